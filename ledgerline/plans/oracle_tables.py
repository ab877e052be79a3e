"""Shared tables of the checking SQL, written for DuckDB on the given tables."""

from ledgerline.settings import FORECAST_LOG, FORECAST_PLAIN


def _correlation(column: str) -> str:
    x, y = f"cast({column} as double)", f"case when {column} is not null then target_turnover_next_year end"
    return f"covar_pop({x}, {y}) / nullif(stddev_pop({x}) * stddev_pop({y}), 0) as {column}"


ORACLE_TABLES = {
    "x_company": """
select 'c'||c_custkey as company_id, c_custkey as ordinal, c_name as company_name,
  'The '||c_mktsegment||case when c_nationkey < 12 then ' Holdings Ltd.' else ' (UK) PLC' end as trading_name,
  case when c_nationkey <> 0 then 'CH'||(case when c_acctbal < 0 then c_custkey + 1 else c_custkey end) end as ch_no,
  'https://profiles.example/'||lower(c_mktsegment)||'/'||c_nationkey||'/'||cast(floor(abs(c_acctbal)/500) as bigint) as profile_url,
  c_mktsegment as value_stream,
  case c_mktsegment when 'AUTOMOBILE' then 'ACE' when 'BUILDING' then 'Beyond Earth'
    when 'FURNITURE' then 'Resilient Earth' when 'HOUSEHOLD' then 'Cross-cutting' end as mission,
  cast(c_nationkey as double) as sic_code_1, c_nationkey + 1995 as founded_year, c_acctbal as balance
from customer""",
    "x_lines": """
select l_orderkey, sum(cast(l_quantity as decimal(18,2))) q, sum(cast(l_extendedprice as decimal(18,2))) a,
  sum(case when l_returnflag='R' then cast(l_extendedprice as decimal(18,2)) end) x
from lineitem group by l_orderkey""",
    "x_yearly": """
select 'c'||o_custkey as company_id, year(o_orderdate)+20 as accounting_year,
  cast(sum(cast(o_totalprice as decimal(18,2)))*20 as double) as turnover, cast(sum(q) as double) as employees,
  cast(sum(a) as double) as total_assets, cast(sum(x) as double) as export_revenue,
  min(cast(o_orderdate as date) + interval 20 year) as first_date, max(cast(o_orderdate as date) + interval 20 year) as last_date
from orders left join x_lines on l_orderkey = o_orderkey group by 1, 2""",
    "x_filings": """
select *, case when employees is not null then
  cast(case when accounting_year = min(accounting_year) over (partition by company_id)
    then ceil((date_diff('day', cast(first_date as date), make_date(accounting_year, 12, 31)) + 1) / 7.0) else 52 end as double) end as weeks
from x_yearly""",
    "x_filed": """
select f.company_id, f.accounting_year, case when c.balance >= 0 then f.turnover end as turnover, f.employees, f.total_assets,
  f.export_revenue, f.weeks, f.first_date, f.last_date, c.ordinal, c.company_name, c.mission, c.value_stream, c.sic_code_1,
  c.founded_year, c.balance
from x_filings f join x_company c on c.company_id = f.company_id""",
    "x_size": """
select company_id, accounting_year, case when employees < 10 then 'Micro' when employees < 50 then 'Small'
  when employees < 250 then 'Medium' when employees is not null then 'Large' end as company_size from x_filings""",
    "x_raw_panel": """
select f.company_id, f.company_name, case when f.mission = 'Cross-cutting' then 'Cross-Cutting' else f.mission end as mission,
  f.value_stream, f.sic_code_1, f.founded_year, f.accounting_year, f.turnover, f.employees, f.total_assets, f.export_revenue,
  f.weeks, s.company_size, case when f.accounting_year >= f.founded_year then f.accounting_year - f.founded_year end as company_age
from x_filed f join x_size s on s.company_id = f.company_id and s.accounting_year = f.accounting_year
where f.turnover is not null and f.mission is not null""",
    "x_panel": """
select * exclude (turnover, weeks), turnover * coalesce(52.0 / weeks, 1.0) as turnover from x_raw_panel""",
    "x_baseline": """
select company_id, company_name, case when mission = 'Cross-cutting' then 'Cross-Cutting' else mission end as mission,
  accounting_year as baseline_year,
  coalesce(turnover * coalesce(52.0 / weeks, 1.0), total_assets / 10) as baseline_turnover,
  case when turnover is not null then 'observed' when total_assets is not null then 'estimated' end as turnover_source,
  case when turnover is not null then 'observed' when employees is null then 'low' else 'standard' end as baseline_reliability,
  case when turnover is null and employees is null then 'no_covariate_data_any_year' else '' end as reliability_reason,
  case when turnover is not null then 'observed' else 'predicted' end as turnover_source_raw
from x_filed where mission is not null
qualify row_number() over (partition by company_id order by accounting_year desc) = 1""",
    "x_dirty": """
select case when c_nationkey = 7 and o_orderstatus = 'P' then null when c_nationkey = 8 and o_orderstatus = 'P' then ' '
    else 'c'||o_custkey end as company_id,
  case when c_nationkey = 9 and o_orderstatus = 'O' then 1900 when c_nationkey = 10 and o_orderstatus = 'F' then 2015.5
    when c_nationkey = 10 and o_orderstatus = 'O' then 15 else year(o_orderdate) + 20 end as accounting_year,
  case when o_orderstatus = 'F' and c_nationkey = 11 then 'n/a' when o_orderstatus = 'F' and c_nationkey = 12 then '-5'
    when o_orderstatus = 'F' and c_nationkey = 13 then '-inf' when o_orderstatus = 'F' and c_nationkey = 14 then 'inf'
    when o_orderstatus = 'F' and c_nationkey = 15 then null
    else cast(sum(cast(o_totalprice as decimal(18,2))) as varchar) end as turnover,
  case when c_nationkey = 16 then 1000000.0 else count(*) end as employees,
  case when c_mktsegment = 'MACHINERY' then (case when c_nationkey >= 12 then 'Unknown' end)
    when c_nationkey = 17 then lower(m.mission)||' ' else m.mission end as mission,
  min(o_orderkey) as ordinal, c_nationkey as nation, o_orderstatus as status
from orders join customer on c_custkey = o_custkey join x_company m on m.ordinal = o_custkey
group by o_custkey, year(o_orderdate), o_orderstatus, c_nationkey, c_mktsegment, m.mission""",
    "x_lagged": """
select *, turnover as turnover_t,
  lag(turnover, 1) over w as turnover_lag_1, lag(turnover, 2) over w as turnover_lag_2, lag(turnover, 3) over w as turnover_lag_3,
  lag(employees) over w as employees_before, lag(total_assets) over w as assets_before,
  lag(accounting_year) over w as year_before, lead(accounting_year) over w as year_after, lead(turnover) over w as turnover_after,
  row_number() over w as position, accounting_year - row_number() over w as island
from x_panel window w as (partition by company_id order by accounting_year)""",
    "x_growth": """
select *, ln(1 + turnover_t) - ln(1 + turnover_lag_1) as log_growth_1y,
  row_number() over (partition by company_id, island order by accounting_year) as run_here
from x_lagged""",
    "x_rolled": """
select *,
  avg(log_growth_1y) over (partition by company_id order by accounting_year rows between 1 preceding and current row) as log_growth_2y_mean,
  avg(log_growth_1y) over (partition by company_id order by accounting_year rows between 2 preceding and current row) as log_growth_3y_mean,
  stddev_samp(log_growth_1y) over (partition by company_id order by accounting_year rows between 2 preceding and current row) as growth_volatility,
  log_growth_1y - lag(log_growth_1y) over (partition by company_id order by accounting_year) as growth_acceleration,
  sum(case when log_growth_1y is not null then cast(log_growth_1y > 0 as int) end) over (partition by company_id order by accounting_year rows unbounded preceding) as positive_growth_count,
  sum(case when log_growth_1y is not null then cast(log_growth_1y < 0 as int) end) over (partition by company_id order by accounting_year rows unbounded preceding) as negative_growth_count,
  avg(turnover) over (partition by company_id order by accounting_year rows between 1 preceding and current row) as rolling_turnover_mean_2,
  avg(turnover) over (partition by company_id order by accounting_year rows between 2 preceding and current row) as rolling_turnover_mean_3,
  median(turnover) over (partition by company_id order by accounting_year rows between 2 preceding and current row) as rolling_turnover_median_3,
  max(turnover) over (partition by company_id order by accounting_year rows unbounded preceding) as historical_turnover_max,
  min(turnover) over (partition by company_id order by accounting_year rows unbounded preceding) as historical_turnover_min,
  accounting_year - min(accounting_year) over (partition by company_id order by accounting_year rows unbounded preceding) as history_span_years
from x_growth""",
    "x_features": """
select *, ln(1 + turnover_t) as log_turnover_t, ln(1 + turnover_lag_1) as log_turnover_lag_1, ln(1 + turnover_lag_2) as log_turnover_lag_2,
  log_growth_3y_mean as rolling_growth_mean_3, growth_volatility as rolling_growth_std_3,
  position - 1 as n_prior_turnover_values, accounting_year - year_before as years_since_previous_turnover,
  run_here as consecutive_history_length_to_date, position >= 2 as has_growth_history, position >= 3 as has_three_year_history,
  case when employees <> 0 then total_assets / employees end as assets_per_employee,
  case when turnover <> 0 then export_revenue / turnover end as export_share,
  ln(1 + employees) - ln(1 + employees_before) as employee_growth,
  ln(1 + total_assets) - ln(1 + assets_before) as asset_growth,
  turnover_lag_1 is null as is_missing_turnover_lag_1, turnover_lag_2 is null as is_missing_turnover_lag_2,
  turnover_lag_3 is null as is_missing_turnover_lag_3, total_assets is null as is_missing_total_assets,
  employees is null as is_missing_employees, export_revenue is null as is_missing_export_revenue,
  employees is not null as has_employee_data, total_assets is not null as has_financial_statement_data
from x_rolled""",
    "x_engineered": """
select *, missing_feature_count / 39.0 as missing_feature_proportion from (
 select *, (turnover_t is null)::int + (turnover_lag_1 is null)::int + (turnover_lag_2 is null)::int + (turnover_lag_3 is null)::int
  + (log_turnover_t is null)::int + (log_turnover_lag_1 is null)::int + (log_turnover_lag_2 is null)::int
  + (log_growth_1y is null)::int + (log_growth_2y_mean is null)::int + (log_growth_3y_mean is null)::int + (rolling_growth_mean_3 is null)::int
  + (growth_volatility is null)::int + (rolling_growth_std_3 is null)::int + (growth_acceleration is null)::int
  + (positive_growth_count is null)::int + (negative_growth_count is null)::int
  + (rolling_turnover_mean_2 is null)::int + (rolling_turnover_mean_3 is null)::int + (rolling_turnover_median_3 is null)::int
  + (historical_turnover_max is null)::int + (historical_turnover_min is null)::int + (history_span_years is null)::int
  + (years_since_previous_turnover is null)::int + (assets_per_employee is null)::int + (export_share is null)::int
  + (employee_growth is null)::int + (asset_growth is null)::int as missing_feature_count
 from x_features) z""",
    "x_training": """
select *, turnover_after as target_turnover_next_year, year_after as target_year
from x_engineered where year_after = accounting_year + 1""",
    "x_history": """
select company_id, count(*) as n_turnover_years, min(accounting_year) as first_turnover_year, max(accounting_year) as latest_turnover_year,
  max(accounting_year) - min(accounting_year) as history_span,
  (select max(accounting_year) from x_panel) - max(accounting_year) as years_since_latest_turnover,
  arg_max(run_here, accounting_year) as consecutive_history_length
from x_growth group by company_id""",
    "x_groups": """
select b.*, coalesce(h.n_turnover_years, 0) as n_turnover_years,
  case when h.n_turnover_years >= 3 then 'A' when h.n_turnover_years = 2 then 'B' when h.n_turnover_years = 1 then 'C'
    when b.turnover_source = 'estimated' then 'D' else 'UNCLASSIFIED' end as forecast_evidence_group
from x_baseline b left join x_history h on h.company_id = b.company_id""",
    "x_cutoffs": "select unnest([2018, 2019, 2020, 2021]) as cutoff_year",
    "x_outer": """
select t.*, c.cutoff_year, case when t.target_year <= c.cutoff_year then 'train' else 'test' end as role
from x_training t, x_cutoffs c
qualify count(*) filter (where t.target_year <= c.cutoff_year) over (partition by t.mission, c.cutoff_year) > 0
  and count(*) filter (where t.target_year > c.cutoff_year) over (partition by t.mission, c.cutoff_year) > 0""",
    "x_mean_growth": """
select mission, cutoff_year, coalesce(avg(log_growth_1y) filter (where target_year <= cutoff_year), 0) as mean_growth
from x_training, x_cutoffs group by 1, 2""",
    "x_tests": """
select o.*, case when target_year - o.cutoff_year >= 4 then '4+' else cast(target_year - o.cutoff_year as varchar) end as horizon,
  turnover_t as persistence, exp(ln(1 + turnover_t) + mean_growth) - 1 as mean_growth_forecast,
  exp(ln(1 + turnover_t) + coalesce(log_growth_3y_mean, log_growth_2y_mean, log_growth_1y, 0)) - 1 as cagr
from x_outer o join x_mean_growth g on g.mission = o.mission and g.cutoff_year = o.cutoff_year where role = 'test'""",
    "x_predictions": """
select company_id, accounting_year, mission, cutoff_year, horizon, log_growth_1y, target_turnover_next_year as y, 'Persistence' as "Model", persistence as p from x_tests
union all select company_id, accounting_year, mission, cutoff_year, horizon, log_growth_1y, target_turnover_next_year, 'Mission-Average Growth', mean_growth_forecast from x_tests
union all select company_id, accounting_year, mission, cutoff_year, horizon, log_growth_1y, target_turnover_next_year, 'Company Historical CAGR', cagr from x_tests""",
    "x_folds": """
select mission, cutoff_year, horizon, "Model", count(*) as n_test_rows, avg(abs(y - p)) as "MAE", sqrt(avg((y - p) * (y - p))) as "RMSE",
  case when count(*) >= 2 then 1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)) end as "R2"
from x_predictions where mission <> 'Cross-Cutting' group by 1, 2, 3, 4""",
    "x_metric_summary": """
select mission, horizon, "Model", avg("MAE") as "MAE_mean", stddev_samp("MAE") as "MAE_std", avg("RMSE") as "RMSE_mean", stddev_samp("RMSE") as "RMSE_std",
  avg("R2") as "R2_mean", stddev_samp("R2") as "R2_std", count("MAE") as n_folds, sum(n_test_rows) as n_test_rows_total
from x_folds group by 1, 2, 3""",
    "x_robust": """
select *, had_broken_fold_r2 or had_mae_blowup_fold as robustness_violation from (
 select mission, horizon, "Model", coalesce(bool_or("R2" < -2), false) as had_broken_fold_r2,
  coalesce(median("MAE") > 0 and max("MAE") > 3 * median("MAE"), false) as had_mae_blowup_fold,
  min("R2") as worst_fold_r2, max("MAE") as max_fold_mae from x_folds group by 1, 2, 3) z""",
    "x_ranks": """
select *,
  case when "MAE_mean" is not null then rank() over (partition by mission, horizon order by "MAE_mean" nulls last) + (count(*) over (partition by mission, horizon, "MAE_mean") - 1) / 2.0 end as r1,
  case when "RMSE_mean" is not null then rank() over (partition by mission, horizon order by "RMSE_mean" nulls last) + (count(*) over (partition by mission, horizon, "RMSE_mean") - 1) / 2.0 end as r2,
  case when "R2_mean" is not null then rank() over (partition by mission, horizon order by "R2_mean" desc nulls last) + (count(*) over (partition by mission, horizon, "R2_mean") - 1) / 2.0 end as r3,
  case when "MAE_std" is not null then rank() over (partition by mission, horizon order by "MAE_std" nulls last) + (count(*) over (partition by mission, horizon, "MAE_std") - 1) / 2.0 end as r4,
  case when "RMSE_std" is not null then rank() over (partition by mission, horizon order by "RMSE_std" nulls last) + (count(*) over (partition by mission, horizon, "RMSE_std") - 1) / 2.0 end as r5,
  case when "R2_std" is not null then rank() over (partition by mission, horizon order by "R2_std" nulls last) + (count(*) over (partition by mission, horizon, "R2_std") - 1) / 2.0 end as r6
from x_metric_summary""",
    "x_ranked": """
select k.*, v.had_broken_fold_r2, v.had_mae_blowup_fold, v.worst_fold_r2, v.max_fold_mae, v.robustness_violation,
  round_even(list_avg([k.r1, k.r2, k.r3, k.r4, k.r5, k.r6]), 2) as composite_rank, 0 as simplicity_rank
from x_ranks k join x_robust v on v.mission = k.mission and v.horizon = k.horizon and v."Model" = k."Model" """,
    "x_pool": """
select *, row_number() over (partition by mission, horizon order by composite_rank, simplicity_rank, "Model") as place,
  count(*) filter (where not robustness_violation) over (partition by mission, horizon) as n_robust
from x_ranked qualify not robustness_violation or count(*) filter (where not robustness_violation) over (partition by mission, horizon) = 0""",
    "x_close": """
select p.*, t."Model" as top_model, p.place = 1 or coalesce(p.composite_rank <= t.composite_rank + 1.0 and abs(p."R2_mean" - t."R2_mean") < 0.05, false) as is_close
from x_pool p join x_pool t on t.mission = p.mission and t.horizon = p.horizon and t.place = 1""",
    "x_winner": """
select * from x_close where is_close
qualify row_number() over (partition by mission, horizon order by simplicity_rank, composite_rank, "Model") = 1""",
    "x_second": """
select c.* from x_close c join x_winner w on w.mission = c.mission and w.horizon = c.horizon and w."Model" <> c."Model"
qualify row_number() over (partition by c.mission, c.horizon order by c.composite_rank, c.simplicity_rank, c."Model") = 1""",
    "x_selected": """
select w.mission, w.horizon, w."Model" as selected_model, s."Model" as runner_up,
  concat_ws(',', case when w."MAE_mean" < s."MAE_mean" then 'MAE_mean' end, case when w."RMSE_mean" < s."RMSE_mean" then 'RMSE_mean' end,
    case when w."R2_mean" > s."R2_mean" then 'R2_mean' end, case when w."MAE_std" < s."MAE_std" then 'MAE_std' end,
    case when w."RMSE_std" < s."RMSE_std" then 'RMSE_std' end, case when w."R2_std" < s."R2_std" then 'R2_std' end) as beats_runner_up_on,
  w."R2_mean" - s."R2_mean" as margin_r2, case when s."MAE_mean" > 0 then (s."MAE_mean" - w."MAE_mean") / s."MAE_mean" * 100 end as margin_mae_pct,
  w."R2_mean" as r2_mean, w."MAE_mean" as mae_mean,
  (select count(*) from x_close c where c.is_close and c.mission = w.mission and c.horizon = w.horizon) > 1 as tie_break_used,
  w.n_robust = 0 as fallback_used_no_robust_survivor, w.top_model as top_ranked_model, w."Model" = w.top_model as winner_is_top_ranked,
  coalesce(w."R2_mean" > 0, false) as usable
from x_winner w left join x_second s on s.mission = w.mission and s.horizon = w.horizon""",
    "x_anchor": """
select mission, median(log_growth_1y) as anchor from x_engineered group by mission""",
    "x_cells": """
select e.mission, g.forecast_evidence_group, stddev_samp(e.log_growth_1y) as std, count(*) as n
from x_engineered e join x_groups g on g.company_id = e.company_id where e.log_growth_1y is not null group by 1, 2""",
    "x_spread": """
select m.mission, l.letter as forecast_evidence_group, coalesce(c.n, 0) as "count", coalesce(c.n, 0) < 5 as used_fallback_spread,
  case when coalesce(c.n, 0) < 5 then (select max(k.std) from x_cells k where k.mission = m.mission and k.n >= 5) else c.std end as sigma_log_residual
from (select distinct mission from x_engineered) m, (select unnest(['A', 'B', 'C', 'D']) as letter) l
left join x_cells c on c.mission = m.mission and c.forecast_evidence_group = l.letter""",
    "x_seeded": """
select company_id, mission, accounting_year, turnover, founded_year, employees, total_assets, export_revenue from x_panel
union all
select b.company_id, b.mission, b.baseline_year, b.baseline_turnover, c.founded_year, null, null, null
from x_baseline b join x_company c on c.company_id = b.company_id
where b.turnover_source = 'estimated' and not exists (select 1 from x_panel p where p.company_id = b.company_id and p.accounting_year = b.baseline_year)""",
    "x_origin_growth": """
select *, ln(1 + turnover) - ln(1 + lag(turnover) over (partition by company_id order by accounting_year)) as g from x_seeded""",
    "x_origin": """
select company_id, mission, accounting_year, turnover as t, founded_year, employees, g as g0,
  lag(g, 1) over (partition by company_id order by accounting_year) as g1,
  lag(g, 2) over (partition by company_id order by accounting_year) as g2
from x_origin_growth""",
    "x_forecast": """
select o.company_id, o.mission, cast(o.accounting_year as bigint) as accounting_year, o.t as turnover, o.g0, o.g1, o.g2,
  coalesce(g.forecast_evidence_group, 'D') as evidence_group, a.anchor, cast(0 as bigint) as step, cast(o.founded_year as bigint) as founded_year,
  o.employees, cast(null as varchar) as growth_signal, cast(null as varchar) as growth_classification
from x_origin o join x_baseline b on b.company_id = o.company_id and b.baseline_year = o.accounting_year
left join x_groups g on g.company_id = o.company_id left join x_anchor a on a.mission = o.mission
union all
select company_id, mission, accounting_year + 1, nt, ln(1 + nt) - ln(1 + turnover), g0, g1, evidence_group, anchor, step + 1, founded_year,
  employees, signal, class
from (
  select *, case when class = 'growing'
    then exp(ln(1 + turnover) + pow(0.5, (step + 1) / 2.0) * coalesce(m, 0) + (1 - pow(0.5, (step + 1) / 2.0)) * anchor) - 1 else turnover end as nt
  from (select *, case when signal = 'growing' and evidence_group = 'A' then 'growing' else 'stable' end as class
    from (select *, case when coalesce(m, g0) > ln(1.1) then 'growing' else 'stable' end as signal
      from (select *, list_avg([g2, g1, g0]) as m from x_forecast where accounting_year < 2030) s0) s1) s2) s3
where nt is not null and nt >= 0""",
    "x_trajectories": """
select f.*, case when growth_classification = 'growing' then 'Company Historical CAGR' else 'Persistence' end as model_used,
  accounting_year - founded_year as company_age, s.sigma_log_residual, s.used_fallback_spread,
  greatest(exp(ln(1 + turnover) - 1.96 * s.sigma_log_residual * sqrt(step)) - 1, 0) as turnover_lower,
  exp(ln(1 + turnover) + 1.96 * s.sigma_log_residual * sqrt(step)) - 1 as turnover_upper
from x_forecast f left join x_spread s on s.mission = f.mission and s.forecast_evidence_group = f.evidence_group
where step > 0""",
    "x_full": """
select company_id, mission, accounting_year, turnover, 'observed' as data_type, cast(null as varchar) as model_used, cast(null as varchar) as growth_classification,
  cast(null as double) as turnover_lower, cast(null as double) as turnover_upper from x_panel
union all
select b.company_id, b.mission, b.baseline_year, b.baseline_turnover, 'estimated_baseline', cast(null as varchar), cast(null as varchar), cast(null as double), cast(null as double) from x_baseline b
where not exists (select 1 from x_panel p where p.company_id = b.company_id and p.accounting_year = b.baseline_year)
union all
select company_id, mission, accounting_year, turnover, 'predicted', model_used, growth_classification, turnover_lower, turnover_upper from x_trajectories""",
    "x_summary": """
select g.*, f.turnover as turnover_2030, case when g.baseline_turnover <> 0 then f.turnover / g.baseline_turnover end as growth_multiple_2030,
  case when g.baseline_year < 2030 and g.baseline_turnover <> 0 then pow(f.turnover / g.baseline_turnover, 1.0 / (2030 - g.baseline_year)) - 1 end as annualized_growth_rate_to_2030,
  coalesce(p.growing, 0) as n_years_growing, coalesce(p.stable, 0) as n_years_stable, p.last_model as final_step_model_used,
  coalesce(p.growing, 0) > 0 as ever_classified_growing
from x_groups g left join x_full f on f.company_id = g.company_id and f.accounting_year = 2030
left join (select company_id, count(*) filter (where growth_classification = 'growing') as growing, count(*) filter (where growth_classification = 'stable') as stable,
  arg_max(model_used, accounting_year) as last_model from x_trajectories group by 1) p on p.company_id = g.company_id""",
    "x_walk": """
select *, coalesce(accounting_year - lag(accounting_year) over w = 1
    and ln(1 + turnover) - ln(1 + lag(turnover) over w) >= ln(1.1), false) as hit10,
  coalesce(accounting_year - lag(accounting_year) over w = 1
    and ln(1 + turnover) - ln(1 + lag(turnover) over w) >= ln(1.2), false) as hit20
from x_full window w as (partition by company_id order by accounting_year)""",
    "x_runs": """
select company_id, max(run10) as longest_run_10pct, max(run20) as longest_run_20pct, max(run10) >= 3 as gazelle_10pct, max(run20) >= 3 as gazelle_20pct from (
  select company_id, sum(hit10::int) over (partition by company_id, block10 order by accounting_year) as run10,
    sum(hit20::int) over (partition by company_id, block20 order by accounting_year) as run20 from (
    select *, sum((not hit10)::int) over (partition by company_id order by accounting_year rows unbounded preceding) as block10,
      sum((not hit20)::int) over (partition by company_id order by accounting_year rows unbounded preceding) as block20 from x_walk) z) y
group by company_id""",
    "x_op_walk": """
select company_id, accounting_year, employee_growth, asset_growth,
  coalesce(accounting_year - year_before = 1 and employee_growth >= ln(1.1), false) as e10,
  coalesce(accounting_year - year_before = 1 and employee_growth >= ln(1.2), false) as e20,
  coalesce(accounting_year - year_before = 1 and asset_growth >= ln(1.1), false) as a10,
  coalesce(accounting_year - year_before = 1 and asset_growth >= ln(1.2), false) as a20
from x_engineered""",
    "x_op_blocks": """
select *, sum((not e10)::int) over w as be10, sum((not e20)::int) over w as be20, sum((not a10)::int) over w as ba10, sum((not a20)::int) over w as ba20
from x_op_walk window w as (partition by company_id order by accounting_year rows unbounded preceding)""",
    "x_op_runs": """
select company_id, employee_growth, asset_growth, sum(e10::int) over (partition by company_id, be10) as re10, sum(e20::int) over (partition by company_id, be20) as re20,
  sum(a10::int) over (partition by company_id, ba10) as ra10, sum(a20::int) over (partition by company_id, ba20) as ra20 from x_op_blocks""",
    "x_scaling": """
select *, employee_growth_10pct or asset_growth_10pct as operational_scaling_10pct, employee_growth_20pct or asset_growth_20pct as operational_scaling_20pct from (
  select company_id, count(employee_growth) as n_real_years_employee_growth, count(asset_growth) as n_real_years_asset_growth,
    count(employee_growth) >= 3 and max(re10) >= 3 as employee_growth_10pct, count(employee_growth) >= 3 and max(re20) >= 3 as employee_growth_20pct,
    count(asset_growth) >= 3 and max(ra10) >= 3 as asset_growth_10pct, count(asset_growth) >= 3 and max(ra20) >= 3 as asset_growth_20pct
  from x_op_runs group by company_id) z""",
    "x_context": """
select s.company_id, s.company_name, s.mission, s.baseline_year, s.baseline_turnover, s.turnover_2030, s.forecast_evidence_group,
  s.turnover_source as baseline_turnover_source, s.ever_classified_growing as growth_decay_applied,
  (select count(*) from x_panel p where p.company_id = s.company_id) as n_real_years,
  coalesce((select bool_or(t.growth_signal = 'growing' and t.growth_classification = 'stable') from x_trajectories t where t.company_id = s.company_id), false) as evidence_gate_triggered
from x_summary s""",
    "x_recent": """
select company_id, max(turnover) as max_recent_turnover from (
  select * from x_panel qualify row_number() over (partition by company_id order by accounting_year desc) <= 5) z group by company_id""",
    "x_intersection": """
select c.*, r.longest_run_10pct, r.longest_run_20pct, r.gazelle_10pct, r.gazelle_20pct,
  case when c.forecast_evidence_group = 'A' and coalesce(k.max_recent_turnover, 0) >= 1000000 then 'meets_credibility_threshold'
    else 'does_not_meet_credibility_threshold' end as credibility_status
from x_context c join x_runs r on r.company_id = c.company_id and (r.gazelle_10pct or r.gazelle_20pct)
left join x_recent k on k.company_id = c.company_id where c.turnover_2030 >= 50000000""",
    "x_sup_years": """
select l_suppkey, year(l_shipdate) + 20 as year, cast(sum(cast(l_extendedprice as decimal(18,2)))*2 as double) as turnover,
  cast(sum(cast(l_quantity as decimal(18,2))) as double) as employees,
  cast(sum(case when l_returnflag = 'A' then cast(l_extendedprice as decimal(18,2)) end) as double) as assets,
  cast(least(count(distinct weekofyear(cast(l_shipdate as date) + interval 20 year)), 52) as double) as weeks,
  max(cast(l_shipdate as date)) as ship_date
from lineitem group by 1, 2""",
    "x_suppliers": """
select s_suppkey as ordinal, 'CH'||(s_nationkey * 100000 + s_suppkey) as key, s_name, s_nationkey as nation, s_acctbal as balance,
  'ch_CH'||(s_nationkey * 100000 + s_suppkey)||'_'||regexp_replace(lower(s_name), '[^a-z0-9]', '', 'g') as company_id,
  cast(s_nationkey as double) as sic_code_1
from supplier where s_suppkey in (select l_suppkey from lineitem)""",
    "x_adjacent": """
select m.mission, s.* from x_suppliers s join (
  select 'ACE' as mission, ordinal from x_suppliers where balance >= 4000 or nation < 10
  union all select 'Beyond Earth', ordinal from x_suppliers where balance < 6000
  union all select 'Resilient Earth', ordinal from x_suppliers where nation >= 12
  union all select 'Cross-cutting', ordinal from x_suppliers where nation < 5) m on m.ordinal = s.ordinal
where s.key not in (select upper(ch_no) from x_company where ch_no is not null)""",
    "x_adjacent_panel": """
select a.mission, a.company_id, y.year, y.turnover, y.employees, y.assets, y.weeks, a.ordinal, a.sic_code_1, a.s_name, y.ship_date
from x_adjacent a join x_sup_years y on y.l_suppkey = a.ordinal""",
    "x_events": """
select user_id,
  count(*) filter (where event_type = 'click') as grants_count, count(*) filter (where event_type = 'purchase') as fundraising_count,
  case when max(cast(value as decimal(18,2))) filter (where event_type = 'click') >= 25 then cast(sum(cast(value as decimal(18,2))) filter (where event_type = 'click') as double) end as grants_total_amount,
  case when max(cast(value as decimal(18,2))) filter (where event_type = 'purchase') >= 25 then cast(sum(cast(value as decimal(18,2))) filter (where event_type = 'purchase') as double) end as fundraising_total_amount,
  year(cast(max(ts) filter (where event_type = 'click') as date) - to_months(cast(floor(max(cast(value as decimal(18,2))) filter (where event_type = 'click')) as int))) as grant_year,
  year(cast(max(ts) filter (where event_type = 'purchase') as date) - to_months(cast(floor(max(cast(value as decimal(18,2))) filter (where event_type = 'purchase')) as int))) as fundraising_year,
  count(*) filter (where event_type = 'click' and cast(value as decimal(18,2)) > 20) > 0 as s1, count(*) filter (where event_type = 'view' and cast(value as decimal(18,2)) > 25) > 0 as s2,
  count(*) filter (where event_type = 'purchase' and cast(value as decimal(18,2)) > 30) > 0 as s3, count(*) filter (where event_type = 'signup' and cast(value as decimal(18,2)) > 35) > 0 as s4,
  count(*) filter (where event_type = 'error' and cast(value as decimal(18,2)) > 40) > 0 as s5, count(*) filter (where event_type = 'click' and cast(value as decimal(18,2)) > 45) > 0 as s6,
  count(*) filter (where event_type = 'view' and cast(value as decimal(18,2)) > 50) > 0 as s7, count(*) filter (where event_type = 'purchase' and cast(value as decimal(18,2)) > 55) > 0 as s8,
  (select count(distinct e.event_type) from events e where e.user_id = events.user_id and e.event_type in ('click', 'view', 'purchase', 'signup', 'error') and cast(e.value as decimal(18,2)) > 30) as accelerator_count,
  count(*) filter (where event_type in ('click', 'view') and cast(value as decimal(18,2)) > 45) > 0 as is_academic_spinout
from events group by user_id""",
    "x_bridge": """
select lower(profile_url) as url_norm, arg_min(company_id, ordinal) as company_id from x_company group by 1""",
    "x_bridged": """
select c.ordinal, c.company_id as own_id, b.company_id from x_company c join x_bridge b on b.url_norm = lower(c.profile_url)""",
    "x_signals": """
select b.company_id, e.* from x_bridged b join x_events e on e.user_id = b.ordinal
qualify row_number() over (partition by b.company_id order by b.ordinal) = 1""",
    "x_last_filing": """
select * from x_filings qualify row_number() over (partition by company_id order by accounting_year desc) = 1""",
    "x_ratios": """
select b.company_id, f.accounting_year as year, f.total_assets / f.turnover as fs1_current_ratio, f.export_revenue / f.turnover as fs1_liquidity_acid_test,
  f.export_revenue / f.total_assets * 100 as fs1_gearing_pct, f.turnover / f.total_assets as fs1_equity_pct, f.employees / f.weeks as fs1_current_debt_ratio,
  f.employees / f.turnover * 1000 as fs1_total_debt_ratio, f.total_assets / f.employees / 100 as fs1_roce_pct,
  f.turnover / f.employees / 100 as fs1_rota_pct, f.export_revenue / f.employees / 100 as fs1_ronae_pct
from x_bridged b join x_last_filing f on f.company_id = b.own_id
qualify row_number() over (partition by b.company_id, f.accounting_year order by b.ordinal) = 1""",
    "x_weeks": """
select company_id, year, weeks, 52.0 / weeks as annualization_factor from (
  select b.company_id, f.accounting_year as year, f.weeks, b.ordinal,
    row_number() over (partition by f.company_id order by f.accounting_year desc) as block
  from x_bridged b join x_filings f on f.company_id = b.own_id) z
where weeks is not null
qualify row_number() over (partition by company_id, year order by block, ordinal) = 1""",
    "x_covariates": """
select f.company_id, f.accounting_year as year, case when c.balance >= 0 then f.turnover end as total_turnover,
  case when c.sic_code_1 >= 5 and c.balance >= -900 then f.employees end as total_employees_ch,
  case when c.balance >= -900 then f.employees * 2 end as total_employees_est,
  case when c.balance >= -900 then f.total_assets end as balance_sheet_total_assets,
  case when c.balance >= -900 then f.export_revenue end as total_export_revenue,
  case when c.balance >= -900 then z.company_size end as company_size,
  c.mission, c.value_stream, c.sic_code_1, c.founded_year, c.trading_name, c.company_name, c.ordinal, c.balance
from x_filings f join x_company c on c.company_id = f.company_id
join x_size z on z.company_id = f.company_id and z.accounting_year = f.accounting_year""",
    "x_labelled": """
select *, coalesce(total_employees_ch, total_employees_est) as total_employees,
  case when total_employees_ch is not null then 'filed' when total_employees_est is not null then 'estimated' end as employee_count_source,
  1.0 / count(*) over (partition by company_id) as sample_weight, 'space' as population_type
from x_covariates where total_turnover is not null""",
    "x_label_features": """
select l.*, s.grants_count, s.fundraising_count, s.grants_total_amount, s.fundraising_total_amount, s.accelerator_count,
  case when l.year >= s.grant_year then l.year - s.grant_year end as grant_recency_years,
  case when l.year >= s.fundraising_year then l.year - s.fundraising_year end as fundraising_recency_years,
  case when l.year >= l.founded_year then l.year - l.founded_year end as company_age_years,
  case when l.total_employees <> 0 then l.balance_sheet_total_assets / l.total_employees end as assets_per_employee,
  case when l.total_employees <> 0 then l.total_export_revenue / l.total_employees end as export_revenue_per_employee,
  r.fs1_current_ratio, r.fs1_gearing_pct, cast(s.s1 as int) as signal_equity_fundraising, cast(s.is_academic_spinout as int) as is_academic_spinout
from x_labelled l left join x_signals s on s.company_id = l.company_id left join x_ratios r on r.company_id = l.company_id and r.year = l.year""",
    "x_snapshot": """
select c.company_id, c.mission, c.value_stream, c.sic_code_1, c.founded_year, c.balance, coalesce(v.year, 2025) as year, v.total_employees_ch,
  v.total_employees_est, v.balance_sheet_total_assets, v.total_export_revenue, v.company_size, v.year is null as is_fallback_year
from x_company c left join (
  select * from x_covariates where coalesce(cast(total_employees_ch as varchar), cast(total_employees_est as varchar),
    cast(balance_sheet_total_assets as varchar), cast(total_export_revenue as varchar), company_size) is not null
  qualify row_number() over (partition by company_id order by year desc) = 1) v on v.company_id = c.company_id
where c.balance < 0""",
    "x_snapshot_features": """
select s.*, coalesce(total_employees_ch, total_employees_est) as total_employees,
  case when total_employees_ch is not null then 'filed' when total_employees_est is not null then 'estimated' end as employee_count_source,
  case when s.year >= s.founded_year then s.year - s.founded_year end as company_age_years
from x_snapshot s""",
    "x_weights": f"""
select mission, 'log_numeric__'||feature as feature, weight from (select mission, {", ".join(_correlation(c) for c in FORECAST_LOG + FORECAST_PLAIN)}
  from x_training group by mission) unpivot (weight for feature in ({", ".join(FORECAST_LOG + FORECAST_PLAIN)}))""",
    "x_top": """
select mission, feature, substr(feature, 14) as engineered_feature, place from (
  select *, row_number() over (partition by mission order by abs(weight) desc, feature) as place from x_weights where abs(weight) > 1e-9) z where place <= 15""",
}
