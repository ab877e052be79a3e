"""Recursive forecast, trajectories, reports and studies."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions import numeric as N
from ledgerline.lineage import FEATURE_SOURCES, OTHER_FIELDS
from ledgerline.operators import features, forecast, gram, metrics, preprocess, reports, routed, selection, stepwise, studies
from ledgerline.operators.preprocess import ESTIMATION_SET, FORECAST_SET
from ledgerline.plans.catalog_models import TARGET, fitted_weights, forecast_rows, subgroup_rows, training_rows_with_adjacent
from ledgerline.plans.catalog_panel import flow
from ledgerline.plans.flow import ForecastFlow
from ledgerline.plans.registry import query
from ledgerline.settings import CORE_MISSIONS, ENGINEERED, FORECAST_LOG, ROUTING
from ledgerline.sources import writers
from ledgerline.sources.domain import Tables

# --- benchmarks and routing ----------------------------------------------------------

TEST_ROW = "company_id accounting_year:i cutoff_year:i predicted:f"


def tests(t: Tables) -> DataFrame:
    return forecast.benchmark_predictions(flow(t).training)


@query("f1_persistence", TEST_ROW, "select company_id, accounting_year, cutoff_year, persistence as predicted from x_tests")
def _(t):
    return tests(t).withColumn("predicted", F.col("Persistence"))


@query("f2_mean_growth", TEST_ROW, "select company_id, accounting_year, cutoff_year, mean_growth_forecast as predicted from x_tests")
def _(t):
    return tests(t).withColumn("predicted", F.col("`Mission-Average Growth`"))


@query("f3_company_cagr", TEST_ROW, "select company_id, accounting_year, cutoff_year, cagr as predicted from x_tests")
def _(t):
    return tests(t).withColumn("predicted", F.col("`Company Historical CAGR`"))


@query("f4_classify_growth", "company_id accounting_year:i growth_signal", """
select company_id, accounting_year, case when coalesce(log_growth_3y_mean, log_growth_1y) > ln(1.1) then 'growing' else 'stable' end as growth_signal from x_engineered""")
def _(t):
    return features.engineered_panel(t.panel()).withColumn(
        "growth_signal", N.growth_signal(F.col("log_growth_3y_mean"), F.col("log_growth_1y")))


@query("f5_evidence_gate", "company_id accounting_year:i growth_classification gated:b", """
select e.company_id, e.accounting_year, case when log_growth_3y_mean > ln(1.1) and forecast_evidence_group = 'A' then 'growing' else 'stable' end as growth_classification,
  coalesce(log_growth_3y_mean > ln(1.1) and forecast_evidence_group <> 'A', false) as gated from x_engineered e left join x_groups g on g.company_id = e.company_id""")
def _(t):
    f = flow(t)
    rows = f.engineered.join(f.groups.select("company_id", F.col("forecast_evidence_group").alias("evidence_group")), "company_id", "left")
    routed = stepwise.route(rows.fillna("D", ["evidence_group"]))
    return routed.withColumn("gated", (F.col("growth_signal") == "growing") & (F.col("growth_classification") == "stable"))


@query("f6_growth_decay", "company_id accounting_year:i step:i decayed:f", """
select e.company_id, e.accounting_year, s.step, exp(ln(1 + turnover_t) + pow(0.5, s.step / 2.0) * log_growth_3y_mean + (1 - pow(0.5, s.step / 2.0)) * a.anchor) - 1 as decayed
from x_engineered e join x_anchor a on a.mission = e.mission, (select unnest([1, 2, 7]) as step) s where log_growth_3y_mean is not null""")
def _(t):
    from ledgerline.operators.ranks import attach

    f = flow(t)
    rows = attach(f.engineered, forecast.growth_anchor(f.growth), ["mission"]).filter(F.col("log_growth_3y_mean").isNotNull())
    rows = rows.withColumn("step", F.explode(F.array(F.lit(1), F.lit(2), F.lit(7))))
    raw = N.grown(F.col("turnover_t"), F.col("log_growth_3y_mean"))
    return rows.withColumn("decayed", N.decayed(F.col("turnover_t"), raw, F.col("step"), F.col("anchor")))


@query("f7_seed_companies", "company_id accounting_year:i turnover:m founded_year:i employees:r",
       "select company_id, accounting_year, turnover, founded_year, employees from x_seeded")
def _(t):
    return forecast.seed_companies(t.panel(), t.baseline(), t.static())


TRAJECTORY = "company_id mission accounting_year:i turnover:f model_used growth_signal evidence_group growth_classification company_age:i step:i employees:r"


@query("f8_predict_step", TRAJECTORY, "select * from x_trajectories where step = 1")
def _(t):
    f = flow(t)
    origin = stepwise.origin_rows(f.panel, f.baseline, f.groups, f.static)
    scored = stepwise.score(stepwise.route(origin), {}, {}).filter(F.col("next_turnover").isNotNull())
    return stepwise.next_rows(scored).select(*stepwise.OUTPUT)


@query("f9_recursive_forecast", TRAJECTORY, "select * from x_trajectories")
def _(t):
    f = flow(t)
    return forecast.recursive_forecast(f.panel, f.baseline, f.groups, f.static)


@query("f9_stepwise_forecast", TRAJECTORY, "select * from x_trajectories")
def _(t):
    f = flow(t)
    return stepwise.stepwise_forecast(f.panel, f.baseline, f.groups, f.static, {}, {})


FITTED_ROUTES = {mission: model for mission, model in ROUTING.items() if model in gram.FORECAST_LINEAR}


def routing_fits(t: Tables) -> gram.Fits:
    """The routed models, tuned on the last years of their missions and refitted on all rows."""
    rows = writers.written(forecast_rows(t).filter(F.col("mission").isin(list(FITTED_ROUTES))), "routing")
    models = {m: gram.FORECAST_LINEAR[m] for m in sorted(set(FITTED_ROUTES.values()))}
    cut, outers = gram.whole_yearly(rows)
    return gram.fit_final(cut, outers, models, FORECAST_SET, TARGET, None, F.col("mission"))


def routed_flow(t: Tables) -> ForecastFlow:
    """The forecast flow whose growing companies follow their mission's routed model, fitted or not."""
    fits = routing_fits(t)
    routes = {g: routed.LinearRoute.of(fits, g, m) for g, m in FITTED_ROUTES.items() if (0, m) in fits.chosen.get(g, {})}
    own = flow(t)
    return ForecastFlow(own.panel, own.baseline, own.static, routes)


@query("f10_fit_routing_model", "mission feature weight:r metric_type direction")
def _(t):
    return gram.feature_weights(routing_fits(t), FITTED_ROUTES, t.spark)


@query("f8_ridge_route", TRAJECTORY)
def _(t):
    return routed_flow(t).predicted


@query("f13_routed_summary", "company_id mission baseline_year:i baseline_turnover:m turnover_2030:f growth_multiple_2030:r annualized_growth_rate_to_2030:r "
       "n_years_growing:i n_years_stable:i final_step_model_used ever_classified_growing:b forecast_evidence_group")
def _(t):
    return routed_flow(t).summary


@query("g3_routed_intersection", "company_id company_name mission baseline_turnover:m turnover_2030:f forecast_evidence_group gazelle_10pct:b gazelle_20pct:b credibility_status")
def _(t):
    return routed_flow(t).intersection


# --- outputs ------------------------------------------------------------------------------


@query("a11_residual_spread", "mission forecast_evidence_group sigma_log_residual:r count:i used_fallback_spread:b", "select * from x_spread")
def _(t):
    return flow(t).spread


BOUNDS = "company_id accounting_year:i turnover:f turnover_lower:f turnover_upper:f sigma_log_residual:r used_fallback_spread:b"


@query("f11_intervals", BOUNDS, "select * from x_trajectories")
def _(t):
    return flow(t).predicted


@query("s8_idempotent_augment", BOUNDS, "select * from x_trajectories")
def _(t):
    f = flow(t)
    return forecast.with_intervals(f.predicted, f.spread)


@query("f12_full_trajectories", "company_id mission accounting_year:i turnover:f data_type model_used growth_classification turnover_lower:f turnover_upper:f", "select * from x_full")
def _(t):
    return flow(t).trajectories


@query("f13_summary_2030", "company_id mission baseline_year:i baseline_turnover:m turnover_2030:f growth_multiple_2030:r annualized_growth_rate_to_2030:r n_years_growing:i "
       "n_years_stable:i final_step_model_used ever_classified_growing:b forecast_evidence_group", "select * from x_summary")
def _(t):
    return flow(t).summary


# --- reports ---------------------------------------------------------------------------------

CONTEXT = ("company_id company_name mission baseline_year:i baseline_turnover:m turnover_2030:f forecast_evidence_group baseline_turnover_source "
           "growth_decay_applied:b n_real_years:i evidence_gate_triggered:b")


@query("g1_crossings_10m", CONTEXT, "select * from x_context where baseline_turnover < 10000000 and turnover_2030 >= 10000000")
def _(t):
    return reports.crossings(flow(t).context)


@query("g2_gazelle_tiers", CONTEXT + " tier longest_run_10pct:i longest_run_20pct:i", """
select c.*, r.longest_run_10pct, r.longest_run_20pct, '10pct' as tier from x_context c join x_runs r on r.company_id = c.company_id where r.gazelle_10pct
union all select c.*, r.longest_run_10pct, r.longest_run_20pct, '20pct' from x_context c join x_runs r on r.company_id = c.company_id where r.gazelle_20pct""")
def _(t):
    f = flow(t)
    tiers = F.array_compact(F.array(F.when(F.col("gazelle_10pct"), "10pct"), F.when(F.col("gazelle_20pct"), "20pct")))
    return f.context.join(f.runs, "company_id").withColumn("tier", F.explode(tiers))


@query("g3_intersection_50m", CONTEXT + " gazelle_10pct:b gazelle_20pct:b credibility_status", "select * from x_intersection")
def _(t):
    return flow(t).intersection


@query("g4_credibility_gate", "company_id max_recent_turnover:m credible:b", """
select g.company_id, r.max_recent_turnover, g.forecast_evidence_group = 'A' and coalesce(r.max_recent_turnover, 0) >= 1000000 as credible
from x_groups g left join x_recent r on r.company_id = g.company_id""")
def _(t):
    f = flow(t)
    peak = reports.recent_peak(f.trajectories)
    rows = f.groups.join(peak, "company_id", "left")
    passes = (F.col("forecast_evidence_group") == "A") & (F.coalesce("max_recent_turnover", F.lit(0.0)) >= 1000000)
    return rows.withColumn("credible", passes)


@query("g5_operational_scaling", CONTEXT + " employee_growth_10pct:b asset_growth_10pct:b operational_scaling_20pct:b", """
select c.*, s.employee_growth_10pct, s.asset_growth_10pct, s.operational_scaling_20pct from x_context c join x_scaling s on s.company_id = c.company_id where s.operational_scaling_10pct""")
def _(t):
    f = flow(t)
    return reports.scaling_report(f.context, f.scaling)


@query("g6_context", CONTEXT, "select * from x_context")
def _(t):
    return flow(t).context


@query("j16_context_join", CONTEXT + " longest_run_10pct:i operational_scaling_10pct:b", """
select c.*, r.longest_run_10pct, coalesce(s.operational_scaling_10pct, false) as operational_scaling_10pct from x_context c
left join x_runs r on r.company_id = c.company_id left join x_scaling s on s.company_id = c.company_id""")
def _(t):
    f = flow(t)
    out = f.context.join(f.runs, "company_id", "left").join(f.scaling, "company_id", "left")
    return out.fillna(False, ["operational_scaling_10pct"])


@query("g7_company_profile", "company_id mission forecast_evidence_group turnover_2030:f observed_years:i estimated_years:i predicted_years:i crosses_10m:b gazelle_10pct:b "
       "gazelle_20pct:b operational_scaling_10pct:b credibility_status", """
select s.company_id, s.mission, s.forecast_evidence_group, s.turnover_2030, count(*) filter (where f.data_type = 'observed') as observed_years,
  count(*) filter (where f.data_type = 'estimated_baseline') as estimated_years, count(*) filter (where f.data_type = 'predicted') as predicted_years,
  coalesce(s.baseline_turnover < 10000000 and s.turnover_2030 >= 10000000, false) as crosses_10m, bool_or(r.gazelle_10pct) as gazelle_10pct, bool_or(r.gazelle_20pct) as gazelle_20pct,
  coalesce(bool_or(o.operational_scaling_10pct), false) as operational_scaling_10pct, max(i.credibility_status) as credibility_status
from x_summary s left join x_full f on f.company_id = s.company_id left join x_runs r on r.company_id = s.company_id left join x_scaling o on o.company_id = s.company_id
left join x_intersection i on i.company_id = s.company_id group by s.company_id, s.mission, s.forecast_evidence_group, s.turnover_2030, s.baseline_turnover""")
def _(t):
    f = flow(t)
    return reports.company_profiles(f.summary, f.trajectories, f.runs, f.intersection, f.scaling)


# --- feature usage ---------------------------------------------------------------------------------

CORRELATED = FORECAST_SET.numeric


def correlation_weights(t: Tables) -> DataFrame:
    """Correlation of each feature with the target as its weight."""

    def correlation(column: str) -> Column:
        x = F.col(column).cast("double")
        y = F.when(x.isNotNull(), F.col(TARGET))
        return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))

    wide = flow(t).training.groupBy("mission").agg(*[correlation(c).alias(f"log_numeric__{c}") for c in CORRELATED])
    return wide.unpivot(["mission"], [f"log_numeric__{c}" for c in CORRELATED], "feature", "weight")


@query("t3_top15_features", "mission engineered_feature place:i", "select mission, engineered_feature, place from x_top")
def _(t):
    return reports.top_features(correlation_weights(t))


def model_names(weights: DataFrame) -> DataFrame:
    return weights.withColumn("mission", F.concat("mission", F.lit(" ("), "model_kind", F.lit(")")))


@query("t3_fitted_top15", "mission engineered_feature place:i")
def _(t):
    return reports.top_features(model_names(fitted_weights(t)))


@query("g8_fitted_usage", "source_file raw_field engineered_feature status n_mission_models_top15:i used_in")
def _(t):
    usage = reports.usage_counts(reports.top_features(model_names(fitted_weights(t))), None)
    return reports.ranked_usage(reports.feature_usage(usage, *lineage_tables(t)))


USAGE_SQL = """
select engineered_feature, count(*) as n_mission_models_top15, string_agg(mission||' (forecasting)', '; ' order by mission) as used_in from x_top group by 1"""


@query("a22_usage_count", "engineered_feature n_mission_models_top15:i used_in", USAGE_SQL)
def _(t):
    return reports.usage_counts(reports.top_features(correlation_weights(t)), "forecasting")


def sql_rows(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in row) + ")" for row in rows)


LINEAGE_ROWS = [(f, *source) for f, source in FEATURE_SOURCES.items()]
OTHER_ROWS = [(source, raw, status) for status, fields in OTHER_FIELDS.items() for source, raw in fields]
USAGE_REPORT_SQL = f"""
select coalesce(l.source_file, 'UNMAPPED') as source_file, coalesce(l.raw_field, u.engineered_feature) as raw_field, u.engineered_feature, 'used_top15' as status,
  u.n_mission_models_top15, u.used_in from ({USAGE_SQL}) u left join (values {sql_rows(LINEAGE_ROWS)}) l(feature, source_file, raw_field) on l.feature = u.engineered_feature
union all select source_file, raw_field, '', status, case when status <> 'structural_required' then 0 end, case when status = 'structural_required' then 'all' else '' end
from (values {sql_rows(OTHER_ROWS)}) o(source_file, raw_field, status)"""


def lineage_tables(t: Tables) -> tuple[DataFrame, DataFrame]:
    lineage = t.spark.createDataFrame(LINEAGE_ROWS, "engineered_feature string, source_file string, raw_field string")
    return lineage, t.spark.createDataFrame(OTHER_ROWS, "source_file string, raw_field string, status string")


def usage_report(t: Tables) -> DataFrame:
    usage = reports.usage_counts(reports.top_features(correlation_weights(t)), "forecasting")
    return reports.feature_usage(usage, *lineage_tables(t))


USAGE = "source_file raw_field engineered_feature status n_mission_models_top15:i used_in"


@query("g8_feature_usage", USAGE, USAGE_REPORT_SQL)
def _(t):
    return usage_report(t)


@query("t6_rank_report", USAGE, USAGE_REPORT_SQL)
def _(t):
    return reports.ranked_usage(usage_report(t))


# --- studies ------------------------------------------------------------------------------------------


@query("d1_temporal_backtest", "mission n_test_rows:i R2:r R2_without_largest:r median_abs_pct_error:r", """
with r as (select * from x_training where target_year between 2019 and 2023 and company_id in (select company_id from x_training where target_year <= 2018)),
 m as (select mission, arg_max(company_id, target_turnover_next_year) as big from r group by 1)
select r.mission, count(*) as n_test_rows, 1 - sum(pow(target_turnover_next_year - turnover_t, 2)) / (var_pop(target_turnover_next_year) * count(*)) as "R2",
  1 - sum(pow(target_turnover_next_year - turnover_t, 2)) filter (where company_id <> big) / (var_pop(target_turnover_next_year) filter (where company_id <> big) * count(*) filter (where company_id <> big)) as "R2_without_largest",
  median(abs((target_turnover_next_year - turnover_t) / nullif(target_turnover_next_year, 0)) * 100) as median_abs_pct_error from r join m on m.mission = r.mission group by 1""")
def _(t):
    rows = studies.backtest_rows(flow(t).training, "turnover_t", (2013, 2018), (2019, 2023))
    return studies.temporal_backtest(writers.written(rows, "backtest"))


@query("d2_weight_sweep", "adjacent_weight:r mission R2:r place:i")
def _(t):
    from pyspark.sql import Window

    rows = training_rows_with_adjacent(t, {m: 1.0 for m in CORE_MISSIONS}).filter(F.col("mission").isin(CORE_MISSIONS))
    # adjacent rows lie in cells of their own, so a weight is a factor on the sums of those cells, not rows of its own
    cut, outers = gram.grouped_cells(rows, "mission")
    outers = gram.scaled_added(outers, "adjacent_weight", [0.2, 0.5, 1.0])
    bake = gram.bake_off(cut, outers, {"Ridge": gram.LINEAR["Ridge"]}, ESTIMATION_SET, "total_turnover", "sample_weight", ["company_id", "mission"], F.col("mission"))
    folds = metrics.metrics_of_moments(bake.moments(["mission"]), ["adjacent_weight", "mission", "repeat", "fold", "Model"])
    means = folds.groupBy("adjacent_weight", "mission").agg(F.avg("R2").alias("R2"))
    order = Window.partitionBy("mission").orderBy(F.col("R2").desc_nulls_last(), "adjacent_weight")
    return means.withColumn("place", F.row_number().over(order))


@query("d1_fitted_backtest", "mission n_test_rows:i R2:r R2_without_largest:r median_abs_pct_error:r")
def _(t):
    rows = writers.written(forecast_rows(t), "forecast_rows")
    return studies.temporal_backtest(writers.written(studies.fitted_backtest(rows, FORECAST_SET, TARGET, (2013, 2018), (2019, 2023)), "backtest"))


@query("d3_error_concentration", "mission company_id error:f share:r", """
with e as (select mission, company_id, sum(w * (target_turnover_next_year - turnover_t) * (target_turnover_next_year - turnover_t)) / 1e12 as error
  from (select *, 1.0 / count(*) over (partition by company_id) as w from x_training) z group by 1, 2)
select mission, company_id, error, error / sum(error) over (partition by mission) as share from e""")
def _(t):
    from ledgerline.operators.panel import inverse_weight

    rows = inverse_weight(flow(t).training)
    out = studies.error_concentration(rows, TARGET, "turnover_t", "sample_weight")
    return out.withColumn("error", F.col("error") / 1e12)


@query("d4_outlier_scan", "company_id accounting_year:i swing:r turnover_per_employee:r", """
select company_id, accounting_year, turnover_t / nullif(turnover_lag_1, 0) as swing, turnover_t / nullif(employees, 0) as turnover_per_employee from x_engineered
where turnover_t / nullif(turnover_lag_1, 0) > 50 or turnover_t / nullif(turnover_lag_1, 0) < 1 / 50.0""")
def _(t):
    return studies.outlier_scan(features.engineered_panel(t.panel()))


@query("d5_ratio_leakage_check", "ratio compared:i exact:i mean_gap:r", """
select 'assets_per_employee' as ratio, count(g1) as compared, count(*) filter (where g1 < 1e-6) as exact, avg(g1) as mean_gap from (
  select abs((assets_per_employee - total_assets / nullif(employees, 0)) / nullif(total_assets / nullif(employees, 0), 0)) as g1 from x_engineered) z
union all select 'export_share', count(g2), count(*) filter (where g2 < 1e-6), avg(g2) from (
  select abs((export_share - export_revenue / nullif(turnover_t, 0)) / nullif(export_revenue / nullif(turnover_t, 0), 0)) as g2 from x_engineered) z
union all select 'growth_volatility', count(g3), count(*) filter (where g3 < 1e-6), avg(g3) from (
  select abs((growth_volatility - employees / nullif(turnover_t, 0)) / nullif(employees / nullif(turnover_t, 0), 0)) as g3 from x_engineered) z""")
def _(t):
    return studies.leakage_check(features.engineered_panel(t.panel()), {
        "assets_per_employee": ("total_assets", "employees", 1.0),
        "export_share": ("export_revenue", "turnover_t", 1.0),
        "growth_volatility": ("employees", "turnover_t", 1.0),
    })


RANKED_SQL = f"select mission, target_turnover_next_year as y, unnest({ENGINEERED}) as feature, unnest([{', '.join(f'cast({c} as double)' for c in ENGINEERED)}]) as v from x_training"


@query("d6_spearman_direction", "mission feature rho:r", f"""
select mission, feature, covar_pop(ra, rb) / nullif(stddev_pop(ra) * stddev_pop(rb), 0) as rho from (select mission, feature,
  rank() over (partition by mission, feature order by v) + (count(*) over (partition by mission, feature, v) - 1) / 2.0 as ra,
  rank() over (partition by mission, feature order by y) + (count(*) over (partition by mission, feature, y) - 1) / 2.0 as rb
  from ({RANKED_SQL}) w where v is not null) z group by 1, 2""")
def _(t):
    return studies.spearman(flow(t).training, ["mission"], ENGINEERED, TARGET, "rho")


ATTENDED_SQL = "select distinct user_id, event_type from events where cast(value as decimal(18,2)) > 30 and user_id in (select c_custkey from customer)"


@query("d7_accelerator_profile", "accelerator companies:i", """
select event_type as accelerator, count(distinct user_id) as companies from events where cast(value as decimal(18,2)) > 30 and user_id in (select c_custkey from customer) group by 1""")
def _(t):
    return studies.slot_profile(t.signals(), "ordinal")


@query("d7_attendee_split", "mission attended:b companies:i mean_age:r median_age:r share_without_turnover:r", f"""
select mission, attended, count(*) as companies, avg(age) as mean_age, median(age) as median_age, avg(case when kind = 'D' then 1.0 else 0.0 end) as share_without_turnover
from (select g.mission, c.ordinal in (select user_id from ({ATTENDED_SQL}) a where event_type in (select event_type from ({ATTENDED_SQL}) b group by 1 having count(*) >= 10)) as attended,
  (select max(baseline_year) from x_baseline) - c.founded_year as age, g.forecast_evidence_group as kind from x_groups g join x_company c on c.company_id = g.company_id) z group by 1, 2""")
def _(t):
    f = flow(t)
    latest = f.baseline.select(F.max("baseline_year")).scalar()
    companies = f.groups.select("company_id", "mission", "forecast_evidence_group").join(
        t.company().select("company_id", "ordinal", "founded_year"), "company_id")
    companies = companies.withColumn("age", latest - F.col("founded_year"))
    return studies.attendee_split(companies, t.signals(), "ordinal")


@query("s10_export_tables", "dataset rows:i companies:i", """
select 'current_turnover_baseline' as dataset, count(*) as rows, count(distinct company_id) as companies from x_baseline
union all select 'full_trajectories_2030', count(*), count(distinct company_id) from x_full
union all select 'crossings_10m', count(*), count(distinct company_id) from x_context where baseline_turnover < 10000000 and turnover_2030 >= 10000000
union all select 'gazelle_10pct', count(*), count(distinct c.company_id) from x_context c join x_runs r on r.company_id = c.company_id where r.gazelle_10pct
union all select 'gazelle_20pct', count(*), count(distinct c.company_id) from x_context c join x_runs r on r.company_id = c.company_id where r.gazelle_20pct
union all select 'intersection_50m', count(*), count(distinct company_id) from x_intersection
union all select 'operational_scaling', count(*), count(distinct c.company_id) from x_context c join x_scaling s on s.company_id = c.company_id where s.operational_scaling_10pct""")
def _(t):
    f = flow(t)
    tiers = f.context.join(f.runs, "company_id")
    tables = {
        "current_turnover_baseline": f.baseline,
        "full_trajectories_2030": f.trajectories,
        "crossings_10m": reports.crossings(f.context),
        "gazelle_10pct": tiers.filter("gazelle_10pct"),
        "gazelle_20pct": tiers.filter("gazelle_20pct"),
        "intersection_50m": f.intersection,
        "operational_scaling": reports.scaling_report(f.context, f.scaling),
    }
    folder = writers.stage_path(t.spark, "export")
    writers.export(tables, folder)
    counts = [
        writers.read_export(t.spark, df, f"{folder}/{name}").agg(
            F.lit(name).alias("dataset"), F.count("*").alias("rows"), F.count_distinct("`Company ID`").alias("companies"))
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, counts)


@query("d8_weighted_structure_score", "mission weighted_r2:r n:i", """
select mission, sum(n * r2) / sum(n) as weighted_r2, sum(n) as n from (select p.mission, forecast_evidence_group, count(*) as n,
  1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)) as r2 from x_predictions p join x_groups g on g.company_id = p.company_id
  where horizon = '1' and "Model" = 'Persistence' group by 1, 2 having count(*) >= 2) z group by 1""")
def _(t):
    rows = subgroup_rows(t).filter(F.col("Model") == "Persistence")
    scores = metrics.metrics(rows, ["mission", "forecast_evidence_group"], TARGET, "predicted").filter("n_test_rows >= 2")
    return selection.structure_score(scores.withColumnRenamed("n_test_rows", "n"))


SKEWED = FORECAST_LOG


def skew_sql(column: str) -> str:
    return f"(select avg(pow({column} - m, 3)) / pow(max(s), 3) from (select {{0}} as {column}, avg({{0}}) over () as m, stddev_pop({{0}}) over () as s from x_training) z)"


def one_skew(column: str) -> str:
    raw, logged = skew_sql("v").format(column), skew_sql("v").format(f"ln(1 + {column})")
    return f"select '{column}' as feature, {raw} as raw, {logged} as logged"


@query("d9_skew_check", "feature raw:r logged:r", " union all ".join(one_skew(c) for c in SKEWED))
def _(t):
    return studies.skewness(flow(t).training, SKEWED)


