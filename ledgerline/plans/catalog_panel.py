"""Joins, reshapes, windows, aggregates and feature tables."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.operators import adjacent, features, forecast, panel, quality, ranks, reports, scoring, segments
from ledgerline.operators.keys import first_per_key
from ledgerline.operators.metrics import coverage, value_counts
from ledgerline.plans.catalog_clean import YEAR_COLUMNS, covariates, dirty
from ledgerline.plans.flow import ForecastFlow
from ledgerline.plans.registry import query
from ledgerline.settings import ADJACENT, CORE_MISSIONS, ENGINEERED, SPACE, YEARS
from ledgerline.sources.domain import Tables, annualized
from ledgerline.sources.writers import written

# --- reshape -----------------------------------------------------------------------

YEARS_SQL = "x_company c cross join (select unnest(range(2013, 2026)) as year) y left join x_covariates v on v.company_id = c.company_id and v.year = y.year"


@query("r1_melt_years", "company_id year:i balance_sheet_total_assets:m",
       f"select c.company_id, y.year, v.balance_sheet_total_assets from {YEARS_SQL}")
def _(t):
    return panel.melt_years(t.master(), ["company_id"], ["balance_sheet_total_assets"], YEARS)


def labelled(t: Tables) -> tuple[DataFrame, DataFrame]:
    kept, _ = segments.split_labelled(t.master(), YEAR_COLUMNS)
    ids = ["company_id", "trading_name", "mission"]
    return panel.long_panel(kept, ids, YEARS)


@query("r2_long_panel", "company_id year:i mission total_turnover:m total_employees:r employee_count_source balance_sheet_total_assets:m "
       "total_export_revenue:m sample_weight:r population_type", """
select company_id, year, mission, total_turnover, total_employees, employee_count_source, balance_sheet_total_assets, total_export_revenue, sample_weight, population_type from x_labelled""")
def _(t):
    return labelled(t)[0]


def foreign(t: Tables) -> DataFrame:
    """Adjacent companies of all missions, stored: their panel, ratios, signals and overlaps are all cut from them."""
    if "foreign" not in t.built:
        t.built["foreign"] = written(adjacent.load_all(t.adjacent_files(), t.company(), "ch_no", "ordinal")[0], "foreign")
    return t.built["foreign"]


@query("r3_statement_panel", "company_id year:i turnover:m weeks:r total_employees:r balance_sheet_total_assets:m", """
select s.company_id, y.year, y.turnover, y.weeks, y.employees as total_employees, y.assets as balance_sheet_total_assets
from x_suppliers s join x_sup_years y on y.l_suppkey = s.ordinal""")
def _(t):
    export = adjacent.parse_dates(t.supplier_export())
    return panel.statement_panel(adjacent.with_foreign_id(export), "ordinal")


def bridge(t: Tables) -> DataFrame:
    return panel.url_bridge(t.company(), "profile_url", "ordinal")


@query("r4_weeks_factor", "company_id year:i weeks:r annualization_factor:r", "select company_id, year, weeks, annualization_factor from x_weeks")
def _(t):
    return panel.weeks_factors(t.statements(), bridge(t), "profile_url", "ordinal")


def flow(t: Tables) -> ForecastFlow:
    """The forecast, one a query: its training rows and folds are read by several steps."""
    if "flow" not in t.built:
        t.stored_filed()
        t.built["flow"] = ForecastFlow(t.panel(), written(t.baseline(), "baseline"), t.static())
    return t.built["flow"]


def trajectories(t: Tables) -> DataFrame:
    f = flow(t)
    return forecast.recursive_forecast(f.panel, f.baseline, f.groups, f.static)


@query("r5_pivot_counts", "company_id growing:i stable:i", """
select company_id, count(*) filter (where growth_classification = 'growing') as growing, count(*) filter (where growth_classification = 'stable') as stable
from x_trajectories group by company_id""")
def _(t):
    kinds = trajectories(t).groupBy("company_id").pivot("growth_classification", ["growing", "stable"])
    return kinds.count().fillna(0)


# --- joins ----------------------------------------------------------------------------


@query("j2_join_static", "company_id accounting_year:i founded_year:i sic_code_1:r value_stream", """
select f.company_id, f.accounting_year, c.founded_year, c.sic_code_1, c.value_stream from x_filings f left join x_company c on c.company_id = f.company_id""")
def _(t):
    return t.filings().join(t.static(), "company_id", "left")


@query("j3_join_company_year", "company_id year:i total_turnover:m fs1_current_ratio:r fs1_equity_pct:r", """
select l.company_id, l.year, l.total_turnover, r.fs1_current_ratio, r.fs1_equity_pct from x_labelled l left join x_ratios r on r.company_id = l.company_id and r.year = l.year""")
def _(t):
    ratios = features.ratio_features(t.statements(), "profile_url")
    return features.join_ratios(labelled(t)[0], ratios, bridge(t))


@query("j4_url_bridge", "ordinal:i company_id grants_count:i", """
select b.ordinal, b.company_id, e.grants_count from x_bridged b join x_events e on e.user_id = b.ordinal""")
def _(t):
    signals = features.signal_features(t.signals(), "profile_url")
    return signals.join(bridge(t), "url_norm")


@query("j5_outer_stack", "company_id year:i total_employees_ch:r total_employees_est:r balance_sheet_total_assets:m", f"""
select c.company_id, y.year, v.total_employees_ch, v.total_employees_est, v.balance_sheet_total_assets from {YEARS_SQL}""")
def _(t):
    return covariates(t)


@query("j6_anti_indicator", "company_id", """
select company_id from x_company where company_id not in (select company_id from x_covariates
  where coalesce(total_employees_ch, total_employees_est, balance_sheet_total_assets, total_export_revenue) is not null)""")
def _(t):
    filled = covariates(t).filter(
        F.coalesce("total_employees_ch", "total_employees_est", "balance_sheet_total_assets", "total_export_revenue").isNotNull())
    return t.company().select("company_id").join(filled, "company_id", "left_anti")


@query("j7_semi_anti_isin", "company_id part", """
select company_id, case when company_id in (select company_id from x_panel) then 'semi' else 'anti' end as part from x_baseline""")
def _(t):
    b, p = t.baseline().select("company_id"), t.panel().select("company_id")
    return b.join(p, "company_id", "left_semi").withColumn("part", F.lit("semi")).unionByName(
        b.join(p, "company_id", "left_anti").withColumn("part", F.lit("anti")))


@query("j8_anti_composite", "company_id baseline_year:i", """
select company_id, baseline_year from x_baseline b where not exists (select 1 from x_panel p where p.company_id = b.company_id and p.accounting_year = b.baseline_year)""")
def _(t):
    p = t.panel().select("company_id", F.col("accounting_year").alias("baseline_year"))
    return t.baseline().join(p, ["company_id", "baseline_year"], "left_anti")


@query("j9_annualize", "company_id accounting_year:i turnover:m", "select company_id, accounting_year, turnover from x_panel")
def _(t):
    return annualized(t)[0]


@query("j9_annualize_log", "company_id accounting_year:i raw_turnover:m weeks:r annualization_factor:r annualized_turnover:m", """
select company_id, accounting_year, turnover as raw_turnover, weeks, 52.0 / weeks as annualization_factor, turnover * (52.0 / weeks) as annualized_turnover
from x_raw_panel where weeks <> 52""")
def _(t):
    return annualized(t)[1]


@query("j9_annualize_baseline", "company_id baseline_turnover:m", """
select b.company_id, case when b.turnover_source_raw = 'observed' then b.baseline_turnover * coalesce(52.0 / f.weeks, 1.0) else b.baseline_turnover end as baseline_turnover
from x_baseline b join x_filings f on f.company_id = b.company_id and f.accounting_year = b.baseline_year""")
def _(t):
    observed = F.col("turnover_source_raw") == "observed"
    return panel.annualize(t.baseline(), "baseline_turnover", "baseline_year", t.factors(), observed)[0]


def stand_in_predictions(t: Tables) -> DataFrame:
    """Predictions for companies without turnover: a tenth of the latest assets."""
    snap = panel.covariate_snapshot(t.segmented().filter("balance < 0"), YEARS)
    value = F.col("balance_sheet_total_assets") / 10
    low = F.col("is_fallback_year")
    return snap.filter((F.col("mission") != "Resilient Earth") & value.isNotNull()).select(
        "company_id", F.col("year").alias("prediction_year"), value.alias("predicted_total_turnover"),
        F.when(low, "low").otherwise("standard").alias("reliability"),
        F.when(low, "no_covariate_data_any_year").otherwise("").alias("reliability_reason"),
    )


STAND_IN_SQL = """select company_id, year as prediction_year, balance_sheet_total_assets / 10 as predicted, case when is_fallback_year then 'low' else 'standard' end as reliability,
  case when is_fallback_year then 'no_covariate_data_any_year' else '' end as reason from x_snapshot where mission <> 'Resilient Earth' and balance_sheet_total_assets is not null"""


def observed_base(t: Tables) -> DataFrame:
    last = panel.latest_observed(t.master(), ["company_id"], YEARS)
    seen = F.col("turnover_value").isNotNull()
    return t.company().select("company_id", "mission").join(last, "company_id", "left").withColumns(
        {"turnover_source": F.when(seen, "observed"), "reliability": F.when(seen, "observed"), "reliability_reason": F.lit("")})


@query("j10_overlay", "company_id year:i turnover_value:m turnover_source reliability reliability_reason", f"""
select c.company_id, coalesce(l.year, p.prediction_year) as year, coalesce(l.total_turnover, p.predicted) as turnover_value,
  case when l.year is not null then 'observed' when p.predicted is not null then 'predicted' end as turnover_source,
  case when l.year is not null then 'observed' else p.reliability end as reliability, case when l.year is not null then '' else coalesce(p.reason, '') end as reliability_reason
from x_company c left join (select * from x_labelled qualify row_number() over (partition by company_id order by year desc) = 1) l on l.company_id = c.company_id
left join ({STAND_IN_SQL}) p on p.company_id = c.company_id""")
def _(t):
    return scoring.overlay_predictions(observed_base(t), stand_in_predictions(t))


@query("j11_origin_select", "company_id accounting_year:i turnover_t:m log_growth_1y:r", """
select e.company_id, e.accounting_year, e.turnover_t, e.log_growth_1y from x_engineered e join x_baseline b on b.company_id = e.company_id and b.baseline_year = e.accounting_year""")
def _(t):
    origins = t.baseline().select("company_id", F.col("baseline_year").alias("accounting_year"))
    return features.engineered_panel(t.panel()).join(origins, ["company_id", "accounting_year"])


@query("j12_cross_product", "mission evidence_group", """
select distinct mission, l.g as evidence_group from x_panel, (select unnest(['A', 'B', 'C', 'D']) as g) l""")
def _(t):
    letters = F.explode(F.array(*[F.lit(g) for g in "ABCD"]))
    return t.panel().select("mission").distinct().withColumn("evidence_group", letters)


@query("j14_multi_overlap", "company_id mission multi_mission_overlap", """
select a.company_id, a.mission, coalesce(string_agg(o.mission, ', ' order by o.mission) filter (where o.mission <> a.mission), '') as multi_mission_overlap
from x_adjacent a join x_adjacent o on o.company_id = a.company_id group by 1, 2""")
def _(t):
    return adjacent.multi_mission_overlap(foreign(t))


# --- windows -----------------------------------------------------------------------------

ENG_KEYS = "company_id accounting_year:i "


def engineered(t: Tables) -> DataFrame:
    return features.engineered_panel(t.panel())


def from_engineered(key: str, columns: str) -> None:
    names = ", ".join(c.split(":")[0] for c in (ENG_KEYS + columns).split())
    query(key, ENG_KEYS + columns, f"select {names} from x_engineered")(engineered)


from_engineered("w1_turnover_lags", "turnover_t:m turnover_lag_1:m turnover_lag_2:m turnover_lag_3:m log_turnover_t:r log_turnover_lag_1:r log_turnover_lag_2:r")
from_engineered("w3_log_growth", "log_growth_1y:r")
from_engineered("w4_growth_rolling", "log_growth_2y_mean:r log_growth_3y_mean:r rolling_growth_mean_3:r growth_volatility:r rolling_growth_std_3:r")
from_engineered("w5_growth_accel", "growth_acceleration:r")
from_engineered("w6_sign_counts", "positive_growth_count:i negative_growth_count:i")
from_engineered("w7_turnover_rolling", "rolling_turnover_mean_2:m rolling_turnover_mean_3:m rolling_turnover_median_3:m historical_turnover_max:m historical_turnover_min:m")
from_engineered("w8_history_to_date", "n_prior_turnover_values:i history_span_years:i years_since_previous_turnover:i has_growth_history:b has_three_year_history:b")
from_engineered("w9_run_ending_here", "consecutive_history_length_to_date:i")
from_engineered("w13_covariate_growth", "employee_growth:r asset_growth:r")
from_engineered("p18_missing_flags", "is_missing_turnover_lag_1:b is_missing_turnover_lag_2:b is_missing_turnover_lag_3:b is_missing_total_assets:b "
                "is_missing_employees:b is_missing_export_revenue:b has_employee_data:b has_financial_statement_data:b")
from_engineered("p19_missing_summary", "missing_feature_count:i missing_feature_proportion:r")

KINDS = {"is_missing": "b", "has_": "b", "n_prior": "i", "history_span": "i", "years_since": "i", "consecutive": "i", "positive": "i", "negative": "i",
         "turnover": "m", "rolling_turnover": "m", "historical": "m"}


def kind_of(feature: str) -> str:
    return next((k for prefix, k in KINDS.items() if feature.startswith(prefix)), "r")


ALL_FEATURES = " ".join(f"{f}:{kind_of(f)}" for f in ENGINEERED) + " missing_feature_count:i missing_feature_proportion:r"


@query("f14_engineered_panel", ENG_KEYS + ALL_FEATURES + " estimation_turnover_source estimation_reliability estimation_reliability_reason", f"""
select e.company_id, e.accounting_year, {', '.join('e.' + f for f in ENGINEERED)}, e.missing_feature_count, e.missing_feature_proportion,
  b.turnover_source as estimation_turnover_source, b.baseline_reliability as estimation_reliability, b.reliability_reason as estimation_reliability_reason
from x_engineered e left join x_baseline b on b.company_id = e.company_id""")
def _(t):
    return features.engineered_panel(t.panel(), t.baseline())


@query("f15_training_features", ENG_KEYS + ALL_FEATURES + " target_turnover_next_year:m target_year:i", f"""
select company_id, accounting_year, {', '.join(ENGINEERED)}, missing_feature_count, missing_feature_proportion, target_turnover_next_year, target_year from x_training""")
def _(t):
    return features.training_features(t.panel(), t.baseline())


@query("w2_next_year_target", "company_id accounting_year:i target_turnover_next_year:m target_year:i",
       "select company_id, accounting_year, target_turnover_next_year, target_year from x_training")
def _(t):
    return features.next_year_target(t.panel()).filter(F.col("target_year").isNotNull())


@query("w10_run_at_latest", "company_id consecutive_history_length:i", "select company_id, consecutive_history_length from x_history")
def _(t):
    return panel.history_properties(t.panel())


@query("w11_gazelle_runs", "company_id longest_run_10pct:i longest_run_20pct:i gazelle_10pct:b gazelle_20pct:b", """
select company_id, max(r10) as longest_run_10pct, max(r20) as longest_run_20pct, max(r10) >= 3 as gazelle_10pct, max(r20) >= 3 as gazelle_20pct from (
  select company_id, sum(h10::int) over (partition by company_id, b10) as r10, sum(h20::int) over (partition by company_id, b20) as r20 from (
    select *, sum((not h10)::int) over (partition by company_id order by accounting_year) as b10, sum((not h20)::int) over (partition by company_id order by accounting_year) as b20 from (
      select company_id, accounting_year, coalesce(accounting_year - year_before = 1 and log_growth_1y >= ln(1.1), false) as h10,
        coalesce(accounting_year - year_before = 1 and log_growth_1y >= ln(1.2), false) as h20 from x_growth) x) y) z group by company_id""")
def _(t):
    return reports.gazelle_runs(t.panel())


@query("w12_operational_scaling", "company_id n_real_years_employee_growth:i n_real_years_asset_growth:i employee_growth_10pct:b employee_growth_20pct:b "
       "asset_growth_10pct:b asset_growth_20pct:b operational_scaling_10pct:b operational_scaling_20pct:b", "select * from x_scaling")
def _(t):
    return reports.operational_scaling(engineered(t))


@query("w14_inverse_weight", "company_id year:i sample_weight:r", "select company_id, year, sample_weight from x_labelled")
def _(t):
    return labelled(t)[0]


@query("w15_latest_observed", "company_id year:i turnover_value:m", """
select company_id, year, total_turnover as turnover_value from x_labelled qualify row_number() over (partition by company_id order by year desc) = 1""")
def _(t):
    return panel.latest_observed(t.master(), ["company_id"], YEARS)


def snapshot(t: Tables) -> DataFrame:
    _, inference = segments.split_labelled(t.master(), YEAR_COLUMNS)
    return panel.covariate_snapshot(inference)


@query("w16_latest_snapshot", "company_id year:i total_employees_ch:r total_employees_est:r balance_sheet_total_assets:m total_export_revenue:m company_size is_fallback_year:b", """
select company_id, year, total_employees_ch, total_employees_est, balance_sheet_total_assets, total_export_revenue, company_size, is_fallback_year from x_snapshot""")
def _(t):
    return snapshot(t)


@query("w17_recent_n", "company_id max_recent_turnover:m", "select company_id, max_recent_turnover from x_recent")
def _(t):
    return reports.recent_peak(t.panel().withColumn("data_type", F.lit("observed")))


# --- aggregates --------------------------------------------------------------------------------


@query("a2_sample_summary", "mission training_eligible_companies:i labelled_companies:i inference_companies:i labelled_panel_rows:i", """
select c.mission, count(*) as training_eligible_companies, count(*) filter (where balance >= 0) as labelled_companies, count(*) filter (where balance < 0) as inference_companies,
  (select count(*) from x_labelled l where l.mission = c.mission) as labelled_panel_rows from x_company c where c.mission in ('ACE', 'Beyond Earth', 'Resilient Earth') group by 1""")
def _(t):
    return segments.sample_summary(t.segmented(), labelled(t)[0], YEAR_COLUMNS)


@query("a3_history_properties", "company_id n_turnover_years:i first_turnover_year:i latest_turnover_year:i history_span:i years_since_latest_turnover:i consecutive_history_length:i",
       "select * from x_history")
def _(t):
    return panel.history_properties(t.panel())


@query("a10_growth_anchor", "mission anchor:r", "select mission, anchor from x_anchor")
def _(t):
    return forecast.growth_anchor(features.growth_core(t.panel()))


@query("a12_class_pivot", "company_id n_years_growing:i n_years_stable:i", """
select company_id, n_years_growing, n_years_stable from x_summary""")
def _(t):
    return flow(t).summary


@query("a13_last_value", "company_id model_used", "select company_id, arg_max(model_used, accounting_year) as model_used from x_trajectories group by 1")
def _(t):
    return trajectories(t).groupBy("company_id").agg(F.max_by("model_used", "accounting_year").alias("model_used"))


@query("a14_any_flag", "company_id evidence_gate_triggered:b", """
select company_id, bool_or(growth_signal = 'growing' and growth_classification = 'stable') as evidence_gate_triggered from x_trajectories group by 1""")
def _(t):
    gated = (F.col("growth_signal") == "growing") & (F.col("growth_classification") == "stable")
    return trajectories(t).groupBy("company_id").agg(F.bool_or(gated).alias("evidence_gate_triggered"))


@query("a15_group_size", "company_id n_real_years:i", "select company_id, count(*) as n_real_years from x_panel group by 1")
def _(t):
    return t.panel().groupBy("company_id").agg(F.count("*").alias("n_real_years"))


@query("a17_training_bounds", "mission max_total_employees:r max_balance_sheet_total_assets:m sic_codes:i", """
select mission, max(total_employees) as max_total_employees, max(balance_sheet_total_assets) as max_balance_sheet_total_assets, count(distinct sic_code_1) as sic_codes
from x_labelled where mission is not null group by 1""")
def _(t):
    training = labelled(t)[0].filter(F.col("mission").isNotNull()).join(t.static(), "company_id")
    codes = scoring.training_categories(training, "sic_code_1").groupBy("mission").agg(F.count("*").alias("sic_codes"))
    return scoring.training_bounds(training).join(codes, "mission")


@query("a18_global_reference", "company_id years_behind:i", """
select company_id, (select max(accounting_year) from x_panel) - max(accounting_year) as years_behind from x_panel group by 1""")
def _(t):
    p = t.panel()
    latest = p.select(F.max("accounting_year")).scalar()
    return p.groupBy("company_id").agg(F.max("accounting_year").alias("y")).select("company_id", (latest - F.col("y")).alias("years_behind"))


@query("a19_coverage", "feature non_null:i", f"""
select unnest({ENGINEERED}) as feature, unnest([{', '.join(f'count({c})' for c in ENGINEERED)}]) as non_null from x_training""")
def _(t):
    return coverage(features.training_features(t.panel()), ENGINEERED)


@query("a21_describe", "mission n:i mean:f std:f low:m q1:m q2:m q3:m high:m", """
select mission, count(turnover) as n, avg(turnover) as mean, stddev_samp(turnover) as std, min(turnover) as low, quantile_cont(turnover, 0.25) as q1,
  median(turnover) as q2, quantile_cont(turnover, 0.75) as q3, max(turnover) as high from x_panel group by 1""")
def _(t):
    p = t.panel()
    out = p.groupBy("mission").agg(
        F.count("turnover").alias("n"), F.avg("turnover").alias("mean"), F.stddev_samp("turnover").alias("std"),
        F.min("turnover").alias("low"), F.max("turnover").alias("high"))
    return ranks.attach(out, ranks.quantiles(p, ["mission"], "turnover", {"q1": 0.25, "q2": 0.5, "q3": 0.75}), ["mission"])


@query("a23_distinct_count", "mission companies:i", "select mission, count(distinct company_id) as companies from x_panel group by 1")
def _(t):
    return t.panel().groupBy("mission").agg(F.count_distinct("company_id").alias("companies"))


@query("a24_annualization_stats", "mission panel_rows:i irregular_rows:i corrected_rows:i rows_over_30pct:i min_factor:r max_factor:r companies:i irregular_share:r", """
select mission, count(*) as panel_rows, count(*) filter (where weeks <> 52) as irregular_rows, count(*) filter (where weeks <> 52) as corrected_rows,
  count(*) filter (where weeks <> 52 and abs(52.0 / weeks - 1) > 0.30) as rows_over_30pct, min(52.0 / weeks) filter (where weeks <> 52) as min_factor,
  max(52.0 / weeks) filter (where weeks <> 52) as max_factor, count(distinct company_id) filter (where weeks <> 52) as companies,
  count(*) filter (where weeks <> 52) / count(*) as irregular_share from x_raw_panel group by 1""")
def _(t):
    rows = t.raw_panel().withColumnRenamed("accounting_year", "year")
    log = annualized(t)[1].withColumnRenamed("accounting_year", "year")
    return panel.annualization_stats(log, rows)


# --- sorts, sets and tags -------------------------------------------------------------------------


@query("t1_order_panel", "company_id accounting_year:i turnover:m", "select company_id, accounting_year, turnover from x_panel")
def _(t):
    return t.panel().orderBy("company_id", "accounting_year")


@query("t2_first_per_key", "company_id accounting_year:r ordinal:i", """
select company_id, accounting_year, ordinal from x_dirty qualify row_number() over (partition by company_id, accounting_year order by ordinal) = 1""")
def _(t):
    return first_per_key(dirty(t).select("company_id", "accounting_year", "ordinal"), ["company_id", "accounting_year"], ["ordinal"])


@query("t5_head_n", "company_id accounting_year:i turnover:m", """
select company_id, accounting_year, turnover from x_panel order by turnover desc, company_id, accounting_year limit 10""")
def _(t):
    return t.panel().orderBy(F.col("turnover").desc(), "company_id", "accounting_year").limit(10)


@query("u1_union_missing_cols", "company_id year:i founded_year:i weeks:r", """
select company_id, accounting_year as year, founded_year, null as weeks from x_panel union all select company_id, year, null, weeks from x_adjacent_panel""")
def _(t):
    space = t.panel().select("company_id", F.col("accounting_year").alias("year"), "founded_year")
    other = adjacent.turnover_panel(foreign(t), "ordinal").select("company_id", "year", "weeks")
    return space.unionByName(other, allowMissingColumns=True)


@query("u2_distinct", "company_id mission", "select distinct company_id, mission from x_adjacent")
def _(t):
    return foreign(t).select("company_id", "mission").distinct()


@query("u3_except", "company_id", "select company_id from x_company except select company_id from x_panel")
def _(t):
    return t.company().select("company_id").exceptAll(t.panel().select("company_id").distinct())


@query("u4_tier_union_intersect", "company_id turnover_2030:f", """
select r.company_id, s.turnover_2030 from x_runs r join x_summary s on s.company_id = r.company_id where (r.gazelle_10pct or r.gazelle_20pct) and s.turnover_2030 >= 50000000""")
def _(t):
    f = flow(t)
    final = f.trajectories.filter("accounting_year = 2030 and turnover >= 50000000")
    final = final.select("company_id", F.col("turnover").alias("turnover_2030"))
    return f.runs.filter("gazelle_10pct or gazelle_20pct").join(final, "company_id")


@query("p25_population_tag", "population_type rows:i", """
select 'space' as population_type, count(*) as rows from x_labelled union all select 'adjacent', count(*) from x_adjacent_panel""")
def _(t):
    space = labelled(t)[0].select("population_type")
    other = adjacent.turnover_panel(foreign(t), "ordinal").select(F.lit(ADJACENT).alias("population_type"))
    tagged = space.unionByName(other)
    assert SPACE != ADJACENT
    return value_counts(tagged, ["population_type"])


# --- completed table ---------------------------------------------------------------------------------


def selected_stub(t: Tables) -> DataFrame:
    """Selected models per mission from the population: small missions are unusable."""
    sizes = t.company().filter(F.col("mission").isNotNull()).groupBy("mission").agg(F.count("*").alias("n"))
    usable = F.col("mission") != "Resilient Earth"
    reason = F.concat(F.lit("not enough data in "), F.col("n").cast("string"), F.lit(" companies"))
    return sizes.select("mission", usable.alias("usable"), F.when(usable, "").otherwise(reason).alias("exclusion_reason"))


CASCADE_SQL = f"""
select c.company_id, c.mission, coalesce(l.year, p.prediction_year) as year, coalesce(l.total_turnover, p.predicted) as turnover_value,
  case when l.year is not null then 'observed' when p.predicted is not null then 'predicted' when c.mission = 'Resilient Earth' then 'no_model_insufficient_data'
    when c.mission = 'Cross-cutting' then 'cross_cutting_unmodelled' when c.mission is null then 'excluded_data_entry_error' end as turnover_source,
  case when l.year is not null then 'observed' when p.predicted is not null then p.reliability when c.mission in ('Resilient Earth', 'Cross-cutting') or c.mission is null then 'n/a' end as reliability,
  case when l.year is not null then '' when p.predicted is not null then p.reason
    when c.mission = 'Resilient Earth' then 'not enough data in '||(select count(*) from x_company where mission = 'Resilient Earth')||' companies'
    when c.mission = 'Cross-cutting' then 'cross-cutting company kept for reference; its models gave no valid prediction'
    when c.mission is null then 'unmapped_value_stream' else '' end as reliability_reason
from x_company c left join (select * from x_labelled qualify row_number() over (partition by company_id order by year desc) = 1) l on l.company_id = c.company_id
left join ({STAND_IN_SQL}) p on p.company_id = c.company_id"""


def assembled(t: Tables) -> DataFrame:
    return scoring.assemble(t.segmented(), stand_in_predictions(t), selected_stub(t), YEARS)[0]


@query("p15_turnover_cascade", "company_id mission year:i turnover_value:m turnover_source reliability reliability_reason", CASCADE_SQL)
def _(t):
    return assembled(t).withColumn("reliability_reason", F.coalesce("reliability_reason", F.lit("")))


@query("p16_staleness", "company_id turnover_age_years:i turnover_is_stale:b", f"""
select company_id, (select max(year) from ({CASCADE_SQL}) m where turnover_source = 'observed') - year as turnover_age_years,
  coalesce(turnover_source = 'observed' and (select max(year) from ({CASCADE_SQL}) m where turnover_source = 'observed') - year > 3, false) as turnover_is_stale from ({CASCADE_SQL}) z""")
def _(t):
    return assembled(t)


# --- composed feature tables ------------------------------------------------------------------------------


@query("f16_historical_source", "company_id mission year:i total_turnover:m company_size company_age_years:i value_stream sic_code_1:r", """
select l.company_id, l.mission, l.year, l.total_turnover * coalesce(w.annualization_factor, 1.0) as total_turnover, l.company_size,
  case when l.year >= l.founded_year then l.year - l.founded_year end as company_age_years, l.value_stream, l.sic_code_1
from x_labelled l left join x_weeks w on w.company_id = l.company_id and w.year = l.year where l.mission is not null""")
def _(t):
    return historical_source(t)


def historical_source(t: Tables) -> DataFrame:
    """Panel of all mission groups from the wide master, annualised."""
    master = t.master().filter(F.col("mission").isNotNull())
    kept, _ = segments.split_labelled(master, YEAR_COLUMNS)
    rows, _ = panel.long_panel(kept, ["company_id", "mission"], YEARS)
    sizes = panel.melt_years(master, ["company_id"], ["company_size"], YEARS)
    out = rows.join(t.static(), "company_id", "left").join(sizes, ["company_id", "year"], "left")
    out = features.with_age(out)
    factors = panel.weeks_factors(t.statements(), bridge(t), "profile_url", "ordinal")
    return panel.annualize(out, "total_turnover", "year", factors)[0]


@query("f17_adjacent_annualize", "company_id mission year:i turnover:m", """
select company_id, mission, year, turnover * (52.0 / weeks) as turnover from x_adjacent_panel""")
def _(t):
    rows = adjacent.turnover_panel(foreign(t), "ordinal")
    return adjacent.annualize_panel(rows, ["ACE", "Beyond Earth", "Resilient Earth", "Cross-cutting"])[0]


def adjacent_training(t: Tables) -> DataFrame:
    raw = foreign(t)
    filed = written(adjacent.turnover_panel(raw, "ordinal"), "adjacent-panel")  # its factors are cut from it too
    rows, _ = adjacent.annualize_panel(filed, ["ACE", "Beyond Earth", "Resilient Earth", "Cross-cutting"])
    return adjacent.training_rows(raw, rows, adjacent.multi_mission_overlap(raw), "ordinal")[0]


@query("f18_adjacent_training", "company_id mission year:i total_turnover:m total_employees:r company_size employee_count_source assets_per_employee:r sic_code_1:r "
       "grants_count:i grant_recency_years:i fs1_current_ratio:r sample_weight:r population_type multi_mission_overlap", """
select p.company_id, p.mission, p.year, p.turnover * (52.0 / p.weeks) as total_turnover, p.employees as total_employees,
  case when p.employees < 10 then 'Micro' when p.employees < 50 then 'Small' when p.employees < 250 then 'Medium' else 'Large' end as company_size,
  'filed' as employee_count_source, p.assets / nullif(p.employees, 0) as assets_per_employee, p.sic_code_1, e.grants_count,
  case when p.year >= e.grant_year then p.year - e.grant_year end as grant_recency_years,
  case when row_number() over (partition by p.mission, p.company_id order by p.year desc) = 1 then p.assets / p.turnover end as fs1_current_ratio,
  1.0 / count(*) over (partition by p.mission, p.company_id) as sample_weight, 'adjacent' as population_type,
  coalesce((select string_agg(o.mission, ', ' order by o.mission) from x_adjacent o where o.company_id = p.company_id and o.mission <> p.mission), '') as multi_mission_overlap
from x_adjacent_panel p left join (select * from x_events where user_id in (select c_custkey from customer)) e on e.user_id = p.ordinal""")
def _(t):
    return adjacent_training(t)


def estimation(t: Tables) -> tuple[DataFrame, DataFrame]:
    sizes = panel.melt_years(t.master(), ["company_id"], ["company_size"], YEARS)
    signals = features.signal_features(t.signals(), "profile_url")
    ratios = features.ratio_features(t.statements(), "profile_url")
    return features.estimation_features(labelled(t)[0], t.static(), sizes, signals, ratios, bridge(t), "trading_name")


@query("f19_estimation_features", "company_id year:i total_turnover:m company_size company_age_years:i total_employees:r assets_per_employee:r export_revenue_per_employee:r "
       "grants_count:i grants_total_amount:m grant_recency_years:i fundraising_recency_years:i accelerator_count:i is_academic_spinout:i signal_equity_fundraising:i "
       "fs1_current_ratio:r fs1_gearing_pct:r is_public_sector_body:i", """
select company_id, year, total_turnover, company_size, company_age_years, total_employees, assets_per_employee, export_revenue_per_employee, grants_count, grants_total_amount,
  grant_recency_years, fundraising_recency_years, accelerator_count, is_academic_spinout, signal_equity_fundraising, fs1_current_ratio, fs1_gearing_pct, 0 as is_public_sector_body from x_label_features""")
def _(t):
    return estimation(t)[0]


@query("f19_age_log", "company_id year:i original_company_age_years:i", """
select company_id, year, year - founded_year as original_company_age_years from x_labelled where year < founded_year""")
def _(t):
    return estimation(t)[1]


def inference_features(t: Tables) -> DataFrame:
    signals = features.signal_features(t.signals(), "profile_url")
    ratios = features.ratio_features(t.statements(), "profile_url")
    rows = snapshot(t).drop("founded_year", "sic_code_1", "value_stream", "ordinal")
    return features.prediction_features(rows, t.static(), signals, ratios, bridge(t), "trading_name")


@query("x1_prediction_features", "company_id year:i total_employees:r employee_count_source company_age_years:i assets_per_employee:r grants_count:i grant_recency_years:i fs1_current_ratio:r", """
select f.company_id, f.year, f.total_employees, f.employee_count_source, f.company_age_years, f.balance_sheet_total_assets / nullif(f.total_employees, 0) as assets_per_employee,
  s.grants_count, case when f.year >= s.grant_year then f.year - s.grant_year end as grant_recency_years, r.fs1_current_ratio
from x_snapshot_features f left join x_signals s on s.company_id = f.company_id left join x_ratios r on r.company_id = f.company_id and r.year = f.year""")
def _(t):
    return inference_features(t)


@query("e6_mission_training_set", "mission population_type rows:i weight:r", """
select mission, population_type, count(*) as rows, sum(sample_weight) as weight from x_labelled where mission in ('ACE', 'Beyond Earth', 'Resilient Earth') group by 1, 2
union all select mission, 'adjacent', count(*), sum(w) from (select mission, 1.0 / count(*) over (partition by mission, company_id) *
  case mission when 'ACE' then 0.2 when 'Beyond Earth' then 1.0 else 0.5 end as w from x_adjacent_panel where mission <> 'Cross-cutting') z group by 1""")
def _(t):
    rows = training_set(t).filter(F.col("mission").isin(CORE_MISSIONS))
    return rows.groupBy("mission", "population_type").agg(F.count("*").alias("rows"), F.sum("sample_weight").alias("weight"))


# Recorded adjacent weights.
ADJACENT_WEIGHTS = {"ACE": 0.2, "Beyond Earth": 1.0}


def training_set(t: Tables) -> DataFrame:
    space = estimation(t)[0].withColumnRenamed("trading_name", "company_name")
    return adjacent.mission_training_set(space, adjacent_training(t), ADJACENT_WEIGHTS, 0.5)


@query("e7_cross_cutting_set", "population_type company_id year:i sample_weight:r", """
select population_type, company_id, year, sample_weight from x_labelled where mission = 'Cross-cutting'
union all select 'adjacent', company_id, year, 0.5 / count(*) over (partition by company_id) from x_adjacent_panel where mission = 'Cross-cutting'""")
def _(t):
    return training_set(t).filter(F.col("mission") == "Cross-cutting")


@query("x2_reliability", "company_id reliability reliability_reason", """
select s.company_id, case when r = '' then 'standard' else 'low' end as reliability, r as reliability_reason from (
  select f.company_id, concat_ws('; ', case when f.is_fallback_year then 'no_covariate_data_any_year' end,
    case when f.total_employees > 1.5 * (select max(total_employees) from x_labelled l where l.mission = f.mission) then 'total_employees_exceeds_training_range' end,
    case when f.balance_sheet_total_assets > 1.5 * (select max(balance_sheet_total_assets) from x_labelled l where l.mission = f.mission) then 'balance_sheet_total_assets_exceeds_training_range' end,
    case when f.sic_code_1 not in (select sic_code_1 from x_labelled l where l.mission = f.mission) then 'unseen_sic_code_1_category' end,
    case when f.value_stream not in (select value_stream from x_labelled l where l.mission = f.mission) then 'unseen_value_stream_category' end,
    case when f.company_size not in (select company_size from x_labelled l where l.mission = f.mission and company_size is not null) then 'unseen_company_size_category' end) as r
  from x_snapshot_features f where f.mission is not null) s""")
def _(t):
    training = estimation(t)[0].filter(F.col("mission").isNotNull())
    return scoring.reliability(inference_features(t).filter(F.col("mission").isNotNull()), training)


@query("x5_usable_gate", "mission companies:i reason", """
select mission, count(*) as companies, case when mission = 'Resilient Earth' then 'not enough data in '||(select count(*) from x_company where mission = 'Resilient Earth')||' companies'
  else 'mission has no selected model' end as reason from x_snapshot where mission = 'Resilient Earth' or mission is null group by 1""")
def _(t):
    return scoring.usable_only(snapshot(t), selected_stub(t))[1]


@query("c21_validate_summary", "company_id baseline_turnover:m turnover_2030:f", """
select company_id, baseline_turnover, turnover_2030 from x_summary where turnover_2030 is null or turnover_2030 < 0""")
def _(t):
    return quality.summary_faults(flow(t).summary)


