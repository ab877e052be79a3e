"""Benchmarks, the recursive forecast, intervals and trajectories."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.numeric import (
    cagr_growth,
    decayed,
    gated_growth,
    grown,
    growth_signal,
    horizon_bucket,
    interval,
    is_finite,
    log_growth,
    mean_of,
)
from ledgerline.operators.features import growth_core
from ledgerline.operators.metrics import metrics
from ledgerline.operators.ranks import attach, quantile
from ledgerline.operators.splits import temporal_outer
from ledgerline.settings import (
    BENCHMARKS,
    EVIDENCE_GROUPS,
    FORECAST_END_YEAR,
    MIN_SPREAD_SAMPLES,
    OUTER_CUTOFFS,
    STABLE_MODEL,
    TREND_MODEL,
)


# --- one-year-ahead benchmarks ------------------------------------------------------


def train_mean_growth(training: DataFrame, cutoffs: list[int] = OUTER_CUTOFFS) -> DataFrame:
    """Mean growth of the training part of every cutoff, one pass, no row copies."""
    growth = F.col("log_growth_1y")
    means = [
        F.struct(
            F.lit(c).alias("cutoff_year"),
            F.coalesce(F.avg(F.when(F.col("target_year") <= c, growth)), F.lit(0.0)).alias("mean_growth"),
        )
        for c in cutoffs
    ]
    return training.groupBy("mission").agg(F.array(*means).alias("m")).select("mission", F.inline("m"))


def benchmark_predictions(training: DataFrame, cutoffs: list[int] = OUTER_CUTOFFS) -> DataFrame:
    """Test rows of every cutoff with the three benchmark predictions."""
    tests = temporal_outer(training, cutoffs).filter(F.col("role") == "test").drop("role")
    rows = attach(tests, train_mean_growth(training, cutoffs), ["mission", "cutoff_year"])
    t = F.col("turnover_t")
    own = cagr_growth(F.col("log_growth_3y_mean"), F.col("log_growth_2y_mean"), F.col("log_growth_1y"))
    return rows.withColumns(
        {
            "Persistence": t,
            "Mission-Average Growth": grown(t, F.col("mean_growth")),
            "Company Historical CAGR": grown(t, own),
            "horizon": horizon_bucket(F.col("target_year"), F.col("cutoff_year")),
        }
    )


def long_predictions(predictions: DataFrame, keep: list[str], models: list[str] = BENCHMARKS) -> DataFrame:
    return predictions.unpivot(keep, models, "Model", "predicted")


def benchmark_folds(training: DataFrame, cutoffs: list[int] = OUTER_CUTOFFS) -> DataFrame:
    keys = ["mission", "cutoff_year", "horizon"]
    rows = long_predictions(
        benchmark_predictions(training, cutoffs), [*keys, "target_turnover_next_year"]
    )
    return metrics(rows, [*keys, "Model"], "target_turnover_next_year", "predicted")


# --- anchors and spreads ------------------------------------------------------------


def growth_anchor(engineered: DataFrame) -> DataFrame:
    """Median one-year growth per mission from real rows only."""
    return quantile(engineered, ["mission"], "log_growth_1y", 0.5, "anchor")


def residual_spread(engineered: DataFrame, groups: DataFrame) -> DataFrame:
    """Spread of one-year growth per mission and evidence group.

    Cells with too few transitions take the widest reliable spread of their mission."""
    labelled = engineered.join(groups.select("company_id", "forecast_evidence_group"), "company_id", "left")
    cells = (
        labelled.filter(F.col("log_growth_1y").isNotNull() & F.col("forecast_evidence_group").isNotNull())
        .groupBy("mission", "forecast_evidence_group")
        .agg(F.stddev_samp("log_growth_1y").alias("std"), F.count("*").alias("count"))
    )
    reliable = F.col("count") >= MIN_SPREAD_SAMPLES
    widest = cells.filter(reliable).groupBy("mission").agg(F.max("std").alias("fallback_std"))
    letters = F.explode(F.array(*[F.lit(g) for g in EVIDENCE_GROUPS]))
    grid = engineered.select("mission").distinct().withColumn("forecast_evidence_group", letters)
    out = grid.join(cells, ["mission", "forecast_evidence_group"], "left").join(widest, "mission", "left")
    out = out.withColumn("count", F.coalesce("count", F.lit(0))).withColumn(
        "used_fallback_spread", F.col("count") < MIN_SPREAD_SAMPLES
    )
    sigma = F.when(F.col("used_fallback_spread"), F.col("fallback_std")).otherwise(F.col("std"))
    return out.select(
        "mission", "forecast_evidence_group", sigma.alias("sigma_log_residual"), "count", "used_fallback_spread"
    )


# --- recursion -----------------------------------------------------------------------


def seed_companies(panel: DataFrame, baseline: DataFrame, static: DataFrame) -> DataFrame:
    """Add a starting row for estimated baselines that have no panel row."""
    seeds = baseline.filter(F.col("turnover_source") == "estimated").select(
        "company_id",
        "mission",
        F.col("baseline_year").alias("accounting_year"),
        F.col("baseline_turnover").alias("turnover"),
    )
    missing = seeds.join(panel.select("company_id", "accounting_year"), ["company_id", "accounting_year"], "left_anti")
    facts = static.select("company_id", "founded_year", "sic_code_1", "value_stream")
    rows = missing.join(facts, "company_id", "left").withColumn(
        "company_age", F.col("accounting_year") - F.col("founded_year")
    )
    return panel.unionByName(rows, allowMissingColumns=True)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind an expression once inside a higher-order function."""
    return F.get(F.transform(F.array(value), body), 0)


STATE = "struct<t double, g0 double, g1 double, g2 double>"
STEP = (
    "array<struct<step int, turnover double, growth_signal string, growth_classification string>>"
)


def _advance(acc: Column, step: Column, evidence: Column, anchor: Column) -> Column:
    """One recursive step on (turnover, last three growths, rows so far)."""
    s = acc["state"]

    def routed(mean: Column) -> Column:
        signal = growth_signal(mean, s["g0"])
        return F.struct(mean.alias("mean"), signal.alias("signal"), gated_growth(signal, evidence).alias("class"))

    def predicted(route: Column) -> Column:
        trend = decayed(s["t"], grown(s["t"], F.coalesce(route["mean"], F.lit(0.0))), step, anchor)
        raw = F.when(route["class"] == "growing", trend).otherwise(s["t"])
        return F.struct(route.alias("route"), F.when(is_finite(raw) & (raw >= 0), raw).alias("next"))

    def appended(p: Column) -> Column:
        row = F.struct(
            step.cast("int").alias("step"),
            p["next"].alias("turnover"),
            p["route"]["signal"].alias("growth_signal"),
            p["route"]["class"].alias("growth_classification"),
        )
        state = F.struct(
            p["next"].alias("t"),
            log_growth(p["next"], s["t"]).alias("g0"),
            s["g0"].alias("g1"),
            s["g1"].alias("g2"),
        )
        rows = F.when(p["next"].isNotNull(), F.concat(acc["rows"], F.array(row))).otherwise(acc["rows"])
        return F.struct(state.cast(STATE).alias("state"), rows.cast(STEP).alias("rows"))

    mean = mean_of([s["g2"], s["g1"], s["g0"]])
    return let(let(let(mean, routed), predicted), appended)


def recursive_forecast(
    panel: DataFrame,
    baseline: DataFrame,
    groups: DataFrame,
    static: DataFrame,
    end_year: int = FORECAST_END_YEAR,
) -> DataFrame:
    """Project every company year by year to `end_year`.

    The next value depends only on the current turnover and the last three growth
    rates, so each company carries a constant-size state through one narrow stage:
    no loop of jobs, no shuffle per step. A failed prediction ends its company."""
    anchors = growth_anchor(growth_core(panel))
    origin = growth_core(seed_companies(panel, baseline, static))
    lag1, lag2, lag3 = F.col("turnover_lag_1"), F.col("turnover_lag_2"), F.col("turnover_lag_3")
    origin = origin.select(
        "company_id", "mission", "accounting_year", "founded_year", "sic_code_1", "value_stream",
        "total_assets", "employees", "export_revenue", "company_size", "turnover_t",
        F.col("log_growth_1y").alias("g0"),
        log_growth(lag1, lag2).alias("g1"),
        log_growth(lag2, lag3).alias("g2"),
    )
    start = baseline.select("company_id", F.col("baseline_year").alias("accounting_year")).filter(
        F.col("accounting_year") < end_year
    )
    active = origin.join(start, ["company_id", "accounting_year"]).join(
        groups.select("company_id", F.col("forecast_evidence_group").alias("evidence_group")), "company_id", "left"
    )
    active = attach(active.fillna("D", ["evidence_group"]), anchors, ["mission"])
    first = F.struct(
        F.struct(F.col("turnover_t").alias("t"), "g0", "g1", "g2").cast(STATE).alias("state"),
        F.array().cast(STEP).alias("rows"),
    )
    steps = F.sequence(F.lit(1), F.lit(end_year) - F.col("accounting_year"))
    folded = F.aggregate(
        steps, first, lambda acc, k: _advance(acc, k, F.col("evidence_group"), F.col("anchor"))
    )
    out = active.withColumn("_rows", folded["rows"]).select("*", F.inline("_rows")).drop("_rows")
    year = F.col("accounting_year") + F.col("step")
    model = F.when(F.col("growth_classification") == "growing", TREND_MODEL).otherwise(STABLE_MODEL)
    return out.select(
        "company_id",
        "mission",
        year.alias("accounting_year"),
        "sic_code_1",
        "value_stream",
        "total_assets",
        "employees",
        "export_revenue",
        "company_size",
        (year - F.col("founded_year")).alias("company_age"),
        "turnover",
        model.alias("model_used"),
        "growth_signal",
        "evidence_group",
        "growth_classification",
        "step",
    )


# --- outputs --------------------------------------------------------------------------

INTERVAL_COLUMNS = ["sigma_log_residual", "used_fallback_spread", "turnover_lower", "turnover_upper", "count"]


def with_intervals(trajectories: DataFrame, spread: DataFrame) -> DataFrame:
    """Add bounds; columns of an earlier run are replaced, so reruns agree."""
    fresh = trajectories.drop(*INTERVAL_COLUMNS)
    cells = spread.withColumnRenamed("forecast_evidence_group", "evidence_group").drop("count")
    joined = attach(fresh, cells, ["mission", "evidence_group"])
    lower, upper = interval(F.col("turnover"), F.col("sigma_log_residual"), F.col("step"))
    return joined.withColumn("turnover_lower", lower).withColumn("turnover_upper", upper)


def full_trajectories(panel: DataFrame, predicted: DataFrame, baseline: DataFrame) -> DataFrame:
    """Observed, estimated-baseline and predicted years of every company."""
    keys = ["company_id", "accounting_year"]
    observed = panel.select(*keys, "mission", "turnover", F.lit("observed").alias("data_type"))
    starts = baseline.select(
        "company_id",
        F.col("baseline_year").alias("accounting_year"),
        "mission",
        F.col("baseline_turnover").alias("turnover"),
        F.lit("estimated_baseline").alias("data_type"),
    ).join(panel.select(*keys), keys, "left_anti")
    extra = [c for c in ("turnover_lower", "turnover_upper") if c in predicted.columns]
    future = predicted.select(
        *keys, "mission", "turnover", F.lit("predicted").alias("data_type"),
        "model_used", "growth_classification", *extra,
    )
    stacked = observed.unionByName(starts)
    return stacked.unionByName(future, allowMissingColumns=True)


def final_summary(
    baseline: DataFrame, trajectories: DataFrame, predicted: DataFrame, end_year: int = FORECAST_END_YEAR
) -> DataFrame:
    """One row per company: final turnover, multiple, yearly rate, route counts."""
    final = trajectories.filter(F.col("accounting_year") == end_year).select(
        "company_id", F.col("turnover").alias("turnover_2030")
    )
    kind = F.col("growth_classification")
    used = F.col("model_used")
    routes = predicted.groupBy("company_id").agg(
        F.count_if(kind == "growing").alias("n_years_growing"),
        F.count_if(kind == "stable").alias("n_years_stable"),
        F.max(F.when(used.isNotNull(), F.struct("accounting_year", "model_used")))["model_used"].alias(
            "final_step_model_used"
        ),
    )
    out = baseline.join(final, "company_id", "left").join(routes, "company_id", "left")
    out = out.fillna(0, ["n_years_growing", "n_years_stable"])
    multiple, yearly = growth_multiple(
        F.col("turnover_2030"), F.col("baseline_turnover"), F.lit(end_year) - F.col("baseline_year")
    )
    return out.withColumns(
        {
            "growth_multiple_2030": multiple,
            "annualized_growth_rate_to_2030": yearly,
            "ever_classified_growing": F.col("n_years_growing") > 0,
        }
    )


def growth_multiple(final: Column, base: Column, years: Column) -> tuple[Column, Column]:
    multiple = F.try_divide(final, base)
    yearly = F.pow(multiple, F.try_divide(F.lit(1.0), years.cast("double"))) - 1
    return multiple, yearly
