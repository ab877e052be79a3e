"""Threshold crossings, sustained growth, credibility and company profiles."""

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ledgerline.functions.numeric import log_growth
from ledgerline.functions.text import base_feature_name
from ledgerline.settings import (
    FIFTY_MILLION,
    GAZELLE_CUTS,
    GAZELLE_YEARS,
    MIN_WEIGHT,
    ONE_MILLION,
    RECENT_YEARS,
    TEN_MILLION,
    TOP_FEATURES,
    TREND_EVIDENCE,
)

def by_year() -> WindowSpec:
    return Window.partitionBy("company_id").orderBy("accounting_year")


def to_date() -> WindowSpec:
    return by_year().rowsBetween(Window.unboundedPreceding, 0)


def _run_to_here(hit: Column) -> Column:
    """Length of the unbroken run of hits ending at this row."""
    position = F.row_number().over(by_year())
    miss = F.when(~F.coalesce(hit, F.lit(False)), position)
    return position - F.coalesce(F.max(miss).over(to_date()), F.lit(0))


def _consecutive() -> Column:
    year = F.col("accounting_year")
    return year - F.lag(year).over(by_year()) == 1


def gazelle_runs(trajectories: DataFrame) -> DataFrame:
    """Longest run of consecutive years growing at least 10 % and 20 %."""
    t = F.col("turnover")
    walked = trajectories.select("company_id", "accounting_year", "turnover").withColumn(
        "_growth", F.when(_consecutive(), log_growth(t, F.lag(t).over(by_year())))
    )
    hits = {f"_hit_{k}": F.coalesce(F.col("_growth") >= cut, F.lit(False)) for k, cut in GAZELLE_CUTS.items()}
    walked = walked.withColumns(hits).withColumns({f"_run_{k}": _position_since(f"_hit_{k}") for k in GAZELLE_CUTS})
    runs = walked.groupBy("company_id").agg(
        *[F.max(f"_run_{k}").alias(f"longest_run_{k}") for k in GAZELLE_CUTS]
    )
    return runs.withColumns({f"gazelle_{k}": F.col(f"longest_run_{k}") >= GAZELLE_YEARS for k in GAZELLE_CUTS})


def _position_since(hit: str) -> Column:
    return _run_to_here(F.col(hit))


def operational_scaling(engineered: DataFrame) -> DataFrame:
    """Sustained growth of employees or assets over real years.

    A missing growth value breaks a run like a gap year does."""
    metrics = ["employee_growth", "asset_growth"]
    walked = engineered.select("company_id", "accounting_year", *metrics).withColumn("_next", _consecutive())
    hits = {
        f"_hit_{m}_{k}": F.coalesce(F.col("_next") & (F.col(m) >= cut), F.lit(False))
        for m in metrics
        for k, cut in GAZELLE_CUTS.items()
    }
    walked = walked.withColumns(hits)
    walked = walked.withColumns(
        {f"_run_{m}_{k}": _position_since(f"_hit_{m}_{k}") for m in metrics for k in GAZELLE_CUTS}
    )
    facts = [F.count(m).alias(f"n_real_years_{m}") for m in metrics]
    facts += [F.max(f"_run_{m}_{k}").alias(f"_long_{m}_{k}") for m in metrics for k in GAZELLE_CUTS]
    out = walked.groupBy("company_id").agg(*facts)
    flags = {
        f"{m}_{k}": (F.col(f"n_real_years_{m}") >= GAZELLE_YEARS) & (F.col(f"_long_{m}_{k}") >= GAZELLE_YEARS)
        for m in metrics
        for k in GAZELLE_CUTS
    }
    out = out.withColumns(flags).drop(*[f"_long_{m}_{k}" for m in metrics for k in GAZELLE_CUTS])
    return out.withColumns(
        {f"operational_scaling_{k}": F.col(f"employee_growth_{k}") | F.col(f"asset_growth_{k}") for k in GAZELLE_CUTS}
    )


def report_context(trajectories: DataFrame, predicted: DataFrame, summary: DataFrame) -> DataFrame:
    """Evidence, source, observed years and routing facts of each company."""
    years = (
        trajectories.filter(F.col("data_type") == "observed")
        .groupBy("company_id")
        .agg(F.count("*").alias("n_real_years"))
    )
    gated = (F.col("growth_signal") == "growing") & (F.col("growth_classification") == "stable")
    gate = predicted.groupBy("company_id").agg(F.bool_or(gated).alias("evidence_gate_triggered"))
    base = summary.select(
        "company_id", "company_name", "mission", "baseline_year", "baseline_turnover", "turnover_2030",
        "forecast_evidence_group",
        F.col("turnover_source").alias("baseline_turnover_source"),
        F.col("ever_classified_growing").alias("growth_decay_applied"),
    )
    out = base.join(years, "company_id", "left").join(gate, "company_id", "left")
    return out.fillna(0, ["n_real_years"]).fillna(False, ["evidence_gate_triggered"])


def crossings(context: DataFrame, threshold: float = TEN_MILLION) -> DataFrame:
    return context.filter((F.col("baseline_turnover") < threshold) & (F.col("turnover_2030") >= threshold))


def recent_peak(trajectories: DataFrame, years: int = RECENT_YEARS) -> DataFrame:
    """Largest turnover among the latest observed years of each company."""
    latest_first = Window.partitionBy("company_id").orderBy(F.col("accounting_year").desc())
    observed = trajectories.filter(F.col("data_type") == "observed")
    recent = observed.withColumn("_n", F.row_number().over(latest_first)).filter(F.col("_n") <= years)
    return recent.groupBy("company_id").agg(F.max("turnover").alias("max_recent_turnover"))


def credible_intersection(
    context: DataFrame, runs: DataFrame, trajectories: DataFrame, threshold: float = FIFTY_MILLION
) -> DataFrame:
    """Either growth tier and a large final turnover, with its credibility status.

    Companies below the bar are kept and labelled, not dropped."""
    either = runs.filter(F.col("gazelle_10pct") | F.col("gazelle_20pct"))
    out = context.filter(F.col("turnover_2030") >= threshold).join(either, "company_id")
    out = out.join(recent_peak(trajectories), "company_id", "left")
    passes = (F.col("forecast_evidence_group") == TREND_EVIDENCE) & (
        F.coalesce("max_recent_turnover", F.lit(0.0)) >= ONE_MILLION
    )
    status = F.when(passes, "meets_credibility_threshold").otherwise("does_not_meet_credibility_threshold")
    return out.withColumn("credibility_status", status).drop("max_recent_turnover")


def scaling_report(context: DataFrame, scaling: DataFrame) -> DataFrame:
    return context.join(scaling.filter("operational_scaling_10pct"), "company_id")


def company_profiles(
    summary: DataFrame, trajectories: DataFrame, runs: DataFrame, intersection: DataFrame, scaling: DataFrame,
    threshold: float = TEN_MILLION,
) -> DataFrame:
    """Explorer view: identity, forecast, flags and provenance counts per company."""
    kinds = F.col("data_type")
    provenance = trajectories.groupBy("company_id").agg(
        F.count_if(kinds == "observed").alias("observed_years"),
        F.count_if(kinds == "estimated_baseline").alias("estimated_years"),
        F.count_if(kinds == "predicted").alias("predicted_years"),
    )
    flags = runs.select("company_id", "gazelle_10pct", "gazelle_20pct")
    status = intersection.select("company_id", "credibility_status")
    scaled = scaling.select("company_id", F.col("operational_scaling_10pct"))
    out = summary.join(provenance, "company_id", "left").join(flags, "company_id", "left")
    out = out.join(status, "company_id", "left").join(scaled, "company_id", "left")
    crossing = (F.col("baseline_turnover") < threshold) & (F.col("turnover_2030") >= threshold)
    booleans = ["gazelle_10pct", "gazelle_20pct", "operational_scaling_10pct", "crosses_10m"]
    return out.withColumn("crosses_10m", crossing).fillna(False, booleans)


# --- feature usage ---------------------------------------------------------------------


def top_features(weights: DataFrame, top: int = TOP_FEATURES) -> DataFrame:
    """Strongest features per mission, category levels folded into their field.

    Weights that differ only in the last bits, as those of a count and its share do, are equal: by name."""
    strong = weights.withColumn("magnitude", F.abs("weight")).filter(F.col("magnitude") > MIN_WEIGHT)
    order = Window.partitionBy("mission").orderBy(F.round(F.ln("magnitude"), 11).desc(), "feature")
    kept = strong.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= top)
    named = kept.withColumn("engineered_feature", base_feature_name(F.col("feature")))
    return named.groupBy("mission", "engineered_feature").agg(F.min("place").alias("place"))


def usage_counts(top: DataFrame, purpose: str | None) -> DataFrame:
    """How many models have a feature at their top, and which; without a purpose the missions name the models."""
    label = F.col("mission") if purpose is None else F.concat(F.col("mission"), F.lit(f" ({purpose})"))
    return top.groupBy("engineered_feature").agg(
        F.count("*").alias("n_mission_models_top15"),
        F.array_join(F.array_sort(F.collect_list(label)), "; ").alias("used_in"),
    )


def feature_usage(usage: DataFrame, lineage: DataFrame, other: DataFrame) -> DataFrame:
    """Used features with their raw fields, then structural and dropped fields."""
    used = usage.join(lineage, "engineered_feature", "left").select(
        F.coalesce("source_file", F.lit("UNMAPPED")).alias("source_file"),
        F.coalesce("raw_field", "engineered_feature").alias("raw_field"),
        "engineered_feature",
        F.lit("used_top15").alias("status"),
        "n_mission_models_top15",
        "used_in",
    )
    rest = other.select(
        "source_file", "raw_field", F.lit("").alias("engineered_feature"), "status",
        F.when(F.col("status") != "structural_required", F.lit(0).cast("bigint")).alias("n_mission_models_top15"),
        F.when(F.col("status") == "structural_required", "all").otherwise("").alias("used_in"),
    )
    return used.unionByName(rest)


def ranked_usage(report: DataFrame) -> DataFrame:
    return report.orderBy(F.col("source_file"), F.col("n_mission_models_top15").desc_nulls_last())
