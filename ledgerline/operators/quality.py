"""Data-quality checks. Each returns (clean rows, log of flagged rows)."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.numeric import is_finite, not_nan, number_of
from ledgerline.functions.text import strip
from ledgerline.operators.keys import join_facts, repeated_keys, split_repeated
from ledgerline.settings import (
    CORE_MISSIONS,
    FORECAST_MISSIONS,
    MAX_EMPLOYEES,
    SUPPORTED_YEARS,
)

Checked = tuple[DataFrame, DataFrame]


def union_logs(logs: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), logs)


def nan_to_null(df: DataFrame) -> DataFrame:
    floats = {f.name for f in df.schema if f.dataType.typeName() in ("double", "float")}
    return df.select(*[not_nan(F.col(f"`{c}`")).alias(c) if c in floats else F.col(f"`{c}`") for c in df.columns])


def check_company_id(df: DataFrame, col: str = "company_id") -> Checked:
    bad = F.col(col).isNull() | (strip(F.col(col)) == "")
    log = df.filter(bad).withColumn("exclusion_reason", F.lit("missing_or_blank_company_id"))
    return df.filter(~bad), log


def check_duplicates(df: DataFrame, keys: list[str], order: str) -> Checked:
    """Keep the first row per key by `order`; log every row of a repeated key."""
    marked = join_facts(df, repeated_keys(df, keys, F.col(order)), keys)
    repeated = F.col("copies").isNotNull()
    reason = "duplicate_key_flagged_for_manual_review_no_reliability_or_timestamp_signal"
    log = marked.filter(repeated).drop("copies", "first_order")
    clean = marked.filter(~repeated | (F.col(order) == F.col("first_order")))
    return clean.drop("copies", "first_order"), log.withColumn("exclusion_reason", F.lit(reason))


def turnover_fault(raw: Column) -> Column:
    number = number_of(raw)
    # A negative infinity counts as non-finite.
    return (
        F.when(number.isNotNull() & ~is_finite(number), "non_finite")
        .when(number < 0, "negative")
        .when(raw.isNotNull() & number.isNull(), "non_numeric")
    )


def check_turnover(df: DataFrame, col: str = "turnover") -> Checked:
    """Null bad turnover and log it with its original value; rows stay."""
    fault = turnover_fault(F.col(col))
    log = df.filter(fault.isNotNull()).withColumn("exclusion_reason", F.concat(F.lit("turnover_"), fault))
    return df.withColumn(col, F.when(fault.isNull(), number_of(F.col(col)))), log


def check_years(df: DataFrame, col: str, supported: tuple[int, int] = SUPPORTED_YEARS) -> Checked:
    year = number_of(F.col(col))
    four_digit = F.coalesce((year == F.round(year)) & year.between(1000, 9999), F.lit(False))
    valid = four_digit & year.between(*supported)
    reason = F.when(~four_digit, "year_not_four_digit_integer").otherwise("year_outside_supported_range")
    log = df.filter(~valid).withColumn("exclusion_reason", reason)
    return df.filter(valid).withColumn(col, year.cast("int")), log


def check_plausible_employees(df: DataFrame, col: str = "employees", limit: int = MAX_EMPLOYEES) -> Checked:
    if col not in df.columns:
        return df, df.limit(0).withColumn("exclusion_reason", F.lit(None).cast("string"))
    bad = F.coalesce(F.col(col) > limit, F.lit(False))
    log = df.filter(bad).withColumn("exclusion_reason", F.lit("employees_exceeds_plausible_max"))
    return df.withColumn(col, F.when(~bad, F.col(col))), log


def canonical_mission(raw: Column) -> Column:
    key = F.lower(strip(raw))
    canonical = F.lit(None).cast("string")
    for mission in FORECAST_MISSIONS:
        canonical = F.when(key == mission.lower(), mission).otherwise(canonical)
    return canonical


def primary_model_eligible(mission: Column) -> Column:
    return mission.isin(CORE_MISSIONS)


def check_mission(df: DataFrame, col: str = "mission") -> Checked:
    canonical = canonical_mission(F.col(col))
    reason = F.when(F.col(col).isNull(), "missing_mission").otherwise("unrecognized_mission_value")
    log = df.filter(canonical.isNull()).withColumn("exclusion_reason", reason)
    clean = df.filter(canonical.isNotNull()).withColumn(col, canonical)
    return clean.withColumn("primary_model_eligible", primary_model_eligible(F.col(col))), log


def normalize_source(df: DataFrame) -> Checked:
    """Map the turnover source to observed / estimated, null without a value."""
    raw = F.col("turnover_source")
    mapped = F.when(raw == "observed", "observed").when(raw == "predicted", "estimated")
    has_value = F.col("baseline_turnover").isNotNull()
    out = df.withColumn("turnover_source_raw", raw).withColumn(
        "turnover_source", F.when(has_value, mapped)
    )
    reason = F.lit("turnover_source_value_not_in_observed_estimated_map")
    log = out.filter(has_value & F.col("turnover_source").isNull())
    return out, log.withColumn("exclusion_reason", reason)


def missing_fields(df: DataFrame, required: list[str]) -> list[str]:
    """Required fields the table lacks; they are reported, never made up."""
    return [f for f in required if f not in df.columns]


def field_report(df: DataFrame, required: list[str], dataset: str) -> DataFrame:
    """One row per required field: whether it exists and how many values it holds."""
    absent = missing_fields(df, required)
    counts = [F.lit(0).cast("bigint") if f in absent else F.count(f) for f in required]
    rows = [
        F.struct(F.lit(f).alias("field"), F.lit(f not in absent).alias("present"), n.alias("non_null"))
        for f, n in zip(required, counts, strict=True)
    ]
    return df.agg(F.array(*rows).alias("r")).select(F.lit(dataset).alias("dataset"), F.inline("r"))


def invalid_turnover_flags(baseline_log: DataFrame, panel_log: DataFrame) -> DataFrame:
    """Company, year and original value of every turnover the checks rejected."""

    def pick(log: DataFrame, check: str, source: str, year: str, value: str) -> DataFrame:
        return log.filter(F.col("check") == check).select(
            "company_id",
            F.lit(source).alias("source"),
            F.col(year).cast("double").cast("int").alias("offending_year"),
            F.col(value).cast("string").alias("offending_value"),
            "exclusion_reason",
        )

    return pick(
        baseline_log, "baseline_turnover", "completed_baseline", "baseline_year", "baseline_turnover"
    ).unionByName(pick(panel_log, "turnover", "historical_panel", "accounting_year", "turnover"))


def exclude_invalid_history(
    baseline: DataFrame, panel: DataFrame, flags: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Drop a company from both tables once any of its turnover values was invalid."""
    bad = flags.select("company_id").distinct()
    return baseline.join(bad, "company_id", "left_anti"), panel.join(bad, "company_id", "left_anti")


def _chain(df: DataFrame, steps: list) -> Checked:
    logs = []
    for name, step in steps:
        df, log = step(df)
        logs.append(_as_text(log).withColumn("check", F.lit(name)))
    return df, union_logs(logs)


def _as_text(log: DataFrame) -> DataFrame:
    """Logs of one chain are stacked, so checked fields are kept as text."""
    checked = ("baseline_turnover", "turnover", "baseline_year", "accounting_year")
    return log.select(*[F.col(c).cast("string").alias(c) if c in checked else F.col(c) for c in log.columns])


def validate_baseline(df: DataFrame, order: str) -> Checked:
    return _chain(
        df,
        [
            ("company_id", check_company_id),
            ("duplicate_company_id", lambda d: check_duplicates(d, ["company_id"], order)),
            ("baseline_turnover", lambda d: check_turnover(d, "baseline_turnover")),
            ("baseline_year", lambda d: check_years(d, "baseline_year")),
            ("mission", check_mission),
            ("turnover_source", normalize_source),
        ],
    )


def validate_panel(df: DataFrame, order: str) -> Checked:
    return _chain(
        df,
        [
            ("company_id", check_company_id),
            (
                "duplicate_company_year",
                lambda d: check_duplicates(d, ["company_id", "accounting_year"], order),
            ),
            ("turnover", check_turnover),
            ("employees", check_plausible_employees),
            ("accounting_year", lambda d: check_years(d, "accounting_year")),
            ("mission", check_mission),
        ],
    )


def negative_log_inputs(df: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """Values below zero in columns about to be log-transformed."""
    wide = df.select(id_col, *[F.col(c).cast("double").alias(c) for c in columns])
    return wide.unpivot([id_col], columns, "column", "value").filter("value < 0")


def validate_predictions(df: DataFrame, col: str = "predicted_total_turnover") -> DataFrame:
    value = F.col(col)
    reason = F.when(~is_finite(value), "non_finite_prediction").when(value < 0, "negative_prediction")
    return (
        df.withColumn("prediction_invalid_reason", F.coalesce(reason, F.lit("")))
        .withColumn("prediction_valid", F.col("prediction_invalid_reason") == "")
        .withColumn(col, F.when(F.col("prediction_valid"), value))
    )


def summary_faults(summary: DataFrame, col: str = "turnover_2030") -> DataFrame:
    value = F.col(col)
    return summary.filter(value.isNull() | ~is_finite(value) | (value < 0))


def one_row_per_company(df: DataFrame, stage: str) -> Checked:
    """Move every copy of a repeated company_id to a review set."""
    unique, repeated = split_repeated(df, ["company_id"])
    return unique, repeated.withColumn("duplicate_detected_at_stage", F.lit(stage))


def null_negative_age(df: DataFrame, age: str = "company_age_years") -> Checked:
    bad = F.coalesce(F.col(age) < 0, F.lit(False))
    reason = F.lit("negative_company_age: turnover recorded in a year before Founded")
    log = df.filter(bad).withColumn(f"original_{age}", F.col(age)).withColumn("reason", reason).drop(age)
    return df.withColumn(age, F.when(~bad, F.col(age))), log


def guard_non_negative(df: DataFrame, columns: list[str]) -> DataFrame:
    """Fail the job when a level that is about to be logged is negative."""
    out = df
    for c in columns:
        message = F.lit(f"negative value in {c}; exclude invalid turnover history first")
        out = out.withColumn(c, F.when(F.col(c) < 0, F.raise_error(message).cast("double")).otherwise(F.col(c)))
    return out
