"""Reliability of predictions and the completed one-row-per-company table."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.operators.keys import salted_join
from ledgerline.operators.panel import latest_observed, staleness
from ledgerline.operators.quality import one_row_per_company
from ledgerline.operators.ranks import attach
from ledgerline.settings import CROSS_CUTTING, OUT_OF_RANGE_FACTOR, YEARS

RANGE_CHECKED = ["total_employees", "balance_sheet_total_assets"]
SEEN_CHECKED = ["sic_code_1", "value_stream", "company_size"]


def training_bounds(training: DataFrame) -> DataFrame:
    """Largest training value of each range-checked field per mission."""
    return training.groupBy("mission").agg(*[F.max(c).alias(f"max_{c}") for c in RANGE_CHECKED])


def training_categories(training: DataFrame, column: str) -> DataFrame:
    seen = training.filter(F.col(column).isNotNull()).select("mission", F.col(column).cast("string").alias("value"))
    return seen.distinct().withColumn("column", F.lit(column))


def reliability(df: DataFrame, training: DataFrame) -> DataFrame:
    """Mark predictions that rest on no covariates, extreme or unseen values."""
    out = attach(df, training_bounds(training), ["mission"])
    reasons = [F.when(F.col("is_fallback_year"), "no_covariate_data_any_year")]
    for c in RANGE_CHECKED:
        beyond = F.col(c) > OUT_OF_RANGE_FACTOR * F.col(f"max_{c}")
        reasons.append(F.when(beyond, f"{c}_exceeds_training_range"))
    for c in SEEN_CHECKED:
        seen = training_categories(training, c).select(
            F.concat_ws("|", "mission", "value").alias("_value"), F.lit(True).alias(f"_seen_{c}")
        )
        value = F.when(F.col(c).isNotNull(), F.concat_ws("|", "mission", F.col(c).cast("string")))
        out = salted_join(out.withColumn("_value", value), seen, ["_value"], "company_id").drop("_value")
        unseen = F.col(c).isNotNull() & F.col(f"_seen_{c}").isNull()
        reasons.append(F.when(unseen, f"unseen_{c}_category"))
    out = out.withColumn("reliability_reason", F.concat_ws("; ", *reasons))
    out = out.withColumn("reliability", F.when(F.col("reliability_reason") == "", "standard").otherwise("low"))
    return out.drop(*[f"max_{c}" for c in RANGE_CHECKED], *[f"_seen_{c}" for c in SEEN_CHECKED])


def approximate_reliability(df: DataFrame) -> DataFrame:
    """Every score through a guessed mission is approximate; earlier reasons stay."""
    prefix = F.concat(
        F.lit("cross_cutting_approximate_mission: assigned "),
        F.col("assigned_mission"),
        F.lit(" via "),
        F.col("assignment_method"),
    )
    earlier = F.when(F.col("reliability_reason") != "", F.col("reliability_reason"))
    return df.withColumn("reliability_reason", F.concat_ws("; ", prefix, earlier)).withColumn(
        "reliability", F.lit("approximate")
    )


# Value stream with a model of its own.
SUB_MODEL_ROUTES = {"Consultancy / Other": "consultancy_other", "Explore New Markets": "blended"}


def sub_segment(value_stream: Column, routes: dict[str, str] = SUB_MODEL_ROUTES) -> Column:
    out = F.lit("blended")
    for stream, segment in routes.items():
        out = F.when(value_stream == stream, segment).otherwise(out)
    return out


def usable_only(df: DataFrame, selected: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of usable missions, skipped missions with their reason)."""
    gates = selected.groupBy("mission").agg(
        F.bool_and("usable").alias("_usable"),
        F.max(F.when(~F.col("usable"), F.col("exclusion_reason"))).alias("_reason"),
    )
    joined = attach(df, gates, ["mission"])
    skipped = joined.filter(~F.coalesce("_usable", F.lit(False))).groupBy("mission").agg(
        F.count("*").alias("companies"),
        F.max(F.coalesce("_reason", F.lit("mission has no selected model"))).alias("reason"),
    )
    return joined.filter("_usable").drop("_usable", "_reason"), skipped


def overlay_predictions(base: DataFrame, predictions: DataFrame) -> DataFrame:
    """Fill rows without an observed value from predictions."""
    p = predictions.select(
        "company_id",
        F.col("prediction_year").alias("_year"),
        F.col("predicted_total_turnover").alias("_value"),
        F.col("reliability").alias("_reliability"),
        F.col("reliability_reason").alias("_reason"),
    )
    joined = base.join(p, "company_id", "left")
    fill = F.col("turnover_source").isNull() & F.col("_value").isNotNull()

    def either(new: Column, old: str) -> Column:
        return F.when(fill, new).otherwise(F.col(old))

    return joined.withColumns(
        {
            "turnover_source": either(F.lit("predicted"), "turnover_source"),
            "year": either(F.col("_year"), "year"),
            "turnover_value": either(F.col("_value"), "turnover_value"),
            "reliability": either(F.col("_reliability"), "reliability"),
            "reliability_reason": either(F.col("_reason"), "reliability_reason"),
        }
    ).drop("_year", "_value", "_reliability", "_reason")


def assemble(
    segmented: DataFrame, predictions: DataFrame, selected: DataFrame, years: list[int] = YEARS
) -> tuple[DataFrame, DataFrame]:
    """One row per company: observed value, else prediction, else why there is none."""
    identity = ["company_id", "company_name", "mission", "training_eligible", "exclusion_reason", "is_miscategorised"]
    base, repeated = one_row_per_company(segmented.select(*identity), "segmented_source")
    observed = latest_observed(segmented, ["company_id"], years)
    base = base.join(observed, "company_id", "left")
    trusted = ~F.col("is_miscategorised")
    base = base.withColumn("year", F.when(trusted, F.col("year"))).withColumn(
        "turnover_value", F.when(trusted, F.col("turnover_value"))
    )
    seen = F.col("turnover_value").isNotNull()
    base = base.withColumns(
        {
            "turnover_source": F.when(seen, "observed"),
            "reliability": F.when(seen, "observed"),
            "reliability_reason": F.lit(""),
        }
    )
    base = turnover_cascade(overlay_predictions(base, predictions), selected)
    final, again = one_row_per_company(
        staleness(base).drop("training_eligible", "exclusion_reason", "is_miscategorised"), "post_assembly"
    )
    return final, repeated.unionByName(again, allowMissingColumns=True)


def turnover_cascade(base: DataFrame, selected: DataFrame) -> DataFrame:
    """Source and reason of every row that has neither an observation nor a prediction."""
    unusable = (
        selected.filter(~F.col("usable")).groupBy("mission").agg(F.max("exclusion_reason").alias("_unusable"))
    )
    out = attach(base, unusable, ["mission"])
    open_row = F.col("turnover_source").isNull()
    eligible = F.coalesce("training_eligible", F.lit(False))
    mission = F.col("mission")
    # Source labels, in order of precedence.
    cases = [
        (F.col("_unusable").isNotNull() & eligible, "no_model_insufficient_data", F.col("_unusable")),
        (
            mission == CROSS_CUTTING,
            "cross_cutting_unmodelled",
            F.lit("cross-cutting company kept for reference; its models gave no valid prediction"),
        ),
        (
            mission.isNotNull() & ~eligible,
            "excluded_duplicate_company_record",
            F.lit("true duplicate of another record, excluded pending manual review"),
        ),
        (mission.isNull(), "excluded_data_entry_error", F.col("exclusion_reason")),
    ]
    source, reason = F.lit(None).cast("string"), F.col("reliability_reason")
    for condition, label, text in reversed(cases):
        source = F.when(condition, label).otherwise(source)
        reason = F.when(condition, text).otherwise(reason)
    closed = out.withColumns({"_source": source, "_text": reason})
    return closed.withColumns(
        {
            "reliability": F.when(open_row & F.col("_source").isNotNull(), "n/a").otherwise(F.col("reliability")),
            "reliability_reason": F.when(open_row, F.col("_text")).otherwise(F.col("reliability_reason")),
            "turnover_source": F.coalesce("turnover_source", "_source"),
        }
    ).drop("_source", "_text", "_unusable")
