"""Mission segmentation, labelled / inference split and population summaries."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.settings import CORE_MISSIONS, CROSS_CUTTING

EXCLUDED_LABEL = "(excluded: data entry error / miscategorized / unmapped)"


def segment_missions(
    df: DataFrame,
    mapping: DataFrame,
    value_stream: str = "value_stream",
    error_value: str | None = None,
    miscategorised: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Attach the mission of each value stream and why a row is excluded.

    `mapping` (value stream, mission) and `miscategorised` (company_id, note) are
    small curated tables; their size decides the join strategy at run time."""
    lookup = mapping.select(F.col(value_stream).alias("_vs"), F.col("mission").alias("_mission"))
    out = df.join(lookup, F.col(value_stream) == F.col("_vs"), "left").drop("_vs")
    if miscategorised is None:
        out = out.withColumn("_note", F.lit(None).cast("string"))
    else:
        notes = miscategorised.select(F.col("company_id"), F.col("note").alias("_note"))
        out = out.join(notes, "company_id", "left")
    wrong_entry = F.coalesce(F.col(value_stream) == F.lit(error_value), F.lit(False))
    wrong_place = F.col("_note").isNotNull()
    unmapped = F.col("_mission").isNull() & ~wrong_entry & ~wrong_place
    # Reason texts.
    reason = F.concat_ws(
        "; ",
        F.when(wrong_entry, "data_entry_error: Value Stream is company's own name"),
        F.when(wrong_place, F.concat(F.lit("known_miscategorized_company: "), F.col("_note"))),
        F.when(unmapped, "unmapped_value_stream"),
        F.when(F.col("is_true_duplicate"), "duplicate_company_record"),
    )
    out = (
        out.withColumn("mission", F.when(~wrong_entry & ~wrong_place, F.col("_mission")))
        .withColumn("exclusion_reason", reason)
        .withColumn("_logged", wrong_entry | wrong_place | unmapped)
        .withColumn("is_miscategorised", wrong_place)
    )
    out = out.withColumn(
        "training_eligible",
        F.coalesce(F.col("mission") != CROSS_CUTTING, F.lit(False)) & ~F.col("is_true_duplicate"),
    ).withColumn("sample_weight", F.lit(1.0))
    log = out.filter("_logged").select(
        "company_id", value_stream, "mission", F.col("exclusion_reason").alias("reason")
    )
    return out.drop("_mission", "_note", "_logged"), log.withColumn("log_type", F.lit("mission_mapping"))


def mission_summary(segmented: DataFrame) -> DataFrame:
    """Company counts per mission, with one row for everything excluded."""
    label = F.when(
        F.col("mission").isNull(), EXCLUDED_LABEL
    ).otherwise(F.col("mission"))
    kept = F.col("mission").isNotNull()
    return segmented.groupBy(label.alias("mission")).agg(
        F.count("*").alias("total_companies"),
        F.count_if(kept & F.col("training_eligible")).alias("training_eligible"),
        F.count_if(kept & F.col("is_true_duplicate")).alias("excluded_true_duplicate"),
        F.count_if(kept & F.col("is_shared_ch_anomaly") & F.col("training_eligible")).alias(
            "shared_ch_anomaly_not_excluded"
        ),
    )


def split_labelled(df: DataFrame, turnover_columns: list[str]) -> tuple[DataFrame, DataFrame]:
    labelled = F.coalesce(*[F.col(f"`{c}`") for c in turnover_columns]).isNotNull()
    return df.filter(labelled), df.filter(~labelled)


def sample_summary(segmented: DataFrame, panel: DataFrame, turnover_columns: list[str]) -> DataFrame:
    """Eligible, labelled and inference companies and panel rows per mission."""
    labelled = F.coalesce(*[F.col(f"`{c}`") for c in turnover_columns]).isNotNull()
    companies = (
        segmented.filter(F.col("mission").isin(CORE_MISSIONS) & F.col("training_eligible"))
        .groupBy("mission")
        .agg(
            F.count("*").alias("training_eligible_companies"),
            F.count_if(labelled).alias("labelled_companies"),
            F.count_if(~labelled).alias("inference_companies"),
        )
    )
    rows = panel.groupBy("mission").agg(F.count("*").alias("labelled_panel_rows"))
    return companies.join(rows, "mission", "left").fillna(0, ["labelled_panel_rows"])
