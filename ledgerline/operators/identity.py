"""Known corrections, duplicate detection and stable company ids."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.text import company_id, normalized_name, registration_key
from ledgerline.operators.keys import join_facts
from ledgerline.operators.quality import union_logs


def _field_text(fields: list[str], field: Column) -> Column:
    value = F.lit(None).cast("string")
    for f in fields:
        value = F.when(field == f, F.col(f).cast("string")).otherwise(value)
    return value


def apply_corrections(
    df: DataFrame, corrections: DataFrame, name: str, fields: list[str]
) -> tuple[DataFrame, DataFrame]:
    """Overwrite fields of named companies from a corrections table.

    `corrections` has match_name, field, new_value (text, null clears), reason,
    one row per name and field."""
    change = F.struct(F.col("new_value"))
    wide = corrections.groupBy("match_name").pivot("field", fields).agg(F.first(change))
    wide = wide.select(
        F.col("match_name").alias("_match"), *[F.col(f).alias(f"_new_{i}") for i, f in enumerate(fields)]
    )
    joined = df.join(wide, F.col(name) == F.col("_match"), "left")
    corrected = []
    for c in df.columns:
        if c in fields:
            new = F.col(f"_new_{fields.index(c)}")
            replaced = new["new_value"].cast(df.schema[c].dataType)
            corrected.append(F.when(new.isNotNull(), replaced).otherwise(F.col(c)).alias(c))
        else:
            corrected.append(F.col(c))
    log = df.join(corrections, F.col(name) == F.col("match_name"), "inner").select(
        F.col(name),
        F.col("field").alias("field_corrected"),
        _field_text(fields, F.col("field")).alias("old_value"),
        "new_value",
        "reason",
    )
    return joined.select(*corrected), log


def resolve_duplicates(df: DataFrame, ch: str, name: str, url: str) -> tuple[DataFrame, DataFrame]:
    """Flag rows that share a registration number.

    Same number and same normalised name: one company twice. Same number and
    different names: an anomaly, kept as separate companies."""
    named = df.withColumn("_norm", normalized_name(F.col(name)))
    facts = (
        named.filter(F.col(ch).isNotNull())
        .groupBy(ch)
        .agg(F.count("*").alias("_n"), F.min("_norm").alias("_lo"), F.max("_norm").alias("_hi"))
        .filter("_n > 1")
    )
    # rows without a number can share none; they stay out of the join, where they would be one key
    blank = {"_n": F.lit(None).cast("bigint"), "_lo": F.lit(None).cast("string"), "_hi": F.lit(None).cast("string")}
    numbered = join_facts(named.filter(F.col(ch).isNotNull()), facts, [ch])
    joined = numbered.unionByName(named.filter(F.col(ch).isNull()).withColumns(blank))
    shared = F.col("_n").isNotNull()
    flagged = joined.withColumn("is_true_duplicate", shared & (F.col("_lo") == F.col("_hi"))).withColumn(
        "is_shared_ch_anomaly", shared & (F.col("_lo") != F.col("_hi"))
    )
    flagged = flagged.withColumns(
        {c: F.coalesce(F.col(c), F.lit(False)) for c in ("is_true_duplicate", "is_shared_ch_anomaly")}
    ).drop("_norm", "_n", "_lo", "_hi")
    # Log reasons.
    reason = F.when(
        F.col("is_true_duplicate"),
        "duplicate_company_record: same CH number and same normalised name",
    ).otherwise(
        "shared_ch_number_anomaly: same CH number but genuinely different company names "
        "— treated as separate entities, not merged"
    )
    log = flagged.filter("is_true_duplicate or is_shared_ch_anomaly").select(
        name, url, ch, reason.alias("reason")
    )
    return flagged, log


def with_company_id(df: DataFrame, ch: str, name: str, url: str) -> DataFrame:
    return df.withColumn("company_id", company_id(F.col(ch), F.col(name).cast("string"), F.col(url)))


def prepare_master(
    df: DataFrame, corrections: DataFrame, ch: str, name: str, url: str, fields: list[str]
) -> tuple[DataFrame, DataFrame]:
    """Corrections, duplicate flags and ids, with one combined quality log."""
    corrected, changes = apply_corrections(df, corrections, name, fields)
    flagged, duplicates = resolve_duplicates(corrected, ch, name, url)
    log = union_logs(
        [
            changes.withColumn("log_type", F.lit("correction")),
            duplicates.withColumn("log_type", F.lit("duplicate_ch")),
        ]
    )
    return with_company_id(flagged, ch, name, url), log


def exclude_known_companies(
    candidates: DataFrame, known: DataFrame, ch: str, known_ch: str
) -> tuple[DataFrame, DataFrame]:
    """Split candidates by whether their registration number is already known."""
    numbers = known.filter(F.col(known_ch).isNotNull()).select(
        registration_key(F.col(known_ch)).alias("_key")
    )
    keyed = candidates.withColumn("_key", registration_key(F.col(ch)))
    distinct = numbers.distinct()
    numbered, blank = keyed.filter(F.col("_key").isNotNull()), keyed.filter(F.col("_key").isNull())
    overlap = numbered.join(distinct, "_key", "left_semi").drop("_key")
    kept = numbered.join(distinct, "_key", "left_anti").unionByName(blank).drop("_key")
    return kept, overlap.withColumn("reason", F.lit("already_a_labelled_space_company"))
