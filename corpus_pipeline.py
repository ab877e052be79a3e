"""Documents through quality rules, near-dedup, decontamination, secret scan and mixing.

Each stage is written and read again before the next one. The first four return the
columns of `documents`; the last one repeats each row as often as the mix takes it and
numbers the repetitions in `copy`. Stages read only the columns they need by name, so
further columns pass through; an empty table passes through empty."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm import decontam, mixing, quality, secrets, simhash
from ledgerline.llm.rows import quoted, table
from ledgerline.sources.writers import written

# n-gram ratios, hashed fingerprints and Markov models have no SQL form; tests/llm has the brute-force version
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Only documents that pass the rules and the n-gram likelihood ratio."""
    return quality.kept_only(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of smallest id, of each group of linked fingerprints."""
    return simhash.first_of_groups(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Only documents that the benchmark does not contaminate."""
    return decontam.clean_only(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark; n_chars follows the text."""
    out = secrets.redacted(docs, secrets.train(docs))
    if "n_chars" not in docs.columns:
        return out
    length = F.when(F.col("text").isNotNull(), F.char_length("text")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", length.cast(docs.schema["n_chars"].dataType)).select(*quoted(docs.columns))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.repeated(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("near dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret scan", secret_scan),
    ("source mix", source_mix),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
