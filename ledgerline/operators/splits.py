"""Grouped, population-aware and rolling-origin train / test splits as data."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.operators.keys import join_facts
from ledgerline.operators.ranks import attach, numbered_by_hash, tile
from ledgerline.settings import FOLDS, INNER_OFFSETS, OUTER_CUTOFFS, REPEATS, SEED, SPACE


def group_folds(
    df: DataFrame, k: int = FOLDS, repeats: int = REPEATS, seed: int = SEED, key: str = "company_id"
) -> DataFrame:
    """(company, repeat, fold): near-equal company counts, one fold per repeat."""
    spread = df.select(key).distinct().withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    label = F.concat_ws(":", F.col(key).cast("string"), (F.col("repeat") + seed).cast("string"))
    numbered = numbered_by_hash(spread, ["repeat"], label)
    fold = tile(F.col("position"), F.col("group_rows"), k) - 1
    return numbered.select(key, "repeat", fold.cast("int").alias("fold"))


def primary_folds(df: DataFrame, k: int = FOLDS, repeats: int = REPEATS, seed: int = SEED) -> DataFrame:
    """Folds over space companies only; other rows keep a null fold in each repeat.

    A row trains fold f when its fold is null or differs from f, so added
    populations train every fold and are never tested."""
    folds = group_folds(df.filter(F.col("population_type") == SPACE), k, repeats, seed)
    spread = df.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    return join_facts(spread, folds, ["company_id", "repeat"])


def _with_both_roles(roles: DataFrame, keys: list[str]) -> DataFrame:
    usable = (
        roles.groupBy(*keys)
        .agg(F.count_if(F.col("role") == "train").alias("n"), F.count_if(F.col("role") == "test").alias("m"))
        .filter("n > 0 and m > 0")
        .drop("n", "m")
    )
    return attach(roles, usable, keys, "inner")


def temporal_outer(
    df: DataFrame, cutoffs: list[int] = OUTER_CUTOFFS, groups: tuple[str, ...] = ("mission",)
) -> DataFrame:
    """Rows with a cutoff and role; a cutoff without both roles is left out."""
    spread = df.withColumn("cutoff_year", F.explode(F.array(*[F.lit(c) for c in cutoffs])))
    role = F.when(F.col("target_year") <= F.col("cutoff_year"), "train").otherwise("test")
    return _with_both_roles(spread.withColumn("role", role), [*groups, "cutoff_year"])


def temporal_inner(
    df: DataFrame,
    cutoffs: list[int] = OUTER_CUTOFFS,
    offsets: list[int] = INNER_OFFSETS,
    groups: tuple[str, ...] = ("mission",),
) -> DataFrame:
    """Expanding splits inside the training part of each outer cutoff."""
    pairs = [
        F.struct(F.lit(c).alias("cutoff_year"), F.lit(c - o).alias("inner_cutoff"))
        for c in cutoffs
        for o in offsets
    ]
    spread = df.select("*", F.inline(F.array(*pairs))).filter(F.col("target_year") <= F.col("cutoff_year"))
    role = F.when(F.col("target_year") <= F.col("inner_cutoff"), "train").otherwise("test")
    return _with_both_roles(spread.withColumn("role", role), [*groups, "cutoff_year", "inner_cutoff"])
