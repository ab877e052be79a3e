"""Key-level facts joined back to rows.

A count or first row per key is aggregated before the shuffle and joined back,
instead of a window over the key: a key that holds a third of the rows is then
combined map-side and its join partition can be split by adaptive execution."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def same(left: str, right: str, keys: list[str]) -> Column:
    condition = F.lit(True)
    for k in keys:
        condition = condition & F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}"))
    return condition


def join_facts(df: DataFrame, facts: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Left join of per-key facts; null keys match null keys."""
    keep = [F.col(f"f.{c}") for c in facts.columns if c not in keys]
    return df.alias("d").join(facts.alias("f"), same("d", "f", keys), how).select("d.*", *keep)


def with_count(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    return join_facts(df, df.groupBy(*keys).agg(F.count("*").alias(name)), keys)


def repeated_keys(df: DataFrame, keys: list[str], order: Column | None = None) -> DataFrame:
    """Keys held by more than one row, with the smallest order value of each."""
    first = F.min(order) if order is not None else F.lit(None).cast("int")
    facts = df.groupBy(*keys).agg(F.count("*").alias("copies"), first.alias("first_order"))
    return facts.filter("copies > 1")


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row with the smallest order values for each key."""
    rest = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct(*order)).alias("best")
    return df.groupBy(*keys).agg(best).select(*keys, "best.*").select(*df.columns)


def split_repeated(df: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows with a unique key, every copy of a repeated key)."""
    marked = join_facts(df, repeated_keys(df, keys).drop("first_order"), keys)
    unique = marked.filter(F.col("copies").isNull()).drop("copies")
    return unique, marked.filter(F.col("copies").isNotNull()).drop("copies")


def salted_join(
    left: DataFrame, right: DataFrame, keys: list[str], row: str, salts: int = 16, how: str = "left"
) -> DataFrame:
    """Equi-join of a skewed left side with a table that is unique per key.

    Rows of a hot key are spread by a hash of their `row` id over `salts`
    partitions; the unique side is repeated once per salt."""
    spread = left.withColumn("_salt", F.pmod(F.xxhash64(row), F.lit(salts)).cast("int"))
    repeated = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return spread.join(repeated, [*keys, "_salt"], how).drop("_salt")
