"""Positions in a global order, without sorting a table in one task."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.sources.writers import written


def with_position(df: DataFrame, by: str, name: str = "position") -> DataFrame:
    """Adds 0, 1, 2, ... in the order of column `by` (binary order of strings, null last).

    The rows are range-partitioned, sorted and stored; only one count a partition goes to
    the driver, so the positions don't depend on where the ranges were cut."""
    order = [F.col(by).isNull(), F.col(by)]
    low = (1 << 33) - 1
    sorted_rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    sorted_rows = sorted_rows.withColumn("_id", F.monotonically_increasing_id())
    stored = written(sorted_rows, "positions")
    part = F.shiftright("_id", 33)
    sizes = {r[0]: r[1] for r in stored.groupBy(part.alias("part")).count().collect()}
    before, total = [], 0
    for k in range(max(sizes, default=-1) + 1):
        before.append(total)
        total += sizes.get(k, 0)
    if not before:
        return stored.withColumn(name, F.lit(0).cast("bigint")).drop("_id")
    offset = F.element_at(F.array(*[F.lit(n).cast("bigint") for n in before]), (part + 1).cast("int"))
    return stored.withColumn(name, offset + F.col("_id").bitwiseAND(low)).drop("_id")
