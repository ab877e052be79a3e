"""Exact ranks, medians and orderings without sorting a whole group in one task.

A quantile is bracketed by a sketch; values outside the bracket collapse to one row per
gap and equal values to one row, so a few rows in ten thousand are left to sort. A full
ranking cuts the value range of each group into up to 4,096 cells; only the cells, never
the group, are sorted by a single task. Facts per group are counted before they are sent
to every task; a larger table of facts is joined by a shuffle instead.
"""

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.sources.writers import written

# Cells per group of a full ranking are the square of the fan-out.
RANK_FANOUT = 64
CELLS = 256  # of a column whose rows are ranked in place
SALTS = 64
SKETCH = 10_000
MARGINS = 15  # the widest one spans every row
BROADCAST_ROWS = 100_000


def _same_groups(left: str, right: str, groups: list[str]) -> Column:
    condition = F.lit(True)
    for g in groups:
        condition = condition & F.col(f"{left}.{g}").eqNullSafe(F.col(f"{right}.{g}"))
    return condition


def attach(df: DataFrame, facts: DataFrame, groups: list[str], how: str = "left") -> DataFrame:
    """Join one row of facts per group to the rows of that group; null groups match null groups."""
    keep = [F.col(f"f.{c}") for c in facts.columns if c not in groups]
    facts = written(facts, "facts")
    small = facts.count() <= BROADCAST_ROWS
    right = F.broadcast(facts.alias("f")) if small else facts.alias("f")
    return df.alias("d").join(right, _same_groups("d", "f", groups), how).select("d.*", *keep)


def value_counts(df: DataFrame, groups: list[str], value: str) -> DataFrame:
    known = df.filter(F.col(value).isNotNull() & ~F.isnan(value))
    return known.groupBy(*groups, F.col(value).cast("double").alias("v")).agg(F.count("*").alias("n"))


def _with_cells(counts: DataFrame, groups: list[str], fanout: int) -> DataFrame:
    cells = fanout * fanout
    shares = ",".join(str(i / cells) for i in range(1, cells))
    # One literal, split while planning, instead of thousands of expression nodes.
    cuts = F.expr(f"percentile_approx(v, cast(split('{shares}', ',') as array<double>), {10 * cells})")
    grid = counts.groupBy(*groups).agg(cuts.alias("grid"))
    coarse = F.expr(f"size(filter(sequence(1, {fanout - 1}), i -> grid[i * {fanout} - 1] < v))")
    fine = F.expr(
        f"coarse * {fanout} + size(filter(slice(grid, coarse * {fanout} + 1, {fanout - 1}), g -> g < v))"
    )
    return (
        attach(counts, grid, groups, "inner")
        .withColumn("coarse", coarse)
        .withColumn("cell", fine)
        .drop("grid", "coarse")
    )


def _cell_offsets(celled: DataFrame, groups: list[str]) -> DataFrame:
    totals = celled.groupBy(*groups, "cell").agg(F.sum("n").alias("cell_rows"))
    upto = Window.partitionBy(*groups).orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*groups)
    return totals.withColumn("offset", F.sum("cell_rows").over(upto) - F.col("cell_rows")).withColumn(
        "group_rows", F.sum("cell_rows").over(whole)
    )


def _rows_before(celled: DataFrame, groups: list[str]) -> DataFrame:
    inside = Window.partitionBy(*groups, "cell").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    return celled.withColumn("before", F.col("offset") + F.sum("n").over(inside) - F.col("n"))


def average_ranks(df: DataFrame, groups: list[str], value: str, rank: str) -> DataFrame:
    """One row per distinct value with its average rank inside the group."""
    celled = _with_cells(value_counts(df, groups, value), groups, RANK_FANOUT)
    placed = _rows_before(attach(celled, _cell_offsets(celled, groups), [*groups, "cell"]), groups)
    average = F.col("before") + (F.col("n") + 1) / F.lit(2.0)
    return placed.select(*groups, F.col("v").alias(value), average.alias(rank))


def _splits(cuts: list[float]) -> list[float]:
    """Ascending cell bounds; a value that takes several quantiles gets a cell of its own."""
    known = [c for c in cuts if math.isfinite(c)]
    after = {math.nextafter(a, math.inf) for a, b in zip(known, known[1:]) if a == b}
    inner = sorted(c for c in {*known, *after} if math.isfinite(c))
    return [-math.inf, *(inner or [0.0]), math.inf]


def with_cells(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Adds the cell of each column's value, named by `columns`; cells ascend with the values.

    The cuts are quantiles of all rows: they only share out the work, so any will do. The driver
    holds `CELLS` of them a column."""
    shares = [i / CELLS for i in range(1, CELLS)]
    found = df.agg(*[F.percentile_approx(c, shares, 10 * CELLS).alias(cell) for c, cell in columns.items()]).first()
    splits = [_splits(found[cell] or []) for cell in columns.values()]
    bucketizer = Bucketizer(
        inputCols=list(columns), outputCols=list(columns.values()), splitsArray=splits, handleInvalid="keep"
    )
    return bucketizer.transform(df).withColumns({cell: F.col(cell).cast("int") for cell in columns.values()})


def cell_starts(df: DataFrame, groups: list[str], cell: str, value: str) -> DataFrame:
    """(group, cell, base, single): the rows of the group before the cell, or the one rank of a cell of equal values."""
    v = F.col(value)
    totals = df.groupBy(*groups, cell).agg(F.count("*").alias("n"), (F.min(v) == F.max(v)).alias("single"))
    before = F.sum("n").over(Window.partitionBy(*groups).orderBy(cell).rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    base = before + F.when(F.col("single"), (F.col("n") + 1) / F.lit(2.0)).otherwise(0.0)
    return totals.select(*groups, cell, base.alias("base"), "single")


def salt_of(single: Column, *row: str) -> Column:
    """Part of a cell: rows of equal values, whose rank is known, go to any; others stay together."""
    return F.when(single, F.pmod(F.xxhash64(*row), F.lit(SALTS)).cast("int")).otherwise(-1)


def _near(known: DataFrame, groups: list[str], shares: list[float]) -> DataFrame:
    """(group, value, count, group_rows) with the rows far from every quantile folded into their neighbours.

    The sketch's rank error is below one in `SKETCH`; a bracket is at least twice as wide
    on each side, and wide enough for the two rows next to the place in a small group, so
    it holds the wanted rows and both its ends. What lies in the gap above a bracket counts
    with the bracket's upper end, which leaves all ranks up to that end as they are."""
    margins = [2 / SKETCH * 2**j for j in range(MARGINS)]
    cuts = [min(max(s + side * m, 0.0), 1.0) for s in shares for m in margins for side in (-1, 1)]
    sketch = known.groupBy(*groups).agg(
        F.count("*").alias("group_rows"), F.percentile_approx("v", cuts, SKETCH).alias("ends")
    )
    margin = F.ceil(F.log2(1 + SKETCH / F.col("group_rows"))).cast("int")  # of 2 / SKETCH + 2 / rows or more
    ends = [F.get("ends", F.lit(2 * MARGINS * i) + 2 * margin + side) for i in range(len(shares)) for side in (0, 1)]
    sketch = sketch.select(*groups, "group_rows", F.array(*ends).alias("bracket"))
    v, bracket = F.col("v"), F.col("bracket")
    folded = v
    for i in range(len(shares)):
        above = v > bracket[2 * i + 1]
        if i + 1 < len(shares):
            above &= v < bracket[2 * i + 2]
        folded = F.when(above, bracket[2 * i + 1]).otherwise(folded)
    folded = F.when(v < bracket[0], float("-inf")).otherwise(folded)
    near = attach(known, sketch, groups, "inner").withColumn("v", folded)
    return near.groupBy(*groups, "v").agg(F.count("*").alias("n"), F.max("group_rows").alias("group_rows"))


def quantiles(df: DataFrame, groups: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Exact interpolated quantiles of each group, one column a share."""
    known = df.select(*groups, F.col(value).cast("double").alias("v")).filter(F.col("v").isNotNull() & ~F.isnan("v"))
    upto = Window.partitionBy(*groups).orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    near = _near(known, groups, sorted(shares.values()))
    placed = near.withColumn("before", F.sum("n").over(upto) - F.col("n"))

    def at(place: Column) -> Column:
        """Value of the row at a place, counted from 0."""
        return F.max(F.when((F.col("before") <= place) & (F.col("before") + F.col("n") > place), F.col("v")))

    columns = []
    for name, share in shares.items():
        target = (F.col("group_rows") - 1) * F.lit(share)
        part = F.max(target - F.floor(target))
        low, high = at(F.floor(target)), at(F.ceil(target))
        columns.append((low + (high - low) * part).alias(name))
    return placed.groupBy(*groups).agg(*columns)


def quantile(df: DataFrame, groups: list[str], value: str, share: float, out: str) -> DataFrame:
    """Exact interpolated quantile of each group."""
    return quantiles(df, groups, value, {out: share})


def numbered_by_hash(df: DataFrame, groups: list[str], label: Column, prefix: int = 3) -> DataFrame:
    """Number rows 1..n per group in md5 order of `label`; adds `position`, `group_rows`.

    Rows are placed by hash prefix: prefix counts give the offset of each prefix,
    and only rows that share a prefix are sorted together."""
    hashed = df.withColumn("digest", F.md5(label)).withColumn("prefix", F.substring("digest", 1, prefix))
    totals = hashed.groupBy(*groups, "prefix").agg(F.count("*").alias("prefix_rows"))
    upto = Window.partitionBy(*groups).orderBy("prefix").rowsBetween(Window.unboundedPreceding, 0)
    offsets = totals.withColumn("offset", F.sum("prefix_rows").over(upto) - F.col("prefix_rows")).withColumn(
        "group_rows", F.sum("prefix_rows").over(Window.partitionBy(*groups))
    )
    inside = Window.partitionBy(*groups, "prefix").orderBy("digest")
    return (
        attach(hashed, offsets, [*groups, "prefix"], "inner")
        .withColumn("position", F.col("offset") + F.row_number().over(inside))
        .drop("digest", "prefix", "prefix_rows", "offset")
    )


def tile(position: Column, rows: Column, k: int) -> Column:
    """1-based tile of a position when n rows are dealt into k near-equal tiles."""
    size = F.floor(rows / k)
    extra = rows - size * k
    large = extra * (size + 1)
    return F.when(position <= large, F.ceil(position / (size + 1))).otherwise(
        extra + F.ceil(F.try_divide(position - large, size))
    )


def rank_of(value: Column, groups: list[Column], descending: bool = False) -> Column:
    """Average rank inside a small table; null values get no rank."""
    order = value.desc_nulls_last() if descending else value.asc_nulls_last()
    ties = F.count(F.lit(1)).over(Window.partitionBy(*groups, value)) - 1
    plain = F.rank().over(Window.partitionBy(*groups).orderBy(order))
    return F.when(value.isNotNull(), plain + ties / F.lit(2.0))
