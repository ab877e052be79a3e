"""Connected components of an edge table, by alternating large-star and small-star rounds.

Each round points every neighbour at its group's smallest node; the groups are joins on
per-node minima (combined map-side), never collected lists, so a node with very many
neighbours only makes a join partition that adaptive execution can split. Rounds end
when the edge table no longer changes; each one is a checkpoint in the shared folder."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b), both bigint; root is the smallest node reachable."""
    now = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct().checkpoint()
    signature = _signature(now)
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = small.union(low.select("u", F.col("m").alias("v"))).distinct().checkpoint()
        before, signature = signature, _signature(now)
        if signature == before:
            break
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots.select("node", F.col("node").alias("root")))
