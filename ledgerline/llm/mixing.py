"""Mixing sources to target weights by capped water-filling.

Every source gets a share of all words in proportion to its weight. A source whose
share would exceed MAX_EPOCHS times its size is clamped there and the excess goes to
the others in proportion to their weights, again and again until none is above. A
target of 2.3 times the size then takes every document twice and a seeded selection
of documents that holds 0.3 times the words a third time.

The selection orders a source's documents by a seeded digest of the id and takes them
while at least half of the next one still fits. To find that place, sizes are summed by
source and digest prefix, the running sum goes over 256 short prefixes, then over the 256
prefixes below the one that straddles the place, and only the documents of the prefix
that straddles it there are ordered one by one; no source is sorted as a whole. All arithmetic up to the last division is on integers,
so reruns agree.

Cases: a null text has size 0; a null source is a source of its own, the last one; a
source of size 0 has target 0; equal ids are ordered by size and the text's digest; without rows
there is nothing to do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.llm.ranked import with_position
from ledgerline.llm.rows import table
from ledgerline.sources.writers import written

WEIGHTS = (5, 2, 1)  # by position of the source, repeating
MAX_EPOCHS = 3
SEED = "mix-1"
PREFIX_HEX = 4  # hex digits of a digest prefix
SHORT = 256  # prefixes that begin alike
BROADCAST_SOURCES = 100_000  # up to so many sources (some 10 MB) their targets are sent to every task
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(WORD)), F.lit(0)).cast("bigint")


def digest(seed: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))


def water_filled(sources: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Adds `target` to one row per source with `size` and integer `weight`.

    One aggregate per round; a source once clamped stays so, because the level only rises."""
    whole = sources.agg(F.sum("size"), F.sum("weight")).first()
    total, left, weights = whole[0] or 0, whole[0] or 0, whole[1] or 0

    def wide(x: Column) -> Column:
        return x.cast("decimal(18,0)")

    def clamped() -> Column:
        return wide(F.col("weight")) * wide(F.lit(left)) > wide(F.col("size") * max_epochs) * wide(F.lit(weights))

    while weights:
        row = sources.agg(
            F.sum(F.when(clamped(), F.col("size"))).alias("size"), F.sum(F.when(~clamped(), F.col("weight"))).alias("weight")
        ).first()
        now = total - max_epochs * (row["size"] or 0), row["weight"] or 0
        if now == (left, weights) or not now[1]:
            break
        left, weights = now
    level = (wide(F.col("weight")) * wide(F.lit(left))).cast("double") / F.lit(float(weights or 1))
    return sources.withColumn("target", F.when(clamped(), (F.col("size") * max_epochs).cast("double")).otherwise(level))


def _cut(plan: DataFrame, sums: DataFrame) -> DataFrame:
    """Adds `_cut`, the first prefix of each source whose words don't all fit into `_rest`,
    and the words `_taken` before it; `sums` has sizes by `_key` and `_prefix`."""
    upto = Window.partitionBy("_key").orderBy("_prefix")
    names = [c for c in plan.columns if c != "_taken"]
    placed = sums.withColumn("upto", F.sum("size").over(upto)).select(F.col("_key").alias("_of"), "_prefix", "upto")
    joined = placed.join(plan.select("_key", "_rest", "_taken"), F.col("_of").eqNullSafe(F.col("_key")))
    inside = F.col("_taken") + F.col("upto") <= F.col("_rest")
    cut = joined.groupBy(F.col("_of")).agg(
        F.min(F.when(~inside, F.col("_prefix"))).alias("_cut"), F.max(F.when(inside, F.col("upto"))).alias("_more")
    )
    out = plan.join(cut, F.col("_of").eqNullSafe(F.col("_key")), "left")
    return out.select(*names, (F.col("_taken") + F.coalesce("_more", F.lit(0))).alias("_taken"), "_cut")


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """Every row with `size`, its source's `source_size` and `target`, and `copies`, how often the mix has it."""
    own = ["size", "source_size", "target", "copies"]
    rows = docs.drop(*own).withColumns({"size": word_count(), "_digest": digest(seed), "_source": F.col("source")})
    rows = rows.withColumn("_prefix", F.conv(F.substring("_digest", 1, PREFIX_HEX), 16, 10).cast("int"))
    rows = rows.withColumn("_text", F.md5(F.col("text").cast("string")))
    small = written(rows.groupBy("_source", "_prefix").agg(F.sum("size").alias("size")), "mix-prefixes")
    sources = with_position(small.groupBy("_source").agg(F.sum("size").alias("size")), "_source")
    cycle = F.array(*[F.lit(w) for w in weights])
    sources = sources.withColumn("weight", F.element_at(cycle, (F.col("position") % len(weights) + 1).cast("int")))
    plan = water_filled(sources, max_epochs).withColumn("_whole", F.floor(F.try_divide("target", F.col("size").cast("double"))))
    plan = plan.withColumn("_whole", F.coalesce(F.col("_whole"), F.lit(0)))
    plan = plan.withColumn("_rest", F.col("target") - F.col("_whole") * F.col("size"))
    plan = plan.select(F.col("_source").alias("_key"), F.col("size").alias("source_size"), "target", "_whole", "_rest")

    same = F.col("_source").eqNullSafe(F.col("_key"))
    short = small.withColumn("_prefix", F.floor(F.col("_prefix") / SHORT)).groupBy("_source", "_prefix").agg(F.sum("size").alias("size"))
    plan = _cut(plan.withColumn("_taken", F.lit(0).cast("bigint")), short.join(plan.select("_key"), same))
    below = small.join(plan.select("_key", "_cut"), same).filter(F.floor(F.col("_prefix") / SHORT) == F.col("_cut"))
    plan = _cut(plan.drop("_cut"), below.drop("_cut"))
    plan = written(plan, "mix-plan")
    placed = rows.join(F.broadcast(plan) if sources.count() <= BROADCAST_SOURCES else plan, same)
    clear = F.col("_cut").isNull() | (F.col("_prefix") != F.col("_cut"))
    early = F.col("_cut").isNull() | (F.col("_prefix") < F.col("_cut"))
    sure = placed.filter(clear).withColumn("copies", F.col("_whole") + early.cast("bigint"))
    order = Window.partitionBy("_source").orderBy("_digest", "size", "_text").rowsBetween(Window.unboundedPreceding, 0)
    edge = placed.filter(~clear).withColumn("_sum", F.sum("size").over(order) + F.col("_taken"))
    edge = edge.withColumn("copies", F.col("_whole") + (2 * F.col("_sum") - F.col("size") <= 2 * F.col("_rest")).cast("bigint"))
    names = [*(c for c in docs.columns if c not in own), *own]
    return sure.select(*names).unionByName(edge.select(*names))


def repeated(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row as often as it is taken, numbered from 1 in `copy`."""
    rows = mixed(docs, **options).filter("copies > 0")
    names = [c for c in docs.columns if c != "copy"]
    return rows.select(*names, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixed(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


OP4_SQL = r"""
with recursive sized as (
  select doc_id, source, md5('mix-1:' || coalesce(doc_id::varchar, 'null')) as digest, text,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size
  from documents
), sources as (
  select source, size, [5, 2, 1][1 + (row_number() over (order by source nulls last) - 1) % 3] as weight
  from (select source, sum(size)::bigint as size from sized group by source)
), level as (
  select 0 as round, sum(size)::hugeint as remaining, sum(weight)::hugeint as weights from sources
  union all
  select round + 1, remaining_next, weights_next from (
    select round, remaining, weights,
      (sum(size) - 3 * coalesce(sum(size) filter (weight * remaining > 3 * size * weights), 0))::hugeint as remaining_next,
      (sum(weight) filter (weight * remaining <= 3 * size * weights))::hugeint as weights_next
    from level, sources group by round, remaining, weights
  ) where weights_next is not null and (remaining_next, weights_next) <> (remaining, weights)
), targets as (
  select source, size as source_size,
    case when weight * remaining > 3 * size * weights then (3 * size)::double
      else (weight * remaining)::double / weights::double end as target
  from sources, (select remaining, weights from level order by round desc limit 1)
), planned as (
  select *, case when source_size = 0 then 0 else floor(target / source_size) end as epochs from targets
), summed as (
  select s.*, p.source_size, p.target, p.epochs, p.target - p.epochs * p.source_size as rest,
    sum(s.size) over (partition by s.source order by s.digest, s.size, md5(s.text) rows unbounded preceding) as running
  from sized s join planned p on s.source is not distinct from p.source
)
select doc_id, size, source_size, target,
  (size * (epochs + case when 2 * running - size <= 2 * rest then 1 else 0 end))::bigint as taken
from summed
"""
