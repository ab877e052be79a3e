"""Filter interaction audit: what each filter removes in every order, by sorted posting lists.

Each document gets the set of filters that it fails. Documents and labels are dealt to
ranges of RANGE ids; a task reads a range in order of part and id and keeps, for each part,
the ascending list of failing places of every filter. The union of every set of filters and
what each further filter adds to it are merged by galloping: the shorter list looks its
entries up in the longer one by steps that double from where they are expected. Only list
sizes leave the task: one sum for each part, set of earlier filters and next filter.

The copies of a text are found by two 64-bit hashes of it; texts that more than one in HEAVY
rows have (at most HEAVY) are sent to every task, the others are joined, so no group of
copies meets in one task. Equal ids of a part that fail the same filters are one place with
a weight.

Cases: a null text is empty; a null lang is the part ''; a null id is in no label row, isn't
larger than any id and makes no other text a copy; rows of equal id are separate documents
(not copies of each other); an id with several label rows counts for a label if one has it;
an empty table gives no rows; a very long text is one row of flags; further columns are not
read."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.rows import gathered, table
from ledgerline.sources.writers import written

FILTERS = "ABCDE"
RANGE = 4096  # ids
CHUNK = 1 << 16  # places of a part that are merged at once
PARTS = 256  # parts whose sums a task holds before it passes them on
HEAVY = 10_000
MIN_WORDS, MIN_DISTINCT, MAX_UPPER = 200, 50, 3  # words, per cent of the words, per cent of the characters
SETS = 1 << len(FILTERS)
GOOD, TOXIC = 1, 2
LABELS_KIND, DOCUMENTS_KIND = 0, 1
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
CELLS = [(earlier, f) for earlier in range(SETS) for f in range(len(FILTERS)) if not earlier >> f & 1]


def own_failures() -> dict[str, Column]:
    """Filters A to D over `words` (their array) and `text`."""
    n, upper = F.size("words"), F.regexp_count("text", F.lit("[A-Z]"))
    return {
        "A": n < MIN_WORDS,
        "B": 100 * F.size(F.array_distinct("words")) < MIN_DISTINCT * n,
        "C": 100 * upper > MAX_UPPER * F.char_length("text"),
        "D": F.col("text").rlike(r"[#$%&*|]"),
    }


def flagged(docs: DataFrame) -> DataFrame:
    """Stored (doc_id, part, failed, low, high): bits of the filters A to D, two hashes of the text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    part = F.coalesce(F.col("lang").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), part.alias("part"), text.alias("text"))
    rows = rows.withColumn("words", F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), ""))
    bits = [F.when(failed, 1 << FILTERS.index(f)).otherwise(0) for f, failed in own_failures().items()]
    failed = sum(bits[1:], bits[0])
    hashes = [F.xxhash64("text").alias("low"), F.xxhash64(F.lit(1), "text").alias("high")]
    return written(rows.select("doc_id", "part", failed.cast("int").alias("failed"), *hashes), "filters")


def with_copies(rows: DataFrame) -> DataFrame:
    """(doc_id, part, failed) with the bit of filter E."""
    bit = 1 << FILTERS.index("E")
    firsts = rows.groupBy("low", "high").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"))
    firsts = written(firsts.filter("copies > 1"), "copies")
    total = rows.count()
    hot = F.broadcast(firsts.filter(F.col("copies") * HEAVY > total))
    light = firsts.filter(F.col("copies") * HEAVY <= total)
    keys = ["low", "high"]
    joined = rows.join(hot, keys).unionByName(rows.join(hot.select(*keys), keys, "left_anti").join(light, keys, "left"), allowMissingColumns=True)
    copy = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    return joined.select("doc_id", "part", (F.col("failed") + F.when(copy, bit).otherwise(0)).alias("failed"))


def dealt(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """(range, kind, part, id, bits, n) of documents and labels; the rows of a range lie in order in one task."""
    marks = labels.select(F.col("doc_id").cast("bigint").alias("id"), F.col("quality") == 1, F.col("toxic") == 1).toDF("id", "good", "toxic")
    marks = marks.filter("id is not null").groupBy("id").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic"))
    bits = F.when(F.col("good"), GOOD).otherwise(0) + F.when(F.col("toxic"), TOXIC).otherwise(0)
    marks = marks.select(F.lit(LABELS_KIND).alias("kind"), F.lit("").alias("part"), "id", bits.alias("bits"), F.lit(1).cast("bigint").alias("n"))
    docs = rows.groupBy("part", F.col("doc_id").alias("id"), F.col("failed").alias("bits")).agg(F.count("*").alias("n"))
    both = marks.unionByName(docs.withColumn("kind", F.lit(DOCUMENTS_KIND)))
    both = both.withColumn("range", F.floor(F.col("id") / RANGE)).repartition("range")
    return both.sortWithinPartitions("range", "kind", "part", "id").select("range", "kind", "part", "id", "bits", "n")


def gallop(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Place of the first entry of `among` that isn't below each value, both ascending."""
    n = len(among)
    place = np.arange(len(values)) * n // max(1, len(values))  # where evenly spread values would be
    low, high = place.copy(), place.copy()  # the wanted place lies in low .. high
    up, step = np.flatnonzero(among[place] < values) if n else np.zeros(0, np.int64), 1
    down = np.setdiff1d(np.arange(len(values)), up, assume_unique=True) if n else up
    while len(up):
        low[up], high[up] = high[up] + 1, np.minimum(high[up] + step, n)
        up = up[(high[up] < n) & (among[np.minimum(high[up], n - 1)] < values[up])]
        step *= 2
    step = 1
    while len(down):
        high[down], low[down] = low[down], np.maximum(low[down] - step, 0)
        down = down[(low[down] > 0) & (among[np.maximum(low[down] - 1, 0)] >= values[down])]
        step *= 2
    low = np.minimum(low, high)
    while len(left := np.flatnonzero(low < high)):
        middle = (low[left] + high[left]) // 2
        below = among[middle] < values[left]
        low[left[below]], high[left[~below]] = middle[below] + 1, middle[~below]
    return low


def holds(among: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Marks the `values` that are in `among`; both ascend, values may repeat."""
    if not len(among) or not len(values):
        return np.zeros(len(values), bool)
    if len(values) <= len(among):
        place = gallop(values, among)
        return (place < len(among)) & (among[np.minimum(place, len(among) - 1)] == values)
    marks = np.zeros(len(values) + 1, np.int64)
    first, after = gallop(among, values), gallop(among + 1, values)
    np.add.at(marks, first, 1)
    np.add.at(marks, after, -1)
    return np.cumsum(marks)[:-1] > 0


def union(lists: list[np.ndarray]) -> np.ndarray:
    """Of ascending lists without repeats: the longest one takes in the others' new entries."""
    lists = sorted(lists, key=len)
    out = lists[-1]
    for other in reversed(lists[:-1]):
        new = other[~holds(out, other)]
        out = np.insert(out, gallop(new, out), new) if len(new) else out
    return out


def difference(values: np.ndarray, gone: np.ndarray) -> np.ndarray:
    return values[~holds(gone, values)]


def audit(ids: np.ndarray, bits: np.ndarray, n: np.ndarray, good: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """One row (kept, removed, redundant, unique, good, toxic) a cell of CELLS, for places in order of id."""
    places = [np.flatnonzero(bits >> f & 1) for f in range(len(FILTERS))]
    unions = [union([p for f, p in enumerate(places) if among >> f & 1]) if among else np.zeros(0, np.int64) for among in range(SETS)]
    is_good, is_toxic = (np.where(holds(label, ids), n, 0) for label in (good, toxic))
    out, whole = np.zeros((len(CELLS), 6), np.int64), n.sum()
    for row, (earlier, f) in zip(out, CELLS, strict=True):
        removed = difference(places[f], unions[earlier])
        others = SETS - 1 - (1 << f)
        gone = n[removed].sum()
        unique = gone if earlier == others else n[difference(places[f], unions[others])].sum()
        row[:] = whole - n[unions[earlier | 1 << f]].sum(), gone, n[places[f]].sum() - gone, unique, is_good[removed].sum(), is_toxic[removed].sum()
    return out


def sums_of_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Sums by part over the ranges of a partition; holds one range's labels and one part's places at a time."""
    sums: dict[str, np.ndarray] = {}
    now, good, toxic = None, [], []
    held: list[pa.RecordBatch] = []

    def flush() -> None:
        if held:
            ids, bits, n = (np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in held]) for c in ("id", "bits", "n"))
            part = held[0].column("part")[0].as_py()
            lists = [np.concatenate([np.zeros(0, np.int64), *x]) for x in (good, toxic)]
            known = np.where(np.isnan(ids), -1, ids).astype(np.int64) if ids.dtype.kind == "f" else ids
            if now[0] is None:
                lists = [x[:0] for x in lists]
            sums[part] = sums.get(part, 0) + audit(known, bits, n, *lists)
            held.clear()

    def passed_on() -> Iterator[dict]:
        for part, cells in sums.items():
            yield {"part": [part] * len(CELLS), "cell": np.arange(len(CELLS), dtype=np.int32), **dict(zip(COUNTS, cells.T, strict=True))}
        sums.clear()

    for batch in batches:
        keys = batch.select(["range", "kind", "part"])
        new = np.zeros(batch.num_rows, bool)
        for c in range(3):
            codes = keys.column(c).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            new[1:] |= codes[1:] != codes[:-1]
        starts = [0, *np.flatnonzero(new).tolist(), batch.num_rows] if batch.num_rows else []
        for a, b in zip(starts, starts[1:]):
            piece = batch.slice(a, b - a)
            key = tuple(c[0].as_py() for c in piece.columns[:3])
            if now is not None and key != now:
                flush()
                if key[0] != now[0]:
                    good, toxic = [], []
                if len(sums) >= PARTS:
                    yield from passed_on()
            now = key
            if key[1] == LABELS_KIND:
                ids, bits = (piece.column(c).to_numpy(zero_copy_only=False) for c in ("id", "bits"))
                good.append(ids[bits & GOOD > 0].astype(np.int64))
                toxic.append(ids[bits & TOXIC > 0].astype(np.int64))
                continue
            held.append(piece)
            if sum(p.num_rows for p in held) >= CHUNK:
                flush()
    flush()
    yield from passed_on()


def interactions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, earlier, filter, counts): what each filter removes after each set of earlier ones."""
    fields = "part string, cell int, " + ", ".join(f"{c} bigint" for c in COUNTS)
    found = gathered(dealt(with_copies(flagged(docs)), labels), fields, sums_of_ranges)
    found = found.groupBy("part", "cell").agg(*[F.sum(c).alias(c) for c in COUNTS])
    cells = docs.sparkSession.createDataFrame([(i, e, FILTERS[f]) for i, (e, f) in enumerate(CELLS)], "cell int, earlier int, filter string")
    return found.join(F.broadcast(cells), "cell").drop("cell")


def orders_report(cells: DataFrame) -> DataFrame:
    """A row for each part, order of the filters and step; `shapley` is a filter's removals over all orders."""
    rows = []
    for order in permutations(range(len(FILTERS))):
        name = "".join(FILTERS[f] for f in order)
        rows += [(name, step + 1, sum(1 << g for g in order[:step]), FILTERS[f]) for step, f in enumerate(order)]
    steps = cells.sparkSession.createDataFrame(rows, "filter_order string, step int, earlier int, filter string")
    last = len(FILTERS) - 1
    orders = F.element_at(
        F.array(*[F.lit(factorial(k) * factorial(last - k)) for k in range(last + 1)]), F.bit_count("earlier") + 1
    )
    cells = written(cells, "filter-cells")
    shares = cells.groupBy("part", "filter").agg(F.sum(F.col("removed") * orders).alias("shapley"))
    out = cells.join(F.broadcast(steps), ["earlier", "filter"]).join(shares, ["part", "filter"])
    return out.select("part", "filter_order", "step", *COUNTS, "shapley")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return orders_report(interactions(docs, table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")))


OP12_SQL = r"""
with texts as (
  select doc_id, coalesce(lang, '') as part, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents
), marked as (
  select doc_id, part,
    (len(words) < 200)::int + 2 * (100 * len(list_distinct(words)) < 50 * len(words))::int
    + 4 * (100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * len(text))::int + 8 * regexp_matches(text, '[#$%&*|]')::int
    + 16 * coalesce(doc_id > min(doc_id) over (partition by text), false)::int as failed
  from texts
), known as (
  select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as toxic from labels group by doc_id
), tally as (
  select part, failed, count(*) as n, coalesce(sum(good), 0) as good, coalesce(sum(toxic), 0) as toxic
  from marked left join known using (doc_id) group by part, failed
), letters as (
  select unnest(['A', 'B', 'C', 'D', 'E']) as letter, unnest([1, 2, 4, 8, 16]) as own
), orders as (
  select a.letter || b.letter || c.letter || d.letter || e.letter as filter_order
  from letters a, letters b, letters c, letters d, letters e where a.own + b.own + c.own + d.own + e.own = 31
    and len(list_distinct([a.own, b.own, c.own, d.own, e.own])) = 5
), steps as (
  select filter_order, step::int as step, l.own, l.letter,
    (select coalesce(sum(p.own), 0) from letters p where instr(filter_order, p.letter) < step)::int as earlier
  from orders, range(1, 6) r(step) join letters l on instr(filter_order, l.letter) = step
), counted as (
  select part, filter_order, step, letter,
    sum(case when failed & (earlier | own) = 0 then n else 0 end) as kept,
    sum(case when failed & earlier = 0 and failed & own > 0 then n else 0 end) as removed,
    sum(case when failed & earlier > 0 and failed & own > 0 then n else 0 end) as redundant,
    sum(case when failed = own then n else 0 end) as unique_fails,
    sum(case when failed & earlier = 0 and failed & own > 0 then good else 0 end) as good_lost,
    sum(case when failed & earlier = 0 and failed & own > 0 then toxic else 0 end) as toxic_lost
  from steps, tally group by part, filter_order, step, letter
)
select part, filter_order, step, kept::bigint as kept, removed::bigint as removed, redundant::bigint as redundant,
  unique_fails::bigint as unique_fails, good_lost::bigint as good_lost, toxic_lost::bigint as toxic_lost,
  sum(removed) over (partition by part, letter)::bigint as shapley
from counted
"""
