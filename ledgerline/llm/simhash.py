"""SimHash near-dedup: 64-bit fingerprints of word shingles, linked by bit-sliced comparison.

Equal fingerprints are one node with their smallest id. Two nodes that differ in at most
RADIUS bits agree on all but RADIUS of BLOCKS bit blocks, so every node goes to one
bucket for each choice of the blocks that agree; a bucket's nodes agree on all but 16
bits, hence it can't hold more than 65,536 nodes whatever the data. Buckets are sorted,
not collected: a task reads them in order and compares runs of equal keys.

Comparison is bit-sliced: bit plane p holds bit p of 64 consecutive nodes a word, and
comparing every node with the one s places on is an exclusive or of each plane with
itself shifted by s. Differences are added up for all nodes at once in three carry-save
counter planes and an overflow plane, and words are abandoned as soon as all their nodes
exceed the radius or their bucket's nodes are all linked. A task sends a spanning forest
of each bucket's links, never all pairs; links between different buckets meet in the
connected components.

near_groups() serves near copies of any kind: several fingerprints of five-word shingles and a
wider radius, compared in the same way. Its buckets agree on 27 bits, so they hold the near
copies of a text and by chance one node in 134 million.

Cases: texts without words have fingerprint 0 and are linked like any other; null ids
never are the smallest unless a group has no other; equal rows are copies."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.llm.components import components
from ledgerline.llm.rows import TEXT, annotate, gathered, quoted, table
from ledgerline.llm.textwords import NOT_SPACE, mix, window_keys, window_starts, words_of
from ledgerline.sources.writers import written

SHINGLE = 3
SEED = 42
RADIUS = 2
BLOCKS = 8
#: Of near copies in general: five-word shingles, four fingerprints, 4 bits of any of them.
NEAR_SHINGLE = 5
NEAR_RADIUS = 4
NEAR_BLOCKS = 7
NEAR_PRINTS = 4
CHUNK = 1 << 18  # nodes compared at once, and the rest of the last bucket
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprints(texts: pa.Array, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """uint64 fingerprint of each text; a bit is set if over half the shingles' hashes have it."""
    words = words_of(texts, NOT_SPACE, lower=True)
    body = words.data[:-8]
    inside = NOT_SPACE[body]
    after = np.zeros(len(body), dtype=bool)
    after[1:] = ~inside[1:] & inside[:-1]
    kept = inside | after
    place = np.concatenate([[0], np.cumsum(kept)])
    plain = np.where(after, 0x20, body)[kept].astype(np.uint8).tobytes()  # words with one space after each
    counts = np.maximum(words.counts - (shingle - 1), words.counts > 0)
    first = np.concatenate([[0], np.cumsum(counts)])
    row = np.repeat(np.arange(len(counts)), counts)
    at = np.arange(first[-1]) - first[:-1][row] + words.first[:-1][row]
    last = np.minimum(at + shingle, words.first[1:][row]) - 1
    start, end = place[words.start[at]], place[words.end[last] - 1] + 1 if len(at) else at
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(plain[a:b], seed) for a, b in zip(start.tolist(), end.tolist(), strict=True)), np.uint64, len(at))
    out = np.zeros(len(counts), np.uint64)
    some = np.flatnonzero(counts)
    if len(some):
        for bit in range(64):
            set_ = np.add.reduceat(((hashes >> np.uint64(bit)) & np.uint64(1)).astype(np.int64), first[some])
            out[some] |= (2 * set_ > counts[some]).astype(np.uint64) << np.uint64(bit)
    return out


def near_fingerprints(texts: pa.Array, shingle: int = NEAR_SHINGLE, prints: int = NEAR_PRINTS) -> list[np.ndarray]:
    """Fingerprints whose distance follows the share of common shingles: bit j of print k is a bit of the
    smallest of the text's shingle hashes under a hash function of its own, so two texts differ in each
    bit with half the probability that a shingle of either is not one of both. 0 for a text without words."""
    words = words_of(texts, NOT_SPACE, lower=True)
    keys, counts = words.keys(), words.counts
    some = np.flatnonzero(counts)
    out = [np.zeros(len(counts), np.uint64) for _ in range(prints)]
    if not len(some):
        return out
    padded = np.concatenate([keys, np.zeros(shingle - 1, np.uint64)])
    hashes = window_keys(padded, shingle)
    whole = window_starts(words.first, shingle)
    for i in some[counts[some] < shingle].tolist():  # a shorter text is one shingle, that of all its words
        at = words.first[i]
        own = np.concatenate([keys[at : words.first[i + 1]], np.zeros(shingle - counts[i], np.uint64)])
        hashes[at], whole[at] = window_keys(own, shingle)[0], True
    hashes = hashes[whole]
    first = np.concatenate([[0], np.cumsum(whole)])[words.first[some]]
    numbers = mix(np.arange(1, 128 * prints + 1, dtype=np.uint64))
    for k in range(prints):
        for bit in range(64):
            turn, factor = numbers[2 * (64 * k + bit)], numbers[2 * (64 * k + bit) + 1] | np.uint64(1)
            smallest = np.minimum.reduceat((hashes ^ turn) * factor, first)
            out[k][some] |= ((smallest >> np.uint64(5)) & np.uint64(1)) << np.uint64(bit)
    return out


def bit_planes(nodes: np.ndarray) -> np.ndarray:
    """uint64[64, words + 1]: bit i of word w in plane p is bit p of node 64 * w + i."""
    width = -(-len(nodes) // 64) + 1
    padded = np.zeros(width * 64, np.uint64)
    padded[: len(nodes)] = nodes
    planes = np.empty((64, width), np.uint64)
    for p in range(64):
        bits = ((padded >> np.uint64(p)) & np.uint64(1)).astype(np.uint8)
        planes[p] = np.packbits(bits, bitorder="little").view(np.uint64)
    return planes


def within_radius(planes: np.ndarray, wanted: np.ndarray, shift: int, radius: int = RADIUS) -> np.ndarray:
    """Nodes i, among those marked in `wanted` (a bit each), that differ from node i + shift in at most `radius`
    bits: three counter planes hold up to seven differences, more are an overflow."""
    word = np.flatnonzero(wanted)
    over = ~wanted[word]
    one, two, four = (np.zeros_like(over) for _ in range(3))

    def exceeded() -> np.ndarray:
        """Nodes whose count of differences so far is above the radius."""
        out = over.copy()
        for count in range(radius + 1, 8):
            out |= np.bitwise_and.reduce([p if count >> k & 1 else ~p for k, p in enumerate((one, two, four))])
        return out

    jump, turn = divmod(shift, 64)
    top = planes.shape[1] - 1
    for p in range(64):
        near = planes[p, np.minimum(word + jump, top)]
        if turn:
            near = (near >> np.uint64(turn)) | (planes[p, np.minimum(word + jump + 1, top)] << np.uint64(64 - turn))
        differ = planes[p, word] ^ near
        carry = one & differ
        one ^= differ
        more = two & carry
        two ^= carry
        over |= four & more
        four ^= more
        if p % 8 == 7:
            alive = exceeded() != FULL
            if not alive.all():
                word, over, one, two, four = word[alive], over[alive], one[alive], two[alive], four[alive]
                if not len(word):
                    break
    good = ~exceeded()
    bits = np.unpackbits(good.view(np.uint8), bitorder="little").reshape(-1, 64)
    lane, i = np.nonzero(bits)
    return word[lane] * 64 + i


def forest(nodes: np.ndarray, run: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (a, b) of the links between nodes of the same run; run numbers ascend."""
    n = len(nodes)
    end = np.searchsorted(run, run, side="right")
    planes = bit_planes(nodes)
    parent = np.arange(n)
    pairs: list[tuple[int, int]] = []
    groups = end[np.searchsorted(run, run, side="left")] - np.searchsorted(run, run, side="left")  # nodes of the run
    trees = groups.copy()  # trees left in the run, kept at its first node
    first = np.searchsorted(run, run, side="left")
    shift, longest = 1, int(groups.max(initial=0))
    while shift < longest:
        open_ = (np.arange(n) + shift < end) & (trees[first] > 1)
        if not open_.any():
            break
        marks = np.zeros(planes.shape[1] * 64, np.uint8)
        marks[:n] = open_
        hit = within_radius(planes, np.packbits(marks, bitorder="little").view(np.uint64), shift, radius)
        hit = hit[parent[hit] != parent[hit + shift]]
        for i in hit.tolist():
            a, b = i, i + shift
            while parent[a] != a:
                a = parent[a]
            while parent[b] != b:
                b = parent[b]
            if a != b:
                parent[max(a, b)] = min(a, b)
                trees[first[i]] -= 1
                pairs.append((i, i + shift))
        if len(hit):
            while True:
                up = parent[parent]
                if np.array_equal(up, parent):
                    break
                parent = up
        shift += 1
    found = np.array(pairs, np.int64).reshape(-1, 2)
    return nodes[found[:, 0]], nodes[found[:, 1]]


def bucket_links(batches: Iterator[pa.RecordBatch], radius: int = RADIUS) -> Iterator[dict]:
    """Links of the buckets of a partition that is sorted by (choice, key)."""
    held: list[pa.RecordBatch] = []

    def links(choice: np.ndarray, key: np.ndarray, node: np.ndarray) -> dict:
        new = np.r_[True, (choice[1:] != choice[:-1]) | (key[1:] != key[:-1])]
        run = np.cumsum(new)
        many = np.bincount(run)[run] > 1
        a, b = forest(node[many].view(np.uint64), run[many], radius)
        return {"a": a.view(np.int64), "b": b.view(np.int64)}

    def columns() -> list[np.ndarray]:
        return [np.concatenate([b.column(k).to_numpy() for b in held]) for k in range(3)]

    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= CHUNK:
            choice, key, node = columns()
            last = int(np.flatnonzero((choice != choice[-1]) | (key != key[-1])).max(initial=-1)) + 1
            if last:  # the last bucket may go on in the next batch
                yield links(choice[:last], key[:last], node[:last])
            rest = [pa.array(c[last:]) for c in (choice, key, node)]
            held, size = [pa.RecordBatch.from_arrays(rest, names=batch.schema.names)], len(choice) - last
    if size:
        yield links(*columns())


def links_of(nodes: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """Links (a, b) that connect all nodes (`fingerprint`, distinct) within the radius, bucket by bucket."""
    assert radius < min(blocks, 8)
    edges = [64 * i // blocks for i in range(blocks + 1)]
    masks = []
    for gone in combinations(range(blocks), radius):
        mask = (1 << 64) - 1
        for block in gone:
            mask &= ~(((1 << (edges[block + 1] - edges[block])) - 1) << edges[block])
        masks.append(mask - (1 << 64) if mask >> 63 else mask)
    keys = F.array(*[F.col("fingerprint").bitwiseAND(F.lit(m).cast("bigint")) for m in masks])
    rows = nodes.select(F.posexplode(keys).alias("choice", "key"), "fingerprint")
    rows = rows.repartition("choice", "key").sortWithinPartitions("choice", "key", "fingerprint")
    return gathered(rows, "a bigint, b bigint", lambda batches: bucket_links(batches, radius))


def groups(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Every row's kept columns, `fingerprint`, `root` (the group's own, both bigint) and
    `component_id`, the group's smallest doc_id."""
    assert "doc_id" in keep
    keep = tuple(k for k in keep if k not in ("root", "component_id"))
    prints = annotate(docs, "fingerprint bigint", lambda step: [fingerprints(step.column(TEXT)).view(np.int64)], keep)
    rows = written(prints, "fingerprints")
    nodes = rows.groupBy("fingerprint").agg(F.min("doc_id").alias("low"))
    linked = components(links_of(nodes.select("fingerprint"))).withColumnRenamed("node", "fingerprint")
    nodes = nodes.join(linked, "fingerprint", "left").withColumn("root", F.coalesce("root", "fingerprint"))
    lows = nodes.groupBy("root").agg(F.min("low").alias("component_id"))
    named = nodes.select("fingerprint", "root").join(lows, "root").select("fingerprint", "root", "component_id")
    return rows.join(named, "fingerprint", "left").select(*quoted(rows.columns), "root", "component_id")


def near_groups(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), shingle: int = NEAR_SHINGLE, radius: int = NEAR_RADIUS,
                blocks: int = NEAR_BLOCKS, prints: int = NEAR_PRINTS) -> DataFrame:
    """Every row's kept columns and `root`, its group's own number: rows are linked if any of their
    near_fingerprints() differ in at most `radius` bits. A near copy that one fingerprint misses
    is met by another one."""
    names = [f"print_{k}" for k in range(prints)]
    rows = annotate(
        docs, ", ".join(f"{n} bigint" for n in names),
        lambda step: [p.view(np.int64) for p in near_fingerprints(step.column(TEXT), shingle, prints)], keep,
    )
    rows = written(rows.withColumn("node", F.xxhash64(*names)), "fingerprints")
    nodes = written(rows.groupBy("node").agg(*[F.first(n).alias(n) for n in names]), "nodes")
    edges = None
    for n in names:
        firsts = written(nodes.groupBy(F.col(n).alias("fingerprint")).agg(F.min("node").alias("first")), "firsts")
        alike = nodes.join(firsts, F.col(n) == F.col("fingerprint")).filter("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
        found = links_of(firsts.select("fingerprint"), radius, blocks)
        found = found.join(firsts.toDF("a", "first_a"), "a").join(firsts.toDF("b", "first_b"), "b").select(F.col("first_a").alias("a"), F.col("first_b").alias("b"))
        edges = alike.unionByName(found) if edges is None else edges.unionByName(alike).unionByName(found)
    linked = components(edges)
    return rows.join(linked, "node", "left").select(*quoted(keep), F.coalesce("root", "node").alias("root"))


def first_of_groups(docs: DataFrame) -> DataFrame:
    """One row of each group of near_groups(), the one of smallest doc_id, with its own columns."""
    marked = docs.withColumn("_row", F.xxhash64(*quoted(docs.columns)))
    members = near_groups(marked.select("doc_id", "_row", "text"), ("doc_id", "_row"))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "_row")
    kept = members.groupBy("root").agg(F.min_by("_row", order).alias("_row")).select("_row")
    once = F.row_number().over(Window.partitionBy("_row").orderBy("_row"))
    return marked.join(kept, "_row", "left_semi").withColumn("_copy", once).filter("_copy = 1").select(*quoted(docs.columns))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = groups(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
