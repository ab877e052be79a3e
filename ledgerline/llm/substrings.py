"""Substring dedup: repeated 13-word windows by super-k-mer partitioning.

A window's minimiser is the smallest of its m-mers (runs of MER words) in an order that
puts m-mers from frequent cells of a count sketch last and is random otherwise.
Consecutive windows that share a minimiser travel as one packed string of words to the
minimiser's bucket, so equal windows meet there. A bucket sorts its windows by a 64-bit
key, compares equal keys word by word, and marks every window that a row of smaller id
also has.

What keeps buckets even: within a step of documents only the rows of smallest id send a
window at all (all others are marked at once), so a passage of a third of all documents
reaches its bucket once a step; the order above picks a window's rarest m-mer; and a
window whose every m-mer is frequent goes by its own key instead of its minimiser's. A
bucket that is large all the same is sorted in ranges of keys, one after the other.
Strings are sent compressed, one block a step and bucket.

Marked spans are gathered by document (bounded by its length) and joined to the texts.

Cases: a null or empty text has no words and keeps an empty text; a null id counts as
larger than every id; rows of equal id never remove words from each other; extra columns
do no harm."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.rows import TEXT, gathered, quoted, schema_of, table
from ledgerline.llm.textwords import NOT_SPACE, STEP_BYTES, Words, merged, mix, steps, window_keys, window_starts, words_of

WINDOW = 13
MER = 2
CELLS = 1 << 16
PART_WINDOWS = 1_000_000  # windows of a bucket, on average
RANGE_BYTES = 32 << 20  # packed text that a bucket sorts at once
LEVEL = 6  # of the blocks' compression; strings overlap their neighbours in other buckets, so they are worth it
FREQUENT = 4  # times the mean cell count from which an m-mer comes later in the order
NO_ID = np.iinfo(np.int64).max

SPANS, STRINGS = 0, 1  # kinds of blocks
SPAN_LIST = "array<struct<start:bigint,end:bigint>>"


@dataclass(frozen=True)
class Order:
    """The order of m-mers by the cell of their key, and the number of buckets."""

    rank: np.ndarray  # uint8[CELLS], 0 for all but frequent cells
    hot: np.ndarray  # bool[CELLS]
    parts: int


def coded(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(exact number of each word within the step, its 64-bit key)."""
    n = len(words.start)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    length = words.end - words.start
    inside = NOT_SPACE[words.data[:-8]]
    offsets = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
    raw = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(words.data[:-8][inside])])
    coding = raw.dictionary_encode()
    distinct = coding.dictionary
    at = np.frombuffer(distinct.buffers()[1], np.int32)[: len(distinct) + 1].astype(np.int64)
    data = np.zeros(at[-1] + 8, np.uint8)
    data[: at[-1]] = np.frombuffer(distinct.buffers()[2], np.uint8)[: at[-1]]
    keys = Words(data, at, at[:-1], at[1:], np.arange(len(at))).keys()
    number = coding.indices.to_numpy()
    return number.astype(np.int64), keys[number]


def spaced(words: Words) -> tuple[bytes, np.ndarray, np.ndarray]:
    """(the words with one space after each, start and end of each word there)."""
    length = words.end - words.start
    start = np.cumsum(length + 1) - (length + 1)
    out = np.full(int(length.sum()) + len(length), 0x20, np.uint8)
    place = np.ones(len(out), dtype=bool)
    place[start + length] = False
    out[place] = words.data[:-8][NOT_SPACE[words.data[:-8]]]
    return out.tobytes(), start, start + length


def sliding_minimum(values: np.ndarray, size: int) -> np.ndarray:
    """Smallest of every `size` consecutive values."""
    done = 1
    while done < size:
        step = min(done, size - done)
        values = np.minimum(values[:-step], values[step:]) if len(values) > step else values[:0]
        done += step
    return values


def equal_windows(number: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Marks the pairs of window starts whose words are the same."""
    out = np.ones(len(a), dtype=bool)
    for j in range(WINDOW):
        out &= number[a + j] == number[b + j]
    return out


def later_ids(number: np.ndarray, key: np.ndarray, at: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Marks the windows (key, start, id) that a window of the same words and a smaller id has."""
    out = np.zeros(len(at), dtype=bool)
    if not len(at):
        return out
    order = np.lexsort((ids, key))
    tied = key[order[1:]] == key[order[:-1]]
    same = np.zeros(len(tied), dtype=bool)
    pairs = np.flatnonzero(tied)
    same[pairs] = equal_windows(number, at[order[pairs + 1]], at[order[pairs]])
    if (tied & ~same).any():  # different windows of equal key: sort these by their words
        odd = np.isin(key, key[order[1:]][tied & ~same])
        rows = np.flatnonzero(odd)
        _, group = np.unique(number[at[rows][:, None] + np.arange(WINDOW)], axis=0, return_inverse=True)
        lowest = np.full(group.max() + 1, NO_ID, np.int64)
        np.minimum.at(lowest, group, ids[rows])
        out[rows] = ids[rows] > lowest[group]
        rest = np.flatnonzero(~odd)
        out[rest] = later_ids(number, key[rest], at[rest], ids[rest])
        return out
    first = np.maximum.accumulate(np.where(np.r_[True, ~same], np.arange(len(order)), 0))
    out[order] = ids[order] > ids[order[first]]
    return out


def _pack(ids: np.ndarray, row_keys: np.ndarray, owner: np.ndarray, columns: list[np.ndarray], text: bytes) -> bytes:
    """ids and keys of the rows that occur, each record's row among them and int32 columns, and the text."""
    used, number = np.unique(owner, return_inverse=True)
    head = np.array([len(used), len(owner), len(columns)], np.int64)
    parts = [head, ids[used], row_keys[used], number.astype(np.int32), *(c.astype(np.int32) for c in columns)]
    return zstandard.ZstdCompressor(level=LEVEL).compress(b"".join([*(p.tobytes() for p in parts), text]))


def _unpack(block: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray], bytes]:
    raw = zstandard.ZstdDecompressor().decompress(block)
    n_rows, n, n_columns = np.frombuffer(raw, np.int64, 3)
    ids, keys = np.frombuffer(raw, np.int64, n_rows, 24), np.frombuffer(raw, np.int64, n_rows, 24 + 8 * n_rows)
    at = 24 + 16 * int(n_rows)
    ints = np.frombuffer(raw, np.int32, n * (1 + n_columns), at).reshape(1 + n_columns, n)
    return ids, keys, ints[0], [ints[1 + k].astype(np.int64) for k in range(n_columns)], raw[at + 4 * n * (1 + n_columns) :]


def _runs(at: np.ndarray, size: int, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, start, end) of the words that windows at ascending starts cover, by owner."""
    if not len(at):
        return owner, at, at
    gap = owner * (size + 1)  # owners ascend with the starts; keep their spans apart
    start, end = merged(at + gap, at + gap + size)
    who = owner[np.searchsorted(at + gap, start)]
    return who, start - who * (size + 1), end - who * (size + 1)


def outgoing(step: pa.RecordBatch, order: Order, serial: int) -> dict:
    """Blocks of a step (text, id, row key): marked spans, and packed strings by bucket."""
    words = words_of(step.column(0), NOT_SPACE)
    ids, row_keys = (step.column(k).to_numpy() for k in (1, 2))
    number, keys = coded(words)
    at = np.flatnonzero(window_starts(words.first, WINDOW))
    out: dict[str, list] = {"part": [], "kind": [], "block": []}
    if not len(at):
        return out
    window = window_keys(keys, WINDOW)[at]
    row = words.row()[at]
    known = later_ids(number, window, at, ids[row])
    if known.any():
        who, start, end = _runs(at[known], WINDOW, row[known])
        base = words.first[who]
        out["part"].append(serial % order.parts)
        out["kind"].append(SPANS)
        out["block"].append(_pack(ids, row_keys, who, [start - base, end - base], b""))
    mers = window_keys(keys, MER)
    ranked = order.rank[(mers & np.uint64(CELLS - 1)).astype(np.int64)].astype(np.uint64) << np.uint64(56)
    ranked |= mers & np.uint64((1 << 56) - 1)
    least = sliding_minimum(ranked, WINDOW - MER + 1)[at]
    at, row, window, least = at[~known], row[~known], window[~known], least[~known]
    if not len(at):
        return out
    hot = order.hot[(least & np.uint64(CELLS - 1)).astype(np.int64)]
    new = np.r_[True, (at[1:] != at[:-1] + 1) | (least[1:] != least[:-1]) | hot[1:]]
    begin = np.flatnonzero(new)
    last = np.r_[begin[1:] - 1, len(at) - 1]
    part = (mix(np.where(hot[begin], window[begin], least[begin])) % np.uint64(order.parts)).astype(np.int64)
    plain, word_start, word_end = spaced(words)
    by = np.argsort(part, kind="stable")
    begin, last, part = begin[by], last[by], part[by]
    first, end = word_start[at[begin]].tolist(), word_end[at[last] + WINDOW - 1].tolist()
    pos, owner = at[begin] - words.first[row[begin]], row[begin]
    cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True])
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        text = b"\n".join(plain[first[k] : end[k]] for k in range(a, b))
        out["part"].append(int(part[a]))
        out["kind"].append(STRINGS)
        out["block"].append(_pack(ids, row_keys, owner[a:b], [pos[a:b]], text))
    return out


def _span_rows(ids: np.ndarray, keys: np.ndarray, start: np.ndarray, end: np.ndarray) -> dict:
    """One row for each row key with its spans, from records ordered by row."""
    first = np.flatnonzero(np.r_[True, (ids[1:] != ids[:-1]) | (keys[1:] != keys[:-1])][: len(ids)])
    offsets = pa.array(np.r_[first, len(ids)].astype(np.int32))
    lists = {n: pa.ListArray.from_arrays(offsets, pa.array(v)) for n, v in (("starts", start), ("ends", end))}
    return {"id": ids[first], "row_key": keys[first], **lists}


def sorted_bucket(blocks: list[bytes], ranges: int) -> Iterator[dict]:
    """Spans of the windows of a bucket that a smaller id has; one range of keys at a time."""
    for part in range(ranges):
        numbers = {"id": [], "key": [], "pos": [], "window": []}
        texts: list[bytes] = []
        for block in blocks:
            ids, keys, owner, (pos,), text = _unpack(block)
            if ranges == 1:
                texts += text.split(b"\n")
                numbers["id"].append(ids[owner])
                numbers["key"].append(keys[owner])
                numbers["pos"].append(pos)
                continue
            # each window of this range becomes a string of its own
            words = words_of(pa.array(text.split(b"\n"), pa.binary()), NOT_SPACE)
            at = np.flatnonzero(window_starts(words.first, WINDOW))
            at = at[window_keys(words.keys(), WINDOW)[at] % np.uint64(ranges) == part]
            plain, start, end = spaced(words)
            texts += [plain[a:b] for a, b in zip(start[at].tolist(), end[at + WINDOW - 1].tolist(), strict=True)]
            string = words.row()[at]
            numbers["id"].append(ids[owner[string]])
            numbers["key"].append(keys[owner[string]])
            numbers["pos"].append(pos[string] + at - words.first[string])
        if not texts:
            continue
        ids, keys, pos = (np.concatenate(numbers[n]) for n in ("id", "key", "pos"))
        words = words_of(pa.array(texts, pa.binary()), NOT_SPACE)
        del texts
        number, word_keys = coded(words)
        at = np.flatnonzero(window_starts(words.first, WINDOW))
        string = words.row()[at]
        later = later_ids(number, window_keys(word_keys, WINDOW)[at], at, ids[string])
        at, string = at[later], string[later]
        if not len(at):
            continue
        start = pos[string] + at - words.first[string]
        by = np.lexsort((start, keys[string], ids[string]))
        string, start = string[by], start[by]
        who_id, who_key = ids[string], keys[string]
        new = np.r_[True, (who_id[1:] != who_id[:-1]) | (who_key[1:] != who_key[:-1])]
        who, start, end = _runs_of_groups(np.cumsum(new) - 1, start)
        heads = np.flatnonzero(new)
        yield _span_rows(who_id[heads][who], who_key[heads][who], start, end)


def _runs_of_groups(group: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, start, end) of the words that the windows of each group cover; sorted by group and start."""
    gap = group * (int(start.max()) + WINDOW + 1)
    s, e = merged(start + gap, start + gap + WINDOW)
    at = np.searchsorted(start + gap, s)
    who, shift = group[at], gap[at]
    return who, s - shift, e - shift


def incoming(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Marked spans from a partition of blocks sorted by bucket; one bucket's blocks are held at a time."""
    part, held, size = None, [], 0

    def bucket() -> Iterator[dict]:
        yield from sorted_bucket(held, max(1, -(-size // RANGE_BYTES)))

    for batch in batches:
        for record in batch.to_pylist():
            if record["kind"] == SPANS:
                ids, keys, owner, (start, end), _ = _unpack(record["block"])
                yield _span_rows(ids[owner], keys[owner], start, end)
                continue
            if record["part"] != part and held:
                yield from bucket()
                held, size = [], 0
            part = record["part"]
            held.append(record["block"])
            size += zstandard.frame_content_size(record["block"])
    if held:
        yield from bucket()


def mer_order(texts: DataFrame, part_windows: int = PART_WINDOWS) -> Order:
    """Counts the m-mers of all texts in CELLS cells; the driver gets one count a cell."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        seen = np.zeros(CELLS, np.int64)
        for step in steps(batches, TEXT, STEP_BYTES):
            words = words_of(step.column(0), NOT_SPACE)
            mers = window_keys(coded(words)[1], MER)[np.flatnonzero(window_starts(words.first, MER))]
            seen += np.bincount((mers & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS)
        some = np.flatnonzero(seen)
        yield {"cell": some.astype(np.int32), "mers": seen[some]}

    seen = np.zeros(CELLS)
    for r in gathered(texts.select(TEXT), "cell int, mers bigint", counts).groupBy("cell").agg(F.sum("mers").alias("n")).collect():
        seen[r["cell"]] = r["n"]
    total, mean = seen.sum(), max(seen.mean(), 1.0)
    parts = max(1, int(-(-total // part_windows)))
    over = np.maximum(seen / (FREQUENT * mean), 1.0)
    return Order(np.minimum(np.ceil(np.log2(over)), 200).astype(np.uint8), seen > max(2 * FREQUENT * mean, total / parts), parts)


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(id, row_key, starts, ends): the words of each row to remove, as spans that may overlap."""
    order = mer_order(docs)
    shared = docs.sparkSession.sparkContext.broadcast(order)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for serial, step in enumerate(steps(batches, TEXT, STEP_BYTES)):
            blocks = outgoing(step, shared.value, serial)
            if blocks["part"]:
                yield {"part": pa.array(blocks["part"], pa.int32()), "kind": pa.array(blocks["kind"], pa.int32()), "block": blocks["block"]}

    sent = gathered(docs.select(TEXT, "id", "row_key"), "part int, kind int, block binary", send)
    sent = sent.repartition(order.parts, "part").sortWithinPartitions("part")
    spans = gathered(sent, "id bigint, row_key bigint, starts array<bigint>, ends array<bigint>", incoming)
    lists = {n: F.flatten(F.collect_list(n)).alias(n) for n in ("starts", "ends")}
    return spans.groupBy("id", "row_key").agg(*lists.values())


def kept_texts(step: pa.RecordBatch) -> list:
    """Word counts, removed spans and what is left of each text; the step has text, starts and ends."""
    words = words_of(step.column(TEXT), NOT_SPACE)
    plain, word_start, word_end = spaced(words)
    flat = np.frombuffer(plain, np.uint8)
    removed, spans, texts = np.zeros(step.num_rows, np.int64), [], []
    lists = [step.column(n).to_pylist() for n in ("starts", "ends")]
    for r in range(step.num_rows):
        a, b = words.first[r], words.first[r + 1]
        begin, stop = (word_start[a], word_end[b - 1]) if b > a else (0, 0)
        if not lists[0][r]:
            spans.append([])
            texts.append(plain[begin:stop])
            continue
        start, end = merged(np.array(lists[0][r]), np.array(lists[1][r]))
        keep = np.ones(stop + 1 - begin, dtype=bool)
        for s, e in zip(start, end, strict=True):
            keep[word_start[a + s] - begin : word_end[a + e - 1] + 1 - begin] = False
        removed[r] = (end - start).sum()
        spans.append([{"start": int(s), "end": int(e)} for s, e in zip(start, end, strict=True)])
        texts.append(flat[begin : stop + 1][keep].tobytes().removesuffix(b" "))
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    return [words.counts, removed, pa.array(spans, kind), pa.array(texts, pa.binary()).cast(pa.string())]


def dedup(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Every row with `n_words`, `n_removed`, the removed word `spans` and `kept_text`, its other words joined by spaces."""
    outputs = schema_of(f"n_words bigint, n_removed bigint, spans {SPAN_LIST}, kept_text string")
    keep = [k for k in keep if k not in outputs.names]
    text = F.col("text").cast("string")
    row = [F.coalesce(F.col("doc_id").cast("bigint"), F.lit(int(NO_ID))).alias("id"), F.xxhash64(text).alias("row_key")]
    rows = docs.select(*[F.col(q).alias(f"keep_{i}") for i, q in enumerate(quoted(keep))], text.alias(TEXT), *row)
    spans = repeated_spans(rows)
    joined = rows.join(spans, ["id", "row_key"], "left")
    kept = [f"keep_{i}" for i in range(len(keep))]
    joined = joined.select(*kept, TEXT, "starts", "ends")
    schema = joined.select(*kept).schema
    for field in outputs.fields:
        schema = schema.add(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in steps(batches, TEXT, STEP_BYTES):
            arrays = [*step.columns[: len(kept)], *map(pa.array, kept_texts(step))]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return joined.mapInArrow(run, schema).toDF(*keep, *outputs.names)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dedup(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
