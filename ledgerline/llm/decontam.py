"""Benchmark decontamination: an FM-index per shard of documents, searched for test phrases.

A phrase is a window of WINDOW consecutive words of a benchmark item (a shorter item is
one phrase). A shard is a step of whole documents. Its words become symbols: only runs
of words that all stand in some phrase, and are no shorter than the shortest phrase, are
indexed, since nothing else can hold an occurrence; runs are set apart by a symbol that
no phrase has, so no occurrence crosses documents. Backward search finds each phrase's
rows, sampled suffix positions locate them, and overlapping occurrences merge to
removal spans.

The benchmark is the stated query set: it is read in blocks of bounded size, each block
is broadcast, and every shard is indexed and searched once a block.

Cases: null and empty texts have no words, no spans and are not contaminated; an item
without words has no phrase; a null item id reads "null"; items of equal id count once;
an empty benchmark contaminates nothing; equal rows get equal results."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.fmindex import FmIndex
from ledgerline.llm.rows import TEXT, annotate, rows_where, table
from ledgerline.llm.textwords import LETTERS, Words, merged, words_of

WINDOW = 13
MAX_SHARE = 20  # contaminated if hit words times this reach all words
BLOCK_BYTES = 16 << 20  # benchmark text of one broadcast block

SPAN = "struct<first_word:bigint,end_word:bigint,start:bigint,end:bigint>"
OUTPUTS = f"n_words bigint, n_hit bigint, spans array<{SPAN}>, item_ids array<string>, contaminated boolean"


class Phrases:
    """The distinct windows of a block of items, as rows of symbols from 1."""

    def __init__(self, ids: list[str], texts: list[str], window: int = WINDOW) -> None:
        words = words_of(pa.array(texts, pa.string()), LETTERS, lower=True)
        self.ids = ids
        self.hashed, symbol = np.unique(words.keys(), return_inverse=True)
        self.maybe = np.zeros(1 << 16, dtype=bool)
        self.maybe[(self.hashed & np.uint64(0xFFFF)).astype(np.int64)] = True
        counts, first = words.counts, words.first
        starts = np.maximum(counts - window, 0) + (counts > 0)
        item = np.repeat(np.arange(len(ids)), starts)
        at = np.arange(starts.sum()) - np.repeat(np.cumsum(starts) - starts, starts) + first[item]
        length = np.minimum(counts[item], window)
        cells = at[:, None] + np.arange(window)
        rows = np.where(np.arange(window) < length[:, None], symbol[np.minimum(cells, max(len(symbol) - 1, 0))] + 1 if len(symbol) else 0, 0)
        self.rows, which = np.unique(rows, axis=0, return_inverse=True)
        self.length = (self.rows > 0).sum(axis=1)
        self.shortest = int(self.length.min()) if len(self.length) else 0
        # items of each phrase, as offsets into one list
        order = np.argsort(which, kind="stable")
        self.items = item[order]
        self.items_from = np.searchsorted(which[order], np.arange(len(self.rows) + 1))

    def symbols(self, keys: np.ndarray) -> np.ndarray:
        """Symbol of each word, 0 for words of no phrase."""
        out = np.zeros(len(keys), np.int64)
        may = np.flatnonzero(self.maybe[(keys & np.uint64(0xFFFF)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.hashed, keys[may]), len(self.hashed) - 1)
        out[may] = np.where(self.hashed[at] == keys[may], at + 1, 0)
        return out


def occurrences(words: Words, keys: np.ndarray, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """(first word, phrase) of every occurrence in the shard."""
    none = np.zeros(0, np.int64)
    if not len(phrases.rows) or not len(keys):
        return none, none
    symbol = phrases.symbols(keys)
    inside = symbol > 0
    begins = inside & np.r_[True, ~inside[:-1]]
    begins[words.first[:-1][words.counts > 0]] |= inside[words.first[:-1][words.counts > 0]]
    run = np.cumsum(begins)[inside]  # of each word inside, numbered from 1
    kept = np.bincount(run)[run] >= phrases.shortest
    at, run = np.flatnonzero(inside)[kept], run[kept]
    if not len(at):
        return none, none
    apart = np.flatnonzero(np.r_[False, run[1:] != run[:-1]])
    apart_symbol = len(phrases.hashed) + 1
    text = np.insert(symbol[at], apart, apart_symbol)
    word = np.insert(at, apart, -1)
    index = FmIndex(text, apart_symbol)
    low, high = index.search(phrases.rows, phrases.length)
    found = np.maximum(high - low, 0)
    phrase = np.repeat(np.arange(len(found)), found)
    rows = np.arange(found.sum()) - np.repeat(np.cumsum(found) - found, found) + np.repeat(low, found)
    return word[index.locate(rows)], phrase


def hits(texts: pa.Array, blocks: list[Phrases]) -> list:
    """The OUTPUTS of each text."""
    words = words_of(texts, LETTERS, lower=True)
    keys, n = words.keys(), len(texts)
    starts, ends, ids = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [set() for _ in range(n)]
    for phrases in blocks:
        at, phrase = occurrences(words, keys, phrases)
        starts.append(at)
        ends.append(at + phrases.length[phrase] if len(at) else at)
        row = np.searchsorted(words.first, at, side="right") - 1
        for r, p in np.unique(np.stack([row, phrase]), axis=1).T:
            ids[r].update(phrases.ids[i] for i in phrases.items[phrases.items_from[p] : phrases.items_from[p + 1]])
    # texts are set apart by a gap, so that spans of neighbours don't merge
    start, end = np.concatenate(starts), np.concatenate(ends)
    gap = np.searchsorted(words.first, start, side="right") - 1
    start, end = merged(start + gap, end + gap)
    row = np.searchsorted(words.first + np.arange(n + 1), start, side="right") - 1
    start, end = start - row, end - row
    n_hit = np.bincount(row, end - start, minlength=n).astype(np.int64)
    chars = np.concatenate([[0], np.cumsum((words.data[:-8] & 0xC0) != 0x80, dtype=np.int64)]) if len(start) else np.zeros(1, np.int64)
    base = words.rows[row]

    def position(byte: np.ndarray) -> pa.Array:
        return pa.array(chars[byte] - chars[base] if len(start) else byte)

    values = [
        pa.array(start - words.first[row]),
        pa.array(end - words.first[row]),
        position(words.start[start] if len(start) else start),
        position(words.end[end - 1] if len(start) else start),
    ]
    spans = pa.StructArray.from_arrays(values, names=["first_word", "end_word", "start", "end"])
    spans = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(n + 1)).astype(np.int32)), spans)
    contaminated = (n_hit > 0) & (MAX_SHARE * n_hit >= words.counts)
    return [words.counts, n_hit, spans, pa.array([sorted(i) for i in ids], pa.list_(pa.string())), contaminated]


def phrase_blocks(benchmark: DataFrame, window: int = WINDOW, most: int = BLOCK_BYTES) -> list[Broadcast]:
    """The benchmark's phrases in broadcast blocks; the driver holds one block of text at a time."""
    items = benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    context = benchmark.sparkSession.sparkContext
    out, ids, texts, size = [], [], [], 0
    for item in items.toLocalIterator():
        ids.append(item["id"])
        texts.append(item["text"])
        size += len(item["text"].encode())
        if size >= most:
            out.append(context.broadcast(Phrases(ids, texts, window)))
            ids, texts, size = [], [], 0
    return [*out, *([context.broadcast(Phrases(ids, texts, window))] if ids else [])]


def find(docs: DataFrame, benchmark: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Every row with its removal spans (words and code points), the items found and the verdict."""
    blocks = phrase_blocks(benchmark)
    return annotate(docs, OUTPUTS, lambda step: hits(step.column(TEXT), [b.value for b in blocks]), keep)


def clean_only(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows that are not contaminated, with their own columns."""
    blocks = phrase_blocks(benchmark)
    return rows_where(docs, lambda step: ~hits(step.column(TEXT), [b.value for b in blocks])[-1])


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return rows.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("item_ids"), ","), 256).alias("items_sha256"),
        "contaminated",
    )
