"""Quality rules: rule counts of a whole text and a hashed n-gram likelihood ratio.

Two multinomials over hashed byte 4-grams are compared: the trusted target (texts that
`labels` marks as good) and the raw corpus (every text). A text's score is the mean of
log(target / raw) over its n-grams, so it does not depend on the text's length; a text
below THRESHOLD is rejected. The raw corpus and all rule counts cover every row.

Both multinomials mix in the same share of the uniform one, so an n-gram that neither
has seen counts 0 and an unknown script or language is not rejected for being unknown.
Byte n-grams are used because generated or foreign words make word n-grams of a large
corpus nearly all unique, while markup, symbol noise and shouting show in four bytes.

Cases: a null or empty text has no words and fails the base rules; without any trusted
row every score is 0 and only the base rules reject; equal rows get equal results."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.rows import TEXT, annotate, gathered, rows_where, table
from ledgerline.llm.textwords import NOT_SPACE, mix, steps, utf8, window_keys, window_starts, words_of

N = 4  # bytes of an n-gram
BUCKETS = 1 << 16
PRIOR = 0.1  # share of the uniform multinomial against a multinomial's own counts
STEP = 2 << 20  # bytes of text at a time; the arrays of a step take some 50 bytes each
THRESHOLD = -0.2  # mean log ratio, in nats, below which a text is rejected
TRUSTED_MOST = 20_000  # trusted texts used, those of smallest hash; the bound of the broadcast

MIN_WORDS = 20
REPEAT_WINDOW = 8
REPEAT_PERCENT = 30
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_IN_LINE = np.ones(256, dtype=bool)
_IN_LINE[0x0A] = False

OUTPUTS = (
    "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
    "base_failed boolean, kept boolean, score double"
)


@dataclass(frozen=True)
class Model:
    """Log ratio of each bucket, float64[BUCKETS]."""

    ratio: np.ndarray


def ngram_buckets(body: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of every n-gram in order, offsets of the texts in them)."""
    counts = np.maximum(np.diff(rows) - (N - 1), 0)
    first = np.concatenate([[0], np.cumsum(counts)])
    if first[-1] == 0:
        return np.zeros(0, np.int64), first
    grams = np.ndarray(len(body) - N + 1, dtype="<u4", buffer=np.ascontiguousarray(body), strides=(1,))
    inside = np.ones(len(grams), dtype=bool)
    for back in range(1, N):  # the last starts of each text would run into the next one
        at = rows[1:] - back
        at = at[(at >= rows[:-1]) & (at < len(grams))]
        inside[at] = False
    if not inside.all():
        grams = grams[inside]
    return ((grams * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.int64), first


def row_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of each row's values, added one after another, so reruns agree to the last bit."""
    out = np.zeros(len(first) - 1, np.float64)
    some = np.flatnonzero(np.diff(first) > 0)
    if len(some):
        out[some] = np.add.reduceat(values, first[some])
    return out


def repeats_in_row(keys: np.ndarray, row: np.ndarray, later_only: bool) -> np.ndarray:
    """Marks the keys that their row holds more than once; the first one too, unless later_only."""
    key = mix(keys ^ mix(row.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    out = np.zeros(len(keys), dtype=bool)
    out[order[1:][same]] = True
    if not later_only:
        out[order[:-1][same]] = True
    return out


def rule_counts(texts: pa.Array) -> dict[str, np.ndarray]:
    """The base counts of each text."""
    words = words_of(texts, NOT_SPACE)
    body, rows = words.data[:-8], words.rows
    n = len(rows) - 1

    def per_row(marks: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(marks)])[rows])

    inside = NOT_SPACE[body]
    lines = words_of(texts, _IN_LINE)
    spaces = np.concatenate([[0], np.cumsum(inside)])
    worded = spaces[lines.end] > spaces[lines.start]
    line_row = lines.row()
    dup = repeats_in_row(lines.keys(), line_row, later_only=True) & worded

    covered = np.zeros(len(words.start) + 1, np.int64)
    at = np.flatnonzero(window_starts(words.first, REPEAT_WINDOW))
    if len(at):
        twice = at[repeats_in_row(window_keys(words.keys(), REPEAT_WINDOW)[at], words.row()[at], later_only=False)]
        np.add.at(covered, twice, 1)
        np.add.at(covered, twice + REPEAT_WINDOW, -1)
    hit = np.concatenate([[0], np.cumsum(np.cumsum(covered[:-1]) > 0)])
    return {
        "n_words": words.counts,
        "word_chars": per_row(inside & ((body & 0xC0) != 0x80)),
        "n_symbols": per_row(_SYMBOL[body]),
        "n_dup_lines": np.bincount(line_row[dup], minlength=n),
        "n_repeat_words": np.diff(hit[words.first]),
    }


def scores(texts: pa.Array, model: Model) -> np.ndarray:
    bucket, first = ngram_buckets(*utf8(texts))
    return row_sums(model.ratio[bucket], first) / np.maximum(np.diff(first), 1)


def verdicts(texts: pa.Array, model: Model) -> dict[str, np.ndarray]:
    out = rule_counts(texts)
    score = scores(texts, model)
    failed = (out["n_words"] < MIN_WORDS) | (100 * out["n_repeat_words"] > REPEAT_PERCENT * out["n_words"])
    return out | {"base_failed": failed, "kept": ~failed & (score >= THRESHOLD), "score": score}


def trusted_ids(labels: DataFrame, most: int = TRUSTED_MOST) -> DataFrame:
    """At most `most` ids of texts that every label row of theirs marks as good."""
    good = labels.groupBy(F.col("doc_id").alias("good_id")).agg(F.min("quality").alias("quality"))
    good = good.filter("quality = 1 and good_id is not null").select("good_id")
    return good.orderBy(F.xxhash64("good_id"), "good_id").limit(most)


def train(docs: DataFrame, labels: DataFrame, most: int = TRUSTED_MOST) -> Model:
    """One pass over all texts; each task sends one pair of counts a bucket.

    The broadcast side has at most `most` ids; the driver gets BUCKETS pairs."""
    marked = docs.select("doc_id", F.col("text").cast("string").alias(TEXT)).join(
        F.broadcast(trusted_ids(labels, most)), F.col("doc_id") == F.col("good_id"), "left"
    )
    marked = marked.select(TEXT, F.col("good_id").isNotNull().alias("good"))

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for step in steps(batches, TEXT, STEP):
            bucket, first = ngram_buckets(*utf8(step.column(0)))
            raw += np.bincount(bucket, minlength=BUCKETS)
            good = step.column(1).to_numpy(zero_copy_only=False).astype(bool)
            target += np.bincount(bucket[np.repeat(good, np.diff(first))], minlength=BUCKETS)
        some = np.flatnonzero(raw)
        yield {"bucket": some.astype(np.int32), "raw": raw[some], "target": target[some]}

    sums = gathered(marked, "bucket int, raw bigint, target bigint", counts)
    sums = sums.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect()
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in sums:
        raw[r.bucket], target[r.bucket] = r.raw, r.target
    if target.sum() == 0:
        return Model(np.zeros(BUCKETS))
    uniform = PRIOR / BUCKETS
    return Model(np.log((target / target.sum() + uniform) / (raw / raw.sum() + uniform)))


def assess(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Counts, score and verdict of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def fill(step: pa.RecordBatch) -> list:
        out = verdicts(step.column(TEXT), shared.value)
        return [out[f.split()[0]] for f in OUTPUTS.split(", ")]

    return annotate(docs, OUTPUTS, fill, keep, most=STEP)


def kept_only(docs: DataFrame, model: Model) -> DataFrame:
    """The rows that are kept, with their own columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return rows_where(docs, lambda step: verdicts(step.column(TEXT), shared.value)["kept"], most=STEP)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return assess(docs, train(docs, table(spark, sf_dir, "labels")))
