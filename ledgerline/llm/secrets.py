"""Secret scan: fixed patterns, and character Markov models for strings without a pattern.

Two first-order models over the bytes of identifiers are compared: one of random
strings, one of ordinary identifiers. Labelled samples of random strings are the values
the patterns find in the corpus and seeded strings over the alphabets that keys use;
ordinary identifiers are all others of the corpus. A run of `[A-Za-z0-9+/_=-]` of
MIN_RUN characters or more that touches no pattern's span is added when the mean
log(random / ordinary) of its transitions is at least THRESHOLD. In any other such run,
windows of MIN_RUN transitions with a mean of WINDOW_THRESHOLD (higher, as a run has many
windows) are added, overlapping ones as one span, so a key that words are joined to by `/`, `-`, `_` or `=` is found; such a span may reach a few
characters into the words.

Patterns are run on texts that hold one of their keywords, which a search of the
lower-cased bytes finds; all patterns are ASCII, so they work on bytes and offsets are
turned into code points afterwards.

Cases: a null text is empty and has no spans; spans of different kinds may overlap;
equal rows get equal results; without rows only the seeded strings are learned. A text
longer than a step is a step of its own, scanned whole. Input columns other than those
kept don't matter, whatever their names; names that begin with an underscore are ours."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.rows import TEXT, annotate, gathered, table
from ledgerline.llm.textwords import LOWER, STEP_BYTES, merged, steps, utf8

# The base patterns.
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24
KINDS = ("assign", "access", "hex", "random")

MIN_RUN = 16
THRESHOLD = 1.0  # nats a transition
WINDOW_THRESHOLD = 2.0
SMOOTHING = 0.5  # pseudo-count of each transition
_RUN_BYTES = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
_IN_RUN = np.zeros(256, dtype=bool)
_IN_RUN[list(_RUN_BYTES)] = True
_HEX = np.zeros(256, dtype=bool)
_HEX[list(b"0123456789abcdef")] = True
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[list(b"0123456789")] = True
MASK = b"[REDACTED]"

SPAN = "struct<kind:string,start:bigint,end:bigint>"
OUTPUTS = f"spans array<{SPAN}>"


def runs(body: np.ndarray, rows: np.ndarray, kind: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Byte spans of the maximal runs of a class within a text, of `least` bytes or more."""
    inside = kind[body]
    cut = np.zeros(len(body) + 1, dtype=bool)
    cut[rows] = True
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | cut[1:-1]
    ends[:-1] &= ~inside[1:] | cut[1:-1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    long = end - start >= least
    return start[long], end[long]


def found_rows(lowered: bytes, word: bytes, rows: np.ndarray) -> set[int]:
    """Texts in which `word` starts."""
    out, at = set(), lowered.find(word)
    while at >= 0:
        row = int(np.searchsorted(rows, at, side="right")) - 1
        out.add(row)
        at = lowered.find(word, int(rows[row + 1]))  # one find in a text is enough
    return out


def base_spans(body: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(kind, start, end) of the patterns' spans, as bytes of the whole step."""
    raw = body.tobytes()
    out: list[tuple[int, int, int]] = []
    lowered = LOWER[body].tobytes()
    for row in set().union(*(found_rows(lowered, w, rows) for w in KEYWORDS)):
        for m in ASSIGN.finditer(raw, int(rows[row]), int(rows[row + 1])):
            if m.end(2) - m.start(2) >= ASSIGN_LEAST:
                out.append((0, m.start(), m.end()))
    for row in found_rows(raw, b"AKIA", rows):
        for m in ACCESS.finditer(raw, int(rows[row]), int(rows[row + 1])):
            if m.end() - m.start() >= ACCESS_LEAST:
                out.append((1, m.start(), m.end()))
    start, end = runs(body, rows, _HEX, HEX_LEAST)
    fixed = np.array(out, dtype=np.int64).reshape(-1, 3)
    return (
        np.concatenate([fixed[:, 0], np.full(len(start), 2, np.int64)]),
        np.concatenate([fixed[:, 1], start]),
        np.concatenate([fixed[:, 2], end]),
    )


def touched(start: np.ndarray, end: np.ndarray, by_start: np.ndarray, by_end: np.ndarray) -> np.ndarray:
    """Marks the spans that overlap one of the other spans."""
    s, e = merged(by_start, by_end)
    if not len(s):
        return np.zeros(len(start), dtype=bool)
    k = np.searchsorted(e, start, side="right")
    return (k < len(s)) & (s[np.minimum(k, len(s) - 1)] < end)


def transitions(body: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(previous * 256 + next of every step inside the spans, offsets of the spans in them)."""
    counts = np.maximum(end - start - 1, 0)
    first = np.concatenate([[0], np.cumsum(counts)])
    at = np.arange(first[-1]) - np.repeat(first[:-1], counts) + np.repeat(start, counts)
    return body[at].astype(np.int64) * 256 + body[at + 1], first


def seeded_strings(count: int = 300, length: int = 40) -> list[bytes]:
    """Random strings over the alphabets that keys are written in, the same in every run."""
    alphabets = (b"0123456789abcdef", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", _RUN_BYTES[:62], _RUN_BYTES)
    out = []
    for alphabet in alphabets:
        for k in range(count):
            block = b"".join(hashlib.sha256(b"%d:%d:%d" % (len(alphabet), k, j)).digest() for j in range(length // 32 + 1))
            out.append(bytes(alphabet[b % len(alphabet)] for b in block[:length]))
    return out


def train(docs: DataFrame) -> np.ndarray:
    """log(random / ordinary) of each transition, float64[65536], from one pass over all texts."""

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        random, ordinary = np.zeros(65536, np.int64), np.zeros(65536, np.int64)
        for step in steps(batches, TEXT, STEP_BYTES):
            body, rows = utf8(step.column(0))
            _, by_start, by_end = base_spans(body, rows)
            by_start, by_end = merged(by_start, by_end)
            start, end = runs(body, rows, _IN_RUN, 2)
            clean = ~touched(start, end, by_start, by_end)
            ordinary += np.bincount(transitions(body, start[clean], end[clean])[0], minlength=65536)
            inside = np.zeros(len(body), dtype=np.int8)
            np.add.at(inside, by_start, 1)
            covered = by_end[by_end < len(body)]
            np.add.at(inside, covered, -1)
            start, end = runs(np.where(np.cumsum(inside) > 0, body, 0).astype(np.uint8), rows, _IN_RUN, MIN_RUN)
            random += np.bincount(transitions(body, start, end)[0], minlength=65536)
        some = np.flatnonzero(random + ordinary)
        yield {"step": some.astype(np.int32), "random": random[some], "ordinary": ordinary[some]}

    texts = docs.select(F.col("text").cast("string").alias(TEXT))
    sums = gathered(texts, "step int, random bigint, ordinary bigint", collect)
    sums = sums.groupBy("step").agg(F.sum("random").alias("random"), F.sum("ordinary").alias("ordinary"))
    random, ordinary = np.zeros(65536), np.zeros(65536)
    for r in sums.collect():  # a row for each pair of run bytes at most
        random[r["step"]], ordinary[r["step"]] = r["random"], r["ordinary"]
    for s in seeded_strings():
        one = np.frombuffer(s, np.uint8)
        random += np.bincount(one[:-1].astype(np.int64) * 256 + one[1:], minlength=65536)

    def conditional(counts: np.ndarray) -> np.ndarray:
        table = counts.reshape(256, 256) + SMOOTHING * (_IN_RUN[:, None] & _IN_RUN[None, :])
        return table / np.maximum(table.sum(axis=1, keepdims=True), SMOOTHING)

    r, o = conditional(random), conditional(ordinary)
    known = (r > 0) & (o > 0)
    return np.where(known, np.log(np.where(known, r, 1) / np.where(known, o, 1)), 0.0).ravel()


def random_windows(score: np.ndarray, first: np.ndarray, digits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(run, start, end) in characters of the run, end exclusive, of the unions of windows of MIN_RUN
    transitions whose mean score is WINDOW_THRESHOLD or more; `score` and `digits` (whether a transition
    is between digits) hold the transitions of all runs, the offsets of the runs being `first`."""
    sums, numbers = np.concatenate([[0.0], np.cumsum(score)]), np.concatenate([[0], np.cumsum(digits)])
    counts = np.maximum(np.diff(first) - MIN_RUN + 1, 0)  # windows of each run
    begin = np.concatenate([[0], np.cumsum(counts)])
    run = np.repeat(np.arange(len(counts)), counts)
    at = np.arange(begin[-1]) - begin[run] + first[run]
    good = (sums[at + MIN_RUN] - sums[at] >= WINDOW_THRESHOLD * MIN_RUN) & (numbers[at + MIN_RUN] - numbers[at] < MIN_RUN)
    run, at = run[good], at[good]
    if not len(at):
        return run, at, at
    fresh = np.concatenate([[True], (run[1:] != run[:-1]) | (at[1:] > at[:-1] + MIN_RUN)])
    last = np.flatnonzero(np.concatenate([fresh[1:], [True]]))
    run, start, end = run[fresh], at[fresh], at[last] + MIN_RUN + 1
    return run, start - first[run], end - first[run]


def random_spans(body: np.ndarray, start: np.ndarray, end: np.ndarray, ratio: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans that the models call random: whole runs by their mean, else the windows of a run."""
    digits = np.concatenate([[0], np.cumsum(_DIGIT[body])])
    some = digits[end] - digits[start] < end - start  # numbers are not identifiers
    s, e = start[some], end[some]
    if not len(s):
        return s, e
    step, first = transitions(body, s, e)
    score = ratio[step]
    whole = np.add.reduceat(score, first[:-1]) / np.diff(first) >= THRESHOLD
    both = _DIGIT[step >> 8] & _DIGIT[step & 255]
    run, since, until = random_windows(score, first, both)
    part = ~whole[run]
    run, since, until = run[part], since[part], until[part]
    return np.concatenate([s[whole], s[run] + since]), np.concatenate([e[whole], s[run] + until])


def all_spans(body: np.ndarray, rows: np.ndarray, ratio: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(kind, start, end) in bytes: the patterns' spans and what the models call random."""
    kind, start, end = base_spans(body, rows)
    s, e = runs(body, rows, _IN_RUN, MIN_RUN)
    free = ~touched(s, e, start, end)
    s, e = random_spans(body, s[free], e[free], ratio)
    kind = np.concatenate([kind, np.full(len(s), 3, np.int64)])
    start, end = np.concatenate([start, s]), np.concatenate([end, e])
    order = np.lexsort((end, kind, start))
    return kind[order], start[order], end[order]


def span_lists(texts: pa.Array, ratio: np.ndarray) -> pa.Array:
    """Each text's spans in code points, by start and kind."""
    body, rows = utf8(texts)
    kind, start, end = all_spans(body, rows, ratio)
    chars = np.concatenate([[0], np.cumsum((body & 0xC0) != 0x80, dtype=np.int64)])
    base = chars[rows[np.searchsorted(rows, start, side="right") - 1]] if len(start) else start
    fields = {
        "kind": pa.array(KINDS).take(pa.array(kind)),
        "start": pa.array(chars[start] - base),
        "end": pa.array(chars[end] - base),
    }
    spans = pa.StructArray.from_arrays(list(fields.values()), names=list(fields))
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(start, rows).astype(np.int32)), spans)


def scan(docs: DataFrame, ratio: np.ndarray, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Every row with its `spans` (kind, start, end; code points, end exclusive)."""
    shared = docs.sparkSession.sparkContext.broadcast(ratio)
    return annotate(docs, OUTPUTS, lambda step: [span_lists(step.column(TEXT), shared.value)], keep)


def redacted_text(texts: pa.Array, ratio: np.ndarray) -> pa.Array:
    body, rows = utf8(texts)
    _, start, end = all_spans(body, rows, ratio)
    start, end = merged(start, end)
    which = np.searchsorted(rows, start, side="right") - 1
    out = texts.to_pylist()
    raw = body.tobytes()
    for row in np.unique(which):
        parts, at = [], int(rows[row])
        for k in np.flatnonzero(which == row):
            parts += [raw[at : start[k]], MASK]
            at = int(end[k])
        out[row] = b"".join([*parts, raw[at : int(rows[row + 1])]]).decode()
    return pa.array(out, pa.string())


def redacted(docs: DataFrame, ratio: np.ndarray) -> DataFrame:
    """The same rows and columns with every span of `text` replaced by MASK; a null stays null."""
    shared = docs.sparkSession.sparkContext.broadcast(ratio)
    rows = annotate(docs, "text string", lambda step: [redacted_text(step.column(TEXT), shared.value)], tuple(docs.columns))
    return rows.select(*[f"`{c}`" for c in docs.columns])


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = scan(docs, train(docs))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def number(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"] != KINDS[3])
    return rows.select(
        "doc_id",
        *[number(k) for k in KINDS[:3]],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )
