"""Token counts of a byte-level BPE vocabulary with word ends, by array merging.

Pre-tokens of a step of whole texts are cut with array masks over code points; each
distinct one is merged once. Merging is rank-synchronous: all pre-tokens lie in one
ragged array, every round finds each sequence's lowest-rank pair with one segmented
minimum, replaces all its non-overlapping occurrences from the left, and drops the
sequences that have no pair left; what survives is counted. That equals merging one
pair after the other as long as every token is made by one merge, from parts made by
earlier merges; `Vocabulary` checks this and otherwise merges the leftmost pair only.

The rules of normalising and splitting are those the vocabulary file names: NFC, white
space, lower case per character, contractions, letters, single digits, the rest. Code
points that Python's Unicode tables don't know (the library's are newer) send their
whole text to the library itself. Special strings in a text count as one token each,
as is the library's default.

Cases: null and empty texts have 0 bytes and 0 tokens; equal rows get equal results."""

from __future__ import annotations

import json
import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from ledgerline.llm.rows import TEXT, annotate, table
from ledgerline.llm.textwords import Words, utf8

LIMIT = 2048
NO_PAIR = np.int32(2**31 - 1)
#: Distinct pre-tokens whose counts a Python worker remembers, 16 bytes each.
REMEMBERED = 2_000_000
SPACE, LETTER, NUMBER, OTHER, UNKNOWN = range(5)
OUTPUTS = "n_bytes bigint, n_tokens bigint, over_limit boolean"


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_characters() -> list[str]:
    """The printable character that stands for each byte: itself where it is one, else from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


class Vocabulary:
    """Merge ranks as sorted arrays, and the file's text for the library."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            self.file = f.read()
        told = json.loads(self.file)
        model, ids = told["model"], told["model"]["vocab"]
        suffix = model["end_of_word_suffix"] or ""
        self.specials = [t["content"] for t in told["added_tokens"]]
        chars = byte_characters()
        self.inner = np.array([ids[c] for c in chars], np.int64)
        self.last = np.array([ids[c + suffix] for c in chars], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        made = [a + b for a, b in pairs]
        first = {t: r for r, t in reversed(list(enumerate(made)))}
        self.whole_rounds = len(first) == len(made) and all(
            first.get(x, -1) < r for r, pair in enumerate(pairs) for x in pair
        )
        self.size = max(ids.values()) + 1
        key = np.array([ids[a] * self.size + ids[b] for a, b in pairs], np.int64)
        self.order = np.argsort(key, kind="stable").astype(np.int32)
        self.pair = key[self.order]
        self.made = np.array([ids[t] for t in made], np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        return np.where(self.pair[at] == key, self.order[at], NO_PAIR)


def surviving(vocabulary: Vocabulary, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Number of tokens of each non-empty byte span data[start:end]."""
    out = np.zeros(len(start), np.int64)
    if not len(start):
        return out
    length = end - start
    first = np.concatenate([[0], np.cumsum(length)])
    seq = np.repeat(np.arange(len(start)), length)
    raw = data[np.arange(first[-1]) - first[:-1][seq] + start[seq]]
    ids = vocabulary.inner[raw]
    ids[first[1:] - 1] = vocabulary.last[raw[first[1:] - 1]]
    rank = np.full(len(ids), NO_PAIR, np.int32)
    inner = np.flatnonzero(seq[1:] == seq[:-1])
    rank[inner] = vocabulary.ranks(ids[inner], ids[inner + 1])
    while len(ids):
        begins = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
        sizes = np.diff(np.r_[begins, len(seq)])
        lowest = np.minimum.reduceat(rank, begins)
        ended = lowest == NO_PAIR
        if ended.any():
            out[seq[begins[ended]]] = sizes[ended]
            going = np.repeat(~ended, sizes)
            ids, seq, rank = ids[going], seq[going], rank[going]
            if not len(ids):
                break
            begins, sizes = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]]), sizes[~ended]
            lowest = lowest[~ended]
        hit = np.flatnonzero(rank == np.repeat(lowest, sizes))
        if vocabulary.whole_rounds:
            near = np.r_[False, hit[1:] == hit[:-1] + 1]  # overlaps its predecessor: keep every other one of a run
            at = np.arange(len(hit))
            hit = hit[(at - np.maximum.accumulate(np.where(near, 0, at))) % 2 == 0]
        else:
            hit = hit[np.r_[True, seq[hit[1:]] != seq[hit[:-1]]]]
        ids[hit] = vocabulary.made[rank[hit]]
        gone = np.zeros(len(ids), dtype=bool)
        gone[hit + 1] = True
        stale = np.zeros(len(ids), dtype=bool)
        stale[hit] = True
        stale[np.maximum(hit - 1, 0)] = True
        stale[np.maximum(hit - 2, 0)] = True  # the left neighbour's second half may have gone in the same round
        ids, seq, rank, stale = ids[~gone], seq[~gone], rank[~gone], np.flatnonzero(stale[~gone])
        rank[stale] = NO_PAIR
        stale = stale[stale + 1 < len(ids)]
        stale = stale[seq[stale] == seq[stale + 1]]
        rank[stale] = vocabulary.ranks(ids[stale], ids[stale + 1])
    return out


@cache
def character_classes() -> np.ndarray:
    """Class of every code point."""
    out = np.full(0x110000, OTHER, np.uint8)
    for code in range(0x110000):
        kind = unicodedata.category(chr(code))
        if kind[0] == "L":
            out[code] = LETTER
        elif kind[0] == "N":
            out[code] = NUMBER
        elif kind == "Cn":
            out[code] = UNKNOWN
        elif kind[0] == "Z" or kind == "Cc":
            out[code] = SPACE if regex.fullmatch(r"\s", chr(code)) else OTHER
    return out


def pretokens(texts: list[str]) -> tuple[Words, np.ndarray]:
    """(the pre-tokens of normalised texts, marks of texts with unknown code points)."""
    joined = "\n".join([*texts, ""])
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    size = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    rows = np.concatenate([[0], np.cumsum(size)])
    kind = character_classes()[codes]
    unknown = np.add.reduceat((kind == UNKNOWN).astype(np.int64), rows[:-1]) > 0 if len(texts) else np.zeros(0, bool)
    begins = kind != SPACE
    begins[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)
    quote = np.flatnonzero((codes == 0x27) & begins)
    if len(quote):
        quote = quote[kind[quote + 1] == LETTER]  # the text ends in a space, so there is a next one
        one, two = codes[quote + 1], codes[np.minimum(quote + 2, len(codes) - 1)]
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        for marks, n in ((short, 1), (long, 2)):
            at = quote[marks]
            begins[at + 1] = False
            after = at + 1 + n
            begins[after[kind[after] == LETTER]] = True
    ends = kind != SPACE
    ends[:-1] &= begins[1:] | (kind[1:] == SPACE)
    width = 1 + (codes >= 0x80).astype(np.int64) + (codes >= 0x800) + (codes >= 0x10000)
    at = np.concatenate([[0], np.cumsum(width)])
    data = np.zeros(at[-1] + 8, np.uint8)
    data[: at[-1]] = np.frombuffer(joined.encode("utf-8", "surrogatepass"), np.uint8)
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return Words(data, at[rows], at[start], at[end], np.searchsorted(start, rows)), unknown


class Counter:
    """Counts tokens of texts; remembers the counts of pre-tokens seen before."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary = vocabulary
        self.known, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.library = None

    def by_library(self, text: str) -> int:
        from tokenizers import Tokenizer

        self.library = self.library or Tokenizer.from_str(self.vocabulary.file)
        return len(self.library.encode(text, add_special_tokens=False).ids)

    def of_distinct(self, words: Words, keys: np.ndarray, example: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.known, keys)
        found = np.zeros(len(keys), dtype=bool)
        if len(self.known):
            found = self.known[np.minimum(at, len(self.known) - 1)] == keys
        out = np.zeros(len(keys), np.int64)
        out[found] = self.counts[at[found]]
        new = np.flatnonzero(~found)
        out[new] = surviving(self.vocabulary, words.data, words.start[example[new]], words.end[example[new]])
        if len(self.known) + len(new) > REMEMBERED:
            self.known, self.counts = keys, out
        else:
            merged = np.argsort(both := np.concatenate([self.known, keys[new]]), kind="stable")
            self.known, self.counts = both[merged], np.concatenate([self.counts, out[new]])[merged]
        return out

    def count(self, texts: list[str]) -> np.ndarray:
        parts, owner, special = [], [], np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            pieces = [text]
            for mark in self.vocabulary.specials:
                if mark in text:
                    special[i] += sum(p.count(mark) for p in pieces)
                    pieces = [q for p in pieces for q in p.split(mark)]
            for p in pieces:
                parts.append(unicodedata.normalize("NFC", p).replace("Σ", "σ").lower())
                owner.append(i)
        words, unknown = pretokens(parts)
        out = special
        if len(words.start):
            keys, example, inverse = np.unique(words.keys(), return_index=True, return_inverse=True)
            each = self.of_distinct(words, keys, example)[inverse]
            sums = np.diff(np.concatenate([[0], np.cumsum(each)])[words.first])
            out = out + np.bincount(owner, sums, minlength=len(texts)).astype(np.int64)
        for i in {owner[k] for k in np.flatnonzero(unknown)}:
            out[i] = self.by_library(texts[i])
        return out


def token_counts(
    docs: DataFrame, path: str | None = None, keep: tuple[str, ...] = ("doc_id",), limit: int = LIMIT
) -> DataFrame:
    """Bytes, tokens and whether there are more than `limit` tokens, for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(path or vocabulary_path()))
    counters: list[Counter] = []

    def fill(step: pa.RecordBatch) -> list:
        if not counters:
            counters.append(Counter(shared.value))
        _, at = utf8(step.column(TEXT))
        tokens = counters[0].count([t or "" for t in step.column(TEXT).to_pylist()])
        return [np.diff(at), tokens, tokens > limit]

    return annotate(docs, OUTPUTS, fill, keep, most=4 << 20)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
