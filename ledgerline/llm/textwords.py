"""Words of a whole Arrow text column as arrays, without a Python object per word.

Every operator here that looks at words sees a batch of texts as one byte buffer:
word starts and ends come from a byte-class mask, and a word's 64-bit key from its
bytes taken eight at a time. Byte classes work on UTF-8 because every byte of a
character above U+007F is at least 0x80, so a class that holds all of those (or none)
never cuts a character."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that one step works on; a single longer text is a step of its own.
STEP_BYTES = 8 << 20

#: `[^\x20\x09-\x0D]+`
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`, after lower-casing A-Z
LETTERS = np.zeros(256, dtype=bool)
LETTERS[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: A-Z to a-z, all else unchanged
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

LOW_BYTES = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all text bytes, offsets of the rows in them); a null is an empty text."""
    if pa.types.is_null(column.type):
        column = column.cast(pa.string())
    if column.null_count:
        column = pc.fill_null(column, "")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    at = at.astype(np.int64)
    body = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return body, at - at[0]


def steps(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in order, cut so that a step holds at most `most` bytes of text or one row."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        _, at = utf8(batch.column(batch.schema.get_field_index(text)))
        row = 0
        while row < batch.num_rows:
            end = max(row + 1, int(np.searchsorted(at, at[row] + most, side="right")) - 1)
            yield batch.slice(row, min(end, batch.num_rows) - row)
            row = end


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


@dataclass
class Words:
    data: np.ndarray  # bytes of all texts, lower-cased on request, and 8 bytes of padding
    rows: np.ndarray  # offsets of the texts in data
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  # offsets of the texts in the words

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def row(self) -> np.ndarray:
        """The text that each word belongs to."""
        return np.repeat(np.arange(len(self.rows) - 1), self.counts)

    def keys(self) -> np.ndarray:
        """A 64-bit key of each word's bytes; equal words have equal keys."""
        view = np.ndarray(len(self.data) - 7, dtype="<u8", buffer=self.data, strides=(1,))
        length = self.end - self.start
        h = mix((view[self.start] & LOW_BYTES[np.minimum(length, 8)]) + length.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        done, rest = 8, np.flatnonzero(length > 8)
        while len(rest):
            part = view[self.start[rest] + done] & LOW_BYTES[np.minimum(length[rest] - done, 8)]
            h[rest] = mix(h[rest] * np.uint64(0x94D049BB133111EB) ^ part)
            done += 8
            rest = rest[length[rest] > done]
        return h

    def text(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def words_of(column: pa.Array, kind: np.ndarray, lower: bool = False) -> Words:
    body, rows = utf8(column)
    data = np.zeros(len(body) + 8, np.uint8)
    data[: len(body)] = LOWER[body] if lower else body
    inside = kind[data[: len(body)]]
    cut = np.zeros(len(body) + 1, dtype=bool)
    cut[rows] = True
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | cut[1:-1]
    ends[:-1] &= ~inside[1:] | cut[1:-1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return Words(data, rows, start, end, np.searchsorted(start, rows))


def window_keys(keys: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit key of every `size` consecutive words, those across texts included."""
    n = len(keys) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for j in range(size):
        h = h * np.uint64(0x9FB21C651E98DF25) + keys[j : j + n]
    return mix(h)


def window_starts(first: np.ndarray, size: int) -> np.ndarray:
    """Marks the words at which a window of `size` words of one text starts."""
    counts = np.diff(first)
    total = int(first[-1]) if len(first) else 0
    left = np.repeat(first[1:], counts) - np.arange(total)
    return left >= size


def merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of half-open spans as separate spans in order."""
    if len(start) == 0:
        return start, end
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    new = np.r_[True, start[1:] > reach[:-1]]
    at = np.flatnonzero(new)
    return start[at], reach[np.r_[at[1:] - 1, len(start) - 1]]


def code_points(body: np.ndarray) -> np.ndarray:
    """Number of code points before each byte, and in all at the end."""
    return np.concatenate([[0], np.cumsum((body & 0xC0) != 0x80)])
