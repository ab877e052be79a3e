"""FM-index over an array of symbols: backward search on wavelet-matrix ranks.

All queries of a call advance together, one array operation a level."""

from __future__ import annotations

import numpy as np

SAMPLE = 16  # text positions between stored suffix positions


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of the suffixes of a text that ends in a unique smallest symbol.

    Prefix doubling that re-sorts only suffixes still tied, so long copies cost rounds,
    not sorts of everything."""
    n = len(text)
    order = np.argsort(text, kind="stable")
    starts = np.r_[True, text[order[1:]] != text[order[:-1]]]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(starts, np.arange(n), 0))
    tied = order[~(starts & np.r_[starts[1:], True])]
    step = 1
    while len(tied):
        key = rank[tied] * (n + 1) + rank[np.minimum(tied + step, n - 1)]
        by = np.argsort(key, kind="stable")
        tied, key = tied[by], key[by]
        old = rank[tied]
        at = np.arange(len(tied))
        group = np.maximum.accumulate(np.where(np.r_[True, old[1:] != old[:-1]], at, 0))
        starts = np.r_[True, key[1:] != key[:-1]]
        rank[tied] = np.maximum.accumulate(np.where(starts, old + at - group, 0))
        tied = tied[~(starts & np.r_[starts[1:], True])]
        step *= 2
    out = np.empty(n, np.int64)
    out[rank] = np.arange(n)
    return out


class WaveletMatrix:
    """Ranks of symbols in an array: one bit of every symbol a level, zeros sorted first."""

    def __init__(self, symbols: np.ndarray, top: int) -> None:
        self.bits = max(1, int(top).bit_length())
        self.ones, self.zeros = [], []
        for level in reversed(range(self.bits)):
            bit = (symbols >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit, dtype=np.int32)]))
            self.zeros.append(int(len(symbols) - self.ones[-1][-1]))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    def _down(self, level: int, bit: np.ndarray, at: np.ndarray) -> np.ndarray:
        ones = self.ones[level][at]
        return np.where(bit == 1, self.zeros[level] + ones, at - ones)

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before position `at`."""
        low = np.zeros_like(at)
        for level in range(self.bits):
            bit = (symbol >> (self.bits - 1 - level)) & 1
            low, at = self._down(level, bit, low), self._down(level, bit, at)
        return at - low

    def symbol(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros_like(at)
        for level in range(self.bits):
            bit = (self.ones[level][at + 1] - self.ones[level][at]).astype(np.int64)
            out, at = out * 2 + bit, self._down(level, bit, at)
        return out


class FmIndex:
    """Of a text of symbols 1 to `top`; its end is marked by a 0 of its own."""

    def __init__(self, text: np.ndarray, top: int) -> None:
        text = np.concatenate([text.astype(np.int64), [0]])
        positions = suffix_array(text)
        last = text[positions - 1]
        self.size = len(text)
        self.ranks = WaveletMatrix(last, top)
        counts = np.bincount(text, minlength=top + 1)
        self.before = np.concatenate([[0], np.cumsum(counts)])
        stored = positions % SAMPLE == 0
        self.stored, self.at = np.concatenate([[0], np.cumsum(stored)]), positions[stored]

    def _step(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self.before[symbol] + self.ranks.rank(symbol, at)

    def search(self, phrases: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row interval of each phrase; row p of `phrases` has length[p] symbols from the left."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.size, np.int64)
        for back in range(phrases.shape[1]):
            go = np.flatnonzero((back < length) & (low < high))
            symbol = phrases[go, length[go] - 1 - back]
            low[go], high[go] = self._step(symbol, low[go]), self._step(symbol, high[go])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text position of each row's suffix: walk back to the next stored position."""
        out, walk, step = np.empty(len(rows), np.int64), rows.copy(), 0
        open_ = np.arange(len(rows))
        while len(open_):
            rank = self.stored[walk]
            found = self.stored[walk + 1] > rank
            out[open_[found]] = self.at[rank[found]] + step
            open_, walk = open_[~found], walk[~found]
            walk = self._step(self.ranks.symbol(walk), walk)
            step += 1
        return out
