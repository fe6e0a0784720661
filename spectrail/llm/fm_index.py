"""An FM-index over a sequence of integers: wavelet matrix, backward search and sampled suffix positions, all in numpy.

The sequence is made of segments that each follow a separator (symbol 0). Separators count as different from each other,
so no suffix comparison runs past the end of a segment, and no match crosses one.
"""

from __future__ import annotations

import numpy as np

#: Every position at a multiple of this, and every start of a segment, keeps its suffix position.
SAMPLE = 16


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """Sorted suffixes, by prefix doubling from keys of as many symbols as fit 62 bits."""
    n, gaps = len(seq), seq == 0
    rank = np.where(gaps, np.cumsum(gaps) - 1, seq.astype(np.int64) + int(gaps.sum()) - 1)
    bits = max(1, int(rank.max()).bit_length() + 1)
    key, width = rank + 1, 1
    while (width + 1) * bits <= 62:
        nxt = np.zeros(n, np.int64)
        nxt[: max(0, n - width)] = rank[width:] + 1
        key, width = (key << bits) | nxt, width + 1
    while True:
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate(([0], np.cumsum(ordered[1:] != ordered[:-1])))
        if rank[order[-1]] == n - 1:
            return order
        nxt = np.zeros(n, np.int64)
        if width < n:
            nxt[: n - width] = rank[width:] + 1
        key, width = rank * (n + 1) + nxt, width * 2


class _Bits:
    """A bit vector with ranks."""

    def __init__(self, bits: np.ndarray) -> None:
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words).astype(np.int64))))
        self.zeros = len(bits) - int(self.before[-1])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        below = self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))
        return self.before[word] + np.bitwise_count(below)

    def get(self, at: np.ndarray) -> np.ndarray:
        return ((self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).astype(np.int64)


class FmIndex:
    def __init__(self, seq: np.ndarray, symbols: int) -> None:
        """seq: int array that begins with 0; symbols: one more than the largest symbol."""
        self.n, self.symbols = len(seq), symbols
        order = suffix_array(seq)
        bwt = seq[order - 1].astype(np.int64)
        counts = np.bincount(seq, minlength=symbols)
        self.first = np.concatenate(([0], np.cumsum(counts)))[:symbols]
        levels = max(1, int(symbols - 1).bit_length())
        self.levels: list[_Bits] = []
        held = bwt
        for level in range(levels - 1, -1, -1):
            bit = (held >> level) & 1
            self.levels.append(_Bits(bit.astype(np.uint8)))
            held = np.concatenate((held[bit == 0], held[bit == 1]))
        self.start = self._down(np.arange(symbols), np.zeros(symbols, np.int64))
        starts = np.zeros(self.n, bool)
        starts[1:] = seq[:-1] == 0
        keep = (order % SAMPLE == 0) | starts[order] | (seq[order] == 0)
        self.marked, self.kept = _Bits(keep.astype(np.uint8)), order[keep]

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where the positions `at` come out below the wavelet matrix, on the way of each symbol."""
        for i, bits in enumerate(self.levels):
            ones = bits.rank(at)
            at = np.where((symbol >> (len(self.levels) - 1 - i)) & 1, bits.zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs in the transform before the position."""
        return self._down(symbol, at) - self.start[symbol]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """patterns: rows of equal length. (row, low, high) of the patterns that occur: backward search of all at once."""
        row = np.arange(len(patterns))
        low, high = np.zeros(len(row), np.int64), np.full(len(row), self.n, np.int64)
        for j in range(patterns.shape[1] - 1, -1, -1):
            symbol = patterns[row, j]
            low, high = self.first[symbol] + self.rank(symbol, low), self.first[symbol] + self.rank(symbol, high)
            found = low < high
            row, low, high = row[found], low[found], high[found]
            if not len(row):
                break
        return row, low, high

    def locate(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index into low, position) of every occurrence: steps back through the text to a kept suffix position."""
        size = high - low
        which = np.repeat(np.arange(len(low)), size)
        rows = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size) + low[which]
        out, open_, steps = np.zeros(len(rows), np.int64), np.arange(len(rows)), 0
        while len(open_):
            kept = self.marked.get(rows) == 1
            out[open_[kept]] = self.kept[self.marked.rank(rows[kept])] + steps
            rows, open_ = rows[~kept], open_[~kept]
            symbol, at = np.zeros(len(rows), np.int64), rows
            for bits in self.levels:
                bit, ones = bits.get(at), bits.rank(at)
                symbol, at = symbol * 2 + bit, np.where(bit == 1, bits.zeros + ones, at - ones)
            rows, steps = self.first[symbol] + at - self.start[symbol], steps + 1
        return which, out
