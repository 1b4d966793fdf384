"""An FM-index over integer symbols: suffix array, wavelet matrix over the BWT, sampled positions.

All operations take arrays, so thousands of patterns or rows advance together.
"""

from __future__ import annotations

import numpy as np

#: Every so many-th position of the text is kept for locating.
SAMPLE = 16


def suffix_order(rank: np.ndarray) -> np.ndarray:
    """Suffixes in ascending order, by prefix doubling of the groups that are still tied.

    rank: non-negative symbols of which the last of any tied run is unique, so no suffix runs off the end.
    """
    order = np.argsort(rank, kind="stable")
    sorted_ranks = rank[order]
    first = np.r_[True, sorted_ranks[1:] != sorted_ranks[:-1]] if len(order) else np.zeros(0, bool)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
    slots, depth = np.arange(len(order)), 1
    while True:
        group = rank[order[slots]]
        tied = np.zeros(len(slots), bool)
        same = group[1:] == group[:-1]
        tied[1:] |= same
        tied[:-1] |= same
        slots, group = slots[tied], group[tied]
        if not len(slots):
            return order
        at = order[slots]
        later = rank[at + depth]
        by = np.lexsort((later, group))
        order[slots] = at = at[by]
        later = later[by]
        new = np.r_[True, (group[1:] != group[:-1]) | (later[1:] != later[:-1])]
        rank[at] = np.maximum.accumulate(np.where(new, slots, 0))
        depth *= 2


class Bits:
    """A bit vector with rank in constant time."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.r_[0, np.cumsum(np.bitwise_count(self.words), dtype=np.int64)[:-1]]

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before position i."""
        word, bit = i >> 6, (i & 63).astype(np.uint64)
        return self.before[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << bit) - np.uint64(1)))

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)


class WaveletMatrix:
    """The wavelet tree of a sequence, laid out level by level."""

    def __init__(self, seq: np.ndarray, n_symbols: int):
        self.depth = max(1, int(n_symbols - 1).bit_length())
        self.levels = []
        for bit in range(self.depth - 1, -1, -1):
            ones = (seq >> bit) & 1
            self.levels.append((bit, Bits(ones), int(len(seq) - ones.sum())))
            seq = np.concatenate([seq[ones == 0], seq[ones == 1]])
        self.start = self._down(np.arange(n_symbols), np.zeros(n_symbols, np.int64))

    def _down(self, symbols: np.ndarray, i: np.ndarray) -> np.ndarray:
        for bit, bits, zeros in self.levels:
            ones = bits.rank(i)
            i = np.where((symbols >> bit) & 1, zeros + ones, i - ones)
        return i

    def rank(self, symbols: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each position."""
        return self._down(symbols, i) - self.start[symbols]

    def access(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols at the positions, and their occurrences before."""
        symbols = np.zeros(len(i), np.int64)
        for bit, bits, zeros in self.levels:
            one = bits.get(i).astype(bool)
            ones = bits.rank(i)
            symbols |= one.astype(np.int64) << bit
            i = np.where(one, zeros + ones, i - ones)
        return symbols, i - self.start[symbols]


class FmIndex:
    """Over a text of symbols in which 0 separates: no pattern contains it, and no two separators are equal."""

    def __init__(self, text: np.ndarray, n_symbols: int):
        breaks = text == 0
        n_breaks = int(breaks.sum())
        unique = np.where(breaks, np.cumsum(breaks) - 1, text + n_breaks)
        order = suffix_order(unique)
        bwt = np.where(order > 0, text[order - 1], 0)
        self.counts = np.r_[0, np.cumsum(np.bincount(text, minlength=n_symbols))]
        self.tree = WaveletMatrix(bwt, n_symbols)
        kept = (order % SAMPLE == 0) | (bwt == 0)  # so no walk passes a separator
        self.kept, self.samples = Bits(kept), order[kept]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The row intervals of patterns, right-aligned in the columns, by backward search."""
        last = patterns[:, -1]
        low, high = self.counts[last], self.counts[last + 1]
        for back in range(2, patterns.shape[1] + 1):
            on = np.flatnonzero((lengths >= back) & (high > low))
            if not len(on):
                break
            symbol = patterns[on, -back]
            low[on] = self.counts[symbol] + self.tree.rank(symbol, low[on])
            high[on] = self.counts[symbol] + self.tree.rank(symbol, high[on])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of the rows: walk back until a sampled one."""
        out, steps, open_ = np.empty(len(rows), np.int64), 0, np.arange(len(rows))
        while len(open_):
            done = self.kept.get(rows).astype(bool)
            out[open_[done]] = self.samples[self.kept.rank(rows[done])] + steps
            open_, rows = open_[~done], rows[~done]
            symbol, before = self.tree.access(rows)
            rows = self.counts[symbol] + before
            steps += 1
        return out
