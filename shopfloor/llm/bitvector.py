"""Bit vectors with rank, and a wavelet matrix of small symbols on top of
them; all queries take arrays of positions.  Used inside tasks."""

from __future__ import annotations

import numpy as np

_ONE = np.uint64(1)


class Bits:
    """Bits in 64-bit words; ``rank(i)`` counts the ones before position i."""

    def __init__(self, words: np.ndarray):
        self.words = np.append(words, np.uint64(0))             # a word for rank(n)
        self.before = np.zeros(len(self.words), np.int64)
        np.cumsum(np.bitwise_count(words), out=self.before[1:])

    @classmethod
    def of(cls, flags: np.ndarray) -> Bits:
        packed = np.packbits(flags, bitorder="little")
        return cls(np.concatenate([packed, np.zeros(-len(packed) % 8, np.uint8)]).view("<u8"))

    def rank(self, i: np.ndarray) -> np.ndarray:
        word, bit = i >> 6, (i & 63).astype(np.uint64)
        return self.before[word] + np.bitwise_count(self.words[word] & ((_ONE << bit) - _ONE))

    def test(self, i: np.ndarray) -> np.ndarray:
        return ((self.words[i >> 6] >> (i & 63).astype(np.uint64)) & _ONE).astype(bool)


class WaveletMatrix:
    """Symbols below 2 ** ``depth``: one bit vector a level, highest bit first;
    each level keeps the order of the one before, zeros in front of ones."""

    def __init__(self, symbols: np.ndarray, depth: int):
        self.n, self.depth, self.levels = len(symbols), depth, []
        for k in reversed(range(depth)):
            ones = (symbols >> k & 1).astype(bool)
            self.levels.append((Bits.of(ones), self.n - int(np.count_nonzero(ones))))
            symbols = np.concatenate([symbols[~ones], symbols[ones]])

    def rank(self, symbol: int, i: np.ndarray) -> np.ndarray:
        """How often ``symbol`` occurs before each position of ``i``."""
        first, at = np.zeros(1, np.int64), i
        for k, (bits, zeros) in zip(reversed(range(self.depth)), self.levels):
            ones_first, ones_at = bits.rank(first), bits.rank(at)
            first, at = (zeros + ones_first, zeros + ones_at) if symbol >> k & 1 else (first - ones_first, at - ones_at)
        return at - first

    def rank_of(self, symbols, i: np.ndarray) -> np.ndarray:
        """How many of ``symbols`` occur before each position: a sum of ranks."""
        return sum(self.rank(s, i) for s in symbols)

    def select(self, symbols, k: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """For each ``k`` the smallest position in [low, high] with at least ``k`` of
        ``symbols`` before it (``high`` if there is none), by bisection on ranks."""
        low, high = low.copy(), high.copy()
        while (open_ := low < high).any():
            middle = (low + high) >> 1
            enough = self.rank_of(symbols, middle) >= k
            high = np.where(open_ & enough, middle, high)
            low = np.where(open_ & ~enough, middle + 1, low)
        return low
