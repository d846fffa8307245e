"""FM-index over words: wavelet matrix of the Burrows-Wheeler transform, backward search.

All searches of a batch go in step: a backward step is one array operation for every search
that is still running, so the index is used at array speed.
"""

from __future__ import annotations

import numpy as np

from kestrel.llm.textarrays import runs


class BitRank:
    """Packed bits with a count per 64-bit word."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        packed = np.packbits(bits, bitorder="little")
        self.words = np.frombuffer(packed.tobytes() + bytes(16 - len(packed) % 8), "<u8")
        self.before = np.append(0, np.cumsum(np.bitwise_count(self.words), dtype=np.int64)).astype(np.int32)
        self.n, self.ones = n, int(self.before[-1])

    def ones_before(self, i: np.ndarray) -> np.ndarray:
        word = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)


class WaveletMatrix:
    """Counts of a symbol before a position, in one rank per bit of the symbol."""

    def __init__(self, symbols: np.ndarray, size: int):
        self.bits = max(1, int(size - 1).bit_length())
        self.levels, rest = [], symbols
        for level in range(self.bits - 1, -1, -1):
            one = (rest >> level) & 1 > 0
            self.levels.append((level, BitRank(one), len(rest) - int(one.sum())))
            rest = np.concatenate([rest[~one], rest[one]])
        self.start = np.zeros(size, np.int64)  # where a symbol's run begins behind the last level
        edge = runs(rest)[:-1]
        self.start[rest[edge]] = edge

    def count(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of ``symbol`` before position ``at``."""
        for level, rank, zeros in self.levels:
            ones = rank.ones_before(at)
            at = np.where((symbol >> level) & 1 > 0, zeros + ones, at - ones)
        return at - self.start[symbol]


def suffix_array(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order, by prefix doubling; a suffix that is a beginning of another comes first."""
    n = len(text)
    rank = text.astype(np.int64)
    width = 1
    while True:
        key = np.zeros(n, np.int64)
        key[: n - width] = rank[width:] + 1
        key += rank * (n + int(text.max(initial=0)) + 2)
        order = np.argsort(key)
        new = np.empty(n, np.int64)
        edge = runs(key[order])
        new[order] = np.repeat(np.arange(len(edge) - 1), np.diff(edge))
        rank, width = new, 2 * width
        if len(edge) - 1 == n or width >= n:
            return order, rank


class FMIndex:
    """Index of a text of symbols 1 .. size - 1 (0 separates its parts and is never searched)."""

    def __init__(self, text: np.ndarray, size: int, threshold: int):
        text = np.append(text, 0)
        self.threshold, self.n = threshold, len(text)
        self.suffixes, rank = suffix_array(text)
        self.transform = WaveletMatrix(text[self.suffixes - 1], size)
        counts = np.bincount(text, minlength=size)
        self.first = np.cumsum(counts) - counts
        # bounds of the suffixes that share threshold - 1 symbols: where to go on from a whole match
        self.wide_lo, self.wide_hi = self._shared(text, threshold - 1)

    def _shared(self, text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.suffixes[:-1], self.suffixes[1:]
        padded = np.append(text, np.zeros(depth, text.dtype))
        live = np.arange(len(a))
        for k in range(depth):
            x = padded[a[live] + k]
            live = live[(x == padded[b[live] + k]) & (x != 0)]
        joined = np.zeros(self.n, bool)
        joined[live + 1] = True  # row shares its first symbols with the row before
        begin = np.flatnonzero(~joined)
        size = np.diff(np.append(begin, self.n))
        return np.repeat(begin, size), np.repeat(begin + size, size)

    def matches(self, text: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts of all stretches of ``threshold`` symbols of text[begin:end] that the index has.

        Returns (position in ``text``, first row, row after the last) of each. Matching
        statistics are kept up to the threshold: a whole match drops its last symbol and is
        extended to the left; where an extension fails, no stretch across it can match, and the
        search starts again to the left of the place where the failed match ended.
        """
        t = self.threshold
        lane = np.flatnonzero(end - begin >= t)
        at, left = end[lane] - 1, begin[lane]  # next symbol to prepend, where the lane's text begins
        size = np.zeros(len(lane), np.int64)
        lo, hi = np.zeros(len(lane), np.int64), np.full(len(lane), self.n)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(at):
            whole = size == t
            if whole.any():
                row = lo[whole]
                lo[whole], hi[whole] = self.wide_lo[row], self.wide_hi[row]
                size[whole] = t - 1
            symbol = text[at]
            both = self.transform.count(np.concatenate([symbol, symbol]), np.concatenate([lo, hi]))
            base = self.first[symbol]
            new_lo, new_hi = base + both[: len(at)], base + both[len(at):]
            ok = (new_hi > new_lo) & (symbol != 0)
            again = at + size - 1  # last symbol but one of the failed match
            at = np.where(ok, at - 1, np.where(size > 0, again, at - 1))
            lo, hi = np.where(ok, new_lo, 0), np.where(ok, new_hi, self.n)
            size = np.where(ok, size + 1, 0)
            hit = size == t
            if hit.any():
                found.append((at[hit] + 1, lo[hit], hi[hit]))
            go = at + 1 + np.minimum(size, t - 1) - left >= t
            at, left, size, lo, hi = at[go], left[go], size[go], lo[go], hi[go]
        if not found:
            none = np.empty(0, np.int64)
            return none, none, none
        return tuple(map(np.concatenate, zip(*found)))

    def earliest(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Smallest text position among the rows lo .. hi - 1 of each match (equal or disjoint)."""
        order = np.argsort(lo)
        edge = runs(lo[order])
        a, b = lo[order][edge[:-1]], hi[order][edge[:-1]]
        cut = np.column_stack([a, b]).ravel()
        low = np.minimum.reduceat(np.append(self.suffixes, self.n), cut)[::2] if len(a) else a
        out = np.empty(len(lo), np.int64)
        out[order] = np.repeat(low, np.diff(edge))
        return out
