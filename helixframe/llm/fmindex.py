"""An FM-index of integer sequences in numpy: suffix order, wavelet matrix, sampled positions.

The text is a set of runs, each closed by symbol 0; ends of runs are distinct and ordered by
place, so no match spans two runs. All searches work on whole arrays of patterns or rows.
"""

from __future__ import annotations

import numpy as np


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Positions of text in the order of their suffixes, each read up to its run's end.

    The first sort takes as many symbols as fit in 62 bits, then prefix doubling sorts only
    what is still tied.
    """
    n = len(text)
    bits = max(1, int(text.max()).bit_length())
    step = max(1, 62 // bits)
    ends = np.flatnonzero(text == 0)
    left = ends[np.searchsorted(ends, np.arange(n))] - np.arange(n)  # symbols before the run's end
    key = np.zeros(n, np.int64)
    padded = np.concatenate([text, np.zeros(step, text.dtype)])
    for k in range(step):
        key <<= bits
        key |= np.where(left > k, padded[k : k + n], 0)
    order = np.argsort(key, kind="stable")
    new = np.ones(n, bool)
    new[1:] = (key[order][1:] != key[order][:-1]) | (left[order][1:] < step)
    row, rank, h = np.arange(n), np.empty(n, np.int64), step
    head = np.maximum.accumulate(np.where(new, row, 0))
    rank[order] = head
    tied = np.flatnonzero(~new | ~np.append(new[1:], True))
    while len(tied):
        at = order[tied]
        pair = rank[at] * n + rank[at + h]
        by = np.argsort(pair, kind="stable")
        order[tied], pair = at[by], pair[by]
        fresh = np.ones(len(tied), bool)
        fresh[1:] = pair[1:] != pair[:-1]
        rank[order[tied]] = np.maximum.accumulate(np.where(fresh, tied, 0))
        tied = tied[~fresh | ~np.append(fresh[1:], True)]
        h *= 2
    return order


class Bits:
    """A bit array with constant-time counts of ones before a place."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        packed = np.packbits(np.concatenate([bits, np.zeros(-n % 64 + 64, bool)]), bitorder="little")
        self.words = packed.view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)

    def ones(self, i: np.ndarray) -> np.ndarray:
        below = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[i >> 6] + np.bitwise_count(self.words[i >> 6] & below)


class WaveletMatrix:
    """Ranks and accesses of any symbol in a few bit-array look-ups (one a bit of the alphabet)."""

    def __init__(self, seq: np.ndarray, n_symbols: int):
        self.levels, self.zeros = [], []
        self.bits = max(1, (n_symbols - 1).bit_length())
        for b in range(self.bits - 1, -1, -1):
            bit = (seq >> b & 1).astype(bool)
            self.levels.append(Bits(bit))
            self.zeros.append(int(len(seq) - bit.sum()))
            seq = np.concatenate([seq[~bit], seq[bit]])
        symbols = np.arange(n_symbols)
        self.start = self._down(symbols, np.zeros(n_symbols, np.int64))

    def _down(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for k, level in enumerate(self.levels):
            ones = level.ones(i)
            i = np.where(c >> (self.bits - 1 - k) & 1, self.zeros[k] + ones, i - ones)
        return i

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often c occurs before place i."""
        return self._down(c, i) - self.start[c]

    def access_rank(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at i, and how often it occurs before."""
        c = np.zeros(len(i), np.int64)
        for k, level in enumerate(self.levels):
            bit = level.get(i).astype(np.int64)
            ones = level.ones(i)
            c = c << 1 | bit
            i = np.where(bit == 1, self.zeros[k] + ones, i - ones)
        return c, i - self.start[c]


class FMIndex:
    def __init__(self, text: np.ndarray, n_symbols: int, sample: int = 16):
        """text: symbols 1 .. n_symbols-1 in runs that each end with 0, which is the last symbol too."""
        order = suffix_order(text)
        before = text[order - 1]  # of place 0 this is the last symbol, an end
        self.counts = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=n_symbols))])
        self.wavelet = WaveletMatrix(before, n_symbols)
        kept = (order % sample == 0) | (before == 0)  # no walk leaves its run
        self.sampled, self.places = Bits(kept), order[kept]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of the patterns (rows of a matrix, left-aligned), by backward search."""
        lo, hi = np.zeros(len(patterns), np.int64), np.zeros(len(patterns), np.int64)
        last = patterns[np.arange(len(patterns)), lengths - 1]
        lo[:], hi[:] = self.counts[last], self.counts[last + 1]
        for k in range(2, patterns.shape[1] + 1):
            live = np.flatnonzero((lengths >= k) & (lo < hi))
            if not len(live):
                break
            c = patterns[live, lengths[live] - k]
            lo[live] = self.counts[c] + self.wavelet.rank(c, lo[live])
            hi[live] = self.counts[c] + self.wavelet.rank(c, hi[live])
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text places of rows, by steps back to the nearest sampled place."""
        out, walked, at = np.empty(len(rows), np.int64), np.zeros(len(rows), np.int64), np.arange(len(rows))
        while len(rows):
            hit = self.sampled.get(rows) == 1
            out[at[hit]] = self.places[self.sampled.ones(rows[hit])] + walked[hit]
            rows, at, walked = rows[~hit], at[~hit], walked[~hit] + 1
            if len(rows):
                c, r = self.wavelet.access_rank(rows)
                rows = self.counts[c] + r
        return out
