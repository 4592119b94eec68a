"""FM-index of a sequence of word numbers: suffix array, wavelet matrix, sampled positions.

All steps run over whole arrays: every phrase takes its next backward step, and every
occurrence its next step towards a sampled position, in one numpy call.
"""

from __future__ import annotations

import numpy as np

SAMPLE = 8


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of all suffixes, by doubling the number of symbols compared.

    The last symbol must be smaller than all others. Only suffixes still tied are
    sorted again.
    """
    n = len(text)
    bits = max(1, int(text.max()).bit_length())
    width = max(1, 62 // bits)
    key = np.zeros(n, dtype=np.int64)
    for i in range(min(width, n)):
        key[: n - i] += text[i:].astype(np.int64) << (bits * (width - 1 - i))
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    first = np.flatnonzero(np.concatenate(([True], sorted_key[1:] != sorted_key[:-1])))
    # A suffix's rank is the place of the first one it ties with.
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.repeat(first, np.diff(np.append(first, n)))
    while len(first) < n:
        sizes = np.diff(np.append(first, n))
        tied = np.flatnonzero(np.repeat(sizes > 1, sizes))
        group, suffix = rank[order[tied]], order[tied]
        later = suffix + width
        next_rank = np.where(later < n, rank[np.minimum(later, n - 1)] + 1, 0)
        again = np.lexsort((next_rank, group))
        suffix, group, next_rank = suffix[again], group[again], next_rank[again]
        order[tied] = suffix
        new = np.concatenate(([True], (group[1:] != group[:-1]) | (next_rank[1:] != next_rank[:-1])))
        starts = np.flatnonzero(new)
        rank[suffix] = np.repeat(tied[starts], np.diff(np.append(starts, len(tied))))
        single = np.flatnonzero(np.repeat(sizes == 1, sizes))
        first = np.sort(np.concatenate((single, tied[starts])))
        width *= 2
    return order


class BitRanks:
    """Bits with the number of ones before any place."""

    def __init__(self, bits: np.ndarray) -> None:
        packed = np.packbits(bits, bitorder="little")
        packed = np.concatenate((packed, np.zeros(16 - len(packed) % 8, dtype=np.uint8)))
        self.words = packed.view(np.uint64)
        counts = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.concatenate(([0], np.cumsum(counts)[:-1]))

    def get(self, i: np.ndarray) -> np.ndarray:
        return ((self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)).astype(np.int64)

    def ones(self, i: np.ndarray) -> np.ndarray:
        low = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[i >> 6] + np.bitwise_count(self.words[i >> 6] & low).astype(np.int64)


class WaveletMatrix:
    """Symbols by bit levels, from the highest; rank and access take one step per level."""

    def __init__(self, symbols: np.ndarray, largest: int) -> None:
        self.levels: list[tuple[int, BitRanks, int]] = []
        for shift in range(max(1, largest.bit_length()) - 1, -1, -1):
            bits = (symbols >> shift) & 1
            ones = bits == 1
            zeros = int(len(symbols) - np.count_nonzero(ones))
            self.levels.append((shift, BitRanks(bits.astype(np.uint8)), zeros))
            symbols = np.concatenate((symbols[~ones], symbols[ones]))
        alphabet = np.arange(largest + 1)
        self.start = self._descend(alphabet, np.zeros(largest + 1, dtype=np.int64))

    def _descend(self, symbols: np.ndarray, places: np.ndarray) -> np.ndarray:
        for shift, bits, zeros in self.levels:
            ones = bits.ones(places)
            places = np.where((symbols >> shift) & 1, zeros + ones, places - ones)
        return places

    def rank(self, symbols: np.ndarray, places: np.ndarray) -> np.ndarray:
        """How often each symbol stands before its place."""
        return self._descend(symbols, places) - self.start[symbols]

    def access_rank(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place and how often it stands before."""
        symbols = np.zeros(len(places), dtype=np.int64)
        for shift, bits, zeros in self.levels:
            bit, ones = bits.get(places), bits.ones(places)
            symbols |= bit << shift
            places = np.where(bit, zeros + ones, places - ones)
        return symbols, places - self.start[symbols]


class FMIndex:
    """Index of a text of numbers from 0; searched phrases must not hold the number 0."""

    def __init__(self, text: np.ndarray) -> None:
        # One more symbol, below all others, ends the text.
        shifted = np.append(text.astype(np.int64) + 1, 0)
        order = suffix_array(shifted)
        largest = int(shifted.max())
        self.n = len(shifted)
        self.wavelet = WaveletMatrix(shifted[order - 1], largest)
        counts = np.bincount(shifted, minlength=largest + 1)
        self.smaller = np.concatenate(([0], np.cumsum(counts)[:-1]))
        self.largest = largest
        sampled = order % SAMPLE == 0
        self.sampled = BitRanks(sampled.astype(np.uint8))
        self.positions = order[sampled]

    def ranges(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row of word numbers, the range of suffixes that begin with it."""
        low = np.zeros(len(phrases), dtype=np.int64)
        high = np.full(len(phrases), self.n, dtype=np.int64)
        alive = np.flatnonzero((phrases + 1 <= self.largest).all(axis=1))
        dead = np.ones(len(phrases), dtype=bool)
        dead[alive] = False
        for j in range(phrases.shape[1] - 1, -1, -1):
            symbols = phrases[alive, j] + 1
            low[alive] = self.smaller[symbols] + self.wavelet.rank(symbols, low[alive])
            high[alive] = self.smaller[symbols] + self.wavelet.rank(symbols, high[alive])
            alive = alive[low[alive] < high[alive]]
        high[dead] = low[dead]
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes, stepping back to the nearest sampled one."""
        out = np.empty(len(rows), dtype=np.int64)
        open_, steps = np.arange(len(rows)), 0
        rows = rows.copy()
        while len(open_):
            at_sample = self.sampled.get(rows) == 1
            done = rows[at_sample]
            out[open_[at_sample]] = self.positions[self.sampled.ones(done)] + steps
            open_, rows = open_[~at_sample], rows[~at_sample]
            if len(open_):
                symbols, before = self.wavelet.access_rank(rows)
                rows = self.smaller[symbols] + before
            steps += 1
        return out
