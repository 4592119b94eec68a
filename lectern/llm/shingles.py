"""Word shingles of many texts as sorted arrays of 64-bit hashes, and their global order."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row

from lectern.llm.common import BASE, BY_SPACE, chunks, mix, stored, text_bytes, word_hashes

WORDS = 5
# Counters of the order, and the pieces they travel in. Fixed, whatever the corpus.
COUNTERS = 1 << 22
PIECES = 128
# Counts below this are told apart, larger ones by eighths of a power of two.
FINE = 16
# Bits of a filter: 16 MB, whatever the corpus.
BITMAP_BITS = 1 << 27


def shingle_sets(texts: list[bytes]) -> Iterator[np.ndarray]:
    """Per text the sorted distinct hashes of its runs of five words; of fewer words, all as one."""
    factor = np.uint64(BASE)
    for begin, end in chunks(texts):
        words, at = word_hashes(texts[begin:end], BY_SPACE)
        runs = np.zeros(max(len(words) - WORDS + 1, 0), dtype=np.uint64)
        for k in range(WORDS if len(runs) else 0):
            runs = runs * factor + words[k : k + len(runs)]
        runs = mix(runs)
        for i in range(end - begin):
            first, last = int(at[i]), int(at[i + 1])
            if last - first >= WORDS:
                yield np.unique(runs[first : last - WORDS + 1])
            elif last > first:
                whole = np.zeros(1, dtype=np.uint64)
                for word in words[first:last]:
                    whole = whole * factor + word
                yield mix(whole + np.uint64(last - first))
            else:
                yield np.zeros(0, dtype=np.uint64)


def signature(hashes: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for the set: equal for equal sets."""
    one = np.add.reduce(mix(hashes + np.uint64(1)))
    two = np.bitwise_xor.reduce(mix(hashes ^ np.uint64(0xA0761D6478BD642F)))
    ends = mix(np.array([one, two + np.uint64(len(hashes))], dtype=np.uint64))
    return int(ends[0]), int(ends[1])


def in_bitmap(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    low = (hashes & np.uint64(BITMAP_BITS - 1)).astype(np.int64)
    return ((bits[low >> 3] >> (low & 7).astype(np.uint8)) & 1).astype(bool)


def set_bits(bits: np.ndarray, places: np.ndarray) -> None:
    """Set bits at sorted places."""
    if len(places):
        at = places >> 3
        first = np.flatnonzero(np.diff(at, prepend=-1))
        masks = np.left_shift(np.uint8(1), (places & 7).astype(np.uint8))
        bits[at[first]] |= np.bitwise_or.reduceat(masks, first)


class Seen:
    """Which places of a filter were met once at least, and which twice at least."""

    def __init__(self, size: int) -> None:
        self.once, self.twice = np.zeros(size, dtype=np.uint8), np.zeros(size, dtype=np.uint8)

    def add(self, hashes: np.ndarray) -> None:
        places = np.sort((hashes & np.uint64(BITMAP_BITS - 1)).astype(np.int64))
        fresh = np.diff(places, prepend=-1) != 0
        known = in_bitmap(self.once, places.view(np.uint64))
        repeated = places[~fresh | known]
        set_bits(self.twice, repeated)
        set_bits(self.once, places[fresh & ~known])

    def merge(self, once: np.ndarray, twice: np.ndarray) -> None:
        self.twice |= twice | (self.once & once)
        self.once |= once


PIECE = "piece int, counts binary, once binary, twice binary"


def count_pieces(text: str):
    """For `mapInArrow`: how many texts of the partition hold shingles of each counter, and
    which places of the filter its texts meet once and twice, in pieces.

    A set that the partition holds again is met once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(COUNTERS, dtype=np.int32)
        met, known = Seen(BITMAP_BITS // 8), set()
        for batch in batches:
            fresh = []
            for hashes in shingle_sets(text_bytes(batch.column(text))):
                name = signature(hashes)
                if name not in known:
                    known.add(name)
                    fresh.append(hashes)
            if fresh:
                hashes = np.concatenate(fresh)
                # No second table of counters for every batch.
                slots, times = np.unique((hashes & np.uint64(COUNTERS - 1)).astype(np.int32), return_counts=True)
                counts[slots] += times.astype(np.int32)
                met.add(hashes)
        packed = [
            pa.array([zlib.compress(p.tobytes(), 1) for p in np.split(values, PIECES)], pa.binary())
            for values in (counts, met.once, met.twice)
        ]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(PIECES, dtype=np.int32)), *packed],
            names=["piece", "counts", "once", "twice"],
        )

    return run


def grades(counts: np.ndarray) -> np.ndarray:
    """Counts in a byte each: a larger count never has a smaller grade."""
    part, power = np.frexp(counts.astype(np.float64))
    coarse = FINE + 8 * (power - 5) + np.floor(16 * part - 8)
    return np.where(counts < FINE, counts, np.minimum(coarse, 255)).astype(np.uint8)


def graded(grade: np.ndarray) -> np.ndarray:
    """The smallest count of each grade."""
    step = np.maximum(grade - FINE, 0)
    return np.where(grade < FINE, grade, np.ldexp(0.5 + step % 8 / 16, step // 8 + 5))


def add_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum pieces that come sorted by number and grade the sums, one sum in memory at a time."""

    def packed(piece: int, total: np.ndarray, met: Seen) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict(
            {
                "piece": pa.array([piece], pa.int32()),
                "grades": pa.array([grades(total).tobytes()], pa.binary()),
                "twice": pa.array([met.twice.tobytes()], pa.binary()),
            }
        )

    piece = total = met = None
    for batch in batches:
        for number, *parts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            counts, once, twice = (zlib.decompress(part) for part in parts)
            if number != piece:
                if piece is not None:
                    yield packed(piece, total, met)
                piece, total = number, np.zeros(COUNTERS // PIECES, dtype=np.int64)
                met = Seen(BITMAP_BITS // 8 // PIECES)
            total += np.frombuffer(counts, dtype=np.int32)
            met.merge(np.frombuffer(once, dtype=np.uint8), np.frombuffer(twice, dtype=np.uint8))
    if piece is not None:
        yield packed(piece, total, met)


@dataclass
class Order:
    """A total order of all shingles: those of one set first, then about rarest first.

    A shingle whose place in the filter `met_twice` is unset belongs to one set only, so
    it can't be in any overlap. Counters and places that several shingles share, and counts
    of one grade, only make the order less sharp: any total order gives right results.
    `fragment` cuts the shingles of several sets into parts of about equal mass.
    """

    grade: np.ndarray
    met_twice: np.ndarray

    def __post_init__(self) -> None:
        # For each grade, the mass of all counters with less, and with the same.
        numbers = sum(np.bincount(part, minlength=256) for part in np.split(self.grade, PIECES))
        mass = graded(np.arange(256)) * numbers
        total = max(float(mass.sum()), 1.0)
        self.below, self.width = (np.cumsum(mass) - mass) / total, mass / total

    def slots(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes & np.uint64(COUNTERS - 1)).astype(np.int64)

    def shared(self, hashes: np.ndarray) -> np.ndarray:
        """Which of the hashes several sets may have."""
        return in_bitmap(self.met_twice, hashes)

    def sort(self, hashes: np.ndarray) -> np.ndarray:
        """The hashes, which come sorted, in the global order."""
        rank = np.where(self.shared(hashes), self.grade[self.slots(hashes)], np.uint8(0))
        return hashes[np.argsort(rank, kind="stable")]

    def fragment(self, hashes: np.ndarray, parts: int) -> np.ndarray:
        at = self.grade[self.slots(hashes)]
        within = hashes.astype(np.float64) / 2.0**64
        return np.minimum((parts * (self.below[at] + self.width[at] * within)).astype(np.int64), parts - 1)


def one_by_one(pieces: DataFrame, purpose: str) -> Iterator[Row]:
    """Rows stored first and brought to the driver by one plan, a partition at a time, so that it holds
    neither all rows beside what they become nor computes them more than once."""
    yield from stored(pieces, purpose).toLocalIterator()


def global_order(docs: DataFrame, text: str) -> Order:
    """Counted over all documents; the driver receives COUNTERS bytes and BITMAP_BITS bits, a fixed size."""
    pieces = docs.select(text).mapInArrow(count_pieces(text), PIECE)
    sums = (
        pieces.repartition("piece")
        .sortWithinPartitions("piece")
        .mapInArrow(add_pieces, "piece int, grades binary, twice binary")
    )
    grade = np.zeros(COUNTERS, dtype=np.uint8)
    twice = np.zeros(BITMAP_BITS // 8, dtype=np.uint8)
    for row in one_by_one(sums, "join-counts"):
        for whole, name in ((grade, "grades"), (twice, "twice")):
            size = len(whole) // PIECES
            whole[row["piece"] * size : (row["piece"] + 1) * size] = np.frombuffer(row[name], dtype=np.uint8)
    return Order(grade, twice)
