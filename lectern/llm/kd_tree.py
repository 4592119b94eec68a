"""K-d trees over vectors of small counts, with range searches in L1 distance pruned by boxes.

Counts above LEVELS are taken as LEVELS, which only shrinks distances, so that a range search finds
all it should. A count c becomes c set bits out of LEVELS; then the L1 distance of two vectors is
the number of bits that differ, and the distance to a box is the number of bits that its
lowest corner has and the vector lacks, or the vector has and its highest corner lacks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np

LEVELS = 4
# Pairs of vectors compared at once.
PAIRS_AT_ONCE = 1 << 20


def bits_of(counts: np.ndarray) -> np.ndarray:
    """Vectors as rows of 64-bit words; their dimensions must be a multiple of 16."""
    bits = counts[:, :, None] > np.arange(LEVELS, dtype=counts.dtype)
    return np.packbits(bits.reshape(len(counts), -1), axis=1).view(np.uint64)


def differing(a: np.ndarray) -> np.ndarray:
    """Set bits over the last axis."""
    return np.bitwise_count(a).sum(axis=-1, dtype=np.uint8)


@dataclass
class Node:
    low: np.ndarray
    high: np.ndarray
    rows: np.ndarray | None = None  # of a leaf of a tight tree
    cell: int = -1  # a leaf's number
    axis: int = -1
    cut: int = 0  # left is up to here
    children: tuple[Node, ...] = field(default=())


class KdTree:
    """`tight` boxes hold just the points; others reach as far as the splits leave room, so that
    points which were not there at building have a cell too."""

    def __init__(self, counts: np.ndarray, leaf: int, tight: bool):
        counts = np.minimum(counts, LEVELS).astype(np.uint8)
        self.cells_made = 0
        self.tight = tight
        self.bits = bits_of(counts) if tight else None
        dimensions = counts.shape[1]
        self.root = self._build(
            counts,
            np.arange(len(counts)),
            np.zeros(dimensions, dtype=np.uint8),
            np.full(dimensions, LEVELS, dtype=np.uint8),
            leaf,
        )

    def _build(self, counts: np.ndarray, rows: np.ndarray, low: np.ndarray, high: np.ndarray, leaf: int) -> Node:
        points, n = counts[rows], len(rows)
        if self.tight and n:
            low, high = points.min(axis=0), points.max(axis=0)
        node = Node(*bits_of(np.stack((low, high))))
        if n > leaf:
            # The split that parts the points most evenly.
            below = (points[:, :, None] <= np.arange(LEVELS, dtype=np.uint8)).sum(axis=0)
            axis, cut = np.unravel_index(np.argmin(np.abs(2 * below - n)), below.shape)
            if 0 < below[axis, cut] < n:
                node.axis, node.cut = int(axis), int(cut)
                left = points[:, axis] <= cut
                high_left, low_right = high.copy(), low.copy()
                high_left[axis], low_right[axis] = cut, cut + 1
                node.children = (
                    self._build(counts, rows[left], low, high_left, leaf),
                    self._build(counts, rows[~left], low_right, high, leaf),
                )
                return node
        node.rows = rows if self.tight else None
        node.cell, self.cells_made = self.cells_made, self.cells_made + 1
        return node

    def cells(self, counts: np.ndarray) -> np.ndarray:
        """The leaf that each vector belongs to."""
        counts = np.minimum(counts, LEVELS)
        out = np.empty(len(counts), dtype=np.int32)
        todo = [(self.root, np.arange(len(counts)))]
        while todo:
            node, rows = todo.pop()
            if not node.children:
                out[rows] = node.cell
                continue
            left = counts[rows, node.axis] <= node.cut
            todo += [(node.children[0], rows[left]), (node.children[1], rows[~left])]
        return out

    def reached(self, bits: np.ndarray, distance: int) -> Iterator[tuple[Node, np.ndarray]]:
        """(leaf, rows of the vectors whose ball of that L1 radius meets the leaf's box)."""
        todo = [(self.root, np.arange(len(bits)))]
        while todo:
            node, rows = todo.pop()
            near = bits[rows]
            rows = rows[differing(node.low & ~near) + differing(near & ~node.high) <= distance]
            if not len(rows):
                continue
            if node.children:
                todo += [(child, rows) for child in node.children]
            else:
                yield node, rows

    def within(self, bits: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (rows of the vectors, rows of the points) at most `distance` apart, block by block."""
        for leaf, rows in self.reached(bits, distance):
            points = self.bits[leaf.rows]
            step = max(1, PAIRS_AT_ONCE // max(1, len(points)))
            for a in range(0, len(rows), step):
                part = rows[a : a + step]
                near = bits[part]
                apart = np.zeros((len(part), len(points)), dtype=np.uint8)
                for word in range(bits.shape[1]):
                    apart += np.bitwise_count(near[:, word, None] ^ points[None, :, word])
                i, j = np.nonzero(apart <= distance)
                if len(i):
                    yield part[i], leaf.rows[j]
