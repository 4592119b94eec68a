"""Approximate nearest neighbours by a forest of random-projection trees.

Each tree splits all vectors at the median of a random projection, level by level, into
leaves of about LEAF vectors. A level's projection is the same for all nodes of a tree, so a
tree is a small matrix and one threshold per node. Medians are taken from a bounded sample
(SAMPLE_ROWS distinct vectors, those of least hash); every vector is then filed in its leaf
of every tree. A query walks all trees through one priority queue of the branches that it
did not take, nearest first, where a branch's distance is the sum of its squared margins.
It stops at a distance measured beforehand: for CALIBRATION vectors the true neighbours
among all rows are found by brute force, and the distance that covers TARGET of them is
taken. So the number of leaves adapts to data and size instead of being fixed. All vectors
of the visited leaves are then ranked by their exact distance.

What is fitted on the sample bounds the number of leaves (SAMPLE_ROWS / LEAST_SAMPLE), so
that beyond about a million distinct vectors leaves grow with the table, unless
SAMPLE_ROWS is raised. Results do not depend on it, only speed.

A vector that many rows share is one entry with the least ids of its rows, one more than
the neighbours asked for: no other row of it can be among the nearest, as ties go to
smaller ids. Queries with one vector are searched once.

Defined results: vectors that are null, zero, hold null or non-finite components, or have another
length than most vectors (of lengths equally frequent, the largest) take no part, nor do rows
without an id; rows with the query's id are the query's own; repeated rows count once; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.cells import meeting, met
from lectern.llm.common import stored

TREES = 8
LEAF = 128
SAMPLE_ROWS = 131_072
LEAST_SAMPLE = 16
CALIBRATION = 128
TARGET = 0.96
SEED = 20_240_611
# Points of one leaf in one task; larger leaves are dealt out.
MOST_POINTS = 4096


@dataclass(frozen=True)
class Forest:
    """Per tree a matrix of projections, one per level, and thresholds by node; node 1 is the root."""

    projections: np.ndarray  # trees x dimensions x depth
    thresholds: np.ndarray  # trees x 2**depth

    @property
    def depth(self) -> int:
        return self.projections.shape[2]

    def leaves(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf of every vector in every tree, trees x vectors."""
        out = np.empty((len(self.projections), len(vectors)), dtype=np.int32)
        for t, (directions, cuts) in enumerate(zip(self.projections, self.thresholds, strict=True)):
            shadow = vectors @ directions
            node = np.ones(len(vectors), dtype=np.int64)
            for level in range(self.depth):
                node = 2 * node + (shadow[:, level] >= cuts[node])
            out[t] = node - (1 << self.depth)
        return out

    def distances(self, queries: np.ndarray, leaves: np.ndarray) -> np.ndarray:
        """Least over all trees of the squared margins between a query and another vector's leaf.

        `leaves` is trees x queries: the leaf of each query's counterpart.
        """
        best = np.full(len(queries), np.inf)
        for t, (directions, cuts) in enumerate(zip(self.projections, self.thresholds, strict=True)):
            shadow = queries @ directions
            total = np.zeros(len(queries))
            for level in range(self.depth):
                place = leaves[t].astype(np.int64) + (1 << self.depth)
                node = place >> (self.depth - level)
                right = (place >> (self.depth - level - 1)) & 1
                margin = shadow[:, level] - cuts[node]
                total += np.where((margin >= 0) == (right == 1), 0.0, margin**2)
            best = np.minimum(best, total)
        return best

    def visits(self, query: np.ndarray, radius: float) -> list[tuple[int, int]]:
        """(tree, leaf) within the radius, nearest first, from one queue shared by all trees."""
        shadows = np.einsum("d,tdl->tl", query, self.projections).tolist()
        cuts, depth = self.thresholds, self.depth
        queue = [(0.0, t, 0, 1) for t in range(len(shadows))]
        found = []
        while queue:
            distance, t, level, node = heapq.heappop(queue)
            for level in range(level, depth):
                margin = shadows[t][level] - cuts[t, node]
                right = margin >= 0
                other = distance + margin * margin
                if other <= radius:
                    heapq.heappush(queue, (other, t, level + 1, 2 * node + (not right)))
                node = 2 * node + right
            found.append((t, int(node) - (1 << depth)))
        return found


def fit_forest(sample: np.ndarray, vectors: int, trees: int = TREES, leaf: int = LEAF) -> Forest:
    """Medians of the sample, for leaves of about `leaf` of all `vectors`."""
    wanted = max(1.0, vectors / leaf)
    allowed = max(1.0, len(sample) / LEAST_SAMPLE)
    depth = int(np.ceil(np.log2(min(wanted, allowed))))
    dimensions = sample.shape[1]
    rng = np.random.default_rng(SEED)
    projections = np.empty((trees, dimensions, depth))
    thresholds = np.zeros((trees, 1 << depth))
    for t in range(trees):
        # Orthogonal as far as there are dimensions, so that squared margins add up.
        squares = [np.linalg.qr(rng.standard_normal((dimensions, dimensions)))[0] for _ in range(-(-depth // dimensions))]
        projections[t] = np.concatenate([*squares, np.empty((dimensions, 0))], axis=1)[:, :depth]
        shadow = sample @ projections[t]
        node = np.ones(len(sample), dtype=np.int64)
        for level in range(depth):
            order = np.lexsort((shadow[:, level], node))
            sorted_node = node[order]
            begins = np.flatnonzero(np.diff(sorted_node, prepend=-1))
            middles = (begins + np.append(begins[1:], len(sample))) // 2
            thresholds[t, sorted_node[begins]] = shadow[order[middles], level]
            node = 2 * node + (shadow[:, level] >= thresholds[t, node])
    return Forest(projections, thresholds)


def usable(vector: str) -> Column:
    """Neither null nor zero, all components finite numbers."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.coalesce(F.forall(vector, finite) & F.exists(vector, lambda x: x != 0), F.lit(False))


def vectors_of(column: pa.Array | pa.ChunkedArray, dimensions: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimensions)


def exact_distances(points: np.ndarray, query: np.ndarray) -> np.ndarray:
    return np.sqrt(((points - query) ** 2).sum(axis=1))


class Nearest:
    """The `n` nearest (distance, id) seen so far, of each query."""

    def __init__(self, n: int):
        self.n = n
        self.best: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def add(self, query: int, distances: np.ndarray, ids: list[np.ndarray]) -> None:
        held = self.best.get(query)
        if held is not None and len(held[0]) == self.n:
            close = np.flatnonzero(distances <= held[0][-1])
        else:
            close = np.arange(len(distances))
        if len(close) > self.n:
            # Each entry has an id at least, so the nearest n entries suffice, and their ties.
            edge = np.partition(distances[close], self.n - 1)[self.n - 1]
            close = close[distances[close] <= edge]
        if not len(close):
            return
        size = [len(ids[i]) for i in close]
        all_distances, all_ids = np.repeat(distances[close], size), np.concatenate([ids[i] for i in close])
        if held is not None:
            all_distances = np.concatenate((held[0], all_distances))
            all_ids = np.concatenate((held[1], all_ids))
        order = np.lexsort((all_ids, all_distances))
        # The same row may come out of several trees.
        first = np.ones(len(order), dtype=bool)
        first[1:] = all_ids[order[1:]] != all_ids[order[:-1]]
        order = order[first][: self.n]
        self.best[query] = all_distances[order], all_ids[order]

    def batches(self, names: tuple[str, str, str]) -> Iterator[pa.RecordBatch]:
        queries = list(self.best)
        for a in range(0, len(queries), 1000):
            part = queries[a : a + 1000]
            sizes = [len(self.best[q][0]) for q in part]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(np.array(part, dtype=np.int64), sizes)),
                    pa.array(np.concatenate([self.best[q][1] for q in part])),
                    pa.array(np.concatenate([self.best[q][0] for q in part])),
                ],
                names=list(names),
            )


def _entry_ids(column: pa.Array | pa.ChunkedArray) -> list[np.ndarray]:
    return [np.asarray(ids, dtype=np.int64) for ids in column.to_pylist()]


def file_entries(shared, dimensions: int):
    """For `mapInArrow`: every entry once per tree, with its leaf."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest: Forest = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            leaves = forest.leaves(vectors_of(batch.column("vector"), dimensions))
            for t, leaf in enumerate(leaves):
                tree = pa.array(np.full(len(leaf), t, dtype=np.int32))
                yield pa.RecordBatch.from_arrays(
                    [tree, pa.array(leaf), batch.column("vector"), batch.column("ids")],
                    names=["tree", "leaf", "vector", "ids"],
                )

    return run


def send_queries(shared, radius: float, dimensions: int):
    """For `mapInArrow`: a query once per leaf that it visits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest: Forest = shared.value
        for batch in batches:
            queries = vectors_of(batch.column("vector"), dimensions)
            for i, query in enumerate(queries):
                visits = forest.visits(query, radius)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([t for t, _ in visits], pa.int32()),
                        pa.array([leaf for _, leaf in visits], pa.int32()),
                        batch.column("vector").take(pa.array([i] * len(visits))),
                        batch.column("class").take(pa.array([i] * len(visits))),
                    ],
                    names=["tree", "leaf", "vector", "class"],
                )

    return run


def rerank(n: int, dimensions: int):
    """For `mapInArrow` after `meeting`: each query's nearest of the leaves seen by one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nearest = Nearest(n)

        def build(points: pa.Table):
            return vectors_of(points.column("vector"), dimensions), _entry_ids(points.column("ids"))

        def search(built, probes: pa.Table) -> tuple:
            points, ids = built
            queries = vectors_of(probes.column("vector"), dimensions)
            for query, vector in zip(probes.column("class").to_pylist(), queries, strict=True):
                nearest.add(query, exact_distances(points, vector), ids)
            return ()

        yield from met(batches, ["tree", "leaf"], build, search)
        yield from nearest.batches(("class", "vec_id", "score"))

    return run


def brute_force(shared, n: int, dimensions: int):
    """For `mapInArrow`: the partition's nearest entries, with vectors, of a few shared queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries: np.ndarray = shared.value
        best = [(np.empty(0), np.empty((0, dimensions)))] * len(queries)
        for batch in batches:
            points = vectors_of(batch.column("vector"), dimensions)
            for q, query in enumerate(queries):
                distances = np.concatenate((best[q][0], exact_distances(points, query)))
                order = np.argsort(distances, kind="stable")[: n + 1]
                best[q] = distances[order], np.concatenate((best[q][1], points))[order]
        for q, (distances, points) in enumerate(best):
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(distances), q, dtype=np.int32)),
                    pa.array(distances),
                    pa.array(list(points), pa.list_(pa.float64())),
                ],
                names=["query", "distance", "vector"],
            )

    return run


def calibrate(entries: DataFrame, forest: Forest, queries: np.ndarray, n: int, target: float) -> float:
    """The squared margin within which the forest has `target` of the true neighbours.

    Neighbours are sought among all entries; what comes back is `n` of each of few queries.
    """
    dimensions = queries.shape[1]
    spark = entries.sparkSession
    shared = spark.sparkContext.broadcast(queries)
    ranked = Window.partitionBy("query").orderBy("distance")
    true = (
        entries.mapInArrow(brute_force(shared, n, dimensions), "query int, distance double, vector array<double>")
        .withColumn("rank", F.row_number().over(ranked))
        # The nearest is the query itself.
        .where((F.col("rank") > 1) & (F.col("rank") <= n + 1))
        .select("query", "vector")
        .toArrow()
    )
    shared.unpersist()
    if not true.num_rows:
        return 0.0
    asked = queries[true.column("query").to_numpy()]
    reached = forest.distances(asked, forest.leaves(vectors_of(true.column("vector"), dimensions)))
    return float(np.quantile(reached, target, method="higher"))


def nearest_neighbours(
    table: DataFrame,
    is_query: Column,
    n: int = 10,
    id_column: str = "vec_id",
    vector: str = "embedding",
    trees: int = TREES,
    leaf: int = LEAF,
    target: float = TARGET,
) -> DataFrame:
    """query_id, rank, vec_id and score of the `n` nearest other rows of each query."""
    spark = table.sparkSession
    rows = table.select(
        F.col(id_column).cast("bigint").alias("id"), F.col(vector).alias("vector"), is_query.alias("asked")
    ).where(F.col("id").isNotNull() & usable("vector"))
    lengths = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), F.desc("d"))
    usual = lengths.first()
    found = "query_id bigint, rank int, vec_id bigint, score double"
    if usual is None:
        return spark.createDataFrame([], found)
    dimensions = usual["d"]
    rows = rows.where(F.size("vector") == dimensions)
    # Per vector only the least ids can matter; Spark cuts to them before the shuffle too.
    least = Window.partitionBy("vector").orderBy("id")
    entries = stored(
        rows.select("vector", "id")
        .distinct()
        .withColumn("place", F.row_number().over(least))
        .where(F.col("place") <= n + 1)
        .groupBy("vector")
        .agg(F.collect_list("id").alias("ids")),
        "nearest-entries",
    )
    sample = vectors_of(
        entries.select("vector").orderBy(F.xxhash64("vector", F.lit(SEED))).limit(SAMPLE_ROWS).toArrow().column(0),
        dimensions,
    )
    forest = fit_forest(sample, entries.count(), trees, leaf)
    radius = calibrate(entries, forest, sample[:CALIBRATION], n, target)
    shared = spark.sparkContext.broadcast(forest)
    kind = table.schema[vector].dataType.simpleString()
    points = entries.mapInArrow(
        file_entries(shared, dimensions), f"tree int, leaf int, vector {kind}, ids array<bigint>"
    )
    queries = rows.where(F.coalesce("asked", F.lit(False))).select("id", "vector").distinct()
    classes = stored(queries.groupBy("vector").agg(F.min("id").alias("class")), "nearest-queries")
    probes = classes.repartition("class").mapInArrow(
        send_queries(shared, radius, dimensions), f"tree int, leaf int, vector {kind}, class bigint"
    )
    near = (
        meeting(points, probes, ["tree", "leaf"], "vector", MOST_POINTS)
        .select("tree", "leaf", "part", "kind", "vector", "ids", "class")
        .mapInArrow(rerank(n + 1, dimensions), "class bigint, vec_id bigint, score double")
    )
    order = Window.partitionBy("class").orderBy("score", "vec_id")
    lists = (
        near.distinct()
        .withColumn("place", F.row_number().over(order))
        .where(F.col("place") <= n + 1)
        .groupBy("class")
        .agg(F.array_sort(F.collect_list(F.struct("score", "vec_id"))).alias("near"))
        .join(classes, "class")
        .select("vector", "near")
    )
    others = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("id")), 1, n)
    return (
        queries.join(stored(lists, "nearest-lists"), "vector")
        .select(F.col("id").alias("query_id"), F.posexplode(others).alias("place", "found"))
        .select(
            "query_id",
            (F.col("place") + 1).cast("int").alias("rank"),
            F.col("found.vec_id").alias("vec_id"),
            F.col("found.score").alias("score"),
        )
    )
