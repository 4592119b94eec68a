"""Points and probes that meet in the cells of a space-partitioning tree.

A point is filed under one cell, a probe visits several. Both are rows that carry the
label of their cell, and a sorted shuffle brings a cell's points together, ahead of its
probes, which stream past them. A task so holds the points of one cell and a bounded number
of probes. Cells that no split could make small enough are dealt out over several parts, by
a hash of the point, and each of their probes visits every part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

POINT, PROBE = 0, 1
PROBES_AT_ONCE = 16_384


def meeting(
    points: DataFrame, probes: DataFrame, cell: list[str], point: str, most: int
) -> DataFrame:
    """Rows of both, sorted for `met` by cell, part and `kind`; parts hold about `most` points.

    `point` is the column by whose hash the points of a large cell are dealt out.
    """
    # Cells over the limit only: mostly none, and never more than points / most.
    large = (
        points.groupBy(*cell).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most)
        .select(*cell, F.ceil(F.col("n") / most).cast("int").alias("parts"))
    )
    parts = F.coalesce("parts", F.lit(1))
    filed = points.join(large, cell, "left").withColumns(
        {"part": F.pmod(F.xxhash64(point), parts).cast("int"), "kind": F.lit(POINT)}
    )
    visits = probes.join(large, cell, "left").withColumns(
        {"part": F.explode(F.sequence(F.lit(0), parts - 1)), "kind": F.lit(PROBE)}
    )
    return (
        filed.drop("parts")
        .unionByName(visits.drop("parts"), allowMissingColumns=True)
        .repartition(*cell, "part")
        .sortWithinPartitions(*cell, "part", "kind")
    )


def met(
    batches: Iterator[pa.RecordBatch],
    cell: list[str],
    build: Callable[[pa.Table], Any],
    search: Callable[[Any, pa.Table], Iterable[pa.RecordBatch]],
) -> Iterator[pa.RecordBatch]:
    """All that `search` gives for the structure that `build` made of a part's points and some of its probes.

    Probes are searched PROBES_AT_ONCE or so at a time.
    """
    now: tuple = ()
    points: list[pa.RecordBatch] = []
    probes: list[pa.RecordBatch] = []
    built = None

    def searched() -> Iterable[pa.RecordBatch]:
        nonlocal built
        if not points or not probes:
            return ()
        if built is None:
            built = build(pa.Table.from_batches(points))
        some = pa.Table.from_batches(probes)
        probes.clear()
        return search(built, some)

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        label = [batch.column(c) for c in (*cell, "part")]
        change = np.diff(batch.column("kind").to_numpy()) != 0
        for column in label:
            change |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), n]
        for a, b in zip(cuts, cuts[1:]):
            key = tuple(column[a].as_py() for column in label)
            if key != now:
                yield from searched()
                now, built = key, None
                points.clear()
                probes.clear()
            if batch.column("kind")[a].as_py() == POINT:
                points.append(batch.slice(a, b - a))
            elif points:
                probes.append(batch.slice(a, b - a))
        if sum(part.num_rows for part in probes) >= PROBES_AT_ONCE:
            yield from searched()
    yield from searched()
