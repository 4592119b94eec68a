"""Contiguous shards of nearly equal bytes, cut from global prefix sums.

Rows are sorted by range partitioning. Each partition sums its own rows in one
streaming pass; only one total per partition is added up globally. A row's place
in bytes and in rows is its partition's offset plus its own running sum, and the
shard follows from where the middle of the row lies between equal targets. So a
shard differs from its target by less than one row at either end, whatever one
key or source holds.

Defined results: a null text has no bytes and crc32 0; a null key sorts first; rows
with equal keys are ordered by checksum, and identical rows are interchangeable; an
empty table gives no rows. Columns other than the key and the text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import stored

RUNNING = "key {key}, size bigint, text_crc32 bigint, part int, row_in_part bigint, bytes_before bigint"


def running_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the sorted rows of one partition and sum the bytes before each."""
    part = TaskContext.get().partitionId()
    rows = total = 0
    for batch in batches:
        n = batch.num_rows
        size = batch.column(1).to_numpy()
        ends = total + np.cumsum(size)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                batch.column(1),
                batch.column(2),
                pa.array(np.full(n, part, dtype=np.int32)),
                pa.array(rows + np.arange(n, dtype=np.int64)),
                pa.array(ends - size),
            ],
            names=["key", "size", "text_crc32", "part", "row_in_part", "bytes_before"],
        )
        if n:
            rows, total = rows + n, int(ends[-1])


def contiguous_shards(
    docs: DataFrame, shards: int = 16, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """key, size, text_crc32, shard and slot of every row; size is UTF-8 bytes plus 1."""
    narrow = docs.select(
        F.col(key).alias("key"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("bigint").alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit(""))).alias("text_crc32"),
        # Splits rows that are equal in all else; which of them comes first shows nowhere.
        F.monotonically_increasing_id().alias("tie"),
    )
    order = ["key", "text_crc32", "size", "tie"]
    schema = RUNNING.format(key=docs.schema[key].dataType.simpleString())
    summed = stored(
        narrow.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select("key", "size", "text_crc32")
        .mapInArrow(running_sums, schema),
        "shard-sums",
    )
    # One row per partition: this window and the broadcasts below are bounded by their number.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    totals = summed.groupBy("part").agg(
        F.count(F.lit(1)).alias("part_rows"), F.sum("size").alias("part_bytes")
    )
    offsets = totals.select(
        "part",
        F.coalesce(F.sum("part_rows").over(before), F.lit(0)).alias("rows_offset"),
        F.coalesce(F.sum("part_bytes").over(before), F.lit(0)).alias("bytes_offset"),
        F.sum("part_bytes").over(everything).alias("all_bytes"),
    )
    target = F.expr(
        "(cast(2 * (bytes_offset + bytes_before) + size as decimal(38,0)) * "
        f"{shards}) div (2 * all_bytes)"
    )
    placed = summed.join(F.broadcast(offsets), "part").select(
        "key",
        "size",
        "text_crc32",
        (F.col("rows_offset") + F.col("row_in_part")).alias("row"),
        F.least(F.lit(shards - 1), target).cast("int").alias("shard"),
    )
    first = placed.groupBy("shard").agg(F.min("row").alias("first_row"))
    return placed.join(F.broadcast(first), "shard").select(
        F.col("key").alias(key),
        "size",
        "text_crc32",
        "shard",
        (F.col("row") - F.col("first_row")).alias("slot"),
    )
