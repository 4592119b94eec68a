"""Running a streaming plan to the end of what has landed, with its result as a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType


def finish(query: StreamingQuery, timeout: int | None) -> None:
    """Wait for the end, without a limit if `timeout` is None; a failed query raises."""
    if timeout is None:
        query.awaitTermination()
    elif not query.awaitTermination(timeout):
        query.stop()
        raise TimeoutError(f"stream {query.id} still ran after {timeout} s")


def run_append(
    stream: DataFrame, folder: str, timeout: int | None = None
) -> tuple[DataFrame, StreamingQuery]:
    """Append finished rows to a table under `folder`; run again, it takes up where it stopped."""
    query = (
        stream.writeStream.outputMode("append")
        .format("parquet")
        .option("path", f"{folder}/rows")
        .option("checkpointLocation", f"{folder}/progress")
        .trigger(availableNow=True)
        .start()
    )
    finish(query, timeout)
    spark = stream.sparkSession
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows"), query


def run_update(
    stream: DataFrame, folder: str, keys: Sequence[str], timeout: int | None = None
) -> tuple[DataFrame, StreamingQuery]:
    """Write the rows each batch changes, and read back the latest row per key.

    A batch overwrites its own directory, so one that is repeated after a failure
    leaves the same table. Only changes are written, never the whole state.
    """
    def write_batch(changed: DataFrame, batch_id: int) -> None:
        changed.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(
            f"{folder}/rows/batch={batch_id}"
        )

    spark = stream.sparkSession
    # Readable even when nothing has landed.
    spark.createDataFrame([], stream.schema).write.mode("overwrite").parquet(
        f"{folder}/rows/batch=-1"
    )
    query = (
        stream.writeStream.outputMode("update")
        .foreachBatch(write_batch)
        .option("checkpointLocation", f"{folder}/progress")
        .trigger(availableNow=True)
        .start()
    )
    finish(query, timeout)
    values = [c for c in stream.columns if c not in keys]
    schema = StructType([*stream.schema.fields, StructField("batch", LongType())])
    changes = spark.read.schema(schema).parquet(f"{folder}/rows")
    latest = changes.groupBy(*keys).agg(*[F.max_by(c, "batch").alias(c) for c in values])
    return latest.select(*stream.columns), query


def dropped_late(query: StreamingQuery, operator: str = "dedupeWithinWatermark") -> int:
    """Rows of the last run that came after the watermark, as counted by `operator`.

    Counted at the deduplication: an aggregation counts partial results instead.
    """
    return sum(
        state["numRowsDroppedByWatermark"]
        for progress in query.recentProgress
        for state in progress["stateOperators"]
        if state["operatorName"] == operator
    )
