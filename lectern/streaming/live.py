"""Live read and saved flags as a keyed table that counts and lists read while events arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from lectern.operators.state import KEYS
from lectern.sources.change_table import ChangeTable
from lectern.streaming.feeds import stream_state
from lectern.streaming.runner import finish

FLAGS = StructType(
    [StructField(k, LongType()) for k in KEYS] + [StructField(f, BooleanType()) for f in ("is_read", "is_saved")]
)


def live_flags(spark: SparkSession, path: str, buckets: int) -> ChangeTable:
    """Flags per account and item, in buckets by account, so that a reader opens its account's only."""
    return ChangeTable(spark, path, FLAGS, tuple(KEYS), ("account_id",), buckets)


def fold_flags(
    events: DataFrame, flags: ChangeTable, progress: str, most_runs: int = 8, timeout: int | None = None
) -> None:
    """Fold a stream of state events into the table, to the end of what has landed.

    A batch writes the flags it changed and voids their last values. One that is repeated after a
    failure writes the same flags once more, which changes nothing. After `most_runs` runs
    the table is compacted, so what a reader opens doesn't grow with the number of batches.
    """

    def fold(changed: DataFrame, _: int) -> None:
        changed = changed.persist()
        try:
            if changed.isEmpty():
                return
            flags.write(changed, changed.select(*KEYS))
            if len({run for run, _ in flags.listing()[1]}) > most_runs:
                flags.compact()
        finally:
            changed.unpersist()

    query = (
        stream_state(events)
        .writeStream.outputMode("update")
        .foreachBatch(fold)
        .option("checkpointLocation", progress)
        .trigger(availableNow=True)
        .start()
    )
    finish(query, timeout)


def account_flags(flags: ChangeTable, account: int) -> DataFrame:
    """Flags of one account by item, as `account_state` gives them from the whole log."""
    own = flags.read([flags.bucket_of(account)])
    return own.where(F.col("account_id") == account).drop("account_id")
