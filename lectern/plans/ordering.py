"""Event order, skew-safe ordered scans, and top-n per key."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

SALTS = 64
# Stands for a missing time: before all others.
OLDEST = datetime(1, 1, 1)


def event_order(ts: str | Column, event_id: str | Column) -> Column:
    """(ts, event_id) as one decimal.

    A struct would order the same way, but `max_by` over a struct cannot use a
    hash aggregate and sorts every input row first.
    """
    ts = F.col(ts) if isinstance(ts, str) else ts
    event_id = F.col(event_id) if isinstance(event_id, str) else event_id
    # A missing time counts as the oldest.
    micros = F.coalesce(F.unix_micros(ts.cast("timestamp")), F.lit(-(2**62))).cast("decimal(38,0)")
    # 10^19 exceeds any bigint, so ids never spill into the time part.
    return micros * F.expr("10000000000000000000BD") + event_id.cast("decimal(20,0)")


def time_bucket(ts: str, bucket: str) -> Column:
    """The bucket of a time; rows without a time come before all others, in one of their own."""
    return F.coalesce(F.date_trunc(bucket, ts).cast("timestamp_ntz"), F.lit(OLDEST).cast("timestamp_ntz"))


def last_known(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    event_id: str,
    value: str,
    out: str,
    bucket: str = "day",
) -> DataFrame:
    """Add `out`: the latest non-null `value` of the same keys up to and with this row.

    Rows are ordered by `ts`, then `event_id`; at the same `ts` rows that bring a
    value go first, and rows without a time come first of all. Keys are scanned in
    time buckets that run as separate tasks, so no task holds the whole of a hot
    key; only the closing value of each bucket is carried from bucket to bucket.
    """
    sequence = [F.col(ts), F.col(value).isNull(), F.col(event_id)]
    cut = df.withColumn("_bucket", time_bucket(ts, bucket))
    key_bucket = [*keys, "_bucket"]
    inside = Window.partitionBy(*key_bucket).orderBy(*sequence).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    order = F.when(F.col(value).isNotNull(), event_order(ts, event_id))
    closing = cut.groupBy(*key_bucket).agg(F.max_by(value, order).alias("_closing"))
    before = (
        Window.partitionBy(*keys)
        .orderBy("_bucket")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = closing.select(
        *[F.col(k).alias(f"_of_{k}") for k in key_bucket],
        F.last("_closing", ignorenulls=True).over(before).alias("_carried"),
    )
    # Rows without a key are one key of their own here as well.
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in key_bucket])
    return (
        cut.withColumn("_inside", F.last(value, ignorenulls=True).over(inside))
        .join(carried, same, "left")
        .withColumn(out, F.coalesce("_inside", "_carried"))
        .select(*df.columns, out)
    )


def first_n_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str = "position"
) -> DataFrame:
    """The first n rows of each key in `order`, numbered from 1 in column `rank`."""
    # Up to this n Spark itself drops rows that can't be among the first before it shuffles.
    pruned = int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000"))
    if n > pruned:
        salted = Window.partitionBy(*keys, "_salt").orderBy(*order)
        df = (
            df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(SALTS)))
            .withColumn("_n", F.row_number().over(salted))
            .where(F.col("_n") <= n)
            .drop("_salt", "_n")
        )
    numbered = df.withColumn(
        rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    )
    return numbered.where(F.col(rank) <= n).withColumn(rank, F.col(rank).cast("bigint"))
