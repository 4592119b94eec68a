"""Events taken up once each, late ones apart, with no state that grows.

Which events are known is read from the table of accepted events itself, which lies in
directories by day: a batch opens only the days that its own events fall on. A resent event has its
first time, so it falls on the same day. With a delay, events at or behind the mark, the
newest event of earlier runs less the delay, go to a table of late events instead; so days behind
the mark are never opened again. The mark moves between runs, not between batches, so that
the outcome does not depend on how what landed is cut into files or batches.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.types import (
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
)

from lectern.streaming.runner import finish

DAY, BATCH = StructField("day", StringType()), StructField("batch", LongType())
MARKS = StructType([StructField("newest", TimestampNTZType()), StructField("run", LongType())])
FIGURES = StructType(
    [StructField(c, LongType()) for c in ("came", "taken", "late")] + [StructField("newest", TimestampNTZType())]
)
NO_DAY = "none"


@dataclass(frozen=True)
class Taken:
    """Accepted and late events, and per batch how many came and where they went."""

    rows: DataFrame
    late: DataFrame
    figures: DataFrame


def _read(spark: SparkSession, path: str, schema: StructType, base: str | None = None) -> DataFrame:
    """A table that may not be there yet."""
    try:
        return spark.read.schema(schema).option("basePath", base or path).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _day(ts: str) -> Column:
    return F.coalesce(F.date_format(ts, "yyyy-MM-dd"), F.lit(NO_DAY))


def accepted(
    spark: SparkSession, folder: str, schema: StructType, days: Sequence[str] | None = None
) -> DataFrame:
    """All events accepted so far, or those of some days (yyyy-MM-dd); other days aren't even listed."""
    base = f"{folder}/rows"
    path = base if days is None else f"{base}/day={{{','.join(days)}}}"
    return _read(spark, path, StructType([*schema.fields, DAY, BATCH]), base)


def take_once(
    events: DataFrame, folder: str, delay: str | None = None, key: str = "event_id", timeout: int | None = None
) -> Taken:
    """Run a stream of events (`ts` without a zone) to the end of what has landed.

    Run again on the same folder, it takes up where it stopped. `delay` is an interval as `2 days`.
    Of events with one key in a batch any one is taken; they are the same event. Events without a
    time are never late. A batch that is repeated after a failure overwrites what it wrote.
    """
    spark = events.sparkSession
    schema = events.schema
    marks = _read(spark, f"{folder}/marks", MARKS)
    newest, runs = marks.agg(F.max("newest"), F.max("run")).first()
    # The mark holds for the whole run; an interrupted run goes on with the one it began with.
    late_if = F.lit(False)
    if delay is not None and newest is not None:
        mark = F.date_trunc("millisecond", F.lit(newest).cast("timestamp_ntz")) - F.expr(f"interval {delay}")
        late_if = F.coalesce(F.col("ts") <= mark, F.lit(False))

    def store(df: DataFrame, table: str, batch: int, by_day: bool) -> None:
        place = f"{folder}/{table}"
        if by_day:
            # One directory per day and batch, so a repeated batch meets its own rows only.
            df.withColumn("batch", F.lit(batch)).hint("rebalance", "day").write.mode("overwrite").option(
                "partitionOverwriteMode", "dynamic"
            ).partitionBy("day", "batch").parquet(place)
        else:
            df.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(f"{place}/batch={batch}")

    def take(batch: DataFrame, number: int) -> None:
        batch = batch.withColumn("_late", late_if).withColumn("day", _day("ts")).persist()
        try:
            came = batch.groupBy("day", "_late").agg(F.count(F.lit(1)).alias("n")).collect()
            days = sorted({r["day"] for r in came if not r["_late"]})
            n_late = sum(r["n"] for r in came if r["_late"])
            fresh = batch.where(~F.col("_late")).drop("_late")
            seen = Observation()
            if days:
                known = accepted(spark, folder, schema, days).where(F.col("batch") < number)
                once = fresh.dropDuplicates([key]).join(known.select(key), key, "left_anti")
                once = once.select(*schema.fieldNames(), "day").observe(
                    seen, F.count(F.lit(1)).alias("taken"), F.max("ts").alias("newest")
                )
                store(once, "rows", number, True)
            if n_late:
                store(batch.where("_late").select(*schema.fieldNames()), "late", number, False)
            taken = seen.get if days else {"taken": 0, "newest": None}
            figures = [(sum(r["n"] for r in came), taken["taken"], n_late, taken["newest"])]
            store(spark.createDataFrame(figures, FIGURES).coalesce(1), "figures", number, False)
        finally:
            batch.unpersist()

    query = (
        events.writeStream.foreachBatch(take)
        .option("checkpointLocation", f"{folder}/progress")
        .trigger(availableNow=True)
        .start()
    )
    finish(query, timeout)
    figures = _read(spark, f"{folder}/figures", StructType([*FIGURES.fields, BATCH]))
    # The run is over: from now on its events count for the mark.
    run = (runs or 0) + 1
    figures.agg(F.max("newest").alias("newest")).coalesce(1).write.mode("overwrite").parquet(f"{folder}/marks/run={run}")
    return Taken(
        accepted(spark, folder, schema).select(*schema.fieldNames()),
        _read(spark, f"{folder}/late", StructType([*schema.fields, BATCH])).select(*schema.fieldNames()),
        figures.select("batch", "came", "taken", "late"),
    )
