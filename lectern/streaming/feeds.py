"""Streams of landed items and state events. Expressions are the batch ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from lectern.operators.state import KEYS, OFF, ON, flag_aggregates


def stream_items(
    spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 64
) -> DataFrame:
    """A stream of the rows of Parquet files as they land at `path` (a directory or glob)."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def with_event_time(events: DataFrame) -> DataFrame:
    """`ts` with a time zone, as watermarks need; the session's zone must be UTC."""
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def stream_dedupe(events: DataFrame, delay: str | None = None) -> DataFrame:
    """Each event once, however late and however often it is sent again.

    The state is one key per event, held on disk. With `delay` it forgets keys, and
    events later than that behind the newest one seen are dropped, which
    `dropped_late` counts; without it none is, in whatever files and order they come.
    """
    timed = with_event_time(events)
    if delay is None:
        return timed.dropDuplicates(["event_id"])
    return timed.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])


def stream_state(events: DataFrame) -> DataFrame:
    """Flags per account and item, for update mode.

    There is no watermark: the latest event wins in whatever order events arrive,
    and the state is one row per account and item touched.
    """
    relevant = events.where(F.col("action").isin([*ON.values(), *OFF.values()]))
    return relevant.groupBy(*KEYS).agg(*flag_aggregates())


def stream_counts(
    events: DataFrame, width: str = "6 hours", delay: str | None = None
) -> DataFrame:
    """Reads and saves per time window, from events that may be sent again."""
    return stream_windows(stream_dedupe(events, delay), width)


def stream_windows(events: DataFrame, width: str = "6 hours") -> DataFrame:
    """Reads and saves per time window, of events that come once; also of a table of them."""
    return (
        events.groupBy(F.window("ts", width))
        .agg(
            F.count_if(F.col("action") == "read").alias("reads"),
            F.count_if(F.col("action") == "save").alias("saves"),
            F.count(F.lit(1)).alias("events"),
        )
        .select(
            F.col("window.start").cast("timestamp_ntz").alias("window_start"),
            "reads",
            "saves",
            "events",
        )
    )


def stream_enriched(
    items: DataFrame, feeds: DataFrame, favicons: DataFrame, default_icon: str
) -> DataFrame:
    """Arriving items with their feed's title and icon; items of unknown feeds are kept."""
    icons = favicons.select("feed_id", F.col("data").alias("icon"))
    known = feeds.select("feed_id", F.col("title").alias("feed_title")).join(
        icons, "feed_id", "left"
    )
    return items.join(known, "feed_id", "left").select(
        "item_id",
        "feed_id",
        "feed_title",
        F.coalesce("icon", F.lit(default_icon)).alias("icon"),
        "title",
        "url",
    )
