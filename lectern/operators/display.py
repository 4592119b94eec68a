"""Data that lists and article views show."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, functions as F

from lectern.functions.dates import day_section, friendly_date


def with_favicons(feeds: DataFrame, favicons: DataFrame, default: str) -> DataFrame:
    """Feeds with their icon, or the default one."""
    icons = favicons.select("feed_id", F.col("data").alias("_data"))
    return feeds.join(icons, "feed_id", "left").select(
        *feeds.columns, F.coalesce("_data", F.lit(default)).alias("icon")
    )


def friendly_dates(df: DataFrame, ts: str, as_of: datetime, out: str = "when") -> DataFrame:
    return df.withColumn(out, friendly_date(ts, as_of))


def day_buckets(items: DataFrame, as_of: datetime) -> DataFrame:
    """The sections a list is divided into, with the number of items in each."""
    return items.groupBy(day_section("created_at", as_of).alias("section")).agg(
        F.count(F.lit(1)).alias("items")
    )


def alternative_url(items: DataFrame, templates: DataFrame) -> DataFrame:
    """`read_url`: the item's URL handed to its feed's reading service, or the URL itself."""
    prefixes = templates.select("feed_id", F.col("prefix").alias("_prefix"))
    return items.join(prefixes, "feed_id", "left").select(
        *items.columns,
        F.coalesce(F.concat("_prefix", F.url_encode("url")), "url").alias("read_url"),
    )
