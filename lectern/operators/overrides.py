"""Manual changes laid over the synced tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F



def apply_overrides(items: DataFrame, overrides: DataFrame) -> DataFrame:
    """Items with hand-edited values over the synced ones; null leaves a value as it is."""
    edited = [c for c in overrides.columns if c != "item_id"]
    renamed = overrides.select("item_id", *[F.col(c).alias(f"_{c}") for c in edited])
    joined = items.join(renamed, "item_id", "left")
    return joined.select(
        *[F.coalesce(f"_{c}", c).alias(c) if c in edited else F.col(c) for c in items.columns]
    )


def apply_view_overrides(feeds: DataFrame, overrides: DataFrame) -> DataFrame:
    """Feeds under the names the reader gave them."""
    named = overrides.select("feed_id", F.col("title").alias("_title"))
    return feeds.join(named, "feed_id", "left").select(
        *[F.coalesce("_title", c).alias(c) if c == "title" else F.col(c) for c in feeds.columns]
    )


def apply_membership_overrides(feed_groups: DataFrame, overrides: DataFrame) -> DataFrame:
    """Group membership with moved feeds taken out of all their groups and put into the new one."""
    moved = overrides.where(F.col("group_id").isNotNull()).select("group_id", "feed_id")
    kept = feed_groups.join(moved.select("feed_id"), "feed_id", "left_anti")
    return kept.select("group_id", "feed_id").unionByName(moved)
