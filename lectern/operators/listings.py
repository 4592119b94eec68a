"""Group and feed drill-down, item listings, and filters."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame, functions as F

from lectern.plans.ordering import first_n_per_key


def group_feeds(groups: DataFrame, feed_groups: DataFrame, feeds: DataFrame) -> DataFrame:
    """Each group's feeds."""
    return (
        groups.select("group_id", F.col("title").alias("group_title"))
        .join(feed_groups, "group_id")
        .join(feeds.select("feed_id", F.col("title").alias("feed_title")), "feed_id")
        .select("group_id", "group_title", "feed_id", "feed_title")
    )


def link_list(items: DataFrame) -> DataFrame:
    """Links of the stored items, by id."""
    return items.select("item_id", "title", "url").orderBy("item_id")


def item_listing(items: DataFrame, n: int) -> DataFrame:
    """The newest n items of each feed; of items equally new the higher id first."""
    listed = items.select("feed_id", "item_id", "title", "created_at")
    return first_n_per_key(
        listed, ["feed_id"], [F.desc("created_at"), F.desc("item_id")], n
    )


def latest_items(items: DataFrame, n: int) -> DataFrame:
    """The newest n items of all feeds."""
    return (
        items.select("feed_id", "item_id", "title", "created_at")
        .orderBy(F.desc("created_at"), F.desc("item_id"))
        .limit(n)
    )


def filter_items(
    items: DataFrame,
    *,
    text_has: str | None = None,
    title_has: str | None = None,
    feeds: Sequence[str] | None = None,
    group: int | None = None,
    feed_groups: DataFrame | None = None,
    since: datetime | None = None,
    until: datetime | None = None,
    flags: DataFrame | None = None,
    read: bool | None = None,
    saved: bool | None = None,
) -> DataFrame:
    """Items meeting every condition given.

    `text_has` and `title_has` are substrings in any case, `since` and `until`
    inclusive. `group` needs `feed_groups`; `read` and `saved` need `flags`, the
    current state of one account, where an absent item counts as unread and unsaved.
    """
    out = items
    if feeds is not None:
        out = out.where(F.col("feed_id").isin(list(feeds)))
    if since is not None:
        out = out.where(F.col("created_at") >= F.lit(since).cast("timestamp_ntz"))
    if until is not None:
        out = out.where(F.col("created_at") <= F.lit(until).cast("timestamp_ntz"))
    if title_has is not None:
        out = out.where(F.contains(F.lower("title"), F.lit(title_has.lower())))
    if text_has is not None:
        out = out.where(F.contains(F.lower("text"), F.lit(text_has.lower())))
    if group is not None:
        members = feed_groups.where(F.col("group_id") == group).select("feed_id")
        out = out.join(members, "feed_id", "left_semi")
    for wanted, flag in ((read, "is_read"), (saved, "is_saved")):
        if wanted is not None:
            how = "left_semi" if wanted else "left_anti"
            out = out.join(flags.where(flag).select("item_id"), "item_id", how)
    return out.select(*items.columns)
