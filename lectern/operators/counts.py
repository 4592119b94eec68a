"""Item counts under any grouping.

An item lies in one feed, and a feed may lie in several groups. So items are
counted per feed first, and only the few resulting rows meet the groups: no item
is counted twice within a group, and no distinct count is needed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

MEASURES = ["total", "unread", "saved"]


def with_flags(items: DataFrame, state: DataFrame) -> DataFrame:
    """Items with `is_read` and `is_saved` of one account, false where it has no event."""
    flags = state.select("item_id", "is_read", "is_saved")
    return items.join(flags, "item_id", "left").withColumns(
        {
            "is_read": F.coalesce("is_read", F.lit(False)),
            "is_saved": F.coalesce("is_saved", F.lit(False)),
        }
    )


def _measures() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("total"),
        F.count_if(~F.col("is_read")).alias("unread"),
        F.count_if("is_saved").alias("saved"),
    ]


def _sums() -> list[Column]:
    return [F.sum(m).alias(m) for m in MEASURES]


def feed_counts(items: DataFrame, state: DataFrame) -> DataFrame:
    """Total, unread and saved items per feed; `state` is that of one account."""
    narrow = items.select("item_id", "feed_id")
    return with_flags(narrow, state).groupBy("feed_id").agg(*_measures())


def account_counts(items: DataFrame, flags: DataFrame, account_feeds: DataFrame) -> DataFrame:
    """Total, unread and saved items per account and feed it follows, of all accounts at once.

    No account meets items that it never touched: totals are those of the feeds, and only
    flags that are set are counted by account, in part before the shuffle, so that neither an
    account nor an item that holds most flags gathers in one task.
    """
    sizes = items.groupBy("feed_id").agg(F.count(F.lit(1)).alias("total"))
    touched = (
        flags.where("is_read or is_saved")
        .join(items.select("item_id", "feed_id"), "item_id")
        .groupBy("account_id", "feed_id")
        .agg(F.count_if("is_read").alias("_read"), F.count_if("is_saved").alias("saved"))
    )
    total, read = F.coalesce("total", F.lit(0)), F.coalesce("_read", F.lit(0))
    return (
        account_feeds.select("account_id", "feed_id")
        .distinct()
        .join(sizes, "feed_id", "left")
        .join(touched, ["account_id", "feed_id"], "left")
        .select(
            "account_id", "feed_id", total.alias("total"), (total - read).alias("unread"),
            F.coalesce("saved", F.lit(0)).alias("saved"),
        )
    )


def group_counts(items: DataFrame, state: DataFrame, feed_groups: DataFrame) -> DataFrame:
    """The same per group, and for all groups together with a null group.

    The grand total counts a feed that lies in two groups once: to the groups'
    feeds it adds each feed once more, under no group.
    """
    every_feed = feed_groups.select(F.lit(None).cast("bigint").alias("group_id"), "feed_id")
    places = feed_groups.select("group_id", "feed_id").unionByName(every_feed.distinct())
    return feed_counts(items, state).join(places, "feed_id").groupBy("group_id").agg(*_sums())


def zero_count_groups(groups: DataFrame, counts: DataFrame) -> DataFrame:
    """Every group with its counts, 0 for those without items."""
    return groups.join(counts, "group_id", "left").select(
        "group_id", "title", *[F.coalesce(m, F.lit(0)).alias(m) for m in MEASURES]
    )


def groups_with_unread(
    groups: DataFrame, feed_groups: DataFrame, unread: DataFrame
) -> DataFrame:
    """Groups that hold an unread item; the unread items shrink to their feeds first."""
    feeds = unread.select("feed_id").distinct()
    filled = feed_groups.join(feeds, "feed_id", "left_semi").select("group_id")
    return groups.join(filled, "group_id", "left_semi")


def counts_rollup(items: DataFrame, state: DataFrame, feed_groups: DataFrame) -> DataFrame:
    """Counts per group and feed, per group, and over all; `level` is 0, 1 and 3.

    Subtotals add up: the overall row counts a feed once per group it lies in.
    """
    per_feed = feed_counts(items, state).join(feed_groups, "feed_id")
    return (
        per_feed.rollup("group_id", "feed_id")
        .agg(F.grouping_id().cast("bigint").alias("level"), *_sums())
        .select("group_id", "feed_id", "level", *MEASURES)
    )


def regroup_items(
    items: DataFrame,
    state: DataFrame,
    *groupings: Sequence[str],
    feed_groups: DataFrame | None = None,
) -> DataFrame:
    """Counts under one or more groupings the reader chose.

    A column that is no part of a row's grouping is null there, and `level`, a
    bit per column (1 = left out, first column highest), tells such a null from a
    missing value. The finest grouping is counted once and the others are sums of
    it, so items are not multiplied by the number of groupings. `group_id` may be a
    column if `feed_groups` is given.
    """
    columns = list(dict.fromkeys(c for grouping in groupings for c in grouping))
    finest = _finest(items, state, columns, feed_groups)
    return (
        finest.groupingSets(
            [[F.col(c) for c in grouping] for grouping in groupings],
            *[F.col(c) for c in columns],
        )
        .agg(F.grouping_id().cast("bigint").alias("level"), *_sums())
        .select(*columns, "level", *MEASURES)
    )


def counts_cube(
    items: DataFrame,
    state: DataFrame,
    columns: Sequence[str],
    feed_groups: DataFrame | None = None,
) -> DataFrame:
    """Counts under every combination of the chosen columns."""
    return (
        _finest(items, state, columns, feed_groups)
        .cube(*columns)
        .agg(F.grouping_id().cast("bigint").alias("level"), *_sums())
        .select(*columns, "level", *MEASURES)
    )


def _finest(
    items: DataFrame, state: DataFrame, columns: Sequence[str], feed_groups: DataFrame | None
) -> DataFrame:
    flagged = with_flags(items, state)
    if "group_id" not in columns:
        return flagged.groupBy(*columns).agg(*_measures())
    inner = dict.fromkeys([*[c for c in columns if c != "group_id"], "feed_id"])
    per_feed = flagged.groupBy(*inner).agg(*_measures())
    return per_feed.join(feed_groups, "feed_id").groupBy(*columns).agg(*_sums())
