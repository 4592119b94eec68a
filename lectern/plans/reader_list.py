"""The reader's main list."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, functions as F

from lectern.functions.dates import friendly_date
from lectern.functions.text import blank_to_null
from lectern.operators.counts import with_flags
from lectern.operators.display import with_favicons
from lectern.operators.listings import group_feeds
from lectern.operators.state import account_state


def reader_list(
    items: DataFrame,
    feeds: DataFrame,
    feed_groups: DataFrame,
    groups: DataFrame,
    favicons: DataFrame,
    events: DataFrame,
    account: int,
    as_of: datetime,
    default_icon: str,
) -> DataFrame:
    """Unread items of an account under each of their groups, ready to show.

    Items meet the account's flags once, as narrow rows by item id, which no feed
    can skew. Groups, feeds and icons are joined to each other first, so items
    meet them in a single join.
    """
    places = group_feeds(groups, feed_groups, feeds).join(
        with_favicons(feeds.select("feed_id"), favicons, default_icon), "feed_id"
    )
    narrow = items.select(
        "item_id",
        "feed_id",
        F.coalesce(blank_to_null("title"), "url").alias("title"),
        "url",
        "created_at",
    )
    unread = with_flags(narrow, account_state(events, account)).where(~F.col("is_read"))
    return unread.join(places, "feed_id").select(
        "group_id",
        "group_title",
        "feed_id",
        "feed_title",
        "icon",
        "item_id",
        "title",
        "url",
        friendly_date("created_at", as_of).alias("when"),
        "is_saved",
        "created_at",
    )
