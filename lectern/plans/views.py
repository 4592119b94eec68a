"""The reader's derived views, built on demand as lazy plans."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

# The views by name, each over the ones before it and the base tables.
DERIVED = {
    "feed_activity": """
        SELECT c.account_id, i.feed_id, count_if(c.is_read) AS read, count_if(c.is_saved) AS saved
        FROM current_flags c JOIN items i ON i.item_id = c.item_id
        GROUP BY c.account_id, i.feed_id
    """,
    "feed_overview": """
        SELECT f.feed_id, f.title, coalesce(t.total, 0) AS total
        FROM feeds f LEFT JOIN
             (SELECT feed_id, count(*) AS total FROM items GROUP BY feed_id) t
             ON t.feed_id = f.feed_id
    """,
    "group_overview": """
        SELECT g.group_id, g.title, count(o.feed_id) AS feeds,
               coalesce(sum(o.total), 0) AS total
        FROM groups g
        LEFT JOIN feed_groups b ON b.group_id = g.group_id
        LEFT JOIN feed_overview o ON o.feed_id = b.feed_id
        GROUP BY g.group_id, g.title
    """,
}


def build_views(spark: SparkSession, tables: Mapping[str, DataFrame]) -> list[str]:
    """Register base tables and the views derived from them; returns the names.

    `tables` holds items, feeds, groups, feed_groups and current_flags. A view is
    a plan, so it shows the tables as they are whenever it is read.
    """
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    for name, query in DERIVED.items():
        spark.sql(query).createOrReplaceTempView(name)
    return [*tables, *DERIVED]
