import pytest
from pyspark.sql import functions as F

from helpers import at, plan, rows
from lectern.operators import counts, display, listings, overrides


@pytest.fixture(scope="module")
def world(spark):
    items = spark.createDataFrame(
        [
            (1, "a", "en", "t1", at(1)),
            (2, "a", "de", "t2", at(1)),
            (3, "b", "en", "t3", at(3)),
            (4, "c", "en", "t4", at(4)),
        ],
        "item_id bigint, feed_id string, lang string, title string, created_at timestamp_ntz",
    )
    flags = spark.createDataFrame(
        [(1, True, False), (3, True, True), (4, False, True), (77, True, True)],
        "item_id bigint, is_read boolean, is_saved boolean",
    )
    feeds = spark.createDataFrame([("a", "A"), ("b", "B"), ("c", "C")], "feed_id string, title string")
    groups = spark.createDataFrame([(0, "G0"), (1, "G1"), (2, "G2")], "group_id bigint, title string")
    # Feed a in two groups, feed c in none, group 2 empty.
    bridge = spark.createDataFrame([(0, "a"), (1, "a"), (1, "b")], "group_id bigint, feed_id string")
    return items, flags, feeds, groups, bridge


def test_feed_counts_include_untouched_items(world):
    items, flags, *_ = world
    assert rows(counts.feed_counts(items, flags)) == [
        ("a", 2, 1, 0), ("b", 1, 0, 1), ("c", 1, 1, 1)
    ]


def test_group_counts_total_counts_shared_feeds_once(world):
    items, flags, _, groups, bridge = world
    got = counts.group_counts(items, flags, bridge)
    assert rows(got) == [(0, 2, 1, 0), (1, 3, 1, 1), (None, 3, 1, 1)]
    assert rows(counts.zero_count_groups(groups, got)) == [
        (0, "G0", 2, 1, 0), (1, "G1", 3, 1, 1), (2, "G2", 0, 0, 0)
    ]


def test_groups_with_unread(world):
    items, flags, _, groups, bridge = world
    unread = items.join(flags.where("is_read"), "item_id", "left_anti")
    assert [r[0] for r in rows(counts.groups_with_unread(groups, bridge, unread))] == [0, 1]
    none = items.where("item_id = 3")
    assert [r[0] for r in rows(counts.groups_with_unread(groups, bridge, none))] == [1]


def test_rollup_adds_up_when_each_feed_has_one_group(world):
    items, flags, _, _, bridge = world
    one_each = bridge.where("group_id = 1")
    got = {(r.group_id, r.feed_id): r.total for r in
           counts.counts_rollup(items, flags, one_each).collect()}
    assert got == {(1, "a"): 2, (1, "b"): 1, (1, None): 3, (None, None): 3}


def test_regrouping_tells_a_missing_value_from_a_subtotal(spark, world):
    items, flags, *_ = world
    odd = items.withColumn("lang", F.when(F.col("lang") == "en", "en"))
    got = counts.regroup_items(odd, flags, ["lang"], ["feed_id"])
    by_lang = {r.lang: r.total for r in got.collect() if r.level == 1}
    assert by_lang == {"en": 3, None: 1}
    assert got.where("level = 2").count() == 3


def test_cube_holds_every_combination(world):
    items, flags, _, _, bridge = world
    got = counts.counts_cube(items, flags, ["feed_id", "lang"])
    assert got.where("level = 3").first().total == 4
    assert got.where("level = 0").count() == 4
    grouped = counts.counts_cube(items, flags, ["group_id"], feed_groups=bridge)
    assert rows(grouped.select("group_id", "total")) == [(0, 2), (1, 3), (None, 5)]


def test_listing_breaks_ties_by_id(world):
    items = world[0]
    got = rows(listings.item_listing(items, 1).select("feed_id", "item_id", "position"))
    assert got == [("a", 2, 1), ("b", 3, 1), ("c", 4, 1)]
    assert [r.item_id for r in listings.latest_items(items, 2).collect()] == [4, 3]


def test_long_listings_are_cut_per_salt_first(spark):
    """Above Spark's own limit a hot feed is cut down in parts before it meets in one task."""
    items = spark.range(5000).select(
        F.lit("hot").alias("feed_id"),
        F.col("id").alias("item_id"),
        F.lit("t").alias("title"),
        F.lit(at(1)).cast("timestamp_ntz").alias("created_at"),
    )
    n = 1200
    df = listings.item_listing(items, n)
    assert "_salt" in plan(df)
    got = df.collect()
    assert sorted(r.item_id for r in got) == list(range(5000 - n, 5000))
    assert all(r.position == 5000 - r.item_id for r in got)


def test_filters_combine(world):
    items, flags, _, _, bridge = world
    keep = listings.filter_items(
        items, title_has="T", group=1, feed_groups=bridge, flags=flags, read=True, until=at(2)
    )
    assert [r[0] for r in rows(keep)] == [1]
    assert rows(listings.filter_items(items, feeds=["b", "c"], since=at(4)))[0][0] == 4
    assert listings.filter_items(items, flags=flags, saved=False).count() == 2
    assert listings.filter_items(items, title_has="absent").count() == 0


def test_overrides_only_where_given(spark, world):
    items, _, feeds, groups, bridge = world
    ovr = spark.createDataFrame([(1, "mine"), (2, None)], "item_id bigint, title string")
    got = rows(overrides.apply_overrides(items.select("item_id", "title"), ovr))
    assert got == [(1, "mine"), (2, "t2"), (3, "t3"), (4, "t4")]
    view = spark.createDataFrame(
        [("a", "My A", 2), ("b", None, None)], "feed_id string, title string, group_id bigint"
    )
    assert rows(overrides.apply_view_overrides(feeds, view)) == [
        ("a", "My A"), ("b", "B"), ("c", "C")
    ]
    moved = overrides.apply_membership_overrides(bridge, view)
    assert rows(moved) == [(1, "b"), (2, "a")]


def test_favicons_default(spark, world):
    feeds = world[2]
    icons = spark.createDataFrame([("a", "data:a"), ("b", None)], "feed_id string, data string")
    assert rows(display.with_favicons(feeds, icons, "none")) == [
        ("a", "A", "data:a"), ("b", "B", "none"), ("c", "C", "none")
    ]


def test_alternative_url_keeps_items_of_feeds_without_service(spark):
    items = spark.createDataFrame(
        [(1, "a", "https://x/?q=1&r=2"), (2, "z", "https://y/")],
        "item_id bigint, feed_id string, url string",
    )
    services = spark.createDataFrame([("a", "https://s?u=")], "feed_id string, prefix string")
    assert rows(display.alternative_url(items, services).select("item_id", "read_url")) == [
        (1, "https://s?u=https%3A%2F%2Fx%2F%3Fq%3D1%26r%3D2"), (2, "https://y/")
    ]


def test_friendly_dates_and_sections(spark):
    now = at(29, 18, 30)
    times = {
        1: at(29, 18, 30), 2: at(29, 18, 28), 3: at(29, 18, 29), 4: at(29, 17, 0), 5: at(29, 16),
        6: at(28, 23, 59), 7: at(25), 8: at(2), 9: at(30), 10: at(1).replace(year=2023),
    }
    df = spark.createDataFrame(list(times.items()), "id int, created_at timestamp_ntz")
    got = {r.id: r.when for r in display.friendly_dates(df, "created_at", now).collect()}
    assert got == {
        1: "just now", 2: "2 minutes ago", 3: "1 minute ago", 4: "1 hour ago", 5: "2 hours ago",
        6: "Yesterday", 7: "Thursday", 8: "Tue 2 Jan", 9: "30 Jan 2024", 10: "1 Jan 2023",
    }
    assert rows(display.day_buckets(df, now)) == [
        ("Older", 2), ("This week", 1), ("Today", 5), ("Upcoming", 1), ("Yesterday", 1)
    ]
