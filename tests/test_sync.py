import pytest
from pyspark.sql import functions as F

from helpers import plan, rows
from lectern.operators import sync
from lectern.session import new_folder
from lectern.sources import ingest, tables
from lectern.schemas import EVENT_PROPS, ITEM_PAYLOAD

COPY = "item_id bigint, feed_id string, title string, text string"


@pytest.fixture(scope="module")
def local(spark):
    return spark.createDataFrame(
        [(1, "a", "one", "x"), (2, "a", None, "y"), (3, "b", "three", "z"), (4, "b", "four", "w")],
        COPY,
    )


@pytest.fixture(scope="module")
def remote(spark):
    return spark.createDataFrame(
        [(1, "a", "one", "x"), (2, "a", "y", None), (4, "b", "four!", "w"), (9, "c", "nine", "v")],
        COPY,
    )


def test_diff_labels_every_key_of_both_copies(local, remote):
    got = rows(sync.sync_diff(local, remote, "item_id", ["feed_id", "title", "text"]))
    # Row 2 moved a value from one null-able column to another.
    assert got == [(1, "same"), (2, "changed"), (3, "removed"), (4, "changed"), (9, "new")]


def test_upsert_prefers_remote_keeps_local_and_is_idempotent(local, remote):
    once = sync.sync_upsert(local, remote, "item_id")
    assert rows(once) == sorted(
        [*rows(remote), (3, "b", "three", "z")], key=repr
    )
    assert rows(sync.sync_upsert(once, remote, "item_id")) == rows(once)


def test_new_since_uses_the_highest_local_key(spark, local, remote):
    assert [r[0] for r in rows(sync.new_since(remote, local, "item_id"))] == [9]
    empty = spark.createDataFrame([], COPY)
    assert sync.new_since(remote, empty, "item_id").count() == 4


def test_removed_items_and_rows_without_a_key(spark, local, remote):
    assert [r[0] for r in rows(sync.removed_items(local, remote, "item_id"))] == [3]
    keyless = spark.createDataFrame([(None,), (1,), (2,)], "item_id bigint")
    one = spark.createDataFrame([(1,)], "item_id bigint")
    assert rows(sync.removed_items(keyless, one, "item_id")) == [(2,), (None,)]


def test_whole_row_comparison(local, remote):
    assert [r[0] for r in rows(sync.unchanged_rows(local, remote))] == [1]
    assert [r[0] for r in rows(sync.changed_rows(local, remote))] == [2, 3, 4]
    doubled = local.union(local)
    assert sync.changed_rows(doubled, local).count() == 4


def test_dedupe_ignores_case_and_keeps_items_without_text(spark):
    items = spark.createDataFrame(
        [(5, "Same"), (3, "same"), (4, "other"), (1, None), (2, None)],
        "item_id bigint, text string",
    )
    got = rows(sync.dedupe_items(items).select("item_id", "copies"))
    assert got == [(1, 1), (2, 1), (3, 2), (4, 1)]


def test_dedupe_counts_copies_before_the_shuffle(spark):
    items = spark.range(1000).select(F.col("id").alias("item_id"), F.lit("one text").alias("text"))
    df = sync.dedupe_items(items)
    assert rows(df.select("item_id", "copies")) == [(0, 1000)]
    # The step that counts is stored, so its plan is its own.
    assert "partial_min" in plan(sync.copy_groups(items.withColumnRenamed("text", "_content"), "item_id"))


def test_union_accounts_first_copy_wins_and_columns_are_filled(spark):
    one = spark.createDataFrame([(1, 7, "kept")], "account_id bigint, item_id bigint, title string")
    again = one.withColumn("title", F.lit("late"))
    two = spark.createDataFrame(
        [(2, 7, "other", "f")], "account_id bigint, item_id bigint, title string, feed_id string"
    )
    got = rows(sync.union_accounts([one, two, again], ["account_id", "item_id"]))
    assert got == [(1, 7, "kept", None), (2, 7, "other", "f")]


def test_local_copy_versions(spark, local, remote):
    path = new_folder(spark, "test-copy")
    assert tables.latest_version(spark, path) is None
    tables.write_local_copy(local, path, 1)
    tables.write_local_copy(remote, path, 2)
    assert tables.latest_version(spark, path) == 2
    assert rows(tables.read_local_copy(spark, path, local.schema).select(*local.columns)) == rows(
        remote
    )
    first = tables.read_local_copy(spark, path, local.schema, version=1)
    assert rows(first.select(*local.columns)) == rows(local)
    one_feed = first.where(F.col("feed_id") == "a")
    assert one_feed.count() == 2
    assert "PartitionFilters: [isnotnull(feed_id" in plan(one_feed)


def test_refresh_replaces_only_the_feeds_given(spark, local):
    path = new_folder(spark, "test-copy")
    tables.write_local_copy(local, path, 1)
    newer = spark.createDataFrame([(8, "b", "eight", "q")], COPY)
    tables.refresh_feeds(newer, path, 1)
    got = tables.read_local_copy(spark, path, local.schema)
    assert sorted(r.item_id for r in got.collect()) == [1, 2, 8]


def test_malformed_payloads_are_set_aside_whole(spark):
    landed = spark.createDataFrame(
        [(1, '{"k": 5}'), (2, '{"k": '), (3, None), (4, '{"k": "no number"}'), (5, "{}")],
        "id bigint, payload string",
    )
    good = ingest.ingest_snapshot(landed, "payload", EVENT_PROPS)
    assert rows(good) == [(1, 5), (5, None)]
    bad = ingest.ingest_rejected(landed, "payload", EVENT_PROPS)
    assert rows(bad) == [(2, '{"k": '), (3, None), (4, '{"k": "no number"}')]


def test_nested_payload_becomes_one_row_per_item(spark):
    payload = (
        '{"feed": {"id": "f", "lang": "en"}, "items": '
        '[{"id": 1, "title": "a", "tags": ["x", "y"]}, {"id": 2}]}'
    )
    landed = spark.createDataFrame([(payload,)], "payload string")
    parsed = ingest.ingest_snapshot(landed, "payload", ITEM_PAYLOAD)
    got = rows(ingest.flatten_items(parsed))
    assert got == [(1, "f", "en", "a", "x,y"), (2, "f", "en", None, None)]
