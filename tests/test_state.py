from datetime import datetime

import pytest
from pyspark.sql import functions as F

from helpers import at, events, plan, rows
from lectern.operators import state


def test_latest_event_wins_and_event_id_breaks_ties(spark):
    log = events(
        spark,
        (1, 7, 10, "save", at(1)),
        (2, 7, 10, "unsave", at(2)),
        (3, 7, 10, "save", at(3)),
        (5, 7, 11, "unread", at(1)),
        (4, 7, 11, "read", at(1)),
        (6, 7, 12, "open", at(1)),
        (7, 8, 10, "read", at(1)),
    )
    got = rows(state.current_state(log))
    # Item 12 was only opened, so it has no state of its own.
    assert got == [(7, 10, False, True), (7, 11, False, False), (8, 10, True, False)]


def test_current_state_is_one_hash_aggregate(spark):
    text = plan(state.current_state(events(spark, (1, 7, 10, "save", at(1)))))
    assert "SortAggregate" not in text and "partial_max_by" in text


@pytest.mark.parametrize("bucket", ["hour", "day", "year"])
def test_as_of_carries_state_over_empty_buckets(spark, bucket):
    log = events(
        spark,
        (1, 7, 10, "read", at(1, 0)),
        (2, 7, 10, "unread", at(5, 3)),
        (3, 7, 10, "read", at(5, 3, 30)),
        (4, 7, 99, "read", at(1)),
    )
    syncs = spark.createDataFrame(
        [
            (100, 7, 10, datetime(2023, 12, 31)),
            (101, 7, 10, at(1, 0)),
            (102, 7, 10, at(3)),
            (103, 7, 10, at(5, 3, 15)),
            (104, 7, 10, at(5, 3, 45)),
            (105, 7, 10, at(20)),
            (106, 8, 10, at(20)),
            (107, None, 10, at(20)),
        ],
        "sync_id bigint, account_id bigint, item_id bigint, ts timestamp_ntz",
    )
    got = {r.sync_id: r.is_read for r in state.state_as_of(log, syncs, bucket=bucket).collect()}
    assert got == {
        100: False, 101: True, 102: True, 103: False, 104: True, 105: True, 106: False, 107: False
    }


@pytest.mark.parametrize("bucket", ["minute", "hour", "day", "year"])
def test_scans_do_not_depend_on_the_bucket(spark, bucket):
    """One hot item: the same history whatever way it is cut."""
    log = spark.range(500).select(
        F.col("id").alias("event_id"),
        F.lit(7).cast("bigint").alias("account_id"),
        F.lit(1).cast("bigint").alias("item_id"),
        F.when(F.xxhash64("id") % 3 == 0, "unsave").otherwise("save").alias("action"),
        F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, cast(id * 17 as int))").alias(
            "ts"
        ),
    )
    got = state.toggle_history(log, bucket=bucket).orderBy("event_id").collect()
    before, flips = False, 0
    for event, row in zip(log.orderBy("event_id").collect(), got, strict=True):
        now = event.action == "save"
        flips += now != before
        assert (row.from_state, row.to_state, row.flips) == (before, now, flips)
        before = now


@pytest.mark.parametrize("bucket", ["hour", "day", "year"])
def test_toggle_history_by_hand(spark, bucket):
    log = events(
        spark,
        (1, 7, 10, "save", at(1)),
        (2, 7, 10, "save", at(1)),
        (3, 7, 10, "unsave", at(9)),
        (4, 7, 10, "save", at(9, 5)),
        (5, 7, 11, "unsave", at(2)),
        (6, 7, 11, "read", at(3)),
    )
    got = rows(state.toggle_history(log, bucket=bucket).drop("ts"))
    assert got == [
        (1, 7, 10, False, True, 1),
        (2, 7, 10, True, True, 1),
        (3, 7, 10, True, False, 2),
        (4, 7, 10, False, True, 3),
        (5, 7, 11, False, False, 0),
    ]


@pytest.fixture(scope="module")
def listed(spark):
    return spark.createDataFrame(
        [(1, "a", at(1)), (2, "a", at(2)), (3, "a", at(2)), (4, "a", at(3)), (5, "b", at(2))],
        "item_id bigint, feed_id string, created_at timestamp_ntz",
    )


def test_marks_split_the_feed_around_the_pivot(listed):
    ids = {
        mode: sorted(r.item_id for r in state.mark_read(listed, 2, mode).collect())
        for mode in ("above", "below", "all")
    }
    # Item 3 is as old as the pivot and comes before it by its id.
    assert ids == {"above": [3, 4], "below": [1], "all": [1, 2, 3, 4]}
    with pytest.raises(ValueError):
        state.mark_read(listed, 2, "beside")


def test_marking_shuffles_nothing_but_the_pivot(listed):
    text = plan(state.mark_read(listed, 2, "above"))
    assert "BroadcastHashJoin" in text and "hashpartitioning" not in text


def test_marks_become_state(spark, listed):
    log = events(spark, (1, 7, 1, "unread", at(1)))
    marks = state.marks_as_events(
        state.mark_read(listed, 2, "all"), 7, "read", F.lit(at(4)).cast("timestamp_ntz"), 1000
    )
    got = state.apply_marks(log, marks)
    assert sorted(r.item_id for r in got.where("is_read").collect()) == [1, 2, 3, 4]


def test_unread_and_saved(spark, listed):
    flags = state.account_state(
        events(
            spark,
            (1, 7, 1, "read", at(1)),
            (2, 7, 2, "read", at(1)),
            (3, 7, 2, "unread", at(2)),
            (4, 7, 5, "save", at(1)),
            (5, 8, 3, "read", at(1)),
        ),
        7,
    )
    assert [r[0] for r in rows(state.unread_items(listed, flags))] == [2, 3, 4, 5]
    assert [r[0] for r in rows(state.saved_items(listed, flags))] == [5]


def test_preferences_last_write_and_defaults(spark):
    prefs = spark.createDataFrame(
        [
            (1, 7, "size", "10", at(1)),
            (3, 7, "size", "12", at(2)),
            (2, 7, "size", "11", at(2)),
            (4, 8, "theme", "dark", at(1)),
            (5, 8, "theme", None, at(2)),
            (6, 8, "unknown", "x", at(3)),
        ],
        "event_id bigint, account_id bigint, pref_key string, pref_value string, ts timestamp_ntz",
    )
    got = rows(state.preferences(prefs, {"size": "9", "theme": "light"}))
    assert got == [(7, "12", "light"), (8, "9", "dark")]




@pytest.mark.parametrize("bucket", ["hour", "day", "year"])
def test_an_event_without_a_time_is_the_oldest(spark, bucket):
    """The same answer however finely time is cut."""
    log = events(spark, (1, 7, 10, "read", None), (2, 7, 11, "read", None), (3, 7, 11, "unread", at(3)))
    syncs = spark.createDataFrame(
        [(100, 7, 10, at(1)), (101, 7, 10, None), (102, 7, 11, at(2)), (103, 7, 11, at(4))],
        "sync_id bigint, account_id bigint, item_id bigint, ts timestamp_ntz",
    )
    got = {r.sync_id: r.is_read for r in state.state_as_of(log, syncs, bucket=bucket).collect()}
    assert got == {100: True, 101: True, 102: True, 103: False}
    assert rows(state.current_state(log)) == [(7, 10, True, False), (7, 11, False, False)]


def jobs_so_far(spark):
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup())


def test_building_a_plan_runs_no_job(spark):
    from lectern.operators import overrides, sync

    log = events(spark, (1, 7, 10, "save", at(1)))
    syncs = log.select(F.col("event_id").alias("sync_id"), "account_id", "item_id", "ts")
    copy = spark.createDataFrame([(1, "a")], "item_id bigint, title string")
    before = jobs_so_far(spark)
    state.state_as_of(log, syncs)
    state.toggle_history(log)
    overrides.apply_overrides(copy, copy)
    sync.sync_upsert(copy, copy, "item_id")
    assert jobs_so_far(spark) == before
