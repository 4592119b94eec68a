"""Events taken once, late ones kept apart, and live flags: the same however what landed is cut."""

from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from helpers import STATE, at, events, rows
from lectern.operators import state
from lectern.session import new_folder
from lectern.streaming import feeds as streams, live
from lectern.streaming.once import take_once

ACTIONS = ["read", "unread", "save", "unsave", "open"]


@pytest.fixture
def log(spark):
    return events(
        spark,
        *[(n, n % 3, n % 5, ACTIONS[(n * 7 + n // 5) % 5], at(1) + timedelta(hours=n)) for n in range(90)],
        (500, 1, 1, "read", None),
    )


def land(df, path, files):
    for n in range(files):
        df.where(F.coalesce(F.col("event_id"), F.lit(0)) % files == n).coalesce(1).write.mode("append").parquet(path)


def stream(spark, path, df):
    return streams.stream_items(spark, path, df.schema, files_per_batch=1)


@pytest.mark.parametrize("files", [1, 4])
def test_events_are_taken_once_and_late_ones_kept(spark, log, files):
    path, folder = new_folder(spark, "land"), new_folder(spark, "s")
    land(log, path, files)
    land(log.where("event_id > 40"), path, 1)
    first = take_once(stream(spark, path, log), folder, "1 day")
    assert rows(first.rows) == rows(log) and first.late.count() == 0
    came = first.figures.agg(F.sum("came"), F.sum("taken"), F.sum("late")).first()
    assert tuple(came) == (91 + 50, 91, 0)

    # Resent ones, new ones in time, and new ones behind the mark: hour 89 less a day.
    new = events(spark, *[(1000 + n, 1, 2, "save", at(1) + timedelta(hours=n)) for n in range(60, 100)])
    land(new, path, files)
    land(log.where("event_id >= 80"), path, 1)
    again = take_once(stream(spark, path, log), folder, "1 day")
    assert rows(again.late) == rows(new.where("event_id <= 1065"))
    assert rows(again.rows) == rows(log.unionByName(new.where("event_id > 1065")))
    came, taken, late = again.figures.agg(F.sum("came"), F.sum("taken"), F.sum("late")).first()
    duplicates = 50 + 11
    assert came == 91 + 50 + 40 + 11 and taken + late + duplicates == came

    # Nothing landed: nothing changes, and the mark stays where it is.
    idle = take_once(stream(spark, path, log), folder, "1 day")
    assert rows(idle.rows) == rows(again.rows) and rows(idle.late) == rows(again.late)


def test_nothing_landed(spark):
    path = new_folder(spark, "land")
    empty = spark.createDataFrame([], STATE)
    empty.coalesce(1).write.parquet(path)
    taken = take_once(stream(spark, path, empty), new_folder(spark, "s"), "1 day")
    assert taken.rows.count() == taken.late.count() == 0


def test_only_days_of_the_batch_are_opened(spark, log):
    from lectern.streaming.once import accepted

    path, folder = new_folder(spark, "land"), new_folder(spark, "s")
    land(log, path, 1)
    take_once(stream(spark, path, log), folder)
    some = accepted(spark, folder, log.schema, ["2024-01-02", "2024-03-01"])
    assert some.inputFiles() and all("day=2024-01-02/" in f for f in some.inputFiles())
    assert some.count() == 24
    assert accepted(spark, folder, log.schema, ["2025-01-01"]).count() == 0


@pytest.mark.parametrize("files, most_runs", [(1, 8), (6, 2)])
def test_live_flags_are_the_batch_flags(spark, log, files, most_runs):
    path, folder = new_folder(spark, "land"), new_folder(spark, "live")
    log = log.unionByName(events(spark, (600, None, 1, "read", at(2)), (601, 1, None, "save", at(2))))
    flags = live.live_flags(spark, f"{folder}/flags", 4)
    for part in (log.where("event_id % 2 = 1"), log.where("event_id % 2 = 0")):
        land(part, path, files)
        live.fold_flags(stream(spark, path, log), flags, f"{folder}/progress", most_runs)
    assert rows(flags.read()) == rows(state.current_state(log))
    assert len({run for run, _ in flags.listing()[1]}) <= most_runs
    for account in range(4):
        assert rows(live.account_flags(flags, account)) == rows(state.account_state(log, account))


def test_a_repeated_batch_changes_nothing(spark, log):
    flags = live.live_flags(spark, new_folder(spark, "flags"), 4)
    now = state.current_state(log)
    for _ in range(2):
        flags.write(now, now.select(*state.KEYS))
    assert rows(flags.read()) == rows(now)
