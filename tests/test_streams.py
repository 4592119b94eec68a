from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from helpers import STATE, at, events, rows
from lectern import schemas
from lectern.operators import state
from lectern.plans import steps
from lectern.session import new_folder
from lectern.sources.reader_model import ReaderTables
from lectern.streaming import feeds as streams, runner
from registry import queries


def land(df, path, files=1):
    df.coalesce(files).write.mode("append").parquet(path)


def stream(spark, path, df, files=1):
    return streams.stream_items(spark, path, df.schema, files_per_batch=files)


@pytest.fixture
def log(spark):
    actions = ["read", "unread", "save", "unsave", "open"]
    return events(
        spark,
        *[
            (n, n % 3, n % 5, actions[(n * 7 + n // 5) % 5], at(1) + timedelta(hours=n))
            for n in range(60)
        ],
    )


@pytest.mark.parametrize("order", [False, True])
def test_streamed_state_is_the_batch_state_in_any_file_order(spark, log, order):
    path = new_folder(spark, "land")
    parts = [log.where(F.col("event_id") % 4 == n) for n in range(4)]
    for part in reversed(parts) if order else parts:
        land(part, path)
    flags, query = runner.run_update(
        streams.stream_state(stream(spark, path, log)), new_folder(spark, "s"), state.KEYS
    )
    assert rows(flags) == rows(state.current_state(log))
    assert len([p for p in query.recentProgress if p["numInputRows"]]) == 4


def test_resumed_stream_takes_up_where_it_stopped(spark, log):
    path, folder = new_folder(spark, "land"), new_folder(spark, "s")
    land(log.where("event_id < 30"), path)

    def run():
        return runner.run_update(
            streams.stream_state(stream(spark, path, log)), folder, state.KEYS
        )

    run()
    land(log.where("event_id >= 30"), path)
    flags, query = run()
    assert rows(flags) == rows(state.current_state(log))
    assert sum(p["numInputRows"] for p in query.recentProgress) == 30


def test_resent_events_count_once(spark, log):
    path = new_folder(spark, "land")
    land(log, path)
    land(log.where("event_id > 50"), path)
    once, _ = runner.run_append(
        streams.stream_dedupe(stream(spark, path, log)), new_folder(spark, "s")
    )
    assert once.count() == 60
    counted, _ = runner.run_update(
        streams.stream_counts(stream(spark, path, log)), new_folder(spark, "s"), ["window_start"]
    )
    assert counted.agg(F.sum("events")).first()[0] == 60
    assert counted.where("events <> 6").count() == 0


def test_late_events_inside_the_watermark_count_and_others_are_dropped(spark, log):
    path, folder = new_folder(spark, "land"), new_folder(spark, "s")
    land(log, path)

    def run():
        windows = streams.stream_counts(stream(spark, path, log), delay="12 hours")
        return runner.run_update(windows, folder, ["window_start"])

    run()
    newest = at(1) + timedelta(hours=59)
    late = events(
        spark,
        *[(1000 + n, 1, 1, "read", newest - timedelta(hours=11)) for n in range(3)],
        *[(2000 + n, 1, 1, "read", newest - timedelta(hours=13)) for n in range(50)],
    )
    land(late, path)
    counted, query = run()
    assert runner.dropped_late(query) == 50
    assert counted.agg(F.sum("events")).first()[0] == 63


@pytest.mark.parametrize("files", [1, 4])
def test_no_event_is_lost_however_files_are_cut(spark, files):
    """Interleaved files, each reaching over the whole time."""
    log = events(spark, *[(n, n % 3, n % 5, "read", at(1) + timedelta(hours=n)) for n in range(400)])
    path = new_folder(spark, "land")
    for n in range(files):
        land(log.where(F.col("event_id") % files == n), path)
    once, _ = runner.run_append(
        streams.stream_dedupe(stream(spark, path, log)), new_folder(spark, "s")
    )
    assert once.count() == 400
    counted, _ = runner.run_update(
        streams.stream_counts(stream(spark, path, log)), new_folder(spark, "s"), ["window_start"]
    )
    assert counted.agg(F.sum("events")).first()[0] == 400


def test_append_emits_only_finished_windows(spark, log):
    path = new_folder(spark, "land")
    land(log, path)
    windows, _ = runner.run_append(
        streams.stream_counts(stream(spark, path, log), delay="12 hours"), new_folder(spark, "s")
    )
    # The last event is at hour 59, so windows up to hour 42 have closed for good.
    assert rows(windows.select("events")) == [(6,)] * 7


def test_nothing_landed_gives_an_empty_table(spark):
    path = new_folder(spark, "land")
    empty = spark.createDataFrame([], STATE)
    land(empty, path)
    flags, _ = runner.run_update(
        streams.stream_state(stream(spark, path, empty)), new_folder(spark, "s"), state.KEYS
    )
    assert flags.count() == 0


def test_items_of_unknown_feeds_stay(spark):
    items = spark.createDataFrame(
        [(1, "a", "t", "u"), (2, "new", "t", "u")],
        "item_id bigint, feed_id string, title string, url string",
    )
    path = new_folder(spark, "land")
    land(items, path)
    feeds = spark.createDataFrame([("a", "A")], "feed_id string, title string")
    icons = spark.createDataFrame([("a", "data:a")], "feed_id string, data string")
    shown, _ = runner.run_append(
        streams.stream_enriched(stream(spark, path, items), feeds, icons, "none"),
        new_folder(spark, "s"),
    )
    assert rows(shown) == [(1, "a", "A", "data:a", "t", "u"), (2, "new", None, "none", "t", "u")]


def test_a_table_lands_in_as_many_files_as_it_is_read_in(spark, monkeypatch):
    """One file a batch would be one task for a third of the table, however large that is."""
    directory, landed = new_folder(spark, "tables"), new_folder(spark, "land")
    known = schemas.SOURCE_TABLES["labels"]
    some = spark.range(120).select(*[F.col("id").cast(f.dataType).alias(f.name) for f in known])
    some.repartition(12).write.parquet(f"{directory}/labels.parquet")
    monkeypatch.setattr(queries, "new_folder", lambda spark, purpose: landed)
    arriving = queries._landed(ReaderTables(spark, directory), "labels")
    whole = spark.read.parquet(f"{directory}/labels.parquet")
    assert len(spark.read.parquet(landed).inputFiles()) >= whole.rdd.getNumPartitions() > queries.LANDED_BATCHES
    taken, query = runner.run_append(arriving, new_folder(spark, "s"))
    assert rows(taken) == rows(some)
    assert sum(p["numInputRows"] > 0 for p in query.recentProgress) == queries.LANDED_BATCHES


def test_feeds_are_made_once_and_not_in_each_batch(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(queries, "stored", lambda df, purpose: kept.append(purpose) or steps.stored(df, purpose))
    r = ReaderTables(spark, new_folder(spark, "tables"))
    known = schemas.SOURCE_TABLES["documents"]
    docs = spark.createDataFrame([(n, f"feed{n % 4}", f"title {n}") for n in range(20)], "doc_id long, source string, text string")
    docs = docs.select(*[(F.col(f.name) if f.name in docs.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in known])
    docs.write.parquet(f"{r.directory}/documents.parquet")
    r.__dict__["source"] = {"documents": docs}
    shown = queries.q_stream_enriched(r)
    want = [(n, f"Feed {n % 4}") for n in range(20)]
    assert rows(shown.select("item_id", "feed_title")) == sorted(want, key=repr)
    assert sorted(kept) == ["favicons", "feeds"]
