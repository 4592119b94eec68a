"""Tables kept in step by changes: equal to what a rebuild gives, and nothing else is written."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from helpers import plan, rows
from lectern.operators import incremental, search, sync
from lectern.session import new_folder
from lectern.sources.change_table import ChangeTable

SCHEMA = StructType([StructField("item_id", LongType()), StructField("word", StringType()), StructField("n", LongType())])
ITEMS = StructType([StructField("item_id", LongType()), StructField("text", StringType())])


def table(spark, bucket_by=("item_id",), buckets=4):
    return ChangeTable(spark, new_folder(spark, "t"), SCHEMA, ("item_id",), bucket_by, buckets)


@pytest.mark.parametrize("bucket_by", [("item_id",), ("word",)])
def test_any_order_of_changes(spark, bucket_by):
    rng = random.Random(len(bucket_by[0]))
    kept = table(spark, bucket_by)
    assert rows(kept.read()) == []
    want = {}
    for step in range(7):
        if step in (3, 5):
            kept.compact(None if step == 5 else [0, 2])
        touched = rng.sample(range(30), 8)
        gone = touched[:2]
        coming = {i: [(i, f"w{n}", step) for n in range(rng.randrange(1, 4))] for i in touched[2:]}
        kept.write(
            spark.createDataFrame([r for some in coming.values() for r in some], SCHEMA),
            spark.createDataFrame([(i,) for i in touched], "item_id bigint"),
        )
        want = {i: r for i, r in want.items() if i not in gone} | coming
        assert rows(kept.read()) == sorted((r for some in want.values() for r in some), key=repr)
    parts = {b: rows(kept.read([b])) for b in range(4)}
    assert sorted((r for p in parts.values() for r in p), key=repr) == rows(kept.read())


def test_a_run_that_dies_is_not_seen(spark):
    kept = table(spark)
    kept.write(spark.createDataFrame([(1, "a", 1)], SCHEMA))
    # Rows and voids of a run that never came to be listed.
    spark.createDataFrame([(2, "b", 1, 0)], "item_id long, word string, n long, bucket int").write.partitionBy("bucket").parquet(f"{kept.path}/rows/run=2")
    assert rows(kept.read()) == [(1, "a", 1)]
    kept.write(spark.createDataFrame([(3, "c", 1)], SCHEMA), spark.createDataFrame([], "item_id long"))
    assert rows(kept.read()) == [(1, "a", 1), (3, "c", 1)]


def test_buckets_not_asked_for_stay_closed(spark):
    kept = table(spark, ("word",), 8)
    kept.write(spark.createDataFrame([(n, f"w{n}", 0) for n in range(100)], SCHEMA))
    bucket = kept.bucket_of("w7")
    files = kept.read([bucket]).inputFiles()
    read = [f for f in files if "/rows/" in f]
    assert read and all(f"bucket={bucket}/" in f for f in read)
    assert kept.read([bucket]).where("word = 'w7'").count() == 1


def test_rows_that_are_laid_are_not_shuffled_and_not_seen_until_published(spark):
    kept = table(spark, ("word",), 2)
    kept.write(spark.createDataFrame([(1, "a", 1), (2, "a", 1)], SCHEMA))
    coming = spark.createDataFrame([(n, "a", n) for n in range(2, 8)], SCHEMA).repartition(3)
    run = kept.next_run()
    laid = kept.lay(coming, run)
    # A file of each task, where a shuffle by bucket would leave one.
    assert len(laid.inputFiles()) == 3 and rows(laid.select("item_id")) == [(n,) for n in range(2, 8)]
    assert rows(kept.read()) == [(1, "a", 1), (2, "a", 1)]
    assert kept.publish(run, spark.createDataFrame([(2,)], "item_id bigint")) == run
    assert rows(kept.read()) == [(1, "a", 1)] + [(n, "a", n) for n in range(2, 8)]


def test_an_index_writes_each_posting_without_a_shuffle_of_postings(spark):
    index = incremental.Index(spark, new_folder(spark, "i"), 2)
    index.update(spark.createDataFrame([(1, "a b a"), (1, "a b a"), (None, "b"), (2, None), (3, " ")], ITEMS))
    assert rows(index.lengths.read()) == [(1, 3), (1, 3), (None, 1)]
    laid = []
    lay = ChangeTable.lay
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(ChangeTable, "lay", lambda self, some, run: laid.append(plan(some)) or lay(self, some, run))
        index.update(spark.createDataFrame([(4, "c")], ITEMS))
    # What is shuffled, texts, lies below the cutting into words.
    (shown,) = laid
    assert "Exchange" in shown and shown.index("Exchange") > shown.index("regexp_extract_all")


def copies(spark):
    local = spark.createDataFrame([(n, f"text {n}") for n in range(50)] + [(99, None)], ITEMS)
    remote = spark.createDataFrame(
        [(n, f"text {n}" + "!" * (n % 7 == 0)) for n in range(10, 60)] + [(99, "now text")], ITEMS
    )
    return local, remote


def test_a_sync_writes_only_what_changed(spark):
    local, remote = copies(spark)
    kept = incremental.copy_table(spark, new_folder(spark, "c"), ITEMS, "item_id", 4)
    incremental.sync_incremental(kept, local, incremental.changes(kept, local))
    found = incremental.changes(kept, remote)
    status = {r.item_id: r.status for r in found.collect()}
    assert status[0] == "removed" and status[14] == "changed" and status[55] == "new" and status[99] == "changed"
    run = incremental.sync_incremental(kept, remote, found)
    written = spark.read.parquet(f"{kept.path}/rows/run={run}")
    assert written.count() == sum(s != "removed" for s in status.values()) == 17
    assert rows(kept.read(columns=["item_id", "text"])) == rows(sync.sync_upsert(local, remote, "item_id"))
    # In step: nothing new or changed, and the next run is empty.
    again = incremental.changes(kept, remote)
    assert {r.status for r in again.collect()} == {"removed"}
    run = incremental.sync_incremental(kept, remote, again, remove=True)
    assert not [p for p in kept.listing()[1] if p[0] == run]
    assert rows(kept.read(columns=["item_id", "text"])) == rows(remote)
    assert incremental.changes(kept, remote).isEmpty()


def test_an_updated_index_is_the_rebuilt_one(spark):
    local, remote = copies(spark)
    index = incremental.Index(spark, new_folder(spark, "i"), 4)
    index.update(local)
    found = sync.sync_diff(local, remote, "item_id", ["text"])
    coming = remote.join(found.where("status in ('new', 'changed')"), "item_id", "left_semi")
    index.update(coming, found.where("status in ('changed', 'removed')").select("item_id"))
    want = rows(search.build_index(remote))
    assert rows(index.postings.read()) == want
    written = spark.read.parquet(f"{index.path}/postings/rows/run=2").select("item_id").distinct().count()
    assert written == coming.count() < remote.count()
    assert rows(index.figures().select("items", "mean_length")) == rows(search.corpus_figures(remote))
    for buckets in ([1, 3], None):
        index.compact(buckets)
        assert rows(index.postings.read()) == want
    assert len({run for run, _ in index.postings.listing()[1]}) == 1
    assert rows(search.search_all(index.find(["text", "now"]), ["text", "now"])) == [(99, 2)]
    some = remote.where("item_id < 20")
    assert rows(search.search_all(index.find_in(["text"], some), ["text"])) == [(n, 1) for n in range(10, 20)]


def test_an_index_of_nothing(spark):
    index = incremental.Index(spark, new_folder(spark, "i"), 4)
    index.update(spark.createDataFrame([(1, None), (2, "")], ITEMS))
    assert rows(index.postings.read()) == [] and rows(index.find(["x"])) == []
    assert index.figures().first()["items"] == 0
