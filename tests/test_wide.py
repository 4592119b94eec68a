"""Counts of all accounts, merged link sketches, the sink by partition, and what must not be shuffled."""

import os
import random

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from helpers import plan, rows
from lectern.operators import articles, counts, links, sync
from lectern.session import new_folder
from lectern.sources.partition_sink import read_parts, write_changed

ITEMS = "item_id bigint, feed_id string, text string"


def exchanges(df):
    """What each exchange of a plan moves: the columns of the node below it."""
    lines = plan(df).splitlines()
    return [lines[n + 1] for n, line in enumerate(lines) if "Exchange " in line and "Broadcast" not in line]


def test_counts_of_all_accounts(spark):
    rng = random.Random(4)
    items = [(n, f"f{n % 7}", "") for n in range(100)]
    flags = [(a, n, rng.random() < 0.5, rng.random() < 0.3) for a in range(9) for n in rng.sample(range(110), 40)]
    follows = sorted({(rng.randrange(12), f"f{rng.randrange(9)}") for _ in range(50)})
    got = counts.account_counts(
        spark.createDataFrame(items, ITEMS),
        spark.createDataFrame(flags, "account_id bigint, item_id bigint, is_read boolean, is_saved boolean"),
        spark.createDataFrame(follows + follows[:3], "account_id bigint, feed_id string"),
    )
    state = {(a, n): (read, saved) for a, n, read, saved in flags}
    want = []
    for a, f in follows:
        mine = [state.get((a, n), (False, False)) for n, feed, _ in items if feed == f]
        want.append((a, f, len(mine), sum(not r for r, _ in mine), sum(s for _, s in mine)))
    assert rows(got) == sorted(want, key=repr)


def test_merged_sketches_are_the_sketch_of_the_whole(spark):
    found = spark.range(60_000).select(
        F.col("id").alias("item_id"),
        F.concat(F.lit("https://a.org/"), F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 900).cast("string"))).alias("url"),
    )
    parts, whole = new_folder(spark, "p"), new_folder(spark, "w")
    for landing in range(4):
        links.land_sketches(found.where(F.col("item_id") % 4 == landing), parts, landing)
    links.land_sketches(found.where(F.col("item_id") % 4 == 2), parts, 2)
    links.land_sketches(found.where(F.col("item_id") % 4 == 2), parts, 9)
    links.land_sketches(found, whole, 0)
    merged = links.merged_links(spark, parts)
    assert rows(merged) == rows(links.merged_links(spark, whole))
    got = dict(rows(merged))
    exact = dict(rows(found.groupBy("url").count()))
    assert got.keys() == exact.keys()
    # Three deviations of a sketch of 4096 registers.
    assert all(abs(got[u] - n) <= max(1, 3 * 1.04 / 64 * n) for u, n in exact.items())


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_a_second_run_rewrites_one_partition(spark):
    path = new_folder(spark, "sink")
    schema = StructType.fromDDL("item_id bigint, page string, feed_id string")

    def run(data):
        df = spark.createDataFrame(data, ITEMS)
        changed = write_changed(df, "feed_id", lambda d: d.select("item_id", F.upper("text").alias("page"), "feed_id"), path)
        want = sorted(((n, t.upper(), f) for n, f, t in data), key=repr)
        assert rows(read_parts(spark, path, schema, "feed_id").select("item_id", "page", "feed_id")) == want
        return dict(rows(changed))

    items = [(n, None if n % 5 == 0 else f"f{n % 5}", f"t{n}") for n in range(50)]
    assert set(run(items).values()) == {"new"}
    before = files(f"{path}/rows")
    assert run(items) == {} and files(f"{path}/rows") == before
    later = [(n, f, t + "!" * (n == 7)) for n, f, t in items]
    assert run(later) == {"f2": "changed"}
    after = files(f"{path}/rows")
    same = {f for f in before if "feed_id=f2/" not in f}
    assert {f: after.get(f) for f in same} == {f: before[f] for f in same}
    assert not [f for f in after if f in before and "feed_id=f2/" in f]
    gone = [r for r in later if r[1] != "f3"]
    assert run(gone) == {"f3": "removed"}
    assert run(later) == {"f3": "new"}
    assert run([r for r in later if r[1] is not None]) == {None: "removed"}


def test_texts_stay_where_they_are(spark):
    pages = spark.createDataFrame([(n, f"https://h{n}.example.net/", "<p>x</p>") for n in range(30)], "page_id bigint, url string, html string")
    folder = new_folder(spark, "pages")
    pages.write.parquet(folder)
    pages = spark.read.parquet(folder)
    patterns = spark.createDataFrame([("example.net", "article"), ("h1.example.net", "h1")], "host_suffix string, body_pattern string")
    matched = articles.match_site_pattern(pages, patterns)
    assert not exchanges(matched) and "SortMergeJoin" not in plan(matched)
    folder = new_folder(spark, "items")
    spark.createDataFrame([(n, "f", f"text {n % 20}") for n in range(30)], ITEMS).write.parquet(folder)
    deduped = sync.dedupe_items(spark.read.parquet(folder))
    assert not [line for line in exchanges(deduped) if "text" in line]
    assert deduped.count() == 20
