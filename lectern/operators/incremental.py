"""The local copy, the search index and the live flags, kept in step by their changes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from lectern.operators.search import build_index, wanted_words
from lectern.operators.sync import content_hash
from lectern.schemas import CORPUS_FIGURES, STORED_POSTINGS
from lectern.sources.change_table import ChangeTable

DIGEST = "_digest"


# The local copy


def copy_table(spark: SparkSession, path: str, schema: StructType, key: str, buckets: int) -> ChangeTable:
    """A local copy by key; each row carries the digest that the next sync compares."""
    kept = StructType([*schema.fields, StructField(DIGEST, LongType())])
    return ChangeTable(spark, path, kept, (key,), (key,), buckets)


def changes(table: ChangeTable, remote: DataFrame) -> DataFrame:
    """Keys whose rows differ, with `status` new, changed or removed.

    Of the copy only keys and digests are read, of both sides only these are shuffled.
    """
    (key,) = table.key
    columns = [c for c in table.schema.fieldNames() if c not in (key, DIGEST)]
    here = table.read(columns=[key, DIGEST]).withColumnRenamed(DIGEST, "_here")
    there = remote.select(key, content_hash(columns).alias("_there"))
    status = (
        F.when(F.col("_here").isNull(), "new")
        .when(F.col("_there").isNull(), "removed")
        .when(F.col("_here") != F.col("_there"), "changed")
    )
    return here.join(there, key, "full").select(key, status.alias("status")).where("status is not null")


def sync_incremental(table: ChangeTable, remote: DataFrame, found: DataFrame, remove: bool = False) -> int:
    """Write the rows that `changes` found new or changed, and no other; returns the run's number.

    Rows the remote no longer has stay, as in `sync_upsert`, unless `remove` is given.
    """
    (key,) = table.key
    columns = [c for c in table.schema.fieldNames() if c not in (key, DIGEST)]
    coming = found.where("status <> 'removed'").select(key)
    rows = remote.join(coming, key, "left_semi").withColumn(DIGEST, content_hash(columns))
    void = found.where("status <> 'new'" if remove else "status = 'changed'").select(key)
    return table.write(rows, void)


# The search index


class Index:
    """Postings in buckets by term, and the length of every item, both kept in step by item."""

    def __init__(self, spark: SparkSession, path: str, buckets: int):
        schema = StructType([f for f in STORED_POSTINGS.fields if f.name != "bucket"])
        lengths = StructType([schema["item_id"], schema["item_length"]])
        self.spark, self.path, self.buckets = spark, path, buckets
        self.postings = ChangeTable(spark, f"{path}/postings", schema, ("item_id",), ("term",), buckets)
        self.lengths = ChangeTable(spark, f"{path}/lengths", lengths, ("item_id",), ("item_id",), buckets)

    def update(self, items: DataFrame, void: DataFrame | None = None) -> None:
        """Take up new and changed items; `void` holds the ids of items that changed or went.

        Only these items' texts are read, and only their postings are written. It is the texts that are
        dealt out evenly, as postings take several times their room.
        """
        posted = self.postings.next_run()
        rows = self.postings.lay(build_index(items.select("item_id", "text").hint("rebalance")), posted)
        # Position 0 exists once per item that has a word.
        run = self.lengths.write(rows.where(F.col("positions")[0] == 0).select("item_id", "item_length"), void)
        n = F.count(F.lit(1))
        figures = self.lengths.read().agg(
            n.alias("items"),
            (F.sum("item_length") / n.cast("double")).alias("mean_length"),
            F.lit(self.buckets).alias("buckets"),
        )
        figures.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/figures/run={run}")
        # Last, as searches see a run once its postings are listed.
        self.postings.publish(posted, void)

    def compact(self, buckets: Sequence[int] | None = None) -> None:
        self.postings.compact(buckets)

    def figures(self) -> DataFrame:
        """One row as `corpus_figures` gives it, added up when the index was written."""
        last, _ = self.lengths.listing()
        return self.spark.read.schema(CORPUS_FIGURES).parquet(f"{self.path}/figures/run={last}")

    def find(self, terms: Sequence[str]) -> DataFrame:
        """The postings of the terms, read from their buckets only."""
        wanted = wanted_words(terms)
        places = {self.postings.bucket_of(t) for t in wanted}
        return self.postings.read(places).where(F.col("term").isin(wanted))

    def find_in(self, terms: Sequence[str], items: DataFrame) -> DataFrame:
        """As `find`, of the items of a filter (`item_id`): postings of others are dropped as they are read."""
        return self.find(terms).join(items.select("item_id"), "item_id", "left_semi")
