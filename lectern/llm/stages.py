"""Stages of the corpus pipeline; each keeps the columns of documents, but for the last.

A stage takes (spark, docs, sf_dir). Rows of one id with one text are one document to
the near-duplicate stage; rows without an id can't be named as another's copy and stay.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import decontaminate, mixing, ngram_join, sharding, toxicity
from lectern.llm.common import stored, table, tuned
from lectern.llm.queries import MIX, SHARDS, shard_columns

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

TOXIC = 0.5
# Nothing comes twice into the corpus, so weights only choose what stays out.
ONCE = replace(MIX, max_epochs=1, share=(9, 10))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scored = toxicity.score_toxicity(docs, table(tuned(spark), sf_dir, "labels"))
    return scored.where(F.col("score") < TOXIC).select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the one with the least id."""
    tuned(spark)
    groups = stored(ngram_join.near_duplicates(docs), "groups")
    dropped = groups.where("doc_id <> component_id").select("doc_id").distinct()
    kept = docs.join(stored(dropped, "dropped"), "doc_id", "left_anti")
    repeated = stored(
        groups.where("doc_id = component_id").groupBy("doc_id").count().where("count > 1").select("doc_id"),
        "repeated",
    )
    if not repeated.isEmpty():
        again = kept.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
        kept = kept.join(repeated, "doc_id", "left_anti").union(again)
    return kept.select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with any span of a benchmark window go as a whole."""
    found = decontaminate.find_passages(docs, table(tuned(spark), sf_dir, "benchmark"))
    return found.where(F.size("spans") == 0).select("row.*")


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    tuned(spark)
    return mixing.mix_sources(docs, ONCE).select("row.*")


def into_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    tuned(spark)
    return shard_columns(sharding.contiguous_shards(docs, SHARDS))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_to_weights),
    ("sharding", into_shards),
]
