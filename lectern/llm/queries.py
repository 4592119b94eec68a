"""The operators applied to the given tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import (
    decontaminate,
    exact_dedup,
    html_blocks,
    licenses,
    merkle,
    mixing,
    nearest,
    ngram_join,
    quality,
    secrets,
    sharding,
    spelling,
    toxicity,
)
from lectern.llm.common import crc_mod, table, tuned

SHARDS = 16

# Domains and weights of the sources; anything not listed is web with weight 1.
MIX = mixing.Mix(
    domain_of={
        f"src{i}": ("web", "books", "news", "code")[i % 4] for i in range(20)
    },
    domains={"web": 5, "books": 3, "news": 2, "code": 2},
    languages={"en": 6, "de": 2, "fr": 2, "es": 1},
)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_passages(docs, table(spark, sf_dir, "benchmark"))
    n_hit = decontaminate.hit_words()
    return found.select(
        F.col("row.doc_id").alias("doc_id"),
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    ledger = secrets.Ledger(spark)
    secrets.update_ledger(docs, ledger)
    found = secrets.findings_by_path(docs, ledger)
    of = lambda *kinds: F.filter("spans", lambda s: s["kind"].isin(*kinds))
    joined = lambda spans: F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )
    return found.select(
        "doc_id",
        *[F.size(of(kind)).cast("bigint").alias(f"n_{kind}") for kind in secrets.BASE],
        F.sha2(joined(of(*secrets.BASE)).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


def shard_columns(placed: DataFrame) -> DataFrame:
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op5_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_columns(sharding.contiguous_shards(table(spark, sf_dir, "documents"), SHARDS))


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    extracted = html_blocks.main_texts(table(spark, sf_dir, "pages"))
    return extracted.select("row.page_id", "row.url", "text", F.length("text").cast("bigint").alias("n_chars"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.score_quality(docs, table(spark, sf_dir, "labels"))
    return scored.select(
        F.col("row.doc_id").alias("doc_id"),
        "held_out",
        "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
    )


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score_toxicity(docs, table(spark, sf_dir, "labels"))
    return scored.select(
        F.col("row.doc_id").alias("doc_id"),
        "held_out",
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.find_licenses(table(spark, sf_dir, "documents"))
    starts = F.transform("places", lambda p: p["start"])
    base = F.array_distinct(F.transform("places", lambda p: p["label"]))
    has_base = F.size("places") > 0
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("bigint").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        F.array_join(F.array_sort(base), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, F.col("template_labels"))), ",").alias("labels"),
        F.when(has_base, 1.0).otherwise(F.col("containment")).alias("score"),
    )


def op10_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = mixing.mix_sources(table(spark, sf_dir, "documents"), MIX)
    return kept.select(
        F.col("row.doc_id").alias("doc_id"),
        "domain",
        "language",
        F.col("origin").alias("source"),
        "tokens",
        "epoch",
        F.col("budget").alias("leaf_budget"),
    )


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


def op12_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def merkle_manifest(docs: DataFrame, levels: int = merkle.BLOCK_LEVELS) -> DataFrame:
    def leaf(n_chars) -> Column:
        return merkle.leaf_digest(F.col("doc_id"), F.col("source"), F.col("lang"), n_chars, F.col("text"))

    # Shown with another length later.
    tampered = leaf(F.col("n_chars").cast("decimal(20,0)") + 1)
    claimed = F.when(crc_mod("doc_id", 7) == 0, tampered)
    return merkle.manifest(docs, "doc_id", "lang", leaf(F.col("n_chars")), claimed, levels)


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_manifest(table(spark, sf_dir, "documents"))


QUERIES = (
    op1_decontaminate,
    op2_exact_dedup,
    op3_secrets,
    op4_ngram_join,
    op5_shards,
    op6_main_text,
    op7_quality,
    op8_toxicity,
    op9_licenses,
    op10_mix,
    op11_spelling,
    op12_nearest,
    op13_merkle,
)


def llm_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def tuned_query(query):
        return lambda spark, sf_dir: query(tuned(spark), sf_dir)

    return {query.__name__: tuned_query(query) for query in QUERIES}
