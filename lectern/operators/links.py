"""Links and images that articles refer to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from lectern.functions import markup as M
from lectern.functions.text import drop_unseen
from lectern.functions.urls import absolute_url, canonical_url


def _references(pages: DataFrame, tag: str, attribute: str) -> DataFrame:
    """What an attribute of all tags of a name refers to, made absolute before it becomes a row."""
    found = F.transform(
        M.tags(drop_unseen("html"), tag), lambda t: absolute_url("url", M.attribute(t, attribute))
    )
    # Outer, as the plain form has Spark do all of the above again to test for rows.
    return pages.select(
        F.col("page_id").alias("item_id"), F.explode_outer(found).alias("url")
    ).where(F.col("url").isNotNull())


def extract_links(pages: DataFrame) -> DataFrame:
    """Outgoing links, absolute, one row per link as often as the page has it."""
    return _references(pages, "a", "href")


def hot_links(links: DataFrame, n: int) -> DataFrame:
    """URLs of the n highest ranks by number of distinct items; equal numbers share a rank.

    The n highest numbers are ranked on their own, so no single task sees all URLs.
    """
    counted = (
        links.select("item_id", canonical_url("url").alias("url"))
        .distinct()
        .groupBy("url")
        .agg(F.count(F.lit(1)).alias("items"))
    )
    top = counted.select("items").distinct().orderBy(F.desc("items")).limit(n)
    ranks = top.withColumn(
        "rank", F.row_number().over(Window.orderBy(F.desc("items"))).cast("bigint")
    )
    return counted.join(ranks, "items").select("rank", "url", "items")


def hot_links_estimate(links: DataFrame, rsd: float = 0.02) -> DataFrame:
    """Approximate number of distinct items per URL in a single pass, for very large link tables."""
    return (
        links.groupBy(canonical_url("url").alias("url"))
        .agg(F.approx_count_distinct("item_id", rsd).alias("items"))
    )


def land_sketches(links: DataFrame, path: str, landing: int, lg_k: int = 12) -> None:
    """Store, for one landing of links, a sketch per URL of the items that have it.

    Written again, a landing replaces itself; an item that lands twice counts once anyway.
    """
    sketches = links.groupBy(canonical_url("url").alias("url")).agg(
        F.hll_sketch_agg("item_id", F.lit(lg_k)).alias("sketch")
    )
    sketches.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(
        f"{path}/landing={landing}"
    )


def merged_links(spark: SparkSession, path: str) -> DataFrame:
    """About how many items have each URL, from the sketches of all landings; links aren't counted again."""
    stored = spark.read.schema("url string, sketch binary, landing bigint").parquet(path)
    union = F.hll_union_agg("sketch").alias("sketch")
    return stored.groupBy("url").agg(union).select("url", F.hll_sketch_estimate("sketch").alias("items"))


def image_manifest(pages: DataFrame) -> DataFrame:
    """Each image with each item that shows it, and the name a cache stores it under."""
    return (
        _references(pages, "img", "src")
        .distinct()
        .select("url", "item_id", F.md5("url").alias("cache_key"))
    )
