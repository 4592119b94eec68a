"""Keeping the local copy in step with the remote one."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from lectern.plans.ordering import first_n_per_key
from lectern.plans.steps import stored


def content_hash(columns: Sequence[str]) -> Column:
    """64 bits per row, compared only within one key; null and absent values differ."""
    return F.xxhash64(*[e for c in columns for e in (F.col(c).isNull(), F.col(c))])


def sync_diff(
    local: DataFrame, remote: DataFrame, key: str, columns: Sequence[str]
) -> DataFrame:
    """`key` with `status`: new, removed, changed or same. Only key and hash are shuffled."""
    here = local.select(key, content_hash(columns).alias("_here"))
    there = remote.select(key, content_hash(columns).alias("_there"))
    status = (
        F.when(F.col("_here").isNull(), "new")
        .when(F.col("_there").isNull(), "removed")
        .when(F.col("_here") != F.col("_there"), "changed")
        .otherwise("same")
    )
    return here.join(there, key, "full").select(key, status.alias("status"))


def sync_upsert(local: DataFrame, remote: DataFrame, key: str) -> DataFrame:
    """The next snapshot: every remote row, and local rows the remote does not have.

    Remote rows pass straight through; of them only keys are shuffled.
    """
    return remote.unionByName(removed_items(local, remote, key).select(*remote.columns))


def removed_items(local: DataFrame, remote: DataFrame, key: str) -> DataFrame:
    """Local rows whose key the remote does not have; a row without a key is in no remote."""
    return local.join(remote.select(key), key, "left_anti").select(*local.columns)


def new_since(remote: DataFrame, local: DataFrame, key: str) -> DataFrame:
    """Remote rows above the highest local key; all of them while the local copy is empty."""
    highest = local.select(F.max(key)).scalar()
    return remote.where(F.col(key) > F.coalesce(highest, F.lit(-(2**63))))


def unchanged_rows(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Rows that stand in both copies with all their values, as often as in both."""
    return local.intersectAll(remote.select(*local.columns))


def changed_rows(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Local rows that the remote does not have with the same values."""
    return local.exceptAll(remote.select(*local.columns))


def dedupe_items(items: DataFrame, by: str = "text", key: str = "item_id") -> DataFrame:
    """One row per content, the lowest key, with the number of copies.

    Copies collapse to (digest, lowest key, count) before the shuffle, however
    many there are of one article. Most items are alone, so only the few copies and
    the few counts meet the rows again. Keys are unique.
    """
    digest = F.md5(F.lower(F.col(by)))
    # An item without content is no copy of another one.
    content = F.coalesce(digest, F.concat(F.lit("#"), F.col(key).cast("string")))
    # Stored, so that texts are digested once and the planner knows how few copies there are:
    # it then sends these to the items and not the texts to them.
    keyed = stored(items.select(key, content.alias("_content")), "digests")
    groups = stored(copy_groups(keyed, key), "copies")
    losers = keyed.join(groups, "_content").where(F.col(key) != F.col("_first")).select(key)
    losers = stored(losers, "losers")
    counted = groups.select(F.col("_first").alias(key), "copies")
    return (
        items.join(losers, key, "left_anti")
        .join(counted, key, "left")
        .withColumn("copies", F.coalesce("copies", F.lit(1)).cast("bigint"))
    )


def copy_groups(keyed: DataFrame, key: str) -> DataFrame:
    """Contents (`_content`) of more than one row, with the lowest key and the number of rows."""
    return (
        keyed.groupBy("_content")
        .agg(F.min(key).alias("_first"), F.count(F.lit(1)).alias("copies"))
        .where("copies > 1")
    )


def union_accounts(copies: Sequence[DataFrame], key: Sequence[str]) -> DataFrame:
    """All rows of several copies, one per key: the copy listed first wins.

    Columns a copy lacks are null. The rows keep their `account_id`.
    """
    marked = [df.withColumn("_copy", F.lit(n)) for n, df in enumerate(copies)]
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), marked)
    return first_n_per_key(every, key, [F.col("_copy")], 1, "_n").drop("_copy", "_n")
