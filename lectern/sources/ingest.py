"""Landed API payloads to typed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType, StructField, StructType

REJECT = "_rejected"


def _parsed(landed: DataFrame, payload: str, schema: StructType) -> DataFrame:
    with_reject = StructType([*schema.fields, StructField(REJECT, StringType())])
    parsed = F.from_json(
        payload, with_reject, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": REJECT}
    )
    # Generated, since a projected column would be parsed again in each filter on it.
    return landed.select("*", F.inline(F.array(F.struct(parsed.alias("_parsed")))))


def _is_bad() -> Column:
    return F.col("_parsed").isNull() | F.col(f"_parsed.{REJECT}").isNotNull()


def ingest_snapshot(landed: DataFrame, payload: str, schema: StructType) -> DataFrame:
    """The columns of `landed` with the payload's fields in place of the payload; good rows only."""
    kept = [c for c in landed.columns if c != payload]
    return (
        _parsed(landed, payload, schema)
        .where(~_is_bad())
        .select(*kept, *[F.col(f"_parsed.{f}").alias(f) for f in schema.fieldNames()])
    )


def ingest_rejected(landed: DataFrame, payload: str, schema: StructType) -> DataFrame:
    """The rows whose payload does not parse, kept whole for inspection."""
    return _parsed(landed, payload, schema).where(_is_bad()).drop("_parsed")


def flatten_items(payloads: DataFrame) -> DataFrame:
    """One row per item of nested payloads: `feed` struct and `items` array of structs.

    A payload without items gives no row.
    """
    return payloads.select("feed", F.explode("items").alias("item")).select(
        F.col("item.id").alias("item_id"),
        F.col("feed.id").alias("feed_id"),
        F.col("feed.lang").alias("lang"),
        F.col("item.title").alias("title"),
        F.array_join("item.tags", ",").alias("tags"),
    )
