"""Exact duplicates through counting quotient filters and byte verification.

Each partition builds a filter of its fingerprints: a fingerprint's high bits are its
quotient, which says where it is kept, the other bits are its remainder, kept sorted
with a count. As all partitions cut fingerprints alike, filters merge without loss by
merging sorted remainders and adding counts. Only fingerprints counted more than once
go on: their texts are grouped byte by byte, so no collision can make two texts one.

The texts of all other documents stay where they are: a bitmap of fixed size, made
from the repeated fingerprints, keeps them from being moved, and an exact join follows.

Defined results: a null text is an empty one; texts are equal when identical after every
run of white space became one blank; of equal texts the row with the least id stays (a
null id comes last; of rows of one id one stays); empty tables give no rows; columns
other than the id and the text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import SPACE_CLASS, stored
from lectern.llm.ngram_join import bitmap_of, in_bitmap

# Fingerprints are 64 bits: so many of them choose the slice of the filter, the rest remain.
QUOTIENT_BITS = 10


def normalised(text: str) -> Column:
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), SPACE_CLASS, " ")


def merged(remainders: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted remainders of several filters' slices with their counts added."""
    together, number = np.concatenate(remainders), np.concatenate(counts)
    order = np.argsort(together, kind="stable")
    together, number = together[order], number[order]
    first = np.flatnonzero(np.concatenate(([True], together[1:] != together[:-1])))[: len(together)]
    return together[first], np.add.reduceat(number, first) if len(first) else number


def build_filter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The partition's filter: one row per quotient with sorted remainders and counts."""
    values = [b.column(0).to_numpy().view(np.uint64) for b in batches]
    if not values:
        return
    prints, counts = np.unique(np.concatenate(values), return_counts=True)
    quotients = (prints >> np.uint64(64 - QUOTIENT_BITS)).astype(np.int64)
    cuts = np.flatnonzero(np.diff(quotients, prepend=-1))
    remainders = prints & np.uint64((1 << (64 - QUOTIENT_BITS)) - 1)
    ends = np.append(cuts[1:], len(prints))
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(quotients[cuts].astype(np.int32)),
            pa.array([remainders[a:b].tobytes() for a, b in zip(cuts, ends, strict=True)], pa.binary()),
            pa.array([counts[a:b].astype(np.int64).tobytes() for a, b in zip(cuts, ends, strict=True)], pa.binary()),
        ],
        names=["quotient", "remainders", "counts"],
    )


def repeated_prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge slices that come sorted by quotient; fingerprints counted more than once."""

    def out(quotient: int, remainders: list[np.ndarray], counts: list[np.ndarray]) -> pa.RecordBatch:
        rest, number = merged(remainders, counts)
        prints = (np.uint64(quotient) << np.uint64(64 - QUOTIENT_BITS)) | rest
        twice = number > 1
        return pa.RecordBatch.from_arrays(
            [pa.array(prints[twice].view(np.int64)), pa.array(number[twice])], names=["print", "count"]
        )

    now, remainders, counts, held = None, [], [], 0
    for batch in batches:
        for quotient, rest, number in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if quotient != now:
                if now is not None:
                    yield out(now, remainders, counts)
                now, remainders, counts, held = quotient, [], [], 0
            remainders.append(np.frombuffer(rest, dtype=np.uint64))
            counts.append(np.frombuffer(number, dtype=np.int64))
            held += len(remainders[-1])
            if held > 2 * len(remainders[0]) + 100_000:
                # Merged as they come: memory follows the distinct remainders of one slice.
                rest_, number_ = merged(remainders, counts)
                remainders, counts, held = [rest_], [number_], len(rest_)
    if now is not None:
        yield out(now, remainders, counts)


def only_marked(shared):
    """For `mapInArrow`: rows whose fingerprint the bitmap has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = batch.column("print").to_numpy().view(np.uint64)
            yield batch.filter(pa.array(in_bitmap(shared.value, prints)))

    return run


def exact_groups(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id, keep_id, group_size, kept and text_sha256."""
    spark = docs.sparkSession
    same = normalised(text)
    narrow = stored(
        docs.select(F.col(id_column).alias("id"), same.alias("same")).select(
            F.monotonically_increasing_id().alias("row"),
            "id",
            F.xxhash64("same").alias("print"),
            F.sha2(F.col("same").cast("binary"), 256).alias("text_sha256"),
        ),
        "dedup-prints",
    )
    filters = narrow.select("print").mapInArrow(
        build_filter, "quotient int, remainders binary, counts binary"
    )
    repeated = stored(
        filters.repartition("quotient")
        .sortWithinPartitions("quotient")
        .mapInArrow(repeated_prints, "print bigint, count bigint"),
        "dedup-repeated",
    )
    marked = spark.sparkContext.broadcast(bitmap_of(repeated, "print"))
    texts = docs.select(same.alias("same")).select(F.xxhash64("same").alias("print"), "same")
    # Grouping by the text itself compares bytes; copies in a partition combine before the shuffle.
    classes = (
        texts.mapInArrow(only_marked(marked), "print bigint, same string")
        .groupBy("print", "same")
        .agg(F.count(F.lit(1)).alias("group_size"))
        .join(repeated.select("print"), "print", "left_semi")
        .where("group_size > 1")
        .select("print", F.sha2(F.col("same").cast("binary"), 256).alias("text_sha256"), "group_size")
    )
    classes = stored(classes, "dedup-classes")
    key = ["print", "text_sha256"]
    # Copies combine before the shuffle. Stored, so that the join below deals both sides by
    # itself and can split a hot group.
    first = stored(
        narrow.groupBy(*key)
        .agg(
            F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("first"),
            F.count(F.lit(1)).alias("copies"),
        )
        .where("copies > 1")
        .join(classes, key)
        .select(*key, "first", "group_size"),
        "dedup-first",
    )
    return narrow.join(first, key, "left").select(
        F.col("id").alias(id_column),
        F.when(F.col("first").isNull(), F.col("id")).otherwise(F.col("first.id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("bigint").alias("group_size"),
        (F.col("first").isNull() | (F.col("first.row") == F.col("row"))).alias("kept"),
        "text_sha256",
    )
