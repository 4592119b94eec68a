"""Tables kept in step by writing changes only.

Rows lie in directories by run and by hash bucket. A run holds the rows that came new or changed with it,
and the keys whose rows of earlier runs are void, because they changed or went. A reader takes the
listed buckets of all runs and leaves out void rows, so a change rewrites nothing. `compact`
rewrites buckets as one run. What is readable is listed last, in one small file per run: a run
that dies midway isn't seen, and the next one takes its number and overwrites what it left.
There is one writer at a time.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

PARTS = StructType([StructField("run", LongType()), StructField("bucket", IntegerType())])
LISTED = StructType(
    [StructField("listing", LongType()), StructField("data_run", LongType()), StructField("data_bucket", IntegerType())]
)


def hash_bucket(columns: Sequence[str | Column], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(buckets)).cast("int")


@dataclass(frozen=True)
class ChangeTable:
    """`key` says which rows a change makes void, `bucket_by` where rows lie; a null key is a key."""

    spark: SparkSession
    path: str
    schema: StructType
    key: tuple[str, ...]
    bucket_by: tuple[str, ...]
    buckets: int

    def listing(self) -> tuple[int, list[tuple[int, int]]]:
        """The number of the last complete run, 0 before the first, and the (run, bucket) that are in use."""
        try:
            log = self.spark.read.schema(LISTED).parquet(f"{self.path}/log")
        except AnalysisException as error:
            if error.getCondition() == "PATH_NOT_FOUND":
                return 0, []
            raise
        last = log.agg(F.max("listing")).first()[0] or 0
        rows = log.where(F.col("listing") == last).where(F.col("data_run").isNotNull()).collect()
        return last, sorted((r["data_run"], r["data_bucket"]) for r in rows)

    def bucket_of(self, *values) -> int:
        """The bucket of literal values of `bucket_by`."""
        one = self.spark.range(1).select(
            hash_bucket(
                [F.lit(v).cast(self.schema[c].dataType) for c, v in zip(self.bucket_by, values, strict=True)],
                self.buckets,
            )
        )
        return one.first()[0]

    def read(self, buckets: Iterable[int] | None = None, columns: Sequence[str] | None = None) -> DataFrame:
        """The rows now in force, of all buckets or of some; other directories aren't opened."""
        wanted = None if buckets is None else set(buckets)
        _, parts = self.listing()
        parts = [p for p in parts if wanted is None or p[1] in wanted]
        columns = list(columns or self.schema.fieldNames())
        if not parts:
            return self.spark.createDataFrame([], self.schema).select(*columns)
        rows = (
            self.spark.read.schema(StructType([*self.schema.fields, *PARTS.fields]))
            .option("basePath", f"{self.path}/rows")
            .parquet(*[f"{self.path}/rows/run={run}/bucket={bucket}" for run, bucket in parts])
        )
        oldest = parts[0][0]
        # Voids of what has been compacted since don't matter any more.
        void = (
            self.spark.read.schema(StructType([*[self.schema[k] for k in self.key], PARTS["run"]]))
            .parquet(f"{self.path}/void")
            .where(F.col("run") > oldest)
            .groupBy(*self.key)
            .agg(F.max("run").alias("_void"))
            .select(*[F.col(k).alias(f"_{k}") for k in self.key], "_void")
        )
        same = F.col("run") < F.col("_void")
        for k in self.key:
            same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
        return rows.join(void, same, "left_anti").select(*columns)

    def write(self, rows: DataFrame, void: DataFrame | None = None) -> int:
        """Add a run of rows; rows of earlier runs whose key is in `void` are no longer in force."""
        run = self.next_run()
        self._lay(rows, run, gathered=True)
        return self.publish(run, void)

    def next_run(self) -> int:
        return self.listing()[0] + 1

    def lay(self, rows: DataFrame, run: int) -> DataFrame:
        """Write rows of a run that `publish` lists later, and give them back as written.

        Each task writes the buckets of its own rows, so nothing is shuffled; a bucket has a file per task
        until it is compacted. Rows should come in tasks small enough to be sorted in memory.
        """
        return self._lay(rows, run, gathered=False)

    def publish(self, run: int, void: DataFrame | None = None) -> int:
        """List a run whose rows are written; rows of earlier runs whose key is in `void` are no longer in force."""
        return self._list(run, void, self.listing()[1])

    def compact(self, buckets: Iterable[int] | None = None) -> int:
        """Rewrite what is in force of some buckets, or of all, as one run."""
        last, parts = self.listing()
        chosen = {b for _, b in parts} if buckets is None else set(buckets)
        rest = [p for p in parts if p[1] not in chosen]
        self._lay(self.read(chosen), last + 1, gathered=True)
        return self._list(last + 1, None, rest)

    def _lay(self, rows: DataFrame, run: int, gathered: bool) -> DataFrame:
        place = f"{self.path}/rows/run={run}"
        dealt = rows.select(*self.schema.fieldNames()).withColumn("bucket", hash_bucket(self.bucket_by, self.buckets))
        if gathered:
            # Sizes the files: a hot bucket is split over tasks.
            dealt = dealt.hint("rebalance", "bucket")
        (
            dealt.sortWithinPartitions("bucket", *self.bucket_by)
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "static")
            .partitionBy("bucket")
            .parquet(place)
        )
        return self.spark.read.schema(StructType([*self.schema.fields, PARTS["bucket"]])).parquet(place)

    def _list(self, run: int, void: DataFrame | None, parts: list[tuple[int, int]]) -> int:
        place = f"{self.path}/rows/run={run}"
        if void is None:
            void = self.spark.createDataFrame([], StructType([self.schema[k] for k in self.key]))
        # An empty table too, so that there is always something to read.
        void.select(*self.key).write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(
            f"{self.path}/void/run={run}"
        )
        filled = (
            self.spark.read.schema(StructType([*self.schema.fields, PARTS["bucket"]])).parquet(place)
            .select("bucket").distinct().collect()
        )
        parts = sorted([*parts, *((run, r["bucket"]) for r in filled)]) or [(None, None)]
        self.spark.createDataFrame([(run, *p) for p in parts], LISTED).select("data_run", "data_bucket").coalesce(
            1
        ).write.mode("overwrite").parquet(f"{self.path}/log/listing={run}")
        return run
