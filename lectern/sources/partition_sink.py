"""A table in directories by one column, of which a new run rewrites only those that changed."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import DecimalType, LongType, StringType, StructField, StructType

DIGESTS = StructType([
    StructField("part", StringType()), StructField("rows", LongType()),
    StructField("digest", DecimalType(38, 0)), StructField("run", LongType()),
])


def _digests(spark: SparkSession, path: str) -> tuple[int, DataFrame]:
    """The last complete run, 0 before the first, and the digests of its directories."""
    try:
        every = spark.read.schema(DIGESTS).parquet(f"{path}/digests")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return 0, spark.createDataFrame([], DIGESTS).drop("run")
    last = every.agg(F.max("run")).first()[0] or 0
    return last, every.where(F.col("run") == last).drop("run")


def write_changed(
    source: DataFrame,
    by: str,
    build: Callable[[DataFrame], DataFrame],
    path: str,
    of: Sequence[str] | None = None,
) -> DataFrame:
    """Write `build(source)` in directories by `by`; returns (`by`, status) of those that differ from the last run.

    A directory is compared by the number of its source rows and the sum of their hashes, over
    the columns `of` or all, so only rows of changed directories are built, shuffled and
    written. The digests are written last: a run that died midway is simply run again. `build`
    keeps the column `by`, which is text.
    """
    spark = source.sparkSession
    last, before = _digests(spark, path)
    values = [e for c in (of or source.columns) for e in (F.col(c).isNull(), F.col(c))]
    now = (
        source.select(F.col(by).alias("part"), F.xxhash64(*values).cast("decimal(20,0)").alias("h"))
        .groupBy("part")
        .agg(F.count(F.lit(1)).alias("rows"), F.sum("h").cast("decimal(38,0)").alias("digest"))
    )
    run = f"{path}/digests/run={last + 1}"
    pending = f"{path}/pending/run={last + 1}"
    now.write.mode("overwrite").parquet(pending)
    now = spark.read.schema(StructType(DIGESTS.fields[:3])).parquet(pending)
    old = before.select(F.col("part").alias("_part"), F.col("rows").alias("_rows"), F.col("digest").alias("_digest"))
    status = (
        F.when(F.col("_rows").isNull(), "new")
        .when(F.col("rows").isNull(), "removed")
        .when((F.col("rows") != F.col("_rows")) | (F.col("digest") != F.col("_digest")), "changed")
    )
    found = (
        now.join(old, F.col("part").eqNullSafe(F.col("_part")), "full")
        .select(F.coalesce("part", "_part").alias(by), status.alias("status"))
        .where("status is not null")
    )
    coming = found.where("status <> 'removed'").select(F.col(by).alias("_part"))
    rows = source.join(coming, F.col(by).eqNullSafe(F.col("_part")), "left_semi")
    (
        build(rows)
        .hint("rebalance", by)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(by)
        .parquet(f"{path}/rows")
    )
    # What changed is kept too, as `found` would be empty once the digests are written.
    found.coalesce(1).write.mode("overwrite").parquet(f"{path}/changes/run={last + 1}")
    now.coalesce(1).write.mode("overwrite").parquet(run)
    return spark.read.schema(found.schema).parquet(f"{path}/changes/run={last + 1}")


def read_parts(spark: SparkSession, path: str, schema: StructType, by: str) -> DataFrame:
    """The table as of the last complete run; directories that went since are left out."""
    _, parts = _digests(spark, path)
    rows = spark.read.schema(schema).parquet(f"{path}/rows")
    return rows.join(parts.select(F.col("part").alias("_part")), F.col(by).eqNullSafe(F.col("_part")), "left_semi")
