"""Reading source tables and keeping versioned local copies."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from lectern import schemas


def load_tables(spark: SparkSession, directory: str) -> dict[str, DataFrame]:
    """The source tables under `directory`, read with their declared schemas."""
    return {
        name: spark.read.schema(schema).parquet(f"{directory}/{name}.parquet")
        for name, schema in schemas.SOURCE_TABLES.items()
    }


def write_local_copy(df: DataFrame, path: str, version: int, by: str = "feed_id") -> None:
    """Write one version of the local copy, a directory per feed.

    `rebalance` sizes the output files: a feed holding most rows is split over
    many tasks, small feeds share one. The version is listed as readable only
    once its data is complete, so a sync that dies midway leaves the last one in
    place and can simply be run again.
    """
    spark = df.sparkSession
    (
        df.hint("rebalance", by)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "static")
        .partitionBy(by)
        .parquet(f"{path}/v={version}")
    )
    (
        spark.range(1)
        .select(F.lit(version).cast("bigint").alias("version"))
        .write.mode("append")
        .parquet(f"{path}/versions")
    )


def refresh_feeds(df: DataFrame, path: str, version: int, by: str = "feed_id") -> None:
    """Replace, within an existing version, only the feeds that `df` holds."""
    (
        df.hint("rebalance", by)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(by)
        .parquet(f"{path}/v={version}")
    )


def latest_version(spark: SparkSession, path: str) -> int | None:
    """The highest complete version, or None before the first sync."""
    try:
        versions = spark.read.schema(schemas.VERSIONS).parquet(f"{path}/versions")
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    return versions.agg(F.max("version")).first()[0]


def read_local_copy(
    spark: SparkSession, path: str, schema: StructType, version: int | None = None
) -> DataFrame:
    """A version of the local copy, by default the latest; filters on the feed prune directories."""
    if version is None:
        version = latest_version(spark, path)
    return spark.read.schema(schema).parquet(f"{path}/v={version}")
