"""Steps of a job written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame

from lectern.session import new_folder


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """`df` written and read back: computed once, of a size that the planner knows, and kept if an executor is lost."""
    spark = df.sparkSession
    folder = new_folder(spark, purpose)
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)
