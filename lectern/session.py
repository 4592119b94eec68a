"""Session settings and the shared folder that jobs write intermediate tables to."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


# Settings that operators rely on and that can be set on a running session.
RUNTIME = {
    # Event times carry no zone; UTC makes every cast of them neutral.
    "spark.sql.session.timeZone": "UTC",
    # Whole pages of HTML pass to Python in these batches.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
}


def prepare(spark: SparkSession) -> SparkSession:
    """Give a session made elsewhere the settings that results and memory depend on."""
    for key, value in RUNTIME.items():
        spark.conf.set(key, value)
    return spark


def get_session(app_name: str = "lectern", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are tuned for; `conf` overrides any of them.

    Keyword names use underscores for dots: `spark_sql_shuffle_partitions="2000"`.
    """
    settings = {
        **RUNTIME,
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        # State of account x item pairs outgrows a heap-held map.
        "spark.sql.streaming.stateStore.providerClass":
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    }
    settings.update({key.replace("_", "."): value for key, value in conf.items()})
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def new_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder under the cluster's shared `spark.checkpoint.dir`.

    Only a local session, where every task shares the machine, may fall back
    to a temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="run-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
