"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a skewed join partition even where an aggregation on the same key follows.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Sessions of a stream are merged before the shuffle, so that a busy key arrives as few rows.
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
    # Executor loss must not lose shuffle output when decommissioning is in use.
    "spark.storage.decommission.shuffleBlocks.enabled": "true",
}


def build_session(app: str = "stockloom", master: str | None = None, **overrides: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**_DEFAULTS, **overrides}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the folder all executors share.

    The folder is the one the cluster names in ``spark.checkpoint.dir``. Only a local master, where driver and
    executors are one machine, may go without it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        root = tempfile.mkdtemp(prefix="stockloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def held(df: DataFrame, label: str) -> DataFrame:
    """The frame written to the shared scratch folder and read again.

    Used where a frame feeds several jobs, or where ids given to rows must not change when a lost task runs again.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
