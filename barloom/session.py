"""Session defaults and the shared working folder."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(master: str = "local[*]", app: str = "barloom", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and local runs. On a cluster, bring your own session; no operator needs these settings."""
    spark = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("BARLOOM_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: the cluster's ``spark.checkpoint.dir``.

    Where the setting is absent, a session with a ``local`` master gets a temporary folder; any other session is refused, because
    its executors don't see the driver's disk.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(base)
    return base


def workspace(spark: SparkSession, tag: str) -> str:
    """A fresh sub-folder of :func:`shared_dir` for one job's written tables."""
    return f"{shared_dir(spark).rstrip('/')}/barloom-{tag}-{uuid.uuid4().hex[:12]}"


def store(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """Write a derived table to the shared folder; the table read back, and its path for :func:`discard`."""
    path = workspace(df.sparkSession, tag)
    df.write.mode("errorifexists").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write a derived table to the shared folder and read it back: later uses scan it instead of recomputing it."""
    return store(df, tag)[0]


def discard(spark: SparkSession, path: str) -> None:
    """Remove a stored table that no later plan reads."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
