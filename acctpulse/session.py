"""Session defaults and the shared work folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # A session that runs many different queries keeps their compiled code.
    "spark.sql.codegen.cache.maxEntries": "5000",
    # Building a plan is several times faster without a call-site record per column expression.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def local_session(app: str = "acctpulse", cpus: str = "8", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks. On a cluster, pass the session of the cluster instead."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return (
        builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


@cache
def _temporary() -> str:
    path = tempfile.mkdtemp(prefix="acctpulse-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def work_dir(spark: SparkSession) -> str:
    """The shared folder named by the cluster. Only a local session may fall back to a temporary one: on a cluster
    every executor would write to its own disk."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _temporary()


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the work folder."""
    return f"{work_dir(spark).rstrip('/')}/acctpulse-{uuid.uuid4().hex}/{name}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate result that several branches use to the work folder and read it back.

    It is computed once, later branches prune and filter its files, and a lost executor never reaches further
    back than to the files.
    """
    spark = df.sparkSession
    path = work_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
