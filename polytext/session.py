"""Spark session helpers.

On a cluster the session is created by the platform; these helpers only fill in
settings that are unset (tests, bench) and never override cluster settings.
"""

from __future__ import annotations

import gc
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Defaults that matter for correctness (UTC) or for the local test harness.
_LOCAL_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: str | int = "*", shuffle_partitions: int = 8, app: str = "polytext") -> SparkSession:
    """A local session for tests and the bench (UI off, AQE on, UTC)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", os.environ.get("POLYTEXT_DRIVER_MEMORY", "12g"))
    )
    for k, v in _LOCAL_DEFAULTS.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder: that of ``spark.checkpoint.dir``, else the
    one the context was given.  Only a local session (tests, bench) that has
    neither gets a scratch folder; elsewhere that is an error, as executors
    could not read a folder of the driver's machine."""
    context = spark.sparkContext
    cur = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not cur:
        cur = scratch_root(context.master)
        spark.conf.set("spark.checkpoint.dir", cur)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(cur)
    return cur


def scratch_root(master: str) -> str:
    """A new folder for a local master; an error for any other."""
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="polytext-ckpt-")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path under the shared checkpoint folder for written intermediate tables."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}"


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner remove the shuffle files of finished steps.  It does
    so when the driver has collected the tables that used them, which on its
    own may take half an hour."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared checkpoint folder and read it
    back: this cuts the lineage and survives lost executors.  The folder is
    removed when the application ends."""
    spark = df.sparkSession
    release(spark)
    path = scratch_path(spark, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hpath)
    return spark.read.schema(df.schema).parquet(path)
