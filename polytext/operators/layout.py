"""Input layout helpers.

``spread`` repartitions rows only when their files make fewer splits than the
cluster's parallelism -- e.g. a text table stored as one parquet row group,
which a single task would otherwise read *and* explode.  What counts is bytes,
not files: a few large files that Spark cuts into many splits are left as they
are.  The check lists the plan's input files and looks up the lengths of fewer
than ``target`` of them; it runs no job.  A plan without files (rows held in
memory or behind a checkpoint) is repartitioned.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Compressed text cannot be cut: one split a file.
WHOLE_FILES = (".gz", ".zst", ".snappy", ".lz4", ".deflate")


def split_count(spark: SparkSession, files: list[str], enough: int) -> int:
    """Splits that Spark makes of these files, counted until there are ``enough``."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    size = jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    found = 0
    for i, name in enumerate(files):
        if found + len(files) - i >= enough:  # each file left has one at least
            return enough
        if name.endswith(WHOLE_FILES):
            found += 1
            continue
        path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(name))  # names are URIs
        found += max(1, -(-path.getFileSystem(conf).getFileStatus(path).getLen() // size))
    return found


def spread(df: DataFrame, *keys: str, factor: int = 2) -> DataFrame:
    spark = df.sparkSession
    target = spark.sparkContext.defaultParallelism * factor
    if split_count(spark, df.inputFiles(), target) >= target:
        return df
    return df.repartition(target, *keys) if keys else df.repartition(target)
