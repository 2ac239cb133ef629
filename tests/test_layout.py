"""Layout helpers: ``spread`` only redistributes under-partitioned inputs;
``prefix_sum`` equals the sequential running sum."""

from __future__ import annotations

from pyspark.sql import functions as F

from polytext.operators.batching import prefix_sum
from polytext.operators.layout import split_count, spread


def test_spread_is_a_no_op_on_inputs_of_many_files(spark, tmp_path):
    target = spark.sparkContext.defaultParallelism * 2
    spark.range(0, 1000, numPartitions=target + 3).write.parquet(str(tmp_path / "wide"))
    wide = spark.read.parquet(str(tmp_path / "wide"))
    assert spread(wide) is wide
    spark.range(0, 1000, numPartitions=1).write.parquet(str(tmp_path / "thin"))
    thin = spark.read.parquet(str(tmp_path / "thin"))
    assert spread(thin).rdd.getNumPartitions() == target
    assert sorted(r.id for r in spread(thin, "id").collect()) == list(range(1000))


def test_spread_counts_splits_not_files(spark, tmp_path):
    target = spark.sparkContext.defaultParallelism * 2
    path = str(tmp_path / "a few")  # the blank is escaped in the names of files
    spark.range(0, 200_000, numPartitions=2).write.parquet(path)
    few = spark.read.parquet(path)
    assert spread(few) is not few
    small = max(1, min(p.stat().st_size for p in (tmp_path / "a few").glob("*.parquet")) // target)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(small))
        assert spread(few) is few
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_split_count_of_whole_files(spark, tmp_path):
    spark.range(0, 5000, numPartitions=2).selectExpr("cast(id as string) id").write.text(str(tmp_path / "z"), compression="gzip")
    files = spark.read.text(str(tmp_path / "z")).inputFiles()
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "10")
        assert split_count(spark, files, 100) == 2
        assert split_count(spark, [], 100) == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_spread_runs_no_job(spark):
    left, right = spark.range(0, 1000), spark.range(0, 1000)
    spark.sparkContext.setJobGroup("spread", "spread")
    spread(left.hint("merge").join(right, "id"))
    assert list(spark.sparkContext.statusTracker().getJobIdsForGroup("spread")) == []
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_prefix_sum_matches_running_sum(spark):
    vals = [(i, (i * 7) % 11) for i in range(300)]
    df = spark.createDataFrame(vals, "k long, v long")
    got = {r.k: r.prefix for r in prefix_sum(df, "v", ["k"], partitions=9).collect()}
    run = 0
    for k, v in vals:
        assert got[k] == run
        run += v
