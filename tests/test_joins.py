"""Salted joins give the plain join's result on a heavily skewed key."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from polytext.operators.joins import salted_join, sparse_join


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_equals_plain_join(spark, how):
    # one key holds a third of all rows
    big = spark.range(0, 3000).select(F.col("id").alias("row"),
                                      F.when(F.col("id") % 3 == 0, F.lit("hot"))
                                      .otherwise(F.concat(F.lit("k"), (F.col("id") % 97).cast("string"))).alias("k"))
    small = spark.createDataFrame([("hot", 1), ("k1", 2), ("k5", 3), ("zz", 4)], "k string, v int")
    plain = sorted(tuple(r) for r in big.join(small, ["k"], how).collect())
    salted = sorted(tuple(r) for r in salted_join(big, small, ["k"], how, salt_by=F.col("row"), salts=5).collect())
    assert plain == salted


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_a_replicated_side_is_never_broadcast(spark, tmp_path, how):
    # its files are small, and Spark does not count the copies
    spark.range(0, 20_000).select(F.col("id").alias("k"), F.lit("v").alias("v")).write.parquet(f"{tmp_path}/small")
    big = spark.range(0, 100_000).select(F.col("id").alias("row"), (F.col("id") % 30_000).alias("k"))
    joined = salted_join(big, spark.read.parquet(f"{tmp_path}/small"), ["k"], how, salt_by=F.col("row"), salts=4)
    rows = joined.count()
    assert rows == {"inner": 70_000, "left": 100_000, "left_semi": 70_000, "left_anti": 30_000}[how]
    assert "Broadcast" not in joined._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("limit", [0, 10_000])
def test_lookup_join_both_paths(spark, limit):
    from polytext.operators.joins import lookup_join
    big = spark.range(0, 500).select(F.col("id").alias("row"), (F.col("id") % 4).cast("string").alias("k"))
    small = spark.createDataFrame([("0", 1), ("2", 3)], "k string, v int")
    plain = sorted(tuple(r) for r in big.join(small, ["k"], "left").collect())
    got = sorted(tuple(r) for r in lookup_join(big, small, ["k"], "left", salt_by=F.col("row"),
                                               max_broadcast_bytes=limit).collect())
    assert plain == got


@pytest.mark.parametrize("how", ["inner", "left_semi", "left_anti"])
@pytest.mark.parametrize("most", [0, 1 << 20])
def test_sparse_join_gives_the_rows_of_a_plain_join(spark, how, most):
    big = spark.createDataFrame([(i % 40 if i % 7 else None, f"t{i}", i) for i in range(300)] + [(3, None, 300)], "k long, t string, i long")
    small = spark.createDataFrame([(k, f"t{i}", v) for k, i, v in ((3, 3, "a"), (3, 43, "b"), (3, 43, "c"), (5, 999, "d"))], "k long, t string, v string")
    for on in (["k"], ["k", "t"]):
        keys = small.select(*on, "v")
        got = sparse_join(big, keys, on, how, most)
        want = big.join(keys, on, how)
        assert got.columns == want.columns
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
