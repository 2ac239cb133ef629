"""Row and line numbers in input order without a sort."""

from __future__ import annotations

import pytest

from polytext.sources import files as FS


@pytest.mark.parametrize("split", [64, 1 << 20])
def test_lines_keep_the_order_of_their_files(spark, tmp_path, split):
    lines = []
    for name, n in (("part-2", 300), ("part-0", 41), ("part-1", 0), ("part-10", 1)):
        own = [f"{name} line {i} " + "x" * (i % 17) for i in range(n)]
        (tmp_path / name).write_text("".join(x + "\n" for x in own))
        lines.append((name, own))
    want = [x for _, own in sorted(lines) for x in own]
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        df = FS.with_line_numbers(FS.read_lines(spark, f"{tmp_path}"))
        got = {r["line_no"]: r["value"] for r in df.collect()}
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert [got[i] for i in range(len(want))] == want and len(got) == len(want)
    assert "rangepartitioning" not in plan and "Sort " not in plan


def test_rows_of_a_table(spark, tmp_path):
    df = spark.range(0, 5000, numPartitions=7).selectExpr("id", "id % 3 as k")
    df.write.parquet(f"{tmp_path}/t")
    got = FS.input_index(spark.read.parquet(f"{tmp_path}/t")).collect()
    assert sorted((r["row_idx"], r["id"]) for r in got) == [(i, i) for i in range(5000)]


def test_no_rows(spark, tmp_path):
    spark.range(0).write.parquet(f"{tmp_path}/t")
    assert FS.input_index(spark.read.parquet(f"{tmp_path}/t")).collect() == []
