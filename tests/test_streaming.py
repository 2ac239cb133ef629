"""Incremental shard processing (K1): every shard exactly once across
restarts, also late shards; progress table (K2): newest row of each run across
restarts, repeated batches and compaction."""

from __future__ import annotations

import tempfile

from pyspark.sql import functions as F

from polytext.operators import qc
from polytext.streaming.jobs import incremental_process, progress_stream, read_latest, start_incremental, upsert_batch

SCHEMA = "hyp_index bigint, src_segm string, hyp_output string, tgt_lang string, hyp_lang string"


def _shard(spark, path, lo, hi):
    rows = [(i, f"source text {i}", f"target text {i}", "English", "en") for i in range(lo, hi)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def test_exactly_once_across_restarts(spark):
    base = tempfile.mkdtemp(prefix="polytext-stream-test-")
    src, out, ck = f"{base}/in", f"{base}/out", f"{base}/ckpt"

    def transform(df):
        return qc.pair_qc(df).select("hyp_index", "flt")

    _shard(spark, src, 0, 10)
    incremental_process(spark, src, SCHEMA, transform, out, ck, max_bytes_per_trigger=1)
    assert spark.read.parquet(out).count() == 10
    # restart with nothing new: no duplicates
    incremental_process(spark, src, SCHEMA, transform, out, ck, max_bytes_per_trigger=1)
    assert spark.read.parquet(out).count() == 10
    # a new shard arrives: only it is processed
    _shard(spark, src, 10, 15)
    incremental_process(spark, src, SCHEMA, transform, out, ck, max_bytes_per_trigger=1)
    got = spark.read.parquet(out)
    assert got.count() == 15
    assert got.select("hyp_index").distinct().count() == 15
    assert got.where(F.col("flt") != "ok").count() == 0


def test_late_shards_while_running(spark):
    base = tempfile.mkdtemp(prefix="polytext-stream-test-")
    args = (spark, f"{base}/in", SCHEMA, lambda df: qc.pair_qc(df).select("hyp_index", "flt"), f"{base}/out", f"{base}/ckpt")
    _shard(spark, f"{base}/in", 0, 10)
    q = start_incremental(*args, max_bytes_per_trigger=1)
    for lo in range(10, 50, 10):
        _shard(spark, f"{base}/in", lo, lo + 10)
    q.processAllAvailable()
    q.stop()
    assert spark.read.parquet(f"{base}/out").count() == 50
    # stopped at any moment, then drained: nothing twice, nothing lost
    q = start_incremental(*args, max_bytes_per_trigger=1)
    _shard(spark, f"{base}/in", 50, 60)
    q.stop()
    incremental_process(*args)
    got = spark.read.parquet(f"{base}/out")
    assert (got.count(), got.select("hyp_index").distinct().count()) == (60, 60)


STEPS = "run string, ts timestamp, event_id bigint, loss double"


def _steps(spark, path, rows):
    spark.createDataFrame([(r, None, i, x) for i, (r, x) in enumerate(rows)], STEPS).coalesce(1).write.mode("append").parquet(path)


def test_progress_over_restarts(spark):
    base = tempfile.mkdtemp(prefix="polytext-stream-test-")
    args = (spark, f"{base}/in", STEPS, f"{base}/table", f"{base}/ckpt")
    _steps(spark, f"{base}/in", [("a", 1.0), ("a", 3.0), ("b", 5.0), (None, 7.0)])

    def rows(df):
        return {r["run"]: (r["steps"], r["mean_loss"]) for r in df.collect()}

    assert rows(progress_stream(*args)) == {"a": (2, 2.0), "b": (1, 5.0), None: (1, 7.0)}
    _steps(spark, f"{base}/in", [("a", 5.0), ("c", None)])
    want = {"a": (3, 3.0), "b": (1, 5.0), None: (1, 7.0), "c": (1, None)}
    assert rows(progress_stream(*args)) == want
    assert rows(progress_stream(*args)) == want  # nothing new
    assert not [t for t in spark.catalog.listTables() if t.isTemporary and t.name.startswith("progress")]


def test_upsert_repeats_and_compaction(spark):
    table = tempfile.mkdtemp(prefix="polytext-stream-test-") + "/table"
    schema = "run string, steps bigint"
    assert read_latest(spark, table, "run", schema).count() == 0
    for batch in range(8):
        changed = spark.createDataFrame([("all", batch), (f"r{batch}", batch), *([(None, batch)] if batch < 2 else [])], schema)
        for _ in range(2):  # repeated after a failure
            upsert_batch(changed, batch, table, "run", schema, compact_every=3)
        got = {r["run"]: r["steps"] for r in read_latest(spark, table, "run", schema).collect()}
        assert got == {"all": batch, None: min(batch, 1), **{f"r{b}": b for b in range(batch + 1)}}
    import os
    assert sorted(n for n in os.listdir(table) if n.startswith("batch=")) == ["batch=6", "batch=7"]
