"""Registered queries: streaming (K1, K2) and step progress (F1)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from polytext.operators import batching as BA
from polytext.operators import qc
from polytext.plans import views as V
from polytext.plans.registry import register
from polytext.session import scratch_path
from polytext.streaming import jobs as J

ADMITTED = 64 << 30  # bytes of shards in a trigger

def _tmp(spark, name):
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex}")


# K1: hypotheses arrive as shards, part of them while the query runs; after a
# restart the rest is drained.  Each shard is QC-labelled exactly once
def _incremental(spark, sf):
    src, out, ck = _tmp(spark, "shards-in"), _tmp(spark, "qc-out"), _tmp(spark, "qc-ckpt")
    h = V.hyps(spark, sf).select("hyp_index", "src_segm", "hyp_output", "tgt_lang", "hyp_lang")
    early = F.coalesce(F.col("tgt_lang") < "Latvian", F.lit(False))
    args = (spark, src, "hyp_index bigint, src_segm string, hyp_output string, tgt_lang string, hyp_lang string",
            lambda df: qc.pair_qc(df).select("hyp_index", "flt"), out, ck)
    h.where(early).write.parquet(src)
    running = J.start_incremental(*args, max_bytes_per_trigger=ADMITTED)
    try:
        h.where(~early).write.mode("append").parquet(src)
    finally:
        running.stop()
    J.incremental_process(*args, max_bytes_per_trigger=ADMITTED)
    return spark.read.parquet(out).select("hyp_index", "flt")


register("incremental_score_shards", V.with_views(
    f"SELECT hyp_index, {qc.sql_pair_qc_label('src_segm', 'hyp_output', 'tgt_lang', 'hyp_lang')} AS flt FROM v_hyps",
    "v_hyps"))(_incremental)


# K2: live progress over the step log of the events table
def _steps(spark, sf):
    e = V.table(spark, sf, "events")
    return e.select(F.col("event_type").alias("run"), "ts", "event_id", F.col("value").alias("loss"))


def _progress(spark, sf):
    src, table, ck = _tmp(spark, "steps-in"), _tmp(spark, "progress"), _tmp(spark, "progress-ckpt")
    _steps(spark, sf).write.parquet(src)
    res = J.progress_stream(spark, src, "run string, ts timestamp, event_id bigint, loss double", table, ck,
                            max_bytes_per_trigger=ADMITTED)
    return res.select("run", "steps", F.round("mean_loss", 6).alias("mean_loss"))


register("progress_stream", "SELECT event_type AS run, count(*) AS steps, round(avg(value), 6) AS mean_loss "
                            "FROM events GROUP BY event_type")(_progress)


# elapsed time per step, running mean and ETA per run
register("progress_eta", """
WITH s AS (SELECT event_type AS run, ts, event_id, value AS loss,
    row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS step_idx,
    count(*) OVER (PARTITION BY event_type) AS n,
    min(ts) OVER (PARTITION BY event_type) AS t0,
    lag(ts) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS prev FROM events)
SELECT run, event_id, step_idx, epoch_us(ts) - epoch_us(prev) AS elapsed_us,
  CASE WHEN step_idx > 0 THEN (epoch_us(ts) - epoch_us(t0)) / step_idx END AS mean_us,
  CASE WHEN step_idx > 0 THEN (epoch_us(ts) - epoch_us(t0)) / step_idx END * (n - 1 - step_idx) AS eta_us
FROM s""")(
    lambda spark, sf: BA.progress_eta(_steps(spark, sf), "run", "ts", ["ts", "event_id"])
    .select("run", "event_id", "step_idx", "elapsed_us", "mean_us", "eta_us"))
