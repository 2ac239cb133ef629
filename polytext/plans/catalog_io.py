"""Registered queries: sources and sinks (A1-A4, A6-A8, A10-A15).  Each query
writes data derived from the driver tables to a fresh folder under the shared
checkpoint folder and reads it back with the reader under test."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from polytext.operators import batching as BA
from polytext.operators import tokens as TK
from polytext.plans import views as V
from polytext.plans.catalog_batching import _PAD_SQL, _lsb, SHARD, B
from polytext.plans.catalog_metrics import MACRO_SQL, macro_average
from polytext.plans.registry import register
from polytext.session import scratch_path
from polytext.sources import files as FS


def _tmp(spark, name):
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex}")


# A3 + A11 (JSON sink) round trip of the translation entries
def _json_entries(spark, sf):
    path = _tmp(spark, "entries")
    e = V.entries(spark, sf).select("doc_id", "task", "src_segm", "tgt_segm", "src_lang", "tgt_lang")
    e.write.json(path)
    return FS.read_json_entries(spark, path, "doc_id bigint, " + FS.ENTRY_SCHEMA)


register("scan_json_entries", V.with_views(
    "SELECT doc_id, task, src_segm, tgt_segm, src_lang, tgt_lang FROM v_entries", "v_entries"))(_json_entries)


# A3, the array form: each task writes one JSON array, read back by splits
def _json_array(spark, sf):
    from polytext.sources.json_arrays import write_json_arrays
    path = _tmp(spark, "entry-arrays")
    write_json_arrays(V.entries(spark, sf).select("doc_id", "task", "src_segm", "tgt_segm", "src_lang", "tgt_lang"), path)
    return FS.read_json_entries(spark, path, "doc_id bigint, " + FS.ENTRY_SCHEMA, array=True)


register("scan_json_array", V.with_views(
    "SELECT doc_id, task, src_segm, tgt_segm, src_lang, tgt_lang FROM v_entries", "v_entries"))(_json_array)


# A2 + A11 (raw sink): one hypothesis per line, read back as lines
def _lines(spark, sf):
    path = _tmp(spark, "hyp-lines")
    FS.write_results(V.hyps(spark, sf).select("hyp_output"), path, raw=True)
    return FS.read_lines(spark, path)


register("scan_lines", V.with_views("SELECT unnest(string_split(hyp_output, chr(10))) AS value FROM v_hyps",
                                    "v_hyps"))(_lines)


# A1: whole files -- one file for each block of document ids in a language (so a
# value holds a bounded number of documents), in id order, one per line
RAW_BLOCK = 64


def _raw(spark, sf):
    path = _tmp(spark, "raw")
    d = V.table(spark, sf, "documents").select("lang", F.floor(F.col("doc_id") / RAW_BLOCK).alias("block"), "doc_id", "text")
    d.repartition("lang", "block").sortWithinPartitions("lang", "block", "doc_id").select("lang", "block", F.col("text").alias("value")) \
        .write.partitionBy("lang", "block").text(path)
    r = FS.read_raw(spark, path)
    return r.select(F.regexp_extract("file", "lang=([^/]+)", 1).alias("lang"),
                    F.regexp_extract("file", "block=([^/]+)", 1).cast("bigint").alias("block"), "value")


register("scan_raw", f"SELECT lang, doc_id // {RAW_BLOCK} AS block, string_agg(text, chr(10) ORDER BY doc_id) || chr(10) AS value "
                     "FROM documents GROUP BY ALL")(_raw)


# A12 + A4: per-process JSON outputs path.proc{i}, read back with the gap rule,
# the count check and the index order
P = 4


def _sharded(spark, sf):
    base = _tmp(spark, "outputs")
    whole = _tmp(spark, "hyps")
    V.hyps(spark, sf).select("hyp_index", "hyp_output").write.parquet(whole)  # evaluated once
    h = spark.read.parquet(whole)
    for i in range(P):
        FS.write_results(h.where(F.pmod("hyp_index", F.lit(P)) == i), f"{base}.proc{i}", raw=False)
    n = h.count()
    df = FS.read_sharded_outputs(spark, base, n, "`hyp-index` bigint, `hyp-output` string")
    return df.select(F.col("`hyp-index`").alias("hyp_index"), F.col("`hyp-output`").alias("hyp_output"))


register("scan_sharded_outputs", V.with_views("SELECT hyp_index, hyp_output FROM v_hyps", "v_hyps"))(_sharded)


# A6 + A7: sentences of even documents vs odd documents as two line files
def _line_files(spark, sf):
    s = V.train_sentences(spark, sf)
    p1, p2 = _tmp(spark, "corpus") + ".even", _tmp(spark, "corpus") + ".odd"
    for path, par in ((p1, 0), (p2, 1)):
        s.where(F.col("doc_id") % 2 == par).orderBy("doc_id", "pos").select(F.col("sentence").alias("value")) \
            .write.text(path)
    return p1, p2


def _parallel(spark, sf):
    t = FS.parallel_to_tuples(spark, [_line_files(spark, sf)])
    return t.select("pos", F.col("m")["even"].alias("even"), F.col("m")["odd"].alias("odd"))


register("scan_parallel_text", V.with_views("""
SELECT a.i AS pos, a.sentence AS even, coalesce(b.sentence, '') AS odd
FROM (SELECT sentence, row_number() OVER (ORDER BY doc_id, p) - 1 AS i FROM
       (SELECT doc_id, unnest(sents) AS sentence, generate_subscripts(sents, 1) AS p FROM v_doc_sents WHERE doc_id % 2 = 0)) a
LEFT JOIN (SELECT sentence, row_number() OVER (ORDER BY doc_id, p) - 1 AS i FROM
       (SELECT doc_id, unnest(sents) AS sentence, generate_subscripts(sents, 1) AS p FROM v_doc_sents WHERE doc_id % 2 = 1)) b
ON a.i = b.i""", "v_doc_sents"))(_parallel)


# A corpus of one file pair to which both directions are added, one of them
# again; it holds every source once
def _append(spark, sf):
    p1, p2 = _line_files(spark, sf)
    path = _tmp(spark, "parallel-corpus")
    FS.append_parallel_sources(spark, path, [(p1, p2)])
    FS.append_parallel_sources(spark, path, [(p2, p1), (p1, p2)])
    return FS.read_parallel_corpus(spark, path).select(
        F.regexp_extract("source", "([a-z]+)$", 1).alias("second"), "pos", F.col("m")["even"].alias("even"), F.col("m")["odd"].alias("odd"))


def _sql_zip(first, second):
    lines = ("(SELECT sentence, row_number() OVER (ORDER BY doc_id, p) - 1 AS i FROM (SELECT doc_id, unnest(sents) AS sentence, "
             "generate_subscripts(sents, 1) AS p FROM v_doc_sents WHERE doc_id % 2 = {}))")
    side = {"even": 0, "odd": 1}
    return (f"SELECT '{second}' AS second, a.i AS pos, a.sentence AS {first}, coalesce(b.sentence, '') AS {second} "
            f"FROM {lines.format(side[first])} a LEFT JOIN {lines.format(side[second])} b ON a.i = b.i")


register("append_parallel_sources", V.with_views(f"""
SELECT second, pos, even, odd FROM ({_sql_zip('even', 'odd')}) UNION ALL SELECT second, pos, even, odd FROM ({_sql_zip('odd', 'even')})""",
                                                 "v_doc_sents"))(_append)


# Token counts written as a TSV in (count desc, first occurrence) order,
# read back into a vocabulary with the reserved ids first
def _vocab_tsv(spark, sf):
    from polytext.plans.catalog_tokens import _freq
    path = _tmp(spark, "vocab.tsv")
    _freq(spark, sf).orderBy(F.col("count").desc(), F.col("first")).select(
        F.concat_ws("\t", "token", F.col("count").cast("string")).alias("value")).write.text(path)
    return TK.vocab_from_tsv(FS.read_vocab_tsv(spark, path))


register("scan_vocab_tsv", V.with_views("""
SELECT token, CAST(3 + row_number() OVER (ORDER BY count DESC, first) AS INTEGER) AS id FROM v_freq
WHERE token NOT IN ('<s>', '<pad>', '</s>', '<unk>')
UNION ALL SELECT * FROM (VALUES ('<s>', 0), ('<pad>', 1), ('</s>', 2), ('<unk>', 3)) t(token, id)""", "v_freq"))(
    _vocab_tsv)


# A13 + A10: shards of length-sorted batches with a manifest, read back and checked
def _shards(spark, sf):
    path = _tmp(spark, "shards")
    rows = _lsb(spark, sf).withColumn("shard_id", BA.shard_assign("batch_id", SHARD))
    FS.write_shards(rows, path)
    data, bad = FS.read_manifest_shards(spark, path)
    counts = data.groupBy("shard_id").agg(F.count(F.lit(1)).alias("shard_size"))
    return counts.join(bad.select("shard_id", F.lit(1).alias("_bad")), "shard_id", "left").select(
        "shard_id", "shard_size", F.col("_bad").isNull().alias("consistent"))


register("sink_shards_manifest", V.with_views(f"""
SELECT CAST(i // {B} // {SHARD} AS INTEGER) AS shard_id, count(*) AS shard_size, true AS consistent
FROM ordered GROUP BY 1""", "v_batches", ctes=_PAD_SQL))(_shards)


# TSV pairs of the tuples, read back as lines
def _tsv_pairs(spark, sf):
    from polytext.operators import tuples as TU
    path = _tmp(spark, "pairs.tsv")
    t = V.tuples(spark, sf).select("tuple_id", TU.clean_tuple(F.col("m")).alias("m"))
    FS.write_tsv_pairs(TU.explode_pairs(t, keep=["tuple_id"]), path)
    return FS.read_lines(spark, path)


register("sink_tsv_pairs", V.with_views("""
SELECT unnest(string_split(src_lang || chr(9) || input || chr(9) || tgt_lang || chr(9) || output, chr(10))) AS value
FROM pairs""", "v_tuple_items", ctes=__import__("polytext.plans.catalog_tuples", fromlist=["_PAIRS"])._PAIRS))(
    _tsv_pairs)


# The macro-averaged score table written as sorted JSON and read back
def _scores(spark, sf):
    path = _tmp(spark, "scores")
    FS.write_scores(macro_average(spark, sf), path)
    return spark.read.schema("key string, score double").json(path)


register("sink_scores", MACRO_SQL)(_scores)
