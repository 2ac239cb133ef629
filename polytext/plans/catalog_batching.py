"""Registered queries: order, batching and sharding (F2, F4-F11, F13, C11,
D10, E10, E14, I3, I4, A13 manifest)."""

from __future__ import annotations

from pyspark.sql import functions as F

from polytext.functions.rand import sql_hash_u32, sql_uniform, uniform
from polytext.operators import batching as BA
from polytext.operators import tokens as TK
from polytext.plans import views as V
from polytext.plans.registry import register
from polytext.sources.files import input_index

B = 16          # batch size of the batching queries
SHARD = 4       # batches per shard
P = 8           # processes of the round-robin plan

register("row_index", V.with_views(
    "SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) - 1 AS idx FROM v_batches", "v_batches"))(
    lambda spark, sf: BA.dense_index(V.batch_rows(spark, sf), [F.col("n_chars").desc(), F.col("doc_id")])
    .select("doc_id", "idx"))

# F2 in input order (the driver's table is written in doc_id order)
register("input_row_index", "SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS idx FROM documents")(
    lambda spark, sf: input_index(V.table(spark, sf, "documents"), out="idx").select("doc_id", "idx"))


def _rr(spark, sf):
    idx = BA.dense_index(V.batch_rows(spark, sf), ["doc_id"])
    a, b = BA.reassemble_order("idx", P)
    return idx.select("doc_id", "idx", BA.round_robin("idx", P).alias("process"), a.alias("pos_in_shard"))


register("round_robin_assign", V.with_views(f"""
SELECT doc_id, idx, idx % {P} AS process, idx // {P} AS pos_in_shard
FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS idx FROM v_batches)""", "v_batches"))(_rr)

register("shuffle_rows", V.with_views(f"""
SELECT doc_id, row_number() OVER (ORDER BY {sql_uniform('doc_id', "'seed42'")}, doc_id) - 1 AS shuffled_pos
FROM v_batches""", "v_batches"))(
    lambda spark, sf: BA.dense_index(V.batch_rows(spark, sf), [uniform(F.col("doc_id"), F.lit("seed42")),
                                                               F.col("doc_id")], out="shuffled_pos")
    .select("doc_id", "shuffled_pos"))

# F6 length-sorted batches with padding by random duplicates
_PAD_SQL = f"""gi AS (SELECT *, row_number() OVER (ORDER BY {sql_uniform('doc_id', "'batches'")}, doc_id) AS _rk
  FROM v_batches),
need AS (SELECT count(*) AS cnt, (({B} - count(*) % {B}) % {B}) AS need FROM gi),
slots AS (SELECT cnt, unnest(range(1, need + 1)) AS pad_copy FROM need WHERE need > 0),
picks AS (SELECT pad_copy, (pad_copy - 1) % cnt + 1 AS _rk FROM slots),
padded AS (SELECT doc_id, lang, n_chars, src_bin, tgt_bin, 0 AS pad_copy FROM gi
  UNION ALL SELECT g.doc_id, g.lang, g.n_chars, g.src_bin, g.tgt_bin, p.pad_copy FROM picks p JOIN gi g USING (_rk)),
ordered AS (SELECT *, row_number() OVER (ORDER BY n_chars DESC, doc_id, pad_copy) - 1 AS i FROM padded)"""


def _lsb(spark, sf):
    return BA.length_sorted_batches(V.batch_rows(spark, sf), "doc_id", "n_chars", B, seed="batches").select(
        "doc_id", "pad_copy", "batch_id", "row_in_batch", "batch_order")


register("length_sorted_batches", V.with_views(f"""
SELECT doc_id, pad_copy, i // {B} AS batch_id, i % {B} AS row_in_batch,
  {sql_uniform(f'i // {B}', "'batches'")} AS batch_order FROM ordered""", "v_batches", ctes=_PAD_SQL))(_lsb)

# F8 + A13 manifest + F9 epoch positions
register("shard_manifest", V.with_views(f"""
SELECT shard_id, shard_size, CAST(coalesce(sum(shard_size) OVER (ORDER BY shard_id ROWS BETWEEN UNBOUNDED PRECEDING
  AND 1 PRECEDING), 0) AS BIGINT) AS shard_start
FROM (SELECT i // {B} // {SHARD} AS shard_id, count(*) AS shard_size FROM ordered GROUP BY 1)""", "v_batches",
                                        ctes=_PAD_SQL))(
    lambda spark, sf: BA.shard_manifest(_lsb(spark, sf).withColumn("shard_id", BA.shard_assign("batch_id", SHARD))))

# F7 bin batches (+ C11 train-bin filter): per (src_bin, tgt_bin)
_BIN_SQL = f"""gi AS (SELECT *, row_number() OVER (PARTITION BY src_bin, tgt_bin
  ORDER BY {sql_uniform('doc_id', "'bins'")}, doc_id) AS _rk FROM v_batches),
need AS (SELECT src_bin, tgt_bin, count(*) AS cnt, (({B} - count(*) % {B}) % {B}) AS need FROM gi GROUP BY ALL),
slots AS (SELECT src_bin, tgt_bin, cnt, unnest(range(1, need + 1)) AS pad_copy FROM need WHERE need > 0),
picks AS (SELECT src_bin, tgt_bin, pad_copy, (pad_copy - 1) % cnt + 1 AS _rk FROM slots),
padded AS (SELECT doc_id, lang, n_chars, src_bin, tgt_bin, 0 AS pad_copy FROM gi
  UNION ALL SELECT g.doc_id, g.lang, g.n_chars, g.src_bin, g.tgt_bin, p.pad_copy FROM picks p JOIN gi g
  USING (src_bin, tgt_bin, _rk)),
ordered AS (SELECT *, row_number() OVER (PARTITION BY src_bin, tgt_bin ORDER BY n_chars, doc_id, pad_copy) - 1 AS i
  FROM padded)"""


def _bins(spark, sf):
    return BA.bin_batches(V.batch_rows(spark, sf), "doc_id", "n_chars", ["src_bin", "tgt_bin"], B, seed="bins")


register("bin_batches", V.with_views(f"""
SELECT doc_id, src_bin, tgt_bin, pad_copy, i // {B} AS batch_in_bin, i % {B} AS row_in_batch,
  {sql_uniform('src_bin', 'tgt_bin', f'i // {B}', "'bins'")} AS batch_order
FROM ordered WHERE src_bin = 0 OR tgt_bin = 0""", "v_batches", ctes=_BIN_SQL))(
    lambda spark, sf: _bins(spark, sf).where((F.col("src_bin") == 0) | (F.col("tgt_bin") == 0)).select(
        "doc_id", "src_bin", "tgt_bin", "pad_copy", "batch_in_bin", "row_in_batch", "batch_order"))

# F10 pad last batch with rows of that batch
register("pad_last_batch", V.with_views(f"""
SELECT doc_id, i // {B} AS batch_id, 0 AS pad_copy FROM sh
UNION ALL
SELECT s.doc_id, p.batch_id, p.pad_copy FROM (
  SELECT (n - 1) // {B} AS batch_id, n - n % {B} AS start, n % {B} AS r, unnest(range(1, {B} - n % {B} + 1)) AS pad_copy
  FROM (SELECT count(*) AS n FROM sh) WHERE n % {B} > 0) p
JOIN sh s ON s.i = p.start + CAST(floor({sql_hash_u32('p.pad_copy', "'last'")} * p.r / 4294967296.0) AS BIGINT)""",
                                        "v_batches", ctes=f"""sh AS (SELECT doc_id, row_number() OVER (
  ORDER BY {sql_uniform('doc_id', "'last'")}, doc_id) - 1 AS i FROM v_batches)"""))(
    lambda spark, sf: BA.pad_last_batch(V.batch_rows(spark, sf), "doc_id", B, seed="last")
    .select("doc_id", "batch_id", "pad_copy"))

# F11 micro-batch plan over the length-sorted batches
register("microbatch_plan", V.with_views(f"""
SELECT doc_id, pad_copy, i // {B} AS batch_id, CAST(floor((i % {B}) / ({B} // 2)) AS INTEGER) AS process,
  CAST(floor(((i % {B}) % ({B} // 2)) / 4) AS INTEGER) AS sub_batch FROM ordered""", "v_batches", ctes=_PAD_SQL))(
    lambda spark, sf: _lsb(spark, sf).select("doc_id", "pad_copy", "batch_id",
                                             *BA.microbatch_columns("row_in_batch", B, 2, 4)))

# E14 language -> bins, D10 bin pair choice, E10 update statistics
_SPEC_SQL = """spec AS (SELECT DISTINCT lang, CAST(doc_id % 3 AS INTEGER) AS bin FROM documents),
l2b AS (SELECT lang, list_sort(list(DISTINCT bin)) AS bins, min(bin) AS bin FROM spec GROUP BY lang)"""


def _spec(spark, sf):
    d = V.table(spark, sf, "documents")
    return d.select("lang", (F.col("doc_id") % 3).cast("int").alias("bin")).distinct()


register("lang_to_bins", V.with_views("SELECT lang, array_to_string(bins, ',') AS bins, bin FROM l2b", "v_batches",
                                      ctes=_SPEC_SQL))(
    lambda spark, sf: BA.lang_to_bins(_spec(spark, sf)).select(
        "lang", F.array_join(F.col("bins").cast("array<string>"), ",").alias("bins"), "bin"))

_PAIRS_SQL = _SPEC_SQL + f""",
prs AS (SELECT e.doc_id, e.src_doc_lang AS src_lang, e.tgt_doc_lang AS tgt_lang FROM v_entries e),
combos AS (SELECT p.doc_id, list_filter(flatten(list_transform(s.bins, lambda a: list_transform(t.bins,
    lambda b: {{'s': a, 't': b}}))), lambda x: NOT (x.s = 1 AND x.t = 1)) AS c
  FROM prs p JOIN l2b s ON s.lang = p.src_lang JOIN l2b t ON t.lang = p.tgt_lang),
chosen AS (SELECT doc_id, c[CAST(floor({sql_hash_u32('doc_id', "'binpair'")} * len(c) / 4294967296.0) AS INTEGER) + 1]
  AS ch FROM combos WHERE len(c) > 0)"""


def _bin_pairs(spark, sf):
    pairs = V.entries(spark, sf).select("doc_id", F.col("src_doc_lang").alias("src_lang"),
                                        F.col("tgt_doc_lang").alias("tgt_lang"))
    return BA.bin_pair_choice(pairs, BA.lang_to_bins(_spec(spark, sf)), "doc_id")


register("bin_pair_choice", V.with_views("SELECT doc_id, ch.s AS src_bin, ch.t AS tgt_bin FROM chosen", "v_entries",
                                         ctes=_PAIRS_SQL))(
    lambda spark, sf: _bin_pairs(spark, sf).select("doc_id", "src_bin", "tgt_bin"))

register("bin_update_stats", V.with_views("""
SELECT CAST(sum(l) AS BIGINT) AS total, CAST(sum(CASE WHEN s = 0 OR t = 0 THEN l ELSE 0 END) AS BIGINT) AS total_x,
  50.0 * sum(l * (2 - s - t)) / sum(l) AS coupled_pct,
  100.0 * count(*) FILTER (WHERE s = 1 AND t = 1) / sum(l) AS dud_pct,
  100.0 * sum(CASE WHEN s = 1 AND t = 1 THEN l ELSE 0 END) / sum(l) AS dud_row_pct,
  CAST(sum(l * (1 - s)) AS BIGINT) AS enc_samples, CAST(sum(l * (1 - t)) AS BIGINT) AS dec_samples
FROM (SELECT ch.s AS s, ch.t AS t, count(*) AS l FROM chosen GROUP BY ALL)""", "v_entries", ctes=_PAIRS_SQL))(
    lambda spark, sf: BA.bin_update_stats(_bin_pairs(spark, sf)))


# I4 pad each length-sorted batch of token rows; I3 output-field loss mask on alpaca
def _padded(spark, sf):
    from polytext.plans.catalog_tokens import _tokenised
    t = _tokenised(spark, sf)
    batches = _lsb(spark, sf).select("doc_id", "pad_copy", "batch_id")
    return TK.pad_batch(batches.join(t, "doc_id"), "batch_id", multiple=8)


from polytext.plans.catalog_tokens import _FULL_SQL  # noqa: E402

register("pad_batch", V.with_views(f"""
SELECT o.doc_id, o.pad_copy, o.i // {B} AS batch_id,
  CAST(ceil(max(len(ids.input_ids)) OVER (PARTITION BY o.i // {B}) / 8) * 8 AS INTEGER) AS n,
  CAST(len(ids.input_ids) AS INTEGER) AS n_real
FROM ordered o JOIN ids USING (doc_id)""", "v_vocab", "v_batches", ctes=_FULL_SQL + ",\n" + _PAD_SQL))(
    lambda spark, sf: _padded(spark, sf).select("doc_id", "pad_copy", "batch_id", F.size("input_ids").alias("n"),
                                                F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x)
                                                .alias("n_real")))
