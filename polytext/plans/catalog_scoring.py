"""Registered queries: batch scoring with the stub model (J1-J3, B20, C9, C8),
hypothesis cache (D9, A9, A16), memoised tuple translation (D8), sequence
log-probabilities (E19) and vector-table differences (D12)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from polytext.functions import prompts as P
from polytext.operators import batching as BA
from polytext.operators import scoring as SC
from polytext.operators import tokens as TK
from polytext.operators import tuples as TU
from polytext.plans import views as V
from polytext.plans.registry import register
from polytext.session import scratch_path


def _rev_sql(e: str) -> str:
    return f"array_to_string(list_reverse(string_split({e}, ' ')), ' ')"


_PROMPT_SQL = P.sql_render(P.MT_INFERENCE)


def _scored(spark, sf):
    e = V.entries(spark, sf).select("doc_id", "src_lang", "tgt_lang", P.prompt_mt_inference().alias("prompt"))
    index = BA.dense_index(e.select("doc_id"), ["doc_id"], out="hyp_index")  # ids only: no prompt is sorted or written
    return SC.score_batches(e.join(index, "doc_id"), "prompt")


register("score_batches", V.with_views(f"""
SELECT doc_id, hyp_index, {_rev_sql('prompt')} AS hyp_output FROM (
  SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS hyp_index, {_PROMPT_SQL} AS prompt FROM v_entries)""",
                                       "v_entries"))(
    lambda spark, sf: _scored(spark, sf).select("doc_id", "hyp_index", "hyp_output"))


def _gated(spark, sf):
    e = V.entries(spark, sf).select("doc_id", P.prompt_mt_inference().alias("prompt"))
    e = e.withColumn("n_tokens", F.size(TK.word_tokens("prompt")))
    return SC.score_batches(e, "prompt", n_tokens="n_tokens")


register("overlength_gate", V.with_views(f"""
SELECT doc_id, CASE WHEN n > 1800 THEN '' ELSE {_rev_sql('prompt')} END AS hyp_output,
  CASE WHEN n > 1800 THEN CAST(-100.0 AS DOUBLE) ELSE NULL END AS hyp_mean_logprob
FROM (SELECT doc_id, prompt, len(regexp_extract_all(lower(prompt), '[^\\s]+')) AS n
      FROM (SELECT doc_id, {_PROMPT_SQL} AS prompt FROM v_entries))""", "v_entries"))(
    lambda spark, sf: _gated(spark, sf).select("doc_id", "hyp_output", "hyp_mean_logprob"))

# The legacy generation prompt (B8) through the model in chunks of 32
register("chunked_translate", V.with_views(f"""
SELECT doc_id, {_rev_sql(P.sql_prompt_gen_text('src_lang', 'tgt_lang', 'src_segm'))} AS hyp_output FROM v_entries""",
                                           "v_entries"))(
    lambda spark, sf: SC.score_batches(
        V.entries(spark, sf).select("doc_id", P.prompt_gen_text().alias("prompt")), "prompt", batch_size=32)
    .select("doc_id", "hyp_output"))

# J2 + C8: only pairs of served languages, chunks of 8, up to 5 attempts
_SERVED = ["English", "Estonian", "Finnish", "Latvian", "Russian, bible", "Veps", "Võro", "Udmurt, Standard"]


register("batched_enrichment", V.with_views(f"""
SELECT doc_id, CASE WHEN src_lang IN {tuple(_SERVED)!r} AND tgt_lang IN {tuple(_SERVED)!r}
  THEN {_rev_sql('src_segm')} END AS hyp_output FROM v_entries""", "v_entries"))(
    lambda spark, sf: SC.batched_enrichment(V.entries(spark, sf).select("doc_id", "src_lang", "tgt_lang", "src_segm"),
                                            "src_segm", "src_lang", "tgt_lang", _SERVED, SC.ReverseWordsModel)
    .select("doc_id", "hyp_output"))


# D9 (+A16 sink, A9 scan): hypotheses cached by language pair and sentence; a
# first run stores the even documents' sentences, the second reuses them and
# adds the rest, and its repetition adds nothing
def _cached(spark, sf):
    path = scratch_path(spark, f"hyp-cache-{uuid.uuid4().hex}")
    req = V.hyps(spark, sf).select("doc_id", "src_lang", "tgt_lang", "src_segm")
    SC.translate_with_cache(req.where(F.col("doc_id") % 2 == 0), path, "fixture", "first")
    SC.translate_with_cache(req, path, "fixture", "second")
    return SC.translate_with_cache(req, path, "fixture", "second")


register("hyp_cache_reuse", V.with_views(f"""
SELECT doc_id, {_rev_sql('src_segm')} AS hyp_output FROM v_hyps""", "v_hyps"))(
    lambda spark, sf: _cached(spark, sf).select("doc_id", "hyp_output"))


# D8 on the tuples: fill every missing high language
def _memo(spark, sf):
    t = V.tuples(spark, sf)
    missing = TU.missing_high_langs(t, keep=["tuple_id"])
    rank = F.array_position(F.array(*[F.lit(k) for k in V.TUPLE_KEYS]), F.col("src"))
    return SC.memo_translate_fill(t, missing, rank)


register("memo_translate_fill", V.with_views(f"""
SELECT tuple_id, tgt AS key, {_rev_sql('arg_max(sentence, r)')} AS value FROM (
  SELECT p.tuple_id, p.key AS src, h.code AS tgt, p.value AS sentence,
    list_position(['est', 'liv', 'rus'], p.key) AS r
  FROM v_tuple_items p JOIN (SELECT unnest({list(TU.HIGH_SET)}) AS code) h ON true
  WHERE p.key IN {tuple(TU.HIGH_SET)!r} AND NOT contains(p.key, '-dia')
    AND NOT EXISTS (SELECT 1 FROM v_tuple_items q WHERE q.tuple_id = p.tuple_id AND q.key = h.code))
GROUP BY tuple_id, tgt""", "v_tuple_items"))(_memo)


# E19 on the logits view of the embeddings table (10 positions per sequence)
def _logits(spark, sf):
    e = V.table(spark, sf, "embeddings")
    return e.select(F.floor(F.col("vec_id") / 10).cast("bigint").alias("seq_id"),
                    (F.col("vec_id") % 10).cast("int").alias("pos"), F.col("embedding").alias("logits"),
                    F.col("label").alias("token"))


register("sequence_mean_logprob", """
WITH lg AS (SELECT vec_id // 10 AS seq_id, CAST(vec_id % 10 AS INTEGER) AS pos,
    list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS l, label AS token FROM embeddings),
st AS (SELECT a.seq_id, a.pos, a.l, b.token AS nxt, list_max(a.l) AS m FROM lg a JOIN lg b
  ON b.seq_id = a.seq_id AND b.pos = a.pos + 1 WHERE a.pos >= 2)
SELECT seq_id, round(avg(l[nxt + 1] - (m + ln(list_reduce(list_transform(l, lambda x: exp(x - m)),
  lambda acc, x: acc + x, 0.0)))), 6) AS mean_logprob FROM st GROUP BY seq_id""")(
    lambda spark, sf: SC.sequence_mean_logprob(_logits(spark, sf), start=3)
    .select("seq_id", F.round("mean_logprob", 6).alias("mean_logprob")))


# The embeddings table against a shifted snapshot, skipping 'shared' names
def _vectors(spark, sf):
    e = V.table(spark, sf, "embeddings")
    name = F.when(F.col("label") == 0, F.concat(F.lit("shared.w"), F.col("vec_id").cast("string"))) \
        .otherwise(F.concat(F.lit("layer"), F.col("label").cast("string"), F.lit(".w"), F.col("vec_id").cast("string")))
    a = e.select(name.alias("name"), F.transform("embedding", lambda x: x.cast("double")).alias("vec"), "vec_id")
    b = a.select("name", F.transform("vec", lambda x: x + (F.col("vec_id") % 3)).alias("vec"))
    return SC.vector_table_diff(a.drop("vec_id"), b, skip_pattern="shared")


register("vector_table_diff", """
WITH a AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
d AS (SELECT vec_id, list_transform(v, lambda x: x - (x + vec_id % 3)) AS dv FROM a WHERE label <> 0)
SELECT round(sum(list_reduce(dv, lambda acc, x: acc + x, 0.0)) / sum(len(dv)), 6) AS mean_diff,
  CAST(sum(len(dv)) AS BIGINT) AS n_elements, count(*) AS n_tensors FROM d""")(
    lambda spark, sf: _vectors(spark, sf).select(F.round("mean_diff", 6).alias("mean_diff"), "n_elements",
                                                 "n_tensors"))
