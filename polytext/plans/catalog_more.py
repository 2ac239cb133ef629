"""Registered queries: language-pair split and keyed-list merge (E15, E16),
corpus concatenation (G1), loss masks (I2, I3), vocabulary extension and the
unknown-token list (I7, E13), batch tokenisation (I9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from polytext.functions import prompts as P
from polytext.functions.rand import sql_uniform, uniform
from polytext.operators import batching as BA
from polytext.operators import synth
from polytext.operators import tokens as TK
from polytext.operators import tuples as TU
from polytext.plans import views as V
from polytext.plans.catalog_batching import _PAD_SQL, B, _lsb
from polytext.plans.catalog_synth import _SCORED_PIVOT_SQL, _scored_pivot
from polytext.plans.catalog_tokens import _freq, _vocab
from polytext.plans.catalog_tuples import _PAIRS, _clean_tuples
from polytext.plans.registry import register
from polytext.session import release, stored


# Pairs grouped by 'l1-l2' (long form; sizes per pair)
def _pairs(spark, sf):
    return TU.explode_pairs(_clean_tuples(spark, sf), keep=["tuple_id"]).withColumn(
        "lp", F.concat_ws("-", "src_lang", "tgt_lang"))


register("split_by_lp", V.with_views("SELECT src_lang || '-' || tgt_lang AS lp, count(*) AS n FROM pairs GROUP BY 1",
                                     "v_tuple_items", ctes=_PAIRS))(
    lambda spark, sf: _pairs(spark, sf).groupBy("lp").agg(F.count(F.lit(1)).alias("n")))


# Two keyed lists (pairs of even and of odd tuples) merged per key by
# concatenation in file order; position within the merged list
def _merged(spark, sf):
    p = _pairs(spark, sf)
    files = p.select("lp", F.pmod("tuple_id", F.lit(2)).alias("file_no"), F.col("tuple_id").alias("pos"))
    return BA.dense_index(files, ["file_no", "pos"], group_by=["lp"], out="merged_pos").select(
        "lp", "merged_pos", "file_no", "pos")


register("merge_keyed_lists", V.with_views("""
SELECT src_lang || '-' || tgt_lang AS lp, row_number() OVER (PARTITION BY src_lang || '-' || tgt_lang
  ORDER BY tuple_id % 2, tuple_id) - 1 AS merged_pos, tuple_id % 2 AS file_no, tuple_id AS pos FROM pairs""",
                                           "v_tuple_items", ctes=_PAIRS))(_merged)


# G1 + F13: original entries and accepted synthetic entries concatenated by
# name (missing columns NULL) and shuffled with a seeded hash order
def _concat_corpora(spark, sf):
    e = V.entries(spark, sf).select(F.concat(F.lit("e"), F.col("doc_id").cast("string")).alias("rid"),
                                    "task", "src_segm", "tgt_segm", "src_lang", "tgt_lang")
    scored = _scored_pivot(spark, sf).where(F.col("flt") == "ok")
    acc = synth.accepted_to_entries(scored, keep=[F.concat(F.lit("s"), F.col("doc_id").cast("string")).alias("rid")])
    allr = e.unionByName(acc, allowMissingColumns=True)
    allr = allr.select("rid", "task", "src_lang", "tgt_lang")  # no segment is sorted or stored
    return BA.dense_index(allr, [uniform(F.col("rid"), F.lit("shuffle")), F.col("rid")], out="shuffled_pos").select(
        "rid", "task", "src_lang", "tgt_lang", "shuffled_pos")


register("concat_corpora", V.with_views(f"""
SELECT rid, task, src_lang, tgt_lang, row_number() OVER (ORDER BY {sql_uniform('rid', "'shuffle'")}, rid) - 1
  AS shuffled_pos FROM (
  SELECT 'e' || CAST(doc_id AS VARCHAR) AS rid, task, src_lang, tgt_lang FROM v_entries
  UNION ALL
  SELECT 's' || CAST(doc_id AS VARCHAR), 'approx-translate', new_hi_res_lang || ', synth', lo_lang
  FROM scored WHERE flt = 'ok')""", "v_hyps", ctes=_SCORED_PIVOT_SQL))(_concat_corpora)


# I2 / I3 loss masks on the instruction entries, vocabulary of their prompts
DELIM_TOKEN = "response:"


def _alpaca_masks(spark, sf):
    a = V.alpaca(spark, sf).select(F.concat_ws(":", "conv_id", "turn").alias("rid"),
                                   P.prompt_alpaca(False).alias("prompt"),
                                   P.render(P.ALPACA_TRAIN, {"output": F.lit("")}).alias("blank"))
    vocab = TK.build_vocab(TK.token_frequency(TK.token_occurrences(a, "rid", "prompt")), min_count=2)
    delim = vocab.where(F.col("token") == DELIM_TOKEN).select("id").first()[0]  # one scalar
    full = TK.tokenise(a, "rid", "prompt", vocab)
    blank = TK.tokenise(a, "rid", "blank", vocab).select("rid", F.size("input_ids").alias("_n"))
    j = full.join(blank, "rid")
    m_delim = TK.loss_mask_delimiter("input_ids", delim)
    m_field = TK.loss_mask_prefix("input_ids", F.col("_n"))

    def n_true(m):
        return F.aggregate(m, F.lit(0), lambda acc, x: acc + F.when(x, 1).otherwise(0))

    return j.select("rid", F.size("input_ids").alias("n_ids"), n_true(m_delim).alias("n_masked_delim"),
                    n_true(m_field).alias("n_masked_field"))


_ALP = f"""al AS (SELECT concat_ws(':', conv_id, turn) AS rid,
  regexp_extract_all(lower({P.sql_render(P.ALPACA_TRAIN)}), '[^\\s]+') AS toks,
  regexp_extract_all(lower({P.sql_render(P.ALPACA_TRAIN, {'output': "''"})}), '[^\\s]+') AS btoks FROM v_alpaca)"""

register("loss_masks", V.with_views(f"""
SELECT rid, CAST(least(len(toks), 3000) + 1 AS INTEGER) AS n_ids,
  CAST(list_position(toks[1:3000], '{DELIM_TOKEN}') AS INTEGER) AS n_masked_delim,
  CAST(least(least(len(btoks), 3000) + 1, least(len(toks), 3000) + 1) AS INTEGER) AS n_masked_field
FROM al""", "v_alpaca", ctes=_ALP))(_alpaca_masks)


# I7 + E13 list: unknown tokens in first-seen order get ids after the vocabulary
register("extend_vocab", V.with_views("""
SELECT token, CAST((SELECT max(id) FROM v_vocab) + row_number() OVER (ORDER BY first) AS INTEGER) AS id
FROM v_freq WHERE token NOT IN (SELECT token FROM v_vocab)""", "v_vocab"))(
    lambda spark, sf: TK.extend_vocab(_vocab(spark, sf), _freq(spark, sf).select("token", "first")))


# Each length-sorted batch of documents tokenised (max 8000, no EOS) and
# padded to its longest row; batch position is 1-based
def _token_batches(spark, sf):
    t = TK.tokenise(V.table(spark, sf, "documents"), "doc_id", "text", _vocab(spark, sf), max_len=8000,
                    add_eos=False)
    # tokenised once and written; the ids are shuffled once, to the batches' rows, and not sorted
    t = stored(t.select("doc_id", "input_ids", F.size("input_ids").alias("n_ids")), "token-ids")
    release(spark)
    rows = _lsb(spark, sf).select("doc_id", "pad_copy", "batch_id").hint("shuffle_hash").join(t, "doc_id")
    padded = TK.pad_batch(rows, "batch_id", multiple=1, length="n_ids")
    return padded.groupBy((F.col("batch_id") + 1).alias("batch_pos")).agg(
        F.count(F.lit(1)).alias("rows"), F.max(F.size("input_ids")).alias("width"),
        F.sum(F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x)).alias("real_tokens"))


register("tokenise_batches", V.with_views(f"""
SELECT o.i // {B} + 1 AS batch_pos, count(*) AS rows, CAST(max(least(len(t.toks), 8000)) AS INTEGER) AS width,
  CAST(sum(least(len(t.toks), 8000)) AS BIGINT) AS real_tokens
FROM ordered o JOIN (SELECT doc_id, regexp_extract_all(lower(text), '[^\\s]+') AS toks FROM documents) t
  USING (doc_id) GROUP BY 1""", "v_batches", ctes=_PAD_SQL))(_token_batches)


# Byte-pair merges that fill the vocabulary of a model family, learned from
# the document corpus (iterative; no SQL oracle -- tested against a brute-force
# learner)
VOCABULARY = 2000


def _bpe(spark, sf):
    from polytext.operators.subword import learn_bpe, vocab_budget
    return learn_bpe(V.table(spark, sf, "documents"), "text", vocab_budget("nllb", VOCABULARY))


register("learn_subword_vocab")(_bpe)
