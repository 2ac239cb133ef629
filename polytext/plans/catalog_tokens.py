"""Registered queries: tokens.

Array-valued results are presented as space-joined text columns so that the
check compares plain values.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from polytext.operators import tokens as TK
from polytext.operators.batching import dense_index
from polytext.operators.joins import lookup_join
from polytext.plans import views as V
from polytext.plans.registry import register
from polytext.session import ensure_checkpoint_dir

TOP_K = 100


def _occ(spark, sf):
    return TK.token_occurrences(V.table(spark, sf, "documents"), "doc_id", "text")


def _freq(spark, sf):
    return TK.token_frequency(_occ(spark, sf))


def _vocab(spark, sf):
    return TK.build_vocab(_freq(spark, sf), min_count=2)


def _ids_text(c):
    return F.array_join(F.col(c).cast("array<string>"), " ")


register("token_frequency", V.with_views("SELECT token, count FROM v_freq", "v_freq"))(
    lambda spark, sf: _freq(spark, sf).select("token", "count"))

register("top_k_tokens", V.with_views(f"SELECT token, count FROM v_freq ORDER BY count DESC, first LIMIT {TOP_K}",
                                      "v_freq"))(
    lambda spark, sf: TK.top_k_tokens(_freq(spark, sf), TOP_K))

register("build_vocab", V.with_views("SELECT * FROM v_vocab", "v_vocab"))(_vocab)

_TOK_SQL = """tok AS (SELECT t.doc_id, t.pos, coalesce(v.id, 3) AS id FROM v_tokens t LEFT JOIN v_vocab v USING (token)
  WHERE t.pos < 3000),
ids AS (SELECT d.doc_id, list_append(coalesce((SELECT list(id ORDER BY pos) FROM tok WHERE tok.doc_id = d.doc_id),
  []::INTEGER[]), 2) AS input_ids FROM documents d)"""


# the same without truncation
_FULL_SQL = _TOK_SQL.replace("\n  WHERE t.pos < 3000", "")


def _tokenised(spark, sf, vocab=None, max_len=None):
    return TK.tokenise(V.table(spark, sf, "documents"), "doc_id", "text", vocab or _vocab(spark, sf), max_len=max_len)


register("tokenise_rows", V.with_views(
    "SELECT doc_id, array_to_string(input_ids, ' ') AS input_ids, CAST(len(input_ids) AS INTEGER) AS n_ids FROM ids",
    "v_vocab", ctes=_TOK_SQL))(
    lambda spark, sf: _tokenised(spark, sf, max_len=3000).select("doc_id", _ids_text("input_ids").alias("input_ids"),
                                                   F.size("attention_mask").alias("n_ids")))

register("unk_token_report", V.with_views("""
SELECT count(DISTINCT token) AS distinct_tokens, count(*) AS total_tokens,
  count(*) FILTER (WHERE v.id IS NULL) AS unk_tokens,
  100.0 * count(*) FILTER (WHERE v.id IS NULL) / count(*) AS unk_pct
FROM v_tokens t LEFT JOIN v_vocab v USING (token)""", "v_vocab"))(
    lambda spark, sf: TK.unk_report(_occ(spark, sf), _vocab(spark, sf)))

def _roundtrip(spark, sf):
    vocab = _vocab(spark, sf)
    detok = TK.detokenise(_tokenised(spark, sf, vocab), "doc_id", "input_ids", vocab)
    ref = V.table(spark, sf, "documents").select("doc_id", F.array_join(TK.word_tokens("text"), " ").alias("ref"))
    ok = detok.join(ref, "doc_id").select((F.col("text") == F.col("ref")).alias("ok"))
    return ok.agg(F.count_if("ok").alias("success"), F.count_if(~F.col("ok")).alias("failure"))


# E20 + I6: detokenise(tokenise(text)) equals the token text for rows without
# unknown tokens
register("token_roundtrip_report", V.with_views("""
SELECT count(*) FILTER (WHERE ok) AS success, count(*) FILTER (WHERE NOT ok) AS failure FROM (
  SELECT d.doc_id, coalesce(bool_and(v.id IS NOT NULL), true) AS ok
  FROM documents d LEFT JOIN v_tokens t USING (doc_id) LEFT JOIN v_vocab v USING (token) GROUP BY d.doc_id)""",
                                                "v_vocab"))(
    lambda spark, sf: _roundtrip(spark, sf))


register("detokenise_rows", V.with_views("""
SELECT d.doc_id, coalesce((SELECT string_agg(coalesce(v.token, ''), ' ' ORDER BY t.pos) FROM tok t
  LEFT JOIN v_vocab v ON v.id = t.id WHERE t.doc_id = d.doc_id AND t.id > 3), '') AS text FROM documents d""",
                                         "v_vocab", ctes=_FULL_SQL))(
    lambda spark, sf: (lambda v: TK.detokenise(_tokenised(spark, sf, v), "doc_id", "input_ids", v))(_vocab(spark, sf)))

# Everything from the first occurrence of the most frequent id on becomes that id
register("fill_after_eos", V.with_views("""
SELECT doc_id, array_to_string(CASE WHEN p = 0 THEN input_ids ELSE
  list_transform(input_ids, lambda x, i: CASE WHEN i >= p THEN 4 ELSE x END) END, ' ') AS output_ids
FROM (SELECT doc_id, input_ids, list_position(input_ids, 4) AS p FROM
  (SELECT doc_id, list_transform(input_ids, lambda x: x) AS input_ids FROM ids))""", "v_vocab", ctes=_FULL_SQL))(
    lambda spark, sf: _tokenised(spark, sf).select(
        "doc_id", F.array_join(TK.fill_after_eos("input_ids", 4).cast("array<string>"), " ").alias("output_ids")))

def _language_tokens(spark, sf):
    docs = V.table(spark, sf, "documents")
    # one id per language (a table of distinct languages), after the vocabulary;
    # a null language is one of them and has the last id
    vocab = _vocab(spark, sf)
    last = vocab.agg(F.max("id")).first()[0]
    lang_ids = dense_index(docs.select("lang").distinct(), [F.col("lang").asc_nulls_last()], out="_i").select(
        "lang", (F.col("_i") + last + 1).cast("int").alias("lang_id"))
    # a row's language is carried along with its id, so that no ids are shuffled
    own = docs.where("doc_id is not null").select(F.struct("doc_id", "lang").alias("_doc"), "text")
    t = TK.tokenise(own, "_doc", "text", vocab, max_len=None).select("_doc.doc_id", "_doc.lang", "input_ids")
    # documents that share an id have all their languages: few rows, joined by measured size
    ensure_checkpoint_dir(spark)
    several = docs.where("doc_id is not null").groupBy("doc_id").agg(F.collect_list(F.struct("lang")).alias("_langs"))
    several = several.where(F.size("_langs") > 1).checkpoint(eager=True)
    t = lookup_join(t, several, ["doc_id"], "left", salt_by=F.col("lang"))
    t = t.select("doc_id", "input_ids", F.explode(F.coalesce("_langs", F.array(F.struct("lang")))).alias("_l")).select("doc_id", "input_ids", "_l.lang")
    # one row per language: broadcast (a dominant language is not a hot shuffle key)
    t = t.join(F.broadcast(lang_ids.withColumnRenamed("lang", "_lang")), F.col("lang").eqNullSafe(F.col("_lang")))
    return t.select("doc_id", F.array_join(TK.set_language_token("input_ids", F.col("lang_id")).cast("array<string>"),
                                           " ").alias("input_ids"))


# I8: first position -> the document language's token id (ids after the vocabulary)
register("set_language_token", V.with_views("""
SELECT i.doc_id, array_to_string(list_concat([l.lang_id], i.input_ids[2:]), ' ') AS input_ids
FROM ids i JOIN documents d USING (doc_id)
JOIN (SELECT lang, CAST((SELECT max(id) FROM v_vocab) + row_number() OVER (ORDER BY lang) AS INTEGER) AS lang_id
      FROM (SELECT DISTINCT lang FROM documents)) l USING (lang)""", "v_vocab", ctes=_FULL_SQL))(
    _language_tokens)
