"""Registered queries: contamination."""

from __future__ import annotations

from pyspark.sql import functions as F

from polytext.operators import contamination as CT
from polytext.plans import views as V
from polytext.plans.registry import register


def _sentence_pairs(spark, sf):
    """Consecutive sentences of a document as (src, tgt) pairs (row-local)."""
    d = V.table(spark, sf, "documents").select("doc_id", "lang", CT.sentences(F.col("text")).alias("s"))
    d = d.where(F.size("s") >= 2)
    return d.select("doc_id", "lang", F.posexplode(F.transform(
        F.sequence(F.lit(1), F.size("s") - 1), lambda i: F.struct(F.element_at("s", i).alias("src"),
                                                                  F.element_at("s", i + 1).alias("tgt"))))
        .alias("pos", "p")).select("doc_id", "pos", F.col("lang").alias("src_lang"),
                                  F.col("lang").alias("tgt_lang"), "p.src", "p.tgt")


_PAIRS_SQL = """pairs AS (SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, lang AS src_lang, lang AS tgt_lang, sents[i] AS src,
    sents[i + 1] AS tgt
  FROM (SELECT *, unnest(range(1, len(sents))) AS i FROM v_doc_sents WHERE len(sents) >= 2))"""

register("decontaminate", V.with_views("""
SELECT * FROM pairs p WHERE NOT EXISTS (SELECT 1 FROM v_dev d WHERE d.lang = p.src_lang AND d.sentence = p.src)
  AND NOT EXISTS (SELECT 1 FROM v_dev d WHERE d.lang = p.tgt_lang AND d.sentence = p.tgt)""",
                                       "v_doc_sents", "v_dev", ctes=_PAIRS_SQL))(
    lambda spark, sf: CT.decontaminate(_sentence_pairs(spark, sf), V.dev_sentences(spark, sf)))

_HITS_SQL = """hits AS (SELECT d.lang, d.sentence, count(s.sentence) AS hits
  FROM (SELECT DISTINCT lang, sentence FROM v_dev) d LEFT JOIN v_sents s ON s.lang = d.lang AND s.sentence = d.sentence
  GROUP BY d.lang, d.sentence)"""


def _hits(spark, sf):
    return CT.contamination_hits(V.train_sentences(spark, sf), V.dev_sentences(spark, sf))


register("contamination_hits", V.with_views("SELECT * FROM hits", "v_sents", "v_dev", ctes=_HITS_SQL))(_hits)

register("contamination_report", V.with_views("""
SELECT lang, count(*) AS dev_sentences, count(*) FILTER (WHERE hits > 0) AS contaminated,
  100.0 * count(*) FILTER (WHERE hits > 0) / count(*) AS percent, CAST(sum(hits) AS BIGINT) AS occurrences
FROM hits GROUP BY lang""", "v_sents", "v_dev", ctes=_HITS_SQL))(
    lambda spark, sf: CT.contamination_report(_hits(spark, sf)))
