"""Registered queries: language identification (C2) and QC with the detector
(C1 + C2).  The model is trained on all documents and applied to every document
and to every hypothesis.  Only the confusion report trains on the even documents
(the odd ones are its hold-out set)."""

from __future__ import annotations

from pyspark.sql import functions as F

from polytext.operators import langid as LI
from polytext.operators import qc
from polytext.plans import views as V
from polytext.plans.registry import register


def sql_nb(train_src: str, apply_src: str) -> str:
    """CTEs ending in ``det(key, detected)``; sources give (lang, text) and (key, text)."""
    return f"""
tr AS (SELECT lang, lower(text) AS t FROM {train_src}),
counts AS (SELECT lang, gram, count(*) AS c FROM (SELECT lang, substr(t, i, 3) AS gram FROM
  (SELECT lang, t, unnest(range(1, length(t) - 1)) AS i FROM tr WHERE length(t) >= 3)) GROUP BY ALL),
nv AS (SELECT count(DISTINCT gram) AS v FROM counts),
pl AS (SELECT lang, sum(c) + (SELECT v FROM nv) AS den,
  ln(CAST(1.0 AS DOUBLE) / (sum(c) + (SELECT v FROM nv))) AS unseen_lp FROM counts GROUP BY lang),
model AS (SELECT c.lang, c.gram, ln((c.c + 1) / pl.den) - pl.unseen_lp AS delta FROM counts c JOIN pl USING (lang)),
te AS (SELECT key, lower(text) AS t FROM {apply_src}),
g AS (SELECT key, gram, count(*) AS n FROM (SELECT key, substr(t, i, 3) AS gram FROM
  (SELECT key, t, unnest(range(1, length(t) - 1)) AS i FROM te WHERE length(t) >= 3)) GROUP BY ALL),
tot AS (SELECT key, sum(n) AS tot FROM g GROUP BY key),
seen AS (SELECT g.key, m.lang, sum(g.n * m.delta) AS s FROM g JOIN model m USING (gram) GROUP BY ALL),
sc AS (SELECT t.key, p.lang, round(t.tot * p.unseen_lp + coalesce(s.s, 0.0), {LI.SCORE_DIGITS}) AS score
  FROM tot t CROSS JOIN pl p LEFT JOIN seen s ON s.key = t.key AND s.lang = p.lang),
det AS (SELECT te.key, coalesce(arg_min(sc.lang, (-sc.score, sc.lang)), 'none') AS detected
  FROM te LEFT JOIN sc USING (key) GROUP BY te.key)"""


_TRAIN = "(SELECT lang, text FROM documents WHERE lang IS NOT NULL)"
_TRAIN_EVEN = "(SELECT lang, text FROM documents WHERE lang IS NOT NULL AND doc_id % 2 = 0)"
_TEST = "(SELECT doc_id AS key, text FROM documents)"


def _model(spark, sf, hold_out=False):
    d = V.table(spark, sf, "documents")
    if hold_out:
        d = d.where(F.col("doc_id") % 2 == 0)
    return LI.train(d.select("lang", "text"))


def _detected(spark, sf, hold_out=False):
    d = V.table(spark, sf, "documents")
    model, per_lang = _model(spark, sf, hold_out)
    return LI.detect(d.select("doc_id", "text"), model, per_lang, "doc_id")


register("detect_language", V.with_views("SELECT key AS doc_id, detected FROM det", ctes=sql_nb(_TRAIN, _TEST)))(
    lambda spark, sf: _detected(spark, sf).select("doc_id", "detected"))

register("langid_confusion", V.with_views("""
SELECT d.doc_id % 2 = 1 AS held_out, d.lang, det.detected, count(*) AS n
FROM det JOIN documents d ON d.doc_id = det.key GROUP BY ALL""", ctes=sql_nb(_TRAIN_EVEN, _TEST)))(
    lambda spark, sf: LI.accuracy(_detected(spark, sf, hold_out=True), V.table(spark, sf, "documents").select(
        "doc_id", "lang", (F.col("doc_id") % 2 == 1).alias("held_out")), "doc_id", by=["held_out"]))


# C1 + C2: QC labels of the hypotheses with the trained detector
def _qc_lid(spark, sf):
    h = V.hyps(spark, sf)
    model, per_lang = _model(spark, sf)
    # the detector only runs on rows whose label depends on it (cheap checks first)
    out = qc.pair_qc_with_detector(h, "hyp_index", lambda rows: LI.detect(rows, model, per_lang, "hyp_index"))
    return out.select("hyp_index", "flt")


register("pair_qc_lid", V.with_views(f"""
SELECT h.hyp_index, {qc.sql_pair_qc_label('h.src_segm', 'h.hyp_output', 'h.tgt_lang', 'det.detected')} AS flt
FROM v_hyps h JOIN det ON det.key = h.hyp_index""", "v_hyps",
                                     ctes=sql_nb(_TRAIN, "(SELECT hyp_index AS key, hyp_output AS text FROM v_hyps)")))(
    _qc_lid)
