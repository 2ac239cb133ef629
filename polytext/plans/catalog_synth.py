"""Registered queries: synthetic-data plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from polytext.functions import langs as L
from polytext.functions.rand import sql_hash_u32
from polytext.operators import qc, synth
from polytext.plans import views as V
from polytext.plans.registry import register

_GS = L.sql_gen_lang_synth("src_lang")
_C4 = f"task = 'translate' AND NOT contains(src_lang, 'bible') AND {L.sql_is_high_resource(_GS)}"
_C5 = f"task = 'generate' AND NOT {L.sql_is_high_resource(_GS)}"
_W_VALUES = ", ".join(f"({L.sql_str(n)}, {w}, {i})" for i, (n, w) in enumerate(L.HI_RES_WEIGHTS, start=1))

COUNTS_CTE = f"""counts AS (SELECT tgt_lang AS lo_lang, tgt_segm AS lo_segm, {_GS} AS hi_lang, src_segm AS hi_segm,
  count(*) AS cnt FROM v_entries WHERE {_C4} GROUP BY ALL),
present AS (SELECT lo_lang, lo_segm, list(DISTINCT hi_lang) AS pres FROM counts GROUP BY ALL),
w AS (SELECT * FROM (VALUES {_W_VALUES}) t(lang, w, pos)),
cands AS (SELECT p.lo_lang, p.lo_segm, w.lang, w.w, w.pos,
  sum(w.w) OVER (PARTITION BY p.lo_lang, p.lo_segm ORDER BY w.pos) AS cum,
  sum(w.w) OVER (PARTITION BY p.lo_lang, p.lo_segm) AS tot
  FROM present p, w WHERE NOT list_contains(p.pres, w.lang))"""

register("pivot_source_filter", V.with_views(f"SELECT doc_id, src_lang, tgt_lang FROM v_entries WHERE {_C4}",
                                             "v_entries"))(
    lambda spark, sf: synth.pivot_source_filter(V.entries(spark, sf)).select("doc_id", "src_lang", "tgt_lang"))

register("bt_source_filter", V.with_views(f"SELECT doc_id, src_lang FROM v_entries WHERE {_C5}", "v_entries"))(
    lambda spark, sf: synth.bt_source_filter(V.entries(spark, sf)).select("doc_id", "src_lang"))

register("pivot_counts", V.with_views("SELECT * FROM counts", "v_entries", ctes=COUNTS_CTE))(
    lambda spark, sf: synth.pivot_counts(V.entries(spark, sf)))

register("output_lang_weights", V.with_views(
    "SELECT lo_lang, lo_segm, lang, CAST(cum AS INTEGER) AS cum, w / tot AS weight FROM cands WHERE tot > 0",
    "v_entries", ctes=COUNTS_CTE))(
    lambda spark, sf: synth.output_lang_weights(synth.pivot_counts(V.entries(spark, sf))))

_PIVOT_SQL = V.with_views(f"""
SELECT DISTINCT d.lo_lang, d.lo_segm, d.hi_lang, d.hi_segm, c.lang AS new_hi_res_lang
FROM draws d JOIN cands c ON c.lo_lang = d.lo_lang AND c.lo_segm = d.lo_segm AND c.cum > d.r AND c.cum - c.w <= d.r""",
                          "v_entries", ctes=COUNTS_CTE + f""",
tot AS (SELECT lo_lang, lo_segm, max(tot) AS tot FROM cands GROUP BY ALL),
seeded AS (SELECT c.lo_lang, c.lo_segm, c.hi_lang, c.hi_segm, t.tot,
  md5(concat_ws('|', c.lo_lang, c.lo_segm, c.hi_lang, c.hi_segm)) AS seed,
  c.cnt * {L.sql_resource_multiplier('c.lo_lang')} AS k
  FROM counts c JOIN tot t ON t.lo_lang = c.lo_lang AND t.lo_segm = c.lo_segm WHERE t.tot > 0),
draws AS (SELECT lo_lang, lo_segm, hi_lang, hi_segm,
  CAST(floor({sql_hash_u32('seed', 'i')} * tot / 4294967296.0) AS BIGINT) AS r
  FROM (SELECT *, unnest(range(1, k + 1)) AS i FROM seeded))""")

register("pivot_plan", _PIVOT_SQL)(lambda spark, sf: synth.pivot_plan(V.entries(spark, sf)))

_TOTAL = sum(w for _, w in L.HI_RES_WEIGHTS)
_BT_SQL = V.with_views(f"""
SELECT d.doc_id, d.src_lang, w.lang AS tgt_lang, d.src_segm, 'translate' AS task
FROM (SELECT DISTINCT doc_id, src_lang, src_segm,
        CAST(floor({sql_hash_u32('seed', 'i')} * {_TOTAL} / 4294967296.0) AS BIGINT) AS r
      FROM (SELECT *, unnest(range(1, k + 1)) AS i FROM src)) d
JOIN (SELECT *, sum(w) OVER (ORDER BY pos) AS cum FROM w) w ON w.cum > d.r AND w.cum - w.w <= d.r
GROUP BY ALL""", "v_entries", ctes=f"""
src AS (SELECT doc_id, src_lang, src_segm, md5(concat_ws('|', CAST(doc_id AS VARCHAR), src_lang, src_segm)) AS seed,
  {L.sql_resource_multiplier('src_lang')} AS k FROM v_entries WHERE {_C5}),
w AS (SELECT * FROM (VALUES {_W_VALUES}) t(lang, w, pos))""")

register("bt_plan", _BT_SQL)(lambda spark, sf: synth.bt_plan(V.entries(spark, sf)))


# ---- B19 (with C1): scored pivot entries -> accepted synthetic entries.
# Scored pivot entries of the fixture: v_hyps read as pivot results, the new
# output language assigned by doc_id over the eight languages with messages.
_NEW_LANGS = ["English", "Russian", "Estonian", "Latvian", "Finnish", "Hungarian", "Swedish", "Norwegian"]


def _scored_pivot(spark, sf):
    h = V.hyps(spark, sf)
    new = F.element_at(F.array(*[F.lit(x) for x in _NEW_LANGS]), (F.col("doc_id") % 8 + 1).cast("int"))
    p = h.select("doc_id", F.col("tgt_lang").alias("lo_lang"), F.col("tgt_segm").alias("lo_segm"),
                 L.gen_lang_synth("src_lang").alias("hi_lang"), F.col("src_segm").alias("hi_segm"),
                 new.alias("new_hi_res_lang"), "hyp_output", "hyp_index", "hyp_lang")
    return qc.pair_qc(p, src="hi_segm", tgt="hyp_output", tgt_lang="new_hi_res_lang", detected="hyp_lang")


_SCORED_PIVOT_SQL = f"""scored AS (SELECT *, {qc.sql_pair_qc_label('hi_segm', 'hyp_output', 'new_hi_res_lang', 'hyp_lang')} AS flt
  FROM (SELECT doc_id, tgt_lang AS lo_lang, tgt_segm AS lo_segm, {_GS} AS hi_lang, src_segm AS hi_segm,
    ([{', '.join(L.sql_str(x) for x in _NEW_LANGS)}])[doc_id % 8 + 1] AS new_hi_res_lang,
    hyp_output, hyp_index, hyp_lang FROM v_hyps))"""

register("pivot_qc", V.with_views("SELECT doc_id, new_hi_res_lang, flt FROM scored", "v_hyps",
                                  ctes=_SCORED_PIVOT_SQL))(
    lambda spark, sf: _scored_pivot(spark, sf).select("doc_id", "new_hi_res_lang", "flt"))

register("accepted_to_entries", V.with_views("""
SELECT hyp_output AS src_segm, new_hi_res_lang || ', synth' AS src_lang, lo_segm AS tgt_segm, lo_lang AS tgt_lang,
  'approx-translate' AS task FROM scored WHERE flt = 'ok'""", "v_hyps", ctes=_SCORED_PIVOT_SQL))(
    lambda spark, sf: synth.accepted_to_entries(_scored_pivot(spark, sf)))
