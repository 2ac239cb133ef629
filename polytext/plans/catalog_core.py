"""Registered queries: QC labels and language-table lookups."""

from __future__ import annotations

from polytext.functions import langs as L
from polytext.operators import qc
from polytext.plans import views as V
from polytext.plans.registry import register

# ---- C1 pair_qc: label of every hypothesis (perfect detector = true language)
register("pair_qc", V.with_views(f"""
SELECT hyp_index, src_lang, tgt_lang,
  {qc.sql_pair_qc_label('src_segm', 'hyp_output', 'tgt_lang', 'hyp_lang')} AS flt
FROM v_hyps""", "v_hyps"))(
    lambda spark, sf: qc.pair_qc(V.hyps(spark, sf)).select("hyp_index", "src_lang", "tgt_lang", "flt"))

# ---- minimum slice: label counts per language pair
register("pair_qc_counts", V.with_views(f"""
SELECT src_lang, tgt_lang, flt, count(*) AS n FROM (
  SELECT src_lang, tgt_lang, {qc.sql_pair_qc_label('src_segm', 'hyp_output', 'tgt_lang', 'hyp_lang')} AS flt
  FROM v_hyps) GROUP BY ALL""", "v_hyps"))(
    lambda spark, sf: qc.pair_qc_counts(qc.pair_qc(V.hyps(spark, sf))))


# ---- B17 / B18 / C3 / D4 / H3 per entry language label
def _lang_lookups(spark, sf):
    e = V.entries(spark, sf)
    return e.select(
        "doc_id", "src_lang", "tgt_lang",
        L.gen_lang_metric("src_lang").alias("src_gen_metric"),
        L.gen_lang_synth("src_lang").alias("src_gen_synth"),
        L.is_high_resource(L.gen_lang_synth("src_lang")).alias("src_is_high"),
        L.resource_tier("src_lang").alias("src_tier"),
        L.resource_tier("tgt_lang").alias("tgt_tier"),
        L.resource_multiplier("src_lang").alias("src_multiplier"),
    )


register("lang_lookups", V.with_views(f"""
SELECT doc_id, src_lang, tgt_lang,
  {L.sql_gen_lang_metric('src_lang')} AS src_gen_metric,
  {L.sql_gen_lang_synth('src_lang')} AS src_gen_synth,
  {L.sql_is_high_resource(L.sql_gen_lang_synth('src_lang'))} AS src_is_high,
  {L.sql_resource_tier('src_lang')} AS src_tier,
  {L.sql_resource_tier('tgt_lang')} AS tgt_tier,
  {L.sql_resource_multiplier('src_lang')} AS src_multiplier
FROM v_entries""", "v_entries"))(_lang_lookups)
