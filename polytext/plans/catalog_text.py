"""Registered queries: prompt rendering."""

from __future__ import annotations

from pyspark.sql import functions as F

from polytext.functions import prompts as P
from polytext.plans import views as V
from polytext.plans.catalog_synth import _SCORED_PIVOT_SQL, _scored_pivot
from polytext.plans.registry import register

register("prompt_passthrough", "SELECT doc_id, text AS prompt FROM documents")(
    lambda spark, sf: V.table(spark, sf, "documents").select("doc_id", F.col("text").alias("prompt")))

register("prompt_mt_inference", V.with_views(
    f"SELECT doc_id, {P.sql_render(P.MT_INFERENCE)} AS prompt, {P.sql_render(P.MT_LID_INFERENCE)} AS lid_prompt "
    "FROM v_entries", "v_entries"))(
    lambda spark, sf: V.entries(spark, sf).select("doc_id", P.prompt_mt_inference().alias("prompt"),
                                                  P.prompt_mt_inference(lid=True).alias("lid_prompt")))

register("prompt_mt_train", V.with_views(f"SELECT doc_id, {P.sql_prompt_mt_train()} AS prompt FROM v_entries",
                                         "v_entries"))(
    lambda spark, sf: V.entries(spark, sf).select("doc_id", P.prompt_mt_train().alias("prompt")))

register("prompt_alpaca", V.with_views(
    f"SELECT conv_id, turn, {P.sql_render(P.ALPACA_INFERENCE)} AS prompt, {P.sql_render(P.ALPACA_TRAIN)} AS "
    "train_prompt FROM v_alpaca", "v_alpaca"))(
    lambda spark, sf: V.alpaca(spark, sf).select("conv_id", "turn", P.prompt_alpaca(True).alias("prompt"),
                                                 P.prompt_alpaca(False).alias("train_prompt")))

register("prompt_pivot", V.with_views(f"SELECT doc_id, {P.sql_prompt_pivot()} AS prompt FROM scored", "v_hyps",
                                      ctes=_SCORED_PIVOT_SQL))(
    lambda spark, sf: _scored_pivot(spark, sf).select("doc_id", P.prompt_pivot().alias("prompt")))

register("prompt_qc_judge", V.with_views(f"SELECT doc_id, {P.sql_prompt_qc_judge('hyp_output')} AS prompt FROM scored",
                                         "v_hyps", ctes=_SCORED_PIVOT_SQL))(
    lambda spark, sf: _scored_pivot(spark, sf).select("doc_id", P.prompt_qc_judge("hyp_output").alias("prompt")))

register("prompt_legacy", V.with_views(
    f"SELECT doc_id, {P.sql_prompt_legacy('a')} AS prompt_a, {P.sql_prompt_legacy('b')} AS prompt_b FROM v_entries",
    "v_entries"))(
    lambda spark, sf: V.entries(spark, sf).select("doc_id", P.prompt_legacy("a").alias("prompt_a"),
                                                  P.prompt_legacy("b").alias("prompt_b")))

# Inputs of every fourth document carry a '<variety> ' tag (the source name)
_TAGGED_SQL = ("(SELECT doc_id, src_lang, tgt_lang, tgt_segm, CASE WHEN doc_id % 4 = 0 THEN '<' || s.source || '> ' "
               "|| src_segm ELSE src_segm END AS src_in FROM v_entries JOIN (SELECT doc_id, source FROM documents) s "
               "USING (doc_id))")


def _tagged(spark, sf):
    d = V.table(spark, sf, "documents").select("doc_id", "source")
    return V.entries(spark, sf).join(d, "doc_id").select(
        "doc_id", "src_lang", "tgt_lang", "tgt_segm",
        F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("<"), "source", F.lit("> "), "src_segm"))
        .otherwise(F.col("src_segm")).alias("src_in"))


register("prompt_gen_text", V.with_views(
    f"SELECT doc_id, {P.sql_prompt_gen_text('src_lang', 'tgt_lang', 'src_in')} AS prompt, "
    f"CASE WHEN tgt_segm IS NULL THEN {P.sql_prompt_gen_text('src_lang', 'tgt_lang', 'src_in')} ELSE "
    f"{P.sql_prompt_gen_text('src_lang', 'tgt_lang', 'src_in')} || tgt_segm || '</s>' END AS train_prompt "
    f"FROM {_TAGGED_SQL}", "v_entries"))(
    lambda spark, sf: _tagged(spark, sf).select(
        "doc_id", P.prompt_gen_text(text="src_in").alias("prompt"),
        P.prompt_gen_text(text="src_in", output="tgt_segm", eos="</s>").alias("train_prompt")))

# Raw decoder output = prompt + generated text (+ further lines)
register("strip_prompt_from_output", V.with_views(f"""
SELECT doc_id, split_part(substr(raw, length(prompt) + 1), chr(10), 1) AS hyp
FROM (SELECT doc_id, prompt, prompt || hyp_output || chr(10) || 'tail' AS raw
      FROM (SELECT doc_id, hyp_output, {P.sql_render(P.MT_INFERENCE)} AS prompt FROM v_hyps))""", "v_hyps"))(
    lambda spark, sf: V.hyps(spark, sf)
    .select("doc_id", P.prompt_mt_inference().alias("prompt"), "hyp_output")
    .select("doc_id", "prompt", F.concat("prompt", "hyp_output", F.lit("\ntail")).alias("raw"))
    .select("doc_id", P.strip_prompt_from_output("raw", "prompt").alias("hyp")))
