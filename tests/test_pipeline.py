"""The README flow end to end on the smallest tables: pivot plan -> prompts
-> scoring -> language id -> QC -> accepted synthetic entries."""

from __future__ import annotations

from pyspark.sql import functions as F

from polytext.functions import prompts as P
from polytext.operators import langid, qc, scoring, synth
from polytext.plans import views as V

SF = "/root/testdata/sf0.001"


def test_synthetic_round_trip(spark):
    entries = V.entries(spark, SF)
    plan = synth.pivot_plan(entries)
    prompts = plan.withColumn("prompt", P.prompt_pivot())
    scored = scoring.score_batches(prompts, "prompt")
    model, per_lang = langid.train(V.table(spark, SF, "documents").select("lang", "text"))
    keyed = scored.withColumn("k", F.md5(F.concat_ws("|", "lo_lang", "lo_segm", "hi_lang", "hi_segm",
                                                        "new_hi_res_lang")))
    det = langid.detect(keyed, model, per_lang, key="k", text="hyp_output")
    labelled = qc.pair_qc(keyed.join(det, "k"), src="hi_segm", tgt="hyp_output", tgt_lang="new_hi_res_lang",
                          detected="detected")
    assert labelled.count() == plan.count()
    # detecting only where the label depends on it gives the same labels
    lazy = qc.pair_qc_with_detector(keyed, "k", lambda rows: langid.detect(rows, model, per_lang, "k"),
                                    src="hi_segm", tgt="hyp_output", tgt_lang="new_hi_res_lang")
    assert sorted(tuple(r) for r in labelled.select("k", "flt").collect()) == \
        sorted(tuple(r) for r in lazy.select("k", "flt").collect())
    out = synth.accepted_to_entries(labelled)
    rows = out.collect()
    assert all(r.src_lang.endswith(", synth") and r.task == "approx-translate" for r in rows)
    assert len(rows) == labelled.where(F.col("flt") == "ok").count()
