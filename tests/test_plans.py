"""Plan checks: no row-at-a-time Python UDF anywhere, Python
(Arrow) stages only in the model-scoring and metric operators, and no Cartesian products
or nested-loop joins."""

from __future__ import annotations

import pytest

from polytext.plans import registry

SF = "/root/testdata/sf0.001"
SCORING = {"score_batches", "overlength_gate", "chunked_translate", "batched_enrichment", "hyp_cache_reuse",
           "memo_translate_fill"}
# n-gram counts within a row (Arrow)
METRICS = {"corpus_metrics", "macro_average_by_class", "metric_row_stats"}
# readers of JSON arrays scan the text of a split (Arrow)
ARRAYS = {"scan_json_array", "scan_categories"}
# ids looked up in the broadcast vocabulary (Arrow)
CODED = {"tokenise_rows", "tokenise_batches", "loss_masks", "detokenise_rows", "pad_batch", "token_roundtrip_report",
         "fill_after_eos", "set_language_token"}
_Q = registry.queries()


@pytest.mark.parametrize("name", sorted(_Q))
def test_plan_shape(spark, name):
    df = _Q[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" not in plan
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    if name not in SCORING | METRICS | ARRAYS | CODED:
        assert "MapInPandas" not in plan and "ArrowEvalPython" not in plan
