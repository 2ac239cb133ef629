"""Registered training_pairs leaves out dev texts."""

from __future__ import annotations

from polytext.plans import registry


def test_pairs_with_a_dev_text_are_left_out(spark, tmp_path):
    docs = [(i, "en", t, "s") for i, t in ((3, "first text"), (4, "a dev sentence"), (5, "третий"), (6, "sixth text"),
                                           (7, "seventh text"), (8, "восьмой"))]
    spark.createDataFrame(docs, "doc_id long, lang string, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "Some words. a dev sentence. More")], "item_id long, text string").write.parquet(
        f"{tmp_path}/benchmark.parquet")
    rows = registry.queries()["training_pairs"](spark, str(tmp_path)).collect()
    assert not [r for r in rows if "a dev sentence" in (r["input"], r["output"])]
    assert {r["tuple_id"] for r in rows} == {1, 2}
    assert len([r for r in rows if r["tuple_id"] == 2]) == 6
