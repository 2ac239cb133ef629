"""set_language_token keeps documents without a language (I8)."""

from __future__ import annotations

from polytext.plans import registry


def test_null_language_keeps_its_row(spark, tmp_path):
    rows = [(1, "en", "a b a b"), (2, None, "a b c"), (3, "et", "b a"), (4, None, "c b a")]
    spark.createDataFrame(rows, "doc_id long, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = {r["doc_id"]: r["input_ids"].split()[0] for r in
           registry.queries()["set_language_token"](spark, str(tmp_path)).collect()}
    assert out.keys() == {1, 2, 3, 4}
    en, et, none = int(out[1]), int(out[3]), int(out[2])
    assert out[4] == out[2] and (et, none) == (en + 1, en + 2)
