"""The language model of the queries is trained on every document."""

from __future__ import annotations

from collections import Counter

import pytest
from conftest import SF001

from polytext.plans import catalog_langid as LQ
from polytext.plans import registry
from polytext.plans import views as V
from polytext.operators import qc

ALL = "(SELECT lang, text FROM documents)"


def test_language_of_odd_documents_only_is_detected(spark, tmp_path):
    rows = [(0, "en", "the cat sat on the mat"), (1, "et", "öötöö jäääär õueaiaäärne"), (2, "en", "a dog and a cat"),
            (3, "et", "jäääär öötöö")]
    spark.createDataFrame(rows, "doc_id long, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["detected"] for r in registry.queries()["detect_language"](spark, str(tmp_path)).collect()}
    assert got == {i: lang for i, lang, _ in rows}


@pytest.mark.parametrize("name", ["detect_language", "pair_qc_lid"])
def test_training_on_all_documents_against_sql(spark, duck, name):
    if name == "detect_language":
        sql = V.with_views("SELECT key, detected FROM det", ctes=LQ.sql_nb(ALL, LQ._TEST))
    else:
        label = qc.sql_pair_qc_label("h.src_segm", "h.hyp_output", "h.tgt_lang", "det.detected")
        sql = V.with_views(f"SELECT h.hyp_index, {label} FROM v_hyps h JOIN det ON det.key = h.hyp_index", "v_hyps",
                           ctes=LQ.sql_nb(ALL, "(SELECT hyp_index AS key, hyp_output AS text FROM v_hyps)"))
    got = Counter(tuple(r) for r in registry.queries()[name](spark, SF001).collect())
    assert got == Counter(duck.sql(sql).fetchall())
