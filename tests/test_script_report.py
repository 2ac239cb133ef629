"""script_mismatch_report lists the texts in another script than expected."""

from __future__ import annotations

from polytext.plans import registry


def test_mismatches_are_listed_with_both_scripts_and_counted(spark, tmp_path):
    # codes by doc_id % 5: est, rus, udm, <2lv>, xx; Latin look-alikes become Cyrillic where doc_id % 3 = 0
    rows = [(1, "latin text"), (11, "<tag> latin \u0436"), (11, "<tag> latin \u0436"), (6, "\u0434\u0430 \u0434\u0430"), (5, "good"), (15, "aeocp"),
            (4, "any"), (14, "12 34"), (2, "")]
    spark.createDataFrame([(i, "en", t) for i, t in rows], "doc_id long, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = registry.queries()["script_mismatch_report"](spark, str(tmp_path))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan
    got = sorted((tuple(r) for r in out.select("doc_id", "code", "this_is", "should_be", "text", "n").collect()), key=str)
    want = [(1, "rus", "latn", "cyrl", "latin text", 3), (11, "rus", "latn", "cyrl", "<tag> latin \u0436", 3), (11, "rus", "latn", "cyrl", "<tag> latin \u0436", 3),
            (15, "est", "cyrl", "latn", "\u0430\u0435\u043e\u0441\u0440", 1), (4, "xx", "latn", "unk", "any", 1)]
    assert got == sorted(want, key=str)
