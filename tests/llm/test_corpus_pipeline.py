from __future__ import annotations

import pytest

import corpus_pipeline as P
from llm_data import SF001
from polytext.llm import pii
from polytext.llm.queries import tokenizer


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet").cache()
    out = [docs]
    for _, f in P.STAGES:
        out.append(f(spark, out[-1], SF001).cache())
    return out


def test_stages_keep_the_columns_and_only_filter_or_redact(steps):
    docs, good, single, clean, private, _ = steps
    assert [n for n, _ in P.STAGES] == ["quality", "near_duplicates", "decontamination", "personal_data", "tokens"]
    for s in steps[1:5]:
        assert s.columns == docs.columns
    before = docs.collect()
    for s in (good, single, clean):
        after = s.collect()
        assert set(after) <= set(before) and len(after) < len(before)
        before = after
    assert {r["doc_id"]: r["text"] for r in private.collect()} == {r["doc_id"]: pii.redact(r["text"]) for r in before}


def test_near_duplicates_against_brute_force(steps):
    good, single = steps[1].collect(), {r["doc_id"] for r in steps[2].collect()}
    sets = {r["doc_id"]: (lambda w: {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set())(r["text"].lower().split()) for r in good}
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    assert single == {i for i in sets if top(i) == i}


def test_last_stage_and_run(spark, steps):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=tokenizer())
    texts = {r["doc_id"]: r["text"] for r in steps[4].collect()}
    last = steps[5].collect()
    assert all(r["ids"] == lib.encode(texts[r["doc_id"]]) and r["n_tokens"] == len(r["ids"]) for r in last)
    assert sorted(map(str, P.run(spark, SF001).collect())) == sorted(map(str, last))


def test_odd_rows_pass_all_stages(spark, odd_docs, no_docs):
    keep = ["doc_id", "text", "lang", "score AS source", "n_tokens AS n_chars", "c", "rank"]
    for docs in (odd_docs.selectExpr(*keep), no_docs.selectExpr(*keep)):
        for name, f in P.STAGES[1:]:
            docs = f(spark, docs, SF001)
        assert docs.count() <= 18


def test_very_long_texts_pass_quality_and_tokens(spark):
    rows = [(i, "Long texts, é and plain words. " * 40_000, "en", "x", 1) for i in range(6)] + [(7, None, None, None, None), (8, "", "en", "x", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert P.quality(spark, docs, SF001).columns == docs.columns
    got = {r["doc_id"]: r["n_tokens"] for r in P.tokens(spark, docs, SF001).select("doc_id", "n_tokens").collect()}
    assert len(got) == 8 and got[7] == got[8] == 0 and min(got[i] for i in range(6)) > 200_000


def test_texts_are_not_shuffled_to_leave_near_duplicates_out(spark):
    rows = [(i, f"{i % 3} " + " ".join(f"w{j}" for j in range(30)), "en", "x", 1) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if the keys passed it
    try:
        kept = P.near_duplicates(spark, docs, SF001)
        plan = kept._jdf.queryExecution().sparkPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
    assert [r.doc_id for r in kept.collect()] == [0]


def test_rows_are_left_out_by_broadcast_and_by_bit_table(spark):
    docs = spark.createDataFrame([(i % 40 if i % 7 else None, i % 3, f"t{i}") for i in range(200)], "doc_id long, _text long, text string")
    gone = spark.createDataFrame([(i, i % 3) for i in range(0, 40, 2)], "doc_id long, _text long")
    out = {(i, i % 3) for i in range(0, 40, 2)}
    want = sorted(tuple(r) for r in docs.collect() if (r.doc_id, r._text) not in out and r.doc_id is not None)
    for most in (1 << 20, 0):
        got = [tuple(r) for r in P.without(docs, gone, ["doc_id", "_text"], most).collect()]
        assert sorted(r for r in got if r[0] is not None) == want and len(got) == len(want) + 29
