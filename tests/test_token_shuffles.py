"""Token queries shuffle no list of ids that they could leave where it lies, and
no token more often than once a chunk (F2, F3 of FINDINGS_r04)."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from polytext.operators import tokens as TK
from polytext.plans import registry


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def documents(spark, path, rows):
    spark.createDataFrame(rows, "doc_id long, lang string, text string").write.parquet(f"{path}/documents.parquet")
    return str(path)


@pytest.fixture
def joined(monkeypatch):
    """Vocabularies are joined, whatever their size, and chunks are small."""
    monkeypatch.setattr(TK.tokenise, "__defaults__", (*TK.tokenise.__defaults__[:-1], 0))
    monkeypatch.setattr(TK, "CHUNK_BYTES", 100)


def test_language_tokens_shuffle_no_ids(spark, tmp_path):
    path = documents(spark, tmp_path, [(i, "en" if i % 2 else "fi", f"a b c{i % 5}") for i in range(40)])
    most = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for a table of documents too large to broadcast
    try:
        out = registry.queries()["set_language_token"](spark, path)
        text = plan(out)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)
    assert "SortMergeJoin [doc_id" not in text and "hashpartitioning(doc_id" not in text
    assert out.count() == 40


def test_documents_of_one_id_have_each_of_its_languages(spark, tmp_path):
    rows = [(1, "en", "a b"), (1, None, "b a a"), (1, "en", "c c"), (2, "fi", "a"), (None, "fi", "b b"), (3, None, "a c"), (4, "fi", None)]
    path = documents(spark, tmp_path, rows)
    vocab = {r["token"]: r["id"] for r in registry.queries()["build_vocab"](spark, path).collect()}
    lang = {"en": max(vocab.values()) + 1, "fi": max(vocab.values()) + 2, None: max(vocab.values()) + 3}
    want = []
    for i, _, text in rows:
        ids = [vocab.get(w, TK.UNK_ID) for w in (text or "").split()] + [TK.EOS_ID]
        want += [(i, " ".join(map(str, [lang[x], *ids[1:]]))) for j, x, _ in rows if i is not None and j == i]
    got = [tuple(r) for r in registry.queries()["set_language_token"](spark, path).select("doc_id", "input_ids").collect()]
    assert Counter(got) == Counter(want) and len(got) == 12


@pytest.mark.parametrize("name", ["tokenise_rows", "set_language_token", "tokenise_batches"])
def test_joined_vocabulary_gives_the_rows_of_a_broadcast_one(spark, tmp_path, request, name):
    r = random.Random(3)
    rows = [(i if i % 9 else None, r.choice(["en", None]), " ".join(f"w{int(r.expovariate(0.1))}" for _ in range(r.randrange(40)))) for i in range(60)]
    path = documents(spark, tmp_path, [*rows, *rows[:5], (70, "en", None), (71, "en", "x " * 9000)])
    small = Counter(map(tuple, registry.queries()[name](spark, path).collect()))
    request.getfixturevalue("joined")
    assert Counter(map(tuple, registry.queries()[name](spark, path).collect())) == small and len(small) > 4


def test_joined_vocabulary_makes_no_token_a_row(spark):
    df = spark.createDataFrame([(i, "a b " * 50 + f"c{i}") for i in range(64)], "id long, text string")
    vocab = spark.createDataFrame([("a", 7), ("b", 8)], "token string, id int")
    out = TK.tokenise(df, "id", "text", vocab, max_broadcast_bytes=0)
    text = plan(out)
    assert "posexplode" not in text and "collect_list" not in text and "FlatMapCoGroupsInArrow" in text
    out.collect()
    text = plan(out)
    assert "ReusedExchange" in text or "ReusedQueryStage" in text or text.count("Reused") > 0  # texts are shuffled once


def test_batches_are_padded_where_they_lie(spark, tmp_path):
    df = spark.createDataFrame([(i % 3, i, [1] * (i + 1)) for i in range(9)] + [(None, 9, [1])], "b int, k int, input_ids array<int>")
    df = df.withColumn("n", F.size("input_ids"))
    got = TK.pad_batch(df, "b", multiple=4, length="n")
    assert "SortMergeJoin" not in plan(got)
    rows = lambda x: sorted(tuple(map(str, r)) for r in x.select("b", "k", "input_ids", "attention_mask", "labels").collect())
    assert rows(got) == rows(TK.pad_batch(df.drop("n"), "b", multiple=4)) and len(rows(got)) == 9
    path = documents(spark, tmp_path, [(i, "en", "a b " * i) for i in range(40)])
    out = registry.queries()["tokenise_batches"](spark, path)
    assert "ShuffledHashJoin" in plan(out) and "ArrowEvalPython" not in plan(out)
    assert out.agg(F.sum("rows")).first()[0] == 48
