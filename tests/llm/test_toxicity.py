from __future__ import annotations

import random

import numpy as np

import pytest
from pyspark.sql import functions as F

from llm_data import SF01, SF1
from polytext.llm import toxicity as T
from polytext.llm.common import read


def brute(values):
    """Maximal segments by definition: the best segment (of equal ones the shortest), then left and right of it."""
    best = None
    for i in range(len(values)):
        for j in range(i + 1, len(values) + 1):
            s = sum(values[i:j])
            if s > 0 and (best is None or (s, i - j) > (best[0], best[1] - best[2])):
                best = s, i, j
    if best is None:
        return []
    s, i, j = best
    return brute(values[:i]) + [(i, j, s)] + [(a + j, b + j, x) for a, b, x in brute(values[j:])]


def test_segments_match_their_definition():
    r = random.Random(1)
    for _ in range(300):
        n, cost = r.randrange(1, 14), r.choice([0.25, 0.5, 1.0])
        known = [(i, r.choice([-2.0, 0.125, 0.5, 1.0, 2.0, 3.0])) for i in range(n) if r.random() < 0.6]
        values = [-cost] * n
        for i, s in known:
            values[i] += s
        got, want = T.segments(known, cost), brute(values)
        assert got == want


def test_lambda_and_logistic():
    lam = T.lambda_of(np.array([2.0, -1.0]), np.array([0.1, 0.9]))
    assert abs(0.1 * np.exp(2 * lam) + 0.9 * np.exp(-lam) - 1) < 1e-6
    slope, _ = T.logistic(np.array([0.0, 0.1, 2.0, 2.1]), np.array([0.0, 0.0, 1.0, 1.0]))
    assert slope > 0


def test_held_out_accuracy_and_rows(spark):
    docs, labels = read(spark, SF01, "documents"), read(spark, SF01, "labels")
    got = {r["doc_id"]: r for r in T.classify(docs, T.fit(docs, labels)).collect()}
    assert len(got) == docs.count()
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    clean = [got[i] for i, y in truth.items() if y == 0 and got[i]["held_out"]]
    assert sum(r["predicted"] for r in clean) / len(clean) < 0.05
    every = [(got[i]["score"], y) for i, y in truth.items() if got[i]["held_out"]]
    pairs = [(a > b) + 0.5 * (a == b) for a, y in every for b, z in every if y == 1 and z == 0]
    assert sum(pairs) / len(pairs) > 0.8


@pytest.mark.parametrize("copies", [1, 5, 25])
def test_copies_and_near_copies_are_no_evidence(spark, copies):
    docs, labels = read(spark, SF1, "documents"), read(spark, SF1, "labels")
    docs = docs.join(labels.select("doc_id", "toxic", "quality"), "doc_id")
    some = docs.where("doc_id % 5 = 0 or toxic = 1")  # every second copy is a near one
    more = some.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(copies - 1)))) if copies > 1 else some.limit(0).withColumn("k", F.lit(0))
    more = more.withColumn("text", F.when(F.col("k") % 2 == 0, F.concat("text", F.lit(" extra "), F.col("k").cast("string"))).otherwise(F.col("text")))
    every = docs.unionByName(more.withColumn("doc_id", F.col("doc_id") + F.col("k") * 10**7).drop("k")).cache()
    model = T.fit(every.select("doc_id", "text"), every.select("doc_id", "toxic", "quality"))
    assert model.lam > 0.5 and 20 < len(model.odds) < 500
    rows = T.classify(docs, model).join(labels, "doc_id").where("held_out").select("score", "toxic").collect()
    toxic, clean = ([r["score"] for r in rows if r["toxic"] == y] for y in (1, 0))
    assert np.mean([s >= 0.5 for s in toxic]) > 0.9 and np.mean([s >= 0.5 for s in clean]) < 0.03
    every.unpersist()


def test_odd_rows_and_no_labels(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(1, 15)] + [(None, 1, 1), (2, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    got = T.classify(odd_docs, T.fit(odd_docs, labels)).collect()
    assert len(got) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in got)
    none = T.classify(odd_docs, T.fit(odd_docs, labels.limit(0))).collect()
    assert {r["score"] for r in none} == {0.0}
    assert T.classify(no_docs, T.fit(no_docs, labels)).collect() == []


def test_passages():
    m = T.Model({"vile": 4.0}, lam=1.0, k=0.01)
    text = " ".join(["word"] * 30 + ["vile"] * 4 + ["word"] * 30)
    (first, end, s, p), = m.significant(text)
    assert (first, end) == (30, 34) and s > 15 and p < T.SIGNIFICANT
    assert m.significant(None) == [] and m.significant("...") == []
