from __future__ import annotations

import numpy as np

from llm_data import SF01
from polytext.llm import quality as Q
from polytext.llm.common import read


def walk(t, x):
    total = t.base
    for root in t.roots:
        at = root
        while t.left[at] != at:
            at = t.left[at] if x[t.feature[at]] <= t.cut[at] else t.right[at]
        total += t.value[at]
    return 1 / (1 + np.exp(-total))


def test_flattened_trees_match_a_walk_and_learn():
    r = np.random.default_rng(1)
    x = r.normal(size=(600, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] < -0.2)).astype(float)
    t = Q.grow(x, y, trees=40)
    said = t.score(x)
    assert np.allclose(said[:50], [walk(t, v) for v in x[:50]])
    assert ((said > 0.5) == y).mean() > 0.95


def test_one_label_or_none_gives_a_constant():
    x = np.ones((4, 2))
    assert (Q.grow(x, np.ones(4)).score(x) > 0.99).all()
    assert (Q.grow(x[:0], np.ones(0)).score(x) == 0.5).all()


def test_statistics_of_odd_texts():
    assert Q.statistics(None) == Q.statistics("") == [0.0] * len(Q.NAMES)
    for t in (" ", "\n\n", "a", "é", "!!", "x " * 100_000):
        assert len(Q.statistics(t)) == len(Q.NAMES) and np.isfinite(Q.statistics(t)).all()


def test_held_out_accuracy(spark):
    docs, labels = read(spark, SF01, "documents"), read(spark, SF01, "labels")
    got = {r["doc_id"]: r for r in Q.classify(docs, Q.fit(docs, labels)).collect()}
    assert len(got) == docs.count()
    own = [(got[r["doc_id"]]["predicted"], r["quality"]) for r in labels.collect() if got[r["doc_id"]]["held_out"]]
    assert sum(a == b for a, b in own) / len(own) > 0.95
    assert all(a == 1 for a, b in own if b == 1)


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(1, 15)] + [(None, 1, 1), (2, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    got = Q.classify(odd_docs, Q.fit(odd_docs, labels)).collect()
    assert len(got) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["held_out"] for r in got if r["doc_id"] is None)
    assert Q.classify(no_docs, Q.fit(no_docs, labels)).collect() == []
