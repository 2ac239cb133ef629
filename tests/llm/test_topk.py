from __future__ import annotations

import math
import random

import pytest

from polytext.llm import topk as K


def brute(rows, k=5, every=50):
    ok = sorted({(i, tuple(math.floor(256 * c) for c in v)) for i, v in rows if i is not None and v and all(c is not None and math.isfinite(c) for c in v)})
    out = []
    for i, q in ok:
        if i % every == 0:
            near = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in ok if j != i and len(v) == len(q))
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(near[:k])]
    return sorted(out)


def test_rows(spark):
    r = random.Random(1)
    rows = [(i, [r.gauss(0, 1) * (1 + (i % 7 == 0) * 5) for _ in range(8)]) for i in range(400)]
    rows += [(400 + i, [0.5] * 8) for i in range(120)]  # ties
    rows += [(600, None), (601, []), (602, [None] + [1.0] * 7), (603, [float("nan")] * 8), (604, [float("inf")] * 8), (None, [1.0] * 8), (3, rows[3][1]), (650, [0.0] * 8), (700, [1.0] * 4), (701, [2.0] * 4), (702, [1.0, 2.0, 0.0, 1.0])]
    df = spark.createDataFrame([(*x, "x", "x") for x in rows], "vec_id long, embedding array<double>, label string, rank string").repartition(5)
    want = brute(rows)
    assert sorted(map(tuple, K.top_k(df).collect())) == want
    assert sorted(map(tuple, K.top_k(df, block=3).collect())) == want


def test_large_numbers_and_few_rows(spark):
    rows = [(0, [1e9, 1.0]), (1, [1e9, 2.0]), (2, [-1e9, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, K.top_k(df).collect()))[0][2] == 1
    assert K.top_k(df.limit(0)).collect() == []


@pytest.mark.parametrize("block", [8192, 1])
def test_choice_among_scores_above_53_bits(spark, block):
    rows = [(0, [2.0**12, 1 / 256])] + [(i, [2.0**27, float(c) / 256]) for i, c in ((1, 0), (2, 1), (3, 0), (4, 1), (5, 1))] + [(50, [2.0**12, 0.0])]
    df = spark.createDataFrame([(i, v) for i, v in rows], "vec_id long, embedding array<double>")
    got = {}
    for r in sorted(K.top_k(df, k=2, block=block).collect(), key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    want = {}
    ints = {i: [int(x * 256) for x in v] for i, v in rows}
    for q in (0, 50):
        every = sorted(((-sum(a * b for a, b in zip(ints[q], v)), i) for i, v in ints.items() if i != q))[:2]
        want[q] = [(i, -s) for s, i in every]
    assert got == want and want[0][0] == (2, 2**55 + 1) and want[0][1][0] == 4
