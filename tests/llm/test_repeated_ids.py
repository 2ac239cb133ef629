"""Stage near_duplicates where ids repeat: a row goes by its own links only."""

from __future__ import annotations

import corpus_pipeline as P
from llm_data import SF001

X, Y, Z = (" ".join(f"{c}{i}" for i in range(200)) for c in "xyz")


def _kept(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted(P.near_duplicates(spark, docs, SF001).collect(), key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def test_a_text_of_a_dropped_id_stays(spark):
    got = _kept(spark, [(1, X), (5, X), (5, Y), (7, Y), (8, Z)])
    assert [tuple(r) for r in got] == [(1, X), (5, Y), (8, Z)]


def test_null_ids_stay_and_repeats_are_one(spark):
    near = X.replace("x7 ", "other ")
    got = [tuple(r) for r in _kept(spark, [(None, Z), (None, Z), (1, Y), (1, Y), (2, X), (2, near), (3, X), (4, ""), (4, "")])]
    assert got.count((None, Z)) == 2 and got.count((1, Y)) == 1 and got.count((4, "")) == 1
    assert len([r for r in got if r[0] in (2, 3)]) == 1 and len(got) == 5
