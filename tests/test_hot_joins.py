"""Joins whose small side has long rows (F1, F11): only hot keys are spread, and
texts are moved once."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from polytext.operators import scoring as SC
from polytext.operators.joins import hot_join


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_hot_join_equals_a_plain_join(spark, how):
    big = spark.createDataFrame([(i, "hot" if i % 2 else f"k{i}" if i % 4 else None) for i in range(100)], "id long, k string")
    small = spark.createDataFrame([("hot", "x"), ("k2", "y"), ("k2", "z"), ("lost", "w"), (None, "n")], "k string, v string")
    got = hot_join(big, small, ["k"], how, salt_by=F.col("id"), hot_rows=5)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, big.join(small, ["k"], how).collect()), key=str)


def test_only_hot_keys_are_copied(spark):
    big = spark.createDataFrame([(i, "hot" if i else "cold") for i in range(30)], "id long, k string")
    small = spark.createDataFrame([("hot", "x"), ("cold", "y")], "k string, v string")
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    # 8 copies of one hot row and one of the cold row: every copy passes the join's small side
    plan = hot_join(big, small.mapInArrow(count, small.schema), ["k"], hot_rows=5)
    assert plan.count() == 30
    assert seen.value == 2


def test_memo_translates_each_triple_once_and_the_last_source_wins(spark):
    seen = spark.sparkContext.accumulator(0)

    class Counting:
        def __call__(self, prompts):
            seen.add(len(prompts))
            return [p.upper() for p in prompts]

    missing = spark.createDataFrame(
        [(1, "est", "fin", "a"), (1, "rus", "fin", "b"), (2, "est", "fin", "a"), (2, "est", "hun", "a"), (3, "est", "fin", None),
         (None, "est", "fin", "a"), (4, None, "fin", "a")], "tuple_id long, src string, tgt string, sentence string")
    rank = F.array_position(F.array(F.lit("est"), F.lit("rus")), F.col("src"))
    got = SC.memo_translate_fill(None, missing, rank, factory=Counting)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(
        [(1, "fin", "B"), (2, "fin", "A"), (2, "hun", "A"), (None, "fin", "A")], key=str)
    assert seen.value == 3  # (est, fin, a), (rus, fin, b), (est, hun, a)
