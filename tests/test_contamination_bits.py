"""Contamination against a dev set beyond the broadcast bound: a bit table lets
few train rows through to the exact join, and results stay the same."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from polytext.operators import contamination as C
from polytext.operators.joins import bit_table, may_match

DEV = [("en", f"dev sentence {i}") for i in range(300)] + [("fi", "shared"), ("en", ""), (None, "no language"), ("en", None)]
PAIRS = ([("en", f"dev sentence {i % 700}", "fi", f"other {i}") for i in range(1500)]
         + [("en", f"free {i}", "fi", "shared") for i in range(40)] + [("en", "shared", "fi", "x")] * 3
         + [(None, "no language", "fi", "x"), ("en", None, "fi", "y"), ("en", "", "fi", "z")])


@pytest.fixture
def tables(spark):
    dev = spark.createDataFrame(DEV * 2, "lang string, sentence string")
    return dev, spark.createDataFrame(PAIRS, "src_lang string, src string, tgt_lang string, tgt string")


def test_bit_table_never_misses_a_key(spark, tables):
    dev, pairs = tables
    for bits in (64, 40_000, 1 << 26):
        table = bit_table(dev, ["lang", "sentence"], bits)
        assert dev.count() == may_match(dev, table, ["lang", "sentence"], "m", bits).where("m").count()
    free = spark.range(5000).select(F.lit("en").alias("lang"), F.concat(F.lit("free "), "id").alias("sentence"))
    assert may_match(free, bit_table(dev, ["lang", "sentence"]), ["lang", "sentence"], "m").where("m").count() < 5


@pytest.mark.parametrize("bound", [1 << 30, 0])
def test_pairs_and_hits_are_those_of_a_plain_search(spark, monkeypatch, tables, bound):
    monkeypatch.setattr(C, "MAX_BROADCAST_BYTES", bound)
    dev, pairs = tables
    keys = {k for k in DEV if None not in k}
    want = [p for p in PAIRS if p[:2] not in keys and p[2:] not in keys]
    assert sorted(map(tuple, C.decontaminate(pairs, dev).collect()), key=str) == sorted(want, key=str)
    train = pairs.select(F.col("src_lang").alias("lang"), F.col("src").alias("sentence"))
    got = {(r.lang, r.sentence): r.hits for r in C.contamination_hits(train, dev).collect() if r.lang and r.sentence is not None}
    assert got == {k: sum(p[:2] == k for p in PAIRS) for k in keys}


def test_rows_that_the_table_rules_out_pass_by_the_join(spark, monkeypatch, tables):
    monkeypatch.setattr(C, "MAX_BROADCAST_BYTES", 0)
    plan = C.decontaminate(tables[1], tables[0])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("strategy=broadcast") >= 2 and "Union" in plan
