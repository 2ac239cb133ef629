"""Batches are worked on in slices (F2-F8, F12, F14, F15, F18): what a task makes
of a batch stays small beside it."""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from polytext.operators import frames, metrics, scoring
from polytext.operators import tokens as TK
from polytext.sources import json_arrays


def test_cuts_bound_every_run_and_lose_no_row():
    size = np.array([3, 3, 3, 20, 1, 1, 0])
    assert frames.cuts(size, 7) == [(0, 2), (2, 3), (3, 4), (4, 7)]
    assert frames.cuts(np.array([], int), 7) == []


def test_a_large_batch_of_json_chunks_is_scanned_in_slices():
    texts = [json.dumps({"a": "x" * 5000, "b": "\\\"{"}) for _ in range(1000)]
    chunks = ("[" + ",".join(texts) + "]").split("}")
    batch = pa.RecordBatch.from_arrays([pa.array(chunks), pa.array(["f"] * len(chunks)), pa.array([0] * len(chunks))], ["value", "file", "start"])
    assert max(len(data) for _, data in json_arrays._runs(iter([batch]))) <= frames.SLICE_BYTES
    found = [b for b in json_arrays._records({("f", 0): (False, 0)}, False)(iter([batch]))]
    assert [x for b in found for x in b.column("text").to_pylist()] == texts
    assert max(b.nbytes for b in found) <= 2 * frames.SLICE_BYTES


def test_outputs_leave_the_task_in_slices():
    batch = pa.RecordBatch.from_arrays([pa.array(range(600)), pa.array(["x" * 20_000] * 600)], ["id", "p"])  # 12 MB
    got = list(scoring.scored_batches(iter([batch]), lambda prompts: prompts, "p", "o", 7, 1))
    assert [i for b in got for i in b.column("id").to_pylist()] == list(range(600))
    assert all(b.column("p") == b.column("o") for b in got)
    assert max(b.num_rows for b in got) < 100


def test_columns_pass_a_model_unchanged(spark):
    rows = spark.range(0, 60, 1, 1).select("id", F.repeat(F.lit("x"), 200).alias("p"), F.array(F.lit("a")).alias("l"),
                                           F.create_map(F.lit("k"), F.lit(1)).alias("m"))
    got = scoring.score_batches(rows, "p", lambda: lambda prompts: prompts, batch_size=7)
    assert got.where("hyp_output = p and l[0] = 'a' and m['k'] = 1 and hyp_mean_logprob is null").count() == 60


def test_matches_of_wide_alphabets_are_exact():
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 30_000, 40_000), rng.integers(0, 30_000, 40_000)
    b[100:5000] = a[200:5100]

    def grams(x, n):
        from collections import Counter
        return Counter(tuple(x[i:i + n].tolist()) for i in range(len(x) - n + 1))

    assert metrics.ngram_matches(a, b, 6) == [sum((grams(a, n) & grams(b, n)).values()) for n in range(1, 7)]
    assert metrics.ngram_matches(a[:2], b, 4)[2:] == [0, 0]


def test_tokens_are_coded_in_slices(spark, monkeypatch):
    monkeypatch.setattr(TK, "SLICE_TOKENS", 3)
    docs = spark.createDataFrame([(1, "b a b c"), (2, None), (3, ""), (4, "a zz a a a"), (None, "b")], "doc_id long, text string")
    vocab = spark.createDataFrame([*TK.SPECIALS, ("a", 5), ("b", 4)], "token string, id int")
    got = {r["doc_id"]: r["input_ids"] for r in TK.tokenise(docs, "doc_id", "text", vocab).collect()}
    assert got == {1: [4, 5, 4, 3, 2], 2: [2], 3: [2], 4: [5, 3, 5, 5, 5, 2], None: [4, 2]}


def test_spelled_as_joined(spark, monkeypatch):
    """Both ways of detokenising agree, also on repeated, null and unknown keys and ids."""
    monkeypatch.setattr(TK, "SLICE_TOKENS", 3)
    rows = spark.createDataFrame([(1, [4, 5, 9, 2]), (1, [5, 4, 4]), (2, []), (3, None), (4, [3, 0, 2]), (None, [4]), (5, [4, 5, 4, 5, 4])],
                                 "doc_id long, input_ids array<int>")
    vocab = spark.createDataFrame([*TK.SPECIALS, ("a", 5), ("b", 4)], "token string, id int")
    one, other = (sorted(map(tuple, TK.detokenise(rows, "doc_id", "input_ids", vocab, max_broadcast_bytes=n).collect()), key=str)
                  for n in (1 << 20, 0))
    assert one == other
    assert (1, "a b a b b") in one


def test_first_occurrences_are_found_without_a_sort(spark):
    rows = [(5, "b a"), (-7, "c c"), (None, "x b"), (9223372036854775807, "z a"), (-9223372036854775808, "y c")]
    occ = TK.token_occurrences(spark.createDataFrame(rows, "k long, t string"), "k", "t")
    freq = TK.token_frequency(occ)
    want = {r["token"]: (r["n"], tuple(r["f"])) for r in occ.groupBy("token").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("k", "pos")).alias("f")).collect()}
    assert {r["token"]: (r["count"], tuple(r["first"])) for r in freq.collect()} == want
    assert "SortAggregate" not in freq._jdf.queryExecution().toString()
    assert freq.schema["first"].dataType.simpleString() == "struct<k:bigint,pos:int>"
