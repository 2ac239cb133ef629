"""BPE merges against a brute-force learner."""

from __future__ import annotations

from collections import Counter

import pytest
from conftest import SF001
from pyspark.sql import functions as F

from polytext.operators.subword import END_OF_WORD, alternatives, learn_bpe, merged, unfinished, vocab_budget
from polytext.plans import registry


def _brute(texts, budget, min_count=2, share=0.25, per_round=256):
    """Every round counts all pairs of all words anew."""
    words = Counter(w for t in texts for w in t.lower().split())
    seqs = {w: list(w) + [END_OF_WORD] for w in words}
    known, out, step = {x for s in seqs.values() for x in s}, [], 0
    while len(known) < budget:
        pc = Counter()
        for w, s in seqs.items():
            for pair in zip(s, s[1:]):
                pc[pair] += words[w]
        order = sorted(((a, b, c) for (a, b), c in pc.items() if c >= min_count), key=lambda x: (-x[2], x[0].encode(), x[1].encode()))[:per_round]
        taken, used = [], set()
        for a, b, c in order:
            if c >= share * order[0][2] and not used & {a, b} and len(known) + len(taken) < budget:
                taken.append((a, b, c))
                used |= {a, b}
        if not taken:
            break
        for a, b, c in taken:
            out.append((len(out), step, a, b, c))
            for w, s in seqs.items():
                new = []
                for x in s:
                    if new and new[-1] == a and x == b:
                        new[-1] = a + b
                    else:
                        new.append(x)
                seqs[w] = new
        known |= {a + b for a, b, _ in taken}
        step += 1
    return out


TEXTS = ["aaa aa banana bandana", "an anna banana", "aaaa a b ab ab ab", "x.*x (x) x\\\\Ex $1 é漢😀 é漢 é漢😀 [a] [a]"]


@pytest.mark.parametrize("share,per_round", [(0.25, 256), (1.0, 1), (0.0, 3)])
def test_bpe_matches_brute_force(spark, share, per_round):
    df = spark.createDataFrame([(t,) for t in [*TEXTS, None, ""]], "text string")
    for budget in (5, 40, 1000):
        got = [tuple(r) for r in learn_bpe(df, "text", budget, share=share, per_round=per_round).orderBy("rank").collect()]
        assert got == _brute(TEXTS, budget, share=share, per_round=per_round)


def test_one_merge_a_round_is_the_greedy_learner():
    """With one pair a round the rule is plain byte-pair encoding."""
    out = _brute(TEXTS, 30, per_round=1)
    assert [r[0] for r in out] == [r[1] for r in out]


def test_registered_query_fills_the_vocabulary(spark):
    got = sorted(tuple(r) for r in registry.queries()["learn_subword_vocab"](spark, SF001).collect())
    texts = [r[0] for r in spark.read.parquet(f"{SF001}/documents.parquet").select("text").collect()]
    assert got == _brute(texts, 1998)
    assert len(got) > 1500 and got[-1][1] < len(got) / 8


def test_vocab_budget():
    assert vocab_budget("facebook/m2m100", 1000) == 892
    assert vocab_budget("NLLB-600M", 1000) == 998
    assert vocab_budget("llama", 1000) == 1000


def test_pairs_of_one_first_character_are_tried_together_and_finished_words_leave(spark):
    merges = [("a", "b"), ("ac", "d"), ("ad", "."), ("(", ")"), ("(x", "😀"), ("😀y", "é")]
    assert alternatives(merges).count("(?=") == 3
    words = [" a b </w> ", " ac d ad . </w> ", " ( ) (x 😀 😀y é ", " a c b ", " aa b ", " ab</w> ", " a b a b "]
    got = unfinished(spark.createDataFrame([(w,) for w in words], "s string").select(merged(F.col("s"), merges).alias("s")))
    assert [r.s for r in got.collect()] == [" ab </w> ", " acd ad. </w> ", " () (x😀 😀yé ", " a c b ", " aa b ", " ab ab "]
