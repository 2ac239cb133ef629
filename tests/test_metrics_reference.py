"""Corpus BLEU / chrF against a small pure-Python implementation of the
published definitions (Papineni et al. 2002 with the 13a tokeniser and exp
smoothing as in sacreBLEU, Post 2018; chrF, Popovic 2015, beta 2, averaged
over orders present on both sides)."""

from __future__ import annotations

import math
import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from polytext.operators import metrics as M


def _tok13a(line: str) -> str:
    line = line.rstrip()
    line = line.replace("<skipped>", "").replace("-\n", "").replace("\n", " ")
    line = line.replace("&quot;", '"').replace("&amp;", "&").replace("&lt;", "<").replace("&gt;", ">")
    line = f" {line} "
    line = re.sub(r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", r" \1 ", line)
    line = re.sub(r"([^0-9])([\.,])", r"\1 \2 ", line)
    line = re.sub(r"([\.,])([^0-9])", r" \1 \2", line)
    line = re.sub(r"([0-9])(-)", r"\1 \2 ", line)
    return " ".join(line.split())


def _ngrams(seq, n):
    return Counter(tuple(seq[i:i + n]) for i in range(len(seq) - n + 1))


def py_bleu(hyps, refs):
    correct, total = [0] * 4, [0] * 4
    sys_len = ref_len = 0
    for h, r in zip(hyps, refs):
        ht, rt = _tok13a(h).split(), _tok13a(r).split()
        sys_len += len(ht)
        ref_len += len(rt)
        for n in range(1, 5):
            hc, rc = _ngrams(ht, n), _ngrams(rt, n)
            correct[n - 1] += sum(min(c, rc[g]) for g, c in hc.items())
            total[n - 1] += max(0, len(ht) - n + 1)
    bp = (math.exp(1 - ref_len / sys_len) if sys_len > 0 else 0.0) if sys_len < ref_len else 1.0
    if not any(correct):
        return 0.0
    prec, smooth = [0.0] * 4, 1.0
    for n in range(4):
        if total[n] == 0:
            break
        if correct[n] == 0:
            smooth *= 2
            prec[n] = 100.0 / (smooth * total[n])
        else:
            prec[n] = 100.0 * correct[n] / total[n]
    return bp * math.exp(sum(-9999999999 if p == 0 else math.log(p) for p in prec) / 4)


def py_chrf(hyps, refs):
    stats = [[0, 0, 0] for _ in range(6)]
    for h, r in zip(hyps, refs):
        hs, rs = "".join(h.split()), "".join(r.split())
        for n in range(1, 7):
            hc, rc = _ngrams(hs, n), _ngrams(rs, n)
            stats[n - 1][0] += sum(hc.values())
            stats[n - 1][1] += sum(rc.values())
            stats[n - 1][2] += sum(min(c, rc[g]) for g, c in hc.items())
    p = r_ = 0.0
    eff = 0
    for nh, nr, m in stats:
        if nh > 0 and nr > 0:
            p += m / nh
            r_ += m / nr
            eff += 1
    if eff == 0:
        return 0.0
    p, r_ = p / eff, r_ / eff
    return 100 * 5 * p * r_ / (4 * p + r_) if p + r_ > 0 else 0.0


def _spark_scores(spark, hyps, refs):
    rows = [(i, "English", "Estonian", r, h) for i, (h, r) in enumerate(zip(hyps, refs))]
    df = spark.createDataFrame(rows, "hyp_index long, src_lang string, tgt_lang string, tgt_segm string, "
                                     "hyp_output string")
    out = M.corpus_metrics(df.drop("hyp_output"), df.select("hyp_index", "hyp_output"), digits=10)
    return {r.lp: (r.bleu, r.chrf) for r in out.collect()}["general: English -> Estonian"]


def test_fixed_cases(spark):
    hyps = ["The cat sat on the mat.", "A 3-4 b&amp;c, 1.5 d.", "", "x y z w", "short"]
    refs = ["The cat is on the mat.", "A 3-4 b&c, 1.5 d!", "nothing here", "x y z w", "a much longer reference"]
    b, c = _spark_scores(spark, hyps, refs)
    assert abs(b - py_bleu(hyps, refs)) < 1e-6
    assert abs(c - py_chrf(hyps, refs)) < 1e-6


_word = st.sampled_from(["a", "b", "ab", "the", "cat", "x.", "1,5", "(y)", "q-", "3-4", "é", "ß"])
_sent = st.lists(_word, min_size=0, max_size=8).map(" ".join)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(_sent, _sent), min_size=1, max_size=6))
def test_property_matches_reference(spark, pairs):
    hyps, refs = [h for h, _ in pairs], [r for _, r in pairs]
    b, c = _spark_scores(spark, hyps, refs)
    assert abs(b - py_bleu(hyps, refs)) < 1e-6
    assert abs(c - py_chrf(hyps, refs)) < 1e-6
