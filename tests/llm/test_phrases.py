from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest

from polytext.llm import phrases as P


def brute(rows, least, cover=50, top=2000):
    """Rows as (lang, text)."""
    n, f = Counter(), Counter()
    for lang, text in rows:
        lang, low = lang or "und", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(ws)
            for d in (1, 2, 3):
                f.update((lang, *ws[i:i + d]) for i in range(len(ws) - d + 1))
    cand = {k: a for k, a in f.items() if len(k) > 2 and a >= least}
    out = []
    for (lang, *ws), a in cand.items():
        if any(len(k) > len(ws) + 1 and k[0] == lang and tuple(ws) in (k[1:3], k[2:4]) and 100 * b >= cover * a for k, b in cand.items()):
            continue
        cuts = [(10**6 * a * a // (f[lang, *ws[:k]] * f[lang, *ws[k:]]), k) for k in range(1, len(ws))]
        s, k = min(cuts)
        out.append((lang, " ".join(ws), a, f[lang, *ws[:k]], f[lang, *ws[k:]], n[lang], s))
    ranked = []
    for lang in sorted({o[0] for o in out}):
        own = sorted((o for o in out if o[0] == lang), key=lambda o: (-o[6], -o[2], o[1].encode()))[:top]
        ranked += [(o[0], i, *o[1:]) for i, o in enumerate(own, 1)]
    return ranked


def texts(seed, n):
    r = random.Random(seed)
    words = ["a", "B", "cé", "漢", "d'e", "f g", "\x1c", "h"]
    return [(r.choice(["en", "fi", None, "und"]), "".join(r.choice(words) + r.choice([" ", " ", "  ", "\t", ", ", ".", "\r\n"]) for _ in range(r.randrange(60)))) for _ in range(n)]


@pytest.mark.parametrize("chunk,budget,sent", [(1 << 22, 1 << 22, 1 << 14), (50, 20, 3)])
def test_equals_brute_force_with_small_and_large_groups(spark, monkeypatch, chunk, budget, sent):
    monkeypatch.setattr(P, "CHUNK", chunk)
    monkeypatch.setattr(P, "SENT", sent)
    rows = [*texts(5, 150), (None, None), ("en", "")]
    df = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], "lang string, text string, h1 int, a int, word string").repartition(3)
    got = sorted(map(tuple, P.mine(df, least=4, budget=budget).collect()))
    assert got == sorted(brute(rows, 4)) and len(got) > 50


def test_top_and_ties(spark):
    rows = [("en", "p q. r s. t u.")] * 12 + [("fi", "x y z. x y z. x y.")] * 6
    df = spark.createDataFrame(rows, "lang string, text string")
    got = sorted(map(tuple, P.mine(df, top=2).collect()))
    assert got == sorted(brute(rows, 10, top=2))
    assert [r[2] for r in got if r[0] == "en"] == ["p q", "r s"]


def test_odd_rows(spark, odd_docs, no_docs):
    rows = [(r.lang, r.text) for r in odd_docs.collect()]
    assert sorted(map(tuple, P.mine(odd_docs, least=3).collect())) == sorted(brute(rows, 3))
    assert P.mine(no_docs).collect() == []


def test_merging_in_steps_gives_the_same_subtree():
    r = np.random.default_rng(1)
    blocks = []
    for _ in range(6):
        b = np.empty(500, P.ENTRY)
        b["h"], b["n"] = r.integers(0, 6, (500, P.DEPTH)), r.integers(1, 5, 500)
        blocks.append(b)
    held = []
    for b in blocks:
        held = [P.subtree([*held, b])]
    assert (held[0] == P.subtree(blocks)).all()


def test_blocks_of_a_long_text_change_nothing(monkeypatch):
    text = " ".join(t for _, t in texts(6, 20))
    whole = P.codes(text, P.Book())
    for block in (1, 7, 64):
        monkeypatch.setattr(P, "BLOCK", block)
        assert (P.codes(text, P.Book()) == whole).all()


def test_a_vocabulary_wider_than_the_packed_key():
    own = np.array([2, 3, 0, 2, 3, 4, 0], np.int32)
    a, b = P.suffixes(own, 5), P.suffixes(own, 1 << 30)
    assert (a[0] == b[0]).all() and (a[1] == b[1]).all()


def test_hashes_shared_by_two_words_take_another_seed(spark, monkeypatch):
    true = P.hashed
    monkeypatch.setattr(P, "hashed", lambda ws, seed: np.minimum(true(ws, seed), np.uint64(5)) if seed == 0 else true(ws, seed))
    df = spark.createDataFrame([("en", "one two three")], "lang string, text string").select("lang", "text")
    assert P.vocabulary(df)[1] == 1


def test_products_beyond_64_bits(spark):
    big = 3 * 10**12
    df = spark.createDataFrame([(big, big + 1, big + 7)], "a long, l long, r long")
    assert df.select(P._score("a", "l", "r")).first()[0] == 10**6 * big * big // ((big + 1) * (big + 7))


def test_a_task_counts_a_million_words_at_once():
    """Six tasks share an executor; larger chunks took more than its memory."""
    import pandas as pd

    from polytext.llm import phrases

    parts = iter([pd.DataFrame({"lang": ["en"] * 30, "text": ["a b c d " * 25_000] * 30})])
    sizes = [len(own) for _, held in phrases.chunks(parts, phrases.CHUNK) for own in held.values()]
    assert len(sizes) > 1 and max(sizes) <= (1 << 20) + 100_001
    assert phrases.BUDGET <= 1 << 20


def test_a_task_holds_a_quarter_million_words_and_sends_no_rare_ones(spark, monkeypatch):
    """Two tasks and the JVM share 3,000 MB of an executor."""
    assert P.CHUNK <= 1 << 18 and P.BUDGET <= 1 << 19
    monkeypatch.setattr(P, "BITS", 1 << 15)  # one row of the bitmap
    df = spark.createDataFrame([("en", f"p q r{i} p q") for i in range(20)], "lang string, text string")
    vocab, seed = P.vocabulary(df)
    table = P.often(vocab, 10, 1 << 20)
    words, held = next(P.chunks(iter([df.toPandas()]), 1 << 20))
    sent = [words[c] for c in P.frequent_only(held["en"], P.hashed(words, seed), table)]
    assert set(sent) == {b"\n", b"p", b"q"} and sent.count(b"p") == 40
    assert int(np.unpackbits(table).sum()) == 2
    got = sorted(map(tuple, P.mine(df).collect()))
    assert got == sorted(brute([tuple(r) for r in df.collect()], 10)) and [r[2] for r in got] == ["p q"]
