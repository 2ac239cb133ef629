from __future__ import annotations

import re

from polytext.llm import decontam as D

BENCH = [("b1", "One two three FOUR five six seven eight nine ten eleven twelve"), ("b2", "short item"), ("a3", "two three four five six seven eight nine ten eleven"), ("n", None), ("e", ""), ("p", "..."), (None, "null id"), ("b2", "short item")]
TEXTS = ["x one TWO three four, five six seven eight nine ten eleven! y", "Short  item short item", "one two three four five six seven eight nine", None, "", "!!", "a null id here", "é short\u00a0item", "short item. and one two three four five six seven eight nine ten"]


def brute(text, bench, width=10):
    low = lambda s: "".join(c.lower() if c.isascii() else c for c in s or "")
    ws = lambda s: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low(s))
    doc, hit, items = ws(text), set(), set()
    for i, t in bench:
        own = ws(t)
        n = min(width, len(own))
        for p in range(len(own) - n + 1 if own else 0):
            for q in range(len(doc) - n + 1):
                if doc[q:q + n] == own[p:p + n]:
                    hit.update(range(q, q + n))
                    items.update([] if i is None else [i])
    return len(doc), len(hit), sorted(items)


def test_rows_in_one_and_in_several_blocks(spark):
    docs = spark.createDataFrame([(i, t, "x", 0) for i, t in enumerate(TEXTS)] + [(0, TEXTS[0], "x", 0), (None, TEXTS[1], "x", 0)], "doc_id long, text string, items string, n_words int")
    bench = spark.createDataFrame([(*r, 1) for r in BENCH], "item_id string, text string, doc_id int")
    want = sorted(((r["doc_id"], *brute(r["text"], BENCH)) for r in docs.collect()), key=str)
    for size in (1 << 20, 200):
        got = D.decontaminate(docs, bench, block_bytes=size)
        assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in got.collect()), key=str) == want
        for r in got.where("n_hit > 0").collect():
            assert sum(len(D.words(r["text"][s["s"]:s["e"]])) for s in r["spans"]) == r["n_hit"]
        kept = D.clean(docs, bench, block_bytes=size)
        assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(w[0] for w in want if not w[2])


def test_empty_tables(spark, odd_docs, no_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    rows = D.digest(D.decontaminate(odd_docs, none)).collect()
    assert len(rows) == odd_docs.count() and not any(r["contaminated"] for r in rows)
    assert D.decontaminate(no_docs, none).collect() == []


def test_two_item_tables_in_one_worker(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string").coalesce(1)
    for part in (BENCH[:1], BENCH[1:], BENCH[:1]):
        bench = spark.createDataFrame(part, "item_id string, text string")
        got = sorted((r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in D.decontaminate(docs, bench).collect())
        assert got == sorted((i, *brute(t, part)) for i, t in enumerate(TEXTS))
