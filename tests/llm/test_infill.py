from __future__ import annotations

import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from polytext.llm import infill as I

TEXT = st.text(st.sampled_from(list("abZ .<PSM>é漢😀\n\x00")), max_size=40)


def brute(key, t):
    t = t or ""
    h = hashlib.sha256(f"1:{key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i:8 * i + 8], 16) for i in range(4))
    ws = re.findall(r"[A-Za-z]+|[^A-Za-z]", t)
    n = len(ws)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", t, None, None
    pre, mid, suf = "".join(ws[:a]), "".join(ws[a:b]), "".join(ws[b:])
    if h4 % 100 < 20:
        return n, "spm", f"<S>{suf}<P>{pre}<M>{mid}", len(pre), len(mid)
    return n, "psm", f"<P>{pre}<S>{suf}<M>{mid}", len(pre), len(mid)


@settings(max_examples=300, deadline=None)
@given(st.integers(-5, 10**6), TEXT, st.sampled_from([3, 5, 1 << 20]))
def test_equals_brute_force_at_any_block_size(key, t, block):
    old, I.BLOCK = I.BLOCK, block
    try:
        n, form, out, p, m = I.transform(t.encode(), str(key))
    finally:
        I.BLOCK = old
    assert (n, form, out.decode(), p, m) == brute(key, t)


@settings(max_examples=200, deadline=None)
@given(TEXT)
def test_index_converts_every_cut_both_ways(t):
    data = t.encode()
    index = I.Index(data)
    assert len(index.byte) == sum(ord(c) > 127 for c in t)
    at = 0
    for i, c in enumerate([*t, ""]):
        assert index.points(at) == i and index.bytes(i) == at
        at += len(c.encode())


@given(TEXT, st.integers(0, 999))
def test_char_units(t, key):
    n, form, out, p, m = I.transform(t.encode(), str(key), unit="char")
    assert n == len(t)
    if form == "psm":
        pre, rest = out.decode()[3:].split("<S>", 1)
        suf, mid = rest.split("<M>", 1)
        assert pre + mid + suf == t and (len(pre), len(mid)) == (p, m)


@pytest.mark.parametrize("frame", [10, 8 << 20])
def test_odd_rows(spark, odd_docs, no_docs, monkeypatch, frame):
    monkeypatch.setattr(I, "FRAME", frame)
    extra = spark.createDataFrame([(20, "a <P> b", None, "x", "x", "x", "x"), (21, "é漢😀" * 5, None, "x", "x", "x", "x"), (22, "x\x00<", None, "x", "x", "x", "x")], odd_docs.schema)
    docs = odd_docs.union(extra)
    rows = I.infill(docs)
    got = sorted((tuple(r) for r in rows.collect()), key=str)
    assert got == sorted(((r.doc_id, *brute("" if r.doc_id is None else r.doc_id, r.text)) for r in docs.collect()), key=str)
    back = I.digest(rows).select("doc_id", "restored_sha256").collect()
    want = docs.select("doc_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)).collect()
    assert sorted(map(tuple, back), key=str) == sorted(map(tuple, want), key=str)
    assert I.infill(no_docs).collect() == []


def test_a_very_long_text_over_several_blocks():
    t = ("word é, " * 400_000).encode()
    assert len(t) > 3 * I.BLOCK
    n, form, out, p, m = I.transform(t, "1")
    assert (n, form, out.decode(), p, m) == brute("1", t.decode())
