from __future__ import annotations

import hashlib
import random

import numpy as np

from polytext.llm import suffixes as X


def brute(rows, width=X.WIDTH):
    """Rows (id, text) of distinct ids, in order of the id."""
    seen, out = set(), []
    for i, t in rows:
        b = (t or "").encode()
        mark, own = bytearray(len(b)), set()
        for p in range(len(b) - width + 1):
            w = b[p:p + width]
            if w in seen or w in own:
                mark[p:p + width] = b"\1" * width
            own.add(w)
        seen |= own
        kept = bytes(c for c, m in zip(b, mark) if not m)
        spans = sum(m and not (j and mark[j - 1]) for j, m in enumerate(mark))
        out.append((i, len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return out


def test_random_texts_with_copies_and_passages(spark):
    r = random.Random(1)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randrange(1, 8)))
    passages = [" ".join(word() for _ in range(60)) for _ in range(3)]
    rows = []
    for i in range(120):
        t = " ".join(word() for _ in range(r.randrange(1, 120)))
        for _ in range(r.randrange(3)):
            p, at = r.choice(passages), r.randrange(len(t) + 1)
            t = t[:at] + p[r.randrange(30):len(p) - r.randrange(30)] + t[at:]
        rows.append((i, rows[r.randrange(len(rows))][1] if rows and r.random() < 0.2 else t))
    rows += [(200, "a" * 250), (201, "a" * 120 + "b" * 99), (202, "ab" * 200), (203, "x" * 99), (204, "x" * 100), (205, "x" * 100)]
    shuffled = random.Random(2).sample(rows, len(rows))
    df = spark.createDataFrame(shuffled, "doc_id long, text string").repartition(7)
    assert sorted(map(tuple, X.remove(df, with_text=False).collect())) == brute(rows)


def test_long_texts_are_read_in_pieces(monkeypatch):
    monkeypatch.setattr(X, "PIECE", 512)
    monkeypatch.setattr(X, "_POWERS", [])
    r = random.Random(3)
    raw = bytes(r.choice(b"abc") for _ in range(3000))
    assert sum(len(b) - X.WIDTH + 1 for _, b in X._pieces(raw)) == len(raw) - X.WIDTH + 1
    for start, b in X._pieces(raw):
        _, _, a, first, last = X.anchors(b)
        assert first[0] == 0 and last[-1] == len(b) - X.WIDTH and (first[1:] == last[:-1] + 1).all()
        assert ((first <= a) | (a <= last + X.WIDTH - X.GRAM)).all()


def test_equal_strings_have_equal_anchors():
    r = random.Random(4)
    s = bytes(r.choice(b"abcdefgh ") for _ in range(300))
    where = []
    for pad in (b"", b"zzzz" * 20, bytes(r.choice(b"xyz") for _ in range(777))):
        b = np.frombuffer(pad + s + pad, np.uint8)
        _, _, a, first, last = X.anchors(b)
        owner = np.repeat(a, last - first + 1)
        where.append([int(owner[len(pad) + i]) - len(pad) for i in range(len(s) - X.WIDTH + 1)])
    assert where[0] == where[1] == where[2]


def test_odd_rows(spark, odd_docs, no_docs):
    got = X.remove(odd_docs).collect()
    assert len(got) == odd_docs.count()
    by = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert all(r["n_removed"] == 0 for r in got if not r["n_bytes"] or r["n_bytes"] < 100)
    twice = [r for r in got if r["doc_id"] == 9]
    assert len(twice) == 2 and twice[0] == twice[1] and twice[0]["n_removed"] > 1000
    null = next(r for r in got if r["doc_id"] is None and r["n_bytes"])
    assert null["n_removed"] == null["n_bytes"] and null["kept"] == ""
    assert by[10]["n_bytes"] - by[10]["n_removed"] == 1  # every string but the first starts earlier too
    assert by[1]["n_removed"] == 0 and by[3]["kept"] == ""
    assert X.remove(no_docs).collect() == []


def test_equal_strings_across_the_borders_of_buckets(spark):
    """More buckets than distinct strings: one passage is cut by most borders."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    adaptive = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = [(i, f"{i:03d}" * 20 + "".join(random.Random(9).choice("abcé ") for _ in range(130)) + f"{i:03d}" * 20) for i in range(60)]
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
        assert sorted(map(tuple, X.remove(df, with_text=False).collect())) == brute(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", adaptive)
