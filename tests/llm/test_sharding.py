from __future__ import annotations

import hashlib
from collections import Counter

import pytest

from polytext.llm import sharding as S


def brute(shards, size):
    num = lambda s: int(hashlib.md5(s.encode()).hexdigest()[:15], 16)
    wish = [[(num("offset|" + s) % size + j * (num("skip|" + s) % (size - 1) + 1)) % size for j in range(size)] for s in shards]
    table, turn = {}, 0
    while len(table) < size:
        slot = next(x for x in wish[turn % len(shards)] if x not in table)
        table[slot] = turn % len(shards)
        turn += 1
    return [table[i] for i in range(size)]


def test_fill_matches_turns_taken_by_preference():
    for n, size in ((1, 2), (3, 7), (5, 101), (16, 211)):
        assert S.fill(S.names(n), size) == brute(S.names(n), size)


def test_loads_are_even_and_a_lost_shard_moves_few_rows():
    full = S.fill(S.names(16), 2039)
    loads = Counter(full).values()
    assert max(loads) - min(loads) <= 1
    names = S.names(16)
    fewer = S.fill(names[:-1], 2039)
    kept = [names[a] == names[:-1][b] for a, b in zip(full, fewer) if a != 15]
    assert sum(kept) / len(kept) > 0.8


def test_bad_tables_are_refused():
    for shards, size in (([], 7), (["a", "a"], 7), (["a"], 9), (["a"] , S.MOST + 1)):
        with pytest.raises(ValueError):
            S.fill(shards, size)


def test_place_odd_rows(spark, odd_docs, no_docs):
    rows = S.place(odd_docs, "doc_id", S.names(4), 101).collect()
    assert len(rows) == odd_docs.count() and all(r["shard"] for r in rows)
    assert len({r["slot"] for r in rows if r["doc_id"] is None}) == 1
    want = int(hashlib.md5(b"12").hexdigest()[:15], 16) % 101
    assert {r["slot"] for r in rows if r["doc_id"] == 12} == {want}
    assert S.place(no_docs, "doc_id", S.names(4), 101).count() == 0
