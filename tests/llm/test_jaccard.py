from __future__ import annotations

import random

import numpy as np
import pandas as pd
import pytest

from polytext.llm import jaccard as J


def brute(rows, k, percent):
    def grams(t):
        ws = (t or "").encode().lower().split()
        n = min(k, len(ws))
        return {tuple(ws[i:i + n]) for i in range(len(ws) - n + 1)} if ws else set()

    sets = [grams(t) for _, t in rows]
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if rows[a][0] is None or rows[b][0] is None or not sets[a] or not sets[b]:
                continue
            both = len(sets[a] & sets[b])
            if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                up[top(a)] = top(b)
    out = []
    for a, (i, _) in enumerate(rows):
        same = [rows[b][0] for b in range(len(rows)) if top(b) == top(a)]
        out.append((i, len(sets[a]), None if i is None else i if not sets[a] else min(same)))
    return sorted(out, key=str)


def check(spark, rows, k, percent):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, J.link(df, k, percent).collect()), key=str) == brute(rows, k, percent)


def near_copies(seed, groups, size, words, edits):
    r = random.Random(seed)
    rows = []
    for _ in range(groups):
        base = [f"v{r.randrange(10**6)}" for _ in range(words)]
        for _ in range(size):
            own = list(base)
            for _ in range(r.randrange(edits)):
                own[r.randrange(words)] = f"e{r.randrange(10**6)}"
            rows.append((len(rows), " ".join(own)))
    return rows


@pytest.mark.parametrize("k,percent", [(3, 90), (5, 80)])
def test_small_groups(spark, k, percent):
    rows = near_copies(1, 12, 5, 150, 7) + [(900 + i, f"short {i % 3}") for i in range(6)]
    check(spark, rows, k, percent)


def test_one_large_group_in_blocks_with_a_second_walk(spark, monkeypatch):
    monkeypatch.setattr(J, "GROUP", 12)
    check(spark, near_copies(2, 1, 90, 140, 9), 3, 90)


def test_a_common_passage_links_nothing(spark):
    r = random.Random(3)
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, " ".join(f"u{r.randrange(10**6)}" for _ in range(120)) + " " + passage) for i in range(60)]
    check(spark, rows, 3, 90)


def test_many_repeats_of_ids(spark, monkeypatch):
    rows = near_copies(5, 2, 3, 120, 4)
    rows = [(i % 2, t) for i, t in rows] * 40
    seen = []
    check_pairs = J._checked
    monkeypatch.setattr(J, "_checked", lambda *a: seen.append(check_pairs(*a)) or seen[-1])
    check(spark, rows, 3, 90)
    assert all(df.count() <= 30 for df in seen)


def test_odd_rows(spark, odd_docs, no_docs):
    got = sorted(map(tuple, J.link(odd_docs).collect()), key=str)
    assert got == brute([(r[0], r[1]) for r in odd_docs.collect()], 3, 90)
    assert J.link(no_docs).collect() == []


def test_walk_keeps_every_pair_that_links():
    import numpy as np

    r = random.Random(4)
    for _ in range(40):
        base = [r.randrange(1 << 60) for _ in range(r.randrange(3, 60))]
        sets = [np.unique(np.array([x if r.random() > 0.06 else r.randrange(1 << 60) for x in base], dtype=np.uint64)) for _ in range(6)]
        first = [s[:J.prefix_length(len(s), 90) + J.DEPTH] for s in sets]
        for a in range(6):
            for b in range(a):
                both = len(np.intersect1d(sets[a], sets[b]))
                if 100 * both < 90 * (len(sets[a]) + len(sets[b]) - both) or (sets[a].tobytes() == sets[b].tobytes()):
                    continue
                token = next(x for x in sets[a] if x in sets[b])
                at = [int(np.flatnonzero(sets[i] == token)[0]) for i in (a, b)]
                assert all(p < J.prefix_length(len(sets[i]), 90) for p, i in zip(at, (a, b)))
                bits = np.stack([np.frombuffer(J.sketch(sets[i]), np.uint8) for i in (a, b)])
                assert J.remaining([len(sets[a]), len(sets[b])], at, [first[i][p + 1:p + 1 + J.DEPTH].tolist() for p, i in zip(at, (a, b))], bits, 90)


@pytest.mark.parametrize("percent", [80, 90])
def test_blocks_by_size_meet_every_pair_that_may_link_once(spark, monkeypatch, percent):
    monkeypatch.setattr(J, "GROUP", 3)
    r = random.Random(5)
    sizes = [1, 1, 2, 8, 9, 10, 64, 72, 80, 81, 90, 100, 512, 640, 729, 800, 810, 900, 1000, 10**6] + [r.randrange(1, 2000) for _ in range(40)] + [100] * 9
    rows = [(1, f"{i:03d}".encode(), n) for i, n in enumerate(sizes)] + [(2, f"{i:03d}".encode(), n) for i, n in enumerate(sizes[:7])] + [(3, b"x", 5), (3, b"y", 6)]
    df = spark.createDataFrame(rows, "token long, c binary, n long")
    met, seen = {}, {}
    for x in J._blocked(df, df, percent).collect():
        seen.setdefault((x["token"], x["i"], x["j"]), []).append((bytes(x["c"]), x["n"], x["own"]))
    for (token, i, j), own in seen.items():
        for a in own:
            for b in own:
                if a[0] < b[0] and (i == j or a[2] != b[2]):
                    met[token, a[0], b[0]] = met.get((token, a[0], b[0]), 0) + 1
    assert set(met.values()) == {1}
    for t, a, n in rows:
        for u, b, m in rows:
            if t == u and a < b and 100 * min(n, m) >= percent * max(n, m):
                assert (t, a, b) in met
    assert not any((1, f"{i:03d}".encode(), f"{j:03d}".encode()) in met for i, j in ((0, 19), (3, 6), (6, 12)))


def test_large_group_of_many_sizes(spark, monkeypatch):
    monkeypatch.setattr(J, "GROUP", 4)
    words = [f"w{i}" for i in range(700)]
    rows = [(i, " ".join(words[:n])) for i, n in enumerate([12, 13, 22, 23, 27, 83, 92, 102, 103, 300, 333, 370, 600, 660, 661, 662, 663, 664, 665, 666, 667])]
    check(spark, rows, 3, 90)


@pytest.mark.parametrize("frame", [7, 1000])
def test_rows_whose_later_n_grams_cannot_link_are_dropped(frame):
    """Sizes alone let them stay: two sets of 100 that first meet at their 16th n-gram share 85 at most."""
    r = np.random.default_rng(3)
    rows = [(1, b"first", 50, 0)] + [(2, b"a", 100, 15), (2, b"b", 100, 15)] + [(3, b"c", 100, 3), (3, b"d", 101, 4)]
    rows += [(t, b"%d" % i, int(r.integers(50, 200)), int(r.integers(0, 30))) for i, t in enumerate(r.integers(4, 40, 150))]
    rows += [(50, b"%d" % i, 90, 17) for i in range(J.NEAR + 5)] + [(60, b"last", 10, 0)]
    p = pd.DataFrame(rows, columns=["token", "c", "n", "pos"]).sort_values(["token", "n", "c"], ignore_index=True)
    got = {(x.token, x.c, x.n, x.pos) for q in J.shared((p.iloc[i:i + frame] for i in range(0, len(p), frame)), 80) for x in q.itertuples()}
    meet = {x for x in rows for y in rows if x != y and x[0] == y[0] and min(x[2] - x[3], y[2] - y[3]) >= J.needed(x[2], y[2], 80)}
    assert got == meet | {x for x in rows if x[0] in (1, 50, 60)}
    assert (2, b"a", 100, 15) not in got and (3, b"c", 100, 3) in got
