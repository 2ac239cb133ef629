from __future__ import annotations

import contextlib
import io
import random

import numpy as np
import pytest

from polytext.llm import jaccard as J
from polytext.llm import minhash as M
from test_jaccard import brute, near_copies


def check(spark, rows, k=2, percent=80):
    got = M.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k, percent).collect()
    assert sorted((tuple(r)[:3] for r in got), key=str) == brute(rows, k, percent)
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in got)


def test_small_groups(spark):
    check(spark, near_copies(1, 12, 5, 150, 9) + [(900 + i, f"short {i % 3}") for i in range(6)])


@pytest.mark.parametrize("group", [8192, 12])
def test_a_large_group_around_the_threshold(spark, monkeypatch, group):
    monkeypatch.setattr(M, "GROUP", group)
    monkeypatch.setattr(M, "HEAD", 4 if group == 12 else 256)
    check(spark, near_copies(2, 1, 90, 140, 18))


def test_a_common_passage_links_nothing(spark):
    r = random.Random(3)
    passage = " ".join(f"p{i}" for i in range(200))
    check(spark, [(i, " ".join(f"u{r.randrange(10**6)}" for _ in range(90)) + " " + passage) for i in range(60)])


def test_many_repeats_of_ids_and_rows(spark):
    rows = near_copies(4, 3, 4, 60, 4)
    rows = [(i % 3, t) for i, t in rows] * 20 + [(7, rows[0][1])] * 30
    check(spark, rows)


def test_odd_rows(spark, odd_docs, no_docs):
    got = sorted((tuple(r)[:3] for r in M.near_duplicates(odd_docs).collect()), key=str)
    assert got == brute([(r[0], r[1]) for r in odd_docs.collect()], 2, 80)
    assert M.near_duplicates(no_docs).collect() == []


def test_slots_match_as_often_as_sets_are_similar():
    r = np.random.default_rng(5)
    got = []
    for _ in range(60):
        both, a, b = (r.integers(0, 1 << 63, n, dtype=np.uint64) for n in (160, 20, 20))
        x, y = (M.slots(np.concatenate([both, z])) for z in (a, b))
        got.append((x == y).mean())
    assert abs(np.mean(got) - 0.8) < 0.015


def test_bounds_prune_few_pairs_at_the_threshold_and_most_far_below():
    r, limits = np.random.default_rng(6), M.bounds(80, 1e-3)
    for j, low, high in ((0.8, 0.99, 1.0), (0.5, 0.0, 0.02)):
        same = r.random((4000, M.BANDS * M.WIDTH)) < j + (1 - j) / 256
        ok = np.ones(4000, bool)
        for n, least in limits:
            ok &= same[:, :n].sum(axis=1) >= least
        assert low <= ok.mean() <= high
    assert all(a <= b for (_, a), (_, b) in zip(M.bounds(80, 1e-9), limits))


def test_survivors_are_what_the_bounds_say():
    r = np.random.default_rng(7)
    base = r.integers(0, 256, M.BANDS * M.WIDTH, dtype=np.uint8)
    sig = np.stack([np.where(r.random(len(base)) < x, base, r.integers(0, 256, len(base), dtype=np.uint8)) for x in r.random(300)], axis=1).astype(np.uint8)
    limits = M.bounds(80)
    same = sig == base[:, None]
    want = [j for j in range(300) if all(same[:n, j].sum() >= least for n, least in limits)]
    at, matches = M.survivors(sig, base, np.arange(300), limits)
    assert at.tolist() == want and matches.tolist() == same[:, want].sum(axis=0).tolist()


def test_parity_never_prunes_a_pair_that_links():
    r = np.random.default_rng(8)
    for _ in range(200):
        base = r.integers(0, 1 << 63, int(r.integers(1, 400)), dtype=np.uint64)
        x, y = (np.unique(np.where(r.random(len(base)) < 0.93, base, r.integers(0, 1 << 63, len(base), dtype=np.uint64))) for _ in "ab")
        both = len(np.intersect1d(x, y))
        if 100 * both >= 80 * (len(x) + len(y) - both):
            assert M.reachable(M.parity(x)[None], M.parity(y)[None], np.array([len(x)]), np.array([len(y)]), 80).all()


def test_wide_sketches_prune_large_sets_and_no_pair_that_links():
    """The sketch of 1,024 cells is full for sets like these and tells none apart."""
    r, apart = np.random.default_rng(9), 0
    for share in (0.99, 0.95, 0.9, 0.85):
        for n in (1, 700, 5000, 9000):
            base = r.integers(0, 1 << 63, n, dtype=np.uint64)
            x = np.unique(base)
            y = np.unique(np.concatenate([np.where(r.random(n) < share, base, r.integers(0, 1 << 63, n, dtype=np.uint64)), r.integers(0, 1 << 63, n // 50, dtype=np.uint64)]))
            both = len(np.intersect1d(x, y))
            links = 100 * both >= 80 * (len(x) + len(y) - both)
            may = J.may_link(J.wide(x), J.wide(y), len(x), len(y), 80)
            assert may or not links
            apart += n >= 5000 and not may and M.reachable(M.parity(x)[None], M.parity(y)[None], np.array([len(x)]), np.array([len(y)]), 80).all()
    assert apart >= 2


def test_a_band_is_walked_again_only_if_a_class_had_more(monkeypatch):
    n, comp = np.full(6, 50), np.arange(6)
    sig, bits = np.zeros((6, M.BANDS * M.WIDTH), np.uint8), np.zeros((6, M.CELLS // 8), np.uint8)
    few, cut = M.nearest(n, comp, sig, bits, None, 80, M.bounds(80), 3)
    assert cut and len(few) < 15
    every, cut = M.nearest(n, comp, sig, bits, None, 80, M.bounds(80), 5)
    assert not cut and len(every) == 15


def test_many_near_copies_take_several_rounds(spark, monkeypatch):
    monkeypatch.setattr(M, "NEAREST", 1)
    rows = near_copies(11, 2, 25, 60, 12)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(r)[:3] for r in M.near_duplicates(df).collect()), key=str) == brute(rows, 2, 80)


def test_lookups_too_large_to_broadcast(spark, monkeypatch):
    """Every lookup by a bit table and a shuffle: copies, odd ids, components."""
    monkeypatch.setattr(M, "LOOKUP", 0)
    monkeypatch.setattr(J, "LOOKUP", 0)
    rows = near_copies(21, 4, 5, 80, 8)
    check(spark, rows + [(500 + i, t) for i, t in rows[:6]] + [(None, rows[0][1]), (800, ""), (801, None), (802, "alone twice"), (803, "ALONE  twice")] + rows[-3:])


def test_signatures_and_sets_are_not_shuffled_for_classes_that_meet_none(spark, monkeypatch):
    """Bands and signatures stay out of the exchange that finds classes and of
    that which picks those that share a band; a pair's row has two numbers."""
    plans, stored = {}, M.stored

    def seen(df, name):
        out = io.StringIO()
        with contextlib.redirect_stdout(out):
            df.explain("formatted")
        plans.setdefault(name, (out.getvalue(), dict(df.dtypes)))
        return stored(df, name)

    monkeypatch.setattr(M, "stored", seen)
    check(spark, near_copies(22, 3, 4, 60, 6) + [(900 + i, f"alone {i}") for i in range(20)])
    for name in ("classes", "met-classes"):
        carried = [b for b in plans[name][0].split("\n\n") if ") Exchange" in b]
        assert all("sig#" not in b and "keys#" not in b for b in carried), name
    assert plans["walked"][1] == {"key": "bigint", "a": "bigint", "b": "bigint"}
    assert plans["shared-bands"][1] == {"key": "bigint", "n": "bigint", "c": "bigint", "lead": "bigint"}
