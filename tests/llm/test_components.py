from __future__ import annotations

import random

from polytext.llm.common import components


def test_components_of_paths_stars_and_random_edges(spark):
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(60)] + [(100, 101 + i) for i in range(40)] + [(200 + r.randrange(80), 200 + r.randrange(80)) for _ in range(50)] + [(5, 5)]
    up = {x: x for e in edges for x in e}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        up[top(a)] = top(b)
    got = {x["node"]: x["root"] for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    assert set(got) == nodes
    assert all((got[x] == got[y]) == (top(x) == top(y)) for x in nodes for y in nodes)


def test_no_edges(spark):
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
