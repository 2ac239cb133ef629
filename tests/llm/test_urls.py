from __future__ import annotations

import math
from urllib.parse import unquote  # noqa: F401

import xxhash
from pyspark.sql import functions as F

from polytext.llm import urls as U

URLS = [None, "", "no scheme", "http://Example.ORG/es/1?x=1#y", "https://sub.example.org/en/12", "http://example.org", "http://a.com/fr/", "http://b.com/de/x", "x://h?q/p", "x://h#f", "http://éx.net/de/1",
        "http://notexample.org/es/1", "http://org/", "http://EXAMPLE.com/FR/", "a://b://c/d", "://", "http:///path"]


def brute(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    n = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:n])
    rest = rest[n:]
    path = rest[:next((i for i, c in enumerate(rest) if c in "?#"), len(rest))]
    fits = [(len(h + p), h + p, v) for h, p, v in U.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *max(fits)[1:]) if fits else (host, path, None, None)


def grams(host, path, n=3):
    out = []
    for mark, text in (("h", f"^{host}$"), ("p", f"^{path}$")):
        for i in range(max(1, len(text) - n + 1)):
            h = xxhash.xxh64_intdigest(text[i:i + n].encode(), seed=xxhash.xxh64_intdigest(mark.encode(), seed=42))
            out.append((h - (1 << 64) * (h >> 63)) % U.BUCKETS + 1)
    return list(dict.fromkeys(out))


def pages(spark, urls=URLS):
    return spark.createDataFrame([(i, u, "x", "x") for i, u in enumerate(urls)] + [(1, "", "x", "x")], "page_id long, url string, verdict string, score string")


def test_parts_rules_and_buckets(spark):
    rows = {r["page_id"]: r for r in U.judge(pages(spark)).collect()}
    for i, u in enumerate(URLS):
        host, path, rule, verdict = brute(u)
        assert (rows[i]["host"], rows[i]["path"], rows[i]["rule"]) == (host, path, rule), u
        assert rows[i]["verdict"] == (verdict or ("block" if rows[i]["score"] > 0.5 else "allow"))
    host, path = U.parts(F.col("url"))
    for r in pages(spark).select("page_id", U.buckets(host, path).alias("g")).collect():
        assert r["g"] == grams(*brute(URLS[r["page_id"]])[:2])


def test_training_matches_plain_gradient_steps(spark):
    labelled = [("a.com", "/de/x", 1), ("b.com", "/fr/y", 0), ("c.org", "/", 0), ("d.com", "/de/z", 1), ("d.com", "/de/z", 1)]
    w, b = U.train(spark.createDataFrame(labelled, "host string, path string, y int"), steps=4)
    weights, bias = [0.0] * U.BUCKETS, 0.0
    data = [(grams(h, p), y) for h, p, y in labelled]
    for _ in range(4):
        error = [y - 1 / (1 + math.exp(-(bias + sum(weights[g - 1] for g in gs)))) for gs, y in data]
        slope = [0.0] * U.BUCKETS
        for (gs, _), e in zip(data, error):
            for g in gs:
                slope[g - 1] += e / len(gs)
        bias += U.RATE * sum(error) / len(data)
        weights = [x * (1 - U.DECAY) + U.RATE * 32 * s / len(data) for x, s in zip(weights, slope)]
    assert abs(b - bias) < 1e-9 and max(abs(x - y) for x, y in zip(w, weights)) < 1e-9


def test_without_labels_and_rows(spark):
    rows = U.judge(pages(spark, ["http://x.net/a", None])).collect()
    assert {r["verdict"] for r in rows} == {"allow"}
    assert U.judge(pages(spark).limit(0)).collect() == []


def test_plan_is_native(spark):
    plan = U.judge(pages(spark))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
