"""Benchmark decontamination: one Aho-Corasick automaton over the normalised
windows of all test items, each document scanned once.

Normalised text is the words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after
lower-casing A-Z.  A window is ``width`` consecutive words of an item; an item
of fewer words (but not none) is one window.  A document word inside any
occurrence of a window is hit.  Hits are mapped back to code-point spans of
the original text.

Scale: documents are only scanned (no shuffle).  The item table is measured
first: its windows have at most ``width`` times its bytes, and an automaton at
most one node (32 bytes) for each byte of a window.  Beyond ``block_bytes`` of
windows the table is split into blocks by a hash of the text, each block has its
own automaton and its own scan, and the hits of a document are merged by (id,
hash of text).  So an automaton never grows beyond about 32 * ``block_bytes``.

Edge cases: a null or empty text, or one without words, has no words and no
hits; null or wordless items have no window; an item with a null id marks
words but is not listed; repeated item ids count once; repeated documents get
equal rows; other columns are not read.
"""

from __future__ import annotations

import re
import uuid

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")  # of the original text, so with A-Z
#: Bytes: A-Z to a-z, other ASCII but letters and digits to a space.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))

RUNS = "array<struct<s:int,e:int>>"
HITS = f"n_words long, runs {RUNS}, items array<string>"
SPANS = f"n_hit long, spans {RUNS}"


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8").translate(_TABLE).split()


def windows(ws: list, width: int) -> set[tuple[bytes, int]]:
    """(joined words, number of words) of each window of an item."""
    if not ws:
        return set()
    n = min(width, len(ws))
    return {(b" ".join(ws[i:i + n]), n) for i in range(len(ws) - n + 1)}


def automaton(items: list[tuple[str | None, str | None]], width: int):
    """Automaton over all windows; a value is (words in the window, item ids)."""
    found: dict[str, tuple[int, set]] = {}
    for item, text in items:
        for w, n in windows(words(text), width):
            found.setdefault(f" {w.decode('latin-1')} ", (n, set()))[1].update([] if item is None else [item])
    a = ahocorasick.Automaton()
    for k, v in found.items():
        a.add_word(k, v)
    if found:
        a.make_automaton()
    return a if found else None


def merged(runs) -> list[tuple[int, int]]:
    """Union of half-open intervals, in order."""
    out: list[list[int]] = []
    for s, e in sorted(runs):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def scan_text(text: str | None, a) -> tuple[int, list[tuple[int, int]], list[str]]:
    ws = words(text)
    if a is None or not ws:
        return len(ws), [], []
    line = f" {b' '.join(ws).decode('latin-1')} "
    hits = list(a.iter(line))
    if not hits:
        return len(ws), [], []
    ends = np.cumsum([len(w) + 1 for w in ws])  # index of the space after each word
    last = np.searchsorted(ends, [e for e, _ in hits])
    return len(ws), merged((int(j) - n + 1, int(j) + 1) for j, (_, (n, _)) in zip(last, hits)), sorted(set().union(*(v for _, (_, v) in hits)))


_BUILT: dict = {}


def _scanner(shared, width: int):
    key = uuid.uuid4().hex  # names the item table: a worker may live on to scan with another one

    @F.pandas_udf(HITS)
    def scan(texts: pd.Series) -> pd.DataFrame:
        if key not in _BUILT:  # one automaton at a time in a worker
            _BUILT.clear()
            _BUILT[key] = automaton(shared.value, width)
        rows = [scan_text(t, _BUILT[key]) for t in texts]
        return pd.DataFrame({"n_words": [r[0] for r in rows], "runs": [[{"s": s, "e": e} for s, e in r[1]] for r in rows], "items": [r[2] for r in rows]})

    return scan


def _spans(text: Column, runs: Column) -> Column:
    """Runs of hit words as code-point spans of the original text."""

    @F.pandas_udf(SPANS)
    def project(texts: pd.Series, runs: pd.Series) -> pd.DataFrame:
        n, out = [], []
        for t, rs in zip(texts, runs):
            rs = merged((r["s"], r["e"]) for r in rs) if rs is not None else []
            at = [m.span() for m in WORD.finditer(t)] if rs else []
            n.append(sum(e - s for s, e in rs))
            out.append([{"s": at[s][0], "e": at[e - 1][1]} for s, e in rs])
        return pd.DataFrame({"n_hit": n, "spans": out})

    return project(text, runs)


def _scanners(bench: DataFrame, width: int, block_bytes: int) -> list:
    """A scan for each block of the item table: one, unless it is large."""
    items = bench.select(F.col("item_id").cast("string").alias("item"), "text").where("text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size * width // block_bytes))
    out = []
    for b in range(blocks):
        part = items.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == b) if blocks > 1 else items
        shared = bench.sparkSession.sparkContext.broadcast([tuple(r) for r in part.collect()])  # at most about block_bytes / width
        out.append(_scanner(shared, width))
    return out


def clean(docs: DataFrame, bench: DataFrame, width: int = 10, block_bytes: int = 12 << 20) -> DataFrame:
    """The rows of ``docs``, with all their columns, in which no window occurs."""
    for scan in _scanners(bench, width, block_bytes):
        docs = docs.where(F.size(scan("text")["runs"]) == 0)
    return docs


def decontaminate(docs: DataFrame, bench: DataFrame, width: int = 10, block_bytes: int = 12 << 20) -> DataFrame:
    """``docs`` (doc_id, text) against ``bench`` (item_id, text): doc_id, text,
    n_words, n_hit, items (ids found, sorted as strings), spans of hit words."""
    docs = docs.select("doc_id", "text")
    parts = [docs.withColumn("h", scan("text")) for scan in _scanners(bench, width, block_bytes)]
    if len(parts) == 1:
        hit = parts[0].select("doc_id", "text", "h.*")
    else:
        tie = F.xxhash64("text").alias("tie")
        found = None
        for p in parts:
            p = p.select("doc_id", tie, "h.runs", "h.items").where(F.size("runs") > 0)
            found = p if found is None else found.union(p)
        found = found.groupBy("doc_id", "tie").agg(F.flatten(F.collect_set("runs")).alias("runs"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
        none = _scanner(docs.sparkSession.sparkContext.broadcast([]), width)
        left = docs.withColumn("tie", F.xxhash64("text")).withColumn("n_words", none("text")["n_words"]).alias("d")
        hit = (left.join(found.alias("f"), F.col("d.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("d.tie") == F.col("f.tie")), "left")
               .select("d.doc_id", "d.text", "d.n_words", "f.runs", F.coalesce("f.items", F.array().cast("array<string>")).alias("items")))
    return hit.withColumn("x", _spans("text", "runs")).select("doc_id", "text", "n_words", "x.n_hit", "items", "x.spans")


def digest(found: DataFrame) -> DataFrame:
    """The columns op9 returns."""
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
p AS (SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS g
      FROM (SELECT item, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
g AS (SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS g
      FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM p) WHERE len(w) >= n)),
h AS (SELECT g.r, g.i, p.n, p.item FROM g JOIN p ON g.g = p.g AND g.n = p.n),
c AS (SELECT r, count(DISTINCT i) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS i FROM h) GROUP BY r),
t AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN t USING (r)
"""
