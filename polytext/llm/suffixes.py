"""Removal of repeated passages by sorted suffixes.

Texts are UTF-8 bytes.  A byte is removed when a ``WIDTH``-byte string that
covers it also starts earlier (in a document with a smaller id, or earlier in
the same one); strings are judged on the input.

Not all suffixes are sorted, but enough to decide every string: each string
has an anchor, its ``GRAM``-byte gram with the smallest hash (the leftmost of
equal ones), which depends on the string alone, so equal strings have equal
anchors at the same place.  About one position in thirty is an anchor.

1. The suffix at each anchor becomes a row: leading bytes with a hash of the
   gram, and a hash of the context, the bytes of all strings of this anchor.
   Rows are range-partitioned at sampled splitters by leading bytes (then
   context, id and place, so that a hot passage is spread too) and sorted
   within each bucket.  A row whose context equals that of the row before it
   is a repeat: all its strings are.
2. The first row of a context is undecided only where its gram has several
   contexts, as at the ends of a passage.  These rows, and the rows at the
   borders of the buckets, give their single strings, which are sorted and
   compared in the same way.  Here the first string of a bucket is compared
   with the last of the bucket before it.
3. The repeats of a document are united and cut out of its text.

Sorting is Spark's (prefix sort with spilling) in place of a hand-written
multikey quicksort: the buckets may exceed memory.

Scale: about a thirtieth of the positions is shuffled; no key gathers in one
task, and the driver only sees two strings for each bucket.  Texts go through
the two joins compressed.

Edge cases: a null or empty text has nothing removed; a text below ``WIDTH``
bytes has no string; rows with equal id and text count as one document and
get equal results, other rows with one id are ordered by a hash of the text;
a null id comes after all others; other columns are not read.  Equality is
that of 64-bit hashes together with leading bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polytext.llm.common import release, ship, stored

WIDTH, GRAM, PIECE = 100, 40, 1 << 20
_BASE = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = []
# ``at`` is a first string start times 256 plus the number of further starts (below WIDTH)
_ROWS = "g long, ctx long, doc long, tie long, at long"
_SEEN = "kind int, doc long, tie long, at long"


def _powers() -> list[np.ndarray]:
    """Powers of the base and of its inverse (mod 2^64)."""
    if not _POWERS:
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(PIECE + 2 * WIDTH + 1, base, np.uint64)
            p[0] = 1
            _POWERS.append(np.multiply.accumulate(p))
    return _POWERS


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Hashes:
    """Hashes of all substrings of up to ``PIECE + 2 * WIDTH`` bytes."""

    def __init__(self, b: np.ndarray):
        power, self.inverse = _powers()
        self.sums = np.zeros(len(b) + 1, np.uint64)
        np.cumsum((b.astype(np.uint64) + np.uint64(1)) * power[:len(b)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.inverse[start])


def _slide(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum over each window of ``width`` values."""
    n, out = 1, x
    while 2 * n <= width:
        out = np.minimum(out[:-n], out[n:])
        n *= 2
    return np.minimum(out[:len(x) - width + 1], out[width - n:width - n + len(x) - width + 1]) if n < width else out


def _leading(b: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(len(at), np.uint64)
    for i in range(n):
        out = (out << np.uint64(8)) | b[at + i]
    return out


def anchors(b: np.ndarray) -> tuple[np.ndarray, ...]:
    """g, ctx, anchor, first and last string start of each anchor of a piece."""
    h = Hashes(b)
    at = np.arange(len(b) - GRAM + 1)
    grams = h.of(at, at + GRAM)
    key = (grams & np.uint64(0xFFFFFFFFFF000000)) | at.astype(np.uint64)
    owner = (_slide(key, WIDTH - GRAM + 1) & np.uint64(0xFFFFFF)).astype(np.int64)  # of the string at each start
    first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
    last = np.append(first[1:], len(owner)) - 1
    a = owner[first]
    g = (_leading(b, a, 4) << np.uint64(32)) | (grams[a] >> np.uint64(32))
    ctx = _mix(h.of(first, last + WIDTH) ^ (((a - first) << 8) | (last - first)).astype(np.uint64))
    return (g ^ np.uint64(1 << 63)).view(np.int64), ctx.view(np.int64), a, first, last


def _pieces(raw: bytes) -> Iterator[tuple[int, np.ndarray]]:
    """Pieces of a text that together hold each string once."""
    b = np.frombuffer(raw, np.uint8)
    for start in range(0, max(0, len(b) - WIDTH + 1), PIECE):
        yield start, b[start:start + PIECE + WIDTH - 1]


def _anchored(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for p in parts:
        got: list[list[np.ndarray]] = []
        size = 0
        for doc, tie, text in zip(p["doc"], p["tie"], p["text"]):
            for start, b in _pieces((text or "").encode("utf-8")):
                g, ctx, _, first, last = anchors(b)
                n = len(g)
                got.append([g, ctx, np.full(n, doc, np.int64), np.full(n, tie, np.int64), (first + start << 8) + last - first])
                size += n
            if size > 200_000:
                yield _frame(got)
                got, size = [], 0
        if got:
            yield _frame(got)


def _frame(got: list[list[np.ndarray]]) -> pd.DataFrame:
    return pd.DataFrame(dict(zip(("g", "ctx", "doc", "tie", "at"), map(np.concatenate, zip(*got)))))


def _repeats(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of sorted rows: kind 0, repeats; kind 1, undecided rows."""
    lead = wait = None  # key of the last row; the last first-row of a context, with its being in an earlier gram
    for p in parts:
        if not len(p):
            continue
        g, ctx = p["g"].to_numpy(), p["ctx"].to_numpy()
        before = (g[:1] ^ 1, ctx[:1]) if lead is None else lead
        same = g == np.append(before[0], g[:-1])
        again = same & (ctx == np.append(before[1], ctx[:-1]))
        rows = p[["doc", "tie", "at"]]
        out = [rows[again].assign(kind=0)]
        heads = rows[~again].assign(same=same[~again])
        if lead is None:  # the first row of a bucket is always undecided
            heads.iloc[0, heads.columns.get_loc("same")] = True
        if wait is not None:
            heads = pd.concat([wait, heads], ignore_index=True)
        if len(heads):
            several = heads["same"].to_numpy(bool)
            undecided = several | np.append(several[1:], True)
            out.append(heads.iloc[:-1][undecided[:-1]].assign(kind=1))
            wait = heads.iloc[-1:]
        lead = g[-1:], ctx[-1:]
        yield pd.concat(out)[["kind", "doc", "tie", "at"]]
    if wait is not None:  # its gram may go on in the next bucket
        yield wait.assign(kind=1)[["kind", "doc", "tie", "at"]]


def _strings(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The single strings of the undecided rows of each document."""
    for p in parts:
        got: list[list[np.ndarray]] = []
        size = 0
        for doc, tie, packed, asked in zip(p["doc"], p["tie"], p["packed"], p["at"]):
            b = np.frombuffer(_unpack(packed), np.uint8)
            at = np.unique(np.concatenate([np.arange(x >> 8, (x >> 8) + (x & 255) + 1) for x in map(int, asked)]))
            for start in range(0, len(b), PIECE):
                own = at[(at >= start) & (at < start + PIECE)] - start
                if len(own):
                    part = b[start:start + PIECE + WIDTH - 1]
                    h, n = Hashes(part).of(own, own + WIDTH), len(own)
                    g = (_leading(part, own, 4) << np.uint64(32)) | (h >> np.uint64(32))
                    got.append([(g ^ np.uint64(1 << 63)).view(np.int64), (h & np.uint64(0xFFFFFFFF)).view(np.int64),
                                np.full(n, doc, np.int64), np.full(n, tie, np.int64), own + start << 8])
                    size += n
            if size > 200_000:
                yield _frame(got)
                got, size = [], 0
        if got:
            yield _frame(got)


def _repeated_strings(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of sorted strings: the repeats as byte spans; and for each bucket its
    first and last string, whose part is the bucket's number."""
    lead = first = None
    for p in parts:
        if not len(p):
            continue
        g, h = p["g"].to_numpy(), p["ctx"].to_numpy()
        if lead is None:
            first, lead = p.iloc[:1], (g[:1] ^ 1, h[:1])
        again = (g == np.append(lead[0], g[:-1])) & (h == np.append(lead[1], h[:-1]))
        lead, end = (g[-1:], h[-1:]), p.iloc[-1:]
        rows = p[again]
        yield pd.DataFrame({"part": -1, "g": 0, "ctx": 0, "end": False, "doc": rows["doc"], "tie": rows["tie"], "at": rows["at"]})
    if first is not None:
        for row, is_end in ((first, False), (end, True)):
            yield row[["g", "ctx", "doc", "tie", "at"]].assign(part=TaskContext.get().partitionId(), end=is_end)[["part", "g", "ctx", "end", "doc", "tie", "at"]]


def _sorted(rows: DataFrame) -> DataFrame:
    order = ["g", "ctx", "doc", "tie", "at"]
    parts = max(2, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)


def _packed(text: str) -> Column:
    """A text column as compressed UTF-8 bytes; null where it is empty."""

    @F.pandas_udf("binary")
    def run(texts: pd.Series) -> pd.Series:
        c = zstandard.ZstdCompressor(level=3)
        return pd.Series([c.compress(t.encode("utf-8")) if t else None for t in texts], dtype=object)

    return run(text)


def _unpack(packed: bytes | None) -> bytes:
    return zstandard.ZstdDecompressor().decompress(packed) if packed else b""


def repeats(docs: DataFrame) -> DataFrame:
    """doc, tie, at: what to remove of ``docs`` (doc, tie, text), of which no
    two have the same doc and tie: from the string start at // 256 the strings
    of 1 + at % 256 starts."""
    spark = docs.sparkSession
    seen = stored(_sorted(docs.mapInPandas(_anchored, _ROWS)).mapInPandas(_repeats, _SEEN), "suffixes")
    asked = seen.where("kind = 1").groupBy("doc", "tie").agg(F.collect_list("at").alias("at"))
    strings = (docs.select("doc", "tie", _packed("text").alias("packed")).join(asked, ["doc", "tie"])
               .select("doc", "tie", "packed", "at").mapInPandas(_strings, _ROWS))
    found = stored(_sorted(strings).mapInPandas(_repeated_strings, "part int, g long, ctx long, end boolean, doc long, tie long, at long"), "strings")
    borders = sorted(found.where("part >= 0").collect(), key=lambda r: (r["part"], r["end"]))  # two rows for each bucket
    crossing = [(b["doc"], b["tie"], b["at"]) for a, b in zip(borders[1::2], borders[2::2]) if (a["g"], a["ctx"]) == (b["g"], b["ctx"])]
    release(spark)
    return (seen.where("kind = 0").select("doc", "tie", "at")
            .union(found.where("part < 0").select("doc", "tie", "at"))
            .union(spark.createDataFrame(crossing, "doc long, tie long, at long")))


def _mask(n: int, at) -> np.ndarray:
    """True for the bytes to remove."""
    edge = np.zeros(n + 1, np.int64)
    if at is not None:
        at = np.asarray(at, np.int64)
        np.add.at(edge, at >> 8, 1)
        np.add.at(edge, (at >> 8) + (at & 255) + WIDTH, -1)
    return np.cumsum(edge[:-1]) > 0


def _cutter(with_text: bool):
    def cut(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            out = []
            for packed, at in zip(p["packed"], p["at"]):
                raw = _unpack(packed)
                gone = _mask(len(raw), at)
                spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
                kept = np.frombuffer(raw, np.uint8)[~gone].tobytes() if spans else raw
                out.append((len(raw), len(raw) - len(kept), spans, hashlib.sha256(kept).hexdigest(), *[kept.decode("utf-8", "ignore")] * with_text))
            yield pd.concat([p["id"].reset_index(drop=True), pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * with_text])], axis=1)

    return cut


def remove(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row of ``docs``
    (doc_id, text), and ``kept``: the remaining text, in which characters cut
    by a removed span are left out."""
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("string").alias("id"), F.coalesce("doc_id", F.lit(2**63 - 1)).alias("doc"), "doc_id", "text")
    odd = not docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").isEmpty()
    rows = rows.withColumn("tie", F.xxhash64("text") if odd else F.lit(0).cast("long"))
    plain = rows.select("doc", "tie", "text")
    found = repeats(plain.dropDuplicates(["doc", "tie"]) if odd else plain)
    spans = found.groupBy("doc", "tie").agg(F.collect_list("at").alias("at"))
    out = (rows.select("id", "doc", "tie", _packed("text").alias("packed")).join(spans, ["doc", "tie"], "left").select("id", "packed", "at")
           .mapInPandas(_cutter(with_text), "id string, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept string" * with_text))
    return out.select(F.col("id").cast("long").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * with_text)
