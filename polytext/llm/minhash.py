"""Near duplicates by MinHash with sequential Bayesian verification.

A document's set holds its distinct word n-grams (64-bit hashes); two documents
link when ``100 * intersection >= percent * union``.  Documents with equal sets
form a class, which is compared once.

1. Signatures: ``BANDS * WIDTH`` slots, each the least value of the set under
   one of as many random linear functions; of a slot 8 bits are kept.
2. Candidates are classes that share a band (all ``WIDTH`` slots of it) and
   whose sizes may link.  A pair at the threshold shares none with probability
   (1 - t^WIDTH)^BANDS, 1.3e-7 at t = 0.8; below it, see 3.
3. Verification: signatures are compared ``BATCH`` slots at a time.  With a
   uniform prior of the similarity, a pair is pruned as soon as the posterior
   probability that it reaches the threshold falls below ``MISS``; then by a
   parity sketch (``CELLS`` bits), whose Hamming distance is a lower bound of the
   symmetric difference and so prunes no pair that links.
4. Every survivor is checked exactly on whole sets, but for those that a parity
   sketch as wide as the set asks for (a sixteenth of its bytes) tells apart.

Which survivors are checked first: each class with the class of a similar size
that leads most of its bands; then, in ``ROUNDS`` rounds, each with its
``NEAREST`` candidates by matches that lie in other components; then all that
are still in different components.  Pairs inside a component need no check, so
a large group of similar texts costs few checks, and none that could join two
components is left out.  A band of which a round took every survivor has none
left to check, so later rounds read only the bands where a class had more.

Scale: a class goes by the number of its first row (the smallest doc_id's), and
only digests, ids and numbers are shuffled to find it: signatures and bands stay
with their rows.  Texts, signatures and sets are shuffled only for classes that a
later step asks for (``sparse_join``); rows
of a band that nobody shares leave first; a band with over ``GROUP`` classes is
split into blocks, whose pairs go to separate tasks; the set of a class that
meets many others is sent once for each ``HEAD`` of them; components are found
by contraction in written tables.  Bands, rounds and blocks cover all rows.

Edge cases: a null or empty text, or one without words, has an empty set and is
linked with nothing; a text with fewer words than n has its whole sequence as
one n-gram; a null doc_id is linked with nothing, its component is null and it
is kept; rows that repeat a doc_id are texts of one id; repeated rows are one
class; other columns are not read; an empty table gives an empty one.  Sets
are compared by 64-bit hashes and classes by 128-bit digests.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polytext.llm.common import components, discard, release, ship, stored
from polytext.llm.jaccard import both_ends, digest, narrowed, shingles, wide
from polytext.operators.joins import lookup_join, sparse_join

BANDS, WIDTH, BATCH, MISS, CELLS = 40, 5, 40, 1e-5, 1024
GROUP, HEAD, NEAREST, ROUNDS, LOOKUP = 8192, 256, 3, 2, 8 << 20
_RNG = np.random.default_rng(12)
_MUL = (_RNG.integers(0, 1 << 31, (BANDS * WIDTH, 1), np.uint32) << np.uint32(1)) | np.uint32(1)
_ADD = _RNG.integers(0, 1 << 32, (BANDS * WIDTH, 1), np.uint32)


def slots(s: np.ndarray) -> np.ndarray:
    """Least value of a set under each function."""
    x = (s >> np.uint64(32)).astype(np.uint32)
    out = np.full(BANDS * WIDTH, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 256):
        v = _MUL * x[None, i:i + 256]
        v += _ADD
        np.minimum(out, v.min(axis=1), out=out)
    return out


def bands(v: np.ndarray) -> np.ndarray:
    """A 64-bit key of each band."""
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for x in v.reshape(BANDS, WIDTH).T.astype(np.uint64):
        key = (key ^ key >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15) + x
    return (key ^ key >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)


def short(v: np.ndarray) -> np.ndarray:
    """8 bits of each slot."""
    return ((v * np.uint32(0x85EBCA6B)) >> np.uint32(24)).astype(np.uint8)


def parity(s: np.ndarray) -> np.ndarray:
    """Parity of the number of hashes in each cell."""
    return np.packbits(np.bincount((s >> np.uint64(20)).astype(np.int64) % CELLS, minlength=CELLS).astype(np.uint8) & 1)


def reachable(x: np.ndarray, y: np.ndarray, n, m, percent: int) -> np.ndarray:
    """Which pairs of sets (rows of parities, sizes n and m) may still link."""
    apart = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
    return (n + m - apart) // 2 >= -(-percent * (n + m) // (100 + percent))


def bounds(percent: int, miss: float = MISS) -> list[tuple[int, int]]:
    """(slots compared, least matches to go on) after each batch: the least with
    a posterior probability of ``miss`` or more that the similarity reaches the
    threshold.  Two slots of different values match by chance in 1 of 256."""
    j = (np.arange(4000) + 0.5) / 4000
    p = j + (1 - j) / 256
    reach = j >= percent / 100
    out = []
    for n in range(BATCH, BANDS * WIDTH + 1, BATCH):
        k = np.arange(n + 1)[:, None]
        like = k * np.log(p) + (n - k) * np.log1p(-p)
        like = np.exp(like - like.max(axis=1, keepdims=True))
        chance = like[:, reach].sum(axis=1) / like.sum(axis=1)
        out.append((n, int(np.argmax(chance >= miss))))
    return out


def survivors(sig: np.ndarray, own: np.ndarray, at: np.ndarray, limits: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Of the columns ``at`` of ``sig`` (slots, classes) those that are not
    pruned against the signature ``own``, and their matches."""
    matches, done = np.zeros(len(at), np.int64), 0
    for n, least in limits:
        if not len(at):
            break
        same = sig[done:n, at] == own[done:n, None]
        matches = matches + same.view(np.uint8).sum(axis=0, dtype=np.uint8)
        keep = matches >= least
        at, matches, done = at[keep], matches[keep], n
    return at, matches


def nearest(n: np.ndarray, comp: np.ndarray, sig: np.ndarray, bits: np.ndarray, side: np.ndarray | None, percent: int, limits: list[tuple[int, int]], most: int | None) -> tuple[list[tuple[int, int]], bool]:
    """Pairs (i, j) of a band's classes in different components that survive;
    with ``most`` only the best of each i, and whether some had more.  The
    largest component's classes are met from the others' side."""
    order = np.argsort(n, kind="stable")
    n, comp, sig, bits = n[order], comp[order], np.ascontiguousarray(sig[order].T), bits[order]
    side = None if side is None else side[order]
    ids, count = np.unique(comp, return_counts=True)
    main = comp == ids[count.argmax()] if count.max() > 1 else np.zeros(len(n), bool)
    out, cut = [], False
    for i in np.flatnonzero(~main):
        first, end = np.searchsorted(n, -(-percent * n[i] // 100)), np.searchsorted(n, 100 * n[i] // percent, "right")
        at = np.arange(first, end)
        keep = (comp[at] != comp[i]) & (main[at] | (at < i))
        if side is not None:
            keep &= side[at] != side[i]
        at, matches = survivors(sig, sig[:, i], at[keep], limits)
        keep = reachable(bits[at], bits[i], n[at], n[i], percent)
        at, matches = at[keep], matches[keep]
        if most is not None and len(at) > most:
            at, cut = at[np.argsort(-matches, kind="stable")[:most]], True
        out += [(int(order[i]), int(order[j])) for j in at]
    return out, cut


def shared(rows: DataFrame, parts: int, percent: int) -> DataFrame:
    """Rows (key, n, c) of bands that a class of a similar size shares, with the
    class that leads (the smallest set that may link).  Rows are sorted by size
    over range partitions, so a row's neighbours are the nearest in size; the
    first and the last of a partition stay, as their neighbours aren't seen."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, size, lead, held = None, 0, None, None  # leader of the last row; held: the last row, and whether it stays
        for p in chain(parts, [None]):
            out = []
            if p is None:
                out += [] if held is None else [held[0]]
            else:
                for k, n, c in zip(p["key"].tolist(), p["n"].tolist(), p["c"].tolist()):
                    near = held is not None and held[0][0] == k and 100 * held[0][1] >= percent * n
                    if held is not None and (held[1] or near):
                        out.append(held[0])
                    first = held is None
                    if k != key or 100 * size < percent * n:
                        key, size, lead = k, n, c
                    held = (k, n, c, lead), first or near
            if out:
                yield pd.DataFrame(out, columns=["key", "n", "c", "lead"])

    return rows.repartitionByRange(parts, "key", "n", "c").sortWithinPartitions("key", "n", "c").mapInPandas(run, "key long, n long, c long, lead long")


def pruned(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes that survive the comparison of signatures."""
    limits = bounds(percent)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            if len(p):
                x, y = (np.frombuffer(b"".join(p[s]), np.uint8).reshape(len(p), -1) for s in ("x", "y"))
                ok, matches, done = np.ones(len(p), bool), np.zeros(len(p), np.int64), 0
                for n, least in limits:
                    matches += (x[:, done:n] == y[:, done:n]).sum(axis=1)
                    ok &= matches >= least
                    done = n
                ok &= reachable(x[:, done:], y[:, done:], p["n"].to_numpy(), p["m"].to_numpy(), percent)
                yield p.loc[ok, ["a", "b"]]

    return both_ends(pairs, classes, "sig").mapInPandas(run, "a long, b long")


def linked(pairs: DataFrame, whole: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that link, by their whole sets.  A set ``a`` is sent once
    for each ``HEAD`` of its partners, which follow it in a sorted stream."""
    pairs = stored(narrowed(pairs, whole, percent), "narrowed")
    of = pairs.groupBy("a").agg(F.ceil(F.count("*") / HEAD).cast("int").alias("heads"))
    cut = lookup_join(pairs, of, ["a"], salt_by=F.col("b"), max_broadcast_bytes=LOOKUP).select("a", "b", F.pmod(F.xxhash64("b"), F.col("heads")).cast("int").alias("part"))
    sends = cut.select("a", "part", F.col("b").alias("c"), F.lit(1).alias("tail"))
    sends = stored(sends.union(of.select("a", F.explode(F.sequence(F.lit(0), F.col("heads") - 1)).alias("part"), F.col("a").alias("c"), F.lit(0))), "sends")
    rows = sparse_join(whole.select("c", "s"), sends, ["c"], max_broadcast_bytes=LOOKUP)

    def check(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        head = np.empty(0, np.uint64)
        for p in parts:
            ok = []
            for a, b, tail, s in zip(p["a"], p["c"], p["tail"], p["s"]):
                s = np.frombuffer(s, np.uint64)
                if not tail:
                    head = s
                    continue
                both = len(np.intersect1d(head, s, assume_unique=True))
                if 100 * both >= percent * (len(head) + len(s) - both):
                    ok.append((a, b))
            if ok:
                yield pd.DataFrame(ok, columns=["a", "b"])

    return rows.repartition("a", "part").sortWithinPartitions("a", "part", "tail").mapInPandas(check, "a long, b long")


def crossing(rows: DataFrame, classes: DataFrame, found: DataFrame, percent: int, most: int | None) -> DataFrame:
    """Pairs (a, b) of classes that share a band, lie in different components
    and survive; with ``most`` the nearest of each class in a band.  A row
    with a key and no pair marks a band in which some class had more; stored."""
    limits = bounds(percent)
    roots = found.select(F.col("node").alias("c"), F.col("root").alias("comp"))
    rows = lookup_join(rows.select("key", "n", "c"), roots, ["c"], "left", max_broadcast_bytes=LOOKUP, salts=1).withColumn("comp", F.coalesce("comp", "c"))  # a class has few rows
    mixed = rows.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count("*").alias("count")).where("x <> y")
    mixed = stored(mixed.select("key", F.ceil(F.col("count") / GROUP).cast("int").alias("blocks")), "mixed-bands")
    rows = stored(lookup_join(rows, mixed, ["key"], salt_by=F.col("c"), max_broadcast_bytes=LOOKUP), "mixed-rows")
    rows = sparse_join(classes.select("c", "sig"), rows, ["c"], max_broadcast_bytes=LOOKUP)
    rows = rows.withColumn("own", F.pmod(F.xxhash64("c", "key"), F.col("blocks")).cast("int")).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("key", "c", "n", "comp", "sig", "own", F.least("own", "x").alias("i"), F.greatest("own", "x").alias("j"))

    def walk(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def done(p: pd.DataFrame) -> list[tuple]:
            side = p["own"].to_numpy() if p["i"].iloc[0] != p["j"].iloc[0] else None
            sig = np.frombuffer(b"".join(p["sig"]), np.uint8).reshape(len(p), -1)
            c = p["c"].tolist()
            got, cut = nearest(p["n"].to_numpy(), p["comp"].to_numpy(), sig[:, :BANDS * WIDTH], sig[:, BANDS * WIDTH:], side, percent, limits, most)
            return [(None, min(c[x], c[y]), max(c[x], c[y])) for x, y in got] + [(int(p["key"].iloc[0]), None, None)] * cut

        left: list[pd.DataFrame] = []
        for p in chain(parts, [None]):  # a band's block may span several frames
            if p is not None:
                left.append(p)
                if len(p) == 0 or all((p[x].iloc[-1] == left[0][x].iloc[0]) for x in ("key", "i", "j") if len(left[0])):
                    continue
            rows = pd.concat(left, ignore_index=True) if left else None
            if rows is None or not len(rows):
                continue
            new = np.zeros(len(rows), bool)
            for x in ("key", "i", "j"):
                v = rows[x].to_numpy()
                new[1:] |= v[1:] != v[:-1]
            starts = [0, *np.flatnonzero(new).tolist(), *[len(rows)] * (p is None)]
            got = [x for s, e in zip(starts, starts[1:]) if e - s > 1 for x in done(rows.iloc[s:e])]
            left = [rows.iloc[starts[-1]:]]
            for i in range(0, len(got), 100_000):
                yield pd.DataFrame({n: pd.array([x[d] for x in got[i:i + 100_000]], "Int64") for d, n in enumerate(("key", "a", "b"))})

    return stored(rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInPandas(walk, "key long, a long, b long").distinct(), "walked")


def near_duplicates(docs: DataFrame, k: int = 2, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links), kept
    of every row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("t"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def measured(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            c, n, key, sig = [], [], [], []
            for text in p["text"]:
                s = shingles(text, k)
                v = slots(s)
                c.append(digest(s)), n.append(len(s)), key.append(bands(v).view(np.int64)), sig.append(short(v).tobytes() + parity(s).tobytes())
            yield pd.DataFrame({"doc_id": p["doc_id"], "t": p["t"], "c": c, "n": n, "keys": key, "sig": sig})

    own = stored(docs.mapInPandas(measured, f"doc_id {kind}, t long, c binary, n long, keys array<long>, sig binary").withColumn("row", F.monotonically_increasing_id()), "signatures")
    some = own.where("n > 0 and doc_id is not null")
    classes = stored(some.groupBy("c").agg(F.min(F.struct("doc_id", "t", "row")).alias("rep"), F.count("*").alias("rows")).select(
        F.col("rep.row").alias("c"), F.col("c").alias("digest"), F.col("rep.doc_id").alias("rep"), (F.col("rows") > 1).alias("copied")), "classes")
    copied = classes.where("copied").select(F.col("digest").alias("c"), F.col("c").alias("first"))
    copies = stored(lookup_join(some.select("c", "row"), copied, ["c"], salt_by=F.col("row"), max_broadcast_bytes=LOOKUP).where("row <> first").select(F.col("row").alias("c")), "copies")
    firsts = sparse_join(some.select(F.col("row").alias("c"), "n", "keys"), copies, ["c"], "left_anti", LOOKUP)
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = stored(shared(firsts.select(F.explode("keys").alias("key"), "n", "c"), parts, percent), "shared-bands")

    meet = stored(rows.select("c").distinct(), "meeting")
    met = stored(sparse_join(own.select(F.col("row").alias("c"), "doc_id", "t", "n", "sig"), meet, ["c"], max_broadcast_bytes=LOOKUP), "met-classes")  # only these are compared
    ids = stored(own.select("doc_id", "n", F.col("c").alias("digest")), "ids")
    discard(own, copies, meet)

    def sets(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in frames:
            for i in range(0, len(p), 256):
                x = p.iloc[i:i + 256]
                own = [shingles(text, k) for text in x["text"]]
                yield pd.DataFrame({"c": x["c"], "n": [len(s) for s in own], "s": [s.tobytes() for s in own], "w": [wide(s) for s in own]})

    whole = stored(sparse_join(docs, met.select("doc_id", "t", "c"), ["doc_id", "t"], max_broadcast_bytes=LOOKUP).select("c", "text").mapInPandas(sets, "c long, n long, s binary, w binary"), "whole-sets")
    if not whole.groupBy("c").count().where("count > 1").isEmpty():  # rows that repeat an id and its text
        whole = stored(whole.dropDuplicates(["c"]), "whole-sets")

    led = rows.where("lead <> c").groupBy("c", "lead").count().groupBy("c").agg(F.max(F.struct("count", "lead")).alias("m"))
    led = stored(led.select(F.least("c", "m.lead").alias("a"), F.greatest("c", "m.lead").alias("b")).distinct(), "led")
    tested = stored(pruned(led, met, percent), "pairs")
    links = stored(linked(tested, whole, percent), "links")
    found = stored(components(links), "components")
    for most in [*[NEAREST] * ROUNDS, None]:
        walked = crossing(rows, met, found, percent, most)
        more = stored(walked.where("a is not null").select("a", "b").join(tested, ["a", "b"], "left_anti"), "pairs")
        tested = tested.union(more)
        new = stored(linked(more, whole, percent), "links") if not more.isEmpty() else more
        if not new.isEmpty():
            links = links.union(new)
            found = stored(components(links), "components")
        left = walked.where("key is not null").select("key").distinct()
        if left.isEmpty():  # every survivor was checked
            break
        before, rows = rows, stored(lookup_join(rows, left, ["key"], "left_semi", salt_by=F.col("c"), max_broadcast_bytes=LOOKUP), "open-bands")
        discard(before)

    found = found.select(F.col("node").alias("c"), "root")
    inside = stored(sparse_join(classes, found, ["c"], max_broadcast_bytes=LOOKUP), "in-components")
    least = stored(inside.groupBy("root").agg(F.min("rep").alias("component_id")), "component-ids")
    alone = sparse_join(classes.where("copied"), found.select("c"), ["c"], "left_anti", LOOKUP)  # of the rest a class of one row is its own component
    named = stored(inside.join(least, "root").select("digest", "component_id").union(alone.select("digest", "rep")), "class-ids")
    discard(rows, met, whole, classes, inside, least)
    release(spark)
    out = lookup_join(ids, named, ["digest"], "left", salt_by=F.col("doc_id"), max_broadcast_bytes=LOOKUP)
    component = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
