"""N-gram Jaccard join by prefix trees.

A document's set holds its distinct word n-grams (64-bit hashes); two texts
link when ``100 * intersection >= percent * union``.  Documents with equal
sets form a class, which is joined once.

1. A global order: n-grams are counted by bucket (``BUCKETS`` numbers, over all
   documents); rare buckets come first, then the hash.
2. Two sets that link share an n-gram among the first ``n - ceil(t n) + 1`` of
   each (n: set size, t: threshold).  A row for each of these goes to the
   n-gram's group; rows without a partner that may link, by the sizes and the
   n-grams left behind this one, are dropped.
3. In a group, each set's further n-grams (``DEPTH`` at most) are put into a
   trie, smaller sets first.  A set is matched by walking the trie: sets below
   a node share the overlap counted so far, and a subtree is left out when the
   overlap and the remaining lengths cannot reach what a link needs.  At the
   leaves, the Hamming distance of two parity sketches, a lower bound of the
   symmetric difference, leaves out most of the rest.
4. What remains is checked exactly on whole sets, which are shuffled once, from
   the task that reads the text to a set it is compared with.  Where a group has many more
   remaining pairs than sets, only a spanning forest of them is checked first;
   then the group is walked again, and the pairs that still lie in different
   components are checked too.  So a large group of similar texts costs few
   checks, and no link between components is missed.

Scale: texts are not shuffled, but for those of remaining pairs; a group with
over ``GROUP`` rows is split into blocks, by set size where it is large, and
pairs of blocks whose sizes may link go to separate tasks; components are found by contraction in written tables.  The order is a
broadcast of ``BUCKETS`` counts.

Edge cases: a null or empty text, or one without words, has an empty set and
is linked with nothing; a text with fewer words than n has its whole sequence
as one n-gram; a null doc_id is linked with nothing and its component is null;
rows that repeat a doc_id are treated as texts of one id; other columns are
not read.  Sets are compared by 64-bit hashes of their n-grams and classes by
128-bit digests.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from polytext.llm.common import components, discard, release, ship, stored
from polytext.operators.joins import sparse_join

BUCKETS, BLOCK, DEPTH, GROUP, SKETCH, HEAD, BROADCAST_IDS, NEAR, LOOKUP = 1 << 20, 1 << 12, 8, 512, 512, 512, 200_000, 64, 8 << 20
_WORDS: dict[bytes, int] = {}
_KEY = "c binary, n long"


def _word(w: bytes) -> int:
    if len(_WORDS) > 100_000:
        _WORDS.clear()
    got = _WORDS[w] = int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little")
    return got


def shingles(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of the word n-grams of a text, A-Z lower-cased,
    words apart at ASCII white space."""
    ws = (text or "").encode("utf-8").lower().split()
    if not ws:
        return np.empty(0, np.uint64)
    get = _WORDS.get
    h = np.fromiter((x if (x := get(w)) is not None else _word(w) for w in ws), np.uint64, len(ws))
    n = min(k, len(h))
    out = h[:len(h) - n + 1].copy()
    out += np.uint64(n)
    for j in range(1, n):
        out ^= out >> np.uint64(31)
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += h[j:len(h) - n + 1 + j]
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    return np.unique(out)


def digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def sketch(s: np.ndarray) -> bytes:
    """Parity of the hashes in each of ``SKETCH`` cells."""
    return np.packbits(np.bincount((s >> np.uint64(40)).astype(np.int64) % SKETCH, minlength=SKETCH).astype(np.uint8) & 1).tobytes()


def wide(s: np.ndarray) -> bytes:
    """Parity of the hashes in each of so many cells (a power of two, 4 to 8 for
    each hash, 512 at least) that even large sets which don't link are told apart."""
    cells = 1 << max(9, (4 * len(s) - 1).bit_length())
    return np.packbits(np.bincount((s >> np.uint64(20)).astype(np.int64) & (cells - 1), minlength=cells).astype(np.uint8) & 1).tobytes()


def may_link(x: bytes, y: bytes, n: int, m: int, percent: int) -> bool:
    """False only for sets that don't link, by their ``wide`` sketches and sizes;
    the sketch with more cells is folded to the size of the other."""
    if len(x) < len(y):
        x, y = y, x
    a = np.frombuffer(x, np.uint8)
    while len(a) > len(y):
        a = a[:len(a) // 2] ^ a[len(a) // 2:]
    apart = int(np.bitwise_count(a ^ np.frombuffer(y, np.uint8)).sum(dtype=np.int64))
    return (n + m - apart) // 2 >= needed(n, m, percent)


def both_ends(pairs: DataFrame, classes: DataFrame, column: str) -> DataFrame:
    """The pairs (a, b) with the size and ``column`` of both classes (n and x, m and
    y); rows of ``classes`` that no pair asks for are not shuffled."""
    of = [classes.select(F.col("c").alias(c), F.col(column).alias(x), F.col("n").alias(n)) for c, x, n in (("a", "x", "n"), ("b", "y", "m"))]
    first = sparse_join(of[0], pairs, ["a"], max_broadcast_bytes=LOOKUP)
    return first.join(sparse_join(of[1], pairs.select("b").distinct(), ["b"], "left_semi", LOOKUP), "b").select("a", "b", "x", "y", "n", "m")


def narrowed(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that the sketches (c, n, w) don't tell apart."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            ok = [may_link(*r, percent) for r in zip(p["x"], p["y"], p["n"].tolist(), p["m"].tolist())]
            yield p.loc[np.array(ok, bool), ["a", "b"]]

    return both_ends(pairs, sketches, "w").mapInPandas(run, pairs.select("a", "b").schema)


def needed(a: int, b: int, percent: int) -> int:
    """Least intersection with which sets of these sizes link."""
    return -(-percent * (a + b) // (100 + percent))


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1 if n else 0


def bucket_counts(docs: DataFrame, k: int) -> np.ndarray:
    """Rows with an n-gram of each bucket, over all documents.  A task sends
    its counts as blocks of ``BLOCK`` numbers, which are added up as they
    arrive; the driver gets ``BUCKETS`` numbers in all."""
    def counted(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(BUCKETS, np.int64)
        for p in parts:
            for i in range(0, len(p), 64):
                own = np.concatenate([shingles(t, k) for t in p["text"].iloc[i:i + 64]])
                np.add.at(total, (own % np.uint64(BUCKETS)).astype(np.int64), 1)
        if total.any():
            yield pd.DataFrame({"block": np.arange(BUCKETS // BLOCK), "n": [x.tobytes() for x in total.reshape(-1, BLOCK)]})

    def added(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for p in parts:
            for b, n in zip(p["block"], p["n"]):
                total[b] = total.get(b, 0) + np.frombuffer(n, np.int64)
        if total:
            yield pd.DataFrame({"block": list(total), "n": [x.tobytes() for x in total.values()]})

    rows = docs.select("text").mapInPandas(counted, "block int, n binary").repartition("block").mapInPandas(added, "block int, n binary").collect()
    out = np.zeros((BUCKETS // BLOCK, BLOCK), np.int64)
    for b, n in rows:
        out[b] = np.frombuffer(n, np.int64)
    return out.reshape(-1).astype(np.uint32 if out.max() < 1 << 32 else np.int64)


def _signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


class _Node:
    __slots__ = ("below", "least", "most", "rows")

    def __init__(self):
        self.below: dict[int, _Node] = {}
        self.least, self.most = 1 << 62, 0  # smallest set below; most n-grams that may still match below
        self.rows: list[int] = []


def remaining(sizes: list[int], at: list[int], seqs: list, bits: np.ndarray, percent: int, sides: list[int] | None = None, comps: list | None = None) -> list[tuple[int, int, int]]:
    """Pairs (i, j, sketch distance) of a group's sets, smaller sets first, that
    may link.  ``at`` has the place of the group's n-gram in each set and
    ``seqs`` the n-grams after it.  With ``sides``, pairs of one side are left
    out; with ``comps``, pairs of one component are."""
    root, out = _Node(), []
    for i in sorted(range(len(sizes)), key=lambda x: (sizes[x], x)):
        n, seq = sizes[i], seqs[i]
        rest = n - at[i] - 1
        place = {t: p for p, t in enumerate(seq)}
        found: list[int] = []
        cut = int(len(seq) < rest)  # then a node's n-gram that isn't in seq may still be in the set, unless a later one is in seq
        stack = [(root, 0, 1, 0, 0)]  # node, n-grams of this set that are behind, overlap, depth, n-grams of the path that may still match
        while stack:
            node, behind, overlap, depth, wait = stack.pop()
            need = needed(n, node.least, percent) if node.least < 1 << 62 else 0
            if overlap + min(rest - behind, node.most - depth + wait) < need:
                continue
            for j in node.rows:
                if overlap + min(rest - behind, sizes[j] - at[j] - 1 - depth + wait) >= needed(n, sizes[j], percent):
                    found.append(j)
            for t, child in node.below.items():
                p = place.get(t)
                stack.append((child, behind, overlap, depth + 1, wait + cut) if p is None else (child, p + 1, overlap + 1, depth + 1, 0))
        if sides is not None:
            found = [j for j in found if sides[j] != sides[i]]
        if comps is not None:
            found = [j for j in found if comps[j] != comps[i]]
        if found:
            apart = np.bitwise_count(bits[found] ^ bits[i]).sum(axis=1, dtype=np.int64)
            out += [(i, j, int(d)) for j, d in zip(found, apart) if (n + sizes[j] - d) // 2 >= needed(n, sizes[j], percent)]
        node = root
        for t in [None, *seq]:
            if t is not None:
                node = node.below.setdefault(t, _Node())
            node.least, node.most = min(node.least, n), max(node.most, rest)
        node.rows.append(i)
    return out


def forest(n: int, pairs: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """A spanning forest of the pairs, the nearest first."""
    up = list(range(n))

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    out = []
    for i, j, d in sorted(pairs, key=lambda p: p[2]):
        a, b = top(i), top(j)
        if a != b:
            up[a] = b
            out.append((i, j, d))
    return out


def _groups(rows: DataFrame, percent: int, again: bool) -> DataFrame:
    """Pairs of classes (a, b) to check; a row without pair marks a group
    (token) in which only a forest was taken."""

    def walk(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def done(s: int, e: int) -> list[tuple]:
            token, mine = int(tokens[s]), c[s:e]
            if e - s == 2 and blocks[0][s] == blocks[1][s]:  # a trie of one set: only its leaf
                need = needed(n[s], n[s + 1], percent)
                if (again and comp[s] == comp[s + 1]) or 1 + min(n[s] - at[s], n[s + 1] - at[s + 1]) - 1 < need:
                    return []
                apart = (int.from_bytes(bits[s], "little") ^ int.from_bytes(bits[s + 1], "little")).bit_count()
                return [(token, mine[0], mine[1])] if (n[s] + n[s + 1] - apart) // 2 >= need else []
            own = np.frombuffer(b"".join(bits[s:e]), np.uint8).reshape(e - s, -1)
            pairs = remaining(n[s:e], at[s:e], [x.tolist() for x in seq[s:e]], own, percent, side[s:e] if blocks[0][s] != blocks[1][s] else None, comp[s:e] if again else None)
            if again or len(pairs) <= 4 * len(mine):
                return [(token, mine[x], mine[y]) for x, y, _ in pairs]
            return [(token, None, None)] + [(token, mine[x], mine[y]) for x, y, _ in forest(len(mine), pairs)]

        left = None
        for p in chain(parts, [None]):  # None: the end
            end = p is None
            p = left if end else p if left is None else pd.concat([left, p], ignore_index=True)
            if p is None or not len(p):
                continue
            tokens, blocks = p["token"].to_numpy(), (p["i"].to_numpy(), p["j"].to_numpy())
            new = np.zeros(len(p) - 1, bool)
            for x in (tokens, *blocks):
                new |= x[1:] != x[:-1]
            starts = [0, *(np.flatnonzero(new) + 1).tolist(), *[len(p)] * end]
            c, n, at, seq, bits, side, comp = (p[x].tolist() for x in ("c", "n", "pos", "seq", "sketch", "own", "comp"))
            got = [x for s, e in zip(starts, starts[1:]) if e - s > 1 for x in done(s, e)]
            left = p.iloc[starts[-1]:]
            if got:
                yield pd.DataFrame(got, columns=["token", "a", "b"])

    return rows.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j").mapInPandas(walk, "token long, a binary, b binary")


def _blocked(rows: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """Rows with their pair of blocks (i <= j) and own block; groups (tokens in
    ``sizes``) of up to ``GROUP`` rows are one block.  A group of over three
    blocks is cut by set size into zones, so wide that sets of zones that are
    not neighbours cannot link, and only blocks of one zone or of neighbouring
    zones are paired."""
    width = max(math.log(100 / percent), 1e-6) * (1 + 1e-9)  # wider than rounding errors
    zone = F.floor(F.log("n") / width).cast("long")
    large = stored(sizes.groupBy("token").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > GROUP), "large-groups")
    cells = sizes.withColumn("zone", zone).join(large, "token").groupBy("token", "rows", "zone").agg(F.count(F.lit(1)).alias("own"))
    cut = F.col("rows") > 3 * GROUP
    cells = cells.select("token", "zone", cut.alias("cut"), F.ceil(F.when(cut, F.col("own")).otherwise(F.col("rows")) / GROUP).alias("blocks"))
    by = Window.partitionBy("token").orderBy("zone")  # a group has few zones: they grow with the logarithm of the sizes

    def neighbour(f, step: int):
        return F.when(F.col("cut") & (f("zone").over(by) == F.col("zone") + step), f("blocks").over(by)).otherwise(F.lit(0))

    cells = stored(cells.select("token", "zone", F.when(F.col("cut"), F.col("zone")).otherwise(F.lit(0)).alias("base"), "blocks",
                                neighbour(F.lag, -1).alias("below"), neighbour(F.lead, 1).alias("above")), "cells")
    rows = rows.withColumn("zone", zone).join(cells, ["token", "zone"], "left").fillna({"base": 0, "blocks": 1, "below": 0, "above": 0})

    def names(base, count):
        first = base * F.lit(1 << 40)
        return F.when(count > 0, F.sequence(first, first + count - 1)).otherwise(F.array().cast("array<bigint>"))

    base = F.col("base")
    rows = rows.withColumn("own", base * F.lit(1 << 40) + F.pmod(F.xxhash64("c", "token"), F.col("blocks")))
    other = F.explode(F.concat(names(base, F.col("blocks")), names(base - 1, F.col("below")), names(base + 1, F.col("above"))))
    return rows.withColumn("x", other).withColumn("i", F.least("own", "x")).withColumn("j", F.greatest("own", "x")).drop("x", "zone", "base", "blocks", "below", "above")


def _checked(docs: DataFrame, classes: DataFrame, ids: DataFrame, pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) of classes that link, by their whole sets; stored.  The
    end of a pair that has more pairs is its hub.  A hub's set is sent once for
    each ``HEAD`` of its partners, whose sets follow it in a sorted stream, so
    sets are shuffled once and the task that reads a text sends its set.
    ``ids`` has the doc_id and c of every row."""
    ends = pairs.select(F.col("a").alias("c")).union(pairs.select("b")).groupBy("c").agg(F.count(F.lit(1)).alias("pairs"))
    ends = stored(ends.join(classes.select("c", F.col("rep").alias("doc_id")), "c"), "wanted")
    of = [ends.select(F.col("c").alias(x), F.col("pairs").alias(f"of_{x}")) for x in "ab"]
    first = F.col("of_a") >= F.col("of_b")
    cut = pairs.join(of[0], "a").join(of[1], "b").select(
        F.when(first, F.col("a")).otherwise(F.col("b")).alias("hub"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("c"),
        F.ceil(F.greatest("of_a", "of_b") / HEAD).cast("int").alias("parts"))
    cut = cut.select("hub", F.pmod(F.xxhash64("c"), F.col("parts")).cast("int").alias("part"), "c", F.lit(1).alias("tail"))
    sends = stored(cut.union(cut.select("hub", "part", F.col("hub").alias("c"), F.lit(0)).distinct()), "sends")

    def small(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if df.count() <= BROADCAST_IDS else df

    def sets(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:  # of rows that repeat an id, those with another text are left out
            for i in range(0, len(p), 256):
                x = p.iloc[i:i + 256]
                own = [(c, s) for c, s in zip(x["c"], (shingles(t, k) for t in x["text"])) if digest(s) == c]
                yield pd.DataFrame({"c": [c for c, _ in own], "s": [s.tobytes() for _, s in own]})

    want = ends.select("c", "doc_id")
    again = ids.join(small(want), ["c", "doc_id"], "left_semi").groupBy("c").count().where("count > 1")
    whole = docs.join(small(want), "doc_id").select("c", "text").mapInPandas(sets, "c binary, s binary")
    copied = [] if again.isEmpty() else [stored(whole, "whole-sets")]
    if copied:  # rows that repeat an id and its text
        copied.append(stored(copied[0].dropDuplicates(["c"]), "whole-sets"))
        whole = copied[1]

    def check(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        head = np.empty(0, np.uint64)
        for p in parts:
            ok = []
            for hub, c, tail, s in zip(p["hub"], p["c"], p["tail"], p["s"]):
                s = np.frombuffer(s, np.uint64)
                if not tail:
                    head = s
                    continue
                both = len(np.intersect1d(head, s, assume_unique=True))
                if 100 * both >= percent * (len(head) + len(s) - both):
                    ok.append((min(hub, c), max(hub, c)))
            yield pd.DataFrame(ok, columns=["a", "b"])

    rows = whole.join(small(sends), "c").select("hub", "part", "tail", "c", "s")
    out = stored(rows.repartition("hub", "part").sortWithinPartitions("hub", "part", "tail").mapInPandas(check, "a binary, b binary"), "links")
    discard(ends, sends, *copied)
    return out


def shared(parts: Iterator[pd.DataFrame], percent: int) -> Iterator[pd.DataFrame]:
    """Rows (token, c, n, pos), sorted by n-gram and size, that may link with
    another of their n-gram, by their sizes and the n-grams left from ``pos`` on
    (two sets that link meet at the first n-gram they share).  All rows of a
    group of over ``NEAR`` stay, and those of a partition's first and last, as
    parts of them aren't seen."""
    left, whole = None, None  # rows of a group that may go on; the n-gram whose rows all stay
    for p in chain(parts, [None]):
        end = p is None
        p = left if end else p if left is None else pd.concat([left, p], ignore_index=True)
        if p is None or not len(p):
            continue
        t, n = p["token"].to_numpy(), p["n"].to_numpy()
        rest = n - p["pos"].to_numpy()
        starts = np.flatnonzero(np.append(True, t[1:] != t[:-1]))
        sizes = np.diff(np.append(starts, len(t)))
        whole = t[0] if whole is None else whole
        keep = (np.repeat(sizes, sizes) > NEAR) | (t == whole) | (end & (t == t[-1]))
        for d in range(1, min(NEAR, int(sizes.max()))):
            at = np.flatnonzero(t[d:] == t[:-d])
            x, y = n[at], n[at + d]
            ok = at[(100 * x >= percent * y) & (np.minimum(rest[at], rest[at + d]) >= -(-percent * (x + y) // (100 + percent)))]
            keep[ok] = keep[ok + d] = True
        stay = len(p) if end else int(starts[-1])
        if not end and sizes[-1] > NEAR:
            whole, stay = t[-1], len(p)
        yield p.iloc[:stay].loc[keep[:stay], ["token", "c", "n", "pos"]]
        left = p.iloc[stay:]


def link(docs: DataFrame, k: int = 3, percent: int = 90, by_text: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links) of
    every row of ``docs`` (doc_id, text).  ``by_text`` adds, where ids may repeat,
    the hash of the row's text, the digest of its class (rows of equal n-grams)
    and of its component's first class: text_hash, class, root."""
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select("doc_id", "text")
    texts = docs.withColumn("text_hash", F.xxhash64("text")) if by_text else docs
    extra = [x for x in texts.columns if x == "text_hash"]
    counts = spark.sparkContext.broadcast(bucket_counts(docs, k))

    def measured(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            c, n, first, bits = [], [], [], []
            for t in p["text"]:
                s = shingles(t, k)
                rank = counts.value[(s % np.uint64(BUCKETS)).astype(np.int64)]
                keep = min(len(s), prefix_length(len(s), percent) + DEPTH)  # the prefix, and what the trie may need after its end
                order = np.argpartition(rank, keep - 1)[:keep] if keep < len(s) else np.arange(len(s))
                if keep < len(s):  # equal counts at the border: take them all, then cut by the hash
                    order = np.flatnonzero(rank <= rank[order].max())
                order = order[np.lexsort((s[order], rank[order]))][:keep]
                c.append(digest(s)), n.append(len(s)), first.append(_signed(s[order])), bits.append(sketch(s))
            yield pd.DataFrame({"doc_id": p["doc_id"], "c": c, "n": n, "first": first, "sketch": bits} | {x: p[x] for x in extra})

    own = stored(texts.mapInPandas(measured, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {_KEY}, first array<long>, sketch binary" + "".join(f", {x} long" for x in extra)), "sets")
    classes = stored(own.where("n > 0 and doc_id is not null").groupBy("c").agg(
        F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("first").alias("first"), F.first("sketch").alias("sketch")), "classes")
    ids = stored(own.select("doc_id", "n", "c", *extra), "ids")
    discard(own)
    length = F.col("n") - F.ceil(F.col("n") * percent / 100).cast("int") + 1
    rows = classes.select("c", "n", F.posexplode(F.slice("first", F.lit(1), length.cast("int"))).alias("pos", "token"))

    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = rows.select("token", "c", "n", "pos").repartitionByRange(parts, "token", "n", "c").sortWithinPartitions("token", "n", "c").mapInPandas(lambda frames: shared(frames, percent), f"token long, {_KEY}, pos int")
    rows = stored(rows, "shared")

    def full(rows: DataFrame) -> DataFrame:
        return rows.join(classes.select("c", "first", "sketch"), "c").withColumn("seq", F.slice("first", F.col("pos") + 2, DEPTH)).drop("first")

    walked = stored(_groups(_blocked(full(rows.withColumn("comp", F.lit(None).cast("binary"))), rows, percent), percent, False).distinct(), "pairs")
    pairs = walked.where("a is not null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    linked = _checked(docs, classes, ids, pairs, k, percent)
    found = components(linked)
    open_groups = walked.where("a is null").select("token").distinct()
    if not open_groups.isEmpty():
        found = stored(found, "components")
        part = rows.join(open_groups, "token", "left_semi").join(found.select(F.col("node").alias("c"), F.col("root").alias("comp")), "c", "left").withColumn("comp", F.coalesce("comp", "c"))
        mixed = part.groupBy("token").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("token")
        part = stored(part.join(mixed, "token", "left_semi"), "mixed-groups")  # only these fetch what the walk reads
        if not part.isEmpty():
            more = _groups(_blocked(full(part), part.drop("comp"), percent), percent, True).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
            more = stored(more.join(pairs, ["a", "b"], "left_anti"), "more-pairs")
            found = components(linked.union(_checked(docs, classes, ids, more, k, percent)))
    named = classes.select("c", "rep").join(found.select(F.col("node").alias("c"), "root"), "c", "left").withColumn("root", F.coalesce("root", "c"))
    least = stored(named.groupBy("root").agg(F.min("rep").alias("component_id")), "component-ids")
    named = stored(named.join(least, "root").select("c", "component_id", *["root"] * by_text), "class-ids")
    discard(classes, rows, walked, least)
    release(spark)
    out = ids.join(named, "c", "left")
    more = [*extra, F.col("c").alias("class"), "root"] if by_text else []
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"), *more)
