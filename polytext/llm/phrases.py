"""Phrase collocations by vertical partitioning of truncated suffix trees.

Text is lower-cased (A-Z), split at ``[.,;:!?\\x0A-\\x0D]`` into pieces and
these into words ``[^\\x20\\x09]+``; all counts are per language.  A phrase of 2
or 3 words that occurs ``least`` times or more is a candidate; of its cuts into
two parts the one with the lowest score floor(10^6 a a / (l r)) counts.

1. Prefixes: one scan counts the words of every language.  A word that occurs
   less than ``least`` times is in no candidate, so it ends a piece from here
   on; a bitmap of ``BITS`` bits (8 MB, whatever the vocabulary) tells these
   words, and one that shares its bit with a frequent word is kept.  With the
   counts the suffixes (one for each word, cut after ``DEPTH`` = 3 words, at the end of
   the piece if that is earlier) are divided by their prefix into groups that
   hold about ``budget`` suffixes: a word is a prefix unless it has more than
   the budget itself; then its two-word prefixes are dealt to the groups.
2. Subtrees: a second scan sends to each group its distinct truncated suffixes
   of two words or more with their counts, as blocks.  A group sorts and merges the blocks as they
   arrive, so a task holds one group's distinct suffixes; that sorted table is
   the group's subtree in flat form.  No group needs another one.
3. Counts: the total of a leaf is the count of its three words, the total of
   the leaves below two words is the count of these two; words come from 1.

Words are 64-bit hashes while counted; that no two words of the vocabulary share
one is checked on the whole vocabulary (else another seed is taken), so counts
are exact.  Products are decimals of 38 digits, as they may pass 64 bits.

Scale: a chunk's equal suffixes are one entry before the shuffle, so neither a
passage copied into a third of the documents nor a frequent word makes a group
large; a word above the budget is spread by its second word.  The words above
the budget are broadcast: at most (all words / budget) of them.  Tables of counts
are joined by ``lookup_join`` (broadcast by measured size, else salted).  The
best of a language are taken in two steps, so that no task sees all its phrases.

Edge cases: a null or empty text has no words; a null language is ``und``;
phrases never cross pieces or documents; overlapping occurrences count;
repeated rows count each; ties go to the smaller phrase in UTF-8 byte order;
other columns are not read; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from polytext.llm.common import ship, stored
from polytext.operators.joins import lookup_join

DEPTH, BUDGET, BLOCK, LOOKUP, BITS = 3, 1 << 19, 1 << 20, 8 << 20, 1 << 26
#: Suffixes of a chunk (words counted together in a task), and of one block sent.
CHUNK, SENT = 1 << 18, 1 << 14
_BITS = 21
#: Bytes: A-Z to a-z, separators of pieces to a line feed, tab to space.
_TABLE = bytes(10 if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))
_END, _NONE = 0, 1
ENTRY = np.dtype([("h", np.uint64, DEPTH), ("n", np.int64)])


class Book(dict):
    """Codes of a chunk's words, given as they are met."""

    def __init__(self):
        super().__init__({b"\n": _END, b"": _NONE})

    def __missing__(self, word: bytes) -> int:
        code = self[word] = len(self)
        return code


def codes(text: str | None, book: Book) -> np.ndarray:
    """Codes of a text's words, with ``_END`` between and after its pieces."""
    data = (text or "").encode("utf-8").translate(_TABLE)
    out, at = [], 0
    while at < len(data):  # words become objects for one block at a time
        end = data.find(b" ", at + BLOCK)
        end = len(data) if end < 0 else end
        said = data[at:end].replace(b"\n", b" \n ").split(b" ")
        out.append(np.fromiter(map(book.__getitem__, said), np.int32, len(said)))
        at = end + 1
    out.append(np.zeros(1, np.int32))
    own = np.concatenate(out)
    return own[own != _NONE]


def chunks(parts: Iterator[pd.DataFrame], most: int) -> Iterator[tuple[list[bytes], dict[str, np.ndarray]]]:
    """Words by code, and the codes of each language's texts, by chunks of about
    ``most`` words."""
    book, held, size = Book(), {}, 0
    for p in parts:
        for lang, text in zip(p["lang"], p["text"]):
            own = codes(text, book)
            held.setdefault(lang, []).append(own)
            size += len(own)
            if size >= most or len(book) >= 1 << _BITS - 1:
                yield list(book), {x: np.concatenate(v) for x, v in held.items()}
                book, held, size = Book(), {}, 0
    if held:
        yield list(book), {x: np.concatenate(v) for x, v in held.items()}


def hashed(words: list[bytes], seed: int) -> np.ndarray:
    """64-bit hashes of a chunk's words by code; 0 for none."""
    salt = seed.to_bytes(8, "little")
    return np.array([0, 0, *(int.from_bytes(hashlib.blake2b(w, digest_size=8, salt=salt).digest(), "little") for w in words[2:])], np.uint64)


def suffixes(own: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct truncated suffixes (codes of ``DEPTH`` words, 0 behind the end
    of the piece) of a text in codes below ``size``, and how often each occurs."""
    own = np.append(own, np.zeros(DEPTH - 1, own.dtype))
    at = [own[d:len(own) - DEPTH + 1 + d] for d in range(DEPTH)]
    if size < 1 << _BITS:
        at = [x.astype(np.int64) for x in at]
        for d in range(1, DEPTH):
            at[d] *= at[d - 1] != _END
        key = at[0]
        for x in at[1:]:
            key = key << _BITS | x
        key, n = np.unique(key[at[0] != _END], return_counts=True)
        return np.stack([key >> _BITS * (DEPTH - 1 - d) & (1 << _BITS) - 1 for d in range(DEPTH)], axis=1), n
    for d in range(1, DEPTH):  # a single text with more words than a key can hold
        at[d] = at[d] * (at[d - 1] != _END)
    return np.unique(np.stack(at, axis=1)[at[0] != _END], axis=0, return_counts=True)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ x >> np.uint64(29)


def subtree(held: list[np.ndarray]) -> np.ndarray:
    """The blocks of a group, merged and sorted."""
    rows = held[0] if len(held) == 1 else np.concatenate(held)
    h = rows["h"]
    rows = rows[np.lexsort([h[:, d] for d in reversed(range(DEPTH))])]
    h = rows["h"]
    new = np.append(True, (h[1:] != h[:-1]).any(axis=1))
    out = rows[new].copy()
    out["n"] = np.add.reduceat(rows["n"], np.flatnonzero(new))
    return out


def totals(tree: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(words, count) of the nodes at depths 2 to ``DEPTH`` that reach ``least``."""
    h = tree["h"]
    for depth in range(2, DEPTH + 1):
        new = np.append(True, (h[1:, :depth] != h[:-1, :depth]).any(axis=1))
        n = np.add.reduceat(tree["n"], np.flatnonzero(new))
        own = h[new].copy()
        own[:, depth:] = 0
        keep = (n >= least) & (own[:, depth - 1] != 0)
        yield own[keep], n[keep]


def vocabulary(docs: DataFrame, seed: int = 0) -> tuple[DataFrame, int]:
    """lang, word, h, f of every word, and the seed with which no two words
    share a hash."""

    def counted(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for words, held in chunks(parts, CHUNK):
            h = hashed(words, seed).view(np.int64)
            said = np.array([w.decode("utf-8", "replace") for w in words], object)
            for lang, own in held.items():
                f = np.bincount(own, minlength=len(words))
                f[[_END, _NONE]] = 0
                at = np.flatnonzero(f)
                for i in range(0, len(at), SENT):
                    x = at[i:i + SENT]
                    yield pd.DataFrame({"lang": lang, "word": said[x], "h": h[x], "f": f[x]})

    rows = docs.mapInPandas(counted, "lang string, word string, h long, f long")
    out = stored(rows.groupBy("lang", "word").agg(F.first("h").alias("h"), F.sum("f").alias("f")), "vocabulary")
    shared = out.groupBy("h").agg(F.min("word").alias("x"), F.max("word").alias("y")).where("x <> y or h = 0")
    return (out, seed) if shared.isEmpty() else vocabulary(docs, seed + 1)


def often(vocab: DataFrame, least: int, bits: int) -> np.ndarray:
    """A bitmap of the hashes of the words that occur ``least`` times or more."""
    at = F.pmod("h", F.lit(bits))
    rows = vocab.where(F.col("f") >= least).select(F.floor(at / 32768).alias("b"), (at % 32768).alias("at"))
    out = np.zeros((-(-bits // 32768), 4096), np.uint8)
    for b, x in rows.groupBy("b").agg(F.bitmap_construct_agg("at")).collect():  # bits / 8 bytes in all
        out[b] = np.frombuffer(x, np.uint8)
    return out.reshape(-1)


def frequent_only(own: np.ndarray, h: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Codes with an end of a piece in place of every word that is not in the bitmap."""
    at = (h.view(np.int64) % (8 * len(table))).astype(np.int64)
    kept = table[at >> 3] >> (at & 7).astype(np.uint8) & 1
    kept[[_END, _NONE]] = 0
    return np.where(kept[own] == 1, own, np.int32(_END))


def counts(docs: DataFrame, vocab: DataFrame, seed: int, least: int, budget: int) -> DataFrame:
    """lang, h1, h2, h3 (0: two words), a of every phrase that occurs ``least``
    times or more."""
    spark = docs.sparkSession
    total = vocab.agg(F.sum("f")).first()[0] or 0
    groups = max(-(-total // budget), int(spark.conf.get("spark.sql.shuffle.partitions")))
    frequent: dict[str, list] = {}
    for r in vocab.where(F.col("f") > budget).select("lang", "h").collect():  # at most total / budget words
        frequent.setdefault(r["lang"], []).append(r["h"] % (1 << 64))
    frequent = {x: np.array(sorted(v), np.uint64) for x, v in frequent.items()}
    table = spark.sparkContext.broadcast(often(vocab, least, BITS))

    def dealt(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for words, held in chunks(parts, CHUNK):
            h = hashed(words, seed)
            for lang, own in held.items():
                at, n = suffixes(frequent_only(own, h, table.value), len(words))
                two = at[:, 1] != _END  # a word alone is in no phrase
                at, n = at[two], n[two]
                rows = np.empty(len(n), ENTRY)
                rows["h"], rows["n"] = h[at], n
                by = mixed(rows["h"][:, 0] + hashed([b"", b"", lang.encode()], 0)[2])
                if lang in frequent:
                    by = np.where(np.isin(rows["h"][:, 0], frequent[lang]), mixed(by + rows["h"][:, 1]), by)
                group = (by % np.uint64(groups)).astype(np.int64)
                order = np.argsort(group, kind="stable")
                rows, group = rows[order], group[order]
                cut = [*(np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(group) else []), len(group)]
                sent = [(s, i, min(i + SENT, e)) for s, e in zip(cut, cut[1:]) for i in range(s, e, SENT)]
                for i in range(0, len(sent), 256):  # bytes are made as they leave
                    part = sent[i:i + 256]
                    yield pd.DataFrame({"g": [int(group[s]) for s, _, _ in part], "lang": lang, "rows": [rows[x:y].tobytes() for _, x, y in part]})

    def merged(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def done(lang: str, held: list[np.ndarray]) -> Iterator[pd.DataFrame]:
            for h, n in totals(subtree(held), least):
                yield pd.DataFrame({"lang": lang, **{f"h{d + 1}": h[:, d].view(np.int64) for d in range(DEPTH)}, "a": n})

        last, held, base, size = None, [], 0, 0
        for p in parts:
            for g, lang, blob in zip(p["g"], p["lang"], p["rows"]):
                if (g, lang) != last:
                    if held:
                        yield from done(last[1], held)
                    last, held, base, size = (g, lang), [], 0, 0
                held.append(np.frombuffer(blob, ENTRY))
                size += len(held[-1])
                if size > 2 * base + BUDGET:  # merge as they arrive: what is held stays near the distinct suffixes
                    held = [subtree(held)]
                    base = size = len(held[0])
        if held:
            yield from done(last[1], held)

    blocks = docs.mapInPandas(dealt, "g long, lang string, rows binary")
    names = ", ".join(f"h{d + 1} long" for d in range(DEPTH))
    tree = blocks.repartition("g", "lang").sortWithinPartitions("g", "lang").mapInPandas(merged, f"lang string, {names}, a long")
    return stored(tree, "phrase-counts")


def _score(a: str, left: str, right: str) -> F.Column:
    wide = lambda c: f"cast({c} as decimal(19, 0))"
    return F.expr(f"cast((cast(1000000 as decimal(7, 0)) * ({wide(a)} * {wide(a)})) div ({wide(left)} * {wide(right)}) as long)")


def mine(docs: DataFrame, least: int = 10, cover: int = 50, top: int = 2000, budget: int = BUDGET) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's ``top`` best
    candidates (all, with ``top`` None, then without rank): a candidate inside a
    longer one that has ``cover`` percent of its occurrences is left out."""
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text")
    vocab, seed = vocabulary(docs)
    found = counts(docs, vocab, seed, least, budget)
    words = vocab.where(F.col("f") >= least)
    pairs = found.where("h3 = 0").select("lang", "h1", "h2", "a")
    triples = found.where("h3 <> 0")

    def near(df: DataFrame, small: DataFrame, on: list[str]) -> DataFrame:
        return lookup_join(df, small, on, salt_by=F.struct("h1", "h2"), max_broadcast_bytes=LOOKUP, salts=4)

    def said(df: DataFrame, d: int) -> DataFrame:
        return near(df, words.select("lang", F.col("h").alias(f"h{d}"), F.col("word").alias(f"w{d}"), F.col("f").alias(f"f{d}")), ["lang", f"h{d}"])

    def known(df: DataFrame, x: str, y: str, name: str) -> DataFrame:
        return near(df, pairs.select("lang", F.col("h1").alias(x), F.col("h2").alias(y), F.col("a").alias(name)), ["lang", x, y])

    inside = triples.select("lang", "h1", "h2", "a").union(triples.select("lang", "h2", "h3", "a")).groupBy("lang", "h1", "h2").agg(F.max("a").alias("longer"))
    # as large as the triples; estimated from compressed files, it could be broadcast
    two = pairs.join(inside.hint("merge"), ["lang", "h1", "h2"], "left").where(F.expr(f"longer is null or 100 * longer < {cover} * a"))
    two = said(said(two, 1), 2).select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", F.col("f1").alias("l"), F.col("f2").alias("r"), _score("a", "f1", "f2").alias("score"))
    three = said(said(said(known(known(triples, "h1", "h2", "f12"), "h2", "h3", "f23"), 1), 2), 3)
    three = three.withColumn("s1", _score("a", "f1", "f23")).withColumn("s2", _score("a", "f12", "f3"))
    first = F.col("s1") <= F.col("s2")
    three = three.select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a", F.when(first, F.col("f1")).otherwise(F.col("f12")).alias("l"),
                         F.when(first, F.col("f23")).otherwise(F.col("f3")).alias("r"), F.least("s1", "s2").alias("score"))
    both = two.union(three)
    if top is not None:
        order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
        part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(16))).orderBy(*order)
        both = both.withColumn("_r", F.row_number().over(part)).where(F.col("_r") <= top).drop("_r")
        both = both.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    sizes = vocab.groupBy("lang").agg(F.sum("f").alias("n"))
    out = lookup_join(both, sizes, ["lang"], salt_by=F.col("phrase"))
    return out.select("lang", *["rank"] * (top is not None), "phrase", "a", "l", "r", "n", "score")


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS p FROM d),
w AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM p),
g AS (SELECT lang, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w)),
u AS (SELECT lang, a AS w, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM u GROUP BY lang),
b AS (SELECT lang, a, b, count(*) AS f FROM g WHERE b IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
t AS (SELECT lang, a, b, c, count(*) AS f FROM g WHERE c IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
x AS (SELECT lang, a, b, max(f) AS f FROM (SELECT lang, a, b, f FROM t UNION ALL SELECT lang, b, c, f FROM t) GROUP BY ALL),
two AS (SELECT b.lang, b.a || ' ' || b.b AS phrase, b.f AS a, p.f AS l, q.f AS r, CAST(1000000::HUGEINT * b.f * b.f // (p.f::HUGEINT * q.f) AS BIGINT) AS score
        FROM b JOIN u p ON p.lang = b.lang AND p.w = b.a JOIN u q ON q.lang = b.lang AND q.w = b.b
        LEFT JOIN x ON x.lang = b.lang AND x.a = b.a AND x.b = b.b WHERE x.f IS NULL OR 100 * x.f < 50 * b.f),
cut AS (SELECT t.lang, t.a || ' ' || t.b || ' ' || t.c AS phrase, t.f AS a, p.f AS l1, y.f AS r1, z.f AS l2, q.f AS r2,
               1000000::HUGEINT * t.f * t.f // (p.f::HUGEINT * y.f) AS s1, 1000000::HUGEINT * t.f * t.f // (z.f::HUGEINT * q.f) AS s2
        FROM t JOIN u p ON p.lang = t.lang AND p.w = t.a JOIN u q ON q.lang = t.lang AND q.w = t.c
        JOIN b y ON y.lang = t.lang AND y.a = t.b AND y.b = t.c JOIN b z ON z.lang = t.lang AND z.a = t.a AND z.b = t.b),
three AS (SELECT lang, phrase, a, CASE WHEN s1 <= s2 THEN l1 ELSE l2 END AS l, CASE WHEN s1 <= s2 THEN r1 ELSE r2 END AS r, CAST(least(s1, s2) AS BIGINT) AS score FROM cut),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM (SELECT * FROM two UNION ALL SELECT * FROM three))
SELECT lang, rank, phrase, a, l, r, n, score FROM o JOIN n USING (lang) WHERE rank <= 2000
"""
