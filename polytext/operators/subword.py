"""Subword vocabulary learning (I5), re-aimed as Spark jobs: byte-pair-encoding
merges (Sennrich et al. 2016) learned from the corpus word counts up to a
vocabulary size.

The corpus is touched once (word counts).  Two tables go from round to round:
the distinct words, each with its symbols, and the count of every adjacent pair.
A round takes many merges at once: pairs by (count descending, left, right),
each that shares no symbol with a pair taken before it in the round and has at
least ``share`` of the best pair's count.  Merges without common symbols don't
change each other's counts, so each has its exact count.  Words that hold one of
the merges change, by one native expression; only their pairs, old and new, are
summed into the count table.  So the rounds grow with the logarithm of the
counts rather than with the merges, and the pairs of unchanged words are never
counted again; words that are one symbol leave.  The driver sees at most ``per_round`` pairs a round and the
vocabulary, which the budget bounds.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polytext.operators.layout import spread
from polytext.operators.tokens import word_tokens
from polytext.session import ensure_checkpoint_dir

END_OF_WORD = "</w>"

# Vocabulary-size corrections by model family.
SIZE_CORRECTIONS = [("m2m", 108), ("nllb", 2)]


def vocab_budget(model_id: str, vocab_size: int) -> int:
    """Vocabulary size to learn for a model family (size minus correction)."""
    low = model_id.lower()
    for key, corr in SIZE_CORRECTIONS:
        if key in low:
            return vocab_size - corr
    return vocab_size


def word_symbols(texts: DataFrame, text: str) -> DataFrame:
    """(count, s) of the corpus' distinct words; s: characters and an end marker,
    each between spaces."""
    words = spread(texts.select(text)).select(F.explode(word_tokens(text)).alias("word")).groupBy("word").agg(
        F.count(F.lit(1)).alias("count"))
    return words.select("count", F.concat(F.lit(" "), F.concat_ws(" ", F.split("word", "")), F.lit(f" {END_OF_WORD} "))
                        .alias("s"))


def _pairs(symbols: Column) -> Column:
    """array<struct<l, r>> of the adjacent symbols of a word."""
    x = F.split(F.trim(symbols), " ")
    return F.arrays_zip(F.slice(x, F.lit(1), F.size(x) - 1).alias("l"), F.slice(x, F.lit(2), F.size(x) - 1).alias("r"))


def alternatives(merges: list[tuple[str, str]]) -> str:
    """A pattern of the pairs, those with the same first character together, so
    that a place in a word is held against the first characters and one group.
    Only one pair can match at a symbol, as merges share none: their order is free."""
    by: dict[str, list[str]] = {}
    for a, b in merges:
        by.setdefault(a[0], []).append(f"({re.escape(a)}) ({re.escape(b)})")
    return "|".join(f"(?={re.escape(x)})(?:{'|'.join(of)})" for x, of in by.items())


def merged(symbols: Column, merges: list[tuple[str, str]]) -> Column:
    """A word after merges without common symbols, from left to right: a match
    of one of the pairs loses the space between its symbols."""
    groups = "".join(f"${i}" for i in range(1, 2 * len(merges) + 1))
    return F.regexp_replace(symbols, F.lit(f"(?<= )(?:{alternatives(merges)})(?= )"), F.lit(groups))


def unfinished(words: DataFrame) -> DataFrame:
    """The words of two symbols or more; the others have no pair left."""
    return words.where(F.instr(F.trim("s"), " ") > 0)


def choose(top: list[tuple[str, str, int]], share: float, most: int) -> list[tuple[str, str, int]]:
    """The merges of a round, from pairs in order."""
    used: set[str] = set()
    out = []
    for left, right, c in top:
        if len(out) < most and c >= share * top[0][2] and not used & {left, right}:
            used |= {left, right}
            out.append((left, right, c))
    return out


def learn_bpe(texts: DataFrame, text: str, budget: int, min_count: int = 2, share: float = 0.25, per_round: int = 256
              ) -> DataFrame:
    """(rank, round, left, right, count) of the merges that fill a vocabulary of
    ``budget`` symbols (the corpus' characters, the end marker, the merges);
    stops early when no pair occurs ``min_count`` times.  Ties between equally
    frequent pairs go to the smaller (left, right)."""
    spark = texts.sparkSession
    ensure_checkpoint_dir(spark)
    words = word_symbols(texts, text).checkpoint(eager=True)
    known = {r[0] for r in words.select(F.explode(F.split(F.trim("s"), " "))).distinct().limit(budget).collect()}
    pairs = words.select("count", F.explode(_pairs(F.col("s"))).alias("p")).groupBy("p.l", "p.r").agg(F.sum("count").alias("c"))
    pairs = pairs.checkpoint(eager=True)
    merges: list[tuple[int, int, str, str, int]] = []
    step = 0
    while len(known) < budget:
        top = pairs.where(F.col("c") >= min_count).orderBy(F.col("c").desc(), "l", "r").limit(per_round).collect()
        taken = choose([tuple(r) for r in top], share, budget - len(known))
        if not taken:
            break
        merges += [(len(merges) + i, step, *m) for i, m in enumerate(taken)]
        known |= {left + right for left, right, _ in taken}
        step += 1
        after = merged(F.col("s"), [m[:2] for m in taken])
        words = words.select("count", after.alias("s"), F.when(after != F.col("s"), F.col("s")).alias("old")).checkpoint(eager=True)
        changed = words.where("old is not null")
        delta = changed.select(F.col("count").alias("c"), F.explode(_pairs(F.col("s"))).alias("p")).union(
            changed.select(-F.col("count"), F.explode(_pairs(F.col("old"))))).select("p.l", "p.r", "c")
        pairs = pairs.union(delta).groupBy("l", "r").agg(F.sum("c").alias("c")).where("c > 0").checkpoint(eager=True)
        words = unfinished(words.drop("old"))
    return spark.createDataFrame(merges, "rank int, round int, left string, right string, count bigint")
