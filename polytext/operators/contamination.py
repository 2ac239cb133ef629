"""Train/dev contamination: decontaminate pairs (D1), hits per dev sentence
(D2) and the per-language report (E7).

The dev side's bytes are measured and it is broadcast below a bound.  Beyond it
a bit table of its hashes (8 MB) is broadcast, and only train rows that the
table lets through are shuffled, to an exact join; that is salted, as a
sentence repeated in many documents is a hot key.  Train sentences are
aggregated (map-side partial counts) only after the semi-join to the dev keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polytext.functions.text import py_strip
from polytext.operators.joins import MAX_BROADCAST_BYTES, bit_table, may_match, salted_join, table_bytes
from polytext.session import ensure_checkpoint_dir

# Fixed value: sentence separator of the contamination check.
SENTENCE_SPLIT = "[.\n]+"


def sentences(text: Column) -> Column:
    """Trimmed, non-blank sentences of a text, in order."""
    return F.filter(F.transform(F.split(text, SENTENCE_SPLIT), lambda s: py_strip(s)), lambda s: s != "")


def dev_keys(dev: DataFrame) -> DataFrame:
    """The distinct (lang, sentence) of a dev set, evaluated once: what follows
    measures it and joins it from the written table."""
    ensure_checkpoint_dir(dev.sparkSession)
    return dev.select("lang", "sentence").distinct().checkpoint(eager=True)


def decontaminate(pairs: DataFrame, dev: DataFrame, src: str = "src", tgt: str = "tgt",
                  src_lang: str = "src_lang", tgt_lang: str = "tgt_lang") -> DataFrame:
    """Drop a pair when either side appears verbatim in the dev set of
    its language.  ``dev`` has columns (lang, sentence).  Beyond the broadcast
    bound ``pairs`` is read twice, so it has to give the same rows each time."""
    d = dev_keys(dev)
    sides, columns = ((src_lang, src), (tgt_lang, tgt)), pairs.columns
    named = [d.select(F.col("lang").alias(lang), F.col("sentence").alias(side)) for lang, side in sides]
    if table_bytes(d) <= MAX_BROADCAST_BYTES:  # measured once for both sides
        for keys, on in zip(named, sides):
            pairs = pairs.join(F.broadcast(keys), list(on), "left_anti")
        return pairs.select(*columns)
    bits = bit_table(d, ["lang", "sentence"]).checkpoint(eager=True)
    marked = may_match(may_match(pairs, bits, [src_lang, src], "_in_src"), bits, [tgt_lang, tgt], "_in_tgt")
    suspect = F.col("_in_src") | F.col("_in_tgt")
    clean = marked.where(~suspect).select(*columns)
    rest = marked.where(suspect).select(*columns)
    # a repeated sentence is a hot key: salted anti-joins keyed by the pair
    salt = F.concat_ws("|", *[F.col(c).cast("string") for c in (src, tgt)])
    for keys, on in zip(named, sides):
        rest = salted_join(rest, keys, list(on), "left_anti", salt_by=salt)
    return clean.unionByName(rest.select(*columns))


def contamination_hits(train: DataFrame, dev: DataFrame) -> DataFrame:
    """For every distinct dev (lang, sentence): occurrences in train."""
    d = dev_keys(dev)
    on = ["lang", "sentence"]
    if table_bytes(d) <= MAX_BROADCAST_BYTES:
        found = train.select(*on).join(F.broadcast(d), on, "left_semi")
    else:
        bits = bit_table(d, on).checkpoint(eager=True)
        some = may_match(train.select(*on), bits, on, "_in_dev").where("_in_dev")
        found = salted_join(some.select(*on, F.monotonically_increasing_id().alias("_row")), d, on, "left_semi", salt_by=F.col("_row"))
    hits = (found.groupBy("lang", "sentence").agg(F.count(F.lit(1)).alias("hits")))
    return d.join(hits, ["lang", "sentence"], "left").select(
        "lang", "sentence", F.coalesce(F.col("hits"), F.lit(0)).alias("hits"))


def contamination_report(hits: DataFrame) -> DataFrame:
    """Per language: dev sentences, contaminated ones, percent, total
    occurrences in train."""
    return hits.groupBy("lang").agg(
        F.count(F.lit(1)).alias("dev_sentences"), F.count_if(F.col("hits") > 0).alias("contaminated"),
        F.sum("hits").alias("occurrences")).select(
        "lang", "dev_sentences", "contaminated",
        (F.lit(100.0) * F.col("contaminated") / F.col("dev_sentences")).alias("percent"), "occurrences")
