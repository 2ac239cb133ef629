"""Language identification (C2) as Spark jobs: a character-trigram naive
Bayes model with add-one smoothing.

Training: explode the trigrams of labelled texts and count them per
(language, trigram) -- partial aggregation, so a frequent trigram only adds to
a partial count.  Scoring: a text's score for a language is

    sum over its trigrams g of count(g) * log P(g | lang)
  = n_trigrams * log P(unseen | lang) + sum over seen g of count(g) * delta(lang, g)

so only the trigrams the model has seen are joined (broadcast when the model's
counted size allows, else salted, since a common trigram is a hot key), and
the unseen mass is
one multiplication per (text, language).  The best language wins; scores are
rounded before the comparison and ties go to the smaller language code.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polytext.operators.joins import lookup_join
from polytext.operators.layout import spread
from polytext.session import ensure_checkpoint_dir

NGRAM = 3
SCORE_DIGITS = 6


# every overlapping window of NGRAM code points: a match takes one code point
# (an empty match would stop between the halves of a supplementary one)
TRIGRAMS = r"(?s)(?=(.{%d}))." % NGRAM


def _grams(df: DataFrame, keep: list[str], text: str) -> DataFrame:
    """(keep..., gram) rows: overlapping character trigrams of the lower-cased
    text, found by one regex pass (no per-element lambda)."""
    rows = spread(df.select(*keep, text))
    return rows.select(*keep, F.explode(F.regexp_extract_all(F.lower(F.col(text)), F.lit(TRIGRAMS), 1))
                       .alias("gram"))


def train(labelled: DataFrame, text: str = "text", lang: str = "lang") -> tuple[DataFrame, DataFrame]:
    """Returns (model: lang, gram, delta) and (per_lang: lang, unseen_lp).  Rows
    without a label teach nothing."""
    grams = _grams(labelled.where(F.col(lang).isNotNull()), [lang], text)
    # the trained counts are materialised once (checkpoint in the shared
    # folder): the vocabulary size, the language totals and the model all
    # read them, and the lineage back to the corpus is cut
    ensure_checkpoint_dir(labelled.sparkSession)
    counts = grams.groupBy(lang, "gram").agg(F.count(F.lit(1)).alias("c")).checkpoint(eager=True)
    n_vocab = counts.select("gram").distinct().count()  # one scalar
    # one row per language label (a small closed set)
    per_lang = counts.groupBy(lang).agg(F.sum("c").alias("N")).select(
        lang, (F.col("N") + n_vocab).alias("_den"), F.log(F.lit(1.0) / (F.col("N") + n_vocab)).alias("unseen_lp"))
    model = counts.join(F.broadcast(per_lang), lang).select(
        lang, "gram", (F.log((F.col("c") + 1) / F.col("_den")) - F.col("unseen_lp")).alias("delta"))
    return model, per_lang.select(lang, "unseen_lp")


def detect(df: DataFrame, model: DataFrame, per_lang: DataFrame, key: str, text: str = "text",
           lang: str = "lang") -> DataFrame:
    """(key, detected, score) for every row; 'none' for texts without trigrams."""
    # the language table is tiny: its rows become literal columns, and the model
    # is pivoted to one row a trigram with a delta for each language.  Trigrams
    # meet it in one left join; sums and counts are one hash aggregate a text,
    # partial within the task that read the text.
    langs = [(r[0], r[1]) for r in per_lang.select(lang, "unseen_lp").orderBy(lang).collect()]
    if not langs:
        return df.select(key, F.lit("none").alias("detected"), F.lit(None).cast("double").alias("score"))
    wide = model.groupBy("gram").agg(*[F.sum(F.when(F.col(lang) == name, F.col("delta"))).alias(f"_d{i}")
                                       for i, (name, _) in enumerate(langs)])
    g = _grams(df, [key], text)
    sc = lookup_join(g, wide, ["gram"], "left", salt_by=F.col(key).cast("string")).groupBy(key).agg(
        F.count(F.lit(1)).alias("_tot"), *[F.sum(f"_d{i}").alias(f"_s{i}") for i in range(len(langs))])
    scores = [F.round(F.col("_tot") * F.lit(lp) + F.coalesce(F.col(f"_s{i}"), F.lit(0.0)), SCORE_DIGITS)
              for i, (_, lp) in enumerate(langs)]
    sc = sc.select(key, *[x.alias(f"_c{i}") for i, x in enumerate(scores)])
    best = F.greatest(*[F.col(f"_c{i}") for i in range(len(langs))]) if len(langs) > 1 else F.col("_c0")
    # highest score; ties go to the smaller language code (codes are in order)
    pick = F.lit(None).cast("string")
    for i in reversed(range(len(langs))):
        pick = F.when(F.col(f"_c{i}") == F.col("_best"), F.lit(langs[i][0])).otherwise(pick)
    top = sc.withColumn("_best", best).select(key, pick.alias("detected"), F.col("_best").alias("score"))
    out = df.select(key).join(top, key, "left")
    return out.select(key, F.coalesce("detected", F.lit("none")).alias("detected"), "score")


def accuracy(detected: DataFrame, truth: DataFrame, key: str, lang: str = "lang", by: list[str] | None = None
             ) -> DataFrame:
    """Confusion counts (true language x detected), optionally split by
    ``by`` columns of ``truth`` (e.g. a hold-out flag)."""
    by = by or []
    j = detected.join(truth.select(key, lang, *by), key)
    return j.groupBy(*by, lang, "detected").agg(F.count(F.lit(1)).alias("n"))
