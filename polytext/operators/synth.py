"""Synthetic-data plans: pivot counts (E6), output-language weights (H1),
weighted draws (H2), back-translation (H4) and pivot (H5) request plans, the
source filters (C4, C5) and the conversion of accepted pairs (B19).

Randomness is the md5 uniform of ``functions.rand``: a draw is keyed by the
row's natural key and the draw number, so the plan gives the same requests on
any partitioning and under task retries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polytext.functions import langs as L
from polytext.functions.rand import hash_u32
from polytext.operators.joins import salted_join

# Draws of one row are split into chunks of this many before they are
# exploded, so that a hot (heavily repeated) pair spreads over many tasks.
DRAW_CHUNK = 1 << 16


def _weights_array() -> Column:
    return F.array(*[F.struct(F.lit(n).alias("lang"), F.lit(w).alias("w")) for n, w in L.HI_RES_WEIGHTS])


def pivot_source_filter(df: DataFrame) -> DataFrame:
    """C4: translate entries, no 'bible' source, generic source is high-resource."""
    g = L.gen_lang_synth("src_lang")
    return df.where((F.col("task") == "translate") & ~F.col("src_lang").contains("bible")
                    & L.is_high_resource(g))


def bt_source_filter(df: DataFrame) -> DataFrame:
    """Generate (monolingual) entries whose generic language is not high."""
    return df.where((F.col("task") == "generate") & ~L.is_high_resource(L.gen_lang_synth("src_lang")))


def pivot_counts(entries: DataFrame) -> DataFrame:
    """Occurrences per (low lang, low segment, generic high lang, high segment)."""
    return (pivot_source_filter(entries)
            .groupBy(F.col("tgt_lang").alias("lo_lang"), F.col("tgt_segm").alias("lo_segm"),
                     L.gen_lang_synth("src_lang").alias("hi_lang"), F.col("src_segm").alias("hi_segm"))
            .agg(F.count(F.lit(1)).alias("cnt")))


def candidate_cdf(excluded: Column | None = None) -> Column:
    """H1: remaining (lang, weight, cum) in table order after removing the
    excluded languages.  Integer weights: normalised weight = w / total."""
    arr = _weights_array()
    if excluded is not None:
        arr = F.filter(arr, lambda x: ~F.array_contains(excluded, x["lang"]))
    return F.transform(arr, lambda x, i: F.struct(
        x["lang"].alias("lang"), x["w"].alias("w"),
        F.aggregate(F.slice(arr, 1, i + 1), F.lit(0), lambda acc, y: acc + y["w"]).alias("cum")))


def cdf_total(cdf: Column) -> Column:
    return F.aggregate(cdf, F.lit(0), lambda acc, y: acc + y["w"])


def weighted_draws(df: DataFrame, keep: list[str], seed_col: str, n_draws: Column, cdf: Column,
                   out: str = "drawn_lang", chunk: int = DRAW_CHUNK) -> DataFrame:
    """H2: ``n_draws`` draws with replacement from the weighted candidates of
    each row, de-duplicated (at most ``n_draws`` distinct results).  No draws
    when the candidates are empty or all have zero weight (Q10).

    ``seed_col`` is a per-row hash of the row's natural key; a row is drawn for
    once.  Up to ``chunk`` draws are made within the row, without a shuffle; a
    larger count is split into chunks that go to different tasks.
    """
    cols = list(dict.fromkeys(keep + [seed_col]))
    total = cdf_total(cdf)
    base = df.select(*cols, cdf.alias("_cdf"), total.alias("_tot"), n_draws.cast("bigint").alias("_k"))
    base = base.where((F.col("_tot") > 0) & (F.col("_k") > 0))

    def place(i: Column) -> Column:
        return F.floor(hash_u32(F.col(seed_col), i) * F.col("_tot") / F.lit(4294967296.0)).cast("bigint")

    def candidate(r: Column) -> Column:
        # the first candidate whose cumulative weight exceeds r: a CASE chain over at most len(HI_RES_WEIGHTS)
        out_col = F.lit(None).cast("string")
        for i in reversed(range(1, len(L.HI_RES_WEIGHTS) + 1)):
            c = F.try_element_at(F.col("_cdf"), F.lit(i))
            out_col = F.when(c["cum"] > r, c["lang"]).otherwise(out_col)
        return out_col

    few = base.where(F.col("_k") <= chunk)
    drawn = F.array_distinct(F.transform(F.transform(F.sequence(F.lit(1).cast("bigint"), F.col("_k")), place), candidate))
    in_row = few.select(*keep, F.explode(drawn).alias(out))
    many = base.where(F.col("_k") > chunk)
    chunks = many.select("*", F.explode(F.sequence(F.lit(0), F.floor((F.col("_k") - 1) / chunk).cast("bigint")))
                         .alias("_chunk"))
    chunks = chunks.repartition(F.col(seed_col), F.col("_chunk"))
    draws = chunks.select("*", F.explode(F.sequence(
        F.col("_chunk") * chunk + 1, F.least(F.col("_k"), (F.col("_chunk") + 1) * chunk))).alias("_i"))
    split = draws.select(*keep, candidate(place(F.col("_i"))).alias(out)).distinct()
    return in_row.unionByName(split)


def bt_plan(entries: DataFrame, key: str = "doc_id") -> DataFrame:
    """H4: back-translation requests for every low-resource monolingual entry:
    multiplier(src_lang) weighted draws over all output languages."""
    src = bt_source_filter(entries).select(
        key, "src_lang", "src_segm",
        F.md5(F.concat_ws("|", F.col(key).cast("string"), "src_lang", "src_segm")).alias("_seed"),
        L.resource_multiplier("src_lang").alias("_mul"))
    drawn = weighted_draws(src, [key, "src_lang", "src_segm"], "_seed", F.col("_mul"), candidate_cdf(None),
                           out="tgt_lang")
    return drawn.select(key, "src_lang", "tgt_lang", "src_segm", F.lit("translate").alias("task"))


def pivot_plan(entries: DataFrame) -> DataFrame:
    """H5: pivot requests.  Candidates exclude the high languages already
    present for the low segment; each (high lang, high segment) pair gets
    count x multiplier(low lang) draws.

    Pairs and low segments are keyed by 256-bit digests: counts, present
    languages and draws move digests only, and the texts, one row a pair, are
    joined to the draws at the end."""
    pair = ["lo_lang", "lo_segm", "hi_lang", "hi_segm"]

    def key(lo_lang: str, lo_segm: str, *more: str) -> Column:
        said = [F.coalesce(F.col(c), F.lit("\x01")) for c in (lo_lang, lo_segm, *more)]  # the low segment's length keeps both apart
        return F.unhex(F.sha2(F.concat_ws("\x1f", said[0], F.char_length(said[1]).cast("string"), *said[1:]), 256))

    e = pivot_source_filter(entries).select(F.col("tgt_lang").alias("lo_lang"), F.col("tgt_segm").alias("lo_segm"),
                                            L.gen_lang_synth("src_lang").alias("hi_lang"), F.col("src_segm").alias("hi_segm"))
    e = e.select("*", key(*pair).alias("_pair"), key("lo_lang", "lo_segm").alias("_low"))
    counts = e.select("_pair", "_low", "lo_lang", "hi_lang", F.md5(F.concat_ws("|", *pair)).alias("_seed")) \
        .groupBy("_pair", "_low", "lo_lang", "hi_lang", "_seed").agg(F.count(F.lit(1)).alias("cnt"))
    # bounded set (<= number of high languages) with map-side partial sets
    present = counts.groupBy("_low").agg(F.collect_set("hi_lang").alias("_present"))
    # a low segment with very many high-side pairs is a hot key: salted join
    j = salted_join(counts, present, ["_low"], "inner", salt_by=F.col("_pair"))
    n = F.col("cnt") * L.resource_multiplier("lo_lang")
    drawn = weighted_draws(j, ["_pair"], "_seed", n, candidate_cdf(F.col("_present")), out="new_hi_res_lang")
    texts = e.groupBy("_pair").agg(*(F.first(c).alias(c) for c in pair))
    return drawn.join(texts, "_pair").select(*pair, "new_hi_res_lang")


def output_lang_weights(counts: DataFrame) -> DataFrame:
    """H1 per low segment: remaining output languages with their normalised
    weight (w / total, one exact division) and cumulative weight."""
    present = counts.groupBy("lo_lang", "lo_segm").agg(F.collect_set("hi_lang").alias("_present"))
    cdf = candidate_cdf(F.col("_present"))
    x = present.select("lo_lang", "lo_segm", cdf.alias("_cdf"), cdf_total(cdf).alias("total"))
    x = x.where(F.col("total") > 0)
    return x.select("lo_lang", "lo_segm", "total", F.inline("_cdf")).select(
        "lo_lang", "lo_segm", "lang", "cum", (F.col("w") / F.col("total")).alias("weight"))


def accepted_to_entries(scored: DataFrame, flt: str = "flt", hyp: str = "hyp_output",
                        keep: list | None = None) -> DataFrame:
    """Keep 'ok' pivot results and swap direction: the hypothesis becomes
    the source (language '<new>, synth'), the low segment the target."""
    return scored.where(F.col(flt) == "ok").select(*(keep or []),
        F.col(hyp).alias("src_segm"), F.concat(F.col("new_hi_res_lang"), F.lit(", synth")).alias("src_lang"),
        F.col("lo_segm").alias("tgt_segm"), F.col("lo_lang").alias("tgt_lang"),
        F.lit("approx-translate").alias("task"))
