"""Corpus metrics per language-pair group: BLEU (E1), chrF (E2), the ragged
group sets (E3), macro averages per class (E4), and positional re-pairing of
inputs with outputs (D3, F3).

Plan shape: the clipped and total n-gram counts of a pair are found within its
row, by a vectorised (Arrow) function on integer codes, so no n-gram becomes a
row.  These per-row statistics (integers) are exploded into the row's group
labels and summed with partial aggregation; the closed-form score is computed
from the sums.  A hot group only adds to a partial sum.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polytext.functions.langs import gen_lang_metric, resource_tier
from polytext.functions.text import remove_ws, tok13a
from polytext.operators.frames import SLICE_BYTES, cuts, text_bytes
from polytext.operators.layout import spread

# Metric settings (library defaults of sacreBLEU BLEU / chrF).
BLEU_ORDER = 4
CHRF_ORDER = 6
CHRF_BETA = 2
CHRF_EPS = 1e-16
BLEU_LOG_ZERO = -9999999999.0

def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _common(ka: np.ndarray, kb: np.ndarray, most: int) -> int:
    """Size of the intersection of two multisets of numbers below ``most``, at most 2**62."""
    if most <= 4 * (len(ka) + len(kb)):
        return int(np.minimum(np.bincount(ka, minlength=most), np.bincount(kb, minlength=most)).sum())
    both = np.sort(np.concatenate([ka << 1, kb << 1 | 1]))
    key = both >> 1
    starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    right = np.add.reduceat(both & 1, starts)
    return int(np.minimum(right, np.diff(np.append(starts, len(both))) - right).sum())


def ngram_matches(a: np.ndarray, b: np.ndarray, orders: int) -> list[int]:
    """Clipped n-gram matches of two integer sequences for each order.  An
    n-gram's number is found from that of its first n - 1 items and its last
    item, so no n-gram is built as a string; numbers are made dense again only
    before they pass 62 bits."""
    out = []
    first = np.unique(np.concatenate([a, b]), return_inverse=True)[1].astype(np.int64)
    fa, fb = first[:len(a)], first[len(a):]
    width = int(first.max(initial=0)) + 1
    ka, kb, most = fa, fb, width  # numbers are below ``most``
    for n in range(1, orders + 1):
        if n > 1:
            if most * width >= 1 << 62:
                dense = np.unique(np.concatenate([ka, kb]), return_inverse=True)[1].astype(np.int64)
                ka, kb, most = dense[:len(ka)], dense[len(ka):], int(dense.max(initial=0)) + 1
            ka, kb, most = ka[:-1] * width + fa[n - 1:], kb[:-1] * width + fb[n - 1:], most * width
        if not len(ka) or not len(kb):
            return out + [0] * (orders + 1 - n)
        out.append(_common(ka, kb, most))
    return out


_COUNTS = (["sys_len", "ref_len", "_lch", "_lcr"] + [f"bleu_correct_{n}" for n in range(1, BLEU_ORDER + 1)]
           + [f"chrf_match_{n}" for n in range(1, CHRF_ORDER + 1)])


def _pair_counts(hyp_toks: str, ref_toks: str, hyp_chars: str, ref_chars: str) -> list[int]:
    numbers: dict[str, int] = {}
    th, tr = (np.array([numbers.setdefault(w, len(numbers)) for w in t.split(" ") if w], dtype=np.int64)
              for t in (hyp_toks, ref_toks))
    ch, cr = (np.frombuffer(t.encode("utf-32-le"), np.uint32).astype(np.int64) for t in (hyp_chars, ref_chars))
    return [len(th), len(tr), len(ch), len(cr), *ngram_matches(th, tr, BLEU_ORDER), *ngram_matches(ch, cr, CHRF_ORDER)]


def row_statistics(df: DataFrame, row_id: str, hyp: str, ref: str, keep: list[str] | None = None) -> DataFrame:
    """Per-row sufficient statistics for BLEU and chrF.

    Output: row_id, keep..., sys_len, ref_len, bleu_total_n, bleu_correct_n
    (n = 1..4), chrf_hyp_n, chrf_ref_n, chrf_match_n (n = 1..6); all bigint.
    The counts of a pair are found within its row by a vectorised (Arrow)
    function, so no n-gram becomes a row and nothing is shuffled.
    """
    keep = keep or []

    @F.arrow_udf("array<long>")
    def counts(th: pa.Array, tr: pa.Array, ch: pa.Array, cr: pa.Array) -> pa.Array:
        found = []
        for first, end in cuts(text_bytes(th, tr, ch, cr), SLICE_BYTES):  # texts become objects slice by slice
            texts = zip(*(x.slice(first, end - first).to_pylist() for x in (th, tr, ch, cr)))
            found.append(np.array([_pair_counts(*(x or "" for x in t)) for t in texts], np.int64).ravel())
        ends = np.arange(len(th) + 1, dtype=np.int32) * len(_COUNTS)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int64), *found])))

    x = counts(tok13a(hyp), tok13a(ref), remove_ws(hyp), remove_ws(ref))
    per_row = df.select(F.col(row_id), *keep, x.alias("_x")).select(
        row_id, *keep, *[F.col("_x")[i].alias(c) for i, c in enumerate(_COUNTS)])
    # totals follow from the lengths: max(len - n + 1, 0) per row
    return per_row.select(
        row_id, *keep, "sys_len", "ref_len",
        *[F.greatest(F.col("sys_len") - (n - 1), F.lit(0)).alias(f"bleu_total_{n}")
          for n in range(1, BLEU_ORDER + 1)],
        *[f"bleu_correct_{n}" for n in range(1, BLEU_ORDER + 1)],
        *[F.greatest(F.col("_lch") - (n - 1), F.lit(0)).alias(f"chrf_hyp_{n}") for n in range(1, CHRF_ORDER + 1)],
        *[F.greatest(F.col("_lcr") - (n - 1), F.lit(0)).alias(f"chrf_ref_{n}") for n in range(1, CHRF_ORDER + 1)],
        *[f"chrf_match_{n}" for n in range(1, CHRF_ORDER + 1)])


STAT_COLS = (["sys_len", "ref_len"] + [f"bleu_total_{n}" for n in range(1, BLEU_ORDER + 1)]
             + [f"bleu_correct_{n}" for n in range(1, BLEU_ORDER + 1)]
             + [f"chrf_hyp_{n}" for n in range(1, CHRF_ORDER + 1)]
             + [f"chrf_ref_{n}" for n in range(1, CHRF_ORDER + 1)]
             + [f"chrf_match_{n}" for n in range(1, CHRF_ORDER + 1)])


def sum_statistics(stats: DataFrame, by: list[str]) -> DataFrame:
    return stats.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"),
                                  *[F.sum(c).cast("bigint").alias(c) for c in STAT_COLS])


def bleu_from_sums() -> Column:
    """Corpus BLEU (exp smoothing, brevity penalty) from summed statistics."""
    sys_len, ref_len = F.col("sys_len"), F.col("ref_len")
    bp = (F.when(sys_len < ref_len, F.when(sys_len > 0, F.exp(1 - ref_len / sys_len)).otherwise(0.0))
          .otherwise(1.0))
    logs = []
    zeros_so_far = F.lit(0)
    for n in range(1, BLEU_ORDER + 1):
        tot, cor = F.col(f"bleu_total_{n}"), F.col(f"bleu_correct_{n}")
        zeros_so_far = zeros_so_far + F.when((tot > 0) & (cor == 0), 1).otherwise(0)
        p = (F.when(tot == 0, F.lit(0.0))
             .when(cor == 0, F.lit(100.0) / (F.pow(F.lit(2.0), zeros_so_far) * tot))
             .otherwise(F.lit(100.0) * cor / tot))
        logs.append(F.when(p == 0, F.lit(BLEU_LOG_ZERO)).otherwise(F.log(p)))
    s = logs[0]
    for x in logs[1:]:
        s = s + x
    any_correct = sum((F.col(f"bleu_correct_{n}") for n in range(2, BLEU_ORDER + 1)), F.col("bleu_correct_1")) > 0
    return F.when(any_correct, bp * F.exp(s / BLEU_ORDER)).otherwise(0.0)


def chrf_from_sums() -> Column:
    """Corpus chrF (beta 2): precision / recall averaged over the orders that
    occur on both sides."""
    precs, recs, effs = [], [], []
    for n in range(1, CHRF_ORDER + 1):
        h, r, m = F.col(f"chrf_hyp_{n}"), F.col(f"chrf_ref_{n}"), F.col(f"chrf_match_{n}")
        both = (h > 0) & (r > 0)
        precs.append(F.when(both, m / h).otherwise(0.0))
        recs.append(F.when(both, m / r).otherwise(0.0))
        effs.append(F.when(both, 1).otherwise(0))
    sp, sr, se = precs[0], recs[0], effs[0]
    for a, b, c in zip(precs[1:], recs[1:], effs[1:]):
        sp, sr, se = sp + a, sr + b, se + c
    ap = F.when(se == 0, 0.0).otherwise(sp / se)
    ar = F.when(se == 0, 0.0).otherwise(sr / se)
    f2 = CHRF_BETA * CHRF_BETA
    return F.when(ap + ar > 0, F.lit(100.0) * ((1 + f2) * ap * ar) / (f2 * ap + ar)).otherwise(0.0)


def metric_groups(src_lang, tgt_lang) -> Column:
    """Every row is in 'general: g1 -> g2' and 'classes: t1 -> t2', and in
    'detailed: l1 -> l2' only when that differs from the general pair."""
    s, t = _c(src_lang), _c(tgt_lang)
    det = F.concat(s, F.lit(" -> "), t)
    gen = F.concat(gen_lang_metric(s), F.lit(" -> "), gen_lang_metric(t))
    cls = F.concat(resource_tier(s), F.lit(" -> "), resource_tier(t))
    return F.array_compact(F.array(
        F.concat(F.lit("general: "), gen),
        F.when(det != gen, F.concat(F.lit("detailed: "), det)),
        F.concat(F.lit("classes: "), cls)))


def corpus_metrics(inputs: DataFrame, outputs: DataFrame, index: str = "hyp_index", hyp: str = "hyp_output",
                   ref: str = "tgt_segm", src_lang: str = "src_lang", tgt_lang: str = "tgt_lang",
                   digits: int = 2) -> DataFrame:
    """E1+E2+E3 with D3: pair inputs and outputs on the explicit index (never by
    position), score every row once, then sum its statistics into each of its
    groups.  Rows without a reference are not scored."""
    pairs = (inputs.select(index, src_lang, tgt_lang, ref).where(F.col(ref).isNotNull())
             .join(outputs.select(index, hyp), index, "inner"))
    stats = row_statistics(spread(pairs), index, hyp, ref, keep=[src_lang, tgt_lang])
    grouped = stats.select(F.explode(metric_groups(src_lang, tgt_lang)).alias("lp"), *STAT_COLS)
    sums = sum_statistics(grouped, ["lp"])
    return sums.select("lp", "n_rows", F.round(bleu_from_sums(), digits).alias("bleu"),
                       F.round(chrf_from_sums(), digits).alias("chrf"))


def macro_average_by_class(stats: DataFrame, lp_col: str, class_col: str, digits: int = 2) -> DataFrame:
    """Score per language pair, then the unweighted mean of the pair scores
    of each class pair.  Output is the long score table (key, score) of A15."""
    per_lp = sum_statistics(stats, [lp_col, class_col]).select(
        lp_col, class_col, bleu_from_sums().alias("bleu"), chrf_from_sums().alias("chrf"))
    lp_rows = per_lp.select(F.explode(F.array(
        F.struct(F.concat(F.col(lp_col), F.lit("-bleu")).alias("key"), F.col("bleu").alias("score")),
        F.struct(F.concat(F.col(lp_col), F.lit("-chrf")).alias("key"), F.col("chrf").alias("score")))).alias("x"))
    avg_rows = per_lp.groupBy(class_col).agg(F.avg("bleu").alias("bleu"), F.avg("chrf").alias("chrf")).select(
        F.explode(F.array(
            F.struct(F.concat(F.col(class_col), F.lit("-bleu")).alias("key"), F.col("bleu").alias("score")),
            F.struct(F.concat(F.col(class_col), F.lit("-chrf")).alias("key"), F.col("chrf").alias("score"))))
        .alias("x"))
    return lp_rows.unionByName(avg_rows).select("x.key", F.round("x.score", digits).alias("score"))


def order_by_index(df: DataFrame, index: str = "hyp_index", value: str = "hyp_output") -> DataFrame:
    """outputs sorted by their index (range-partitioned global sort)."""
    return df.select(index, value).orderBy(index)
