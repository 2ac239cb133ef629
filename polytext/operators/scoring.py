"""Batch model scoring (J1-J3), the over-length gate (C9), hypothesis caches
(D9), memoised translation of tuples (D8), sequence log-probabilities (E19)
and vector-table differences (D12).

A model is any picklable callable ``list[str] -> list[str]`` (optionally
returning ``(outputs, mean_logprobs)``).  It runs inside ``mapInArrow``, on a
chunk of prompts at a time; the callable is built once per task by its factory, not once
per batch.  The engine ships a deterministic stub model only.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from polytext.operators.frames import SLICE_BYTES
from polytext.operators.joins import hot_join
from polytext.operators.qc import OVERLENGTH_LOGPROB, OVERLENGTH_TOKENS
from polytext.session import ensure_checkpoint_dir

class ReverseWordsModel:
    """Deterministic stub 'translator': the words of the prompt in reverse
    order (split on single spaces)."""

    name = "reverse-words"

    def __call__(self, prompts: list[str]) -> list[str]:
        return [" ".join(reversed(p.split(" "))) for p in prompts]


def _called(model: Callable, chunk: list[str], max_attempts: int) -> tuple[list[str], list[float | None]]:
    res = None
    for attempt in range(max_attempts):
        try:
            res = model(chunk)
            break
        except Exception:  # noqa: BLE001 - retried, then re-raised
            if attempt + 1 == max_attempts:
                raise
            time.sleep(min(2 ** attempt, 30))
    res, lp = res if isinstance(res, tuple) else (res, [None] * len(chunk))
    if len(res) != len(chunk):
        raise RuntimeError(f"model returned {len(res)} outputs for {len(chunk)} inputs")
    return res, lp


def scored_batches(batches: Iterator[pa.RecordBatch], model: Callable, prompt: str, out: str, batch_size: int,
                   max_attempts: int) -> Iterator[pa.RecordBatch]:
    """The batches with outputs and log-probs, in slices of about ``SLICE_BYTES`` of outputs."""
    for b in batches:
        start, size, outs, probs = 0, 0, [], []
        for i in range(0, b.num_rows, batch_size):
            texts = b.column(prompt).slice(i, batch_size)
            res, lp = _called(model, ["" if x is None else str(x) for x in texts.to_pylist()], max_attempts)
            outs.extend(res)
            probs.extend(lp)
            size += sum(map(len, res))
            if size >= SLICE_BYTES or i + batch_size >= b.num_rows:
                own = b.slice(start, len(outs))
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(outs, pa.string()), pa.array(probs, pa.float64())],
                                                 names=[*own.schema.names, out, "hyp_mean_logprob"])
                start, size, outs, probs = start + len(outs), 0, [], []


def score_batches(df: DataFrame, prompt: str, factory: Callable[[], Callable] = ReverseWordsModel,
                  out: str = "hyp_output", batch_size: int = 32, n_tokens: str | None = None,
                  max_tokens: int = OVERLENGTH_TOKENS, max_attempts: int = 1) -> DataFrame:
    """J1 (+J3 chunking, +C9 gate): one output per row, all columns kept.

    Rows whose ``n_tokens`` exceed ``max_tokens`` are not sent to the model:
    they get '' and log-prob -100 (split before the Python stage, since
    filters are not pushed through it).  Calls are made in chunks of
    ``batch_size`` prompts; a chunk is retried up to ``max_attempts`` times and
    its result must have one output per prompt.
    """
    schema = T.StructType(df.schema.fields + [T.StructField(out, T.StringType()),
                                              T.StructField("hyp_mean_logprob", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return scored_batches(batches, factory(), prompt, out, batch_size, max_attempts)

    if n_tokens is None:
        return df.mapInArrow(run, schema)
    over = F.coalesce(F.col(n_tokens) > max_tokens, F.lit(False))  # an unknown length is sent to the model
    scored = df.where(~over).mapInArrow(run, schema)
    skipped = df.where(over).select("*", F.lit("").alias(out), F.lit(OVERLENGTH_LOGPROB).alias("hyp_mean_logprob"))
    return scored.unionByName(skipped)


def batched_enrichment(df: DataFrame, text: str, src_lang: str, tgt_lang: str, allowed: list[str],
                       factory: Callable[[], Callable], out: str = "hyp_output", batch_size: int = 8,
                       max_attempts: int = 5) -> DataFrame:
    """J2 (+C8): rows whose two languages are both served are sent in chunks
    of 8 with up to 5 attempts; other rows get NULL (the pair is skipped)."""
    ok = F.coalesce(F.col(src_lang).isin(allowed) & F.col(tgt_lang).isin(allowed), F.lit(False))
    served = score_batches(df.where(ok), text, factory, out=out, batch_size=batch_size, max_attempts=max_attempts)
    rest = df.where(~ok).select("*", F.lit(None).cast("string").alias(out),
                                F.lit(None).cast("double").alias("hyp_mean_logprob"))
    return served.unionByName(rest)


def hyp_cache_reuse(requests: DataFrame, cache: DataFrame, keys: list[str], prompt: str,
                    factory: Callable[[], Callable] = ReverseWordsModel, out: str = "hyp_output") -> DataFrame:
    """Reuse cached hypotheses; of the requests that miss, equal keys are
    scored once.  Of several cached hypotheses for equal keys the smallest is
    taken, so a request never multiplies; a request with a null key is never
    cached and is scored by itself."""
    null_key = F.lit(False)
    for k in keys:
        null_key = null_key | F.col(k).isNull()
    known = cache.groupBy(*keys).agg(F.min(out).alias(out))
    asked = requests.where(~null_key)
    todo = asked.select(*keys).distinct() if prompt in keys else asked.groupBy(*keys).agg(F.min(prompt).alias(prompt))
    new = score_batches(todo.join(known.select(*keys), keys, "left_anti"), prompt, factory, out=out)
    known = known.unionByName(new.select(*known.columns))
    # a sentence that many requests share is a hot key
    found = hot_join(asked, known, keys, "inner", salt_by=F.struct(*requests.columns))
    alone = score_batches(requests.where(null_key), prompt, factory, out=out)
    return found.select(*requests.columns, out).unionByName(alone.select(*requests.columns, out))


def translate_with_cache(requests: DataFrame, path: str, corpus: str, run: str, factory: Callable[[], Callable] = ReverseWordsModel,
                         src: str = "src_lang", tgt: str = "tgt_lang", segm: str = "src_segm", out: str = "hyp_output") -> DataFrame:
    """D9 + A9 + A16: the hypothesis of every request, by language pair and
    sentence.  Sentences that the cache lacks are scored once each and added to
    it under ``run``; a run that is repeated adds nothing.  Null languages or
    sentences count as empty."""
    from polytext.sources.files import read_hyp_cache, upsert_hyp_cache

    spark = requests.sparkSession
    keys = ["cache_src", "cache_tgt", "digest"]
    r = requests.select("*", F.coalesce(src, F.lit("")).alias("cache_src"), F.coalesce(tgt, F.lit("")).alias("cache_tgt"),
                        F.sha2(F.coalesce(segm, F.lit("")).cast("binary"), 256).alias("digest"))
    cache = read_hyp_cache(spark, path, corpus)
    todo = r.select(*keys, F.coalesce(segm, F.lit("")).alias("segm")).join(cache.select(*keys), keys, "left_anti").distinct()
    upsert_hyp_cache(score_batches(todo, "segm", factory, out="hyp").select(*keys, "hyp"), path, corpus, run)
    known = read_hyp_cache(spark, path, corpus).groupBy(*keys).agg(F.min("hyp").alias(out))
    found = hot_join(r, known, keys, "left", salt_by=F.struct(*requests.columns))
    return found.select(*requests.columns, out)


def memo_translate_fill(tuples: DataFrame, missing: DataFrame, key_rank: Column,
                        factory: Callable[[], Callable] = ReverseWordsModel) -> DataFrame:
    """Every distinct (src, tgt, sentence) is translated once, written
    back to every tuple that needs it; with several source languages for one
    missing language the last source in key order wins.  ``missing`` is the
    output of D7 (tuple_id, src, tgt, sentence); returns (tuple_id, key,
    value) rows to add to the tuples."""
    ensure_checkpoint_dir(missing.sparkSession)
    digest = F.unhex(F.sha2(F.col("sentence").cast("binary"), 256))
    known = missing.where(F.col("src").isNotNull() & F.col("tgt").isNotNull() & F.col("sentence").isNotNull())
    # who needs what is settled on digests; a sentence is moved once to its languages, a translation once to the tuples
    asks = known.select("tuple_id", "src", "tgt", key_rank.alias("_rank"), digest.alias("_d")).checkpoint(eager=True)
    keys = ["src", "tgt", "_d"]
    last = asks.groupBy("tuple_id", "tgt").agg(F.max_by(F.struct("src", "_d"), "_rank").alias("_x")).select(
        "tuple_id", "tgt", "_x.src", "_x._d").checkpoint(eager=True)
    todo = asks.select(*keys).distinct().join(last.select(*keys).distinct().withColumn("_used", F.lit(True)), keys, "left")
    sentences = known.select("sentence").distinct().select(digest.alias("_d"), "sentence")
    done = score_batches(sentences.join(todo, "_d"), "sentence", factory, out="translation")
    done = done.where("_used").select(*keys, "translation")
    back = hot_join(last, done, keys, "left", salt_by=F.col("tuple_id"))
    return back.select("tuple_id", F.col("tgt").alias("key"), F.col("translation").alias("value"))


def sequence_mean_logprob(logits: DataFrame, start: int) -> DataFrame:
    """Per sequence, mean over generated positions of
    log_softmax(logits[p])[token[p + 1]] for p >= start - 1 (logits shifted by
    one; prompt positions excluded).  Log-sum-exp is max-shifted."""
    nxt = logits.select("seq_id", (F.col("pos") - 1).alias("pos"), F.col("token").alias("_next"))
    j = logits.join(nxt, ["seq_id", "pos"], "inner").where(F.col("pos") >= start - 1)
    # one-pass (online) log-sum-exp: the running maximum lives in the
    # accumulator, so no outer expression is re-evaluated per element
    init = F.struct(F.lit(float("-inf")).alias("m"), F.lit(0.0).alias("s"))

    def step(acc, x):
        x = x.cast("double")
        m = F.greatest(acc["m"], x)
        return F.struct(m.alias("m"), (acc["s"] * F.exp(acc["m"] - m) + F.exp(x - m)).alias("s"))

    lse = F.aggregate("logits", init, step, lambda acc: acc["m"] + F.log(acc["s"]))
    lp = F.element_at("logits", F.col("_next") + 1).cast("double") - lse
    return j.groupBy("seq_id").agg(F.avg(lp).alias("mean_logprob"))


def vector_table_diff(a: DataFrame, b: DataFrame, name: str = "name", vec: str = "vec",
                      skip_pattern: str | None = None) -> DataFrame:
    """Two snapshots keyed by name (key sets must match, else the job
    fails); mean signed element difference over all elements, optionally
    skipping names containing ``skip_pattern``."""
    j = a.select(name, F.col(vec).alias("_a")).join(b.select(name, F.col(vec).alias("_b")), name, "full_outer")
    j = j.select(name, F.when(F.col("_a").isNull() | F.col("_b").isNull(),
                              F.raise_error(F.concat(F.lit("key sets differ at "), F.col(name))))
                       .when(F.size("_a") != F.size("_b"), F.raise_error(F.concat(F.lit("lengths differ at "), F.col(name))))
                 .otherwise(F.lit(True)).alias("_ok"), "_a", "_b")
    if skip_pattern:
        j = j.where(~F.col(name).contains(skip_pattern))
    d = F.zip_with("_a", "_b", lambda x, y: x.cast("double") - y.cast("double"))
    per = j.select(F.aggregate(d, F.lit(0.0), lambda acc, x: acc + x).alias("_s"), F.size(d).alias("_n"), "_ok")
    return per.agg((F.sum("_s") / F.sum("_n")).alias("mean_diff"), F.sum("_n").alias("n_elements"),
                   F.count_if("_ok").alias("n_tensors"))
