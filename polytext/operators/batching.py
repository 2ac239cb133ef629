"""Global order, batching and sharding.

The central primitive is ``dense_index``: a 0-based index in a total order,
optionally restarting per group, computed in two passes -- range partitioning
+ a per-partition count table + offsets -- so it never funnels rows through a
single task (an unpartitioned window would) and a hot group is spread over as
many range partitions as its size needs.  The partitioned, tagged rows are
checkpointed to the shared checkpoint folder first, so both passes see the
same partitions even after an executor loss.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from polytext.functions.rand import hash_u32, uniform
from polytext.operators.joins import salted_join
from polytext.session import ensure_checkpoint_dir


def _cols(xs) -> list[Column]:
    return [F.col(x) if isinstance(x, str) else x for x in xs]


def dense_index(df: DataFrame, order_by: list, group_by: list[str] | None = None, out: str = "idx",
                partitions: int | None = None, checkpoint: bool = True) -> DataFrame:
    """0-based dense index of every row in the total order ``order_by``
    (which must break ties), restarting at 0 for every ``group_by`` group."""
    group_by = group_by or []
    spark = df.sparkSession
    keys = [F.col(g) for g in group_by] + _cols(order_by)
    # without an explicit count, adaptive execution sizes the range partitions
    ranged = df.repartitionByRange(partitions, *keys) if partitions else df.repartitionByRange(*keys)
    tagged = (ranged.sortWithinPartitions(*keys)
              .select("*", F.spark_partition_id().alias("_pid"), F.monotonically_increasing_id().alias("_mid")))
    if checkpoint:
        ensure_checkpoint_dir(spark)
        tagged = tagged.checkpoint(eager=True)
    tagged = tagged.withColumn("_pos", F.col("_mid") - F.shiftleft(F.col("_pid").cast("bigint"), 33))
    # rows of one group in one partition are contiguous; count them per (group, partition)
    counts = tagged.groupBy(*group_by, "_pid").agg(F.count(F.lit(1)).alias("_n"), F.min("_pos").alias("_first"))
    w = Window.partitionBy(*group_by).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*group_by, "_pid", "_first",
                            F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    # the offsets table has one row per (group, partition): at most
    # partitions + groups rows; adaptive execution broadcasts it when small.
    j = tagged.join(offsets, [*group_by, "_pid"], "inner")
    return j.select(*df.columns, (F.col("_off") + F.col("_pos") - F.col("_first")).alias(out))


def round_robin(idx: str, processes: int) -> Column:
    """row i goes to process i mod P."""
    return F.pmod(F.col(idx), F.lit(processes))


def reassemble_order(idx: str, processes: int) -> list[Column]:
    """interleaving per-process lists back = order by (pos in shard, shard),
    which is the original index order."""
    return [F.floor(F.col(idx) / processes), F.pmod(F.col(idx), F.lit(processes))]


def shuffle_key(seed: int | str, *cols) -> Column:
    """a uniform permutation key (md5 of the row key and a seed)."""
    return uniform(*cols, F.lit(str(seed)))


def pad_to_multiple(df: DataFrame, key: str, batch_size: int, group_by: list[str] | None = None, seed: str = "pad",
                    out_copy: str = "pad_copy") -> DataFrame:
    """Pad every group to a multiple of ``batch_size`` with random members.

    Members are ranked by a hash of (key, seed); padding copy j takes the
    member of rank ((j - 1) mod group size) + 1, i.e. distinct members while
    the group is large enough and repeats (with replacement, as the reference
    does) only when it is smaller than the padding it needs.  Only ranks below
    ``batch_size`` are ever needed, so ``row_number() <= B - 1`` is planned as
    a group limit that keeps at most B - 1 rows per group *before* the
    shuffle -- no full index of the data, and a hot group ships B - 1 rows.
    Returned rows carry ``pad_copy`` = 0 for originals and 1.. for copies."""
    group_by = group_by or []
    sizes = df.groupBy(*group_by).agg(F.count(F.lit(1)).alias("_cnt"))
    need = sizes.select(*group_by, "_cnt", F.pmod(-F.col("_cnt"), F.lit(batch_size)).alias("_need"))
    slots = need.where(F.col("_need") > 0).select(
        *group_by, "_cnt", F.explode(F.sequence(F.lit(1), F.col("_need"))).alias(out_copy))
    slots = slots.select(*group_by, out_copy, (F.pmod(F.col(out_copy) - 1, F.col("_cnt")) + 1).alias("_rk"))
    order = [uniform(F.col(key), F.lit(seed)), F.col(key)]
    if group_by:
        w = Window.partitionBy(*group_by).orderBy(*order)
        ranked = df.select("*", F.row_number().over(w).alias("_rk")).where(F.col("_rk") <= batch_size - 1)
    else:
        # one group: a distributed top-k (each partition sends at most B - 1
        # rows), then ranks over those few rows
        top = df.orderBy(*order).limit(batch_size - 1)
        ranked = top.select("*", F.row_number().over(Window.orderBy(*order)).alias("_rk"))
    copies = ranked.join(slots, [*group_by, "_rk"], "inner").drop("_rk")
    return df.withColumn(out_copy, F.lit(0)).unionByName(copies)


def length_sorted_batches(df: DataFrame, key: str, length: str, batch_size: int, seed: str = "batches") -> DataFrame:
    """pad to a multiple of B with random duplicates, sort by length
    descending (ties by key), cut into batches of B, and give the batches a
    random order (``batch_order``)."""
    padded = pad_to_multiple(df, key, batch_size, seed=seed)
    idx = dense_index(padded, [F.col(length).desc(), F.col(key), F.col("pad_copy")], out="_i")
    b = F.floor(F.col("_i") / batch_size).cast("bigint")
    return idx.select(*padded.columns, b.alias("batch_id"), F.pmod(F.col("_i"), F.lit(batch_size))
                      .alias("row_in_batch"), uniform(b, F.lit(seed)).alias("batch_order"))


def bin_batches(df: DataFrame, key: str, length: str, bins: list[str], batch_size: int, sort_by_len: bool = True,
                seed: str = "bins") -> DataFrame:
    """per bin: pad to a multiple of B with random members, order by input
    length ascending (or randomly), cut into batches; batches of all bins get
    one random order."""
    padded = pad_to_multiple(df, key, batch_size, group_by=bins, seed=seed)
    order = ([F.col(length), F.col(key), F.col("pad_copy")] if sort_by_len
             else [uniform(F.col(key), F.col("pad_copy"), F.lit(seed)), F.col(key), F.col("pad_copy")])
    idx = dense_index(padded, order, group_by=bins, out="_i")
    b = F.floor(F.col("_i") / batch_size).cast("bigint")
    bkey = [F.col(x).cast("string") for x in bins] + [b.cast("string")]
    return idx.select(*padded.columns, b.alias("batch_in_bin"), F.pmod(F.col("_i"), F.lit(batch_size))
                      .alias("row_in_batch"), uniform(*bkey, F.lit(seed)).alias("batch_order"))


def shard_assign(batch_no: str, shard_size: int) -> Column:
    """F8: shard = batch number div shard size (last shard may be partial)."""
    return F.floor(F.col(batch_no) / shard_size).cast("bigint")


def prefix_sum(df: DataFrame, value: str, order_by: list, out: str = "prefix", partitions: int | None = None
               ) -> DataFrame:
    """Exclusive running sum of ``value`` in the total order ``order_by``,
    computed like ``dense_index``: range partitions, a running sum inside each
    partition (a window per partition id, so all partitions work in
    parallel), per-partition totals and their offsets."""
    spark = df.sparkSession
    keys = _cols(order_by)
    ranged = df.repartitionByRange(partitions, *keys) if partitions else df.repartitionByRange(*keys)
    tagged = ranged.select("*", F.spark_partition_id().alias("_pid"))
    ensure_checkpoint_dir(spark)
    tagged = tagged.checkpoint(eager=True)
    inner = Window.partitionBy("_pid").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    local = tagged.select("*", F.coalesce(F.sum(value).over(inner), F.lit(0)).alias("_local"))
    totals = tagged.groupBy("_pid").agg(F.sum(value).alias("_t"))
    # one row per partition: bounded by the partition count
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_pid", F.coalesce(F.sum("_t").over(w), F.lit(0)).alias("_off"))
    return local.join(offsets, "_pid").select(*df.columns, (F.col("_off") + F.col("_local")).alias(out))


def shard_manifest(df: DataFrame, shard: str = "shard_id") -> DataFrame:
    """A13 manifest / F9: rows per shard and the global position of each
    shard's first row (sum of the sizes of earlier shards).  The shard table
    grows with the data, so the running sum is distributed (``prefix_sum``)."""
    m = df.groupBy(shard).agg(F.count(F.lit(1)).alias("shard_size"))
    return prefix_sum(m, "shard_size", [shard], out="shard_start")


def pad_last_batch(df: DataFrame, key: str, batch_size: int, seed: str = "last") -> DataFrame:
    """shuffle; ceil(n / B) batches; the last batch is filled up with
    random rows of that same batch."""
    idx = dense_index(df, [uniform(F.col(key), F.lit(seed)), F.col(key)], out="_i")
    b = F.floor(F.col("_i") / batch_size).cast("bigint")
    idx = idx.withColumn("batch_id", b).withColumn("pad_copy", F.lit(0))
    n = idx.agg(F.count(F.lit(1)).alias("_n"))
    last = n.select((F.floor((F.col("_n") - 1) / batch_size)).cast("bigint").alias("batch_id"),
                    F.pmod(F.col("_n"), F.lit(batch_size)).alias("_r"),
                    (F.col("_n") - F.pmod(F.col("_n"), F.lit(batch_size))).alias("_start")).where(F.col("_r") > 0)
    slots = last.select("batch_id", "_start", "_r", F.explode(F.sequence(F.lit(1), F.lit(batch_size) - F.col("_r")))
                        .alias("pad_copy"))
    pick = F.floor(hash_u32(F.col("pad_copy"), F.lit(seed)) * F.col("_r") / F.lit(4294967296.0)).cast("bigint")
    slots = slots.select("batch_id", "pad_copy", (F.col("_start") + pick).alias("_i"))
    copies = idx.drop("pad_copy").join(slots, ["batch_id", "_i"], "inner")
    return idx.unionByName(copies.select(*idx.columns)).drop("_i")


def microbatch_plan(batch_size: int, processes: int, per_device: int) -> tuple[int, int]:
    """F11 checks: B % (P * s) == 0; returns (rows per process, accumulation)."""
    if batch_size % (processes * per_device) != 0:
        raise ValueError(f"batch size {batch_size} is not divisible by {processes} x {per_device}")
    return batch_size // processes, batch_size // (processes * per_device)


def microbatch_columns(row_in_batch: str, batch_size: int, processes: int, per_device: int) -> list[Column]:
    """row r of a batch -> process r div (B/P), sub-batch (r mod (B/P)) div s."""
    per_proc, _ = microbatch_plan(batch_size, processes, per_device)
    r = F.col(row_in_batch)
    return [F.floor(r / per_proc).cast("int").alias("process"),
            F.floor(F.pmod(r, F.lit(per_proc)) / per_device).cast("int").alias("sub_batch")]


def lang_to_bins(spec: DataFrame, lang: str = "lang", bin_idx: str = "bin") -> DataFrame:
    """Language -> set of group indices, and the unique choice (0 wins,
    otherwise the smallest) -- partial sets, bounded by the number of groups."""
    return spec.groupBy(lang).agg(F.array_sort(F.collect_set(bin_idx)).alias("bins"),
                                  F.min(bin_idx).alias("bin"))


def bin_pair_choice(pairs: DataFrame, bins: DataFrame, key: str, seed: str = "binpair") -> DataFrame:
    """Per pair, all (src bin, tgt bin) combinations except (1, 1); one is
    picked uniformly (hash-keyed); pairs without a combination are dropped."""
    # one row per language (a bounded dimension): broadcast, so a dominant
    # language is never a hot shuffle key
    sb = F.broadcast(bins.select(F.col("lang").alias("src_lang"), F.col("bins").alias("_sb")))
    tb = F.broadcast(bins.select(F.col("lang").alias("tgt_lang"), F.col("bins").alias("_tb")))
    j = pairs.join(sb, "src_lang", "inner").join(tb, "tgt_lang", "inner")
    combos = F.filter(F.flatten(F.transform("_sb", lambda s: F.transform("_tb", lambda t: F.struct(
        s.alias("s"), t.alias("t"))))), lambda x: ~((x["s"] == 1) & (x["t"] == 1)))
    j = j.select(*pairs.columns, combos.alias("_c")).where(F.size("_c") > 0)
    pick = F.floor(hash_u32(F.col(key), F.lit(seed)) * F.size("_c") / F.lit(4294967296.0)).cast("int")
    ch = F.element_at("_c", pick + 1)
    return j.select(*pairs.columns, ch["s"].alias("src_bin"), ch["t"].alias("tgt_bin"))


def bin_update_stats(binned: DataFrame) -> DataFrame:
    """Totals, coupled-update ratio, dud ratio (dud *bins* over rows, as
    the reference does, plus a row-based ratio), encoder/decoder samples."""
    per_bin = binned.groupBy("src_bin", "tgt_bin").agg(F.count(F.lit(1)).alias("l"))
    s, t, ln = F.col("src_bin"), F.col("tgt_bin"), F.col("l")
    agg = per_bin.agg(
        F.sum(ln).alias("total"),
        F.sum(F.when((s == 0) | (t == 0), ln).otherwise(0)).alias("total_x"),
        F.sum(ln * (F.lit(2) - s - t)).alias("_upd2"),
        F.count_if((s == 1) & (t == 1)).alias("dud_bins"),
        F.sum(F.when((s == 1) & (t == 1), ln).otherwise(0)).alias("dud_rows"),
        F.sum(ln * (F.lit(1) - s)).alias("enc_samples"),
        F.sum(ln * (F.lit(1) - t)).alias("dec_samples"))
    return agg.select("total", "total_x", (F.lit(50.0) * F.col("_upd2") / F.col("total")).alias("coupled_pct"),
                      (F.lit(100.0) * F.col("dud_bins") / F.col("total")).alias("dud_pct"),
                      (F.lit(100.0) * F.col("dud_rows") / F.col("total")).alias("dud_row_pct"),
                      "enc_samples", "dec_samples")


def progress_eta(steps: DataFrame, run: str, ts: str, order: list[str], max_steps: Column | None = None
                 ) -> DataFrame:
    """F1: per run and step: the step's elapsed time (microseconds since the
    previous step), the running mean of those intervals and the ETA =
    mean x remaining steps.  The running mean telescopes to
    (ts - first ts) / intervals, so only the dense per-run index is needed --
    no window over a run (which may be a hot key)."""
    idx = dense_index(steps, order, group_by=[run], out="step_idx")
    first = idx.groupBy(run).agg(F.min(ts).alias("_t0"), F.count(F.lit(1)).alias("_n"))
    prev = idx.select(run, (F.col("step_idx") + 1).alias("step_idx"), F.col(ts).alias("_prev"))
    # a run may be a hot key: its one row is joined salted
    j = salted_join(idx, first, [run], salt_by=F.col("step_idx")).join(prev, [run, "step_idx"], "left")
    # timestamp_diff works for zone-less timestamps too and needs no time zone
    since_start = F.timestamp_diff("MICROSECOND", F.col("_t0"), F.col(ts))
    mean = F.when(F.col("step_idx") > 0, since_start / F.col("step_idx"))
    total = max_steps if max_steps is not None else F.col("_n")
    return j.select(*steps.columns, "step_idx",
                    F.timestamp_diff("MICROSECOND", F.col("_prev"), F.col(ts)).alias("elapsed_us"), mean.alias("mean_us"),
                    (mean * (total - 1 - F.col("step_idx"))).alias("eta_us"))
