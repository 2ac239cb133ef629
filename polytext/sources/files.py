"""File sources and sinks.

Readers take explicit schemas (no inference pass over the data), writers use
Spark's part files (one per task) instead of a single output file, and every
layout that is read back by key is partitioned on that key so that reads are
pruned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from polytext.session import ensure_checkpoint_dir

ENTRY_SCHEMA = "task string, src_segm string, tgt_segm string, src_lang string, tgt_lang string"
PIVOT_SCHEMA = "lo_lang string, lo_segm string, hi_lang string, hi_segm string, new_hi_res_lang string"
CATEGORY_SCHEMA = "source string, sentences array<map<string,string>>"


HYP_CACHE_SCHEMA = "digest string, hyp string, corpus string, cache_src string, cache_tgt string, run string"


def read_hyp_cache(spark: SparkSession, path: str, corpus: str) -> DataFrame:
    """(cache_src, cache_tgt, digest, hyp, run) of a corpus; filters on
    corpus and languages prune partitions.  A cache not yet written is empty."""
    if not path_exists(spark, path):
        df = spark.createDataFrame([], HYP_CACHE_SCHEMA)
    else:
        df = spark.read.schema(HYP_CACHE_SCHEMA).parquet(path)
    return df.where(F.col("corpus") == corpus).drop("corpus")


def upsert_hyp_cache(rows: DataFrame, path: str, corpus: str, run: str) -> None:
    """Add (cache_src, cache_tgt, digest, hyp) rows that no other run has
    stored.  They are partitioned by corpus, languages and run, staged, and
    committed by replacing the run's own partitions: a run that is repeated,
    after a failure or not, stores no row twice."""
    spark = rows.sparkSession
    keys = ["cache_src", "cache_tgt", "digest"]
    others = read_hyp_cache(spark, path, corpus).where(F.col("run") != run).select(*keys)
    # joined first: the rows are then already where they are grouped
    fresh = rows.join(others, keys, "left_anti").groupBy(*keys).agg(F.min("hyp").alias("hyp")).select("digest", "hyp", F.lit(corpus).alias("corpus"), "cache_src", "cache_tgt", F.lit(run).alias("run"))
    fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("corpus", "cache_src", "cache_tgt", "run").parquet(path)


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return bool(fs.exists(p))


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """A1: every file is one record (``value``); CR LF / CR become LF like
    Python's universal newlines."""
    df = spark.read.text(path, wholetext=True)
    return df.select(F.regexp_replace("value", "\r\n?", "\n").alias("value"),
                     F.input_file_name().alias("file"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """A2: one record per line (the line terminator is dropped)."""
    return spark.read.text(path)


def input_index(scan: DataFrame, out: str = "row_idx") -> DataFrame:
    """0-based index of the rows of a file scan in input order: files by
    path, rows by their position in the file.

    A row's place in its split is the distance of its scan id from the split's
    first one; a first pass over the files counts the rows of every split.  Only
    these counts (file, split, first id, rows) are aggregated and summed up in
    order, so no row is sorted, shuffled or stored.  Both passes plan the same
    splits, as they read the same files under the same settings.  The offsets,
    one row a split, are broadcast below a measured size."""
    from polytext.operators.joins import lookup_join
    tagged = scan.select("*", F.col("_metadata.file_path").alias("_file"),
                         F.col("_metadata.file_block_start").alias("_start"),
                         F.monotonically_increasing_id().alias("_mid"))
    splits = tagged.groupBy("_file", "_start").agg(F.min("_mid").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_file", "_start").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.select("_file", "_start", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_off"))
    ensure_checkpoint_dir(scan.sparkSession)
    offsets = offsets.checkpoint(eager=True)  # counted once
    return lookup_join(tagged, offsets, ["_file", "_start"], salt_by=F.col("_mid")).select(
        *scan.columns, (F.col("_mid") + F.col("_off")).alias(out))


def with_line_numbers(lines: DataFrame, out: str = "line_no") -> DataFrame:
    """0-based line numbers in file order of the lines that ``read_lines`` gives:
    part files by name, lines by their position."""
    return input_index(lines, out)


def read_json_entries(spark: SparkSession, path: str, schema: str = ENTRY_SCHEMA, array: bool = False) -> DataFrame:
    """A3: JSON entries with an explicit schema, one a line, or (``array``) the
    elements of files that hold one top-level array each."""
    if array:
        from polytext.sources.json_arrays import read_json_array
        return read_json_array(spark, path, schema)
    return spark.read.schema(schema).json(path)


def read_categories(spark: SparkSession, path: str) -> DataFrame:
    """A5: category files, arrays of ``{"source": ..., "sentences": [{...}]}``."""
    return read_json_entries(spark, path, CATEGORY_SCHEMA, array=True)


def write_results(df: DataFrame, path: str, raw: bool, mode: str = "errorifexists") -> None:
    """A11 (+A12: one part file per task): raw formats write one hypothesis
    per line, others JSON lines with the reference's hyphenated keys."""
    if raw:
        df.select(F.coalesce(F.col("hyp_output"), F.lit("None")).alias("value")).write.mode(mode).text(path)
    else:
        ren = {"hyp_output": "hyp-output", "hyp_index": "hyp-index", "hyp_mean_logprob": "hyp-mean-logprob"}
        df.select(*[F.col(c).alias(ren.get(c, c)) for c in df.columns]).write.mode(mode).json(path)


def read_sharded_outputs(spark: SparkSession, path: str, expected_rows: int | None, schema: str) -> DataFrame:
    """A4: read ``path``; if absent, ``path.proc0``, ``path.proc1``, ... up to
    the first gap; check the row count and order by the index."""
    if path_exists(spark, path):
        parts = [path]
    else:
        parts, i = [], 0
        while path_exists(spark, f"{path}.proc{i}"):
            parts.append(f"{path}.proc{i}")
            i += 1
        if not parts:
            raise FileNotFoundError(path)
    df = spark.read.schema(schema).json(parts)
    if expected_rows is not None:
        n = df.count()
        if n != expected_rows:
            raise ValueError(f"{path}: {n} output rows for {expected_rows} inputs")
    return df.orderBy("`hyp-index`")


def lang_from_name(path: str) -> str:
    return path.rstrip("/").split(".")[-1]


def read_parallel_text(spark: SparkSession, file1: str, file2: str) -> DataFrame:
    """Two line-aligned files zipped by line number; the language is the
    last dotted part of the name; both sides stripped; a shorter second file
    gives '', surplus lines of the second file are dropped."""
    from polytext.functions.text import py_strip
    l1, l2 = lang_from_name(file1), lang_from_name(file2)
    a = with_line_numbers(read_lines(spark, file1)).select("line_no", py_strip("value").alias("t1"))
    b = with_line_numbers(read_lines(spark, file2)).select("line_no", py_strip("value").alias("t2"))
    j = a.join(b, "line_no", "left")
    return j.select("line_no", F.lit(l1).alias("lang1"), F.col("t1").alias("text1"), F.lit(l2).alias("lang2"),
                    F.coalesce(F.col("t2"), F.lit("")).alias("text2"))


def parallel_to_tuples(spark: SparkSession, pairs: list[tuple[str, str]]) -> DataFrame:
    """One category per file pair (source 'f1-f2'), tuples as maps.  The pairs
    of the same two files, in either order, are zipped once: each takes the lines
    that its first file has."""
    from polytext.functions.text import py_strip

    def lines(name: str, out: str) -> DataFrame:
        return with_line_numbers(read_lines(spark, name)).select(F.col("line_no").alias("pos"), py_strip("value").alias(out))

    def tuples(f1: str, f2: str, t1: str, t2: str) -> Column:
        texts = F.create_map(F.lit(lang_from_name(f1)), F.col(t1), F.lit(lang_from_name(f2)), F.coalesce(t2, F.lit("")))
        return F.when(F.col(t1).isNotNull(), F.struct(F.lit(f"{f1}-{f2}").alias("source"), texts.alias("m")))

    zips: dict[tuple[str, str], list[tuple[str, str]]] = {}
    for f1, f2 in pairs:
        zips.setdefault((f2, f1) if (f2, f1) in zips else (f1, f2), []).append((f1, f2))
    out = None
    for (f1, f2), of in zips.items():
        both = any(x != (f1, f2) for x in of)
        j = lines(f1, "t1").join(lines(f2, "t2"), "pos", "full" if both else "left")
        each = [tuples(*x, *(("t1", "t2") if x == (f1, f2) else ("t2", "t1"))) for x in of]
        t = j.select("pos", F.explode(F.array(*each)).alias("x")).where("x is not null").select("x.source", "pos", "x.m")
        out = t if out is None else out.unionByName(t)
    return out


def append_parallel_sources(spark: SparkSession, path: str, pairs: list[tuple[str, str]]) -> None:
    """Add file pairs to a corpus of tuples (source, pos, m) at ``path``.
    Each source is a partition of its own (by the digest of its name) that is
    staged and then replaced as a whole; other sources stay as they are, and
    adding a pair again changes nothing."""
    t = parallel_to_tuples(spark, pairs).withColumn("source_key", F.md5("source"))
    t.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source_key").option("compression", "zstd").parquet(path)


def read_parallel_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(source, pos, m) of a corpus of file pairs."""
    return spark.read.schema("source string, pos bigint, m map<string,string>, source_key string").parquet(path).drop("source_key")


def write_tsv_pairs(pairs: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """``src_lang<TAB>input<TAB>tgt_lang<TAB>output`` lines, unquoted."""
    pairs.select(F.concat_ws("\t", "src_lang", "input", "tgt_lang", "output").alias("value")) \
        .write.mode(mode).text(path)


def read_vocab_tsv(spark: SparkSession, path: str) -> DataFrame:
    """A8 input: ``token<TAB>count`` lines with their line numbers."""
    lines = with_line_numbers(read_lines(spark, path))
    return lines.select("line_no", F.split("value", "\t").getItem(0).alias("token"))


def write_shards(df: DataFrame, path: str, shard: str = "shard_id") -> DataFrame:
    """Write rows partitioned by shard (never overwriting) and a manifest
    (shard, rows) next to them; returns the manifest."""
    df.write.mode("errorifexists").partitionBy(shard).parquet(f"{path}/data")
    manifest = df.groupBy(shard).agg(F.count(F.lit(1)).alias("shard_size"))
    manifest.write.mode("errorifexists").json(f"{path}/manifest")
    return manifest


def read_manifest_shards(spark: SparkSession, path: str, shard: str = "shard_id") -> tuple[DataFrame, DataFrame]:
    """A10: the shards listed in the manifest and the shards whose row count
    differs from the manifest (violations; empty when consistent)."""
    manifest = spark.read.schema(f"{shard} bigint, shard_size bigint").json(f"{path}/manifest")
    data = spark.read.parquet(f"{path}/data")
    data = data.join(manifest.select(shard), shard, "left_semi")
    counts = data.groupBy(shard).agg(F.count(F.lit(1)).alias("rows"))
    bad = manifest.join(counts, shard, "full_outer").where(
        F.coalesce(F.col("rows"), F.lit(-1)) != F.coalesce(F.col("shard_size"), F.lit(-1)))
    return data, bad


def write_scores(scores: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """The score table (key, score) as JSON, sorted by key (a small
    result: one row per language pair and metric)."""
    scores.orderBy("key").write.mode(mode).json(path)
