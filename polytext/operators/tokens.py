"""Token work: vocabulary tables (A8, F14, D11, I7), token counts and reports
(E12, E13, E20, F12), tokenisation with truncation/EOS (I1), loss masks (I2,
I3), padding (I4), detokenisation (I6), language tokens (I8), batch
tokenisation (I9), end-of-sequence fill (B22) and subword vocabulary learning
(I5).

Tokens are lower-cased non-space runs.  Tokens are mapped to ids by a lookup
in the vocabulary: broadcast when its counted size allows, else the distinct
tokens of a chunk of rows are joined to it and the ids found come back to the
chunk; a row's token list is bounded by ``max_len``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from polytext.operators.batching import dense_index
from polytext.operators.frames import cuts
from polytext.operators.joins import MAX_BROADCAST_BYTES, lookup_join, table_bytes
from polytext.operators.layout import spread
from polytext.session import ensure_checkpoint_dir, release

# The four reserved ids of a vocabulary read from TSV.
SPECIALS = [("<s>", 0), ("<pad>", 1), ("</s>", 2), ("<unk>", 3)]
BOS_ID, PAD_ID, EOS_ID, UNK_ID = 0, 1, 2, 3
DEFAULT_MAX_LEN = 3000
TOKEN_PATTERN = r"[^\s]+"
# Tokens that a task codes or spells at once.
SLICE_TOKENS = 1 << 17
# Text that a task codes at once where the vocabulary is joined.
CHUNK_BYTES = 16 << 20


def word_tokens(text) -> Column:
    t = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.lower(t), F.lit(TOKEN_PATTERN), 0)


def token_occurrences(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, token) for every token of every row (0-based position)."""
    return spread(df.select(key, text)).select(key, F.posexplode(word_tokens(text)).alias("pos", "token"))


_BELOW = "-9223372036854775809"  # below every integer key: a null key comes first
_POSITIONS = 1 << 31


def _first_occurrences(occ: DataFrame, *aggregates: Column) -> DataFrame:
    """(token, aggregates..., first) with the first (key, pos) of each token.
    The minimum of a struct makes Spark sort every occurrence; with integer
    keys the pair is one decimal, which is aggregated in a hash table instead."""
    key = occ.columns[0]
    kind = occ.schema[key].dataType.typeName()
    if kind not in ("byte", "short", "integer", "long"):
        return occ.groupBy("token").agg(*aggregates, F.min(F.struct(F.col(key), F.col("pos"))).alias("first"))
    wide = F.coalesce(F.col(key).cast("decimal(20,0)"), F.lit(_BELOW).cast("decimal(20,0)"))
    place = F.lit(_POSITIONS).cast("decimal(10,0)")
    found = occ.groupBy("token").agg(*aggregates, F.min((wide * place + F.col("pos")).cast("decimal(38,0)")).alias("_f"))
    pos = F.pmod(F.col("_f"), place)
    own = ((F.col("_f") - pos) / place).cast("decimal(20,0)")
    own = F.when(own != F.lit(_BELOW).cast("decimal(20,0)"), own).cast(occ.schema[key].dataType)
    return found.select(*[c for c in found.columns if c != "_f"], F.struct(own.alias(key), pos.cast("int").alias("pos")).alias("first"))


def token_frequency(occ: DataFrame) -> DataFrame:
    """Corpus token counts with the first occurrence (row key, position;
    for stable ties).  Row keys may be of any ordered type and size."""
    return _first_occurrences(occ, F.count(F.lit(1)).alias("count"))


def top_k_tokens(freq: DataFrame, k: int) -> DataFrame:
    """k most frequent tokens, ties by first occurrence (TakeOrdered)."""
    return freq.orderBy(F.col("count").desc(), F.col("first")).limit(k).select("token", "count")


def build_vocab(freq: DataFrame, min_count: int = 2, base: int = len(SPECIALS)) -> DataFrame:
    """F14 + D11: tokens seen at least ``min_count`` times get ids base + i in
    first-occurrence order (dense two-pass index); reserved tokens first."""
    cand = freq.where(F.col("count") >= min_count).select("token", "first")
    cand = cand.join(F.broadcast(special_table(freq.sparkSession)), "token", "left_anti")
    idx = dense_index(cand, ["first"], out="_i")
    spark = freq.sparkSession
    return idx.select("token", (F.col("_i") + base).cast("int").alias("id")).unionByName(special_table(spark))


def special_table(spark) -> DataFrame:
    return spark.createDataFrame(SPECIALS, "token string, id int")


def vocab_from_tsv(lines: DataFrame, line_no: str = "line_no", token: str = "token") -> DataFrame:
    """Reserved ids 0-3, then every new token of the TSV in line order
    (first occurrence wins)."""
    first = lines.groupBy(token).agg(F.min(line_no).alias("first"))
    first = first.join(F.broadcast(special_table(lines.sparkSession)), token, "left_anti")
    idx = dense_index(first, ["first"], out="_i")
    return idx.select(F.col(token).alias("token"), (F.col("_i") + len(SPECIALS)).cast("int").alias("id")) \
        .unionByName(special_table(lines.sparkSession))


def _coded(rows: DataFrame, key: str, toks: Column, vocab: DataFrame) -> DataFrame:
    """(key, ids): tokens are found in the broadcast vocabulary (Arrow).

    The vocabulary is sent sorted by the tokens' hashes, so a task looks tokens
    up in it as it is and holds no table of objects; tokens that are found are
    compared, so a hash that two tokens share gives no wrong id."""
    seed, shared = 0, None
    while shared is None:
        table = vocab.select("token", "id", F.xxhash64("token", F.lit(seed)).alias("h")).toArrow().combine_chunks()
        table = table.filter(pc.is_valid(table.column("token"))).sort_by("h")
        h = table.column("h").to_numpy()
        if (h[1:] != h[:-1]).all():  # else with another seed
            shared = rows.sparkSession.sparkContext.broadcast(
                (h, table.column("token").combine_chunks(), table.column("id").to_numpy().astype(np.int32)))
        seed += 1
    seed -= 1

    @F.arrow_udf("array<int>")
    def run(words: pa.Array, hashes: pa.Array) -> pa.Array:
        known, token, code = shared.value
        size = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ids = [np.empty(0, np.int32)]
        for first, end in cuts(size, SLICE_TOKENS):
            said = words.slice(first, end - first).flatten()
            h = hashes.slice(first, end - first).flatten().to_numpy()
            at = np.minimum(np.searchsorted(known, h), max(len(known) - 1, 0))
            if len(known):
                same = pc.equal(pc.take(token, pa.array(at)), said).to_numpy(zero_copy_only=False)
                ids.append(np.where(same, code[at], np.int32(UNK_ID)))
            else:
                ids.append(np.full(len(h), UNK_ID, np.int32))
        ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids), pa.int32()))

    split = rows.select(key, toks.alias("_toks"))
    hashed = split.select(key, "_toks", F.transform("_toks", lambda t: F.xxhash64(t, F.lit(seed))).alias("_hashes"))
    return hashed.select(key, run("_toks", "_hashes").alias("_ids"))


def _whole(column: pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def _joined(df: DataFrame, key: str, text: str, toks: Column, vocab: DataFrame, chunk_bytes: int) -> DataFrame:
    """(key, ids) with a vocabulary too large to broadcast.  Rows are dealt by
    a hash of what they hold to chunks of about ``chunk_bytes`` of text; the
    distinct tokens of a chunk meet the vocabulary, and those that it has come
    back to the chunk, where the rows are coded (Arrow).  So a text is shuffled
    once, a token once a chunk (a frequent one is no hot key), and no token
    becomes a row of its own."""
    release(df.sparkSession)  # the vocabulary is written: what it was made of is not needed
    size = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    n = max(-(-size // chunk_bytes), df.sparkSession.sparkContext.defaultParallelism)
    rows = df.select(key, text, F.pmod(F.xxhash64(key, text), F.lit(n)).alias("_chunk")).repartition(n, "_chunk")
    # the key is kept as far as here, so that both uses read the same shuffled rows
    used = rows.select("_chunk", F.xxhash64(key).alias("_of"), F.explode(toks).alias("token"))
    used = used.groupBy("_chunk", "token").agg(F.min("_of").alias("_of")).where("_of is not null").select("_chunk", "token")
    known = used.join(vocab.hint("shuffle_hash"), "token").select(F.col("_chunk").alias("_in"), "token", "id")
    split = rows.select("_chunk", F.col(key).alias("_key"), toks.alias("_toks"))

    def code(own: pa.Table, found: pa.Table) -> pa.Table:
        lists, token, id_ = (_whole(t.column(c)) for t, c in ((own, "_toks"), (found, "token"), (found, "id")))
        ids = pc.fill_null(pc.take(id_, pc.index_in(lists.flatten(), value_set=token)), UNK_ID)
        ends = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(np.int32)
        return pa.table({"_key": own.column("_key"), "_ids": pa.ListArray.from_arrays(pa.array(ends), ids.cast(pa.int32()))})

    schema = T.StructType([T.StructField("_key", df.schema[key].dataType), T.StructField("_ids", T.ArrayType(T.IntegerType()))])
    coded = split.groupBy("_chunk").cogroup(known.groupBy("_in")).applyInArrow(code, schema)
    return coded.select(F.col("_key").alias(key), "_ids")


def tokenise(df: DataFrame, key: str, text: str, vocab: DataFrame, max_len: int | None = DEFAULT_MAX_LEN,
             add_eos: bool = True, max_broadcast_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """Ids (unknown -> UNK), truncated to ``max_len`` *before* EOS is
    appended (so up to max_len + 1; None: not truncated), and an all-ones
    attention mask.  A text is tokenised and coded where it lies; only a
    vocabulary of more than ``max_broadcast_bytes`` (measured) is joined
    instead.  A null text has no tokens; rows that repeat a key stay apart."""
    rows = spread(df.select(key, text))
    toks = F.coalesce(word_tokens(text) if max_len is None else F.slice(word_tokens(text), 1, max_len),
                      F.array().cast("array<string>"))
    ensure_checkpoint_dir(df.sparkSession)
    vocab = vocab.select("token", "id").checkpoint(eager=True)  # evaluated once: measured, then sent or joined
    if table_bytes(vocab) <= max_broadcast_bytes:
        coded = _coded(rows, key, toks, vocab)
    else:
        coded = _joined(df.select(key, text), key, text, toks, vocab, CHUNK_BYTES)
    ids = F.concat("_ids", F.array(F.lit(EOS_ID))) if add_eos else F.col("_ids")
    return coded.select(key, ids.alias("input_ids")).select(
        key, "input_ids", F.array_repeat(F.lit(1), F.size("input_ids")).alias("attention_mask"))


def loss_mask_delimiter(ids: str, delim_id: int) -> Column:
    """Positions up to and including the first delimiter are masked
    (True); a missing delimiter fails the job at that row."""
    pos = F.array_position(F.col(ids), delim_id).cast("int")
    n = F.size(F.col(ids))
    return F.when(pos == 0, F.raise_error(F.lit(f"delimiter id {delim_id} not in input"))) \
        .otherwise(F.concat(F.array_repeat(F.lit(True), pos), F.array_repeat(F.lit(False), n - pos)))


def loss_mask_prefix(ids: str, n_masked: Column) -> Column:
    """Mask the first n tokens (n = token count of the prompt rendered with
    the output left blank, EOS included -- one output token too many, Q6)."""
    n = F.size(F.col(ids))
    k = F.least(n_masked.cast("int"), n)
    return F.concat(F.array_repeat(F.lit(True), k), F.array_repeat(F.lit(False), n - k))


def pad_batch(df: DataFrame, batch: str, ids: str = "input_ids", multiple: int = 8, left: bool = True,
              pad_id: int = PAD_ID, length: str | None = None) -> DataFrame:
    """I4: pad to the longest row of the batch rounded up to a multiple, on
    the left; mask 0 on padding; labels = ids copy.  With ``length``, a column
    with the size of a row's ids (``df`` is then read twice), the longest of the
    batches are found without the ids, and a row is padded where it lies."""
    mx = df.groupBy(batch).agg(F.max(length or F.size(ids)).alias("_mx"))
    target = (F.ceil(F.col("_mx") / multiple) * multiple).cast("int")
    if length:
        ensure_checkpoint_dir(df.sparkSession)
        j = lookup_join(df, mx.checkpoint(eager=True), [batch])
    else:
        j = df.join(mx, batch, "inner")
    npad = target - F.size(ids)
    pad = F.array_repeat(F.lit(pad_id), npad)
    zeros = F.array_repeat(F.lit(0), npad)
    ones = F.array_repeat(F.lit(1), F.size(ids))
    if left:
        padded, mask = F.concat(pad, F.col(ids)), F.concat(zeros, ones)
    else:
        padded, mask = F.concat(F.col(ids), pad), F.concat(ones, zeros)
    rest = [c for c in df.columns if c not in (ids, "attention_mask", "labels")]
    return j.select(*rest, padded.alias(ids), mask.alias("attention_mask"),
                    padded.alias("labels"))


def fill_after_eos(ids: str, eos_id: int = EOS_ID) -> Column:
    """From the first EOS on, every position becomes EOS."""
    pos = F.array_position(F.col(ids), eos_id).cast("int")
    return F.when(pos == 0, F.col(ids)).otherwise(F.concat(
        F.slice(F.col(ids), 1, pos - 1), F.array_repeat(F.lit(eos_id), F.size(F.col(ids)) - pos + 1)))


def set_language_token(ids: str, lang_id: Column) -> Column:
    """I8: position 0 becomes the row's language-token id."""
    return F.concat(F.array(lang_id.cast("int")), F.slice(F.col(ids), 2, 1 << 30))


def _spelled(ids: Column, vocab: pa.Table, spark) -> Column:
    """Texts of array<array<int>>, the ids of the rows of a key: the tokens by
    (position, token), without reserved ids and ids that the vocabulary lacks."""
    table = vocab.filter(pc.is_valid(vocab.column("id"))).sort_by("id")
    known = table.column("id").to_numpy()
    shared = spark.sparkContext.broadcast((known, table.column("token").combine_chunks()))
    reserved = np.array([i for _, i in SPECIALS])

    @F.arrow_udf("string")
    def run(rows: pa.Array) -> pa.Array:
        known, token = shared.value
        several = pc.list_value_length(rows).to_numpy(zero_copy_only=False)
        texts: list[pa.Array] = []
        each = rows.flatten()  # the id lists, one or more a row
        size = pc.fill_null(pc.list_value_length(each), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        lists = np.concatenate([[0], np.cumsum(np.nan_to_num(several))]).astype(np.int64)
        upto = np.concatenate([[0], np.cumsum(size)])
        for first, end in cuts(np.diff(upto[lists]), SLICE_TOKENS):
            own = each.slice(lists[first], lists[end] - lists[first])
            n = size[lists[first]:lists[end]]
            ids = own.flatten().to_numpy(zero_copy_only=False)
            row = np.repeat(np.repeat(np.arange(end - first), np.diff(lists[first:end + 1])), n)
            at = np.minimum(np.searchsorted(known, ids), max(len(known) - 1, 0))
            keep = np.zeros(len(ids), bool) if not len(known) else (known[at] == ids) & ~np.isin(ids, reserved)
            pos = np.arange(len(ids)) - np.repeat(np.cumsum(n) - n, n)
            row, at, pos = row[keep], at[keep], pos[keep]
            said = pc.take(token, pa.array(at))
            if len(n) > end - first:  # a key of several rows: their tokens by position
                order = np.lexsort([_ranks(said), pos, row])
                row, said = row[order], pc.take(said, pa.array(order))
            ends = np.searchsorted(row, np.arange(end - first + 1)).astype(np.int32)
            texts.append(pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), said), " "))
        return pa.concat_arrays(texts) if texts else pa.array([], pa.string())

    return run(ids)


def _ranks(said: pa.Array) -> np.ndarray:
    """Places of texts in byte order, equal ones alike."""
    table = pc.dictionary_encode(said)
    order = pc.sort_indices(table.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return rank[table.indices.to_numpy()]


def detokenise(df: DataFrame, key: str, ids: str, vocab: DataFrame, added: DataFrame | None = None,
               max_broadcast_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """Ids -> surface text; reserved ids skipped; ids missing from the
    vocabulary use the added-token table; tokens joined by spaces.  Rows of the
    same key count as one, by position.  A vocabulary of more than
    ``max_broadcast_bytes`` (measured) is joined with the single ids."""
    v = vocab.select("id", "token")
    if added is not None:
        v = v.unionByName(added.select("id", "token")).groupBy("id").agg(F.first("token").alias("token"))
    ensure_checkpoint_dir(df.sparkSession)
    v = v.checkpoint(eager=True)  # evaluated once: measured, then sent or joined
    if table_bytes(v) <= max_broadcast_bytes:
        table = v.toArrow()
        if len(pc.unique(table.column("id"))) == table.num_rows:
            own = df.groupBy(key).agg(F.collect_list(ids).alias("_x")).select(key, _spelled(F.col("_x"), table, df.sparkSession).alias("text"))
            return df.select(key).join(own, key, "left").select(key, F.coalesce("text", F.lit("")).alias("text"))
    special = [i for _, i in SPECIALS]
    occ = df.select(key, F.posexplode(ids).alias("pos", "id")).where(~F.col("id").isin(special))
    j = lookup_join(occ, v, ["id"], "left",
                    salt_by=F.concat_ws("|", F.col(key).cast("string"), F.col("pos").cast("string")))
    per_row = j.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "token"))).alias("_p"))
    return df.select(key).join(per_row, key, "left").select(
        key, F.coalesce(F.array_join(F.transform("_p", lambda x: x["token"]), " "), F.lit("")).alias("text"))


def unk_report(occ: DataFrame, vocab: DataFrame) -> DataFrame:
    """Distinct tokens used, total tokens, UNK percentage.  Tokens are
    counted first, so the join has one row a token."""
    counted = occ.groupBy("token").agg(F.count(F.lit(1)).alias("_n"))
    j = counted.join(vocab.select("token", F.lit(1).alias("_known")), "token", "left")
    return j.agg(F.count(F.lit(1)).alias("distinct_tokens"), F.coalesce(F.sum("_n"), F.lit(0)).alias("total_tokens"),
                 F.coalesce(F.sum(F.when(F.col("_known").isNull(), F.col("_n"))), F.lit(0)).alias("unk_tokens")).select(
        "distinct_tokens", "total_tokens", "unk_tokens",
        (F.lit(100.0) * F.col("unk_tokens") / F.col("total_tokens")).alias("unk_pct"))


def unk_tokens(occ: DataFrame, vocab: DataFrame, key: str) -> DataFrame:
    """E13 list / I7 candidates: unknown surface tokens in first-seen order."""
    first = _first_occurrences(occ.select(key, "pos", "token"))
    return first.join(vocab.select("token"), "token", "left_anti")


def extend_vocab(vocab: DataFrame, unknown: DataFrame) -> DataFrame:
    """Unknown tokens (minus known, D11) get new ids after the current
    maximum in first-seen order (F14)."""
    base = vocab.agg(F.max("id")).first()[0]  # one scalar
    new = unknown.join(vocab.select("token"), "token", "left_anti")
    idx = dense_index(new, ["first"], out="_i")
    return idx.select("token", (F.lit(base) + 1 + F.col("_i")).cast("int").alias("id"))
