"""Files that hold one top-level JSON array (A3, A5), read by many tasks.

Spark's text reader cuts a file into splits and these into chunks that end with
``}``.  Whether such a brace ends a record depends on what stands before it:
whether that is inside a string, and how many objects are open.

1. Every split is scanned once for both possible starts (inside a string or
   not): how the string state and the number of open objects change over it.
   These changes, one small row a split, are composed in file order at the
   driver, which gives the state at the start of every split.
2. Every split is scanned again from its true state.  Records that lie in one
   split are returned where they are; no text is shuffled.
3. A record that crosses splits is put together from its fragments (at most two
   a split), grouped by the split in which it opens.

A task holds one batch of chunks, what belongs to one slice of it, and one open
record.  The elements of the array
are objects of any nesting; others are left out.  Fields follow the schema: a
missing one is NULL, others are not read.  An empty array gives no rows; a file
that ends inside a string or an object raises an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from polytext.operators.frames import slices

WHOLE, OPENS, CONTINUES = 0, 1, 2
_CHANGES = pa.schema([("file", pa.string()), ("start", pa.int64()), ("out0", pa.bool_()), ("d0", pa.int64()), ("out1", pa.bool_()), ("d1", pa.int64())])
_KINDS = pa.schema([("file", pa.string()), ("start", pa.int64()), ("kind", pa.int32()), ("text", pa.string())])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def outside_braces(data: bytes, inside: bool) -> tuple[np.ndarray, np.ndarray, bool]:
    """Positions of braces outside strings, +1 or -1 for each, and whether the
    end lies inside a string."""
    b = np.frombuffer(data, np.uint8)
    quotes = np.flatnonzero(b == 34)
    if 92 in data:  # quotes behind an odd run of backslashes are escaped
        at = np.arange(len(b))
        plain = np.maximum.accumulate(np.where(b == 92, -1, at))
        quotes = quotes[(quotes - 1 - np.where(quotes > 0, plain[quotes - 1], -1)) % 2 == 0]
    braces = np.flatnonzero((b == 123) | (b == 125))
    braces = braces[(np.searchsorted(quotes, braces) + inside) % 2 == 0]
    return braces, np.where(b[braces] == 123, 1, -1), bool((len(quotes) + inside) % 2)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], bytes]]:
    """(file, start of the split) and text of the chunks of a slice."""
    for b in slices(batches, "value"):
        p = b.to_pandas()
        new = (p["file"] != p["file"].shift()) | (p["start"] != p["start"].shift())
        for _, own in p.groupby(new.cumsum(), sort=False):
            yield (own["file"].iloc[0], int(own["start"].iloc[0])), ("}".join(own["value"]) + "}").encode("utf-8")


def _changes(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: dict[tuple[str, int], list] = {}
    for key, data in _runs(parts):
        state = seen.setdefault(key, [[False, 0], [True, 0]])
        for s in state:
            _, step, s[0] = outside_braces(data, s[0])
            s[1] += int(step.sum())
    yield _batch([(f, at, a[0], a[1], b[0], b[1]) for (f, at), (a, b) in seen.items()], _CHANGES)


def _states(rows) -> dict[tuple[str, int], tuple[bool, int]]:
    """State at the start of every split."""
    found, last = {}, None
    for r in [*sorted(rows, key=lambda r: (r["file"], r["start"])), None]:
        if last is not None and (r is None or r["file"] != last):
            if inside or depth != -1:  # the text after the last brace counts as one chunk more
                raise ValueError(f"{last}: not a complete JSON array")
        if r is None:
            break
        if r["file"] != last:
            inside, depth, last = False, 0, r["file"]
        found[r["file"], r["start"]] = inside, depth
        inside, depth = (r["out1"], depth + r["d1"]) if inside else (r["out0"], depth + r["d0"])
    return found


def _records(states: dict, edges: bool):
    """Whole records of each split, or (``edges``) the fragments at its ends."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = held = None
        inside, depth, crossing = False, 0, False

        def left() -> list[tuple]:
            return [(*key, CONTINUES if crossing else OPENS, b"".join(held).decode("utf-8"))] if key and depth > 0 and edges else []

        for now, data in _runs(parts):
            out = []
            if now != key:
                out += left()
                key, held = now, []
                inside, depth = states[key]
                crossing = depth > 0
            braces, step, inside = outside_braces(data, inside)
            after = depth + np.cumsum(step)
            starts = braces[(step == 1) & (after == 1)].tolist()
            ends = braces[(step == -1) & (after == 0)].tolist()
            if depth > 0:  # open since before this slice
                if not ends:
                    held.append(data)
                else:
                    if crossing == edges:
                        out.append((*key, CONTINUES if crossing else WHOLE, (b"".join(held) + data[:ends[0] + 1]).decode("utf-8")))
                    held, crossing, ends = [], False, ends[1:]
            if not edges:
                out += [(*key, WHOLE, data[s:e + 1].decode("utf-8")) for s, e in zip(starts, ends)]
            if len(starts) > len(ends):
                held = [data[starts[-1]:]]
            depth = int(after[-1]) if len(after) else depth
            if out:
                yield _batch(out, _KINDS)
        out = left()
        if out:
            yield _batch(out, _KINDS)

    return run


def record_texts(spark: SparkSession, path: str) -> DataFrame:
    """The records' JSON texts (``text``)."""
    chunks = spark.read.option("lineSep", "}").text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    rows = chunks.mapInArrow(_changes, "file string, start long, out0 boolean, d0 long, out1 boolean, d1 long").collect()  # one a split
    states = _states(rows)
    kind = "file string, start long, kind int, text string"
    whole = chunks.mapInArrow(_records(states, False), kind).select("text")
    if not any(depth > 0 for _, depth in states.values()):
        return whole
    part = chunks.mapInArrow(_records(states, True), kind)
    order = Window.partitionBy("file").orderBy("start", F.desc("kind"))
    part = part.withColumn("record", F.sum(F.when(F.col("kind") == OPENS, 1).otherwise(0)).over(order))
    joined = part.groupBy("file", "record").agg(F.array_sort(F.collect_list(F.struct("start", "text"))).alias("x"))
    return whole.union(joined.select(F.array_join(F.col("x.text"), "").alias("text")))


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The objects of the top-level arrays of one or more files."""
    return record_texts(spark, path).select(F.from_json("text", schema).alias("r")).select("r.*")


def write_json_arrays(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One file a task, each holding one JSON array with an object a line."""

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = True
        for b in slices(batches, "value"):
            mark = pa.array(["[" if first and not i else "," for i in range(len(b))])
            first = False
            yield pa.RecordBatch.from_arrays([pc.binary_join_element_wise(mark, b.column("value"), "")], ["value"])
        yield pa.RecordBatch.from_arrays([pa.array(["[]" if first else "]"])], ["value"])

    df.select(F.to_json(F.struct(*df.columns)).alias("value")).mapInArrow(lines, "value string").write.mode(mode).text(path)
