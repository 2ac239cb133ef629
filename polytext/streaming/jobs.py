"""K1 / K2 as Structured Streaming queries.

K1 replaces the reference's resumable shard iteration: a file source picks up
shards as they arrive, admitted by bytes per trigger, the checkpoint location
records what was processed, and the parquet file sink commits every
micro-batch through its metadata log, so a restart (or a lost executor)
neither skips nor duplicates a shard.

K2 keeps steps and loss per run as keyed streaming state and writes what a
micro-batch changed into a table on shared storage, which outlives the driver.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from polytext.sources.files import _fs, path_exists


def start_incremental(spark: SparkSession, source: str, schema: str, transform: Callable[[DataFrame], DataFrame],
                      out: str, checkpoint: str, fmt: str = "parquet", max_bytes_per_trigger: int | None = None,
                      drain: bool = False) -> StreamingQuery:
    """K1: a running query that processes each shard under ``source`` exactly
    once into the parquet table ``out``, also shards that arrive while it runs.
    A trigger admits shards up to ``max_bytes_per_trigger`` (at least one
    shard; None: all that are there).  With ``drain`` the query
    ends by itself when the shards present at its start are done."""
    reader = spark.readStream.schema(schema).format(fmt)
    if max_bytes_per_trigger:
        reader = reader.option("maxBytesPerTrigger", max_bytes_per_trigger)
    writer = (transform(reader.load(source)).writeStream.format("parquet").option("path", out)
              .option("checkpointLocation", checkpoint).outputMode("append"))
    return (writer.trigger(availableNow=True) if drain else writer).start()


def incremental_process(spark: SparkSession, source: str, schema: str, transform: Callable[[DataFrame], DataFrame],
                        out: str, checkpoint: str, fmt: str = "parquet", max_bytes_per_trigger: int | None = None
                        ) -> None:
    """K1, run until the shards present at start are done."""
    start_incremental(spark, source, schema, transform, out, checkpoint, fmt, max_bytes_per_trigger,
                      drain=True).awaitTermination()


def read_latest(spark: SparkSession, table: str, key: str, schema: str, before: int | None = None) -> DataFrame:
    """The newest row of each key in a table written by ``upsert_batch`` (of
    the batches ``before`` one, if given); a table not yet written is empty."""
    columns = spark.createDataFrame([], schema).columns
    if not path_exists(spark, table):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(f"{schema}, batch bigint").option("basePath", table).parquet(table)
    if before is not None:
        rows = rows.where(F.col("batch") < before)
    newest = rows.groupBy(key).agg(F.max_by(F.struct(*columns), "batch").alias("r"))
    return newest.select(*(F.col(f"r.{c}").alias(c) for c in columns))


def upsert_batch(changed: DataFrame, batch: int, table: str, key: str, schema: str, compact_every: int = 20) -> None:
    """Store the rows that a micro-batch changed as partition ``batch`` of
    ``table``.  A batch that is repeated after a failure replaces its own
    partition.  Every ``compact_every`` batches the partition holds the newest
    row of every key instead, and the partitions it replaces go only at the
    batch after it, so that a reader always finds each key."""
    spark = changed.sparkSession
    fs, folder = _fs(spark, table)
    if batch % compact_every == 1 and batch > compact_every:
        for status in fs.listStatus(folder):
            name = status.getPath().getName()
            if name.startswith("batch=") and int(name[len("batch="):]) < batch - 1:
                fs.delete(status.getPath(), True)
    if batch and batch % compact_every == 0:
        older = read_latest(spark, table, key, schema, before=batch)
        changed = changed.unionByName(older.join(changed.select(F.col(key).alias("_k")), F.col(key).eqNullSafe(F.col("_k")), "left_anti"))
    changed.write.mode("overwrite").parquet(f"{table}/batch={batch}")


def progress_stream(spark: SparkSession, source: str, schema: str, table: str, checkpoint: str,
                    run: str = "run", loss: str = "loss", max_bytes_per_trigger: int | None = None) -> DataFrame:
    """K2: steps and mean loss per run over a step log that grows, as keyed
    state in the state store; each micro-batch stores the runs it changed in
    ``table`` (run, steps, mean_loss).  Runs until the log present at start is
    read and returns the newest row of each run.  A restart with the same
    checkpoint goes on from the state.  A null run is a run of its own; null
    losses count as steps and not in the mean."""
    steps = spark.readStream.schema(schema).format("parquet")
    if max_bytes_per_trigger:
        steps = steps.option("maxBytesPerTrigger", max_bytes_per_trigger)
    agg = steps.load(source).groupBy(F.col(run).alias("run")).agg(
        F.count(F.lit(1)).alias("steps"), F.avg(loss).alias("mean_loss"))
    kept = f"run {dict(agg.dtypes)['run']}, steps bigint, mean_loss double"
    q = (agg.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True)
         .foreachBatch(lambda changed, batch: upsert_batch(changed, batch, table, "run", kept)).start())
    q.awaitTermination()
    return read_latest(spark, table, "run", kept)
