"""Incremental runs: each object once, bounded state, a log that batches share."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from veilframe.model import LOG_SCHEMA, OBJECT_SCHEMA
from veilframe.plans.scale import scratch
from veilframe.sources.batches import BUCKETS, commit_batch, read_log
from veilframe.sources.logs import read_log_path


def stream_table(
    spark: SparkSession, folder: str, schema: T.StructType, pattern: str = "*.parquet", files: int | None = None
) -> DataFrame:
    """A folder of parquet files as a stream, with so many of them per batch (None: all)."""
    reader = spark.readStream.format("parquet").schema(schema)
    if files is not None:
        reader = reader.option("maxFilesPerTrigger", str(files))
    return reader.option("pathGlobFilter", pattern).load(folder)


def stream_objects(spark: SparkSession, root: str) -> DataFrame:
    """A folder of objects as a stream."""
    reader = spark.readStream.format("binaryFile").schema(OBJECT_SCHEMA)
    return reader.option("recursiveFileLookup", "true").load(root)


def ingest(stream: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Append what is new to a parquet folder and stop; a repeat adds nothing."""
    writer = stream.writeStream.format("parquet").outputMode("append")
    writer = writer.option("checkpointLocation", checkpoint).option("path", target)
    return writer.trigger(availableNow=True).start()


def first_seen(stream: DataFrame, key: str, ts: str, delay: str = "24 hours") -> DataFrame:
    """Drop repeats of a key that arrive within the delay; state older than that is freed."""
    timed = stream.withColumn(ts, F.col(ts).cast("timestamp"))
    return timed.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def query_id(spark: SparkSession, checkpoint: str) -> str:
    """The id of the query that a checkpoint belongs to; it outlives restarts."""
    return json.loads(spark.read.text(f"{checkpoint}/metadata").first()[0])["id"]


def committed_batches(
    stream: DataFrame,
    work: Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame]],
    root: str,
    checkpoint: str,
    key: str,
    object_key: str,
    log_schema: T.StructType = LOG_SCHEMA,
    buckets: int = BUCKETS,
) -> StreamingQuery:
    """Run `work(batch, log)` per batch and commit its objects and log rows together.

    Copies of a `key` within a batch count once. `log` has the rows of all earlier commits.
    A batch that is run again after a failure is committed once, whatever the failure was.
    The tables that the work writes on the way are deleted after each batch.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        log = read_log(spark, root, log_schema)
        with scratch():
            objects, rows = work(batch.dropDuplicates([key]), log)
            commit_batch(root, query_id(spark, checkpoint), batch_id, objects, rows, object_key, buckets)

    writer = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


def logged_batches(
    stream: DataFrame,
    work: Callable[[DataFrame, DataFrame], DataFrame],
    log_path: str,
    checkpoint: str,
    key: str = "file_name",
) -> StreamingQuery:
    """Run `work(batch, log)` per batch and add its log rows to the log folder.

    Copies of a `key` within a batch count once. Each batch owns one partition of the log,
    named by the query id in the checkpoint and the batch number, and does not see its own
    rows. So a batch that is run again after a failure overwrites its rows, and a second
    source or a new checkpoint over the same log leaves them.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        own = f"{query_id(spark, checkpoint)}-{batch_id}"
        log = read_log_path(spark, log_path)
        if "batch_id" in log.columns:
            log = log.where(F.col("batch_id").cast("string") != F.lit(own))
        batch = batch.dropDuplicates([key])
        rows = work(batch, log)
        rows.write.mode("overwrite").parquet(f"{log_path}/batch_id={own}")

    writer = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()
