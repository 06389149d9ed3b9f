"""Live job status, expiry of silent jobs, and uploads that start work, with Structured Streaming."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import token_estimate, word_count
from ..operators.jobs import status, validated
from ..sources.views import as_job_events


def shared(spark: SparkSession, tag: str) -> str:
    """A new folder where driver and executors both write: in spark.checkpoint.dir, in the context's checkpoint folder, or in a local one where both are unset and Spark is local."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="spark-")
    return f"{named.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def started(spark: SparkSession, key: str, value: str, start: Callable[[], Any]) -> Any:
    """start() with a setting of the session, which is as it was afterwards; a query keeps what it starts with."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        return start()
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def event_stream(spark: SparkSession, sf_dir: str, files_per_batch: int = 1) -> DataFrame:
    """The events table as a stream of job events."""
    held = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    source = spark.readStream.schema(held).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", "*.parquet")
    return as_job_events(source.parquet(f"{sf_dir}/events.parquet*"))


def drained(stream: DataFrame, *key: str, mode: str = "update") -> DataFrame:
    """Runs a stream over all that is there; each micro-batch is written as a table, and the last row of each key is returned."""
    spark = stream.sparkSession
    out = shared(spark, "stream")

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch={number:09d}")

    stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", shared(spark, "offsets")).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.option("recursiveFileLookup", "true").parquet(out)
    last = rows.groupBy(*key).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in key]), "batch").alias("r"))
    return last.select(*key, *[f"r.{c}" for c in rows.columns if c not in (*key, "batch")])


def live_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The job table as clients would see it once the stream has caught up; equal to the batch fold."""
    return drained(status(event_stream(spark, sf_dir)), "job_id")


def silent_jobs(events: DataFrame, lateness: str = "1 hour", silence: str = "6 hours") -> DataFrame:
    """(job_id, first_ts, last_ts, events) of sessions: a job is evicted after `silence` without an event. State is dropped behind the watermark."""
    window = F.session_window("ts", silence)
    return events.withWatermark("ts", lateness).groupBy("job_id", window).agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("events")).drop("session_window")


def ingest(spark: SparkSession, folder: str, schema, work: Callable[[DataFrame, int], None], offsets: str | None = None) -> None:
    """Hands each new batch of rows under `folder` to `work` once; files that were seen are not seen again."""
    source = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(folder)
    source.writeStream.foreachBatch(work).option("checkpointLocation", offsets or shared(spark, "offsets")).trigger(availableNow=True).start().awaitTermination()


def evicted(spark: SparkSession, sf_dir: str, files_per_batch: int = 10_000) -> DataFrame:
    """Sessions of jobs that the stream has closed and forgotten once it has caught up; those the watermark hasn't passed are still held.

    The watermark moves between batches: files that arrive together are never late for each other.
    """
    return drained(silent_jobs(event_stream(spark, sf_dir, files_per_batch)), "job_id", "first_ts", mode="append")


def accepted(uploads: DataFrame, models: DataFrame, providers: DataFrame) -> DataFrame:
    """(job_id, ext, provider, error, chars, words, tokens) of a batch of uploads (a manifest with text): the first broken rule, and what a valid upload holds."""
    rows = validated(uploads, models, providers, "text")
    good = lambda c: F.when(F.col("error").isNull(), c)
    text = F.col("text")
    return rows.select("job_id", "ext", "provider", "error", good(F.coalesce(F.length(text), F.lit(0)).cast("long")).alias("chars"), good(word_count(text)).alias("words"), good(token_estimate(text)).alias("tokens"))
