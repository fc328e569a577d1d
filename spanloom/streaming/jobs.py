"""Streaming forms of the event operators. Each builder takes a stream (or a table) and returns a DataFrame, so that batch results are comparable."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.core import half_even
from ..sources.generations import BUCKETS, upsert_generation

EVENT_DDL = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
STALE_SECONDS = 120


def read_events(spark: SparkSession, path: str, max_files: int = 1) -> DataFrame:
    """Parquet files of a folder as a stream."""
    return spark.readStream.schema(EVENT_DDL).option("maxFilesPerTrigger", max_files).parquet(path)


def run_events(events: DataFrame) -> DataFrame:
    """Run events from the raw ones: the run is the user; event types in the vocabulary of runs."""
    kind = F.create_map(*[F.lit(x) for p in {
        "purchase": "call_succeeded", "error": "call_failed", "signup": "candidate_evaluated", "view": "progress", "click": "call_started",
    }.items() for x in p])
    k = F.get_json_object("props", "$.k").cast("long")
    return events.select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("run_id"), kind[F.col("event_type")].alias("event_type"), F.col("value").alias("loss"), k.alias("tokens"))


def live_progress(events: DataFrame) -> DataFrame:
    """Counters per run and event type."""
    return events.groupBy("run_id", "event_type").agg(F.count(F.lit(1)).alias("event_count"), F.sum("tokens").alias("tokens"), F.min("loss").alias("best_loss"), F.max("ts").alias("last_ts"))


def throughput(events: DataFrame, window: str = "60 seconds", slide: str | None = "10 seconds", watermark: str | None = "10 minutes") -> DataFrame:
    """Finished calls per window. Sliding windows give the recent rate, tumbling ones (``slide=None``) a series."""
    done = events.where(F.col("event_type") == "call_succeeded")
    if watermark and done.isStreaming:
        done = done.withWatermark("ts", watermark)
    w = F.window("ts", window, slide) if slide else F.window("ts", window)
    return done.groupBy(w.alias("w")).agg(F.count(F.lit(1)).alias("completed")).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "completed")


def eta_from_throughput(rates: DataFrame, remaining: int, seconds: int = 60) -> DataFrame:
    return rates.withColumn("eta_seconds", half_even(F.lit(float(remaining)) * seconds / F.col("completed"), 2))


def active_sessions(events: DataFrame, gap_seconds: int = STALE_SECONDS, watermark: str | None = "10 minutes") -> DataFrame:
    """Stretches of a run without a pause longer than the limit; where one ends before the data does, the run may be interrupted."""
    if watermark and events.isStreaming:
        events = events.withWatermark("ts", watermark)
    return events.groupBy("run_id", F.session_window("ts", f"{gap_seconds} seconds").alias("w")).agg(F.count(F.lit(1)).alias("event_count"), F.max("ts").alias("last_ts")).select(
        "run_id", F.col("w.start").alias("started_at"), F.col("w.end").alias("stale_at"), "event_count", "last_ts"
    )


def stale_runs(events: DataFrame, now: object, limit_seconds: int = STALE_SECONDS) -> DataFrame:
    """Runs without an event for longer than the limit at the given time (a timestamp literal or column)."""
    last = events.groupBy("run_id").agg(F.max("ts").alias("last_ts"))
    now = F.lit(now).cast("timestamp") if not hasattr(now, "cast") else now
    idle = F.unix_seconds(now) - F.unix_seconds(F.date_trunc("second", "last_ts"))
    return last.withColumn("idle_seconds", idle).where(F.col("idle_seconds") > limit_seconds)


def upsert_stream(events: DataFrame, target: str, keys: list[str], order: list[str], checkpoint: str, buckets: int = BUCKETS) -> StreamingQuery:
    """Keeps the newest row per key in a bucketed table; ``read_state`` reads it. A batch rewrites only the buckets of its keys.

    Rows are newest by ``order`` (a version, then what tells rows of one version apart). A repeated batch writes the same generation again.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        upsert_generation(batch, target, batch_id, keys, order, buckets)

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_to_memory(df: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """Drain a stream into an in-memory table, for tests and small results."""
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def process_once(events: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hands every file to ``handle`` once; after a restart the checkpoint skips what is finished."""
    return events.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def task_changes(events: DataFrame) -> DataFrame:
    """Changes of tasks and reviews out of raw events: (kind, item_id, status, value, updated_at, event_id)."""
    review = F.col("event_type").isin("purchase", "error")
    status = F.when(F.col("event_type") == "purchase", "accepted").when(F.col("event_type") == "error", "rejected").when(F.col("event_type") == "signup", "created").otherwise("pending")
    return events.select(
        F.when(review, "review").otherwise("task").alias("kind"), F.col("user_id").alias("item_id"), status.alias("status"), "value",
        F.unix_micros(F.col("ts").cast("timestamp")).alias("updated_at"), "event_id")
