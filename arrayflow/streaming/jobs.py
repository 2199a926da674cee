"""Streams: paced task generation, continuous compression, periodic status, stale workers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from arrayflow.functions.expr import MICROS, micros, moment, ratio, stage_of
from arrayflow.functions.ordered import keep_last
from arrayflow.operators.activity import GAUGES, LOG_SHOWN, full_status
from arrayflow.operators.rolling import stale_workers
from arrayflow.operators.tensors import compress_tensors, task_stream
from arrayflow.session import pinned


def rate_tasks(spark: SparkSession, grid: DataFrame, rows_per_second: int = 2) -> DataFrame:
    """Endless stream of tasks cycling over the grid at a set pace."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()
    return task_stream(ticks, grid)


def _start(writer, checkpoint: str, once: bool, seconds: float) -> StreamingQuery:
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{seconds} seconds")).start()


def stream_compress(tensors: DataFrame, path: str, checkpoint: str, once: bool = False, seconds: float = 1) -> StreamingQuery:
    """Compress tensors as they arrive; the file sink commits every micro-batch exactly once."""
    return _start(compress_tensors(tensors).writeStream.format("parquet").option("path", path).outputMode("append"),
                  checkpoint, once, seconds)


def status_feed(closed: DataFrame, starts: DataFrame, gauges: DataFrame) -> DataFrame:
    """Closed intervals, starts and gauges as one stream of typed rows, whose state is one row per worker.

    ``starts`` are the start events (``worker_id, ts, seq, idle_time``); ``seq`` of an interval is that of its start.
    """
    rows = closed.withColumn("kind", F.lit("interval")).withColumnRenamed("end_time", "ts")
    for kind, other in (("start", starts), ("gauge", gauges)):
        rows = rows.unionByName(other.withColumn("kind", F.lit(kind)), allowMissingColumns=True)
    return rows


def stream_process_stats(feed: DataFrame) -> DataFrame:
    """Worker statistics over all rows of the feed so far: what the batch statistics give for the same rows."""
    is_interval, now = F.col("kind") == "interval", moment()

    def closed(value: Column | str) -> Column:
        return F.when(is_interval, F.col(value) if isinstance(value, str) else value)
    begun = F.when(F.col("kind") == "start", now)
    stats = feed.groupBy("worker_id").agg(
        F.count(closed(F.lit(1))).alias("total_activities"), (F.sum(closed("duration_us")) / float(MICROS)).alias("total_duration"),
        F.sum(closed("idle_time")).alias("total_idle_time"), F.avg(closed("cpu_usage")).alias("avg_cpu_usage"),
        F.avg(closed("memory_usage")).alias("avg_memory_usage"), F.min_by("worker_name", closed(now)).alias("worker_name"),
        *[F.avg(closed(g)).alias(f"avg_{g}") for g in GAUGES],
        *[F.coalesce(F.max_by("value", F.when((F.col("kind") == "gauge") & (F.col("metric") == g), now)), F.lit(0.0)).alias(f"current_{g}") for g in GAUGES],
        F.max(begun).alias("_begun"), F.max(closed(moment("start_time"))).alias("_ended"),
        F.max_by(F.when(F.col("idle_time") > 0, "idle").otherwise("active"), begun).alias("_open"))
    # A worker's newest start is open until an interval that begins with it arrives.
    still_open = F.col("_begun").isNotNull() & (F.col("_ended").isNull() | (F.col("_begun") > F.col("_ended")))
    return stats.filter(F.col("total_activities") > 0).select(
        *[c for c in stats.columns if not c.startswith("_")], ratio(F.col("total_idle_time") * 100, "total_duration").alias("idle_percentage"),
        F.when(still_open, F.col("_open")).otherwise("unknown").alias("current_status"), stage_of("worker_name").alias("stage"))


def stream_recent(log_events: DataFrame, path: str, checkpoint: str, n: int = LOG_SHOWN, once: bool = False, seconds: float = 1) -> StreamingQuery:
    """Keep the newest ``n`` messages below ``path``: each batch is merged into the ``n`` before it, and no older row is read.

    Batches write two slots in turn, so that a batch that is run again finds what it started from.
    """
    def merge(batch: DataFrame, batch_id: int) -> None:
        rows = batch.withColumn("level", F.upper("level"))
        if batch_id:
            before = batch.sparkSession.read.parquet(f"{path}/slot={(batch_id - 1) % 2}")
            rows = rows.unionByName(before.drop("batch_id"))
        kept = keep_last(rows, [], ["ts", "seq"], n).withColumn("batch_id", F.lit(batch_id))
        kept.write.mode("overwrite").parquet(f"{path}/slot={batch_id % 2}")
    return _start(log_events.writeStream.foreachBatch(merge), checkpoint, once, seconds)


def recent_messages(spark: SparkSession, path: str) -> DataFrame:
    """The messages that :func:`stream_recent` keeps now."""
    slots = spark.read.parquet(path)
    newest = slots.agg(F.max("batch_id").alias("batch_id"))
    return slots.join(newest, "batch_id", "left_semi").drop("batch_id", "slot")


def stream_status(feed: DataFrame, recent: Callable[[], DataFrame], sink: Callable[[DataFrame, int], None], checkpoint: str,
                  once: bool = False, seconds: float = 1) -> StreamingQuery:
    """Hand the status document to ``sink`` at most once per ``seconds``: worker state of the feed, and the recent messages."""
    def emit(stats: DataFrame, batch_id: int) -> None:
        sink(full_status(stats, recent()), batch_id)
    return _start(stream_process_stats(feed).writeStream.outputMode("complete").foreachBatch(emit), checkpoint, once, seconds)


def stream_stale(heartbeats: DataFrame, interval_seconds: float, sink: Callable[[DataFrame, int], None], checkpoint: str,
                 once: bool = False, seconds: float = 1) -> StreamingQuery:
    """Hand the stale workers to ``sink`` every trigger, judged against the newest beat of all."""
    def emit(last: DataFrame, batch_id: int) -> None:
        kept = pinned(last)
        now = kept.agg(F.max(micros("ts"))).first()[0]
        if now is not None:
            sink(stale_workers(kept, interval_seconds, now), batch_id)
    beats = heartbeats.groupBy("worker_id").agg(F.max("ts").alias("ts"))
    return _start(beats.writeStream.outputMode("complete").foreachBatch(emit), checkpoint, once, seconds)
