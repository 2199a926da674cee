"""Streams replayed from the given tables until they are used up, then read back from their sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arrayflow.operators.tensors import decompress_tensors
from arrayflow.plans import bindings as B
from arrayflow.plans.activity_queries import ACT, STATS
from arrayflow.plans.registry import query
from arrayflow.session import scratch_path
from arrayflow.streaming import intervals, jobs


def replay(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet file or directory as a stream. A stream's path may name a single file only as a pattern."""
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]")


@query("SELECT doc_id AS tensor_id, strlen(text) AS original_size, md5(text) AS digest FROM documents")
def stream_compress(spark: SparkSession, sf: str) -> DataFrame:
    docs = replay(spark, f"{sf}/documents.parquet").select(F.col("doc_id").alias("tensor_id"), F.encode("text", "UTF-8").alias("payload"))
    out = scratch_path(spark, "compressed")
    jobs.stream_compress(docs, f"{out}/data", f"{out}/state", once=True).awaitTermination()
    stored = spark.read.parquet(f"{out}/data")
    plain = decompress_tensors(stored.withColumn("size", F.col("original_size").cast("bigint")))
    return plain.select("tensor_id", F.col("size").alias("original_size"), F.md5("payload").alias("digest"))


#: A time after all events (that nanoseconds can hold): the tick that ends a replay.
END = "2200-01-01"


def replayed_events(spark: SparkSession, sf: str) -> DataFrame:
    return replay(spark, f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


@query(f"WITH {ACT} SELECT worker_id, seq::VARCHAR AS task_id, start_us, end_us, duration_us / 1e6 AS duration FROM act WHERE end_us IS NOT NULL")
def stream_intervals(spark: SparkSession, sf: str) -> DataFrame:
    out = scratch_path(spark, "intervals")
    events = replayed_events(spark, sf).select(F.col("user_id").alias("worker_id"), "ts", F.col("event_id").alias("seq"), F.lit("start").alias("kind"), F.col("event_id").alias("task_id"))
    end = spark.range(1).select(F.lit(None).cast("bigint").alias("worker_id"), F.lit(END).cast("timestamp").alias("ts"), F.lit(0).cast("bigint").alias("seq"),
                                F.lit(intervals.TICK).alias("kind"), F.lit(None).cast("bigint").alias("task_id"))
    end.write.parquet(f"{out}/end")
    both = events.unionByName(spark.readStream.schema(end.schema).parquet(f"{out}/end"))
    (intervals.stream_intervals(both).writeStream.format("parquet").option("path", f"{out}/data").option("checkpointLocation", f"{out}/state")
     .trigger(availableNow=True).start().awaitTermination())
    return spark.read.parquet(f"{out}/data")


@query(f"""WITH {STATS} SELECT count(*) AS total_processes, count(*) FILTER (current_status = 'active') AS active_processes,
  round(sum(current_queue_size), 4) AS total_queue_size, round(sum(current_throughput), 4) AS total_throughput,
  (sum(total_activities) FILTER (stage = 'compressor'))::BIGINT AS total_compressed, count(*) FILTER (idle_percentage <= 50) AS active_workers,
  (SELECT sum(seq) FROM (SELECT seq FROM ev ORDER BY us DESC, seq DESC LIMIT 10))::BIGINT AS messages FROM stats""")
def stream_status(spark: SparkSession, sf: str) -> DataFrame:
    out = scratch_path(spark, "status")
    B.activities(spark, sf).filter(F.col("end_time").isNotNull()).write.parquet(f"{out}/activities")
    jobs.stream_recent(B.log_events(spark, sf, replayed_events(spark, sf)), f"{out}/recent", f"{out}/log_state", once=True).awaitTermination()

    def keep(status: DataFrame, batch_id: int) -> None:
        status.withColumn("batch_id", F.lit(batch_id)).write.mode("append").parquet(f"{out}/status")
    starts = replayed_events(spark, sf).select(F.col("user_id").alias("worker_id"), "ts", F.col("event_id").alias("seq"), F.col("value").alias("idle_time"))
    feed = jobs.status_feed(replay(spark, f"{out}/activities"), starts, B.gauges(spark, sf, replayed_events(spark, sf)))
    jobs.stream_status(feed, lambda: jobs.recent_messages(spark, f"{out}/recent"), keep, f"{out}/state", once=True).awaitTermination()
    last = spark.read.parquet(f"{out}/status").agg(F.max_by("status", "batch_id").alias("status"))

    def field(section: str, path: str, kind: str = "bigint") -> Column:
        return F.get_json_object(F.col("status")[section], path).cast(kind)
    messages = F.from_json(F.get_json_object(F.col("status")["errors"], "$.messages"), "array<struct<seq:bigint>>")
    return last.select(field("workers", "$.total_processes").alias("total_processes"), field("workers", "$.active_processes").alias("active_processes"),
                       F.round(field("queues", "$.total_queue_size", "double"), 4).alias("total_queue_size"),
                       F.round(field("workers", "$.total_throughput", "double"), 4).alias("total_throughput"),
                       field("compression", "$.total_compressed").alias("total_compressed"), field("idle", "$.workers_by_status.active").alias("active_workers"),
                       F.aggregate(messages, F.lit(0).cast("bigint"), lambda n, m: n + m["seq"]).alias("messages"))


@query("""WITH l AS (SELECT user_id AS worker_id, max(epoch_us(ts)) AS last_beat_us FROM events GROUP BY 1)
  SELECT * FROM l WHERE (SELECT max(epoch_us(ts)) FROM events) - last_beat_us > 2 * 21600 * 1000000::BIGINT""")
def stream_stale(spark: SparkSession, sf: str) -> DataFrame:
    beats = replay(spark, f"{sf}/events.parquet").select(F.col("user_id").alias("worker_id"), F.col("ts").cast("timestamp").alias("ts"))
    out = scratch_path(spark, "stale")

    def keep(stale: DataFrame, batch_id: int) -> None:
        stale.write.mode("overwrite").parquet(f"{out}/data")
    jobs.stream_stale(beats, 6 * 3600, keep, f"{out}/state", once=True).awaitTermination()
    return spark.read.parquet(f"{out}/data")
