"""The given tables as the operators' input tables. NTZ timestamps become UTC timestamps once, here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arrayflow.functions.expr import micros
from arrayflow.functions.ordered import running_sum
from arrayflow.operators.activity import build_intervals

# Which gauge each kind of event reports.
GAUGE_OF = {"click": "throughput", "view": "queue_size", "purchase": "buffer_usage", "signup": "compression_ratio", "error": "write_speed"}
CLUSTER_SIZE = 32
CHUNK = 1024
SHARDS = 3


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def worker_name(user: str = "user_id") -> Column:
    kinds = F.array(*[F.lit(k) for k in ("Producer", "Compressor", "Writer", "other")])
    return F.concat(F.element_at(kinds, (F.col(user) % 4 + 1).cast("int")), F.lit("-"), F.col(user))


def events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def activity_events(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf).select(
        F.col("user_id").alias("worker_id"), worker_name().alias("worker_name"), "ts", F.col("event_id").alias("seq"),
        F.lit("start").alias("kind"), F.col("event_id").cast("string").alias("task_id"), "value")


def activities(spark: SparkSession, sf: str) -> DataFrame:
    return with_gauges(build_intervals(activity_events(spark, sf)))


def with_gauges(intervals: DataFrame) -> DataFrame:
    value, seq = F.col("value"), F.col("seq")
    return intervals.withColumns({
        "idle_time": F.least(value, F.coalesce("duration", value)), "cpu_usage": F.least(F.lit(100.0), value),
        "memory_usage": (seq % 100).cast("double"), "buffer_usage": (seq % 5).cast("int"), "queue_size": (seq % 7).cast("int"),
        "throughput": value, "compression_ratio": (seq % 10) / 10.0, "write_speed": value * 2}).drop("value")


def gauges(spark: SparkSession, sf: str, source: DataFrame | None = None) -> DataFrame:
    """Gauges of the events, or of ``source``, a stream of events."""
    metric = F.create_map(*[F.lit(x) for pair in GAUGE_OF.items() for x in pair])[F.col("event_type")]
    rows = events(spark, sf) if source is None else source
    return rows.select(
        F.col("user_id").alias("worker_id"), worker_name().alias("worker_name"), metric.alias("metric"), "ts", F.col("event_id").alias("seq"), "value")


def heartbeats(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf).select(F.col("user_id").alias("worker_id"), "ts")


def log_events(spark: SparkSession, sf: str, source: DataFrame | None = None) -> DataFrame:
    """Messages of the events, or of ``source``, a stream of events."""
    user = F.col("user_id")
    message = (F.when(F.col("event_type") == "error", F.concat(F.lit("Process "), user, F.lit(" unresponsive")))
               .when(F.col("event_type") == "signup", F.concat(F.lit("Process "), user, F.lit(" restarted")))
               .when(F.col("event_type") == "purchase", F.lit("Checkpoint saved"))
               .when(F.col("event_type") == "view", F.lit("Restored system state")).otherwise(F.col("props")))
    rows = events(spark, sf) if source is None else source
    return rows.select("ts", F.col("event_id").alias("seq"), F.col("event_type").alias("level"), message.alias("message"), user.alias("worker_id"))


def task_events(spark: SparkSession, sf: str) -> DataFrame:
    """Orders create tasks, line items start them and, once closed, complete or (if returned) fail them."""
    orders, items = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    ship = F.col("l_shipdate").cast("timestamp")
    key, worker = F.col("l_orderkey").cast("string"), F.col("l_suppkey")
    created = orders.select(F.col("o_orderkey").cast("string").alias("task_id"), F.col("o_orderpriority").alias("task_type"),
                            F.col("o_orderdate").cast("timestamp").alias("ts"), F.lit(0).cast("bigint").alias("seq"), F.lit("created").alias("event"),
                            F.lit(None).cast("bigint").alias("worker_id"))
    none = F.lit(None).cast("string").alias("task_type")
    started = items.select(key.alias("task_id"), none, ship.alias("ts"), (worker + 1).alias("seq"), F.lit("started").alias("event"), worker.alias("worker_id"))
    ended_at = F.timestamp_micros(micros(ship) + F.col("l_quantity").cast("bigint") * 3_600_000_000)
    ended = items.filter(F.col("l_linestatus") == "F").select(
        key.alias("task_id"), none, ended_at.alias("ts"), (worker + 1_000_000_000).alias("seq"),
        F.when(F.col("l_returnflag") == "R", "failed").otherwise("completed").alias("event"), worker.alias("worker_id"))
    return created.unionByName(started).unionByName(ended)


def spans(spark: SparkSession, sf: str) -> DataFrame:
    """Orders open from their date to their last shipment."""
    last = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("ship"))
    joined = table(spark, sf, "orders").join(last, "o_orderkey").filter(F.col("ship") > F.col("o_orderdate"))
    return joined.select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("timestamp").alias("start_time"), F.col("ship").cast("timestamp").alias("end_time"))


def buffer_events(spark: SparkSession, sf: str) -> DataFrame:
    change = F.explode(F.array(F.struct(F.lit("acquire").alias("kind"), F.col("start_time").alias("ts")),
                               F.struct(F.lit("release").alias("kind"), F.col("end_time").alias("ts")))).alias("c")
    rows = spans(spark, sf).select("o_orderkey", "o_custkey", change)
    return rows.select((F.col("o_orderkey") % 64).alias("buffer_id"), F.col("c.ts").alias("ts"),
                       (F.col("o_orderkey") * 2 + (F.col("c.kind") == "release").cast("int")).alias("seq"), "c.kind",
                       F.concat(F.lit("t"), F.col("o_custkey") % 8).alias("owner"))


def system_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """A growing byte counter per event type."""
    rows = events(spark, sf).select(F.col("event_type").alias("host"), "ts", F.col("event_id").alias("seq"), F.round(F.col("value") * 100).cast("bigint").alias("n"))
    return running_sum(rows, ["host"], ["ts", "seq"], {"disk_read_bytes": "n"}).drop("n")


def stage_events(spark: SparkSession, sf: str) -> DataFrame:
    stage = F.element_at(F.array(F.lit("producer"), F.lit("compressor"), F.lit("writer")), (F.col("user_id") % 3 + 1).cast("int"))
    return events(spark, sf).select(
        stage.alias("stage"), F.col("user_id").alias("worker_id"), "ts", F.round(F.col("value") * 1000).cast("bigint").alias("n_bytes"),
        (F.col("value") / 100).alias("seconds"), ((F.col("event_id") % 10) / 10.0).alias("compression_ratio"))


def catalog(spark: SparkSession, sf: str) -> DataFrame:
    size, key = F.col("p_size"), F.col("p_partkey")
    return table(spark, sf, "part").select(
        key.alias("tensor_id"), F.col("p_name").alias("name"), F.concat(F.lit("t_"), key, F.lit(".bin")).alias("filename"),
        F.array(size.cast("bigint"), key % 10 + 1).alias("shape"), F.when(size % 2 == 0, "float32").otherwise("float64").alias("dtype"),
        F.timestamp_seconds(F.lit(1_600_000_000) + key).alias("created_at"), F.lit(None).cast("string").alias("compressed_file"))


def cells(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("tensor_id"), F.posexplode("embedding").alias("pos", "value")).select(
        "tensor_id", F.col("pos").cast("bigint").alias("pos"), F.col("value").cast("double").alias("value"))


def embedding_tensors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("tensor_id"), F.lit("float32").alias("dtype"),
        F.array(F.lit(1).cast("bigint"), F.size("embedding").cast("bigint")).alias("shape"), "embedding")


def payloads(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("file_id"), F.col("source").alias("name"), "lang", "n_chars", F.encode("text", "UTF-8").alias("payload"))


def shards(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "supplier").select(
        F.col("s_nationkey").alias("array_id"), F.col("s_suppkey").alias("shard_id"), F.lit(1000.0).alias("capacity_gb"), (F.abs("s_acctbal") / 20).alias("used_gb"))


def workers(spark: SparkSession, sf: str) -> DataFrame:
    user = F.col("worker_id")
    even = user % 2 == 0
    seen = events(spark, sf).groupBy(F.col("user_id").alias("worker_id")).agg(
        F.count_if(F.col("event_type") == "error").alias("errors"), F.max("value").alias("top"))
    return seen.select(
        F.floor(user / CLUSTER_SIZE).cast("bigint").alias("cluster"), "worker_id",
        F.when(even, (user % 14) / 100 + 0.85).otherwise((user % 12) / 100).alias("current_load"),
        F.when(even, 0.05).otherwise((user % 6) / 10 + 0.4).alias("idle_probability"),
        (F.col("errors") % 10).cast("int").alias("queue_size"), F.least(F.lit(100.0), F.col("top") / 3).alias("cpu_usage"),
        (user * 11 % 90).cast("double").alias("memory_usage"))


def wal(spark: SparkSession, sf: str) -> DataFrame:
    """Intents for all line items, commits for closed ones, rollbacks for returned open ones."""
    items = table(spark, sf, "lineitem")
    closed, open_returned = F.col("l_linestatus") == "F", (F.col("l_linestatus") == "O") & (F.col("l_returnflag") == "R")
    ops = F.filter(F.array(F.lit(1), F.when(closed, 2), F.when(open_returned, 3)), lambda op: op.isNotNull())
    return items.withColumn("op", F.explode(ops)).select(
        F.col("op").cast("tinyint").alias("op"), F.col("l_orderkey").alias("offset"), F.col("l_linenumber").cast("bigint").alias("length"),
        F.concat(F.lit('{"part": '), F.col("l_partkey") % 10, F.lit("}")).alias("meta"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supplier"))


def checkpoints(spark: SparkSession, sf: str) -> DataFrame:
    """One checkpoint store per customer; every seventh version is spoiled."""
    key = F.col("o_orderkey")
    payload = F.concat(F.lit('{"c": '), F.col("o_custkey"), F.lit(', "total": "'), F.col("o_orderstatus"), F.lit('"}'))
    good = F.sha2(payload.cast("binary"), 256)
    return table(spark, sf, "orders").select(
        F.col("o_custkey").alias("store"), key.alias("version"), F.lit("1.0").alias("system_version"), F.lit("1.0").alias("schema_version"),
        (micros(F.col("o_orderdate").cast("timestamp")) / 1e6).alias("ts"), payload.alias("payload"),
        F.when(key % 7 == 0, F.reverse(good)).otherwise(good).alias("checksum"))
