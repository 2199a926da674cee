"""Log and checkpoint operators over `lineitem` and `orders`, recovery messages from `events`."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arrayflow.functions.expr import micros
from arrayflow.operators import activity as A
from arrayflow.operators import recovery as R
from arrayflow.plans import bindings as B
from arrayflow.plans.activity_queries import EV, STATS, TASKS
from arrayflow.plans.registry import query
from arrayflow.session import scratch_path
from arrayflow.sources import logs

LOG = """
log AS (SELECT 1 AS op, l_orderkey AS "offset", l_linenumber::BIGINT AS length, l_partkey % 10 AS part, l_partkey, l_suppkey FROM lineitem
  UNION ALL SELECT 2, l_orderkey, l_linenumber, l_partkey % 10, l_partkey, l_suppkey FROM lineitem WHERE l_linestatus = 'F'
  UNION ALL SELECT 3, l_orderkey, l_linenumber, l_partkey % 10, l_partkey, l_suppkey FROM lineitem WHERE l_linestatus = 'O' AND l_returnflag = 'R')"""
CKPT = """
cp AS (SELECT o_custkey AS store, o_orderkey AS version, '{"c": ' || o_custkey || ', "total": "' || o_orderstatus || '"}' AS payload, epoch_us(o_orderdate) / 1e6 AS ts, o_orderkey % 7 <> 0 AS good FROM orders),
ld AS (SELECT * FROM cp WHERE good QUALIFY row_number() OVER (PARTITION BY store ORDER BY version DESC) = 1)"""


@query(f"""WITH {LOG} SELECT op, "offset", length, l_partkey AS part, l_suppkey AS supplier FROM log WHERE l_partkey % 11 <> 0""")
def valid_entries(spark: SparkSession, sf: str) -> DataFrame:
    header = F.encode(F.concat_ws("|", "op", "offset", "length"), "UTF-8")
    digest = F.md5(F.concat(header, F.encode("meta", "UTF-8")))
    spoiled = F.col("part") % 11 == 0
    entries = B.wal(spark, sf).withColumn("header", header).withColumn("checksum", F.unhex(F.when(spoiled, F.reverse(digest)).otherwise(digest)))
    return R.valid_entries(entries).select(F.col("op").cast("int").alias("op"), "offset", "length", "part", "supplier")


@query(f"""WITH {LOG}, c AS (SELECT DISTINCT "offset", length, part FROM log WHERE op = 2)
  SELECT "offset", length, '{{"part": ' || part || '}}' AS meta, l_suppkey AS supplier FROM log l WHERE op = 1 AND NOT EXISTS (FROM c WHERE c."offset" = l."offset" AND c.length = l.length AND c.part = l.part)""")
def uncommitted(spark: SparkSession, sf: str) -> DataFrame:
    return R.uncommitted(B.wal(spark, sf)).select("offset", "length", "meta", "supplier")


@query(f"""WITH {LOG}, c AS (SELECT DISTINCT "offset", length, part FROM log WHERE op IN (2, 3))
  SELECT "offset", length, '{{"part": ' || part || '}}' AS meta, l_suppkey AS supplier FROM log l WHERE op = 1 AND NOT EXISTS (FROM c WHERE c."offset" = l."offset" AND c.length = l.length AND c.part = l.part)""")
def unresolved(spark: SparkSession, sf: str) -> DataFrame:
    return R.unresolved(B.wal(spark, sf)).select("offset", "length", "meta", "supplier")


@query(f"""WITH {LOG} SELECT "offset"::VARCHAR AS path, op, "offset", length, '{{"part": ' || part || '}}' AS meta, l_partkey % 11 <> 0 AS checksum_ok FROM log""")
def read_wal(spark: SparkSession, sf: str) -> DataFrame:
    """One binary log per order, as long as the order; entries in order of (line, kind)."""
    entries = B.wal(spark, sf).select(
        F.col("offset").cast("string").alias("path"), (F.col("length") * 4 + F.col("op")).alias("seq"), "op", F.lit(0.5).alias("ts"), "offset", "length", "meta", (F.col("part") % 11 == 0).alias("spoiled"))
    parsed = logs.parse_wal(logs.wal_files(entries))
    return parsed.select("path", F.col("op").cast("int").alias("op"), "offset", "length", "meta", "checksum_ok")


@query(f"WITH {CKPT} SELECT store, version FROM cp QUALIFY row_number() OVER (PARTITION BY store ORDER BY version DESC) <= 3")
def rotate(spark: SparkSession, sf: str) -> DataFrame:
    return R.rotate(B.checkpoints(spark, sf), by=["store"]).select("store", "version")


@query(f"WITH {CKPT} SELECT store, version, payload FROM ld")
def load_checkpoint(spark: SparkSession, sf: str) -> DataFrame:
    return R.load_checkpoint(B.checkpoints(spark, sf), ["store"]).select("store", "version", "payload")


@query(f"WITH {CKPT} SELECT store, version, ts, '1.0' AS system_version, '1.0' AS schema_version FROM ld")
def checkpoint_info(spark: SparkSession, sf: str) -> DataFrame:
    return R.checkpoint_info(B.checkpoints(spark, sf), ["store"])


@query("SELECT 2::BIGINT AS version, o_custkey AS store, count(*) AS n, true AS valid FROM orders GROUP BY 2")
def save_checkpoint(spark: SparkSession, sf: str) -> DataFrame:
    """Two versions of all stores' states are saved; the newest valid one is loaded for every state."""
    path = scratch_path(spark, "checkpoints")
    state = B.checkpoints(spark, sf).select("store", F.col("version").alias("state_id"), "payload")
    for version in (1, 2):
        logs.save_checkpoint(state, path, version, ts=float(version))
    loaded = R.load_checkpoint(logs.read_checkpoints(spark, path), ["store", "state_id"])
    return loaded.groupBy("version", "store").agg(F.count(F.lit(1)).alias("n"), F.min(F.col("payload").startswith('{"c": ')).alias("valid"))


@query(f"""WITH {CKPT}, failed AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'error')
  SELECT coalesce(store, user_id) AS worker_id, CASE WHEN user_id IS NOT NULL THEN 'restarted' ELSE payload[-3:-3] END AS health FROM ld FULL JOIN failed ON store = user_id""")
def restore_health(spark: SparkSession, sf: str) -> DataFrame:
    loaded = R.load_checkpoint(B.checkpoints(spark, sf), ["store"])
    health = loaded.select(F.col("store").alias("worker_id"), F.get_json_object("payload", "$.total").alias("health"))
    failures = B.events(spark, sf).filter(F.col("event_type") == "error").select(F.col("user_id").alias("worker_id"))
    return R.restore_health(health, failures)


@query("""WITH good AS (SELECT * FROM orders WHERE o_orderkey % 7 <> 0 QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1),
  failed AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'error'),
  health AS (SELECT o_custkey AS store, unnest([o_custkey, o_custkey + 1]) AS worker, o_orderstatus AS health FROM good)
  SELECT o_custkey AS store, 'active_tasks' AS part, 't' || o_orderkey AS entry, '0' AS value FROM good
  UNION ALL SELECT o_custkey, 'active_tasks', 'p' || o_orderpriority, '1' FROM good
  UNION ALL SELECT o_custkey, 'buffer_usage', o_custkey::VARCHAR, (o_orderkey % 5)::VARCHAR FROM good
  UNION ALL SELECT coalesce(store, user_id), 'process_health', coalesce(worker, user_id)::VARCHAR, CASE WHEN user_id IS NOT NULL THEN 'restarted' ELSE health END
    FROM health FULL JOIN failed ON store = user_id AND worker = user_id""")
def restore_state(spark: SparkSession, sf: str) -> DataFrame:
    """A store per customer, every seventh version spoiled; a failed worker belongs to the store of its number."""
    key, worker = F.col("o_orderkey"), F.col("o_custkey")
    payload = F.to_json(F.struct(
        F.array(F.concat(F.lit("t"), key), F.concat(F.lit("p"), F.col("o_orderpriority"))).alias("active_tasks"),
        F.create_map(worker.cast("string"), key % 5).alias("buffer_usage"),
        F.create_map(worker.cast("string"), F.col("o_orderstatus"), (worker + 1).cast("string"), F.col("o_orderstatus")).alias("process_health")))
    saved = B.table(spark, sf, "orders").select(worker.alias("store"), key.alias("version"), payload.alias("payload"))
    good = F.sha2(F.col("payload").cast("binary"), 256)
    saved = saved.withColumn("checksum", F.when(F.col("version") % 7 == 0, F.reverse(good)).otherwise(good))
    failures = B.events(spark, sf).filter(F.col("event_type") == "error").select(F.col("user_id").alias("store"), F.col("user_id").alias("worker_id"))
    return R.restore_state(saved, failures, ["store"])


@query(f"""WITH {EV} SELECT us AS ts_us, seq, CASE event_type WHEN 'error' THEN 'failure' WHEN 'signup' THEN 'restart' WHEN 'view' THEN 'restore' ELSE 'checkpoint' END AS event, worker_id, message
  FROM ev WHERE event_type <> 'click'""")
def recovery_events(spark: SparkSession, sf: str) -> DataFrame:
    return R.recovery_events(B.log_events(spark, sf)).withColumn("ts_us", micros("ts")).drop("ts")


@query(f"""WITH {STATS}, {TASKS}, c AS (SELECT sum(round(value * 100)::BIGINT) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS n FROM events)
  SELECT 'activities' AS part, worker_id, total_activities AS n, round(total_idle_time, 4) AS total FROM stats
  UNION ALL SELECT 'gauges', worker_id, count(*), round(sum(value), 4) FROM ev GROUP BY 2
  UNION ALL SELECT 'tasks', -1, count(*), round(sum(duration), 4) FROM tasks
  UNION ALL SELECT 'error_logs', worker_id, count(*), sum(length(message))::DOUBLE FROM ev GROUP BY 2
  UNION ALL SELECT 'system_metrics', -1, count(*), sum(n)::DOUBLE FROM c""")
def export_activity_json(spark: SparkSession, sf: str) -> DataFrame:
    """Every part of the export, read back from its files."""
    path = scratch_path(spark, "export")
    logs.export_activity_json(path, B.activities(spark, sf), {
        "gauges": B.gauges(spark, sf), "tasks": A.task_lifecycle(B.task_events(spark, sf)), "error_logs": B.log_events(spark, sf),
        "system_metrics": B.system_metrics(spark, sf)}, piece=100)

    def part(name: str, schema: str, n: Column, total: Column, worker: str = "worker_id") -> DataFrame:
        rows = spark.read.schema(schema).json(f"{path}/{name}")
        return rows.groupBy(F.expr(worker).cast("bigint").alias("worker_id")).agg(n.cast("bigint").alias("n"), F.round(total, 4).alias("total")).select(
            F.lit(name).alias("part"), "worker_id", "n", "total")
    idle, rows = F.aggregate("activities", F.lit(0.0), lambda acc, a: acc + a["idle_time"]), F.count(F.lit(1))
    parts = [part("activities", "worker_id bigint, activities array<struct<idle_time:double>>", F.sum(F.size("activities")), F.sum(idle)),
             part("gauges", "worker_id bigint, value double", rows, F.sum("value")),
             part("tasks", "duration double", rows, F.sum("duration"), "-1"),
             part("error_logs", "worker_id bigint, message string", rows, F.sum(F.length("message")).cast("double")),
             part("system_metrics", "disk_read_bytes bigint", rows, F.sum("disk_read_bytes").cast("double"), "-1")]
    return reduce(DataFrame.union, parts)
