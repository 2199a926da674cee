"""Activity operators over `events`, `orders` and `lineitem`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arrayflow.functions.expr import micros
from arrayflow.functions.ordered import keep_last
from arrayflow.operators import activity as A
from arrayflow.plans import bindings as B
from arrayflow.plans.registry import NUDGE, query, rounded

EV = """
ev AS (SELECT event_id AS seq, epoch_us(ts) AS us, user_id AS worker_id, event_type, value,
  ['Producer','Compressor','Writer','other'][user_id % 4 + 1] || '-' || user_id AS worker_name,
  CASE event_type WHEN 'click' THEN 'throughput' WHEN 'view' THEN 'queue_size' WHEN 'purchase' THEN 'buffer_usage'
    WHEN 'signup' THEN 'compression_ratio' ELSE 'write_speed' END AS metric,
  CASE event_type WHEN 'error' THEN 'Process ' || user_id || ' unresponsive' WHEN 'signup' THEN 'Process ' || user_id || ' restarted'
    WHEN 'purchase' THEN 'Checkpoint saved' WHEN 'view' THEN 'Restored system state' ELSE props END AS message
  FROM events)"""
ACT = EV + """,
iv AS (SELECT *, us AS start_us, lead(us) OVER (PARTITION BY worker_id ORDER BY us, seq) AS end_us FROM ev),
act AS (SELECT *, end_us - start_us AS duration_us, least(value, coalesce((end_us - start_us) / 1e6, value)) AS idle_time,
  least(100, value) AS cpu_usage, seq % 100 AS memory_usage, seq % 5 AS buffer_usage, seq % 7 AS queue_size,
  value AS throughput, (seq % 10) / 10.0 AS compression_ratio, value * 2 AS write_speed FROM iv),
recent AS (SELECT * FROM act WHERE end_us IS NOT NULL)"""
STATS = ACT + """,
gauge AS (SELECT worker_id, metric, arg_max(value, us) AS value FROM ev GROUP BY 1, 2),
cur AS (SELECT worker_id,
  max(value) FILTER (metric = 'buffer_usage') AS current_buffer_usage, max(value) FILTER (metric = 'queue_size') AS current_queue_size,
  max(value) FILTER (metric = 'throughput') AS current_throughput, max(value) FILTER (metric = 'compression_ratio') AS current_compression_ratio,
  max(value) FILTER (metric = 'write_speed') AS current_write_speed FROM gauge GROUP BY 1),
opened AS (SELECT worker_id, max(CASE WHEN idle_time > 0 THEN 'idle' ELSE 'active' END) AS status FROM act WHERE end_us IS NULL GROUP BY 1),
base AS (SELECT worker_id, count(*) AS total_activities, sum(duration_us)::BIGINT / 1e6 AS total_duration, sum(idle_time) AS total_idle_time,
  avg(cpu_usage) AS avg_cpu_usage, avg(memory_usage) AS avg_memory_usage, arg_min(worker_name, end_us) AS worker_name,
  avg(buffer_usage) AS avg_buffer_usage, avg(queue_size) AS avg_queue_size, avg(throughput) AS avg_throughput,
  avg(compression_ratio) AS avg_compression_ratio, avg(write_speed) AS avg_write_speed FROM recent GROUP BY 1),
stats AS (SELECT base.*, CASE WHEN total_duration > 0 THEN total_idle_time * 100 / total_duration ELSE 0 END AS idle_percentage,
  coalesce(current_buffer_usage, 0) AS current_buffer_usage, coalesce(current_queue_size, 0) AS current_queue_size,
  coalesce(current_throughput, 0) AS current_throughput, coalesce(current_compression_ratio, 0) AS current_compression_ratio,
  coalesce(current_write_speed, 0) AS current_write_speed, coalesce(status, 'unknown') AS current_status,
  CASE WHEN lower(worker_name) LIKE '%producer%' THEN 'producer' WHEN lower(worker_name) LIKE '%compressor%' THEN 'compressor'
    WHEN lower(worker_name) LIKE '%writer%' THEN 'writer' ELSE 'unknown' END AS stage
  FROM base LEFT JOIN cur USING (worker_id) LEFT JOIN opened USING (worker_id))"""
TASKS = """
te AS (
  SELECT o_orderkey AS k, o_orderpriority AS task_type, epoch_us(o_orderdate) AS us, 0::BIGINT AS seq, 'created' AS event, NULL::BIGINT AS worker FROM orders
  UNION ALL SELECT l_orderkey, NULL, epoch_us(l_shipdate), l_suppkey + 1, 'started', l_suppkey FROM lineitem
  UNION ALL SELECT l_orderkey, NULL, epoch_us(l_shipdate) + l_quantity::BIGINT * 3600000000, l_suppkey + 1000000000,
    CASE WHEN l_returnflag = 'R' THEN 'failed' ELSE 'completed' END, l_suppkey FROM lineitem WHERE l_linestatus = 'F'),
known AS (SELECT *, max(CASE WHEN event = 'started' THEN us END) OVER (PARTITION BY k ORDER BY us, seq ROWS UNBOUNDED PRECEDING) AS started,
  row_number() OVER (PARTITION BY k ORDER BY us, seq) AS rn FROM te),
tasks AS (SELECT k::VARCHAR AS task_id, max(task_type) AS task_type, min(us) FILTER (event = 'created') AS created_us,
  max(us) FILTER (event = 'started') AS started_us, max(us) FILTER (event = 'completed') AS completed_us,
  arg_max(us - started, rn) FILTER (event = 'completed') / 1e6 AS duration, arg_max(worker, rn) FILTER (event = 'started') AS assigned_worker,
  CASE arg_max(event, rn) WHEN 'created' THEN 'pending' WHEN 'started' THEN 'running' ELSE arg_max(event, rn) END AS status
  FROM known GROUP BY k)"""
SPANS = """
ship AS (SELECT l_orderkey, max(l_shipdate) AS ship FROM lineitem GROUP BY 1),
spans AS (SELECT o_orderkey, o_custkey, epoch_us(o_orderdate) AS s, epoch_us(ship) AS e FROM orders JOIN ship ON o_orderkey = l_orderkey WHERE ship > o_orderdate)"""
BUF = SPANS + """,
buf AS (SELECT o_orderkey % 64 AS buffer_id, s AS us, o_orderkey * 2 AS seq, 'acquire' AS kind, 't' || (o_custkey % 8) AS owner FROM spans
  UNION ALL SELECT o_orderkey % 64, e, o_orderkey * 2 + 1, 'release', 't' || (o_custkey % 8) FROM spans)"""
STAGES = """
counters AS (SELECT ['producer','compressor','writer'][user_id % 3 + 1] AS stage, user_id AS worker_id, count(*) AS items,
  sum(round(value * 1000)::BIGINT)::BIGINT AS total_bytes, avg(value / 100) AS avg_time, avg((event_id % 10) / 10.0) AS avg_ratio,
  max(epoch_us(ts)) AS last_us FROM events GROUP BY 1, 2)"""


def us(df: DataFrame, **columns: str) -> DataFrame:
    """Timestamps as epoch microseconds under new names."""
    return df.withColumns({new: micros(old) for new, old in columns.items()}).drop(*columns.values())


def stats_of(spark: SparkSession, sf: str) -> DataFrame:
    return A.process_stats(B.activities(spark, sf), B.gauges(spark, sf))


@query(f"WITH {ACT} SELECT worker_id, seq::VARCHAR AS task_id, start_us, coalesce(end_us, -1) AS end_us, coalesce(duration_us, -1) AS duration_us FROM act")
def build_intervals(spark: SparkSession, sf: str) -> DataFrame:
    rows = us(A.build_intervals(B.activity_events(spark, sf)), start_us="start_time", end_us="end_time")
    return rows.select("worker_id", "task_id", "start_us", F.coalesce("end_us", F.lit(-1)).alias("end_us"), F.coalesce("duration_us", F.lit(-1)).alias("duration_us"))


@query(f"""WITH {STATS} SELECT worker_id, total_activities, round(total_duration, 6) AS total_duration, round(total_idle_time, 6) AS total_idle_time,
  round(idle_percentage + {NUDGE}, 6) AS idle_percentage, round(avg_cpu_usage + {NUDGE}, 6) AS avg_cpu_usage, round(avg_memory_usage + {NUDGE}, 6) AS avg_memory_usage FROM stats""")
def worker_stats(spark: SparkSession, sf: str) -> DataFrame:
    stats = rounded(A.worker_stats(B.activities(spark, sf)), "total_duration", "total_idle_time")
    return rounded(stats, "idle_percentage", "avg_cpu_usage", "avg_memory_usage", nudge=NUDGE)


_MEANS = [f"avg_{g}" for g in A.GAUGES]
_NOW = [f"current_{g}" for g in A.GAUGES]


@query(f"""WITH {STATS} SELECT worker_id, worker_name, stage, current_status, total_activities, {", ".join(f"round({c} + {NUDGE}, 6) AS {c}" for c in _MEANS + _NOW)} FROM stats""")
def process_stats(spark: SparkSession, sf: str) -> DataFrame:
    stats = stats_of(spark, sf).select("worker_id", "worker_name", "stage", "current_status", "total_activities", *_MEANS, *_NOW)
    return rounded(stats, *_MEANS, *_NOW, nudge=NUDGE)


@query("SELECT DISTINCT worker_id FROM (SELECT user_id AS worker_id FROM events UNION ALL SELECT s_suppkey FROM supplier)")
def worker_universe(spark: SparkSession, sf: str) -> DataFrame:
    suppliers = B.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("worker_id"))
    return A.worker_universe(B.activities(spark, sf), suppliers)


@query("""SELECT user_id AS worker_id, event_id FROM events
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 50""", name="keep_last")
def keep_last_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = B.events(spark, sf).select(F.col("user_id").alias("worker_id"), "ts", "event_id")
    return keep_last(rows, ["worker_id"], ["ts", "event_id"], 50).drop("ts")


@query(f"""WITH {TASKS} SELECT task_id, coalesce(task_type, '') AS task_type, coalesce(created_us, -1) AS created_us, coalesce(started_us, -1) AS started_us,
  coalesce(completed_us, -1) AS completed_us, coalesce(duration, -1) AS duration, coalesce(assigned_worker, -1) AS assigned_worker, status FROM tasks""")
def task_lifecycle(spark: SparkSession, sf: str) -> DataFrame:
    rows = us(A.task_lifecycle(B.task_events(spark, sf)), created_us="created_at", started_us="started_at", completed_us="completed_at")
    return rows.fillna(-1).fillna("", ["task_type"])


_LATEST = [g for g in A.GAUGES]


@query(f"""WITH {EV}, g AS (SELECT worker_id, metric, arg_max(value, us) AS v FROM ev GROUP BY 1, 2)
  SELECT worker_id, {", ".join(f"coalesce(max(v) FILTER (metric = '{g}'), -1) AS {g}" for g in _LATEST)} FROM g GROUP BY 1""")
def latest_gauges(spark: SparkSession, sf: str) -> DataFrame:
    return A.latest_gauges(B.gauges(spark, sf)).fillna(-1.0)


@query(f"""WITH {TASKS}, {ACT} SELECT * FROM (SELECT count(*) AS total_tasks, count(*) FILTER (status = 'pending') AS pending_tasks,
  count(*) FILTER (status = 'running') AS running_tasks, count(*) FILTER (status = 'completed') AS completed_tasks, count(*) FILTER (status = 'failed') AS failed_tasks FROM tasks),
  (SELECT count(DISTINCT worker_id) AS total_workers, count(DISTINCT worker_id) FILTER (end_us IS NULL) AS active_workers,
   round(sum(idle_time), 4) AS total_idle_time, round(sum(duration_us)::BIGINT / 1e6, 4) AS total_busy_time FROM act)""")
def overall_counts(spark: SparkSession, sf: str) -> DataFrame:
    counts = A.overall_counts(A.task_lifecycle(B.task_events(spark, sf)), B.activities(spark, sf))
    return rounded(counts, "total_idle_time", "total_busy_time", digits=4)


@query(f"""WITH {ACT}, f AS (SELECT worker_id, seq, count(*) OVER w AS n, sum(duration_us) OVER w AS busy FROM act WHERE end_us IS NOT NULL
    WINDOW w AS (PARTITION BY worker_id ORDER BY end_us, seq ROWS UNBOUNDED PRECEDING))
  SELECT worker_id, seq, round(CASE WHEN busy > 0 THEN n / (busy / 1e6) ELSE 0 END, 9) AS throughput FROM f""")
def throughput_history(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(A.throughput_history(B.activities(spark, sf)).drop("ts"), "throughput", digits=9)


@query(f"""WITH {SPANS}, d AS (SELECT s AS t, 1 AS step FROM spans UNION ALL SELECT e, -1 FROM spans), n AS (SELECT t, sum(step) AS step FROM d GROUP BY 1)
  SELECT max(running)::BIGINT AS peak FROM (SELECT sum(step) OVER (ORDER BY t) AS running FROM n)""")
def peak_concurrency(spark: SparkSession, sf: str) -> DataFrame:
    return A.peak_concurrency(B.spans(spark, sf))


_SUMS = ["total_buffer_usage", "total_queue_size", "total_throughput", "avg_compression_ratio"]


@query(f"""WITH {STATS} SELECT count(*) AS total_processes, count(*) FILTER (current_status = 'active') AS active_processes,
  count(*) FILTER (current_status <> 'active') AS idle_processes, round(sum(current_buffer_usage), 4) AS total_buffer_usage,
  round(sum(current_queue_size), 4) AS total_queue_size, round(sum(current_throughput), 4) AS total_throughput, round(avg(current_compression_ratio), 4) AS avg_compression_ratio FROM stats""")
def pipeline_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(A.pipeline_rollup(stats_of(spark, sf)), *_SUMS, digits=4)


@query(f"""WITH {ACT} SELECT coalesce(worker_id, -1) AS worker_id, grouping(worker_id)::BIGINT AS is_total, round(sum(idle_time), 4) AS total_idle_time
  FROM act GROUP BY ROLLUP (worker_id)""")
def idle_totals(spark: SparkSession, sf: str) -> DataFrame:
    totals = rounded(A.idle_totals(B.activities(spark, sf)), "total_idle_time", digits=4)
    return totals.withColumns({"worker_id": F.coalesce("worker_id", F.lit(-1)), "is_total": F.col("is_total").cast("bigint")})


@query(f"""WITH {EV} SELECT us AS ts_us, seq, upper(event_type) AS level, message FROM ev WHERE upper(event_type) = 'ERROR' ORDER BY us DESC, seq DESC LIMIT 10""")
def recent_errors(spark: SparkSession, sf: str) -> DataFrame:
    return us(A.recent_errors(B.log_events(spark, sf), level="error").drop("worker_id"), ts_us="ts")


@query(f"""WITH {STATS} SELECT (SELECT count(DISTINCT worker_id) FROM act WHERE end_us IS NULL) AS active_processes, round(sum(current_throughput), 4) AS total_throughput,
  round((SELECT avg(current_compression_ratio) FROM cur), 6) AS avg_compression_ratio, round(sum(current_queue_size), 4) AS queue_depth,
  round(sum(current_buffer_usage) / (sum(current_buffer_usage) + 1) * 100, 6) AS buffer_utilization_raw,
  round(sum(current_buffer_usage) / 100000 * 100, 6) AS buffer_utilization FROM cur""")
def system_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    still_open = B.activities(spark, sf).filter(~A.is_closed())
    snapshot = A.system_snapshot(B.gauges(spark, sf), still_open, total_buffers=100_000)
    return rounded(rounded(snapshot, "avg_compression_ratio", "buffer_utilization_raw", "buffer_utilization"), "total_throughput", "queue_depth", digits=4)


@query("""WITH c AS (SELECT event_type AS host, event_id AS seq, epoch_us(ts) AS us,
    sum(round(value * 100)::BIGINT) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS n FROM events),
  p AS (SELECT *, lag(n) OVER w AS pn, lag(us) OVER w AS pus FROM c WINDOW w AS (PARTITION BY host ORDER BY us, seq))
  SELECT host, seq, n AS disk_read_bytes, round(coalesce(CASE WHEN n >= pn AND us > pus THEN (n - pn) / ((us - pus) / 1e6) END, -1), 4) AS disk_read_bytes_per_second FROM p""")
def counter_rates(spark: SparkSession, sf: str) -> DataFrame:
    rates = A.counter_rates(B.system_metrics(spark, sf), ["disk_read_bytes"], ["host"], ["ts", "seq"]).drop("ts")
    return rounded(rates.fillna(-1.0, ["disk_read_bytes_per_second"]), "disk_read_bytes_per_second", digits=4)


@query(f"""WITH {EV} SELECT seq, worker_name, CASE WHEN worker_name LIKE 'Producer%' THEN 'producer' WHEN worker_name LIKE 'Compressor%' THEN 'compressor'
  WHEN worker_name LIKE 'Writer%' THEN 'writer' ELSE 'unknown' END AS stage FROM ev""")
def classify_stage(spark: SparkSession, sf: str) -> DataFrame:
    return A.classify_stage(B.activity_events(spark, sf)).select("seq", "worker_name", "stage")


@query(f"""WITH {STATS}, s AS (SELECT stage, sum(total_activities) / sum(total_duration) AS rate FROM stats GROUP BY 1),
  r AS (SELECT coalesce(max(rate) FILTER (stage = 'producer'), 0) AS p, coalesce(max(rate) FILTER (stage = 'compressor'), 0) AS c, coalesce(max(rate) FILTER (stage = 'writer'), 0) AS w FROM s)
  SELECT round(p, 9) AS producer_throughput, round(c, 9) AS compressor_throughput, round(w, 9) AS writer_throughput, round(p + c + w, 9) AS total_throughput FROM r""")
def stage_throughput(spark: SparkSession, sf: str) -> DataFrame:
    rates = A.stage_throughput(A.classify_stage(stats_of(spark, sf)))
    return rounded(rates, *rates.columns, digits=9)


@query(f"""WITH {STATS} SELECT round(sum(current_queue_size), 4) AS total_queue_size, round(avg(current_queue_size), 6) AS avg_queue_size,
  round(least(100, sum(current_queue_size) / 100 * 100), 6) AS queue_utilization FROM stats""")
def queue_summary(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(rounded(A.queue_summary(stats_of(spark, sf)), "avg_queue_size", "queue_utilization"), "total_queue_size", digits=4)


@query(f"""WITH {BUF}, r AS (SELECT us, seq, sum(CASE kind WHEN 'acquire' THEN 1 ELSE -1 END) OVER (ORDER BY us, seq ROWS UNBOUNDED PRECEDING)::BIGINT AS active FROM buf)
  SELECT us AS ts_us, seq, active, 10000 - active AS free, 10000::BIGINT AS total FROM r WHERE us >= (SELECT max(us) FROM buf) - 31536000000000""")
def buffer_occupancy(spark: SparkSession, sf: str) -> DataFrame:
    rows = A.buffer_occupancy(B.buffer_events(spark, sf), 10_000, window_seconds=31_536_000)
    return us(rows, ts_us="ts").withColumn("total", F.col("total").cast("bigint"))


@query(f"""WITH {BUF}, l AS (SELECT buffer_id, arg_max(kind, row(us, seq)) AS kind FROM buf GROUP BY 1)
  SELECT count(*) FILTER (kind = 'acquire') AS in_use, 64 - count(*) FILTER (kind = 'acquire') AS available, 64::BIGINT AS total FROM l""")
def buffer_state(spark: SparkSession, sf: str) -> DataFrame:
    return A.buffer_state(B.buffer_events(spark, sf), 64)


@query(f"""WITH {BUF}, p AS (SELECT *, lag(kind) OVER w AS pk, lag(owner) OVER w AS po FROM buf WINDOW w AS (PARTITION BY buffer_id ORDER BY us, seq))
  SELECT buffer_id, us AS ts_us, seq, owner, coalesce(CASE WHEN pk = 'acquire' THEN po END, '') AS holder FROM p
  WHERE kind = 'release' AND NOT coalesce(pk = 'acquire' AND po = owner, false)""")
def ownership_violations(spark: SparkSession, sf: str) -> DataFrame:
    return us(A.ownership_violations(B.buffer_events(spark, sf)), ts_us="ts").fillna("", ["holder"])


@query(f"""WITH {STATS} SELECT round(coalesce(avg(avg_compression_ratio), 0), 6) AS avg_compression_ratio, coalesce(sum(total_activities), 0)::BIGINT AS total_compressed,
  round(coalesce((1 - avg(avg_compression_ratio)) * 100, 0), 6) AS compression_efficiency FROM stats WHERE stage = 'compressor'""")
def compression_summary(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(A.compression_summary(stats_of(spark, sf)), "avg_compression_ratio", "compression_efficiency")


@query(f"""WITH {STATS} SELECT worker_id, round(idle_percentage, 6) AS idle_percentage, round(least(1, idle_percentage / 100), 6) AS idle_probability,
  CASE WHEN idle_percentage > 50 THEN 'idle' ELSE 'active' END AS status FROM stats""")
def idle_classes(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(A.idle_classes(stats_of(spark, sf)), "idle_percentage", "idle_probability")


@query(f"""WITH {STATS} SELECT worker_id, round(idle_percentage, 6) AS idle_percentage, round(avg_cpu_usage, 6) AS cpu_usage,
  CASE WHEN idle_percentage > 70 THEN 'green' WHEN idle_percentage > 30 THEN 'amber' ELSE 'red' END AS band FROM stats""")
def activity_heatmap(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(A.activity_heatmap(A.worker_stats(B.activities(spark, sf))), "idle_percentage", "cpu_usage")


@query("""SELECT epoch_us(date_trunc('hour', ts)) AS ts_us, count(*) AS n, round(sum(value), 4) AS throughput, round(avg((event_id % 10) / 10.0), 6) AS ratio FROM events
  GROUP BY 1 ORDER BY 1 DESC LIMIT 100""")
def status_history(spark: SparkSession, sf: str) -> DataFrame:
    hours = B.events(spark, sf).groupBy(F.window("ts", "1 hour")["start"].alias("ts")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("throughput"), F.round(F.avg((F.col("event_id") % 10) / 10.0), 6).alias("ratio"))
    return us(A.status_history(hours), ts_us="ts")


@query(f"WITH {STAGES} SELECT stage, worker_id, items, total_bytes, round(avg_time, 6) AS avg_time, round(avg_ratio, 6) AS avg_ratio, last_us FROM counters")
def stage_counters(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(us(A.stage_counters(B.stage_events(spark, sf)), last_us="last_activity"), "avg_time", "avg_ratio")


@query(f"""WITH {STAGES}, i AS (SELECT stage, worker_id, ((SELECT max(last_us) FROM counters) - last_us) / 1e6 AS idle_time FROM counters)
  SELECT stage, worker_id, round(idle_time, 6) AS idle_time, round(least(1, idle_time / 10), 6) AS idle_probability FROM i""")
def staleness(spark: SparkSession, sf: str) -> DataFrame:
    events = B.stage_events(spark, sf)
    rows = A.staleness(A.stage_counters(events), events.agg(F.max("ts")))
    return rounded(rows, "idle_time", "idle_probability").select("stage", "worker_id", "idle_time", "idle_probability")


@query(f"""WITH {STAGES} SELECT (sum(items) FILTER (stage = 'producer'))::BIGINT AS total_produced, (sum(items) FILTER (stage = 'compressor'))::BIGINT AS total_compressed,
  round(avg(avg_ratio) FILTER (stage = 'compressor'), 6) AS avg_ratio, (sum(items) FILTER (stage = 'writer'))::BIGINT AS files_written,
  round((sum(total_bytes) FILTER (stage = 'writer'))::BIGINT / 1048576.0, 6) AS written_mb FROM counters""")
def status_summary(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(A.status_summary(A.stage_counters(B.stage_events(spark, sf))), "avg_ratio", "written_mb")


@query("SELECT event_type AS queue, sum(CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END)::BIGINT AS depth FROM events GROUP BY 1")
def queue_depths(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.when(F.col("event_id") % 2 == 0, "put").otherwise("get")
    return A.queue_depths(B.events(spark, sf).select(F.col("event_type").alias("queue"), kind.alias("kind")))


@query(f"""WITH {STATS} SELECT count(*) AS total_processes, round(sum(current_queue_size), 4) AS total_queue_size,
  (sum(total_activities) FILTER (stage = 'compressor'))::BIGINT AS total_compressed, count(*) FILTER (idle_percentage <= 50) AS active_workers, 10::BIGINT AS n_errors FROM stats""")
def full_status(spark: SparkSession, sf: str) -> DataFrame:
    status = A.full_status(stats_of(spark, sf), B.log_events(spark, sf))

    def field(section: str, path: str, kind: str):
        return F.get_json_object(F.col("status")[section], path).cast(kind)
    n_errors = F.size(F.from_json(F.get_json_object(F.col("status")["errors"], "$.messages"), "array<string>")).cast("bigint")
    return status.select(
        field("workers", "$.total_processes", "bigint").alias("total_processes"),
        F.round(field("queues", "$.total_queue_size", "double"), 4).alias("total_queue_size"),
        field("compression", "$.total_compressed", "bigint").alias("total_compressed"),
        field("idle", "$.workers_by_status.active", "bigint").alias("active_workers"), n_errors.alias("n_errors"))


@query(f"WITH {ACT} SELECT worker_id, count(end_us) AS completed_tasks, count(*) = count(end_us) AS is_idle FROM act GROUP BY 1")
def worker_task_counts(spark: SparkSession, sf: str) -> DataFrame:
    return A.worker_task_counts(B.activities(spark, sf))
