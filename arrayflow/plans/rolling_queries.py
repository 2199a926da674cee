"""Trailing means, scaling signals, stale workers and checkpoint schedules over `events`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arrayflow.functions.expr import micros
from arrayflow.operators import rolling as R
from arrayflow.plans import bindings as B
from arrayflow.plans.activity_queries import ACT, EV
from arrayflow.plans.registry import NUDGE, query, rounded

HOUR = 3600
IDLE = ACT + """,
smp AS (SELECT end_us AS us, CASE WHEN duration_us > 0 THEN idle_time * 100 / (duration_us / 1e6) ELSE 0 END AS pct,
  CASE WHEN worker_name LIKE 'Producer%' THEN 'producer' WHEN worker_name LIKE 'Compressor%' THEN 'compressor' WHEN worker_name LIKE 'Writer%' THEN 'writer' END AS stage
  FROM act WHERE end_us IS NOT NULL),
idle AS (SELECT DISTINCT stage, us AS ts_us, avg(pct) OVER w AS m, count(*) OVER w AS n FROM smp WHERE stage IS NOT NULL
  WINDOW w AS (PARTITION BY stage ORDER BY us RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW))"""


def newest_us(df: DataFrame) -> int:
    return df.agg(F.max(micros("ts"))).first()[0]


def idle_samples(spark: SparkSession, sf: str) -> DataFrame:
    percent = F.when(F.col("duration") > 0, F.col("idle_time") * 100 / F.col("duration")).otherwise(0.0)
    return B.activities(spark, sf).filter(F.col("end_time").isNotNull()).select("worker_name", F.col("end_time").alias("ts"), percent.alias("idle_percentage"))


@query(f"""WITH {EV} SELECT DISTINCT metric, us AS ts_us, round(avg(value) OVER w + {NUDGE}, 6) AS rolling_mean, count(*) OVER w AS n_samples FROM ev
  WINDOW w AS (PARTITION BY metric ORDER BY us RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW)""")
def rolling_mean(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(R.rolling_mean(B.gauges(spark, sf), HOUR), "rolling_mean", nudge=NUDGE)


@query(f"WITH {IDLE} SELECT stage, ts_us, round(m + {NUDGE}, 6) AS rolling_mean, n AS n_samples FROM idle")
def rolling_idle(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(R.rolling_idle(idle_samples(spark, sf), HOUR), "rolling_mean", nudge=NUDGE)


@query(f"WITH {IDLE} SELECT stage, ts_us, n AS n_samples, CASE WHEN m < 20 THEN 'add' WHEN m > 80 THEN 'remove' ELSE 'none' END AS decision FROM idle")
def scaling_decision(spark: SparkSession, sf: str) -> DataFrame:
    return R.scaling_decision(R.rolling_idle(idle_samples(spark, sf), HOUR)).drop("rolling_mean")


@query(f"""WITH {EV}, t AS (SELECT worker_id, worker_name, metric, us - us % 60000000 AS tick_us, arg_max(value, row(us, seq)) AS v FROM ev GROUP BY ALL)
  SELECT tick_us, round(coalesce(sum(v) FILTER (metric = 'throughput' AND worker_name LIKE 'Producer%'), 0), 6) AS producer_rate,
  round(coalesce(sum(v) FILTER (metric = 'throughput' AND worker_name LIKE 'Compressor%'), 0), 6) AS compressor_rate,
  round(coalesce(sum(v) FILTER (metric = 'throughput' AND worker_name LIKE 'Writer%'), 0), 6) AS writer_rate,
  round(coalesce(sum(v) FILTER (metric = 'queue_size'), 0), 6) AS queue_depth, round(coalesce(sum(v) FILTER (metric = 'buffer_usage'), 0), 6) AS buffer_usage,
  round(coalesce(avg(v) FILTER (metric = 'compression_ratio' AND worker_name LIKE 'Compressor%'), 0), 6) AS compression_ratio FROM t GROUP BY 1""")
def stage_rates(spark: SparkSession, sf: str) -> DataFrame:
    rates = R.stage_rates(B.gauges(spark, sf), 60)
    values = [c for c in rates.columns if c != "tick"]
    return rounded(rates, *values).withColumn("tick_us", micros("tick")).drop("tick")


@query(f"""WITH {EV}, w AS (SELECT * FROM ev WHERE us >= (SELECT max(us) FROM ev) - 864000000000)
  SELECT {", ".join(f"round(coalesce(avg(value) FILTER (metric = '{m}'), 0), 6) AS {m}" for m in (*B.GAUGE_OF.values(), "unknown"))} FROM w""")
def metric_vector(spark: SparkSession, sf: str) -> DataFrame:
    gauges, names = B.gauges(spark, sf), [*B.GAUGE_OF.values(), "unknown"]
    return rounded(R.metric_vector(gauges, newest_us(gauges), 240 * HOUR, names), *names)


@query("""WITH l AS (SELECT user_id AS worker_id, max(epoch_us(ts)) AS last_beat_us FROM events GROUP BY 1)
  SELECT * FROM l WHERE (SELECT max(epoch_us(ts)) FROM events) - last_beat_us > 2 * 21600 * 1000000::BIGINT""")
def stale_workers(spark: SparkSession, sf: str) -> DataFrame:
    beats = B.heartbeats(spark, sf)
    return R.stale_workers(beats, 6 * HOUR, newest_us(beats))


@query("""WITH RECURSIVE p AS (SELECT event_type AS host, event_id AS seq, epoch_us(ts) AS us, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS rn FROM events),
  f(host, rn, us, seq, last, reason) AS (
    SELECT host, rn, us, seq, us, NULL::VARCHAR FROM p WHERE rn = 1
    UNION ALL SELECT p.host, p.rn, p.us, p.seq, CASE WHEN p.rn % 10 = 0 OR p.us - f.last >= 7200000000 THEN p.us ELSE f.last END,
      CASE WHEN p.rn % 10 = 0 THEN 'count' WHEN p.us - f.last >= 7200000000 THEN 'timer' END FROM f JOIN p ON p.host = f.host AND p.rn = f.rn + 1)
  SELECT host, us AS ts_us, seq, rn AS completion, reason FROM f WHERE reason IS NOT NULL""")
def checkpoint_due(spark: SparkSession, sf: str) -> DataFrame:
    done = B.events(spark, sf).select(F.col("event_type").alias("host"), "ts", F.col("event_id").alias("seq"))
    return R.checkpoint_due(done, 10, 2 * HOUR, ["host"]).withColumn("ts_us", micros("ts")).drop("ts")


@query(f"""WITH {EV} SELECT worker_id, worker_name, metric, us - us % 3600000000 AS tick_us, arg_max(value, row(us, seq)) AS value FROM ev GROUP BY ALL""")
def latest_per_tick(spark: SparkSession, sf: str) -> DataFrame:
    return R.latest_per_tick(B.gauges(spark, sf), HOUR).withColumn("tick_us", micros("tick")).drop("tick")
