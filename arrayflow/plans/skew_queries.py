"""Worker-skew operators over workers made of `events`, in clusters of bounded size; tasks from `orders`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arrayflow.functions.expr import micros
from arrayflow.operators import skew as S
from arrayflow.plans import bindings as B
from arrayflow.plans.registry import query, rounded, wide

BY = ["cluster"]
THRESHOLD = 0.15

WK = f"""
seen AS (SELECT user_id AS worker_id, count(*) FILTER (event_type = 'error') AS errors, max(value) AS top FROM events GROUP BY 1),
wk AS (SELECT worker_id // {B.CLUSTER_SIZE} AS cluster, worker_id, CASE WHEN worker_id % 2 = 0 THEN (worker_id % 14) / 100 + 0.85 ELSE (worker_id % 12) / 100 END AS ld,
  CASE WHEN worker_id % 2 = 0 THEN 0.05 ELSE (worker_id % 6) / 10 + 0.4 END AS idle, errors % 10 AS q, least(100, top / 3) AS cpu, (worker_id * 11 % 90)::DOUBLE AS mem FROM seen),
fl AS (SELECT *, (q > 5)::INT + (cpu > 90)::INT + (ld > 0.8)::INT + (idle < 0.1)::INT AS marks FROM wk),
ov AS (SELECT *, marks >= 2 AS over FROM fl),
gate AS (SELECT cluster, var_samp(ld) AS variance, avg(ld) AS mean, coalesce(var_samp(ld) > 0.1 AND avg(ld) > 0.3, false) AS gate FROM wk GROUP BY 1)"""
MOVES = WK + f""",
pairs AS (SELECT s.cluster, s.worker_id AS source_id, t.worker_id AS target_id,
  greatest(0, CASE WHEN t.idle > 0.7 THEN (s.ld * 0.2::DOUBLE - t.ld * 0.3::DOUBLE) * 1.5::DOUBLE ELSE s.ld * 0.2::DOUBLE - t.ld * 0.3::DOUBLE END) AS improvement
  FROM ov s JOIN ov t ON s.cluster = t.cluster AND s.worker_id <> t.worker_id JOIN gate g ON g.cluster = s.cluster
  WHERE s.over AND t.idle > 0.5 AND t.q < 2 AND g.gate),
mv AS (SELECT *, source_id * 1000000 + target_id AS seq, (source_id + target_id) % 5 <> 0 AS success FROM pairs WHERE improvement > {THRESHOLD}::DOUBLE)"""
BEST_MOVES = WK + f""",
pairs AS (SELECT s.cluster, s.worker_id AS source_id, t.worker_id AS target_id,
  greatest(0, CASE WHEN t.idle > 0.7 THEN (s.ld * 0.2::DOUBLE - t.ld * 0.3::DOUBLE) * 1.5::DOUBLE ELSE s.ld * 0.2::DOUBLE - t.ld * 0.3::DOUBLE END) AS improvement,
  s.ld * 0.2::DOUBLE > t.ld * 0.3::DOUBLE + {THRESHOLD}::DOUBLE / CASE WHEN t.idle > 0.7 THEN 1.5::DOUBLE ELSE 1::DOUBLE END AS enough
  FROM ov s JOIN ov t ON s.cluster = t.cluster AND s.worker_id <> t.worker_id JOIN gate g ON g.cluster = s.cluster
  WHERE s.over AND t.idle > 0.5 AND t.q < 2 AND g.gate),
best AS (SELECT *, count(*) FILTER (enough) OVER (PARTITION BY source_id) AS n_targets FROM pairs
  QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY improvement DESC, target_id) = 1),
mv AS (SELECT *, source_id * 1000000 + target_id AS seq, (source_id + target_id) % 5 <> 0 AS success FROM best WHERE n_targets > 0)"""
SCORE = "idle * 10 - q * 2 - cpu / 100 * 5 + (1 - mem / 100) * 2 - CASE WHEN over THEN 10 ELSE 0 END"


def made(found: DataFrame) -> DataFrame:
    """Moves found, as if made: in order of their workers, most with success."""
    pair = F.col("source_id") + F.col("target_id")
    return found.withColumns({"seq": F.col("source_id") * 1_000_000 + F.col("target_id"), "success": pair % 5 != 0})


def all_moves(spark: SparkSession, sf: str) -> DataFrame:
    return made(S.move_pairs(B.workers(spark, sf), THRESHOLD, BY))


def best_made(spark: SparkSession, sf: str) -> DataFrame:
    return made(S.move_candidates(B.workers(spark, sf), THRESHOLD, BY))


@query(f"WITH {WK} SELECT cluster, worker_id, marks, over AS is_overloaded FROM ov")
def overload_flags(spark: SparkSession, sf: str) -> DataFrame:
    return S.overload_flags(B.workers(spark, sf)).select("cluster", "worker_id", "marks", "is_overloaded")


@query(f"WITH {WK} SELECT cluster, round(coalesce(variance, -1), 6) AS variance, round(mean, 6) AS mean, gate FROM gate")
def imbalance_gate(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(S.imbalance_gate(B.workers(spark, sf), BY).fillna(-1.0, ["variance"]), "variance", "mean")


@query(f"WITH {WK} SELECT cluster, worker_id FROM wk WHERE idle > 0.5 AND q < 2")
def underused(spark: SparkSession, sf: str) -> DataFrame:
    return S.underused(B.workers(spark, sf)).select("cluster", "worker_id")


@query(f"WITH {MOVES} SELECT cluster, source_id, target_id, round(improvement, 9) AS improvement FROM mv")
def move_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(S.move_pairs(B.workers(spark, sf), THRESHOLD, BY), "improvement", digits=9)


@query(f"WITH {BEST_MOVES} SELECT cluster, source_id, target_id, round(improvement, 9) AS improvement, n_targets FROM mv")
def best_moves(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(S.move_candidates(B.workers(spark, sf), THRESHOLD, BY), "improvement", digits=9)


@query("""SELECT event_id, round(greatest(0, (value / 500 * 0.2 - (event_id % 100) / 100 * 0.3) * CASE WHEN (user_id % 10) / 10 > 0.7 THEN 1.5 ELSE 1 END), 9) AS improvement FROM events""")
def move_improvement(spark: SparkSession, sf: str) -> DataFrame:
    pairs = B.events(spark, sf).select("event_id", (F.col("value") / 500).alias("source_load"), (F.col("event_id") % 100 / 100).alias("target_load"), (F.col("user_id") % 10 / 10).alias("target_idle"))
    return rounded(S.move_improvement(pairs).select("event_id", "improvement"), "improvement", digits=9)


@query(f"""WITH {MOVES}, p AS (SELECT m.cluster, source_id, target_id, s.ld * 0.8 AS source_load, greatest(0, s.q - 1) AS source_queue, least(1, t.ld * 1.2) AS target_load, t.q + 1 AS target_queue,
    s.cpu AS sc, s.idle AS si, t.cpu AS tc, t.idle AS ti FROM mv m JOIN wk s ON s.worker_id = source_id JOIN wk t ON t.worker_id = target_id)
  SELECT cluster, source_id, target_id, round(source_load, 9) AS source_load, source_queue, (source_queue > 5)::INT + (sc > 90)::INT + (source_load > 0.8)::INT + (si < 0.1)::INT >= 2 AS source_overloaded,
  round(target_load, 9) AS target_load, target_queue, (target_queue > 5)::INT + (tc > 90)::INT + (target_load > 0.8)::INT + (ti < 0.1)::INT >= 2 AS target_overloaded FROM p""")
def project_moves(spark: SparkSession, sf: str) -> DataFrame:
    return wide(rounded(S.project_moves(B.workers(spark, sf), all_moves(spark, sf).select("cluster", "source_id", "target_id"), BY), "source_load", "target_load", digits=9))


@query(f"WITH {WK} SELECT cluster, worker_id, round({SCORE} - ld * 5, 6) AS score FROM ov")
def worker_score(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(S.worker_score(B.workers(spark, sf), 2.0).select("cluster", "worker_id", "score"), "score")


@query(f"""WITH {WK}, ts AS (SELECT o_orderkey AS task_id, o_custkey % 5 AS cluster, o_totalprice / 100000 > 1 AS hard FROM orders),
  sc AS (SELECT cluster, worker_id, hard, {SCORE} - CASE WHEN hard THEN ld * 5 ELSE 0 END AS score FROM ov, (VALUES (true), (false)) h(hard)),
  best AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY cluster, hard ORDER BY score DESC, worker_id) = 1)
  SELECT task_id, coalesce(worker_id, -1) AS worker_id FROM ts LEFT JOIN best USING (cluster, hard)""")
def best_worker(spark: SparkSession, sf: str) -> DataFrame:
    tasks = B.table(spark, sf, "orders").select(F.col("o_orderkey").alias("task_id"), (F.col("o_custkey") % 5).alias("cluster"), (F.col("o_totalprice") / 100_000).alias("complexity"))
    return S.best_worker(B.workers(spark, sf), tasks, BY).select("task_id", F.coalesce("worker_id", F.lit(-1)).alias("worker_id"))


@query(f"WITH {WK} SELECT cluster, round(coalesce(greatest(0, 1 - var_samp(ld)), 1), 6) AS balance_score FROM wk GROUP BY 1")
def balance_score(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(S.balance_score(B.workers(spark, sf), BY), "balance_score")


@query(f"""WITH {BEST_MOVES}, c AS (SELECT cluster, count(*) FILTER (over) AS o, count(*) FILTER (idle > 0.7) AS i FROM ov GROUP BY 1), r AS (SELECT cluster, avg(success::INT) AS rate FROM mv GROUP BY 1)
  SELECT cluster, 'overload' AS topic, 'add ' || o || ' workers' AS message FROM c WHERE o > 0
  UNION ALL SELECT cluster, 'idle', i || ' workers underused' FROM c WHERE i > 0
  UNION ALL SELECT cluster, 'moves', 'few moves succeed, review the strategy' FROM r WHERE rate < 0.8""")
def recommendations(spark: SparkSession, sf: str) -> DataFrame:
    return S.recommendations(B.workers(spark, sf), best_made(spark, sf), BY)


@query(f"""WITH {MOVES}, l AS (SELECT cluster, avg(improvement) AS recent FROM (SELECT * FROM mv QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY seq DESC) <= 10) GROUP BY 1)
  SELECT cluster, count(*) AS total, count(*) FILTER (success) AS successful, count(*) FILTER (NOT success) AS failed, round(any_value(recent), 9) AS recent_improvement FROM mv JOIN l USING (cluster) GROUP BY 1""")
def move_effect(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(S.move_effect(all_moves(spark, sf), BY), "recent_improvement", digits=9)


@query(f"""WITH RECURSIVE {MOVES}, n AS (SELECT *, row_number() OVER w AS rn, avg(success::INT) OVER (PARTITION BY cluster ORDER BY seq ROWS 9 PRECEDING) AS rate FROM mv WINDOW w AS (PARTITION BY cluster ORDER BY seq)),
  f(cluster, rn, seq, t) AS (SELECT cluster, rn, seq, 0.3::DOUBLE FROM n WHERE rn = 1
    UNION ALL SELECT n.cluster, n.rn, n.seq, CASE WHEN n.rn < 10 THEN f.t ELSE greatest(0.1::DOUBLE, least(0.8::DOUBLE, f.t * CASE WHEN n.rate > 0.8 THEN 0.95::DOUBLE WHEN n.rate < 0.5 THEN 1.05::DOUBLE ELSE 1 END)) END
    FROM f JOIN n ON n.cluster = f.cluster AND n.rn = f.rn + 1)
  SELECT cluster, seq, round(t, 9) AS threshold FROM f""")
def adaptive_threshold(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(S.adaptive_threshold(all_moves(spark, sf), 0.3, BY), "threshold", digits=9)


@query(f"""WITH {MOVES} SELECT cluster, round(avg(success::INT), 6) AS success_rate, count(*) AS n FROM (SELECT * FROM mv QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY seq DESC) <= 20) GROUP BY 1""")
def recent_success(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(S.recent_success(all_moves(spark, sf), by=BY), "success_rate")


@query("""WITH st AS (SELECT user_id AS worker_id, round(avg(value), 6) AS idle FROM events GROUP BY 1),
  c AS (SELECT o_orderkey AS task_id, o_custkey, o_orderkey % 4 AS batch_size, unnest([0, 1, 2]) AS position FROM orders),
  j AS (SELECT task_id, batch_size, position, (o_custkey + position * 7) % 200 AS worker_id FROM c)
  SELECT task_id, CASE WHEN batch_size <= 2 THEN worker_id ELSE -1 END AS worker_id FROM (SELECT j.*, coalesce(idle, 100) AS idle FROM j LEFT JOIN st USING (worker_id))
  QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY idle, position) = 1""")
def assign_tasks(spark: SparkSession, sf: str) -> DataFrame:
    stats = B.events(spark, sf).groupBy(F.col("user_id").alias("worker_id")).agg(F.round(F.avg("value"), 6).alias("idle_percentage"))
    rows = B.table(spark, sf, "orders").select(F.col("o_orderkey").alias("task_id"), "o_custkey", (F.col("o_orderkey") % 4).alias("batch_size"), F.explode(F.array(*[F.lit(i) for i in range(3)])).alias("position"))
    candidates = rows.withColumn("worker_id", (F.col("o_custkey") + F.col("position") * 7) % 200)
    return S.assign_tasks(candidates, stats, "min_idle", capacity=2).fillna(-1, ["worker_id"])


@query("""WITH s AS (SELECT user_id AS worker_id, epoch_us(ts) AS us, event_id AS seq, CASE WHEN event_type IN ('click', 'view') THEN value END AS ld, CASE WHEN event_type = 'error' THEN round(value) END AS q FROM events),
  f AS (SELECT worker_id, us, seq, last_value(ld IGNORE NULLS) OVER w AS current_load, last_value(q IGNORE NULLS) OVER w AS queue_size FROM s WINDOW w AS (PARTITION BY worker_id ORDER BY us, seq ROWS UNBOUNDED PRECEDING))
  SELECT worker_id, us AS ts_us, seq, coalesce(current_load, -1) AS current_load, coalesce(queue_size, -1) AS queue_size FROM f QUALIFY row_number() OVER (PARTITION BY worker_id ORDER BY us DESC, seq DESC) <= 50""")
def load_history(spark: SparkSession, sf: str) -> DataFrame:
    kind, value = F.col("event_type"), F.col("value")
    samples = B.events(spark, sf).select(F.col("user_id").alias("worker_id"), "ts", F.col("event_id").alias("seq"),
                                         F.when(kind.isin("click", "view"), value).alias("current_load"), F.when(kind == "error", F.round(value)).alias("queue_size"))
    return S.load_history(samples, ["current_load", "queue_size"]).withColumn("ts_us", micros("ts")).drop("ts").fillna(-1.0)
