"""Trailing means, scaling signals, stale workers and checkpoint schedules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arrayflow.functions.expr import MICROS, STAGES, floor_div, micros, moment, stage_of
from arrayflow.functions.ordered import number, running_sum

# The monitored metrics and the scaling bounds.
METRICS = ("producer_rate", "compressor_rate", "writer_rate", "buffer_usage", "queue_depth", "compression_ratio")
ADD_BELOW, REMOVE_ABOVE = 20.0, 80.0


def rolling_mean(gauges: DataFrame, seconds: float = 10, by: Sequence[str] = ("metric",)) -> DataFrame:
    """Mean of the trailing ``seconds`` (far end included) at every instant that has samples.

    Samples of one instant are summed first. Time is cut into buckets one window long, so that a window is the start of its
    own bucket and the end of the one before: a running sum from the left plus one from the right, looked up where the
    window begins. Nothing is subtracted, so that large, infinite or undefined values leave together with their window, and
    the cost does not depend on its length.
    """
    by, span = list(by), int(seconds * MICROS)
    instants = (gauges.groupBy(*by, micros("ts").alias("ts_us"))
                .agg(F.sum("value").alias("_sum"), F.count("value").alias("_n")))
    at, home = F.col("ts_us"), floor_div(F.col("ts_us"), span)

    def entry(right: bool, bucket: Column, place: Column, asks: bool, adds: bool) -> Column:
        return F.struct(F.lit(right).alias("_right"), bucket.alias("_bucket"), place.alias("_at"), F.lit(int(asks and right)).alias("_after"), F.lit(asks).alias("_asks"),
                        (F.col("_sum") if adds else F.lit(0.0)).alias("_dsum"), (F.col("_n") if adds else F.lit(0).cast("bigint")).alias("_dn"))
    entries = F.array(entry(False, home, at, True, True), entry(True, home, -at, False, True), entry(True, home - 1, F.lit(span) - at, True, False))
    spread = instants.withColumn("_entry", F.explode(entries)).select(*by, "ts_us", "_entry.*")
    summed = running_sum(spread, [*by, "_right", "_bucket"], ["_at", "_after"], {"_total": F.coalesce("_dsum", F.lit(0.0)), "n_samples": "_dn"})
    whole = summed.filter("_asks").groupBy(*by, "ts_us").agg(F.sum("_total").alias("_total"), F.sum("n_samples").alias("n_samples"))
    mean = F.when(F.col("n_samples") > 0, F.col("_total") / F.col("n_samples")).otherwise(0.0)
    return whole.select(*by, "ts_us", mean.alias("rolling_mean"), "n_samples")


def rolling_idle(idle_samples: DataFrame, seconds: float = 15) -> DataFrame:
    """Trailing mean idle percentage per stage; workers of no known stage are left out."""
    staged = idle_samples.withColumn("stage", stage_of("worker_name")).filter(F.col("stage") != "unknown")
    return rolling_mean(staged.withColumnRenamed("idle_percentage", "value"), seconds, by=["stage"])


def latest_per_tick(gauges: DataFrame, seconds: int = 1) -> DataFrame:
    """The last value of every worker and metric within each tick."""
    tick = F.window("ts", f"{seconds} seconds")["start"].alias("tick")
    return gauges.groupBy("worker_id", "worker_name", "metric", tick).agg(
        F.max_by("value", moment()).alias("value"))


def stage_rates(gauges: DataFrame, seconds: int = 1) -> DataFrame:
    """Per tick: summed throughput of each stage, queue depth, buffers in use, mean compressor ratio."""
    stage, metric, value = stage_of("worker_name"), F.col("metric"), F.col("value")
    def total(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, value)), F.lit(0.0))
    rates = [total((metric == "throughput") & (stage == s)).alias(f"{s}_rate") for s in STAGES]
    ratio = F.avg(F.when((metric == "compression_ratio") & (stage == "compressor"), value))
    return latest_per_tick(gauges, seconds).groupBy("tick").agg(
        *rates, total(metric == "queue_size").alias("queue_depth"), total(metric == "buffer_usage").alias("buffer_usage"),
        F.coalesce(ratio, F.lit(0.0)).alias("compression_ratio"))


def metric_vector(gauges: DataFrame, at_us: int, seconds: float = 10, metrics: Sequence[str] = METRICS) -> DataFrame:
    """All metrics' trailing means at one moment, in one pass over the window; no samples give 0."""
    inside = gauges.filter(micros("ts").between(at_us - int(seconds * MICROS), at_us))
    return inside.agg(*[
        F.coalesce(F.avg(F.when(F.col("metric") == m, F.col("value"))), F.lit(0.0)).alias(m) for m in metrics])


def scaling_decision(rolling: DataFrame, value: str = "rolling_mean") -> DataFrame:
    """Add or remove a worker by its stage's mean idle percentage; no samples count as 0."""
    mean = F.coalesce(F.col(value), F.lit(0.0))
    decision = F.when(mean < ADD_BELOW, "add").when(mean > REMOVE_ABOVE, "remove").otherwise("none")
    return rolling.withColumn("decision", decision)


def stale_workers(heartbeats: DataFrame, interval_seconds: float, now_us: int) -> DataFrame:
    """Workers whose last beat is older than two intervals."""
    last = heartbeats.groupBy("worker_id").agg(F.max(micros("ts")).alias("last_beat_us"))
    return last.filter(F.lit(now_us) - F.col("last_beat_us") > int(2 * interval_seconds * MICROS))


def checkpoint_due(completions: DataFrame, every_n: int = 10, every_seconds: float = 10.0, by: Sequence[str] = ()) -> DataFrame:
    """Completions at which a save is due: every ``every_n``-th, and when ``every_seconds`` passed since the last save.

    Each counted save restarts the timer, so the stretch between two counted saves is independent of all others: the
    timer is folded over at most ``every_n`` rows. The first completion starts the clock.
    """
    by = list(by)
    numbered = number(completions.select(*by, "ts", "seq"), by, ["ts", "seq"], "_rn")
    numbered = numbered.withColumn("_us", micros("ts"))
    own = floor_div(F.col("_rn") - 1, every_n)
    # A counted save is also the start of the next stretch.
    stretches = F.when(F.col("_rn") % every_n == 0, F.array(own, own + 1)).otherwise(F.array(own))
    rows = numbered.withColumn("_stretch", F.explode(stretches))
    ordered = F.sort_array(F.collect_list(F.struct("_rn", "_us", "ts", "seq")))
    grouped = rows.groupBy(*by, "_stretch").agg(ordered.alias("_rows"))

    gap = int(every_seconds * MICROS)
    first = F.element_at("_rows", 1)
    is_seed = first["_rn"] == F.col("_stretch") * every_n
    body = F.when(is_seed, F.slice("_rows", 2, every_n)).otherwise(F.col("_rows"))
    empty = F.array().cast("array<struct<reason:string,_rn:bigint,ts:timestamp,seq:bigint>>")

    def step(acc: Column, row: Column) -> Column:
        counted = row["_rn"] % every_n == 0
        timed = row["_us"] - acc["last"] >= gap
        reason = F.when(counted, "count").when(timed, "timer")
        save = F.struct(reason.alias("reason"), row["_rn"].alias("_rn"), row["ts"].alias("ts"), row["seq"].cast("bigint").alias("seq"))
        return F.struct(
            F.when(counted | timed, row["_us"]).otherwise(acc["last"]).alias("last"),
            F.when(counted | timed, F.concat(acc["saves"], F.array(save))).otherwise(acc["saves"]).alias("saves"))

    start = F.struct(first["_us"].alias("last"), empty.alias("saves"))
    saves = F.aggregate(body, start, step)["saves"]
    return grouped.select(*by, F.explode(saves).alias("s")).select(*by, "s.ts", "s.seq", F.col("s._rn").alias("completion"), "s.reason")
