"""Activity analytics: intervals, per-worker and per-stage statistics, gauges, buffers, tasks and status documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from arrayflow.functions.expr import MICROS, STAGES, attach, micros, moment, ratio, seconds_between, stage_of
from arrayflow.functions.ordered import SLICE, keep_last, last_known, neighbour, running_sum, slice_rows, trailing_sum

# Gauge names and other output field names below, thresholds of the reports.
GAUGES = ("buffer_usage", "queue_size", "throughput", "compression_ratio", "write_speed")
LOG_SHOWN = 10
IDLE_STATUS_PERCENT = 50
QUEUE_CAPACITY = 100
IDLE_AFTER_SECONDS = 10.0
GREEN_ABOVE, AMBER_ABOVE = 70, 30


def is_closed() -> Column:
    return F.col("end_time").isNotNull()


# Intervals -----------------------------------------------------------------------------------------------------------

def build_intervals(activity_events: DataFrame) -> DataFrame:
    """Start/end events to intervals: a start is closed by the worker's next event; the last one may stay open."""
    closed = neighbour(activity_events, ["worker_id"], ["ts", "seq"], {"end_time": "ts"}, step=1)
    return (closed.filter(F.col("kind") == "start")
            .withColumnRenamed("ts", "start_time")
            .withColumn("duration_us", micros("end_time") - micros("start_time"))
            .withColumn("duration", F.col("duration_us") / float(MICROS))
            .drop("kind"))


def worker_universe(activities: DataFrame, *others: DataFrame) -> DataFrame:
    """Every worker with closed or open intervals, in any of the inputs."""
    ids = activities.select("worker_id")
    for other in others:
        ids = ids.union(other.select("worker_id"))
    return ids.distinct()


def recent_intervals(activities: DataFrame, max_history: int | None = None) -> DataFrame:
    """Closed intervals: all, or only the newest ``max_history`` of each worker."""
    return keep_last(activities.filter(is_closed()), ["worker_id"], ["end_time", "seq"], max_history)


def worker_stats(activities: DataFrame, max_history: int | None = None) -> DataFrame:
    """Count, busy and idle seconds, idle percentage and mean usage per worker."""
    return _worker_totals(recent_intervals(activities, max_history))


def _worker_totals(history: DataFrame, means: Sequence[str] = ("cpu_usage", "memory_usage"), named: bool = False) -> DataFrame:
    """Totals and means per worker; ``named`` adds the name of its first interval (at one instant: no sequence first).

    Sums per worker and name hash, as the first time does; only these few rows per worker are then sorted for the name.
    """
    sums = {"total_activities": F.count(F.lit(1)), "_busy_us": F.sum("duration_us"), "total_idle_time": F.sum("idle_time")}
    sums |= {f"_sum_{m}": F.sum(m) for m in means} | {f"_n_{m}": F.count(m) for m in means}
    if named:
        first = F.min(moment("end_time", F.coalesce("seq", F.lit(-1))))
        parts = history.groupBy("worker_id", "worker_name").agg(*[c.alias(n) for n, c in sums.items()], first.alias("_first"))
        stats = parts.groupBy("worker_id").agg(*[F.sum(n).alias(n) for n in sums], F.min_by("worker_name", "_first").alias("worker_name"))
    else:
        stats = history.groupBy("worker_id").agg(*[c.alias(n) for n, c in sums.items()])
    totals = ["worker_id", "total_activities", (F.col("_busy_us") / float(MICROS)).alias("total_duration"), "total_idle_time"]
    averages = [F.try_divide(F.col(f"_sum_{m}").cast("double"), f"_n_{m}").alias(f"avg_{m}") for m in means]
    stats = stats.select(*totals, *averages, *(["worker_name"] if named else []))
    return stats.withColumn("idle_percentage", ratio(F.col("total_idle_time") * 100, "total_duration"))


def latest_gauges(gauges: DataFrame, metrics: Sequence[str] = GAUGES, by: Sequence[str] = ()) -> DataFrame:
    """Last value of every gauge per worker, one column per metric, in one aggregation."""
    latest = moment()
    return gauges.groupBy(*by, "worker_id").agg(*[
        F.max_by("value", F.when(F.col("metric") == m, latest)).alias(m) for m in metrics])


def process_stats(activities: DataFrame, gauges: DataFrame, max_history: int | None = None) -> DataFrame:
    """Worker statistics with name, stage, mean and current gauges, and status."""
    history = recent_intervals(activities, max_history)
    stats = _worker_totals(history, ["cpu_usage", "memory_usage", *GAUGES], named=True)
    status = (activities.filter(~is_closed()).groupBy("worker_id")
              .agg(F.max(F.when(F.col("idle_time") > 0, "idle").otherwise("active")).alias("open_status")))
    current = latest_gauges(gauges)
    current = current.select("worker_id", *[F.col(g).alias(f"current_{g}") for g in GAUGES])
    joined = stats.join(current, "worker_id", "left").join(status, "worker_id", "left")
    return (joined.fillna(0.0, [f"current_{g}" for g in GAUGES])
            .withColumn("current_status", F.coalesce("open_status", F.lit("unknown"))).drop("open_status")
            .withColumn("stage", stage_of("worker_name")))


def overall_counts(tasks: DataFrame, activities: DataFrame) -> DataFrame:
    """Task counts by status next to worker, idle and busy totals; both inputs are summed up per key before they meet."""
    workers = activities.groupBy("worker_id").agg(
        F.sum("idle_time").alias("idle_time"), F.sum("duration_us").alias("duration_us"), (F.count_if(~is_closed()) > 0).alias("open"))
    states = tasks.groupBy("status").agg(F.count("status").alias("n"))
    rows = states.unionByName(workers, allowMissingColumns=True)
    by_status = [F.coalesce(F.sum(F.when(F.col("status") == s, F.col("n"))), F.lit(0)).alias(f"{s}_tasks") for s in ("pending", "running", "completed", "failed")]
    return rows.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_tasks"), *by_status,
        F.count("worker_id").alias("total_workers"),
        F.count_if(F.col("open") & F.col("worker_id").isNotNull()).alias("active_workers"),
        F.coalesce(F.sum("idle_time"), F.lit(0.0)).alias("total_idle_time"),
        F.coalesce(F.sum("duration_us") / float(MICROS), F.lit(0.0)).alias("total_busy_time"))


def throughput_history(activities: DataFrame, max_history: int | None = None) -> DataFrame:
    """At every interval end: intervals so far (or the last ``max_history``) per busy second of theirs."""
    closed = activities.filter(is_closed()).select("worker_id", "end_time", "seq", "duration_us")
    sums = {"n": F.lit(1).cast("bigint"), "busy_us": F.col("duration_us")}
    if max_history is None:
        summed = running_sum(closed, ["worker_id"], ["end_time", "seq"], sums)
    else:
        summed = trailing_sum(closed, ["worker_id"], ["end_time", "seq"], max_history, sums)
    return summed.select("worker_id", F.col("end_time").alias("ts"), "seq",
                         ratio("n", F.col("busy_us") / float(MICROS)).alias("throughput"))


def peak_concurrency(intervals: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Most intervals open at once; starts and ends of one instant are netted before the sweep.

    Each slice of a group is summed up by its change and its highest level from 0. These two merge: a group's peak is the
    highest of its slices' levels, each on top of the changes before it.
    """
    by = list(by)
    change = F.explode(F.array(F.struct(F.col("start_time").alias("ts"), F.lit(1).alias("step")),
                               F.struct(F.col("end_time").alias("ts"), F.lit(-1).alias("step")))).alias("c")
    steps = (intervals.select(*by, change).select(*by, "c.ts", "c.step").filter(F.col("ts").isNotNull())
             .groupBy(*by, "ts").agg(F.sum("step").alias("step")))
    part = [*by, SLICE]
    level = F.sum("step").over(W.partitionBy(*part).orderBy("ts").rowsBetween(W.unboundedPreceding, 0))
    parts = slice_rows(steps, by, ["ts"]).withColumn("_level", level).groupBy(*part).agg(F.max("_level").alias("_top"), F.sum("step").alias("_change"))
    before = F.coalesce(F.sum("_change").over(W.partitionBy(*by).orderBy(SLICE).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return parts.select(*by, (F.col("_top") + before).alias("_peak")).groupBy(*by).agg(F.max("_peak").alias("peak"))


def idle_totals(idle_events: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Idle seconds per worker and, with a null worker, of the whole group."""
    sets = [[*by, "worker_id"], list(by)]
    return idle_events.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in sets[0]]).agg(
        F.sum("idle_time").alias("total_idle_time"), F.grouping("worker_id").alias("is_total"))


def worker_task_counts(activities: DataFrame) -> DataFrame:
    """Completed intervals per worker and whether it is idle now."""
    return activities.groupBy("worker_id").agg(
        F.count_if(is_closed()).alias("completed_tasks"), (F.count_if(~is_closed()) == 0).alias("is_idle"))


# Tasks ---------------------------------------------------------------------------------------------------------------

def task_lifecycle(task_events: DataFrame) -> DataFrame:
    """Task events (created, started, completed, failed) to one row per task with its last status."""
    event, order = F.col("event"), F.struct("ts", "seq")
    known = last_known(task_events, ["task_id"], ["ts", "seq"], {"_started": F.when(event == "started", F.col("ts"))})
    done = F.when(event == "completed", order)
    status = (F.when(event == "created", "pending").when(event == "started", "running").otherwise(event))
    return known.groupBy("task_id").agg(
        F.max("task_type").alias("task_type"),
        F.min(F.when(event == "created", F.col("ts"))).alias("created_at"),
        F.max(F.when(event == "started", F.col("ts"))).alias("started_at"),
        F.max(F.when(event == "completed", F.col("ts"))).alias("completed_at"),
        F.max_by(seconds_between("_started", "ts"), done).alias("duration"),
        F.max_by("worker_id", F.when(event == "started", order)).alias("assigned_worker"),
        F.max_by(status, order).alias("status"))


# Roll-ups over process statistics ------------------------------------------------------------------------------------

def _rollup() -> list[Column]:
    active, zero = F.count_if(F.col("current_status") == "active"), F.lit(0.0)
    return [F.count(F.lit(1)).alias("total_processes"), active.alias("active_processes"), (F.count(F.lit(1)) - active).alias("idle_processes"),
            *[F.coalesce(F.sum(f"current_{g}"), zero).alias(f"total_{g}") for g in ("buffer_usage", "queue_size", "throughput")],
            F.coalesce(F.avg("current_compression_ratio"), zero).alias("avg_compression_ratio")]


def pipeline_rollup(stats: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Worker counts, summed gauges and the mean ratio over all workers."""
    return stats.groupBy(*by).agg(*_rollup())


def classify_stage(df: DataFrame, name: str = "worker_name") -> DataFrame:
    """Add the pipeline stage a worker's name points to."""
    return df.withColumn("stage", stage_of(name))


def _stage_rates() -> list[Column]:
    rates = []
    for stage in STAGES:
        member = stage_of("worker_name") == stage
        rates.append(F.coalesce(ratio(F.sum(F.when(member, F.col("total_activities"))), F.sum(F.when(member, F.col("total_duration")))), F.lit(0.0)))
    return [*[r.alias(f"{stage}_throughput") for stage, r in zip(STAGES, rates, strict=True)], sum(rates[1:], rates[0]).alias("total_throughput")]


def stage_throughput(stats: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Activities per busy second of each stage, and the sum over the stages."""
    return stats.groupBy(*by).agg(*_stage_rates())


def _queues() -> list[Column]:
    total = F.coalesce(F.sum("current_queue_size"), F.lit(0.0))
    return [total.alias("total_queue_size"), F.coalesce(F.avg("current_queue_size"), F.lit(0.0)).alias("avg_queue_size"),
            F.least(F.lit(100.0), total / QUEUE_CAPACITY * 100).alias("queue_utilization")]


def queue_summary(stats: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Total and mean queue size, and the share of the assumed capacity."""
    return stats.groupBy(*by).agg(*_queues())


def _compression() -> list[Column]:
    member = stage_of("worker_name") == "compressor"
    mean = F.avg(F.when(member, F.col("avg_compression_ratio")))
    return [F.coalesce(mean, F.lit(0.0)).alias("avg_compression_ratio"),
            F.coalesce(F.sum(F.when(member, F.col("total_activities"))), F.lit(0)).alias("total_compressed"),
            F.coalesce((1 - mean) * 100, F.lit(0.0)).alias("compression_efficiency")]


def compression_summary(stats: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Items handled by compressors, their mean ratio and the space saved in percent."""
    return stats.groupBy(*by).agg(*_compression())


def _idle_status() -> Column:
    return F.when(F.col("idle_percentage") > IDLE_STATUS_PERCENT, "idle").otherwise("active")


def idle_classes(stats: DataFrame) -> DataFrame:
    """Idle percentage as a probability and a status."""
    return stats.select(
        "worker_id", "idle_percentage",
        F.least(F.lit(1.0), F.col("idle_percentage") / 100).alias("idle_probability"),
        _idle_status().alias("status"))


def activity_heatmap(stats: DataFrame) -> DataFrame:
    """Idle and CPU percentage with a colour band."""
    idle = F.col("idle_percentage")
    band = F.when(idle > GREEN_ABOVE, "green").when(idle > AMBER_ABOVE, "amber").otherwise("red")
    return stats.select("worker_id", "idle_percentage", F.col("avg_cpu_usage").alias("cpu_usage"), band.alias("band"))


# Gauges, counters and logs -------------------------------------------------------------------------------------------

def system_snapshot(gauges: DataFrame, open_intervals: DataFrame, total_buffers: int | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Current totals over all workers; pseudo-workers with negative ids do not count."""
    latest = latest_gauges(gauges.filter(F.col("worker_id") >= 0), by=by)
    opened = open_intervals.select(*by, F.col("worker_id").alias("open_worker")).distinct()
    rows = latest.unionByName(opened, allowMissingColumns=True)
    total = {g: F.coalesce(F.sum(g), F.lit(0.0)) for g in GAUGES}
    used = total["buffer_usage"]
    return rows.groupBy(*by).agg(
        F.count("open_worker").alias("active_processes"),
        total["throughput"].alias("total_throughput"),
        F.coalesce(F.avg("compression_ratio"), F.lit(0.0)).alias("avg_compression_ratio"),
        total["queue_size"].alias("queue_depth"),
        (used / (used + 1) * 100).alias("buffer_utilization_raw"),
        (used / F.lit(total_buffers) * 100 if total_buffers else F.lit(None).cast("double")).alias("buffer_utilization"))


def counter_rates(system_metrics: DataFrame, counters: Sequence[str], by: Sequence[str] = (), order: Sequence[str] = ("ts",)) -> DataFrame:
    """Per-second rates of cumulative counters; null on the first sample and after a reset."""
    before = {f"_before_{c}": c for c in (*counters, "ts")}
    shifted = neighbour(system_metrics, list(by), list(order), before, step=-1)
    elapsed = seconds_between("_before_ts", "ts")
    rates = [F.when((F.col(c) >= F.col(f"_before_{c}")) & (elapsed > 0), (F.col(c) - F.col(f"_before_{c}")) / elapsed)
             .alias(f"{c}_per_second") for c in counters]
    return shifted.select(*system_metrics.columns, *rates)


def recent_errors(log_events: DataFrame, n: int = LOG_SHOWN, level: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """The newest ``n`` messages, of one level if it is given, oldest first."""
    kept = log_events.withColumn("level", F.upper("level"))
    if level is not None:
        kept = kept.filter(F.col("level") == level.upper())
    return keep_last(kept, list(by), ["ts", "seq"], n).orderBy(*by, "ts", "seq")


def status_history(snapshots: DataFrame, n: int = 100) -> DataFrame:
    """The last ``n`` points of the status series."""
    return keep_last(snapshots, [], ["ts"], n)


# Buffers -------------------------------------------------------------------------------------------------------------

def buffer_occupancy(buffer_events: DataFrame, total: int, window_seconds: float | None = 60, by: Sequence[str] = ()) -> DataFrame:
    """Buffers in use after every event of the last ``window_seconds``.

    Events before the window only count into a start value, so the ordered part never grows beyond the window.
    """
    by = list(by)
    events = buffer_events.withColumn("_step", F.when(F.col("kind") == "acquire", 1).otherwise(-1))
    if window_seconds is None:
        recent = events.withColumn("_base", F.lit(0).cast("bigint"))
    else:
        cutoff = events.groupBy(*by).agg((F.max(micros("ts")) - int(window_seconds * MICROS)).alias("_cutoff"))
        marked = attach(events, cutoff, by).withColumn("_old", micros("ts") < F.col("_cutoff"))
        base = marked.groupBy(*by).agg(F.coalesce(F.sum(F.when(F.col("_old"), F.col("_step"))), F.lit(0)).alias("_base"))
        recent = attach(marked.filter(~F.col("_old")).drop("_cutoff", "_old"), base, by)
    running = running_sum(recent, by, ["ts", "seq"], {"_sum": "_step"})
    active = F.col("_base") + F.col("_sum")
    return running.select(*by, "ts", "seq", active.alias("active"), (F.lit(total) - active).alias("free"), F.lit(total).alias("total"))


def buffer_state(buffer_events: DataFrame, total: int, by: Sequence[str] = ()) -> DataFrame:
    """Buffers in use and available now."""
    last = buffer_events.groupBy(*by, "buffer_id").agg(F.max_by(F.col("kind") == "acquire", moment()).alias("held"))
    used = F.count_if("held")
    return last.groupBy(*by).agg(used.alias("in_use"), (F.lit(total) - used).alias("available"), F.lit(total).cast("bigint").alias("total"))


def ownership_violations(buffer_events: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Releases of a buffer that is not held, or is held by somebody else."""
    before = neighbour(buffer_events, [*by, "buffer_id"], ["ts", "seq"], {"_kind": "kind", "holder": "owner"}, step=-1)
    held_by_owner = F.coalesce((F.col("_kind") == "acquire") & (F.col("holder") == F.col("owner")), F.lit(False))
    holder = F.when(F.col("_kind") == "acquire", F.col("holder"))
    return (before.filter((F.col("kind") == "release") & ~held_by_owner)
            .select(*by, "buffer_id", "ts", "seq", "owner", holder.alias("holder")))


# Stage counters ------------------------------------------------------------------------------------------------------

def stage_counters(stage_events: DataFrame) -> DataFrame:
    """Per stage and worker: items, bytes, mean time, mean ratio, last activity."""
    return stage_events.groupBy("stage", "worker_id").agg(
        F.count(F.lit(1)).alias("items"), F.sum("n_bytes").alias("total_bytes"), F.avg("seconds").alias("avg_time"),
        F.avg("compression_ratio").alias("avg_ratio"), F.max("ts").alias("last_activity"))


def staleness(counters: DataFrame, now: DataFrame | Column) -> DataFrame:
    """Seconds since the last activity, as a probability of being idle after ten seconds."""
    if isinstance(now, DataFrame):
        counters, now = attach(counters, now.toDF("_now"), []), F.col("_now")
    return counters.select("*", seconds_between("last_activity", now).alias("idle_time")).withColumn(
        "idle_probability", F.least(F.lit(1.0), F.col("idle_time") / IDLE_AFTER_SECONDS)).drop("_now")


def status_summary(counters: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Totals per stage; the ratio is the plain mean of the compressors' means."""
    def items(stage: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("stage") == stage, F.col("items"))), F.lit(0))
    written = F.sum(F.when(F.col("stage") == "writer", F.col("total_bytes")))
    return counters.groupBy(*by).agg(
        items("producer").alias("total_produced"), items("compressor").alias("total_compressed"),
        F.coalesce(F.avg(F.when(F.col("stage") == "compressor", F.col("avg_ratio"))), F.lit(0.0)).alias("avg_ratio"),
        items("writer").alias("files_written"),
        (F.coalesce(written, F.lit(0)) / float(1 << 20)).alias("written_mb"))


def queue_depths(queue_events: DataFrame) -> DataFrame:
    """Items put but not yet taken, per queue."""
    return queue_events.groupBy("queue").agg(
        F.sum(F.when(F.col("kind") == "put", 1).otherwise(-1)).alias("depth"))


def full_status(stats: DataFrame, log_events: DataFrame, level: str | None = None) -> DataFrame:
    """All roll-ups as one row: section name to JSON document. The statistics are read in one aggregation."""
    counted = [F.struct(F.lit(name).alias("key"), F.count_if(_idle_status() == name).alias("value")) for name in ("active", "idle")]
    present = F.filter(F.array(*counted), lambda c: c["value"] > 0)
    sections = {"workers": _rollup(), "throughput": _stage_rates(), "queues": _queues(), "compression": _compression(),
                "idle": [F.map_from_entries(present).alias("workers_by_status")]}
    bodies = stats.agg(*[F.struct(*columns).alias(name) for name, columns in sections.items()])
    errors = recent_errors(log_events, level=level).agg(
        F.struct(F.sort_array(F.collect_list(F.struct("ts", "seq", "level", "message"))).alias("messages")).alias("errors"))
    # Two tables of one row each.
    names = (*sections, "errors")
    return bodies.crossJoin(errors).select(F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*map(F.to_json, names))).alias("status"))
