"""Hand-computed rows for activity, rolling and skew operators."""

import pytest
from pyspark.sql import functions as F

from arrayflow.functions.expr import micros
from arrayflow.operators import activity as A
from arrayflow.operators import rolling as R
from arrayflow.operators import skew as S

EVENTS = "worker_id bigint, ts timestamp, seq bigint, kind string, task_id string"


def test_intervals(frame, rows):
    events = frame([(1, 0.0, 1, "start", "a"), (1, 5.0, 2, "start", "b"), (1, 8.0, 3, "end", "b"), (1, 20.0, 4, "start", "c"), (2, 1.0, 5, "end", "x")], EVENTS, ["ts"])
    out = A.build_intervals(events).select("worker_id", "task_id", micros("start_time") / 1e6, micros("end_time") / 1e6, "duration")
    assert rows(out) == [(1, "a", 0.0, 5.0, 5.0), (1, "b", 5.0, 8.0, 3.0), (1, "c", 20.0, None, None)]


def activities(frame, data):
    """(worker, start, end, idle) rows."""
    made = [(w, f"Producer-{w}", s, e, i, None if e is None else int((e - s) * 1e6), idle) for i, (w, s, e, idle) in enumerate(data)]
    df = frame(made, "worker_id bigint, worker_name string, start_time timestamp, end_time timestamp, seq bigint, duration_us bigint, idle_time double", ["start_time", "end_time"])
    return df.withColumns({"cpu_usage": F.lit(1.0), "memory_usage": F.lit(2.0), "buffer_usage": F.lit(5), "queue_size": F.lit(10), "throughput": F.lit(100.0),
                           "compression_ratio": F.lit(0.7), "write_speed": F.lit(50.0)})


def test_worker_stats(frame):
    row = A.worker_stats(activities(frame, [(1, 0.0, 5.0, 1.0), (1, 5.0, 8.0, 1.0)])).first()
    assert (row.total_activities, row.total_duration, row.total_idle_time, row.idle_percentage) == (2, 8.0, 2.0, 25.0)
    assert A.worker_stats(activities(frame, [(1, 0.0, 0.0, 1.0)])).first().idle_percentage == 0.0


def test_first_name(frame):
    """The name of the first interval stays, at one instant the one without a sequence; sums cover all names."""
    acts = activities(frame, [(1, 5.0, 9.0, 1.0), (1, 0.0, 5.0, 1.0), (1, 9.0, 10.0, 1.0), (2, 0.0, 1.0, 0.0), (2, 0.0, 1.0, 0.0)])
    names = F.concat(F.lit("Writer-"), F.col("seq"))
    acts = acts.withColumns({"worker_name": F.when(F.col("seq") == 2, F.lit(None)).otherwise(names),
                             "seq": F.when(F.col("seq") != 4, F.col("seq"))})
    gauges = frame([(1, "throughput", 0.0, 1, 1.0)], GAUGE, ["ts"])
    stats = {r.worker_id: r for r in A.process_stats(acts, gauges).collect()}
    assert (stats[1].worker_name, stats[1].total_activities, stats[1].total_duration, stats[1].avg_queue_size) == ("Writer-1", 3, 10.0, 10.0)
    assert (stats[2].worker_name, stats[2].stage) == ("Writer-4", "writer")
    none = A.worker_stats(acts.withColumn("cpu_usage", F.lit(None).cast("double"))).first()
    assert none.avg_cpu_usage is None and none.avg_memory_usage == 2.0


def test_history_is_bounded(frame):
    data = [(1, float(i), float(i) + 1, 0.0) for i in range(6)]
    assert A.worker_stats(activities(frame, data), max_history=4).first().total_activities == 4
    assert A.worker_stats(activities(frame, data), max_history=None).first().total_activities == 6


def test_throughput_history(frame, rows):
    out = A.throughput_history(activities(frame, [(1, 0.0, 5.0, 0.0), (1, 5.0, 8.0, 0.0)]))
    assert rows(out, "throughput") == [(0.2,), (0.25,)]


GAUGE = "worker_id bigint, metric string, ts timestamp, seq bigint, value double"


def test_snapshot(frame):
    gauges = frame([(1, "throughput", 1.0, 1, 10.0), (2, "throughput", 1.0, 2, 5.0), (-1, "throughput", 1.0, 3, 99.0), (1, "buffer_usage", 1.0, 4, 3.0)], GAUGE, ["ts"])
    row = A.system_snapshot(gauges, frame([(7,)], "worker_id bigint"), total_buffers=4).first()
    assert (row.total_throughput, row.buffer_utilization_raw, row.buffer_utilization, row.active_processes) == (15.0, 75.0, 75.0, 1)


def test_process_stats_status(frame):
    gauges = frame([(1, "queue_size", 1.0, 1, 4.0), (1, "queue_size", 2.0, 2, 6.0)], GAUGE, ["ts"])
    stats = {r.worker_id: r for r in A.process_stats(activities(frame, [(1, 0.0, 5.0, 1.0), (1, 6.0, None, 0.0), (2, 0.0, 1.0, 0.0), (3, 0.0, 1.0, 0.0), (3, 2.0, None, 1.0)]), gauges).collect()}
    assert [stats[w].current_status for w in (1, 2, 3)] == ["active", "unknown", "idle"]
    assert stats[1].current_queue_size == 6.0 and stats[2].current_queue_size == 0.0 and stats[1].avg_write_speed == 50.0
    roll = A.pipeline_rollup(A.process_stats(activities(frame, [(1, 0.0, 5.0, 1.0)]), gauges)).first()
    assert (roll.total_processes, roll.active_processes, roll.idle_processes) == (1, 0, 1)


def test_queue_summary(frame):
    assert tuple(A.queue_summary(frame([(5.0,), (15.0,)], "current_queue_size double")).first()) == (20.0, 10.0, 20.0)


BUFFERS = "buffer_id bigint, ts timestamp, seq bigint, kind string, owner string"


def test_buffers(frame, rows):
    events = frame([(1, 1.0, 1, "acquire", "t1"), (2, 2.0, 2, "acquire", "t1"), (1, 3.0, 3, "release", "t2")], BUFFERS, ["ts"])
    assert rows(A.buffer_occupancy(events, 3, None), "seq", "active", "free") == [(1, 1, 2), (2, 2, 1), (3, 1, 2)]
    assert rows(A.buffer_occupancy(events, 3, 1), "seq", "active", "free") == [(2, 2, 1), (3, 1, 2)]
    assert rows(A.ownership_violations(events), "buffer_id", "owner", "holder") == [(1, "t2", "t1")]
    assert tuple(A.buffer_state(events, 3).first()) == (1, 2, 3)


def test_release_of_free_buffer_is_a_violation(frame, rows):
    events = frame([(1, 1.0, 1, "release", "t1"), (1, 2.0, 2, "acquire", "t1"), (1, 3.0, 3, "release", "t1"), (1, 4.0, 4, "release", "t1")], BUFFERS, ["ts"])
    assert rows(A.ownership_violations(events), "seq", "holder") == [(1, None), (4, None)]


def test_idle_classes_and_heatmap(frame, rows):
    idle = frame([(1, 50.0), (2, 50.1), (3, 130.0)], "worker_id bigint, idle_percentage double")
    assert [(r.status, round(r.idle_probability, 6)) for r in A.idle_classes(idle).orderBy("worker_id").collect()] == [("active", 0.5), ("idle", 0.501), ("idle", 1.0)]
    heat = frame([(1, 70.1, 0.0), (2, 70.0, 0.0), (3, 30.0, 0.0)], "worker_id bigint, idle_percentage double, avg_cpu_usage double")
    assert rows(A.activity_heatmap(heat), "worker_id", "band") == [(1, "green"), (2, "amber"), (3, "red")]


def test_counter_reset_has_no_rate(frame, rows):
    metrics = frame([("h", 0.0, 10), ("h", 2.0, 30), ("h", 3.0, 5)], "host string, ts timestamp, c bigint", ["ts"])
    assert rows(A.counter_rates(metrics, ["c"], ["host"]), "c", "c_per_second") == [(10, None), (30, 10.0), (5, None)]


def test_task_duration_uses_the_start_before_completion(frame):
    events = frame([("t", "x", 0.0, 1, "created", None), ("t", None, 1.0, 2, "started", 7), ("t", None, 4.0, 3, "completed", 7), ("t", None, 9.0, 4, "started", 8)],
                   "task_id string, task_type string, ts timestamp, seq bigint, event string, worker_id bigint", ["ts"])
    row = A.task_lifecycle(events).first()
    assert (row.duration, row.status, row.assigned_worker, row.task_type) == (3.0, "running", 8, "x")


def test_log_level_and_order(frame, rows):
    logs = frame([(float(i), i, "error" if i % 2 else "info", f"m{i}", 1) for i in range(120)], "ts timestamp, seq bigint, level string, message string, worker_id bigint", ["ts"])
    assert [r.seq for r in A.recent_errors(logs, 3, "error").collect()] == [115, 117, 119]
    assert A.recent_errors(logs, 500).count() == 120
    old = frame([(float(i), i, "error" if i < 20 else "info", f"m{i}", 1) for i in range(150)], "ts timestamp, seq bigint, level string, message string, worker_id bigint", ["ts"])
    assert A.recent_errors(old, 30, "error").count() == 20


def test_long_histories_count_in_full(spark, frame):
    long = spark.range(5000).selectExpr("1L AS worker_id", "timestamp_seconds(id) AS start_time", "timestamp_seconds(id + 1) AS end_time", "id AS seq", "1000000L AS duration_us",
                                        "0.5D AS idle_time", "1.0D AS cpu_usage", "2.0D AS memory_usage")
    row = A.worker_stats(long).first()
    assert (row.total_activities, row.total_duration, row.total_idle_time) == (5000, 5000.0, 2500.0)
    assert A.worker_stats(long, 1000).first().total_activities == 1000
    assert A.throughput_history(long).agg(F.max("throughput")).first()[0] == 1.0


def test_negative_workers_never_count(frame):
    assert A.latest_gauges(frame([(1, "throughput", 1.0, 1, 1.0), (1, "throughput", 1.0, 2, 2.0)], GAUGE, ["ts"])).first().throughput == 2.0


# Rolling -------------------------------------------------------------------------------------------------------------

def test_rolling_mean(frame, rows):
    gauges = frame([("m", 0.0, 1.0), ("m", 10.0, 3.0), ("m", 20.0, 5.0), ("x", 20.0, 7.0)], "metric string, ts timestamp, value double", ["ts"])
    assert rows(R.rolling_mean(gauges, 10), "metric", "rolling_mean") == [("m", 1.0), ("m", 2.0), ("m", 4.0), ("x", 7.0)]


def test_rolling_mean_forgets(frame, rows):
    """Large, infinite and undefined values leave with their window."""
    data = [("m", 5.0, 1e17), ("m", 6.0, 1.0), ("m", 17.0, 1.0), ("m", 18.0, 1.0), ("i", 0.0, float("inf")), ("i", 11.0, 2.0), ("i", 12.0, 4.0), ("i", 19.0, 6.0),
            ("n", 0.0, float("nan")), ("n", 10.5, 3.0)]
    gauges = frame(data, "metric string, ts timestamp, value double", ["ts"])
    got = {(m, t): v for m, t, v in rows(R.rolling_mean(gauges, 10), "metric", "ts_us", "rolling_mean")}
    assert got[("m", 17_000_000)] == got[("m", 18_000_000)] == 1.0
    assert [got[("i", t)] for t in (11_000_000, 12_000_000, 19_000_000)] == [2.0, 3.0, 4.0] and got[("n", 10_500_000)] == 3.0


def test_metric_vector(frame):
    gauges = frame([("queue_depth", 5.0, 2.0), ("queue_depth", 15.0, 4.0), ("writer_rate", 4.9, 9.0)], "metric string, ts timestamp, value double", ["ts"])
    row = R.metric_vector(gauges, 15_000_000, 10).first()
    assert (row.queue_depth, row.writer_rate) == (3.0, 0.0)


def test_scaling(frame, rows):
    rolling = frame([(1, 19.9), (2, 20.0), (3, 80.0), (4, 80.1), (5, None)], "id int, rolling_mean double")
    assert rows(R.scaling_decision(rolling), "id", "decision") == [(1, "add"), (2, "none"), (3, "none"), (4, "remove"), (5, "add")]


def test_stale(frame, rows):
    beats = frame([(1, 8.0), (2, 7.9), (2, 1.0)], "worker_id bigint, ts timestamp", ["ts"])
    assert rows(R.stale_workers(beats, 1, 10_000_000), "worker_id") == [(2,)]


@pytest.mark.parametrize("every_n, every_s", [(3, 4.0), (5, 2.5), (1, 1.0), (50, 3.0)])
def test_checkpoint_due_equals_a_loop(frame, rows, every_n, every_s):
    times = [0.0, 1.0, 1.0, 2.0, 6.0, 6.5, 7.0, 11.0, 11.0, 11.5, 20.0, 20.5, 24.5, 25.0]
    wanted, last = [], times[0]
    for i, t in enumerate(times, 1):
        reason = "count" if i % every_n == 0 else "timer" if t - last >= every_s else None
        if reason:
            last = t
            wanted.append((i, reason))
    done = frame([(t, i) for i, t in enumerate(times)], "ts timestamp, seq bigint", ["ts"])
    assert sorted((r.completion, r.reason) for r in R.checkpoint_due(done, every_n, every_s).collect()) == sorted(wanted)


# Skew ----------------------------------------------------------------------------------------------------------------

WORKERS = "worker_id bigint, current_load double, idle_probability double, queue_size int, cpu_usage double, memory_usage double"


@pytest.fixture
def workers(frame):
    return frame([(0, .95, 0.0, 9, 95.0, 50.0), (1, .1, .9, 0, 5.0, 10.0), (2, .9, .05, 7, 50.0, 20.0), (3, .05, .6, 1, 2.0, 5.0)], WORKERS)


def test_overload_and_scores(workers, rows):
    assert rows(S.overload_flags(workers).filter("is_overloaded"), "worker_id") == [(0,), (2,)]
    assert [round(r.score, 6) for r in S.worker_score(workers).orderBy("worker_id").collect()] == [-31.75, 10.55, -24.4, 5.8]
    assert [round(r.score, 6) for r in S.worker_score(workers, 2.0).orderBy("worker_id").collect()] == [-36.5, 10.05, -28.9, 5.55]


def test_gate_and_balance(workers, frame):
    gate = S.imbalance_gate(workers).first()
    assert (round(gate.variance, 7), gate["mean"], gate.gate) == (0.2416667, 0.5, True)
    assert round(S.balance_score(workers).first().balance_score, 7) == 0.7583333
    single = workers.filter("worker_id = 0")
    assert S.imbalance_gate(single).first().gate is False and S.balance_score(single).first().balance_score == 1.0
    assert S.balance_score(workers.filter("worker_id > 9")).first().balance_score == 1.0


def test_moves(workers, rows):
    found = [(s, t, round(i, 6), n) for s, t, i, n in rows(S.move_candidates(workers, 0.15), "source_id", "target_id", "improvement", "n_targets")]
    assert found == [(0, 1, 0.24, 2), (2, 1, 0.225, 2)]
    assert S.move_candidates(workers, 0.3).count() == 0


@pytest.mark.parametrize("threshold", [0.0, 0.02, 0.1, 0.15])
def test_moves_equal_all_pairs(spark, rows, threshold):
    made = spark.range(120).selectExpr(
        "id % 3 AS g", "id AS worker_id", "pmod(hash(id), 1000) / 700.0D AS current_load", "pmod(hash(id, 5), 100) / 100.0D AS idle_probability",
        "cast(pmod(hash(id, 6), 8) AS int) AS queue_size", "pmod(hash(id, 7), 120) * 1.0D AS cpu_usage", "1.0D AS memory_usage")
    loads = [r.asDict() for r in S.overload_flags(made).collect()]
    gates = {r.g: r.gate for r in S.imbalance_gate(made, ["g"]).collect()}
    wanted = {}
    for s in loads:
        for t in loads:
            if s["g"] == t["g"] and gates[s["g"]] and s["is_overloaded"] and t["idle_probability"] > .5 and t["queue_size"] < 2 and s["worker_id"] != t["worker_id"]:
                gain = s["current_load"] * .2 - t["current_load"] * .3
                gain = max(0.0, gain * 1.5 if t["idle_probability"] > .7 else gain)
                if gain > threshold:
                    wanted.setdefault((s["g"], s["worker_id"]), []).append((gain, -t["worker_id"]))
    best = [(*source, -max(pairs)[1], max(pairs)[0], len(pairs)) for source, pairs in wanted.items()]
    assert rows(S.move_candidates(made, threshold, ["g"])) == sorted(best, key=repr)


def test_moves_in_slices(spark, rows, small_groups):
    test_moves_equal_all_pairs(spark, rows, 0.02)


def test_projection(workers, frame):
    row = S.project_moves(workers, frame([(0, 1)], "source_id bigint, target_id bigint")).first()
    assert (round(row.source_load, 6), row.source_queue, round(row.target_load, 6), row.target_queue) == (0.76, 8, 0.12, 1)


def test_best_worker(workers, frame, rows):
    tasks = frame([(1, 0.5), (2, 3.0)], "task_id int, complexity double")
    assert rows(S.best_worker(workers, tasks), "task_id", "worker_id") == [(1, 1), (2, 1)]


def threshold_loop(flags, t):
    out = []
    for i in range(len(flags)):
        if i >= 9:
            rate = sum(flags[i - 9:i + 1]) / 10
            t = max(.1, min(.8, t * (.95 if rate > .8 else 1.05 if rate < .5 else 1)))
        out.append(t)
    return out


@pytest.mark.parametrize("flags, start", [([True] * 10, .3), ([True] * 60, .3), ([False] * 60, .3), ([i % 3 > 0 for i in range(90)], .9), ([(i * i) % 7 < 3 for i in range(120)], .05)])
def test_adaptive_threshold(frame, monkeypatch, flags, start):
    monkeypatch.setattr(S, "STRETCH", 4)
    moves = frame([(i, f) for i, f in enumerate(flags)], "seq bigint, success boolean")
    got = [r.threshold for r in S.adaptive_threshold(moves, start).orderBy("seq").collect()]
    assert got == pytest.approx(threshold_loop(flags, start), abs=1e-12)
    if start == .3 and len(flags) == 10:
        assert got[8] == .3 and round(got[9], 6) == .285


def test_assign(frame):
    candidates = frame([("t", 0, 7, 2), ("t", 1, 8, 2), ("t", 2, 9, 2)], "task_id string, position int, worker_id bigint, batch_size int")
    stats = frame([(7, 30.0), (8, 10.0)], "worker_id bigint, idle_percentage double")
    assert S.assign_tasks(candidates, stats).first().worker_id == 8
    assert S.assign_tasks(candidates, stats, "max_idle").first().worker_id == 9
    assert S.assign_tasks(candidates, stats, capacity=1).first().worker_id is None
    assert S.assign_tasks(candidates, stats, capacity=2).first().worker_id == 8


def test_recommendations_and_effect(workers, frame, rows):
    moves = frame([(i, i >= 3, float(i)) for i in range(12)], "seq bigint, success boolean, improvement double")
    assert [t for t, in rows(S.recommendations(workers, moves), "topic")] == ["idle", "moves", "overload"]
    assert tuple(S.move_effect(moves).first()) == (12, 9, 3, 6.5)
    assert S.recent_success(moves, 4).first().success_rate == 1.0
    assert S.recent_success(moves.filter("seq < 0")).first().success_rate == 0.0
