"""Streams give what the batch operators give, also over several micro-batches."""

import json

import pytest
from pyspark.sql import functions as F

from arrayflow.functions.expr import micros
from arrayflow.operators import activity as A
from arrayflow.operators import tensors as T
from arrayflow.plans.bindings import with_gauges
from arrayflow.streaming import intervals, jobs

EVENTS = "worker_id bigint, ts timestamp, seq bigint, kind string, task_id string"


def feed_files(events, path, parts):
    """One file per micro-batch, in the given order."""
    for part in parts:
        events.filter(part).coalesce(1).write.mode("append").parquet(path)


def run_intervals(spark, path, out, schema, late):
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    (intervals.stream_intervals(stream, late).writeStream.format("parquet").option("path", f"{out}/data").option("checkpointLocation", f"{out}/state")
     .trigger(availableNow=True).start().awaitTermination())
    return spark.read.parquet(f"{out}/data")


def closed_of(events):
    return A.build_intervals(events).filter("end_time is not null").select(
        "worker_id", "task_id", micros("start_time").alias("start_us"), micros("end_time").alias("end_us"), "duration")


def test_intervals_over_batches(spark, frame, rows, tmp_path):
    data = [(w, float(10 * i + w + 100), 100 * w + i, "end" if i % 4 == 3 else "start", f"t{i}") for w in range(3) for i in range(20)]
    data += [(None, float(10 * i + 100), 900 + i, "start", f"n{i}") for i in range(20)]
    events = frame(data, EVENTS, ["ts"])
    tick = frame([(-1, 1e6, 0, "tick", None)], EVENTS, ["ts"])
    path = str(tmp_path / "in")
    feed_files(events, path, [f"seq % 100 >= {5 * p} AND seq % 100 < {5 * p + 5}" for p in range(4)])
    feed_files(tick, path, ["true"])
    assert rows(run_intervals(spark, path, str(tmp_path / "out"), events.schema, "5 seconds")) == rows(closed_of(events))


def test_late_events_take_their_place(spark, frame, rows, tmp_path):
    """Events one or more batches late are put where they belong; one behind the watermark is dropped; nothing is negative."""
    data = [(1, float(t), t, "start", f"t{t}") for t in (10, 20, 30, 40, 50, 60)] + [(2, 15.0, 7, "start", "a"), (2, 15.0, 8, "end", None), (2, 55.0, 9, "start", "b")]
    late, too_late = (1, 25.0, 25, "end", None), (1, 5.0, 5, "start", "gone")
    tick = (-1, 1e6, 0, "tick", None)
    events = frame([*data, late], EVENTS, ["ts"])
    path = str(tmp_path / "in")
    feed_files(events, path, ["seq in (10, 30, 7)", "seq in (20, 40, 9, 8)", "seq in (25, 60)"])
    feed_files(frame([too_late, data[4]], EVENTS, ["ts"]), path, ["true"])
    feed_files(frame([tick], EVENTS, ["ts"]), path, ["true"])
    got = run_intervals(spark, path, str(tmp_path / "out"), events.schema, "40 seconds")
    assert got.filter("duration < 0").count() == 0
    assert rows(got) == rows(closed_of(events))


def test_status_equals_batch(spark, frame, tmp_path):
    """The streamed statistics and status document are those of the batch functions, with open intervals, gauges and messages."""
    names = ["Producer", "Compressor", "Writer", "other"]
    data = [(w, f"{names[w % 4]}-{w}", float(10 * i + w), 100 * w + i, "end" if (i + w) % 5 == 4 else "start", f"t{i}", float(i % 3)) for w in range(6) for i in range(12)]
    events = frame(data, "worker_id bigint, worker_name string, ts timestamp, seq bigint, kind string, task_id string, value double", ["ts"])
    acts = with_gauges(A.build_intervals(events))
    closed, opened = acts.filter("end_time is not null"), events.filter("kind = 'start'").select("worker_id", "ts", "seq", F.col("value").alias("idle_time"))
    samples = frame([(w, m, float(t), t, float(t * (w + 1))) for w in range(5) for t, m in enumerate(A.GAUGES * 3)], "worker_id bigint, metric string, ts timestamp, seq bigint, value double", ["ts"])
    logs = frame([(float(t), t, "error", f"m{t}", 1) for t in range(37)], "ts timestamp, seq bigint, level string, message string, worker_id bigint", ["ts"])
    streams = {}
    for name, table in {"closed": closed, "opened": opened, "samples": samples, "logs": logs}.items():
        path = str(tmp_path / name)
        feed_files(table, path, [f"seq % 3 = {p}" for p in range(3)])
        streams[name] = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path)
    jobs.stream_recent(streams["logs"], str(tmp_path / "recent"), str(tmp_path / "s1"), once=True).awaitTermination()
    seen = []

    def sink(status, batch_id):
        seen.append(status.first()["status"])
    feed = jobs.status_feed(streams["closed"], streams["opened"], streams["samples"])
    jobs.stream_status(feed, lambda: jobs.recent_messages(spark, str(tmp_path / "recent")), sink, str(tmp_path / "s2"), once=True).awaitTermination()
    stats = A.process_stats(acts, samples)
    assert stats.filter("current_status <> 'unknown'").count() > 0
    wanted = A.full_status(stats, logs).first()["status"]
    assert {k: json.loads(v) for k, v in seen[-1].items()} == {k: pytest.approx(json.loads(v)) if k != "errors" and k != "idle" else json.loads(v) for k, v in wanted.items()}


def test_rate_tasks_cycle(spark, frame):
    grid = T.task_grid(frame([(0, 10), (1, 20)], "size_order int, size int"))
    query = jobs.rate_tasks(spark, grid, rows_per_second=50).writeStream.format("memory").queryName("rate_tasks").start()
    try:
        while spark.table("rate_tasks").count() < 20:
            query.processAllAvailable()
    finally:
        query.stop()
    made = spark.table("rate_tasks").collect()
    assert {r.kind for r in made} == {"random", "identity", "zeros"} and all(r.task_no == r.value % 6 for r in made)


def test_intervals_keep_one_state_per_bucket(spark, frame, rows, tmp_path):
    """Many workers share a state: its rows follow the buckets and batches, not the workers."""
    data = [(w, float(100 + 7 * i + w % 5), 100 * w + i, "end" if (i + w) % 4 == 3 else "start", f"t{w}-{i}") for w in range(90) for i in range(12)]
    events, path, out = frame(data, EVENTS, ["ts"]), str(tmp_path / "in"), str(tmp_path / "out")
    feed_files(events, path, [f"seq % 100 % 3 = {p}" for p in range(3)])
    feed_files(frame([(-1, 1e6, 0, "tick", None)], EVENTS, ["ts"]), path, ["true"])
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(path)
    query = (intervals.stream_intervals(stream, "200 seconds", buckets=3).writeStream.format("parquet").option("path", f"{out}/data")
             .option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start())
    query.awaitTermination()
    assert 0 < max(o["numRowsTotal"] for p in query.recentProgress for o in p["stateOperators"]) < 90
    assert rows(spark.read.parquet(f"{out}/data")) == rows(closed_of(events))
