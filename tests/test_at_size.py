"""What keeps a task's share bounded when its table grows."""

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from arrayflow.functions import ordered
from arrayflow.sources import logs


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_task_holds_a_whole_version(spark, tmp_path):
    path = str(tmp_path / "saved")
    state = spark.range(1000).selectExpr("id AS state_id", "concat('p', id) AS payload")
    for version in (1, 2):
        logs.save_checkpoint(state, path, version, ts=1.0)
    logs.save_checkpoint(state.limit(7), path, 3, ts=1.0)
    next((tmp_path / "saved" / "version=3").glob("part-*.parquet")).unlink()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        read = logs.read_checkpoints(spark, path)
        assert "SortMergeJoin" not in plan(read)
        assert {v: n for v, n in read.groupBy("version").count().collect()} == {1: 1000, 2: 1000}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_logs_are_read_in_batches(spark, rows, monkeypatch):
    """Entries of many files are taken apart together; a file may be longer than a piece and be cut between batches."""
    entries = spark.range(3000).selectExpr(
        "concat('f', if(id < 900, 0, id % 400)) AS path", "id AS seq", "cast(id % 3 + 1 AS tinyint) AS op", "id / 8.0D AS ts", "-id AS offset", "id * 3 AS length",
        "if(id % 50 = 0, '', concat('{\"n\": \"', if(id % 7 = 0, 'é', 'e'), id, '\"}')) AS meta", "id % 11 = 0 AS spoiled")
    wanted = rows(entries.selectExpr("path", "op", "ts", "offset", "length", "meta", "NOT spoiled"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        for n in (10_000, 7):
            monkeypatch.setattr(logs, "WAL_ROWS", n)
            files = logs.wal_files(entries)
            assert "ObjectHashAggregate" not in plan(files)
            assert rows(files.groupBy().count()) == [(400,)]
            parsed = logs.parse_wal(files).persist()
            assert rows(parsed, "path", "op", "ts", "offset", "length", "meta", "checksum_ok") == wanted
            first = parsed.filter("path = 'f0'").orderBy("seq").select("seq", "offset", "bytes_left").collect()
            assert [r.seq for r in first] == list(range(len(first))) and [r.offset for r in first] == sorted((r.offset for r in first), reverse=True)
            assert first[-1].bytes_left == 0 and all(a.bytes_left > b.bytes_left for a, b in zip(first, first[1:]))
            parsed.unpersist()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("hashes", [1, 3, 1 << 16])
def test_large_groups_among_crowded_hashes(spark, rows, small_groups, monkeypatch, hashes):
    """Only rows of crowded hashes are counted by group; what is cut does not depend on how groups share hashes."""
    monkeypatch.setattr(ordered, "KEY_HASHES", hashes)
    df = spark.range(2000).selectExpr("if(id % 4 = 0, null, if(id % 4 = 1, -1, id div 8)) AS g", "id AS v", "cast(hash(id) % 10 AS bigint) AS n")
    sliced = ordered.slice_rows(df, ["g"], ["v"])
    assert "LeftSemi" in plan(sliced)
    assert rows(sliced.filter(ordered.CUT).select("g").distinct()) == [(-1,), (None,)]
    got = ordered.running_sum(df, ["g"], ["v"], {"total": "n"})
    window = df.withColumn("total", F.sum("n").over(W.partitionBy("g").orderBy("v").rowsBetween(W.unboundedPreceding, 0)))
    assert rows(got) == rows(window)


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_times_without_zone_are_cut(spark, rows, small_groups, zone):
    """Also where a zone's clocks are changed: 2024-03-10 and 2024-11-03 in New York, and before 1970."""
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.sql("""SELECT id, timestampadd(MILLISECOND, (id div 3) * 700003, start) AS t FROM range(60)
          JOIN (VALUES (TIMESTAMP_NTZ'2024-03-10 00:00:00.000001'), (TIMESTAMP_NTZ'2024-11-03 00:00:00'), (TIMESTAMP_NTZ'1969-12-31 22:00:00.5')) v(start)""")
        df = df.withColumn("id", F.row_number().over(W.orderBy(F.col("t"), F.xxhash64("id", "t"))))
        assert dict(df.dtypes)["t"] == "timestamp_ntz"
        slices = ordered.slice_rows(df, [], ["t", "id"]).groupBy(ordered.SLICE).agg(F.count("t").alias("n"), F.min("t"), F.max("t")).orderBy(ordered.SLICE).collect()
        assert len(slices) > 4 and max(s.n for s in slices) < 40
        assert all(a[3] < b[2] for a, b in zip(slices, slices[1:]))
        assert rows(ordered.number(df, [], ["t", "id"]).filter("rn <> id")) == []
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
