"""Every registered query against its SQL on the smallest given tables."""

import pytest

import __spark_entry__ as entry
from oracle import compare, connect

SF = "/root/testdata/sf0.001"
# Queries whose operators put ordered groups into slices once they grow.
ORDERED = ["build_intervals", "task_lifecycle", "throughput_history", "peak_concurrency", "counter_rates", "buffer_occupancy",
           "ownership_violations", "assign_ids", "segment_layout", "rle_encode", "rle_decode", "rolling_mean", "checkpoint_due",
           "load_history", "task_grid", "adaptive_threshold", "worker_stats", "process_stats", "rolling_idle", "export_activity_json"]


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert df.count() > 0
    else:
        assert compare(df, duck, sql) is None


@pytest.mark.parametrize("name", ORDERED)
def test_sliced(spark, duck, small_groups, name):
    assert compare(entry.queries()[name](spark, SF), duck, entry.oracle_sql()[name]) is None


def test_entry(spark):
    assert entry.entry(spark).count() > 0
