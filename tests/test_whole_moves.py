"""The move queries look at every move of a cluster, not only at the best one of each source."""

import pytest

import __spark_entry__ as entry
from arrayflow.operators import skew as S
from oracle import compare, connect

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def counted(spark):
    """Pairs of a source and a target with enough gain per cluster, counted without forming them."""
    from arrayflow.plans import bindings as B
    best = S.move_candidates(B.workers(spark, SF), 0.15, ["cluster"]).groupBy("cluster").sum("n_targets").collect()
    return {cluster: n for cluster, n in best}


def of(spark, name):
    return entry.queries()[name](spark, SF)


def rows_per_cluster(spark, name):
    return {cluster: n for cluster, n in of(spark, name).groupBy("cluster").count().collect()}


def test_move_candidates(spark, counted):
    assert sum(counted.values()) > 75 and rows_per_cluster(spark, "move_candidates") == counted


def test_move_pairs_without_groups(frame, rows):
    workers = frame([(0, .95, 0.0, 9, 95.0), (1, .1, .9, 0, 5.0), (2, .9, .05, 7, 50.0), (3, .05, .6, 1, 2.0)],
                    "worker_id bigint, current_load double, idle_probability double, queue_size int, cpu_usage double")
    assert [(s, t, round(i, 6)) for s, t, i in rows(S.move_pairs(workers, 0.15))] == [(0, 1, 0.24), (0, 3, 0.175), (2, 1, 0.225), (2, 3, 0.165)]
    assert rows(S.move_pairs(workers, 0.23), "source_id", "target_id") == [(0, 1)]


def test_best_moves_keep_their_sql(spark):
    assert compare(of(spark, "best_moves"), connect(SF), entry.oracle_sql()["best_moves"]) is None


def test_project_moves(spark, counted):
    assert rows_per_cluster(spark, "project_moves") == counted


def test_move_effect(spark, counted):
    assert {r.cluster: r.total for r in of(spark, "move_effect").collect()} == counted


def test_adaptive_threshold(spark, counted):
    assert rows_per_cluster(spark, "adaptive_threshold") == counted


def test_recent_success(spark, counted):
    assert {r.cluster: r.n for r in of(spark, "recent_success").collect()} == {c: min(n, 20) for c, n in counted.items()}
