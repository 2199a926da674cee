"""Ordered building blocks: slices give what one window gives, also with one key holding most rows, ties and nulls."""

import random

import pytest
from pyspark.sql import functions as F

from arrayflow.functions import ordered as O


@pytest.fixture(scope="module")
def skewed(spark):
    """300 rows: a hot key, a few small ones, a null key, sparse values, many equal times."""
    rng = random.Random(3)
    data = []
    for seq in range(300):
        key = "hot" if rng.random() < 0.6 else rng.choice(["a", "b", "c", None])
        data.append((key, rng.randrange(40), seq, rng.randrange(100), rng.choice([None, rng.randrange(9)])))
    return spark.createDataFrame(data, "k string, t bigint, seq bigint, v bigint, sparse bigint").repartition(5).persist()


CASES = {
    "running_sum": lambda df, keys: O.running_sum(df, keys, ["t", "seq"], {"s": "v", "n": F.lit(1), "p": "sparse"}),
    "number": lambda df, keys: O.number(df, keys, ["t", "seq"]),
    "next": lambda df, keys: O.neighbour(df, keys, ["t", "seq"], {"nt": "t", "ns": "sparse"}, step=1),
    "previous": lambda df, keys: O.neighbour(df, keys, ["t", "seq"], {"pt": "t", "ps": "sparse"}, step=-1),
    "last_known": lambda df, keys: O.last_known(df, keys, ["t", "seq"], {"known": "sparse", "v2": "v"}),
    "trailing_sum": lambda df, keys: O.trailing_sum(df, keys, ["t", "seq"], 7, {"s7": "v", "n7": F.lit(1)}),
    "keep_last": lambda df, keys: O.keep_last(df, keys, ["t", "seq"], 11),
}


@pytest.mark.parametrize("keys", [[], ["k"]], ids=["global", "keyed"])
@pytest.mark.parametrize("case", CASES)
def test_slices_equal_window(skewed, rows, monkeypatch, case, keys):
    """All sizes of slices give the same rows, which for one slice come from plain windows."""
    plain = CASES[case](skewed, keys)
    wanted = rows(plain, *sorted(plain.columns))
    monkeypatch.setattr(O, "SLICE_ROWS", 16)
    sliced = CASES[case](skewed, keys)
    assert rows(sliced, *sorted(sliced.columns)) == wanted
    assert set(sliced.columns) == set(plain.columns)


def test_against_plain_python(skewed, rows):
    data = sorted([tuple(r) for r in skewed.collect()], key=lambda r: (r[1], r[2]))
    groups = {}
    for k, t, seq, v, sparse in data:
        groups.setdefault(k, []).append((k, t, seq, v, sparse))
    got = rows(O.keep_last(skewed, ["k"], ["t", "seq"], 11))
    assert got == sorted((r for g in groups.values() for r in g[-11:]), key=repr)
    summed = rows(O.running_sum(skewed, ["k"], ["t", "seq"], {"s": "v"}), "seq", "s")
    assert summed == sorted(((r[2], sum(x[3] for x in g[:i + 1])) for g in groups.values() for i, r in enumerate(g)), key=repr)


@pytest.mark.parametrize("n", [1, 25, 150, 2000])
def test_long_history(skewed, rows, monkeypatch, n):
    wanted = rows(O.keep_last(skewed, ["k"], ["t", "seq"], n))
    monkeypatch.setattr(O, "SALTS", 3)
    assert rows(O.keep_last(skewed, ["k"], ["t", "seq"], n)) == wanted
    every = sorted(map(tuple, skewed.collect()), key=lambda r: (r[1], r[2]))
    assert rows(O.keep_last(skewed, [], ["t", "seq"], n)) == sorted(every[-n:], key=repr)


def hot(spark, n):
    """A key with a third of all rows, in clusters, with one stray value far away; the other keys have three rows each."""
    values = F.when(F.col("id") % 3 > 0, F.concat(F.lit("k"), F.col("id") % 3, F.floor(F.col("id") / 9))).otherwise("hot")
    at = F.when(F.col("id") == 0, -(1 << 28)).when(F.col("id") % 5 == 0, F.lit(1 << 20) + F.col("id")).otherwise(F.col("id"))
    return spark.range(n).select(values.alias("k"), at.alias("t"), F.col("id").alias("seq"), F.lit(1).alias("v"))


def test_slices_split_a_hot_key(spark, monkeypatch):
    monkeypatch.setattr(O, "SLICE_ROWS", 500)
    sliced = O.slice_rows(hot(spark, 30_000), ["k"], ["t", "seq"])
    sizes = {(r["k"], r[O.SLICE]): r["count"] for r in sliced.groupBy("k", O.SLICE).count().collect()}
    of_hot = [n for (k, _), n in sizes.items() if k == "hot"]
    assert sum(of_hot) == 10_000 and len(of_hot) >= 10 and max(of_hot) <= 1000
    assert all(s == 0 for k, s in sizes if k != "hot")
    # A slice begins behind all values of the slices before it.
    spans = sorted((r[O.SLICE], r["low"], r["high"]) for r in sliced.filter("k = 'hot'").groupBy(O.SLICE).agg(F.min("t").alias("low"), F.max("t").alias("high")).collect())
    assert all(a[2] < b[1] for a, b in zip(spans, spans[1:], strict=False))


@pytest.mark.parametrize("kind", ["bigint", "timestamp", "date", "string", "double", "int"])
def test_order_types(spark, rows, monkeypatch, kind):
    values = {"timestamp": "timestamp_micros(id * 86400000000 - 3000000000000)", "date": "date_add(date'1969-11-01', cast(id as int))",
              "string": "lpad(cast(id as string), 9, 'x')", "double": "id / 7"}.get(kind, f"cast(id - 100 as {kind})")
    df = spark.range(400).selectExpr(f"{values} AS t", "id AS seq", "id % 2 AS k").unionByName(spark.sql(f"SELECT cast(null AS {kind}) AS t, -1L AS seq, 0L AS k"))
    wanted = rows(O.running_sum(df, ["k"], ["t", "seq"], {"s": "seq"}))
    monkeypatch.setattr(O, "SLICE_ROWS", 16)
    assert rows(O.running_sum(df, ["k"], ["t", "seq"], {"s": "seq"})) == wanted


def test_no_job_when_called(spark, skewed):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("calls", "")
    try:
        for case in CASES.values():
            case(skewed, ["k"])
        assert not tracker.getJobIdsForGroup("calls")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
