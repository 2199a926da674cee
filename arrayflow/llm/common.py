"""Helpers the pipeline operators share: pinned tables, ranges of an ordering, ranks inside groups of any size."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from arrayflow.session import scratch_path

#: A word: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def tune(spark: SparkSession) -> None:
    """Bound what one Arrow batch of texts holds, however long the texts are."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Jobs that are defined and run inside leave no shuffle files behind. Later jobs must start from pinned tables."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


@contextmanager
def rows_in_batch(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of jobs that run inside hold up to so many rows, within the bound of bytes: for rows of numbers."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def parallelism(spark: SparkSession) -> int:
    """Shuffle partitions of the session: what its owner has sized for the input."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def pinned(df: DataFrame, name: str, options: dict[str, str] | None = None) -> DataFrame:
    """Write ``df`` once as a table in the shared folder, with the writer's ``options``, and read it from there.

    Later jobs then agree on its rows and start from files that survive a lost executor.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.options(**(options or {})).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def pinned_with(df: DataFrame, name: str, options: dict[str, str] | None = None, **facts: Column) -> tuple[DataFrame, dict]:
    """As :func:`pinned`, with aggregates over the rows that the write itself observes."""
    seen = Observation()
    out = pinned(df.observe(seen, *[c.alias(n) for n, c in facts.items()]), name, options)
    return out, seen.get


def whole_text(df: DataFrame, text: str) -> Column:
    """The text, a null one as empty."""
    return F.coalesce(df[text].cast("string"), F.lit(""))


def id_bounds(df: DataFrame, key: str, parts: int) -> np.ndarray:
    """At most ``parts - 1`` ascending cut points of the integer column ``key``; equal keys are never cut apart."""
    if parts < 2:
        return np.zeros(0, np.int64)
    shares = [i / parts for i in range(1, parts)]
    cuts = df.select(F.percentile_approx(key, F.array(*map(F.lit, shares)), 100 * parts).alias("cuts")).first()[0]
    return np.unique(np.array(cuts or [], np.int64))


def range_number(bounds: np.ndarray, key: Column) -> Column:
    """Number of the range of ``bounds`` that a key lies in (a bound opens a range); null keys go to range 0."""
    @F.pandas_udf("int")
    def number(keys: pd.Series) -> pd.Series:
        low = np.iinfo(np.int64).min
        return pd.Series(np.searchsorted(bounds, keys.fillna(low).to_numpy(np.int64), side="right").astype(np.int32))
    return number(key)


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[Column], spread: Column, name: str,
           attach: DataFrame | None = None) -> DataFrame:
    """Add ``name``: the row's place (from 0) in its group of ``keys``, exact and dense, with no task holding a group.

    ``spread`` is a number that cuts a group into slices; rows are placed slice by slice and by ``order`` inside a slice. One
    count per slice carries the places across slices. ``attach`` has one row per group, whose other columns are added.
    """
    cut = df.withColumn("_slice", spread)
    counts = cut.groupBy(*keys, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*keys).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(*keys, "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    if attach is not None:
        offsets = offsets.join(attach, list(keys))
    own = cut.withColumn("_place", F.row_number().over(W.partitionBy(*keys, "_slice").orderBy(*order)))
    return own.join(offsets, [*keys, "_slice"]).withColumn(name, F.col("_before") + F.col("_place") - 1).drop("_slice", "_place", "_before")
