"""Ordered per-group building blocks that stay parallel when one group holds most of the rows.

Every function takes ``keys`` (may be empty) and ``order`` (ascending, unique within a group). All of them work on slices:
a group of more than ``SLICE_ROWS`` rows is cut where its rows, counted per bucket of the first order column, fill a slice;
any other group is one slice. Windows run within slices, and one small row per slice of a cut group carries the state across.
Counts decide the cuts, so that they are the same whenever a lost task is run again. Everything is part of one lazy plan:
calling a function runs no job, and where no group is large the plan finds an empty table of cuts at run time and goes on with
plain windows. A caller that chains several steps over the same groups starts with :func:`slice_rows`.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows that one slice should hold. The tables of cuts and of carried states have one row per so many rows at most.
SLICE_ROWS = 4_000_000
SLICE, CUT, BEFORE = "_slice", "_cut", "_before_slice"
#: Hashes of the keys whose rows are counted first.
KEY_HASHES = 1 << 16
# Buckets per doubling of the distance from a group's first value: 2 ** STEPS.
STEPS = 20
#: Parts of a group that keep their own last rows before the group's are chosen.
SALTS = 32


def _number(df: DataFrame, column: str) -> Column:
    """A whole number that never falls where the column rises; other types than times, dates, integers and texts give one value."""
    kind, value = df.schema[column].dataType, F.col(column)
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(value)
    if isinstance(kind, T.TimestampNTZType):
        # From its parts: as a time of a zone it would fall where clocks are changed.
        seconds = F.unix_date(value.cast("date")).cast("bigint") * 86_400 + F.hour(value) * 3600 + F.minute(value) * 60
        return seconds * 1_000_000 + (F.extract(F.lit("SECOND"), value) * 1_000_000).cast("bigint")
    if isinstance(kind, T.DateType):
        return F.unix_date(value).cast("bigint")
    if isinstance(kind, T.IntegralType):
        return value.cast("bigint")
    if isinstance(kind, T.StringType):
        return F.conv(F.rpad(F.hex(F.substring(value.cast("binary"), 1, 7)), 14, "0"), 16, 10).cast("bigint")
    return F.lit(0).cast("bigint")


def _bucket(number: Column, least: Column) -> Column:
    """Bucket of a value by its distance from the least one: of equal width within each doubling, so that a stray value far
    from all others does not widen theirs. Nulls come first."""
    # Halved, so that a distance is never beyond the largest number.
    distance = F.shiftright(number, 1) - F.shiftright(least, 1) + 1
    octave = F.length(F.bin(distance)) - 1
    wide = F.call_function("shiftright", distance, F.greatest(octave - STEPS, F.lit(0)))
    step = F.call_function("shiftleft", wide, F.greatest(F.lit(STEPS) - octave, F.lit(0))) - (1 << STEPS)
    return F.coalesce(octave.cast("bigint") * (1 << STEPS) + step, F.lit(-1).cast("bigint"))


def _on_keys(rows: DataFrame, other: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join ``other``, a table of at most one row per ``SLICE_ROWS`` rows; null keys match each other."""
    renamed = other.select(*[F.col(c).alias(f"_on_{c}") for c in keys], *[c for c in other.columns if c not in keys])
    condition = F.lit(True)
    for c in keys:
        condition = condition & F.col(c).eqNullSafe(F.col(f"_on_{c}"))
    return rows.join(F.broadcast(renamed), condition, how).drop(*[f"_on_{c}" for c in keys])


def slice_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows with their slice for several steps over the same groups; drop the columns of :data:`MARKS` at the end."""
    if SLICE in df.columns:
        return df
    value = _number(df, order[0])
    own = df.select(*keys, value.alias("_cut_value"))
    if keys:
        # Only a crowded hash of the keys can hold a large group: mostly there is none, and groups need not be counted one by one.
        own = own.withColumn("_cut_hash", F.pmod(F.xxhash64(*keys), F.lit(KEY_HASHES)))
        crowded = df.groupBy(F.pmod(F.xxhash64(*keys), F.lit(KEY_HASHES)).alias("_cut_hash")).agg(F.count(F.lit(1)).alias("_cut_n")).filter(F.col("_cut_n") > SLICE_ROWS)
        own = own.join(F.broadcast(crowded.drop("_cut_n")), "_cut_hash", "left_semi")
    large = own.groupBy(*keys).agg(F.count(F.lit(1)).alias("_cut_rows"), F.min("_cut_value").alias("_cut_least")).filter(F.col("_cut_rows") > SLICE_ROWS)
    counted = _on_keys(own, large, keys, "inner").groupBy(*keys, "_cut_least", _bucket(F.col("_cut_value"), F.col("_cut_least")).alias("_cut_bucket")).agg(
        F.count(F.lit(1)).alias("_cut_n"))
    # A bucket belongs to the slice that its first row falls into.
    upto = F.sum("_cut_n").over(W.partitionBy(*keys).orderBy("_cut_bucket").rowsBetween(W.unboundedPreceding, 0))
    slices = counted.withColumn("_cut_before", upto - F.col("_cut_n")).groupBy(*keys, "_cut_least", F.floor(F.col("_cut_before") / SLICE_ROWS).alias("_cut_part")).agg(
        F.min("_cut_bucket").alias("start"), F.min("_cut_before").alias("before"))
    cut = slices.groupBy(*keys, "_cut_least").agg(F.array_sort(F.collect_list(F.struct("start", "before"))).alias("_cut_cuts"))
    # The bucket is the fold's start value, so that it is found once for a row and not once for a cut.
    at = F.struct(_bucket(value, F.col("_cut_least")).alias("at"), F.lit(-1).alias("n"))
    begun = F.aggregate("_cut_cuts", at, lambda acc, c: F.struct(acc["at"].alias("at"), (acc["n"] + (c["start"] <= acc["at"]).cast("int")).alias("n")), lambda acc: acc["n"])
    marked = _on_keys(df, cut, keys).withColumn(SLICE, F.when(F.col("_cut_cuts").isNotNull(), begun).otherwise(0))
    before = F.coalesce(F.get("_cut_cuts", F.col(SLICE))["before"], F.lit(0).cast("bigint"))
    return marked.select(*df.columns, SLICE, before.alias(BEFORE), F.col("_cut_cuts").isNotNull().alias(CUT))


MARKS = (SLICE, BEFORE, CUT)


def _over(keys: Sequence[str], order: Sequence[str]):
    return W.partitionBy(*keys, SLICE).orderBy(*order)


def _across(sliced: DataFrame, keys: Sequence[str], aggregates: Mapping[str, Column], carry: Callable[[str, object], Column]) -> DataFrame:
    """One row per slice of a cut group, its aggregates replaced by what the group's other slices hand over."""
    summary = sliced.filter(CUT).groupBy(*keys, SLICE).agg(*[c.alias(n) for n, c in aggregates.items()])
    between = W.partitionBy(*keys).orderBy(SLICE)
    return summary.select(*keys, SLICE, *[carry(n, between).alias(n) for n in aggregates])


def _columns(values: Mapping[str, Column | str]) -> dict[str, Column]:
    return {name: F.col(v) if isinstance(v, str) else v for name, v in values.items()}


def running_sum(df: DataFrame, keys: Sequence[str], order: Sequence[str], sums: Mapping[str, Column | str]) -> DataFrame:
    """Add inclusive running sums ``{output: value}``."""
    sums = _columns(sums)
    sliced = slice_rows(df, keys, order)
    base = _across(sliced, keys, {f"_base_{n}": F.sum(v) for n, v in sums.items()},
                   lambda n, between: F.sum(n).over(between.rowsBetween(W.unboundedPreceding, -1)))
    frame = _over(keys, order).rowsBetween(W.unboundedPreceding, 0)
    local = sliced.select("*", *[F.sum(v).over(frame).alias(n) for n, v in sums.items()])
    return _on_keys(local, base, [*keys, SLICE]).select(*df.columns, *[
        F.when(F.col(f"_base_{n}").isNull(), F.col(n)).otherwise(F.coalesce(n, F.lit(0)) + F.col(f"_base_{n}")).alias(n) for n in sums])


def number(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str = "rn") -> DataFrame:
    """Add dense positions 1, 2, 3, ... as bigint: the counts that made the cuts say where a slice begins."""
    sliced = slice_rows(df, keys, order)
    return sliced.select(*df.columns, (F.row_number().over(_over(keys, order)) + F.col(BEFORE)).alias(out))


def neighbour(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Mapping[str, str], step: int) -> DataFrame:
    """Add the values of the next (step 1) or previous (step -1) row of the group, null at its end."""
    shift, pick = (F.lead, F.min_by) if step > 0 else (F.lag, F.max_by)
    sliced = slice_rows(df, keys, order)
    both = F.struct(*[F.col(v).alias(n) for n, v in values.items()])
    edge = _across(sliced, keys, {"_edge": pick(both, F.struct(*order))}, lambda n, between: shift(n, 1).over(between))
    frame = _over(keys, order)
    local = sliced.select("*", shift(both, 1).over(frame).alias("_near"))
    return _on_keys(local, edge, [*keys, SLICE]).select(*df.columns, *[F.coalesce("_near", "_edge").getField(n).alias(n) for n in values])


def last_known(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Mapping[str, Column | str]) -> DataFrame:
    """Add the latest non-null value up to and including each row."""
    values = _columns(values)
    sliced = slice_rows(df, keys, order)
    rank = F.struct(*order)
    carried = _across(sliced, keys, {f"_carry_{n}": F.max_by(v, F.when(v.isNotNull(), rank)) for n, v in values.items()},
                      lambda n, between: F.last(n, ignorenulls=True).over(between.rowsBetween(W.unboundedPreceding, -1)))
    frame = _over(keys, order).rowsBetween(W.unboundedPreceding, 0)
    local = sliced.select("*", *[F.last(v, ignorenulls=True).over(frame).alias(f"_own_{n}") for n, v in values.items()])
    return _on_keys(local, carried, [*keys, SLICE]).select(*df.columns, *[F.coalesce(f"_own_{n}", f"_carry_{n}").alias(n) for n in values])


def trailing_sum(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int, sums: Mapping[str, Column | str]) -> DataFrame:
    """Add sums over the last ``n`` rows, as the difference of two running sums: values must be whole numbers.

    The cost does not depend on ``n``: every row looks up the running sum of the place ``n`` rows before its own.
    """
    sums = _columns(sums)
    totals = running_sum(df, keys, order, {"_rn": F.lit(1).cast("bigint"), **sums})
    before = totals.select(*[F.col(k).alias(f"_on_{k}") for k in keys], (F.col("_rn") + n).alias("_on_rn"), *[F.col(s).alias(f"_before_{s}") for s in sums])
    condition = F.col("_rn") == F.col("_on_rn")
    for k in keys:
        condition = condition & F.col(k).eqNullSafe(F.col(f"_on_{k}"))
    return totals.join(before, condition, "left").select(*df.columns, *[(F.col(s) - F.coalesce(f"_before_{s}", F.lit(0))).alias(s) for s in sums])


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int | None) -> DataFrame:
    """The last ``n`` rows of every group; ``None`` keeps all.

    A group's rows are dealt to parts by their order values. Each part keeps its last ``n``, then the group those of its parts,
    for every ``n`` and also without keys: no task sees more of a group than a part's rows, or ``SALTS`` times ``n``.
    """
    if n is None:
        return df
    parts = df.withColumn(SLICE, F.pmod(F.xxhash64(*order), F.lit(SALTS)))
    for group in ([*keys, SLICE], list(keys)):
        newest = W.partitionBy(*group).orderBy(*[F.col(c).desc() for c in order])
        parts = parts.withColumn("_rank", F.row_number().over(newest)).filter(F.col("_rank") <= n)
    return parts.select(*df.columns)
