"""Column expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Stage words in matching order.
STAGES = ("producer", "compressor", "writer")
MICROS = 1_000_000

ColumnLike = Column | str


def col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def micros(ts: ColumnLike) -> Column:
    """Epoch microseconds of a timestamp."""
    return F.unix_micros(col(ts))


def seconds_between(start: ColumnLike, end: ColumnLike) -> Column:
    return (micros(end) - micros(start)) / F.lit(float(MICROS))


def floor_div(value: Column, by: int) -> Column:
    """Whole-number division rounding down, exact for any bigint."""
    return F.call_function("div", value - F.pmod(value, F.lit(by)), F.lit(by))


def ratio(part: ColumnLike, whole: ColumnLike, empty: float | None = 0.0) -> Column:
    """part / whole where whole > 0, else ``empty``."""
    part, whole = col(part), col(whole)
    return F.when(whole > 0, part / whole).otherwise(F.lit(empty).cast("double"))


def stage_of(name: ColumnLike) -> Column:
    """Stage named by a worker's name, else ``unknown``."""
    lowered = F.lower(col(name))
    found = F.lit("unknown")
    for stage in reversed(STAGES):
        found = F.when(lowered.contains(stage), F.lit(stage)).otherwise(found)
    return found


def element_count(shape: ColumnLike) -> Column:
    """Product of the dimensions."""
    return F.aggregate(col(shape), F.lit(1).cast("bigint"), lambda acc, dim: acc * dim)


def zero_bytes(n: ColumnLike) -> Column:
    """``n`` zero bytes."""
    return F.unhex(F.repeat(F.lit("00"), col(n).cast("int") if isinstance(n, Column) else F.col(n).cast("int")))


def moment(ts: ColumnLike = "ts", seq: ColumnLike = "seq") -> Column:
    """(time, sequence) as one number of fixed width, so that a latest value is found by hashing and not by sorting."""
    wide = "decimal(38,0)"
    return (micros(ts).cast(wide) * F.lit(str(10 ** 19)).cast(wide)).cast(wide) + col(seq).cast("decimal(19,0)")


def attach(df: DataFrame, stats: DataFrame, by: Sequence[str]) -> DataFrame:
    """Add group-level columns to rows: an equi-join on ``by``; without ``by`` the single row of ``stats`` joins all."""
    if by:
        return df.join(stats, list(by), "left")
    return df.join(F.broadcast(stats), F.lit(True), "left")
