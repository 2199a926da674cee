"""Queries by operator name, each with the SQL that checks it (none where SQL cannot express it)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Register the decorated function under ``name``, its own if none is given."""
    def add(function: Query) -> Query:
        key = name or function.__name__
        QUERIES[key] = function
        if sql is not None:
            ORACLES[key] = sql
        return function
    return add


# Means of two-decimal values are often exact halves of the last digit kept; engines disagree on those, so both sides add
# a little before rounding.
NUDGE = 3e-8


def rounded(df: DataFrame, *columns: str, digits: int = 6, nudge: float = 0.0) -> DataFrame:
    """Round doubles, so that the order of additions does not show."""
    return df.withColumns({c: F.round(F.col(c) + nudge, digits) for c in columns})


def wide(df: DataFrame) -> DataFrame:
    """Integer columns as bigint, as the SQL has them."""
    return df.withColumns({f.name: F.col(f.name).cast("bigint") for f in df.schema.fields if f.dataType.simpleString() == "int"})
