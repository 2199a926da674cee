"""Catalog files: the JSON index and the appended Parquet form."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arrayflow.operators.catalog import latest_entries

CATALOG = ("tensor_id bigint, name string, filename string, shape array<bigint>, dtype string, "
           "created_at timestamp, compressed_file string")
ENTRY = "name string, filename string, shape array<bigint>, dtype string, created_at double, compressed_file string"


def _read(spark: SparkSession, schema: str, path: str, kind: str, **options: str) -> DataFrame | None:
    try:
        return spark.read.schema(schema).options(**options).format(kind).load(path)
    except AnalysisException as missing:
        if missing.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def load_catalog(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Entries of JSON indexes ``{"matrices": {id: entry}, "next_id": n}``; a missing path is an empty catalog.

    A pretty-printed index is one document per file; with ``multi_line`` false every line is an index and files are split.
    """
    schema = f"matrices map<string, struct<{ENTRY}>>, next_id bigint"
    raw = _read(spark, schema, path, "json", multiLine=str(multi_line).lower())
    if raw is None:
        return spark.createDataFrame([], CATALOG)
    entries = raw.select(F.explode("matrices").alias("id", "e"))
    return entries.select(F.col("id").cast("bigint").alias("tensor_id"), "e.name", "e.filename", "e.shape", "e.dtype",
                          F.timestamp_micros((F.col("e.created_at") * 1_000_000).cast("bigint")).alias("created_at"), "e.compressed_file")


def append_catalog(updates: DataFrame, path: str) -> None:
    """Append new or changed entries; :func:`read_catalog` resolves them.

    ``updated_at`` orders the changes of an entry; where it is missing, ``created_at`` stands in.
    """
    updated = F.coalesce("updated_at", "created_at") if "updated_at" in updates.columns else F.col("created_at")
    updates.withColumn("updated_at", updated).write.mode("append").parquet(path)


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """The appended catalog: per id the latest non-null values, and the time it was first created."""
    rows = _read(spark, f"{CATALOG}, updated_at timestamp", path, "parquet")
    if rows is None:
        return spark.createDataFrame([], CATALOG)
    return latest_entries(rows, ["updated_at"], earliest=["created_at"]).drop("updated_at")
