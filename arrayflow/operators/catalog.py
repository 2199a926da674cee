"""Catalog queries: one row per tensor, payloads stay untouched."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arrayflow.functions.expr import element_count
from arrayflow.functions.ordered import number


def list_tensors(catalog: DataFrame, limit: int | None = None) -> DataFrame:
    """All entries in id order; a limit of 0 or None returns all."""
    ordered = catalog.orderBy("tensor_id")
    return ordered.limit(limit) if limit else ordered


def tensor_info(catalog: DataFrame, ids: DataFrame) -> DataFrame:
    """Entries of the given ids."""
    return catalog.join(ids.select("tensor_id"), "tensor_id", "left_semi")


def unknown_ids(catalog: DataFrame, ids: DataFrame) -> DataFrame:
    """Requested ids that have no entry."""
    return ids.select("tensor_id").distinct().join(catalog.select("tensor_id"), "tensor_id", "left_anti")


def read_many(tensors: DataFrame, ids: DataFrame) -> DataFrame:
    """Whole tensors (or their cells) of the given ids; ids without data are listed by :func:`unknown_ids`."""
    return tensors.join(ids.select("tensor_id"), "tensor_id", "left_semi")


def search_tensors(catalog: DataFrame, criteria: Mapping[str, object]) -> DataFrame:
    """Entries that meet every criterion.

    A scalar must be equal, a list means one of, a mapping compares struct or map fields, an unknown name matches nothing.
    """
    fields = {f.name: f.dataType for f in catalog.schema.fields}

    def equal(value: Column, wanted: object) -> Column:
        return value.isNull() if wanted is None else value == F.lit(wanted)

    def matches(name: str, wanted: object) -> Column:
        if name not in fields:
            return F.lit(False)
        value, kind = F.col(name), fields[name].typeName()
        if isinstance(wanted, Mapping):
            if kind == "struct":
                known = fields[name].fieldNames()
                parts = [equal(value.getField(k), v) if k in known else F.lit(False) for k, v in wanted.items()]
            elif kind == "map":
                parts = [F.map_contains_key(value, k) & equal(value[k], v) for k, v in wanted.items()]
            else:
                return F.lit(False)
            return reduce(lambda a, b: a & b, parts, value.isNotNull())
        if kind in ("array", "struct", "map"):
            return F.lit(False)
        if isinstance(wanted, (list, tuple, set)):
            return value.isin(list(wanted))
        return equal(value, wanted)

    return catalog.filter(reduce(lambda a, b: a & b, (matches(k, v) for k, v in criteria.items()), F.lit(True)))


def find_by_shape(catalog: DataFrame, shape: Sequence[int]) -> DataFrame:
    """Entries of exactly this shape."""
    return catalog.filter(F.col("shape") == F.array(*[F.lit(d).cast("bigint") for d in shape]))


def find_by_size_range(catalog: DataFrame, low: int, high: int) -> DataFrame:
    """Entries whose element count lies in [low, high]."""
    return catalog.filter(element_count("shape").between(low, high))


def find_by_name(catalog: DataFrame, pattern: str) -> DataFrame:
    """Entries whose name contains a match of the pattern in any case; a missing name is empty."""
    return catalog.filter(F.coalesce("name", F.lit("")).rlike(f"(?i){pattern}"))


def shape_distribution(catalog: DataFrame) -> DataFrame:
    return catalog.groupBy("shape").agg(F.count(F.lit(1)).alias("n"))


def size_distribution(catalog: DataFrame) -> DataFrame:
    return catalog.groupBy(element_count("shape").alias("n_elements")).agg(F.count(F.lit(1)).alias("n"))


def index_stats(catalog: DataFrame) -> DataFrame:
    """Distinct shapes, sizes and names. Each column is made distinct on its own, then counted, so no row is multiplied."""
    names = catalog.select(F.coalesce("name", F.lit("")).alias("v")).distinct().select(F.lit("names").alias("k"))
    shapes = shape_distribution(catalog).select(F.lit("shapes").alias("k"))
    sizes = size_distribution(catalog).select(F.lit("sizes").alias("k"))
    return shapes.union(sizes).union(names).groupBy().agg(
        *[F.count_if(F.col("k") == k).alias(f"unique_{k}") for k in ("shapes", "sizes", "names")])


def reader_stats(catalog: DataFrame, data_bytes: DataFrame, index_bytes: DataFrame) -> DataFrame:
    """Tensor count with catalog and data megabytes; the byte inputs are one-row results of ``dataset_size``."""
    mb = float(1 << 20)
    rows = (catalog.agg(F.count(F.lit(1)).alias("total_tensors"))
            .unionByName(data_bytes.select((F.col("total_bytes") / mb).alias("data_mb")), allowMissingColumns=True)
            .unionByName(index_bytes.select((F.col("total_bytes") / mb).alias("index_mb")), allowMissingColumns=True))
    return rows.agg(*[F.max(c).alias(c) for c in ("total_tensors", "index_mb", "data_mb")])


def assign_ids(df: DataFrame, order: Sequence[str], start: int = 0, out: str = "tensor_id") -> DataFrame:
    """Dense ids from ``start`` in the given order."""
    return number(df, [], order, "_rn").withColumn(out, F.col("_rn") - 1 + start).drop("_rn")


def latest_entries(rows: DataFrame, order: Sequence[str], earliest: Sequence[str] = ()) -> DataFrame:
    """One row per id out of additions and updates: every column's latest non-null value, the smallest one of ``earliest``."""
    columns = [c for c in rows.columns if c not in ("tensor_id", *order, *earliest)]
    newest = [F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(*order))).alias(c) for c in columns]
    merged = rows.groupBy("tensor_id").agg(*[F.max(c).alias(c) for c in order], *[F.min(c).alias(c) for c in earliest], *newest)
    return merged.select(*rows.columns)


def merge_catalog(catalog: DataFrame, updates: DataFrame) -> DataFrame:
    """Catalog after additions and updates: per id the update's values, null fields keep the old ones."""
    both = catalog.withColumn("_step", F.lit(0)).unionByName(updates.withColumn("_step", F.lit(1)), allowMissingColumns=True)
    return latest_entries(both, ["_step"]).drop("_step")
