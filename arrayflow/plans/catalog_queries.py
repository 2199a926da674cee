"""Catalog operators over `part`, with cells from `embeddings`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arrayflow.functions.expr import micros
from arrayflow.operators import catalog as C
from arrayflow.plans import bindings as B
from arrayflow.plans.registry import query
from arrayflow.plans.tensor_queries import written_lines
from arrayflow.session import scratch_path
from arrayflow.sources import catalogs, containers

CAT = """
cat AS (SELECT p_partkey AS tensor_id, p_name AS name, p_size::BIGINT AS rows, p_partkey % 10 + 1 AS cols,
  CASE WHEN p_size % 2 = 0 THEN 'float32' ELSE 'float64' END AS dtype FROM part)"""
ENTRY = "tensor_id, name, rows, cols, dtype"


def flat(catalog: DataFrame) -> DataFrame:
    """Catalog rows with the shape as two columns."""
    return catalog.select("tensor_id", "name", F.col("shape")[0].alias("rows"), F.col("shape")[1].alias("cols"), "dtype")


@query(f"WITH {CAT} SELECT {ENTRY} FROM cat ORDER BY tensor_id LIMIT 100")
def list_tensors(spark: SparkSession, sf: str) -> DataFrame:
    return flat(C.list_tensors(B.catalog(spark, sf), 100))


@query(f"WITH {CAT} SELECT {ENTRY} FROM cat WHERE tensor_id IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')")
def tensor_info(spark: SparkSession, sf: str) -> DataFrame:
    ids = B.table(spark, sf, "lineitem").filter(F.col("l_returnflag") == "R").select(F.col("l_partkey").alias("tensor_id"))
    return flat(C.tensor_info(B.catalog(spark, sf), ids))


@query("SELECT DISTINCT o_custkey AS tensor_id FROM orders WHERE o_custkey NOT IN (SELECT vec_id FROM embeddings)")
def unknown_ids(spark: SparkSession, sf: str) -> DataFrame:
    known = B.table(spark, sf, "embeddings").select(F.col("vec_id").alias("tensor_id"))
    return C.unknown_ids(known, B.table(spark, sf, "orders").select(F.col("o_custkey").alias("tensor_id")))


@query("""SELECT vec_id AS tensor_id, unnest(range(len(embedding))) AS pos, unnest(embedding)::DOUBLE AS value FROM embeddings
  WHERE vec_id IN (SELECT doc_id FROM labels WHERE quality = 1)""")
def read_many(spark: SparkSession, sf: str) -> DataFrame:
    ids = B.table(spark, sf, "labels").filter(F.col("quality") == 1).select(F.col("doc_id").alias("tensor_id"))
    return C.read_many(B.cells(spark, sf), ids)


@query(f"WITH {CAT} SELECT {ENTRY} FROM cat WHERE dtype IN ('float32') AND name = 'small ring'")
def search_tensors(spark: SparkSession, sf: str) -> DataFrame:
    return flat(C.search_tensors(B.catalog(spark, sf), {"dtype": ["float32"], "name": "small ring"}))


@query(f"WITH {CAT} SELECT {ENTRY} FROM cat WHERE rows = 10 AND cols = 4")
def find_by_shape(spark: SparkSession, sf: str) -> DataFrame:
    return flat(C.find_by_shape(B.catalog(spark, sf), [10, 4]))


@query(f"WITH {CAT} SELECT {ENTRY} FROM cat WHERE rows * cols BETWEEN 100 AND 200")
def find_by_size_range(spark: SparkSession, sf: str) -> DataFrame:
    return flat(C.find_by_size_range(B.catalog(spark, sf), 100, 200))


@query(f"WITH {CAT} SELECT {ENTRY} FROM cat WHERE regexp_matches(name, '(?i)^RED')")
def find_by_name(spark: SparkSession, sf: str) -> DataFrame:
    return flat(C.find_by_name(B.catalog(spark, sf), "^RED"))


@query(f"WITH {CAT} SELECT rows, cols, count(*) AS n FROM cat GROUP BY 1, 2")
def shape_distribution(spark: SparkSession, sf: str) -> DataFrame:
    shapes = C.shape_distribution(B.catalog(spark, sf))
    return shapes.select(F.col("shape")[0].alias("rows"), F.col("shape")[1].alias("cols"), "n")


@query(f"WITH {CAT} SELECT rows * cols AS n_elements, count(*) AS n FROM cat GROUP BY 1")
def size_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return C.size_distribution(B.catalog(spark, sf))


@query(f"WITH {CAT} SELECT count(DISTINCT (rows, cols)) AS unique_shapes, count(DISTINCT rows * cols) AS unique_sizes, count(DISTINCT name) AS unique_names FROM cat")
def index_stats(spark: SparkSession, sf: str) -> DataFrame:
    return C.index_stats(B.catalog(spark, sf))


@query("""SELECT (SELECT count(*) FROM part) AS total_tensors, (SELECT sum(strlen(p_name) + 1)::BIGINT FROM part) / 1048576.0::DOUBLE AS index_mb,
  (SELECT sum(strlen(o_orderpriority) + 1)::BIGINT FROM orders) / 1048576.0::DOUBLE AS data_mb""")
def reader_stats(spark: SparkSession, sf: str) -> DataFrame:
    data, index = (containers.dataset_size(spark, written_lines(spark, sf, *of)) for of in (("orders", "o_orderpriority"), ("part", "p_name")))
    return C.reader_stats(B.catalog(spark, sf), data, index)


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 + 500 AS tensor_id FROM orders")
def assign_ids(spark: SparkSession, sf: str) -> DataFrame:
    return C.assign_ids(B.table(spark, sf, "orders").select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"], 500).drop("o_orderdate")


def _updates(catalog: DataFrame) -> DataFrame:
    """Compressing the larger tensors adds a file name, one second later."""
    later = F.timestamp_micros(micros("created_at") + 1_000_000)
    changed = catalog.filter(F.col("shape")[0] > 25)
    return changed.select("tensor_id", later.alias("updated_at"), F.concat("filename", F.lit(".zst")).alias("compressed_file"))


@query(f"""WITH {CAT} SELECT {ENTRY}, CASE WHEN rows > 25 THEN 't_' || tensor_id || '.bin.zst' ELSE '' END AS compressed_file,
  1600000000 + tensor_id AS created_s FROM cat""")
def append_catalog(spark: SparkSession, sf: str) -> DataFrame:
    path, catalog = scratch_path(spark, "catalog"), B.catalog(spark, sf)
    catalogs.append_catalog(catalog, path)
    catalogs.append_catalog(_updates(catalog).withColumn("created_at", F.col("updated_at")), path)
    merged = catalogs.read_catalog(spark, path)
    return merged.select("tensor_id", "name", F.col("shape")[0].alias("rows"), F.col("shape")[1].alias("cols"), "dtype",
                         F.coalesce("compressed_file", F.lit("")).alias("compressed_file"), F.unix_seconds("created_at").alias("created_s"))


@query(f"""WITH {CAT} SELECT {ENTRY}, CASE WHEN rows > 25 THEN 't_' || tensor_id || '.bin.zst' ELSE '' END AS compressed_file FROM cat""")
def merge_catalog(spark: SparkSession, sf: str) -> DataFrame:
    catalog = B.catalog(spark, sf)
    merged = C.merge_catalog(catalog, _updates(catalog).drop("updated_at"))
    return flat(merged.withColumn("name", F.struct("name", "compressed_file"))).select(
        "tensor_id", "name.name", "rows", "cols", "dtype", F.coalesce("name.compressed_file", F.lit("")).alias("compressed_file"))


@query(f"WITH {CAT} SELECT {ENTRY} FROM cat")
def load_catalog(spark: SparkSession, sf: str) -> DataFrame:
    """Index documents of at most a hundred tensors each, written as JSON lines and read back."""
    path = scratch_path(spark, "index")
    catalog = B.catalog(spark, sf).withColumn("created_at", micros("created_at") / 1e6)
    entry = F.struct("name", "filename", "shape", "dtype", "created_at")
    documents = catalog.groupBy(F.floor(F.col("tensor_id") / 100).alias("part_no")).agg(
        F.map_from_entries(F.collect_list(F.struct(F.col("tensor_id").cast("string"), entry))).alias("matrices"),
        (F.max("tensor_id") + 1).alias("next_id"))
    documents.drop("part_no").write.json(path)
    return flat(catalogs.load_catalog(spark, path, multi_line=False))
