"""Tensor compute and codecs over `embeddings`, `documents`, `part` and `events`."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arrayflow.operators import tensors as T
from arrayflow.operators.layout import assemble
from arrayflow.plans import bindings as B
from arrayflow.plans.registry import query, rounded
from arrayflow.session import scratch_path
from arrayflow.sources import containers

CELLS = "cells AS (SELECT vec_id AS tensor_id, unnest(range(len(embedding))) AS pos, unnest(embedding)::DOUBLE AS value FROM embeddings)"
DOCS = "SELECT doc_id AS tensor_id, md5(text) AS digest FROM documents"
SIDE = 8


def document_tensors(spark: SparkSession, sf: str) -> DataFrame:
    return B.payloads(spark, sf).select(F.col("file_id").alias("tensor_id"), "name", "payload")


def embedding_payloads(spark: SparkSession, sf: str) -> DataFrame:
    return T.encode_tensors(B.embedding_tensors(spark, sf), "embedding")


@query(f"WITH {CELLS} SELECT tensor_id, pos, value FROM cells")
def decode_cells(spark: SparkSession, sf: str) -> DataFrame:
    return T.decode_cells(embedding_payloads(spark, sf))


def parsed_frames(spark: SparkSession, sf: str) -> DataFrame:
    """Every tensor framed and split again; one frame in seven is cut short, has an unreadable header, or lost a byte."""
    framed = containers.frame_containers(embedding_payloads(spark, sf), ["shape", "dtype"])
    key, content = F.col("tensor_id"), F.col("content")
    spoiled = (F.when(key % 21 == 3, F.substring(content, 1, 3)).when(key % 21 == 10, F.concat(F.unhex(F.lit("0000000000000004")), F.encode(F.lit("!!!!"), "UTF-8"), content))
               .when(key % 21 == 17, F.substring(content, F.lit(1), F.octet_length(content) - 1)).otherwise(content))
    return containers.parse_containers(framed.select(key, spoiled.alias("content")), containers.RAW_HEADER)


@query(f"WITH {CELLS} SELECT tensor_id, pos, value FROM cells WHERE tensor_id % 7 <> 3")
def read_containers(spark: SparkSession, sf: str) -> DataFrame:
    return T.decode_cells(parsed_frames(spark, sf).filter("ok").select("tensor_id", "header.dtype", "payload"))


@query("""SELECT vec_id AS tensor_id, CASE vec_id % 21 WHEN 3 THEN 'short file' WHEN 10 THEN 'unreadable header' ELSE 'broken element' END AS reason
  FROM embeddings WHERE vec_id % 7 = 3""")
def rejected_containers(spark: SparkSession, sf: str) -> DataFrame:
    parsed = parsed_frames(spark, sf)
    return parsed.filter("NOT ok").select("tensor_id", "reason").union(T.undecodable(parsed.filter("ok").select("tensor_id", "header.dtype", "header.shape", "payload")))


def customer_files(spark: SparkSession, sf: str) -> str:
    """One framed file per fifty customers: their names in order, ended by the line end that the writer adds."""
    customers = B.table(spark, sf, "customer").groupBy(F.expr("c_custkey div 50").alias("file")).agg(F.sort_array(F.collect_list(F.struct("c_custkey", "c_name"))).alias("rows"))
    tensors = customers.select("file", F.array(F.size("rows").cast("bigint")).alias("shape"), F.lit("str").alias("dtype"),
                               F.encode(F.array_join(F.col("rows.c_name"), ","), "UTF-8").alias("payload"))
    path = scratch_path(spark, "framed")
    framed = containers.frame_containers(tensors, ["shape", "dtype"])
    framed.select("file", F.col("content").cast("string")).write.option("compression", "none").partitionBy("file").text(path)
    return path


NAMES = """names AS (SELECT c_custkey // 50 AS file, count(*) AS n, string_agg(c_name, ',' ORDER BY c_custkey) || chr(10) AS payload FROM customer GROUP BY 1)"""
FILE_NO = r"/file=(\d+)/"


@query(f"WITH {NAMES} SELECT file::BIGINT AS file, n, 'str' AS dtype, strlen(payload)::BIGINT AS payload_bytes, true AS ok FROM names")
def read_headers(spark: SparkSession, sf: str) -> DataFrame:
    """Shapes and payload sizes of files of which only the headers are read."""
    read = containers.read_headers(spark, customer_files(spark, sf))
    return read.select(F.regexp_extract("path", FILE_NO, 1).cast("bigint").alias("file"), F.col("header.shape")[0].alias("n"), F.col("header.dtype").alias("dtype"), "payload_bytes", "ok")


@query(f"WITH {NAMES} SELECT file::BIGINT AS file, ceil(strlen(payload) / 256)::BIGINT AS n_ranges, true AS complete, md5(payload) AS digest FROM names")
def read_ranges(spark: SparkSession, sf: str) -> DataFrame:
    """Payloads read in ranges of 256 bytes and put together again."""
    ranges = containers.payload_ranges(containers.read_headers(spark, customer_files(spark, sf)), 256)
    chunks = containers.read_ranges(ranges)
    counts = ranges.filter("chunk_index = 0").select("file_id", F.col("n_chunks").alias("n_ranges"))
    return assemble(chunks).join(counts, "file_id").select(F.regexp_extract("file_id", FILE_NO, 1).cast("bigint").alias("file"), "n_ranges", "complete", F.md5("payload").alias("digest"))


@query(DOCS)
def write_tensors(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "tensors")
    containers.write_tensors(document_tensors(spark, sf), path)
    return spark.read.parquet(path).select("tensor_id", F.md5("payload").alias("digest"))


@query("SELECT sum(strlen(l_returnflag) + 1)::BIGINT AS total_bytes FROM lineitem")
def dataset_size(spark: SparkSession, sf: str) -> DataFrame:
    """One text column, written as uncompressed lines."""
    return containers.dataset_size(spark, written_lines(spark, sf, "lineitem", "l_returnflag")).select("total_bytes")


def written_lines(spark: SparkSession, sf: str, table: str, column: str) -> str:
    path = scratch_path(spark, "lines")
    B.table(spark, sf, table).select(column).write.option("compression", "none").text(path)
    return path


@query("""WITH s AS (SELECT p_partkey AS tensor_id, p_size % 8 + 1 AS n, ['random','identity','zeros'][p_partkey % 3 + 1] AS kind FROM part),
  c AS (SELECT *, unnest(range(n * n)) AS pos FROM s)
  SELECT tensor_id, kind, pos, CASE kind WHEN 'identity' THEN CASE WHEN pos // n = pos % n THEN 1.0::DOUBLE ELSE 0 END WHEN 'zeros' THEN 0 ELSE -1 END AS value, true AS in_range FROM c""")
def generate_tensors(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.element_at(F.array(*[F.lit(k) for k in ("random", "identity", "zeros")]), (F.col("p_partkey") % 3 + 1).cast("int"))
    specs = B.table(spark, sf, "part").select(F.col("p_partkey").alias("tensor_id"), kind.alias("kind"), (F.col("p_size") % 8 + 1).alias("size"))
    value = F.col("value")
    return T.generate_tensors(specs, seed=7).select(
        "tensor_id", "kind", "pos", F.when(F.col("kind") == "random", -1.0).otherwise(value).alias("value"), ((value >= 0) & (value <= 1)).alias("in_range"))


def _grid(spark: SparkSession, sf: str) -> DataFrame:
    return T.task_grid(B.table(spark, sf, "part").select(F.col("p_partkey").alias("size_order"), F.col("p_size").alias("size")))


GRID = """grid AS (SELECT row_number() OVER (ORDER BY p_partkey, k) - 1 AS task_no, p_size AS size, ['random','identity','zeros'][k] AS kind
  FROM (SELECT p_partkey, p_size, unnest([1, 2, 3]) AS k FROM part))"""


@query(f"WITH {GRID} SELECT task_no, 'task_' || task_no AS task_id, size, kind FROM grid")
def task_grid(spark: SparkSession, sf: str) -> DataFrame:
    return _grid(spark, sf)


@query(f"""WITH {GRID} SELECT event_id AS value, event_id % (SELECT count(*) FROM grid) AS task_no, 'task_' || event_id AS task_id, size, kind
  FROM events JOIN grid ON event_id % (SELECT count(*) FROM grid) = task_no""")
def task_stream(spark: SparkSession, sf: str) -> DataFrame:
    return T.task_stream(B.table(spark, sf, "events").select(F.col("event_id").alias("value")), _grid(spark, sf))


# Every other tensor lies in one axis, the others in rows of SIDE.
SHAPES = "CASE WHEN tensor_id % 2 = 0 THEN array(n) ELSE array(n div {side}, {side}L) END"


@query(f"""WITH {CELLS}, n AS (SELECT vec_id AS tensor_id, len(embedding) AS n FROM embeddings), p AS (SELECT cells.*, n, pos // {SIDE} AS i, pos % {SIDE} AS j FROM cells JOIN n USING (tensor_id))
  SELECT tensor_id, pos // 2 AS pos, value FROM p WHERE tensor_id % 2 = 0 AND pos < 4 AND pos % 2 = 0
  UNION ALL SELECT tensor_id, i // 2 * {SIDE} + j, value FROM p WHERE tensor_id % 2 = 1 AND i < 4 AND i % 2 = 0""")
def slice_tensor(spark: SparkSession, sf: str) -> DataFrame:
    """A slice of the first axis of every tensor, by its own shape; the stored payloads give the same cells."""
    shapes = B.embedding_tensors(spark, sf).withColumn("n", F.size("embedding").cast("bigint")).select("tensor_id", F.expr(SHAPES.format(side=SIDE)).alias("shape"))
    return T.slice_tensor(B.cells(spark, sf), shapes, [slice(0, 4, 2)])


@query(f"""WITH {CELLS}, n AS (SELECT vec_id AS tensor_id, len(embedding) AS n FROM embeddings), p AS (SELECT cells.*, n, pos // {SIDE} AS i, pos % {SIDE} AS j FROM cells JOIN n USING (tensor_id))
  SELECT tensor_id, pos // 2 AS pos, value FROM p WHERE tensor_id % 2 = 0 AND pos < 4 AND pos % 2 = 0
  UNION ALL SELECT tensor_id, i // 2 * {SIDE} + j, value FROM p WHERE tensor_id % 2 = 1 AND i < 4 AND i % 2 = 0""")
def slice_stored(spark: SparkSession, sf: str) -> DataFrame:
    stored = embedding_payloads(spark, sf).drop("shape")
    shapes = B.embedding_tensors(spark, sf).withColumn("n", F.size("embedding").cast("bigint")).select("tensor_id", F.expr(SHAPES.format(side=SIDE)).alias("shape"))
    return T.slice_stored(stored.join(shapes, "tensor_id"), [slice(0, 4, 2)])


@query(f"WITH {CELLS} SELECT 'transformed_' || tensor_id AS name, tensor_id, pos, round((value * 2 + 1) * (value * 2 + 1), 9) AS value FROM cells")
def apply_transforms(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(T.apply_transforms(B.cells(spark, sf), [lambda v: v * 2 + 1, lambda v: v * v]), "value", digits=9)


@query(f"""WITH {CELLS}, n AS (SELECT tensor_id, len(embedding) AS n FROM (SELECT vec_id AS tensor_id, embedding FROM embeddings))
  SELECT tensor_id, n - 1 - pos AS pos, value FROM cells JOIN n USING (tensor_id)""")
def apply_tensor_udf(spark: SparkSession, sf: str) -> DataFrame:
    return T.decode_cells(T.apply_tensor_udf(embedding_payloads(spark, sf), lambda a: np.flip(a, axis=-1).T))


@query("""SELECT p_partkey AS tensor_id, p_size * (p_partkey % 10 + 1) AS n_elements, CASE WHEN p_size % 2 = 0 THEN 4 ELSE 8 END AS item_size,
  p_size * (p_partkey % 10 + 1) * CASE WHEN p_size % 2 = 0 THEN 4 ELSE 8 END AS n_bytes FROM part""")
def tensor_footprint(spark: SparkSession, sf: str) -> DataFrame:
    return T.tensor_footprint(B.catalog(spark, sf))


RUNS = """runs AS (SELECT user_id, run, any_value(event_type) AS event_type, count(*) AS length FROM (
  SELECT *, sum(CASE WHEN prev = event_type THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS run FROM (
  SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events)) GROUP BY 1, 2)"""


def _runs(spark: SparkSession, sf: str) -> DataFrame:
    return T.rle_encode(B.events(spark, sf), ["user_id"], ["ts", "event_id"], "event_type")


@query(f"WITH {RUNS} SELECT user_id, run, event_type, length FROM runs")
def rle_encode(spark: SparkSession, sf: str) -> DataFrame:
    return _runs(spark, sf)


@query("SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, event_type FROM events")
def rle_decode(spark: SparkSession, sf: str) -> DataFrame:
    return T.rle_decode(_runs(spark, sf), ["user_id"], "event_type")


@query("SELECT doc_id AS tensor_id, source AS name, strlen(text) AS original_size, true AS smaller FROM documents")
def compress_tensors(spark: SparkSession, sf: str) -> DataFrame:
    """Sizes of the compressed payloads; a frame never exceeds its input by more than a few bytes."""
    packed = T.compress_tensors(document_tensors(spark, sf))
    smaller = F.col("compressed_size").between(1, F.col("original_size") + 64)
    return packed.select("tensor_id", "name", F.col("original_size").cast("bigint"), smaller.alias("smaller"))


@query(DOCS)
def decompress_tensors(spark: SparkSession, sf: str) -> DataFrame:
    packed = T.compress_tensors(document_tensors(spark, sf))
    return T.decompress_tensors(packed).select("tensor_id", F.md5("payload").alias("digest"))


@query("""SELECT source, count(*) AS n, sum(strlen(text))::BIGINT AS original_size, sum(n_chars)::BIGINT AS compressed_size,
  round(avg(n_chars / strlen(text)), 6) AS avg_size_ratio, round(sum(n_chars) / sum(strlen(text)), 6) AS size_ratio, round(sum(strlen(text)) / sum(n_chars), 6) AS compression_factor
  FROM documents GROUP BY 1""")
def compression_report(spark: SparkSession, sf: str) -> DataFrame:
    """UTF-8 bytes against characters, so that both sizes come from the table."""
    sizes = B.payloads(spark, sf).select(F.col("name").alias("source"), F.octet_length("payload").alias("original_size"), F.col("n_chars").alias("compressed_size"))
    return rounded(T.compression_report(sizes, ["source"]), "avg_size_ratio", "size_ratio", "compression_factor")


@query("""WITH w AS (SELECT doc_id, source, strlen(text) AS n, hex(encode(text)) AS h FROM documents),
  x AS (SELECT doc_id, source, i, rpad(substr(h, i * 8 + 1, 8), 8, '0') AS word FROM (SELECT *, unnest(range((n + 3) // 4)) AS i FROM w)),
  r AS (SELECT doc_id, count(*) FILTER (prev IS DISTINCT FROM word) * 8 AS size FROM (SELECT *, lag(word) OVER (PARTITION BY doc_id ORDER BY i) AS prev FROM x) GROUP BY 1)
  SELECT source, sum(n)::BIGINT AS original_size, sum(size)::BIGINT AS rle_size, round(sum(n) / sum(size), 6) AS rle_factor, true AS zstd_wins
  FROM w JOIN r USING (doc_id) GROUP BY 1""")
def compare_codecs(spark: SparkSession, sf: str) -> DataFrame:
    sizes = T.compare_codecs(document_tensors(spark, sf).withColumnRenamed("name", "source"), ["source"])
    return sizes.select("source", "original_size", "rle_size", F.round("rle_factor", 6).alias("rle_factor"), (F.col("zstd_factor") > F.col("rle_factor")).alias("zstd_wins"))


@query("""SELECT source, round(sum(strlen(text)) / 1048576, 6) AS total_mb, CASE WHEN sum(strlen(text)) / 1048576 > 0.12 THEN 'A' ELSE 'B' END AS path
  FROM documents GROUP BY 1""")
def route_by_size(spark: SparkSession, sf: str) -> DataFrame:
    sizes = B.payloads(spark, sf).select(F.col("name").alias("source"), F.octet_length("payload").alias("n_bytes"))
    return rounded(T.route_by_size(sizes, ["source"], 0.12), "total_mb")


@query("SELECT doc_id AS tensor_id, substr(md5(text), 1, 8) || '_' || substr(md5(source), 1, 8) AS content_id FROM documents")
def content_id(spark: SparkSession, sf: str) -> DataFrame:
    return T.content_id(document_tensors(spark, sf)).select("tensor_id", "content_id")

