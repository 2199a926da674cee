"""Chunk, placement and parity operators over `documents`; shard operators over `supplier`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arrayflow.operators import layout as L
from arrayflow.plans import bindings as B
from arrayflow.plans.registry import query, rounded, wide
from arrayflow.session import scratch_path
from arrayflow.sources import containers

K = B.SHARDS - 1
# The shard whose loss the recovery queries repair.
DEAD = 1

CHUNKS = f"""
d AS (SELECT doc_id AS file_id, source, lang, n_chars, strlen(text) AS n_bytes, (strlen(text) + {B.CHUNK - 1}) // {B.CHUNK} AS n_chunks, hex(encode(text)) AS h FROM documents),
ch AS (SELECT file_id, n_bytes, n_chunks, i AS chunk_index, substr(h, i * {2 * B.CHUNK} + 1, {2 * B.CHUNK}) AS hex FROM (SELECT *, unnest(range(n_chunks)) AS i FROM d))"""
GROUPS = CHUNKS + f""",
slots AS (SELECT file_id, n_bytes, i AS chunk_index, i // {K} AS group_index, i % {K} AS slot, i >= n_chunks AS is_pad
  FROM (SELECT *, unnest(range((n_chunks + {K - 1}) // {K} * {K})) AS i FROM d)),
gr AS (SELECT slots.*, coalesce(hex, repeat('00', {B.CHUNK})) AS hex FROM slots LEFT JOIN ch USING (file_id, chunk_index))"""
PARITY = GROUPS + f""",
xr AS (SELECT file_id, group_index, bit_xor(unhex(rpad(hex, {2 * B.CHUNK}, '0'))::BIT) AS x FROM gr GROUP BY 1, 2),
first_len AS (SELECT file_id, group_index, length(hex) AS n FROM gr WHERE slot = 0),
par AS (SELECT file_id, group_index, substr(hex(x::BLOB), 1, n) AS hex FROM xr JOIN first_len USING (file_id, group_index))"""
SH = "sh AS (SELECT s_nationkey AS array_id, s_suppkey AS shard_id, 1000.0::DOUBLE AS capacity_gb, abs(s_acctbal) / 20 AS used_gb FROM supplier)"
SEG = """seg AS (SELECT doc_id AS file_id, row_number() OVER (ORDER BY doc_id) - 1 AS seq, (row_number() OVER (ORDER BY doc_id) - 1) % 3 AS path_no,
  n_chars AS length, n_chars / (1 + doc_id % 9) AS speed FROM documents)"""


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    return L.chunk_payload(B.payloads(spark, sf), B.CHUNK)


def groups(spark: SparkSession, sf: str) -> DataFrame:
    return L.parity_groups(chunks(spark, sf), B.SHARDS, B.CHUNK)


def digest(column: str):
    """MD5 of the upper-case hex of bytes: both engines can make it."""
    return F.md5(F.hex(column)).alias("digest")


def file_table(spark: SparkSession, sf: str) -> DataFrame:
    n_bytes = F.octet_length("payload")
    return B.payloads(spark, sf).select("file_id", "lang", n_bytes.alias("n_bytes"), F.ceil(n_bytes / B.CHUNK).cast("int").alias("n_chunks"))


def surviving(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Data chunks and parity chunks left after one shard of a parity array is gone."""
    grouped = groups(spark, sf)
    placed = L.place_parity(grouped, B.SHARDS).filter(F.col("shard_id") != DEAD)
    data = placed.filter(~F.col("is_parity") & ~F.col("is_pad")).select("file_id", "chunk_index")
    parity = placed.filter("is_parity").select("file_id", "group_index")
    return (chunks(spark, sf).join(data, ["file_id", "chunk_index"]), L.file_parity(B.payloads(spark, sf), B.SHARDS, B.CHUNK).join(parity, ["file_id", "group_index"]))


@query(f"WITH {CHUNKS} SELECT file_id, chunk_index, n_bytes, n_chunks, length(hex) // 2 AS n, md5(hex) AS digest FROM ch")
def chunk_payload(spark: SparkSession, sf: str) -> DataFrame:
    return wide(chunks(spark, sf).select("file_id", "chunk_index", "n_bytes", "n_chunks", F.octet_length("chunk").alias("n"), digest("chunk")))


@query(f"WITH {CHUNKS} SELECT file_id, chunk_index, chunk_index % 3 AS shard_id FROM ch")
def place_round_robin(spark: SparkSession, sf: str) -> DataFrame:
    return wide(L.place_round_robin(chunks(spark, sf), B.SHARDS).select("file_id", "chunk_index", "shard_id"))


@query("SELECT doc_id AS file_id, unnest([0, 1, 2]) AS shard_id FROM documents")
def place_mirror(spark: SparkSession, sf: str) -> DataFrame:
    return L.place_mirror(B.payloads(spark, sf).select("file_id"), B.SHARDS)


@query("""WITH r AS (SELECT doc_id, lang, unnest([0, 1, 2]) AS shard_id, n_chars FROM documents), o AS (SELECT *, NOT (shard_id = 1 OR (shard_id = 2 AND n_chars > 1000)) AS ok FROM r)
  SELECT doc_id AS file_id, count(*) AS n, count(*) FILTER (ok) AS n_ok,
  count(*) FILTER (ok) >= CASE WHEN any_value(lang) = 'en' THEN count(*) // 2 ELSE count(*) END AS success FROM o GROUP BY 1""")
def mirror_quorum(spark: SparkSession, sf: str) -> DataFrame:
    placed = L.place_mirror(B.payloads(spark, sf).select("file_id", "lang", "n_chars"), B.SHARDS)
    failed = (F.col("shard_id") == 1) | ((F.col("shard_id") == 2) & (F.col("n_chars") > 1000))
    layout = F.when(F.col("lang") == "en", "mirror").otherwise("stripe")
    return L.mirror_quorum(placed.select("file_id", layout.alias("layout"), (~failed).alias("ok")))


@query(f"WITH {GROUPS} SELECT file_id, chunk_index, group_index, slot, is_pad, md5(hex) AS digest FROM gr")
def parity_groups(spark: SparkSession, sf: str) -> DataFrame:
    return wide(groups(spark, sf).select("file_id", "chunk_index", "group_index", "slot", "is_pad", digest("chunk")))


@query(f"""WITH {GROUPS} SELECT file_id, group_index, false AS is_parity, chunk_index, (group_index * {K} + slot) % 3 AS shard_id FROM gr
  UNION ALL SELECT DISTINCT file_id, group_index, true, group_index * {K} + {K}, (group_index * {K} + {K}) % 3 FROM gr""")
def place_parity(spark: SparkSession, sf: str) -> DataFrame:
    return wide(L.place_parity(groups(spark, sf), B.SHARDS).drop("is_pad"))


@query(f"WITH {PARITY} SELECT file_id, group_index, length(hex) // 2 AS n, md5(hex) AS digest FROM par")
def xor_parity(spark: SparkSession, sf: str) -> DataFrame:
    return wide(L.xor_parity(groups(spark, sf)).select("file_id", "group_index", F.octet_length("parity").alias("n"), digest("parity")))


@query(f"WITH {PARITY} SELECT file_id, group_index, length(hex) // 2 AS n, md5(hex) AS digest FROM par")
def file_parity(spark: SparkSession, sf: str) -> DataFrame:
    parities = L.file_parity(B.payloads(spark, sf), B.SHARDS, B.CHUNK)
    return wide(parities.select("file_id", "group_index", F.octet_length("parity").alias("n"), digest("parity")))


@query("SELECT doc_id AS file_id, true AS complete, md5(text) AS digest FROM documents WHERE strlen(text) > 0")
def assemble(spark: SparkSession, sf: str) -> DataFrame:
    return L.assemble(chunks(spark, sf)).select("file_id", "complete", F.md5("payload").alias("digest"))


def replicas(spark: SparkSession, sf: str) -> DataFrame:
    """Mirrored documents; shard 0 cannot be read for long ones."""
    placed = L.place_mirror(B.payloads(spark, sf), B.SHARDS)
    return placed.withColumn("ok", ~((F.col("shard_id") == 0) & (F.col("n_chars") > 500)))


@query("SELECT doc_id AS file_id, md5(text) AS digest, CASE WHEN n_chars > 500 THEN 1 ELSE 0 END AS shard_id FROM documents")
def read_mirror(spark: SparkSession, sf: str) -> DataFrame:
    return L.read_mirror(replicas(spark, sf)).select("file_id", F.md5("payload").alias("digest"), "shard_id")


@query(f"WITH {CHUNKS} SELECT file_id, chunk_index FROM ch WHERE chunk_index % 3 = {DEAD}")
def missing_chunks(spark: SparkSession, sf: str) -> DataFrame:
    present = L.place_round_robin(chunks(spark, sf), B.SHARDS).filter(F.col("shard_id") != DEAD)
    return wide(L.missing_chunks(file_table(spark, sf), present))


@query(f"""WITH {GROUPS} SELECT file_id, group_index, chunk_index, length(hex) // 2 AS n, md5(hex) AS digest FROM gr
  WHERE NOT is_pad AND (group_index * {K} + slot) % 3 = {DEAD}""")
def rebuild_chunk(spark: SparkSession, sf: str) -> DataFrame:
    data, parity = surviving(spark, sf)
    rebuilt = L.rebuild_chunk(file_table(spark, sf), data, parity, B.SHARDS, B.CHUNK)
    return wide(rebuilt.select("file_id", "group_index", "chunk_index", F.octet_length("chunk").alias("n"), digest("chunk")))


@query(f"""WITH {CHUNKS} SELECT file_id, CASE d.lang WHEN 'en' THEN 1 WHEN 'fr' THEN 5 ELSE 0 END AS level,
  CASE WHEN d.lang IN ('en', 'fr') OR n_chunks < 2 THEN md5(text) ELSE '' END AS digest FROM d JOIN documents ON file_id = doc_id""")
def dispatch_read(spark: SparkSession, sf: str) -> DataFrame:
    """One shard is gone: mirrored and parity files read back whole, striped ones only if they had no chunk there."""
    level = F.when(F.col("lang") == "en", 1).when(F.col("lang") == "fr", 5).otherwise(0)
    files = file_table(spark, sf).withColumn("level", level)
    data, parity = surviving(spark, sf)
    parity_data = data.join(files.filter("level = 5").select("file_id"), "file_id", "left_semi")
    striped = L.place_round_robin(chunks(spark, sf), B.SHARDS).filter(F.col("shard_id") != DEAD).drop("shard_id")
    striped = striped.join(files.filter("level = 0").select("file_id"), "file_id", "left_semi")
    stored = parity_data.unionByName(striped)
    whole = L.dispatch_read(files, stored, replicas(spark, sf), parity, B.SHARDS, B.CHUNK)
    return whole.select("file_id", "level", F.coalesce(F.md5("payload"), F.lit("")).alias("digest"))


@query(f"""WITH {SH} SELECT array_id, coalesce(shard_id, -1) AS shard_id, round(sum(capacity_gb), 6) AS capacity_gb, round(sum(used_gb), 6) AS used_gb,
  round(sum(capacity_gb - used_gb), 6) AS available_gb, round(sum(used_gb) * 100 / sum(capacity_gb), 6) AS usage_percent FROM sh GROUP BY GROUPING SETS ((array_id, shard_id), (array_id))""")
def shard_usage(spark: SparkSession, sf: str) -> DataFrame:
    usage = L.shard_usage(B.shards(spark, sf), ["array_id"])
    return rounded(usage, "capacity_gb", "used_gb", "available_gb", "usage_percent", digits=6).fillna(-1, ["shard_id"])


@query(f"""WITH {SH} SELECT array_id, round(CASE array_id % 3 WHEN 1 THEN sum(capacity_gb) / 2 WHEN 2 THEN sum(capacity_gb) * (count(*) - 1) / count(*) ELSE sum(capacity_gb) END, 4) AS effective_gb
  FROM sh GROUP BY 1""")
def effective_capacity(spark: SparkSession, sf: str) -> DataFrame:
    level = F.element_at(F.array(F.lit(0), F.lit(1), F.lit(5)), (F.first("array_id") % 3 + 1).cast("int"))
    return rounded(L.effective_capacity(B.shards(spark, sf), level, ["array_id"]), "effective_gb", digits=4)


@query(f"""WITH {SH}, dm AS (SELECT c_custkey AS demand_id, c_nationkey AS array_id, abs(c_acctbal) / 10 AS size_gb FROM customer),
  fit AS (SELECT demand_id, shard_id, row_number() OVER (PARTITION BY demand_id ORDER BY capacity_gb - used_gb DESC, shard_id) AS rn FROM dm JOIN sh USING (array_id) WHERE capacity_gb - used_gb >= size_gb)
  SELECT dm.demand_id, coalesce(shard_id, -1) AS shard_id FROM dm LEFT JOIN (SELECT * FROM fit WHERE rn = 1) f USING (demand_id)""")
def best_shard(spark: SparkSession, sf: str) -> DataFrame:
    demands = B.table(spark, sf, "customer").select(F.col("c_custkey").alias("demand_id"), F.col("c_nationkey").alias("array_id"), (F.abs("c_acctbal") / 10).alias("size_gb"))
    return L.best_shard(B.shards(spark, sf), demands, ["array_id"]).select("demand_id", F.coalesce("shard_id", F.lit(-1)).alias("shard_id"))


@query(f"""WITH {SH}, u AS (SELECT array_id, used_gb * 100 / capacity_gb AS p FROM sh) SELECT array_id, round(avg(p), 6) AS avg_usage, round(max(p) - min(p), 6) AS spread, max(p) - min(p) > 20 AS rebalance FROM u GROUP BY 1""")
def usage_imbalance(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(L.usage_imbalance(B.shards(spark, sf), ["array_id"]), "avg_usage", "spread")


def segments(spark: SparkSession, sf: str) -> DataFrame:
    buffers = B.table(spark, sf, "documents").select(F.col("doc_id").alias("file_id"), F.col("n_chars").alias("length"))
    return L.segment_layout(buffers, B.SHARDS, ["file_id"]).withColumn("speed", F.col("length") / (F.col("file_id") % 9 + 1))


def paths(spark: SparkSession) -> DataFrame:
    """The output paths, one more than is written to."""
    return spark.range(B.SHARDS + 1).withColumnRenamed("id", "path_no")


@query(f"""WITH {SEG} SELECT file_id, seq, path_no, length, coalesce(sum(length) OVER (PARTITION BY path_no ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset" FROM seg""")
def segment_layout(spark: SparkSession, sf: str) -> DataFrame:
    return segments(spark, sf).drop("speed")


@query(f"""WITH {SEG}, r AS (SELECT * FROM seg QUALIFY row_number() OVER (PARTITION BY path_no ORDER BY seq DESC) <= 10), a AS (SELECT path_no, avg(speed) AS speed FROM r GROUP BY 1)
  SELECT path_no, round(speed, 6) AS speed FROM a ORDER BY a.speed DESC, path_no LIMIT 1""")
def load_aware_pick(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(L.load_aware_pick(segments(spark, sf), paths(spark)), "speed")


@query(f"WITH {SEG} SELECT p AS path_no, round(coalesce(avg(speed), 0), 6) AS speed FROM range(4) t(p) LEFT JOIN seg ON p = path_no GROUP BY 1")
def segment_speed(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(L.segment_speed(segments(spark, sf), paths(spark)), "speed")


@query("SELECT doc_id AS file_id, md5(text) AS digest FROM documents")
def reassemble_segments(spark: SparkSession, sf: str) -> DataFrame:
    """Documents appended 64 to a file, so that no file grows with the data, and cut out again."""
    docs = B.payloads(spark, sf).select("file_id", "payload", F.octet_length("payload").cast("bigint").alias("length"), F.floor(F.col("file_id") / 64).alias("path_no"))
    rows = F.sort_array(F.collect_list(F.struct("file_id", "length", "payload")))
    packed = docs.groupBy("path_no").agg(rows.alias("rows")).withColumn(
        "content", F.unhex(F.array_join(F.transform("rows", lambda r: F.hex(r["payload"])), "")))
    zero = F.lit(0).cast("bigint")
    offset = F.transform("rows", lambda r, i: F.struct(
        r["file_id"].alias("file_id"), r["length"].alias("length"),
        F.aggregate(F.slice("rows", F.lit(1), i), zero, lambda acc, x: acc + x["length"]).alias("offset")))
    locators = packed.select("path_no", F.explode(offset).alias("s")).select("path_no", "s.*")
    return L.reassemble_segments(locators, packed).select("file_id", F.md5("chunk").alias("digest"))


@query("""SELECT source, count(*) FILTER (n_chars <= 5000) AS total_writes, coalesce(sum(strlen(text)) FILTER (n_chars <= 5000), 0)::BIGINT AS total_bytes_written,
  count(*) FILTER (n_chars > 5000) AS failed_writes FROM documents GROUP BY 1""")
def write_totals(spark: SparkSession, sf: str) -> DataFrame:
    writes = B.payloads(spark, sf).select(F.col("name").alias("source"), F.octet_length("payload").alias("n_bytes"), (F.col("n_chars") <= 5000).alias("ok"))
    return L.write_totals(writes, ["source"])


@query("""SELECT count(*) FILTER (n_chars <= 5000) AS total_writes, coalesce(sum(strlen(text)) FILTER (n_chars <= 5000), 0)::BIGINT AS total_bytes_written,
  count(*) FILTER (n_chars > 5000) AS failed_writes, count(*) FILTER (n_chars <= 5000) AS rows_stored, coalesce(sum(strlen(text)) FILTER (n_chars <= 5000), 0)::BIGINT AS bytes_stored
  FROM documents""")
def write_observed(spark: SparkSession, sf: str) -> DataFrame:
    """Totals observed while the documents are written, next to what is then stored."""
    path = scratch_path(spark, "observed")
    writes = B.payloads(spark, sf).select("file_id", "payload", (F.col("n_chars") <= 5000).alias("ok"))
    totals = containers.write_observed(writes, path)
    stored = spark.read.parquet(path).agg(F.count(F.lit(1)).alias("rows_stored"), F.sum(F.octet_length("payload").cast("bigint")).alias("bytes_stored"))
    return stored.select(*[F.lit(n).cast("bigint").alias(c) for c, n in totals.items()], "rows_stored", "bytes_stored")
