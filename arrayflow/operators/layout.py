"""Chunk datasets: splitting, placement, parity, reassembly, shard usage and segment layout."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arrayflow.functions.expr import attach, ratio, zero_bytes
from arrayflow.functions.ordered import keep_last, number, running_sum
from arrayflow.operators.tensors import batched

# Chunk size, spread of usage percent that counts as imbalance, speeds averaged by the picker.
CHUNK_BYTES = 64 * 1024
IMBALANCE_POINTS = 20
RECENT_SPEEDS = 10


# Splitting and placement ---------------------------------------------------------------------------------------------

def chunk_payload(files: DataFrame, size: int = CHUNK_BYTES) -> DataFrame:
    """Payloads to chunks; the last one may be short, an empty payload has none."""
    n_bytes = F.octet_length("payload")
    sized = files.select("file_id", "payload", n_bytes.alias("n_bytes"), F.ceil(n_bytes / size).cast("int").alias("n_chunks"))
    parts = F.transform(F.sequence(F.lit(0), F.col("n_chunks") - 1), lambda i: F.substring(F.col("payload"), i * size + 1, F.lit(size)))
    return (sized.filter(F.col("n_chunks") > 0)
            .select("file_id", "n_bytes", "n_chunks", F.posexplode(parts).alias("chunk_index", "chunk")))


def place_round_robin(chunks: DataFrame, n: int) -> DataFrame:
    """Stripe chunks over ``n`` shards."""
    return chunks.withColumn("shard_id", F.col("chunk_index") % n)


def place_mirror(files: DataFrame, n: int) -> DataFrame:
    """Every file on every shard."""
    return files.withColumn("shard_id", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def mirror_quorum(results: DataFrame) -> DataFrame:
    """Write results per file: a mirror needs half its shards (rounded down), stripes need all."""
    ok = F.count_if("ok")
    needed = F.when(F.first("layout") == "mirror", F.floor(F.count(F.lit(1)) / 2)).otherwise(F.count(F.lit(1)))
    return results.groupBy("file_id").agg(F.count(F.lit(1)).alias("n"), ok.alias("n_ok"), (ok >= needed).alias("success"))


def parity_groups(chunks: DataFrame, n: int, size: int = CHUNK_BYTES) -> DataFrame:
    """Groups of ``n - 1`` chunks; the last chunk of a file brings the zero chunks that fill its group."""
    k = n - 1
    index = F.col("chunk_index")
    last = index == F.col("n_chunks") - 1
    end = F.when(last, index + (k - 1) - index % k).otherwise(index)
    spread = chunks.withColumn("_index", F.explode(F.sequence(index, end)))
    pad = F.col("_index") != index
    chunk = F.when(pad, zero_bytes(F.lit(size))).otherwise(F.col("chunk"))
    return spread.select("file_id", "n_bytes", F.col("_index").alias("chunk_index"),
                         F.floor(F.col("_index") / k).cast("int").alias("group_index"),
                         (F.col("_index") % k).cast("int").alias("slot"), pad.alias("is_pad"), chunk.alias("chunk"))


def place_parity(groups: DataFrame, n: int) -> DataFrame:
    """Shards of data chunks and of each group's parity chunk (announced by the group's first slot)."""
    k = n - 1
    base = F.col("group_index") * k
    own = F.struct(F.lit(False).alias("is_parity"), (base + F.col("slot")).alias("chunk_index"))
    parity = F.struct(F.lit(True).alias("is_parity"), (base + k).alias("chunk_index"))
    rows = groups.withColumn("_row", F.explode(F.when(F.col("slot") == 0, F.array(own, parity)).otherwise(F.array(own))))
    index, is_parity = F.col("_row.chunk_index"), F.col("_row.is_parity")
    return rows.select("file_id", "group_index", is_parity.alias("is_parity"), index.alias("chunk_index"),
                       (index % n).alias("shard_id"), (~is_parity & F.col("is_pad")).alias("is_pad"))


@F.pandas_udf(T.BinaryType())
def _xor(parts: pd.Series) -> pd.Series:
    """XOR of byte strings, shorter ones filled with zeros; as long as the first."""
    def one(chunks) -> bytes:
        chunks = list(chunks)
        out = np.frombuffer(chunks[0], dtype="u1").copy()
        for chunk in chunks[1:]:
            other = np.frombuffer(chunk, dtype="u1")[:len(out)]
            out[:len(other)] ^= other
        return out.tobytes()
    return parts.map(one)


def _in_order(*order: str) -> Column:
    """Chunks of one group sorted by ``order``."""
    rows = F.sort_array(F.collect_list(F.struct(*order, "chunk")))
    return F.transform(rows, lambda r: r["chunk"])


def xor_parity(groups: DataFrame) -> DataFrame:
    """Parity chunk of every group; a group never holds more than ``n - 1`` chunks."""
    return groups.groupBy("file_id", "group_index").agg(_in_order("slot").alias("_parts")).select(
        "file_id", "group_index", _xor("_parts").alias("parity"))


def file_parity(files: DataFrame, n: int, size: int = CHUNK_BYTES) -> DataFrame:
    """Parity chunks of whole payloads, as :func:`xor_parity` over their groups, but without moving any chunk."""
    k = n - 1

    def parities(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for file_id, payload in zip(batch.column("file_id").to_pylist(), batch.column("payload").to_pylist()):
                data = np.frombuffer(payload or b"", dtype="u1")
                for no, begin in enumerate(range(0, len(data), k * size)):
                    group = data[begin:begin + k * size]
                    parity = group[:size].copy()
                    for lo in range(size, len(group), size):
                        part = group[lo:lo + size]
                        parity[:len(part)] ^= part
                    yield file_id, no, parity.tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return batched(parities(batches), {"file_id": pa.int64(), "group_index": pa.int32(), "parity": pa.binary()})
    return files.select("file_id", "payload").mapInArrow(run, "file_id bigint, group_index int, parity binary")


# Reading back --------------------------------------------------------------------------------------------------------

def assemble(chunks: DataFrame) -> DataFrame:
    """Chunks back to payloads; a file with missing chunks has ``complete`` false and no payload."""
    grouped = chunks.groupBy("file_id").agg(
        F.max("n_chunks").alias("n_chunks"), F.count("chunk").alias("_n"),
        F.expr("listagg(chunk) WITHIN GROUP (ORDER BY chunk_index)").alias("_joined"))
    complete = F.col("_n") == F.col("n_chunks")
    return grouped.select("file_id", complete.alias("complete"), F.when(complete, F.col("_joined")).alias("payload"))


def read_mirror(replicas: DataFrame) -> DataFrame:
    """The first readable replica of each file in shard order; none leaves a null payload.

    The choice is made on ids alone; only the chosen replicas' payloads move.
    """
    chosen = replicas.groupBy("file_id").agg(F.min(F.when(F.col("ok"), F.col("shard_id"))).alias("shard_id"))
    return chosen.join(replicas.select("file_id", "shard_id", "payload"), ["file_id", "shard_id"], "left")


def missing_chunks(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks the files (file_id, n_chunks) should have but do not."""
    index = F.explode(F.sequence(F.lit(0), F.col("n_chunks") - 1)).alias("chunk_index")
    expected = files.filter(F.col("n_chunks") > 0).select("file_id", index)
    return expected.join(chunks.select("file_id", "chunk_index"), ["file_id", "chunk_index"], "left_anti")


def rebuild_chunk(files: DataFrame, chunks: DataFrame, parity: DataFrame, n: int, size: int = CHUNK_BYTES) -> DataFrame:
    """Restore lost chunks where a group lost exactly one: XOR of its survivors and its parity.

    Pads are zero and need not be stored. The result is cut to the length the lost chunk had.
    """
    k = n - 1
    group = F.floor(F.col("chunk_index") / k).cast("int").alias("group_index")
    lost = (missing_chunks(files, chunks).groupBy("file_id", group)
            .agg(F.count(F.lit(1)).alias("_n"), F.min("chunk_index").alias("lost_index")).filter(F.col("_n") == 1).drop("_n"))
    # The parity chunk leads: it is as long as the longest chunk of its group.
    members = (chunks.select("file_id", group, F.lit(1).alias("_kind"), "chunk")
               .unionByName(parity.select("file_id", "group_index", F.lit(0).alias("_kind"), F.col("parity").alias("chunk"))))
    affected = members.join(lost, ["file_id", "group_index"])
    xored = affected.groupBy("file_id", "group_index", "lost_index").agg(
        _in_order("_kind").alias("_parts"), F.count_if(F.col("_kind") == 0).alias("_parities")).filter(F.col("_parities") == 1)
    whole = xored.select("file_id", "group_index", "lost_index", _xor("_parts").alias("chunk"))
    length = F.least(F.lit(size), F.col("n_bytes") - F.col("lost_index") * size).cast("int")
    return whole.join(files.select("file_id", "n_bytes", "n_chunks"), "file_id").select(
        "file_id", "group_index", F.col("lost_index").alias("chunk_index"), "n_bytes", "n_chunks",
        F.substring("chunk", F.lit(1), length).alias("chunk"))


def dispatch_read(files: DataFrame, chunks: DataFrame, replicas: DataFrame, parity: DataFrame, n: int, size: int = CHUNK_BYTES) -> DataFrame:
    """Payload of every file by its level: 1 from a mirror, 5 with lost chunks rebuilt, anything else from its stripes."""
    parity_files = files.filter(F.col("level") == 5)
    columns = ["file_id", "n_chunks", "chunk_index", "chunk"]
    rebuilt = rebuild_chunk(parity_files, chunks.join(parity_files.select("file_id"), "file_id", "left_semi"), parity, n, size)
    striped = files.filter(~F.col("level").isin(1)).select("file_id")
    stored = chunks.join(striped, "file_id", "left_semi").select(*columns)
    from_chunks = assemble(stored.unionByName(rebuilt.select(*columns))).select("file_id", "payload")
    mirrored = files.filter(F.col("level") == 1).select("file_id")
    from_mirror = read_mirror(replicas.join(mirrored, "file_id", "left_semi")).select("file_id", "payload")
    found = from_chunks.unionByName(from_mirror)
    return files.select("file_id", "level").join(found, "file_id", "left")


# Shards --------------------------------------------------------------------------------------------------------------


def shard_usage(shards: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Free space and usage percent of every shard and, with a null shard, of every group."""
    available = F.col("capacity_gb") - F.col("used_gb")
    rows = shards.withColumn("available_gb", available)
    sums = [F.sum(c).alias(c) for c in ("capacity_gb", "used_gb", "available_gb")]
    total = rows.groupBy(*by).agg(*sums).withColumn("shard_id", F.lit(None).cast("bigint"))
    columns = [*by, "shard_id", "capacity_gb", "used_gb", "available_gb"]
    return rows.select(*columns).unionByName(total.select(*columns)).withColumn(
        "usage_percent", ratio(F.col("used_gb") * 100, "capacity_gb"))


def effective_capacity(shards: DataFrame, level: Column | int, by: Sequence[str] = ()) -> DataFrame:
    """Usable capacity of a group of shards at a level."""
    level = level if isinstance(level, Column) else F.lit(level)
    total, n = F.sum("capacity_gb"), F.count(F.lit(1))
    usable = F.when(level == 1, total / 2).when(level == 5, total * (n - 1) / n).otherwise(total)
    return shards.groupBy(*by).agg(F.coalesce(usable, F.lit(0.0)).alias("effective_gb"))


def best_shard(shards: DataFrame, demands: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """For each demand the fitting shard with most space. The emptiest shard fits whenever any does, so one row per group decides."""
    space = F.col("capacity_gb") - F.col("used_gb")
    rank = F.struct(space.alias("space"), (-F.col("shard_id")).alias("low_id_first"))
    top = shards.groupBy(*by).agg(F.max_by("shard_id", rank).alias("_shard"), F.max(space).alias("_space"))
    chosen = F.when(F.col("_space") >= F.col("size_gb"), F.col("_shard"))
    return attach(demands, top, by).withColumn("shard_id", chosen).drop("_shard", "_space")


def usage_imbalance(shards: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean usage percent, and whether the spread calls for rebalancing."""
    usage = ratio(F.col("used_gb") * 100, "capacity_gb")
    spread = F.max(usage) - F.min(usage)
    return shards.groupBy(*by).agg(F.avg(usage).alias("avg_usage"), spread.alias("spread"), (spread > IMBALANCE_POINTS).alias("rebalance"))


# Segments ------------------------------------------------------------------------------------------------------------

def segment_layout(buffers: DataFrame, n: int, order: Sequence[str]) -> DataFrame:
    """Append buffers round robin to ``n`` files: (file, offset, length) of each buffer."""
    numbered = number(buffers, [], order, "seq").withColumn("seq", F.col("seq") - 1)
    pathed = numbered.withColumn("path_no", F.col("seq") % n)
    placed = running_sum(pathed, ["path_no"], ["seq"], {"_end": "length"})
    return placed.withColumn("offset", F.col("_end") - F.col("length")).drop("_end")


def load_aware_pick(segments: DataFrame, paths: DataFrame) -> DataFrame:
    """The path with the highest mean of its last ten speeds; the first path (by path_no) where none is positive."""
    recent = keep_last(segments, ["path_no"], ["seq"], RECENT_SPEEDS).groupBy("path_no").agg(F.avg("speed").alias("speed"))
    known = paths.select("path_no").join(recent, "path_no", "left")
    speed = F.greatest(F.lit(0.0), F.coalesce("speed", F.lit(0.0)))
    return known.agg(F.max_by("path_no", F.struct(speed.alias("speed"), (-F.col("path_no")).alias("first"))).alias("path_no"),
                     F.max(speed).alias("speed"))


def segment_speed(segments: DataFrame, paths: DataFrame) -> DataFrame:
    """Mean write speed per path; 0 without writes."""
    speeds = segments.groupBy("path_no").agg(F.avg("speed").alias("speed"))
    return paths.select("path_no").join(speeds, "path_no", "left").fillna(0.0, ["speed"])


def reassemble_segments(segments: DataFrame, files: DataFrame) -> DataFrame:
    """Cut buffers back out of file contents by their locators."""
    cut = F.substring(F.col("content"), (F.col("offset") + 1).cast("int"), F.col("length").cast("int"))
    return segments.join(files.select("path_no", "content"), "path_no").withColumn("chunk", cut).drop("content")


def write_totals(writes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Successful writes, their bytes, and failures."""
    return writes.groupBy(*by).agg(
        F.count_if("ok").alias("total_writes"),
        F.coalesce(F.sum(F.when(F.col("ok"), F.col("n_bytes"))), F.lit(0)).alias("total_bytes_written"),
        F.count_if(~F.col("ok")).alias("failed_writes"))
