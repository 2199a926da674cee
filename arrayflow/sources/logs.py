"""Binary write-ahead logs, JSON activity exports and checkpoint tables."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arrayflow.functions.ordered import number
from arrayflow.operators.activity import recent_intervals

# Big-endian op, time, offset, length, meta length; then meta; then MD5.
WAL_HEADER = np.dtype([("op", "u1"), ("ts", ">f8"), ("offset", ">i8"), ("length", ">i8"), ("meta", ">u4")])
DIGEST_BYTES = 16
#: Entries and bytes that are taken apart at once.
WAL_ROWS, WAL_BYTES = 10_000, 1 << 25
#: Intervals in one object of an export.
EXPORT_PIECE = 10_000
WAL_SCHEMA = ("path string, seq bigint, op tinyint, ts double, offset bigint, length bigint, meta string, "
              "header binary, checksum binary, checksum_ok boolean, bytes_left bigint")


def _spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places of all bytes of the given ranges, in order."""
    ends = np.cumsum(lengths)
    return np.arange(lengths.sum()) + np.repeat(starts - (ends - lengths), lengths)


def _block(starts: np.ndarray, width: int) -> np.ndarray:
    return starts[:, None] + np.arange(width)


def _digests(data: bytes | np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """MD5 of every range, one per row."""
    view, md5 = memoryview(data), hashlib.md5
    joined = b"".join([md5(view[a:b]).digest() for a, b in zip(starts.tolist(), stops.tolist())])
    return np.frombuffer(joined, np.uint8).reshape(-1, DIGEST_BYTES)


def _binary(data: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.Array.from_buffers(kind, len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def _texts(data: np.ndarray, lengths: np.ndarray) -> pa.Array:
    if not (data & 0x80).any():
        return _binary(data, lengths, pa.string())
    return pa.array([b.decode("utf-8", "replace") for b in _binary(data, lengths, pa.binary()).to_pylist()], pa.string())


def parse_wal(files: DataFrame) -> DataFrame:
    """Log files (path, content) to entries in file order.

    A corrupt entry is kept with ``checksum_ok`` false. Reading stops where an entry would run past the end of its file;
    ``bytes_left`` of the last entry tells how much was not read. One file is read by one task: only the lengths are followed
    one by one, the entries of many files are then taken apart together.
    """
    size = WAL_HEADER.itemsize
    meta_at = WAL_HEADER.fields["meta"][1]

    def pieces(path: str, content: bytes) -> Iterator[tuple]:
        """Runs of whole entries: path, place of the first, bytes, where each ends, length of the file."""
        at, begin, seq, end, stops = 0, 0, 0, len(content), []
        while at + size <= end:
            stop = at + size + DIGEST_BYTES + int.from_bytes(content[at + meta_at:at + size])
            if stop > end:
                break
            stops.append(stop)
            at = stop
            if len(stops) >= WAL_ROWS or at - begin >= WAL_BYTES:
                yield path, seq, content[begin:at], begin, stops, end
                begin, seq, stops = at, seq + len(stops), []
        if stops:
            yield path, seq, content[begin:at], begin, stops, end

    def entries(held: list[tuple]) -> pa.RecordBatch:
        data = b"".join(p[2] for p in held)
        raw, counts = np.frombuffer(data, np.uint8), np.array([len(p[4]) for p in held])
        sizes, begins = np.array([len(p[2]) for p in held]), np.array([p[3] for p in held])
        places = np.array([stop for p in held for stop in p[4]])
        stops = places + np.repeat(np.cumsum(sizes) - sizes - begins, counts)
        lengths = np.diff(stops, prepend=0)
        starts, sums = stops - lengths, stops - DIGEST_BYTES
        header = raw[_block(starts, size)]
        fields, checksum = header.view(WAL_HEADER)[:, 0], raw[_block(sums, DIGEST_BYTES)]
        meta_lengths = lengths - size - DIGEST_BYTES
        first = np.repeat([p[1] for p in held] - (np.cumsum(counts) - counts), counts)
        left = np.repeat([p[5] for p in held], counts) - places
        n = len(lengths)
        # Spark tinyint is signed; unknown codes above 127 only occur in corrupt entries.
        return pa.record_batch({
            "path": pa.array([p[0] for p in held], pa.string()).take(pa.array(np.repeat(np.arange(len(held)), counts))),
            "seq": pa.array(np.arange(n) + first, pa.int64()), "op": pa.array(fields["op"].copy().view(np.int8)),
            "ts": pa.array(fields["ts"].astype(np.float64)), "offset": pa.array(fields["offset"].astype(np.int64)),
            "length": pa.array(fields["length"].astype(np.int64)), "meta": _texts(raw[_spread(starts + size, meta_lengths)], meta_lengths),
            "header": _binary(header, np.full(n, size), pa.binary()), "checksum": _binary(checksum, np.full(n, DIGEST_BYTES), pa.binary()),
            "checksum_ok": pa.array((_digests(data, starts, sums) == checksum).all(axis=1)), "bytes_left": pa.array(left, pa.int64())})

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, size_held = [], 0, 0
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                for piece in pieces(path, content):
                    held.append(piece)
                    rows, size_held = rows + len(piece[4]), size_held + len(piece[2])
                    if rows >= WAL_ROWS or size_held >= WAL_BYTES:
                        yield entries(held)
                        held, rows, size_held = [], 0, 0
        if held:
            yield entries(held)
    return files.select("path", "content").mapInArrow(parse, WAL_SCHEMA)


def wal_files(entries: DataFrame) -> DataFrame:
    """Entries (path, seq, op, ts, offset, length, meta, spoiled) to one log content per path, for files of bounded length."""
    fields = ("seq", "op", "ts", "offset", "length", "meta", "spoiled")
    placed = entries.select("path", *fields).repartition("path").sortWithinPartitions("path", *fields)

    def encoded(batch: pa.RecordBatch) -> tuple[memoryview, np.ndarray]:
        """All entries of a batch in one text, and the length of each."""
        meta, size = batch.column("meta").cast(pa.binary()), WAL_HEADER.itemsize
        if meta.null_count:
            raise ValueError("an entry has no meta")
        at = np.frombuffer(meta.buffers()[1], np.int32)[meta.offset:meta.offset + len(meta) + 1].astype(np.int64)
        texts, meta_lengths = np.frombuffer(meta.buffers()[2] or b"", np.uint8)[at[0]:at[-1]], np.diff(at)
        header = np.empty(batch.num_rows, WAL_HEADER)
        for name in ("op", "ts", "offset", "length"):
            header[name] = batch.column(name).to_numpy(zero_copy_only=False)
        header["meta"] = meta_lengths
        lengths = meta_lengths + size + DIGEST_BYTES
        stops = np.cumsum(lengths)
        starts, sums = stops - lengths, stops - DIGEST_BYTES
        out = np.empty(stops[-1], np.uint8)
        out[_block(starts, size)] = header.view(np.uint8).reshape(-1, size)
        out[_spread(starts + size, meta_lengths)] = texts
        digests, spoiled = _digests(out, starts, sums), pc.fill_null(batch.column("spoiled"), False).to_numpy(zero_copy_only=False)
        out[_block(sums, DIGEST_BYTES)] = np.where(spoiled[:, None], digests[:, ::-1], digests)
        return memoryview(out), stops

    def made(files: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch({"path": pa.array([f[0] for f in files], pa.string()), "content": pa.array([f[1] for f in files], pa.binary())})

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The last file of a batch may go on in the next one.
        opened, parts = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            content, stops = encoded(batch)
            code = batch.column("path").dictionary_encode(null_encoding="encode").indices.to_numpy()
            first = np.flatnonzero(np.diff(code, prepend=-1))
            edges = np.concatenate([[0], stops])[np.append(first, len(code))].tolist()
            files = list(zip(batch.column("path").take(pa.array(first)).to_pylist(), (bytes(content[a:b]) for a, b in zip(edges, edges[1:]))))
            if parts and files[0][0] == opened:
                parts.append(files.pop(0)[1])
                if not files:
                    continue
            whole = ([(opened, b"".join(parts))] if parts else []) + files[:-1]
            opened, parts = files[-1][0], [files[-1][1]]
            if whole:
                yield made(whole)
        if parts:
            yield made([(opened, b"".join(parts))])
    return placed.mapInArrow(encode, "path string, content binary")


def read_wal(spark: SparkSession, path: str) -> DataFrame:
    """Entries of all log files below ``path``."""
    return parse_wal(spark.read.format("binaryFile").load(path))


def export_activity_json(path: str, activities: DataFrame, tables: Mapping[str, DataFrame] | None = None,
                         max_history: int | None = None, piece: int = EXPORT_PIECE) -> None:
    """Write activity as JSON: closed intervals nested under their worker, every other table one object per row.

    A worker's intervals are nested in order, ``piece`` to an object, so that no object grows with its worker's history.
    """
    history = number(recent_intervals(activities, max_history), ["worker_id"], ["end_time", "seq"], "_rn")
    fields = [c for c in activities.columns if c not in ("worker_id", "end_time", "seq")]
    nested = history.groupBy("worker_id", F.floor((F.col("_rn") - 1) / piece).alias("piece")).agg(
        F.sort_array(F.collect_list(F.struct("end_time", "seq", *fields))).alias("activities"))
    nested.write.mode("overwrite").json(f"{path}/activities")
    for name, table in (tables or {}).items():
        table.write.mode("overwrite").json(f"{path}/{name}")


def save_checkpoint(state: DataFrame, path: str, version: int, ts: float, system_version: str = "1.0", schema_version: str = "1.0") -> None:
    """Write the state texts (``payload``) of one version with their SHA-256.

    Every row carries the number of rows of its version, so a reader can tell a version that is still being committed.
    Writing a version again replaces it.
    """
    n_rows = state.count()
    (state.select(F.lit(n_rows).cast("bigint").alias("n_rows"), F.lit(system_version).alias("system_version"), F.lit(schema_version).alias("schema_version"), F.lit(ts).alias("ts"),
                  "payload", F.sha2(F.col("payload").cast("binary"), 256).alias("checksum"),
                  *[c for c in state.columns if c != "payload"])
     .write.mode("overwrite").parquet(f"{path}/version={version}"))


def read_checkpoints(spark: SparkSession, path: str) -> DataFrame:
    """All versions of which every row is there."""
    rows = spark.read.parquet(path).withColumn("version", F.col("version").cast("bigint"))
    whole = rows.groupBy("version").agg((F.count(F.lit(1)) == F.max("n_rows")).alias("whole")).filter("whole")
    # One row per version, each a folder that the driver has listed. A shuffle by version would put all its rows into one task.
    return rows.join(F.broadcast(whole.select("version")), "version", "left_semi").drop("n_rows")

