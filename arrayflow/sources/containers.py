"""Framed tensor files: 8-byte big-endian header length, JSON header, raw or compressed bytes."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from arrayflow.operators.catalog import assign_ids
from arrayflow.operators.tensors import batched

# Fixed value: width of the length prefix.
PREFIX = 8
#: Longer headers are rejected, so that a spoiled length never brings a whole file into memory.
HEADER_LIMIT = 1 << 26
#: Bytes of a payload that one row holds.
PIECE = 1 << 25
RAW_HEADER = "shape array<bigint>, dtype string"
BATCH_HEADER = "shape array<bigint>, dtype string, compression_type string, original_size bigint, compressed_size bigint"
STREAM_HEADER = ("original_metadata struct<shape:array<bigint>,dtype:string,size_bytes:bigint,task_id:string>, "
                 "compression_metadata struct<compressed_size:bigint,compression_ratio:double,compression_time:double,algorithm:string>, "
                 "task_info string, created_at double")


def parse_containers(files: DataFrame, header_schema: str = RAW_HEADER) -> DataFrame:
    """Split ``content`` into header fields and payload.

    ``ok`` is false, and ``reason`` says why, where a file is too short for its header or the header cannot be read.
    """
    length = F.conv(F.hex(F.substring("content", 1, PREFIX)), 16, 10).cast("bigint")
    whole = (F.octet_length("content") >= PREFIX) & (length + PREFIX <= F.octet_length("content"))
    sized = files.withColumn("_len", F.when(whole, length).cast("int"))
    text = F.decode(F.substring("content", F.lit(PREFIX + 1), F.col("_len")), "UTF-8")
    payload = F.substring("content", F.col("_len") + PREFIX + 1, F.octet_length("content"))
    read = sized.withColumn("header", F.from_json(text, header_schema)).withColumn("payload", payload)
    reason = F.when(F.col("_len").isNull(), "short file").when(unread_header(read), "unreadable header")
    return read.withColumns({"ok": reason.isNull(), "reason": reason}).drop("content", "_len")


def unread_header(read: DataFrame) -> Column:
    """Whether ``header`` is none: a text that is no JSON object parses to nulls throughout."""
    fields = read.select("header.*").columns
    unread = F.lit(bool(fields))
    for name in fields:
        unread = unread & F.col(f"header.{name}").isNull()
    return F.col("header").isNull() | unread


def read_containers(spark: SparkSession, path: str, header_schema: str = RAW_HEADER) -> DataFrame:
    """Framed files below ``path`` as (path, header, payload)."""
    return parse_containers(spark.read.format("binaryFile").load(path).select("path", "content"), header_schema)


def opened(path: str) -> pa.NativeFile:
    """A file for ranged reads in a worker: a local or mounted path, or a store that pyarrow knows (hdfs, s3, gs)."""
    scheme, colon, rest = path.partition(":")
    if not colon or scheme == "file" or "/" in scheme:
        return fs.LocalFileSystem().open_input_file("/" + rest.lstrip("/") if scheme == "file" else path)
    authority, _, name = rest.removeprefix("//").partition("/")
    system, base = fs.FileSystem.from_uri(f"{'s3' if scheme in ('s3a', 's3n') else scheme}://{authority}/")
    return system.open_input_file(f"{base.rstrip('/')}/{name}")


def head(path: str, length: int) -> tuple[str | None, int | None, str | None]:
    """Header text and place of the payload of a file of ``length`` bytes, or the reason why there is none."""
    with opened(path) as file:
        lead = file.read(PREFIX)
        n = int.from_bytes(lead, "big")
        if len(lead) < PREFIX or PREFIX + n > length:
            return None, None, "short file"
        if n > HEADER_LIMIT:
            return None, None, "long header"
        return file.read(n).decode("utf-8", "replace"), PREFIX + n, None


def read_headers(spark: SparkSession, path: str, header_schema: str = RAW_HEADER) -> DataFrame:
    """Headers of the framed files below ``path``: (path, length, header, payload_at, payload_bytes, ok, reason).

    Sizes come from the listing, and of a file only the prefix and the header are read, whatever its payload's size. Rejected
    files stay as rows with a reason, as in :func:`parse_containers`; a header above ``HEADER_LIMIT`` bytes is one too.
    """
    types = {"path": pa.string(), "length": pa.int64(), "text": pa.string(), "payload_at": pa.int64(), "short": pa.string()}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = (f for b in batches for f in zip(b.column("path").to_pylist(), b.column("length").to_pylist()))
        return batched(((path, length, *head(path, length)) for path, length in files), types)
    listed = spark.read.format("binaryFile").load(path).select("path", "length")
    heads = listed.mapInArrow(read, "path string, length bigint, text string, payload_at bigint, short string")
    parsed = heads.withColumn("header", F.from_json("text", header_schema))
    reason = F.coalesce("short", F.when(unread_header(parsed), "unreadable header"))
    return parsed.select("path", "length", "header", "payload_at", (F.col("length") - F.col("payload_at")).alias("payload_bytes"),
                         reason.isNull().alias("ok"), reason.alias("reason"))


def payload_ranges(headers: DataFrame, piece: int = PIECE) -> DataFrame:
    """Payloads of the files that are ``ok``, cut into ranges of ``piece`` bytes; an empty payload is one empty range.

    Rows are (file_id, chunk_index, n_chunks, start, n_bytes): what is not wanted can be filtered before anything is read.
    """
    size, last = F.col("payload_bytes"), F.greatest(F.ceil(F.col("payload_bytes") / piece), F.lit(1)).cast("bigint")
    cut = headers.filter("ok").select(F.col("path").alias("file_id"), "payload_at", size, last.alias("n_chunks"),
                                      F.explode(F.sequence(F.lit(0).cast("bigint"), last - 1)).alias("chunk_index"))
    begin = F.col("chunk_index") * piece
    return cut.select("file_id", "chunk_index", "n_chunks", (F.col("payload_at") + begin).alias("start"),
                      F.least(F.lit(piece).cast("bigint"), size - begin).alias("n_bytes"))


def read_ranges(ranges: DataFrame) -> DataFrame:
    """Ranges with their bytes as ``chunk``, dealt by (file, range): a large file is read by many tasks.

    A file that has become shorter since its listing is an error.
    """
    types = {"file_id": pa.string(), "chunk_index": pa.int64(), "n_chunks": pa.int64(), "start": pa.int64(), "n_bytes": pa.int64(), "chunk": pa.binary()}

    def load(path: str, start: int, size: int) -> bytes:
        with opened(path) as file:
            file.seek(start)
            data = file.read(size)
        if len(data) < size:
            raise OSError(f"{path} ends before byte {start + size}")
        return data

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (tuple(r.values()) for b in batches for r in b.to_pylist())
        return batched(((*r, load(r[0], r[3], r[4])) for r in rows), types)
    dealt = ranges.select(*list(types)[:-1]).repartition("file_id", "chunk_index")
    return dealt.mapInArrow(read, "file_id string, chunk_index bigint, n_chunks bigint, start bigint, n_bytes bigint, chunk binary")


def read_headerless(spark: SparkSession, path: str, catalog: DataFrame) -> DataFrame:
    """Bare compressed files joined to the catalog entries that describe them (``compressed_file`` is the file name)."""
    files = spark.read.format("binaryFile").load(path).select(
        F.element_at(F.split("path", "/"), -1).alias("compressed_file"), F.col("content").alias("payload"))
    named = catalog.withColumn("compressed_file", F.element_at(F.split("compressed_file", "/"), -1))
    return named.join(files, "compressed_file")


def frame_containers(tensors: DataFrame, header: Sequence[str]) -> DataFrame:
    """Replace header columns and payload by the framed ``content``."""
    text = F.encode(F.to_json(F.struct(*header)), "UTF-8")
    prefix = F.unhex(F.lpad(F.hex(F.octet_length(text)), 2 * PREFIX, "0"))
    return tensors.withColumn("content", F.concat(prefix, text, "payload")).drop("payload")


def write_tensors(tensors: DataFrame, path: str, order: Sequence[str] | None = None, next_id: int = 0) -> None:
    """Append tensors as zstd Parquet, header fields as columns; with ``order`` ids are assigned from ``next_id``."""
    if order:
        tensors = assign_ids(tensors.drop("tensor_id"), order, next_id)
    tensors.write.mode("append").option("compression", "zstd").parquet(path)


def write_observed(writes: DataFrame, path: str) -> dict[str, int]:
    """Append the rows that are ``ok`` and return the totals that the write itself has seen: no second pass reads anything."""
    seen, ok = Observation(), F.coalesce("ok", F.lit(False))
    size = F.coalesce(F.octet_length("payload"), F.lit(0)).cast("bigint")
    observed = writes.observe(seen, F.count_if(ok).alias("total_writes"), F.coalesce(F.sum(F.when(ok, size)), F.lit(0)).alias("total_bytes_written"),
                              F.count_if(~ok).alias("failed_writes"))
    observed.filter(ok).drop("ok").write.mode("append").option("compression", "zstd").parquet(path)
    return dict(seen.get)


def dataset_size(spark: SparkSession, path: str) -> DataFrame:
    """Files and bytes of any kind below a directory, from its listing; no file is opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("length")
    return files.agg(F.count(F.lit(1)).alias("n_files"), F.coalesce(F.sum("length"), F.lit(0)).alias("total_bytes"))
