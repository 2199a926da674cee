"""Tensor compute: cells, slices, transforms, run lengths, codecs and compression reports."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arrayflow.functions.expr import element_count, floor_div, ratio
from arrayflow.functions.ordered import neighbour, running_sum, slice_rows

# Zstd level, run-length word size, size above which path A is taken.
ZSTD_LEVEL = 3
WORD = 4
ROUTE_MB = 100
BATCH_CELLS = 1 << 18
# Longest expansion of one row; longer runs are cut into pieces first.
PIECE = 1 << 16


def batched(rows: Iterable[tuple], types: Mapping[str, pa.DataType], max_rows: int = 10_000, max_bytes: int = 1 << 25) -> Iterator[pa.RecordBatch]:
    """Tuples to Arrow batches bounded in rows and in bytes of their binary fields."""
    def flush(held: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held), types.values())], names=list(types))
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += sum(len(v) for v in row if isinstance(v, bytes))
        if len(held) >= max_rows or size >= max_bytes:
            yield flush(held)
            held, size = [], 0
    if held:
        yield flush(held)


# Cells ---------------------------------------------------------------------------------------------------------------

def decode_cells(tensors: DataFrame) -> DataFrame:
    """Binary payloads to (tensor_id, pos, value); large tensors leave in batches of bounded size.

    Rows that :func:`undecodable` lists have no cells. Where there is a column ``first_pos``, a payload begins at that position.
    """
    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, np.ndarray]]:
        for batch in batches:
            columns = (batch.column(n).to_pylist() for n in ("tensor_id", "dtype", "first_pos", "payload"))
            for tensor_id, dtype, first, payload in zip(*columns):
                values = np.frombuffer(payload, dtype=dtype)
                for lo in range(0, len(values), BATCH_CELLS):
                    yield tensor_id, first + lo, values[lo:lo + BATCH_CELLS].astype("float64")

    def flush(held: list[tuple[int, int, np.ndarray]]) -> pa.RecordBatch:
        counts = [len(v) for _, _, v in held]
        return pa.record_batch({
            "tensor_id": np.repeat(np.array([t for t, _, _ in held], dtype="int64"), counts),
            "pos": np.concatenate([np.arange(lo, lo + n, dtype="int64") for (_, lo, _), n in zip(held, counts)]),
            "value": np.concatenate([v for _, _, v in held])})

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for part in parts(batches):
            held.append(part)
            n += len(part[2])
            if n >= BATCH_CELLS:
                yield flush(held)
                held, n = [], 0
        if n:
            yield flush(held)
    first = F.col("first_pos") if "first_pos" in tensors.columns else F.lit(0).cast("bigint").alias("first_pos")
    return tensors.filter(_reject(tensors).isNull()).select("tensor_id", "dtype", first, "payload").mapInArrow(decode, "tensor_id bigint, pos bigint, value double")


def _reject(tensors: DataFrame) -> Column:
    """Why a row's payload gives no cells, null if it does. With a ``shape``, the size must be the shape's too."""
    width, size = item_bytes("dtype"), F.octet_length("payload")
    reason = (F.when(F.col("payload").isNull(), "no payload").when(width.isNull(), "unknown dtype")
              .when(F.col("dtype").rlike("^(complex|[<>=|]?c)"), "complex numbers").when(size % width != 0, "broken element"))
    if "shape" in tensors.columns:
        reason = reason.when(F.coalesce(size != element_count("shape") * width, F.lit(True)), "other size than the shape's")
    return reason


def undecodable(tensors: DataFrame) -> DataFrame:
    """Rows whose payload gives no cells: ``tensor_id, reason``."""
    return tensors.select("tensor_id", _reject(tensors).alias("reason")).filter("reason IS NOT NULL")


def item_bytes(dtype: str) -> Column:
    """Bytes per element of the number types, by name (``float32``, ``double``, ``complex128``, ``bool``) or code (``<f8``, ``>i4``)."""
    name = F.col(dtype)
    bits = F.regexp_extract(name, "^(?:float(?=16$|32$|64$)|u?int(?=8$|16$|32$|64$)|complex(?=64$|128$))([0-9]+)$", 1)
    code = F.regexp_extract(name, "^[<>=|]?(?:f(?=[248]$)|[iu](?=[1248]$)|c(?=8$|16$)|b(?=1$))([0-9]+)$", 1)
    return (F.when(bits != "", F.try_divide(bits.cast("int"), F.lit(8)).cast("int")).when(code != "", code.cast("int"))
            .when(name.isin("bool", "?"), 1).when(name == "half", 2).when(name == "single", 4).when(name == "double", 8))


def encode_tensors(tensors: DataFrame, values: str) -> DataFrame:
    """Array column to a row-major payload in the row's dtype."""
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            payload = [np.asarray(v, dtype=d).tobytes() for v, d in zip(batch.column(values).to_pylist(), batch.column("dtype").to_pylist())]
            kept = {n: batch.column(n) for n in batch.schema.names if n != values}
            yield pa.record_batch({**kept, "payload": pa.array(payload, pa.binary())})
    fields = [f for f in tensors.schema.fields if f.name != values]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return tensors.mapInArrow(encode, f"{ddl}, payload binary")


def generate_tensors(specs: DataFrame, seed: int = 0, default_size: int = 100) -> DataFrame:
    """Square matrices as cells from (tensor_id, kind, size): identity, zeros, anything else is random in [0, 1).

    Random values hash (seed, id, pos), so they do not depend on partitioning or retries.
    """
    size = F.coalesce("size", F.lit(default_size)).cast("bigint")
    sized = specs.select("tensor_id", F.coalesce("kind", F.lit("random")).alias("kind"), size.alias("size"))
    rows = sized.filter(F.col("size") > 0).withColumn("i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("size") - 1)))
    # The rows of a large matrix spread over all tasks before they become cells.
    cells = rows.repartition("tensor_id", "i").withColumn("j", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("size") - 1)))
    pos = F.col("i") * F.col("size") + F.col("j")
    # 2^24 steps keep the value exact in float32.
    noise = F.pmod(F.xxhash64(F.lit(seed), "tensor_id", pos), F.lit(1 << 24)) / float(1 << 24)
    value = (F.when(F.col("kind") == "identity", (F.col("i") == F.col("j")).cast("double"))
             .when(F.col("kind") == "zeros", 0.0).otherwise(noise))
    return cells.select("tensor_id", "kind", pos.alias("pos"), value.alias("value"))


def _floor_by(value: Column, by: Column) -> Column:
    return F.call_function("div", value - F.pmod(value, by), by)


def _box(slices: Sequence[slice], shape: Column) -> Column:
    """Per axis of ``shape``: stride, start, stop, step and length of the slice, in the order of the axes."""
    for part in slices:
        if (part.start or 0) < 0 or (part.stop or 0) < 0 or (part.step if part.step is not None else 1) < 1:
            raise ValueError("slices need start, stop >= 0 and step >= 1")
    one = F.lit(1).cast("bigint")
    given = F.array(*[F.struct(F.lit(p.start or 0).cast("bigint").alias("start"), F.lit(p.stop or None).cast("bigint").alias("stop"),
                               F.lit(p.step or 1).cast("bigint").alias("step")) for p in (*slices, slice(None))])

    def axis(dim: Column, at: Column) -> Column:
        own = F.get(given, F.least(at, F.lit(len(slices))))
        stop = F.least(F.coalesce(own["stop"], dim), dim)
        length = F.greatest(F.lit(0).cast("bigint"), floor_div(stop - own["start"] + own["step"] - 1, own["step"]))
        stride = F.aggregate(F.slice(shape, at + 2, F.size(shape)), one, lambda n, d: n * d)
        return F.struct(stride.alias("stride"), dim.alias("dim"), own["start"].alias("start"), stop.alias("stop"), own["step"].alias("step"), length.alias("length"))
    return F.transform(shape, axis)


def slice_tensor(cells: DataFrame, shapes: DataFrame | Sequence[int], slices: Sequence[slice]) -> DataFrame:
    """Box slice with steps of every tensor. A stop of 0 or None means the end, axes beyond ``slices`` stay whole.

    ``shapes`` has each tensor's ``tensor_id, shape``, of any sizes and numbers of axes, or is one shape for all. A tensor
    with fewer axes than ``slices`` has no cells, nor has one without a shape.
    """
    if isinstance(shapes, DataFrame):
        boxes = shapes.filter(F.size("shape") >= len(slices)).select("tensor_id", _box(slices, F.col("shape")).alias("_box"))
        boxed = cells.join(boxes, "tensor_id")
    else:
        boxed = cells.withColumn("_box", _box(slices, F.array(*[F.lit(d).cast("bigint") for d in shapes])))

    def index(axis: Column) -> Column:
        return F.pmod(_floor_by(F.col("pos"), axis["stride"]), axis["dim"])
    inside = F.forall("_box", lambda a: (index(a) >= a["start"]) & (index(a) < a["stop"]) & (F.pmod(index(a) - a["start"], a["step"]) == 0))
    new_pos = F.aggregate("_box", F.lit(0).cast("bigint"), lambda n, a: n * a["length"] + _floor_by(index(a) - a["start"], a["step"]))
    return boxed.filter(inside).withColumn("pos", new_pos).select(*cells.columns)


def slice_stored(tensors: DataFrame, slices: Sequence[slice], chunk: int = BATCH_CELLS) -> DataFrame:
    """As :func:`slice_tensor` over stored payloads (``tensor_id, shape, dtype, payload``), decoding only what the box touches.

    The slice of the first axis bounds the row-major positions that can be inside. Only the bytes of these positions reach the
    decoder, in pieces of ``chunk`` elements that are decoded in parallel. Rows that :func:`undecodable` lists have no cells.
    """
    given = tensors.select("tensor_id", "shape", "dtype", "payload")
    whole = given.filter(_reject(given).isNull() & (F.size("shape") >= len(slices)))
    first, width = F.get(_box(slices, F.col("shape")), F.lit(0)), item_bytes("dtype")
    # A tensor without axes is one cell.
    low, high = F.coalesce(first["start"] * first["stride"], F.lit(0)), F.coalesce(first["stop"] * first["stride"], F.lit(1))
    touched = whole.select("*", low.cast("bigint").alias("_low"), high.cast("bigint").alias("_high")).filter("_low < _high")
    pieces = touched.select("*", F.explode(F.sequence(F.col("_low"), F.col("_high") - 1, F.lit(chunk).cast("bigint"))).alias("first_pos"))
    size = F.least(F.lit(chunk).cast("bigint"), F.col("_high") - F.col("first_pos"))
    cut = F.substring(F.col("payload"), (F.col("first_pos") * width + 1).cast("int"), (size * width).cast("int"))
    cells = decode_cells(pieces.select("tensor_id", "dtype", "first_pos", cut.alias("payload")))
    return slice_tensor(cells, given.select("tensor_id", "shape"), slices)


def apply_transforms(cells: DataFrame, transforms: Sequence[Callable[[Column], Column]]) -> DataFrame:
    """Apply column functions to every value, in order, and name the result after its source."""
    value = F.col("value")
    for transform in transforms:
        value = transform(value)
    return cells.select(F.concat(F.lit("transformed_"), F.col("tensor_id")).alias("name"), "tensor_id", "pos", value.alias("value"))


def apply_tensor_udf(tensors: DataFrame, function: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Apply an array function to every whole tensor; shape and dtype follow its result."""
    types = {"tensor_id": pa.int64(), "shape": pa.list_(pa.int64()), "dtype": pa.string(), "payload": pa.binary()}

    def results(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for row in batch.to_pylist():
                result = np.ascontiguousarray(function(np.frombuffer(row["payload"], dtype=row["dtype"]).reshape(row["shape"])))
                yield row["tensor_id"], list(result.shape), str(result.dtype), result.tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return batched(results(batches), types)
    return (tensors.select("tensor_id", "shape", "dtype", "payload")
            .mapInArrow(run, "tensor_id bigint, shape array<bigint>, dtype string, payload binary"))


def tensor_footprint(catalog: DataFrame) -> DataFrame:
    """Elements, bytes per element and bytes of every entry; a type of unknown width fails."""
    unknown = F.raise_error(F.concat(F.lit("unknown dtype "), F.coalesce("dtype", F.lit("null")))).cast("int")
    return catalog.select("tensor_id", element_count("shape").alias("n_elements"), F.coalesce(item_bytes("dtype"), unknown).alias("item_size")).withColumn(
        "n_bytes", F.col("n_elements") * F.col("item_size"))


def content_id(tensors: DataFrame, payload: str = "payload", name: str = "name") -> DataFrame:
    """Add an id made of content and name."""
    return tensors.withColumn("content_id", F.concat_ws(
        "_", F.substring(F.md5(payload), 1, 8), F.substring(F.md5(F.col(name).cast("binary")), 1, 8)))


# Run lengths ---------------------------------------------------------------------------------------------------------

def rle_encode(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Runs of equal neighbouring values per group, numbered from 1."""
    rows = slice_rows(df.select(*keys, *order, value), keys, order)
    before = neighbour(rows.withColumn("_has", F.lit(True)), keys, order, {"_before": value, "_before_has": "_has"}, step=-1)
    same = F.coalesce("_before_has", F.lit(False)) & F.col(value).eqNullSafe(F.col("_before"))
    runs = running_sum(before, keys, order, {"run": F.when(same, 0).otherwise(1)})
    return runs.groupBy(*keys, "run", value).agg(F.count(F.lit(1)).alias("length"))


def rle_decode(runs: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Runs back to one row per position; a long run is spread over many tasks before it is expanded."""
    placed = running_sum(runs, keys, ["run"], {"_end": "length"})
    zero = F.lit(0).cast("bigint")
    pieces = placed.filter(F.col("length") > 0).withColumn("_from", F.explode(F.sequence(zero, F.col("length") - 1, F.lit(PIECE).cast("bigint"))))
    begin = F.col("_end") - F.col("length") + F.col("_from")
    size = F.least(F.lit(PIECE).cast("bigint"), F.col("length") - F.col("_from"))
    spread = pieces.select(*keys, value, begin.alias("_begin"), size.alias("_size")).repartition(*keys, "_begin")
    return spread.select(*keys, F.explode(F.sequence(F.col("_begin"), F.col("_begin") + F.col("_size") - 1)).alias("pos"), value)


# Codecs --------------------------------------------------------------------------------------------------------------

def _map_payload(df: DataFrame, function: Callable[[bytes], object], column: str, kind: str, arrow_type: pa.DataType) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = pa.array([None if p is None else function(p) for p in batch.column("payload").to_pylist()], arrow_type)
            kept = {n: batch.column(n) for n in batch.schema.names if n not in ("payload", column)}
            yield pa.record_batch({**kept, column: made})
    kept = [f for f in df.schema.fields if f.name not in ("payload", column)]
    ddl = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept)
    return df.mapInArrow(run, f"{ddl}{column} {kind}")


@lru_cache
def _compressor(level: int) -> zstandard.ZstdCompressor:
    """One compressor per Python worker: its tables are larger than most small payloads."""
    return zstandard.ZstdCompressor(level=level)


def compress_tensors(tensors: DataFrame, level: int = ZSTD_LEVEL) -> DataFrame:
    """zstd-compress every payload and keep both sizes; rows stay where they are."""
    sized = tensors.withColumn("original_size", F.octet_length("payload"))
    packed = _map_payload(sized, lambda p: _compressor(level).compress(p), "payload", "binary", pa.binary())
    return packed.withColumn("compressed_size", F.octet_length("payload"))


def _whole_frames(payload: bytes) -> bytes:
    """What all zstd frames of a payload hold; a cut one is an error."""
    parts, rest = [], payload
    while rest or not parts:
        frame = zstandard.ZstdDecompressor().decompressobj()
        parts.append(frame.decompress(rest))
        if not frame.eof:
            raise ValueError("a zstd frame is cut short")
        rest = frame.unused_data
    return b"".join(parts)


def decompress_tensors(tensors: DataFrame) -> DataFrame:
    """Inverse of :func:`compress_tensors`; a payload that is not zstd, or is cut short, fails the job."""
    plain = _map_payload(tensors, _whole_frames, "payload", "binary", pa.binary())
    return plain.drop("original_size", "compressed_size")


def compression_report(sizes: DataFrame, by: Sequence[str]) -> DataFrame:
    """Sizes and both ratios per group: compressed/original and original/compressed."""
    return sizes.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.sum("original_size").alias("original_size"), F.sum("compressed_size").alias("compressed_size"),
        F.avg(F.when(F.col("original_size") > 0, F.col("compressed_size") / F.col("original_size"))).alias("avg_size_ratio")).select(
        "*", ratio("compressed_size", "original_size").alias("size_ratio"), ratio("original_size", "compressed_size").alias("compression_factor"))


def rle_size(payload: bytes) -> int:
    """Bytes of a run-length code over 4-byte words, the last one zero-padded: 8 bytes a run."""
    words = np.frombuffer(payload + b"\0" * (-len(payload) % WORD), dtype="<u4")
    return 0 if len(words) == 0 else 2 * WORD * (1 + int(np.count_nonzero(words[1:] != words[:-1])))


def zstd_size(payload: bytes) -> int:
    return len(_compressor(ZSTD_LEVEL).compress(payload))


CODECS: Mapping[str, Callable[[bytes], int]] = {"rle": rle_size, "zstd": zstd_size}


def compare_codecs(tensors: DataFrame, by: Sequence[str], codecs: Mapping[str, Callable[[bytes], int]] = CODECS) -> DataFrame:
    """Total size and compression factor of each codec per batch; only sizes leave the Python workers."""
    sized = tensors.select(*by, F.octet_length("payload").alias("original_size"), "payload")
    codec_items = list(codecs.items())

    def measure(payload: bytes) -> list[int]:
        return [size(payload) for _, size in codec_items]
    measured = _map_payload(sized, measure, "sizes", "array<bigint>", pa.list_(pa.int64()))
    totals = measured.groupBy(*by).agg(F.sum("original_size").alias("original_size"), *[
        F.sum(F.col("sizes")[i]).alias(f"{name}_size") for i, (name, _) in enumerate(codec_items)])
    return totals.select("*", *[ratio("original_size", f"{name}_size").alias(f"{name}_factor") for name, _ in codec_items])


def route_by_size(sizes: DataFrame, by: Sequence[str], threshold_mb: float = ROUTE_MB) -> DataFrame:
    """Batches above the threshold take path A, the others B."""
    megabytes = F.sum("n_bytes") / float(1 << 20)
    return sizes.groupBy(*by).agg(megabytes.alias("total_mb"), F.when(megabytes > threshold_mb, "A").otherwise("B").alias("path"))


def task_grid(sizes: DataFrame, kinds: Sequence[str] = ("random", "identity", "zeros")) -> DataFrame:
    """Every size with every kind, numbered with sizes outermost; sizes carry their own ``size_order``."""
    kind = F.posexplode(F.array(*[F.lit(k) for k in kinds]))
    grid = sizes.select("size_order", "size", kind.alias("kind_order", "kind"))
    numbered = running_sum(grid, [], ["size_order", "kind_order"], {"_rn": F.lit(1).cast("bigint")})
    task_no = F.col("_rn") - 1
    return numbered.select(task_no.alias("task_no"), F.concat(F.lit("task_"), task_no).alias("task_id"), "size", "kind")


def task_stream(ticks: DataFrame, grid: DataFrame, start: int = 0) -> DataFrame:
    """Cycle over the grid: tick ``value`` takes task ``value % n``. Ticks may be a stream (``rate`` source)."""
    n = grid.count()
    cyclic = ticks.withColumn("task_no", F.pmod(F.col("value"), F.lit(n)))
    return cyclic.join(grid.drop("task_id"), "task_no").withColumn(
        "task_id", F.concat(F.lit("task_"), F.col("value") + start))

