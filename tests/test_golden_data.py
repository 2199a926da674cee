"""Hand-computed rows and round trips for catalog, tensor, layout, recovery and file operators."""

import hashlib
import json
import os
import struct

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from arrayflow.operators import catalog as C
from arrayflow.operators import layout as L
from arrayflow.operators import recovery as R
from arrayflow.operators import tensors as T
from arrayflow.session import pinned
from arrayflow.sources import catalogs, containers, logs

CATALOG = "tensor_id bigint, name string, shape array<bigint>, dtype string, tags struct<a: int, b: string>"


@pytest.fixture
def catalog(frame):
    return frame([(2, "Red ring", [3, 4], "float32", (1, "x")), (1, None, [2, 6], "float64", None), (3, "blue", [3, 4], "int8", (1, "y"))], CATALOG)


def test_search(catalog, rows):
    def ids(**criteria):
        return [i for i, in rows(C.search_tensors(catalog, criteria), "tensor_id")]
    assert ids(dtype=["float32", "float64"], x=1) == []
    assert ids(dtype=["float32", "float64"]) == [1, 2]
    assert ids(name="blue") == [3] and ids(tags={"a": 1, "b": "x"}) == [2] and ids(tags={"a": 1, "c": 1}) == []
    assert ids(shape=[3, 4]) == [] and ids(name=None) == [1] and ids(name={"a": 1}) == [] and ids() == [1, 2, 3]


def test_finders(catalog, rows):
    assert rows(C.find_by_size_range(catalog, 12, 12), "tensor_id") == [(1,), (2,), (3,)]
    assert rows(C.find_by_name(catalog, "^$"), "tensor_id") == [(1,)]
    assert rows(C.find_by_name(catalog, "RED"), "tensor_id") == [(2,)]
    assert rows(C.find_by_shape(catalog, [3, 4]), "tensor_id") == [(2,), (3,)]
    assert tuple(C.index_stats(catalog).first()) == (2, 1, 3)
    assert [r.tensor_id for r in C.list_tensors(catalog, 0).collect()] == [1, 2, 3]
    assert [r.tensor_id for r in C.list_tensors(catalog, 2).collect()] == [1, 2]


def test_lookup_by_ids(catalog, frame, rows):
    assert rows(C.tensor_info(catalog, frame([(1,), (9,), (1,)], "tensor_id bigint")), "tensor_id") == [(1,)]
    assert rows(C.unknown_ids(catalog, frame([(1,), (9,)], "tensor_id bigint"))) == [(9,)]


def test_catalog_file(spark, tmp_path, rows):
    assert catalogs.load_catalog(spark, str(tmp_path / "none.json")).count() == 0
    index = {"matrices": {"0": {"name": "a", "filename": "f", "shape": [2, 3], "dtype": "float64", "created_at": 1.5},
                          "7": {"name": "b", "filename": "g", "shape": [1], "dtype": "int8", "created_at": 2.0, "compressed_file": "g.zst"}}, "next_id": 8}
    path = tmp_path / "index.json"
    path.write_text(json.dumps(index, indent=2))
    assert rows(catalogs.load_catalog(spark, str(path)), "tensor_id", "name", "shape", "compressed_file") == [(0, "a", [2, 3], None), (7, "b", [1], "g.zst")]


def test_appended_catalog_keeps_first_time(spark, tmp_path):
    """The earliest creation and the latest non-null fields, in one aggregation without a window."""
    path = str(tmp_path / "catalog")
    entry = "tensor_id bigint, name string, filename string, shape array<bigint>, dtype string, created_at timestamp, compressed_file string"
    for name, second in (("a", 10), ("b", 30), (None, 40)):
        made = spark.createDataFrame([(1, name, "f", [2], "int8", None, None)], entry)
        catalogs.append_catalog(made.withColumn("created_at", F.timestamp_seconds(F.lit(second))), path)
    found = catalogs.read_catalog(spark, path)
    row = found.select("name", F.unix_micros("created_at").alias("t"), "compressed_file").first()
    assert tuple(row) == ("b", 10_000_000, None)
    assert "Window" not in found._jdf.queryExecution().executedPlan().toString()


def test_missing_appended_catalog_is_empty(spark, tmp_path):
    assert catalogs.read_catalog(spark, str(tmp_path / "none")).count() == 0


# Files ---------------------------------------------------------------------------------------------------------------

def framed(header, payload):
    text = json.dumps(header).encode()
    return len(text).to_bytes(8, "big") + text + payload


def test_container_files(spark, tmp_path, rows):
    array = np.arange(6, dtype="float32").reshape(2, 3)
    (tmp_path / "a.bin").write_bytes(framed({"shape": [2, 3], "dtype": "float32", "chunk_size": 9}, array.tobytes()))
    (tmp_path / "torn.bin").write_bytes(b"\0\0\0\0\0\0\1")
    read = containers.read_containers(spark, str(tmp_path)).withColumn("file", F.element_at(F.split("path", "/"), -1))
    got = {r.file: r for r in read.collect()}
    assert bytes(got["a.bin"].payload) == array.tobytes() and got["a.bin"].header.shape == [2, 3]
    assert got["torn.bin"].payload is None and (got["torn.bin"].ok, got["torn.bin"].reason) == (False, "short file") and got["a.bin"].ok
    whole = read.filter("payload is not null").select(F.lit(5).cast("bigint").alias("tensor_id"), "header.dtype", "payload")
    assert rows(T.decode_cells(whole)) == [(5, i, float(i)) for i in range(6)]


def test_headers_without_payloads(spark, tmp_path):
    """A payload of 3 GB is listed from a few hundred bytes of its file, and its last range is read alone."""
    huge = tmp_path / "huge file%20.bin"
    huge.write_bytes(framed({"shape": [3 << 30], "dtype": "int8"}, b""))
    begin = huge.stat().st_size
    with open(huge, "r+b") as file:
        file.truncate(begin + (3 << 30))
        file.seek(-2, os.SEEK_END)
        file.write(b"xy")
    (tmp_path / "torn.bin").write_bytes(b"\0\0\1")
    (tmp_path / "claim.bin").write_bytes((99).to_bytes(8, "big") + b"{}")
    (tmp_path / "text.bin").write_bytes((4).to_bytes(8, "big") + b"!!!!data")
    (tmp_path / "none.bin").write_bytes(framed({"shape": [0], "dtype": "int8"}, b""))

    def read_so_far():
        with open("/proc/self/io") as counts:
            return int(counts.readline().split()[1])
    before = read_so_far()
    assert containers.head(f"file:{huge}", huge.stat().st_size)[1] == begin
    assert read_so_far() - before < 10_000

    headers = containers.read_headers(spark, str(tmp_path))
    got = {os.path.basename(r.path): r for r in headers.collect()}
    assert {n: r.reason for n, r in got.items() if not r.ok} == {"torn.bin": "short file", "claim.bin": "short file", "text.bin": "unreadable header"}
    assert got[huge.name].header.shape == [3 << 30] and (got[huge.name].payload_at, got[huge.name].payload_bytes) == (begin, 3 << 30)

    ranges = containers.payload_ranges(headers.filter("payload_bytes > 0"), 1 << 20)
    assert ranges.count() == 3 << 10
    last = containers.read_ranges(ranges.filter("chunk_index = n_chunks - 1")).select(F.octet_length("chunk").alias("n"), F.expr("substring(chunk, -2)").alias("end")).first()
    assert (last.n, bytes(last.end)) == (1 << 20, b"xy")


def test_long_header_is_rejected(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(containers, "HEADER_LIMIT", 10)
    (tmp_path / "a.bin").write_bytes(framed({"shape": [1], "dtype": "int8"}, b"1"))
    assert containers.head(str(tmp_path / "a.bin"), 100) == (None, None, "long header")


def test_ranges_put_together(spark, tmp_path):
    """Ranges give the payload that the whole file gives; a file cut after its listing is an error."""
    payload = bytes(range(256)) * 5
    (tmp_path / "a.bin").write_bytes(framed({"shape": [1280], "dtype": "uint8"}, payload))
    (tmp_path / "none.bin").write_bytes(framed({"shape": [0], "dtype": "uint8"}, b""))
    headers = containers.read_headers(spark, str(tmp_path))
    chunks = containers.read_ranges(containers.payload_ranges(headers, 300))
    assert {os.path.basename(r.file_id): bytes(r.payload) for r in L.assemble(chunks).collect()} == {"a.bin": payload, "none.bin": b""}
    ranges = containers.payload_ranges(headers.withColumn("payload_bytes", F.col("payload_bytes") + 1), 300)
    with pytest.raises(Exception, match="ends before byte"):
        containers.read_ranges(ranges).count()


def test_compressed_container_and_headerless_file(spark, tmp_path, frame):
    data = np.zeros(100, dtype="float64").tobytes()
    frame_bytes = zstandard.ZstdCompressor(level=3).compress(data)
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "x.zst").write_bytes(framed({"original_metadata": {"shape": [10, 10], "dtype": "float64", "size_bytes": 800, "task_id": "t"}, "created_at": 1.0}, frame_bytes))
    stream = containers.read_containers(spark, str(tmp_path / "s"), containers.STREAM_HEADER)
    assert stream.first().header.original_metadata.shape == [10, 10]
    assert bytes(T.decompress_tensors(stream.select("payload")).first().payload) == data
    (tmp_path / "h").mkdir()
    (tmp_path / "h" / "m.zst").write_bytes(frame_bytes)
    entries = frame([(1, [10, 10], "float64", "/out/m.zst")], "tensor_id bigint, shape array<bigint>, dtype string, compressed_file string")
    bare = containers.read_headerless(spark, str(tmp_path / "h"), entries)
    assert bytes(T.decompress_tensors(bare).first().payload) == data


def test_write_assigns_ids_and_sizes_agree(spark, tmp_path, frame, rows):
    tensors = frame([("b", [1], "int8", bytearray(b"2")), ("a", [1], "int8", bytearray(b"1"))], "name string, shape array<bigint>, dtype string, payload binary")
    path = str(tmp_path / "t")
    containers.write_tensors(tensors, path, order=["name"], next_id=4)
    containers.write_tensors(tensors, path, order=["name"], next_id=6)
    stored = spark.read.parquet(path)
    assert rows(stored, "tensor_id", "name") == [(4, "a"), (5, "b"), (6, "a"), (7, "b")]
    parts = [p for p in (tmp_path / "t").glob("*.parquet")]
    expected = (len(parts), sum(os.path.getsize(p) for p in parts))
    assert tuple(containers.dataset_size(spark, path).first()) == expected


def test_undecodable_rows(frame, rows):
    data = [(1, "<f4", [2], bytearray(8)), (2, "float32", [3], bytearray(8)), (3, "float64", [1], bytearray(7)), (4, "nonsense", [1], bytearray(8)), (5, None, [1], bytearray(8)),
            (6, "int8", [1], None), (7, "complex128", [1], bytearray(16)), (8, "bool", [2], bytearray(2))]
    tensors = frame(data, "tensor_id bigint, dtype string, shape array<bigint>, payload binary")
    assert rows(T.undecodable(tensors)) == [(2, "other size than the shape's"), (3, "broken element"), (4, "unknown dtype"), (5, "unknown dtype"), (6, "no payload"), (7, "complex numbers")]
    assert rows(T.decode_cells(tensors).groupBy("tensor_id").count()) == [(1, 2), (8, 2)]


def wal_entry(op, offset, length, meta, spoil=False, meta_len=None):
    text = meta.encode()
    head = struct.pack(">BdqqI", op, 1.25, offset, length, len(text) if meta_len is None else meta_len)
    digest = hashlib.md5(head + text).digest()
    return head + text + (digest[::-1] if spoil else digest)


def test_wal_files(spark, tmp_path, rows):
    good = wal_entry(1, 0, 10, '{"a": 1}')
    (tmp_path / "one.wal").write_bytes(good + wal_entry(2, 5, 6, '{"b": "é"}', spoil=True) + wal_entry(3, -7, 8, "{}") + good[:20])
    (tmp_path / "bad_length.wal").write_bytes(good + wal_entry(1, 1, 1, "{}", meta_len=10**6) + good)
    (tmp_path / "empty.wal").write_bytes(b"")
    read = logs.read_wal(spark, str(tmp_path)).withColumn("file", F.element_at(F.split("path", "/"), -1))
    assert rows(read.filter("file = 'one.wal'"), "seq", "op", "offset", "length", "meta", "checksum_ok", "bytes_left") == [
        (0, 1, 0, 10, '{"a": 1}', True, 56 + 47 + 20), (1, 2, 5, 6, '{"b": "é"}', False, 47 + 20), (2, 3, -7, 8, "{}", True, 20)]
    assert rows(read.filter("file = 'bad_length.wal'"), "seq", "checksum_ok") == [(0, True)]
    assert R.valid_entries(read).count() == 3


# Tensors -------------------------------------------------------------------------------------------------------------

def test_slice(spark, rows):
    cells = spark.range(12).selectExpr("1L AS tensor_id", "id AS pos", "id * 1.0D AS value")
    assert rows(T.slice_tensor(cells, [3, 4], [slice(0, 2), slice(1, 4, 2)]), "pos", "value") == [(0, 1.0), (1, 3.0), (2, 5.0), (3, 7.0)]
    with pytest.raises(ValueError):
        T.slice_tensor(cells, [3, 4], [slice(-1, None)])


@pytest.mark.parametrize("shape, cut", [((2, 3, 4), (slice(1, 2), slice(None, None, 2), slice(1, 3))), ((24,), (slice(3, 20, 5),)), ((4, 6), (slice(2, 0),)), ((4, 6), (slice(3, 1),))])
def test_slice_equals_numpy(spark, shape, cut):
    cells = spark.range(24).selectExpr("1L AS tensor_id", "id AS pos", "id * 1.0D AS value")
    effective = tuple(slice(c.start, c.stop or None, c.step) for c in cut)
    wanted = np.arange(24.0).reshape(shape)[effective].ravel()
    got = T.slice_tensor(cells, shape, cut).orderBy("pos").collect()
    assert [r.value for r in got] == list(wanted) and [r.pos for r in got] == list(range(len(wanted)))


BOXES = [(slice(1, 3),), (slice(0, 2), slice(1, None, 2)), (slice(2, 0),), (slice(3, 1),), ()]


@pytest.mark.parametrize("cut", BOXES, ids=str)
def test_slices_follow_each_shape(frame, rows, cut):
    """One call over tensors of several shapes and numbers of axes, as cells and as stored payloads."""
    shapes = {1: (3, 4), 2: (24,), 3: (2, 3, 4), 4: (5, 1), 5: (0, 7), 6: (1, 1, 1, 2), 7: ()}
    arrays = {k: (np.arange(int(np.prod(shape))) * 10.0 + k).reshape(shape) for k, shape in shapes.items()}
    wanted = []
    for k, a in arrays.items():
        if len(cut) <= a.ndim:
            part = a[tuple(slice(c.start, c.stop or None, c.step) for c in cut)]
            wanted += [(k, pos, float(v)) for pos, v in enumerate(part.ravel())]
    tensors = frame([(k, list(shapes[k]), "float64", a.tobytes()) for k, a in arrays.items()] + [(8, [2], "float64", b"123"), (9, None, "float64", b"12345678")],
                    "tensor_id bigint, shape array<bigint>, dtype string, payload binary")
    assert rows(T.slice_tensor(T.decode_cells(tensors), tensors.select("tensor_id", "shape"), cut)) == sorted(wanted, key=repr)
    assert rows(T.slice_stored(tensors, cut, chunk=5)) == sorted(wanted, key=repr)


def test_slices_decode_only_the_box(frame, monkeypatch):
    """Bytes outside the pieces a box touches are never seen: the decoder is given them in full."""
    seen = []
    monkeypatch.setattr(T, "decode_cells", lambda df: seen.append(df) or df.selectExpr("tensor_id", "first_pos AS pos", "0.0D AS value"))
    tensors = frame([(1, [1000, 10], "float64", bytes(80_000)), (2, [10], "float64", bytes(80))], "tensor_id bigint, shape array<bigint>, dtype string, payload binary")
    T.slice_stored(tensors, [slice(500, 505)], chunk=20)
    got = seen[0].selectExpr("first_pos", "octet_length(payload) AS n").orderBy("first_pos").collect()
    assert [tuple(r) for r in got] == [(5000, 160), (5020, 160), (5040, 80)]


def test_one_rule_for_rejects(frame, rows):
    four, odd = np.arange(4, dtype="float32").tobytes(), b"\x00" * 7
    data = [(1, "float32", [2, 3], four), (2, "double", [2], four), (3, "complex64", [2], four), (4, "int", [4], four), (5, "float32", [4], None), (6, "float32", [4], odd),
            (7, None, [4], four), (8, "float32", None, four), (9, "half", [8], four), (10, "float24", [4], four), (11, "<c8", [2], four), (12, "float32", [4], four)]
    tensors = frame([(k, d, s, p) for k, d, s, p in data], "tensor_id bigint, dtype string, shape array<bigint>, payload binary")
    rejects = {r.tensor_id for r in T.undecodable(tensors).collect()}
    assert rejects == {1, 3, 4, 5, 6, 7, 8, 10, 11}
    assert {r.tensor_id for r in T.decode_cells(tensors).select("tensor_id").distinct().collect()} == {2, 9, 12}


def test_run_lengths(frame, rows):
    sequence = frame([("k", i, v) for i, v in enumerate("AAABBA")] + [("n", i, None) for i in range(2)], "k string, i int, v string")
    runs = T.rle_encode(sequence, ["k"], ["i"], "v")
    assert rows(runs, "k", "run", "v", "length") == [("k", 1, "A", 3), ("k", 2, "B", 2), ("k", 3, "A", 1), ("n", 1, None, 2)]
    assert rows(T.rle_decode(runs, ["k"], "v"), "k", "pos", "v") == rows(sequence, "k", "i", "v")


def test_long_runs_are_cut(frame, monkeypatch):
    monkeypatch.setattr(T, "PIECE", 10)
    decoded = T.rle_decode(frame([("k", 1, "a", 25), ("k", 2, "b", 7)], "k string, run int, v string, length bigint"), ["k"], "v")
    assert [(r.pos, r.v) for r in decoded.orderBy("pos").collect()] == [(i, "a" if i < 25 else "b") for i in range(32)]


def test_codecs(frame):
    zeros = frame([(1, bytearray(40_000))], "tensor_id bigint, payload binary")
    packed = T.compress_tensors(zeros)
    report = T.compression_report(packed, []).first()
    assert (report.original_size, report.compressed_size, report.size_ratio, report.compression_factor) == (40_000, 20, 0.0005, 2000.0)
    assert bytes(T.decompress_tensors(packed).first().payload) == bytes(40_000)
    sizes = T.compare_codecs(zeros, []).first()
    assert (sizes.rle_size, sizes.zstd_size) == (8, 20)
    assert T.rle_size(b"") == 0 and T.rle_size(b"aaaabbbbc") == 24


def test_decompress_needs_a_frame(frame):
    with pytest.raises(Exception, match="(?i)zstd"):
        T.decompress_tensors(frame([(1, bytearray(b"plain"))], "tensor_id bigint, payload binary")).collect()


def test_route(frame, rows):
    mb = 1 << 20
    assert rows(T.route_by_size(frame([("x", 60 * mb), ("x", 40 * mb), ("y", int(100.1 * mb))], "b string, n_bytes bigint"), ["b"]), "b", "path") == [("x", "B"), ("y", "A")]


def test_generate(frame, rows):
    cells = T.generate_tensors(frame([(1, "identity", 2), (2, "zeros", 1), (3, "other", 2), (4, None, None)], "tensor_id bigint, kind string, size int"), seed=1)
    assert rows(cells.filter("tensor_id < 3"), "tensor_id", "pos", "value") == [(1, 0, 1.0), (1, 1, 0.0), (1, 2, 0.0), (1, 3, 1.0), (2, 0, 0.0)]
    assert cells.filter("tensor_id = 4").count() == 10_000
    random = cells.filter("tensor_id = 3")
    assert rows(random) == rows(random.repartition(3)) and random.select("value").distinct().count() > 2


def test_grid(frame, rows):
    grid = T.task_grid(frame([(0, 100), (1, 200)], "size_order int, size int"))
    assert rows(grid, "task_id", "size", "kind") == sorted([(f"task_{i}", s, k) for i, (s, k) in enumerate((s, k) for s in (100, 200) for k in ("random", "identity", "zeros"))], key=repr)


def test_tensor_udf_may_change_shape(frame):
    array = np.arange(6, dtype="int16").reshape(2, 3)
    row = T.apply_tensor_udf(frame([(1, [2, 3], "int16", bytearray(array.tobytes()))], "tensor_id bigint, shape array<bigint>, dtype string, payload binary"), lambda a: a.T.astype("float64")).first()
    assert row.shape == [3, 2] and row.dtype == "float64" and bytes(row.payload) == np.ascontiguousarray(array.T.astype("float64")).tobytes()


# Layout --------------------------------------------------------------------------------------------------------------

@pytest.fixture
def letters(frame):
    return frame([(1, bytearray(b"ABCDEFGHIJ")), (2, bytearray(b""))], "file_id bigint, payload binary")


def test_parity_golden(letters, rows):
    chunks = L.chunk_payload(letters, 4)
    assert [bytes(r.chunk) for r in chunks.orderBy("chunk_index").collect()] == [b"ABCD", b"EFGH", b"IJ"]
    groups = L.parity_groups(chunks, 3, 4)
    placed = L.place_parity(groups, 3)
    assert rows(placed, "group_index", "is_parity", "chunk_index", "shard_id", "is_pad") == sorted(
        [(0, False, 0, 0, False), (0, False, 1, 1, False), (0, True, 2, 2, False), (1, False, 2, 2, False), (1, False, 3, 0, True), (1, True, 4, 1, False)], key=repr)
    assert [bytes(r.parity).hex().upper() for r in L.xor_parity(groups).orderBy("group_index").collect()] == ["0404040C", "494A"]


@pytest.mark.parametrize("size, n", [(4, 3), (3, 4), (1, 2), (7, 5), (64, 3)])
def test_file_parity_equals_group_parity(frame, rows, size, n):
    files = frame([(i, bytearray(os.urandom(3 * i))) for i in range(12)], "file_id bigint, payload binary")
    grouped = L.xor_parity(L.parity_groups(L.chunk_payload(files, size), n, size))
    assert rows(L.file_parity(files, n, size)) == rows(grouped)


@pytest.mark.parametrize("lost", [0, 1, 2])
def test_rebuild_any_chunk(letters, lost):
    chunks = pinned(L.chunk_payload(letters, 4))
    files = chunks.select("file_id", "n_bytes", "n_chunks").distinct()
    left = chunks.filter(F.col("chunk_index") != lost)
    rebuilt = L.rebuild_chunk(files, left, L.file_parity(letters, 3, 4), 3, 4).collect()
    assert [(r.chunk_index, bytes(r.chunk)) for r in rebuilt] == [(lost, [b"ABCD", b"EFGH", b"IJ"][lost])]


def test_two_lost_chunks_stay_lost(letters):
    chunks = L.chunk_payload(letters, 4)
    files = chunks.select("file_id", "n_bytes", "n_chunks").distinct()
    rebuilt = L.rebuild_chunk(files, chunks.filter("chunk_index > 1"), L.file_parity(letters, 3, 4), 3, 4)
    assert rebuilt.count() == 0
    assert L.assemble(chunks.filter("chunk_index > 1")).first().complete is False
    assert bytes(L.assemble(chunks).first().payload) == b"ABCDEFGHIJ"


def test_mirror(frame, rows):
    results = frame([(1, "mirror", True), (1, "mirror", False), (1, "mirror", False), (2, "mirror", False), (3, "stripe", True), (3, "stripe", False)], "file_id int, layout string, ok boolean")
    assert rows(L.mirror_quorum(results), "file_id", "success") == [(1, True), (2, True), (3, False)]
    replicas = frame([(1, 0, False, bytearray(b"x")), (1, 2, True, bytearray(b"c")), (1, 1, True, bytearray(b"b")), (2, 0, False, bytearray(b"d"))], "file_id int, shard_id int, ok boolean, payload binary")
    assert rows(L.read_mirror(replicas), "file_id", "shard_id", "payload") == [(1, 1, bytearray(b"b")), (2, None, None)]


SHARDS = "shard_id bigint, capacity_gb double, used_gb double"


def test_shards(frame, rows):
    three = frame([(i, 1000.0, 0.0) for i in range(3)], SHARDS)
    assert [L.effective_capacity(three, level).first()[0] for level in (0, 1, 5, 9)] == [3000.0, 1500.0, 2000.0, 3000.0]
    assert L.effective_capacity(three.limit(0), 5).first()[0] == 0.0
    assert L.usage_imbalance(frame([(1, 100.0, 10.0), (2, 100.0, 31.0)], SHARDS)).first().rebalance is True
    assert L.usage_imbalance(frame([(1, 100.0, 10.0), (2, 100.0, 30.0)], SHARDS)).first().rebalance is False
    assert rows(L.shard_usage(frame([(1, 0.0, 0.0)], SHARDS)), "shard_id", "usage_percent") == [(1, 0.0), (None, 0.0)]
    demands = frame([("a", 5.0), ("b", 95.0)], "demand string, size_gb double")
    assert rows(L.best_shard(frame([(2, 100.0, 10.0), (1, 100.0, 10.0), (3, 100.0, 50.0)], SHARDS), demands), "demand", "shard_id") == [("a", 1), ("b", None)]


def test_segments(frame, rows):
    buffers = frame([(i, n) for i, n in enumerate([5, 7, 2, 4])], "i int, length bigint")
    laid = L.segment_layout(buffers, 2, ["i"])
    assert rows(laid, "seq", "path_no", "offset", "length") == [(0, 0, 0, 5), (1, 1, 0, 7), (2, 0, 5, 2), (3, 1, 7, 4)]
    paths = frame([(0,), (1,)], "path_no bigint")
    assert L.load_aware_pick(laid.withColumn("speed", F.lit(0.0)).limit(0), paths).first().path_no == 0
    fast = laid.withColumn("speed", F.col("path_no") * 1.0)
    assert L.load_aware_pick(fast, paths).first().path_no == 1
    assert rows(L.segment_speed(fast.filter("path_no = 1"), paths)) == [(0, 0.0), (1, 1.0)]


# Recovery ------------------------------------------------------------------------------------------------------------

def test_wal_resolution(frame, rows):
    wal = frame([(1, 0, 10, '{"a": 1, "b": 2}'), (1, 10, 5, "{}"), (1, 15, 5, '{"b": 1}'), (2, 0, 10, '{"b": 2, "a": 1}'), (3, 15, 5, '{"b": 1}')], "op int, offset bigint, length bigint, meta string")
    assert rows(R.uncommitted(wal), "offset") == [(10,), (15,)]
    assert rows(R.unresolved(wal), "offset") == [(10,)]


@pytest.mark.parametrize("split", [1, 3])
def test_wal_in_one_pass(frame, rows, split):
    """One scan, one exchange; a key with a null in it is resolved by nothing; a hot key in parts loses and keeps the same rows."""
    hot = [(1, 7, 7, '{"a": [1, {"y": 1, "x": 2}]}', i) for i in range(200)] + [(2, 7, 7, '{"a":[1.0,{"x":2,"y":1}]}', 0)]
    odd = [(1, 1, 1, None, 1), (2, 1, 1, None, 1), (1, None, 1, "{}", 2), (2, None, 1, "{}", 2), (1, 3, 1, "no json", 3), (2, 3, 1, "no json", 3), (9, 4, 1, "{}", 4), (1, 4, 1, "{}", 5), (3, 4, 1, "{}", 5)]
    wal = frame(hot + odd, "op int, offset bigint, length bigint, meta string, n int")
    left = R.uncommitted(wal, split=split)
    assert left.columns == wal.columns and rows(left.select("n"), "n") == [(1,), (2,), (5,)]
    assert rows(R.unresolved(wal, split=split).select("n"), "n") == [(1,), (2,)]
    plan = left._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Scan") == 1 and "Join" not in plan


def test_duplicates_go_together(frame):
    wal = frame([(2, 1, 1, "{}"), (1, 1, 1, "{}"), (1, 1, 1, "{}"), (1, 2, 1, "{}"), (1, 2, 1, "{}")], "op int, offset bigint, length bigint, meta string")
    assert R.uncommitted(wal).count() == 2


def test_checkpoints(spark, tmp_path, frame, rows):
    path = str(tmp_path / "ck")
    for version in range(5):
        logs.save_checkpoint(frame([(json.dumps({"version": version}),)], "payload string"), path, version, ts=float(version))
    saved = logs.read_checkpoints(spark, path)
    kept = R.rotate(saved, 3)
    assert rows(kept, "version") == [(2,), (3,), (4,)]
    assert R.load_checkpoint(kept).first().payload == '{"version": 4}'
    spoiled = kept.withColumn("payload", F.when(F.col("version") == 4, "corrupted data").otherwise(F.col("payload")))
    assert R.load_checkpoint(spoiled).first().version == 3
    assert R.checkpoint_info(spoiled).first().ts == 3.0
    assert R.load_checkpoint(kept.withColumn("payload", F.lit("corrupted data"))).count() == 0


def test_one_spoiled_row_spoils_its_version(spark, tmp_path, frame, rows):
    path = str(tmp_path / "ck")
    for version in (1, 2):
        logs.save_checkpoint(frame([(f"{part}{version}",) for part in "abc"], "payload string"), path, version, ts=float(version))
    saved = logs.read_checkpoints(spark, path)
    assert rows(R.load_checkpoint(saved), "payload") == [("a2",), ("b2",), ("c2",)]
    spoiled = saved.withColumn("payload", F.when(F.col("payload") == "b2", "x").otherwise(F.col("payload")))
    assert rows(R.load_checkpoint(spoiled), "payload") == [("a1",), ("b1",), ("c1",)]
    assert rows(R.checkpoint_info(spoiled), "version") == [(1,)]


def test_half_written_version_is_not_read(spark, tmp_path, frame, rows):
    path = str(tmp_path / "ck")
    logs.save_checkpoint(frame([("a",)], "payload string"), path, 1, ts=1.0)
    logs.save_checkpoint(frame([("b",), ("c",)], "payload string").repartition(2), path, 2, ts=2.0)
    assert rows(logs.read_checkpoints(spark, path), "version") == [(1,), (2,), (2,)]
    next((tmp_path / "ck" / "version=2").glob("*.parquet")).rename(tmp_path / "late.parquet")
    assert rows(logs.read_checkpoints(spark, path), "version") == [(1,)]


def test_canonical_meta(frame, rows):
    texts = [('{"b": 1, "a": {"z": 1, "y": [2, "3"]}}',), ('{"a":{"y":[2,"3"],"z":1},"b":1}',), ('{"a": "1"}',), ('{"a": 1}',), ("no json",)]
    keys = [k for k, in frame(texts, "meta string").select(R.canonical_json("meta")).collect()]
    assert keys[0] == keys[1] and keys[2] != keys[3] and keys[4] == "no json"


def test_restore(frame, rows):
    saved = frame([(1001, "alive"), (1002, "alive")], "worker_id bigint, health string")
    restored = R.restore_health(saved, frame([(1001,), (7,)], "worker_id bigint"))
    assert sorted(rows(restored)) == [(7, "restarted"), (1001, "restarted"), (1002, "alive")]


def test_restore_whole_state(frame, rows):
    """Tasks, buffers and health come back from the newest version that is not spoiled; odd payloads give what they can."""
    import hashlib
    good = '{"active_tasks": ["task1", "task2"], "buffer_usage": {"1001": 2}, "process_health": {"1001": "alive", "1002": "alive"}}'
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    data = [("a", 1, "{}", sha("{}")), ("a", 2, good, sha(good)), ("a", 3, "{}", "spoiled"), ("b", 1, "{}", "spoiled"), ("c", 1, "no json", sha("no json")),
            ("d", 1, '{"active_tasks": 5, "buffer_usage": {"7": 1}}', sha('{"active_tasks": 5, "buffer_usage": {"7": 1}}'))]
    saved = frame(data, "store string, version bigint, payload string, checksum string")
    failures = frame([("a", 1002), ("b", 4), ("b", 4)], "store string, worker_id bigint")
    assert rows(R.restore_state(saved, failures, ["store"])) == [
        ("a", "active_tasks", "task1", "0"), ("a", "active_tasks", "task2", "1"), ("a", "buffer_usage", "1001", "2"),
        ("a", "process_health", "1001", "alive"), ("a", "process_health", "1002", "restarted"), ("b", "process_health", "4", "restarted"), ("d", "buffer_usage", "7", "1")]


def test_observed_writes(spark, frame, tmp_path):
    writes = frame([(1, b"abc", True), (2, b"", True), (3, b"xx", False), (4, None, True), (5, b"y", None)], "tensor_id bigint, payload binary, ok boolean")
    totals = containers.write_observed(writes, str(tmp_path / "out"))
    stored = spark.read.parquet(str(tmp_path / "out"))
    assert totals == {"total_writes": 3, "total_bytes_written": 3, "failed_writes": 2}
    assert (stored.count(), stored.selectExpr("sum(octet_length(payload))").first()[0]) == (3, 3)
    assert containers.write_observed(writes.limit(0), str(tmp_path / "none")) == {"total_writes": 0, "total_bytes_written": 0, "failed_writes": 0}


def test_recovery_timeline(frame, rows):
    log = frame([(1.0, 1, "Process 7 unresponsive", None), (2.0, 2, "Process 7 restarted", None), (3.0, 3, "Restored state", 4), (4.0, 4, "Checkpoint saved", 4), (5.0, 5, "hello", 4)],
                "ts timestamp, seq bigint, message string, worker_id bigint", ["ts"])
    assert rows(R.recovery_events(log), "seq", "event", "worker_id") == [(1, "failure", 7), (2, "restart", 7), (3, "restore", 4), (4, "checkpoint", 4)]


def test_zstd_frames():
    """All frames of a payload count, and a cut frame fails."""
    import pytest
    import zstandard

    from arrayflow.operators.tensors import _whole_frames
    one, two = (zstandard.ZstdCompressor().compress(p) for p in (b"a" * 5000, b""))
    assert _whole_frames(one + two + one) == b"a" * 10000 and _whole_frames(two) == b""
    for cut in (one[:-1], one + one[:5], b""):
        with pytest.raises(ValueError):
            _whole_frames(cut)
