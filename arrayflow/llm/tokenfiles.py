"""Token ids in files: a static range asymmetric numeral system over independent interleaved blocks.

A segment is a row of the written files: whole documents in ascending id order, a frequency table that all its blocks
share, and the blocks. A block holds ``BLOCK`` ids in ``LANES`` interleaved states whose 32-bit words form one stream; it
starts from its own states, so any block can be decoded alone. Per block there is a checkpoint (place of its first id in the
range of documents, place of its words) and a checksum of its ids. Segments and blocks are decoded in parallel.

Segment layout, little-endian: magic ``RSEG``, u32 version, u32 bytes of the table, u32 blocks, u32 documents; the table
(zlib: u32 entries, then ids and frequencies as u32); per document u64 count of ids; per block u64 place of its first id,
u32 ids, u32 word offset, u32 words, u32 CRC-32 of its ids, ``LANES`` u64 states; then all words as u32.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arrayflow.llm.common import id_bounds, parallelism, range_number, whole_text
from arrayflow.llm.packing import END
from arrayflow.llm.tokens import encoder
from arrayflow.session import scratch_path

MAGIC, VERSION = b"RSEG", 2
LANES, STEPS = 64, 256
BLOCK = LANES * STEPS
#: Ids after which a segment is closed, and blocks that are worked on at once.
SEGMENT, AT_ONCE = 1 << 22, 64
SCALE = 20
_LOW, _MASK, _WORD = np.uint64(1 << 31), np.uint64((1 << SCALE) - 1), np.uint64(32)
_HEAD = struct.Struct("<4sIIII")
_MARK = np.dtype([("first", "<u8"), ("ids", "<u4"), ("at", "<u4"), ("words", "<u4"), ("crc", "<u4"), ("states", "<u8", (LANES,))])
SEGMENTS = "part int, first_id bigint, docs int, ids bigint, doc_ids array<bigint>, payload binary"


class Table:
    """Frequencies of sorted ``ids``, scaled to sum to 2**SCALE with at least 1 each."""

    def __init__(self, ids: np.ndarray, scaled: np.ndarray):
        size = int(ids[-1]) + 1 if len(ids) else 1
        full = np.zeros(size, np.int64)
        full[ids] = scaled
        self.ids, self.scaled = ids, scaled
        self.freq = full.astype(np.uint64)
        self.start = (np.cumsum(full) - full).astype(np.uint64)
        self.symbol = np.repeat(ids.astype(np.uint32), scaled)
        self.filler = int(ids[scaled.argmax()]) if len(ids) else 0

    @classmethod
    def count(cls, ids: np.ndarray) -> Table:
        """The table of what occurs in ``ids``."""
        counts = np.bincount(ids)
        used = np.flatnonzero(counts)
        if len(used) > 1 << SCALE:
            raise ValueError("more distinct ids than the table has room for")
        scaled = np.maximum(1, counts[used] * (1 << SCALE) // max(len(ids), 1))
        gap = (1 << SCALE) - int(scaled.sum())
        for at in np.argsort(-scaled, kind="stable"):
            give = max(gap, 1 - int(scaled[at]))
            scaled[at] += give
            gap -= give
            if not gap:
                break
        return cls(used, scaled)

    def packed(self) -> bytes:
        return zlib.compress(b"".join(np.asarray(x).astype("<u4").tobytes() for x in ([len(self.ids)], self.ids, self.scaled)))

    @classmethod
    def unpacked(cls, data: bytes) -> Table:
        numbers = np.frombuffer(zlib.decompress(data), "<u4").astype(np.int64)
        return cls(numbers[1:numbers[0] + 1], numbers[numbers[0] + 1:])


def encode_blocks(ids: np.ndarray, table: Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``ids`` of shape (blocks, steps, LANES): final states, words of all blocks one after the other, words per block."""
    blocks, steps, _ = ids.shape
    state = np.full((blocks, LANES), _LOW, np.uint64)
    words, owners, numbers = [], [], np.arange(blocks, dtype=np.min_scalar_type(blocks))  # small numbers sort by their digits
    for step in range(steps - 1, -1, -1):
        freq, start = table.freq[ids[:, step]], table.start[ids[:, step]]
        over = state >= freq << np.uint64(63 - SCALE)
        words.append((state[over] & np.uint64(0xFFFFFFFF)).astype("<u4"))
        owners.append(np.repeat(numbers, over.sum(1)))
        state = np.where(over, state >> _WORD, state)
        whole = state // freq
        state = (whole << np.uint64(SCALE)) + (state - whole * freq) + start
    owner = np.concatenate(owners[::-1])
    order = np.argsort(owner, kind="stable")
    return state, np.concatenate(words[::-1])[order], np.bincount(owner, minlength=blocks)


def decode_blocks(state: np.ndarray, words: np.ndarray, at: np.ndarray, steps: int, table: Table) -> np.ndarray:
    """Ids of shape (blocks, steps, LANES); block ``i`` reads its words from ``at[i]`` on."""
    state, at, words = state.copy(), at.astype(np.int64), words.astype(np.uint64)
    out = np.empty((len(state), steps, LANES), np.uint32)
    for step in range(steps):
        slot = state & _MASK
        symbol = table.symbol[slot.astype(np.int64)]
        out[:, step] = symbol
        state = table.freq[symbol] * (state >> np.uint64(SCALE)) + slot - table.start[symbol]
        need = state < _LOW
        turn = np.cumsum(need, axis=1)
        place = (at[:, None] + turn - 1)[need]
        state[need] = (state[need] << _WORD) | words[place]
        at += turn[:, -1]
    return out


def encode_segment(counts: list[int], ids: np.ndarray, first: int) -> bytes:
    """Whole documents with ``counts`` ids each; ``first`` is the place of the first id."""
    table = Table.count(ids)
    packed = table.packed()
    marks, words = np.zeros(-(-len(ids) // BLOCK), _MARK), []
    total = 0
    for low in range(0, len(marks), AT_ONCE):
        part = ids[low * BLOCK:(low + AT_ONCE) * BLOCK]
        # The last block may be short: it has as many steps as its ids need, filled with the likeliest id.
        for chunk, offset in ((part[:len(part) // BLOCK * BLOCK], low), (part[len(part) // BLOCK * BLOCK:], low + len(part) // BLOCK)):
            if not len(chunk):
                continue
            fill = -len(chunk) % LANES
            steps = min(STEPS, (len(chunk) + fill) // LANES)
            shaped = np.concatenate([chunk, np.full(fill, table.filler, chunk.dtype)]).reshape(-1, steps, LANES)
            state, stream, sizes = encode_blocks(shaped, table)
            for i, size in enumerate(sizes.tolist()):
                own = chunk[i * BLOCK:(i + 1) * BLOCK]
                marks[offset + i] = (first + (offset + i) * BLOCK, len(own), total, size, zlib.crc32(own.astype("<u4").tobytes()), state[i])
                total += size
            words.append(stream)
    head = _HEAD.pack(MAGIC, VERSION, len(packed), len(marks), len(counts))
    return b"".join([head, packed, np.array(counts, "<u8").tobytes(), marks.tobytes(), *(w.tobytes() for w in words)])


def decode_segment(payload: bytes) -> tuple[int, list[int], np.ndarray]:
    """Place of the first id, ids per document, and all ids; fails on foreign data or a damaged block."""
    magic, version, size, blocks, docs = _HEAD.unpack_from(payload)
    if magic != MAGIC or version != VERSION:
        raise ValueError("not a segment")
    at = _HEAD.size + size
    table = Table.unpacked(payload[_HEAD.size:at])
    counts = np.frombuffer(payload, "<u8", docs, at)
    marks = np.frombuffer(payload, _MARK, blocks, at + 8 * docs)
    words = np.frombuffer(payload, "<u4", offset=at + 8 * docs + blocks * _MARK.itemsize)
    out = []
    for low in range(0, blocks, AT_ONCE):
        part = marks[low:low + AT_ONCE]
        for own in (part[part["ids"] == BLOCK], part[part["ids"] < BLOCK]):
            if len(own):
                steps = -(-int(own["ids"][0]) // LANES)
                ids = decode_blocks(own["states"].astype(np.uint64), words, own["at"], steps, table).reshape(len(own), -1)
                for row, mark in zip(ids, own, strict=True):
                    if zlib.crc32(row[:mark["ids"]].astype("<u4").tobytes()) != mark["crc"]:
                        raise ValueError(f"block at id {mark['first']} is damaged")
                    out.append(row[:mark["ids"]])
    return int(marks[0]["first"]) if blocks else 0, counts.astype(int).tolist(), np.concatenate(out) if out else np.zeros(0, np.uint32)


def write_ids(docs: DataFrame, tokenizer: str, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the ids of all texts, each followed by id 0, in ascending order of ``id_col`` (null first, repeated ids by text).

    A null text counts as empty. Segments go to ``path`` through Spark's writer, so any shared store will do. Texts move once,
    into ranges of ids, and are encoded where they arrive; places count from the start of a range (``part``), and the ranges'
    sizes, which stand beside them, give the places in the corpus.
    """
    rows = docs.select(docs[id_col].cast("bigint").alias("id"), whole_text(docs, text_col).alias("text"))
    bounds = id_bounds(rows, "id", 4 * parallelism(docs.sparkSession))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, place = encoder(tokenizer), None, 0
        held: list[tuple[int | None, bytes]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, size, place
            ids = np.frombuffer(b"".join(d for _, d in held), "<u4")
            payload = encode_segment([len(d) // 4 for _, d in held], ids, place)
            row = pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([held[0][0]], pa.int64()), pa.array([len(held)], pa.int32()),
                 pa.array([len(ids)], pa.int64()), pa.array([[k for k, _ in held]], pa.list_(pa.int64())), pa.array([payload], pa.binary())],
                ["part", "first_id", "docs", "ids", "doc_ids", "payload"])
            place += len(ids)
            held, size = [], 0
            return row

        for batch in batches:
            parts, ids, texts = (c.to_pylist() for c in batch.columns)
            for own, key, data in zip(parts, ids, encode(texts), strict=True):
                if own != part:
                    if held:
                        yield flush()
                    part, place = own, 0
                held.append((key, data + END))
                size += len(data) // 4 + 1
                if size >= SEGMENT:
                    yield flush()
        if held:
            yield flush()

    parts = len(bounds) + 1
    dealt = rows.select(range_number(bounds, F.col("id")).alias("part"), "id", "text").repartition(parts, "part")
    dealt.sortWithinPartitions("part", "id", "text").mapInArrow(write, SEGMENTS).write.parquet(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the files: ``doc_id, start, n_tokens, ids_crc32, ids`` (ids as little-endian u32 bytes).

    Drop ``ids`` where they are not needed. Blocks are checked against their checksums.
    """
    files = spark.read.parquet(path)
    # One row per range of documents, as many as the writer had tasks.
    offsets, at = {}, 0
    for part, n in sorted((r["part"], r["n"]) for r in files.groupBy("part").agg(F.sum("ids").alias("n")).collect()):
        offsets[part], at = at, at + n

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, keys, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                start, counts, ids = decode_segment(payload)
                start += offsets[part]
                data, rows, at = ids.astype("<u4").tobytes(), [], 0
                for key, n in zip(keys, counts, strict=True):
                    own = data[4 * at:4 * (at + n)]
                    rows.append((key, start + at, n, zlib.crc32(own), own))
                    at += n
                for low in range(0, len(rows), 1000):
                    columns = zip(*rows[low:low + 1000], strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if i == 4 else pa.int64()) for i, c in enumerate(columns)],
                                                     ["doc_id", "start", "n_tokens", "ids_crc32", "ids"])

    return files.select("part", "doc_ids", "payload").mapInArrow(
        read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint, ids binary")


def round_trip(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the ids of ``docs`` into the shared folder and read them back. An empty table gives an empty result."""
    path = scratch_path(docs.sparkSession, "token-ids")
    write_ids(docs, tokenizer, path, id_col, text_col)
    return read_ids(docs.sparkSession, path)
