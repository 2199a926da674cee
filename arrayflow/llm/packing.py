"""Best-fit packing of documents into sequences by linear grouping.

Only the histogram of lengths (at most one row per length up to the capacity) reaches the driver. There, long pieces are
cut into groups of equal cardinality and rounded up to their group's longest; a linear programme over the configurations
of these few sizes is solved by column generation; actual lengths are substituted into its sequences, which leaves them
a little more room; everything else, longest first, goes where it fits best. All this works on runs of equal sequences,
so that its cost depends on the capacity and not on the number of documents. The executors then only look up the place of
the r-th piece of a length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arrayflow.llm.common import parallelism, pinned, ranked, whole_text
from arrayflow.llm.tokens import encoder

END = b"\0\0\0\0"
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, text_hash bigint"


def cut_pieces(docs: DataFrame, tokenizer: str, capacity: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token pieces of at most ``capacity`` ids: ``doc_id, piece, start, length, ids_crc32, text_hash``.

    A document is its text's ids and one id 0 after them; a null text counts as empty, so that every row has a piece.
    """
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in batches:
            ids, texts, hashes = (c.to_pylist() for c in batch.columns)
            rows = []
            for key, data, mark in zip(ids, encode(texts), hashes, strict=True):
                data += END
                for piece, at in enumerate(range(0, len(data), 4 * capacity)):
                    part = data[at:at + 4 * capacity]
                    rows.append((key, piece, at // 4, len(part) // 4, zlib.crc32(part), mark))
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int32() if i == 1 else pa.int64()) for i, c in enumerate(columns)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "text_hash"])

    text = whole_text(docs, text_col)
    return docs.select(docs[id_col].cast("bigint").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("h")).mapInArrow(cut, PIECES)


def best_patterns(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 2000) -> list[tuple[np.ndarray, int]]:
    """Configurations of ``sizes`` and how often to use each: the column-generation optimum, rounded down."""
    k = len(sizes)
    basis = np.diag((capacity // sizes).astype(float))
    most = int(capacity // sizes.min())
    at = np.arange(capacity + 1)
    source = at[None, :] - sizes[:, None]
    fits = source >= 0
    source = np.where(fits, source, 0)
    for _ in range(rounds):
        value = np.linalg.solve(basis.T, np.ones(k))
        layers, best = [], np.zeros(capacity + 1)
        for _ in range(most):
            options = np.where(fits, best[source] + value[:, None], -1.0)
            pick = options.argmax(0)
            top = options[pick, at]
            better = top > best + 1e-12
            layers.append(np.where(better, pick, -1))
            best = np.where(better, top, best)
        if best[capacity] <= 1 + 1e-7:
            break
        column, room = np.zeros(k), capacity
        for layer in reversed(layers):
            if layer[room] >= 0:
                column[layer[room]] += 1
                room -= sizes[layer[room]]
        use, move = np.linalg.solve(basis, demand), np.linalg.solve(basis, column)
        with np.errstate(divide="ignore", invalid="ignore"):
            limit = np.where(move > 1e-9, use / move, np.inf)
        basis[:, limit.argmin()] = column
    use = np.linalg.solve(basis, demand)
    patterns = [(basis[:, i].astype(int), int(np.floor(use[i] + 1e-9))) for i in range(k)]
    # Rounding errors must not use more pieces than there are.
    left, safe = demand.astype(int).copy(), []
    for pattern, times in patterns:
        used = pattern > 0
        times = min(times, int((left[used] // pattern[used]).min()))
        if times > 0:
            left -= times * pattern
            safe.append((pattern, times))
    return safe


def plan_packing(histogram: Mapping[int, int], capacity: int, groups: int = 256, large_above: int | None = None) -> np.ndarray:
    """The plan with the fewest sequences over the given or a few values of ``large_above``, the longest piece called small.

    Runs ``(length, first rank, count, first sequence, offset)``: piece ``first rank + i`` of a length lies in sequence
    ``first sequence + i`` at ``offset``, for ``i < count``; sorted by length and rank."""
    tried = [capacity // 2, capacity // 3] if large_above is None else [large_above]
    plans = [_plan(histogram, capacity, groups, above) for above in tried]
    return min(plans, key=lambda runs: int((runs[:, 3] + runs[:, 2]).max()) if len(runs) else 0)


def _plan(histogram: Mapping[int, int], capacity: int, groups: int, large_above: int) -> np.ndarray:
    bins: list[tuple[int, int, tuple[tuple[int, int], ...]]] = []  # (sequences, room, their pieces as (length, first rank))
    large = sorted((n for n in histogram if n > large_above and n < capacity), reverse=True)
    total = sum(histogram[n] for n in large)
    if total:
        # Positions in descending order of length; a group is a range of positions.
        ends = np.cumsum([histogram[n] for n in large])
        if len(large) <= groups:
            cuts = np.concatenate([[0], ends])
        else:
            cuts = np.unique(np.linspace(0, total, groups + 1).astype(np.int64))
        sizes = np.array([large[int(np.searchsorted(ends, c, side="right"))] for c in cuts[:-1]])
        # Groups of one rounded size are one size.
        first = np.flatnonzero(np.concatenate([[True], sizes[1:] != sizes[:-1]]))
        sizes, cuts = sizes[first], np.append(cuts[:-1][first], total)
        at = cuts[:-1].astype(int).tolist()
        for pattern, times in best_patterns(sizes, np.diff(cuts).astype(float), capacity):
            slots = []
            for g in np.flatnonzero(pattern):
                for _ in range(pattern[g]):
                    slots.append(at[g])
                    at[g] += times
            # Substitute actual lengths: a run of sequences ends where one of its slots meets another length.
            done = 0
            while done < times:
                where = [int(np.searchsorted(ends, s + done, side="right")) for s in slots]
                step = min(times - done, *(int(ends[w]) - s - done for w, s in zip(where, slots, strict=True)))
                pieces = tuple((large[w], s + done - (int(ends[w - 1]) if w else 0)) for w, s in zip(where, slots, strict=True))
                bins.append((step, capacity - sum(n for n, _ in pieces), pieces))
                done += step
        # What the rounded-down programme leaves: the end of every group.
        rest = [(int(a), int(b)) for a, b in zip(at, cuts[1:], strict=True)]
    else:
        ends, rest = np.zeros(0, np.int64), []

    todo: list[tuple[int, int, int]] = [(n, 0, histogram[n]) for n in histogram if n <= large_above or n >= capacity]
    for a, b in rest:
        while a < b:
            w = int(np.searchsorted(ends, a, side="right"))
            step = min(b, int(ends[w])) - a
            todo.append((large[w], a - (int(ends[w - 1]) if w else 0), step))
            a += step

    rooms: list[int] = []
    by_room: dict[int, list[tuple[int, tuple[tuple[int, int], ...]]]] = {}
    full: list[tuple[int, tuple[tuple[int, int], ...]]] = []

    def put(count: int, room: int, pieces: tuple[tuple[int, int], ...]) -> None:
        if count <= 0:
            return
        if room not in by_room:
            by_room[room] = []
            insort(rooms, room)
        by_room[room].append((count, pieces))

    def part(pieces: tuple[tuple[int, int], ...], skip: int) -> tuple[tuple[int, int], ...]:
        return tuple((n, r + skip) for n, r in pieces)

    for count, room, pieces in bins:
        put(count, room, pieces)
    for n, rank, left in sorted(todo, key=lambda t: (-t[0], t[1])):
        while left:
            i = bisect_left(rooms, n)
            if i == len(rooms):
                each = capacity // n
                count, room, pieces = -(-left // each), capacity, ()
            else:
                room = rooms[i]
                count, pieces = by_room[room].pop()
                if not by_room[room]:
                    del by_room[room], rooms[i]
                each = room // n
            whole = min(count, left // each)
            if whole:
                put(whole, room - each * n, pieces + tuple((n, rank + j * whole) for j in range(each)))
                rank, left = rank + whole * each, left - whole * each
            if whole < count:
                pieces, count = part(pieces, whole), count - whole
                few = min(left, each)
                if few:
                    put(1, room - few * n, pieces + tuple((n, rank + j) for j in range(few)))
                    rank, left, pieces, count = rank + few, left - few, part(pieces, 1), count - 1
                if pieces:
                    put(count, room, pieces)
    runs, sequence = [], 0
    for room in rooms:
        for count, pieces in by_room[room]:
            offset = 0
            for n, rank in pieces:
                runs.append((n, rank, count, sequence, offset))
                offset += n
            sequence += count
    return np.array(sorted(runs), np.int64).reshape(-1, 5)


def pack(pieces: DataFrame, capacity: int = 2048, groups: int = 256) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to rows with a ``length`` from 1 to ``capacity``.

    Sequences are numbered from 0 and gapless; a sequence's rows lie one after the other from offset 0. Rows of one length
    are interchangeable, so ties need no order: ``doc_id, piece`` decide. ``pieces`` should be a pinned table. An empty table
    gives an empty result.
    """
    spark = pieces.sparkSession
    histogram = {int(r["length"]): int(r["n"]) for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    if any(n < 1 or n > capacity for n in histogram):
        raise ValueError(f"lengths must lie between 1 and {capacity}")
    # Its size is bounded by the capacity: runs of equal sequences, not sequences.
    runs = spark.sparkContext.broadcast(plan_packing(histogram, capacity, groups))

    @F.pandas_udf("sequence_id bigint, offset bigint")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        table = runs.value
        scale = int(table[:, 1].max()) + 1 if len(table) else 1
        n, r = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        at = np.searchsorted(table[:, 0] * scale + table[:, 1], n * scale + np.minimum(r, scale - 1), side="right") - 1
        return pd.DataFrame({"sequence_id": table[at, 3] + r - table[at, 1], "offset": table[at, 4]})

    parts = 4 * parallelism(spark)
    spread = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(parts))
    placed = ranked(pieces, ["length"], [F.col("doc_id"), F.col("piece")], spread, "rank")
    return placed.withColumn("place", place("length", "rank")).select(*pieces.columns, "place.sequence_id", "place.offset")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenize, cut and pack whole documents; one row per piece.

    Repeated rows are packed once each and told apart by nothing else than their place. Null ids are packed under null.
    """
    return pack(pinned(cut_pieces(docs, tokenizer, capacity, id_col, text_col), "pieces"), capacity)
