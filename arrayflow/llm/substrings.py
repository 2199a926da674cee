"""Substring dedup: repeated windows of many words, found in groups of suffixes that share a part.

Suffixes matter only down to the depth of a window, so that a deep internal node is a window that starts in several
documents. Every window is dealt to the group of its least short gram, which depends on its words alone; neighbouring
windows of one group form a stretch. Groups seen in one document only hold no repeat and go at once. Equal stretches stand
for all their windows. Where a group has several different stretches, it is split further by whole windows: each different
stretch sends its windows once, however many documents have it. So a passage that a third of all documents share is a few
rows with their smallest id, summed up before any shuffle, and no group is ever gathered.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arrayflow.llm.common import pinned, shuffles_dropped, whole_text
from arrayflow.llm.shingles import WordHashes, mix, runs_of

#: Words of the short grams that groups are named by.
GRAM = 10
#: Tasks that the different stretches with one window are dealt to.
DEALS = 32
_BASE = np.uint64(0xD6E8FEB86659FD93)
_INVERSE = np.uint64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of every ``width`` consecutive values."""
    least, done = values, 1
    while done < width:
        step = min(done, width - done)
        least = np.minimum(least[:-step], least[step:])
        done += step
    return least


def stretches(words: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Group, first window, and content hash of every stretch of a document; the next stretch starts where one ends."""
    if len(words) < window:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    groups = sliding_least(runs_of(words, GRAM), window - GRAM + 1)
    first = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]]))
    ends = np.append(first[1:], len(groups)) + window - 1
    powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(words) - 1, _BASE)]))
    back = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(words) - 1, _INVERSE)]))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(words * powers)])
    content = mix((sums[ends] - sums[first]) * back[first] + (ends - first).astype(np.uint64))
    return groups[first], first, content


def _as_longs(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def _text_words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split()


def outline(rows: DataFrame, window: int) -> DataFrame:
    """``id, mark, n_words, all_sha256, groups, contents`` of rows ``id, mark, text``."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            counts, digests, groups, contents = [], [], [], []
            for text in batch.column(2).to_pylist():
                words = _text_words(text)
                group, _, content = stretches(hashes.of(words), window)
                counts.append(len(words))
                digests.append(hashlib.sha256(b" ".join(words)).hexdigest())
                groups.append(_as_longs(group))
                contents.append(_as_longs(content))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(digests, pa.string()),
                 pa.array(groups, pa.list_(pa.int64())), pa.array(contents, pa.list_(pa.int64()))],
                ["id", "mark", "n_words", "all_sha256", "groups", "contents"])
    return rows.mapInArrow(work, "id bigint, mark bigint, n_words bigint, all_sha256 string, groups array<bigint>, contents array<bigint>")


def windows_of(rows: DataFrame, window: int) -> DataFrame:
    """``grp, content, place, label`` of the windows in the stretches ``wanted`` of rows ``text, wanted``."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            found: list[tuple[np.ndarray, ...]] = []
            for text, wanted in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = hashes.of(_text_words(text))
                group, first, content = stretches(words, window)
                labels = runs_of(words, window)
                ends = np.append(first[1:], len(labels))
                for i in wanted:
                    n = ends[i] - first[i]
                    found.append((np.full(n, group[i]), np.full(n, content[i]), np.arange(n), labels[first[i]:ends[i]]))
            if found:
                group, content, place, label = (np.concatenate(c) for c in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(_as_longs(group)), pa.array(_as_longs(content)), pa.array(place.astype(np.int32)),
                                                  pa.array(_as_longs(label))], ["grp", "content", "place", "label"])
    return rows.mapInArrow(work, "grp bigint, content bigint, place int, label bigint")


REMOVED = "id bigint, n_words bigint, n_removed bigint, kept_sha256 string, spans array<struct<start:int,end:int>>, kept_text string"


def cover(rows: DataFrame, window: int, with_text: bool) -> DataFrame:
    """Apply ``flags`` (stretch number and first owner per window, or one for all) to rows ``id, text, flags``."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            out = []
            for key, text, flags in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = _text_words(text)
                _, first, _ = stretches(hashes.of(words), window)
                ends = np.append(first[1:], len(words) - window + 1)
                change = np.zeros(len(words) + 1, np.int64)
                for flag in flags:
                    at = first[flag["no"]]
                    n = ends[flag["no"]] - at
                    owners = flag["owners"]
                    starts = at + (np.arange(n) if len(owners) == 1 and n > 1 else np.flatnonzero(np.array(owners) < key))
                    np.add.at(change, starts, 1)
                    np.add.at(change, starts + window, -1)
                gone = np.cumsum(change[:-1]) > 0
                edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
                kept = b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g])
                out.append((key, len(words), int(gone.sum()), hashlib.sha256(kept).hexdigest(),
                            [{"start": a, "end": b} for a, b in edges.reshape(-1, 2).tolist()],
                            kept.decode("utf-8", "surrogatepass") if with_text else None))
            columns = list(zip(*out, strict=True)) or [[]] * 6
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                                             ["id", "n_words", "n_removed", "kept_sha256", "spans", "kept_text"])
    return rows.mapInArrow(work, REMOVED)


def remove_repeats(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """One row per input row: ``id_col, n_words, n_removed, kept_sha256, spans, kept_text``.

    A word goes if a window of ``window`` consecutive words covers it that also starts in a document with a smaller id; all
    windows are judged on the input. ``spans`` are the removed word ranges. ``kept_text`` (only ``with_text``) joins the kept
    words by single spaces and is null for documents that lose nothing. Null texts have no words. Rows with a null id neither
    lose words nor make others lose any. Repeated rows share an id, so they do not make each other lose words. An empty table
    gives an empty result.
    """
    if window < GRAM:
        raise ValueError(f"windows must have at least {GRAM} words")
    text = whole_text(docs, text_col)
    rows = docs.select(docs[id_col].cast("bigint").alias("id"), F.xxhash64(text).alias("mark"), text.alias("text"))
    # A step's shuffle files go when its table is written.
    with shuffles_dropped(docs.sparkSession):
        outlines = pinned(outline(rows, window), "outlines")
        own = outlines.where("id IS NOT NULL").select("id", "mark", F.posexplode(F.arrays_zip("groups", "contents")).alias("no", "s")).select(
            "id", "mark", "no", F.col("s.groups").alias("grp"), F.col("s.contents").alias("content"))
        contents = own.groupBy("grp", "content").agg(F.min("id").alias("low"), F.max("id").alias("high"))
        # Groups of one document go; where all documents of a group have the same stretch, the smallest id owns all its windows.
        groups = contents.groupBy("grp").agg(F.count(F.lit(1)).alias("kinds"), F.min("low").alias("least"), F.max("high").alias("most")).where("least < most")
        repeated = pinned(contents.join(groups.select("grp", "kinds"), "grp"), "stretches")

        split = repeated.where("kinds > 1")
        senders = own.join(split.select("grp", "content", F.col("low").alias("id")), ["grp", "content", "id"]).groupBy("id", "mark").agg(
            F.collect_list("no").alias("wanted"))
        sent = windows_of(rows.join(senders, ["id", "mark"]).select("text", "wanted"), window).dropDuplicates(["grp", "content", "place"])
        sent = pinned(sent.join(split.select("grp", "content", "low"), ["grp", "content"]), "windows")
        # A window that many different stretches share is dealt to several tasks, which exchange one row each.
        sent = sent.withColumn("deal", F.pmod("content", F.lit(DEALS)))
        dealt = sent.groupBy("grp", "label", "deal").agg(F.min("low").alias("low"))
        owners = dealt.groupBy("grp", "label").agg(F.min("low").alias("owner"))
        told = dealt.select("grp", "label", "deal").join(owners, ["grp", "label"])
        by_window = sent.join(told, ["grp", "label", "deal"]).groupBy("grp", "content").agg(
            F.array_sort(F.collect_list(F.struct("place", "owner"))).alias("w"), F.min("owner").alias("first"))
        owned = repeated.where("kinds = 1").select("grp", "content", F.array("low").alias("owners"), F.col("low").alias("first")).union(
            by_window.select("grp", "content", F.col("w.owner").alias("owners"), "first"))
        flags = own.join(owned, ["grp", "content"]).where("first < id").groupBy("id", "mark").agg(
            F.collect_list(F.struct("no", "owners")).alias("flags"))
        flags = pinned(flags, "flags")
    changed = cover(rows.join(flags, ["id", "mark"]).select("id", "text", "flags"), window, with_text)
    same = outlines.join(flags.select(F.col("id").alias("_id"), F.col("mark").alias("_mark")),
                         F.expr("id = _id AND mark = _mark"), "left_anti").select(
        "id", "n_words", F.lit(0).cast("bigint").alias("n_removed"), F.col("all_sha256").alias("kept_sha256"),
        F.array().cast("array<struct<start:int,end:int>>").alias("spans"), F.lit(None).cast("string").alias("kept_text"))
    return changed.union(same).withColumnRenamed("id", id_col)
