"""Document fingerprints: a Merkle tree over pieces, paragraphs and sections.

A paragraph is a line; a line is cut into pieces after words picked by their last bytes, so that an edit moves no other cut
(about four words a piece). A section ends after a blank line or after a paragraph picked by its digest. Every node's
digest covers its children's, so that equal roots mean equal texts and differing branches lead to the edits.

A fingerprint is text: the root's digest, ``:``, then sections joined by ``/``, of paragraphs joined by ``.``, of 8 hex
characters per piece (the first of its digest).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arrayflow.llm.common import id_bounds, parallelism, range_number, whole_text

#: One word in so many ends a piece, and one paragraph in so many ends a section.
PIECE_WORDS, SECTION_PARAGRAPHS = 4, 8
_SPACE, _LINE = 0x20, 0x0A


class Tree(NamedTuple):
    root: str
    sections: list[list[list[str]]]

    def text(self) -> str:
        return self.root + ":" + "/".join(".".join("".join(p) for p in s) for s in self.sections)

    def leaves(self) -> set[str]:
        return {leaf for s in self.sections for p in s for leaf in p}


def parse(fingerprint: str) -> Tree:
    """The tree of a fingerprint's text."""
    root, _, body = fingerprint.partition(":")
    sections = [[[p[i:i + 8] for i in range(0, len(p), 8)] for p in s.split(".")] for s in body.split("/")] if body else []
    return Tree(root, sections)


def cuts(data: bytes) -> np.ndarray:
    """Ends of the pieces of ``data``; a piece keeps the white space that ends it."""
    raw = np.frombuffer(data, np.uint8)
    at = np.flatnonzero((raw == _SPACE) | (raw == _LINE))
    before = [raw[np.maximum(at - k, 0)].astype(np.uint32) for k in (1, 2, 3, 4)]
    mixed = (before[0] * np.uint32(0x9E3779B1) ^ before[1] * np.uint32(0x85EBCA77) ^ before[2] * np.uint32(0xC2B2AE3D)
             ^ before[3] * np.uint32(0x27D4EB2F)) * np.uint32(0x165667B1)
    ends = at[(raw[at] == _LINE) | ((mixed >> np.uint32(16)) % np.uint32(PIECE_WORDS) == 0)] + 1
    return ends if len(ends) and ends[-1] == len(data) else np.append(ends, len(data)) if len(data) else ends


def tree(text: str) -> Tree:
    """The Merkle tree of a whole text; the empty text has no section."""
    data = text.encode("utf-8", "surrogatepass")
    ends = cuts(data).tolist()
    root, section, paragraph = hashlib.blake2b(digest_size=16), hashlib.blake2b(digest_size=16), []
    sections: list[list[list[str]]] = []
    paragraphs: list[list[str]] = []
    low = 0
    for high in ends:
        paragraph.append(xxhash.xxh3_128_digest(data[low:high]))
        if data[high - 1] == _LINE or high == len(data):
            node = hashlib.blake2b(b"".join(paragraph), digest_size=16).digest()
            section.update(node)
            paragraphs.append([leaf[:4].hex() for leaf in paragraph])
            blank = len(paragraph) == 1 and not data[low:high].strip()
            paragraph = []
            if blank or node[0] % SECTION_PARAGRAPHS == 0 or high == len(data):
                root.update(section.digest())
                sections.append(paragraphs)
                section, paragraphs = hashlib.blake2b(digest_size=16), []
        low = high
    return Tree(root.hexdigest(), sections)


def likeness(a: Tree, b: Tree) -> float:
    """1 for equal roots, else the share of pieces that two trees have in common (Dice coefficient of their sets)."""
    if a.root == b.root:
        return 1.0
    left, right = a.leaves(), b.leaves()
    return 2 * len(left & right) / (len(left) + len(right)) if left or right else 0.0


def edits(text: str, other: Tree) -> list[tuple[int, int]]:
    """Byte spans of ``text`` whose pieces ``other`` does not have; touching spans are joined."""
    data, known, low, out = text.encode("utf-8", "surrogatepass"), other.leaves(), 0, []
    for high in cuts(data).tolist():
        if xxhash.xxh3_128_digest(data[low:high])[:4].hex() not in known:
            if out and out[-1][1] == low:
                out[-1] = (out[-1][0], high)
            else:
                out.append((low, high))
        low = high
    return out


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row ``id_col, n_chars, fingerprint`` of its whole text; null counts as empty."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([tree(t).text() for t in texts], pa.string())],
                [id_col, "n_chars", "fingerprint"])
    rows = docs.select(docs[id_col].cast("bigint").alias(id_col), whole_text(docs, text_col).alias("text"))
    return rows.mapInArrow(work, f"`{id_col}` bigint, n_chars bigint, fingerprint string")


EDITED = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every text beside an edited one: its last third replaced by the start of the next document's text.

    The next document is the next lower id (repeated ids in order of text, null ids last); after the last comes the first,
    so a single document is its own next. The last ``floor(n_chars / 3)`` code points are replaced by as many of the next
    text, or all it has. Texts move once, into ranges of ids; the first document of each range is also sent to the range
    before it. An empty table gives an empty result.
    """
    rows = docs.select(docs[id_col].cast("bigint").alias("id"), whole_text(docs, text_col).alias("text"))
    bounds = id_bounds(rows, "id", 4 * parallelism(docs.sparkSession))
    # Range 0 holds the lowest ids and is worked through last. One id per range comes to the driver.
    heads = {r["part"]: r["id"] for r in rows.groupBy(range_number(bounds, F.col("id")).alias("part")).agg(F.max("id").alias("id")).collect()}
    order = sorted(heads, reverse=True)
    follows = {heads[b]: a for a, b in zip(order, order[1:] + order[:1], strict=True)}
    null_goes, firsts = follows.pop(None, None), np.array(sorted(follows), np.int64)
    goes = np.array([follows[k] for k in firsts.tolist()], np.int64)

    @F.pandas_udf("array<int>")
    def places(keys: pd.Series) -> pd.Series:
        null, low = keys.isna().to_numpy(), np.iinfo(np.int64).min
        ids = keys.fillna(low).to_numpy(np.int64)
        own = np.searchsorted(bounds, ids, side="right")
        at = np.minimum(np.searchsorted(firsts, ids), max(len(firsts) - 1, 0))
        head = ~null & (firsts[at] == ids) if len(firsts) else np.zeros(len(ids), bool)
        return pd.Series([[o, goes[a]] if h else [o, null_goes] if n and null_goes is not None else [o]
                          for o, a, h, n in zip(own.tolist(), at.tolist(), head.tolist(), null.tolist(), strict=True)])

    dealt = rows.select(F.posexplode(places("id")).alias("ghost", "part"), "id", "text").select("part", "ghost", "id", "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = held = None  # held: (id, text, tree) that waits for its next document
        for batch in batches:
            out = []
            for where, ghost, key, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if where != part:
                    part, held = where, None
                elif held is None and ghost:
                    continue  # a further row of the neighbour's first id
                made = tree(text)
                if held is not None:
                    before, full, own = held
                    cut = len(full) // 3
                    edited = full[:len(full) - cut] + text[:cut]
                    changed = own if edited == full else tree(edited)
                    out.append((before, len(full), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), own.text(), changed.text(),
                                likeness(own, changed), likeness(own, made)))
                held = None if ghost else (key, text, made)
            if out:
                columns = list(zip(*out, strict=True))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                                                 ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return dealt.repartition(len(bounds) + 1, "part").sortWithinPartitions("part", "ghost", F.desc_nulls_last("id"), "text").mapInArrow(work, EDITED)
