"""Ranked lexical search of stated items over all documents, with equal bags of words scored once.

Items are taken in blocks of bounded size. For a block, a document is reduced to its bag: the items' terms that it holds, with
their counts. Documents whose bags and length factors are equal form a class: they are brought together by a digest, and
the bags themselves are compared. Classes, not documents, are scored, against all items of the block at once; every task keeps
only the best ``k`` classes of an item. A class's members share its score, so that of an item's classes the ``k`` with the
highest scores (of equal ones, with the smallest ids) hold all documents of its result; their members come in by ascending id.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from arrayflow.llm.common import pinned, whole_text

#: Cells (terms times items) of a block's table of counts; a block ends with the item that goes beyond it.
BLOCK_CELLS = 1 << 22
_LAST = np.iinfo(np.int64).max
# Bytes that are no part of a term become spaces; A-Z become a-z.
_TERM_BYTES = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).translate(
    bytes.maketrans(ascii_uppercase.encode(), ascii_lowercase.encode()))


def terms_of(text: bytes) -> list[bytes]:
    """Runs of letters (A-Z as a-z), digits and characters beyond ASCII, in UTF-8."""
    return text.translate(_TERM_BYTES).split()


def weight(documents: int, holding: int) -> int:
    """Weight of a term that ``holding`` of ``documents`` documents hold."""
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def _bytes(df: DataFrame, text: str) -> Column:
    return whole_text(df, text).cast("binary")


class Block:
    """Items with their terms: the vocabulary, and how often each item (column) holds each term (row)."""

    def __init__(self, items: list[tuple[int, Counter]]):
        self.items = np.array([item for item, _ in items], np.int64)
        self.vocabulary = {term: i for i, term in enumerate(sorted(set().union(*(counts for _, counts in items))))}
        self.counts = np.zeros((len(self.vocabulary), len(items)), np.int64)
        for column, (_, counts) in enumerate(items):
            for term, n in counts.items():
                self.counts[self.vocabulary[term], column] = n


def blocks(items: DataFrame, cells: int) -> Iterator[Block]:
    """Blocks of rows ``item, text`` (binary), in turn; the driver holds one block, of ``cells`` cells and one item more at most."""
    own: list[tuple[int, Counter]] = []
    seen: set[bytes] = set()
    for item, text in items.select("item", "text").toLocalIterator():
        counts = Counter(terms_of(bytes(text)))
        own.append((item, counts))
        seen.update(counts)
        if len(seen) * len(own) > cells:
            yield Block(own)
            own, seen = [], set()
    if own:
        yield Block(own)


def bags(docs: DataFrame, block: Block) -> DataFrame:
    """``id, n, bag`` of rows ``id, text``: the number of all terms, and (term number, count) pairs of the block's terms in order."""
    shared = docs.sparkSession.sparkContext.broadcast(block.vocabulary)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value
        for batch in batches:
            sizes, packed = [], []
            for text in batch.column(1).to_pylist():
                words = terms_of(text)
                counts = Counter(words)
                own = sorted((vocabulary[t], counts[t]) for t in counts.keys() & vocabulary.keys())
                sizes.append(len(words))
                packed.append(np.array(own, "<u4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(packed, pa.binary())], ["id", "n", "bag"])
    return docs.mapInArrow(work, "id bigint, n bigint, bag binary")


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Term numbers and counts of all bags one after the other, and the bags' ends."""
    each = column.to_pylist()
    pairs = np.frombuffer(b"".join(each), "<u4").reshape(-1, 2).astype(np.int64)
    return pairs[:, 0], pairs[:, 1], np.cumsum([len(b) // 8 for b in each])


def holders(found: DataFrame, terms: int) -> np.ndarray:
    """Number of documents that hold each of a block's terms."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(terms, np.int64)
        for batch in batches:
            total += np.bincount(_flat(batch.column(0))[0], minlength=terms)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["term", "n"])
    out = np.zeros(terms, np.int64)
    for term, n in found.select("bag").mapInArrow(work, "term bigint, n bigint").groupBy("term").agg(F.sum("n")).collect():
        out[term] = n
    return out


def scored(classes: DataFrame, block: Block, weights: np.ndarray, k: int) -> DataFrame:
    """``item, digest, least, score``: every task's best ``k`` classes of each item, of rows ``digest, m, bag, least``."""
    shared = classes.sparkSession.sparkContext.broadcast((block.items, block.counts, weights))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, counts, factor = shared.value
        # A count's share of a score is below 10 ** 6 times its weight. Doubles are exact below 2 ** 53, and faster.
        exact = counts.T @ factor
        table = counts if exact.size and int(exact.max()) * 10 ** 6 >= 1 << 53 else counts.astype(np.float64)
        kept: list[np.ndarray] = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, object)]
        floor = np.ones(len(items), np.int64)
        for batch in batches:
            term, count, ends = _flat(batch.column(2))
            m = np.repeat(batch.column(1).to_numpy(), np.diff(ends, prepend=0))
            value = (factor[term] * ((10 ** 9 * count) // (1000 * count + 8 * m))).astype(table.dtype)
            scores = np.zeros((len(ends), len(items)), np.int64)
            for row, (low, high) in enumerate(zip([0, *ends[:-1]], ends, strict=True)):
                scores[row] = value[low:high] @ table[term[low:high]]
            row, column = np.nonzero(scores >= floor)
            least, digests = batch.column(3).fill_null(_LAST).to_numpy(), np.array(batch.column(0).to_pylist(), object)
            new = [column, scores[row, column], least[row], digests[row]]
            column, score, first, name = (np.concatenate(p) for p in zip(kept, new, strict=True))
            order = np.lexsort((first, -score, column))
            begins = np.searchsorted(column[order], np.arange(len(items)))
            order = order[np.arange(len(order)) - begins[column[order]] < k]
            kept = [column[order], score[order], first[order], name[order]]
            # An item with k classes takes no score below its last one's.
            n = np.bincount(kept[0], minlength=len(items))
            full = np.flatnonzero(n >= k)
            floor[full] = kept[1][np.cumsum(n)[full] - 1]
        column, score, first, name = kept
        yield pa.RecordBatch.from_arrays(
            [pa.array(items[column]), pa.array(name.tolist(), pa.binary()), pa.array(first, mask=first == _LAST), pa.array(score)],
            ["item", "digest", "least", "score"])
    return classes.select("digest", "m", "bag", "least").mapInArrow(work, "item bigint, digest binary, least bigint, score bigint")


def _top(rows: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group, with their ``rank``; tasks drop what is beyond before they exchange rows."""
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


def _ranked(docs: DataFrame, block: Block, k: int) -> DataFrame:
    """``item, rank, id, score`` of the block's items over rows ``id, text``."""
    found = pinned(bags(docs, block), "bags")
    documents, total = found.where("n > 0").agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    weights = np.array([weight(documents, int(n)) for n in holders(found, len(block.vocabulary))], np.int64)
    factor = F.expr(f"25 + (cast(75 as decimal(38,0)) * n * {documents}L) div {max(total, 1)}L")
    held = found.where("octet_length(bag) > 0").withColumn("m", factor.cast("bigint"))
    named = held.withColumn("digest", F.unhex(F.sha2(F.concat(F.encode(F.concat("m", F.lit(":")), "UTF-8"), "bag"), 256)))
    classes = pinned(named.groupBy("digest", "m", "bag").agg(F.min("id").alias("least")), "classes")
    if not classes.groupBy("digest").count().where("count > 1").isEmpty():
        raise ArithmeticError("two different bags have one digest")
    best = pinned(_top(scored(classes, block, weights, k), ["item"], [F.col("score").desc(), F.asc_nulls_last("least"), F.col("digest")], k)
                  .select("item", "digest", "score"), "best")
    # Members of the winning classes only, by ascending id.
    members = _top(named.select("id", "digest").join(best.select("digest").distinct(), "digest"), ["digest"], [F.asc_nulls_last("id")], k)
    result = best.join(members.select("id", "digest"), "digest")
    return _top(result, ["item"], [F.col("score").desc(), F.asc_nulls_last("id")], k).select("item", "rank", "id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id",
           item_text_col: str = "text", cells: int = BLOCK_CELLS) -> DataFrame:
    """Each item's ``k`` documents with the highest scores above 0: ``item_id_col, rank, id_col, score``.

    Equal scores rank by ascending id, null ids last. Repeated documents and items are rows of their own. Null and empty texts
    have no terms: such a document is in no result and such an item has none. Ids of documents are integers below 2 ** 63 - 1,
    ids of items may be anything, also null. Empty tables give an empty result. Other columns are not read. Items beyond
    ``cells`` are searched in further blocks, each of which reads the documents once.
    """
    spark = docs.sparkSession
    asked = pinned(items.select(F.monotonically_increasing_id().alias("item"), items[item_id_col].alias("item_id"), _bytes(items, item_text_col).alias("text")), "items")
    texts = docs.select(docs[id_col].cast("bigint").alias("id"), _bytes(docs, text_col).alias("text"))
    result = spark.createDataFrame([], "item bigint, rank int, id bigint, score bigint")
    for block in blocks(asked, cells):
        result = result.union(_ranked(texts, block, k))
    return result.join(asked, "item").select(
        F.col("item_id").alias(item_id_col), F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")
