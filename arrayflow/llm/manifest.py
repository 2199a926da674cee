"""Merkle manifest of a dataset: one root over all rows, and for each row the proof that it belongs to the root.

Rows are leaves. Per source, leaves ascend by id and every ``FAN`` neighbours become the digest of their concatenation, until
one node is left, the source's subroot; subroots become the root in the same way. Nodes are stored by content: a record maps a
digest to its children. Proofs are found by descent: requests start at the root, each step looks up a digest's record, follows
the digit of the leaf's rank and collects the children that were not selected. Leaves below one node share its request, so a
level has as many requests as nodes; the path's segments are reversed at the leaf.

Places come from one ordering of all rows by source and id, cut into slices of about equal size, so that a source which holds
a third of all rows is spread over many tasks. Texts stay where they are read; only digests move.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from arrayflow.llm.common import parallelism, pinned, ranked

FAN = 16
#: Columns of a leaf, in the order of hashing.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field(value: Column) -> Column:
    """A value with its length in front, ``-`` for null: no two lists of values give the same text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts one after the other."""
    return F.sha2(F.concat(*parts), 256)


def _slot(column: str) -> Column:
    """Number of the group of ``FAN`` that a place lies in."""
    return F.floor(F.col(column) / FAN).cast("bigint")


def _ordered(docs: DataFrame, fields: Sequence[str], altered: Mapping[str, Column], id_col: str, source_col: str) -> DataFrame:
    """``name, id, leaf, altered, slice, at``: rows in slices by (source, id), with their place inside the slice."""
    leaf = digest(*[field(docs[c]) for c in fields])
    other = digest(*[field(altered.get(c, docs[c])) for c in fields])
    digests = pinned(docs.select(
        docs[source_col].cast("string").alias("source"), docs[id_col].cast("bigint").alias("id"), leaf.alias("leaf"), other.alias("altered")), "digests")
    # Rows that are equal in everything are told apart by where they were read, so that no key is too large for a slice.
    numbered = digests.withColumn("row", F.monotonically_increasing_id())
    order = ["source", "id", "leaf", "altered", "row"]
    sliced = numbered.repartitionByRange(parallelism(docs.sparkSession), *order).sortWithinPartitions(*order)
    # The number is the partition's in the upper bits and the row's place in it in the lower 33. Written once, it stays.
    place = sliced.withColumn("number", F.monotonically_increasing_id())
    return pinned(place.select(
        field(F.col("source")).alias("name"), "id", "leaf", "altered", F.shiftright("number", 33).alias("slice"),
        F.col("number").bitwiseAND((1 << 33) - 1).alias("at")), "ordered")


def _placed(rows: DataFrame) -> DataFrame:
    """Add ``tree`` (the source's number), ``place`` (in the source) and ``n`` (rows of the source)."""
    pairs = pinned(rows.groupBy("name", "slice").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("here")), "pairs")
    # One row per slice: as many as the session has partitions.
    before = pairs.groupBy("slice").agg(F.sum("here").alias("here")).select(
        "slice", (F.sum("here").over(W.orderBy("slice")) - F.col("here")).alias("before"))
    spans = pairs.join(before, "slice")
    sources = spans.groupBy("name").agg(F.min(F.col("before") + F.col("first")).alias("start"), F.sum("here").alias("n"), F.min("slice").alias("slice"))
    trees = ranked(sources, [], [F.col("start")], F.col("slice"), "tree").select("name", "tree", "start", "n")
    # Keyed by source and slice, so that rows of a large source meet it in many places.
    offsets = pinned(spans.join(trees, "name").select("name", "slice", "tree", "n", (F.col("before") - F.col("start")).alias("shift")), "offsets")
    return rows.join(offsets, ["name", "slice"]).select("tree", (F.col("at") + F.col("shift")).alias("place"), "n", "id", "leaf", "altered")


def _grown(nodes: DataFrame, most: int) -> list[DataFrame]:
    """Levels above ``nodes`` (``tree, place, n, digest``; n nodes in the tree): ``tree, place, n, digest, children``."""
    levels = []
    while most > 1:
        children = F.transform(F.sort_array(F.collect_list(F.struct("place", "digest"))), lambda c: c["digest"])
        grouped = nodes.where("n > 1").groupBy("tree", _slot("place").alias("place"), F.ceil(F.col("n") / FAN).alias("n")).agg(children.alias("children"))
        levels.append(pinned(grouped.withColumn("digest", digest(F.array_join("children", ""))), "level"))
        nodes, most = levels[-1], -(-most // FAN)
    return levels


def _others(children: Column, at: Column) -> Column:
    """The children that were not selected, as the text left and the text right of the selected one."""
    return F.struct(F.array_join(F.slice(children, 1, at), "").alias("left"), F.array_join(F.slice(children, at + 2, FAN), "").alias("right"))


def _descended(requests: DataFrame, level: DataFrame) -> DataFrame:
    """One step down: requests ``place, digest, path, ...`` become requests for the children of their digests."""
    records = level.select("digest", "children").dropDuplicates(["digest"])
    rest = [c for c in requests.columns if c not in ("place", "digest", "path")]
    met = requests.join(records, "digest").select("place", "path", "children", *rest, F.posexplode("children").alias("at", "child"))
    return met.select((F.col("place") * FAN + F.col("at")).alias("place"), F.col("child").alias("digest"),
                      F.concat("path", F.array(_others(F.col("children"), F.col("at")))).alias("path"), *rest)


def proofs(docs: DataFrame, fields: Sequence[str] = FIELDS, altered: Mapping[str, Column] | None = None, id_col: str = "doc_id",
           source_col: str = "source") -> DataFrame:
    """One row per input row: ``id_col, leaf, altered_leaf, subroot, root, path``.

    ``path`` lists, from the leaf's run up to the root's, the digests left and right of the own one. ``altered`` replaces
    columns for ``altered_leaf``, which the tree does not hold. Sources ascend bytewise, null first. A null value in any
    column hashes as ``-``; rows with a null id come first in their source. Rows with one id, also wholly equal ones, are
    leaves of their own, ordered by digest. Columns beside ``fields`` are not read. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    placed = _placed(_ordered(docs, fields, altered or {}, id_col, source_col))
    member = F.struct("place", "id", "leaf", "altered")
    grouped = placed.groupBy("tree", _slot("place").alias("slot"), F.col("n").alias("leaves")).agg(F.sort_array(F.collect_list(member)).alias("members"))
    joined = F.array_join(F.transform("members", lambda m: m["leaf"]), "")
    # A lone leaf is its source's subroot as it is.
    own = F.when(F.col("leaves") == 1, joined).otherwise(digest(joined))
    runs = pinned(grouped.select("tree", F.col("slot").alias("place"), F.ceil(F.col("leaves") / FAN).alias("n"), "leaves", "members", own.alias("digest")), "runs")

    most = runs.agg(F.max("n")).first()[0] or 0
    levels = _grown(runs, most)
    subroots = runs.where("n = 1").select("tree", "digest", F.lit(0).alias("height"))
    for height, level in enumerate(levels, 1):
        subroots = subroots.union(level.where("n = 1").select("tree", "digest", F.lit(height)))
    subroots = pinned(subroots, "subroots")
    sources = subroots.count()
    top = _grown(subroots.select(F.lit(0).alias("tree"), F.col("tree").alias("place"), F.lit(sources).cast("bigint").alias("n"), "digest"), sources)
    root = (top[-1] if top else subroots).select("digest").first() if sources else [None]

    empty = F.array().cast("array<struct<left:string,right:string>>")
    requests = spark.range(1).select(F.col("id").alias("place"), F.lit(root[0]).cast("string").alias("digest"), empty.alias("path"))
    for level in reversed(top):
        requests = _descended(requests, level)
    heights = subroots.select(F.col("tree").alias("place"), "height")
    starts = requests.join(heights, "place").select(
        F.lit(0).cast("bigint").alias("place"), "digest", "path", F.col("place").alias("tree"), F.col("digest").alias("subroot"), "height")
    requests = starts.where(F.col("height") == len(levels))
    for height in range(len(levels), 0, -1):
        requests = _descended(requests, levels[height - 1]).unionByName(starts.where(F.col("height") == height - 1))

    met = runs.select("tree", "place", "leaves", "members").join(requests, ["tree", "place"])
    leaves = F.transform("members", lambda m: m["leaf"])
    each = met.withColumn("children", leaves).select("*", F.posexplode("members").alias("at", "own"))
    first = F.when(F.col("leaves") > 1, F.array(_others(F.col("children"), F.col("at")))).otherwise(empty)
    return each.select(F.col("own.id").alias(id_col), F.col("own.leaf").alias("leaf"), F.col("own.altered").alias("altered_leaf"), "subroot",
                       F.lit(root[0]).cast("string").alias("root"), F.concat(first, F.reverse("path")).alias("path"))


def proof_digest(path: Column) -> Column:
    """Digest of a proof: all digests beside the own ones, leaf to root, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and a proof lead to."""
    return F.aggregate(path, leaf, lambda own, s: digest(s["left"], own, s["right"]))
