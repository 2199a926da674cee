"""MinHash near-dedup by an inverted join over signature coordinates.

Equal shingle sets form one class. A class posts itself under its (coordinate, value) pairs, rarest pairs first, and only
under so many that two signatures with the wanted number of matches must meet in one of them (prefix filter). Collisions
are counted on whole signatures, and pairs above the match threshold are confirmed on full sets.

A shingle that no other candidate has cannot be shared, so that a class whose other shingles are too few for the similarity
goes at once, and pairs are only formed where both have enough. A list of postings is never expanded into all its pairs while its members may be linked through fewer: in each of a few
rounds every class is compared with the best of its lists' leaders, links are contracted to components, and only pairs of
different components that share a posting go on. What is left after the rounds is compared in full, so no link between
components is lost: a list is dealt to blocks of bounded size, each task counts the common shingles of all members of two
blocks at once, and hands on one link per component it has joined, not the pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arrayflow.llm.common import parallelism, pinned, pinned_with, whole_text
from arrayflow.llm.components import connected
from arrayflow.llm.shingles import WordHashes, mix, runs_of

#: Coordinates of a signature. A pair at the wanted similarity misses the match threshold, which lies MARGIN standard
#: deviations below the expected matches, with a probability of 1.5e-9 at 0.85 and 9e-10 at 0.8.
COORDINATES, MARGIN = 64, 6.5
ROUNDS = 3
#: Members and shingles that a block of a list should hold.
BLOCK_MEMBERS, BLOCK_SHINGLES = 512, 1 << 21
#: Shingles that are counted at once.
_WIDTH = 4096
_SEEDS = mix(np.arange(1, COORDINATES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingle_set(hashes: WordHashes, text: str, size: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of ``size`` words, A-Z in lower case; fewer words are one shingle."""
    words = hashes.of(text.encode("utf-8", "surrogatepass").lower().split())
    return np.unique(runs_of(words, min(size, len(words)))) if len(words) else np.zeros(0, np.uint64)


def matches_needed(similarity: float) -> int:
    """Matches of a candidate pair's signatures."""
    return int(COORDINATES * similarity - MARGIN * (COORDINATES * similarity * (1 - similarity)) ** 0.5)


def signature(own: np.ndarray) -> np.ndarray:
    """Least hash of a set under each coordinate's function."""
    least = [(own[low:low + 4096] * _SEEDS[:, None] >> np.uint64(33)).min(1) for low in range(0, len(own), 4096)]
    return np.min(least, axis=0).astype(np.int32)


def sketch(docs: DataFrame, size: int) -> DataFrame:
    """``id, check, n_shingles, digest, signature`` of rows ``id, check, text``; an empty set has a null digest."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            counts, digests, signatures = [], [], []
            for text in batch.column(2).to_pylist():
                own = shingle_set(hashes, text, size)
                counts.append(len(own))
                digests.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest() if len(own) else None)
                signatures.append(signature(own) if len(own) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()),
                                              pa.array(signatures, pa.list_(pa.int32()))], ["id", "check", "n_shingles", "digest", "signature"])
    return docs.mapInArrow(work, "id bigint, check bigint, n_shingles bigint, digest binary, signature array<int>")


def sets_of(docs: DataFrame, size: int) -> DataFrame:
    """``id, shingles`` (array of hashes) of rows ``id, text``."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            sets = [shingle_set(hashes, t, size).view(np.int64) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["id", "shingles"])
    return docs.mapInArrow(work, "id bigint, shingles array<bigint>")


def postings(classes: DataFrame, matches: int) -> DataFrame:
    """``posting, id``: each class under its rarest coordinate-value pairs, as far as another class may meet it there."""
    pairs = classes.select("id", F.posexplode("signature").alias("at", "value")).select(
        "id", (F.col("at").cast("bigint") * F.lit(1 << 32) + F.col("value")).alias("posting"))
    often = pairs.groupBy("posting").agg(F.count(F.lit(1)).alias("n"))
    ranked = pairs.join(often, "posting").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("n", "posting"))).alias("own"))
    prefix = F.slice("own", 1, COORDINATES - matches + 1)
    own = F.transform(F.filter(prefix, lambda p: p["n"] > 1), lambda p: p["posting"])
    return ranked.select(F.explode(own).alias("posting"), "id")


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of different sets."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(x) for x in sets])
    values, place, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    # A shingle of one set only is in no intersection.
    shared = times > 1
    number = np.cumsum(shared) - 1
    kept = shared[place]
    owner, column = owner[kept], number[place[kept]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((n, n))
    for low in range(0, int(shared.sum()), _WIDTH):
        a, b = np.searchsorted(column, [low, low + _WIDTH])
        held = np.zeros((n, min(_WIDTH, int(shared.sum()) - low)), np.float32)
        held[owner[a:b], column[a:b] - low] = 1
        # Exact: a float32 holds whole numbers up to 2 ** 24, and a chunk adds 4096 at most.
        out += held @ held.T
    return out.astype(np.int64)


def block_links(components: np.ndarray, sets: list[np.ndarray], hundred: int) -> list[tuple[int, int]]:
    """``(root, component)`` for every component that links join to another one within the block."""
    if len(sets) < 2 or (components == components[0]).all():
        return []
    sizes, common = np.array([len(x) for x in sets]), common_counts(sets)
    linked = common * 100 >= (sizes[:, None] + sizes - common) * hundred
    linked |= components[:, None] == components
    root = np.full(len(sets), -1)
    for start in range(len(sets)):
        front = np.array([start]) if root[start] < 0 else np.zeros(0, int)
        while len(front):
            root[front] = start
            front = np.flatnonzero(linked[front].any(0) & (root < 0))
    return sorted({(int(components[r]), int(c)) for r, c in zip(root.tolist(), components.tolist(), strict=True) if components[r] != c})


def listed_links(members: DataFrame, sets: DataFrame, hundred: int) -> DataFrame:
    """Links ``a, b`` between components, from all pairs in the lists of rows ``posting, id, n, component``."""
    sizes = members.groupBy("posting").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_MEMBERS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).alias("blocks"))
    dealt = members.join(sizes, "posting").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks"))).withColumn(
        "other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    # Two blocks meet in one task, a block alone in its own.
    placed = dealt.select("posting", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "id", "component")
    group = ["posting", "low", "high"]
    together = placed.join(sets, "id").select(*group, "component", "shingles").repartition(parallelism(members.sparkSession), *group).sortWithinPartitions(*group)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, components, own = None, [], []

        def flush() -> Iterator[pa.RecordBatch]:
            found = block_links(np.array(components), own, hundred) if len(own) > 1 else []
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["a", "b"])
        for batch in batches:
            for *at, component, shingles in zip(*(batch.column(i).to_pylist() for i in range(4)), batch.column(4), strict=True):
                if at != key:
                    yield from flush()
                    key, components, own = at, [], []
                components.append(component)
                own.append(shingles.values.to_numpy())
        yield from flush()
    return together.mapInArrow(work, "a bigint, b bigint").distinct()


def _grouped(docs: DataFrame, similarity: float, size: int, id_col: str, text_col: str, rounds: int) -> DataFrame:
    """``id, check, n_shingles, component`` per input row; ``check`` is a hash of the text, so that both together name a text."""
    hundred = round(similarity * 100)
    if hundred < 80:
        raise ValueError("the match threshold is made for similarities from 0.8")
    spark = docs.sparkSession
    runs = 4 * parallelism(spark)
    text = whole_text(docs, text_col)
    rows = docs.select(docs[id_col].cast("bigint").alias("id"), F.xxhash64(text).alias("check"), text.alias("text"))
    # A class goes by the number of one of its rows: ids may be null, or repeat with different texts.
    sketches = pinned(sketch(rows, size).withColumn("row", F.monotonically_increasing_id()).withColumn(
        "run", F.pmod(F.xxhash64("row"), F.lit(runs))), "sketches")
    # Rows of a set go by their run first, so that a set which a third of all rows have is one row per run.
    held = sketches.where("digest IS NOT NULL")
    dealt = pinned(held.groupBy("run", "digest").agg(F.min("id").alias("rep"), F.min("row").alias("row")), "dealt")
    heads = pinned(dealt.groupBy("digest").agg(F.min("rep").alias("rep"), F.min("row").alias("row")), "heads")
    classes = pinned(held.join(heads.select("row"), "row", "left_semi").select(
        F.col("row").alias("id"), F.col("id").alias("doc"), "check", "n_shingles", "signature"), "classes")
    needed = matches_needed(similarity)
    met = pinned(postings(classes, needed), "postings")
    # Only classes that share a posting can be linked; their texts are read once more for full sets.
    texts = classes.join(met.select("id").distinct(), "id", "left_semi").select(
        F.col("id").alias("class"), F.col("doc").alias("_id"), F.col("check").alias("_check"))
    chosen = rows.join(texts, F.expr("id <=> _id AND check = _check")).select(F.col("class").alias("id"), "text")
    sets = pinned(sets_of(chosen, size).dropDuplicates(["id"]), "sets")
    lonely = sets.select("id", F.explode("shingles").alias("shingle")).groupBy("shingle").agg(
        F.count(F.lit(1)).alias("n"), F.min("id").alias("id")).where("n = 1").groupBy("id").agg(F.count(F.lit(1)).alias("own"))
    facts = pinned(sets.select("id", F.size("shingles").alias("n")).join(lonely, "id", "left").select(
        "id", "n", (F.col("n") - F.coalesce("own", F.lit(0))).alias("common")).where(F.col("common") * 100 >= F.col("n") * hundred), "facts")
    signatures = facts.join(classes.select("id", "signature"), "id")
    posted = pinned(met.join(facts, "id"), "posted")

    def enough(a: str, b: str) -> Column:
        """Whether two classes have enough common shingles for an intersection of the wanted share."""
        both, least = F.col(f"{a}.n") + F.col(f"{b}.n"), F.least(f"{a}.common", f"{b}.common")
        return least * (100 + hundred) >= both * hundred

    def matched(pairs: DataFrame) -> DataFrame:
        """The pairs whose signatures have enough matches, with ``matches``."""
        left, right = (signatures.select(F.col("id").alias(x), F.col("signature").alias(f"s{x}")) for x in "ab")
        same = F.aggregate(F.zip_with("sa", "sb", lambda x, y: (x == y).cast("int")), F.lit(0), lambda t, x: t + x)
        return pairs.join(left, "a").join(right, "b").select(*pairs.columns, same.alias("matches")).where(F.col("matches") >= needed)

    def confirmed(pairs: DataFrame) -> DataFrame:
        """Links ``a, b`` between the components of the pairs that are linked by intersection and union of full sets."""
        own = pairs.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b")
        both = own.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a")
        common = F.size(F.array_intersect("x", "y"))
        return both.select("ca", "cb", common.alias("n"), (F.size("x") + F.size("y") - common).alias("all")).where(
            F.col("n") * 100 >= F.col("all") * hundred).select(F.col("ca").alias("a"), F.col("cb").alias("b"))

    labels: DataFrame | None = None
    turn, last = 0, False
    while not last:
        last = turn >= rounds
        if labels is None:
            named = posted.withColumn("component", F.col("id"))
        else:
            named = posted.join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
        members = named.select("posting", F.struct("id", "n", "common", "component").alias("m"))
        # Lists whose members are all in one component are done. The first leader is the member with the smallest share of
        # shingles of its own, which is the nearest to most others; a hash picks another one in each further round.
        central = F.col("m.common") / F.col("m.n") if turn == 0 else F.lit(0.0)
        lead = F.struct((-central).alias("own"), F.xxhash64(F.lit(turn), "m.id").alias("h"), F.col("m"))
        spans = members.groupBy("posting").agg(F.min("m.component").alias("low"), F.max("m.component").alias("high"), F.min(lead).alias("lead"))
        mixed = members.join(spans.where("low < high").select("posting", F.col("lead.m").alias("lead")), "posting")
        other = F.col("lead.component") != F.col("m.component")
        if last:
            found = listed_links(mixed.select("posting", "m.id", "m.n", "m.component"), sets, hundred)
        else:
            pairs = mixed.where(other & enough("lead", "m"))
            close = matched(pairs.select(F.col("lead.id").alias("a"), F.col("m.id").alias("b"), F.col("lead.component").alias("ca"),
                                         F.col("m.component").alias("cb")).distinct())
            # One leader per class and round: the one with the most matches.
            best = close.groupBy("b").agg(F.max(F.struct("matches", "a", "ca", "cb")).alias("top")).select("top.a", "b", "top.ca", "top.cb")
            found = confirmed(best)
        links, seen = pinned_with(found, "confirmed", n=F.count(F.lit(1)))
        # Leaders that link nothing more are not worth another round.
        turn = turn + 1 if seen["n"] else rounds
        if seen["n"]:
            # Only the new links are contracted, over the components they join.
            joined = connected(links)
            if labels is not None:
                moved = joined.select(F.col("id").alias("component"), F.col("component").alias("to"))
                old = labels.join(moved, "component", "left").select("id", F.coalesce("to", "component").alias("component"))
                joined = old.union(joined.join(labels, "id", "left_anti").select("id", "component"))
            labels = pinned(joined, "labels")
    if labels is None:
        answers = heads.select("digest", F.col("rep").alias("component"))
    else:
        # Of a component's classes, the smallest id that is not null.
        linked = heads.join(labels.withColumnRenamed("id", "row"), "row").select("digest", "rep", "component")
        names = linked.groupBy("component").agg(F.min("rep").alias("name"))
        told = linked.join(names, "component").select("digest", "name", F.lit(True).alias("linked"))
        answers = heads.join(told, "digest", "left").select("digest", F.when(F.col("linked"), F.col("name")).otherwise(F.col("rep")).alias("component"))
    down = dealt.select("run", "digest").join(answers, "digest")
    own = held.join(down, ["run", "digest"]).select("id", "check", "n_shingles", "component")
    alone = sketches.where("digest IS NULL").select("id", "check", "n_shingles", F.col("id").alias("component"))
    return own.union(alone)


def near_groups(docs: DataFrame, similarity: float = 0.85, size: int = 5, id_col: str = "doc_id", text_col: str = "text",
                rounds: int = ROUNDS) -> DataFrame:
    """One row per input row: ``id_col, n_shingles, component_id, kept``.

    Documents are linked where intersection / union of their sets of ``size``-word shingles is at least ``similarity`` (0.8 or
    more, compared in whole hundredths). ``component_id`` is the smallest id that links lead to, the document's own included;
    ``kept`` marks it. Null texts and texts without words have no shingles and no links. A null id is no document's
    smallest: its row gets the group's id, and a null one where the group has no other. Repeated rows are each marked; an
    empty table gives an empty result.
    """
    return _grouped(docs, similarity, size, id_col, text_col, rounds).select(
        F.col("id").alias(id_col), "n_shingles", F.col("component").alias("component_id"),
        F.col("id").eqNullSafe(F.col("component")).alias("kept"))


def drop_near(docs: DataFrame, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text", size: int = 5,
              rounds: int = ROUNDS) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of every group the smallest id.

    Rows of a group that share its smallest id stay all, and so do rows with a null id whose group has no id. Where an id
    repeats with different texts, each text stays or goes with its own group.
    """
    groups = _grouped(docs, similarity, size, id_col, text_col, rounds)
    gone = groups.where("NOT id <=> component").select(F.col("id").alias("_id"), F.col("check").alias("_check")).distinct()
    rows = docs.select(F.struct("*").alias("row"), docs[id_col].cast("bigint").alias("id"), F.xxhash64(whole_text(docs, text_col)).alias("check"))
    return rows.join(gone, F.expr("id <=> _id AND check = _check"), "left_anti").select("row.*")
