"""Mixing sources to target weights: subset-sum budget fitting over counts of documents by exact length.

Every document of a source is taken as often as its target holds the whole source. What is left of the budget is fitted
on the histogram of lengths: a proportional share of every length, then long documents while the rest is large, then a
bounded-knapsack dynamic programme that hits the rest exactly where the lengths allow it. The seeded rank of a document
among those of its source and length says whether it is one of those counted.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from arrayflow.llm.common import WORD, parallelism, pinned, ranked, whole_text

#: Words of rest that the dynamic programme works on.
FIT_WINDOW = 1 << 16


def fit_targets(sizes: Sequence[int], weights: Sequence[float], total: float, most: float) -> list[float]:
    """Shares of ``total`` by weight; none above ``most`` times its size, the excess dealt again by weight."""
    targets = [0.0] * len(sizes)
    open_ = [i for i, size in enumerate(sizes) if size > 0 and weights[i] > 0]
    left = float(total)
    while open_:
        weight = sum(weights[i] for i in open_)
        full = [i for i in open_ if left * weights[i] / weight > most * sizes[i]]
        if not full:
            for i in open_:
                targets[i] = left * weights[i] / weight
            break
        for i in full:
            targets[i] = float(most * sizes[i])
        left -= sum(targets[i] for i in full)
        open_ = [i for i in open_ if i not in full]
    return targets


def fit_lengths(lengths: Sequence[int], counts: Sequence[int], budget: int, copies: int = 1, window: int = FIT_WINDOW) -> list[int]:
    """How many documents of each length to take, so that their lengths sum to nearly ``budget``.

    Every document is taken once before any is taken again, up to ``copies`` times; that is only done to fill what single
    documents cannot. The last document may go over the budget if that is nearer to it.
    """
    total = sum(n * c for n, c in zip(lengths, counts, strict=True))
    take = [c * min(budget, total) // total if n > 0 else 0 for n, c in zip(lengths, counts, strict=True)]
    for time in range(1, copies + 1):
        rest = budget - sum(n * t for n, t in zip(lengths, take, strict=True))
        if rest > 0:
            more = _fill(lengths, [time * c - t if n > 0 else 0 for n, c, t in zip(lengths, counts, take, strict=True)], rest, window)
            take = [t + m for t, m in zip(take, more, strict=True)]
    rest = budget - sum(n * t for n, t in zip(lengths, take, strict=True))
    over = [(n, i) for i, n in enumerate(lengths) if n > rest and take[i] < copies * counts[i]]
    if rest > 0 and over and min(over)[0] - rest < rest:
        take[min(over)[1]] += 1
    return take


def _fill(lengths: Sequence[int], free: Sequence[int], rest: int, window: int) -> list[int]:
    """Fill ``rest`` from below with at most ``free`` documents of each length."""
    take = [0] * len(lengths)
    down = sorted((i for i, n in enumerate(lengths) if n > 0 and free[i] > 0), key=lambda i: -lengths[i])
    for i in down:
        take[i] = min(free[i], max(0, rest - window) // lengths[i])
        rest -= take[i] * lengths[i]
    # reach[k]: bit s is set if the first k choices can sum to s; a choice takes all or none of its documents.
    reach, choices, mask = [1], [], (1 << (rest + 1)) - 1
    for i in down:
        left, size = min(free[i] - take[i], rest // lengths[i]), 1
        while left > 0 and not reach[-1] >> rest & 1:
            size = min(size, left)
            grown = reach[-1] | (reach[-1] << size * lengths[i]) & mask
            if grown != reach[-1]:
                reach.append(grown)
                choices.append((i, size))
            left, size = left - size, 2 * size
    at = reach[-1].bit_length() - 1
    for k in range(len(choices) - 1, -1, -1):
        if not reach[k] >> at & 1:
            i, size = choices[k]
            take[i] += size
            at -= size * lengths[i]
    return take


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), most: int = 3, share: float = 1.0, seed: int = 17,
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per input row: ``id_col, size, source_size, target, taken, times, text_hash``.

    ``size`` counts words (null text: 0). Sources in code-point order, null last, get the ``weights`` in turn. Targets
    share ``share`` of all words, at most ``most`` times a source. ``times`` says how often the mix takes the document, never
    above ``most``; ``taken`` is ``times * size``. Empty documents are taken as often as their whole source is. The same
    rows and seed give the same mix; repeated rows are documents of their own, and which of them is taken is immaterial.
    Driver memory holds one row per source, as the weights do. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    sizes = pinned(docs.select(
        docs[id_col].cast("bigint").alias("id"), docs[source_col].cast("string").alias("source"),
        F.xxhash64(docs[text_col]).alias("text_hash"),
        F.regexp_count(whole_text(docs, text_col), F.lit(WORD)).cast("bigint").alias("size")), "sizes")
    totals = sorted(((r["source"], int(r["words"])) for r in sizes.groupBy("source").agg(F.sum("size").alias("words")).toLocalIterator()),
                    key=lambda r: (r[0] is None, r[0] or ""))
    words = [w for _, w in totals]
    targets = fit_targets(words, [weights[i % len(weights)] for i in range(len(words))], share * sum(words), most)
    plan = []
    for i, ((source, size), target) in enumerate(zip(totals, targets, strict=True)):
        whole = min(most, int(target) // size) if size else 0
        plan.append((i, source, size, target, whole, round(target) - whole * size if size and whole < most else 0))
    sources = spark.createDataFrame(plan, "source_no int, source string, source_size bigint, target double, whole int, rest bigint")
    keyed = sizes.join(F.broadcast(sources), sizes["source"].eqNullSafe(sources["source"])).drop("source")

    def fit(batches: pd.DataFrame) -> pd.DataFrame:
        rows = batches.sort_values("size")
        chosen = fit_lengths(rows["size"].tolist(), rows["n"].tolist(), int(rows["rest"].iloc[0]), most - int(rows["whole"].iloc[0]))
        return pd.DataFrame({"source_no": rows["source_no"], "size": rows["size"], "n": rows["n"], "extra": chosen})

    # One row per length: a source's group grows with its longest document, not with its number of documents.
    quota = keyed.groupBy("source_no", "size", "whole", "rest").agg(F.count(F.lit(1)).alias("n")).groupBy("source_no").applyInPandas(
        fit, "source_no int, size bigint, n bigint, extra bigint")
    draw = F.xxhash64(F.lit(seed), F.col("id"))
    parts = 4 * parallelism(spark)
    placed = ranked(keyed.withColumn("draw", draw), ["source_no", "size"], [F.col("draw"), F.col("id"), F.col("text_hash")],
                    F.pmod("draw", F.lit(parts)), "place", attach=quota)
    times = F.col("whole") + F.expr("extra div n") + F.when(F.col("place") < F.col("extra") % F.col("n"), 1).otherwise(0)
    return placed.select(
        F.col("id").alias(id_col), "size", "source_size", "target", (times * F.col("size")).cast("bigint").alias("taken"),
        times.cast("int").alias("times"), "text_hash")


def take_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: object) -> DataFrame:
    """``docs`` with every row repeated as often as the mix takes it; rows taken 0 times go, all columns stay.

    Repeated rows (same id and text) are numbered, so that each finds one of their counts.
    """
    times = mix(docs, id_col=id_col, text_col=text_col, **options).select(
        F.col(id_col).alias("_id"), F.col("text_hash").alias("_hash"), "times")
    times = times.withColumn("_no", F.row_number().over(W.partitionBy("_id", "_hash").orderBy(F.desc("times")))).where("times > 0")
    # Whole rows travel as one value, so that no column name of theirs can clash.
    rows = docs.select(F.struct("*").alias("row"), docs[id_col].cast("bigint").alias("id"), F.xxhash64(docs[text_col]).alias("hash"))
    rows = rows.withColumn("no", F.row_number().over(W.partitionBy("id", "hash").orderBy(F.lit(0))))
    joined = rows.join(times, F.expr("id <=> _id AND hash = _hash AND no = _no"))
    return joined.select("row", F.explode(F.array_repeat(F.lit(1), F.col("times")))).select("row.*")
