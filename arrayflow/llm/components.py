"""Connected components of a table of links, by alternating star contraction; nothing but sums reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arrayflow.llm.common import pinned_with


def connected(links: DataFrame) -> DataFrame:
    """``id, component`` for every id in ``links`` (``a, b``); the component is its smallest id. No links give no rows.

    ``links`` is read several times and should be a written table. Each step is one job, whose write also tells whether
    anything has changed.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct()
    state, before = {"n": -1}, None
    while state != before and state["n"] != 0:
        # Large star: every larger neighbour moves to the smallest neighbour.
        both = edges.union(edges.select(F.col("v"), F.col("u")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        # Small star: every smaller neighbour, and the vertex itself, moves to the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before = state
        edges, state = pinned_with(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "links",
                                   n=F.count(F.lit(1)), mark=F.expr("bit_xor(xxhash64(u, v))"))
    roots = edges.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots)
