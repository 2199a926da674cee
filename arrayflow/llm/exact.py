"""Exact dedup: a tree merge of sorted digest runs, in DataFrame functions only.

Documents are dealt into ``runs`` by a hash of their id, and each run reduces its documents to one row per digest. Runs
then meet in rounds: ``fan`` neighbouring runs merge into one, keeping per digest the surviving identifier and the count.
After the last round the root knows the survivor of every digest. The answers go down the same tree, so that a digest
which holds a third of all documents is still only one row per run, and its documents stay spread over all runs.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from arrayflow.llm.common import parallelism, pinned, whole_text

# Equality of texts is decided by SHA-256 and verified by length and an independent 64-bit hash at every level.
DIGEST = ["sha", "n_bytes", "check"]


def merge_runs(rows: DataFrame, keys: Sequence[str], runs: int, fan: int,
               kept: Mapping[str, tuple[Callable[[str], Column], str]]) -> list[DataFrame]:
    """Reduce rows with a ``run`` below ``runs`` per run and keys, then ``fan`` runs to one until one is left.

    ``kept`` maps a column to (aggregate, source column). Every level also counts ``group_size``.
    """
    levels = [rows.groupBy("run", *keys).agg(*[f(c).alias(n) for n, (f, c) in kept.items()], F.count(F.lit(1)).alias("group_size"))]
    while runs > 1:
        runs = -(-runs // fan)
        levels.append(levels[-1].withColumn("run", F.floor(F.col("run") / fan)).groupBy("run", *keys)
                      .agg(*[f(n).alias(n) for n, (f, _) in kept.items()], F.sum("group_size").alias("group_size")))
    return levels


def answer_runs(levels: Sequence[DataFrame], answers: DataFrame, keys: Sequence[str], fan: int, columns: Sequence[str]) -> DataFrame:
    """Carry ``columns`` of ``answers`` (rows of the last level) down the tree to the rows of the first level."""
    for level in reversed(levels[:-1]):
        below = level.select(F.col("run").alias("_run"), F.floor(F.col("run") / fan).alias("run"), *keys)
        answers = below.join(answers, ["run", *keys]).select(F.col("_run").alias("run"), *keys, *columns)
    return answers.select("run", *keys, *columns)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest",
                 runs: int | None = None, fan: int = 8) -> DataFrame:
    """One row per input row: ``id_col, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical; null counts as empty. ``keep`` names the identifier that stays: ``smallest`` or
    ``largest``. Rows whose id is null belong to their group but never stay while another id is there; in a group of null
    ids only, ``keep_id`` is null and one row is kept. Of repeated rows with the kept id, exactly one is ``kept``. Other
    columns are not read. An empty table gives an empty result.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep must be smallest or largest, not {keep!r}")
    best = F.min if keep == "smallest" else F.max
    if runs is None:
        runs = 4 * parallelism(docs.sparkSession)
    text = whole_text(docs, text_col)
    digests = pinned(docs.select(
        docs[id_col].alias("id"), F.pmod(F.xxhash64(docs[id_col]), F.lit(runs)).alias("run"),
        F.unhex(F.sha2(text, 256)).alias("sha"), F.octet_length(text).alias("n_bytes"), F.xxhash64(text).alias("check")), "digests")

    levels = merge_runs(digests, DIGEST, runs, fan, {"keep_id": (best, "id")})
    answers = answer_runs(levels, levels[-1], DIGEST, fan, ["keep_id", "group_size"])

    same = W.partitionBy("run", *DIGEST, "id").orderBy(F.lit(0))
    joined = digests.join(answers, ["run", *DIGEST]).withColumn("copy", F.row_number().over(same))
    # Rows with a null id all lie in one run, so one of them can be chosen where no id exists.
    return joined.select(
        F.col("id").alias(id_col), "keep_id", "group_size",
        (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def drop_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", **options: int) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; repeated rows with the kept id leave one row.

    Rows with a null id stay only where their whole group has no id.
    """
    kept = exact_groups(docs, id_col, text_col, keep, **options).where("kept").select(
        F.col(id_col).alias("_id"), F.col("text_sha256").alias("_sha"))
    # Whole rows travel as one value, so that no column name of theirs can clash.
    rows = docs.select(F.struct("*").alias("row"), docs[id_col].alias("id"), F.sha2(whole_text(docs, text_col), 256).alias("sha"))
    first = rows.withColumn("copy", F.row_number().over(W.partitionBy("id", "sha").orderBy(F.lit(0)))).where("copy = 1")
    return first.join(kept, F.expr("id <=> _id AND sha = _sha"), "left_semi").select("row.*")
