"""The Merkle manifest against a brute-force tree, on odd rows and on sources of one to several hundred rows."""

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from arrayflow.llm import common, manifest

DDL = "doc_id bigint, text string, lang string, source string, n_chars bigint, place string, tree string, leaf string, path string"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, text):
    key, _, lang, source, n_chars = row[:5]
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (key, source, lang, n_chars, text)])


def climb(digests):
    """All levels of a tree, the leaves first."""
    levels = [digests]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][i:i + 16]) for i in range(0, len(levels[-1]), 16)])
    return levels


def siblings(levels, i):
    for level in levels[:-1]:
        run = i // 16 * 16
        yield "".join(level[run:i]), "".join(level[i + 1:run + 16])
        i //= 16


def brute(rows):
    sources = {}
    for row in rows:
        sources.setdefault(row[3], []).append(row)
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for s in order:
        own = sorted(sources[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r, r[1])))
        trees.append((own, climb([leaf_of(r, r[1]) for r in own])))
    top = climb([levels[-1][0] for _, levels in trees])
    for t, (own, levels) in enumerate(trees):
        for i, row in enumerate(own):
            path = [*siblings(levels, i), *siblings(top, t)]
            fold = leaf_of(row, row[1].lower() if row[1] else row[1])
            for left, right in path:
                fold = sha(left, fold, right)
            yield row[0], levels[0][i], levels[-1][0], top[-1][0], sha(*[a + b for a, b in path]), fold


def make(spark, rows):
    return spark.createDataFrame([(*r, "p", "t", "l", None) for r in rows], DDL).repartition(3)


def check(spark, rows):
    df = make(spark, rows)
    proved = manifest.proofs(df, altered={"text": F.lower("text")})
    path = F.col("path")
    got = proved.select("doc_id", "leaf", "subroot", "root", manifest.proof_digest(path), manifest.folded(F.col("altered_leaf"), path)).collect()
    assert Counter(map(tuple, got)) == Counter(brute(rows))


def test_sources_of_many_sizes(spark):
    common.tune(spark)
    rng = random.Random(2)
    rows = [(rng.randrange(10 ** 12) * 2 + k % 2, rng.choice(["Text A", "text", "Ünï 漢", ""]), "en", f"s{s}", k)
            for s, n in enumerate([1, 2, 15, 16, 17, 256, 257, 300]) for k in range(n)]
    check(spark, rows)


def test_many_sources(spark):
    check(spark, [(k, f"T{k}", None, f"site-{k % 290}", None) for k in range(400)])


def test_odd_rows(spark):
    rows = [(None, None, None, None, None), (None, "No id", "xx", None, 3), (None, "No id", "xx", None, 3), (5, None, "a", "", 1), (5, "", "a", "", 0),
            (7, "Same", "a", "z", 4), (7, "Same", "a", "z", 4), (7, "Other", "a", "z", 5), (-3, "Long " * 50_000, "a", "z", 9)]
    rows += [(9, "Copy", "a", "hot", 4)] * 40
    check(spark, rows)


@pytest.mark.parametrize("n", [0, 1])
def test_small_tables(spark, n):
    check(spark, [(1, "One", "a", None, 3)][:n])


def test_untouched_rows_verify(spark):
    df = make(spark, [(k, f"Row {k}", "a", f"s{k % 3}", k) for k in range(60)])
    proved = manifest.proofs(df, altered={"text": F.when(F.col("doc_id") % 5 == 0, F.upper("text")).otherwise(F.col("text"))})
    got = proved.select("doc_id", (manifest.folded(F.col("altered_leaf"), F.col("path")) == F.col("root")).alias("ok")).collect()
    assert {r.doc_id for r in got if not r.ok} == set(range(0, 60, 5))
