"""Ranked search against brute force: ties, copies, odd rows, several blocks."""

import math
import random
import re
from collections import Counter

import pytest

from arrayflow.llm import common, lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
A_TO_Z = {c: c + 32 for c in range(65, 91)}
DOCS = "doc_id bigint, text string, item string, score string, rank string, bag string"
ITEMS = "item_id string, text string, id string, item string"


def terms(text):
    return [t.translate(A_TO_Z) for t in TERM.findall(text or "")]


def brute(docs, items, k):
    bags = [(key, Counter(terms(t))) for key, t in docs]
    total, n = sum(sum(b.values()) for _, b in bags), sum(1 for _, b in bags if b)
    df = Counter(t for _, b in bags for t in b)
    out = Counter()
    for item, text in items:
        found = []
        for key, bag in bags:
            m = 25 + (75 * sum(bag.values()) * n) // max(total, 1)
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10 ** 9 * bag[t]) // (1000 * bag[t] + 8 * m)) for t in terms(text) if bag[t])
            if score > 0:
                found.append((-score, key is None, key or 0, key))
        out.update((item, i, key, -score) for i, (score, _, _, key) in enumerate(sorted(found)[:k], 1))
    return out


def search(spark, docs, items, **options):
    common.tune(spark)
    left = spark.createDataFrame([(k, t, "i", "s", "r", None) for k, t in docs], DOCS).repartition(3)
    right = spark.createDataFrame([(k, t, "i", "j") for k, t in items], ITEMS)
    return Counter(map(tuple, lexical.search(left, right, **options).collect()))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(6)
    words = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 4))) for _ in range(60)] + ["É", "é", "漢字", "x9", "A_b"]
    prose = lambda n: rng.choice([" ", "-", ", "]).join(rng.choice(words) for _ in range(n))
    docs = [(7 * i % 211 - 50, prose(rng.choice([1, 3, 20, 80]))) for i in range(200)]
    copy = docs[3][1]
    docs += [(1000 + i, copy) for i in range(60)] + [(5, copy.upper()), (5, copy), (None, copy), (None, None), (6, None), (8, ""), (9, " ._- "), (10, "long " * 40_000)]
    items = [(f"i{i}", prose(rng.choice([1, 2, 10, 40]))) for i in range(25)] + [
        ("copy", copy), ("none", None), ("void", ""), (None, "a b c"), ("twice", "a a a b"), ("twice", "a a a b"), ("unknown", "zzzzzz"), ("long", "long long")]
    return docs, items


@pytest.mark.parametrize("k, cells", [(10, lexical.BLOCK_CELLS), (3, 200), (1, 1)])
def test_search(spark, corpus, k, cells):
    docs, items = corpus
    assert search(spark, docs, items if cells > 1 else items[:4] + items[25:28], k=k, cells=cells) == brute(docs, items if cells > 1 else items[:4] + items[25:28], k)


def test_ties_by_id(spark):
    docs = [(i, "same words here") for i in range(50, 0, -1)] + [(0, "other")]
    got = search(spark, docs, [("q", "same other")], k=5)
    assert [key for _, rank, key, _ in sorted(got, key=lambda r: r[1])] == [0, 1, 2, 3, 4]


@pytest.mark.parametrize("docs, items", [([], [("q", "a")]), ([(1, "a")], []), ([], []), ([(1, None)], [("q", "a")])])
def test_empty(spark, docs, items):
    assert not search(spark, docs, items)


def test_large_counts_stay_exact(spark):
    docs = [(1, "a " * 50 + "b"), (2, "b c")] + [(k, "c") for k in range(3, 9)]
    items = [("q", "a b c " * 4_000_000)]
    assert search(spark, docs, items) == brute(docs, items, 10)
