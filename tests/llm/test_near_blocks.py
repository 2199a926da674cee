"""The last round of near-dedup: blocks of lists against brute force."""

import random

import numpy as np
import pytest

from arrayflow.llm import neardup


def some_sets(seed, n):
    rng = random.Random(seed)
    base = [rng.randrange(-2 ** 63, 2 ** 63) for _ in range(60)]
    return [np.unique(np.array(rng.sample(base, rng.randrange(40, 60)) + [rng.randrange(2 ** 40) for _ in range(rng.randrange(12))], np.int64)) for _ in range(n)]


def similar(x, y, hundred):
    both = len(np.intersect1d(x, y))
    return 100 * both >= hundred * (len(x) + len(y) - both)


@pytest.mark.parametrize("seed", range(4))
def test_block(seed, monkeypatch):
    monkeypatch.setattr(neardup, "_WIDTH", 16)
    sets = some_sets(seed, 25)
    counts = neardup.common_counts(sets)
    assert all(counts[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(25) for j in range(i))
    components = np.array([i - i % 3 if i < 9 else i for i in range(25)])
    groups = {int(c): int(c) for c in components}

    def top(c):
        return c if groups[c] == c else top(groups[c])
    for i in range(25):
        for j in range(i):
            if similar(sets[i], sets[j], 80):
                a, b = sorted((top(int(components[i])), top(int(components[j]))))
                groups[b] = a
    wanted = {c: top(c) for c in groups}
    for a, b in neardup.block_links(components, sets, 80):
        assert wanted[a] == wanted[b]
    joined = {}
    for a, b in neardup.block_links(components, sets, 80):
        joined[b] = a
    assert len(joined) == len(wanted) - len(set(wanted.values()))


@pytest.mark.parametrize("members, shingles", [(512, 1 << 21), (4, 1 << 21), (512, 300)])
def test_lists(spark, monkeypatch, members, shingles):
    """Whatever the blocks, all links of a list between different components come out as joined components."""
    monkeypatch.setattr(neardup, "BLOCK_MEMBERS", members)
    monkeypatch.setattr(neardup, "BLOCK_SHINGLES", shingles)
    sets = some_sets(9, 40)
    table = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(sets)], "id bigint, shingles array<bigint>")
    rows = [(p, i, len(sets[i]), i) for i in range(40) for p in (i % 2, 7)]
    got = neardup.listed_links(spark.createDataFrame(rows, "posting bigint, id bigint, n bigint, component bigint"), table, 80).collect()
    near = {(i, j) for i in range(40) for j in range(i) if similar(sets[i], sets[j], 80)}

    def parts(pairs):
        label = list(range(40))
        for a, b in sorted(pairs):
            label = [label[a] if x == label[b] else x for x in label]
        return {frozenset(i for i in range(40) if label[i] == x) for x in label}
    assert parts({(r.a, r.b) for r in got}) == parts(near)
    assert len(got) < 40 * 12
