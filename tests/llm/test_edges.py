"""Every operator and stage on nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from arrayflow.llm import common, exact, fingerprints, lmscore, mixing, neardup, packing, quality, substrings, tokenfiles, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
# Names that the operators use inside, and one that hides in a struct.
CLASH = ["id", "run", "size", "part", "place", "rank", "score", "label", "row", "times", "text_hash", "sequence_id", "kept", "_id", "component"]


def make_texts(seed=1):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    shared = prose(70)
    base = prose(120)
    near = [" ".join(w if i != k else "changed" for i, w in enumerate(base.split())) for k in (10, 60)]
    texts = [prose(rng.randint(1, 90)) for _ in range(14)]
    texts += [base, base, base.upper(), *near, f"{prose(30)} {shared} {prose(20)}", f"{prose(5)}\n{shared}\t{prose(40)}", shared]
    texts += [None, "", " \n\t ", "one", "One", "a b c", "a b c", "word " * 130, "x" * 5000, prose(4000), "é ü 漢字 \xa0 🙂 it's  fine.", "a\x1cb\x0bc", "tie tie tie tie tie tie", "a <|endoftext|> b<|startoftext|>c <|ENDOFTEXT|>"]
    return texts


@pytest.fixture(scope="module")
def corpus(spark):
    common.tune(spark)
    rows = [(i * 3 - 20, t, random.Random(i).choice(["b", "a", None, "c"]), "xx", None) for i, t in enumerate(make_texts())]
    rows += [rows[0], rows[0], rows[20], (None, "no id here", "a", None, 3), (None, None, None, None, None)]
    columns = "doc_id bigint, text string, source string, lang string, n_chars bigint"
    wide = [(*r, *[str(k) for k in range(len(CLASH))]) for r in rows]
    return spark.createDataFrame(wide, columns + "".join(f", {c} string" for c in CLASH)).repartition(3).persist(), rows


@pytest.fixture(scope="module")
def empty(corpus):
    return corpus[0].limit(0)


@pytest.fixture(scope="module")
def labels(spark, corpus):
    rng = random.Random(4)
    rows = [(r[0], rng.randint(0, 1), rng.choice([0, 1, None])) for r in corpus[1]]
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


def test_exact(corpus, empty):
    df, rows = corpus
    for keep, best in (("smallest", min), ("largest", max)):
        groups = {}
        for key, text, *_ in rows:
            groups.setdefault(text or "", []).append(key)
        got = [tuple(r) for r in exact.exact_groups(df, keep=keep).collect()]
        assert len(got) == len(rows)
        wanted = Counter()
        for text, keys in groups.items():
            known = [k for k in keys if k is not None]
            stays = best(known) if known else None
            for key in keys:
                wanted[(key, stays, len(keys), hashlib.sha256(text.encode()).hexdigest())] += 1
        assert Counter((a, b, c, e) for a, b, c, _, e in got) == wanted
        assert Counter(e for *_, d, e in got if d) == Counter({hashlib.sha256(t.encode()).hexdigest(): 1 for t in groups})
    kept = exact.drop_exact(df, keep="largest")
    assert kept.columns == df.columns
    assert Counter(r["text"] or "" for r in kept.collect()) == Counter({t: 1 for t in groups})
    assert exact.exact_groups(empty).count() == 0 and exact.drop_exact(empty).count() == 0


def brute_near(rows, hundred):
    sets = []
    for _, text, *_ in rows:
        words = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
        sets.append({tuple(words[i:i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set())
    group = list(range(len(rows)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= hundred * len(a | sets[j]):
                group[find(i)] = find(j)
    least = {}
    for i, (key, *_) in enumerate(rows):
        if key is not None:
            least[find(i)] = min(key, least.get(find(i), key))
    return Counter((r[0], len(s), least.get(find(i))) for i, (r, s) in enumerate(zip(rows, sets, strict=True)))


@pytest.mark.parametrize("hundred", [80, 85])
def test_near(corpus, empty, hundred):
    df, rows = corpus
    got = neardup.near_groups(df, hundred / 100).collect()
    assert Counter(tuple(r)[:3] for r in got) == brute_near(rows, hundred)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    kept = neardup.drop_near(df, hundred / 100)
    assert kept.columns == df.columns
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in got if r["kept"]}
    assert neardup.near_groups(empty).count() == 0 and neardup.drop_near(empty).count() == 0


def test_near_chain(spark):
    """Chains of small steps, a large family around one text, and two families that one text links."""
    rng = random.Random(9)
    words = [f"w{i}" for i in range(150)]
    texts, chain = [], list(words)
    for step in range(25):
        chain = list(chain)
        chain[step * 5] = f"s{step}"
        texts.append(" ".join(chain))
    family = [f"f{i}" for i in range(200)]
    for k in range(120):
        own = list(family)
        for at in rng.sample(range(200), 2):
            own[at] = f"k{k}x{at}"
        texts.append(" ".join(own))
    rows = [(i, t) for i, t in enumerate(texts)]
    got = neardup.near_groups(spark.createDataFrame(rows, "doc_id bigint, text string"), 0.85).collect()
    assert Counter(tuple(r)[:3] for r in got) == brute_near(rows, 85)


@pytest.mark.parametrize("hundred", [80, 85])
def test_near_misses(hundred):
    """A pair exactly at the similarity misses the match threshold with a probability of at most 4e-9."""
    n, p = neardup.COORDINATES, hundred / 100
    assert sum(math.comb(n, i) * p**i * (1 - p)**(n - i) for i in range(neardup.matches_needed(p))) <= 4e-9


def test_near_ids(spark):
    """Null ids link like others; an id that repeats with different texts leaves each text with its own group."""
    rng = random.Random(12)
    text = lambda n=100: [f"v{rng.randrange(10 ** 6)}" for _ in range(n)]
    near = lambda words, at: [*words[:at], "changed", *words[at + 1:]]
    a, b, c, d = text(), text(), text(), text()
    rows = [(1, a), (None, near(a, 50)), (None, b), (None, near(b, 20)), (7, near(b, 70)),
            (3, c), (5, near(c, 30)), (5, d), (9, near(d, 60)), (5, text()), (None, text())]
    rows = [(key, " ".join(words)) for key, words in rows]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert Counter(tuple(r)[:3] for r in neardup.near_groups(df, 0.8).collect()) == brute_near(rows, 80)
    stay = [rows[i] for i in (0, 4, 5, 7, 9, 10)]
    assert Counter(tuple(r) for r in neardup.drop_near(df, 0.8).collect()) == Counter(stay)


def brute_repeats(rows, window):
    first, words = {}, [WORD.findall(t or "") for _, t, *_ in rows]
    for (key, *_), own in zip(rows, words, strict=True):
        for i in range(len(own) - window + 1 if key is not None else 0):
            span = tuple(own[i:i + window])
            first[span] = min(key, first.get(span, key))
    out = Counter()
    for (key, *_), own in zip(rows, words, strict=True):
        gone = set()
        for i in range(len(own) - window + 1 if key is not None else 0):
            if first[tuple(own[i:i + window])] < key:
                gone.update(range(i, i + window))
        kept = " ".join(w for i, w in enumerate(own) if i not in gone)
        out[(key, len(own), len(gone), hashlib.sha256(kept.encode()).hexdigest())] += 1
    return out


@pytest.mark.parametrize("window", [50, 20, 10])
def test_substrings(corpus, empty, window):
    df, rows = corpus
    got = substrings.remove_repeats(df, window, with_text=True).collect()
    assert Counter(tuple(r)[:4] for r in got) == brute_repeats(rows, window)
    for r in got:
        assert sum(s["end"] - s["start"] for s in r["spans"]) == r["n_removed"]
        assert r["kept_text"] is None or hashlib.sha256(r["kept_text"].encode()).hexdigest() == r["kept_sha256"]
    assert substrings.remove_repeats(empty).count() == 0


def test_substrings_overlaps(spark):
    """Passages cut at many places, so that windows meet in stretches with different ends; few words, so that grams repeat."""
    rng = random.Random(3)
    pool = [f"p{i}" for i in range(6)]
    passage = [rng.choice(pool) for _ in range(300)]
    rows = []
    for i in range(60):
        low = rng.randrange(200)
        rows.append((i, " ".join([rng.choice(pool) for _ in range(rng.randrange(30))] + passage[low:low + rng.randrange(20, 90)] + [f"z{i}"])))
    got = substrings.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string"), 30).collect()
    assert Counter(tuple(r)[:4] for r in got) == brute_repeats(rows, 30)


def test_lm_scores(corpus, empty):
    df, rows = corpus
    texts = [WORD.findall(t or "") for _, t, *_ in rows]
    ones, twos = Counter(w for t in texts for w in t), Counter(p for t in texts for p in zip(t, t[1:]))
    total = sum(ones.values())

    def score(t):
        out = 0.0
        for i, w in enumerate(t):
            if i and twos[(t[i - 1], w)] >= 2:
                out += np.log(twos[(t[i - 1], w)] / ones[t[i - 1]])
            else:
                out += np.log((0.4 if i else 1) * ones[w] / total)
        return round(out, 6)
    wanted = Counter((r[0], len(t), score(t) + 0.0) for r, t in zip(rows, texts, strict=True))
    assert Counter((a, b, round(c, 6) + 0.0) for a, b, c in lmscore.score_documents(df).collect()) == wanted
    assert lmscore.score_documents(empty).count() == 0


@pytest.mark.parametrize("order", [1, 3, 4])
def test_lm_orders(corpus, order):
    """Every word by its longest history that is frequent enough."""
    df, rows = corpus
    texts = [WORD.findall(t or "") for _, t, *_ in rows]
    counts = Counter(tuple(t[i:i + k]) for t in texts for k in range(1, order + 1) for i in range(len(t) - k + 1))
    total = sum(map(len, texts))

    def score(t):
        out = 0.0
        for i in range(len(t)):
            longest = min(i + 1, order)
            k = next((k for k in range(longest, 1, -1) if counts[tuple(t[i + 1 - k:i + 1])] >= 2), 1)
            before = counts[tuple(t[i + 1 - k:i])] if k > 1 else total
            out += (longest - k) * np.log(0.4) + np.log(counts[tuple(t[i + 1 - k:i + 1])] / before)
        return round(out, 6)
    wanted = Counter((r[0], len(t), score(t) + 0.0) for r, t in zip(rows, texts, strict=True))
    assert Counter((a, b, round(c, 6) + 0.0) for a, b, c in lmscore.score_documents(df, order=order).collect()) == wanted


def ids_of(path, text):
    tokenizer = Tokenizer.from_file(path)
    return np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 0], "<u4")


def test_token_files(corpus, empty, spark):
    df, rows = corpus
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    start, wanted = 0, []
    for key, text, *_ in order:
        ids = ids_of(BYTES, text or "")
        wanted.append((key, start, len(ids), zlib.crc32(ids.tobytes()), ids.tobytes()))
        start += len(ids)
    assert sorted((tuple(r) for r in tokenfiles.round_trip(df, BYTES).collect()), key=lambda r: r[1]) == wanted
    assert tokenfiles.round_trip(empty, BYTES).count() == 0


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, tokenfiles.BLOCK, tokenfiles.BLOCK + 1, 3 * tokenfiles.BLOCK + 777])
def test_segment(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.geometric(0.01, n), 50000).astype("<u4") if n != 65 else np.full(n, 7, "<u4")
    payload = tokenfiles.encode_segment([n], ids, 11)
    first, counts, back = tokenfiles.decode_segment(payload)
    assert (first if n else 11, counts) == (11, [n]) and np.array_equal(back, ids)
    if n > 65:
        broken = bytearray(payload)
        broken[-3] ^= 255
        with pytest.raises((ValueError, IndexError)):
            tokenfiles.decode_segment(bytes(broken))


def test_packing(corpus, empty):
    df, rows = corpus
    wanted = Counter()
    for key, text, *_ in rows:
        ids = ids_of(WORDS, text or "")
        for piece, at in enumerate(range(0, len(ids), 256)):
            part = ids[at:at + 256]
            wanted[(key, piece, at, len(part), zlib.crc32(part.tobytes()))] += 1
    got = packing.pack_documents(df, WORDS, capacity=256).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == wanted
    assert_gapless(got, 256)
    assert packing.pack_documents(empty, WORDS).count() == 0


def assert_gapless(rows, capacity):
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sorted(sequences) == list(range(len(sequences)))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


@pytest.mark.parametrize("seed", range(6))
def test_packing_plan(seed):
    """Every piece has one place, no sequence is overfull, and few are more than the lengths need."""
    rng = random.Random(seed)
    capacity = rng.choice([50, 2048])
    kinds = [lambda: rng.randint(1, capacity), lambda: min(capacity, int(rng.lognormvariate(5, 1)) + 1), lambda: rng.choice([capacity // 2 + 1, capacity // 3, 7])]
    histogram = Counter(rng.choice(kinds)() if seed % 2 else kinds[seed // 2]() for _ in range(3000))
    runs = packing.plan_packing(histogram, capacity, groups=24)
    ranks, fill, places = {}, Counter(), {}
    for length, rank, count, sequence, offset in runs.tolist():
        ranks.setdefault(length, []).extend(range(rank, rank + count))
        for i in range(count):
            fill[sequence + i] += length
            places.setdefault(sequence + i, []).append((offset, length))
    assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(v)) for k, v in histogram.items()}
    assert max(fill.values()) <= capacity and sorted(fill) == list(range(len(fill)))
    for own in places.values():
        assert all(a + n <= b for (a, n), (b, _) in zip(sorted(own), sorted(own)[1:]))
    first_fit, bins = sorted(histogram.elements(), reverse=True), []
    for n in first_fit:
        for i, room in enumerate(bins):
            if room >= n:
                bins[i] -= n
                break
        else:
            bins.append(capacity - n)
    assert len(fill) <= len(bins) * 1.02 + 1


def test_mixing(corpus, empty):
    df, rows = corpus
    got = mixing.mix(df).collect()
    sizes = {}
    for _, text, source, *_ in rows:
        sizes.setdefault(source, []).append(len(WORD.findall(text or "")))
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    totals = [sum(sizes[s]) for s in names]
    targets = mixing.fit_targets(totals, [(5, 2, 1)[i % 3] for i in range(len(names))], sum(totals), 3)
    taken = Counter()
    for r in got:
        assert r["times"] <= 3 and r["taken"] == r["times"] * r["size"]
        taken[(r["source_size"], round(r["target"], 6))] += r["taken"]
    for name, total, target in zip(names, totals, targets, strict=True):
        reach = {0}
        for n in sizes[name]:
            reach |= {r + n * k for r in reach for k in (1, 2, 3)}
        assert abs(taken[(total, round(target, 6))] - target) <= min(abs(r - target) for r in reach) + 0.01 * target + 2
    assert len(got) == len(rows) and Counter(map(tuple, got)) == Counter(map(tuple, mixing.mix(df.repartition(5)).collect()))
    mixed = mixing.take_mix(df)
    assert mixed.columns == df.columns
    assert Counter((r["doc_id"], r["text"]) for r in mixed.collect()).total() == sum(r["times"] for r in got)
    assert mixing.mix(empty).count() == 0 and mixing.take_mix(empty).count() == 0


def test_targets_and_lengths():
    assert mixing.fit_targets([100, 10, 50], [5, 2, 1], 160, 3) == pytest.approx([160 - 30 - 130 / 6, 30, 130 / 6])
    assert mixing.fit_targets([], [], 0, 3) == [] and mixing.fit_targets([0, 4], [5, 2], 4, 3) == [0, 4]
    rng = random.Random(2)
    for _ in range(30):
        lengths = sorted(rng.sample(range(0, 60), 8))
        counts = [rng.randint(1, 4) for _ in lengths]
        budget = rng.randint(0, sum(n * c for n, c in zip(lengths, counts)) + 5)
        copies = rng.choice([1, 3])
        take = mixing.fit_lengths(lengths, counts, budget, copies)
        reach = {0}
        for n, c in zip(lengths, counts):
            reach = {r + n * k for r in reach for k in range(copies * c + 1)}
        got = sum(n * t for n, t in zip(lengths, take))
        assert all(0 <= t <= copies * c for t, c in zip(take, counts))
        assert abs(got - budget) <= min(abs(r - budget) for r in reach) + 3


def test_fingerprints(corpus, empty):
    df, rows = corpus
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    texts = [r[1] or "" for r in order]
    got = Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in fingerprints.edited_fingerprints(df).collect())
    wanted = Counter()
    for (key, *_), own, after in zip(order, texts, texts[1:] + texts[:1], strict=True):
        cut = len(own) // 3
        wanted[(key, len(own), hashlib.sha256((own[:len(own) - cut] + after[:cut]).encode()).hexdigest())] += 1
    assert got == wanted
    prints = {}
    for r in fingerprints.fingerprint(df.select("doc_id", "text")).collect():
        prints.setdefault(r["fingerprint"], set()).add(r["doc_id"])
    assert len(prints) == len(set(texts))
    assert fingerprints.edited_fingerprints(empty).count() == 0
    single = fingerprints.edited_fingerprints(df.where("doc_id = 1")).collect()
    assert len(single) == 1 and single[0]["near_next"] == 1.0


def test_tree():
    text = "The first line has words.\n\nA second one, too, with more of them.\nThird " + " ".join(f"w{i}" for i in range(80))
    tree = fingerprints.tree(text)
    assert fingerprints.parse(tree.text()) == tree and fingerprints.likeness(tree, tree) == 1.0
    changed = text.replace("second", "2nd")
    spans = fingerprints.edits(changed, tree)
    assert spans and all("2nd" in changed.encode()[a:b].decode() for a, b in spans)
    assert 0.5 < fingerprints.likeness(tree, fingerprints.tree(changed)) < 1
    assert fingerprints.tree("").leaves() == set() and fingerprints.tree("").root != fingerprints.tree(" ").root


def brute_marginals(weights, moves, first):
    """Sums over all labellings."""
    n = len(weights)
    mass, total = np.zeros(n), 0.0
    for code in range(1 << n):
        tags = [code >> i & 1 for i in range(n)]
        value = np.exp(sum(w for w, t in zip(weights, tags) if t) + first * tags[0] + sum(moves[a, b] for a, b in zip(tags, tags[1:])))
        total += value
        mass += value * np.array(tags)
    return mass / total


def test_marginals():
    rng = np.random.default_rng(5)
    moves, first = rng.normal(size=(2, 2)), 0.3
    lengths = np.array([1, 7, 3, 9, 2, 8])
    weights = rng.normal(0, 2, lengths.sum())
    field = toxicity.Field(np.zeros(toxicity.BUCKETS), 0.0, moves, first, np.zeros(3))
    wanted = np.concatenate([brute_marginals(w, moves, first) for w in np.split(weights, np.cumsum(lengths)[:-1])])
    assert np.allclose(toxicity.marginals(field, weights, lengths), wanted)


def test_toxicity_learns(spark):
    rng = random.Random(6)
    clean = lambda n: [f"w{rng.randrange(300)}" for _ in range(n)]
    rows, truth = [], []
    for i in range(400):
        toxic = i % 5 == 0
        words = clean(60)
        for _ in range(3 if toxic else 0):
            words[rng.randrange(60)] = rng.choice(["awful", "nasty", "vile"])
        rows.append((i, " ".join(words)))
        truth.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame(truth[:300], "doc_id bigint, toxic int")
    field = toxicity.fit_field(docs, labels)
    for r in toxicity.score(docs.where("doc_id >= 300"), field).collect():
        assert (r["score"] >= 0.3) == bool(truth[r["doc_id"]][1])
        text = rows[r["doc_id"]][1]
        assert all(set(text[s["start"]:s["end"]].split()) & {"awful", "nasty", "vile"} for s in r["spans"])
        assert bool(r["spans"]) == bool(truth[r["doc_id"]][1])
    kept = toxicity.drop_toxic(docs, field, 0.3)
    assert kept.count() == sum(1 - t for _, t in truth)


def test_quality_learns(spark):
    rng = random.Random(8)
    rows, truth = [], []
    for i in range(400):
        good = i % 3 > 0
        words = [f"w{rng.randrange(300)}" for _ in range(80)] if good else [f"w{rng.randrange(300)}$$$" for _ in range(80)]
        rows.append((i, " ".join(words)))
        truth.append((i, int(good)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    scored = quality.score(docs, spark.createDataFrame(truth[:300], "doc_id bigint, quality int")).collect()
    held = [r for r in scored if r["doc_id"] >= 300]
    assert sum((r["score"] >= 0.7) == bool(truth[r["doc_id"]][1]) for r in held) >= 95


def test_toxicity_on_odd_rows(corpus, empty, labels):
    df, rows = corpus
    for known in (labels, labels.limit(0)):
        field = toxicity.fit_field(df, known)
        found = toxicity.score(df, field).collect()
        assert Counter(r["doc_id"] for r in found) == Counter(r[0] for r in rows)
        assert all(0 <= r["score"] <= 1 for r in found)
        assert toxicity.drop_toxic(df, field, 0.5).columns == df.columns
    assert toxicity.score(empty, field).count() == 0
    assert toxicity.drop_toxic(empty, toxicity.fit_field(empty, labels), 0.3).count() == 0


def test_toxicity_without_documents():
    assert 0 <= 1 / (1 + np.exp(-toxicity.fit([], []).scale[0])) < 0.1
    assert toxicity.fit(["", ""], [0, 0]).scale[0] < 0


def test_quality_on_odd_rows(corpus, empty, labels):
    df, rows = corpus
    for known in (labels, labels.limit(0)):
        found = quality.score(df, known).collect()
        assert Counter(r["doc_id"] for r in found) == Counter(r[0] for r in rows)
        assert all(0 <= r["score"] <= 1 for r in found)
    assert quality.score(empty, labels).count() == 0


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_encoder(path):
    from arrayflow.llm.tokens import Encoder
    rng = random.Random(7)
    pieces = ["abc", "Äö", "it's", ".", ",", "!?", " ", "  ", "\n", "\t\r", "\xa0", " ", "\x1c", "12", "x1", "漢字", "🙂", "é", "́", "<|endoftext|>", "<|startoftext|>", "<|", "$", "-", "|"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(12))) for _ in range(3000)] + ["y" * 200 + " z"]
    encode = Encoder(path, cached=500)
    got = [b for i in range(0, len(texts), 100) for b in encode(texts[i:i + 100])]
    assert got == [ids_of(path, "")[:-1].tobytes() if not t else b for t, b in zip(texts, got, strict=True)]
    tokenizer = Tokenizer.from_file(path)
    assert got == [np.array(e.ids, "<u4").tobytes() for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_stage_keeps_columns(spark, corpus, tmp_path, name):
    """A stage alone on odd rows: all columns stay, and an empty table stays empty."""
    df, rows = corpus
    spark.createDataFrame([(r[0], 0, 0) for r in rows], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    stage = dict(corpus_pipeline.STAGES)[name]
    out = stage(spark, df, str(tmp_path))
    if name == "pack":
        assert_gapless(out.collect(), 2048)
    else:
        assert out.columns == df.columns and out.count() > 0
    assert stage(spark, df.limit(0), str(tmp_path)).count() == 0


def test_pipeline(spark):
    """run() against the stages' rules in plain Python."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    packed = corpus_pipeline.run(spark, sf).collect()
    assert_gapless(packed, 2048)
    kept = {d["doc_id"] for d in corpus_pipeline.drop_toxic(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf).collect()}
    rest = [d for d in docs if d["doc_id"] in kept]
    largest = {}
    for d in rest:
        largest[d["text"] or ""] = max(d["doc_id"], largest.get(d["text"] or "", d["doc_id"]))
    rest = [d for d in rest if largest[d["text"] or ""] == d["doc_id"]]
    groups = brute_near([(d["doc_id"], d["text"]) for d in rest], 80)
    single = {key for key, _, component in groups if key == component}
    rest = [d for d in rest if d["doc_id"] in single]
    mixed = mixing.mix(spark.createDataFrame(rest, spark.read.parquet(f"{sf}/documents.parquet").schema)).collect()
    texts = {d["doc_id"]: d["text"] or "" for d in rest}
    wanted = Counter()
    for r in mixed:
        ids = ids_of(WORDS, texts[r["doc_id"]])
        for piece, at in enumerate(range(0, len(ids), 2048)):
            wanted[(r["doc_id"], piece, at, len(ids[at:at + 2048]), zlib.crc32(ids[at:at + 2048].tobytes()))] += r["times"]
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in packed) == +wanted


def test_hash_is_sparks(spark):
    from pyspark.sql import functions as F

    from arrayflow.llm.shingles import xx_long
    rng = random.Random(5)
    pairs = [(rng.randrange(-1 << 63, 1 << 63), rng.randrange(-1 << 63, 1 << 63)) for _ in range(500)]
    wanted = [r[0] for r in spark.createDataFrame(pairs, "a bigint, b bigint").select(F.xxhash64("a", "b")).collect()]
    a, b = np.array(pairs, np.int64).T.copy().view(np.uint64)
    assert xx_long(b, xx_long(a, np.uint64(42))).view(np.int64).tolist() == wanted


@pytest.mark.parametrize("order", [2, 3])
def test_lm_passes(corpus, order):
    """Slices of n-grams leave the scores as they are."""
    df, _ = corpus
    whole, sliced = (Counter((a, b, round(c, 6)) for a, b, c in lmscore.score_documents(df, order=order, passes=p).collect()) for p in (1, 4))
    assert whole == sliced


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_encoder_joins_pieces(path):
    """New pieces of all kinds go to the tokenizer many at a time and get the ids of the whole text."""
    from arrayflow.llm.tokens import Encoder
    rng = random.Random(11)
    parts = ["ab", "Zé", "ÿß", "Äö", "it's", ".", ",", "!?", "\n", "\t", "12", "漢字", "🙂", "é", "<|", "|>", "µ", "İ", "|"]
    texts = [" ".join("".join(rng.choice(parts) for _ in range(rng.randrange(1, 5))) for _ in range(40)) for _ in range(100)]
    encode, tokenizer = Encoder(path), Tokenizer.from_file(path)

    class Counted:
        strings = 0

        def encode_batch_fast(self, some, **options):
            self.strings += len(some)
            return tokenizer.encode_batch_fast(some, **options)

    encode._tokenizer = counted = Counted()
    assert encode(texts) == [np.array(e.ids, "<u4").tobytes() for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert counted.strings < len(encode._known) / 10


def test_lm_reads_once(spark):
    """Texts are read once, also where they fill several chunks, and an n-gram sends a row per chunk at most."""
    from functools import partial

    from pyspark.sql import functions as F
    rng = random.Random(8)
    texts = [" ".join(rng.choice("abcde") for _ in range(rng.randrange(6))) for _ in range(2500)]
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def told(text):
        read.add(1)
        return text
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1)
    table = lmscore.chunks(rows.select("doc_id", "text"), words=1).withColumn("chunk", F.monotonically_increasing_id())
    sent = lmscore.chunk_ngrams(table, 2)
    assert table.count() == 3
    assert max(r["count"] for r in sent.groupBy("gram").count().collect()) == 3
    twos = Counter(p for t in texts for p in zip(t.split(), t.split()[1:]))
    ones = Counter(w for t in texts for w in t.split())
    with pytest.MonkeyPatch.context() as patched:
        patched.setattr(lmscore, "chunks", partial(lmscore.chunks, words=1))
        got = lmscore.score_documents(rows.withColumn("text", told("text"))).collect()
    assert read.value == len(texts)

    def score(words):
        return sum(np.log(ones[w] / sum(ones.values())) if not i else np.log(twos[words[i - 1], w] / ones[words[i - 1]]) for i, w in enumerate(words))
    assert min(twos.values()) >= 2
    assert sorted((a, b, round(c, 6) + 0.0) for a, b, c in got) == [(i, len(t.split()), round(score(t.split()), 6) + 0.0) for i, t in enumerate(texts)]


def test_hashed_words():
    """Words of all lengths, next to each other in neighbouring texts, in slices and large strings."""
    import pyarrow as pa

    from arrayflow.llm.shingles import hashed_words
    long = "x" * 63
    texts = ["", "ab", "abc de", "ab\x00", "ab", " \t", "漢字 ab\x0bc", *(f"{long[:n]}y {long[:n]}" for n in range(64)), long * 3, long * 3 + "y", "\x00", "\x00\x00", "\x1c a\x85"]
    wanted = [t.encode().split() for t in texts]
    for kind in (pa.string(), pa.large_string()):
        for low, high in ((0, len(texts)), (2, 9), (5, 6), (3, 3)):
            hashes, counts = hashed_words(pa.array(texts, kind)[low:high])
            words = [w for t in wanted[low:high] for w in t]
            assert counts.tolist() == [len(t) for t in wanted[low:high]]
            assert len(set(words)) == len(set(hashes.tolist())) == len(set(zip(words, hashes.tolist())))


def test_pieces_are_found_together(monkeypatch):
    """Pieces of many texts are cut and told apart as the pattern cuts one text, also where two share a hash; none is looked up twice in a group."""
    from arrayflow.llm import tokens
    space, letter = r"\x20\x09-\x0D", "A-Za-zÀ-ÖØ-öø-ÿ"
    pattern = re.compile(rf"[{space}]*[{letter}]+(?=[{space}.,;:!?|]|\Z)|[{space}]*[^{space}]+|[{space}]+")
    rng = random.Random(3)
    parts = ["ab", "Zé", "ÿ", "×", "÷", "Ö", "Ø", "it's", ".", ",", "!", "|", " ", "  ", "\n", "\t", "\x0b\x0c\r", "1", "漢", "🙂", "\x00", "Ã", "x" * 9, "à" * 9]
    groups = [["".join(rng.choice(parts) for _ in range(rng.randrange(14))) for _ in range(rng.randrange(6))] for _ in range(500)]
    for clash in (False, True):
        if clash:
            monkeypatch.setattr(tokens, "xx_long", lambda values, seed: np.zeros(len(values), np.uint64))
        for texts in groups:
            pieces, numbers, counts = tokens._distinct([t.encode() for t in texts])
            wanted = [pattern.findall(t) for t in texts]
            assert [pieces[i].decode() for i in numbers] == [p for w in wanted for p in w]
            assert counts.tolist() == list(map(len, wanted))
            assert len(set(pieces)) == len(pieces)

    class Counted(dict):
        looked = 0

        def get(self, key):
            Counted.looked += 1
            return super().get(key)
    encode = tokens.Encoder(WORDS)
    encode._known = Counted()
    encode(["to be or not to be"] * 100)
    assert Counted.looked == 5


def test_substrings_leave_no_shuffles(spark, corpus):
    """The steps before the result leave no shuffle files on disk."""
    import time

    def shuffles():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {name for i in range(files.size()) if (name := files.apply(i).getName()).startswith("shuffle_")}
    df = corpus[0].select("doc_id", "text")
    df.count()
    before = shuffles()
    result = substrings.remove_repeats(df, 50)
    for _ in range(20):
        if not (left := shuffles() - before):
            break
        time.sleep(0.25)
    assert not left
    assert result.count() == df.count()
