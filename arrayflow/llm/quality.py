"""A quality classifier: random-indexing word vectors pooled per document, and a two-layer network on top.

Every token has a sparse random index vector, given by its hash. The vector of a word is the sum of the index vectors of its
neighbours over the whole corpus, kept per hash bucket of words. A document is the mean of its words' vectors, the mean of
its tokens' index vectors and shapes, and a few norms of these. The network is fitted on a bounded number of labelled
documents, and its probabilities are calibrated by a temperature on labelled documents that it was not fitted on.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arrayflow.llm.common import whole_text

_TOKEN = re.compile(r"\n|\w+|[^\w\s]+")
#: Words share vectors by hash bucket; the table of BUCKETS x WIDTH numbers is all that ever reaches the driver.
BUCKETS, WIDTH, SHAPES, WINDOW = 1 << 14, 64, 64, 2
BLOCKS = 64
#: Labelled documents the network is fitted on at most; which ones is decided by a hash of the id.
FIT_ROWS = 16000
SCALARS = 9
FEATURES = 2 * WIDTH + SHAPES + SCALARS


class Vocabulary(dict):
    """Row of each token in the tables of hashes; it starts again between batches when it is full."""

    def __init__(self, size: int = 600_000):
        super().__init__()
        self.hashes, self.shapes = np.zeros(size, np.uint64), np.zeros(size, np.int64)

    def __missing__(self, token: str) -> int:
        row = len(self)
        if row == len(self.hashes):
            self.hashes, self.shapes = np.resize(self.hashes, 2 * row), np.resize(self.shapes, 2 * row)
        self.hashes[row] = xxhash.xxh64_intdigest(token)
        self.shapes[row] = xxhash.xxh32_intdigest(shape(token)) % SHAPES
        self[token] = row
        return row

    def renew(self) -> None:
        if len(self) > 500_000:
            self.clear()


def shape(token: str) -> str:
    """Kinds of characters in order, repeats once, and a coarse length."""
    kinds = ("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in token[:40])
    last, out = "", []
    for kind in kinds:
        if kind != last:
            out.append(kind)
            last = kind
    return "".join(out[:6]) + str(min(len(token), 20) // 4)


def read(vocabulary: Vocabulary, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Vocabulary rows of all tokens one after the other, and each text's number of tokens."""
    found = [_TOKEN.findall(t) for t in texts]
    lengths = np.array([len(f) for f in found], np.int64)
    return np.fromiter((vocabulary[t] for own in found for t in own), np.int64, int(lengths.sum())), lengths


def index_vectors(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two places of each index vector that are not 0, and their signs."""
    bits = hashes.astype(np.uint64)
    places = np.stack([(bits >> np.uint64(20)) % np.uint64(WIDTH), (bits >> np.uint64(30)) % np.uint64(WIDTH)], 1).astype(np.int64)
    signs = np.stack([(bits >> np.uint64(40)) & np.uint64(1), (bits >> np.uint64(41)) & np.uint64(1)], 1).astype(np.float64) * 2 - 1
    return places, signs


def word_vectors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """Context vectors of all word buckets over the whole texts of all documents, each of length 1."""
    rows = BUCKETS // BLOCKS

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, total = Vocabulary(), np.zeros(BUCKETS * WIDTH)
        for batch in batches:
            vocabulary.renew()
            tokens, lengths = read(vocabulary, batch.column(0).to_pylist())
            owner = np.repeat(np.arange(len(lengths)), lengths)
            hashes = vocabulary.hashes[tokens]
            bucket = (hashes % np.uint64(BUCKETS)).astype(np.int64) * WIDTH
            places, signs = index_vectors(hashes)
            for gap in range(1, WINDOW + 1):
                near = owner[gap:] == owner[:-gap]
                for word, other in ((bucket[gap:][near], np.s_[:-gap]), (bucket[:-gap][near], np.s_[gap:])):
                    at, sign = places[other][near], signs[other][near]
                    total += np.bincount((word[:, None] + at).ravel(), sign.ravel(), len(total))
        parts = total.reshape(BLOCKS, -1)
        used = np.flatnonzero(parts.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([parts[b].astype("<f4").tobytes() for b in used], pa.binary())], ["block", "sums"])

    def add(frames: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(rows * WIDTH)
        for sums in frames["sums"]:
            total += np.frombuffer(sums, "<f4")
        return pd.DataFrame({"block": frames["block"].iloc[:1], "sums": [total.astype("<f4").tobytes()]})

    kind = "block int, sums binary"
    parts = docs.select(whole_text(docs, text_col).alias("text")).mapInArrow(gather, kind)
    # Two levels, so that no task adds up the tables of all tasks.
    parts = parts.withColumn("salt", F.spark_partition_id() % 64).groupBy("block", "salt").applyInPandas(add, kind)
    table = np.zeros((BUCKETS, WIDTH))
    for row in parts.groupBy("block").applyInPandas(add, kind).collect():
        table[row["block"] * rows:(row["block"] + 1) * rows] = np.frombuffer(row["sums"], "<f4").reshape(rows, WIDTH)
    return (table / np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def pooled(vectors: np.ndarray, vocabulary: Vocabulary, texts: list[str]) -> np.ndarray:
    """Feature row of every text; a text without tokens has zeros."""
    out = np.zeros((len(texts), FEATURES))
    vocabulary.renew()
    tokens, lengths = read(vocabulary, texts)
    full = np.flatnonzero(lengths)
    if not len(full):
        return out
    n = lengths[full]
    at = np.cumsum(n) - n
    owner = np.repeat(np.arange(len(full)), n)
    hashes = vocabulary.hashes[tokens]
    mean, near = _context(vectors, (hashes % np.uint64(BUCKETS)).astype(np.int64), owner, len(full))
    mean, near = mean / n[:, None], near / n
    places, signs = index_vectors(hashes)
    own = np.bincount((owner[:, None] * WIDTH + places).ravel(), signs.ravel(), len(full) * WIDTH).reshape(-1, WIDTH) / n[:, None]
    kinds = np.bincount(owner * SHAPES + vocabulary.shapes[tokens], minlength=len(full) * SHAPES).reshape(-1, SHAPES) / n[:, None]
    inside = owner[1:] == owner[:-1]
    equal = np.bincount(owner[1:][inside], (tokens[1:] == tokens[:-1])[inside], len(full)) / n
    two = owner[2:] == owner[:-2]
    again = np.bincount(owner[2:][two], (tokens[2:] == tokens[:-2])[two], len(full)) / n
    distinct = np.bincount(np.unique(owner * (len(vocabulary) + 1) + tokens) // (len(vocabulary) + 1), minlength=len(full)) / n
    scalars = np.stack([np.log1p(n) / 4, np.linalg.norm(mean, axis=1), np.linalg.norm(own, axis=1), near, equal, again, distinct,
                        np.linalg.norm(kinds, axis=1), distinct * np.log1p(n) / 4], 1)
    out[full] = np.concatenate([mean, 4 * own, kinds, scalars], 1)
    return out


def _context(vectors: np.ndarray, buckets: np.ndarray, owner: np.ndarray, docs: int, step: int = 1 << 16) -> tuple[np.ndarray, np.ndarray]:
    """Per document the sum of its words' vectors, and of the products of neighbouring ones; a part of the tokens at a time."""
    total, near = np.zeros((docs, WIDTH)), np.zeros(docs)
    for low in range(0, len(buckets), step):
        context, own = vectors[buckets[low:low + step + 1]], owner[low:low + step + 1]
        same = own[1:] == own[:-1]
        near += np.bincount(own[1:][same], (context[1:] * context[:-1]).sum(1)[same], docs)
        context, own = context[:step], own[:step]
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        total[own[first]] += np.add.reduceat(context, first, axis=0)
    return total, near


class Network(NamedTuple):
    """Input scaling, two layers, and the temperature its log-odds are divided by."""
    centre: np.ndarray
    scale: np.ndarray
    inner: np.ndarray
    inner_bias: np.ndarray
    outer: np.ndarray
    outer_bias: float
    temperature: float

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        hidden = np.maximum((x - self.centre) / self.scale @ self.inner + self.inner_bias, 0)
        return hidden @ self.outer + self.outer_bias

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.log_odds(x) / self.temperature, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, hidden: int = 48, epochs: int = 40, decay: float = 2e-3, seed: int = 11) -> Network:
    """Fit by Adam on mini-batches; every sixth row is kept for the temperature. Without both labels, the prior is the score."""
    random = np.random.default_rng(seed)
    order = random.permutation(len(x))
    held, used = order[::6], np.delete(order, np.s_[::6])
    centre = x[used].mean(0) if len(used) else np.zeros(FEATURES)
    scale = x[used].std(0) + 1e-3 if len(used) else np.ones(FEATURES)
    width = x.shape[1]
    prior = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    weights = [random.normal(0, np.sqrt(2 / width), (width, hidden)), np.zeros(hidden), np.zeros(hidden), np.array(prior)]
    moment, spread = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    step = 0
    if 0 < y[used].sum() < len(used):
        z = (x - centre) / scale
        weights[2] = random.normal(0, np.sqrt(1 / hidden), hidden)
        for epoch in range(epochs):
            rate = 2e-3 * (1 - epoch / epochs)
            for low in range(0, len(used), 128):
                rows = used if low == 0 and len(used) <= 128 else used[low:low + 128]
                drop = (random.random((len(rows), width)) > 0.1) / 0.9
                inputs = z[rows] * drop
                raw = inputs @ weights[0] + weights[1]
                inner = np.maximum(raw, 0)
                error = (1 / (1 + np.exp(-np.clip(inner @ weights[2] + weights[3], -30, 30))) - y[rows]) / len(rows)
                back = np.outer(error, weights[2]) * (raw > 0)
                slopes = [inputs.T @ back + decay * weights[0], back.sum(0), inner.T @ error + decay * weights[2], error.sum()]
                step += 1
                for i, slope in enumerate(slopes):
                    moment[i] = 0.9 * moment[i] + 0.1 * slope
                    spread[i] = 0.999 * spread[i] + 0.001 * slope ** 2
                    weights[i] = weights[i] - rate * (moment[i] / (1 - 0.9 ** step)) / (np.sqrt(spread[i] / (1 - 0.999 ** step)) + 1e-8)
            used = random.permutation(used)
    network = Network(centre, scale, weights[0], weights[1], weights[2], float(weights[3]), 1.0)
    if len(held):
        odds = network.log_odds(x[held])
        losses = {t: np.logaddexp(0, np.where(y[held] == 1, -odds, odds) / t).mean() for t in np.geomspace(0.25, 8, 61)}
        network = network._replace(temperature=float(min(losses, key=losses.get)))
    return network


def _features(docs: DataFrame, vectors: np.ndarray, network: Network | None) -> DataFrame:
    """Per row of (``id``, ``text``) its feature row as bytes, or its score where a network is given."""
    shared = docs.sparkSession.sparkContext.broadcast((vectors, network))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, model = shared.value
        vocabulary = Vocabulary()
        for batch in batches:
            for low in range(0, batch.num_rows, 200):
                part = batch.slice(low, 200)
                x = pooled(table, vocabulary, part.column(1).to_pylist())
                data = pa.array([r.astype("<f4").tobytes() for r in x], pa.binary()) if model is None else pa.array(model.score(x), pa.float64())
                yield pa.RecordBatch.from_arrays([part.column(0), data], ["doc_id", "data"])

    return docs.mapInArrow(work, f"doc_id bigint, data {'binary' if network is None else 'double'}")


def score(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text",
          most: int = FIT_ROWS) -> DataFrame:
    """Per row ``doc_id, score``: probability of label 1, learnt from at most ``most`` rows of ``labels``.

    Null texts count as empty and are scored too. Labels with a null id or label are left out; without usable labels every
    score is the prior. Repeated rows are scored each. An empty table gives an empty result.
    """
    rows = docs.select(docs[id_col].cast("bigint").alias("doc_id"), whole_text(docs, text_col).alias("text"))
    vectors = word_vectors(docs, id_col, text_col)
    chosen = labels.select(labels[id_col].alias("_id"), labels[label_col].cast("int").alias("_label")).dropna().orderBy(
        F.xxhash64("_id"), "_label").limit(most)
    # Bounded by ``most`` rows of two integers, whatever the tables hold.
    sample = rows.join(F.broadcast(chosen), rows["doc_id"] == chosen["_id"])
    truth = {r["_id"]: r["_label"] for r in chosen.collect()}
    found = sorted((r["doc_id"], bytes(r["data"])) for r in _features(sample.select("doc_id", "text"), vectors, None).collect())
    x = np.array([np.frombuffer(data, "<f4") for _, data in found], float).reshape(-1, FEATURES)
    network = fit(x, np.array([truth[key] for key, _ in found], float))
    return _features(rows, vectors, network).withColumnRenamed("data", "score")
