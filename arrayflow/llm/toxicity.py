"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Labels are given per document. Words that labelled toxic documents use far more often than labelled clean ones mark the
toxic tokens that the field learns from. Its two states are clean and toxic. Forward and
backward passes run over all tokens of a batch at once: tokens lie in columns, every column is first reduced to one
2 x 2 matrix, the matrices carry the state across columns, and the columns then run side by side.

A token has three features: its hashed word and the word's first letters twice, so that forms of a toxic stem count.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arrayflow.llm.common import whole_text

_TOKEN = re.compile(r"[^\W_]+")
BUCKETS = 1 << 18
#: Tokens that a gradient is computed on at once.
CHUNK = 250_000
#: Labelled documents that a field is fitted on at most; which ones is decided by a hash of the id.
FIT_ROWS = 4000
#: Lengths of a word's start that are features beside the word.
STEMS = (5, 7)
#: A feature marks toxic tokens if it is so much likelier in labelled toxic documents, and the log-likelihood ratio is so high.
LEAST_LIFT, LEAST_RATIO = 8.0, 24.0


class Field(NamedTuple):
    """Weights of the toxic state: hashed words, bias, transitions (clean/toxic to clean/toxic), start; and the document scale."""
    words: np.ndarray
    bias: float
    moves: np.ndarray
    first: float
    scale: np.ndarray


def features(word: str) -> list[int]:
    """Buckets of a token: the word in lower case and its starts, each in a name space of its own."""
    word = word.lower()
    return [xxhash.xxh32_intdigest(part, seed) & (BUCKETS - 1) for seed, part in enumerate((word, *(word[:n] for n in STEMS)))]


class Features(dict):
    """Buckets of tokens, remembered; starts again when it is full."""

    def __missing__(self, word: str) -> list[int]:
        if len(self) >= 100_000:
            self.clear()
        got = self[word] = features(word)
        return got


class Weights(dict):
    """Summed weight of a token's features, remembered per token; starts again when it is full."""

    def __init__(self, field: Field):
        super().__init__()
        self._field = field

    def __missing__(self, word: str) -> float:
        if len(self) >= 200_000:
            self.clear()
        got = self[word] = float(self._field.words[features(word)].sum() + self._field.bias)
        return got


def _scan(odds: np.ndarray, starts: np.ndarray, moves: np.ndarray, first: float) -> tuple[np.ndarray, np.ndarray]:
    """Forward probabilities (clean, toxic) of tokens with toxic odds ``odds``; ``starts`` marks first tokens."""
    n = len(odds)
    width = max(1, int(np.sqrt(n)))
    depth = -(-n // width)
    fill = width * depth - n
    odds = np.ascontiguousarray(np.concatenate([odds, np.ones(fill)]).reshape(width, depth).T)
    fresh = np.concatenate([starts, np.ones(fill, bool)]).reshape(width, depth).T
    at, column = np.nonzero(fresh)
    columns = np.split(column, np.searchsorted(at, np.arange(1, depth)))
    (stay, enter), (leave, keep) = np.exp(moves)
    begin = np.exp(first)

    def step(clean: np.ndarray, toxic: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        next_clean, next_toxic = clean * stay + toxic * leave, clean * enter + toxic * keep
        next_clean[..., columns[t]], next_toxic[..., columns[t]] = 1.0, begin
        next_toxic *= odds[t]
        total = next_clean + next_toxic
        next_clean /= total
        next_toxic /= total
        return next_clean, next_toxic, total

    # Each column from either state with certainty. Results are normalized, so a weight keeps how likely each start is.
    clean = np.repeat([[1.0], [0.0]], width, axis=1)
    toxic, weight, scale = 1.0 - clean, np.zeros((2, width)), np.ones((2, width))
    for t in range(depth):
        clean, toxic, total = step(clean, toxic, t)
        # What a column begins with does not matter behind a first token.
        weight[:, columns[t]] = 0.0
        total[:, columns[t]] = scale[:, columns[t]] = 1.0
        scale *= total
        if t % 8 == 7:
            weight += np.log(scale)
            scale[:] = 1.0
    weight += np.log(scale)
    entry = np.empty((2, width))
    entry[:, 0] = 1.0, 0.0
    share = np.exp(weight - weight.max(0))
    for c in range(width - 1):
        part = entry[:, c] * share[:, c]
        out = np.array([part @ clean[:, c], part @ toxic[:, c]])
        entry[:, c + 1] = out / out.sum()
    results = np.empty((2, depth, width))
    clean, toxic = entry
    for t in range(depth):
        clean, toxic, _ = step(clean, toxic, t)
        results[0, t], results[1, t] = clean, toxic
    return results[0].T.reshape(-1)[:n], results[1].T.reshape(-1)[:n]


def marginals(field: Field, weights: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Probability of the toxic state for every token; ``lengths`` are the documents' token counts, none 0."""
    odds = np.exp(np.clip(weights, -30, 30))
    starts, ends = np.zeros(len(odds), bool), np.zeros(len(odds), bool)
    starts[np.cumsum(lengths) - lengths] = True
    ends[np.cumsum(lengths) - 1] = True
    forward = _scan(odds, starts, field.moves, field.first)
    # Backward: the same scan over reversed tokens and transitions; a token's own odds are divided out again.
    backward = [x[::-1] for x in _scan(odds[::-1], ends[::-1], field.moves.T, 0.0)]
    toxic = forward[1] * backward[1] / odds
    return toxic / (toxic + forward[0] * backward[0])


def summaries(field: Field, weights: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per document (constant, largest marginal as log-odds, log of the expected number of toxic tokens), and the marginals."""
    toxic = np.zeros(0)
    out = np.tile([1.0, -12.0, -12.0], (len(lengths), 1))
    full = np.flatnonzero(lengths)
    if len(full):
        toxic = marginals(field, weights, lengths[full])
        at = np.cumsum(lengths[full]) - lengths[full]
        top = np.clip(np.maximum.reduceat(toxic, at), 1e-6, 1 - 1e-6)
        out[full, 1] = np.log(top / (1 - top))
        out[full, 2] = np.log(np.add.reduceat(toxic, at) + 1e-6)
    return out, toxic


def _slopes(weights: np.ndarray, target: np.ndarray, lengths: np.ndarray, moves: np.ndarray, first: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the log-likelihood of the tags ``target``: its slopes by token weight and by transition, and the first tokens."""
    odds = np.exp(np.clip(weights, -30, 30))
    starts, ends = np.zeros(len(odds), bool), np.zeros(len(odds), bool)
    starts[np.cumsum(lengths) - lengths] = True
    ends[np.cumsum(lengths) - 1] = True
    forward = _scan(odds, starts, moves, first)
    backward = [x[::-1] for x in _scan(odds[::-1], ends[::-1], moves.T, 0.0)]
    toxic = forward[1] * backward[1] / odds
    toxic /= toxic + forward[0] * backward[0]
    follows = np.flatnonzero(~starts)
    pair = {(a, b): forward[a][follows - 1] * np.exp(moves[a, b]) * backward[b][follows] for a in (0, 1) for b in (0, 1)}
    whole = sum(pair.values())
    seen = np.bincount(2 * target[follows - 1].astype(int) + target[follows].astype(int), minlength=4).reshape(2, 2)
    expected = np.array([[(pair[a, b] / whole).sum() for b in (0, 1)] for a in (0, 1)])
    return target - toxic, seen - expected, starts


def fit(texts: Sequence[str], labels: Sequence[int], rounds: int = 15, step: float = 0.5) -> Field:
    """Fit a field on labelled documents; without toxic ones every score is low."""
    found = Features()
    return fit_tokens([token_features(found, text) for text in texts], labels, rounds, step)


def token_features(found: Features, text: str) -> np.ndarray:
    """The features of a text's tokens, a row per token."""
    return np.array([found[w] for w in _TOKEN.findall(text)], np.int32).reshape(-1, 1 + len(STEMS))


def fit_tokens(parts: list[np.ndarray], labels: Sequence[int], rounds: int = 15, step: float = 0.5) -> Field:
    """As :func:`fit`, on the documents' token features; ``parts`` is emptied, so that they are not held twice."""
    labels = np.asarray(labels, np.int64)
    lengths = np.array([len(p) for p in parts], np.int64)
    # Toxic features: by the number of documents they are in, on either side.
    inside, outside = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for part, label in zip(parts, labels.tolist(), strict=True):
        (inside if label == 1 else outside)[np.unique(part)] += 1
    tokens = np.concatenate([*parts, np.zeros((0, 1 + len(STEMS)), np.int32)])
    parts.clear()
    owner = np.repeat(np.arange(len(lengths)), lengths)
    n_toxic, n_clean = max(int((labels == 1).sum()), 1), max(int((labels == 0).sum()), 1)
    share = n_toxic / (n_toxic + n_clean)
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = 2 * (np.where(inside > 0, inside * np.log(inside / ((inside + outside) * share)), 0)
                     + np.where(outside > 0, outside * np.log(outside / ((inside + outside) * (1 - share))), 0))
    lift = ((inside + 0.1) / n_toxic) / ((outside + 0.5) / n_clean)
    marks = (lift >= LEAST_LIFT) & (ratio >= LEAST_RATIO)
    target = marks[tokens].any(1) & (labels[owner] == 1)

    # Weighted maximum likelihood of the tagged chains by gradient ascent on states, transitions and bias.
    weights, bias, moves, first = np.zeros(BUCKETS), -2.0, np.zeros((2, 2)), 0.0
    speed = np.full(BUCKETS, 1e-8)
    del owner
    ends = np.cumsum(lengths)
    # Whole documents in chunks of bounded size (none without documents); the gradients of all chunks make one step.
    cuts = np.flatnonzero(np.diff(ends // CHUNK, append=-1)) + 1
    chunks = [(int(ends[a - 1]) if a else 0, int(ends[b - 1]), lengths[a:b]) for a, b in zip([0, *cuts[:-1]], cuts, strict=False)]
    some = max(int(target.sum()), 1)
    for _ in range(rounds if target.any() else 0):
        gain, push, turn, begin = -0.01 * weights, 0.0, np.zeros((2, 2)), []
        for low, high, own in chunks:
            if low < high:
                slope, moved, starts = _slopes(weights[tokens[low:high]].sum(1) + bias, target[low:high], own[own > 0], moves, first)
                for k in range(tokens.shape[1]):
                    gain += np.bincount(tokens[low:high, k], slope, BUCKETS)
                push, turn = push + slope.sum(), turn + moved
                begin.append(slope[starts])
        speed += gain ** 2
        weights = weights + step * gain / np.sqrt(speed)
        bias += step * float(np.clip(push / some, -1, 1))
        moves = moves + step * np.clip(turn / some, -1, 1) - 0.01 * moves
        first += step * float(np.clip(np.concatenate(begin).mean(), -1, 1))
    field = Field(weights, bias, moves, first, np.zeros(3))
    # Document scale: logistic regression on the summaries.
    x = np.concatenate([np.zeros((0, 3)), *[summaries(field, weights[tokens[a:b]].sum(1) + bias, own)[0] for a, b, own in chunks]])
    scale = np.array([np.log(n_toxic / n_clean), 0.0, 0.0]) if len(labels) else np.array([-3.0, 0.0, 0.0])
    for _ in range(50 if 0 < (labels == 1).sum() < len(labels) else 0):
        p = 1 / (1 + np.exp(-x @ scale))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(3)
        scale = scale + np.linalg.solve(hessian, x.T @ (labels - p) - 1e-2 * scale)
    return field._replace(scale=scale)


def fit_field(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text",
              most: int = FIT_ROWS) -> Field:
    """Fit on at most ``most`` labelled documents, chosen by a hash of their id; rows with null labels or ids are left out.

    One task fits on them, whatever the tables hold; the driver gets the weights alone.
    """
    chosen = labels.select(labels[id_col].alias("_id"), labels[label_col].cast("int").alias("_label")).dropna().orderBy(
        F.xxhash64("_id"), "_label").limit(most)
    # Bounded by ``most`` rows of two integers, whatever the tables hold.
    rows = docs.select(docs[id_col].alias("_doc"), whole_text(docs, text_col).alias("text")).join(F.broadcast(chosen), F.col("_doc") == F.col("_id"))
    sample = rows.select("_id", "text", "_label").repartition(1).sortWithinPartitions("_id", "text", "_label").select("text", "_label")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, parts, known = Features(), [], []
        for batch in batches:
            parts += [token_features(found, text) for text in batch.column(0).to_pylist()]
            known += batch.column(1).to_pylist()
        field = fit_tokens(parts, known)
        yield pa.RecordBatch.from_pydict({k: [np.asarray(v, np.float64).tobytes()] for k, v in field._asdict().items()})

    fitted = sample.mapInArrow(work, ", ".join(f"{k} binary" for k in Field._fields)).first()
    # No task runs where no row is left.
    if fitted is None:
        return fit([], [])
    words, bias, moves, first, scale = (np.frombuffer(v, np.float64) for v in fitted)
    return Field(words, float(bias[0]), moves.reshape(2, 2), float(first[0]), scale)


def _score_texts(field: Field, weight: Weights, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scores, token counts, and the marginals of all tokens one after the other."""
    words = [_TOKEN.findall(t) for t in texts]
    lengths = np.array([len(w) for w in words], np.int64)
    flat = np.fromiter((weight[w] for own in words for w in own), np.float64, int(lengths.sum()))
    x, toxic = summaries(field, flat, lengths)
    return 1 / (1 + np.exp(-x @ field.scale)), lengths, toxic


SCORES = "doc_id bigint, score double, spans array<struct<start:int,end:int,probability:double>>"


def score(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text", span_above: float = 0.5) -> DataFrame:
    """Per row ``doc_id, score, spans``: probability that the document is toxic, and its offending character offsets.

    A null or empty text has no tokens and gets the score of a text without evidence. Spans join neighbouring tokens whose
    marginal is above ``span_above``. Repeated rows are scored each; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        weight = Weights(model)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            scores, lengths, toxic = _score_texts(model, weight, texts)
            spans, at = [], np.cumsum(lengths) - lengths
            for i, n in enumerate(lengths.tolist()):
                own: list[dict] = []
                hot = np.flatnonzero(toxic[at[i]:at[i] + n] > span_above)
                if len(hot):
                    places = [m.span() for m in _TOKEN.finditer(texts[i])]
                    for group in np.split(hot, np.flatnonzero(np.diff(hot) > 1) + 1):
                        own.append({"start": places[group[0]][0], "end": places[group[-1]][1], "probability": float(toxic[at[i] + group].max())})
                spans.append(own)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores, pa.float64()),
                 pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("probability", pa.float64())])))],
                ["doc_id", "score", "spans"])

    rows = docs.select(docs[id_col].cast("bigint").alias("doc_id"), whole_text(docs, text_col).alias("text"))
    return rows.mapInArrow(work, SCORES)


def drop_toxic(docs: DataFrame, field: Field, threshold: float, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose score is below ``threshold``, with all their columns; rows are scored where they are."""
    score_of = _scorer(docs.sparkSession, field)
    return docs.where(score_of(whole_text(docs, text_col)) < threshold)


def _scorer(spark: SparkSession, field: Field) -> Callable[[Column], Column]:
    shared = spark.sparkContext.broadcast(field)

    @F.pandas_udf("double")
    def scorer(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        weight = Weights(shared.value)
        for texts in batches:
            scores, _, _ = _score_texts(shared.value, weight, texts.tolist())
            yield pd.Series(scores)
    return scorer
