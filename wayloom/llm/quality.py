"""A quality classifier by attention-based multiple-instance learning.

A text is a bag of passages of PASSAGE words. Each passage is described by shares of its bytes and words (FEATURES)
and encoded by a small network. A gated attention (tanh times sigmoid) weighs the passages against each other, and
the weighted mean of the encodings is scored by a logistic function. Encoder, attention and score are learned
together, by gradient descent in numpy, from the labels of whole documents in a bounded sample (MOST rows by
default); no passage is ever labelled.

Defined results: null, empty and blank texts are one passage without words, scored like any other. Without both
labels in the learned rows every score is the known label's (0 if none). Extra columns pass through.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

PASSAGE, HIDDEN, GATE, MOST, STEPS, RATE = 48, 16, 8, 3000, 150, 0.03
FEATURES = ("upper", "lower", "digits", "symbols", "marks", "other letters", "bytes a word", "short words", "long words", "same as the word before", "same as two words before", "distinct words", "lines", "words", "words of the text")
FIELDS = "score double, predicted int, n_passages long, attention double"

_UPPER, _LOWERCASE, _DIGIT, _SYMBOL, _MARK, _HIGH, _LINE = (np.zeros(256, np.int32) for _ in range(7))
_UPPER[65:91] = _LOWERCASE[97:123] = _DIGIT[48:58] = _HIGH[128:256] = _LINE[10] = 1
_SYMBOL[[ord(c) for c in "#*$%&|<>{}[]=_\\^~@/"]] = 1
_MARK[[ord(c) for c in "!?;:"]] = 1


@dataclass
class Model:
    mean: np.ndarray
    spread: np.ndarray
    weights: list[np.ndarray]  # encoder and its offset, tanh gate, sigmoid gate, attention, score and its offset
    constant: float | None = None


def passages(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The features of all passages of all texts, and the number of passages of each text (one at least)."""
    starts, stops, counts = common.word_spans(raw, offsets)
    n = np.maximum(-(-counts // PASSAGE), 1)
    owner = np.repeat(np.arange(len(counts)), n)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    first = (np.cumsum(counts) - counts)[owner] + nth * PASSAGE
    words = np.clip(counts[owner] - nth * PASSAGE, 0, PASSAGE)
    x = np.zeros((len(owner), len(FEATURES)), "f4")
    if not len(starts):
        return x, n
    begin, end = starts[np.minimum(first, len(starts) - 1)], stops[np.clip(first + words - 1, 0, len(stops) - 1)]
    begin, end = np.where(words > 0, begin, 0), np.where(words > 0, end, 0)
    size = np.maximum(end - begin, 1)

    def share(kind: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(kind[raw])])
        return (total[end] - total[begin]) / size

    def per_word(values: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(values)])
        return (total[np.minimum(first + words, len(values))] - total[np.minimum(first, len(values))]) / np.maximum(words, 1)

    for k, kind in enumerate((_UPPER, _LOWERCASE, _DIGIT, _SYMBOL, _MARK, _HIGH)):
        x[:, k] = share(kind)
    length, hashes = stops - starts, common.hash_spans(raw, starts, stops)
    place = np.repeat(np.arange(len(owner)), words)
    x[:, 6] = np.log1p(per_word(length))
    x[:, 7], x[:, 8] = per_word(length <= 2), per_word(length >= 12)
    for lag, k in ((1, 9), (2, 10)):
        same = np.zeros(len(hashes), bool)
        same[lag:] = (hashes[lag:] == hashes[:-lag]) & (place[lag:] == place[:-lag])
        x[:, k] = per_word(same)
    keyed = np.sort((place.astype(np.uint64) << np.uint64(32)) | (hashes >> np.uint64(32)))
    new = np.append(True, keyed[1:] != keyed[:-1])
    x[:, 11] = np.bincount((keyed[new] >> np.uint64(32)).astype(np.int64), minlength=len(owner)) / np.maximum(words, 1)
    x[:, 12] = share(_LINE) * 20
    x[:, 13], x[:, 14] = words / PASSAGE, np.log1p(counts[owner]) / 5
    return x, n


def forward(m: Model, x: np.ndarray, n: np.ndarray):
    """Encodings, gates, attention weights, weighted means and scores of all texts."""
    w1, b1, v, u, a, w2, b2 = m.weights
    h = np.tanh((x - m.mean) / m.spread @ w1 + b1)
    t, g = np.tanh(h @ v), 1 / (1 + np.exp(-np.clip(h @ u, -30, 30)))
    at = np.cumsum(n) - n
    e = np.exp(np.clip((t * g) @ a, -20, 20))
    alpha = e / np.repeat(np.add.reduceat(e, at), n)
    z = np.add.reduceat(alpha[:, None] * h, at, axis=0)
    return h, t, g, alpha, z, 1 / (1 + np.exp(-np.clip(z @ w2 + b2[0], -30, 30)))


def fit(rows: list[tuple[str, int]], seed: int = 0) -> Model:
    """Learn from (text, label) rows; both labels weigh alike in all, then the offset returns to the true shares."""
    y = np.array([int(label) for _, label in rows], float)
    none = np.zeros(len(FEATURES))
    if len(set(y.tolist())) < 2:
        return Model(none, none + 1, [], float(y[0]) if len(y) else 0.0)
    x, n = passages(*common.bytes_of(pa.array([t for t, _ in rows], pa.large_string())))
    rng = np.random.default_rng(seed)
    k = len(FEATURES)
    m = Model(x.mean(axis=0), x.std(axis=0) + 1e-3, [rng.normal(0, k**-0.5, (k, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.3, (HIDDEN, GATE)), rng.normal(0, 0.3, (HIDDEN, GATE)), rng.normal(0, 0.3, GATE), rng.normal(0, 0.3, HIDDEN), np.zeros(1)])
    x = (x - m.mean) / m.spread
    centred = Model(none, none + 1, m.weights)
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())) / len(y)
    at, owner = np.cumsum(n) - n, np.repeat(np.arange(len(n)), n)
    first, second = [np.zeros_like(p) for p in m.weights], [np.zeros_like(p) for p in m.weights]
    for step in range(1, STEPS + 1):
        h, t, g, alpha, z, p = forward(centred, x, n)
        w1, b1, v, u, a, w2, b2 = m.weights
        d = weight * (p - y)
        dz = d[:, None] * w2
        dz_of = dz[owner]
        pull = (dz_of * h).sum(axis=1)
        ds = alpha * (pull - np.add.reduceat(alpha * pull, at)[owner])
        dt, dg = ds[:, None] * a * g * (1 - t * t), ds[:, None] * a * t * g * (1 - g)
        dh = (alpha[:, None] * dz_of + dt @ v.T + dg @ u.T) * (1 - h * h)
        grads = [x.T @ dh, dh.sum(axis=0), h.T @ dt, h.T @ dg, (t * g).T @ ds, z.T @ d, np.array([d.sum()])]
        for p_, grad, f, s in zip(m.weights, grads, first, second, strict=True):
            grad = grad + 1e-4 * p_
            f += 0.1 * (grad - f)
            s += 0.01 * (grad * grad - s)
            p_ -= RATE * (f / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
    m.weights[6] += np.log(y.mean() / (1 - y.mean())) * 0.5
    return m


def scorer(m: Model):
    """A function of a batch of texts for common.map_texts."""

    def score(raw, offsets, texts):
        if m.constant is not None:
            k = len(texts)
            return np.full(k, m.constant), np.full(k, m.constant >= 0.5).astype(np.int32), np.zeros(k, np.int64), np.zeros(k)
        x, n = passages(raw, offsets)
        *_, alpha, _, p = forward(m, x, n)
        return p, (p >= 0.5).astype(np.int32), n, np.maximum.reduceat(alpha, np.cumsum(n) - n)

    return score


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = MOST) -> Model:
    """A model from the labelled rows outside the held-out third."""
    known = labels.where(labels[label_col].isNotNull() & ~common.held_out(labels[id_col], 3, 1)).select(id_col, labels[label_col].alias("label"))
    return fit(common.learning_sample(docs, known, most, id_col, text_col))


def score(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns keep, score, predicted, n_passages and the largest attention weight."""
    return common.map_texts(docs, text_col, [c for c in keep if c not in ("score", "predicted", "n_passages", "attention")], FIELDS, scorer(model))
