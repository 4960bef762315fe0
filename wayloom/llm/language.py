"""Language identification by a byte convolutional network.

Bytes of a text (ASCII letters folded) are cut into windows of WINDOW bytes. Each byte is embedded; filters of
several widths run over a window, the largest answer of each filter is kept (max pooling), and a softmax over these
gives the languages' probabilities. A text's probabilities are the mean over all its windows, weighted by the bytes
they hold. The network is trained in numpy on a bounded sample of labelled rows (`most` rows, MOST by default, and
common.MOST_BYTES of text); of their windows MOST_WINDOWS, drawn at random, are learned from in each epoch.

Defined results: null texts and texts without a letter are `und`, score 0; so is every text if nothing is labelled.
An empty table gives an empty result. Extra columns pass through; columns named as the result's are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW, DEPTH, WIDTHS, FILTERS = 128, 8, (2, 3, 4), 12
MOST, MOST_WINDOWS, EPOCHS, BATCH, RATE = 3000, 20_000, 5, 256, 0.01
FIELDS = "lang_pred string, score double"


@dataclass
class Model:
    languages: list[str]
    embed: np.ndarray
    filters: list[np.ndarray]
    bias: list[np.ndarray]
    dense: np.ndarray
    offset: np.ndarray


def windows(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of all texts (zero-padded at a text's end), the text of each, and the bytes each holds."""
    sizes = np.diff(offsets)
    counts = -(-sizes // WINDOW)
    owner = np.repeat(np.arange(len(sizes)), counts)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    begin = offsets[owner] + nth * WINDOW
    held = np.minimum(offsets[owner + 1] - begin, WINDOW)
    padded = np.concatenate([common._LOWER[raw], np.zeros(WINDOW, np.uint8)])
    block = np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[begin] if len(begin) else np.zeros((0, WINDOW), np.uint8)
    return np.where(np.arange(WINDOW) < held[:, None], block, 0).astype(np.uint8), owner, held


def pooled(m: Model, x: np.ndarray, where: bool = False) -> tuple[np.ndarray, list[np.ndarray]]:
    """The pooled answers of all filters for windows x; with where, the position of each filter's largest answer."""
    widest = max(WIDTHS)
    kernel = np.zeros((widest * DEPTH, len(WIDTHS) * FILTERS), "f4")  # narrower filters end in zeros
    for j, (w, k) in enumerate(zip(WIDTHS, m.filters, strict=True)):
        kernel[: w * DEPTH, j * FILTERS : (j + 1) * FILTERS] = k
    e = m.embed[x].reshape(len(x), -1)
    spans = np.lib.stride_tricks.sliding_window_view(e, widest * DEPTH, axis=1)[:, ::DEPTH]
    answers = (np.ascontiguousarray(spans).reshape(-1, widest * DEPTH) @ kernel).reshape(len(x), -1, kernel.shape[1])
    at = np.split(answers.argmax(axis=1), len(WIDTHS), axis=1) if where else []
    return answers.max(axis=1) + np.concatenate(m.bias), at


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(rows: list[tuple[str, str]], seed: int = 0, most_windows: int = MOST_WINDOWS) -> Model | None:
    """Train on (text, language) rows: Adam on cross-entropy, each language with the same weight in all."""
    import pyarrow as pa

    rng = np.random.default_rng(seed)
    languages = sorted({lang for _, lang in rows})
    if not languages:
        return None
    raw, offsets = common.bytes_of(pa.array([t for t, _ in rows], pa.large_string()))
    x, owner, held = windows(raw, offsets)
    y = np.array([languages.index(lang) for _, lang in rows])[owner] if len(owner) else np.zeros(0, int)
    cut = np.where(rng.random(len(x)) < 0.3, rng.integers(8, WINDOW, len(x)), WINDOW)  # short texts are learned too
    x = np.where(np.arange(WINDOW) < cut[:, None], x, 0)
    n = len(WIDTHS) * FILTERS
    m = Model(languages, rng.normal(0, 0.5, (256, DEPTH)).astype("f4"), [rng.normal(0, (w * DEPTH) ** -0.5, (w * DEPTH, FILTERS)).astype("f4") for w in WIDTHS], [np.zeros(FILTERS, "f4") for _ in WIDTHS], rng.normal(0, n**-0.5, (n, len(languages))).astype("f4"), np.zeros(len(languages), "f4"))
    weight = (len(y) / np.maximum(np.bincount(y, minlength=len(languages)), 1) / len(languages))[y].astype("f4")
    params = [m.embed, *m.filters, *m.bias, m.dense, m.offset]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(x))[:most_windows]
        for s in range(0, len(order), BATCH):
            i = order[s : s + BATCH]
            h, at = pooled(m, x[i], True)
            a = np.maximum(h, 0)
            d = softmax(a @ m.dense + m.offset)
            d[np.arange(len(i)), y[i]] -= 1
            d *= (weight[i] / len(i))[:, None]
            dh = (d @ m.dense.T) * (h > 0)
            d_embed, d_filters, d_bias = np.zeros_like(m.embed), [], []
            for j, (w, k) in enumerate(zip(WIDTHS, m.filters, strict=True)):
                g = dh[:, j * FILTERS : (j + 1) * FILTERS]
                seen = x[i][np.arange(len(i))[:, None, None], at[j][:, :, None] + np.arange(w)]  # windows, filters, width
                d_filters.append(np.einsum("bf,bfk->kf", g, m.embed[seen].reshape(*seen.shape[:2], -1)))
                np.add.at(d_embed, seen, (g[:, :, None] * k.T[None]).reshape(*seen.shape, DEPTH))
                d_bias.append(g.sum(axis=0))
            step += 1
            for p, grad, f, v in zip(params, [d_embed, *d_filters, *d_bias, a.T @ d, d.sum(axis=0)], first, second, strict=True):
                f += 0.1 * (grad - f)
                v += 0.001 * (grad * grad - v)
                p -= RATE * (f / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return m


def scorer(m: Model | None):
    """A function of a batch of texts for common.map_texts."""

    def score(raw, offsets, texts):
        n = len(texts)
        lang, top = np.full(n, "und", dtype=object), np.zeros(n)
        if m is None or not len(raw):
            return lang, top
        letter = np.add.reduceat(np.append((raw | 32) - 97 < 26, False).astype(np.int64), np.minimum(offsets[:-1], len(raw))) * (np.diff(offsets) > 0) > 0
        for i in np.flatnonzero(~letter & (np.diff(offsets) > 0)):
            letter[i] = any(c.isalpha() for c in texts[int(i)].as_py())
        x, owner, held = windows(raw, offsets)
        total = np.zeros((n, len(m.languages)))
        for s in range(0, len(x), 128):
            h, _ = pooled(m, x[s : s + 128])
            np.add.at(total, owner[s : s + 128], softmax(np.maximum(h, 0) @ m.dense + m.offset) * held[s : s + 128, None])
        share = total / np.maximum(total.sum(axis=1, keepdims=True), 1e-12)
        lang[letter] = np.array(m.languages, dtype=object)[share.argmax(axis=1)][letter]
        top[letter] = share.max(axis=1)[letter]
        return lang, np.clip(top, 0.0, 1.0)

    return score


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most: int = MOST) -> Model | None:
    """A model from the labelled rows outside the held-out third."""
    labels = docs.where(F.col(lang_col).isNotNull() & ~common.held_out(F.col(id_col), 3, 1)).select(id_col, F.col(lang_col).alias("label"))
    return fit(common.learning_sample(docs, labels, most, id_col, text_col))


def predict(docs: DataFrame, model: Model | None, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns keep, and lang_pred and score."""
    return common.map_texts(docs, text_col, [c for c in keep if c not in ("lang_pred", "score")], FIELDS, scorer(model))
