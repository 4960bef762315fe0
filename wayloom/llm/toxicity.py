"""Toxicity by maximum-scoring segment search over token log-odds.

Learning: of near copies among the labelled texts one counts. For each token (a run of letters and digits, ASCII
case folded) the toxic and the clean texts that hold it are counted; a token's score is its log-odds between the two with an informative Dirichlet prior (PRIOR times the pooled counts), kept where it is more than SURE standard errors from nothing
and enough texts hold it (LEAST_TEXTS, and LEAST_SHARE of the rarer label's texts). Every other token costs DRIFT, so that
scores fall in clean text. A linear-time scan (Ruzzo and Tompa) then finds every maximal-scoring segment.
Extreme-value theory says how many segments of a score chance puts into a text of n tokens: K n exp(-lambda S);
lambda solves E[exp(lambda s)] = 1 over clean tokens, K is fitted to clean texts. Segments that chance rarely makes
are the toxic passages. A text's score is a logistic function of their joined evidence (the sum of -ln E, the
largest, and the number of toxic tokens), fitted on the same bounded sample of labelled rows (MOST rows and
common.MOST_BYTES of text by default).

Defined results: null and empty texts have no passages and get the score of texts without evidence. Without both
labels in the learned rows every score is the known label's (0 if none). Extra columns pass through.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

MOST, PRIOR, SURE, DRIFT, LEAST_TEXTS, LEAST_SHARE = 4000, 0.05, 3.0, 0.35, 4, 0.005
FIELDS = "score double, predicted int, n_passages long, passages array<struct<start:long,end:long,score:double>>"

_TOKEN = np.zeros(256, dtype=bool)
_TOKEN[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


@dataclass
class Model:
    tokens: np.ndarray  # sorted hashes of the scored tokens
    scores: np.ndarray
    rate: float  # lambda
    often: float  # K
    weights: np.ndarray  # of the logistic function: constant, evidence, best, hits
    constant: float | None = None  # the score of every text, where nothing can be learned


def token_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all tokens, and where each text's tokens begin."""
    return common.spans_of(_TOKEN[raw], offsets)


def segments(at: list[int], score: list[float], drift: float) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first and last token, score). `at` are the tokens of positive or negative
    score, in order; each token between them, and each of them as well, costs `drift`."""
    found: list[tuple[float, float, int, int]] = []  # sums before and after, first, last
    lower: list[int] = []  # of each segment found: the last one before it that begins at a smaller sum
    total, last = 0.0, -1
    for i, s in zip(at, score, strict=True):
        total -= drift * (i - last - 1)
        last, before = i, total
        total += s - drift
        if s <= drift:
            continue
        left, right, first = before, total, i
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][0] >= left:
                j = lower[j]  # those between begin at no smaller sum than j, and no later search passes j again
            if j < 0 or found[j][1] >= right:
                found.append((left, right, first, i))
                lower.append(j)
                break
            left, first = found[j][0], found[j][2]
            del found[j:], lower[j:]
    return [(first, end, right - left) for left, right, first, end in found]


def log_odds(toxic: np.ndarray, clean: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds of each token with the Dirichlet prior, and how many standard errors it is from nothing."""
    prior = PRIOR * (toxic + clean) + 1e-6
    a, b = toxic + prior, clean + prior
    delta = np.log(a / (a.sum() - a + 1e-6)) - np.log(b / (b.sum() - b + 1e-6))
    return delta, delta / np.sqrt(1 / a + 1 / b)


def rate_of(score: np.ndarray, share: np.ndarray) -> float:
    """The positive solution of sum(share * exp(rate * score)) = 1, by bisection."""
    low, high = 1e-6, 1.0
    while high < 50 and (share * np.exp(high * score)).sum() < 1:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (low, mid) if (share * np.exp(mid * score)).sum() > 1 else (mid, high)
    return low


def _hits(m_tokens: np.ndarray, m_scores: np.ndarray, raw: np.ndarray, offsets: np.ndarray):
    starts, stops, counts = token_spans(raw, offsets)
    hashes = common.hash_spans(raw, starts, stops)
    i = np.minimum(np.searchsorted(m_tokens, hashes), len(m_tokens) - 1)
    hit = np.flatnonzero(m_tokens[i] == hashes) if len(m_tokens) else np.zeros(0, int)
    firsts = np.cumsum(counts) - counts
    bounds = np.searchsorted(hit, np.append(firsts, len(hashes)))
    return starts, stops, counts, firsts, hit, (m_scores[i[hit]] if len(hit) else np.zeros(0)), bounds


def _evidence(m: Model, found: list[tuple[int, int, float]], n: int) -> tuple[list[tuple[int, int, float]], list[float]]:
    rare = [(a, b, s) for a, b, s in found if m.often * n * np.exp(-m.rate * s) < 1.0]
    e = [-np.log(m.often * n) + m.rate * s for _, _, s in rare]
    return rare, [1.0, np.log1p(sum(e)), np.log1p(max(e, default=0.0)), np.log1p(sum(s for _, _, s in rare))]


def fit(rows: list[tuple[str, int]]) -> Model:
    """Learn from (text, label) rows; label 1 is toxic."""
    label = np.array([int(y) for _, y in rows])
    if len(set(label.tolist())) < 2:
        return Model(np.zeros(0, np.uint64), np.zeros(0), 1.0, 1.0, np.zeros(4), float(label[0]) if len(label) else 0.0)
    raw, offsets = common.bytes_of(pa.array([t for t, _ in rows], pa.large_string()))
    starts, stops, counts = token_spans(raw, offsets)
    hashes = common.hash_spans(raw, starts, stops)
    own = _one_of_copies(hashes, counts)
    owner = np.repeat(np.arange(len(rows)), counts)
    tokens, index = np.unique(hashes, return_inverse=True)
    pairs = np.unique(index.astype(np.int64)[own[owner]] * len(rows) + owner[own[owner]])
    toxic = np.bincount(pairs // len(rows), label[pairs % len(rows)], len(tokens))
    texts = np.bincount(pairs // len(rows), minlength=len(tokens)).astype(float)
    clean = texts - toxic
    delta, z = log_odds(toxic, clean)
    rarer = min(label[own].sum(), (1 - label[own]).sum())
    sure = (np.abs(z) > SURE) & (texts >= max(LEAST_TEXTS, LEAST_SHARE * rarer))
    score = np.where(sure, delta, 0.0) - DRIFT
    told = np.bincount(index, (1 - label[owner]) * own[owner], len(tokens))  # how often clean texts hold each token
    rate = rate_of(score, told / max(told.sum(), 1))
    m = Model(tokens[sure], delta[sure], rate, 1.0, np.zeros(4))
    each = _segments_of(m, raw, offsets)
    # K: as many segments of score >= 1 in clean texts as chance makes
    many = sum(1 for (found, _), y in zip(each, label, strict=True) if not y for *_, s in found if s >= 1.0)
    m.often = max(many, 1) / max(float(told.sum()) * np.exp(-m.rate), 1.0)
    x = np.array([_evidence(m, found, max(n, 1))[1] for found, n in each])
    w = np.zeros(x.shape[1])
    for _ in range(30):  # Newton's method on the penalised likelihood
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w)), x.T @ (label - p) - 0.1 * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    m.weights = w
    return m


def _one_of_copies(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Of texts that share one of three least hashes of their three-token windows, the first only."""
    windows = common.mix64(hashes + np.roll(hashes, -1) * np.uint64(3) + np.roll(hashes, -2) * np.uint64(7))
    ends = np.cumsum(counts)
    own, seen = np.zeros(len(counts), bool), set()
    salted = [common.mix64(windows ^ np.uint64(k * 0x5851F42D4C957F2D % 2**64)) for k in (1, 2, 3)]
    for i, (n, end) in enumerate(zip(counts, ends, strict=True)):
        if not n:
            continue
        stop = max(end - 2, end - n + 1)
        least = {(k, int(h[end - n : stop].min())) for k, h in enumerate(salted)}
        own[i] = not least & seen
        seen |= least
    return own


def _segments_of(m: Model, raw: np.ndarray, offsets: np.ndarray) -> list[tuple[list[tuple[int, int, float]], int]]:
    *_, counts, firsts, hit, score, bounds = _hits(m.tokens, m.scores, raw, offsets)
    return [(segments((hit[a:b] - f).tolist(), score[a:b].tolist(), DRIFT) if b > a else [], int(n)) for a, b, f, n in zip(bounds[:-1], bounds[1:], firsts, counts, strict=True)]


def scorer(m: Model):
    """A function of a batch of texts for common.map_texts; passages are in code points, end exclusive."""

    def score(raw, offsets, texts):
        n = len(texts)
        if m.constant is not None:
            return np.full(n, m.constant), np.full(n, m.constant >= 0.5).astype(np.int32), np.zeros(n, np.int64), pa.array([[]] * n, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])))
        starts, stops, counts, firsts, hit, scores, bounds = _hits(m.tokens, m.scores, raw, offsets)
        lead = np.cumsum((raw & 0xC0) != 0x80)  # code points up to a byte
        x, passages = np.zeros((n, 4)), []
        x[:, 0] = 1.0
        for i in range(n):
            a, b, f = bounds[i], bounds[i + 1], firsts[i]
            rare = []
            if b > a:
                rare, x[i] = _evidence(m, segments((hit[a:b] - f).tolist(), scores[a:b].tolist(), DRIFT), max(int(counts[i]), 1))
            base = lead[offsets[i]] - 1 if rare else 0
            passages.append([{"start": int(lead[starts[f + p]] - 1 - base), "end": int(lead[stops[f + q] - 1] - base), "score": float(s)} for p, q, s in rare])
        p = 1 / (1 + np.exp(-np.clip(x @ m.weights, -30, 30)))
        return p, (p >= 0.5).astype(np.int32), np.array([len(v) for v in passages], np.int64), pa.array(passages, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])))

    return score


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = MOST) -> Model:
    """A model from the labelled rows outside the held-out fifth."""
    known = labels.where(labels[label_col].isNotNull() & ~common.held_out(labels[id_col], 5, 0)).select(id_col, labels[label_col].alias("label"))
    return fit(common.learning_sample(docs, known, most, id_col, text_col))


def score(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns keep, score, predicted, n_passages and passages."""
    return common.map_texts(docs, text_col, [c for c in keep if c not in ("score", "predicted", "n_passages", "passages")], FIELDS, scorer(model))
