"""How the models learn: growing and pruning of rules, and the gradients of both networks, against plain Python."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wayloom.llm import common, language, quality, rules

WORDS = "river stone garden window market letter summer bridge forest candle mirror harbour winter village table paper music silver morning shadow".split()


def text(rng, symbols=False, digits=False, capitals=False, marks=False):
    """90 words, of which signs take the place of letters, so that words stay as long."""
    words = [rng.choice(WORDS) for _ in range(90)]
    for i in range(0, 90, 2):
        w = "77" + words[i][2:] if digits else words[i]
        words[i] = w[:-1] + ("%" if symbols else "!" if marks else w[-1])
    return " ".join(w.upper() if capitals and i % 3 == 0 else w for i, w in enumerate(words))


KINDS = [{}, {"symbols": True}, {"digits": True}, {"symbols": True, "digits": True}, {"capitals": True}, {"marks": True}, {"capitals": True, "marks": True}]
BAD = {3, 6}


def plain_growing(rows, bounds):
    """The best condition by gain, again and again, by counting rows."""
    rule, rows = [], list(rows)
    while len(rule) < rules.CONDITIONS:
        good, bad = sum(not r["_bad"] for r in rows), sum(r["_bad"] for r in rows)
        if bad < rules.LEAST or not good:
            break
        best = (0.0, "", None)
        for name, at in bounds.items():
            for bound in at:
                for above in (True, False):
                    in_ = [r for r in rows if (r[name] > bound) == above]
                    b = sum(r["_bad"] for r in in_)
                    if b >= rules.LEAST:
                        c = rules.Condition(name, above, bound)
                        best = max(best, (b * (math.log2(b / len(in_)) - math.log2(bad / (good + bad))), str(c), c), key=lambda x: x[:2])
        if best[2] is None:
            break
        rule.append(best[2])
        rows = [r for r in rows if (r[best[2].feature] > best[2].bound) == best[2].above]
    return tuple(rule)


def test_two_rules_of_two_conditions(spark, rng, monkeypatch):
    """Symbols with digits are bad, and capitals with exclamation marks; each alone is good."""
    docs = spark.createDataFrame([(i, text(rng, **KINDS[i % 7])) for i in range(420)], "doc_id long, text string")
    labels = docs.select("doc_id", (~(F.col("doc_id") % 7).isin(*BAD)).cast("int").alias("quality"))
    grow, seen = rules._grow, []

    def watched(rows, bounds):
        seen.append(([r.asDict() for r in rows.collect()], bounds, grow(rows, bounds)))
        return seen[-1][2]

    monkeypatch.setattr(rules, "_grow", watched)
    learned = rules.learn(docs, labels)
    assert sorted(sorted(c.feature for c in r) for r in learned) == [["capitals", "marks_a_word"], ["digits", "symbols_a_word"]]
    for rows, bounds, rule in seen:
        assert rule == plain_growing(rows, bounds)
    out = rules.apply(docs, learned)
    wrong = out.where(F.col("kept") == (F.col("doc_id") % 7).isin(*BAD))
    assert wrong.count() <= 4  # of 420: bounds lie between shares of the rows learned from, others may lie beyond
    assert {r["rejected_by"] for r in out.where("not kept").select("rejected_by").distinct().collect()} == {" and ".join(map(str, r)) for r in learned}


@pytest.mark.parametrize("good, kept", [(0, 1), (1, 2), (400, 0)])
def test_conditions_are_pruned(spark, good, kept):
    """50 bad rows with many symbols, and `good` ones that only a second condition tells apart; a third never helps. A rule
    that isn't sure with all its conditions goes."""
    a, b, c = rules.Condition("symbols_a_word", True, 0.5), rules.Condition("digits", True, 0.1), rules.Condition("words", True, 10.0)
    row = lambda bad, digits: (bad, 100, 100, 500, digits, 100, 0, 0, 0)
    rows = [row(True, 200)] * 50 + ([row(False, 10)] * good if good < 400 else [row(False, 200)] * 20)
    told = spark.createDataFrame(rows, "_bad boolean, n_words long, n_symbols long, word_chars long, n_digits long, n_lines long, n_dup_lines long, n_repeat_words long, n_capitals long")
    assert rules._prune(told, (a, b, c)) == (a, b, c)[:kept]


def test_first_step_of_attention_goes_down_the_slope(rng, monkeypatch):
    """Adam's first step is RATE against the sign of each gradient: that of numeric differences of the loss."""
    rows = [(" ".join(rng.choice(WORDS) + ("!" if i % 2 and rng.random() < 0.5 else "") for _ in range(rng.randrange(5, 300))), i % 2) for i in range(24)]
    made = {}
    for steps in (0, 1):
        monkeypatch.setattr(quality, "STEPS", steps)
        made[steps] = quality.fit(rows)
    start, moved = made[0], made[1]
    x, n = quality.passages(*common.bytes_of(pa.array([t for t, _ in rows], pa.large_string())))
    y = np.array([label for _, label in rows], float)
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())) / len(y)

    def loss():
        p = quality.forward(start, x, n)[-1]
        return -(weight * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum() + 0.5e-4 * sum((w * w).sum() for w in start.weights)

    compared = 0
    for before, after in zip(start.weights, moved.weights, strict=True):
        for i in rng.sample(range(before.size), min(25, before.size)):
            held = before.flat[i]
            ends = []
            for e in (1e-5, -1e-5):
                before.flat[i] = held + e
                ends.append(loss())
            before.flat[i] = held
            slope = (ends[0] - ends[1]) / 2e-5
            if abs(slope) > 1e-6:
                compared += 1
                assert math.isclose(after.flat[i] - held, -quality.RATE * np.sign(slope), rel_tol=0.05)
    assert compared > 60


def test_first_step_of_language_goes_down_the_slope(rng, monkeypatch):
    rows = [(" ".join(rng.choice(WORDS) for _ in range(30)), "en") for _ in range(10)] + [(" ".join(rng.choice(WORDS).replace("e", "ä") for _ in range(30)), "de") for _ in range(10)]
    monkeypatch.setattr(language, "BATCH", 10_000)
    made = {}
    for epochs in (0, 1):
        monkeypatch.setattr(language, "EPOCHS", epochs)
        made[epochs] = language.fit(rows)
    start, moved = made[0], made[1]
    # the windows as fit cuts them: the first two draws of its generator
    x, owner, _ = language.windows(*common.bytes_of(pa.array([t for t, _ in rows], pa.large_string())))
    draw = np.random.default_rng(0)
    cut = np.where(draw.random(len(x)) < 0.3, draw.integers(8, language.WINDOW, len(x)), language.WINDOW)
    x = np.where(np.arange(language.WINDOW) < cut[:, None], x, 0)
    y = np.array([start.languages.index(lang) for _, lang in rows])[owner]
    weight = (len(y) / np.bincount(y) / 2)[y]
    fields = ("embed", "filters", "bias", "dense", "offset")
    exact = language.Model(start.languages, *[[p.astype("f8") for p in v] if isinstance(v, list) else v.astype("f8") for v in (getattr(start, f) for f in fields)])
    params = [[p for f in fields for p in (getattr(m, f) if isinstance(getattr(m, f), list) else [getattr(m, f)])] for m in (exact, moved)]

    def loss():
        h, _ = language.pooled(exact, x)
        p = language.softmax(np.maximum(h, 0) @ exact.dense + exact.offset)
        return -(weight * np.log(p[np.arange(len(y)), y])).mean()

    compared = 0
    for before, after in zip(*params, strict=True):
        for i in rng.sample(range(before.size), min(20, before.size)):
            held = before.flat[i]
            ends = []
            for e in (1e-6, -1e-6):
                before.flat[i] = held + e
                ends.append(loss())
            before.flat[i] = held
            slope = (ends[0] - ends[1]) / 2e-6
            if abs(slope) > 1e-5:
                compared += 1
                assert math.isclose(after.flat[i] - held, -language.RATE * np.sign(slope), rel_tol=0.05)
    assert compared > 30
