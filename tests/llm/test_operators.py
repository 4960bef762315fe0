import hashlib
import math
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wayloom.llm import common, language, mixing, near, neighbours, packing, pages, pii, quality, rules, toxicity

from .conftest import sentence

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
FIXED = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def documents(spark, texts, **more):
    rows = [(i, t, "en", "ab"[i % 2]) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


# --- kernels --------------------------------------------------------------------------------


def test_word_hashes_depend_on_the_word_alone():
    texts = ["a bb  ccc", None, "", "CCC a", "y" * 300 + " bb", "é bb"]
    raw, offsets = common.bytes_of(pa.array(texts))
    starts, stops, counts = common.word_spans(raw, offsets)
    assert counts.tolist() == [3, 0, 0, 2, 2, 2]
    h = common.hash_spans(raw, starts, stops)
    assert h[2] == h[3] and h[0] == h[4] and h[1] == h[6] == h[8] and len(set(h.tolist())) == 5
    alone = common.bytes_of(pa.array(["y" * 300]))
    assert common.hash_spans(alone[0], *common.word_spans(*alone)[:2])[0] == h[5]


# --- 1: personal data -----------------------------------------------------------------------


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def valid(kind, value):
    d = re.sub("[^0-9]", "", value)
    return {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in value.split(".")), "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]


PII_TEXTS = ["a@b.c_d@e.f a.b@c-d.e.f", "1.2.3.4.5 256.1.1.1 001.02.3.4 9.9.9.9", "4111 1111 1111 1111 and 4111-1111-1111-1112", "+1 (743) 555-3824. +1 2 +49 123456789012345678", "é+ü +33 1 23 45 67 89 x@y x@y.z", "a.b@c.d@e.f.g@h i@j.k", "1.2.3.4 1.1.1.1.2.2.2.2.3 00.1.2.3x4.5.6.7", None, "", "4111111111111111 " * 3, "9" * 3000, "+" * 50 + "12345678 a@@b.c"]


def test_base_spans_match_brute_force(spark):
    got = {r["doc_id"]: (r["spans"], r["sha"]) for r in pii.find(documents(spark, PII_TEXTS)).select("doc_id", pii.digest(F.col("found")).alias("spans"), F.sha2(pii.digest(F.col("base")), 256).alias("sha")).collect()}
    for i, text in enumerate(PII_TEXTS):
        spans = ",".join(f"{k}:{m.start()}:{m.end()}" for k in FIXED for m in re.finditer(FIXED[k], text or "") if valid(k, m[0]))
        assert got[i] == (spans, hashlib.sha256(spans.encode()).hexdigest())


def test_contexts_find_unseen_identifiers(spark, rng):
    texts = [f"{sentence(rng, 20)} dial-me +1 555 000 {1000 + i} thanks-again {sentence(rng, 9)}" for i in range(12)]
    texts += [f"{sentence(rng, 15)} dial-me 0555-77{i} thanks-again" for i in range(3)] + ["the 0555-99 of the room"]
    rows = {r["doc_id"]: [x["kind"] for x in r["found"]] for r in pii.find(documents(spark, texts)).collect()}
    assert all(rows[i] == ["phone"] for i in range(15)) and rows[15] == []


def test_patterns_of_the_second_generation(spark, rng):
    """ref= values are found by dial-me, which phones induce; what follows note-to only stands beside such values."""
    texts = [f"{sentence(rng, 20)} dial-me +1 555 000 {1000 + i} {sentence(rng, 9)}" for i in range(12)]
    texts += [f"{sentence(rng, 15)} dial-me 0555-77{i} note-to" for i in range(6)]
    texts += [f"{sentence(rng, 12)} 0555-88{i} note-to {sentence(rng, 3)}" for i in range(3)]
    rows = {r["doc_id"]: [x["kind"] for x in r["found"]] for r in pii.find(documents(spark, texts)).collect()}
    assert all(rows[i] == ["phone"] for i in range(21))


def test_contexts_need_most_places(spark, rng):
    """A word that stands before an address in 45 of 100 places is no pattern."""
    texts = [f"{sentence(rng, 8)} via u{i}@mail{i}.example.org {sentence(rng, 8)}" for i in range(45)] + [f"{sentence(rng, 8)} via north {sentence(rng, 8)}" for i in range(45)]
    texts += [f"{sentence(rng, 8)} via x{i}9 {sentence(rng, 8)}" for i in range(10)]
    rows = {r["doc_id"]: len(r["found"]) for r in pii.find(documents(spark, texts)).collect()}
    assert all(rows[i] == (i < 45) for i in range(100))


def test_pii_is_linear(spark):
    many = " ".join(f"user{i}@host{i}.example.org" for i in range(20_000))
    docs = documents(spark, ["x" * 1_000_000 + " a@b.cd", "1" * 300_000, many])
    start = time.time()
    found = pii.find(docs).select("doc_id", "n_email", "found", "text")
    rows = {r["doc_id"]: r for r in pii.redact(found).collect()}
    assert time.time() - start < 90
    assert rows[0]["found"][0]["start"] == 1_000_001 and rows[2]["n_email"] == 20_000 and rows[2]["text"] == " ".join(["<email>"] * 20_000)
    assert many[rows[2]["found"][777]["start"] : rows[2]["found"][777]["end"]] == "user777@host777.example.org"


def test_pii_clashing_columns(spark):
    names = ["_id", "_h", "_free", "_more", "_email", "found"]
    out = pii.find(documents(spark, ["a@b.cd"]).select("*", *[F.lit(7).alias(n) for n in names]))
    row = out.first()
    assert [row[n] for n in names[:-1]] == [7] * 5 and len(row["found"]) == 1 and row["n_email"] == 1


def test_redaction(spark):
    out = pii.redact(pii.find(documents(spark, ["to a@b.de, from 1.2.3.4!", "nothing"]))).select("doc_id", "text").collect()
    assert {tuple(r) for r in out} == {(0, "to <email>, from <ip>!"), (1, "nothing")}


def test_pii_odd(odd, none):
    out = pii.find(odd).collect()
    assert len(out) == 10 and {r["score"] for r in out} == {1.0} and all(r["found"] == [] for r in out)
    assert pii.find(none).count() == 0


# --- 2: rules -------------------------------------------------------------------------------


def test_measures_match_brute_force(spark, rng, odd_rows):
    texts = [r[1] for r in odd_rows] + ["a b c a b c d", "x x x x", "q\nq\n\nr\nq", "# $ %%", " ".join(["k l m"] * 40)] + [sentence(rng, 80) for _ in range(5)]
    got = {r["doc_id"]: r for r in rules.measures(documents(spark, texts)).collect()}
    for i, t in enumerate(texts):
        t = t or ""
        w = WORD.findall(t)
        c = Counter(zip(w, w[1:], w[2:], strict=False))
        covered = {k + j for k in range(len(w) - 2) if c[tuple(w[k : k + 3])] > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        assert [got[i][x] for x in rules.BASE] == [len(w), sum(map(len, w)), sum(ch in rules.SYMBOLS for ch in t), len(lines) - len(set(lines)), len(covered)], t[:50]


def test_rules_are_learned_and_ordered(spark, rng):
    texts = [sentence(rng, 70) if i % 3 else " ".join(x + "%%%" for x in sentence(rng, 70).split()) for i in range(240)]
    docs = documents(spark, texts)
    labels = docs.select("doc_id", (F.col("doc_id") % 3 != 0).cast("int").alias("quality"))
    learned = rules.learn(docs, labels)
    assert learned and all(len(r) <= rules.CONDITIONS for r in learned)
    assert rules.apply(docs, learned).where((F.col("doc_id") % 3 != 0) != F.col("kept")).count() == 0
    assert rules.learn(docs, labels.limit(0)) == []


def test_rules_odd(odd, none):
    out = rules.apply(odd, []).collect()
    assert sum(r["kept"] for r in out) == 0 and sum(not r["base_failed"] for r in out) == 0
    assert rules.apply(none, []).count() == 0


# --- 3: pages -------------------------------------------------------------------------------

PAGE = """<!doctype html><html><head><title>no</title><style>p{}</style><script>var t="</p>";</script></head><body><header><a href=/>Home</a></header>
<nav><ul><li><a href=a>A</a><li><a href=b>B</a></ul></nav><div class="cookie-notice">We use cookies on this page, friend.</div>
<article><h1>A &amp; B</h1><p>First paragraph with   many words, and
an end.<p>Sh&eacute;rt.</p><div class="ad">Buy this now, it is good.</div><p>Last &lt;one&gt; &#8212; ok.</article>
<section id="comments"><p>I am a reader and I say a lot of words here, really a lot of words.</p></section><form><input><p>Join us today.</form><aside>More to read here.</aside><footer>&copy; us</footer></body></html>"""


def test_main_text(spark):
    assert pages.main_text(PAGE) == "A & B\nFirst paragraph with many words, and an end.\nShért.\nLast <one> — ok."
    assert [pages.main_text(x) for x in (None, "", "<p", "<nav>x</nav>")] == [""] * 4
    rows = spark.createDataFrame([(1, "u", PAGE), (2, None, None)], "page_id long, url string, html string")
    assert [(r["page_id"], r["n_chars"]) for r in pages.extract(rows, ["page_id", "url"]).orderBy("page_id").collect()] == [(1, len(pages.main_text(PAGE))), (2, 0)]


@pytest.mark.parametrize(
    "html, text",
    [
        ("<html><head><title>t</title><p>Some text that is long enough to stay here, is it not, as it has no fewer words than a paragraph of prose would have.</p>", "Some text that is long enough to stay here, is it not, as it has no fewer words than a paragraph of prose would have."),
        ("<title>t</title>Plain words without any tag before them are the body of the page, if there are as many as a paragraph of prose would have.", "Plain words without any tag before them are the body of the page, if there are as many as a paragraph of prose would have."),
        ("<article><p>One text here, long enough to be content.<svg><path><p>Another text here, long enough as well.</article>", "One text here, long enough to be content.\nAnother text here, long enough as well."),
        ("<article><p>Words go here, and many of them.</p><button>Go<p>More words go here, and many of them.</article>", "Words go here, and many of them.\nMore words go here, and many of them."),
        ("<article>x y z a b c.<template><div><p>no</div></template> And so on it goes.</article>", "x y z a b c. And so on it goes."),
        ("<article><div>aa bb cc dd.<object><p>no</div>ee ff gg hh.</article>", "aa bb cc dd.\nee ff gg hh."),
    ],
)
def test_tags_that_are_left_out(html, text):
    assert pages.main_text(html) == text


def test_cut_decides_where_names_dont():
    """A heading of two words between paragraphs stays, as the cut joins it to them; alone it would go."""
    long = "This is a sentence of some length that nobody would take for a menu entry at all, and then some. " "It has another sentence, which makes it as long as paragraphs are on most pages that people read."
    blocks = pages.read(f"<div><p>{long}</p><p>Two words</p><p>{long}</p></div><div><p><a href=x>Home</a></p><p><a href=y>More of it</a></p></div>")
    assert [pages.log_odds(b) > 0 for b in blocks] == [True, False, True, False, False]
    assert pages.label(blocks) == [True, True, True, False, False]


def test_block_classifier_is_learned(spark):
    text = "It was a long day in the harbour and the ships came in late with the grain."
    html = f"<nav><ul><li><a href=x>Home</a><li><a href=y>About us</a></ul></nav><article><p>{text}</p><p>{text} {text}</p></article>"
    rows = spark.createDataFrame([(i, "u", html, 5) for i in range(20)] + [(1, "u", html, 5), (99, None, None, 5)], "page_id long, url string, html string, text int")
    weights = pages.learn(rows)
    assert weights != pages.PLAIN and weights[1] > 0 > weights[3] and pages.learn(rows.where("html is null")) == pages.PLAIN
    got = pages.extract(rows, ["page_id", "url"]).collect()
    assert len(got) == 22 and sum(r["text"] == f"{text}\n{text} {text}" for r in got) == 21 and pages.extract(rows.limit(0), ["page_id"]).count() == 0


def test_cut_is_minimal(rng):
    """The cut that the flow finds costs no more than any labelling."""
    for _ in range(30):
        n = 6
        blocks = [pages.Block("w " * rng.randrange(1, 40) + "w.", rng.uniform(-6, 6), rng.randrange(2), 0) for _ in range(n)]

        def cost(labels, blocks=blocks, n=n):
            odds = [round(pages.SCALE * pages.log_odds(b)) for b in blocks]
            total, latest = sum(max(o, 0) if not x else max(-o, 0) for o, x in zip(odds, labels, strict=True)), {}
            for i, b in enumerate(blocks):
                if i and labels[i] != labels[i - 1]:
                    total += round(pages.SCALE * (pages.NEAR if blocks[i - 1].container == b.container else pages.FAR))
                before = latest.get(b.container)
                if before is not None and before < i - 1 and labels[i] != labels[before]:
                    total += round(pages.SCALE * pages.SAME)
                latest[b.container] = i
            return total

        assert cost(pages.label(blocks)) == min(cost([bool(m >> k & 1) for k in range(n)]) for m in range(1 << n))


# --- 4: near duplicates ---------------------------------------------------------------------


def brute(texts):
    sets = []
    for t in texts:
        w = WORD.findall((t or "").translate(LOWER))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set())
    name = list(range(len(texts)))

    def find(x):
        while name[x] != x:
            x = name[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                x, y = find(i), find(j)
                name[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in enumerate(sets)}


def edited(rng, text, k):
    w = text.split()
    for _ in range(k):
        w[rng.randrange(len(w))] = f"edit{rng.randrange(10**6)}"
    return " ".join(w)


def test_near_duplicates_match_brute_force(spark, rng):
    base = [sentence(rng, 120) for _ in range(6)]
    passage = sentence(rng, 60)
    texts = [edited(rng, b, rng.randrange(4)) for b in base for _ in range(12)] + [base[0].upper()] * 5 + [f"{passage} {sentence(rng, 40)}" for _ in range(30)]
    texts += [None, "", " ", "a b", "A  B", "a b c", "one", "one", base[0][: len(base[0]) // 2]] + [edited(rng, base[1], k) for k in range(8)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near.cluster(documents(spark, texts)).collect()}
    assert got == brute(texts)


def test_near_odd(odd, none):
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in near.cluster(odd).collect())
    assert got[(5, 977, 5)] == got[(6, 977, 5)] == 1 and got[(1, 0, 1)] == got[(3, 0, 3)] == 1 and got[(8, 1, 8)] == 2 and got[(None, 1, None)] == 1
    assert near.cluster(none).count() == 0
    kept = near.deduplicate(odd)
    assert kept.columns == odd.columns and sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 7, 8]


def test_near_template(spark, rng):
    """Documents that share a template and aren't similar, among near copies of it."""
    template = sentence(rng, 104)
    texts = [f"{template} {sentence(rng, 14)}" for _ in range(150)] + [edited(rng, template, k % 3) for k in range(12)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near.cluster(documents(spark, texts)).collect()}
    assert got == brute(texts)


def test_near_large_group(spark, rng):
    """5,000 different near copies of one text, and as many texts that share a passage only."""
    base, passage = sentence(rng, 80), sentence(rng, 30)
    texts = [base] + [edited(rng, base, 1) for _ in range(4999)] + [f"{sentence(rng, 25)} {passage} {sentence(rng, 25)}" for _ in range(1000)]
    got = {r["doc_id"]: r["component_id"] for r in near.cluster(documents(spark, texts)).collect()}
    assert all(got[i] == 0 for i in range(5000)) and all(got[i] == i for i in range(5000, 6000))


def test_near_chain_and_groups(spark, rng):
    """A chain of texts each similar to the next only, and groups of several members: same prefix and size."""
    words = [f"{i}q" for i in range(400)]
    chain = [" ".join(words[6 * i : 6 * i + 100]) for i in range(40)]
    texts = chain[::-1] + [edited(rng, chain[20], 2) for _ in range(150)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near.cluster(documents(spark, texts)).collect()}
    assert got == brute(texts)


def test_near_counts_in_a_tree_and_hubs_in_parts(spark, rng, monkeypatch):
    """Sums of two tasks each, and hubs whose pairs fall in many parts, give the same components."""
    monkeypatch.setattr(near, "RACK", 2)
    monkeypatch.setattr(near, "PART_PAIRS", 3)
    base = sentence(rng, 60)
    texts = [edited(rng, base, rng.randrange(3)) for _ in range(40)] + [sentence(rng, 30) for _ in range(20)] + [None, "", "a b"]
    docs = documents(spark, texts).repartition(7)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near.cluster(docs).collect()}
    assert got == brute(texts)


def test_near_sketches_never_lose_a_pair(rng):
    for _ in range(200):
        a = np.unique(np.array([rng.randrange(2**64) for _ in range(rng.randrange(1, 400))], np.uint64))
        b = np.unique(np.append(a[rng.randrange(20) :], np.array([rng.randrange(2**64) for _ in range(rng.randrange(20))], np.uint64)))
        differing = int(np.bitwise_count(near.sketch(a).view(np.uint64) ^ near.sketch(b).view(np.uint64)).sum())
        assert differing <= len(np.setxor1d(a, b))


def test_near_clashing_columns(spark, rng):
    names = ["node", "grp", "comp", "list", "text_hash", "_k"]
    docs = documents(spark, [sentence(rng, 20), sentence(rng, 20)] * 2).select("*", *[F.lit("x").alias(n) for n in names])
    assert sorted(r["component_id"] for r in near.cluster(docs).collect()) == [0, 0, 1, 1]
    kept = near.deduplicate(docs.drop("_k"))
    assert kept.columns == docs.columns[:-1] and sorted(r["doc_id"] for r in kept.collect()) == [0, 1]


# --- 5, 7, 9: learned scores ----------------------------------------------------------------


def test_held_out_is_the_checksum(spark):
    rows = spark.range(50).select("id", common.held_out(F.col("id"), 3, 1).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 3 == 1) for r in rows)


def test_language(spark, odd, none):
    english, german = "the and of with this that from have".split(), "der und die mit nicht eine sich auch".split()
    r = np.random.default_rng(1)
    texts = [" ".join(r.choice(english if i % 2 else german, 30)) for i in range(200)]
    docs = spark.createDataFrame([(i, t, "en" if i % 2 else "de") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    model = language.learn(docs)
    out = language.predict(docs.where(common.held_out(F.col("doc_id"), 3, 1)), model, ["doc_id", "lang"])
    assert out.where("lang = lang_pred").count() >= 0.95 * out.count()
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.predict(odd, model, odd.columns).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0) and 0 < got[4][1] <= 1
    assert language.predict(none, model, ["doc_id"]).count() == 0 and language.learn(none) is None
    assert {r["lang_pred"] for r in language.predict(odd, None, ["doc_id"]).collect()} == {"und"}


def test_language_network_matches_a_naive_one(rng):
    """The pooled answers, and the direction of the training's steps, against loops over places and filters."""
    rows = [(sentence(rng, 60), "en") for _ in range(20)] + [(sentence(rng, 60).replace("a", "ä"), "de") for _ in range(20)]
    m = language.fit(rows, most_windows=30)  # fewer than there are
    x, _, _ = language.windows(*common.bytes_of(pa.array([t for t, _ in rows[::7]])))
    h, _ = language.pooled(m, x)
    slow = np.full(h.shape, -np.inf)
    for i, window in enumerate(x):
        e = m.embed[window]
        for j, (w, k, b) in enumerate(zip(language.WIDTHS, m.filters, m.bias, strict=True)):
            for place in range(language.WINDOW - max(language.WIDTHS) + 1):
                answer = e[place : place + w].ravel() @ k + b
                mine = slice(j * language.FILTERS, (j + 1) * language.FILTERS)
                slow[i, mine] = np.maximum(slow[i, mine], answer)
    assert np.allclose(h, slow, atol=1e-4)


def test_attention_matches_a_naive_one(rng):
    rows = [(sentence(rng, rng.randrange(1, 200)), i % 2) for i in range(30)]
    m = quality.fit(rows)
    x, n = quality.passages(*common.bytes_of(pa.array([t for t, _ in rows])))
    *_, alpha, _, p = quality.forward(m, x, n)
    w1, b1, v, u, a, w2, b2 = m.weights
    at = 0
    for i, k in enumerate(n):
        h = [np.tanh((row - m.mean) / m.spread @ w1 + b1) for row in x[at : at + k]]
        pull = np.array([np.exp((np.tanh(y @ v) / (1 + np.exp(-(y @ u)))) @ a) for y in h])
        pull /= pull.sum()
        z = sum(g * y for g, y in zip(pull, h, strict=True))
        assert np.allclose(pull, alpha[at : at + k]) and np.isclose(p[i], 1 / (1 + np.exp(-(z @ w2 + b2[0]))))
        at += k


def test_segments_are_maximal(rng):
    def slow(scores):
        """Ruzzo and Tompa's definition: the best segment, then those left and right of it."""
        best = max(((sum(scores[i:j]), i - j, i, j) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)), default=(0, 0, 0, 0), key=lambda x: (x[0], x[1]))
        if best[0] <= 1e-9:
            return []
        _, _, i, j = best
        return slow(scores[:i]) + [(i, j - 1)] + [(a + j, b + j) for a, b in slow(scores[j:])]

    for _ in range(200):
        hits = sorted(rng.sample(range(14), 5))
        values = [rng.uniform(-2, 3) for _ in hits]
        scores = [-0.3] * 14
        for h, v in zip(hits, values, strict=True):
            scores[h] += v
        assert [(a, b) for a, b, _ in toxicity.segments(hits, values, 0.3)] == slow(scores)


def test_segments_are_linear(rng):
    start = time.time()
    n = 100_000
    assert len(toxicity.segments(list(range(0, 40 * n, 40)), [2.0] * n, 0.35)) == n  # sums fall all the time
    toxicity.segments(sorted(rng.sample(range(10 * n), n)), [rng.uniform(-3, 6) for _ in range(n)], 0.35)
    assert time.time() - start < 5


def test_toxicity(spark, rng, odd, none):
    texts = [sentence(rng, 40) if i % 4 else sentence(rng, 20) + " you moron and idiot " + sentence(rng, 20) for i in range(400)]
    texts = [t if i % 4 == 0 else t + " you and" for i, t in enumerate(texts)]
    docs = documents(spark, texts)
    labels = docs.select("doc_id", (F.col("doc_id") % 4 == 0).cast("int").alias("toxic"))
    model = toxicity.learn(docs, labels)
    out = {r["doc_id"]: r for r in toxicity.score(docs, model, ["doc_id"]).collect()}
    assert all(out[i]["predicted"] == (i % 4 == 0) for i in out)
    span = out[0]["passages"][0]
    assert texts[0][span["start"] : span["end"]] == "moron and idiot"
    scores = [r["score"] for r in toxicity.score(odd, model, ["doc_id"]).collect()]
    assert len(scores) == 10 and all(0 <= s < 0.5 for s in scores)
    assert toxicity.score(none, model, ["doc_id"]).count() == 0
    assert {r["score"] for r in toxicity.score(odd, toxicity.learn(docs, labels.limit(0)), ["doc_id"]).collect()} == {0.0}


def test_quality(spark, rng, odd, none):
    texts = [sentence(rng, 90) if i % 3 else sentence(rng, 45).upper() + " !! $$ " + sentence(rng, 40) for i in range(240)]
    docs = documents(spark, texts)
    labels = docs.select("doc_id", (F.col("doc_id") % 3 != 0).cast("int").alias("quality"))
    model = quality.learn(docs, labels)
    out = {r["doc_id"]: r["predicted"] for r in quality.score(docs, model, ["doc_id"]).collect()}
    assert sum(out[i] == (i % 3 != 0) for i in out) >= 0.98 * len(out)
    scores = [r["score"] for r in quality.score(odd, model, ["doc_id"]).collect()]
    assert len(scores) == 10 and all(0 <= s <= 1 for s in scores)
    assert quality.score(none, model, ["doc_id"]).count() == 0


# --- 6: mixing ------------------------------------------------------------------------------


def test_mixing_takes_prefixes_by_hash(spark, rng):
    texts = [sentence(rng, rng.randrange(1, 60)) for _ in range(300)] + [None, ""]
    rows = [(i, t, [None, "a", "b", "c", "hot", "hot", "hot"][i % 7]) for i, t in enumerate(texts)]
    out = mixing.plan(spark.createDataFrame(rows, "doc_id long, text string, source string")).toPandas()
    size = {i: len(WORD.findall(t or "")) for i, t, _ in rows}
    total = {s: sum(size[i] for i, _, x in rows if x == s) for s in {r[2] for r in rows}}
    order = sorted((s for s in total if s), key=str) + [None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    capped: set = set()
    while True:
        rest, ws = 1.5 * sum(total.values()) - sum(2 * total[s] for s in capped), sum(weight[s] for s in order if s not in capped)
        more = {s for s in order if s not in capped and rest * weight[s] / ws > 2 * total[s]}
        if not more:
            break
        capped |= more
    for s in order:
        part = out[out["source"].isna()] if s is None else out[out["source"] == s]
        target = 2 * total[s] if s in capped else rest * weight[s] / ws
        assert math.isclose(part["target"].iloc[0], target) and abs(part["taken"].sum() - target) <= max(size.values())
        assert (part["taken"] <= 2 * part["size"]).all() and (part["size"] == part["doc_id"].map(size)).all()
    again = mixing.plan(spark.createDataFrame(rows[::-1], "doc_id long, text string, source string")).toPandas()
    assert dict(zip(again["doc_id"], again["taken"], strict=True)) == dict(zip(out["doc_id"], out["taken"], strict=True))


def test_mixing_clashing_columns(spark, rng):
    rows = [(i, sentence(rng, 9), "ab"[i % 2], 3) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, low int").select("*", *[F.lit(1).alias(c) for c in ("passes", "budget", "src", "_h", "_src", "size")])
    out = mixing.plan(docs).collect()
    assert {(r["low"], r["passes"], r["budget"], r["src"], r["size"]) for r in out} == {(3, 1, 1, 1, 9)}


def test_learned_scores_clashing_columns(spark, rng):
    docs = documents(spark, [sentence(rng, 60) for _ in range(60)]).select("*", *[F.lit(1).alias(c) for c in ("label", "_id", "_label", "_text", "toxic", "quality")])
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"), (F.col("doc_id") % 2).cast("int").alias("quality"), F.lit(1).alias("label"))
    assert toxicity.score(docs, toxicity.learn(docs, labels), docs.columns).count() == 60
    assert quality.score(docs, quality.learn(docs, labels), docs.columns).count() == 60
    assert language.predict(docs, language.learn(docs), docs.columns).count() == 60


def test_mixing_odd(odd, none):
    out = mixing.plan(odd).collect()
    assert len(out) == 10 and all(r["taken"] <= 2 * r["size"] for r in out)
    assert mixing.plan(none).count() == 0
    assert mixing.repeat(mixing.plan(odd), odd.columns).columns == odd.columns


# --- 8: neighbours --------------------------------------------------------------------------


@pytest.mark.parametrize("clustered", [True, False])
def test_neighbours_recall(spark, clustered):
    r = np.random.default_rng(3)
    x = r.normal(size=(3000, 24)) + (5 * r.normal(size=(20, 24))[r.integers(0, 20, 3000)] if clustered else 0)
    x[100:160] = x[100]  # ties
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(5000, None), (5050, [0.0] * 24), (5100, [float("nan")] * 24), (5150, [None] + [1.0] * 23), (None, [1.0] * 24), (5200, [1.0])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>")
    got = {}
    for row in neighbours.search(df, F.col("vec_id") % 50 == 0, 5).collect():
        got.setdefault(row["query_id"], {})[row["rank"]] = (row["vec_id"], row["score"])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = 0
    for q in range(0, 3000, 50):
        s = unit @ unit[q]
        s[q] = -2
        best = np.lexsort((np.arange(3000), -np.round(s, 12)))[:5]
        mine = [got[q][k][0] for k in range(1, 6)]
        hit += len(set(best.tolist()) & set(mine))
        assert all(math.isclose(got[q][k][1], s[got[q][k][0]], abs_tol=1e-12) for k in range(1, 6))
    assert set(got) == set(range(0, 3000, 50)) and hit >= 0.95 * 300
    assert [got[100][k][0] for k in range(1, 6)] == [101, 102, 103, 104, 105]


def test_neighbours_recall_ordered(spark):
    """Ids in order of clusters, of which the first is tight and the rest diffuse."""
    r = np.random.default_rng(5)
    x = np.concatenate([20 + 0.01 * r.normal(size=(400, 24)), r.normal(size=(2600, 24))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for row in neighbours.search(df, F.col("vec_id") % 20 == 0, 5).collect():
        got.setdefault(row["query_id"], set()).add(row["vec_id"])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = 0
    for q in range(400, 3000, 20):
        s = unit @ unit[q]
        s[q] = -2
        hit += len(set(np.argsort(-s)[:5].tolist()) & got[q])
    assert hit >= 0.9 * 5 * 130, hit


def test_neighbours_repeated_ids(spark):
    r = np.random.default_rng(9)
    rows = [(i % 60, v.tolist(), 1) for i, v in enumerate(np.tile(r.normal(size=(60, 8)), (3, 1)))]
    got = neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int"), F.col("vec_id") % 20 == 0, 5).collect()
    assert sorted(Counter(x["query_id"] for x in got).items()) == [(0, 5), (20, 5), (40, 5)] and all(x["vec_id"] != x["query_id"] for x in got)


def test_neighbours_few(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert [(r["rank"], r["vec_id"]) for r in neighbours.search(df, F.col("vec_id") == 0).orderBy("rank").collect()] == [(1, 1), (2, 2)]
    assert neighbours.search(df.limit(0), F.lit(True)).count() == 0


# --- 10: packing ----------------------------------------------------------------------------


def slow_best_fit(sizes, sources, clusters, capacity, per_source):
    bins, out = [], []
    for item in zip(sizes, sources, clusters, strict=True):
        fits = [(capacity - sum(x[0] for x in b), k) for k, b in enumerate(bins) if sum(x[0] for x in b) + item[0] <= capacity and sum(x[1] == item[1] for x in b) < per_source and all(x[2] != item[2] for x in b)]
        k = min(fits)[1] if fits else len(bins)
        if not fits:
            bins.append([])
        bins[k].append(item)
        out.append(k)
    return out


def test_best_fit_matches_brute_force(rng):
    for _ in range(20):
        items = sorted(((rng.randrange(1, 40), rng.randrange(3), rng.randrange(12)) for _ in range(80)), reverse=True)
        assert packing.best_fit(*zip(*items, strict=True), 50, 2) == slow_best_fit(*zip(*items, strict=True), 50, 2)


def test_packing(spark, odd, none, rng):
    texts = [sentence(rng, rng.randrange(1, 90)) for _ in range(200)] + ["copy of this text"] * 30 + [sentence(rng, 250)]
    docs = documents(spark, texts)
    out = packing.pack(docs, capacity=100, per_source=3, shard_rows=60).toPandas()
    words = {i: len(t.split()) for i, t in enumerate(texts)}
    assert out.groupby("doc_id")["n_words"].sum().to_dict() == words
    held = out.groupby("bin_id")["n_words"].sum()
    assert held.max() <= 100 and (out["bin_id"].map(held) == out["bin_words"]).all()
    copies = out[out["doc_id"].between(200, 229)]
    assert copies["bin_id"].is_unique
    assert out.assign(s=out["doc_id"] % 2).groupby(["bin_id", "s"]).size().max() <= 3
    rows = packing.pack(odd).toPandas()
    assert rows[rows["bin_id"].isna()]["doc_id"].tolist() and sorted(rows[rows["bin_id"].isna()]["doc_id"].tolist()) == [1, 2, 3]
    assert (rows["doc_id"] == 8).sum() == 2 and rows[rows["doc_id"] == 5]["n_words"].sum() == 20_000
    assert packing.pack(none).count() == 0
    same = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("one text of all").alias("text"), F.lit("a").alias("source"))
    many = packing.pack(same, shard_rows=100).select((F.col("bin_id") / 2**32).cast("int").alias("shard"), "bin_id").toPandas()
    assert len(many) == 3000 and many["bin_id"].is_unique and many.groupby("shard").size().max() < 200
