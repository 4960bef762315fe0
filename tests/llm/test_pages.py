"""Main text: names that inform, the cut where it decides, markup that never ends, odd rows."""

import time

import numpy as np
import pytest

from wayloom.llm import pages

PROBES = {
    '<article><section class="social-history"><p>Social history is a branch of history.</p></section></article>': "Social history is a branch of history.",
    '<article><p class="form">An article on water colour and its forms.</p></article>': "An article on water colour and its forms.",
    '<article><div class="search-results-explained"><p>Search results are explained here.</p></div></article>': "Search results are explained here.",
    '<article><p>First of all.</p><p id="comment-on-law">Commentary on the law of the land.</p></article>': "First of all.\nCommentary on the law of the land.",
    "<body><header><h1>Title of page</h1></header><div><p>Text of the page.</p></div></body>": "Text of the page.",
    '<body><div><p>An honest paragraph of some length stands here, and it goes on.</p><p>Another one follows it, as long as the first.</p></div><div>Copyright 2020</div><div><a href="x">Home</a> | <a href="y">About</a></div></body>': "An honest paragraph of some length stands here, and it goes on.\nAnother one follows it, as long as the first.",
    '<article><p>The text itself goes here.</p><div class="post-comments"><p>I liked it, says a reader.</p></div><div id="sidebar-left"><p>See these as well.</p></div><div class="siteFooter">All rights.</div></article>': "The text itself goes here.",
}


@pytest.mark.parametrize("html", PROBES)
def test_names_inform_and_do_not_rule(html):
    assert pages.main_text(html) == PROBES[html]


def test_the_cut_decides_where_a_block_alone_does_not():
    """A short line between long paragraphs of its container stays; the same line among links goes."""
    text = "<p>A paragraph that is long enough to be text by itself, as anyone can see.</p>"
    blocks = pages.read(f"<div>{text}<div>Two words</div>{text}</div><ul><li><a>one</a></li><li><a>two</a></li></ul>")
    inside = pages.read(f"<div>{text}<b>Two words</b><hr>{text}</div>")
    assert pages.log_odds(inside[1]) < 0 and pages.label(inside) == [True, True, True]
    assert pages.label(blocks)[-2:] == [False, False]
    lone = pages.read("<ul><li><a>one two</a></li><li>Read more.</li><li><a>three</a></li><li><a>four</a></li></ul>")
    assert pages.log_odds(lone[1]) > 0 and pages.label(lone) == [False] * 4


@pytest.mark.parametrize("bad", ["<!--x", "</x>", "<a ", "<![CDATA[", "<?", "<!x", "<p", "<div>", "<x>", "<b>", "<svg>", "<", "<a x='", "<p>", "<li>x"])
def test_a_megabyte_of_markup_that_never_ends(bad):
    start = time.time()
    assert pages.read("hello " + bad * (1_000_000 // len(bad)))[0].text.startswith("hello")
    assert time.time() - start < 20


def test_weights_stay_on_their_side():
    rng = np.random.default_rng(1)
    x = np.column_stack([np.ones(400), rng.random((400, 3)), rng.integers(0, 2, (400, 3)), rng.random(400)])
    y = (x[:, 2] < 0.5).astype(float)  # sentences are boilerplate here
    w = np.array(pages.fit(x, y))
    assert (w >= pages.LOW).all() and (w <= pages.HIGH).all() and w[2] == pages.LOW[2]
    assert pages.fit(x, np.ones(400)) == pages.PLAIN


def test_odd_pages(spark):
    long = "<article>" + "<p>A sentence of the article.</p>" * 20_000 + "</article>"
    rows = [(1, None, "a"), (2, "", "b"), (3, "<article><p>One &amp; two.</p></article>", "c"), (3, "<article><p>One &amp; two.</p></article>", "c"), (None, long, None)]
    table = spark.createDataFrame([(*r, 7, "x") for r in rows], "page_id long, html string, url string, n_chars int, text string")
    got = sorted((r.page_id or 0, r.text[:20], r.n_chars) for r in pages.extract(table, ["page_id", "url", "text"]).collect())
    assert got == [(0, "A sentence of the ar", 20_000 * 27 - 1 + 0), (1, "", 0), (2, "", 0), (3, "One & two.", 10), (3, "One & two.", 10)]
    assert pages.extract(table.limit(0), ["page_id"]).count() == 0
