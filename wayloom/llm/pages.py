"""Main text of web pages by minimum-cut labelling.

A page is read into blocks of text. What stands above a block (elements, and names in class, id and role) gives log-odds
of content against boilerplate, and a linear classifier over the block itself (length, links, last character, kind of
element, place in the page) adds its own. Names inform and don't rule: a name counts by its last word (`site-footer`,
`sidebar-left`, but not `social-history`), and words that articles use as well count less, least on a paragraph. The
classifier is learned from the pages: blocks deep inside an article or a main element are its examples of content, blocks
in menus, footers and the like those of boilerplate; its weights stay on the side that common sense gives them (long
blocks, sentences: content; links: not). The sum becomes the capacities of the block's edges to the two terminals.
Neighbouring blocks, and blocks next to each other in the same container, are joined by smoothness edges, the stronger
the closer they are in the document tree. The maximum flow between the terminals then cuts the page into content and
boilerplate at the least cost, so that a heading between paragraphs stays, and so does a menu's one long line not.
Character references are decoded, white space within a block becomes one space, and the content blocks are joined by
line feeds.

Defined results: null and empty html, and pages without content, give an empty text. Unclosed and stray tags are
tolerated as browsers do: head and body tags may be left out, and an unclosed drawing, button or list of choices ends at
the next block, any other silent element at the end of one that it stands in. A comment or tag that never ends takes
the rest of the page with it. Pages are read in linear time. Without examples of both kinds the
classifier is PLAIN. Rows stay as they are, repeated ones as well; extra columns pass through; columns named text and
n_chars are replaced.
"""

from __future__ import annotations

import re
from collections import deque
from dataclasses import dataclass, field
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

# Element names of HTML by their role, and words that pages use in class, id and role attributes.
SILENT = frozenset("head title script style noscript template iframe svg math canvas object select option textarea button audio video map datalist".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
HEAD = frozenset("title script style noscript template meta link base".split())
SHALLOW = frozenset("svg math button select option map datalist".split())  # what a block ends, if it isn't closed
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}}
HOLDS = frozenset("article main section div body html aside nav header footer form table ul ol dl blockquote td th fieldset figure".split())
BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 pre li dl hr".split())
ELEMENTS = {"article": 5.0, "main": 3.0, "nav": -9.0, "footer": -9.0, "aside": -9.0, "form": -9.0, "dialog": -9.0, "menu": -9.0, "header": -6.0, "address": -1.0}
GOOD = frozenset("article content story post entry main text body".split())
BAD = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored banner cookie cookies consent gdpr modal overlay newsletter subscribe signup login sharing sidebar aside widget nav navbar navigation "
    "menu breadcrumb breadcrumbs toolbar topbar pagination pager masthead footer copyright disclaimer comment comments commentlist replies respond disqus".split()
)
# words that articles are about as well
UNSURE = frozenset("promo promotion notice notices alert popup subscription share social related recommended recommendations trending popular side header legal reply discussion form search tags".split())
# last words of a name that say where or how, not what
PLACES = frozenset("left right top bottom wrapper wrap container inner outer block box list section area bar row column col link links item items button buttons slot unit group holder panel region text".split())
SCALE, NEAR, FAR, SAME = 100, 1.5, 0.19, 0.75  # smoothness of neighbours in a container, of others, of a container's next
MOST_PAGES, SURE, MOST_OWN = 500, 4.0, 3.0  # learned pages; log-odds from above of an example; most of a block's own
# constant, length, last character, links, paragraph, list item, heading, nearness to the page's ends; and their bounds
PLAIN = (-0.5, 2.5, 1.5, -3.0, 0.5, -0.5, 0.3, -0.5)
LOW = np.array([-9.0, 0.5, 0.5, -9.0, 0.0, -9.0, -9.0, -9.0])
HIGH = np.array([9.0, 9.0, 9.0, -0.5, 9.0, 0.0, 9.0, 0.0])
_SPACE = re.compile(r"\s+")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass
class Block:
    text: str
    prior: float  # from the elements above it
    container: int
    linked: int  # characters within links
    tag: str = ""
    place: float = 0.5  # in the page, from 0 to 1


@dataclass
class _Open:
    tag: str
    prior: float
    container: int
    in_article: bool


@dataclass
class Reader(HTMLParser):
    """Blocks of a page, in page order."""

    blocks: list[Block] = field(default_factory=list)

    def __post_init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack = [_Open("", 0.0, 0, False)]
        self.silent: list[str] = []
        self.links = self.containers = self.linked = 0
        self.buffer: list[str] = []
        self.within: dict[str, int] = {}  # elements opened inside the silent one
        self.open: dict[str, int] = {}  # how many elements of each name stand open

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.silent == ["head"] and tag not in HEAD or tag == "body" or self.silent and self.silent[-1] in SHALLOW and (tag in HOLDS or tag in BLOCKS):
            self.silent.clear()
            self.within.clear()
        if tag in SILENT:
            if not self.silent or tag == self.silent[-1] or self.silent[-1] == "head":
                self.silent.append(tag)
            return
        if self.silent:
            self.within[tag] = self.within.get(tag, 0) + (tag not in VOID)
            return
        if tag == "br":
            self.buffer.append(" ")
        if tag == "a":
            self.links += 1
        if tag in INLINE or tag in VOID and tag != "hr":
            return
        self.flush()
        if tag in VOID:
            return
        closes = CLOSES.get(tag, frozenset())
        if any(self.open.get(x) for x in closes) or tag in HOLDS and self.open.get("p"):
            for above in range(len(self.stack) - 1, 0, -1):  # elements whose end tags may be left out
                name = self.stack[above].tag
                if name in closes or name == "p" and tag in HOLDS:
                    self._end(above)
                elif name in HOLDS:
                    break
        top = self.stack[-1]
        prior, article = ELEMENTS.get(tag, 0.0), top.in_article or tag == "article"
        if tag == "header" and top.in_article:
            prior = 0.0  # the article's own heading
        if tag not in ("html", "body", "article"):
            prior += named(tag, [value for key, value in attrs if key in ("class", "id", "role", "itemprop") and value])
        if tag in HOLDS:
            self.containers += 1
        self.open[tag] = self.open.get(tag, 0) + 1
        self.stack.append(_Open(tag, top.prior + prior, self.containers if tag in HOLDS else top.container, article))

    def handle_endtag(self, tag: str) -> None:
        if self.silent:
            if tag in self.silent:
                del self.silent[len(self.silent) - 1 - self.silent[::-1].index(tag) :]
                self.within.clear()
                return
            if self.within.get(tag) or not self.open.get(tag):
                self.within[tag] = max(self.within.get(tag, 0) - 1, 0)
                return
            self.silent.clear()
            self.within.clear()
        if tag == "a":
            self.links = max(self.links - 1, 0)
        if tag in INLINE or tag in SILENT:
            return
        self.flush()
        if self.open.get(tag):
            self._end(next(i for i in range(len(self.stack) - 1, 0, -1) if self.stack[i].tag == tag))
            self.links = 0 if tag in HOLDS else self.links

    def _end(self, above: int) -> None:
        for x in self.stack[above:]:
            self.open[x.tag] -= 1
        del self.stack[above:]

    def handle_data(self, data: str) -> None:
        if self.silent == ["head"] and not data.isspace():
            self.silent.clear()
        if not self.silent:
            self.buffer.append(data)
            if self.links:
                self.linked += len(data)

    def flush(self) -> None:
        text = _SPACE.sub(" ", "".join(self.buffer)).strip()
        if text:
            top = self.stack[-1]
            self.blocks.append(Block(text, top.prior, top.container, self.linked, top.tag))
        self.buffer.clear()
        self.linked = 0


def named(tag: str, values: list[str]) -> float:
    """What an element's names say of its content: by the last word of each that says what it is."""
    kinds = set()
    for name in " ".join(values).split():
        words = [w.lower() for w in _WORDS.findall(name)]
        while len(words) > 1 and words[-1] in PLACES:
            words.pop()
        kinds.update(words[-1:])
    if kinds & BAD:
        return -9.0
    if kinds & UNSURE and not kinds & GOOD:
        return -9.0 if tag in HOLDS - {"section"} else -4.0
    return 2.0 if kinds & GOOD else 0.0


def features(block: Block) -> tuple[float, ...]:
    """A constant, the length, whether it ends as a sentence does, the share of links, whether it is a paragraph, a list
    item or a heading, and how near it is to an end of the page."""
    kinds = (block.tag == "p", block.tag in ("li", "dt", "dd"), block.tag in ("h1", "h2", "h3", "h4", "h5", "h6"))
    return 1.0, min(block.text.count(" ") + 1, 30) / 30, float(block.text[-1] in ".!?\"'”…»)"), min(block.linked / len(block.text), 1.0), *map(float, kinds), abs(2 * block.place - 1)


def log_odds(block: Block, weights: tuple[float, ...] = PLAIN) -> float:
    """How likely a block is content rather than boilerplate: from what stands above it, and from itself."""
    own = sum(w * x for w, x in zip(weights, features(block), strict=True))
    return max(block.prior, -12.0) + min(max(own, -MOST_OWN), MOST_OWN)


def fit(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Weights of a logistic function (both labels weigh alike) near PLAIN and within bounds, by Newton steps that are
    clipped to them; PLAIN without both labels."""
    if len(set(y.tolist())) < 2:
        return PLAIN
    weight, plain = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())), np.array(PLAIN)
    w = plain.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (y - p)) - (w - plain)
        free = ~((w <= LOW) & (gradient < 0) | (w >= HIGH) & (gradient > 0))
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + np.eye(len(w))
        step = np.zeros(len(w))
        step[free] = np.linalg.solve(curve[np.ix_(free, free)], gradient[free])
        before, w = w, np.clip(w + step, LOW, HIGH)
        if np.abs(w - before).max() < 1e-8:
            break
    return tuple(w.tolist())


def learn(pages: DataFrame, html_col: str = "html", most: int = MOST_PAGES, most_bytes: int = common.MOST_BYTES) -> tuple[float, ...]:
    """The classifier's weights, from `most` pages at most, the first by a hash of the html as far as they hold
    `most_bytes` in all. Pages are chosen by hash and size, then read by all tasks."""
    n = len(PLAIN)
    fields = [f"f{i}" for i in range(n)] + ["y"]

    def run(batches):
        for batch in batches:
            for html in batch.column(0):
                told = [(*features(b), float(b.prior > 0)) for b in read(html.as_py()) if abs(b.prior) >= SURE]
                if told:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*told, strict=True)], names=fields)

    texts = pages.select(F.col(html_col).alias("html"), F.xxhash64(html_col).alias("h")).where("html is not null")
    first = texts.groupBy("h").agg(F.max(F.octet_length("html")).alias("size")).orderBy("h").limit(most)
    running = F.sum("size").over(Window.orderBy("h"))  # over `most` rows at most
    chosen = common.checkpoint(first.withColumn("held", running).where(F.col("held") <= most_bytes).select("h"))
    held = texts.join(F.broadcast(chosen), "h").groupBy("h").agg(F.min("html").alias("html")).repartition(pages.sparkSession.sparkContext.defaultParallelism).select("html")
    counted = held.mapInArrow(run, ", ".join(f"{f} double" for f in fields)).groupBy(*fields).count()
    rows = counted.select(*fields, "count").collect()  # the blocks of `most` pages
    told = np.array([tuple(r) for r in rows], float).reshape(len(rows), n + 2)
    told = told[np.lexsort(told.T)]
    return fit(np.repeat(told[:, :n], told[:, n + 1].astype(int), axis=0), np.repeat(told[:, n], told[:, n + 1].astype(int)))


class Flow:
    """Maximum flow by Dinic's method over integer capacities."""

    def __init__(self, n: int) -> None:
        self.edges: list[list[int]] = [[] for _ in range(n)]
        self.to: list[int] = []
        self.room: list[int] = []

    def join(self, a: int, b: int, forth: int, back: int = 0) -> None:
        for x, y, room in ((a, b, forth), (b, a, back)):
            self.edges[x].append(len(self.to))
            self.to.append(y)
            self.room.append(room)

    def levels(self, source: int) -> list[int]:
        level = [-1] * len(self.edges)
        level[source], queue = 0, deque([source])
        while queue:
            x = queue.popleft()
            for e in self.edges[x]:
                if self.room[e] > 0 and level[self.to[e]] < 0:
                    level[self.to[e]] = level[x] + 1
                    queue.append(self.to[e])
        return level

    def source_side(self, source: int, sink: int) -> list[bool]:
        """Saturate the network; the nodes still reached from the source."""
        while (level := self.levels(source))[sink] >= 0:
            turn, path, x = [0] * len(self.edges), [], source
            while True:
                if x == sink:
                    least = min(self.room[e] for e in path)
                    for e in path:
                        self.room[e] -= least
                        self.room[e ^ 1] += least
                    path, x = [], source
                    continue
                while turn[x] < len(self.edges[x]):
                    e = self.edges[x][turn[x]]
                    if self.room[e] > 0 and level[self.to[e]] == level[x] + 1:
                        break
                    turn[x] += 1
                if turn[x] < len(self.edges[x]):
                    path.append(e)
                    x = self.to[e]
                elif path:
                    x = self.to[path.pop() ^ 1]
                    turn[x] += 1
                else:
                    break
        return [v >= 0 for v in level]


def label(blocks: list[Block], weights: tuple[float, ...] = PLAIN) -> list[bool]:
    """Which blocks are content: those that the minimum cut leaves with the source."""
    n = len(blocks)
    flow, latest = Flow(n + 2), {}
    for i, block in enumerate(blocks):
        odds = round(SCALE * log_odds(block, weights))
        flow.join(n, i, max(odds, 0))
        flow.join(i, n + 1, max(-odds, 0))
        if i:
            near = NEAR if blocks[i - 1].container == block.container else FAR
            flow.join(i - 1, i, round(SCALE * near), round(SCALE * near))
        before = latest.get(block.container)
        if before is not None and before < i - 1:
            flow.join(before, i, round(SCALE * SAME), round(SCALE * SAME))
        latest[block.container] = i
    return flow.source_side(n, n + 1)[:n]


def read(html: str | None) -> list[Block]:
    """The blocks of a page. What never ends, a comment or a tag, is cut off first: the parser would look for its end
    again and again."""
    html = html or ""
    if (at := html.find("<!--", html.rfind("-->") + 1)) >= 0:
        html = html[:at]
    if found := re.compile("<[A-Za-z/!?]").search(html, html.rfind(">") + 1):
        html = html[: found.start()]
    reader = Reader()
    reader.feed(html)
    reader.close()
    reader.flush()
    n = len(reader.blocks)
    for i, block in enumerate(reader.blocks):
        block.place = (i + 0.5) / n
    return reader.blocks


def main_text(html: str | None, weights: tuple[float, ...] = PLAIN) -> str:
    blocks = read(html)
    return "\n".join(b.text for b, content in zip(blocks, label(blocks, weights), strict=True) if content)


def extract(pages: DataFrame, keep: list[str], html_col: str = "html") -> DataFrame:
    """The columns keep, text and n_chars (code points of text)."""
    weights = learn(pages, html_col)
    kept = pages.select(*[c for c in keep if c not in ("text", "n_chars")], F.col(html_col))
    schema = T.StructType([*kept.schema.fields[:-1], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    names = schema.names

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [main_text(x.as_py(), weights) for x in part.column(part.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=names)

    return kept.mapInArrow(run, schema)
