"""Main text of HTML pages by smoothed text-to-tag ratios.

The standard library's parser streams a page's events.  Block elements cut it
into lines; each line has its text, the number of tags met in it and the
characters inside links.  Lines belong to regions: the nearest element that holds
blocks (article, section, division, footer, form, ...), nested ones as well.  A
line's ratio is its text outside links by its tags, smoothed with a Gaussian over the
neighbouring lines of its region.  A line is a point of two features, the logarithm
of its smoothed ratio and the root of the sum of the ratios in its region; a threshold
in this plane, the border of two clusters, parts content from the rest.  A region is content
where a line of it is; all its lines make the text, short ones as well, save
paragraphs and lists whose own ratio says that they are but links.

Elements that are usually no article (navigation, forms, asides, page headers and
footers), classes, ids or roles that say so (adverts, notices, menus, comments, ...)
and a place outside the page's article weigh: they lower a line's ratio, and decide
nothing alone.  An article or main element ends the weights of what is open around
it, as of a navigation element that is never closed.  Only scripts, styles and the
like are never text.

Defined results: a null or empty page has the empty text; a page without an
element is one line; text after the last complete tag counts, a tag cut off at
the end does not.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from html.parser import HTMLParser
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skycap.llm import common as C

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike "
                   "strong sub sup time tt u var label wbr img".split())
#: Never text.
HIDDEN = frozenset("script style noscript template head iframe object svg math canvas audio video".split())
#: Usually not part of an article.
ASIDE = frozenset("nav aside footer form button select textarea menu dialog fieldset".split())
#: Lists and paragraphs: left out of their region where they are but links.
BLOCKS = frozenset("p ul ol dl table".split())
#: Blocks that are no region of their own; any other block is one.
LEAVES = BLOCKS | frozenset("li dt dd h1 h2 h3 h4 h5 h6 hgroup pre blockquote figure figcaption caption thead tbody tfoot tr th "
                            "address details summary center html".split())
#: Words of class, id or role that mark what is usually no article.
MARKS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar menu nav navbar "
                  "navigation breadcrumb breadcrumbs footer masthead comment comments disqus replies cookie cookies consent gdpr "
                  "notice notices alert popup modal overlay newsletter subscribe signup login share sharing social related "
                  "recommended widget toolbar pagination pager search complementary contentinfo".split())
_WORDS = re.compile(r"[A-Za-z]+")
_CUT_TAG = re.compile(r"<[A-Za-z/!?][^<>]*\Z")
SIGMA = 1.0
#: Least text outside links by tags of a paragraph or list.
LEAST_RATIO = 0.75
#: Weights of the ratio: usual elements and marked ones that are no article, lines outside the page's article.
ASIDE_WEIGHT = 0.05
MARK_WEIGHT = 0.25
OUTSIDE_WEIGHT = 0.2


class Line:
    __slots__ = ("parts", "tags", "links", "state")

    def __init__(self, state):
        self.parts: list[str] = []
        self.tags = self.links = 0
        self.state: State = state


class State(NamedTuple):
    """What is open at some place of the page."""

    region: int = 0
    block: int = 0
    inside: bool = False  # an article
    weight: float = 1.0
    hidden: bool = False


class PageParser(HTMLParser):
    """Lines of one page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, State]] = []  # tag, state around it
        self.blocks: Counter[str] = Counter()  # open ones
        self.inlines: list[Counter[str]] = [Counter()]  # open ones of each open block
        self.state = State()
        self.regions = 0
        self.link = 0
        self.lines = [Line(self.state)]

    def _cut(self) -> None:
        line = self.lines[-1]
        if line.parts:
            self.lines.append(Line(self.state))
        else:
            line.state = self.state

    def handle_starttag(self, tag, attrs):
        self.lines[-1].tags += 1
        if tag in VOID:
            if tag not in INLINE:
                self._cut()
            return
        region, block, inside, weight, hidden = self.state
        self.stack.append((tag, self.state))
        if tag in INLINE:
            self.link += tag == "a"
            self.inlines[-1][tag] += 1
            return
        self.blocks[tag] += 1
        self.inlines.append(Counter())
        if tag in ("article", "main"):
            weight = weight if inside else 1.0
            inside = True
        hidden = hidden or tag in HIDDEN
        light = 1.0
        if tag in ASIDE or (tag == "header" and not inside):
            light = ASIDE_WEIGHT
        elif tag not in ("html", "body", "article", "main") and attrs:
            for name, value in attrs:
                if value and name in ("class", "id", "role") and not MARKS.isdisjoint(_WORDS.findall(value.lower())):
                    light = MARK_WEIGHT
        if light < 1 or (tag not in LEAVES and tag != "header"):
            self.regions += 1
            region = block = self.regions
            weight *= light
        elif tag in BLOCKS:
            self.regions += 1
            block = self.regions
        self.state = State(region, block, inside, weight, hidden)
        self._cut()

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self.lines[-1].tags += 1
        inline = tag in INLINE
        if (self.inlines[-1] if inline else self.blocks)[tag]:  # an inline element does not close a block around it
            while True:
                name, around = self.stack.pop()
                if name in INLINE:
                    self.link -= name == "a"
                    self.inlines[-1][name] -= 1
                else:
                    self.blocks[name] -= 1
                    self.inlines.pop()
                    self.state = around
                if name == tag:
                    break
        if not inline:
            self._cut()

    def handle_data(self, data):
        if self.state.hidden:
            return
        line = self.lines[-1]
        line.parts.append(data)
        if self.link:
            line.links += len(data.strip())


def smoothed(values: list[float], sigma: float = SIGMA) -> list[float]:
    """Gaussian mean over neighbouring lines, weights renormed at the ends."""
    reach = math.ceil(2 * sigma)
    kernel = [math.exp(-d * d / (2 * sigma * sigma)) for d in range(-reach, reach + 1)]
    out = []
    for i in range(len(values)):
        lo, hi = max(0, i - reach), min(len(values), i + reach + 1)
        weights = kernel[lo - i + reach:hi - i + reach]
        out.append(sum(w * v for w, v in zip(weights, values[lo:hi])) / sum(weights))
    return out


def ratio(text: int, tags: int, links: int) -> float:
    """Characters of text outside links by tags."""
    return max(0, text - links) / max(1, tags)


def upper_cluster(points: list[tuple[float, float]]) -> list[bool]:
    """Whether each point is nearer the upper centre of two (two-means, first centres: the points of least and
    greatest sum).  All are where there are no two clusters."""
    low, high = min(points, key=sum), max(points, key=sum)
    upper = [True] * len(points)
    if low == high:
        return upper
    for _ in range(50):
        new = [math.dist(p, high) <= math.dist(p, low) for p in points]
        if new == upper or all(new) or not any(new):
            break
        upper = new
        low, high = (tuple(sum(x) / len(x) for x in zip(*[p for p, u in zip(points, upper) if u == side])) for side in (False, True))
    return upper


def _select(lines: list[tuple[str, Line]]) -> str:
    weighed = any(line.state.weight == 1 for _, line in lines)
    article = any(line.state.inside for _, line in lines)
    members: dict[int, list[int]] = {}
    blocks: dict[int, list[int]] = {}  # text, tags, link characters
    for i, (text, line) in enumerate(lines):
        members.setdefault(line.state.region, []).append(i)
        sums = blocks.setdefault(line.state.block, [0, 0, 0])
        for k, x in enumerate((len(text), line.tags, line.links)):
            sums[k] += x
    points = [(0.0, 0.0)] * len(lines)
    mass = {}
    for region, at in members.items():
        state = lines[at[0]][1].state
        weight = (state.weight if weighed else 1.0) * (OUTSIDE_WEIGHT if article and not state.inside else 1.0)
        ratios = [weight * r for r in smoothed([ratio(len(lines[i][0]), lines[i][1].tags, lines[i][1].links) for i in at])]
        mass[region] = sum(ratios)
        for i, r in zip(at, ratios):
            points[i] = math.log1p(r), math.sqrt(mass[region])
    content = {lines[i][1].state.region for i, upper in enumerate(upper_cluster(points)) if upper}
    mine = [(text, line.state.block) for text, line in lines if line.state.region in content]
    return " ".join([text for text, block in mine if not blocks[block][2] or ratio(*blocks[block]) >= LEAST_RATIO] or [text for text, _ in mine])


def page_text(html: str | None) -> str:
    """Main text of one page."""
    if not html:
        return ""
    parser = PageParser()
    parser.feed(_CUT_TAG.sub("", html))
    parser.close()
    lines = [(text, line) for line in parser.lines if (text := " ".join("".join(line.parts).split()))]
    return _select(lines) if lines else ""


def extract_text(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages without the html column, with text (a column of that name is replaced)."""
    C.prepare(pages.sparkSession)
    rest = [c for c in pages.columns if c not in (html, "text")]
    rows = pages.select(*[F.col(f"`{c}`") for c in rest], F.col(f"`{html}`").cast("string").alias("__html"))

    def run(batches):
        for b in batches:
            texts = [page_text(h) for h in b.column("__html").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string())], [*b.schema.names[:-1], "text"])

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{schema}text string")
