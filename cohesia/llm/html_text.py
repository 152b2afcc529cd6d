"""Main text of web pages from text-to-tag ratios over streaming parser events.

The standard library's parser is read once per page. Its events are folded into
*lines*: the text of one block, with the number of tags and of link characters
seen in it and the element it stands in. Every line, whatever its element is
called, gets a text-to-tag ratio (characters outside links over tags); the ratios
are smoothed with a Gaussian kernel, and lines whose smoothed ratio reaches the
threshold (the standard deviation of the smoothed ratios, at most their mean) form
content clusters. Elements are then judged by the clusters: text whose own ratio reaches
the threshold counts for an element, text outside the clusters counts against it
(``LINK`` times where it is link text), and the element with the best balance is the content
region, the innermost on a tie. Where article or main elements hold most of the
content, only they compete. All lines of the region are kept, and headings that stand
directly before it and are no links, so short paragraphs stay.

Names only veto: lines of page furniture (navigation, headers, footers, sidebars,
notices, adverts, forms, scripts, styles, reader comments; by element, role, class
or id) are left out of what the ratios have selected. Of a region that is the
whole body, lines before the first cluster and after the last one stay only if they are
paragraphs or headings and no links.

Character references are decoded, white space inside a block becomes one space,
blocks are joined by two line feeds in page order. A line break element counts as
white space. Null or empty pages, and pages without text, give an empty string.
Unclosed elements end with their parent. Repeated rows give repeated rows. Pages
may be nested to any depth and of any length: time and memory grow with the page.
Columns other than ``page_id``, ``url`` and ``html`` are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
from pyspark.sql import DataFrame

from cohesia.llm.batches import map_batches

SIGMA = 1.0
RADIUS = 2
#: How much a character of link text outside the clusters weighs against an element.
LINK = 4

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header "
    "hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
_FURNITURE = frozenset(
    "nav header footer aside form script style noscript template head title menu iframe object embed svg math canvas audio video select option button textarea "
    "input label fieldset dialog".split()
)
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Words of class and id values that mark furniture.
_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising advertorial adsense banner banners sponsor sponsored promo promos promotion promoted cookie cookies consent "
    "gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login paywall nav navbar navigation menu menus breadcrumb breadcrumbs "
    "pagination pager sidebar sidebars aside footer footnav header masthead topbar toolbar comment comments commentlist disqus replies respond reviews related "
    "recommended recommendations share sharing social widget widgets skip copyright legal disclaimer outbrain taboola".split()
)
#: With one of these beside it, the word "header" names the head of the article itself.
_OWN = frozenset("article post entry story content".split())
_REGION = frozenset(("article", "main"))
#: Of an article element outside all others, only these words make furniture.
_READERS = frozenset("comment comments commentlist disqus replies respond".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_PROSE = _HEADINGS | {"p", "blockquote", "pre"}
#: Elements that may be the region.
_CONTAINER = frozenset("article main section div body td center blockquote".split())
_CELL_ENDS = frozenset(("td", "th", "tr", "tbody", "tfoot"))
#: Start tags that end an open element of these names (the element's closing tag may be left out).
_ENDS = {
    "p": frozenset(_BLOCK - {"option", "optgroup", "caption", "legend", "head", "title", "html", "body"}),
    "li": frozenset(("li",)),
    "dt": frozenset(("dt", "dd")),
    "dd": frozenset(("dt", "dd")),
    "td": _CELL_ENDS,
    "th": _CELL_ENDS,
    "tr": frozenset(("tr", "tbody", "tfoot")),
    "option": frozenset(("option", "optgroup")),
    "head": frozenset(("body",)),
}
_NOTHING: frozenset[str] = frozenset()
_HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")
_SPLIT = re.compile(r"[^a-z0-9]+")
_SPACE = re.compile(r"\s+")


@dataclass(slots=True)
class Node:
    tag: str
    number: int  # in order of start tags, so the elements inside one have the numbers after it
    up: int  # the number of the element around it, -1 for the page
    furniture: bool
    region: bool  # inside an article or main, or one itself


@dataclass(slots=True)
class Line:
    text: str
    tags: int
    links: int
    node: Node


class Lines(HTMLParser):
    """Folds parser events into lines."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.nodes = [Node("", 0, -1, False, False)]
        self.stack = self.nodes[:]
        self.open: Counter[str] = Counter()
        self.text: list[str] = []
        self.tags = self.links = 0

    def flush(self) -> None:
        text = _SPACE.sub(" ", "".join(self.text)).strip()
        if text:
            self.lines.append(Line(text, self.tags, self.links, self.stack[-1]))
        self.text = []
        self.tags = self.links = 0

    def _pop(self) -> None:
        self.open[self.stack.pop().tag] -= 1

    def _end_by(self, tag: str) -> None:
        while len(self.stack) > 1 and tag in _ENDS.get(self.stack[-1].tag, _NOTHING):
            self._pop()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in _BLOCK:
            self.flush()
        self.tags += 1
        self._end_by(tag)
        if tag == "br":
            self.text.append(" ")
        if tag == "body":  # whatever was open in the head ends
            while len(self.stack) > (2 if len(self.stack) > 1 and self.stack[1].tag == "html" else 1):
                self._pop()
        if tag in _VOID:
            return
        if tag in _BLOCK:
            # an inline element left open does not reach into the next block
            while len(self.stack) > 1 and self.stack[-1].tag not in _BLOCK and not self.stack[-1].furniture:
                self._pop()
            self._end_by(tag)
        up = self.stack[-1]
        node = Node(tag, len(self.nodes), up.number, up.furniture or _is_furniture(tag, dict(attrs), up), up.region or tag in _REGION)
        self.nodes.append(node)
        self.stack.append(node)
        self.open[tag] += 1

    def handle_endtag(self, tag: str) -> None:
        if tag == "br":
            self.text.append(" ")
        elif tag in _BLOCK:
            self.flush()
        self.tags += 1
        if not self.open[tag]:
            return
        if tag not in _BLOCK:  # an inline end tag does not close a block
            for node in reversed(self.stack):
                if node.tag == tag:
                    break
                if node.tag in _BLOCK:
                    return
        while self.stack[-1].tag != tag:
            self._pop()
        self._pop()

    def handle_data(self, data: str) -> None:
        if self.stack[-1].tag in ("script", "style"):
            return
        if self.text or not data.isspace():
            if self.open["a"]:
                self.links += len(data.strip())
            self.text.append(data)

    def finish(self) -> list[Line]:
        self.close()
        self.flush()
        return self.lines


def _is_furniture(tag: str, attrs: dict[str, str | None], up: Node) -> bool:
    """Whether an element starts page furniture by its own name, role, class or id."""
    if tag == "header" and up.region:  # an article's own heading
        return False
    if tag in _FURNITURE or "hidden" in attrs or attrs.get("aria-hidden") == "true" or (attrs.get("role") or "").lower() in _ROLES:
        return True
    marks = f"{attrs.get('class') or ''} {attrs.get('id') or ''}"
    if tag in ("html", "body", "main") or marks.isspace():
        return False
    words = set(_SPLIT.split(_HUMP.sub(" ", marks).lower()))
    if tag == "article" and not up.region:
        return not words.isdisjoint(_READERS)
    found = words & _WORDS
    return found != {"header"} and bool(found) or bool(found) and not up.region and words.isdisjoint(_OWN)


def ratios(lines: list[Line]) -> np.ndarray:
    """Characters outside links over tags, line by line."""
    return np.array([max(0, len(x.text) - x.links) / max(1, x.tags) for x in lines])


def smooth(values: np.ndarray) -> np.ndarray:
    """Gaussian smoothing with renormalised weights at the ends."""
    kernel = np.exp(-0.5 * (np.arange(-RADIUS, RADIUS + 1) / SIGMA) ** 2)
    weight = np.convolve(np.ones(len(values)), kernel)[RADIUS:-RADIUS]
    return np.convolve(values, kernel)[RADIUS:-RADIUS] / weight


def clusters(ratio: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which lines are in content clusters, and which of them reach the threshold by their own ratio."""
    smoothed = smooth(ratio)
    limit = min(smoothed.std(), smoothed.mean())
    inside = smoothed >= limit
    return inside, inside & (ratio >= limit)


def _region(lines: list[Line], nodes: list[Node], inside: np.ndarray, own: np.ndarray) -> tuple[int, int]:
    """First and last number of the elements of the content region."""
    balance, content = np.zeros(len(nodes)), np.zeros(len(nodes))
    for x, near, full in zip(lines, inside.tolist(), own.tolist(), strict=True):
        if full and not x.node.furniture:
            balance[x.node.number] += len(x.text)
            content[x.node.number] += len(x.text)
        elif not near:
            balance[x.node.number] -= len(x.text) + (LINK - 1) * min(x.links, len(x.text))
    end = np.arange(len(nodes))
    for node in reversed(nodes[1:]):
        balance[node.up] += balance[node.number]
        content[node.up] += content[node.number]
        end[node.up] = max(end[node.up], end[node.number])
    heads = [n.number for n in nodes if n.tag in _REGION and not n.furniture]
    inmost = [n for n in heads if not nodes[nodes[n].up].region]
    if 2 * content[inmost].sum() > content[0]:
        allowed = heads
    else:
        allowed = [0, *(n.number for n in nodes if n.tag in _CONTAINER and not n.furniture)]
    best = max(allowed, key=lambda n: (balance[n], n))
    return best, int(end[best])


def _is_prose(node: Node, nodes: list[Node]) -> bool:
    while node.tag not in _BLOCK and node.up >= 0:
        node = nodes[node.up]
    return node.tag in _PROSE


def main_text(html: str | None) -> str:
    if not html:
        return ""
    parser = Lines()
    parser.feed(html)
    lines = parser.finish()
    if all(x.node.furniture for x in lines):
        return ""
    ratio = ratios(lines)
    inside, own = clusters(ratio)
    first, last = _region(lines, parser.nodes, inside, own)
    kept = np.array([first <= x.node.number <= last for x in lines])
    if parser.nodes[first].tag in ("", "html", "body"):  # beside the clusters may stand what surrounds them
        at = np.flatnonzero(inside & kept & np.array([not x.node.furniture for x in lines]))
        if len(at):
            for k in (*range(at[0]), *range(at[-1] + 1, len(lines))):
                kept[k] &= ratio[k] > 0 and _is_prose(lines[k].node, parser.nodes)
    # headings directly before the region
    k = int(kept.argmax()) - 1
    while k >= 0 and ratio[k] > 0 and lines[k].node.tag in _HEADINGS and not lines[k].node.furniture:
        kept[k] = True
        k -= 1
    return "\n\n".join(x.text for x, k in zip(lines, kept.tolist(), strict=True) if k and not x.node.furniture)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every whole page."""

    def make():
        def step(batch):
            texts = [main_text(h) for h in batch.column("html").to_pylist()]
            return {"page_id": batch.column("page_id"), "url": batch.column("url"), "text": texts, "n_chars": [len(t) for t in texts]}

        return step

    return map_batches(pages.select("page_id", "url", "html"), make, "page_id long, url string, text string, n_chars long")
