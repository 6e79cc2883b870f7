"""Main text of web pages by the ratio of text to tags along root-to-leaf tag paths.

Per page, text nodes are grouped by their tag path from the root.  A path's score is its text per
node, times its punctuation per node: article text comes in long, punctuated nodes of one
path.  Scores are smoothed over the page's order of nodes and fused with the unsmoothed ones, and a path whose mean
reaches the page's threshold is a content path.  From the smallest element around nearly all
content the main part it stands in is taken, or the article with its headline and the page's other articles, or else
the smallest section around all content; its blocks are returned but for those in elements that are marked as
something else (menus, notices, adverts, comments and so on).

A page is read once: paths are numbers, what an element inherits is written on it when it opens, and sums run once
from the leaves up, so the time grows with the page's length however deep its elements nest.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retail_spark.llm.common import safe_id, true_id

# HTML elements by their part in a page, and words that mark an element as not the article.
SILENT = frozenset("script style noscript template head title iframe object svg annotation annotation-xml canvas audio video select option textarea button datalist".split())
#: What may stand in a head; anything else ends it.
IN_HEAD = frozenset("base basefont bgsound head html link meta noscript script style template title".split())
NOT_ARTICLE = frozenset("nav footer aside menu dialog fieldset input".split())
BLOCKS = frozenset(
    "html body address article aside blockquote center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr li main menu nav ol p pre section summary table caption colgroup tbody thead tfoot tr td th ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner promo promotion sponsor sponsored cookie cookies consent gdpr notice notices "
    "alert newsletter subscribe subscription signup popup modal overlay sidebar sidebars side widget widgets related recommended recommendations "
    "share sharing social breadcrumb breadcrumbs menu menus nav navbar navigation header footer masthead comment comments reply replies respond "
    "disqus discussion toolbar pagination pager skip login search copyright legal disclaimer".split()
)
#: Inside an article these mark an element only where the rest of the name is one of PLACES: "social-bar", not "social-impact".
FAINT_MARKS = frozenset("alert discussion legal notice notices related respond search share sharing side skip social subscription".split())
PLACES = frozenset(
    "area bar block body bottom box button buttons column container float form fixed footer group header icon icons inline inner item items left link links list "
    "main media message nav outer page panel post posts right row section site text top widget wrap wrapper".split()
)
#: Of the marks, those that tell an article from the page's own.
ARTICLE_MARKS = frozenset("ad ads advert advertisement comment comments promo recommended related replies reply sponsored teaser".split())
#: Beside one of these, "header" names the article's own.
OWN_HEADER = frozenset("article content entry post story".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
#: An element that starts ends these where they are open.
ENDS = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "option": ("option",), "tbody": ("thead", "tbody"), "tfoot": ("thead", "tbody"),
}
SCOPES = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",)}
CLOSES_P = BLOCKS - {"html", "body", "caption", "colgroup", "tbody", "thead", "tfoot", "tr", "td", "th"}

_SPACE = re.compile(r"\s+")
_TOKENS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_PUNCTUATION = re.compile(r"[.,;:!?…。、，！？]")
SMOOTHING = np.exp(-0.5 * (np.arange(-3, 4) / 1.0) ** 2) / np.exp(-0.5 * (np.arange(-3, 4) / 1.0) ** 2).sum()
CONTENT_SHARE = 0.9
#: A mark is ignored on an element with half of the content and a headline, article or main part (an article itself: with most of it), or with such a part of a page that has none.
FORGIVEN_SHARE, FORGIVEN_HALF = 0.8, 0.5
#: Elements that may be the whole of an article.
SECTIONS = frozenset("html body main article section div".split())


class _Element:
    __slots__ = ("tag", "parent", "path", "depth", "out", "mark", "central", "content", "within", "links", "holder", "heads")

    def __init__(self, tag: str, parent: _Element | None, path: int, out: bool = False, marked: bool = False):
        self.tag, self.parent, self.path, self.out = tag, parent, path, out
        #: The nearest element that is marked by words, and whether this one holds a headline, article or main part.
        self.mark = self if marked else parent.mark if parent else None
        self.central = False
        self.depth = parent.depth + 1 if parent else 0
        self.content = 0
        #: Is it an article or main part or inside one, how many links is it in, its block, and the heading it is in.
        self.within = tag in ("article", "main") or bool(parent and parent.within)
        self.links = (tag == "a") + (parent.links if parent else 0)
        self.holder: _Element = self if tag in BLOCKS or not parent else parent.holder
        self.heads: str = tag if tag in HEADINGS else parent.heads if parent else ""


def _out(tag: str, attributes: dict[str, str | None], parent: _Element) -> bool:
    """Is an element, by its kind or role, something else than the article?"""
    if tag in NOT_ARTICLE or (attributes.get("role") or "").lower() in ROLES:
        return True
    if tag in ("header", "label") and not parent.within:
        return True
    if "hidden" in attributes or (attributes.get("aria-hidden") or "").lower() == "true":
        return True
    return bool(re.search(r"display\s*:\s*none", attributes.get("style") or "", re.I))


def _marked(tag: str, attributes: dict[str, str | None], parent: _Element) -> bool:
    """Do the words of an element's class or id say that it is something else than the article, or is it a form?"""
    if tag == "form":
        return True
    if tag in ("html", "body", "main"):
        return False
    names = f"{attributes.get('class') or ''} {attributes.get('id') or ''}".split()
    named = [{t.lower() for t in _TOKENS.findall(name)} for name in names]
    words = {w for name in named for w in name}
    if tag == "article":
        return any(name & ARTICLE_MARKS and name <= ARTICLE_MARKS | PLACES for name in named)
    marks = set(MARKS)
    if parent.within:
        marks -= FAINT_MARKS
        if any(name & FAINT_MARKS and name <= FAINT_MARKS | PLACES for name in named):
            return True
    if parent.within or tag in HEADINGS or words & OWN_HEADER:
        marks.discard("header")
    return not words.isdisjoint(marks)


class _Page(HTMLParser):
    """Text nodes with their elements, and blocks of them."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = _Element("", None, 0)
        #: All elements as they came, those that are open, and the places of the open ones by tag and of the open blocks.
        self.elements = [self.root]
        self.open = [self.root]
        self.places: dict[str, list[int]] = defaultdict(list)
        self.open_blocks: list[int] = []
        self.paths: dict[tuple[int, str], int] = {}
        self.silences: list[str] = []
        self.silent: dict[str, int] = defaultdict(int)
        self.blocks: list[list[tuple[_Element, str]]] = [[]]

    def _place(self, tags: tuple[str, ...]) -> int:
        """Where the innermost open element of these tags stands; 0 if none is open."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def _close(self, place: int) -> None:
        """Closes the elements from a place on."""
        while len(self.open) > place:
            tag = self.open.pop().tag
            self.places[tag].pop()
            if tag in BLOCKS:
                self.open_blocks.pop()

    def _leave(self, tags: tuple[str, ...], scopes: tuple[str, ...] = ()) -> None:
        place = self._place(tags)
        if place and place > self._place((*scopes, "table", "body")):
            self._close(place)

    def _hush(self, tag: str) -> None:
        self.silences.append(tag)
        self.silent[tag] += 1

    def _speak(self) -> str:
        tag = self.silences.pop()
        self.silent[tag] -= 1
        return tag

    def handle_starttag(self, tag: str, attrs) -> None:
        if self.silences == ["head"] and tag not in IN_HEAD:
            self._speak()
        if tag in SILENT:
            self._hush(tag)
        if self.silences:
            return
        if tag == "br":
            self.handle_data(" ")
        if tag in CLOSES_P:
            self._leave(("p",), ("td", "th", "li", "div", "article", "section", "button"))
        if tag in ENDS:
            self._leave(ENDS[tag], SCOPES.get(tag, ()))
        if tag in BLOCKS:
            self.blocks.append([])
        if tag not in VOID:
            named, at = dict(attrs), self.open[-1]
            out = at.out or _out(tag, named, at)
            path = self.paths.setdefault((at.path, tag), len(self.paths) + 1)
            element = _Element(tag, at, path, out, not out and _marked(tag, named, at))
            self.places[tag].append(len(self.open))
            if tag in BLOCKS:
                self.open_blocks.append(len(self.open))
            self.open.append(element)
            self.elements.append(element)
            if tag in ("h1", "article", "main"):
                walk: _Element | None = element
                while walk and not walk.central:
                    walk.central = True
                    walk = walk.parent

    def handle_startendtag(self, tag: str, attrs) -> None:
        if tag not in SILENT:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if self.silences:
            if self.silent[tag]:
                while self._speak() != tag:
                    pass
            return
        if tag in BLOCKS:
            self.blocks.append([])
        place = self._place((tag,))
        # The end of an inline element outside whose block it stands is a stray one.
        if place and (tag in BLOCKS or not self.open_blocks or self.open_blocks[-1] < place):
            self._close(place)

    def handle_data(self, data: str) -> None:
        if self.silences == ["head"] and data.strip():
            self._speak()
        if not self.silences:
            self.blocks[-1].append((self.open[-1], data))


def _scores(nodes: list[tuple[_Element, int, int]]) -> np.ndarray:
    """Score per text node: its path's text and punctuation per node, smoothed and fused."""
    _, path, count = np.unique([e.path for e, _, _ in nodes], return_inverse=True, return_counts=True)
    size = np.bincount(path, [size for _, size, _ in nodes]) / count
    marks = np.bincount(path, [marks for _, _, marks in nodes]) / count
    plain = (size * (1 + marks))[path]
    smooth = np.convolve(np.pad(plain, 3, mode="edge"), SMOOTHING, "valid")
    return (np.bincount(path, np.sqrt(plain * smooth)) / count)[path]


def _threshold(scores: np.ndarray) -> float:
    return min(scores.mean(), scores.std()) if len(scores) > 1 else 0.0


def _forgiven(nodes: list[tuple[_Element, int, int]], central: bool) -> set[_Element]:
    """Elements marked by words that hold most of the content: wrappers, whose names say what stands beside it.

    Content under a further mark inside counts for that one alone; ``central`` says whether the page has a
    headline, article or main part.
    """
    own: dict[_Element, int] = defaultdict(int)
    total = 0
    scores = _scores(nodes)
    threshold = _threshold(scores)
    for (element, size, _), score in zip(nodes, scores):
        if score >= threshold:
            total += size
            if element.mark:
                own[element.mark] += size
    marks = set(own)
    for mark in own:
        while (mark := mark.parent.mark) and mark not in marks:
            marks.add(mark)
    nested: dict[_Element, int] = defaultdict(int)
    found = set()
    for mark in sorted(marks, key=lambda e: -e.depth):
        share = FORGIVEN_HALF if mark.central and mark.tag != "article" else FORGIVEN_SHARE
        outer = mark.parent.mark
        if own.get(mark) and mark.central == central and own[mark] >= share * (total - nested[mark]):
            found.add(mark)
            if outer:
                own[outer] += own[mark]
                nested[outer] += nested[mark]
        elif outer:
            nested[outer] += own.get(mark, 0) + nested[mark]
    return found


def _inside(elements: list[_Element], roots: set[_Element]) -> set[_Element]:
    """The elements that are one of ``roots`` or stand in one; a parent comes before its children."""
    found: set[_Element] = set()
    for element in elements:
        if element in roots or element.parent in found:
            found.add(element)
    return found


def _dropped(page: _Page, forgiven: set[_Element]) -> set[_Element]:
    """The elements that are, or stand in, something else than the article."""
    return _inside(page.elements, {e for e in page.elements if e.out or (e.mark is e and e not in forgiven)})


class _Block:
    """Text of one block, what it stands in, and its nodes (element, length, punctuation marks)."""

    __slots__ = ("text", "nodes", "holder", "heads")

    def __init__(self, text: str, nodes: list[tuple[_Element, int, int]]):
        self.text, self.nodes = text, nodes
        self.holder, self.heads = nodes[0][0].holder, nodes[0][0].heads

    def only_links(self, outside: int) -> bool:
        """Is it but a link without punctuation and no heading?  ``outside`` links are around all of the article."""
        linked = sum(size for e, size, _ in self.nodes if e.links > outside)
        return not self.heads and linked > 0.8 * sum(size for _, size, _ in self.nodes) and not any(marks for _, _, marks in self.nodes)


def _headline(blocks: list[_Block], inside: set[_Element]) -> range:
    """The blocks from the headline that stands before an article without one, up to the article."""
    first = next((k for k, b in enumerate(blocks) if b.holder in inside), 0)
    own = {b.heads for b in blocks if b.holder in inside}
    for heading in ("h1",) if own - {""} else ("h1", "h2"):
        found = next((k for k in range(first - 1, -1, -1) if blocks[k].heads == heading), None)
        if found is not None and "h1" not in own:
            return range(found, first)
    return range(0)


def _closed(html: str) -> str:
    """A page whose comments end and whose last sign is no half tag, which a parser would look for again and again.

    A comment without an end is an empty one, so the text after it stays.
    """
    end = max(html.rfind("-->") + 3, html.rfind("--!>") + 4) if "--" in html else 0
    html = html[:end] + html[end:].replace("<!--", "<!---->")
    end = html.rfind(">") + 1
    return html[:end] + html[end:].replace("<", "&lt;")


def main_text(html: str | None) -> str:
    """The article of a page, its blocks joined by line feeds; empty for NULL or a page without text."""
    page = _Page()
    page.feed(_closed(html or ""))
    page.close()
    nodes = [(e, len(d.strip()), len(_PUNCTUATION.findall(d))) for block in page.blocks for e, d in block if not e.out and d.strip()]
    forgiven = _forgiven(nodes, page.root.central) if any(e.mark for e, _, _ in nodes) else set()
    dropped = _dropped(page, forgiven)
    blocks: list[_Block] = []
    for block in page.blocks:
        inside = [(e, d) for e, d in block if e not in dropped]
        text = _SPACE.sub(" ", "".join(d for _, d in inside)).strip()
        if text:
            blocks.append(_Block(text, [(e, len(d.strip()), len(_PUNCTUATION.findall(d))) for e, d in inside if d.strip()]))
    nodes = [n for b in blocks for n in b.nodes]
    if not nodes:
        return ""
    scores = _scores(nodes)
    threshold = _threshold(scores)
    total = 0
    for (element, size, _), score in zip(nodes, scores):
        if score >= threshold:
            total += size
            element.content += size
    for element in reversed(page.elements):
        if element.parent:
            element.parent.content += element.content
    root = max((e for e, _, _ in nodes), key=lambda e: e.content)
    while root.parent and (root.content < CONTENT_SHARE * total or root.tag not in BLOCKS or root.tag in ("p", "li", "td", "tr", "h1", "h2", "h3")):
        root = root.parent
    around, walk = [], root
    while walk:
        around.append(walk)
        walk = walk.parent
    main = next((e for e in reversed(around) if e.tag == "main"), None)
    article = next((e for e in reversed(around) if e.tag == "article"), None)
    section = next((e for e in around if e.tag in SECTIONS and e.content >= total), around[-1])
    # Links in the article itself are its text.
    own = _inside(page.elements, {article or main} - {None})
    before = range(0)
    if main:
        roots = {main}
    elif article:
        roots = {e for e in page.elements if e.tag == "article" and e.content and e not in dropped}
        before = _headline(blocks, own)
    else:
        roots = {section}
    outside = (main or article or section).links
    kept = _inside(page.elements, roots)
    return "\n".join(
        b.text
        for k, b in enumerate(blocks)
        if (b.holder in kept or k in before) and (b.holder in own or not b.only_links(outside))
    )


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` for every row of ``pages`` (page_id, url, html).

    A NULL or empty page, or one without text, has the empty text.  Broken markup is read as far as it goes; repeated
    rows come back as often as they came in; NULL ids and addresses stay NULL.  Other
    columns are ignored, whatever their names; an empty table gives no rows.
    """

    def texts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            frame["text"] = [main_text(h) for h in frame.pop("html")]
            frame["n_chars"] = frame["text"].str.len().astype("int64")
            yield frame

    rows = pages.select(safe_id("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    found = rows.mapInPandas(texts, "page_id long, url string, text string, n_chars long")
    return found.select(true_id("page_id"), "url", "text", "n_chars")
