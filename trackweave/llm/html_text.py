"""Operator 1: main text of HTML pages.

The standard library's parser streams events into lines, one for each block of the page, with the characters of text,
the tags met and the characters within links. A line's ratio is its text to its tags, weighed by its markup: nothing for
menus, page headers, footers, sidebars, forms, adverts and comments, however long, a part for blocks that their class or id
calls something of the kind but that may be prose, all for the rest. The ratios are smoothed with a Gaussian kernel and clustered by a threshold.
The lines above it vote, by their text, for the content region: the articles they lie in, or else the container. Within
the region a line of part weight stays if its own ratio passes the threshold; lines of full weight stay, short ones and
headings among them too.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Elements of HTML by what they do here.
SILENT = set("script style noscript template svg math iframe object canvas audio video head title textarea select option button datalist".split())
BOILERPLATE = set("nav footer aside form menu dialog".split())
REGIONS = set("article main section div body td".split())
BLOCKS = REGIONS | BOILERPLATE | set(
    "address blockquote center dd details dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 header hr html legend li ol p pre"
    " summary table tbody tfoot th thead tr ul caption".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE_SPACE = {"br", "img", "wbr", "td", "th"}
#: Words in class, id and role that mark boilerplate.
HARD = set(
    "ad ads advert adverts advertisement advertising breadcrumb breadcrumbs cookie cookies consent"
    " footer masthead nav navbar navigation newsletter pagination popup modal sidebar sponsor sponsored subscribe"
    " subscription widget widgets respond signup complementary contentinfo login".split()
)
#: Words that do so of page headers, which within an article name its own.
OUTSIDE = {"header", "banner", "menu", "toolbar"}
#: Those of them that within an article leave the verdict to the ratio.
INSIDE = OUTSIDE - {"header"}
#: Words that say it of some blocks, but stand on prose as well.
SOFT = set("notice notices promo promoted related share sharing social alert search reply".split())
#: What ratios keep of their value in blocks of SOFT and INSIDE. Other boilerplate and comments keep nothing.
SOFT_WEIGHT = 0.25
COMMENTS = {"comment", "comments", "commentlist", "replies", "disqus"}
#: Words that say where a block is or what kind of box. An id marks boilerplate if it has no others beside
#: those above, as it may name the subject of a section; so does a part of a class, unless it begins with one of WITHOUT.
PLACES = set(
    "site main page global left right top bottom upper lower primary secondary area box wrap wrapper container list section"
    " block bar inner outer links form unit slot panel col column div gpt google dfp the my l r".split()
)
WITHOUT = {"has", "no", "with", "without", "hide"}
#: Words that name the block of the article.
CONTENT = {"article", "content", "entry", "post", "story", "main"}
#: Elements whose id is as often an anchor, so that only their class and role count, and those that hold no block's name.
ANCHORS = {"h1", "h2", "h3", "h4", "h5", "h6", "p", "span", "a", "li", "dt", "dd"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Elements whose closing tag may be left out, by what closes them.
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
SIGMA, RADIUS = 1.0, 2
#: Share of the mean smoothed ratio, over the lines of full weight, from which a line counts as content.
THRESHOLD = 0.5
SPACES = re.compile(r"\s+")
PARTS = re.compile(r"[A-Za-z]+")
HUMPS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
#: Controls that hold no blocks; where one stays open in the page, the next of these tags ends it.
CONTROLS = {"button", "select", "option", "datalist"}
ENDS = set("article main section nav header footer aside p ul ol table blockquote pre h1 h2 h3 h4 h5 h6".split())


@dataclass
class Line:
    """A block: its text, the tags met since the last one, the characters within links, the weight of its markup, and its
    containers' numbers."""

    text: str
    tags: int
    linked: int
    weight: float
    regions: tuple[int, ...]
    heading: bool = False


@dataclass
class Element:
    tag: str
    region: int | None = None
    weight: float = 1.0
    silent: bool = False
    #: Of a header in main but in no article: where its lines start.
    banner: int | None = None


@dataclass
class _State:
    lines: list[Line] = field(default_factory=list)
    stack: list[Element] = field(default_factory=list)
    text: list[str] = field(default_factory=list)
    tags: int = 0
    linked: int = 0
    regions: list[str] = field(default_factory=list)


def named(tag: str, attrs: list[tuple[str, str | None]]) -> set[str]:
    """The words of class, id and role, but for the id of elements that are rather anchors."""
    used = ("class", "role") if tag in ANCHORS else ("class", "id", "role")
    return {x.lower() for name, value in attrs if name in used and value for x in PARTS.findall(value)}


def marks(tag: str, attrs: list[tuple[str, str | None]]) -> set[str]:
    """The words of class, role and id that may mark boilerplate."""
    found: set[str] = set()
    for name, value in attrs:
        if not value or name not in ("class", "role", "id") or name == "id" and tag in ANCHORS:
            continue
        for token in value.split():
            words = [x.lower() for x in (*PARTS.findall(token), *HUMPS.findall(token))]
            known = HARD | OUTSIDE | SOFT | COMMENTS | PLACES
            if name == "id" and not known.issuperset(x.lower() for x in HUMPS.findall(token)) and not known.issuperset(x.lower() for x in PARTS.findall(token)):
                continue
            if words and words[0] not in WITHOUT:
                found.update(words)
    return found


def hinted(tag: str, attrs: list[tuple[str, str | None]], in_article: bool) -> float:
    """The weight that class, id and role leave an element; an article has all of it unless it is a comment."""
    if tag in ("html", "body", "main"):
        return 1.0
    if any(name == "hidden" or name == "aria-hidden" and value == "true" for name, value in attrs):
        return 0.0
    words = marks(tag, attrs)
    if tag == "article":
        return 0.0 if words & COMMENTS else 1.0
    if words & (COMMENTS | HARD) or not in_article and words & OUTSIDE:
        return 0.0
    return SOFT_WEIGHT if words & (SOFT | INSIDE) and tag not in HEADINGS else 1.0


class PageLines(HTMLParser):
    """Events in, lines out. Memory is the page's text and the open elements."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.s = _State()
        self.silent = self.links = 0
        self.unclosed = False

    def _end_line(self) -> None:
        s = self.s
        text = SPACES.sub(" ", "".join(s.text)).strip()
        if text:
            regions = tuple(e.region for e in s.stack if e.region is not None)
            s.lines.append(Line(text, s.tags, s.linked, min((e.weight for e in s.stack), default=1.0), regions, any(e.tag in HEADINGS for e in s.stack)))
            s.tags = s.linked = 0
        s.text.clear()

    def _push(self, e: Element) -> None:
        self.s.stack.append(e)
        self.silent += e.silent
        self.links += e.tag == "a"

    def _pop(self) -> None:
        e = self.s.stack.pop()
        self.silent -= e.silent
        self.links -= e.tag == "a"
        if e.banner is not None:
            self._end_banner(e.banner)

    def _end_banner(self, start: int) -> None:
        """A header in main names the site, unless it has a heading, which then is the article's."""
        if not any(x.heading for x in self.s.lines[start:]):
            for x in self.s.lines[start:]:
                x.weight = 0.0

    def _in_article(self, *tags: str) -> bool:
        return any(e.tag in (tags or ("article", "main")) for e in self.s.stack)

    def handle_starttag(self, tag: str, attrs) -> None:
        s = self.s
        s.tags += 1
        if tag in BLOCKS:
            self._end_line()
            self._leave(tag, attrs)
            while s.stack and s.stack[-1].tag == "p":
                self._pop()
            if s.stack and s.stack[-1].tag not in BLOCKS and any(e.tag == "p" for e in s.stack):
                self._close("p")
        elif tag in INLINE_SPACE:
            s.text.append(" ")
        closes = CLOSED_BY.get(s.stack[-1].tag) if s.stack else None
        if closes and tag in closes:
            self._end_line()
            self._pop()
        if tag in VOID:
            return
        # A header inside the article may hold its title; one of the page doesn't.
        weight = hinted(tag, attrs, self._in_article())
        if tag in BOILERPLATE or tag == "header" and not self._in_article():
            weight = 0.0
        region = None
        if tag in REGIONS:
            region = len(s.regions)
            s.regions.append(tag)
        banner = len(s.lines) if tag == "header" and self._in_article("main") and not self._in_article("article") else None
        self._push(Element(tag, region, weight, tag in SILENT, banner))

    def _leave(self, tag: str, attrs) -> None:
        """A block ends an open head; an article, by its tag or its name, ends a menu or page header that was left open."""
        if any(e.tag == "head" for e in self.s.stack):
            self._close("head")
        while self.unclosed and tag in ENDS and any(e.tag in CONTROLS for e in self.s.stack):
            self._close(next(e.tag for e in self.s.stack if e.tag in CONTROLS))
        if tag in ("article", "main") or tag in REGIONS and named(tag, attrs) & CONTENT:
            for left in ("nav", "header"):
                if any(e.tag == left for e in self.s.stack) and not self._in_article():
                    self._close(left)

    def handle_startendtag(self, tag: str, attrs) -> None:
        self.handle_starttag(tag, attrs)

    def _close(self, tag: str) -> None:
        stack = self.s.stack
        while stack:
            last = stack[-1].tag
            self._pop()
            if last == tag:
                break

    def handle_endtag(self, tag: str) -> None:
        s = self.s
        s.tags += 1
        if tag in BLOCKS:
            self._end_line()
        depth = next((k for k in range(len(s.stack) - 1, -1, -1) if s.stack[k].tag == tag), None)
        if depth is None:
            return
        # An inline end tag doesn't reach beyond the block it stands in.
        if tag in BLOCKS or not any(e.tag in BLOCKS for e in s.stack[depth + 1 :]):
            self._close(tag)

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.s.text.append(data)
            if self.links:
                self.s.linked += len(data.strip())

    def lines(self, html: str) -> list[Line]:
        small = html.lower()
        self.unclosed = any(small.count(f"<{x}") > small.count(f"</{x}") for x in CONTROLS - {"option"})
        self.feed(html)
        self.close()
        self._end_line()
        while self.s.stack:
            self._pop()
        return self.s.lines


def smoothed(ratios: np.ndarray) -> np.ndarray:
    """Gaussian smoothing over neighbouring lines; at the ends the kernel is cut and weighed anew."""
    kernel = np.exp(-0.5 * (np.arange(-RADIUS, RADIUS + 1) / SIGMA) ** 2)
    part = lambda x: np.convolve(x, kernel)[RADIUS : RADIUS + len(x)]
    return part(ratios) / part(np.ones(len(ratios)))


def content(lines: list[Line], tags: list[str]) -> list[Line]:
    """The lines of the content region; tags names the container of each number."""
    plain = [k for k, x in enumerate(lines) if x.weight == 1]
    if not plain:
        return []
    ratios = np.array([0.0 if 2 * x.linked > len(x.text) else x.weight * len(x.text) / max(x.tags, 1) for x in lines])
    smooth = smoothed(ratios)
    limit = THRESHOLD * smooth[plain].mean()
    seeds = [k for k in plain if smooth[k] >= limit and ratios[k] > 0] or plain
    # What lies outside the cluster of its own accord: blocks of part weight with a low ratio.
    inside = [k for k, x in enumerate(lines) if x.weight == 1 or 0 < x.weight and ratios[k] >= limit]
    votes: dict[int, int] = {}
    for k in seeds:
        for r in lines[k].regions or (-1,):
            votes[r] = votes.get(r, 0) + len(lines[k].text)
    # The innermost container that holds most of the seeds' text; it widens to the article it is part of.
    total = sum(len(lines[k].text) for k in seeds)
    region = max((r for r in votes if 2 * votes[r] > total), default=-1)
    path = next((x.regions[: x.regions.index(region) + 1] for x in lines if region in x.regions), ())
    # Articles side by side are content if the cluster has lines in them; the outermost ones are taken whole.
    outer = lambda x: next((r for r in x.regions if tags[r] == "article"), None)
    articles = {outer(lines[k]) for k in seeds} - {None}
    if any(tags[r] == "article" for r in path) or sum(votes[r] for r in articles) * 2 > total:
        return [lines[k] for k in inside if outer(lines[k]) in articles]
    mains = [r for r in path if tags[r] == "main"]
    if mains:
        return [lines[k] for k in inside if mains[-1] in lines[k].regions]
    # Without one, lines count that stand in the path to the region or in a container with seeds.
    wide = next((r for r in path if tags[r] != "body"), region)
    seeded = {lines[k].regions[-1] for k in seeds if lines[k].regions} | {r for r in path if r >= wide}
    return [lines[k] for k in inside if wide == -1 or wide in lines[k].regions and lines[k].regions[-1] in seeded]


def main_text(html: str | None) -> str:
    """The article of a page: its blocks in order, joined by an empty line. Null and pages without text give ''."""
    page = PageLines()
    lines = page.lines(html or "")
    return "\n\n".join(x.text for x in content(lines, page.s.regions))


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row a row of pages: id, url, text, n_chars.

    The whole html is parsed, however long. Null html and html without text give an empty text of no characters. Broken
    markup never fails: open elements are closed where a browser would, or at the end. Lone surrogates that character
    references may write become the replacement character. Repeated rows give equal results; of containers with
    equal votes the innermost, later one wins. Other columns of pages play no part; an empty table gives an empty result.
    """
    kinds = [pages.schema[c].dataType.simpleString() for c in (id_col, url_col)]
    schema = f"{id_col} {kinds[0]}, {url_col} {kinds[1]}, text string, n_chars bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                texts = [main_text(x.as_py()) for x in part.column(2)]
                texts = [x.encode("utf-8", "replace").decode() if not x.isascii() else x for x in texts]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                    names=[id_col, url_col, "text", "n_chars"],
                )

    return pages.select(id_col, url_col, html_col).mapInArrow(run, schema)
