"""HTML extraction: tag ratios per line of parser events, smoothed, clustered by a threshold.

The standard library's parser streams events; block boundaries cut them into lines. Each line has a
text-to-tag ratio, its characters outside links by the tags met, weighed by what the elements around
it suggest: nothing for menus, footers and controls, little where a tag, role or name speaks of what
stands around an article, more inside article and main elements. The ratios are smoothed with a
Gaussian kernel, and a threshold from their spread parts the lines into two clusters: lines over it,
both smoothed and by themselves, are content. So names and tags are priors only: where all of the
text stands under a doubtful name, it is the content nevertheless.

The regions are the containers of content lines: an article or main element with all that stands in
it, else the element around text elements. In a region, other lines are the text's as well if they
weigh what some of its content does, or most of that: all lines of an article; elsewhere those
between content lines, headings above, and text elements, or elements of the kind that holds the
content, at its begin and end. Lines that are mostly links count only in text elements, between
content lines or in an article. A line that begins as footers do weighs little.

Defined results: a null or empty page gives an empty text; a page without content lines too; a page
without any markup is one block; very long and deeply nested pages are streamed in linear memory and
never cut; equal lines are all kept; extra columns stay as they are, since only html is read.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Element and attribute names with a meaning in HTML pages.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead title tr ul".split())
#: Elements without text, and those whose text is never an article's.
MUTE = frozenset("applet audio canvas head iframe noscript object script style svg template title video".split())
NEVER = frozenset("button datalist fieldset footer label legend map menu nav option select textarea".split())
ASIDE = frozenset("aside dialog form search".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE_NEVER = frozenset("applet audio button canvas datalist iframe label map noscript object script select style svg template textarea video".split())
NEVER_ROLES = frozenset("navigation contentinfo menu menubar toolbar".split())
ASIDE_ROLES = frozenset("banner complementary search form alert alertdialog dialog".split())
NAMES = frozenset(
    "ad ads adbox adsense advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disclaimer discussion discussions disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices notification pager pagination popup promo promoted promotion related reply replies respond responses search share sharing sidebar sidebars signup skip social sponsor sponsored subscribe subscription teaser toolbar topbar widget widgets".split()
)
#: Names like has-sidebar, ad-free or page-header-wrapper stand on elements around the whole page.
LAYOUT = frozenset("has no with without layout wrapper free".split())
#: First parts of names that tell a post's subjects or kind, like category-social and tag-search.
SUBJECTS = frozenset("category tag taxonomy term type format status".split())
#: First parts of names of a post's own header.
POSTS = frozenset("article entry post story".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Parts of a text, which are no region of their own.
TEXT_LEVEL = HEADINGS | frozenset("address blockquote caption center dd details dl dt figcaption figure hgroup li ol p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCKS - {"html", "head", "body", "title", "option"}
#: What an open element of this name ends when a new one of the group starts.
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select", "datalist"}}

#: Parameters of the method: kernel width in lines, and the threshold in standard deviations.
SIGMA = 1.0
LEVEL = 0.5
#: Priors of an element: inside article and main, with a name of doubt, and with one of the frame.
ARTICLE, DOUBT, AROUND = 3.0, 0.25, 0.03
#: Least share of its content's weight that a region's other lines have.
ALIKE = 0.5

# How lines of footers begin.
_FOOTER = re.compile(r"(?i)(?:copyright|©|\(c\)|&copy;)\s*(?:©|\(c\))?\s*(?:\d{4}|by\b)|all rights reserved\b|powered by\b")
_PARTS = re.compile(r"[a-z]+|[A-Z][a-z]*|[A-Z]+")
_SPACE = re.compile(r"\s+")


def _names(value: str) -> list[str]:
    return [p.lower() for p in _PARTS.findall(value)]


@dataclass(eq=False, slots=True)
class Element:
    tag: str
    weight: float
    article: bool
    around: Element | None  # the element around it that is no part of a text
    root: Element | None = None  # the article or main element that it is or stands in, the innermost
    whole: bool = False  # whether that is an article, not only the page's main part
    holds: bool = False  # whether blocks stand inside

    @property
    def region(self) -> Element | None:
        """The element around its text lines: a div without blocks inside is used as a paragraph."""
        if self.root is not None:
            return self.root
        if self.tag in TEXT_LEVEL or (self.tag == "div" and not self.holds):
            return self.around
        return self


@dataclass(slots=True)
class Line:
    text: str
    tags: int
    links: int
    element: Element

    @property
    def ratio(self) -> float:
        return self.weight * max(0, len(self.text) - self.links) / self.tags

    @property
    def weight(self) -> float:
        """The element's, but little for a line outside articles that begins as footers do."""
        return self.element.weight * (AROUND if not self.element.whole and _FOOTER.match(self.text) else 1.0)


@dataclass(slots=True)
class _Held:
    """A line around an inline element that is skipped."""

    depth: int
    text: list[str] = field(default_factory=list)
    links: int = 0


class _Lines(HTMLParser):
    """Streams events into lines."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.page = Element("body", 1.0, False, None)
        self.stack = [self.page]
        self.open = Counter()  # of each tag, how many are open
        self.lines: list[Line] = []
        self.text: list[str] = []
        self.tags = self.links = 0
        self.in_link = False
        self.held: list[_Held] = []

    def _flush(self) -> None:
        if self.text:
            text = _SPACE.sub(" ", "".join(self.text)).strip()
            if text:
                self.lines.append(Line(text, max(1, self.tags), self.links, self.stack[-1]))
                self.tags = 0
            self.text = []
        self.links = 0

    def _pop(self, to: int) -> None:
        self._flush()
        for x in self.stack[to:]:
            self.open[x.tag] -= 1
        del self.stack[to:]

    def _end(self, names: set[str], stop: set[str]) -> None:
        if any(self.open[n] for n in names):
            for k in range(len(self.stack) - 1, 0, -1):
                if self.stack[k].tag in names:
                    self._pop(k)
                    return
                if self.stack[k].tag in stop:
                    return

    def _prior(self, tag: str, attrs: list[tuple[str, str | None]], article: bool, inside: Element) -> float:
        if tag in MUTE or tag in NEVER:
            return 0.0
        found = 1.0
        if tag in ASIDE or (tag == "header" and not inside.article):
            found = AROUND
        for key, value in attrs:
            if key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and re.search(r"display\s*:\s*none", value or "", re.I)):
                return 0.0
            if key == "role" and (value or "").strip().lower() in NEVER_ROLES:
                return 0.0
            if key == "role" and (value or "").strip().lower() in ASIDE_ROLES:
                found = AROUND
            if key in ("class", "id") and value and tag not in ("html", "body"):
                for name in value.split():
                    found = min(found, self._prior_of(_names(name), tag, article, inside))
        return found * ARTICLE if article and not inside.article and found == 1.0 else found

    @staticmethod
    def _prior_of(parts: list[str], tag: str, article: bool, inside: Element) -> float:
        if article:  # an article in another one may be a comment or teaser, if its whole name says so
            return AROUND if len(parts) == 1 and parts[0] in NAMES and tag == "article" and inside.article else 1.0
        if not NAMES.intersection(parts) or LAYOUT.intersection(parts) or (len(parts) > 1 and parts[0] in SUBJECTS):
            return 1.0
        if (inside.article or parts[0] in POSTS) and {"header", "masthead"}.intersection(parts):
            return 1.0
        return AROUND if parts[-1] in NAMES else DOUBT

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if tag == "a":
            self.in_link = True
        if tag == "br":
            self.text.append(" ")
        if tag in BLOCKS:
            if tag in CLOSES_P:
                self._end({"p"}, {"td", "th", "li", "div", "section", "article", "main", "button", "blockquote"})
            if tag in SIBLINGS:
                self._end(SIBLINGS[tag], SCOPES[tag])
            self._flush()
            self.stack[-1].holds = True
            if tag in VOID:
                return
        elif tag not in INLINE_NEVER:
            return
        else:  # inline elements that are skipped leave the line around them whole
            self.held.append(_Held(len(self.stack), self.text, self.links))
            self.text, self.links = [], 0
        inside, told = self.stack[-1], dict(attrs)
        article = tag in ("article", "main") or told.get("role") in ("main", "article") or told.get("itemprop") == "articleBody"
        prior = self._prior(tag, attrs, article, inside)
        around = inside if inside.tag not in TEXT_LEVEL else inside.around
        made = Element(tag, inside.weight * prior, inside.article or (article and prior > AROUND), around, inside.root, inside.whole)
        if article and prior > AROUND:
            made.root, made.whole = made, tag == "article" or told.get("role") == "article" or told.get("itemprop") == "articleBody"
        elif article or (prior <= AROUND and not inside.whole):
            made.root = None  # a comment, or what stands beside the text in the main part
        self.stack.append(made)
        self.open[tag] += 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and (tag in BLOCKS or tag in INLINE_NEVER):
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self.tags += 1
        if tag == "a":
            self.in_link = False
        if not self.open[tag]:
            return
        if tag in INLINE_NEVER:
            if self.held and any(x.tag == tag for x in self.stack[self.held[-1].depth :]):
                held = self.held.pop()
                self._pop(held.depth)
                self.text, self.links = held.text, held.links
        elif tag in BLOCKS:
            self._flush()
            k = next(k for k in range(len(self.stack) - 1, -1, -1) if self.stack[k].tag == tag)
            while self.held and self.held[-1].depth >= k:
                self.held.pop()
            self._pop(max(k, 1))

    def handle_data(self, data):
        if self.stack[-1].tag not in MUTE:
            self.text.append(data)
            if self.in_link:
                self.links += len(data)

    def finish(self) -> None:
        self.close()
        for held in reversed(self.held):
            self.stack, self.text = self.stack[: held.depth], held.text + ([] if self.stack[-1].weight == 0 else self.text)
        self._flush()


def smooth(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing over neighbouring lines, with the edge values carried on."""
    radius = max(1, int(np.ceil(2 * sigma)))
    kernel = np.exp(-(np.arange(-radius, radius + 1) ** 2) / (2 * sigma**2))
    padded = np.pad(ratios, radius, mode="edge")
    return np.convolve(padded, kernel / kernel.sum(), mode="valid")


def content_lines(lines: list[Line]) -> np.ndarray:
    """Whether each line is in the cluster over the threshold, smoothed and by itself."""
    ratios = np.array([x.ratio for x in lines])
    smoothed = smooth(ratios)
    level = LEVEL * smoothed.std()
    content = (smoothed >= level) & (ratios >= level) & (ratios > 0)
    return content if content.any() else np.array([x.weight > 0 for x in lines])


def kept_lines(lines: list[Line], content: np.ndarray) -> np.ndarray:
    """Content lines, and the other lines of their regions that are the text's."""
    regions: dict[int, list[int]] = {}
    for i in np.flatnonzero(content).tolist():
        regions.setdefault(id(lines[i].element.region), []).append(i)
    weights = {r: [lines[i].weight for i in inside] for r, inside in regions.items()}
    least = {r: ALIKE * float(np.median(w)) for r, w in weights.items()}
    weights = {r: set(w) for r, w in weights.items()}
    tags = {r: {lines[i].element.tag for i in inside} for r, inside in regions.items()}
    kept = content.copy()
    for i, x in enumerate(lines):
        r, element = id(x.element.region), x.element
        if kept[i] or r not in regions or (x.weight < least[r] and x.weight not in weights[r]):
            continue
        text, within = element.tag in TEXT_LEVEL, regions[r][0] < i < regions[r][-1]
        if 2 * x.links >= len(x.text):
            kept[i] = text and (within or element.whole)
        else:
            kept[i] = within or element.whole or text or element.tag in tags[r] or element is element.region
    first = np.flatnonzero(kept)[:1].tolist()
    for i in reversed(range(*([0] + first if first else [0]))):  # headings just above the text, in another element
        if lines[i].element.tag not in HEADINGS or lines[i].weight < min(least.values()):
            break
        kept[i] = True
    return kept


def main_text(html: str | None) -> str:
    """The article of a page: its blocks in order, joined by newlines."""
    if not html:
        return ""
    parser = _Lines()
    parser.feed(html)
    parser.finish()
    if not parser.lines:
        return ""
    kept = kept_lines(parser.lines, content_lines(parser.lines))
    return "\n".join(x.text for x, keep in zip(parser.lines, kept, strict=True) if keep)


@F.pandas_udf(T.StringType())
def _main_text(pages: pd.Series) -> pd.Series:
    return pages.map(main_text, na_action=None)


def extract(html: str | Column) -> Column:
    """The main text of a column of pages; empty if there is none."""
    return _main_text(html)


def op1(spark, sf_dir: str) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    from tessera.session import table

    pages = table(spark, sf_dir, "pages")
    out = pages.select("page_id", "url", extract("html").alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))
