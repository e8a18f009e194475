"""The main text of web pages, by text-to-tag ratios over lines of parser events.

The events of the standard parser are folded into lines, one per block of the page, each with its text, its
number of tags and the containers it stands in. A line's ratio is its text over its tags; lines in menus,
footers, adverts and the like have none. The ratios are smoothed with a Gaussian, and lines above their
standard deviation form the content cluster. The article element (or the main element, or a container named
as content) that holds the cluster is the region, and all its lines are returned, short ones as well. A page
without such a container has the stretch of lines from the first to the last of the cluster as its region.
"""

from __future__ import annotations

import re
from collections import defaultdict
from html.parser import HTMLParser

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .common import map_batches

# Element names of the markup language.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section "
    "summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
IN_HEAD = frozenset("base link meta title style script noscript template".split())
SILENT = frozenset(
    "applet audio button canvas datalist head iframe map noframes noscript object option script select style "
    "svg template textarea title video".split()
)
# An element that ends an open one of the same kind, up to the named containers.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
}
ASIDE = frozenset("nav footer aside form menu dialog search".split())
STRUCTURAL = ASIDE | {"article", "header", "main"}
P_SCOPE = frozenset(("button", "object", "td", "th"))
ASIDE_ROLES = frozenset(
    "alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split()
)
# Words in a class or an id that name other things than the article.
ASIDE_WORDS = frozenset(
    "ad ads adbox adslot adsense advert adverts advertisement advertisements advertising aside banner breadcrumb "
    "breadcrumbs comment commentlist comments commentary consent cookie cookies copyright dialog disqus footer "
    "gdpr header login masthead menu menubar modal nav navbar navigation newsletter notice notices notification "
    "overlay pager pagination popup promo promoted promotion recommended related remarks replies respond reply "
    "search share sharing sidebar signup social sponsor sponsored subscribe subscription teaser toolbar widget "
    "widgets".split()
)
COMMENT_WORDS = frozenset("comment comments commentlist disqus replies reply respond".split())
CONTENT_WORDS = frozenset("article content entry main post story".split())
NEGATING = frozenset("has is no not with without".split())

SIGMA = 1.0
RADIUS = 3
LINK_SHARE = 0.5
REGION_SHARE = 0.5

_WORD = re.compile(r"[a-z0-9]+")
_HUMP = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_KINDS = ("article", "main", "content")


class Line:
    """A block of the page: its pieces of text, tags, characters in links and where it stands."""

    __slots__ = ("parts", "tags", "links", "aside", "within", "heading", "item")

    def __init__(self, aside, within, heading, item):
        self.parts, self.tags, self.links = [], 0, 0
        self.aside, self.within, self.heading, self.item = aside, within, heading, item


def _named(attrs) -> list[list[str]]:
    """The words of each class name and of the id."""
    names = [*(attrs.get("class") or "").split(), attrs.get("id") or ""]
    return [_WORD.findall(_HUMP.sub(" ", n).lower()) for n in names]


class PageLines(HTMLParser):
    """Folds parser events into lines; ``by_name`` says whether class names may set a part aside."""

    def __init__(self, by_name: bool = True):
        super().__init__(convert_charrefs=True)
        self.by_name = by_name
        self.lines: list[Line] = []
        self.stack: list[tuple] = [("", False, False, (), False)]
        self.opened: dict[str, int] = defaultdict(int)
        self.regions = 0
        self.line: Line | None = None
        self.pending_tags = 0

    def updatepos(self, i, j):
        """Line numbers are not needed."""
        return j

    def parse_comment(self, i, report=1):
        """A comment that is never closed reaches to the end of the page."""
        if self.rawdata.find("-->", i + 4) < 0 and self.rawdata.startswith("<!--", i):
            closed = self.rawdata.find(">", i + 4)
            return closed + 1 if self.rawdata.startswith(("<!-->", "<!--->"), i) else len(self.rawdata)
        return super().parse_comment(i, report)

    def parse_html_declaration(self, i):
        """Marked sections are no part of a page; they are passed over like comments."""
        if self.rawdata.startswith("<![", i):
            return self.parse_bogus_comment(i)
        return super().parse_html_declaration(i)

    # The stack holds (name, silent, aside, regions, in_article) of each open element.
    def _pop_to(self, at: int):
        while len(self.stack) > at:
            name = self.stack.pop()[0]
            self.opened[name] -= 1
            if name in BLOCK:
                self.line = None

    def _last(self, names, until=frozenset()) -> int:
        """The innermost open element of these names, but none outside the containers ``until``."""
        for at in range(len(self.stack) - 1, 0, -1):
            name = self.stack[at][0]
            if name in names:
                return at
            if name in until:
                return -1
        return -1

    def _set_aside(self, tag, attrs, in_article) -> bool:
        if tag in ASIDE or (tag == "header" and not in_article):
            return True
        role = (attrs.get("role") or "").lower()
        if role in ASIDE_ROLES or "hidden" in attrs or (attrs.get("aria-hidden") or "").lower() == "true":
            return True
        if _HIDDEN.search(attrs.get("style") or ""):
            return True
        if not self.by_name or tag in ("html", "body", "main"):
            return False
        for words in _named(attrs):
            if not words or words[0] in NEGATING:
                continue
            found = ASIDE_WORDS.intersection(words)
            if tag == "article":
                found &= COMMENT_WORDS
            elif in_article or CONTENT_WORDS.intersection(words):
                found -= {"header"}
            if found:
                return True
        return False

    def _kind(self, tag, attrs) -> int:
        if tag == "article" or (attrs.get("role") or "").lower() == "article":
            return 0
        if tag == "main" or (attrs.get("role") or "").lower() == "main":
            return 1
        if tag in ("div", "section", "td") and any(
            CONTENT_WORDS.intersection(w) and not (w[0] in NEGATING) for w in _named(attrs) if w
        ):
            return 2
        return -1

    def handle_starttag(self, tag, attrs):
        if tag in VOID:
            if tag == "hr":
                self.line = None
            elif tag == "br":
                self._text(" ")
            self._tag()
            return
        opened = self.opened
        if opened["head"] and tag not in IN_HEAD and tag != "head":
            self._pop_to(self._last({"head"}))
        if tag in BLOCK:
            if opened["p"]:
                self._end_open({"p"}, P_SCOPE)
            if tag in ENDS and any(opened[n] for n in ENDS[tag][0]):
                self._end_open(*ENDS[tag])
            if tag in HEADINGS and self.stack[-1][0] in HEADINGS:
                self._pop_to(len(self.stack) - 1)
            self.line = None
        _, silent, aside, regions, in_article = self.stack[-1]
        if attrs or tag in STRUCTURAL:
            attrs = dict(attrs)
            aside = aside or self._set_aside(tag, attrs, in_article)
            kind = self._kind(tag, attrs)
            if kind >= 0 and not any(k == kind for k, _ in regions):
                regions = (*regions, (kind, self.regions))
                self.regions += 1
            in_article = in_article or kind in (0, 1)
        self.stack.append((tag, silent or tag in SILENT, aside, regions, in_article))
        opened[tag] += 1
        self._tag()

    def _end_open(self, names, until):
        at = self._last(names, until)
        if at > 0:
            self._pop_to(at)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        self._tag()
        if self.opened[tag]:
            if self.stack[-1][0] == tag:
                self._pop_to(len(self.stack) - 1)
            else:
                self._end_open({tag}, frozenset() if tag in BLOCK or tag in SILENT else BLOCK)
        if tag in BLOCK:
            self.line = None

    def _tag(self):
        if self.line is None:
            self.pending_tags += 1
        else:
            self.line.tags += 1

    def handle_data(self, data):
        if not self.stack[-1][1]:
            self._text(data)

    def _text(self, data):
        line = self.line
        if line is None:
            if not data or data.isspace():
                return
            _, _, aside, regions, _ = self.stack[-1]
            opened = self.opened
            heading = any(opened[h] for h in HEADINGS)
            line = self.line = Line(aside, regions, heading, opened["li"] > 0)
            line.tags, self.pending_tags = self.pending_tags, 0
            self.lines.append(line)
        line.parts.append(data)
        if self.opened["a"]:
            line.links += len(data.strip())


def read_lines(html: str, by_name: bool = True) -> list[Line]:
    parser = PageLines(by_name)
    parser.feed(html)
    parser.close()
    return parser.lines


def smooth(ratios: np.ndarray, sigma: float = SIGMA, radius: int = RADIUS) -> np.ndarray:
    """Gaussian smoothing; at the ends the weights that fall outside are left out."""
    at = np.arange(-radius, radius + 1)
    kernel = np.exp(-(at**2) / (2 * sigma**2))
    whole = np.convolve(ratios, kernel)[radius : radius + len(ratios)]
    weight = np.convolve(np.ones(len(ratios)), kernel)[radius : radius + len(ratios)]
    return whole / weight


def content_lines(lines: list[Line], lengths: list[int]) -> list[bool]:
    """Which lines belong to the region of the content cluster."""
    ratios = [0 if x.aside else n / max(1, x.tags) for x, n in zip(lines, lengths, strict=True)]
    smoothed = smooth(np.array(ratios, float))
    above = (smoothed >= smoothed.std()).tolist()
    cluster = [i for i, x in enumerate(lines) if above[i] and lengths[i] and not x.aside]
    total = sum(lengths[i] for i in cluster)
    for kind in range(len(_KINDS)):
        region = [next((n for k, n in x.within if k == kind), -1) for x in lines]
        held = [i for i in cluster if region[i] >= 0]
        if held and sum(lengths[i] for i in held) >= REGION_SHARE * total:
            chosen = {region[i] for i in held}
            return [r in chosen and not x.aside for r, x in zip(region, lines, strict=True)]
    if not cluster:
        return [False] * len(lines)

    def near(i: int) -> bool:
        """Whether a line beside the cluster is plain text: no menu entry, not mostly links."""
        x = lines[i]
        return not (x.aside or x.item or x.links >= LINK_SHARE * max(1, lengths[i]))

    first, last = cluster[0], cluster[-1]
    while first > 0 and near(first - 1):
        first -= 1
    while last + 1 < len(lines) and near(last + 1) and not lines[last + 1].heading:
        last += 1
    return [first <= i <= last and not x.aside for i, x in enumerate(lines)]


def main_blocks(html: str | None) -> tuple[list[str], int]:
    """The blocks of the article in page order, and how many lines with text the page has."""
    n_lines = 0
    for by_name in (True, False):
        lines = read_lines(html or "", by_name)
        blocks = [" ".join("".join(line.parts).split()) for line in lines]
        n_lines = sum(map(bool, blocks))
        if not n_lines:
            break
        chosen = content_lines(lines, [len(b) for b in blocks])
        if any(chosen):
            return [b for b, keep in zip(blocks, chosen, strict=True) if keep and b], n_lines
    return [], n_lines


def main_text(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """(page_id, url, text, n_chars, n_blocks, n_lines) of every page, in one pass without a shuffle.

    ``text`` is the article with character references decoded, white space inside a block turned into one
    space, and blocks joined by two line feeds in page order. A NULL or empty page, one without text and one
    that holds nothing but menus, notices and the like have an empty text. Where class names would
    set aside everything, they are ignored. Pages of any length are read whole; repeated rows
    give a row each, NULL ids stay, an empty table gives no rows, further columns are ignored. Unclosed and
    crossed elements are closed as browsers do; an unclosed comment reaches to the end.
    """
    narrow = pages.select(
        F.col(f"`{id_col}`").cast("long").alias("page_id"),
        F.col(f"`{url_col}`").cast("string").alias("url"),
        F.col(f"`{html_col}`").cast("string").alias("html"),
    )

    def extract(batch):
        found = [main_blocks(html) for html in batch.column("html").to_pylist()]
        joined = ["\n\n".join(blocks) for blocks, _ in found]
        yield {
            "page_id": batch.column("page_id"),
            "url": batch.column("url"),
            "text": joined,
            "n_chars": [len(t) for t in joined],
            "n_blocks": [len(blocks) for blocks, _ in found],
            "n_lines": [n for _, n in found],
        }

    schema = "page_id long, url string, text string, n_chars long, n_blocks long, n_lines long"
    return map_batches(narrow, extract, schema)
