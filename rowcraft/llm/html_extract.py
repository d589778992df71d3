"""Main text of web pages from the events of the standard library's parser.

A page is read once as a stream of events into blocks (paragraphs, headings,
list items, cells). Each block is a line with a text-to-tag ratio: its characters
outside links by the tags since the line before. The ratios are smoothed with a
Gaussian and split by a threshold between two clusters; the text of the upper
cluster is the page's mass, and the mass decides what is content:

*   Elements, roles, classes and ids only *claim* to stand beside the article
    (menus, footers, sidebars, notices, adverts, forms, comments). A form, or an
    element claimed by its names, that holds half of the mass is the article's
    wrapper and its claim falls, unless an article stands elsewhere.
*   The region is all articles, if they hold half of the unclaimed mass; else so
    the main elements; else the page without the runs of links before the first
    and after the last line of the upper cluster.

All blocks of the region are the text, short ones too.

Pages are independent: the operator is a narrow map in Arrow batches.

Defined results
    null or empty html, or no text: empty text, 0 characters. Empty table: none.
    Cut or broken markup: what was opened ends with its parent or the page; an
    unfinished tag at the end of the page is no text.
    Marked sections (``<![``) and declarations: no text up to the next ``>``.
    Markup of any depth and very long pages: time in proportion to the page.
    Equal ratios: one cluster, all of it upper.
    null ``page_id`` or ``url`` and repeated rows: each page on its own.
    Only ``page_id``, ``url`` and ``html`` are read, so clashing columns cannot
    matter.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

from rowcraft.functions.arrow import map_arrow

# Elements by what they do to text.
_SILENT = frozenset("script style noscript template svg math iframe object embed applet canvas audio video map head title select option datalist textarea button".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup p pre search section summary table tbody td tfoot th thead tr ul".split()
)
_BESIDE = frozenset("nav footer aside dialog menu search".split())
_FORMS = frozenset("form fieldset".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: Words of class and id values that name something besides the article.
_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promoted promotion banner cookie cookies consent gdpr notice notices "
    "notification alert popup modal overlay newsletter subscribe subscription sidebar aside menu nav navbar navigation breadcrumb breadcrumbs footer "
    "masthead topbar share sharing social related recommended recommendations "
    "widget toolbar pagination pager login signup signin search skip trending popular copyright legal disclaimer".split()
)
_COMMENTS = frozenset("comment comments commentlist disqus respond reply replies discussion".split())
#: Words that say what kind of box a name is for; beside them a name stands alone.
_BOXES = frozenset(
    "area article articles bar block bottom box button buttons card col column container content div form group header icons inner item items left line link links list main "
    "module outer page panel post posts reader region right row section site slot space stories story text top unit user wrap wrapper".split()
)
#: What a class that only describes the page's state begins with.
_STATES = frozenset("has no not with without is show hide".split())
#: These name the page's head unless they stand inside an article.
_HEADS = frozenset(("header",))
_HEAD_NAMES = frozenset("header head topnav".split())
#: Inside an article names claim none of these.
_RUNNING = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th tr blockquote pre figure figcaption table tbody thead caption".split())
#: An opening tag ends an open one of these, up to its own container.
_ENDS = {
    "p": (frozenset("p".split()), frozenset()),
    "li": (frozenset("li p".split()), frozenset("ul ol menu dir".split())),
    "dt": (frozenset("dt dd p".split()), frozenset("dl".split())),
    "dd": (frozenset("dt dd p".split()), frozenset("dl".split())),
    "tr": (frozenset("tr td th p".split()), frozenset("table".split())),
    "td": (frozenset("td th p".split()), frozenset("tr table".split())),
    "th": (frozenset("td th p".split()), frozenset("tr table".split())),
}
_NOT_IN_P = _BLOCK - frozenset("html body td th tr tbody thead tfoot caption".split())
_ONLY_P = frozenset(("p",))
_SPLIT = re.compile(r"[^a-z0-9]+")
_COMMENT_END = re.compile(r"--!?>")
_TAG_BEGIN = re.compile(r"<[a-zA-Z/!?]")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")

_SIGMA = 1.0
#: Share of the mass that makes an element the place of the article.
_MOST = 0.5
#: Share of a line's characters that makes it a link, and links that make a menu.
_LINKED, _MENU = 0.8, 3

_OPEN, _NAMED, _CLAIMED, _UNSEEN_AT_ALL = range(4)


class _Node:
    """An element, with what it claims and what it turns out to be."""

    __slots__ = ("tag", "parent", "claim", "in_article", "mass", "text", "article", "aside", "region")

    def __init__(self, tag: str, parent: _Node | None, claim: int):
        self.tag, self.parent, self.claim = tag, parent, claim
        self.in_article = tag in ("article", "main") or (parent is not None and parent.in_article)
        self.mass, self.text, self.article, self.aside, self.region = 0, False, False, False, None


class _Block:
    __slots__ = ("text", "ratio", "linked", "links", "node")

    def __init__(self, text: str, tags: int, linked: int, links: int, node: _Node):
        self.text, self.node, self.links = text, node, links
        self.ratio = max(0, len(text) - linked) / max(1, tags)
        self.linked = linked >= _LINKED * len(text)


class _Blocks(HTMLParser):
    """The blocks of a page, and its elements, parents first."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.at = _Node("", None, _OPEN)
        self.nodes = [self.at]
        self.open: Counter[str] = Counter()
        self.blocks: list[_Block] = []
        self.parts: list[str] = []
        self.tags = self.links = self.linked = self.in_link = 0
        self.silent, self.depth = "", 0
        self.within: Counter[str] = Counter()

    def flush(self) -> None:
        if self.parts:
            if text := " ".join("".join(self.parts).split()):
                self.blocks.append(_Block(text, self.tags, self.linked, self.links, self.at))
                self.tags = 0
            self.parts, self.links, self.linked = [], 0, 0
        self.in_link = 0

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """Skips what HTML has no marked sections for, up to the next ``>``."""
        return self.rawdata.find(">", i) + 1 or len(self.rawdata)

    def parse_comment(self, i: int, report: bool = True) -> int:
        """Skips a comment; one that is left open reaches to the end."""
        found = _COMMENT_END.search(self.rawdata, i + 2)
        return found.end() if found else len(self.rawdata)

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.parts.append(data)
            if self.in_link:
                self.linked += len(" ".join(data.split()))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in _VOID and (tag in _SILENT or tag not in _BLOCK):
            self.handle_endtag(tag)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.tags += 1
        if tag == "br":
            self.parts.append(" ")
            return
        if self.silent:
            if tag == "body" or (self.silent == "head" and tag in _BLOCK):
                self.silent = ""  # the head was left open
            else:
                self.depth += tag == self.silent
                self.within[tag] += tag in _BLOCK and tag not in _VOID
                return
        if tag in _SILENT:
            if tag not in _VOID:
                self.silent, self.depth, self.within = tag, 1, Counter()
            return
        if tag == "a":
            self.links += 1
            self.in_link = 1
        if tag in _BLOCK:
            self.flush()
            if tag in _VOID:
                return
            self._close_implied(tag)
            self._enter(tag, self._claim(tag, attrs))
        elif attrs and tag not in _VOID and (claim := self._claim(tag, attrs)):
            self.flush()
            self._enter(tag, claim)

    def _enter(self, tag: str, claim: int) -> None:
        self.at = _Node(tag, self.at, claim)
        self.nodes.append(self.at)
        self.open[tag] += 1

    def _leave(self, last: _Node) -> None:
        while True:
            node = self.at
            self.open[node.tag] -= 1
            self.at = node.parent
            if node is last:
                return

    def _close_implied(self, tag: str) -> None:
        ends, stop = _ENDS.get(tag, (_ONLY_P, frozenset()) if tag in _NOT_IN_P else (frozenset(), frozenset()))
        node, found, left = self.at, None, sum(self.open[t] for t in ends)
        while left and node.parent is not None and node.tag not in stop and not (node.tag in _BLOCK and node.tag not in ends):
            if node.tag in ends:
                found, left = node, left - 1
            node = node.parent
        if found is not None:
            self._leave(found)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if self.silent:
            if tag == self.silent:
                self.depth -= 1
                if not self.depth:
                    self.silent = ""
                return
            if self.within[tag] or not self.open[tag]:
                self.within[tag] -= self.within[tag] > 0
                return
            self.silent = ""  # left open, it ends with its parent
        if tag == "a":
            self.in_link = 0
        if not self.open[tag] or (tag not in _BLOCK and self.at.tag != tag):
            return
        node = self.at
        while node.tag != tag:
            node = node.parent
        if tag not in ("html", "body"):
            self.flush()
            self._leave(node)

    def _claim(self, tag: str, attrs: list) -> int:
        """Whether an element claims to stand beside the article."""
        inside = self.at.in_article
        claim = _CLAIMED if tag in _BESIDE or (tag in _HEADS and not inside) else _NAMED if tag in _FORMS else _OPEN
        if tag in ("html", "body", "article", "main"):
            return _OPEN
        for name, value in attrs:
            if name == "hidden" or (name == "aria-hidden" and value == "true"):
                return _UNSEEN_AT_ALL
            if not value:
                continue
            if name == "style" and _UNSEEN.search(value.lower()):
                return _UNSEEN_AT_ALL
            if name == "role" and value.lower() in _ROLES:
                claim = max(claim, _NAMED if value.lower() in ("form", "search") else _CLAIMED)
            elif name in ("class", "id"):
                claim = max(claim, *(_named(word, tag, inside) for word in value.lower().split()), _OPEN)
        return claim


@lru_cache(maxsize=4096)
def _named(value: str, tag: str, inside: bool) -> int:
    """What one class or id says of an element."""
    parts = [p for p in _SPLIT.split(value) if p]
    if not parts or parts[0] in _STATES:
        return _OPEN
    if not _COMMENTS.isdisjoint(parts):
        found = _CLAIMED
    elif not _NAMES.isdisjoint(parts) or (not inside and tag not in ("h1", "h2", "h3") and not _HEAD_NAMES.isdisjoint(parts)):
        found = _NAMED
    else:
        return _OPEN
    if inside and (tag in _RUNNING or any(p not in _NAMES and p not in _COMMENTS and p not in _BOXES and len(p) > 2 and not p.isdigit() for p in parts)):
        return _OPEN  # in running text a name must stand alone
    return found


def smooth(values: list[float], sigma: float = _SIGMA) -> list[float]:
    """Gaussian smoothing; the weights of an end are those inside the list."""
    reach = math.ceil(3 * sigma)
    weights = [math.exp(-(k * k) / (2 * sigma * sigma)) for k in range(-reach, reach + 1)]
    out = []
    for i in range(len(values)):
        low, high = max(0, i - reach), min(len(values), i + reach + 1)
        part = weights[low - i + reach : high - i + reach]
        out.append(sum(w * v for w, v in zip(part, values[low:high], strict=True)) / sum(part))
    return out


def threshold(values: list[float]) -> float:
    """Midpoint of two clusters on a line (two means, from the extremes)."""
    low, high = min(values), max(values)
    for _ in range(32):
        cut = (low + high) / 2
        below, above = [v for v in values if v <= cut], [v for v in values if v > cut]
        if not above or not below:
            break
        means = sum(below) / len(below), sum(above) / len(above)
        if means == (low, high):
            break
        low, high = means
    return (low + high) / 2


def _judge(nodes: list[_Node], blocks: list[_Block], upper: list[bool]) -> None:
    """Sums the mass of every element and decides on the claims."""
    for block, high in zip(blocks, upper, strict=True):
        block.node.mass += len(block.text) if high else 0
        block.node.text = True
    for node in reversed(nodes[1:]):
        node.article |= node.text and node.tag in ("article", "main")
        node.parent.mass += node.mass
        node.parent.text |= node.text
        node.parent.article |= node.article
    free = False  # whether an article stands where nothing claims to be beside it
    for node in nodes[1:]:
        node.aside = node.parent.aside or node.claim != _OPEN
        free |= node.article and node.tag in ("article", "main") and not node.aside
    for node in nodes[1:]:
        wrapper = node.claim == _NAMED and 0 < node.mass >= _MOST * nodes[0].mass and (node.article or not free)
        node.aside = node.parent.aside or not (node.claim == _OPEN or wrapper)


def _menus(blocks: list[_Block], upper: list[bool]) -> set[int]:
    """Runs of links before the first and after the last line of text."""
    text = [k for k, (b, high) in enumerate(zip(blocks, upper, strict=True)) if high and not b.linked]
    if not text:
        return set()
    gone, k = set(), 0
    while k < len(blocks):
        end = k
        while end < len(blocks) and blocks[end].linked:
            end += 1
        if (end <= text[0] or k > text[-1]) and sum(b.links for b in blocks[k:end]) >= _MENU:
            gone.update(range(k, end))
        k = max(end, k + 1)
    return gone


def _content(nodes: list[_Node], blocks: list[_Block]) -> list[_Block]:
    """The blocks of the content region."""
    ratios = smooth([b.ratio for b in blocks])
    cut = threshold(ratios)
    upper = [ratio >= cut for ratio in ratios]
    _judge(nodes, blocks, upper)
    if all(b.node.aside for b in blocks):
        for node in nodes[1:]:  # nothing else is there: only what is hidden stays away
            node.aside = node.parent.aside or node.claim == _UNSEEN_AT_ALL
    shown = [k for k, b in enumerate(blocks) if not b.node.aside]
    total = sum(len(blocks[k].text) for k in shown if upper[k])
    for tag in ("article", "main"):
        for node in nodes[1:]:
            node.region = node.parent.region or (node if node.tag == tag else None)
        inside = [blocks[k] for k in shown if blocks[k].node.region is not None]
        if inside and sum(len(blocks[k].text) for k in shown if upper[k] and blocks[k].node.region is not None) >= _MOST * total:
            return inside
    menus = _menus([blocks[k] for k in shown], [upper[k] for k in shown])
    return [blocks[k] for at, k in enumerate(shown) if at not in menus]


def extract(html: str) -> str:
    """Main text of one page, blocks joined by a line feed."""
    page = _Blocks()
    # A tag that the page's end cuts off is no text; a comment may be left open.
    cut = _TAG_BEGIN.search(html, html.rfind(">") + 1)
    page.feed(html[: cut.start()] if cut else html)
    page.close()
    page.flush()
    return "\n".join(b.text for b in _content(page.nodes, page.blocks)) if page.blocks else ""


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of each page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(h.as_py() or "") for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"]
            )

    narrow = pages.selectExpr("cast(page_id as long) as page_id", "cast(url as string) as url", "cast(html as string) as html")
    return map_arrow(narrow, run, "page_id long, url string, text string, n_chars long")
