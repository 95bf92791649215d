"""Main text of web pages by site style trees.

The pages of a host are merged into one tree whose nodes are paths of tags and classes; paragraphs, headings and the like
are content of the container that they are in. A node is important if its content or its layout differs from page to
page: with m pages, a content that n of them have counts ln n / ln m, and a node's content importance is one minus the
mean over its distinct contents; its layout importance is the entropy, to base m, of the distinct sequences of child
tags. Both are weighed by GAMMA ** (number of layouts). Few pages tell little, so the outcome is drawn towards 1 as if
DOUBT more pages had spoken for the node. Text under nodes whose importance, times a weight, is below THRESHOLD is
removed from each page; inside `article` and `main` below MAIN_THRESHOLD.

The weight is what markup says beforehand: NAMED for navigation, footers, asides, headers outside of articles, forms, and
for elements that a whole class or id, or a role, names as menu, advert, notice, sidebar or comments; 1 for all others.
NAMED is below both thresholds, so the tree need not be asked about such text. But names have no say where they can't be
right: if no text of `article` or `main` lies outside of named elements, those that hold such text, or if none does those
that hold more than half of the page's text, count as any other. What is never shown, and the labels of buttons and the
like, are no text at all.

If nothing would be left of the text inside `article` and `main` (of a page without such, of the text under no name), it
all stays. Pages of a host that are equal byte by byte count once.

A page is parsed in time proportional to its length. All sums are grouped by host and node, so a host with a third of all
pages is no single group. Only the nodes that go meet the pages again.

Defined cases: a null or empty page has no text; a page without a host in its url takes part in no tree; markup
without end is closed at the end of the page; repeated rows give repeated results; extra columns are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html import unescape
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickbars.llm.tools import map_batches, stored

GAMMA = 0.9
THRESHOLD = 0.4
# Inside `article` and `main`.
MAIN_THRESHOLD = 0.2
DOUBT = 2.0
# Below both thresholds: what is named goes, unless the name has no say.
NAMED = 0.15

# Elements that start and end a block of text.
_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer"
    " form h1 h2 h3 h4 h5 h6 header hgroup html legend li main menu nav ol optgroup option p pre search section summary table"
    " tbody td tfoot th thead tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp noembed noframes iframe noscript template svg math".split())
_NAMED_TAGS = frozenset("nav footer aside form dialog menu search".split())
_CONTROLS = frozenset("button select object canvas audio video head".split())
# Content of the container that they are in.
_PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre hgroup address figcaption".split())
# Start tags that close an open element of these names.
_CLOSES = {
    "li": ("li",),
    "dt": ("dt", "dd"),
    "dd": ("dt", "dd"),
    "tr": ("tr", "td", "th"),
    "td": ("td", "th"),
    "th": ("td", "th"),
    "option": ("option",),
    "optgroup": ("option", "optgroup"),
    "body": ("head",),
}
# An end tag or an implied end does not reach beyond these.
_SCOPES = frozenset("html body table td th ul ol dl article main section nav aside footer header div button object".split())
_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner sidebar menu nav navbar"
    " navigation breadcrumb breadcrumbs footer masthead cookie cookies consent gdpr notice notices alert popup modal overlay"
    " newsletter subscribe subscription social share sharing related recommended recommendations login signup pagination pager"
    " toolbar widget skip copyright disclaimer comment comments disqus disqus_thread reply replies respond commentlist".split()
)
# Class words that may stand before or behind a name in a whole class: site-footer, ad-box, cookie-notice.
_BEFORE = frozenset("site page main top bottom left right global primary secondary post entry cookie skip social comment".split())
_BEHIND = frozenset("container wrapper box bar block area section list inner banner notice links link list form menu thread".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())

_ATTRIBUTES = r"""[^>"']*+(?:"[^"]*+"[^>"']*+|'[^']*+'[^>"']*+)*+"""
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)(?:({_ATTRIBUTES})>|([^>]*+)(?:>|\Z))|([^<]++|<)", re.S
)
_ATTRIBUTE = re.compile(r"""(?:^|[\s"'/])([a-zA-Z-]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_SPLIT = re.compile(r"[-_]+")


class Block(NamedTuple):
    """A run of text: its node, the weight that markup gives it, and whether it is inside `article` or `main`."""

    node: int
    weight: float
    main: bool
    text: str


class _Name:
    """A named element: the one above it, how much text it holds, and whether it or one above has a say."""

    __slots__ = ("above", "chars", "main_chars", "says")

    def __init__(self, above: _Name | None):
        self.above, self.chars, self.main_chars, self.says = above, 0, 0, True


class _Open(NamedTuple):
    tag: str
    node: int
    block: bool
    main: bool
    name: _Name | None
    drop: bool
    children: list[str]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, value in _ATTRIBUTE.findall(text):
        out.setdefault(name.lower(), unescape(value.strip("\"'")).lower())
    return out


def _is_name(token: str) -> bool:
    """Whether a whole class or id names what it belongs to as something else than content."""
    if token in _NAMES:
        return True
    parts = _SPLIT.split(token)
    return len(parts) == 2 and (
        (parts[0] in _BEFORE and parts[1] in _NAMES) or (parts[0] in _NAMES and parts[1] in _BEHIND)
    )


def _says(tag: str, attributes: dict[str, str], main: bool) -> tuple[bool, bool, bool]:
    """Of an element: whether it is never text, whether it is named, and whether it begins the main text."""
    role = attributes.get("role")
    begins = tag in ("article", "main") or role in ("main", "article")
    if not attributes:
        return tag in _CONTROLS, tag in _NAMED_TAGS or (tag == "header" and not main), begins
    hidden = "hidden" in attributes or attributes.get("aria-hidden") == "true" or "display:none" in attributes.get("style", "").replace(" ", "")
    tokens = attributes.get("class", "").split() + attributes.get("id", "").split()
    named = tag in _NAMED_TAGS or (tag == "header" and not main) or role in _ROLES
    if not named and not begins and tag not in ("html", "body"):
        named = any(_is_name(t) or (t == "header" and not main) for t in tokens)
    return hidden or tag in _CONTROLS, named, begins


class _Page:
    """Blocks and layouts of a page, one tag after the other, each in constant time but for what it closes."""

    def __init__(self) -> None:
        self.found: list[tuple[int, _Name | None, bool, str]] = []
        self.layouts: dict[int, set[str]] = {}
        self.stack = [_Open("", 0, True, False, None, False, [])]
        # Places on the stack: of the open elements of each tag, of those that end tags don't reach beyond, of blocks.
        self.open: dict[str, list[int]] = {}
        self.scopes: list[int] = [0]
        self.blocks: list[int] = [0]
        self.text: list[str] = []
        self.held: list[list[str]] = []
        self.names: list[_Name] = []  # those above first

    def flush(self) -> None:
        if self.text:
            joined = " ".join("".join(self.text).split())
            self.text.clear()
            if joined:
                at = self.stack[self.blocks[-1]]
                if not (at.drop or self.stack[-1].drop):
                    self.found.append((at.node, at.name, at.main, joined))
                    if at.name is not None:
                        at.name.chars += len(joined)
                        at.name.main_chars += len(joined) * at.main

    def push(self, element: _Open) -> None:
        place = len(self.stack)
        self.open.setdefault(element.tag, []).append(place)
        if element.tag in _SCOPES:
            self.scopes.append(place)
        if element.block:
            self.blocks.append(place)
        self.stack.append(element)

    def pop(self) -> None:
        top = self.stack[-1]
        if top.block:
            self.flush()
            self.blocks.pop()
            if top.children:
                self.layouts.setdefault(top.node, set()).add(",".join(top.children))
        elif top.drop and not self.stack[-2].drop:  # an inline element that is no text
            self.text[:] = self.held.pop()
        self.stack.pop()
        self.open[top.tag].pop()
        if self.scopes[-1] == len(self.stack):
            self.scopes.pop()

    def close(self, tag: str) -> None:
        """An end tag."""
        places = self.open.get(tag)
        if places and (tag in _SCOPES or places[-1] >= self.scopes[-1]):
            while len(self.stack) > places[-1] + 1:
                self.pop()
            self.pop()

    def make_room(self, tag: str) -> None:
        """Closes what the start of a block ends: an open paragraph, and elements such as the item before."""
        closed = _CLOSES.get(tag, ())
        while True:
            place = max((self.open[t][-1] for t in (*closed, "p") if self.open.get(t)), default=0)
            if not place or place < self.scopes[-1]:
                return
            while len(self.stack) > place:
                self.pop()
            if self.stack[-1].tag not in closed:
                return

    def start(self, tag: str, attributes: dict[str, str]) -> None:
        block = tag in _BLOCKS or tag in _NAMED_TAGS or tag == "head"
        if block:
            self.make_room(tag)
            self.flush()
        top = self.stack[-1]
        drop, named, begins = _says(tag, attributes, top.main)
        if not block:
            # Inline elements matter only if they are no text, and within such.
            if drop or named or top.drop:
                if not top.drop:
                    self.held.append(list(self.text))
                    self.text.clear()
                self.push(_Open(tag, 0, False, top.main, top.name, True, []))
            return
        parent = self.stack[self.blocks[-1]]
        name = parent.name
        if named:
            name = _Name(parent.name)
            self.names.append(name)
        # A comment section inside an article is no main text any more; an article in a named element is.
        main = begins or (parent.main and not named)
        node, children = parent.node, []
        if tag in _PROSE and not named:
            children = parent.children
        else:
            if not parent.children or parent.children[-1] != tag:
                parent.children.append(tag)
            kind = f"{tag}.{re.sub(r'[0-9]+', '', attributes['class'])}" if "class" in attributes else tag
            node = _signed(xxhash.xxh64_intdigest(kind, parent.node & 0xFFFFFFFFFFFFFFFF))
        self.push(_Open(tag, node, True, main, name, drop or top.drop, children))

    def end(self) -> list[Block]:
        while len(self.stack) > 1:
            self.pop()
        self.flush()
        self._silence()
        return [Block(node, NAMED if name and name.says else 1.0, main, text) for node, name, main, text in self.found]

    def _silence(self) -> None:
        """Takes the say from names that can't be right, and gives it to what is below the others."""
        for name in reversed(self.names):
            if name.above is not None:
                name.above.chars += name.chars
                name.above.main_chars += name.main_chars
        if not any(main and name is None for _, name, main, _ in self.found):
            total = sum(len(text) for _, _, _, text in self.found)
            any_main = any(main for _, _, main, _ in self.found)
            for name in self.names:
                name.says = not (name.main_chars if any_main else 2 * name.chars > total)
        for name in self.names:
            name.says = name.says or (name.above is not None and name.above.says)


def parse(html: str) -> tuple[list[Block], dict[int, set[str]]]:
    """The blocks of a page in order, and the layouts of its nodes: distinct sequences of child tags."""
    page = _Page()
    pos, n = 0, len(html)
    while pos < n:
        m = _TOKEN.match(html, pos)
        pos = m.end()
        if m[5] is not None:
            page.text.append(unescape(m[5]) if "&" in m[5] else m[5])
            continue
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "br":
                page.text.append(" ")
            page.close(tag)
            continue
        given = m[3] if m[3] is not None else m[4] or ""
        if tag in _VOID:
            if tag == "hr":
                page.flush()
            elif tag == "br":
                page.text.append(" ")
            continue
        if tag in _RAW:
            if given.endswith("/") and tag in ("svg", "math"):
                continue
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(html, pos)
            pos = end.end() if end else n
            continue
        page.start(tag, _attributes(given) if given.strip(" /\t\n") else {})
    return page.end(), page.layouts


def host_of(url: str) -> Column:
    """Host of a url in lower case, without user and port; empty if there is none."""
    known = F.lower(F.coalesce(F.col(url), F.lit("")))
    return F.regexp_extract(known, r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)


def _observed(pages: DataFrame) -> DataFrame:
    """Per page and node the hashes of its contents and layouts, of nodes whose text no name has ruled out."""

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[tuple] = []
        for host, html in zip(batch.column(0).to_pylist(), batch.column(1)):
            source = html.as_py() or ""
            page = _signed(xxhash.xxh3_64_intdigest(source))
            blocks, layouts = parse(source)
            asked = [b for b in blocks if b.weight == 1]
            rows = {(b.node, b.main, "c", _signed(xxhash.xxh3_64_intdigest(b.text))) for b in asked}
            for node in {b.node for b in asked}:
                rows |= {(node, False, "l", _signed(xxhash.xxh3_64_intdigest(x))) for x in layouts.get(node, ())}
            out += [(host, *row, page) for row in rows]
        names = ["host", "node", "main", "kind", "feature", "page"]
        columns = list(zip(*out)) if out else [[] for _ in names]
        types = [pa.string(), pa.int64(), pa.bool_(), pa.string(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    known = pages.where("host <> ''").select("host", "html")
    return map_batches(known, make, "host string, node bigint, main boolean, kind string, feature bigint, page bigint")


def importance(pages: DataFrame) -> DataFrame:
    """Nodes of the style tree of each host, from rows (host, html): pages that have it, whether it is inside `main` or
    `article`, content and layout importance, and both, drawn towards 1."""
    seen = stored(_observed(pages).distinct(), "style-nodes")
    node = ["host", "node"]
    size = seen.select(*node, "page").distinct().groupBy(*node).agg(F.count("*").alias("pages"))
    counts = seen.groupBy(*node, "kind", "feature").agg(F.count("*").alias("n"), F.max("main").alias("main"))
    content = F.col("kind") == "c"
    ln = F.log(F.col("n").cast("double"))
    sums = counts.groupBy(*node).agg(
        F.sum(F.when(content, ln)).alias("content_ln"),
        F.count(F.when(content, 1)).alias("contents"),
        F.sum(F.when(~content, F.col("n") * ln)).alias("layout_nln"),
        F.sum(F.when(~content, F.col("n"))).alias("layout_n"),
        F.count(F.when(~content, 1)).alias("layouts"),
        F.max("main").alias("main"),
    )
    m = F.log(F.col("pages").cast("double"))
    joined = sums.join(size, node)
    by_content = F.when((F.col("pages") > 1) & (F.col("contents") > 0), 1 - F.col("content_ln") / (F.col("contents") * m)).otherwise(1.0)
    spread = F.log(F.col("layout_n").cast("double")) - F.col("layout_nln") / F.col("layout_n")
    by_layout = F.when((F.col("pages") > 1) & (F.col("layouts") > 0), F.least(spread / m, F.lit(1.0))).otherwise(1.0)
    weight = F.pow(F.lit(GAMMA), F.col("layouts"))
    both = (1 - weight) * F.col("by_layout") + weight * F.col("by_content")
    shown = joined.select(*node, "pages", "main", "layouts", by_content.alias("by_content"), by_layout.alias("by_layout"))
    drawn = (F.col("pages") * both + DOUBT) / (F.col("pages") + DOUBT)
    return shown.select(*node, "pages", "main", "by_content", "by_layout", drawn.alias("importance"))


def low_nodes(pages: DataFrame) -> DataFrame:
    """The nodes of `importance` whose text goes."""
    limit = F.when(F.col("main"), MAIN_THRESHOLD).otherwise(THRESHOLD)
    return importance(pages).where(F.col("importance") < limit)


def main_text(html: str, low: set[int]) -> str:
    """The blocks of a page that stay, `low` being the nodes of its host that go."""
    blocks = [b for b in parse(html)[0] if b.weight == 1]
    judged = [b for b in blocks if b.main] or blocks
    spared = not any(b.node not in low for b in judged)
    return "\n".join(b.text for b in blocks if b.node not in low or (spared and (b.main or judged is blocks)))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The id, the url and `text`, the main text of each page: its blocks joined by line feeds."""
    plain = pages.select(
        F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html")
    ).withColumn("host", host_of("url"))
    low = stored(low_nodes(plain).groupBy("host").agg(F.collect_list("node").alias("low")), "low-nodes")
    with_low = plain.join(low, "host", "left").select("id", "url", "html", "low")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [main_text(html.as_py() or "", set(low.as_py() or ())) for html, low in zip(batch.column(2), batch.column(3))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], names=["id", "url", "text"])

    made = with_low.mapInArrow(run, f"id {pages.schema[id_col].dataType.simpleString()}, url string, text string")
    return made.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text")


def page_report(pages: DataFrame) -> DataFrame:
    """The text of every page and its length in code points."""
    return extract(pages).select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


def entropy_importance(counts: list[int], pages: int) -> float:
    """Content importance of a node by the formula, for checks by hand."""
    return 1 - sum(math.log(n) for n in counts) / (len(counts) * math.log(pages)) if pages > 1 else 1.0
