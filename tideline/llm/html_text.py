"""Main text of web pages by consensus host paths (operator 6).

1. Each page's containers are scored by the text that lies in them outside links; the best one (or the article or main
   element around it) votes for its path: the tags from the root with their classes, digits generalised. Where it is
   one of several parts of a text in a common parent, the parent does; of the body's own parts, like ones are one text.
2. Votes are counted per host in Spark; the paths with at least `SHARE` of a host's votes win.
3. Pages are extracted again: of the host's winning paths that a page has, the best container; without one, or if it
   holds less than `WEAK` of the page's best score, the page's own best; again the parent for one of several parts.

From the container's text go menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles, hidden parts
and reader comments, told by element, role or class; nothing else is left out. Character references are decoded and
white space becomes one space.

Defined cases: quotes in a tag that never close are plain characters, there and in the rest of the page; elements nested
deeper than `DEPTH` lie beside each other; null html or a page without text gives an empty text; null or odd urls have no host and vote for no one;
repeated rows are extracted one by one; an empty table gives an empty result; further columns are ignored."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, lookup_join

SHARE = 0.1
WEAK = 0.2
#: Elements nested deeper lie beside each other, as browsers have it; the work on a page is then linear in its length.
DEPTH = 512

_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_STOP = re.compile(r"""[>"']""")
_ATTR = re.compile(r"""\b(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_PART = re.compile(r"[A-Za-z]+")
_RAW = {t: re.compile(rf"</{t}\b[^>]*>", re.I) for t in ("script", "style", "textarea", "title", "noscript", "template", "iframe", "noframes", "xmp")}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_CONTAINERS = frozenset("article body div main section td blockquote center".split())
_CLOSES_P = frozenset("address article aside blockquote center details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_OWN_END = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dd", ("dl",)), "dd": ("dt", ("dl",)), "tr": ("tr", ("table",)), "td": ("th", ("tr", "table")), "th": ("td", ("tr", "table")), "option": ("option", ("select",))}
_OUT_TAGS = frozenset("nav footer aside form button select option textarea input menu dialog iframe svg canvas object audio video noframes head datalist".split())
_OUT_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())
_OUT_CLASSES = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion nav navbar navigation menu menubar submenu breadcrumb breadcrumbs "
    "sidebar side aside footer masthead topbar cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup login "
    "comment comments commentlist disqus respond reply replies share sharing social related recommended widget widgets pagination pager toolbar search skip hidden".split()
)
_GOOD = ("article", "main")
#: Parts of what they lie in, whatever their classes.
_PARTS = frozenset("section blockquote center td".split())
_WORD = re.compile(r"\w")


class _Node:
    __slots__ = ("tag", "path", "parent", "box", "out", "score", "start", "end", "own", "kids", "words")

    def __init__(self, tag, path, parent, out, start):
        self.tag, self.path, self.parent, self.out, self.score, self.start, self.end = tag, path, parent, out, 0.0, start, -1
        self.box: _Node = self if parent is None or tag in _CONTAINERS else parent.box  # the container it is or lies in
        self.own = self.words = False  # text with a word outside links: not in a container within, or at all
        self.kids: list[_Node] = []

    def holder(self):
        """The container around, or the root."""
        return self.parent and self.parent.box


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(text)} if text.strip() else {}


class Page:
    """A page's containers with paths and scores, and its text in pieces; by_class: leave out parts by their classes."""

    def __init__(self, html: str, by_class: bool = True):
        self.pieces: list[str | None] = []  # None: a block begins or ends
        self.nodes: list[_Node] = []
        self.by_class = by_class
        self.paths: list[tuple[int, str]] = [(-1, "html")]  # of each path the one around it and its last part
        self.known: dict[tuple[int, str], int] = {}
        root = _Node("html", 0, None, False, 0)
        self.stack, self.links, self.opened = [root], 0, Counter()
        at, n, last, quotes = 0, len(html), html.rfind(">"), True
        while at < n:
            lt = html.find("<", at)
            if lt < 0 or lt > last:
                self._text(html[at:])
                break
            if lt > at:
                self._text(html[at:lt])
            if html.startswith("<!--", lt):
                end = html.find("-->", lt + 4)
                at = end + 3 if end >= 0 else n
                continue
            if html.startswith(("<!", "<?"), lt):
                at = html.find(">", lt) + 1
                continue
            m = _NAME.match(html, lt)
            if not m:
                self._text("<")
                at = lt + 1
                continue
            tag, p = m[1].lower(), m.end()
            end = -1
            while quotes and (stop := _STOP.search(html, p)):
                if stop[0] == ">":
                    end = stop.start()
                    break
                close = html.find(stop[0], stop.end())
                if close < 0:
                    break
                p = close + 1
            if end < 0:  # quotes that don't close mean nothing in the rest of the page
                quotes, end = False, html.find(">", m.end())
            attributes, at = html[m.end() : end], end + 1
            if html[lt + 1] == "/":
                self._close(tag)
                continue
            if tag in _RAW and not attributes.endswith("/"):
                end = _RAW[tag].search(html, at)
                at = end.end() if end else n
                continue
            self._open(tag, attributes)
        while len(self.stack) > 1:
            self._pop()
        root.end = len(self.pieces)
        root.words = root.own or any(k.words for k in root.kids)
        self.nodes.append(root)

    def _text(self, text: str) -> None:
        top = self.stack[-1]
        if top.out:
            return
        text = unescape(text) if "&" in text else text
        self.pieces.append(text)
        n = len(text) - text.count(" ")
        if self.links:
            n = -n
        near = top.box
        near.score += n
        near.own = near.own or n > 0 and _WORD.search(text) is not None
        if near.parent and n > 0:
            near.holder().score += n / 2

    def _open(self, tag: str, attributes: str) -> None:
        if tag == "html":
            return
        stack = self.stack
        if tag in _CLOSES_P:
            self._close_within("p", ("td", "th", "button", "article", "section", "div", "li", "body"))
        if tag in _OWN_END:
            other, stops = _OWN_END[tag]
            self._close_within(tag, stops)
            self._close_within(other, stops)
        if tag in _GOOD:  # an article doesn't lie in a menu that was never closed
            for i, x in enumerate(stack):
                if x.tag in ("nav", "head") or x.tag == "header" and x.out:
                    while len(stack) > i:
                        self._pop()
                    break
        if tag == "body":
            self._close_within("head", ())
        top = stack[-1]
        if tag == "br" or tag == "hr":
            if not top.out:
                self.pieces.append(None)
            return
        if tag in _VOID:
            return
        a = _attributes(attributes)
        names = [x.lower() for x in _PART.findall(a.get("class", "") + " " + a.get("id", ""))]
        out = top.out or tag in _OUT_TAGS or a.get("role", "").lower() in _OUT_ROLES or "hidden" in a or a.get("aria-hidden", "").lower() == "true" or bool(_HIDDEN.search(a.get("style", "")))
        if not out and tag == "header":
            out = not any(x.tag in _GOOD for x in stack)
        if not out and self.by_class and names and tag not in ("body", "main") and tag not in _INLINE:
            out = any(x in _OUT_CLASSES for x in names) or tag in ("div", "section") and names[0] in ("header", "footer") and not any(x.tag in _GOOD for x in stack)
        if attributes.endswith("/") and tag not in _CONTAINERS and tag not in _INLINE and tag != "p":
            return
        if len(stack) >= DEPTH:
            self._pop()
            top = stack[-1]
        if tag not in _INLINE and not top.out:
            self.pieces.append(None)
        path = top.path
        if tag in _CONTAINERS:
            kind = ".".join([tag, *sorted({re.sub(r"\d+", "#", c.lower()).replace(">", "_") for c in a.get("class", "").split()})])
            path = self.known.setdefault((top.path, kind), len(self.paths))
            if path == len(self.paths):
                self.paths.append((top.path, kind))
        node = _Node(tag, path, top, out, len(self.pieces))
        self.links += tag == "a"
        self.opened[tag] += 1
        stack.append(node)

    def path(self, node: _Node) -> str:
        """The tags from the root to a container."""
        parts, at = [], node.path
        while at >= 0:
            at, kind = self.paths[at]
            parts.append(kind)
        return ">".join(reversed(parts))

    def number(self, path: str) -> int:
        """A path's number on this page, -1 if it isn't there."""
        at = 0
        for kind in path.split(">")[1:]:
            at = self.known.get((at, kind), -1)
        return at

    def _pop(self) -> None:
        node = self.stack.pop()
        self.opened[node.tag] -= 1
        node.end = len(self.pieces)
        self.links -= node.tag == "a"
        if node.tag not in _INLINE and not node.parent.out:
            self.pieces.append(None)
        if node.tag in _CONTAINERS and not node.out:
            self.nodes.append(node)
            node.words = node.own or any(k.words for k in node.kids)
            node.holder().kids.append(node)

    def _close_within(self, tag: str, stops: tuple[str, ...]) -> None:
        for i in range(len(self.stack) - 1, 0, -1) if self.opened[tag] else ():
            if self.stack[i].tag == tag:
                while len(self.stack) > i:
                    self._pop()
                return
            if self.stack[i].tag in stops:
                return

    def _close(self, tag: str) -> None:
        if tag not in ("html", "body"):
            self._close_within(tag, ("body",) if tag != "body" else ())

    def best(self, paths: list[str] | None = None) -> _Node | None:
        """The best container, or the best of those with one of the paths."""
        wanted = None if paths is None else {self.number(p) for p in paths}
        some = [n for n in self.nodes if n.tag != "html" and n.score > 0 and (wanted is None or n.path in wanted)]
        top = max(some, key=lambda n: (n.score * (1.5 if n.tag in _GOOD else 1), -n.start), default=None)
        around = top
        while paths is None and around is not None:
            if around.tag in _GOOD:
                return around
            around = around.parent
        return top

    def whole(self, node: _Node | None) -> _Node | None:
        """The container that holds all parts of a text of which node is one: what lies beside it in a common parent,
        but directly in the body only like containers and bare text. Article and main are joined by like ones only."""
        top = at = node
        while at is not None and (up := at.holder()) is not None:
            more = [k for k in up.kids if k is not at and k.words]
            like = any(k.path == at.path or at.tag in _PARTS and k.tag in _PARTS for k in more)
            if like or at.tag not in _GOOD and (up.own or more and up.tag not in ("body", "html")):
                top = up
            elif more or up.own:
                break
            at = up
        return top

    def text(self, node: _Node | None) -> str:
        pieces = self.pieces if node is None else self.pieces[node.start : node.end]
        return " ".join("".join(" " if x is None else x for x in pieces).split())


def vote(html: str | None) -> str | None:
    page = Page(html or "")
    node = page.whole(page.best())
    return page.path(node) if node else None


def extract(html: str | None, paths: list[str] | None) -> str:
    page = Page(html or "")
    own = page.whole(page.best())
    if own is None:  # all that there is was left out, or there is no container
        text = page.text(None)
        return text or Page(html or "", by_class=False).text(None)
    chosen = page.whole(page.best(paths)) if paths else None
    if chosen is not None and chosen is not own:
        total = sum(len(x) for x in page.pieces[own.start : own.end] if x)
        if sum(len(x) for x in page.pieces[chosen.start : chosen.end] if x) >= WEAK * total:
            return page.text(chosen)
    return page.text(own)


def host_of(url):
    host = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1)
    return F.when(host != "", host)


def host_paths(pages: DataFrame, share: float = SHARE) -> DataFrame:
    """(host, paths): each host's winning paths. pages: host, html. Votes are pre-aggregated, so a host of a third of
    the pages is a few rows for each task."""

    def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("host"), pa.array([vote(h) for h in b.column("html").to_pylist()], pa.string())], ["host", "path"])

    v = pages.where("host is not null").select("host", "html").mapInArrow(votes, "host string, path string").where("path is not null")
    v = v.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"))
    most = v.groupBy("host").agg(F.sum("n").alias("all"))
    won = v.join(most, "host").where(F.col("n") >= F.lit(share) * F.col("all"))
    return won.groupBy("host").agg(F.sort_array(F.collect_list("path")).alias("paths"))  # 1 / share paths at most


def main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text) of every page."""

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [extract(h, p) for h, p in zip(b.column("html").to_pylist(), b.column("paths").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(found, pa.string())], ["page_id", "url", "text"])

    p = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), host_of(F.col(url)).alias("host"), F.col(html).alias("html"))
    paths = Scratch(pages.sparkSession).table(host_paths(p), "host_paths")
    more = paths.select(F.sum(F.octet_length(F.array_join("paths", ""))).alias("n")).first()[0] or 0
    return lookup_join(p, paths, "host", F.col("page_id"), more).select("page_id", "url", "html", "paths").mapInArrow(texts, "page_id long, url string, text string")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return t.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
