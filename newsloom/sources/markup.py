"""Feeds, outlines, sitemaps and pages as rows. Parsing runs in Arrow batches where the data lie; nothing is fetched.

Unreadable documents give no rows, or one row with ``error`` where the reader asks for it.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator, Sequence
from html.parser import HTMLParser
from itertools import islice
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FEED_SCHEMA = "feed_title string, title string, link string, summary string, published string"


def _name(e: ET.Element) -> str:
    return e.tag.rsplit("}", 1)[-1].lower() if isinstance(e.tag, str) else ""


def _words(e: ET.Element | None) -> str:
    return " ".join("".join(e.itertext()).split()) if e is not None else ""


def _child(e: ET.Element, *names: str) -> ET.Element | None:
    return next((c for n in names for c in e if _name(c) == n), None)


def parse_feed(xml: str, default_title: str = "") -> list[tuple]:
    """Items of an RSS, RDF or Atom document that have a title or a link."""
    root = ET.fromstring(xml.strip())
    if _name(root) not in ("rss", "rdf", "feed"):
        raise ValueError("neither RSS nor Atom")
    channel = root if _name(root) == "feed" else _child(root, "channel")
    feed_title = _words(_child(channel, "title")) if channel is not None else ""
    rows = []
    for e in root.iter():
        if _name(e) not in ("item", "entry"):
            continue
        links = [c for c in e if _name(c) == "link"]
        hrefs = sorted((c for c in links if c.get("href")), key=lambda c: c.get("rel", "alternate") != "alternate")
        best = hrefs[0] if hrefs else None
        link = best.get("href").strip() if best is not None else _words(links[0]) if links else ""
        title = _words(_child(e, "title"))
        if title or link:
            rows.append((feed_title or default_title, title or "(no title)", link, _words(_child(e, "summary", "description", "content", "encoded")), _words(_child(e, "published", "pubdate", "updated", "date")) or None))
    return rows


def parse_outline(xml: str) -> list[tuple]:
    """``title, url`` of the feeds of an OPML list at any depth."""
    out = []
    for e in ET.fromstring(xml.strip()).iter():
        if _name(e) == "outline" and (e.get("xmlUrl") or "").strip():
            url = e.get("xmlUrl").strip()
            out.append((e.get("title") or e.get("text") or url, url))
    return out


def parse_sitemap(xml: str) -> list[tuple]:
    """``kind, url``: child sitemaps and pages with a web address."""
    root = ET.fromstring(xml.strip())
    kind = "sitemap" if _name(root) == "sitemapindex" else "page"
    urls = [_words(e) for e in root.iter() if _name(e) == "loc"]
    return [(kind, u) for u in urls if u.lower().startswith(("http://", "https://")) and len(u.split("/", 3)) > 2 and u.split("/", 3)[2]]


VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Elements that are closed by the next of their kind.
CLOSES = {"p": ("p",), "li": ("li",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}


class Node:
    """An element of a page: its children are nodes and texts, in order."""

    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []

    def walk(self) -> Iterator[Node]:
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack += [c for c in reversed(node.children) if isinstance(c, Node)]

    def texts(self, without: frozenset[str] = frozenset()) -> Iterator[str]:
        stack: list = [self]
        while stack:
            node = stack.pop()
            if isinstance(node, str):
                yield node
            elif node.tag not in without and not node.attrs.get("_cut"):
                stack += reversed(node.children)

    def text(self, sep: str = "", without: frozenset[str] = frozenset()) -> str:
        return " ".join(sep.join(self.texts(without)).split())

    def is_(self, mark: str) -> bool:
        """``tag``, ``.class``, ``#id``, ``[name=value]`` or ``[name]``."""
        if mark[0] == ".":
            return mark[1:] in self.attrs.get("class", "").split()
        if mark[0] == "#":
            return self.attrs.get("id") == mark[1:]
        if mark[0] == "[":
            name, _, value = mark[1:-1].partition("=")
            return name in self.attrs and (not value or self.attrs[name] == value)
        return self.tag == mark


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("", {})
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in ("table", "ul", "ol") and tag not in ("table",):
                break
            if self.open[i].tag in CLOSES.get(tag, ()):
                del self.open[i:]
                break
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.open[-1].children.append(Node(tag, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                break

    def handle_data(self, data):
        self.open[-1].children.append(data)


def parse_page(html: str) -> Node:
    p = _Builder()
    p.feed(html)
    p.close()
    return p.root


def parse_anchors(html: str, text_nodes: bool = False) -> list[tuple]:
    """``text, href`` of each link, or of each text inside one."""
    out = []
    for node in parse_page(html).walk():
        if node.tag == "a" and node.attrs.get("href"):
            href = node.attrs["href"].strip()
            out += [(" ".join(t.split()), href) for t in node.texts() if t.strip()] if text_nodes else [(node.text(), href)]
    return out


NOT_TEXT = frozenset("script style noscript nav footer aside form".split())
#: Where pages keep their article; the longest of those that are there is taken.
CONTAINERS = ("article", "[itemprop=articleBody]", ".entry-content", ".post-content", ".wp-block-post-content", ".article-content", "main", "body")
COMMENTS = ("#comments", ".comments", ".comments-area", ".comment-list")
CORRECTIONS = (".correction", ".corrections", ".editors-note")
_CORRECTION = re.compile(r"(?i)(correction|clarification|editor.s note|update)\s*[:\u2014\u2013-]")


def correction_notes(page: Node, least: int = 20) -> list[str]:
    """What a page says about its own mistakes: marked sections, and paragraphs that begin or speak like one; each once."""
    told = [n.text(" ") for n in page.walk() if any(n.is_(m) for m in CORRECTIONS)]
    for box in page.walk():
        if any(box.is_(m) for m in ("article", "main", ".entry-content", ".post-content")):
            told += [t for n in box.walk() if n.tag == "p" and (t := n.text(" ")) and (_CORRECTION.match(t) or "was corrected" in t.lower())]
    return list({t.lower(): t for t in reversed(told) if len(t) >= least}.values())[::-1]


def parse_article(html: str, address: str = "") -> list[tuple]:
    """``title, text, url, published, author, corrections``.

    The text is that of the longest container without navigation, forms and comments; correction notes that
    it doesn't hold are put at its end. The address is the page's canonical one where it states one.
    """
    page = parse_page(html)
    meta: dict[str, str] = {}
    title = canonical = ""
    for n in page.walk():
        if n.tag == "meta" and (key := (n.attrs.get("property") or n.attrs.get("name") or "").lower()):
            meta.setdefault(key, n.attrs.get("content", "").strip())
        elif n.tag == "title" and not title:
            title = n.text()
        elif n.tag == "link" and "canonical" in n.attrs.get("rel", "").lower().split() and n.attrs.get("href") and not canonical:
            canonical = urljoin(address, n.attrs["href"].strip())
        if n.tag in NOT_TEXT or any(n.is_(m) for m in COMMENTS):
            n.attrs["_cut"] = "1"
    boxes = [n for m in CONTAINERS for n in islice((x for x in page.walk() if x.is_(m)), 1)] or [page]
    text = max((b.text(" ", frozenset(("title", "head"))) for b in boxes), key=len)
    notes = correction_notes(page)
    missing = [n for n in notes if n.lower() not in text.lower()]
    if missing:
        text = f"{text}\n\nCorrection notes: {' '.join(missing)}".strip()
    url = canonical or address
    return [(meta.get("og:title") or title or url, text, url, meta.get("article:published_time") or None, meta.get("author") or None, notes)]


def parse_table(html: str, mark: str = "", base: str = "", detail: Sequence[str] = (), pdf: Sequence[str] = ("pdf",)) -> list[tuple]:
    """``row_no, cells``: the rows of a table (whose id or class holds ``mark``) as maps by its first header row.

    Cells beyond the header are ``Column n``; the link in a cell under one of the ``detail`` or ``pdf`` names is
    ``Detail URL`` or ``PDF URL``, made absolute. A table without header takes its first row for one.
    """
    tables = [t for t in parse_page(html).walk() if t.tag == "table" and mark in t.attrs.get("id", "") + " " + t.attrs.get("class", "")]
    rows, head = [], None
    for r in (r for t in tables for r in t.walk() if r.tag == "tr"):
        cells = [c for c in r.children if isinstance(c, Node) and c.tag in ("td", "th")]
        if cells and head is None:
            head = [c.text(" ") for c in cells]
        elif any(c.tag == "td" for c in cells):
            rows.append(cells)
    out = []
    for i, cells in enumerate(rows):
        row = {}
        for j, c in enumerate(cells):
            name = head[j] if j < len(head) and head[j] else f"Column {j + 1}"
            row[name] = c.text(" ")
            link = next((a.attrs["href"].strip() for a in c.walk() if a.tag == "a" and a.attrs.get("href")), None)
            for kind, names in (("Detail URL", detail), ("PDF URL", pdf)):
                if link and name.lower() in names:
                    row[kind] = urljoin(base, link)
        out.append((i, row))
    return out


PARSERS: dict[str, tuple[Callable, str, list[str]]] = {
    "feed": (parse_feed, FEED_SCHEMA, ["feed_title", "title", "link", "summary", "published"]),
    "outline": (parse_outline, "title string, url string", ["title", "url"]),
    "sitemap": (parse_sitemap, "kind string, url string", ["kind", "url"]),
    "anchors": (parse_anchors, "text string, href string", ["text", "href"]),
    "article": (parse_article, "title string, text string, url string, published string, author string, corrections array<string>", ["title", "text", "url", "published", "author", "corrections"]),
    "table": (parse_table, "row_no int, cells map<string,string>", ["row_no", "cells"]),
}


def parse_documents(df: DataFrame, id_col: str, text_col: str, parser: str, errors: bool = False, **options) -> DataFrame:
    """``id, pos, ...`` rows that a parser finds in each document.

    Unreadable documents give none, or with ``errors`` one row that says why in ``error``.
    """
    parse, schema, names = PARSERS[parser]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i, text in zip(pdf.iloc[:, 0], pdf.iloc[:, 1]):
                try:
                    rows += [(i, pos, *r, *[None] * errors) for pos, r in enumerate(parse(text, **options))]
                except (ET.ParseError, ValueError, AssertionError) as e:
                    rows += [(i, None, *[None] * len(names), str(e) or type(e).__name__)] * errors
            if rows:
                made = pd.DataFrame(rows, columns=[id_col, "pos", *names, *["error"] * errors])
                yield made.assign(pos=made["pos"].astype("Int32"))

    kind = dict(df.dtypes)[id_col]
    return df.where(F.col(text_col).isNotNull()).select(id_col, text_col).mapInPandas(run, f"{id_col} {kind}, pos int, {schema}" + ", error string" * errors)


def feed_list(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``url, title``: the feeds of several outline files, each address once, as its first file and place have it."""
    rows = parse_documents(documents, id_col, text_col, "outline")
    return rows.groupBy("url").agg(F.min_by("title", F.struct(id_col, "pos")).alias("title"))


def walk(edges: DataFrame, roots: DataFrame, depth: int | None = None, most: int | None = None) -> DataFrame:
    """``url, level``: all pages reached from the roots along ``parent, child``, each at its least level.

    One join a level against the frontier only; stops when a level finds nothing new, at ``depth`` levels, or
    when at least ``most`` pages are found, of which then the nearest by level and address are kept.
    """
    from newsloom.session import staged

    spark = edges.sparkSession
    seen = frontier = staged(spark, roots.select(F.col(roots.columns[0]).alias("url"), F.lit(0).alias("level")).distinct(), "walk")
    level = 0
    while depth is None or level < depth:
        level += 1
        step = edges.join(frontier, edges["parent"] == frontier["url"]).select(F.col("child").alias("url")).distinct().join(seen.select("url"), "url", "left_anti")
        frontier = staged(spark, step.withColumn("level", F.lit(level)), "walk")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
        if most is not None and seen.count() >= most:
            break
    return seen if most is None else seen.orderBy("level", "url").limit(most)
