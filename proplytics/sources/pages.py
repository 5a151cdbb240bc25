"""Landed HTML pages as rows of raw material: pairs, candidate texts, links, images, scripts.

Python only reads the markup here (inside ``mapInArrow``: plain markup is split at its tags, the rest is left to
the standard-library parser); every decision about the material is a column expression in ``proplytics.operators.extract``.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache
from html import unescape
from html.parser import HTMLParser
from operator import attrgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

RAW = (
    "page_id bigint, source string, page_url string, kind string, card_no int, link string, titles array<string>, "
    "prices array<string>, addresses array<string>, pairs map<string,string>, cells array<string>, blocks array<string>, "
    "text string, images array<struct<src: string, width: string>>, scripts array<string>, ld array<string>, "
    "frames array<string>, styles array<string>, point array<string>, pdfs array<struct<url: string, label: string>>, "
    "links array<struct<href: string, text: string, rel: string, pager: boolean>>, inputs array<string>"
)

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "p": {"p"}}
SILENT = {"script", "style", "template"}
#: elements whose content may be no markup; plain pages have no tag in them
RAW_TEXT = {"script", "style", "title", "textarea", "iframe", "noembed", "noframes", "noscript", "xmp"}
#: pages whose material is held at a time
CHUNK = 256
KEYS = ("page_id", "source", "page_url", "kind", "card_no")
#: fields of a detail page that single elements tell, wherever they stand
FLAT = {"images", "scripts", "ld", "frames", "styles", "point", "inputs"}

# Where each portal keeps what, most specific selector first.
# cards: search result blocks; parents: enclosing tags of a detail link when no card matches.
SPECS: dict[str, dict[str, list[str]]] = {
    "suumo": {
        "cards": [".property_unit", ".cassetteitem", ".dottable-line", "[class*=cassette]"],
        "detail_links": ["a[href*=/chukoikkodate/]"],
        "parents": ["div", "li", "tr", "article"],
        "link": ["a[href*=/chukoikkodate/]", "a[href*=/kodate/]", "a[href]"],
        "title": ["h2", ".property_unit-title", ".cassetteitem_content-title", "a"],
        "price": [".dottable-value", ".detailnote-price", "[class*=price]", ".cassetteitem_price"],
        "address": [".dottable-vm", "[class*=address]", "[class*=area]", ".cassetteitem_detail-col1"],
        "fallback": ["td", "dd", ".detailnote-value", "span"],
        "page_title": ["h1", ".section_h1", "[class*=heading]"],
        "pager": [".pagination_set .pagination_set-num"],
        "images": ["img[src*=img.suumo]", "img[data-src*=img.suumo]"],
    },
    "homes": {
        "cards": [".mod-mergeBuilding", ".mod-buildingListUnit", "[class*=building]", ".prg-building"],
        "detail_links": ["a[href*=/kodate/chu/]"],
        "parents": ["div", "li", "article", "section"],
        "link": ["a[href*=/kodate/chu/]", "a[href*=/kodate/]", "a[href]"],
        "title": ["h2", "[class*=heading]", "[class*=title]", "[class*=name]", "a"],
        "price": ["[class*=price]", "[class*=Price]", ".priceLabel", ".value"],
        "address": ["[class*=address]", "[class*=Address]", "[class*=area]", "[class*=location]"],
        "fallback": ["td", "dd", "span", "li"],
        "page_title": ["h1", "[class*=heading]", "[class*=title]"],
        "pager": ["[class*=pagination] a", ".pager a"],
        "images": ["img[src*=homes.co.jp]", "img[data-src*=homes.co.jp]"],
    },
    "athome": {
        "cards": ["[class*=property-card]", "[class*=propertyCard]", "[class*=kodate-card]", "[class*=estate-card]",
                  ".p-property-object", "[class*=object-card]", "[class*=bukken]", "article[class*=property]", "[data-property-id]"],
        "detail_links": ["a[href*=/kodate/]", "a[href*=/chuko/]", "a[href*=/home/]"],
        "parents": ["div", "li", "tr", "article", "section"],
        "link": ["a[href*=/kodate/]", "a[href*=/chuko/]", "a[href*=/home/]", "a[href]"],
        "title": ["h2", "h3", "[class*=title]", "[class*=name]", "[class*=heading]", "a"],
        "price": ["[class*=price]", "[class*=Price]", "[class*=kakaku]", ".price", ".value", "span.num"],
        "address": ["[class*=address]", "[class*=Address]", "[class*=shozaichi]", "[class*=area]", "[class*=location]"],
        "fallback": ["td", "dd", "span", "p"],
        "page_title": ["h1", "[class*=heading]", "[class*=title]", ".section_h1"],
        "pager": [".pagination li", ".paginate li", "[class*=pager] a", "[class*=pagination] a"],
        "images": ["img[src*=athome.co.jp]", "img[data-src*=athome.co.jp]", "img[src*=athome-inc]", "img[data-src*=athome-inc]"],
    },
    "akiya": {
        "cards": ["section.propety", "article.property-item", ".akiya-item", ".property-card", ".bukken-list li", ".property_unit"],
        "detail_links": ["a[href*=/bukken/detail/buy/]", "a[href*=/buy/detail/]"],
        "parents": ["section", "article", "div", "li", "tr"],
        "link": ["a[href*=/bukken/detail/buy/]", "a[href*=/buy/detail/]", ".propetyTitle a", "a.sp", "a[href]"],
        "title": [".propetyTitle a", ".propetyTitle", "h2", "h3", ".property-title", ".item-title", "[class*=title]", "a"],
        "price": ["dl.price dd", ".price", "[class*=price]", ".kakaku", "[class*=kakaku]", "span.value", ".property-price"],
        "detail_price": [".price", "[class*=price]", ".kakaku", ".price-red-strong"],
        "address": [".address", "[class*=address]", "[class*=location]", ".area", "[class*=area]"],
        "fallback": ["td", "dd", "span", "p", "div.value", "[class*=value]"],
        "page_title": ["h1", "h2", ".property-title", "[class*=heading]", "[class*=title]"],
        "pager": [".pager a[href]", ".pagination a[href]", ".page-nav a[href]", "[class*=paginat] a[href]", "ul.page-numbers a[href]"],
        "images": ["img[src*=akiya]", "img[src*=property]", "img[src*=photo]", "img[src*=image]", "img[src*=bukken]", "img[data-src]"],
    },
    "bit": {
        "cards": ["table.result-table tbody tr", "table.list-table tbody tr", "div.result-list table tr", "#result-list table tr"],
        "detail_links": ["a[href*=pt001]", "a[href*=detail]"],
        "parents": ["tr"],
        "loose_cards": ["div.property-item", "div.result-item", "div.list-item"],
        "link": ["a[href*=pt001]", "a[href*=detail]", "a[href]"],
        "title": [], "price": [], "address": [], "fallback": [],
        "page_title": ["h1", "h2", ".property-title", ".detail-title", "title"],
        "pager": ["ul.pagination li a", "div.pager a", "nav.pagination a"],
        "images": ["img"],
    },
}


class Page(list):
    """The elements of a page in document order, also by tag, by attribute and by selector."""

    __slots__ = ("_tags", "_marked", "_fitting", "marks")

    def __init__(self):
        super().__init__()
        #: the markup, where no tag has anything escaped, so that what its attributes hold stands in it
        self.marks: str | None = None
        self._tags, self._marked, self._fitting = None, None, {}

    def leave(self) -> None:
        """Take the elements apart once a page is read: they hold each other, and would wait for the garbage collector."""
        for node in self:
            node.kids = ()
        self.clear()
        self._tags, self._marked, self._fitting = None, None, {}

    def that_may_fit(self, step: tuple) -> list["Node"]:
        if self._tags is None:
            self._tags, self._marked = {}, {}
            for node in self:
                self._tags.setdefault(node.tag, []).append(node)
                for name in node.attrs:
                    self._marked.setdefault(name, []).append(node)
        # a step without a tag tests an attribute
        return self._tags.get(step[0], []) if step[0] else self._marked.get(_tested(step), [])

    def fitting(self, selector: str) -> list["Node"]:
        """All elements that fit a selector; each is looked for once a page, however many cards it has."""
        found = self._fitting.get(selector)
        if found is None:
            *outer, last = _path(selector)
            # most selectors of a portal name a class that the page has not
            marks = self.marks
            found = [] if marks is not None and any(v not in marks for v in _values(selector)) else self.that_may_fit(last)
            if found and last[1:] != (None, None, ()):
                found = _those_that_fit(found, last)
            if found and outer:
                found = [n for n in found if _is_below(n, outer)]
            self._fitting[selector] = found
        return found


_start = attrgetter("start")


class Node:
    """An element; its descendants are a slice of the page's elements in document order."""

    __slots__ = ("tag", "attrs", "kids", "up", "page", "start", "end")

    def __init__(self, tag: str, attrs: dict, up: "Node | None", page: Page):
        self.tag, self.attrs, self.kids, self.up, self.page = tag, attrs, [], up, page
        self.start = self.end = len(page)
        page.append(self)

    def within(self, nodes: list["Node"]) -> list["Node"]:
        """Those of some elements in document order that are descendants."""
        if self.up is None:
            return nodes
        low = bisect_right(nodes, self.start, key=_start)
        return nodes[low : bisect_left(nodes, self.end, low, key=_start)]

    def strings(self) -> list[str]:
        out, open_ = [], [iter(self.kids)]
        while open_:
            for kid in open_[-1]:
                if isinstance(kid, str):
                    out.append(kid)
                elif kid.tag not in SILENT:
                    open_.append(iter(kid.kids))
                    break
            else:
                open_.pop()
        return out

    def text(self, gap: str = "") -> str:
        if len(self.kids) == 1 and isinstance(self.kids[0], str):
            return self.kids[0].strip()
        return gap.join(s for s in (t.strip() for t in self.strings()) if s)


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root", {}, None, Page())

    def handle_starttag(self, tag, attrs):
        self.open(tag, {k: v or "" for k, v in attrs}, tag not in VOID)

    def open(self, tag: str, attrs: dict, enter: bool):
        while self.at.up is not None and self.at.tag in CLOSES.get(tag, ()):
            self.at = self.at.up
        node = Node(tag, attrs, self.at, self.root.page)
        self.at.kids.append(node)
        if enter:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        node = self.at
        while node is not None and node.tag != tag:
            node = node.up
        if node is not None and node.up is not None:
            self.at = node.up

    def handle_data(self, data):
        self.at.kids.append(data)


# a tag as most pages write it: quoted attributes or names alone
_TAG = re.compile(r"""([a-zA-Z][a-zA-Z0-9]*)((?:\s+[a-zA-Z][\w:-]*(?:="[^"]*"|='[^']*')?)*)\s*(/?)""", re.ASCII)
_NAMED = re.compile(r"""([a-zA-Z][\w:-]*)(?:="([^"]*)"|='([^']*)')?""", re.ASCII)
_END = re.compile(r"/([a-zA-Z][a-zA-Z0-9]*)\s*", re.ASCII)


@lru_cache(maxsize=4096)
def _tag(inner: str) -> tuple[str, str, dict] | None:
    """(start, empty, end or none, name, attributes) of what stands between < and >; None where that is not plain."""
    if found := _TAG.fullmatch(inner):
        name, attrs, empty = found.groups()
        if "&" in attrs:
            one = _Builder()
            one.feed(f"<{inner}>")
            return "empty" if empty else "start", name.lower(), one.root.page[1].attrs
        named = {k.lower(): a or b for k, a, b in _NAMED.findall(attrs)} if attrs else {}
        return "empty" if empty else "start", name.lower(), named
    if found := _END.fullmatch(inner):
        return "end", found[1].lower(), {}
    comment = inner.startswith("!-- ") and inner.endswith(" --") and len(inner) > 6 and "--" not in inner[3:-2]
    return ("none", "", {}) if comment or inner[:9].lower() == "!doctype " else None


def _plain_tree(html: str, flat: bool = False) -> Node | None:
    """The tree of a page of plain markup, as the standard parser reads it; None where only that one knows what is meant.

    A ``flat`` one is the elements in document order alone, nothing in them but what is in scripts.
    """
    builder, raw = _Builder(), None
    if "\0" in html:
        return None
    root, page = builder.root, builder.root.page
    before, *parts = html.split("<")
    escaped = False
    if before and not flat:
        builder.at.kids.append(unescape(before))
    for part in parts:
        inner, closed, text = part.partition(">")
        if raw in ("script", "style") and (inner[:1] != "/" or closed and raw not in inner.lower()):
            # no end: it belongs to the script, unless that may be a comment in it
            if inner.startswith("!--"):
                return None
            (page[-1] if flat else builder.at).kids.append("<" + part)
            continue
        tag = _tag(inner) if closed else None
        if tag is None or raw is not None and tag[:2] != ("end", raw):
            return None
        form, name, attrs = tag
        escaped = escaped or "&" in inner
        raw = None
        if form == "start":
            if flat:
                Node(name, attrs, root, page)
            else:
                builder.open(name, attrs, name not in VOID)
            if name in RAW_TEXT:
                raw = name
                if "&" in text and name not in ("script", "style", "title", "textarea"):
                    return None
        elif form == "empty":
            if flat:
                Node(name, attrs, root, page)
            else:
                builder.open(name, attrs, False)
        elif form == "end" and not flat:
            builder.handle_endtag(name)
        if not text:
            continue
        if raw in ("script", "style"):
            (page[-1] if flat else builder.at).kids.append(text)
        elif not flat:
            builder.at.kids.append(unescape(text) if "&" in text else text)
    if not escaped:
        page.marks = html
    return root if raw is None else None


_ATTRS = r"""(?:\s+[a-zA-Z][\w:-]*+(?:="[^"<>]*+"|='[^'<>]*+')?)*+"""
# text up to the next tag; in scripts a < may stand where no tag can begin
_GAP, _TEXT, _BODY = r"\s*+", r"[^<]*+", r"[^<]*+(?:<(?![/!a-zA-Z])[^<]*+)*+"


def _raw_body(name: str) -> str:
    return _BODY if name in ("script", "style") else "[^<]*+" if name in ("title", "textarea") else "[^<&]*+"


#: pages of closed plain tags, the most of all: one look at the whole page instead of one at each tag. What it lets through, ``_plain_tree`` reads the same
_SIMPLE = re.compile(
    rf"""{_TEXT}(?:<(?:/[a-zA-Z][a-zA-Z0-9]*+\s*+>|(?!(?i:{"|".join(sorted(RAW_TEXT))})\b)[a-zA-Z][a-zA-Z0-9]*+{_ATTRS}\s*+/?>"""
    rf"""|{"|".join(rf"{name}{_ATTRS}{_GAP}>{_raw_body(name)}</{name}{_GAP}>" for name in sorted(RAW_TEXT))}"""
    rf"""|!--\x20[^<>-]+\x20-->|!(?i:doctype)\x20[^<>]*+>){_TEXT})*+""", re.ASCII)
#: the elements that ``FLAT`` fields are read from, and some more
_SINGLE = re.compile(rf"""<((?i:img|script|iframe|input)\b{_ATTRS}|[a-zA-Z][a-zA-Z0-9]*+(?=[^>]*(?i:style|data-l)){_ATTRS})\s*+/?>({_BODY})""", re.ASCII)


def _single_elements(html: str) -> Node | None:
    """The root over the elements that ``FLAT`` fields are read from, as ``_plain_tree`` finds them, of a page that is ``_SIMPLE``; None of others."""
    if not _SIMPLE.fullmatch(html) or "\0" in html:
        return None
    page = Page()
    root = Node("#root", {}, None, page)
    for inner, text in _SINGLE.findall(html):
        _, name, attrs = _tag(inner)
        node = Node(name, attrs, root, page)
        if text and name == "script":
            node.kids.append(text)
    return root


def tree(html: str, flat: bool = False) -> Node:
    """The tree of a page; ``flat`` where it is enough to know the elements that ``FLAT`` fields are read from, in document order, and the scripts' text."""
    html = html or ""
    if flat and (root := _single_elements(html)) is not None:
        return root
    root = _plain_tree(html, True) if flat else _plain_tree(html)
    if root is None:
        builder = _Builder()
        builder.feed(html)
        builder.close()
        root = builder.root
    elif flat:
        return root
    for node in reversed(root.page):
        if node.end == node.start:
            node.end += 1
        if node.up is not None and node.up.end < node.end:
            node.up.end = node.end
    return root


_STEP = re.compile(r"([\w*]*)(#[\w-]+)?((?:\.[\w-]+)*)((?:\[[^\]]+\])*)$")
_ATTR = re.compile(r"\[([\w-]+)(?:(\*|\$)?=([^\]]+))?\]")


@lru_cache(maxsize=None)
def _step(text: str) -> tuple:
    """(tag, id, classes, attribute tests) of one selector step."""
    tag, ident, classes, attrs = _STEP.match(text).groups()
    return tag, ident and ident[1:], frozenset(classes[1:].split(".")) if classes else None, tuple(_ATTR.findall(attrs))


def _tested(step: tuple) -> str:
    """The attribute that every element which fits a step without a tag has."""
    return "id" if step[1] else "class" if step[2] else step[3][0][0] if step[3] else ""


def _fits(node: Node, step: tuple) -> bool:
    tag, ident, classes, attrs = step
    if tag and node.tag != tag or ident and node.attrs.get("id") != ident:
        return False
    if classes:
        have = node.attrs.get("class")
        if not have or not classes <= set(have.split()):
            return False
    for name, op, value in attrs:
        have = node.attrs.get(name)
        if have is None or (value and not (value in have if op == "*" else have.endswith(value) if op == "$" else have == value)):
            return False
    return True


@lru_cache(maxsize=None)
def _path(selector: str) -> tuple:
    return tuple(_step(part) for part in selector.split())


@lru_cache(maxsize=None)
def _values(selector: str) -> tuple:
    """What must stand in the attributes of a page for elements to fit."""
    return tuple({v for _, ident, classes, attrs in _path(selector) for v in (ident, *(classes or ()), *(a[2] for a in attrs)) if v})


def _those_that_fit(nodes: list[Node], step: tuple) -> list[Node]:
    _, ident, classes, attrs = step
    if not ident and not classes and len(attrs) == 1 and attrs[0][1] == "*":
        name, _, value = attrs[0]
        return [n for n in nodes if value in n.attrs.get(name, "")]
    return [n for n in nodes if _fits(n, step)]


def _is_below(node: Node, outer: list[tuple]) -> bool:
    """Do ancestors of a node fit the steps, the last of them nearest?"""
    above, left = node.up, len(outer)
    while above is not None and left:
        left -= _fits(above, outer[left - 1])
        above = above.up
    return not left


def select(root: Node, *selectors: str) -> list[Node]:
    """Descendants that fit any selector (steps joined by spaces), in document order."""
    found = [nodes for s in selectors if (nodes := root.page.fitting(s)) and (nodes := root.within(nodes))]
    if len(found) < 2:
        return found[0] if found else []
    some = {n.start: n for nodes in found for n in nodes}
    return [some[i] for i in sorted(some)]


def first(root: Node, selector: str) -> Node | None:
    nodes = root.page.fitting(selector)
    if not nodes or root.up is None:
        return nodes[0] if nodes else None
    at = bisect_right(nodes, root.start, key=_start)
    return nodes[at] if at < len(nodes) and nodes[at].start < root.end else None


def first_texts(root: Node, selectors: list[str]) -> list[str]:
    """Text of the first element of each selector, in selector order."""
    return [n.text() for s in selectors if (n := first(root, s)) is not None]


def pairs_of(root: Node, fallback: list[str], keep_blank: bool = False) -> dict[str, str]:
    """Label → value from table rows, then definition lists; numbered cells when there are none."""
    out: dict[str, str] = {}
    found = [(first(r, "th"), first(r, "td")) for r in select(root, "tr")]
    terms = select(root, "dt")
    values = root.page.that_may_fit(_step("dd")) if terms else []
    for dt in terms:
        at, end = bisect_left(values, dt.end, key=_start), dt.up.end
        while at < len(values) and values[at].start < end and values[at].up is not dt.up:
            at += 1
        found.append((dt, values[at] if at < len(values) and values[at].start < end else None))
    for label, value in found:
        if label is not None and value is not None:
            key, text = label.text(), value.text()
            if keep_blank or key and text:
                out[key] = text
    if not out and fallback:
        texts = [n.text() for n in select(root, *fallback)]
        out = {f"field_{i}": t for i, t in enumerate(texts) if len(t) > 1}
    return out


def _cards(root: Node, spec: dict[str, list[str]]) -> list[Node]:
    for selector in spec["cards"]:
        found = select(root, selector)
        if found:
            return found
    # vacant houses try one link form after the other, the rest all forms at once
    groups = [[s] for s in spec["detail_links"]] if spec is SPECS["akiya"] else [spec["detail_links"]]
    for group in groups:
        found, seen = [], set()
        for link in select(root, *group):
            box = link.up
            while box is not None and box.tag not in spec["parents"]:
                box = box.up
            if box is not None and id(box) not in seen:
                seen.add(id(box))
                found.append(box)
        if found:
            return found
    for selector in spec.get("loose_cards", []):
        found = select(root, selector)
        if found:
            return found
    return []


def _images(node: Node, source: str, spec: dict[str, list[str]], card: bool) -> list[dict]:
    found = select(node, "img") if card or source == "bit" else select(node, *spec["images"])
    if not card and source == "akiya" and not found:
        found = select(node, "img[src]")
    return [{"src": n.attrs.get("data-src") or n.attrs.get("src") or "", "width": n.attrs.get("width", "")} for n in found]


def _scripts(node: Node, card: bool, linked_data: bool = False) -> list[str]:
    scripts = () if card else select(node, "script")
    return ["".join(k for k in n.kids if isinstance(k, str)) for n in scripts if not linked_data or n.attrs.get("type") == "application/ld+json"]


def _point(node: Node) -> list[str]:
    for point in select(node, "[data-lat][data-lng]", "[data-latitude][data-longitude]"):
        return [point.attrs.get("data-lat") or point.attrs.get("data-latitude", ""), point.attrs.get("data-lng") or point.attrs.get("data-longitude", "")]
    return []


def _link(node: Node, spec: dict[str, list[str]]) -> str | None:
    for selector in spec["link"]:
        found = first(node, selector)
        if found is not None:
            return found.attrs.get("href", "")
    return None


def _material(node: Node, source: str, spec: dict[str, list[str]], card: bool, wanted: set[str]) -> dict:
    auction = source == "bit"
    makers = {
        "link": lambda: _link(node, spec),
        "titles": lambda: first_texts(node, spec["title"] if card else spec["page_title"]),
        "prices": lambda: first_texts(node, spec["price"] if card else spec.get("detail_price", spec["price"])),
        "addresses": lambda: first_texts(node, spec["address"]),
        "pairs": lambda: list(pairs_of(node, spec["fallback"] if card else [], keep_blank=card and source != "akiya").items()),
        "cells": lambda: [n.text() for n in select(node, "td")] if auction else [],
        "blocks": lambda: [n.text() for n in select(node, "span", "p", "div", "dd", "td")] if card and source == "akiya" else [],
        "text": lambda: node.text(" ") if auction else "".join(node.strings()),
        "images": lambda: _images(node, source, spec, card),
        "scripts": lambda: _scripts(node, card),
        "ld": lambda: _scripts(node, card, linked_data=True),
        "frames": lambda: [n.attrs.get("src", "") for n in select(node, "iframe[src*=maps.google]", "iframe[src*=google.com/maps]")],
        "styles": lambda: [n.attrs.get("style", "") for n in select(node, "[style*=background-image]")] if source == "athome" else [],
        "point": lambda: _point(node),
        "pdfs": lambda: [{"url": n.attrs["href"], "label": n.text()} for n in select(node, "a[href*=.pdf]")] if auction else [],
        "links": lambda: [] if card else _page_links(node, spec),
        "inputs": lambda: [] if card else [n.attrs["value"] for n in select(node, "input") if n.attrs.get("name") == "gyosei_cd[]" and n.attrs.get("value")],
    }
    return {name: make() for name, make in makers.items() if name in wanted}


def _page_links(root: Node, spec: dict[str, list[str]]) -> list[dict]:
    paged = {id(n) for n in select(root, *spec["pager"])}
    return [
        {"href": n.attrs.get("href"), "text": n.text(), "rel": n.attrs.get("rel", ""), "pager": id(n) in paged or (n.up is not None and id(n.up) in paged)}
        for n in select(root, "a")
    ]


def _rows(page_id: int, source: str, url: str, kind: str, html: str, wanted: set[str]) -> Iterator[dict]:
    root, spec = tree(html, kind != "search" and wanted <= FLAT), SPECS[source]
    base = {"page_id": page_id, "source": source, "page_url": url, "kind": kind}
    if kind == "search":
        for i, card in enumerate(_cards(root, spec)):
            yield {**base, "card_no": i, **_material(card, source, spec, True, wanted)}
    else:
        yield {**base, "card_no": 0, **_material(root, source, spec, False, wanted)}
    root.page.leave()


def raw_material(pages: DataFrame, *fields: str) -> DataFrame:
    """One row per detail page and one per card of a search page, from pages(page_id, source, url, kind, html).

    ``fields`` are the columns to read besides the keys, all without any. Reading markup takes far longer than moving it, so pages
    are first dealt out over all cores, however few files they lie in; then each is read on its own.
    """
    parts = re.split(r", (?=\w+ (?:bigint|string|int|array|map))", RAW)
    schema = ", ".join(part for part in parts if not fields or part.split(" ")[0] in (*KEYS, *fields))
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    wanted = set(arrow.names) - set(KEYS)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                some = [c.to_pylist() for c in batch.slice(at, CHUNK).columns]
                rows = [row for page in zip(*some) for row in _rows(*page, wanted)]
                yield pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in rows], f.type) for f in arrow], schema=arrow)

    spark = pages.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    dealt = pages.select("page_id", "source", "url", "kind", "html").repartition(tasks, "page_id", "url")
    return dealt.mapInArrow(read, schema)
