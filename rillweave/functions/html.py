"""One-pass extraction of page records: the page is parsed once, all fields come from that tree.

The tree comes from the standard library's tokenizer with void elements and
implied end tags; a bad page gives a record with parse_error instead of
failing its batch.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Collection, Iterator
from dataclasses import dataclass
from html.parser import HTMLParser
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCKS = frozenset("address article aside blockquote body div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
#: A start tag ends open elements of these kinds, up to the container named last.
_ENDS = {"li": ("li", {"ul", "ol"}), "option": ("option", {"select"}), "tr": ("tr", {"table"}), "td": ("td", {"tr", "table"}), "th": ("th", {"tr", "table"}), "dt": ("dd", {"dl"}), "dd": ("dt", {"dl"})}
_SILENT = frozenset(("script", "style", "template"))
_DROPPED = frozenset(("script", "style", "nav", "footer", "header"))
# What the words of a rating count.
_RATINGS = {"One": 1, "Two": 2, "Three": 3, "Four": 4, "Five": 5}
#: Containers tried for product lists, in order: tag and part of its class.
# Boxes of a product list, tried in this order.
_LISTS = [("div", "product-item"), ("div", "product-card"), ("div", "product"), ("li", "product"), ("div", "item")]

PRODUCT = "struct<name: string, url: string, price: string, rating: string, rating_num: int, availability: string, image: string>"
QUOTE = "struct<text: string, author: string, author_url: string, tags: array<string>>"
PAGE_SCHEMA = f"title string, description string, h1 string, links array<struct<url: string, text: string>>, links_count int, text_length int, text_preview string, products array<{PRODUCT}>, products_count int, quotes array<{QUOTE}>, quotes_count int, parse_error string"


class Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.children, self.parent = tag, attrs, [], parent

    def walk(self) -> Iterator[Node]:
        stack = [iter(self.children)]
        while stack:
            for child in stack[-1]:
                if isinstance(child, Node):
                    yield child
                    stack.append(iter(child.children))
                    break
            else:
                stack.pop()

    def all(self, test: Callable[[Node], bool]) -> Iterator[Node]:
        return (n for n in self.walk() if test(n))

    def first(self, test: Callable[[Node], bool]) -> Node | None:
        return next(self.all(test), None)

    def classes(self) -> list[str]:
        return (self.attrs.get("class") or "").split()

    def text(self, joint: str = "") -> str:
        """Text nodes, each stripped, the empty ones left out; scripts and styles are silent inside others."""
        found, stack = [], [iter(self.children)]
        while stack:
            for child in stack[-1]:
                if isinstance(child, str):
                    if bare := child.strip():
                        found.append(bare)
                elif child.tag not in _SILENT:
                    stack.append(iter(child.children))
                    break
            else:
                stack.pop()
        return joint.join(found)

    def remove(self) -> None:
        self.parent.children = [c for c in self.parent.children if c is not self]


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def _close_to(self, tag: str, stop: set[str]) -> None:
        node = self.at
        while node is not self.root and node.tag not in stop:
            if node.tag == tag:
                self.at = node.parent
                return
            node = node.parent

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in _BLOCKS and self.at.tag == "p":
            self.at = self.at.parent
        if tag in _ENDS:
            other, stop = _ENDS[tag]
            self._close_to(tag, stop)
            self._close_to(other, stop)
        held: dict[str, str] = {}
        for name, value in attrs:
            held.setdefault(name, value or "")
        node = Node(tag, held, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        node = self.at
        while node is not self.root:
            if node.tag == tag:
                self.at = node.parent
                return
            node = node.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def parse(page: str) -> Node:
    builder = _Builder()
    builder.feed(page)
    builder.close()
    return builder.root


def _tag(*names: str) -> Callable[[Node], bool]:
    return lambda n: n.tag in names


def _has(tag: str, name: str) -> Callable[[Node], bool]:
    return lambda n: n.tag == tag and name in n.classes()


def _like(part: str, tag: str | None = None, fold: bool = True) -> Callable[[Node], bool]:
    """part stands somewhere in one of the classes, or in all of them as written."""

    def test(n: Node) -> bool:
        if tag and n.tag != tag:
            return False
        full = n.attrs.get("class") or ""
        return part in (full.lower() if fold else full)

    return test


def _attr(name: str) -> Callable[[Node], str]:
    return lambda n: n.attrs.get(name, "")


def _word(stars: Node) -> str | None:
    """The rating among the classes of a box of stars, as it is written."""
    return next((c for c in stars.classes() if c != "star-rating"), None)


@dataclass(frozen=True)
class Pick:
    """What a field of a box is: the first match of each step below the one before, and what is taken of the last; None where a step has no match."""

    steps: tuple[Callable[[Node], bool], ...]
    take: Callable[[Node], Any] = Node.text

    def of(self, node: Node) -> Any:
        for step in self.steps:
            node = node.first(step)
            if node is None:
                return None
        return self.take(node)


@dataclass(frozen=True)
class Listing:
    """Boxes of a tag and the fields of each; a box counts if one of the fields `need` (any field, if none are named) has a value."""

    tag: str
    box: Callable[[Node], bool]
    fields: dict[str, Pick]
    need: tuple[str, ...] = ()

    def boxes(self, by_tag: dict[str, list[Node]]) -> list[Node]:
        return [n for n in by_tag.get(self.tag, ()) if self.box(n)]

    def rows(self, boxes: list[Node]) -> list[dict]:
        found = ({name: pick.of(box) for name, pick in self.fields.items()} for box in boxes)
        return [r for r in found if any((r[n] for n in self.need) if self.need else (v is not None for v in r.values()))]


_LINK = (_tag("h3"), _tag("a"))
_STARS = (_like("star-rating", "p", fold=False),)
# Where the fields of quotes, of product pods and of product cards stand.
QUOTES = Listing(
    "div",
    _has("div", "quote"),
    {
        "text": Pick((_has("span", "text"),)),
        "author": Pick((_has("small", "author"),)),
        "author_url": Pick((lambda n: n.tag == "a" and "/author/" in n.attrs.get("href", ""),), _attr("href")),
        "tags": Pick((_has("div", "tags"),), lambda n: [a.text() for a in n.all(_has("a", "tag"))] or None),
    },
    need=("text",),
)
PODS = Listing(
    "article",
    _has("article", "product_pod"),
    {
        "name": Pick(_LINK, lambda a: a.attrs.get("title", "") or a.text()),
        "url": Pick(_LINK, _attr("href")),
        "rating": Pick(_STARS, lambda n: None if (w := _word(n)) is None else str(_RATINGS.get(w, w))),
        "rating_num": Pick(_STARS, lambda n: _RATINGS.get(_word(n))),
        "price": Pick((_has("p", "price_color"),)),
        "availability": Pick((_has("p", "instock"),)),
        "image": Pick((_tag("img"),), _attr("src")),
    },
)
CARDS = [Listing(tag, _like(part, tag), {"name": Pick((_tag("h2", "h3", "h4", "a"),), lambda n: n.text()[:200]), "price": Pick((_like("price"),)), "rating": Pick((_like("rating"),))}, need=("name",)) for tag, part in _LISTS]


def products_in(by_tag: dict[str, list[Node]]) -> list[dict]:
    """Pods if the page has any, else the first kind of cards that gives rows."""
    blank = dict.fromkeys(PODS.fields)
    pods = PODS.boxes(by_tag)
    if pods:
        return PODS.rows(pods)
    return next(([blank | r for r in rows] for kind in CARDS if (rows := kind.rows(kind.boxes(by_tag)))), [])


def _by_tag(root: Node) -> dict[str, list[Node]]:
    """All nodes in order of the page, by tag: one walk for all lists."""
    found: dict[str, list[Node]] = {}
    for n in root.walk():
        found.setdefault(n.tag, []).append(n)
    return found


#: Fields of a page in groups that are worked out together.
_HEAD, _LINKS, _BODY, _PRODUCTS, _QUOTES = {"title", "description", "h1"}, {"links", "links_count"}, {"text_length", "text_preview"}, {"products", "products_count"}, {"quotes", "quotes_count"}


def page_record(page: str, fields: Collection[str] | None = None) -> dict:
    """The fields of a page, all or some. The text is cut before its length is taken; parts dropped for it are gone for lists that come later."""
    wanted = _HEAD | _LINKS | _BODY | _PRODUCTS | _QUOTES if fields is None else set(fields)
    root, out = parse(page), {"parse_error": None}
    if wanted & _HEAD:
        title, h1 = root.first(_tag("title")), root.first(_tag("h1"))
        meta = root.first(lambda n: n.tag == "meta" and n.attrs.get("name") == "description")
        out |= {"title": title.text() if title else "", "description": _attr("content")(meta) if meta else "", "h1": h1.text() if h1 else ""}
    if wanted & _LINKS:
        links = [{"url": a.attrs["href"], "text": a.text()[:100]} for a in root.all(_tag("a")) if a.attrs.get("href", "").startswith("http")]
        out |= {"links": links, "links_count": len(links)}
    if wanted & (_BODY | _PRODUCTS | _QUOTES):
        main = root.first(_tag("main")) or root.first(_tag("article")) or root.first(_tag("body")) or (root if root.children and not root.first(_tag("body")) else None)
        for part in list(main.all(_tag(*_DROPPED))) if main else ():
            part.remove()
        if wanted & _BODY:
            body = main.text(" ")[:5000] if main else ""
            out |= {"text_length": len(body), "text_preview": body[:500]}
        if wanted & (_PRODUCTS | _QUOTES):
            by_tag = _by_tag(root)
            for name, group, find in (("products", _PRODUCTS, products_in), ("quotes", _QUOTES, lambda b: QUOTES.rows(QUOTES.boxes(b)))):
                if wanted & group:
                    found = find(by_tag)
                    out |= {name: found or None, f"{name}_count": len(found) or None}
    return out


def _record(parser: Callable[[str], dict], page: str | None, names: list[str]) -> dict:
    try:
        return parser(page or "")
    except Exception as e:  # a page's fault is its own
        return dict.fromkeys(names) | {"parse_error": f"{type(e).__name__}: {e}"}


def extract(page: Column, parser: Callable[[str], dict] = page_record, schema: str = PAGE_SCHEMA, fields: list[str] | None = None) -> Column:
    """A struct of the page's fields; a parser of one's own maps HTML to a dict of the schema's fields, with parse_error among them. fields: those of a page_record that are wanted, so that no others are worked out and sent."""
    kinds = {f.split()[0].rstrip(":"): f for f in _top_level(schema)}
    if fields is not None:
        if parser is not page_record:
            raise ValueError("fields are those of page_record")
        kinds, parser = {n: kinds[n] for n in [*fields, "parse_error"]}, functools.partial(page_record, fields=frozenset(fields))
    names = list(kinds)

    @F.pandas_udf(", ".join(kinds.values()))
    def run(pages: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_record(parser, p, names) for p in pages], columns=names)

    return run(page)


def _top_level(schema: str) -> list[str]:
    depth, out = 0, [""]
    for c in schema:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return [x.strip() for x in out]
