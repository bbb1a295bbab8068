"""Pages of HTML as structural units: headings and paragraphs in order, with the path of headings above each.

The tree is built with the standard library's parser: void elements, implied ends of p and li, and block starts that
close open inline elements. Elements keep text and tails, as the rules for what a paragraph is speak of them."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphlake.functions.batches import freeing, pieces

# Fixed values.
BLOCKS = frozenset("p div blockquote li pre table section article".split())
HEADINGS = {f"h{n}": n for n in range(1, 7)}
SKIPPED = frozenset("script style head".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Starts that close an open paragraph, and elements that end open inline ones.
STRUCTURAL = BLOCKS | HEADINGS.keys() | frozenset("ul ol dl dt dd nav header footer aside main form tr td th tbody thead body".split())

UNIT = T.StructType([T.StructField("kind", T.StringType()), T.StructField("level", T.IntegerType()), T.StructField("text", T.StringType())])
PARAGRAPH = T.StructType([T.StructField("text", T.StringType()), T.StructField("path", T.ArrayType(T.StringType()))])
_UNIT_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("level", pa.int32()), ("text", pa.string())]))
_PARAGRAPH_ARROW = pa.list_(pa.struct([("text", pa.string()), ("path", pa.list_(pa.string()))]))


class Element:
    """text stands before the first child, tail behind the element's end. filled says whether a block or heading with
    text lies below, which is worked out once for the whole tree."""

    __slots__ = ("tag", "text", "tail", "children", "filled", "wordy")

    def __init__(self, tag: str):
        self.tag, self.text, self.tail, self.children, self.filled, self.wordy = tag, "", "", [], False, False

    def whole(self) -> str:
        out, todo = [], [(self, False)]
        while todo:
            node, tail = todo.pop()
            if tail:
                out.append(node.tail)
                continue
            out.append(node.text)
            for child in reversed(node.children):
                todo += [(child, True), (child, False)]
        return "".join(out)


class Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Element("")
        self.open = [self.root]

    def close_at(self, i: int) -> None:
        del self.open[i:]

    def handle_starttag(self, tag, attrs):
        tag = tag.rpartition(":")[2]
        if tag in STRUCTURAL:
            while self.open[-1].tag and self.open[-1].tag not in STRUCTURAL | {"html", "head"} | SKIPPED and self.open[-1].tag in INLINE:
                self.open.pop()
            if self.open[-1].tag == "p" or self.open[-1].tag == tag == "li":
                self.open.pop()
        if tag == "body" and self.open[-1].tag == "head":
            self.open.pop()
        element = Element(tag)
        self.open[-1].children.append(element)
        if tag not in VOID:
            self.open.append(element)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.open.pop()

    def handle_endtag(self, tag):
        tag = tag.rpartition(":")[2]
        at = next((i for i in range(len(self.open) - 1, 0, -1) if self.open[i].tag == tag), 0)
        if at:
            self.close_at(at)

    def handle_data(self, data):
        top = self.open[-1]
        if top.children:
            top.children[-1].tail += data
        else:
            top.text += data


INLINE = frozenset("a abbr b bdi bdo big cite code del dfn em font i ins kbd mark q s samp small span strike strong sub sup tt u var".split())


def parse(html: str) -> Element:
    tree = Tree()
    tree.feed(html)
    tree.close()
    root = tree.root
    todo, order = [root], []
    while todo:
        node = todo.pop()
        order.append(node)
        todo += node.children
    for node in reversed(order):  # children first
        inside = any(c.filled or c.wordy and (c.tag in BLOCKS or c.tag in HEADINGS) for c in node.children)
        node.filled = inside
        node.wordy = bool(node.text.strip()) or any(c.wordy or c.tail.strip() for c in node.children)
    return next((n for n in order if n.tag == "body"), root)


def squeezed(text: str) -> str:
    return re.sub(r"\s+", " ", text).strip()


def lines(element: Element) -> Iterator[str]:
    """The text of an inline subtree, parted at <br>, without scripts and styles."""
    held: list[str] = []
    todo: list = [element]
    while todo:
        node = todo.pop()
        if isinstance(node, str):
            held.append(node)
        elif node.tag == "br":
            yield "".join(held)
            held = []
        elif node.tag not in ("script", "style"):
            held.append(node.text)
            for child in reversed(node.children):
                todo += [child.tail, child]
    yield "".join(held)


def units(html: str | None, lossless: bool = False) -> list[tuple[str, int, str]]:
    """(kind, level, text) in document order; kind is 'heading' or 'para', whose level is 0.

    A heading's children are walked as well, and text that stands before or behind blocks inside another element is
    left out, unless lossless is set: then headings are not repeated and such text becomes paragraphs."""
    out: list[tuple[str, int, str]] = []
    if not html:
        return out

    def para(text: str) -> None:
        if text := squeezed(text):
            out.append(("para", 0, text))

    todo: list = [parse(html)]
    while todo:
        node = todo.pop()
        if isinstance(node, str):
            para(node)
            continue
        tag, below = node.tag, node.children
        if tag in SKIPPED:
            continue
        if tag == "br":
            if not lossless:
                para(node.tail)
            continue
        if tag in HEADINGS:
            if text := node.whole().strip():
                out.append(("heading", HEADINGS[tag], text))
            if lossless:
                continue
        elif tag in BLOCKS and node.wordy and not node.filled:
            para(node.whole())
            continue
        elif tag not in BLOCKS and not node.filled:
            for line in lines(node):
                para(line)
            if not lossless:
                para(node.tail)
            continue
        if lossless:
            below = [x for c in below for x in (c, c.tail)]
            todo += reversed([node.text, *below])
        else:
            todo += reversed(below)
    return out


def paragraphs(html: str | None, lossless: bool = False) -> list[dict]:
    """Paragraphs with the headings above each; a heading ends those of its own level and below. Each page starts anew."""
    above: list[tuple[int, str]] = []
    out = []
    for kind, level, text in units(html, lossless):
        if kind == "heading":
            above = [h for h in above if h[0] < level] + [(level, text)]
        else:
            out.append({"text": text, "path": [t for _, t in above]})
    return out


def _mapped(pages: DataFrame, id_col: str, html_col: str, name: str, kind: T.DataType, arrow, made) -> DataFrame:
    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([made(h) for h in batch.column(1).to_pylist()], arrow)], names=[id_col, name])

    rows = pages.select(F.col(id_col).alias(id_col), F.col(html_col).alias(html_col))
    return rows.mapInArrow(freeing(mapped), T.StructType([rows.schema[0], T.StructField(name, T.ArrayType(kind))]))


def page_units(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", lossless: bool = False) -> DataFrame:
    """(id, units array<struct<kind, level, text>>) of every page."""
    names = ("kind", "level", "text")
    return _mapped(pages, id_col, html_col, "units", UNIT, _UNIT_ARROW, lambda h: [dict(zip(names, u, strict=True)) for u in units(h, lossless)])


def page_paragraphs(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", lossless: bool = False) -> DataFrame:
    """(id, paragraphs array<struct<text, path>>) of every page."""
    return _mapped(pages, id_col, html_col, "paragraphs", PARAGRAPH, _PARAGRAPH_ARROW, lambda h: paragraphs(h, lossless))


def book_paragraphs(pages: DataFrame, book_col: str, order_col: str) -> DataFrame:
    """Paragraphs of all pages of a book in page order, from `page_paragraphs` with the book's id and an order beside."""
    parts = pages.groupBy(book_col).agg(F.array_sort(F.collect_list(F.struct(order_col, "paragraphs"))).alias("p"))
    return parts.select(book_col, F.flatten("p.paragraphs").alias("paragraphs"))
