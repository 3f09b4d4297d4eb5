"""HTML as arrays of nodes: one small parser per page, everything after it in column expressions.

A node is (tag, cls, attrs, text, last): text nodes have tag "#text", and ``last`` is the position of the last
node below it, so the nodes below position p are the slice p + 1 .. last.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

from hemline.functions import text as T

NODES = "array<struct<tag: string, cls: string, attrs: map<string,string>, text: string, last: int>>"
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
RAW = {"script", "style"}
# Bytes of pages parsed together: their nodes are Python objects until they are handed on.
SLICE_BYTES = 1 << 20


class _Nodes(HTMLParser):
    """Appends the nodes of one page after another to flat column lists."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tag, self.cls, self.text, self.last = [], [], [], []
        self.key, self.value, self.attr_ends, self.page_ends = [], [], [0], [0]

    def page(self, html: str | None):
        self.reset()
        self.start, self.open = len(self.tag), []
        self.feed(html or "")
        self.close()
        for at in self.open:
            self.last[at] = len(self.tag) - 1 - self.start
        self.page_ends.append(len(self.tag))

    def add(self, tag, cls, text, attrs):
        self.tag.append(tag)
        self.cls.append(cls)
        self.text.append(text)
        self.last.append(len(self.tag) - 1 - self.start)
        self.key.extend(attrs.keys())
        self.value.extend(attrs.values())
        self.attr_ends.append(len(self.key))

    def handle_starttag(self, tag, attrs):
        found = {k: v or "" for k, v in attrs}
        self.add(tag, found.get("class", ""), None, found)
        if tag not in VOID:
            self.open.append(len(self.tag) - 1)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        self.handle_endtag(tag)

    def handle_endtag(self, tag):
        for depth in range(len(self.open) - 1, -1, -1):
            if self.tag[self.open[depth]] == tag:
                for at in self.open[depth:]:
                    self.last[at] = len(self.tag) - 1 - self.start
                del self.open[depth:]
                return

    def handle_data(self, data):
        if not (self.open and self.tag[self.open[-1]] in RAW):
            self.add("#text", "", data, {})

    def columns(self) -> pa.Array:
        text, number = pa.string(), pa.int32()
        attrs = pa.MapArray.from_arrays(
            pa.array(self.attr_ends, number), pa.array(self.key, text), pa.array(self.value, text)
        )
        nodes = pa.StructArray.from_arrays(
            [pa.array(self.tag, text), pa.array(self.cls, text), attrs, pa.array(self.text, text), pa.array(self.last, number)],
            names=["tag", "cls", "attrs", "text", "last"],
        )
        return pa.ListArray.from_arrays(pa.array(self.page_ends, number), nodes)


def html_nodes(html: Column) -> Column:
    cloudpickle.register_pickle_by_value(sys.modules[__name__])

    @F.arrow_udf(NODES)
    def nodes(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for pages in batches:
            yield from node_slices(pages)

    return nodes(html)


def node_slices(pages: pa.Array, slice_bytes: int = SLICE_BYTES) -> Iterator[pa.Array]:
    """Nodes of the pages in order, in slices of about ``slice_bytes`` of page text; no pages give one empty slice."""
    parser, size = _Nodes(), 0
    for page in pages:
        page = page.as_py()
        parser.page(page)
        size += len(page or "")
        if size >= slice_bytes:
            yield parser.columns()
            parser, size = _Nodes(), 0
    if size or len(parser.page_ends) > 1 or not len(pages):
        yield parser.columns()


# --- column helpers over node arrays ----------------------------------------------------------------------

def placed(nodes: Column) -> Column:
    """Nodes with their position ``at`` and their class in lower case, ``low``."""
    return F.transform(
        nodes,
        lambda n, i: F.struct(
            n["tag"].alias("tag"), n["cls"].alias("cls"), F.lower(n["cls"]).alias("low"), n["attrs"].alias("attrs"),
            n["text"].alias("text"), n["last"].alias("last"), i.alias("at"),
        ),
    )


def below(nodes: Column, node: Column, start: Column | None = None) -> Column:
    """Nodes under ``node``. ``nodes`` is the whole page, or the slice of it that begins at position ``start``."""
    return F.slice(nodes, node["at"] - (F.lit(0) if start is None else start) + 2, node["last"] - node["at"])


def where(nodes: Column, *tags: str, cls: list[str] | None = None, test: Callable | None = None) -> Column:
    """Elements with one of the tags (any when none is given) whose class holds one of ``cls``, in any case."""

    def fits(n: Column) -> Column:
        ok = n["tag"].isin(*tags) if tags else n["tag"] != "#text"
        if cls:
            ok = ok & T.any_of([F.contains(n["low"], F.lit(c)) for c in cls])
        return ok & test(n) if test else ok

    return F.filter(nodes, fits)


def first(nodes: Column, *tags: str, cls: list[str] | None = None, test: Callable | None = None) -> Column:
    return F.get(where(nodes, *tags, cls=cls, test=test), F.lit(0))


def text_of(nodes: Column, separator: str = "") -> Column:
    """Trimmed text pieces among ``nodes``, blank ones dropped."""
    pieces = F.transform(F.filter(nodes, lambda n: n["tag"] == "#text"), lambda n: T.strip(n["text"]))
    return F.array_join(F.filter(pieces, lambda p: p != ""), separator)


def attr(node: Column, name: str) -> Column:
    return F.try_element_at(node["attrs"], F.lit(name))
