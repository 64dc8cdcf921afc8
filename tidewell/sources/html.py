"""HTML pages into ordered text blocks and links, with the standard library's parser in Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

#: Tags whose content is no text of a page, tags of text blocks, and tags that have no end.
SKIPPED = frozenset(("script", "style", "nav", "header", "footer", "aside", "form"))
BLOCKS = frozenset(("p", "h1", "h2", "h3", "h4", "li"))
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"))
LEAST = 20


class Node:
    __slots__ = ("tag", "attrs", "parts")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.parts = tag, attrs, []

    def walk(self) -> Iterator[Node]:
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack += [x for x in reversed(node.parts) if isinstance(x, Node)]

    def text(self, sep: str = " ") -> str:
        out: list[str] = []
        stack: list[Node | str] = [self]
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                out.append(x)
            else:
                stack += reversed(x.parts)
        return re.sub(r"\s+", " ", sep.join(t for t in out if t.strip())).strip()


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("", {})
        self.open = [self.root]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in ("p", "li", "tr", "td", "th") and self.open[-1].tag == tag:  # ends that were left out
            self.open.pop()
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].parts.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.open[-1].parts.append(Node(tag, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                break

    def handle_data(self, data: str) -> None:
        self.open[-1].parts.append(data)


def parse(html: str) -> Node:
    tree = _Tree()
    tree.feed(html)
    tree.close()
    return tree.root


def _main(root: Node) -> Node:
    """The element that holds the content: main, article, one whose id or class says so, or the body."""
    nodes = list(root.walk())
    for test in (
        lambda n: n.tag == "main",
        lambda n: n.tag == "article",
        lambda n: re.search(r"main|content", n.attrs.get("id", ""), re.I),
        lambda n: re.search(r"main|content|body", n.attrs.get("class", ""), re.I),
        lambda n: n.tag == "body",
    ):
        for n in nodes:
            if n.tag and test(n):
                return n
    return root


def extract_blocks(html: str | None) -> list[tuple[str, str]]:
    """(kind, text) of a page: tables first, as lines of cells between bars, then text blocks in order, each of at least
    20 characters.  A paragraph inside of a list item comes twice, once with its item."""
    if not html:
        return []
    root = parse(html)
    for n in root.walk():
        n.parts = [x for x in n.parts if not (isinstance(x, Node) and x.tag in SKIPPED)]
    main = _main(root)
    out: list[tuple[str, str]] = []
    for table in [n for n in main.walk() if n.tag == "table"]:
        rows = [[c.text() for c in r.walk() if c.tag in ("td", "th")] for r in table.walk() if r.tag == "tr"]
        text = "\n".join(" | ".join(r) for r in rows if any(r))
        if len(text) >= LEAST:
            out.append(("table", text))
    for n in main.walk():
        n.parts = [x for x in n.parts if not (isinstance(x, Node) and x.tag == "table")]
    for n in main.walk():
        if n.tag in BLOCKS and len(t := n.text()) >= LEAST:
            out.append(("text", t))
    return out


def extract_links(html: str | None) -> list[tuple[str, str]]:
    """(href, text) of every link, in order."""
    return [(n.attrs["href"], n.text()) for n in parse(html or "").walk() if n.tag == "a" and "href" in n.attrs]


def _rows(extract, names: tuple[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(key, i, a, b) for key, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for i, (a, b) in enumerate(extract(html))]
            types = (batch.schema.field(0).type, pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows) if rows else [()] * 4, types)], names=["k", "pos", *names])

    return run


def page_blocks(pages: DataFrame, key: str = "url", html: str = "html") -> DataFrame:
    """key, pos, kind, text."""
    kind = pages.schema[key].dataType.simpleString()
    return pages.select(key, html).mapInArrow(_rows(extract_blocks, ("kind", "text")), f"k {kind}, pos int, kind string, text string").withColumnRenamed("k", key)


def page_links(pages: DataFrame, key: str = "url", html: str = "html") -> DataFrame:
    """key, pos, href, link_text."""
    kind = pages.schema[key].dataType.simpleString()
    return pages.select(key, html).mapInArrow(_rows(extract_links, ("href", "link_text")), f"k {kind}, pos int, href string, link_text string").withColumnRenamed("k", key)
