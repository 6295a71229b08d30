"""HTML: texts, links, attributes and tables, by the parser of the standard
library.  A cell, row or paragraph that isn't closed ends with the next one."""

from __future__ import annotations

from html import escape, unescape  # noqa: F401
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
ENDS = {"td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr", "td", "th"}, {"table"}), "li": ({"li"}, {"ul", "ol"}), "p": ({"p"}, {"td", "th", "div"}), "option": ({"option"}, {"select"})}
GROUPS = ("thead", "tbody", "tfoot")


class Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs=(), parent=None):
        self.tag, self.attrs, self.children, self.parent = tag, dict(attrs), [], parent

    def walk(self):
        for c in self.children:
            if isinstance(c, Node):
                yield c
                yield from c.walk()

    def texts(self):
        for c in self.children:
            if isinstance(c, Node):
                yield from c.texts()
            else:
                yield c

    def html(self) -> str:
        return "".join(c if not isinstance(c, Node) else f"<{c.tag}{''.join(f' {k}={chr(34)}{escape(v or str())}{chr(34)}' for k, v in c.attrs.items())}>" + ("" if c.tag in VOID else f"{c.html()}</{c.tag}>") for c in self.children)


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("")

    def handle_starttag(self, tag, attrs):
        if tag in ENDS:
            closes, until = ENDS[tag]
            n = self.at
            while n.parent is not None and n.tag not in until:
                if n.tag in closes:
                    self.at = n.parent
                n = n.parent
        node = Node(tag, attrs, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_endtag(self, tag):
        n = self.at
        while n.parent is not None and n.tag != tag:
            if n.tag == "table" and tag not in ("body", "html"):
                return
            n = n.parent
        if n.parent is not None:
            self.at = n.parent

    def handle_data(self, data):
        self.at.children.append(data)


def parse(html: str) -> Node:
    b = _Builder()
    b.feed(html or "")
    b.close()
    return b.root


def text_of(node: Node) -> str:
    return " ".join(x.strip() for x in node.texts() if x.strip())


def tables(html: str, table="table", row="tr", cells=("td", "th"), preserve_html=False, properties=False) -> list[list[list]]:
    """Rows of texts of every table, in document order; nested ones count."""
    out = []
    for t in (n for n in parse(html).walk() if n.tag == table):
        rows, todo = [], list(t.children)
        while todo:
            n = todo.pop(0)
            if isinstance(n, Node) and n.tag in GROUPS:
                todo = list(n.children) + todo
            elif isinstance(n, Node) and n.tag == row:
                found = [c.html().strip() if preserve_html and any(isinstance(x, Node) for x in c.children) else text_of(c) for c in n.children if isinstance(c, Node) and c.tag in cells]
                rows.append(found + ([n.attrs] if properties else []))
        out.append(rows)
    return out


def _each(function, kind: str, column: Column) -> Column:
    """A Python function of texts, in batches; null stays null."""

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: None if x is None else function(x))

    return F.pandas_udf(run, kind)(column)


def html_text(html: Column) -> Column:
    return _each(lambda x: text_of(parse(x)), "string", html)


def _first(x: str) -> dict[str, str]:
    first = next((n for n in parse(x).walk() if n.tag not in ("html", "head", "body")), None)
    return {} if first is None else {**{k: v or "" for k, v in first.attrs.items()}, "text": "".join(first.texts())}


def first_tag(html: Column) -> Column:
    """Attributes of the first tag, and its text as ``text``."""
    return _each(_first, "map<string,string>", html)


def links(html: Column) -> Column:
    """Every href in double quotes, without leaving the JVM."""
    return F.regexp_extract_all(html, F.lit('href="([^"]*)"'), F.lit(1))


def links_parsed(html: Column) -> Column:
    """Every href, however it is quoted."""
    return _each(lambda x: [n.attrs["href"] for n in parse(x).walk() if "href" in n.attrs], "array<string>", html)


def tag_count(html: Column, tag: str = "table") -> Column:
    return F.regexp_count(html, F.lit(f"(?i)<{tag}[\\s>]")).cast("long")
