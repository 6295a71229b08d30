"""HTML tables and paths into XML."""

from __future__ import annotations

from collections.abc import Iterator
from html import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions.naming import header
from ..operators.infer import shown, typed


def html_rows(pages: DataFrame, column: str = "html", index: int | None = None, **how) -> DataFrame:
    """(all other columns, table, row, cells) of the tables of every page."""
    keep = [c for c in pages.columns if c != column]
    kinds = dict(pages.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for rest, page in zip(b[keep].itertuples(index=False) if keep else [()] * len(b), b[column]):
                for t, rows in enumerate(H.tables(page, **how)):
                    if index is None or t == index:
                        out += [(*rest, t, r, [None if c is None else str(c) for c in cells]) for r, cells in enumerate(rows)]
            yield pd.DataFrame(out, columns=[*keep, "table", "row", "cells"])

    return pages.mapInPandas(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "table int, row int, cells array<string>"]))


def read_html(spark: SparkSession, path: str, index: int = 0, ignore_colspan: bool = True, encoding: str = "utf-8", infer: bool = True, types=None, **how) -> DataFrame:
    """The table of that number; the first row is the header.  Rows with fewer
    cells than the widest are left out with ``ignore_colspan``."""
    page = spark.read.option("encoding", encoding).text(path, wholetext=True).withColumnRenamed("value", "html")
    rows = html_rows(page, index=index, **how)
    widest = rows.agg(F.max(F.size("cells"))).first()[0] or 0
    rows = rows.where(F.size("cells") == widest) if ignore_colspan else rows
    first = rows.orderBy("row").select("row", "cells").first()
    if first is None:
        return spark.createDataFrame([], "field_0 string")
    names = header([*first["cells"], *[None] * widest][:widest])
    df = rows.where(F.col("row") > first["row"]).orderBy("row").select(*(F.coalesce(F.get("cells", F.lit(k)), F.lit("")).alias(c) for k, c in enumerate(names)))
    return typed(df, types) if infer else df


def to_html(df: DataFrame, caption: str | None = None) -> str:
    """The table passes through the driver, a partition at a time."""
    out = ["<table>\n"] + ([f"  <caption>{escape(caption)}</caption>\n"] if caption else [])
    out += ["\n  <thead>\n    <tr>\n", *(f"      <th> {escape(c)} </th>\n" for c in df.columns), "    </tr>\n  </thead>\n\n  <tbody>\n"]
    for k, row in enumerate(shown(df).toLocalIterator(), 1):
        out += [f'\n    <tr class="{"odd" if k % 2 else "even"}">\n', *(f"      <td> {escape(v)} </td>\n" for v in row), "    </tr>\n"]
    return "".join(out) + "\n  </tbody>\n\n</table>\n"


def read_xpath(spark: SparkSession, path: str, rows: str, fields: dict[str, str], encoding: str = "utf-8", **how) -> DataFrame:
    """Elements by path, and each field by a path from there (the paths that
    the standard library knows, with /text() and /@name at the end)."""
    if not isinstance(rows, str) or not all(isinstance(x, str) for x in fields.values()):
        raise TypeError("Paths must be text")
    page = spark.read.option("encoding", encoding).text(path, wholetext=True)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from xml.etree import ElementTree as ET

        def tree(node: H.Node) -> ET.Element:
            e = ET.Element(node.tag or "html-root", {k: v or "" for k, v in node.attrs.items()})
            last = None
            for c in node.children:
                if isinstance(c, H.Node):
                    last = tree(c)
                    e.append(last)
                elif last is None:
                    e.text = (e.text or "") + c
                else:
                    last.tail = (last.tail or "") + c
            return e

        def find(e, p):
            p, _, end = p.rpartition("/") if p.rpartition("/")[2].startswith(("text()", "@")) else (p, "", "")
            p = f".{p}" if p.startswith("/") else p
            for x in e.findall(p.rstrip("/") or ".") if p not in ("", ".") else [e]:
                yield from ([x.get(end[1:], "")] if end.startswith("@") else x.itertext() if end == "text()" and p == "" else [x.text or ""] if end == "text()" else ["".join(x.itertext())])

        for b in batches:
            out = []
            for text in b["value"]:
                root = tree(H.parse(text))
                for e in root.findall(f".{rows}" if rows.startswith("/") else rows):
                    got = [[v.strip() for v in find(e, p) if v.strip()] for p in fields.values()]
                    out.append([" ".join(v) if v else None for v in got])
            yield pd.DataFrame(out, columns=list(fields))

    return typed(page.mapInPandas(run, ", ".join(f"`{c}` string" for c in header(fields))), **how)
