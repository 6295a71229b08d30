"""Spreadsheets: XLSX (read and write) and ODS (read), one task a file."""

from __future__ import annotations

import datetime as dt
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.naming import header
from ..operators.infer import shown, typed
from .files import local

M = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
T = "{urn:oasis:names:tc:opendocument:xmlns:table:1.0}"
O = "{urn:oasis:names:tc:opendocument:xmlns:office:1.0}"  # noqa: E741
X = "{urn:oasis:names:tc:opendocument:xmlns:text:1.0}"
EPOCH = dt.datetime(1899, 12, 30)


def sheet_names(data: bytes) -> list[str]:
    z = zipfile.ZipFile(io.BytesIO(data))
    if "content.xml" in z.namelist():
        return [t.get(f"{T}name") for t in ET.fromstring(z.read("content.xml")).iter(f"{T}table")]
    return [s.get("name") for s in ET.fromstring(z.read("xl/workbook.xml")).iter(f"{M}sheet")]


def list_sheets(path: str) -> list[str]:
    with open(local(path), "rb") as f:
        return sheet_names(f.read())


def _column(ref: str) -> int:
    k = 0
    for c in re.match("[A-Z]+", ref)[0]:
        k = k * 26 + ord(c) - 64
    return k - 1


def _date(value: float) -> str:
    d = EPOCH + dt.timedelta(days=value)
    d = (d + dt.timedelta(microseconds=500_000)).replace(microsecond=0)
    return d.date().isoformat() if value == int(value) else d.isoformat()


def _number(text: str) -> str:
    x = float(text)
    return str(int(x)) if x == int(x) and abs(x) < 1e15 else repr(x)


def xlsx_rows(data: bytes, name: str | None, index: int) -> Iterator[tuple[int, dict[int, str]]]:
    z = zipfile.ZipFile(io.BytesIO(data))
    book = ET.fromstring(z.read("xl/workbook.xml"))
    sheets = list(book.iter(f"{M}sheet"))
    sheet = next(s for s in sheets if s.get("name") == name) if name else sheets[index]
    links = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    target = links[sheet.get(f"{R}id")].lstrip("/")
    shared = ["".join(t.text or "" for t in si.iter(f"{M}t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in z.namelist() else []
    kinds: list[str] = []
    if "xl/styles.xml" in z.namelist():
        style = ET.fromstring(z.read("xl/styles.xml"))
        codes = {int(f.get("numFmtId")): f.get("formatCode") for f in style.iter(f"{M}numFmt")}
        codes |= {9: "0%", 10: "0.00%", 14: "yyyy-mm-dd", 22: "yyyy-mm-dd h:mm"}
        for xf in style.find(f"{M}cellXfs") if style.find(f"{M}cellXfs") is not None else []:
            code = codes.get(int(xf.get("numFmtId", 0)), "").lower()
            kinds.append("%" if "%" in code else "date" if "yy" in code else "")
    for row in ET.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}")).iter(f"{M}row"):
        cells = {}
        for n, c in enumerate(row):
            v, t = c.find(f"{M}v"), c.get("t")
            at = _column(c.get("r")) if c.get("r") else n
            kind = kinds[int(c.get("s", 0))] if int(c.get("s", 0)) < len(kinds) else ""
            if t == "inlineStr":
                cells[at] = "".join(x.text or "" for x in c.iter(f"{M}t"))
            elif v is None or v.text is None:
                continue
            elif t == "s":
                cells[at] = shared[int(v.text)]
            elif t == "b":
                cells[at] = "true" if v.text == "1" else "false"
            elif t in ("str", "e"):
                cells[at] = v.text
            else:
                cells[at] = f"{_number(str(round(float(v.text) * 100, 10)))}%" if kind == "%" else _date(float(v.text)) if kind == "date" else _number(v.text)
        yield int(row.get("r", 1)) - 1, cells


def ods_rows(data: bytes, name: str | None, index: int) -> Iterator[tuple[int, dict[int, str]]]:
    z = zipfile.ZipFile(io.BytesIO(data))
    tables = list(ET.fromstring(z.read("content.xml")).iter(f"{T}table"))
    table = next(t for t in tables if t.get(f"{T}name") == name) if name else tables[index]
    at = 0
    for row in table.iter(f"{T}table-row"):
        cells, k = {}, 0
        for c in row:
            n = int(c.get(f"{T}number-columns-repeated", 1))
            kind = c.get(f"{O}value-type")
            value = {"date": c.get(f"{O}date-value"), "boolean": c.get(f"{O}boolean-value"), "float": c.get(f"{O}value"), "percentage": c.get(f"{O}value")}.get(kind)
            if kind == "percentage" and value is not None:
                value = f"{_number(str(round(float(value) * 100, 10)))}%"
            elif kind == "float" and value is not None:
                value = _number(value)
            elif kind and value is None:
                value = "\n".join("".join(p.itertext()) for p in c.iter(f"{X}p"))
            if value is not None:
                for j in range(n):
                    cells[k + j] = value
            k += n
        for _ in range(int(row.get(f"{T}number-rows-repeated", 1)) if cells else 1):
            yield at, cells
            at += 1
        if not cells:
            at += int(row.get(f"{T}number-rows-repeated", 1)) - 1


def read_sheet(spark: SparkSession, path: str, sheet_name: str | None = None, sheet_index: int = 0, start_row: int = 0, start_column: int = 0, end_row: int | None = None, end_column: int | None = None, infer: bool = True, **how) -> DataFrame:
    """A window of a sheet (bounds from 0, both included); its first row that
    isn't empty is the header, empty rows are dropped."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for blob in b["content"]:
                reader = ods_rows if "content.xml" in zipfile.ZipFile(io.BytesIO(blob)).namelist() else xlsx_rows
                out = []
                for r, cells in reader(blob, sheet_name, sheet_index):
                    got = {k - max(0, start_column): v for k, v in cells.items() if k >= start_column and (end_column is None or k <= end_column)}
                    if r >= start_row and (end_row is None or r <= end_row) and got:
                        out.append((r, [got.get(k) for k in range(max(got) + 1)]))
                yield pd.DataFrame(out, columns=["r", "cells"])

    rows = spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "r int, cells array<string>")
    width = rows.agg(F.max(F.size("cells"))).first()[0] or 0
    first = rows.orderBy("r").first()
    if first is None:
        return spark.createDataFrame([], "field_0 string")
    names = header([*first["cells"], *[None] * width][:width])
    df = rows.where(F.col("r") > first["r"]).orderBy("r").select(*(F.get("cells", F.lit(k)).alias(c) for k, c in enumerate(names)))
    return typed(df, **how) if infer else df


def _ref(r: int, c: int) -> str:
    name, c = "", c + 1
    while c:
        c, k = divmod(c - 1, 26)
        name = chr(65 + k) + name
    return f"{name}{r}"


def write_xlsx(df: DataFrame, path: str, sheet_name: str | None = None) -> str:
    """A workbook, or one more sheet of an existing one.  A sheet has at most
    a million rows, so it is written by the driver."""
    from ..functions.types import field_of

    fields = [f.metadata.get("field") or field_of(f.dataType.simpleString()).name for f in df.schema]
    style = {"date": 1, "datetime": 2, "percent": 3}
    rows = [f'<row r="1">{"".join(f"<c r={chr(34)}{_ref(1, k)}{chr(34)} t={chr(34)}inlineStr{chr(34)}><is><t>{escape(c)}</t></is></c>" for k, c in enumerate(df.columns))}</row>']
    plain = df.select(*(F.col(c) if k in ("bool", "integer", "float", "decimal", "percent", "date", "datetime") else s for c, k, s in zip(df.columns, fields, [F.col(x) for x in shown(df).columns])))
    for r, row in enumerate(plain.toLocalIterator(), 2):
        cells = []
        for k, (v, f) in enumerate(zip(row, fields)):
            at = f'r="{_ref(r, k)}"'
            if v is None:
                continue
            if f == "bool":
                cells.append(f'<c {at} t="b"><v>{int(v)}</v></c>')
            elif f in ("date", "datetime"):
                d = v if isinstance(v, dt.datetime) else dt.datetime.combine(v, dt.time())
                cells.append(f'<c {at} s="{style[f]}"><v>{(d - EPOCH) / dt.timedelta(days=1)!r}</v></c>')
            elif f in ("integer", "float", "decimal", "percent"):
                cells.append(f'<c {at} s="{style.get(f, 0)}"><v>{v}</v></c>')
            else:
                cells.append(f'<c {at} t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>')
        rows.append(f'<row r="{r}">{"".join(cells)}</row>')
    sheet = f'<worksheet xmlns="{M[1:-1]}"><sheetData>{"".join(rows)}</sheetData></worksheet>'
    old: list[tuple[str, bytes]] = []
    try:
        with zipfile.ZipFile(local(path)) as z:
            book = ET.fromstring(z.read("xl/workbook.xml"))
            old = [(s.get("name"), z.read(f"xl/worksheets/sheet{k}.xml")) for k, s in enumerate(book.iter(f"{M}sheet"), 1)]
    except FileNotFoundError:
        pass
    taken = {n for n, _ in old}
    sheet_name = sheet_name or next(f"Sheet{k}" for k in range(1, len(taken) + 2) if f"Sheet{k}" not in taken)
    sheets = [*((n, s) for n, s in old if n != sheet_name), (sheet_name, sheet.encode())]
    n = len(sheets)
    with zipfile.ZipFile(local(path), "w", zipfile.ZIP_DEFLATED) as z:
        kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
        z.writestr("[Content_Types].xml", f'<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="{kind}.styles+xml"/>' + "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="{kind}.worksheet+xml"/>' for k in range(1, n + 1)) + "</Types>")
        rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
        z.writestr("_rels/.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{M[1:-1]}" xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{escape(x)}" sheetId="{k}" r:id="r{k}"/>' for k, (x, _) in enumerate(sheets, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="r{k}" Type="{rel}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in range(1, n + 1)) + f'<Relationship Id="r{n + 1}" Type="{rel}/styles" Target="styles.xml"/></Relationships>')
        z.writestr("xl/styles.xml", f'<styleSheet xmlns="{M[1:-1]}"><numFmts count="3"><numFmt numFmtId="164" formatCode="yyyy-mm-dd"/><numFmt numFmtId="165" formatCode="yyyy-mm-dd hh:mm:ss"/><numFmt numFmtId="166" formatCode="0.00%"/></numFmts><fonts count="1"><font/></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="4"><xf numFmtId="0"/><xf numFmtId="164" applyNumberFormat="1"/><xf numFmtId="165" applyNumberFormat="1"/><xf numFmtId="166" applyNumberFormat="1"/></cellXfs></styleSheet>')
        for k, (_, s) in enumerate(sheets, 1):
            z.writestr(f"xl/worksheets/sheet{k}.xml", s)
    return sheet_name
