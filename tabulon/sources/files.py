"""Delimited text, drawn tables, JSON and compressed files.

Only the head of a file is read by the driver, to find its dialect and header;
Spark reads the rest in parallel."""

from __future__ import annotations

import bz2
import csv
import gzip
import io
import json
import lzma
from collections.abc import Iterable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.naming import header
from ..operators.infer import shown, typed

SAMPLE = 256 << 10
OPENERS = {".gz": gzip.open, ".xz": lzma.open, ".bz2": bz2.open}


class Semicolon(csv.excel):
    delimiter = ";"


csv.register_dialect("semicolon", Semicolon)


def local(path: str) -> str:
    return path.removeprefix("file://")


def open_any(path: str, mode: str = "rb", **how):
    """A plain or compressed file, by its name."""
    return OPENERS.get(Path(local(path)).suffix.lower(), open)(local(path), mode, **how)


def head_bytes(path: str, size: int = SAMPLE, spark: SparkSession | None = None) -> bytes:
    """The first bytes of a file, or of the first data file of a folder; other
    file systems than the local one are read through ``spark``."""
    at = Path(local(path))
    if at.is_dir():
        at = next((f for f in sorted(at.rglob("*")) if f.is_file() and f.stat().st_size and not any(x.startswith(("_", ".")) for x in f.relative_to(at).parts)), None)
        if at is None:
            return b""
    elif not at.exists() and spark is not None:
        return _remote_head(spark, path, size)
    with open_any(str(at)) as f:
        return f.read(size)


def _remote_head(spark: SparkSession, path: str, size: int) -> bytes:
    sc = spark.sparkContext
    hadoop, conf = sc._jvm.org.apache.hadoop, sc._jsc.hadoopConfiguration()
    fs = hadoop.fs.Path(path).getFileSystem(conf)
    found = sorted((s for s in fs.globStatus(hadoop.fs.Path(path)) or []), key=lambda s: s.getPath().toString())
    while found and found[0].isDirectory():
        found = sorted((s for s in fs.listStatus(found[0].getPath()) if not s.getPath().getName().startswith(("_", ".")) and (s.isDirectory() or s.getLen())), key=lambda s: s.getPath().toString())
    if not found:
        raise FileNotFoundError(path)
    f = fs.open(found[0].getPath())
    try:
        data = bytes(f.readNBytes(size))
    finally:
        f.close()
    suffix = Path(found[0].getPath().getName()).suffix.lower()
    return OPENERS[suffix](io.BytesIO(data)).read(size) if suffix in OPENERS and len(data) < size else data


def sniff(sample: bytes, encoding: str = "utf-8", delimiters: Iterable[str] = ",;\t|"):
    """Dialect of a sample; a character that is cut off at its end is left out."""
    text = sample.decode(encoding, "ignore")
    try:
        d = csv.Sniffer().sniff(text, delimiters="".join(delimiters))
    except csv.Error:
        return csv.excel
    if not d.escapechar:
        d.doublequote = True
    if d.quotechar == "'" and d.quoting == csv.QUOTE_MINIMAL:
        d.quotechar = '"'
    return d


def _raw(path: str, encoding: str, dialect, spark: SparkSession | None = None) -> tuple[list[str], object]:
    sample = head_bytes(path, spark=spark)
    dialect = csv.get_dialect(dialect) if isinstance(dialect, str) else dialect or sniff(sample, encoding)
    names = next(csv.reader(sample.decode(encoding, "ignore").replace("\0", "").splitlines(True), dialect), [])
    return names, dialect


def inspect(path: str, encoding: str = "utf-8", dialect=None) -> dict:
    names, d = _raw(path, encoding, dialect)
    return {"encoding": encoding, "delimiter": d.delimiter, "quotechar": d.quotechar, "field_names": names}


def read_csv(spark: SparkSession, path: str, encoding: str = "utf-8", dialect=None, types: dict[str, str] | None = None, infer: bool = True, strict: bool = True, fields: list[str] | None = None, max_rows: int | None = None, multiline: bool | None = None, **how) -> DataFrame:
    """A file, a folder of files or a pattern, on any file system that Spark
    knows.  Header in the first record of each file.  An empty cell is an empty
    text; a cell that a short row lacks is null.  Records may span lines; such
    files can't be split, so without ``multiline`` the lines with an odd number
    of quotes are looked for first, in parallel: without any, files are split."""
    names, d = _raw(path, encoding, dialect, spark)
    columns = header(names)
    if Path(path).suffix == ".xz":  # Spark doesn't know it: one task a file

        def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for blob in b["content"]:
                    lines = csv.reader(lzma.decompress(blob).decode(encoding).replace("\0", "").splitlines(True), d)
                    next(lines, None)
                    yield pd.DataFrame([(r + [None] * len(columns))[: len(columns)] for r in lines], columns=columns)

        df = spark.read.format("binaryFile").load(path).select("content").mapInPandas(unpack, ", ".join(f"`{c}` string" for c in columns))
    else:
        if multiline is None:
            multiline = _spans_lines(spark, path, encoding, d.quotechar or '"')
        df = (
            spark.read.schema(", ".join(f"`{c}` string" for c in columns))
            .options(header=True, sep=d.delimiter, quote=d.quotechar or '"', escape=d.escapechar or '"', multiLine=multiline, encoding=encoding, nullValue="\0", emptyValue="", enforceSchema=True, mode="PERMISSIVE")
            .csv(path)
        )
    df = df.select(*(F.coalesce(F.replace(F.col(c), F.lit("\0"), F.lit("")), F.lit("")).alias(c) for c in columns))
    df = df.select(*fields) if fields else df
    df = df.limit(max_rows) if max_rows else df
    return typed(df, types, strict, **how) if infer else df


def _spans_lines(spark: SparkSession, path: str, encoding: str, quote: str) -> bool:
    """Whether a record goes on in the next line: some line has an odd number
    of quotes, or lone line ends of another kind."""
    if encoding.lower().replace("-", "") not in ("utf8", "ascii", "usascii", "latin1", "iso88591", "windows1252", "cp1252"):
        return True
    value = F.col("value")
    odd = (F.length(value) - F.length(F.replace(value, F.lit(quote), F.lit("")))) % 2 == 1
    return not spark.read.text(path).where(odd).limit(1).isEmpty()


def write_csv(df: DataFrame, path: str, **options) -> None:
    """A folder of parts, written in parallel."""
    shown(df).write.mode("overwrite").options(**{"header": True, "escape": '"', "emptyValue": "", "nullValue": "", **options}).csv(path)


def write_csv_file(df: DataFrame, path: str, dialect="excel", encoding: str = "utf-8", callback=None, batch: int = 100) -> None:
    """One file, streamed through the driver a partition at a time."""
    with open_any(path, "wt", encoding=encoding, newline="") as f:
        w = csv.writer(f, dialect)
        w.writerow(df.columns)
        done = 0
        for done, row in enumerate(shown(df).toLocalIterator(), 1):
            w.writerow(row)
            if callback and done % batch == 0:
                callback(done)
        if callback and done % batch:
            callback(done)


class DictWriter:
    """Rows as dicts into a CSV file; the first one gives the header."""

    def __init__(self, path: str, encoding: str = "utf-8", dialect="excel"):
        self.file, self.dialect, self.writer = open_any(path, "wt", encoding=encoding, newline=""), dialect, None

    def writerow(self, row: dict) -> None:
        if self.writer is None:
            self.writer = csv.DictWriter(self.file, list(row), dialect=self.dialect)
            self.writer.writeheader()
        self.writer.writerow(row)

    def close(self) -> None:
        self.file.close()

    __enter__ = lambda self: self

    def __exit__(self, *_):
        self.close()


def mend(rows: Iterable[list[str]]) -> Iterator[list[str]]:
    """Rows of a wrong number of cells are joined with those after them, as
    when a cell was broken by a line end."""
    rows = iter(rows)
    first = next(rows, None)
    if first is None:
        return
    yield first
    held: list[str] = []
    for row in rows:
        if len(row) == len(first):
            held = []
            yield row
            continue
        held = held[:-1] + [f"{held[-1]} {row[0]}"] + row[1:] if held and row else held or row
        if len(held) == len(first):
            yield held
            held = []


def mend_csv(source: str, target: str, encoding: str = "utf-8", dialect=None) -> None:
    """One file is one sequence: this runs where it is called."""
    d = sniff(head_bytes(source), encoding) if dialect is None else dialect
    with open_any(source, "rt", encoding=encoding, newline="") as f, open_any(target, "wt", encoding=encoding, newline="") as g:
        csv.writer(g).writerows(mend(csv.reader(f, d)))


def split_csv(spark: SparkSession, path: str, size: int, target: str, **how) -> DataFrame:
    """Folders part=1, part=2, ... of ``size`` rows each, with headers."""
    from ..operators.table import parts

    out = parts(read_csv(spark, path, infer=False, **how), size)
    out.write.mode("overwrite").partitionBy("part").option("header", True).csv(target)
    return out.groupBy("part").count()


# ---- drawn tables -----------------------------------------------------------

FRAMES = {"ascii": ("-", "|", "+"), "single": ("─", "│", "┼"), "double": ("═", "║", "╬")}
CORNERS = "+─│┌┐└┘├┤┬┴┼═║╔╗╚╝╠╣╦╩╬"


def style_of(line: str) -> str | None:
    return {"+": "ascii", "┌": "single", "│": "single", "╔": "double", "║": "double", "|": "ascii"}.get(line[:1])


def _drawn(line: str) -> bool:
    return bool(line.strip()) and not line.strip(CORNERS + "-| ")


def read_txt(spark: SparkSession, path: str, encoding: str = "utf-8", style: str | None = None, **how) -> DataFrame:
    """A drawn table; columns are cut where the header has its bars, or two
    blanks where there is no frame."""
    top = [x for x in head_bytes(path).decode(encoding, "ignore").splitlines() if x.strip()]
    style = style or (style_of(top[0]) if top else None)
    line = next((x for x in top if not _drawn(x)), "")
    if style:
        bars = [k for k, c in enumerate(line) if c == FRAMES[style.lower()][1]]
        cuts = [(a + 2, b - a - 1) for a, b in zip(bars, bars[1:])]
    else:
        begin = [0] + [k + 2 for k in range(len(line) - 2) if line[k : k + 2] == "  " and line[k + 2] != " "]
        cuts = [(a + 1, b - a) for a, b in zip(begin, [*begin[1:], 1 << 20])]
    columns = header(line[a - 1 : a - 1 + n].strip() for a, n in cuts)
    rows = spark.read.option("encoding", encoding).text(path).where(F.trim("value") != "").where(F.col("value") != line)
    rows = rows.where(F.translate("value", CORNERS + "-| ", "") != "") if style else rows
    return typed(rows.select(*(F.trim(F.substring("value", a, n)).alias(c) for c, (a, n) in zip(columns, cuts))), **how)


def to_txt(df: DataFrame, style: str | None = "ascii") -> str:
    """Drawn for reading; the table passes through the driver."""
    text = shown(df)
    size = text.agg(*(F.max(F.length(c)) for c in text.columns)).first()
    wide = [max(len(c), n or 0) for c, n in zip(text.columns, size)]
    lines = text.toLocalIterator()
    if not style or style.lower() == "none":
        body = ["  ".join(c.center(n) for c, n in zip(text.columns, wide)), *("  ".join(v.rjust(n) for v, n in zip(r, wide)) for r in lines)]
        return "\n".join(body) + "\n"
    style = style.lower()
    flat, bar, _ = FRAMES[style]
    edges = {"ascii": ["+++"] * 3, "single": ["┌┬┐", "├┼┤", "└┴┘"], "double": ["╔╦╗", "╠╬╣", "╚╩╝"]}[style]
    rule = [e[0] + e[1].join(flat * (n + 2) for n in wide) + e[2] for e in edges]
    row = lambda cells: f"{bar} " + f" {bar} ".join(cells) + f" {bar}"
    return "\n".join([rule[0], row(c.center(n) for c, n in zip(text.columns, wide)), rule[1], *(row(v.rjust(n) for v, n in zip(r, wide)) for r in lines), rule[2]]) + "\n"


# ---- JSON -------------------------------------------------------------------


def read_json(spark: SparkSession, path: str, encoding: str = "utf-8", infer: bool = True, **how) -> DataFrame:
    """An array of objects; columns in the order in which keys appear."""
    whole = spark.read.option("encoding", encoding).text(path, wholetext=True)
    rows = whole.select(F.posexplode(F.from_json("value", "array<map<string,string>>")).alias("i", "m"))
    seen = rows.select("i", F.posexplode(F.map_keys("m")).alias("k", "name")).groupBy("name").agg(F.min(F.struct("i", "k")).alias("at")).orderBy("at")
    keys = [r["name"] for r in seen.collect()]  # they become columns
    df = rows.orderBy("i").select(*(F.col("m")[k].alias(c) for k, c in zip(keys, header(keys))))
    return typed(df, **how) if infer else df


def read_json_lines(spark: SparkSession, path: str, encoding: str = "utf-8", infer: bool = True, **how) -> DataFrame:
    """One object a line, in one file or many; columns in the order of their
    names, as lines have none among files.  Lines are read in parallel."""
    rows = spark.read.option("encoding", encoding).text(path).where(F.trim("value") != "").select(F.from_json("value", "map<string,string>").alias("m"))
    keys = sorted(r["name"] for r in rows.select(F.explode(F.map_keys("m")).alias("name")).distinct().collect())  # they become columns
    df = rows.select(*(F.col("m")[k].alias(c) for k, c in zip(keys, header(keys))))
    return typed(df, **how) if infer else df


def native_json(df: DataFrame) -> DataFrame:
    """One object a row as text: numbers, booleans and JSON as they are, other
    values as the text of their field."""
    from ..functions.types import FIELDS, field_of

    cols = []
    for f in df.schema:
        kind = f.metadata.get("field") or field_of(f.dataType.simpleString()).name
        c = F.col(f"`{f.name}`")
        plain = kind in ("bool", "integer", "float", "text")
        cols.append((F.parse_json(c) if kind == "json" else c if plain else F.when(c.isNotNull(), FIELDS[kind].show(c))).alias(f.name))
    return df.select(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias("value"))


def write_json_lines(df: DataFrame, path: str) -> None:
    native_json(df).write.mode("overwrite").text(path)


def write_json_file(df: DataFrame, path: str, indent: int | None = None) -> None:
    with open_any(path, "wt", encoding="utf-8") as f:
        f.write("[")
        for k, row in enumerate(native_json(df).toLocalIterator()):
            f.write(("," if k else "") + json.dumps(json.loads(row[0]), indent=indent))
        f.write("]")


def from_dicts(spark: SparkSession, rows: list[dict], samples: int | None = None, **how) -> DataFrame:
    keys = list(dict.fromkeys(k for r in rows[:samples] for k in r))
    text = [[None if r.get(k) is None else r[k] if isinstance(r[k], str) else json.dumps(r[k]) if isinstance(r[k], (list, dict)) else str(r[k]) for k in keys] for r in rows]
    return typed(spark.createDataFrame(text, ", ".join(f"`{c}` string" for c in header(keys))), **how)


def to_dicts(df: DataFrame) -> list[dict]:
    return [r.asDict() for r in df.toLocalIterator()]
