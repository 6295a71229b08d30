"""Which reader and writer a name asks for."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..shipping import ship
from . import database, files, markup, sheets

MAGIC = ((b"PAR1", "parquet"), (b"SQLite format 3", "sqlite"), (b"%PDF", "pdf"), (b"\xd0\xcf\x11\xe0", "xls"))
SUFFIX = {".csv": "csv", ".tsv": "csv", ".txt": "txt", ".json": "json", ".jsonl": "jsonl", ".ndjson": "jsonl", ".html": "html", ".htm": "html", ".parquet": "parquet", ".sqlite": "sqlite", ".db": "sqlite", ".xlsx": "xlsx", ".ods": "ods", ".xls": "xls", ".pdf": "pdf", ".xml": "xpath"}
READERS = {"csv": files.read_csv, "txt": files.read_txt, "json": files.read_json, "jsonl": files.read_json_lines, "html": markup.read_html, "xpath": markup.read_xpath, "sqlite": database.read_sqlite, "xlsx": sheets.read_sheet, "ods": sheets.read_sheet}

WRITERS = {"csv": files.write_csv_file, "json": files.write_json_file, "jsonl": files.write_json_lines, "sqlite": database.write_sqlite, "xlsx": sheets.write_xlsx, "jdbc": database.write_jdbc}


def register(kind: str, reader=None, writer=None, suffixes: tuple[str, ...] = (), magic: tuple[bytes, ...] = ()) -> None:
    """A format of one's own: reader(spark, path, **options) returns a
    DataFrame, writer(df, path, **options) writes one; files with a suffix or
    first bytes are taken for it."""
    global MAGIC
    if reader is not None:
        READERS[kind] = reader
    if writer is not None:
        WRITERS[kind] = writer
    SUFFIX.update({s.lower(): kind for s in suffixes})
    MAGIC += tuple((m, kind) for m in magic)


def kind_of(path: str) -> str:
    if path.startswith(("postgres://", "postgresql://", "jdbc:")):
        return "jdbc"
    suffixes = [s.lower() for s in Path(path).suffixes]
    if suffixes and suffixes[-1] in files.OPENERS:
        suffixes.pop()
    if suffixes and suffixes[-1] in SUFFIX:
        return SUFFIX[suffixes[-1]]
    if Path(files.local(path)).is_file():
        head = files.head_bytes(path, 64)
        for mark, kind in MAGIC:
            if head.startswith(mark):
                return kind
    raise ValueError(f"The format of {path} isn't known")


def read(spark: SparkSession, path: str, kind: str | None = None, **options) -> DataFrame:
    ship(spark)
    kind = kind or kind_of(path)
    if kind == "parquet":
        return spark.read.parquet(path)
    if kind == "jdbc":
        return database.read_jdbc(spark, path if path.startswith("jdbc:") else "jdbc:postgresql://" + path.split("://", 1)[1], **options)
    if kind not in READERS:
        raise ValueError(f"{kind}: no library for this format is installed")
    return READERS[kind](spark, path, **options)


def write(df: DataFrame, path: str, kind: str | None = None, **options) -> None:
    kind = kind or kind_of(path)
    if kind in ("txt", "html"):
        text = files.to_txt(df, **options) if kind == "txt" else markup.to_html(df, **options)
        with files.open_any(path, "wt", encoding="utf-8") as f:
            f.write(text)
    elif kind == "parquet":
        df.write.mode("overwrite").parquet(path)
    else:
        if kind not in WRITERS:
            raise ValueError(f"{kind}: there is no writer for this format")
        WRITERS[kind](df, path, **options)
