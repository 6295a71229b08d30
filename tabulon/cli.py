"""Command line: ``python -m tabulon.cli COMMAND ...``."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .functions.types import ALL
from .operators import table as T
from .plans import schema, sql
from .sources import database, files, read, sheets, write


def parse_options(options: list[str] | None) -> dict[str, str | int | bool]:
    """["name=value", ...] by their first "="; whole numbers, true and false
    become values."""
    out = {}
    for o in options or []:
        name, mark, value = o.partition("=")
        if not mark:
            raise ValueError(f"Option {o!r} has no '='")
        out[name.strip()] = int(value) if value.lstrip("-").isdigit() else {"true": True, "false": False}.get(value.lower(), value)
    return out


def _arguments(argv):
    p = argparse.ArgumentParser(prog="tabulon")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name, *args, **options):
        c = sub.add_parser(name)
        for a in args:
            c.add_argument(a, nargs="+" if a == "sources" else None)
        for k, v in options.items():
            c.add_argument("--" + k.replace("_", "-"), **v)

    several = {"action": "append", "metavar": "NAME=VALUE"}
    into = {"input_encoding": {}, "samples": {"type": int}, "table_index": {"type": int}, "input_option": several}
    out = {"order_by": {}, "fields": {}, "fields_exclude": {}, "output_option": several, **into}
    command("convert", "source", "target", **out)
    command("join", "keys", "sources", "target", **out)
    command("sum", "sources", "target", **out)
    command("print", "source", frame_style={"default": "ascii"}, **out)
    command("query", "sql", "sources", output={}, frame_style={"default": "ascii"}, **out)
    command("schema", "source", "target", **into, format={"default": "txt"}, detect_all_types={"action": "store_true"})
    command("csv-inspect", "source")
    command("csv-fix", "source", "target")
    command("csv-merge", "sources", "target")
    command("csv-clean", "source", "target")
    command("csv-row-count", "source")
    command("csv-split", "source", "lines", "target")
    command("list-sheets", "source")
    command("csv-to-sqlite", "source", "target", table={"default": None})
    command("sqlite-to-csv", "source", "table", "target")
    command("pgimport", "source", "url", "table")
    command("pgexport", "url", "table", "target")
    command("pg2pg", "source", "target", "table", query={"default": None})
    return p.parse_args(argv)


def _shaped(df, a):
    if a.order_by:
        df = T.order_by(df, *a.order_by.split(","))
    if a.fields:
        df = T.project(df, a.fields.split(","))
    return T.exclude(df, a.fields_exclude.split(",")) if a.fields_exclude else df


def _reading(a) -> dict:
    """Options for the readers."""
    out = parse_options(a.input_option)
    return out | {k: v for k, v in (("encoding", a.input_encoding), ("samples", a.samples), ("index", a.table_index)) if v is not None}


def main(argv=None) -> int:
    a = _arguments(argv)
    if a.command == "csv-inspect":
        print(files.inspect(a.source))
        return 0
    if a.command == "csv-fix":
        files.mend_csv(a.source, a.target)
        return 0
    if a.command == "list-sheets":
        print(*sheets.list_sheets(a.source), sep="\n")
        return 0
    spark = SparkSession.builder.appName("tabulon").getOrCreate()
    try:
        return _run(spark, a)
    except ValueError as x:
        print(x, file=sys.stderr)
        return 1


def _run(spark, a) -> int:
    raw = lambda p: files.read_csv(spark, p, infer=False)
    get = lambda p, **how: read(spark, p, **how, **_reading(a))
    put = lambda df, p: write(df, p, **parse_options(a.output_option))
    if a.command == "convert":
        put(_shaped(get(a.source), a), a.target)
    elif a.command == "join":
        put(_shaped(T.merge_join(a.keys.split(","), [get(s) for s in a.sources]), a), a.target)
    elif a.command == "sum":
        put(_shaped(T.append(*(get(s) for s in a.sources)), a), a.target)
    elif a.command == "print":
        print(files.to_txt(_shaped(get(a.source), a), a.frame_style), end="")
    elif a.command == "query":
        df = _shaped(sql.query(spark, a.sql, *(get(s) for s in a.sources)), a)
        put(df, a.output) if a.output else print(files.to_txt(df, a.frame_style), end="")
    elif a.command == "schema":
        df = get(a.source, **({"candidates": ALL} if a.detect_all_types else {}))
        with open(a.target, "w", encoding="utf-8") as f:
            f.write(schema.describe(df, a.format))
    elif a.command == "csv-merge":
        write(T.append_by_name(*(raw(s) for s in a.sources), tidy=True), a.target, "csv")
    elif a.command == "csv-clean":
        write(T.tidy(raw(a.source)), a.target, "csv")
    elif a.command == "csv-row-count":
        print(raw(a.source).count())
    elif a.command == "csv-split":
        files.split_csv(spark, a.source, int(a.lines), a.target)
    elif a.command == "csv-to-sqlite":
        database.write_sqlite(read(spark, a.source, "csv"), a.target, a.table, batch=10_000)
    elif a.command == "sqlite-to-csv":
        write(database.read_sqlite(spark, a.source, a.table, infer=False), a.target, "csv")
    elif a.command == "pgimport":
        database.write_jdbc(read(spark, a.source, "csv"), a.url, a.table)
    elif a.command == "pgexport":
        write(database.read_jdbc(spark, a.url, a.table), a.target, "csv")
    elif a.command == "pg2pg":
        database.copy_jdbc(spark, a.source, a.query or f"SELECT * FROM {database.checked(a.table)}", a.target, a.table)
    return 0


if __name__ == "__main__":
    sys.exit(main())
