"""Schemas as text, CSV, SQL or a model class."""

from __future__ import annotations

import csv
import io

from pyspark.sql import DataFrame

from ..functions.types import FIELDS, field_of


def field_names(df: DataFrame) -> dict[str, str]:
    return {f.name: f.metadata.get("field") or field_of(f.dataType.simpleString()).name for f in df.schema}


def describe(df: DataFrame, kind: str = "txt", name: str = "table1") -> str:
    types = field_names(df)
    if kind == "txt":
        rows = [("field_name", "field_type"), *types.items()]
        w = [max(len(r[k]) for r in rows) for k in (0, 1)]
        rule = f"+-{'-' * w[0]}-+-{'-' * w[1]}-+"
        lines = [f"| {a.rjust(w[0])} | {b.rjust(w[1])} |" for a, b in rows]
        return "\n".join([rule, lines[0], rule, *lines[1:], rule]) + "\n"
    if kind == "csv":
        out = io.StringIO()
        csv.writer(out).writerows([("field_name", "field_type"), *types.items()])
        return out.getvalue()
    if kind == "sql":
        return f"CREATE TABLE IF NOT EXISTS {name} (\n    " + ",\n    ".join(f"{c} {FIELDS[k].sql}" for c, k in types.items()) + "\n);\n"
    if kind == "django":
        body = [f"    {c} = models.{FIELDS[k].django}({'max_digits=38, decimal_places=8' if FIELDS[k].django == 'DecimalField' else ''})" for c, k in types.items()]
        return "\n".join([f"class {''.join(x.capitalize() for x in name.split('_'))}(models.Model):", *body]) + "\n"
    raise ValueError(f"Unknown kind of schema: {kind}")


def load(path: str) -> dict[str, str]:
    """{field: type} from a CSV with field_name and field_type."""
    with open(path, newline="", encoding="utf-8") as f:
        found = {r["field_name"]: r["field_type"] for r in csv.DictReader(f)}
    if unknown := {k for k in found.values() if k not in FIELDS}:
        raise ValueError(f"Unknown types: {', '.join(sorted(unknown))}")
    return found
