"""Compare a registered query with its SQL in DuckDB."""

from __future__ import annotations

import datetime as dt
import decimal
import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    return str(v) if v.__class__.__name__ == "UUID" else v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in rows), key=repr)


def oracle(sf: str, sql: str):
    db = duckdb.connect()
    for t in TABLES:
        if Path(f"{sf}/{t}.parquet").exists():
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    c = db.execute(sql)
    names = [x[0] for x in c.description]
    return sorted(names), rows_of(names, c.fetchall())


def same(df, sf: str, sql: str) -> None:
    names, want = oracle(sf, sql)
    assert sorted(df.columns) == names, (sorted(df.columns), names)
    got = rows_of(df.columns, df.collect())
    assert got == want, next(((a, b) for a, b in zip(got, want) if a != b), (len(got), len(want)))
