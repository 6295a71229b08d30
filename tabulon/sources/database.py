"""SQLite by ranges of row ids, and other databases by JDBC."""

from __future__ import annotations

import re
import sqlite3
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from ..functions.naming import header
from ..operators.infer import typed
from .files import local

SQLITE = {"bool": "INTEGER", "integer": "INTEGER", "date": "TEXT", "datetime": "TEXT", "text": "TEXT", "decimal": "REAL", "float": "REAL", "percent": "REAL", "binary": "BLOB"}


def checked(name: str) -> str:
    """A table name that can stand in SQL."""
    if not re.fullmatch(r"[A-Za-z_]\w*", name):
        raise ValueError(f"Not a table name: {name}")
    return name


def read_sqlite(spark: SparkSession, path: str, table: str = "table1", query: str | None = None, args: tuple = (), tasks: int = 8, infer: bool = True, **how) -> DataFrame:
    """A table, read in parallel by ranges of row ids, or a query's result."""
    at = local(path)
    db = sqlite3.connect(at)
    sql = query or f'SELECT * FROM "{checked(table)}"'
    cursor = db.execute(f"SELECT * FROM ({sql}) LIMIT 0", args)
    names = [c[0] for c in cursor.description]
    ranged = False
    if query is None:
        try:
            low, high = db.execute(f'SELECT min(rowid), max(rowid) FROM "{table}"').fetchone()
            ranged = low is not None
        except sqlite3.OperationalError:  # a table without row ids
            pass
    db.close()
    step = -(-(high - low + 1) // tasks) if ranged else 0
    tasks_ = [(f"{sql} WHERE rowid >= {a} AND rowid < {a + step}",) for a in range(low, high + 1, step)] if ranged else [(sql,)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with sqlite3.connect(f"file:{at}?mode=ro", uri=True) as db:
            for b in batches:
                for q in b["q"]:
                    c = db.execute(q, args if q == sql else ())
                    while got := c.fetchmany(10_000):
                        yield pd.DataFrame([[v if v is None or isinstance(v, str) else v.hex() if isinstance(v, bytes) else str(v) for v in r] for r in got], columns=names)

    df = spark.createDataFrame(tasks_, "q string").repartition(len(tasks_)).mapInPandas(run, ", ".join(f"`{c}` string" for c in header(names)))
    return typed(df, **how) if infer else df


def write_sqlite(df: DataFrame, path: str, table: str | None = None, batch: int = 100, callback=None) -> str:
    """Append to a table, or make the first free ``table{n}``.  SQLite has one
    writer: rows stream through the driver."""
    from ..functions.types import field_of

    with sqlite3.connect(local(path)) as db:
        if table is None:
            taken = {r[0] for r in db.execute("SELECT name FROM sqlite_master WHERE type = 'table'")}
            table = next(f"table{k}" for k in range(1, len(taken) + 2) if f"table{k}" not in taken)
        fields = [f.metadata.get("field") or field_of(f.dataType.simpleString()).name for f in df.schema]
        columns = ", ".join(f'"{c}" {SQLITE.get(k, "TEXT")}' for c, k in zip(df.columns, fields))
        db.execute(f'CREATE TABLE IF NOT EXISTS "{checked(table)}" ({columns})')
        plain = [c if SQLITE.get(k) in ("INTEGER", "BLOB") else f"CAST(`{c}` AS {'DOUBLE' if SQLITE.get(k) == 'REAL' else 'STRING'}) AS `{c}`" for c, k in zip(df.columns, fields)]
        put, held, done = f'INSERT INTO "{table}" VALUES ({", ".join("?" * len(fields))})', [], 0
        for row in df.selectExpr(*plain).toLocalIterator():
            held.append(tuple(row))
            if len(held) >= batch:
                db.executemany(put, held)
                done, held = done + len(held), []
                if callback:
                    callback(done)
        db.executemany(put, held)
        if callback and held:
            callback(done + len(held))
    return table


def read_jdbc(spark: SparkSession, url: str, table: str | None = None, query: str | None = None, column: str | None = None, low=None, high=None, tasks: int = 8, **options) -> DataFrame:
    """Needs the database's driver on the class path.  With ``column`` the
    table is read in ranges of it."""
    r = spark.read.format("jdbc").options(url=url, **options).option(*(("query", query) if query else ("dbtable", table or "table1")))
    return (r.options(partitionColumn=column, lowerBound=low, upperBound=high, numPartitions=tasks) if column else r).load()


def write_jdbc(df: DataFrame, url: str, table: str, mode: str = "append", **options) -> None:
    df.write.format("jdbc").options(url=url, dbtable=table, **options).mode(mode).save()


def copy_jdbc(spark: SparkSession, source: str, query: str, target: str, table: str, **options) -> None:
    write_jdbc(read_jdbc(spark, source, query=query, **options), target, table, **options)


POSTGRES = {"bool": "BOOLEAN", "integer": "BIGINT", "big_integer": "NUMERIC", "float": "REAL", "decimal": "NUMERIC", "percent": "REAL", "date": "DATE", "datetime": "TIMESTAMP(0) WITHOUT TIME ZONE", "json": "JSONB", "uuid": "UUID", "binary": "BYTEA"}


def create_sql(types: dict[str, str], table: str, unlogged: bool = False) -> str:
    columns = ", ".join(f'"{c}" {POSTGRES.get(k, "TEXT")}' for c, k in types.items())
    return f'CREATE {"UNLOGGED " if unlogged else ""}TABLE IF NOT EXISTS "{checked(table)}" ({columns})'
