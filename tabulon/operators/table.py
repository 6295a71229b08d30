"""The table algebra.  Operators that need an order take the column that gives
it; without one it is the order in which Spark reads the rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .infer import typed

POS = "__pos"


def _known(df: DataFrame, names: Sequence[str]) -> None:
    if missing := [n for n in names if n not in df.columns]:
        raise ValueError(f"Invalid field names: {', '.join(missing)}")


def project(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    _known(df, fields)
    return df.select(*fields)


def exclude(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    _known(df, fields)
    return df.drop(*fields)


def keys_of(order: str | Sequence[str] | None, marks: str = "-^") -> list[Column]:
    """'-a' and '^a' mean descending."""
    return [F.col(k.lstrip(marks)).desc() if k[0] in marks else F.col(k).asc() for k in ([order] if isinstance(order, str) else order or [])]


def order_by(df: DataFrame, *keys: str, tie: str | None = None) -> DataFrame:
    """Nulls come first, descending last; ``tie`` makes it stable."""
    _known(df, [k.lstrip("-^") for k in keys])
    return df.orderBy(*keys_of(keys), *([tie] if tie else []))


def numbered(df: DataFrame, order: str | Sequence[str] | None = None) -> DataFrame:
    """With the position of each row in ``__pos``, from 0, made in parallel:
    rows are numbered within sorted partitions and shifted by the counts of
    the partitions before."""
    if order is not None:
        df = df.orderBy(*keys_of(order))
    schema = df.schema
    spark = df.sparkSession
    from pyspark.sql import types as T

    out = T.StructType([*schema.fields, T.StructField(POS, T.LongType())])
    return spark.createDataFrame(df.rdd.zipWithIndex().map(lambda x: (*x[0], x[1])), out)


def head(df: DataFrame, n: int = 10, order=None) -> DataFrame:
    return (df.orderBy(*keys_of(order)) if order else df).limit(n)


def tail(df: DataFrame, n: int = 10, order=None) -> DataFrame:
    """The last n rows: one sort by the reversed keys, cut by each task."""
    if order is None:
        d = numbered(df)
        return d.orderBy(F.desc(POS)).limit(n).orderBy(POS).drop(POS)
    flip = [k[1:] if k[0] in "-^" else f"-{k}" for k in ([order] if isinstance(order, str) else order)]
    return df.orderBy(*keys_of(flip)).limit(n).orderBy(*keys_of(order))


def rows(df: DataFrame, start: int = 0, stop: int | None = None, step: int = 1, order=None) -> DataFrame:
    """The slice [start:stop:step]; negative bounds count from the end."""
    if step < 1:
        raise ValueError("The step must be positive")
    d = numbered(df, order)
    if start < 0 or (stop or 0) < 0:
        n = df.count()
        start, stop = max(0, start + n) if start < 0 else start, max(0, stop + n) if stop is not None and stop < 0 else stop
    keep = (F.col(POS) >= start) & ((F.col(POS) - start) % step == 0)
    return d.where(keep if stop is None else keep & (F.col(POS) < stop)).drop(POS)


def delete_row(df: DataFrame, i: int, order=None) -> DataFrame:
    return numbered(df, order).where(F.col(POS) != i).drop(POS)


def set_row(df: DataFrame, i: int, values: dict, order=None) -> DataFrame:
    _known(df, list(values))
    d = numbered(df, order)
    kinds = dict(df.dtypes)
    return d.select(*(F.when(F.col(POS) == i, F.lit(values[c]).cast(kinds[c])).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in df.columns))


def insert_row(df: DataFrame, i: int, values: dict, order=None) -> DataFrame:
    _known(df, list(values))
    kinds = dict(df.dtypes)
    d = numbered(df, order).withColumn(POS, F.when(F.col(POS) >= i, F.col(POS) + 1).otherwise(F.col(POS)))
    new = df.sparkSession.range(1).select(*(F.lit(values.get(c)).cast(kinds[c]).alias(c) for c in df.columns), F.lit(i).cast("long").alias(POS))
    return d.union(new).orderBy(POS).drop(POS)


def set_column(df: DataFrame, name: str, value: Column | Sequence, order=None) -> DataFrame:
    """Add or replace a column by an expression, or by a list of values."""
    if isinstance(value, Column):
        return df.withColumn(name, value)
    if len(value) != df.count():
        raise ValueError("The values are not as many as the rows")
    new = df.sparkSession.createDataFrame(pd.DataFrame({POS: range(len(value)), name: list(value)}))
    return numbered(df.drop(name), order).join(new, POS, "left").orderBy(POS).drop(POS)


def append(*tables: DataFrame) -> DataFrame:
    """All rows of tables with equal columns in equal order."""
    first = tables[0]
    for t in tables[1:]:
        if t.dtypes != first.dtypes:
            raise ValueError("Tables have incompatible fields")
    return reduce(DataFrame.union, tables)


def append_by_name(*tables: DataFrame, tidy: bool = False) -> DataFrame:
    """All rows; columns are the union of the names.  ``tidy`` strips texts and
    drops rows without any value."""
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
    return trimmed(out) if tidy else out


def trimmed(df: DataFrame) -> DataFrame:
    kinds = dict(df.dtypes)
    out = df.select(*(F.trim(F.col(c)).alias(c) if kinds[c] == "string" else F.col(c) for c in df.columns))
    return out.where(reduce(lambda a, b: a | b, (F.coalesce(F.col(c).cast("string"), F.lit("")) != "" for c in out.columns)))


def tidy(df: DataFrame) -> DataFrame:
    """Names as slugs, texts stripped, without empty rows and empty columns."""
    from ..functions.naming import header

    out = trimmed(df.toDF(*header(df.columns)))
    empty = out.agg(*(F.coalesce(F.bool_and(F.coalesce(F.col(c).cast("string"), F.lit("")) == ""), F.lit(False)).alias(c) for c in out.columns)).first()
    return out.drop(*(c for c in out.columns if empty[c]))


def merge_join(keys: Sequence[str], tables: Sequence[DataFrame], order: Sequence[str | None] | None = None, position: bool = False) -> DataFrame:
    """Rows of all tables grouped by key: in a group the last table's last row
    with a column decides its value, null or not.  Equal keys become one row,
    null keys are equal.  One shuffle, with partial aggregation before it."""
    if not tables:
        raise ValueError("There are no tables")
    names: dict[str, str] = {}
    for t in tables:
        _known(t, keys)
        names |= dict(t.dtypes)
    order = order or [None] * len(tables)
    parts = []
    for k, (t, by) in enumerate(zip(tables, order)):
        at = F.struct(F.lit(k).alias("t"), (F.col(by).cast("long") if by else F.monotonically_increasing_id()).alias("p"))
        parts.append(t.select(*(F.col(c).try_cast(kind).alias(c) if dict(t.dtypes).get(c, kind) != kind else F.col(c) if c in t.columns else F.lit(None).cast(kind).alias(c) for c, kind in names.items()), at.alias("__at")))
    every = reduce(DataFrame.union, parts)
    aggs = []
    for c in names:
        if c not in keys:
            has = [k for k, t in enumerate(tables) if c in t.columns]
            at = F.col("__at") if len(has) == len(tables) else F.when(F.col("__at.t").isin(*has), F.col("__at"))
            aggs.append(F.max_by(F.struct(F.col(c).alias("v")), at).alias(c))
    out = every.groupBy(*keys).agg(*aggs, F.min("__at").alias("__at"))
    out = out.select(*(F.col(c) if c in keys else F.col(f"{c}.v").alias(c) for c in names), "__at")
    return out.withColumnRenamed("__at", POS) if position else out.drop("__at")


def transform(fields: dict[str, str], function: Callable[[dict], dict | None], *tables: DataFrame) -> DataFrame:
    """Any Python function of a row; a falsy result drops the row.  Batches of
    rows are converted by Arrow."""
    schema = ", ".join(f"`{k}` {v}" for k, v in fields.items())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [x for x in map(function, b.to_dict("records")) if x]
            yield pd.DataFrame({k: [x.get(k) for x in got] for k in fields})

    return reduce(DataFrame.union, (t.mapInPandas(run, schema) for t in tables))


def transpose(df: DataFrame, names: str, infer: bool = True) -> DataFrame:
    """Values of ``names`` become columns, the other columns rows, in order.
    The names must differ and be few enough to be columns."""
    _known(df, [names])
    rest = [c for c in df.columns if c != names]
    found = [r[0] for r in df.select(F.col(names).cast("string")).collect()]  # they become columns
    if len(set(found)) < len(found):
        raise ValueError("Values that become columns are repeated")
    long = df.select(F.col(names).cast("string").alias("__name"), F.posexplode(F.array(*(F.col(c).cast("string") for c in rest))).alias("__row", "__value"))
    out = long.groupBy("__row").pivot("__name", found).agg(F.first("__value")).orderBy("__row").drop("__row")
    return typed(out) if infer else out


def unique_values(df: DataFrame, column: str, order: str | None = None) -> DataFrame:
    """Distinct values that aren't null, in order of first appearance."""
    at = F.col(order) if order else F.monotonically_increasing_id()
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.min(at).alias(POS)).orderBy(POS).drop(POS)


def widths(df: DataFrame) -> DataFrame:
    """The longest text of each column, its name included."""
    one = df.agg(*(F.greatest(F.lit(len(c)), F.coalesce(F.max(F.length(F.col(c).cast("string"))), F.lit(0))).alias(c) for c in df.columns))
    return one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).cast("long").alias("width")) for c in df.columns))).alias("x")).select("x.*")


def parts(df: DataFrame, size: int, order=None) -> DataFrame:
    """With the number, from 1, of the part of ``size`` rows it belongs to."""
    return numbered(df, order).withColumn("part", F.floor(F.col(POS) / size) + 1).drop(POS)


def where(df: DataFrame, predicate: str | Column) -> DataFrame:
    return df.where(predicate)


def first_last_seen(df: DataFrame, key: str, order: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(order)
    return df.withColumn("seen", F.row_number().over(w))


def preview(df: DataFrame, n: int = 20) -> str:
    """HTML of a table: up to n rows whole, else its first and last ten."""
    from ..sources.markup import to_html

    total = df.count()
    if total <= n:
        return to_html(df)
    dots = df.sparkSession.createDataFrame([tuple("..." for _ in df.columns)], ", ".join(f"`{c}` string" for c in df.columns))
    text = lambda d: d.select(*(F.col(c).cast("string").alias(c) for c in d.columns))
    return to_html(text(head(df, 10)).union(dots).union(text(tail(df, 10))), caption=f"{total} rows")
