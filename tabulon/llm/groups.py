"""Distributed building blocks shared by the operators of this folder."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .session import Scratch


def lean(fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``fn``, and what it has freed goes back to the system when a task ends:
    workers are reused, so it would count beside the needs of later stages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from fn(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc
            if trim is not None:
                trim(0)

    return run


def by_key(df: DataFrame, key: str, fn: Callable[[pa.Table], pa.Table], schema: str, n: int) -> DataFrame:
    """Apply ``fn`` to tables that hold whole groups of ``key``, many groups
    at a time, in order of the key.  One shuffle; a task holds one batch and
    the group that is still open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            k = b.column(key)
            if held and held[-1].column(key)[-1] == k[0] and k[0] == k[-1]:
                held.append(b)
                continue
            cut = b.num_rows - 1
            last = k[cut]
            while cut > 0 and k[cut - 1] == last:
                cut -= 1
            whole = held + ([b.slice(0, cut)] if cut else [])
            if whole:
                yield from fn(pa.Table.from_batches(whole).combine_chunks()).to_batches()
            held = [b.slice(cut)]
        if held:
            yield from fn(pa.Table.from_batches(held).combine_chunks()).to_batches()

    return df.repartition(n, key).sortWithinPartitions(key).mapInArrow(lean(run), schema)


#: Bits of a sieve: at most SIEVE / 64 rows of 16 bytes, whatever the input.
SIEVE = 1 << 24


def unused(df: DataFrame) -> str:
    """Underscores that no column of ``df`` begins with, to name new ones."""
    p = "__"
    while any(c.startswith(p) for c in df.columns):
        p += "_"
    return p


def sifted(df: DataFrame, key: Column, wanted: DataFrame, of: Column, p: str = "__") -> DataFrame:
    """``df`` with a column ``p``maybe: false only for rows whose ``key`` is in no
    row of ``wanted`` (``of``, both bigint).  A bitmap of fixed size is
    broadcast, so rows that a later join would drop needn't be shuffled; when
    the bitmap is full, all rows are."""
    at = lambda c: F.pmod(c, F.lit(SIEVE))
    words = wanted.select(at(of).alias("b")).groupBy(F.shiftright("b", 6).alias(f"{p}word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("b").cast("int").bitwiseAND(63))).alias(f"{p}bits"))
    df = df.withColumn(f"{p}at", at(key)).withColumn(f"{p}word", F.shiftright(f"{p}at", 6))
    df = df.join(F.broadcast(words), f"{p}word", "left")  # at most SIEVE / 64 rows
    return df.withColumn(f"{p}maybe", F.coalesce(F.getbit(f"{p}bits", F.col(f"{p}at").cast("int").bitwiseAND(63)) == 1, F.lit(False))).drop(f"{p}at", f"{p}word", f"{p}bits")


def components(scratch: Scratch, edges: DataFrame, name: str) -> DataFrame:
    """(v, root): the least member of each connected component, by alternating
    large-star and small-star steps (Kiveris et al., 2014).  ``edges`` has
    columns a and b of one orderable type; vertices without an edge between
    different ends are left out."""
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct()
    e = scratch.keep(e, f"{name}-0")
    seen, step = None, 0
    while True:
        both = e.union(e.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("m"))
        large = both.join(least, "v").where("u > v").select(F.col("u").alias("v"), F.col("m").alias("u"))
        # small star: each vertex passes its least neighbour to the others
        large = large.where("v <> u").distinct()
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(low, "v").select(F.explode(F.array(F.struct("v", F.col("m").alias("u")), F.struct(F.col("u").alias("v"), F.col("m").alias("u")))).alias("x")).select("x.v", "x.u")
        step += 1
        e = scratch.keep(small.where("v <> u").distinct(), f"{name}-{step}")
        now = e.agg(F.count("*"), F.sum(F.hash("v", "u").cast("long"))).first()
        scratch.drop(f"{name}-{step - 1}")
        if tuple(now) == seen:
            return e.select("v", F.col("u").alias("root"))
        seen = tuple(now)
