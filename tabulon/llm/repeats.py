"""Substring deduplication by seed and extend.

Words are runs of bytes other than ASCII white space, compared exactly.  Every
window of ``least`` words has a seed, the k-word gram with the least hash in
it (winnowing), so equal windows share their seed and its place in them.
Documents are joined on seeds; around each seed the match is extended to both
sides over all windows that have this seed, and matches that continue across
seeds at the same displacement are joined into one.  Each match refers to the
first occurrence of its windows, in order of doc_id, text hash and position,
so a passage with m copies gives m-1 rows rather than m*m/2; no occurrence is
left out.

Scale: one shuffle by seed.  A document sends the hashes of its windows, each
once, together with their seed (about 8 bytes a word); nothing is broadcast.

Defined results: null and empty texts and those under ``least`` words have no
repeats; a null doc_id takes no part; rows that repeat doc_id and text are one
document; a document can repeat itself.  Other columns are ignored.  Equality
of windows is equality of 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import kernel as K
from .groups import by_key
from .session import parallel, ship

LEAST, GRAM = 50, 25


def identified(docs: DataFrame) -> DataFrame:
    """(doc_id, h, text) of the rows that have a doc_id; h is xxhash64."""
    d = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return d.select("doc_id", F.xxhash64("text").alias("h"), "text")


def seeds(h: np.ndarray, at: np.ndarray, least: int, gram: int):
    """Of each run of windows with one seed: seed hash, first window (index of
    its first word), number of windows; and the valid windows' flags."""
    ok = K.room(at, least)
    g = K.rolling(h, gram)
    m = K.winnow(g, least - gram + 1)
    if not len(m):
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), z, z, ok
    new = np.ones(len(m), bool)
    new[1:] = (m[1:] != m[:-1]) | ~ok[:-1] | ~ok[1:]
    new &= ok
    first = np.flatnonzero(new)
    stop = np.append(first[1:], len(m))
    bad = np.flatnonzero(~ok)
    nxt = np.append(bad, len(m))[np.searchsorted(bad, first)]
    return g[m[first]], first, np.minimum(stop, nxt) - first, ok


def _emit(least: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, h, _, _, at in K.tokens(K.strings(b.column("text"))):
                seed, first, count, _ = seeds(h, at, least, gram)
                if not len(seed):
                    continue
                w = K.rolling(h, least)
                o = np.concatenate([[0], np.cumsum(count)])
                index = np.repeat(first - o[:-1], count) + np.arange(o[-1])
                doc = np.searchsorted(at, first, "right") - 1
                take = pa.array(doc + i)
                yield pa.RecordBatch.from_arrays([pa.array(seed.view(np.int64)), b.column("doc_id").take(take), b.column("h").take(take), pa.array((first - at[doc]).astype(np.int32)), K.lists(w[index], o)], ["seed", "doc_id", "h", "p", "w"])

    return run


def _match(t: pa.Table) -> pa.Table:
    """Matches of each window with its first occurrence, joined along runs."""
    lists = t["w"].combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    count = lists.value_lengths().to_numpy()
    w = lists.flatten().to_numpy()
    seed = t["seed"].to_numpy()
    # a seed that occurs once has no match: leave it before sorting
    edge = np.flatnonzero(np.r_[True, seed[1:] != seed[:-1], True])
    crowd = np.repeat(np.diff(edge) > 1, np.diff(edge))
    row = np.repeat(np.arange(len(count)), count)
    p = t["p"].to_numpy()[row] + np.arange(len(w)) - np.repeat(np.cumsum(count) - count, count)
    keep = crowd[row]
    w, row, p = w[keep], row[keep], p[keep]
    doc, h = t["doc_id"].to_numpy()[row], t["h"].to_numpy()[row]
    order = np.lexsort((p, h, doc, w))
    w, doc, h, p = w[order], doc[order], h[order], p[order]
    new = np.r_[True, w[1:] != w[:-1]] if len(w) else np.zeros(0, bool)
    at = np.flatnonzero(new)[np.cumsum(new) - 1] if len(w) else np.zeros(0, np.int64)
    fd, fh, fp = doc[at], h[at], p[at]
    copy = (doc != fd) | (h != fh) | (p != fp)
    return _runs(*(x[copy] for x in (doc, h, p, fd, fh, fp)))


def _runs(doc, h, p, fd, fh, fp) -> pa.Table:
    """Windows that follow each other, in both documents, become one row."""
    order = np.lexsort((p, fp - p, fh, fd, h, doc))
    doc, h, p, fd, fh, fp = (x[order] for x in (doc, h, p, fd, fh, fp))
    new = np.ones(len(p), bool)
    if len(p):
        same = np.ones(len(p) - 1, bool)
        for x in (doc, h, fd, fh, fp - p):
            same &= x[1:] == x[:-1]
        step = p[1:] - p[:-1]
        keep = np.r_[True, ~(same & (step == 0))]  # repeated rows
        new[1:] = ~(same & (step <= 1))
        doc, h, p, fd, fh, fp, new = (x[keep] for x in (doc, h, p, fd, fh, fp, new))
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(p)))
    return pa.table({"doc_id": doc[at], "h": h[at], "p": p[at].astype(np.int64), "n": count, "first_id": fd[at], "first_h": fh[at], "fp": fp[at].astype(np.int64)})


def repeats(docs: DataFrame, least: int = LEAST, gram: int = GRAM) -> DataFrame:
    """(doc_id, h, start_word, end_word, first_id, first_h, first_word): the
    words [start, end) of the document repeat those from first_word on in the
    document first_id (an earlier one, or an earlier place in the same one).
    Each row is as long as its windows' first occurrences run side by side."""
    spark = docs.sparkSession
    ship(spark)
    sent = identified(docs).mapInArrow(_emit(least, gram), "seed long, doc_id long, h long, p int, w array<long>")
    runs = by_key(sent, "seed", _match, "doc_id long, h long, p long, n long, first_id long, first_h long, fp long", parallel(spark, docs))
    runs = runs.withColumn("shift", F.col("fp") - F.col("p"))
    side = ["doc_id", "h", "first_id", "first_h", "shift"]
    before = F.max(F.col("p") + F.col("n")).over(Window.partitionBy(side).orderBy("p").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.withColumn("new", F.when(before >= F.col("p"), 0).otherwise(1))
    runs = runs.withColumn("run", F.sum("new").over(Window.partitionBy(side).orderBy("p").rowsBetween(Window.unboundedPreceding, 0)))
    whole = runs.groupBy(*side, "run").agg(F.min("p").alias("start_word"), (F.max(F.col("p") + F.col("n")) + least - 1).alias("end_word"))
    return whole.select("doc_id", "h", "start_word", "end_word", "first_id", "first_h", (F.col("start_word") + F.col("shift")).alias("first_word"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every passage of at least 50 words in ``documents`` that occurred before."""
    return repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("h", "first_h")


QUERIES = {"op5_substring_dedup": op5_substring_dedup}
ORACLE: dict[str, str] = {}
