"""Circulant MinHash near-duplicate detection.

Every document is its set of 3-word shingles (lower case, words of letters and
digits).  Two permutations of Z_2^32 make all coordinates of the signature:
coordinate k is the least pi(sigma(x) - k) over the shingles x, so pi shifted
round by k places serves as the k-th permutation (C-MinHash, Li and Li 2021).
Signatures are cut into bands; documents that share a band are candidates; the
exact Jaccard similarity of the shingle sets decides.

Scale: a class of documents with equal sets is one node, the 64-bit hash of the
set.  Bands travel as one 64-bit key and the node.  A bucket of m nodes yields
m-1 candidate pairs with its least node; after these are verified and joined
into components, only pairs of *different* components that still share a bucket
are left.  They are found by an exact prefix filter: sets of Jaccard similarity
t share one of the first n - ceil(t n) + 1 shingles of either in any order
(Bayardo et al., 2007), with frequent shingles last, so nodes that only share
boilerplate don't meet.  The components equal those of all pairs that share a
band, without any cap.  Sets are packed to five bytes a shingle; documents that
share no bucket are left out by a bitmap of fixed size before they are shuffled.

Defined results: a null text counts as empty; a document without words is in
no group; a null doc_id takes no part; rows that repeat a doc_id and text are
one document; rows of one doc_id with different texts are different documents.
A shorter document than 3 words has one shingle.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernel as K
from .groups import by_key, components, lean, sifted, unused
from .session import Scratch, parallel

SHINGLE, BANDS, ROWS, THRESHOLD = 3, 32, 3, 0.5
#: A shingle is frequent if it makes up more than one of so many in all sets,
#: which bounds how many are.
FREQUENT = 200_000
#: Pairs of a task that are made at a time.
BLOCK = 1 << 18


def signatures(values: np.ndarray, offs: np.ndarray, n: int) -> np.ndarray:
    """n circulant MinHash coordinates of each non-empty set of hashes."""
    sigma = K.mix32((values ^ (values >> np.uint64(32))).astype(np.uint32))
    out = np.empty((n, len(offs) - 1), np.uint32)
    for k in range(n):
        out[k] = np.minimum.reduceat(K.mix32((sigma - np.uint32(k)) * np.uint32(0x9E3779B1) + np.uint32(0x7F4A7C15)), offs[:-1])
    return out


def _sets(text: pa.Array, shingle: int):
    """(first row, rows with shingles, distinct shingles, offsets) by chunk."""
    for i, h, _, _, at in K.tokens(K.strings(text, lower=True), K.ALNUM):
        v, o = K.distinct(*K.shingles(h, at, shingle))
        has = np.flatnonzero(np.diff(o))
        yield i, has, v, np.append(o[has], len(v))


def _node(v: np.ndarray, o: np.ndarray) -> np.ndarray:
    """The hash of each set."""
    return K.mix(np.add.reduceat(K.mix(v), o[:-1]) + np.diff(o).astype(np.uint64)).view(np.int64)


def _sign(shingle: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, has, v, o in _sets(b.column("text"), shingle):
                if not len(has):
                    continue
                sig = signatures(v, o, bands * rows)
                keys = []
                for j in range(bands):
                    x = np.full(len(has), j + 1, np.uint64)
                    for r in range(rows):
                        x = K.mix(x * np.uint64(0x9E3779B97F4A7C15) + sig[j * rows + r])
                    keys.append(x)
                take = pa.array(has + i)
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").take(take), b.column("h").take(take), pa.array(_node(v, o)), pa.array(np.diff(o).astype(np.int32)), K.lists(np.stack(keys, 1).ravel(), np.arange(len(has) + 1) * bands)],
                    ["doc_id", "h", "node", "n", "bands"],
                )

    return run


def _crowd(t: pa.Table) -> pa.Table:
    """Different nodes of buckets with two or more, and the bucket's hub."""
    bucket, node, n = (t[c].to_numpy() for c in ("bucket", "node", "n"))
    order = np.lexsort((node, bucket))
    bucket, node, n = bucket[order], node[order], n[order]
    new = np.r_[True, (bucket[1:] != bucket[:-1]) | (node[1:] != node[:-1])]
    bucket, node, n = bucket[new], node[new], n[new]
    edge = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True])
    many = np.repeat(np.diff(edge), np.diff(edge))
    hub = np.repeat(edge[:-1], np.diff(edge))
    keep = many > 1
    return pa.table({"bucket": bucket[keep], "node": node[keep], "n": n[keep], "hub": node[hub[keep]], "hub_n": n[hub[keep]], "m": many[keep].astype(np.int64)})


def _packed(shingle: int):
    """Sets as five bytes a shingle, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, has, v, o in _sets(b.column("text"), shingle):
                if not len(has):
                    continue
                v = (v >> np.uint64(24)).astype(">u8").view(np.uint8).reshape(-1, 8)[:, 3:].copy().reshape(-1)
                yield pa.RecordBatch.from_arrays([b.column("node").take(pa.array(has + i)), _binary(v, o * 5)], ["node", "set"])

    return run


def _binary(data: np.ndarray, offs: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_binary(), len(offs) - 1, [None, pa.py_buffer(offs.astype(np.int64)), pa.py_buffer(data)]).cast(pa.binary())


def _unpack(blob: bytes) -> np.ndarray:
    out = np.zeros((len(blob) // 5, 8), np.uint8)
    out[:, 3:] = np.frombuffer(blob, np.uint8).reshape(-1, 5)
    return np.unique(out.view(">u8").astype(np.int64))


def _alike(threshold: float):
    """The pairs whose sets are alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = np.zeros(b.num_rows, bool)
            for r, (x, y) in enumerate(zip(b.column("sx").to_pylist(), b.column("sy").to_pylist())):
                both = np.concatenate([_unpack(x), _unpack(y)])
                every = len(both)
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                ok[r] = common >= threshold * (every - common)
            keep = pa.array(ok)
            yield pa.RecordBatch.from_arrays([b.column("x").filter(keep), b.column("y").filter(keep)], ["a", "b"])

    return run


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for blob in b.column("set").to_pylist():
            yield pa.RecordBatch.from_arrays([pa.array(_unpack(blob))], ["s"])


def _prefix(threshold: float, frequent: np.ndarray):
    """The shingles of each set of which a similar one must have one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for node, root, blob in zip(*(b.column(c).to_pylist() for c in ("node", "root", "set"))):
                v = _unpack(blob)
                n = len(v)
                last = np.isin(v, frequent)
                v = np.concatenate([v[~last], v[last]])[: n - int(np.ceil(threshold * n - 1e-9)) + 1]
                yield pa.RecordBatch.from_arrays([pa.array(v), pa.array(np.full(len(v), node)), pa.array(np.full(len(v), root)), pa.array(np.full(len(v), n, np.int32))], ["s", "node", "root", "n"])

    return run


def _across(threshold: float):
    """Pairs of nodes of different components that share a shingle and whose
    sizes allow the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs(t: pa.Table) -> Iterator[pa.RecordBatch]:
            s, node, root, n = (t[c].to_numpy() for c in ("s", "node", "root", "n"))
            order = np.lexsort((n, s))
            s, node, root, n = s[order], node[order], root[order], n[order]
            # partners of a row: those after it with the same shingle and a size up to n / threshold
            edge = np.flatnonzero(np.r_[True, s[1:] != s[:-1], True])
            stop = np.empty(len(s), np.int64)
            for lo, hi in zip(edge[:-1], edge[1:]):
                stop[lo:hi] = lo + np.searchsorted(n[lo:hi], n[lo:hi] / threshold, "right") if hi - lo > 1 else hi
            many = stop - np.arange(len(s)) - 1
            done = np.concatenate([[0], np.cumsum(many)])
            lo = 0
            while lo < len(s):
                hi = max(lo + 1, int(np.searchsorted(done, done[lo] + BLOCK, "right")) - 1)
                k = many[lo:hi]
                left = np.repeat(np.arange(lo, hi), k)
                right = left + 1 + np.arange(len(left)) - np.repeat(done[lo:hi] - done[lo], k)
                other = root[left] != root[right]
                x, y = node[left[other]], node[right[other]]
                if len(x):
                    both = np.unique(np.stack([np.maximum(x, y), np.minimum(x, y)], 1), axis=0)
                    yield pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], ["x", "y"])
                lo = hi

        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            t = pa.Table.from_batches(held).combine_chunks()
            s = t["s"].to_numpy()
            cut = int(np.searchsorted(s, s[-1]))
            if cut:
                yield from pairs(t.slice(0, cut))
                held = t.slice(cut).to_batches()
        if held:
            yield from pairs(pa.Table.from_batches(held).combine_chunks())

    return run


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, h, keep_id, keep_h): each document that is not the least of its
    group, and the least.  h is xxhash64 of the text (null for a null text
    reads as of '').  A group is a connected component of the pairs with
    Jaccard similarity of at least ``threshold``."""
    spark = docs.sparkSession
    s, n = Scratch(spark), parallel(spark, docs)
    ids = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    sig = s.keep(ids.mapInArrow(lean(_sign(shingle, bands, rows)), "doc_id long, h long, node long, n int, bands array<long>"), "sig")
    buckets = sig.select(F.explode("bands").alias("bucket"), "node", "n")
    members = s.keep(by_key(buckets, "bucket", _crowd, "bucket long, node long, n int, hub long, hub_n int, m long", n), "members")
    fits = (F.col("n") >= F.lit(threshold) * F.col("hub_n")) & (F.col("hub_n") >= F.lit(threshold) * F.col("n"))
    stars = s.keep(members.where(F.col("node") != F.col("hub")).where(fits).select(F.col("node").alias("x"), F.col("hub").alias("y")).distinct(), "stars")
    # of each class one document gives the set, of the documents in crowded buckets
    key = F.xxhash64("doc_id", "h")
    classes = s.keep(sig.groupBy("node").agg(F.min(F.struct("doc_id", "h")).alias("least"), F.count("*").alias("docs")), "classes")
    crowded = members.select("node").distinct()
    givers = s.keep(classes.join(crowded, "node", "left_semi").select("least.doc_id", "least.h", "node"), "givers")
    s.drop()
    maybe = sifted(ids, key, givers, F.xxhash64("doc_id", "h")).where("__maybe").drop("__maybe")
    sets = maybe.hint("merge").join(givers.hint("merge"), ["doc_id", "h"]).dropDuplicates(["node"]).mapInArrow(lean(_packed(shingle)), "node long, set binary")
    sets = s.keep(sets, "sets")
    s.drop("givers")

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        left = pairs.join(sets.select(F.col("node").alias("x"), F.col("set").alias("sx")), "x")
        both = left.join(sets.select(F.col("node").alias("y"), F.col("set").alias("sy")), "y")
        ok = s.keep(both.select("x", "y", "sx", "sy").mapInArrow(lean(_alike(threshold)), "a long, b long"), f"ok-{name}")
        s.drop()
        return ok

    edges = verified(stars, "stars")
    roots = components(s, edges, "cc1")
    found = members.where("m > 2").select("bucket", "node").join(roots.select(F.col("v").alias("node"), "root"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = found.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("bucket")
    open_ = found.join(mixed, "bucket", "left_semi").select("node", "root").distinct().join(sets, "node")
    open_ = s.keep(open_, "open")
    s.drop("members")
    total = open_.agg(F.sum(F.octet_length("set") / 5)).first()[0] or 0
    often = open_.select("set").mapInArrow(lean(_shingles), "s long").groupBy("s").count().where(F.col("count") > max(2, total / FREQUENT))
    frequent = np.array([r["s"] for r in often.select("s").toLocalIterator()], np.int64)  # at most FREQUENT
    prefix = open_.mapInArrow(lean(_prefix(threshold, frequent)), "s long, node long, root long, n int")
    rest = prefix.repartition(n, "s").sortWithinPartitions("s").mapInArrow(lean(_across(threshold)), "x long, y long").distinct()
    star = stars.select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y"))
    rest = s.keep(rest.join(star, ["x", "y"], "left_anti"), "rest")
    s.drop("open")
    more = verified(rest, "rest")
    s.drop("sets", "stars", "rest")
    roots = components(s, edges.union(more), "cc2").select(F.col("v").alias("node"), "root")
    roots = roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
    s.drop("ok-stars", "ok-rest")
    # names of the groups: only classes with a partner or with several documents
    group = s.keep(classes.join(roots, "node", "left").where("root is not null or docs > 1").withColumn("root", F.coalesce("root", "node")).select("node", "root", "least"), "group")
    keep = group.groupBy("root").agg(F.min("least").alias("keep"))
    named = group.select("node", "root").join(keep, "root").select("node", "keep")
    out = sig.select("doc_id", "h", "node").distinct().join(named, "node").where(F.struct("doc_id", "h") != F.col("keep"))
    out = s.keep(out.select("doc_id", "h", F.col("keep.doc_id").alias("keep_id"), F.col("keep.h").alias("keep_h")), "out")
    s.drop("sig", "classes", "group")
    return out


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with one document of each near-duplicate group, the least
    doc_id (then text hash).  Rows without doc_id stay; of rows that repeat
    doc_id and text one stays."""
    found = near_duplicates(docs, **how)
    s = Scratch(docs.sparkSession)
    p = unused(docs)
    id_, h = F.col("doc_id").cast("long"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    again = docs.where("doc_id is not null").select(id_.alias(f"{p}id"), h.alias(f"{p}h")).groupBy(f"{p}id", f"{p}h").count().where("count > 1")
    # documents that go, and those that repeat: only these are shuffled
    known = s.keep(found.select(F.col("doc_id").alias(f"{p}id"), F.col("h").alias(f"{p}h"), F.lit(True).alias(f"{p}gone")).unionByName(again.select(f"{p}id", f"{p}h", F.lit(False).alias(f"{p}gone"))), "known")
    marked = sifted(docs.withColumns({f"{p}id": id_, f"{p}h": h}), F.coalesce(F.xxhash64(f"{p}id", f"{p}h"), F.lit(0)), known, F.xxhash64(f"{p}id", f"{p}h"), p)
    sure = F.col("doc_id").isNull() | ~F.col(f"{p}maybe")
    rest = marked.where(~sure).join(known.where(f"{p}gone").select(f"{p}id", f"{p}h").hint("merge"), [f"{p}id", f"{p}h"], "left_anti").dropDuplicates([f"{p}id", f"{p}h"])
    return marked.where(sure).select(docs.columns).unionByName(rest.select(docs.columns))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every near duplicate in ``documents`` and the document kept for it."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "keep_id")


QUERIES = {"op9_near_dedup": op9_near_dedup}
ORACLE: dict[str, str] = {}
