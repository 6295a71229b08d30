"""Bottom-k fingerprints of documents.

A document is the set of its 3-word shingles (lower case, words of letters and
digits); its fingerprint is the k least 63-bit hashes of them.  Fingerprints
merge: the k least of a union of fingerprints is the fingerprint of the union
of the sets, so parts, documents or whole sources can be combined in any
order.  Two fingerprints estimate the resemblance and the containment of their
sets, one the number of its distinct shingles (exact below k).

The query also searches: with the documents whose id is divisible by ``EVERY``
as queries, it returns both estimates for every document that holds at least
``SHARE`` of a query, or of which a query holds as much.  The search is exact on
the fingerprints: the hashes that a document shares with each query are counted.

Scale: fingerprints are made in one pass without a shuffle.  The search sends
blocks of at most about ``BLOCK`` queries (1 KB each) to all tasks, each one
pass over the fingerprints; only results are shuffled.  Merging first
reduces to one fingerprint per key in each batch, so a hot key costs no more
than k hashes from each batch.

Defined results: a null or empty text, or one without words, has the empty
fingerprint and 0 shingles; a text of 1 or 2 words has one shingle; a null
doc_id or source stays null (a null source is a source of its own); repeated
rows are fingerprinted each, and don't change a merged fingerprint; other
columns are ignored.  Equal hashes count once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernel as K
from .groups import by_key
from .session import Scratch, parallel, ship

SHINGLE, SIZE = 3, 128
#: Containment from which a pair is returned, and from how many hashes it must
#: be estimated; documents whose id is divisible by this are queries.
SHARE, SHOWN, EVERY = 0.5, 8, 50
#: Queries of a block, and of how many of them a hash is common; most sources
#: whose fingerprints are broadcast (others are joined by shuffling).
BLOCK, COMMON, SOURCES = 16_384, 256, 4096
MOST = 2**63 - 1
PAIR = "a long, b long, resemblance double, containment double"


def _bottom(values: np.ndarray, offs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k least distinct values of each group, sorted."""
    v, o = K.distinct(values, offs)
    rank = np.arange(len(v)) - np.repeat(o[:-1], np.diff(o))
    return v[rank < k], np.concatenate([[0], np.cumsum(np.minimum(np.diff(o), k))])


def _sketch(shingle: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, h, _, _, at in K.tokens(K.strings(b.column("text"), lower=True), K.ALNUM):
                v, o = K.shingles(h, at, shingle)
                v, o = _bottom(K.mix(v) >> np.uint64(1), o, k)
                n = len(at) - 1
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, n), b.column("source").slice(i, n), K.lists(v, o)], ["doc_id", "source", "sketch"])

    return run


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, k: int = SIZE) -> DataFrame:
    """(doc_id, source, sketch) for every row of ``docs``."""
    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text")).mapInArrow(_sketch(shingle, k), "doc_id long, source string, sketch array<long>")


def _merge_by(k: int):
    def run(t: pa.Table) -> pa.Table:
        code = t["key"].combine_chunks().dictionary_encode()
        code = code.combine_chunks() if isinstance(code, pa.ChunkedArray) else code
        lists = t["sketch"].combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        n = len(code.dictionary)
        group = np.repeat(code.indices.to_numpy(), lists.value_lengths().to_numpy())
        order = np.argsort(group, kind="stable")
        v, o = _bottom(lists.flatten().to_numpy()[order], np.searchsorted(group[order], np.arange(n + 1)), k)
        return pa.table({"key": code.dictionary.cast(pa.string()), "sketch": K.lists(v, o)})

    return run


def merge(sketches: DataFrame, by: str, k: int = SIZE) -> DataFrame:
    """(``by``, sketch): the fingerprint of the union for each value of ``by``."""
    fn = _merge_by(k)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield from fn(pa.Table.from_batches([b])).to_batches()

    spark = sketches.sparkSession
    # a null must survive as a key of its own: values get a prefix
    keyed = sketches.select(F.coalesce(F.concat(F.lit("v"), F.col(by).cast("string")), F.lit("n")).alias("key"), "sketch")
    done = by_key(keyed.mapInArrow(partial, "key string, sketch array<long>"), "key", fn, "key string, sketch array<long>", parallel(spark, sketches))
    return done.select(F.when(F.col("key") != "n", F.substring("key", 2, 1 << 30)).alias(by), "sketch")


def distinct_shingles(sketch: Column, k: int = SIZE) -> Column:
    """Estimated size of the set: exact below k hashes."""
    return F.when(F.size(sketch) < k, F.size(sketch).cast("double")).otherwise(F.lit(float(k - 1)) * F.lit(2.0**63) / F.element_at(sketch, k).cast("double"))


def resemblance(a: Column, b: Column, k: int = SIZE) -> Column:
    """Estimated |A and B| / |A or B|; null if both are empty."""
    least = F.slice(F.array_sort(F.array_union(a, b)), 1, k)
    return F.when(F.size(least) > 0, F.size(F.array_intersect(least, F.array_intersect(a, b))) / F.size(least))


def containment(a: Column, b: Column, k: int = SIZE) -> Column:
    """Estimated |A and B| / |A|; null if A is empty.  Only hashes that both
    fingerprints would show are compared; if none of A's are, null."""
    top = lambda s: F.when(F.size(s) < k, F.lit(2**63 - 1)).otherwise(F.element_at(s, k))
    shown = F.filter(a, lambda x: x <= F.least(top(a), top(b)))
    return F.when(F.size(shown) > 0, F.size(F.array_intersect(shown, b)) / F.size(shown))


class _Index:
    """Fingerprints of a block of queries: the queries that have each hash.  A
    hash that more than ``COMMON`` of them have is a row of flags."""

    def __init__(self, nodes: np.ndarray, values: np.ndarray, offs: np.ndarray, k: int):
        self.nodes, self.k, self.matrix = nodes, k, _matrix(values, offs, k)
        self.size = np.diff(offs)
        order = np.argsort(values, kind="stable")
        self.query = np.repeat(np.arange(len(nodes)), self.size)[order]
        self.hash, self.first, self.count = np.unique(values[order], return_index=True, return_counts=True)
        often = np.flatnonzero(self.count > COMMON)
        self.row = np.full(len(self.hash), -1)
        self.row[often] = np.arange(len(often))
        self.flags = np.zeros((len(often), len(nodes)), np.uint8)
        for r, x in enumerate(often):
            self.flags[r, self.query[self.first[x] : self.first[x] + self.count[x]]] = 1

    def candidates(self, values: np.ndarray, offs: np.ndarray, share: float):
        """(document, query, hashes in common) of all that share enough to be
        a result whatever they show of each other."""
        n, q = len(offs) - 1, len(self.nodes)
        at = np.minimum(np.searchsorted(self.hash, values), len(self.hash) - 1)
        hit = np.flatnonzero(self.hash[at] == values)
        doc, at = np.repeat(np.arange(n), np.diff(offs))[hit], at[hit]
        rare = self.row[at] < 0
        many = self.count[at[rare]]
        where = np.repeat(self.first[at[rare]] - np.cumsum(many) + many, many) + np.arange(many.sum())
        key, common = np.unique(np.repeat(doc[rare], many) * q + self.query[where], return_counts=True)
        d, x = [key // q], [key % q]
        c = [common]
        edge = np.searchsorted(d[0], np.arange(n + 1))
        drop = np.zeros(len(key), bool)
        full_doc, full_at = doc[~rare], at[~rare]
        for one in np.unique(full_doc):
            total = self.flags[self.row[full_at[full_doc == one]]].sum(0, dtype=np.int64)
            mine = slice(edge[one], edge[one + 1])
            total[x[0][mine]] += common[mine]
            drop[mine] = True
            some = np.flatnonzero(total)
            d.append(np.full(len(some), one))
            x.append(some)
            c.append(total[some])
        d[0], x[0], c[0] = (z[0][~drop] for z in (d, x, c))
        d, x, c = (np.concatenate(z) for z in (d, x, c))
        least = share * np.minimum(SHOWN, np.minimum(np.diff(offs)[d], self.size[x]))
        keep = c >= least
        return d[keep], x[keep], c[keep]


def _matrix(values: np.ndarray, offs: np.ndarray, k: int) -> np.ndarray:
    """One fingerprint a row, filled up with a value above all hashes."""
    out = np.full((len(offs) - 1, k), MOST, np.int64)
    out[np.repeat(np.arange(len(offs) - 1), np.diff(offs)), np.arange(len(values)) - np.repeat(offs[:-1], np.diff(offs))] = values
    return out


def _compare(nodes: np.ndarray, values: np.ndarray, offs: np.ndarray, share: float, k: int):
    """Both estimates of the fingerprints of a batch with those of the queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _Index(nodes, values, offs, k)
        for b in batches:
            own, one = np.unique(b.column("node").to_numpy(), return_index=True)
            part = b.column("sketch").take(pa.array(one))
            size = part.value_lengths().to_numpy().astype(np.int64)
            v, o = part.flatten().to_numpy(), np.concatenate([[0], np.cumsum(size)])
            d, q, c = index.candidates(v, o, share)
            other = own[d] != index.nodes[q]
            d, q, c = d[other], q[other], c[other]
            docs = _matrix(v, o, k)
            for lo in range(0, len(d), 20_000):
                i, j, n = (x[lo : lo + 20_000] for x in (d, q, c))
                x, y = docs[i], index.matrix[j]
                bound = np.minimum(x[:, -1], y[:, -1])[:, None]
                nx, ny = ((z <= bound) & (z < MOST) for z in (x, y))
                nx, ny = nx.sum(1), ny.sum(1)
                whole = (x[:, -1] == MOST) & (y[:, -1] == MOST)
                out = [np.flatnonzero((n >= share * m - 1e-9) & (whole | (m >= SHOWN))) for m in (ny, nx)]
                for rows, m, a, z in ((out[0], ny, index.nodes[j], own[i]), (out[1], nx, own[i], index.nodes[j])):
                    if not len(rows):
                        continue
                    alike = np.array([_alike(x[r], y[r], k) for r in rows])
                    yield pa.RecordBatch.from_arrays([pa.array(a[rows]), pa.array(z[rows]), pa.array(alike), pa.array(n[rows] / m[rows])], ["a", "b", "resemblance", "containment"])

    return run


def _alike(x: np.ndarray, y: np.ndarray, k: int) -> float:
    every, count = np.unique(np.concatenate([x[x < MOST], y[y < MOST]]), return_counts=True)
    return float((count[:k] == 2).mean())


def pairs(sketches: DataFrame, asked: DataFrame, share: float = SHARE, k: int = SIZE) -> DataFrame:
    """(a, b, resemblance, containment) of all (node, sketch) with different
    nodes, one of them in ``asked``, whose containment of a in b is at least
    ``share`` and is estimated from ``SHOWN`` hashes or exact.  Every pair of
    at least this resemblance is among them."""
    s = Scratch(sketches.sparkSession)
    asked = s.keep(asked.where(F.size("sketch") > 0).dropDuplicates(["node"]), "asked")
    blocks = max(1, -(-asked.count() // BLOCK))
    found = []
    for k_ in range(blocks):  # a block is about ``BLOCK`` fingerprints of at most k hashes
        rows = asked.where(F.pmod(F.xxhash64("node"), F.lit(blocks)) == k_).toArrow()
        if not rows.num_rows:
            continue
        lists = rows["sketch"].combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        offs = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())]).astype(np.int64)
        fn = _compare(rows["node"].to_numpy(), lists.flatten().to_numpy(), offs, share, k)
        found.append(s.keep(sketches.where(F.size("sketch") > 0).select("node", "sketch").mapInArrow(fn, PAIR), f"found-{k_}"))
    s.drop("asked")
    out = sketches.sparkSession.createDataFrame([], PAIR)
    for f in found:
        out = out.union(f)
    return out.dropDuplicates(["a", "b"])


def compared(each: DataFrame, merged: DataFrame, share: float = SHARE, k: int = SIZE, every: int = EVERY) -> DataFrame:
    """(level, doc_id, source, other_id, resemblance, containment): at level
    "pair" documents with others that hold ``share`` of them, where one of the
    two is a query (doc_id divisible by ``every``), at level "within" each
    document with its own source.  Documents of equal fingerprints are one
    class: each has one row, "copy", with the first of them (least doc_id,
    which stands for them in the other rows), so m copies give m - 1 rows; a
    class with a query in it is a query."""
    s = Scratch(each.sparkSession)
    known = each.where(F.size("sketch") > 0).withColumn("node", F.xxhash64("sketch"))
    first = s.keep(known.where("doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("first")), "first")
    copies = known.where("doc_id is not null").select("doc_id", "source", "node").distinct().join(first, "node").where("doc_id <> first")
    copies = copies.select(F.lit("copy").alias("level"), "doc_id", "source", F.col("first").alias("other_id"), F.lit(1.0).alias("resemblance"), F.lit(1.0).alias("containment"))
    found = pairs(known.where("doc_id is not null").select("node", "sketch"), known.where(F.col("doc_id") % every == 0).select("node", "sketch"), share, k)
    found = found.join(first.select(F.col("node").alias("a"), F.col("first").alias("doc_id")), "a").join(first.select(F.col("node").alias("b"), F.col("first").alias("other_id")), "b")
    found = found.select(F.lit("pair").alias("level"), "doc_id", F.lit(None).cast("string").alias("source"), "other_id", "resemblance", "containment")
    own = known.withColumnRenamed("sketch", "sa").join(F.broadcast(merged.select(F.col("source").alias("of"), F.col("sketch").alias("sb"))) if _few(merged) else merged.select(F.col("source").alias("of"), F.col("sketch").alias("sb")), F.col("source").eqNullSafe(F.col("of")))
    own = own.withColumn("containment", containment(F.col("sa"), F.col("sb"), k)).withColumn("resemblance", resemblance(F.col("sa"), F.col("sb"), k))
    own = own.select(F.lit("within").alias("level"), "doc_id", "source", F.lit(None).cast("long").alias("other_id"), "resemblance", "containment")
    return copies.unionByName(found).unionByName(own)


def _few(merged: DataFrame) -> bool:
    """Whether the sources are few enough to be sent to every task (1 KB each)."""
    return merged.limit(SOURCES + 1).count() <= SOURCES


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fingerprint of every document, the merged one of every source, and
    what they tell of resembling and contained documents."""
    s = Scratch(spark)
    each = s.keep(fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")), "each")
    merged = s.keep(merge(each, "source"), "merged")
    made = (
        each.select(F.lit("document").alias("level"), "doc_id", "source", "sketch")
        .unionByName(merged.select(F.lit("source").alias("level"), F.lit(None).cast("long").alias("doc_id"), "source", "sketch"))
        .withColumn("distinct_shingles", distinct_shingles(F.col("sketch")))
    )
    return made.unionByName(compared(each, merged), allowMissingColumns=True)


QUERIES = {"op8_fingerprints": op8_fingerprints}
ORACLE: dict[str, str] = {}
