"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words; only documents have
labels.  A passage x is encoded as h = tanh(W x); gated attention (Ilse,
Tomczak and Welling, 2018) weighs the passages of a document,

    a_i = softmax_i( w . (tanh(V h_i) * sigmoid(U h_i)) ),

and the document's score is sigmoid(c . sum_i a_i h_i + b).  W, V, U, w, c and
b are learned together from document labels by Adam.  The features x of a
passage are shares of character classes, word lengths, repetition inside the
passage and the document, and hashed word shapes, all taken from the bytes of
whole texts.

Scale: training sees a bounded sample of labelled documents (``SAMPLE``, those
with the least hashes of doc_id); scoring is one pass without a shuffle, each
passage of each document once, with the few thousand weights in the closure.

Defined results: null, empty and wordless texts have no passage, score 0 and
are rejected.  Null doc_ids are scored like others; repeated rows are scored
each; labels that are null or have a null doc_id are left out, a document with
several labels is trained on with each.  Without labelled documents of both
kinds nothing can be learned: every score is null and every row is kept.
Other columns stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernel as K
from .groups import lean
from .session import ship

PASSAGE, HIDDEN, ATTENTION, SHAPES, SAMPLE, STEPS = 64, 24, 12, 64, 3000, 400

_CLASSES = np.zeros((8, 256), bool)
_CLASSES[0, 97:123] = True  # lower case
_CLASSES[1, 65:91] = True  # upper case
_CLASSES[2, 48:58] = True  # digits
_CLASSES[3, [9, 10, 13, 32]] = True  # white space
_CLASSES[4, list(b".,;:'\"?-()")] = True  # ordinary punctuation
_CLASSES[5, list(b"!|*#%&$@<>{}[]/\\=_~^+")] = True  # marks
_CLASSES[6, 10] = True  # line ends
_CLASSES[7, 128:] = True  # not ASCII

#: A byte's class in the shape of a word.
_SHAPE = np.full(256, 7, np.uint8)
for _k in range(8):
    _SHAPE[_CLASSES[_k] & (_SHAPE == 7)] = _k

FEATURES = 8 + 10 + SHAPES


def _bags(column: pa.Array, passage: int):
    """(first row, features of each passage, passage offsets by document)."""
    text = K.strings(column)
    offsets, data = K.raw(text)
    for i, h, first, last, at in K.tokens(text):
        n = np.diff(at)
        parts = -(-n // passage)
        offs = np.concatenate([[0], np.cumsum(parts)])
        doc = np.repeat(np.arange(len(n)), parts)
        if not offs[-1]:
            yield i, np.zeros((0, FEATURES), np.float32), offs
            continue
        lo = at[doc] + (np.arange(offs[-1]) - offs[doc]) * passage
        hi = np.minimum(lo + passage, at[doc + 1])
        base = offsets[i]
        begin = np.repeat(offsets[i : i + len(n)] - base, n)
        b = data[base : offsets[i + len(n)]]
        start, end = begin + first, begin + last
        # bytes of a passage: up to the start of the next, or the last word's end
        p, q = start[lo], np.where(hi < at[doc + 1], start[np.minimum(hi, len(start) - 1)], end[hi - 1])
        cols = []
        size = (q - p).astype(np.float32)
        sums = [np.concatenate([[0], np.cumsum(c[b], dtype=np.int32)]) for c in _CLASSES]
        cols += [(s[q] - s[p]) / size for s in sums]
        words = (hi - lo).astype(np.float32)
        length = (end - start).astype(np.float32)
        over = lambda x: np.add.reduceat(x, lo) / words  # noqa: E731  passages cover all words in order
        mean = over(length)
        cols += [mean / 10, np.sqrt(np.maximum(over(length * length) - mean * mean, 0)) / 10, np.log1p(words) / 5]
        mark = (sums[4] + sums[5])[end] - (sums[4] + sums[5])[end - 1]
        caps = sums[1][end] - sums[1][start]
        cols += [over(mark.astype(np.float32)), over((caps == length).astype(np.float32)), over((caps > 0).astype(np.float32)), over((length == 1).astype(np.float32))]
        where = np.repeat(np.arange(len(lo)), hi - lo)
        cols.append(1 - _new(where, h, len(lo)) / words)
        whole = np.repeat(np.arange(len(n)), n)
        cols.append(1 - (_new(whole, h, len(n)) / np.maximum(n, 1))[doc])
        # neighbours within a passage, so no feature depends on other documents
        inner = where[1:] == where[:-1]
        pair = (h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])[inner]
        cols.append(1 - _new(where[1:][inner], pair, len(lo)) / np.maximum(words - 1, 1))
        # hashed shapes: first and last class, which classes occur, length
        seen = np.zeros(len(start), np.uint64)
        for k, s in enumerate(sums):
            seen |= ((s[end] - s[start]) > 0).astype(np.uint64) << np.uint64(k)
        shape = K.mix(seen * np.uint64(64) + _SHAPE[b[start]].astype(np.uint64) * np.uint64(8) + _SHAPE[b[end - 1]] + (np.minimum(length, 12).astype(np.uint64) << np.uint64(20)))
        bucket = (shape % np.uint64(SHAPES)).astype(np.int64)
        counts = np.bincount(where * SHAPES + bucket, minlength=len(lo) * SHAPES).reshape(-1, SHAPES)
        yield i, np.concatenate([np.stack(cols, 1), np.sqrt(counts / words[:, None])], 1).astype(np.float32), offs


def _new(group: np.ndarray, value: np.ndarray, groups: int) -> np.ndarray:
    """Distinct values in each group."""
    order = np.lexsort((value, group))
    g, v = group[order], value[order]
    first = np.r_[True, (g[1:] != g[:-1]) | (v[1:] != v[:-1])] if len(g) else np.zeros(0, bool)
    return np.bincount(g[first], minlength=groups).astype(np.float32)


class Model:
    """Encoder, gated attention and classifier."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, seed: int = 7):
        r = np.random.default_rng(seed)
        draw = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.mean, self.scale = mean, scale
        self.p = {"W": draw(FEATURES, HIDDEN), "V": draw(HIDDEN, ATTENTION), "U": draw(HIDDEN, ATTENTION), "w": draw(ATTENTION), "c": draw(HIDDEN), "b": np.zeros(1, np.float32)}

    def forward(self, x: np.ndarray, offs: np.ndarray):
        """Scores (log odds) of non-empty bags, and what the gradient needs."""
        p = self.p
        x = np.clip((x - self.mean) / self.scale, -6, 6)
        h = np.tanh(x @ p["W"])
        t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = (t * g) @ p["w"]
        n = np.diff(offs)
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, offs[:-1]), n))
        a = e / np.repeat(np.add.reduceat(e, offs[:-1]), n)
        z = np.add.reduceat(a[:, None] * h, offs[:-1])
        return z @ p["c"] + p["b"][0], (x, h, t, g, a, z, n)

    def gradient(self, x: np.ndarray, offs: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        s, (x, h, t, g, a, z, n) = self.forward(x, offs)
        p = self.p
        ds = (1 / (1 + np.exp(-s)) - y) * weight
        dz = np.repeat(ds, n)[:, None] * p["c"]
        da = (dz * h).sum(1)
        de = a * (da - np.repeat(np.add.reduceat(a * da, offs[:-1]), n))
        dt, dg = de[:, None] * p["w"] * g * (1 - t * t), de[:, None] * p["w"] * t * g * (1 - g)
        dh = dz * a[:, None] + dt @ p["V"].T + dg @ p["U"].T
        return {"W": x.T @ (dh * (1 - h * h)), "V": h.T @ dt, "U": h.T @ dg, "w": (t * g).T @ de, "c": z.T @ ds, "b": ds.sum(keepdims=True)}

    def fit(self, x: np.ndarray, offs: np.ndarray, y: np.ndarray, steps: int = STEPS, batch: int = 128) -> "Model":
        r = np.random.default_rng(3)
        share = y.mean()
        weight = np.where(y > 0, 0.5 / share, 0.5 / (1 - share))
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        for step in range(1, steps + 1):
            pick = r.integers(0, len(y), min(batch, len(y)))
            size = np.diff(offs)[pick]
            o = np.concatenate([[0], np.cumsum(size)])
            rows = np.repeat(offs[pick] - o[:-1], size) + np.arange(o[-1])
            for k, d in self.gradient(x[rows], o, y[pick], weight[pick] / len(pick)).items():
                d = d + 1e-4 * self.p[k]
                m[k] = 0.9 * m[k] + 0.1 * d
                v2[k] = 0.999 * v2[k] + 0.001 * d * d
                self.p[k] = (self.p[k] - 0.01 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v2[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self

    def score(self, x: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Probabilities of good quality; 0 for an empty bag."""
        out, has = np.zeros(len(offs) - 1), np.flatnonzero(np.diff(offs))
        if len(has):
            out[has] = 1 / (1 + np.exp(-self.forward(x, np.append(offs[has], len(x)))[0]))
        return out


def _features(passage: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, x, offs in _bags(b.column("text"), passage):
                n = len(offs) - 1
                yield pa.RecordBatch.from_arrays([b.column("y").slice(i, n), pa.array([x[p:q].tobytes() for p, q in zip(offs[:-1], offs[1:])], pa.binary())], ["y", "x"])

    return run


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """A model of ``quality`` in ``labels``, or None without both kinds.  At
    most ``sample`` labelled documents are used."""
    ship(docs.sparkSession)
    y = labels.where("doc_id is not null and quality is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y"))
    y = y.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(sample)
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(y), "doc_id").select("y", "text")  # at most ``sample`` rows
    rows = [(r["y"], np.frombuffer(r["x"], np.float32).reshape(-1, FEATURES)) for r in known.mapInArrow(lean(_features(PASSAGE)), "y int, x binary").collect()]
    rows = sorted(((k, x) for k, x in rows if len(x)), key=lambda r: (r[0], len(r[1]), r[1].tobytes()))
    if len({k for k, _ in rows}) < 2:
        return None
    x = np.concatenate([x for _, x in rows])
    offs = np.concatenate([[0], np.cumsum([len(x) for _, x in rows])])
    y = np.array([k for k, _ in rows], np.float32)
    return Model(x.mean(0), x.std(0) + 0.02).fit(x, offs, y)


def scored(docs: DataFrame, model: Model | None, column: str = "quality_score") -> DataFrame:
    """``docs`` with the probability of good quality (null without a model)."""
    if model is None:
        return docs.withColumn(column, F.lit(None).cast("double"))
    base = docs.drop(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [model.score(x, offs) for _, x, offs in _bags(b.column("text"), PASSAGE)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.concatenate(got or [np.zeros(0)]))], [*b.schema.names, column])

    ship(docs.sparkSession)
    from pyspark.sql import types as T

    return base.mapInArrow(lean(run), T.StructType([*base.schema.fields, T.StructField(column, T.DoubleType())]))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, sample: int = SAMPLE, column: str = "quality_score") -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, with their score."""
    return scored(docs, train(docs, labels, sample), column).where(F.col(column).isNull() | (F.col(column) >= threshold))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of good quality and their score, learned from ``labels``."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return keep_good(docs.select("doc_id", "text"), labels).select("doc_id", "quality_score")


QUERIES = {"op2_quality_classifier": op2_quality_classifier}
ORACLE: dict[str, str] = {}
