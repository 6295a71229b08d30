"""Benchmark decontamination: n-gram seeds, then Smith-Waterman.

1. Find the words of the benchmark that occur in documents.  An item's seeds
   are all its n-grams of such words, so no passage is missed that shares a
   run of n words with it.
2. Seeds join training passages to items: each document emits the stretches
   of words around n-grams that pass a bit filter of the seeds, as many as an
   alignment can reach; an equi-join with the seeds makes the pairs exact.
   Pairs with too few words in common to score enough aren't aligned.
3. Smith-Waterman aligns words of item and stretch: +2 for a match, -1 for a
   substitution and for each inserted or deleted word, so edits and
   paraphrases cost in proportion.  The score is a share of an exact copy's.

Scale: two scans of the text without moving it.  What travels are the words
around hits.  The filter has a fixed size (2**22 bits): more seeds than it can
hold apart let more stretches through to the join, which stays exact.
The benchmark's distinct words go to every task while they are at most
``VOCABULARY``; beyond that words are counted by a join.  Items and seeds are
joined as Spark sees fit and are never collected.

Defined results: null and empty texts on either side never match; items shorter
than n words use their whole text as the seed; null doc_ids or item_ids stay
null in the result; equal rows give equal rows, once; other columns are
ignored.  Words are lower case runs of letters and digits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernel as K
from .groups import lean, sifted, unused
from .session import Scratch

GRAM, THRESHOLD, SLOTS = 3, 0.5, 1 << 22
MATCH, MISS, GAP = 2, 1, 1
VOCABULARY = 1_000_000


def _items(gram: int):
    """For each item its words, n-grams with place, and n-gram length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, h, _, _, at in K.tokens(K.strings(b.column("text"), lower=True), K.ALNUM):
                g, o = K.shingles(h, at, gram)
                n = len(at) - 1
                yield pa.RecordBatch.from_arrays([b.column("item_id").slice(i, n), K.lists(h, at), K.lists(g, o)], ["item_id", "words", "grams"])

    return run


def _counts(words: np.ndarray):
    """Occurrences of ``words`` (sorted) in the texts, one row a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(words), np.int64)
        every = 0
        small = _bits(words)
        for b in batches:
            for _, h, _, _, _ in K.tokens(K.strings(b.column("text"), lower=True), K.ALNUM):
                every += len(h)
                h = h[small[(h & np.uint64(SLOTS - 1)).astype(np.int64)]]
                at = np.minimum(np.searchsorted(words, h), len(words) - 1)
                total += np.bincount(at[words[at] == h], minlength=len(words))
        yield pa.RecordBatch.from_arrays([K.lists(np.append(words, np.uint64(0)), np.array([0, len(words) + 1])), K.lists(np.append(total, every), np.array([0, len(words) + 1]))], ["word", "n"])

    return run


def _all_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences of every word by chunk, and of all words as word 0."""
    for b in batches:
        for _, h, _, _, _ in K.tokens(K.strings(b.column("text"), lower=True), K.ALNUM):
            word, n = np.unique(np.append(h, np.uint64(0)), return_counts=True)
            n[word == 0] = len(h)
            yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n)], ["word", "n"])


def _bits(values: np.ndarray) -> np.ndarray:
    out = np.zeros(SLOTS, bool)
    out[(values & np.uint64(SLOTS - 1)).astype(np.int64)] = True
    return out


def _stretches(sizes: list[int], packed: bytes, reach: int):
    """Words around n-grams that pass the filter: (doc_id, start, words, seeds)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(np.frombuffer(packed, np.uint8)).astype(bool)
        for b in batches:
            for i, h, _, _, at in K.tokens(K.strings(b.column("text"), lower=True), K.ALNUM):
                where, grams = [], []
                for k in sizes:
                    g = K.rolling(h, k)
                    if k < GRAM:
                        g = g ^ np.uint64(k)
                    hit = np.flatnonzero(bits[(g & np.uint64(SLOTS - 1)).astype(np.int64)] & K.room(at, k))
                    where.append(hit)
                    grams.append(g[hit])
                p, g = np.concatenate(where), np.concatenate(grams)
                if not len(p):
                    continue
                order = np.argsort(p, kind="stable")
                p, g = p[order], g[order]
                doc = np.searchsorted(at, p, "right") - 1
                new = np.r_[True, (doc[1:] != doc[:-1]) | (p[1:] - p[:-1] > reach)]
                edge = np.append(np.flatnonzero(new), len(p))
                d = doc[edge[:-1]]
                lo, hi = np.maximum(p[edge[:-1]] - reach, at[d]), np.minimum(p[edge[1:] - 1] + reach, at[d + 1])
                o = np.concatenate([[0], np.cumsum(hi - lo)])
                index = np.repeat(lo - o[:-1], hi - lo) + np.arange(o[-1])
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(d + i)), pa.array(lo - at[d]), K.lists(h[index], o), K.lists(g, edge)], ["doc_id", "start", "words", "seeds"])

    return run


def align(items: list[np.ndarray], texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Best local alignment scores of pairs of word sequences, and the place
    after the last aligned word of the text (the first such place)."""
    n, m = max(map(len, items)), max(map(len, texts))
    a, t = np.zeros((len(items), n), np.uint64), np.full((len(texts), m), 1, np.uint64)
    ka = np.zeros(a.shape, bool)
    kt = np.zeros(t.shape, bool)
    for r, (x, y) in enumerate(zip(items, texts)):
        a[r, : len(x)], t[r, : len(y)], ka[r, : len(x)], kt[r, : len(y)] = x, y, True, True
    h = np.zeros((len(items), m + 1), np.int32)
    slope = np.arange(m + 1, dtype=np.int32) * GAP
    best, end = np.zeros(len(items), np.int32), np.zeros(len(items), np.int64)
    for j in range(n):
        same = (a[:, j : j + 1] == t) & ka[:, j : j + 1] & kt
        now = np.maximum(h - GAP, 0)
        np.maximum(now[:, 1:], h[:, :-1] + np.where(same, MATCH, -MISS), out=now[:, 1:])
        h = np.maximum.accumulate(now + slope, 1) - slope
        top = h.argmax(1)
        value = h[np.arange(len(h)), top]
        better = value > best
        best[better], end[better] = value[better], top[better]
    return best, end


def _score(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                lists = []
                for name in ("item", "words"):
                    c = part.column(name)
                    flat, o = c.values.to_numpy().view(np.uint64), c.offsets.to_numpy()
                    lists.append([flat[x:y] for x, y in zip(o[:-1], o[1:])])
                items, texts = lists
                if not items:
                    continue
                # sizes differ by orders of magnitude: align like with like
                got = np.zeros(len(items)), np.zeros(len(items), np.int64), np.zeros(len(items), np.int64)
                enough = [r for r in range(len(items)) if np.isin(items[r], texts[r]).sum() / len(items[r]) >= threshold]
                by = sorted(enough, key=lambda r: (len(texts[r]), len(items[r])))
                for k in range(0, len(by), 64):
                    rows = by[k : k + 64]
                    x, y = [items[r] for r in rows], [texts[r] for r in rows]
                    best, end = align(x, y)
                    _, back = align([v[::-1] for v in x], [v[::-1] for v in y])
                    got[0][rows] = best / np.array([MATCH * len(v) for v in x])
                    got[1][rows] = np.array([len(v) for v in y]) - back
                    got[2][rows] = end
                ok = np.array([r for r in enough if got[0][r] >= threshold], np.int64)
                take, start = pa.array(ok), part.column("start").to_numpy()
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(take), part.column("item_id").take(take), pa.array(got[0][ok]), pa.array((start + got[1])[ok]), pa.array((start + got[2])[ok])], ["doc_id", "item_id", "score", "start_word", "end_word"])

    return run


def leaks(docs: DataFrame, benchmark: DataFrame, gram: int = GRAM, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, score, start_word, end_word): stretches of documents
    that align with a benchmark item for at least ``threshold`` of the score
    of an exact copy.  Words count from 0 in the document."""
    spark = docs.sparkSession
    s = Scratch(spark)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).mapInArrow(lean(_items(gram)), "item_id long, words array<long>, grams array<long>")
    items = s.keep(items.where(F.size("words") > 0).distinct(), "items")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    vocabulary = items.select(F.explode("words").alias("word")).distinct()
    known = np.unique(np.array([r[0] for r in vocabulary.limit(VOCABULARY + 1).collect()], np.int64).view(np.uint64))
    if not len(known):
        return spark.createDataFrame([], "doc_id long, item_id long, score double, start_word long, end_word long")
    if len(known) <= VOCABULARY:
        each = texts.select("text").mapInArrow(lean(_counts(known)), "word array<long>, n array<long>").select(F.explode(F.arrays_zip("word", "n")).alias("x")).select("x.word", "x.n")
    else:
        every = texts.select("text").mapInArrow(lean(_all_counts), "word long, n long")
        each = every.join(vocabulary.union(spark.createDataFrame([(0,)], "word long")), "word", "left_semi")
    counts = s.keep(each.groupBy("word").agg(F.sum("n").alias("n")), "counts")
    # a word that no document has is missing where words are counted by a join
    each = vocabulary.join(counts, "word", "left").select("word", F.coalesce("n", F.lit(0)).alias("n"))
    there = each.select("word", (F.col("n") > 0).alias("there"))
    # the n-grams that can occur
    words = items.select("item_id", "words", F.posexplode("words").alias("p", "word")).join(there, "word")
    model = words.groupBy("item_id", "words").agg(F.array_sort(F.collect_list(F.struct("p", "there"))).alias("pt"))
    lists = items.join(model, ["item_id", "words"]).select("item_id", "words", F.posexplode("grams").alias("p", "seed"), (F.size("words") - F.size("grams") + 1).alias("k"), F.col("pt.there").alias("there"))
    lists = lists.where(F.forall(F.slice("there", F.col("p") + 1, F.col("k")), lambda x: x))
    seeds = s.keep(lists.select("item_id", "words", "seed", "k").distinct(), "seeds")
    got = seeds.agg(F.max(F.size("words")), F.collect_set("k")).first()
    if got[0] is None:  # no document has a word
        return spark.createDataFrame([], "doc_id long, item_id long, score double, start_word long, end_word long")
    slots = seeds.select(F.col("seed").bitwiseAND(SLOTS - 1).alias("x")).distinct()
    bits = np.zeros(SLOTS, bool)
    bits[[r[0] for r in slots.toLocalIterator()]] = True  # at most SLOTS rows, whatever the benchmark
    # n matches, less one for each word of the text that has none, score 2 n threshold at least
    reach = int(got[0] * max(3 - MATCH * threshold, 1)) + gram
    near = texts.mapInArrow(lean(_stretches(sorted(got[1]), np.packbits(bits).tobytes(), reach)), "doc_id long, start long, words array<long>, seeds array<long>")
    near = s.keep(near, "near")
    hits = near.select("doc_id", "start", "words", F.explode(F.array_distinct("seeds")).alias("seed"))
    pairs = hits.join(seeds.select("item_id", F.col("words").alias("item"), "seed"), "seed").drop("seed").dropDuplicates(["doc_id", "start", "item_id", "item", "words"])
    out = pairs.mapInArrow(lean(_score(threshold)), "doc_id long, item_id long, score double, start_word long, end_word long").distinct()
    out = s.keep(out, "out")
    s.drop("items", "counts", "seeds", "near")
    return out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item.  Rows without
    doc_id stay."""
    s = Scratch(docs.sparkSession)
    p = unused(docs)
    found = s.keep(leaks(docs, benchmark, **how).where("doc_id is not null").select(F.col("doc_id").alias(f"{p}id")).distinct(), "leaky")
    # only documents that may be among them are shuffled
    marked = sifted(docs.withColumn(f"{p}id", F.col("doc_id").cast("long")), F.coalesce(F.col(f"{p}id"), F.lit(0)), found, F.col(f"{p}id"), p)
    sure = F.col(f"{p}id").isNull() | ~F.col(f"{p}maybe")
    rest = marked.where(~sure).join(found, f"{p}id", "left_anti")
    return marked.where(sure).select(docs.columns).unionByName(rest.select(docs.columns))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of ``documents`` that holds an item of ``benchmark``."""
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES = {"op6_decontamination": op6_decontamination}
ORACLE: dict[str, str] = {}
