"""Token ids as Re-Pair grammars.

The documents of a shard are one sequence of token ids.  Re-Pair (Larsson and
Moffat, 1999) replaces frequent pairs of neighbours by new symbols, again and
again, and keeps the rules.  Each round counts all pairs that lie within a
document and replaces every place where a frequent pair is at least as frequent
as the pairs that overlap it (the more frequent pair wins, as in Re-Pair), for
all such pairs at once; rounds go on until no pair occurs ``LEAST`` times without
overlapping itself.  Pairs are counted by one sort, in which a pair and its place
are one number; a pair becomes a rule by the number of places that it won.
After a round only pairs that were frequent or have a new symbol can be
frequent, so only these are counted again.

A rule has the length of its expansion, so decoding is random access: document
boundaries are symbol boundaries, an inner range is found by the running sum of
lengths, and only rules that reach into it are expanded.

Scale: no shuffle.  A task makes shards of about ``SHARD`` tokens from the
documents it reads, so memory doesn't depend on the data; each round is a few
array operations over the sequence that is left.

Defined results: a null text is an entry with null size, an empty one an entry
of size 0; null doc_ids and repeated rows are entries of their own; an empty
table gives no shard; a document of more than ``SHARD`` tokens is a shard
alone or ends one.  Of equally frequent overlapping pairs the left one wins.
Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import VOCABULARY, codec
from .session import ship

SHARD, LEAST = 1 << 20, 2
SHARD_SCHEMA = "shard long, doc_ids array<long>, sizes array<int>, symbols array<int>, starts array<int>, base int, left array<int>, right array<int>, lengths array<int>, n_tokens long"


def _classes(key: np.ndarray, bound: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys (all below ``bound``) that occur ``least`` times, how
    often each occurs, and the number of the class of each key, -1 for others.
    ``key`` is overwritten."""
    n = len(key)
    bits = n.bit_length()
    if bound.bit_length() + bits < 64:  # keys and places in one number: several times as fast as a sort of indices
        key <<= bits
        key |= np.arange(n)
        key.sort()
        order = key & (1 << bits) - 1
        key >>= bits
    else:
        order = np.argsort(key, kind="stable")
        key = key[order]
    head = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][:n])
    count = np.diff(head, append=n)
    often = count >= least
    which = np.full(n, -1, np.int32)
    which[order[np.repeat(often, count)]] = np.repeat(np.arange(often.sum(), dtype=np.int32), count[often])
    return key[head[often]], count[often], which


def _apart(touch: np.ndarray) -> np.ndarray:
    """Flags of the places that are left when every second one of a run is
    dropped; touch[i]: place i + 1 is in a run with place i."""
    out = np.ones(len(touch) + 1, bool)
    later = np.flatnonzero(touch) + 1
    lead = np.flatnonzero(np.r_[True, later[1:] != later[:-1] + 1][: len(later)])
    step = np.arange(len(later)) - np.repeat(lead, np.diff(lead, append=len(later)))
    out[later[step % 2 == 0]] = False
    return out


def repair(ids: np.ndarray, starts: np.ndarray, base: int, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, starts of the documents among them, left, right): symbol
    base + k stands for left[k] and right[k]; smaller ones are ids."""
    seq, starts = ids.astype(np.int32), starts.astype(np.int64)
    left, right, size = [], [], base
    last = np.zeros(len(seq), bool)  # the last symbols of documents
    last[-1:] = True
    last[starts[starts > 0] - 1] = True
    # a pair within a document can only win later if it is frequent now, or new
    place = np.flatnonzero(~last)
    while True:
        key = seq[place].astype(np.int64)
        key *= size
        key += seq[1:][place]
        new, count, which = _classes(key, size * size, least)
        often = np.flatnonzero(which >= 0)
        place, which = place[often], which[often]
        if not len(place):
            break
        # a pair loses to a more frequent one that it overlaps
        times = count[which]
        beside = place[1:] == place[:-1] + 1
        win = np.ones(len(place), bool)
        win[:-1] &= ~(beside & (times[:-1] < times[1:]))
        win[1:] &= ~(beside & (times[1:] < times[:-1]))
        best = np.flatnonzero(win)
        # runs of equal counts: every second place from the left
        best = best[_apart(place[best[1:]] == place[best[:-1]] + 1)]
        good = np.bincount(which[best], minlength=len(new)) >= least
        if good.any():
            best = best[good[which[best]]]
            at, which = place[best], which[best]
        else:
            # ties took each other's places: the most frequent pair goes alone
            order = np.argsort(which, kind="stable")
            at, of = place[order], which[order]
            alone = _apart((at[1:] == at[:-1] + 1) & (of[1:] == of[:-1]))
            times = np.bincount(of[alone], minlength=len(new))
            good[k := int(times.argmax())] = True
            if times[k] < least:  # all that are left overlap themselves
                break
            place = place[(times >= least)[which]]
            at, which = at[alone & (of == k)], of[alone & (of == k)]
        seq[at] = (np.cumsum(good) + (size - 1)).astype(np.int32)[which]
        left.append(new[good] // size)
        right.append(new[good] % size)
        size += len(left[-1])
        # pairs with a new symbol are open
        last[at] = last[at + 1]
        open_ = np.zeros(len(seq), bool)
        open_[place] = True
        open_[at - 1] = True  # before the first symbol is the last one, which has no pair
        open_ &= ~last
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        keep = np.flatnonzero(keep)  # faster than flags
        seq, last, place = seq[keep], last[keep], np.flatnonzero(open_[keep])
        starts -= np.searchsorted(at, starts - 1)
    join = lambda x: np.concatenate(x or [np.zeros(0)]).astype(np.int32)
    return seq, starts.astype(np.int32), join(left), join(right)


def lengths(base: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Expansion lengths of the rules; a rule refers to earlier ones."""
    out = np.ones(base + len(left), np.int32)
    done = 0
    while done < len(left):  # a stretch of rules that don't refer to each other at a time
        part = np.maximum(left[done:], right[done:]) >= base + done
        n = int(np.argmax(part)) if part.any() else len(part)
        out[base + done : base + done + n] = out[left[done : done + n]] + out[right[done : done + n]]
        done += n
    return out[base:]


class Shard:
    """Random access to one row of ``compress``."""

    def __init__(self, row):
        get = lambda k: np.array(row[k], np.int64)
        self.base, self.symbols, self.starts = row["base"], get("symbols"), get("starts")
        self.left, self.right, self.lengths = get("left"), get("right"), get("lengths")
        self.doc_ids, self.sizes = row["doc_ids"], row["sizes"]
        self.size = np.where(self.symbols < self.base, 1, self.lengths[np.maximum(self.symbols - self.base, 0)] if len(self.lengths) else 1)
        self.ends = np.cumsum(self.size)

    def document(self, k: int) -> np.ndarray | None:
        """Token ids of the k-th document."""
        if self.sizes[k] is None:
            return None
        a = self.starts[k]
        begin = self.ends[a - 1] if a else 0
        return self.range(int(begin), int(begin) + self.sizes[k])

    def range(self, i: int, j: int) -> np.ndarray:
        """Tokens [i, j) of the shard."""
        out: list[int] = []
        if i >= j:
            return np.zeros(0, np.int32)
        a, z = np.searchsorted(self.ends, i, "right"), np.searchsorted(self.ends, j, "left")
        at = int(self.ends[a] - self.size[a])
        stack = [(int(s), 0) for s in self.symbols[a : z + 1][::-1]]
        while stack:
            s, _ = stack.pop()
            n = 1 if s < self.base else int(self.lengths[s - self.base])
            if at + n <= i or at >= j:
                at += n
            elif s < self.base:
                out.append(s)
                at += 1
            else:
                stack += [(int(self.right[s - self.base]), 0), (int(self.left[s - self.base]), 0)]
        return np.array(out, np.int32)


def _shards(vocabulary: str, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary)
        base = len(c.bytes)
        number = TaskContext.get().partitionId() << 32
        ids: list[np.ndarray | None] = []
        docs: list[int | None] = []
        held = 0

        def emit() -> pa.RecordBatch:
            nonlocal number
            sizes = [None if x is None else len(x) for x in ids]
            o = np.concatenate([[0], np.cumsum([n or 0 for n in sizes])]).astype(np.int64)
            flat = np.concatenate([x for x in ids if x is not None] or [np.zeros(0, np.int32)])
            symbols, starts, left, right = repair(flat, o[:-1], base)
            row = [number, docs, sizes, symbols, starts, base, left, right, lengths(base, left, right), len(flat)]
            number += 1
            one = lambda x, t: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, t))
            kinds = [pa.int64(), None, None, None, None, pa.int32(), None, None, None, pa.int64()]
            cols = [pa.array([x], k) if k else one(x, pa.int64() if x is docs else pa.int32()) for x, k in zip(row, kinds)]
            return pa.RecordBatch.from_arrays(cols, ["shard", "doc_ids", "sizes", "symbols", "starts", "base", "left", "right", "lengths", "n_tokens"])

        for b in batches:
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text")):
                text = text.as_py()
                ids.append(None if text is None else np.array(c.leaf(text), np.int32))
                docs.append(doc)
                held += 0 if text is None else len(ids[-1])
                if held >= limit:
                    yield emit()
                    ids, docs, held = [], [], 0
        if docs:
            yield emit()

    return run


def compress(docs: DataFrame, vocabulary: str = VOCABULARY, shard: int = SHARD) -> DataFrame:
    """One row for each shard (see ``SHARD_SCHEMA``)."""
    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_shards(vocabulary, shard), SHARD_SCHEMA)


def _expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for row in b.to_pylist():
            s = Shard(row)
            ids = [s.document(k) for k in range(len(s.doc_ids))]
            yield pa.RecordBatch.from_arrays([pa.array(s.doc_ids, pa.int64()), pa.array([None if x is None else x.tolist() for x in ids], pa.list_(pa.int32()))], ["doc_id", "ids"])


def expand(shards: DataFrame) -> DataFrame:
    """(doc_id, ids) of every document."""
    ship(shards.sparkSession)
    return shards.mapInArrow(_expand, "doc_id long, ids array<int>")


def op10_token_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token ids of all ``documents`` as one grammar for each shard."""
    return compress(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op10_token_grammar": op10_token_grammar}
ORACLE: dict[str, str] = {}
