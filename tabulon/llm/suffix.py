"""Suffix-array deduplication by a distributed difference-cover sort.

The suffixes of all documents are sorted word by word with the difference
cover {1, 2} modulo 3 (Karkkainen, Sanders and Burkhardt, 2006), level by level:

1. sort the triples of words at the sampled places (i mod 3 = 1 or 2) and name
   them by their rank;
2. recurse on the names, those of the places 1 mod 3 and then 2 mod 3, until
   all names differ, so that they are the ranks of the sampled suffixes;
3. merge the suffixes at the remaining places, whose order follows from their
   first word and the rank of the next place, with the sampled ones;
4. compare the prefixes of neighbours in the sorted order: a run of neighbours
   that agree on ``least`` words are the occurrences of one passage.

Only words that can belong to a repeat are sorted: equal passages of ``least``
words share a winnowed k-word gram, so words which no repeated gram reaches are
left out beforehand.  This is exact, it never loses a repeat.  What is left of a
document are stretches, each closed by a mark of its own.

Scale: a bucket (about ``BUCKET`` words of neighbouring documents) is one row
of packed numbers; a sort sends it as one packed slice for each range of keys,
so what moves is 4-byte numbers, and no row is made for a word.  Ranges follow
splitters from a sample of every bucket that grows with the number of ranges;
their number follows the number of words.  A level is two thirds of the one
above it; every level is a table in the shared folder, dropped when it has been
used.  Texts without a repeat are left out by a bitmap of fixed size before the
others are shuffled.

Defined results: null and empty texts and texts under ``least`` words have no
repeats; a null doc_id takes no part; rows that repeat doc_id and text are one
document; a document can repeat itself; of equal passages the one first in
doc_id, text hash and place is the original.  Other columns are ignored.  Words
are runs of bytes other than ASCII white space; they are sorted by 32-bit
hashes, and prefixes are compared by 48-bit hashes of their words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import kernel as K
from .groups import by_key, lean, sifted, unused
from .repeats import GRAM, LEAST, identified, seeds
from .session import Scratch, parallel

BUCKET, RANGE = 1 << 19, 400_000


def _np(blob: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(blob, kind)


# ---- which words can repeat -------------------------------------------------


def _seeds(least: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, h, _, _, at in K.tokens(K.strings(b.column("text"))):
                seed, first, count, _ = seeds(h, at, least, gram)
                doc = np.searchsorted(at, first, "right") - 1
                take = pa.array(doc + i)
                yield pa.RecordBatch.from_arrays([pa.array(seed.view(np.int64)), b.column("doc_id").take(take), b.column("h").take(take), pa.array((first - at[doc]).astype(np.int32)), pa.array(count.astype(np.int32))], ["seed", "doc_id", "h", "p", "n"])

    return run


def _crowded(t: pa.Table) -> pa.Table:
    seed = t["seed"].to_numpy()
    edge = np.flatnonzero(np.r_[True, seed[1:] != seed[:-1], True])
    return t.filter(pa.array(np.repeat(np.diff(edge) > 1, np.diff(edge)))).drop_columns("seed")


def _join_runs(p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Disjoint intervals that cover the intervals [p, q)."""
    order = np.argsort(p, kind="stable")
    p, q = p[order], np.maximum.accumulate(q[order])
    new = np.r_[True, p[1:] > q[:-1]]
    return p[new], q[np.append(np.flatnonzero(new)[1:] - 1, len(q) - 1)]


def _spans(least: int):
    """For one document a row: its stretches of words that can repeat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            starts, stops, size, longest = [], [], [], []
            for ps, ns in zip(b.column("ps").to_pylist(), b.column("ns").to_pylist()):
                p = np.array(ps, np.int64)
                a, z = _join_runs(p, p + np.array(ns) + least - 1)
                starts.append(a.astype(np.int32).tobytes())
                stops.append(z.astype(np.int32).tobytes())
                size.append(int((z - a).sum()) + len(a))
                longest.append(int((z - a).max()) + 1)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("h"), pa.array(starts, pa.binary()), pa.array(stops, pa.binary()), pa.array(size, pa.int64()), pa.array(longest, pa.int64())], ["doc_id", "h", "starts", "stops", "size", "longest"])

    return run


def _six(x: np.ndarray) -> bytes:
    """The low six bytes of each number."""
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unsix(blob: bytes) -> np.ndarray:
    out = np.zeros((len(blob) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(blob, np.uint8).reshape(-1, 6)
    return out.view("<u8").reshape(-1)


def _words(least: int):
    """The words of each stretch, each closed by a mark of its own, and the
    hash of the window of ``least`` words at each place (0: none)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            starts, stops = b.column("starts").to_pylist(), b.column("stops").to_pylist()
            nth = b.column("nth").to_numpy()
            syms, wins, sizes = [], [], []
            for i, h, _, _, at in K.tokens(K.strings(b.column("text"))):
                w = K.rolling(h, least) | np.uint64(1)
                for d in range(len(at) - 1):
                    s, z = _np(starts[i + d], np.int32).astype(np.int64), _np(stops[i + d], np.int32).astype(np.int64)
                    size = z - s + 1
                    o = np.concatenate([[0], np.cumsum(size)])
                    where = np.arange(o[-1]) - np.repeat(o[:-1] - s, size)
                    sym = (h[np.minimum(where + at[d], len(h) - 1)] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
                    sym[o[1:] - 1] = (K.mix(K.mix(nth[i + d : i + d + 1].astype(np.uint64)) + o[1:].astype(np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
                    win = np.zeros(o[-1], np.uint64)
                    fits = np.repeat(z, size) - where >= least
                    win[fits] = w[where[fits] + at[d]]
                    syms.append(sym.tobytes())
                    wins.append(_six(win))
                    sizes.append(size.astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays(
                [b.column("bucket"), b.column("nth"), pa.array(syms, pa.binary()), pa.array(wins, pa.binary()), pa.array(sizes, pa.binary()), b.column("starts")],
                ["bucket", "nth", "sym", "win", "sizes", "starts"],
            )

    return run


def _pack(t: pa.Table) -> pa.Table:
    """One row for each bucket; stretches in order of their documents."""
    t = t.sort_by([("bucket", "ascending"), ("nth", "ascending")])
    bucket = t["bucket"].to_numpy()
    edge = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True])
    sym, win, sizes, starts = (t[c].to_pylist() for c in ("sym", "win", "sizes", "starts"))
    nth = t["nth"].to_numpy()
    rows = [
        (int(bucket[a]), b"".join(sizes[a:z]), np.repeat(nth[a:z], [len(x) // 4 for x in sizes[a:z]]).astype(np.int64).tobytes(), b"".join(sym[a:z]), b"".join(win[a:z]), b"".join(starts[a:z]))
        for a, z in zip(edge[:-1], edge[1:])
    ]
    return pa.table(dict(zip(["bucket", "lens", "nths", "sym", "win", "starts"], [pa.array(c, pa.int32() if k == 0 else pa.binary()) for k, c in enumerate(zip(*rows))])))


# ---- the sort ---------------------------------------------------------------


def _layout(lens: np.ndarray):
    """(place within its document, length of its document) for every symbol."""
    o = np.concatenate([[0], np.cumsum(lens.astype(np.int64))])
    return np.arange(o[-1]) - np.repeat(o[:-1], lens), np.repeat(lens.astype(np.int64), lens), o


def _below(lens: np.ndarray) -> np.ndarray:
    """Lengths of the documents one level down."""
    n = lens.astype(np.int64)
    return ((n + 1) // 3 + n // 3).astype(np.int32)


def _down(inner: np.ndarray, size: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Where each sampled place (inner mod 3 in 1, 2) lies one level down."""
    o = np.concatenate([[0], np.cumsum(_below(lens).astype(np.int64))])[:-1]
    base = np.repeat(o, lens)
    return base + np.where(inner % 3 == 1, inner // 3, (size + 1) // 3 + inner // 3)


def _ahead(x: np.ndarray, inner: np.ndarray, size: np.ndarray, step: int) -> np.ndarray:
    """x at ``step`` places ahead in the same document, else 0."""
    out = np.zeros(len(x), x.dtype)
    if len(x) > step:
        out[:-step] = np.where(inner[:-step] + step < size[:-step], x[step:], 0)
    return out


def _sample(kind: str, every: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lens, sym in zip(b.column("lens").to_pylist(), b.column("sym").to_pylist()):
                s = _np(sym, kind)
                inner, size, _ = _layout(_np(lens, np.int32))
                t = [s, _ahead(s, inner, size, 1), _ahead(s, inner, size, 2)]
                pick = np.flatnonzero(K.mix(np.arange(len(s), dtype=np.uint64) + s.astype(np.uint64)) % np.uint64(every) == 0)
                yield pa.RecordBatch.from_arrays([pa.array(x[pick].astype(np.int64)) for x in t], ["a", "b", "c"])

    return run


def _ranges(a, b, c, splits: np.ndarray):
    """(order, cuts): places in order of their triples, and where each range
    of keys begins in that order."""
    order = np.lexsort((c, b, a))
    a, b, c = a[order], b[order], c[order]
    cuts, splits = [], splits.astype(a.dtype)
    for x, y, z in splits:
        lo, hi = np.searchsorted(a, x, "left"), np.searchsorted(a, x, "right")
        lo, hi = lo + np.searchsorted(b[lo:hi], y, "left"), lo + np.searchsorted(b[lo:hi], y, "right")
        cuts.append(lo + np.searchsorted(c[lo:hi], z, "left"))
    return order, np.concatenate([[0], cuts, [len(order)]]).astype(np.int64)


def _send_triples(kind: str, splits: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, lens, sym in zip(*(batch.column(c).to_pylist() for c in ("bucket", "lens", "sym"))):
                lens, s = _np(lens, np.int32), _np(sym, kind)
                inner, size, _ = _layout(lens)
                b, c = _ahead(s, inner, size, 1), _ahead(s, inner, size, 2)
                pick = np.flatnonzero(inner % 3 != 0)
                a, b, c, to = s[pick], b[pick], c[pick], _down(inner, size, lens)[pick].astype(np.int32)
                order, cuts = _ranges(a, b, c, splits)
                a, b, c, to = a[order], b[order], c[order], to[order]
                rows = [(r, bucket, a[x:y].tobytes() + b[x:y].tobytes() + c[x:y].tobytes(), to[x:y].tobytes()) for r, (x, y) in enumerate(zip(cuts[:-1], cuts[1:])) if y > x]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.binary(), pa.binary()))], ["range", "bucket", "keys", "to"])

    return run


def _bundles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each range; ranges that share a task come one by one."""
    got = [b for b in batches if b.num_rows]
    if got:
        t = pa.Table.from_batches(got)
        for r in np.unique(t["range"].to_numpy()):
            yield t.filter(pa.array(t["range"].to_numpy() == r))


def _name(kind: str):
    """Dense names of the triples of a range, and how many there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _bundles(batches):
            keys = [_np(k, kind).reshape(3, -1) for k in t["keys"].to_pylist()]
            a, b, c = np.concatenate(keys, 1)
            order = np.lexsort((c, b, a))
            x, y, z = a[order], b[order], c[order]
            new = np.r_[1, (x[1:] != x[:-1]) | (y[1:] != y[:-1]) | (z[1:] != z[:-1])]
            name = np.empty(len(order), np.uint32)
            name[order] = np.cumsum(new)
            o = np.concatenate([[0], np.cumsum([k.shape[1] for k in keys])])
            n = t.num_rows
            yield pa.RecordBatch.from_arrays(
                [t["range"].combine_chunks(), pa.array(np.full(n, new.sum(), np.int64)), t["bucket"].combine_chunks(), t["to"].combine_chunks(), pa.array([name[i:j].tobytes() for i, j in zip(o[:-1], o[1:])], pa.binary())],
                ["range", "count", "bucket", "to", "name"],
            )

    return run


def _place(kind: str, base: dict[int, int]):
    """Put names or ranks at their places in the buckets.  The row of range -1
    is the bucket's own (lengths in ``to``, symbols in ``name``): (bucket,
    lens, sym, win, lens and names one level down)."""

    def run(t: pa.Table) -> pa.Table:
        bucket, rng, to, name, win = (t[c].to_pylist() for c in ("bucket", "range", "to", "name", "win"))
        open_: dict[int, list] = {}
        for row in zip(bucket, rng, to, name, win):
            open_.setdefault(row[0], []).append(row[1:])
        out = []
        for k, parts in open_.items():
            own = next(x for x in parts if x[0] < 0)
            below = _below(_np(own[1], np.int32))
            s = np.zeros(int(below.sum(dtype=np.int64)), kind)
            for r, x, y, _ in parts:
                if r >= 0:
                    s[_np(x, np.int32)] = _np(y, np.uint32).astype(kind) + np.dtype(kind).type(base[r])
            out.append((k, own[1], own[2], own[3], below.tobytes(), s.tobytes()))
        kinds = (pa.int32(), *[pa.binary()] * 5)
        return pa.table({c: pa.array([x[j] for x in out], kinds[j]) for j, c in enumerate(("bucket", "lens", "sym", "win", "below", "rank"))})

    return run


PLACED = "bucket int, lens binary, sym binary, win binary, below binary, rank binary"


def _send_suffixes(kind: str, rkind: str, splits: np.ndarray, top: bool):
    """Every suffix with what orders it: class, first two symbols, ranks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = ("bucket", "lens", "sym", "rank", "win")
            for bucket, lens, sym, rank, win in zip(*(batch.column(c).to_pylist() for c in cols)):
                lens, s, low = _np(lens, np.int32), _np(sym, kind), _np(rank, rkind)
                inner, size, _ = _layout(lens)
                b, c = _ahead(s, inner, size, 1), _ahead(s, inner, size, 2)
                kind3 = (inner % 3).astype(np.uint8)
                own = np.zeros(len(s), rkind)
                sampled = kind3 != 0
                own[sampled] = low[_down(inner, size, lens)[sampled]]
                one, two = _ahead(own, inner, size, 1), _ahead(own, inner, size, 2)
                ra, rb = np.where(kind3 == 2, own, one), np.where(kind3 == 1, own, two)
                order, cuts = _ranges(s, b, c, splits)
                cols_ = [x[order] for x in (s, b, ra, rb, kind3)]
                to = order.astype(np.int32)
                if top:
                    cols_.append(_np(win, "V6")[order])
                rows = [(r, bucket, b"".join(v[x:y].tobytes() for v in cols_), to[x:y].tobytes()) for r, (x, y) in enumerate(zip(cuts[:-1], cuts[1:])) if y > x]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.binary(), pa.binary()))], ["range", "bucket", "keys", "to"])

    return run


def _dense(*keys: np.ndarray) -> np.ndarray:
    """Ranks from 0 of the tuples; equal tuples have equal ranks."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def _merged(a, b, ra, rb, kind3) -> np.ndarray:
    """The order of the suffixes of a range."""
    c0, c1, c2 = (np.flatnonzero(kind3 == k) for k in range(3))
    sampled = np.concatenate([c1, c2])
    sampled = sampled[np.argsort(np.concatenate([rb[c1], ra[c2]]), kind="stable")]
    rest = c0[np.lexsort((ra[c0], a[c0]))]
    at = np.empty(len(a), np.int64)
    at[sampled], at[rest] = np.arange(len(sampled)), np.arange(len(rest))
    # a place 0 mod 3 against 1 mod 3: first symbol, then the next place's rank
    both = np.concatenate([c0, c1])
    key = _dense(a[both], ra[both])
    k0, k1 = key[: len(c0)], key[len(c0) :]
    at[c0] += np.searchsorted(np.sort(k1), k0, "left")
    at[c1] += np.searchsorted(np.sort(k0), k1, "right")
    # against 2 mod 3: two symbols, then the rank of the place after them
    both = np.concatenate([c0, c2])
    key = _dense(a[both], b[both], rb[both])
    k0, k2 = key[: len(c0)], key[len(c0) :]
    at[c0] += np.searchsorted(np.sort(k2), k0, "left")
    at[c2] += np.searchsorted(np.sort(k0), k2, "right")
    return np.argsort(at, kind="stable")


def _read_suffixes(blobs: list[bytes], kind: str, rkind: str, extra: tuple[str, ...]) -> list[np.ndarray]:
    kinds = (kind, kind, rkind, rkind, "u1", *extra)
    width = sum(np.dtype(k).itemsize for k in kinds)
    cols: list[list] = [[] for _ in kinds]
    for blob in blobs:
        n, at = len(blob) // width, 0
        for k, col in zip(kinds, cols):
            col.append(np.frombuffer(blob, k, n, at))
            at += n * np.dtype(k).itemsize
    return [np.concatenate(c) for c in cols]


def _rank(kind: str, rkind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _bundles(batches):
            blobs = t["keys"].to_pylist()
            order = _merged(*_read_suffixes(blobs, kind, rkind, ()))
            rank = np.empty(len(order), np.uint32)
            rank[order] = np.arange(1, len(order) + 1)
            o = np.concatenate([[0], np.cumsum([len(x) // 4 for x in t["to"].to_pylist()])])
            yield pa.RecordBatch.from_arrays(
                [t["range"].combine_chunks(), pa.array(np.full(t.num_rows, len(order), np.int64)), t["bucket"].combine_chunks(), t["to"].combine_chunks(), pa.array([rank[i:j].tobytes() for i, j in zip(o[:-1], o[1:])], pa.binary())],
                ["range", "count", "bucket", "to", "name"],
            )

    return run


def _compare(kind: str, rkind: str):
    """Runs of neighbours with equal prefixes; copies and their original, which
    is the first by bucket and place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _bundles(batches):
            a, b, ra, rb, kind3, win = _read_suffixes(t["keys"].to_pylist(), kind, rkind, ("V6",))
            order = _merged(a, b, ra, rb, kind3)
            win = _unsix(win.tobytes())
            to = np.concatenate([_np(x, np.int32) for x in t["to"].to_pylist()])
            sizes = [len(x) // 4 for x in t["to"].to_pylist()]
            bucket = np.repeat(t["bucket"].to_numpy(), sizes)
            order = order[win[order] != 0]
            if not len(order):
                continue
            win, to, bucket = win[order], to[order], bucket[order]
            run_ = np.cumsum(np.r_[0, win[1:] != win[:-1]])
            by = np.lexsort((to, bucket, run_))
            run_, to, bucket = run_[by], to[by], bucket[by]
            new = np.r_[True, run_[1:] != run_[:-1]]
            at = np.flatnonzero(new)[np.cumsum(new) - 1]
            code = (bucket[at].astype(np.int64) << 32 | to[at])[~new]
            to, bucket = to[~new], bucket[~new]
            by = np.argsort(bucket, kind="stable")
            to, bucket, code = to[by], bucket[by], code[by]
            edge = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True]) if len(bucket) else np.zeros(1, int)
            rows = [(int(bucket[x]), to[x:y].tobytes(), code[x:y].tobytes()) for x, y in zip(edge[:-1], edge[1:])]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t_) for x, t_ in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary()))], ["bucket", "to", "first"])

    return run


def _where(row: dict, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document number, word) of places in a bucket."""
    lens, starts, nths = _np(row["lens"], np.int32).astype(np.int64), _np(row["starts"], np.int32), _np(row["nths"], np.int64)
    ends = np.cumsum(lens)
    k = np.searchsorted(ends, at, "right")
    return nths[k], at - (ends[k] - lens[k]) + starts[k]


def _report(least: int):
    """Copies that follow each other beside their originals become one row:
    (document, words, bucket and place of the original)."""

    def run(t: pa.Table) -> pa.Table:
        groups: dict[int, list] = {}
        for row in t.to_pylist():
            groups.setdefault(row["bucket"], []).append(row)
        out: list[tuple] = []
        for rows in groups.values():
            own = [r for r in rows if r["lens"] is not None]
            hits = [r for r in rows if r["lens"] is None]
            if not own or not hits:
                continue
            to, first = np.concatenate([_np(r["to"], np.int32) for r in hits]).astype(np.int64), np.concatenate([_np(r["first"], np.int64) for r in hits])
            order = np.argsort(to)
            to, first = to[order], first[order]
            new = np.r_[True, (to[1:] != to[:-1] + 1) | (first[1:] != first[:-1] + 1)]
            at = np.flatnonzero(new)
            n = np.diff(np.append(at, len(to)))
            nth, p = _where(own[0], to[at])
            out.append((nth, p, p + n - 1 + least, first[at] >> 32, first[at] & 0xFFFFFFFF))
        cols = [np.concatenate(c).astype(np.int64) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 5
        return pa.table(dict(zip(["nth", "start_word", "end_word", "bucket", "place"], cols)))

    return run


def _originals(t: pa.Table) -> pa.Table:
    """The document of each original; rows of one document and one original
    that touch become one."""
    rows = t.select(["bucket", "lens", "nths", "starts"]).filter(t["lens"].is_valid()).to_pylist()
    own = {r["bucket"]: r for r in rows}
    hits = t.filter(t["lens"].is_null())
    bucket, place = hits["bucket"].to_numpy(), hits["place"].to_numpy()
    first = np.zeros(len(bucket), np.int64)
    for k in np.unique(bucket):
        mine = bucket == k
        first[mine], _ = _where(own[int(k)], place[mine])
    nth, start, end = (hits[c].to_numpy() for c in ("nth", "start_word", "end_word"))
    order = np.lexsort((start, first, nth))
    nth, start, end, first = nth[order], start[order], end[order], first[order]
    # the furthest end so far within a group of one document and original
    group = np.cumsum(np.r_[False, (nth[1:] != nth[:-1]) | (first[1:] != first[:-1])])
    reach = np.maximum.accumulate(end + group * (1 << 40)) - group * (1 << 40) if len(end) else end
    new = np.r_[True, (group[1:] != group[:-1]) | (start[1:] > reach[:-1])] if len(end) else np.zeros(0, bool)
    last = np.r_[new[1:], True] if len(end) else new
    return pa.table({"nth": nth[new], "start_word": start[new], "end_word": reach[last], "first": first[new]})


# ---- the operator -----------------------------------------------------------


def repeated_passages(docs: DataFrame, least: int = LEAST, gram: int = GRAM) -> DataFrame:
    """(doc_id, h, start_word, end_word, first_id): words [start, end) of the
    document are made of windows of ``least`` words that occur first in the
    document first_id (which can be the same document)."""
    spark = docs.sparkSession
    s, n = Scratch(spark), parallel(spark, docs)
    ids = identified(docs)
    found = by_key(ids.mapInArrow(lean(_seeds(least, gram)), "seed long, doc_id long, h long, p int, n int"), "seed", _crowded, "doc_id long, h long, p int, n int", n).distinct()
    spans = found.groupBy("doc_id", "h").agg(F.collect_list(F.struct("p", "n")).alias("x")).select("doc_id", "h", F.col("x.p").alias("ps"), F.col("x.n").alias("ns"))
    spans = s.keep(spans.mapInArrow(lean(_spans(least)), "doc_id long, h long, starts binary, stops binary, size long, longest long").where("size > 0"), "spans")
    # number the documents in order; a bucket is the numbers of words before
    part = spans.select("doc_id", "h", "size", "longest").repartitionByRange(n, "doc_id", "h").withColumn("part", F.spark_partition_id())
    part = s.keep(part, "part")
    sums = {r["part"]: (r["docs"], r["words"], r["longest"]) for r in part.groupBy("part").agg(F.count("*").alias("docs"), F.sum("size").alias("words"), F.max("longest").alias("longest")).collect()}
    docs_before = words_before = 0
    before = []
    for k in sorted(sums):
        before.append((k, docs_before, words_before))
        docs_before, words_before = docs_before + sums[k][0], words_before + sums[k][1]
    if not words_before:
        return spark.createDataFrame([], "doc_id long, h long, start_word long, end_word long, first_id long")
    longest = max(x for _, _, x in sums.values())
    offsets = F.broadcast(spark.createDataFrame(before, "part int, d long, w long"))  # one row for each partition
    w = Window.partitionBy("part").orderBy("doc_id", "h")
    order = part.join(offsets, "part").withColumn("nth", F.col("d") + F.row_number().over(w) - 1).withColumn("at", F.col("w") + F.sum("size").over(w) - F.col("size"))
    order = s.keep(order.select("doc_id", "h", "nth", F.floor(F.col("at") / BUCKET).cast("int").alias("bucket")), "order")
    key = F.xxhash64("doc_id", "h")
    some = sifted(ids, key, spans, key).where("__maybe").drop("__maybe")
    text = some.join(spans.drop("size", "longest").join(order, ["doc_id", "h"]), ["doc_id", "h"]).dropDuplicates(["doc_id", "h"]).drop("doc_id", "h")
    cut = text.mapInArrow(lean(_words(least)), "bucket int, nth long, sym binary, win binary, sizes binary, starts binary")
    level = s.keep(by_key(cut, "bucket", _pack, "bucket int, lens binary, nths binary, sym binary, win binary, starts binary", n), "level-0")
    s.drop("spans", "part")

    size, kinds, levels, splitters, ranges = words_before, ["u4"], [level], [], []
    while True:
        depth, kind, count = len(levels) - 1, kinds[-1], max(1, -(-size // RANGE))
        every = max(1, size // (count * 100))
        seen = np.array([tuple(r) for r in levels[-1].select("lens", "sym").mapInArrow(lean(_sample(kind, every)), "a long, b long, c long").collect()], np.int64).reshape(-1, 3)
        seen = seen[np.lexsort(seen.T[::-1])]
        splits = seen[(np.arange(1, count) * len(seen)) // count] if len(seen) else np.zeros((0, 3), np.int64)
        splitters.append(splits)
        ranges.append(count)
        names = levels[-1].select("bucket", "lens", "sym").mapInArrow(lean(_send_triples(kind, splits)), "range int, bucket int, keys binary, to binary").repartitionById(count, "range").mapInArrow(lean(_name(kind)), "range int, count long, bucket int, to binary, name binary")
        names = s.keep(names, f"names-{depth}")
        base, different, size = _bases(names)
        kinds.append("u4" if words_before < 1 << 31 else "u8")
        # equal names beyond the longest stretch are of equal suffixes
        if different == size or 3 ** (depth + 1) >= longest:
            break
        below = _placed(names, levels[-1], kinds[-1], base, n).select("bucket", F.col("below").alias("lens"), F.col("rank").alias("sym"))
        levels.append(s.keep(below, f"level-{depth + 1}"))
        s.drop(f"names-{depth}")
    parts, last = names, f"names-{depth}"
    for depth in reversed(range(len(levels))):
        top, kind, rkind = depth == 0, kinds[depth], kinds[depth + 1]
        sent = _placed(parts, levels[depth], rkind, base, n).mapInArrow(lean(_send_suffixes(kind, rkind, splitters[depth], top)), "range int, bucket int, keys binary, to binary").repartitionById(ranges[depth], "range")
        if top:
            copies = s.keep(sent.mapInArrow(lean(_compare(kind, rkind)), "bucket int, to binary, first binary"), "copies")
            break
        parts = s.keep(sent.mapInArrow(lean(_rank(kind, rkind)), "range int, count long, bucket int, to binary, name binary"), f"ranked-{depth}")
        base, _, _ = _bases(parts)
        s.drop(last, f"level-{depth}")
        last = f"ranked-{depth}"
    s.drop(last)
    nothing = lambda *names: [F.lit(None).cast("binary").alias(c) for c in names]
    own = levels[0].select("bucket", "lens", "nths", "starts")
    found = by_key(own.select("*", *nothing("to", "first")).unionByName(copies.select("*", *nothing("lens", "nths", "starts"))), "bucket", _report(least), "nth long, start_word long, end_word long, bucket long, place long", n)
    found = found.withColumn("bucket", F.col("bucket").cast("int"))
    both = found.select("*", *nothing("lens", "nths", "starts")).unionByName(own.select("*", *[F.lit(None).cast("long").alias(c) for c in ("nth", "start_word", "end_word", "place")]))
    found = by_key(both, "bucket", _originals, "nth long, start_word long, end_word long, first long", n)
    ids_ = order.select("doc_id", "h", "nth")
    out = found.join(ids_, "nth").join(ids_.select(F.col("nth").alias("first"), F.col("doc_id").alias("first_id")), "first")
    out = s.keep(out.select("doc_id", "h", "start_word", "end_word", "first_id"), "out")
    s.drop("copies", "order", "level-0")
    return out


def _bases(parts: DataFrame) -> tuple[dict[int, int], int, int]:
    """How many names the ranges before each range have; all names; all places."""
    rows = parts.groupBy("range").agg(F.max("count").alias("names"), F.sum(F.octet_length("to")).alias("bytes")).collect()  # one row for each range
    base, total, size = {}, 0, 0
    for r in sorted(rows, key=lambda r: r["range"]):
        base[r["range"]], total, size = total, total + r["names"], size + r["bytes"] // 4
    return base, total, size


def _placed(parts: DataFrame, level: DataFrame, kind: str, base: dict[int, int], n: int) -> DataFrame:
    """Names or ranks of all ranges, made global, beside what they rank."""
    win = F.col("win") if "win" in level.columns else F.lit(None).cast("binary")
    own = level.select("bucket", F.lit(-1).alias("range"), F.col("lens").alias("to"), F.col("sym").alias("name"), win.alias("win"))
    rows = parts.select("bucket", "range", "to", "name", F.lit(None).cast("binary").alias("win")).unionByName(own)
    return by_key(rows, "bucket", _place(kind, base), PLACED, n)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Remove the words of the spans in the last two columns from the texts."""
    for b in batches:
        text = b.column("text")
        starts, stops = b.column(b.num_columns - 2).to_pylist(), b.column(b.num_columns - 1).to_pylist()
        hit = np.array([x is not None for x in starts], bool)
        out = text.to_pylist() if hit.any() else None
        if out is not None:
            rows = np.flatnonzero(hit)
            for i, _, first, last, at in K.tokens(K.strings(text.take(pa.array(rows)))):
                for d in range(len(at) - 1):
                    r = rows[i + d]
                    a, z = _join_runs(np.array(starts[r]), np.array(stops[r]))
                    raw, parts, done = out[r].encode(), [], 0
                    f, e = first[at[d] : at[d + 1]], last[at[d] : at[d + 1]]
                    for x, y in zip(a, z):
                        parts.append(raw[done : f[x]])
                        done = int(e[y - 1])
                    parts.append(raw[done:])
                    out[r] = b"".join(parts).decode().strip()
        cols = [pa.array(out, text.type) if name == "text" and out is not None else b.column(name) for name in b.schema.names[:-2]]
        names = b.schema.names[:-2]
        if "n_chars" in names and out is not None:
            k = names.index("n_chars")
            old = cols[k].to_pylist()
            for r in np.flatnonzero(hit):
                old[r] = len(out[r])
            cols[k] = pa.array(old, cols[k].type)
        yield pa.RecordBatch.from_arrays(cols, names)


def remove_repeats(docs: DataFrame, least: int = LEAST, gram: int = GRAM) -> DataFrame:
    """``docs`` without the passages that occurred before.  Every row stays,
    n_chars follows the text; a text may become empty.  Rows without doc_id
    are unchanged."""
    s = Scratch(docs.sparkSession)
    p = unused(docs)
    found = repeated_passages(docs, least, gram).groupBy(F.col("doc_id").alias(f"{p}id"), F.col("h").alias(f"{p}h")).agg(F.collect_list(F.struct("start_word", "end_word")).alias("x"))
    found = s.keep(found.select(f"{p}id", f"{p}h", F.col("x.start_word").alias(f"{p}starts"), F.col("x.end_word").alias(f"{p}stops")), "found")
    keyed = docs.withColumn(f"{p}id", F.col("doc_id").cast("long")).withColumn(f"{p}h", F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    keyed = sifted(keyed, F.xxhash64(f"{p}id", f"{p}h"), found, F.xxhash64(f"{p}id", f"{p}h"), p)
    hit = keyed.where(f"{p}maybe").join(found, [f"{p}id", f"{p}h"], "left").select(*docs.columns, f"{p}starts", f"{p}stops").mapInArrow(lean(_cut), docs.schema)
    return keyed.where(f"not {p}maybe").select(docs.columns).unionByName(hit)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every passage of at least 50 words in ``documents`` that occurred before."""
    return repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("h")


QUERIES = {"op7_suffix_dedup": op7_suffix_dedup}
ORACLE: dict[str, str] = {}
