"""Vectorised text kernels that work on Arrow string buffers.

Words are hashed straight from the UTF-8 bytes with prefix sums of a
polynomial hash, so no Python string is made per word.  Memory is bounded by
``CHUNK`` bytes of text at a time (a longer document forms a chunk alone).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 19
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}

#: Bytes that belong to words: everything but ASCII white space ...
SPACE = np.ones(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = False
#: ... or ASCII letters, digits and every byte of a non-ASCII character.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = True
ALNUM[128:] = True


def mix(h: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3, a bijection."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def mix32(h: np.ndarray) -> np.ndarray:
    """The 32-bit finaliser of MurmurHash3, a bijection on uint32."""
    h = h ^ (h >> np.uint32(16))
    h *= np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(13)
    h *= np.uint32(0xC2B2AE35)
    h ^= h >> np.uint32(16)
    return h


def _cumpow(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0], have = 1, 1
    while have < n:
        step = min(have, n - have)
        np.multiply(out[:step], np.uint64(pow(base, have, 1 << 64)), out=out[have : have + step])
        have += step
    return out


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least n powers of the hash base, and of its inverse."""
    size = 1 << max(20, int(n - 1).bit_length()) if n > 1 else 1 << 20
    if max(_POWERS, default=0) < size:
        _POWERS.clear()
        _POWERS[size] = (_cumpow(_BASE, size), _cumpow(pow(_BASE, -1, 1 << 64), size))
    return _POWERS[max(_POWERS)]


def strings(column: pa.Array | pa.ChunkedArray, lower: bool = False) -> pa.Array:
    """One large_string array without nulls (a null counts as '')."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = pc.fill_null(column.cast(pa.large_string()), "")
    return pc.utf8_lower(column) if lower else column


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a large_string array."""
    n = len(column)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64, n + 1, column.offset * 8) if offs is not None and n else np.zeros(n + 1, np.int64)
    return offsets, np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)


def chunks(offsets: np.ndarray, limit: int = CHUNK):
    """Ranges (i, j) of documents with about ``limit`` bytes together."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def tokens(column: pa.Array, table: np.ndarray = SPACE, limit: int = CHUNK):
    """For each chunk of documents: (first document, hash of each word, byte
    start and end of each word within its document, word offsets by document).
    """
    offsets, data = raw(column)
    for i, j in chunks(offsets, limit):
        lo, hi = int(offsets[i]), int(offsets[j])
        b = data[lo:hi]
        rel = offsets[i : j + 1] - lo
        if not len(b):
            z = np.zeros(0, np.int64)
            yield i, np.zeros(0, np.uint64), z, z, np.zeros(j - i + 1, np.int64)
            continue
        word = table[b]
        first = np.empty(len(b), bool)
        first[0] = True
        np.logical_not(word[:-1], out=first[1:])
        inner = rel[:-1][rel[:-1] < len(b)]
        first[inner] = True
        first &= word
        last = np.empty(len(b), bool)
        last[-1] = True
        np.logical_not(word[1:], out=last[:-1])
        last[inner[inner > 0] - 1] = True
        last &= word
        start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
        p, q = powers(len(b))
        sums = np.empty(len(b) + 1, np.uint64)
        sums[0] = 0
        np.cumsum((b.astype(np.uint64) + np.uint64(1)) * p[: len(b)], out=sums[1:])
        h = mix((sums[end] - sums[start]) * q[start])
        at = np.searchsorted(start, rel)
        base = np.repeat(rel[:-1], np.diff(at))
        yield i, h, start - base, end - base, at


def rolling(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each window of k neighbours (before document ends are minded)."""
    n = len(h)
    if n < k:
        return np.zeros(0, np.uint64)
    cur, width, out, done, bits = h, 1, None, 0, k
    while bits:
        if bits & 1:
            if out is None:
                out, done = cur, width
            else:
                m = n - (done + width) + 1
                out = out[:m] * np.uint64(pow(_BASE, width, 1 << 64)) + cur[done : done + m]
                done += width
        bits >>= 1
        if bits:
            m = len(cur) - width
            cur = cur[:m] * np.uint64(pow(_BASE, width, 1 << 64)) + cur[width : width + m]
            width *= 2
    return mix(out[: n - k + 1])


def room(at: np.ndarray, k: int) -> np.ndarray:
    """Whether the window of k words that begins at each word ends within the
    word's document; one flag for each of the n-k+1 windows."""
    n = int(at[-1])
    if n < k:
        return np.zeros(0, bool)
    until = np.repeat(at[1:], np.diff(at))[: n - k + 1]
    return np.arange(n - k + 1) + k <= until


def shingles(h: np.ndarray, at: np.ndarray, k: int):
    """Hashes of the k-word shingles, and offsets by document.  A document of
    1 to k-1 words has one shingle, all its words."""
    ok = room(at, k)
    where = np.flatnonzero(ok)
    out = rolling(h, k)[where]
    offs = np.searchsorted(where, at)
    size = np.diff(at)
    short = np.flatnonzero((size > 0) & (size < k))
    if len(short):
        extra = np.array([rolling(h[at[d] : at[d + 1]], int(size[d]))[0] ^ np.uint64(size[d]) for d in short], np.uint64)
        out = np.insert(out, offs[short], extra)
        offs = offs + np.concatenate([[0], np.cumsum(np.isin(np.arange(len(size)), short))])
    return out, offs


def distinct(values: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each group."""
    group = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    order = np.lexsort((values, group))
    v, g = values[order], group[order]
    keep = np.ones(len(v), bool)
    keep[1:] = (v[1:] != v[:-1]) | (g[1:] != g[:-1])
    v, g = v[keep], g[keep]
    return v, np.searchsorted(g, np.arange(len(offs)))


def winnow(g: np.ndarray, w: int) -> np.ndarray:
    """Index of the leftmost least value of each window of w of ``g``."""
    n = len(g) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best, idx, width = g, np.arange(len(g)), 1
    while width * 2 <= w:
        m = len(best) - width
        right = best[width : width + m] < best[:m]
        best, idx = np.where(right, best[width : width + m], best[:m]), np.where(right, idx[width : width + m], idx[:m])
        width *= 2
    if width < w:
        a = w - width
        right = best[a : a + n] < best[:n]
        idx = np.where(right, idx[a : a + n], idx[:n])
    return idx[:n]


def lists(values: np.ndarray, offs: np.ndarray) -> pa.Array:
    """An Arrow list array of int64."""
    return pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), pa.array(values.view(np.int64) if values.dtype == np.uint64 else values))
