"""Byte-level BPE encoding and decoding by monoid tree reduction.

A text is halved, its halves are encoded recursively, and the encodings are
joined.  Next to a cut the tokens may differ from those of the whole text, so
a join re-encodes a window around the cut and widens it until the tokens at
its rims provably equal those outside:

*Why it is exact.*  The vocabulary's pattern splits text into pieces, each of
which is merged by itself, so the tokens depend on the pieces alone.  The
pieces come from one scan, and the pattern looks ahead by one character at
most (the white space rule), so two scans that are at a piece border at the
same place go on alike from there.  A left encoding is therefore final up to
the start of its last two pieces (only a piece that touches the cut, or white
space before it, could have come out otherwise), and the scan of the window
started there is in step with that of the whole text.  As soon as the window's
scan has a border where the right encoding has one, all that follows in the
right encoding is final too.  Where none is met the window is doubled, at most
to the end of the right half.

Encodings with this join form a monoid (the empty text is its unit), so any
tree over the parts gives the same tokens.  Decoding maps ids to bytes and
concatenates them up the tree; bytes become characters only at the root.

Scale: no shuffle; each document is encoded where it is read.  The vocabulary
(some 50,000 entries, independent of the data) is read from ``vocabulary`` on
each executor.  Leaves bound the text encoded at once, so a long document
costs in proportion to its length.

Defined results: a null text has null ids, an empty one the empty list, of
null ids the text is null; rows are kept as they are, with repeats, ties and
other columns (a column named like a new one is replaced).  Characters that
aren't valid UTF-8 can't occur in a string column.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .groups import lean
from .session import ship

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPACES = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LEAF, WINDOW = 1 << 13, 64
_CODECS: dict[str, "Codec"] = {}


class Codec:
    """Encoder and decoder for one vocabulary file."""

    def __init__(self, vocabulary: str):
        import regex
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(vocabulary).read_bytes().splitlines())}
        self.leaf = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        # the encoder's engine takes \\s as the White_Space property
        self.pieces = regex.compile(PATTERN.replace(r"[^\s\p{L}\p{N}]", rf"[^{SPACES}\p{{L}}\p{{N}}]").replace(r"\S", f"[^{SPACES}]").replace(r"\s", f"[{SPACES}]"))
        self.bytes = [b""] * (max(ranks.values()) + 1)
        for k, v in ranks.items():
            self.bytes[v] = k
        self.size = np.array([len(x) for x in self.bytes], np.int64)

    def encode(self, text: str, leaf: int = LEAF) -> np.ndarray:
        return self._tree(text, 0, len(text), leaf)

    def _tree(self, text: str, lo: int, hi: int, leaf: int) -> np.ndarray:
        if hi - lo <= leaf:
            return np.array(self.leaf(text[lo:hi]), np.int32)
        mid = (lo + hi) // 2
        return self.join(text, lo, mid, hi, self._tree(text, lo, mid, leaf), self._tree(text, mid, hi, leaf))

    def join(self, text: str, lo: int, mid: int, hi: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Tokens of text[lo:hi] from those of text[lo:mid] and text[mid:hi]."""
        if not len(left) or not len(right):
            return right if not len(left) else left
        start = self._last_pieces(text, lo, mid)
        reach = WINDOW
        while True:
            stop = min(mid + reach, hi)
            found = self._meet(text, start, mid, stop, hi)
            if found is not None:
                break
            reach *= 2
        window, until = found
        head = self._cut(left, len(text[start:mid].encode()), from_end=True)
        tail = self._cut(right, len(text[mid:until].encode()), from_end=False)
        if head is None or tail is None:  # the two pattern engines know different characters: join at the leaf
            return np.array(self.leaf(text[lo:hi]), np.int32)
        inner = [t for x, y in zip(window[:-1], window[1:]) for t in self.leaf(text[x:y])]
        return np.concatenate([head, np.array(inner, np.int32), tail])

    def _last_pieces(self, text: str, lo: int, mid: int) -> int:
        """Start of the second last piece of text[lo:mid], as scanned from lo.
        Borders are found from a place where the scan must have one: between
        white space and the character after it a piece starts at the latest
        one blank earlier, so a window back from the cut is in step if it
        begins with a letter run that follows a line end or two pieces."""
        back = WINDOW
        while True:
            a = max(lo, mid - back)
            if a > lo:
                a = self._sync(text, a, mid)
            if a is not None:
                starts = [m.start() for m in self.pieces.finditer(text, a, mid)]
                if len(starts) >= 3 or a == lo:
                    return starts[-2] if len(starts) >= 2 else a
            if mid - back <= lo:
                return lo
            back *= 2

    @staticmethod
    def _sync(text: str, a: int, mid: int) -> int | None:
        """A place from a on where every scan has a border: before a blank
        that stands between two letters (the blank belongs to the piece on its
        right, and the piece on its left ends there in any scan)."""
        for i in range(max(a, 1), mid - 1):
            if text[i] == " " and text[i - 1].isalpha() and text[i + 1].isalpha():
                return i
        return None

    def _meet(self, text: str, start: int, mid: int, stop: int, hi: int) -> tuple[list[int], int] | None:
        """(borders of the scan from ``start`` up to the place, the place): a
        border of that scan that is also one of the scan from ``mid``."""
        mine = [m.start() for m in self.pieces.finditer(text, start, stop)]
        theirs = {m.start() for m in self.pieces.finditer(text, mid, stop)}
        if stop == hi:
            mine.append(hi)
            theirs.add(hi)
        else:  # the last pieces of a scan may go on beyond the window
            mine = mine[:-2]
            theirs -= set(sorted(theirs)[-2:])
        for k, x in enumerate(mine):
            if x >= mid and x in theirs:
                return mine[: k + 1], x
        return None

    def _cut(self, ids: np.ndarray, size: int, from_end: bool) -> np.ndarray | None:
        """Drop the tokens of the last, or the first, ``size`` bytes."""
        if not size:
            return ids
        n = 16
        while True:
            part = ids[-n:][::-1] if from_end else ids[:n]
            ends = np.cumsum(self.size[part])
            if ends[-1] >= size or n >= len(ids):
                break
            n *= 2
        k = int(np.searchsorted(ends, size))
        if k == len(ends) or ends[k] != size:
            return None
        return ids[: len(ids) - k - 1] if from_end else ids[k + 1 :]

    def decode(self, ids: np.ndarray, leaf: int = LEAF) -> bytes:
        if len(ids) <= leaf:
            return b"".join(map(self.bytes.__getitem__, ids.tolist()))
        mid = len(ids) // 2
        return self.decode(ids[:mid], leaf) + self.decode(ids[mid:], leaf)


def codec(vocabulary: str) -> Codec:
    if vocabulary not in _CODECS:
        _CODECS[vocabulary] = Codec(vocabulary)
    return _CODECS[vocabulary]


def _encode(vocabulary: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary)
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                part = b.slice(lo, 1024)
                ids = [None if t is None else c.encode(t) for t in part.column("text").to_pylist()]
                offs = np.concatenate([[0], np.cumsum([0 if x is None else len(x) for x in ids])]).astype(np.int32)
                flat = np.concatenate([x for x in ids if x is not None] or [np.zeros(0, np.int32)])
                null = pa.array([x is None for x in ids])
                arr = pa.ListArray.from_arrays(pa.array(offs), pa.array(flat, pa.int32()), mask=null)
                count = pa.array([None if x is None else len(x) for x in ids], pa.int32())
                names = [n for n in b.schema.names if n not in ("ids", "n_tokens")]
                yield pa.RecordBatch.from_arrays([part.column(n) for n in names] + [arr, count], [*names, "ids", "n_tokens"])

    return run


def encode(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``docs`` with ids (array<int>) and n_tokens in place of any such columns."""
    ship(docs.sparkSession)
    base = docs.drop("ids", "n_tokens")
    fields = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in base.schema)
    return base.mapInArrow(lean(_encode(vocabulary)), f"{fields}, ids array<int>, n_tokens int")


def _decode(vocabulary: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary)
        for b in batches:
            ids = b.column("ids")
            flat, offs = ids.values.to_numpy(zero_copy_only=False), ids.offsets.to_numpy()
            valid = ids.is_valid().to_numpy(zero_copy_only=False)
            text = [c.decode(flat[i:j]).decode("utf-8", "replace") if ok else None for i, j, ok in zip(offs[:-1], offs[1:], valid)]
            names = [n for n in b.schema.names if n not in ("ids", "n_tokens", "text")]
            yield pa.RecordBatch.from_arrays([b.column(n) for n in names] + [pa.array(text, pa.string())], [*names, "text"])

    return run


def decode(encoded: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``encoded`` with text in place of ids, n_tokens and any old text."""
    ship(encoded.sparkSession)
    base = encoded.drop("n_tokens", "text")
    fields = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in base.schema if f.name != "ids")
    return base.mapInArrow(lean(_decode(vocabulary)), f"{fields}, text string" if fields else "text string")


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, and whether decoding gives its text back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(VOCABULARY)
        for b in _encode(VOCABULARY)(batches):
            ids, text = b.column("ids"), b.column("text").to_pylist()
            flat, offs = ids.values.to_numpy(), ids.offsets.to_numpy()
            same = [None if t is None else c.decode(flat[i:j]) == t.encode() for t, i, j in zip(text, offs[:-1], offs[1:])]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), ids, b.column("n_tokens"), pa.array(same, pa.bool_())], ["doc_id", "ids", "n_tokens", "round_trip"])

    return docs.mapInArrow(lean(run), "doc_id long, ids array<int>, n_tokens int, round_trip boolean")


QUERIES = {"op4_byte_bpe": op4_byte_bpe}
ORACLE: dict[str, str] = {}
