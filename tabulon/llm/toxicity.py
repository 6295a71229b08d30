"""Toxicity by a subsequence string-kernel support vector machine.

The gap-weighted subsequence kernel (Lodhi et al., 2002) of order 3 compares
two strings by their common subsequences, each weighted by the decay to the
power of the length it spans in both; so "idiot" stays close to "id.iot",
"idxiot" and "i d i o t".  A sentence is a bag of units: its words, where three
or more single characters in a row are one unit and a word beyond ``WIDTH``
characters is the windows of that length in it; marks inside a word are gaps.
A sentence scores as its most telling unit, so a long sentence doesn't drown an
insult.

*Landmarks* (Nystroem): a unit u has the features k(u, L) K(L, L)^(-1/2), all
normalised.  Insults are inflected, so landmarks aren't whole words: they are
runs of 3 to 8 characters.  One is telling if more of the labelled toxic
documents hold it in one unit (or in two, three, five: stems are in clean words
by chance, but seldom in several of a document) than chance explains (Fisher's
exact test at a false discovery rate of ``CHANCE``, Benjamini and Hochberg,
1995).  They are taken in order of evidence, each on the words that no earlier
one is in, and made longer while the longer run is in half as many toxic
documents.  Copies of a document count once.  As many landmarks again, or
more, are ordinary units.

*Training*: the examples are the sentences of labelled documents.  They inherit
their document's label, which is wrong for most sentences of a toxic document;
so a sentence of a toxic document is an example only if it has a witness, at
first a unit with a telling run, and then a unit on the machine's toxic side; a
sentence of a clean document counts by its worst unit (multiple instances,
Andrews et al., 2003).  Bent copies of the witnesses (a character inserted)
teach the gaps.  The hinge loss is minimised by averaged subgradient steps.

*Documents*: short runs occur in clean words by chance.  For each landmark, the
hits of a document are held against the rate of clean documents (the tail of a
Poisson distribution); a document is toxic if the evidence of one landmark, or
of all together, is beyond what all but ``MISTAKES`` of the clean ones have.
The sentences of toxic documents that have a hit of such a landmark are
returned.

Scale: training sees at most ``SAMPLE`` labelled documents of each kind, those
with the least hashes.  Scoring is one pass without a shuffle over every word,
once for each distinct unit of a chunk.  The kernel is explicit in the triples
of characters of the landmarks, so the sum over landmarks is folded into one
weight for each triple and a unit costs one look-up for each of its triples.

Defined results: null, empty and wordless texts have no toxic sentence; null
doc_ids and repeated rows are scored like others; null labels are left out;
without toxic and clean labelled documents nothing is flagged; runs with equal
evidence are taken longest first, then in order of their characters.  A
sentence ends at '.', '!', '?' or a line end; a null score can't occur.  Other
columns are ignored.  Units are compared in lower case, by characters.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernel as K
from .session import ship

ORDER, DECAY, LANDMARKS, WIDTH, STEP, SAMPLE, ROUNDS = 3, 0.7, 96, 12, 4, 2000, 3
#: Lengths of the runs that can be telling; share of those taken that may be so by chance.
RUNS, CHANCE = range(3, 9), 0.01
#: A run can tell by so many different units of a document that hold it.
FORMS = (1, 2, 3, 5)
#: Documents that share so much of their units count as copies of each other.
COPY, SIGNATURE = 0.3, 64
#: Share of clean documents that may pass; evidence that any toxic document has.
MISTAKES, EVIDENCE = 0.002, 5.0
#: Training sees so many sentences of clean documents, spread evenly.
SENTENCES = 6000
PIECE, MEMORY = 1 << 21, 1 << 20

_EDGE = np.zeros(256, bool)
_EDGE[list(b".,;:!?'\"()[]%$&#*|")] = True
#: ASCII characters that are gaps within a unit.
_MARK = np.array([not chr(c).isalnum() for c in range(128)])


def _pad(units: list[np.ndarray], width: int = 0) -> np.ndarray:
    out = np.zeros((len(units), max([width, *map(len, units)]) if units else width), np.uint32)
    for row, u in zip(out, units):
        row[: len(u)] = u
    return out


def _points(text: str) -> np.ndarray:
    return np.array([ord(c) for c in text], np.uint32)


def subsequences(s: np.ndarray, t: np.ndarray, each: bool = False) -> np.ndarray:
    """Kernel values of the rows of s (characters; 0 for gaps and at the end)
    with all rows of t, or with ``each`` with the row of t at the same place."""
    n = t.shape[1]
    step = np.arange(n)
    # DECAY ** (gap in t), from the matched place before to the next one
    pull = np.where(step[:, None] < step[None], DECAY ** (step[None] - step[:, None] - 1.0), 0).astype(np.float32)
    shape = (len(s), n) if each else (len(s), len(t), n)
    d = [np.zeros(shape, np.float32) for _ in range(ORDER - 1)]
    total = np.zeros(shape[:-1], np.float32)
    for x in range(int((s != 0).any(0).nonzero()[0].max(initial=-1)) + 1):
        c = s[:, x]
        live = c != 0
        hit = ((t == c[:, None]) if each else (t[None] == c[:, None, None])) & live.reshape(-1, *[1] * (len(shape) - 1))
        new = [np.float32(DECAY**2) * hit]
        for i in range(1, ORDER):
            new.append(np.float32(DECAY**2) * (d[i - 1] @ pull) * hit)
        for i in range(ORDER - 1):
            d[i] = d[i] * np.float32(DECAY) + new[i]
        total += new[-1].sum(-1)
    return total


def _norm(units: np.ndarray) -> np.ndarray:
    return np.sqrt(subsequences(units, units, True)) + 1e-9


def _triples(n: int):
    """Places i < j < k below n, and the decay of what they span."""
    if n not in _TRIPLES:
        i, j, k = np.array(list(itertools.combinations(range(n), 3)), np.int64).reshape(-1, 3).T
        _TRIPLES[n] = i, j, k, (DECAY ** (k - i + 1.0)).astype(np.float32)
    return _TRIPLES[n]


_TRIPLES: dict[int, tuple] = {}


class Machine:
    """Landmarks (the first ``telling`` ones are toxic), weights and bars."""

    def __init__(self, landmarks: list[np.ndarray], telling: int):
        self.landmarks, self.telling = _pad(landmarks), telling
        self.norm = _norm(self.landmarks)
        self.floor = float(np.median(self.norm[:telling]))
        value, vector = np.linalg.eigh((subsequences(self.landmarks, self.landmarks) / (self.norm[:, None] * self.norm)).astype(np.float64))
        keep = value > 0.03
        self.whiten = vector[:, keep] / np.sqrt(value[keep])
        self.weight, self.bias = np.zeros(keep.sum()), 0.0
        self.bar = np.zeros(telling)
        self.rate, self.least, self.together = np.zeros(telling), np.ones(telling), 1.0

    def scale(self, units: np.ndarray) -> np.ndarray:
        """Norms of the units.  Short ones count as the usual telling one, lest
        they be like all that hold them; those with gaps don't."""
        norm, letters = _norm(units), (units != 0).sum(1)
        width = units.shape[1] - (units[:, ::-1] != 0).argmax(1)
        return np.where((letters < width) & (letters >= 5), norm, np.maximum(norm, self.floor))

    def similar(self, units: np.ndarray, of: int | None = None) -> np.ndarray:
        """Normalised kernel values with the landmarks (the first ``of``)."""
        marks = self.landmarks[:of]
        out = np.zeros((len(units), len(marks)), np.float32)
        for lo in range(0, len(units), 256):
            u = units[lo : lo + 256]
            out[lo : lo + 256] = subsequences(u, marks) / (self.norm[:of] * self.scale(u)[:, None])
        return out

    def nearest(self, units: np.ndarray) -> np.ndarray:
        """The telling landmark that each unit is most like."""
        return self.similar(units, self.telling).argmax(1) if len(units) else np.zeros(0, np.int64)

    def features(self, units: np.ndarray) -> np.ndarray:
        return self.similar(units) @ self.whiten

    def fold(self) -> "Machine":
        """Weights of the landmarks as weights of triples of characters: a
        number for each pair that begins a triple, and a weight for each such
        number and third character."""
        share = (self.whiten @ self.weight) / self.norm
        self.letters = np.unique(self.landmarks[self.landmarks != 0])
        self.a = len(self.letters) + 1
        self.number = np.zeros(0x110000, np.int32)
        self.number[self.letters] = np.arange(1, self.a)
        parts = []
        for row, w in zip(self.landmarks, share):
            c = np.searchsorted(self.letters, row[row != 0]) + 1
            i, j, k, decay = _triples(len(c))
            parts.append((c[i] * self.a + c[j], c[k], w * decay))
        pair, last, w = (np.concatenate(x) for x in zip(*parts))
        known, row = np.unique(pair, return_inverse=True)
        self.pair = np.zeros(self.a**2, np.int32)
        self.pair[known] = np.arange(1, len(known) + 1) * self.a
        table = np.zeros((len(known) + 1) * self.a)
        np.add.at(table, (row + 1) * self.a + last, w)
        self.table = table.astype(np.float32)
        return self

    def letter(self, points: np.ndarray) -> np.ndarray:
        """Numbers of characters; 0 for those that no landmark has."""
        return self.number[points]

    def score(self, points: np.ndarray, start: np.ndarray, size: np.ndarray, least: float = -np.inf) -> np.ndarray:
        """Decision values of the units points[start : start + size]; of those
        below ``least``, only that they are below."""
        out, letters = np.zeros(len(start)), self.letter(points)
        for n in np.unique(size):
            if n < ORDER:
                continue
            i, j, k, decay = _triples(int(n))
            rows = np.flatnonzero(size == n)
            for lo in range(0, len(rows), 2048):
                part = rows[lo : lo + 2048]
                where = start[part] + np.arange(n)[:, None]
                c = letters[where]
                total = np.zeros(len(part), np.float32)
                for x in range(n - 2):  # triples by their first two places
                    for y in range(x + 1, n - 1):
                        row = self.pair[c[x] * self.a + c[y]]
                        live = np.flatnonzero(row)
                        if len(live):
                            z = np.arange(y + 1, n)
                            w = self.table[row[live] + c[y + 1 :, live]]
                            total[live] += (DECAY ** (z - x + 1.0)).astype(np.float32) @ w
                # the norm itself is needed only where its least value leaves a chance
                size_ = np.where((points[where] == 0).any(0), 1e-9, max(self.floor, float(np.sqrt((decay.astype(np.float64) ** 2).sum()))))
                high = np.flatnonzero(total / size_ >= least - self.bias) if least > self.bias else np.arange(len(part))
                out[part] = total / size_
                out[part[high]] = total[high] / self.scale(points[where[:, high]].T)
        return out + self.bias

    def shares(self, hits: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of documents with ``hits`` (documents x telling landmarks) among
        ``size`` units: the evidence of each landmark as a share of what it
        needs; and that of the strongest, or of all together if it is more."""
        share = np.zeros((len(hits), self.telling))
        for d, f in zip(*np.nonzero(hits)):
            share[d, f] = _tail(int(hits[d, f]), float(self.rate[f] * size[d])) / self.least[f]
        return share, np.maximum(share.max(1, initial=0), share.sum(1) / self.together)


def _tail(n: int, mean: float) -> float:
    """-log P(X >= n) of a Poisson distribution."""
    if n <= mean:
        return 0.0
    term = log = -mean + n * math.log(mean) - math.lgamma(n + 1)
    total, k = 1.0, n
    while term - log > -40:
        k += 1
        term += math.log(mean / k)
        total += math.exp(term - log)
    return -(log + math.log(total))


def fit_svm(x: np.ndarray, y: np.ndarray, kind: np.ndarray, steps: int = 2000, c: float = 1e-4) -> tuple[np.ndarray, float]:
    """Linear SVM by averaged subgradient steps, with balanced classes, and
    balanced kinds of positive examples (``kind`` of the rows with y > 0)."""
    r = np.random.default_rng(5)
    w, mean, b, mean_b, n = np.zeros(x.shape[1]), np.zeros(x.shape[1]), 0.0, 0.0, 0
    pos, neg = np.flatnonzero(y > 0), np.flatnonzero(y <= 0)
    share = 1 / np.bincount(kind)[kind]
    share /= share.sum()
    draws = r.choice(pos, (steps, 128), p=share)
    for step in range(1, steps + 1):
        pick = np.concatenate([draws[step - 1], r.choice(neg, 128)])
        sign = np.where(y[pick] > 0, 1.0, -1.0)
        bad = sign * (x[pick] @ w + b) < 1
        rate = 1 / (1 + 0.01 * step)
        w = w - rate * (c * w - (sign[bad, None] * x[pick][bad]).sum(0) / len(pick))
        b += rate * sign[bad].sum() / len(pick)
        if step > steps // 2:
            mean, mean_b, n = mean + w, mean_b + b, n + 1
    return mean / n, mean_b / n


# ---- units of texts -----------------------------------------------------------


def _characters(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes, and the character that each byte is in."""
    lead = (b & 0xC0) != 0x80
    at = np.flatnonzero(lead)
    point = b[at].astype(np.uint32)
    for k, (low, mask) in enumerate(((0xC0, 0x1F), (0xE0, 0x0F), (0xF0, 0x07))):
        rows = np.flatnonzero(b[at] >= low)
        if not len(rows):
            break
        point[rows] = b[at[rows]] & mask
        for step in range(1, k + 2):
            point[rows] = (point[rows] << np.uint32(6)) | (b[np.minimum(at[rows] + step, len(b) - 1)] & np.uint8(0x3F))
    return point, np.cumsum(lead) - 1


class _Units:
    """The units of a chunk of texts: code points; start, size, hash, sentence
    and document (row of the column) of each unit."""

    def __init__(self, points, start, size, h, sentence, doc):
        self.points, self.start, self.size, self.h, self.sentence, self.doc = points, start, size, h, sentence, doc


def _units(column: pa.Array) -> Iterator[_Units]:
    text = K.strings(column, lower=True)
    offsets, data = K.raw(text)
    for i, h, first, last, at in K.tokens(text, K.SPACE, PIECE):
        if not len(h):
            continue
        n = len(at) - 1
        b = data[offsets[i] : offsets[i + n]]
        begin = np.repeat(offsets[i : i + n] - offsets[i], np.diff(at))
        start, end = begin + first, begin + last
        doc = np.repeat(np.arange(n), np.diff(at))
        # a sentence ends with a word that ends in . ! ? or before a line end
        stop = np.isin(b[end - 1], list(b".!?"))
        lines = np.concatenate([[0], np.cumsum(b == 10)])
        stop[:-1] |= lines[start[1:]] > lines[end[:-1]]
        before = np.concatenate([[0], np.cumsum(stop)[:-1]])
        sentence = before - np.repeat(before[np.minimum(at[:-1], len(before) - 1)], np.diff(at))
        for _ in range(3):  # marks around a word aren't part of it
            start = start + (_EDGE[b[start]] & (end - start > 1))
            end = end - (_EDGE[b[end - 1]] & (end - start > 1))
        points, char = _characters(b)
        start, size = char[start], char[end - 1] + 1 - char[start]
        # runs of words of one character each are one unit
        edge = np.flatnonzero(np.r_[True, ((size == 1)[1:] != (size == 1)[:-1]) | (doc[1:] != doc[:-1]), True])
        runs = np.flatnonzero((size[edge[:-1]] == 1) & (np.diff(edge) >= 3))
        if len(runs):
            lo, hi = edge[runs], edge[runs + 1]
            many = hi - lo
            took = np.repeat(lo - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
            new = len(points) + np.concatenate([[0], np.cumsum(many)[:-1]])
            points = np.concatenate([points, points[start[took]]])
            start, size, sentence, doc = np.r_[start, new], np.r_[size, many], np.r_[sentence, sentence[lo]], np.r_[doc, doc[lo]]
        # long words are windows, the last one at their end
        pieces = 1 + np.maximum(0, -(-(size - WIDTH) // STEP))
        back = np.repeat(np.arange(len(size)), pieces)
        nth = np.arange(len(back)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        shift = np.minimum(nth * STEP, np.maximum(0, size[back] - WIDTH))
        start, size = start[back] + shift, np.minimum(size[back], WIDTH)
        points[(points < 128) & _MARK[np.minimum(points, 127)]] = 0
        up, down = K.powers(len(points) + 1)
        sums = np.zeros(len(points) + 1, np.uint64)
        np.cumsum((points.astype(np.uint64) + np.uint64(1)) * up[: len(points)], out=sums[1:])
        yield _Units(points, start, size, K.mix((sums[start + size] - sums[start]) * down[start]), sentence[back], doc[back] + i)


# ---- training -----------------------------------------------------------------


def _groups(doc: np.ndarray, unit: np.ndarray, n: int) -> np.ndarray:
    """A number for each document, the same for copies of each other, by
    MinHash signatures; ``doc`` ascends, every document has a unit."""
    r = np.random.default_rng(7)
    salt = r.integers(1, 1 << 63, SIGNATURE, np.uint64) | np.uint64(1)
    first = np.searchsorted(doc, np.arange(n))
    h = K.mix(unit.astype(np.uint64) + np.uint64(1))
    sign = np.stack([np.minimum.reduceat(K.mix(h * x), first) for x in salt], 1)
    group = np.arange(n)
    for k in range(1, n):
        like = np.flatnonzero((sign[:k] == sign[k]).mean(1) >= COPY)
        if len(like):
            group[np.isin(group, group[like])] = k
    return np.unique(group, return_inverse=True)[1]


def _by_chance(n1: np.ndarray, n0: np.ndarray, toxic: int, clean: int) -> np.ndarray:
    """Log of Fisher's exact test: how likely a run of n1 + n0 documents is in
    n1 or more of the toxic ones."""
    log = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, toxic + clean + 1)))])
    kinds, back = np.unique(np.stack([n1, n0]).astype(int), axis=1, return_inverse=True)
    out = np.zeros(kinds.shape[1])
    for k, (a, b) in enumerate(kinds.T):
        n = a + b
        x = np.arange(max(a, n - clean), min(n, toxic) + 1)
        each = log[toxic] - log[x] - log[toxic - x] + log[clean] - log[n - x] - log[clean - n + x] - log[toxic + clean] + log[n] + log[toxic + clean - n]
        top = each.max()
        out[k] = min(0.0, top + math.log(np.exp(each - top).sum()))
    return out[back.ravel()]


class _Sample:
    """Distinct units of the labelled documents, and where they are."""

    def __init__(self, texts: list[str], toxic: np.ndarray):
        points, start, size, key, cells, sentences = [], [], [], [], [], []
        at = 0
        for u in _units(pa.array(texts, pa.large_string())):
            _, one = np.unique(u.h, return_index=True)
            width = u.size[one]
            took = np.repeat(u.start[one] - (np.cumsum(width) - width), width) + np.arange(width.sum())
            points.append(u.points[took])
            start.append(at + np.cumsum(width) - width)
            at += int(width.sum())
            size.append(width)
            key.append(u.h[one])
            # a sentence once for each of its units
            cells.append(np.unique(np.rec.fromarrays([u.doc, u.sentence, u.h], names="d,s,h")))
        key, one, _ = np.unique(np.concatenate(key), return_index=True, return_inverse=True) if key else (np.zeros(0, np.uint64), np.zeros(0, np.int64), None)
        self.points = np.concatenate(points) if points else np.zeros(0, np.uint32)
        self.start, self.size = (np.concatenate(x)[one] if x else np.zeros(0, np.int64) for x in (start, size))
        cell = np.concatenate(cells) if cells else np.zeros(0, [("d", "i8"), ("s", "i8"), ("h", "u8")])
        unit = np.searchsorted(key, cell["h"])
        docs, doc = np.unique(cell["d"], return_inverse=True)
        self.toxic = toxic[docs]
        order = np.lexsort((unit, cell["s"], doc))
        self.cell_doc, self.cell_unit, s = doc[order], unit[order], cell["s"][order]
        new = np.r_[True, (self.cell_doc[1:] != self.cell_doc[:-1]) | (s[1:] != s[:-1])] if len(s) else np.zeros(0, bool)
        self.sentence = np.cumsum(new) - 1
        pair = np.unique(self.cell_doc * len(key) + self.cell_unit) if len(key) else np.zeros(0, np.int64)
        self.doc, self.unit = (pair // len(key), pair % len(key)) if len(key) else (pair, pair)
        self.sizes = np.bincount(self.doc, minlength=len(docs))

    def matrix(self, units: np.ndarray) -> np.ndarray:
        return _pad([self.points[a : a + n] for a, n in zip(self.start[units].tolist(), self.size[units].tolist())], WIDTH)


def _telling(s: _Sample) -> tuple[list[np.ndarray], np.ndarray]:
    """The telling runs, and whether each unit has one."""
    group = _groups(s.doc, s.unit, len(s.toxic))
    # a group of copies is toxic if most of them are
    toxic = np.bincount(group, s.toxic) * 2 > np.bincount(group)
    t, c = int(toxic.sum()), int((~toxic).sum())
    covered = np.zeros(len(s.start), bool)
    if not t or not c:
        return [], covered
    pair = np.unique(s.unit * len(toxic) + group[s.doc])
    unit, where = pair // len(toxic), pair % len(toxic)
    o = np.searchsorted(unit, np.arange(len(s.start) + 1))
    n1 = np.bincount(unit[toxic[where]], minlength=len(s.start))
    n0 = np.diff(o) - n1
    code, gaps = K.mix(s.points.astype(np.uint64)), np.concatenate([[0], np.cumsum(s.points == 0)])
    fewest = np.flatnonzero(np.cumsum(np.log(np.arange(t, 0, -1) / np.arange(t + c, c, -1))) < math.log(CHANCE / 10))
    if not len(fewest):
        return [], covered
    fewest = int(fewest[0]) + 1
    tables, cands = [], []
    for n in RUNS:
        rows = np.flatnonzero(s.size >= n)
        many = s.size[rows] - n + 1
        back = np.repeat(rows, many)
        at = np.arange(len(back)) - np.repeat(np.cumsum(many) - many, many) + s.start[back]
        whole = gaps[at + n] == gaps[at]
        back, at = back[whole], at[whole]
        roll = K.rolling(code, n)
        key = roll[at]
        order = np.argsort(key, kind="stable")
        key, back, at = key[order], back[order], at[order]
        edge = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        if not len(edge):
            continue
        # a screen by the sums over words; the test itself counts documents, and
        # what is in too few of them to pass doesn't count as tested
        a, b = (np.add.reduceat(x[back], edge) / z for x, z in ((n1, t), (n0, c)))
        few = np.flatnonzero((a * t >= fewest) & (a > 1.5 * b))
        stop = np.append(edge[1:], len(key))
        for k in few:
            cands.append((n, edge[k], stop[k], at[edge[k]], len(tables)))
        tables.append(back)

    def count(words: np.ndarray) -> np.ndarray:
        """Toxic and clean documents with one, two and so on of the words."""
        n = np.bincount(np.concatenate([where[o[w] : o[w + 1]] for w in words]), minlength=len(toxic)) if len(words) else np.zeros(len(toxic), int)
        return np.array([((n >= m) & x).sum() for x in (toxic, ~toxic) for m in FORMS]).reshape(2, -1)

    words = [np.unique(tables[x][i:j]) for _, i, j, _, x in cands]
    if not cands:
        return [], covered
    got = np.array([count(w) for w in words])
    chance = _by_chance(got[:, 0].ravel(), got[:, 1].ravel(), t, c).reshape(len(cands), -1)
    # runs that are in the same units are one test
    tests = len({w.tobytes() for w in words}) * len(FORMS)
    text = ["".join(map(chr, s.points[p : p + n])) for n, _, _, p, _ in cands]
    found: list[tuple[float, np.ndarray, np.ndarray]] = []
    sure = np.flatnonzero(chance.min(1) <= math.log(CHANCE))
    order = sorted(sure.tolist(), key=lambda k: (chance[k].min(), -len(text[k]), text[k]))
    for k in order:
        if not (~covered[words[k]]).any():
            continue
        # a shorter run of nearly the same evidence that more toxic documents
        # have, and no more clean ones
        seen = lambda x: got[x, :, chance[x].argmin()]
        within = [x for x in order if text[x] in text[k] and chance[x].min() <= 0.75 * chance[k].min() and seen(x)[1] <= seen(k)[1] and len(text[x]) > max(4, len(text[k]) - 3)] + [k]
        k = max(within, key=lambda x: (seen(x)[0], len(text[x]), text[x]))
        left = words[k][~covered[words[k]]]
        hit = got[k] if len(left) == len(words[k]) else count(left)
        each = _by_chance(hit[0], hit[1], t, c)
        m = int(each.argmin())
        if each[m] > math.log(CHANCE):
            continue
        covered[left] = True
        longer = [x for x in order if text[k] in text[x] and got[x, 0, m] >= 0.5 * hit[0, m]]
        best = max(longer, key=lambda x: (len(text[x]), got[x, 0, m], text[x]), default=k)
        found.append((float(each[m]), _points(text[best if len(text[best]) > len(text[k]) else k]), left))
    found.sort(key=lambda x: x[0])
    passed = [j for j, (p, _, _) in enumerate(found, 1) if p <= math.log(CHANCE * j / tests)]
    found = found[: passed[-1] if passed else 0]
    covered[:] = False
    for _, _, left in found:
        covered[left] = True
    return [r for _, r, _ in found], covered


def _bent(runs: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """Runs with a character inserted, doubled or a gap at each inner place,
    and the numbers of the runs."""
    out, kind = [], []
    for f, u in enumerate(runs):
        many = [np.insert(u, k, x) for k in range(1, len(u)) for x in (0, ord("x"), u[k - 1])]
        dots = np.zeros(2 * len(u) - 1, np.uint32)
        dots[::2] = u
        many += [u, dots[:WIDTH]]
        out += many
        kind += [f] * len(many)
    return out, np.array(kind)


def _learn(texts: list[str], labels: list[int]) -> Machine | None:
    """A machine from documents and their labels."""
    s = _Sample(texts, np.array(labels, bool))
    runs, has = _telling(s)
    if not runs:
        return None
    clean_unit = np.bincount(s.unit[~s.toxic[s.doc]], minlength=len(s.start))
    gaps = np.concatenate([[0], np.cumsum(s.points == 0)])
    plain = np.flatnonzero((clean_unit > 0) & ~has & (s.size >= ORDER) & (gaps[s.start + s.size] == gaps[s.start]))
    if not len(plain):
        return None
    # ordinary landmarks: the units nearest to the telling runs, then common ones
    first = Machine(runs, len(runs))
    common = plain[np.lexsort((plain, -clean_unit[plain]))]
    rest = max(LANDMARKS - len(runs), len(runs))
    among = common[: 40 * rest]
    close = first.similar(s.matrix(among)).max(1)
    near = among[np.lexsort((among, -close))][: 2 * rest // 3]
    more = common[~np.isin(common, near)][: rest - len(near)]
    machine = Machine(runs + [s.points[s.start[k] : s.start[k] + s.size[k]] for k in np.concatenate([near, more])], len(runs))

    bent, kind = _bent(runs)
    extra = machine.features(_pad(bent, WIDTH))
    worst = np.full(len(s.start), -9.0)
    worst[near] = close[: len(near)]
    value = np.where(has, 1.0, worst)
    cell_toxic = s.toxic[s.cell_doc]
    for round_ in range(ROUNDS):
        # the sentence's most telling unit; sentences of clean documents without a telling run
        order = np.lexsort((s.cell_unit, -value[s.cell_unit], s.sentence))
        top = order[np.r_[True, s.sentence[order][1:] != s.sentence[order][:-1]]]
        pos = s.cell_unit[top[cell_toxic[top] & (value[s.cell_unit[top]] > 0)]]
        neg = s.cell_unit[top[~cell_toxic[top] & ~has[s.cell_unit[top]] & (s.size[s.cell_unit[top]] >= ORDER)]]
        if not len(neg):
            neg = plain
        every = neg[:: max(1, len(neg) // SENTENCES)]
        hard = plain[np.argsort(-value[plain], kind="stable")[: SENTENCES // 4]]
        used, at = np.unique(np.concatenate([pos, every, hard]), return_inverse=True)
        x = machine.features(s.matrix(used))[at]
        x = np.concatenate([x, extra])
        y = np.r_[np.ones(len(pos)), -np.ones(len(every) + len(hard)), np.ones(len(bent))]
        machine.weight, machine.bias = fit_svm(x, y, np.r_[machine.nearest(s.matrix(pos)), kind])
        machine.fold()
        value = machine.score(s.points, s.start, s.size)
    _calibrate(machine, s, value, has, machine.features(_pad(bent, WIDTH)) @ machine.weight + machine.bias, kind)
    return machine


def _calibrate(machine: Machine, s: _Sample, value: np.ndarray, has: np.ndarray, bent: np.ndarray, kind: np.ndarray) -> None:
    """Bars of units, rates of clean documents and the evidence that a toxic
    one needs.  Of the bars between those that nearly all bent copies and
    hardly any unit of a landmark pass, the one by which most toxic documents
    are found is taken."""
    n = machine.telling
    floor = np.array([np.quantile(bent[kind == f], 0.1) for f in range(n)])
    high = np.flatnonzero(value >= floor.min() - 1)
    near = np.full(len(value), -1)
    near[high] = machine.nearest(s.matrix(high))
    clean, words = ~s.toxic, s.sizes[~s.toxic].sum()
    hits = np.zeros((len(s.toxic), n), np.int64)
    for f in range(n):
        rows = np.flatnonzero(near[s.unit] == f)
        level = value[s.unit[rows]]
        best = (-1, 0)
        whole = value[(near == f) & has]
        bars = [floor[f], *([floor[f] / 2 + whole.max() / 2, *np.quantile(whole, (0.05, 0.1, 0.25, 0.5, 0.75), method="lower") - 1e-4] if len(whole) else [])]
        for bar in sorted(bars, reverse=True):
            x = np.bincount(s.doc[rows[level >= bar]], minlength=len(s.toxic))
            rate = (x[clean].sum() + 0.5) / max(1, words)
            got = np.array([_tail(int(x[d]), float(rate * s.sizes[d])) if x[d] else 0.0 for d in range(len(x))])
            least = max(EVIDENCE, float(np.quantile(got[clean], 1 - MISTAKES / 2, method="higher")) + 1e-6)
            found = int((got[~clean] >= least).sum()), -int(x[clean].sum())
            if found >= best:  # of equal ones the lowest, which forgives most
                best = found
                hits[:, f], machine.bar[f], machine.rate[f], machine.least[f] = x, bar, rate, least
    machine.together = 1e9
    _, share = machine.shares(hits[clean], s.sizes[clean])
    machine.least *= max(1.0, float(np.quantile(share, 1 - MISTAKES, method="higher")) + 1e-6)
    machine.together = 1.0
    _, share = machine.shares(hits[clean], s.sizes[clean])
    machine.together = max(1.0, float(np.quantile(share, 1 - MISTAKES, method="higher")) + 1e-6)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine | None:
    """A machine for ``toxic`` in ``labels``; at most ``sample`` documents of
    each kind are used.  None if one kind is missing."""
    ship(docs.sparkSession)
    y = labels.where("doc_id is not null and toxic is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("y"))
    kinds = [y.where(F.col("y") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for k in (0, 1)]
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(kinds[0].union(kinds[1])), "doc_id").select("doc_id", "y", "text")  # at most 2 * ``sample`` rows
    rows = sorted((r["doc_id"], r["y"], r["text"] or "") for r in known.toLocalIterator())
    return _learn([r[2] for r in rows], [r[1] for r in rows]) if rows else None


# ---- scoring ------------------------------------------------------------------


class _Memory:
    """Score and landmark (-1: no hit) of the units met so far, by their hash."""

    def __init__(self, machine: Machine):
        self.machine, self.least = machine, float(machine.bar.min())
        self.h, self.value, self.near = np.zeros(0, np.uint64), np.zeros(0), np.zeros(0, np.int64)

    def judge(self, u: _Units, one: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For the units ``one``, whose hashes h ascend."""
        at = np.minimum(np.searchsorted(self.h, h), max(len(self.h) - 1, 0))
        known = self.h[at] == h if len(self.h) else np.zeros(len(h), bool)
        value, near = np.zeros(len(h)), np.full(len(h), -1)
        value[known], near[known] = self.value[at[known]], self.near[at[known]]
        new = np.flatnonzero(~known)
        k = one[new]
        got, kind = self.machine.score(u.points, u.start[k], u.size[k], self.least), np.full(len(k), -1)
        high = np.flatnonzero(got >= self.least)
        if len(high):
            place = np.arange(WIDTH)
            units = np.where(place < u.size[k[high], None], u.points[np.minimum(u.start[k[high], None] + place, len(u.points) - 1)], 0)
            kind[high] = self.machine.nearest(units)
            kind[high[got[high] < self.machine.bar[kind[high]]]] = -1
        value[new], near[new] = got, kind
        if len(self.h) + len(new) > MEMORY:  # begin again
            self.h, self.value, self.near = h, value, near
        else:
            every = np.concatenate([self.h, h[new]])
            order = np.argsort(every, kind="stable")
            self.h, self.value, self.near = every[order], np.concatenate([self.value, got])[order], np.concatenate([self.near, kind])[order]
        return value, near


def _flag(machine: Machine):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = _Memory(machine)
        for batch in batches:
            for u in _units(batch.column("text")):
                h, one, back = np.unique(u.h, return_index=True, return_inverse=True)
                value, near = memory.judge(u, one, h)
                hit = np.flatnonzero(near[back] >= 0)
                if not len(hit):
                    continue
                docs, row = np.unique(u.doc[hit], return_inverse=True)
                # different units by document, as in training
                pair = np.unique(row.astype(np.int64) * len(one) + back[hit])
                hits = np.zeros((len(docs), machine.telling), np.int64)
                np.add.at(hits, (pair // len(one), near[pair % len(one)]), 1)
                some = np.zeros(batch.num_rows, bool)
                some[docs] = True
                some = some[u.doc]
                size = np.bincount(np.unique(u.doc[some].astype(np.int64) * len(one) + back[some]) // len(one), minlength=int(docs[-1]) + 1)[docs]
                share, most = machine.shares(hits, size)
                # hits of landmarks that tell by themselves; of all, where only all together tell
                alone = share >= 1
                alone[(most >= 1) & ~alone.any(1)] = True
                hit = hit[alone[row, near[back[hit]]]]
                if not len(hit):
                    continue
                order = hit[np.lexsort((-value[back[hit]], u.sentence[hit], u.doc[hit]))]
                d, s = u.doc[order], u.sentence[order]
                order = order[np.r_[True, (d[1:] != d[:-1]) | (s[1:] != s[:-1])]]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(u.doc[order])), pa.array(u.sentence[order].astype(np.int64)), pa.array(value[back[order]].astype(np.float64))], ["doc_id", "sentence", "score"])

    return run


def toxic_sentences(docs: DataFrame, machine: Machine | None) -> DataFrame:
    """(doc_id, sentence, score) of every toxic sentence; sentences count from
    0 in their document."""
    if machine is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, sentence long, score double")
    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_flag(machine), "doc_id long, sentence long, score double")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxic sentences of ``documents``, learned from ``labels``."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return toxic_sentences(docs, train(docs, labels))


QUERIES = {"op3_toxicity": op3_toxicity}
ORACLE: dict[str, str] = {}
