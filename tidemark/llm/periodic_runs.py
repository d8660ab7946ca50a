"""Periodic runs of words by internal pattern matching on dyadic blocks.

A run is a stretch with smallest period q and at least max(6, 4q) words that no
neighbouring word extends. Found without trying all periods:

1. A task lays the words of many documents of like length one after another, a
   separator of its own behind each, and ranks all blocks of 1, 2, 4, ... words by
   prefix doubling. Suffixes sorted by their longest ranked block make the suffix
   array: equal blocks of any of these lengths are a range of it.
2. A wavelet matrix over the suffix array answers range successor: the least
   position at or after x within a range.
3. Let 2^k <= q < 2^(k+1). Every run holds a block of 2^k words at a multiple of
   2^k that recurs q words on. So each such block at i is asked for its occurrences
   that start in the neighbouring window [i + 2^k, i + 2^(k+1)). There are none, one
   or two, each of which gives a candidate period, or they form an arithmetic
   progression. Its difference d is then the block's own period, and of the
   progression only one distance can be a run's period: the one that brings the end
   of the d-periodic stretch at i onto that of the stretch in the window.
4. A candidate is extended both ways by comparing ranked blocks of falling length,
   and kept if it is long enough. Equal stretches keep their least period.

Work is n log n for n words, memory some 8 log2(n) bytes for each word of a chunk; a
chunk holds `CHUNK` words or one longer document, so it is bounded by the longest
text. Nothing is shuffled: each document is judged in the task that reads it.

Null texts count as empty: no words, no runs. Rows with a null id are judged, too,
and are never rewritten by `planted`. Repeated rows are judged each. An empty table
gives an empty one; columns other than id and text, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import raw_texts

#: A run has at least this many words and this many periods.
LEAST, TIMES = 6, 4
#: Words that a task ranks at once, unless one document has more.
CHUNK = 1 << 16

SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


class _Blocks:
    """Ranks of all blocks of 2^k symbols, k <= top; the first and last symbols occur nowhere else."""

    def __init__(self, symbols: np.ndarray, top: int):
        n = len(symbols)
        order = np.argsort(symbols, kind="stable")
        self.ranks = [self._ranked(order, symbols[order])]
        for k in range(top):
            last, step = self.ranks[-1], 1 << k
            if int(last.max()) == n - 1 or step >= n:
                break
            key = last.astype(np.int64) * (n + 1)
            key[:-step] += last[step:] + 1
            order = np.argsort(key, kind="stable")
            self.ranks.append(self._ranked(order, key[order]))
        #: Positions by the rank of the longest block, then by place.
        self.suffixes = np.argsort(self.ranks[-1], kind="stable").astype(np.int32)

    @staticmethod
    def _ranked(order: np.ndarray, values: np.ndarray) -> np.ndarray:
        rank = np.empty(len(order), np.int32)
        rank[order] = np.r_[0, np.cumsum(values[1:] != values[:-1])]
        return rank

    @property
    def top(self) -> int:
        return len(self.ranks) - 1

    def spans(self, k: int) -> np.ndarray:
        """Where each rank of blocks of 2^k symbols begins in the suffix array, and the end."""
        return np.r_[0, np.cumsum(np.bincount(self.ranks[k]))].astype(np.int64)

    def _common(self, a: np.ndarray, b: np.ndarray, back: bool) -> np.ndarray:
        """How many symbols agree from ``a`` and ``b`` on, or before them; ``a < b``."""
        got = np.zeros(len(a), np.int64)
        live = np.arange(len(a))
        for k in range(self.top, -1, -1):
            rank, step, rows = self.ranks[k], 1 << k, live
            while len(rows):
                x, y = (a[rows] - got[rows] - step, b[rows] - got[rows] - step) if back else (a[rows] + got[rows], b[rows] + got[rows])
                same = rank[np.maximum(x, 0)] == rank[np.maximum(y, 0)]
                rows = rows[same & (x >= 0)]
                got[rows] += step
                if k < self.top:
                    break
        return got

    def ahead(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self._common(a, b, back=False)

    def behind(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self._common(a, b, back=True)


class _Wavelet:
    """A wavelet matrix over the values of an array: counts below and k-th least values of ranges, many at once."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, int(len(values) - 1).bit_length())
        self.zeros = []
        for b in range(self.bits - 1, -1, -1):
            one = (values >> b & 1).astype(bool)
            self.zeros.append(np.r_[0, np.cumsum(~one)].astype(np.int32))
            values = np.concatenate([values[~one], values[one]])

    def below(self, lo: np.ndarray, hi: np.ndarray, x: np.ndarray) -> np.ndarray:
        """How many values of [lo, hi) are below x."""
        count = np.zeros(len(lo), np.int64)
        for b, zero in zip(range(self.bits - 1, -1, -1), self.zeros, strict=True):
            l0, h0, one = zero[lo], zero[hi], (x >> b & 1).astype(bool)
            count += np.where(one, h0 - l0, 0)
            lo, hi = np.where(one, zero[-1] + lo - l0, l0), np.where(one, zero[-1] + hi - h0, h0)
        return count

    def kth(self, lo: np.ndarray, hi: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The k-th least value of [lo, hi), counted from 0."""
        value = np.zeros(len(lo), np.int64)
        for b, zero in zip(range(self.bits - 1, -1, -1), self.zeros, strict=True):
            l0, h0 = zero[lo], zero[hi]
            one = k >= h0 - l0
            k = np.where(one, k - (h0 - l0), k)
            value += one.astype(np.int64) << b
            lo, hi = np.where(one, zero[-1] + lo - l0, l0), np.where(one, zero[-1] + hi - h0, h0)
        return value


def _successors(wavelet: _Wavelet, lo: np.ndarray, hi: np.ndarray, x: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
    """The first three values at or after ``x`` and before ``end`` of each range; -1 where there are fewer."""
    rank, out = wavelet.below(lo, hi, x), []
    open_rows = np.arange(len(lo))
    for step in range(3):
        open_rows = open_rows[rank[open_rows] + step < (hi - lo)[open_rows]]
        value = wavelet.kth(lo[open_rows], hi[open_rows], rank[open_rows] + step)
        inside = value < end[open_rows]
        open_rows, found = open_rows[inside], np.full(len(lo), -1, np.int64)
        found[open_rows] = value[inside]
        out.append(found)
    return out


def runs(symbols: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(start, end, period)`` of all runs in documents laid out in ``symbols``, by start, end.

    Document j is symbols[first[j] : first[j] + sizes[j]]; the symbols around and
    between documents occur once each.
    """
    none = np.zeros(0, np.int64)
    longest = int(sizes.max(initial=0))
    if longest < LEAST:
        return none, none, none
    blocks = _Blocks(symbols, max(0, (longest // TIMES).bit_length() - 1))
    ends = first + sizes
    at, lo, hi, length = [], [], [], []
    for k in range(blocks.top + 1):
        step = 1 << k
        i = np.arange(0, len(symbols), step)
        doc = np.searchsorted(first, i, "right") - 1
        i = i[(doc >= 0) & (i + 2 * step <= ends[doc]) & (TIMES * step <= sizes[doc])]
        span, rank = blocks.spans(k), blocks.ranks[k][i]
        several = span[rank + 1] - span[rank] > 1
        i, rank = i[several], rank[several]
        at.append(i), lo.append(span[rank]), hi.append(span[rank + 1]), length.append(np.full(len(i), step))
    at, lo, hi, length = (np.concatenate(x) for x in (at, lo, hi, length))
    if not len(at):
        return none, none, none
    one, two, three = _successors(_Wavelet(blocks.suffixes), lo, hi, at + length, at + 2 * length)
    few = three < 0
    i = np.concatenate([at[few & (one >= 0)], at[few & (two >= 0)]])
    q = np.concatenate([one[few & (one >= 0)], two[few & (two >= 0)]]) - i
    i3, j3, d = at[~few], one[~few], (two - one)[~few]
    if len(i3):  # a progression: the distance that brings the two stretches of period d to one end
        q3 = (j3 + blocks.ahead(j3, j3 + d)) - (i3 + blocks.ahead(i3, i3 + d))
        fit = q3 > 0
        i, q = np.concatenate([i, i3[fit]]), np.concatenate([q, q3[fit]])
    start, end = i - blocks.behind(i, i + q), i + q + blocks.ahead(i, i + q)
    good = end - start >= np.maximum(LEAST, TIMES * q)
    start, end, q = start[good], end[good], q[good]
    order = np.lexsort((q, end, start))
    start, end, q = start[order], end[order], q[order]
    new = np.r_[True, (start[1:] != start[:-1]) | (end[1:] != end[:-1])][: len(start)]
    return start[new], end[new], q[new]


def planted(doc_id: int | None, n: int) -> np.ndarray | None:
    """Which original word stands at each place after the rule that repeats the tail of every tenth document; None: unchanged."""
    if doc_id is None or n == 0:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    place = np.arange(n)
    place[a:] = a + (place[a:] - a) % p
    return place


def _judged(ids: list, texts: list[list[bytes]], rewrite) -> Iterator[tuple]:
    """Rows of `SCHEMA` for a chunk of documents given as word lists."""
    known: dict[bytes, int] = {}
    pieces, sizes = [], np.array([len(t) for t in texts], np.int64)
    for words in texts:
        for word in words:
            known.setdefault(word, len(known))
    for k, words in enumerate(texts):
        values = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        place = rewrite(ids[k], len(words)) if rewrite else None
        if place is not None:
            values = values[place]
            texts[k] = [words[x] for x in place.tolist()]
        pieces += [np.array([len(known) + k]), values]
    pieces.append(np.array([len(known) + len(texts)]))
    first = np.cumsum(np.r_[1, sizes[:-1] + 1])
    start, end, period = runs(np.concatenate(pieces), first, sizes)
    doc = np.searchsorted(first, start, "right") - 1
    cuts = np.searchsorted(doc, np.arange(len(texts) + 1))
    for k, words in enumerate(texts):
        mine = slice(cuts[k], cuts[k + 1])
        s, e, q = (start[mine] - first[k]).tolist(), (end[mine] - first[k]).tolist(), period[mine].tolist()
        best = (None,) * 4
        if s:
            told = sorted((a, b - a, c) for a, b, c in zip(s, e, q, strict=True))
            a, n, c = max(told, key=lambda r: (r[1], -r[0], -r[2]))
            best = (a, n, c, 1000 * n // c)
            gone = np.zeros(len(words) + 1, np.int64)
            np.add.at(gone, np.array([a + c for a, _, c in told]), 1)
            np.add.at(gone, np.array([a + n for a, n, _ in told]), -1)
            words = [words[x] for x in np.flatnonzero(np.cumsum(gone[:-1]) == 0).tolist()]
            listed = "".join(f"{a},{n},{c}\n" for a, n, c in told).encode()
        else:
            listed = b""
        yield ids[k], len(s), *best, hashlib.sha256(listed).hexdigest(), hashlib.sha256(b" ".join(words)).hexdigest()


def _rows(rewrite):
    fields = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    kinds = [pa.int64()] * 6 + [pa.string()] * 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, raws = batch.column(0).to_pylist(), list(raw_texts(batch.column(1)))
            order = sorted(range(len(ids)), key=lambda k: len(raws[k] or b""))  # like lengths together need like depths
            while order:
                some, held, n = [], [], 0
                while order and n < CHUNK:
                    k = order[-1]
                    words = (raws[k] or b"").split()
                    if held and n + len(words) > CHUNK:
                        break
                    order.pop()
                    raws[k] = None
                    some.append(ids[k]), held.append(words)
                    n += len(words)
                columns = zip(*_judged(some, held, rewrite), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], fields)

    return run


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rewrite=None) -> DataFrame:
    """One row (`SCHEMA`) for every row of ``docs``: its runs, the longest of them, and the text without repetitions.

    ``rewrite(id, n)`` may give, for a document of n words, which original word is to
    stand at each place (see `planted`), or None.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(_rows(rewrite), SCHEMA)
