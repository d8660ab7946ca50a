"""Scoring texts with a class-based bigram model whose classes come from exchange clustering.

The model: P(w | v) = P(class(w) | class(v)) * P(w | class(w)). Tokens are the
words of a text with A-Z lower-cased, then one end token.

* Counts of all training tokens are gathered by a distributed aggregation.
* Words with at least ``CLUSTER_SHARE`` of all tokens (and ``MIN_COUNT`` of them)
  get their class by exchange. First those with ``FIRST_SHARE`` or more are
  exchanged in sweeps: tasks compute for each word of a batch the class that the
  likelihood gains most by, from its class-level neighbour counts and the class
  bigram matrix; the batch moves if the likelihood of the new matrix, counted
  again, is higher, else only its better half is tried, down to a single word.
  So the likelihood never falls. Sweeps end when one gains less than
  ``TOLERANCE``. Then every rarer word moves once by the same gain against the
  matrix of the frequent words, all together, accepted by the same rule.
* All other words, seen or not, have a class by their shape: their ending and
  last letters.
* Class transitions are smoothed towards the class frequencies, emissions of
  shape classes add ``DELTA`` to every count and keep one share for unseen
  words, so that probabilities sum to one.

What is held in a task or on the driver is bounded by shares, not by the data:
at most 1/CLUSTER_SHARE clustered words, 1/KNOWN_SHARE words with counts at hand
(a word list of the language; in practice a tenth of that), and a class matrix of
fixed size. All other words' counts are joined to the texts' rarer words by a
shuffle, so every word's own count is used.

Null texts count as empty (one end token). Held-out rows (crc32 of the id mod 10
is 0) never enter a count. Repeated rows are scored, and counted, each. An
empty training table gives the smoothed unseen probabilities, an empty table no
rows. A very long text is one array of token places, in one task. Extra columns,
whatever their names, are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_batches, cut, id_bucket, raw_texts, stored, words

HELD_OUT = (10, 0)
DELTA = 0.1
#: Words with this share of the training tokens or more are clustered: at most 1,000,000 words.
CLUSTER_SHARE = 1e-6
#: Fewer occurrences than this tell too little of a word's neighbours to cluster it.
MIN_COUNT = 5
#: Words with this share or more are exchanged in sweeps: at most 10,000 words.
FIRST_SHARE = 1e-4
#: Words with this share or more have their counts in every task: at most 3,300,000 words.
KNOWN_SHARE = 3e-7
CLASSES = 96
SWEEPS = 4
#: Batches of a sweep.
BATCHES = 4
#: A sweep that gains less than this part of the likelihood is the last.
TOLERANCE = 1e-4
#: Smoothing of class transitions, in counts of the class frequencies.
ALPHA = 20.0
END = b"\n"
_KINDS, _ENDINGS = 6, 24
SHAPES = _KINDS * _ENDINGS


def shape(word: bytes) -> int:
    """The shape class of a word that is not clustered: how it ends, and a hash of its last two letters."""
    last = word[-1:]
    kind = 0 if last == b"." else 1 if last == b"," else 2 if last.isdigit() else 4 if last.isalpha() else 3 if last < b"\x80" else 5
    core = word.rstrip(b".,;:!?%$#&*\"')]")
    return kind * _ENDINGS + crc32(core[-2:]) % _ENDINGS


def count_tokens(texts: DataFrame) -> DataFrame:
    """``(token, n)`` of all texts ``(text)``; tokens are bytes, the end is one line feed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(counts: Counter) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["token", "n"])

        counts: Counter = Counter()
        for batch in batches:
            for raw in raw_texts(batch.column(0)):
                counts.update(words(raw))
                if len(counts) > 400_000:
                    yield rows(counts)
                    counts = Counter()
            counts[END] += batch.num_rows
        yield rows(counts)

    return texts.mapInArrow(run, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n"))


class _Units(dict):
    """token -> unit: its place in a list of words, or behind these its shape class, then the end; no other word is kept."""

    def __init__(self, listed: list[bytes]):
        super().__init__(zip(listed, range(len(listed)), strict=True))
        self.others = len(listed)
        self[END] = self.others + SHAPES

    def __missing__(self, token: bytes) -> int:
        return self.others + shape(token)


def _pairs(texts: DataFrame, clustered: list[bytes]) -> DataFrame:
    """``(a, b, n)``: how often unit b follows unit a; every text begins and ends at the end token."""
    m = len(clustered) + SHAPES + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = _Units(clustered)
        end = np.array([m - 1])
        held: list[np.ndarray] = []

        def rows() -> pa.RecordBatch:
            code, n = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(code, pa.int64()), pa.array(n, pa.int64())], ["code", "n"])

        size = 0
        for batch in batches:
            for raw in raw_texts(batch.column(0)):
                tokens = words(raw)
                ids = np.concatenate([end, np.fromiter(map(units.__getitem__, tokens), np.int64, len(tokens)), end])
                held.append(ids[:-1] * m + ids[1:])
                size += len(ids)
                if size > 6_000_000:
                    yield rows()
                    size = 0
        yield rows()

    # One number is a shorter key to shuffle; a task's codes are distinct, so they are dealt out before they are summed.
    counts = texts.mapInArrow(run, "code long, n long").repartition("code").groupBy("code").agg(F.sum("n").alias("n"))
    return counts.select(F.expr(f"code div {m}").cast("int").alias("a"), (F.col("code") % m).cast("int").alias("b"), "n")


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def likelihood(matrix: np.ndarray) -> float:
    """The part of the training log-likelihood that the classes decide, from the counts of class bigrams."""
    m = matrix.astype(np.float64)
    return float(_xlogx(m).sum() - _xlogx(m.sum(axis=0)).sum() - _xlogx(m.sum(axis=1)).sum())


def best_class(matrix: np.ndarray, own: int, left: np.ndarray, right: np.ndarray, alone: float, n: int, sums: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[int, float]:
    """The class among the first ``n`` that a word should have, and what the log-likelihood gains by it.

    ``matrix`` counts class bigrams with the word in class ``own``; ``left[c]``
    and ``right[c]`` count its predecessors and successors by class, itself
    included, ``alone`` the times it follows itself. ``sums`` are the matrix's row
    and column sums, if they are at hand. Only classes of neighbours are looked at.
    """
    rows, cols = sums or (matrix.sum(axis=1), matrix.sum(axis=0))
    left, right = left.astype(np.float64), right.astype(np.float64)
    left[own] -= alone
    right[own] -= alone
    at = np.arange(n) if own < n else np.r_[np.arange(n), own]
    mine = int(own) if own < n else n  # the place of its own class in ``at``
    l, r = np.flatnonzero(left), np.flatnonzero(right)
    # Counts without the word: of the classes in ``at`` before its successors' classes, and behind its predecessors'.
    out, into = matrix[np.ix_(at, r)].astype(np.float64), matrix[np.ix_(l, at)].T.astype(np.float64)
    out[mine] -= right[r]
    into[mine] -= left[l]
    out[:, r == own] -= left[at][:, None]
    into[:, l == own] -= right[at][:, None]
    out[mine, r == own] -= alone
    into[mine, l == own] -= alone
    diagonal = matrix[at, at].astype(np.float64)
    diagonal[mine] -= left[own] + right[own] + alone
    rows, cols = rows[at].astype(np.float64), cols[at].astype(np.float64)
    rows[mine] -= right.sum() + alone
    cols[mine] -= left.sum() + alone
    other_r, other_l = at[:, None] != r[None, :], at[:, None] != l[None, :]
    total = ((_xlogx(out + right[r]) - _xlogx(out)) * other_r).sum(axis=1) + ((_xlogx(into + left[l]) - _xlogx(into)) * other_l).sum(axis=1)
    total += _xlogx(diagonal + left[at] + right[at] + alone) - _xlogx(diagonal)
    total -= _xlogx(rows + right.sum() + alone) - _xlogx(rows) + _xlogx(cols + left.sum() + alone) - _xlogx(cols)
    best = int(total[:n].argmax())
    return best, float(total[best] - total[mine])


def _summed(pairs: DataFrame, codes: Callable[[np.ndarray, np.ndarray], list[tuple[np.ndarray, np.ndarray]]], dense: int | None = None) -> DataFrame:
    """``(code, n)``: the counts of ``pairs (a, b, n)`` summed by whole numbers.

    ``codes`` gives for arrays of ``a`` and ``b`` places in them and their codes. A task sums
    before the shuffle: in one array if the codes lie below ``dense``, else by sorting.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def rows() -> pa.RecordBatch:
            code, n = (np.concatenate(x) for x in zip(*held, strict=True)) if held else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            held.clear()
            if dense:
                sums = np.bincount(code, n, dense).astype(np.int64)
                code = np.flatnonzero(sums)
                sums = sums[code]
            else:
                order = np.argsort(code)
                code, n = code[order], n[order]
                first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]][: len(code)])
                code, sums = code[first], np.add.reduceat(n, first) if len(first) else n
            return pa.RecordBatch.from_arrays([pa.array(code, pa.int64()), pa.array(sums, pa.int64())], ["code", "n"])

        size = 0
        for batch in batches:
            a, b, n = (batch.column(i).to_numpy() for i in range(3))
            for at, code in codes(a, b):
                held.append((code, n[at]))
                size += len(code)
            if size > 2_000_000:
                found = rows()
                size = 0
                yield found
        yield rows()

    found = pairs.select("a", "b", "n").mapInArrow(run, "code long, n long")
    return (found if dense else found.repartition("code")).groupBy("code").agg(F.sum("n").alias("n"))


def class_bigrams(pairs: DataFrame, of: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` x ``k`` counts of class bigrams of ``pairs (a, b, n)``."""
    out = np.zeros(k * k, np.int64)
    found = _summed(pairs, lambda a, b: [(slice(None), of[a] * k + of[b])], k * k).toArrow()  # at most k * k rows
    out[found["code"].to_numpy()] = found["n"].to_numpy()
    return out.reshape(k, k)


def _sides(pairs: DataFrame, of: np.ndarray, first: int, stop: int) -> DataFrame:
    """``(u, left, right, alone)`` of the units from ``first`` to ``stop``: counts of their neighbours by ``o``, unit or class."""
    k = int(of.max()) + 1

    def codes(a: np.ndarray, b: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        left, right = np.flatnonzero((b >= first) & (b < stop)), np.flatnonzero((a >= first) & (a < stop))
        alone = right[a[right] == b[right]]
        code = lambda u, side, o: (u.astype(np.int64) * 3 + side) * k + o
        return [(left, code(b[left], 0, of[a[left]])), (right, code(a[right], 1, of[b[right]])), (alone, code(a[alone], 2, 0))]

    counts = _summed(pairs, codes).select(F.expr(f"code div {3 * k}").cast("int").alias("u"), F.expr(f"code div {k} % 3").alias("side"), (F.col("code") % k).cast("int").alias("o"), "n")
    pick = lambda side: F.collect_list(F.when(F.col("side") == side, F.struct("o", "n")))
    return counts.groupBy("u").agg(pick(0).alias("left"), pick(1).alias("right"), F.coalesce(F.sum(F.when(F.col("side") == 2, F.col("n"))), F.lit(0)).alias("alone"))


def _proposals(sides: DataFrame, matrix: np.ndarray, of: np.ndarray, classes: int, mapped: np.ndarray | None = None) -> list[tuple[int, int]]:
    """``(word, class)`` of the words that gain by a move, those that gain most first; ``mapped`` gives the class of each ``o``."""
    k = len(matrix)
    sums = matrix.sum(axis=1), matrix.sum(axis=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counts(batch: pa.RecordBatch, name: str) -> Iterator[np.ndarray]:
            column = batch.column(batch.schema.get_field_index(name))
            ends, flat = column.offsets.to_numpy(), column.values
            o, n = flat.field("o").to_numpy(), flat.field("n").to_numpy()
            o = o if mapped is None else mapped[o]
            for a, b in zip(ends[:-1], ends[1:], strict=True):
                yield np.bincount(o[a:b], n[a:b], k)

        for batch in batches:
            words, alone = batch.column(0).to_numpy(), batch.column(3).to_numpy()
            found = [best_class(matrix, int(of[u]), l, r, x, classes, sums) for u, x, l, r in zip(words, alone, counts(batch, "left"), counts(batch, "right"), strict=True)]
            gain = np.array([g for _, g in found])
            keep = gain > 1e-6
            yield pa.RecordBatch.from_arrays([pa.array(words[keep], pa.int32()), pa.array(np.array([c for c, _ in found])[keep], pa.int32()), pa.array(gain[keep])], ["u", "c", "gain"])

    moves = sides.select("u", "left", "right", "alone").mapInArrow(run, "u int, c int, gain double").toArrow().to_pydict()  # a row a clustered word
    order = sorted(range(len(moves["u"])), key=lambda i: (-moves["gain"][i], moves["u"][i]))
    return [(moves["u"][i], moves["c"][i]) for i in order]


def _climb(pairs: DataFrame, of: np.ndarray, matrix: np.ndarray, moves: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Classes and matrix after as many of ``moves``, from the front, as raise the likelihood together; each failure halves them."""
    now = likelihood(matrix)
    while moves:
        moved = of.copy()
        at = np.array(moves)
        moved[at[:, 0]] = at[:, 1]
        after = class_bigrams(pairs, moved, len(matrix))
        if likelihood(after) > now:
            return moved, after
        moves = moves[: len(moves) // 2]
    return of, matrix


def exchange(pairs: DataFrame, shapes: np.ndarray, n_first: int, classes: int = CLASSES, sweeps: int = SWEEPS) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """The class of every unit, the class bigrams, and the likelihood after each step, which never falls.

    ``shapes`` has the shape of each clustered word, most frequent first;
    ``pairs (a, b, n)`` stays distributed; the driver holds a class for each unit
    and the class matrix, both of bounded size.
    """
    n_words, k = len(shapes), classes + SHAPES + 1
    lumps = classes + np.r_[shapes, np.arange(SHAPES + 1)].astype(np.int64)
    if n_words < 2 or not sweeps:
        return lumps, class_bigrams(pairs, lumps, k), []
    # The frequent words' neighbours: themselves, and all others by their shapes.
    small_of = np.r_[np.arange(n_first), n_first + lumps[n_first:] - classes]
    m = int(small_of.max()) + 1
    small = _summed(pairs, lambda a, b: [(slice(None), small_of[a] * m + small_of[b])])
    small = stored(small.select(F.expr(f"code div {m}").cast("int").alias("a"), (F.col("code") % m).cast("int").alias("b"), "n"))
    of = np.r_[np.arange(n_first) % classes, classes + np.arange(SHAPES + 1)].astype(np.int64)
    matrix = class_bigrams(small, of, k)
    trace = [likelihood(matrix)]
    sides = cut(_sides(small, np.arange(len(of)), 0, n_first))
    for sweep in range(sweeps):
        before = likelihood(matrix)
        for part in range(BATCHES):
            mine = sides.where(F.pmod(F.xxhash64(F.col("u"), F.lit(sweep)), F.lit(BATCHES)) == part)
            of, matrix = _climb(small, of, matrix, _proposals(mine, matrix, of, classes, of))
            trace.append(likelihood(matrix))
        if trace[-1] - before < TOLERANCE * abs(before):
            break
    # The rarer words: from their shape to the class they gain most by.
    every = np.r_[of[:n_first], lumps[n_first:]]
    rarer = _sides(pairs, every, n_first, n_words)
    every, matrix = _climb(pairs, every, matrix, _proposals(rarer, matrix, every, classes))
    return every, matrix, [*trace, likelihood(matrix)]


class ClassModel:
    """Counts, classes and probabilities; `score` applies them to texts."""

    def __init__(self, counts: DataFrame, known: dict[bytes, int], clustered: list[bytes], of: np.ndarray, bigrams: np.ndarray, types: np.ndarray, tokens: int, vocabulary: int, trace: list[float]):
        self.counts, self.known, self.clustered, self.of = counts, known, clustered, of
        self.trace = trace  # the likelihood after each step of the exchange
        self.tokens, self.vocabulary = tokens, vocabulary
        k = len(bigrams)
        after, before = bigrams.sum(axis=0).astype(np.float64), bigrams.sum(axis=1).astype(np.float64)
        share = (after + DELTA) / (after.sum() + DELTA * k)
        self.transition = np.log10((bigrams + ALPHA * share[None, :]) / (before[:, None] + ALPHA))
        # Emission: a clustered word's count over its class's; in shape classes smoothed, with a share for unseen words.
        self.class_size, self.types = after, types


def fit(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cluster_share: float = CLUSTER_SHARE, known_share: float = KNOWN_SHARE,
    first_share: float = FIRST_SHARE, min_count: int = MIN_COUNT, classes: int = CLASSES, sweeps: int = SWEEPS,
) -> ClassModel:
    """Learn from the rows of ``docs`` that are not held out."""
    texts = docs.where(id_bucket(id_col, HELD_OUT[0]) != HELD_OUT[1]).select(F.col(text_col).cast("string").alias("text"))
    bounded_batches(docs.sparkSession)
    counts = stored(count_tokens(texts))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    least = max(float(min_count), total.n * cluster_share)
    frequent = counts.where((F.col("n") >= min(least, max(1.0, total.n * known_share))) | (F.col("token") == F.lit(END))).toArrow()  # at most 1 / known_share rows
    known = dict(zip(frequent["token"].to_pylist(), frequent["n"].to_pylist(), strict=True))
    clustered = sorted((w for w, n in known.items() if n >= least and w != END), key=lambda w: (-known[w], w))
    n_first = sum(known[w] >= total.n * first_share for w in clustered)
    pairs = stored(_pairs(texts, clustered))
    of, bigrams, trace = exchange(pairs, np.array([shape(w) for w in clustered], np.int64), n_first, classes, sweeps)
    # Words that no class gains by stay words of their shape, with its smoothing.
    settled = [i for i in range(len(clustered)) if of[i] < classes]
    of = np.r_[of[settled], of[len(clustered) :]]
    clustered = [clustered[i] for i in settled]
    k = classes + SHAPES + 1

    def types(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = {*clustered, END}
        n = Counter(shape(t) for batch in batches for t in raw_texts(batch.column(0)) if t not in own)
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.int32()), pa.array(list(n.values()), pa.int64())], ["s", "v"])

    v = np.zeros(k)
    for r in counts.select("token").mapInArrow(types, "s int, v long").groupBy("s").agg(F.sum("v").alias("v")).collect():
        v[classes + r.s] = r.v
    return ClassModel(counts, known, clustered, of, bigrams, v, total.n, total.v, trace)


def score(model: ClassModel, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` of every row."""
    clustered, of, transition, class_size, v = model.clustered, model.of, model.transition, model.class_size, model.types
    n_words, tokens = len(clustered), model.tokens
    base_under = float(np.log10(tokens + DELTA * (model.vocabulary + 1)))
    under = np.log10(class_size[of[n_words:]] + DELTA * (v[of[n_words:]] + 1))  # of the shapes' emissions
    under[-1] = 0.0
    # Places: the words whose counts are at hand, the shapes of all others, the end.
    at_hand = [w for w in model.known if w != END]
    n_known, end_count = len(at_hand), model.known.get(END, 0)
    unit = np.r_[np.fromiter(map(_Units(clustered).__getitem__, at_hand), np.int64, n_known), n_words + np.arange(SHAPES + 1)]
    counts = np.r_[np.fromiter((model.known[w] for w in at_hand), np.float64, n_known), np.zeros(SHAPES), end_count]
    shaped = unit >= n_words
    emissions = np.where(counts > 0, np.log10(counts + DELTA), 0.0)
    emissions[shaped] -= under[unit[shaped] - n_words]
    emissions[~shaped] = np.log10(counts[~shaped] / class_size[of[unit[~shaped]]])
    emissions[-1] = 0.0
    bases = np.log10(counts + DELTA)
    bases[n_known:-1] = 0.0  # these counts are joined
    end = n_known + SHAPES
    tables = docs.sparkSession.sparkContext.broadcast((at_hand, of[unit], emissions, bases))
    schema = "row long, doc_id long, n_tokens long, n_known long, base double, score double, token binary, n long"
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.int64()]
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_at_hand, classes, emit, base = tables.value
        place = _Units(words_at_hand)

        def scored(rows: np.ndarray, docs_: pa.Array, tokens: list[bytes], lengths: list[int]) -> Iterator[pa.RecordBatch]:
            """Of rows whose ``tokens``, an end behind each row's, stand one after another: a record a row, and one for each of its rarer words."""
            lengths = np.array(lengths, np.int64)
            starts = np.cumsum(lengths) - lengths
            at = np.fromiter(map(place.__getitem__, tokens), np.int64, len(tokens))
            cls = classes[at]
            moved = transition[np.r_[classes[end], cls[:-1]], cls] + emit[at]  # the row before ends at the end, where each begins
            rare = np.flatnonzero((at >= n_known) & (at < end))
            owner = np.searchsorted(starts, rare, "right") - 1
            known = lengths - np.bincount(owner, minlength=len(lengths)) - (not end_count)
            sums = [np.add.reduceat(x, starts) for x in (base[at] - base_under, moved)]
            ends = [END + str(row).encode() for row in rows.tolist()]  # no word, and one of its own for each row
            yield record(rows, docs_, lengths, known, *sums, ends, np.zeros(len(rows), np.int64))
            found = Counter(zip(owner.tolist(), map(tokens.__getitem__, rare.tolist()), strict=True))
            nulls = [pa.nulls(len(found), t) for t in kinds[1:6]]
            yield record(rows[np.fromiter((i for i, _ in found), np.int64, len(found))], *nulls, [w for _, w in found], list(found.values()))

        def record(*columns) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

        for batch in batches:
            rows, ids = batch.column(0).to_numpy(), batch.column(1)
            tokens: list[bytes] = []
            lengths: list[int] = []
            first = 0
            for i, raw in enumerate(raw_texts(batch.column(2)), 1):
                before = len(tokens)
                tokens += words(raw)
                tokens.append(END)
                lengths.append(len(tokens) - before)
                if len(tokens) > 200_000 or i == batch.num_rows:
                    yield from scored(rows[first:i], ids[first:i], tokens, lengths)
                    first, tokens, lengths = i, [], []

    bounded_batches(docs.sparkSession)
    slim = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    flat = slim.mapInArrow(run, schema)
    rare = model.counts.select(F.col("token").alias("t"), F.col("n").alias("c"))
    joined = flat.join(rare, flat.token == F.col("t"), "left")
    logs = F.col("n") * F.log10(F.coalesce(F.col("c"), F.lit(0)) + DELTA)
    sums = joined.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens"), F.max("base").alias("base"), F.max("score").alias("score"),
        (F.max("n_known") + F.sum(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0))).alias("n_known"), F.sum(logs).alias("more"),
    )
    n, r = HELD_OUT
    return sums.select(
        "doc_id", (id_bucket("doc_id", n) == r).alias("held_out"), "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.col("more")).alias("base_score"), (F.col("score") + F.col("more")).alias("score"),
    )
