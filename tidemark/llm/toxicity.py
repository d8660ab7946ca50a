"""Toxicity: gradient-boosted trees over dense features, calibrated by isotonic regression.

Training, on labelled rows only, at most ``MAX_TRAIN`` of them (chosen by a hash
of the id; the bound is a parameter):

* A lexicon is learned: words and word beginnings whose share among toxic texts
  is significantly higher than among others (log-odds with a z-score), all of
  them. No word list is fixed, so it follows the labels' languages.
* A row's features come from a lexicon that its own fold did not help to
  learn, so that the trees see densities as they are on unseen texts.
* ``pyspark.ml`` fits the trees on most of these rows and the isotonic
  calibration on the rest, where rows of equal raw scores are one weighted row.

Scoring reads every whole text once, in Arrow batches, and looks each word up
in a bounded cache. Null and empty texts have all features zero. Labels, ids,
languages and sources are never features. Without labelled rows of both kinds
the score is the (smoothed) share of toxic labels, or 0 without labels.
Repeated labels of an id count as toxic if one of them does; repeated rows are
scored each. An empty table gives an empty one. A very long text is described in
chunks. Extra columns, whatever their names, are ignored by scores and kept by
`drop_toxic`.
"""

from __future__ import annotations

import re
import string
from array import array
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_batches, cut, id_bucket, raw_texts, unit_hash

#: Documented bound on the labelled rows that training reads.
MAX_TRAIN = 20_000
#: A lexicon's entries from this quantile of their z-scores on are strong ones.
STRONG = 0.75
FOLDS = 3
THRESHOLD = 0.3
HELD_OUT = (4, 2)

#: Second-person words of the corpus languages.
SECOND_PERSON = frozenset(
    "you your yours yourself u ur du dich dir dein deine deinen ihr euch tu te toi ton ta tes vous votre vos tú ti usted ustedes vosotros tus".split()
)
#: Characters that stand in for letters inside disguised words.
STAND_INS = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})

FEATURES = (
    "strong_density", "strong_hits", "weak_density", "mean_z", "kinds",
    "near_second_person", "second_person", "upper_share", "shouted_share", "punctuation", "exclaimed", "obfuscated", "length",
)

_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_INNER = re.compile(r"[^\W\d_][\d@$!*.\-_]+[^\W\d_]")


def _core(word: str) -> str:
    """A word without the punctuation around it, in lower case, disguises undone."""
    bare = _EDGE.sub("", word).lower()
    if bare.isalpha() or not bare:
        return bare
    return re.sub(r"[\W\d_]+", "", bare.translate(STAND_INS))


def grams(core: str) -> list[str]:
    """What the lexicon may hold of a word: itself and its beginnings of 4 to 6 letters."""
    return [core, *(f"{core[:n]}*" for n in (4, 5, 6) if len(core) > n)]


def _known(cache: dict, word: bytes, make) -> object:
    """``cache[word]``, made if missing; the cache is emptied before it grows beyond its bound."""
    found = cache.get(word)
    if found is None:
        if len(cache) > 60_000:
            cache.clear()
        found = cache[word] = make(word)
    return found


class _Words(dict):
    """token -> the place of its row among the distinct ``rows`` of numbers that describe words.

    A row: the highest z of the lexicon's entries for it, second person, letters, capitals,
    shouted, marks, marks that exclaim or ask, disguised, length.
    """

    WIDTH = 9

    def __init__(self, lexicon: dict[str, float], most: int = 150_000):
        super().__init__()
        self.lexicon, self.most = lexicon, most
        self.heads = {g.rstrip("*")[:4] for g in lexicon}  # how every word begins that the lexicon knows
        self.places: dict[tuple, int] = {}
        self.rows = array("d")

    def __missing__(self, token: bytes) -> int:
        word = token.decode("utf-8", "replace")
        bare = word.strip(string.punctuation)
        core, n = bare.lower(), len(word)
        if bare.isalpha() and core.isalpha():  # most words: letters in one piece, with ASCII marks around them at most
            letters, digits, inner = len(bare), 0, 0.0
        else:
            core, letters, digits, inner = _core(word), sum(map(str.isalpha, word)), sum(map(str.isdigit, word)), float(bool(_INNER.search(word)))
        upper = 0 if bare.islower() else letters if bare.isupper() and not inner and letters == len(bare) and bare.isascii() else sum(map(str.isupper, word))
        z = max((self.lexicon.get(g, 0.0) for g in grams(core)), default=0.0) if core and core[:4] in self.heads else 0.0
        asks = word.count("!") + word.count("?") if letters < n else 0
        row = (z, core in SECOND_PERSON, letters, upper, letters > 2 and upper == letters, n - letters - digits, asks, inner, n)
        found = self.places.get(row)
        if found is None:
            found = self.places[row] = len(self.places)
            self.rows.extend(row)
        self[token] = found
        return found

    def described(self, tokens: list[bytes]) -> np.ndarray:
        """A row for each of ``tokens``; the words are forgotten before they grow beyond ``most``."""
        if len(self) > self.most or len(self.places) > self.most:
            self.clear()
            self.places, self.rows = {}, array("d")
        at = np.fromiter(map(self.__getitem__, tokens), np.int64, len(tokens))
        return np.frombuffer(self.rows).reshape(-1, self.WIDTH)[at]


def learn_lexicon(train: DataFrame, min_z: float = 2.5, min_odds: float = 1.4) -> list[dict[str, float]]:
    """Lexicons ``gram -> z`` from ``train (text, toxic, fold)``: one without each fold, then one of all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cores: dict[bytes, list[str]] = {}

        def rows(counts: Counter) -> pa.RecordBatch:
            g, f, y = (pa.array((key[i] for key in counts), kind) for i, kind in enumerate((pa.string(), pa.int32(), pa.int32())))
            return pa.RecordBatch.from_arrays([g, f, y, pa.array(counts.values(), pa.int64())], ["gram", "fold", "toxic", "n"])

        counts: Counter = Counter()
        for batch in batches:
            for raw, toxic, fold in zip(raw_texts(batch.column(0)), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                found: set[str] = set()
                for word in set((raw or b"").split()):
                    found.update(_known(cores, word, lambda w: grams(_core(w.decode("utf-8", "replace")))))
                found.discard("")
                counts.update((g, fold, toxic) for g in found)
                if len(counts) > 100_000:
                    yield rows(counts)
                    counts.clear()
        yield rows(counts)

    totals = {(r.fold, r.toxic): r.n for r in train.groupBy("fold", "toxic").agg(F.count("*").alias("n")).collect()}
    by = train.select("text", "toxic", "fold").mapInArrow(run, "gram string, fold int, toxic int, n long").groupBy("gram")
    sums = [F.sum(F.when((F.col("fold") == f) & (F.col("toxic") == y), F.col("n")).otherwise(0)).alias(f"n{f}_{y}") for f in range(FOLDS) for y in (0, 1)]
    counts = cut(by.agg(*sums).where(" + ".join(f"n{f}_1" for f in range(FOLDS)) + " >= 2"))
    out = []
    for left_out in (*range(FOLDS), None):
        folds = [f for f in range(FOLDS) if f != left_out]
        clean, toxic = (sum(totals.get((f, y), 0) for f in folds) for y in (0, 1))
        a, b = (sum((F.col(f"n{f}_{y}") for f in folds), F.lit(0)) for y in (1, 0))
        odds = F.log((a + 0.5) / (toxic + 1.0)) - F.log((b + 0.5) / (clean + 1.0))
        z = odds / F.sqrt(1.0 / (a + 0.5) + 1.0 / (b + 0.5))
        best = counts.select("gram", z.alias("z"), odds.alias("odds")).where((F.col("z") >= min_z) & (F.col("odds") >= min_odds))
        out.append({r.gram: r.z for r in best.collect()})  # of at most MAX_TRAIN texts
    return out


def features(docs: DataFrame, lexicons: list[dict[str, float]], id_col: str = "doc_id", text_col: str = "text", fold_col: str | None = None, keep: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """``(id, x: array<double>)``: FEATURES of every row; ``fold_col`` says which lexicon a row gets (the last by default).

    With ``keep``, which judges a matrix of features, the rows of ``docs`` that it keeps instead.
    """
    strong_of = [float(np.quantile(list(x.values()), STRONG)) if x else 0.0 for x in lexicons]

    def vector(raw: bytes | None, known: _Words, strong_z: float) -> list[float]:
        tokens = (raw or b"").split()
        if not tokens:
            return [0.0] * len(FEATURES)
        m = np.zeros(_Words.WIDTH)
        n, hits, persons, strong, weak, z_sum, kinds = len(tokens), [], [], 0, 0, 0.0, set()
        for start in range(0, n, 1 << 16):  # bounds what a very long text holds at once
            part = tokens[start : start + (1 << 16)]
            rows = known.described(part)
            m += rows.sum(axis=0)
            at = np.flatnonzero(rows[:, 0])
            z = rows[at, 0]
            strong += int((z >= strong_z).sum())
            weak += int((z < strong_z).sum())
            z_sum += float(z.sum())
            kinds.update(part[i].lower() for i in at[z >= strong_z])
            hits.append(at + start)
            persons.append(np.flatnonzero(rows[:, 1]) + start)
        hit, person = np.concatenate(hits), np.concatenate(persons)
        near = 0.0
        if len(hit) and len(person):
            right = np.searchsorted(person, hit)
            gap = np.minimum(np.abs(person[np.minimum(right, len(person) - 1)] - hit), np.abs(person[np.maximum(right - 1, 0)] - hit))
            near = float((1.0 / (1.0 + gap)).max())
        letters = max(m[2], 1.0)
        return [
            strong / n, float(np.log1p(strong)), weak / n, z_sum / max(1, strong + weak), float(np.log1p(len(kinds))),
            near, m[1] / n, m[3] / letters, m[4] / n, m[5] / max(m[8], 1.0), m[6] / n, m[7] / n, float(np.log1p(n)),
        ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        makers = [(_Words(x), z) for x, z in zip(lexicons, strong_of, strict=True)]
        for batch in batches:
            folds = [len(makers) - 1] * batch.num_rows if keep else batch.column(2).to_pylist()
            x = [vector(t, *makers[f]) for t, f in zip(raw_texts(batch.column(text_at)), folds, strict=True)]
            if keep:
                yield batch.filter(pa.array(keep(np.array(x, np.float64).reshape(-1, len(FEATURES)))))
            else:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float64()))], ["id", "x"])

    bounded_batches(docs.sparkSession)
    text_at = docs.columns.index(text_col) if keep else 1
    if keep:
        return docs.mapInArrow(run, docs.schema)
    fold = F.col(fold_col) if fold_col else F.lit(len(lexicons) - 1)
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), fold.cast("int").alias("fold"))
    return slim.mapInArrow(run, "id long, x array<double>")


def tree_arrays(trees) -> list[tuple[float, np.ndarray]]:
    """The fitted trees as ``(weight, nodes)``, a node as (feature, threshold, left, right, prediction); a leaf leads to itself."""
    out = []
    for tree, weight in zip(trees.trees, trees.treeWeights, strict=True):
        nodes: list[list[float]] = []

        def grow(node, nodes=nodes) -> int:
            at = len(nodes)
            nodes.append([0.0, 0.0, at, at, node.prediction()])
            if node.subtreeDepth():
                nodes[at][:2] = node.split().featureIndex(), node.split().threshold()
                nodes[at][2:4] = grow(node.leftChild()), grow(node.rightChild())
            return at

        grow(tree._call_java("rootNode"))
        out.append((float(weight), np.array(nodes)))
    return out


def judge(x: np.ndarray, trees: list[tuple[float, np.ndarray]], boundaries: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The calibrated scores of a matrix of features."""
    margin, rows = np.zeros(len(x)), np.arange(len(x))
    for weight, nodes in trees:
        at = np.zeros(len(x), np.int64)
        for _ in range(len(nodes)):
            left = x[rows, nodes[at, 0].astype(np.int64)] <= nodes[at, 1]
            below = np.where(left, nodes[at, 2], nodes[at, 3]).astype(np.int64)
            if np.array_equal(below, at):
                break
            at = below
        margin += weight * nodes[at, 4]
    return np.clip(np.interp(1.0 / (1.0 + np.exp(-2.0 * margin)), boundaries, values), 0.0, 1.0)


class ToxicityModel:
    """A fitted lexicon, trees and calibration; ``score`` applies them to any table."""

    def __init__(self, lexicon: dict[str, float], trees, calibration, prior: float):
        self.lexicon, self.trees, self.calibration, self.prior = lexicon, trees, calibration, prior

    def _scored(self, found: DataFrame) -> DataFrame:
        """``(id, score)`` of rows ``found (id, x)``."""
        if self.trees is None:
            return found.select("id", F.lit(self.prior).alias("score"))
        raw = self.trees.transform(found.select("id", array_to_vector("x").alias("features"))).select("id", vector_to_array("probability")[1].alias("p"))
        return self.calibration.transform(raw).select("id", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("prediction"))).alias("score"))

    def score(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """``(doc_id, score, predicted)`` of every row; score is in [0, 1]."""
        scored = self._scored(features(docs, [self.lexicon], id_col, text_col)).withColumnRenamed("id", "doc_id")
        return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))

    def drop_toxic(self, docs: DataFrame, text_col: str = "text") -> DataFrame:
        """The rows of ``docs`` that score below THRESHOLD, judged in the pass that reads them: no join, rows without an id included."""
        if self.trees is None:
            return docs.where(F.lit(self.prior) < THRESHOLD)
        trees, at, values = tree_arrays(self.trees), self.calibration.boundaries.toArray(), self.calibration.predictions.toArray()
        return features(docs, [self.lexicon], text_col=text_col, keep=lambda x: judge(x, trees, at, values) < THRESHOLD)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_train: int = MAX_TRAIN, seed: int = 7) -> ToxicityModel:
    """Fit on the labelled rows of ``docs`` outside the held-out ids (crc32 of the id mod 4 is 2)."""
    bounded_batches(docs.sparkSession)
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    known = known.where(id_bucket("doc_id", HELD_OUT[0]) != HELD_OUT[1]).withColumn("u", unit_hash("doc_id", seed=seed))
    total = known.count()
    chosen = known.where(F.col("u") < max_train / total) if total > max_train else known
    chosen = chosen.select(F.col("doc_id").alias("__l"), "toxic", (F.floor(F.col("u") * 1e6) % FOLDS).cast("int").alias("fold"), (F.floor(F.col("u") * 1e9) % 4 == 0).alias("later"))
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    train = slim.join(F.broadcast(chosen), slim.id == F.col("__l")).select("id", "text", "toxic", "fold", "later")  # at most max_train rows, about
    train = train.persist()
    try:
        lexicons = learn_lexicon(train)
        x = features(train.select("id", "text", "fold"), lexicons, "id", "text", "fold")
        table = cut(x.join(chosen, x.id == F.col("__l")).select(array_to_vector("x").alias("features"), F.col("toxic").cast("double").alias("label"), "later"))
    finally:
        train.unpersist()
    n = {(r.later, int(r.label)): r.n for r in table.groupBy("later", "label").agg(F.count("*").alias("n")).collect()}
    positives, rows = sum(v for (_, y), v in n.items() if y), sum(n.values())
    prior = positives / (rows + 2.0) if rows else 0.0
    if not (n.get((False, 0)) and n.get((False, 1))):
        return ToxicityModel(lexicons[-1], None, None, prior)
    trees = GBTClassifier(maxDepth=3, maxIter=16, stepSize=0.3, minInstancesPerNode=3, maxBins=32, seed=seed).fit(table.where("not later").coalesce(2))
    small = not (n.get((True, 0), 0) >= 20 and n.get((True, 1), 0) >= 20)
    raw = trees.transform(table if small else table.where("later")).select("label", vector_to_array("probability")[1].alias("p"))
    distinct = raw.groupBy("p").agg(F.avg("label").alias("label"), F.count("*").cast("double").alias("w"))
    calibration = IsotonicRegression(featuresCol="p", labelCol="label", weightCol="w").fit(distinct)
    return ToxicityModel(lexicons[-1], trees, calibration, prior)
