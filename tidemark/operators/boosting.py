"""Gradient-boosted trees by histograms, all models of a table grown at once.

A table holds the training rows of many models (one for each coin and fold, say). Models
of more than `TASK_ROWS` rows are grown together, a level of a tree being one job for all
of them: each task sums first and second derivatives and row counts by (model, node,
feature, bin) over the rows it holds, the sums meet by (model, node), and a node's best
split is all that leaves. Rows are ranged by (model, key), so a large model lies in many
tasks and a task holds the histograms of one model at a time. Smaller models are dealt
to tasks whole and grown there, by the same sums and with equal trees, all in one job.

* Values are binned by quantiles of their model's training rows; bin 0 is for missing
  values, which go to the side that gains more.
* Derivatives are summed as whole multiples of 2^-30, so sums and splits do not depend
  on how rows are dealt to tasks or on a task that runs again.
* Each tree sees the rows and features that a hash of (seed, tree) picks.
* A model below `REFUSED_BELOW` rows, or whose rows are of one class, is refused: it
  has no row in the result.
* Every `KEEP` trees the margins are written to the shared folder, so a task never
  evaluates more than that.

The driver holds the splits (7 nodes a tree and model). Some `MODELS` models at most are
grown at a time, which bounds that and the broadcast of the last `KEEP` trees.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import settle

#: A model's rows below which it is refused.
REFUSED_BELOW = 200
#: Trees after which margins are written, and models grown at a time.
KEEP, MODELS = 25, 2_000
#: A model of at most so many rows is grown in one task.
TASK_ROWS = 20_000
DEPTH = 3
NODES, LEAVES = 2**DEPTH - 1, 2**DEPTH
_UNIT = float(1 << 30)

TREE = "array<struct<feature:array<int>,threshold:array<double>,missing_left:array<boolean>,leaf:array<double>>>"


@dataclass(frozen=True)
class Settings:
    trees: int = 200
    rate: float = 0.05
    least_rows: int = 40
    share: float = 0.8
    bins: int = 32
    ridge: float = 1.0
    seed: int = 0


class Tree:
    """One tree of a model, as a heap: node i has children 2i + 1 and 2i + 2; its splits are by bins."""

    __slots__ = ("feature", "bin", "missing_left", "leaf")

    def __init__(self):
        self.feature = np.zeros(NODES, np.int64)
        self.bin = np.full(NODES, 1 << 20)  # all rows go left until a split is found
        self.missing_left = np.ones(NODES, bool)
        self.leaf = np.zeros(LEAVES)

    def nodes(self, bins: np.ndarray, level: int) -> np.ndarray:
        """The node of each row at a level; leaves are level DEPTH."""
        at = np.zeros(len(bins), np.int64)
        for _ in range(level):
            value = bins[np.arange(len(bins)), self.feature[at]]
            left = np.where(value == 0, self.missing_left[at], value <= self.bin[at])
            at = 2 * at + np.where(left, 1, 2)
        return at

    def values(self, bins: np.ndarray) -> np.ndarray:
        return self.leaf[self.nodes(bins, DEPTH) - NODES]


def picked_rows(key: np.ndarray, tree: int, settings: Settings) -> np.ndarray:
    """Which rows a tree sees, by a hash of their key."""
    x = key.view(np.uint64) + np.uint64((settings.seed * 1_000_003 + tree + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / float(1 << 53) < settings.share


def picked_features(n: int, tree: int, settings: Settings) -> np.ndarray:
    """Which features a tree sees, ascending."""
    order = sorted(range(n), key=lambda f: hashlib.md5(f"{settings.seed}/{tree}/{f}".encode()).hexdigest())
    return np.array(sorted(order[: max(1, math.ceil(settings.share * n))]))


def derivatives(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of the weighted log loss, in whole units."""
    p = 1 / (1 + np.exp(-margin))
    return np.rint((p - y) * weight * _UNIT).astype(np.int64), np.rint(p * (1 - p) * weight * _UNIT).astype(np.int64)


def best_split(sums: np.ndarray, features: np.ndarray, settings: Settings) -> tuple:
    """``(feature, bin, missing_left, left value, right value)`` of a node from its sums [feature, bin, (g, h, n)].

    Of equal gains the first by (feature, bin, missing on the left) wins; without a split
    that gains, feature is -1 and both values are the node's own.
    """
    scaled = sums[features].astype(np.float64)
    scaled[..., :2] /= _UNIT
    total = scaled[0].sum(axis=0)
    left = np.cumsum(scaled[:, 1:-1], axis=1)
    left = np.stack([left + scaled[:, :1], left], axis=2)  # missing values left, or right
    right = total - left
    worth = lambda s: s[..., 0] ** 2 / (s[..., 1] + settings.ridge)
    value = lambda s: -settings.rate * s[0] / (s[1] + settings.ridge)
    gain = np.round(worth(left) + worth(right) - worth(total), 9)
    gain[(left[..., 2] < settings.least_rows) | (right[..., 2] < settings.least_rows)] = -1
    at = np.unravel_index(np.argmax(gain), gain.shape)
    if gain[at] <= 0:
        return -1, 0, True, value(total), value(total)
    return int(features[at[0]]), int(at[1]) + 1, at[2] == 0, value(left[at]), value(right[at])


def edges_of(rows: DataFrame, features: list[str], bins: int) -> DataFrame:
    """``(model, edges)``: for each feature the distinct quantiles at which a model's values are cut."""
    share = [k / bins for k in range(1, bins)]
    value = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    cuts = [F.array_sort(F.array_distinct(F.coalesce(F.percentile_approx(value(c), share, 10_000), F.array().cast("array<double>")))) for c in features]
    return rows.groupBy("model").agg(F.array(*cuts).alias("edges"))


def _binned(features: list[str]) -> Column:
    """A row's bins: 0 for a missing value, else 1 and one more for each edge below it."""
    places = [F.coalesce(F.size(F.filter(F.col("edges")[k], lambda e: e < F.col(c).cast("double"))) + 1, F.lit(0)) for k, c in enumerate(features)]  # noqa: B023
    return F.array(*[F.when(F.col(c).isNull() | F.isnan(F.col(c).cast("double")), 0).otherwise(p) for c, p in zip(features, places, strict=True)])


def _runs(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple]:
    """Rows in stretches of one model: ``(model, key, y, weight, margin, bins)``."""
    for batch in batches:
        if not batch.num_rows:
            continue
        model, key, y, weight, margin = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(5))
        bins = batch.column(5).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
        cuts = np.flatnonzero(np.r_[True, model[1:] != model[:-1], True])
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield int(model[a]), key[a:b], y[a:b], weight[a:b], margin[a:b], bins[a:b]


def _sums(bins: np.ndarray, node: np.ndarray, g: np.ndarray, h: np.ndarray, shape: tuple[int, int, int]) -> np.ndarray:
    """Sums of (g, h, 1) by node, feature and bin."""
    nodes, width, places = shape
    table = np.zeros((nodes, width, places, 3), np.int64)
    for f in range(width):
        place = node * places + bins[:, f]
        for k, v in enumerate((g, h, 1)):
            flat = np.zeros(nodes * places, np.int64)
            np.add.at(flat, place, v)
            table[:, f, :, k] = flat.reshape(nodes, places)
    return table


def _placed(tree: Tree, level: int, k: int, split: tuple) -> None:
    """Write the split of a level's k-th node into its tree."""
    feature, cut, missing_left, left, right = split
    node = 2**level - 1 + k
    if feature >= 0:
        tree.feature[node], tree.bin[node], tree.missing_left[node] = feature, cut, missing_left
    if level == DEPTH - 1:
        tree.leaf[2 * k : 2 * k + 2] = left, right


def _grown_here(key: np.ndarray, y: np.ndarray, weight: np.ndarray, margin: np.ndarray, bins: np.ndarray, settings: Settings) -> list[Tree]:
    """All trees of one model whose rows are at hand."""
    trees, width = [], bins.shape[1]
    for t in range(settings.trees):
        tree, seen, features = Tree(), picked_rows(key, t, settings), picked_features(width, t, settings)
        own = bins[seen]
        g, h = derivatives(margin[seen], y[seen], weight[seen])
        for level in range(DEPTH):
            table = _sums(own, tree.nodes(own, level) - (2**level - 1), g, h, (2**level, width, settings.bins + 1))
            for k in range(2**level):
                if table[k, 0, :, 2].any():
                    _placed(tree, level, k, best_split(table[k], features, settings))
        margin = margin + tree.values(bins)
        trees.append(tree)
    return trees


def _small_grown(data: DataFrame, width: int, settings: Settings) -> dict[int, list[Tree]]:
    """All trees of models of at most `TASK_ROWS` rows, each grown in the task that its rows are dealt to: one job."""
    names, kinds = ["model", "feature", "bin", "missing_left", "leaf"], [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.float64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def told() -> pa.RecordBatch:
            trees = _grown_here(*map(np.concatenate, zip(*held, strict=True)), settings)
            rows = [(at, t.feature.tolist(), t.bin.tolist(), t.missing_left.tolist(), t.leaf.tolist()) for t in trees]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for model, *part in _runs(batches, width):
            if model != at and held:
                yield told()
                held = []
            at = model
            held.append(part)
        if held:
            yield told()

    dealt = data.repartition("model").sortWithinPartitions("model", "key")
    out: dict[int, list[Tree]] = {}
    for r in dealt.mapInArrow(run, "model long, feature array<long>, bin array<long>, missing_left array<boolean>, leaf array<double>").collect():
        tree = Tree()
        tree.feature[:], tree.bin[:], tree.missing_left[:], tree.leaf[:] = r.feature, r.bin, r.missing_left, r.leaf
        out.setdefault(r.model, []).append(tree)
    return out


def _level(data: DataFrame, grown, tree: int, level: int, width: int, tasks: int, settings: Settings) -> list:
    """The best split of every node of a level, of all models: one job."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, at, table, first = grown.value, None, None, 2**level - 1
        shape = (2**level, width, settings.bins + 1)

        def told() -> pa.RecordBatch:
            full = [k for k in range(2**level) if table[k, 0, :, 2].any()]
            return pa.RecordBatch.from_arrays([pa.array([at] * len(full)), pa.array(full, pa.int32()), pa.array([table[k].tobytes() for k in full], pa.binary())], ["model", "node", "sums"])

        for model, key, y, weight, margin, bins in _runs(batches, width):
            if model != at:
                if at is not None:
                    yield told()
                at, table = model, np.zeros((*shape, 3), np.int64)
            for done in trees[model][:-1]:
                margin = margin + done.values(bins)
            seen = picked_rows(key, tree, settings)
            node = trees[model][-1].nodes(bins[seen], level) - first
            table += _sums(bins[seen], node, *derivatives(margin[seen], y[seen], weight[seen]), shape)
        if at is not None:
            yield told()

    names = ["model", "node", "feature", "bin", "missing_left", "left", "right"]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.float64(), pa.float64()]
    features = picked_features(width, tree, settings)

    def splits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = None, None
        for batch in batches:
            found = []
            for model, node, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                part = np.frombuffer(raw, np.int64).reshape(width, settings.bins + 1, 3)
                if (model, node) != at:
                    if at is not None:
                        found.append((*at, *best_split(total, features, settings)))
                    at, total = (model, node), np.zeros_like(part)
                total = total + part
            yield _record(found, kinds, names)
        if at is not None:
            yield _record([(*at, *best_split(total, features, settings))], kinds, names)

    parts = data.mapInArrow(sums, "model long, node int, sums binary").repartition(tasks, "model", "node").sortWithinPartitions("model", "node")
    return parts.mapInArrow(splits, "model long, node int, feature int, bin int, missing_left boolean, left double, right double").collect()


def _record(rows: list[tuple], kinds: list, names: list[str]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in kinds]
    return pa.RecordBatch.from_arrays([pa.array([x.item() if isinstance(x, np.generic) else x for x in c], t) for c, t in zip(columns, kinds, strict=True)], names)


def _with_margins(data: DataFrame, grown, width: int) -> DataFrame:
    """``data`` with what the grown trees add to the margins."""
    names = data.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for model, key, y, weight, margin, bins in _runs(batches, width):
            for tree in grown.value[model]:
                margin = margin + tree.values(bins)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, bins.size + 1, width), pa.int32()), pa.array(bins.ravel(), pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), model)), pa.array(key), pa.array(y), pa.array(weight), pa.array(margin), lists], names)

    return data.mapInArrow(run, data.schema)


def _grown(data: DataFrame, models: list[int], width: int, tasks: int, settings: Settings) -> dict[int, list[Tree]]:
    """All trees of the models of ``data``."""
    sc = data.sparkSession.sparkContext
    out: dict[int, list[Tree]] = {m: [] for m in models}
    fresh = 0  # trees that the margins of data do not hold yet
    for tree in range(settings.trees):
        for m in models:
            out[m].append(Tree())
        fresh += 1
        for level in range(DEPTH):
            grown = sc.broadcast({m: trees[len(trees) - fresh :] for m, trees in out.items()})
            for r in _level(data, grown, tree, level, width, tasks, settings):
                _placed(out[r.model][-1], level, r.node, (r.feature, r.bin, r.missing_left, r.left, r.right))
            grown.unpersist()
        if fresh == KEEP and tree + 1 < settings.trees:
            grown = sc.broadcast({m: trees[-fresh:] for m, trees in out.items()})
            data = settle(_with_margins(data, grown, width))
            fresh = 0
    return out


def fit(train: DataFrame, by: list[str], features: list[str], settings: Settings = Settings(), key: str = "key", label: str = "y", weight: str = "weight") -> DataFrame:  # noqa: B008
    """``(*by, base, trees)``: a model for each group of ``by`` that is not refused.

    ``train`` has a long ``key`` for each row, a label 0 or 1, a weight, and the features;
    ``trees`` are those of `score`, whose thresholds are values.
    """
    spark = train.sparkSession
    rows = settle(train.select(*by, F.xxhash64(*by).alias("model"), F.col(key).alias("key"), F.col(label).cast("double").alias("y"), F.col(weight).cast("double").alias("weight"), *features))
    y, w = F.col("y"), F.col("weight")
    told = rows.groupBy("model", *by).agg(F.count("*").alias("n"), F.sum((y * w).cast("decimal(38,12)")).cast("double").alias("up"), F.sum(w.cast("decimal(38,12)")).cast("double").alias("w"), F.min("y").alias("least"), F.max("y").alias("most"))
    told = settle(told.where((F.col("n") >= REFUSED_BELOW) & (F.col("least") < F.col("most")) & (F.col("up") > 0) & (F.col("up") < F.col("w"))))
    base = F.log(F.col("up") / (F.col("w") - F.col("up")))
    edges = edges_of(rows.join(told.select("model"), "model", "left_semi"), features, settings.bins)
    parts = max(1, -(-told.count() // (MODELS // 2)))
    made = settle(told.join(edges, "model").select("model", *by, base.alias("base"), "n", "edges", F.pmod("model", F.lit(parts)).alias("part")))
    found = None
    for part in [r.part for r in made.select("part").distinct().orderBy("part").collect()]:
        some = made.where(F.col("part") == part)
        models = {r.model: r for r in some.collect()}
        data = rows.join(some.select("model", "base", "edges", "n"), "model").select("model", "key", "y", "weight", F.col("base").alias("margin"), _binned(features).alias("bins"), "n")
        few, many = (data.where((F.col("n") <= TASK_ROWS) == small).drop("n") for small in (True, False))
        grown = _small_grown(few, len(features), settings)
        large = {m: r.n for m, r in models.items() if r.n > TASK_ROWS}
        if large:
            tasks = -(-sum(large.values()) // TASK_ROWS)
            dealt = settle(many.repartitionByRange(tasks, "model", "key").sortWithinPartitions("model", "key"))
            grown |= _grown(dealt, list(large), len(features), tasks, settings)
        table = [(m, [_as_row(t, models[m].edges) for t in trees]) for m, trees in grown.items()]
        trees = some.drop("n", "edges", "part").join(spark.createDataFrame(table, f"model long, trees {TREE}"), "model").drop("model")
        found = trees if found is None else found.unionByName(trees)
    return found if found is not None else spark.createDataFrame([], train.select(*by).schema.add("base", "double")).withColumn("trees", F.array().cast(TREE))


def _as_row(tree: Tree, edges: list[list[float]]) -> tuple:
    """A tree whose splits are by value."""
    cuts = [float(edges[f][b - 1]) if b < 1 << 20 else math.inf for f, b in zip(tree.feature.tolist(), tree.bin.tolist(), strict=True)]
    return tree.feature.tolist(), cuts, tree.missing_left.tolist(), tree.leaf.tolist()


def score(features: list[str]) -> Column:
    """The probability of label 1 of a row that has the features and its model's ``base`` and ``trees``; null without a model."""
    row = F.array(*[F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in features])

    def leaf(x: Column, tree: Column) -> Column:
        def down(at: Column, _: Column) -> Column:
            v = F.get(x, F.get(tree["feature"], at))
            left = F.when(v.isNull(), F.get(tree["missing_left"], at)).otherwise(v <= F.get(tree["threshold"], at))
            return 2 * at + F.when(left, 1).otherwise(2)

        return F.get(tree["leaf"], F.aggregate(F.array(*[F.lit(k) for k in range(DEPTH)]), F.lit(0), down) - NODES)

    # A lambda's variable is computed once, a Column at each place where it stands.
    margin = lambda x: F.aggregate("trees", F.col("base"), lambda sum_, tree: sum_ + leaf(x, tree))
    return 1 / (1 + F.exp(-F.get(F.transform(F.array(row), margin), 0)))
