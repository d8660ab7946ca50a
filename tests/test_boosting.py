import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import boosting as op

FEATURES = ["a", "b", "c", "d"]


def planted(rnd, n, odd):
    """Label 1 is likely where a is large, or b is missing (odd groups: where c is small); d is noise."""
    rows = []
    for k in range(n):
        a, b, c, d = rnd.random(), None if rnd.random() < 0.3 else rnd.randrange(5), rnd.gauss(0, 1), float("nan") if rnd.random() < 0.1 else rnd.random()
        p = (0.9 if c < -0.3 else 0.2) if odd else (0.9 if a > 0.7 or b is None else 0.15)
        rows.append((k, a, b, c, d, int(rnd.random() < p), round(rnd.uniform(0.2, 1), 3)))
    return rows


def slow_trees(rows, edges, settings):
    """Trees of one model, grown node by node with plain loops."""
    none = lambda v: v is None or v != v
    bins = [[0 if none(v) else 1 + sum(e < v for e in edges[f]) for f, v in enumerate(r[1:5])] for r in rows]
    y, w = [r[5] for r in rows], [r[6] for r in rows]
    up = sum(a * b for a, b in zip(y, w))
    margin = [math.log(up / (sum(w) - up))] * len(rows)
    keys = np.array([r[0] for r in rows])
    trees = []
    for t in range(settings.trees):
        seen = [k for k, s in enumerate(op.picked_rows(keys, t, settings).tolist()) if s]
        g, h = op.derivatives(np.array(margin), np.array(y, float), np.array(w))
        features = op.picked_features(len(FEATURES), t, settings).tolist()
        tree, held = op.Tree(), {0: seen}
        for node in range(op.NODES):
            mine = held[node]
            sums = lambda ks: (float(sum(g[k].item() for k in ks)) / 2**30, float(sum(h[k].item() for k in ks)) / 2**30)  # noqa: E731, B023
            worth = lambda s: s[0] ** 2 / (s[1] + settings.ridge)
            value = lambda s: -settings.rate * s[0] / (s[1] + settings.ridge)
            best, split = 0, None
            for f in features:
                for b in range(1, settings.bins):
                    for missing_left in (True, False):
                        left = [k for k in mine if (missing_left if bins[k][f] == 0 else bins[k][f] <= b)]
                        if len(left) < settings.least_rows or len(mine) - len(left) < settings.least_rows:
                            continue
                        inside = set(left)
                        right = [k for k in mine if k not in inside]
                        gain = round(worth(sums(left)) + worth(sums(right)) - worth(sums(mine)), 9)
                        if gain > best:
                            best, split = gain, (f, b, missing_left, left, right)
            f, b, missing_left, left, right = split or (0, 1 << 20, True, mine, [])
            tree.feature[node], tree.bin[node], tree.missing_left[node] = f, b, missing_left
            if 2 * node + 1 < op.NODES:
                held[2 * node + 1], held[2 * node + 2] = left, right
            else:
                at = 2 * node + 1 - op.NODES
                tree.leaf[at], tree.leaf[at + 1] = (value(sums(left)), value(sums(right))) if split else (value(sums(mine)),) * 2
        margin = (np.array(margin) + tree.values(np.array(bins))).tolist()
        trees.append(tree)
    return trees


@pytest.fixture(scope="module")
def table(spark):
    rnd = random.Random(9)
    groups = {"even": planted(rnd, 400, False), "odd": planted(rnd, 600, True), "few": planted(rnd, 199, False), "one class": [(*r[:5], 1, r[6]) for r in planted(rnd, 300, True)]}
    rows = [(g, *r) for g, rs in groups.items() for r in rs]
    df = spark.createDataFrame(rows, "coin string, key long, a double, b int, c double, d double, y int, weight double")
    return groups, df


@pytest.mark.parametrize(("partitions", "task_rows"), [(1, 500), (4, 90), (4, 20_000)])
def test_trees_equal_those_grown_node_by_node(spark, table, monkeypatch, partitions, task_rows):
    groups, df = table
    monkeypatch.setattr(op, "KEEP", 2)
    monkeypatch.setattr(op, "TASK_ROWS", task_rows)  # one model in a task and one in many, both in many, both in tasks
    settings = op.Settings(trees=3, bins=6, least_rows=20, rate=0.3, seed=partitions)
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        got = {r.coin: r for r in op.fit(df, ["coin"], FEATURES, settings).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert set(got) == {"even", "odd"}
    edges = {r.coin: r.edges for r in op.edges_of(df.withColumn("model", F.xxhash64("coin")), FEATURES, 6).join(df.select(F.xxhash64("coin").alias("model"), "coin").distinct(), "model").collect()}
    for coin in got:
        for tree, slow in zip(got[coin].trees, slow_trees(groups[coin], edges[coin], settings), strict=True):
            expected = op._as_row(slow, edges[coin])
            assert (tree.feature, tree.threshold, tree.missing_left) == expected[:3]
            assert tree.leaf == pytest.approx(expected[3], abs=1e-12)


def test_planted_signals_are_found_and_missing_values_take_a_side(spark, table):
    _, df = table
    models = op.fit(df, ["coin"], FEATURES, op.Settings(trees=25, rate=0.2, bins=16))
    fresh = [("even", 0.9, 1, 0.0, 0.5), ("even", 0.1, None, 0.0, 0.5), ("even", 0.1, 1, 0.0, None), ("odd", 0.9, 1, -1.0, 0.5), ("odd", 0.9, None, 1.0, 0.5), ("few", 0.9, 1, 0.0, 0.5)]
    test = spark.createDataFrame(fresh, "coin string, a double, b int, c double, d double").join(models, "coin", "left")
    p = {(r.coin, r.a, r.b, r.c): r.p for r in test.withColumn("p", op.score(FEATURES)).collect()}
    assert p["even", 0.9, 1, 0.0] > 0.7 and p["even", 0.1, None, 0.0] > 0.7 and p["even", 0.1, 1, 0.0] < 0.35
    assert p["odd", 0.9, 1, -1.0] > 0.7 and p["odd", 0.9, None, 1.0] < 0.4 and p["few", 0.9, 1, 0.0] is None


def test_column_score_walks_trees_as_tasks_do(spark, table):
    groups, df = table
    settings = op.Settings(trees=4, bins=8, rate=0.3)
    model = op.fit(df.where("coin = 'odd'"), ["coin"], FEATURES, settings)
    edges = op.edges_of(df.where("coin = 'odd'").withColumn("model", F.lit(1)), FEATURES, 8).first().edges
    slow = slow_trees(groups["odd"], edges, settings)
    none = lambda v: v is None or v != v
    bins = np.array([[0 if none(v) else 1 + sum(e < v for e in edges[f]) for f, v in enumerate(r[1:5])] for r in groups["odd"]])
    margin = model.first().base + sum(t.values(bins) for t in slow)
    got = {r.key: r.p for r in df.where("coin = 'odd'").join(model, "coin").select("key", op.score(FEATURES).alias("p")).collect()}
    assert [got[r[0]] for r in groups["odd"]] == pytest.approx((1 / (1 + np.exp(-margin))).tolist(), abs=1e-9)
