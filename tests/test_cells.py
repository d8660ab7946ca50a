import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import pyramid
from tidemark.operators.labels import first_touch

HOUR = 3_600_000_000_000


def slow_touch(d, ticks):
    key, coin, t0, horizon, upper, lower = d
    inside = sorted((t, s, p) for c, t, s, p in ticks if c == coin and t0 < t <= t0 + horizon)
    for t, _, p in inside:
        if p >= upper:
            return (key, 1, t, p)
        if p <= lower:
            return (key, -1, t, p)
    return (key, 0, t0 + horizon, inside[-1][2]) if inside else (key, None, None, None)


def walk(rnd, n, span):
    px = {"a": 100.0, "b": 10.0}
    rows = []
    for k in range(n):
        coin = rnd.choice("aab")
        px[coin] *= 1 + rnd.gauss(0, 0.003)
        rows.append((coin, rnd.randrange(-span, span), k, px[coin]))
    return rows


@pytest.mark.parametrize("base", [7, 60, 1000])
def test_first_touches_of_many_horizons_and_barriers(spark, base):
    rnd = random.Random(base)
    ticks = walk(rnd, 500, 4000)
    ticks += [("a", 100, 900, 250.0), ("a", 100, 901, 1.0), ("b", 0, 902, 10.0)]  # ties in time: the sequence decides
    decisions = []
    for k in range(250):
        coin, t0, horizon = rnd.choice("abc"), rnd.randrange(-4200, 4000), rnd.choice([1, 13, 90, 700, 2500])
        mid = {"a": 100.0, "b": 10.0, "c": 1.0}[coin] * rnd.uniform(0.9, 1.1)
        half = rnd.choice([0.0, 0.01, 0.1, 5.0])
        decisions.append((f"k{k}", coin, t0, horizon, mid * (1 + half), mid * (1 - half)))
    d = spark.createDataFrame(decisions, "key string, coin string, t0 long, horizon long, upper double, lower double")
    t = spark.createDataFrame(ticks, "coin string, t_event long, seq long, px double")
    got = pyramid.first_touches(d, t, 2500, base).select("key", "outcome", "t_end", "price_end").collect()
    assert sorted(tuple(r) for r in got) == sorted(slow_touch(x, ticks) for x in decisions)
    assert {r.outcome for r in got} == {1, -1, 0, None}


def test_cover_is_whole_disjoint_and_logarithmic(spark):
    rnd = random.Random(2)
    spans = [(a, a + rnd.choice([0, 1, 2, 5, 33, 100, 127])) for a in (rnd.randrange(-300, 300) for _ in range(200))]
    df = spark.createDataFrame(spans, "a long, z long")
    for r in df.select("a", "z", pyramid.cover(F.col("a"), F.col("z"), 7).alias("c")).collect():
        held = [b for part in r.c for b in range(part.bucket << part.level, (part.bucket + 1) << part.level)]
        assert sorted(held) == list(range(r.a, r.z)) and len(r.c) <= 14


def test_cells_equal_single_labellings(spark):
    from tidemark.plans import cells, research

    sf = "/root/testdata/sf0.001"
    one = research._decisions(spark, sf)
    ticks = research._ticks(spark, sf)
    whole = pyramid.first_touches(one.withColumn("horizon", F.lit(4 * HOUR)), ticks, 24 * HOUR)
    columns = ["key", "outcome", "t_end", "price_end"]
    assert sorted(map(tuple, whole.select(*columns).collect())) == sorted(map(tuple, first_touch(one, ticks, 4 * HOUR).select(*columns).collect()))
    rows = cells.labelled_cells(spark, sf).where("horizon = 4 and k = 2.0")
    own = research.scored_of(spark, sf)
    pick = lambda df: sorted(map(tuple, df.select("coin", "t_open", "y", "weight", "map_seq").collect()), key=str)
    assert pick(rows) == pick(own) and rows.count() > 0


CELL = (("coin", "c"), ("horizon", 1), ("k", 1.0), ("alpha", 1.0), ("n", 9), ("z", 3.0), ("beats", True), ("p_value", 0.005), ("hit_rate", 0.7), ("threshold", 0.56))


def grid(spark, change=lambda alpha, k: {}):
    from tidemark.plans.cells import CELL as SCHEMA

    rows = [tuple((dict(CELL) | {"alpha": a, "k": float(k)} | change(a, k)).values()) for a in (1.0, 2.0) for k in range(6)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize(
    ("change", "failed"),
    [
        (lambda a, k: {}, set()),
        (lambda a, k: {"beats": a == 2.0 or k < 4}, set()),  # 4 of 6 are just enough
        (lambda a, k: {"beats": a == 2.0 or k < 3}, {"beats_baseline"}),
        (lambda a, k: {"beats": a == 1.0 and k < 5, "p_value": 0.5 if k else 0.005}, {"kernel_wins", "kernel_clears", "collapses"}),
        (lambda a, k: {"p_value": None if a == 1.0 and k == 2 else 0.001}, {"collapses"}),
        (lambda a, k: {"hit_rate": 0.5 if a == 1.0 and k == 2 else 0.7}, {"clears_cost"}),
        (lambda a, k: {"hit_rate": None if a == 2.0 and k == 2 else 0.7, "z": 3.0 + a}, {"kernel_clears"}),
        (lambda a, k: {"beats": False}, {"beats_baseline", "kernel_wins", "collapses", "clears_cost", "kernel_clears"}),
    ],
)
def test_the_gate_reads_any_evaluators_cells(spark, change, failed):
    from tidemark.plans import cells

    r = cells.gate_cells(spark, "nowhere", evaluate=lambda *_: grid(spark, change)).first().asDict()
    assert {k for k in ("beats_baseline", "kernel_wins", "collapses", "clears_cost", "kernel_clears") if not r[k]} == failed
    assert r["passed"] == (not failed)


def test_the_gate_over_no_cells(spark):
    from tidemark.plans import cells

    r = cells.decide(grid(spark).limit(0)).collect()
    assert len(r) == 1 and r[0].cells == 0 and not r[0].passed and r[0].winning_alpha is None
