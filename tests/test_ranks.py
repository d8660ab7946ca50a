import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import ranks


@pytest.mark.parametrize("partitions", [1, 3, 11])
def test_ranks_of_a_hot_key_by_ranges(spark, partitions):
    rnd = random.Random(partitions)
    rows = [(rnd.choice(["hot"] * 8 + ["b", "c", None]), rnd.choice([None, 1.5, -2.0, *[rnd.random() for _ in range(30)]]), k) for k in range(400)]
    df = spark.createDataFrame(rows, "k string, v double, i long")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        got = ranks.ranked(df, ["k"], [F.desc("v"), F.col("i")], "place").collect()
        whole = ranks.ranked(df, [], [F.col("v").asc_nulls_last(), F.col("i")], "place").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    for key in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1] is None, -(r[1] or 0), r[2]))
        assert [r.i for r in sorted((r for r in got if r.k == key), key=lambda r: r.place)] == [r[2] for r in own]
        assert sorted(r.place for r in got if r.k == key) == list(range(len(own)))
    assert [r.i for r in sorted(whole, key=lambda r: r.place)] == [r[2] for r in sorted(rows, key=lambda r: (r[1] is None, r[1] or 0, r[2]))]
    assert ranks.ranked(df.limit(0), ["k"], [F.col("v")], "place").count() == 0


@pytest.mark.parametrize(("bins", "leaf"), [(4, 1), (16, 10), (1024, 4096)])
@pytest.mark.parametrize("kind", ["long", "double"])
def test_selection_equals_sorting(spark, bins, leaf, kind):
    rnd = random.Random(bins)
    value = (lambda: rnd.choice([5, 5, 5, -7, rnd.randrange(-(10**6), 10**6)])) if kind == "long" else (lambda: rnd.choice([0.0, 1e-9, rnd.expovariate(1), rnd.expovariate(1) * 1e6]))
    rows = [(k, value()) for k, n in (("hot", 300), ("b", 7), ("one", 1)) for _ in range(n)] + [("same", type(value())(3))] * 50 + [("none", None), ("hot", None)]
    df = spark.createDataFrame(rows, f"k string, v {kind}")
    n = F.col("n")
    got = {r.k: r for r in ranks.selected(df, ["k"], "v", {"low": F.lit(0), "mid": F.floor(n * 0.5), "high": n - 1, "beyond": n}, bins, leaf).collect()}
    assert set(got) == {"hot", "b", "one", "same"}
    for key, r in got.items():
        own = sorted(v for k, v in rows if k == key and v is not None)
        assert (r.n, r.low, r.mid, r.high, r.beyond) == (len(own), own[0], own[len(own) // 2], own[-1], None)
    assert ranks.selected(df.limit(0), ["k"], "v", {"mid": F.floor(n * 0.5)}).count() == 0
