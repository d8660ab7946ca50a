import random
import re

import pytest

from tidemark.llm import mixture as op


def slow_targets(sizes, epochs=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(names)}
    total, target, free = float(sum(sizes.values())), {}, set(names)
    while free:
        left = total - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > epochs * sizes[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = float(epochs * sizes[s])
        free -= over
    return target


def rows_of(seed, n=400):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        source = rnd.choice(["hot"] * 5 + ["a", "B", "é", "z", "", None, "tiny"] if i % 40 else ["tiny"])
        words = " ".join(rnd.choices(["word", "x1", "$$$", "é e"], k=rnd.choice([0, 1, 5, 40])))
        rows.append((i, rnd.choice([words, words + "\n", "\t" + words, None]) if i % 7 == 0 else words, source))
    return rows


@pytest.mark.parametrize("seed,buckets", [(1, 4096), (2, 4), (3, 1)])
def test_targets_and_taken(spark, seed, buckets):
    rows = rows_of(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 AS size", "2 AS src")
    got = op.mix(df, buckets=buckets).collect()
    again = op.mix(df.repartition(3), buckets=64, range_rows=5).collect()
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _ in rows}
    sums = {}
    for i, _, s in rows:
        sums[s] = sums.get(s, 0) + size[i]
    expected = slow_targets(sums)
    assert sum(expected.values()) == pytest.approx(sum(sums.values()))
    assert sorted(r.doc_id for r in got) == list(range(len(rows)))
    assert {r.doc_id: r.taken for r in got} == {r.doc_id: r.taken for r in again}
    taken, largest = {}, {}
    for r in got:
        assert r["size"] == size[r.doc_id] and r.source_size == sums[r.source]
        assert r.target == pytest.approx(expected[r.source])
        assert r.taken <= 3 * r["size"] and (r["size"] == 0 or r.taken % r["size"] == 0)
        taken[r.source] = taken.get(r.source, 0) + r.taken
        largest[r.source] = max(largest.get(r.source, 0), r["size"])
    for s in taken:
        assert abs(taken[s] - expected[s]) <= largest[s] / 2 + 1e-6
        epochs = {r.epochs for r in got if r.source == s and r["size"]}
        assert max(epochs, default=0) - min(epochs, default=0) <= 1  # complete epochs come first


def test_quality_raises_the_chance(spark):
    rows = [(i, ("word " * 10 if i % 2 else "w%$# " * 10), "s") for i in range(2000)] + [(9999, "word " * 60_000, "t")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = [r for r in op.mix(df, weights=(1, 7)).collect() if r.doc_id < 2000]
    cut = min(r.epochs for r in got)
    extra = [r for r in got if r.epochs > cut]
    assert 0 < len(extra) < len(got)
    assert sum(r.doc_id % 2 for r in extra) > 0.6 * len(extra)


def test_empty_table_and_empty_texts(spark):
    schema = "doc_id long, text string, source string"
    assert op.mix(spark.createDataFrame([], schema)).count() == 0
    got = op.mix(spark.createDataFrame([(1, None, "a"), (2, "", None), (2, "", None)], schema)).collect()
    assert len(got) == 3 and all(r.taken == 0 for r in got)


def test_hot_ranges_are_cut_until_few_rows_are_sorted(spark):
    """Numbers have the least weight, so nearly all keys lie in the last ranges; repeated rows share one key."""
    rows = [(i, "1234567 " * (i % 9), "hot") for i in range(3000)] + [(None, "99 " * 7, "hot")] * 500 + [(5, "7 " * 3, "cold")] * 400
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    key = lambda r: str((r.doc_id, r.source, r["size"], r.taken))
    few, many = (sorted(op.mix(df, weights=(1, 3), buckets=b, range_rows=n).collect(), key=key) for b, n in ((16, 3), (4096, 10**6)))
    assert few == many and len(few) == len(rows)
    for source in ("hot", "cold"):
        got = [r for r in few if r.source == source]
        assert abs(sum(r.taken for r in got) - got[0].target) <= 4.5
