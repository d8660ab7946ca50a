import math
import random
from zlib import crc32

import numpy as np
import pytest

from tidemark.llm import class_lm as op


def corpus(n=300, seed=4):
    rnd = random.Random(seed)
    nouns, verbs = [f"noun{i}" for i in range(12)], [f"verb{i}." for i in range(12)]
    rows = []
    for i in range(n):
        out = []
        for _ in range(rnd.randint(0, 30)):
            out += ["The" if rnd.random() < 0.8 else f"rare{rnd.randrange(200)}", rnd.choice(nouns), rnd.choice(verbs)]
        rows.append((i, " ".join(out)))
    return rows


def tokens_of(text):
    return [w for w in (text or "").encode().lower().split()] + [b"\n"]


def slow_score(model, count, tokens):
    """P(class | class before) * P(word | class), token by token, from the model's classes and counts alone."""
    units, before, total = op._Units(model.clustered), model.of[-1], 0.0
    for w in tokens:
        c = model.of[units[w]]
        if w == op.END:
            emit = 1.0
        elif units[w] < len(model.clustered):
            emit = count[w] / model.class_size[c]
        else:
            emit = (count.get(w, 0) + 0.1) / (model.class_size[c] + 0.1 * (model.types[c] + 1))
        total += model.transition[before, c] + math.log10(emit)
        before = c
    return total


@pytest.mark.parametrize("cluster,known,first", [(1e-2, 1e-3, 1e-2), (1e-3, 0.05, 3e-2), (0.2, 0.2, 0.2)])
def test_counts_base_and_better_held_out_score(spark, cluster, known, first):
    rows = corpus() + [(900, None), (901, ""), (902, "only unseen words zzz"), (None, "the noun1"), (7, "twice the"), (904, "the " * 60_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS row", "2 AS n")
    model = op.fit(df, cluster_share=cluster, known_share=known, first_share=first, min_count=2, classes=8, sweeps=3)
    got = op.score(model, df).collect()
    assert len(got) == len(rows)
    count = {}
    for i, t in rows:
        if crc32(("" if i is None else str(i)).encode()) % 10:
            for w in tokens_of(t):
                count[w] = count.get(w, 0) + 1
    n, v = sum(count.values()), len(count)
    expected = {}
    for i, t in rows:
        w = tokens_of(t)
        expected.setdefault(i, set()).add((len(w), sum(x in count for x in w), round(sum(math.log10((count.get(x, 0) + 0.1) / (n + 0.1 * (v + 1))) for x in w), 6)))
    slow = {}
    for i, t in rows:
        slow.setdefault(i, set()).add(round(slow_score(model, count, tokens_of(t)), 5))
    assert all(x <= y for x, y in zip(model.trace, model.trace[1:]))  # the likelihood never falls
    for r in got:
        assert (r.n_tokens, r.n_known, round(r.base_score, 6)) in expected[r.doc_id]
        assert round(r.score, 5) in slow[r.doc_id]
        assert r.train_tokens == n and r.held_out == (crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 10 == 0)
    if cluster < 0.1:
        held = [r for r in got if r.held_out and r.n_tokens > 5]
        assert sum(r.score for r in held) > 0.8 * sum(r.base_score for r in held)


def test_probabilities_sum_to_one(spark):
    rows = corpus(120)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    model = op.fit(df, cluster_share=1e-3, known_share=1e-3, first_share=2e-2, min_count=2, classes=8, sweeps=2)
    assert np.allclose((10**model.transition).sum(axis=1), 1)
    count = {bytes(r.token): r.n for r in model.counts.collect()}
    units = op._Units(model.clustered)
    total = np.zeros(len(model.class_size))
    for w, n in count.items():
        c = model.of[units[w]]
        plain = units[w] < len(model.clustered) or w == op.END
        total[c] += n / model.class_size[c] if plain else (n + 0.1) / (model.class_size[c] + 0.1 * (model.types[c] + 1))
    for c in range(8, 8 + op.SHAPES):  # each shape class keeps the share of one unseen word
        total[c] += 0.1 / (model.class_size[c] + 0.1 * (model.types[c] + 1))
    used = model.class_size > 0
    assert np.allclose(total[used], 1)


@pytest.mark.parametrize("n", [4, 5])
def test_best_class_against_the_likelihood_itself(n):
    rnd = np.random.default_rng(0)
    w, k = 12, 5
    pairs = rnd.integers(0, 9, (w, w)) * rnd.integers(0, 2, (w, w))

    def likelihood(of):
        m = np.zeros((k, k))
        np.add.at(m, (of[:, None].repeat(w, 1), of[None, :].repeat(w, 0)), pairs)
        return op._xlogx(m).sum() - op._xlogx(m.sum(0)).sum() - op._xlogx(m.sum(1)).sum(), m

    # Of five classes a word may move to the first four; words in the fifth stand for rarer ones in their shape.
    of = np.arange(w) % k
    base, m = likelihood(of)
    for u in range(w):
        left, right = np.zeros(k), np.zeros(k)
        np.add.at(left, of, pairs[:, u])
        np.add.at(right, of, pairs[u])
        values = [likelihood(np.where(np.arange(w) == u, c, of))[0] for c in range(n)]
        best, gain = op.best_class(m, of[u], left, right, pairs[u, u], n)
        assert values[best] == pytest.approx(max(values)) and gain == pytest.approx(max(values) - base, abs=1e-6)


def test_exchange_beats_no_sweeps_and_keeps_its_classes(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    held = {}
    for sweeps in (0, 4):
        model = op.fit(docs, first_share=5e-4, min_count=3, classes=24, sweeps=sweeps)
        held[sweeps] = op.score(model, docs).where("held_out").selectExpr("sum(score) / sum(n_tokens) AS x").first().x
    assert held[4] > held[0]
    used = np.bincount(model.of[: len(model.clustered)], minlength=24)[:24]
    assert (used > 0).sum() >= 20 and used.max() < 0.5 * used.sum()


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert op.score(op.fit(df), df).count() == 0
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert op.score(op.fit(df), one).count() == 1


def test_units_keep_no_word_that_is_not_listed():
    units = op._Units([b"a", b"b"])
    others = [f"w{i}".encode() for i in range(1000)]
    assert [units[w] for w in others] == [2 + op.shape(w) for w in others]
    assert (units[b"a"], units[b"b"], units[op.END], len(units)) == (0, 1, 2 + op.SHAPES, 3)


def test_pairs_of_units_are_counted_as_one_number(spark):
    texts = spark.createDataFrame([("a b a b zz",), ("",), (None,), ("zz A",)], "text string")
    pairs = op._pairs(texts, [b"a", b"b"])
    zz, end = 2 + op.shape(b"zz"), 2 + op.SHAPES
    expected = {(end, 0): 1, (0, 1): 2, (1, 0): 1, (1, zz): 1, (zz, end): 1, (end, end): 2, (end, zz): 1, (zz, 0): 1, (0, end): 1}
    assert {(r.a, r.b): r.n for r in pairs.collect()} == expected
    assert "hashpartitioning(code" in pairs._jdf.queryExecution().executedPlan().toString()


def test_long_tables_are_kept_by_column_and_distinct_codes_summed_once(spark):
    df = spark.createDataFrame(corpus(60), "doc_id long, text string")
    assert op.fit(df, min_count=2, sweeps=0).counts.inputFiles()  # files of columns, not a checkpoint's rows
    plan = op._pairs(df.select("text"), [b"the"])._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" not in plan[plan.index("Exchange") :]


def test_rows_scored_in_one_piece_keep_their_own_sums(spark):
    rows = [(i, t) for i, (_, t) in enumerate(corpus(80, seed=9))] + [(500, ""), (501, None), (502, "the zzz zzz yyy"), (503, "the " * 210_000), (504, "zzz")]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    model = op.fit(df, cluster_share=1e-2, known_share=0.05, first_share=5e-2, min_count=2, classes=6, sweeps=1)
    together = {r.doc_id: r for r in op.score(model, df).collect()}
    alone = {r.doc_id: r for r in op.score(model, df.repartition(len(rows) * 2)).collect()}
    assert len(together) == len(rows)
    for i, r in together.items():
        assert (r.n_tokens, r.n_known) == (alone[i].n_tokens, alone[i].n_known)
        assert r.score == pytest.approx(alone[i].score, abs=1e-6) and r.base_score == pytest.approx(alone[i].base_score, abs=1e-6)
