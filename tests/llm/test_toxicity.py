import random

import numpy as np

from tidemark.llm import toxicity as op


def corpus(n, seed=3):
    rnd = random.Random(seed)
    vocab = ["".join(rnd.choices("abcdefgh", k=5)) for _ in range(300)]
    docs, labels = [], []
    for i in range(n):
        words = rnd.choices(vocab, k=rnd.randint(20, 80))
        toxic = int(rnd.random() < 0.3)
        if toxic:
            for _ in range(3):
                words.insert(rnd.randrange(len(words)), rnd.choice(["zidiot", "zm0ron", "schelmzen", "schelmzung", "schelmzig"]))
        docs.append((i, " ".join(words)))
        labels.append((i, toxic))
    return docs, labels


def test_held_out_accuracy_and_odd_rows(spark):
    docs, labels = corpus(700)
    odd = [(9001, None), (9002, ""), (None, "abc"), (9003, "word " * 50_000 + "schelmzen zidiot schelmzig"), (5, docs[5][1])]
    df = spark.createDataFrame(docs + odd, "doc_id long, text string").selectExpr("*", "1 AS x", "0 AS fold")
    known = spark.createDataFrame([*labels, (5, labels[5][1]), (None, 1), (6, None)], "doc_id long, toxic int")
    got = op.fit(df, known).score(df).collect()
    assert len(got) == len(docs) + len(odd)
    truth = dict(labels)
    held = [r for r in got if r.doc_id in truth and __import__("zlib").crc32(str(r.doc_id).encode()) % 4 == 2]
    right = sum(r.predicted == truth[r.doc_id] for r in held)
    assert len(held) > 100 and right >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert {r.predicted for r in got if r.doc_id in (9001, 9002)} == {0}


def test_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.score for r in op.fit(docs, none).score(docs).collect()] == [0.0, 0.0]
    one = spark.createDataFrame([(1, 1), (3, 1)], "doc_id long, toxic int")
    assert op.fit(docs, one).score(docs).count() == 2
    assert op.fit(docs.limit(0), one).score(docs.limit(0)).count() == 0


def test_trees_as_arrays_score_like_the_fitted_ones(spark):
    docs, labels = corpus(400, seed=5)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    model = op.fit(df, spark.createDataFrame(labels, "doc_id long, toxic int"))
    x = {r.id: r.x for r in op.features(df, [model.lexicon]).collect()}
    want = {r.doc_id: r.score for r in model.score(df).collect()}
    at, values = model.calibration.boundaries.toArray(), model.calibration.predictions.toArray()
    got = op.judge(np.array([x[i] for i in want]), op.tree_arrays(model.trees), at, values)
    assert np.allclose(got, list(want.values()), atol=1e-9) and len(set(want.values())) > 1
    kept = sorted(r.doc_id for r in model.drop_toxic(df).collect())
    assert kept == sorted(i for i, s in want.items() if s < op.THRESHOLD)


def test_plain_words_are_described_without_searches_and_as_a_slow_version_does(monkeypatch):
    lexicon = {"idiot": 3.0, "stup*": 4.0, "fool*": 2.6, "foolish": 5.0, "ab": 2.5}
    plain = "you You idiot, IDIOT!! stupid foolish? fools, ab abc STRASSE straße été?! Ǆx ʼn 日本. (word) _x_ @b".split()
    odd = "f00l i.d.i.o.t İstanbul x² ²x ½ ١a a!b $$$ 12 b-c İ".split()

    def slow(word: str) -> tuple:
        core = op._core(word)
        letters, upper = sum(map(str.isalpha, word)), sum(map(str.isupper, word))
        z = max((lexicon.get(g, 0.0) for g in op.grams(core)), default=0.0) if core else 0.0
        marks = len(word) - letters - sum(map(str.isdigit, word))
        return (z, core in op.SECOND_PERSON, letters, upper, letters > 2 and upper == letters, marks, word.count("!") + word.count("?"), bool(op._INNER.search(word)), len(word))

    expected = [slow(w) for w in plain + odd + plain]
    searched, core = [], op._core
    monkeypatch.setattr(op, "_core", lambda word: searched.append(word) or core(word))
    known = op._Words(lexicon, most=10)
    found = known.described([w.encode() for w in plain + odd + plain])
    assert [tuple(r) for r in found] == [tuple(map(float, r)) for r in expected]
    assert set(searched) == set(odd)
    known.described([b"next"])  # beyond its bound it starts anew
    assert len(known) == 1 and len(known.rows) == known.WIDTH
