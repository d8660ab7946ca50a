import random

import numpy as np
import pytest

from tidemark.llm import jaccard_join as op


def slow_set(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate({c: " " for c in range(9, 14)})
    w = [x for x in text.split(" ") if x]
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def slow_components(rows):
    sets = {}
    for i, t in rows:
        if i is not None:
            sets.setdefault(i, []).append(slow_set(t))
    label = {i: i for i in sets}

    def linked(a, b):
        return any(x and y and 100 * len(x & y) >= 80 * len(x | y) for x in sets[a] for y in sets[b])

    links = [(a, b) for a in sets for b in sets if a < b and linked(a, b)]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            if label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    return label, links


def copy_of(rnd, words, edits, vocab):
    words = list(words)
    for _ in range(edits):
        at = rnd.randrange(len(words))
        words[at : at + rnd.choice([0, 1])] = [rnd.choice(vocab)]
    return words


def corpus(seed):
    rnd = random.Random(seed)
    vocab = ["".join(rnd.choices("abcdeéÉXY", k=5)) for _ in range(3000)]
    passages = [rnd.choices(vocab, k=60) for _ in range(3)]
    texts = []
    for _ in range(30):  # families of near copies at all distances from the threshold
        base = rnd.choices(vocab, k=rnd.choice([6, 9, 30, 80, 200]))
        for _ in range(rnd.choice([1, 2, 4])):
            texts.append(copy_of(rnd, base, rnd.randint(0, max(1, len(base) // 40)), vocab))
    for _ in range(40):  # documents that are little but a passage, and some that are more
        texts.append(rnd.choice(passages) + rnd.choices(vocab, k=rnd.choice([0, 1, 2, 5, 8, 12, 60])))
    base = rnd.choices(vocab, k=150)
    texts += [copy_of(rnd, base, rnd.randint(1, 4), vocab) for _ in range(60)]  # a large family
    rows = [(i, rnd.choice([" ", "\n", "\t "]).join(t)) for i, t in enumerate(texts)]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize(("group", "queries", "hot", "ids"), [(64, 4096, 20_000, 1_000_000), (4, 3, 5, 10)])
def test_against_brute_force(spark, monkeypatch, group, queries, hot, ids):
    for name, value in (("GROUP", group), ("QUERIES", queries), ("HOT", hot), ("BROADCAST_IDS", ids)):
        monkeypatch.setattr(op, name, value)
    rows = corpus(group)
    rows += [(900, None), (901, ""), (902, " \n"), (903, "one"), (904, "ONE\t"), (905, "one two"), (906, "one two three four five"), (907, "one two three four"), (None, "one"), (None, None)]
    rows += [rows[0], (rows[1][0], rows[7][1]), (rows[2][0], "another text under an id that is there"), (908, "Another Text under an id that is there"), (909, "lang " * 200_000), (910, " ".join(map(str, range(60_000))))]
    rows.append((911, " ".join(map(str, range(300, 60_000)))))
    expected, links = slow_components(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 AS n", "2 AS rep", "3 AS id_")
    got = op.similar_sets(df).collect()
    assert len(got) == len(rows) and len(links) > 100
    assert {(r.doc_id, r.component_id) for r in got if r.doc_id is not None} == set(expected.items())
    assert all(r.component_id is None for r in got if r.doc_id is None)
    sizes = {}
    for i, t in rows:
        sizes.setdefault(i, []).append(len(slow_set(t)))
    assert {i: sorted(r.n_shingles for r in got if r.doc_id == i) for i in sizes} == {i: sorted(n) for i, n in sizes.items()}
    assert op.similar_sets(df.limit(0)).count() == 0


def test_groups_are_opened_by_their_bound():
    rnd = np.random.default_rng(2)
    base = np.unique(rnd.integers(0, 1 << 60, 100).astype(np.uint64))
    near = [np.unique(np.r_[base[k:], rnd.integers(0, 1 << 60, k).astype(np.uint64)]) for k in range(10)]
    group = op.TokenGroup(list(range(10)), list(range(10)), near)
    assert not group.similar(np.unique(rnd.integers(0, 1 << 60, 100).astype(np.uint64))).any() and group.opened == 0
    found = group.similar(base)
    assert group.opened == 1
    assert found.tolist() == [100 * len(np.intersect1d(base, s)) >= 80 * len(np.union1d(base, s)) for s in near]
    assert len(group.inner_links()) == 9


@pytest.mark.parametrize("n", [1, 2, 4, 5, 9, 10, 99, 1000])
def test_prefix_holds_every_link(n):
    least = next(k for k in range(n + 1) if 100 * k >= 80 * n)  # of an overlap that can reach 0.8
    assert op.prefix_size(n) == n - least + 1
