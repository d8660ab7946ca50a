import random

import pytest
import xxhash

from tidemark.llm import simhash_dedup as op


def slow_fingerprint(text):
    tokens = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\v\f\r":
        tokens = tokens.replace(c, " ")
    w = [x for x in tokens.split(" ") if x]
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(pairs):
    fps = {}
    for i, fp in pairs:
        if i is not None:
            fps.setdefault(i, fp)
    ids = sorted(fps)
    label = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                if bin(fps[a] ^ fps[b]).count("1") <= 3 and label[b] < label[a]:
                    label[a] = label[b]
                    changed = True
    return label


@pytest.mark.parametrize("shard_rows", [20_000, 8])
def test_against_brute_force(spark, shard_rows):
    rnd = random.Random(5)
    vocab = ["".join(rnd.choices("abcdéÉXY", k=4)) for _ in range(60)]
    rows = []
    for i in range(60):
        base = rnd.choices(vocab, k=rnd.randint(0, 80))
        for j in range(rnd.choice([1, 1, 2, 5])):
            copy = list(base)
            if j and copy:
                copy[rnd.randrange(len(copy))] = rnd.choice(vocab)
            rows.append((len(rows), " ".join(copy) + rnd.choice(["", "\n", " \x1c "])))
    rows += [(900, None), (901, ""), (902, " \n"), (903, "one"), (904, "One"), (905, "one two"), (7, rows[7][1]), (None, "one")]
    rows.append((906, "lang " * 200_000))
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 AS fp", "2 AS shard")
    got = op.near_duplicates(df, shard_rows=shard_rows).collect()
    assert len(got) == len(rows)
    slow = {(i, t): slow_fingerprint(t) for i, t in rows}
    expected = slow_components([(i, slow[i, t]) for i, t in rows])
    prints = {}
    for i, t in rows:
        prints.setdefault(i, set()).add(f"{slow[i, t]:016x}")
    for r in got:
        assert r.fingerprint in prints[r.doc_id]
        assert r.component_id == (None if r.doc_id is None else expected[r.doc_id])


def test_links_between_random_fingerprints_are_exact(spark):
    rnd = random.Random(1)
    fps = [rnd.getrandbits(64) for _ in range(150)]
    for fp in list(fps[:80]):
        for _ in range(3):
            for b in rnd.sample(range(64), rnd.randint(1, 4)):
                fp ^= 1 << b
            fps.append(fp)
    near = fps[0]
    fps += [near ^ (1 << a) ^ (1 << b) for a in range(30) for b in range(a)]  # a ball with hundreds of members
    fps = sorted(set(fps))
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    reps = spark.createDataFrame(list(zip(signed, range(len(fps)), strict=True)), "fp long, rep long")
    expected = slow_components(list(enumerate(fps)))
    for bound in (20_000, 50):
        from tidemark.llm.components import components

        links = op.near_links(reps, shard_rows=bound)
        assert links.count() <= 40 * len(fps)
        got = {r.node: r.component for r in components(links).collect()}
        assert all(got.get(i, i) == expected[i] for i in range(len(fps)))


def test_empty_and_keep_one(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert op.near_duplicates(empty).count() == 0
    df = spark.createDataFrame([(3, "a b c d"), (2, "A b c d"), (2, "A b c d"), (5, "x y z q w"), (None, "t")], "doc_id long, text string")
    kept = op.keep_one(df)
    assert kept.columns == ["doc_id", "text"]
    assert op.keep_one(empty).count() == 0
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [2, 5]
    assert kept.count() == 3


def test_components_of_a_long_chain_and_a_hub(spark):
    from tidemark.llm.components import components

    edges = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 560)] + [(7, 7), (501, 500)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 100 for i in range(100, 161))
    assert all(got[i] == 500 for i in range(500, 560))
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_keep_one_with_clashing_names_and_repeated_ids(spark):
    rows = [(1, "a b c d", 1), (1, "a b c d", 2), (1, "other words stand in here", 3), (2, "a b c d", 4), (3, "other words stand in here", 5), (4, None, 6), (5, "", 7), (None, "a b c d", 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, __out int").selectExpr("*", "1 AS __keep", "2 AS __n", "3 AS fp", "4 AS id")
    got = op.keep_one(df)
    assert got.columns == df.columns
    kept = sorted((r.doc_id if r.doc_id is not None else -1, r.text or "") for r in got.collect())
    # Both groups that id 1 is in have it as their least id, so a row of id 1 stands for each.
    assert [k for k in kept if k[0] != 1] == [(-1, "a b c d"), (4, "")]
    assert sum(k[0] == 1 for k in kept) == 1 and {r.doc_id for r in op.keep_one(df.repartition(3)).collect()} == {r.doc_id for r in got.collect()}


def test_trees_of_one_shard_find_every_link():
    import numpy as np

    rnd = np.random.default_rng(3)
    fps = rnd.integers(0, 1 << 63, 300, np.uint64)
    flips = np.uint64(1) << rnd.integers(0, 64, (3, 300)).astype(np.uint64)
    fps = np.unique(np.concatenate([fps, fps ^ flips[0], fps ^ flips[0] ^ flips[1] ^ flips[2], np.uint64(7) ^ (np.uint64(1) << np.arange(64, dtype=np.uint64))]))
    rnd.shuffle(fps)
    label = np.arange(len(fps))
    for a, b in op._tree_links(fps, np.arange(len(fps)), 3):
        for x, y in zip(a, b, strict=True):
            assert bin(int(fps[x]) ^ int(fps[y])).count("1") <= 3
            label[label == max(label[x], label[y])] = min(label[x], label[y])
    slow = slow_components(list(enumerate(map(int, fps))))
    assert {i: int(label[i]) for i in range(len(fps))} == slow
