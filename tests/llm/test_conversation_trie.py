import hashlib
import random
import re
import zlib

import pytest

from tidemark.llm import conversation_trie as op

COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def slow_paths(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            name = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            convs.setdefault(c, []).append(((turn is not None, turn or 0), name, (role, text)))
    convs = {c: [t[2] for t in sorted(s)] for c, s in convs.items()}
    out = {}
    for c in convs:
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = convs.get(c - c % 20, [])[:h] + convs[c][h:]
    return out


def slow_trie(paths):
    members = {}
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members.setdefault(tuple(path[:d]), []).append(c)
    out = []
    for node, cs in members.items():
        below = [x for x in members if x[: len(node)] == node]
        childless = lambda x: not any(len(y) == len(x) + 1 and y[: len(x)] == x for y in members)
        words = lambda x: len(re.findall(r"[^\x20\x09-\x0D]+", x[-1][1])) if x else 0
        ends = ",".join(str(c) for c in sorted(cs) if len(paths[c]) == len(node))
        out.append((
            min(cs), len(node), min(members[node[:-1]]) if node else None, len(cs),
            sum(len(y) == len(node) + 1 and y[: len(node)] == node for y in members),
            sum(map(childless, below)), sum((len(members[x]) - 1) * words(x) for x in below), hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def conversations(rnd, n):
    rows = []
    for c in range(n):
        if c % 17 == 3:
            continue
        for t in range(rnd.randint(1, 6)):
            rows.append((c, t, rnd.choice(["user", "assistant"]) if t else "system", rnd.choice(["", "a b", "a  b", "x\x1cy\nz é", "one two three"]) if t else "sys"))
    return rows


@pytest.mark.parametrize("partitions", [1, 4, 13])
def test_against_brute_force(spark, partitions):
    rnd = random.Random(11)
    rows = conversations(rnd, 130)
    rows += [(1000, 0, "user", "hi")] * 3  # repeated rows
    rows += [(1001, None, None, None), (1001, 0, "user", None), (1001, None, "user", "b"), (1002, 5, None, "lang " * 50_000)]
    rows += [(None, 0, "user", "nobody"), (2000, 1, "user", "no base"), (-7, 0, "user", "below zero")]
    expected = slow_trie(slow_paths([r for r in rows if r[0] is None or r[0] >= 0]))
    df = spark.createDataFrame([r for r in rows if r[0] is None or r[0] >= 0], "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS words", "'p' AS path", "2 AS name")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
        got = [tuple(r) for r in op.trie(op.grafted(op.conversations_of(df))).select(*COLUMNS).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert sorted(got, key=str) == expected


def test_hot_paths_and_small_skeletons(spark, monkeypatch):
    monkeypatch.setattr(op, "ID_BITS", 3)
    monkeypatch.setattr(op, "SKELETON_NODES", 12)  # fewer shards
    paths = {c: [("r", str(x)) for x in ([1, 2, 3] if c % 3 == 0 else [1, 2, c % 7, c % 5][: c % 5])] for c in range(150)}
    rows = [(c, [hashlib.md5(t[1].encode()).digest() for t in p], [1] * len(p)) for c, p in paths.items()]
    got = [tuple(r) for r in op.trie(spark.createDataFrame(rows, "conv_id long, path array<binary>, words array<long>")).select(*COLUMNS).collect()]
    assert sorted(got, key=str) == slow_trie(paths)


def test_empty_and_deep(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert op.trie(op.grafted(op.conversations_of(empty))).count() == 0
    deep = spark.createDataFrame([(1, 1_500)], "conv_id long, n int").selectExpr("conv_id", "explode(sequence(0, n - 1)) AS turn", "'user' AS role", "'a b c' AS text")
    both = deep.unionByName(deep.selectExpr("conv_id + 1 AS conv_id", "turn", "role", "text").where("turn < 1000"))
    turns = op.conversations_of(both)
    got = op.trie(turns.selectExpr("conv_id", "s.id AS path", "s.words AS words")).collect()
    root = next(r for r in got if r.depth == 0)
    assert len(got) == 1_501 and (root.n_convs, root.n_children, root.n_leaves, root.saved_tokens) == (2, 1, 1, 3_000)
