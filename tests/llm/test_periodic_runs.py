import hashlib
import random
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import periodic_runs as op


def slow_runs(w):
    """All (start, length, period) by trying every period."""
    found = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted((s, n, q) for (s, n), q in found.items())


def slow_row(doc_id, text):
    text = (text or "").translate({c: " " for c in range(9, 14)})
    w = [x for x in text.split(" ") if x]
    n = len(w)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = slow_runs(w)
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2])) if runs else None
    gone = {x for s, m, q in runs for x in range(s + q, s + m)}
    kept = " ".join(x for i, x in enumerate(w) if i not in gone)
    listed = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    told = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *told, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def fast_runs(docs):
    pieces, first, at, mark = [], [], 1, 1000
    pieces.append([mark])
    for d in docs:
        mark += 1
        first.append(at)
        pieces.append([*d, mark])
        at += len(d) + 1
    sizes = np.array([len(d) for d in docs])
    start, end, q = op.runs(np.array([x for p in pieces for x in p]), np.array(first), sizes)
    out = [[] for _ in docs]
    for s, e, p in zip(start.tolist(), end.tolist(), q.tolist(), strict=True):
        k = int(np.searchsorted(first, s, "right")) - 1
        out[k].append((s - first[k], e - s, p))
    return [sorted(x) for x in out]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=60), min_size=1, max_size=4))
def test_runs_of_few_symbols(docs):
    assert fast_runs(docs) == [slow_runs(d) for d in docs]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=9), st.integers(1, 12)), min_size=1, max_size=6))
def test_runs_of_repeated_pieces(parts):
    doc = [x for piece, times in parts for x in piece * times]
    twice = doc * 5  # a period that holds shorter runs
    assert fast_runs([doc, twice]) == [slow_runs(doc), slow_runs(twice)]


def test_progressions_inside_a_long_period():
    piece = [0, 1] * 13 + [2] + [0] * 9 + [3, 4]
    doc = piece * 4 + piece[:7]
    assert fast_runs([doc]) == [slow_runs(doc)]
    assert (0, len(doc), len(piece)) in fast_runs([doc])[0]


def test_against_brute_force(spark):
    rnd = random.Random(3)
    rows = []
    for i in range(160):
        vocab = [f"w{x}é" for x in range(rnd.choice([2, 5, 400]))]
        rows.append((i, rnd.choice([" ", "\n", "\t  "]).join(rnd.choices(vocab, k=rnd.choice([0, 1, 5, 6, 40, 200])))))
    rows += [(1000, None), (1001, " \n"), (None, "a a a a a a a"), (None, None), (5, rows[5][1]), (5, "b " * 9), (2000, "x\x1cy " * 8), (2001, "A a " * 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 AS start", "'t' AS id")
    got = [tuple(r) for r in op.periodic_runs(df, rewrite=op.planted).collect()]
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(got, key=key) == sorted((slow_row(i, t) for i, t in rows), key=key)
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 for i in range(160))
    assert op.periodic_runs(df.limit(0), rewrite=op.planted).count() == 0


def test_long_texts(spark):
    words = [str(x) for x in range(30_000)]
    rows = [(1, "a " * 300_000), (2, " ".join(words * 5)), (3, " ".join(words))]
    got = {r.doc_id: r for r in op.periodic_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1].start, got[1].length, got[1].period, got[1].exponent_milli) == (0, 300_000, 1, 300_000_000)
    assert (got[2].start, got[2].length, got[2].period) == (0, 150_000, 30_000)
    assert got[2].collapsed_sha256 == hashlib.sha256(" ".join(words).encode()).hexdigest() == got[3].collapsed_sha256
    assert got[3].n_runs == 0 and got[3].start is None
