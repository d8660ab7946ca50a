import math
import re
from collections import Counter

from tidemark.llm import license_scan as op

ROWS = [
    (1, "a/LICENSE", "Some words\nReleased under the MIT License.\nmore"),
    (2, "a/b/x.py", "# nothing here"),
    (3, "a/b/y.py", "# Licensed under the Apache License, Version 2.0.\ncode"),
    (4, "a/b/c/COPYING.txt", "This work is licensed under the\nGNU General Public License, version 3."),
    (5, "a/b/c/d/e/z", None),
    (6, "q/z", "the license of this plot is a free gift of nobody at all and nothing else"),
    (7, "top", ""),
    (8, None, "Licensed under CC BY-NC 4.0."),
    (9, None, "nothing"),
    (2, "a/b/x.py", "# nothing here"),
    (10, "z/LICENSE", "no licence text in here"),
    (11, "z/k", "word " * 50_000),
    (12, "a/b/LICENSE-note", "Licensed under CC BY-NC 4.0.\nLicensed under the Apache License, Version 2.0."),
    (13, "a/b/c2/w", "x"),
    (14, "a/k", "x"),
    (15, "w/wrapped.c", "int x;\n/* This program is free software: you can redistribute it\n * and/or modify it under the terms of the GNU General Public\n * License as published by the Free Software Foundation, either version 3\n * of the License, or (at your option) any later version. */\nint y;"),
    (16, "w/inside.txt", "tall grass and more of it " * 20 + "licensed under the apache license, version 2.0. " + "and so on it goes " * 30),
    (17, "w/all.txt", "(c) someone. All rights reserved."),
]


def slow(rows, similarity=op.SIMILARITY):
    templates = [(n, op.terms_of(t)) for n, t in op.TEMPLATES]
    vocabulary = {t for _, c in templates for t in c}
    n = len(rows)
    df = Counter(t for _, _, x in rows for t in set(op.terms_of(x or "")) & vocabulary)
    idf = lambda t: math.log((n + 1) / (df[t] + 1)) + 1
    vector = lambda terms: {t: k * idf(t) for t, k in Counter(terms).items()}
    own = []
    for _, _, x in rows:
        terms, best = op.terms_of(x or ""), None
        for i, term in enumerate(terms):
            for name, c in templates:
                for at in [k for k, t in enumerate(c) if t == term and op.is_mark(t)]:
                    start = max(0, i - at)
                    v, w = vector(terms[start : start + len(c)]), vector(c)
                    score = round(sum(v[t] * w[t] for t in v if t in w) / math.sqrt(sum(a * a for a in v.values()) * sum(a * a for a in w.values())), 6)
                    if score >= similarity:
                        best = min(best or (1, ""), (-score, name))
        own.append(best)
    dirs = {}
    for (_, p, _), b in zip(rows, own, strict=True):
        if p and b and re.match(op.LICENSE_FILE.replace("(?i)", ""), p.split("/")[-1], re.I):
            d = "/".join(p.split("/")[:-1])
            dirs[d] = min(dirs.get(d, (1, "", "")), (b[0], p.split("/")[-1], b[1]))
    out = []
    for (i, p, _), b in zip(rows, own, strict=True):
        if b:
            out.append((i, p, b[1], round(-b[0], 4), b[1], "own", None))
            continue
        parts = p.split("/")[:-1] if p else None
        d = next((x for k in range(len(parts), -1, -1) if (x := "/".join(parts[:k])) in dirs), None) if p else None
        out.append((i, p, None, None, dirs[d][2] if d is not None else None, "none" if d is None else "inherited", d))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, path string, text string").selectExpr("*", "1 AS term", "2 AS row")
    got = sorted((tuple(r[:3]) + (None if r.own_score is None else round(r.own_score, 4),) + tuple(r[4:]) for r in op.scan(df).collect()), key=str)
    assert got == slow(ROWS)
    assert ("inherited", "MIT") in {(r[5], r[4]) for r in got} and ("inherited", "GPL-3.0") in {(r[5], r[4]) for r in got}


def test_wrapped_and_inside_paragraphs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, path string, text string")
    own = {r.id: r.own_license for r in op.scan(df).collect()}
    assert (own[15], own[16], own[17]) == ("GPL-3.0", "Apache-2.0", "LicenseRef-All-Rights-Reserved")


def test_documents_and_empty(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    paths = op.document_paths(docs)
    rows = [tuple(r) for r in paths.collect()]
    got = sorted((tuple(r[:3]) + (None if r.own_score is None else round(r.own_score, 4),) + tuple(r[4:]) for r in op.scan(paths).collect()), key=str)
    assert got == slow(rows)
    assert "inherited" in {r[5] for r in got}
    assert op.scan(paths.limit(0)).count() == 0
