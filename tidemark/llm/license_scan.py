"""Licence scans: sparse TF-IDF cosine to templates, then inheritance along directories. DataFrame operations only.

Units are token windows of a template's own length. Every token that is a
distinctive word of templates (a mark) anchors, for each place at which a
template has that word, the window in which the template would stand; so
notices are found in headers, in licence files, wrapped over lines, or inside a
paragraph, with at most one unit for each mark and place. Such a window is
compared with its template only: both vectors have tf * idf for each term, idf
comes from the number of all files that hold the term, and terms that no
template has weigh like unseen ones. A file's own licence is the template of the
highest cosine, at least ``SIMILARITY`` (ties: the first name).

A licence file with a licence gives it to its directory (several: the highest
cosine, then the first name). A file without one of its own inherits from the
nearest ancestor directory that has one: distinct directories are exploded to
their ancestors and equi-joined by path, and files join their directory.

Scale: texts are read twice, once for the document frequencies of the template
terms and once for the cosines. These need nothing but the row and the
templates, a parameter, whose weights are literals of the expression: no term
leaves its row and none is shuffled. Only ids, paths and licences go on, to joins
whose smaller sides are broadcast up to BROADCAST_ROWS counted rows and
shuffled beyond, where adaptive execution splits a hot directory.

Null texts have no terms, null paths inherit nothing, repeated rows are rows of
their own, an empty table gives an empty one. A very long text is one row's
arrays: its tokens, and a window for each mark and place. Extra columns,
whatever their names, are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, small

SIMILARITY = 0.6

#: Short notices of common licences, by SPDX name.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Released to the public domain under CC0 1.0."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("LicenseRef-All-Rights-Reserved", "All rights reserved."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]
#: Template words that are common words of some language (mit: German), so they anchor no window.
_COMMON = frozenset("a all and any are as at by can charge code conditions copy distribute documentation domain either fee file files following for form forms foundation free general granted hereby in international into is it later may met mit modification modify no not obtaining of option or permission permitted person program provided public published purpose redistribute released rights source subject terms that the this to under use version with without work you".split())
TOKEN = r"[a-z0-9]+(?:[.][0-9]+)*"
#: Names of licence files, without their endings.
LICENSE_FILE = r"(?i)^(licen[sc]es?|copying|copyright|unlicen[sc]e|notice)([._-].*)?$"


def terms_of(text: str) -> list[str]:
    """A template's terms in order; the same rule as for texts."""
    return re.findall(TOKEN, text.lower())


def is_mark(term: str) -> bool:
    """Whether a template term anchors windows: it is no common word and no number."""
    return term not in _COMMON and not term.replace(".", "").isdigit()


def _tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def _literal(values: list) -> Column:
    return F.array(*[F.lit(v) for v in values])


def own_license(tokens: Column, templates: list[tuple[str, str]], df: dict[str, int], n: int, similarity: float) -> Column:
    """``struct(neg, license)`` of the best template of a row's ``tokens``, or null; ``neg`` is the negative cosine."""
    parsed = [terms_of(text) for _, text in templates]
    vocabulary = sorted({t for p in parsed for t in p})
    place = {t: i for i, t in enumerate(vocabulary)}
    idf = [math.log((n + 1.0) / (df.get(t, 0) + 1.0)) + 1.0 for t in vocabulary]
    weights = []  # of each template, by the place in the vocabulary: what one token adds to the dot product; the first is no term of it
    for p in parsed:
        w = {t: k * idf[place[t]] for t, k in Counter(p).items()}
        norm = math.sqrt(sum(x * x for x in w.values())) or 1.0
        weights.append([0.0, *(w.get(t, 0.0) * idf[place[t]] / norm for t in vocabulary)])
    squares = [(math.log(n + 1.0) + 1.0) ** 2, *(x * x for x in idf)]
    marks = [t for t in vocabulary if is_mark(t)]
    anchors = [[(t, at) for t, p in enumerate(parsed) for at, term in enumerate(p) if term == m] for m in marks]
    # (template, place of the mark in it) for each mark.
    anchor = F.array(*[F.array(*[F.struct(F.lit(t).alias("t"), F.lit(at).alias("p")) for t, at in a]) for a in anchors])
    lengths, names = _literal([len(p) for p in parsed]), _literal([name for name, _ in templates])
    found = F.filter(F.transform(tokens, lambda x, i: F.struct(i.alias("i"), F.array_position(_literal(marks), x).cast("int").alias("m"))), lambda x: x["m"] > 0)
    starts = F.flatten(F.transform(found, lambda x: F.transform(F.element_at(anchor, x["m"]), lambda a: F.struct(a["t"].alias("t"), F.greatest(F.lit(0), x["i"] - a["p"]).alias("s")))))
    windows = F.transform(F.array_distinct(starts), lambda w: F.struct(w["t"].alias("t"), F.slice(tokens, w["s"] + 1, F.element_at(lengths, w["t"] + 1)).alias("x")))
    placed = F.transform(windows, lambda w: F.struct(w["t"].alias("t"), w["x"].alias("x"), F.transform(w["x"], lambda x: (F.array_position(_literal(vocabulary), x) + 1).cast("int")).alias("v")))
    table = F.array(*[_literal(w) for w in weights])
    dot = lambda w: F.aggregate(w["v"], F.lit(0.0), lambda acc, v: acc + F.element_at(F.element_at(table, w["t"] + 1), v))
    # The sum of (tf * idf)^2 over terms is the sum of tf * idf^2 over tokens.
    length = lambda w: F.aggregate(F.zip_with(w["x"], w["v"], lambda x, v: F.size(F.filter(w["x"], lambda y: y == x)) * F.element_at(_literal(squares), v)), F.lit(0.0), lambda acc, x: acc + x)
    scored = F.transform(placed, lambda w: F.struct((-F.round(dot(w) / F.sqrt(length(w)), 6)).alias("neg"), F.element_at(names, w["t"] + 1).alias("license")))
    best = F.array_min(F.filter(scored, lambda x: x["neg"] <= -similarity))
    return F.when(F.arrays_overlap(tokens, _literal(marks)), best)


def scan(files: DataFrame, path_col: str = "path", text_col: str = "text", id_col: str = "doc_id", templates: list[tuple[str, str]] = TEMPLATES, similarity: float = SIMILARITY) -> DataFrame:
    """``(id, path, own_license, own_score, license, origin, licensed_dir)`` of every row.

    ``origin`` is own, inherited or none; ``licensed_dir`` is the directory a
    licence is inherited from.
    """
    vocabulary = sorted({t for _, text in templates for t in terms_of(text)})
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    # One row a template term leaves this aggregate, and one, the empty term, with the number of files.
    held = F.concat(F.array_intersect(_tokens(text), _literal(vocabulary)), F.array(F.lit("")))
    df = {r.term: r.n for r in files.select(F.explode(held).alias("term")).groupBy("term").agg(F.count("*").alias("n")).collect()}
    slim = files.select(F.col(id_col).alias("id"), F.col(path_col).cast("string").alias("path"), _tokens(text).alias("tokens"))
    parts = F.split("path", "/")
    owned = slim.select("id", "path", own_license(F.col("tokens"), templates, df, df.get("", 0), similarity).alias("best"))
    owned = owned.select(
        "id", "path", F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), "/").alias("dir"), F.element_at(parts, -1).rlike(LICENSE_FILE).alias("named"),
        F.col("best.license").alias("own_license"), (-F.col("best.neg")).alias("own_score"),
    )
    owned = cut(owned)
    name = F.element_at(F.split("path", "/"), -1)
    given = owned.where(F.col("named") & F.col("own_license").isNotNull()).groupBy(F.col("dir").alias("licensed_dir")).agg(F.min(F.struct((-F.col("own_score")).alias("neg"), name.alias("name"), F.col("own_license").alias("license"))).alias("g"))
    given = cut(given.select("licensed_dir", F.col("g.license").alias("dir_license")))
    dirs = owned.where(F.col("own_license").isNull() & F.col("path").isNotNull()).select("dir").distinct()
    pieces = F.split("dir", "/")
    # The root directory "" is everyone's ancestor.
    ancestors = F.concat(F.array(F.struct(F.lit(0).alias("depth"), F.lit("").alias("licensed_dir"))), F.when(F.col("dir") != "", F.transform(F.sequence(F.lit(1), F.size(pieces)), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(pieces, 1, i), "/").alias("licensed_dir")))).otherwise(F.array().cast("array<struct<depth:int,licensed_dir:string>>")))
    up = dirs.select("dir", F.explode(ancestors).alias("a")).select("dir", "a.depth", "a.licensed_dir")
    nearest = up.join(small(given), "licensed_dir").groupBy("dir").agg(F.max(F.struct("depth", "licensed_dir", "dir_license")).alias("n")).select(F.col("dir").alias("d"), F.col("n.licensed_dir").alias("licensed_dir"), F.col("n.dir_license").alias("dir_license"))
    out = owned.join(small(cut(nearest)), (F.col("dir") == F.col("d")) & F.col("own_license").isNull() & F.col("path").isNotNull(), "left")
    origin = F.when(F.col("own_license").isNotNull(), "own").when(F.col("dir_license").isNotNull(), "inherited").otherwise("none")
    return out.select("id", "path", "own_license", "own_score", F.coalesce("own_license", "dir_license").alias("license"), origin.alias("origin"), "licensed_dir")


def document_paths(docs: DataFrame) -> DataFrame:
    """``documents`` as a tree of files: thousands/hundreds/tens/name, with licence files at each level.

    Of the ids divisible by 10, which are the licence files, those divisible by
    1000 lie at the root, by 100 in their thousand, the others in their hundred;
    all other files lie in their ten. Rows with a null id have no path.
    """
    level = lambda n: F.floor(F.col("doc_id") / n).cast("string")
    file = F.concat(F.when(F.col("doc_id") % 10 == 0, F.lit("LICENSE-")).otherwise(F.lit("doc")), F.col("doc_id").cast("string"))
    path = F.when(F.col("doc_id") % 1000 == 0, file).when(F.col("doc_id") % 100 == 0, F.concat_ws("/", level(1000), file)).when(F.col("doc_id") % 10 == 0, F.concat_ws("/", level(1000), level(100), file))
    return docs.select("doc_id", path.otherwise(F.when(F.col("doc_id").isNotNull(), F.concat_ws("/", level(1000), level(100), level(10), file))).alias("path"), "text")


#: DuckDB SQL of the scan over `document_paths`; tokens, windows and cosines by joins.
ORACLE_SQL = rf"""WITH tmpl AS (SELECT * FROM (VALUES {{templates}}) v(t, license, said)),
tt AS (SELECT t, license, unnest(w) AS term, generate_subscripts(w, 1) - 1 AS p, len(w) AS l FROM (SELECT t, license, regexp_extract_all(lower(said), '{TOKEN}') AS w FROM tmpl)),
docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(lower(coalesce(text, '')), '{TOKEN}') AS w FROM documents),
tok AS (SELECT r, unnest(w) AS term, generate_subscripts(w, 1) - 1 AS i FROM docs), n AS (SELECT count(*) AS n FROM docs),
idf AS (SELECT term, ln((n + 1.0) / (count(DISTINCT r) + 1.0)) + 1.0 AS idf FROM (SELECT DISTINCT term FROM tt) LEFT JOIN tok USING (term), n GROUP BY term, n),
tw AS (SELECT t, license, term, count(*) * any_value(idf) AS w, any_value(l) AS l FROM tt JOIN idf USING (term) GROUP BY t, license, term),
tn AS (SELECT t, sqrt(sum(w * w)) AS tlen FROM tw GROUP BY t),
cand AS (SELECT DISTINCT r, t, l, greatest(0, i - p) AS s FROM tok JOIN tt USING (term) WHERE term NOT IN ({{common}}) AND NOT regexp_full_match(term, '[0-9.]+')),
win AS (SELECT c.r, c.t, c.s, k.term, count(*) * coalesce(any_value(idf.idf), any_value(ln(n + 1.0) + 1.0)) AS w FROM cand c JOIN tok k ON k.r = c.r AND k.i BETWEEN c.s AND c.s + c.l - 1 LEFT JOIN idf ON idf.term = k.term, n GROUP BY c.r, c.t, c.s, k.term),
cos AS (SELECT win.r, win.t, win.s, round(sum(win.w * coalesce(tw.w, 0)) / any_value(tlen) / sqrt(sum(win.w * win.w)), 6) AS score FROM win JOIN tn ON tn.t = win.t LEFT JOIN tw ON tw.t = win.t AND tw.term = win.term GROUP BY win.r, win.t, win.s),
own AS (SELECT r, arg_min(license, (-score, license)) AS own_license, max(score) AS own_score FROM cos JOIN tmpl USING (t) WHERE score >= {SIMILARITY} GROUP BY r),
placed AS (SELECT r, doc_id, CASE WHEN doc_id IS NULL THEN NULL WHEN doc_id % 1000 = 0 THEN '' WHEN doc_id % 100 = 0 THEN '' || doc_id // 1000 WHEN doc_id % 10 = 0 THEN doc_id // 1000 || '/' || doc_id // 100 ELSE doc_id // 1000 || '/' || doc_id // 100 || '/' || doc_id // 10 END AS dir,
    CASE WHEN doc_id % 10 = 0 THEN 'LICENSE-' || doc_id ELSE 'doc' || doc_id END AS name FROM docs),
o AS (SELECT placed.*, CASE WHEN dir = '' THEN name ELSE dir || '/' || name END AS path, own_license, own_score FROM placed LEFT JOIN own USING (r)),
given AS (SELECT dir AS licensed_dir, arg_min(own_license, (-own_score, name)) AS dir_license FROM o WHERE doc_id % 10 = 0 AND own_license IS NOT NULL GROUP BY dir),
near AS (SELECT o.r, arg_max(licensed_dir, length(licensed_dir)) AS licensed_dir, arg_max(dir_license, length(licensed_dir)) AS dir_license FROM o JOIN given ON licensed_dir = '' OR dir = licensed_dir OR starts_with(dir, licensed_dir || '/') WHERE own_license IS NULL GROUP BY o.r)
SELECT doc_id, path, own_license, own_score, coalesce(own_license, dir_license) AS license, CASE WHEN own_license IS NOT NULL THEN 'own' WHEN dir_license IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin, licensed_dir FROM o LEFT JOIN near USING (r)"""


def oracle_sql(templates: list[tuple[str, str]] = TEMPLATES) -> str:
    values = ", ".join(f"({i}, '{name}', '{text}')" for i, (name, text) in enumerate(templates))
    return ORACLE_SQL.replace("{templates}", values).replace("{common}", ", ".join(f"'{w}'" for w in sorted(_COMMON)))
