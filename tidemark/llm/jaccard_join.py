"""Similarity join on word shingles by a token-group matrix, exact.

Two documents link when their sets of 5-word shingles have a Jaccard similarity of
0.8 or more. Every document gets the component of its links.

1. Tokens are 64-bit hashes of shingles. Documents with equal sets collapse to a class
   by a partial aggregate over a digest of the set; the least id stands for the class.
   The same pass counts tokens in a table of `CELLS` hashed cells, summed cell by cell.
   (The bound of its broadcast is its size, whatever the corpus.) It orders tokens: those
   in rare cells first. Any order gives the same links; this one keeps what many
   documents share, such as passages or boilerplate, out of step 2.
2. Sets of n tokens that link share one of their first n - ceil(0.8 n) + 1 tokens in
   that order (the prefix), and the smaller set has it among its first n - ceil(0.89 n)
   + 1, which a class posts. Each posted token has a head, the least class that posts it,
   and a class's leader is the head with which it shares most of what it posts. Classes
   with one leader form a group, together with the leader; groups above `GROUP` are
   dealt into several, each with the leader. So documents of a group are alike, and no
   group grows with the data.
3. A group is a row of the matrix: the union of its members' tokens, with the places of
   each member's. Its members are linked among themselves, the leader first, those
   already in one component no more; what that gives is contracted.
4. Other links lie between components that share a prefix token. From all but the
   largest component of such a token, each class is a query against the token's
   groups of larger components (by size, then id), as far as sizes and the token's place
   in both sets admit.
5. A query is counted against the group's union. That bounds its overlap with any
   member, so only groups whose bound reaches 0.8 of the query are opened, and its
   overlap with each member of a fitting size is counted exactly by the members' places.

Queries stream past one group of at most `GROUP` + 1 sets in a task; queries of one group
are dealt over tasks by `QUERIES`. Near copies, however many, are linked in step 3 and
never meet again, since step 4 asks only across components.

Null or empty texts, or texts without words, have no tokens, link with nothing and are
their own component. Texts of fewer than five words are one token. Rows with a null id
get a null component. Rows that repeat an id are one node, and each has its own count.
Texts of any length are taken whole. Empty tables give no rows. Columns other than id
and text, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import cut, raw_texts, small, words
from tidemark.llm.components import components

SHINGLE = 5
#: Sets link when 100 * intersection >= PERCENT * union.
PERCENT = 80
#: Cells of the table that orders tokens; 4 bytes each are broadcast.
CELLS = 1 << 21
#: Members of a group, and queries of one group in a task.
GROUP = 64
QUERIES = 4096
#: Tokens with more classes than this are matched to their heads by a broadcast.
HOT = 20_000
#: Up to this many ids (8 bytes each) are broadcast to choose documents.
BROADCAST_IDS = 1_000_000

_PART = 1 << 14
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * _ODD[1]
    return x ^ (x >> np.uint64(29))


def shingle_set(tokens: list[bytes]) -> np.ndarray:
    """The distinct hashes of a word list's shingles, ascending; those of fewer words than a shingle has differ from any shingle's."""
    from xxhash import xxh64_intdigest

    n = len(tokens)
    if not n:
        return np.zeros(0, np.uint64)
    h = _mixed(np.fromiter(map(xxh64_intdigest, tokens), np.uint64, n))
    size = min(n, SHINGLE)
    value = np.full(n - size + 1, np.uint64(size), np.uint64)
    for j in range(size):
        value += h[j : n - size + 1 + j] * _ODD[j]
    return np.unique(_mixed(value))


def prefix_size(n: int) -> int:
    """How many of n tokens, in one order for all, must be looked at so that no link is missed."""
    return n - -(-PERCENT * n // 100) + 1


def _index_size(n: Column | str) -> Column:
    """How many of n tokens a set must post so that every link with a set of its size or more shows in them."""
    n = F.col(n) if isinstance(n, str) else n
    return n - F.ceil(2 * PERCENT * n / (100 + PERCENT)) + 1


def _overlap(n: Column, m: Column) -> Column:
    """The overlap that sets of n and m tokens need to link."""
    return F.ceil(PERCENT * (n + m) / (100 + PERCENT))


def _cells(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(64 - CELLS.bit_length() + 1)).astype(np.int64)


def _packed(counts: np.ndarray) -> bytes:
    """Counts as compressed planes of bytes: most are small."""
    return zlib.compress(counts.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def _unpacked(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(raw), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


def _slim(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))


_PRINT = "id long, n long, digest binary, part int, counts binary"


def _prints(slim: DataFrame) -> DataFrame:
    """A row for each document (id, n, digest of its set), and at a task's end its token counts in parts (part, counts)."""
    kinds, names = [pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.binary()], [c.split()[0] for c in _PRINT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(CELLS, np.int64)
        for batch in batches:
            n, digests, cells, held = [], [], [], 0
            for raw in raw_texts(batch.column(1)):
                tokens = shingle_set(words(raw))
                n.append(len(tokens))
                digests.append(hashlib.md5(tokens.tobytes()).digest())
                cells.append(_cells(tokens))
                held += len(tokens)
                if held > CELLS:
                    table += np.bincount(np.concatenate(cells), minlength=CELLS)
                    cells, held = [], 0
            table += np.bincount(np.concatenate([*cells, np.zeros(0, np.int64)]), minlength=CELLS)
            empty = pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, kinds[1]), pa.array(digests, kinds[2]), *empty], names)
        parts = [k for k in range(CELLS // _PART) if table[k * _PART : (k + 1) * _PART].any()]
        if parts:
            packed = [_packed(table[k * _PART : (k + 1) * _PART]) for k in parts]
            blank = [pa.nulls(len(parts), t) for t in kinds[:3]]
            yield pa.RecordBatch.from_arrays([*blank, pa.array(parts, kinds[3]), pa.array(packed, kinds[4])], names)

    return slim.mapInArrow(run, _PRINT)


def _token_counts(prints: DataFrame) -> np.ndarray:
    """The table of token counts, its parts summed in streams; CELLS numbers reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums.setdefault(part, np.zeros(_PART, np.int64))[:] += _unpacked(raw)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["part", "counts"])

    table = np.zeros(CELLS, np.int64)
    summed = prints.where("part is not null").select("part", "counts").repartition("part").mapInArrow(run, "part int, counts binary")
    for row in summed.toLocalIterator():
        table[row.part * _PART : (row.part + 1) * _PART] = np.frombuffer(row.counts, np.int64)
    return np.minimum(table, np.iinfo(np.uint32).max).astype(np.uint32)


def _prefixes(slim: DataFrame, order) -> DataFrame:
    """``(id, n, tokens)``: the prefix of every document with tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = order.value
        for batch in batches:
            ids, sizes, found = [], [], []
            for doc_id, raw in zip(batch.column(0).to_pylist(), raw_texts(batch.column(1)), strict=True):
                tokens = shingle_set(words(raw))
                if len(tokens):
                    rank = np.argsort(table[_cells(tokens)], kind="stable")  # equal counts: by token
                    ids.append(doc_id), sizes.append(len(tokens)), found.append(tokens[rank[: prefix_size(len(tokens))]].view(np.int64))
            if ids:
                at = np.cumsum([0, *map(len, found)])
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate(found)))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), lists], ["id", "n", "tokens"])

    return slim.mapInArrow(run, "id long, n long, tokens array<long>")


class TokenGroup:
    """A row of the token-group matrix: the union of some sets, and where in it each set's tokens lie."""

    def __init__(self, ids: list[int], comps: list[int], sets: list[np.ndarray]):
        self.ids, self.comps = np.array(ids, np.int64), np.array(comps, np.int64)
        self.sizes = np.array([len(s) for s in sets], np.int64)
        self.union, places = np.unique(np.concatenate(sets), return_inverse=True)
        self.places, self.first = places, np.cumsum(np.r_[0, self.sizes[:-1]])
        self.opened = 0

    def hits(self, query: np.ndarray) -> np.ndarray:
        """Where in the union the query's tokens lie; their number bounds its overlap with every member."""
        at = np.minimum(np.searchsorted(self.union, query), len(self.union) - 1)
        return at[self.union[at] == query]

    def similar(self, query: np.ndarray) -> np.ndarray:
        """Which members link with the query; the group is opened only if its bound admits one."""
        n, hits = len(query), self.hits(query)
        none = np.zeros(len(self.ids), bool)
        if 100 * len(hits) < PERCENT * n:
            return none
        fit = (100 * self.sizes >= PERCENT * n) & (PERCENT * self.sizes <= 100 * n)
        if not fit.any():
            return none
        self.opened += 1
        mark = np.zeros(len(self.union), np.int64)
        mark[hits] = 1
        both = np.add.reduceat(mark[self.places], self.first)
        return fit & (100 * both >= PERCENT * (n + self.sizes - both))

    def inner_links(self) -> list[tuple[int, int]]:
        """Links that span the group's components: each member against those not yet joined with it, the first member first."""
        comp = np.arange(len(self.ids))
        out = []
        for k in range(len(self.ids)):
            if (comp == comp[k]).all():
                break
            one = self.union[self.places[self.first[k] : self.first[k] + self.sizes[k]]]
            for j in np.flatnonzero(self.similar(one) & (comp != comp[k])).tolist():
                if comp[j] != comp[k]:
                    comp[comp == comp[j]] = comp[k]
                    out.append((int(self.ids[k]), int(self.ids[j])))
        return out


def _rows_of(batch: pa.RecordBatch) -> Iterator[tuple]:
    """The rows of a batch whose last column is a text, which is given as its set."""
    *columns, texts = batch.columns
    for *row, raw in zip(*(c.to_pylist() for c in columns), raw_texts(texts), strict=True):
        yield *row, shingle_set(words(raw))


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], ["a", "b"])


def _inner(rows: DataFrame) -> DataFrame:
    """Links within groups, from ``(grp, role, id, text)`` sorted by group with the leader first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grp, ids, sets = None, [], []
        for batch in batches:
            found: list[tuple[int, int]] = []
            for one, doc_id, tokens in _rows_of(batch):
                if one != grp:
                    if len(ids) > 1:
                        found += TokenGroup(ids, ids, sets).inner_links()
                    grp, ids, sets = one, [], []
                ids.append(doc_id), sets.append(tokens)
            if found:
                yield _pairs(found)
        if len(ids) > 1:
            yield _pairs(TokenGroup(ids, ids, sets).inner_links())

    return rows.select("grp", "id", "text").mapInArrow(run, "a long, b long")


def _across(rows: DataFrame) -> DataFrame:
    """Links of queries with members of other components, from ``(shard, role, id, comp, text)``: a shard's members (role 0), then its queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, group = None, [], None
        for batch in batches:
            found: list[tuple[int, int]] = []
            for one, role, doc_id, comp, tokens in _rows_of(batch):
                if one != shard:
                    shard, held, group = one, [], None
                if role == 0:
                    held.append((doc_id, comp, tokens))
                    continue
                if group is None:
                    group = TokenGroup(*map(list, zip(*held, strict=True)))
                hit = group.similar(tokens) & (group.comps != comp)
                for k in np.unique(group.comps[hit], return_index=True)[1].tolist():  # one link for each component
                    found.append((doc_id, int(group.ids[hit][k])))
            if found:
                yield _pairs(found)

    return rows.select("shard", "role", "id", "comp", "text").mapInArrow(run, "a long, b long")


def _led(tokens: DataFrame) -> DataFrame:
    """``(token, id, n, i, head)``: prefix tokens that several classes have and one posts, with the least class that posts them.

    Hot tokens meet their heads by a broadcast.
    """
    posts = F.col("i") < _index_size("n")
    heads = cut(tokens.groupBy("token").agg(F.min(F.when(posts, F.col("id"))).alias("head"), F.count("*").alias("c")).where("c > 1 and head is not null"))
    rows = tokens.join(small(heads.where(F.col("c") > HOT).select("token", F.col("head").alias("hot_head"))), "token", "left")
    cold = rows.where("hot_head is null").drop("hot_head").join(heads.where(F.col("c") <= HOT).select("token", "head"), "token")
    return cold.unionByName(rows.where("hot_head is not null").select("token", "id", "n", "i", F.col("hot_head").alias("head")))


def _groups(matched: DataFrame) -> DataFrame:
    """``(grp, leader, id, n)`` of every class with a shared token: its group by its leader, dealt if there are many.

    A leader shares a token that the class posts; without one a class leads itself.
    """
    shares = matched.groupBy("id", "head").agg(F.sum((F.col("i") < _index_size("n")).cast("int")).alias("c"), F.first("n").alias("n"))
    alike = (F.col("id") != F.col("head")) & (F.col("c") > 0)
    best = F.max(F.when(alike, F.struct("c", (-F.col("head")).alias("h"))))
    led = cut(shares.groupBy("id").agg(F.coalesce(-best["h"], F.col("id")).alias("leader"), F.first("n").alias("n")))
    many = led.where("id <> leader").groupBy("leader").agg(F.count("*").alias("m"))
    deal = F.pmod(F.xxhash64("id"), F.ceil(F.coalesce("m", F.lit(1)) / (GROUP // 2)))  # half full on average
    return led.join(many, "leader", "left").select(F.struct("leader", deal.alias("k")).alias("grp"), "leader", "id", "n")


def _met(rows: DataFrame, texts: DataFrame, at: str) -> DataFrame:
    """Texts brought to where they are compared: there they are made sets again, which take more room on the way than texts do."""
    return texts.join(small(rows, BROADCAST_IDS), "id").repartition(at).sortWithinPartitions(at, "role", "id")


def _inner_rows(groups: DataFrame, texts: DataFrame) -> DataFrame:
    """Members and leaders of groups with two texts or more."""
    others = groups.where("id <> leader")
    rows = others.select("grp", "id", F.lit(1).alias("role")).unionByName(others.select("grp", F.col("leader").alias("id"), F.lit(0).alias("role")).distinct())
    return _met(cut(rows), texts, "grp")


def _asked(matched: DataFrame, members: DataFrame) -> DataFrame:
    """``(grp, id)``: which classes are to be asked against which groups of other components.

    The first common token of two sets, in the order of tokens, lies before place
    n - overlap + 1 of each; so only tokens that do, given what a group's sizes admit, bring
    a class to a group.
    """
    rows = matched.select("token", "id", "n", "i").join(members.select("id", "grp", "comp", "size"), "id")
    rank = F.struct("size", "comp")
    tops = rows.groupBy("token").agg(F.max(rank).alias("top"), F.min(rank).alias("low")).where(F.col("top") != F.col("low")).select("token", "top")
    live = cut(rows.join(tops, "token"))
    asking = live.where(F.struct("size", "comp") != F.col("top")).select("token", "id", "n", "i", "size", "comp")
    held = live.groupBy("token", F.col("grp"), F.col("comp").alias("g_comp"), F.col("size").alias("g_size")).agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.max(F.col("n") - F.col("i")).alias("rest"))
    up = F.struct(F.col("g_size"), F.col("g_comp")) > F.struct("size", "comp")
    fit = (100 * F.col("hi") >= PERCENT * F.col("n")) & (PERCENT * F.col("lo") <= 100 * F.col("n"))
    least = F.greatest(F.col("lo"), F.ceil(PERCENT * F.col("n") / 100))  # the least size of a member that may link
    need = _overlap(F.col("n"), least)
    early = (F.col("n") - F.col("i") >= need) & (F.col("rest") >= need)
    return asking.join(held, "token").where(up & fit & early).select("grp", "id").distinct()


def _across_rows(asked: DataFrame, members: DataFrame, texts: DataFrame) -> DataFrame:
    """Groups with their queries, those of one group dealt over shards that each hold the group."""
    counts = asked.groupBy("grp").agg(F.count("*").alias("c"))
    deal = counts.select("grp", F.ceil(F.col("c") / QUERIES).cast("int").alias("shards"))
    queries = asked.join(deal, "grp").select(F.struct("grp", F.pmod(F.xxhash64("id"), F.col("shards")).cast("int").alias("k")).alias("shard"), F.lit(1).alias("role"), "id")
    rows = members.select("grp", "id").join(deal, "grp").select("id", "grp", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("k"))
    both = rows.select(F.struct("grp", "k").alias("shard"), F.lit(0).alias("role"), "id").unionByName(queries).join(members.select("id", "comp"), "id")
    return _met(cut(both), texts, "shard")


def _repeated(named: DataFrame, reps: DataFrame) -> DataFrame:
    """Links between the classes of rows that repeat an id with other texts."""
    other = named.where("id <> rep")
    least = other.groupBy("id").agg(F.min("rep").alias("b"), F.max("rep").alias("__most")).where("b <> __most").drop("__most")
    own = other.join(reps, "id", "left_semi").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    return own.unionByName(other.join(least, "id").select(F.col("rep").alias("a"), "b"))


def similar_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` for every row of ``docs``."""
    spark: SparkSession = docs.sparkSession
    slim = _slim(docs, id_col, text_col)
    prints = cut(_prints(slim))
    rows = prints.where("part is null").select("id", "n", "digest")
    known = rows.where("id is not null and n > 0")
    classes = cut(known.groupBy("digest").agg(F.min("id").alias("rep")))
    order = spark.sparkContext.broadcast(_token_counts(prints))

    named = cut(known.join(classes, "digest").select("id", "n", "rep"))
    reps = classes.select(F.col("rep").alias("id")).distinct()
    copies = known.select("id").distinct().join(reps, "id", "left_anti")
    whole = slim.where("id is not null")
    first = whole.join(small(copies, BROADCAST_IDS), "id", "left_anti")
    prefixes = cut(_prefixes(first, order))
    tokens = prefixes.select("id", F.col("n").cast("int").alias("n"), F.posexplode("tokens").alias("i", "token"))
    matched = cut(_led(tokens))

    groups = cut(_groups(matched))
    links = cut(_inner(_inner_rows(groups, first)).unionByName(_repeated(named, reps)))
    joined = cut(components(links))

    members = groups.join(joined, groups.id == joined.node, "left").select("grp", "id", "n", F.coalesce("component", "id").alias("comp"))
    members = cut(members.join(members.groupBy("comp").agg(F.count("*").alias("size")), "comp"))
    asked = cut(_asked(matched, members))
    more = cut(_across(_across_rows(asked, members, first)))
    final = components(links.unionByName(more)) if more.limit(1).count() else joined

    named = named.join(final, named.rep == final.node, "left").select("id", "n", F.coalesce("component", "rep").alias("component_id"))
    rest = rows.where("id is null or n = 0").select("id", "n", F.col("id").alias("component_id"))
    return named.unionByName(rest).select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id")


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
x AS (SELECT DISTINCT doc_id, unnest(list_transform(range(CASE WHEN len(ws) = 0 THEN 0 ELSE greatest(len(ws) - 4, 1) END), lambda i: array_to_string(ws[i + 1:i + 5], ' '))) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM x GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM x a JOIN x b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n u ON u.doc_id = a JOIN n v ON v.doc_id = b WHERE 100 * m >= 80 * (u.n + v.n - m)),
r AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT r.a AS doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.b) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.a GROUP BY 1"""
