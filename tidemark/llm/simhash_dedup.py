"""SimHash near-duplicates by vantage-point partitions of Hamming space.

A document's 64-bit fingerprint is the bitwise majority of the XXH64 values of
its 3-word shingles. Two fingerprints link when they differ in ``radius`` bits
or fewer, and linked fingerprints form a component.

How links are found, exactly and without comparing all pairs:

1. Equal fingerprints collapse to one row (a partial aggregate), so copies cost
   nothing however many there are.
2. The root vantage point is fingerprint zero. Ring r of a vantage point holds
   the distances [w*r, w*r + w), w = radius + 1. By the triangle inequality,
   partners of a fingerprint at distance d lie within d +- radius, so it goes to
   its own ring and, where that ring's lower bound is near enough, to the next
   one too: linked fingerprints meet in a ring.
3. Random fingerprints lie about 32 bits apart, with a spread of 4, so rings alone
   prune little at this radius. A ring's fingerprints are therefore dealt by the
   values of ``radius + 1`` blocks of bits as well: of two within the radius at
   least one block is untouched, so they meet in the shard of its value.
4. A shard above ``shard_rows`` is cut into rings around a vantage point of its
   own, its least fingerprint, and rings still above it around theirs, as long as
   that makes the largest smaller: the depth follows the data.
5. A task builds a vantage-point tree of each shard: half of the fingerprints, by
   distance to a vantage point, in one branch, the others and those within the
   radius of the boundary in the other, down to leaves of ``SMALL`` that are
   compared all at once. Where no vantage point divides (a dense ball), a
   search visits each fingerprint once and emits a spanning link, never all pairs.
6. Components come from the links by star contraction (`components`).

Null text counts as empty (fingerprint zero, linked like any other). Rows with
a null id keep their fingerprint and get a null component. Repeated rows and
ids are fine: each row has its own fingerprint. A very long text is hashed in
chunks. An empty table gives an empty one. Columns other than id and text,
whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_batches, cut, fits, free_name, raw_texts, small, words
from tidemark.llm.components import components

SHINGLE = 3
SEED = 42
RADIUS = 3
#: Shards above this many fingerprints are cut into rings by a vantage point.
SHARD_ROWS = 20_000
#: Shards and leaves up to this size are compared row by row in one sweep.
SMALL = 64
#: Up to this many ids (24 bytes each) are broadcast to filter the documents.
BROADCAST_IDS = 1_000_000


def fingerprint(tokens: list[bytes], size: int = SHINGLE, seed: int = SEED, chunk: int = 1 << 16) -> int:
    """The majority fingerprint of a word list; ``chunk`` bounds the memory used at once."""
    from xxhash import xxh64_intdigest

    n = max(1, len(tokens) - size + 1)
    if not tokens:
        return 0
    ones = np.zeros(64, np.int64)
    for start in range(0, n, chunk):
        stop = min(n, start + chunk)
        columns = [tokens[start + j : stop + j] for j in range(size)] if len(tokens) >= size else []
        shingles = map(b" ".join, zip(*columns, strict=True)) if columns else [b" ".join(tokens)]
        values = np.fromiter((xxh64_intdigest(s, seed) for s in shingles), np.uint64, stop - start)
        bits = np.unpackbits(values.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, fp)`` of every row; ``fp`` is the unsigned value kept in a long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.fromiter((fingerprint(words(t)) for t in raw_texts(batch.column(1))), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64))], ["id", "fp"])

    bounded_batches(docs.sparkSession)
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(run, "id long, fp long")


def _distance(x: np.ndarray, y: np.ndarray | np.uint64) -> np.ndarray:
    return np.bitwise_count(x ^ y)


def _small_links(key: np.ndarray, dist: np.ndarray, fp: np.ndarray, rep: np.ndarray, radius: int) -> Iterator[tuple]:
    """Links of many small shards at once; rows are sorted by (shard, distance to its vantage point)."""
    for shift in range(1, SMALL):
        if shift >= len(fp):
            return
        near = (key[shift:] == key[:-shift]) & (dist[shift:] - dist[:-shift] <= radius)
        if not near.any():
            return
        at = np.flatnonzero(near)
        at = at[_distance(fp[at], fp[at + shift]) <= radius]
        if len(at):
            yield rep[at], rep[at + shift]


def _spanning_links(dist: np.ndarray, fp: np.ndarray, rep: np.ndarray, radius: int) -> Iterator[tuple]:
    """Spanning links of one shard sorted by distance to its vantage point.

    A search from each unvisited row; each row is expanded once and looks only
    at unvisited rows whose distance to the vantage point is within the radius.
    """
    open_rows = np.ones(len(fp), bool)
    lo = np.searchsorted(dist, dist - radius, "left")
    hi = np.searchsorted(dist, dist + radius, "right")
    for start in range(len(fp)):
        if not open_rows[start]:
            continue
        open_rows[start] = False
        queue = [start]
        while queue:
            x = queue.pop()
            at = lo[x] + np.flatnonzero(open_rows[lo[x] : hi[x]])
            at = at[_distance(fp[at], fp[x]) <= radius]
            if len(at):
                open_rows[at] = False
                queue.extend(at.tolist())
                yield np.full(len(at), rep[x]), rep[at]


def _tree_links(fp: np.ndarray, rep: np.ndarray, radius: int) -> Iterator[tuple]:
    """Links of one shard by a vantage-point tree whose second branches hold the first's boundary as well."""
    open_branches = [np.arange(len(fp))]
    leaves: list[np.ndarray] = []
    while open_branches:
        at = open_branches.pop()
        if len(at) <= SMALL:
            leaves.append(at)
            continue
        vantage = fp[at[0]]
        for _ in range(2):  # the first one, else the fingerprint farthest from it
            dist = _distance(fp[at], vantage).astype(np.int16)
            middle = np.median(dist)
            first, second = at[dist <= middle], at[dist > middle - radius]
            if max(len(first), len(second)) <= 0.9 * len(at):
                open_branches += [first, second]
                break
            vantage = fp[at[dist.argmax()]]
        else:
            order = np.argsort(dist, kind="stable")
            yield from _spanning_links(dist[order], fp[at[order]], rep[at[order]], radius)
    if leaves:
        at = np.concatenate(leaves)
        key = np.repeat(np.arange(len(leaves)), [len(x) for x in leaves])
        yield from _small_links(key, np.zeros(len(at), np.int16), fp[at], rep[at], radius)


def _shard_links(radius: int):
    """A task over rows sorted by shard: hands whole shards on as they end."""

    def links(shard: np.ndarray, fp: np.ndarray, rep: np.ndarray) -> Iterator[tuple]:
        first = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]])
        sizes = np.diff(np.r_[first, len(shard)])
        few = np.repeat((sizes > 1) & (sizes <= SMALL), sizes)
        dist = _distance(fp, np.repeat(fp[first], sizes)).astype(np.int16)  # small shards: the first row is their vantage point
        order = np.lexsort((dist[few], np.repeat(first, sizes)[few]))
        yield from _small_links(np.repeat(first, sizes)[few][order], dist[few][order], fp[few][order], rep[few][order], radius)
        for a, n in zip(first[sizes > SMALL], sizes[sizes > SMALL], strict=True):
            yield from _tree_links(fp[a : a + n], rep[a : a + n], radius)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush(parts: list[tuple]) -> Iterator[pa.RecordBatch]:
            if parts:
                for a, b in links(*(np.concatenate(x) for x in zip(*parts, strict=True))):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            shard = batch.column(0).to_numpy(zero_copy_only=False)
            fp = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            rep = batch.column(2).to_numpy(zero_copy_only=False)
            last = int(np.searchsorted(shard, shard[-1], "left"))
            if last:
                yield from flush([*held, (shard[:last], fp[:last], rep[:last])])
                held = []
            elif held and held[-1][0][-1] != shard[0]:
                yield from flush(held)
                held = []
            held.append((shard[last:], fp[last:], rep[last:]))
        yield from flush(held)

    return run


def _rings(d: Column, width: int) -> Column:
    """The rings of a vantage point that a fingerprint at distance ``d`` goes to: its own, and the next if its bound is near."""
    own = F.floor(d / width)
    return F.when(d % width > 0, F.array(own, own + 1)).otherwise(F.array(own))


def near_links(reps: DataFrame, radius: int = RADIUS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Links ``(a, b)`` between distinct fingerprints ``reps (fp, rep)``.

    The links span every component exactly: any two fingerprints within the
    radius are joined by a path of links of their shard.
    """
    blocks, width = radius + 1, 64 // (radius + 1)
    if width * blocks != 64:
        raise ValueError("radius + 1 must divide 64")
    value = lambda b: F.shiftrightunsigned("fp", b * width).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
    keys = F.array(*[F.struct(F.lit(b).alias("b"), value(b).alias("v")) for b in range(blocks)])
    ringed = reps.select("fp", "rep", F.explode(_rings(F.bit_count("fp"), radius + 1)).alias("__r"))
    rows = ringed.select("fp", "rep", "__r", F.explode(keys).alias("__k")).select("fp", "rep", F.xxhash64("__r", "__k.b", "__k.v").alias("shard"))
    done, largest = None, None
    while True:
        hot = cut(rows.groupBy("shard").agg(F.count("*").alias("__n"), F.min("fp").alias("__v")).where(F.col("__n") > shard_rows))
        now = hot.agg(F.max("__n")).first()[0]
        if now is None or (largest is not None and now > 0.9 * largest):
            break
        largest, hot = now, small(hot)
        cold = rows.join(hot, "shard", "left_anti")
        done = cold if done is None else done.unionByName(cold)
        rows = rows.join(hot, "shard").select("fp", "rep", "shard", F.explode(_rings(F.bit_count(F.col("fp").bitwiseXOR(F.col("__v"))), radius + 1)).alias("__r"))
        rows = cut(rows.select("fp", "rep", F.xxhash64("shard", "__r").alias("shard")))
    rows = rows if done is None else done.unionByName(rows)
    dealt = rows.select("shard", "fp", "rep").repartition("shard").sortWithinPartitions("shard", "fp")
    return dealt.mapInArrow(_shard_links(radius), "a long, b long")


def _classes(prints: DataFrame, radius: int, shard_rows: int) -> DataFrame:
    """``(fp, component)`` of every fingerprint of ``prints (id, fp)`` that a row with an id has."""
    reps = cut(prints.where("id is not null").groupBy("fp").agg(F.min("id").alias("rep")))
    linked = components(near_links(reps, radius, shard_rows))
    return reps.join(linked, reps.rep == linked.node, "left").select("fp", F.coalesce("component", "rep").alias("component"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for every row of ``docs``."""
    prints = cut(fingerprints(docs, id_col, text_col))
    out = prints.join(_classes(prints, radius, shard_rows), "fp", "left")
    return out.select(
        F.col("id").alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col("id").isNotNull(), F.col("component")).alias("component_id"),
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """``docs`` with one row of each near-duplicate group: that with the least id.

    Rows with a null id stay. Of the rows that share the kept id, those of the
    group's fingerprints count, and the one with the least hash of its values
    stays. Texts are not shuffled: the ids to leave out are broadcast, up to
    BROADCAST_IDS of them (counted), and shuffled beyond; only rows with a repeated
    id are looked at again.
    """
    prints = cut(fingerprints(docs, id_col, text_col))
    classes = cut(_classes(prints, radius, SHARD_ROWS))
    heads = prints.where("id is not null").join(classes, "fp").groupBy("id").agg(F.count("*").alias("n"), F.max((F.col("id") == F.col("component")).cast("int")).alias("head"))
    out = cut(heads.where("n > 1 or head = 0").select("id", (F.col("head") == 1).alias("again")))
    name = free_name(docs, "__out")
    own = F.col(id_col).cast("long") == F.col(name)
    gone = out.select(F.col("id").alias(name))
    kept = docs.join(F.broadcast(gone) if fits(gone, BROADCAST_IDS) else gone, own, "left_anti")
    again = out.where("again").select(F.col("id").alias(name))
    if again.isEmpty():
        return kept
    several = docs.join(small(again), own, "left_semi").select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    several = cut(several.select("row", F.monotonically_increasing_id().alias("k")))
    told = fingerprints(several.select(F.col("k"), F.col(f"row.`{text_col}`").alias("t")), "k", "t").select(F.col("id").alias("k"), "fp")
    met = several.join(told, "k").join(classes, "fp").where(F.col(f"row.`{id_col}`").cast("long") == F.col("component"))
    ones = met.groupBy("component").agg(F.min_by("row", F.struct(F.xxhash64("row"), "k")).alias("row"))
    return kept.unionByName(ones.select("row.*"))
