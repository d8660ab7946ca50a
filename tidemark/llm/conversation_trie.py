"""The prefix trie of conversations, by sorted shards and a skeleton of splitter paths.

A conversation is a path of turns (role, text); a node is a distinct prefix, the root
the empty one. For every node: its members (conversations that start with it), its
children, the leaves below it, and the words that sharing the prefix saves.

1. A turn is named by the MD5 of its role and text, a prefix by the MD5 chained over
   its turns. Conversations with one path collapse to a row by a partial aggregate, so
   a hot path costs nothing.
2. The distinct paths are range-partitioned and sorted into shards, and written to the
   shared folder once. The first path of each shard is its splitter. Only the
   prefixes of splitters can have members in two shards: they are the skeleton, and
   its names are broadcast. There are so few shards that shards x longest path is at
   most `SKELETON_NODES`, which bounds the broadcast; tasks stream, so a larger shard
   takes longer but holds no more.
3. A task walks its shard with a stack of open nodes. A node that closes and is not
   in the skeleton is finished there. A skeleton node's counts are partial: they are
   summed by name over the shards, and one more walk, over the skeleton alone, adds
   what depends on the totals (a node's own savings, childless nodes, children).
4. A parent closes after its children, so their rows are read in reverse (a sort in
   the partition, no shuffle), where parents come first. Parents in the skeleton are
   joined by name.
5. The ids of the conversations that end at a node are hashed in order. Pieces of
   2^`ID_BITS` ids are sorted and joined to strings where they lie; a task then feeds a
   node's pieces, in order, to its digest. SHA-256 admits no other way than one
   after the other, but holds nothing.

Nulls: a null role or text is empty; turns are ordered by turn, null first, and turns
that tie in it by their names, so repeated rows are repeated turns. Rows with a null
conv_id belong to no conversation. Empty tables give no rows. Texts of any length are
hashed where they are read and never shuffled; a path holds 16 bytes a turn. Columns
other than the four, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, cut, small

#: The skeleton has at most this many nodes (of 16 bytes, some 100 in a task's set).
SKELETON_NODES = 1 << 18
#: Ids that differ in this many low bits alone are joined to one string.
ID_BITS = 14
ROOT = b""

_NODE = "name binary, depth long, conv_id long, n_convs long, n_children long, n_leaves long, saved long"


def conversations_of(rows: DataFrame) -> DataFrame:
    """``(conv_id, s)``: every conversation's turns ``(turn, id, words)`` in order, each named by its content; rows without a conv_id are left out."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    named = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    turn = F.struct(F.col("turn").cast("long").alias("turn"), named.alias("id"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))
    slim = rows.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("s"))
    return slim.groupBy("conv_id").agg(F.sort_array(F.collect_list("s")).alias("s"))


def grafted(conversations: DataFrame, every: int = 20, kinds: int = 4) -> DataFrame:
    """``(conv_id, path, words)`` of conversations rebuilt on the first turns of another.

    Conversation c begins with the first h turns of c - c % every, h = crc32(c in
    decimal) % kinds, then goes on with its own turns after its first h. Those
    without a turn left have an empty path.
    """
    convs = cut(conversations)
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % kinds).cast("int")
    heads = convs.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("base"), F.slice("s", 1, kinds - 1).alias("head"))
    both = convs.withColumn("base", F.col("conv_id") - F.col("conv_id") % every).join(heads, "base", "left")
    own = F.slice("s", h + 1, F.greatest(F.size("s"), F.lit(1)))
    steps = both.select("conv_id", F.when(F.col("head").isNull(), own).otherwise(F.concat(F.slice("head", F.lit(1), h), own)).alias("s"))
    return steps.select("conv_id", F.col("s.id").alias("path"), F.col("s.words").alias("words"))


def chained(path: list[bytes]) -> list[bytes]:
    """The names of all prefixes of a path, the root first."""
    names = [ROOT]
    for turn in path:
        names.append(hashlib.md5(names[-1] + turn).digest())
    return names


def _end_names(paths: DataFrame) -> DataFrame:
    """``(conv_id, path, words)`` with the name of the node at which each ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [chained(p)[-1] for p in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), *batch.columns], ["name", "conv_id", "path", "words"])

    return paths.select("conv_id", "path", "words").mapInArrow(run, "name binary, conv_id long, path array<binary>, words array<long>")


class _Open:
    """An open node on the stack; ``leaves`` and ``saved`` are those of finished nodes below it."""

    __slots__ = ("name", "turn", "words", "conv", "n", "children", "leaves", "saved", "shared")

    def __init__(self, name: bytes, turn: bytes, words: int, shared: bool):
        self.name, self.turn, self.words, self.shared = name, turn, words, shared
        self.conv, self.n, self.children, self.leaves, self.saved = None, 0, 0, 0, 0


def _least(a: int | None, b: int | None) -> int | None:
    return b if a is None else a if b is None else min(a, b)


def _walk(rows: Iterator[tuple], skeleton) -> Iterator[tuple]:
    """Nodes of sorted distinct paths ``(path, words, n, conv)`` as they close: ``(node, depth, parent name)``."""
    stack: list[_Open] = []

    def close() -> tuple:
        node = stack.pop()
        above = stack[-1] if stack else None
        if not node.shared:
            node.leaves += not node.children
            node.saved += (node.n - 1) * node.words
        if above:
            above.conv, above.n = _least(above.conv, node.conv), above.n + node.n
            if not node.shared:  # what is below skeleton nodes is added up the skeleton
                above.children += 1
                above.leaves += node.leaves
                above.saved += node.saved
        return node, len(stack), above.name if above else None

    for path, words, n, conv in rows:
        if not stack:
            stack.append(_Open(ROOT, b"", 0, True))
        same = 0
        while same < len(path) and same + 1 < len(stack) and stack[same + 1].turn == path[same]:
            same += 1
        while len(stack) > same + 1:
            yield close()
        for turn, count in zip(path[same:], words[same:], strict=True):
            name = hashlib.md5(stack[-1].name + turn).digest()
            stack.append(_Open(name, turn, count, stack[-1].shared and name in skeleton))
        stack[-1].conv, stack[-1].n = _least(stack[-1].conv, conv), stack[-1].n + n
    while stack:
        yield close()


_SHARD = "seq long, name binary, parent binary, depth long, words long, shared boolean, conv_id long, n_convs long, n_children long, n_leaves long, saved long"
_SHARD_KINDS = [pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.bool_(), *[pa.int64()] * 5]
_SHARD_NAMES = [c.split()[0] for c in _SHARD.split(", ")]


def _batches(rows: Iterator[tuple], kinds: list, names: list[str], size: int = 4096) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds, strict=True)], names)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds, strict=True)], names)


def _shard_nodes(sorted_paths: DataFrame, skeleton) -> DataFrame:
    """Every node of each shard in closing order; skeleton nodes with what this shard knows of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = skeleton.value

        def rows() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

        def told() -> Iterator[tuple]:
            for seq, (x, depth, parent) in enumerate(_walk(rows(), shared)):
                yield seq, x.name, parent, depth, x.words, x.shared, x.conv, x.n, x.children, x.leaves, x.saved

        yield from _batches(told(), _SHARD_KINDS, _SHARD_NAMES)

    return sorted_paths.select("path", "words", "n", "conv").mapInArrow(run, _SHARD)


def _parents_first(nodes: DataFrame) -> DataFrame:
    """Finished nodes with their parent's least member, read against the order in which they closed."""
    names = ["name", "depth", "conv_id", "n_convs", "n_children", "n_leaves", "saved", "parent_conv_id", "parent"]
    kinds = [pa.binary(), *[pa.int64()] * 7, pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        convs: list[int] = []  # of the open nodes by depth; None for those of the skeleton

        def told() -> Iterator[tuple]:
            for batch in batches:
                for name, parent, depth, shared, *counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    del convs[depth:]
                    convs.extend([None] * (depth - len(convs)))
                    convs.append(None if shared else counts[0])
                    if not shared:
                        up = convs[depth - 1]
                        yield name, depth, *counts, up, parent if up is None else None

        yield from _batches(told(), kinds, names)

    slim = nodes.sortWithinPartitions(F.col("seq").desc()).select("name", "parent", "depth", "shared", "conv_id", "n_convs", "n_children", "n_leaves", "saved")
    return slim.mapInArrow(run, _NODE + ", parent_conv_id long, parent binary")


def _skeleton_totals(parts: DataFrame) -> DataFrame:
    """Skeleton nodes from the shards' partial counts, with what depends on the totals added up the skeleton.

    The sums meet by name. What is left is bounded by SKELETON_NODES, and one task
    walks it from the deepest node up.
    """
    summed = parts.groupBy("name").agg(F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.first("words").alias("words"), F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved")])
    names = ["name", "parent", "depth", "conv_id", "n_convs", "n_children", "n_leaves", "saved", "parent_conv_id"]
    kinds = [pa.binary(), pa.binary(), *[pa.int64()] * 7]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [dict(zip(batch.schema.names, r, strict=True)) for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
        at = {r["name"]: r for r in rows}
        for r in rows:
            if r["parent"] is not None:
                at[r["parent"]]["n_children"] += 1
        for r in sorted(rows, key=lambda r: -r["depth"]):
            r["saved"] += (r["n_convs"] - 1) * r["words"]
            r["n_leaves"] += not r["n_children"]
            up = at.get(r["parent"])
            r["parent_conv_id"] = up["conv_id"] if up else None
            if up:
                up["saved"] += r["saved"]
                up["n_leaves"] += r["n_leaves"]
        yield from _batches((tuple(r[c] for c in names) for r in rows), kinds, names)

    slim = summed.select("name", "parent", "depth", "words", "conv_id", "n_convs", "n_children", "n_leaves", "saved").coalesce(1)
    return slim.mapInArrow(run, "name binary, parent binary, " + _NODE.replace("name binary, ", "") + ", parent_conv_id long")


def _end_digests(ends: DataFrame) -> DataFrame:
    """``(name, ends_sha256)`` of nodes at which a conversation ends: its ids ascending, comma-joined, hashed."""
    block = ends.groupBy("name", F.shiftright("conv_id", ID_BITS).alias("b")).agg(F.sort_array(F.collect_list("conv_id")).alias("ids"))
    pieces = block.select("name", "b", F.array_join(F.col("ids").cast("array<string>"), ",").alias("piece"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told() -> Iterator[tuple]:
            name, digest = None, None
            for batch in batches:
                for one, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    if digest is None or one != name:
                        if digest:
                            yield name, digest.hexdigest()
                        name, digest = one, hashlib.sha256(piece.encode())
                    else:
                        digest.update(b"," + piece.encode())
            if digest:
                yield name, digest.hexdigest()

        yield from _batches(told(), [pa.binary(), pa.string()], ["name", "ends_sha256"])

    return pieces.repartition("name").sortWithinPartitions("name", "b").select("name", "piece").mapInArrow(run, "name binary, ends_sha256 string")


def trie(paths: DataFrame) -> DataFrame:
    """All nodes of the trie of ``paths (conv_id, path array<binary>, words array<long>)``.

    ``(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256, node)``; a path's elements name its turns, ``words`` counts theirs.
    """
    ended = cut(_end_names(paths))
    distinct = ended.groupBy("name").agg(F.first("path").alias("path"), F.first("words").alias("words"), F.count("*").alias("n"), F.min("conv_id").alias("conv"))
    spark = paths.sparkSession
    longest = ended.agg(F.max(F.size("path"))).first()[0] or 0
    count = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), SKELETON_NODES // (longest + 1)))
    shards = cut(distinct.repartitionByRange(count, F.col("path")).sortWithinPartitions("path").withColumn("shard", F.spark_partition_id()))
    splitters = shards.groupBy("shard").agg(F.min("path").alias("path"))
    skeleton = {name for row in splitters.select("path").toLocalIterator() for name in chained(row.path)}
    nodes = cut(_shard_nodes(shards, spark.sparkContext.broadcast(skeleton)))
    core = cut(_skeleton_totals(nodes.where("shared")))
    own = _parents_first(nodes)
    ups = core.select(F.col("name").alias("parent"), F.col("conv_id").alias("up"))
    own = own.join(small(ups), "parent", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "up"))
    columns = ["name", "depth", "conv_id", "n_convs", "n_children", "n_leaves", "saved", "parent_conv_id"]
    found = own.select(*columns).unionByName(core.select(*columns)).join(_end_digests(ended.select("name", "conv_id")), "name", "left")
    return found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"), F.lower(F.hex("name")).alias("node"))



#: CRC-32 of a conversation id in decimal, its bits as elements of a list folded one after another.
_CRC = """(xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: [CAST(ord(c) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))),
    lambda x, e: xor(xor(x, e) >> 1, 3988292384 * (xor(x, e) & 1))), 4294967295))"""

ORACLE_SQL = f"""WITH t AS (SELECT conv_id, md5(strlen(role) || ':' || role || text) AS id, turn, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, id) - 1 AS pos FROM t),
c AS (SELECT conv_id, {_CRC} % 4 AS h FROM (SELECT DISTINCT conv_id FROM t)),
r AS (SELECT c.conv_id, 0 AS side, pos, id, words FROM c JOIN o ON o.conv_id = c.conv_id - c.conv_id % 20 AND pos < h UNION ALL SELECT c.conv_id, 1, pos, id, words FROM c JOIN o ON o.conv_id = c.conv_id AND pos >= h),
p AS (SELECT c.conv_id, coalesce(list(id ORDER BY side, pos) FILTER (id IS NOT NULL), []) AS ids, coalesce(list(words ORDER BY side, pos) FILTER (id IS NOT NULL), []) AS ws FROM c LEFT JOIN r ON c.conv_id = r.conv_id GROUP BY c.conv_id),
m AS (SELECT conv_id, len(ids) AS size, d AS depth, array_to_string(ids[1:d], ',') AS node, CASE WHEN d > 0 THEN array_to_string(ids[1:d - 1], ',') END AS parent, CASE WHEN d > 0 THEN ws[d] ELSE 0 END AS words FROM (SELECT *, unnest(range(len(ids) + 1)) AS d FROM p)),
n AS (SELECT node, depth, parent, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(words) AS own, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (size = depth), '')) AS ends_sha256 FROM m GROUP BY 1, 2, 3),
k AS (SELECT parent, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
f AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k ON n.node = k.parent),
s AS (SELECT top, count(*) FILTER (n_children = 0) AS n_leaves, CAST(sum(own) AS BIGINT) AS saved_tokens FROM (SELECT DISTINCT a.node AS top, b.node FROM m a JOIN m b ON a.conv_id = b.conv_id AND b.depth >= a.depth) x JOIN f ON x.node = f.node GROUP BY 1)
SELECT f.conv_id, f.depth, u.conv_id AS parent_conv_id, f.n_convs, f.n_children, s.n_leaves, s.saved_tokens, f.ends_sha256 FROM f JOIN s ON f.node = s.top LEFT JOIN n u ON f.parent = u.node"""
