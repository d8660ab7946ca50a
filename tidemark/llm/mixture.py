"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame operations only.

Every source gets a token budget: its share of all tokens by weight, at most
``max_epochs`` times its own size, with what that cuts off shared again by
weight until no source is above its bound (water filling, solved exactly from
prefix sums over the sources, one row each).

Within a source the budget is met by complete epochs first (each document once
an epoch). The rest of the budget goes to a weighted sample without
replacement: a document's key is an exponential variable divided by its quality
weight, documents are taken in the order of their keys while the prefix sum of
tokens stays in the budget, and the document that crosses it is taken if that
ends nearer to the budget.

Scale: texts are read once, for their token counts and quality weights. A hot
source is never sorted in one task: it is cut into ``BUCKETS`` ranges of keys whose
sums are small; whole ranges below the crossing point are taken without
sorting, and the range in which the budget ends is cut again between its own
least and largest key until it has at most ``RANGE_ROWS`` rows, which alone are
sorted. So it does not matter how the keys are distributed. Rows with one key
(repeated rows) are cut by their row number. The water filling sorts one row a
source.

Null text counts 0 tokens and is never taken; null sources are a source of their
own (last in order); null ids draw like an empty one. Repeated rows (equal id and
size) share a draw and are taken one after the other. A very long text is one
row's count. An empty table gives an empty mix. Extra columns, whatever their
names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, cut, small

MAX_EPOCHS = 3
#: Key ranges that a source, or its range with the crossing point, is cut into at a time.
BUCKETS = 4096
#: A range with the crossing point of at most this many rows is sorted.
RANGE_ROWS = 100_000
SEED = 20240
#: Signs that count against a text's quality.
NOISE = "0123456789%$#&*@|_~^\\<>{}[]="


def draw(id_col: Column, size: Column, seed: int) -> Column:
    """A stable uniform number in (0, 1) from the md5 of seed, id and size."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(id_col.cast("string"), F.lit("")), size.cast("string")).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def token_count(text: Column) -> Column:
    """The number of words; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_weight(text: Column) -> Column:
    """A weight in (0, 1] for sampling: the share of characters that are not NOISE, at least 0.05."""
    length = F.length(text)
    clean = F.length(F.translate(text, NOISE, ""))
    return F.when(length > 0, F.greatest(F.lit(0.05), clean / length)).otherwise(F.lit(0.05))


def source_targets(sizes: DataFrame, max_epochs: int = MAX_EPOCHS, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """``(src, source_size, target)`` from ``sizes (src, source_size)``, one row a source.

    Sources in code-point order, null last, have the weights in turn. With
    bounds b = max_epochs * size, the level L solves sum(min(b, L*w)) = total:
    sorted by b/w, sources up to some place are at their bound, and L follows
    from prefix sums. The windows hold one row for each source.
    """
    order = Window.orderBy(F.col("src").asc_nulls_last())
    ranked = sizes.withColumn("__k", ((F.row_number().over(order) - 1) % len(weights)).cast("int"))
    weighted = ranked.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("__k") + 1)).drop("__k")
    bound = weighted.withColumn("bound", F.col("source_size") * float(max_epochs))
    by_level = Window.orderBy(F.col("bound") / F.col("w"), F.col("src").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sums = bound.withColumns({
        "__b": F.coalesce(F.sum("bound").over(by_level) - F.col("bound"), F.lit(0.0)),
        "__w": F.sum("w").over(every) - (F.sum("w").over(by_level) - F.col("w")),
        "__total": F.sum("source_size").over(every).cast("double"),
    })
    # The level if all sources before this one are at their bounds and no other is; the highest that is consistent holds.
    level = sums.withColumn("__level", (F.col("__total") - F.col("__b")) / F.col("__w"))
    fits = F.when(F.col("__level") <= F.col("bound") / F.col("w"), F.col("__level"))
    found = level.withColumn("__l", F.max(fits).over(every))
    return found.select("src", "source_size", F.least(F.col("bound"), F.coalesce(F.col("__l") * F.col("w"), F.col("bound"))).alias("target"))


def _cross(rows: DataFrame, plan: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose range is taken whole or not at all (with ``extra``), and those of the ranges with a crossing point.

    ``rows`` have a ``bucket``; ``plan (s, rest, start, ...)`` says for each source where its
    budget ends and what lies before these rows.
    """
    sums = rows.groupBy("src", "bucket").agg(F.sum("size").alias("n"))
    before = Window.partitionBy("s").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    ranges = sums.join(plan, sums.src.eqNullSafe(plan.s)).select("s", F.col("bucket").alias("b"), "n", *[c for c in plan.columns if c != "s"])
    ranges = ranges.withColumn("before", F.col("start") + F.coalesce(F.sum("n").over(before), F.lit(0))).drop("start")
    ranges = small(cut(ranges))
    # Below the crossing point whole ranges are taken, above it none.
    state = F.when(F.col("before") + F.col("n") <= F.col("rest"), F.lit(1)).when(F.col("before") >= F.col("rest"), F.lit(0))
    met = rows.join(ranges, rows.src.eqNullSafe(ranges.s) & (rows.bucket == ranges.b)).withColumn("extra", state)
    keep = ["id", "src", "size", "key", "row", "source_size", "target", "full", "rest"]
    return met.where("extra is not null").select(*keep, "extra"), met.where("extra is null").select(*keep, F.col("before").alias("start"))


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", max_epochs: int = MAX_EPOCHS, weights: tuple[int, ...] = (1, 2, 3),
    buckets: int = BUCKETS, seed: int = SEED, range_rows: int = RANGE_ROWS,
) -> DataFrame:
    """``(doc_id, source, size, source_size, target, epochs, taken)`` of every row.

    ``taken`` is the number of tokens the mix takes of the document, repeats
    counted: ``size * epochs``.
    """
    text = F.col(text_col).cast("string")
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("src"), token_count(text).alias("size"), quality_weight(text).alias("q"), F.monotonically_increasing_id().alias("row"))
    # The exponential key -ln(u) / q; the first ranges are even in 1 - exp(-key), which lies in [0, 1) and has the same order.
    keyed = slim.select("id", "src", "size", "row", (-F.log(draw(F.col("id"), F.col("size"), seed)) / F.col("q")).alias("key"))
    keyed = cut(keyed.withColumn("bucket", F.least(F.lit(buckets - 1), F.floor((1 - F.exp(-F.col("key"))) * buckets)).cast("int")))
    targets = source_targets(keyed.groupBy("src").agg(F.sum("size").alias("source_size")), max_epochs, weights)
    plan = targets.withColumn("full", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    plan = cut(plan.select(F.col("src").alias("s"), "source_size", "target", "full", (F.col("target") - F.col("full") * F.col("source_size")).alias("rest"), F.lit(0).cast("long").alias("start")))
    sure, opened = _cross(keyed, small(plan))
    buckets = max(buckets, 16)
    opened = cut(opened)
    while True:
        ends = cut(opened.groupBy(F.col("src").alias("s")).agg(*[f("key").alias(f"{n}_key") for n, f in (("lo", F.min), ("hi", F.max))], *[f("row").alias(f"{n}_row") for n, f in (("lo", F.min), ("hi", F.max))], F.count("*").alias("rows"), *[F.first(c).alias(c) for c in ("source_size", "target", "full", "rest", "start")]))
        if ends.agg(F.coalesce(F.max("rows"), F.lit(0))).first()[0] <= range_rows:
            break
        ends = small(ends)
        part = lambda c: F.coalesce(F.try_divide(F.col(c) - F.col(f"lo_{c}"), F.col(f"hi_{c}") - F.col(f"lo_{c}")), F.lit(0.0))
        placed = opened.select("id", "src", "size", "key", "row").join(ends, F.col("src").eqNullSafe(F.col("s")))
        placed = placed.withColumn("bucket", F.least(F.lit(buckets - 1), F.floor(F.when(F.col("hi_key") > F.col("lo_key"), part("key")).otherwise(part("row")) * buckets)).cast("int"))
        more, opened = _cross(placed.select("id", "src", "size", "key", "row", "bucket"), small(ends.select("s", "source_size", "target", "full", "rest", "start")))
        sure, opened = sure.unionByName(more), cut(opened)
    in_order = Window.partitionBy("src").orderBy("key", "row").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("rest") - F.col("start") - F.coalesce(F.sum("size").over(in_order), F.lit(0))
    taken = F.when(F.col("left") <= 0, 0).when(F.col("size") <= F.col("left"), 1).when(F.col("size") - F.col("left") < F.col("left"), 1).otherwise(0)
    crossing = opened.withColumn("left", left).withColumn("extra", taken).drop("left", "start")
    epochs = F.when(F.col("size") > 0, F.col("full") + F.col("extra")).otherwise(0).cast("long")
    return sure.unionByName(crossing).select(F.col("id").alias("doc_id"), F.col("src").alias("source"), "size", "source_size", "target", epochs.alias("epochs"), (F.col("size") * epochs).alias("taken"))


#: DuckDB SQL of the mix over ``documents``: one sort a source.
ORACLE_SQL = rf"""WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS size, greatest(0.05, coalesce(length(translate(text, '{NOISE}', '')) / CAST(nullif(length(text), 0) AS DOUBLE), 0)) AS q FROM documents),
k AS (SELECT *, -ln((CAST('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || size), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0) / q AS key FROM d),
s AS (SELECT source, sum(size) AS n, CAST(((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3) + 1 AS DOUBLE) AS w FROM d GROUP BY source),
b AS (SELECT *, n * {MAX_EPOCHS}.0 AS bound, sum(n) OVER () AS total FROM s),
l AS (SELECT *, (total - (sum(bound) OVER o - bound)) / (sum(w) OVER () - (sum(w) OVER o - w)) AS level FROM b WINDOW o AS (ORDER BY bound / w, encode(source) NULLS LAST)),
t AS (SELECT *, least(bound, coalesce((SELECT max(level) FROM l WHERE level <= bound / w) * w, bound)) AS target FROM l),
p AS (SELECT *, CASE WHEN n > 0 THEN CAST(floor(target / n) AS BIGINT) ELSE 0 END AS full_epochs FROM t),
r AS (SELECT k.*, p.n AS source_size, p.target, full_epochs, target - full_epochs * p.n - coalesce(sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest FROM k JOIN p ON k.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(source_size AS BIGINT) AS source_size, target, CAST(CASE WHEN size = 0 THEN 0 ELSE size * (full_epochs + CASE WHEN rest > 0 AND (size <= rest OR size - rest < rest) THEN 1 ELSE 0 END) END AS BIGINT) AS taken FROM r"""
