"""First touches of any barrier within any horizon, by a pyramid of extremes over ticks.

Level 0 holds the highest and lowest price of every stretch of ``base`` ns, level l
those of 2^l stretches; each bucket also has its last tick. A window is then a piece of
a stretch, at most two buckets of each level, and a piece of a stretch. The first of the
buckets that touches is halved, level by level, down to one stretch, and of the ticks
only that one and the two pieces at the ends are opened. So a decision does work in
proportion to the logarithm of its horizon, and decisions of all horizons and barriers
share one pyramid and one job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.expressions import whole
from tidemark.operators.ordered import HOUR
from tidemark.session import settle

BASE = HOUR // 4


def levels_of(longest: int, base: int = BASE) -> int:
    """How many doublings make a bucket longer than any window."""
    return max(1, (longest // base).bit_length())


def pyramid(ticks: DataFrame, levels: int, base: int = BASE) -> DataFrame:
    """``(coin, level, bucket, hi, lo, last)`` of ticks ``(coin, t_event, seq, px)``; one exchange for all levels."""
    last = F.max(F.struct("t_event", "seq", "px"))
    floor = ticks.groupBy("coin", whole(F.col("t_event"), base).alias("b")).agg(F.max("px").alias("hi"), F.min("px").alias("lo"), last.alias("last"))
    up = floor.select("coin", F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("level"), "b", "hi", "lo", "last")
    return up.groupBy("coin", "level", F.expr("shiftright(b, level)").alias("bucket")).agg(F.max("hi").alias("hi"), F.min("lo").alias("lo"), F.max("last").alias("last"))


def cover(first: Column, end: Column, levels: int) -> Column:
    """The buckets ``(level, bucket)`` of which the stretches from ``first`` up to, but not with, ``end`` consist."""

    def at(level: int) -> Column:
        a, z = F.shiftright(first + ((1 << level) - 1), level), F.shiftright(end, level)
        left, right = (a % 2 != 0) & (a < z), (z % 2 != 0) & (a < z)
        one = lambda is_part, b: F.when(is_part, F.struct(F.lit(level).alias("level"), b.alias("bucket")))
        return F.array(one(left, a), one(right, z - 1))

    return F.array_compact(F.flatten(F.array(*[at(k) for k in range(levels + 1)])))


def first_touches(decisions: DataFrame, ticks: DataFrame, longest: int, base: int = BASE) -> DataFrame:
    """``decisions (key, coin, t0, horizon, upper, lower, ...)`` with ``outcome``, ``t_end`` and ``price_end``.

    Outcome 1 is the upper barrier (tested first), -1 the lower, both by the first tick
    in (t0, t0 + horizon] that reaches one; 0 a timeout, null no tick at all. No horizon
    may be above ``longest``.
    """
    levels = levels_of(longest, base)
    built = settle(pyramid(ticks, levels, base))
    start = F.col("t0") + F.col("horizon")
    slim = decisions.select("key", "coin", "t0", "horizon", "upper", "lower", (whole(F.col("t0"), base) + 1).alias("first"), whole(start, base).alias("end"))
    touched = (F.col("hi") >= F.col("upper")) | (F.col("lo") <= F.col("lower"))
    parts = slim.select("key", "coin", "upper", "lower", F.explode(cover(F.col("first"), F.col("end"), levels)).alias("p")).select("key", "coin", "upper", "lower", "p.*")
    place = F.expr("bucket * shiftleft(1L, level)")  # the first stretch of a bucket
    met = parts.join(built, ["coin", "level", "bucket"]).withColumn("hit", F.when(touched, place))
    found = met.groupBy("key", "coin", "upper", "lower").agg(F.min_by(F.struct("level", "bucket"), "hit").alias("at"), F.max("last").alias("last"))
    found = found.select("key", "coin", "upper", "lower", "last", "at.level", "at.bucket")
    for level in range(levels, 0, -1):  # into the earlier half if it touches, else into the later one
        half = built.where(F.col("level") == level - 1).select("coin", F.col("bucket").alias("half"), "hi", "lo")
        earlier = found.withColumn("half", F.when(F.col("level") == level, F.col("bucket") * 2)).join(half, ["coin", "half"], "left")
        down = F.when(F.col("level") == level, F.when(touched, F.col("half")).otherwise(F.col("half") + 1)).otherwise(F.col("bucket"))
        found = earlier.select("key", "coin", "upper", "lower", "last", F.when(F.col("level") == level, level - 1).otherwise(F.col("level")).alias("level"), down.alias("bucket"))
    known = slim.join(found.select("key", "last", "bucket"), "key", "left")
    opened = known.select("key", "coin", "t0", "horizon", "upper", "lower", F.explode(F.array_distinct(F.array_compact(F.array(F.col("first") - 1, "bucket", "end")))).alias("b"))
    inside = opened.join(ticks.select("coin", "t_event", "seq", "px", whole(F.col("t_event"), base).alias("b")), ["coin", "b"]).where((F.col("t_event") > F.col("t0")) & (F.col("t_event") <= start))
    side = F.when(F.col("px") >= F.col("upper"), 1).when(F.col("px") <= F.col("lower"), -1)
    tick = F.struct("t_event", "seq", "px")
    ends = inside.withColumn("side", side).groupBy("key").agg(F.min(F.when(F.col("side").isNotNull(), F.struct("t_event", "seq", "px", "side"))).alias("touch"), F.max(tick).alias("late"))
    j = decisions.join(known.select("key", "last"), "key", "left").join(ends, "key", "left")
    final = F.greatest("last", "late")
    return j.select(
        *decisions.columns, F.coalesce("touch.side", F.when(final.isNotNull(), 0)).alias("outcome"),
        F.coalesce("touch.t_event", F.when(final.isNotNull(), start)).alias("t_end"), F.coalesce("touch.px", final["px"]).alias("price_end"),
    )
