"""Path-dependent labels by first touch, and weights of overlapping spans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ordered import HOUR, previous, running_sum


def first_touch(decisions: DataFrame, ticks: DataFrame, horizon: int, micro: int = HOUR // 4) -> DataFrame:
    """``decisions`` with ``outcome``, ``t_end`` and ``price_end`` of the first tick in (t0, t0 + horizon] beyond a barrier.

    ``decisions`` has key, coin, t0, upper, lower; ``ticks`` has coin, t_event,
    seq, px. Outcome 1 is the upper barrier (tested first), -1 the lower, 0 a
    timeout, null no tick at all.

    Ticks are summed up to micro-bars first. A decision meets the micro-bars of
    the two horizon-long chunks that it spans (an equi join), and of these only
    the first, the last, the last whole one and the first whole one that
    touches are opened to ticks: no decision reads its whole window.
    """
    bars = ticks.groupBy("coin", F.floor(F.col("t_event") / micro).alias("m")).agg(F.max("px").alias("hi"), F.min("px").alias("lo"))
    bars = bars.withColumn("chunk", F.floor(F.col("m") * micro / horizon))
    first, last = F.floor(F.col("t0") / horizon), F.floor((F.col("t0") + horizon) / horizon)
    spans = decisions.select("key", "coin", "t0", "upper", "lower", F.explode(F.sequence(first, last)).alias("chunk"))
    start, end = F.col("m") * micro, (F.col("m") + 1) * micro
    near = spans.join(bars, ["coin", "chunk"]).where((end > F.col("t0")) & (start <= F.col("t0") + horizon))
    whole = (start > F.col("t0")) & (end <= F.col("t0") + horizon)
    touched = whole & ((F.col("hi") >= F.col("upper")) | (F.col("lo") <= F.col("lower")))
    picks = near.groupBy("key", "coin", "t0", "upper", "lower").agg(F.array_distinct(F.array_compact(F.array(F.min("m"), F.max("m"), F.max(F.when(whole, F.col("m"))), F.min(F.when(touched, F.col("m")))))).alias("ms"))
    opened = picks.select("key", "coin", "t0", "upper", "lower", F.explode("ms").alias("m"))
    inside = opened.join(ticks.withColumn("m", F.floor(F.col("t_event") / micro)), ["coin", "m"]).where((F.col("t_event") > F.col("t0")) & (F.col("t_event") <= F.col("t0") + horizon))
    side = F.when(F.col("px") >= F.col("upper"), 1).when(F.col("px") <= F.col("lower"), -1)
    at = F.struct("t_event", "seq")
    ends = inside.withColumn("side", side).groupBy("key").agg(
        F.min_by(F.struct("side", "t_event", "px"), F.when(F.col("side").isNotNull(), at)).alias("hit"), F.max_by("px", at).alias("last_px"),
    )
    j = decisions.join(ends, "key", "left")
    timeout = F.col("last_px").isNotNull()
    return j.select(
        *decisions.columns, F.coalesce(F.col("hit.side"), F.when(timeout, F.lit(0))).alias("outcome"),
        F.coalesce(F.col("hit.t_event"), F.when(timeout, F.col("t0") + horizon)).alias("t_end"), F.coalesce(F.col("hit.px"), F.col("last_px")).alias("price_end"),
    )


def uniqueness(spans: DataFrame) -> DataFrame:
    """``(key, weight)`` of spans (key, coin, t0, t_end): the time-weighted mean of 1/concurrency; 1 for empty spans.

    An edge sweep: running concurrency, the integral F of dt/c at every edge,
    and a span's weight is (F(end) - F(start)) / length.
    """
    edges = spans.select("coin", F.explode(F.array(F.struct(F.col("t0").alias("t"), F.lit(1).alias("d")), F.struct(F.col("t_end").alias("t"), F.lit(-1).alias("d")))).alias("e"))
    steps = edges.groupBy("coin", F.col("e.t").alias("t")).agg(F.sum("e.d").alias("d"))
    open_spans = running_sum(steps, ["coin"], "t", [], F.col("d"), "c").select("coin", "t", "c")
    moved = previous(open_spans, ["coin"], "t", [], ["t", "c"])
    part = F.when(F.col("prev_c") > 0, (F.col("t") - F.col("prev_t")) / F.col("prev_c")).otherwise(0.0)
    area = running_sum(moved, ["coin"], "t", [], part, "area").select("coin", "t", "area")
    a = area.select("coin", F.col("t").alias("t0"), F.col("area").alias("a0"))
    b = area.select("coin", F.col("t").alias("t_end"), F.col("area").alias("a1"))
    j = spans.join(a, ["coin", "t0"]).join(b, ["coin", "t_end"])
    return j.select("key", F.when(F.col("t_end") > F.col("t0"), (F.col("a1") - F.col("a0")) / (F.col("t_end") - F.col("t0"))).otherwise(1.0).alias("weight"))
