"""Ordered operators in two levels, so that a hot key is never ordered in one task.

Rows are dealt by (key, chunk of time); the ordered work happens inside a chunk,
each chunk leaves one row, a window over those few rows gives every chunk what
comes before it, and an equi join brings it back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOUR = 3_600_000_000_000
DAY = 24 * HOUR


def _before(keys: list[str]) -> Window:
    return Window.partitionBy(*keys).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)


def asof(left: DataFrame, right: DataFrame, on: list[str], left_time: str, right_time: str, take: list[str], tie: list[str] = [], strict: bool = False, chunk: int = DAY) -> DataFrame:  # noqa: B006
    """``left`` with ``take`` of the last row of ``right`` at or before ``left_time``.

    ``strict`` wants a row before it. Equal times of ``right`` are ordered by
    ``tie``. Without such a row ``take`` is null.
    """
    packed_left = F.struct(*[F.col(c) for c in left.columns])
    packed_right = F.struct(*[F.col(c) for c in take])
    order = lambda cols: F.struct(*[F.col(c) for c in cols])
    l = left.select(*on, F.col(left_time).alias("__t"), F.lit(0 if strict else 1).alias("__side"), packed_left.alias("__l"))
    r = right.select(*on, F.col(right_time).alias("__t"), F.lit(1 if strict else 0).alias("__side"), packed_right.alias("__r"), order(tie or [right_time]).alias("__tie"))
    rows = l.unionByName(r, allowMissingColumns=True).withColumn("__chunk", F.floor(F.col("__t") / chunk))
    by = [*on, "__chunk"]
    inside = Window.partitionBy(*by).orderBy("__t", "__side", "__tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = rows.withColumn("__in", F.last("__r", ignorenulls=True).over(inside)).where(F.col("__l").isNotNull())
    ends = rows.groupBy(*by).agg(F.max_by("__r", F.when(F.col("__r").isNotNull(), F.struct("__t", "__tie"))).alias("__end"))
    carry = ends.withColumn("__carry", F.last("__end", ignorenulls=True).over(_before(on))).drop("__end")
    found = seen.join(carry, by, "left").select("__l.*", F.coalesce("__in", "__carry").alias("__got"))
    return found.select(*left.columns, *[F.col("__got")[c].alias(c) for c in take])


def running_sum(df: DataFrame, keys: list[str], time: str, order: list[str], value: Column, name: str, chunk: int = DAY) -> DataFrame:
    """``df`` with the sum of ``value`` over the key's rows up to this one, in the order (time, *order)."""
    rows = df.withColumn("__chunk", F.floor(F.col(time) / chunk)).withColumn("__v", value)
    by = [*keys, "__chunk"]
    inside = Window.partitionBy(*by).orderBy(time, *order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carry = rows.groupBy(*by).agg(F.sum("__v").alias("__s")).withColumn("__carry", F.sum("__s").over(_before(keys))).drop("__s")
    summed = rows.withColumn("__in", F.sum("__v").over(inside)).join(carry, by)
    return summed.withColumn(name, F.col("__in") + F.coalesce("__carry", F.lit(0))).drop("__in", "__carry", "__chunk", "__v")


def previous(df: DataFrame, keys: list[str], time: str, order: list[str], columns: list[str], chunk: int = DAY) -> DataFrame:
    """``df`` with ``prev_<c>`` of the key's row before this one, in the order (time, *order)."""
    rows = df.withColumn("__chunk", F.floor(F.col(time) / chunk))
    by = [*keys, "__chunk"]
    packed = F.struct(*[F.col(c) for c in columns])
    at = F.struct(time, *order)
    carry = rows.groupBy(*by).agg(F.max_by(packed, at).alias("__end")).withColumn("__carry", F.last("__end").over(_before(keys))).drop("__end")
    inside = Window.partitionBy(*by).orderBy(time, *order)
    found = rows.withColumn("__in", F.lag(packed).over(inside)).join(carry, by).withColumn("__p", F.coalesce("__in", "__carry"))
    return found.select(*df.columns, *[F.col("__p")[c].alias(f"prev_{c}") for c in columns])


def blocks(df: DataFrame, keys: list[str], time: str, order: list[str], n: int, size: int = 100_000) -> DataFrame:
    """``df`` dealt into blocks of ``size`` rows of a key, with the ``n - 1`` rows before each block in front of it.

    Windows over the last ``n`` rows by (*keys, __block) in the order ``__i`` are
    exact on rows with ``__own``; the others are only there for them.
    """
    numbered = running_sum(df, keys, time, order, F.lit(1).cast("long"), "__i")
    own = F.floor((F.col("__i") - 1) / size)
    late = (F.col("__i") - 1) % size >= size - (n - 1)
    dealt = numbered.select("*", F.posexplode(F.when(late, F.array(own, own + 1)).otherwise(F.array(own))).alias("__p", "__block"))
    return dealt.withColumn("__own", F.col("__p") == 0).drop("__p")


def rolling(df: DataFrame, keys: list[str], time: str, order: list[str], n: int, columns, size: int = 100_000) -> DataFrame:
    """``df`` with ``columns(window)``, a dict of Columns over each row and the ``n - 1`` before it, in blocks."""
    over = Window.partitionBy(*keys, "__block").orderBy("__i").rowsBetween(-(n - 1), Window.currentRow)
    return blocks(df, keys, time, order, n, size).withColumns(columns(over)).where("__own").drop("__i", "__block", "__own")


def kth(column: Column, value: str, k: Column) -> Column:
    """The element at place ``k`` (from 0) of a group's sorted values."""
    return F.element_at(F.sort_array(F.collect_list(value)), k + 1)
