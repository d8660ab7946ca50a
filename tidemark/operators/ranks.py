"""Exact ranks and order statistics of groups of any size, without a window over a group.

`ranked` numbers rows by ranges: rows are range-partitioned and sorted by (keys, order),
so a hot key lies in as many tasks as it needs; each task's rows of a key are counted,
the counts of the tasks before give an offset, and a row's rank is its offset and its
place in its task.

`selected` finds the values at given ranks by refined histograms: rows are counted in
bins between a group's least and greatest value, and only the bin that holds a rank is
looked into again, until it is of one value or has at most `LEAF` rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import settle

BINS = 1024
#: Bins with at most this many rows are sorted.
LEAF = 4096
_PLACE = 33  # bits of monotonically_increasing_id() that number the rows of a partition


def ranked(df: DataFrame, keys: list[str], order: list[Column], name: str) -> DataFrame:
    """``df`` with each row's rank from 0 within its key, in ``order``; equal rows of the order get ranks in any order.

    The sorted rows are written to the shared folder once, since a rank is only as
    stable as the ranges that it was counted in.
    """
    by = [*[F.col(c) for c in keys], *order]
    at = settle(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__at", F.monotonically_increasing_id()))
    at = at.withColumn("__range", F.shiftright("__at", _PLACE))
    runs = at.groupBy(*keys, "__range").agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    before = F.sum("__n").over(Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))  # a row a key and task
    offset = runs.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(keys)], F.col("__range").alias("__r"), "__first", F.coalesce(before, F.lit(0)).alias("__before"))
    same = F.col("__range") == F.col("__r")
    for i, c in enumerate(keys):
        same = same & F.col(c).eqNullSafe(F.col(f"__k{i}"))
    return at.join(offset, same).select(*df.columns, (F.col("__before") + F.col("__at") - F.col("__first")).alias(name))


def selected(df: DataFrame, keys: list[str], value: str, ranks: dict[str, Column], bins: int = BINS, leaf: int = LEAF) -> DataFrame:
    """``(*keys, n, *ranks)``: the values of each group at the given ranks (Columns over ``n``, the group's count, from 0).

    Null values and values that are no number are left out; ranks beyond a group are null.
    """
    rows = settle(df.select(*keys, F.col(value).alias("__v")).where(F.col("__v").isNotNull() & ~F.isnan(F.col("__v").cast("double"))))
    told = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi"))
    wanted = F.array(*[F.struct(F.lit(name).alias("__name"), rank.cast("long").alias("__k")) for name, rank in ranks.items()])
    told = settle(told)
    open_ = told.select(*keys, F.explode(wanted).alias("w"), "n", "__lo", "__hi").select(*keys, "w.*", "n", "__lo", "__hi").where((F.col("__k") >= 0) & (F.col("__k") < F.col("n")))
    open_ = settle(open_.withColumnRenamed("n", "__n"))
    done = None
    while True:
        ready = (F.col("__lo") == F.col("__hi")) | (F.col("__n") <= leaf)
        part = open_.where(ready)
        done = part if done is None else done.unionByName(part)
        open_ = open_.where(~ready)
        if open_.isEmpty():
            break
        span = F.col("__hi").cast("double") - F.col("__lo").cast("double")
        place = F.least(F.lit(bins - 1), F.floor((F.col("__v").cast("double") - F.col("__lo").cast("double")) / span * bins))
        inside = rows.join(open_.withColumnRenamed("__n", "__size"), keys).where((F.col("__v") >= F.col("__lo")) & (F.col("__v") <= F.col("__hi")))
        counts = inside.groupBy(*keys, "__name", "__k", place.alias("__b")).agg(F.count("*").alias("__n"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi"))
        over = Window.partitionBy(*keys, "__name").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)  # at most ``bins`` rows
        upto = counts.withColumn("__before", F.coalesce(F.sum("__n").over(over), F.lit(0)))
        found = upto.where((F.col("__k") >= F.col("__before")) & (F.col("__k") < F.col("__before") + F.col("__n")))
        open_ = settle(found.select(*keys, "__name", (F.col("__k") - F.col("__before")).alias("__k"), "__n", "__lo", "__hi"))
    one = done.where("__lo = __hi").select(*keys, "__name", F.col("__lo").alias("__v"))
    few = rows.join(done.where("__lo < __hi"), keys).where((F.col("__v") >= F.col("__lo")) & (F.col("__v") <= F.col("__hi")))
    few = few.groupBy(*keys, "__name").agg(F.element_at(F.sort_array(F.collect_list("__v")), (F.first("__k") + 1).cast("int")).alias("__v"))  # at most ``leaf`` rows
    both = one.unionByName(few).groupBy(*keys).agg(*[F.max(F.when(F.col("__name") == name, F.col("__v"))).alias(name) for name in ranks])
    return told.select(*keys, "n").join(both, keys, "left")
