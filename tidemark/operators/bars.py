"""Time bars in event time, and rolling statistics over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.expressions import whole
from tidemark.operators.ordered import HOUR


def bars(prints: DataFrame, interval: int = HOUR) -> DataFrame:
    """Bars of a width in ns: event time decides membership, arrival decides ``available_at``.

    One aggregation with partial sums; buckets without prints have no bar.
    """
    start = (whole(F.col("t_event"), interval) * interval).cast("long")
    at = F.struct("t_event", "seq")
    notional = (F.col("px").cast("decimal(20,6)") * F.col("sz").cast("decimal(12,3)")).cast("decimal(32,9)")
    rows = prints.groupBy("coin", start.alias("t_open")).agg(
        F.min_by("px", at).alias("open"), F.max("px").alias("high"), F.min("px").alias("low"), F.max_by("px", at).alias("close"),
        F.sum(F.col("sz").cast("decimal(12,3)")).cast("double").alias("volume"), F.sum(notional).cast("double").alias("notional"), F.count("*").alias("prints"), F.max("t_ingest").alias("__last"),
    )
    close = F.col("t_open") + interval
    return rows.withColumn("t_close", close).withColumn("available_at", F.greatest("__last", "t_close")).drop("__last")


def ratios(found: DataFrame) -> DataFrame:
    """vwap, ret and range of bars; 0 where the denominator is 0."""
    safe = lambda x, y: F.when(y != 0, x / y).otherwise(F.lit(0.0))
    c = F.col
    return found.withColumns({"vwap": F.round(safe(c("notional"), c("volume")), 6), "ret": F.round(safe(c("close") - c("open"), c("open")), 9), "range": F.round(safe(c("high") - c("low"), c("open")), 9)})


def rows_back(keys: list[str], order: list[str], n: int) -> Window:
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(-(n - 1), Window.currentRow)


def rolling_z(value: Column, over: Window, n: int) -> Column:
    """z-score in a window with this row, null until it is full, 0 where flat."""
    if n < 2:
        return F.lit(None).cast("double")
    sd = F.stddev_samp(value).over(over)
    full = F.count(value).over(over) == n
    return F.when(full & value.isNotNull(), F.when(F.round(sd, 12) == 0, F.lit(0.0)).otherwise((value - F.avg(value).over(over)) / sd))


def with_sigma(found: DataFrame, n: int = 30, regime: int = 120) -> DataFrame:
    """Bars with log returns, their rolling deviation, and that over its trailing upper median.

    The windows run over bars, a summary of the prints that is orders of magnitude smaller.
    """
    ordered = Window.partitionBy("coin").orderBy("t_open")
    r = found.withColumn("lr", F.log(F.col("close") / F.lag("close").over(ordered)))
    over = rows_back(["coin"], ["t_open"], n)
    sd = F.when(F.count("lr").over(over) == n, F.round(F.stddev_samp("lr").over(over), 9))
    r = r.withColumn("sigma", sd)
    kept = F.sort_array(F.collect_list(F.when(F.col("sigma") != 0, F.col("sigma"))).over(rows_back(["coin"], ["t_open"], regime)))
    median = F.when(F.size(kept) > 0, F.element_at(kept, F.floor(F.size(kept) / 2).cast("int") + 1))
    return r.withColumn("sigma_regime", F.round(F.col("sigma") / median, 6))
