"""Queries of keys and scales: clock keys, release times, costs, scaled maps, names, page text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import expressions as X
from tidemark.operators import bars as B
from tidemark.plans import market
from tidemark.sources import views as V


def tape_keys(spark: SparkSession, d: str) -> DataFrame:
    """Prints by the keys under which their files lie: hour, day and ISO week of arrival."""
    at = F.col("t_ingest")
    return V.tape(spark, d).groupBy("coin", X.hour_key(at).alias("hour_key"), X.day_key(at).alias("day_key"), X.week_key(at).alias("week_key")).agg(F.count("*").alias("n"))


def release_times(spark: SparkSession, d: str) -> DataFrame:
    """Order dates as releases at 14:00 in New York, in UTC nanoseconds."""
    o = V.table(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("n"))
    return o.select(F.date_format("day", "yyyy-MM-dd").alias("day"), X.wall_ns(F.col("day").cast("timestamp_ntz") + F.expr("interval 14 hours")).alias("release_ns"), "n")


def bar_costs(spark: SparkSession, d: str) -> DataFrame:
    """Each bar's move in basis points and, for each way of trading, from which probability a bet on it pays; with the digest of the costs."""
    b = B.bars(V.prints(spark, d)).select("coin", "t_open", F.round(F.abs(F.col("close") / F.col("open") - 1) * 10000, 6).alias("move_bps"))
    ways = [F.struct(F.lit(way).alias("way"), F.round(X.worth_betting(F.col("move_bps"), terms), 9).alias("threshold"), F.lit(X.cost_id(terms)).alias("cost_id")) for way, terms in X.COSTS.items()]
    return b.select("coin", "t_open", "move_bps", F.explode(F.array(*ways)).alias("w")).select("coin", "t_open", "move_bps", "w.*")


def held_for(spark: SparkSession, d: str) -> DataFrame:
    """Prints by a written stretch of time (hours and minutes, or seconds, by their size), in nanoseconds; some texts are none."""
    text = F.when(F.col("k") % 5 == 0, F.concat(F.col("k"), F.lit("s"))).when(F.col("k") % 7 == 0, F.concat(F.lit("k"), F.col("k"))).otherwise(F.concat(F.col("k") % 24, F.lit("h"), F.col("k") % 60, F.lit(".5m")))
    t = V.tape(spark, d).groupBy("coin", text.alias("text")).agg(F.count("*").alias("n"))
    return t.select("coin", "text", X.stretch_ns_of(F.col("text")).alias("ns"), "n")


def iso_times(spark: SparkSession, d: str) -> DataFrame:
    """Order dates as ISO texts with an offset by the order, with Z or bare, and their instants."""
    o = V.table(spark, d, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), (F.col("o_orderkey") % 5).alias("z"))
    at = F.concat("day", F.lit("T14:30:00.25"), F.element_at(F.array(*map(F.lit, ("", "Z", "+02:00", "-05:30", "+0900"))), (F.col("z") + 1).cast("int")))
    return o.groupBy(at.alias("text")).agg(F.count("*").alias("n")).select("text", X.iso_ns(F.col("text")).alias("ns"), "n")


def map_scaled(spark: SparkSession, d: str) -> DataFrame:
    """Distances of maps' nearest clusters in daily sigmas and band masses over the day's volume."""
    m = V.map_rows(spark, d).select("coin", "seq", "near_up", "near_down", "up4", "down4")
    c = V.contexts(spark, d).select("coin", "seq", "day_volume")
    s = market.daily_sigma(spark, d).select("coin", "daily_sigma")  # a row a coin: adaptive execution broadcasts it by its size
    j = m.join(c, ["coin", "seq"]).join(s, "coin", "left")
    scaled = {f"{k}_sigma": F.round(X.over(F.col(k), F.col("daily_sigma")), 6) for k in ("near_up", "near_down")} | {f"{k}_volume": F.round(X.over(F.col(k), F.col("day_volume")), 9) for k in ("up4", "down4")}
    return j.select("coin", "seq", *[c.alias(n) for n, c in scaled.items()])


def namespaces(spark: SparkSession, d: str) -> DataFrame:
    """Coins by venue: names with a namespace (one print in four here) apart from bare ones."""
    name = F.when(F.col("k") % 4 == 0, F.concat(F.lit("dex"), (F.col("k") % 3).cast("string"), F.lit(":"), "coin")).otherwise(F.col("coin"))
    t = V.tape(spark, d).select(name.alias("name"))
    dex = F.when(X.is_namespaced(F.col("name")), F.split_part("name", F.lit(":"), F.lit(1)))
    return t.groupBy("name", dex.alias("dex")).agg(F.count("*").alias("n"))


def page_plain(spark: SparkSession, d: str) -> DataFrame:
    """Pages without their tags: length and digest of the text."""
    text = X.without_markup(F.col("html"))
    return V.table(spark, d, "pages").select("page_id", F.length(text).cast("long").alias("n_chars"), F.md5(text).alias("text_md5"))


QUERIES = {f.__name__: f for f in (tape_keys, release_times, bar_costs, held_for, iso_times, map_scaled, namespaces, page_plain)}

_DAILY = market.SQL["daily_sigma"]
SQL = {
    "tape_keys": V.with_views("tape") + "SELECT coin, strftime(w, '%Y%m%dT%H') AS hour_key, strftime(w, '%Y-%m-%d') AS day_key, strftime(w, '%G-W%V') AS week_key, count(*) AS n FROM (SELECT coin, make_timestamp(t_ingest // 1000) AS w FROM tape) GROUP BY 1, 2, 3, 4",
    "release_times": "SELECT strftime(day, '%Y-%m-%d') AS day, epoch_us(timezone('America/New_York', day + INTERVAL 14 HOUR)) * 1000 AS release_ns, n FROM (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders GROUP BY 1)",
    "bar_costs": market.sql("bars") + """SELECT coin, t_open, move_bps, way, CASE WHEN move_bps > 0 THEN round(least(0.99::DOUBLE, 0.5::DOUBLE + 2.0::DOUBLE * bps / (2 * move_bps)), 9) ELSE 1.0::DOUBLE END AS threshold, sha256(fee || chr(10) || listed) AS cost_id
        FROM (SELECT coin, t_open, round(abs(close / open - 1) * 10000, 6) AS move_bps FROM bars), (VALUES ('maker', 6.0::DOUBLE), ('taker', 12.0::DOUBLE)) w(way, bps),
        (SELECT 'funding' || chr(9) || '0.0' || chr(9) || '1' || chr(9) || 'True' || chr(10) || 'half spread' || chr(9) || '1.0' || chr(9) || '2' || chr(9) || 'False' AS fixed), LATERAL (SELECT CASE way WHEN 'maker' THEN fixed || chr(10) || 'maker fee' || chr(9) || '1.5' || chr(9) || '2' || chr(9) || 'False' ELSE fixed END AS fee,
        CASE way WHEN 'maker' THEN 'slippage' || chr(9) || '1.0' || chr(9) || '1' || chr(9) || 'False' ELSE 'slippage' || chr(9) || '1.0' || chr(9) || '1' || chr(9) || 'False' || chr(10) || 'taker fee' || chr(9) || '4.5' || chr(9) || '2' || chr(9) || 'False' END AS listed)""",
    "held_for": V.with_views("tape") + """SELECT coin, text, CASE WHEN k % 5 = 0 THEN CAST(k AS BIGINT) * 1000000000 WHEN k % 7 = 0 THEN NULL ELSE CAST(k % 24 AS BIGINT) * 3600000000000 + CAST(k % 60 AS BIGINT) * 60000000000 + 30000000000 END AS ns, n
        FROM (SELECT coin, CASE WHEN k % 5 = 0 THEN k || 's' WHEN k % 7 = 0 THEN 'k' || k ELSE (k % 24) || 'h' || (k % 60) || '.5m' END AS text, max(k) AS k, count(*) AS n FROM tape GROUP BY 1, 2)""",
    "iso_times": """SELECT text, epoch_us(CAST(CASE WHEN text LIKE '%25' THEN text || 'Z' WHEN text LIKE '%+0900' THEN replace(text, '+0900', '+09:00') ELSE text END AS TIMESTAMPTZ)) * 1000 AS ns, n
        FROM (SELECT strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') || 'T14:30:00.25' || (['', 'Z', '+02:00', '-05:30', '+0900'])[o_orderkey % 5 + 1] AS text, count(*) AS n FROM orders GROUP BY 1)""",
    "map_scaled": market.sql("map_rows", "bars").rstrip() + f""", sig AS (SELECT coin, daily_sigma FROM ({_DAILY[_DAILY.rindex("SELECT coin, count(*) AS closes") :]}))
        SELECT m.coin, m.seq, round(near_up / nullif(daily_sigma, 0), 6) AS near_up_sigma, round(near_down / nullif(daily_sigma, 0), 6) AS near_down_sigma, round(up4 / nullif(day_volume, 0), 9) AS up4_volume, round(down4 / nullif(day_volume, 0), 9) AS down4_volume
        FROM map_rows m JOIN contexts c ON m.coin = c.coin AND m.seq = c.seq LEFT JOIN sig s ON m.coin = s.coin""",
    "namespaces": V.with_views("tape") + "SELECT name, CASE WHEN contains(name, ':') THEN split_part(name, ':', 1) END AS dex, count(*) AS n FROM (SELECT CASE WHEN k % 4 = 0 THEN 'dex' || (k % 3) || ':' || coin ELSE coin END AS name FROM tape) GROUP BY 1, 2",
    "page_plain": r"SELECT page_id, length(t) AS n_chars, md5(t) AS text_md5 FROM (SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '[ \t\n\x0B\f\r]+', ' ', 'g')) AS t FROM pages)",
}
