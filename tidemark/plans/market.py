"""Queries over the tape: scans, bars, contexts, as-of joins, silences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.expressions import whole
from tidemark.operators import bars as B
from tidemark.operators.ordered import DAY, HOUR, asof, previous, rolling, running_sum
from tidemark.operators.ranks import selected
from tidemark.session import settle
from tidemark.sources import views as V

MINUTE = 60_000_000_000
#: A silence: no arrival of a coin for this long.
QUIET = 90 * MINUTE
#: Views that several queries read, with what they read themselves.
MORE = {
    "bars": (["prints"], """bars AS (SELECT coin, t_open, t_open + 3600000000000 AS t_close, arg_min(px, t_event) AS open, max(px) AS high, min(px) AS low, arg_max(px, t_event) AS close,
        CAST(sum(CAST(sz AS DECIMAL(12,3))) AS DOUBLE) AS volume, CAST(sum(CAST(px AS DECIMAL(20,6)) * CAST(sz AS DECIMAL(12,3))) AS DOUBLE) AS notional, count(*) AS prints, greatest(max(t_ingest), t_open + 3600000000000) AS available_at
        FROM (SELECT *, (t_event // 3600000000000) * 3600000000000 AS t_open FROM prints) GROUP BY coin, t_open)"""),
    "sigmas": (["bars"], """sigmas AS (SELECT *, round(sigma / CASE WHEN len(kept) > 0 THEN list_sort(kept)[CAST(floor(len(kept) / 2) AS INT) + 1] END, 6) AS sigma_regime FROM
        (SELECT *, list(CASE WHEN sigma <> 0 THEN sigma END) FILTER (sigma IS NOT NULL AND sigma <> 0) OVER (PARTITION BY coin ORDER BY t_open ROWS BETWEEN 119 PRECEDING AND CURRENT ROW) AS kept FROM
        (SELECT *, CASE WHEN count(lr) OVER w = 30 THEN round(stddev_samp(lr) OVER w, 9) END AS sigma FROM
        (SELECT *, ln(close / lag(close) OVER (PARTITION BY coin ORDER BY t_open)) AS lr FROM bars)
        WINDOW w AS (PARTITION BY coin ORDER BY t_open ROWS BETWEEN 29 PRECEDING AND CURRENT ROW))))"""),
}


def sql(*names: str) -> str:
    return V.with_views(*names, more=MORE)


def scan_tape(spark: SparkSession, d: str) -> DataFrame:
    return V.tape(spark, d)


def scan_since(spark: SparkSession, d: str) -> DataFrame:
    since = 1704499200000000000  # 2024-01-06
    return V.tape(spark, d).where(F.col("t_ingest") >= since).select("coin", "seq", "t_ingest")


def prints(spark: SparkSession, d: str) -> DataFrame:
    return V.prints(spark, d).select("coin", "seq", "t_event", "t_ingest", "px", "sz")


def tape_parties(spark: SparkSession, d: str) -> DataFrame:
    return V.prints(spark, d).select("coin", "seq", F.posexplode(F.array("buyer", "seller")).alias("side", "party"))


def contexts(spark: SparkSession, d: str) -> DataFrame:
    c = V.contexts(spark, d)
    return c.select("coin", "seq", "t_ingest", "mark", F.round("oracle", 9).alias("oracle"), F.round("funding", 9).alias("funding"), "open_interest", "day_volume")


def map_rows(spark: SparkSession, d: str) -> DataFrame:
    m = V.map_rows(spark, d)
    return m.select("coin", "seq", "t_ingest", *[f"{s}{i}" for s in ("up", "down") for i in range(1, 5)], F.round("near_up", 6).alias("near_up"), F.round("near_down", 6).alias("near_down"))


def event_time(spark: SparkSession, d: str) -> DataFrame:
    """The newest event time per coin and hour of arrival; null for streams without a clock."""
    hour = whole(F.col("t_ingest"), HOUR)
    return V.tape(spark, d).groupBy("coin", hour.alias("hour")).agg(F.max(F.when(F.col("coin") != "error", F.col("t_event"))).alias("t_event"))


def bars(spark: SparkSession, d: str) -> DataFrame:
    return B.ratios(B.bars(V.prints(spark, d)))


def bars_visible(spark: SparkSession, d: str) -> DataFrame:
    return B.bars(V.prints(spark, d)).where(F.col("available_at") <= 1705276800000000000).select("coin", "t_open", "available_at")


def bars_lag(spark: SparkSession, d: str) -> DataFrame:
    """The newest 20 bars of each coin and how late they became available."""
    newest = F.row_number().over(Window.partitionBy("coin").orderBy(F.desc("t_open")))
    return B.bars(V.prints(spark, d)).withColumn("n", newest).where("n <= 20").select("coin", "t_open", "n", ((F.col("available_at") - F.col("t_close")) / 1e9).alias("lag_s"))


def sigma(spark: SparkSession, d: str) -> DataFrame:
    return B.with_sigma(B.bars(V.prints(spark, d))).select("coin", "t_open", "sigma", "sigma_regime")


def daily_sigma(spark: SparkSession, d: str) -> DataFrame:
    """Realised daily volatility of hourly closes; null under 25 closes."""
    r = B.bars(V.prints(spark, d)).withColumn("lr", F.log(F.col("close") / F.lag("close").over(Window.partitionBy("coin").orderBy("t_open"))))
    return r.groupBy("coin").agg(F.count("*").alias("closes"), F.when(F.count("*") >= 25, F.round(F.stddev_samp("lr") * F.sqrt(F.lit(24.0)), 9)).alias("daily_sigma"))


def latest_ctx(spark: SparkSession, d: str) -> DataFrame:
    return V.marks(spark, d)


def ctx_features(spark: SparkSession, d: str, n: int = 20) -> DataFrame:
    """Premium, notional of open interest and rolling z-scores of each context."""
    return context_features(V.contexts(spark, d), n).select("coin", "seq", "premium", "oi_notional", "premium_z", "funding_z", "oi_z")


def context_features(c: DataFrame, n: int = 20) -> DataFrame:
    """Contexts with their features; the windows run in blocks, so a hot coin lies in many tasks."""
    premium = F.when(F.col("oracle") != 0, F.round((F.col("mark") - F.col("oracle")) / F.col("oracle"), 12)).otherwise(0.0)
    z = lambda name, over: F.round(B.rolling_z(F.col(name), over, n), 6)
    c = rolling(c.withColumn("premium", premium), ["coin"], "t_ingest", ["seq"], n, lambda w: {"premium_z": z("premium", w), "funding_z": z("funding", w), "oi_z": z("open_interest", w)})
    return c.withColumns({"premium": F.round("premium", 9), "oi_notional": F.round(F.col("open_interest") * F.col("mark"), 6)})


def rolling_z(spark: SparkSession, d: str, n: int = 20) -> DataFrame:
    c = rolling(V.contexts(spark, d), ["coin"], "t_ingest", ["seq"], n, lambda w: {"z": F.round(B.rolling_z(F.col("open_interest"), w, n), 6)})
    return c.select("coin", "seq", "z")


def finite(spark: SparkSession, d: str) -> DataFrame:
    s = B.with_sigma(B.bars(V.prints(spark, d)))
    good = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return s.where(good("close") & good("sigma") & good("sigma_regime")).select("coin", "t_open", "close", "sigma")


def asof_context(spark: SparkSession, d: str) -> DataFrame:
    """Each bar with the last context that had arrived when the bar was available."""
    with V.one_tape(spark, d):
        return _asof_context(spark, d)


def _asof_context(spark: SparkSession, d: str) -> DataFrame:
    b = B.bars(V.prints(spark, d)).select("coin", "t_open", "available_at")
    c = V.contexts(spark, d).select("coin", "seq", "t_ingest", "mark", "open_interest")
    return asof(b, c, ["coin"], "available_at", "t_ingest", ["seq", "mark", "open_interest"], tie=["seq"])


def asof_map(spark: SparkSession, d: str) -> DataFrame:
    b = B.bars(V.prints(spark, d)).select("coin", "t_open", "available_at")
    m = V.map_rows(spark, d).select("coin", F.col("seq").alias("map_seq"), F.col("t_ingest").alias("map_t"), "up4", "down4")
    found = asof(b, m, ["coin"], "available_at", "map_t", ["map_seq", "map_t", "up4", "down4"], tie=["map_seq"])
    return found.select("coin", "t_open", "map_seq", "up4", "down4", ((F.col("available_at") - F.col("map_t")) / 1e9).alias("age_s"))


def asof_strict(spark: SparkSession, d: str) -> DataFrame:
    """Each liquidation with the last map that had arrived strictly before it."""
    q = V.liquidations(spark, d).select("tid", "coin", "t_event")
    m = V.map_rows(spark, d).select("coin", F.col("seq").alias("map_seq"), F.col("t_ingest").alias("map_t"), "up1", "down1")
    return asof(q, m, ["coin"], "t_event", "map_t", ["map_seq", "up1", "down1"], tie=["map_seq"], strict=True)


def shells(spark: SparkSession, d: str) -> DataFrame:
    """Mass between neighbouring bands, never below 0; null beyond a missing bound."""
    m = V.map_rows(spark, d)
    diff = lambda s, i: F.greatest(F.lit(0.0), F.col(f"{s}{i}") - F.col(f"{s}{i - 1}")) if i > 1 else F.greatest(F.lit(0.0), F.col(f"{s}1"))
    return m.select("coin", "seq", *[diff(s, i).alias(f"{s}_shell{i}") for s in ("up", "down") for i in range(1, 5)])


def event_feats(spark: SparkSession, d: str) -> DataFrame:
    """Per bar: whole bars since the last liquidation, and their notional since the open of the bar 29 rows back."""
    with V.one_tape(spark, d):
        return event_features(B.bars(V.prints(spark, d)), V.liquidations(spark, d))


def event_features(b: DataFrame, liquidations: DataFrame) -> DataFrame:
    """``(coin, t_open, tau, liq_flow)`` of bars."""
    b = b.select("coin", "t_open", "t_close")
    w = Window.partitionBy("coin").orderBy("t_open")
    b = b.withColumn("since", F.coalesce(F.lag("t_open", 29).over(w), F.min("t_open").over(w)))
    q = liquidations.select("coin", "tid", "t_event", (F.col("px").cast("decimal(20,6)") * F.col("sz").cast("decimal(12,3)")).cast("decimal(32,6)").alias("v"))
    sums = running_sum(q, ["coin"], "t_event", ["tid"], F.col("v"), "total").select("coin", "tid", "t_event", "total")
    now = asof(b, sums, ["coin"], "t_close", "t_event", ["t_event", "total"], tie=["tid"]).withColumnsRenamed({"t_event": "last_t", "total": "upto"})
    old = asof(now, sums, ["coin"], "since", "t_event", ["total"], tie=["tid"], strict=True)
    flow = (F.coalesce("upto", F.lit(0)) - F.coalesce("total", F.lit(0))).cast("double")
    return old.select("coin", "t_open", F.floor((F.col("t_close") - F.col("last_t")) / HOUR).cast("long").alias("tau"), F.round(flow, 6).alias("liq_flow"))


def silences(spark: SparkSession, d: str) -> DataFrame:
    """Stretches of over QUIET without an arrival, by coin."""
    arrivals = V.tape(spark, d).select("coin", "t_ingest").distinct()
    p = previous(arrivals, ["coin"], "t_ingest", [], ["t_ingest"])
    return p.where(F.col("t_ingest") - F.col("prev_t_ingest") > QUIET).select("coin", F.col("prev_t_ingest").alias("t_from"), F.col("t_ingest").alias("t_to"))


def tape_gaps(spark: SparkSession, d: str, cadence: int = HOUR) -> DataFrame:
    """Gaps between the manifest's files of more than twice the cadence."""
    m = V.manifest(spark, d)
    p = m.select("coin", "hour", "first_ingest", F.lag("last_ingest").over(Window.partitionBy("coin").orderBy("hour")).alias("before"))
    return p.where(F.col("first_ingest") - F.col("before") > 2 * cadence).select("coin", "hour", (F.col("first_ingest") - F.col("before")).alias("gap_ns"))


def tape_hours(spark: SparkSession, d: str) -> DataFrame:
    return V.manifest(spark, d).select("coin", "hour", "lines")


def feed_audit(spark: SparkSession, d: str) -> DataFrame:
    """Holes and backward steps of the sequence, largest gap, and latency order statistics, by coin."""
    t = settle(V.tape(spark, d).select("coin", "seq", "t_event", "t_ingest"))
    p = previous(t, ["coin"], "t_event", ["seq"], ["seq", "t_ingest"])
    step = p.groupBy("coin").agg(
        F.count("*").alias("n"), F.sum((F.col("seq") - F.col("prev_seq") > 1).cast("int")).alias("holes"), F.sum((F.col("t_ingest") < F.col("prev_t_ingest")).cast("int")).alias("backward"),
        F.max(F.col("t_ingest") - F.col("prev_t_ingest")).alias("largest_gap"), F.sum((F.col("t_ingest") < F.col("t_event") - 2_000_000_000).cast("int")).alias("acausal"),
    )
    latency = t.select("coin", (F.col("t_ingest") - F.col("t_event")).alias("latency"))
    at = lambda q: F.least(F.col("n") - 1, F.floor(F.col("n") * q))
    quant = selected(latency, ["coin"], "latency", {"latency_p50": at(0.5), "latency_p99": at(0.99)}).drop("n")
    return step.join(quant, "coin").select("coin", "n", "holes", "backward", "largest_gap", "acausal", "latency_p50", "latency_p99", (F.col("holes") == 0).alias("seq_continuous"), (F.col("acausal") == 0).alias("clock_causal"), (F.col("largest_gap") <= 60 * HOUR).alias("no_gaps"))


def gap_minutes(spark: SparkSession, d: str) -> DataFrame:
    """Minutes of silence by ISO week; a silence across weeks is split."""
    week = 7 * DAY
    monday = 345_600_000_000_000  # 1970-01-05
    s = silences(spark, d)
    first, last = F.floor((F.col("t_from") - monday) / week), F.floor((F.col("t_to") - monday) / week)
    parts = s.select("coin", "t_from", "t_to", F.explode(F.sequence(first, last)).alias("w"))
    a, b = F.greatest(F.col("t_from"), F.col("w") * week + monday), F.least(F.col("t_to"), (F.col("w") + 1) * week + monday)
    return parts.groupBy("coin", F.col("w").alias("week")).agg(F.round(F.sum((b - a).cast("decimal(38,0)")).cast("double") / MINUTE, 6).alias("minutes"))


def capture_holes(spark: SparkSession, d: str) -> DataFrame:
    """Silences that contain a restart (every error event with k over 90)."""
    s = silences(spark, d).select("coin", "t_from", "t_to", F.explode(F.sequence(whole(F.col("t_from"), DAY), whole(F.col("t_to"), DAY))).alias("day"))
    r = V.tape(spark, d).where("coin = 'error' and k > 90").select(F.col("t_event").alias("restart"), whole(F.col("t_event"), DAY).alias("day"))
    return s.join(r, "day").where("restart > t_from and restart < t_to").groupBy("coin", "t_from", "t_to").agg(F.count("*").alias("restarts"))


def sma_cross(spark: SparkSession, d: str, n: int = 12, band: float = 0.001) -> DataFrame:
    """Crossings of close and moving average with hysteresis; the newest bar is still open, the first side is silent."""
    b = B.bars(V.prints(spark, d)).select("coin", "t_open", "close")
    w = Window.partitionBy("coin").orderBy("t_open")
    b = b.withColumn("open_bar", F.lead("t_open").over(w).isNull()).where("not open_bar")
    over = B.rows_back(["coin"], ["t_open"], n)
    m = b.withColumn("sma", F.when(F.count("close").over(over) == n, F.round(F.avg("close").over(over), 9)))
    side = F.when(F.col("close") > F.col("sma") * (1 + band), 1).when(F.col("close") < F.col("sma") * (1 - band), -1)
    kept = m.withColumn("side", side).withColumn("held", F.last("side", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return kept.withColumn("was", F.lag("held").over(w)).where("was is not null and held <> was").select("coin", "t_open", "close", "held")


_GAPS = """(SELECT coin, lag(t_ingest) OVER (PARTITION BY coin ORDER BY t_ingest) AS t_from, t_ingest AS t_to FROM (SELECT DISTINCT coin, t_ingest FROM tape))"""

QUERIES = {f.__name__: f for f in (scan_tape, scan_since, prints, tape_parties, contexts, map_rows, event_time, bars, bars_visible, bars_lag, sigma, daily_sigma, latest_ctx, ctx_features, rolling_z, finite, asof_context, asof_map, asof_strict, shells, event_feats, silences, tape_gaps, tape_hours, feed_audit, gap_minutes, capture_holes, sma_cross)}

_Z = "CASE WHEN count({c}) OVER w = 20 THEN CASE WHEN round(stddev_samp({c}) OVER w, 12) = 0 THEN 0.0 ELSE round(({c} - avg({c}) OVER w) / stddev_samp({c}) OVER w, 6) + 0.0 END END"
_W = "WINDOW w AS (PARTITION BY coin ORDER BY t_ingest, seq ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"
_ASOF = """SELECT {out} FROM (SELECT b.*, (SELECT {pick} FROM {right} r WHERE r.coin = b.coin AND r.t_ingest {op} b.{t} ORDER BY r.t_ingest DESC, r.seq DESC LIMIT 1) AS got FROM {left} b)"""
_LAST = """(SELECT {keys}, m.seq AS rseq FROM {left} b ASOF LEFT JOIN (SELECT coin, t_ingest, max(seq) AS seq FROM {right} GROUP BY 1, 2) m ON b.coin = m.coin AND b.{t} {op} m.t_ingest)"""

SQL = {
    "scan_tape": sql("tape") + "SELECT * FROM tape",
    "scan_since": sql("tape") + "SELECT coin, seq, t_ingest FROM tape WHERE t_ingest >= 1704499200000000000",
    "prints": sql("prints") + "SELECT coin, seq, t_event, t_ingest, px, sz FROM prints",
    "tape_parties": sql("prints") + "SELECT coin, seq, CAST(0 AS INT) AS side, buyer AS party FROM prints UNION ALL SELECT coin, seq, CAST(1 AS INT), seller FROM prints",
    "contexts": sql("contexts") + "SELECT coin, seq, t_ingest, mark, round(oracle, 9) AS oracle, round(funding, 9) AS funding, open_interest, day_volume FROM contexts",
    "map_rows": sql("map_rows") + "SELECT coin, seq, t_ingest, up1, up2, up3, up4, down1, down2, down3, down4, round(near_up, 6) AS near_up, round(near_down, 6) AS near_down FROM map_rows",
    "event_time": sql("tape") + "SELECT coin, t_ingest // 3600000000000 AS hour, max(CASE WHEN coin <> 'error' THEN t_event END) AS t_event FROM tape GROUP BY 1, 2",
    "bars": sql("bars") + "SELECT *, round(CASE WHEN volume <> 0 THEN notional / volume ELSE 0 END, 6) AS vwap, round((close - open) / open, 9) AS ret, round((high - low) / open, 9) AS range FROM bars",
    "bars_visible": sql("bars") + "SELECT coin, t_open, available_at FROM bars WHERE available_at <= 1705276800000000000",
    "bars_lag": sql("bars") + "SELECT coin, t_open, CAST(n AS INT) AS n, (available_at - t_close) / 1e9 AS lag_s FROM (SELECT *, row_number() OVER (PARTITION BY coin ORDER BY t_open DESC) AS n FROM bars) WHERE n <= 20",
    "sigma": sql("sigmas") + "SELECT coin, t_open, sigma, sigma_regime FROM sigmas",
    "daily_sigma": sql("bars") + "SELECT coin, count(*) AS closes, CASE WHEN count(*) >= 25 THEN round(stddev_samp(lr) * sqrt(24.0), 9) END AS daily_sigma FROM (SELECT *, ln(close / lag(close) OVER (PARTITION BY coin ORDER BY t_open)) AS lr FROM bars) GROUP BY 1",
    "latest_ctx": sql("marks") + "SELECT * FROM marks",
    "ctx_features": sql("contexts") + f"SELECT coin, seq, round(premium, 9) AS premium, round(open_interest * mark, 6) AS oi_notional, {_Z.format(c='premium')} AS premium_z, {_Z.format(c='funding')} AS funding_z, {_Z.format(c='open_interest')} AS oi_z FROM (SELECT *, round((mark - oracle) / oracle, 12) AS premium FROM contexts) {_W}",
    "rolling_z": sql("contexts") + f"SELECT coin, seq, {_Z.format(c='open_interest')} AS z FROM contexts {_W}",
    "finite": sql("sigmas") + "SELECT coin, t_open, close, sigma FROM sigmas WHERE close IS NOT NULL AND sigma IS NOT NULL AND sigma_regime IS NOT NULL",
    "asof_context": sql("bars", "contexts") + "SELECT b.coin, b.t_open, b.available_at, c.seq, c.mark, c.open_interest FROM " + _LAST.format(keys="b.coin, b.t_open, b.available_at", left="bars", right="contexts", t="available_at", op=">=") + " b LEFT JOIN contexts c ON b.rseq = c.seq",
    "asof_map": sql("bars", "map_rows") + "SELECT b.coin, b.t_open, c.seq AS map_seq, c.up4, c.down4, (b.available_at - c.t_ingest) / 1e9 AS age_s FROM " + _LAST.format(keys="b.coin, b.t_open, b.available_at", left="bars", right="map_rows", t="available_at", op=">=") + " b LEFT JOIN map_rows c ON b.rseq = c.seq",
    "asof_strict": sql("liquidations", "map_rows") + "SELECT b.tid, b.coin, b.t_event, c.seq AS map_seq, c.up1, c.down1 FROM " + _LAST.format(keys="b.tid, b.coin, b.t_event", left="liquidations", right="map_rows", t="t_event", op=">") + " b LEFT JOIN map_rows c ON b.rseq = c.seq",
    "shells": sql("map_rows") + "SELECT coin, seq, " + ", ".join(f"greatest(0.0, {s}{i}{f' - {s}{i - 1}' if i > 1 else ''}) AS {s}_shell{i}" for s in ("up", "down") for i in range(1, 5)) + " FROM map_rows",
    "event_feats": sql("bars", "liquidations") + """SELECT b.coin, b.t_open, (b.t_close - max(l.t_event)) // 3600000000000 AS tau, round(CAST(coalesce(sum(CASE WHEN l.t_event >= b.since THEN l.v END), 0) AS DOUBLE), 6) AS liq_flow
        FROM (SELECT *, coalesce(lag(t_open, 29) OVER (PARTITION BY coin ORDER BY t_open), min(t_open) OVER (PARTITION BY coin)) AS since FROM bars) b
        LEFT JOIN (SELECT coin, t_event, CAST(CAST(px AS DECIMAL(20,6)) * CAST(sz AS DECIMAL(12,3)) AS DECIMAL(32,6)) AS v FROM liquidations) l ON l.coin = b.coin AND l.t_event <= b.t_close GROUP BY b.coin, b.t_open, b.t_close, b.since""",
    "silences": sql("tape") + f"SELECT coin, t_from, t_to FROM {_GAPS} WHERE t_to - t_from > {QUIET}",
    "tape_gaps": sql("manifest") + "SELECT coin, hour, first_ingest - before AS gap_ns FROM (SELECT *, lag(last_ingest) OVER (PARTITION BY coin ORDER BY hour) AS before FROM manifest) WHERE first_ingest - before > 7200000000000",
    "tape_hours": sql("manifest") + "SELECT coin, hour, lines FROM manifest",
    "feed_audit": sql("tape") + """SELECT coin, n, holes, backward, largest_gap, acausal, l[CAST(least(n - 1, floor(n * 0.5)) AS INT) + 1] AS latency_p50, l[CAST(least(n - 1, floor(n * 0.99)) AS INT) + 1] AS latency_p99,
        holes = 0 AS seq_continuous, acausal = 0 AS clock_causal, largest_gap <= 216000000000000 AS no_gaps FROM (SELECT coin, count(*) AS n, CAST(sum(CAST(seq - ps > 1 AS INT)) AS BIGINT) AS holes, CAST(sum(CAST(t_ingest < pt AS INT)) AS BIGINT) AS backward, max(t_ingest - pt) AS largest_gap,
        CAST(sum(CAST(t_ingest < t_event - 2000000000 AS INT)) AS BIGINT) AS acausal, list_sort(list(t_ingest - t_event)) AS l
        FROM (SELECT *, lag(seq) OVER (PARTITION BY coin ORDER BY t_event, seq) AS ps, lag(t_ingest) OVER (PARTITION BY coin ORDER BY t_event, seq) AS pt FROM tape) GROUP BY coin)""",
    "gap_minutes": sql("tape") + f"""SELECT coin, w AS week, round(CAST(sum(least(t_to, (w + 1) * 604800000000000 + 345600000000000) - greatest(t_from, w * 604800000000000 + 345600000000000)) AS DOUBLE) / 60000000000, 6) AS minutes
        FROM (SELECT coin, t_from, t_to, unnest(generate_series((t_from - 345600000000000) // 604800000000000, (t_to - 345600000000000) // 604800000000000)) AS w FROM {_GAPS} WHERE t_to - t_from > {QUIET}) GROUP BY 1, 2""",
    "capture_holes": sql("tape") + f"SELECT s.coin, t_from, t_to, count(*) AS restarts FROM {_GAPS} s JOIN (SELECT t_event FROM tape WHERE coin = 'error' AND k > 90) r ON r.t_event > t_from AND r.t_event < t_to WHERE t_to - t_from > {QUIET} GROUP BY 1, 2, 3",
    "sma_cross": sql("bars") + """SELECT coin, t_open, close, held FROM (SELECT *, lag(held) OVER (PARTITION BY coin ORDER BY t_open) AS was FROM (SELECT *, last_value(side IGNORE NULLS) OVER (PARTITION BY coin ORDER BY t_open ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS held
        FROM (SELECT *, CASE WHEN close > sma * 1.001 THEN 1 WHEN close < sma * 0.999 THEN -1 END AS side FROM (SELECT *, CASE WHEN count(close) OVER w = 12 THEN round(avg(close) OVER w, 9) END AS sma
        FROM (SELECT coin, t_open, close, lead(t_open) OVER (PARTITION BY coin ORDER BY t_open) AS nxt FROM bars) WHERE nxt IS NOT NULL WINDOW w AS (PARTITION BY coin ORDER BY t_open ROWS BETWEEN 11 PRECEDING AND CURRENT ROW))))) WHERE was IS NOT NULL AND held <> was""",
}
