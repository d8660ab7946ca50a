"""Queries of integrity and reporting: hash chains, tape comparison, gate verdicts, event logs, digests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.expressions import whole
from tidemark.operators.ordered import DAY, HOUR, previous, running_sum
from tidemark.plans import liquidity, market
from tidemark.sources import views as V

NOW = 1706572800000000000  # 2024-01-30
MORE = market.MORE | {
    "verdicts": (["tape"], "verdicts AS (SELECT coin AS gate, seq, t_event, CASE WHEN k % 7 = 0 THEN 'refused' WHEN k > 50 THEN 'pass' ELSE 'fail' END AS verdict FROM tape)"),
    "calendar": (["tape"], "calendar AS (SELECT 'ev' || CAST(seq % 5000 // 200 AS VARCHAR) AS event_id, CASE WHEN seq % 2 = 0 THEN 'release' ELSE 'post' END AS class, coin AS source, t_event + 86400000000000 AS source_ts, t_ingest AS receipt_ts, seq FROM tape WHERE seq % 100 = 1)"),
}


def sql(*names: str) -> str:
    return V.with_views(*names, more=MORE)


def verdicts_of(spark: SparkSession, d: str) -> DataFrame:
    """The tape read as a gate log: pass, fail or refused."""
    t = V.tape(spark, d)
    return t.select(F.col("coin").alias("gate"), "seq", "t_event", F.when(F.col("k") % 7 == 0, "refused").when(F.col("k") > 50, "pass").otherwise("fail").alias("verdict"))


def gate_flips(spark: SparkSession, d: str) -> DataFrame:
    """Every change of a gate's verdict; a refusal is a verdict of its own."""
    p = previous(verdicts_of(spark, d), ["gate"], "t_event", ["seq"], ["verdict"])
    return p.where("prev_verdict is not null and prev_verdict <> verdict").select("gate", "seq", F.col("prev_verdict").alias("was"), "verdict")


def gate_status(spark: SparkSession, d: str) -> DataFrame:
    v = verdicts_of(spark, d).groupBy("gate").agg(F.max_by(F.struct("verdict", "t_event"), F.struct("t_event", "seq")).alias("v"), F.count("*").alias("runs"), F.sum((F.col("verdict") == "pass").cast("int")).alias("passes"))
    return v.select("gate", F.col("v.verdict").alias("verdict"), F.col("v.t_event").alias("at"), "runs", "passes")


def gate_require(spark: SparkSession, d: str) -> DataFrame:
    """Why a gate may not be passed: its newest verdict is missing, bad or older than a day."""
    s = gate_status(spark, d)
    return s.select("gate", F.when(F.col("verdict") != "pass", F.concat(F.lit("verdict is "), "verdict")).when(F.lit(NOW) - F.col("at") > DAY, "stale").otherwise("ok").alias("state"))


def ledger_latest(spark: SparkSession, d: str) -> DataFrame:
    """The newest entry of each gate and verdict."""
    return verdicts_of(spark, d).groupBy("gate", "verdict").agg(F.max("seq").alias("seq"), F.max("t_event").alias("at"))


def ledger_newest(spark: SparkSession, d: str, verdict: str = "refused", n: int = 20) -> DataFrame:
    """The newest entries of one kind, newest first."""
    return verdicts_of(spark, d).where(F.col("verdict") == verdict).orderBy(F.desc("t_event"), F.desc("seq")).limit(n)


def observations(spark: SparkSession, d: str) -> DataFrame:
    """The share of passes over time, by gate and day."""
    v = verdicts_of(spark, d)
    return v.groupBy("gate", whole(F.col("t_event"), DAY).alias("day")).agg(F.round(F.avg((F.col("verdict") == "pass").cast("double")), 9).alias("share"))


def actions(spark: SparkSession, d: str) -> DataFrame:
    """Action records of level two and above since the tape's middle."""
    t = V.tape(spark, d).select("seq", "t_ingest", F.concat(F.lit("L"), (F.col("k") % 4).cast("string")).alias("level"), F.col("coin").alias("kind"))
    return t.where("t_ingest >= 1705276800000000000 and level in ('L2', 'L3')")


def tape_compare(spark: SparkSession, d: str, tolerance: float = 0.1) -> DataFrame:
    """Two tapes' hours: same, differ beyond the tolerance, only ours, only theirs."""
    hour = whole(F.col("t_ingest"), HOUR)
    ours = V.tape(spark, d).groupBy("coin", hour.alias("hour")).agg(F.count("*").alias("a"))
    theirs = V.tape(spark, d).where("seq % 7 <> 0").groupBy("coin", hour.alias("hour")).agg(F.count("*").alias("b"))
    j = ours.join(theirs, ["coin", "hour"], "full")
    state = F.when(F.col("b").isNull(), "only_ours").when(F.col("a").isNull(), "only_theirs").when(F.abs(F.col("a") - F.col("b")) <= tolerance * F.greatest("a", "b"), "same").otherwise("differ")
    return j.select("coin", "hour", "a", "b", state.alias("state"))


def raw_missing(spark: SparkSession, d: str) -> DataFrame:
    """Files on one side of the manifest only, both ways."""
    m = V.manifest(spark, d).select("coin", "hour")
    disk = m.where("hour % 11 <> 0").unionByName(m.where("hour % 13 = 0").withColumn("hour", F.col("hour") + 100000))
    lost = m.join(disk, ["coin", "hour"], "left_anti").withColumn("state", F.lit("missing"))
    return lost.unionByName(disk.join(m, ["coin", "hour"], "left_anti").withColumn("state", F.lit("orphan")))


def chain_of(spark: SparkSession, d: str) -> DataFrame:
    """A hash chain for each coin over canonical bodies; every hash commits to the body before it.

    A chain of hashes of hashes is sequential by nature; here each entry commits
    to its own body and its predecessor's, so that chains are written and
    verified in parallel inside as well.
    """
    t = V.tape(spark, d)
    body = F.concat_ws("|", F.lit("b"), "coin", F.col("seq").cast("string"), F.col("k").cast("string"))
    p = previous(t.select("coin", "seq", "t_event", body.alias("body")), ["coin"], "t_event", ["seq"], ["body"])
    digest = lambda c: F.sha2(F.coalesce(F.col(c), F.lit("genesis")), 256)
    return p.select("coin", "seq", "t_event", "body", digest("prev_body").alias("before"), digest("body").alias("hash"))


def chain_verify(spark: SparkSession, d: str) -> DataFrame:
    """The first break of each chain whose body or link was changed (every coin but one here)."""
    c = chain_of(spark, d)
    bad = c.withColumn("body", F.when((F.col("seq") % 331 == 5) & (F.col("coin") != "view"), F.concat("body", F.lit("!"))).otherwise(F.col("body")))
    p = previous(bad, ["coin"], "t_event", ["seq"], ["hash"])
    linked = F.col("before") == F.coalesce(F.col("prev_hash"), F.sha2(F.lit("genesis"), 256))
    wrong = F.when(F.sha2("body", 256) != F.col("hash"), "digest").when(~linked, "link")
    found = p.withColumn("wrong", wrong).groupBy("coin").agg(F.count("*").alias("entries"), F.min(F.when(F.col("wrong").isNotNull(), F.col("seq"))).alias("first_break"))
    return found.select("coin", "entries", "first_break", F.col("first_break").isNull().alias("intact"))


def calendar_of(spark: SparkSession, d: str) -> DataFrame:
    t = V.tape(spark, d).where("seq % 100 = 1")
    return t.select(F.concat(F.lit("ev"), F.floor(F.col("seq") % 5000 / 200).cast("string")).alias("event_id"), F.when(F.col("seq") % 2 == 0, "release").otherwise("post").alias("class"), F.col("coin").alias("source"), (F.col("t_event") + DAY).alias("source_ts"), F.col("t_ingest").alias("receipt_ts"), "seq")


def event_dedup(spark: SparkSession, d: str) -> DataFrame:
    """The first receipt of every event id."""
    first = calendar_of(spark, d).groupBy("event_id").agg(F.min_by(F.struct("source", "receipt_ts"), F.struct("receipt_ts", "seq")).alias("e"))
    return first.select("event_id", "e.source", "e.receipt_ts")


def event_counts(spark: SparkSession, d: str) -> DataFrame:
    return calendar_of(spark, d).groupBy("source", "class").agg(F.count("*").alias("n"), F.max("receipt_ts").alias("newest"))


def events_ahead(spark: SparkSession, d: str) -> DataFrame:
    """Scheduled events of the next 48 hours, once each, in order of time."""
    c = calendar_of(spark, d).where((F.col("source_ts") >= NOW - 10 * DAY) & (F.col("source_ts") < NOW - 8 * DAY))
    return c.groupBy("event_id").agg(F.min("source_ts").alias("source_ts")).orderBy("source_ts", "event_id")


def failure_reasons(spark: SparkSession, d: str) -> DataFrame:
    """The most frequent failures by their three-digit status."""
    t = V.tape(spark, d).where("coin = 'error'").select(F.concat(F.lit("info failed after 4 attempts: "), (400 + F.col("k")).cast("string")).alias("message"))
    return t.groupBy(F.concat(F.lit("HTTP "), F.regexp_extract("message", r"\b(\d{3})\b", 1)).alias("reason")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason").limit(5)


def sweep_guard(spark: SparkSession, d: str) -> DataFrame:
    """Whether a sweep may be published: refused without successes or with too many errors, by coin."""
    s = V.tape(spark, d).groupBy("coin").agg(F.count("*").alias("wallets"), F.sum((F.col("k") % 2 == 0).cast("int")).alias("holders"), F.sum((F.col("k") < 49).cast("int")).alias("errors"))
    reason = F.when(F.col("holders") == 0, "nothing succeeded").when(F.col("errors") > 0.5 * F.col("wallets"), "too many errors")
    return s.withColumn("refusal", reason)


def stream_age(spark: SparkSession, d: str) -> DataFrame:
    """The newest arrival of each stream and whether that is a gap."""
    s = V.tape(spark, d).groupBy("coin").agg(F.max("t_ingest").alias("newest"))
    return s.select("coin", "newest", F.round((F.lit(NOW + DAY) - F.col("newest")) / 1e9, 3).alias("age_s"), (F.lit(NOW + DAY) - F.col("newest") > HOUR).alias("gap"))


def pair_digest(spark: SparkSession, d: str) -> DataFrame:
    """A row for each coin: latest mark, mapped positions, events, bars."""
    m = V.marks(spark, d).select("coin", "mark")
    p = V.positions(spark, d).groupBy("coin").agg(F.count("*").alias("holders"))
    q = V.liquidations(spark, d).groupBy("coin").agg(F.count("*").alias("events"))
    b = market.bars(spark, d).groupBy("coin").agg(F.count("*").alias("bars"))
    return m.join(p, "coin", "left").join(q, "coin", "left").join(b, "coin", "left").select("coin", "mark", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("holders", "events", "bars")])


def gate_ladder(spark: SparkSession, d: str) -> DataFrame:
    """Refusal reasons of the map gate in their order: too few events, low coverage, no side information."""
    c = liquidity.cluster_score_cadence(spark, d).select("coin", "scored", "z")
    s = liquidity.map_snapshot(spark, d).select("coin", "coverage")
    j = s.join(c, "coin", "left")
    return j.select("coin", F.when(F.coalesce("scored", F.lit(0)) < 20, "too few events").when(F.col("coverage") < 0.25, "low coverage").when(F.coalesce("z", F.lit(0.0)) < 3, "side not informative").otherwise("pass").alias("state"))


def liq_parse(spark: SparkSession, d: str) -> DataFrame:
    """Fills as JSON, parsed to forced closes: the counterparty's view first, else one's own direction's prefix."""
    t = V.tape(spark, d)
    cp = F.col("seq") % 50 == 7
    text = F.to_json(F.struct(
        "coin", F.col("px").cast("string").alias("px"), F.col("k").cast("string").alias("sz"), "tid", F.when(F.col("seq") % 4 == 3, "Liquidated Isolated Long").otherwise("Open Long").alias("dir"),
        F.when(cp, F.struct(F.col("buyer").alias("liquidatedUser"), F.col("px").cast("string").alias("markPx"), F.lit("market").alias("method"))).alias("liquidation"),
    ))
    schema = "coin string, px string, sz string, tid long, dir string, liquidation struct<liquidatedUser:string,markPx:string,method:string>"
    f = t.select("seq", "seller", F.from_json(text, schema).alias("f")).select("seq", "seller", "f.*")
    f = f.withColumns({"px": F.expr("try_cast(px as double)"), "sz": F.expr("try_cast(sz as double)")}).where("px > 0 and sz > 0 and tid is not null")
    own = F.lower("dir").startswith("liquidated")
    got = f.where(F.col("liquidation").isNotNull() | own)
    return got.select("tid", "coin", F.coalesce("liquidation.liquidatedUser", "seller").alias("user"), F.when(F.col("liquidation").isNotNull(), "counterparty").otherwise("self").alias("source"), "px", "sz")


def page_events(spark: SparkSession, d: str) -> DataFrame:
    """Links of pages as events: every href with its anchor text, markup removed."""
    p = V.table(spark, d, "pages")
    links = F.explode(F.regexp_extract_all("html", F.lit(r'<a href="([^"]*)">'), F.lit(1)))
    return p.select("page_id", F.regexp_extract("url", r"^https?://([^/]+)", 1).alias("host"), links.alias("target")).groupBy("page_id", "host").agg(F.count("*").alias("links"), F.min("target").alias("first_target"))


#: Of the attack ratio: A, kappa, the weight of cross positions, and the round trip's cost as a share.
A, KAPPA, OMEGA_CROSS, COST = 1.0, 0.5, 0.5, 0.001
#: Of the signal: barrier half-width in sigmas and horizon in days.
BARRIER, HORIZON_DAYS = 2.0, 4 / 24


def attack_of(p: DataFrame, stats: DataFrame, a: float = A, kappa: float = KAPPA, omega: float = OMEGA_CROSS, cost: float = COST) -> DataFrame:
    """``(coin, side, psi, jackknife, distance, mass, positions)``: per side the supremum of A sigma sqrt(R(d)/V) / (kappa d + cost).

    R steps up only at positions and the denominator grows, so the supremum is
    taken at one: a running sum over positions, in two levels by distance, and a
    minimum. The jackknife is the supremum without the heaviest position within
    the winning distance (of equal ones the nearest), 0 where that is the only one.
    Coins without a positive sigma and volume have null ratios. ``stats (coin,
    daily_sigma, day_volume)`` has a row a coin.
    """
    if cost < 0 or kappa < 0 or not (kappa or cost):
        raise ValueError("without a cost floor the ratio has no supremum")
    d = (F.col("price") - F.col("mark")) / F.col("mark")
    weight = F.when(F.col("margin_type") == "cross", F.lit(omega)).otherwise(F.lit(1.0)).cast("decimal(3,2)")
    mass = liquidity.notional().cast("decimal(24,6)") * weight
    rows = p.where("price > 0 and szi <> 0").select("coin", "address", d.alias("d"), mass.alias("m")).where("d <> 0")
    rows = rows.select("coin", F.when(F.col("d") > 0, "up").otherwise("down").alias("side"), F.abs("d").alias("x"), "m", "address").withColumn("nano", F.floor(F.col("x") * 1e9))
    walked = running_sum(rows, ["coin", "side"], "nano", ["x", "m", "address"], F.col("m"), "upto", chunk=10_000_000)
    good = (F.col("daily_sigma") > 0) & (F.col("day_volume") > 0)
    psi = lambda upto: F.when(good, F.round(a * F.col("daily_sigma") * F.sqrt(upto.cast("double") / F.col("day_volume")) / (kappa * F.col("x") + cost), 9))
    walked = walked.join(stats.select("coin", "daily_sigma", "day_volume"), "coin", "left").withColumn("psi", psi(F.col("upto")))
    key = ["coin", "side"]
    place = F.struct("x", "m", "address")
    best = walked.groupBy(*key).agg(F.min(F.struct((-F.col("psi")).alias("neg"), place.alias("at"), "upto")).alias("b"))
    inside = walked.join(best, key).where(F.col("x") <= F.col("b.at.x"))
    heavy = inside.groupBy(*key).agg(F.count("*").alias("within"), F.sum((place <= F.col("b.at")).cast("int")).alias("positions"), F.min(F.struct((-F.col("m")).alias("neg"), "x", "address")).alias("h"))
    others = walked.join(heavy, key).where(~((F.col("x") == F.col("h.x")) & (F.col("address") == F.col("h.address"))))
    behind = F.struct("x", "m", "address") > F.struct(F.col("h.x"), -F.col("h.neg"), F.col("h.address"))
    again = others.where("within > 1").groupBy(*key).agg(F.max(psi(F.when(behind, F.col("upto") + F.col("h.neg")).otherwise(F.col("upto")))).alias("jackknife"))
    out = best.join(heavy, key).join(again, key, "left")
    sign = F.when(F.col("side") == "up", 1).otherwise(-1)
    return out.select(*key, (-F.col("b.neg")).alias("psi"), F.when(F.col("b.neg").isNotNull(), F.coalesce("jackknife", F.lit(0.0))).alias("jackknife"), F.round(sign * F.col("b.at.x"), 9).alias("distance"), F.round(F.col("b.upto").cast("double"), 3).alias("mass"), "positions")


def attack(spark: SparkSession, d: str) -> DataFrame:
    with V.one_tape(spark, d):
        stats = market.daily_sigma(spark, d).join(V.marks(spark, d).select("coin", "day_volume"), "coin")
        return attack_of(liquidity._p(spark, d), stats)


def attack_signal(spark: SparkSession, d: str) -> DataFrame:
    """The hinged difference of the sides' ratios, positive upward, and its first-passage logit; ``abstain`` where both sides exceed 1."""
    with V.one_tape(spark, d):
        sigma = market.daily_sigma(spark, d).select("coin", "daily_sigma")
        a = attack(spark, d).groupBy("coin").pivot("side", ["up", "down"]).agg(F.max("psi"))
    hinge = lambda c: F.greatest(F.coalesce(F.col(c), F.lit(0.0)) - 1, F.lit(0.0))
    a = a.join(sigma, "coin").withColumn("drift", F.when(F.col("daily_sigma") > 0, F.round(hinge("up") - hinge("down"), 9)))
    both = F.coalesce((F.col("up") > 1) & (F.col("down") > 1), F.lit(False))
    return a.select("coin", "drift", F.round(2 * BARRIER * (HORIZON_DAYS**0.5) * F.col("drift") / F.col("daily_sigma"), 6).alias("logit"), both.alias("abstain"))


QUERIES = {f.__name__: f for f in (gate_flips, gate_status, gate_require, ledger_latest, ledger_newest, observations, actions, tape_compare, raw_missing, chain_verify, event_dedup, event_counts, events_ahead, failure_reasons, sweep_guard, stream_age, pair_digest, gate_ladder, liq_parse, page_events, attack, attack_signal)}

_STATUS = "(SELECT gate, arg_max(verdict, t_event) AS verdict, max(t_event) AS at, count(*) AS runs, count(*) FILTER (verdict = 'pass') AS passes FROM verdicts GROUP BY 1)"
_DAILY = market.SQL["daily_sigma"]
_ATTACK = V.with_views("priced", "bars", more=liquidity.MORE | market.MORE).rstrip() + f""", stats AS (SELECT s.coin, daily_sigma, day_volume FROM ({_DAILY[_DAILY.rindex("SELECT coin, count(*) AS closes") :]}) s JOIN marks m ON s.coin = m.coin),
    held AS (SELECT coin, CASE WHEN dd > 0 THEN 'up' ELSE 'down' END AS side, abs(dd) AS x, CAST(round(abs(szi) * mark, 6) AS DECIMAL(24,6)) * CAST(CASE margin_type WHEN 'cross' THEN {OMEGA_CROSS} ELSE 1.0 END AS DECIMAL(3,2)) AS m, address FROM (SELECT *, (price - mark) / mark AS dd FROM priced WHERE price > 0) WHERE dd <> 0),
    walked AS (SELECT *, row_number() OVER o AS i, CASE WHEN daily_sigma > 0 AND day_volume > 0 THEN round({A}::DOUBLE * daily_sigma * sqrt(CAST(sum(m) OVER o AS DOUBLE) / day_volume) / ({KAPPA}::DOUBLE * x + {COST}::DOUBLE), 9) END AS psi, sum(m) OVER o AS upto
        FROM held LEFT JOIN stats USING (coin) WINDOW o AS (PARTITION BY coin, side ORDER BY x, m, address)),
    best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY coin, side ORDER BY psi DESC, i) AS r FROM walked) WHERE r = 1),
    heavy AS (SELECT * FROM (SELECT w.coin, w.side, w.i, count(*) OVER (PARTITION BY w.coin, w.side) AS within, row_number() OVER (PARTITION BY w.coin, w.side ORDER BY w.m DESC, w.x, w.address) AS r FROM walked w JOIN best b ON w.coin = b.coin AND w.side = b.side AND w.x <= b.x) WHERE r = 1),
    rest AS (SELECT w.coin, w.side, max(p2) AS jackknife FROM (SELECT w.*, round({A}::DOUBLE * daily_sigma * sqrt(CAST(sum(m) OVER (PARTITION BY w.coin, w.side ORDER BY w.i) AS DOUBLE) / day_volume) / ({KAPPA}::DOUBLE * x + {COST}::DOUBLE), 9) AS p2 FROM walked w JOIN heavy h ON w.coin = h.coin AND w.side = h.side AND w.i <> h.i AND h.within > 1) w GROUP BY 1, 2),
    attacked AS (SELECT b.coin, b.side, psi, coalesce(jackknife, 0.0) AS jackknife, round(CASE WHEN b.side = 'up' THEN x ELSE -x END, 9) AS distance, round(CAST(upto AS DOUBLE), 3) AS mass, b.i AS positions FROM best b LEFT JOIN rest r ON b.coin = r.coin AND b.side = r.side)
"""
SQL = {
    "gate_flips": sql("verdicts") + "SELECT gate, seq, was, verdict FROM (SELECT *, lag(verdict) OVER (PARTITION BY gate ORDER BY seq) AS was FROM verdicts) WHERE was <> verdict",
    "gate_status": sql("verdicts") + f"SELECT * FROM {_STATUS}",
    "gate_require": sql("verdicts") + f"SELECT gate, CASE WHEN verdict <> 'pass' THEN 'verdict is ' || verdict WHEN {NOW} - s.at > 86400000000000 THEN 'stale' ELSE 'ok' END AS state FROM {_STATUS} s",
    "ledger_newest": sql("verdicts") + "SELECT gate, seq, t_event, verdict FROM verdicts WHERE verdict = 'refused' ORDER BY t_event DESC, seq DESC LIMIT 20",
    "ledger_latest": sql("verdicts") + "SELECT gate, verdict, max(seq) AS seq, max(t_event) AS at FROM verdicts GROUP BY 1, 2",
    "observations": sql("verdicts") + "SELECT gate, t_event // 86400000000000 AS day, round(avg(CAST(verdict = 'pass' AS DOUBLE)), 9) AS share FROM verdicts GROUP BY 1, 2",
    "actions": sql("tape") + "SELECT seq, t_ingest, 'L' || CAST(k % 4 AS VARCHAR) AS level, coin AS kind FROM tape WHERE t_ingest >= 1705276800000000000 AND k % 4 >= 2",
    "tape_compare": sql("tape") + """SELECT coalesce(o.coin, t.coin) AS coin, coalesce(o.hour, t.hour) AS hour, a, b, CASE WHEN b IS NULL THEN 'only_ours' WHEN a IS NULL THEN 'only_theirs' WHEN abs(a - b) <= 0.1 * greatest(a, b) THEN 'same' ELSE 'differ' END AS state
        FROM (SELECT coin, t_ingest // 3600000000000 AS hour, count(*) AS a FROM tape GROUP BY 1, 2) o FULL JOIN (SELECT coin, t_ingest // 3600000000000 AS hour, count(*) AS b FROM tape WHERE seq % 7 <> 0 GROUP BY 1, 2) t ON o.coin = t.coin AND o.hour = t.hour""",
    "raw_missing": sql("manifest").rstrip() + """, disk AS (SELECT coin, hour FROM manifest WHERE hour % 11 <> 0 UNION ALL SELECT coin, hour + 100000 FROM manifest WHERE hour % 13 = 0)
        SELECT coin, hour, 'missing' AS state FROM manifest m ANTI JOIN disk USING (coin, hour) UNION ALL SELECT coin, hour, 'orphan' FROM disk ANTI JOIN manifest USING (coin, hour)""",
    "chain_verify": sql("tape").rstrip() + """, bodies AS (SELECT coin, seq, 'b|' || coin || '|' || seq || '|' || k AS body FROM tape),
        links AS (SELECT coin, seq, sha256(coalesce(lag(body) OVER (PARTITION BY coin ORDER BY seq), 'genesis')) AS before, sha256(body) AS hash, CASE WHEN seq % 331 = 5 AND coin <> 'view' THEN body || '!' ELSE body END AS body FROM bodies),
        judged AS (SELECT coin, seq, sha256(body) <> hash OR before <> coalesce(lag(hash) OVER (PARTITION BY coin ORDER BY seq), sha256('genesis')) AS wrong FROM links)
        SELECT coin, count(*) AS entries, min(seq) FILTER (wrong) AS first_break, NOT bool_or(wrong) AS intact FROM judged GROUP BY 1""",
    "event_dedup": sql("calendar") + "SELECT event_id, source, receipt_ts FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY receipt_ts, seq) AS rn FROM calendar) WHERE rn = 1",
    "event_counts": sql("calendar") + "SELECT source, class, count(*) AS n, max(receipt_ts) AS newest FROM calendar GROUP BY 1, 2",
    "events_ahead": sql("calendar") + f"SELECT event_id, min(source_ts) AS source_ts FROM calendar WHERE source_ts >= {NOW - 10 * DAY} AND source_ts < {NOW - 8 * DAY} GROUP BY 1",
    "failure_reasons": sql("tape") + "SELECT 'HTTP ' || CAST(400 + k AS VARCHAR) AS reason, count(*) AS n FROM tape WHERE coin = 'error' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5",
    "sweep_guard": sql("tape") + "SELECT *, CASE WHEN holders = 0 THEN 'nothing succeeded' WHEN errors > 0.5 * wallets THEN 'too many errors' END AS refusal FROM (SELECT coin, count(*) AS wallets, count(*) FILTER (k % 2 = 0) AS holders, count(*) FILTER (k < 49) AS errors FROM tape GROUP BY 1)",
    "stream_age": sql("tape") + f"SELECT coin, max(t_ingest) AS newest, round(({NOW + DAY} - max(t_ingest)) / 1e9, 3) AS age_s, {NOW + DAY} - max(t_ingest) > 3600000000000 AS gap FROM tape GROUP BY 1",
    "pair_digest": sql("positions", "liquidations", "bars") + "SELECT m.coin, m.mark, coalesce(h, 0) AS holders, coalesce(e, 0) AS events, coalesce(b, 0) AS bars FROM marks m LEFT JOIN (SELECT coin, count(*) AS h FROM positions GROUP BY 1) p ON m.coin = p.coin LEFT JOIN (SELECT coin, count(*) AS e FROM liquidations GROUP BY 1) q ON m.coin = q.coin LEFT JOIN (SELECT coin, count(*) AS b FROM bars GROUP BY 1) x ON m.coin = x.coin",
    "gate_ladder": V.with_views("placed", "matched", more=liquidity.MORE) + "SELECT s.coin, CASE WHEN coalesce(scored, 0) < 20 THEN 'too few events' WHEN coverage < 0.25 THEN 'low coverage' WHEN coalesce(z, 0) < 3 THEN 'side not informative' ELSE 'pass' END AS state FROM (" + liquidity.SQL["map_snapshot"][liquidity.SQL["map_snapshot"].rindex("SELECT b.coin") :] + ") s LEFT JOIN (" + liquidity.SQL["cluster_score_cadence"][liquidity.SQL["cluster_score_cadence"].rindex("SELECT *, CASE WHEN scored") :] + ") c ON s.coin = c.coin",
    "liq_parse": sql("tape") + "SELECT tid, coin, CASE WHEN seq % 50 = 7 THEN buyer ELSE seller END AS user, CASE WHEN seq % 50 = 7 THEN 'counterparty' ELSE 'self' END AS source, px, sz FROM tape WHERE k > 0 AND (seq % 50 = 7 OR seq % 4 = 3)",
    "page_events": "SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, count(*) AS links, min(target) AS first_target FROM (SELECT page_id, url, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\">', 1)) AS target FROM pages) GROUP BY 1, 2",
    "attack": _ATTACK + "SELECT * FROM attacked",
    "attack_signal": _ATTACK + f"""SELECT coin, drift, round(2 * {BARRIER} * {HORIZON_DAYS**0.5!r}::DOUBLE * drift / daily_sigma, 6) AS logit, abstain FROM (SELECT a.coin, daily_sigma, coalesce(up > 1 AND down > 1, FALSE) AS abstain,
        round(greatest(coalesce(up, 0) - 1, 0.0) - greatest(coalesce(down, 0) - 1, 0.0), 9) AS drift FROM (SELECT coin, max(psi) FILTER (side = 'up') AS up, max(psi) FILTER (side = 'down') AS down FROM attacked GROUP BY 1) a JOIN stats s ON a.coin = s.coin)""",
}
