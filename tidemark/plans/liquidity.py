"""Queries over liquidation maps and events: prices, range histograms, scores, permutation nulls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.expressions import whole
from tidemark.operators.ordered import DAY, HOUR, asof
from tidemark.operators.ranks import selected
from tidemark.session import settle
from tidemark.sources import views as V

WIDTH = 0.0025
SPAN = 0.3
BANDS = (0.005, 0.01, 0.02, 0.05)
STALE = 6 * HOUR
_PRICE = """SELECT *, CASE WHEN liquidation_px > 0 THEN liquidation_px ELSE derived END AS price, CASE WHEN liquidation_px > 0 THEN 'published' WHEN derived IS NOT NULL THEN 'derived' ELSE 'none' END AS src FROM
    (SELECT *, CASE WHEN raw > 0 THEN raw END AS derived FROM (SELECT *, CASE WHEN 1 - mm * sign(szi) <> 0 THEN mark - sign(szi) * (margin - mm * abs(szi) * mark) / abs(szi) / (1 - mm * sign(szi)) END AS raw FROM
    (SELECT *, 0.5 / max_leverage AS mm, CASE WHEN margin_type = 'isolated' THEN abs(szi) * mark / max_leverage ELSE account_value END AS margin FROM positions)))"""
MORE = {
    "priced": (["positions"], f"priced AS ({_PRICE})"),
    "placed": (["priced", "marks"], f"""placed AS (SELECT *, CASE WHEN price < mark * (1 + cand * {WIDTH}::DOUBLE) THEN cand - 1 WHEN price >= mark * (1 + (cand + 1) * {WIDTH}::DOUBLE) THEN cand + 1 ELSE cand END AS bucket
        FROM (SELECT address, coin, price, src, margin_type, mark, round(abs(szi) * mark, 6) AS notional, price / mark - 1 AS dist, CAST(floor((price / mark - 1) / {WIDTH}::DOUBLE) AS BIGINT) AS cand FROM priced WHERE price IS NOT NULL AND abs(price / mark - 1) <= {SPAN}))"""),
    "buckets": (["placed"], "buckets AS (SELECT coin, bucket, CAST(sum(CAST(notional AS DECIMAL(24,6))) AS DOUBLE) AS notional, CAST(coalesce(sum(CAST(notional AS DECIMAL(24,6))) FILTER (margin_type = 'cross'), 0) AS DOUBLE) AS cross_notional, count(*) AS n FROM placed GROUP BY 1, 2)"),
    "once": (["liquidations"], "once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tid ORDER BY CAST(source = 'self' AS INT), t_ingest, observer) AS rn FROM liquidations) WHERE rn = 1)"),
    "matched": (["once", "map_rows"], """matched AS (SELECT q.tid, q.coin, q.t_event, q.mark_px, q.px, q.sz, m.seq AS map_seq, m.t_ingest AS map_t, m.mark, up1, up2, up3, up4, down1, down2, down3, down4, q.mark_px / m.mark - 1 AS dist, f.first_t
        FROM (SELECT o.*, a.seq AS rseq FROM once o ASOF LEFT JOIN (SELECT coin, t_ingest, max(seq) AS seq FROM map_rows GROUP BY 1, 2) a ON o.coin = a.coin AND o.t_event > a.t_ingest) q
        LEFT JOIN map_rows m ON q.rseq = m.seq LEFT JOIN (SELECT coin, min(t_ingest) AS first_t FROM map_rows GROUP BY 1) f ON q.coin = f.coin)"""),
}


def sql(*names: str) -> str:
    return V.with_views(*names, more=MORE)


def priced(p: DataFrame) -> DataFrame:
    """Positions with their derived and effective liquidation price; null where none can be computed."""
    side, size = F.signum("szi"), F.abs("szi")
    mm = F.lit(0.5) / F.col("max_leverage")
    margin = F.when(F.col("margin_type") == "isolated", size * F.col("mark") / F.col("max_leverage")).otherwise(F.col("account_value"))
    raw = F.when(1 - mm * side != 0, F.col("mark") - side * (margin - mm * size * F.col("mark")) / size / (1 - mm * side))
    p = p.withColumn("raw", raw).withColumn("derived", F.when(F.col("raw") > 0, F.col("raw")))
    published = F.col("liquidation_px") > 0
    return p.withColumn("price", F.when(published, F.col("liquidation_px")).otherwise(F.col("derived"))).withColumn("src", F.when(published, "published").when(F.col("derived").isNotNull(), "derived").otherwise("none"))


def notional() -> Column:
    """A position's size at the mark to six digits; rounded as binary numbers, so that half digits go the same way in SQL."""
    return F.floor(F.abs("szi") * F.col("mark") * 1e6 + 0.5) / 1e6


def placed(p: DataFrame, width: float = WIDTH, span: float = SPAN, keys: tuple[str, ...] = ("coin",)) -> DataFrame:
    """Priced positions within the span, with the bucket [mark(1+i*w), mark(1+(i+1)*w)) of their price.

    The index comes from a division and is corrected by one against the edges themselves.
    """
    near = p.where(F.col("price").isNotNull() & (F.abs(F.col("price") / F.col("mark") - 1) <= span))
    dist = F.col("price") / F.col("mark") - 1
    cand = F.floor(dist / width)
    edge = lambda i: F.col("mark") * (1 + i * width)
    bucket = F.when(F.col("price") < edge(cand), cand - 1).when(F.col("price") >= edge(cand + 1), cand + 1).otherwise(cand)
    return near.select("address", *keys, "price", "src", "margin_type", "mark", notional().alias("notional"), dist.alias("dist"), bucket.alias("bucket"))


def _sum(when: Column | None = None) -> Column:
    v = F.col("notional").cast("decimal(24,6)")
    return F.coalesce(F.sum(v if when is None else F.when(when, v)), F.lit(0)).cast("double")


def buckets_of(p: DataFrame) -> DataFrame:
    return placed(p).groupBy("coin", "bucket").agg(_sum().alias("notional"), _sum(F.col("margin_type") == "cross").alias("cross_notional"), F.count("*").alias("n"))


def bands_of(p: DataFrame, keys: tuple[str, ...] = ("coin",)) -> DataFrame:
    """Mass within each band above and below, all and cross only, published share, imbalance, by coin (or by ``keys``)."""
    up = lambda b: (F.col("dist") > 0) & (F.col("dist") <= b)
    down = lambda b: (F.col("dist") < 0) & (F.col("dist") >= -b)
    sums = [_sum(up(b)).alias(f"up{i}") for i, b in enumerate(BANDS, 1)] + [_sum(down(b)).alias(f"down{i}") for i, b in enumerate(BANDS, 1)]
    rows = placed(p, keys=keys).groupBy(*keys).agg(*sums, _sum().alias("total"), _sum(F.col("src") == "published").alias("pub"))
    mass = F.col("up4") + F.col("down4")
    return rows.withColumn("imbalance", F.when(mass != 0, F.round((F.col("down4") - F.col("up4")) / mass, 9)).otherwise(0.0)).withColumn("published_share", F.when(F.col("total") != 0, F.round(F.col("pub") / F.col("total"), 9)).otherwise(0.0)).drop("pub")


def _p(spark: SparkSession, d: str) -> DataFrame:
    return priced(V.positions(spark, d))


def liq_price(spark: SparkSession, d: str) -> DataFrame:
    return _p(spark, d).select("address", "coin", F.round("derived", 6).alias("derived"), F.round("price", 6).alias("price"), F.col("src").alias("source"))


def liqmap_buckets(spark: SparkSession, d: str) -> DataFrame:
    return buckets_of(_p(spark, d))


def liqmap_bands(spark: SparkSession, d: str) -> DataFrame:
    return bands_of(_p(spark, d))


def map_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """The narrow snapshot: bands with coverage of the open interest."""
    m = V.marks(spark, d).select("coin", "mark", "open_interest", "t_ingest")
    cover = F.round(F.col("total") / (2 * F.col("open_interest") * F.col("mark")), 9)
    return bands_of(_p(spark, d)).join(F.broadcast(m), "coin").select("coin", "t_ingest", "up4", "down4", "imbalance", cover.alias("coverage"))  # a row a coin


def map_history(spark: SparkSession, d: str) -> DataFrame:
    """A map for each coin at the end of each day: the wallets' running positions and the mark as of then.

    A day's flows are summed before anything is ordered, so a wallet has a row a
    day at most; a position stands until the day before its next change. Wallets
    out of the registry count as isolated.
    """
    from tidemark.plans.wallets import legs_of

    day = lambda t: whole(F.col(t), DAY).cast("int")
    with V.one_tape(spark, d):
        ends = V.tape(spark, d).agg(F.min(day("t_event")).alias("first"), F.max(day("t_event")).alias("last"))  # one row
        flows = legs_of(spark, d).groupBy("address", "coin", day("t_event").alias("day")).agg(F.sum("signed").alias("flow"))
        seen = V.contexts(spark, d).groupBy("coin", day("t_ingest").alias("day")).agg(F.max_by("mark", F.struct("t_ingest", "seq")).alias("mark"))
    w = Window.partitionBy("address", "coin").orderBy("day")
    held = flows.withColumns({"szi": F.sum("flow").over(w).cast("double"), "next": F.lead("day").over(w)}).where("szi <> 0").crossJoin(F.broadcast(ends))
    held = held.select("address", "coin", "szi", F.explode(F.sequence("day", F.coalesce(F.col("next") - 1, F.col("last")))).alias("day"))
    until = Window.partitionBy("coin").orderBy("day")  # a row a day
    marks = seen.withColumn("next", F.lead("day").over(until)).crossJoin(F.broadcast(ends)).where(F.col("day") <= F.col("last"))
    marks = marks.select("coin", "mark", F.explode(F.sequence("day", F.greatest("day", F.least("last", F.coalesce(F.col("next") - 1, F.col("last")))))).alias("day"))
    number = F.substring("address", 2, 20).cast("long")
    p = held.join(marks, ["coin", "day"]).join(V.wallets(spark, d).select("address", "account_value"), "address", "left")
    p = p.withColumns({"max_leverage": (5 + number % 4 * 10).cast("int"), "margin_type": F.when(F.col("account_value").isNull(), "isolated").otherwise("cross"), "liquidation_px": F.lit(None).cast("double")})
    return bands_of(priced(p), ("coin", "day")).drop("published_share")


def nearest(spark: SparkSession, d: str, least: float = 5000.0) -> DataFrame:
    """The nearest bucket on each side with a mass above the least."""
    b = buckets_of(_p(spark, d)).where(F.col("notional") > least)
    return b.groupBy("coin").agg(F.min(F.when(F.col("bucket") >= 0, F.col("bucket"))).alias("up_bucket"), F.max(F.when(F.col("bucket") < 0, F.col("bucket"))).alias("down_bucket"))


def sparse(spark: SparkSession, d: str) -> DataFrame:
    """Each coin's non-empty buckets as one text, in order."""
    b = buckets_of(_p(spark, d)).groupBy("coin").agg(F.sort_array(F.collect_list(F.struct("bucket", "n"))).alias("b"))  # at most 2 * span / width buckets
    return b.select("coin", F.array_join(F.transform("b", lambda x: F.concat_ws(":", x["bucket"].cast("string"), x["n"].cast("string"))), ",").alias("buckets"))


def map_visible(spark: SparkSession, d: str, share: float = 0.01, rows: int = 8) -> DataFrame:
    """The nearest buckets on each side that hold a share of the mass."""
    b = buckets_of(_p(spark, d)).withColumn("part", F.round(F.col("notional") / F.sum("notional").over(Window.partitionBy("coin")), 9)).where(F.col("part") >= share)
    side = F.when(F.col("bucket") >= 0, "up").otherwise("down")
    place = F.row_number().over(Window.partitionBy("coin", "side").orderBy(F.abs(F.col("bucket") + 0.5)))
    return b.withColumn("side", side).withColumn("place", place).where(F.col("place") <= rows).select("coin", "side", "place", "bucket", "part")


def wide_map(spark: SparkSession, d: str) -> DataFrame:
    """Mass in wide bands and beyond five percent, by coin."""
    wide = (0.01, 0.05, 0.1, 0.2, 0.3)
    p = placed(_p(spark, d)).groupBy("coin").agg(*[_sum(F.abs("dist") <= b).alias(f"within{i}") for i, b in enumerate(wide, 1)], _sum(F.abs("dist") > 0.05).alias("beyond"))
    return p


def map_epoch(spark: SparkSession, d: str) -> DataFrame:
    m = V.map_rows(spark, d)
    return m.groupBy("coin").agg(F.max("t_ingest").alias("newest"), F.max(F.when(F.col("up4") + F.col("down4") > 0, F.col("t_ingest"))).alias("newest_with_mass"))


def derive_fidelity(spark: SparkSession, d: str) -> DataFrame:
    """Derived against published prices: count, upper median, exact share, by margin type."""
    e = settle(_p(spark, d).where("liquidation_px > 0 and derived is not null").select("margin_type", F.round(F.abs(F.col("derived") / F.col("liquidation_px") - 1), 9).alias("err")))
    n = F.col("n")
    picked = selected(e, ["margin_type"], "err", {"median": F.floor(n * 0.5), "p90": F.floor(n * 0.9)})
    exact = e.groupBy("margin_type").agg(F.sum((F.col("err") < 1e-4).cast("int")).alias("exact"))
    return picked.join(exact, "margin_type").select("margin_type", "n", "exact", "median", "p90")


def once_of(q: DataFrame) -> DataFrame:
    """One event a tid: a counterparty's view before one's own, then the first seen."""
    cols = [c for c in q.columns if c != "tid"]
    best = F.min_by(F.struct(*cols), F.struct((F.col("source") == "self").cast("int"), "t_ingest", "observer"))
    return q.groupBy("tid").agg(best.alias("e")).select("tid", "e.*")


def liq_dedupe(spark: SparkSession, d: str) -> DataFrame:
    q = V.liquidations(spark, d)
    return once_of(q.unionByName(q.where("tid % 3 = 0").withColumn("source", F.lit("self")))).select("tid", "coin", "source", "px", "sz")


def liq_method(spark: SparkSession, d: str) -> DataFrame:
    v = (F.col("px").cast("decimal(20,6)") * F.col("sz").cast("decimal(12,3)")).cast("decimal(32,9)")
    return V.liquidations(spark, d).groupBy("method").agg(F.count("*").alias("n"), F.sum(v).cast("double").alias("notional"))


def liq_append(spark: SparkSession, d: str) -> DataFrame:
    """Insert or ignore by tid: the first write stays."""
    q = V.liquidations(spark, d).select("tid", "source", "px")
    old = q.where("tid % 3 <> 1").withColumn("px", -F.col("px"))
    return old.unionByName(q.join(old.select("tid"), "tid", "left_anti"))


def liq_minutes(spark: SparkSession, d: str) -> DataFrame:
    """Events, notional and largest one-minute total by coin."""
    v = (F.col("px").cast("decimal(20,6)") * F.col("sz").cast("decimal(12,3)")).cast("decimal(32,9)")
    m = V.liquidations(spark, d).groupBy("coin", F.floor(F.col("t_event") / 60_000_000_000).alias("minute")).agg(F.count("*").alias("n"), F.sum(v).alias("v"))
    return m.groupBy("coin").agg(F.sum("n").alias("n"), F.sum("v").cast("double").alias("notional"), F.max("v").cast("double").alias("max_minute"))


def liq_day(spark: SparkSession, d: str, hours: int = 24) -> DataFrame:
    """Events, notional and largest one-minute total by coin in the last hours up to the newest event."""
    v = (F.col("px").cast("decimal(20,6)") * F.col("sz").cast("decimal(12,3)")).cast("decimal(32,9)")
    q = V.liquidations(spark, d)
    newest = q.agg(F.max("t_event")).first()[0] or 0  # one number
    m = q.where(F.col("t_event") > newest - hours * 3_600_000_000_000).groupBy("coin", F.floor(F.col("t_event") / 60_000_000_000).alias("minute")).agg(F.count("*").alias("n"), F.sum(v).alias("v"))
    return m.groupBy("coin").agg(F.sum("n").alias("n"), F.sum("v").cast("double").alias("notional"), F.max("v").cast("double").alias("max_minute"))


def liq_recent(spark: SparkSession, d: str) -> DataFrame:
    return V.liquidations(spark, d).orderBy(F.desc("t_event"), F.desc("tid")).limit(15).select("tid", "coin", "method", "px", "sz")


def scan_stats(spark: SparkSession, d: str) -> DataFrame:
    """Accounting of a scan: raw, unique and new events, and observers that saw one."""
    q = V.liquidations(spark, d)
    raw = q.unionByName(q.where("tid % 3 = 0"))
    return raw.agg(F.count("*").alias("raw"), F.count_distinct("tid").alias("unique"), F.count_distinct(F.when(F.col("tid") % 2 == 1, F.col("tid"))).alias("fresh"), F.count_distinct("observer").alias("productive"))


def score_positions(spark: SparkSession, d: str) -> DataFrame:
    """Events against the mapped position of their user: hits within 2 percent, unmatched, by coin."""
    p = _p(spark, d).where("price is not null").select(F.col("address").alias("liquidated_user"), "coin", "price")
    j = V.liquidations(spark, d).join(p, ["liquidated_user", "coin"], "left")
    err = F.abs(F.col("mark_px") / F.col("price") - 1)
    return j.groupBy("coin").agg(F.count("*").alias("events"), F.sum(F.col("price").isNotNull().cast("int")).alias("scored"), F.coalesce(F.sum((err <= 0.02).cast("int")), F.lit(0)).alias("hits"), F.sum(F.col("price").isNull().cast("int")).alias("unmatched"))


def population(spark: SparkSession, d: str) -> DataFrame:
    """How many liquidated wallets are registered or mapped: first by wallet, then in total."""
    w = V.wallets(spark, d).select(F.col("address").alias("liquidated_user"), F.lit(True).alias("r")).distinct()
    m = V.positions(spark, d).select(F.col("address").alias("liquidated_user"), "coin", F.lit(True).alias("m"))
    j = V.liquidations(spark, d).join(w, "liquidated_user", "left").join(m, ["liquidated_user", "coin"], "left")
    by = j.groupBy("liquidated_user").agg(F.count("*").alias("n"), F.max(F.coalesce("r", F.lit(False))).alias("r"), F.max(F.coalesce("m", F.lit(False))).alias("m"))
    return by.agg(F.sum("n").alias("events"), F.count("*").alias("wallets"), F.sum(F.col("r").cast("int")).alias("registered"), F.sum(F.col("m").cast("int")).alias("mapped"))


_SIDES = [f"{s}{i}" for s in ("up", "down") for i in range(1, 5)]


def matched(spark: SparkSession, d: str) -> DataFrame:
    """Each event once, with the map that was believed strictly before it."""
    q = once_of(V.liquidations(spark, d)).select("tid", "coin", "t_event", "mark_px", "px", "sz")
    m = V.map_rows(spark, d)
    maps = m.select("coin", F.col("seq").alias("map_seq"), F.col("t_ingest").alias("map_t"), "mark", *_SIDES)
    found = asof(q, maps, ["coin"], "t_event", "map_t", ["map_seq", "map_t", "mark", *_SIDES], tie=["map_seq"], strict=True, chunk=DAY)
    first = m.groupBy("coin").agg(F.min("t_ingest").alias("first_t"))
    return found.join(F.broadcast(first), "coin", "left").withColumn("dist", F.col("mark_px") / F.col("mark") - 1)  # a row a coin


def _slot(dist: str = "dist") -> Column:
    """The shell of a distance, 0 to 3 from the mark; null outside the span."""
    a = F.abs(dist)
    return F.when(a <= BANDS[0], 0).when(a <= BANDS[1], 1).when(a <= BANDS[2], 2).when(a <= BANDS[3], 3)


#: How old a map may be to score an event: the tightest band is 0.5% wide, so a stale mark measures elapsed movement.
MAX_MAP_AGE = 300_000_000_000
_STATUS_SQL = f"CASE WHEN first_t IS NULL THEN 'no_map' WHEN map_t IS NULL THEN 'pre_map' WHEN t_event - map_t > {STALE} THEN 'stale_map' WHEN abs(dist) > 0.05 THEN 'outside_span' ELSE 'scored' END"
_SLOT_SQL = "CASE WHEN abs(dist) <= 0.005 THEN 0 WHEN abs(dist) <= 0.01 THEN 1 WHEN abs(dist) <= 0.02 THEN 2 WHEN abs(dist) <= 0.05 THEN 3 END"


def _status(stale: int = STALE) -> Column:
    return F.when(F.col("first_t").isNull(), "no_map").when(F.col("map_t").isNull(), "pre_map").when(F.col("t_event") - F.col("map_t") > stale, "stale_map").when(F.abs("dist") > BANDS[-1], "outside_span").otherwise("scored")


def cluster_score(spark: SparkSession, d: str) -> DataFrame:
    """The score with maps of at most five minutes; these tables' maps come hours apart, so most events are set aside as stale."""
    return score_clusters(matched(spark, d), MAX_MAP_AGE)


def cluster_score_cadence(spark: SparkSession, d: str) -> DataFrame:
    """The score with maps up to the age that these tables' cadence has."""
    return score_clusters(matched(spark, d), STALE)


def score_clusters(found: DataFrame, max_age: int = MAX_MAP_AGE, least: float = 0.0) -> DataFrame:
    """Whether events fell where the map had mass, in the tightest band that holds their distance; reasons to set aside counted, by coin.

    A side hit has more mass on the event's side of that band than on the other.
    The median is the upper one of distances rounded to 1e-6, read off their counts.
    """
    m = found.withColumn("status", _status(max_age)).withColumn("slot", _slot() + 1)
    at = lambda side: F.element_at(F.array(*[F.col(f"{side}{i}") for i in range(1, 5)]), F.coalesce("slot", F.lit(1)))
    near = F.when(F.col("dist") >= 0, at("up")).otherwise(at("down"))
    far = F.when(F.col("dist") >= 0, at("down")).otherwise(at("up"))
    counts = m.where("status = 'scored'").groupBy("coin", F.round(F.abs("dist"), 6).alias("x")).agg(F.count("*").alias("c"))
    upto = counts.withColumn("upto", F.sum("c").over(Window.partitionBy("coin").orderBy("x"))).withColumn("n", F.sum("c").over(Window.partitionBy("coin")))
    median = upto.where(F.col("upto") > F.floor(F.col("n") / 2)).groupBy("coin").agg(F.min("x").alias("median_distance"))
    scored = F.col("status") == "scored"
    count = lambda c: F.sum(c.cast("int"))
    rows = m.groupBy("coin").agg(count(F.col("status") == "pre_map").alias("pre_map"), count(F.col("status") == "stale_map").alias("stale_map"), count(F.col("status") == "outside_span").alias("outside_span"), count(scored).alias("scored"), count(scored & (near > far)).alias("side_hits"), count(scored & (near > least)).alias("band_hits"), count(F.col("status") == "no_map").alias("no_map"), F.count("*").alias("events"))
    rows = rows.withColumn("stderr", F.when(F.col("scored") > 0, F.round(F.sqrt(0.25 / F.col("scored")), 9)).otherwise(0.0)).join(median, "coin", "left")
    return rows.withColumn("median_distance", F.coalesce("median_distance", F.lit(0.0))).withColumn("z", F.when(F.col("scored") > 0, F.round((F.col("side_hits") / F.col("scored") - 0.5) / F.sqrt(0.25 / F.col("scored")), 6)))


def accrual(spark: SparkSession, d: str) -> DataFrame:
    """Scored events and distinct days since the middle of the tape."""
    m = matched(spark, d).where((_status() == "scored") & (F.col("t_event") >= 1705276800000000000))
    return m.agg(F.count("*").alias("events"), F.count_distinct(whole(F.col("t_event"), DAY)).alias("days"))


def band_null(spark: SparkSession, d: str, reps: int = 1000) -> DataFrame:
    return null_of(matched(spark, d), reps)


def null_of(found: DataFrame, reps: int = 1000) -> DataFrame:
    """Hits of the tightest band against maps whose eight stored band masses are shuffled, once for each snapshot and replication.

    The permutation is the order of a hash, so other engines reproduce it. A snapshot is one
    row with its events by slot and is shuffled within that row, so what is exchanged is a row
    a coin and replication. Where all masses or none are positive, every order of them gives
    the same hits, and none is made.
    """
    m = found.where(_status() == "scored").withColumn("slot", F.when(F.col("dist") >= 0, _slot()).otherwise(_slot() + 4)).where("coin is not null and slot is not null")
    counts = [F.count_if(F.col("slot") == i) for i in range(8)]
    full = F.array(*[F.coalesce(F.col(c) > 0, F.lit(False)) for c in _SIDES])
    snaps = settle(m.groupBy("coin", "map_seq", *_SIDES).agg(F.array(*counts).alias("events")).select("coin", "map_seq", full.alias("full"), "events"))
    total = lambda where: F.aggregate(F.zip_with("events", where, lambda n, yes: F.when(yes, n).otherwise(0)), F.lit(0).cast("long"), lambda a, n: a + n)
    real = snaps.groupBy("coin").agg(F.sum(total("full")).alias("observed"))
    mixed = F.exists("full", lambda yes: yes) & F.exists("full", lambda yes: ~yes)
    fixed = snaps.groupBy("coin").agg(F.sum(F.when(mixed, 0).otherwise(total("full"))).alias("hits"))
    every = F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("rep")
    key = lambda i: F.md5(F.concat_ws("-", F.lit("7"), F.col("rep").cast("string"), F.col("map_seq").cast("string"), F.lit(str(i))))
    order = F.array_sort(F.array(*[F.struct(key(i).alias("key"), F.element_at("full", i + 1).alias("full")) for i in range(8)]))
    moved = snaps.where(mixed).repartition("map_seq").select("coin", "map_seq", "full", "events", every).select("coin", "rep", total(F.transform(order, lambda x: x["full"])).alias("hits"))
    per = moved.unionByName(fixed.select("coin", every, "hits")).groupBy("coin", "rep").agg(F.sum("hits").alias("hits"))
    null = per.groupBy("coin").agg(F.round(F.avg("hits"), 6).alias("null_mean"), F.round(F.stddev_pop("hits"), 6).alias("null_sd"))
    told = real.join(null, "coin").withColumn("informative", F.col("null_sd") > 0)
    return told.withColumn("z", F.when(F.col("informative"), F.round((F.col("observed") - F.col("null_mean")) / F.col("null_sd"), 4)))


QUERIES = {f.__name__: f for f in (liq_price, liqmap_buckets, liqmap_bands, map_snapshot, map_history, nearest, sparse, map_visible, wide_map, map_epoch, derive_fidelity, liq_dedupe, liq_method, liq_append, liq_minutes, liq_day, liq_recent, scan_stats, score_positions, population, cluster_score, cluster_score_cadence, accrual, band_null)}

from tidemark.plans.wallets import MORE as _WALLETS  # noqa: E402

_N = "CAST(notional AS DECIMAL(24,6))"
_BANDS = ", ".join([f"CAST(coalesce(sum({_N}) FILTER (dist > 0 AND dist <= {b}), 0) AS DOUBLE) AS up{i}" for i, b in enumerate(BANDS, 1)] + [f"CAST(coalesce(sum({_N}) FILTER (dist < 0 AND dist >= -{b}), 0) AS DOUBLE) AS down{i}" for i, b in enumerate(BANDS, 1)])
_BANDED = f"""(SELECT *, CASE WHEN up4 + down4 <> 0 THEN round((down4 - up4) / (up4 + down4), 9) ELSE 0 END AS imbalance, CASE WHEN total <> 0 THEN round(pub / total, 9) ELSE 0 END AS published_share
    FROM (SELECT coin, {_BANDS}, CAST(sum({_N}) AS DOUBLE) AS total, CAST(coalesce(sum({_N}) FILTER (src = 'published'), 0) AS DOUBLE) AS pub FROM placed GROUP BY 1))"""
_V = "CAST(px AS DECIMAL(20,6)) * CAST(sz AS DECIMAL(12,3))"
_MASS = "[" + ", ".join(_SIDES) + "]"

_PICK = "[{side}1, {side}2, {side}3, {side}4][slot + 1]"
_CLUSTERS = sql("matched") + f"""SELECT *, CASE WHEN scored > 0 THEN round(sqrt(0.25 / scored), 9) ELSE 0.0 END AS stderr, CASE WHEN scored > 0 THEN round((side_hits / scored::DOUBLE - 0.5) / sqrt(0.25 / scored), 6) END AS z FROM
    (SELECT coin, count(*) AS events, count(*) FILTER (st = 'no_map') AS no_map, count(*) FILTER (st = 'pre_map') AS pre_map, count(*) FILTER (st = 'stale_map') AS stale_map, count(*) FILTER (st = 'outside_span') AS outside_span, count(*) FILTER (st = 'scored') AS scored,
    count(*) FILTER (st = 'scored' AND near > far) AS side_hits, count(*) FILTER (st = 'scored' AND near > 0) AS band_hits, coalesce(list_sort(list(round(abs(dist), 6)) FILTER (st = 'scored'))[count(*) FILTER (st = 'scored') // 2 + 1], 0.0) AS median_distance
    FROM (SELECT *, CASE WHEN dist >= 0 THEN {_PICK.format(side="up")} ELSE {_PICK.format(side="down")} END AS near, CASE WHEN dist >= 0 THEN {_PICK.format(side="down")} ELSE {_PICK.format(side="up")} END AS far
    FROM (SELECT *, {_STATUS_SQL} AS st, {_SLOT_SQL} AS slot FROM matched)) GROUP BY 1)"""

SQL = {
    "liq_price": sql("priced") + "SELECT address, coin, round(derived, 6) AS derived, round(price, 6) AS price, src AS source FROM priced",
    "liqmap_buckets": sql("buckets") + "SELECT * FROM buckets",
    "liqmap_bands": sql("placed") + f"SELECT * EXCLUDE (pub) FROM {_BANDED}",
    "map_snapshot": sql("placed") + f"SELECT b.coin, m.t_ingest, up4, down4, imbalance, round(total / (2 * m.open_interest * m.mark), 9) AS coverage FROM {_BANDED} b JOIN marks m ON b.coin = m.coin",
    "map_history": V.with_views("legs", "contexts", "wallets", more=_WALLETS).rstrip() + f""", grid AS (SELECT unnest(generate_series(min(t_event // {DAY}), max(t_event // {DAY}))) AS day FROM tape), flows AS (SELECT address, coin, t_event // {DAY} AS day, sum(signed) AS flow FROM legs GROUP BY 1, 2, 3),
        marked AS (SELECT c.coin, g.day, arg_max(mark, (t_ingest, seq)) AS mark FROM contexts c JOIN grid g ON c.t_ingest // {DAY} <= g.day GROUP BY 1, 2),
        positions AS (SELECT h.address, h.coin, h.day, szi, mark, 5 + CAST(h.address[2:] AS BIGINT) % 4 * 10 AS max_leverage, CASE WHEN account_value IS NULL THEN 'isolated' ELSE 'cross' END AS margin_type, account_value, CAST(NULL AS DOUBLE) AS liquidation_px
            FROM (SELECT address, coin, g.day, CAST(sum(flow) AS DOUBLE) AS szi FROM flows f JOIN grid g ON f.day <= g.day GROUP BY 1, 2, 3 HAVING sum(flow) <> 0) h JOIN marked m ON h.coin = m.coin AND h.day = m.day LEFT JOIN wallets w ON h.address = w.address),
        priced AS ({_PRICE}), placed AS (SELECT coin, CAST(day AS INT) AS day, round(abs(szi) * mark, 6) AS notional, price / mark - 1 AS dist, src FROM priced WHERE price IS NOT NULL AND abs(price / mark - 1) <= {SPAN})
        SELECT * EXCLUDE (pub, published_share) FROM {_BANDED.replace("(SELECT coin, CAST", "(SELECT coin, day, CAST").replace("GROUP BY 1)", "GROUP BY 1, 2)")}""",
    "nearest": sql("buckets") + "SELECT coin, min(bucket) FILTER (bucket >= 0) AS up_bucket, max(bucket) FILTER (bucket < 0) AS down_bucket FROM buckets WHERE notional > 5000 GROUP BY 1",
    "sparse": sql("buckets") + "SELECT coin, string_agg(CAST(bucket AS VARCHAR) || ':' || CAST(n AS VARCHAR), ',' ORDER BY bucket) AS buckets FROM buckets GROUP BY 1",
    "map_visible": sql("buckets") + """SELECT coin, side, CAST(place AS INT) AS place, bucket, part FROM (SELECT *, row_number() OVER (PARTITION BY coin, side ORDER BY abs(bucket + 0.5)) AS place FROM
        (SELECT *, CASE WHEN bucket >= 0 THEN 'up' ELSE 'down' END AS side FROM (SELECT coin, bucket, round(notional / sum(notional) OVER (PARTITION BY coin), 9) AS part FROM buckets) WHERE part >= 0.01)) WHERE place <= 8""",
    "wide_map": sql("placed") + "SELECT coin, " + ", ".join(f"CAST(coalesce(sum({_N}) FILTER (abs(dist) <= {b}), 0) AS DOUBLE) AS within{i}" for i, b in enumerate((0.01, 0.05, 0.1, 0.2, 0.3), 1)) + f", CAST(coalesce(sum({_N}) FILTER (abs(dist) > 0.05), 0) AS DOUBLE) AS beyond FROM placed GROUP BY 1",
    "map_epoch": sql("map_rows") + "SELECT coin, max(t_ingest) AS newest, max(t_ingest) FILTER (up4 + down4 > 0) AS newest_with_mass FROM map_rows GROUP BY 1",
    "derive_fidelity": sql("priced") + "SELECT margin_type, count(*) AS n, count(*) FILTER (err < 1e-4) AS exact, list_sort(list(err))[CAST(floor(count(*) * 0.5) AS INT) + 1] AS median, list_sort(list(err))[CAST(floor(count(*) * 0.9) AS INT) + 1] AS p90 FROM (SELECT margin_type, round(abs(derived / liquidation_px - 1), 9) AS err FROM priced WHERE liquidation_px > 0 AND derived IS NOT NULL) GROUP BY 1",
    "liq_dedupe": sql("liquidations") + "SELECT tid, coin, source, px, sz FROM (SELECT *, row_number() OVER (PARTITION BY tid ORDER BY CAST(source = 'self' AS INT), t_ingest, observer) AS rn FROM (SELECT * FROM liquidations UNION ALL SELECT * REPLACE ('self' AS source) FROM liquidations WHERE tid % 3 = 0)) WHERE rn = 1",
    "liq_method": sql("liquidations") + f"SELECT method, count(*) AS n, CAST(sum({_V}) AS DOUBLE) AS notional FROM liquidations GROUP BY 1",
    "liq_append": sql("liquidations") + "SELECT tid, source, CASE WHEN tid % 3 <> 1 THEN -px ELSE px END AS px FROM liquidations",
    "liq_day": sql("liquidations") + f"SELECT coin, CAST(sum(n) AS BIGINT) AS n, CAST(sum(v) AS DOUBLE) AS notional, CAST(max(v) AS DOUBLE) AS max_minute FROM (SELECT coin, t_event // 60000000000 AS minute, count(*) AS n, sum({_V}) AS v FROM liquidations WHERE t_event > (SELECT max(t_event) FROM liquidations) - 86400000000000 GROUP BY 1, 2) GROUP BY 1",
    "liq_minutes": sql("liquidations") + f"SELECT coin, CAST(sum(n) AS BIGINT) AS n, CAST(sum(v) AS DOUBLE) AS notional, CAST(max(v) AS DOUBLE) AS max_minute FROM (SELECT coin, t_event // 60000000000 AS minute, count(*) AS n, sum({_V}) AS v FROM liquidations GROUP BY 1, 2) GROUP BY 1",
    "liq_recent": sql("liquidations") + "SELECT tid, coin, method, px, sz FROM liquidations ORDER BY t_event DESC, tid DESC LIMIT 15",
    "scan_stats": sql("liquidations") + "SELECT count(*) AS raw, count(DISTINCT tid) AS unique, count(DISTINCT tid) FILTER (tid % 2 = 1) AS fresh, count(DISTINCT observer) AS productive FROM (SELECT * FROM liquidations UNION ALL SELECT * FROM liquidations WHERE tid % 3 = 0)",
    "score_positions": sql("liquidations", "priced") + "SELECT q.coin, count(*) AS events, count(*) FILTER (p.price IS NOT NULL) AS scored, count(*) FILTER (abs(mark_px / p.price - 1) <= 0.02) AS hits, count(*) FILTER (p.price IS NULL) AS unmatched FROM liquidations q LEFT JOIN (SELECT * FROM priced WHERE price IS NOT NULL) p ON q.liquidated_user = p.address AND q.coin = p.coin GROUP BY 1",
    "population": sql("liquidations", "wallets", "positions") + """SELECT CAST(sum(n) AS BIGINT) AS events, count(*) AS wallets, count(*) FILTER (r) AS registered, count(*) FILTER (m) AS mapped FROM (SELECT liquidated_user, count(*) AS n, bool_or(liquidated_user IN (SELECT address FROM wallets)) AS r,
        bool_or((liquidated_user || '/' || coin) IN (SELECT address || '/' || coin FROM positions)) AS m FROM liquidations GROUP BY 1)""",
    "cluster_score": _CLUSTERS.replace(f"> {STALE}", f"> {MAX_MAP_AGE}"),
    "cluster_score_cadence": _CLUSTERS,
    "accrual": sql("matched") + f"SELECT count(*) AS events, count(DISTINCT t_event // 86400000000000) AS days FROM matched WHERE {_STATUS_SQL} = 'scored' AND t_event >= 1705276800000000000",
    "band_null": sql("matched") + f""", hit AS (SELECT coin, map_seq, slot, count(*) AS events FROM (SELECT *, CASE WHEN dist >= 0 THEN {_SLOT_SQL} ELSE {_SLOT_SQL} + 4 END AS slot FROM matched WHERE {_STATUS_SQL} = 'scored') GROUP BY 1, 2, 3),
        slots AS (SELECT coin, map_seq, i AS from_slot, masses[i + 1] AS mass FROM (SELECT DISTINCT coin, map_seq, {_MASS} AS masses FROM matched WHERE {_STATUS_SQL} = 'scored'), generate_series(0, 7) g(i)),
        moved AS (SELECT *, row_number() OVER (PARTITION BY rep, map_seq ORDER BY md5('7-' || rep || '-' || map_seq || '-' || from_slot)) - 1 AS slot FROM slots, generate_series(0, 999) r(rep)),
        per AS (SELECT m.coin, rep, sum(CASE WHEN mass > 0 THEN events ELSE 0 END) AS hits FROM moved m JOIN hit h ON m.coin = h.coin AND m.map_seq = h.map_seq AND m.slot = h.slot GROUP BY 1, 2),
        real AS (SELECT s.coin, CAST(sum(CASE WHEN mass > 0 THEN events ELSE 0 END) AS BIGINT) AS observed FROM slots s JOIN hit h ON s.coin = h.coin AND s.map_seq = h.map_seq AND s.from_slot = h.slot GROUP BY 1)
        SELECT r.coin, observed, round(avg(hits), 6) AS null_mean, round(stddev_pop(hits), 6) AS null_sd, round(stddev_pop(hits), 6) > 0 AS informative, CASE WHEN round(stddev_pop(hits), 6) > 0 THEN round((observed - round(avg(hits), 6)) / round(stddev_pop(hits), 6), 4) END AS z FROM real r JOIN per p ON r.coin = p.coin GROUP BY 1, 2""",
}
