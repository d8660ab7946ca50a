"""Gates as ordered tables of rules, judged for all their subjects in one pass.

A rule holds or it does not; of those that refuse, the first that does not hold makes
the verdict a refusal with that reason, whatever else holds: what cannot be judged is
not refuted. Otherwise the gate's own condition says pass or fail. All rules that do
not hold are listed, and every verdict carries how far its window is filled.

What a gate asks for was registered before it ran. A registration is a ledger entry
with the numbers; if they differ from those in force, it does not count.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.ordered import DAY, HOUR
from tidemark.plans import cells, integrity, liquidity
from tidemark.functions.expressions import whole
from tidemark.session import settle
from tidemark.sources import views as V


@dataclass(frozen=True)
class Rule:
    name: str
    #: What has to hold; null counts as not.
    holds: Column
    #: The reason of the refusal that the rule stands for, if it is one.
    refuses: str | None = None


def judged(subjects: DataFrame, rules: list[Rule], passes: Column) -> DataFrame:
    """``subjects`` with ``verdict`` (refused, pass, fail), ``reason`` (of a refusal) and ``failed`` (names of rules, comma-joined)."""
    ok = {r.name: F.coalesce(r.holds, F.lit(False)) for r in rules}
    reason = F.coalesce(*[F.when(~ok[r.name], r.refuses) for r in rules if r.refuses], F.lit(None).cast("string"))
    failed = F.array_join(F.array_compact(F.array(*[F.when(~ok[r.name], r.name) for r in rules])), ",")
    told = subjects.withColumn("reason", reason)
    return told.withColumns({"verdict": F.when(F.col("reason").isNotNull(), "refused").when(F.coalesce(passes, F.lit(False)), "pass").otherwise("fail"), "failed": failed})


@dataclass(frozen=True)
class MapNumbers:
    """What the map's gate asks for."""

    events: int = 1000
    share: float = 0.60
    side: float = 0.60
    z: float = 3.0
    coverage: float = 0.25
    exact: float = 0.20
    age_ns: int = 6 * HOUR

    def registered(self) -> str:
        return f"events={self.events} share={self.share} side={self.side} z={self.z}"


@dataclass(frozen=True)
class MagnetNumbers:
    """What the magnet's gate asks for."""

    events: int = 2000
    days: int = 30
    map_age_ns: int = DAY

    def registered(self) -> str:
        return f"events={self.events} days={self.days}"


def map_gate(inputs: DataFrame, numbers: MapNumbers = MapNumbers()) -> DataFrame:  # noqa: B008
    """The map's gate for each coin of ``inputs`` (see `map_inputs`).

    Either the positions' or the clusters' bar is enough, given that all that the map rests on holds.
    """
    c = F.col
    cluster = c("informative") & (c("side_hits") / c("scored") >= numbers.side) & (c("z") >= numbers.z) & (c("null_z") >= numbers.z)
    rests_on = [Rule("positions_fresh", c("age_ns") <= numbers.age_ns), Rule("coverage", c("coverage") >= numbers.coverage), Rule("fidelity", (c("priced") > 0) & (c("exact") >= numbers.exact))]
    window = [Rule("registered", c("numbers") == numbers.registered(), "preregistration_missing"), Rule("window", c("scored") >= numbers.events, "insufficient_forward_events")]
    either = [Rule("positions", c("mapped_share") >= numbers.share), Rule("clusters", cluster)]
    whole_map = F.lit(True)
    for rule in rests_on:
        whole_map = whole_map & F.coalesce(rule.holds, F.lit(False))
    one = F.coalesce(either[0].holds, F.lit(False)) | F.coalesce(either[1].holds, F.lit(False))
    told = judged(inputs, [*rests_on, *window, *either], whole_map & one)
    return told.withColumn("progress", F.concat_ws("/", F.coalesce("scored", F.lit(0)).cast("string"), F.lit(str(numbers.events))))


def magnet_gate(inputs: DataFrame, numbers: MagnetNumbers = MagnetNumbers()) -> DataFrame:  # noqa: B008
    """The magnet's gate from one row or more of (numbers, map_verdict, map_age_ns, events, days, cells_passed)."""
    c = F.col
    rules = [
        Rule("registered", c("numbers") == numbers.registered(), "preregistration_missing"),
        Rule("map", (c("map_verdict") == "pass") & (c("map_age_ns") <= numbers.map_age_ns), "upstream_map"),
        Rule("window", (c("events") >= numbers.events) & (c("days") >= numbers.days), "insufficient_forward_events"),
        Rule("cells", c("cells_passed")),
    ]
    told = judged(inputs, rules, c("cells_passed"))
    return told.withColumn("progress", F.concat(F.coalesce("events", F.lit(0)).cast("string"), F.lit(f"/{numbers.events} events, "), F.coalesce("days", F.lit(0)).cast("string"), F.lit(f"/{numbers.days} days")))


#: The numbers in force for these tables, whose windows are short.
MAP, MAGNET = MapNumbers(events=20, share=0.3), MagnetNumbers(events=20, days=5, map_age_ns=30 * DAY)


def registrations(spark: SparkSession, d: str) -> DataFrame:
    """``(coin, registered_at, numbers)`` from the tape: one coin registered nothing, and one other numbers."""
    t = V.tape(spark, d).where("k = 7 and coin <> 'signup'").groupBy("coin").agg(F.min("t_event").alias("registered_at"))
    moved = MapNumbers(events=30, share=0.3).registered()
    return t.withColumn("numbers", F.when(F.col("coin") == "view", moved).otherwise(MAP.registered()))


def map_inputs(spark: SparkSession, d: str) -> DataFrame:
    """What the map's gate reads, by coin; events count from the registration on."""
    with V.one_tape(spark, d):
        coins = V.marks(spark, d).select("coin", (F.lit(integrity.NOW) - F.col("t_ingest")).alias("age_ns"))
        registered = settle(registrations(spark, d))
        cover = liquidity.map_snapshot(spark, d).select("coin", "coverage")
        priced = settle(liquidity.priced(V.positions(spark, d)))
        err = F.round(F.abs(F.col("derived") / F.col("liquidation_px") - 1), 9)
        exact = priced.where("liquidation_px > 0 and derived is not null").groupBy("coin").agg(F.count("*").alias("priced"), F.round(F.avg((err < 1e-4).cast("double")), 9).alias("exact"))
        forward = settle(liquidity.matched(spark, d).join(registered.select("coin", "registered_at"), "coin").where("t_event > registered_at").drop("registered_at"))
        events = liquidity.once_of(V.liquidations(spark, d)).join(registered.select("coin", "registered_at"), "coin").where("t_event > registered_at")
        mapped = priced.where("price is not null").select(F.col("address").alias("liquidated_user"), "coin", F.lit(True).alias("m"))
        size = (F.col("px").cast("decimal(20,6)") * F.col("sz").cast("decimal(12,3)")).cast("decimal(32,6)")
        share = events.join(mapped, ["liquidated_user", "coin"], "left").groupBy("coin").agg(F.round(F.sum(F.when(F.col("m"), size).otherwise(F.lit(0).cast("decimal(32,6)"))).cast("double") / F.sum(size).cast("double"), 9).alias("mapped_share"))
        cluster = liquidity.score_clusters(forward, liquidity.STALE).select("coin", "scored", "side_hits", "z")
        null = liquidity.null_of(forward).select("coin", "informative", F.col("z").alias("null_z"))
    out = coins.join(registered, "coin", "left")
    for part in (cover, exact, share, cluster, null):
        out = out.join(part, "coin", "left")
    return out


def gate_map(spark: SparkSession, d: str) -> DataFrame:
    return map_gate(map_inputs(spark, d), MAP).select("coin", "verdict", "reason", "failed", "progress")


def gate_magnet(spark: SparkSession, d: str) -> DataFrame:
    """The magnet's gate by coin: its map's newest verdict, events since the registration, and the grid's decision."""
    with V.one_tape(spark, d):
        newest = integrity.gate_status(spark, d).select(F.col("gate").alias("coin"), F.col("verdict").alias("map_verdict"), (F.lit(integrity.NOW) - F.col("at")).alias("map_age_ns"))
        registered = registrations(spark, d).select("coin", "registered_at", F.when(F.col("coin") != "view", MAGNET.registered()).otherwise(MagnetNumbers().registered()).alias("numbers"))
        scored = liquidity.matched(spark, d).where(liquidity._status() == "scored").join(registered.select("coin", "registered_at"), "coin").where("t_event > registered_at")
        filled = scored.groupBy("coin").agg(F.count("*").alias("events"), F.count_distinct(whole(F.col("t_event"), DAY)).alias("days"))
        decided = settle(cells.gate_cells(spark, d).select(F.col("passed").alias("cells_passed")))
    inputs = newest.join(registered.drop("registered_at"), "coin", "left").join(filled, "coin", "left").crossJoin(F.broadcast(decided))  # one row
    return magnet_gate(inputs, MAGNET).select("coin", "verdict", "reason", "failed", "progress")


QUERIES = {"gate_map": gate_map, "gate_magnet": gate_magnet}

_BODY = liquidity.MORE["matched"][1][len("matched AS ") :]
_REG = f"registered AS (SELECT coin, min(t_event) AS at, CASE WHEN coin = 'view' THEN '{MapNumbers(events=30, share=0.3).registered()}' ELSE '{MAP.registered()}' END AS numbers FROM tape WHERE k = 7 AND coin <> 'signup' GROUP BY coin)"
_MORE = cells._MORE | liquidity.MORE | {
    "verdicts": integrity.MORE["verdicts"],
    "registered": (["tape"], _REG),
    "matched": ([*liquidity.MORE["matched"][0], "registered"], f"matched AS (SELECT m.* FROM {_BODY} m JOIN registered r ON m.coin = r.coin AND m.t_event > r.at)"),
}
_NULL = liquidity.SQL["band_null"]
_CADENCE = liquidity.SQL["cluster_score_cadence"]
_SNAPSHOT = liquidity.SQL["map_snapshot"]
_SIZE = "CAST(CAST(px AS DECIMAL(20,6)) * CAST(sz AS DECIMAL(12,3)) AS DECIMAL(32,6))"
_JUDGED = """SELECT coin, CASE WHEN reason IS NOT NULL THEN 'refused' WHEN passes THEN 'pass' ELSE 'fail' END AS verdict, reason, failed, progress"""
_INPUTS = f"""SELECT c.coin, coalesce({integrity.NOW} - c.t_ingest <= {MAP.age_ns}, FALSE) AS fresh, coalesce(coverage >= {MAP.coverage}, FALSE) AS covered, coalesce(x.exact >= {MAP.exact}, FALSE) AS faithful, coalesce(r.numbers = '{MAP.registered()}', FALSE) AS known,
    coalesce(scored, 0) AS scored, coalesce(mapped_share >= {MAP.share}, FALSE) AS held, coalesce(informative AND side_hits / scored::DOUBLE >= {MAP.side} AND k.z >= {MAP.z} AND n.z >= {MAP.z}, FALSE) AS clustered
    FROM marks c LEFT JOIN registered r ON c.coin = r.coin LEFT JOIN ({_SNAPSHOT[_SNAPSHOT.rindex("SELECT b.coin"):]}) s ON c.coin = s.coin
    LEFT JOIN (SELECT coin, round(avg(CASE WHEN round(abs(derived / liquidation_px - 1), 9) < 1e-4 THEN 1.0::DOUBLE ELSE 0 END), 9) AS exact FROM priced WHERE liquidation_px > 0 AND derived IS NOT NULL GROUP BY 1) x ON c.coin = x.coin
    LEFT JOIN (SELECT o.coin, round(CAST(sum(CASE WHEN p.address IS NOT NULL THEN {_SIZE} ELSE 0 END) AS DOUBLE) / CAST(sum({_SIZE}) AS DOUBLE), 9) AS mapped_share FROM once o JOIN registered r ON o.coin = r.coin AND o.t_event > r.at LEFT JOIN (SELECT address, coin FROM priced WHERE price IS NOT NULL) p ON o.liquidated_user = p.address AND o.coin = p.coin GROUP BY 1) h ON c.coin = h.coin
    LEFT JOIN ({_CADENCE[_CADENCE.rindex("SELECT *, CASE WHEN scored"):]}) k ON c.coin = k.coin LEFT JOIN ({_NULL[_NULL.rindex("SELECT r.coin"):]}) n ON c.coin = n.coin"""
SQL = {
    "gate_map": V.with_views("placed", "matched", more=_MORE).rstrip() + _NULL[_NULL.index(", hit AS") : _NULL.rindex("SELECT r.coin")] + f"""{_JUDGED} FROM (SELECT coin, CASE WHEN NOT known THEN 'preregistration_missing' WHEN scored < {MAP.events} THEN 'insufficient_forward_events' END AS reason, fresh AND covered AND faithful AND (held OR clustered) AS passes, scored || '/{MAP.events}' AS progress,
        concat_ws(',', CASE WHEN NOT fresh THEN 'positions_fresh' END, CASE WHEN NOT covered THEN 'coverage' END, CASE WHEN NOT faithful THEN 'fidelity' END, CASE WHEN NOT known THEN 'registered' END, CASE WHEN scored < {MAP.events} THEN 'window' END, CASE WHEN NOT held THEN 'positions' END, CASE WHEN NOT clustered THEN 'clusters' END) AS failed FROM ({_INPUTS}))""",
    "gate_magnet": V.with_views("celled", "matched", "verdicts", more=_MORE).rstrip() + cells._CELLS[cells._CELLS.index(", summed AS") :] + cells.SQL["decide"][len(cells._CELLS) : cells.SQL["decide"].rindex("SELECT cells, wins, (SELECT")] + f""", dec_ AS ({cells.SQL["decide"][cells.SQL["decide"].rindex("SELECT cells, wins, (SELECT"):]}),
        st_ AS (SELECT gate AS coin, arg_max(verdict, (t_event, seq)) AS v, max(t_event) AS at FROM verdicts GROUP BY 1), ev_ AS (SELECT coin, count(*) AS events, count(DISTINCT t_event // {DAY}) AS days FROM matched WHERE {liquidity._STATUS_SQL} = 'scored' GROUP BY 1)
        {_JUDGED} FROM (SELECT coin, CASE WHEN NOT known THEN 'preregistration_missing' WHEN NOT mapped THEN 'upstream_map' WHEN NOT filled THEN 'insufficient_forward_events' END AS reason, passed AS passes, events || '/{MAGNET.events} events, ' || days || '/{MAGNET.days} days' AS progress,
        concat_ws(',', CASE WHEN NOT known THEN 'registered' END, CASE WHEN NOT mapped THEN 'map' END, CASE WHEN NOT filled THEN 'window' END, CASE WHEN NOT passed THEN 'cells' END) AS failed
        FROM (SELECT s.coin, r.coin IS NOT NULL AND s.coin <> 'view' AS known, s.v = 'pass' AND {integrity.NOW} - s.at <= {MAGNET.map_age_ns} AS mapped, coalesce(events, 0) AS events, coalesce(days, 0) AS days, coalesce(events >= {MAGNET.events} AND days >= {MAGNET.days}, FALSE) AS filled, passed
        FROM st_ s LEFT JOIN registered r ON s.coin = r.coin LEFT JOIN ev_ e ON s.coin = e.coin, (SELECT passed FROM dec_)))""",
}
