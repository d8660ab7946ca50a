"""The grid of cells (coin, horizon, barrier width) on which the gate decides, evaluated in one job.

A cell is a labelling of a coin's bars: which barrier is touched first within the
horizon. In each cell every kernel is held against the plain imbalance: paired z, a
placebo under permuted maps, and how often its decisions hit. Scores depend on the map
alone, so rows are summed up by (cell, map, label) before they meet the replications,
and a replication is a row a map, not a row a label.

`decide` reads a table of cells; another evaluator's table, with the columns of
`CELL`, will do as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import expressions as X
from tidemark.operators import bars as B
from tidemark.operators.labels import uniqueness
from tidemark.operators.ordered import HOUR, asof
from tidemark.operators.pyramid import first_touches
from tidemark.plans import research
from tidemark.session import settle
from tidemark.sources import views as V

#: Horizons in hours and barrier widths of the grid; exponents of the kernels; what the gate asks for.
HORIZONS, WIDTHS = (1, 4), (1.0, 2.0)
ALPHAS = (1.0, 2.0)
WINS_OF, LEAST_Z, PLACEBO_P = (12, 18), 2.0, 0.01
REPS = 200
#: The move, in basis points, that a decision is taken to bet on.
MOVE_BPS = 100.0
CELL = "coin string, horizon int, k double, alpha double, n long, z double, beats boolean, p_value double, hit_rate double, threshold double"
KEYS = ["coin", "horizon", "k"]


def labelled_cells(spark: SparkSession, d: str) -> DataFrame:
    """Bars labelled in every cell, timeouts left out: ``(*KEYS, t_open, t0, y, weight, map_seq, maps' masses)``."""
    with V.one_tape(spark, d):
        ticks = V.prints(spark, d).select("coin", "t_event", "seq", "px")
        bars = B.with_sigma(B.bars(V.prints(spark, d))).where("sigma > 0").select("coin", "t_open", F.col("available_at").alias("t0"), "sigma", "close")
        maps = V.map_rows(spark, d).select("coin", F.col("seq").alias("map_seq"), F.col("t_ingest").alias("map_t"), *research.SIDES)
        grid = F.array(*[F.struct(F.lit(h).alias("horizon"), F.lit(k).alias("k"), F.lit(float(max(1, h) ** 0.5)).alias("root")) for h in HORIZONS for k in WIDTHS])
        cells = settle(asof(bars, maps, ["coin"], "t0", "map_t", ["map_seq", *research.SIDES], tie=["map_seq"])).withColumn("c", F.explode(grid)).select("*", "c.*").drop("c")
        half = F.col("k") * F.col("sigma") * F.col("root")
        cell = F.concat_ws("/", *[F.col(c).cast("string") for c in KEYS])
        cells = cells.withColumns({"hours": F.col("horizon"), "horizon": F.col("horizon") * F.lit(HOUR), "upper": F.col("close") * (1 + half), "lower": F.col("close") * (1 - half), "cell": cell, "key": F.concat_ws("/", cell, F.col("t_open").cast("string"))})
        touched = settle(first_touches(cells, ticks, max(HORIZONS) * HOUR))
    spans = touched.where("outcome is not null").select("key", F.col("cell").alias("coin"), "t0", "t_end")
    weights = uniqueness(spans).select("key", F.round("weight", 6).alias("weight"))
    rows = touched.where("outcome in (1, -1)").join(weights, "key")
    return settle(rows.select("coin", F.col("hours").alias("horizon"), "k", "t_open", "t0", (F.col("outcome") == 1).cast("int").alias("y"), "weight", "map_seq", *research.SIDES))


def cell_labels(spark: SparkSession, d: str) -> DataFrame:
    return labelled_cells(spark, d).select(*KEYS, "t_open", "y", "weight", "map_seq")


def _kernel(alpha: float) -> Column:
    return research.kernel_score(research._masses(), alpha)


def evaluated(rows: DataFrame, reps: int = REPS) -> DataFrame:
    """The cells (`CELL`) of labelled rows: each kernel against the imbalance on rows that have a map."""
    y, w = F.col("y"), F.col("weight")
    summed = settle(rows.where("map_seq is not null").groupBy(*KEYS, "map_seq", "y").agg(F.count("*").alias("n"), F.sum(w.cast("decimal(18,6)")).cast("double").alias("w"), F.sum((w * w).cast("decimal(20,12)")).cast("double").alias("w2")))
    maps = rows.where("map_seq is not null").select("map_seq", *research.SIDES).distinct()
    drawn = maps.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps)))).withColumn("b8", research.permuted(F.col("rep"), F.col("map_seq")))
    drawn = drawn.select("map_seq", "rep", *[F.col("b8")[i].alias(c) for i, c in enumerate(research.SIDES)])
    scores = settle(drawn.select("map_seq", "rep", research._base().alias("b"), F.explode(F.array(*[F.struct(F.lit(a).alias("alpha"), _kernel(a).alias("p")) for a in ALPHAS])).alias("s")).select("map_seq", "rep", "b", "s.*"))
    lost = summed.join(scores, "map_seq").withColumns({"le": research._loss(F.col("p")), "lb": research._loss(F.col("b"))}).withColumn("dl", F.col("lb") - F.col("le"))
    s = lost.groupBy(*KEYS, "alpha", "rep").agg(F.sum("w").alias("sw"), F.sum("w2").alias("sw2"), F.sum(w_times("dl")).alias("sd"), F.sum(w_times("dl") * F.col("dl")).alias("sd2"))
    mean = F.col("sd") / F.col("sw")
    var = F.round(F.col("sd2") / F.col("sw") - mean * mean, 12)
    z = s.select(*KEYS, "alpha", "rep", F.when(var > 0, F.round(mean / F.sqrt(var / (F.col("sw") * F.col("sw") / F.col("sw2"))), 4)).otherwise(0.0).alias("z"))
    real = z.where("rep = 0").select(*KEYS, "alpha", F.col("z").alias("real"))
    beaten = F.sum((F.col("z") >= F.col("real")).cast("int"))
    placebo = z.where("rep > 0").join(real, [*KEYS, "alpha"]).groupBy(*KEYS, "alpha").agg(F.round((beaten + 1) / (F.count("*") + 1), 6).alias("p_value"))
    own = lost.where("rep = 0")
    edge = X.worth_betting(F.lit(MOVE_BPS), X.COSTS["maker"])
    up, down = F.col("p") >= edge, F.col("p") <= 1 - edge
    hits, bets = F.sum(F.when((up & (y == 1)) | (down & (y == 0)), F.col("n"))), F.sum(F.when(up | down, F.col("n")))
    rate = F.sum(F.when(y == 1, F.col("w"))) / F.sum("w")
    told = own.groupBy(*KEYS, "alpha").agg(F.sum("n").alias("n"), F.round(F.sum(w_times("le")) / F.sum("w"), 9).alias("loss"), F.round(F.sum(w_times("lb")) / F.sum("w"), 9).alias("base"), F.coalesce(rate, F.lit(0.0)).alias("rate"), F.round(F.coalesce(hits, F.when(bets > 0, 0)) / bets, 6).alias("hit_rate"))
    constant = F.round(-(F.col("rate") * F.log("rate") + (1 - F.col("rate")) * F.log(1 - F.col("rate"))), 9)
    inside = (F.col("rate") > 0) & (F.col("rate") < 1)
    beats = (F.col("loss") < F.col("base")) & (F.col("real") >= LEAST_Z) & inside & F.coalesce(F.col("loss") < constant, F.lit(False))
    out = told.join(real, [*KEYS, "alpha"]).join(placebo, [*KEYS, "alpha"], "left")
    return out.select(*KEYS, "alpha", "n", F.col("real").alias("z"), beats.alias("beats"), "p_value", "hit_rate", F.round(edge, 9).alias("threshold"))


def w_times(column: str) -> Column:
    return F.col("w") * F.col(column)


def decide(cells: DataFrame) -> DataFrame:
    """The gate over a table of cells (`CELL`): one row, whatever the table.

    The least alpha is the expert. It must win enough cells, all its wins must collapse
    under the placebo, and their decisions must clear the costs; and one alpha must win,
    collapsed, in more than half of all cells and clear the costs there.
    """
    won, collapsed = F.col("beats"), F.coalesce(F.col("p_value") <= PLACEBO_P, F.lit(False))
    clear = F.coalesce(F.col("hit_rate") > F.col("threshold"), F.lit(False))
    n = lambda c: F.coalesce(F.sum(c.cast("int")), F.lit(0))
    by = cells.groupBy("alpha").agg(F.count("*").alias("cells"), n(won).alias("wins"), n(won & collapsed).alias("collapsed"), n(won & clear).alias("clear"), n(won & collapsed & clear).alias("both"), F.coalesce(F.sum(F.when(won & collapsed, F.col("z"))), F.lit(0.0)).alias("edge"))
    majority = F.col("collapsed") * 2 > F.col("cells")
    best = F.max(F.when(majority, F.struct("collapsed", "edge", "alpha", (F.col("both") == F.col("collapsed")).alias("clears"))))
    first = lambda c: F.coalesce(F.min_by(c, "alpha"), F.lit(0))
    s = by.agg(first("cells").alias("cells"), first("wins").alias("wins"), first("collapsed").alias("c"), first("clear").alias("k"), best.alias("best"))
    some = F.col("wins") > 0
    s = s.select("cells", "wins", F.col("best.alpha").alias("winning_alpha"), ((F.col("cells") > 0) & (F.col("wins") * WINS_OF[1] >= F.col("cells") * WINS_OF[0])).alias("beats_baseline"), F.col("best").isNotNull().alias("kernel_wins"), (some & (F.col("c") == F.col("wins"))).alias("collapses"), (some & (F.col("k") == F.col("wins"))).alias("clears_cost"), F.coalesce(F.col("best.clears"), F.lit(False)).alias("kernel_clears"))
    return s.withColumn("passed", F.col("beats_baseline") & F.col("kernel_wins") & F.col("collapses") & F.col("clears_cost") & F.col("kernel_clears"))


def cells(spark: SparkSession, d: str) -> DataFrame:
    return evaluated(labelled_cells(spark, d))


def gate_cells(spark: SparkSession, d: str, evaluate=cells) -> DataFrame:
    """The gate's decision on the cells that ``evaluate(spark, d)`` gives."""
    return decide(evaluate(spark, d))


QUERIES = {"cell_labels": cell_labels, "cells": cells, "decide": gate_cells}

_MORE = research.MORE | {
    "celled": (["sigmas", "prints", "map_rows"], f"""grid AS (SELECT * FROM (VALUES {", ".join(f"({h}, {k}::DOUBLE, {float(max(1, h) ** 0.5)!r}::DOUBLE)" for h in HORIZONS for k in WIDTHS)}) g(horizon, k, root)),
        dec AS (SELECT b.coin, b.t_open, b.available_at AS t0, horizon, k, close * (1 + k * sigma * root) AS upper, close * (1 - k * sigma * root) AS lower FROM sigmas b, grid WHERE sigma > 0),
        lab AS (SELECT b.coin, b.t_open, b.t0, b.horizon, b.k, CASE WHEN count(p.px) = 0 THEN NULL ELSE coalesce(arg_min(CASE WHEN p.px >= b.upper THEN 1 WHEN p.px <= b.lower THEN -1 END, p.t_event) FILTER ((p.px >= b.upper OR p.px <= b.lower)), 0) END AS outcome,
            CASE WHEN count(p.px) = 0 THEN NULL ELSE coalesce(min(p.t_event) FILTER ((p.px >= b.upper OR p.px <= b.lower)), b.t0 + b.horizon * {HOUR}) END AS t_end
            FROM dec b LEFT JOIN prints p ON p.coin = b.coin AND p.t_event > b.t0 AND p.t_event <= b.t0 + b.horizon * {HOUR} GROUP BY b.coin, b.t_open, b.t0, b.horizon, b.k),
        sp AS (SELECT coin, horizon, k, t_open, t0, t_end FROM lab WHERE outcome IS NOT NULL),
        ar AS (SELECT coin, horizon, k, t, sum(coalesce((t - pt) / nullif(pc, 0), 0)) OVER (PARTITION BY coin, horizon, k ORDER BY t) AS area FROM (SELECT *, lag(t) OVER (PARTITION BY coin, horizon, k ORDER BY t) AS pt, lag(c) OVER (PARTITION BY coin, horizon, k ORDER BY t) AS pc
            FROM (SELECT coin, horizon, k, t, sum(d) OVER (PARTITION BY coin, horizon, k ORDER BY t) AS c FROM (SELECT coin, horizon, k, t, sum(d) AS d FROM (SELECT coin, horizon, k, t0 AS t, 1 AS d FROM sp UNION ALL SELECT coin, horizon, k, t_end, -1 FROM sp) GROUP BY 1, 2, 3, 4)))),
        wt AS (SELECT s.coin, s.horizon, s.k, s.t_open, CASE WHEN s.t_end > s.t0 THEN round((b.area - a.area) / (s.t_end - s.t0), 6) ELSE 1.0 END AS weight FROM sp s JOIN ar a ON s.coin = a.coin AND s.horizon = a.horizon AND s.k = a.k AND s.t0 = a.t JOIN ar b ON s.coin = b.coin AND s.horizon = b.horizon AND s.k = b.k AND s.t_end = b.t),
        celled AS (SELECT l.coin, l.horizon, l.k, l.t_open, CAST(l.outcome = 1 AS INT) AS y, w.weight, m.seq AS map_seq FROM (SELECT b.*, a.seq AS rseq FROM lab b ASOF LEFT JOIN (SELECT coin, t_ingest, max(seq) AS seq FROM map_rows GROUP BY 1, 2) a ON b.coin = a.coin AND b.t0 >= a.t_ingest WHERE b.outcome IN (1, -1)) l
            JOIN wt w ON l.coin = w.coin AND l.horizon = w.horizon AND l.k = w.k AND l.t_open = w.t_open LEFT JOIN map_rows m ON l.rseq = m.seq)"""),
}


def _sql(*names: str) -> str:
    return V.with_views(*names, more=_MORE)


def _power(alpha: float) -> str:
    up = " + ".join(f"{m} * {(x**-alpha)!r}::DOUBLE" for m, x in zip(research._SHELL[:4], research.DISTANCES, strict=True))
    down = " + ".join(f"{m} * {(x**-alpha)!r}::DOUBLE" for m, x in zip(research._SHELL[4:], research.DISTANCES, strict=True))
    return f"coalesce(CASE WHEN ({up}) + ({down}) > 0 THEN round(0.5 * (1 - (({down}) - ({up})) / (({up}) + ({down}))), 9) END, 0.5)"


_EDGE = 0.5 + 2.0 * 6.0 / (2 * MOVE_BPS)
_Z = "CASE WHEN round(sd2 / sw - (sd / sw) * (sd / sw), 12) > 0 THEN round((sd / sw) / sqrt(round(sd2 / sw - (sd / sw) * (sd / sw), 12) / (sw * sw / sw2)), 4) ELSE 0.0 END"
_CELLS = _sql("celled").rstrip() + f""", summed AS (SELECT coin, horizon, k, map_seq, y, count(*) AS n, CAST(sum(CAST(weight AS DECIMAL(18,6))) AS DOUBLE) AS w, CAST(sum(CAST(weight * weight AS DECIMAL(20,12))) AS DOUBLE) AS w2 FROM celled WHERE map_seq IS NOT NULL GROUP BY 1, 2, 3, 4, 5),
    maps AS (SELECT * FROM map_rows WHERE seq IN (SELECT map_seq FROM summed)),
    drawn AS (SELECT seq AS map_seq, rep, {", ".join(f"b[{i + 1}] AS {c}" for i, c in enumerate(research.SIDES))} FROM (SELECT seq, rep, {research._BANDS8.format(seq="seq")} AS b FROM maps, generate_series(0, {REPS}) r(rep))),
    scores AS ({" UNION ALL ".join(f"SELECT map_seq, rep, {research._BASE} AS b, {a!r}::DOUBLE AS alpha, {_power(a)} AS p FROM drawn" for a in ALPHAS)}),
    lost AS (SELECT *, lb - le AS dl FROM (SELECT s.*, rep, alpha, p, {research._LOSS.format(p="p")} AS le, {research._LOSS.format(p="b")} AS lb FROM summed s JOIN scores x ON s.map_seq = x.map_seq)),
    zs AS (SELECT coin, horizon, k, alpha, rep, {_Z} AS z FROM (SELECT coin, horizon, k, alpha, rep, sum(w) AS sw, sum(w2) AS sw2, sum(w * dl) AS sd, sum(w * dl * dl) AS sd2 FROM lost GROUP BY 1, 2, 3, 4, 5)),
    pv AS (SELECT f.coin, f.horizon, f.k, f.alpha, r.z, round((count(*) FILTER (f.z >= r.z) + 1) / (count(*) + 1)::DOUBLE, 6) AS p_value FROM zs f JOIN zs r ON f.coin = r.coin AND f.horizon = r.horizon AND f.k = r.k AND f.alpha = r.alpha AND r.rep = 0 WHERE f.rep > 0 GROUP BY 1, 2, 3, 4, 5),
    told AS (SELECT coin, horizon, k, alpha, CAST(sum(n) AS BIGINT) AS n, round(sum(w * le) / sum(w), 9) AS loss, round(sum(w * lb) / sum(w), 9) AS base, coalesce(sum(w) FILTER (y = 1) / sum(w), 0) AS rate,
        round(coalesce(sum(n) FILTER ((p >= {_EDGE} AND y = 1) OR (p <= 1 - {_EDGE}::DOUBLE AND y = 0)), 0) / CAST(sum(n) FILTER (p >= {_EDGE} OR p <= 1 - {_EDGE}::DOUBLE) AS DOUBLE), 6) AS hit_rate FROM lost WHERE rep = 0 GROUP BY 1, 2, 3, 4),
    cells AS (SELECT t.coin, t.horizon, t.k, t.alpha, n, z, loss < base AND z >= {LEAST_Z} AND rate > 0 AND rate < 1 AND coalesce(loss < round(-(rate * ln(nullif(rate, 0)) + (1 - rate) * ln(nullif(1 - rate, 0))), 9), FALSE) AS beats, p_value, hit_rate, {_EDGE!r}::DOUBLE AS threshold
        FROM told t JOIN pv ON t.coin = pv.coin AND t.horizon = pv.horizon AND t.k = pv.k AND t.alpha = pv.alpha)"""
SQL = {
    "cell_labels": _sql("celled") + "SELECT coin, horizon, k, t_open, y, weight, map_seq FROM celled",
    "cells": _CELLS + " SELECT * FROM cells",
    "decide": _CELLS + f""", a AS (SELECT alpha, count(*) AS cells, count(*) FILTER (beats) AS wins, count(*) FILTER (beats AND p_value <= {PLACEBO_P}) AS collapsed, count(*) FILTER (beats AND hit_rate > threshold) AS clear, count(*) FILTER (beats AND p_value <= {PLACEBO_P} AND hit_rate > threshold) AS both_,
        coalesce(sum(z) FILTER (beats AND p_value <= {PLACEBO_P}), 0) AS edge FROM cells GROUP BY 1),
        best AS (SELECT alpha, both_ = collapsed AS clears FROM a WHERE collapsed * 2 > cells ORDER BY collapsed DESC, edge DESC, alpha DESC LIMIT 1), e AS (SELECT * FROM a ORDER BY alpha LIMIT 1)
        SELECT cells, wins, (SELECT alpha FROM best) AS winning_alpha, cells > 0 AND wins * {WINS_OF[1]} >= cells * {WINS_OF[0]} AS beats_baseline, EXISTS (FROM best) AS kernel_wins, wins > 0 AND collapsed = wins AS collapses, wins > 0 AND clear = wins AS clears_cost, coalesce((SELECT clears FROM best), FALSE) AS kernel_clears,
        cells > 0 AND wins * {WINS_OF[1]} >= cells * {WINS_OF[0]} AND EXISTS (FROM best) AND wins > 0 AND collapsed = wins AND clear = wins AND coalesce((SELECT clears FROM best), FALSE) AS passed FROM e""",
}
