"""Queries of the research chain: feature frame, labels, folds, scores, calibration, placebo, gate."""

from __future__ import annotations

from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.expressions import whole
from tidemark.operators import bars as B
from tidemark.operators.labels import first_touch, uniqueness
from tidemark.operators.ordered import HOUR, asof
from tidemark.operators.ranks import ranked
from tidemark.plans import market
from tidemark.session import settle
from tidemark.sources import views as V

HORIZON = 4 * HOUR
K = 2.0
SPLITS = 5
REPS = 200
#: A placebo below this p-value says that the effect needs the map's masses where they are.
ALPHA = 0.01
SIDES = [f"{s}{i}" for s in ("up", "down") for i in range(1, 5)]
#: Distances of the four shells from the mark, in percent.
DISTANCES = (0.25, 0.75, 1.5, 3.5)
#: The frame's columns by source: where they come from and how many bars they look back.
FEATURES = {
    "open": ("bars", 1), "high": ("bars", 1), "low": ("bars", 1), "close": ("bars", 1), "volume": ("bars", 1), "notional": ("bars", 1), "prints": ("bars", 1), "vwap": ("bars", 1), "ret": ("bars", 1), "range": ("bars", 1),
    "sigma": ("bars", 30), "sigma_regime": ("bars", 149), "mark": ("context", 1), "premium": ("context", 1), "funding": ("context", 1), "oi_notional": ("context", 1), "premium_z": ("context", 20), "funding_z": ("context", 20), "oi_z": ("context", 20),
    **{c: ("map", 1) for c in SIDES}, **{f"{s}_shell{i}": ("map", 1) for s in ("up", "down") for i in range(1, 5)}, "imbalance": ("map", 1), "map_age_s": ("map", 1), "tau": ("liquidations", 30), "liq_flow": ("liquidations", 30),
}
_SHELL = [f"greatest(0.0, {s}{i}{f' - {s}{i - 1}' if i > 1 else ''})" for s in ("up", "down") for i in range(1, 5)]
MORE = market.MORE | {
    "ctxf": (["contexts"], f"ctxf AS (SELECT *, {market._Z.format(c='premium')} AS premium_z, {market._Z.format(c='funding')} AS funding_z, {market._Z.format(c='open_interest')} AS oi_z FROM (SELECT *, round((mark - oracle) / oracle, 12) AS premium FROM contexts) {market._W})"),
    "labels_": (["sigmas", "prints"], f"""labels_ AS (SELECT b.coin, b.t_open, b.t_close, b.t0, b.sigma, b.close, b.upper, b.lower, CASE WHEN count(p.px) = 0 THEN NULL ELSE coalesce(arg_min(CASE WHEN p.px >= b.upper THEN 1 WHEN p.px <= b.lower THEN -1 END, p.t_event) FILTER ((p.px >= b.upper OR p.px <= b.lower)), 0) END AS outcome,
        CASE WHEN count(p.px) = 0 THEN NULL ELSE coalesce(min(p.t_event) FILTER ((p.px >= b.upper OR p.px <= b.lower)), b.t0 + {HORIZON}) END AS t_end, coalesce(arg_min(p.px, p.t_event) FILTER ((p.px >= b.upper OR p.px <= b.lower)), arg_max(p.px, p.t_event)) AS price_end
        FROM (SELECT coin, t_open, t_close, available_at AS t0, sigma, close, close * (1 + {K}::DOUBLE * sigma * 2) AS upper, close * (1 - {K}::DOUBLE * sigma * 2) AS lower FROM sigmas WHERE sigma > 0) b
        LEFT JOIN prints p ON p.coin = b.coin AND p.t_event > b.t0 AND p.t_event <= b.t0 + {HORIZON}
        GROUP BY b.coin, b.t_open, b.t_close, b.t0, b.sigma, b.close, b.upper, b.lower)"""),
    "spans_": (["labels_"], "spans_ AS (SELECT coin, t_open, t0, t_end FROM labels_ WHERE outcome IS NOT NULL)"),
    "area_": (["spans_"], """area_ AS (SELECT coin, t, sum(coalesce((t - pt) / nullif(pc, 0), 0)) OVER (PARTITION BY coin ORDER BY t) AS area FROM (SELECT *, lag(t) OVER (PARTITION BY coin ORDER BY t) AS pt, lag(c) OVER (PARTITION BY coin ORDER BY t) AS pc
        FROM (SELECT coin, t, sum(d) OVER (PARTITION BY coin ORDER BY t) AS c FROM (SELECT coin, t, sum(d) AS d FROM (SELECT coin, t0 AS t, 1 AS d FROM spans_ UNION ALL SELECT coin, t_end, -1 FROM spans_) GROUP BY 1, 2))))"""),
    "weights_": (["area_"], "weights_ AS (SELECT s.coin, s.t_open, CASE WHEN t_end > t0 THEN round((b.area - a.area) / (t_end - t0), 6) ELSE 1.0 END AS weight FROM spans_ s JOIN area_ a ON s.coin = a.coin AND s.t0 = a.t JOIN area_ b ON s.coin = b.coin AND s.t_end = b.t)"),
    "scored_": (["weights_", "map_rows"], f"""scored_ AS (SELECT l.coin, l.t_open, l.t0, l.t_end, CAST(l.outcome = 1 AS INT) AS y, w.weight, m.seq AS map_seq, {', '.join('m.' + c for c in SIDES)} FROM
        (SELECT b.*, a.seq AS rseq FROM labels_ b ASOF LEFT JOIN (SELECT coin, t_ingest, max(seq) AS seq FROM map_rows GROUP BY 1, 2) a ON b.coin = a.coin AND b.t0 >= a.t_ingest WHERE b.outcome IN (1, -1)) l
        JOIN weights_ w ON l.coin = w.coin AND l.t_open = w.t_open LEFT JOIN map_rows m ON l.rseq = m.seq)"""),
}


def sql(*names: str) -> str:
    return V.with_views(*names, more=MORE)


def with_map(b: DataFrame, maps: DataFrame) -> DataFrame:
    """Bars with the columns of the map believed when they became available; rebuilding a frame's map columns is this alone."""
    m = maps.drop("mark").withColumnRenamed("t_ingest", "map_t")
    b = asof(b, m, ["coin"], "available_at", "map_t", ["map_t", *SIDES], tie=["seq"])
    shells = {f"{s}_shell{i}": F.when(F.col(f"{s}{i}").isNotNull(), F.greatest(F.lit(0.0), F.col(f"{s}{i}") - (F.col(f"{s}{i - 1}") if i > 1 else F.lit(0.0)))) for s in ("up", "down") for i in range(1, 5)}
    mass = F.col("up4") + F.col("down4")
    return b.withColumns(shells | {"imbalance": F.when(mass > 0, F.round((F.col("down4") - F.col("up4")) / mass, 9)).when(mass == 0, 0.0), "map_age_s": (F.col("available_at") - F.col("map_t")) / 1e9}).drop("map_t")


def frame_of(spark: SparkSession, d: str) -> DataFrame:
    """One row a bar with all FEATURES, joined as of the moment the bar became available; all coins in one job."""
    with V.one_tape(spark, d):
        return _frame_of(spark, d)


def _frame_of(spark: SparkSession, d: str) -> DataFrame:
    bars = settle(B.bars(V.prints(spark, d)))
    b = B.with_sigma(B.ratios(bars)).drop("lr")
    c = market.context_features(V.contexts(spark, d))
    take = ["mark", "premium", "funding", "oi_notional", "premium_z", "funding_z", "oi_z"]
    b = asof(b, c, ["coin"], "available_at", "t_ingest", take, tie=["seq"])
    b = with_map(b, V.map_rows(spark, d))
    b = b.join(market.event_features(bars, V.liquidations(spark, d)), ["coin", "t_open"], "left")
    out = b.select("coin", "t_open", "t_close", "available_at", *FEATURES)
    undeclared = set(out.columns) - set(FEATURES) - {"coin", "t_open", "t_close", "available_at"}
    if undeclared:
        raise ValueError(f"columns without a declaration: {sorted(undeclared)}")
    return out


def frame(spark: SparkSession, d: str) -> DataFrame:
    f = frame_of(spark, d)
    return f.withColumns({"funding": F.round("funding", 9)})


def frame_rebuild(spark: SparkSession, d: str) -> DataFrame:
    """The frame with its map columns rebuilt from another history: every second snapshot."""
    own = [n for n, (source, _) in FEATURES.items() if source == "map"]
    again = with_map(frame(spark, d).drop(*own), V.map_rows(spark, d).where("seq % 40 = 0"))
    return again.select("coin", "t_open", "close", "sigma", *own)


def frame_stats(spark: SparkSession, d: str) -> DataFrame:
    return frame_of(spark, d).groupBy("coin").agg(F.count("*").alias("rows"), F.count("up4").alias("with_map"), F.count("mark").alias("with_context"), F.count("sigma").alias("with_sigma"))


def spec_lookback(spark: SparkSession, d: str) -> DataFrame:
    """How many bars it takes, by coin and source, until every column of the source has had a value: the lookback that the frame shows.

    Row numbers run over bars, a summary of the prints.
    """
    f = frame_of(spark, d).withColumn("i", F.row_number().over(Window.partitionBy("coin").orderBy("t_open")))
    first = f.groupBy("coin").agg(*[F.min(F.when(F.col(n).isNotNull(), F.col("i"))).alias(n) for n in FEATURES])
    sources = sorted({s for s, _ in FEATURES.values()})
    own = {s: [F.col(n) for n, (x, _) in FEATURES.items() if x == s] for s in sources}
    rows = F.array(*[F.struct(F.lit(s).alias("source"), F.greatest(*own[s]).alias("seen_at"), F.lit(max(k for x, k in FEATURES.values() if x == s)).alias("declared")) for s in sources])
    return first.select("coin", F.explode(rows).alias("r")).select("coin", "r.*")


def ablation_cols(spark: SparkSession, d: str) -> DataFrame:
    """The frame without the map's columns."""
    return frame(spark, d).select("coin", "t_open", *[n for n, (s, _) in FEATURES.items() if s == "bars"])


def _decisions(spark: SparkSession, d: str) -> DataFrame:
    b = B.with_sigma(B.bars(V.prints(spark, d))).where("sigma > 0")
    half = K * F.col("sigma") * 2
    return b.select("coin", "t_open", "t_close", F.col("available_at").alias("t0"), "sigma", "close", (F.col("close") * (1 + half)).alias("upper"), (F.col("close") * (1 - half)).alias("lower"), F.concat_ws("/", "coin", F.col("t_open").cast("string")).alias("key"))


def _ticks(spark: SparkSession, d: str) -> DataFrame:
    return V.prints(spark, d).select("coin", "t_event", "seq", "px")


def labels_of(spark: SparkSession, d: str) -> DataFrame:
    with V.one_tape(spark, d):
        return settle(first_touch(settle(_decisions(spark, d)), _ticks(spark, d), HORIZON))


def triple_barrier(spark: SparkSession, d: str) -> DataFrame:
    return labels_of(spark, d).select("coin", "t_open", F.col("outcome").cast("int").alias("outcome"), "t_end", "price_end")


def race(spark: SparkSession, d: str) -> DataFrame:
    """Whether a target half a percent above is reached before its mirror image; timeouts count 0."""
    x = _decisions(spark, d).withColumns({"upper": F.col("close") * 1.005, "lower": F.col("close") - (F.col("close") * 1.005 - F.col("close"))})
    r = first_touch(settle(x), settle(_ticks(spark, d)), HORIZON)
    return r.select("coin", "t_open", F.when(F.col("outcome").isNotNull(), (F.col("outcome") == 1).cast("int")).alias("won"))


def fade(spark: SparkSession, d: str) -> DataFrame:
    """The label signed against the swept side, which alternates by the hour here."""
    r = labels_of(spark, d)
    side = F.when(whole(F.col("t_open"), HOUR) % 2 == 0, F.lit(1)).otherwise(F.lit(-1))
    return r.select("coin", "t_open", (F.col("outcome") * -side).cast("int").alias("faded"))


def _weights(spark: SparkSession, labels: DataFrame) -> DataFrame:
    return uniqueness(labels.where("outcome is not null").select("key", "coin", "t0", "t_end")).select("key", F.round("weight", 6).alias("weight"))


def uniqueness_weights(spark: SparkSession, d: str) -> DataFrame:
    r = labels_of(spark, d)
    return r.join(_weights(spark, r), "key").select("coin", "t_open", "weight")


def sample_weights(spark: SparkSession, d: str) -> DataFrame:
    """Average uniqueness of every decision's span; 0 where it is unresolved."""
    r = labels_of(spark, d)
    return r.join(_weights(spark, r), "key", "left").select("coin", "t_open", F.coalesce("weight", F.lit(0.0)).alias("weight"))


def label_stats(spark: SparkSession, d: str) -> DataFrame:
    r = labels_of(spark, d)
    n = lambda c: F.sum(c.cast("int"))
    o = F.col("outcome")
    return r.groupBy("coin").agg(F.count("*").alias("rows"), n(o.isNull()).alias("unresolved"), F.coalesce(n(o == 0), F.lit(0)).alias("timeouts"), F.coalesce(n(o == 1), F.lit(0)).alias("up"), F.coalesce(n(o == -1), F.lit(0)).alias("down"))


def scored_of(spark: SparkSession, d: str) -> DataFrame:
    """Labelled rows (timeouts left out) with their weight and the map believed at the decision."""
    r = labels_of(spark, d)
    rows = r.where("outcome in (1, -1)").join(_weights(spark, r), "key").select("coin", "t_open", "t0", "t_end", (F.col("outcome") == 1).cast("int").alias("y"), "weight")
    m = V.map_rows(spark, d).select("coin", F.col("seq").alias("map_seq"), F.col("t_ingest").alias("map_t"), *SIDES)
    return settle(asof(rows, m, ["coin"], "t0", "map_t", ["map_seq", *SIDES], tie=["map_seq"]))


def labelled(spark: SparkSession, d: str) -> DataFrame:
    return scored_of(spark, d).select("coin", "t_open", "y", "weight", "map_seq", "up4", "down4")


def _masses() -> list[Column]:
    return [F.greatest(F.lit(0.0), F.col(f"{s}{i}") - (F.col(f"{s}{i - 1}") if i > 1 else F.lit(0.0))) for s in ("up", "down") for i in range(1, 5)]


def kernel_score(masses: list[Column], alpha: float = 1.0) -> Column:
    """0.5 * (1 - asymmetry), where mass below weighs positive and each shell d^-alpha; 0.5 without mass."""
    w = [x**-alpha for x in DISTANCES]
    up = sum((m * k for m, k in zip(masses[:4], w, strict=True)), F.lit(0.0))
    down = sum((m * k for m, k in zip(masses[4:], w, strict=True)), F.lit(0.0))
    return F.coalesce(F.when(up + down > 0, F.round(0.5 * (1 - (down - up) / (up + down)), 9)), F.lit(0.5))


def alpha_score(spark: SparkSession, d: str) -> DataFrame:
    m = V.map_rows(spark, d)
    return m.select("coin", "seq", kernel_score(_masses()).alias("p"))


def baseline_score(spark: SparkSession, d: str) -> DataFrame:
    """The negated imbalance as a probability; 0.5 without mass."""
    mass = F.col("up4") + F.col("down4")
    return V.map_rows(spark, d).select("coin", "seq", F.when(mass > 0, F.round(0.5 * (1 - (F.col("down4") - F.col("up4")) / mass), 9)).otherwise(0.5).alias("p"))


def _loss(p: Column) -> Column:
    q = F.least(F.lit(1 - 1e-9), F.greatest(F.lit(1e-9), p))
    return F.when(F.col("y") == 1, -F.log(q)).otherwise(-F.log(1 - q))


def _base() -> Column:
    mass = F.col("up4") + F.col("down4")
    return F.coalesce(F.when(mass > 0, F.round(0.5 * (1 - (F.col("down4") - F.col("up4")) / mass), 9)), F.lit(0.5))


def eval_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Weighted losses of expert and baseline, paired z with effective size, by coin: one pass of weighted sums."""
    x = scored_of(spark, d).withColumns({"p": kernel_score(_masses()), "b": _base()})
    x = x.withColumns({"le": _loss(F.col("p")), "lb": _loss(F.col("b"))}).withColumn("dl", F.col("lb") - F.col("le"))
    w = F.col("weight")
    s = x.groupBy("coin").agg(F.count("*").alias("n"), F.sum(w).alias("sw"), F.sum(w * w).alias("sw2"), F.sum(w * F.col("le")).alias("le"), F.sum(w * F.col("lb")).alias("lb"), F.sum(w * F.pow(F.col("p") - F.col("y"), 2)).alias("br"), F.sum(w * F.col("y")).alias("sy"), F.sum(w * F.col("dl")).alias("sd"), F.sum(w * F.col("dl") * F.col("dl")).alias("sd2"))
    mean = F.col("sd") / F.col("sw")
    var = F.round(F.col("sd2") / F.col("sw") - mean * mean, 12)
    eff = F.col("sw") * F.col("sw") / F.col("sw2")
    return s.select("coin", "n", F.round(F.col("le") / F.col("sw"), 6).alias("log_loss"), F.round(F.col("lb") / F.col("sw"), 6).alias("base_loss"), F.round(F.col("br") / F.col("sw"), 6).alias("brier"), F.round(F.col("sy") / F.col("sw"), 6).alias("base_rate"), F.round(eff, 4).alias("n_eff"), F.when(var > 0, F.round(mean / F.sqrt(var / eff), 4)).alias("z"))


def folds_of(rows: DataFrame, splits: int = SPLITS, horizon: int = HORIZON) -> DataFrame:
    """Purged walk-forward folds by coin: each row's part in each fold, from its rank in time.

    Fold bounds are a few rows a coin; every row meets its coin's bounds in an equi join.
    """
    r = settle(ranked(rows, ["coin"], [F.col("t0"), F.col("t_open")], "i"))
    n = r.groupBy("coin").agg(F.count("*").alias("n"))
    folds = n.where(F.col("n") > splits).select("coin", "n", F.floor(F.col("n") / (splits + 1)).alias("block"), F.explode(F.sequence(F.lit(1), F.lit(splits))).alias("fold"))
    folds = folds.select("coin", "fold", (F.col("fold") * F.col("block")).alias("lo"), F.when(F.col("fold") == splits, F.col("n")).otherwise((F.col("fold") + 1) * F.col("block")).alias("hi"))
    inside = r.join(F.broadcast(folds), "coin").where("i >= lo and i < hi").groupBy("coin", "fold", "lo", "hi").agg(F.min("t0").alias("t_start"), F.max("t0").alias("t_stop"))  # splits rows a coin
    j = r.join(F.broadcast(inside), "coin")
    part = F.when((F.col("i") >= F.col("lo")) & (F.col("i") < F.col("hi")), "test").when(F.col("i") >= F.col("hi"), "future").when(F.col("t0") + horizon >= F.col("t_start"), "purged").otherwise("train")
    return j.withColumn("part", part)


def wfo(spark: SparkSession, d: str) -> DataFrame:
    f = folds_of(scored_of(spark, d).select("coin", "t_open", "t0"))
    n = lambda p: F.sum((F.col("part") == p).cast("int")).alias(f"n_{p}")
    return f.groupBy("coin", "fold").agg(n("train"), n("purged"), n("test"), n("future"), F.min("t_start").alias("t_start"), F.max("t_stop").alias("t_stop"))


def wfo_coverage(spark: SparkSession, d: str) -> DataFrame:
    """The share of rows that are tested, and rows tested more than once (none)."""
    f = folds_of(scored_of(spark, d).select("coin", "t_open", "t0"))
    tests = f.groupBy("coin", "t_open").agg(F.sum((F.col("part") == "test").cast("int")).alias("k"))
    return tests.groupBy("coin").agg(F.round(F.avg((F.col("k") > 0).cast("double")), 6).alias("coverage"), F.sum((F.col("k") > 1).cast("int")).alias("leaks"))


def walk_forward(spark: SparkSession, d: str) -> DataFrame:
    """The kernel expert's weighted loss on each fold's test rows; the fold is a column, all folds are one job."""
    x = folds_of(scored_of(spark, d)).where("part = 'test'").withColumn("p", kernel_score(_masses()))
    return x.groupBy("coin", "fold").agg(F.count("*").alias("n"), F.round(F.sum(F.col("weight") * _loss(F.col("p"))) / F.sum("weight"), 6).alias("log_loss"))


def isotonic(spark: SparkSession, d: str) -> DataFrame:
    """Calibrated probabilities at the distinct scores (two decimals) of the kernel expert."""
    x = scored_of(spark, d).select(F.round(kernel_score(_masses()), 2).alias("p"), F.col("y").cast("double").alias("y"))
    model = IsotonicRegression(featuresCol="p", labelCol="y").fit(x)
    out = model.transform(x.select("p").distinct())
    return out.select("p", F.round("prediction", 6).alias("calibrated"))


def permuted(rep: Column, seq: Column) -> Column:
    """The eight stored band masses of a snapshot in the order of a hash of (replication, snapshot, slot); replication 0 leaves them.

    The multiset of masses and the slots stay; the sort runs inside the row.
    """
    key = lambda i: F.when(rep == 0, F.lit(str(i))).otherwise(F.md5(F.concat_ws("-", F.lit("11"), rep.cast("string"), seq.cast("string"), F.lit(str(i)))))
    drawn = F.sort_array(F.array(*[F.struct(key(i).alias("h"), F.col(c).alias("m")) for i, c in enumerate(SIDES)]))
    return F.transform(drawn, lambda x: x["m"])


def permute(spark: SparkSession, d: str, reps: int = 3) -> DataFrame:
    """Snapshots with shuffled bands; half of them also swap which side their nearest clusters sit on."""
    m = V.map_rows(spark, d).withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(reps)))).withColumn("b", permuted(F.col("rep"), F.col("seq")))
    swap = F.substring(F.md5(F.concat_ws("-", F.lit("12"), F.col("rep").cast("string"), F.col("seq").cast("string"))), 1, 1) < "8"
    near = lambda own, other: F.round(F.when(swap, -F.col(other)).otherwise(F.col(own)), 6)
    return m.select("coin", F.col("seq").alias("map_seq"), "rep", *[F.col("b")[i].alias(c) for i, c in enumerate(SIDES)], near("near_up", "near_down").alias("near_up"), near("near_down", "near_up").alias("near_down"))


def placebo(spark: SparkSession, d: str, reps: int = REPS) -> DataFrame:
    """The paired z of expert over baseline against that under permuted maps, expert and baseline rebuilt from them: add-one p-value.

    All replications are one job; a row and replication never leave their task but for weighted sums by (coin, replication).
    """
    x = scored_of(spark, d).where("map_seq is not null").select("coin", "y", "weight", "map_seq", *SIDES)
    x = x.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps)))).withColumn("b8", permuted(F.col("rep"), F.col("map_seq")))
    x = x.select("coin", "rep", "y", "weight", *[F.col("b8")[i].alias(c) for i, c in enumerate(SIDES)])
    x = x.select("coin", "rep", "weight", (_loss(_base()) - _loss(kernel_score(_masses()))).alias("dl"))
    w = F.col("weight")
    s = x.groupBy("coin", "rep").agg(F.sum(w).alias("sw"), F.sum(w * w).alias("sw2"), F.sum(w * F.col("dl")).alias("sd"), F.sum(w * F.col("dl") * F.col("dl")).alias("sd2"))
    mean = F.col("sd") / F.col("sw")
    var = F.round(F.col("sd2") / F.col("sw") - mean * mean, 12)
    z = s.select("coin", "rep", F.when(var > 0, F.round(mean / F.sqrt(var / (F.col("sw") * F.col("sw") / F.col("sw2"))), 4)).otherwise(0.0).alias("z"))
    real = F.max(F.when(F.col("rep") == 0, F.col("z")))
    told = z.groupBy("coin").agg(real.alias("real_z"), F.sort_array(F.collect_list(F.when(F.col("rep") > 0, F.col("z")))).alias("zs"))  # reps values a coin
    beaten = F.size(F.filter("zs", lambda v: v >= F.col("real_z")))
    p = F.round((beaten + 1) / (F.size("zs") + 1), 6)
    return told.select("coin", "real_z", F.size("zs").alias("reps"), p.alias("p_value"), F.round(F.aggregate("zs", F.lit(0.0), lambda acc, v: acc + v) / F.size("zs"), 4).alias("mean_z"), F.element_at("zs", -1).alias("max_z"), (p <= ALPHA).alias("collapses"))


QUERIES = {f.__name__: f for f in (frame, frame_rebuild, frame_stats, spec_lookback, ablation_cols, triple_barrier, race, fade, uniqueness_weights, sample_weights, label_stats, labelled, alpha_score, baseline_score, eval_metrics, wfo, wfo_coverage, walk_forward, isotonic, permute, placebo)}

_W1 = [1 / x for x in DISTANCES]
_UPK = " + ".join(f"{m} * {k!r}::DOUBLE" for m, k in zip(_SHELL[:4], _W1, strict=True))
_DOWNK = " + ".join(f"{m} * {k!r}::DOUBLE" for m, k in zip(_SHELL[4:], _W1, strict=True))
_KERNEL = f"coalesce(CASE WHEN ({_UPK}) + ({_DOWNK}) > 0 AND up4 IS NOT NULL THEN round(0.5 * (1 - (({_DOWNK}) - ({_UPK})) / (({_UPK}) + ({_DOWNK}))), 9) END, 0.5)"
_BASE = "coalesce(CASE WHEN up4 + down4 > 0 THEN round(0.5 * (1 - (down4 - up4) / (up4 + down4)), 9) END, 0.5)"
_LOSS = "CASE WHEN y = 1 THEN -ln(least(1 - 1e-9, greatest(1e-9, {p}))) ELSE -ln(1 - least(1 - 1e-9, greatest(1e-9, {p}))) END"
_FOLDS = f"""folded AS (SELECT r.*, f.fold, f.lo, f.hi, min(CASE WHEN i >= lo AND i < hi THEN t0 END) OVER (PARTITION BY r.coin, fold) AS t_start, max(CASE WHEN i >= lo AND i < hi THEN t0 END) OVER (PARTITION BY r.coin, fold) AS t_stop
    FROM (SELECT *, row_number() OVER (PARTITION BY coin ORDER BY t0, t_open) - 1 AS i FROM scored_) r JOIN (SELECT coin, fold, fold * (n // {SPLITS + 1}) AS lo, CASE WHEN fold = {SPLITS} THEN n ELSE (fold + 1) * (n // {SPLITS + 1}) END AS hi FROM (SELECT coin, count(*) AS n FROM scored_ GROUP BY 1), generate_series(1, {SPLITS}) g(fold) WHERE n > {SPLITS}) f ON r.coin = f.coin),
    parted AS (SELECT *, CASE WHEN i >= lo AND i < hi THEN 'test' WHEN i >= hi THEN 'future' WHEN t0 + {HORIZON} >= t_start THEN 'purged' ELSE 'train' END AS part FROM folded)"""
_BANDS8 = "list_transform(list_sort([" + ", ".join(f"{{{{'h': CASE WHEN rep = 0 THEN '{i}' ELSE md5('11-' || rep || '-' || {{seq}} || '-{i}') END, 'm': {c}}}}}" for i, c in enumerate(SIDES)) + "]), lambda x: x.m)"
_RAW = market.SQL["event_feats"]
_EF = _RAW[_RAW.index("SELECT b.coin, b.t_open, (b.t_close - max") :]
_FRAME = f"""SELECT b.coin, b.t_open, b.t_close, b.available_at, b.open, b.high, b.low, b.close, b.volume, b.notional, b.prints, round(CASE WHEN volume <> 0 THEN notional / volume ELSE 0 END, 6) AS vwap, round((close - open) / open, 9) AS ret, round((high - low) / open, 9) AS range,
    b.sigma, b.sigma_regime, c.mark, round(c.premium, 9) AS premium, round(c.funding, 9) AS funding, round(c.open_interest * c.mark, 6) AS oi_notional, c.premium_z, c.funding_z, c.oi_z, {", ".join("m." + s for s in SIDES)},
    {", ".join(f"CASE WHEN m.{s}{i} IS NOT NULL THEN greatest(0.0, m.{s}{i}{f' - m.{s}{i - 1}' if i > 1 else ''}) END AS {s}_shell{i}" for s in ("up", "down") for i in range(1, 5))},
    CASE WHEN m.up4 + m.down4 > 0 THEN round((m.down4 - m.up4) / (m.up4 + m.down4), 9) WHEN m.up4 + m.down4 = 0 THEN 0.0 END AS imbalance, (b.available_at - m.t_ingest) / 1e9 AS map_age_s, e.tau, e.liq_flow
    FROM (SELECT s.*, a.seq AS cseq FROM sigmas s ASOF LEFT JOIN (SELECT coin, t_ingest, max(seq) AS seq FROM contexts GROUP BY 1, 2) a ON s.coin = a.coin AND s.available_at >= a.t_ingest) b
    LEFT JOIN (SELECT s.coin, s.t_open, a.seq AS mseq FROM sigmas s ASOF LEFT JOIN (SELECT coin, t_ingest, max(seq) AS seq FROM map_rows GROUP BY 1, 2) a ON s.coin = a.coin AND s.available_at >= a.t_ingest) k ON b.coin = k.coin AND b.t_open = k.t_open
    LEFT JOIN ctxf c ON b.cseq = c.seq LEFT JOIN map_rows m ON k.mseq = m.seq LEFT JOIN ({_EF}) e ON b.coin = e.coin AND b.t_open = e.t_open"""
_FW = sql("sigmas", "ctxf", "map_rows", "liquidations")

SQL = {
    "frame": _FW + _FRAME,
    "frame_rebuild": _FW.replace("seq % 20 = 0", "seq % 40 = 0") + "SELECT coin, t_open, close, sigma, " + ", ".join(n for n, (s, _) in FEATURES.items() if s == "map") + f" FROM ({_FRAME})",
    "frame_stats": _FW + f"SELECT coin, count(*) AS rows, count(up4) AS with_map, count(mark) AS with_context, count(sigma) AS with_sigma FROM ({_FRAME}) GROUP BY 1",
    "ablation_cols": _FW + "SELECT coin, t_open, " + ", ".join(n for n, (s, _) in FEATURES.items() if s == "bars") + f" FROM ({_FRAME})",
    "spec_lookback": " UNION ALL ".join(
        f"SELECT coin, '{s}' AS source, greatest({', '.join(f'min(i) FILTER ({n} IS NOT NULL)' for n, (x, _) in FEATURES.items() if x == s)}) AS seen_at, CAST({max(k for x, k in FEATURES.values() if x == s)} AS INT) AS declared FROM numbered GROUP BY 1"
        for s in sorted({x for x, _ in FEATURES.values()})
    ).join((_FW.rstrip() + f", numbered AS (SELECT *, row_number() OVER (PARTITION BY coin ORDER BY t_open) AS i FROM ({_FRAME})) ", "")),
    "triple_barrier": sql("labels_") + "SELECT coin, t_open, CAST(outcome AS INT) AS outcome, t_end, price_end FROM labels_",
    "race": sql("labels_").replace(f"close * (1 + {K}::DOUBLE * sigma * 2) AS upper", "close * 1.005::DOUBLE AS upper").replace(f"close * (1 - {K}::DOUBLE * sigma * 2) AS lower", "close - (close * 1.005::DOUBLE - close) AS lower") + "SELECT coin, t_open, CASE WHEN outcome IS NOT NULL THEN CAST(outcome = 1 AS INT) END AS won FROM labels_",
    "fade": sql("labels_") + "SELECT coin, t_open, CAST(outcome * CASE WHEN (t_open // 3600000000000) % 2 = 0 THEN -1 ELSE 1 END AS INT) AS faded FROM labels_",
    "uniqueness_weights": sql("weights_") + "SELECT * FROM weights_",
    "sample_weights": sql("weights_") + "SELECT l.coin, l.t_open, coalesce(weight, 0.0) AS weight FROM labels_ l LEFT JOIN weights_ w ON l.coin = w.coin AND l.t_open = w.t_open",
    "label_stats": sql("labels_") + "SELECT coin, count(*) AS rows, count(*) FILTER (outcome IS NULL) AS unresolved, count(*) FILTER (outcome = 0) AS timeouts, count(*) FILTER (outcome = 1) AS up, count(*) FILTER (outcome = -1) AS down FROM labels_ GROUP BY 1",
    "labelled": sql("scored_") + "SELECT coin, t_open, y, weight, map_seq, up4, down4 FROM scored_",
    "alpha_score": sql("map_rows") + f"SELECT coin, seq, {_KERNEL} AS p FROM map_rows",
    "baseline_score": sql("map_rows") + f"SELECT coin, seq, {_BASE} AS p FROM map_rows",
    "eval_metrics": sql("scored_") + f"""SELECT coin, n, round(le / sw, 6) AS log_loss, round(lb / sw, 6) AS base_loss, round(br / sw, 6) AS brier, round(sy / sw, 6) AS base_rate, round(sw * sw / sw2, 4) AS n_eff, CASE WHEN round(sd2 / sw - (sd / sw) * (sd / sw), 12) > 0 THEN round((sd / sw) / sqrt(round(sd2 / sw - (sd / sw) * (sd / sw), 12) / (sw * sw / sw2)), 4) END AS z
        FROM (SELECT coin, count(*) AS n, sum(weight) AS sw, sum(weight * weight) AS sw2, sum(weight * le) AS le, sum(weight * lb) AS lb, sum(weight * (p - y) * (p - y)) AS br, sum(weight * y) AS sy, sum(weight * (lb - le)) AS sd, sum(weight * (lb - le) * (lb - le)) AS sd2
        FROM (SELECT *, {_LOSS.format(p="p")} AS le, {_LOSS.format(p="b")} AS lb FROM (SELECT *, {_KERNEL} AS p, {_BASE} AS b FROM scored_)) GROUP BY 1)""",
    "wfo": sql("scored_").rstrip() + f", {_FOLDS} SELECT coin, CAST(fold AS INT) AS fold, count(*) FILTER (part = 'train') AS n_train, count(*) FILTER (part = 'purged') AS n_purged, count(*) FILTER (part = 'test') AS n_test, count(*) FILTER (part = 'future') AS n_future, min(t_start) AS t_start, max(t_stop) AS t_stop FROM parted GROUP BY 1, 2",
    "wfo_coverage": sql("scored_").rstrip() + f", {_FOLDS} SELECT coin, round(avg(CAST(k > 0 AS DOUBLE)), 6) AS coverage, count(*) FILTER (k > 1) AS leaks FROM (SELECT coin, t_open, count(*) FILTER (part = 'test') AS k FROM parted GROUP BY 1, 2) GROUP BY 1",
    "walk_forward": sql("scored_").rstrip() + f", {_FOLDS} SELECT coin, CAST(fold AS INT) AS fold, count(*) AS n, round(sum(weight * {_LOSS.format(p='p')}) / sum(weight), 6) AS log_loss FROM (SELECT *, {_KERNEL} AS p FROM parted WHERE part = 'test') GROUP BY 1, 2",
    "isotonic": sql("scored_").rstrip() + f""", s AS (SELECT round({_KERNEL}, 2) AS p, sum(y) AS sy, count(*) AS n FROM scored_ GROUP BY 1), c AS (SELECT row_number() OVER (ORDER BY p) AS i, p, sum(sy) OVER (ORDER BY p) AS cy, sum(n) OVER (ORDER BY p) AS cn FROM s),
        e AS (SELECT i, p, cy, cn FROM c UNION ALL SELECT 0, NULL, 0, 0) SELECT c.p, round(max(m), 6) AS calibrated FROM c JOIN (SELECT a.i AS lo, b.i AS k, min(w.cy_ratio) AS m FROM (SELECT DISTINCT i FROM e) a JOIN c b ON a.i < b.i JOIN (SELECT x.i AS a_i, z.i AS b_i, (z.cy - x.cy) / (z.cn - x.cn)::DOUBLE AS cy_ratio FROM e x JOIN c z ON x.i < z.i) w ON w.a_i = a.i AND w.b_i >= b.i GROUP BY 1, 2) q ON q.k = c.i GROUP BY 1""",
    "permute": sql("map_rows") + "SELECT coin, seq AS map_seq, CAST(rep AS INT) AS rep, " + ", ".join(f"b[{i + 1}] AS {c}" for i, c in enumerate(SIDES)) + f""", round(CASE WHEN swap THEN -near_down ELSE near_up END, 6) AS near_up, round(CASE WHEN swap THEN -near_up ELSE near_down END, 6) AS near_down
        FROM (SELECT *, {_BANDS8.format(seq="seq")} AS b, substr(md5('12-' || rep || '-' || seq), 1, 1) < '8' AS swap FROM map_rows, generate_series(1, 3) r(rep))""",
    "placebo": sql("scored_").rstrip() + ", moved AS (SELECT coin, rep, y, weight, " + ", ".join(f"b[{i + 1}] AS {c}" for i, c in enumerate(SIDES)) + f""" FROM (SELECT *, {_BANDS8.format(seq="map_seq")} AS b FROM scored_, generate_series(0, {REPS}) r(rep) WHERE map_seq IS NOT NULL)),
        lost AS (SELECT coin, rep, weight AS w, {_LOSS.format(p="b")} - {_LOSS.format(p="p")} AS dl FROM (SELECT *, {_KERNEL} AS p, {_BASE} AS b FROM moved)),
        zs AS (SELECT coin, rep, CASE WHEN round(sd2 / sw - (sd / sw) * (sd / sw), 12) > 0 THEN round((sd / sw) / sqrt(round(sd2 / sw - (sd / sw) * (sd / sw), 12) / (sw * sw / sw2)), 4) ELSE 0.0 END AS z FROM (SELECT coin, rep, sum(w) AS sw, sum(w * w) AS sw2, sum(w * dl) AS sd, sum(w * dl * dl) AS sd2 FROM lost GROUP BY 1, 2))
        SELECT f.coin, max(r.z) AS real_z, CAST(count(*) AS INT) AS reps, round((count(*) FILTER (f.z >= r.z) + 1) / (count(*) + 1)::DOUBLE, 6) AS p_value, round(avg(f.z), 4) AS mean_z, max(f.z) AS max_z, round((count(*) FILTER (f.z >= r.z) + 1) / (count(*) + 1)::DOUBLE, 6) <= {ALPHA} AS collapses
        FROM zs f JOIN zs r ON f.coin = r.coin AND r.rep = 0 WHERE f.rep > 0 GROUP BY 1""",
}
