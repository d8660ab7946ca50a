"""Opinions on which way a decision goes, each held against a plainer one on purged walk-forward folds.

An opinion is a record: the columns it reads, a score as a Column, and, if it learns,
a function from training rows to a table with a row for each (coin, fold). All folds of
all coins are then one job. `register` admits a record if the frame declares what it
reads and the opinion it has to beat is known. Whatever makes the table of a learning
opinion can be passed in, as can the opinions known.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import boosting
from tidemark.plans import cells, research
from tidemark.sources import views as V


@dataclass(frozen=True)
class Opinion:
    name: str
    #: Columns of the frame that the score or what it learns depends on.
    reads: tuple[str, ...]
    #: Makes the score, a Column from 0 to 1 over test rows joined with what was learned for their fold.
    score: Callable[[], Column]
    #: Makes the table of what is learned from training rows.
    learn: Callable[[DataFrame], DataFrame] | None = None
    #: Folds with fewer training rows have no score.
    needs: int = 0
    #: The name of the opinion to beat; None for the plainest.
    beats: str | None = None


KNOWN: dict[str, Opinion] = {}


def register(opinion: Opinion, known: dict[str, Opinion] = KNOWN) -> Opinion:
    """Admit an opinion, or say why not."""
    faults = [f"{c!r} is no column of the frame" for c in opinion.reads if c not in research.FEATURES]
    if opinion.beats is not None and opinion.beats not in known:
        faults.append(f"nothing is known as {opinion.beats!r}")
    if faults:
        raise LookupError(f"opinion {opinion.name!r}: " + "; ".join(faults))
    known[opinion.name] = opinion
    return opinion


def bars_back(opinion: Opinion) -> int:
    """How many bars an opinion looks back, by the frame's declarations."""
    return max([0, *(research.FEATURES[c][1] for c in opinion.reads)])


def boosted(name: str, reads: tuple[str, ...], settings: boosting.Settings = boosting.Settings(), fit=boosting.fit, beats: str = "imbalance") -> Opinion:  # noqa: B008
    """Boosted trees over some columns; ``fit`` may be anything that gives ``(coin, fold, base, trees)``."""

    def learn(train: DataFrame) -> DataFrame:
        rows = train if "key" in train.columns else train.withColumn("key", F.xxhash64("coin", "t_open"))
        return fit(rows, ["coin", "fold"], list(reads), settings)

    return Opinion(name, reads, lambda: boosting.score(list(reads)), learn, boosting.REFUSED_BELOW, beats)


def _rates(train: DataFrame) -> DataFrame:
    up = F.sum(F.col("weight") * F.col("y")) / F.sum("weight")
    return train.groupBy("coin", "fold").agg(F.round(up, 9).alias("rate"))


#: What the trees read: masses of the map, the context, and the trend, range and liquidations around.
TREE_READS = ("imbalance", "up1", "up2", "up4", "down1", "down2", "down4", "map_age_s", "premium", "premium_z", "funding_z", "oi_z", "ret", "range", "sigma", "sigma_regime", "tau", "liq_flow")
MAP_READS = tuple(c for c in TREE_READS if research.FEATURES[c][0] == "map")

register(Opinion("even", (), lambda: F.lit(0.5)))
register(Opinion("rate", (), lambda: F.col("rate"), _rates, 20, beats="even"))
register(Opinion("imbalance", ("up4", "down4"), research._base, beats="rate"))
register(Opinion("kernel", tuple(research.SIDES), lambda: research.kernel_score(research._masses()), beats="imbalance"))
register(boosted("trees", TREE_READS))
register(boosted("trees without map", tuple(c for c in TREE_READS if c not in MAP_READS)))
register(boosted("trees of map", MAP_READS))


def scored(opinion: Opinion, folds: DataFrame, name: str) -> DataFrame:
    """Test rows of all folds with an opinion's score under ``name``, null where its fold is too small."""
    test, train = folds.where("part = 'test'"), folds.where("part = 'train'")
    score = opinion.score()
    if opinion.learn is not None:
        test = test.join(opinion.learn(train), ["coin", "fold"], "left")
    if opinion.needs:
        sizes = train.groupBy("coin", "fold").agg(F.count("*").alias("__rows"))
        test = test.join(sizes, ["coin", "fold"], "left")
        score = F.when(F.col("__rows") >= opinion.needs, score)
    return test.select("coin", "fold", "t_open", "y", "weight", score.alias(name))


def evaluate(folds: DataFrame, names: Iterable[str], known: dict[str, Opinion] = KNOWN) -> DataFrame:
    """``(expert, baseline, coin, n, unfit, log_loss, base_loss)``: opinions and what they have to beat, on the same test rows.

    A row without a score from both is counted as unfit and lost to neither.
    """
    out = None
    for one in (known[name] for name in names):
        other = known[one.beats or one.name]
        pair = scored(one, folds, "p").join(scored(other, folds, "b").select("coin", "fold", "t_open", "b"), ["coin", "fold", "t_open"])
        both = F.col("p").isNotNull() & F.col("b").isNotNull()
        weight = F.when(both, F.col("weight"))
        mean = lambda loss: F.round(F.sum(weight * loss) / F.sum(weight), 6)  # noqa: E731, B023
        told = pair.groupBy("coin").agg(F.count("*").alias("n"), F.sum((~both).cast("int")).alias("unfit"), mean(research._loss(F.col("p"))).alias("log_loss"), mean(research._loss(F.col("b"))).alias("base_loss"))
        told = told.select(F.lit(one.name).alias("expert"), F.lit(other.name).alias("baseline"), "*")
        out = told if out is None else out.unionByName(told)
    return out


def expert_compare(spark: SparkSession, d: str) -> DataFrame:
    """The opinions that SQL can express, each against the one it has to beat."""
    with V.one_tape(spark, d):
        folds = research.settle(research.folds_of(research.scored_of(spark, d)))
    return evaluate(folds, ("imbalance", "kernel", "rate"))


def gbt_expert(spark: SparkSession, d: str) -> DataFrame:
    """Boosted trees on the frame's columns: every test row's score by the trees of its fold, null where the fold was refused.

    The folds hold the rows of all coins, labelled at four hours and one sigma.
    """
    with V.one_tape(spark, d):
        rows = cells.labelled_cells(spark, d).where("horizon = 4 and k = 1.0").drop("horizon", "k")
        frame = research.frame_of(spark, d)
        more = [c for c in TREE_READS if c not in rows.columns]
        rows = rows.join(frame.select("coin", "t_open", *more), ["coin", "t_open"]).withColumn("key", F.xxhash64("coin", "t_open"))
        folds = research.settle(research.folds_of(rows.withColumnsRenamed({"coin": "market"}).withColumn("coin", F.lit("all"))))
    trees = KNOWN["trees"]
    test = folds.where("part = 'test'").join(trees.learn(folds.where("part = 'train'")), ["coin", "fold"], "left")
    return test.select(F.col("market").alias("coin"), "fold", "t_open", "y", F.round(trees.score(), 9).alias("p"))


QUERIES = {f.__name__: f for f in (expert_compare, gbt_expert)}

_PAIRS = (("imbalance", "rate", research._BASE, "rate"), ("kernel", "imbalance", research._KERNEL, research._BASE), ("rate", "even", "rate", "0.5::DOUBLE"))

_ONE = """SELECT '{e}' AS expert, '{b}' AS baseline, coin, count(*) AS n, count(*) FILTER (NOT ({fit})) AS unfit, round(sum(weight * {lp}) FILTER ({fit}) / sum(weight) FILTER ({fit}), 6) AS log_loss, round(sum(weight * {lb}) FILTER ({fit}) / sum(weight) FILTER ({fit}), 6) AS base_loss
    FROM (SELECT *, {p} AS p, {q} AS b FROM judged) GROUP BY coin"""
SQL = {
    "expert_compare": research.sql("scored_").rstrip() + f""", {research._FOLDS}, rates AS (SELECT coin, fold, CASE WHEN count(*) >= 20 THEN round(sum(weight * y) / sum(weight), 9) END AS rate FROM parted WHERE part = 'train' GROUP BY 1, 2),
    judged AS (SELECT p.*, r.rate FROM parted p LEFT JOIN rates r ON p.coin = r.coin AND p.fold = r.fold WHERE part = 'test') """
    + " UNION ALL ".join(_ONE.format(e=e, b=b, p=p, q=q, fit="rate IS NOT NULL" if "rate" in (e, b) else "TRUE", lp=research._LOSS.format(p="p"), lb=research._LOSS.format(p="b")) for e, b, p, q in _PAIRS)
}
