"""What is kept between runs: the frame, the wallets' series, map snapshots in a narrow and a wide form, actions, compacted files.

Each query writes its table as a job would, some of it twice, and returns what a reader finds.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.expressions import whole
from tidemark.operators.ordered import DAY
from tidemark.plans import integrity, landed, liquidity, market, research, wallets
from tidemark.session import settle, shared_folder
from tidemark.sources import log, sinks
from tidemark.sources import views as V

#: The levels that an action may have.
LEVELS = ("L0", "L1", "L2", "L3")
#: The time from which `open_log` reads.
SINCE = 19740 * DAY + 5
SERIES = ["t_event", "tid", "address", "coin", "leg"]


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/kept-{uuid.uuid4().hex}"


def frame_kept(spark: SparkSession, d: str) -> DataFrame:
    """The feature frame, written once and read back."""
    at, f = _folder(spark), research.frame(spark, d)
    sinks.put(f, at, "frame", ["coin", "t_open"])
    return sinks.get(spark, at, f.schema)


def series_kept(spark: SparkSession, d: str) -> DataFrame:
    """The wallets' running positions in the order of (time, trade, wallet), written twice; both copies are the same files, or this raises."""
    rows = wallets.series_of(wallets.legs_of(spark, d)).select("t_event", F.col("seq").alias("tid"), "address", "coin", F.col("leg").cast("int").alias("leg"), F.col("szi").cast("double").alias("szi"))
    at = [_folder(spark), _folder(spark)]
    for one in at:
        sinks.put(rows, one, "series", SERIES)
    told = [{(r.batch, r.file, r.sha256) for r in sinks.digests(spark, one).collect()} for one in at]  # a row a file
    if told[0] != told[1]:
        raise RuntimeError("the same series was written as different files")
    return sinks.get(spark, at[0], rows.schema)


def append_maps(narrow: DataFrame, wide: DataFrame, at: str, name: str) -> dict[str, bool]:
    """Add a snapshot in both forms, the narrow one first: whatever befalls the wide one, the narrow one is kept."""
    done = {"v1": sinks.put(narrow, f"{at}/v1", name, ["coin", "day"])}
    return done | {"v2": sinks.put(wide, f"{at}/v2", name, ["coin", "band"])}


def maps_kept(spark: SparkSession, d: str) -> DataFrame:
    """The history of maps appended week by week, a week of it twice, next to the wide masses as of each append."""
    history = settle(liquidity.map_history(spark, d))
    masses = settle(liquidity.wide_map(spark, d))
    wide = masses.select("coin", F.explode(F.create_map(*[x for c in masses.columns if c != "coin" for x in (F.lit(c), F.col(c))])).alias("band", "mass"))
    at = _folder(spark)
    weeks = sorted(r.w for r in history.select(F.expr("day div 7").alias("w")).distinct().collect())  # a row a week
    for w in [*weeks, *weeks[:1]]:
        append_maps(history.where(F.expr("day div 7") == w), wide, at, f"week-{w}")
    return sinks.get(spark, f"{at}/v1", history.schema)


def append_actions(rows: DataFrame, at: str, name: str) -> bool:
    """Add actions ``(seq, t_ingest, level, kind)``; one of a level that there is not raises, and nothing is added."""
    odd = rows.where(~F.coalesce(F.col("level").isin(*LEVELS), F.lit(False))).select("level").first()
    if odd is not None:
        raise ValueError(f"actions have no level {odd.level!r}")
    return sinks.put(rows, at, name, ["t_ingest", "seq"])


def actions_kept(spark: SparkSession, d: str) -> DataFrame:
    """Actions appended in two batches, then read by time and level."""
    t = settle(V.tape(spark, d).select("seq", "t_ingest", F.concat(F.lit("L"), (F.col("k") % 4).cast("string")).alias("level"), F.col("coin").alias("kind")))
    at = _folder(spark)
    for part in (0, 1):
        append_actions(t.where(F.col("seq") % 2 == part), at, f"batch-{part}")
    return sinks.get(spark, at, t.schema).where("t_ingest >= 1705276800000000000 and level in ('L2', 'L3')")


def compact(spark: SparkSession, at: str, manifest: DataFrame, out: str) -> list[str]:
    """Closed landed files to typed Parquet, a batch a day; days that are there, and days without a line, are skipped."""
    rows = spark.read.schema(f"{landed.LINE}, day int, part int").option("mode", "FAILFAST").json(at)
    days = sorted(r.day for r in manifest.select("day").distinct().collect())  # a row a day
    known = set(sinks.batches(spark, out))
    fresh = [day for day in days if f"day-{day}" not in known]
    return [f"day-{day}" for day in fresh if sinks.put(rows.where(F.col("day") == day).select("coin", "seq", "t_event", "t_ingest", "k"), out, f"day-{day}", ["coin", "seq"])]


def compacted(spark: SparkSession, d: str) -> DataFrame:
    """The landed tape, compacted as its days close; the open days stay out."""
    at = _folder(spark)
    landed.land(landed.lines_of(V.tape(spark, d)), f"{at}/tape")
    for today in landed.TODAYS:
        landed.close_finished(spark, f"{at}/tape", f"{at}/manifest", today)
        compact(spark, f"{at}/tape", spark.read.schema(landed.MANIFEST).parquet(f"{at}/manifest"), f"{at}/typed")
    return sinks.get(spark, f"{at}/typed", "coin string, seq long, t_event long, t_ingest long, k int")


def write_open_log(rows: DataFrame, at: str, key: list[str], order: list[str]) -> None:
    """Rows as a log whose every file is still being written: a line of JSON for each, and after the last one the beginning of another.

    Files are ``key``'s, in the order of ``order``. Lines end where the writer puts the next one's
    first character, so the file ends with that character and no newline.
    """
    first = F.row_number().over(Window.partitionBy(*key).orderBy(*order)) == 1
    text = F.to_json(F.struct(*[c for c in rows.columns if c not in key]))
    lines = rows.select(*key, *order, F.when(first, text).otherwise(F.substring(text, 2, 1 << 30)).alias("value"))
    dealt = lines.repartition(*key).sortWithinPartitions(*key, *order)
    dealt.select("value", *key).write.option("lineSep", "\n{").partitionBy(*key).text(at)


def open_log(spark: SparkSession, d: str) -> DataFrame:
    """The tape read from a log while its files are being written, from a time on: days before it are not opened, half a record at each file's end is left out."""
    t = V.tape(spark, d).select("coin", "seq", "t_event", "t_ingest", "k", whole(F.col("t_ingest"), DAY).cast("int").alias("day"), F.floor(F.col("seq") / landed.PART_ROWS).cast("int").alias("part"), F.col("coin").alias("of"))
    at = _folder(spark)
    write_open_log(t, at, ["of", "part", "day"], ["seq"])
    return log.read_log(spark, at, "coin string, seq long, t_event long, t_ingest long, k int", since=SINCE)


def event_log(spark: SparkSession, d: str) -> DataFrame:
    """Receipts kept as lines of JSON, a folder a day: by source and class how many there are in the log and the newest one."""
    c = integrity.calendar_of(spark, d).withColumn("day", whole(F.col("receipt_ts"), DAY).cast("int"))
    at = _folder(spark)
    write_open_log(c, at, ["day"], ["receipt_ts", "seq"])
    got = log.read_log(spark, at, "event_id string, class string, source string, source_ts long, receipt_ts long", clock="receipt_ts")
    return got.groupBy("source", "class").agg(F.count("*").alias("n"), F.max("receipt_ts").alias("newest"))


QUERIES = {f.__name__: f for f in (frame_kept, series_kept, maps_kept, actions_kept, compacted, open_log, event_log)}
SQL = {
    "frame_kept": research.SQL["frame"],
    "series_kept": wallets.sql("series") + "SELECT t_event, seq AS tid, address, coin, CAST(leg AS INT) AS leg, CAST(szi AS DOUBLE) AS szi FROM series",
    "maps_kept": liquidity.SQL["map_history"],
    "actions_kept": integrity.SQL["actions"],
    "open_log": market.sql("tape") + f"SELECT coin, seq, t_event, t_ingest, k FROM tape WHERE t_ingest >= {SINCE}",
    "event_log": integrity.SQL["event_counts"],
    "compacted": market.sql("tape") + f"SELECT coin, seq, t_event, t_ingest, k FROM tape WHERE t_ingest // 86400000000000 < {landed.TODAYS[-1]}",
}
