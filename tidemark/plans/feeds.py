"""Feeds by name: how the payload of each stream tells its id, its time and its class.

A feed is a record of Columns over ``payload``, a text of JSON, so a stream is added by
registering one; rows of all feeds are parsed in one pass, each by its own record. A
stream without a record is kept, with nulls, and counted by `unknown`. A payload that
is broken, or lacks what its feed needs, gives nulls as well.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.expressions import iso_ns, ntz
from tidemark.sources import views as V

PARSED = "stream string, t_ingest long, event_id string, class string, t_event long"


@dataclass(frozen=True)
class Feed:
    stream: str
    event_id: Column
    kind: Column
    #: The event's own time in UTC nanoseconds; a null for feeds that tell none.
    t_event: Column


def _at(path: str) -> Column:
    return F.get_json_object("payload", path)


def standard() -> dict[str, Feed]:
    """The feeds that come with the library."""
    own = (
        Feed("trades", _at("$.tid"), F.lit("trade"), _at("$.time").cast("long") * 1_000_000),
        Feed("contexts", F.concat_ws("/", _at("$.coin"), F.col("t_ingest").cast("string")), F.lit("context"), F.lit(None).cast("long")),
        Feed("posts", _at("$.guid"), F.lower(_at("$.title")), iso_ns(_at("$.published"))),
        Feed("releases", _at("$.id"), F.coalesce(_at("$.series"), F.lit("release")), iso_ns(F.concat(_at("$.date"), F.lit("T"), _at("$.utc")))),
    )
    return {feed.stream: feed for feed in own}


def parsed(envelopes: DataFrame, feeds: dict[str, Feed] | None = None) -> DataFrame:
    """`PARSED` of envelopes ``(stream, t_ingest, payload)``, by the feed of each row's stream."""
    feeds = standard() if feeds is None else feeds
    pick = lambda what, kind: F.coalesce(F.lit(None).cast(kind), *[F.when(F.col("stream") == name, what(feed)) for name, feed in feeds.items()])
    return envelopes.select("stream", "t_ingest", pick(lambda f: f.event_id, "string").alias("event_id"), pick(lambda f: f.kind, "string").alias("class"), pick(lambda f: f.t_event, "long").alias("t_event"))


def unknown(envelopes: DataFrame, feeds: dict[str, Feed] | None = None) -> DataFrame:
    """``(stream, n)`` of streams without a feed."""
    return envelopes.where(~F.coalesce(F.col("stream").isin(*(standard() if feeds is None else feeds)), F.lit(False))).groupBy("stream").agg(F.count("*").alias("n"))


def envelopes(spark: SparkSession, d: str) -> DataFrame:
    """The tape as envelopes of four streams and one that no feed knows."""
    t = V.tape(spark, d)
    clock = F.date_format(ntz(F.col("t_event")), "yyyy-MM-dd'T'HH:mm:ss")
    payload = (
        F.when(F.col("seq") % 5 == 0, F.to_json(F.struct(F.col("tid").alias("tid"), F.expr("t_event div 1000000").alias("time"), "px")))
        .when(F.col("seq") % 5 == 1, F.to_json(F.struct("coin", F.col("k").alias("mark"))))
        .when(F.col("seq") % 5 == 2, F.to_json(F.struct(F.concat(F.lit("p"), F.col("seq")).alias("guid"), F.concat(F.lit("On "), F.initcap("coin")).alias("title"), F.concat(clock, F.lit("+02:00")).alias("published"))))
        .when(F.col("seq") % 5 == 3, F.to_json(F.struct(F.col("seq").alias("id"), F.substring(clock, 1, 10).alias("date"), F.lit("14:30:00").alias("utc"), F.when(F.col("k") % 2 == 0, F.col("coin")).alias("series"))))
        .otherwise(F.lit("{broken"))
    )
    stream = F.element_at(F.array(*map(F.lit, ("trades", "contexts", "posts", "releases", "noise"))), (F.col("seq") % 5 + 1).cast("int"))
    return t.select(stream.alias("stream"), "t_ingest", payload.alias("payload"))


def feeds_parsed(spark: SparkSession, d: str) -> DataFrame:
    return parsed(envelopes(spark, d))


def feeds_unknown(spark: SparkSession, d: str) -> DataFrame:
    return unknown(envelopes(spark, d))


QUERIES = {f.__name__: f for f in (feeds_parsed, feeds_unknown)}
_CLOCK = "date_trunc('second', make_timestamp(t_event // 1000))"
SQL = {
    "feeds_parsed": V.with_views("tape") + f"""SELECT (['trades', 'contexts', 'posts', 'releases', 'noise'])[seq % 5 + 1] AS stream, t_ingest,
        CASE seq % 5 WHEN 0 THEN CAST(tid AS VARCHAR) WHEN 1 THEN coin || '/' || t_ingest WHEN 2 THEN 'p' || seq WHEN 3 THEN CAST(seq AS VARCHAR) END AS event_id,
        CASE seq % 5 WHEN 0 THEN 'trade' WHEN 1 THEN 'context' WHEN 2 THEN 'on ' || coin WHEN 3 THEN CASE WHEN k % 2 = 0 THEN coin ELSE 'release' END END AS class,
        CASE seq % 5 WHEN 0 THEN t_event // 1000000 * 1000000 WHEN 2 THEN epoch_us({_CLOCK}) * 1000 - 7200000000000 WHEN 3 THEN epoch_us(date_trunc('day', make_timestamp(t_event // 1000))) * 1000 + 52200000000000 END AS t_event FROM tape""",
    "feeds_unknown": V.with_views("tape") + "SELECT 'noise' AS stream, count(*) AS n FROM tape WHERE seq % 5 = 4 HAVING count(*) > 0",
}
