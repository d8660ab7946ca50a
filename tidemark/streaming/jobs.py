"""Structured Streaming versions of ingest, bars, deduplication, silences and crossings.

Each job reads landed files, runs until they are used up (``availableNow``) and
keeps its state and progress in the shared folder, so a restart goes on where
it stopped. The queries here land the tape first and return what the job wrote.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.expressions import whole
from tidemark.operators.ordered import HOUR
from tidemark.plans import market
from tidemark.session import settle, shared_folder
from tidemark.sources import views as V
from tidemark.streaming import stateful


#: Files in which the tape lands here.
FILES = 4


def _landed(spark: SparkSession, d: str, rows: DataFrame | None = None, by: str = "t_event") -> tuple[DataFrame, str]:
    """The tape landed as files in the order of ``by``, read back as a stream with a TIMESTAMP clock."""
    at = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    rows = V.prints(spark, d) if rows is None else rows
    dealt = settle(rows.repartitionByRange(FILES, by).withColumn("__file", F.spark_partition_id()))
    for k in range(FILES):  # one after the other: streams take files by the time at which they landed
        dealt.where(F.col("__file") == k).drop("__file").coalesce(1).sortWithinPartitions(by).write.mode("append").parquet(f"{at}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(f"{at}/in")
    return stream.withColumn("at", F.timestamp_micros(whole(F.col(by), 1000))), at


def run(out: DataFrame, at: str, own_state: bool = False) -> DataFrame:
    """What the stream ``out`` writes below ``at`` until its input is used up; a run with the same ``at`` goes on where the last one stopped."""
    spark = out.sparkSession
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    if own_state:
        spark.conf.set(key, stateful.ROCKS)  # state with timers needs this store; a query keeps what is set at its start
    try:
        query = out.writeStream.format("parquet").option("checkpointLocation", f"{at}/progress").option("path", f"{at}/out").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(key, before)
    return spark.read.schema(out.schema).parquet(f"{at}/out")


def stream_ingest(spark: SparkSession, d: str) -> DataFrame:
    """Landed prints to typed Parquet, each once."""
    stream, at = _landed(spark, d)
    return run(stream.drop("at"), at)


def stream_bars(spark: SparkSession, d: str) -> DataFrame:
    """Hourly bars in append mode: a bar is out when the watermark has passed it, two hours behind the newest print."""
    stream, at = _landed(spark, d)
    first, size = F.struct("t_event", "seq"), F.col("sz").cast("decimal(12,3)")
    bars = stream.withWatermark("at", "2 hours").groupBy("coin", F.window("at", "1 hour")).agg(
        F.min_by("px", first).alias("open"), F.max("px").alias("high"), F.min("px").alias("low"), F.max_by("px", first).alias("close"), F.count("*").alias("prints"), F.sum(size).cast("double").alias("volume"),
        F.sum((F.col("px").cast("decimal(20,6)") * size).cast("decimal(32,9)")).cast("double").alias("notional"), F.max("t_ingest").alias("last"),
    )
    done = run(bars, at).withColumn("t_open", F.unix_micros(F.col("window.start")) * 1000)
    return done.select("coin", "t_open", "open", "high", "low", "close", "volume", "notional", "prints", F.greatest("last", F.col("t_open") + HOUR).alias("available_at"))


def stream_alerts(spark: SparkSession, d: str) -> DataFrame:
    """Alerts of silent coins, each opened once and closed by the arrival that ends it; some are still open at the end."""
    stream, at = _landed(spark, d, V.tape(spark, d), by="t_ingest")
    return run(stateful.gap_events(stream, market.QUIET), at, own_state=True).select("coin", "event", "t_from", "t_to").distinct()


def stream_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Minutes of silence by ISO week, from the alerts."""
    stream, at = _landed(spark, d, V.tape(spark, d), by="t_ingest")
    closed = run(stateful.gap_events(stream, market.QUIET), at, own_state=True).where("event = 'recovery'")
    return closed.groupBy("coin", "week").agg(F.round(F.sum(F.col("ns").cast("decimal(38,0)")).cast("double") / market.MINUTE, 6).alias("minutes"))


def stream_sma(spark: SparkSession, d: str) -> DataFrame:
    """Crossings of close and moving average, from the stream of prints."""
    stream, at = _landed(spark, d)
    return run(stateful.crossings(stream), at, own_state=True)


def stream_dedup(spark: SparkSession, d: str) -> DataFrame:
    """The first row of every tid within the watermark; the landed files hold every print twice."""
    stream, at = _landed(spark, d)
    twice = stream.unionByName(stream)
    return run(twice.withWatermark("at", "1 day").dropDuplicatesWithinWatermark(["tid"]), at).select("coin", "tid", "px", "sz")


def stream_replay(spark: SparkSession, d: str) -> DataFrame:
    """Position flows replayed batch by batch; a batch that runs again replaces its own folder, so nothing counts twice."""
    from tidemark.plans.wallets import legs

    stream, at = _landed(spark, d)

    def merge(batch: DataFrame, batch_id: int) -> None:
        flows = legs(batch).groupBy("address", "coin").agg(F.sum("signed").cast("decimal(22,3)").alias("delta"), F.count("*").alias("fills"))
        flows.write.mode("overwrite").parquet(f"{at}/flows/batch={batch_id}")

    stream.writeStream.foreachBatch(merge).option("checkpointLocation", f"{at}/progress").trigger(availableNow=True).start().awaitTermination()
    found = spark.read.schema("address string, coin string, delta decimal(22,3), fills long").parquet(f"{at}/flows/*")
    return found.groupBy("address", "coin").agg(F.sum("delta").cast("double").alias("delta"), F.sum("fills").alias("fills"))


QUERIES = {f.__name__: f for f in (stream_ingest, stream_bars, stream_alerts, stream_gaps, stream_sma, stream_dedup, stream_replay)}
SQL = {
    "stream_ingest": V.with_views("prints") + "SELECT * FROM prints",
    "stream_replay": V.with_views("prints") + "SELECT address, coin, CAST(sum(s) AS DOUBLE) AS delta, count(*) AS fills FROM (SELECT buyer AS address, coin, CAST(sz AS DECIMAL(12,3)) AS s FROM prints UNION ALL SELECT seller, coin, -CAST(sz AS DECIMAL(12,3)) FROM prints) GROUP BY 1, 2",
    "stream_bars": market.sql("bars") + "SELECT coin, t_open, open, high, low, close, volume, notional, prints, available_at FROM bars WHERE t_close <= ((SELECT max(t_event) FROM prints) // 1000000) * 1000000 - 7200000000000",
    "stream_alerts": market.sql("tape").rstrip() + f""", s AS (SELECT coin, t_from, t_to FROM {market._GAPS} WHERE t_to - t_from > {market.QUIET}), e AS (SELECT coin, max(t_ingest) AS t_from FROM tape GROUP BY 1)
        SELECT coin, 'open' AS event, t_from, CAST(NULL AS BIGINT) AS t_to FROM s UNION ALL SELECT coin, 'recovery', t_from, t_to FROM s
        UNION ALL SELECT coin, 'open', t_from, NULL FROM e WHERE (t_from + {market.QUIET}) // 1000000 + 1 <= (SELECT max(t_ingest) FROM tape) // 1000000""",
    "stream_gaps": market.SQL["gap_minutes"],
    "stream_sma": market.SQL["sma_cross"],
    "stream_dedup": V.with_views("prints") + "SELECT coin, tid, px, sz FROM prints",
}
