"""Market tables derived from the given star-schema tables: a tape, contexts, wallets, positions, maps.

Every view exists twice: as a DataFrame for the operators and, in `SQL`, as the
same definition in SQL for checking. Times are whole nanoseconds since 1970.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.expressions import whole
from tidemark.operators.ordered import running_sum
from tidemark.session import settle

BANDS = ("0.005", "0.01", "0.02", "0.05")
COINS = ("click", "error", "purchase", "signup", "view")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts: str = "ts"):
    """Microseconds since 1970 of a timestamp without zone, whatever the session's zone."""
    days = F.datediff(F.to_date(ts), F.lit("1970-01-01")).cast("long")
    seconds = F.expr(f"cast(extract(second from {ts}) * 1000000 as long)")
    return days * 86_400_000_000 + F.hour(ts).cast("long") * 3_600_000_000 + F.minute(ts).cast("long") * 60_000_000 + seconds


_settled: dict[tuple[str, str], DataFrame] = {}


@contextmanager
def one_tape(spark: SparkSession, d: str) -> Iterator[None]:
    """Inside, every view reads one typed tape that is computed once, in the shared folder."""
    key = (spark.sparkContext.applicationId, d)
    if key in _settled:
        yield
        return
    _settled[key] = settle(tape(spark, d))
    try:
        yield
    finally:
        del _settled[key]


def tape(spark: SparkSession, d: str) -> DataFrame:
    """Prints of coins: event time and arrival time, size, price, both parties."""
    if (found := _settled.get((spark.sparkContext.applicationId, d))) is not None:
        return found
    e = table(spark, d, "events")
    rows = e.select(
        F.col("event_type").alias("coin"), F.col("event_id").alias("seq"), F.col("event_id").alias("tid"),
        (micros() * 1000).alias("t_event"), ((micros() + (F.col("event_id") * 7919 % 90) * 1_000_000) * 1000).alias("t_ingest"),
        F.regexp_extract("props", r'"k": *(\d+)', 1).cast("int").alias("k"),
        F.concat(F.lit("w"), F.col("user_id").cast("string")).alias("buyer"), F.concat(F.lit("w"), (F.col("event_id") % 15).cast("string")).alias("seller"),
    )
    walked = running_sum(rows, ["coin"], "t_event", ["seq"], (2 * F.col("k") - 99).cast("long"), "walk")
    return walked.select("coin", "seq", "tid", "t_event", "t_ingest", "k", F.col("k").cast("double").alias("sz"), F.round(100 * F.exp(0.00004 * F.col("walk")), 6).alias("px"), "buyer", "seller")


def prints(spark: SparkSession, d: str) -> DataFrame:
    """The tape's prints with a positive size and price."""
    return tape(spark, d).where("sz > 0 and px > 0")


def contexts(spark: SparkSession, d: str) -> DataFrame:
    """Per-coin market contexts by arrival time."""
    e = F.col("seq")
    return tape(spark, d).where("seq % 5 = 0").select(
        "coin", "seq", "t_ingest", F.col("px").alias("mark"), (F.col("px") * (1 + ((e % 11) - 5) / 10000)).alias("oracle"), (((e % 7) - 3) / 100000).alias("funding"),
        (1000 + e % 500).cast("double").alias("open_interest"), (1000000 + (e % 1000) * 1000).cast("double").alias("day_volume"),
    )


def wallets(spark: SparkSession, d: str) -> DataFrame:
    """A partial registry: address, equity, weekly volume."""
    c = table(spark, d, "customer").where("c_nationkey % 3 = 0")
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("v"))
    return c.join(o, c.c_custkey == o.o_custkey, "left").select(F.concat(F.lit("w"), F.col("c_custkey").cast("string")).alias("address"), F.col("c_acctbal").alias("account_value"), F.coalesce(F.col("v").cast("double"), F.lit(0.0)).alias("vlm_week"))


def marks(spark: SparkSession, d: str) -> DataFrame:
    """Every coin's latest context, by arrival and sequence."""
    return contexts(spark, d).groupBy("coin").agg(F.max_by(F.struct("mark", "open_interest", "day_volume", "t_ingest"), F.struct("t_ingest", "seq")).alias("c")).select("coin", "c.*")


def positions(spark: SparkSession, d: str) -> DataFrame:
    """Signed positions of addresses, with margin and, for some, a published liquidation price."""
    o = table(spark, d, "orders")
    coin = F.element_at(F.array(*map(F.lit, COINS)), (F.col("o_orderkey") % 5 + 1).cast("int"))
    sums = o.select("o_custkey", coin.alias("coin"), ((F.col("o_orderkey") % 2 * 2 - 1) * (F.col("o_orderkey") % 97 + 1)).alias("s")).groupBy("o_custkey", "coin").agg(F.sum("s").alias("s"))
    c = table(spark, d, "customer").select("c_custkey", "c_acctbal")
    full = sums.join(c, sums.o_custkey == c.c_custkey).join(marks(spark, d).select("coin", "mark"), "coin")  # a row a coin: adaptive execution broadcasts it by its size
    key = F.col("o_custkey")
    return full.select(
        F.concat(F.lit("w"), key.cast("string")).alias("address"), "coin", (F.col("s") / 10).alias("szi"), "mark", (5 + (key % 4) * 10).cast("int").alias("max_leverage"),
        F.when(key % 3 == 0, "isolated").otherwise("cross").alias("margin_type"), F.col("c_acctbal").alias("account_value"),
        F.when(key % 4 == 0, F.col("mark") * (1 + ((key % 41) - 20) / 200)).alias("liquidation_px"),
    ).where("szi <> 0")


def liquidations(spark: SparkSession, d: str) -> DataFrame:
    """Forced closes on the tape."""
    return tape(spark, d).where("seq % 50 = 7").select(
        "tid", "t_event", "t_ingest", "coin", F.col("buyer").alias("liquidated_user"), F.col("px").alias("mark_px"), F.when(F.col("seq") % 350 == 7, "backstop").otherwise("market").alias("method"),
        "px", "sz", F.col("seller").alias("observer"), F.when(F.col("seq") % 4 == 3, "self").otherwise("counterparty").alias("source"),
    )


def map_rows(spark: SparkSession, d: str) -> DataFrame:
    """Map snapshots: cumulated mass in four bands on each side, nearest clusters."""
    e = F.col("seq")
    shell = lambda m, n: ((e * m) % n * ((e * m) % 3 > 0).cast("int") * 1000).cast("double")
    u1, u2, u3, u4 = shell(7, 83), shell(11, 71), shell(13, 61), shell(17, 53)
    d1, d2, d3, d4 = shell(19, 83), shell(23, 71), shell(29, 61), shell(31, 53)
    names = ("up1", "up2", "up3", "up4", "down1", "down2", "down3", "down4")
    sums = (u1, u1 + u2, u1 + u2 + u3, u1 + u2 + u3 + u4, d1, d1 + d2, d1 + d2 + d3, d1 + d2 + d3 + d4)
    return contexts(spark, d).where("seq % 20 = 0").select("coin", "seq", "t_ingest", "mark", *[s.alias(n) for s, n in zip(sums, names, strict=True)], (0.001 * (e % 40 + 1)).alias("near_up"), (-0.001 * (e % 30 + 1)).alias("near_down"))


def manifest(spark: SparkSession, d: str) -> DataFrame:
    """The tape's files: a row for each coin and hour of arrival."""
    hour = whole(F.col("t_ingest"), 3_600_000_000_000)
    return tape(spark, d).groupBy("coin", hour.alias("hour")).agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.min("t_ingest").alias("first_ingest"), F.max("t_ingest").alias("last_ingest"), F.count("*").alias("lines"))


_SHELL = "CAST((seq * {m}) % {n} * CAST((seq * {m}) % 3 > 0 AS INT) * 1000 AS DOUBLE)"
_UP = [_SHELL.format(m=m, n=n) for m, n in ((7, 83), (11, 71), (13, 61), (17, 53))]
_DOWN = [_SHELL.format(m=m, n=n) for m, n in ((19, 83), (23, 71), (29, 61), (31, 53))]

#: The views in SQL, each after those it reads.
SQL = {
    "tape": """tape AS (SELECT coin, seq, tid, t_event, t_ingest, k, CAST(k AS DOUBLE) AS sz,
        round(100 * exp(0.00004 * sum(2 * k - 99) OVER (PARTITION BY coin ORDER BY seq)), 6) AS px, buyer, seller
        FROM (SELECT event_type AS coin, event_id AS seq, event_id AS tid, epoch_us(ts) * 1000 AS t_event,
            (epoch_us(ts) + (event_id * 7919 % 90) * 1000000) * 1000 AS t_ingest, CAST(regexp_extract(props, '"k": *(\\d+)', 1) AS INT) AS k,
            'w' || CAST(user_id AS VARCHAR) AS buyer, 'w' || CAST(event_id % 15 AS VARCHAR) AS seller FROM events))""",
    "prints": "prints AS (SELECT * FROM tape WHERE sz > 0 AND px > 0)",
    "contexts": """contexts AS (SELECT coin, seq, t_ingest, px AS mark, px * (1 + ((seq % 11) - 5) / 10000.0::DOUBLE) AS oracle, ((seq % 7) - 3) / 100000.0::DOUBLE AS funding,
        CAST(1000 + seq % 500 AS DOUBLE) AS open_interest, CAST(1000000 + (seq % 1000) * 1000 AS DOUBLE) AS day_volume FROM tape WHERE seq % 5 = 0)""",
    "wallets": """wallets AS (SELECT 'w' || CAST(c_custkey AS VARCHAR) AS address, c_acctbal AS account_value, coalesce(CAST(v AS DOUBLE), 0.0) AS vlm_week
        FROM customer LEFT JOIN (SELECT o_custkey, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS v FROM orders GROUP BY 1) ON c_custkey = o_custkey WHERE c_nationkey % 3 = 0)""",
    "marks": """marks AS (SELECT coin, mark, open_interest, day_volume, t_ingest FROM (SELECT *, row_number() OVER (PARTITION BY coin ORDER BY t_ingest DESC, seq DESC) AS rn FROM contexts) WHERE rn = 1)""",
    "positions": """positions AS (SELECT 'w' || CAST(o_custkey AS VARCHAR) AS address, coin, s / 10.0::DOUBLE AS szi, mark, CAST(5 + (o_custkey % 4) * 10 AS INT) AS max_leverage,
        CASE WHEN o_custkey % 3 = 0 THEN 'isolated' ELSE 'cross' END AS margin_type, c_acctbal AS account_value,
        CASE WHEN o_custkey % 4 = 0 THEN mark * (1 + ((o_custkey % 41) - 20) / 200.0::DOUBLE) END AS liquidation_px
        FROM (SELECT o_custkey, (['click','error','purchase','signup','view'])[o_orderkey % 5 + 1] AS coin, sum((o_orderkey % 2 * 2 - 1) * (o_orderkey % 97 + 1)) AS s FROM orders GROUP BY 1, 2)
        JOIN customer ON o_custkey = c_custkey JOIN (SELECT coin AS mcoin, mark FROM marks) ON coin = mcoin WHERE s <> 0)""",
    "liquidations": """liquidations AS (SELECT tid, t_event, t_ingest, coin, buyer AS liquidated_user, px AS mark_px, CASE WHEN seq % 350 = 7 THEN 'backstop' ELSE 'market' END AS method,
        px, sz, seller AS observer, CASE WHEN seq % 4 = 3 THEN 'self' ELSE 'counterparty' END AS source FROM tape WHERE seq % 50 = 7)""",
    "map_rows": f"""map_rows AS (SELECT coin, seq, t_ingest, mark, {_UP[0]} AS up1, {" + ".join(_UP[:2])} AS up2, {" + ".join(_UP[:3])} AS up3, {" + ".join(_UP)} AS up4,
        {_DOWN[0]} AS down1, {" + ".join(_DOWN[:2])} AS down2, {" + ".join(_DOWN[:3])} AS down3, {" + ".join(_DOWN)} AS down4,
        0.001::DOUBLE * (seq % 40 + 1) AS near_up, -0.001::DOUBLE * (seq % 30 + 1) AS near_down FROM contexts WHERE seq % 20 = 0)""",
    "manifest": """manifest AS (SELECT coin, CAST(floor(t_ingest / 3600000000000) AS BIGINT) AS hour, min(seq) AS first_seq, max(seq) AS last_seq, min(t_ingest) AS first_ingest, max(t_ingest) AS last_ingest, count(*) AS lines FROM tape GROUP BY 1, 2)""",
}
_NEEDS = {"prints": ["tape"], "contexts": ["tape"], "marks": ["contexts"], "positions": ["marks"], "liquidations": ["tape"], "map_rows": ["contexts"], "manifest": ["tape"]}


def with_views(*names: str, more: dict[str, tuple[list[str], str]] | None = None) -> str:
    """``WITH`` clause of the named views and all that they read; ``more`` adds definitions with what they read."""
    text = SQL | {k: v[1] for k, v in (more or {}).items()}
    needs = _NEEDS | {k: v[0] for k, v in (more or {}).items()}
    done: list[str] = []

    def add(name: str) -> None:
        for other in needs.get(name, []):
            add(other)
        if name not in done:
            done.append(name)

    for name in names:
        add(name)
    return "WITH " + ",\n".join(text[n] for n in done) + "\n"
