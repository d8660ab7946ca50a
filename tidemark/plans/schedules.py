"""Schedules read from raw pages: tables of releases and lists of posts, as events with an id, a class, an instant and a payload.

A page is a row ``(source, body)``. Parsers are column expressions over all pages;
a row or post that has no readable time gives no event, and null or empty pages give none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import expressions as X
from tidemark.sources import views as V

MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
POSTS = "array<struct<id: string, created_at: string, content: string, reblog: string>>"


def clock_of(date: Column, time: Column) -> Column:
    """The wall clock of texts such as ``Jan. 5, 2024`` and ``08:30 AM``; null where there is none."""
    part = lambda k: F.regexp_extract(date, r"^([A-Za-z]{3})[a-z]*\.? (\d{1,2}), (\d{4})", k)
    hand = lambda k: F.regexp_extract(time, r"^(\d{1,2}):(\d\d) ([AP])M", k)
    month = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(part(1)))
    hour = hand(1).try_cast("int") % 12 + F.when(hand(3) == "P", 12).otherwise(0)
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    return F.concat(part(3), F.lit("-"), two(month), F.lit("-"), two(part(2)), F.lit(" "), two(hour), F.lit(":"), hand(2), F.lit(":00")).try_cast("timestamp_ntz")


def releases(pages: DataFrame, zone: str = "America/New_York") -> DataFrame:
    """Events of tables whose rows begin with (what it is about, date, time in ``zone``); a row with a link has been released, too."""
    rows = pages.select("source", F.explode(F.regexp_extract_all("body", F.lit(r"(?s)<tr[^>]*>(.*?)</tr>"), F.lit(1))).alias("row"))
    cells = rows.withColumn("c", F.transform(F.regexp_extract_all("row", F.lit(r"(?s)<td[^>]*>(.*?)</td>"), F.lit(1)), X.without_markup))
    timed = cells.where(F.size("c") >= 3).withColumn("at", clock_of(F.get("c", 1), F.get("c", 2))).where("at is not null")
    name = F.concat("source", F.lit(":"), F.date_format("at", "yyyy-MM-dd"))
    planned = F.struct(name.alias("event_id"), F.to_json(F.struct(F.get("c", 0).alias("about"), F.concat(F.get("c", 1), F.lit(" "), F.get("c", 2)).alias("when"))).alias("payload"))
    link = F.regexp_extract("row", r'href="([^"]+)"', 1)
    out = F.struct(F.concat(name, F.lit(":released")).alias("event_id"), F.to_json(F.struct(F.lit("released").alias("status"), link.alias("link"))).alias("payload"))
    events = timed.select("source", X.wall_ns(F.col("at"), zone).alias("source_ts"), F.explode(F.when(link == "", F.array(planned)).otherwise(F.array(planned, out))).alias("e"))
    return events.select("e.event_id", F.lit("scheduled").alias("class"), "source", "source_ts", "e.payload")


def posts(pages: DataFrame) -> DataFrame:
    """Events of lists of posts in JSON, without their markup."""
    p = pages.select("source", F.explode(F.from_json("body", POSTS)).alias("p")).select("source", "p.*", X.iso_ns(F.col("p.created_at")).alias("source_ts"))
    payload = F.to_json(F.struct(X.without_markup(F.coalesce("content", F.lit(""))).alias("text"), F.col("reblog").isNotNull().alias("reblog")))
    return p.where("id is not null and source_ts is not null").select(F.concat("source", F.lit(":"), "id").alias("event_id"), F.lit("unscheduled").alias("class"), "source", "source_ts", payload.alias("payload"))


#: Parsers by kind of page; others may be added.
PARSERS = {"releases": releases, "posts": posts}


def pages_of(spark: SparkSession, d: str) -> DataFrame:
    """``(kind, source, body)``: order days as tables of releases, a page a month (some rows lack a date or a cell), and as posts, a page a month."""
    day = F.to_date("o_orderdate")
    o = V.table(spark, d, "orders").groupBy(day.alias("day")).agg(F.count("*").alias("n")).withColumn("dom", F.dayofmonth("day"))
    hour = F.make_dt_interval(hours=F.lit(6) + F.col("dom") % 12, mins=F.lit(30))
    about = F.when(F.col("dom") % 2 == 0, F.format_string('<a href="/out/%s">%d orders</a>', F.date_format("day", "yyyyMMdd"), "n")).otherwise(F.format_string("%d <i>orders</i>", "n"))
    date = F.when(F.col("dom") % 10 == 3, F.lit("to be announced")).otherwise(F.date_format("day", "MMM. d, yyyy"))
    time = F.when(F.col("dom") % 10 == 7, F.lit("")).otherwise(F.concat(F.lit("<td class='t'>"), F.date_format(F.col("day").cast("timestamp_ntz") + hour, "hh:mm a"), F.lit("</td>")))
    row = F.concat(F.lit("<tr>\n<td>"), about, F.lit("</td><td> "), date, F.lit("</td>"), time, F.lit("</tr>"))
    post = F.struct(F.date_format("day", "yyyyMMdd").alias("id"), F.concat(F.date_format("day", "yyyy-MM-dd"), F.lit("T10:00:00.5Z")).alias("created_at"), F.format_string("<p>%d  <b>orders</b></p>", "n").alias("content"))
    m = o.groupBy(F.trunc("day", "month").alias("month")).agg(F.collect_list(row).alias("rows"), F.collect_list(post).alias("posts"))  # at most 31 days
    table = F.concat(F.lit("<table><tr><th>About</th><th>Date</th><th>Time</th></tr>"), F.array_join("rows", "\n"), F.lit("</table>"))
    kinds = F.array(F.struct(F.lit("releases").alias("kind"), F.lit("orders").alias("source"), table.alias("body")), F.struct(F.lit("posts").alias("kind"), F.lit("desk").alias("source"), F.to_json("posts").alias("body")))
    return m.select(F.explode(kinds).alias("p")).select("p.*")


def schedules(spark: SparkSession, d: str) -> DataFrame:
    """Every event that the pages tell, each kind of page by its parser."""
    pages = pages_of(spark, d)
    found = [parse(pages.where(F.col("kind") == kind)) for kind, parse in PARSERS.items()]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


QUERIES = {"schedules": schedules}
SQL = {
    "schedules": """WITH o AS (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n, dayofmonth(CAST(o_orderdate AS DATE)) AS dom FROM orders GROUP BY 1, 3),
    t AS (SELECT *, CAST(day AS TIMESTAMP) + to_hours(6 + dom % 12) + INTERVAL 30 MINUTE AS clock FROM o WHERE dom % 10 NOT IN (3, 7)),
    r AS (SELECT *, 'orders:' || strftime(day, '%Y-%m-%d') AS event_id, epoch_us(timezone('America/New_York', clock)) * 1000 AS source_ts FROM t)
    SELECT event_id, 'scheduled' AS class, 'orders' AS source, source_ts, '{"about":"' || n || ' orders","when":"' || strftime(clock, '%b. %-d, %Y %I:%M %p') || '"}' AS payload FROM r
    UNION ALL SELECT event_id || ':released', 'scheduled', 'orders', source_ts, '{"status":"released","link":"/out/' || strftime(day, '%Y%m%d') || '"}' FROM r WHERE dom % 2 = 0
    UNION ALL SELECT 'desk:' || strftime(day, '%Y%m%d'), 'unscheduled', 'desk', epoch_us(CAST(day AS TIMESTAMP) + INTERVAL 10 HOUR) * 1000 + 500000000, '{"text":"' || n || ' orders","reblog":false}' FROM o"""
}
