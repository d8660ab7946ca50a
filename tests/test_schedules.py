from datetime import datetime
from zoneinfo import ZoneInfo

from tidemark.plans import schedules as op


def ns(*at, zone="America/New_York"):
    return int(datetime(*at, tzinfo=ZoneInfo(zone)).timestamp()) * 10**9


def test_tables_of_releases_with_odd_rows(spark):
    rows = [
        ("<b>Dec</b> 2023", "January 5, 2024", "12:05 AM"), ("x &lt;", "Jul. 31, 2024", "12:30 PM"), ('<a href="/r/1">May</a>', "May 9, 2024", "9:00 PM ET"),
        ("no month", "Foo 1, 2024", "08:30 AM"), ("no day", "Feb. 30, 2024", "08:30 AM"), ("no time", "Feb. 3, 2024", "noon"), ("no hour", "Feb. 3, 2024", "8:75 AM"),
    ]
    html = "<table><tr><th>a</th></tr>" + "".join(f"<tr class='r'><td>{a}</td>\n<td>{b}</td><td> {c} </td><td>more</td></tr>" for a, b, c in rows) + "<tr><td>two</td><td>Feb. 3, 2024</td></tr></table>"
    pages = spark.createDataFrame([("s", html), ("s", None), ("s", ""), (None, html)], "source string, body string")
    got = {r.event_id: r for r in op.releases(pages).where("source is not null").collect()}
    assert {k: r.source_ts for k, r in got.items()} == {"s:2024-01-05": ns(2024, 1, 5, 0, 5), "s:2024-07-31": ns(2024, 7, 31, 12, 30), "s:2024-05-09": ns(2024, 5, 9, 21, 0), "s:2024-05-09:released": ns(2024, 5, 9, 21, 0)}
    assert got["s:2024-01-05"].payload == '{"about":"Dec 2023","when":"January 5, 2024 12:05 AM"}'
    assert got["s:2024-05-09:released"].payload == '{"status":"released","link":"/r/1"}'
    assert {r.source_ts for r in op.releases(pages, "UTC").where("event_id = 's:2024-07-31'").collect()} == {ns(2024, 7, 31, 12, 30, zone="UTC")}


def test_posts_with_odd_ones(spark):
    body = '[{"id":"1","created_at":"2024-01-05T10:00:00.250Z","content":"<p>a <br/> b</p>","reblog":{"id":2}},{"id":"2","created_at":"soon"},{"created_at":"2024-01-05T10:00:00Z"},{"id":"3","created_at":"2024-01-05T12:00:00+02:00"}]'
    pages = spark.createDataFrame([("s", body), ("s", "no json"), ("s", None), ("s", "[]")], "source string, body string")
    t = ns(2024, 1, 5, 10, 0, zone="UTC")
    assert sorted((r.event_id, r.source_ts, r.payload) for r in op.posts(pages).collect()) == [("s:1", t + 250_000_000, '{"text":"a b","reblog":true}'), ("s:3", t, '{"text":"","reblog":false}')]
