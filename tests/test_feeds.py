from pyspark.sql import functions as F

from tidemark.plans import feeds


def test_feeds_are_parsed_by_name_and_one_is_added_from_outside(spark):
    rows = [
        ("trades", 5, '{"tid": 7, "time": 1704067200123}'), ("trades", 6, "{"), ("trades", 6, None), ("posts", 7, '{"guid": "g", "title": "Rates UP", "published": "2024-01-01T02:00:00+02:00"}'),
        ("posts", 8, '{"guid": "h", "published": "soon"}'), ("releases", 9, '{"id": "r", "date": "2024-01-01", "utc": "00:00:00"}'), ("tides", 10, '{"n": 3, "s": 12}'), (None, 11, "{}"),
    ]
    df = spark.createDataFrame(rows, "stream string, t_ingest long, payload string")
    day = 1_704_067_200_000_000_000
    expected = [
        ("trades", 5, "7", "trade", day + 123_000_000), ("trades", 6, None, "trade", None), ("trades", 6, None, "trade", None), ("posts", 7, "g", "rates up", day), ("posts", 8, "h", None, None),
        ("releases", 9, "r", "release", day), ("tides", 10, None, None, None), (None, 11, None, None, None),
    ]
    assert sorted(map(tuple, feeds.parsed(df).collect()), key=str) == sorted(expected, key=str)
    assert {tuple(r) for r in feeds.unknown(df).collect()} == {("tides", 1), (None, 1)}
    own = feeds.standard() | {"tides": feeds.Feed("tides", F.get_json_object("payload", "$.n"), F.lit("tide"), F.get_json_object("payload", "$.s").cast("long") * 1_000_000_000)}
    assert ("tides", 10, "3", "tide", 12_000_000_000) in {tuple(r) for r in feeds.parsed(df, own).collect()}
    assert feeds.parsed(df).schema.simpleString() == "struct<stream:string,t_ingest:bigint,event_id:string,class:string,t_event:bigint>"
    assert feeds.parsed(df.limit(0)).count() == 0
