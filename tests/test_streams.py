import random
import uuid

import pytest

from tidemark.streaming import jobs, stateful

HOUR = 3_600_000_000_000
MINUTE = 60_000_000_000


def slow_gaps(rows, quiet):
    """(coin, event, t_from, t_to) and (coin, week, ns) by one walk over each coin's arrivals."""
    alerts, weeks, newest = [], {}, max(t for _, t in rows)
    for coin in {c for c, _ in rows}:
        times = sorted({t for c, t in rows if c == coin})
        for a, b in zip(times, times[1:]):
            if b - a > quiet:
                alerts += [(coin, "open", a, None), (coin, "recovery", a, b)]
                t = a
                while t < b:
                    w = (t - stateful.MONDAY) // stateful.WEEK
                    end = min(b, (w + 1) * stateful.WEEK + stateful.MONDAY)
                    weeks[coin, w] = weeks.get((coin, w), 0) + end - t
                    t = end
        if (times[-1] + quiet) // 1_000_000 + 1 <= newest // 1_000_000:
            alerts.append((coin, "open", times[-1], None))
    return sorted(alerts, key=str), weeks


@pytest.mark.parametrize("files", [2, 7])
def test_alerts_survive_restarts_and_are_sent_once(spark, tmp_path, files):
    rnd = random.Random(files)
    start = 1_704_067_200_000_000_000
    rows, t = [], start
    for _ in range(900):
        t += rnd.choice([1, 5, 30]) * MINUTE + rnd.randrange(1_000_000_000)
        rows.append((rnd.choices(["a", "b", "c"], [20, 3, 1])[0], t))
    rows += [rows[5]] * 3 + [("only once", start + 7)]
    rows += [("hot", start + k * MINUTE) for k in range(300)]  # then silent for good
    rows.sort(key=lambda r: r[1])
    at, quiet = str(tmp_path / uuid.uuid4().hex), 90 * MINUTE
    alerts, weeks = slow_gaps(rows, quiet)
    assert len(weeks) > 4 and len(alerts) > 40
    got, size = [], -(-len(rows) // files)
    for k in range(files):  # a run for each landed file: every one starts from the state that the last one left
        spark.createDataFrame(rows[k * size : (k + 1) * size], "coin string, t_ingest long").coalesce(1).write.mode("append").parquet(f"{at}/in")
        stream = spark.readStream.schema("coin string, t_ingest long").option("maxFilesPerTrigger", 1).parquet(f"{at}/in")
        got = [tuple(r) for r in jobs.run(stateful.gap_events(stream, quiet), at, own_state=True).collect()]
    told = [(c, e, a, b) for c, e, a, b, w, _ in got if e == "open" or w == (a - stateful.MONDAY) // stateful.WEEK]
    assert sorted(told, key=str) == alerts
    summed = {}
    for c, e, _, _, w, ns in got:
        if e == "recovery":
            summed[c, w] = summed.get((c, w), 0) + ns
    assert summed == weeks


def slow_crossings(rows, n, band):
    out = []
    for coin in {r[0] for r in rows}:
        bars = {}
        for _, t, seq, px in sorted(r for r in rows if r[0] == coin):
            bars[t // HOUR * HOUR] = px
        held, closes = None, []
        for t_open in sorted(bars)[:-1]:
            closes.append(bars[t_open])
            if len(closes) < n:
                continue
            mean = round(sum(closes[-n:]) / n, 9)
            side = 1 if closes[-1] > mean * (1 + band) else -1 if closes[-1] < mean * (1 - band) else held
            if held is not None and side != held:
                out.append((coin, t_open, closes[-1], side))
            held = side
    return sorted(out)


def test_crossings_survive_restarts(spark, tmp_path):
    rnd = random.Random(4)
    rows, px = [], {"a": 100.0, "b": 50.0}
    for k in range(2_000):
        coin = rnd.choice(["a", "a", "a", "b"])
        px[coin] *= 1 + rnd.uniform(-0.004, 0.004)
        rows.append((coin, k * 9 * MINUTE + rnd.randrange(MINUTE), k, px[coin]))
    expected = slow_crossings(rows, 6, 0.001)
    assert len(expected) > 15
    at = str(tmp_path / uuid.uuid4().hex)
    for k in range(4):
        spark.createDataFrame(rows[k * 500 : (k + 1) * 500], "coin string, t_event long, seq long, px double").coalesce(1).write.mode("append").parquet(f"{at}/in")
        stream = spark.readStream.schema("coin string, t_event long, seq long, px double").parquet(f"{at}/in")
        got = [tuple(r) for r in jobs.run(stateful.crossings(stream, n=6), at, own_state=True).collect()]
    assert sorted(got) == expected


def test_weeks_and_stretches():
    monday = stateful.MONDAY + 3 * stateful.WEEK
    assert stateful.by_week(monday - 5, monday + 7) == [(2, 5), (3, 7)]
    assert stateful._stretches([(5, 6), (0, 1), (2, 3), (6, 20), (31, 31)], 10) == [(0, 20), (31, 31)]


def test_no_shared_folder_off_local_mode(monkeypatch):
    from tidemark.session import shared_folder

    class Conf:
        def get(self, *_):
            return None

    class Context:
        master, getConf, getCheckpointDir = "spark://host:7077", lambda self: Conf(), lambda self: None

    session = type("Session", (), {"conf": Conf(), "sparkContext": Context()})()
    with pytest.raises(RuntimeError, match="shared|share"):
        shared_folder(session)
