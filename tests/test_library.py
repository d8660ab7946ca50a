import os
import random
import subprocess
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.001"
CHECKED = ("prints", "bars", "sigma", "ctx_features", "asof_context", "asof_strict", "event_feats", "gap_minutes", "sma_cross", "position_series", "wallets_upsert", "checkpoints", "liqmap_buckets", "band_null", "chain_verify", "gate_flips", "close_days", "file_audit", "ledger_verify", "liq_parse", "map_history", "tape_keys", "liqmap_bands")


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_its_sql(spark, name):
    from tidemark import catalog

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = catalog.queries()[name](spark, SF)
    cols = sorted(df.columns)
    rel = con.sql(catalog.oracle_sql()[name])
    at = [rel.columns.index(c) for c in cols]
    assert sorted(rel.columns) == cols
    expected = sorted(repr(tuple(r[i] for i in at)) for r in rel.fetchall())
    assert sorted(repr(tuple(r)) for r in df.select(*cols).collect()) == expected


def test_asof_chunks_do_not_change_the_result(spark):
    from tidemark.operators.ordered import asof

    rnd = random.Random(1)
    left = [(i, rnd.choice("ab"), rnd.randrange(0, 500)) for i in range(200)]
    right = [(rnd.choice("abc"), rnd.randrange(0, 500), i, None if i % 9 == 0 else i * 1.0) for i in range(60)]
    l = spark.createDataFrame(left, "id int, k string, t long")
    r = spark.createDataFrame(right, "k string, rt long, n int, v double")
    for strict in (False, True):
        expected = {}
        for i, k, t in left:
            own = [x for x in right if x[0] == k and (x[1] < t if strict else x[1] <= t)]
            best = max(own, key=lambda x: (x[1], x[2]), default=None)
            expected[i] = (best[2], best[3]) if best else (None, None)
        for chunk in (1, 7, 100, 10_000):
            got = asof(l, r, ["k"], "t", "rt", ["n", "v"], tie=["n"], strict=strict, chunk=chunk).collect()
            assert {x.id: (x.n, x.v) for x in got} == expected and len(got) == len(left)


def test_running_sum_and_previous_by_chunks(spark):
    from tidemark.operators.ordered import previous, running_sum
    from pyspark.sql import functions as F

    rnd = random.Random(2)
    rows = [(rnd.choice("ab"), rnd.randrange(0, 100), i, rnd.randrange(-5, 6)) for i in range(150)]
    df = spark.createDataFrame(rows, "k string, t long, n int, v long")
    total, before, expected = {}, {}, {}
    for k, t, n, v in sorted(rows, key=lambda x: (x[0], x[1], x[2])):
        expected[n] = (total.get(k, 0) + v, before.get(k))
        total[k], before[k] = total.get(k, 0) + v, v
    for chunk in (1, 13, 1000):
        s = {x.n: x.s for x in running_sum(df, ["k"], "t", ["n"], F.col("v"), "s", chunk).collect()}
        p = {x.n: x.prev_v for x in previous(df, ["k"], "t", ["n"], ["v"], chunk).collect()}
        assert {n: (s[n], p[n]) for n in s} == expected


def test_first_touch_equals_the_naive_walk(spark):
    from tidemark.operators.labels import first_touch

    rnd = random.Random(3)
    ticks, px, t = [], 100.0, 0
    for i in range(600):
        t += rnd.choice([1, 1, 3, 40])
        px += rnd.uniform(-0.5, 0.5)
        ticks.append(("c", t, i, round(px, 3)))
    decisions = [(i, "c", rnd.randrange(0, t + 50), 0.0, 0.0) for i in range(150)]
    decisions = [(i, c, t0, round((p := next((x[3] for x in reversed(ticks) if x[1] <= t0), 100.0)) + rnd.choice([0.3, 1, 3]), 3), round(p - rnd.choice([0.3, 1, 3]), 3)) for i, c, t0, _, _ in decisions]
    got = first_touch(spark.createDataFrame(decisions, "key int, coin string, t0 long, upper double, lower double"), spark.createDataFrame(ticks, "coin string, t_event long, seq int, px double"), 100, 7)
    rows = {r.key: (r.outcome, r.t_end, r.price_end) for r in got.collect()}
    for i, _, t0, up, lo in decisions:
        inside = [x for x in ticks if t0 < x[1] <= t0 + 100]
        hit = next((x for x in inside if x[3] >= up or x[3] <= lo), None)
        expected = (1 if hit[3] >= up else -1, hit[1], hit[3]) if hit else (0, t0 + 100, inside[-1][3]) if inside else (None, None, None)
        assert rows[i] == expected


def test_uniqueness_equals_its_definition(spark):
    from tidemark.operators.labels import uniqueness

    rnd = random.Random(4)
    spans = [(i, "c", a := rnd.randrange(0, 60), a + rnd.choice([0, 1, 5, 20])) for i in range(40)]
    got = {r.key: r.weight for r in uniqueness(spark.createDataFrame(spans, "key int, coin string, t0 long, t_end long")).collect()}
    for i, _, a, b in spans:
        parts = [1 / sum(x <= u < y for _, _, x, y in spans) for u in range(a, b)]
        assert got[i] == pytest.approx(sum(parts) / len(parts) if parts else 1.0)


def test_every_query_but_few_has_sql():
    from tidemark import catalog

    missing = set(catalog.queries()) - set(catalog.oracle_sql())
    assert missing == {"gbt_expert"}
    assert set(catalog.oracle_sql()) <= set(catalog.queries())


def test_entry_module_works_without_the_optional_parts(tmp_path):
    import shutil

    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copy(os.path.join(top, "__spark_entry__.py"), tmp_path)
    shutil.copytree(os.path.join(top, "tidemark"), tmp_path / "tidemark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); o = e.oracle_sql(); assert len(q) > 90 and not any(n.startswith('op') and n[2].isdigit() for n in q) and 'pipeline' not in q; print(len(q), len(o))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
    assert done.returncode == 0, done.stderr


def test_rolling_in_blocks_is_rolling_over_all_rows(spark):
    from tidemark.operators.ordered import rolling

    rows = [(c, t, float((7 * t + len(c)) % 11)) for c in ("a", "hot") for t in range(40 if c == "a" else 200)]
    df = spark.createDataFrame(rows, "coin string, t long, x double")
    found = {}
    for size in (7, 10_000):
        found[size] = sorted(tuple(r) for r in rolling(df, ["coin"], "t", [], 5, lambda w: {"s": F.sum("x").over(w), "n": F.count("x").over(w)}, size).collect())
    assert found[7] == found[10_000] and len(found[7]) == len(rows)
    by = {(c, t): x for c, t, x in rows}
    for c, t, _, s, n in found[7]:
        last = [by[c, k] for k in range(max(0, t - 4), t + 1)]
        assert (s, n) == (sum(last), len(last))


def test_attack_ratio_by_hand(spark):
    from math import sqrt

    from tidemark.plans.integrity import attack_of

    held = [("w1", "c", 101.0, 100.0, 10.0, "isolated"), ("w2", "c", 110.0, 100.0, 40.0, "cross"), ("w3", "c", 110.0, 100.0, 1.0, "isolated"), ("w4", "c", 95.0, 100.0, -3.0, "isolated"), ("w5", "c", 100.0, 100.0, 5.0, "isolated"), ("w6", "d", 101.0, 100.0, 1.0, "isolated"), ("w7", "c", None, 100.0, 9.0, "isolated")]
    p = spark.createDataFrame(held, "address string, coin string, price double, mark double, szi double, margin_type string")
    stats = spark.createDataFrame([("c", 0.05, 1000.0), ("d", None, 1000.0)], "coin string, daily_sigma double, day_volume double")
    got = {(r.coin, r.side): r for r in attack_of(p, stats).collect()}
    psi = lambda mass, x: 0.05 * sqrt(mass / 1000) / (0.5 * x + 0.001)
    up = got["c", "up"]
    assert up.psi == round(psi(1000, 0.01), 9) and up.distance == 0.01 and up.positions == 1 and up.mass == 1000 and up.jackknife == 0
    assert got["c", "down"].psi == round(psi(300, 0.05), 9) and got["c", "down"].distance == -0.05
    assert got["d", "up"].psi is None and got["d", "up"].jackknife is None
    wide = attack_of(p, stats, cost=1.0).where("coin = 'c' and side = 'up'").first()  # with a high cost the far cluster wins
    low = lambda mass, x: 0.05 * sqrt(mass / 1000) / (0.5 * x + 1.0)
    assert wide.psi == round(low(3100, 0.1), 9) and wide.positions == 3 and wide.jackknife == round(low(1100, 0.1), 9)


def test_clusters_are_scored_in_the_tightest_band(spark):
    from tidemark.plans.liquidity import score_clusters

    minute = 60_000_000_000
    maps = (100.0, 0.0, 5.0, 9.0, 9.0, 7.0, 7.0, 7.0, 7.0)
    rows = [  # event time, map time, distance
        ("c", 100 * minute, 99 * minute, 0.004, 1, *maps),  # up1 0 against down1 7: no hit
        ("c", 100 * minute, 99 * minute, -0.004, 1, *maps),  # down1 7 against up1 0: both hits
        ("c", 100 * minute, 99 * minute, 0.015, 1, *maps),  # up3 9 against 7: both hits
        ("c", 100 * minute, 99 * minute, 0.2, 1, *maps),
        ("c", 100 * minute, 90 * minute, 0.004, 1, *maps),
        ("c", 100 * minute, None, None, 1, *[None] * 9),
        ("n", 100 * minute, None, None, None, *[None] * 9),
    ]
    sides = ", ".join(f"{s}{i} double" for s in ("up", "down") for i in range(1, 5))
    df = spark.createDataFrame(rows, f"coin string, t_event long, map_t long, dist double, first_t long, mark double, {sides}")
    got = {r.coin: r for r in score_clusters(df).collect()}
    c = got["c"]
    assert (c.events, c.scored, c.side_hits, c.band_hits, c.outside_span, c.stale_map, c.pre_map, c.median_distance) == (6, 3, 2, 2, 1, 1, 1, 0.004)
    assert got["n"].no_map == 1 and got["n"].scored == 0 and got["n"].z is None


def test_opinions_declare_what_they_read_and_meet_their_baseline(spark):
    from tidemark.plans import experts

    with pytest.raises(LookupError, match="'nothing' is no column.*'nobody'"):
        experts.register(experts.Opinion("odd", ("nothing",), lambda: F.lit(0.5), beats="nobody"))
    assert "odd" not in experts.KNOWN and experts.bars_back(experts.KNOWN["kernel"]) == 1 and experts.bars_back(experts.KNOWN["trees"]) == 149
    rows = [("c", f, 10 * f + i, i % 2, 1.0, part, *[float(10 + i)] * 8) for f in (1, 2) for part, k in (("train", 30 if f == 1 else 3), ("test", 4)) for i in range(k)]
    sides = ", ".join(f"{s}{i} double" for s in ("up", "down") for i in range(1, 5))
    folds = spark.createDataFrame(rows, f"coin string, fold int, t_open long, y int, weight double, part string, {sides}")
    got = {r.expert: r for r in experts.evaluate(folds, ["rate", "kernel"]).collect()}
    assert (got["rate"].n, got["rate"].unfit, got["rate"].baseline) == (8, 4, "even")  # three rows are too few to fit on
    assert got["rate"].log_loss == got["rate"].base_loss == pytest.approx(0.693147)
    assert got["kernel"].unfit == 0 and got["kernel"].log_loss == pytest.approx(0.693147)
    own = {"even": experts.KNOWN["even"]}
    experts.register(experts.Opinion("oracle", (), lambda: F.col("y") * 0.8 + 0.1, beats="even"), own)
    told = experts.evaluate(folds, ["oracle"], own).first()
    assert told.log_loss == pytest.approx(0.105361) and told.base_loss == pytest.approx(0.693147) and "oracle" not in experts.KNOWN


def test_entry_lives_without_what_the_llm_operators_import(tmp_path):
    code = "import sys; sys.modules['xxhash'] = None; import __spark_entry__ as e; q = e.queries(); assert 'frame' in q and 'op9_simhash' not in q and 'pipeline' not in q"
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-W", "ignore", "-c", code], cwd=tmp_path, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": top})
    assert done.returncode == 0, done.stderr


def test_chains_go_on_from_their_heads_and_name_the_first_break(spark):
    from hashlib import sha256

    from tidemark.plans.landed import GENESIS, append_chain, verify_chain

    rows = [("a", i, f"body {i}") for i in range(6)] + [("b", 0, "x")]
    batch = spark.createDataFrame(rows, "chain string, at int, body string")
    first = append_chain(None, batch.where("at < 4"))
    heads = first.where("seq = 3").select("chain", "seq", "hash")
    both = sorted(first.unionByName(append_chain(heads, batch.where("at >= 4"))).collect(), key=lambda r: (r.chain, r.seq))
    before = GENESIS
    for r in both[:6]:
        assert r.prev_hash == before and r.hash == sha256(f"{r.seq}|{before}|body {r.seq}".encode()).hexdigest()
        before = r.hash
    assert both == sorted(append_chain(None, batch).collect(), key=lambda r: (r.chain, r.seq))
    df = spark.createDataFrame(both)
    assert [r.reason for r in verify_chain(df).collect()] == [None, None]
    lost = {r.chain: (r.first_break, r.reason) for r in verify_chain(df.where("seq <> 2")).collect()}
    assert lost == {"a": (3, "sequence"), "b": (None, None)}


def test_a_day_is_closed_once_and_damage_is_found(spark, tmp_path):
    from tidemark.operators.ordered import DAY
    from tidemark.plans import landed

    at, manifest = str(tmp_path / "tape"), str(tmp_path / "manifest")
    tape = spark.createDataFrame([(i, "c", i, (10 + i % 3) * DAY + i, i % 7) for i in range(30)], "seq long, coin string, t_event long, t_ingest long, k int")
    landed.land(landed.lines_of(tape), at)
    for today, n in ((11, 1), (11, 1), (12, 2)):
        landed.close_finished(spark, at, manifest, today)
        known = spark.read.schema(landed.MANIFEST).parquet(manifest)
        assert known.count() == n and known.agg(F.sum("lines")).first()[0] == 10 * n
    files = landed.files_of(spark, at)
    assert {(r.day, r.state) for r in landed.audit(known, files, 12).collect()} == {(10, "ok"), (11, "ok"), (12, "open")}
    bad = files.where("day <> 10").withColumn("sha256", F.when(F.col("day") == 11, "0").otherwise(F.col("sha256")))
    assert {(r.day, r.state) for r in landed.audit(known, bad, 13).collect()} == {(10, "missing"), (11, "modified"), (12, "stale")}


def test_clock_and_cost_expressions(spark):
    from tidemark.functions import expressions as X

    stretches = {"90s": 90_000_000_000, " 1.5H ": 5_400_000_000_000, "1h30m": 5_400_000_000_000, "2d 0.5s": 172_800_500_000_000}
    assert {t: X.stretch_ns(t) for t in stretches} == stretches
    for bad in ("", "5", "m", "5y", "h5", "1h-5m"):
        with pytest.raises(ValueError):
            X.stretch_ns(bad)
        stretches[bad] = None
    texts = spark.createDataFrame([(t,) for t in stretches], "t string")
    assert {r.t: r.ns for r in texts.select("t", X.stretch_ns_of(F.col("t")).alias("ns")).collect()} == stretches
    iso = spark.createDataFrame([("2024-07-31T14:00:00",), ("2024-07-31T14:00:00Z",), ("2024-07-31T16:00:00+02:00",), ("2024-07-31 08:30:00.5-0530",), ("yesterday",), (None,)], "t string")
    assert [r[0] for r in iso.select(X.iso_ns(F.col("t"))).collect()] == [1722434400000000000] * 3 + [1722434400500000000, None, None]
    ns = spark.createDataFrame([(1704067199999999999,), (1704067200000000000,), (-1,)], "t long")
    got = [tuple(r) for r in ns.select(X.hour_key(F.col("t")), X.day_key(F.col("t")), X.week_key(F.col("t"))).collect()]
    assert got == [("20231231T23", "2023-12-31", "2023-W52"), ("20240101T00", "2024-01-01", "2024-W01"), ("19691231T23", "1969-12-31", "1970-W01")]
    clock = spark.sql("select timestamp_ntz '2024-01-31 14:00:00' as w, timestamp_ntz '2024-07-31 14:00:00' as s")
    assert tuple(clock.select(X.wall_ns(F.col("w")), X.wall_ns(F.col("s"))).first()) == (1706727600000000000, 1722448800000000000)
    move = spark.createDataFrame([(100.0,), (1.0,), (0.0,), (None,)], "m double")
    assert [r[0] for r in move.select(X.worth_betting(F.col("m"), X.COSTS["maker"])).collect()] == [0.56, 0.99, 1.0, 1.0]
    hourly = (X.Term("funding", 0.5, 1, True), X.Term("fee", 2.0, 2, False))
    assert tuple(move.select(X.cost_bps(X.COSTS["maker"]), X.cost_bps(X.COSTS["taker"], 8.0), X.cost_bps(hourly, F.lit(8.0))).first()) == (6.0, 12.0, 8.0)
    assert X.cost_id(hourly) == X.cost_id(hourly[::-1]) != X.cost_id(hourly[:1]) and X.cost_id(X.COSTS["maker"]) != X.cost_id(X.COSTS["taker"])
    odd = spark.createDataFrame([("<p>a <b>b</b>\n</p>", 1.0, 0.0), (None, None, 2.0)], "h string, x double, y double")
    assert [tuple(r) for r in odd.select(X.without_markup(F.col("h")), X.over(F.col("x"), F.col("y"))).collect()] == [("a b", None), (None, None)]
