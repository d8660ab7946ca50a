import pytest

from tidemark.operators.ordered import DAY, HOUR
from tidemark.plans import gates, liquidity

MAP = {"coin": "c", "age_ns": HOUR, "coverage": 0.3, "priced": 10, "exact": 0.5, "numbers": gates.MapNumbers().registered(), "scored": 1000, "side_hits": 700, "z": 9.0, "informative": True, "null_z": 4.0, "mapped_share": 0.7}
KIND = "coin string, age_ns long, coverage double, priced long, exact double, numbers string, scored long, side_hits long, z double, informative boolean, null_z double, mapped_share double"


@pytest.mark.parametrize(
    ("change", "verdict", "reason", "failed"),
    [
        ({}, "pass", None, ""),
        ({"mapped_share": 0.59}, "pass", None, "positions"),  # one of the two bars is enough
        ({"side_hits": 599}, "pass", None, "clusters"),
        ({"informative": False}, "pass", None, "clusters"),
        ({"null_z": 2.9, "mapped_share": None}, "fail", None, "positions,clusters"),
        ({"z": 2.0, "mapped_share": 0.1}, "fail", None, "positions,clusters"),
        ({"age_ns": 7 * HOUR}, "fail", None, "positions_fresh"),
        ({"age_ns": None}, "fail", None, "positions_fresh"),
        ({"coverage": 0.2}, "fail", None, "coverage"),
        ({"exact": 0.1}, "fail", None, "fidelity"),
        ({"priced": None, "exact": None}, "fail", None, "fidelity"),
        ({"numbers": None}, "refused", "preregistration_missing", "registered"),
        ({"numbers": gates.MapNumbers(side=0.55).registered(), "scored": 3}, "refused", "preregistration_missing", "registered,window"),
        ({"scored": 999}, "refused", "insufficient_forward_events", "window"),
        ({"scored": None, "side_hits": None, "z": None, "coverage": None}, "refused", "insufficient_forward_events", "coverage,window,clusters"),
    ],
)
def test_map_gate(spark, change, verdict, reason, failed):
    row = tuple((MAP | change).values())
    r = gates.map_gate(spark.createDataFrame([row], KIND)).first()
    assert (r.verdict, r.reason, r.failed) == (verdict, reason, failed)
    assert r.progress == f"{(MAP | change)['scored'] or 0}/1000"


MAGNET = {"numbers": gates.MagnetNumbers().registered(), "map_verdict": "pass", "map_age_ns": HOUR, "events": 2000, "days": 30, "cells_passed": True}
MAGNET_KIND = "numbers string, map_verdict string, map_age_ns long, events long, days long, cells_passed boolean"


@pytest.mark.parametrize(
    ("change", "verdict", "reason"),
    [
        ({}, "pass", None),
        ({"cells_passed": False}, "fail", None),
        ({"cells_passed": None}, "fail", None),
        ({"numbers": None, "map_verdict": "fail"}, "refused", "preregistration_missing"),
        ({"numbers": gates.MagnetNumbers(days=29).registered()}, "refused", "preregistration_missing"),
        ({"map_verdict": "refused", "events": 1}, "refused", "upstream_map"),
        ({"map_verdict": None}, "refused", "upstream_map"),
        ({"map_age_ns": 2 * DAY}, "refused", "upstream_map"),
        ({"events": 1999, "cells_passed": False}, "refused", "insufficient_forward_events"),
        ({"days": 29}, "refused", "insufficient_forward_events"),
        ({"events": None, "days": None}, "refused", "insufficient_forward_events"),
    ],
)
def test_magnet_gate(spark, change, verdict, reason):
    r = gates.magnet_gate(spark.createDataFrame([tuple((MAGNET | change).values())], MAGNET_KIND)).first()
    assert (r.verdict, r.reason) == (verdict, reason)


def test_gates_without_subjects(spark):
    assert gates.map_gate(spark.createDataFrame([], KIND)).count() == 0
    assert gates.magnet_gate(spark.createDataFrame([], MAGNET_KIND)).count() == 0


def test_the_permutation_null_makes_no_row_a_snapshot_and_replication(spark):
    import hashlib
    from statistics import pstdev

    reps, sides = 40, liquidity._SIDES
    snaps = [("a" if i % 3 else "b", i, [float((i >> j) % 2 * (i % 7 > 0)) for j in range(8)]) for i in range(1, 60)]
    dists = (0.001, 0.007, 0.015, 0.03, -0.001, -0.007, -0.015, -0.03)  # one a slot
    hits = [(coin, seq, masses, dists[(seq * 5 + e) % 8], (seq * 5 + e) % 8) for coin, seq, masses in snaps for e in range(1 + seq % 3)]
    hits.append(("c", 99, [1.0] * 8, 0.001, 0))  # every order is the same
    found = spark.createDataFrame([(c, q, 10, 5, 1, x, *m) for c, q, m, x, _ in hits], f"coin string, map_seq long, t_event long, map_t long, first_t long, dist double, {', '.join(f'{s} double' for s in sides)}")
    want = {}
    for coin in "abc":
        mine, own = [h for h in hits if h[0] == coin], []
        for rep in range(reps):
            order = {q: sorted(range(8), key=lambda i: hashlib.md5(f"7-{rep}-{q}-{i}".encode()).hexdigest()) for q in {h[1] for h in mine}}
            own.append(sum(m[order[q][slot]] > 0 for _, q, m, _, slot in mine))
        want[coin] = (sum(m[slot] > 0 for _, _, m, _, slot in mine), round(sum(own) / reps, 6), round(pstdev(own), 6))
    null = liquidity.null_of(found, reps)
    got = {r.coin: r for r in null.collect()}
    assert {c: (r.observed, r.informative) for c, r in got.items()} == {c: (w[0], w[2] > 0) for c, w in want.items()} and not got["c"].informative
    assert all((got[c].null_mean, got[c].null_sd) == pytest.approx(w[1:], abs=2e-6) for c, w in want.items())
    assert "Window" not in null._jdf.queryExecution().optimizedPlan().toString()  # nothing is ordered across rows
