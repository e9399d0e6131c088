"""Search trees and their constraints on small networks."""

import random
from itertools import groupby

import pytest

from isoreach.graph.search import Constraints, Limit, OnDemand, Timetable, reach, with_costs

EDGES = "src long, dst long, edge_list_id int, edge_id long, mode string, cost double, distance double"
LINE = [(1, 2, 0, 1, "walk", 5.0, 400.0), (2, 3, 0, 2, "walk", 5.0, 400.0), (2, 3, 1, 3, "bus", 1.0, 400.0), (3, 4, 1, 4, "bus", 2.0, 900.0), (4, 5, 0, 5, "walk", 3.0, 200.0), (1, 5, 2, 6, "bike", 30.0, 3000.0)]


@pytest.fixture(scope="module")
def line(spark):
    return spark.createDataFrame(LINE, EDGES), spark.createDataFrame([(1,)], "origin long")


def costs(tree):
    return {(r["vertex_id"], r["mode_seq"]): r["cost"] for r in tree.collect() if r["edge_id"] is not None}


def best(tree):
    out = {}
    for (v, _), c in costs(tree).items():
        out[v] = min(c, out.get(v, c))
    return out


def test_shortest(line):
    edges, origins = line
    assert best(reach(origins, edges, Constraints())) == {2: 5.0, 3: 6.0, 4: 8.0, 5: 11.0}
    assert best(reach(origins, edges, Constraints(cost=100.0))) == {2: 5.0, 3: 6.0, 4: 8.0, 5: 11.0}


def test_cost_limit_is_on_the_tail(line):
    edges, origins = line
    limits = Constraints(cost=6.0, modes=frozenset({"walk", "bus"}))
    assert best(reach(origins, edges, limits)) == {2: 5.0, 3: 6.0, 4: 8.0}


def test_legs_counts_and_sequences(line):
    edges, origins = line
    assert best(reach(origins, edges, Constraints(max_legs=2), by_mode=True)) == {2: 5.0, 3: 6.0, 4: 8.0, 5: 30.0}
    assert best(reach(origins, edges, Constraints(mode_counts={"walk": 1, "bike": 1}), by_mode=True)) == {2: 5.0, 3: 10.0, 5: 30.0}
    tree = costs(reach(origins, edges, Constraints(sequences=(("walk", "bus", "walk"),)), by_mode=True))
    assert tree[(5, "walk-bus-walk")] == 11.0 and (5, "bike") not in tree
    assert costs(reach(origins, edges, Constraints(sequences=(("walk", "bus", "walk"),)), by_mode=True)).keys() >= {(3, "walk"), (3, "walk-bus")}


def test_distances_and_minimum(line):
    edges, origins = line
    assert best(reach(origins, edges, Constraints(distance=900.0))) == {2: 5.0, 3: 6.0}
    assert best(reach(origins, edges, Constraints(mode_cost={"bus": 1.0, "bike": 1.0}))) == {2: 5.0, 3: 6.0}
    assert best(reach(origins, edges, Constraints(leg_minimum={"walk": 500.0}), by_mode=True))[4] == 12.0
    assert best(reach(origins, edges, Constraints(mode_distance={"walk": 500.0})))[5] == 30.0


def test_delay_and_size(line, spark):
    edges, origins = line
    assert best(reach(origins, edges, Constraints(), delays={1: 10.0}))[2] == 15.0
    assert best(reach(origins, edges, Constraints(), delays=spark.createDataFrame([(1, 10.0)], "origin long, delay double")))[2] == 15.0
    assert reach(origins, edges, Constraints(), most=2).count() == 2
    assert {r["mode_seq"] for r in reach(origins, edges, Constraints()).collect()} == {"", "walk", "walk-bus", "walk-bus-walk"}


def test_limits_of_trips_and_legs(line):
    edges, origins = line
    with_limit = lambda *x, **k: best(reach(origins, edges, Constraints(limits=x, **k)))
    assert with_limit(Limit(5.0, "cost", "max_exclusive")) == {} and with_limit(Limit(5.0, "cost")) == {2: 5.0}
    assert with_limit(Limit(400.0, op="min_inclusive", mode="walk"))[3] == 6.0
    assert with_limit(Limit(400.0, op="min_exclusive", mode="walk"))[4] == 12.0
    assert with_limit(Limit(2.0, "cost", mode="bus", leg=1)) == {2: 5.0, 3: 6.0, 4: 12.0, 5: 15.0}
    assert with_limit(Limit(2.0, "cost", mode="bus", leg="first"))[4] == 8.0
    assert with_limit(Limit(100.0, mode="walk", leg="last"), max_legs=3)[5] == 30.0
    with pytest.raises(ValueError):
        with_limit(Limit(100.0, mode="walk", leg="last"))
    with pytest.raises(ValueError):
        with_limit(Limit(100.0, op="about"))


def test_every_limit_against_enumeration(spark):
    """The cheapest valid trip of every vertex, against all simple walks of a small network."""
    rng = random.Random(12)
    rows = [(rng.randrange(6), rng.randrange(6), 0, i, rng.choice(["walk", "bike", "bus"]), float(rng.randint(1, 9)), float(rng.randint(1, 9) * 100)) for i in range(22)]
    edges, origins = spark.createDataFrame(rows, EDGES), spark.createDataFrame([(0,), (3,)], "origin long")

    def enumerated(cost, ok):
        out = {}
        for origin in (0, 3):
            queue = [(origin, ())]
            while queue:
                at, trip = queue.pop()
                for r in rows:
                    longer = (*trip, r)
                    if r[0] == at and sum(x[5] for x in trip) <= cost and len(longer) <= 9 and ok(longer):
                        key = (origin, r[1])
                        total = sum(x[5] for x in longer)
                        out[key] = min(out.get(key, total), total)
                        if total <= cost:
                            queue.append((r[1], longer))
        return {k: v for k, v in out.items() if k[0] != k[1]}

    legs = lambda trip: [(m, list(g)) for m, g in groupby(trip, key=lambda x: x[4])]
    length = lambda trip: sum(x[6] for x in trip)
    cases = [
        (Constraints(cost=9.0, max_legs=2), lambda t: len(legs(t)) <= 2),
        (Constraints(cost=9.0, distance=1200.0), lambda t: length(t) <= 1200),
        (Constraints(cost=9.0, mode_distance={"bike": 500.0}), lambda t: length([x for x in t if x[4] == "bike"]) <= 500),
        (Constraints(cost=9.0, leg_minimum={"walk": 700.0}), lambda t: all(m != "walk" or length(g) >= 700 for m, g in legs(t)[:-1])),
        (Constraints(cost=9.0, limits=(Limit(600.0, mode="bus"),)), lambda t: all(m != "bus" or length(g) <= 600 for m, g in legs(t))),
    ]
    for limits, ok in cases:
        got = {(r["origin"], r["vertex_id"]): r["cost"] for r in reach(origins, edges, limits).collect() if r["edge_id"] is not None and r["origin"] != r["vertex_id"]}
        assert got == enumerated(limits.cost, ok), limits


def test_timetable(spark):
    """A ride waits for its departure; a later one serves a later arrival at the stop."""
    edges = spark.createDataFrame([(1, 2, 0, 1, "walk", 5.0, 400.0), (2, 3, 1, 1, "transit", 0.0, 900.0), (3, 4, 1, 2, "transit", 0.0, 900.0), (1, 4, 0, 2, "walk", 60.0, 5000.0)], EDGES)
    times = spark.createDataFrame([(1, 1, 478.0, 480.0, 7), (1, 1, 486.0, 490.0, 7), (1, 1, 500.0, 503.0, 7), (1, 2, 491.0, 495.0, 7), (1, 2, 490.0, 499.0, 8)], "edge_list_id int, edge_id long, departure double, arrival double, route long")
    origins = spark.createDataFrame([(1,)], "origin long")
    tree = {r["vertex_id"]: r for r in reach(origins, edges, Constraints(cost=100.0), timetable=Timetable(times, 480.0)).collect()}
    assert (tree[3]["cost"], tree[3]["route"], tree[3]["boarding"], tree[3]["dwell"]) == (10.0, 7, 1.0, None)
    assert (tree[4]["cost"], tree[4]["route"], tree[4]["dwell"], tree[4]["mode_seq"]) == (15.0, 7, 1.0, "walk-transit")
    late = {r["vertex_id"]: r["cost"] for r in reach(origins, edges, Constraints(cost=100.0), timetable=Timetable(times, 494.0)).collect()}
    assert late == {1: 0.0, 2: 5.0, 3: 9.0, 4: 60.0}


DEPARTURES = "edge_list_id int, edge_id long, departure double, arrival double, route string"


def test_express_overtakes(spark):
    """The ride that arrives first wins, though another leaves before it."""
    edges = spark.createDataFrame([(1, 2, 1, 1, "transit", 0.0, 900.0)], EDGES)
    origins = spark.createDataFrame([(1,)], "origin long")
    find = lambda rows, start, **k: [(r["cost"], r["route"]) for r in reach(origins, edges, Constraints(cost=100.0), timetable=Timetable(spark.createDataFrame(rows, DEPARTURES), start, **k)).collect() if r["edge_id"]]
    rows = [(1, 1, 5.0, 50.0, "slow"), (1, 1, 6.0, 10.0, "express"), (1, 1, 7.0, 6.5, "wrong"), (1, 1, 30.0, 49.0, "last"), (1, 1, 30.0, 48.0, "least"), (1, 1, 30.0, 48.0, "same")]
    assert find(rows, 0.0) == [(10.0, "express")] and find(rows, 6.5) == [(41.5, "least")] and find(rows, 31.0) == []
    beyond = [(1, 1, 5.0, 300.0, "slow"), (1, 1, 120.0, 130.0, "late")]  # departs beyond the limit, arrives first
    assert find(beyond, 0.0) == [(130.0, "late")]


def test_dates_are_mapped_before_the_look_up(spark):
    """Days of 100 units: on day 2 route "a" runs as on day 0, and on to day 1; "b" runs by its own dates."""
    edges = spark.createDataFrame([(1, 2, 1, 1, "transit", 0.0, 900.0)], EDGES)
    origins = spark.createDataFrame([(1,)], "origin long")
    rows = [(1, 1, 20.0, 30.0, "a"), (1, 1, 120.0, 125.0, "a"), (1, 1, 250.0, 255.0, "b"), (1, 1, 310.0, 320.0, "b")]
    mapping = spark.createDataFrame([("a", 2, 0), ("c", 2, 1)], "route string, target_day long, picked_day long")
    times = spark.createDataFrame(rows, DEPARTURES)
    find = lambda start: [(r["cost"], r["route"]) for r in reach(origins, edges, Constraints(cost=150.0), timetable=Timetable(times, start, mapping, 100.0)).collect() if r["edge_id"]]
    assert find(205.0) == [(25.0, "a")]  # as at 5, back by two days
    assert find(221.0) == [(34.0, "b")] and find(256.0) == [(64.0, "b")]
    assert find(100.0) == [(25.0, "a")] and find(300.0) == [(20.0, "b")]


def test_timetables_against_enumeration(spark):
    """Arrivals over a small network of rides and walks, by label setting in plain Python, dates mapped or not."""
    rng = random.Random(6)
    rows = [(rng.randrange(7), rng.randrange(7), i % 2, i, "walk" if i % 5 == 0 else "transit", float(rng.randint(4, 30)), 100.0) for i in range(30)]
    rides = [(r[2], r[3], float(d), float(d + rng.randint(0, 60)), rng.choice("xyz")) for r in rows if r[4] == "transit" for d in (rng.randrange(600) for _ in range(9))]
    days = {("x", 2): 1, ("y", 2): 4, ("x", 3): 0, ("z", 9): 1}
    mapping = spark.createDataFrame([(*k, v) for k, v in days.items()], "route string, target_day long, picked_day long")
    times = spark.createDataFrame(rides, DEPARTURES)
    for start, maps in ((230.0, {}), (230.0, days)):
        want = {0: 0.0}
        for _ in range(60):  # arrivals only fall; with maps a later start may arrive earlier, so take every label
            for src, dst, lst, e, mode, cost, _ in rows:
                if src in want and want[src] <= 120:
                    now = start + want[src]
                    if mode == "walk":
                        got = want[src] + cost
                    else:
                        options = []
                        for li, ei, dep, arr, route in rides:
                            shift = (maps.get((route, now // 100), now // 100) - now // 100) * 100
                            if (li, ei) == (lst, e) and dep >= now + shift:
                                options.append(arr - shift)
                        if not options:
                            continue
                        got = min(options) - start
                    want[dst] = min(got, want.get(dst, got))
        tree = reach(spark.createDataFrame([(0,)], "origin long"), spark.createDataFrame(rows, EDGES), Constraints(cost=120.0), timetable=Timetable(times, start, mapping if maps else None, 100.0))
        assert {r["vertex_id"]: r["cost"] for r in tree.collect()} == want


@pytest.mark.parametrize("bucket", [None, 3.0, 1000.0, float("inf")])
def test_buckets_and_merges_change_nothing(spark, monkeypatch, bucket):
    """Costs and edges of a grid with ties, by any bucket width, merged tables and keys not broadcast."""
    from isoreach.graph import search

    monkeypatch.setattr(search, "MERGED", 3)
    monkeypatch.setattr(search, "FEW", 0)
    monkeypatch.setattr(search, "FRONTIER", 0 if bucket == 3.0 else 20_000)
    rng = random.Random(2)
    rows = []
    for k in range(36):
        for to in (k + 1 if k % 6 < 5 else None, k + 6 if k < 30 else None):
            if to is not None:
                rows += [(k, to, 0, len(rows), "walk", float(rng.randint(0, 4)), 1.0), (to, k, 0, len(rows) + 1, "walk", float(rng.randint(1, 4)), 1.0)]
    want = {}
    for origin in (0, 20):
        best = {origin: (0.0, 0)}
        for _ in range(80):
            for src, dst, _, _, _, cost, _ in rows:
                if src in best and best[src][0] <= 9.0:
                    got = (best[src][0] + cost, best[src][1] + 1)
                    best[dst] = min(best.get(dst, got), got)
        want |= {(origin, v): c for v, (c, _) in best.items()}
    tree = reach(spark.createDataFrame([(0,), (20,), (0,)], "origin long"), spark.createDataFrame(rows, EDGES), Constraints(cost=9.0), bucket=bucket)
    found = tree.collect()
    assert {(r["origin"], r["vertex_id"]): r["cost"] for r in found} == want and len(found) == len(want)
    for r in found:
        assert r["edge_id"] is None or rows[r["edge_id"]][:2] == (r["parent"], r["vertex_id"])
    assert reach(spark.createDataFrame([], "origin long"), spark.createDataFrame(rows, EDGES), Constraints(cost=9.0)).count() == 0


def test_on_demand(spark):
    """A ride starts in a zone with an open relation and may end where it leads."""
    edges = spark.createDataFrame([(1, 2, 0, 1, "flex", 5.0, 400.0), (2, 3, 0, 2, "flex", 5.0, 400.0), (1, 4, 0, 3, "flex", 1.0, 100.0), (3, 5, 0, 4, "walk", 2.0, 100.0)], EDGES)
    zones = spark.createDataFrame([(2, "a"), (3, "b"), (4, "c")], "vertex_id long, zone_id string")
    relations = spark.createDataFrame([("a", "b", 100.0, 200.0), ("c", "c", 300.0, 400.0)], "src_zone string, dst_zone string, opens double, closes double")
    origins = spark.createDataFrame([(1,)], "origin long")
    find = lambda start: {r["vertex_id"]: (r["zone"], r["may_alight"]) for r in reach(origins, edges, Constraints(cost=50.0), on_demand=OnDemand("flex", zones, relations, start)).collect()}
    assert find(150.0) == {1: (None, False), 2: ("a", False), 3: ("a", True), 5: (None, False)}
    assert find(350.0) == {1: (None, False), 4: ("c", True)}


def test_fixed_speeds(spark):
    edges = spark.createDataFrame([(1, 2, 0, 1, "walk", 9.0, 160.0), (1, 2, 0, 2, "bike", 9.0, 300.0), (1, 2, 0, 3, "drive", 9.0, 300.0)], EDGES)
    assert {r["mode"]: r["cost"] for r in with_costs(edges, {"walk": 80.0, "bike": 150.0}).collect()} == {"walk": 2.0, "bike": 2.0}
    assert {r["mode"]: r["cost"] for r in with_costs(edges, {"bike": "distance"}, "cost").collect()} == {"walk": 9.0, "bike": 1.0, "drive": 9.0}


def test_bins():
    from isoreach.operators.bins import Binning

    assert Binning("cost", (20, 10, 10)).intervals() == [("10", 0.0, 10.0), ("20", 0.0, 20.0)]
    assert Binning("cost", (10, 20), marginal=True).intervals() == [("20", 10.0, 20.0)]
    assert Binning("cost", (10, 20), marginal=True, prepend_zero=True).intervals() == [("10", 0.0, 10.0), ("20", 10.0, 20.0)]
    with pytest.raises(ValueError):
        Binning("cost", (10,), marginal=True).intervals()


def test_engine_cumulative_bins_grow(spark, line):
    from isoreach.engine import Engine
    from isoreach.operators.bins import Binning

    edges, origins = line
    opps = spark.createDataFrame([(2, "jobs", 3.0), (3, "jobs", 4.0), (5, "food", 1.0)], "vertex_id long, activity string, count double")
    places = spark.createDataFrame([(i, i * 0.01, (i % 2) * 0.01) for i in range(1, 6)], "vertex_id long, x double, y double")
    engine = Engine(spark).network(places, edges).opportunities(opps)
    rows = {(r["bin_key"], r["activity"]): r["opportunities"] for r in engine.access(origins, Constraints(), Binning("cost", (6, 12)), ["jobs", "food"]).collect()}
    assert rows == {("6", "jobs"): 3.0, ("6", "food"): 0.0, ("12", "jobs"): 7.0, ("12", "food"): 1.0}
    rings = {r["bin_key"]: (r["isochrone"], r["n_destinations"]) for r in engine.isochrones(origins, Constraints(), Binning("cost", (6, 12))).collect()}
    assert rings["6"] == ("POLYGON EMPTY", 1) and rings["12"][1] == 4 and rings["12"][0].startswith("POLYGON((")
