"""All plans of many questions against plain searches of one question at a time."""

import heapq
import math
import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from outways.operators import journeys, roads, routeplans, timetable, walking
from outways.plans.profiles import Profile

NODE, ARC = "node long, lat double, lon double", "a long, b long, cost double, length double, highway string, attrs map<string,string>"
DEGREE = 1 / 111_000
TIMES = "feed_id string, trip_id string, seq int, place_id string, arr int, dep int"
QUICK = Profile("quick", walk_speed=80, max_walk_seconds=700)
PRAM = Profile("pram", tier="stroller", walk_speed=70, max_walk_seconds=500, steps=None, stroller=True)


def metres(p, q):
    (a, b), (c, d) = ((math.radians(x) for x in z) for z in (p, q))
    return 2 * 6_371_000 * math.asin(math.sqrt(math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2))


def dijkstra(arcs, start, most=1e18):
    cost, queue = {start: 0.0}, [(0.0, start)]
    while queue:
        c, n = heapq.heappop(queue)
        if c > cost[n]:
            continue
        for b, step in arcs.get(n, []):
            if c + step <= most and c + step < cost.get(b, 1e18):
                cost[b] = c + step
                heapq.heappush(queue, (c + step, b))
    return cost


def walked(point, places, nodes, arcs, speed, most):
    """Places on foot, one point at a time."""
    open_ = {n for a, out in arcs.items() for b, _ in out for n in (a, b)}
    near = lambda p, limit: min(((metres(p, nodes[n]), n) for n in open_ if metres(p, nodes[n]) < limit), default=None)
    close = sorted((metres(point, q), k) for k, q in places.items() if metres(point, q) < 1500)[:30]
    start, found = near(point, 400), {}
    if start:
        cost = dijkstra(arcs, start[1], most)
        for _, k in close:
            end = near(places[k], 250)
            if end and end[1] in cost and cost[end[1]] + end[0] / 80 * 60 <= most:
                found[k] = int(cost[end[1]] + end[0] / 80 * 60)
    return found or {k: int(m * 1.3 / speed * 60) for m, k in close if int(m * 1.3 / speed * 60) <= most}


def searched(access, egress, when, trips, transfers, stroller):
    """(signature, depart, arrive) of the best journeys of one question, by labels per round."""
    leaving = {}
    for key, (route, wheelchair, stops) in trips.items():
        for i, (p, t) in enumerate(stops):
            if not (stroller and wheelchair == "2"):
                leaving.setdefault(p, {}).setdefault(route, []).append((t, key, i))
    starts = sorted({when} | {t - s for p, s in access.items() for _, _, stops in trips.values() for q, t in stops if q == p and when <= t - s <= when + 10_800})[:12]
    found = {}
    for start in starts:
        best, rounds = {p: start + s for p, s in access.items()}, [{p: (start + s, []) for p, s in access.items()}]
        rounds[0] = {p: (t, [("walk", start, t)] if t - start >= 60 else []) for p, (t, _) in rounds[0].items()}
        for _ in range(3):
            offers = {}
            for p, (t, legs) in rounds[-1].items():
                for route, out in leaving.get(p, {}).items():
                    ride = min((x for x in out if t <= x[0] <= t + 10_800), default=None)
                    if ride:
                        for q, arr in trips[ride[1]][2][ride[2] + 1 :]:
                            offers.setdefault(q, []).append((arr, "ride", "f", ride[1], p, (*legs, ("ride", ride[0], arr, f"{route}/{ride[1]}"))))
                for q, s in transfers.get(p, {}).items():
                    offers.setdefault(q, []).append((t + s, "walk", "", "", p, (*legs, ("walk", t, t + s))))
            new = {q: min(o, key=lambda x: x[:5]) for q, o in offers.items()}
            new = {q: (o[0], list(o[5])) for q, o in new.items() if q not in best or o[0] < best[q]}
            best.update({q: t for q, (t, _) in new.items()})
            rounds.append(new)
        for turn, labels in enumerate(rounds):
            for p, (t, legs) in labels.items():
                if p in egress and any(x[0] == "ride" for x in legs):
                    legs = legs + ([("walk", t, t + egress[p])] if egress[p] > 60 else [])
                    sig = ">".join(x[3] for x in legs if x[0] == "ride")
                    row = (t + egress[p], len(legs), -legs[0][1], p, turn, start)
                    found[sig] = min(found.get(sig, row), row)
    if not found:
        return []
    out = [(sig, -r[2], r[0]) for sig, r in found.items()]
    shortest, earliest = min(a - d for _, d, a in out), min(a for _, _, a in out)
    out = [x for x in out if x[2] - x[1] <= shortest * 2.5 + 900 and x[2] <= earliest + 5400]
    return sorted(out, key=lambda x: (x[2], x[2] - x[1], x[0]))[:5]


@pytest.fixture(scope="module")
def world(spark):
    rnd = random.Random(4)
    side = 5
    nodes = {i: (35.0 + (i // side) * 120 * DEGREE, 139.0 + (i % side) * 200 * DEGREE) for i in range(side * side)}
    edges = []
    for i in nodes:
        for j in ((i + 1) if i % side < side - 1 else None, i + side):
            if j in nodes:
                edges.append((i, j, rnd.choice(["steps", "footway", "footway"]), float(rnd.randrange(120, 210))))
    # The last node is reached by steps alone.
    edges = [(a, b, "steps" if side * side - 1 in (a, b) else kind, c) for a, b, kind, c in edges]

    def legs(free):
        return [(x, y, None if free and kind == "steps" else c * (6 if free is None and kind == "steps" else 1), 200.0, kind, {}) for a, b, kind, c in edges for x, y in ((a, b), (b, a))]

    places = {f"p{k}": (lat + 15 * DEGREE, lon) for k, (lat, lon) in enumerate(nodes[n] for n in (0, 4, 7, 12, 17, 20, 24))}
    trips = {f"t{k:02}": (f"r{k % 5}", rnd.choice(["", "", "2"]), sorted(zip(rnd.sample(sorted(p for p in places if p != "far"), 3), sorted(rnd.sample(range(30_000, 38_000), 3)), strict=True), key=lambda x: x[1])) for k in range(40)}
    trips |= {f"u{k}": ("r1", "2", [("p0", 31_000 + 900 * k), ("far", 33_000 + 900 * k)]) for k in range(3)}
    transfers = {a: {b: max(120, int(metres(places[a], places[b]) * 1.3 / 80 * 60)) for b in places if b != a and metres(places[a], places[b]) <= 450} for a in places}
    tables = {
        "nodes": spark.createDataFrame([(n, *p) for n, p in nodes.items()], NODE), "places": spark.createDataFrame([(k, *p) for k, p in places.items()], "place_id string, lat double, lon double"),
        "stop_times": spark.createDataFrame([("f", t, i, p, None, at) for t, (_, _, stops) in trips.items() for i, (p, at) in enumerate(stops)], TIMES),
        "trips": spark.createDataFrame([("f", t, r, w) for t, (r, w, _) in trips.items()], "feed_id string, trip_id string, route_id string, wheelchair string"),
        "transfers": spark.createDataFrame([(a, b, s, tier) for a, out in transfers.items() for b, s in out.items() for tier in ("normal", "stroller")], "a string, b string, seconds int, tier string"),
        "routes": spark.createDataFrame([(f"r{k}", 3 if k % 2 else 2) for k in range(5)], "route_id string, route_type int"),
    }
    return nodes, places, trips, transfers, {name: legs(free) for name, free in (("quick", False), ("pram", True), ("relaxed", None))}, tables


def test_plans_of_many_questions(spark, world):
    nodes, places, trips, transfers, legs, t = world
    rnd = random.Random(5)
    ends = [(0, 24), (0, 12), (4, 20), (7, 24)]
    asks = []
    for k, (o, d) in enumerate(ends * 2):
        profile = ("quick", "pram")[k >= len(ends)]
        asks.append((k, profile, 30_500, nodes[o][0] - 20 * DEGREE, nodes[o][1], nodes[d][0] + 25 * DEGREE, nodes[d][1] + rnd.random() * 20 * DEGREE))
    asks.append((90, "pram", 30_500, 35.0, 139.0, 36.0, 139.001))
    asked = spark.createDataFrame(asks, "ask int, profile string, when int, o_lat double, o_lon double, d_lat double, d_lon double")
    ways = {n: spark.createDataFrame(rows, ARC) for n, rows in legs.items()}
    travels = {"quick": routeplans.Travel(QUICK, {"walk": ways["quick"], "car": ways["quick"]}), "pram": routeplans.Travel(PRAM, {"walk": ways["pram"]}, ways["relaxed"])}
    cards, found, on_road = routeplans.plan_all(asked, travels, t["places"], t["nodes"], t["stop_times"], timetable.departures(t["stop_times"], t["trips"]), t["transfers"], t["routes"], ("walk", "car"))
    got = {}
    for r in found.orderBy("ask", "rank").collect():
        got.setdefault(r["ask"], []).append((r["signature"], r["depart"], r["arrive"], r["stage"]))
    graph = {}
    for name, rows in legs.items():
        for a, b, c, *_ in rows:
            if c is not None:
                graph.setdefault(name, {}).setdefault(a, []).append((b, c))
    want, stages = {}, set()
    for k, profile, when, *p in asks:
        for stage, (name, own, most) in enumerate([("quick", QUICK, 700)] if profile == "quick" else [("pram", PRAM, 500), ("relaxed", PRAM, 800)]):
            access, egress = (walked(x, places, nodes, graph[name], own.walk_speed, most) for x in (tuple(p[:2]), tuple(p[2:])))
            plans = searched(access, egress, when, trips, transfers, profile == "pram" and not stage)
            if plans:
                want[k] = [(*x, stage) for x in plans]
                stages.add(stage)
                break
    assert got == want
    assert stages == {0, 1}  # both stages of the cascade are met
    assert {r["warning"] for r in found.filter("stage = 1").collect()} == {journeys.RELAXED}
    walks = {(r["ask"], r["mode"]): r for r in on_road.collect()}
    assert len(walks) == len(asks) + len(ends) and walks[90, "walk"]["unavailable"] and walks[90, "walk"]["arrive"] is None
    shown = {(r["ask"], r["card"]): (r["arrive"], r["signature"]) for r in cards.collect()}
    for k, *_ in asks:
        walk = walks[k, "walk"]["arrive"]
        assert shown.get((k, "walk")) == (None if walk is None else (walk, "walk"))
        first = [(x[2], x[0]) for x in got.get(k, [])[:1]]
        assert shown.get((k, "total")) == min([*first, *([(walk, "~walk")] if walk is not None else [])], default=None, key=lambda x: (x[0], x[1] == "~walk")) or shown[k, "total"] == (walk, "walk")


def test_asof_departures_equal_a_range_join(spark):
    rnd = random.Random(6)
    departing = spark.createDataFrame([(rnd.randrange(4), rnd.randrange(0, 400) * 60, "f", f"t{i:03}", rnd.randrange(3), rnd.randrange(5), rnd.choice(["", "2", None])) for i in range(500)], "place_id int, dep int, feed_id string, trip_id string, route_id int, idx int, wheelchair string")
    labels = spark.createDataFrame([(rnd.randrange(5), rnd.randrange(0, 400) * 60) for _ in range(200)], "place_id int, t int")
    for stroller in (False, True):
        got = sorted(map(tuple, timetable.next_departures(labels, departing, 3600, stroller).collect()))
        rows, want = departing.collect(), []
        for place, at in {tuple(r) for r in labels.collect()}:
            for route in range(3):
                fit = [(r["dep"], r["trip_id"], r["idx"]) for r in rows if r["place_id"] == place and r["route_id"] == route and at <= r["dep"] <= at + 3600 and not (stroller and r["wheelchair"] == "2")]
                if fit:
                    want.append((place, at, "f", route, *min(fit)))
        assert got == sorted(want)


def random_graph(seed, n=300, m=1300):
    rnd = random.Random(seed)
    arcs = {}
    for _ in range(m):
        arcs.setdefault(rnd.randrange(n), []).append((rnd.randrange(n), float(rnd.choice([0, 1, 2, 5, 9, 20]))))
    return arcs


@pytest.mark.parametrize("delta", [None, 4.0])
def test_shortest_in_buckets(spark, delta, monkeypatch):
    arcs = random_graph(7)
    table = spark.createDataFrame([(a, b, c) for a, out in arcs.items() for b, c in out], "a long, b long, cost double")
    sources = spark.createDataFrame([(s, s, 0.0) for s in (0, 1)], "start long, node long, cost double")
    monkeypatch.setattr(roads, "PARTS", 3)
    known = roads.shortest(table, sources, 12.0, by=("start",), delta=delta).cache()
    want = {(s, n): c for s in (0, 1) for n, c in dijkstra(arcs, s, 12.0).items()}
    assert {(r["start"], r["node"]): r["cost"] for r in known.collect()} == want
    # Following predecessors always ends at the start, though many arcs cost nothing.
    sums = roads.path_sums(known, known.select("start", "node", F.lit(1.0).alias("legs")), ["legs"], by=("start",))
    assert sums.count() == len(want)


def test_arcs_without_cost_make_no_circle(spark):
    arcs = spark.createDataFrame([(10, 2, 5.0), (2, 1, 0.0), (1, 2, 0.0), (1, 3, 0.0)], "a long, b long, cost double")
    known = roads.shortest(arcs, spark.createDataFrame([(10, 0.0)], "node long, cost double"))
    assert {(r["node"], r["pred"]) for r in known.collect()} == {(10, None), (2, 10), (1, 2), (3, 1)}
    assert {r["node"]: r["hops"] for r in roads.path_sums(known, known.select("node"), []).collect()} == {10: 0, 2: 1, 1: 2, 3: 3}


def test_landmarks_bound_the_search(spark):
    rnd, side = random.Random(8), 12
    nodes = {i: (35.0 + (i // side) * 100 * DEGREE, 139.0 + (i % side) * 100 * DEGREE) for i in range(side * side)}
    arcs = [(x, y, float(rnd.randrange(60, 90))) for i in nodes for j in ((i + 1) if i % side < side - 1 else None, i + side) if j in nodes for x, y in ((i, j), (j, i))]
    arcs += [(1000, 1001, 1.0), (1001, 1000, 1.0)]  # an island
    node_df = spark.createDataFrame([(n, *p) for n, p in [*nodes.items(), (1000, (35.0, 138.99)), (1001, (35.0, 138.991))]], NODE)
    arc_df = spark.createDataFrame(arcs, "a long, b long, cost double")
    pairs = [(k, *nodes[o], *nodes[d]) for k, (o, d) in enumerate([(0, 2), (5, 20), (100, 103), (120, 143), (17, 33)])]
    pair_df = spark.createDataFrame(pairs, "pair long, o_lat double, o_lon double, d_lat double, d_lon double")
    marks = roads.landmarks(node_df, arc_df)
    full, all_known = walking.route_ends(pair_df, node_df, arc_df, 80.0)
    near, some_known = walking.route_ends(pair_df, node_df, arc_df, 80.0, marks=marks)
    assert sorted(map(tuple, near.collect())) == sorted(map(tuple, full.collect()))
    assert some_known.count() < all_known.count() / 3
    # The ways themselves are the same, leg by leg.
    assert sorted(map(tuple, walking.way_nodes(near, some_known).collect())) == sorted(map(tuple, walking.way_nodes(full, all_known).collect()))


def test_relaxed_profiles_are_no_strollers():
    assert not replace(PRAM).relaxed().stroller and PRAM.relaxed().steps == 6.0
