"""Ways, stations and journeys against plain searches on small graphs."""

import heapq
import random

import pytest
from pyspark.sql import functions as F

from outways.operators import indoor, journeys, walking

NODE, ARC = "node long, lat double, lon double", "a long, b long, cost double, length double, highway string, attrs map<string,string>"
DEGREE = 1 / 111_000


def dijkstra(arcs, start):
    cost, queue = {start: 0.0}, [(0.0, start)]
    while queue:
        c, n = heapq.heappop(queue)
        if c > cost[n]:
            continue
        for a, b, step, *_ in arcs:
            if a == n and step is not None and c + step < cost.get(b, 1e18):
                cost[b] = c + step
                heapq.heappush(queue, (c + step, b))
    return cost


@pytest.fixture(scope="module")
def town(spark):
    rnd = random.Random(8)
    nodes = [(i, 35.0 + (i // 6) * 100 * DEGREE, 139.0 + (i % 6) * 100 * DEGREE) for i in range(36)]
    arcs = []
    for i in range(36):
        for j in ((i + 1) if i % 6 < 5 else None, i + 6):
            if j is not None and j < 36:
                steps = rnd.random() < 0.3
                c = None if steps else float(rnd.randrange(60, 120))
                kind = "steps" if steps else rnd.choice(["footway", "elevator"])
                arcs += [(x, y, c, 100.0, kind, {"covered": "yes"} if rnd.random() < 0.5 else {}) for x, y in ((i, j), (j, i))]
    nodes += [(100, 35.0 - 50 * DEGREE, 139.0), (101, 35.0 - 60 * DEGREE, 139.0)]  # an island by the origin
    arcs += [(100, 101, 5.0, 10.0, "footway", {}), (101, 100, 5.0, 10.0, "footway", {})]
    return nodes, arcs, spark.createDataFrame(nodes, NODE), spark.createDataFrame(arcs, ARC)


def test_plans_equal_a_plain_search(spark, town):
    nodes, arcs, node_df, arc_df = town
    pairs = spark.createDataFrame([(1, 35.0, 139.0, 35.0 + 500 * DEGREE, 139.0 + 300 * DEGREE), (2, 35.0, 139.0, 36.0, 139.0), (3, 35.0, 139.0, 35.0, 139.0)], "pair long, o_lat double, o_lon double, d_lat double, d_lon double")
    got = {r["pair"]: r for r in walking.walk_plans(pairs, node_df, arc_df, 80.0).collect()}
    assert got[2]["unavailable"] and got[2]["reason"] == "歩くには遠すぎます" and got[2]["seconds"] is None and got[2]["straight_m"] > 100_000
    usable = {x for a, b, c, *_ in arcs if c is not None for x in (a, b)}
    near = lambda lat, lon: sorted((((n[1] - lat) ** 2 + (n[2] - lon) ** 2) ** 0.5, n[0]) for n in nodes if n[0] in usable)[:8]
    starts, ends = [n for _, n in near(35.0, 139.0)][:2], near(35.0 + 500 * DEGREE, 139.0 + 300 * DEGREE)
    options = [dijkstra(arcs, s).get(n) for s in starts for _, n in ends]
    assert got[1]["seconds"] == min(int(o) for o in options if o is not None) or got[1]["seconds"] >= min(o for o in options if o is not None) - 1
    assert got[1]["step_free"] and got[1]["steps"] == 0 and got[1]["metres"] >= 0 and got[3]["seconds"] is not None


def test_steps_are_taken_only_where_nothing_else_leads(spark):
    nodes = spark.createDataFrame([(1, 35.0, 139.0), (2, 35.0, 139.01), (3, 35.001, 139.0)], NODE)
    flat = [(1, 3, 10.0, 10.0, "footway", {}), (3, 1, 10.0, 10.0, "footway", {})]
    free = spark.createDataFrame([*flat, (1, 2, None, 900.0, "steps", {}), (2, 1, None, 900.0, "steps", {}), (2, 2, 1.0, 1.0, "footway", {})], ARC)
    relaxed = spark.createDataFrame([*flat, (1, 2, 700.0, 900.0, "steps", {"covered": "yes"}), (2, 1, 700.0, 900.0, "steps", {})], ARC)
    pairs = spark.createDataFrame([(1, 35.0, 139.0, 35.0, 139.01), (2, 35.0, 139.0, 35.001, 139.0)], "pair long, o_lat double, o_lon double, d_lat double, d_lon double")
    got = {r["pair"]: r for r in walking.walk_plans(pairs, nodes, free, 70.0, relaxed=relaxed).collect()}
    assert got[1]["step_free"] is False and got[1]["steps"] == 1 and "階段が 1 か所" in got[1]["warning"] and got[1]["covered_m"] == 900
    assert got[2]["step_free"] and got[2]["warning"] is None
    ends, known = walking.route_ends(pairs, nodes, relaxed.select("a", "b", "cost"), 70.0)
    ways = {}
    for r in sorted(walking.way_nodes(ends, known).collect(), key=lambda r: (r["pair"], r["i"])):
        ways.setdefault(r["pair"], []).append(r["node"])
    assert ways[2] == [1, 3] or ways[2] == [3]


def test_reachable_points_and_their_bounds(spark, town):
    nodes, arcs, node_df, arc_df = town
    origin = spark.createDataFrame([("o", 35.0 + 200 * DEGREE, 139.0)], "origin string, lat double, lon double")
    candidates = [(i, n[1] + 20 * DEGREE, n[2]) for i, n in enumerate(nodes[:36])] + [(99, 40.0, 139.0)]
    got = {r["candidate"]: r["seconds"] for r in walking.reachable_points(origin, spark.createDataFrame(candidates, "candidate long, lat double, lon double"), node_df, arc_df, 500).collect()}
    cost = dijkstra(arcs, 12)
    want = {i: cost[i] + 15 for i in range(36) if i in cost and cost[i] + 15 <= 500}
    assert set(got) <= set(range(36)) and all(abs(got[i] - want[i]) <= 1 for i in got if i in want) and len(set(got) ^ set(want)) <= 3


def test_obstacles_are_folded_along_the_way(spark):
    legs = [(1, i, "steps" if i in (1, 2, 3, 9) else "footway", "5" if i == 4 else "1", "1" if i == 4 else None, "6" if i == 7 else "1", 35.0 + i * 30 * DEGREE, 139.0) for i in range(1, 10)]
    got = walking.obstacles(spark.createDataFrame(legs, "pair long, i int, highway string, lev_diff string, width_code string, vtcl_slope string, lat double, lon double")).first()["obstacles"]
    # Steps 1 and 2 are 30 m apart; 3 is 60 m from the mark that was kept.
    assert [(o["kind"], o["count"], o["i"]) for o in got] == [("steps", 2, 1), ("steps", 1, 3), ("narrow", 1, 4), ("step", 1, 4), ("steep", 1, 7), ("steps", 1, 9)]


def plain_diverge(chosen, plain):
    n, p, s = min(len(chosen), len(plain)), 0, 0
    while p < n and chosen[p] == plain[p]:
        p += 1
    if p >= len(plain):
        return None
    while s < n - p and chosen[len(chosen) - 1 - s] == plain[len(plain) - 1 - s]:
        s += 1
    return (p, len(plain) - s) if len(plain) - s > p else None


def test_diverging_parts(spark):
    rnd = random.Random(3)
    rows = []
    for k in range(60):
        a = [float(rnd.randrange(3)) for _ in range(rnd.randrange(1, 7))]
        b = a[: rnd.randrange(len(a) + 1)] + [float(rnd.randrange(3)) for _ in range(rnd.randrange(0, 3))] + a[rnd.randrange(len(a)) :]
        rows.append((k, [(x, 0.0) for x in a], [(x, 0.0) for x in b]))
    line = "array<struct<lon:double,lat:double>>"
    got = spark.createDataFrame(rows, f"k int, a {line}, b {line}").select("k", walking.diverging(F.col("a"), F.col("b")).alias("s")).collect()
    for r in got:
        assert (tuple(r["s"]) if r["s"] else None) == plain_diverge(rows[r["k"]][1], rows[r["k"]][2])


def test_comparison_keeps_marks_of_the_other_part(spark):
    mark = lambda i: (35.0, 139.0, "steps", "階段", "OpenStreetMap", 1, i)
    line = lambda *xs: [(float(x), 0.0) for x in xs]
    rows = [(1, line(0, 1, 5, 6, 3, 4), 900, line(0, 1, 2, 3, 4), 400, [mark(2), mark(4)]), (2, line(0, 1), 100, line(0, 1), 100, [mark(1)])]
    pt = "array<struct<lon:double,lat:double>>"
    ways = spark.createDataFrame(rows, f"pair long, coords {pt}, metres int, plain_coords {pt}, plain_metres int, plain_obstacles array<struct<lat:double,lon:double,kind:string,label:string,source:string,count:int,i:int>>")
    (got,) = walking.compared(ways, 70.0).collect()
    assert got["pair"] == 1 and got["extra_m"] == 500 and got["extra_seconds"] == 428 and [p["lon"] for p in got["coords"]] == [1, 2, 3] and [o["i"] for o in got["obstacles"]] == [2]


STOP = "stop_id string, stop_name string, lat double, lon double, location_type int, parent_station string"
PATH = "from_stop string, to_stop string, mode int, bidirectional int, length double"


def test_inside_a_station(spark):
    stops = spark.createDataFrame(
        [("S", "大門駅", 35.0, 139.0, 1, None), ("E1", "A1", 35.0, 139.0, 2, "S"), ("E2", None, 35.0, 139.0, 2, "S"), ("B", "1", 35.0, 139.0, 0, "S"), ("AR", "", 35.0, 139.0, 4, "B"), ("H", "", 35.0, 139.0, 3, "S"), ("T", "端", 35.0, 139.0, 1, ""), ("X", "x", 35.0, 139.0, 2, "T")],
        STOP,
    )
    paths = spark.createDataFrame([("E1", "H", 1, 1, 70.0), ("H", "AR", 2, 1, 70.0), ("H", "AR", 5, 0, None), ("E2", "AR", 4, 1, 50.0)], PATH)
    plain, free = (indoor.entrance_times(stops, paths, f).cache() for f in (False, True))
    assert {(r["entrance"], r["board"], r["seconds"]) for r in plain.collect()} == {("E1", "B", 65 + 70), ("E2", "B", 75), ("X", None, None)}
    assert {(r["entrance"], r["seconds"]) for r in free.collect()} == {("E1", 135), ("E2", None), ("X", None)}
    assert [r["entrance"] for r in indoor.entrances(free).filter("station = 'S'").collect()] == ["E1", "E2"]
    said = {r["station"]: r for r in indoor.stations(stops, free).collect()}
    assert said["S"]["entrances"] == 2 and said["S"]["step_free_count"] == 1 and said["S"]["text"].startswith("A1 の出入口から") and said["T"]["text"].startswith("公開されている")
    assert indoor.summary(indoor.stations(stops, free)).first().asDict() == {"stations": 2, "entrances": 3, "step_free": 1}
    station = spark.createDataFrame([("S", "大門", "f", 35.0, 139.0)], "station string, name string, feed_id string, lat double, lon double")
    places = spark.createDataFrame([("p", "大門", ["f"], 35.001, 139.0), ("far", "大門", ["f"], 35.1, 139.0), ("other", "大門", ["g"], 35.0, 139.0)], "place_id string, name string, feeds array<string>, lat double, lon double")
    extra = indoor.extra_seconds(indoor.station_seconds(plain), indoor.station_seconds(free), indoor.places_of(station, places))
    assert [(r["place_id"], r["extra"]) for r in extra.collect()] == [("p", 60)]
    legs = spark.createDataFrame([(1, "大門"), (2, "none")], "leg int, from_name string")
    assert {r["leg"]: r["station"] for r in indoor.station_for(legs, indoor.stations(stops, free)).collect()} == {1: "S", 2: None}
    circle = spark.createDataFrame([("a", "", 0.0, 0.0, 0, "b"), ("b", "", 0.0, 0.0, 0, "a")], STOP)
    with pytest.raises(RuntimeError, match="circle"):
        indoor.rooted(circle, max_rounds=4)


def test_boarding_places_are_counted_without_a_row_each():
    import random

    pick = random.Random(5)
    for size, arcs in ((12, 14), (40, 70), (60, 200)):
        ways = {a: {} for a in range(size)}
        for _ in range(arcs):
            ways[pick.randrange(size)][pick.randrange(size)] = pick.randrange(1, 90) * 6 / 7
        begun = [(n % 3, n) for n in range(0, size, 2)]
        boards = [(n % 2, n, n // 4) for n in range(1, size, 2)]
        for station, start, n in indoor.boards_reached([(a, b) for a, to in ways.items() for b in to], begun, boards):
            cost, left = {start: 0.0}, [start]
            while left:
                at = left.pop()
                for to, step in ways[at].items():
                    if cost[at] + step < cost.get(to, 1e9):
                        cost[to] = cost[at] + step
                        left.append(to)
            held = {(node, board) for s, node, board in boards if s == station and node in cost}
            assert n == len({board for _, board in held})
            if n:
                assert indoor.soonest(ways, start, {node for s, node, _ in boards if s == station}) == min(cost[node] for node, _ in held)


def test_journeys_of_a_morning(spark):
    times = [("f", "t1", 1, "A", None, 1000), ("f", "t1", 2, "B", None, 2000), ("f", "t2", 1, "A", None, 1500), ("f", "t2", 2, "B", None, 2100), ("f", "t3", 1, "B", None, 2200), ("f", "t3", 2, "C", None, 2500), ("f", "slow", 1, "A", None, 1000), ("f", "slow", 2, "C", None, 20_000)]
    stop_times = spark.createDataFrame(times, "feed_id string, trip_id string, seq int, place_id string, arr int, dep int")
    from outways.operators import timetable

    trips = spark.createDataFrame([("f", "t1", "r1", ""), ("f", "t2", "r2", "2"), ("f", "t3", "r3", ""), ("f", "slow", "r4", "")], "feed_id string, trip_id string, route_id string, wheelchair string")
    departing = timetable.departures(stop_times, trips)
    access, egress = spark.createDataFrame([("A", 100)], "place_id string, seconds int"), spark.createDataFrame([("C", 50)], "place_id string, seconds int")
    none = spark.createDataFrame([], "a string, b string, seconds int")
    found = journeys.search_many(access, egress, 800, stop_times, departing, none)
    rows = [(r["depart"], r["arrive"], r["transfers"], r["signature"], len(r["legs"])) for r in found.collect()]
    # The walk of 100 s is a leg, that of 50 s at the end isn't.
    assert rows == [(1400, 2550, 1, "r2/t2>r3/t3", 3), (900, 2550, 1, "r1/t1>r3/t3", 3)]
    strollers = journeys.search_many(access, egress, 800, stop_times, departing, none, stroller=True).collect()
    assert [r["signature"] for r in strollers] == ["r1/t1>r3/t3"]
    routes = spark.createDataFrame([("r1", 3), ("r2", 2), ("r3", 3), ("r4", 3)], "route_id string, route_type int")
    plans = journeys.decorated(found, routes).cache()
    assert {r["signature"]: r["kinds"] for r in plans.collect()} == {"r1/t1>r3/t3": ["bus"], "r2/t2>r3/t3": ["train", "bus"]}
    walk = spark.createDataFrame([(0, 2550)], "ask int, arrive int")
    # The first journey and the walk arrive at one time: the journey stays.
    assert {r["card"]: r["signature"] for r in journeys.cards(plans, walk).collect()} == {"bus": "r1/t1>r3/t3", "walk": "walk", "total": "r2/t2>r3/t3"}
    near = journeys.search_many(access.withColumn("seconds", F.lit(40)), egress, 800, stop_times, departing, none).collect()
    # A first walk under a minute is left out: the journey departs with the ride, of equal starts the first stays.
    assert [(r["start"], r["depart"], len(r["legs"])) for r in near] == [(1460, 1500, 2), (800, 1000, 2)]
    assert [r["seconds"] for r in journeys.with_extra(access, spark.createDataFrame([("A", 30)], "place_id string, extra int")).collect()] == [130]


def test_access_goes_by_road_or_else_straight(spark, town):
    _, _, node_df, arc_df = town
    places = spark.createDataFrame([("p", 35.0 + 300 * DEGREE, 139.0), ("q", 35.2, 139.0)], "place_id string, lat double, lon double")
    origins = spark.createDataFrame([("road", 35.0 + 200 * DEGREE, 139.0), ("field", 35.2 + 300 * DEGREE, 139.0)], "origin string, lat double, lon double")
    got = {(r["origin"], r["place_id"]): r["seconds"] for r in journeys.access_on_foot(origins, places, node_df, arc_df, 80.0, 1200).collect()}
    assert got["field", "q"] == pytest.approx(300 * 1.3 / 80 * 60, abs=2) and ("road", "p") in got and ("road", "q") not in got
