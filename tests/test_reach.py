"""Reach from many starts, its outlines, walks between stops and the loading of roads by cell, against plain searches."""

import heapq
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from outways.operators import reach

DEGREE = 1 / 111_000
LAT0, LON0 = 35.0, 139.0


def dijkstra(arcs, starts):
    ways = {}
    for a, b, step in arcs:
        if step is not None:
            ways.setdefault(a, []).append((b, step))
    cost, queue = {}, [(c, n) for n, c in starts]
    for c, n in queue:
        cost[n] = min(c, cost.get(n, math.inf))
    heapq.heapify(queue)
    while queue:
        c, n = heapq.heappop(queue)
        if c > cost[n]:
            continue
        for b, step in ways.get(n, ()):
            if c + step < cost.get(b, math.inf):
                cost[b] = c + step
                heapq.heappush(queue, (c + step, b))
    return cost


def metres(a, b):
    p = math.pi / 180
    h = math.sin((b[0] - a[0]) * p / 2) ** 2 + math.cos(a[0] * p) * math.cos(b[0] * p) * math.sin((b[1] - a[1]) * p / 2) ** 2
    return 2 * 6371000 * math.asin(math.sqrt(h))


@pytest.fixture(scope="module")
def town(spark):
    """A grid of 12 by 12 corners, 100 metres apart, some streets of it closed."""
    rnd = random.Random(4)
    spots = {i: (LAT0 + (i // 12) * 100 * DEGREE, LON0 + (i % 12) * 120 * DEGREE) for i in range(144)}
    arcs = []
    for i in range(144):
        for j in (i + 1 if i % 12 < 11 else None, i + 12 if i < 132 else None):
            if j is not None:
                c = None if rnd.random() < 0.25 else float(rnd.randrange(60, 140))
                arcs += [(i, j, c), (j, i, c)]
    nodes = spark.createDataFrame([(i, *s) for i, s in spots.items()], "node long, lat double, lon double")
    return spots, arcs, nodes, spark.createDataFrame(arcs, "a long, b long, cost double")


def usable(spots, arcs):
    open_ = {n for a, b, c in arcs if c is not None for n in (a, b)}
    return {n: s for n, s in spots.items() if n in open_}


def nearest(spot, spots, limit):
    d, n = min((metres(spot, s), n) for n, s in spots.items())
    return (n, d) if d < limit else None


def test_transfers_are_the_plain_searches_rows(spark, town):
    spots, arcs, nodes, table = town
    rnd = random.Random(9)
    places = [(i, LAT0 + rnd.random() * 1100 * DEGREE, LON0 + rnd.random() * 1300 * DEGREE) for i in range(40)]
    places += [(90, LAT0 + 0.5, LON0), (91, LAT0 + 0.5, LON0 + 100 * DEGREE)]  # near each other, far from any road
    slow = [(a, b, None if c is None else c * 2) for a, b, c in arcs]
    got = reach.road_transfers(spark.createDataFrame(places, "place_id long, lat double, lon double"), nodes, {"normal": table, "stroller": table.withColumn("cost", F.col("cost") * 2)})
    got = {(r["tier"], r["a"], r["b"]): r["seconds"] for r in got.collect()}
    want = {}
    for tier, of in (("normal", arcs), ("stroller", slow)):
        held = usable(spots, of)
        for a, *at in places:
            start = nearest(at, held, 400)
            if start is None:
                continue
            cost = dijkstra(of, [(start[0], 0.0)])
            for b, *to in places:
                end = nearest(to, held, 250)
                if a != b and end and abs(at[0] - to[0]) < 0.005 and metres(at, to) <= 400 and end[0] in cost and cost[end[0]] + end[1] / 80 * 60 <= 600:
                    want[tier, a, b] = int(cost[end[0]] + end[1] / 80 * 60)
    want |= {("gentle", a, b): int(s * (80 / 65)) for (tier, a, b), s in want.items() if tier == "normal"}
    assert got == want and len(want) > 100
    assert any(("normal", a, b) in want and ("stroller", a, b) not in want for _, a, b in want)


def test_a_place_given_twice_and_an_empty_table(spark, town):
    _, _, nodes, table = town
    places = spark.createDataFrame([(1, LAT0, LON0), (1, LAT0 + 200 * DEGREE, LON0), (2, LAT0 + 200 * DEGREE, LON0)], "place_id long, lat double, lon double")
    got = reach.road_transfers(places, nodes, {"normal": table}, gentle=None).collect()
    assert sorted((r["a"], r["b"]) for r in got) == [(1, 2), (2, 1)] and min(r["seconds"] for r in got) == 0
    assert reach.road_transfers(places.limit(0), nodes, {"normal": table}).count() == 0


def test_places_at_one_spot_are_searched_for_once(spark, town):
    """Copies of a place walk as it does, also to each other, and multiply only where the rows are written out."""
    spots, arcs, nodes, table = town
    rnd, widest, held, want = random.Random(9), [], usable(spots, arcs), {}
    at = [(LAT0 + rnd.random() * 1100 * DEGREE, LON0 + rnd.random() * 1300 * DEGREE) for _ in range(12)]
    n = len(at)

    def cut(df):
        kept = df.localCheckpoint()
        widest.append(kept.count() if {"a", "b"} <= set(kept.columns) and "cost" not in kept.columns else 0)
        return kept

    for a, here in enumerate(at):
        start = nearest(here, held, 400)
        cost = dijkstra(arcs, [(start[0], 0.0)]) if start else {}
        for b, to in enumerate(at):
            end = nearest(to, held, 250)
            if end and abs(here[0] - to[0]) < 0.005 and metres(here, to) <= 400 and end[0] in cost and cost[end[0]] + end[1] / 80 * 60 <= 600:
                want |= {(a + n * i, b + n * j): int(cost[end[0]] + end[1] / 80 * 60) for i in range(5) for j in range(5) if a != b or i != j}
    copies = spark.createDataFrame([(k + n * i, *spot) for k, spot in enumerate(at) for i in range(5)], "place_id long, lat double, lon double")
    rows = reach.road_transfers(copies, nodes, {"normal": table}, gentle=None, cut=cut).collect()
    assert {(r["a"], r["b"]): r["seconds"] for r in rows} == want and len(rows) == len(want) and any(a % n != b % n for a, b in want)
    assert 0 < max(widest) <= n * n


def test_each_question_has_its_own_limit_and_seeds(spark, town):
    spots, arcs, nodes, table = town
    asks = [("short", LAT0 + 3 * DEGREE, LON0, 2), ("long", LAT0 + 550 * DEGREE, LON0 + 650 * DEGREE, 12), ("off", LAT0 + 1.0, LON0, 500)]
    told = reach.asked(spark.createDataFrame(asks, "ask string, lat double, lon double, minutes int"))
    rows = {r["ask"]: r for r in told.collect()}
    assert {a: (r["minutes"], r["cell_m"]) for a, r in rows.items()} == {"short": (5, 100), "long": (12, 100), "off": (60, 200)}
    arrivals = [("long", LAT0, LON0, 500), ("long", LAT0, LON0 + 1000 * DEGREE, 800), ("off", LAT0 + 900 * DEGREE, LON0, 3000)]
    starts = reach.seeds(told, spark.createDataFrame(arrivals, "ask string, lat double, lon double, used int"))
    got: dict = {}
    reached = reach.reached_nodes(starts, nodes, table)
    for r in reached.collect():
        got.setdefault(r["ask"], {})[r["node"]] = r["cost"]
    held = usable(spots, arcs)
    for ask, row in rows.items():
        seeds = [((row["lat"], row["lon"]), 0)] + [((la, lo), u) for a, la, lo, u in arrivals if a == ask and u <= row["budget"]]
        first = [(n[0], used + n[1] / 80 * 60) for spot, used in seeds if (n := nearest(spot, held, 300))]
        want = {n: c for n, c in dijkstra(arcs, [(n, c) for n, c in first if c <= row["budget"]]).items() if c <= row["budget"]}
        assert got.get(ask, {}).keys() == want.keys() and all(abs(got[ask][n] - c) < 1e-6 for n, c in want.items())
    assert len(got["long"]) > len(got["short"]) > 3
    cells = reach.question_cells(told, reached, nodes)
    # The cell of the start is there even where no road is.
    assert {r["ask"] for r in cells.collect()} == {"short", "long", "off"}
    stats = reached.groupBy("ask").agg(F.count("*").alias("reached_nodes")).withColumn("places", F.lit(1).cast("long")).filter("ask <> 'off'")
    answers = {r["ask"]: json.loads(r["answer"]) for r in reach.reach_documents(told, cells, stats, "transit", "電車").collect()}
    assert answers["long"]["reached_nodes"] == len(got["long"]) and answers["off"]["reached_nodes"] == 0 and answers["long"]["geojson"]["features"][0]["properties"]["label"] == "電車"
    for ask, a in answers.items():
        rings = [ring for polygon in a["geojson"]["features"][0]["geometry"]["coordinates"] for ring in polygon]
        assert all(ring[0] == ring[-1] and len(ring) >= 5 for ring in rings)
        size = sum(x1 * y2 - x2 * y1 for ring in rings for (x1, y1), (x2, y2) in zip(ring, ring[1:])) / 2 / rows[ask]["dlat"] / rows[ask]["dlon"]
        assert abs(size - a["cells"]) < 1e-3


@pytest.mark.parametrize("share", [0.2, 0.5, 0.75])
def test_outlines_hold_exactly_the_cells(spark, share):
    rnd = random.Random(int(share * 100))
    cells = {k: {(y, x) for y in range(-7, 8) for x in range(12) if rnd.random() < share} for k in "ab"}
    got = reach.outlines(spark.createDataFrame([(k, y, x) for k, c in cells.items() for y, x in c], "ask string, y long, x long")).collect()
    for k, own in cells.items():
        polygons: dict = {}
        for r in got:
            if r["ask"] == k:
                points = [(p["y"], p["x"]) for p in r["points"]]
                turns = [(b[1] - a[1]) * (c[0] - b[0]) - (b[0] - a[0]) * (c[1] - b[1]) for a, b, c in zip(points, points[1:] + points[:1], points[2:] + points[:2])]
                assert all(turns)  # corners only
                polygons.setdefault(r["polygon"], {})[r["ring"]] = (r["cells"], points)
        assert sum(c for rings in polygons.values() for c, _ in rings.values()) == len(own)
        assert all(rings[0][0] > 0 and all(c < 0 for n, (c, _) in rings.items() if n) for rings in polygons.values())
        for y in range(-8, 9):
            for x in range(-1, 13):
                inside = [n for n, rings in polygons.items() if reach._inside((y + 0.5, x + 0.5), rings[0][1]) and not any(reach._inside((y + 0.5, x + 0.5), p) for i, (_, p) in rings.items() if i)]
                assert len(inside) == ((y, x) in own)


def test_cells_at_a_corner_and_a_hole_in_a_hole(spark):
    corner = [(0, 0), (1, 1)]
    frame = [(y, x) for y in range(7) for x in range(7) if y in (0, 6) or x in (0, 6)] + [(3, 3)]
    cells = spark.createDataFrame([("corner", y, x) for y, x in corner] + [("frame", y, x) for y, x in frame], "ask string, y long, x long")
    got = sorted((r["ask"], r["polygon"], r["ring"], r["cells"]) for r in reach.outlines(cells).collect())
    assert got == [("corner", 0, 0, 1), ("corner", 1, 0, 1), ("frame", 0, 0, 49), ("frame", 0, 1, -25), ("frame", 1, 0, 1)]
    assert reach.outlines(cells.limit(0)).count() == 0


def test_only_cells_wanted_and_not_loaded_are_read(spark, town, tmp_path):
    spots, _, _, _ = town
    size = 0.002
    cell = lambda lat, lon: (math.floor(lat / size), math.floor(lon / size))
    edges = [(i, i + 1, *cell(*spots[i]), 1, 1, 1, i % 2) for i in range(143)]
    path = str(tmp_path / "edges")
    spark.createDataFrame(edges, "a long, b long, y long, x long, walk int, bike int, car int, oneway int").write.partitionBy("y").parquet(path)
    points = [(LAT0 + 500 * DEGREE, LON0 + 500 * DEGREE), (LAT0, LON0)]
    loaded = [cell(*points[1])]
    table = lambda rows, schema: spark.createDataFrame(rows, schema)
    wanted = reach.wanted_cells(table(points, "lat double, lon double"), 250.0, size, table(loaded, "y long, x long"))
    want = set()
    for lat, lon in points:
        high, wide = 250 / 111000, 250 / (111000 * math.cos(math.radians(lat)))
        (y0, x0), (y1, x1) = cell(lat - high, lon - wide), cell(lat + high, lon + wide)
        want |= {(y, x) for y in range(y0, y1 + 1) for x in range(x0, x1 + 1)}
    want -= set(loaded)
    assert {(r["y"], r["x"]) for r in wanted.collect()} == want
    surveyed = table([(65, 66, "5")], "a long, b long, lev_diff string")
    got = reach.roads_within(spark.read.parquet(path), wanted, surveyed)
    held = [e for e in edges if (e[2], e[3]) in want]
    both = sorted([(e[0], e[1], 1) for e in held] + [(e[1], e[0], 0 if e[7] else 1) for e in held])
    assert sorted((r["a"], r["b"], r["car"]) for r in got.collect()) == both and 0 < len(held) < len(edges)
    assert [r["lev_diff"] for r in got.filter("a = 65 and b = 66").collect()] == (["5"] if any(e[0] == 65 for e in held) else [])
