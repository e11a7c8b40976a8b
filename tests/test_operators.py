"""Operators on small tables: spots, joins, timetables, roads, pages and feeds."""

import math

import pytest
from pyspark.sql import functions as F

from outways.operators import entity, feeds, near, pages, roads, spots, timetable
from outways.plans.profiles import BANDS, MODES, for_months

SPOT = "id long, ord long, name string, facility_type string, category string, lat double, lon double, age_min int, age_max int, area_m2 int, playground string, toilet boolean, official_url string, dropin boolean, event_start string, event_end string, city string, outside boolean, hand boolean"


def spot(i, kind="図書館", lat=35.85, **more):
    base = dict(id=i, ord=i, name=f"s{i}", facility_type=kind, category=None, lat=lat, lon=139.9, age_min=None, age_max=None, area_m2=None, playground=None, toilet=None, official_url=None, dropin=None, event_start=None, event_end=None, city="c", outside=False, hand=False)
    return tuple((base | more).values())


def test_search_filters_and_order(spark):
    rows = spark.createDataFrame(
        [
            spot(1, lat=35.851), spot(2, lat=35.8505), spot(3, dropin=False), spot(4, "公園", 35.86), spot(5, "公園", 35.8501, area_m2=5), spot(6, age_min=50, age_max=90),
            spot(7, "イベント", event_start="2024-01-01"), spot(8, "イベント", event_start="2024-01-01", event_end="2024-07-01", lat=35.8505), spot(9, lat=36.5),
        ], SPOT,
    )
    found = spots.search(rows, 35.85, 139.9, 2.0, months=24, on="2024-06-15").collect()
    assert [r["id"] for r in found] == [5, 2, 8, 1]
    one = spots.search_summary(rows, 35.85, 139.9, 2.0, months=24, on="2024-06-15").collect()[0]
    assert (one["total"], one["skipped_parks"]) == (4, 1)


def test_wider_radius_holds_the_narrower(spark):
    rows = spark.createDataFrame([spot(i, lat=35.85 + i * 0.001) for i in range(40)], SPOT)
    near_ids, far_ids = ({r["id"] for r in spots.search(rows, 35.85, 139.9, km).collect()} for km in (1.0, 3.0))
    assert near_ids < far_ids


def test_picks_take_turns(spark):
    rows = spark.createDataFrame([spot(1, "公園", area_m2=20000), spot(2, "図書館"), spot(3, "図書館", 35.851), spot(4, "イベント"), spot(5, "おむつ替えのできるトイレ")], SPOT)
    assert [r["id"] for r in spots.picks(rows, 35.85, 139.9, limit=4).collect()] == [4, 2, 1, 3]


def test_empty_tables(spark):
    none = spark.createDataFrame([], SPOT)
    assert spots.search(none, 35.0, 139.0).count() == 0
    assert spots.coverage(none).collect()[0]["spots"] == 0
    assert spots.picks(none, 35.0, 139.0).count() == 0


def test_park_size_prefers_text_then_polygon_then_name(spark):
    square = [(139.9, 35.85), (139.902, 35.85), (139.902, 35.852), (139.9, 35.852)]
    polygons = spark.createDataFrame([(1, "a", square, 500.0, 35.851, 139.901), (2, "d", [(140.0, 36.0), (140.001, 36.0), (140.0, 36.001)], 70.0, 35.9, 139.95)], "poly int, pkey string, ring array<struct<lon double, lat double>>, area double, plat double, plon double")
    parks = spark.createDataFrame(
        [(1, "a", 35.851, 139.901, "約1.5ヘクタール"), (5, "a", 35.8512, 139.9012, "about 9 ヘクタール"), (2, "b", 35.8511, 139.9011, None), (3, "d", 35.9001, 139.9501, ""), (4, "e", 30.0, 130.0, "")],
        "id int, key string, lat double, lon double, page_text string",
    )
    got = {r["id"]: (r["area_m2"], r["how"]) for r in spots.park_sizes(parks, polygons).collect()}
    # Several parks lie in the polygon around 1, 2 and 5: it sizes those of its name.
    assert got == {1: (15000.0, "text"), 5: (500.0, "polygon"), 2: (None, None), 3: (70.0, "name"), 4: (None, None)}


def test_details_overlay(spark):
    rows = spark.createDataFrame([spot(1), spot(2), spot(3, toilet=True)], SPOT).withColumn("key", F.col("name"))
    details = spark.createDataFrame([("s1", 1, 35.85, 139.9, True, None, None), ("s3", 2, None, None, False, False, "u"), ("s2", 3, 36.9, 139.9, True, None, None)], "key string, d_ord int, d_lat double, d_lon double, closed boolean, d_toilet boolean, d_url string")
    got = {r["id"]: (r["toilet"], r["official_url"]) for r in spots.with_details(rows, details).collect()}
    assert got == {2: (None, None), 3: (True, "u")}


def test_grid_join_matches_all_pairs(spark):
    import random

    from outways.operators.entity import _metres

    rnd = random.Random(5)
    a = [(i, 35.8 + rnd.random() / 50, 139.8 + rnd.random() / 50) for i in range(60)]
    b = [(i, 35.8 + rnd.random() / 50, 139.8 + rnd.random() / 50) for i in range(60)]
    left, right = spark.createDataFrame(a, "l long, lat double, lon double"), spark.createDataFrame(b, "r long, lat double, lon double")
    got = {(x["l"], x["r"]) for x in near.within_metres(left, right, 250).collect()}
    assert got == {(i, j) for i, y, x in a for j, v, u in b if _metres(y, x, v, u) <= 250}


def test_nearest_is_strict_and_breaks_ties_by_key(spark):
    left = spark.createDataFrame([(1, 35.0, 139.0)], "l long, lat double, lon double")
    right = spark.createDataFrame([(9, 35.0001, 139.0), (3, 35.0001, 139.0)], "r long, lat double, lon double")
    assert near.nearest(left, right, 25, "l", "r").collect()[0]["r"] == 3
    limit = left.join(right.filter("r = 3").select(F.col("lat").alias("y"), F.col("lon").alias("x"))).select(near.geo.haversine(F.col("lat"), F.col("lon"), F.col("y"), F.col("x")).alias("m")).collect()[0]["m"]
    assert near.nearest(left, right, limit, "l", "r").count() == 0


def test_copies_at_a_spot_are_met_once(spark):
    at = ["CAST(35 + (id % 3) * 0.001 AS DOUBLE) AS lat", "CAST(139 AS DOUBLE) AS lon"]
    left, right = spark.range(300).selectExpr("id AS l", *at), spark.range(600).selectExpr("id AS r", *at)
    assert near._spot_pairs(left, right, 120.0, True, None).count() == 7
    assert near.within_metres(left, right, 120.0).count() == 7 * 100 * 200
    first = near.nearest(left, right, 120.0, "l", "r").collect()
    assert len(first) == 300 and all(x["r"] == x["l"] % 3 and x["metres"] == 0 for x in first)
    some = near.nearest(left, right, 120.0, "l", "r", 4).collect()
    assert len(some) == 1200 and all(x["r"] == x["l"] % 3 + 3 * (x["rank"] - 1) for x in some)
    # A key at two spots has the nearest of both.
    twice = spark.createDataFrame([(1, 35.0, 139.0), (1, 35.002, 139.0)], "l int, lat double, lon double")
    assert [(x["r"], x["rank"]) for x in near.nearest(twice, right.filter("r > 3"), 50.0, "l", "r", 2).orderBy("rank").collect()] == [(5, 1), (6, 2)]


def test_clusters_stay_near_their_first_stop(spark):
    stops = spark.createDataFrame([("a", "N", 35.0, 139.0, 1), ("b", "N", 35.0004, 139.0, 2), ("c", "N", 35.0008, 139.0, 3), ("d", "M", 35.0, 139.0, 4)], "stop_id string, name string, lat double, lon double, ord int")
    got = {r["stop_id"]: r["place_id"] for r in entity.place_clusters(stops).collect()}
    assert got == {"a": "N", "b": "N", "c": "N#1", "d": "M"}


def test_candidates_rank_hint_over_official_over_size(spark):
    rows = [("k", 35.0, 139.0, "gtfs", 1), ("k", 35.5, 139.0, "osm:B", 2), ("k", 35.5, 139.0001, "osm:B", 3), ("k", 36.0, 139.0, "osm:A bus", 4)]
    points = spark.createDataFrame(rows, "key string, lat double, lon double, source string, ord int")
    got = entity.coordinate_candidates(points, "A").orderBy("rank").collect()
    assert [(r["lat"], r["source"], r["n"]) for r in got] == [(36.0, "osm", 1), (35.0, "gtfs", 1), (35.5, "osm", 2)]


def test_merge_takes_open_coordinates_and_the_better_kind(spark):
    rows = [(1, 1, "k", "トイレ前", "おむつ替えのできるトイレ", 35.0, 139.0, 5, True, False, 0, 10), (2, 2, "k", "児童館K", "児童館・児童センター", 35.001, 139.0, 1, False, True, 5, 20), (3, 3, "k", "far", "公園", 36.0, 139.0, 0, False, False, 0, 1), (4, 4, "", "x", "公園", 35.0, 139.0, 0, False, False, 0, 1)]
    got = {r["id"]: r for r in entity.merged_spots(spark.createDataFrame(rows, "id long, ord int, key string, name string, facility_type string, lat double, lon double, richness int, hand boolean, toilet boolean, age_min int, age_max int")).collect()}
    assert set(got) == {1, 3, 4}
    one = got[1]
    assert (one["name"], one["facility_type"], one["lat"], one["toilet"], one["age_max"], one["also_types"], one["also_in"]) == ("児童館K", "児童館・児童センター", 35.001, True, 20, ["おむつ替えのできるトイレ"], [2])


def test_merge_of_many_of_one_name_equals_plain_order(spark):
    import random

    pick, rank = random.Random(3), {k: i for i, k in enumerate(entity.KIND_PRIORITY)}
    rows = [(i, i, "k", f"n{i}", pick.choice(["公園", "図書館", None, "イベント"]), 35 + pick.randrange(60) * 0.0028, 139 + pick.randrange(60) * 0.0028, pick.randrange(3), pick.random() < 0.3, False, 0, 9) for i in range(1500)]
    frame = spark.createDataFrame(rows, "id int, ord int, key string, name string, facility_type string, lat double, lon double, richness int, hand boolean, toilet boolean, age_min int, age_max int")
    reach, kept = lambda k: 0.004 if k in ("公園", "イベント") else 0.014, []
    for i, _, _, _, kind, lat, lon, _, hand, *_ in sorted(rows, key=lambda r: (-r[7], r[1])):
        into = next((k for k in kept if math.hypot(k[1] - lat, k[2] - lon) < max(reach(k[0]), reach(kind))), None)
        if into is None:
            kept.append([kind, lat, lon, hand, i, []])
            continue
        if into[3] and not hand:
            into[1:3] = lat, lon
        kinds = [k for k in (into[0], kind) if k]
        into[0] = min(kinds, key=lambda k: rank[k]) if kinds else None
        into[5].append(i)
    got = {r["id"]: (r["facility_type"], r["lat"], r["lon"], r["also_in"]) for r in entity.merged_spots(frame).collect()}
    assert len(kept) > 64 and got == {k[4]: (k[0], k[1], k[2], k[5]) for k in kept}


def test_copies_of_spots_and_pages_have_one_page(spark):
    from outways.operators import details

    named = spark.createDataFrame([(i, ["A", "B", "C"][i % 3], 35.0, 139.0) for i in range(60)] + [(90, "A", None, None)], "id int, name string, lat double, lon double")
    pages = spark.createDataFrame([(100 + i, "A", 35.01, 139.0, 1) for i in range(30)] + [(200 + i, "A", None, None, 0 if i else 2) for i in range(9)] + [(300 + i, "big C house", 35.001, 139.0, 5) for i in range(20)], "page int, title string, lat double, lon double, rank int")
    got = {r["id"]: r["page"] for r in details.matched_pages(named, pages).collect()}
    assert got == {i: 201 if i % 3 == 0 else 300 for i in range(60) if i % 3 != 1} | {90: 201}


def test_exceptions_decide_over_the_calendar(spark):
    cal = spark.createDataFrame([("f", "s", 1, 1, 1, 1, 1, 0, 0, "20240101", "")], "feed_id string, service_id string, mon int, tue int, wed int, thu int, fri int, sat int, sun int, start_date string, end_date string")
    exc = spark.createDataFrame([("f", "s", "20240612", 1, 1), ("f", "s", "20240612", 2, 2), ("f", "x", "20240615", 1, 1)], "feed_id string, service_id string, date string, exception_type int, ord int")
    days = spark.createDataFrame([("20240612",), ("20240613",), ("20240615",), ("20231213",)], "day string")
    got = {(r["service_id"], r["day"]) for r in timetable.services_on(cal, exc, days).filter("runs").collect()}
    assert got == {("s", "20240613"), ("x", "20240615")}


@pytest.fixture(scope="module")
def small_timetable(spark):
    stops = [("f", t, s, p, None, d) for t, times in {1: [("A", 100), ("B", 200), ("C", 300)], 2: [("B", 250), ("D", 400)], 3: [("A", 50), ("D", 60)]}.items() for s, (p, d) in enumerate(times)]
    stop_times = spark.createDataFrame(stops, "feed_id string, trip_id long, seq int, place_id string, arr int, dep int")
    trips = spark.createDataFrame([("f", 1, "r1", "s", ""), ("f", 2, "r2", "s", "2"), ("f", 3, "r3", "s", "")], "feed_id string, trip_id long, route_id string, service_id string, wheelchair string")
    transfers = spark.createDataFrame([("C", "E", 120), ("E", "C", 120)], "a string, b string, seconds int")
    return stop_times, timetable.departures(stop_times, trips), transfers


def test_rounds(spark, small_timetable):
    stop_times, departing, transfers = small_timetable
    access = spark.createDataFrame([("A", 0)], "place_id string, seconds int")
    got = {r["place_id"]: (r["t"], r["round"]) for r in timetable.reachable_places(access, 90, stop_times, departing, transfers).collect()}
    assert got == {"A": (90, 0), "B": (200, 1), "C": (300, 1), "D": (400, 2), "E": (420, 2)}
    tight = timetable.reachable_places(access, 90, stop_times, departing, transfers, budget=250, stroller=True).collect()
    assert {r["place_id"] for r in tight} == {"A", "B", "C"}


def test_legs_lead_back_to_the_start(spark, small_timetable):
    stop_times, departing, transfers = small_timetable
    access = spark.createDataFrame([("A", 0)], "place_id string, seconds int")
    labels = timetable.search_labels(access, 90, stop_times, departing, transfers)
    egress = spark.createDataFrame([("D", 30), ("A", 0)], "place_id string, seconds int")
    got = timetable.signatures(timetable.itineraries(labels, egress)).collect()
    assert [(r["arrive"], r["signature"], [leg["to_place"] for leg in r["legs"]]) for r in got] == [(430, "1>2", ["B", "D"])]


EDGE = "a long, b long, length double, highway string, attrs map<string,string>, walk int, bike int, car int, lev_diff string, width_code string, vtcl_slope string, roof string, to_tags map<string,string>"


def cost(spark, profile, mode="walk", **edge):
    base = dict(a=1, b=2, length=100.0, highway="residential", attrs={}, walk=1, bike=1, car=1, lev_diff=None, width_code=None, vtcl_slope=None, roof=None, to_tags={})
    row = spark.createDataFrame([tuple((base | edge).values())], EDGE).select(roads.edge_seconds(profile, mode).alias("s")).collect()[0]["s"]
    return None if row is None else pytest.approx(row, rel=1e-9)


def test_edge_costs(spark):
    walk, stroller = MODES["walk"], MODES["stroller"]
    assert cost(spark, walk) == 75.0
    flat = 100 / 70 * 60
    assert cost(spark, stroller) == flat
    assert cost(spark, stroller, lev_diff="5") == flat * 8
    assert cost(spark, stroller, highway="steps") is None
    assert cost(spark, walk, highway="steps") == 90.0
    assert cost(spark, BANDS[0], highway="steps") == 100 / 65 * 60 * 4.5
    assert cost(spark, BANDS[0], highway="steps", attrs={"handrail": "yes"}) == 100 / 65 * 60 * 3
    assert cost(spark, walk, walk=0) is None
    assert cost(spark, walk, highway="primary", attrs={"sidewalk": "both"}) == 75.0
    assert cost(spark, walk, highway="primary") == 105.0
    assert cost(spark, stroller, to_tags={"kerb": "raised"}) == flat * 1.8
    assert cost(spark, stroller, attrs={"width": "1.2m"}) == flat * 1.8
    assert cost(spark, stroller, attrs={"width": "wide"}) == flat
    assert cost(spark, MODES["bike"], "bike", highway="footway") == 100 / 220 * 60 * 1.6
    assert cost(spark, walk, "car", highway="motorway") == 100 / 1300 * 60


def test_bands():
    assert [for_months(m).id for m in (-5, 0, 23, 24, 60, 100, 400, -50)] == ["prenatal", "baby", "baby", "toddler", "preschool", "school", "school", "prenatal"]


def test_shortest_matches_dijkstra(spark):
    import heapq
    import random

    rnd = random.Random(2)
    arcs = [(rnd.randrange(40), rnd.randrange(40), float(rnd.randrange(1, 30))) for _ in range(160)]
    dist, queue = {}, [(0, 0)]
    while queue:
        d, u = heapq.heappop(queue)
        if u not in dist:
            dist[u] = d
            for a, b, c in arcs:
                if a == u:
                    heapq.heappush(queue, (d + c, b))
    frame = spark.createDataFrame(arcs, "a long, b long, cost double")
    source = spark.createDataFrame([(0, 0.0)], "node long, cost double")
    assert {r["node"]: r["cost"] for r in roads.shortest(frame, source).collect()} == dist
    some = {r["node"]: r["cost"] for r in roads.shortest(frame, source, 25).collect()}
    assert some == {n: d for n, d in dist.items() if d <= 25}


def test_one_way_reverse_keeps_walkers(spark):
    edges = spark.createDataFrame([(1, 2, 1, 1, 1, 1)], "a long, b long, walk int, bike int, car int, oneway int")
    assert {tuple(r) for r in roads.both_ways(edges).collect()} == {(1, 2, 1, 1, 1, 1), (2, 1, 1, 1, 0, 1)}


def test_holes_are_filled_and_bays_are_not(spark):
    ring = [("r", y, x) for y in range(5) for x in range(5) if (y in (0, 4) or x in (0, 4))]
    bay = [("b", y, x) for _, y, x in ring if (y, x) != (0, 2)]
    got = roads.filled(spark.createDataFrame(ring + bay, "mode string, y long, x long")).groupBy("mode").count().collect()
    assert {r["mode"]: r["count"] for r in got} == {"r": 25, "b": 15}


def test_page_fields_and_links(spark):
    html = '<h1>A &amp; B</h1><dl><dt>所在地</dt><dd>x<br>y</dd><dt>所在地</dt><dd>z</dd></dl><table><tr><th>時間</th><td>9時</td></tr><tr><td>a</td><td>b</td><td>c</td></tr></table><a class="k" href="/p">in</a><a href="https://o.example/?url=https%3A%2F%2Fq.example">out</a>'
    frame = spark.createDataFrame([(1, html), (2, None)], "page_id long, html string")
    rows = {r["page_id"]: r for r in frame.select("page_id", pages.title(F.col("html")).alias("t"), pages.fields(F.col("html")).alias("f")).collect()}
    assert rows[1]["t"] == "A & B" and rows[1]["f"] == {"所在地": "x\ny", "時間": "9時"}
    links = pages.links(frame)
    assert [(r["ord"], r["href"], r["label"]) for r in links.orderBy("ord").collect()][0] == (0, "/p", "in")
    assert pages.official_link(links, "city.example").collect()[0]["href"] == "https://q.example"


def test_hours_and_toys(spark):
    row = spark.range(1).select(pages.opening_hours(F.lit("午前9時30分から午後5時まで")).alias("h"), pages.opening_hours(F.lit("午前9時")).alias("n"), pages.toys(F.lit("滑り台、ブランコ・すべり台、なし")).alias("t")).collect()[0]
    assert tuple(row["h"]) == ("09:30", "17:00") and row["n"] is None and row["t"] == ["すべり台", "ブランコ"]


def test_crawl_waves(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("b", "skip/x")], "src string, dst string")
    start = spark.createDataFrame([("a",)], "url string")
    assert {r["url"]: r["wave"] for r in pages.crawl(links, start, skip="^skip").collect()} == {"a": 0, "b": 1, "c": 2}
    assert pages.crawl(links, start, max_pages=2).count() == 2


@pytest.mark.parametrize(("local", "remote", "newer", "same", "said"), [(None, 5, True, None, feeds.MISSING), (5, 6, False, None, feeds.CHANGED), (5, 5, False, None, feeds.CURRENT), (5, None, True, None, feeds.CHECK), (5, 5, True, True, feeds.RESENT), (5, 5, True, False, feeds.CHANGED)])
def test_verdict(spark, local, remote, newer, same, said):
    col = lambda v, t: F.lit(v).cast(t)
    assert spark.range(1).select(feeds.verdict(col(local, "long"), col(remote, "long"), col(newer, "boolean"), col(same, "boolean")).alias("v")).collect()[0]["v"] == said


def test_forecast_and_advice(spark):
    body = '[{"timeSeries":[{"areas":[{"weathers":["雨"]}]},{"areas":[{"pops":["10","60"]}]},{"areas":[{"temps":["x","31","35"]}]}]}]'
    fc = spark.range(1).select(feeds.forecast(F.lit(body)).alias("f"))
    row = fc.select("f", feeds.advice(F.lit(False), F.col("f.weather"), F.col("f.pops"), F.col("f.temp_max")).alias("a"), feeds.advice(F.lit(True), F.col("f.weather"), F.col("f.pops"), F.col("f.temp_max")).alias("b")).collect()[0]
    assert row["f"]["temp_max"] == 35
    assert [n["level"] for n in row["a"]] == ["warn", "warn"] and row["a"][0]["text"].startswith("今日の天気は「雨」です") and row["a"][1]["text"].startswith("最高気温35℃の猛暑日")
    assert [(n["level"], n["text"]) for n in row["b"]] == [("info", "屋内なので、雨の日でも過ごせます")]
    told = lambda *a: spark.range(1).select(feeds.advice(*[F.lit(x) if not isinstance(x, list) else F.array(*map(F.lit, x)).cast("array<string>") for x in a]).alias("a")).first()["a"]
    assert [n["level"] for n in told(False, "晴れ", ["10", "x", "50"], 31)] == ["warn", "info"] and "降水確率が50%" in told(False, "晴れ", ["50"], 3)[0]["text"]
    assert told(False, "晴れ", ["40"], 30) == [] and told(None, "晴れ", ["90"], 40) == [] and told(False, "くもり", [], 2) == []
