"""Searches over many copies of a place, and roads with many arcs at a node."""

from pyspark.sql import functions as F

from outways.operators import journeys, roads, timetable


def _rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_arcs_of_a_node_share_rows(spark):
    hub = [(0, n, float(n)) for n in range(1, 151)] + [(0, 5, 99.0), (7, 8, 1.0), (8, 0, None)]
    arcs = spark.createDataFrame(hub, "a long, b long, cost double")
    listed = roads.listed(arcs)
    assert sorted(r[0] for r in listed.filter("a = 0").select(F.size("arcs")).collect()) == [22, 64, 64]
    assert (0, 5, 5.0) in _rows(roads.unlisted(listed)) and roads.unlisted(listed).count() == 151
    source = spark.createDataFrame([(0, 0.0)], "node long, cost double")
    for given in (arcs, listed):
        found = {r.node: (r.cost, r.pred) for r in roads.shortest(given, source).collect()}
        assert found[0] == (0.0, None) and found[8] == (8.0, 0) and len(found) == 151
    plain = roads.least_costs(listed, source, 100.0).select("node", "cost")
    assert _rows(plain) == [r for r in _rows(roads.shortest(arcs, source, 100.0).select("node", "cost"))]


def _town(spark):
    """Forty copies of places at each of three spots some 110 metres apart, and one far away with a line to them."""
    places = [(s * 100 + i, 35.0 + s * 0.001, 139.0) for s in range(3) for i in range(40)] + [(900, 36.0, 139.0), (901, 36.0, 139.0)]
    places = spark.createDataFrame(places, "place_id long, lat double, lon double")
    times = spark.createDataFrame([("f", 1, 1, 900, None, 1000), ("f", 1, 2, 7, None, 1300), ("f", 2, 1, 901, None, 1000), ("f", 2, 2, 203, None, 1300), ("f", 3, 1, 115, None, 1500), ("f", 3, 2, 901, None, 1700)], "feed_id string, trip_id long, seq int, place_id long, arr int, dep int")
    trips = spark.createDataFrame([("f", t, t, "") for t in (1, 2, 3)], "feed_id string, trip_id long, route_id long, wheelchair string")
    access = spark.createDataFrame([(900, 10), (901, 20)], "place_id long, seconds int")
    return places, times, timetable.departures(times, trips), access


def test_copies_of_a_place_meet_by_spot(spark):
    places, times, departing, access = _town(spark)
    pairs, spots = timetable.nearby_transfers(places), timetable.nearby_spots(places)
    # All of three spots lie near each other; the fourth is alone.
    assert spots[1].count() == 10 and spots[0].count() == 122 and pairs.count() == 120 * 119 + 2
    for budget in (None, 700):
        a, b = (timetable.reachable_places(access, 900, times, departing, t, budget=budget) for t in (pairs, spots))
        assert _rows(a) == _rows(b) and a.count() >= 100
    a, b = (timetable.search_labels(access, 900, times, departing, t) for t in (pairs, spots))
    assert _rows(a) == _rows(b) and a.filter("how = 'walk'").count() > 100
    starts = spark.createDataFrame([(0, 900, False, "normal"), (0, 950, False, "normal"), (1, 900, False, "normal")], "src int, start int, stroller boolean, tier string")
    of = access.withColumn("src", F.lit(0)).union(access.withColumn("src", F.lit(1)))
    a, b = (journeys.labels(starts, of, times, departing, t) for t in (pairs, spots))
    assert _rows(a) == _rows(b) and a.filter("how = 'walk'").count() > 200
