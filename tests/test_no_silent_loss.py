"""Long paths, text ids, the poles, line breaks in quotes: nothing is cut or lost without notice."""

import math
import random

import pytest
from pyspark.sql import functions as F

from outways.operators import near, pages, roads, timetable
from outways.sources import files


def chain(spark, n):
    return spark.range(n).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"), F.lit(1.0).alias("cost"))


def test_paths_of_more_than_64_hops(spark):
    known = spark.range(81).select(F.col("id").alias("node"), F.when(F.col("id") > 0, F.col("id") - 1).alias("pred"))
    hops = roads.path_nodes(known, known.filter("node = 80"))
    assert sorted(r["hop"] for r in hops.collect()) == list(range(81))
    with pytest.raises(RuntimeError, match="hops"):
        roads.path_nodes(known, known.filter("node = 80"), max_hops=5)
    legs = known.filter("node > 0").select("node", F.col("node").cast("double").alias("metres"))
    sums = {r["node"]: (r["hops"], r["metres"]) for r in roads.path_sums(known, legs, ["metres"]).collect()}
    assert sums[80] == (80, sum(range(81))) and sums[0] == (0, 0.0) and len(sums) == 81


def test_costs_that_would_go_on_falling_raise(spark):
    start = spark.createDataFrame([(0, 0.0)], "node long, cost double")
    with pytest.raises(RuntimeError, match="rounds"):
        roads.shortest(chain(spark, 20), start, max_rounds=3)


def test_equal_ways_name_the_smaller_predecessor(spark):
    arcs = spark.createDataFrame([(0, 5, 1.0), (0, 3, 2.0), (5, 9, 2.0), (3, 9, 1.0)], "a long, b long, cost double")
    got = {r["node"]: r["pred"] for r in roads.shortest(arcs, spark.createDataFrame([(0, 0.0)], "node long, cost double")).collect()}
    assert got == {0: None, 5: 0, 3: 0, 9: 3}


def test_representative_trips_of_text_ids(spark):
    times = spark.createDataFrame([("f", t, i, "p") for t, n in (("t9", 3), ("t10", 3), ("x", 2), ("one", 1)) for i in range(n)], "feed_id string, trip_id string, seq int, place_id string")
    trips = spark.createDataFrame([("f", "t9", "r"), ("f", "t10", "r"), ("f", "x", "r"), ("f", "one", "q")], "feed_id string, trip_id string, route_id string")
    assert [(r["route_id"], r["trip_id"], r["stops"]) for r in timetable.representative_trips(times, trips).collect()] == [("r", "t10", 3)]


def haversine(a, b):
    p = math.pi / 180
    h = math.sin((b[0] - a[0]) * p / 2) ** 2 + math.cos(a[0] * p) * math.cos(b[0] * p) * math.sin((b[1] - a[1]) * p / 2) ** 2
    return 2 * 6371000 * math.asin(math.sqrt(h))


@pytest.mark.parametrize("metres", [700.0, 40_000.0])
def test_near_anywhere_equals_all_pairs(spark, metres):
    rnd = random.Random(5)
    reach = metres / 111_000
    points = []
    for lat, lon in [(85.0, 10.0), (-85.0, -170.0), (0.0, 179.999), (60.0, -179.999), (89.99, 0.0), (-89.999, 90.0), (35.85, 139.9), (66.0, 0.0), (72.0, 180.0)]:
        for _ in range(14):
            y = max(-90.0, min(90.0, lat + rnd.uniform(-1.5, 1.5) * reach))
            x = lon + rnd.uniform(-1.5, 1.5) * reach / max(0.001, math.cos(math.radians(y)))
            points.append((y, (x + 180) % 360 - 180))
    points += [(90.0, 5.0), (-90.0, 5.0), (0.0, 180.0), (0.0, -180.0)]
    frame = spark.createDataFrame([(i, *p) for i, p in enumerate(points)], "a int, lat double, lon double")
    found = {(r["a"], r["b"]) for r in near.within_metres(frame, frame.withColumnRenamed("a", "b"), metres).select("a", "b").collect()}
    want = {(i, j) for i, p in enumerate(points) for j, q in enumerate(points) if haversine(p, q) <= metres}
    assert {x for x in found ^ want if abs(haversine(points[x[0]], points[x[1]]) - metres) > 1e-6} == set()


def test_line_breaks_inside_quotes_stay(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes('id,note\r\n1,"two\nlines, ""said"""\r\n\r\n2,plain\r\n'.encode())
    rows = files.csv_bytes(spark, str(tmp_path / "a.csv"), "id int, note string").orderBy("id").collect()
    assert [(r["id"], r["note"]) for r in rows] == [(1, 'two\nlines, "said"'), (2, "plain")]


def test_character_references(spark):
    text = "&lt;b&gt; &#65;&#x3042;&#X1F600; &eacute;&hellip; &amp;lt; &unknown; &#38;amp; & &#0; &#9999999;"
    assert spark.range(1).select(pages.unescaped(F.lit(text)).alias("t")).first()["t"] == "<b> Aあ😀 é… &lt; &unknown; &amp; & &#0; &#9999999;"


def test_a_crawl_that_leads_on_raises(spark):
    links = chain(spark, 10).select(F.col("a").cast("string").alias("src"), F.col("b").cast("string").alias("dst"))
    start = spark.createDataFrame([("0",)], "url string")
    assert pages.crawl(links, start).count() == 11
    with pytest.raises(RuntimeError, match="waves"):
        pages.crawl(links, start, max_waves=3)
