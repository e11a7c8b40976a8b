"""Readers on small literal files, and the freshness stream."""

from pyspark.sql import functions as F

from outways.sources import files, gtfs
from outways.streaming import freshness


def test_feed(spark, tmp_path):
    base = tmp_path / "f" / "sub"
    base.mkdir(parents=True)
    (base / "stops.txt").write_text("﻿stop_id,stop_name,stop_lat,stop_lon,location_type\nA,a,35.0,139.0,\nA,a2,35.1,139.0,0\nB,b,,139.0,0\n", encoding="utf-8")
    (base / "stop_times.txt").write_text("trip_id,stop_sequence,stop_id,arrival_time,departure_time\nt,1,A,25:00:00,25:01:00\nt,2,,x,\nt,3,Z,,bad\n")
    tables = gtfs.load_feeds(spark, {"f": str(tmp_path / "f"), "gone": str(tmp_path / "gone")})
    assert [tuple(r) for r in tables["stop"].select("feed_id", "stop_id", "stop_name", "lat", "location_type").collect()] == [("f", "A", "a2", 35.1, 0)]
    assert {(r["seq"], r["arr"], r["dep"]) for r in tables["stop_time"].collect()} == {(1, 90000, 90060), (3, None, None)}
    assert tables["calendar"].count() == 0
    gtfs.write_store(tables, str(tmp_path / "store"))
    assert spark.read.parquet(str(tmp_path / "store" / "stop")).count() == 1


def test_osm(spark, tmp_path):
    (tmp_path / "x.osm").write_text(
        '<osm><node id="1" lat="35.0" lon="139.0"/><node id="2" lat="35.001" lon="139.0"><tag k="kerb" v="raised"/></node><node id="3" lat="35.001" lon="139.0"/>'
        '<way id="9"><nd ref="1"/><nd ref="2"/><nd ref="3"/><tag k="highway" v="steps"/><tag k="oneway" v="yes"/></way><way id="8"><nd ref="1"/><nd ref="2"/></way></osm>'
    )
    path = str(tmp_path / "x.osm")
    edges = files.road_edges(files.osm_ways(spark, path), files.osm_nodes(spark, path)).collect()
    assert [(r["a"], r["b"], r["walk"], r["bike"], r["car"], r["oneway"]) for r in edges] == [(1, 2, 1, 0, 0, 1)]
    assert edges[0]["length"] == 111.19


def test_geojson(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"features":[{"properties":{"name":"x"},"geometry":{"type":"MultiPolygon","coordinates":[[[[0,0],[1,0],[1,1]]],[[[5,5],[6,5],[6,6]]]]}},{"properties":{"name":"y"},"geometry":{"type":"Polygon","coordinates":[[[0,0],[2,0],[2,2]],[[1,1],[1.1,1],[1.1,1.1]]]}}]}')
    rings = files.geojson_rings(spark, str(tmp_path / "r.json"), "struct<name:string>").select("properties.name", F.size("ring").alias("n")).collect()
    assert sorted((r["name"], r["n"]) for r in rings) == [("x", 3), ("x", 3), ("y", 3)]
    (tmp_path / "s.txt").write_text('\x1e{"id":1}\n{"id":2}\n')
    assert {r["id"] for r in files.geojson_sequence(spark, str(tmp_path / "s.txt"), "id int").collect()} == {1, 2}


def test_csv_bytes(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿id,name\n1,港\n".encode())
    assert [(r["id"], r["name"]) for r in files.csv_bytes(spark, str(tmp_path / "a.csv"), "id int, name string").collect()] == [(1, "港")]


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    line = '{"feed_id":"f","at":"2024-01-01T00:00:00Z","local_size":5,"remote_size":6,"remote_newer":true}\n'
    (tmp_path / "in" / "a.json").write_text(line + line)
    freshness.watch(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    assert [r["verdict"] for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["更新あり"]
