"""Column functions on literal rows."""

import math

import pytest
from pyspark.sql import functions as F

from outways.functions import clock, geo, names, places


def value(spark, column):
    return spark.range(1).select(column.alias("v")).collect()[0]["v"]


def line(*points):
    return F.array(*[F.struct(F.lit(float(x)).alias("lon"), F.lit(float(y)).alias("lat")) for x, y in points])


def test_haversine_of_a_degree(spark):
    assert value(spark, geo.haversine(35.0, 139.0, 36.0, 139.0)) == pytest.approx(6371000 * math.pi / 180, rel=1e-12)
    assert value(spark, geo.haversine(35.0, 139.0, 35.0, 139.0)) == 0


def test_in_ring_even_odd(spark):
    ring = line((0, 0), (2, 0), (2, 2), (1, 1), (0, 2))
    for lat, lon, inside in ((0.5, 1.0, True), (1.5, 1.0, False), (1.5, 0.2, True), (3.0, 1.0, False)):
        assert value(spark, geo.in_ring(F.lit(lat), F.lit(lon), ring)) is inside


def test_ring_area_is_closed_and_unsigned(spark):
    assert value(spark, geo.ring_area_m2(line((0, 0), (0, 2), (3, 2), (3, 0)), 1.0, 1.0)) == 6.0
    assert value(spark, geo.ring_area_m2(line((0, 0)), 1.0, 1.0)) == 0.0


def test_line_length_of_one_point_is_zero(spark):
    assert value(spark, geo.line_length_m(line((139, 35)))) == 0.0


def test_snap_clamps_to_the_segment(spark):
    feet = value(spark, geo.snapped(line((0, 0), (1, 0), (1, 0)), F.lit(0.5), F.lit(2.0)))
    assert [(f["lon"], f["lat"]) for f in feet] == [(1.0, 0.0), (1.0, 0.0)]


def test_best_pair_boards_before_it_alights(spark):
    arr = lambda *xs: F.array(*[F.lit(float(x)) for x in xs])
    # On a loop the nearest boarding segment is the last one; it can't be boarded before alighting.
    got = value(spark, geo.best_pair(arr(5, 9, 1), arr(9, 2, 9)))
    assert (got["total"], got["board"], got["alight"]) == (7.0, 0, 1)


def test_best_pair_makes_its_arrays_once(spark):
    # With 20,000 segments an array that is made again for every index would take hours.
    n = 20_000
    metres = F.transform(F.sequence(F.lit(0), F.col("id").cast("int")), lambda i: F.abs(i - n // 2).cast("double"))
    pair = geo.best_pair(metres, F.transform(F.sequence(F.lit(0), F.col("id").cast("int")), lambda i: F.abs(i - n // 4).cast("double")))
    import threading

    timer = threading.Timer(100, spark.sparkContext.cancelAllJobs)
    timer.start()
    got = spark.range(n, n + 1).select(pair.alias("p")).collect()[0]["p"]
    timer.cancel()
    assert (got["total"], got["board"], got["alight"]) == (n / 4, n // 4, n // 4)


@pytest.mark.parametrize(("text", "seconds"), [("25:10:05", 90605), ("9:00:00", 32400), ("9:00", None), ("a:b:c", None), ("", None), (None, None)])
def test_to_seconds(spark, text, seconds):
    assert value(spark, clock.to_seconds(F.lit(text).cast("string"))) == seconds


def test_clock_texts_and_rollover(spark):
    assert value(spark, clock.hhmm(F.lit(90605))) == "01:10"
    assert value(spark, clock.hhmmss(F.lit(90605))) == "25:10:05"
    assert value(spark, clock.rollover(F.array(F.lit(86000).cast("long"), F.lit(100).cast("long"), F.lit(50).cast("long")))) == [86000, 86500, 172850]


def test_lenient_int(spark):
    assert [value(spark, clock.lenient_int(F.lit(x).cast("string"), 7)) for x in ("3.9", "x", None)] == [3, 7, 7]


def test_name_keys(spark):
    assert value(spark, names.spot_name_key(F.lit("市立 西ケ丘公園（東側）Ａ・1"))) == "西ヶ丘公園A1"
    assert value(spark, names.stop_name_key(F.lit("霞ヶ関 (西口)ｱ･ﾄﾞ"))) == "霞ケ関ア・ド"
    assert value(spark, names.spot_name_key(F.lit(None).cast("string"))) == ""


def test_packed_map_keeps_later_equals_and_first_keys(spark):
    assert value(spark, names.packed_map(F.lit("a=1;b=2=3;c;a=4"))) == {"a": "1", "b": "2=3"}
    assert value(spark, names.packed_map(F.lit(None).cast("string"))) == {}


@pytest.mark.parametrize(
    ("name", "area", "playground", "toilet", "rank"),
    [
        ("x", 10000, None, None, "major"), ("x", 100, "a・b・c・d", True, "major"), ("中央近隣公園", 900, None, None, "minor"), ("中央近隣公園", 3000, None, None, "major"),
        ("x", 3000, None, None, "normal"), ("x", None, "a・b・c", None, "normal"), ("x", None, "a・b", True, "normal"), ("x", None, None, True, "unknown"), ("x", 1, "", False, "minor"),
    ],
)
def test_park_rank(spark, name, area, playground, toilet, rank):
    got = places.park_rank(F.lit(name), F.lit(area).cast("int"), F.lit(playground).cast("string"), F.lit(toilet).cast("boolean"))
    assert value(spark, got) == rank


def test_park_bands_include_their_limit(spark):
    worth = lambda rank, m: value(spark, places.worth_going(F.lit(rank).cast("string"), F.lit(m)))
    assert [worth("minor", 600), worth("minor", 601), worth("normal", 1500), worth("normal", 1501), worth("major", 9000), worth(None, 9000)] == [True, False, True, False, True, True]


def test_kinds(spark):
    kind = lambda name, poi, given: value(spark, places.facility_kind(F.lit(name), F.lit(poi).cast("string"), F.lit(given).cast("string")))
    assert kind("ひまわり", "1403a", "図書館") == "児童館・児童センター"
    assert kind("ひまわり公園", None, "-") == "公園"
    assert kind("ひまわり", None, "その他施設") == "その他施設"
    assert kind("ひまわり", None, None) is None
    assert [value(spark, places.is_dropin(F.lit(k).cast("string"))) for k in ("公園", "私立幼稚園", "なにか", None)] == [True, False, True, None]
