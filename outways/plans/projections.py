"""Projections of star-schema tables onto the domain's tables.

Each is a list of select expressions in SQL that Spark and DuckDB read alike, so that a query and
its counterpart start from the same rows. Keys become coordinates around (35.85, 139.90).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

HOME_LAT, HOME_LON = 35.85, 139.9
DAY = "2024-06-15"


def lat(k: str) -> str:
    return f"CAST(35.8 AS DOUBLE) + CAST(({k} * 7919) % 1000 AS DOUBLE) / CAST(10000 AS DOUBLE)"


def lon(k: str) -> str:
    return f"CAST(139.85 AS DOUBLE) + CAST(({k} * 104729) % 1000 AS DOUBLE) / CAST(10000 AS DOUBLE)"


def _text(x: str) -> str:
    return f"CAST({x} AS STRING)"


INSIDE = [
    "p_partkey AS id", "p_partkey AS ord", "p_name AS name",
    "CASE p_type WHEN 'ECONOMY' THEN '公園' WHEN 'LARGE' THEN '図書館' WHEN 'MEDIUM' THEN '児童館・児童センター' WHEN 'SMALL' THEN '子育てひろば' WHEN 'PROMO' THEN 'イベント' ELSE 'おむつ替えのできるトイレ' END AS facility_type",
    "CAST(NULL AS STRING) AS category", f"{lat('p_partkey')} AS lat", f"{lon('p_partkey')} AS lon",
    "CASE WHEN p_partkey % 13 <> 0 THEN (p_size % 5) * 12 END AS age_min", "CASE WHEN p_partkey % 13 <> 0 THEN (p_size % 5) * 12 + (p_size % 7) * 24 END AS age_max",
    "p_size * 250 AS area_m2", "repeat('a・', CAST(p_partkey % 6 AS INT)) AS playground", "(p_partkey % 3 = 0) AS toilet",
    f"CASE WHEN p_partkey % 11 <> 0 THEN 'https://city.example/' || {_text('p_partkey')} END AS official_url",
    "CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE p_partkey % 19 <> 0 END AS dropin",
    f"CASE WHEN p_type = 'PROMO' THEN '2024-' || lpad({_text('1 + p_partkey % 12')}, 2, '0') || '-' || lpad({_text('1 + p_partkey % 28')}, 2, '0') END AS event_start",
    f"CASE WHEN p_type = 'PROMO' AND p_partkey % 2 = 0 THEN '2024-' || lpad({_text('1 + p_partkey % 12')}, 2, '0') || '-28' END AS event_end",
    "p_brand AS city", "(p_partkey < 0) AS outside", "(p_partkey % 7 = 0) AS hand",
]
OUTSIDE = [
    "1000000000 + c_custkey AS id", "1000000000 + c_custkey AS ord", "c_name AS name",
    "CASE c_mktsegment WHEN 'BUILDING' THEN '公民館' WHEN 'AUTOMOBILE' THEN '公園' WHEN 'FURNITURE' THEN '図書館' WHEN 'HOUSEHOLD' THEN '子育て支援センター' ELSE '子ども家庭支援センター' END AS facility_type",
    "CAST(NULL AS STRING) AS category", f"{lat('c_custkey + 13')} AS lat", f"{lon('c_custkey + 29')} AS lon",
    "0 AS age_min", "155 AS age_max", "CAST((c_custkey % 40) * 500 AS INT) AS area_m2", "CAST(NULL AS STRING) AS playground", "CAST(NULL AS BOOLEAN) AS toilet",
    "CASE WHEN c_custkey % 4 <> 0 THEN 'https://out.example' ELSE ' ' END AS official_url", "(c_custkey >= 0) AS dropin", "CAST(NULL AS STRING) AS event_start",
    "CAST(NULL AS STRING) AS event_end", "c_mktsegment AS city", "(c_custkey >= 0) AS outside", "(c_custkey % 5 = 0) AS hand",
]
#: Neighbouring ids are some 180 metres apart, so that there are walks between places.
PLACES = [
    "s_suppkey AS place_id", f"{lat('(s_suppkey - s_suppkey % 2) * 7')} AS lat",
    f"{lon('(s_suppkey - s_suppkey % 2) * 11')} + CAST(s_suppkey % 2 AS DOUBLE) * CAST(0.002 AS DOUBLE) AS lon", "s_nationkey AS nation",
]
STOPS = ["s_suppkey AS stop_id", "s_suppkey AS ord", f"'N' || {_text('s_nationkey')} AS name", f"{lat('s_suppkey % 40')} AS lat", f"{lon('s_suppkey % 40')} AS lon"]
POINTS = ["c_custkey AS point_id", f"{lat('c_custkey')} AS lat", f"{lon('c_custkey')} AS lon"]
TRIPS = [
    "'f' AS feed_id", "o_orderkey AS trip_id", "o_custkey % 40 AS route_id", "o_orderstatus AS service_id",
    "CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN '1' WHEN '2' THEN '2' ELSE '' END AS wheelchair",
]
ROUTES = ["'f' || CAST(c_nationkey % 3 AS STRING) AS feed_id", "c_custkey AS route_id", "CASE c_mktsegment WHEN 'BUILDING' THEN 3 WHEN 'MACHINERY' THEN 3 WHEN 'FURNITURE' THEN 1 ELSE 2 END AS route_type"]
#: Over lineitem, grouped by order and line: neither is a key.
STOP_TIME_KEYS = ["l_orderkey", "l_linenumber"]
STOP_TIMES = [
    "'f' AS feed_id", "l_orderkey AS trip_id", "l_linenumber AS seq", "place_id", "CAST(NULL AS INT) AS arr",
    "CAST(21600 + (l_orderkey * 37) % 57600 + l_linenumber * 240 AS INT) AS dep",
]
EXCEPTIONS = ["'f' AS feed_id", "o_orderstatus AS service_id", "strftime_day AS date", "CASE WHEN o_orderstatus = 'F' THEN 2 ELSE 1 END AS exception_type"]
ATTRS = (
    "CASE WHEN k % 5 = 0 THEN 'surface=gravel;' ELSE '' END || CASE WHEN k % 7 = 0 THEN 'incline=8%;' ELSE '' END || CASE WHEN k % 11 = 0 THEN 'width=1.2m;' ELSE '' END"
    " || CASE WHEN k % 4 = 0 THEN 'covered=yes;' ELSE '' END || CASE WHEN k % 9 = 0 THEN 'handrail=yes;' ELSE '' END || CASE WHEN k % 3 = 0 THEN 'sidewalk=both;' ELSE '' END"
    " || CASE WHEN k % 8 = 0 THEN 'bicycle=yes;' ELSE '' END || CASE WHEN k % 45 = 0 THEN 'ramp=yes;' ELSE '' END"
)
#: Over distinct (a, b, k) of the road graph.
EDGES = [
    "a", "b", "k", "CAST(20 + k % 180 AS DOUBLE) AS length",
    "CASE k % 10 WHEN 0 THEN 'steps' WHEN 1 THEN 'cycleway' WHEN 2 THEN 'footway' WHEN 3 THEN 'primary' WHEN 4 THEN 'elevator' WHEN 5 THEN 'tertiary' ELSE 'residential' END AS highway",
    f"{ATTRS} AS packed", "CASE WHEN k % 23 = 0 THEN 0 ELSE 1 END AS walk", "CASE WHEN k % 6 = 0 THEN 0 ELSE 1 END AS bike", "CASE WHEN k % 3 = 0 THEN 0 ELSE 1 END AS car", "CASE WHEN k % 12 = 0 THEN 1 ELSE 0 END AS oneway",
    "CASE WHEN k % 13 < 6 THEN CAST(k % 13 AS STRING) END AS lev_diff", "CASE WHEN k % 17 = 0 THEN '1' END AS width_code", "CASE WHEN k % 19 < 9 THEN CAST(k % 19 AS STRING) END AS vtcl_slope", "CASE WHEN k % 29 = 0 THEN '2' END AS roof",
    "CASE WHEN b % 31 = 0 THEN 'raised' END AS kerb", "CASE WHEN b % 37 = 0 THEN 'gate' END AS barrier",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def inside(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(*INSIDE)


def outside(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr(*OUTSIDE)


def spots(spark, sf_dir) -> DataFrame:
    return inside(spark, sf_dir).unionByName(outside(spark, sf_dir))


def places(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "supplier").selectExpr(*PLACES)


def points(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr(*POINTS)


def trips(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(*TRIPS)


def stop_times(spark, sf_dir) -> DataFrame:
    grouped = table(spark, sf_dir, "lineitem").groupBy(*STOP_TIME_KEYS).agg({"l_suppkey": "min"}).withColumnRenamed("min(l_suppkey)", "place_id")
    return grouped.selectExpr(*STOP_TIMES)


def edges(spark, sf_dir) -> DataFrame:
    """The road graph: nodes are parts, an edge per order line; the modulus is the number of parts."""
    n = table(spark, sf_dir, "part").selectExpr("count(*) AS n")
    raw = table(spark, sf_dir, "lineitem").selectExpr("l_partkey AS a", "l_partkey * 31 + l_linenumber * 97 AS t", "l_partkey * 7 + l_linenumber AS k")
    return raw.crossJoin(n).selectExpr("a", "t % n AS b", "k").distinct().filter("a <> b").selectExpr(*EDGES)


def nodes(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr("p_partkey AS node", f"{lat('p_partkey')} AS lat", f"{lon('p_partkey')} AS lon")


def _cte(name: str, exprs: list[str], source: str) -> str:
    return f"{name} AS (SELECT {', '.join(exprs)} FROM {source})"


#: The same for DuckDB, by name.
CTES = {
    "inside": _cte("inside", INSIDE, "part"),
    "outside": _cte("outside", OUTSIDE, "customer"),
    "spots": f"{_cte('inside_spots', INSIDE, 'part')}, {_cte('outside_spots', OUTSIDE, 'customer')}, spots AS (SELECT * FROM inside_spots UNION ALL SELECT * FROM outside_spots)",
    "places": _cte("places", PLACES, "supplier"),
    "stops": _cte("stops", STOPS, "supplier"),
    "points": _cte("points", POINTS, "customer"),
    "trips": _cte("trips", TRIPS, "orders"),
    "routes": _cte("routes", ROUTES, "customer"),
    "stop_times": "line_stops AS (SELECT l_orderkey, l_linenumber, min(l_suppkey) AS place_id FROM lineitem GROUP BY ALL), " + _cte("stop_times", STOP_TIMES, "line_stops"),
    "edges": "raw_edges AS (SELECT DISTINCT l_partkey AS a, (l_partkey * 31 + l_linenumber * 97) % (SELECT count(*) FROM part) AS b, l_partkey * 7 + l_linenumber AS k FROM lineitem), "
    + _cte("edges", EDGES, "raw_edges WHERE a <> b"),
    "nodes": _cte("nodes", ["p_partkey AS node", f"{lat('p_partkey')} AS lat", f"{lon('p_partkey')} AS lon"], "part"),
}


def with_ctes(names: str, body: str, more: str = "") -> str:
    """DuckDB SQL: the named projections, further CTEs, and the body."""
    parts = [CTES[n] for n in names.split()] + ([more] if more else [])
    return f"WITH {', '.join(parts)} {body}"


def haversine_sql(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    p = "(pi() / 180)"
    return f"(2 * 6371000.0::DOUBLE * asin(sqrt(pow(sin(({lat2} - {lat1}) * {p} / 2), 2) + cos({lat1} * {p}) * cos({lat2} * {p}) * pow(sin(({lon2} - {lon1}) * {p} / 2), 2))))"
