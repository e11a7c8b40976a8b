"""Queries on destinations, their pages, bus patterns and lines, registered beside those of ``queries``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outways.functions import labels, names, shapes
from outways.operators import barriers, buses, details, overlay, rails, spotbuild, timetable, walking
from outways.plans import projections as pr
from outways.plans import queries as q

D = "::DOUBLE"

# --- destinations ---------------------------------------------------------------------------------

#: Parts as rows of a curated list, customers as rows of a facility list.
CURATED = [
    "p_partkey AS ord", "p_name AS name", "CAST(35.8 + CAST(p_partkey % 100 AS DOUBLE) / 1000 AS STRING) AS lat", "CASE WHEN p_partkey % 17 <> 0 THEN '139.9' END AS lon",
    "CASE p_type WHEN 'ECONOMY' THEN '公園' WHEN 'LARGE' THEN '図書館' WHEN 'MEDIUM' THEN '市立児童館' WHEN 'SMALL' THEN '赤ちゃんの駅' WHEN 'PROMO' THEN '幼稚園' ELSE '' END AS category",
    "CASE WHEN p_partkey % 3 = 0 THEN ' 有 ' WHEN p_partkey % 3 = 1 THEN 'no' END AS fee_free", "CASE WHEN p_partkey % 11 = 0 THEN CAST(p_size AS STRING) END AS age_min", "CASE WHEN p_partkey % 13 = 0 THEN '120.7' END AS area_m2",
]


@q.query(
    f"WITH c AS (SELECT {', '.join(CURATED)} FROM part), k AS (SELECT *, nullif(trim(category), '') AS cat FROM c WHERE lon IS NOT NULL), "
    "t AS (SELECT *, CASE WHEN cat = '市立児童館' THEN '児童館・児童センター' WHEN cat IS NOT NULL THEN cat ELSE NULL END AS kind FROM k) "
    "SELECT 'hand:' || CAST(ord AS STRING) AS id, kind AS facility_type, CASE WHEN kind IS NULL THEN NULL ELSE kind <> '幼稚園' END AS dropin, "
    "CASE WHEN kind IS NULL THEN NULL WHEN kind = '幼稚園' THEN '入園・入会の手続きが要る施設です（見学は要問い合わせ）' ELSE '予約なしで、その日に行けます' END AS visit_note, "
    "coalesce(CAST(age_min AS INT), CASE WHEN kind = '赤ちゃんの駅' THEN -9 WHEN kind = '幼稚園' THEN 36 ELSE 0 END) AS age_min, CASE WHEN kind = '赤ちゃんの駅' THEN 35 WHEN kind = '幼稚園' THEN 71 ELSE 155 END AS age_max, "
    "CASE WHEN trim(fee_free) = '有' THEN true WHEN fee_free IS NOT NULL THEN false END AS fee_free, CAST(trunc(CAST(area_m2 AS DOUBLE)) AS INT) AS area_m2 FROM t"
)
def curated_spots(spark, sf_dir):
    """Destinations of a hand-kept list, with what its rows don't say."""
    rows = pr.table(spark, sf_dir, "part").selectExpr(*CURATED)
    return spotbuild.curated(rows, spotbuild.Source("hand")).select("id", "facility_type", "dropin", "visit_note", "age_min", "age_max", "fee_free", "area_m2")


@q.query(
    "SELECT p_partkey AS id, CASE p_type WHEN 'ECONOMY' THEN 'park' WHEN 'LARGE' THEN 'library' WHEN 'MEDIUM' THEN 'hiroba' WHEN 'SMALL' THEN 'nursing' WHEN 'PROMO' THEN 'event' ELSE 'other' END AS mark, "
    "CASE WHEN p_size < 10 THEN '産前（あと' || CAST(10 - p_size AS STRING) || 'か月）' ELSE CAST((p_size - 10) // 12 AS STRING) || '歳' || CAST((p_size - 10) % 12 AS STRING) || 'か月' END AS age, "
    "CASE p_size % 4 WHEN 0 THEN '公共交通オープンデータ基本ライセンス' WHEN 1 THEN 'CC BY 4.0' WHEN 2 THEN 'チャレンジ2026 限定ライセンス' ELSE '—' END AS license FROM part"
)
def marks_and_labels(spark, sf_dir):
    part = pr.table(spark, sf_dir, "part")
    kind = F.expr("CASE p_type WHEN 'ECONOMY' THEN 'ふれあい広場' WHEN 'LARGE' THEN '図書館' WHEN 'MEDIUM' THEN 'つどいの広場' WHEN 'SMALL' THEN '授乳室' WHEN 'PROMO' THEN 'イベント（公園）' ELSE '' END")
    license, publisher = F.expr("CASE p_size % 4 WHEN 0 THEN 'ODPT' WHEN 1 THEN 'CC BY 4.0' END"), F.expr("CASE p_size % 4 WHEN 2 THEN '東武バス' WHEN 3 THEN '-' END")
    return part.select(F.col("p_partkey").alias("id"), labels.mark_of(kind, F.lit(None).cast("string")).alias("mark"), labels.age_text(F.col("p_size") - 10).alias("age"), labels.license_of(license, publisher).alias("license"))


RAW_NAMES = "CASE p_partkey % 3 WHEN 0 THEN '流山市立' WHEN 1 THEN '県立 ' ELSE '' END || p_name || CASE p_partkey % 4 WHEN 0 THEN '（ケツ）' WHEN 1 THEN '・ケツＢ２' ELSE '　公園' END"


@q.query(
    f"SELECT p_partkey AS id, replace(replace(replace(replace(translate(replace(replace(raw, '　', ''), ' ', ''), 'ＢＡ２ケ（）', 'BA2ヶ()'), '流山市立', ''), '流山市', ''), '都立', ''), '県立', '') AS park_key, "
    f"trim(replace(replace(replace(translate(regexp_replace(translate(replace(replace(raw, '　', ''), ' ', ''), 'ＢＡ２（）', 'BA2()'), '[（(].*?[）)]', '', 'g'), 'ケツ', 'ヶッ'), '・', ''), '流山市立', ''), '流山市', '')) AS page_key FROM (SELECT p_partkey, {RAW_NAMES} AS raw FROM part)"
)
def name_keys(spark, sf_dir):
    raw = pr.table(spark, sf_dir, "part").selectExpr("p_partkey AS id", f"{RAW_NAMES} AS raw")
    return raw.select("id", names.park_name_key(F.col("raw")).alias("park_key"), names.page_name_key(F.col("raw")).alias("page_key"))


@q.query(
    "SELECT c_mktsegment AS city, count(*) AS n, CASE WHEN sum(h) > 0 THEN '隣の市区町村が自分のホームページで載せている行き先を 1 件ずつ当たったもの ' || CAST(sum(h) AS STRING) || ' 件' ELSE '' END || CASE WHEN sum(h) > 0 AND count(*) > sum(h) THEN '／' ELSE '' END || "
    "CASE WHEN count(*) > sum(h) THEN '区市町村をまたいで配られているデータセットから取ったもの ' || CAST(count(*) - sum(h) AS STRING) || ' 件' ELSE '' END AS note FROM (SELECT c_mktsegment, CAST(c_custkey % 7 = 0 AS INT) AS h FROM customer) GROUP BY 1"
)
def outside_cities(spark, sf_dir):
    """Destinations outside per city, and where they come from."""
    found = pr.table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("city"), (F.col("c_custkey") % 7 == 0).cast("int").alias("hand"))
    notes = found.groupBy("city").agg(F.sum("hand").alias("h"), F.count("*").alias("c")).select("city", labels.source_note(F.col("h"), F.col("c") - F.col("h")).alias("note"))
    return spotbuild.outside_report(found).join(notes, "city")


# --- pages of destinations --------------------------------------------------------------------------

CITY_PAGES = [
    "c_custkey AS page", "CASE c_custkey % 3 WHEN 0 THEN 'N' || CAST(c_custkey % 200 AS STRING) WHEN 1 THEN 'Hall' || CAST(c_custkey % 50 AS STRING) || '（N' || CAST(c_custkey % 170 AS STRING) || '）' ELSE 'Big N' || CAST(c_custkey % 90 AS STRING) || ' house' END AS title",
    f"CASE WHEN c_custkey % 5 <> 0 THEN {pr.lat('c_custkey % 300')} END AS lat", f"CASE WHEN c_custkey % 5 <> 0 THEN {pr.lon('c_custkey % 300')} END AS lon", "CAST(c_custkey % 4 AS INT) AS rank",
]
NAMED_SPOTS = ["p_partkey AS id", "'N' || CAST(p_partkey % 260 AS STRING) AS name", f"{pr.lat('p_partkey % 300')} AS lat", f"{pr.lon('p_partkey % 300')} AS lon"]
APART = f"sqrt(pow((s.lat - p.lat) * 111000{D}, 2) + pow((s.lon - p.lon) * 91000{D}, 2))"


@q.query(
    f"WITH p AS (SELECT {', '.join(CITY_PAGES)} FROM customer), s AS (SELECT {', '.join(NAMED_SPOTS)} FROM part), "
    "k AS (SELECT page, rank, lat, lon, regexp_replace(title, '（.*）', '') AS key FROM p UNION SELECT page, rank, lat, lon, regexp_extract(title, '（(.*)）', 1) FROM p WHERE title LIKE '%（%'), "
    "met AS (SELECT s.id, p.page, p.rank, p.lat AS p_lat, " + APART + " AS m FROM s JOIN k p ON p.key = s.name), "
    "held AS (SELECT s.id, p.page, p.rank FROM s ANTI JOIN met USING (id) JOIN p ON contains(replace(regexp_replace(p.title, '（.*）', ''), ' ', ''), s.name) WHERE p.lat IS NOT NULL AND " + APART + " < 300) "
    "SELECT id, arg_min(page, (rank, page)) AS page FROM (SELECT id, page, rank FROM met WHERE p_lat IS NULL OR m <= 1500 UNION ALL SELECT * FROM held) GROUP BY 1"
)
def matched_pages(spark, sf_dir):
    """The city page of each destination, by name and place."""
    pages = pr.table(spark, sf_dir, "customer").selectExpr(*CITY_PAGES)
    return details.matched_pages(pr.table(spark, sf_dir, "part").selectExpr(*NAMED_SPOTS), pages)


@q.query(
    "SELECT page, CASE WHEN k % 3 = 0 THEN '約' || CAST(1 + k % 8 AS STRING) || '.5ヘクタール' WHEN k % 3 = 1 THEN '約' || format('{:,}', 1000 + k % 5000) || '平方メートル' END AS area, "
    "CASE WHEN k % 4 < 2 THEN 'おおたか' || substr('ABCDEFGHI', CAST(k % 9 + 1 AS INT), 1) || '駅' END AS station, CASE WHEN k % 4 < 2 THEN CAST(1 + k % 20 AS INT) END AS walk_min, '9時 17時' AS hours, CASE WHEN k % 5 = 0 THEN 'おはなし会と、赤ちゃん向けのおはなし会があります' WHEN k % 5 = 1 THEN '子ども向けのおはなし会があります' END AS kids_program "
    "FROM (SELECT page_id AS page, page_id AS k FROM pages)"
)
def page_facts(spark, sf_dir):
    """Facts of pages' texts and fields."""
    text = "CASE WHEN k % 3 = 0 THEN '面積：約' || CAST(1 + k % 8 AS STRING) || '.50ヘクタール' WHEN k % 3 = 1 THEN '広い 面積: ' || CAST(1000 + k % 5000 AS STRING) || '㎡' ELSE '面積' END AS text"
    access = "CASE WHEN k % 4 < 2 THEN 'JR常磐線おおたか' || substr('ABCDEFGHI', CAST(k % 9 + 1 AS INT), 1) || '駅東口から徒歩' || CAST(1 + k % 20 AS STRING) || '分' END AS access"
    fields = "map('開館時間', '9時\n\n 17時', '電話', '0', CASE WHEN k % 5 < 2 THEN 'おはなし会' ELSE 'x' END, CASE WHEN k % 5 = 0 THEN '赤ちゃん 10時' ELSE '11時' END) AS fields"
    rows = pr.table(spark, sf_dir, "pages").selectExpr("page_id AS page", "page_id AS k").selectExpr("page", text, access, fields)
    return details.facts(rows).select("page", "area", "station", "walk_min", "hours", "kids_program")


# --- bus patterns and lines ------------------------------------------------------------------------

#: An order's lines as a pattern of stops, some of them far off.
VISITS = ["l_orderkey AS pattern", "l_linenumber AS i", "l_partkey AS stop", "CAST(35.8 AS DOUBLE) + CAST(l_linenumber AS DOUBLE) / 500 + CASE WHEN l_partkey % 9 = 0 THEN 0.05 ELSE 0.0 END AS lat", "CAST(139.9 AS DOUBLE) + CAST(l_partkey % 7 AS DOUBLE) / 1000 AS lon"]
VISITS_SQL = "visits AS (SELECT " + ", ".join(VISITS).replace("0.05", "0.05::DOUBLE").replace("0.0 END", "0.0::DOUBLE END") + " FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey FROM lineitem GROUP BY ALL))"


def visits(spark, sf_dir) -> DataFrame:
    once = pr.table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"))
    return once.selectExpr(*VISITS)


def _h(a: str, b: str) -> str:
    return pr.haversine_sql(f"{a}lat", f"{a}lon", f"{b}lat", f"{b}lon")


@q.query(
    f"WITH {VISITS_SQL}, around AS (SELECT *, lag(lat) OVER w AS p_lat, lag(lon) OVER w AS p_lon, lead(lat) OVER w AS n_lat, lead(lon) OVER w AS n_lon FROM visits WINDOW w AS (PARTITION BY pattern ORDER BY i)) "
    f"SELECT pattern, count(*) AS stops, CAST(count(*) FILTER (WHERE {_h('p_', '')} + {_h('', 'n_')} > greatest(1500{D}, {_h('p_', 'n_')} * 3)) AS BIGINT) AS spikes FROM around GROUP BY 1"
)
def pattern_spikes(spark, sf_dir):
    """Stops of a pattern that no bus would go round by."""
    return buses.spikes(visits(spark, sf_dir)).groupBy("pattern").agg(F.count("*").alias("stops"), F.count(F.when(F.col("spike"), 1)).alias("spikes"))


@q.query(
    f"WITH {VISITS_SQL}, hops AS (SELECT pattern, {_h('', 'n_')} AS m FROM (SELECT *, lead(lat) OVER w AS n_lat, lead(lon) OVER w AS n_lon FROM visits WINDOW w AS (PARTITION BY pattern ORDER BY i))) "
    "SELECT pattern, round(list_sort(list(m))[1 + len(list(m)) // 2], 3) AS hop_m FROM hops WHERE m IS NOT NULL GROUP BY 1"
)
def usual_hops(spark, sf_dir):
    return buses.usual_hops(visits(spark, sf_dir)).select("pattern", F.round("hop_m", 3).alias("hop_m"))


@q.query()
def repaired_stops(spark, sf_dir):
    """Stops moved or dropped along the patterns of each feed: the nations' customers' orders."""
    feeds = pr.table(spark, sf_dir, "orders").join(pr.table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("pattern"), F.col("c_nationkey").alias("feed_id"))
    rows = visits(spark, sf_dir).join(feeds, "pattern").select("feed_id", F.col("pattern").alias("p_ord"), "i", "stop", "lat", "lon", F.lit("osm").alias("source"))
    options = rows.select("stop").distinct().select("stop", F.lit(1).alias("rank"), F.lit(35.81).alias("lat"), (F.lit(139.9) + F.col("stop") % 7 / 1000).alias("lon"), F.lit("gtfs").alias("source")).filter("stop % 18 = 0")
    return buses.repaired(rows, options, q.cut).groupBy("feed_id", "outcome").agg(F.count("*").alias("stops"))


@q.query(
    f"WITH {VISITS_SQL}, located AS (SELECT DISTINCT l_partkey AS key, CAST(35.8 AS DOUBLE) + CAST(l_partkey % 100 AS DOUBLE) / 1000 AS lat FROM lineitem) SELECT DISTINCT pattern FROM visits JOIN located ON key = stop WHERE located.lat < 35.803"
)
def patterns_inside(spark, sf_dir):
    """Patterns with a stop inside an area."""
    located = pr.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("key")).distinct().select("key", (F.lit(35.8) + (F.col("key") % 100).cast("double") / 1000).alias("lat"))
    return buses.patterns_inside(visits(spark, sf_dir).select("pattern", F.col("stop").alias("key")), located, F.col("lat") < 35.803)


@q.query(
    "WITH mapped AS (SELECT 'N' || CAST(s_nationkey AS STRING) AS key, round(" + pr.lat("s_suppkey % 40") + ", 6) AS lat, round(" + pr.lon("s_suppkey % 40") + ", 6) AS lon FROM supplier) SELECT key, count(*) AS stops, min(lat) AS lat_min FROM (SELECT DISTINCT * FROM mapped) GROUP BY 1"
)
def mapped_stops(spark, sf_dir):
    """Distinct coordinates of stops under each name."""
    points = pr.table(spark, sf_dir, "supplier").selectExpr(*pr.STOPS).select(F.col("name").alias("stop_name"), "lat", "lon", F.lit(None).cast("string").alias("operator"), "ord")
    return buses.mapped_stops(points).select("key", F.size("stops").cast("long").alias("stops"), F.array_min(F.transform("stops", lambda s: s["lat"])).alias("lat_min"))


def _shape_points(spark, sf_dir) -> DataFrame:
    return visits(spark, sf_dir).select(F.lit("f").alias("feed_id"), F.col("pattern").alias("shape_id"), F.col("i").alias("seq"), "lat", "lon")


@q.query(f"WITH {VISITS_SQL} SELECT pattern AS shape_id, count(*) AS points, round(arg_min(lat, i), 6) AS first_lat, round(arg_max(lat, i), 6) AS last_lat FROM visits GROUP BY 1")
def trip_shapes(spark, sf_dir):
    shaped = overlay.trip_shapes(_shape_points(spark, sf_dir))
    return shaped.select("shape_id", F.size("line").cast("long").alias("points"), F.round(F.get("line", F.lit(0))["lat"], 6).alias("first_lat"), F.round(F.element_at("line", -1)["lat"], 6).alias("last_lat"))


@q.query()
def simplified_shapes(spark, sf_dir):
    """Shapes with fewer points."""
    shaped = overlay.trip_shapes(_shape_points(spark, sf_dir))
    return shaped.select("shape_id", F.size("line").alias("points"), F.size(shapes.simplified(F.col("line"), 0.001)).alias("kept"))


@q.query()
def rail_lines(spark, sf_dir):
    """Lines stitched from the tracks of each supplier's nation: an order's lines are a way between parts."""
    refs = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"])
    ways = pr.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_distinct(refs).alias("refs")).join(pr.table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    ways = ways.select(F.col("l_orderkey").alias("way"), F.col("l_orderkey").alias("ord"), "refs", F.create_map(F.lit("railway"), F.lit("rail"), F.lit("name"), F.concat(F.lit("L"), (F.col("o_custkey") % 97).cast("string"))).alias("tags"))
    return rails.rail_lines(ways, pr.nodes(spark, sf_dir), q.cut).select("name", "chain", F.size("line").alias("points"), "length_m")


def _overlay(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    times, trips = pr.stop_times(spark, sf_dir), pr.trips(spark, sf_dir)
    # Every third route's trips have a shape, one in three is a railway.
    trips = trips.withColumn("shape_id", F.when(F.col("route_id") % 3 == 0, F.col("trip_id")))
    routes = trips.select("feed_id", "route_id").distinct().select("feed_id", "route_id", F.when(F.col("route_id") % 3 == 1, 2).otherwise(3).alias("route_type"), F.lit("R").alias("name"), F.lit("O").alias("operator"))
    best = q.cut(timetable.representative_trips(times, trips))
    home = pr.places(spark, sf_dir).filter("place_id = 1")
    none = home.select(F.lit(1).alias("rail"), F.lit("X").alias("name"), F.lit("").alias("operator"), F.array(F.struct(F.lit(0.0).alias("lon"), F.lit(0.0).alias("lat")), F.struct(F.lit(0.1).alias("lon"), F.lit(0.0).alias("lat"))).alias("line"))
    lines = overlay.route_lines(best, times, pr.places(spark, sf_dir), routes, trips, overlay.trip_shapes(_shape_points(spark, sf_dir)), none)
    return lines, overlay.places_served(best, times, routes)


BEST = "best AS (SELECT route_id, trip_id, stops FROM (SELECT *, row_number() OVER (PARTITION BY route_id ORDER BY stops DESC, trip_id) AS r FROM (SELECT route_id, trip_id, count(*) AS stops FROM stop_times JOIN trips USING (feed_id, trip_id) GROUP BY ALL HAVING count(*) >= 2)) WHERE r = 1)"


@q.query(
    pr.with_ctes(
        "stop_times trips places",
        "SELECT route_id, CASE WHEN route_id % 3 = 1 THEN 'train' ELSE 'bus' END AS kind, CASE WHEN route_id % 3 = 0 THEN 'gtfs' ELSE 'stops' END AS shape, stops FROM best JOIN (SELECT trip_id, count(*) AS n FROM (SELECT *, lag(lat) OVER w AS pa, lag(lon) OVER w AS po FROM stop_times JOIN places USING (place_id) WINDOW w AS (PARTITION BY trip_id ORDER BY seq)) WHERE pa IS NULL OR pa <> lat OR po <> lon GROUP BY 1) USING (trip_id) WHERE route_id % 3 = 0 OR n >= 2",
        BEST,
    )
)
def overlay_lines(spark, sf_dir):
    """A line per route and where it comes from."""
    return _overlay(spark, sf_dir)[0].select("route_id", "kind", "shape", "stops")


@q.query(pr.with_ctes("stop_times trips", "SELECT place_id, max(CASE WHEN route_id % 3 = 1 THEN 'train' ELSE 'bus' END) AS kind FROM stop_times JOIN best USING (trip_id) GROUP BY 1", BEST))
def overlay_places(spark, sf_dir):
    return _overlay(spark, sf_dir)[1].select("place_id", "kind")


@q.query(
    "WITH a AS (SELECT s_suppkey AS k FROM supplier) SELECT k, round(CAST(4 AS DOUBLE) * (k % 10 + 1) * 0.01 * 0.01 * 111 * 111 * cos(radians(35.5)), 6) AS km2, 35.0 + 0.01 AS lat, round(139.0 + 0.01 * (k % 10 + 1), 6) AS lon FROM a".replace("0.01 * 0.01", f"0.01{D} * 0.01{D}").replace("35.0 + 0.01", f"35.0{D} + 0.01{D}").replace("139.0 + 0.01", f"139.0{D} + 0.01{D}").replace("radians(35.5)", f"radians(35.5{D})")
)
def stage_areas(spark, sf_dir):
    """Area and mean of the points of a ring per supplier."""
    w = (F.col("s_suppkey") % 10 + 1) * 0.02
    point = lambda lon, lat: F.struct(lon.alias("lon"), lat.alias("lat"))
    ring = F.array(point(F.lit(139.0), F.lit(35.0)), point(F.lit(139.0) + w, F.lit(35.0)), point(F.lit(139.0) + w, F.lit(35.02)), point(F.lit(139.0), F.lit(35.02)))
    rows = pr.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), ring.alias("ring"))
    mean = shapes.vertex_mean(F.col("ring"))
    return rows.select("k", F.round(shapes.stage_area_km2(F.array("ring"), F.lit(35.5)), 6).alias("km2"), F.round(mean["lat"], 6).alias("lat"), F.round(mean["lon"], 6).alias("lon"))


# --- what is on a way ------------------------------------------------------------------------------


@q.query(
    pr.with_ctes(
        "edges nodes points",
        "SELECT way, CAST(count(lev_diff) AS BIGINT) AS checked, CAST(count(*) FILTER (WHERE lev_diff IN ('1', '2')) AS BIGINT) AS step_free, CAST(count(*) FILTER (WHERE lev_diff IS NULL) AS BIGINT) AS unknown, coalesce(array_to_string(list_sort(list(DISTINCT CASE lev_diff WHEN '3' THEN '2〜5cmの段差が確認されています' WHEN '4' THEN '5〜10cmの段差が確認されています' WHEN '5' THEN '10cm超の段差が確認されています' END) FILTER (WHERE lev_diff IN ('3', '4', '5'))), '|'), '') AS notes "
        f"FROM (SELECT s.a AS way, s.b, (SELECT arg_min(p.lev_diff, ({q.PAIR}, p.ord)) FROM mids p WHERE abs(s.lat - p.lat) < 0.001 AND abs(s.lon - p.lon) < 0.001 AND {q.PAIR} < 25) AS lev_diff FROM mid_edges s) GROUP BY 1",
        q.MIDS,
    )
)
def barrier_notes(spark, sf_dir):
    """What surveyed links confirm along the footpaths of each node."""
    node = pr.nodes(spark, sf_dir)
    ends = pr.edges(spark, sf_dir).filter("walk = 1 and car = 0").select("a", "b").distinct()
    ends = ends.join(node.select(F.col("node").alias("a"), F.col("lat").alias("la"), F.col("lon").alias("oa")), "a").join(node.select(F.col("node").alias("b"), F.col("lat").alias("lb"), F.col("lon").alias("ob")), "b")
    segments = ends.select(F.col("a").alias("way"), F.col("b").alias("i"), ((F.col("la") + F.col("lb")) / 2).alias("lat"), ((F.col("oa") + F.col("ob")) / 2).alias("lon"))
    surveyed = pr.points(spark, sf_dir).selectExpr("point_id AS ord", "lat", "lon", "CAST(1 + point_id % 5 AS STRING) AS lev_diff", "'1' AS roof")
    return barriers.annotated(segments, surveyed).select("way", "checked", "step_free", "unknown", F.array_join("notes", "|").alias("notes"))


@q.query()
def way_obstacles(spark, sf_dir):
    """Marks along each order as a way: its lines are legs, some with steps."""
    kinds = "CASE WHEN l_quantity % 3 = 0 THEN 'steps' ELSE 'footway' END AS highway", "CAST(CAST(l_quantity AS INT) % 7 AS STRING) AS lev_diff", "CASE WHEN l_partkey % 11 = 0 THEN '1' END AS width_code", "CAST(l_suppkey % 9 AS STRING) AS vtcl_slope"
    legs = pr.table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS pair", "l_linenumber AS i", *kinds, "CAST(35.8 AS DOUBLE) + CAST(l_linenumber AS DOUBLE) / 4000 AS lat", "CAST(139.9 AS DOUBLE) AS lon")
    found = walking.obstacles(legs)
    return found.select("pair", F.size("obstacles").alias("marks"), labels.spared(F.col("obstacles"), F.col("pair") % 60, F.col("pair") % 60).alias("text"))


@q.query("SELECT DISTINCT n_nationkey AS feed_id FROM nation ANTI JOIN (SELECT DISTINCT s_nationkey AS n_nationkey FROM supplier WHERE s_acctbal > 5000) USING (n_nationkey)")
def missing_feeds(spark, sf_dir):
    configured = pr.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("feed_id"))
    return details.missing_feeds(configured, pr.table(spark, sf_dir, "supplier").filter("s_acctbal > 5000").select(F.col("s_nationkey").alias("feed_id")))


