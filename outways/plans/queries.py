"""The registered queries, each with its DuckDB counterpart.

A query starts from projections of the given tables, applies one operator, and returns plain columns.
Distances are rounded to millimetres or cut to metres in both engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from outways.functions import clock, geo, names, places
from outways.operators import entity, feeds, near, pages, roads, spots, timetable
from outways.plans import projections as pr
from outways.plans.profiles import MODES, Profile, for_months

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
LAT, LON = pr.HOME_LAT, pr.HOME_LON
HOME = {"lat": LAT, "lon": LON}


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return register


HOME_M = pr.haversine_sql(f"{LAT}::DOUBLE", f"{LON}::DOUBLE", "lat", "lon")
BIG = " OR ".join(f"contains(coalesce(name, ''), '{w}')" for w in places.BIG_PARK_WORDS)
TOYS = "len(list_filter(string_split(trim(coalesce(playground, '')), '・'), lambda x: x <> ''))"
RANK = (
    f"CASE WHEN facility_type = '公園' THEN CASE WHEN area_m2 >= 10000 OR ({TOYS} >= 4 AND coalesce(toilet, false)) OR (({BIG}) AND (area_m2 >= 3000 OR coalesce(toilet, false))) THEN 'major' "
    f"WHEN area_m2 >= 3000 OR {TOYS} >= 3 OR ({TOYS} >= 2 AND coalesce(toilet, false)) THEN 'normal' WHEN area_m2 > 0 THEN 'minor' ELSE 'unknown' END END"
)
WORTH = "CASE WHEN park_rank IS NULL THEN true WHEN metres <= 600 THEN true WHEN metres <= 1500 THEN park_rank IN ('major', 'normal') ELSE park_rank = 'major' END"
ON = f"(coalesce(event_start, '') = '' OR coalesce(nullif(event_end, ''), event_start) >= '{pr.DAY}')"


def candidate_sql(months: int | None = 24, more: str = "true") -> str:
    ages = f"coalesce(age_min, {months}) <= {months} AND coalesce(age_max, {months}) >= {months}" if months is not None else "true"
    return (
        f"ranked AS (SELECT *, {RANK} AS park_rank, {HOME_M} AS metres FROM spots), "
        f"cand AS (SELECT *, {WORTH} AS worth FROM ranked WHERE {ages} AND coalesce(dropin, true) AND {ON} AND {more})"
    )


def found_sql(radius_m: int, limit: int) -> str:
    return f"found AS (SELECT *, CAST(trunc(metres) AS INT) AS distance_m FROM cand WHERE worth AND metres <= {radius_m} ORDER BY distance_m, ord LIMIT {limit})"


# --- destinations ---------------------------------------------------------------------------------


@query(pr.with_ctes("spots", "SELECT id, name, facility_type, city, outside, park_rank, distance_m FROM found", candidate_sql() + ", " + found_sql(2000, 400)))
def nearby_radius(spark, sf_dir):
    """Suitable destinations within two kilometres of home, nearest first."""
    found = spots.search(pr.spots(spark, sf_dir), LAT, LON, radius_km=2.0, months=24, on=pr.DAY)
    return found.select("id", "name", "facility_type", "city", "outside", "park_rank", "distance_m")


@query(pr.with_ctes("spots", "SELECT id, name, distance_m FROM found", candidate_sql(None) + ", " + found_sql(10000, 20)))
def nearby_topk(spark, sf_dir):
    return spots.search(pr.spots(spark, sf_dir), LAT, LON, limit=20, on=pr.DAY).select("id", "name", "distance_m")


@query(
    pr.with_ctes(
        "spots",
        "SELECT count(*) FILTER (WHERE worth AND metres <= 3000) AS total, count(*) FILTER (WHERE worth AND metres <= 3000 AND NOT outside) AS inside, "
        "count(*) FILTER (WHERE worth AND metres <= 3000 AND outside) AS outside, count(DISTINCT CASE WHEN worth AND metres <= 3000 AND outside THEN city END) AS outside_cities, "
        "count(*) FILTER (WHERE NOT worth) AS skipped_parks FROM cand",
        candidate_sql(),
    )
)
def nearby_summary(spark, sf_dir):
    return spots.search_summary(pr.spots(spark, sf_dir), LAT, LON, radius_km=3.0, months=24, on=pr.DAY)


ORDER = "CASE facility_type " + " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(places.PICK_ORDER)) + " END"


@query(
    pr.with_ctes(
        "spots", "SELECT id, facility_type, distance_m, turn FROM turns WHERE turn <= 3 ORDER BY turn, pick LIMIT 6",
        candidate_sql() + ", " + found_sql(10000, 4000) + f", turns AS (SELECT *, {ORDER} AS pick, CAST(row_number() OVER (PARTITION BY facility_type ORDER BY distance_m, ord) AS INT) AS turn FROM found WHERE {ORDER} IS NOT NULL)",
    )
)
def nearby_picks(spark, sf_dir):
    return spots.picks(pr.spots(spark, sf_dir), LAT, LON, months=24, on=pr.DAY).select("id", "facility_type", "distance_m", "turn")


@query(pr.with_ctes("spots", "SELECT coalesce(nullif(facility_type, ''), nullif(category, ''), 'その他') AS category, count(*) AS n, min(ord) AS first_ord FROM spots WHERE coalesce(dropin, true) GROUP BY 1"))
def nearby_categories(spark, sf_dir):
    return spots.categories(pr.spots(spark, sf_dir))


@query(pr.with_ctes("spots", "SELECT city, count(*) AS n, min(ord) AS first_ord FROM found WHERE outside GROUP BY 1", candidate_sql() + ", " + found_sql(6000, 4000)))
def nearby_cities(spark, sf_dir):
    found = spots.search(pr.spots(spark, sf_dir), LAT, LON, radius_km=6.0, limit=4000, months=24, on=pr.DAY)
    return spots.tally(found.filter("outside"), F.col("city"), "city")


@query(pr.with_ctes("spots", "SELECT id, age_min, age_max FROM spots WHERE coalesce(age_min, 30) <= 30 AND coalesce(age_max, 30) >= 30"))
def spots_age(spark, sf_dir):
    return pr.spots(spark, sf_dir).filter(places.ages_match(F.col("age_min"), F.col("age_max"), 30)).select("id", "age_min", "age_max")


@query(pr.with_ctes("spots", f"SELECT id, event_start, event_end FROM spots WHERE coalesce(event_start, '') <> '' AND {ON} ORDER BY coalesce(event_start, '9999'), ord LIMIT 20"))
def spots_event_on(spark, sf_dir):
    return spots.events(pr.spots(spark, sf_dir), pr.DAY).select("id", "event_start", "event_end")


@query(pr.with_ctes("spots", "SELECT city, facility_type, count(*) AS n FROM spots WHERE outside AND coalesce(facility_type, '') NOT IN ('図書館', 'おむつ替えのできるトイレ') GROUP BY ALL"))
def spots_hidden_types(spark, sf_dir):
    seen = spots.visible(pr.spots(spark, sf_dir), ["図書館", "おむつ替えのできるトイレ"]).filter("outside")
    return seen.groupBy("city", "facility_type").agg(F.count("*").alias("n"))


@query(pr.with_ctes("spots", "SELECT facility_type, count(*) AS n, min(ord) AS first_ord FROM spots WHERE NOT (length(trim(coalesce(official_url, ''))) > 0) GROUP BY 1"))
def no_web_info_tally(spark, sf_dir):
    return spots.tally(pr.spots(spark, sf_dir).filter(~places.has_web_info(F.col("official_url"))), F.col("facility_type"), "facility_type")


@query(
    pr.with_ctes(
        "spots",
        "SELECT count(*) AS spots, count(*) FILTER (WHERE dropin) AS dropin, count(*) FILTER (WHERE facility_type = '公園') AS parks, count(*) FILTER (WHERE length(trim(coalesce(official_url, ''))) > 0) AS with_url, "
        "count(*) FILTER (WHERE event_start <> '') AS events, count(*) FILTER (WHERE toilet) AS with_toilet, count(*) FILTER (WHERE area_m2 > 0) AS with_area, count(age_min) AS with_ages, "
        "count(DISTINCT city) AS cities, count(DISTINCT facility_type) AS kinds, count(*) FILTER (WHERE outside) AS outside, count(*) FILTER (WHERE dropin IS NULL) AS dropin_unknown FROM spots",
    )
)
def coverage_spots(spark, sf_dir):
    return spots.coverage(pr.spots(spark, sf_dir))


@query(pr.with_ctes("spots", f"SELECT id, {RANK} AS park_rank FROM spots WHERE facility_type = '公園'"))
def park_rank(spark, sf_dir):
    return spots.with_rank(pr.spots(spark, sf_dir)).filter("facility_type = '公園'").select("id", "park_rank")


@query(pr.with_ctes("spots", f"SELECT id, {WORTH} AS worth FROM (SELECT *, {RANK} AS park_rank, {HOME_M} AS metres FROM spots)"))
def park_worth(spark, sf_dir):
    ranked = spots.with_rank(pr.spots(spark, sf_dir)).withColumn("metres", geo.haversine(LAT, LON, F.col("lat"), F.col("lon")))
    return ranked.select("id", places.worth_going(F.col("park_rank"), F.col("metres")).alias("worth"))


@query(pr.with_ctes("spots", f"SELECT outside, park_rank, count(*) AS n, count(*) FILTER (WHERE area_m2 > 0) AS with_area FROM (SELECT *, {RANK} AS park_rank FROM spots WHERE facility_type = '公園') GROUP BY ALL"))
def park_summary(spark, sf_dir):
    return spots.park_summary(pr.spots(spark, sf_dir))


@query(pr.with_ctes("spots", "SELECT facility_type, count(*) FILTER (WHERE dropin IS NULL OR dropin) AS kept, count(*) FILTER (WHERE NOT dropin) AS dropped FROM spots GROUP BY 1"))
def drop_enrolment(spark, sf_dir):
    all_of = pr.spots(spark, sf_dir)
    kept = spots.drop_enrolment(all_of).groupBy("facility_type").agg(F.count("*").alias("kept"))
    totals = all_of.groupBy("facility_type").agg(F.count("*").alias("n"))
    return totals.join(kept, "facility_type", "left").select("facility_type", F.coalesce("kept", F.lit(0).cast("long")).alias("kept"), (F.col("n") - F.coalesce("kept", F.lit(0))).alias("dropped"))


@query(
    pr.with_ctes(
        "inside outside",
        "SELECT id, name, outside FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY o DESC, ord DESC) AS r FROM (SELECT *, 0 AS o FROM inside UNION ALL SELECT * REPLACE (ord % 500 AS id), 1 AS o FROM outside)) WHERE r = 1",
    )
)
def spot_by_id(spark, sf_dir):
    return spots.by_id(pr.inside(spark, sf_dir), pr.outside(spark, sf_dir).withColumn("id", F.expr("ord % 500"))).select("id", "name", "outside")


KINDS = "CASE " + " ".join(f"WHEN contains(said, '{w}') THEN '{k}'" for w, k in places.NAME_KINDS) + " END"


@query(
    pr.with_ctes(
        "spots",
        f"SELECT id, kind, CASE WHEN kind IS NULL THEN NULL WHEN kind IN ({', '.join(repr(k) for k in places.DROPIN_KINDS)}) THEN true ELSE NOT ({' OR '.join(f'contains(kind, {k!r})' for k in places.ENROL_KINDS)}) END AS goes "
        f"FROM (SELECT id, coalesce(CASE WHEN id % 50 = 3 THEN '保育所' END, {KINDS}, CASE WHEN id % 3 = 1 THEN said END) AS kind FROM said)",
        "said AS (SELECT id, CASE id % 3 WHEN 0 THEN '市立' || facility_type WHEN 1 THEN CASE WHEN id % 2 = 0 THEN facility_type || '前' ELSE '市場' END ELSE 'ひだまり幼稚園' END AS said FROM spots)",
    )
)
def facility_kinds(spark, sf_dir):
    """Kinds by code, given field and name; and whether one may just go there."""
    rows = pr.spots(spark, sf_dir).selectExpr(
        "id", "CASE id % 3 WHEN 0 THEN '市立' || facility_type WHEN 2 THEN 'ひだまり幼稚園' ELSE '' END AS label",
        "CASE WHEN id % 3 = 1 THEN CASE WHEN id % 2 = 0 THEN facility_type || '前' ELSE '市場' END END AS given", "CASE WHEN id % 50 = 3 THEN '1402a' END AS poi",
    )
    kind = places.facility_kind(F.col("label"), F.col("poi"), F.col("given"))
    return rows.select("id", kind.alias("kind")).withColumn("goes", places.is_dropin(F.col("kind")))


# --- geometry and spatial joins -------------------------------------------------------------------

PAIR = pr.haversine_sql("p.lat", "p.lon", "s.lat", "s.lon")


@query(pr.with_ctes("points", f"SELECT point_id, round({HOME_M}, 3) AS metres FROM points"))
def haversine_pairs(spark, sf_dir):
    return pr.points(spark, sf_dir).select("point_id", F.round(geo.haversine(LAT, LON, F.col("lat"), F.col("lon")), 3).alias("metres"))


@query(pr.with_ctes("points places", f"SELECT point_id, place_id, round({PAIR}, 3) AS metres FROM points p, places s WHERE {PAIR} <= 700"))
def places_within(spark, sf_dir):
    return near.within_metres(pr.points(spark, sf_dir), pr.places(spark, sf_dir), 700, digits=3).select("point_id", "place_id", "metres")


NEAR = f"near AS (SELECT point_id, place_id, {PAIR} AS m FROM points p, places s WHERE {PAIR} < 1000), ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY point_id ORDER BY m, place_id) AS INT) AS rank FROM near)"


@query(pr.with_ctes("points places", "SELECT point_id, place_id, round(m, 3) AS metres FROM ranked WHERE rank = 1", NEAR))
def nearest_1(spark, sf_dir):
    best = near.nearest(pr.points(spark, sf_dir), pr.places(spark, sf_dir), 1000, "point_id", "place_id")
    return best.select("point_id", "place_id", F.round("metres", 3).alias("metres"))


@query(pr.with_ctes("points places", "SELECT point_id, place_id, round(m, 3) AS metres, rank FROM ranked WHERE rank <= 8", NEAR))
def nearest_k(spark, sf_dir):
    best = near.nearest(pr.points(spark, sf_dir), pr.places(spark, sf_dir), 1000, "point_id", "place_id", 8)
    return best.select("point_id", "place_id", F.round("metres", 3).alias("metres"), "rank")


@query(pr.with_ctes("points", "SELECT CAST(floor(lat / 0.01::DOUBLE) AS BIGINT) AS y, CAST(floor(lon / 0.01::DOUBLE) AS BIGINT) AS x, count(*) AS n FROM points GROUP BY ALL"))
def grid_cells(spark, sf_dir):
    return pr.points(spark, sf_dir).groupBy(geo.cell(F.col("lat"), 0.01).alias("y"), geo.cell(F.col("lon"), 0.01).alias("x")).agg(F.count("*").alias("n"))


RING = [(139.88, 35.83), (139.92, 35.825), (139.935, 35.85), (139.905, 35.88), (139.9, 35.86), (139.87, 35.87)]
RING_LIST = "[" + ", ".join(f"{{'lon': {x}::DOUBLE, 'lat': {y}::DOUBLE}}" for x, y in RING) + "]"
CROSSED = " + ".join(
    f"CASE WHEN ({y1}::DOUBLE > lat) <> ({y2}::DOUBLE > lat) AND lon < ({x2}::DOUBLE - {x1}::DOUBLE) * ((lat - {y1}::DOUBLE) / ({y2}::DOUBLE - {y1}::DOUBLE)) + {x1}::DOUBLE THEN 1 ELSE 0 END"
    for (x1, y1), (x2, y2) in zip(RING, RING[1:] + RING[:1], strict=True)
)


@query(pr.with_ctes("points", f"SELECT point_id, ({CROSSED}) % 2 = 1 AS inside FROM points"))
def point_in_ring(spark, sf_dir):
    ring = F.array(*[F.struct(F.lit(x).alias("lon"), F.lit(y).alias("lat")) for x, y in RING])
    return pr.points(spark, sf_dir).select("point_id", geo.in_ring(F.col("lat"), F.col("lon"), ring).alias("inside"))


LINE = "seq AS (SELECT nation, lat, lon, lead(lat) OVER w AS lat2, lead(lon) OVER w AS lon2, first_value(lat) OVER w AS lat0, first_value(lon) OVER w AS lon0, row_number() OVER w - 1 AS i FROM places WINDOW w AS (PARTITION BY nation ORDER BY place_id))"


def lines(spark, sf_dir) -> DataFrame:
    """(nation, line): the places of each nation by id as a line."""
    point = F.struct("place_id", "lon", "lat")
    joined = pr.places(spark, sf_dir).groupBy("nation").agg(F.sort_array(F.collect_list(point)).alias("points"))
    return joined.select("nation", F.transform("points", lambda p: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat"))).alias("line"))


@query(
    pr.with_ctes("places", "SELECT nation, round(abs(sum(lon * coalesce(lat2, lat0) - coalesce(lon2, lon0) * lat)) / 2 * 111000.0::DOUBLE * 111000.0::DOUBLE, 0) AS area_m2 FROM seq GROUP BY 1", LINE)
)
def ring_area(spark, sf_dir):
    return lines(spark, sf_dir).select("nation", F.round(geo.ring_area_m2(F.col("line")), 0).alias("area_m2"))


@query(pr.with_ctes("places", f"SELECT nation, round(coalesce(sum({pr.haversine_sql('lat', 'lon', 'lat2', 'lon2')}), 0), 2) AS metres FROM seq GROUP BY 1", LINE))
def polyline_length(spark, sf_dir):
    return lines(spark, sf_dir).select("nation", F.round(geo.line_length_m(F.col("line")), 2).alias("metres"))


def snapped_sql(lat: float, lon: float, name: str) -> str:
    k = f"cos(radians({lat}::DOUBLE))"
    along = f"((({lon}::DOUBLE - lon) * {k}) * ((lon2 - lon) * {k}) + ({lat}::DOUBLE - lat) * (lat2 - lat)) / nullif(((lon2 - lon) * {k}) * ((lon2 - lon) * {k}) + (lat2 - lat) * (lat2 - lat), 0)"
    return (
        f"{name}_t AS (SELECT nation, i, lat, lon, lat2, lon2, greatest(0.0::DOUBLE, least(1.0::DOUBLE, coalesce({along}, 0.0::DOUBLE))) AS t FROM seq WHERE lat2 IS NOT NULL), "
        f"{name} AS (SELECT nation, i, {pr.haversine_sql(f'{lat}::DOUBLE', f'{lon}::DOUBLE', '(lat + (lat2 - lat) * t)', '(lon + (lon2 - lon) * t)')} AS m FROM {name}_t)"
    )


@query(pr.with_ctes("places", "SELECT nation, CAST(i AS INT) AS segment, round(m, 2) AS metres FROM home", LINE + ", " + snapped_sql(LAT, LON, "home")))
def snap_to_line(spark, sf_dir):
    snapped = geo.snapped(F.col("line"), F.lit(LAT), F.lit(LON))
    return lines(spark, sf_dir).select("nation", F.posexplode(snapped).alias("segment", "s")).select("nation", "segment", F.round("s.m", 2).alias("metres"))


@query(
    pr.with_ctes(
        "places", "SELECT nation, round(min(a.m + b.m), 2) AS total FROM home a JOIN far b USING (nation) WHERE a.i <= b.i GROUP BY 1",
        LINE + ", " + snapped_sql(LAT, LON, "home") + ", " + snapped_sql(35.87, 139.93, "far"),
    )
)
def best_pair(spark, sf_dir):
    metres = lambda lat, lon: F.transform(geo.snapped(F.col("line"), F.lit(lat), F.lit(lon)), lambda s: s["m"])
    pair = geo.best_pair(metres(LAT, LON), metres(35.87, 139.93))
    return lines(spark, sf_dir).select("nation", F.round(pair["total"], 2).alias("total")).filter("total is not null")


BOXES = "SELECT CAST(a AS INT) AS poly, 35.8::DOUBLE + (a % 5) * 0.02::DOUBLE AS y, 139.85::DOUBLE + (a // 5) * 0.02::DOUBLE AS x, 0.015::DOUBLE + (a % 3) * 0.005::DOUBLE AS s FROM range(25) t(a)"


def boxes(spark) -> DataFrame:
    """Overlapping squares that stand for municipalities."""
    b = spark.range(25).selectExpr("cast(id as int) AS poly", "35.8D + (id % 5) * 0.02D AS y", "139.85D + (id div 5) * 0.02D AS x", "0.015D + (id % 3) * 0.005D AS s")
    corner = lambda dx, dy: F.struct((F.col("x") + F.col("s") * dx).alias("lon"), (F.col("y") + F.col("s") * dy).alias("lat"))
    return b.select("poly", "s", F.array(corner(0, 0), corner(1, 0), corner(1, 1), corner(0, 1)).alias("ring"))


@query(pr.with_ctes("points", f"SELECT point_id, arg_min(poly, s * 1000000 + poly) AS poly FROM points, ({BOXES}) WHERE lat >= y AND lat < y + s AND lon >= x AND lon < x + s GROUP BY 1"))
def smallest_polygon(spark, sf_dir):
    """The smallest polygon around each point."""
    return near.containing(pr.points(spark, sf_dir), boxes(spark), "point_id", "poly", F.col("s"))


# --- timetable ------------------------------------------------------------------------------------

WHEN = 28_800
EARLIEST = "min(dep)"
TIMED = "timed AS (SELECT *, CAST(row_number() OVER (PARTITION BY feed_id, trip_id ORDER BY seq, place_id) - 1 AS INT) AS idx FROM stop_times), departing AS (SELECT timed.*, route_id, wheelchair FROM timed JOIN trips USING (feed_id, trip_id) WHERE dep IS NOT NULL)"


def departing(spark, sf_dir) -> DataFrame:
    return timetable.departures(pr.stop_times(spark, sf_dir), pr.trips(spark, sf_dir))


def calendar(spark) -> DataFrame:
    rows = [("f", "F", 1, 1, 1, 1, 1, 0, 0, "", ""), ("f", "O", 0, 0, 0, 0, 0, 1, 1, "19950101", "20011231"), ("f", "P", 1, 1, 1, 1, 1, 1, 1, "19960101", "")]
    return spark.createDataFrame(rows, "feed_id string, service_id string, mon int, tue int, wed int, thu int, fri int, sat int, sun int, start_date string, end_date string")


@query(
    "WITH days AS (SELECT DISTINCT strftime(o_orderdate, '%Y%m%d') AS d, o_orderdate AS t FROM orders), ex AS (SELECT o_orderstatus AS service_id, strftime(o_orderdate, '%Y%m%d') AS d, CASE sum(o_custkey) % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 END AS e FROM orders GROUP BY ALL), "
    "cal AS (SELECT * FROM (VALUES ('F', 1, 0, '', ''), ('O', 0, 1, '19950101', '20011231'), ('P', 1, 1, '19960101', '')) v(service_id, wk, we, s, e)) "
    "SELECT d AS day, service_id, CASE WHEN ex.e = 2 THEN false WHEN ex.e = 1 THEN true ELSE (cal.s = '' OR cal.s <= d) AND (cal.e = '' OR cal.e >= d) AND CASE WHEN isodow(t) >= 6 THEN we ELSE wk END = 1 END AS runs "
    "FROM days CROSS JOIN cal LEFT JOIN ex USING (service_id, d)"
)
def service_runs(spark, sf_dir):
    """Whether each service runs on each day of the orders: exceptions first, then calendar."""
    orders = pr.table(spark, sf_dir, "orders")
    exceptions = orders.groupBy(F.expr("'f'").alias("feed_id"), F.col("o_orderstatus").alias("service_id"), F.date_format("o_orderdate", "yyyyMMdd").alias("date"))
    exceptions = exceptions.agg(F.expr("CASE sum(o_custkey) % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 END").alias("exception_type"))
    days = orders.select(F.date_format("o_orderdate", "yyyyMMdd").alias("day")).distinct()
    return timetable.services_on(calendar(spark), exceptions, days).select("day", "service_id", "runs")


@query("WITH run AS (SELECT unnest(['F', 'P']) AS service_id) SELECT route_id, count(*) AS trips FROM (" + pr.with_ctes("trips", "SELECT * FROM trips") + ") JOIN run USING (service_id) GROUP BY 1")
def active_trips(spark, sf_dir):
    """Trips per route that run on a Wednesday inside two services' spans and outside the third's days."""
    none = spark.createDataFrame([], "feed_id string, service_id string, date string, exception_type int")
    day = spark.createDataFrame([("20240612",)], "day string")
    services = timetable.services_on(calendar(spark), none, day)
    return timetable.active_trips(pr.trips(spark, sf_dir), services).groupBy("route_id").agg(F.count("*").alias("trips"))


@query(pr.with_ctes("stop_times trips", "SELECT place_id, count(*) AS departures, min(dep) AS first_dep, max(dep) AS last_dep, CAST(sum(idx) AS BIGINT) AS idx_sum FROM departing GROUP BY 1", TIMED))
def departures_index(spark, sf_dir):
    return departing(spark, sf_dir).groupBy("place_id").agg(F.count("*").alias("departures"), F.min("dep").alias("first_dep"), F.max("dep").alias("last_dep"), F.sum("idx").alias("idx_sum"))


@query(
    pr.with_ctes(
        "stop_times trips", "SELECT place_id, route_id, dep, trip_id, idx FROM (SELECT *, row_number() OVER (PARTITION BY place_id, feed_id, route_id ORDER BY dep, trip_id, idx) AS r FROM departing WHERE dep BETWEEN 28800 AND 39600 AND wheelchair <> '2') WHERE r = 1", TIMED
    )
)
def next_departure(spark, sf_dir):
    """The next departure of each route at each place from eight o'clock, for a stroller."""
    departing_ = departing(spark, sf_dir)
    labels = pr.places(spark, sf_dir).select("place_id", F.lit(WHEN).alias("t"))
    return timetable.next_departures(labels, departing_, stroller=True).select("place_id", "route_id", "dep", "trip_id", "idx")


PLACE_PAIR = pr.haversine_sql("p.lat", "p.lon", "q.lat", "q.lon")
TRANSFERS = f"transfers AS (SELECT p.place_id AS a, q.place_id AS b, greatest(120, CAST(trunc({PLACE_PAIR} * 1.3::DOUBLE / 80.0::DOUBLE * 60) AS INT)) AS seconds FROM places p, places q WHERE p.place_id <> q.place_id AND {PLACE_PAIR} <= 300)"


@query(pr.with_ctes("places", "SELECT * FROM transfers", TRANSFERS))
def transfers_fallback(spark, sf_dir):
    return timetable.nearby_transfers(pr.places(spark, sf_dir))


@query(pr.with_ctes("places", "SELECT a, b, CAST(floor(seconds * 80.0::DOUBLE / 65.0::DOUBLE) AS INT) AS seconds FROM transfers", TRANSFERS))
def transfer_gentle(spark, sf_dir):
    return timetable.gentler(timetable.nearby_transfers(pr.places(spark, sf_dir)))


#: So many places near a start or an end does the SQL of these queries take; that of ``isochrone_transit`` takes all.
NEAREST = 30
ALL_ACCESS = f"access AS (SELECT place_id, CAST(trunc(m * 1.3::DOUBLE / 80.0::DOUBLE * 60) AS INT) AS seconds FROM (SELECT place_id, {HOME_M} AS m FROM places) WHERE m <= 1500)"
ACCESS = f"access AS (SELECT place_id, CAST(trunc(m * 1.3::DOUBLE / 80.0::DOUBLE * 60) AS INT) AS seconds FROM (SELECT place_id, {HOME_M} AS m FROM places) WHERE m <= 1500 ORDER BY m, place_id LIMIT 30)"


def _round_sql(i: int) -> str:
    return (
        f"f{i} AS (SELECT place_id, t FROM l{i - 1} WHERE round = {i - 1}), "
        f"b{i} AS (SELECT * FROM (SELECT f.place_id, f.t, d.feed_id, d.route_id, d.dep, d.trip_id, d.idx, row_number() OVER (PARTITION BY f.place_id, d.feed_id, d.route_id ORDER BY d.dep, d.trip_id, d.idx) AS r FROM f{i} f JOIN departing d USING (place_id) WHERE d.dep BETWEEN f.t AND f.t + 10800) WHERE r = 1), "
        f"c{i} AS (SELECT t.place_id, coalesce(t.arr, t.dep) AS t FROM b{i} b JOIN timed t USING (feed_id, trip_id) WHERE t.idx > b.idx AND coalesce(t.arr, t.dep) IS NOT NULL UNION ALL SELECT x.b, f.t + x.seconds FROM f{i} f JOIN transfers x ON f.place_id = x.a), "
        f"l{i} AS (SELECT place_id, min(t) AS t, arg_min(round, t * 10 + round) AS round FROM (SELECT place_id, t, round FROM l{i - 1} UNION ALL SELECT place_id, t, {i} FROM c{i} WHERE t <= {WHEN} + 7200) GROUP BY 1)"
    )


RAPTOR, ALL_RAPTOR = (
    ", ".join([TIMED, TRANSFERS, access, f"l0 AS (SELECT place_id, {WHEN} + min(seconds) AS t, 0 AS round FROM access WHERE seconds <= 1200 GROUP BY 1)", *[_round_sql(i) for i in (1, 2, 3)]]) for access in (ACCESS, ALL_ACCESS)
)


def _reached(spark, sf_dir, budget: int | None = 7200, top: int | None = NEAREST) -> DataFrame:
    places_ = pr.places(spark, sf_dir)
    access = timetable.access_times(places_, LAT, LON, top=top)
    return timetable.reachable_places(access, WHEN, pr.stop_times(spark, sf_dir), departing(spark, sf_dir), timetable.nearby_spots(places_), budget=budget, cut=cut)


def cut(df: DataFrame) -> DataFrame:
    """End a lineage with a reliable checkpoint, in the shared folder if one is set."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        import tempfile

        root = context.getConf().get("spark.checkpoint.dir")
        if root is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(root or tempfile.mkdtemp(prefix="outways-"))
    return df.checkpoint()


@query(pr.with_ctes("stop_times trips places", "SELECT place_id, CAST(t AS INT) AS t, CAST(round AS INT) AS round FROM l3", RAPTOR))
def raptor_reach(spark, sf_dir):
    """Earliest arrival at every place within two hours, with at most two changes."""
    return _reached(spark, sf_dir)


@query(pr.with_ctes("stop_times trips places", "SELECT CAST(round AS INT) AS round, count(*) AS places, min(t) AS first_t, max(t) AS last_t FROM l3 GROUP BY 1", RAPTOR))
def raptor_rounds(spark, sf_dir):
    return _reached(spark, sf_dir).groupBy("round").agg(F.count("*").alias("places"), F.min("t").alias("first_t"), F.max("t").alias("last_t"))


@query(
    pr.with_ctes(
        "stop_times trips places", f"SELECT DISTINCT start FROM (SELECT {WHEN} AS start UNION ALL SELECT dep - seconds FROM access JOIN departing USING (place_id) WHERE seconds <= 1200 AND dep - seconds BETWEEN {WHEN} AND {WHEN} + 10800) ORDER BY start LIMIT 12", f"{TIMED}, {ACCESS}"
    )
)
def departure_candidates(spark, sf_dir):
    access = timetable.access_times(pr.places(spark, sf_dir), LAT, LON, top=NEAREST)
    return timetable.start_times(access, WHEN, departing(spark, sf_dir))


@query()
def raptor_itineraries(spark, sf_dir):
    """Itineraries with their legs to the places near a destination, one per set of rides."""
    places_ = pr.places(spark, sf_dir)
    access = timetable.access_times(places_, LAT, LON, top=NEAREST)
    egress = timetable.access_times(places_, 35.87, 139.93, top=NEAREST)
    labels = timetable.search_labels(access, WHEN, pr.stop_times(spark, sf_dir), departing(spark, sf_dir), timetable.nearby_spots(places_), cut=cut)
    found = timetable.signatures(timetable.itineraries(labels, egress))
    return found.orderBy("arrive", F.size("legs"), "signature").limit(5).select("arrive", "round", "place_id", "signature", F.to_json("legs").alias("legs"))


@query(
    pr.with_ctes(
        "stop_times trips", "SELECT route_id, trip_id, stops FROM (SELECT *, row_number() OVER (PARTITION BY route_id ORDER BY stops DESC, trip_id) AS r FROM (SELECT route_id, trip_id, count(*) AS stops FROM stop_times JOIN trips USING (feed_id, trip_id) GROUP BY ALL HAVING count(*) >= 2)) WHERE r = 1"
    )
)
def representative_trip(spark, sf_dir):
    return timetable.representative_trips(pr.stop_times(spark, sf_dir), pr.trips(spark, sf_dir)).select("route_id", "trip_id", "stops")


@query(pr.with_ctes("stop_times trips", "SELECT place_id, count(DISTINCT route_id) AS routes, count(DISTINCT feed_id) AS feeds, count(DISTINCT trip_id) AS trips FROM stop_times JOIN trips USING (feed_id, trip_id) GROUP BY 1"))
def network_counts(spark, sf_dir):
    return timetable.network_counts(pr.stop_times(spark, sf_dir), pr.trips(spark, sf_dir))


@query(
    pr.with_ctes(
        "routes stop_times trips",
        "SELECT r.feed_id, r.routes, coalesce(t.trips, 0) AS trips, coalesce(s.stops, 0) AS stops, k.route_type FROM (SELECT feed_id, count(DISTINCT route_id) AS routes FROM routes GROUP BY 1) r "
        "JOIN (SELECT feed_id, route_type FROM (SELECT *, row_number() OVER (PARTITION BY feed_id ORDER BY n DESC, route_type) AS x FROM (SELECT feed_id, route_type, count(*) AS n FROM routes GROUP BY ALL)) WHERE x = 1) k USING (feed_id) "
        "LEFT JOIN (SELECT 'f' || CAST(route_id % 3 AS STRING) AS feed_id, count(DISTINCT trip_id) AS trips FROM trips GROUP BY 1) t USING (feed_id) LEFT JOIN (SELECT 'f' || CAST(place_id % 3 AS STRING) AS feed_id, count(DISTINCT place_id) AS stops FROM stop_times GROUP BY 1) s USING (feed_id)",
    )
)
def feed_stats(spark, sf_dir):
    routes = pr.table(spark, sf_dir, "customer").selectExpr(*pr.ROUTES)
    trips = pr.trips(spark, sf_dir).withColumn("feed_id", F.expr("'f' || CAST(route_id % 3 AS STRING)"))
    stops = pr.stop_times(spark, sf_dir).withColumn("feed_id", F.expr("'f' || CAST(place_id % 3 AS STRING)"))
    return timetable.feed_stats(trips, stops, routes)


@query()
def place_clusters(spark, sf_dir):
    """Stops of one name merged into places by distance to the first of each."""
    return entity.place_clusters(pr.table(spark, sf_dir, "supplier").selectExpr(*pr.STOPS))


@query()
def coordinate_candidates(spark, sf_dir):
    """Clusters of coordinates under each name, best first."""
    points = pr.table(spark, sf_dir, "supplier").selectExpr("'N' || CAST(s_nationkey AS STRING) AS key", "s_suppkey AS ord", f"{pr.lat('s_suppkey % 40')} AS lat", f"{pr.lon('s_suppkey % 40')} AS lon", "CASE s_suppkey % 3 WHEN 0 THEN 'gtfs' WHEN 1 THEN 'osm:A' ELSE 'osm:' END AS source")
    return entity.coordinate_candidates(points, hint="A")


@query()
def merged_spots(spark, sf_dir):
    """One row per place: equal names nearby are merged."""
    rows = pr.spots(spark, sf_dir)
    rich = sum((F.when(F.col(c).isNotNull(), 1).otherwise(0) for c in ("official_url", "age_min", "event_start", "playground")), F.lit(0)) + F.when(F.col("hand"), 2).otherwise(0)
    keyed = rows.withColumn("key", names.spot_name_key(F.col("name"))).withColumn("richness", rich).withColumn("toilet", F.coalesce("toilet", F.lit(False))).withColumn("age_min", F.coalesce("age_min", F.lit(0))).withColumn("age_max", F.coalesce("age_max", F.lit(155)))
    return entity.merged_spots(keyed.select("id", "ord", "key", "name", "facility_type", "lat", "lon", "richness", "hand", "toilet", "age_min", "age_max"))


# --- roads ----------------------------------------------------------------------------------------


def road_edges(spark, sf_dir) -> DataFrame:
    tags = F.map_filter(F.create_map(F.lit("kerb"), F.col("kerb"), F.lit("barrier"), F.col("barrier")), lambda _, v: v.isNotNull())
    return pr.edges(spark, sf_dir).withColumn("attrs", names.packed_map(F.col("packed"))).withColumn("to_tags", tags)


def cost_sql(p: Profile, mode: str = "walk") -> str:
    has = lambda kv: f"contains(';' || packed, ';{kv};')"
    d = lambda x: f"{x}::DOUBLE"
    pick = lambda c, w: f"CASE WHEN {c} THEN {d(w)} ELSE 1.0::DOUBLE END"
    busy = "highway IN ('primary')"
    unpaved = pick(has("surface=gravel"), p.unpaved)
    if mode == "car":
        speeds = "CASE highway WHEN 'primary' THEN 550.0 WHEN 'tertiary' THEN 420.0 WHEN 'residential' THEN 280.0 ELSE 300.0 END::DOUBLE"
        return f"CASE WHEN car = 1 THEN length / {speeds} * 60 END"
    if mode == "bike":
        road = f"CASE WHEN highway = 'cycleway' THEN {d(p.cycleway)} WHEN highway = 'footway' THEN CASE WHEN {has('bicycle=yes')} THEN {d(p.bike_sidewalk)} ELSE 1.6::DOUBLE END WHEN {busy} THEN {d(p.busy_road)} ELSE 1.0::DOUBLE END"
        return f"CASE WHEN bike = 1 THEN length / 220 * 60 * {road} * {unpaved} END"
    steps = "NULL" if p.steps is None else (f"CASE WHEN NOT {has('handrail=yes')} THEN {d(p.steps_no_handrail)} ELSE {d(p.steps)} END" if p.steps_no_handrail else d(p.steps))
    road = f"CASE WHEN highway = 'steps' THEN {steps} WHEN highway = 'elevator' THEN {d(p.elevator)} WHEN {busy} AND NOT {has('sidewalk=both')} THEN {d(p.busy_road)} ELSE 1.0::DOUBLE END"
    b = p.barriers
    step = f"CASE lev_diff WHEN '5' THEN {d(b['step_over_10cm'])} WHEN '4' THEN {d(b['step_over_5cm'])} WHEN '3' THEN {d(b['step_over_2cm'])} ELSE 1.0::DOUBLE END"
    slope = f"CASE WHEN vtcl_slope IN ('5', '6', '7', '8') THEN {d(b['steep'])} WHEN vtcl_slope IN ('3', '4') THEN {d(b['slope'])} ELSE 1.0::DOUBLE END"
    terms = [road, pick(has("incline=8%"), p.incline), unpaved, pick(has("width=1.2m"), p.narrow or 1.0), pick(has("covered=yes"), p.covered), step, slope, pick("width_code = '1'", b["narrow"]), pick("roof = '2'", b["roof"])]
    if p.stroller:
        terms += [pick("kerb = 'raised'", 1.8), pick("barrier = 'gate'", 1.3)]
    return f"CASE WHEN walk = 1 THEN length / {d(p.walk_speed)} * 60 * " + " * ".join(f"({t})" for t in terms) + " END"


def _cost_query(p: Profile, mode: str):
    def run(spark, sf_dir):
        return road_edges(spark, sf_dir).select("a", "b", "k", F.round(roads.edge_seconds(p, mode), 6).alias("seconds"))

    return run, pr.with_ctes("edges", f"SELECT a, b, k, round({cost_sql(p, mode)}, 6) AS seconds FROM edges")


for _name, _profile, _mode in (("edge_cost_walk", MODES["walk"], "walk"), ("edge_cost_stroller", MODES["stroller"], "walk"), ("edge_cost_prenatal", for_months(-3), "walk"), ("edge_cost_bike", MODES["bike"], "bike"), ("edge_cost_car", MODES["walk"], "car")):
    QUERIES[_name], ORACLES[_name] = _cost_query(_profile, _mode)

#: Whole seconds, so that both engines add up the same numbers.
BUDGET = 900


def costed_edges(spark, sf_dir) -> DataFrame:
    """Edges with whole seconds; tags are read once, not for each rule that asks for one."""
    edges = cut(road_edges(spark, sf_dir).select("a", "b", "length", "highway", "packed", "attrs", "walk", "bike", "car", "lev_diff", "width_code", "vtcl_slope", "roof", "to_tags"))
    cost = F.ceil(roads.edge_seconds(MODES["walk"])).cast("double")
    return edges.select("a", "b", cost.alias("cost"), "length", "highway", "packed", "attrs")


def walk_arcs(spark, sf_dir) -> DataFrame:
    """(a, b, cost): the same as ``arcs``, for one reader: tags are shuffled, not cut, and each cost is taken once for both ways."""
    edges = road_edges(spark, sf_dir).repartition("a", "b")
    costed = edges.select("a", "b", F.ceil(roads.edge_seconds(MODES["walk"])).cast("double").alias("cost"))
    way = lambda a, b: F.struct(F.col(a).alias("a"), F.col(b).alias("b"), "cost")
    return costed.select(F.inline(F.array(way("a", "b"), way("b", "a"))))


def arcs(spark, sf_dir) -> DataFrame:
    """The edges both ways, as all lead both ways on foot."""
    costed = cut(costed_edges(spark, sf_dir))
    return costed.union(costed.select(F.col("b").alias("a"), F.col("a").alias("b"), *costed.columns[2:]))


ARCS = f"costed AS (SELECT a, b, ceil({cost_sql(MODES['walk'])}) AS cost FROM edges), arcs AS (SELECT a, b, min(cost) AS cost FROM (SELECT a, b, cost FROM costed UNION ALL SELECT b, a, cost FROM costed) WHERE cost IS NOT NULL GROUP BY ALL)"
SSSP = (
    "sssp(node, cost) USING KEY (node) AS (SELECT CAST(1 AS BIGINT), CAST(0 AS DOUBLE) UNION SELECT n.node, n.cost FROM (SELECT a.b AS node, min(s.cost + a.cost) AS cost FROM sssp s JOIN arcs a ON s.node = a.a GROUP BY 1) n "
    f"LEFT JOIN recurring.sssp r ON r.node = n.node WHERE n.cost <= {BUDGET} AND (r.cost IS NULL OR n.cost < r.cost))"
)


def sssp_sql(body: str, more: str = "") -> str:
    return pr.with_ctes("edges nodes", body, ", ".join(x for x in (ARCS, SSSP, more) if x)).replace("WITH ", "WITH RECURSIVE ", 1)


def _known(spark, sf_dir, search=roads.least_costs) -> DataFrame:
    source = spark.range(1).select(F.lit(1).cast("long").alias("node"), F.lit(0.0).alias("cost"))
    return search(walk_arcs(spark, sf_dir), source, BUDGET, cut=cut)


@query(sssp_sql("SELECT node, CAST(cost AS BIGINT) AS seconds FROM sssp"))
def sssp_cost(spark, sf_dir):
    """Seconds on foot from one node to all within a quarter of an hour."""
    return _known(spark, sf_dir).select("node", F.col("cost").cast("long").alias("seconds"))


CELL_M = 100
CELLS = f"cells AS (SELECT DISTINCT CAST(floor(lat / ({CELL_M} / 111000.0::DOUBLE)) AS BIGINT) AS y, CAST(floor(lon / {roads.grid(LAT, CELL_M)[1]!r}::DOUBLE) AS BIGINT) AS x FROM (SELECT lat, lon FROM sssp JOIN nodes USING (node) UNION ALL SELECT {LAT}::DOUBLE, {LON}::DOUBLE))"


def _cells(spark, sf_dir) -> DataFrame:
    reached = _known(spark, sf_dir).join(pr.nodes(spark, sf_dir), "node")
    return roads.reach_cells(reached, LAT, LON, CELL_M)


@query(sssp_sql("SELECT y, x FROM cells", CELLS))
def isochrone_cells(spark, sf_dir):
    return _cells(spark, sf_dir)


@query(sssp_sql("SELECT count(*) AS cells, round(count(*) * 0.01::DOUBLE, 4) AS area_km2, min(y) AS y_min, max(y) AS y_max, min(x) AS x_min, max(x) AS x_max FROM cells", CELLS))
def isochrone_area(spark, sf_dir):
    cells = _cells(spark, sf_dir)
    return cells.agg(F.count("*").alias("cells"), F.round(F.count("*") * F.lit((CELL_M / 1000) ** 2), 4).alias("area_km2"), F.min("y").alias("y_min"), F.max("y").alias("y_max"), F.min("x").alias("x_min"), F.max("x").alias("x_max"))


#: Cells of all points in two modes, as two overlapping reaches with holes.
TWO = "two AS (SELECT DISTINCT 'm' || CAST(point_id % 2 AS STRING) AS mode, CAST(floor((lat - 35.8::DOUBLE) / 0.002::DOUBLE) AS BIGINT) AS y, CAST(floor((lon - 139.85::DOUBLE) / 0.002::DOUBLE) AS BIGINT) AS x FROM points)"


def two_reaches(spark, sf_dir) -> DataFrame:
    cell = lambda c, low: F.floor((F.col(c) - low) / 0.002).cast("long")
    return pr.points(spark, sf_dir).select(F.expr("'m' || CAST(point_id % 2 AS STRING)").alias("mode"), cell("lat", 35.8).alias("y"), cell("lon", 139.85).alias("x")).distinct()


FLOOD = (
    "box AS (SELECT mode, min(y) - 1 AS y0, max(y) + 1 AS y1, min(x) - 1 AS x0, max(x) + 1 AS x1 FROM two GROUP BY 1), "
    "flood AS (SELECT mode, y0 AS y, x0 AS x FROM box UNION SELECT f.mode, f.y + d.dy, f.x + d.dx FROM flood f JOIN box USING (mode), (VALUES (1, 0), (-1, 0), (0, 1), (0, -1)) d(dy, dx) "
    "WHERE f.y + d.dy BETWEEN y0 AND y1 AND f.x + d.dx BETWEEN x0 AND x1 AND NOT EXISTS (SELECT 1 FROM two t WHERE t.mode = f.mode AND t.y = f.y + d.dy AND t.x = f.x + d.dx)), "
    "rows_ AS (SELECT mode, unnest(range(y0, y1 + 1)) AS y, x0, x1 FROM box), grid AS (SELECT mode, y, unnest(range(x0, x1 + 1)) AS x FROM rows_), filled AS (SELECT g.mode, g.y, g.x FROM grid g ANTI JOIN flood f ON f.mode = g.mode AND f.y = g.y AND f.x = g.x)"
)


@query(pr.with_ctes("points", "SELECT mode, y, x FROM filled", TWO + ", " + FLOOD).replace("WITH ", "WITH RECURSIVE ", 1))
def flood_fill(spark, sf_dir):
    """Reached cells and the holes they enclose."""
    return roads.filled(two_reaches(spark, sf_dir))


@query(pr.with_ctes("points", "SELECT modes, count(*) AS cells, round(count(*) * 0.04::DOUBLE, 4) AS area_km2 FROM (SELECT y, x, string_agg(DISTINCT mode, '+' ORDER BY mode) AS modes FROM two GROUP BY ALL) GROUP BY 1", TWO))
def overlap_zones(spark, sf_dir):
    zones = roads.overlap_zones(two_reaches(spark, sf_dir), 200)
    return zones.select("modes", "cells", F.round("area_km2", 4).alias("area_km2"))


@query(
    pr.with_ctes(
        "points spots",
        "SELECT id, string_agg(DISTINCT mode, '+' ORDER BY mode) AS reach FROM (SELECT id, mode FROM (SELECT id, CAST(floor(lat / 0.0005::DOUBLE) AS BIGINT) AS y, CAST(floor(lon / 0.0005::DOUBLE) AS BIGINT) AS x FROM spots) s JOIN abs_two t ON abs(s.y - t.y) <= 1 AND abs(s.x - t.x) <= 1) GROUP BY 1",
        "abs_two AS (SELECT DISTINCT 'm' || CAST(point_id % 2 AS STRING) AS mode, CAST(floor(lat / 0.0005::DOUBLE) AS BIGINT) AS y, CAST(floor(lon / 0.0005::DOUBLE) AS BIGINT) AS x FROM points)",
    )
)
def reach_contains(spark, sf_dir):
    """Destinations in or next to a cell of a reach, with the modes that reach them."""
    cell = lambda c: F.floor(F.col(c) / 0.0005).cast("long")
    starts = pr.points(spark, sf_dir)
    reach = starts.select(F.expr("'m' || CAST(point_id % 2 AS STRING)").alias("mode"), cell("lat").alias("y"), cell("lon").alias("x"), F.lit(0.0005).alias("cell_lat"), F.lit(0.0005).alias("cell_lon")).distinct()
    return spots.reachable(pr.spots(spark, sf_dir), reach).select("id", F.array_join("reach", "+").alias("reach"))


WAYS = (
    f"ways AS (SELECT a, b, min(struct_pack(cost := cost, length := length, highway := highway, packed := packed)) AS w FROM (SELECT a, b, cost, length, highway, packed FROM (SELECT *, ceil({cost_sql(MODES['walk'])}) AS cost FROM edges) "
    f"UNION ALL SELECT b, a, cost, length, highway, packed FROM (SELECT *, ceil({cost_sql(MODES['walk'])}) AS cost FROM edges)) WHERE cost IS NOT NULL GROUP BY 1, 2), "
    "preds AS (SELECT s.node, min(c.a) AS pred FROM sssp s JOIN arcs c ON c.b = s.node JOIN sssp p ON p.node = c.a WHERE p.cost + c.cost = s.cost AND s.cost > 0 GROUP BY 1), "
    "legs AS (SELECT node, pred, w.length AS metres, w.cost AS seconds, CASE WHEN w.highway = 'steps' THEN 1.0 ELSE 0.0 END::DOUBLE AS steps, CASE WHEN w.highway = 'elevator' THEN 1.0 ELSE 0.0 END::DOUBLE AS elevators, "
    "CASE WHEN contains(w.packed, 'covered=yes') THEN w.length ELSE 0 END AS covered_m, CASE WHEN w.highway = 'footway' AND contains(w.packed, 'bicycle=yes') THEN w.length ELSE 0 END AS bike_sidewalk_m FROM preds JOIN ways ON a = pred AND b = node), "
    "along(node, hops, metres, seconds, steps, elevators, covered_m, bike_sidewalk_m) AS (SELECT CAST(1 AS BIGINT), CAST(0 AS BIGINT), 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE "
    "UNION ALL SELECT l.node, w.hops + 1, w.metres + l.metres, w.seconds + l.seconds, w.steps + l.steps, w.elevators + l.elevators, w.covered_m + l.covered_m, w.bike_sidewalk_m + l.bike_sidewalk_m FROM along w JOIN legs l ON l.pred = w.node)"
)


@query(sssp_sql("SELECT node, hops, round(metres, 3) AS metres, round(seconds, 3) AS seconds, steps, elevators, round(covered_m, 3) AS covered_m, round(bike_sidewalk_m, 3) AS bike_sidewalk_m FROM along", WAYS))
def path_summary(spark, sf_dir):
    """Length, seconds, steps, elevators and covered metres of the way to each reached node."""
    known = _known(spark, sf_dir, roads.shortest)
    way = arcs(spark, sf_dir).filter("cost is not null").groupBy("a", "b").agg(F.min(F.struct("cost", "length", "highway", "packed")).alias("w"))
    legs = known.filter("pred is not null").join(way, (F.col("pred") == F.col("a")) & (F.col("node") == F.col("b"))).select("node", "w.cost", "w.length", "w.highway", names.packed_map(F.col("w.packed")).alias("attrs"))
    sums = roads.path_sums(known, legs.select("node", *roads.leg_measures()), list(roads.PATH_SUMS), cut=cut)
    return sums.select("node", "hops", *[F.round(c, 3).alias(c) for c in roads.PATH_SUMS])


MIDS = "mids AS (SELECT point_id AS ord, lat, lon, CAST(1 + point_id % 5 AS STRING) AS lev_diff FROM points), mid_edges AS (SELECT DISTINCT a, b, (n.lat + m.lat) / 2 AS lat, (n.lon + m.lon) / 2 AS lon FROM edges JOIN nodes n ON a = n.node JOIN nodes m ON b = m.node WHERE walk = 1 AND car = 0)"


@query(
    pr.with_ctes("edges nodes points", f"SELECT a, b, lev_diff FROM (SELECT a, b, lev_diff, row_number() OVER (PARTITION BY a, b ORDER BY d, ord) AS r FROM (SELECT s.a, s.b, p.ord, p.lev_diff, {PAIR} AS d FROM mid_edges s, mids p WHERE abs(s.lat - p.lat) < 0.001 AND abs(s.lon - p.lon) < 0.001) WHERE d < 25) WHERE r = 1", MIDS)
)
def barrier_join(spark, sf_dir):
    """Footpaths with the codes of the nearest surveyed stretch."""
    node = pr.nodes(spark, sf_dir)
    ends = pr.edges(spark, sf_dir).filter("walk = 1 and car = 0").select("a", "b", "walk", "car").distinct()
    ends = ends.join(node.select(F.col("node").alias("a"), F.col("lat").alias("lat_a"), F.col("lon").alias("lon_a")), "a").join(node.select(F.col("node").alias("b"), F.col("lat").alias("lat_b"), F.col("lon").alias("lon_b")), "b")
    middle = ends.select("a", "b", "walk", "car", ((F.col("lat_a") + F.col("lat_b")) / 2).alias("lat"), ((F.col("lon_a") + F.col("lon_b")) / 2).alias("lon"))
    mids = pr.points(spark, sf_dir).selectExpr("point_id AS ord", "lat", "lon", "CAST(1 + point_id % 5 AS STRING) AS lev_diff", "CAST(NULL AS STRING) AS width_code", "CAST(NULL AS STRING) AS vtcl_slope", "CAST(NULL AS STRING) AS roof")
    return roads.barrier_edges(middle, mids).select("a", "b", "lev_diff")


# --- names, pages and feeds -----------------------------------------------------------------------

FULL_SQL = "translate(translate(raw, '　 ', ''), '" + names.FULL_WIDTH + "', '" + names.HALF_WIDTH.replace("'", "''") + "')"
KEYED = f"replace(translate(regexp_replace({FULL_SQL}, '[（(][^）)]*[）)]', '', 'g'), 'ケ', 'ヶ'), '・', '')"
for _word in names.SPOT_WORDS:
    KEYED = f"replace({KEYED}, '{_word}', '')"
RAW = "'市立 ' || p_name || CASE p_partkey % 4 WHEN 0 THEN '（東側）' WHEN 1 THEN '・ケＡ１' ELSE ' ルーム' END"


@query(f"SELECT p_partkey, {KEYED} AS key FROM (SELECT p_partkey, {RAW} AS raw FROM part)")
def norm_name(spark, sf_dir):
    raw = pr.table(spark, sf_dir, "part").selectExpr("p_partkey", f"{RAW} AS raw")
    return raw.select("p_partkey", names.spot_name_key(F.col("raw")).alias("key"))


@query(r"SELECT p_partkey, translate(regexp_replace(regexp_replace(raw, '[（(][^）)]*[）)]', '', 'g'), '\s+', '', 'g'), '･ヶヵ', '・ケケ') AS key FROM (SELECT p_partkey, p_name || CASE p_partkey % 3 WHEN 0 THEN '(x y)' WHEN 1 THEN 'ヶ丘' ELSE ' 前' END AS raw FROM part)")
def norm_stop_name(spark, sf_dir):
    raw = pr.table(spark, sf_dir, "part").selectExpr("p_partkey", "p_name || CASE p_partkey % 3 WHEN 0 THEN '(x y)' WHEN 1 THEN 'ヶ丘' ELSE ' 前' END AS raw")
    return raw.select("p_partkey", names.stop_name_key(F.col("raw")).alias("key"))


@query("SELECT l_orderkey, CASE WHEN len(p) = 3 THEN p[1]::INT * 3600 + p[2]::INT * 60 + p[3]::INT END AS seconds, count(*) AS n FROM (SELECT l_orderkey, string_split(CAST(l_orderkey % 30 AS STRING) || ':' || CAST(l_linenumber AS STRING) || CASE WHEN l_linenumber % 3 = 0 THEN '' ELSE ':07' END, ':') AS p FROM lineitem) GROUP BY ALL")
def clock_times(spark, sf_dir):
    text = F.expr("CAST(l_orderkey % 30 AS STRING) || ':' || CAST(l_linenumber AS STRING) || CASE WHEN l_linenumber % 3 = 0 THEN '' ELSE ':07' END")
    return pr.table(spark, sf_dir, "lineitem").groupBy("l_orderkey", clock.to_seconds(text).alias("seconds")).agg(F.count("*").alias("n"))


@query(
    r"""SELECT page_id, trim(regexp_replace(replace(replace(replace(regexp_extract(html, '<h1[^>]*>(.*?)</h1>', 1, 's'), '&quot;', '"'), '&middot;', '·'), '&amp;', '&'), '[ \t]+', ' ', 'g')) AS title FROM pages"""
)
def html_title(spark, sf_dir):
    return pr.table(spark, sf_dir, "pages").select("page_id", pages.title(F.col("html")).alias("title"))


@query(
    """SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS INT) AS ord, m AS href FROM (SELECT page_id,
    unnest(regexp_extract_all(html, '<a[^>]*?href="([^"]*)"[^>]*>', 1, 's')) AS m, generate_subscripts(regexp_extract_all(html, '<a[^>]*?href="([^"]*)"[^>]*>', 1, 's'), 1) AS i FROM pages)"""
)
def html_links(spark, sf_dir):
    return pages.links(pr.table(spark, sf_dir, "pages")).select("page_id", "ord", "href")


@query()
def html_text(spark, sf_dir):
    """Text of whole pages by the plain fragment rule."""
    return pr.table(spark, sf_dir, "pages").select("page_id", pages.text_of(F.col("html")).alias("text"))


LINKS = "links AS (SELECT DISTINCT a.page_id AS src, b.page_id AS dst FROM pages a JOIN pages b ON (a.page_id * 7 + 1) % (SELECT count(*) FROM pages) = b.page_id OR (a.page_id * 3 + 2) % (SELECT count(*) FROM pages) = b.page_id)"


@query(f"WITH RECURSIVE {LINKS}, waves(node, wave) USING KEY (node) AS (SELECT CAST(0 AS BIGINT), 0 UNION SELECT DISTINCT l.dst, w.wave + 1 FROM waves w JOIN links l ON w.node = l.src LEFT JOIN recurring.waves r ON r.node = l.dst WHERE r.node IS NULL) SELECT node AS page_id, wave FROM waves")
def crawl_frontier(spark, sf_dir):
    """Waves of a crawl over a derived link graph."""
    ids = pr.table(spark, sf_dir, "pages").select("page_id")
    n = ids.agg(F.count("*").alias("n"))
    out = ids.join(F.broadcast(n)).select(F.col("page_id").alias("src"), F.explode(F.array((F.col("page_id") * 7 + 1) % F.col("n"), (F.col("page_id") * 3 + 2) % F.col("n"))).alias("dst")).distinct()
    start = spark.range(1).select(F.lit(0).cast("long").alias("url"))
    return pages.crawl(out, start, max_pages=10**9, cut=cut).select(F.col("url").alias("page_id"), "wave")


@query("SELECT event_id, CASE WHEN event_type = 'signup' THEN '手元に無い' WHEN event_type = 'error' AND user_id % 2 = 0 THEN '更新あり' WHEN value < 10 THEN '最新' WHEN event_type = 'view' THEN '要確認' WHEN user_id % 2 = 0 THEN '最新（配信し直しただけ）' ELSE '更新あり' END AS verdict FROM events")
def feed_verdict(spark, sf_dir):
    rows = pr.table(spark, sf_dir, "events")
    local = F.when(F.col("event_type") != "signup", F.col("event_id"))
    remote = F.when(F.col("event_type") == "error", F.col("event_id") + F.when(F.col("user_id") % 2 == 0, 1).otherwise(0))
    same = F.when(F.col("event_type") != "view", F.col("user_id") % 2 == 0)
    return rows.select("event_id", feeds.verdict(local, remote, ~(F.col("value") < 10), same).alias("verdict"))


@query("SELECT user_id, epoch_us(max(ts)) AS at_us, arg_max(value, ts) AS value FROM events WHERE ts <= TIMESTAMP '2024-01-10 12:00:00' AND epoch_us(TIMESTAMP '2024-01-10 12:00:00') - epoch_us(ts) < 86400000000 GROUP BY 1")
def ttl_cache_latest(spark, sf_dir):
    """The last response per key that is no older than a day."""
    rows = pr.table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    fresh = feeds.latest_within(rows, "user_id", "ts", "value", F.to_timestamp(F.lit("2024-01-10 12:00:00")), 86_400)
    return fresh.select("user_id", F.unix_micros("ts").alias("at_us"), "value")


# --- sinks ----------------------------------------------------------------------------------------


@query(pr.with_ctes("spots", "SELECT regexp_replace(name, '[^A-Za-z0-9_-]', '_', 'g') AS file, count(*) AS n FROM spots GROUP BY 1"))
def safe_ids(spark, sf_dir):
    return pr.spots(spark, sf_dir).groupBy(names.safe_id(F.col("name")).alias("file")).agg(F.count("*").alias("n"))


@query(
    pr.with_ctes(
        "spots", f"SELECT home, radius, count(*) AS n, min(metres) AS nearest FROM (SELECT h.home, r.radius, CAST(trunc({pr.haversine_sql('h.hlat', 'h.hlon', 'lat', 'lon')}) AS INT) AS metres FROM spots, homes h, radii r WHERE {pr.haversine_sql('h.hlat', 'h.hlon', 'lat', 'lon')} <= r.radius) GROUP BY ALL",
        "homes AS (SELECT * FROM (VALUES ('a', 35.85::DOUBLE, 139.9::DOUBLE), ('b', 35.87::DOUBLE, 139.93::DOUBLE)) v(home, hlat, hlon)), radii AS (SELECT unnest([200, 1000, 3000]) AS radius)",
    )
)
def static_matrix(spark, sf_dir):
    """Every home and radius answered in one plan: what a batch materialises."""
    homes = spark.createDataFrame([("a", 35.85, 139.9), ("b", 35.87, 139.93)], "home string, hlat double, hlon double")
    radii = spark.createDataFrame([(200,), (1000,), (3000,)], "radius int")
    asked = F.broadcast(homes.join(radii))  # six rows: the dimensions of the batch
    met = pr.spots(spark, sf_dir).join(asked).withColumn("metres", geo.haversine(F.col("hlat"), F.col("hlon"), F.col("lat"), F.col("lon"))).filter("metres <= radius")
    return met.groupBy("home", "radius").agg(F.count("*").alias("n"), F.min(F.col("metres").cast("int")).alias("nearest"))


@query()
def geo_json_export(spark, sf_dir):
    """Destinations as GeoJSON features, one per row."""
    geometry = F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct("id", "name", "facility_type").alias("properties"))
    return pr.spots(spark, sf_dir).select("id", F.to_json(feature).alias("feature"))
