"""Queries on reach by public transport and walks between stops, registered beside those of ``queries``.

Their roads are streets between points: points stand in rows some 90 metres apart, and rows some 570 metres from each other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outways.functions import names
from outways.operators import reach, roads, timetable
from outways.plans import projections as pr
from outways.plans import queries as q
from outways.plans.profiles import MODES, Profile

#: From a point to the next one of its row, to the row beside it, and to the point that stands where it stands.
STEPS = (321, 369, 1000)
ENDS = [f"({at(end)})" for end in "ab" for at in (pr.lat, pr.lon)]
LENGTH = f"CAST(greatest(20, floor({pr.haversine_sql(*ENDS)})) AS DOUBLE) AS length"
STREET_KEYS = "c_custkey AS a, c_custkey + step AS b, c_custkey * 7 + step AS k"
STREETS = [LENGTH if e.endswith(" AS length") else e for e in pr.EDGES]
CORNERS = ["c_custkey AS node", f"{pr.lat('c_custkey')} AS lat", f"{pr.lon('c_custkey')} AS lon"]
STREETS_SQL = (
    f"raw_streets AS (SELECT {STREET_KEYS} FROM customer, (SELECT unnest({list(STEPS)}) AS step)), streets AS (SELECT {', '.join(STREETS)} FROM raw_streets WHERE b IN (SELECT c_custkey FROM customer)), "
    f"corners AS (SELECT {', '.join(CORNERS)} FROM customer)"
)


def corners(spark, sf_dir) -> DataFrame:
    return pr.table(spark, sf_dir, "customer").selectExpr(*CORNERS)


def streets(spark, sf_dir) -> DataFrame:
    """Edges with all that their costs ask for; cut once, as each profile reads them."""
    points = pr.table(spark, sf_dir, "customer").select("c_custkey")
    # One small file of points becomes many edges, whose costs are dear: they are spread first.
    raw = points.withColumn("step", F.explode(F.array(*[F.lit(s) for s in STEPS]))).selectExpr(*STREET_KEYS.split(", ")).repartition("a")
    edges = raw.join(points.withColumnRenamed("c_custkey", "b"), "b", "left_semi").selectExpr(*STREETS)
    tags = F.map_filter(F.create_map(F.lit("kerb"), F.col("kerb"), F.lit("barrier"), F.col("barrier")), lambda _, v: v.isNotNull())
    return q.cut(edges.withColumn("attrs", names.packed_map(F.col("packed"))).withColumn("to_tags", tags))


def street_arcs(edges: DataFrame, profile: Profile) -> DataFrame:
    """Both ways at the edge's cost in whole seconds."""
    costed = edges.select("a", "b", F.ceil(roads.edge_seconds(profile)).cast("double").alias("cost"))
    return costed.union(costed.select(F.col("b"), F.col("a"), "cost"))


def _arcs_sql(name: str, profile: Profile) -> str:
    cost = f"ceil({q.cost_sql(profile)})"
    return f"{name} AS (SELECT a, b, min(cost) AS cost FROM (SELECT a, b, {cost} AS cost FROM streets UNION ALL SELECT b, a, {cost} FROM streets) WHERE cost IS NOT NULL GROUP BY ALL)"


def _usable_sql(name: str, arcs: str) -> str:
    return f"{name} AS (SELECT node, lat, lon FROM corners SEMI JOIN (SELECT a AS node FROM {arcs} UNION SELECT b FROM {arcs}) USING (node))"


def _recursive(tables: str, body: str, *more: str) -> str:
    return pr.with_ctes(tables, body, ", ".join([STREETS_SQL, *more])).replace("WITH ", "WITH RECURSIVE ", 1)


# --- walks between stops -----------------------------------------------------------------------------

TIERS = {"stroller": MODES["stroller"], "normal": MODES["walk"]}
PAIR_D = pr.haversine_sql("p.lat", "p.lon", "n.lat", "n.lon")


def _tier_sql(tier: str, profile: Profile) -> tuple[str, ...]:
    t = tier[0]
    return (
        _arcs_sql(f"arcs_{t}", profile), _usable_sql(f"usable_{t}", f"arcs_{t}"),
        f"at_{t} AS (SELECT place_id, arg_min(node, (d, node)) AS node, min(d) AS metres FROM (SELECT p.place_id, n.node, {PAIR_D} AS d FROM asked p JOIN usable_{t} n ON abs(p.lat - n.lat) < 0.006 AND abs(p.lon - n.lon) < 0.006) WHERE d < 400 GROUP BY 1)",
        f"from_{t}(start, node, cost) USING KEY (start, node) AS (SELECT DISTINCT node, node, 0.0::DOUBLE FROM at_{t} UNION SELECT n.start, n.node, n.cost FROM (SELECT s.start, a.b AS node, min(s.cost + a.cost) AS cost FROM from_{t} s JOIN arcs_{t} a ON s.node = a.a GROUP BY 1, 2) n "
        f"LEFT JOIN recurring.from_{t} r ON r.start = n.start AND r.node = n.node WHERE n.cost <= 600 AND (r.cost IS NULL OR n.cost < r.cost))",
        f"rows_{t} AS (SELECT '{tier}' AS tier, p.a, p.b, CAST(trunc(s.cost + e.metres / 80.0::DOUBLE * 60) AS INT) AS seconds FROM close p JOIN at_{t} o ON o.place_id = p.a JOIN at_{t} e ON e.place_id = p.b AND e.metres < 250 "
        f"JOIN from_{t} s ON s.start = o.node AND s.node = e.node WHERE s.cost + e.metres / 80.0::DOUBLE * 60 <= 600)",
    )


@q.query(
    _recursive(
        "places",
        "SELECT * FROM rows_s UNION ALL SELECT * FROM rows_n UNION ALL SELECT 'gentle', a, b, CAST(trunc(seconds * (80.0::DOUBLE / 65.0::DOUBLE)) AS INT) FROM rows_n",
        f"close AS (SELECT p.place_id AS a, n.place_id AS b FROM places p JOIN places n ON abs(p.lat - n.lat) < 0.005 AND p.place_id <> n.place_id WHERE {PAIR_D} <= 400)", "asked AS (SELECT * FROM places WHERE place_id IN (SELECT a FROM close))",
        *[part for tier, profile in TIERS.items() for part in _tier_sql(tier, profile)],
    )
)
def road_transfers(spark, sf_dir):
    """Walks on the streets between places near each other: for strollers, at the usual and at a gentle pace."""
    edges = streets(spark, sf_dir)
    return reach.road_transfers(pr.places(spark, sf_dir), corners(spark, sf_dir), {tier: street_arcs(edges, profile) for tier, profile in TIERS.items()}, cut=q.cut)


# --- reach by public transport -----------------------------------------------------------------------

#: Two of them are cut to the limits.
ASKED = (("m03", 3), ("m15", 15), ("m30", 30), ("m90", 90))


def questions(spark) -> DataFrame:
    rows = spark.createDataFrame(list(ASKED), "ask string, minutes int")
    return reach.asked(rows.withColumn("lat", F.lit(q.LAT)).withColumn("lon", F.lit(q.LON)))


def _transit(spark, sf_dir, top: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The questions, the places in time, the nodes and the cells of each; from all places near home, or the ``top`` nearest."""
    asks = q.cut(questions(spark))
    arrived = q._reached(spark, sf_dir, reach.MOST_MINUTES * 60, top).select("place_id", (F.col("t") - q.WHEN).alias("used"))
    arrivals = q.cut(arrived.join(pr.places(spark, sf_dir), "place_id").join(asks.select("ask", "budget"), F.col("used") <= F.col("budget")).select("ask", "place_id", "lat", "lon", "used"))
    nodes = q.cut(corners(spark, sf_dir))
    reached = q.cut(reach.reached_nodes(reach.seeds(asks, arrivals), nodes, street_arcs(streets(spark, sf_dir), MODES["walk"]), cut=q.cut))
    return asks, arrivals, reached, q.cut(reach.question_cells(asks, reached, nodes))


ASKS_SQL = (
    "asks AS (SELECT *, CASE WHEN minutes <= 20 THEN 100 WHEN minutes <= 40 THEN 150 ELSE 200 END AS cell_m, minutes * 60 AS budget FROM (SELECT ask, greatest(5, least(m, 60)) AS minutes FROM (VALUES "
    + ", ".join(f"('{a}', {m})" for a, m in ASKED)
    + f") v(ask, m))), sized AS (SELECT *, cell_m / 111000.0::DOUBLE AS dlat, cell_m / (111000.0::DOUBLE * cos(radians({q.LAT}::DOUBLE))) AS dlon FROM asks)"
)
ALL_TRANSIT_SQL = (
    ASKS_SQL, q.ALL_RAPTOR, _arcs_sql("arcs", MODES["walk"]), _usable_sql("usable", "arcs"),
    f"arrived AS (SELECT ask, place_id, lat, lon, t - {q.WHEN} AS used, budget FROM l3 JOIN places USING (place_id) JOIN asks ON t - {q.WHEN} <= budget)",
    f"seeds AS (SELECT ask, lat, lon, used, budget FROM arrived UNION ALL SELECT ask, {q.LAT}::DOUBLE, {q.LON}::DOUBLE, 0, budget FROM asks)",
    f"spots AS (SELECT lat, lon, arg_min(node, (d, node)) AS node, min(d) AS metres FROM (SELECT p.lat, p.lon, n.node, {PAIR_D} AS d FROM (SELECT DISTINCT lat, lon FROM seeds) p JOIN usable n ON abs(p.lat - n.lat) < 0.006 AND abs(p.lon - n.lon) < 0.006) WHERE d < 300 GROUP BY ALL)",
    "begun AS (SELECT ask, node, budget, min(cost) AS cost FROM (SELECT ask, node, budget, used + metres / 80.0::DOUBLE * 60 AS cost FROM seeds JOIN spots USING (lat, lon)) WHERE cost <= budget GROUP BY ALL)",
    "search(ask, node, cost) USING KEY (ask, node) AS (SELECT ask, node, cost FROM begun UNION SELECT n.ask, n.node, n.cost FROM (SELECT s.ask, a.b AS node, min(s.cost + a.cost) AS cost FROM search s JOIN arcs a ON s.node = a.a GROUP BY 1, 2) n JOIN asks q USING (ask) "
    "LEFT JOIN recurring.search r ON r.ask = n.ask AND r.node = n.node WHERE n.cost <= q.budget AND (r.cost IS NULL OR n.cost < r.cost))",
    f"two AS (SELECT DISTINCT s.ask AS mode, CAST(floor(p.lat / s.dlat) AS BIGINT) AS y, CAST(floor(p.lon / s.dlon) AS BIGINT) AS x FROM (SELECT ask, lat, lon FROM search JOIN corners USING (node) UNION ALL SELECT ask, {q.LAT}::DOUBLE, {q.LON}::DOUBLE FROM asks) p JOIN sized s USING (ask))",
    q.FLOOD,
    "sides AS (SELECT mode, 2 * y + dy AS sy, 2 * x + dx AS sx FROM filled, (VALUES (0, 1), (0, -1), (1, 0), (-1, 0)) v(dy, dx)), border AS (SELECT mode AS ask, count(*) AS border FROM (SELECT mode FROM sides GROUP BY mode, sy, sx HAVING count(*) = 1) GROUP BY 1)",
)
TRANSIT_SQL = tuple(q.RAPTOR if part == q.ALL_RAPTOR else part for part in ALL_TRANSIT_SQL)


@q.query(
    _recursive(
        "stop_times trips places",
        "SELECT a.ask, CAST(a.minutes AS INT) AS minutes, CAST(a.cell_m AS INT) AS cell_m, coalesce(p.n, 0) AS places, coalesce(s.n, 0) AS reached_nodes, c.n AS cells, round(c.n * pow(a.cell_m / 1000.0::DOUBLE, 2), 4) AS area_km2, c.n AS outlined, b.border FROM asks a "
        "LEFT JOIN (SELECT ask, count(*) AS n FROM arrived GROUP BY 1) p USING (ask) LEFT JOIN (SELECT ask, count(*) AS n FROM search GROUP BY 1) s USING (ask) JOIN (SELECT mode AS ask, count(*) AS n FROM filled GROUP BY 1) c USING (ask) JOIN border b USING (ask)",
        *ALL_TRANSIT_SQL,
    )
)
def isochrone_transit(spark, sf_dir):
    """What public transport and walking reach from home by time limit: places, nodes, cells, and the area and length of the outlines."""
    asks, arrivals, reached, cells = _transit(spark, sf_dir)
    count = lambda df, name: df.groupBy("ask").agg(F.count("*").alias(name))
    along = F.aggregate(F.zip_with(F.slice(F.concat("points", F.slice("points", 1, 1)), F.lit(2), F.size("points")), "points", lambda b, a: F.abs(b["y"] - a["y"]) + F.abs(b["x"] - a["x"])), F.lit(0).cast("long"), lambda s, n: s + n)
    drawn = reach.outlines(cells).groupBy("ask").agg(F.sum("cells").alias("outlined"), F.sum(along).alias("border"))
    told = asks.join(count(cells, "cells"), "ask").join(drawn, "ask").join(count(arrivals, "places"), "ask", "left").join(count(reached, "reached_nodes"), "ask", "left")
    none = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    return told.select("ask", "minutes", F.col("cell_m").cast("int").alias("cell_m"), none("places"), none("reached_nodes"), "cells", F.round(F.col("cells") * F.pow(F.col("cell_m") / 1000.0, F.lit(2.0)), 4).alias("area_km2"), "outlined", "border")


@q.query(_recursive("stop_times trips places", "SELECT mode AS ask, y, x FROM filled", *TRANSIT_SQL))
def isochrone_transit_cells(spark, sf_dir):
    """The cells of each time limit, with those that they enclose."""
    return _transit(spark, sf_dir, q.NEAREST)[3]


ROAD_CELL = 0.01


@q.query(
    _recursive(
        "places",
        "SELECT a, b, walk, bike, car FROM held UNION ALL SELECT b, a, walk, bike, CASE WHEN oneway = 1 THEN 0 ELSE car END FROM held",
        f"wanted AS (SELECT DISTINCT unnest(range(CAST(floor((lat - 500 / 111000.0::DOUBLE) / {ROAD_CELL}::DOUBLE) AS BIGINT), CAST(floor((lat + 500 / 111000.0::DOUBLE) / {ROAD_CELL}::DOUBLE) AS BIGINT) + 1)) AS y, lon, lat FROM places)",
        f"cells AS (SELECT DISTINCT y, unnest(range(CAST(floor((lon - 500 / (111000.0::DOUBLE * cos(radians(lat)))) / {ROAD_CELL}::DOUBLE) AS BIGINT), CAST(floor((lon + 500 / (111000.0::DOUBLE * cos(radians(lat)))) / {ROAD_CELL}::DOUBLE) AS BIGINT) + 1)) AS x FROM wanted)",
        f"loaded AS (SELECT DISTINCT CAST(floor(lat / {ROAD_CELL}::DOUBLE) AS BIGINT) AS y, CAST(floor(lon / {ROAD_CELL}::DOUBLE) AS BIGINT) AS x FROM places WHERE nation = 7)",
        f"held AS (SELECT s.* FROM streets s JOIN corners n ON n.node = s.a JOIN (SELECT * FROM cells ANTI JOIN loaded USING (y, x)) c ON c.y = CAST(floor(n.lat / {ROAD_CELL}::DOUBLE) AS BIGINT) AND c.x = CAST(floor(n.lon / {ROAD_CELL}::DOUBLE) AS BIGINT))",
    )
)
def roads_within(spark, sf_dir):
    """The streets in cells round places, both ways, but for the cells in which a nation has its own."""
    cell = lambda c: F.floor(F.col(c) / ROAD_CELL).cast("long")
    places, at = pr.places(spark, sf_dir), corners(spark, sf_dir).select(F.col("node").alias("a"), cell("lat").alias("y"), cell("lon").alias("x"))
    loaded = places.filter("nation = 7").select(cell("lat").alias("y"), cell("lon").alias("x")).distinct()
    held = reach.roads_within(streets(spark, sf_dir).join(at, "a"), reach.wanted_cells(places, 500.0, ROAD_CELL, loaded))
    return held.select("a", "b", "walk", "bike", "car")
