"""Lines on the map: shapes of trips, parts of them that are ridden, rail lines, and a line per route."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outways.functions import geo, labels, shapes

RAIL_TYPES = (0, 1, 2, 5, 7, 12)


def trip_shapes(shape_points: DataFrame) -> DataFrame:
    """(feed_id, shape_id, line) of the points (feed_id, shape_id, seq, lat, lon), in order."""
    points = F.array_sort(F.collect_list(F.struct("seq", "lon", "lat")))
    return shape_points.groupBy("feed_id", "shape_id").agg(F.transform(points, lambda p: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat"))).alias("line"))


def _dense(line: Column, step: float = 0.015) -> Column:
    """Points along a line at most ``step`` degrees apart."""
    legs = F.zip_with(F.slice(line, F.lit(1), F.size(line) - 1), F.slice(line, F.lit(2), F.size(line) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))

    def points(leg: Column) -> Column:
        dx, dy = leg["b"]["lon"] - leg["a"]["lon"], leg["b"]["lat"] - leg["a"]["lat"]
        n = F.ceil(F.greatest(F.abs(dx), F.abs(dy)) / step).cast("int") + 1
        return F.transform(F.sequence(F.lit(0), n), lambda i: F.struct((leg["a"]["lon"] + dx * i / n).alias("lon"), (leg["a"]["lat"] + dy * i / n).alias("lat")))

    return F.flatten(F.transform(legs, points))


def matched_rails(hops: DataFrame, rails: DataFrame) -> DataFrame:
    """(hop, part): each hop's part of a rail line, null where none fits.

    hops: hop, name, operator, f_lat, f_lon, t_lat, t_lon; rails: rail, name, operator, line. The lines of
    the hop's name are looked at, else those of its operator, else all; of these the one that both
    stations lie nearest to. Rail lines of a stage are some dozens: they meet by name and operator
    in equi joins, and only hops that found neither meet all that lie in a cell with them.
    """
    bare = hops.select("hop", F.col("name").alias("h_name"), F.col("operator").alias("h_operator"), "f_lat", "f_lon", "t_lat", "t_lon")
    named = bare.join(rails.filter("name <> ''"), F.col("h_name") == F.col("name")).select(*bare.columns, "rail", "line")
    rest = bare.join(named.select("hop").distinct(), "hop", "left_anti")
    operated = rest.join(rails.filter("operator <> ''"), F.col("h_operator") == F.col("operator")).select(*bare.columns, "rail", "line")
    lost = rest.join(operated.select("hop").distinct(), "hop", "left_anti")
    # A line within RAIL_SNAP_M of a station passes its cell of 0.02 degrees or one beside it.
    cells = lambda lat, lon: F.struct(geo.cell(lat, 0.02).alias("y"), geo.cell(lon, 0.02).alias("x"))
    dense = rails.select("rail", F.explode(_dense(F.col("line"))).alias("p"))
    passed = dense.select("rail", F.explode(geo.neighbours(geo.cell(F.col("p.lat"), 0.02), geo.cell(F.col("p.lon"), 0.02), 1)).alias("c")).distinct()
    anywhere = lost.withColumn("c", cells(F.col("f_lat"), F.col("f_lon"))).join(passed, "c").join(rails.select("rail", "line"), "rail").select(*bare.columns, "rail", "line")
    fits = shapes.rail_slice(F.col("line"), F.col("f_lat"), F.col("f_lon"), F.col("t_lat"), F.col("t_lon"))
    found = named.unionByName(operated).unionByName(anywhere).withColumn("fit", fits).filter("fit is not null")
    best = found.groupBy("hop").agg(F.min(F.struct(F.col("fit.far").alias("far"), "rail", F.col("fit.part").alias("part"))).alias("b"))
    return hops.select("hop").join(best, "hop", "left").select("hop", F.col("b.part").alias("part"))


def ride_lines(rides: DataFrame, trips: DataFrame, shaped: DataFrame, rails: DataFrame) -> DataFrame:
    """(ride, coords, shape): the ridden line, from the trip's shape (gtfs), else a rail line (osm), else straight
    (stops).

    rides: ride, feed_id, trip_id, route_type, name, operator, f_lat, f_lon, t_lat, t_lon, seconds; trips:
    feed_id, trip_id, shape_id; shaped: ``trip_shapes``.
    """
    own = rides.join(trips.select("feed_id", "trip_id", "shape_id"), ["feed_id", "trip_id"], "left").join(shaped, ["feed_id", "shape_id"], "left")
    cut = shapes.ride_slice(F.col("line"), F.col("f_lat"), F.col("f_lon"), F.col("t_lat"), F.col("t_lon"), F.col("seconds"))
    own = own.select("ride", "route_type", "name", "operator", "f_lat", "f_lon", "t_lat", "t_lon", F.when(F.col("line").isNotNull(), cut).alias("gtfs"))
    by_rail = matched_rails(own.filter(F.col("gtfs").isNull() & F.col("route_type").isin(*RAIL_TYPES)).withColumnRenamed("ride", "hop"), rails).select(F.col("hop").alias("ride"), "part")
    point = lambda lat, lon: F.struct(F.col(lon).alias("lon"), F.col(lat).alias("lat"))
    return own.join(by_rail, "ride", "left").select(
        "ride", F.coalesce("gtfs", "part", F.array(point("f_lat", "f_lon"), point("t_lat", "t_lon"))).alias("coords"),
        F.when(F.col("gtfs").isNotNull(), "gtfs").when(F.col("part").isNotNull(), "osm").otherwise("stops").alias("shape"),
    )


def route_lines(representative: DataFrame, stop_times: DataFrame, stops: DataFrame, routes: DataFrame, trips: DataFrame, shaped: DataFrame, rails: DataFrame) -> DataFrame:
    """(feed_id, route_id, kind, shape, stops, coords): one line a route, of its representative trip: its shape
    (gtfs), else its stops with rail lines between them (osm where at least half of the hops found
    one, mixed where some did), else its stops joined (stops).

    representative: feed_id, route_id, trip_id, stops; stop_times: feed_id, trip_id, seq, place_id; stops:
    place_id, lat, lon; routes: feed_id, route_id, route_type, name, operator.
    """
    chosen = representative.join(routes, ["feed_id", "route_id"], "left").join(trips.select("feed_id", "trip_id", "shape_id"), ["feed_id", "trip_id"], "left").join(shaped, ["feed_id", "shape_id"], "left")
    keys = ["feed_id", "route_id"]
    visits = chosen.join(stop_times.select("feed_id", "trip_id", "seq", "place_id"), ["feed_id", "trip_id"]).join(stops.select("place_id", "lat", "lon"), "place_id")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("seq", "lon", "lat"))), lambda p: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat")))
    joined = visits.groupBy(*keys).agg(ordered.alias("at")).select(*keys, shapes.without_repeats(F.col("at")).alias("at"))
    base = chosen.select(*keys, "stops", "route_type", "name", "operator", F.when(F.size("line") >= 2, F.col("line")).alias("line")).join(joined, keys)
    hops = base.filter(F.col("line").isNull() & F.col("route_type").isin(*RAIL_TYPES) & (F.size("at") >= 2))
    hops = hops.select(*keys, "name", "operator", F.posexplode(F.arrays_zip(F.slice("at", F.lit(1), F.size("at") - 1).alias("a"), F.slice("at", F.lit(2), F.size("at") - 1).alias("b"))).alias("i", "h"))
    hops = hops.select(F.struct(*keys, "i").alias("hop"), "name", "operator", *[F.col(f"h.{e}.{c}").alias(f"{n}_{c}") for e, n in (("a", "f"), ("b", "t")) for c in ("lat", "lon")])
    matched = hops.select("hop", F.struct(F.col("t_lon").alias("lon"), F.col("t_lat").alias("lat")).alias("end")).join(matched_rails(hops, rails), "hop")
    hit = F.col("part").isNotNull() & (F.size("part") > 2)
    piece = F.when(hit, F.slice("part", F.lit(2), F.size("part"))).otherwise(F.array("end"))
    railed = matched.select(F.col("hop.feed_id").alias("feed_id"), F.col("hop.route_id").alias("route_id"), F.col("hop.i").alias("i"), piece.alias("piece"), hit.cast("int").alias("hit"))
    railed = railed.groupBy(*keys).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("i", "piece"))), lambda x: x["piece"])).alias("pieces"), F.sum("hit").alias("hits"), F.count("*").alias("hops"))
    out = base.join(railed, keys, "left")
    line = F.when(F.col("line").isNotNull(), F.col("line")).when(F.col("hits") > 0, F.concat(F.slice("at", 1, 1), "pieces")).otherwise(F.col("at"))
    shape = F.when(F.col("line").isNotNull(), "gtfs").when((F.col("hits") > 0) & (F.col("hits") * 2 >= F.col("hops")), "osm").when(F.col("hits") > 0, "mixed").otherwise("stops")
    return out.select(*keys, labels.route_kind(F.col("route_type")).alias("kind"), shape.alias("shape"), "stops", line.alias("coords")).filter(F.size("coords") >= 2)


def places_served(representative: DataFrame, stop_times: DataFrame, routes: DataFrame) -> DataFrame:
    """(place_id, kind, feeds array): places that a representative trip stops at; train where any is one."""
    kinds = representative.join(routes.select("feed_id", "route_id", labels.route_kind(F.col("route_type")).alias("kind")), ["feed_id", "route_id"])
    met = stop_times.select("feed_id", "trip_id", "place_id").join(kinds.select("feed_id", "trip_id", "kind"), ["feed_id", "trip_id"])
    return met.groupBy("place_id").agg(F.max("kind").alias("kind"), F.sort_array(F.collect_set("feed_id")).alias("feeds"))


def feed_summary(lines: DataFrame, served: DataFrame) -> DataFrame:
    """(feed_id, kind, routes, stops, by_shape map) from ``route_lines`` and ``places_served``."""
    shaped = lines.groupBy("feed_id", "shape").agg(F.count("*").alias("n")).groupBy("feed_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("shape", "n")))).alias("by_shape"))
    own = lines.groupBy("feed_id").agg(F.max("kind").alias("kind"), F.count("*").alias("routes"))
    stops = served.select(F.explode("feeds").alias("feed_id")).groupBy("feed_id").agg(F.count("*").alias("stops"))
    return own.join(shaped, "feed_id").join(stops, "feed_id", "left").select("feed_id", "kind", "routes", F.coalesce("stops", F.lit(0)).alias("stops"), "by_shape")


def shape_histogram(feeds: DataFrame) -> DataFrame:
    """(shape, routes) over all feeds of ``feed_summary``."""
    return feeds.select(F.explode("by_shape").alias("shape", "n")).groupBy("shape").agg(F.sum("n").alias("routes"))


def overlay_counts(lines: DataFrame, served: DataFrame) -> DataFrame:
    """One row: train, bus, train_stops, bus_stops."""
    of = lambda df, kind, name: df.agg(F.count(F.when(F.col("kind") == kind, 1)).alias(name))
    out = of(lines, "train", "train")
    for df, kind, name in ((lines, "bus", "bus"), (served, "train", "train_stops"), (served, "bus", "bus_stops")):
        out = out.crossJoin(of(df, kind, name))
    return out


def walk_box(nodes: DataFrame, margin: float = 0.005) -> DataFrame:
    """One row: the box of a road graph with a margin."""
    low, high = lambda c: (F.min(c) - margin).alias(f"{c}_min"), lambda c: (F.max(c) + margin).alias(f"{c}_max")
    return nodes.agg(low("lat"), high("lat"), low("lon"), high("lon"))


def ring_box(rings: Column) -> Column:
    """(lon_min, lat_min, lon_max, lat_max) of an array of rings."""
    at = lambda name: F.flatten(F.transform(rings, lambda r: F.transform(r, lambda p: p[name])))
    return F.struct(F.array_min(at("lon")).alias("lon_min"), F.array_min(at("lat")).alias("lat_min"), F.array_max(at("lon")).alias("lon_max"), F.array_max(at("lat")).alias("lat_max"))
