"""Service days, departures, transfers and round-based search over a timetable.

Tables: stop_time (feed_id, trip_id, seq, place_id, arr, dep), trip (feed_id, trip_id, route_id,
service_id, wheelchair), calendar (feed_id, service_id, mon..sun, start_date, end_date),
calendar_date (feed_id, service_id, date, exception_type), transfer (a, b, seconds). Keys are
always qualified by the feed. Times are seconds and may pass 24 hours.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from outways.functions import geo
from outways.operators.near import within_metres

BOARDING_WINDOW = 10_800
LEAST_TRANSFER, TRANSFER_M = 120, 300.0
WALK_DETOUR = 1.3
DAYS = ("mon", "tue", "wed", "thu", "fri", "sat", "sun")


def services_on(calendar: DataFrame, exceptions: DataFrame, days: DataFrame) -> DataFrame:
    """(day, feed_id, service_id, runs) for each service and asked yyyymmdd ``day``.

    An exception of the day decides (the last by ``ord``, where repeated), else the calendar
    row's span and weekday; blank bounds are open.
    """
    order = F.col("ord") if "ord" in exceptions.columns else F.lit(0)
    last = F.max(F.struct(order.alias("o"), "exception_type")).alias("e")
    special = exceptions.groupBy("feed_id", "service_id", F.col("date").alias("day")).agg(last).select("feed_id", "service_id", "day", "e.exception_type")
    services = calendar.select("feed_id", "service_id").union(exceptions.select("feed_id", "service_id")).distinct()
    asked = services.crossJoin(days.select("day").distinct()).join(calendar, ["feed_id", "service_id"], "left").join(special, ["feed_id", "service_id", "day"], "left")
    flag = F.element_at(F.array(*[F.col(d) for d in DAYS]), F.weekday(F.to_date("day", "yyyyMMdd")) + 1)
    blank = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) == ""
    regular = (blank("start_date") | (F.col("start_date") <= F.col("day"))) & (blank("end_date") | (F.col("end_date") >= F.col("day"))) & (flag == 1)
    runs = F.when(F.col("exception_type") == 2, False).when(F.col("exception_type") == 1, True).otherwise(F.coalesce(regular, F.lit(False)))
    return asked.select("day", "feed_id", "service_id", runs.alias("runs"))


def active_trips(trips: DataFrame, services: DataFrame) -> DataFrame:
    """Trips of the services that run; ``services`` of one day."""
    return trips.join(services.filter("runs"), ["feed_id", "service_id"], "left_semi")


def departures(stop_times: DataFrame, trips: DataFrame) -> DataFrame:
    """(place_id, dep, feed_id, trip_id, route_id, idx): every departure, with its trip's ordinal of the
    stop; only stops with a departure time."""
    order = Window.partitionBy("feed_id", "trip_id").orderBy("seq", "place_id")
    placed = stop_times.withColumn("idx", F.row_number().over(order) - 1)
    return placed.join(trips.select("feed_id", "trip_id", "route_id", "wheelchair"), ["feed_id", "trip_id"]).filter("dep is not null")


def indexed(stop_times: DataFrame) -> DataFrame:
    """Stop times with their ordinal in the trip and ``arr`` filled from ``dep``."""
    order = Window.partitionBy("feed_id", "trip_id").orderBy("seq", "place_id")
    return stop_times.withColumn("idx", F.row_number().over(order) - 1).withColumn("arr", F.coalesce("arr", "dep"))


def lines(departing: DataFrame) -> DataFrame:
    """(place_id, feed_id, route_id): which routes leave a place."""
    return departing.select("place_id", "feed_id", "route_id").distinct()


def next_departures(labels: DataFrame, departing: DataFrame, window: int = BOARDING_WINDOW, stroller: bool = False, of: DataFrame | None = None) -> DataFrame:
    """For each label (place_id, t) the first departure of each route from t on, within the window.

    Labels, one row for each route of their place (``of``: ``lines``, where a caller has them), and departures
    are sorted together by place, route and time; a label takes the last departure that a walk backwards in
    time has met. So the rows met are labels by routes plus departures, never labels by departures.

    Trips without room for a stroller (wheelchair '2') are passed over for one; blank ones stay.
    """
    if stroller:
        departing = departing.filter(~F.coalesce(F.col("wheelchair"), F.lit("")).eqNullSafe("2"))
    here = labels.select("place_id", "t").distinct()
    line = ["place_id", "feed_id", "route_id"]
    asked = here.join(lines(departing) if of is None else of, "place_id")
    ride = F.struct("dep", "trip_id", "idx")
    leaving = departing.join(here.select("place_id").distinct(), "place_id", "left_semi").select(*line, F.col("dep").cast("int").alias("at"), ride.alias("ride"))
    events = leaving.unionByName(asked.select(*line, F.col("t").cast("int").alias("at")), allowMissingColumns=True)
    # At one time departures come before the labels they serve, the smallest trip last.
    back = Window.partitionBy(*line).orderBy(F.desc("at"), F.col("ride").isNull(), F.desc("ride")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = events.withColumn("first", F.last("ride", ignorenulls=True).over(back)).filter(F.col("ride").isNull() & (F.col("first.dep") <= F.col("at") + window))
    return met.select("place_id", F.col("at").alias("t"), "feed_id", "route_id", "first.dep", "first.trip_id", "first.idx")


def downstream(boarded: DataFrame, stop_times: DataFrame) -> DataFrame:
    """Arrivals at later stops of the boarded trips: (from_place, from_t, place_id, arr, feed_id, trip_id, route_id, dep)."""
    later = stop_times.select("feed_id", "trip_id", F.col("idx").alias("to_idx"), F.col("place_id").alias("to_place"), F.col("arr").alias("to_arr"))
    met = boarded.join(later, ["feed_id", "trip_id"]).filter((F.col("to_idx") > F.col("idx")) & F.col("to_arr").isNotNull())
    return met.select(F.col("place_id").alias("from_place"), F.col("t").alias("from_t"), F.col("to_place").alias("place_id"), F.col("to_arr").alias("arr"), "feed_id", "trip_id", "route_id", "dep")


def nearby_transfers(places: DataFrame, metres: float = TRANSFER_M, speed: float = 80.0) -> DataFrame:
    """(a, b, seconds) between places up to ``metres`` apart, both ways: the walk at ``speed`` metres a
    minute with a detour, at least LEAST_TRANSFER. places: place_id, lat, lon."""
    other = places.select(F.col("place_id").alias("b"), "lat", "lon")
    pairs = within_metres(places.select(F.col("place_id").alias("a"), "lat", "lon"), other, metres).filter("a <> b")
    seconds = F.greatest(F.lit(LEAST_TRANSFER), (F.col("metres") * WALK_DETOUR / speed * 60).cast("int"))
    return pairs.select("a", "b", seconds.alias("seconds"))


def nearby_spots(places: DataFrame, metres: float = TRANSFER_M, speed: float = 80.0) -> tuple[DataFrame, DataFrame]:
    """The walks of ``nearby_transfers`` by spot: (place_id, spot) and (spot, b_spot, seconds).

    Places at one spot walk alike, so a search goes through spots (``walked``) and no pair of places is written out. A spot
    leads to itself too, for the places that share it.
    """
    at = places.select("place_id", F.struct("lat", "lon").alias("spot")).distinct()
    spots = at.select("spot.lat", "spot.lon").distinct().withColumn("spot", F.struct("lat", "lon"))
    pairs = nearby_transfers(spots.select(F.struct("spot", F.lit(0).alias("side")).alias("place_id"), "lat", "lon"), metres, speed)
    own = spots.select("spot", F.col("spot").alias("b_spot"), F.lit(LEAST_TRANSFER).alias("seconds"))
    return at, pairs.select("a.spot", F.col("b.spot").alias("b_spot"), "seconds").union(own)


def held_walks(transfers: DataFrame | tuple[DataFrame, DataFrame], cut) -> DataFrame | tuple[DataFrame, DataFrame]:
    """Transfers by place or by spot, cut once as every round reads them."""
    return tuple(map(cut, transfers)) if isinstance(transfers, tuple) else cut(transfers)


def walked(fresh: DataFrame, transfers: DataFrame | tuple[DataFrame, DataFrame], by: tuple[str, ...] = (), tiers: str | None = None) -> DataFrame:
    """(*by, place_id, t, from_place, from_t): where labels (*by, place_id, t) walk to.

    transfers: (a, b, seconds), of the ``tiers`` column's own where they have one, or ``nearby_spots``. By spots only the
    first label of a spot (then the smaller place) goes on, and only the first at a spot is handed to its places: no
    other is the least there. What a place is handed by itself is later than its own label.
    """
    if not isinstance(transfers, tuple):
        on = ["from_place", tiers] if tiers is not None and tiers in transfers.columns else ["from_place"]
        met = fresh.select(*by, F.col("place_id").alias("from_place"), F.col("t").alias("from_t")).join(transfers.withColumnRenamed("a", "from_place"), on)
        return met.select(*by, F.col("b").alias("place_id"), (F.col("from_t") + F.col("seconds")).cast("int").alias("t"), "from_place", "from_t")
    at, between = transfers
    first = fresh.join(at, "place_id").groupBy(*by, "spot").agg(F.min(F.struct("t", "place_id")).alias("o"))
    best = F.min(F.struct((F.col("o.t") + F.col("seconds")).cast("int").alias("t"), F.col("o.place_id").alias("from_place"), F.col("o.t").alias("from_t"))).alias("w")
    met = first.join(between, "spot").groupBy(*by, F.col("b_spot").alias("spot")).agg(best)
    return met.join(at, "spot").select(*by, "place_id", "w.t", "w.from_place", "w.from_t")


def gentler(transfers: DataFrame, speed: float = 80.0, gentle: float = 65.0) -> DataFrame:
    """The same transfers at a gentle pace."""
    return transfers.withColumn("seconds", F.floor(F.col("seconds") * speed / gentle).cast("int"))


def reachable_places(access: DataFrame, when: int, stop_times: DataFrame, departing: DataFrame, transfers: DataFrame, rounds: int = 3, budget: int | None = None, stroller: bool = False, cut=None) -> DataFrame:
    """Earliest arrival per place, with the round that found it: (place_id, t, round).

    access: (place_id, seconds); transfers: (a, b, seconds) or ``nearby_spots``. In each round every label of the last one boards the next departure of
    each route or walks a transfer; a place keeps a new label only if it is earlier than all before.
    A round is a plan of joins and one min aggregate; ``cut`` (a function of a DataFrame) ends its
    lineage, a reliable checkpoint by default.
    """
    cut = cut or (lambda df: df.checkpoint())
    limit = F.lit(when + budget if budget is not None else 2**31 - 1)
    # Every round reads them. No label is earlier than ``when`` or later than the limit, so nothing else is ever boarded or kept.
    until = F.lit(when + budget + BOARDING_WINDOW if budget is not None else 2**31 - 1)
    departing, transfers = cut(departing.filter(F.col("dep").between(F.lit(when), until))), held_walks(transfers, cut)
    timed = cut(indexed(stop_times).filter(F.col("arr") <= limit))
    of = cut(lines(departing))
    best = cut(access.groupBy("place_id").agg((F.min("seconds") + when).cast("int").alias("t")).filter(F.col("t") <= limit).withColumn("round", F.lit(0)))
    for turn in range(1, rounds + 1):
        fresh = best.filter(F.col("round") == turn - 1).select("place_id", "t")
        rides = downstream(next_departures(fresh, departing, stroller=stroller, of=of), timed).select("place_id", F.col("arr").alias("t"))
        walks = walked(fresh, transfers).select("place_id", "t")
        new = rides.union(walks).groupBy("place_id").agg(F.min("t").cast("int").alias("t")).filter(F.col("t") <= limit).withColumn("round", F.lit(turn))
        ranked = best.union(new.select("place_id", "t", "round")).groupBy("place_id").agg(F.min(F.struct("t", "round")).alias("b"))
        best = cut(ranked.select("place_id", "b.t", "b.round"))
    return best


def search_labels(access: DataFrame, when: int, stop_times: DataFrame, departing: DataFrame, transfers: DataFrame, rounds: int = 3, stroller: bool = False, cut=None) -> DataFrame:
    """Labels with back-pointers: (round, place_id, t, from_round, from_place, how, feed_id, trip_id, route_id, dep).

    Ties go to the smaller (feed, trip, place) so that results are the same on every run.
    """
    cut = cut or (lambda df: df.checkpoint())
    none = lambda kind: F.lit(None).cast(kind)
    feed, trip, route = (stop_times.schema["feed_id"].dataType, stop_times.schema["trip_id"].dataType, departing.schema["route_id"].dataType)
    start = access.groupBy("place_id").agg((F.min("seconds") + when).cast("int").alias("t"))
    place = start.schema["place_id"].dataType
    labels = cut(
        start.select(F.lit(0).alias("round"), "place_id", "t", none(place).alias("from_place"), F.lit("access").alias("how"), none(feed).alias("feed_id"), none(trip).alias("trip_id"), none(route).alias("route_id"), none("int").alias("dep"))
    )
    # Every round reads them; no label is earlier than ``when``.
    departing, transfers, timed = cut(departing.filter(F.col("dep") >= when)), held_walks(transfers, cut), cut(indexed(stop_times))
    of = cut(lines(departing))
    for turn in range(1, rounds + 1):
        best = labels.groupBy("place_id").agg(F.min("t").alias("best"))
        fresh = labels.filter(F.col("round") == turn - 1).select("place_id", "t")
        rides = downstream(next_departures(fresh, departing, stroller=stroller, of=of), timed).select("place_id", F.col("arr").cast("int").alias("t"), "from_place", F.lit("ride").alias("how"), "feed_id", "trip_id", "route_id", F.col("dep").cast("int").alias("dep"))
        walks = walked(fresh, transfers).select("place_id", "t", "from_place", F.lit("walk").alias("how"), none(feed).alias("feed_id"), none(trip).alias("trip_id"), none(route).alias("route_id"), F.col("from_t").alias("dep"))
        new = rides.union(walks).groupBy("place_id").agg(F.min(F.struct("t", "how", "feed_id", "trip_id", "from_place", "route_id", "dep")).alias("b"))
        new = new.join(best, "place_id", "left").filter(F.col("best").isNull() | (F.col("b.t") < F.col("best")))
        labels = cut(labels.union(new.select(F.lit(turn).alias("round"), "place_id", "b.t", "b.from_place", "b.how", "b.feed_id", "b.trip_id", "b.route_id", "b.dep")))
    return labels


def itineraries(labels: DataFrame, egress: DataFrame, rounds: int = 3) -> DataFrame:
    """Best itinerary per round and end place: (round, place_id, arrive, legs array), those with a ride.

    Back-pointers are followed by one self join per round.
    """
    step = labels.select(*[F.col(c).alias(f"p_{c}") for c in labels.columns])
    path = labels.join(egress.withColumnRenamed("seconds", "egress"), "place_id").select(
        "round", "place_id", (F.col("t") + F.col("egress")).alias("arrive"), F.col("round").alias("at_round"), F.col("place_id").alias("at_place"),
        F.array().cast("array<struct<how:string,from_place:string,to_place:string,trip:string,dep:int,arr:int>>").alias("legs"),
    )
    for _ in range(rounds):
        met = path.join(step, (F.col("at_round") == F.col("p_round")) & (F.col("at_place") == F.col("p_place_id")), "left")
        leg = F.struct(
            F.col("p_how").alias("how"), F.col("p_from_place").cast("string").alias("from_place"), F.col("at_place").cast("string").alias("to_place"),
            F.col("p_trip_id").cast("string").alias("trip"), F.col("p_dep").alias("dep"), F.col("p_t").alias("arr"),
        )
        moved = F.coalesce(F.col("p_from_place").isNotNull(), F.lit(False))
        path = met.select(
            "round", "place_id", "arrive", F.when(moved, F.col("at_round") - 1).otherwise(F.col("at_round")).alias("at_round"),
            F.when(moved, F.col("p_from_place")).otherwise(F.col("at_place")).alias("at_place"), F.when(moved, F.concat(F.array(leg), "legs")).otherwise(F.col("legs")).alias("legs"),
        )
    rode = F.exists("legs", lambda leg: leg["how"] == "ride")
    return path.filter(rode).select("round", "place_id", "arrive", "legs")


def signatures(found: DataFrame) -> DataFrame:
    """Of itineraries with the same rides the one that arrives first."""
    sig = F.array_join(F.transform(F.filter("legs", lambda leg: leg["how"] == "ride"), lambda leg: leg["trip"]), ">")
    first = Window.partitionBy("signature").orderBy("arrive", F.size("legs"), "place_id")
    return found.withColumn("signature", sig).withColumn("__r", F.row_number().over(first)).filter("__r = 1").drop("__r")


def start_times(access: DataFrame, when: int, departing: DataFrame, window: int = BOARDING_WINDOW, limit: int = 12) -> DataFrame:
    """The first ``limit`` useful times to leave: now, and what just catches a departure."""
    caught = access.join(departing, "place_id").select((F.col("dep") - F.col("seconds")).cast("int").alias("start")).filter(F.col("start").between(when, when + window))
    now = access.sparkSession.range(1).select(F.lit(when).alias("start"))
    return now.union(caught).distinct().orderBy("start").limit(limit)


def representative_trips(stop_times: DataFrame, trips: DataFrame) -> DataFrame:
    """(feed_id, route_id, trip_id, stops): the trip with the most stops, at least two; the first on ties."""
    counts = stop_times.groupBy("feed_id", "trip_id").agg(F.count("*").alias("stops")).filter("stops >= 2").join(trips, ["feed_id", "trip_id"])
    best = F.min(F.struct((-F.col("stops")).alias("minus"), "trip_id")).alias("best")
    return counts.groupBy("feed_id", "route_id").agg(best).select("feed_id", "route_id", "best.trip_id", (-F.col("best.minus")).alias("stops"))


def network_counts(stop_times: DataFrame, trips: DataFrame) -> DataFrame:
    """Per place: routes, feeds and trips that stop there."""
    met = stop_times.join(trips.select("feed_id", "trip_id", "route_id"), ["feed_id", "trip_id"])
    return met.groupBy("place_id").agg(F.countDistinct("route_id").alias("routes"), F.countDistinct("feed_id").alias("feeds"), F.countDistinct("trip_id").alias("trips"))


def feed_stats(trips: DataFrame, stop_times: DataFrame, routes: DataFrame) -> DataFrame:
    """Per feed: routes, trips, stops, and its most common route type (the smallest on ties)."""
    kinds = routes.groupBy("feed_id", "route_type").agg(F.count("*").alias("n")).groupBy("feed_id").agg(F.max(F.struct("n", (-F.col("route_type")).alias("minus"))).alias("b"))
    out = routes.groupBy("feed_id").agg(F.countDistinct("route_id").alias("routes"))
    out = out.join(trips.groupBy("feed_id").agg(F.countDistinct("trip_id").alias("trips")), "feed_id", "left")
    out = out.join(stop_times.groupBy("feed_id").agg(F.countDistinct("place_id").alias("stops")), "feed_id", "left")
    return out.join(kinds, "feed_id").select("feed_id", "routes", F.coalesce("trips", F.lit(0)).alias("trips"), F.coalesce("stops", F.lit(0)).alias("stops"), (-F.col("b.minus")).alias("route_type"))


def access_times(places: DataFrame, lat: float, lon: float, limit_m: float = 1500.0, top: int | None = None, speed: float = 80.0, max_seconds: int = 1200) -> DataFrame:
    """(place_id, seconds) of the places near a spot on foot, straight with a detour: all of them, or the ``top`` nearest."""
    metres = geo.haversine(lat, lon, F.col("lat"), F.col("lon"))
    near = places.withColumn("metres", metres).filter(F.col("metres") <= limit_m)
    if top is not None:
        near = near.orderBy("metres", "place_id").limit(top)
    return near.select("place_id", (F.col("metres") * WALK_DETOUR / speed * 60).cast("int").alias("seconds")).filter(F.col("seconds") <= max_seconds)
