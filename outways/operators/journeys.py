"""Journeys by timetable over many questions and departure times at once.

A question (``ask``) is a pair of ends with a way of travelling. Its search hangs on where, when and how it
begins alone (``src``), which many questions may share; all searches and all their times to leave
(``starts``) run in the same rounds, and what boards at the same place and time is expanded once for all of
them. A label is the earliest arrival of a start at a place by a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from outways.operators import timetable

# Kinds of routes, how much longer or later than the best a journey may be, how much farther a
# relaxed search walks, walks too short to be shown, and what is said of a relaxed search.
RAIL_TYPES, BUS_TYPES = (0, 1, 2, 5, 7, 12), (3, 11, 700, 715)
LONGER, LONGER_S, LATER_S = 2.5, 900, 5_400
STRETCH = 1.6
FIRST_WALK_S, LAST_WALK_S = 60, 60
RELAXED = "段差を避けたまま乗れる便が見つからず、条件をゆるめて探しています"
LEG = "array<struct<how:string,from_place:string,to_place:string,route:string,trip:string,dep:int,arr:int>>"
KEY = ["src", "start"]
#: What of a search decides how it goes on: no trips without room for a stroller, and whose transfers it walks.
WAY = ["stroller", "tier"]


def starts_of(searches: DataFrame, access: DataFrame, departing: DataFrame, window: int = timetable.BOARDING_WINDOW, limit: int = 12) -> DataFrame:
    """(src, start, stroller, tier): the first ``limit`` useful times to leave of each search (src, when, stroller,
    tier): now, and what just catches a departure of a place it walks to (access: src, place_id, seconds)."""
    caught = access.join(searches.select("src", "when"), "src").join(departing.select("place_id", "dep"), "place_id")
    caught = caught.select("src", (F.col("dep") - F.col("seconds")).cast("int").alias("start"), "when").filter(F.col("start").between(F.col("when"), F.col("when") + window))
    times = searches.select("src", F.col("when").cast("int").alias("start")).unionByName(caught.select("src", "start")).distinct()
    order = Window.partitionBy("src").orderBy("start")
    first = times.withColumn("__r", F.row_number().over(order)).filter(F.col("__r") <= limit).drop("__r")
    return first.join(searches.select("src", *WAY), "src")


def labels(starts: DataFrame, access: DataFrame, stop_times: DataFrame, departing: DataFrame, transfers: DataFrame, rounds: int = 3, cut=None) -> DataFrame:
    """(src, start, stroller, tier, round, place_id, t, how, from_place, feed_id, trip_id, route_id, dep): where a start is
    when, and how it got there. Ties go to the smaller (how, feed, trip, place)."""
    cut = cut or (lambda df: df.checkpoint())
    types = {"from_place": access.schema["place_id"].dataType, "feed_id": stop_times.schema["feed_id"].dataType, "trip_id": stop_times.schema["trip_id"].dataType, "route_id": departing.schema["route_id"].dataType, "dep": "int"}
    none = lambda name: F.lit(None).cast(types[name]).alias(name)
    first = starts.select(*KEY, *WAY).join(access.groupBy("src", "place_id").agg(F.min("seconds").alias("seconds")), "src")
    columns = [*KEY, *WAY, "round", "place_id", "t", "how", "from_place", "feed_id", "trip_id", "route_id", "dep"]
    found = cut(first.select(*KEY, *WAY, F.lit(0).alias("round"), "place_id", (F.col("start") + F.col("seconds")).cast("int").alias("t"), F.lit("access").alias("how"), *[none(c) for c in columns[8:]]))
    departing, transfers, timed = cut(departing), timetable.held_walks(transfers, cut), cut(timetable.indexed(stop_times))  # every round reads them
    of = cut(timetable.lines(departing))
    kinds = [bool(r[0]) for r in found.select("stroller").distinct().collect()]  # at most two rows
    for turn in range(1, rounds + 1):
        fresh = found.filter(F.col("round") == turn - 1).select(*KEY, *WAY, F.col("place_id").alias("from_place"), F.col("t").alias("from_t"))
        rides = None
        for stroller in kinds:
            own = fresh.filter(F.col("stroller") == stroller)
            boarding = own.select(F.col("from_place").alias("place_id"), F.col("from_t").alias("t")).distinct()
            ridden = own.join(timetable.downstream(timetable.next_departures(boarding, departing, stroller=stroller, of=of), timed), ["from_place", "from_t"])
            rides = ridden if rides is None else rides.unionByName(ridden)
        if rides is None:
            break
        rides = rides.select(*KEY, *WAY, "place_id", F.col("arr").cast("int").alias("t"), F.lit("ride").alias("how"), "from_place", "feed_id", "trip_id", "route_id", F.col("dep").cast("int").alias("dep"))
        walks = timetable.walked(fresh.withColumnsRenamed({"from_place": "place_id", "from_t": "t"}), transfers, (*KEY, *WAY), "tier")
        walks = walks.select(*KEY, *WAY, "place_id", "t", F.lit("walk").alias("how"), "from_place", none("feed_id"), none("trip_id"), none("route_id"), F.col("from_t").alias("dep"))
        offered = rides.union(walks).groupBy(*KEY, *WAY, "place_id").agg(F.min(F.struct("t", "how", "feed_id", "trip_id", "from_place", "route_id", "dep")).alias("b"))
        best = found.groupBy(*KEY, "place_id").agg(F.min("t").alias("best"))
        new = offered.join(best, [*KEY, "place_id"], "left").filter(F.col("best").isNull() | (F.col("b.t") < F.col("best")))
        found = cut(found.union(new.select(*KEY, *WAY, F.lit(turn).alias("round"), "place_id", *[F.col(f"b.{c}") for c in columns[6:]])))
    return found


def journeys(found: DataFrame, egress: DataFrame, rounds: int = 3) -> DataFrame:
    """(ask, src, start, round, place_id, depart, arrive, legs): a journey for each label of an end place (ask, src,
    place_id, seconds) with a ride. Legs are followed back by one self join a round; the walks at both ends are
    legs where they are long enough to be shown, and a journey departs with its first leg."""
    step = found.select(*[F.col(c).alias(f"p_{c}") for c in found.columns])
    path = found.join(egress.withColumnRenamed("seconds", "egress"), ["src", "place_id"]).select(
        "ask", *KEY, "round", "place_id", F.col("t").alias("end_t"), (F.col("t") + F.col("egress")).cast("int").alias("arrive"), F.col("round").alias("at_round"), F.col("place_id").alias("at_place"), F.array().cast(LEG).alias("legs")
    )
    text = lambda c: F.col(c).cast("string")
    for _ in range(rounds + 1):
        same = (F.col("src") == F.col("p_src")) & (F.col("start") == F.col("p_start")) & (F.col("at_round") == F.col("p_round")) & (F.col("at_place") == F.col("p_place_id"))
        first = F.col("p_how") == "access"
        leg = F.struct(
            F.when(first, "walk").otherwise(F.col("p_how")).alias("how"), text("p_from_place").alias("from_place"), text("at_place").alias("to_place"), text("p_route_id").alias("route"), text("p_trip_id").alias("trip"),
            F.when(first, F.col("start")).otherwise(F.col("p_dep")).alias("dep"), F.col("p_t").alias("arr"),
        )
        shown = F.coalesce(~first | (F.col("p_t") - F.col("start") >= FIRST_WALK_S), F.lit(False))
        # A path that has come to its first walk has no place to go on from.
        path = path.join(step, same, "left").select(
            "ask", *KEY, "round", "place_id", "end_t", "arrive", (F.col("at_round") - 1).alias("at_round"), F.col("p_from_place").alias("at_place"), F.when(shown, F.concat(F.array(leg), "legs")).otherwise(F.col("legs")).alias("legs")
        )
    last = F.struct(F.lit("walk").alias("how"), text("place_id").alias("from_place"), F.lit(None).cast("string").alias("to_place"), F.lit(None).cast("string").alias("route"), F.lit(None).cast("string").alias("trip"), F.col("end_t").alias("dep"), F.col("arrive").alias("arr"))
    whole = path.withColumn("legs", F.when(F.col("arrive") - F.col("end_t") > LAST_WALK_S, F.concat("legs", F.array(last))).otherwise(F.col("legs")))
    rode = F.exists("legs", lambda leg: leg["how"] == "ride")
    return whole.filter(rode).select("ask", *KEY, "round", "place_id", F.col("legs")[0]["dep"].alias("depart"), "arrive", "legs")


def pruned(found: DataFrame, limit: int = 5) -> DataFrame:
    """The best journeys of each ask: of those with the same rides the one that arrives first, then with fewer
    legs, then that leaves last; none much longer or later than the best; at most ``limit`` by arrival and
    duration, numbered by ``rank``."""
    ridden = F.filter("legs", lambda leg: leg["how"] == "ride")
    named = found.withColumn("signature", F.array_join(F.transform(ridden, lambda leg: F.concat_ws("/", leg["route"], leg["trip"])), ">"))
    named = named.withColumn("duration", F.col("arrive") - F.col("depart")).withColumn("transfers", F.size(ridden) - 1)
    order = Window.partitionBy("ask", "signature").orderBy("arrive", F.size("legs"), F.desc("depart"), "place_id", "round", "start")
    once = named.withColumn("__r", F.row_number().over(order)).filter("__r = 1").drop("__r")
    best = once.groupBy("ask").agg(F.min("duration").alias("shortest"), F.min("arrive").alias("earliest"))
    kept = once.join(best, "ask").filter((F.col("duration") <= F.col("shortest") * LONGER + LONGER_S) & (F.col("arrive") <= F.col("earliest") + LATER_S))
    rank = F.row_number().over(Window.partitionBy("ask").orderBy("arrive", "duration", "signature"))
    return kept.withColumn("rank", rank).filter(F.col("rank") <= limit).drop("shortest", "earliest")


def search_asks(asks: DataFrame, access: DataFrame, egress: DataFrame, stop_times: DataFrame, departing: DataFrame, transfers: DataFrame, rounds: int = 3, limit: int = 5, cut=None) -> DataFrame:
    """The best journeys of the next three hours of every ask (ask, src, when, stroller, tier): (ask, rank, start, depart,
    arrive, duration, transfers, signature, legs, ...). access: src, place_id, seconds; egress: ask, place_id,
    seconds; transfers: a, b, seconds and, where they differ by it, tier, or ``timetable.nearby_spots``."""
    cut = cut or (lambda df: df.checkpoint())
    access, egress = cut(access), cut(egress.join(asks.select("ask", "src"), "ask"))
    searches = asks.select("src", "when", *WAY).distinct()
    starts = cut(starts_of(searches, access, departing))
    return pruned(journeys(labels(starts, access, stop_times, departing, transfers, rounds, cut), egress, rounds), limit)


def search_many(access: DataFrame, egress: DataFrame, when: int, stop_times: DataFrame, departing: DataFrame, transfers: DataFrame, rounds: int = 3, limit: int = 5, stroller: bool = False, cut=None) -> DataFrame:
    """The same for one ask: access, egress: place_id, seconds."""
    ask = access.sparkSession.range(1).select(F.lit(0).alias("ask"), F.lit(0).alias("src"), F.lit(when).alias("when"), F.lit(stroller).alias("stroller"), F.lit("normal").alias("tier"))
    return search_asks(ask, access.withColumn("src", F.lit(0)), egress.withColumn("ask", F.lit(0)), stop_times, departing, transfers, rounds, limit, cut).orderBy("rank")


def with_extra(times: DataFrame, extra: DataFrame) -> DataFrame:
    """Access or egress times (place_id, seconds) with what a station takes longer inside (place_id, extra)."""
    return times.join(extra, "place_id", "left").select("place_id", (F.col("seconds") + F.coalesce("extra", F.lit(0))).cast("int").alias("seconds"))


def access_on_foot(origins: DataFrame, places: DataFrame, nodes: DataFrame, arcs: DataFrame, speed: float, max_seconds: int, limit_m: float = 1500.0, top: int = 30, cut=None) -> DataFrame:
    """(origin, place_id, seconds) to the nearest places along the roads; an origin that reaches none that
    way goes straight, with a detour.

    origins: origin, lat, lon; places: place_id, lat, lon.
    """
    from outways.operators import near, walking

    near_by = near.nearest(origins, places.select("place_id", "lat", "lon"), limit_m, "origin", "place_id", top)
    candidates = places.join(near_by.select("place_id").distinct(), "place_id", "left_semi").select(F.col("place_id").alias("candidate"), "lat", "lon")
    walked = walking.reachable_points(origins, candidates, nodes, arcs, max_seconds, cut).withColumnRenamed("candidate", "place_id").join(near_by.select("origin", "place_id"), ["origin", "place_id"], "left_semi")
    straight = near_by.join(walked.select("origin").distinct(), "origin", "left_anti").withColumn("seconds", (F.col("metres") * timetable.WALK_DETOUR / speed * 60).cast("int"))
    return walked.select("origin", "place_id", "seconds").unionByName(straight.filter(F.col("seconds") <= max_seconds).select("origin", "place_id", "seconds"))


def decorated(found: DataFrame, routes: DataFrame) -> DataFrame:
    """Journeys with ``kinds`` (train, bus) of their rides, and times as text. routes: route_id, route_type."""
    from outways.functions import clock

    kind = F.when(F.col("route_type").isin(*RAIL_TYPES), "train").when(F.col("route_type").isin(*BUS_TYPES), "bus")
    by_route = routes.select(F.col("route_id").cast("string").alias("route"), kind.alias("kind")).filter("kind is not null").distinct()
    used = found.select("ask", "signature", F.explode(F.filter(F.transform("legs", lambda leg: leg["route"]), lambda r: r.isNotNull())).alias("route")).join(by_route, "route")
    kinds = used.groupBy("ask", "signature").agg(F.sort_array(F.collect_set("kind"), asc=False).alias("kinds"))
    out = found.join(kinds, ["ask", "signature"], "left").withColumn("kinds", F.coalesce("kinds", F.array().cast("array<string>")))
    return out.withColumn("depart_text", clock.hhmm(F.col("depart"))).withColumn("arrive_text", clock.hhmm(F.col("arrive")))


def cards(plans: DataFrame, walk: DataFrame | None = None) -> DataFrame:
    """(ask, card, signature, arrive): what is shown of each ask. ``train`` and ``bus`` are the first journeys of
    one kind alone, ``walk`` is the walk (ask, arrive) and ``total`` the earlier of the first journey and
    the walk, which wins no tie."""
    first = lambda card, rows: rows.groupBy("ask").agg(F.min(F.struct("arrive", "duration", "signature")).alias("b")).select("ask", F.lit(card).alias("card"), "b.signature", "b.arrive")
    out = first("train", plans.filter("kinds = array('train')")).unionByName(first("bus", plans.filter("kinds = array('bus')")))
    ways = plans.select("ask", "arrive", F.lit(0).alias("turn"), "duration", "signature")
    if walk is not None:
        on_foot = walk.select("ask", F.col("arrive").cast("int").alias("arrive"), F.lit(1).alias("turn"), F.lit(0).alias("duration"), F.lit("walk").alias("signature"))
        out, ways = out.unionByName(on_foot.select("ask", F.lit("walk").alias("card"), "signature", "arrive")), ways.unionByName(on_foot)
    total = ways.groupBy("ask").agg(F.min(F.struct("arrive", "turn", "duration", "signature")).alias("b"))
    return out.unionByName(total.select("ask", F.lit("total").alias("card"), "b.signature", "b.arrive"))


def cascade(stages: list, asks: DataFrame, cut=None) -> DataFrame:
    """Journeys by the first stage that finds any for an ask: a stage is a function of the asks left; what it finds
    gets ``stage``, and later stages see only those without."""
    cut = cut or (lambda df: df.checkpoint())
    out, left = None, asks
    for turn, stage in enumerate(stages):
        found = cut(stage(left).withColumn("stage", F.lit(turn)))
        out = found if out is None else out.unionByName(found)
        left = cut(left.join(found.select("ask").distinct(), "ask", "left_anti"))
        if not left.limit(1).count():
            break
    return out


def warned(plans: DataFrame) -> DataFrame:
    """Journeys of a later stage say that they are relaxed."""
    return plans.withColumn("warning", F.when(F.col("stage") > 0, F.lit(RELAXED)))
