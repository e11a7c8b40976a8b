"""Bus feeds from patterns of stops known by name: coordinates, detours, holidays, and the tables of a feed."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from outways.functions import names, shapes

# How far an end stop may lie from the next one, in metres and against the pattern's usual hop.
END_MIN_M, END_RATIO = 3000.0, 6.0
#: Rows up to which the patterns or stops of a round are broadcast.
SMALL_ROWS = 200_000
# A feed's tables, their key and fields.
TABLES = {
    "agency": (("agency_id",), ("agency_id", "agency_name", "agency_url", "agency_timezone", "agency_lang")),
    "stops": (("stop_id",), ("stop_id", "stop_name", "stop_lat", "stop_lon")),
    "routes": (("route_id",), ("route_id", "agency_id", "route_short_name", "route_long_name", "route_type")),
    "trips": (("trip_id",), ("route_id", "service_id", "trip_id", "trip_headsign")),
    "stop_times": (("trip_id", "stop_sequence"), ("trip_id", "arrival_time", "departure_time", "stop_id", "stop_sequence")),
    "calendar": (("service_id",), ("service_id", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday", "start_date", "end_date")),
    "calendar_dates": (("service_id", "date"), ("service_id", "date", "exception_type")),
    "feed_info": (("feed_publisher_name",), ("feed_publisher_name", "feed_publisher_url", "feed_lang", "feed_start_date", "feed_end_date")),
}


def coordinates(official: DataFrame, mapped: DataFrame, own_feed: str) -> DataFrame:
    """(key, lat, lon, source, ord): stops' coordinates by name key, those of other feeds first, then mapped ones.

    official: feed_id, stop_name, lat, lon, ord; mapped: stop_name, lat, lon, operator, ord.
    """
    of_feeds = official.filter((F.col("feed_id") != own_feed) & F.col("lat").isNotNull() & F.col("lon").isNotNull())
    first = of_feeds.select(names.stop_name_key(F.col("stop_name")).alias("key"), "lat", "lon", F.lit("gtfs").alias("source"), F.struct(F.lit(0).alias("turn"), F.col("feed_id").alias("feed"), F.col("ord").cast("long").alias("ord")).alias("ord"))
    then = mapped.select(
        names.stop_name_key(F.col("stop_name")).alias("key"), "lat", "lon", F.concat(F.lit("osm:"), F.coalesce("operator", F.lit(""))).alias("source"),
        F.struct(F.lit(1).alias("turn"), F.lit("").alias("feed"), F.col("ord").cast("long").alias("ord")).alias("ord"),
    )
    return first.unionByName(then)


def mapped_stops(points: DataFrame) -> DataFrame:
    """(key, stops array of lat, lon, operator): distinct coordinates per name key, for a table by name."""
    rounded = points.select(names.stop_name_key(F.col("stop_name")).alias("key"), F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), F.coalesce("operator", F.lit("")).alias("operator"), "ord")
    once = rounded.groupBy("key", "lat", "lon").agg(F.min(F.struct("ord", "operator")).alias("f"))
    listed = F.array_sort(F.collect_list(F.struct(F.col("f.ord").alias("ord"), "lat", "lon", F.col("f.operator").alias("operator"))))
    return once.filter("key <> ''").groupBy("key").agg(F.transform(listed, lambda s: F.struct(s["lat"].alias("lat"), s["lon"].alias("lon"), s["operator"].alias("operator"))).alias("stops"))


def spikes(visits: DataFrame) -> DataFrame:
    """Visits (pattern, i, stop, lat, lon) with ``spike``: whether the way by this stop is a detour that no bus
    makes, seen from its neighbours in the pattern; never at the ends."""
    order = Window.partitionBy("pattern").orderBy("i")
    at = F.struct("lat", "lon")
    around = visits.withColumn("__p", F.lag(at).over(order)).withColumn("__n", F.lead(at).over(order))
    return around.withColumn("spike", F.coalesce(shapes.is_spike(F.col("__p"), at, F.col("__n")), F.lit(False))).drop("__p", "__n")


def usual_hops(visits: DataFrame) -> DataFrame:
    """(pattern, hop_m): the upper median of the hops of each pattern."""
    from outways.functions import geo

    order = Window.partitionBy("pattern").orderBy("i")
    hop = geo.haversine(F.col("lat"), F.col("lon"), F.lead("lat").over(order), F.lead("lon").over(order))
    return visits.select("pattern", hop.alias("m")).filter("m is not null").groupBy("pattern").agg(shapes.upper_median(F.collect_list("m")).alias("hop_m"))


def patterns_inside(visits: DataFrame, located: DataFrame, inside: Column) -> DataFrame:
    """(pattern): those with a stop whose name's best coordinates lie ``inside`` (a condition on lat, lon).

    visits: pattern, key; located: key, lat, lon.
    """
    return visits.select("pattern", "key").distinct().join(located.filter(inside).select("key"), "key", "left_semi").select("pattern").distinct()


def _metres(p, q) -> float:
    a, b = math.radians(p[0]), math.radians(q[0])
    h = math.sin((b - a) / 2) ** 2 + math.cos(a) * math.cos(b) * math.sin(math.radians(q[1] - p[1]) / 2) ** 2
    return 2 * 6371000.0 * math.asin(math.sqrt(h))


def _spike(p, here, q) -> bool:
    return _metres(p, here) + _metres(here, q) > max(shapes.SPIKE_MIN_M, shapes.SPIKE_RATIO * _metres(p, q))


def _faulty(stops: Column) -> Column:
    """Whether a repair would change a pattern, given the array of its stops (lat, lon) that still stand: with a detour, or an
    end far from the next stop."""
    from outways.functions import geo

    at = lambda i: F.get(stops, i)
    spike = F.exists(F.sequence(F.lit(1), F.size(stops) - 2), lambda i: F.coalesce(shapes.is_spike(at(i - 1), at(i), at(i + 1)), F.lit(False)))
    metres = F.transform(F.sequence(F.lit(1), F.size(stops) - 1), lambda i: geo.haversine(at(i - 1)["lat"], at(i - 1)["lon"], at(i)["lat"], at(i)["lon"]))
    limit = lambda m: F.greatest(F.lit(END_MIN_M), END_RATIO * shapes.upper_median(m))
    end = lambda m: F.greatest(F.get(m, F.lit(0)), F.get(m, F.size(m) - 1)) > limit(m)
    far = shapes.bound(F.filter(metres, lambda m: m.isNotNull()), lambda m: (F.size(m) > 0) & end(m))
    return F.when(F.size(stops) >= 3, spike | far).otherwise(F.lit(False))


def _closest(options: list, fits, length) -> tuple | None:
    """Of the options that fit the one with the shortest way, the first of equals."""
    fitting = [o for o in options if fits(o[:2])]
    return min(fitting, key=lambda o: length(o[:2])) if fitting else None


def _end_limit(points: list) -> float:
    hops = sorted(map(_metres, points, points[1:]))
    return max(END_MIN_M, END_RATIO * hops[len(hops) // 2])


def mended(stops: list, at: dict, options: dict) -> dict:
    """What becomes of the stops of one pattern: stop to its new (lat, lon, source), or to None where it is dropped.

    The first end is looked at, then the inner stops from the left, each between the last one that stands and the
    next, then the last end. Only whole patterns of three stops or more say anything.
    """
    at, news = dict(at), {}

    def put(stop, option) -> None:
        at[stop], news[stop] = option[:2], option

    def look_at_end(stop, other, standing) -> None:
        limit = _end_limit([at[s] for s in standing])
        if _metres(at[stop], at[other]) > limit:
            near = lambda c: _metres(at[other], c)
            if option := _closest(options.get(stop, []), lambda c: near(c) < limit, near):
                put(stop, option)

    if len(stops) < 3:
        return news
    look_at_end(stops[0], stops[1], stops)
    standing, coming = [stops[0]], list(reversed(stops[1:]))
    while len(coming) > 1:
        stop, before, after = coming.pop(), at[standing[-1]], at[coming[-1]]
        if _spike(before, at[stop], after):
            option = _closest(options.get(stop, []), lambda c, p=before, q=after: not _spike(p, c, q), lambda c, p=before, q=after: _metres(p, c) + _metres(c, q))
            if option is None:
                news[stop] = None
                if len(standing) + len(coming) < 3:
                    return news
                continue
            put(stop, option)
        standing.append(stop)
    look_at_end(coming[0], standing[-1], [*standing, coming[0]])
    return news


def repaired(visits: DataFrame, candidates: DataFrame, cut=None) -> DataFrame:
    """(feed_id, stop, lat, lon, source, outcome): each stop's coordinates after repair; outcome is kept, moved
    or dropped.

    visits: feed_id, p_ord (order of patterns), i, stop, lat, lon, source; candidates: stop, rank, lat, lon,
    source. Along each pattern in turn a stop that is a detour moves to the candidate that is least of one, or is
    dropped where none helps; a stop at an end only moves, where the next is too far. A stop that one pattern
    changed is seen so by the later ones of its feed.

    Each pattern is repaired as if no other had changed a thing; then those that pass a stop which an earlier one changed
    are repaired again with what they see of it, until nothing changes. What the first patterns do is right from the
    start, so each round sets at least the next ones right, and only patterns after a change take part in it.
    There are at most as many rounds as patterns follow from each other.
    """
    cut = cut or (lambda df: df.checkpoint())
    at, keys, kind = ["feed_id", "stop"], ["feed_id", "p_ord"], dict(visits.dtypes)
    small = lambda df, n: F.broadcast(df) if n <= SMALL_ROWS else df
    known = cut(candidates.groupBy("stop").agg(F.array_sort(F.collect_list(F.struct("rank", "lat", "lon", "source"))).alias("options")))
    known = small(known, known.agg(F.coalesce(F.sum(F.size("options")), F.lit(0))).first()[0])
    latest = F.max_by(F.struct("lat", "lon", "source"), F.struct("p_ord", "i")).over(Window.partitionBy(*at))
    placed = cut(visits.select(*keys, "i", "stop", latest.alias("s")).select(*keys, "i", "stop", "s.*"))
    passed = placed.drop("source").dropna(subset=["feed_id", "p_ord", "stop"])
    schema = f"feed_id {kind['feed_id']}, p_ord {kind['p_ord']}, stop {kind['stop']}, lat double, lon double, source string, outcome string"

    def mend(batches):
        for batch in batches:
            rows = []
            for feed, p_ord, stops, lats, lons, listed in batch.itertuples(index=False, name=None):
                options = {}
                for o in listed:
                    options.setdefault(o["stop"], []).append((o["lat"], o["lon"], o["source"]))
                news = mended(list(stops), dict(zip(stops, zip(lats, lons, strict=True), strict=True)), options)
                rows += [(feed, p_ord, s, *(n or (None, None, None)), "moved" if n else "dropped") for s, n in news.items()]
            yield pd.DataFrame(rows, columns=["feed_id", "p_ord", "stop", "lat", "lon", "source", "outcome"])

    def repair(seen: DataFrame) -> DataFrame:
        stops = F.array_sort(F.collect_list(F.struct("i", "stop", "lat", "lon", "options"))).alias("s")
        faulty = seen.join(known, "stop", "left").groupBy(*keys).agg(stops).filter(_faulty(F.col("s")))
        option = lambda x: F.transform(x["options"], lambda o: F.struct(x["stop"].alias("stop"), o["lat"].alias("lat"), o["lon"].alias("lon"), o["source"].alias("source")))
        listed = F.flatten(F.transform(F.filter("s", lambda x: x["options"].isNotNull()), option)).alias("listed")
        return cut(faulty.select(*keys, "s.stop", "s.lat", "s.lon", listed).mapInPandas(mend, schema))

    def seen_by(rows: DataFrame, news: DataFrame) -> DataFrame:
        """The rows as their pattern sees them: with the last that an earlier one did to their stop."""
        done = news.select(*keys, "stop", F.struct("lat", "lon", "outcome").alias("done"))
        before = Window.partitionBy(*at).orderBy("p_ord", F.col("done").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        met = rows.unionByName(done, allowMissingColumns=True).withColumn("own", F.col("done").isNotNull()).withColumn("done", F.last("done", ignorenulls=True).over(before))
        now = lambda c: F.when(F.col("done").isNotNull(), F.col("done")[c]).otherwise(F.col(c)).alias(c)
        return met.filter(~F.col("own") & F.coalesce(F.col("done.outcome") != "dropped", F.lit(True))).select(*keys, "i", "stop", now("lat"), now("lon"))

    news = changed = repair(passed)
    while n := changed.count():
        since = small(changed.groupBy(*at).agg(F.min("p_ord").alias("since")), n)
        again = cut(passed.join(since, at).filter(F.col("p_ord") > F.col("since")).select(*keys).distinct())
        turn = small(again, again.count())
        fresh = repair(seen_by(passed.join(turn, keys, "left_semi"), news))
        sides = news.join(turn, keys, "left_semi").withColumn("side", F.lit(-1)).unionByName(fresh.withColumn("side", F.lit(1)))
        changed = cut(sides.groupBy(*fresh.columns).agg(F.sum("side").alias("side")).filter("side <> 0"))
        news = cut(news.join(turn, keys, "left_anti").unionByName(fresh))
    moved = F.max(F.when(F.col("outcome") == "moved", F.struct("p_ord", "lat", "lon", "source"))).alias("moved")
    last = news.groupBy(*at).agg(F.max_by("outcome", "p_ord").alias("outcome"), moved)
    state = placed.groupBy(*at).agg(F.first(F.struct("lat", "lon", "source")).alias("s")).join(last, at, "left")
    now = lambda c: F.when(F.col("moved").isNotNull(), F.col("moved")[c]).otherwise(F.col("s")[c]).alias(c)
    return cut(state.select(*at, now("lat"), now("lon"), now("source"), F.coalesce("outcome", F.lit("kept")).alias("outcome")))


def holidays(lines: DataFrame, start: str, end: str) -> DataFrame:
    """(day) of the dates ``y/m/d`` in the first field of CSV lines (value), within the ISO dates; other
    lines are passed over."""
    first = F.split(F.regexp_replace("value", "^\\ufeff|\"", ""), ",")[0]
    day = F.try_to_date(F.trim(first), "y/M/d")
    return lines.select(day.alias("day")).filter(F.col("day").between(F.lit(start).cast("date"), F.lit(end).cast("date"))).distinct()


def write_feed(tables: dict[str, DataFrame], folder: str) -> None:
    """Write a feed's tables as CSV with a header, each a folder of its name, sorted by its key; missing
    fields are empty. The sort is global, so the files in turn hold the table in order."""
    for name, (key, fields) in TABLES.items():
        if name in tables:
            df = tables[name]
            row = [F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in fields]
            df.select(*row).orderBy(*key).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(f"{folder}/{name}")
