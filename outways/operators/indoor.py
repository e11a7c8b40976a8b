"""Inside stations: entrances, passages and the boarding places they lead to.

Stops: stop_id, stop_name, lat, lon, location_type (0 boarding place, 1 station, 2 entrance, 4 boarding
area), parent_station; pathways: from_stop, to_stop, mode, bidirectional, length.
"""

from __future__ import annotations

import heapq
import math
from collections import defaultdict

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outways.operators import near, rails, roads
STAIRS, ESCALATOR = 2, 4
SAME_STATION_M = 400.0
NAMES_SHOWN = 3
# What is said of a station's entrances.
STEP_FREE_TEXT = " の出入口から入ると、階段を使わずにホームまで行けます"
NO_STEP_FREE_TEXT = "公開されている構内データでは、階段を使わない行き方が確認できませんでした。駅係員や他社のエレベーターが使えることがあります"


def blocked(mode: Column, step_free: bool) -> Column:
    """Stairs and escalators, for those who can't take steps."""
    return F.coalesce(mode.isin(STAIRS, ESCALATOR), F.lit(False)) if step_free else F.lit(False)


def passages(pathways: DataFrame, step_free: bool = False) -> DataFrame:
    """Arcs (a, b, cost) of the open passages, back as well where they go both ways."""
    open_ = pathways.filter(~blocked(F.col("mode"), step_free)).withColumn("cost", roads.interior_seconds(F.col("mode"), F.col("length")))
    back = open_.filter("bidirectional = 1").select(F.col("to_stop").alias("a"), F.col("from_stop").alias("b"), "cost")
    return open_.select(F.col("from_stop").alias("a"), F.col("to_stop").alias("b"), "cost").union(back)


def rooted(stops: DataFrame, cut=None, max_rounds: int = 40) -> DataFrame:
    """Stops with ``root``, the end of their chain of parents, by doubling; a parent that isn't a stop
    ends it. Fails on circles."""
    cut = cut or (lambda df: df.checkpoint())
    parents = stops.select("stop_id", F.nullif(F.col("parent_station"), F.lit("")).alias("up"))
    known = parents.select(F.col("stop_id").alias("up"), F.lit(True).alias("known"))
    parents = cut(parents.join(known, "up", "left").select("stop_id", F.when(F.col("known"), F.col("up")).alias("up")))
    at = cut(parents.select("stop_id", F.coalesce("up", "stop_id").alias("root")))
    for _ in range(max_rounds):
        further = at.join(at.select(F.col("stop_id").alias("root"), F.col("root").alias("beyond")), "root")
        after = cut(further.select("stop_id", F.col("beyond").alias("root"), (F.col("beyond") != F.col("root")).alias("moved")))
        at = after.select("stop_id", "root")
        if not after.filter("moved").limit(1).count():
            break
    # On a circle some root has a parent.
    if not at.join(parents.filter("up is not null").select(F.col("stop_id").alias("root")), "root", "left_semi").limit(1).count():
        return stops.join(at, "stop_id")
    raise RuntimeError("the parents of the stops form a circle")


def _entrances(held: DataFrame) -> DataFrame:
    """(station, entrance, name, lat, lon) from ``rooted`` stops."""
    return held.filter("location_type = 2").select(F.col("root").alias("station"), F.col("stop_id").alias("entrance"), F.coalesce("stop_name", "stop_id").alias("name"), "lat", "lon")


def _areas(held: DataFrame) -> DataFrame:
    """(station, node, board): the boarding areas of each boarding place, from ``rooted`` stops."""
    boards = held.filter("location_type = 0 and coalesce(parent_station, '') <> ''").select(F.col("root").alias("station"), F.col("stop_id").alias("board"))
    areas = held.filter("location_type = 4 and coalesce(parent_station, '') <> ''").select(F.col("stop_id").alias("node"), F.col("parent_station").alias("board"))
    return areas.join(boards, "board").select("station", "node", "board")


def entrance_times(stops: DataFrame, pathways: DataFrame, step_free: bool = False, cut=None) -> DataFrame:
    """(station, entrance, name, lat, lon, board, seconds): each entrance's least seconds to each boarding
    place of its station; one row with null board where it reaches none. All entrances are searched
    at once, each for itself."""
    cut = cut or (lambda df: df.checkpoint())
    held = cut(rooted(stops, cut))
    entrances = _entrances(held)
    boards = held.filter("location_type = 0 and coalesce(parent_station, '') <> ''").select(F.col("root").alias("station"), F.col("stop_id").alias("board"))
    areas = held.filter("location_type = 4 and coalesce(parent_station, '') <> ''").select(F.col("stop_id").alias("node"), F.col("parent_station").alias("board"))
    sources = entrances.select("entrance", F.col("entrance").alias("node"), F.lit(0.0).alias("cost"))
    known = roads.shortest(passages(pathways, step_free), sources, cut=cut, by=("entrance",))
    reached = known.join(areas, "node").groupBy("entrance", "board").agg(F.min("cost").alias("seconds"))
    own = entrances.select("station", "entrance").join(reached, "entrance").join(boards, ["station", "board"], "left_semi")
    return entrances.join(own, ["station", "entrance"], "left").select("station", "entrance", "name", "lat", "lon", "board", F.col("seconds").cast("int").alias("seconds"))


def boards_reached(arcs: list[tuple], entrances: list[tuple], boards: list[tuple]) -> list[tuple]:
    """(station, entrance, how many boarding places of its station it reaches) over directed arcs (a, b). entrances: (station,
    node); boards: (station, node, board). Nodes that reach each other are taken together; then each part's boarding
    places are those of the parts it leads to, as bits, which are dropped once no part asks for them any more."""
    out: dict = defaultdict(list)
    for a, b in arcs:
        out[a].append(b)
    bit: dict = {}
    own, masks = defaultdict(int), defaultdict(int)
    for station, node, board in boards:
        b = 1 << bit.setdefault((station, board), len(bit))
        own[node] |= b
        masks[station] |= b
    asked = defaultdict(list)
    for station, node in entrances:
        asked[node].append(station)
    order, low, place, part, stack, members, found = {}, {}, {}, {}, [], [], []
    for root in asked:
        if root in order:
            continue
        order[root] = low[root] = len(order)
        place[root] = len(stack)
        stack.append(root)
        path = [(root, iter(out[root]))]
        while path:
            node, ahead = path[-1]
            for n in ahead:
                if n not in order:
                    order[n] = low[n] = len(order)
                    place[n] = len(stack)
                    stack.append(n)
                    path.append((n, iter(out[n])))
                    break
                if n not in part:
                    low[node] = min(low[node], order[n])
            else:
                path.pop()
                if path:
                    low[path[-1][0]] = min(low[path[-1][0]], low[node])
                if low[node] == order[node]:
                    at = place[node]
                    members.append(stack[at:])
                    del stack[at:]
                    part.update(dict.fromkeys(members[-1], len(members) - 1))
    # A part is closed after all it leads to.
    leads = [{part[n] for node in own_nodes for n in out[node]} - {i} for i, own_nodes in enumerate(members)]
    wanted = [0] * len(members)
    for to in leads:
        for n in to:
            wanted[n] += 1
    reach: list = [0] * len(members)
    for i, nodes in enumerate(members):
        bits = 0
        for node in nodes:
            bits |= own[node]
        for n in leads[i]:
            bits |= reach[n]
            wanted[n] -= 1
            if not wanted[n]:
                reach[n] = None
        reach[i] = bits if wanted[i] else None
        found += [(station, node, (bits & masks[station]).bit_count()) for node in nodes for station in asked.get(node, ())]
    return found


def soonest(arcs: dict, start, goals: set) -> float:
    """The least cost from a node over arcs {a: {b: cost}} to any of the goals, which one of them must be in reach of."""
    known, heap = {start: 0.0}, [(0.0, start)]
    while True:
        cost, node = heapq.heappop(heap)
        if node in goals:
            return cost
        for n, step in arcs.get(node, {}).items():
            if cost + step < known.get(n, math.inf) and cost <= known[node]:
                known[n] = cost + step
                heapq.heappush(heap, (cost + step, n))


def entrance_boards(stops: DataFrame, pathways: DataFrame, step_free: bool = False, cut=None) -> DataFrame:
    """(station, entrance, name, lat, lon, boards, seconds): to how many boarding places of its station each entrance leads
    and its least seconds to one, null where there is none: ``entrance_times`` without a row for every boarding place.

    Passages that hang together are a group each, however many stations they join. Boarding places are counted for all
    entrances at once, and an entrance's way is searched only up to the first one.
    """
    cut = cut or (lambda df: df.checkpoint())
    held = cut(rooted(stops, cut))
    arcs = cut(passages(pathways, step_free).filter("cost is not null and a <> b").groupBy("a", "b").agg(F.min("cost").alias("cost")))
    part = rails.connected(arcs.select(F.col("a").alias("u"), F.col("b").alias("v")), [], cut)
    own = _entrances(held)
    none = lambda kind: F.lit(None).cast(kind)
    rows = arcs.select(none("string").alias("station"), F.col("a").alias("node"), F.col("b").alias("to"), "cost")
    rows = rows.unionByName(own.select("station", F.col("entrance").alias("node"), none("string").alias("to"), none("double").alias("cost")))
    rows = rows.unionByName(_areas(held).select("station", "node", F.col("board").alias("to"), none("double").alias("cost")))

    def count(group: pd.DataFrame) -> pd.DataFrame:
        ways, begun, boards, goals = defaultdict(dict), [], [], defaultdict(set)
        for station, node, to, cost in zip(group["station"], group["node"], group["to"], group["cost"], strict=True):
            if not math.isnan(cost):
                ways[node][to] = cost
            elif to is None:
                begun.append((station, node))
            else:
                boards.append((station, node, to))
                goals[station].add(node)
        reached = boards_reached([(a, b) for a, to in ways.items() for b in to], begun, boards)
        found = [(station, node, n, int(soonest(ways, node, goals[station]))) for station, node, n in reached if n]
        return pd.DataFrame(found, columns=["station", "entrance", "boards", "seconds"])

    found = rows.join(part, "node").groupBy("root").applyInPandas(count, "station string, entrance string, boards long, seconds int")
    return own.join(found, ["station", "entrance"], "left").select("station", "entrance", "name", "lat", "lon", F.coalesce("boards", F.lit(0).cast("long")).alias("boards"), "seconds")


def entrances(times: DataFrame) -> DataFrame:
    """(station, entrance, name, lat, lon, reaches map, seconds, step_free) from ``entrance_times``, the
    quickest first, those that lead nowhere last."""
    pairs = F.array_sort(F.collect_list(F.when(F.col("board").isNotNull(), F.struct("board", "seconds"))))
    grouped = times.groupBy("station", "entrance", "name", "lat", "lon").agg(F.map_from_entries(pairs).alias("reaches"), F.min("seconds").alias("seconds"))
    return grouped.withColumn("step_free", F.col("seconds").isNotNull()).orderBy("station", F.asc_nulls_last("seconds"), "entrance")


def station_seconds(times: DataFrame) -> DataFrame:
    """(station, seconds): the quickest way in; null where no entrance leads to a boarding place."""
    return times.groupBy("station").agg(F.min("seconds").alias("seconds"))


def stations(stops: DataFrame, step_free_times: DataFrame) -> DataFrame:
    """(station, name, lat, lon, entrances, step_free_count, text): each station with what can be said of its
    step-free entrances, the three quickest by name."""
    per = step_free_times.groupBy("station", "entrance", "name").agg(F.min("seconds").alias("seconds"))
    free = F.transform(F.array_sort(F.collect_list(F.when(F.col("seconds").isNotNull(), F.struct("seconds", "entrance", "name")))), lambda e: e["name"])
    summed = per.groupBy("station").agg(F.countDistinct("entrance").alias("entrances"), F.count("seconds").alias("step_free_count"), free.alias("free"))
    named = F.concat(F.array_join(F.slice("free", 1, NAMES_SHOWN), "・"), F.lit(STEP_FREE_TEXT))
    own = stops.filter("location_type = 1").select(F.col("stop_id").alias("station"), F.col("stop_name").alias("name"), "lat", "lon")
    return own.join(summed, "station", "left").select(
        "station", "name", "lat", "lon", F.coalesce("entrances", F.lit(0)).alias("entrances"), F.coalesce("step_free_count", F.lit(0)).alias("step_free_count"),
        F.when(F.col("step_free_count") > 0, named).otherwise(F.lit(NO_STEP_FREE_TEXT)).alias("text"),
    )


def summary(found: DataFrame) -> DataFrame:
    """One row: stations, entrances, step_free; from ``stations``."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return found.agg(F.count("*").alias("stations"), total("entrances"), F.coalesce(F.sum("step_free_count"), F.lit(0)).alias("step_free"))


def places_of(stations: DataFrame, places: DataFrame) -> DataFrame:
    """(station, place_id): the places of a station, of the same name and feed and up to 400 m away.

    stations: station, name, feed_id, lat, lon; places: place_id, name, feeds array, lat, lon.
    """
    named = stations.select("station", "name", "feed_id", "lat", "lon").join(places.select("place_id", "name", "feeds", F.col("lat").alias("p_lat"), F.col("lon").alias("p_lon")), "name")
    return named.filter(F.array_contains("feeds", F.col("feed_id")) & (near.geo.haversine(F.col("lat"), F.col("lon"), F.col("p_lat"), F.col("p_lon")) <= SAME_STATION_M)).select("station", "place_id")


def extra_seconds(plain: DataFrame, own: DataFrame, station_places: DataFrame) -> DataFrame:
    """(place_id, extra): what a profile takes longer inside than a plain walker, the most of a place's
    stations; the whole plain time where it gets nowhere. Stations without data add nothing."""
    met = plain.filter("seconds > 0").select("station", F.col("seconds").alias("base")).join(own.select("station", F.col("seconds").alias("mine")), "station", "left")
    extra = F.when(F.col("mine").isNull(), F.col("base")).otherwise(F.greatest(F.lit(0), F.col("mine") - F.col("base")))
    return met.withColumn("extra", extra).filter("extra > 0").join(station_places, "station").groupBy("place_id").agg(F.max("extra").cast("int").alias("extra"))


def station_for(legs: DataFrame, stations: DataFrame) -> DataFrame:
    """Legs with ``station``: that of the same name as where they begin, a trailing 駅 aside; the first by id."""
    bare = lambda c: F.replace(F.coalesce(c, F.lit("")), F.lit("駅"), F.lit(""))
    by_name = stations.groupBy(bare(F.col("name")).alias("__key")).agg(F.min("station").alias("station"))
    return legs.withColumn("__key", bare(F.col("from_name"))).join(by_name, "__key", "left").drop("__key")
