"""All plans of many questions in one run: journeys by timetable, and the ways on foot, by bicycle and by car.

A question (ask, profile, when, o_lat, o_lon, d_lat, d_lon) names its travel profile, so that one run answers
questions of all profiles: journeys share the rounds of one search, ways are searched once per profile and mode.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outways.operators import journeys, timetable, walking
from outways.plans.profiles import Profile

# Metres a minute of the modes whose pace isn't the profile's, and the places walked to.
SPEEDS = {"bike": 220.0, "car": 330.0}
NEAR_M, NEAR_PLACES = 1500.0, 30


@dataclass
class Travel:
    """A profile with its ways: ``legs`` by mode (a, b, cost, length, highway, attrs), and for profiles that pass no
    steps ``relaxed``, the ways on foot of ``profile.relaxed()``."""

    profile: Profile
    legs: dict[str, DataFrame]
    relaxed: DataFrame | None = None

    def speed(self, mode: str) -> float:
        return SPEEDS.get(mode, float(self.profile.walk_speed))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def walked_ends(points: DataFrame, travel: Travel, places: DataFrame, nodes: DataFrame, max_seconds: int, relaxed: bool = False, cut=None) -> DataFrame:
    """(key, place_id, seconds): the places near each point (key, lat, lon), along the roads; equal points are searched once."""
    at = points.select("key", F.struct("lat", "lon").alias("origin"))
    origins = at.select("origin").distinct().select("origin", "origin.lat", "origin.lon")
    legs = travel.relaxed if relaxed else travel.legs["walk"]
    found = journeys.access_on_foot(origins, places, nodes, legs.select("a", "b", "cost"), float(travel.profile.walk_speed), max_seconds, NEAR_M, NEAR_PLACES, cut=cut)
    return at.join(found, "origin").select("key", "place_id", "seconds")


def transit_plans(asks: DataFrame, travels: dict[str, Travel], places: DataFrame, nodes: DataFrame, stop_times: DataFrame, departing: DataFrame, transfers: DataFrame, limit: int = 5, cut=None) -> DataFrame:
    """The best journeys of every ask (see ``journeys.search_asks``), with ``stage`` and ``warning``: where a profile
    that passes no steps finds none, its steps are weighed instead and it walks ``journeys.STRETCH`` times as long."""
    # Asks that begin alike share a search.
    asks = asks.withColumn("src", F.concat_ws("|", "profile", "when", "o_lat", "o_lon"))

    def stage(own: list[Travel], relaxed: bool):
        def run(left: DataFrame) -> DataFrame:
            asked, access, egress = [], [], []
            for t in own:
                mine = left.filter(F.col("profile") == t.profile.id)
                p = t.profile.relaxed() if relaxed else t.profile
                seconds = int(p.max_walk_seconds * journeys.STRETCH) if relaxed else p.max_walk_seconds
                asked.append(mine.select("ask", "src", "when", F.lit(p.stroller).alias("stroller"), F.lit(p.tier).alias("tier")))
                begins = mine.select(F.col("src").alias("key"), F.col("o_lat").alias("lat"), F.col("o_lon").alias("lon")).distinct()
                ends = mine.select(F.col("ask").alias("key"), F.col("d_lat").alias("lat"), F.col("d_lon").alias("lon"))
                for points, parts, name in ((begins, access, "src"), (ends, egress, "ask")):
                    parts.append(walked_ends(points, t, places, nodes, seconds, relaxed, cut).withColumnRenamed("key", name))
            return journeys.search_asks(_union(asked), _union(access), _union(egress), stop_times, departing, transfers, limit=limit, cut=cut)

        return run

    every, careful = list(travels.values()), [t for t in travels.values() if t.relaxed is not None]
    stages = [stage(every, False)] + ([stage(careful, True)] if careful else [])
    return journeys.warned(journeys.cascade(stages, asks, cut))


def ways(asks: DataFrame, travels: dict[str, Travel], nodes: DataFrame, modes: tuple[str, ...] = ("walk",), cut=None) -> DataFrame:
    """(ask, mode, arrive, and the figures of ``walking.walk_plans``): one row per ask and mode."""
    parts = []
    for t in travels.values():
        mine = asks.filter(F.col("profile") == t.profile.id)
        pairs = mine.select(F.col("ask").alias("pair"), "o_lat", "o_lon", "d_lat", "d_lon")
        for mode in modes:
            if mode in t.legs:
                plans = walking.walk_plans(pairs, nodes, t.legs[mode], t.speed(mode), mode, t.relaxed if mode == "walk" else None, cut=cut)
                parts.append(plans.withColumnRenamed("pair", "ask").join(mine.select("ask", "when"), "ask").withColumn("arrive", (F.col("when") + F.col("seconds")).cast("int")).drop("when"))
    return _union(parts)


def plan_all(asks: DataFrame, travels: dict[str, Travel], places: DataFrame, nodes: DataFrame, stop_times: DataFrame, departing: DataFrame, transfers: DataFrame, routes: DataFrame, modes: tuple[str, ...] = ("walk",), cut=None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(cards, journeys, ways): for each ask the cards that are shown (ask, card, signature, arrive), every journey
    behind them, and the way of each mode, which stays in the result where it is too far or not found."""
    cut = cut or (lambda df: df.checkpoint())
    asks = cut(asks)
    found = cut(journeys.decorated(transit_plans(asks, travels, places, nodes, stop_times, departing, transfers, cut=cut), routes))
    on_road = cut(ways(asks, travels, nodes, modes, cut))
    cards = journeys.cards(found, on_road.filter("mode = 'walk' and arrive is not null").select("ask", "arrive"))
    others = on_road.filter("mode <> 'walk' and arrive is not null").select("ask", F.col("mode").alias("card"), F.col("mode").alias("signature"), "arrive")
    return cards.unionByName(others), found, on_road


def transfers_by_tier(places: DataFrame, speeds: dict[str, float]) -> DataFrame:
    """(a, b, seconds, tier): the transfers between places, walked at the pace of each tier."""
    plain = timetable.nearby_transfers(places)
    return _union([(plain if speed == 80.0 else timetable.gentler(plain, gentle=speed)).withColumn("tier", F.lit(tier)) for tier, speed in speeds.items()])
