"""Parts of lines: what was ridden of a route's shape, detours, and simplified rings. Lines are arrays of (lon, lat)."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from outways.functions import geo

# How far a stop may lie from its route's shape or from a rail line (metres), how fast a ride along a shape
# may be (metres a second), how much longer than the straight line a ride along a rail line may be, and from what length on.
SHAPE_SNAP_M, SHAPE_MAX_MPS, RAIL_SNAP_M, RAIL_DETOUR, RAIL_LEAST_M = 300.0, 42.0, 400.0, 2.5, 100.0
# A detour in metres, and against the direct way, that no bus makes.
SPIKE_MIN_M, SPIKE_RATIO = 1500.0, 3.0
LINE = T.ArrayType(T.StructType([T.StructField("lon", T.DoubleType()), T.StructField("lat", T.DoubleType())]))


def without_repeats(line: Column) -> Column:
    """The line without points equal to the one before."""
    return F.filter(line, lambda p, i: (i == 0) | (F.get(line, i - 1) != p))


def between(line: Column, first: Column, board: Column, last: Column, alight: Column) -> Column:
    """The line from a foot on segment ``board`` to one on segment ``alight``, board <= alight."""
    return F.concat(F.array(first), F.slice(line, board + 2, alight - board), F.array(last))


def _point(foot: Column) -> Column:
    return F.struct(foot["lon"].alias("lon"), foot["lat"].alias("lat"))


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value derived once, however often it is used there."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def ride_slice(shape: Column, from_lat: Column, from_lon: Column, to_lat: Column, to_lon: Column, seconds: Column) -> Column:
    """The ridden part of a trip's shape; null where a stop lies too far from it, or the part is too long for
    the time. Of all pairs of segments in order that with the least sum of distances is taken."""
    metres = lambda feet: F.transform(feet, lambda f: f["m"])

    def ends(feet: Column) -> Column:
        pair = geo.best_pair(metres(feet["b"]), metres(feet["a"]))
        return bound(pair, lambda p: F.struct(p["board"].alias("i"), p["alight"].alias("j"), F.get(feet["b"], p["board"]).alias("first"), F.get(feet["a"], p["alight"]).alias("last")))

    def told(e: Column) -> Column:
        near = F.greatest(e["first"]["m"], e["last"]["m"]) <= SHAPE_SNAP_M
        part = without_repeats(between(shape, _point(e["first"]), e["i"], _point(e["last"]), e["j"]))
        slow = lambda p: ~F.coalesce((seconds > 0) & (geo.line_length_m(p) / seconds > SHAPE_MAX_MPS), F.lit(False))
        return F.when(near, bound(part, lambda p: F.when((F.size(p) >= 2) & slow(p), p)))

    feet = F.struct(geo.snapped(shape, from_lat, from_lon).alias("b"), geo.snapped(shape, to_lat, to_lon).alias("a"))
    return F.when(F.size(shape) >= 2, bound(bound(feet, ends), told))


def rail_slice(line: Column, from_lat: Column, from_lon: Column, to_lat: Column, to_lon: Column) -> Column:
    """(far, part): the part of a rail line between two stations, turned where it runs the other way, and the
    larger of the stations' distances to it; null where that is over ``RAIL_SNAP_M``. ``part`` is
    null where it is a detour."""
    nearest = lambda feet: F.array_min(F.transform(feet, lambda f, i: F.struct(f["m"].alias("m"), i.alias("i"), f["lon"].alias("lon"), f["lat"].alias("lat"))))
    straight = geo.haversine(from_lat, from_lon, to_lat, to_lon)

    def told(e: Column) -> Column:
        a, b = e["a"], e["b"]
        forth = between(line, _point(a), a["i"], _point(b), b["i"])
        back = F.reverse(between(line, _point(b), b["i"], _point(a), a["i"]))
        part = bound(F.when(a["i"] <= b["i"], forth).otherwise(back), without_repeats)
        detour = lambda p: (straight > RAIL_LEAST_M) & (geo.line_length_m(p) > straight * RAIL_DETOUR)
        kept = bound(part, lambda p: F.when((F.size(p) >= 2) & ~detour(p), p))
        far = F.greatest(a["m"], b["m"])
        return F.when(far <= RAIL_SNAP_M, F.struct(far.alias("far"), kept.alias("part")))

    return bound(F.struct(nearest(geo.snapped(line, from_lat, from_lon)).alias("a"), nearest(geo.snapped(line, to_lat, to_lon)).alias("b")), told)


def is_spike(prev: Column, here: Column, following: Column) -> Column:
    """Whether going by ``here`` is a detour that no bus makes; points are structs of lat and lon."""
    metres = lambda p, q: geo.haversine(p["lat"], p["lon"], q["lat"], q["lon"])
    return metres(prev, here) + metres(here, following) > F.greatest(F.lit(SPIKE_MIN_M), metres(prev, following) * SPIKE_RATIO)


def upper_median(values: Column) -> Column:
    """The middle of the sorted values, the upper one of two."""
    return F.get(F.array_sort(values), (F.size(values) / 2).cast("int"))


def _off(p, a, b) -> float:
    dx, dy = b["lon"] - a["lon"], b["lat"] - a["lat"]
    norm = dx * dx + dy * dy
    t = max(0.0, min(1.0, ((p["lon"] - a["lon"]) * dx + (p["lat"] - a["lat"]) * dy) / norm)) if norm else 0.0
    return math.hypot(p["lon"] - a["lon"] - t * dx, p["lat"] - a["lat"] - t * dy)


def thinned(points: list, tolerance: float) -> list:
    """Douglas-Peucker with a stack: of each stretch the farthest point stays if it is off by more."""
    if len(points) < 3:
        return points
    keep, stack = {0, len(points) - 1}, [(0, len(points) - 1)]
    while stack:
        low, high = stack.pop()
        far, at = max(((_off(points[i], points[low], points[high]), -i) for i in range(low + 1, high)), default=(0.0, 0))
        if far > tolerance:
            keep.add(-at)
            stack += [(low, -at), (-at, high)]
    return [points[i] for i in sorted(keep)]


def simplified(line: Column, tolerance: float) -> Column:
    """The line with fewer points, none of the dropped ones farther off than the tolerance (in degrees)."""

    @F.pandas_udf(LINE)
    def thin(lines: pd.Series) -> pd.Series:
        return lines.map(lambda points: None if points is None else thinned(list(points), tolerance))

    return thin(line)


def stage_area_km2(rings: Column, lat: Column) -> Column:
    """Area of an array of rings at a latitude."""
    twice = F.aggregate(rings, F.lit(0.0), lambda total, ring: total + geo.ring_area_m2(ring, 1.0, 1.0))
    return twice * 111.0 * 111.0 * F.cos(F.radians(lat))


def vertex_mean(ring: Column) -> Column:
    """The mean of a ring's points, as they are listed."""
    mean = lambda name: F.aggregate(ring, F.lit(0.0), lambda s, p: s + p[name]) / F.size(ring)
    return F.struct(mean("lat").alias("lat"), mean("lon").alias("lon"))


def mask(rings: Column) -> Column:
    """The world's ring and the given ones as holes in it."""
    corner = lambda lon, lat: F.struct(F.lit(float(lon)).alias("lon"), F.lit(float(lat)).alias("lat"))
    world = F.array(corner(-180, -85), corner(180, -85), corner(180, 85), corner(-180, 85), corner(-180, -85))
    return F.concat(F.array(world), rings)
