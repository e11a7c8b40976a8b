"""Geometry on WGS84 degrees as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6371000.0
#: Metres of a degree of latitude where the earth is taken as flat.
DEGREE_M = 111000.0


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def haversine(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle metres."""
    lat1, lon1, lat2, lon2 = map(_col, (lat1, lon1, lat2, lon2))
    p = F.lit(math.pi / 180)
    h = F.pow(F.sin((lat2 - lat1) * p / 2), 2.0) + F.cos(lat1 * p) * F.cos(lat2 * p) * F.pow(F.sin((lon2 - lon1) * p / 2), 2.0)
    return F.lit(2 * EARTH_M) * F.asin(F.sqrt(h))


def planar_m(lat1, lon1, lat2, lon2, lon_m: float = 91000.0) -> Column:
    """Metres on a plane with fixed lengths of a degree (of longitude near 35 degrees north)."""
    lat1, lon1, lat2, lon2 = map(_col, (lat1, lon1, lat2, lon2))
    return F.hypot((lat1 - lat2) * DEGREE_M, (lon1 - lon2) * lon_m)


def cell(value: Column, size: float) -> Column:
    """Number of the grid cell that holds a coordinate."""
    return F.floor(value / size).cast("long")


def cell_size_m(minutes: Column) -> Column:
    """Reach cells grow with the time limit."""
    return F.when(minutes <= 20, 100).when(minutes <= 40, 150).otherwise(200)


def neighbours(y: Column, x: Column, radius: int = 1) -> Column:
    """Array of (y, x) of the cell and those around it."""
    ds = list(range(-radius, radius + 1))
    return F.array(*[F.struct((y + a).alias("y"), (x + b).alias("x")) for a in ds for b in ds])


def _edges(ring: Column) -> Column:
    """(a, b) of neighbouring points of a line; for a ring repeat its first point at the end."""
    return F.zip_with(F.slice(ring, 1, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def closed(ring: Column) -> Column:
    """The ring with its first point at the end."""
    return F.when(F.size(ring) > 0, F.concat(ring, F.slice(ring, 1, 1))).otherwise(ring)


def in_ring(lat: Column, lon: Column, ring: Column) -> Column:
    """Even-odd test of a point against a ring of (lon, lat); the ring need not be closed."""
    def crosses(e: Column) -> Column:
        a, b = e["a"], e["b"]
        astride = (a["lat"] > lat) != (b["lat"] > lat)
        return astride & (lon < (b["lon"] - a["lon"]) * F.try_divide(lat - a["lat"], b["lat"] - a["lat"]) + a["lon"])

    return F.aggregate(_edges(closed(ring)), F.lit(False), lambda odd, e: odd != F.coalesce(crosses(e), F.lit(False)))


def ring_area_m2(ring: Column, lat_m: Column | float = DEGREE_M, lon_m: Column | float = DEGREE_M) -> Column:
    """Shoelace area with the given metres of a degree; 0 under three points."""
    twice = F.aggregate(_edges(closed(ring)), F.lit(0.0), lambda s, e: s + e["a"]["lon"] * e["b"]["lat"] - e["b"]["lon"] * e["a"]["lat"])
    return F.abs(twice) / 2 * _col(lat_m) * _col(lon_m)


def line_length_m(line: Column) -> Column:
    return F.aggregate(_edges(line), F.lit(0.0), lambda s, e: s + haversine(e["a"]["lat"], e["a"]["lon"], e["b"]["lat"], e["b"]["lon"]))


def snapped(line: Column, lat: Column, lon: Column) -> Column:
    """For each segment of a line: (m, lat, lon), the nearest point on it and the metres to it."""
    k = F.cos(F.radians(lat))

    def foot(e: Column) -> Column:
        a, b = e["a"], e["b"]
        dx, dy = (b["lon"] - a["lon"]) * k, b["lat"] - a["lat"]
        along = F.try_divide((lon - a["lon"]) * k * dx + (lat - a["lat"]) * dy, dx * dx + dy * dy)
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(along, F.lit(0.0))))
        y, x = a["lat"] + (b["lat"] - a["lat"]) * t, a["lon"] + (b["lon"] - a["lon"]) * t
        return F.struct(haversine(lat, lon, y, x).alias("m"), y.alias("lat"), x.alias("lon"))

    return F.transform(_edges(line), foot)


def best_pair(board: Column, alight: Column) -> Column:
    """(total, board, alight): indices of the segments with board <= alight and the least sum of
    distances, from two arrays of metres; the first such pair."""
    # Bound by a lambda, the arrays are made once and not again for every index.
    both = F.array(F.struct(board.alias("board"), alight.alias("alight")))
    return F.get(F.transform(both, lambda m: _best_pair(m["board"], m["alight"])), F.lit(0))


def _best_pair(board: Column, alight: Column) -> Column:
    start = F.struct(F.lit(None).cast("double").alias("total"), F.lit(None).cast("int").alias("board"), F.lit(None).cast("int").alias("alight"), F.lit(None).cast("int").alias("run"))

    def step(best: Column, j: Column) -> Column:
        run = F.when(best["run"].isNull() | (F.get(board, j) < F.get(board, best["run"])), j).otherwise(best["run"])
        total = F.get(board, run) + F.get(alight, j)
        better = best["total"].isNull() | (total < best["total"])
        return F.struct(
            F.when(better, total).otherwise(best["total"]).alias("total"),
            F.when(better, run).otherwise(best["board"]).alias("board"),
            F.when(better, j).otherwise(best["alight"]).alias("alight"),
            run.alias("run"),
        )

    indices = F.when(F.size(alight) > 0, F.sequence(F.lit(0), F.size(alight) - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(indices, start, step, lambda s: F.struct(s["total"].alias("total"), s["board"].alias("board"), s["alight"].alias("alight")))


def circle(lat: Column, lon: Column, metres: float, steps: int = 128) -> Column:
    """Closed ring of (lon, lat) around a point."""
    k = 2 * math.pi / steps
    return F.transform(
        F.sequence(F.lit(0), F.lit(steps)),
        lambda i: F.struct((lon + metres / DEGREE_M / F.cos(F.radians(lat)) * F.cos(i * k)).alias("lon"), (lat + metres / DEGREE_M * F.sin(i * k)).alias("lat")),
    )
