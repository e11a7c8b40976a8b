"""Spatial joins over a grid: equal cells first, exact distance after."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from outways.functions import geo

#: Metres of a degree, a little short, so that cells are a little wide.
DEGREE_SHORT = 110_000.0
#: Rows of fewer cells than this, round the poles, are one cell each: there a degree's metres bend.
LEAST_CELLS = 12


def _row_height(metres: float) -> float:
    return metres / DEGREE_SHORT


def _cells_in(row: Column, metres: float) -> Column:
    """Into how many cells, each at least ``metres`` wide there and in the rows next to it, a row is cut."""
    height = _row_height(metres)
    edge = F.greatest(F.abs(row * height), F.abs((row + 1) * height)) + height
    n = F.floor(360.0 * DEGREE_SHORT / metres * F.cos(F.radians(F.least(edge, F.lit(90.0))))).cast("long")
    return F.when(n < LEAST_CELLS, F.lit(1).cast("long")).otherwise(n)


def _cell_at(lon: Column, cells: Column) -> Column:
    """The cell of a row that holds a longitude; cells go round the globe."""
    return F.pmod(F.floor((lon + 180.0) / 360.0 * cells).cast("long"), cells)


def _spot_pairs(left: DataFrame, right: DataFrame, metres: float, strict: bool, reach: float | None) -> DataFrame:
    """(lat, lon, r_lat, r_lon, metres): pairs of spots, each of which occurs once on its side."""
    size = float(reach or metres)
    height = _row_height(size)
    left = left.select("lat", "lon").distinct().withColumn("__y", geo.cell(F.col("lat"), height)).withColumn("__x", _cell_at(F.col("lon"), _cells_in(F.col("__y"), size)))
    right = right.select(F.col("lat").alias("r_lat"), F.col("lon").alias("r_lon")).distinct().withColumn("__y", F.explode(F.array(*[geo.cell(F.col("r_lat"), height) + d for d in (-1, 0, 1)])))
    right = right.withColumn("__n", _cells_in(F.col("__y"), size))
    around = F.array_distinct(F.array(*[F.pmod(_cell_at(F.col("r_lon"), F.col("__n")) + d, F.col("__n")) for d in (-1, 0, 1)]))
    right = right.withColumn("__x", F.explode(around)).drop("__n")
    pairs = left.join(right, ["__y", "__x"]).withColumn("metres", geo.haversine(F.col("lat"), F.col("lon"), F.col("r_lat"), F.col("r_lon")))
    return pairs.filter(F.col("metres") < metres if strict else F.col("metres") <= metres).drop("__y", "__x")


def within_metres(left: DataFrame, right: DataFrame, metres: float, strict: bool = False, reach: float | None = None, digits: int | None = None) -> DataFrame:
    """Pairs of rows closer than ``metres``, with column ``metres`` (told to so many ``digits``), anywhere on the globe.

    Both sides have lat and lon; the right one's columns must have other names than the left
    one's, but for these: they are r_lat and r_lon. Spots are met, not rows, so that copies at one spot cost no distance
    of their own: the right side's spots are dealt to their cell and the eight around it, so the shuffle is by cell and
    no pair is missed or met twice. Rows of cells have their own number of cells, fewer towards the poles,
    and close across longitude 180.
    """
    pairs = _spot_pairs(left, right, metres, strict, reach)
    if digits is not None:
        # Rounding is dear; here it is done once for a pair of spots.
        pairs = pairs.groupBy("lat", "lon", "r_lat", "r_lon").agg(F.round(F.first("metres"), digits).alias("metres"))
    # What a pair of spots multiplies into is spread over the tasks before it is written out.
    spread = left.join(pairs, ["lat", "lon"]).repartition("lat", "lon", "r_lat", "r_lon")
    return spread.join(right.withColumnsRenamed({"lat": "r_lat", "lon": "r_lon"}), ["r_lat", "r_lon"])


def nearest(left: DataFrame, right: DataFrame, metres: float, left_key: str, right_key: str, k: int = 1) -> DataFrame:
    """The ``k`` nearest rows of ``right`` under ``metres`` (strictly) of each row of ``left``.

    Ties go to the smaller key. No spot gives a row of ``left`` more than its ``k`` smallest keys, and rows of ``left`` at
    one spot have the same nearest, so that copies at a spot meet nothing twice. With k = 1 the nearest is an
    aggregate, with partial sums before the shuffle; otherwise ranks in a window.
    """
    pairs = _spot_pairs(left, right, metres, True, None)
    at, key = ["r_lat", "r_lon"], right.select(F.col("lat").alias("r_lat"), F.col("lon").alias("r_lon"), F.col(right_key).alias("__key"))
    best = F.min(F.struct("metres", "__key")).alias("best")
    if k == 1:
        first = key.groupBy(*at).agg(F.min(F.struct("__key")).alias("f")).select(*at, "f.__key")
        spots = pairs.join(first, at).groupBy("lat", "lon").agg(best).select("lat", "lon", "best.*")
        found = left.select(left_key, "lat", "lon").join(spots, ["lat", "lon"]).groupBy(left_key).agg(best)
        return found.select(left_key, F.col("best.__key").alias(right_key), F.col("best.metres").alias("metres"), F.lit(1).alias("rank"))
    first_k = lambda df, *by: df.withColumn("rank", F.row_number().over(Window.partitionBy(*by[:-1]).orderBy(*by[-1]))).filter(F.col("rank") <= k)
    spots = first_k(pairs.join(first_k(key, *at, ["__key"]).drop("rank"), at), "lat", "lon", ["metres", "__key"]).drop("rank", *at)
    found = first_k(left.select(left_key, "lat", "lon").join(spots, ["lat", "lon"]), left_key, ["metres", "__key"])
    return found.select(left_key, F.col("__key").alias(right_key), "metres", "rank")


def rings_with_boxes(polygons: DataFrame, ring: str = "ring") -> DataFrame:
    """Polygons with lat_min, lat_max, lon_min and lon_max of their ring."""
    at = lambda name: F.transform(ring, lambda p: p[name])
    return polygons.select(
        "*", F.array_min(at("lat")).alias("lat_min"), F.array_max(at("lat")).alias("lat_max"), F.array_min(at("lon")).alias("lon_min"), F.array_max(at("lon")).alias("lon_max")
    )


def containing(points: DataFrame, polygons: DataFrame, point_key: str, polygon_key: str, prefer: Column, tile: float = 0.01) -> DataFrame:
    """(point key, polygon key): the preferred polygon (least ``prefer``, then key) with each point.

    A polygon is dealt to the tiles of its box; points meet only the polygons of their tile.
    """
    boxes = rings_with_boxes(polygons)
    tiles = lambda low, high: F.explode(F.sequence(geo.cell(F.col(low), tile), geo.cell(F.col(high), tile)))
    dealt = boxes.withColumn("__y", tiles("lat_min", "lat_max")).withColumn("__x", tiles("lon_min", "lon_max"))
    inside = F.col("lat").between(F.col("lat_min"), F.col("lat_max")) & F.col("lon").between(F.col("lon_min"), F.col("lon_max"))
    met = points.withColumn("__y", geo.cell(F.col("lat"), tile)).withColumn("__x", geo.cell(F.col("lon"), tile)).join(dealt, ["__y", "__x"])
    met = met.filter(inside).filter(geo.in_ring(F.col("lat"), F.col("lon"), F.col("ring")))
    return met.groupBy(point_key).agg(F.min(F.struct(prefer.alias("p"), F.col(polygon_key))).alias("best")).select(point_key, f"best.{polygon_key}")
