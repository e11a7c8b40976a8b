"""Surveyed walkways: their links, and what they confirm about a way."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outways.operators import near

MATCH_M = 25.0
CODES = ("lev_diff", "width", "vtcl_slope", "roof", "elevator", "brail_tile", "route_type")
# Texts and codes of steps.
LEV_DIFF = {"1": "段差なし", "2": "2cm以下", "3": "2〜5cm", "4": "5〜10cm", "5": "10cm超", "99": "不明"}
FLAT, STEP = ("1", "2"), ("3", "4", "5")
NO_DATA = "このあたりは歩道の段差データがありません（OSM の情報だけで案内しています）"


def links(nodes: DataFrame, raw: DataFrame) -> DataFrame:
    """(ord, lat, lon, codes, km): surveyed links by their middle. nodes: node_id, lat, lon (text); raw: ord,
    start_id, end_id, distance and the codes, all text. Links with an unknown end are left out, a
    distance that is no number counts nothing."""
    point = nodes.select("node_id", F.col("lat").try_cast("double").alias("lat"), F.col("lon").try_cast("double").alias("lon")).filter("lat is not null and lon is not null").dropDuplicates(["node_id"])
    end = lambda side: point.select(F.col("node_id").alias(f"{side}_id"), F.col("lat").alias(f"{side}_lat"), F.col("lon").alias(f"{side}_lon"))
    met = raw.join(end("start"), "start_id").join(end("end"), "end_id")
    return met.select(
        "ord", ((F.col("start_lat") + F.col("end_lat")) / 2).alias("lat"), ((F.col("start_lon") + F.col("end_lon")) / 2).alias("lon"),
        *[F.trim(F.coalesce(c, F.lit(""))).alias(c) for c in CODES], F.coalesce(F.col("distance").try_cast("double") / 1000, F.lit(0.0)).alias("km"),
    )


def coverage(surveyed: DataFrame) -> DataFrame:
    """One row: links, km."""
    return surveyed.agg(F.count("*").alias("links"), F.round(F.coalesce(F.sum("km"), F.lit(0.0)), 1).alias("km"))


def annotated(segments: DataFrame, surveyed: DataFrame) -> DataFrame:
    """(way, checked, step_free, roofed, unknown, notes, remark): what the survey confirms along each way.

    segments: way, i, lat, lon (the middle of each segment). The nearest link under 25 m away tells; where
    all checked segments are flat, a remark says so.
    """
    keyed = segments.withColumn("segment", F.struct("way", "i"))
    hit = near.nearest(keyed.select("segment", "lat", "lon"), surveyed.select("ord", "lat", "lon"), MATCH_M, "segment", "ord").select("segment", "ord")
    told = keyed.join(hit, "segment", "left").join(surveyed.select("ord", "lev_diff", "roof"), "ord", "left")
    step = F.when(F.col("lev_diff").isin(*STEP), F.concat(F.try_element_at(F.create_map(*[F.lit(x) for item in LEV_DIFF.items() for x in item]), F.col("lev_diff")), F.lit("の段差が確認されています")))
    count = lambda c: F.count(F.when(c, 1))
    found = told.groupBy("way").agg(
        count(F.col("ord").isNotNull()).alias("checked"), count(F.col("lev_diff").isin(*FLAT)).alias("step_free"), count(F.col("roof") == "2").alias("roofed"), count(F.col("ord").isNull()).alias("unknown"),
        F.sort_array(F.collect_set(step)).alias("notes"),
    )
    flat = (F.col("checked") > 0) & (F.col("checked") == F.col("step_free"))
    return found.withColumn("remark", F.when(flat, F.format_string("歩道%d区間のうち%d区間で「段差なし」が確認できました", F.col("checked"), F.col("step_free"))))


def barrier_edges_near(edges: DataFrame, surveyed: DataFrame, cell: float = 0.01) -> DataFrame:
    """Edges (lat, lon of the middle) in cells that hold surveyed links or lie next to one: others can't match."""
    geo = near.geo
    cells = surveyed.select(F.explode(geo.neighbours(geo.cell(F.col("lat"), cell), geo.cell(F.col("lon"), cell))).alias("c")).distinct().select(F.col("c.y").alias("__y"), F.col("c.x").alias("__x"))
    return edges.withColumn("__y", geo.cell(F.col("lat"), cell)).withColumn("__x", geo.cell(F.col("lon"), cell)).join(cells, ["__y", "__x"], "left_semi").drop("__y", "__x")
