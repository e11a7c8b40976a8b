"""GeoJSON, OSM extracts, text in several encodings, and crawled pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from outways.functions import geo

POINT = "struct<lon:double,lat:double>"


def decoded(content: Column, encodings: tuple[str, ...] = ("UTF-8", "windows-31j", "UTF-16")) -> Column:
    """Bytes as text by the first encoding that reads them without a replacement character.

    Other charsets than the standard ones need ``spark.sql.legacy.javaCharsets``.
    """
    text = F.lit(None).cast("string")
    for encoding in reversed(encodings):
        try_one = F.decode(content, encoding)
        text = F.when(~try_one.contains("�"), try_one).otherwise(text)
    return F.regexp_replace(text, "^﻿", "")


def csv_bytes(spark: SparkSession, path: str, schema: str, encodings: tuple[str, ...] = ("UTF-8",)) -> DataFrame:
    """Rows of small CSV files of unknown encoding, with the file's name: decoded whole, one file a row,
    then parsed by Spark's CSV reader. A line break inside quotes doesn't end a row. Files must fit a row."""
    text = spark.read.format("binaryFile").load(path).select("path", decoded(F.col("content"), encodings).alias("text"))
    record = r'(?:[^"\r\n]++|"(?:[^"]++|"")*+"?+)++'
    lines = text.select("path", F.posexplode(F.regexp_extract_all("text", F.lit(record), F.lit(0))).alias("ord", "line")).filter("ord > 0 and trim(line) <> ''")
    return lines.select("path", "ord", F.from_csv("line", schema, {"mode": "PERMISSIVE", "escape": "\""}).alias("r")).select("path", "ord", "r.*")


def geojson_lines(spark: SparkSession, path: str, properties: str) -> DataFrame:
    """(properties, line): LineString features with at least two points."""
    schema = f"features array<struct<properties:{properties},geometry:struct<type:string,coordinates:array<array<double>>>>>"
    features = spark.read.option("multiLine", True).schema(schema).json(path).select(F.explode("features").alias("f")).select("f.properties", "f.geometry.coordinates")
    line = F.transform("coordinates", lambda p: F.struct(p[0].alias("lon"), p[1].alias("lat")))
    return features.filter(F.size("coordinates") >= 2).select("properties", line.alias("line"))


def geojson_rings(spark: SparkSession, path: str, properties: str) -> DataFrame:
    """(properties, ring): outer rings of Polygon and MultiPolygon features."""
    raw = spark.read.option("multiLine", True).schema(f"features array<struct<properties:{properties},geometry:struct<type:string,coordinates:string>>>").json(path)
    f = raw.select(F.explode("features").alias("f")).select("f.properties", "f.geometry.type", "f.geometry.coordinates")
    polygon = F.from_json("coordinates", "array<array<array<double>>>")
    many = F.from_json("coordinates", "array<array<array<array<double>>>>")
    rings = F.when(F.col("type") == "Polygon", F.array(polygon[0])).otherwise(F.transform(many, lambda p: p[0]))
    return f.select("properties", F.explode(rings).alias("r")).select("properties", F.transform("r", lambda p: F.struct(p[0].alias("lon"), p[1].alias("lat"))).alias("ring"))


def geojson_sequence(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Features of a line-delimited file, with or without record separators."""
    return spark.read.text(path).select(F.from_json(F.regexp_replace("value", "^\x1e", ""), schema).alias("f")).filter("f is not null").select("f.*")


WAY = "_id long, nd array<struct<_ref:long>>, tag array<struct<_k:string,_v:string>>"
NODE = "_id long, _lat double, _lon double, tag array<struct<_k:string,_v:string>>"


def osm_ways(spark: SparkSession, path: str) -> DataFrame:
    """(way, refs, tags) of an OSM XML extract."""
    ways = spark.read.format("xml").option("rowTag", "way").schema(WAY).load(path)
    return ways.select(F.col("_id").alias("way"), F.transform("nd", lambda n: n["_ref"]).alias("refs"), _tags())


def osm_nodes(spark: SparkSession, path: str) -> DataFrame:
    nodes = spark.read.format("xml").option("rowTag", "node").schema(NODE).load(path)
    return nodes.select(F.col("_id").alias("node"), F.col("_lat").alias("lat"), F.col("_lon").alias("lon"), _tags())


def _tags() -> Column:
    pairs = F.transform(F.coalesce("tag", F.array().cast("array<struct<_k:string,_v:string>>")), lambda t: F.struct(t["_k"].alias("k"), t["_v"].alias("v")))
    return F.map_from_entries(F.array_distinct(pairs)).alias("tags")


# Roads that can't be walked, and roads cars may use.
NO_WALK = ("motorway", "motorway_link", "trunk", "trunk_link")
CAR_ROADS = ("motorway", "motorway_link", "trunk", "trunk_link", "primary", "primary_link", "secondary", "secondary_link", "tertiary", "residential", "living_street", "service", "unclassified", "busway", "road")


def road_edges(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges of neighbouring nodes of each way, with lengths and who may use them; zero ones go."""
    tag = lambda k: F.try_element_at(F.col("tags"), F.lit(k))
    steps = ways.filter(tag("highway").isNotNull()).select("way", "tags", F.posexplode("refs").alias("i", "a"), "refs")
    steps = steps.withColumn("b", F.try_element_at("refs", F.col("i") + 2)).filter("b is not null").drop("refs")
    at = lambda key: nodes.select(F.col("node").alias(key), F.col("lat").alias(f"{key}_lat"), F.col("lon").alias(f"{key}_lon"))
    met = steps.join(at("a"), "a").join(at("b"), "b").withColumn("length", F.round(geo.haversine(F.col("a_lat"), F.col("a_lon"), F.col("b_lat"), F.col("b_lon")), 2))
    highway, foot, bicycle = tag("highway"), F.coalesce(tag("foot"), F.lit("")), F.coalesce(tag("bicycle"), F.lit(""))
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    return met.filter("length > 0").select(
        "a", "b", "length", highway.alias("highway"), F.map_filter("tags", lambda k, _: k != "highway").alias("attrs"),
        flag(~highway.isin(*NO_WALK) & (foot != "no")).alias("walk"), flag(~highway.isin(*NO_WALK, "steps") & (bicycle != "no")).alias("bike"),
        flag(highway.isin(*CAR_ROADS)).alias("car"), flag(tag("oneway").isin("yes", "1", "true")).alias("oneway"),
    )


def crawled_pages(spark: SparkSession, path: str, section: str) -> DataFrame:
    """Crawled page records as JSON lines."""
    return spark.read.schema("url string, page_id string, title string, html string").json(path).withColumn("section", F.lit(section))
