"""GTFS folders as typed tables.

A missing file is an empty table. Ids and codes stay text; times become seconds. Tables with a
primary key keep the last row of a key. Every key is qualified by the feed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from outways.functions import clock

#: File, columns in the file, primary key (none: repeated rows stay).
FILES = {
    "stop": ("stops", ["stop_id", "stop_name", "stop_lat", "stop_lon", "location_type", "parent_station", "wheelchair_boarding"], ["stop_id"]),
    "route": ("routes", ["route_id", "agency_id", "route_short_name", "route_long_name", "route_type"], ["route_id"]),
    "trip": ("trips", ["trip_id", "route_id", "service_id", "trip_headsign", "shape_id", "wheelchair_accessible"], ["trip_id"]),
    "stop_time": ("stop_times", ["trip_id", "stop_sequence", "stop_id", "arrival_time", "departure_time"], []),
    "calendar": ("calendar", ["service_id", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday", "start_date", "end_date"], ["service_id"]),
    "calendar_date": ("calendar_dates", ["service_id", "date", "exception_type"], []),
    "shape_point": ("shapes", ["shape_id", "shape_pt_sequence", "shape_pt_lat", "shape_pt_lon"], []),
    "fare_attribute": ("fare_attributes", ["fare_id", "price", "currency_type"], ["fare_id"]),
    "fare_rule": ("fare_rules", ["fare_id", "route_id", "origin_id", "destination_id"], []),
    "pathway": ("pathways", ["pathway_id", "from_stop_id", "to_stop_id", "pathway_mode", "is_bidirectional", "length"], []),
}


def exists(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(hadoop_path))


def csv_table(spark: SparkSession, base: str, name: str, columns: list[str]) -> DataFrame:
    """``name.txt`` or ``name.csv`` in a folder or one below, all columns as text and null where the
    file lacks them; a byte order mark is dropped; a missing file is an empty table. ``ord`` counts
    the rows in turn."""
    for pattern in (f"{base}/{name}.txt", f"{base}/{name}.csv", f"{base}/*/{name}.txt", f"{base}/*/{name}.csv"):
        if exists(spark, pattern):
            raw = spark.read.option("header", True).option("inferSchema", False).csv(pattern)
            raw = raw.toDF(*[c.lstrip("﻿").strip() for c in raw.columns])
            picked = [(F.col(c) if c in raw.columns else F.lit(None)).cast("string").alias(c) for c in columns]
            return raw.select(*picked, F.monotonically_increasing_id().alias("ord"))
    return spark.createDataFrame([], T.StructType([T.StructField(c, T.StringType()) for c in columns] + [T.StructField("ord", T.LongType())]))


def last_wins(df: DataFrame, key: list[str]) -> DataFrame:
    newest = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("ord")))
    return df.withColumn("__r", newest).filter("__r = 1").drop("__r")


def _blank(c: str) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def _number(c: str) -> Column:
    return F.trim(F.col(c)).try_cast("double")


def load_feed(spark: SparkSession, feed_id: str, base: str) -> dict[str, DataFrame]:
    """The tables of one feed, by name."""
    raw = {}
    for table, (name, columns, key) in FILES.items():
        df = csv_table(spark, base, name, columns)
        raw[table] = last_wins(df, key) if key else df
    integer = lambda c, default=0: clock.lenient_int(F.col(c), default)
    tables = {
        "stop": raw["stop"].filter(_number("stop_lat").isNotNull()).select(
            "stop_id", "stop_name", _number("stop_lat").alias("lat"), _number("stop_lon").alias("lon"), integer("location_type").alias("location_type"), _blank("parent_station").alias("parent_station"), F.trim("wheelchair_boarding").alias("wheelchair_boarding")
        ),
        "route": raw["route"].select("route_id", "agency_id", F.col("route_short_name").alias("short_name"), F.col("route_long_name").alias("long_name"), integer("route_type", 3).alias("route_type")),
        "trip": raw["trip"].select("trip_id", "route_id", "service_id", F.col("trip_headsign").alias("headsign"), "shape_id", F.trim(F.coalesce("wheelchair_accessible", F.lit(""))).alias("wheelchair")),
        "stop_time": raw["stop_time"].filter(_blank("stop_id").isNotNull()).select("trip_id", integer("stop_sequence").alias("seq"), "stop_id", clock.to_seconds(F.col("arrival_time")).alias("arr"), clock.to_seconds(F.col("departure_time")).alias("dep")),
        "calendar": raw["calendar"].select("service_id", *[integer(day).alias(day[:3]) for day in FILES["calendar"][1][1:8]], "start_date", "end_date"),
        "calendar_date": raw["calendar_date"].select("service_id", "date", integer("exception_type").alias("exception_type"), "ord"),
        "shape_point": raw["shape_point"].filter(_number("shape_pt_lat").isNotNull()).select("shape_id", integer("shape_pt_sequence").alias("seq"), _number("shape_pt_lat").alias("lat"), _number("shape_pt_lon").alias("lon")),
        "fare_attribute": raw["fare_attribute"].filter(_number("price").isNotNull()).select("fare_id", _number("price").alias("price"), F.col("currency_type").alias("currency")),
        "fare_rule": raw["fare_rule"].drop("ord"),
        "pathway": raw["pathway"].select("pathway_id", F.col("from_stop_id").alias("from_stop"), F.col("to_stop_id").alias("to_stop"), integer("pathway_mode").alias("mode"), integer("is_bidirectional").alias("bidirectional"), _number("length").alias("length")),
    }
    return {name: df.select(F.lit(feed_id).alias("feed_id"), "*") for name, df in tables.items()}


def load_feeds(spark: SparkSession, feeds: dict[str, str]) -> dict[str, DataFrame]:
    """The union of several feeds' tables; feeds: id to folder, folders that don't exist are skipped."""
    merged: dict[str, DataFrame] = {}
    for feed_id, base in feeds.items():
        if exists(spark, base):
            for name, df in load_feed(spark, feed_id, base).items():
                merged[name] = merged[name].unionByName(df) if name in merged else df
    return merged


def write_store(tables: dict[str, DataFrame], path: str) -> None:
    """Parquet tables, dealt by feed."""
    for name, df in tables.items():
        df.write.mode("overwrite").partitionBy("feed_id").parquet(f"{path}/{name}")
