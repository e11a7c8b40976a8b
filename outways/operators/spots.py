"""Search and tallies over destinations.

A spot has id, ord (its place in the source, the last tie-break), name, facility_type, category,
lat, lon, age_min, age_max, area_m2, playground, toilet, official_url, dropin, event_start,
event_end, city, outside, hand (curated) and source_id. Flags are three-valued: null is unknown.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from outways.functions import geo, places

PARK = "公園"


def with_rank(spots: DataFrame) -> DataFrame:
    """Parks with ``park_rank``; null for other kinds."""
    rank = places.park_rank(F.col("name"), F.col("area_m2"), F.col("playground"), F.col("toilet"))
    return spots.withColumn("park_rank", F.when(F.col("facility_type") == PARK, rank))


def candidates(spots: DataFrame, lat: float, lon: float, months: int | None = None, categories: list[str] | None = None, on: str | None = None) -> DataFrame:
    """Spots that suit the age, the categories and the day, with ``metres`` and ``worth``."""
    keep = places.ages_match(F.col("age_min"), F.col("age_max"), months) & F.coalesce(F.col("dropin"), F.lit(True))
    if categories:
        keep = keep & (F.col("facility_type").isin(categories) | F.coalesce(F.col("category").isin(categories), F.lit(False)))
    if on:
        keep = keep & places.event_is_on(F.col("event_start"), F.col("event_end"), on)
    metres = geo.haversine(lat, lon, F.col("lat"), F.col("lon"))
    return with_rank(spots).filter(keep).withColumn("metres", metres).withColumn("worth", places.worth_going(F.col("park_rank"), F.col("metres")))


def search(spots: DataFrame, lat: float, lon: float, radius_km: float = 10.0, limit: int = 400, **how) -> DataFrame:
    """The nearest suitable spots in the circle, by whole metres and then ``ord``; parks only where
    they are worth the way."""
    found = candidates(spots, lat, lon, **how).filter(F.col("worth") & (F.col("metres") <= radius_km * 1000))
    return found.withColumn("distance_m", F.col("metres").cast("int")).orderBy("distance_m", "ord").limit(limit)


def search_summary(spots: DataFrame, lat: float, lon: float, radius_km: float = 10.0, **how) -> DataFrame:
    """One row: spots found before any limit, inside, outside, cities outside, parks skipped (at any
    distance)."""
    all_of = candidates(spots, lat, lon, **how)
    hit = F.col("worth") & (F.col("metres") <= radius_km * 1000)
    count = lambda c: F.count(F.when(c, 1))
    return all_of.agg(
        count(hit).alias("total"), count(hit & ~F.col("outside")).alias("inside"), count(hit & F.col("outside")).alias("outside"),
        F.countDistinct(F.when(hit & F.col("outside"), F.col("city"))).alias("outside_cities"), count(~F.col("worth")).alias("skipped_parks"),
    )


def reachable(spots: DataFrame, reach: DataFrame) -> DataFrame:
    """Spots in at least one reach (mode, y, x, and the grid's cell_lat, cell_lon) or next to a cell of it,
    with ``reach``: the modes in order."""
    y, x = F.floor(F.col("lat") / F.col("cell_lat")).cast("long"), F.floor(F.col("lon") / F.col("cell_lon")).cast("long")
    grids = reach.select("mode", "cell_lat", "cell_lon").distinct()
    near = spots.join(F.broadcast(grids)).withColumn("c", F.explode(geo.neighbours(y, x))).select("id", "mode", F.col("c.y").alias("y"), F.col("c.x").alias("x"))
    hit = near.join(reach.select("mode", "y", "x"), ["mode", "y", "x"], "left_semi").groupBy("id").agg(F.sort_array(F.collect_set("mode")).alias("reach"))
    return spots.join(hit, "id")


def picks(spots: DataFrame, lat: float, lon: float, radius_km: float = 10.0, limit: int = 6, **how) -> DataFrame:
    """Up to ``limit`` spots: the nearest of each kind in the order of picks, then the second, the third."""
    order = F.lit(None).cast("int")
    for i, kind in enumerate(places.PICK_ORDER):
        order = F.when(F.col("facility_type") == kind, i).otherwise(order)
    found = search(spots, lat, lon, radius_km, 4000, **how).withColumn("pick", order).filter("pick is not null")
    turn = F.row_number().over(Window.partitionBy("facility_type").orderBy("distance_m", "ord"))
    return found.withColumn("turn", turn).filter("turn <= 3").orderBy("turn", "pick").limit(limit)


def tally(spots: DataFrame, key: Column, name: str = "key") -> DataFrame:
    """Count by key, with the first ``ord`` that breaks ties."""
    return spots.groupBy(key.alias(name)).agg(F.count("*").alias("n"), F.min("ord").alias("first_ord"))


def categories(spots: DataFrame) -> DataFrame:
    kind = F.coalesce(F.nullif(F.col("facility_type"), F.lit("")), F.nullif(F.col("category"), F.lit("")), F.lit("その他"))
    return tally(spots.filter(F.coalesce(F.col("dropin"), F.lit(True))), kind, "category")


def visible(spots: DataFrame, hidden: list[str]) -> DataFrame:
    """Spots whose kind isn't hidden; the kind alone decides."""
    return spots.filter(~F.coalesce(F.col("facility_type"), F.lit("")).isin(hidden))


def events(spots: DataFrame, on: str, limit: int = 20) -> DataFrame:
    """Coming events by their start."""
    dated = spots.filter(F.coalesce(F.col("event_start"), F.lit("")) != "").filter(places.event_is_on(F.col("event_start"), F.col("event_end"), on))
    return dated.orderBy(F.coalesce("event_start", F.lit("9999")), "ord").limit(limit)


def by_id(inside: DataFrame, outside: DataFrame) -> DataFrame:
    """Spots by id; one from outside overrides one of the same id."""
    both = inside.withColumn("__o", F.lit(0)).unionByName(outside.withColumn("__o", F.lit(1)), allowMissingColumns=True)
    last = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("__o"), F.desc("ord")))
    return both.withColumn("__r", last).filter("__r = 1").drop("__r", "__o")


def drop_enrolment(spots: DataFrame) -> DataFrame:
    """Spots but those known to need enrolment."""
    return spots.filter("dropin is null or dropin")


def park_summary(spots: DataFrame) -> DataFrame:
    """Parks by side and rank, with how many have an area."""
    parks = with_rank(spots).filter(F.col("facility_type") == PARK)
    return parks.groupBy("outside", "park_rank").agg(F.count("*").alias("n"), F.count(F.when(F.col("area_m2") > 0, 1)).alias("with_area"))


def coverage(spots: DataFrame) -> DataFrame:
    """One row of counts: what is known about how many spots."""
    known = lambda c: F.count(F.when(c, 1))
    return spots.agg(
        F.count("*").alias("spots"), known(F.col("dropin")).alias("dropin"), known(F.col("facility_type") == PARK).alias("parks"),
        known(places.has_web_info(F.col("official_url"))).alias("with_url"), known(F.col("event_start") != "").alias("events"),
        known(F.col("toilet")).alias("with_toilet"), known(F.col("area_m2") > 0).alias("with_area"), known(F.col("age_min").isNotNull()).alias("with_ages"),
        F.countDistinct("city").alias("cities"), F.countDistinct("facility_type").alias("kinds"), known(F.col("outside")).alias("outside"),
        known(F.col("dropin").isNull()).alias("dropin_unknown"),
    )


def park_sizes(parks: DataFrame, polygons: DataFrame) -> DataFrame:
    """(id, area_m2, how): a park's size from its page's text, else the smallest polygon around it (where
    several parks lie in it, only for those of its name), else a polygon of the same name whose
    box's middle is under 300 m away.

    parks: id, ord, name, key, lat, lon, page_text; polygons: poly, pkey, ring, area, plat, plon.
    """
    from outways.operators.near import containing

    stated = F.trim(F.translate(F.coalesce("page_text", F.lit("")), "約,", ""))
    pattern = r"^([0-9.]+)\s*(ヘクタール|平方メートル|㎡|m2)"
    value = F.regexp_extract(stated, pattern, 1).try_cast("double")
    said = (value * F.when(F.regexp_extract(stated, pattern, 2) == "ヘクタール", 10000).otherwise(1)).cast("long").cast("double")
    parks = parks.withColumn("said", F.nullif(said, F.lit(0.0)))
    held = containing(parks, polygons, "id", "poly", F.col("area")).join(parks.select("id", "key"), "id")
    shared = held.groupBy("poly").agg(F.count("*").alias("parks"))
    around = held.join(shared, "poly").join(polygons.select("poly", "pkey", "area"), "poly").filter((F.col("parks") == 1) | (F.col("pkey") == F.col("key"))).select("id", F.col("area").alias("around"))
    near = parks.join(polygons.select("poly", "pkey", "plat", "plon", F.col("area").alias("named_area")), F.col("key") == F.col("pkey"))
    close = (F.abs(F.col("lat") - F.col("plat")) * 111000 < 300) & (F.abs(F.col("lon") - F.col("plon")) * 91000 < 300)
    named = near.filter(close).groupBy("id").agg(F.min(F.struct("poly", "named_area")).alias("b")).select("id", F.col("b.named_area").alias("named"))
    out = parks.join(around, "id", "left").join(named, "id", "left")
    how = F.when(F.col("said").isNotNull(), "text").when(F.col("around").isNotNull(), "polygon").when(F.col("named").isNotNull(), "name")
    return out.select("id", F.coalesce("said", "around", "named").alias("area_m2"), how.alias("how"))


def with_details(spots: DataFrame, details: DataFrame) -> DataFrame:
    """Spots overlaid with details of the same name within 0.02 degrees; the closed ones go.

    details: key, d_ord, d_lat, d_lon (null: anywhere), closed, and d_* flags: a flag only ever
    turns true; texts fill gaps only.
    """
    close = F.coalesce(F.hypot(F.col("lat") - F.col("d_lat"), F.col("lon") - F.col("d_lon")) <= 0.02, F.lit(True))
    met = spots.join(details, "key", "left").withColumn("__ok", F.coalesce(close & F.col("d_ord").isNotNull(), F.lit(False)))
    first = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("__ok"), "d_ord"))
    met = met.withColumn("__r", first).filter("__r = 1")
    flag = lambda own, new: F.when(F.col("__ok") & F.coalesce(F.col(new), F.lit(False)), True).otherwise(F.col(own))
    return (
        met.filter(~(F.col("__ok") & F.coalesce(F.col("closed"), F.lit(False))))
        .withColumn("toilet", flag("toilet", "d_toilet"))
        .withColumn("official_url", F.coalesce("official_url", F.when(F.col("__ok"), F.col("d_url"))))
        .select(*spots.columns)
    )
