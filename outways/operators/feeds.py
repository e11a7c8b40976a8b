"""Freshness of feeds, cached responses and weather advice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The outcomes of a freshness check.
MISSING, CHANGED, CURRENT, CHECK, RESENT = "手元に無い", "更新あり", "最新", "要確認", "最新（配信し直しただけ）"


def verdict(local_size: Column, remote_size: Column, remote_newer: Column, same_body: Column) -> Column:
    """Whether a feed has to be fetched again."""
    return (
        F.when(local_size.isNull(), MISSING)
        .when(remote_size.isNotNull() & (remote_size != local_size), CHANGED)
        .when(~F.coalesce(remote_newer, F.lit(False)), CURRENT)
        .when(same_body.isNull(), CHECK)
        .when(same_body, RESENT)
        .otherwise(CHANGED)
    )


def latest_within(responses: DataFrame, key: str, at: str, value: str, now: Column, ttl_seconds: int) -> DataFrame:
    """The last response of each key that isn't older than the time to live; a cached failure is a null value."""
    fresh = responses.filter((F.col(at) <= now) & (F.unix_micros(now) - F.unix_micros(at) < ttl_seconds * 1_000_000))
    return fresh.groupBy(key).agg(F.max(F.struct(at, value)).alias("last")).select(key, F.col(f"last.{at}").alias(at), F.col(f"last.{value}").alias(value))


def forecast(body: Column) -> Column:
    """(weather, pops, temp_max) of a forecast document as text: the first area of each series."""
    area = "struct<weathers:array<string>,pops:array<string>,temps:array<string>>"
    parsed = F.from_json(body, f"array<struct<timeSeries:array<struct<areas:array<{area}>>>>>")
    series = F.get(parsed, F.lit(0))["timeSeries"]
    first = lambda i: F.get(F.get(series, F.lit(i))["areas"], F.lit(0))
    temps = F.filter(F.transform(first(2)["temps"], lambda t: t.try_cast("int")), lambda t: t.isNotNull())
    return F.struct(F.get(first(0)["weathers"], F.lit(0)).alias("weather"), first(1)["pops"].alias("pops"), F.array_max(temps).alias("temp_max"))


# Words of bad weather, chance of rain in percent, and degrees of a hot and of a warm day.
BAD_WEATHER, LIKELY_RAIN, HOT, WARM = ("雨", "雪", "雷"), 50, 35, 31


def advice(indoor: Column, weather: Column, pops: Column, temp_max: Column) -> Column:
    """Notes (level, text) for a trip; a place not known to be outdoors counts as indoors.

    Outdoors a word of bad weather comes before the chance of rain, then heat before warmth; indoors
    only bad weather is worth a note. No forecast, no note.
    """
    weather = F.coalesce(weather, F.lit(""))
    bad = F.lit(False)
    for word in BAD_WEATHER:
        bad = bad | weather.contains(word)
    chance = F.array_max(F.transform(F.filter(pops, lambda p: p.rlike("^[0-9]+$")), lambda p: p.try_cast("int")))
    outdoor = ~F.coalesce(indoor, F.lit(True))
    note = lambda level, *text: F.struct(F.lit(level).alias("level"), F.concat(*[t if isinstance(t, Column) else F.lit(t) for t in text]).alias("text"))
    degrees = temp_max.cast("string")
    rain = F.when(bad, note("warn", "今日の天気は「", weather, "」です。屋根のある行き先も見てみてください")).when(chance >= LIKELY_RAIN, note("warn", "降水確率が", chance.cast("string"), "%あります。雨具の用意を"))
    heat = F.when(temp_max >= HOT, note("warn", "最高気温", degrees, "℃の猛暑日です。ベビーカーは地面に近く暑くなります")).when(temp_max >= WARM, note("info", "最高気温", degrees, "℃です。日陰と水分を用意してください"))
    dry = F.when(bad, note("info", "屋内なので、雨の日でも過ごせます"))
    return F.filter(F.array(F.when(outdoor, rain), F.when(outdoor, heat), F.when(~outdoor, dry)), lambda n: n.isNotNull())


def active_warnings(body: Column) -> Column:
    """Codes of the warnings in force in a warning document."""
    parsed = F.from_json(body, "struct<areaTypes:array<struct<areas:array<struct<warnings:array<struct<code:string,status:string>>>>>>>")
    all_of = F.flatten(F.transform(F.flatten(F.transform(parsed["areaTypes"], lambda t: t["areas"])), lambda a: a["warnings"]))
    return F.array_distinct(F.transform(F.filter(all_of, lambda w: w["status"].isin("発表", "継続")), lambda w: w["code"]))
