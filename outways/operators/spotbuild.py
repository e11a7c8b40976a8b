"""Destinations from municipal files: one loader a kind of file, and the build from all of them.

A loader takes the rows of a file, whose columns are the file's own headers, with ``ord``, the row's place
in it; and the source: id, label, url and, per kind, category, sub, include_path, exclude_name,
lg_code or lg_codes. It returns rows of ``SPOT``.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from outways.functions import labels, names, places
from outways.operators import entity, pages, spots

SPOT = (
    "id string, ord long, name string, lat double, lon double, category string, facility_type string, dropin boolean, visit_note string, age_min int, age_max int, open_time string, close_time string, closed_days string, "
    "fee_text string, fee_free boolean, stroller_ok boolean, nursing_room boolean, diaper_table boolean, hot_water boolean, indoor boolean, capacity string, note string, source_id string, source_label string, source_url string, "
    "checked_at string, official_url string, official_label string, summary string, area_m2 int, open_hours string, event_start string, event_end string, place_name string, playground string, toilet boolean, city string, park_rank string, outside boolean"
)
FIELDS = [f.split() for f in SPOT.split(", ")]
# Notes on visits, kinds, and words of files.
DROPIN_NOTE, ENROL_NOTE = "予約なしで、その日に行けます", "入園・入会の手続きが要る施設です（見学は要問い合わせ）"
HOT_SPACE, DIAPER, EVENT, PARK = "赤ちゃんほっとスペース", labels.DIAPER_KIND, "イベント", "公園"
DIAPER_SUMMARY = "車椅子使用者対応トイレで、**おむつ交換台があります**。東京都がバリアフリー情報として公開しているものです。"
DIAPER_LABEL, CHAIR_NOTE = "ほこナビ バリアフリー施設等データ（東京都）", "ベビーチェアもあります"
YES = ("1", "true", "yes", "有", "○")
BABY_AGES = (-9, 35)
AREA = r"面積[（(]?㎡?[)）]?\s*[:：]\s*([0-9,]+(?:\.[0-9]+)?)\s*(?:平方メートル|㎡)?"


@dataclass(frozen=True)
class Source:
    id: str
    label: str | None = None
    url: str | None = None
    category: str | None = None
    sub: tuple[str, ...] = ()
    include_path: tuple[str, ...] = ()
    exclude_name: tuple[str, ...] = ()
    lg_code: str | None = None
    lg_codes: dict[str, str] = field(default_factory=dict)


def _field(rows: DataFrame, name: str) -> Column:
    """A trimmed field, null where it is blank or the file has no such column."""
    return F.nullif(F.trim(F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))), F.lit("")) if name in rows.columns else F.lit(None).cast("string")


def base_spots(rows: DataFrame, source: Source, name: Column, lat: Column, lon: Column, category: Column, kind: Column | None = None, ages: tuple[int, int] | None = None, **fields: Column) -> DataFrame:
    """Spots with the defaults of a source: the kind from name and category where none is given, whether one may
    drop in, ages by kind, category and name, and a note on visits."""
    kind = F.coalesce(F.nullif(kind, F.lit("")) if kind is not None else F.lit(None).cast("string"), places.facility_kind(F.concat_ws(" ", name, category), F.lit(None).cast("string"), F.lit(None).cast("string")))
    span = F.struct(F.lit(ages[0]).alias("age_min"), F.lit(ages[1]).alias("age_max")) if ages else labels.ages_for(F.coalesce(F.col("__kind"), F.lit("")), category, name)
    dropin = fields.pop("dropin", None)
    dropin = places.is_dropin(F.col("__kind")) if dropin is None else F.coalesce(dropin, places.is_dropin(F.col("__kind")))
    note = fields.pop("visit_note", F.lit(None).cast("string"))
    values = {
        "id": F.concat(F.lit(f"{source.id}:"), F.col("ord").cast("string")), "ord": F.col("ord"), "name": F.trim(name), "lat": lat, "lon": lon, "category": category, "facility_type": F.col("__kind"), "dropin": dropin,
        "visit_note": F.coalesce(note, F.when(dropin, DROPIN_NOTE).when(~dropin, ENROL_NOTE)), "age_min": span["age_min"], "age_max": span["age_max"], "source_id": F.lit(source.id),
        "source_label": F.lit(source.label), "source_url": F.lit(source.url), "outside": F.lit(False),
    } | fields
    # The kind stands in many fields: derived once, in a step of its own.
    rows = rows.withColumn("__kind", kind)
    return rows.select(*[(values[f] if f in values else F.lit(None)).try_cast(t).alias(f) for f, t in FIELDS])


def _located(rows: DataFrame, lat: str, lon: str) -> tuple[Column, Column, Column]:
    y, x = _field(rows, lat).try_cast("double"), _field(rows, lon).try_cast("double")
    return y, x, y.isNotNull() & x.isNotNull()


def facilities(rows: DataFrame, source: Source) -> DataFrame:
    """A list of public facilities, with codes of their kinds; parks are outdoors and free."""
    name, (lat, lon, there) = _field(rows, "名称"), _located(rows, "緯度", "経度")
    given = F.lit(source.category) if source.category else _field(rows, "小分類")
    kind = F.lit(source.category) if source.category else places.facility_kind(name, _field(rows, "POIコード"), given)
    category = F.coalesce(F.lit(source.category), kind, F.lit(source.label))
    park = F.coalesce(category, F.lit("")).contains(PARK)
    return base_spots(rows.filter(name.isNotNull() & there), source, name, lat, lon, category, kind, indoor=F.when(park, False), fee_free=F.when(park, True))


def hot_spaces(rows: DataFrame, source: Source) -> DataFrame:
    """Places to nurse and change."""
    name, (lat, lon, there) = _field(rows, "名称"), _located(rows, "緯度", "経度")
    true = F.lit(True)
    return base_spots(rows.filter(name.isNotNull() & there), source, name, lat, lon, F.lit(HOT_SPACE), F.lit(HOT_SPACE), BABY_AGES, nursing_room=true, diaper_table=true, indoor=true, fee_free=true)


def toilets(rows: DataFrame, source: Source) -> DataFrame:
    """Public toilets, those with equipment for infants."""
    lat, lon, there = _located(rows, "緯度", "経度")
    kept = rows.filter(there & (_field(rows, "乳幼児用設備設置トイレ有無") == "有"))
    return base_spots(
        kept, source, _field(rows, "名称"), lat, lon, F.lit(DIAPER), F.lit(DIAPER), BABY_AGES, diaper_table=F.lit(True), fee_free=F.lit(True), open_time=_field(rows, "利用開始時間"),
        close_time=_field(rows, "利用終了時間"), note=_field(rows, "利用可能時間特記事項"),
    )


def geocoded(rows: DataFrame, address: Column, cache: DataFrame) -> DataFrame:
    """Rows with ``g_lat`` and ``g_lon`` from a cache (address, lat, lon) of addresses; null for unknown ones."""
    known = cache.select(F.col("address").alias("__a"), F.col("lat").alias("g_lat"), F.col("lon").alias("g_lon")).dropDuplicates(["__a"])
    return rows.withColumn("__a", address).join(known, "__a", "left").drop("__a")


def events(rows: DataFrame, source: Source, cache: DataFrame, stage_name: str = "") -> tuple[DataFrame, DataFrame]:
    """Dated events, and (missing): how many have a name but no place, neither in the file nor in the cache."""
    name, (own_lat, own_lon, _) = _field(rows, "イベント名"), _located(rows, "緯度", "経度")
    named = geocoded(rows.filter(name.isNotNull()), _field(rows, "住所"), cache)
    given = own_lat.isNotNull() & own_lon.isNotNull()
    lat, lon = F.when(given, own_lat).otherwise(F.col("g_lat")), F.when(given, own_lon).otherwise(F.col("g_lon"))
    start, url = _field(rows, "開始日"), _field(rows, "URL")
    found = base_spots(
        named.filter(lat.isNotNull()), source, name, lat, lon, F.lit(EVENT), F.lit(EVENT), labels.ALL_AGES, event_start=start, event_end=F.coalesce(_field(rows, "終了日"), start),
        open_time=_field(rows, "開始時間"), close_time=_field(rows, "終了時間"), note=F.nullif(F.concat_ws(" ", _field(rows, "説明"), _field(rows, "備考")), F.lit("")), place_name=_field(rows, "開催場所名称"),
        source_url=F.coalesce(url, F.lit(source.url)), official_url=url, official_label=F.when(url.isNotNull(), f"{stage_name} イベントのページ"),
    )
    return found, named.agg(F.count(F.when(lat.isNull(), 1)).alias("missing"))


def _flag(text: Column) -> Column:
    return F.when(text.isNotNull(), F.lower(text).isin(*YES))


def curated(rows: DataFrame, source: Source) -> DataFrame:
    """A hand-kept list: a field that is there overrides what would be derived."""
    get = lambda c: _field(rows, c)
    name, (lat, lon, there) = get("name"), _located(rows, "lat", "lon")
    category = F.coalesce(get("category"), F.lit(source.label))
    kind = F.coalesce(get("facility_type"), places.facility_kind(name, F.lit(None).cast("string"), category))
    found = base_spots(
        rows.filter(name.isNotNull() & there), source, name, lat, lon, category, kind, dropin=F.when(get("dropin").isNotNull(), F.lower(get("dropin")).isin("1", "true", "yes")),
        **{c: get(c) for c in ("visit_note", "event_start", "event_end", "place_name", "official_url", "official_label", "summary", "playground", "open_hours", "city", "park_rank", "open_time", "close_time", "closed_days", "fee_text", "note", "checked_at")},
        **{c: _flag(get(c)) for c in ("fee_free", "stroller_ok", "nursing_room", "diaper_table", "hot_water", "indoor")},
        source_url=F.coalesce(get("source_url"), F.lit(source.url)), area_m2=get("area_m2").try_cast("double").try_cast("int"), toilet=F.when(F.lower(F.coalesce(get("toilet"), F.lit(""))).isin("1", "true", "有", "○"), True),
    )
    own = rows.select("ord", get("age_min").try_cast("int").alias("__low"), get("age_max").try_cast("int").alias("__high"))
    return found.join(own, "ord").withColumn("age_min", F.coalesce("__low", "age_min")).withColumn("age_max", F.coalesce("__high", "age_max")).select(*[f for f, _ in FIELDS])


def ward_facilities(rows: DataFrame, source: Source) -> DataFrame:
    """A ward's pages of facilities: hours, closed days and sizes from their texts."""
    get = lambda c: _field(rows, c)
    name, (lat, lon, there) = get("ページタイトル"), _located(rows, "緯度", "経度")
    path, sub = F.coalesce(get("ファイルパス"), F.lit("")), get("第2分類")
    kept = there & name.isNotNull() & (sub.isin(*source.sub) if source.sub else F.lit(True))
    kept = kept & (labels._has(path, source.include_path) if source.include_path else F.lit(True)) & ~labels._has(name, source.exclude_name)
    category = F.coalesce(F.lit(source.category), sub, F.lit(source.label))
    none = F.lit(None).cast("string")
    kind = F.coalesce(F.lit(source.category), places.facility_kind(name, none, none), places.facility_kind(name, none, sub))
    squeeze = lambda c: F.trim(F.regexp_replace(c, r"(?U)\s+", " "))
    about = F.coalesce(get("施設の概要"), get("紹介文"))
    both = squeeze(F.concat(F.coalesce(get("施設の概要"), F.lit("")), F.lit(" "), F.coalesce(get("紹介文"), F.lit(""))))
    area = F.replace(F.regexp_extract(both, AREA, 1), F.lit(","), F.lit("")).try_cast("double").try_cast("int")
    hours = pages.opening_hours(F.translate(get("開館時間"), "　", " "))
    park = F.lit(source.category == PARK)
    return base_spots(
        rows.filter(kept), source, name, lat, lon, category, kind, official_url=F.when(path.startswith("http"), path), official_label=F.when(path.startswith("http"), "港区 施設案内"), summary=F.substring(squeeze(about), 1, 220),
        area_m2=area, open_time=hours["open"], close_time=hours["close"], open_hours=F.when(hours.isNull(), squeeze(get("開館時間"))), closed_days=squeeze(get("休業日")), indoor=F.when(park, False), fee_free=F.when(park, True),
    )


def diaper_toilets(rows: DataFrame, hours: DataFrame, source: Source) -> DataFrame:
    """Accessible toilets of a prefecture that have a diaper table, of one municipality (lg_code) or, outside,
    of several (lg_codes: code to city). hours: facilId, ord, t_openTime, t_closeTime; the first row of a
    facility counts."""
    get = lambda c: _field(rows, c)
    lat, lon, there = _located(rows, "latitude", "longitude")
    code = get("lgCode")
    # The configured codes of a stage are some dozens.
    city = F.try_element_at(F.create_map(*[F.lit(x) for item in source.lg_codes.items() for x in item]), code) if source.lg_codes else F.lit(None).cast("string")
    ours = city.isNotNull() if source.lg_codes else code == source.lg_code
    yes = lambda c: F.coalesce(get(c).isin("1", "true", "TRUE"), F.lit(False))
    first = hours.groupBy(F.trim("facilId").alias("__f")).agg(F.min(F.struct("ord", "t_openTime", "t_closeTime")).alias("__h"))
    met = rows.filter(there & ours & yes("t_dTable")).withColumn("__f", get("facilId")).join(first, "__f", "left")
    at = lambda c: F.nullif(F.substring(F.trim(F.col(f"__h.{c}")), 1, 5), F.lit(""))
    true = F.lit(True)
    return base_spots(
        met, source, get("name"), lat, lon, F.lit(DIAPER), F.lit(DIAPER), BABY_AGES, diaper_table=true, fee_free=true, indoor=true, note=F.when(yes("t_bChair"), CHAIR_NOTE), open_time=at("t_openTime"), close_time=at("t_closeTime"),
        official_url=F.lit(source.url), official_label=F.lit(DIAPER_LABEL), summary=F.lit(DIAPER_SUMMARY), city=city, outside=F.lit(bool(source.lg_codes)),
    )


def outside_report(found: DataFrame) -> DataFrame:
    """(city, n) of destinations outside; fails where a name stands twice in a city."""
    twice = found.groupBy("name", "city").agg(F.count("*").alias("n")).filter("n > 1").orderBy("city", "name").limit(10).collect()
    if twice:
        raise ValueError("twice in a city: " + ", ".join(f"{r['name']} ({r['city']})" for r in twice))
    return found.groupBy("city").agg(F.count("*").alias("n"))


def union_of(parts: list[DataFrame]) -> DataFrame:
    """All spots by id, the last of a repeated id."""
    out = parts[0].withColumn("__part", F.lit(0))
    for i, more in enumerate(parts[1:], 1):
        out = out.unionByName(more.withColumn("__part", F.lit(i)))
    last = Window.partitionBy("id").orderBy(F.desc("__part"), F.desc("ord"))
    return out.withColumn("__r", F.row_number().over(last)).filter("__r = 1").drop("__r", "__part")


def source_report(loaded: DataFrame, kept: DataFrame) -> DataFrame:
    """(source_id, loaded, kept): how many spots each source gave and how many head a record in the end."""
    return loaded.groupBy("source_id").agg(F.count("*").alias("loaded")).join(kept.groupBy("source_id").agg(F.count("*").alias("kept")), "source_id", "left").select("source_id", "loaded", F.coalesce("kept", F.lit(0)).alias("kept"))


def built(loaded: DataFrame) -> DataFrame:
    """Spots without those that need enrolment, and one record a place: equal names near each other are merged,
    the richer record first. Adds also_types and also_in; other fields are the head's."""
    rich = sum((F.col(f).isNotNull().cast("int") for f, _ in FIELDS), F.lit(0))
    own = spots.drop_enrolment(loaded).withColumn("key", names.spot_name_key(F.col("name"))).withColumn("richness", rich).withColumn("hand", F.lit(False))
    merged = entity.merged_spots(own.select("id", "ord", "key", "name", "facility_type", "lat", "lon", "richness", "hand", "toilet", "age_min", "age_max"))
    taken = ("name", "facility_type", "lat", "lon", "toilet", "age_min", "age_max")
    rest = [f for f, _ in FIELDS if f not in (*taken, "id")]
    return merged.select("id", *taken, "also_types", "also_in").join(own.select("id", *rest), "id").withColumn("dropin", places.is_dropin(F.col("facility_type"))).filter("dropin is null or dropin")
