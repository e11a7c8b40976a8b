"""Kinds and ranks of places as Column expressions over a place's columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Code to kind, keyword to kind (the first that is found wins).
POI_KINDS = {"1402a": "保育所", "1403a": "児童館・児童センター", "1404a": "学童クラブ", "1406a": "子育て支援センター", "1501a": "幼稚園"}
NAME_KINDS = (
    ("子育て支援センター", "子育て支援センター"), ("子育てひろば", "子育てひろば"), ("つどいの広場", "子育てひろば"), ("親と子のひろば", "子育てひろば"),
    ("子ども家庭支援センター", "子ども家庭支援センター"), ("子ども中高生プラザ", "児童館・児童センター"), ("児童高齢者交流プラザ", "児童館・児童センター"),
    ("児童センター", "児童館・児童センター"), ("児童館", "児童館・児童センター"), ("あっぴぃ", "子育てひろば"), ("子育て応援プラザ", "子育てひろば"),
    ("あい･ぽーと", "子育てひろば"), ("あい・ぽーと", "子育てひろば"), ("学童クラブ", "学童クラブ"), ("放課後児童", "学童クラブ"), ("こども園", "認定こども園"),
    ("幼稚園", "幼稚園"), ("保育園", "保育所"), ("保育所", "保育所"), ("図書館", "図書館"), ("公民館", "公民館"), ("区民センター", "区民センター"),
    ("区民協働施設", "区民センター"), ("いきいきプラザ", "区民センター"), ("科学館", "科学館・郷土歴史館"), ("郷土歴史館", "科学館・郷土歴史館"),
    ("伝統文化交流館", "科学館・郷土歴史館"), ("公園", "公園"),
)
# Kinds that need enrolment, kinds in the order of picks, words of large parks.
DROPIN_KINDS = (
    "子育て支援センター", "子育てひろば", "子ども家庭支援センター", "児童館・児童センター", "公園", "図書館", "公民館", "区民センター", "科学館・郷土歴史館",
    "赤ちゃんほっとスペース", "赤ちゃんの駅", "おむつ替えのできるトイレ", "イベント",
)
ENROL_KINDS = ("保育所", "幼稚園", "認定こども園", "学童クラブ", "小規模保育事業", "家庭的保育", "地域型保育事業", "認可保育施設")
PICK_ORDER = ("子育て支援センター", "子育てひろば", "子ども家庭支援センター", "児童館・児童センター", "イベント", "図書館", "公民館", "公園")
BIG_PARK_WORDS = (
    "総合運動", "運動公園", "総合公園", "地区公園", "近隣公園", "運動場", "水辺公園", "市民の森", "こどもの森", "子どもの森", "セントラルパーク", "森の公園", "自然公園", "河川敷",
)
MAJOR_M2, NORMAL_M2 = 10000, 3000
#: (metres, ranks worth going for up to there).
PARK_BANDS = ((600, ("major", "normal", "unknown", "minor")), (1500, ("major", "normal")), (None, ("major",)))


def _first_keyword(text: Column, otherwise: Column) -> Column:
    """The kind of the first keyword in the text. A filter over a constant list: as a chain of conditions it would
    be written out at each use of the kind, past what compiles."""
    rules = F.array(*[F.struct(F.lit(word).alias("word"), F.lit(kind).alias("kind")) for word, kind in NAME_KINDS])
    return F.coalesce(F.get(F.filter(rules, lambda r: text.contains(r["word"])), F.lit(0))["kind"], otherwise)


def facility_kind(name: Column, poi: Column, given: Column) -> Column:
    """Kind by code, else by the given field, else by the name."""
    by_code = F.lit(None).cast("string")
    for code, kind in POI_KINDS.items():
        by_code = F.when(poi == code, kind).otherwise(by_code)
    said = F.trim(F.coalesce(given, F.lit("")))
    by_field = F.when(~said.isin("", "0", "-", "不明"), _first_keyword(said, said))
    return F.coalesce(by_code, by_field, _first_keyword(F.coalesce(name, F.lit("")), F.lit(None).cast("string")))


def is_dropin(kind: Column) -> Column:
    """Whether one may just go there: null without a kind."""
    enrol = F.lit(False)
    for word in ENROL_KINDS:
        enrol = enrol | kind.contains(word)
    return F.when(kind.isNull() | (kind == ""), F.lit(None).cast("boolean")).when(kind.isin(*DROPIN_KINDS), True).otherwise(~enrol)


def ages_match(age_min: Column, age_max: Column, months: int | None) -> Column:
    """Whether a child of so many months is in the span; null bounds are open."""
    if months is None:
        return F.lit(True)
    return (F.coalesce(age_min, F.lit(months)) <= months) & (F.coalesce(age_max, F.lit(months)) >= months)


def has_web_info(url: Column) -> Column:
    return F.length(F.trim(F.coalesce(url, F.lit("")))) > 0


def toys(playground: Column) -> Column:
    """Number of toys in a dotted list."""
    return F.size(F.filter(F.split(F.trim(F.coalesce(playground, F.lit(""))), "・"), lambda x: x != ""))


def park_rank(name: Column, area_m2: Column, playground: Column, toilet: Column) -> Column:
    """major, normal, minor or unknown."""
    area, n, wc = F.coalesce(area_m2, F.lit(0)), toys(playground), F.coalesce(toilet, F.lit(False))
    big = F.lit(False)
    for word in BIG_PARK_WORDS:
        big = big | F.coalesce(name, F.lit("")).contains(word)
    major = (area >= MAJOR_M2) | ((n >= 4) & wc) | (big & ((area >= NORMAL_M2) | wc))
    normal = (area >= NORMAL_M2) | (n >= 3) | ((n >= 2) & wc)
    return F.when(major, "major").when(normal, "normal").when(area > 0, "minor").otherwise("unknown")


def worth_going(rank: Column, metres: Column) -> Column:
    """Whether a park of that rank is worth that distance; true for what has no rank."""
    out = F.lit(True)
    for limit, ranks in reversed(PARK_BANDS):
        out = rank.isin(*ranks) if limit is None else F.when(metres <= limit, rank.isin(*ranks)).otherwise(out)
    return F.coalesce(rank, F.lit("")).isin("") | out


def event_is_on(start: Column, end: Column, day: str) -> Column:
    """Whether an event is on that day or later; undated ones are."""
    return (F.coalesce(start, F.lit("")) == "") | (F.coalesce(F.nullif(end, F.lit("")), start) >= day)
