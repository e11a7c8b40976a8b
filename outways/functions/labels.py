"""Words for what is shown: kinds of marks, ages, licences, and what a way spares."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Marks and the words that call for them, the first that is found wins.
MARKS = (
    ("event", ("イベント",)), ("toilet", ("トイレ",)), ("library", ("図書館",)), ("hall", ("公民館", "文化会館", "区民センター", "協働施設", "科学館", "郷土歴史館")),
    ("hiroba", ("支援センター", "ひろば", "児童館", "こども館", "つどい")), ("nursing", ("赤ちゃん", "ほっと", "授乳", "おむつ")), ("park", ("公園", "緑地", "広場")),
)
# Licences by their name, then by who publishes a feed.
LICENSES = {"CC BY 4.0": "CC BY 4.0", "ODPT": "公共交通オープンデータ基本ライセンス"}
PUBLISHERS = {
    "東京都交通局": "CC BY 4.0", "首都圏新都市鉄道": "公共交通オープンデータ基本ライセンス", "流山市": "CC BY 4.0", "東武鉄道": "チャレンジ2026 限定ライセンス", "東武バス": "チャレンジ2026 限定ライセンス",
    "JR東日本": "チャレンジ2026 限定ライセンス",
}
# Ages in months by words, the first that is found wins; all ages without one.
AGE_RULES = (
    (("授乳", "おむつ", "赤ちゃん", "ほっとスペース"), (-9, 35)), (("子育て支援センター", "子育てひろば", "つどいの広場", "親と子のひろば", "子ども家庭支援センター"), (0, 71)),
    (("保育所", "保育園", "認定こども園", "こども園", "小規模保育", "家庭的保育"), (0, 71)), (("幼稚園",), (36, 71)), (("子育て支援", "子育てひろば", "つどいの広場", "地域子育て"), (0, 35)),
    (("児童館", "児童センター", "こどもセンター"), (0, 155)), (("学童", "放課後児童", "放課後子ども"), (72, 155)), (("公園", "緑地", "広場"), (0, 155)), (("図書館", "公民館", "文化会館"), (0, 155)),
)
ALL_AGES = (0, 155)
# Words that a park's name may lack.
PARK_WORDS = ("流山市立", "流山市", "都立", "県立", "千葉県立", "東京都立", "区立", "市立")
# Tags of mapped places and the kinds they stand for, the first that fits wins.
TAG_KINDS = (("leisure", "playground", "公園"), ("leisure", "park", "公園"), ("amenity", "library", "図書館"), ("amenity", "community_centre", "公民館"))
DIAPER_KIND = "おむつ替えのできるトイレ"


def _has(text: Column, words: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for word in words:
        found = found | text.contains(word)
    return found


def mark_of(kind: Column, category: Column) -> Column:
    text = F.coalesce(F.nullif(kind, F.lit("")), category, F.lit(""))
    out = F.lit("other")
    for mark, words in reversed(MARKS):
        out = F.when(_has(text, words), mark).otherwise(out)
    return out


def age_text(months: Column) -> Column:
    """Years and months, or the months to go before birth."""
    return F.when(months < 0, F.format_string("産前（あと%dか月）", -months)).otherwise(F.format_string("%d歳%dか月", F.floor(months / 12), months % 12))


def _looked_up(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for item in table.items() for x in item]), key)


def license_of(license: Column, organization: Column) -> Column:
    return F.coalesce(_looked_up(LICENSES, license), _looked_up(PUBLISHERS, organization), F.lit("—"))


def ages_for(*texts: Column) -> Column:
    """(age_min, age_max) in months by the first rule one of whose words stands in the texts."""
    span = lambda ages: F.struct(F.lit(ages[0]).alias("age_min"), F.lit(ages[1]).alias("age_max"))
    text = F.concat_ws(" ", *texts)
    rules = F.array(*[F.struct(F.array(*map(F.lit, words)).alias("words"), span(ages).alias("ages")) for words, ages in AGE_RULES])
    return F.coalesce(F.get(F.filter(rules, lambda r: F.exists(r["words"], lambda w: text.contains(w))), F.lit(0))["ages"], span(ALL_AGES))


def route_kind(route_type: Column) -> Column:
    return F.when(route_type == 3, "bus").otherwise("train")


def kind_by_tags(tags: Column) -> Column:
    out = F.when(F.try_element_at(tags, F.lit("changing_table")) == "yes", DIAPER_KIND)
    for key, value, kind in reversed(TAG_KINDS):
        out = F.when(F.try_element_at(tags, F.lit(key)) == value, kind).otherwise(out)
    return out


def source_note(hand: Column, others: Column) -> Column:
    """Where destinations outside the city come from: those looked up one by one, those of a dataset."""
    one = F.when(hand > 0, F.format_string("隣の市区町村が自分のホームページで載せている行き先を 1 件ずつ当たったもの %d 件", hand))
    return F.concat_ws("／", one, F.when(others > 0, F.format_string("区市町村をまたいで配られているデータセットから取ったもの %d 件", others)))


def spared(obstacles: Column, extra_m: Column, extra_seconds: Column) -> Column:
    """What the chosen way spares, in one sentence: its detour, then each kind of obstacle with its number."""
    labels = F.transform(obstacles, lambda o: o["label"])
    named = F.transform(F.array_distinct(labels), lambda k: F.concat(k, F.when(F.size(F.filter(labels, lambda x: x == k)) > 1, F.concat(F.lit(" "), F.size(F.filter(labels, lambda x: x == k)).cast("string"), F.lit(" か所"))).otherwise("")))
    minutes = F.greatest(F.lit(1), F.floor(extra_seconds / 60 + 0.5)).cast("string")
    far = F.when(extra_m > 20, F.concat(extra_m.cast("string"), F.lit("m（約"), minutes, F.lit("分）遠回りして、"))).otherwise("遠回りせずに、")
    return F.concat(far, F.array_join(named, "・"), F.lit("を通らない道です"))
