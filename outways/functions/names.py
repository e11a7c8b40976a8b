"""Keys under which names from different sources meet."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Full-width ASCII and its half-width counterpart.
FULL_WIDTH = "".join(map(chr, range(0xFF01, 0xFF5F)))
HALF_WIDTH = "".join(map(chr, range(0x21, 0x7F)))
# Words that some sources put into a name and others don't.
SPOT_WORDS = ("子育て支援センター", "地域子育て支援拠点", "ルーム", "流山市立", "流山市", "市立", "区立")


@F.pandas_udf(T.StringType())
def nfkc(names: pd.Series) -> pd.Series:
    """Compatibility composition, which Spark has no function for."""
    return names.str.normalize("NFKC")


def _without(text: Column, words) -> Column:
    for word in words:
        text = F.replace(text, F.lit(word), F.lit(""))
    return text


def stop_name_key(name: Column, compose=nfkc) -> Column:
    """Key of a stop's name: composed, without brackets and white space, small ke as ke."""
    text = compose(F.coalesce(name, F.lit("")))
    text = F.regexp_replace(text, r"[（(][^）)]*[）)]", "")
    text = F.regexp_replace(text, r"(?U)\s+", "")
    return F.translate(text, "･ヶヵ", "・ケケ")


def spot_name_key(name: Column) -> Column:
    """Key of a place's name: no spaces or brackets, half-width, ke as small ke, without titles."""
    text = F.translate(F.translate(F.coalesce(name, F.lit("")), "　 ", ""), FULL_WIDTH, HALF_WIDTH)
    text = F.regexp_replace(text, r"[（(][^）)]*[）)]", "")
    return _without(F.translate(F.translate(text, "ケ", "ヶ"), "・", ""), SPOT_WORDS)


def park_name_key(name: Column) -> Column:
    """Key of a park's name: brackets stay, its owner's name goes."""
    from outways.functions.labels import PARK_WORDS

    text = F.translate(F.translate(F.coalesce(name, F.lit("")), "　 ", ""), FULL_WIDTH, HALF_WIDTH)
    return _without(F.translate(text, "ケ", "ヶ"), PARK_WORDS)


def page_name_key(name: Column) -> Column:
    """Key of a page's title: as of a place, small tsu as well, only the city's own name dropped."""
    text = F.translate(F.translate(F.coalesce(name, F.lit("")), "　 ", ""), FULL_WIDTH, HALF_WIDTH)
    text = F.regexp_replace(text, r"[（(].*?[）)]", "")
    return F.trim(_without(F.translate(F.translate(text, "ケツ", "ヶッ"), "・", ""), ("流山市立", "流山市")))


def packed_map(text: Column) -> Column:
    """``k=v;k=v`` to a map; parts without ``=`` are left out, the first of repeated keys stays."""
    parts = F.filter(F.split(F.coalesce(text, F.lit("")), ";"), lambda p: p.contains("="))
    keys = F.array_distinct(F.transform(parts, lambda p: F.substring_index(p, "=", 1)))
    value = lambda k: F.get(F.filter(parts, lambda p: F.substring_index(p, "=", 1) == k), F.lit(0))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.substr(value(k), F.length(k) + 2)))


def safe_id(text: Column) -> Column:
    """An id that may stand in a file name."""
    return F.regexp_replace(text, "[^A-Za-z0-9_-]", "_")
