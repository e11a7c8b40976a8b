"""Clusters of coordinates and merged records of one place.

These are greedy and depend on the order of rows, so they carry an ordinal and run per name: clusters in
``applyInPandas`` on groups of equal keys, where names with a single row never leave the JVM; merged records over sorted rows.
"""

from __future__ import annotations

import bisect
import itertools
import math
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CLUSTER_M = 60.0


def _metres(lat1: float, lon1: float, lat2: float, lon2: float) -> float:
    a, b = math.radians(lat1), math.radians(lat2)
    h = math.sin((b - a) / 2) ** 2 + math.cos(a) * math.cos(b) * math.sin(math.radians(lon2 - lon1) / 2) ** 2
    return 2 * 6371000.0 * math.asin(math.sqrt(h))


def place_clusters(stops: DataFrame, metres: float = CLUSTER_M) -> DataFrame:
    """(stop_id, place_id, lat, lon): stops of one name near the first of their cluster are a place.

    stops: stop_id, name, lat, lon, ord. The place's id is the name, with ``#i`` from the second
    cluster on; its coordinates are its first stop's.
    """

    def cluster(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("ord")
        anchors: list[tuple[float, float]] = []
        which = []
        for lat, lon in zip(group["lat"], group["lon"], strict=True):
            at = next((i for i, a in enumerate(anchors) if _metres(lat, lon, *a) <= metres), len(anchors))
            if at == len(anchors):
                anchors.append((lat, lon))
            which.append(at)
        name = group["name"].iloc[0]
        return pd.DataFrame(
            {"stop_id": group["stop_id"], "place_id": [name if i == 0 else f"{name}#{i}" for i in which], "lat": [anchors[i][0] for i in which], "lon": [anchors[i][1] for i in which]}
        )

    counted = stops.withColumn("__n", F.count("*").over(Window.partitionBy("name")))
    key = stops.schema["stop_id"].dataType.simpleString()
    single = counted.filter("__n = 1").select("stop_id", F.col("name").alias("place_id"), "lat", "lon")
    several = counted.filter("__n > 1").select("stop_id", "name", "lat", "lon", "ord").groupBy("name").applyInPandas(cluster, f"stop_id {key}, place_id string, lat double, lon double")
    return single.unionByName(several)


def coordinate_candidates(points: DataFrame, hint: str = "", half_lat: float = 0.0014, half_lon: float = 0.0017) -> DataFrame:
    """(key, rank, lat, lon, source, n): clusters of coordinates under one name, best first: with the
    operator's name, then official, then larger. points: key, lat, lon, source, ord."""

    def cluster(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("ord")
        found: list[dict] = []
        for row in group.itertuples():
            into = next((c for c in found if abs(c["lat"] - row.lat) < half_lat and abs(c["lon"] - row.lon) < half_lon), None)
            if into is None:
                found.append(into := {"lat": row.lat, "lon": row.lon, "rows": []})
            into["rows"].append(row)
        better = lambda c: (any(hint and hint in r.source for r in c["rows"]), any(r.source == "gtfs" for r in c["rows"]), len(c["rows"]))
        found.sort(key=better, reverse=True)
        mean = lambda c, name: round(sum(getattr(r, name) for r in c["rows"]) / len(c["rows"]), 6)
        return pd.DataFrame(
            [(group["key"].iloc[0], i + 1, mean(c, "lat"), mean(c, "lon"), "gtfs" if better(c)[1] else "osm", len(c["rows"])) for i, c in enumerate(found)],
            columns=["key", "rank", "lat", "lon", "source", "n"],
        )

    return points.groupBy("key").applyInPandas(cluster, "key string, rank int, lat double, lon double, source string, n int")


# Which kind heads a merged place.
KIND_PRIORITY = (
    "子育て支援センター", "子育てひろば", "子ども家庭支援センター", "児童館・児童センター", "図書館", "公民館", "イベント", "公園", "赤ちゃんほっとスペース", "赤ちゃんの駅",
    "おむつ替えのできるトイレ",
)
WIDE, NARROW = 0.014, 0.004
#: Degrees of a cell, a little more than places of a name are ever apart when they merge, and rows of a batch handed back.
CELL, BATCH = WIDE * 1.001, 10_000
FIELDS = ("id", "ord", "key", "name", "facility_type", "lat", "lon", "hand", "toilet", "age_min", "age_max")
RANK = {kind: i for i, kind in enumerate(KIND_PRIORITY)}


def _reach(kind: str | None) -> float:
    return NARROW if kind in ("公園", "イベント") else WIDE


class Kept:
    """The places of one name so far, in the order of their heads. A place is listed in its cell and the eight around it, so a
    row looks at those alone that lie near it."""

    def __init__(self) -> None:
        self.rows: list[list] = []
        self.at: list[tuple[float | None, float | None, float]] = []
        self.cells: list[tuple[int, int] | None] = []
        self.near: dict[tuple[int, int], list[int]] = {}

    def _put(self, n: int, lat: float | None, lon: float | None, reach: float) -> None:
        self.at[n] = lat, lon, reach
        cell = None if lat is None or lon is None or not (math.isfinite(lat) and math.isfinite(lon)) else (math.floor(lat / CELL), math.floor(lon / CELL))
        if cell == self.cells[n]:
            return
        for old, change in ((self.cells[n], list.remove), (cell, bisect.insort)):
            for y, x in () if old is None else ((old[0] + dy, old[1] + dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)):
                change(self.near.setdefault((y, x), []), n)
        self.cells[n] = cell

    def _first(self, lat: float | None, lon: float | None, own: float) -> int | None:
        """The first place in whose reach, or in the row's own, the row lies; without coordinates there is none."""
        if lat is None or lon is None or not (math.isfinite(lat) and math.isfinite(lon)):
            return None
        for n in self.near.get((math.floor(lat / CELL), math.floor(lon / CELL)), ()):
            y, x, reach = self.at[n]
            if math.hypot(y - lat, x - lon) < (own if own > reach else reach):
                return n
        return None

    def take(self, row: tuple) -> None:
        """The next row (``FIELDS``) joins a place or begins one."""
        id_, _, _, name, kind, lat, lon, hand, toilet, low, high = row
        own = _reach(kind)
        n = self._first(lat, lon, own)
        if n is None:
            self.rows.append([*row, set(), []])
            self.at.append((lat, lon, own))
            self.cells.append(None)
            self._put(len(self.rows) - 1, lat, lon, own)
            return
        into = self.rows[n]
        if into[7] and not hand:
            into[5], into[6] = lat, lon
        head = into[4]
        if kind != head or not kind:
            kinds = [k for k in (into[4], kind) if k]
            head = min(kinds, key=lambda k: RANK.get(k, len(RANK))) if kinds else None
            if head != into[4]:
                into[3] = name
            into[11] |= {k for k in kinds if k != head}
            into[11].discard(head)
            into[4] = head
        if self.at[n] != (into[5], into[6], reach := _reach(head)):
            self._put(n, into[5], into[6], reach)
        into[12].append(id_)
        if toilet is True:
            into[8] = True
        # A place whose age isn't known stays so.
        if into[9] is not None and low is not None and low < into[9]:
            into[9] = low
        if into[10] is not None and high is not None and high > into[10]:
            into[10] = high


def _values(column: pa.Array) -> list:
    """A column's values, None where it has none; those of plain columns at once, not one by one."""
    kind = pa.types
    plain = kind.is_string(column.type) or (not column.null_count and (kind.is_integer(column.type) or kind.is_floating(column.type) or kind.is_boolean(column.type)))
    return column.to_numpy(zero_copy_only=False).tolist() if plain else column.to_pylist()


def merged_in_order(rows: Iterable[tuple]) -> Iterator[list]:
    """Merged rows (``FIELDS``, also_types, also_in) of rows that come name by name, in their order. Only the places of the
    name at hand are held; a blank name merges nothing."""
    kept, name = Kept(), None
    for row in rows:
        if row[2] == "":
            yield [*row, [], []]
            continue
        if row[2] != name:
            yield from ([*r[:11], sorted(r[11]), r[12]] for r in kept.rows)
            kept, name = Kept(), row[2]
        kept.take(row)
    yield from ([*r[:11], sorted(r[11]), r[12]] for r in kept.rows)


def merged_spots(spots: DataFrame) -> DataFrame:
    """One row per place: spots of equal name keys near each other are merged.

    spots: id, ord, key, name, facility_type, lat, lon, richness, hand, toilet, age_min, age_max.
    Richer spots come first; the head's kind and name are those of the best kind; ages widen;
    an open record's coordinates replace a curated one's. Adds also_types and also_in. Names are sorted and come one
    after another, so that small names cost no group of their own and a large one isn't gathered.
    """

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        kinds = [first.schema.field(f).type for f in FIELDS]
        kinds += [pa.list_(pa.string()), pa.list_(kinds[0])]
        rows = (row for batch in itertools.chain([first], batches) for row in zip(*(_values(batch.column(f)) for f in FIELDS), strict=True))
        merged = merged_in_order(rows)
        while out := list(itertools.islice(merged, BATCH)):
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), kinds, strict=True)], names=[*FIELDS, "also_types", "also_in"])

    types = dict(spots.dtypes)
    schema = ", ".join(f"{c} {types[c]}" for c in FIELDS) + f", also_types array<string>, also_in array<{types['id']}>"
    # Blank names need not meet, so they are spread.
    dealt = spots.filter("key is not null").repartition("key", F.when(F.col("key") == "", F.xxhash64("id")))
    return dealt.sortWithinPartitions("key", F.desc_nulls_last("richness"), F.asc_nulls_last("ord")).select(*FIELDS).mapInArrow(merge, schema)
