"""What can be reached in so many minutes, on the roads and by public transport, and walks between stops.

Many questions run in one search: labels are keyed by question, and each has its own limit, which its sources
carry along. Nodes: node, lat, lon; arcs: a, b, cost (seconds, null where closed), both directions.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from outways.functions import geo
from outways.operators import near, roads
from outways.operators.walking import ATTEMPTS, CANDIDATE_SNAP_M, PACE

# Limits of a question in minutes, how far a stop may lie from the roads, and the walks between stops
# that are worth a search: metres and degrees of latitude of the straight line, and seconds.
LEAST_MINUTES, MOST_MINUTES = 5, 60
SEED_SNAP_M = 300.0
TRANSFER_M, TRANSFER_LAT, TRANSFER_S = 400.0, 0.005, 600
GENTLE = ("gentle", "normal", 80.0, 65.0)
#: Places of a group that share a row, and rows that a task writes out.
LISTED, ROWS_A_TASK = 64, 2_000_000


def road_transfers(places: DataFrame, nodes: DataFrame, arcs: dict[str, DataFrame], gentle: tuple[str, str, float, float] | None = GENTLE, cut=None) -> DataFrame:
    """(tier, a, b, seconds): walks on the roads of each tier between places near each other, up to ``TRANSFER_S``.

    places: place_id, lat, lon; arcs: by tier. Only pairs of places that lie close in a straight line are asked for; one
    search a tier starts from every node that such a place lies at, and ends where the farthest of its own
    partners could still be in time. The way to the first node is free, that from the last is walked at
    ``PACE``. ``gentle`` (tier, of tier, pace, slower pace) is derived from another tier's rows, cut to whole seconds.
    Places without a road near them, or without a near place, have no rows. Of places with one id the
    quickest walk holds. Places at the same spots walk alike: one of them is searched for, and the rows of all are
    written out at the end, spread by their number.
    """
    cut = cut or (lambda df: df.checkpoint())
    groups = cut(_alike(places))
    one = places.select("place_id", "lat", "lon").join(groups.filter("place_id = one").select("place_id"), "place_id", "left_semi")
    other = one.select(F.col("place_id").alias("b"), "lat", "lon")
    close = near.within_metres(one.select(F.col("place_id").alias("a"), "lat", "lon"), other, TRANSFER_M).filter((F.col("a") != F.col("b")) & (F.abs(F.col("lat") - F.col("r_lat")) < TRANSFER_LAT))
    several = groups.groupBy("one").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("one").alias("a"), F.col("one").alias("b"))
    pairs = cut(close.select("a", "b").distinct().union(several))
    asked = one.join(pairs.select(F.col("a").alias("place_id")).distinct(), "place_id", "left_semi")
    tiers = []
    for tier, of in arcs.items():
        usable = roads.usable_nodes(nodes, of).select("node", "lat", "lon")
        snapped = cut(near.nearest(asked, usable, ATTEMPTS[0][0], "place_id", "node").select("place_id", "node", "metres"))
        starts = snapped.select(F.col("place_id").alias("a"), F.col("node").alias("start"))
        rest = F.col("metres") / PACE * 60
        ends = snapped.filter(F.col("metres") < CANDIDATE_SNAP_M).select(F.col("place_id").alias("b"), "node", rest.alias("rest"))
        wanted = cut(pairs.join(starts, "a").join(ends, "b"))
        sources = wanted.groupBy("start").agg(F.max(TRANSFER_S - F.col("rest")).alias("room")).select("start", F.col("start").alias("node"), F.lit(0.0).alias("cost"), "room")
        known = roads.least_costs(of.select("a", "b", "cost"), sources, TRANSFER_S, cut=cut, by=("start",), keep=F.col("cost") <= F.col("room"), carry=("room",))
        met = wanted.join(known.select("start", "node", "cost"), ["start", "node"]).withColumn("total", F.col("cost") + F.col("rest")).filter(F.col("total") <= TRANSFER_S)
        tiers.append(met.groupBy("a", "b").agg(F.min("total").cast("int").alias("seconds")).select(F.lit(tier).alias("tier"), "a", "b", "seconds"))
    found = cut(roads.union_all(tiers))
    if gentle is not None:
        tier, base, pace, slower = gentle
        found = found.union(found.filter(F.col("tier") == base).select(F.lit(tier), "a", "b", (F.col("seconds") * F.lit(pace / slower)).cast("int")))
    return _of_all(found, groups, cut)


def _alike(places: DataFrame) -> DataFrame:
    """(place_id, one): for each place the smallest id of those that lie at the very same spots."""
    known = places.select("place_id", "lat", "lon").filter("place_id is not null and lat is not null and lon is not null")
    spots = known.groupBy("place_id").agg(F.array_sort(F.collect_set(F.struct("lat", "lon"))).alias("spots"))
    return spots.join(spots.groupBy("spots").agg(F.min("place_id").alias("one")), "spots").select("place_id", "one")


def _of_all(found: DataFrame, groups: DataFrame, cut) -> DataFrame:
    """The rows (tier, a, b, seconds) of one place of each group, written out for all of ``groups`` (place_id, one).

    Lists of places meet, and are dealt to as many tasks as their rows need, since their size tells nothing of what
    they multiply into.
    """
    turn = F.floor((F.row_number().over(Window.partitionBy("one").orderBy("place_id")) - 1) / LISTED).alias("turn")
    lists = cut(groups.select("one", "place_id", turn).groupBy("one", "turn").agg(F.collect_list("place_id").alias("ids")))
    of = lambda c: lists.select(F.col("one").alias(c), F.col("turn").alias(f"{c}_turn"), F.col("ids").alias(f"{c}_ids"))
    met = found.join(of("a"), "a").join(of("b"), "b")
    rows = met.agg(F.coalesce(F.sum(F.size("a_ids").cast("long") * F.size("b_ids")), F.lit(0))).first()[0]
    dealt = met.repartition(max(1, math.ceil(rows / ROWS_A_TASK)), "tier", "a", "b", "a_turn", "b_turn")
    return dealt.select("tier", F.explode("a_ids").alias("a"), "b_ids", "seconds").select("tier", "a", F.explode("b_ids").alias("b"), "seconds").filter("a <> b")


def asked(questions: DataFrame) -> DataFrame:
    """Questions (ask, lat, lon, minutes) with the minutes cut to ``LEAST_MINUTES`` to ``MOST_MINUTES``, their ``budget`` in
    seconds and the size of their cells: cell_m, dlat, dlon (degrees at the question's latitude)."""
    minutes = F.greatest(F.lit(LEAST_MINUTES), F.least(F.col("minutes").cast("int"), F.lit(MOST_MINUTES)))
    told = questions.withColumn("minutes", minutes).withColumn("budget", F.col("minutes") * 60.0).withColumn("cell_m", geo.cell_size_m(F.col("minutes")))
    dlat = F.col("cell_m") / geo.DEGREE_M
    return told.withColumn("dlat", dlat).withColumn("dlon", F.col("cell_m") / (geo.DEGREE_M * F.cos(F.radians("lat"))))


def seeds(questions: DataFrame, arrivals: DataFrame | None = None) -> DataFrame:
    """(ask, lat, lon, used, budget): where each question's walk begins and the seconds spent until then: at its
    start, and at the places (ask, lat, lon, used) that public transport reaches within its limit.

    questions: as ``asked`` returns them.
    """
    own = questions.select("ask", "lat", "lon", F.lit(0.0).alias("used"), "budget")
    if arrivals is None:
        return own
    more = arrivals.select("ask", "lat", "lon", F.col("used").cast("double").alias("used")).join(questions.select("ask", "budget"), "ask")
    return own.union(more.filter(F.col("used") <= F.col("budget")))


def reached_nodes(starts: DataFrame, nodes: DataFrame, arcs: DataFrame, speed: float = 80.0, cut=None) -> DataFrame:
    """(ask, node, cost): the nodes within each question's limit of any of its ``seeds``, in one search of all.

    A seed goes to its nearest node under ``SEED_SNAP_M`` at ``speed`` metres a minute; one without such a node, or
    whose time is used up on the way there, begins nothing.
    """
    cut = cut or (lambda df: df.checkpoint())
    arcs = roads.listed(arcs.select("a", "b", "cost"), cut)
    usable = cut(roads.usable_nodes(nodes, roads.unlisted(arcs)).select("node", "lat", "lon"))
    # Seeds at one spot are snapped once, however many questions share it.
    spots = starts.select("lat", "lon").distinct().withColumn("spot", F.struct("lat", "lon"))
    at = near.nearest(spots, usable, SEED_SNAP_M, "spot", "node").select("spot.lat", "spot.lon", "node", "metres")
    sources = starts.join(at, ["lat", "lon"]).select("ask", "node", (F.col("used") + F.col("metres") / speed * 60).alias("cost"), "budget").filter(F.col("cost") <= F.col("budget"))
    return roads.least_costs(arcs, sources, cut=cut, by=("ask",), keep=F.col("cost") <= F.col("budget"), carry=("budget",)).select("ask", "node", "cost")


def question_cells(questions: DataFrame, reached: DataFrame, nodes: DataFrame) -> DataFrame:
    """(ask, y, x): the cells of each question's reached nodes and of its start, and the empty ones they enclose."""
    of = lambda c, size: F.floor(F.col(c) / F.col(size)).cast("long")
    sizes = questions.select("ask", "dlat", "dlon")
    spots = reached.select("ask", "node").join(nodes.select("node", "lat", "lon"), "node").select("ask", "lat", "lon").union(questions.select("ask", "lat", "lon"))
    return roads.filled(spots.join(sizes, "ask").select("ask", of("lat", "dlat").alias("y"), of("lon", "dlon").alias("x")).distinct(), "ask")


def border(cells: DataFrame, key: str = "ask") -> DataFrame:
    """(key, y1, x1, y2, x2): the sides of cells (key, y, x) that no neighbour shares, with the cell on their left.

    A side that two cells share runs once each way; both go.
    """
    y, x = F.col("y"), F.col("x")
    side = lambda y1, x1, y2, x2: F.struct(y1.alias("y1"), x1.alias("x1"), y2.alias("y2"), x2.alias("x2"))
    around = F.array(side(y, x, y, x + 1), side(y, x + 1, y + 1, x + 1), side(y + 1, x + 1, y + 1, x), side(y + 1, x, y, x))
    sides = cells.select(key, F.explode(around).alias("s"))
    # Both runs of a side have the same middle.
    middle = [(F.col("s.y1") + F.col("s.y2")).alias("my"), (F.col("s.x1") + F.col("s.x2")).alias("mx")]
    alone = sides.groupBy(key, *middle).agg(F.count("*").alias("n"), F.first("s").alias("s"))
    return alone.filter("n = 1").select(key, "s.*")


def outlines(cells: DataFrame, key: str = "ask") -> DataFrame:
    """(key, polygon, ring, cells, points array of (y, x)): the outlines of cells (key, y, x).

    Points are corners in numbers of cells; the first isn't repeated. Ring 0 of a polygon is its outside,
    anticlockwise, the others are its holes. Cells that touch at a corner only are polygons apart. ``cells`` is
    the area of the ring in cells, negative for a hole. Cells are cut to their border before they meet; a reach is bounded
    by its time limit (some hundred cells a side), so its border is one group.
    """

    def chained(group: pd.DataFrame) -> pd.DataFrame:
        sides = [tuple(r) for r in group[["y1", "x1", "y2", "x2"]].sort_values(["y1", "x1", "y2", "x2"]).itertuples(index=False)]
        leads: dict[tuple, list] = {}
        for side in sides:
            leads.setdefault(side[:2], []).append(side)
        # Where two cells touch at a corner the outline stays with the own cell, to the left.
        after = {s: max(leads[s[2:]], key=lambda w, s=s: _turn(s, w)) for s in sides}
        rings, seen = [], set()
        for first in sides:
            side, ring = first, []
            while side not in seen:
                seen.add(side)
                if _turn(side, after[side]):
                    ring.append(side[2:])
                side = after[side]
            if ring:
                rings.append(ring)
        areas = [_area(r) for r in rings]
        outer = [i for i, a in enumerate(areas) if a > 0]
        rows = [(n, 0, areas[i], rings[i]) for n, i in enumerate(outer)]
        holes = dict.fromkeys(range(len(outer)), 0)
        for i, a in enumerate(areas):
            if a < 0:
                # A hole lies in the smallest outline round a point just left of its first side, which is a cell of it.
                (y1, x1), (y2, x2) = rings[i][0], rings[i][1]
                dy, dx = np.sign(y2 - y1), np.sign(x2 - x1)
                point = (y1 + dy * 0.5 + dx * 0.5, x1 + dx * 0.5 - dy * 0.5)
                home = min((n for n, o in enumerate(outer) if _inside(point, rings[o])), key=lambda n: areas[outer[n]])
                holes[home] += 1
                rows.append((home, holes[home], a, rings[i]))
        out = pd.DataFrame(rows, columns=["polygon", "ring", "cells", "points"])
        out["points"] = [[{"y": int(y), "x": int(x)} for y, x in r] for r in out["points"]]
        out.insert(0, key, group[key].iloc[0])
        return out

    kind = dict(cells.dtypes)[key]
    return border(cells, key).groupBy(key).applyInPandas(chained, f"{key} {kind}, polygon int, ring int, cells long, points array<struct<y:long,x:long>>")


def _turn(side: tuple, other: tuple) -> int:
    """1 where ``other`` turns left from ``side``, -1 to the right, 0 straight on; all sides are one cell long."""
    return (side[3] - side[1]) * (other[2] - other[0]) - (side[2] - side[0]) * (other[3] - other[1])


def _area(ring: list) -> int:
    """The area in cells, positive anticlockwise (y up)."""
    return sum(x1 * y2 - x2 * y1 for (y1, x1), (y2, x2) in zip(ring, ring[1:] + ring[:1], strict=True)) // 2


def _inside(point: tuple, ring: list) -> bool:
    y, x = point
    crossed = False
    for (y1, x1), (y2, x2) in zip(ring, ring[1:] + ring[:1], strict=True):
        if (y1 > y) != (y2 > y) and x < x1 + (y - y1) * (x2 - x1) / (y2 - y1):
            crossed = not crossed
    return crossed


def reach_documents(questions: DataFrame, cells: DataFrame, stats: DataFrame, mode: str, label: str) -> DataFrame:
    """(ask, answer): each question's reach as a JSON text: mode, label, minutes, cell_m, cells, area_km2, origin,
    reached_nodes, places, and its outlines as GeoJSON.

    stats: ask, reached_nodes, places. A question without a row there counts none.
    """
    rings = outlines(cells).join(questions.select("ask", "dlat", "dlon"), "ask")
    corner = lambda p: F.array(p["x"] * F.col("dlon"), p["y"] * F.col("dlat"))
    drawn = rings.select("ask", "polygon", "ring", F.transform(geo.closed(F.col("points")), corner).alias("line"))
    polygons = drawn.groupBy("ask", "polygon").agg(F.array_sort(F.collect_list(F.struct("ring", "line"))).alias("r")).select("ask", "polygon", F.col("r.line").alias("rings"))
    shapes = polygons.groupBy("ask").agg(F.array_sort(F.collect_list(F.struct("polygon", "rings"))).alias("p")).select("ask", F.col("p.rings").alias("coordinates"))
    sizes = cells.groupBy("ask").agg(F.count("*").alias("cells"))
    told = questions.join(sizes, "ask").join(shapes, "ask").join(stats, "ask", "left")
    area = F.round(F.col("cells") * F.pow(F.col("cell_m") / 1000.0, 2.0), 2)
    told = told.withColumn("area_km2", area).withColumn("mode", F.lit(mode)).withColumn("label", F.lit(label))
    feature = F.struct(
        F.lit("Feature").alias("type"), F.struct(F.lit("MultiPolygon").alias("type"), "coordinates").alias("geometry"), F.struct("mode", "label", "minutes", "area_km2").alias("properties"),
    )
    none = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    answer = F.struct(
        "mode", "label", "minutes", "cell_m", "cells", "area_km2", F.struct("lat", "lon").alias("origin"), none("reached_nodes"), none("places"),
        F.struct(F.lit("FeatureCollection").alias("type"), F.array(feature).alias("features")).alias("geojson"),
    )
    return told.select("ask", F.to_json(answer).alias("answer"))


def wanted_cells(points: DataFrame, metres: Column | float, size: float, loaded: DataFrame | None = None) -> DataFrame:
    """(y, x): the cells of ``size`` degrees within a box of ``metres`` round any point (lat, lon), but those ``loaded``."""
    away = F.lit(float(metres)) if isinstance(metres, (int, float)) else metres
    high, wide = away / geo.DEGREE_M, away / (geo.DEGREE_M * F.cos(F.radians("lat")))
    cell = lambda c: F.floor(c / size).cast("long")
    rows = points.select(F.sequence(cell(F.col("lat") - high), cell(F.col("lat") + high)).alias("ys"), F.sequence(cell(F.col("lon") - wide), cell(F.col("lon") + wide)).alias("xs"))
    wanted = rows.select(F.explode("ys").alias("y"), "xs").select("y", F.explode("xs").alias("x")).distinct()
    return wanted if loaded is None else wanted.join(loaded.select("y", "x"), ["y", "x"], "left_anti")


def roads_within(edges: DataFrame, cells: DataFrame, surveyed: DataFrame | None = None) -> DataFrame:
    """The edges (a, b, y, x of their cell, ...) in wanted cells, both ways, with the codes surveyed on them.

    A table of edges written by ``y`` is read for the rows of cells asked for alone, as the join prunes its folders.
    A car may not drive a one-way edge backwards; all else may go there.
    """
    held = edges.join(cells, ["y", "x"], "left_semi")
    if surveyed is not None:
        held = held.join(surveyed, ["a", "b"], "left")
    return roads.both_ways(held)
