"""Ways between points over a road graph: one to many, point to point, and what lies on the way.

Nodes: node, lat, lon; arcs: a, b, cost (seconds, null where closed), both directions. Points are
snapped to nodes that an open arc touches; searches from the same node run once, whatever the number of
pairs that start there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from outways.functions import geo
from outways.operators import near, roads

# Snapping in two attempts (metres, nodes, starts tried), the pace to a candidate's node, and the
# longest straight line per mode.
ATTEMPTS = ((400.0, 8, 2), (800.0, 32, 6))
CANDIDATE_SNAP_M, PACE = 250.0, 80.0
LONGEST_M = {"walk": 6_500, "bike": 15_000, "car": 30_000}
TOO_FAR = {"walk": "歩くには遠すぎます", "bike": "自転車には遠すぎます", "car": "遠すぎます"}
NO_STEP_FREE = "段差を避ける道が見つかりませんでした。この道には階段が %d か所あります"
MERGE_M = 45.0
# Labels of surveyed steps by their code.
STEP_LABELS = {"3": "2〜5cm の段差", "4": "5〜10cm の段差", "5": "10cm を超える段差"}


def reachable_points(origins: DataFrame, candidates: DataFrame, nodes: DataFrame, arcs: DataFrame, max_seconds: float = 900, cut=None) -> DataFrame:
    """(origin, candidate, seconds) of the candidates within ``max_seconds`` of an origin.

    origins: origin, lat, lon; candidates: candidate, lat, lon. The way from the origin to its node is
    free, that from a candidate's node is walked at ``PACE``.
    """
    cut = cut or (lambda df: df.checkpoint())
    arcs = roads.listed(arcs.select("a", "b", "cost"), cut)
    usable = cut(roads.usable_nodes(nodes, roads.unlisted(arcs)))
    starts = near.nearest(origins, usable.select("node", "lat", "lon"), ATTEMPTS[0][0], "origin", "node").select("origin", F.col("node").alias("start"))
    ends = near.nearest(candidates, usable.select("node", "lat", "lon"), CANDIDATE_SNAP_M, "candidate", "node").select("candidate", "node", F.col("metres").alias("snap"))
    sources = starts.select("start", F.col("start").alias("node")).distinct().withColumn("cost", F.lit(0.0))
    known = roads.least_costs(arcs, sources, max_seconds, cut=cut, by=("start",))
    seconds = F.col("cost") + F.col("snap") / PACE * 60
    met = starts.join(known.select("start", "node", "cost"), "start").join(ends, "node").withColumn("total", seconds).filter(F.col("total") <= max_seconds)
    return met.select("origin", "candidate", F.col("total").cast("int").alias("seconds"))


#: How much longer than its lower bound a way is taken to be at first; beyond that only an upper bound holds.
GUESSES = (1.25, None)


def route_ends(pairs: DataFrame, nodes: DataFrame, arcs: DataFrame, speed: float, attempts=ATTEMPTS, budget: float | None = None, cut=None, marks: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The way of each pair: (pair, start, node, cost, attempt), and the searches behind them (start, node,
    cost, pred).

    pairs: pair, o_lat, o_lon, d_lat, d_lon. The nearest nodes are tried first; pairs without a way go
    on to the next attempt, with more and farther nodes: the nearest may lie on an island. The way
    from the last node to the destination is walked at ``speed`` metres a minute. Ties go to the
    nearer start, then the smaller node.

    With ``marks`` (``roads.landmarks``) a search goes only where a way of one of its pairs within a guessed bound can
    lie; a way found within the guess is the best, and pairs without one are searched again within the
    proven bound. Without ``marks`` a search goes everywhere within ``budget``.
    """
    cut = cut or (lambda df: df.checkpoint())
    arcs = roads.listed(arcs.select("a", "b", "cost"), cut)
    usable = cut(roads.usable_nodes(nodes, roads.unlisted(arcs)).select("node", "lat", "lon"))
    left, found, searches = cut(pairs), None, None
    for turn, (metres, k, tries) in enumerate(attempts):
        origins = left.select("o_lat", "o_lon").distinct().withColumn("origin", F.struct("o_lat", "o_lon"))
        goals = left.select("d_lat", "d_lon").distinct().withColumn("goal", F.struct("d_lat", "d_lon"))
        starts = near.nearest(origins.select("origin", F.col("o_lat").alias("lat"), F.col("o_lon").alias("lon")), usable, metres, "origin", "node", k)
        ends = cut(near.nearest(goals.select("goal", F.col("d_lat").alias("lat"), F.col("d_lon").alias("lon")), usable, metres, "goal", "node", k))
        starts = cut(starts.filter(F.col("rank") <= tries).select("origin", F.col("node").alias("start"), "rank"))
        for guess in GUESSES if marks is not None and not turn else (None,):
            asked = left.withColumn("origin", F.struct("o_lat", "o_lon")).withColumn("goal", F.struct("d_lat", "d_lon")).join(starts, "origin")
            sources = asked.select("start", F.col("start").alias("node")).distinct().withColumn("cost", F.lit(0.0))
            met = asked.join(ends.withColumnRenamed("metres", "snap").drop("rank"), "goal").withColumn("extra", F.col("snap") / speed * 60)
            if marks is None:
                known = roads.least_costs(arcs, sources, budget, cut=cut, by=("start",))
            else:
                wanted = cut(met.select("pair", "start", "node", "extra"))
                bounds = cut(roads.pair_bounds(wanted, marks, guess))
                marked = roads.unlisted(arcs).join(marks.withColumnRenamed("node", "b"), "b", "left")
                known = roads.least_costs(marked, sources.join(roads.goal_bounds(wanted, bounds, marks), "start", "left"), budget, cut=cut, by=("start",), keep=roads.within_bounds(), carry=("ahead", "behind"))
            best = F.min(F.struct((F.col("cost") + F.col("extra")).alias("total"), "rank", "node", "start", "cost")).alias("b")
            won = met.join(known, ["start", "node"]).groupBy("pair").agg(best)
            if guess is not None:
                won = won.join(bounds, "pair").filter(F.col("b.total") <= F.col("u"))
            won = cut(won.select("pair", "b.start", "b.node", "b.cost", F.lit(turn + 1).alias("attempt")))
            found = won if found is None else found.unionByName(won)
            known = roads.with_preds(known, arcs, ("start",))
            searches = known if searches is None else searches.unionByName(known)
            left = cut(left.join(won, "pair", "left_anti"))
            if not left.limit(1).count():
                break
        else:
            continue
        break
    # A bounded search may know a node by a detour alone; the best of all searches from a start counts.
    return found, searches.groupBy("start", "node").agg(F.min(F.struct("cost", "pred")).alias("o")).select("start", "node", "o.cost", "o.pred")


def straight_m(pairs: DataFrame) -> Column:
    return geo.haversine(F.col("o_lat"), F.col("o_lon"), F.col("d_lat"), F.col("d_lon"))


def walk_plans(pairs: DataFrame, nodes: DataFrame, legs: DataFrame, speed: float, mode: str = "walk", relaxed: DataFrame | None = None, budget: float | None = None, cut=None) -> DataFrame:
    """One row a pair: (pair, mode, straight_m, unavailable, reason, seconds, metres, steps, elevators,
    covered_m, bike_sidewalk_m, step_free, warning); null figures where no way is found.

    legs: arcs with length, highway, attrs beside a, b and cost. Pairs farther apart than the mode goes
    are named as such and not searched. ``relaxed``: legs that are taken where ``legs`` lead nowhere,
    with a warning that names the steps.
    """
    cut = cut or (lambda df: df.checkpoint())
    apart = cut(pairs.withColumn("straight_m", straight_m(pairs).cast("int")))
    near_enough = apart.filter(F.col("straight_m") <= LONGEST_M[mode]).drop("straight_m")
    plans, left = None, near_enough
    for stage, ways in enumerate([legs] if relaxed is None else [legs, relaxed]):
        ends, known = route_ends(left, nodes, ways.select("a", "b", "cost"), speed, budget=budget, cut=cut)
        found = cut(summarised(ends, known, ways, cut).withColumn("stage", F.lit(stage)))
        plans = found if plans is None else plans.unionByName(found)
        left = cut(left.join(found, "pair", "left_anti"))
        if not left.limit(1).count():
            break
    far = F.col("straight_m") > LONGEST_M[mode]
    relaxed_way = F.col("stage") == 1
    return apart.select("pair", "straight_m").join(plans, "pair", "left").select(
        "pair", F.lit(mode).alias("mode"), "straight_m", far.alias("unavailable"), F.when(far, F.lit(TOO_FAR[mode])).alias("reason"),
        *[F.col(c).cast("int").alias(c) for c in ("seconds", "metres", "steps", "elevators", "covered_m", "bike_sidewalk_m")],
        F.when(F.col("steps").isNotNull(), (F.col("steps") == 0) & ~relaxed_way).alias("step_free"), F.when(relaxed_way, F.format_string(NO_STEP_FREE, F.col("steps").cast("int"))).alias("warning"),
    )


def best_legs(legs: DataFrame) -> DataFrame:
    """Of parallel legs the cheapest open one: (a, b, w struct)."""
    return legs.filter("cost is not null").groupBy("a", "b").agg(F.min(F.struct("cost", "length", "highway", F.to_json("attrs").alias("attrs"))).alias("w"))


def summarised(ends: DataFrame, known: DataFrame, legs: DataFrame, cut=None) -> DataFrame:
    """(pair, seconds, metres, steps, elevators, covered_m, bike_sidewalk_m) of the ways that ``route_ends`` found."""
    by_leg = known.filter("pred is not null").join(best_legs(legs), (F.col("pred") == F.col("a")) & (F.col("node") == F.col("b")))
    by_leg = by_leg.select("start", "node", "w.cost", "w.length", "w.highway", F.from_json("w.attrs", "map<string,string>").alias("attrs"))
    sums = roads.path_sums(known.select("start", "node", "pred"), by_leg.select("start", "node", *roads.leg_measures()), list(roads.PATH_SUMS), cut=cut, by=("start",))
    return ends.join(sums, ["start", "node"]).select("pair", "start", "node", *roads.PATH_SUMS)


def way_nodes(ends: DataFrame, known: DataFrame, max_hops: int = 100_000, cut=None) -> DataFrame:
    """(pair, i, node): the nodes of each found way, from its start (0) on."""
    cut = cut or (lambda df: df.checkpoint())
    back = cut(known.filter("pred is not null").select("start", "node", "pred"))
    at = cut(ends.select("pair", "start", "node", F.lit(0).alias("back")))
    parts = [at]
    for hop in range(1, max_hops + 2):
        at = cut(at.join(back, ["start", "node"]).select("pair", "start", F.col("pred").alias("node"), F.lit(hop).alias("back")))
        if not at.limit(1).count():
            break
        parts.append(at)
        if len(parts) == 64:
            parts = [cut(roads.union_all(parts))]
    else:
        raise RuntimeError(f"a way has over {max_hops} hops")
    order = Window.partitionBy("pair").orderBy(F.desc("back"))
    return roads.union_all(parts).select("pair", (F.row_number().over(order) - 1).alias("i"), "node")


def obstacles(legs: DataFrame) -> DataFrame:
    """(pair, obstacles array of lat, lon, kind, label, source, count, i): what troubles a pram on each way.

    legs: pair, i (from 1), highway, lev_diff, width_code, vtcl_slope, lat, lon (the leg's middle). Marks of
    one kind up to ``MERGE_M`` after the last one kept are counted into it: a fold along the way, as
    the distance is to the mark that was kept.
    """
    label = F.create_map(*[F.lit(x) for item in STEP_LABELS.items() for x in item])
    mark = lambda kind, text, source: F.struct(F.lit(kind).alias("kind"), (text if isinstance(text, Column) else F.lit(text)).alias("label"), F.lit(source).alias("source"))
    step = F.try_element_at(label, F.col("lev_diff"))
    kinds = F.array(
        F.when(F.col("highway") == "steps", mark("steps", "階段", "OpenStreetMap")),
        F.when(step.isNotNull(), mark("step", step, "ほこナビ")),
        F.when(F.col("width_code") == "1", mark("narrow", "幅 1m 未満（ベビーカーですれ違えない）", "ほこナビ")),
        F.when(F.col("vtcl_slope").isin("5", "6", "7", "8"), mark("steep", "8% を超える坂", "ほこナビ")),
    )
    each = legs.select("pair", "i", "lat", "lon", F.explode(F.filter(kinds, lambda k: k.isNotNull())).alias("k")).select("pair", "i", "lat", "lon", "k.kind", "k.label", "k.source")
    marks = each.groupBy("pair", "kind").agg(F.array_sort(F.collect_list(F.struct("i", "lat", "lon", "label", "source"))).alias("marks"))
    kept = "array<struct<lat:double,lon:double,kind:string,label:string,source:string,count:int,i:int>>"

    def fold(done: Column, m: Column) -> Column:
        last = F.element_at(done, -1)
        merged = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(last.withField("count", last["count"] + 1)))
        new = F.struct(m["lat"].alias("lat"), m["lon"].alias("lon"), F.col("kind").alias("kind"), m["label"].alias("label"), m["source"].alias("source"), F.lit(1).alias("count"), m["i"].cast("int").alias("i"))
        close = (F.size(done) > 0) & (geo.haversine(F.try_element_at(done, F.lit(-1))["lat"], F.try_element_at(done, F.lit(-1))["lon"], m["lat"], m["lon"]) <= MERGE_M)
        return F.when(F.coalesce(close, F.lit(False)), merged).otherwise(F.concat(done, F.array(new)))

    folded = marks.select("pair", F.explode(F.aggregate("marks", F.array().cast(kept), fold)).alias("o"))
    return folded.groupBy("pair").agg(F.array_sort(F.collect_list(F.struct("o.i", "o.kind", "o"))).alias("os")).select("pair", F.transform("os", lambda x: x["o"]).alias("obstacles"))


def diverging(chosen: Column, plain: Column) -> Column:
    """(low, high) of the part of ``plain`` that isn't the chosen line's, by its points; null where there
    is none. Lines: arrays of (lon, lat)."""
    same = lambda u, v: (F.abs(u["lon"] - v["lon"]) < 1e-9) & (F.abs(u["lat"] - v["lat"]) < 1e-9)
    n = F.least(F.size(chosen), F.size(plain))

    def run(a: Column, b: Column, most: Column) -> Column:
        """How many points agree from the front."""
        agree = F.zip_with(F.slice(a, F.lit(1), most), F.slice(b, F.lit(1), most), same)
        first = F.array_position(agree, False)
        return F.when(first > 0, first - 1).otherwise(F.size(agree)).cast("int")

    head = run(chosen, plain, n)
    tail = run(F.reverse(chosen), F.reverse(plain), n - head)
    high = F.size(plain) - tail
    return F.when((head < F.size(plain)) & (high > head), F.struct(head.alias("low"), high.alias("high")))


def compared(ways: DataFrame, walk_speed: float) -> DataFrame:
    """The plain way's part beside the chosen one: (pair, coords, metres, extra_m, extra_seconds, obstacles);
    only where that part has obstacles.

    ways: pair, coords, metres (chosen), plain_coords, plain_metres, plain_obstacles.
    """
    span = ways.withColumn("span", diverging(F.col("coords"), F.col("plain_coords"))).filter("span is not null and size(coords) >= 2")
    marks = F.filter("plain_obstacles", lambda o: (o["i"] + 1 >= F.col("span.low")) & (o["i"] < F.col("span.high")))
    low = F.greatest(F.lit(0), F.col("span.low") - 1)
    part = F.slice("plain_coords", low + 1, F.least(F.size("plain_coords"), F.col("span.high") + 1) - low)
    extra = F.greatest(F.lit(0), F.col("metres") - F.col("plain_metres"))
    out = span.withColumn("obstacles", marks).filter(F.size("obstacles") > 0)
    return out.select("pair", part.alias("coords"), F.col("plain_metres").alias("metres"), extra.alias("extra_m"), (extra / walk_speed * 60).cast("int").alias("extra_seconds"), "obstacles")
