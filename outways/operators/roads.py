"""Road graphs: edge costs by travel profile, shortest paths, reach and its cells."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from outways.functions import geo
from outways.plans.profiles import Profile

# Kinds of roads and metres a minute on them.
BUSY_ROADS = ("primary", "primary_link", "secondary", "secondary_link", "trunk", "trunk_link", "motorway", "motorway_link")
CAR_SPEEDS = {
    "motorway": 1300, "motorway_link": 800, "trunk": 800, "trunk_link": 600, "primary": 550, "primary_link": 450, "secondary": 500, "secondary_link": 400,
    "tertiary": 420, "residential": 280, "living_street": 180, "service": 180, "unclassified": 350, "busway": 300, "road": 300,
}
CAR_DEFAULT, BIKE_SPEED, PUSHED_BIKE = 300, 220, 1.6
UNPAVED = ("gravel", "ground", "dirt", "sand", "unpaved")
RAISED_KERB, STROLLER_BARRIER = 1.8, 1.3


def _factor(condition: Column, weight: float | None) -> Column:
    return F.when(F.coalesce(condition, F.lit(False)), F.lit(float(weight if weight is not None else 1.0))).otherwise(F.lit(1.0))


def edge_seconds(profile: Profile, mode: str = "walk") -> Column:
    """Seconds along an edge with columns length, highway, attrs (map), walk, bike, car, lev_diff, width,
    vtcl_slope, roof (codes or null) and to_tags (map of the node it leads to); null where it
    can't be passed. All weights multiply."""
    attr = lambda key: F.try_element_at(F.col("attrs"), F.lit(key))
    highway, length = F.col("highway"), F.col("length").cast("double")
    busy = highway.isin(*BUSY_ROADS)
    unpaved = _factor(attr("surface").isin(*UNPAVED), profile.unpaved)
    if mode == "car":
        speed = F.lit(float(CAR_DEFAULT))
        for kind, metres in CAR_SPEEDS.items():
            speed = F.when(highway == kind, float(metres)).otherwise(speed)
        return F.when(F.col("car") == 1, length / speed * 60)
    if mode == "bike":
        pushed = F.when(F.coalesce(attr("bicycle").isin("yes", "designated"), F.lit(False)), F.lit(float(profile.bike_sidewalk))).otherwise(F.lit(PUSHED_BIKE))
        road = F.when(highway == "cycleway", F.lit(float(profile.cycleway))).when(highway == "footway", pushed).when(busy, F.lit(float(profile.busy_road))).otherwise(F.lit(1.0))
        return F.when(F.col("bike") == 1, length / BIKE_SPEED * 60 * road * unpaved)
    ramp = (F.coalesce(attr("ramp"), F.lit("")) != "") | (F.coalesce(attr("ramp:stroller"), F.lit("")) != "")
    if profile.steps is None:
        steps = F.lit(None).cast("double")
    else:
        no_rail = F.coalesce(attr("handrail") != "yes", F.lit(True))
        steps = F.when(no_rail, F.lit(float(profile.steps_no_handrail))).otherwise(F.lit(float(profile.steps))) if profile.steps_no_handrail else F.lit(float(profile.steps))
        if profile.stroller:
            steps = F.when(ramp, steps)
    bare = attr("sidewalk").isNull() | attr("sidewalk").isin("no", "none")
    road = F.when(highway == "steps", steps).when(highway == "elevator", F.lit(float(profile.elevator))).when(busy & bare, F.lit(float(profile.busy_road))).otherwise(F.lit(1.0))
    incline = _factor(~F.coalesce(attr("incline"), F.lit("")).isin("", "0%"), profile.incline)
    width = F.trim(F.replace(attr("width"), F.lit("m"), F.lit(""))).try_cast("double")
    narrow = _factor(width < 1.5, profile.narrow) if profile.narrow else F.lit(1.0)
    covered = _factor((attr("covered") == "yes") | (attr("tunnel") == "building_passage"), profile.covered)
    b = profile.barriers
    step = F.when(F.col("lev_diff") == "5", b.get("step_over_10cm", 1.0)).when(F.col("lev_diff") == "4", b.get("step_over_5cm", 1.0)).when(F.col("lev_diff") == "3", b.get("step_over_2cm", 1.0)).otherwise(1.0)
    slope = F.when(F.col("vtcl_slope").isin("5", "6", "7", "8"), b.get("steep", 1.0)).when(F.col("vtcl_slope").isin("3", "4"), b.get("slope", 1.0)).otherwise(1.0)
    barrier = step * slope * _factor(F.col("width_code") == "1", b.get("narrow", 1.0)) * _factor(F.col("roof") == "2", b.get("roof", 1.0))
    node = F.lit(1.0)
    if profile.stroller:
        tag = lambda key: F.try_element_at(F.col("to_tags"), F.lit(key))
        node = _factor(tag("kerb").isin("raised", "yes"), RAISED_KERB) * _factor(tag("barrier").isin("gate", "bollard", "kissing_gate", "stile"), STROLLER_BARRIER)
    return F.when(F.col("walk") == 1, length / profile.walk_speed * 60 * road * incline * unpaved * narrow * covered * barrier * node)


def both_ways(edges: DataFrame) -> DataFrame:
    """Edges and their reverse; a one-way edge's reverse is closed to cars only."""
    turned = {"a": F.col("b").alias("a"), "b": F.col("a").alias("b"), "car": F.when(F.col("oneway") == 1, 0).otherwise(F.col("car")).alias("car")}
    back = edges.select(*[turned.get(c, F.col(c)) for c in edges.columns])
    return edges.unionByName(back)


#: Rows up to which a frontier, or the nodes it can offer, are broadcast; beyond it both sides are shuffled by key.
SMALL_ROWS = 200_000
#: Parts of the known costs that are kept side by side before the later ones are merged.
PARTS = 4
#: Arcs of a node that share a row.
LISTED = 64


def shortest(
    arcs: DataFrame, sources: DataFrame, budget: float | None = None, max_rounds: int = 10_000, cut=None, by: tuple[str, ...] = (), delta: float | None = None,
    keep: Column | None = None, carry: tuple[str, ...] = (),
) -> DataFrame:
    """(*by, node, cost, pred): cheapest cost from any source (*by, node, cost) up to ``budget``; see ``least_costs``.

    Of several cheapest ways the predecessor with the smallest id is named; over an arc of cost 0 that of the round and
    step in which the cost was found, so that predecessors never form a circle.
    """
    arcs = arcs if "arcs" in arcs.columns else listed(arcs, cut)
    return with_preds(least_costs(arcs, sources, budget, max_rounds, cut, by, delta, keep, carry), arcs, by)


def with_preds(known: DataFrame, arcs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``least_costs`` over ``listed`` arcs with the predecessors that ``shortest`` names: every arc is met once more, so only for those who
    follow ways."""
    keys, costs = [*by, "node"], known.select(*by, "node", "cost")
    steps = arcs.select("a", F.inline("arcs")).select("a", "b", "step").filter("step > 0")
    through = costs.select(*by, F.col("node").alias("a"), F.col("cost").alias("before")).join(steps, "a").join(costs.withColumnRenamed("node", "b"), [*by, "b"]).filter(F.col("before") + F.col("step") == F.col("cost"))
    # A start that nothing improved has no predecessor.
    preds = through.groupBy(*by, F.col("b").alias("node")).agg(F.min("a").alias("first"))
    return known.join(preds, keys, "left").select(*keys, "cost", F.when(F.col("pred").isNotNull(), F.coalesce("first", "pred")).alias("pred"))


def listed(arcs: DataFrame, cut=None) -> DataFrame:
    """(a, arcs array of (b, step, ...)): the cheapest open arc (a, b, cost, ...) between two nodes, side by side in rows of
    up to ``LISTED``, dealt by their start and cut once: what reads them reads rows by nodes, not by arcs."""
    cut = cut or (lambda df: df.checkpoint())
    on = [c for c in arcs.columns if c not in ("a", "b", "cost")]
    best = F.min(F.struct(F.col("cost").cast("double").alias("step"), *on)).alias("w")
    dealt = arcs.filter("cost is not null").repartition("a").groupBy("a", "b").agg(best)
    turn = F.floor((F.row_number().over(Window.partitionBy("a").orderBy("b")) - 1) / LISTED).alias("turn")
    rows = dealt.select("a", turn, F.struct("b", "w.*").alias("arc")).groupBy("a", "turn").agg(F.collect_list("arc").alias("arcs"))
    return cut(rows.select("a", "arcs").sortWithinPartitions("a"))


def unlisted(arcs: DataFrame) -> DataFrame:
    """The arcs (a, b, cost, ...) of ``listed`` ones."""
    return arcs.select("a", F.inline("arcs")).withColumnRenamed("step", "cost")


def least_costs(
    arcs: DataFrame, sources: DataFrame, budget: float | None = None, max_rounds: int = 10_000, cut=None, by: tuple[str, ...] = (), delta: float | None = None,
    keep: Column | None = None, carry: tuple[str, ...] = (),
) -> DataFrame:
    """(*by, node, cost, pred): cheapest cost from any source (*by, node, cost) up to ``budget``; ``pred`` is the node before
    it on some cheapest way.

    arcs: (a, b, cost), costs not negative or null (closed). ``by``: columns of the sources that keep
    searches apart; all run in the same rounds. Labels are set in buckets of ``delta`` seconds (all at once where it is
    None): a round relaxes only what is new in the bucket, the rest of the frontier waits until no label of
    an earlier bucket can change. Only the frontier and its offers move: what is known is appended to in
    parts and looked up for the offered nodes alone; of over ``PARTS`` parts the later, small ones are merged, and
    the first with them only once they hold half as much. The search ends when nothing is left to relax, and fails
    where ``max_rounds`` aren't enough.

    ``keep``: a condition on an offer (cost, the arc's other columns, and the columns ``carry`` that each source
    hands on along its ways); offers that fail it are dropped, see ``goal_bounds``.

    A small frontier goes two arcs a round. ``arcs`` may come ``listed``, so that several readers share them.
    """
    cut = cut or (lambda df: df.checkpoint())
    limit = F.lit(float("inf") if budget is None else float(budget))
    node_type = arcs.schema["a"].dataType
    keys = [*by, "node"]
    handed = [F.first(c).alias(c) for c in carry]
    first = sources.groupBy(*keys).agg(F.min(F.col("cost").cast("double")).alias("cost"), *handed).filter(F.col("cost") <= limit)
    frontier = cut(first.select(*keys, "cost", F.lit(None).cast(node_type).alias("pred"), *carry))
    listed_arcs = arcs if "arcs" in arcs.columns else listed(arcs, cut)
    # No frontier of n rows can offer more than n times so many.
    fan = listed_arcs.groupBy("a").agg(F.sum(F.size("arcs")).alias("n")).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    n = frontier.count()
    parts, sizes, waiting, upto = [frontier], [n], None, delta
    for _ in range(max_rounds):
        if not n and waiting is not None:
            # The bucket is settled; what waits and is still the best goes on with the next one.
            left = waiting.join(_current(parts, keys), keys).filter(F.col("cost") == F.col("known")).drop("known").distinct()
            lowest = left.agg(F.min("cost")).first()[0]
            if lowest is None:
                break
            upto = (math.floor(lowest / delta) + 1) * delta
            frontier, waiting = cut(left.filter(F.col("cost") < upto)), cut(left.filter(F.col("cost") >= upto))
            n = frontier.count()
        if not n:
            break
        small = n * fan <= SMALL_ROWS

        def offers(of: DataFrame, bounded: bool) -> DataFrame:
            moving = of.select(*by, F.col("node").alias("a"), "cost", *carry)
            met = listed_arcs.join(F.broadcast(moving) if bounded else moving, "a").select(*by, "a", "cost", *carry, F.inline("arcs"))
            met = met.withColumn("cost", F.col("cost") + F.col("step")).filter(F.col("cost") <= limit)
            if keep is not None:
                met = met.filter(keep)
            found = met.select(*by, F.col("b").alias("node"), "cost", F.col("a").alias("pred"), *carry).groupBy(*keys).agg(F.min(F.struct("cost", "pred")).alias("o"), *handed)
            return found.select(*keys, "o.cost", "o.pred", *carry)

        offered = offers(frontier, n <= SMALL_ROWS)
        if small and delta is None:
            # What so few rows can offer is bounded too: it goes on at once, in the same round. At equal cost the nearer wins.
            hop = lambda of, i: of.withColumn("hop", F.lit(i))
            both = hop(offered, 0).unionByName(hop(offers(offered, True), 1)).groupBy(*keys).agg(F.min(F.struct("cost", "hop", "pred")).alias("o"), *handed)
            offered = both.select(*keys, "o.cost", "o.pred", *carry)
        known = _current(parts, keys, offered if small and n * fan * fan <= SMALL_ROWS < sum(sizes) else None)
        better = cut(offered.join(known, keys, "left").filter(F.col("known").isNull() | (F.col("cost") < F.col("known"))).drop("known"))
        parts.append(better)
        fresh = better.count()
        sizes.append(fresh)
        if len(parts) > PARTS:
            at = 0 if 2 * sum(sizes[1:]) >= sizes[0] else 1
            parts, sizes = [*parts[:at], cut(_merged(parts[at:], keys, carry))], [*sizes[:at], sum(sizes[at:])]
        if delta is None:
            frontier, n = better, fresh
        else:
            frontier, later = better.filter(F.col("cost") < upto), better.filter(F.col("cost") >= upto)
            waiting, n = later if waiting is None else waiting.union(later), frontier.count()
    else:
        raise RuntimeError(f"costs still fall after {max_rounds} rounds")
    return cut(_merged(parts, keys, carry).select(*keys, "cost", "pred"))


def _current(parts: list[DataFrame], keys: list[str], of: DataFrame | None = None) -> DataFrame:
    """(*keys, known): the least cost so far; of the keys of ``of`` alone, where it is small."""
    rows = union_all([p.select(*keys, "cost") for p in parts])
    if of is not None:
        rows = rows.join(F.broadcast(of.select(*keys)), keys, "left_semi")
    return rows.groupBy(*keys).agg(F.min("cost").alias("known"))


def _merged(parts: list[DataFrame], keys: list[str], carry: tuple[str, ...]) -> DataFrame:
    """The best label of each key; a label found later is strictly better than those before."""
    return union_all(parts).groupBy(*keys).agg(F.min(F.struct("cost", "pred")).alias("o"), *[F.first(c).alias(c) for c in carry]).select(*keys, "o.cost", "o.pred", *carry)


def landmarks(nodes: DataFrame, arcs: DataFrame, n: int = 4, cut=None) -> DataFrame:
    """(node, there array, back array): seconds from each of ``n`` landmarks to the node and from the node to each,
    null where there is no way. Landmarks are the outermost nodes: north, south, east and west, then their diagonals.

    nodes: node, lat, lon; arcs: a, b, cost. Two searches over the graph, made once for all later ones.
    """
    cut = cut or (lambda df: df.checkpoint())
    turns = [F.struct(x.alias("x"), F.col("node")) for x in (F.col("lat"), -F.col("lat"), F.col("lon"), -F.col("lon"), F.col("lat") + F.col("lon"), F.col("lat") - F.col("lon"), F.col("lon") - F.col("lat"), -F.col("lat") - F.col("lon"))]
    picked = usable_nodes(nodes, arcs).agg(*[F.max(t)["node"].alias(f"n{i}") for i, t in enumerate(turns[:n])])
    sources = picked.select(F.posexplode(F.array(*picked.columns)).alias("landmark", "node")).withColumn("cost", F.lit(0.0))
    sources = cut(sources)
    forth = shortest(arcs.select("a", "b", "cost"), sources, cut=cut, by=("landmark",))
    turned = arcs.select(F.col("b").alias("a"), F.col("a").alias("b"), "cost")
    back = shortest(turned, sources, cut=cut, by=("landmark",))

    def row(found: DataFrame, name: str) -> DataFrame:
        """One row a node: its costs by landmark, in order."""
        costs = F.map_from_entries(F.collect_list(F.struct("landmark", "cost")))
        of = found.groupBy("node").agg(costs.alias("m"))
        return of.select("node", F.array(*[F.try_element_at("m", F.lit(i)) for i in range(n)]).alias(name))

    return cut(row(forth, "there").join(row(back, "back"), "node", "full"))


def pair_bounds(wanted: DataFrame, marks: DataFrame, stretch: float | None = None, slack: float = 120.0) -> DataFrame:
    """(pair, u): an upper bound of each pair's seconds, by a way over a landmark; with ``stretch`` no more than so
    many times the lower bound of the way, and ``slack``: a guess, which a way found within it proves right."""
    met = _marked_ends(wanted, marks)
    upper = F.array_min(F.zip_with("s_back", "there", lambda x, y: x + y))
    if stretch is not None:
        ahead, behind = F.array_max(F.zip_with("there", "s_there", lambda x, y: x - y)), F.array_max(F.zip_with("s_back", "back", lambda x, y: x - y))
        upper = F.least(upper, F.greatest(ahead, behind, F.lit(0.0)) * stretch + slack)
    return met.groupBy("pair").agg(F.min(upper + F.col("extra")).alias("u"))


def _marked_ends(wanted: DataFrame, marks: DataFrame) -> DataFrame:
    at = marks.select("node", "there", "back")
    starts = at.select(F.col("node").alias("start"), F.col("there").alias("s_there"), F.col("back").alias("s_back"))
    return wanted.join(starts, "start", "left").join(at, "node", "left")


def goal_bounds(wanted: DataFrame, bounds: DataFrame, marks: DataFrame) -> DataFrame:
    """(start, ahead array, behind array): how far a search from each start need go, landmark by landmark.

    wanted: (pair, start, node, extra): the starts and end nodes of each pair, with the seconds from an end node on;
    bounds: (pair, u). A label (n, cost) can only lie on a pair's way to e within u if cost + extra + d(n, e) <= u,
    and d(n, e) >= d(L, e) - d(L, n) as well as d(n, L) - d(e, L). So ``ahead`` is the largest u - extra - d(L, e) of
    a start's ends and ``behind`` the largest u - extra + d(e, L); null where a bound is missing, which then
    closes nothing.
    """
    met = _marked_ends(wanted, marks).join(bounds, "pair")
    # A little slack for sums that round otherwise.
    room = F.col("u") * (1 + 1e-9) + 1e-6 - F.col("extra")
    ahead, behind = F.transform("there", lambda d: room - d), F.transform("back", lambda d: room + d)
    n = F.greatest(F.size("there"), F.size("back"), F.lit(1))
    rows = met.select("start", F.explode(F.sequence(F.lit(1), n)).alias("i"), ahead.alias("ahead"), behind.alias("behind"))
    at_i = lambda c: F.try_element_at(F.col(c), F.col("i"))
    # One missing bound leaves the whole start unbounded at that landmark.
    most = lambda c: F.when(F.count("*") == F.count(at_i(c)), F.max(at_i(c))).alias(c)
    each = rows.groupBy("start", "i").agg(most("ahead"), most("behind"))
    ordered = F.array_sort(F.collect_list(F.struct("i", "ahead", "behind")))
    return each.groupBy("start").agg(ordered.alias("o")).select("start", F.col("o.ahead").alias("ahead"), F.col("o.behind").alias("behind"))


def within_bounds() -> Column:
    """The condition on an offer over an arc whose end has ``there`` and ``back``, from a start with ``ahead`` and ``behind``."""
    cost = F.col("cost")
    open_ahead = F.forall(F.zip_with("ahead", "there", lambda room, d: F.coalesce(cost <= room + d, F.lit(True))), lambda x: x)
    open_behind = F.forall(F.zip_with("behind", "back", lambda room, d: F.coalesce(cost <= room - d, F.lit(True))), lambda x: x)
    return F.coalesce(open_ahead, F.lit(True)) & F.coalesce(open_behind, F.lit(True))


def snapped_nodes(points: DataFrame, nodes: DataFrame, metres: float, key: str, k: int = 1) -> DataFrame:
    """(key, node, metres, rank) of the nearest nodes strictly within ``metres`` of each point."""
    from outways.operators.near import nearest

    return nearest(points, nodes.select("node", "lat", "lon"), metres, key, "node", k)


def usable_nodes(nodes: DataFrame, arcs: DataFrame) -> DataFrame:
    """The nodes (node, lat, lon) that an open arc (a, b, cost) touches."""
    touched = arcs.filter("cost is not null").select(F.explode(F.array("a", "b")).alias("node")).distinct()
    return nodes.join(touched, "node", "left_semi")


def path_nodes(known: DataFrame, targets: DataFrame, max_hops: int = 100_000, cut=None) -> DataFrame:
    """(target, hop, node): the nodes of the path to each target, from the target back.

    One round a hop, as the result holds a row for each; for sums along paths see ``path_sums``. Fails
    on paths of over ``max_hops``.
    """
    cut = cut or (lambda df: df.checkpoint())
    at = cut(targets.select(F.col("node").alias("target"), F.lit(0).alias("hop"), "node"))
    parts = [at]
    back = cut(known.select("node", "pred").filter("pred is not null"))
    for hop in range(1, max_hops + 2):
        at = cut(at.join(back, "node").select("target", F.lit(hop).alias("hop"), F.col("pred").alias("node")))
        if not at.limit(1).count():
            break
        parts.append(at)
        if len(parts) == 64:
            parts = [cut(union_all(parts))]
    else:
        raise RuntimeError(f"a path has over {max_hops} hops")
    return union_all(parts)


def union_all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for more in parts[1:]:
        out = out.union(more)
    return out


def path_sums(known: DataFrame, legs: DataFrame, sums: list[str], max_doublings: int = 60, cut=None, by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, node, hops, *sums): the sums of each node's way from its source.

    known: (*by, node, pred); legs: (*by, node, *sums) of the leg from pred to node. Sums travel up the tree of
    predecessors by doubling: after k rounds a node knows its last 2**k legs and the node before
    them, so long paths take few rounds and no path is written out.
    """
    cut = cut or (lambda df: df.checkpoint())
    keys = [*by, "node"]
    legs = legs.select(*keys, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in sums])
    at = known.select(*keys, F.col("pred").alias("up"), F.col("pred").isNotNull().cast("long").alias("hops")).join(legs, keys, "left")
    at = cut(at.select(*keys, "up", "hops", *[F.when(F.col("up").isNotNull(), F.col(c)).otherwise(0.0).alias(c) for c in sums]))
    for _ in range(max_doublings):
        if not at.filter("up is not null").limit(1).count():
            return at.drop("up")
        above = at.select(*by, F.col("node").alias("up"), F.col("up").alias("further"), *[F.col(c).alias(f"__{c}") for c in ("hops", *sums)])
        met = at.join(above, [*by, "up"], "left")
        at = cut(met.select(*keys, F.col("further").alias("up"), *[(F.col(c) + F.coalesce(f"__{c}", F.lit(0))).alias(c) for c in ("hops", *sums)]))
    raise RuntimeError("the predecessors form a circle")


PATH_SUMS = ("metres", "seconds", "steps", "elevators", "covered_m", "bike_sidewalk_m")


def leg_measures() -> list[Column]:
    """What a leg (length, cost, highway, attrs) adds to a path's summary, by ``PATH_SUMS``."""
    attr = lambda key: F.try_element_at(F.col("attrs"), F.lit(key))
    one = lambda c: F.when(F.coalesce(c, F.lit(False)), 1.0).otherwise(0.0)
    long_if = lambda c: F.when(F.coalesce(c, F.lit(False)), F.col("length")).otherwise(0.0)
    covered = (F.coalesce(attr("covered"), F.lit("")) == "yes") | (F.coalesce(attr("tunnel"), F.lit("")) != "")
    walked = (F.col("highway") == "footway") & attr("bicycle").isin("yes", "designated")
    measures = (F.col("length"), F.col("cost"), one(F.col("highway") == "steps"), one(F.col("highway") == "elevator"), long_if(covered), long_if(walked))
    return [m.alias(name) for m, name in zip(measures, PATH_SUMS, strict=True)]


def barrier_edges(edges: DataFrame, midpoints: DataFrame, metres: float = 25.0) -> DataFrame:
    """(a, b, and the codes of the nearest surveyed stretch strictly within ``metres``), for footpaths only.

    edges: a, b, walk, car, lat, lon (of the middle); midpoints: ord, lat, lon, lev_diff, width_code,
    vtcl_slope, roof.
    """
    from outways.operators.near import nearest

    footpaths = edges.filter("walk = 1 and car = 0").withColumn("edge", F.struct("a", "b"))
    best = nearest(footpaths.select("edge", "lat", "lon"), midpoints.select("ord", "lat", "lon"), metres, "edge", "ord")
    return best.join(midpoints.drop("lat", "lon"), "ord").select("edge.a", "edge.b", "lev_diff", "width_code", "vtcl_slope", "roof")


def grid(lat: float, metres: float) -> tuple[float, float]:
    """Degrees of a reach cell of so many metres at a latitude."""
    return metres / geo.DEGREE_M, metres / (geo.DEGREE_M * math.cos(math.radians(lat)))


def reach_cells(reached: DataFrame, lat: float, lon: float, metres: float) -> DataFrame:
    """Distinct cells (y, x) of reached nodes (lat, lon) and of the start."""
    size_y, size_x = grid(lat, metres)
    home = reached.sparkSession.range(1).select(F.lit(float(lat)).alias("lat"), F.lit(float(lon)).alias("lon"))
    both = reached.select("lat", "lon").union(home)
    return both.select(geo.cell(F.col("lat"), size_y).alias("y"), geo.cell(F.col("lon"), size_x).alias("x")).distinct()


def filled(cells: DataFrame, key: str = "mode") -> DataFrame:
    """Cells (key, y, x) of each reach and the empty ones they enclose, by a flood from outside.

    A reach is bounded by its time limit (at most some hundred cells a side), so each is one group.
    """

    def fill(group: pd.DataFrame) -> pd.DataFrame:
        y0, x0 = group["y"].min() - 1, group["x"].min() - 1
        shape = (int(group["y"].max() - y0 + 2), int(group["x"].max() - x0 + 2))
        own = np.zeros(shape, bool)
        own[(group["y"] - y0).to_numpy(), (group["x"] - x0).to_numpy()] = True
        outside = np.zeros(shape, bool)
        outside[0, 0] = True
        while True:
            grown = outside.copy()
            grown[1:] |= outside[:-1]
            grown[:-1] |= outside[1:]
            grown[:, 1:] |= outside[:, :-1]
            grown[:, :-1] |= outside[:, 1:]
            grown &= ~own
            if (grown == outside).all():
                break
            outside = grown
        ys, xs = np.nonzero(~outside)
        return pd.DataFrame({key: group[key].iloc[0], "y": ys + y0, "x": xs + x0})

    return cells.groupBy(key).applyInPandas(fill, f"{key} {dict(cells.dtypes)[key]}, y long, x long")


def overlap_zones(cells: DataFrame, metres: float) -> DataFrame:
    """(modes, cells, area_km2): the cells by the set of modes that reach them."""
    sets = cells.groupBy("y", "x").agg(F.array_join(F.sort_array(F.collect_set("mode")), "+").alias("modes"))
    return sets.groupBy("modes").agg(F.count("*").alias("cells")).withColumn("area_km2", F.col("cells") * F.lit((metres / 1000.0) ** 2))


def interior_seconds(kind: Column, length: Column) -> Column:
    """Seconds of a passage inside a station by its kind: 2 stairs, 4 escalator, 5 elevator."""
    metres = F.coalesce(length, F.lit(0.0))
    return F.when(kind == 5, F.lit(70.0)).when(kind == 4, metres / 50 * 60 + 15).when(kind == 2, metres / 70 * 60 + 45).otherwise(metres / 70 * 60 + 5)
