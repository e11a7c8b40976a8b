"""Hard negatives from an R-tree packed by sort-tile-recursive, searched best-first by inner product.

Rows are dealt to shards by ranges of (length of the vector, label, first coordinate, id): the first slabs of
the tiling, which Spark sorts out and which split a label or a vector that a third of all rows share.
A task packs its shard further: a subtree for each label, in it slabs along the coordinates by falling variance,
leaves of ``LEAF`` rows, and ``FAN`` boxes under each inner one. A box bounds the inner product with an anchor
from both sides, coordinate by coordinate. Boxes are opened from the highest upper bound on; one is left closed
if its interval misses the window of scores, if it holds no wanted label, or if its upper bound lies strictly
below the k-th score so far (an equal one may hold a smaller id).

Two rounds of the same search: the first finds each anchor's positives, the second the negatives of all windows
that these give. Only an anchor's vector goes to the shards whose outer box it can't rule out, in blocks
of ``ANCHORS``; each shard hands on its best ``k`` for each window, and these are merged. On the driver there are
the shards' outer boxes, at most ``SHARDS`` of them.

Scores are exact: products are taken in doubles where no sum can reach 2^53, else in 64-bit integers.

Cases: rows with a null id, label or vector, or a null or non-finite component take no part, nor do
those with a component of 2^20 or more, whose products may not fit 64 bits. Vectors of different lengths have
no inner product: each length is searched by itself. Of rows that share an id the one with the smallest
label, then the smallest vector, counts. Ties go to the smaller id. An anchor without another row of its label has
no positive and no result, and so has a positive with a negative score, whose window is empty. An empty table gives an
empty result. Other columns are passed over, whatever their names.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from outways.llm.store import written

LEAF, FAN = 32, 8
SHARD_ROWS, SHARDS = 8_192, 16_384
#: Anchors that meet a shard in one task, and that have their bounds taken at a time.
ANCHORS, BATCH = 16_384, 256
POSITIVES, NEGATIVES = 5, 10
#: The window of a negative's score, in percent of the positive's.
LOW, HIGH = 30, 90
LARGEST = 1 << 28


class BoxTree:
    """An R-tree over the rows of a shard: ``lo``, ``hi`` and label ranges per node, leaves first."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        axes = np.argsort(-vectors.astype("f8").var(axis=0), kind="stable") if len(vectors) else np.zeros(0, "i8")
        order, starts = [], []
        for label in np.unique(labels):
            for leaf in self._tiled(vectors, np.flatnonzero(labels == label), axes):
                starts.append(len(order))
                order.extend(leaf)
        order = np.array(order, "i8")
        self.ids, self.labels, self.vectors = ids[order], labels[order], vectors[order]
        self.starts, self.ends = np.array(starts, "i8"), np.array([*starts[1:], len(order)], "i8")
        lo, hi = np.minimum.reduceat(self.vectors, starts), np.maximum.reduceat(self.vectors, starts)
        low, high = np.minimum.reduceat(self.labels, starts), np.maximum.reduceat(self.labels, starts)
        boxes, self.children, base = [(lo, hi, low, high)], [None] * len(starts), 0
        while len(lo) > 1:
            cuts = np.arange(0, len(lo), FAN)
            self.children += [range(base + a, base + min(a + FAN, len(lo))) for a in cuts]
            base += len(lo)
            lo, hi = np.minimum.reduceat(lo, cuts), np.maximum.reduceat(hi, cuts)
            low, high = np.minimum.reduceat(low, cuts), np.maximum.reduceat(high, cuts)
            boxes.append((lo, hi, low, high))
        self.lo, self.hi, self.low, self.high = (np.concatenate(x) for x in zip(*boxes, strict=True))
        self.opened = 0

    @staticmethod
    def _tiled(vectors: np.ndarray, rows: np.ndarray, axes: np.ndarray) -> list[np.ndarray]:
        """Leaves of at most ``LEAF`` rows: halves along one axis after another, at a whole number of leaves."""
        leaves = -(-len(rows) // LEAF)
        if leaves <= 1 or not len(axes):
            return [rows[a : a + LEAF] for a in range(0, len(rows), LEAF)]
        rows = rows[np.argsort(vectors[rows, axes[0]], kind="stable")]
        half = leaves // 2 * LEAF
        return [*BoxTree._tiled(vectors, rows[:half], axes[1:]), *BoxTree._tiled(vectors, rows[half:], axes[1:])]

    def bounds(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(lower, upper) of every inner product of each anchor (rows) with what each node (columns) holds."""
        return intervals(anchors, self.lo, self.hi)

    def search(self, anchor: np.ndarray, own: int, label: int, same: bool, windows: list[tuple[int, int]], k: int, lower: np.ndarray, upper: np.ndarray) -> list[list[tuple[int, int]]]:
        """For each window of scores the ``k`` best (score, id), of the label or of other labels, but the row ``own``."""
        held: list[list[tuple[int, int]]] = [[] for _ in windows]
        least = [low for low, _ in windows]
        root = len(self.lo) - 1
        queue = [(-upper[root], root)]

        def closed(node: int) -> bool:
            if not self.low[node] <= label <= self.high[node] if same else self.low[node] == self.high[node] == label:
                return True
            return all(upper[node] < least[w] or lower[node] > windows[w][1] for w in range(len(windows)))

        while queue and -queue[0][0] >= min(least):
            _, node = heapq.heappop(queue)
            if closed(node):
                continue
            if self.children[node] is not None:
                for child in self.children[node]:
                    if not closed(child):
                        heapq.heappush(queue, (-upper[child], child))
                continue
            self.opened += 1
            rows = slice(self.starts[node], self.ends[node])
            scores = self.vectors[rows] @ anchor
            fits = ((self.labels[rows] == label) == same) & (self.ids[rows] != own)
            for w, (_, most) in enumerate(windows):
                for i in np.flatnonzero(fits & (scores >= least[w]) & (scores <= most)):
                    found = int(scores[i]), -int(self.ids[rows][i])
                    if len(held[w]) < k:
                        heapq.heappush(held[w], found)
                    elif found > held[w][0]:
                        heapq.heapreplace(held[w], found)
                if len(held[w]) == k:
                    least[w] = max(least[w], held[w][0][0])
        return [[(score, -i) for score, i in sorted(found, reverse=True)] for found in held]


def intervals(anchors: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.maximum(anchors, 0), np.minimum(anchors, 0)
    return up @ lo.T + down @ hi.T, up @ hi.T + down @ lo.T


def _exact(*parts: np.ndarray) -> type:
    """Doubles where no partial sum of products can reach 2^53, else 64-bit integers."""
    most = max((int(np.abs(p).max(initial=0)) for p in parts), default=0)
    return np.float64 if 2 * max((p.shape[-1] for p in parts), default=0) * most * most < 1 << 53 else np.int64


def whole_vectors(rows: DataFrame, column: str = "embedding") -> DataFrame:
    """(vec_id, label, v array<long>, dim): the rows that take part, components as floor(256 x)."""
    x = F.col(column).cast("array<double>")
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float(LARGEST >> 8))))
    kept = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(fine, F.lit(False)))
    v = F.transform(x, lambda c: F.floor(c * 256).cast("long"))
    vec_id, label = F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long")
    label = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    one = kept.select(vec_id, F.struct(label.alias("label"), v.alias("v")).alias("row")).groupBy("vec_id").agg(F.min("row").alias("row"))
    return one.select("vec_id", "row.label", "row.v", F.size("row.v").alias("dim"))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, "i8") for v in column])


def _boxes(shards: DataFrame) -> pd.DataFrame:
    """The outer box of each shard; as many rows as shards."""

    def box(group: pd.DataFrame) -> pd.DataFrame:
        v = _matrix(group["v"])
        return pd.DataFrame({"shard": group["shard"].iloc[:1], "dim": group["dim"].iloc[:1], "lo": [v.min(0)], "hi": [v.max(0)], "low": [group["label"].min()], "high": [group["label"].max()]})

    return shards.groupBy("shard", "dim").applyInPandas(box, "shard int, dim int, lo array<long>, hi array<long>, low long, high long").toPandas()


def _routed(anchors: DataFrame, boxes: pd.DataFrame, same: bool) -> DataFrame:
    """Each anchor with every shard that its windows and labels can't rule out; ``windows`` has their ends one after another."""

    def route(batches):
        by_dim = {dim: (b["shard"].to_numpy(), _matrix(b["lo"]), _matrix(b["hi"]), b["low"].to_numpy(), b["high"].to_numpy()) for dim, b in boxes.groupby("dim")}
        for batch in batches:
            out = []
            for dim, part in batch.groupby("dim"):
                shards, lo, hi, low, high = by_dim[dim]
                a = _matrix(part["v"])
                kind = _exact(a, lo, hi)
                lower, upper = intervals(a.astype(kind), lo.astype(kind), hi.astype(kind))
                for i, (label, windows) in enumerate(zip(part["label"], part["windows"], strict=True)):
                    meets = (low <= label) & (label <= high) if same else (low != label) | (high != label)
                    inside = np.zeros(len(shards), bool)
                    for least, most in np.asarray(windows).reshape(-1, 2):
                        inside |= (upper[i] >= least) & (lower[i] <= most)
                    to = shards[meets & inside]
                    out.append(part.iloc[[i] * len(to)].assign(shard=to))
            if out:
                yield pd.concat(out)[["vec_id", "label", "v", "dim", "windows", "block", "shard"]]

    return anchors.mapInPandas(route, "vec_id long, label long, v array<long>, dim int, windows array<long>, block int, shard int")


FOUND = "anchor_id long, least long, most long, vec_id long, score long"


def _searched(shards: DataFrame, boxes: pd.DataFrame, anchors: DataFrame, blocks: int, same: bool, k: int) -> DataFrame:
    """(anchor_id, least, most, vec_id, score): the best ``k`` of each shard for each window of each anchor."""

    def search(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows) and len(asked):
            rows = rows.sort_values("vec_id", kind="stable")
            v, a = _matrix(rows["v"]), _matrix(asked["v"])
            kind = _exact(v, a)
            tree = BoxTree(rows["vec_id"].to_numpy(), rows["label"].to_numpy(), v.astype(kind))
            for at in range(0, len(a), BATCH):
                part, some = asked.iloc[at : at + BATCH], a[at : at + BATCH].astype(kind)
                lower, upper = tree.bounds(some)
                for i, row in enumerate(part.itertuples()):
                    windows = [tuple(map(int, w)) for w in np.asarray(row.windows).reshape(-1, 2)]
                    for (least, most), found in zip(windows, tree.search(some[i], row.vec_id, row.label, same, windows, k, lower[i], upper[i]), strict=True):
                        out += [(row.vec_id, least, most, i_, s) for s, i_ in found]
        return pd.DataFrame(out, columns=["anchor_id", "least", "most", "vec_id", "score"]).astype("i8")

    asked = _routed(anchors, boxes, same)
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
    keys = ["shard", "dim", "block"]
    return shards.select("*", every).groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(search, FOUND)


def _first(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def mined(rows: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, column: str = "embedding") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each anchor and each of its best
    ``positives`` rows of the same label, the best ``negatives`` rows of other labels within the window."""
    spark = rows.sparkSession
    kept = written(whole_vectors(rows, column), "vectors")
    total = kept.count()
    result = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not total:
        return spark.createDataFrame([], result)
    n_shards = max(1, min(SHARDS, -(-total // SHARD_ROWS)))
    dealt = kept.repartitionByRange(n_shards, "dim", "label", F.get("v", F.lit(0)), "vec_id").withColumn("shard", F.spark_partition_id())
    shards = written(dealt, "shards")
    boxes = _boxes(shards)
    anchors = kept.filter(is_anchor)
    blocks = max(1, -(-anchors.count() // ANCHORS))
    anchors = anchors.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
    # Scores stay within 63 bits, so this window holds all.
    everything = F.array(F.lit(-(1 << 62)), F.lit(1 << 62))
    near = _first(_searched(shards, boxes, anchors.withColumn("windows", everything), blocks, True, positives), ["anchor_id"], positives)
    # Integer ends of the window: the least not under, the most not over.
    least, most = F.expr(f"-((-{LOW} * score - pmod(-{LOW} * score, 100)) div 100)"), F.expr(f"({HIGH} * score - pmod({HIGH} * score, 100)) div 100")
    paired = near.select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), least.alias("least"), most.alias("most")).filter("least <= most")
    paired = written(paired, "positives")
    windows = paired.groupBy("anchor_id").agg(F.flatten(F.sort_array(F.collect_set(F.array("least", "most")))).alias("windows"))
    asking = anchors.join(windows, anchors["vec_id"] == windows["anchor_id"]).drop("anchor_id")
    far = _first(_searched(shards, boxes, asking, blocks, False, negatives), ["anchor_id", "least", "most"], negatives)
    return paired.join(far, ["anchor_id", "least", "most"]).select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
