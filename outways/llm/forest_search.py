"""Approximate nearest neighbours with a forest of random-projection trees.

Each tree splits space by hyperplanes between the centres of two random halves of what it sees; it is
fitted on a bounded sample of vectors, and every vector is then sent down every tree. A query
walks all trees with one shared priority queue: the branch whose hyperplane lies nearest is
opened next, until the leaves opened hold ``share`` times as many entries as there are vectors
(an entry is a vector in one tree). All vectors in an opened leaf are candidates, and are ranked
by their exact distance.

The trees are the only thing on the driver: ``trees * 2**depth`` hyperplanes, at most
``2**MAX_DEPTH`` per tree. Vectors are dealt once, to chunks of bounded size with the numbers of their
leaves; a query goes to each chunk with a bitmap of the leaves it opened, and meets there the
vectors in these; distances to these alone are computed. Chunks are dealt by hash, so a leaf that a common vector fills is no hot group; each
hands on the best ``k`` of each query only.

Vectors that are null, zero, of another length than most, or hold null or non-finite components
take no part. Repeated ids are one candidate, with their nearest vector. Ties go to the smaller
id. With no query or no candidate the result is empty.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from outways.llm.store import written

TREES = 8
SAMPLE_ROWS = 16_384
MAX_DEPTH = 11
LEAF_ROWS = 512
#: Entries opened, as a multiple of the vectors; the trees overlap, so 1.0 opens some 6 in 10 vectors.
SHARE = 1.0
CHUNK_ROWS, CHUNK_QUERIES, BATCH_QUERIES = 16_384, 16_384, 64


def hyperplanes(sample: np.ndarray, depth: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """(normals, offsets) of one tree's inner nodes, node k's children at 2k+1 and 2k+2."""
    dim = sample.shape[1]
    normals, offsets = np.zeros((2**depth - 1, dim)), np.zeros(2**depth - 1)

    def split(node: int, rows: np.ndarray, level: int) -> None:
        if level == depth:
            return
        normal, offset = None, 0.0
        if len(rows) >= 4:
            seen = sample[rng.choice(rows, min(len(rows), 256), replace=False)]
            a, b = seen[0], seen[1]
            for _ in range(8):
                left = ((seen - a) ** 2).sum(1) <= ((seen - b) ** 2).sum(1)
                if left.all() or not left.any():
                    break
                a, b = seen[left].mean(0), seen[~left].mean(0)
            if (a != b).any():
                normal = (a - b) / np.linalg.norm(a - b)
                offset = normal @ (a + b) / 2
        if normal is None:
            normal = rng.standard_normal(dim)
            normal /= np.linalg.norm(normal)
        along = sample[rows] @ normal
        if len(rows) and not 0.05 <= (along > offset).mean() <= 0.95:
            offset = float(np.median(along))
        normals[node], offsets[node] = normal, offset
        split(2 * node + 1, rows[along <= offset], level + 1)
        split(2 * node + 2, rows[along > offset], level + 1)

    split(0, np.arange(len(sample)), 0)
    return normals, offsets


def leaf_of(vectors: np.ndarray, normals: np.ndarray, offsets: np.ndarray, depth: int) -> np.ndarray:
    node = np.zeros(len(vectors), "i8")
    for _ in range(depth):
        node = 2 * node + 1 + (np.einsum("ij,ij->i", vectors, normals[node]) > offsets[node])
    return node - (2**depth - 1)


def opened(query: np.ndarray, trees: list, depth: int, sizes: np.ndarray, budget: float) -> list[tuple[int, int]]:
    """(tree, leaf) in the order of the shared queue, until the leaves hold ``budget`` entries."""
    margins = [normals @ query - offsets for normals, offsets in trees]
    queue = [(0.0, t, 0) for t in range(len(trees))]
    found, held, inner = [], 0, 2**depth - 1
    while queue and held < budget:
        far, t, node = heapq.heappop(queue)
        if node >= inner:
            found.append((t, node - inner))
            held += sizes[t, node - inner]
            continue
        margin = margins[t][node]
        near, other = (2 * node + 2, 2 * node + 1) if margin > 0 else (2 * node + 1, 2 * node + 2)
        heapq.heappush(queue, (far, t, near))
        heapq.heappush(queue, (max(far, abs(margin)), t, other))
    return found


def distances(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    return np.sqrt(((vectors - query) ** 2).sum(1))


def nearest(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int, met: np.ndarray) -> list[tuple[int, int, float]]:
    """The k nearest vectors of each query but its own, ties to the smaller id, of those that it ``met`` (queries by
    vectors). No distance to another vector is computed."""
    found = []
    for i, query_id in enumerate(query_ids):
        rows = np.flatnonzero(met[i] & (ids != query_id))
        exact = distances(queries[i], vectors[rows])
        if len(rows) > k:
            near = np.flatnonzero(exact <= np.partition(exact, k - 1)[k - 1])
            rows, exact = rows[near], exact[near]
        order = np.lexsort((ids[rows], exact))[:k]
        found += [(int(query_id), int(ids[rows[j]]), float(exact[j])) for j in order]
    return found


def meetings(bits: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Which vectors each query meets: those in a leaf that it opened. bits: queries by leaves; held: vectors by trees."""
    met = np.zeros((len(bits), len(held)), bool)
    for leaves in held.T:
        met |= bits[:, leaves]
    return met


def usable(vectors: DataFrame, column: str) -> DataFrame:
    """(vec_id, v array<double>): the vectors that take part."""
    v = F.col(column).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    kept = vectors.filter(F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    lengths = kept.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return kept.filter(F.size("v") == (lengths[0]["n"] if lengths else 0))


def searched(
    vectors: DataFrame, queries: DataFrame, k: int = 10, column: str = "embedding", trees: int = TREES, share: float = SHARE,
    sample_rows: int = SAMPLE_ROWS, leaf_rows: int = LEAF_ROWS, seed: int = 11,
) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found for each row of ``queries``, a part of
    ``vectors``' rows, nearest first."""
    spark = vectors.sparkSession
    rows = usable(vectors, column)
    asked = usable(queries, column)
    total = rows.count()
    result = "query_id long, rank int, vec_id long, score double"
    if not total:
        return spark.createDataFrame([], result)
    sample = np.array([r["v"] for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).collect()])
    leaf_rows = max(32, min(leaf_rows, total // 64))
    depth = max(0, min(MAX_DEPTH, int(np.log2(max(1, total / leaf_rows))), int(np.log2(max(1, len(sample) / 8)))))
    rng = np.random.default_rng(seed)
    forest = [hyperplanes(sample, depth, rng) for _ in range(trees)]

    width = 2**depth

    def leaves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                v = np.stack(batch["v"].to_numpy())
                held = np.stack([leaf_of(v, normals, offsets, depth) for normals, offsets in forest], axis=1)
                yield batch.assign(leaves=list(held.astype("i4")))

    placed = written(rows.mapInPandas(leaves, "vec_id long, v array<double>, leaves array<int>"), "forest-leaves")
    sizes = np.zeros((trees, width), "i8")
    # trees * 2**depth rows at most.
    for r in placed.select(F.posexplode("leaves").alias("tree", "leaf")).groupBy("tree", "leaf").count().collect():
        sizes[r["tree"], r["leaf"]] = r["count"]

    def visits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            maps = []
            for v in batch["v"]:
                bits = np.zeros(trees * width, bool)
                bits[[t * width + leaf for t, leaf in opened(np.asarray(v), forest, depth, sizes, share * total)]] = True
                maps.append(np.packbits(bits).tobytes())
            yield pd.DataFrame({"query_id": batch["vec_id"], "q": batch["v"], "bits": maps})

    asking = written(asked.mapInPandas(visits, "query_id long, q array<double>, bits binary"), "forest-queries")
    chunks, blocks = -(-total // CHUNK_ROWS), max(1, -(-asking.count() // CHUNK_QUERIES))
    every = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    left = placed.select("vec_id", "v", "leaves", F.pmod(F.xxhash64("vec_id"), F.lit(chunks)).alias("chunk"), every(blocks, "block"))
    right = asking.select("query_id", "q", "bits", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block"), every(chunks, "chunk")).withColumn("chunk", F.col("chunk").cast("long"))
    keys = ["chunk", "block"]

    def best(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(rows) and len(queries):
            v, ids = np.stack(rows["v"].to_numpy()), rows["vec_id"].to_numpy()
            held = np.stack(rows["leaves"].to_numpy()).astype("i8") + np.arange(trees) * width
            q, query_ids = np.stack(queries["q"].to_numpy()), queries["query_id"].to_numpy()
            bits = np.unpackbits(np.stack([np.frombuffer(b, "u1") for b in queries["bits"]]), axis=1)[:, : trees * width].astype(bool)
            for at in range(0, len(q), BATCH_QUERIES):
                part = slice(at, at + BATCH_QUERIES)
                found += nearest(q[part], query_ids[part], v, ids, k, meetings(bits[part], held))
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"]).astype({"query_id": "i8", "vec_id": "i8", "score": "f8"})

    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(best, "query_id long, vec_id long, score double")
    ranked = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return ranked.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
