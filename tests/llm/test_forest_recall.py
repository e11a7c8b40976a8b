"""Recall of the forest search on the given vectors, against all distances."""

from __future__ import annotations

import numpy as np
import pytest

from outways.llm import forest_search

TABLES = "/root/testdata"


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_on_the_given_vectors(spark, sf):
    vectors = spark.read.parquet(f"{TABLES}/{sf}/embeddings.parquet")
    got: dict = {}
    for r in forest_search.searched(vectors, vectors.filter("vec_id % 100 = 0")).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    rows = [(r["vec_id"], r["embedding"]) for r in vectors.collect()]
    rows = [(i, np.array(v, "f8")) for i, v in rows if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    ids, held = np.array([i for i, _ in rows]), np.stack([v for _, v in rows])
    hits = total = 0
    for i, v in rows:
        if i % 100 == 0:
            d = np.sqrt(((held - v) ** 2).sum(1))
            d[ids == i] = np.inf
            order = np.lexsort((ids, d))[:10]
            found = got[i]
            assert len(found) == 10 and all(abs(s - d[np.flatnonzero(ids == j)[0]]) < 1e-9 for j, s in found)
            hits, total = hits + len({j for j, _ in found} & set(ids[order].tolist())), total + 10
    assert hits / total >= 0.9


@pytest.mark.parametrize(("spread", "share", "most"), [(0.02, 0.25, 0.35), (None, 1.0, 0.75)])
def test_only_vectors_in_opened_leaves_are_measured(monkeypatch, spread, share, most):
    rng = np.random.default_rng(5)
    dim, n, trees, depth = 16, 3000, 6, 5
    v = rng.standard_normal((n, dim)) if spread is None else rng.standard_normal((40, dim))[rng.integers(40, size=n)] + spread * rng.standard_normal((n, dim))
    forest = [forest_search.hyperplanes(v[:1000], depth, rng) for _ in range(trees)]
    held = np.stack([forest_search.leaf_of(v, *tree, depth) for tree in forest], axis=1)
    sizes = np.stack([np.bincount(leaves, minlength=2**depth) for leaves in held.T])
    at = held + np.arange(trees) * 2**depth
    ids, measured, right = np.arange(n), [], 0
    plain = forest_search.distances
    monkeypatch.setattr(forest_search, "distances", lambda q, rows: measured.append(len(rows)) or plain(q, rows))
    for i in range(0, n, 100):
        bits = np.zeros((1, trees * 2**depth), bool)
        opened = forest_search.opened(v[i], forest, depth, sizes, share * n)
        bits[0, [t * 2**depth + leaf for t, leaf in opened]] = True
        got = forest_search.nearest(v[i : i + 1], ids[i : i + 1], v, ids, 10, forest_search.meetings(bits, at))
        inside = {j for t, leaf in opened for j in np.flatnonzero(held[:, t] == leaf)} - {i}
        assert measured[-1] == len(inside)
        d = plain(v[i], v)
        assert [j for _, j, _ in got] == sorted(inside, key=lambda j: (d[j], j))[:10]
        d[i] = np.inf
        right += len({j for _, j, _ in got} & set(np.lexsort((ids, d))[:10].tolist()))
    assert sum(measured) <= most * n * len(measured) and right >= 0.9 * 10 * len(measured)
