"""Negatives from the R-tree against every product taken one by one."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from outways.llm import box_tree
from outways.llm.box_tree import BoxTree


def brute_force(rows, every, positives=5, negatives=10):
    """The rule as it is stated, over (vec_id, vector, label)."""
    kept = {}
    for vec_id, x, label in rows:
        if vec_id is None or label is None or x is None or any(c is None or not math.isfinite(c) or abs(c) >= 2**20 for c in x):
            continue
        row = ((label + 1) % 10 if vec_id % 7 == 0 else label, [math.floor(256 * c) for c in x])
        kept[vec_id] = min(kept.get(vec_id, row), row)
    out = []
    for a, (label, v) in kept.items():
        if a % every:
            continue
        scored = sorted((-sum(p * q for p, q in zip(v, w, strict=True)), b, other) for b, (other, w) in kept.items() if b != a and len(w) == len(v))
        for s, b, _ in [x for x in scored if x[2] == label][:positives]:
            inside = [(n, c) for n, c, other in scored if other != label and 30 * -s <= 100 * -n <= 90 * -s]
            out += [(a, b, r, c, -s, -n) for r, (n, c) in enumerate(inside[:negatives], 1)]
    return sorted(out)


def clustered(n, dim, seed, spread=0.02):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(40, dim))
    return (centres[rng.integers(0, 40, n)] + spread * rng.normal(size=(n, dim))) * 256


def test_boxes_far_off_stay_closed():
    v = np.floor(clustered(6000, 8, 1)).astype("f8")
    labels = np.arange(6000) % 5
    tree = BoxTree(np.arange(6000), labels, v)
    lower, upper = tree.bounds(v[:50])
    for a in range(50):
        scores = v @ v[a]
        for same in (True, False):
            fits = np.flatnonzero((labels == labels[a]) == same)
            fits = fits[fits != a]
            window = (int(scores.max() * 0.3), int(scores.max() * 0.9))
            got = tree.search(v[a], a, labels[a], same, [(-(1 << 62), 1 << 62), window], 10, lower[a], upper[a])
            for (least, most), found in zip([(-(1 << 62), 1 << 62), window], got, strict=True):
                inside = fits[(scores[fits] >= least) & (scores[fits] <= most)]
                order = inside[np.lexsort((inside, -scores[inside]))][:10]
                assert found == [(int(scores[i]), int(i)) for i in order]
    # 100 searches of two windows each: a quarter of all leaves would be 25 times their number.
    assert tree.opened < 100 * len(tree.starts) / 4, (tree.opened, len(tree.starts))


def test_every_box_holds_what_lies_under_it():
    rng = np.random.default_rng(2)
    v = rng.integers(-50, 50, (500, 5))
    tree = BoxTree(np.arange(500), rng.integers(0, 3, 500), v)
    anchors = rng.integers(-50, 50, (20, 5))
    lower, upper = tree.bounds(anchors)

    def under(node):
        return range(tree.starts[node], tree.ends[node]) if tree.children[node] is None else [r for c in tree.children[node] for r in under(c)]

    assert sorted(under(len(tree.lo) - 1)) == list(range(500))
    for node in range(len(tree.lo)):
        rows = list(under(node))
        products = anchors @ tree.vectors[rows].T
        assert (products.min(1) >= lower[:, node]).all() and (products.max(1) <= upper[:, node]).all()
        assert tree.low[node] == tree.labels[rows].min() and tree.high[node] == tree.labels[rows].max()


SCHEMA = "vec_id long, embedding array<double>, label int, v string, shard int, dim string"


@pytest.mark.parametrize("shard_rows", [40, 100_000])
def test_mined_on_odd_rows(spark, monkeypatch, shard_rows):
    monkeypatch.setattr(box_tree, "SHARD_ROWS", shard_rows)
    rng = np.random.default_rng(3)
    rows = [(int(i), rng.integers(-3, 4, 4).tolist(), int(rng.integers(0, 4))) for i in rng.permutation(240)]
    rows += [(1000 + i, [1.0, 2.0, 0.0, -1.0], 2) for i in range(60)]
    rows += [(0, [9.0, 9.0, 9.0, 9.0], 9), (10, [1.0, 1.0, 1.0, 1.0], 0), (2000, None, 1), (2010, [1.0, None, 1.0, 0.0], 1), (2020, [float("nan")] * 4, 1), (2030, [float("inf"), 0.0, 0.0, 0.0], 1)]
    rows += [(2040, [1.0, 1.0, 1.0, 1.0], None), (None, [1.0, 1.0, 1.0, 1.0], 1), (2050, [0.0] * 4, 1), (2060, [1.0, 2.0], 1), (2061, [2.0, 2.0], 1), (2062, [1.0, 1.0], 2), (2070, [], 1), (2080, [2.0**20, 0.0, 0.0, 0.0], 1)]
    rows += [(2090, [900_000.0, -900_000.0, 3.5, 0.0], 3), (2091, [800_000.0, -800_000.0, 1.0, 0.0], 3), (2092, [500_000.0, -500_000.0, 7.0, 0.0], 1)]
    table = spark.createDataFrame([(a, None if b is None else [None if c is None else float(c) for c in b], c, "x", 5, "y") for a, b, c in rows], SCHEMA)
    got = box_tree.mined(table, F.col("vec_id") % 10 == 0)
    assert sorted(map(tuple, got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())) == brute_force(rows, 10)
    assert box_tree.mined(table.limit(0), F.col("vec_id") % 10 == 0).count() == 0
    assert box_tree.mined(table, F.lit(False)).count() == 0
