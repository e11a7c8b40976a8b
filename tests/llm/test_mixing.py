"""Pfair mixing against the fluid ideal, simulated in fractions slot by slot."""

from __future__ import annotations

import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F
from test_small_tables import docs

from outways.llm import pfair_mix


def ideal(blocks, weights):
    """After each slot: what every source has had in the fluid schedule."""
    had = {s: Fraction(0) for s in blocks}
    for _ in range(sum(blocks.values())):
        left = Fraction(1)
        while left:
            alive = [s for s in blocks if had[s] < blocks[s]]
            total = sum(weights[s] for s in alive)
            step = min([left, *[(blocks[s] - had[s]) * total / weights[s] for s in alive]])
            for s in alive:
                had[s] += step * weights[s] / total
            left -= step
        yield dict(had)


CASES = [
    ({"a": 4}, {"a": 0.3}),
    ({"a": 200, "b": 3, "c": 90}, {"a": 0.9996, "b": 0.0004, "c": 0.0001}),
    ({"a": 100, "b": 100, "c": 100}, {"a": 1 / 3, "b": 1 / 3, "c": 1 / 3}),
    *[({str(i): random.Random(k * 31 + i).randrange(1, 50) for i in range(k)}, {str(i): random.Random(k * 7 + i).random() + 1e-4 for i in range(k)}) for k in range(2, 9)],
]


@pytest.mark.parametrize(("blocks", "weights"), CASES)
def test_every_slot_of_every_phase_deviates_by_less_than_a_block(blocks, weights):
    whole = pfair_mix.whole_weights(weights)
    had = dict.fromkeys(blocks, 0)
    for (source, block, release, deadline, slot), aim in zip(pfair_mix.pfair(blocks, whole), ideal(blocks, whole), strict=True):
        assert block == had[source] and release <= slot < deadline
        had[source] += 1
        assert all(abs(had[s] - aim[s]) < 1 for s in blocks)
    assert had == blocks


def test_tiny_targets_keep_their_share_over_a_long_stream():
    blocks, had = {"a": 60_000, "b": 40}, {"a": 0, "b": 0}
    for source, _, _, _, slot in pfair_mix.pfair(blocks, pfair_mix.whole_weights({"a": 0.9996, "b": 0.0004})):
        had[source] += 1
        if slot < 60_000:
            assert abs(had["b"] - (slot + 1) * 0.0004) < 1 + 1e-6


@pytest.mark.parametrize("weight", [0.0, -1.0, float("nan"), float("inf"), None])
def test_weights_that_are_no_targets(weight):
    with pytest.raises(ValueError, match="weights"):
        pfair_mix.whole_weights({"a": weight})


@pytest.mark.parametrize("max_blocks", [1 << 20, 7])
def test_schedule_keeps_every_row(spark, max_blocks):
    rnd = random.Random(4)
    frame = docs(spark, *["x" * rnd.randrange(1, 40) for _ in range(300)], None, "", (5, "dup"), (5, "dup"), (None, "no id"), sources=["big", "big", None])
    rows = pfair_mix.schedule(frame, block_chars=100, max_blocks=max_blocks).collect()
    assert len(rows) == 305
    slots: dict = {}
    for r in rows:
        assert slots.setdefault((r["source"], r["block"]), r["slot"]) == r["slot"] and r["release"] <= r["slot"] < r["deadline"]
    assert len(set(slots.values())) == len(slots)
    assert pfair_mix.schedule(frame.limit(0)).count() == 0


def test_places_in_a_stream_are_gapless_over_all_groups(spark, monkeypatch):
    monkeypatch.setattr(pfair_mix, "GROUP_ROWS", 3)
    monkeypatch.setattr(pfair_mix, "GROUPS_OF_GROUPS", 4)
    frame = docs(spark, *["y" * (1 + i % 5) for i in range(200)], sources=["s", "s", "t"])
    ends: dict = {}
    for r in sorted(pfair_mix.streams(frame).collect(), key=lambda r: (r["source"], r["at"])):
        assert r["at"] == ends.get(r["source"], 0)
        ends[r["source"]] = r["at"] + r["n"]


def test_more_sources_than_a_thousand(spark):
    frame = docs(spark, *["z"] * 3_000).withColumn("source", F.col("doc_id").cast("string"))
    assert pfair_mix.schedule(frame, block_chars=1).select("slot").distinct().count() == 3_000
