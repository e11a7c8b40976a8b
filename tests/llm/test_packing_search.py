"""Packing: exchanges between standing bins, order, and token ids over a whole table."""

from __future__ import annotations

import random
import zlib
from itertools import combinations

import numpy as np
import pytest
from test_small_tables import docs

from outways.llm import packing

TABLE = "/root/testdata/sf0.001/documents.parquet"


def test_pairs_by_length_equal_all_pairs():
    rnd = random.Random(3)
    for _ in range(200):
        stock, lengths = packing.Lengths(50), [rnd.randrange(1, 50) for _ in range(rnd.randrange(0, 8))]
        for i, n in enumerate(lengths):
            stock.add(n, i)
        low, high = sorted((rnd.randrange(1, 100), rnd.randrange(1, 100)))
        sums = [a + b for a, b in combinations(lengths, 2) if low <= a + b <= high]
        found = stock.pair(low, high)
        assert (sum(found) if found else None) == max(sums, default=None)


@pytest.mark.parametrize(("low", "high"), [(400, 900), (300, 1000), (600, 1100)])
def test_search_saves_bins_on_lengths_that_fit_badly(low, high):
    rnd = random.Random(low)
    lengths = [rnd.randint(low, high) for _ in range(1_500)]
    first = packing.best_fit(lengths, 2048)
    better = packing.improved(first, lengths, 2048)
    energy = lambda bins: sum(sum(lengths[i] for i in b) ** 2 for b in bins)
    assert sorted(i for b in better for i in b) == list(range(len(lengths)))
    assert len(better) < len(first) and energy(better) > energy(first)


def test_every_exchange_raises_the_sum_of_squares(monkeypatch):
    seen, plain = [], packing._best_exchange

    def watched(own, room, stock, home, fill, lengths):
        seen.append(sum(f * f for f in fill))
        found = plain(own, room, stock, home, fill, lengths)
        if found is None:
            seen.append(None)
        return found

    monkeypatch.setattr(packing, "_best_exchange", watched)
    rnd = random.Random(9)
    for _ in range(60):
        low = rnd.randrange(10, 900)
        lengths = [rnd.randint(low, rnd.randint(low + 1, 2047)) for _ in range(rnd.randrange(2, 160))]
        seen.clear()
        bins = packing.improved(packing.best_fit(lengths, 2048), lengths, 2048)
        assert sorted(i for b in bins for i in b) == list(range(len(lengths))) and all(sum(lengths[i] for i in b) <= 2048 for b in bins)
        # Between two looks at the fills lies one exchange, unless the first look found none.
        for before, after in zip(seen, seen[1:]):
            if before is not None and after is not None:
                assert after > before


@pytest.mark.parametrize(
    ("lengths", "bins", "left"),
    [
        ([60, 40], [[0], [1]], 1),  # move
        ([50, 30, 70, 25, 25], [[0, 1], [2], [3, 4]], 2),  # one for one
        ([35, 25, 30, 70, 40], [[0, 1, 2], [3], [4]], 2),  # any of the exchanges that fill ten
    ],
)
def test_single_exchanges(lengths, bins, left):
    assert len(packing.improved(bins, lengths, 100)) == left


def test_order_is_kept_in_windows(spark, tmp_path):
    docs(spark, *["word " * (1 + i % 7) for i in range(60)]).repartitionByRange(5, "doc_id").sortWithinPartitions("doc_id").write.parquet(str(tmp_path / "d"))
    stored = spark.read.parquet(str(tmp_path / "d"))
    rows = {r["doc_id"]: r["__row"] for r in packing.numbered(stored).collect()}
    assert rows == {i: i for i in range(60)}
    cut = packing.pieces(packing.numbered(stored), 16, packing.F.col("__row")).cache()
    places = packing.packed_in_order(cut, 16, window_items=10).collect()
    assert len(places) == 60
    ordered = sorted(places, key=lambda r: r["sequence_id"])
    assert [r["row"] // 10 for r in ordered] == sorted(r["row"] // 10 for r in ordered)
    got = packing.packed_documents(stored, 16, in_order=True).collect()
    fill: dict = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == fill.get(r["sequence_id"], 0)
        fill[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(fill.values()) <= 16 and len(got) == 60
    assert packing.packed_documents(stored.limit(0), in_order=True).count() == 0


def test_rounds_of_several_shards(spark):
    got = packing.packed_documents(docs(spark, *["w " * (1 + i * 7 % 23) for i in range(300)]), 64).count()
    assert got == 300
    items = spark.range(300).selectExpr("id AS row", "0 AS piece", "1 + id * 37 % 60 AS length")
    places = packing.packed(items, 64, shard_items=40).collect()
    lengths = {i: 1 + i * 37 % 60 for i in range(300)}
    fill: dict = {}
    for r in places:
        fill[r["sequence_id"]] = fill.get(r["sequence_id"], 0) + lengths[r["row"]]
    assert len(places) == 300 and max(fill.values()) <= 64 and len(fill) <= 1.1 * sum(lengths.values()) / 64


def test_ids_of_a_whole_table_are_those_of_the_tokenizer(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    exact, want = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), {}
    table = spark.read.parquet(TABLE)
    for r in table.select("doc_id", "text").collect():
        ids = np.array([*exact.encode(r["text"] or "", add_special_tokens=False).ids, 0], dtype="<u4")
        for piece, (start, n) in enumerate(packing.cut(len(ids))):
            want[r["doc_id"], piece] = (start, n, zlib.crc32(ids[start : start + n].tobytes()))
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in packing.packed_documents(table).collect()} == want
