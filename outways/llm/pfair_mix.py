"""Mixing sources to target weights by Pfair scheduling.

Each source is a stream of blocks of ``block_chars`` characters, its documents in a hashed order.
Time is slots of one block. In the fluid ideal every source is served all the time at its share of
the weights of those that have blocks left. Block j of a source is released in the slot in which the
ideal begins with it, and due at the end of the slot in which the ideal ends it; in each slot the
released block with the earliest deadline goes next. The ideal serves every block one unit
within its window and every slot one unit in all, so every block meets its window: after every slot
a source has had less than one block more or less than the ideal.

The ideal has a closed form, in whole numbers and without rounding: if V is the service per unit of
weight, the slots gone by are the sum over sources of min(V * weight, blocks); block j of a source
ends at V = j / weight. Weights are taken exactly as given, whatever their size; when a source runs
out, the others' windows stretch to their new share by the same formula, and no document is dropped
or repeated.

Earliest deadline first is a sequence by nature; only blocks run through it, in one task of two heap
operations a block that holds one entry a source. Blocks have ``BLOCK_CHARS`` characters, or more on
inputs where that would give over ``MAX_BLOCKS`` blocks, so that this task stays some seconds long
however large the input is. Documents meet their block's slot in a join on (source, block).

A source with a third of all rows is no hot group: places in a source's stream are prefix sums over
(source, range of hashes), each a bounded group, and over these groups' totals in two levels.

Cases: a null source is a source of its own; a null or empty text counts one character; documents
longer than a block take the slots of several; ties in the hashed order go by id, so repeated rows
keep a place each; a source without a target weight gets the mean of those given; a weight that is
null, zero, negative or not finite is an error; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Iterator
from fractions import Fraction
from math import isfinite, lcm

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from outways.llm.store import written

BLOCK_CHARS = 32_768
MAX_BLOCKS = 1 << 20
GROUP_ROWS, GROUPS_OF_GROUPS = 512, 1_024
NO_SOURCE = "\u0000none"


def whole_weights(weights: dict[str, float]) -> dict[str, int]:
    """The weights, exactly, as whole multiples of one unit."""
    if any(w is None or not isfinite(w) or w <= 0 for w in weights.values()):
        raise ValueError("target weights must be finite and above zero")
    exact = {s: Fraction(w) for s, w in weights.items()}
    unit = lcm(*(x.denominator for x in exact.values()), 1)
    return {s: int(x * unit) for s, x in exact.items()}


class Ideal:
    """The fluid schedule of sources with numbers of blocks and whole weights."""

    def __init__(self, blocks: list[int], weights: list[int]):
        order = sorted(range(len(blocks)), key=lambda i: Fraction(blocks[i], weights[i]))
        self.ends = [(blocks[i], weights[i]) for i in order]
        self.done, self.rest = [0], [sum(weights)]
        for i in order:
            self.done.append(self.done[-1] + blocks[i])
            self.rest.append(self.rest[-1] - weights[i])

    def time(self, j: int, weight: int, since: int = 0) -> tuple[int, int]:
        """(slots * weight, sources that ended before): when a source of this weight has had j blocks.

        ``since``: a number of sources known to have ended before.
        """
        ended = lambda k: self.ends[k][0] * weight >= j * self.ends[k][1]
        k = since if since == len(self.ends) or ended(since) else bisect_left(range(len(self.ends)), True, lo=since, key=ended)
        return self.done[k] * weight + j * self.rest[k], k


def pfair(blocks: dict[str, int], weights: dict[str, int]) -> Iterator[tuple[str, int, int, int, int]]:
    """(source, block, release, deadline, slot) of every block, slot by slot.

    Earliest deadline first among released blocks; ties by the later release, then by name.
    """
    names = sorted(s for s in blocks if blocks[s])
    size, weight = [blocks[s] for s in names], [weights[s] for s in names]
    ideal = Ideal(size, weight)
    began, ended = [0] * len(names), [0] * len(names)
    ends: list[int] = [0] * len(names)  # slots * weight, of the block before

    def window(i: int, j: int) -> tuple[int, int]:
        release = ends[i] // weight[i]
        ends[i], ended[i] = ideal.time(j + 1, weight[i], ended[i])
        return release, -(-ends[i] // weight[i])

    coming: list[tuple[int, int, int, int]] = []
    for i in range(len(names)):
        release, deadline = window(i, 0)
        coming.append((release, i, 0, deadline))
    heapq.heapify(coming)
    ready: list[tuple[int, int, int, int]] = []
    for slot in range(sum(size)):
        while coming and coming[0][0] <= slot:
            release, i, j, deadline = heapq.heappop(coming)
            heapq.heappush(ready, (deadline, -release, i, j))
        deadline, release, i, j = heapq.heappop(ready)
        yield names[i], j, -release, deadline, slot
        if j + 1 < size[i]:
            release, deadline = window(i, j + 1)
            heapq.heappush(coming, (release, i, j + 1, deadline))


def root_weights(sizes: dict[str, int]) -> dict[str, float]:
    """Square roots of the sizes: small sources weigh more than their share."""
    return {s: float(max(1, n)) ** 0.5 for s, n in sizes.items()}


def streams(documents: DataFrame) -> DataFrame:
    """(doc_id, h, source, n, at): each row's first character's place in its source's stream."""
    text = F.coalesce(F.col("text"), F.lit(""))
    source: Column = F.coalesce(F.col("source").cast("string"), F.lit(NO_SOURCE))
    rows = documents.select(
        "doc_id", source.alias("source"), F.greatest(F.length(text), F.lit(1)).cast("long").alias("n"), F.xxhash64(F.col("doc_id"), text).alias("h")
    )
    rows = written(rows, "mix-rows")
    groups = max(1, rows.count() // GROUP_ROWS)
    rows = rows.withColumn("g", F.pmod(F.shiftrightunsigned("h", 20), F.lit(groups)))
    before = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0).cast("long")
    totals = rows.groupBy("source", "g").agg(F.sum("n").alias("n")).withColumn("gg", F.expr(f"g div {GROUPS_OF_GROUPS}"))
    upper = totals.groupBy("source", "gg").agg(F.sum("n").alias("n"))
    upper = upper.select("source", "gg", F.coalesce(F.sum("n").over(before("source").orderBy("gg")), none).alias("above"))
    bases = totals.withColumn("base", F.coalesce(F.sum("n").over(before("source", "gg").orderBy("g")), none)).join(upper, ["source", "gg"])
    placed = rows.withColumn("at", F.coalesce(F.sum("n").over(before("source", "g").orderBy("h", "doc_id")), none))
    return placed.join(bases.select("source", "g", (F.col("base") + F.col("above")).alias("base")), ["source", "g"]).select(
        "doc_id", "h", "source", "n", (F.col("base") + F.col("at")).alias("at")
    )


def planned(sources: DataFrame, weights: dict[str, float] | None) -> DataFrame:
    """(source, block, release, deadline, slot) of all blocks of ``sources`` (source, chars, blocks)."""

    def plan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat(batches, ignore_index=True)
        blocks = dict(zip(rows["source"], map(int, rows["blocks"]), strict=True))
        aims = root_weights(dict(zip(rows["source"], map(int, rows["chars"]), strict=True))) if weights is None else dict(weights)
        mean = sum(aims.values()) / len(aims) if aims else 1.0
        aims = whole_weights({s: aims.get(s, mean) for s in blocks})
        held: list[tuple] = []
        for row in pfair(blocks, aims):
            held.append(row)
            if len(held) == 65_536:
                yield pd.DataFrame(held, columns=["source", "block", "release", "deadline", "slot"])
                held = []
        yield pd.DataFrame(held, columns=["source", "block", "release", "deadline", "slot"])

    # One row a source, in one task: what runs through it is bounded by MAX_BLOCKS and a block a source.
    return sources.coalesce(1).mapInPandas(plan, "source string, block long, release long, deadline long, slot long")


def schedule(documents: DataFrame, weights: dict[str, float] | None = None, block_chars: int = BLOCK_CHARS, max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """Every row of documents with its place in the mixed stream.

    ``weights``: target weight per source (those not named get the mean; the null source is named
    by ``NO_SOURCE``); by default the square root of the source's characters. Returns doc_id, source,
    n_chars, block, release, deadline, slot, within (order among a block's documents) and h, the hash
    that stands for the row.
    """
    placed = written(streams(documents), "mix-places")
    total = placed.agg(F.coalesce(F.sum("n"), F.lit(0))).collect()[0][0]
    block_chars = max(block_chars, -(-total // max_blocks))
    placed = placed.withColumn("block", F.expr(f"at div {block_chars}"))
    sources = placed.groupBy("source").agg(F.sum("n").alias("chars"), (F.max("block") + 1).alias("blocks"))
    plan = written(planned(sources, weights), "mix-plan")
    return placed.join(plan, ["source", "block"]).select(
        "doc_id", F.nullif("source", F.lit(NO_SOURCE)).alias("source"), F.col("n").alias("n_chars"), "block", "release", "deadline", "slot", (F.col("at") % block_chars).alias("within"), "h"
    )


def mixed(documents: DataFrame, weights: dict[str, float] | None = None, **how) -> DataFrame:
    """The rows of documents, as they are, in the order of the schedule: range-partitioned by slot
    and sorted inside, so files written from it hold the mixed stream in turn."""
    text = F.coalesce(F.col("text"), F.lit(""))
    row = F.struct(*[F.col(f"`{c}`") for c in documents.columns])
    keyed = documents.select(row.alias("__row"), F.col("doc_id").alias("__id"), F.xxhash64(F.col("doc_id"), text).alias("__h"))
    places = schedule(documents, weights, **how).groupBy("doc_id", "h").agg(F.min("slot").alias("slot"), F.min("within").alias("within"))
    joined = keyed.join(places, F.col("__id").eqNullSafe(F.col("doc_id")) & (F.col("__h") == F.col("h")))
    return joined.repartitionByRange("slot").sortWithinPartitions("slot", "within", "__id").select("__row.*")
