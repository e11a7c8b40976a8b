"""Ranked lexical search with Block-Max MaxScore over a sharded, compressed index.

``index`` cuts each partition of the documents into shards of bounded size, without a shuffle, and writes one row
per shard and term: the posting list in blocks of ``BLOCK`` documents (gaps and counts, in as few
bytes as the block's largest needs), each block with its last document and its *peaks*, those pairs of (count,
document length) that no other document of the block beats in both. A score rises with the count and
falls with the length, so the best score of a block is that of one of its peaks whatever the
corpus' statistics turn out to be; one pass makes the index, and it stays right when more shards are added.

``search`` joins the terms of the items with the index and runs, for each shard and item:

* the sums of the lists' maxima part them into non-essential ones, which together can't lift a document
  over the k-th score so far, and essential ones, which name the candidates;
* a stretch of documents whose blocks' maxima don't add up to that score is passed over;
* the maxima of a candidate's blocks in the non-essential lists reject it before these are decompressed.

Each shard hands on the best ``k`` of each item and these are merged. All sums are in 64-bit
integers. Documents of a shard are met by ascending id, so a later equal score never displaces an earlier one.

Cases: a null or empty text has no term; such a document is in no list and isn't counted, and such an item has no
result. Items that share an id are one item with the terms of all. Rows without an id take no part. A repeated
document is ranked once per row. Ties go to the smaller id. An empty table gives an empty result.
Texts of any length are one document. Other columns are passed over, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from outways.llm.store import written

BLOCK = 128
#: A shard ends with the row that brings it to so many bytes of text or documents.
SHARD_BYTES, SHARD_DOCS = 24_000_000, 32_768
#: Documents scored at a time, and items searched by one task in a shard.
STRETCH, ITEMS = 2_048, 1_024
TOP = 20

#: Terms are runs of ASCII letters, ASCII digits and characters beyond ASCII; A-Z are lowered.
_FOLD = bytes(b if b >= 0x80 or chr(b).isalnum() else 32 for b in range(256)).lower()

INDEX = (
    "shard long, term string, df long, words long, lasts array<int>, widths binary, peaks array<int>, peak_tf array<int>, peak_n array<int>, body binary, doc_ids array<long>, lengths array<int>"
)


def terms_of(text: bytes) -> list[bytes]:
    # ``lower`` of bytes touches A-Z only; runs of spaces separate.
    return text.translate(_FOLD).lower().split()


class _Ids(dict):
    def __missing__(self, term: bytes) -> int:
        self[term] = number = len(self)
        return number


class Shard:
    """Documents gathered by one task, until they are packed into index rows."""

    def __init__(self):
        self.ids, self.doc_ids, self.lengths, self.held = _Ids(), [], [], 0
        self.numbers, self.counts, self.sizes = [], [], []

    def add(self, doc_id: int, text: bytes) -> None:
        words = terms_of(text)
        if not words:
            return
        count = Counter(words)
        self.doc_ids.append(doc_id)
        self.lengths.append(len(words))
        self.numbers.append(np.fromiter(map(self.ids.__getitem__, count), "i4", len(count)))
        self.counts.append(np.fromiter(count.values(), "i4", len(count)))
        self.held += len(text)

    def full(self) -> bool:
        return self.held >= SHARD_BYTES or len(self.doc_ids) >= SHARD_DOCS

    def rows(self, shard: int) -> pa.Table:
        """The index rows: one per term, and one of the documents, whose term is null."""
        by_id = np.argsort(np.array(self.doc_ids, "i8"), kind="stable")
        place = np.empty(len(by_id), "i8")
        place[by_id] = np.arange(len(by_id))
        lengths = np.array(self.lengths, "i8")[by_id]
        term = np.concatenate(self.numbers).astype("i8")
        doc = np.repeat(place, [len(c) for c in self.counts])
        order = np.argsort(term * len(by_id) + doc)
        term, doc, tf = term[order], doc[order], np.concatenate(self.counts).astype("i8")[order]
        df = np.bincount(term, minlength=len(self.ids))
        first = np.cumsum(df) - df
        within = np.arange(len(term)) - first[term]
        starts = np.flatnonzero(within % BLOCK == 0)
        size = np.diff(np.append(starts, len(term)))
        block = np.repeat(np.arange(len(starts)), size)
        previous = np.where(within == 0, -1, np.append(-1, doc[:-1]))
        gap, extra = doc - previous - 1, tf - 1
        # Bytes a number needs: 1, 2 or 4.
        bytes_of = lambda most: np.where(most < 1 << 8, 1, np.where(most < 1 << 16, 2, 4))
        gap_width, tf_width = (bytes_of(np.maximum.reduceat(x, starts)) for x in (gap, extra))
        total = size * (gap_width + tf_width)
        at = np.cumsum(total) - total
        body = np.zeros(total.sum(), "u1")
        inside = np.arange(len(term)) - starts[block]
        for values, width, base in ((gap, gap_width, at), (extra, tf_width, at + size * gap_width)):
            wide, to = width[block], base[block] + inside * width[block]
            for byte in range(4):
                some = wide > byte
                body[to[some] + byte] = values[some] >> 8 * byte & 255
        # Peaks: by rising length, longer counts first, each count larger than all before it in its block.
        n = lengths[doc]
        rising = np.lexsort((-tf, n, block))
        lifted = block[rising] * (tf.max() + 1) + tf[rising]
        highest = np.maximum.accumulate(lifted)
        peak = rising[np.append(True, lifted[1:] > highest[:-1])]
        peaks = np.bincount(block[peak], minlength=len(starts))
        term_of_block = term[starts]
        per_term = lambda sizes: np.append(0, np.cumsum(np.bincount(term_of_block, weights=sizes, minlength=len(self.ids)))).astype("i4")
        lists = lambda values, sizes: pa.ListArray.from_arrays(pa.array(per_term(sizes)), pa.array(values.astype("i4")))
        binary = lambda values, sizes: pa.Array.from_buffers(pa.binary(), len(self.ids), [None, pa.py_buffer(per_term(sizes)), pa.py_buffer(values.tobytes())])
        ones = np.ones(len(starts), "i8")
        none = lambda kind: pa.nulls(len(self.ids), kind)
        terms = pa.table(
            [
                pa.array(np.full(len(self.ids), shard)), pa.array(list(self.ids), pa.binary()).cast(pa.string()), pa.array(df), none(pa.int64()), lists(doc[starts + size - 1], ones),
                binary((gap_width + 16 * tf_width).astype("u1"), ones), lists(peaks, ones), lists(tf[peak], peaks), lists(n[peak], peaks), binary(body, total), none(pa.list_(pa.int64())), none(pa.list_(pa.int32())),
            ],
            names=[part.split(" ")[0] for part in INDEX.split(", ")],
        )
        documents = {"shard": shard, "term": None, "df": len(by_id), "words": int(lengths.sum()), "doc_ids": np.array(self.doc_ids, "i8")[by_id].tolist(), "lengths": lengths.tolist()}
        return pa.concat_tables([terms, pa.Table.from_pylist([documents], schema=terms.schema)])


def index(documents: DataFrame) -> DataFrame:
    """The index of all documents, one row per shard and term, and per shard one with its documents."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, made, shard = TaskContext.get().partitionId() << 24, 0, Shard()
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                if text.is_valid:
                    shard.add(doc_id, text.as_buffer().to_pybytes())
                if shard.full():
                    yield from shard.rows(base + made).to_batches(max_chunksize=20_000)
                    made, shard = made + 1, Shard()
        if shard.doc_ids:
            yield from shard.rows(base + made).to_batches(max_chunksize=20_000)

    rows = documents.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(build, INDEX)


class Postings:
    """One list of a shard; blocks are decompressed when first read."""

    def __init__(self, weight: int, df: int, lasts: np.ndarray, widths: bytes, peaks: np.ndarray, peak_tf: np.ndarray, peak_n: np.ndarray, body: bytes, norm):
        self.weight, self.lasts, self.body, self.read = weight, np.asarray(lasts, "i8"), body, {}
        self.sizes = np.full(len(self.lasts), BLOCK)
        self.sizes[-1] = df - BLOCK * (len(self.lasts) - 1)
        self.gap_width, self.tf_width = np.frombuffer(widths, "u1") & 15, np.frombuffer(widths, "u1") >> 4
        ends = np.cumsum(self.sizes * (self.gap_width.astype("i8") + self.tf_width))
        self.at = np.append(0, ends[:-1])
        starts = np.cumsum(peaks) - peaks
        self.maxima = weight * np.maximum.reduceat(impact(np.asarray(peak_tf, "i8"), norm(np.asarray(peak_n, "i8"))), starts)
        self.most = int(self.maxima.max())

    def block(self, b: int, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) of a block."""
        if b not in self.read:
            size, at = self.sizes[b], self.at[b]
            gaps = np.frombuffer(self.body, f"<u{self.gap_width[b]}", size, at).astype("i8")
            tf = np.frombuffer(self.body, f"<u{self.tf_width[b]}", size, at + size * self.gap_width[b]).astype("i8") + 1
            docs = np.cumsum(gaps + 1) + (self.lasts[b - 1] if b else -1)
            self.read[b] = docs, self.weight * impact(tf, m[docs])
        return self.read[b]


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1_000 * tf + 12 * m)


def best(lists: list[tuple[Postings, int]], m: np.ndarray, k: int, stretch: int | None = None) -> list[tuple[int, int]]:
    """(score, document) of the ``k`` best documents of a shard above 0, best first; ``lists`` has the
    postings of each term of an item, and how often the item has it."""
    stretch = stretch or STRETCH
    lists = sorted(lists, key=lambda x: x[0].most * x[1])
    sums = np.cumsum([p.most * times for p, times in lists])
    docs, scores, least = np.zeros(0, "i8"), np.zeros(0, "i8"), 0
    for low in range(0, len(m), stretch):
        high = min(low + stretch, len(m))
        essential = int(np.searchsorted(sums, least, side="right"))
        if essential == len(lists):
            break
        # The blocks of each list that reach into the stretch, and what they can add at most.
        spans = [(int(np.searchsorted(p.lasts, low)), int(np.searchsorted(p.lasts, high - 1)) + 1) for p, _ in lists]
        tops = [int(p.maxima[a:b].max(initial=0)) * times for (p, times), (a, b) in zip(lists, spans, strict=True)]
        if sum(tops) <= least:
            continue
        held = np.zeros(high - low, "i8")
        for (p, times), (a, b) in zip(lists[essential:], spans[essential:], strict=True):
            for at in range(a, min(b, len(p.lasts))):
                found, own = p.block(at, m)
                lo, hi = np.searchsorted(found, (low, high))
                held[found[lo:hi] - low] += times * own[lo:hi]
        met = np.flatnonzero(held)
        now, met = held[met], met + low
        rest = sum(tops[:essential])
        for i in range(essential - 1, -1, -1):
            # Before any block of these lists is read: their maxima at the candidates' places.
            some = now + rest > least
            now, met = now[some], met[some]
            if not len(met):
                break
            rest -= tops[i]
            p, times = lists[i]
            blocks = np.searchsorted(p.lasts, met)
            inside = blocks < len(p.lasts)
            bound = np.zeros(len(met), "i8")
            bound[inside] = times * p.maxima[blocks[inside]]
            wanted = inside & (now + bound + rest > least)
            for b in np.unique(blocks[wanted]):
                found, own = p.block(int(b), m)
                asked = np.flatnonzero(wanted & (blocks == b))
                at = np.minimum(np.searchsorted(found, met[asked]), len(found) - 1)
                hit = found[at] == met[asked]
                now[asked[hit]] += times * own[at[hit]]
            # A candidate that the block's maximum rejected can't come back.
            kept = wanted | (now + rest > least) & ~inside
            now, met = now[kept], met[kept]
        some = now > least
        docs, scores = np.append(docs, met[some]), np.append(scores, now[some])
        order = np.lexsort((docs, -scores))[:k]
        docs, scores = docs[order], scores[order]
        least = int(scores[-1]) if len(scores) == k else 0
    return list(zip(scores.tolist(), docs.tolist(), strict=True))


FOUND = "item_id long, doc_id long, score long"


def _searcher(n_docs: int, n_words: int, k: int):
    norm = lambda n: 100 - 25 + 25 * n * n_docs // n_words

    def search(group: pd.DataFrame) -> pd.DataFrame:
        documents = group[group["term"].isna()].iloc[0]
        doc_ids, m = np.asarray(documents["doc_ids"], "i8"), norm(np.asarray(documents["lengths"], "i8"))
        items: dict[int, list] = {}
        for row in group[group["term"].notna()].itertuples():
            postings = Postings(int(row.weight), row.df, row.lasts, row.widths, np.asarray(row.peaks), row.peak_tf, row.peak_n, row.body, norm)
            for asked in row.items:
                items.setdefault(asked["item_id"], []).append((postings, asked["times"]))
        found = [(item, int(doc_ids[doc]), score) for item, lists in items.items() for score, doc in best(lists, m, k)]
        return pd.DataFrame(found, columns=["item_id", "doc_id", "score"]).astype("i8")

    return search


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term, times) of each item."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(i, t.decode(), n) for i, text in zip(*(c.to_pylist() for c in batch.columns), strict=True) for t, n in Counter(terms_of(text or b"")).items()]
            yield pa.record_batch([pa.array([o[k] for o in out], kind) for k, kind in enumerate((pa.int64(), pa.string(), pa.int64()))], names=["item_id", "term", "times"])

    rows = items.filter("item_id IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(split, "item_id long, term string, times long").groupBy("item_id", "term").agg(F.sum("times").alias("times"))


def search(found_in: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` best documents of each item; ``found_in`` is a stored index."""
    spark = found_in.sparkSession
    size = found_in.filter("term IS NULL").agg(F.coalesce(F.sum("df"), F.lit(0)).alias("n"), F.coalesce(F.sum("words"), F.lit(0)).alias("words")).first()
    asked = written(item_terms(items), "item-terms")
    n_items = asked.select("item_id").distinct().count()
    if not size["n"] or not n_items:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    # Items go in blocks, so that a task holds a bounded number of them whatever their number.
    blocks = -(-n_items // ITEMS)
    block = F.pmod(F.xxhash64("item_id"), F.lit(blocks)).alias("block")
    wanted = asked.groupBy("term", block).agg(F.collect_list(F.struct("item_id", "times")).alias("items"))
    lists = found_in.filter("term IS NOT NULL").join(asked.select("term").distinct(), "term")
    lists = written(lists, "lists")
    n_docs = size["n"]
    weigh = F.udf(lambda df: math.floor(1_000 * math.log((2 * n_docs + 2) / (2 * df + 1))), "long")
    # One row per term of an item.
    weights = lists.groupBy("term").agg(F.sum("df").alias("all")).select("term", weigh("all").alias("weight")).filter("weight > 0")
    asking = lists.join(weights, "term").join(wanted, "term")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block")
    documents = found_in.filter("term IS NULL").select("*", every)
    rows = asking.unionByName(documents, allowMissingColumns=True).drop("words")
    # Shards of which an item holds no term come alone and find nothing.
    found = rows.groupBy("shard", "block").applyInPandas(_searcher(n_docs, size["words"], k), FOUND)
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def ranked(documents: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """Index ``documents`` in the shared folder and search it."""
    return search(written(index(documents), "postings"), items, k)
