"""Best-fit packing with swap-based local search.

Documents become token sequences (ids of a byte-level BPE, then one end id); longer ones than a
sequence are cut, the rest first, so that all later pieces fill a sequence. Pieces that do not
fill one are dealt at random to shards of bounded size; each shard is packed best-fit decreasing
and improved by local search between its underfull bins: a document moves to a fuller bin (move), is
exchanged for a longer one there (one-for-one), two for a longer one, or one for two
(two-for-one). Every exchange raises the sum of squared fills, so the search ends, with bins emptied
into the others. Of the bins with room the emptiest eighth goes on as items to fewer shards in the
next round, until one shard is left; the rest is closed.

Only (row, piece, length) travels between tasks; no group is larger than ``SHARD_ITEMS``, and the
last round's one shard only exists once that few items are left. A stream whose order matters is
packed in windows of consecutive rows instead.

Cases: a null or empty text is one piece that holds the end id; repeated rows and ids are packed
once per row; an empty table gives no sequences; other columns are passed over, whatever their names.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from outways.llm.store import written

CAPACITY = 2048
END_ID = 0
SHARD_ITEMS = 8_192


class Encoder:
    """Ids of the byte-level BPE ``byte_bpe_50k.json``.

    Encoded with the same vocabulary's ranks file: the ids are those of the ``tokenizers``
    library (a test compares a whole table), at a third of its time. Texts with the special
    token's own string go through ``tokenizers`` itself.
    """

    SPECIAL = "<|endoftext|>"

    def __init__(self):
        import public_tokenizers
        import tiktoken

        self.json = public_tokenizers.path("byte_bpe_50k.json")
        with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.exact = None

    def ids(self, text: str) -> list[int]:
        if self.SPECIAL not in text:
            return self.fast.encode_ordinary(text)
        if self.exact is None:
            from tokenizers import Tokenizer

            self.exact = Tokenizer.from_file(self.json)
        return self.exact.encode(text, add_special_tokens=False).ids


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of each piece of n ids; only the first may be shorter than the capacity."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity or capacity
    return [(0, first), *((start, capacity) for start in range(first, n, capacity))]


def pieces(documents: DataFrame, capacity: int = CAPACITY, row: Column | None = None) -> DataFrame:
    """(row, doc_id, piece, start, length, ids_crc32); ``row`` tells rows apart."""

    def encoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = Encoder()
        for batch in batches:
            found = []
            for row, doc_id, text in zip(batch["row"], batch["doc_id"], batch["text"], strict=True):
                ids = np.array([*encoder.ids(text), END_ID], dtype="<u4")
                found += [(row, doc_id, i, start, n, zlib.crc32(ids[start : start + n].tobytes())) for i, (start, n) in enumerate(cut(len(ids), capacity))]
            out = pd.DataFrame(found, columns=["row", "doc_id", "piece", "start", "length", "ids_crc32"])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    rows = documents.select((F.monotonically_increasing_id() if row is None else row).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInPandas(encoded, "row long, doc_id long, piece int, start long, length long, ids_crc32 long")


class Lengths:
    """Items by length: a bit for each length at hand, and the same bits from the other end."""

    def __init__(self, capacity: int):
        self.capacity, self.mask, self.mirror, self.at = capacity, 0, 0, {}

    def add(self, length: int, item) -> None:
        self.at.setdefault(length, {})[item] = None
        self.mask |= 1 << length
        self.mirror |= 1 << (self.capacity - length)

    def remove(self, length: int, item) -> None:
        held = self.at[length]
        del held[item]
        if not held:
            del self.at[length]
            self.mask &= ~(1 << length)
            self.mirror &= ~(1 << (self.capacity - length))

    def last(self, length: int, but=None):
        """The item of this length that was added last, other than ``but``; None if there is none."""
        return next((item for item in reversed(self.at.get(length, {})) if item != but), None)

    def largest(self, low: int, high: int) -> int | None:
        """The largest length at hand in [low, high]."""
        top = (self.mask & ((1 << (high + 1)) - 1)).bit_length() - 1
        return top if top >= max(low, 0) else None

    def pair(self, low: int, high: int) -> tuple[int, int] | None:
        """Two lengths at hand (the same one, only if two items have it) with the largest sum in [low, high]."""
        for total in range(high, low - 1, -1):
            # Bit x of the mirror, moved, stands for length total - x.
            moved = self.mirror >> (self.capacity - total) if total <= self.capacity else self.mirror << (total - self.capacity)
            both = self.mask & moved & ((1 << (total // 2 + 1)) - 1)
            if both and total % 2 == 0 and both >> (total // 2) and len(self.at[total // 2]) < 2:
                both &= ~(1 << (total // 2))
            if both:
                shorter = both.bit_length() - 1
                return shorter, total - shorter
        return None


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers: longest first, into the fullest bin that has room."""
    bins: list[list[int]] = []
    rooms, mask = {}, 0
    for item in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n = lengths[item]
        fitting = mask >> n
        if fitting:
            room = n + (fitting & -fitting).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                mask &= ~(1 << room)
        else:
            room, b = capacity, len(bins)
            bins.append([])
        bins[b].append(item)
        if room > n:
            rooms.setdefault(room - n, []).append(b)
            mask |= 1 << (room - n)
    return bins


def improved(bins: list[list[int]], lengths: list[int], capacity: int) -> list[list[int]]:
    """Local search between standing bins.

    In each sweep the bins that aren't full take their turns, the fullest first, and exchange
    documents with bins whose turn is still to come: a document moves over; one goes for a longer
    one, or two for a longer one; one or none comes back for two. What a bin gives goes to a bin it took
    from, where it fits. A turn takes the exchange that fills most of the bin's room until there
    is none. Only exchanges that raise the sum of squared fills are taken, so the search ends: with a
    sweep that finds none. Bins that have run empty by then are gone.
    """
    bins = [list(b) for b in bins if b]
    while True:
        fill = [sum(lengths[i] for i in b) for b in bins]
        turns = sorted((b for b in range(len(bins)) if fill[b] < capacity), key=lambda b: -fill[b])
        stock, home = Lengths(capacity), {}
        for b in turns:
            for i in bins[b]:
                stock.add(lengths[i], i)
                home[i] = b
        exchanged = False
        for b in turns:
            for i in bins[b]:
                stock.remove(lengths[i], i)
            while stock.mask and bins[b] and fill[b] < capacity and (move := _best_exchange(bins[b], capacity - fill[b], stock, home, fill, lengths)):
                taken, given, giver = move
                exchanged = True
                for i in taken:
                    stock.remove(lengths[i], i)
                    bins[home[i]].remove(i)
                    fill[home[i]] -= lengths[i]
                    bins[b].append(i)
                for i in given:
                    bins[b].remove(i)
                    bins[giver].append(i)
                    home[i] = giver
                    fill[giver] += lengths[i]
                    stock.add(lengths[i], i)
                fill[b] = sum(lengths[i] for i in bins[b])
        bins = [b for b in bins if b]
        if not exchanged:
            return sorted(bins, key=lambda b: -sum(lengths[i] for i in b))


def _best_exchange(own: list[int], room: int, stock: Lengths, home: dict[int, int], fill: list[int], lengths: list[int]) -> tuple[list[int], list[int], int] | None:
    """(items to take, items to give, bin to give to) that fills most of a bin's room."""
    gain, best = 0, None
    filled = stock.capacity - room
    by_length = {lengths[i]: i for i in own}
    singles = [(0, []), *((n, [i]) for n, i in by_length.items())]
    twos = [(lengths[x] + lengths[y], [x, y]) for k, x in enumerate(own) for y in own[k + 1 :]]
    for given, items in [*singles, *sorted(twos, key=lambda t: t[0])]:
        high = min(given + room, stock.capacity)
        while (n := stock.largest(given + gain + 1, high)) is not None:
            # What moves is n - given; the squares rise if this bin gets fuller than the other was.
            item = next((i for i in reversed(stock.at[n]) if fill[home[i]] < filled + n - given), None)
            if item is not None:
                gain, best = n - given, ([item], items, home[item])
                break
            high = n - 1
        if gain == room:
            return best
    for given, items in singles:
        low = given + gain + 1
        high = given + room
        while low <= high and (two := stock.pair(low, high)):
            first = stock.last(two[1])
            second = stock.last(two[0], first)
            left = {home[i]: fill[home[i]] for i in (first, second)}
            for i in (first, second):
                left[home[i]] -= lengths[i]
            giver = next((b for b, held in left.items() if held + given <= stock.capacity), None)
            more = sum(two) - given
            if giver is not None:
                left[giver] += given
            if giver is None or (filled + more) ** 2 - filled**2 + sum(held**2 - fill[b] ** 2 for b, held in left.items()) <= 0:
                high = sum(two) - 1  # the given one fits in neither, or the squares would fall: a smaller pair
                continue
            gain, best = more, ([first, second], items, giver)
            break
        if gain == room:
            break
    return best


def _packer(turn: int, last: bool, capacity: int):
    """Packs one shard; ``closed`` marks the bins that no later round repacks: all in the last one, else
    all but the emptiest eighth of those with room."""

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["row", "piece"], ignore_index=True)
        lengths = group["length"].tolist()
        bins = improved(best_fit(lengths, capacity), lengths, capacity)
        fills = [sum(lengths[i] for i in b) for b in bins]
        under = [b for b in range(len(bins)) if fills[b] < capacity]
        later = set() if last else set(under[-max(1, len(under) // 8) :] if under else [])
        shard = int(group["shard"].iloc[0])
        which, offset, closed = np.zeros(len(group), "i8"), np.zeros(len(group), "i8"), np.zeros(len(group), bool)
        for b, members in enumerate(bins):
            at = 0
            for i in members:
                which[i], offset[i] = (shard << 24) + b, at
                at += lengths[i]
            closed[members] = b not in later
        return pd.DataFrame({"row": group["row"], "piece": group["piece"], "length": group["length"], "round": turn, "bin": which, "offset": offset, "closed": closed})

    return pack


PACKED = "row long, piece int, length long, round int, bin long, offset long, closed boolean"


def packed(items: DataFrame, capacity: int = CAPACITY, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """(row, piece, sequence_id, offset) of every item (row, piece, length)."""
    full = items.filter(F.col("length") == capacity).select("row", "piece", "length", F.lit(0).alias("round"), F.monotonically_increasing_id().alias("bin"), F.lit(0).cast("long").alias("offset"), F.lit(True).alias("closed"))
    done = [full]
    open_items, turn = items.filter(F.col("length") < capacity).select("row", "piece", "length"), 1
    left = open_items.count()
    while left:
        shards = -(-left // shard_items)
        dealt = open_items.withColumn("shard", F.pmod(F.xxhash64("row", "piece", F.lit(turn)), F.lit(shards)))
        result = written(dealt.groupBy("shard").applyInPandas(_packer(turn, shards == 1, capacity), PACKED), "packed")
        done.append(result.filter("closed"))
        open_items = result.filter("not closed").select("row", "piece", "length")
        left, turn = open_items.count(), turn + 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    # Rounds, shards and bins are numbers of few bits; full pieces count up in round 0.
    return out.select("row", "piece", (F.shiftleft(F.col("round").cast("long"), 57) + F.col("bin")).alias("sequence_id"), "offset")


def packed_in_order(items: DataFrame, capacity: int = CAPACITY, window_items: int = SHARD_ITEMS) -> DataFrame:
    """(row, piece, sequence_id, offset) of every item (row, piece, length), where ``row`` counts up
    without gaps: items of ``window_items`` consecutive rows share sequences, and sequences are
    numbered in the order of these windows."""
    dealt = items.withColumn("shard", F.expr(f"row div {window_items}"))
    result = dealt.groupBy("shard").applyInPandas(_packer(0, True, capacity), PACKED)
    return result.select("row", "piece", F.col("bin").alias("sequence_id"), "offset")


def numbered(documents: DataFrame) -> DataFrame:
    """The rows with ``__row``, a count from 0 in the order of the files they were read from (of the
    partitions, where they come from no files)."""
    if documents.inputFiles():
        at = documents.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__index"))
    else:
        place = F.monotonically_increasing_id()
        at = documents.select("*", F.shiftright(place, 33).cast("string").alias("__file"), place.bitwiseAND(F.lit((1 << 33) - 1)).alias("__index"))
        at = at.withColumn("__file", F.lpad("__file", 10, "0"))
    # One row a file or partition.
    files = at.groupBy("__file").agg(F.count("*").alias("n"))
    base = F.coalesce(F.sum("n").over(Window.orderBy("__file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return at.join(files.select("__file", base.alias("base")), "__file").withColumn("__row", F.col("base") + F.col("__index")).drop("__file", "__index", "base")


def packed_documents(documents: DataFrame, capacity: int = CAPACITY, in_order: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for each piece.

    ``in_order`` keeps the rows' order: sequences are made of windows of consecutive documents, for
    a stream that was mixed before; else all documents are packed into as few sequences as can be.
    """
    if in_order:
        cut_up = written(pieces(numbered(documents), capacity, F.col("__row")), "pieces")
        places = packed_in_order(cut_up, capacity)
    else:
        cut_up = written(pieces(documents, capacity), "pieces")
        places = packed(cut_up, capacity)
    return cut_up.join(places, ["row", "piece"]).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
