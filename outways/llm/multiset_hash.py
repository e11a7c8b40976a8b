"""Homomorphic multiset hash of documents.

A text is a multiset of paragraphs (its lines). Every paragraph hashes to a wide vector, and a
document's fingerprint is the sum of its paragraphs' vectors modulo powers of two, so the order
of paragraphs does not matter and a paragraph is inserted or deleted by adding or subtracting
its vector. The vector has two parts:

* ``EQUALITY_LANES`` words of 32 bits, hashed from the whole paragraph, summed modulo 2**32;
* ``COUNTERS`` counters: at each word of the paragraph a piece of up to four words starts, and
  adds the bits of its hash, modulo 2**32; a word more or less changes the four pieces around it. Twice a counter less the number of pieces is a sum of random signs, so
  the inner product of two documents' counters estimates that of their piece multisets.

Everything here is DataFrame expressions; no Python runs on the executors.

Cases: a null text is an empty one; an empty text has the zero vector; two empty texts have
likeness 1, an empty and a non-empty one 0. Rows with a repeated id keep one row each. Rows
without an id are successors of nothing and have none, so their tail is only cut off.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EQUALITY_LANES = 8
COUNTERS = 64
MASK32 = 0xFFFFFFFF
#: Bit 0 of either half of a 64-bit word: two counters in one long.
PAIR = 0x0000000100000001
#: Up to four words of one line, from each word on; in a word of over 24 characters also from
#: each character after the first 24, so that texts without spaces have overlapping pieces too.
PIECE = r"(?:(?<!\S)|(?<=\S{24}))(?=(\S{1,24}(?:[^\S\n]+\S{1,24}){0,3}))"


def paragraphs(text: Column) -> Column:
    """The lines of a text; none for an empty text."""
    return F.when(F.length(text) > 0, F.split(text, "\n", -1)).otherwise(F.array().cast("array<string>"))


def equality_lanes(lines: Column) -> Column:
    """Hex of the summed 32-bit words hashed from whole paragraphs."""

    def lane(seed: int, shift: int) -> Column:
        word = lambda p: F.shiftrightunsigned(F.xxhash64(F.lit(seed), p), shift).bitwiseAND(F.lit(MASK32))
        total = F.aggregate(lines, F.lit(0).cast("long"), lambda a, p: (a + word(p)).bitwiseAND(F.lit(MASK32)))
        return F.lpad(F.lower(F.hex(total)), 8, "0")

    return F.concat(*[lane(seed, shift) for seed in range(EQUALITY_LANES // 2) for shift in (0, 32)])


def counter_sums(piece: Column) -> list[Column]:
    """Aggregates over pieces: 32 longs with two counters each."""
    h = F.xxhash64(piece)
    return [
        F.coalesce(F.sum(F.when(piece.isNotNull(), F.shiftrightunsigned(h, i).bitwiseAND(F.lit(PAIR)))), F.lit(0)).alias(f"c{i}")
        for i in range(COUNTERS // 2)
    ]


def unpacked(packed: Column) -> Column:
    return F.flatten(F.transform(packed, lambda x: F.array(x.bitwiseAND(F.lit(MASK32)), F.shiftrightunsigned(x, 32))))


def counters_hex(counters: Column) -> Column:
    return F.array_join(F.transform(counters, lambda x: F.lpad(F.lower(F.hex(x.bitwiseAND(F.lit(MASK32)))), 8, "0")), "")


def signed(counters: Column, pieces: Column) -> Column:
    return F.transform(counters, lambda c: (c * 2 - pieces).cast("double"))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1 from two signed counter vectors: twice the inner product over the squared norms."""
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, x: s + x)
    dot = total(F.zip_with(a, b, lambda x, y: x * y))
    norms = total(F.transform(a, lambda x: x * x)) + total(F.transform(b, lambda x: x * x))
    return F.when(norms == 0, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2 * dot / norms)))


def fingerprints(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """One row per row of ``df``: keys, ``fingerprint`` string, ``pieces`` long, ``counters`` array.

    ``keys`` must tell the rows apart. No shuffle where ``df`` is already dealt by some of them.
    """
    prepared = (
        df.select(*keys, F.coalesce(F.col(text), F.lit("")).alias("__t"))
        .select(*keys, "__t", paragraphs(F.col("__t")).alias("__lines"))
        .select(*keys, "__t", equality_lanes(F.col("__lines")).alias("__eq"))
    )
    exploded = prepared.select(*keys, "__eq", F.explode_outer(F.regexp_extract_all("__t", F.lit(PIECE), F.lit(1))).alias("__piece"))
    sums = exploded.groupBy(*keys, "__eq").agg(F.count("__piece").alias("pieces"), *counter_sums(F.col("__piece")))
    return sums.select(
        *keys, "__eq", "pieces", unpacked(F.array(*[f"c{i}" for i in range(COUNTERS // 2)])).alias("counters")
    ).select(
        *keys,
        F.concat(F.col("__eq"), F.lit(":"), F.lower(F.hex("pieces")), F.lit(":"), counters_hex(F.col("counters"))).alias("fingerprint"),
        "pieces",
        "counters",
    )


def _words_of(hex_text: Column) -> Column:
    """The 32-bit words of a text of eight hexadecimal digits each."""
    digits = lambda k: F.substr(hex_text, k * 8 + 1, F.lit(8))
    return F.transform(F.sequence(F.lit(0), (F.length(hex_text) / 8).cast("int") - 1), lambda k: F.conv(digits(k), 16, 10).cast("long"))


def changed(fingerprint: Column, paragraph: Column, times: int) -> Column:
    """A stored fingerprint with a paragraph (a line, without its break) inserted ``times`` times, or deleted
    where ``times`` is negative; the text itself isn't needed, and the place doesn't matter."""
    part = lambda i: F.split_part(fingerprint, F.lit(":"), F.lit(i))
    added = lambda old, own: F.zip_with(old, own, lambda a, b: (a + b * times).bitwiseAND(F.lit(MASK32)))
    pieces = F.regexp_extract_all(paragraph, F.lit(PIECE), F.lit(1))
    hashes = F.transform(pieces, lambda p: F.xxhash64(p))
    pair = lambda i: F.aggregate(hashes, F.lit(0).cast("long"), lambda s, h: s + F.shiftrightunsigned(h, i).bitwiseAND(F.lit(PAIR)))
    own = unpacked(F.array(*[pair(i) for i in range(COUNTERS // 2)]))
    number = F.conv(part(2), 16, 10).cast("long") + F.size(pieces) * times
    return F.concat(counters_hex(added(_words_of(part(1)), _words_of(equality_lanes(F.array(paragraph))))), F.lit(":"), F.lower(F.hex(number)), F.lit(":"), counters_hex(added(_words_of(part(3)), own)))


def _previous_blocks(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, block): the first document of each block of ids, and the block before it, the
    last one for the first. Two levels, so that no window holds more than one row in
    ``width * 4096`` ids."""
    firsts = (
        docs.filter(F.col("doc_id").isNotNull())
        .groupBy(F.expr(f"doc_id div {width}").alias("own"))
        .agg(F.min("doc_id").alias("doc_id"))
        .withColumn("over", F.expr("own div 4096"))
    )
    overs = firsts.groupBy("over").agg(F.max("own").alias("last"))
    everything = Window.orderBy("over")
    overs = overs.select(
        "over",
        F.coalesce(F.lag("last").over(everything), F.max("last").over(everything.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("before"),
    )
    inside = Window.partitionBy("over").orderBy("own")
    return (
        firsts.withColumn("previous", F.lag("own").over(inside))
        .join(overs, "over")
        .select("doc_id", F.coalesce("previous", "before").alias("block"))
    )


def edited_fingerprints(documents: DataFrame, width: int = 512) -> DataFrame:
    """Fingerprint every document and its edited text.

    The edited text has the last quarter of the code points (rounded down) replaced by as many
    of the next document by ascending ``doc_id``, the first after the last. Documents are dealt
    by blocks of ``width`` ids with one shuffle of the texts; the first document of the next
    block rides along as a guest.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next.
    """
    docs = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    guests = docs.join(_previous_blocks(docs.select("doc_id"), width), "doc_id").select("block", F.lit(True).alias("guest"), "doc_id", "text")
    #: Rows without an id are spread over blocks below all others.
    lone = F.lit(-(2**62)) + F.pmod(F.xxhash64("text"), F.lit(1024))
    own = docs.select(F.coalesce(F.expr(f"doc_id div {width}"), lone).alias("block"), F.lit(False).alias("guest"), "doc_id", "text")
    order = Window.partitionBy("block").orderBy("guest", "doc_id", "text")
    n = F.length("text").cast("long")
    following = F.when(F.col("doc_id").isNotNull(), F.lead("text").over(order))
    rows = (
        own.unionByName(guests)
        .select("block", "guest", "doc_id", "text", F.row_number().over(order).alias("row"), F.coalesce(following, F.lit("")).alias("next_text"))
        .withColumn("edited", F.concat(F.expr("substring(text, 1, length(text) - length(text) div 4)"), F.expr("substring(next_text, 1, cast(length(text) div 4 as int))")))
        .select(
            "block", "row", "guest", "doc_id", n.alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
            F.explode(F.array(F.struct(F.lit(0).alias("edit"), F.col("text").alias("t")), F.struct(F.lit(1).alias("edit"), F.col("edited").alias("t")))).alias("v"),
        )
        .select("block", "row", "guest", "doc_id", "n_chars", "edited_sha256", "v.edit", "v.t")
        .filter("not (guest and edit = 1)")
    )
    keys = ["block", "row", "guest", "doc_id", "n_chars", "edited_sha256", "edit"]
    prints = fingerprints(rows, keys, "t").withColumn("signs", signed(F.col("counters"), F.col("pieces")))
    pick = lambda name, edit: F.first(F.when(F.col("edit") == edit, F.col(name)), ignorenulls=True)
    paired = prints.groupBy("block", "row", "guest", "doc_id", "n_chars", "edited_sha256").agg(
        pick("fingerprint", 0).alias("fingerprint"),
        pick("fingerprint", 1).alias("edited_fingerprint"),
        pick("signs", 0).alias("signs"),
        pick("signs", 1).alias("edited_signs"),
    )
    following_signs = F.when(F.col("doc_id").isNotNull(), F.lead("signs").over(Window.partitionBy("block").orderBy("row")))
    return (
        paired.withColumn("next_signs", following_signs)
        .filter("not guest")
        .select(
            "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
            likeness(F.col("signs"), F.col("edited_signs")).alias("near_edited"),
            F.when(F.col("next_signs").isNotNull(), likeness(F.col("signs"), F.col("next_signs"))).otherwise(F.lit(0.0)).alias("near_next"),
        )
    )
