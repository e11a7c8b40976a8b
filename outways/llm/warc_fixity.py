"""Merkle fixity audit of WARC records.

Records (a canonical header and the payload) are hashed and ordered by their id. Ordered ranges
of ``FANOUT`` neighbours are hashed into a node, ``FANOUT`` neighbouring nodes into the node
above, and so on to one root per replica. An audit compares the roots and descends only into
branches that differ, so the work below the leaf hashes follows the damage, not the archive.

A node's hash covers the children's positions and hashes, so a missing, an added and a moved
record change it. Byte offsets of a damaged record are its place in the primary copy of its
WARC file (``RECORDS_PER_FILE`` neighbouring ids make a file).

All DataFrame expressions; no group holds more than ``FANOUT`` rows or one file's records.

Cases: null urls and payloads are empty ones; repeated ids are told apart by their order of hash;
records without an id take places below -2**40 by their hash (ids are above that); two empty
replicas agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from outways.llm.store import written

FANOUT = 64
RECORDS_PER_FILE = 1024


def record_bytes(url: Column, payload: Column) -> Column:
    """A WARC response record as text: header lines, a blank line, the payload."""
    body = F.coalesce(payload, F.lit(""))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"),
    )


def leaves(pages: DataFrame) -> DataFrame:
    """(page_id, copy, slot, sha256, bytes): one row per record; ``slot`` orders and places it."""
    record = record_bytes(F.col("url"), F.col("html"))
    hashed = pages.select("page_id", F.sha2(record, 256).alias("sha256"), F.octet_length(record).cast("long").alias("bytes"))
    lone = F.lit(-(2**40)) - F.pmod(F.xxhash64("sha256"), F.lit(2**30))
    hashed = hashed.withColumn("slot", F.coalesce(F.col("page_id").cast("long"), lone))
    same = Window.partitionBy("slot").orderBy("sha256")
    return hashed.select("page_id", (F.row_number().over(same) - 1).alias("copy"), "slot", "sha256", "bytes")


def parents(nodes: DataFrame, fanout: int) -> DataFrame:
    """(node, sha256) of the level above, from (node, sha256) or leaves as (slot, copy, sha256)."""
    place = F.struct("node", "sub", "sha256")
    line = lambda x: F.concat_ws(",", x["node"].cast("string"), x["sub"].cast("string"), x["sha256"])
    return (
        nodes.groupBy(F.floor(F.col("node").cast("decimal(20,0)") / fanout).cast("long").alias("up"))
        .agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(place)), line), "\n"), 256).alias("sha256"))
        .select(F.col("up").alias("node"), F.lit(0).alias("sub"), "sha256")
    )


def tree(records: DataFrame, fanout: int = FANOUT, levels: int | None = None) -> list[DataFrame]:
    """Levels from the leaves (node, sub, sha256) up to a root, or one on either side of id 0."""
    level = records.select(F.col("slot").alias("node"), F.col("copy").alias("sub"), "sha256")
    built = [level]
    while levels is None or len(built) < levels:
        level = written(parents(level, fanout), "merkle")
        built.append(level)
        if levels is None and (level.agg(F.max(F.greatest(F.col("node"), -F.col("node") - 1))).collect()[0][0] or 0) < 1:
            break
    return built


def differing(primary: DataFrame, replica: DataFrame, within: DataFrame | None, fanout: int) -> DataFrame:
    """Nodes (node, sub, sha256, other) that differ, only below those of ``within``."""
    if within is not None:
        up = F.floor(F.col("node").cast("decimal(20,0)") / fanout).cast("long").alias("up")
        below = within.select(F.col("node").alias("up")).distinct()
        primary = primary.withColumn("up", up).join(below, "up", "left_semi").drop("up")
        replica = replica.withColumn("up", up).join(below, "up", "left_semi").drop("up")
    other = replica.select("node", "sub", F.col("sha256").alias("other"))
    return primary.join(other, ["node", "sub"], "full").filter(~F.col("sha256").eqNullSafe(F.col("other")))


def audit(primary: DataFrame, replica: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """The damaged records of a replica: page_id, copy, status (altered, missing or added), file,
    offset and bytes in the primary copy (null for added ones), and both hashes."""
    own, other = written(leaves(primary), "leaves"), written(leaves(replica), "leaves")
    trees = [tree(own, fanout)]
    trees.append(tree(other, fanout, len(trees[0])))
    bad = None
    for level in range(len(trees[0]) - 1, -1, -1):
        bad = differing(trees[0][level], trees[1][level], bad, fanout)
        if level:
            bad = written(bad, "differing")
    file = F.floor(F.col("slot").cast("decimal(20,0)") / RECORDS_PER_FILE).cast("long")
    damaged_files = bad.select(F.floor(F.col("node").cast("decimal(20,0)") / RECORDS_PER_FILE).cast("long").alias("file")).distinct()
    before = Window.partitionBy("file").orderBy("slot", "copy").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        own.withColumn("file", file)
        .join(damaged_files, "file", "left_semi")
        .select(F.col("slot").alias("node"), F.col("copy").alias("sub"), F.coalesce(F.sum("bytes").over(before), F.lit(0).cast("long")).alias("offset"), "bytes")
    )
    status = F.when(F.col("other").isNull(), "missing").when(F.col("sha256").isNull(), "added").otherwise("altered")
    return bad.join(placed, ["node", "sub"], "left").select(
        F.when(F.col("node") > -(2**40), F.col("node")).alias("page_id"), F.col("sub").alias("copy"), status.alias("status"),
        F.floor(F.col("node").cast("decimal(20,0)") / RECORDS_PER_FILE).cast("long").alias("file"), "offset", "bytes",
        F.col("sha256").alias("primary_sha256"), F.col("other").alias("replica_sha256"),
    )


def damaged_copy(pages: DataFrame) -> DataFrame:
    """A replica derived from the pages: by their id a page in fifty has the first character of its
    payload changed, one is missing, and one stands twice."""
    kind = F.expr("(page_id % 1009 * 31) % 50")
    changed = F.concat(F.lit("~"), F.expr("substring(coalesce(html, ''), 2)"))
    copies = F.coalesce(F.when(kind == 1, 0).when(kind == 2, 2), F.lit(1))
    return (
        pages.select("page_id", "url", F.when(kind == 0, changed).otherwise(F.col("html")).alias("html"), copies.alias("copies"))
        .select("page_id", "url", "html", F.explode(F.array_repeat(F.lit(1), F.col("copies"))).alias("one"))
        .drop("one")
    )
