"""N-gram Jaccard join with a token-group matrix.

Links texts whose sets of word shingles have a Jaccard similarity of at least ``percent``/100, exactly,
and returns the connected components.

1. Texts with equal sets are one node. Every node's shingles are ordered by one global order,
   common ones last, and its prefix is taken: similar sets share a shingle of both prefixes. The
   order's table of common shingles is bounded; what it leaves out costs time, not links.
2. Shingles that several prefixes hold give each node pivots: the smallest node under the shingle.
   The pivot that may be nearest is compared with it exactly, which gives first components. The
   pivot it meets most often makes its group: similar texts, linked or not, in chunks of
   bounded size.
3. The token-group matrix holds the union of the prefix shingles of each group's chunks, of the
   shingles that still stand in several components. A node opens a chunk only if it shares such
   a shingle, and the chunk holds fitting sizes and another component; what is left after the
   parity bound goes on to the exact comparison, for which the opened texts' token union must
   hold enough of the node's tokens.
4. Components of components give each document the smallest id it can reach.

Before any full set is looked up, pairs pass a parity bound: a node's bitmap has the parity of the
number of its shingles under each bit, so two bitmaps differ in no more bits than the sets in
shingles, and pairs whose bitmaps differ in too many are no links. Bitmaps are a 64th of the sets.

No step emits the pairs of a group: step 2 has one pair per node, step 3 one row per node and
chunk of up to CHUNK_SETS texts. Only counts and the bounded table reach the driver.

Cases: null and empty texts and those without words have no shingles and are linked with nothing;
rows without an id keep a row but take no part (component null); repeated ids keep a row each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outways.llm.shingles import chunks, set_keys, shingle_sets
from outways.llm.store import written

#: Common shingles that the global order knows, at most.
COMMON_TABLE = 100_000
#: A shingle is reported as common by a task that meets it in so many texts, and kept from so many in all.
COMMON_IN_TASK, COMMON_LEAST = 4, 16
#: Tokens that a task counts at once.
COUNT_TOKENS = 2_000_000
CHUNK_SETS = 256
#: Tokens that the sets of a chunk hold, and that the sets asking it in one part hold, on average; long texts make smaller chunks.
CHUNK_TOKENS, PART_TOKENS = 512 * 1024, 1024 * 1024
#: Up to so many ids (64 MB) choose texts by broadcast; beyond, by a shuffled join.
BROADCAST_IDS = 4_000_000


def common_shingles(documents: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes ascending, class): the commonest shingles; the class is the binary logarithm of a count."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush():
            tokens, counts = np.unique(np.concatenate(held), return_counts=True)
            often = counts >= COMMON_IN_TASK
            return pa.RecordBatch.from_arrays([pa.array(tokens[often].view("i8")), pa.array(counts[often])], ["token", "n"])

        for batch in chunks(batches):
            _, hashes = shingle_sets(batch.column(0).to_pylist(), width)
            held.append(hashes)
            size += len(hashes)
            if size >= COUNT_TOKENS:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    counts = documents.select("text").mapInArrow(counted, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).filter(F.col("n") >= COMMON_LEAST)
    rows = counts.orderBy(F.desc("n"), "token").limit(COMMON_TABLE).toPandas()
    tokens = rows["token"].to_numpy("i8").view("u8")
    order = np.argsort(tokens)
    return tokens[order], np.log2(rows["n"].to_numpy("f8")[order]).astype("i8") if len(rows) else np.zeros(0, "i8")


def prefix_length(n: np.ndarray, percent: int) -> np.ndarray:
    """Of a set of n tokens: all but the least overlap that a link needs, and one."""
    return n - -(-percent * n // 100) + (n > 0)


def sketches(documents: DataFrame, width: int, percent: int) -> DataFrame:
    """(doc_id, h, node, n, prefix, bits) of each row; h stands for its text, node is the key of the set,
    null for an empty one."""
    tokens, classes = common_shingles(documents, width)

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            offsets, hashes = shingle_sets(batch.column(2).to_pylist(), width)
            n = np.diff(offsets)
            owner = np.repeat(np.arange(len(n)), n)
            cls = np.zeros(len(hashes), "i8")
            if len(tokens):
                at = np.minimum(np.searchsorted(tokens, hashes), len(tokens) - 1)
                known = tokens[at] == hashes
                cls[known] = classes[at[known]]
            order = np.lexsort((hashes, cls, owner))
            place = np.arange(len(hashes)) - np.repeat(offsets[:-1], n)
            lengths = prefix_length(n, percent)
            prefix = hashes[order][place < np.repeat(lengths, n)]
            ends = np.concatenate([[0], np.cumsum(lengths)]).astype("i4")
            keys = pa.array(set_keys(offsets, hashes), mask=n == 0)
            words, begins = parities(hashes, n)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), keys, pa.array(n), pa.ListArray.from_arrays(pa.array(ends), pa.array(prefix.view("i8"))),
                    pa.ListArray.from_arrays(pa.array(begins.astype("i4")), pa.array(words.view("i8"))),
                ],
                ["doc_id", "h", "node", "n", "prefix", "bits"],
            )

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("h"), "text")
    return rows.mapInArrow(sketched, "doc_id long, h long, node long, n long, prefix array<long>, bits array<long>")


def text_key() -> Column:
    """With the id, what tells a row from those of other texts."""
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def parities(hashes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, offsets): each set's bitmap of at least n bits, a power of two and at least one word."""
    sizes = 1 << np.maximum(0, np.ceil(np.log2(np.maximum(n, 1) / 64)).astype("i8"))
    begins = np.concatenate([[0], np.cumsum(sizes)])
    words = np.zeros(begins[-1], "u8")
    low = hashes & np.repeat((sizes * 64 - 1).astype("u8"), n)
    at = np.repeat(begins[:-1], n) + (low >> np.uint64(6)).astype("i8")
    np.bitwise_xor.at(words, at, np.uint64(1) << (low & np.uint64(63)))
    return words, begins


def differing_bits(a: str, b: str) -> Column:
    """In how many bits two bitmaps differ, the longer one folded onto the shorter."""
    m = F.least(F.size(a), F.size(b))
    xor = lambda x, y: x.bitwiseXOR(y)
    fold = lambda x: F.when(F.size(x) > m, F.zip_with(F.slice(x, F.lit(1), m), F.slice(x, m + 1, m), xor)).otherwise(F.col(x))
    return F.aggregate(F.zip_with(fold(a), fold(b), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def shared_tokens(sketch: DataFrame) -> DataFrame:
    """(token, node, pivot): prefix tokens that several nodes have, with the smallest of these nodes.

    Equal tokens are sorted next to each other and streamed, so no token is ever held whole.
    """

    def stars(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, pivot, seen, told = None, None, None, False
        for batch in batches:
            if not len(batch):
                continue
            token, node = batch["token"].to_numpy(), batch["node"].to_numpy()
            new = np.ones(len(token), bool)
            new[1:] = token[1:] != token[:-1]
            new[0] = last is None or token[0] != last
            group = np.cumsum(new) - 1 + (not new[0])
            firsts = node[new] if new[0] else np.concatenate([np.array([pivot], "i8"), node[new]])
            pivots = firsts[group]
            before = np.concatenate([np.array([node[0] if new[0] else seen], "i8"), node[:-1]])
            fresh = ~new & (node != before)
            out_token, out_node, out_pivot = token[fresh], node[fresh], pivots[fresh]
            # The pivot itself is told once, with the first other node of its token.
            first_of = np.unique(group[fresh], return_index=True)[1] if fresh.any() else np.zeros(0, "i8")
            first_of = np.array([i for i in first_of if not (told and group[fresh][i] == 0 and not new[0])], "i8")
            yield pd.DataFrame(
                {
                    "token": np.concatenate([out_token, out_token[first_of]]),
                    "node": np.concatenate([out_node, out_pivot[first_of]]),
                    "pivot": np.concatenate([out_pivot, out_pivot[first_of]]),
                }
            )
            ended = group[-1]
            told = bool((group[fresh] == ended).any()) or (told and ended == 0 and not new[0])
            last, pivot, seen = token[-1], firsts[ended], node[-1]

    rows = sketch.filter("node is not null and doc_id is not null").select("node", F.explode("prefix").alias("token"))
    dealt = rows.repartition("token").sortWithinPartitions("token", "node").select("token", "node")
    return dealt.mapInPandas(stars, "token long, node long, pivot long")


def components(edges: DataFrame) -> DataFrame:
    """(id, label): the smallest id reachable, for each id in edges (a, b)."""
    both = written(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("a"), F.min("b")).alias("label"))
    labels = written(labels, "labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        lower = labels.join(near, "id").select("id", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = lower.join(labels.select(F.col("id").alias("label"), F.col("label").alias("further")), "label")
        fresh = written(jump.select("id", "old", F.least("label", "further").alias("label")), "labels")
        labels = fresh.select("id", "label")
        if not fresh.filter("label <> old").limit(1).count():
            return labels


def needed_sets(documents: DataFrame, sketch: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """(node, n, tokens): the sets of ``nodes``, hashed again from one text of each.

    The texts are chosen by a broadcast of their ids while these are at most BROADCAST_IDS, so no
    text is shuffled; beyond, by a shuffled join.
    """
    chosen = sketch.filter("doc_id is not null").join(nodes.distinct(), "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    chosen = written(chosen, "chosen")
    ids = F.broadcast(chosen) if chosen.count() <= BROADCAST_IDS else chosen
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(ids, "doc_id").select("node", "text")

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, 500):
            offsets, hashes = shingle_sets(batch.column(1).to_pylist(), width)
            keys = set_keys(offsets, hashes)
            tokens = pa.ListArray.from_arrays(pa.array(offsets.astype("i4")), pa.array(hashes.view("i8")))
            # Repeated ids: only the text with the set that is asked for.
            wanted = pa.array(keys == batch.column(0).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.diff(offsets)), tokens], ["node", "n", "tokens"]).filter(wanted)

    return rows.mapInArrow(again, "node long, n long, tokens array<long>")


def compatible(a: str, b: str, percent: int):
    """Whether sets of these sizes can be similar enough."""
    return F.expr(f"100 * least({a}, {b}) >= {percent} * greatest({a}, {b})")


def may_link(percent: int) -> Column:
    """Whether the parity bound lets sets of n and other_n shingles that differ in ``apart`` bits link."""
    return F.expr(f"{100 + percent} * apart <= {100 - percent} * (n + other_n)")


def links(percent: int) -> Column:
    return F.expr(f"100 * same >= {percent} * (n + other_n - same)")


def best_pivots(shared: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """(node, pivot): of the pivots a node meets and may link with, that with the fewest differing bits."""
    met = shared.filter("node <> pivot").select("node", "pivot").distinct()
    sizes = nodes.select("node", "n")
    met = met.join(sizes, "node").join(sizes.select(F.col("node").alias("pivot"), F.col("n").alias("other_n")), "pivot").filter(compatible("n", "other_n", percent))
    met = met.join(nodes.select("node", "bits"), "node").join(nodes.select(F.col("node").alias("pivot"), F.col("bits").alias("other_bits")), "pivot")
    met = met.withColumn("apart", differing_bits("bits", "other_bits")).filter(may_link(percent))
    return met.groupBy("node").agg(F.min(F.struct("apart", "pivot")).alias("best")).select("node", "best.pivot")


def pivot_links(best: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): nodes linked with their pivot."""
    both = best.join(sets, "node").join(sets.select(F.col("node").alias("pivot"), F.col("n").alias("other_n"), F.col("tokens").alias("others")), "pivot")
    return both.withColumn("same", F.size(F.array_intersect("tokens", "others"))).filter(links(percent)).select(F.col("node").alias("a"), F.col("pivot").alias("b"))


def families(shared: DataFrame) -> DataFrame:
    """(node, grp): the pivot that a node meets most often, the smaller on ties; one that meets none is
    its own."""
    met = shared.groupBy("node", "pivot").agg(F.sum((F.col("node") != F.col("pivot")).cast("int")).alias("met"))
    return met.groupBy("node").agg(F.min(F.struct((-F.col("met")).alias("m"), "pivot")).alias("best")).select("node", F.col("best.pivot").alias("grp"))


def opened_chunks(shared: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """(query, query_comp, query_n, grp, chunk): nodes and the chunks that the token-group matrix lets them open.

    groups: (node, n, comp, grp, size). A pair is tried once, from its larger node.
    """
    members = shared.select("token", "node").distinct().join(groups, "node")
    still_open = members.groupBy("token").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low <> high").select("token")
    members = written(members.join(still_open, "token").withColumn("chunk", chunk_of()), "open-tokens")
    bounds = [F.min("n").alias("low"), F.max("n").alias("high"), F.min("node").alias("first"), F.min("comp").alias("comp_low"), F.max("comp").alias("comp_high")]
    matrix = members.groupBy("token", "grp", "chunk").agg(*bounds)
    asking = members.select("token", F.col("node").alias("query"), F.col("n").alias("query_n"), F.col("comp").alias("query_comp"))
    fits = F.expr(f"first < query and not (comp_low = query_comp and comp_high = query_comp) and {percent} * low <= 100 * query_n and 100 * high >= {percent} * query_n")
    return asking.join(matrix, "token").filter(fits).select("query", "query_comp", "query_n", "grp", "chunk").distinct()


def chunk_of() -> Column:
    return F.pmod(F.xxhash64("node"), F.ceil(F.col("size") / CHUNK_SETS)).cast("int")


def in_parts(opened: DataFrame, held: DataFrame, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Held rows and queries by (grp, chunk, part): at most some 512 queries, of some PART_TOKENS together, meet a
    chunk in one part."""
    parts = opened.groupBy("grp", "chunk").agg(F.ceil(F.greatest(F.count("*") / 512, F.sum("query_n") / PART_TOKENS)).cast("int").alias("parts"))
    held = held.join(parts, ["grp", "chunk"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    queries = queries.join(parts, ["grp", "chunk"]).withColumn("part", F.pmod(F.xxhash64("query"), F.col("parts")).cast("int")).drop("parts")
    # Aliases: both sides come from the same tables.
    return tuple(df.select(*[F.col(c).alias(c) for c in df.columns]).groupBy("grp", "chunk", "part") for df in (held, queries))


def surviving(opened: DataFrame, groups: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """(query, query_comp, grp, chunk, node, comp): pairs in opened chunks that the parity bound lets link."""
    wanted = opened.select("grp", "chunk").distinct()
    held = groups.withColumn("chunk", chunk_of()).join(wanted, ["grp", "chunk"], "left_semi").select("node", "comp", "grp", "chunk").join(nodes.select("node", "n", "bits"), "node")
    queries = opened.drop("query_n").join(nodes.select(F.col("node").alias("query"), "n", "bits"), "query")

    def folded(words: np.ndarray) -> np.ndarray:
        half = words.shape[-1] // 2
        return words[..., :half] ^ words[..., half:]

    def compare(own: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        # Plain arrays, one each a query with hits: many small frames would hold far more memory.
        hits: list[np.ndarray] = []
        asked: list[tuple[int, int, int]] = []
        if len(own) and len(queries):
            widths = own["bits"].map(len).to_numpy()
            sizes, ids, comps = (own[c].to_numpy() for c in ("n", "node", "comp"))
            stacks = {int(w): (np.flatnonzero(widths == w), np.stack(own["bits"][widths == w].to_numpy()).view("u8")) for w in np.unique(widths)}
            stacks = {w: (rows, words, folded(words) if w > 1 else None) for w, (rows, words) in stacks.items()}
            for query, query_comp, n, bits in zip(queries["query"], queries["query_comp"], queries["n"], queries["bits"], strict=True):
                mine = np.asarray(bits).view("u8")
                w = len(mine)
                for width in (w, w * 2, w // 2):  # other sizes are too unlike to link
                    if width not in stacks:
                        continue
                    rows, words, halved = stacks[width]
                    a, b = (mine, words) if width == w else (mine, halved) if width > w else (folded(mine), words)
                    apart = np.bitwise_count(a ^ b).sum(axis=1, dtype="i8")
                    fine = ((100 + percent) * apart <= (100 - percent) * (sizes[rows] + n)) & (ids[rows] < query) & (comps[rows] != query_comp)
                    fine &= 100 * np.minimum(sizes[rows], n) >= percent * np.maximum(sizes[rows], n)
                    if fine.any():
                        hits.append(rows[fine])
                        asked.append((query, query_comp, len(hits[-1])))
        if not hits:
            return pd.DataFrame({c: pd.Series(dtype="i8") for c in ("query", "query_comp", "grp", "chunk", "node", "comp")})
        hit, of = np.concatenate(hits), np.array(asked, "i8")
        times = of[:, 2]
        return pd.DataFrame(
            {"query": np.repeat(of[:, 0], times), "query_comp": np.repeat(of[:, 1], times), "grp": own["grp"].iloc[0], "chunk": own["chunk"].iloc[0], "node": ids[hit], "comp": comps[hit]}
        )

    left, right = in_parts(opened, held, queries)
    return left.cogroup(right).applyInPandas(compare, "query long, query_comp long, grp long, chunk int, node long, comp long")


def group_links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): links between components, from surviving pairs' texts compared exactly."""
    held = pairs.select("grp", "chunk", "node", "comp").distinct().join(sets.select("node", "tokens"), "node")
    opened = pairs.select("grp", "chunk", "query", "query_comp").distinct().join(sets.select(F.col("node").alias("query"), F.col("n").alias("query_n")), "query")
    queries = opened.drop("query_n").join(sets.select(F.col("node").alias("query"), "tokens"), "query")

    def compare(own: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        found: set[tuple] = set()
        if len(own) and len(queries):
            held, comps = [np.asarray(t) for t in own["tokens"]], own["comp"].to_numpy()
            union, where = np.unique(np.concatenate(held), return_inverse=True)
            holder = np.repeat(np.arange(len(held)), [len(t) for t in held])
            holder, ends = holder[np.argsort(where, kind="stable")], np.cumsum(np.bincount(where, minlength=len(union)))
            lengths = np.array([len(t) for t in held])
            for query_comp, tokens in zip(queries["query_comp"], queries["tokens"], strict=True):
                x = np.asarray(tokens)
                at = np.minimum(np.searchsorted(union, x), len(union) - 1)
                at = at[union[at] == x]
                if 100 * len(at) < percent * len(x):
                    continue  # the union holds too few of its tokens
                begins = np.where(at > 0, ends[at - 1], 0)
                runs = ends[at] - begins
                picks = np.repeat(begins - np.concatenate([[0], np.cumsum(runs)[:-1]]), runs) + np.arange(runs.sum())
                same = np.bincount(holder[picks], minlength=len(held))
                linked = 100 * same >= percent * (lengths + len(x) - same)
                found |= {(int(query_comp), int(c)) for c in np.unique(comps[linked]) if c != query_comp}
        return pd.DataFrame(sorted(found), columns=["a", "b"]).astype("i8")

    left, right = in_parts(opened, held, queries)
    return left.cogroup(right).applyInPandas(compare, "a long, b long").distinct()


def rooted(documents: DataFrame, width: int, percent: int) -> DataFrame:
    """(doc_id, h, n, root) of each row; linked rows have one root, a text without shingles none."""
    if not 50 <= percent <= 100:
        raise ValueError("a link needs 50 to 100 percent: bitmaps of less similar sets are not compared")
    sketch = written(sketches(documents, width, percent), "sketches")
    shared = written(shared_tokens(sketch), "shared")
    playing = shared.select("node").distinct()
    nodes = sketch.filter("doc_id is not null").join(playing, "node", "left_semi").groupBy("node").agg(F.first("n").alias("n"), F.first("bits").alias("bits"))
    nodes = written(nodes, "nodes")
    best = written(best_pivots(shared, nodes, percent), "best-pivots")
    sets = written(needed_sets(documents, sketch, best.select("node").union(best.select("pivot")), width), "sets")
    labels = components(written(pivot_links(best, sets, percent), "star-links"))
    grouped = nodes.select("node", "n").join(labels.select(F.col("id").alias("node"), "label"), "node", "left").join(families(shared), "node")
    grouped = grouped.select("node", "n", F.coalesce("label", "node").alias("comp"), "grp")
    # The number of sets, or of sets' worth of tokens where these are long.
    counts = grouped.groupBy("grp").agg(F.greatest(F.count("*"), F.ceil(F.sum("n") / (CHUNK_TOKENS // CHUNK_SETS))).alias("size"))
    groups = written(grouped.join(counts, "grp").select("node", "n", "comp", "grp", "size"), "groups")
    opened = written(opened_chunks(shared, groups, percent), "opened")
    pairs = written(surviving(opened, groups, nodes, percent), "surviving")
    more = written(needed_sets(documents, sketch, pairs.select("node").union(pairs.select("query")), width), "sets")
    merged = components(written(group_links(pairs, more, percent), "group-links"))
    final = groups.join(merged.select(F.col("id").alias("comp"), "label"), "comp", "left").select("node", F.coalesce("label", "comp").alias("root"))
    # A node that shares nothing is its own root.
    rows = sketch.select("doc_id", "h", "node", "n").join(final, "node", "left")
    return written(rows.select("doc_id", "h", "n", F.when(F.col("node").isNotNull(), F.coalesce("root", "node")).alias("root")), "rooted")


def joined(documents: DataFrame, width: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of documents. Rows without an id have no component."""
    rows = rooted(documents, width, percent)
    least = rows.filter("root is not null").groupBy("root").agg(F.min("doc_id").alias("least"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id"))
    return rows.join(least, "root", "left").select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def one_of_each(documents: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of documents, as they are, but one row of each group of linked ones: that of the smallest
    id (rows without one come last, those of a repeated id in the order of their texts' hashes).

    Decided by row, not by id. Texts without words all stay; so do rows equal in id and text to the
    one kept. A row without an id is linked by an equal set of shingles only.
    """
    rows = rooted(documents, width, percent).filter("root is not null").withColumn("rank", F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "h"))
    best = rows.groupBy("root").agg(F.min("rank").alias("best"))
    gone = rows.join(best, "root").filter("rank <> best").select(F.col("doc_id").alias("__id"), F.col("h").alias("__h")).distinct()
    return documents.join(gone, documents["doc_id"].cast("long").eqNullSafe(F.col("__id")) & (text_key() == F.col("__h")), "left_anti")
