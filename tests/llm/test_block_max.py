"""Block-Max MaxScore against all documents scored one by one."""

import math
import random
import re
from collections import Counter

import numpy as np

from outways.llm import block_max

TERM = re.compile("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute_force(documents, items, k=20):
    """(item_id, rank, doc_id, score), by the rule as it is stated."""
    docs = [(d, Counter(TERM.findall(t.translate(LOWER)))) for d, t in documents if d is not None and t]
    docs = [(d, c) for d, c in docs if c]
    n_docs, n_words = len(docs), sum(c.total() for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    asked = {}
    for i, t in items:
        if i is not None:
            asked.setdefault(i, Counter()).update(TERM.findall((t or "").translate(LOWER)))
    out = []
    for item, terms in asked.items():
        scored = []
        for d, c in docs:
            m = 100 - 25 + 25 * c.total() * n_docs // n_words
            score = sum(times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m)) for t, times in terms.items() if c[t])
            if score > 0:
                scored.append((-score, d))
        out += [(item, r, d, -s) for r, (s, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


def words(rnd, n, vocabulary):
    return " ".join(f"w{min(int(rnd.expovariate(0.05)), vocabulary)}" for _ in range(n))


def shard_lists(texts):
    """(lists by term, norms, doc ids) of one shard, as a task of the search has them."""
    shard = block_max.Shard()
    for doc_id, text in texts:
        shard.add(doc_id, text.encode())
    rows = shard.rows(0).to_pylist()
    documents = next(r for r in rows if r["term"] is None)
    n_docs, n_words = documents["df"], documents["words"]
    norm = lambda n: 75 + 25 * n * n_docs // n_words
    lists = {}
    for r in rows:
        if r["term"] is not None:
            weight = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * r["df"] + 1)))
            lists[r["term"]] = block_max.Postings(weight, r["df"], r["lasts"], r["widths"], np.array(r["peaks"]), r["peak_tf"], r["peak_n"], r["body"], norm)
    return lists, norm(np.array(documents["lengths"])), documents["doc_ids"]


def test_search_of_a_shard_skips_blocks_and_loses_nothing():
    rnd = random.Random(5)
    texts = [(i * 7 % 4001, words(rnd, rnd.randint(1, 60), 90)) for i in range(4001)]
    texts += [(i - 100, f"rare{i % 2} " + words(rnd, 10, 90)) for i in range(60)]
    items = [(0, "rare1 w0 w1 w2"), (1, "w80 w0 w3"), (2, "w0 w0 w1"), (3, "rare0 rare1 w5 w6"), (4, "rare0 w1 w1")]
    lists, m, doc_ids = shard_lists(texts)
    found, read = [], 0
    for item, text in items:
        for p in lists.values():
            p.read.clear()
        asked = [(lists[t], n) for t, n in Counter(text.split()).items() if t in lists]
        found += [(item, rank, doc_ids[d], s) for rank, (s, d) in enumerate(block_max.best(asked, m, 20, stretch=256), 1)]
        read += sum(len(p.read) for p, _ in asked)
    assert sorted(found) == brute_force(texts, items)
    total = sum(len(lists[t].lasts) for _, text in items for t in set(text.split()))
    assert read < 0.7 * total, (read, total)


def test_blocks_hold_wide_numbers():
    texts = [(0, "a " * 70_000), *((i, "b") for i in range(1, 70_000)), (70_001, "a a"), (70_002, "b " * 300)]
    lists, m, _ = shard_lists(texts)
    docs, _ = lists["a"].block(0, m)
    assert docs.tolist() == [0, 70_000]
    assert sum(len(lists["b"].block(b, m)[0]) for b in range(len(lists["b"].lasts))) == 70_000
    for p in lists.values():
        for b in range(len(p.lasts)):
            assert p.block(b, m)[1].max() == p.maxima[b]


def test_random_shards_with_ties_and_repeats():
    rnd = random.Random(6)
    for _ in range(30):
        texts = [(rnd.randint(0, 30), words(rnd, rnd.randint(0, 6), 8)) for _ in range(rnd.randint(1, 300))]
        if not any(t for _, t in texts):
            continue
        lists, m, doc_ids = shard_lists(texts)
        item = words(rnd, 5, 10)
        asked = [(lists[t], n) for t, n in Counter(item.split()).items() if t in lists and lists[t].weight > 0]
        got = [(0, r, doc_ids[d], s) for r, (s, d) in enumerate(block_max.best(asked, m, 20, stretch=16), 1)] if asked else []
        assert got == brute_force(texts, [(0, item)])


def test_ranked_on_odd_rows(spark):
    rnd = random.Random(7)
    texts = [(i // 2, words(rnd, rnd.randint(1, 30), 40).upper()) for i in range(300)]
    texts += [(400, None), (401, ""), (402, " .,\n"), (None, "w1 w2"), (403, "Ärger ärger É w1\0w2"), (404, "w3 " * 50_000)]
    items = [(1, "w1 w2 W2"), (2, None), (3, ""), (4, "nothing here"), (1, "w9"), (None, "w1"), (5, "Ärger É"), (6, "w3")]
    documents = spark.createDataFrame([(d, t, t, 1) for d, t in texts], "doc_id long, text string, term string, df int").repartition(5)
    asked = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, block int")
    assert sorted(map(tuple, block_max.ranked(documents, asked).collect())) == brute_force(texts, items)
    assert block_max.ranked(documents.limit(0), asked).count() == 0
    assert block_max.ranked(documents, asked.limit(0)).count() == 0
