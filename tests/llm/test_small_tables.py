"""Each operator on tiny tables: nulls, empty and long texts, ties, repeated rows, empty tables, extra columns."""

import hashlib
import random
import re
import zlib
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from outways.llm import forest_search, host_reputation, jaccard_groups, multiset_hash, packing, pfair_mix, quality_rules, site_templates, toxic_grammar, warc_fixity

DOC = "doc_id long, text string, lang string, source string, n_chars long, label string, `__row` int"


def docs(spark, *texts, sources=None):
    rows = [(i if isinstance(t, (str, type(None))) else t[0], t if isinstance(t, (str, type(None))) else t[1], "en", (sources or ["a", "b", None])[i % 3], None, "clash", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOC)


# --- 1: fixity ---


def pages(spark, *rows):
    return spark.createDataFrame([(i, f"http://h/{i}", r) for i, r in rows], "page_id long, url string, html string")


def test_audit_finds_altered_missing_and_added(spark):
    own = pages(spark, *[(i, f"body {i}" * (i % 5)) for i in range(300)], (None, "lone"), (7, "twice"))
    other = pages(spark, *[(i, ("X" if i == 42 else "") + f"body {i}" * (i % 5)) for i in range(300) if i != 199], (None, "lone"), (7, "twice"), (999, None))
    got = {(r["page_id"], r["status"]) for r in warc_fixity.audit(own, other, fanout=32).collect()}
    assert got == {(42, "altered"), (199, "missing"), (999, "added")}
    none = spark.createDataFrame([], own.schema)
    assert warc_fixity.audit(none, none).count() == 0
    few = own.filter("page_id < 20")
    assert warc_fixity.audit(few, none, fanout=4).filter("status = 'missing'").count() == 21


def test_audit_offsets_are_byte_places(spark):
    own = pages(spark, (0, "é"), (1, "bb"), (2, "c"))
    other = pages(spark, (0, "é"), (1, "bx"), (2, "c"))
    row = warc_fixity.audit(own, other).collect()[0]
    size = lambda i, body: len(f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: http://h/{i}\r\nContent-Length: {len(body.encode())}\r\n\r\n{body}\r\n\r\n".encode())
    assert (row["page_id"], row["offset"], row["bytes"]) == (1, size(0, "é"), size(1, "bb"))


# --- 2: multiset hash ---


def test_edited_texts_and_equality(spark):
    texts = ["a b c d e f g h", None, "", "p\nq\nr", "q\nr\np", "a b c d e f g h", "é" * 400]
    frame = docs(spark, *texts)
    got = {r["doc_id"]: r for r in multiset_hash.edited_fingerprints(frame, width=2).collect()}
    full = [t or "" for t in texts]
    for i, t in enumerate(full):
        k = len(t) // 4
        edited = t[: len(t) - k] + full[(i + 1) % len(full)][:k]
        assert got[i]["n_chars"] == len(t)
        assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
    prints = [got[i]["fingerprint"] for i in range(len(texts))]
    assert prints[0] == prints[5] and prints[1] == prints[2] and prints[3] == prints[4] and len(set(prints)) == 4
    assert got[1]["near_next"] == 1.0 and got[2]["near_next"] == 0.0 and got[3]["near_next"] == 1.0
    assert all(0 <= r[c] <= 1 for r in got.values() for c in ("near_edited", "near_next"))


def test_multiset_hash_odd_rows(spark):
    frame = docs(spark, (3, "x y"), (3, "x y"), (None, "abcd"), (-600, "z"))
    got = multiset_hash.edited_fingerprints(frame).collect()
    assert len(got) == 4
    lone = next(r for r in got if r["doc_id"] is None)
    assert lone["edited_sha256"] == hashlib.sha256(b"abc").hexdigest() and lone["near_next"] == 0.0
    assert multiset_hash.edited_fingerprints(docs(spark, "x").limit(0)).count() == 0


def test_paragraph_sums_add_up(spark):
    """Deleting a paragraph subtracts its vector."""
    frame = spark.createDataFrame([(1, "one two\nthree"), (2, "one two"), (3, "three")], "id int, text string")
    c = {r["id"]: r for r in multiset_hash.fingerprints(frame, ["id"], "text").collect()}
    assert [x - y for x, y in zip(c[1]["counters"], c[3]["counters"])] == c[2]["counters"]
    lanes = lambda r: np.array([int(r["fingerprint"][i : i + 8], 16) for i in range(0, 64, 8)])
    assert ((lanes(c[1]) - lanes(c[3])) % 2**32 == lanes(c[2])).all()


def test_near_copies_are_alike_after_an_inserted_word(spark):
    rnd = random.Random(2)
    text = [f"w{rnd.randrange(900)}" for _ in range(200)]
    solid = "".join(rnd.choices("abcdefghij", k=600))
    frame = docs(spark, " ".join(text), " ".join(["more", *text]), " ".join(f"v{i}" for i in range(200)), solid, solid[:30] + "x" + solid[30:])
    got = {r["doc_id"]: r["near_next"] for r in multiset_hash.edited_fingerprints(frame).collect()}
    assert got[0] > 0.9 and got[3] > 0.8 and got[1] < 0.5


def test_lanes_of_a_paragraph_have_a_hash_each(spark):
    frame = spark.createDataFrame([("a",)], "t string")
    seeded = frame.select(F.shiftrightunsigned(F.xxhash64(F.lit(1), "t"), 0).alias("h")).first()["h"] & 0xFFFFFFFF
    lanes = frame.select(multiset_hash.equality_lanes(F.array("t")).alias("x")).first()["x"]
    assert int(lanes[16:24], 16) == seeded


# --- 3: mixing ---


def test_mixed_returns_the_rows_as_they_are(spark):
    frame = docs(spark, "a", None, "b", (2, "b"), (None, "c"))
    mixed = pfair_mix.mixed(frame, block_chars=1)
    assert mixed.columns == frame.columns
    assert sorted(map(str, mixed.collect())) == sorted(map(str, frame.collect()))


# --- 4: packing ---


def test_cut_shortens_the_first_piece():
    assert packing.cut(5, 4) == [(0, 1), (1, 4)] and packing.cut(8, 4) == [(0, 4), (4, 4)] and packing.cut(4, 4) == [(0, 4)]


def test_local_search_only_improves():
    rnd = random.Random(1)
    for _ in range(30):
        lengths = [rnd.randrange(1, 100) for _ in range(rnd.randrange(1, 60))]
        bins = packing.best_fit(lengths, 100)
        better = packing.improved(bins, lengths, 100)
        assert sorted(i for b in better for i in b) == list(range(len(lengths)))
        assert max(sum(lengths[i] for i in b) for b in better) <= 100
        assert len(better) <= len(bins)


def test_search_empties_a_bin_that_best_fit_left():
    lengths = [60, 50, 50, 40]
    assert len(packing.improved([[0], [1], [2], [3]], lengths, 100)) == 2


def test_packed_documents(spark):
    from tokenizers import Tokenizer
    import public_tokenizers

    texts = ["Hello world, this is it. " * 30, None, "", "short", "x <|endoftext|> y", "wörter " * 900]
    got = packing.packed_documents(docs(spark, *texts, (3, "short"), (None, "no id")), capacity=64).collect()
    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for i, t in enumerate(texts):
        ids = np.array([*exact.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4")
        own = sorted((r for r in got if r["doc_id"] == i), key=lambda r: r["start"])
        for r in own:
            assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
        assert sum(r["length"] for r in own) == len(ids) * (2 if i == 3 else 1)
    fill = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == fill.get(r["sequence_id"], 0)
        fill[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(fill.values()) <= 64 and len(fill) == -(-sum(fill.values()) // 64)
    assert packing.packed_documents(docs(spark, "x").limit(0)).count() == 0


# --- 5: Jaccard join ---


def components_of(texts, width, percent):
    sets = []
    for t in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if len(words) >= width else ({tuple(words)} if words else set()))
    root = list(range(len(texts)))
    for i, j in combinations(range(len(texts)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
            a, b = root[i], root[j]
            root = [min(a, b) if r in (a, b) else r for r in root]
    return [len(s) for s in sets], root


@pytest.mark.parametrize(("width", "percent"), [(4, 85), (5, 80), (1, 50)])
def test_join_equals_all_pairs(spark, width, percent, monkeypatch):
    monkeypatch.setattr(jaccard_groups, "CHUNK_SETS", 3)
    rnd = random.Random(width)
    words = [f"w{i}" for i in range(400)]
    texts = [None, "", " \t", "One", "one", "ONE two", "É x", "é x"]
    passage = " ".join(rnd.choices(words, k=30))
    for _ in range(12):
        base = rnd.choices(words, k=rnd.randrange(5, 120))
        for _ in range(rnd.randrange(1, 9)):
            copy = list(base)
            for _ in range(rnd.randrange(0, 4)):
                copy[rnd.randrange(len(copy))] = rnd.choice(words)
            texts.append(" ".join(copy) + (" " + passage if rnd.random() < 0.4 else ""))
    sizes, roots = components_of(texts, width, percent)
    got = {r["doc_id"]: r for r in jaccard_groups.joined(docs(spark, *texts), width, percent).collect()}
    assert [got[i]["n_shingles"] for i in range(len(texts))] == sizes
    assert [got[i]["component_id"] for i in range(len(texts))] == roots


def test_join_odd_rows(spark):
    frame = docs(spark, (4, "a b c d e"), (4, "a b c d e"), (None, "a b c d e"), (9, "a b c d e"), (2, None))
    got = sorted((str(r["doc_id"]), str(r["component_id"])) for r in jaccard_groups.joined(frame).collect())
    assert got == [("2", "2"), ("4", "4"), ("4", "4"), ("9", "4"), ("None", "None")]
    assert sorted(str(r["doc_id"]) for r in jaccard_groups.one_of_each(frame).collect()) == ["2", "4", "4"]
    assert jaccard_groups.joined(frame.limit(0)).count() == 0


# --- 6: nearest neighbours ---


def test_search_of_all_leaves_is_exact(spark):
    rng = np.random.default_rng(1)
    vectors = rng.standard_normal((230, 6)).round(1)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(vectors)] + [(900, [1.0] * 6, 0), (901, [1.0] * 6, 0), (902, None, 0), (903, [0.0] * 6, 0), (904, [float("nan")] * 6, 0), (905, [1.0], 0), (906, [1.0, None, 1.0, 1.0, 1.0, 1.0], 0), (907, [float("inf")] * 6, 0)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    kept = {i: np.array(v, dtype="f4").astype("f8") for i, v, _ in rows if i < 902}
    got = forest_search.searched(frame, frame.filter("vec_id % 100 = 0"), k=5, share=1e9).collect()
    for q in (0, 100, 200, 900):
        want = sorted((float(np.sqrt(((kept[q] - v) ** 2).sum())), i) for i, v in kept.items() if i != q)[:5]
        own = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [(r["score"], r["vec_id"]) for r in own] == want
    assert forest_search.searched(frame.limit(0), frame.limit(0)).count() == 0
    two = frame.filter("vec_id < 2")
    assert forest_search.searched(two, two.filter("vec_id = 0")).count() == 1


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((20, 16))
    vectors = centres[rng.integers(20, size=4000)] + 0.4 * rng.standard_normal((4000, 16))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    got = forest_search.searched(frame, frame.filter("vec_id % 100 = 0"), share=0.5).collect()
    hits = 0
    for q in range(0, 4000, 100):
        d = np.sqrt(((vectors - vectors[q]) ** 2).sum(1))
        d[q] = np.inf
        hits += len(set(np.argsort(d)[:10].tolist()) & {r["vec_id"] for r in got if r["query_id"] == q})
    assert hits / 400 >= 0.9


# --- 7: host reputation ---


def test_rules_hosts_and_paths(spark):
    urls = ["https://WWW.Example.COM/en/1?x#y", "http://blog.example.com/en/2", "http://a.com", "http://a.net/es/x", "http://a.net/fr", None, "no scheme", "https://x.org#f", "ftp://com/", "http://notexample.com/en/"]
    frame = spark.createDataFrame([(i, u, "") for i, u in enumerate(urls)], "page_id long, url string, html string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = [tuple(r) for r in host_reputation.judged_pages(frame, labels).select("page_id", "host", "path", "rule", "verdict").orderBy("page_id").collect()]
    assert got == [
        (0, "www.example.com", "/en/1", "www.example.com/en/", "allow"), (1, "blog.example.com", "/en/2", "example.com/en/", "block"), (2, "a.com", "", None, got[2][4]),
        (3, "a.net", "/es/x", "net/es/", "block"), (4, "a.net", "/fr", None, got[4][4]), (5, "", "", None, got[5][4]), (6, "", "", None, got[6][4]), (7, "x.org", "", None, got[7][4]),
        (8, "com", "/", "com/", "allow"), (9, "notexample.com", "/en/", "com/", "allow"),
    ]


def test_bad_hosts_are_blocked_and_thin_ones_shrunk(spark):
    rows = [(f"bad{i % 3}.spam.org", 1) for i in range(90)] + [(f"good{i % 5}.fine.org", 0) for i in range(300)] + [("new.fine.org", 1), ("new.spam.org", 0)]
    got = {r["host"]: r for r in host_reputation.reputations(spark.createDataFrame(rows, "host string, bad int")).collect()}
    assert got["bad0.spam.org"]["lower"] > 0.5 and got["good0.fine.org"]["lower"] < 0.05
    assert got["new.fine.org"]["mean"] < 0.6 and got["new.spam.org"]["mean"] > got["good1.fine.org"]["mean"]
    assert got[None]["n"] == 0


def test_hosts_without_labels_fall_back_level_by_level(spark):
    urls = [f"http://bad{i % 3}.spam.org/d/{i}" for i in range(90)] + [f"http://good{i % 5}.fine.org/d/{i}" for i in range(90, 390)] + [f"http://x{i % 2}.ok.dev/d/{i}" for i in range(390, 490)]
    urls += ["http://new.spam.org/p", "http://new.fine.org/p", "http://other.org/p", "http://a.b.zz/p", None]
    frame = spark.createDataFrame([(i, u, "") for i, u in enumerate(urls)], "page_id long, url string, html string")
    labels = spark.createDataFrame([(i, int(i >= 90), 0) for i in range(490)], "doc_id long, quality int, toxic int")
    got = {r["host"]: r for r in host_reputation.judged_pages(frame, labels).collect()}
    assert got["new.spam.org"]["verdict"] == "block" and got["new.fine.org"]["verdict"] == "allow" and got["new.spam.org"]["n_labelled"] == 0
    corpus = round(90.5 / 491, 6)
    assert got["a.b.zz"]["bad_rate"] == got[""]["bad_rate"] == corpus
    assert got["new.fine.org"]["bad_rate"] < corpus < got["other.org"]["bad_rate"] < got["new.spam.org"]["bad_rate"]


# --- 8 and 9: classifiers ---


def labelled(spark, n=400, toxic=False):
    rnd = random.Random(8)
    words = [f"{a}{b}" for a in ("ta", "re", "mo", "li") for b in ("na", "ku", "so", "vi", "pe")]
    texts, labels = [], []
    for i in range(n):
        text = [rnd.choice(words) for _ in range(rnd.randrange(3, 60))]
        good = rnd.random() < 0.6
        if not good:
            text = [w.upper() + "!!" for w in text] if not toxic else [*text[:2], "idiot", *text[2:], "you", "moron"]
        texts.append(" ".join(text) + ".")
        labels.append((i, int(good), int(not good)))
    return docs(spark, *texts), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize(("module", "column", "toxic"), [(quality_rules, "quality", False), (toxic_grammar, "toxic", True)])
def test_held_out_accuracy(spark, module, column, toxic):
    frame, labels = labelled(spark, toxic=toxic)
    got = module.scored(frame, labels).join(labels, "doc_id").filter("held_out").collect()
    assert len(got) > 40 and sum(r["predicted"] == r[column] for r in got) / len(got) > 0.95
    kept = module.kept(frame, labels)
    assert kept.columns == frame.columns
    ids = {r["doc_id"] for r in kept.collect()}
    assert ids == {r["doc_id"] for r in module.scored(frame, labels).collect() if r["predicted"] == (0 if toxic else 1)}


@pytest.mark.parametrize("module", [quality_rules, toxic_grammar])
def test_classifier_odd_tables(spark, module):
    frame = docs(spark, None, "", "word " * 5000, (None, "x"), (2, "again"))
    no_labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = module.scored(frame, no_labels).collect()
    assert len(got) == 5 and all(0 <= r["score"] <= 1 and r["predicted"] in (0, 1) and r["held_out"] is not None for r in got)
    assert module.scored(frame.limit(0), no_labels).count() == 0
    assert module.kept(frame, no_labels).count() == 5
    nulls = spark.createDataFrame([(0, None, None), (None, 1, 1), (1, 1, 0), (1, 1, 0)], "doc_id long, quality int, toxic int")
    assert module.scored(frame, nulls).count() == 5


def test_rules_are_sql_predicates(spark):
    frame, labels = labelled(spark)
    model = quality_rules.fitted(frame, labels)
    assert model.rules and all("<=" in r or ">" in r for r in model.rules)


@pytest.mark.parametrize(
    ("text", "counted"),
    [
        ("You idiot.", {"insult_targeted": 1}), ("idiot you.", {"insult_targeted": 1}), ("an idiot. you", {"insult_plain": 1}), ("not an idiot.", {"insult_negated": 1}), ('he said "idiot" again.', {"insult_reported": 1}),
        ("I will kill you.", {"threat_targeted": 1}), ("kill time. you", {}), ("I will not kill you.", {"threat_negated": 1}), ("He wrote I will kill you.", {"threat_reported": 1}), ("IDIOT*** idiot!!", {"insult_plain": 2}), ("idiotic", {}), ("", {}), (None, {}),
    ],
)
def test_grammar(text, counted):
    got = dict(zip(toxic_grammar.FEATURES, toxic_grammar.Lexicon().counter()(text), strict=True))
    got.pop("words")
    assert {k: v for k, v in got.items() if v} == counted


# --- 10: site templates ---


def test_main_text_rules():
    page = """<!DOCTYPE html><html><head><title>t</title><script>var a="<p>x</p>";</script></head><body><nav><ul><li>menu</ul></nav><header>top</header>
    <!-- <p>gone</p> --><article><h1>A &amp; B&#33;</h1><p>one  two<br>three<p>four <b>bold</b></p><ul><li>x<li>y</ul><div class="related-posts">more</div><aside>side</aside>
    <section id="comments"><p>reader</p></section><blockquote>q</blockquote></article><div class="ad">buy</div><footer>&copy; 1</footer></body>"""
    assert site_templates.main_text(page) == "A & B!\n\none two three\n\nfour bold\n\nx\n\ny\n\nq"
    assert site_templates.main_text(None) == "" and site_templates.main_text("") == ""
    assert site_templates.main_text("plain &lt;text") == "plain <text"
    assert site_templates.main_text("<p>a<p>b<div>c") == "a\n\nb\n\nc"
    assert len(site_templates.main_text("<p>" + "word " * 100_000)) == 499_999


def test_recurring_subtrees_go_and_shared_sentences_stay(spark):
    rows = [(i, f"http://h.org/{i}", f"<body><div class='x{i}'>Join our club today</div><main><p>shared line</p><p>own {i}</p></main><div>tail {i}</div></body>") for i in range(20)]
    rows += [(100 + i, f"http://h.org/b{i}", f"<div>Join our club today</div><p>only {i}</p>") for i in range(20)] + [(500, "http://other.org/1", "<div>Join our club today</div><p>x</p>"), (501, None, None), (500, "http://other.org/1", "<div>Join our club today</div><p>x</p>")]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, text int")
    got = {r["page_id"]: r["text"] for r in site_templates.extracted(frame).collect()}
    assert got[3] == "shared line\n\nown 3" and got[103] == "only 3"
    assert got[500] == "Join our club today\n\nx" and got[501] == ""
    assert site_templates.extracted(frame).count() == len(rows)
    assert site_templates.extracted(frame.limit(0)).count() == 0


def test_templates_inside_articles_go_and_copied_articles_stay(spark):
    boxes = "<ul><li><a href='/a'>Top ten</a></li><li>Plain</li></ul>", "<p>Get our letter: <a href='/s'>sign up</a></p>", "<table><tr><td>Opening hours</td></tr></table>"
    rows = [(i, f"http://h.org/{i}", f"<article><p>shared line</p><p>own {i}</p>{''.join(boxes)}</article>") for i in range(20)]
    rows += [(100 + i, f"http://h.org/copy{i}", "<article><p>copied</p><ul><li>flour</li><li>eggs</li></ul></article>") for i in range(20)]
    rows += [(200, "http://h.org/c", "<article><p>teaser</p></article><div>" + "the page's long text " * 9 + "</div>")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in site_templates.extracted(frame).collect()}
    assert got[3] == "shared line\n\nown 3" and got[103] == "copied\n\nflour\n\neggs"
    assert got[200].startswith("teaser\n\nthe page's long text the")


def test_template_on_a_small_share_of_a_large_host_goes(spark):
    rows = [(i, f"http://h.org/{i}", f"<div>{'Rotating word' if i < 6 else f'unlike {i}'}</div><p>own {i}</p>") for i in range(100)]
    rows += [(200 + i, f"http://h.org/copy{i}", "<div>a page copied whole</div>") for i in range(8)]
    got = {r["page_id"]: r["text"] for r in site_templates.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == "own 3" and got[50] == "unlike 50\n\nown 50" and got[203] == "a page copied whole"
