"""Near duplicates are decided by row, reputations that block, and the pipeline's stages."""

from __future__ import annotations

import random

import corpus_pipeline
import pytest
from test_small_tables import docs

from outways.llm import host_reputation, jaccard_groups

A, B, C = "a b c d e f g h i j", "k l m n o p q r s t", "u v w x y z 1 2 3 4"


def test_a_repeated_id_keeps_its_own_text(spark):
    # Id 7 has a copy of id 3's text and a text of its own: only the copy goes.
    frame = docs(spark, (3, A), (7, A), (7, B), (None, B), (None, C), (None, C), (5, ""), (6, ""), (8, None))
    got = sorted((str(r["doc_id"]), r["text"] or "") for r in jaccard_groups.one_of_each(frame).collect())
    assert got == [("3", A), ("5", ""), ("6", ""), ("7", B), ("8", ""), ("None", C), ("None", C)]


@pytest.mark.parametrize("percent", [0, 49, 101])
def test_percents_that_would_lose_links_are_refused(spark, percent):
    with pytest.raises(ValueError, match="percent"):
        jaccard_groups.joined(docs(spark, A), 4, percent)


def test_reputation_blocks_where_outcomes_are_bad(spark):
    pages, labels = [], []
    for i in range(600):
        host = ("bad.spam.org", "worse.spam.org", "good.site.org", "fine.other.org", "ok.third.org")[i % 5]
        pages.append((i, f"http://{host}/x/{i}"))
        labels.append((i, int(i % 5 > 1), 0))
    pages += [(1000, "http://new.spam.org/x"), (1001, "http://new.site.org/x"), (1002, "http://elsewhere.org/"), (1003, None), (1004, "http://www.example.com/en/a")]
    got = {r["page_id"]: r for r in host_reputation.judged_pages(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert [got[i]["verdict"] for i in range(5)] == ["block", "block", "allow", "allow", "allow"]
    # A host without outcomes has its domain's reputation, pulled to the suffix's.
    assert got[1000]["bad_rate"] > 0.6 > 0.45 > got[1002]["bad_rate"] > got[1001]["bad_rate"]
    assert got[1002]["verdict"] == "allow" and got[1003]["verdict"] == "allow" and got[1004]["rule"] == "www.example.com/en/"


def stage_tables(spark, folder, documents, labels):
    documents.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")


def test_stages_on_a_small_corpus(spark, tmp_path):
    rnd, words = random.Random(2), [f"word{i}" for i in range(500)]
    texts, labels = [], []
    for i in range(240):
        toxic, good = i % 6 == 0, i % 5 != 0
        body = [w for w in rnd.choices(words, k=60)] if good else ["buy!!!", "###"] * 30
        if toxic:
            body[7] = "idiot"
        texts.append(" ".join(body) + ("." if good else f" {i}"))
        labels.append((i, int(good), int(toxic)))
    texts += [texts[1], texts[1] + " more", None, "", (None, "no id here at all"), (3, "an id again with other words")]
    frame = docs(spark, *texts)
    stage_tables(spark, tmp_path, frame, labels)
    columns, held = frame.columns, frame
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = held
        held = stage(spark, before, str(tmp_path))
        assert held.columns == columns, name
        held.write.parquet(f"{tmp_path}/{name}")
        held = spark.read.parquet(f"{tmp_path}/{name}")
        rows, earlier = [str(r) for r in held.collect()], [str(r) for r in before.collect()]
        assert set(rows) <= set(earlier), name
        if name == "mixing":
            assert sorted(rows) == sorted(earlier)
            order = [r["doc_id"] for r in held.collect()]
    kept = {r["doc_id"] for r in held.collect()}
    assert 240 not in kept and 241 not in kept  # copies of 1
    assert not any(i in kept for i in range(0, 240, 6)) and sum(i in kept for i in range(240) if i % 6 and i % 5) > 140
    pieces = corpus_pipeline.STAGES[-1][1](spark, held, str(tmp_path)).collect()
    assert {r["doc_id"] for r in pieces} == kept
    # Sequences follow the mixed order; here all rows are one window.
    assert len(order) == len(pieces)
    result = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in result} == kept and len(result) == len(pieces)


def test_pipeline_on_empty_tables(spark, tmp_path):
    stage_tables(spark, tmp_path, docs(spark, "x").limit(0), [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
