"""A stored fingerprint follows its text when a paragraph comes or goes."""

from __future__ import annotations

from pyspark.sql import functions as F

from outways.llm import multiset_hash


def test_paragraphs_come_and_go(spark):
    lines = ["one two three four five six", "", "zwei wörter", "x" * 60, "one two three four five six", "a  b\tc"]
    texts = {"all": "\n".join(lines), "turned": "\n".join(reversed(lines)), "but first": "\n".join(lines[1:]), "but word": "\n".join(x for i, x in enumerate(lines) if i != 2), "empty": "", "one": lines[3]}
    frame = spark.createDataFrame(list(texts.items()), "name string, t string")
    stored = {r["name"]: r["fingerprint"] for r in multiset_hash.fingerprints(frame, ["name"], "t").collect()}
    assert stored["all"] == stored["turned"] != stored["but first"]
    rows = [("but first", lines[0], "all"), ("but word", lines[2], "all"), ("empty", lines[3], "one")]
    steps = spark.createDataFrame([(stored[a], line, stored[b]) for a, line, b in rows], "less string, line string, more string")
    for r in steps.select("*", multiset_hash.changed(F.col("less"), F.col("line"), 1).alias("up"), multiset_hash.changed(F.col("more"), F.col("line"), -1).alias("down")).collect():
        assert r["up"] == r["more"] and r["down"] == r["less"]
    twice = spark.createDataFrame([(stored["empty"],)], "f string").select(multiset_hash.changed(multiset_hash.changed(F.col("f"), F.lit(lines[3]), 2), F.lit(lines[3]), -1).alias("f")).first()["f"]
    assert twice == stored["one"]
