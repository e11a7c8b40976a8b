"""Toxic grammar: learned stems go through all machines, and patterns keep their order of weight."""

from __future__ import annotations

import random
import re

import pytest
from test_small_tables import docs

from outways.llm import toxic_grammar
from outways.llm.toxic_grammar import FEATURES, Lexicon, ToxicModel, inputs_of


@pytest.mark.parametrize(
    ("text", "counted"),
    [
        ("a zorkling.", {"stem_plain": 1}), ("you zorkling.", {"stem_targeted": 1}), ("zorkling you", {"stem_targeted": 1}), ("not a zorkling.", {"stem_negated": 1}), ('he said "zorkling" again.', {"stem_reported": 1}),
        ("zorkling idiot you.", {"stem_plain": 1, "insult_targeted": 1}), ("idiot zorkling. you", {"insult_plain": 1, "stem_plain": 1}), ("not an idiot, he wrote: zorkling and idiot.", {"insult_negated": 1, "stem_reported": 1, "insult_reported": 1}),
        ("zork zorks. zo", {"stem_plain": 2}), ("no more of it. zorkling", {"stem_plain": 1}),
    ],
)
def test_stems_meet_every_machine(text, counted):
    got = dict(zip(FEATURES, Lexicon(stems=("zork",)).counter()(text), strict=True))
    got.pop("words")
    assert {k: v for k, v in got.items() if v} == counted


def reference_counts(text, insults):
    """Negated, reported, targeted and plain insults by regular expressions over sentences."""
    found = dict.fromkeys(("insult_plain", "insult_targeted", "insult_negated", "insult_reported"), 0)
    for sentence in re.split(r"[.!?\n]+", text.lower()):
        words = re.findall(r"[a-z']+", sentence)
        reporting = next((i for i, w in enumerate(words) if w == "said"), len(words))
        kinds = []
        for i, w in enumerate(words):
            if w in insults:
                kinds.append((i, "insult_negated" if "not" in words[max(0, i - 3) : i] else "insult_reported" if i > reporting else None))
        person = "you" in words
        for _, kind in kinds:
            found[kind or ("insult_targeted" if person else "insult_plain")] += 1
    return found


def test_one_clause_sentences_equal_a_plain_reading():
    rnd = random.Random(9)
    for _ in range(300):
        text = " ".join(rnd.choice(["idiot", "the", "of", "not", "house", "moron", "."]) for _ in range(20))
        got = dict(zip(FEATURES, Lexicon().counter()(text), strict=True))
        want = reference_counts(text, {"idiot", "moron"})
        assert {k: got[k] for k in want} == want
    for text in ("you idiot", "he said you idiot. moron you", "you are not an idiot"):
        got, want = dict(zip(FEATURES, Lexicon().counter()(text), strict=True)), reference_counts(text, {"idiot", "moron"})
        assert {k: got[k] for k in want} == want


def trained(spark):
    rnd, words = random.Random(6), [f"w{i}" for i in range(300)]
    texts, rows = [], []
    for i in range(400):
        toxic = i % 3 == 0
        body = rnd.choices(words, k=40)
        if toxic:
            body[rnd.randrange(40)] = rnd.choice(["idiot", "scum"]) if i % 2 else f"zork{chr(97 + i % 20)}"
        texts.append(" ".join(body))
        rows.append((i, 1, int(toxic)))
    return docs(spark, *texts), spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_fitted_weights_keep_the_patterns_in_order(spark):
    frame, labels = trained(spark)
    model = toxic_grammar.fitted(frame, labels)
    assert all(w >= 0 for w in model.weights[:-1]) and any(s.startswith("zork") or "zork".startswith(s) for s in model.lexicon.stems)
    score = model.scorer()
    filler = "w1 w2 w3 w4 w5 w6 w7 w8 w9. "
    for word in ("idiot", "zorkb"):
        clean, negated, reported, plain, targeted = (score(filler + t) for t in ("w1.", f"not a {word}.", f'he said "{word}" then.', f"a {word}.", f"you {word}."))
        assert clean < negated < plain <= targeted and clean < reported < plain
        assert negated < toxic_grammar.LEAST_SCORE < plain
    # No threat in the sample: threats take the insults' coefficient.
    assert score(filler + "I will kill you.") > toxic_grammar.LEAST_SCORE > score(filler + "I will not kill you.")


def test_score_as_a_column_equals_the_scorer(spark):
    model = ToxicModel(Lexicon(stems=("zork",)), (3.0, 2.0, 1.0, 0.5, -0.1), -1.0)
    texts = ["you idiot", None, "", "not a zorkling. zorks kill you", 'he said "scum"', "long " * 3000]
    frame = docs(spark, *texts)
    got = {r["doc_id"]: r["s"] for r in toxic_grammar.with_counts(frame, ["doc_id"], model.lexicon).select("doc_id", model.score().alias("s")).collect()}
    score = model.scorer()
    assert all(got[i] == pytest.approx(score(t)) for i, t in enumerate(texts))
    assert len(inputs_of([0] * len(FEATURES[:-1]) + [1])) == len(toxic_grammar.INPUTS)
