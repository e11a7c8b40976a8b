"""Toxicity: a weighted finite-state grammar over clauses.

Words are mapped to classes (insult, learned stem, threat verb, person, negation, reporting verb); four
small transducers, composed into one machine, rewrite the class string of each clause:

* threat: a threat verb before a person becomes a threat;
* negation: an insult, stem or threat up to three words after a negation becomes a negated one;
* reported speech: after a reporting verb or a quotation mark, up to the sentence's end, it
  becomes a reported one;
* target: an insult or stem in a clause with a person becomes a targeted one.

Each output has a weight (``WEIGHTS``): a targeted insult counts more than a plain one, a negated or
reported one a fraction of it. A document's weights are summed per class, and a logistic
regression on a bounded sample of labelled rows, its coefficients bounded below by zero, calibrates
the logarithms of the sums: so whatever is learned, a negated or reported clause counts less than a
plain one, and a plain one less than a targeted one. A class that the sample hardly shows takes
the insults' coefficient.

The insult lexicon is the fixed list below and what the same sample shows: words that stand almost
only in toxic texts, in many different surroundings, and, as some languages build insults by
composition, stems: beginnings of several different words, far more frequent in toxic texts. What is
learned is bounded by evidence, not by a number. As stems also turn up in clean texts, their sum
counts twice, as it is and by the thousand words.

Cases: a null text counts as empty; texts without a match get the score of no matches; ties between
stems go to the longer, then the first by name; repeated rows keep a row each; with no labelled rows
or only one class among them fixed coefficients are taken; other columns are passed over.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from math import exp, log1p

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outways.llm.labelled import MAX_ROWS, held_out, training_rows
from outways.llm.store import written

# Word lists.
INSULTS = (
    "idiot idiots moron morons stupid scum loser losers pathetic disgusting trash worthless clown clowns imbecile cretin "
    "dumb dumbass jerk bastard bastards asshole assholes bitch bitches retard retarded whore slut vermin filth filthy "
    "garbage subhuman degenerate dimwit halfwit dipshit fool fools coward cowards parasite parasites "
    "idioten dummkopf abschaum versager trottel arschloch schlampe "
    "imbécile crétin connard connasse salope ordure abruti "
    "imbécil estúpido estúpida basura escoria cabrón payaso"
)
THREATS = "kill murder destroy hurt strangle stab shoot beat töten umbringen tuer matar"
PERSONS = "you your yours he she him her they them du dich ihr euch tu toi vous te usted ustedes ellos"
NEGATIONS = "not no never isn't aren't wasn't don't nicht kein keine nie pas jamais ne nunca jamás"
REPORTING = "said says wrote writes claimed claims called quoted quotes reported sagte schrieb dit écrit dijo escribió"
PATTERNS = ("plain", "targeted", "negated", "reported")
#: What a match of each pattern counts.
WEIGHTS = {"plain": 1.0, "targeted": 1.5, "negated": 0.2, "reported": 0.2}
KINDS_SCORED = ("insult", "threat", "stem")
FEATURES = (*(f"{kind}_{pattern}" for kind in KINDS_SCORED for pattern in PATTERNS), "words")
INPUTS = ("insult", "threat", "stem", "stem_rate", "words")
#: Coefficients of the inputs and the intercept where nothing can be learned.
FALLBACK = ((6.0, 6.0, 0.0, 0.0, 0.0), -3.0)
#: A class that fewer texts of the sample match takes the insults' coefficient.
LEAST_TEXTS = 5
#: In rates, shorter texts count as so many words.
LEAST_WORDS = 50
LEAST_SCORE = 0.5

TOKEN = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|[\n.!?]+|[;:]+|[\"“”«»]")
KINDS = {"insult": "I", "threat_verb": "T", "person": "P", "negation": "N", "reporting": "R"}


@dataclass(frozen=True)
class Transducer:
    """Deterministic: (state, symbol) -> (next state, output symbols); other pairs copy the symbol
    and stay, but for ``reset`` symbols, which copy and go back to the start."""

    arcs: dict
    finals: dict
    start: object = 0
    reset: str = ".;"

    def step(self, state, symbol):
        if (state, symbol) in self.arcs:
            return self.arcs[state, symbol]
        if symbol in self.reset:
            return self.start, (*self.finals.get(state, ()), symbol)
        return state, (symbol,)


def composed(*machines: Transducer):
    """One step function over tuples of states; each machine reads what the one before writes."""
    memo: dict = {}

    def step(states, symbol):
        if (states, symbol) not in memo:
            now, symbols = list(states), (symbol,)
            for i, machine in enumerate(machines):
                out: tuple = ()
                for x in symbols:
                    now[i], more = machine.step(now[i], x)
                    out += more
                symbols = out
            memo[states, symbol] = tuple(now), symbols
        return memo[states, symbol]

    return tuple(m.start for m in machines), step


# Symbols: I insult, S stem, T threat verb, P person, N negation, R reporting verb, o other word,
# " quotation mark, ";" clause end, "." sentence end. Written: H threat, i s h negated, J U K reported
# (insult, stem, threat), A B targeted (insult, stem).
THREAT = Transducer({(0, "T"): (1, ("o",)), (1, "T"): (1, ("o",)), (1, "P"): (0, ("H", "P"))}, {})
NEGATION = Transducer(
    {(n, "N"): (3, ("N",)) for n in range(4)}
    | {(n, x): (n - 1, (x,)) for n in range(1, 4) for x in "oPR"}
    | {(n, x): (n - 1, (y,)) for n in range(1, 4) for x, y in (("I", "i"), ("S", "s"), ("H", "h"))},
    {},
)
REPORTED = Transducer(
    {(0, "R"): (1, ("R",)), (0, '"'): (2, ()), (2, '"'): (0, ()), (1, '"'): (2, ())}
    | {(s, x): (s, (y,)) for s in (1, 2) for x, y in (("I", "J"), ("S", "U"), ("H", "K"))}
    | {(s, ";"): (s, (";",)) for s in (1, 2)},
    {},
)
#: State 1: a person stood in the clause; 2, 3: an insult, a stem waits for one.
TARGET = Transducer(
    {(0, "P"): (1, ()), (1, "I"): (1, ("A",)), (1, "S"): (1, ("B",)), (2, "P"): (1, ("A",)), (3, "P"): (1, ("B",))}
    | {(0, x): (y, ()) for x, y in (("I", 2), ("S", 3))}
    | {(w, x): (y, (z,)) for w, z in ((2, "I"), (3, "S")) for x, y in (("I", 2), ("S", 3))},
    {2: ("I",), 3: ("S",)},
)
START, STEP = composed(THREAT, NEGATION, REPORTED, TARGET)
#: Output symbol to feature; a threat has its person by its pattern.
COUNTED = {
    symbol: FEATURES.index(name)
    for symbol, name in {
        "I": "insult_plain", "A": "insult_targeted", "i": "insult_negated", "J": "insult_reported", "H": "threat_targeted", "h": "threat_negated",
        "K": "threat_reported", "S": "stem_plain", "B": "stem_targeted", "s": "stem_negated", "U": "stem_reported",
    }.items()
}
WORDS = FEATURES.index("words")


@dataclass(frozen=True)
class Lexicon:
    """Words and, for other words, beginnings of words, with their classes."""

    words: tuple[str, ...] = ()
    stems: tuple[str, ...] = ()

    def classes(self) -> dict[str, str]:
        """Word to class; where lists overlap, the first named here wins."""
        classes: dict[str, str] = {}
        for kind, words in (("insult", [*INSULTS.split(), *self.words]), ("threat_verb", THREATS.split()), ("person", PERSONS.split()), ("negation", NEGATIONS.split()), ("reporting", REPORTING.split())):
            for word in words:
                classes.setdefault(word, KINDS[kind])
        return classes

    def counter(self):
        """A function that counts how often a text matches each of ``FEATURES``."""
        classes, stems = self.classes(), self.stems
        heads = [w for w, kind in classes.items() if kind in "IT"] + list(stems)

        def counts(text: str | None) -> list[int]:
            low, found, state = (text or "").lower(), [0] * len(FEATURES), START
            if not any(w in low for w in heads):
                found[WORDS] = low.count(" ") + low.count("\n") + 1
                return found
            for token in [*TOKEN.findall(low), "."]:
                first = token[0]
                if first in "\n.!?":
                    symbol = "."
                elif first in ";:":
                    symbol = ";"
                elif first in '"“”«»':
                    symbol = '"'
                else:
                    symbol = classes.get(token) or ("S" if stems and token.startswith(stems) else "o")
                state, out = STEP(state, symbol)
                for x in out:
                    if x in COUNTED:
                        found[COUNTED[x]] += 1
            found[WORDS] = low.count(" ") + low.count("\n") + 1
            return found

        return counts


def with_counts(df: DataFrame, keep: list[str], lexicon: Lexicon) -> DataFrame:
    """``keep`` columns and the clause counts of column ``text``, in Arrow batches."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = lexicon.counter()
        for batch in batches:
            rows = [counts(text) for text in batch["text"]]
            out = batch[keep].copy()
            for i, name in enumerate(FEATURES):
                out[name] = [r[i] for r in rows]
            yield out

    rows = df.select(*keep, F.coalesce(F.col("text"), F.lit("")).alias("text"))
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*keep).schema] + [f"{x} int" for x in FEATURES])
    return rows.mapInPandas(counted, schema)


def inputs() -> list[Column]:
    """The regression's inputs from the counts."""
    sums = {kind: sum((F.col(f"{kind}_{p}") * F.lit(WEIGHTS[p]) for p in PATTERNS), F.lit(0.0)) for kind in KINDS_SCORED}
    return [*[F.log1p(sums[kind]).alias(kind) for kind in KINDS_SCORED], F.log1p(sums["stem"] * 1000.0 / F.greatest(F.col("words"), F.lit(LEAST_WORDS))).alias("stem_rate"), F.log1p(F.col("words").cast("double")).alias("words")]


def inputs_of(counts: list[int]) -> list[float]:
    sums = [sum(counts[4 * k + i] * WEIGHTS[p] for i, p in enumerate(PATTERNS)) for k in range(len(KINDS_SCORED))]
    return [*map(log1p, sums), log1p(sums[2] * 1000.0 / max(counts[WORDS], LEAST_WORDS)), log1p(counts[WORDS])]


def unlike(train: DataFrame) -> DataFrame:
    """One text of each group of near copies, nearly: those with the same smallest hash of three words."""
    threes = F.regexp_extract_all(F.lower("text"), F.lit(r"\S+\s+\S+\s+\S+"), F.lit(0))
    least = F.coalesce(F.array_min(F.transform(threes, lambda w: F.xxhash64(w))), F.xxhash64("text"))
    return train.withColumn("__least", least).dropDuplicates(["__least"]).drop("__least")


def learned_stems(train: DataFrame, low: int = 3, high: int = 7, kinds: int = 6, ratio: float = 4.0, deviations: float = 8.0) -> tuple[str, ...]:
    """Beginnings of words: of at least ``kinds`` different words of toxic texts, ``ratio`` times as
    often there as in clean ones and by so many standard deviations more (a word counts once a
    text). Of beginnings of each other the one with the most evidence."""
    tokens = train.select("label", F.explode(F.filter(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}]+")), lambda w: F.length(w) >= low)).alias("word"))
    tokens = tokens.filter(~F.col("word").isin(INSULTS.split()))
    words = tokens.groupBy("word").agg(F.sum("label").alias("toxic"), F.sum(1 - F.col("label")).alias("clean"))
    texts = train.agg(F.sum("label").alias("t"), F.sum(1 - F.col("label")).alias("c")).collect()[0]
    if not texts["t"] or not texts["c"]:
        return ()
    begun = words.select("toxic", "clean", F.explode(F.transform(F.sequence(F.lit(low), F.least(F.lit(high), F.length("word"))), lambda k: F.col("word").substr(F.lit(1), k))).alias("stem"))
    sums = begun.groupBy("stem").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"), F.count(F.when(F.col("toxic") > 0, 1)).alias("kinds"))
    due = (F.col("clean") + 0.5) * F.lit(texts["t"] / texts["c"])
    good = sums.filter((F.col("kinds") >= kinds) & (F.col("toxic") >= ratio * due) & (F.col("toxic") - due >= deviations * F.sqrt(due)))
    chosen: list[str] = []
    # Bounded by the sample: each takes evidence from many of its toxic texts.
    for row in good.select("stem", (F.col("toxic") * F.log(F.col("toxic") / due)).alias("gain")).orderBy(F.desc("gain"), F.desc(F.length("stem")), "stem").collect():
        if not any(row["stem"].startswith(s) or s.startswith(row["stem"]) for s in chosen):
            chosen.append(row["stem"])
    return tuple(chosen)


def learned_words(train: DataFrame, least: int = 5, purity: float = 0.97) -> tuple[str, ...]:
    """Words of toxic texts: in at least ``least`` of them, almost never elsewhere, and after at least
    ``least`` different words, which the words of one copied text are not."""
    tokens = F.split(F.lower("text"), r"[^\p{L}]+")
    seen = train.select("label", F.explode(F.array_distinct(F.filter(tokens, lambda w: F.length(w) >= 3))).alias("word")).groupBy("word").agg(F.sum("label").alias("toxic"), F.count("*").alias("all"))
    pure = seen.filter((F.col("toxic") >= least) & (F.col("toxic") >= purity * F.col("all")))
    pairs = train.filter("label = 1").select(F.explode(F.zip_with(tokens, F.slice(tokens, 2, F.size(tokens)), lambda a, b: F.struct(a.alias("before"), b.alias("word")))).alias("p"))
    around = pairs.select("p.*").join(pure.select("word", "toxic"), "word").groupBy("word").agg(F.countDistinct("before").alias("befores"), F.max("toxic").alias("toxic"))
    # Bounded by the sample: each is in ``least`` of its toxic texts.
    return tuple(r["word"] for r in around.filter((F.col("befores") >= least) & (F.col("befores") >= 0.5 * F.col("toxic"))).orderBy("word").collect())


@dataclass
class ToxicModel:
    lexicon: Lexicon
    weights: tuple[float, ...]
    intercept: float

    def score(self) -> Column:
        total = F.lit(self.intercept)
        for x, weight in zip(inputs(), self.weights, strict=True):
            total = total + x * F.lit(weight)
        return 1 / (1 + F.exp(-total))

    def scorer(self):
        """The same for one text at a time."""
        counts = self.lexicon.counter()
        return lambda text: 1 / (1 + exp(-self.intercept - sum(w * x for w, x in zip(self.weights, inputs_of(counts(text)), strict=True))))


def fitted(documents: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> ToxicModel:
    # Here, as executors import this module for the counts and have no use for the fitting.
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.linalg import DenseMatrix

    train = written(training_rows(documents, labels, "toxic", max_rows), "toxic-train")
    classes = {r["label"]: r["count"] for r in train.groupBy("label").count().collect()}
    if len(classes) < 2:
        return ToxicModel(Lexicon(), *FALLBACK)
    apart = written(unlike(train), "toxic-apart")
    stems = learned_stems(apart)
    lexicon = Lexicon(tuple(w for w in learned_words(apart) if not w.startswith(stems or ("\0",))), stems)
    counted = written(with_counts(train, ["label"], lexicon).select("label", *inputs()), "toxic-counts")
    rows = VectorAssembler(inputCols=list(INPUTS), outputCol="x").transform(counted).select("label", "x").coalesce(8)
    # The inputs of matches can only speak for toxic; the number of words is free (a finite bound, as a constant input has no scale).
    least = DenseMatrix(1, len(INPUTS), [0.0] * (len(INPUTS) - 1) + [-100.0])
    model = LogisticRegression(featuresCol="x", labelCol="label", regParam=1e-3, elasticNetParam=0.0, maxIter=100, lowerBoundsOnCoefficients=least).fit(rows)
    weights = list(map(float, model.coefficientMatrix.toArray()[0]))
    shown = counted.agg(*[F.count(F.when(F.col(kind) > 0, 1)).alias(kind) for kind in KINDS_SCORED]).collect()[0]
    if shown["insult"] < LEAST_TEXTS:
        weights[0] = FALLBACK[0][0]
    if shown["threat"] < LEAST_TEXTS:
        weights[1] = weights[0]
    return ToxicModel(lexicon, tuple(weights), float(model.interceptVector[0]))


def scored(documents: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """doc_id, held_out, score (higher: label 1 likelier), predicted, for each row of documents."""
    model = fitted(documents, labels, max_rows)
    return (
        with_counts(documents, ["doc_id"], model.lexicon)
        .select("doc_id", held_out(F.col("doc_id")).alias("held_out"), model.score().alias("score"))
        .withColumn("predicted", (F.col("score") >= LEAST_SCORE).cast("int"))
    )


def kept(documents: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """The rows of documents that aren't toxic, as they are."""
    model = fitted(documents, labels, max_rows)

    def clean(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = model.scorer()
        for batch in batches:
            yield batch[[score(text) < LEAST_SCORE for text in batch["text"]]]

    return documents.mapInPandas(clean, documents.schema)
