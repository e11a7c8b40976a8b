"""Quality classifier: a sparse rule ensemble over text statistics.

Statistics of each text are Column expressions. A small random forest is fitted to them on a
bounded sample of labelled rows; every path from a root to an inner or outer node is a
conjunctive rule; a logistic regression with an L1 penalty weighs the rules and drops most. What
is left is compiled into one Column expression, so scoring a corpus is a single scan.

Cases: a null text counts as an empty one and gets a score as well; with no labelled row or
only one class among them every text scores that class's (smoothed) share.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outways.llm.labelled import MAX_ROWS, held_out, training_rows
from outways.llm.store import written

#: Function words of the four most common languages of the corpus, fixed values.
FUNCTION_WORDS = "the|and|of|to|in|is|that|for|de|la|le|les|des|et|que|el|en|los|der|die|das|und|von|zu"
#: Texts with at least this score are kept.
KEEP_AT = 0.3


def statistics(text: Column) -> list[Column]:
    """The statistics of a text, each a double with a name."""
    words = F.col("__words")
    n_words = F.size(words).cast("double")
    n_chars = F.greatest(F.length(text), F.lit(1)).cast("double")
    lines = F.split(text, "\n", -1)
    count = lambda pattern: F.regexp_count(text, F.lit(pattern)).cast("double")
    repeats = F.size(F.filter(F.zip_with(words, F.slice(words, 2, F.size(words)), lambda a, b: a.eqNullSafe(b)), lambda same: same))
    return [
        F.length(text).cast("double").alias("chars"),
        n_words.alias("words"),
        (n_chars / n_words).alias("chars_per_word"),
        (F.size(F.array_distinct(words)) / n_words).alias("distinct_words"),
        (repeats / n_words).alias("repeated_words"),
        (count(r"[A-ZÀ-ÖØ-Þ]") / n_chars).alias("upper_case"),
        (count(r"[0-9]") / n_chars).alias("digits"),
        (count(r"[#$%&*@^~_=+<>{}\\]") / n_words).alias("symbols"),
        (count(r"\|") / n_words).alias("bars"),
        (count(r"!") / n_words).alias("exclamations"),
        (count(r"[.?]") / n_words).alias("sentence_ends"),
        (count(rf"(?i)\b(?:{FUNCTION_WORDS})\b") / n_words).alias("function_words"),
        (n_words / F.size(lines)).alias("words_per_line"),
        (F.size(F.array_distinct(lines)) / F.size(lines)).alias("distinct_lines"),
    ]


def with_statistics(df: DataFrame, *keep: str) -> DataFrame:
    """``keep`` columns and the statistics of column ``text``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return df.select(*keep, text.alias("__text")).withColumn("__words", F.split(F.trim("__text"), r"\s+")).select(*keep, *statistics(F.col("__text")))


@dataclass
class RuleModel:
    """Rules as SQL predicates over the statistics' names, their weights, and the intercept."""

    intercept: float
    rules: dict[str, float] = field(default_factory=dict)

    def score(self) -> Column:
        total = F.lit(float(self.intercept))
        for rule, weight in self.rules.items():
            total = total + F.when(F.expr(rule), F.lit(float(weight))).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def tree_rules(node, names: list[str], path: tuple[str, ...] = ()) -> set[str]:
    """The conjunctions that lead to each node below ``node``."""
    found = {" AND ".join(sorted(path))} if path else set()
    if node.getClass().getSimpleName() == "InternalNode":
        name, at = names[node.split().featureIndex()], node.split().threshold()
        found |= tree_rules(node.leftChild(), names, (*path, f"({name} <= {at!r}D)"))
        found |= tree_rules(node.rightChild(), names, (*path, f"({name} > {at!r}D)"))
    return found


def fit(train: DataFrame, trees: int = 12, depth: int = 3, penalty: float = 0.002, seed: int = 7) -> RuleModel:
    """``train``: ``label`` double and the statistics."""
    names = [c for c in train.columns if c not in ("label", "doc_id")]
    classes = {r["label"]: r["count"] for r in train.groupBy("label").count().collect()}
    if len(classes) < 2:
        good = (classes.get(1.0, 0) + 1) / (sum(classes.values()) + 2)
        return RuleModel(float(_logit(good)))
    assembled = VectorAssembler(inputCols=names, outputCol="x").transform(train)
    forest = RandomForestClassifier(featuresCol="x", labelCol="label", numTrees=trees, maxDepth=depth, maxBins=64, featureSubsetStrategy="onethird", seed=seed).fit(assembled)
    rules = sorted(set().union(*(tree_rules(t._java_obj.rootNode(), names) for t in forest.trees)))
    fired = train.select("label", F.array(*[F.expr(r).cast("double") for r in rules]).alias("fired"))
    fired = fired.select("label", *[F.col("fired")[i].alias(f"r{i}") for i in range(len(rules))])
    matrix = VectorAssembler(inputCols=[f"r{i}" for i in range(len(rules))], outputCol="x").transform(fired).select("label", "x").cache()
    lasso = LogisticRegression(featuresCol="x", labelCol="label", elasticNetParam=1.0, regParam=penalty, standardization=False, maxIter=100).fit(matrix)
    matrix.unpersist()
    return RuleModel(float(lasso.intercept), {r: float(w) for r, w in zip(rules, lasso.coefficients, strict=True) if w})


def _logit(p: float) -> float:
    from math import log

    return log(p / (1 - p))


def fitted(documents: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> RuleModel:
    train = written(with_statistics(training_rows(documents, labels, "quality", max_rows), "doc_id", "label").coalesce(8), "quality-train")
    return fit(train)


def scored(documents: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """doc_id, held_out, score (higher: label 1 likelier), predicted, for each row of documents."""
    model = fitted(documents, labels, max_rows)
    return (
        with_statistics(documents, "doc_id")
        .select("doc_id", held_out(F.col("doc_id")).alias("held_out"), model.score().alias("score"))
        .withColumn("predicted", (F.col("score") >= KEEP_AT).cast("int"))
    )


def kept(documents: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """The rows of documents that the classifier doesn't reject, as they are."""
    model = fitted(documents, labels, max_rows)
    text = F.coalesce(F.col("text"), F.lit(""))
    row = F.struct(*[F.col(f"`{c}`") for c in documents.columns])
    judged = (
        documents.select(row.alias("__row"), text.alias("__text"))
        .withColumn("__words", F.split(F.trim("__text"), r"\s+"))
        .select("__row", *statistics(F.col("__text")))
        .filter(model.score() >= KEEP_AT)
    )
    return judged.select("__row.*")
