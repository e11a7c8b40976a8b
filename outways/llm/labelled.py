"""Training rows from a table of labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most labelled rows that a model is fitted on.
MAX_ROWS = 20_000


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from: crc32 of the id's text is divisible by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_rows(documents: DataFrame, labels: DataFrame, label: str, max_rows: int = MAX_ROWS) -> DataFrame:
    """(doc_id, text, label double): at most ``max_rows`` labelled rows that aren't held out, those
    with the smallest hash of their id. Null or other labels than 0 and 1 are passed over.
    """
    sample = (
        labels.filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")) & F.col(label).isin(0, 1))
        .groupBy("doc_id")
        .agg(F.max(label).cast("double").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_rows)
    )
    # max_rows pairs of an id and a label: broadcasting them is bounded by that parameter.
    return documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(sample), "doc_id")
