"""Polled feed observations as a file stream, with a verdict for each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from outways.operators import feeds

OBSERVATION = "feed_id string, at timestamp, local_size long, remote_size long, remote_newer boolean, same_body boolean"


def verdicts(observations: DataFrame) -> DataFrame:
    """Each observation once, by feed and time, with its verdict; late ones up to an hour count."""
    once = observations.withWatermark("at", "1 hour").dropDuplicates(["feed_id", "at"])
    said = feeds.verdict(F.col("local_size"), F.col("remote_size"), F.col("remote_newer"), F.col("same_body"))
    return once.select("feed_id", "at", said.alias("verdict"))


def watch(spark: SparkSession, folder: str, out: str, checkpoint: str) -> StreamingQuery:
    """Read JSON observations as they land and append their verdicts as Parquet; handles what is there and ends."""
    stream = spark.readStream.schema(OBSERVATION).json(folder)
    return verdicts(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
