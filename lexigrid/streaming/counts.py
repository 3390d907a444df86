"""A phrase table kept up to date from a stream of texts.

Each micro-batch is counted and written as a part of its own under its batch number, so a batch that is run again after a
failure replaces its part instead of being counted twice. Reading sums the parts; ``compact`` folds them into one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from lexigrid.sources.corpus import MAX_WORDS, counted, lines


def opened(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A stream over a Parquet table, which may be a file or a folder of them."""
    # Spark streams a single file only where a pattern names it; this one has no other match.
    return spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]")


def start(texts: DataFrame, path: str, checkpoint: str, column: str = "text", max_words: int = MAX_WORDS, once: bool = False) -> StreamingQuery:
    """Starts counting a stream of texts into path; once: all that is there now, then stop."""

    def write(batch: DataFrame, number: int) -> None:
        counted(lines(batch, column), max_words).write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = texts.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def current(spark: SparkSession, path: str, min_count: int = 1) -> DataFrame:
    """(text, score) of all batches so far."""
    parts = spark.read.parquet(path).groupBy("text").agg(F.sum("score").alias("score"))
    return parts.where(F.col("score") >= min_count)


def compact(spark: SparkSession, path: str, to: str) -> None:
    """Folds all batches into one table under to; run it while no stream writes to path."""
    current(spark, path).write.mode("overwrite").parquet(f"{to}/batch=-1")
