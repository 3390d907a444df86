"""Helpers shared by the corpus operators: staging in the shared folder, words, connected components."""

from __future__ import annotations

import atexit
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrid.sources.store import new_path

#: Characters that separate words: space and U+0009 to U+000D.
SPACE = r"[\x20\x09-\x0D]"

_STAGED: list[tuple[SparkSession, str]] = []


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses; removed when the driver's interpreter ends, or before."""
    if not _STAGED:
        atexit.register(drop_staged)
    _STAGED.append((spark, new_path(spark, name)))
    return _STAGED[-1][1]


def staged_paths() -> list[str]:
    return [path for _, path in _STAGED]


def drop_staged(paths: list[str] | None = None) -> None:
    """Removes these staged paths, or all: for when what reads them has been written."""
    for spark, path in [x for x in _STAGED if paths is None or x[1] in paths]:
        try:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:
            return  # the session has ended: whoever owns the shared folder clears it
        _STAGED.remove((spark, path))


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it again: lineage ends there, and it survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 500, size: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut into pieces of at most rows rows, and of about size bytes, so that what a worker builds from one
    stays small; Spark bounds the batches themselves (``spark.sql.execution.arrow.maxBytesPerBatch``)."""
    for batch in batches:
        step = max(1, min(rows, len(batch) * size // max(1, batch.nbytes)))
        for at in range(0, len(batch), step):
            yield batch.slice(at, step)


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """(n, row) of each row of docs: n names the row, row holds all its columns, so what repeats an id, or has none, stays apart.

    Rows read straight from files are named by file and place there, which no retry changes; others are staged first,
    with a number that rises with the partition.
    """
    row = F.struct("*").alias("row")
    if docs._jdf.queryExecution().analyzed().getClass().getSimpleName() == "LogicalRelation" and "_metadata" not in map(str.lower, docs.columns):
        place = F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))
        return docs.select(place.alias("n"), row)
    return staged(docs.select(F.monotonically_increasing_id().alias("n"), row), name)


def words_of(text: Column) -> Column:
    """Array of the words of a text; null counts as empty."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), "")


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) of each node of edges (u, v), component being the smallest node reachable.

    Alternating large-star and small-star rounds until nothing changes. A round is two aggregations and two joins on
    the node; minima are combined map-side, and AQE splits the joins' skewed side, so a hub is no single task's work.
    """
    arcs = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    arcs, seen = staged(arcs, name), None
    while True:
        mark = arcs.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_000_007)).first()
        if mark == seen or not mark[0]:
            return arcs.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                arcs.select(F.col("v").alias("node"), F.col("v").alias("component"))
            ).distinct()
        seen = mark
        both = arcs.union(arcs.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", "m"))
        arcs = staged(small.where("u <> v").distinct(), name)
