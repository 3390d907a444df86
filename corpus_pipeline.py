"""A training-data pipeline of five stages, each an operator of lexigrid.llm, over the table documents.

Quality rules drop what they reject; line dedup removes later occurrences of lines, and documents left without a worded
line; near-dedup keeps the document with the smallest id of each group; decontamination drops documents that hold a
benchmark item; mixing keeps the documents that the mix draws from, with ``taken``, the words to draw (over the
document's size where it is repeated). Each stage's result is written as Parquet and read again by the next, so a lost
executor costs no more than a stage. The stages' docstrings define nulls, empty and repeated rows.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from lexigrid.llm.common import drop_staged, staged, staged_paths
from lexigrid.llm.decontam import drop_contaminated
from lexigrid.llm.lines import dedup_lines
from lexigrid.llm.mixing import mix_documents
from lexigrid.llm.quality import quality_filter
from lexigrid.llm.simhash import near_dedup


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: What the stages before have staged in the shared folder.
_SPENT: list[str] = []


def _stage(run_stage: Stage) -> Stage:
    """A stage that first clears what earlier ones staged: their results are written, as its docs have been read again."""

    @wraps(run_stage)
    def run_it(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        drop_staged(_SPENT)
        _SPENT.clear()
        before = set(staged_paths())
        found = run_stage(spark, docs, sf_dir)
        _SPENT.extend(p for p in staged_paths() if p not in before)
        return found

    return run_it


@_stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_filter(docs)


@_stage
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return dedup_lines(docs)


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup(docs)


@_stage
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@_stage
def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix_documents(docs)


STAGES = [
    ("quality", quality),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
]

#: SQL has no edit joins, near copies or template windows; the tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
