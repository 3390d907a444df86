"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in shuffled order, gone through at most twice. A document's virtual finish time
is the queue's words up to and including it, divided by the source's target. In the order of finish times the queues
advance at the pace of their targets, and the words with a virtual time up to 1 are exactly the total budget: there the
global order is cut. The document of a source that crosses the line is taken in part.

Queue positions are sums in two levels: a document's place within a bucket of its source (buckets are slices of the
shuffle's hash, so even a source with most of the rows is dealt evenly), plus the sums of the buckets before.

The cut needs no global prefix sum: up to virtual time v a source gives v * target words, so the words of all sources up
to v are v * budget, and the budget is spent at v = 1 whatever the order. ``mix_documents`` range-sorts by finish time.

Defined results: null text has size 0; a null source is a source of its own, the last; a row without doc_id is shuffled
by its text; rows that repeat an id, or such a text, follow one another in the queue, the smaller first, and each is
taken for itself; an empty table, or one without words, takes nothing; very long texts are documents like any other and
may be taken in part; other columns are ignored or, in ``mix_documents``, passed through; one named ``taken`` there is
renamed ``taken_0``, or with the next free number.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexigrid.llm.common import numbered, staged, words_of

#: Weights by a source's rank, repeating; the budget as a share of all words; the most passes over a document.
WEIGHTS, SHARE, PASSES = (3, 1, 2), 1.5, 2
BUCKET_ROWS = 5_000


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target) from (source, size) rows.

    target = least(2 * size, level * weight): the level is the largest of (budget - capped) / (weights left) over the
    sources in the order in which they reach their caps. The windows without a key hold a row for each source.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (rank - 1) % len(WEIGHTS) + 1)
    cap = F.col("source_size") * PASSES
    by_ratio = Window.orderBy(cap / F.col("weight"))
    before = F.coalesce(F.sum(cap).over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    everything = Window.partitionBy(F.lit(1))
    levels = totals.withColumn("weight", weight).withColumn("budget", F.sum("source_size").over(everything) * F.lit(SHARE))
    levels = levels.withColumn("level", F.max((F.col("budget") - before) / left).over(everything))
    target = F.least(cap.cast("double"), F.col("level") * F.col("weight"))
    return levels.select("source", "source_size", target.alias("target"))


def assign_rows(rows: DataFrame, seed: str = "mix") -> DataFrame:
    """(n, doc_id, source, size, source_size, target, virtual_finish, taken) of each of rows (n, doc_id, source,
    text); virtual_finish is that of the first pass, null where the source's target is 0."""
    buckets = max(1, math.ceil(rows.count() / BUCKET_ROWS))
    text = F.coalesce("text", F.lit(""))
    place = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null:"), F.md5(text))), F.lit(f":{seed}")))
    sized = rows.select(
        "n", "doc_id", "source", F.size(words_of(text)).cast("long").alias("size"), place.alias("place"),
        F.floor(F.conv(F.substring(place, 1, 8), 16, 10).cast("long") * buckets / 2**32).cast("int").alias("bucket"),
    )
    sized = staged(sized, "sizes")
    sums = sized.groupBy("source", "bucket").agg(F.sum("size").alias("size"))
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("source", "bucket", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("offset"))
    queues = offsets.alias("o").join(source_targets(sums).alias("t"), F.expr("o.source <=> t.source")).select("o.*", "source_size", "target")
    within = Window.partitionBy("source", "bucket").orderBy("place", "size", "n").rowsBetween(Window.unboundedPreceding, 0)
    placed = sized.withColumn("upto", F.sum("size").over(within)).alias("p").join(queues.alias("q"), F.expr("p.source <=> q.source and p.bucket = q.bucket"))
    before = F.col("upto") + F.col("offset") - F.col("size")
    line = F.floor("target")
    first = F.greatest(F.lit(0), F.least(F.col("size"), line - before))
    second = F.greatest(F.lit(0), F.least(F.col("size"), line - F.col("source_size") - before))
    finish = F.when(F.col("target") > 0, (before + F.col("size")) / F.col("target"))
    return placed.select("n", "doc_id", "p.source", "size", "source_size", "target", finish.alias("virtual_finish"), (first + second).cast("long").alias("taken"))


def assign(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """assign_rows of docs."""
    return assign_rows(docs.select(F.monotonically_increasing_id().alias("n"), "doc_id", "source", "text"), seed).drop("n")


def mix_documents(docs: DataFrame) -> DataFrame:
    """Rows of docs in the mix, range-sorted by virtual finish time, with taken: the words to draw from the document,
    over its size where it is repeated."""
    rows = numbered(docs, "mix-rows")
    taken = assign_rows(rows.select("n", "row.doc_id", "row.source", "row.text")).where("taken > 0").select("n", "taken", "virtual_finish")
    names = {c.lower() for c in docs.columns}
    free = next(f"taken_{k}" for k in range(len(names) + 1) if f"taken_{k}" not in names)
    own = [F.col(f"row.`{c}`").alias(free if c.lower() == "taken" else c) for c in docs.columns]
    return rows.join(taken, "n").orderBy("virtual_finish").select(*own, "taken")


def op10_mixing(spark, sf_dir: str) -> DataFrame:
    found = assign(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.orderBy("virtual_finish").select("doc_id", "size", "source_size", "target", "taken", "virtual_finish")


OP10_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '')), 0) AS BIGINT) AS size,
             md5(coalesce(CAST(doc_id AS VARCHAR), 'null:' || md5(coalesce(text, ''))) || ':mix') AS place FROM documents),
t AS (SELECT source, CAST(sum(size) AS BIGINT) AS s FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight, 1.5::DOUBLE * sum(s) OVER () AS budget FROM t),
l AS (SELECT *, (budget - coalesce(CAST(sum(2 * s) OVER (ORDER BY 2 * s / weight::DOUBLE ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS DOUBLE), 0))
                / CAST(sum(weight) OVER (ORDER BY 2 * s / weight::DOUBLE ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS lv FROM w),
g AS (SELECT source, s, least(CAST(2 * s AS DOUBLE), max(lv) OVER () * weight) AS target FROM l),
q AS (SELECT doc_id, size, s AS source_size, target,
        CAST(sum(size) OVER (PARTITION BY d.source ORDER BY place, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS upto
      FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
  CAST(greatest(0, least(size, floor(target) - (upto - size))) + greatest(0, least(size, floor(target) - source_size - (upto - size))) AS BIGINT) AS taken,
  CASE WHEN target > 0 THEN upto / target END AS virtual_finish
FROM q
"""
