"""SimHash near-dedup: fingerprints, then an exact tiled comparison, then connected components.

Every text gets a 64-bit SimHash of its 3-word shingles. Distinct fingerprints are laid out in tiles whose members
share the population counts of the fingerprint's blocks (four of 16 bits; narrower ones for more fingerprints, which
skip more). Two fingerprints within Hamming distance r differ by at most r in the
sum of absolute differences of those counts, so a tile meets only tiles that near; each pair of tiles is compared whole
with numpy exclusive-or and bit counts. A pair of tiles returns a spanning forest of its links, never all pairs.

Defined results: null text counts as empty; a text without words has fingerprint zero and is linked like any other;
repeated rows and equal texts share one fingerprint and so one component; a null doc_id never names a component unless
no row of it has an id; an empty table gives an empty result; very long texts are hashed whole, in pieces; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrid.llm.common import connected_components, pieces, staged

SEED = 42
#: Blocks of a fingerprint, by the number of distinct fingerprints up to which they are used; any gives the same links.
BLOCKS = ((4, 20_000_000), (8, 2_000_000_000), (16, None))
#: Comparisons of fingerprints that a task should make.
TASK_WORK = 1 << 30


def simhash(data: bytes, n: int = 3) -> int:
    """Fingerprint of a UTF-8 text: bit i is 1 if it is set in over half of the shingles' hashes."""
    words = data.lower().split()
    if not words:
        return 0
    if len(words) < n:
        shingles = iter([b" ".join(words)])
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(n)), strict=False))
    digest = xxhash.xxh64_intdigest
    return fingerprint(np.fromiter((digest(s, SEED) for s in shingles), np.uint64, max(1, len(words) - n + 1)))


def fingerprint(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    total, counts = 0, np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):  # a very long text in pieces
        part = hashes[at : at + (1 << 16)]
        bits = np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
        total += len(part)
    return int(np.packbits(counts * 2 > total, bitorder="little").view("<u8")[0])


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        texts = batch.column(1).cast(pa.binary()).to_pylist()
        found = np.fromiter((simhash(t or b"") for t in texts), np.uint64, len(texts)).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of each row; fp holds the 64 bits as a signed long."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_fingerprint_batches, "doc_id long, fp long")


def forest(i: np.ndarray, j: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each linked node to the least node of its local component."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[i], label[j])
        before = label.copy()
        np.minimum.at(label, i, least)
        np.minimum.at(label, j, least)
        label = label[label]
        if (label == before).all():
            node = np.flatnonzero(label != np.arange(n))
            return node, label[node]


def compare_tiles(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between two tiles of fingerprints, as a spanning forest."""
    rows, cols = [], []
    for at in range(0, len(a), 256):
        near = np.bitwise_count(a[at : at + 256, None] ^ b[None, :]) <= radius
        r, c = np.nonzero(near)
        rows.append(r + at)
        cols.append(c)
    i, j = np.concatenate(rows), np.concatenate(cols)
    keep = a[i] != b[j]
    both, where = np.unique(np.concatenate([a[i[keep]], b[j[keep]]]), return_inverse=True)
    if not len(both):
        return both, both
    half = len(where) // 2
    u, v = forest(where[:half], where[half:], len(both))
    return both[u], both[v]


def _tile_links(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, v = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
            for a, b in zip(batch.column(0), batch.column(1), strict=True):
                x, y = compare_tiles(a.values.to_numpy().view(np.uint64), b.values.to_numpy().view(np.uint64), radius)
                u.append(x)
                v.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (u, v)], ["u", "v"])

    return run


def _steps(blocks: int, radius: int) -> list[dict[int, int]]:
    """Differences of two cells' counts, by block, whose absolute values sum up to radius or less."""
    found = [{}]
    for _ in range(radius):
        more = [{**d, k: d.get(k, 0) + x} for d in found for k in range(blocks) for x in (-1, 1) if d.get(k, 0) * x >= 0]
        found = [dict(t) for t in {tuple(sorted(d.items())) for d in found + more}]
    return found


def near_links(fps: DataFrame, radius: int = 2, tile_rows: int = 2048, blocks: int | None = None) -> DataFrame:
    """Links (u, v) that connect all distinct fingerprints within radius, found tile against tile.

    Pairs of tiles are chosen by their names alone and dealt over tasks by the second tile, whose number grows with a
    cell's rows; the number of tasks follows from the comparisons to make, not from bytes.
    """
    spark, rows = fps.sparkSession, fps.count()
    blocks = blocks or next(b for b, most in BLOCKS if most is None or rows <= most)
    width = 64 // blocks
    side = width + 1
    counts = [F.bit_count(F.shiftrightunsigned("fp", width * k).bitwiseAND(F.lit((1 << width) - 1))).cast("long") for k in range(blocks)]
    celled = fps.select("fp", sum((p * side**k for k, p in enumerate(counts)), F.lit(0)).alias("cell"))
    parts = celled.groupBy("cell").agg(F.ceil(F.count("*") / tile_rows).cast("int").alias("parts"))
    tiles = (
        celled.join(parts, "cell")  # side ** blocks cells at most; Spark's own size threshold decides on a broadcast
        .groupBy("cell", F.expr("cast(pmod(xxhash64(fp), parts) as int)").alias("part"))
        .agg(F.collect_list("fp").alias("fps"))  # about tile_rows distinct values
    )
    tiles = staged(tiles, "tiles")
    names = tiles.select("cell", "part", F.size("fps").cast("long").alias("size"))
    at = [F.floor(F.col("cell") / F.lit(side**k)).cast("long") % side for k in range(blocks)]
    near = []
    for d in _steps(blocks, radius):
        shift = sum(x * side**k for k, x in d.items())
        if shift >= 0:
            inside = F.lit(True)
            for k, x in d.items():
                inside = inside & (at[k] + x).between(0, side - 1) if x else inside
            near.append(F.when(inside, F.col("cell") + F.lit(shift)))
    left = names.select(F.col("cell").alias("c"), F.col("part").alias("p"), F.col("size").alias("s"), F.explode(F.array_compact(F.array(*near))).alias("cell"))
    pairs = staged(left.join(names, "cell").where("cell > c or part >= p").selectExpr("c", "p", "cell", "part", "s * size as work"), "tile-pairs")
    work = pairs.agg(F.sum("work")).first()[0] or 0
    tasks = int(min(100_000, max(spark.sparkContext.defaultParallelism, work // TASK_WORK)))
    first = tiles.select(F.col("cell").alias("c"), F.col("part").alias("p"), F.col("fps").alias("a"))
    met = pairs.join(first, ["c", "p"]).select("a", "cell", "part").repartition(tasks, "cell", "part")
    both = met.join(tiles.repartition(tasks, "cell", "part"), ["cell", "part"]).select("a", F.col("fps").alias("b"))
    return both.mapInArrow(_tile_links(radius), "u long, v long")


def simhash_components(docs: DataFrame, radius: int = 2) -> DataFrame:
    """(doc_id, fp, component_id) of each row: texts linked at radius or fewer differing bits, transitively."""
    prints = staged(fingerprints(docs), "fingerprints")
    classes = staged(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "classes")
    roots = connected_components(near_links(classes, radius), "simhash")
    rooted = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("component", "fp"))
    least = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def near_dedup(docs: DataFrame) -> DataFrame:
    """Rows of docs, one of each component of near copies (neardup): that with the component's smallest doc_id.

    Ids are unique in documents; of rows that repeat an id all stay or none, and rows without an id, which nothing tells
    apart, stay if any of them is in a component without ids.
    """
    from lexigrid.llm.neardup import near_components  # which uses this module

    found = near_components(docs)
    keep = found.where("doc_id <=> component_id").select(F.col("doc_id").alias("_keep")).distinct()
    return docs.join(keep, docs["doc_id"].eqNullSafe(keep["_keep"]), "left_semi")


def op1_simhash(spark, sf_dir: str) -> DataFrame:
    found = simhash_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
