"""Near-duplicate components: texts whose sets of 5-word shingles have Jaccard similarity of 0.8 or more, transitively.

Candidates come from SimHash, as in operator 1 but with a radius for that similarity: two 64-bit fingerprints of a text's
distinct 2-word shingles, compared tile against tile. A pair is a candidate if the first differ in at most RADIUS bits and
both together in at most RADIUS_BOTH. Two exact bounds leave pairs out: similar sets have sizes within 4 : 5, so a
tile meets only tiles of its own size band and the next ones; fingerprints within RADIUS have population counts within it.
Texts linked by candidate pairs, transitively, are brought together in tiles, and each candidate pair is decided by its
exact similarity, unless the tile has linked both already. A tile returns a spanning forest of its links, never all pairs.

A word changed in a text costs five of the 5-word shingles but two of the 2-word ones, so that similarity 0.8 leaves few bits
different: on 23,640 different texts of the check's smaller table, all 2,165 pairs found similar were within both radii.

Defined results: words are runs without white space, ASCII letters in lower case; null text counts as empty; a text of
fewer than five words is one shingle; texts without words are like each other; equal sets of shingles are one class.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrid.llm.common import connected_components, pieces, staged
from lexigrid.llm.simhash import TASK_WORK, fingerprint, forest

#: Words of a shingle: of the sets that are compared, and of what is fingerprinted.
WIDTH, PRINT_WIDTH = 5, 2
RADIUS, RADIUS_BOTH = 16, 28
#: Similarity as a fraction, so that the comparison is exact.
OVER, UNDER = 4, 5
TILE_BYTES = 4 << 20
#: Fingerprints of a tile; comparisons made at once.
TILE_ROWS, AT_ONCE = 1 << 15, 1 << 20
_PRIME, _OTHER = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def word_hashes(data: bytes) -> np.ndarray:
    words = data.lower().split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def shingles(hashes: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles, from its words' hashes."""
    if not len(hashes):
        return hashes
    n = min(width, len(hashes))
    out = np.full(len(hashes) - n + 1, n, np.uint64)
    for k in range(n):
        out = (out ^ hashes[k : k + len(out)]) * _PRIME
        out ^= out >> np.uint64(29)
    return np.unique(out)


def prints(some: np.ndarray) -> tuple[int, int]:
    """Two fingerprints of a set of hashes."""
    first = (some ^ some >> np.uint64(32)) * _OTHER
    second = (first ^ first >> np.uint64(32)) * _PRIME
    return fingerprint(first ^ first >> np.uint64(32)), fingerprint(second ^ second >> np.uint64(29))


def band(size: int) -> int:
    """Sizes within 4 : 5 are in the same band or in neighbours; the base is a little wider than that."""
    return int(math.log(size) / math.log(1.26)) if size else -1


def near(first: np.ndarray, second: np.ndarray, one: np.uint64, other: np.uint64) -> np.ndarray:
    """Whether fingerprints are within both radii of another's."""
    bits = np.bitwise_count(first ^ one)
    return (bits <= RADIUS) & (bits + np.bitwise_count(second ^ other) <= RADIUS_BOTH)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets of shingles have the similarity."""
    if UNDER * min(len(a), len(b)) < OVER * max(len(a), len(b)):
        return False
    both = np.sort(np.concatenate([a, b]))
    common = int((both[1:] == both[:-1]).sum())
    return UNDER * common >= OVER * (len(both) - common)


def _sketch_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        out = []
        for text in batch.column(2).cast(pa.binary()).to_pylist():
            hashes = word_hashes(text or b"")
            some = shingles(hashes)
            out.append((xxhash.xxh3_64_intdigest(some.tobytes()), *prints(shingles(hashes, PRINT_WIDTH))) + (band(len(some)) % 2**64,))
        columns = np.array(out, np.uint64).reshape(-1, 4).T.copy().view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, columns)], ["doc_id", "hash", "key", "first", "second", "band"])


def compare_prints(a: np.ndarray, b: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Candidate pairs within a tile, or between two, as a spanning forest. A tile has rows of key, first and second."""
    side = a if b is None else b
    keys = a[0] if b is None else np.concatenate([a[0], b[0]])
    shift = 0 if b is None else len(a[0])
    at_a, at_b = (np.argsort(np.bitwise_count(t[1]), kind="stable") for t in (a, side))
    ones = np.bitwise_count(side[1])[at_b].astype(int)
    step, i, j = max(1, AT_ONCE // max(1, len(at_b))), [np.zeros(0, int)], [np.zeros(0, int)]
    for at in range(0, len(at_a), step):
        rows = at_a[at : at + step]
        counts = np.bitwise_count(a[1][rows[[0, -1]]]).astype(int)
        cols = at_b[np.searchsorted(ones, counts[0] - RADIUS) : np.searchsorted(ones, counts[1] + RADIUS, "right")]
        r, c = np.nonzero(np.bitwise_count(a[1][rows][:, None] ^ side[1][cols][None, :]) <= RADIUS)
        r, c = rows[r], cols[c]
        keep = near(a[1][r], a[2][r], side[1][c], side[2][c]) & ((b is not None) | (r != c))
        if keep.any():
            u, v = forest(r[keep], c[keep] + shift, len(keys))
            i.append(u)
            j.append(v)
    u, v = np.concatenate(i), np.concatenate(j)
    if len(u):
        u, v = forest(u, v, len(keys))
    return keys[u], keys[v]


def _candidate_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        links = [np.zeros((2, 0), np.uint64)]
        for k in range(len(batch)):
            a, b = (None if x is None else np.array([x.field(n).to_numpy().view(np.uint64) for n in range(3)]) for x in (batch.column(c)[k].values for c in (0, 1)))
            links.append(np.array(compare_prints(a, b)))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in np.concatenate(links, axis=1).view(np.int64)], ["u", "v"])


def candidate_links(classes: DataFrame) -> DataFrame:
    """Links (u, v) of keys that connect all candidate pairs of classes (key, first, second, band).

    A pair of tiles is dealt out by both tiles' names, and the number of tasks follows from the comparisons to make.
    """
    parts = classes.groupBy("band").agg(F.ceil(F.count("*") / TILE_ROWS).cast("int").alias("parts"))
    tiles = classes.join(parts, "band").groupBy("band", F.expr("cast(pmod(xxhash64(key), parts) as int)").alias("part"))
    tiles = staged(tiles.agg(F.collect_list(F.struct("key", "first", "second")).alias("a")), "print-tiles")  # about TILE_ROWS
    left = tiles.select(F.col("band").alias("c"), F.col("part").alias("p"), F.size("a").cast("long").alias("s"))
    right = tiles.select("band", "part", F.size("a").cast("long").alias("size"))
    met = left.select("*", F.explode(F.array(F.col("c"), F.col("c") + 1)).alias("band")).join(right, "band").where("band > c or part >= p")
    met = staged(met, "print-pairs")
    work = met.agg(F.sum(F.col("s") * F.col("size"))).first()[0] or 0
    tasks = int(min(100_000, max(classes.sparkSession.sparkContext.defaultParallelism, work // TASK_WORK)))
    first = tiles.select(F.col("band").alias("c"), F.col("part").alias("p"), "a")
    whole = met.join(first, ["c", "p"]).join(tiles.withColumnRenamed("a", "b"), ["band", "part"])
    same = (F.col("c") == F.col("band")) & (F.col("p") == F.col("part"))
    dealt = whole.select("a", F.when(~same, F.col("b")).alias("b"), "c", "p", "band", "part").repartition(tasks, "c", "p", "band", "part")
    return dealt.select("a", "b").mapInArrow(_candidate_batches, "u long, v long")


def _set_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        sets = [shingles(word_hashes(t or b"")).tobytes() for t in batch.column(3).cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sets, pa.binary())], ["part_of", "key", "marks", "shingles"])


def tile_links(keys: np.ndarray, marks: np.ndarray, sets: list[np.ndarray], split: int) -> list[tuple[int, int]]:
    """Links that connect what is similar within a tile (split 0), or between its first split members and the others."""
    label, out = np.arange(len(keys)), []
    for i in range(split or len(keys)):
        others = np.arange(split or i + 1, len(keys))
        others = others[label[others] != label[i]]
        for j in others[near(*marks[others].T, *marks[i])].tolist():
            if label[j] != label[i] and similar(sets[i], sets[j]):
                out.append((int(keys[i]), int(keys[j])))
                label[label == label[j]] = label[i]
    return out


def _link_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        links = []
        for k in range(len(batch)):
            a, b = batch.column(0)[k].values, batch.column(1)[k].values
            whole = a if b is None else pa.concat_arrays([a, b])
            keys = whole.field("key").to_numpy()
            marks = whole.field("marks").flatten().to_numpy().view(np.uint64).reshape(-1, 2)
            sets = [np.frombuffer(s, np.uint64) for s in whole.field("shingles").to_pylist()]
            links += tile_links(keys, marks, sets, 0 if b is None else len(a))
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], ["u", "v"])


def near_components(docs: DataFrame) -> DataFrame:
    """(doc_id, key, component_id) of each row; component_id is the least doc_id of its component."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("hash"), text.alias("text"))
    found = rows.mapInArrow(_sketch_batches, "doc_id long, hash long, key long, first long, second long, band long")
    found = staged(found, "sketches")
    one = F.min(F.struct("hash", "first", "second", "band")).alias("x")  # equal sets have equal fingerprints
    classes = staged(found.groupBy("key").agg(F.min("doc_id").alias("rep"), one).select("key", "rep", "x.*"), "classes")
    stars = candidate_links(classes)
    parts_of = connected_components(stars, "candidates").select(F.col("node").alias("key"), F.col("component").alias("part_of"))
    # Classes without a candidate end here; a text of each other class gives its set.
    wanted = staged(classes.join(parts_of, "key").select("hash", "key", "part_of", F.array("first", "second").alias("marks")), "candidates")
    held = rows.select("hash", "text").join(wanted, "hash").groupBy("part_of", "key", "marks").agg(F.any_value("text").alias("text"))
    sets = held.select("part_of", "key", "marks", "text").mapInArrow(_set_batches, "part_of long, key long, marks array<long>, shingles binary")
    sets = staged(sets, "shingles")
    parts = sets.groupBy("part_of").agg(F.ceil(F.sum(F.length("shingles") + 24) / TILE_BYTES).cast("int").alias("parts"))
    tiles = sets.join(parts, "part_of").groupBy("part_of", F.expr("cast(pmod(xxhash64(key), parts) as int)").alias("part"))
    tiles = staged(tiles.agg(F.collect_list(F.struct("key", "marks", "shingles")).alias("a")), "tiles")  # about TILE_BYTES
    within = tiles.select("a", F.lit(None).cast(tiles.schema["a"].dataType).alias("b"))
    across = tiles.alias("x").join(tiles.alias("y"), F.expr("x.part_of = y.part_of and x.part < y.part")).select(F.col("x.a"), F.col("y.a").alias("b"))
    links = within.union(across).mapInArrow(_link_batches, "u long, v long")
    roots = connected_components(links, "near").withColumnRenamed("node", "key")
    rooted = classes.join(roots, "key", "left").withColumn("root", F.coalesce("component", "key"))
    least = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = rooted.join(least, "root").select("key", "component_id")
    return found.join(named, "key").select("doc_id", "key", "component_id")
