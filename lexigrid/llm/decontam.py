"""Benchmark decontamination by template windows.

Numbers, units after a number, and names (capitalised words inside a sentence) become typed placeholders. Windows of five
template words with at least three literal ones are hashed and joined with the windows of the benchmark's items. For a
document and an item, the share of the item's windows found must reach min_share; then the slots are compared: where
each value of the item always meets the same value in the document, the question is the item, verbatim or with other
parameters; different values of the item may meet equal ones. Slots are read by occurrence, that is by windows whose
place in the document less that in the item is equal, or moves by no more than half the item's windows from one to the
next, where words have been put in; an occurrence counts if it reaches min_share. Parts scattered over a document are
read together.

An item of fewer than five words is one window of its own width. An item without a usable template window is looked for
by windows of its words themselves, placeholders left out. Documents get windows of each shape that items have.

Defined results: null text counts as empty; an item without a word can't be found; in ``contaminated``, which names
documents, rows that repeat a doc_id count as one document and rows without doc_id are left out, while
``drop_contaminated`` judges every row by its own text; of places or values that tie each counts once; very long texts
are read whole; an empty table gives an empty result; other columns are ignored, or pass through ``drop_contaminated``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexigrid.llm.common import pieces, staged

WIDTH, LITERALS = 5, 3
#: The shape of a window: its number of words, and this added where words stand for themselves.
PLAIN = 8
#: Above so many distinct windows of the benchmark (8 bytes each), documents' windows are joined unfiltered.
MOST_HASHES = 4_000_000
#: Units of measure that become a placeholder after a number: fixed values.
UNITS = frozenset("mm cm m km in ft yd mi mg g kg t lb oz ml l gal s sec min h hr hours minutes seconds days weeks years eur usd dollars euros cents percent % kb mb gb tb hz khz mhz ghz w kw v a c f k mph kph".split())
_NUMBER = re.compile(r"[$€£+-]?[0-9][0-9.,:/]*%?")
_EDGE = re.compile(r"^[^\w$€£+%-]+|[^\w%]+$")
LITERAL, NUMBER, UNIT, NAME = 0, 1, 2, 3
#: The reading of a whole document, besides those by start and by occurrence.
WHOLE = 2
_PRIME = np.uint64(0x9E3779B97F4A7C15)


class _Words(dict):
    """word -> its row in the arrays of hashes of literal forms and of flags."""

    MOST = 500_000

    def __init__(self) -> None:
        self.hashes, self.flags = np.zeros(1 << 12, np.uint64), np.zeros(1 << 12, np.uint8)

    def __missing__(self, word: str) -> int:
        plain = word.isalpha()
        core = word if plain else _EDGE.sub("", word)
        low = core.lower()
        row = len(self)
        if row == len(self.hashes):
            self.hashes, self.flags = np.concatenate([self.hashes] * 2), np.concatenate([self.flags] * 2)
        number = not plain and bool(_NUMBER.fullmatch(core))
        self.hashes[row] = xxhash.xxh3_64_intdigest(low)
        self.flags[row] = number | (low in UNITS) << 1 | ((plain or core.isalpha()) and core.istitle()) << 2 | (not plain and word[-1] in ".!?:") << 3
        self[word] = row
        return row


#: A worker's words, kept from task to task.
_KNOWN = _Words()


def _worker_words() -> _Words:
    return _KNOWN


def template(text: str, known: _Words) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """The words of a text, their hashes, those with slots replaced by placeholders, and their types."""
    if len(known) > known.MOST:
        known.clear()
    words, fresh = [], []
    for line in text.split("\n"):  # a line begins a sentence
        own = line.split()
        if own:
            fresh.append(len(words))
            words += own
    rows = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
    hashes, flags = known.hashes[rows], known.flags[rows]
    begins = np.zeros(len(words), bool)
    begins[1:] = (flags[:-1] & 8) > 0
    begins[fresh] = True
    number = (flags & 1) > 0
    unit = np.zeros(len(words), bool)
    unit[1:] = ((flags[1:] & 2) > 0) & number[:-1]
    kind = np.where(number, NUMBER, np.where(unit, UNIT, np.where(((flags & 4) > 0) & ~begins, NAME, LITERAL))).astype(np.uint8)
    return words, hashes, np.where(kind > 0, kind.astype(np.uint64), hashes), kind


def windows(plain: np.ndarray, hashes: np.ndarray, kind: np.ndarray, shape: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and whether it may be used, for the window of a shape from each place on."""
    n = shape % PLAIN
    count = max(0, len(hashes) - n + 1)
    if shape > PLAIN:
        hashes, kind = plain, np.zeros_like(kind)
    out, literal = np.full(count, shape, np.uint64), np.zeros(count, np.uint8)
    for k in range(n if count else 0):
        out = (out ^ hashes[k : k + count]) * _PRIME
        out ^= out >> np.uint64(29)
        literal += kind[k : k + count] == LITERAL
    return out, literal >= min(LITERALS, n)


def _slots(words: list[str], kind: np.ndarray, at: int, shape: int) -> str:
    """The values of a window's slots; windows of words themselves have none."""
    return "" if shape > PLAIN else "\x1f".join(_EDGE.sub("", words[k]).lower() for k in range(at, at + shape) if kind[k])


def _own_shape(plain: np.ndarray, hashes: np.ndarray, kind: np.ndarray) -> list[int]:
    """An item's shape; none without words."""
    n = min(WIDTH, len(kind))
    return [n if windows(plain, hashes, kind, n)[1].any() else n + PLAIN] if n else []


def _window_batches(wanted, shapes: list[int] | None = None):
    """wanted: a broadcast sorted array of hashes, outside which windows are left out; or None. shapes: None for a text's own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _worker_words()
        for batch in pieces(batches):
            ids, hs, ats, slots, total, shaped = [], [], [], [], [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words, *arrays = template(text or "", known)
                for shape in _own_shape(*arrays) if shapes is None else shapes:
                    full, usable = windows(*arrays, shape)
                    if wanted is not None:
                        some = wanted.value
                        place = np.minimum(np.searchsorted(some, full), len(some) - 1)
                        found = np.flatnonzero(usable & (some[place] == full)) if len(some) else np.zeros(0, np.int64)
                    else:
                        found = np.flatnonzero(usable)
                    ids += [key] * len(found)
                    hs.append(full[found])
                    ats += found.tolist()
                    total += [int(usable.sum())] * len(found)
                    shaped += [shape] * len(found)
                    slots += [_slots(words, arrays[2], at, shape) for at in found.tolist()]
            if ids:
                out = pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(np.concatenate(hs).view(np.int64)), pa.array(ats, pa.int32()), pa.array(slots, pa.string()), pa.array(total, pa.int32()), pa.array(shaped, pa.int32())],
                    ["id", "hash", "at", "slots", "n", "shape"],
                )
                yield from (out.slice(k, 1 << 16) for k in range(0, len(out), 1 << 16))

    return run


SCHEMA = "id long, hash long, at int, slots string, n int, shape int"


def contaminated(docs: DataFrame, benchmark: DataFrame, min_share: float = 0.6) -> DataFrame:
    """(doc_id, item_id, share, verbatim, consistent) for each document and item of which it holds at least min_share."""
    spark = docs.sparkSession
    items = benchmark.where("item_id is not null").select(F.col("item_id").cast("long"), "text")
    items = staged(items.mapInArrow(_window_batches(None), SCHEMA).dropDuplicates(["id", "hash", "slots", "at"]), "benchmark-windows")
    shapes = sorted(r[0] for r in items.select("shape").distinct().collect())  # at most ten
    known = items.select("hash").distinct()
    wanted = None
    if known.count() <= MOST_HASHES:  # a proven bound of 32 MB; beyond it, the join alone decides
        rows = np.array([r[0] for r in known.toLocalIterator()], np.int64).view(np.uint64)
        wanted = spark.sparkContext.broadcast(np.sort(rows))
    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), "text")
    held = texts.mapInArrow(_window_batches(wanted, shapes), SCHEMA)
    # Per item and hash the places are few.
    hits = held.alias("d").join(items.alias("i"), "hash").select(
        F.col("d.id").alias("doc_id"), F.col("i.id").alias("item_id"), F.col("i.at").alias("place"), F.col("i.n").alias("n"),
        (F.col("d.at") - F.col("i.at")).alias("start"), F.col("d.slots").alias("theirs"), F.col("i.slots").alias("ours"),
    )
    hits = hits.groupBy("doc_id", "item_id", "n", "place", "start", "theirs", "ours").agg(F.count("*").alias("c"))
    hits = staged(hits.drop("c"), "hits")
    share = hits.groupBy("doc_id", "item_id", "n").agg((F.count_distinct("place") / F.col("n")).alias("share")).where(F.col("share") >= min_share).drop("n")
    # A window holds the places of one item in one document, no more than its text has.
    by = Window.partitionBy("doc_id", "item_id").orderBy("start")
    mine = hits.join(share.select("doc_id", "item_id"), ["doc_id", "item_id"], "left_semi")
    mine = mine.withColumn("moved", (F.col("start") - F.lag("start").over(by) > F.col("n") / 2).cast("int"))
    mine = mine.withColumn("occurrence", F.sum(F.coalesce("moved", F.lit(0))).over(by))
    readings = F.array(*(F.struct(F.lit(k).alias("kind"), F.col(c).cast("long").alias("id")) for k, c in enumerate(("start", "occurrence"))), F.struct(F.lit(WHOLE).alias("kind"), F.lit(0).cast("long").alias("id")))
    # For each window of a reading the slots equal to the item's count if there are any.
    read = mine.withColumn("reading", F.explode(readings)).groupBy("doc_id", "item_id", "n", "reading", "place", "ours")
    read = read.agg(F.max(F.col("ours") == F.col("theirs")).alias("same"), F.min("theirs").alias("other"))
    read = read.withColumn("pair", F.explode(F.arrays_zip(F.split("ours", "\x1f").alias("a"), F.split(F.when(F.col("same"), F.col("ours")).otherwise(F.col("other")), "\x1f").alias("b"))))
    read = read.groupBy("doc_id", "item_id", "n", "reading").agg(
        F.min("same").alias("same"), (F.count_distinct("place") / F.col("n") >= min_share).alias("enough"),
        (F.count_distinct("pair") == F.count_distinct("pair.a")).alias("consistent"),
    )
    whole = F.col("reading.kind") == WHOLE
    slots = read.groupBy("doc_id", "item_id").agg(F.max(whole & F.col("same")).alias("verbatim"), F.max(F.col("consistent") & (whole | F.col("enough"))).alias("consistent"))
    return share.join(slots, ["doc_id", "item_id"])


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, min_share: float = 0.6) -> DataFrame:
    """Rows of docs without those whose text holds an item with consistent slots, be they with a doc_id or without.

    A text goes by its hash: all rows of one text share its verdict, and texts collide by 64 bits' chance alone.
    """
    key = F.xxhash64(docs["text"])
    texts = docs.where("text is not null").select(key.alias("doc_id"), "text")
    found = contaminated(texts, benchmark, min_share).where("consistent").select(F.col("doc_id").alias("_found")).distinct()
    return docs.join(found, key == found["_found"], "left_anti")


def op4_decontamination(spark, sf_dir: str) -> DataFrame:
    """A row for each document that holds a benchmark item, with its items; other documents are left out."""
    found = contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where("consistent").groupBy("doc_id").agg(
        F.count("*").alias("n_items"), F.max("share").alias("share"), F.max("verbatim").alias("verbatim"),
        F.array_join(F.transform(F.array_sort(F.collect_list("item_id")), lambda i: i.cast("string")), ",").alias("items"),
    )
