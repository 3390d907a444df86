"""Language ID with language-bitmask n-gram filters.

One Bloom filter serves all languages: each slot holds a bit mask with a bit per language, in as many 64-bit words as the
languages need, sliced so that a lookup reads every language at once. An n-gram sets its language's bit in each of its slots; the conjunction of the slots' masks gives
all languages that may hold it. For a text, each language's count of n-grams found is corrected for the share that the
language's fill lets through by chance, (hits - n * f) / (1 - f) with f = fill ** hashes, and the largest decides.

Only n-grams that are typical of a language enter its bit: those at least half as frequent there as in any other, among
n-grams of at least min_share of the language's. The filter is trained on a bounded sample of labelled rows: of every
language about TRAIN_TEXTS distinct texts, drawn by hash, so that rare languages count as much as common ones and a
large group of copies as much as one text.

Defined results: null text, or text without a letter (Unicode category L), is ``und`` with score 0; ties go to the
language first in code point order; without any labelled row all texts are ``und``; repeated rows get equal results; rows
with null lang are not learned from; very long texts are read whole, in pieces of PIECE characters; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexigrid.llm.common import pieces, staged

SLOTS, HASHES, ORDERS = 1 << 20, 2, (2, 3, 4)
#: Bounds of training, by language: texts in the sample, n-grams in the filter.
TRAIN_TEXTS, GRAMS = 5_000, 60_000
#: Characters of a text that are looked up at once.
PIECE = 1 << 18
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def _flat(text: str) -> str:
    """The text's letters in lower case, all else one space."""
    return " " + " ".join(re.split(r"[\W\d_]+", text.lower())).strip() + " "


def _parts(texts: list[str]) -> Iterator[tuple[list[str], list[int], int]]:
    """Texts in groups of about PIECE characters, with the number of each; a longer text in pieces, whose last
    max(ORDERS) - 1 characters begin the next one (the third value: how many of the end are such)."""
    more, held, rows, size = max(ORDERS) - 1, [], [], 0
    for k, text in enumerate(map(_flat, texts)):
        at = 0
        while len(text) - at > PIECE + more:
            yield [text[at : at + PIECE + more]], [k], more
            at += PIECE
        held.append(text[at:])
        rows.append(k)
        size += len(held[-1])
        if size > PIECE:
            yield held, rows, 0
            held, rows, size = [], [], 0
    if held:
        yield held, rows, 0


def grams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashes of the character n-grams of texts, and the number of the text of each, a part at a time."""
    for flat, numbers, again in _parts(texts):
        points = np.frombuffer("".join(flat).encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
        row = np.repeat(numbers, [len(t) for t in flat])
        for n in ORDERS:
            count = len(points) - max(n - 1, again)  # n-grams that begin in the overlap belong to the next piece
            if count < 1:
                continue
            h = np.full(count, n, np.uint64)
            for k in range(n):
                h = (h ^ points[k : k + count]) * _MIX
                h ^= h >> np.uint64(31)
            inside = row[:count] == row[n - 1 : n - 1 + count]
            yield h[inside], row[:count][inside]


def _slots(h: np.ndarray) -> Iterator[np.ndarray]:
    for k in range(HASHES):
        yield ((h >> np.uint64(20 * k)) & np.uint64(SLOTS - 1)).astype(np.int64)


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        langs, texts = np.array(batch.column(0).to_pylist(), object), batch.column(1).to_pylist()
        for lang in sorted(set(langs)):
            for h, _ in grams([texts[k] or "" for k in np.flatnonzero(langs == lang)]):
                found, counts = np.unique(h, return_counts=True)
                out = pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(found.view(np.int64)), pa.array(counts.astype(np.int64))], ["lang", "gram", "c"])
                yield from (out.slice(k, 1 << 16) for k in range(0, len(out), 1 << 16))


def sample(labelled: DataFrame, texts: int = TRAIN_TEXTS) -> DataFrame:
    """(lang, text) of about texts distinct texts of each language, by hash."""
    most = float(1 << 63)
    share = labelled.groupBy("lang").agg(F.count("*").alias("rows")).select("lang", (F.lit(texts * most) / F.col("rows")).alias("line"))
    place = F.xxhash64("text").bitwiseAND(F.lit((1 << 63) - 1))
    drawn = labelled.join(share, "lang").where(place.cast("double") < F.col("line"))
    return drawn.groupBy("lang", place.alias("place")).agg(F.min("text").alias("text")).select("lang", "text")


def train(labelled: DataFrame, min_share: float = 2e-5) -> tuple[list[str], np.ndarray]:
    """Languages in code point order, and the filter's slots: SLOTS rows of a word for each 64 languages."""
    counts = sample(labelled).mapInArrow(_count_batches, "lang string, gram long, c long").groupBy("lang", "gram").agg(F.sum("c").alias("c"))
    counts = staged(counts, "grams")
    totals = counts.groupBy("lang").agg(F.sum("c").alias("total"))
    langs = sorted(r[0] for r in totals.select("lang").collect())  # a row for each language
    shares = counts.join(totals, "lang").withColumn("share", F.col("c") / F.col("total")).where(F.col("share") >= min_share)
    top = F.max("share").over(Window.partitionBy("gram"))  # at most a row for each language
    typical = shares.withColumn("top", top).where(F.col("share") * 2 >= F.col("top"))
    # min_share bounds a language's n-grams to 1 / min_share, and GRAMS again.
    ranked = typical.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("share"), "gram"))).where(F.col("rank") <= GRAMS)
    numbers = counts.sparkSession.createDataFrame(list(enumerate(langs)), "number int, lang string")
    slot = F.explode(F.array(*(F.shiftrightunsigned("gram", 20 * k).bitwiseAND(F.lit(SLOTS - 1)).cast("int") for k in range(HASHES))))
    bits = ranked.join(numbers, "lang").select(slot.alias("slot"), F.expr("cast(number div 64 as int)").alias("word"), F.expr("shiftleft(1L, number % 64)").alias("bit"))
    table = np.zeros((SLOTS, max(1, -(-len(langs) // 64))), np.uint64)
    masks = bits.groupBy("slot", "word").agg(F.bit_or("bit").alias("mask")).toPandas()  # at most a row for each slot and word
    table[masks["slot"].to_numpy(np.int64), masks["word"].to_numpy(np.int64)] = masks["mask"].to_numpy(np.int64).view(np.uint64)
    return langs, table


def _predict_batches(langs: list[str], table):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = table.value
        place = [(k // 64, np.uint64(k % 64)) for k in range(len(langs))]
        fill = np.array([((slots[:, w] >> bit) & np.uint64(1)).mean() for w, bit in place])
        chance = np.minimum(fill**HASHES, 0.999)
        for batch in pieces(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            n, hits = np.zeros(len(texts)), np.zeros((len(texts), len(langs)))
            for h, row in grams(texts) if langs else ():
                first, last = (int(row[0]), int(row[-1]) + 1) if len(row) else (0, 0)
                own, size = row - first, last - first
                n[first:last] += np.bincount(own, minlength=size)
                mask = [np.full(len(h), np.uint64(2**64 - 1)) for _ in range(slots.shape[1])]
                for s in _slots(h):
                    for w in range(len(mask)):
                        mask[w] &= slots[s, w]
                for k, (w, bit) in enumerate(place):
                    hits[first:last, k] += np.bincount(own, (mask[w] >> bit) & np.uint64(1), size)
            fair = np.maximum(0, (hits - n[:, None] * chance) / (1 - chance))
            best, score = [], []
            for t, x, m in zip(texts, fair, n, strict=True):
                if not langs or not _has_letter(t):
                    best.append("und")
                    score.append(0.0)
                else:
                    k = int(np.argmax(x))
                    best.append(langs[k])
                    score.append(float(min(1.0, x[k] / max(1, m))))
            yield pa.RecordBatch.from_arrays([*batch.columns[:1], pa.array(best, pa.string()), pa.array(score, pa.float64()), batch.column(2)], ["doc_id", "lang_pred", "score", "held_out"])

    return run


def identify(docs: DataFrame, langs: list[str], table: np.ndarray) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of each row; docs has doc_id, text and held_out."""
    shared = docs.sparkSession.sparkContext.broadcast(table)  # SLOTS * 8 bytes for each 64 languages, whatever the corpus
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double, held_out boolean"
    return docs.select("doc_id", "text", "held_out").mapInArrow(_predict_batches(langs, shared), schema).select("doc_id", "held_out", "lang_pred", "score")


def op7_langid(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    docs = docs.withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False)))
    langs, table = train(docs.where("not held_out and lang is not null"))
    return identify(docs, langs, table)
