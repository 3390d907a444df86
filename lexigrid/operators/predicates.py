"""Predicates over a whole match, as expressions and joins with the phrase table itself.

Each takes matches (text, letters, n_letters, n_words, sort_key, rev, score, ...) and returns those that it holds of, with a
column note_<n>.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigrid.operators.verify import PIECE_SHARE, REVERSAL_SHARE
from lexigrid.plans.lower import between
from lexigrid.plans.syntax import count_range

#: A piece of up to DEBRIS_CHARS characters needs DEBRIS_SHARE of the words that end with it, where that test is on.
DEBRIS_CHARS, DEBRIS_SHARE = 6, 0.03


def known_words(table: DataFrame, share: float) -> DataFrame:
    """(word, count) of single words with at least a share of all words' occurrences."""
    single = table.where("n_words = 1").select(F.col("text").alias("word"), F.col("score").alias("count"))
    whole = single.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("total"))
    return single.join(F.broadcast(whole), F.col("count") >= F.col("total") * share).drop("total")  # one row is broadcast


def palindrome(df: DataFrame, note: str) -> DataFrame:
    return df.where((F.col("n_letters") >= 2) & (F.col("letters") == F.col("rev"))).withColumn(note, F.lit(""))


def reversible(df: DataFrame, note: str, table: DataFrame) -> DataFrame:
    known = known_words(table, REVERSAL_SHARE).select(F.col("word").alias("_back"))
    return df.where("letters <> rev").join(known, F.col("rev") == F.col("_back")).withColumn(note, F.concat(F.lit("← "), "_back")).drop("_back")


def suffix_counts(table: DataFrame) -> DataFrame:
    """(suffix, total): occurrences of the words that end with each suffix of 2 to DEBRIS_CHARS characters."""
    single = table.where("n_words = 1").select("text", "score")
    cut = F.transform(F.sequence(F.lit(2), F.least(F.lit(DEBRIS_CHARS), F.length("text"))), lambda n: F.right("text", n))
    return single.where(F.length("text") >= 2).select(F.explode(cut).alias("suffix"), "score").groupBy("suffix").agg(F.sum("score").alias("total"))


def pieces(table: DataFrame, debris: bool = False) -> DataFrame:
    """(word): what a compound may consist of."""
    known = known_words(table, PIECE_SHARE).where(F.length("word") >= 2)
    if debris:
        known = known.join(suffix_counts(table), F.col("word") == F.col("suffix"), "left")
        known = known.where((F.length("word") > DEBRIS_CHARS) | (F.col("count") >= DEBRIS_SHARE * F.coalesce("total", F.lit(0))))
    return known.select("word")


def splits(words: DataFrame, n: int, known: DataFrame) -> DataFrame:
    """(word, shortest, split) of words that cut into n known ones: the shortest piece is longest, ties to the earliest
    cut, level by level."""
    if n == 1:
        return words.join(known, "word", "left_semi").select("word", F.length("word").alias("shortest"), F.col("word").alias("split"))
    cut = words.where(F.length("word") >= 2 * n).select("word", F.explode(F.sequence(F.lit(2), F.length("word") - 2 * (n - 1))).alias("cut"))
    cut = cut.select("word", "cut", F.expr("left(word, cut)").alias("first"), F.expr("substr(word, cut + 1)").alias("rest"))
    cut = cut.join(known.withColumnRenamed("word", "first"), "first", "left_semi")
    rest = splits(cut.select(F.col("rest").alias("word")).distinct(), n - 1, known)
    both = cut.join(rest.select(F.col("word").alias("rest"), "shortest", "split"), "rest")
    choice = F.struct(F.least("cut", "shortest").alias("shortest"), (-F.col("cut")).alias("order"), F.concat_ws("·", "first", "split").alias("split"))
    return both.groupBy("word").agg(F.max(choice).alias("best")).select("word", "best.shortest", "best.split")


def compound(df: DataFrame, note: str, table: DataFrame, n: int, debris: bool = False) -> DataFrame:
    words = df.where("n_words = 1").select(F.col("text").alias("word")).distinct()
    found = splits(words, n, pieces(table, debris)).select(F.col("word").alias("text"), F.col("split").alias(note))
    return df.join(found, "text")


def known_ends(df: DataFrame, stress: DataFrame) -> DataFrame:
    """Rows whose first and last words are known. Words are broadcast: a dictionary is as large as its language."""
    known = F.broadcast(stress.select("word").distinct())
    for at, end in ((1, "_first"), (-1, "_last")):
        df = df.withColumn(end, F.substring_index("text", " ", at)).join(known.withColumnRenamed("word", end), end, "left_semi").drop(end)
    return df


def shapes(df: DataFrame, stress: DataFrame) -> DataFrame:
    """(text, shape): the stress of texts of which every word is known, word by word."""
    each = df.select("text").distinct().select("text", F.posexplode(F.split("text", " ")).alias("at", "word"))
    met = each.join(stress, "word", "left").groupBy("text").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "shape"))), lambda x: x["shape"]), "").alias("shape"),
        F.min(F.col("shape").isNotNull()).alias("all"),
    )
    return met.where("all").select("text", "shape")


def syllables(df: DataFrame, note: str, stress: DataFrame, spec: str) -> DataFrame:
    low, high = (int(spec), int(spec)) if spec.isdigit() else count_range(spec)
    df = known_ends(df, stress)  # what is joined below, and dealt out for it, is what may match
    found = shapes(df, stress).where(between(F.length("shape"), low, high))
    return df.join(found.select("text", F.concat(F.length("shape").cast("string"), F.lit(" syll")).alias(note)), "text")


def stressed(df: DataFrame, note: str, stress: DataFrame, spec: str) -> DataFrame:
    df = known_ends(df, stress)  # what is joined below, and dealt out for it, is what may match
    found = shapes(df, stress).where(F.translate("shape", "2", "1") == spec.replace("2", "1"))
    return df.join(found.select("text", F.lit("").alias(note)), "text")


def anagram_of(df: DataFrame, note: str, entries: DataFrame) -> DataFrame:
    """entries (pos, entry): the first with the same letters in another order."""
    from lexigrid.functions.text import letters, sort_key

    keyed = entries.select("pos", "entry", letters(F.col("entry")).alias("_l")).withColumn("_key", sort_key(F.col("_l")))
    met = df.join(keyed, (F.col("sort_key") == F.col("_key")) & (F.col("letters") != F.col("_l")))
    first = met.groupBy("text").agg(F.min(F.struct("pos", "entry")).alias("first"))
    return df.join(first.select("text", F.concat(F.lit("← "), "first.entry").alias(note)), "text")


def iso(df: DataFrame, note: str, cipher: str) -> DataFrame:
    """The places where each letter stands first are the same in both texts, and so are the spaces."""
    plain = cipher.replace(" ", "")
    gaps = "^" + " ".join(f"[a-z]{{{len(w)}}}" for w in cipher.split(" ")) + "$"
    places = F.expr("transform(split(letters, ''), c -> instr(letters, c))")
    wanted = F.array(*(F.lit(plain.index(c) + 1) for c in plain))
    return df.where(F.col("text").rlike(gaps) & (places == wanted)).withColumn(note, _mapping(plain))


def _mapping(plain: str) -> Column:
    pairs = [F.concat(F.lit(f"{c}="), F.substring("letters", plain.index(c) + 1, 1)) for c in dict.fromkeys(plain)]
    return reduce(lambda a, b: F.concat_ws(" ", a, b), pairs)


def near_order(df: DataFrame, near: DataFrame) -> DataFrame:
    """Matches ordered by the best rank of a word of theirs; those without any last. near: (entry, rank)."""
    each = df.select("text", F.explode(F.split("text", " ")).alias("entry"))
    best = each.join(near, "entry").groupBy("text").agg(F.min("rank").alias("near_rank"))
    return df.join(best, "text", "left").orderBy(F.col("near_rank").asc_nulls_last(), F.desc("score"), "text")

