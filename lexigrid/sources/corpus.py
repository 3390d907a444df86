"""The phrase table: how often each word n-gram of a corpus occurs.

Columns: text, n_words, letters (text without spaces), n_letters, sort_key (the sorted letters), rev (letters backwards),
score (the count). Counting is two aggregations with map-side sums, of the longest n-grams and of those that they begin
with; an n-gram's key is spread evenly but for the most frequent words, of which each task sends one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrid.functions.text import MOST_CHARS, letters, normal, sort_key, words

MAX_WORDS = 3
#: Articles' titles count so many times.
TITLE_WEIGHT = 10


def lines(texts: DataFrame, column: str = "text", weight: Column | int = 1) -> DataFrame:
    """(line, weight) of each line of a text column; n-grams never cross lines."""
    return texts.select(F.explode(F.split(column, "\n")).alias("line"), F.lit(weight).cast("long").alias("weight"))


def titled_lines(texts: DataFrame, column: str = "text", weight: int = TITLE_WEIGHT) -> DataFrame:
    """As lines, but the first line of each text is a title that counts weight times."""
    each = texts.select(F.posexplode(F.split(column, "\n")).alias("at", "line"))
    return each.select("line", F.when(F.col("at") == 0, weight).otherwise(1).cast("long").alias("weight"))


def counted(line_weights: DataFrame, max_words: int = MAX_WORDS, min_count: int = 1) -> DataFrame:
    """(text, score): the n-grams of up to max_words words and 39 characters that occur at least min_count times."""
    spark = line_weights.sparkSession
    if not line_weights.isStreaming and line_weights.rdd.getNumPartitions() < spark.sparkContext.defaultParallelism:
        # A file of few row groups: its lines are dealt to all cores before each becomes many n-grams.
        line_weights = line_weights.repartition(spark.sparkContext.defaultParallelism)
    segments = line_weights.select(F.explode(F.split(normal(F.col("line")), "\n")).alias("segment"), "weight")
    rows = segments.select(words(F.col("segment")).alias("w"), "weight").where(F.size("w") > 0)
    # Each place counts as its longest n-gram, and what that begins with is counted from the sums: fewer rows are dealt out.
    each = rows.select(F.explode(F.expr("sequence(0, size(w) - 1)")).alias("i"), "w", "weight")
    longest = F.col("w")[F.col("i")]
    grams = [longest]
    for n in range(2, max_words + 1):
        grams.append(F.concat_ws(" ", *(F.col("w")[F.col("i") + k] for k in range(n))))
    fits = [F.when((F.col("i") + n <= F.size("w")) & (F.length(g) <= MOST_CHARS), g) for n, g in enumerate(grams, 1)]
    found = each.select(F.coalesce(*reversed(fits)).alias("text"), "weight", fits[-1].isNotNull().alias("full"))
    # That a text has all max_words words is an aggregate, as a filter on it stays above the exchange, which both sides then share.
    table = found.groupBy("text").agg(F.sum("weight").alias("score"), F.max("full").alias("full"))
    if max_words > 1:
        begun = F.expr(f"array_distinct(transform(sequence(1, if(full, {max_words - 1}, {max_words})), n -> substring_index(text, ' ', n)))")
        shorter = table.select(F.explode(begun).alias("text"), "score").groupBy("text").agg(F.sum("score").alias("score"))
        table = table.where("full").select("text", "score").union(shorter)
    table = table.select("text", "score")
    return table.where(F.col("score") >= min_count) if min_count > 1 else table


def described(counts: DataFrame) -> DataFrame:
    """A phrase table from (text, score), or (text, score, rev)."""
    df = counts.select(
        *(c for c in ("text", "rev") if c in counts.columns),
        (F.length("text") - F.length(letters(F.col("text"))) + 1).alias("n_words"),
        letters(F.col("text")).alias("letters"),
        F.col("score").cast("long").alias("score"),
    )
    back = F.col("rev") if "rev" in counts.columns else F.reverse("letters")
    every = df.withColumns({"n_letters": F.length("letters"), "sort_key": sort_key(F.col("letters")), "rev": back})
    return every.select("text", "n_words", "letters", "score", "n_letters", "sort_key", "rev")


def phrase_table(texts: DataFrame, column: str = "text", max_words: int = MAX_WORDS, min_count: int = 1) -> DataFrame:
    return described(counted(lines(texts, column), max_words, min_count))


def total(table: DataFrame) -> DataFrame:
    """(total): the occurrences of all single words."""
    return table.where("n_words = 1").agg(F.coalesce(F.sum("score"), F.lit(0)).cast("long").alias("total"))


def merge(tables: list[DataFrame], min_count: int = 1) -> DataFrame:
    """(text, score) of several counted tables: sums, and those of at least min_count."""
    both = tables[0].select("text", "score")
    for t in tables[1:]:
        both = both.unionByName(t.select("text", "score"))
    return both.groupBy("text").agg(F.sum("score").alias("score")).where(F.col("score") >= min_count)


def from_wordlists(unigrams: DataFrame, bigrams: DataFrame) -> DataFrame:
    """(text, score) from counted words and counted pairs (text, score): a word counts what its list says, or what its
    pairs that begin with it sum to, if that is more. Pairs without a space are left out."""
    pairs = bigrams.where(F.col("text").contains(" "))
    begun = pairs.groupBy(F.substring_index("text", " ", 1).alias("text")).agg(F.sum("score").alias("pairs"))
    single = unigrams.join(begun, "text", "full").select("text", F.greatest(F.coalesce("score", F.lit(0)), F.coalesce("pairs", F.lit(0))).alias("score"))
    return single.union(pairs.select("text", "score"))


def head(table: DataFrame, size: int = 500_000) -> DataFrame:
    """The most frequent phrases: a first page's table."""
    return table.orderBy(F.desc("score"), "text").limit(size)


def dump(table: DataFrame) -> DataFrame:
    """The listing of a table in the order of its texts: the count in five places and the text in brackets."""
    return table.orderBy("text").select(F.format_string("%5d [%s ]", "score", "text").alias("line"))


def stats(table: DataFrame) -> DataFrame:
    """What a table holds: by number of words the phrases, their occurrences, the most frequent's, and the longest's length."""
    return table.groupBy("n_words").agg(
        F.count("*").alias("phrases"), F.sum("score").alias("occurrences"), F.max("score").alias("most"), F.max(F.length("text")).alias("longest")
    )


def save(table: DataFrame, path: str) -> None:
    """Writes a table's texts and scores sorted by text, so that literal prefixes prune row groups; the other columns follow
    from the text, and ``load`` gives them."""
    _put(table.select("text", "score").sort("text"), path)


def _put(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("compression", "zstd").parquet(path)


def store(table: DataFrame, path: str, head_size: int = 500_000) -> None:
    """Writes a table three ways: sorted by text, sorted by its letters backwards (for patterns that fix their end), and its
    most frequent phrases (for first pages). The first is what the others are made from."""
    save(table, f"{path}/text")
    kept = load(table.sparkSession, f"{path}/text")
    _put(kept.select("text", "score", "rev").sort("rev"), f"{path}/rev")
    _put(head(kept, head_size).select("text", "score"), f"{path}/head")


def load(spark: SparkSession, path: str) -> DataFrame:
    """A table that was written; letters backwards are read where they were, as they are what its rows are sorted by."""
    return described(spark.read.parquet(path))
