"""Quality rules: a short-circuit cascade in native expressions.

Each rule is a condition under which a text is rejected. A sample tells the cost of each rule (its features' work by
character and by word, times the sample's mean characters and words) and which rules reject each text; the cascade asks
first the rule with the most rejection per cost, then that with the most among the texts the first leaves, and so on,
and stops at the first that rejects. The order changes what is computed, never the verdict.

Defined results: null text counts as empty, and so has no word and is rejected; repeated rows are judged alike, and rules
that tie are asked in the order in which they are given; a very long text is judged whole; an empty table gives an empty
result; columns of other names pass through ``quality_filter`` untouched.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigrid.llm.common import words_of
from lexigrid.llm.spans import let

#: Bits of a sort key that hold a window's place in its text.
PLACE = 28

Feature = Callable[[str], Column]


@dataclass(frozen=True)
class Rule:
    """rejects: the condition under which a text is rejected, given a function from a feature's name to its column.

    by_char, by_word: nanoseconds of its features, as timed once on prose of 50 to 5,000 words; they decide order alone.
    """

    name: str
    rejects: Callable[[Feature], Column]
    by_char: float = 0.0
    by_word: float = 0.0


RULES = (
    Rule("few_words", lambda f: f("n_words") < 50),
    Rule("repeated_words", lambda f: 100 * f("n_repeat_words") > 50 * f("n_words"), 0, 550),
    Rule("symbols", lambda f: 10 * f("n_symbols") > f("n_words"), 5, 0),
    Rule("shouting", lambda f: 2 * f("n_upper") > f("word_chars"), 15, 90),
    Rule("repeated_lines", lambda f: 2 * f("n_dup_lines") > f("n_lines"), 15, 0),
    Rule("word_length", lambda f: ~f("word_chars").between(2 * f("n_words"), 20 * f("n_words")), 0, 90),
    Rule("few_letters", lambda f: 10 * f("n_letters") < 6 * f("word_chars"), 15, 90),
)
#: The two rules of which base_failed consists.
BASE = ("few_words", "repeated_words")


def repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more in the text.

    Each window's hash, cut to its upper bits and joined with its place, is sorted as a plain long: equal windows are then
    neighbours. Where neighbours agree in the upper bits and differ in the full hash, or places have too many bits, pairs
    of full hash and place are sorted instead. The union of windows of width 3 is a sum over the gaps of places.
    """
    mask, zero = (1 << PLACE) - 1, F.lit(0).cast("long")
    count = F.greatest(F.size(words) - 2, F.lit(0))
    hashes = F.transform(F.arrays_zip(*(F.slice(words, k, count) for k in (1, 2, 3))), lambda x: F.xxhash64(x))
    key = lambda x, i: x.bitwiseAND(F.lit(~mask)).bitwiseOR(i.cast("long"))
    place = lambda x: x.bitwiseAND(F.lit(mask))
    sure = lambda c: F.coalesce(c, F.lit(False))

    def of_places(p: Column) -> Column:
        gaps = F.zip_with(F.slice(p, 2, F.size(p) - 1), F.slice(p, 1, F.size(p) - 1), lambda b, a: F.least(F.lit(3).cast("long"), b - a))
        return F.when(F.size(p) < 1, zero).otherwise(F.aggregate(gaps, F.lit(3).cast("long"), lambda s, x: s + x))

    def twice(k: Column, same: Callable[[Column, Column], Column]) -> Column:
        return F.filter(k, lambda x, i: sure(same(x, F.get(k, i - 1))) | sure(same(x, F.get(k, i + 1))))

    def exact(h: Column) -> Column:
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.cast("long").alias("at"))))
        same = lambda x, other: x["h"] == other["h"]
        return let(pairs, lambda k: let(F.sort_array(F.transform(twice(k, same), lambda x: x["at"])), of_places))

    def of_keys(h: Column) -> Callable[[Column], Column]:
        def body(k: Column) -> Column:
            full = lambda x: F.get(h, place(x).cast("int"))
            upper = lambda x, other: F.shiftright(x, PLACE) == F.shiftright(other, PLACE)
            mixed = F.exists(F.sequence(F.lit(1), F.size(k) - 1), lambda i: upper(F.get(k, i), F.get(k, i - 1)) & (full(F.get(k, i)) != full(F.get(k, i - 1))))
            return F.when(mixed, exact(h)).otherwise(let(F.sort_array(F.transform(twice(k, upper), place)), of_places))

        return body

    some = lambda h: (
        F.when(F.size(F.array_distinct(h)) == F.size(h), zero)
        .when(F.size(h) > mask, exact(h))
        .otherwise(let(F.sort_array(F.transform(h, key)), of_keys(h)))
    )
    return F.when(F.size(words) < 4, zero).otherwise(let(hashes, some))


def _left(text: Column, pattern: str) -> Column:
    """Characters of the text that remain when the runs of pattern go."""
    return F.length(F.regexp_replace(text, pattern, "")).cast("long")


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


#: Features of a text and its words.
FEATURES = {
    "n_words": lambda text, words: F.size(words).cast("long"),
    "word_chars": lambda text, words: F.length(F.array_join(words, "")).cast("long"),
    "n_symbols": lambda text, words: _left(text, r"[^#*$%&|<>]+"),
    "n_upper": lambda text, words: _left(text, r"[^\p{Lu}]+"),
    "n_letters": lambda text, words: _left(text, r"[^\p{L}]+"),
    "n_lines": lambda text, words: F.size(_lines(text)).cast("long"),
    "n_dup_lines": lambda text, words: (F.size(_lines(text)) - F.size(F.array_distinct(_lines(text)))).cast("long"),
    "n_repeat_words": lambda text, words: repeat_words(words),
}


def rejected_by(order: list[Rule], feature: Feature) -> Column:
    """The first rule that rejects, or null. A later rule's features are computed only if all before it let the text pass."""
    found = F.lit(None).cast("string")
    for rule in reversed(order):
        found = F.when(rule.rejects(feature), F.lit(rule.name)).otherwise(found)
    return found


def verdict(text: Column, order: list[Rule]) -> Column:
    """rejected_by over a text alone."""
    text = F.coalesce(text, F.lit(""))
    return let(words_of(text), lambda words: rejected_by(order, lambda name: FEATURES[name](text, words)))


def plan_order(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = 400) -> list[Rule]:
    """The rules in the order in which to ask them, from at most sample_rows rows (the bound).

    The sample decides only in which order the rules are asked; no row's verdict depends on it.
    """
    share = min(1.0, max(0.01, 2 * sample_rows / max(docs.count(), 1)))
    text = F.coalesce("text", F.lit(""))
    asked = let(words_of(text), lambda words: F.array(
        F.length(text), F.size(words), *(rule.rejects(lambda name: FEATURES[name](text, words)).cast("int") for rule in rules)
    ))
    drawn = docs.select("text").where(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < share * 1_000_000)
    rows = [r[0] for r in drawn.select(asked).take(sample_rows)]
    chars, words = (sum(r[k] for r in rows) / max(1, len(rows)) for k in (0, 1))
    left, order = list(range(len(rules))), []
    while left:
        worth = lambda k: sum(r[2 + k] or 0 for r in rows) / (100 + rules[k].by_char * chars + rules[k].by_word * words)
        best = max(left, key=lambda k: (worth(k), -k))
        left.remove(best)
        order.append(rules[best])
        rows = [r for r in rows if not r[2 + best]]
    return order


def quality_filter(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Rows of docs that no rule rejects."""
    return docs.where(verdict(F.col("text"), plan_order(docs, rules)).isNull())


def op3_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    df = docs.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("_w", words_of(F.col("text")))
    wanted = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")  # the contract has these of every row
    df = df.withColumns({name: FEATURES[name](F.col("text"), F.col("_w")) for name in wanted})
    feature = lambda name: F.col(name) if name in wanted else FEATURES[name](F.col("text"), F.col("_w"))
    base = rejected_by([r for r in RULES if r.name in BASE], feature).isNotNull()
    kept = rejected_by(plan_order(docs), feature).isNull()
    return df.select("doc_id", *wanted, base.alias("base_failed"), (~base & kept).alias("kept"))


OP3_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS r FROM documents),
s AS (SELECT r, doc_id, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT r, i, count(*) OVER (PARTITION BY r, w[i], w[i + 1], w[i + 2]) AS c
      FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM s)),
rep AS (SELECT r, count(DISTINCT i + k) AS n FROM g, range(0, 3) t(k) WHERE c > 1 GROUP BY r),
f AS (SELECT s.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
        CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
        length(regexp_replace(text, '[^\p{Lu}]+', '', 'g')) AS n_upper, length(regexp_replace(text, '[^\p{L}]+', '', 'g')) AS n_letters
      FROM s LEFT JOIN rep ON s.r = rep.r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 10 * n_symbols > n_words OR 2 * n_upper > word_chars
       OR 2 * n_dup_lines > n_lines OR word_chars NOT BETWEEN 2 * n_words AND 20 * n_words OR 10 * n_letters < 6 * word_chars) AS kept
FROM f
"""
