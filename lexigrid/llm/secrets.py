"""Secret scans: fixed patterns, and a randomness test battery for tokens no pattern knows. Native expressions only.

A candidate is a run of 20 or more token characters. Its encoding is inferred from its characters; under the hypothesis
that the token is random in that encoding, five p-values are taken: chi-squared uniformity over the alphabet, over its cells
(vowels, common and rare consonants, digits, marks) and of vowels against all else, runs of kinds of characters, and
serial correlation of neighbours. Their combination after Fisher, here as their geometric mean, is the token's
randomness: 0.2 to 0.7 for most random tokens, and next to 0 for most that people make. A token under PLAUSIBLE is
rejected as random and no secret.

What is reported is bounded, by encoding and class of length (longer tokens have more power, so they share no threshold
with short ones), over distinct tokens, at a rate of false reports, in two ways of which the stricter decides:

* The null hypothesis is that people made the token. Its p-value is the share of made tokens that look as random, made
  tokens coming from a fixed model (``made_tokens``: words joined in the usual styles, with numbers; repeated blocks;
  counters and dates). The Benjamini-Hochberg step-up tells which tokens are secrets.
* How random truly random tokens look is known (``drawn_tokens``). From each threshold on, the number of tokens found over
  the share of random tokens found bounds the number of random tokens, give or take two standard errors; the least bound,
  times the share of random tokens from the line on, leaves the number of reported tokens that aren't random. This holds
  whatever words people use, and matters as classes grow.

Both work on histograms, which have a bounded number of cells whatever the corpus. Short tokens, of 20 to 31 characters,
look alike often enough that among many made ones few random ones are reported.

Defined results: null text counts as empty; a text without secrets has zero counts, an empty spans string and the hash of
the empty string; repeated rows get equal results, and a token that repeats counts once in the step-up; tokens that tie
share their verdict; very long texts are searched whole, positions in about n ** 1.5 steps for n matches; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexigrid.llm.common import staged
from lexigrid.llm.spans import apart, matches, none

KINDS = ("assign", "access", "hex")
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]++"""
VALUE = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
ACCESS, HEX = r"AKIA[A-Z0-9]{16,}", r"[0-9a-f]{24,}"
TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+={0,2}"
UUID = r"^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$"
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Encodings in the order in which they are tried: name, pattern, alphabet in order. The last fits every candidate.
ENCODINGS = (
    ("decimal", r"^[0-9]+$", DIGITS),
    ("hex", r"^[0-9a-f]+$", DIGITS + "abcdef"),
    ("hexu", r"^[0-9A-F]+$", DIGITS + "ABCDEF"),
    ("lower", r"^[a-z]+$", LOWER),
    ("upper", r"^[A-Z]+$", UPPER),
    ("base32", r"^[A-Z2-7]+$", UPPER + "234567"),
    ("lower36", r"^[a-z0-9]+$", LOWER + DIGITS),
    ("upper36", r"^[A-Z0-9]+$", UPPER + DIGITS),
    ("slug", r"^[a-z0-9_-]+$", LOWER + DIGITS + "_-"),
    ("slugu", r"^[A-Z0-9_-]+$", UPPER + DIGITS + "_-"),
    ("base62", r"^[A-Za-z0-9]+$", UPPER + LOWER + DIGITS),
    ("base64", r"^[A-Za-z0-9+/]+$", UPPER + LOWER + DIGITS + "+/"),
    ("base64url", r"^[A-Za-z0-9_-]+$", UPPER + LOWER + DIGITS + "-_"),
    ("any", "", UPPER + LOWER + DIGITS + "+/_-"),
)
#: Cells of characters for the second chi-squared test, and the kind of each for the runs test.
VOWELS, COMMON, RARE, MARKS = "aeiou", "nrstldcm", "bfghjkpqvwxyz", "+/_-"
GROUPS = ((VOWELS, "v"), (COMMON, "c"), (RARE, "c"), (VOWELS.upper(), "v"), (COMMON.upper(), "C"), (RARE.upper(), "C"), ("01234", "d"), ("56789", "d"), (MARKS, "m"))
#: Least length of each class, after the first; cells of randomness; tokens made, and drawn at random, for comparison.
#: Randomness that about 99 of 100 random tokens reach.
PLAUSIBLE = 0.06
LENGTHS, CELLS, MADE, DRAWN = (24, 32, 48, 64), 250, 60_000, 30_000
#: Words of the model of tokens that people make.
WORDS = (
    "user name account order total value index count list item page view model data base table column field type code text "
    "string number date time start end first last next open close read write file path folder image video sound color size "
    "width height length weight price cost amount balance payment invoice customer product service request response server "
    "client network address street city country region language message subject content header footer title summary detail "
    "report result status state version build release update create delete remove insert select search filter group member "
    "person profile setting option default custom public private static final test sample example template project package "
    "module library function method object class parent child node tree branch leaf market sales stock energy water house "
    "school health travel music sport haus strasse zeitung arbeit leben monde temps maison ville tiempo mundo trabajo vida"
).split()


def base_spans(text: Column) -> dict[str, Column]:
    """Spans by kind, each in the order of the text. Cheap tests keep the matcher from texts without any."""
    assign = F.filter(matches(text, ASSIGN), lambda s: F.length(F.regexp_replace(s["val"], VALUE, "")) >= 6)
    return {
        "assign": F.when(text.rlike("(?i:passw|secret|token|api_?key)"), assign).otherwise(none()),
        "access": F.when(text.contains("AKIA"), matches(text, ACCESS)).otherwise(none()),
        "hex": F.when(text.rlike(HEX), matches(text, HEX)).otherwise(none()),
    }


def upper_tail(z: Column) -> Column:
    """1 - Phi(z), by a logistic approximation good to 2e-4."""
    z = F.least(F.greatest(z, F.lit(-12.0)), F.lit(12.0))
    return 1 / (1 + F.exp(1.5976 * z + 0.07056 * z * z * z))


def _by_encoding(value: Callable[[str], float]) -> Column:
    """A number of the encoding's alphabet, by the column enc."""
    return F.element_at(F.create_map(*(F.lit(x) for name, _, letters in ENCODINGS for x in (name, float(value(letters))))), F.col("enc"))


def _share(letters: str, of: str) -> float:
    return sum(c in of for c in letters) / len(letters)


def _kinds(letters: str) -> list[float]:
    return [sum(_share(letters, g) for g, kind in GROUPS if kind == k) for k in "vcCdm"]


def battery(df: DataFrame) -> DataFrame:
    """Adds enc, length_class and randomness to rows with val."""
    body = F.regexp_replace("val", "=+$", "")
    body = F.when(body.rlike(UUID), F.lower(F.replace(body, F.lit("-"), F.lit("")))).otherwise(body)
    enc, alphabet = F.lit(ENCODINGS[-1][0]), F.lit(ENCODINGS[-1][2])
    for name, pattern, letters in reversed(ENCODINGS[:-1]):
        enc = F.when(F.col("body").rlike(pattern), F.lit(name)).otherwise(enc)
    for name, _, letters in ENCODINGS[:-1]:
        alphabet = F.when(F.col("enc") == name, F.lit(letters)).otherwise(alphabet)
    df = df.withColumn("body", body).withColumn("enc", enc).withColumn("alphabet", alphabet)
    df = df.withColumn("n", F.length("body").cast("double")).withColumn("k", F.length("alphabet").cast("double"))

    def chi_tail(chi2: Column, dof: Column) -> Column:
        spread = F.lit(2.0) / (9 * dof)
        return upper_tail((F.pow(F.greatest(chi2, F.lit(0.0)) / dof, F.lit(1 / 3)) - (1 - spread)) / F.sqrt(spread))

    squares = F.expr("aggregate(array_distinct(split(body, '')), 0D, (s, c) -> s + pow(length(body) - length(replace(body, c, '')), 2))")
    letters = chi_tail(squares * F.col("k") / F.col("n") - F.col("n"), F.col("k") - 1)
    pooled = F.lit(0.0)
    for group, _ in GROUPS:
        expected = F.col("n") * _by_encoding(lambda a, g=group: _share(a, g))
        found = F.length("body") - F.length(F.translate("body", group, ""))
        pooled = pooled + F.when(expected > 0, F.pow(found - expected, F.lit(2.0)) / F.greatest(expected, F.lit(1e-9))).otherwise(0.0)
    cells = chi_tail(pooled, _by_encoding(lambda a: max(1, sum(_share(a, g) > 0 for g, _ in GROUPS) - 1)))
    every = VOWELS + VOWELS.upper()
    share = _by_encoding(lambda a: _share(a, every))
    found = F.length("body") - F.length(F.translate("body", every, ""))
    vowels = F.when(share > 0, chi_tail(F.pow(found - F.col("n") * share, F.lit(2.0)) / F.greatest(F.col("n") * share * (1 - share), F.lit(1e-9)), F.lit(1.0))).otherwise(1.0)

    kinds = F.translate("body", "".join(g for g, _ in GROUPS), "".join(k * len(g) for g, k in GROUPS))
    changes = F.length(F.regexp_replace(kinds, r"(.)\1*+", "x")) - 1
    p2, p3 = _by_encoding(lambda a: sum(p**2 for p in _kinds(a))), _by_encoding(lambda a: sum(p**3 for p in _kinds(a)))
    var = (F.col("n") - 1) * p2 * (1 - p2) + 2 * (F.col("n") - 2) * (p3 - p2 * p2)
    runs = F.when(var > 1e-9, 2 * upper_tail(F.abs(changes - (F.col("n") - 1) * (1 - p2)) / F.sqrt(F.greatest(var, F.lit(1e-9))))).otherwise(1.0)

    df = df.withColumn("uniform", letters * cells * vowels).withColumn("runs", runs)
    df = df.withColumn("v", F.expr("transform(split(body, ''), c -> cast(locate(c, alphabet) as double))"))
    df = df.withColumn("mean", F.expr("aggregate(v, 0D, (s, x) -> s + x) / n"))
    lagged = F.expr("aggregate(zip_with(slice(v, 1, size(v) - 1), slice(v, 2, size(v) - 1), (a, b) -> (a - mean) * (b - mean)), 0D, (s, x) -> s + x)")
    power = F.expr("aggregate(v, 0D, (s, x) -> s + (x - mean) * (x - mean))")
    serial = F.when(power > 0, 2 * upper_tail(F.abs(lagged / F.greatest(power, F.lit(1e-9)) * F.sqrt("n")))).otherwise(0.0)
    length = sum((F.when(F.col("n") >= x, 1).otherwise(0) for x in LENGTHS), F.lit(0))
    df = df.withColumn("length_class", length).withColumn("randomness", F.least(F.lit(1.0), F.pow(F.col("uniform") * F.col("runs") * serial, F.lit(0.2))))
    return df.drop("body", "alphabet", "n", "k", "uniform", "runs", "v", "mean")


def _size(pick: Callable[[int, int], Column]) -> Column:
    """A length, every class alike."""
    least, size = (20, *LENGTHS, 120), F.lit(0)
    for k in range(len(least) - 1):
        size = F.when(pick(-5, len(least) - 1) == k, least[k] + pick(-6, least[k + 1] - least[k])).otherwise(size)
    return size


def drawn_tokens(spark: SparkSession, count: int = DRAWN) -> DataFrame:
    """(val) of tokens drawn at random, the same at each call: every encoding in every class of length."""
    pick = lambda k, n: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(n)).cast("int")
    alphabet = F.get(F.array(*(F.lit(letters) for _, _, letters in ENCODINGS)), pick(-1, len(ENCODINGS)))
    char = lambda j: F.substr("alphabet", F.pmod(F.xxhash64("id", j), F.length("alphabet")).cast("int") + 1, F.lit(1))
    rows = spark.range(0, count, 1, 8).withColumn("alphabet", alphabet).withColumn("size", _size(pick))
    return rows.select(F.array_join(F.transform(F.sequence(F.lit(1), F.col("size")), char), "").alias("val"))


def made_tokens(spark: SparkSession, count: int = MADE) -> DataFrame:
    """(val) of tokens as people make them, the same at each call: every style in every class of length.

    Styles: words run together, with _ or -, in capitals with _, in camel case, capitals run together, each with a number
    at the end or none; blocks of up to four characters again and again; counters; dates.
    """
    draw = lambda k: F.xxhash64("id", F.lit(k))
    pick = lambda k, n: F.pmod(draw(k), F.lit(n)).cast("int")
    of = F.array(*map(F.lit, WORDS))
    words = F.transform(F.sequence(F.lit(0), F.lit(39)), lambda j: F.get(of, F.pmod(F.xxhash64("id", j), F.lit(len(WORDS))).cast("int")))
    number = F.substring(F.pmod(draw(-1), F.lit(10**6)).cast("string"), 1, 1)
    number = F.when(pick(-2, 5) == 0, "").otherwise(F.substring(F.concat(number, F.pmod(draw(-3), F.lit(10**5)).cast("string")), 1, 9)).cast("string")
    number = F.substr(number, F.lit(1), 1 + pick(-4, 4))
    size = _size(pick)
    joined = lambda mark: F.array_join("words", mark)
    letters = F.lit("abcdef" + DIGITS + "ABCDEF" + LOWER + UPPER)
    block = F.concat(*(F.substr(letters, F.least(pick(-20 - j, 22) + 1, F.lit(22)) if j % 2 else pick(-20 - j, 74) + 1, F.lit(1)) for j in range(4)))
    hexes = F.concat(*(F.substr(F.lit(DIGITS + "abcdef"), pick(-30 - j, 16) + 1, F.lit(1)) for j in range(4)))
    again = lambda b: F.repeat(F.substr(b, F.lit(1), 1 + pick(-7, 4)), F.lit(120))
    date = F.date_format(F.timestamp_seconds(F.pmod(draw(-8), F.lit(1 << 31))), "yyyyMMddHHmmss")
    styles = [
        joined(""), joined("_"), joined("-"), F.upper(joined("_")), F.replace(F.initcap(joined(" ")), F.lit(" "), F.lit("")), F.upper(joined("")),
        joined("/"), again(block), again(hexes), F.upper(again(hexes)), F.lpad(pick(-9, 10**6).cast("string"), 120, "0"), F.repeat(date, 9),
        again(F.translate(hexes, "abcdef", "123456")),
    ]
    val = F.lit("")
    for k, style in enumerate(styles):
        # Words end before the number; the other styles are cut to size.
        cut = F.concat(F.substr(style, F.lit(1), size - F.length("number")), F.col("number")) if k < 7 else F.when(F.lit(k) == 10, F.substr(style, 121 - size, size)).otherwise(F.substr(style, F.lit(1), size))
        val = F.when(pick(-10, len(styles)) == k, cut).otherwise(val)
    rows = spark.range(0, count, 1, 8).withColumn("words", words).withColumn("number", number)
    return rows.select(val.alias("val"))


def secret_lines(counts: DataFrame, rate: float) -> DataFrame:
    """(enc, length_class, line) of classes with secrets: tokens whose cell is line or more are such.

    counts: (enc, length_class, cell, kind, times), kind being found, made or drawn.
    """
    of = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("times")).otherwise(0)).alias(kind)
    cells = counts.groupBy("enc", "length_class", "cell").agg(of("found"), of("made"), of("drawn"))
    by = Window.partitionBy("enc", "length_class")  # at most CELLS rows
    upto = lambda c: F.sum(c).over(by.orderBy(F.desc("cell")))
    cells = cells.select(
        "enc", "length_class", "cell", upto("found").alias("n"), ((1 + upto("made")) / (1 + F.sum("made").over(by))).alias("p"),
        (upto("found") / F.greatest(F.sum("found").over(by), F.lit(1))).alias("share"), (upto("drawn") / F.greatest(F.sum("drawn").over(by), F.lit(1))).alias("random"),
    )
    bound = (F.col("n") + 2 * F.sqrt(F.col("n") + 1)) / F.greatest("random", F.lit(0.1))
    most = F.least(*(F.min_by(bound, F.abs(F.col("random") - at)).over(by) for at in (0.6, 0.4, 0.2)))
    bounded = F.col("n") - F.coalesce(most, F.lit(0)) * F.col("random") <= rate * F.col("n")
    ranked = cells.withColumn("secret", (F.col("p") <= rate * F.col("share")) & bounded & (F.col("cell") >= PLAUSIBLE * CELLS) & (F.col("n") > 0))
    return ranked.where("secret").groupBy("enc", "length_class").agg(F.min("cell").alias("line"))


def random_tokens(vals: DataFrame, rate: float) -> DataFrame:
    """(val) of the distinct tokens vals that are secrets."""
    spark, cell = vals.sparkSession, F.least(F.floor(F.col("randomness") * CELLS), F.lit(CELLS - 1))
    celled = lambda df: battery(df).select("val", "enc", "length_class", cell.alias("cell"))
    tested = staged(celled(vals), "tested")
    counted = [df.groupBy("enc", "length_class", "cell").agg(F.count("*").alias("times")).withColumn("kind", F.lit(kind))
               for kind, df in (("found", tested), ("made", celled(made_tokens(spark))), ("drawn", celled(drawn_tokens(spark))))]
    lines = staged(secret_lines(counted[0].union(counted[1]).union(counted[2]), rate), "lines")  # a row for each encoding and class of length
    return tested.join(F.broadcast(lines), ["enc", "length_class"]).where("cell >= line").select("val")


def secret_spans(docs: DataFrame, rate: float = 0.05) -> DataFrame:
    """(doc_id, assign, access, hex, random): spans by kind of each row; random spans overlap no other."""
    text = F.coalesce(F.col("text"), F.lit(""))
    df = docs.select("doc_id", text.alias("text"))
    df = df.select("doc_id", "text", *(c.alias(k) for k, c in base_spans(F.col("text")).items()))
    tokens = F.when(F.col("text").rlike(TOKEN), apart(matches(F.col("text"), TOKEN), F.concat(*KINDS))).otherwise(none())
    row = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), F.lit(":"), F.col("text"))
    df = df.withColumn("tokens", tokens).select("doc_id", *KINDS, "tokens", F.when(F.size("tokens") > 0, F.md5(row)).alias("key"))
    df = staged(df, "secrets")
    holders, clean = df.where("key is not null"), df.where("key is null")
    # Rows that repeat have one entry here, as they have one result.
    each = holders.select("key", F.explode("tokens").alias("t")).select("key", "t.*").distinct()
    secrets = staged(random_tokens(each.select("val").distinct(), rate), "secret-tokens")
    found = each.join(secrets, "val", "left_semi").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("start", "end", "val"))).alias("random"))  # a text's tokens
    marked = holders.join(found, "key", "left").select("doc_id", *KINDS, F.coalesce("random", none()).alias("random"))
    return marked.union(clean.select("doc_id", *KINDS, none().alias("random")))


def _place(kind: int) -> Callable[[Column], Column]:
    return lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end"))


def _joined(kinds: tuple[str, ...]) -> Column:
    """kind:start:end of all spans by start, then kind as listed."""
    marked = [F.transform(F.col(k), _place(i)) for i, k in enumerate(kinds)]
    names = F.array(*map(F.lit, kinds))
    return F.array_join(F.transform(F.array_sort(F.concat(*marked)), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def redact(text: Column, spans: Column) -> Column:
    """The text with each of the sorted, non-overlapping spans replaced by [SECRET]."""
    zero = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))
    step = lambda a, s: F.struct(F.concat(a["out"], F.substring(text, (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int")), F.lit("[SECRET]")).alias("out"), s["end"].alias("at"))
    return F.aggregate(spans, zero, step, lambda a: F.concat(a["out"], F.substring(text, (a["at"] + 1).cast("int"), F.length(text))))


def op8_secrets(spark, sf_dir: str) -> DataFrame:
    df = secret_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return df.select("doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS), F.sha2(_joined(KINDS), 256).alias("base_sha256"), _joined((*KINDS, "random")).alias("spans"))
