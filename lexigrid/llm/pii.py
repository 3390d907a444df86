"""PII: fixed patterns, and information-theoretic sanitisation of the terms that reveal them. Native expressions only.

The spans of the fixed patterns name protected entities. Over the whole corpus, with n(e) the rows that hold entity e,
df(t) those that hold term t, n(t, e) those that hold both and N all rows, the information content of an entity is
IC(e) = log2(N / n(e)), and a term reveals PMI(t; e) = log2(N * n(t, e) / (df(t) * n(e))) of it. A term that stands with e
in at least min_support different texts, and of which PMI(t; e) >= threshold * IC(e), discloses e: wherever it stands in a
text that holds e its spans are added as kind ``term``, and ``sanitise`` generalises entities to their kind and removes
such terms. Below min_support texts there is no estimate: an entity that fewer texts hold has no disclosing terms.

Defined results: null text counts as empty; a text without personal data has zero counts, an empty spans string and the
hash of the empty string; repeated rows get equal results, and equal texts count once as support; terms at the threshold
disclose; spans that would overlap a pattern's are left out; very long texts are searched whole, positions in about
n ** 1.5 steps for n matches; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigrid.llm.common import staged
from lexigrid.llm.spans import apart, matches, none, texts

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "[A-Za-z0-9._%+-]"
EMAIL = rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
#: Runs of 16 digits or more, from where the base pattern's run would begin: shorter ones are no cards.
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?+[0-9]){15,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
TERM = r"\p{L}{3,}+"


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]+", "")


def luhn(digits: Column) -> Column:
    """Whether a text of digits passes the check that cards carry."""
    values = F.transform(F.split(F.reverse(digits), ""), lambda c, i: (c.cast("int") * (1 + i % 2)))
    return F.aggregate(values, F.lit(0), lambda s, x: s + x - F.when(x > 9, 9).otherwise(0)) % 10 == 0


def base_spans(text: Column) -> dict[str, Column]:
    """Spans by kind, each in the order of the text. Cheap tests keep the matcher from texts without any."""
    # A part with over three digits beside leading zeros is over 255; of the others, the last three digits decide.
    over = lambda o: (F.length(F.ltrim(o, F.lit("0"))) > 3) | (F.substring(F.concat(F.lit("000"), o), -3, 3).cast("int") > 255)
    octets = lambda s: ~F.exists(F.split(s["val"], r"\."), over)
    card = F.filter(matches(text, CARD), lambda s: F.when(F.length(_digits(s["val"])).between(16, 19), luhn(_digits(s["val"]))).otherwise(False))
    phone = F.filter(matches(text, PHONE), lambda s: F.length(_digits(s["val"])).between(8, 15))
    return {
        "email": F.when(text.contains("@"), matches(text, EMAIL)).otherwise(none()),
        "ip": F.when(text.rlike(r"[0-9]\.[0-9]"), F.filter(matches(text, IP), octets)).otherwise(none()),
        "card": F.when(text.rlike(r"[0-9](?:[\x20-]?[0-9]){15}"), card).otherwise(none()),
        "phone": F.when(text.contains("+"), phone).otherwise(none()),
    }


def _terms(text: Column) -> Column:
    """The distinct terms of a text, in lower case."""
    words = F.filter(F.split(text, r"[^\p{L}]+"), lambda w: F.length(w) >= 3)
    return F.array_distinct(F.transform(words, F.lower))


def disclosing(held: DataFrame, docs: DataFrame, threshold: float, min_support: int) -> DataFrame:
    """(key, term) of each row of held (key, entity, text) and each term there that reveals its entity."""
    rows = held.select("key", "entity", F.xxhash64("text").alias("of"), "text")
    by_text = rows.groupBy("entity", "of").agg(F.count("*").alias("c"))
    entities = by_text.groupBy("entity").agg(F.sum("c").alias("n_e"), F.count("*").alias("texts")).where(F.col("texts") >= min_support)
    entities = staged(entities.select("entity", "n_e"), "entities")
    # Only rows of entities with support give terms.
    each = rows.join(entities, "entity").select("key", "entity", "of", "n_e", F.explode(_terms(F.col("text"))).alias("term"))
    joint = each.groupBy("entity", "n_e", "term", "of").agg(F.count("*").alias("c")).groupBy("entity", "n_e", "term")
    joint = staged(joint.agg(F.sum("c").alias("n_te"), F.count("*").alias("texts")).where(F.col("texts") >= min_support), "joint")
    # Staged, so that its size is known: where it can be broadcast, Catalyst moves the semi join below the counts, and else
    # each task sends a term once.
    wanted = staged(joint.select("term").distinct(), "terms")
    words = docs.select(F.explode(_terms(F.coalesce("text", F.lit("")))).alias("term"))
    df_t = words.groupBy("term").agg(F.count("*").alias("df")).join(wanted, "term", "left_semi")
    n = F.lit(float(docs.count()))
    pmi = F.log2(n * F.col("n_te") / (F.col("df") * F.col("n_e")))
    scored = joint.join(df_t, "term").where((F.col("n_e") < n) & (pmi >= threshold * F.log2(n / F.col("n_e"))))
    pairs = staged(scored.select("entity", "term"), "disclosing")
    return each.join(pairs, ["entity", "term"], "left_semi").select("key", "term").distinct()


def pii_spans(docs: DataFrame, threshold: float = 0.9, min_support: int = 3) -> DataFrame:
    """(doc_id, email, ip, card, phone, term): spans by kind of each row."""
    df = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    df = df.select("doc_id", "text", *(c.alias(k) for k, c in base_spans(F.col("text")).items()))
    entity = lambda kind: lambda s: F.concat_ws(":", F.lit(kind), F.lower(s["val"]))
    df = df.withColumn("entities", F.array_distinct(F.concat(*(F.transform(k, entity(k)) for k in KINDS))))
    some = F.size("entities") > 0
    row = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), F.lit(":"), F.col("text"))
    df = df.select("doc_id", *KINDS, "entities", F.when(some, F.md5(row)).alias("key"), F.when(some, F.col("text")).alias("text"))
    df = staged(df, "pii")
    holders = df.where("key is not null")
    held = holders.select("key", F.explode("entities").alias("entity"), "text")
    added = disclosing(held, docs, threshold, min_support).groupBy("key").agg(F.collect_set("term").alias("terms"))  # one text's terms
    spans = F.filter(matches(F.col("text"), TERM), lambda s: F.array_contains("terms", F.lower(s["val"])))
    marked = holders.join(added, "key", "left").withColumn("term", F.when(F.col("terms").isNotNull(), apart(spans, F.concat(*KINDS))).otherwise(none()))
    clean = df.where("key is null").select("doc_id", *KINDS, none().alias("term"))
    return marked.select("doc_id", *KINDS, "term").union(clean)


def _label(to: str) -> Callable[[Column], Column]:
    return lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(to).alias("to"))


def sanitise(text: Column, spans: dict[str, Column]) -> Column:
    """The text with entities generalised to their kind and disclosing terms removed."""
    marked = F.array_sort(F.concat(*(F.transform(c, _label("" if k == "term" else f"[{k.upper()}]")) for k, c in spans.items())))
    zero = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def step(a: Column, s: Column) -> Column:
        gap = F.substr(text, (a["at"] + 1).cast("int"), F.greatest(F.lit(0), s["start"] - a["at"]).cast("int"))
        inside = s["end"] <= a["at"]  # a span within one already replaced
        return F.when(inside, a).otherwise(F.struct(F.concat(a["out"], gap, s["to"]).alias("out"), s["end"].alias("at")))

    return F.aggregate(marked, zero, step, lambda a: F.concat(a["out"], F.substr(text, (a["at"] + 1).cast("int"), F.length(text))))


def _joined(kinds: tuple[str, ...]) -> Column:
    """kind:start:end of all spans by kind as listed, then start."""
    return F.array_join(F.concat(*(texts(F.col(k), k) for k in kinds)), ",")


def op5_pii(spark, sf_dir: str) -> DataFrame:
    df = pii_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return df.select("doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS), F.sha2(_joined(KINDS), 256).alias("base_sha256"), _joined((*KINDS, "term")).alias("spans"))
