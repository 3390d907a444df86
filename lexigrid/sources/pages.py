"""Text and lists from web pages and wiki markup, in built-in string functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrid.functions.text import entry

#: Steps from HTML to text, in order: pattern and replacement.
HTML_STEPS = (
    (r"(?is)<(script|style|head)\b.*?</(script|style|head)>", " "),
    (r"(?s)<!--.*?-->", " "),
    (r"(?i)</?(p|div|li|ul|ol|tr|td|th|table|h[1-6]|br|nav|article|section|header|footer)\b[^>]*>", "\n"),
    (r"<[^>]*>", ""),
    (r"(?i)&nbsp;", " "),
    (r"(?i)&lt;", "<"),
    (r"(?i)&gt;", ">"),
    (r"(?i)&quot;", '"'),
    (r"(?i)&amp;", "&"),
    (r"[ \t]+", " "),
    (r" ?\n[ \n]*", "\n"),
)
#: Steps from wiki markup to text.
WIKI_STEPS = (
    (r"(?s)<!--.*?-->", ""),
    (r"(?is)<ref[^>/]*/>|<ref\b.*?</ref>", ""),
    (r"\{\{[^{}]*\}\}", ""),
    (r"(?s)\{\|.*?\|\}", ""),
    (r"(?i)\[\[(file|image|category):[^\[\]]*\]\]", ""),
    (r"\[\[[^\[\]|]*\|([^\[\]]*)\]\]", "$1"),
    (r"\[\[([^\[\]]*)\]\]", "$1"),
    (r"\[https?://[^ \]]*\s*([^\]]*)\]", "$1"),
    (r"'{2,}", ""),
    (r"(?m)^=+\s*(.*?)\s*=+\s*$", "$1"),
    (r"(?m)^[*#:;]+\s*", ""),
    (r"<[^>]*>", ""),
)
#: Sections that end a page's lists, as their entries are about it: fixed values.
END_SECTIONS = ("see also", "references", "external links", "notes", "further reading", "bibliography", "sources", "footnotes", "citations", "external media")
#: From such a section's heading on.
ENDING = rf"(?is)<h[1-6][^>]*>\s*(?:<[^>]*>\s*)*(?:{'|'.join(END_SECTIONS)})\s*<.*"
#: A harvested entry: a first link in a list item or a table's row.
ITEM = r"(?i)<(?:li|tr)[^>]*>\s*(?:<t[dh][^>]*>\s*)?<a [^>]*>([^<]*)</a>"
MOST_CHARS, MOST_WORDS = 25, 3


def _apply(text: Column, steps: tuple[tuple[str, str], ...]) -> Column:
    return F.trim(reduce(lambda t, s: F.regexp_replace(t, s[0], s[1]), steps, text))


def html_text(html: Column) -> Column:
    return _apply(html, HTML_STEPS)


def wiki_text(markup: Column) -> Column:
    return _apply(markup, WIKI_STEPS)


def read_dump(spark: SparkSession, path: str) -> DataFrame:
    """(title, ns, text) of the articles of a wiki's XML dump, redirects left out: Spark's reader deals pages to tasks."""
    schema = "title string, ns int, redirect struct<_title: string>, revision struct<text: struct<_VALUE: string, `_xml:space`: string>>"
    pages = spark.read.format("xml").option("rowTag", "page").schema(schema).load(path)
    return pages.where("ns = 0 and redirect is null").select("title", "ns", F.coalesce("revision.text._VALUE", F.lit("")).alias("text"))


def harvested(pages: DataFrame, table: DataFrame | None = None) -> DataFrame:
    """(entry, pages, score): first links of list items above the sections that end a page, in short normal form, how many
    pages have each, and its count in a phrase table."""
    body = F.regexp_replace("html", ENDING, "")
    found = pages.select("page_id", F.explode(F.regexp_extract_all(body, F.lit(ITEM), F.lit(1))).alias("raw"))
    short = found.select("page_id", entry(F.col("raw")).alias("entry")).where(
        (F.col("entry") != "") & (F.length("entry") <= MOST_CHARS) & (F.size(F.split("entry", " ")) <= MOST_WORDS)
    )
    counts = short.distinct().groupBy("entry").agg(F.count("*").alias("pages"))
    if table is None:
        return counts.withColumn("score", F.lit(0).cast("long"))
    return counts.join(table.select(F.col("text").alias("entry"), "score"), "entry", "left").select("entry", "pages", F.coalesce("score", F.lit(0)).alias("score"))
