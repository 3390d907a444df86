"""Text to words and letters, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A phrase with its closing space has at most 40 characters; longer tokens are cut in blocks of 40.
MOST_CHARS = 39


def normal(line: Column) -> Column:
    """Lower-case words separated by single spaces; a newline where a token of 40 or more characters was cut.

    Apostrophes vanish, all else that is no ASCII letter or digit separates. Of a long token only the last
    length % 40 characters stay, and nothing before them is adjacent. Letters are lowered last, when all are ASCII.
    """
    plain = F.lower(F.regexp_replace(F.regexp_replace(line, "'", ""), "[^A-Za-z0-9]+", " "))
    return F.regexp_replace(plain, "(?:[a-z0-9]{40})+", "\n")


def words(segment: Column) -> Column:
    return F.array_remove(F.split(segment, " "), "")


def entry(text: Column) -> Column:
    """The normal form of a list's entry."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), "'", ""), "[^a-z0-9]+", " "))


#: Letters that fold to others beside those that NFD strips: fixed values.
FOLDS = {"œ": "oe", "æ": "ae", "ß": "ss", "ł": "l", "đ": "d", "ø": "o", "ı": "i"}
GERMAN = {"ä": "ae", "ö": "oe", "ü": "ue", "ß": "ss"}
_ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿāăąćčďēĕėęěğģīĭįķĺļľńņňōŏőŕŗřśşšţťūŭůűųźżž"
_PLAIN = "aaaaaaceeeeiiiinooooouuuuyyaaaccdeeeeeggiiiklllnnnooorrrsssttuuuuuzzz"


def fold(text: Column, language: str | None = None) -> Column:
    """Latin letters without their marks; German spells umlauts out."""
    text = F.lower(text)
    for a, b in ({**FOLDS, **GERMAN} if language == "de" else FOLDS).items():
        text = F.replace(text, F.lit(a), F.lit(b))
    return F.translate(text, _ACCENTED, _PLAIN)


def letters(text: Column) -> Column:
    return F.replace(text, F.lit(" "), F.lit(""))


def sort_key(chars: Column) -> Column:
    return F.array_join(F.sort_array(F.split(chars, "")), "")
