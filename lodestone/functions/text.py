"""Expressions over lines and tokens of text. Patterns are Unicode-aware, as (?U) asks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Punctuation stripped from the edges of a token (fixed value).
EDGE_PUNCTUATION = "\"'`.,;:!?()[]{}<>"


def collapsed(text: Column) -> Column:
    """Runs of white space as one space, trimmed."""
    return F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), "^ | $", "")


def normalized(text: Column) -> Column:
    return F.lower(collapsed(text))


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def has_text(text: Column) -> Column:
    return F.coalesce(text.rlike(r"(?U)\S"), F.lit(False))


def lines(text: Column) -> Column:
    """Non-empty trimmed lines."""
    return F.filter(F.transform(F.split(text, "\n"), stripped), lambda x: x != "")


def latin_words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"([A-Za-z]+)"), 1)


def any_of(words: Column, listed) -> Column:
    return F.arrays_overlap(F.transform(words, F.lower), F.array(*[F.lit(w) for w in sorted(listed)]))
