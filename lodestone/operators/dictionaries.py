"""Dictionaries of the values that questions may name, and the terms that spelling must not touch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import any_of, latin_words, normalized, stripped

#: Fixed values.
NON_NAME_WORDS = "and attack computer cybersecurity development energy for in low of system the wlan".split()
STOP_WORDS = "and for from in of on the to using with".split()


def likely_author(value: Column) -> Column:
    words = latin_words(value)
    return (F.size(words) >= 2) & ~any_of(words, NON_NAME_WORDS)


def value_counts(points: DataFrame) -> DataFrame:
    """field, value, n: how many points have a value, of all fields that dictionaries and protected terms are made of.

    The state from which dictionaries follow without their points: it grows with distinct values, and changes by changed().
    """
    fields = [c for c in ("project_title", "title", "author", "advisor", "keywords") if c in points.columns]
    each = points.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in fields])).alias("v")).select("v.*")
    return each.filter("value is not null").groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))


def changed(counts: DataFrame, fresh: DataFrame | None = None, gone: DataFrame | None = None) -> DataFrame:
    """counts after points are added and others are gone; only these are read. A value that no point has any more is left out."""
    rows = counts.select("field", "value", "n")
    if fresh is not None:
        rows = rows.unionByName(value_counts(fresh))
    if gone is not None:
        rows = rows.unionByName(value_counts(gone).withColumn("n", -F.col("n")))
    return rows.groupBy("field", "value").agg(F.sum("n").alias("n")).filter("n > 0")


def valued(counts: DataFrame) -> DataFrame:
    """counts as rows of one value each: all functions of this module that list values give for it what they give for its points."""
    return counts.select(*[F.when(F.col("field") == c, F.col("value")).alias(c) for c in ("project_title", "title", "author", "advisor", "keywords")])


def titles(points: DataFrame) -> DataFrame:
    """Distinct non-empty titles."""
    columns = [c for c in ("project_title", "title") if c in points.columns]
    out = points.select(stripped(F.col(columns[0])).alias("term"))
    for c in columns[1:]:
        out = out.unionByName(points.select(stripped(F.col(c)).alias("term")))
    return out.filter("term <> ''").distinct()


def _parts(points: DataFrame, field: str) -> DataFrame:
    whole = points.select(F.col(field).alias("full")).filter("full is not null").distinct()
    return whole.select(F.explode(F.transform(F.split("full", ","), stripped)).alias("term"), "full").filter("term <> ''")


def _full(parts: DataFrame) -> DataFrame:
    return parts.groupBy("term").agg(F.array_sort(F.collect_set(stripped(F.col("full")))).alias("full_values"))


def authors(points: DataFrame) -> DataFrame:
    """Likely names with every full author string they occur in."""
    return _full(_parts(points, "author").filter(likely_author(F.col("term"))))


def advisors(points: DataFrame) -> DataFrame:
    return points.select(stripped(F.col("advisor")).alias("term")).filter("term <> ''").distinct()


def keywords(points: DataFrame) -> DataFrame:
    return _full(_parts(points, "keywords"))


def dictionary(points: DataFrame) -> DataFrame:
    """field, term, full_values of all four dictionaries."""
    alone = lambda df, f: df.select(F.lit(f).alias("field"), "term", F.array("term").alias("full_values"))
    full = lambda df, f: df.select(F.lit(f).alias("field"), "term", "full_values")
    return alone(titles(points), "project_title").unionByName(full(authors(points), "author")).unionByName(alone(advisors(points), "advisor")).unionByName(full(keywords(points), "keywords"))


def summary(points: DataFrame) -> DataFrame:
    """Records scanned and the size of each dictionary."""
    sizes = dictionary(points).groupBy("field").agg(F.count(F.lit(1)).alias("n_terms"))
    scanned = points.agg(F.count(F.lit(1)).alias("n_terms")).select(F.lit("records").alias("field"), "n_terms")
    return scanned.unionByName(sizes)


def terms(points: DataFrame) -> DataFrame:
    """Normalized values of title, author and advisor."""
    each = points.select(F.explode(F.array("project_title", "author", "advisor")).alias("value")).filter("value is not null")
    return each.select(normalized(F.col("value")).alias("term")).filter("term <> ''").distinct()


def term_tokens(terms_: DataFrame) -> DataFrame:
    """Distinct tokens of terms, longer than two and no stop-words."""
    tokens = F.regexp_extract_all(F.lower("term"), F.lit("([a-z0-9]+)"), 1)
    out = terms_.select(F.explode(tokens).alias("token")).filter(F.length("token") > 2)
    return out.filter(~F.col("token").isin(*STOP_WORDS)).distinct()


def protected(points: DataFrame, aliases: DataFrame) -> DataFrame:
    """kind (phrase or token), value: what spelling correction must leave alone."""
    named = aliases.filter("kind in ('advisor', 'staff')").select(F.explode(F.array("alias", "canonical")).alias("t")).select(F.lower("t").alias("term"))
    phrases = terms(points).unionByName(named).distinct()
    return phrases.select(F.lit("phrase").alias("kind"), F.col("term").alias("value")).unionByName(term_tokens(phrases).select(F.lit("token").alias("kind"), F.col("token").alias("value")))
