"""Metadata filters read from questions, and their evaluation against payloads.

A filter is MAP<STRING, ARRAY<STRING>>: fields are AND-ed, values are alternatives. Each step takes the questions with
columns rest (what is left of the text) and filters, and deletes what it matched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalized
from ..sources.tables import cut
from .normalize import containing

FILTER = "map<string,array<string>>"
#: A named value, and years that questions may hold.
NAMED = r"""(?iU)"?\b(project_title|title|author|advisor|keywords?)\b"?\s*[:=]\s*(?:"([^"]+)"|'([^']+)'|([^\s"]+))"""
YEAR = r"(?U)\b(19\d{2}|20\d{2})\b"
#: Author patterns that a question is tried against.
MOST_PATTERNS = 1_000
KEY_NAMES = {"title": "project_title", "keyword": "keywords"}


def start(questions: DataFrame) -> DataFrame:
    """The columns that steps work on; filters read before stay."""
    read = F.col("filters") if "filters" in questions.columns else F.create_map().cast(FILTER)
    return questions.withColumns({"rest": F.col("question"), "filters": read})


def _settled(q: DataFrame) -> DataFrame:
    """Ends a step: its columns leave through a generator, so that tests on them in later steps do not inline the step."""
    return q.withColumn("_s", F.explode(F.array(F.struct("rest", "filters")))).withColumns({"rest": F.col("_s.rest"), "filters": F.col("_s.filters")}).drop("_s")


def _with(filters: Column, key: Column | str, values: Column) -> Column:
    key = F.lit(key) if isinstance(key, str) else key
    return F.map_concat(F.map_filter(filters, lambda k, v: k != key), F.map_from_arrays(F.array(key), F.array(values)))


def named_values(q: DataFrame) -> DataFrame:
    """field:value and field="value"; of duplicates the last wins; all occurrences go (F1, F2)."""
    groups = [F.regexp_extract_all("rest", F.lit(NAMED), g) for g in (1, 2, 3, 4)]
    pairs = F.zip_with(F.transform(groups[0], lambda k: F.lower(k)), F.zip_with(F.zip_with(groups[1], groups[2], lambda a, b: F.concat(a, b)), groups[3], lambda a, b: F.concat(a, b)), lambda k, v: F.struct(F.coalesce(*[F.when(k == a, F.lit(b)) for a, b in KEY_NAMES.items()], k).alias("k"), F.trim(v).alias("v")))
    q = q.withColumn("_pairs", pairs)
    last = F.filter("_pairs", lambda p, i: ~F.exists(F.slice("_pairs", i + 2, F.size("_pairs")), lambda o: o["k"] == p["k"]))
    found = F.map_from_entries(F.transform(last, lambda p: F.struct(p["k"], F.array(p["v"]))))
    return _settled(q.withColumns({"filters": F.map_concat("filters", F.map_filter(found, lambda k, v: ~F.map_contains_key("filters", k))), "rest": F.regexp_replace("rest", NAMED, "")}).drop("_pairs"))


def advisor_alias(q: DataFrame, aliases: DataFrame) -> DataFrame:
    """An advisor value that contains an alias becomes its canonical form; the first alias wins."""
    value = F.get(F.try_element_at("filters", F.lit("advisor")), F.lit(0))
    known = aliases.filter("kind = 'advisor'").select(F.lower("alias").alias("phrase"), "canonical", "ord")
    hits = containing(q.select("question_id", F.lower(value).alias("value")).filter("value is not null"), "value", known, "phrase")
    first = hits.groupBy("question_id").agg(F.min_by("canonical", "ord").alias("hit"))
    return _settled(q.join(first, "question_id", "left").withColumn("filters", F.when(F.col("hit").isNotNull(), _with(F.col("filters"), "advisor", F.array("hit"))).otherwise(F.col("filters"))).drop("hit"))


def year(q: DataFrame) -> DataFrame:
    """The first year is the filter, all years go."""
    found = F.regexp_extract("rest", YEAR, 1)
    return _settled(q.withColumns({"filters": F.when(found != "", _with(F.col("filters"), "year", F.array(found))).otherwise(F.col("filters")), "rest": F.regexp_replace("rest", YEAR, "")}))


def quoted(text: Column) -> Column:
    """A pattern for text as it stands, one that holds an end of quotation too."""
    return F.concat(F.lit(r"\Q"), F.replace(text, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def _word(alias: Column) -> Column:
    return F.concat(F.lit(r"(?iU)\b"), quoted(alias), F.lit(r"\b"))


def _named_alias(q: DataFrame, aliases: DataFrame, kind: str, field: str) -> DataFrame:
    known = aliases.filter(F.col("kind") == kind).select(F.lower("alias").alias("phrase"), "canonical", "ord")
    open_ = q.filter(~F.map_contains_key("filters", field)).select("question_id", F.lower("rest").alias("text"))
    hits = containing(open_, "text", known, "phrase").filter(F.rlike("text", _word(F.col("phrase"))))
    first = hits.groupBy("question_id").agg(F.min_by(F.struct("phrase", "canonical"), "ord").alias("hit"))
    return q.join(first, "question_id", "left")


def author_alias(q: DataFrame, aliases: DataFrame) -> DataFrame:
    """The first known short name of an author, as a whole word, else the first spelling pattern that fits; one occurrence goes.

    Patterns (column pattern of aliases) come as one row beside every question; more than MOST_PATTERNS are refused.
    """
    q = _named_alias(q, aliases, "author", "author")
    if "pattern" in aliases.columns:
        written = aliases.filter("kind = 'author' and pattern is not null")
        if written.limit(MOST_PATTERNS + 1).count() > MOST_PATTERNS:
            raise ValueError(f"over {MOST_PATTERNS} author patterns: each question tries each of them; write them as aliases")
        each = written.select(F.struct("ord", F.concat(F.lit(r"(?iU)\b(?:"), "pattern", F.lit(r")\b")).alias("pattern"), "canonical").alias("p"))
        q = q.join(F.broadcast(each.agg(F.array_sort(F.collect_list("p")).alias("_patterns"))))  # one row
        fits = F.get(F.filter("_patterns", lambda p: F.rlike("rest", p["pattern"])), F.lit(0))
        found = F.when(F.col("hit").isNull() & ~F.map_contains_key("filters", "author") & fits.isNotNull(), F.struct(F.regexp_substr("rest", fits["pattern"]).alias("phrase"), fits["canonical"].alias("canonical")))
        q = q.withColumn("hit", F.coalesce("hit", found)).drop("_patterns")
    spot = F.regexp_instr(F.lower("rest"), _word(F.lower("hit.phrase")))
    cut = F.concat(F.substring("rest", F.lit(1), spot - 1), F.substring("rest", spot + F.length("hit.phrase"), F.length("rest")))
    return _settled(q.withColumns({"filters": F.when(F.col("hit").isNotNull(), _with(F.col("filters"), "author", F.array("hit.canonical"))).otherwise(F.col("filters")), "rest": F.when(F.col("hit").isNotNull(), cut).otherwise(F.col("rest"))}).drop("hit"))


def staff(q: DataFrame, aliases: DataFrame) -> DataFrame:
    """Without an advisor so far: the first member of staff named as a whole word."""
    q = _named_alias(q, aliases, "staff", "advisor")
    cut = F.regexp_replace("rest", _word(F.col("hit.phrase")), F.lit(""))
    return _settled(q.withColumns({"filters": F.when(F.col("hit").isNotNull(), _with(F.col("filters"), "advisor", F.array("hit.canonical"))).otherwise(F.col("filters")), "rest": F.when(F.col("hit").isNotNull(), cut).otherwise(F.col("rest"))}).drop("hit"))


def dictionary_hit(q: DataFrame, dictionary: DataFrame, field: str, longer_than: int = 3) -> DataFrame:
    """The longest dictionary term that the question contains names the filter (F6-F9); ties go to the first term."""
    known = dictionary.filter((F.col("field") == field) & (F.length("term") > longer_than)).select(F.lower("term").alias("phrase"), "term", "full_values")
    open_ = q.filter(~F.map_contains_key("filters", field)).select("question_id", F.lower("rest").alias("text"))
    hits = containing(open_, "text", known, "phrase")
    best = hits.groupBy("question_id").agg(F.min_by(F.struct("phrase", "full_values"), F.struct((-F.length("term")).alias("n"), "term")).alias("hit"))
    q = q.join(best, "question_id", "left")
    cut = F.regexp_replace("rest", F.concat(F.lit("(?iu)"), quoted(F.col("hit.phrase"))), F.lit(""))
    return _settled(q.withColumns({"filters": F.when(F.col("hit").isNotNull(), _with(F.col("filters"), field, F.col("hit.full_values"))).otherwise(F.col("filters")), "rest": F.when(F.col("hit").isNotNull(), cut).otherwise(F.col("rest"))}).drop("hit"))


def validated(filters: Column) -> Column:
    """Values trimmed, blank ones and empty fields dropped."""
    return F.map_filter(F.transform_values(filters, lambda k, v: F.filter(F.transform(v, lambda x: F.trim(x)), lambda x: F.coalesce(x != "", F.lit(False)))), lambda k, v: F.coalesce(F.size(v) > 0, F.lit(False)))


def residual(question: Column, filters: Column) -> Column:
    """question without each filter value (once, any case), and without years where a year is a filter."""
    def without(text: Column, value: Column) -> Column:
        at = F.position(F.lower(value), F.lower(text))
        return F.when(at > 0, F.concat(F.substring(text, F.lit(1), at - 1), F.substring(text, at + F.length(value), F.length(text)))).otherwise(text)

    left = F.aggregate(F.flatten(F.map_values(filters)), question, without)
    return normalized(F.when(F.map_contains_key(filters, "year"), F.regexp_replace(left, YEAR, "")).otherwise(left))


def overridden(filters: Column, overrides: Column) -> Column:
    """The caller's fields win."""
    return F.map_zip_with(filters, overrides, lambda k, a, b: F.coalesce(b, a))


def matches(filters: Column, payload: Column) -> Column:
    """Every field of the filter equals one of its values; no fields: every payload."""
    return F.forall(F.map_entries(filters), lambda e: F.coalesce(F.array_contains(e["value"], F.try_element_at(payload, e["key"])), F.lit(False)))


def canonical_values(q: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Typed values that equal a dictionary term but for case take that term's stored values."""
    each = q.select("question_id", F.explode("filters").alias("field", "values")).select("question_id", "field", F.explode("values").alias("value"))
    known = dictionary.select("field", F.lower("term").alias("low"), "full_values")
    each = each.join(known, (each["field"] == known["field"]) & (F.lower("value") == known["low"]), "left").select("question_id", each["field"], F.coalesce("full_values", F.array("value")).alias("values"))
    merged = each.groupBy("question_id", "field").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("values")))).alias("values"))
    back = merged.groupBy("question_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "values")))).alias("_new"))
    return q.join(back, "question_id", "left").withColumn("filters", F.coalesce("_new", F.create_map().cast(FILTER))).drop("_new")


def parse(questions: DataFrame, dictionary: DataFrame, aliases: DataFrame) -> DataFrame:
    """question_id, question, filters, residual (F13): all steps, dictionaries always in use."""
    dictionary = cut(dictionary, "dictionary")
    q = cut(year(advisor_alias(cut(named_values(start(questions))), aliases)))
    q = cut(author_alias(q, aliases))
    for field, longer in (("project_title", 3), ("author", 3), ("advisor", 3), ("keywords", 2)):  # each step is used twice by the next
        q = cut(dictionary_hit(q, dictionary, field, longer))
    q = canonical_values(cut(staff(q, aliases)), dictionary)
    q = q.withColumn("filters", validated(F.col("filters")))
    return q.select("question_id", "question", "filters", residual(F.col("question"), F.col("filters")).alias("residual"))


def sorted_text(filters: Column) -> Column:
    """A filter as text, fields in order: for output and comparison."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(filters)), lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"], "|"))), ";")
