"""Front matter of project reports, from page texts: title, authors, advisor, keywords, year; native expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import any_of, collapsed, has_text, latin_words, lines

#: Words that a line of capitals with a name does not hold; headings of a degree.
TITLE_WORDS = "access agency application attack computer cybersecurity development energy for in management monitoring of online project system the vehicle wlan".split()
NAME_PREFIX = r"(?iU)^(Mr\.|Ms\.|Miss)\s+[A-Z]"
DEGREE = r"(?iU)\b(BACHELOR|MASTER|DOCTOR|DIPLOMA)\b"
PROPOSAL = r"(?iU)\(Project\s+Proposal\)"
FIELDS = ("project_title", "author", "advisor", "keywords", "year")
LAST_CONTRIBUTING_PAGE = 5


def looks_like_name(line: Column) -> Column:
    words = latin_words(line)
    capitals = (F.upper(line) == line) & (F.lower(line) != line) & F.size(words).between(2, 3) & ~any_of(words, TITLE_WORDS)
    return line.rlike(NAME_PREFIX) | capitals


def _settled(pages: DataFrame, **made: Column) -> DataFrame:
    """pages with columns that leave through a generator: what later steps use of them is not computed again, and no filter on them moves below."""
    df = pages.withColumn("_s", F.explode(F.array(F.struct(*[c.alias(n) for n, c in made.items()]))))
    return df.withColumns({n: F.col("_s")[n] for n in made}).drop("_s")


def with_title_parts(pages: DataFrame) -> DataFrame:
    """pages with lines, title_lines and author_lines (M1-M3), and _named: which lines look like names."""
    df = _settled(pages, lines=lines(F.col("content")))
    degree = F.array_position(F.transform("lines", lambda x: x.rlike(DEGREE)), True).cast("int")
    df = _settled(df, _named=F.transform("lines", looks_like_name), _degree=F.nullif(degree, F.lit(0)))
    before = F.filter(F.sequence(F.lit(0), F.col("_degree") - 1), lambda i: F.when(i == 0, True).otherwise(~F.get(F.col("_named"), i - 1)))
    df = _settled(df, _k=F.when(F.col("_degree") > 0, F.array_max(before)))
    valid = F.coalesce((F.col("_k") > 0) & (F.col("_k") < F.col("_degree") - 1), F.lit(False))
    empty = F.array().cast("array<string>")
    df = _settled(
        df,
        title_lines=F.when(valid, F.slice("lines", F.lit(1), F.greatest("_k", F.lit(1)))).otherwise(F.slice("lines", 1, 1)),
        author_lines=F.when(valid, F.slice("lines", F.col("_k") + 1, F.greatest(F.col("_degree") - 1 - F.col("_k"), F.lit(0)))).otherwise(empty),
    )
    return df.drop("_degree", "_k")


def with_fields(pages: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """pages with the fields asked for as found on each page, null where not found (M4-M9)."""
    named = "project_title" in fields or "author" in fields
    df = with_title_parts(pages) if named else _settled(pages, lines=lines(F.col("content")))
    some = F.size("lines") > 0
    parts, made = {}, {}  # what a field is made of; the field
    if named:
        df = _settled(df, _title=F.array_join("title_lines", " "), _found=F.regexp_extract("content", "(" + PROPOSAL + ")", 1))
        df = _settled(df, _proposal=some & (F.col("_found") != "") & ~F.contains(F.lower("_title"), F.lower("_found")))
        made["project_title"] = F.when(some, F.when(F.col("_proposal"), F.concat_ws(" ", F.array_join(F.slice("lines", 1, 2), " "), "_found")).otherwise(F.col("_title")))
    if "author" in fields:
        start = F.when(F.col("_proposal"), 3).otherwise(F.size("title_lines") + 1)
        df = _settled(df, _lines=F.slice("lines", start, F.lit(8)), _names=F.slice("_named", start, F.lit(8)))
        df = _settled(df, _stop=F.array_position(F.transform("_lines", lambda x: x.rlike(r"(?i)Bachelor|Advisor|Keyword|Year")), True))
        added = F.array_distinct(F.filter("_lines", lambda x, i: F.get("_names", i) & ((F.col("_stop") == 0) | (i < F.col("_stop") - 1))))
        df = _settled(df, _added=added)
        parts["_authors"] = F.concat("author_lines", F.array_except("_added", "author_lines"))
        made["author"] = F.when(some & (F.size("_authors") > 0), F.array_join("_authors", ", "))
    if "advisor" in fields:
        committee = F.transform("lines", lambda x, i: F.when(x.rlike("(?i)Supervisory"), F.regexp_extract(F.concat_ws(" ", F.slice("lines", i + 1, F.lit(3))), r"(?iU)Supervisory\s+Committee\s+(.*?)\s+Advisor", 0)))
        parts["_hit"] = F.get(F.filter(committee, lambda x: x.isNotNull() & (x != "")), F.lit(0))
        advisor = F.regexp_replace(F.regexp_extract("_hit", r"(?iU)Supervisory\s+Committee\s+(.*?)\s+Advisor$", 1), r"(?U)^[\s.:-]+|[\s.:-]+$", "")
        made["advisor"] = F.when(F.col("_hit").isNotNull(), advisor)
    if "keywords" in fields:
        parts["_rest"] = F.filter(F.transform(F.filter("lines", lambda x: x.rlike(r"(?iU)\bKeywords?\b")), lambda x: collapsed(F.regexp_replace(x, r"(?iU)Keywords?\s*[:\-]?\s*", ""))), lambda x: x != "")
        made["keywords"] = F.when(F.size("_rest") > 0, F.regexp_replace(collapsed(F.array_join("_rest", " ")), r"^[ .]+|[ .]+$", ""))
    if "year" in fields:
        parts["_year"] = F.regexp_extract("content", r"(?U)\b(20[12]\d)\b", 1)
        made["year"] = F.when(F.col("_year") != "", F.col("_year"))
    df = _settled(_settled(df, **parts) if parts else df, **{f: made[f] for f in fields})
    return df.select(*pages.columns, *[f for f in fields if f not in pages.columns])


def carried(pages: DataFrame, backfill: bool = False) -> DataFrame:
    """pages with each field's first value on the document's contributing pages, as of each page."""
    until = Window.partitionBy("source").orderBy("page_number").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing if backfill else 0)
    open_ = F.col("page_number") <= LAST_CONTRIBUTING_PAGE
    return pages.withColumns({f: F.first(F.when(open_ & has_text(F.col("content")), F.col(f)), ignorenulls=True).over(until) for f in FIELDS})
