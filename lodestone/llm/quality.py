"""Quality rules as a short-circuit cascade.

Each rule is a step that computes its metrics under a guard and says which rows it rejects. On a bounded
sample every rule's cost and selectivity (share of rows rejected) are measured; rules then run in
order of rejections per second, and a row that one rule rejects is not looked at by later rules: the guard
makes their metrics null without evaluating them. A rule's cost is the time of a job with it less the time of the same job without
it, both compiled before, so that starting a job costs no rule anything. The order is a matter of speed only: the verdict is the
conjunction of all rules, so reruns agree whatever the clock said.

The sample: at most SAMPLE_ROWS texts of at most SAMPLE_CHARS characters, one text in SAMPLE_ONE_IN by its hash, from the first
partitions that hold enough of them; no other partition is read, and nothing is shuffled.

Defined cases: a null or blank text has no words, all metrics 0, and fails min_words. Extra columns pass
through accepted(), whatever their names; metrics() and cascade() add columns that begin with OWN, so theirs must not. Repeated rows and ties are judged each on
its own; null ids stay. An empty table gives an empty table.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, boxed, unboxed, words_of

#: Prefix of the columns that the cascade adds.
OWN = "_q_"
#: The sample on which costs and selectivities are measured (a bound, whatever the size of the table), and how often a job reads it.
SAMPLE_ROWS, SAMPLE_CHARS, SAMPLE_ONE_IN, SAMPLE_READS = 1000, 100_000, 4, 4
#: Up to so many distinct repeated windows, membership is tested directly; beyond that windows are sorted.
FEW_REPEATS = 32


def _c(name: str) -> Column:
    return F.col(OWN + name)


def _words(df: DataFrame) -> DataFrame:
    df = df.withColumn(OWN + "words", words_of(F.col(OWN + "text")))
    return df.withColumns({OWN + "n_words": F.size(_c("words")).cast("long"), OWN + "word_chars": F.length(F.array_join(_c("words"), "")).cast("long")})


def _only(guard: Column | None, value: Column) -> Column:
    return value if guard is None else F.when(guard, value)


def _symbols(df: DataFrame, guard: Column | None) -> DataFrame:
    return df.withColumn(OWN + "n_symbols", _only(guard, F.regexp_count(_c("text"), F.lit(r"[#*$%&|<>]")).cast("long")))


def _lines(df: DataFrame, guard: Column | None) -> DataFrame:
    df = df.withColumn(OWN + "lines", _only(guard, F.filter(F.split(_c("text"), "\n"), lambda x: x.rlike(WORD))))
    return df.withColumns({OWN + "n_lines": F.size(_c("lines")).cast("long"), OWN + "n_dup_lines": (F.size(_c("lines")) - F.size(F.array_distinct(_c("lines")))).cast("long")}).drop(OWN + "lines")


def _alpha(df: DataFrame, guard: Column | None) -> DataFrame:
    return df.withColumn(OWN + "n_alpha", _only(guard, F.size(F.filter(_c("words"), lambda w: w.rlike(r"\p{L}"))).cast("long")))


#: A line of text, from its first word on.
LINE = r"[^\x20\x09-\x0D][^\n]*"
BULLET = r"(?:^|\n)[\x20\t]*[•‣◦●*-]"
ELLIPSIS = r"(?:…|\.\.\.)[\x20\t\r]*(?:\n|\z)"


def _marked(name: str, pattern: str) -> Callable[[DataFrame, Column | None], DataFrame]:
    """Counts lines, and those among them that pattern marks."""
    count = lambda p: F.regexp_count(_c("text"), F.lit(p)).cast("long")
    return lambda df, guard: df.withColumns({OWN + name: _only(guard, count(pattern)), OWN + name + "_of": _only(guard, count(LINE))})


def _repeats(df: DataFrame, guard: Column | None) -> DataFrame:
    """n_repeat_words: words covered by three-word windows that occur twice or more in the text."""
    df = df.withColumn(OWN + "each", _only(guard, F.transform(_c("words"), lambda w: F.xxhash64(w))))
    window = F.transform(_c("each"), lambda x, i: F.xxhash64(x, F.get(_c("each"), i + 1), F.get(_c("each"), i + 2)))
    df = df.withColumn(OWN + "win", F.slice(window, F.lit(1), F.greatest(F.size(_c("each")) - 2, F.lit(0))))
    df = df.withColumn(OWN + "win", F.when(F.size(F.array_distinct(_c("win"))) < F.size(_c("win")), _c("win")))
    df = df.withColumn(OWN + "sorted", F.sort_array(_c("win")))
    again = F.filter(_c("sorted"), lambda x, i: x.eqNullSafe(F.get(_c("sorted"), i - 1)) & ~x.eqNullSafe(F.get(_c("sorted"), i - 2)))
    df = df.withColumn(OWN + "again", again)
    df = df.withColumn(OWN + "ranked", F.when(F.size(_c("again")) > FEW_REPEATS, F.sort_array(F.transform(_c("win"), lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    by_test = F.filter(F.transform(_c("win"), lambda x, i: F.when(F.array_contains(_c("again"), x), i)), lambda i: i.isNotNull())
    by_sort = F.sort_array(F.transform(F.filter(_c("ranked"), lambda e, i: e["h"].eqNullSafe(F.get(_c("ranked"), i - 1)["h"]) | e["h"].eqNullSafe(F.get(_c("ranked"), i + 1)["h"])), lambda e: e["i"]))
    df = df.withColumn(OWN + "at", F.when(F.size(_c("again")) > FEW_REPEATS, by_sort).otherwise(by_test))
    covered = F.aggregate(F.transform(_c("at"), lambda p, i: F.least(F.lit(3), F.coalesce(F.get(_c("at"), i + 1) - p, F.lit(3)))), F.lit(0), lambda a, x: a + x)
    df = df.withColumn(OWN + "n_repeat_words", _only(guard, F.coalesce(covered, F.lit(0)).cast("long")))
    return df.drop(*(OWN + x for x in ("each", "win", "sorted", "again", "ranked", "at")))


@dataclass(frozen=True)
class Rule:
    """metrics(df, guard) adds the rule's columns where guard holds; rejects is true for rows that fail."""

    name: str
    metrics: Callable[[DataFrame, Column | None], DataFrame]
    rejects: Callable[[], Column]


#: Production rules. The first two are the base of the contract; limits are fixed values.
RULES = (
    Rule("min_words", lambda df, g: df, lambda: _c("n_words") < 50),
    Rule("repeated_windows", _repeats, lambda: 100 * _c("n_repeat_words") > 50 * _c("n_words")),
    Rule("symbol_ratio", _symbols, lambda: 10 * _c("n_symbols") > _c("n_words")),
    Rule("word_length", lambda df, g: df, lambda: (_c("word_chars") < 2 * _c("n_words")) | (_c("word_chars") > 15 * _c("n_words"))),
    Rule("repeated_lines", _lines, lambda: 2 * _c("n_dup_lines") > _c("n_lines")),
    Rule("words_with_letters", _alpha, lambda: 10 * _c("n_alpha") < 7 * _c("n_words")),
    Rule("bullet_lines", _marked("bullets", BULLET), lambda: 10 * _c("bullets") > 9 * _c("bullets_of")),
    Rule("ellipsis_lines", _marked("ellipses", ELLIPSIS), lambda: 10 * _c("ellipses") > 3 * _c("ellipses_of")),
)
BASE = ("min_words", "repeated_windows")
#: Rules whose metrics the contract wants of every row, rejected or not.
FORCED = (*BASE, "symbol_ratio", "word_length", "repeated_lines")


def _start(docs: DataFrame, text: str) -> DataFrame:
    return _words(docs.withColumn(OWN + "text", F.coalesce(F.col(text).cast("string"), F.lit(""))))


def _own_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.startswith(OWN)]


def metrics(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with every metric of every rule, computed for every row."""
    df = _start(docs, text)
    for rule in rules:
        df = rule.metrics(df, None)
    return df


def sampled(docs: DataFrame, text: str, rows: int) -> DataFrame:
    """The sample's texts, each SAMPLE_READS times, as a local table."""
    own = docs.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    own = own.filter((F.length("text") <= SAMPLE_CHARS) & (F.pmod(F.xxhash64("text"), F.lit(SAMPLE_ONE_IN)) == 0))
    taken = docs.sparkSession.createDataFrame([(r["text"],) for r in own.take(rows)], "text string")
    return taken.withColumn("read", F.explode(F.sequence(F.lit(1), F.lit(SAMPLE_READS))))


def measured_order(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> list[tuple[Rule, float, float]]:
    """(rule, seconds a row, share rejected) by rejections per second, highest first, from a sample of at most sample_rows rows."""
    sample = _start(sampled(docs, text, sample_rows), "text")

    def timed(rule: Rule | None) -> tuple[float, int, int]:
        df, hit = (sample, F.lit(False)) if rule is None else (rule.metrics(sample, None), rule.rejects())
        job = df.agg(F.sum("_q_n_words"), F.count_if(hit), F.count(F.lit(1)))
        for _ in range(2):  # the first run compiles the job
            began = time.perf_counter()
            _, hits, rows = job.first()
        return time.perf_counter() - began, hits, rows

    plain, _, _ = timed(None)
    found = []
    for rule in rules:
        seconds, hits, rows = timed(rule)
        found.append((rule, max(seconds - plain, plain / 100) / max(rows, 1), hits / max(rows, 1)))
    return sorted(found, key=lambda x: (-x[2] / x[1], x[1]))


def cascade(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """docs with the boolean _q_kept: rules run in measured order, each only on rows that all before it accepted."""
    df = _start(docs, text).withColumn(OWN + "kept", F.lit(True))
    for rule, _, _ in measured_order(docs, text, rules, sample_rows):
        df = rule.metrics(df, _c("kept"))
        df = df.withColumn(OWN + "kept", _c("kept") & ~F.coalesce(rule.rejects(), F.lit(False)))
    # the verdict leaves through a generator: no filter on it is pushed below, which would inline all the stages into itself
    df = df.withColumn(OWN + "kept", F.explode(F.array(_c("kept"))))
    return df.drop(*(c for c in _own_columns(df) if c != OWN + "kept"))


def accepted(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """Rows of docs that every rule accepts, with the columns of docs, whatever their names."""
    rows = boxed(docs, text=F.col("`" + text.replace("`", "``") + "`"))
    return unboxed(cascade(rows, "text", **options).filter(_c("kept")))


def report(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Per document: its id, the base metrics, base_failed and the verdict."""
    docs = docs.select("doc_id", "text")
    ordered = [r for r, _, _ in measured_order(docs, rules=RULES, sample_rows=sample_rows)]
    by_name = {r.name: r for r in RULES}
    df = _start(docs, "text")
    base = F.lit(False)
    for name in BASE:
        df = by_name[name].metrics(df, None)
        base = base | by_name[name].rejects()
    for name in FORCED:
        if name not in BASE:
            df = by_name[name].metrics(df, None)
    df = df.withColumn(OWN + "kept", ~base)
    for rule in ordered:  # the contract's metrics are there; all other metrics are computed under the guard
        if rule.name not in FORCED:
            df = rule.metrics(df, _c("kept"))
        df = df.withColumn(OWN + "kept", _c("kept") & ~F.coalesce(rule.rejects(), F.lit(False)))
    named = [_c(n).alias(n) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return df.select("doc_id", *named, base.alias("base_failed"), _c("kept").alias("kept"))


#: DuckDB: the same report. Windows are compared as texts.
REPORT_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
m AS (
  SELECT doc_id, w, len(w)::BIGINT AS n_words, coalesce(length(array_to_string(w, '')), 0)::BIGINT AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
    len(list_filter(w, lambda x: regexp_matches(x, '\p{L}')))::BIGINT AS n_alpha,
    len(regexp_extract_all(t, '[^\x20\x09-\x0D][^\n]*')) AS n_of, len(regexp_extract_all(t, '(?:^|\n)[\x20\t]*[•‣◦●*-]')) AS n_bullets,
    len(regexp_extract_all(t, '(?:…|\.\.\.)[\x20\t\r]*(?:\n|\z)')) AS n_ellipses FROM d),
win AS (SELECT doc_id, i, w[i] || ' ' || w[i+1] || ' ' || w[i+2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k)::BIGINT AS n_repeat_words FROM dup, (VALUES (0), (1), (2)) AS o(k) GROUP BY doc_id),
a AS (SELECT m.*, len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words FROM m LEFT JOIN cov USING (doc_id)),
b AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM a)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (10 * n_symbols > n_words) AND NOT (word_chars < 2 * n_words OR word_chars > 15 * n_words)
  AND NOT (2 * n_dup_lines > n_lines) AND NOT (10 * n_alpha < 7 * n_words) AND NOT (10 * n_bullets > 9 * n_of) AND NOT (10 * n_ellipses > 3 * n_of) AS kept
FROM b
"""
