"""Document fingerprints by one-permutation MinHash, in DataFrame functions only.

Each shingle of SHINGLE_WORDS words is hashed once; the hash's leading bits name one of BINS bins, and each bin keeps its
least hash. Empty bins are filled by optimal densification: bin j looks at bins of a random sequence of its own
until it meets a full one (PROBES steps as a table, beyond that the first full bin in a permutation of j's own). The low
8 bits of each bin are the fingerprint, two hex digits a bin; likeness is the share of equal bins, corrected for the 1 in 256 that
agree by chance.

The next document comes from a window over buckets of ids; a bucket's last document finds the first of the next bucket through a
table with one row per bucket (at most MOST_BUCKETS). The texts are shuffled once.

Defined cases: null text is empty; a text without words has the empty fingerprint, like another such text by 1 and any
other by 0; fewer words than a shingle are one shingle. Ids that repeat are ordered by text, null ids come last. A single document is its own
next. Extra columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import words_of

BINS, SHINGLE_WORDS, PROBES = 256, 5, 8
BUCKET_ROWS, MOST_BUCKETS = 2_000, 10_000
_SHIFT = 55
_EMPTY = (1 << _SHIFT) - 1


def _table(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _probe_tables() -> tuple[list[list[int]], list[int]]:
    rng = np.random.default_rng(11)
    return rng.integers(0, BINS, (PROBES, BINS)).tolist(), rng.integers(0, BINS, BINS).tolist()


def with_codes(df: DataFrame, text: str, out: str) -> DataFrame:
    """df with out: BINS low-order bytes as array<tinyint>; null if the text has no words."""
    t = lambda n: f"_{out}_{n}"
    c = lambda n: F.col(t(n))
    df = df.withColumn(t("w"), words_of(F.col(text)))
    df = df.withColumn(t("h"), F.transform(c("w"), lambda w: F.xxhash64(w)))
    rolled = F.transform(c("h"), lambda x, i: F.shiftrightunsigned(F.xxhash64(x, *[F.get(c("h"), i + k) for k in range(1, SHINGLE_WORDS)]), 1))
    few = F.array(F.shiftrightunsigned(F.xxhash64(c("h")), 1))
    df = df.withColumn(t("s"), F.when(F.size(c("h")) >= SHINGLE_WORDS, F.slice(rolled, F.lit(1), F.size(c("h")) - (SHINGLE_WORDS - 1))).when(F.size(c("h")) > 0, few))
    ends = _table([(b << _SHIFT) | _EMPTY for b in range(BINS)])
    df = df.withColumn(t("o"), F.sort_array(F.concat(c("s"), ends)))
    lead = F.filter(c("o"), lambda x, i: (i == 0) | (F.shiftright(x, _SHIFT) != F.shiftright(F.get(c("o"), i - 1), _SHIFT)))
    df = df.withColumn(t("d"), F.transform(lead, lambda x: F.when(x.bitwiseAND(F.lit(_EMPTY)) != _EMPTY, x.bitwiseAND(F.lit(255)).cast("int"))))
    probes, turns = _probe_tables()
    full = F.filter(F.transform(c("d"), lambda d, i: F.when(d.isNotNull(), F.struct(i.alias("i"), d.alias("d")))), lambda e: e.isNotNull())
    df = df.withColumn(t("f"), full)
    first = lambda j: F.array_min(F.transform(c("f"), lambda e: F.struct(((e["i"].bitwiseXOR(F.get(_table(turns), j)) * 181) % BINS).alias("r"), e["d"].alias("d"))))["d"]
    fill = lambda d, j: F.coalesce(d, *[F.get(c("d"), F.get(_table(p), j)) for p in probes], first(j))
    signed = lambda v: F.when(v > 127, v - 256).otherwise(v).cast("tinyint")
    df = df.withColumn(out, F.when(F.size(c("f")) > 0, F.transform(c("d"), lambda d, j: signed(fill(d, j)))))
    return df.drop(*[t(n) for n in "whsodf"])


def packed(codes: Column) -> Column:
    """Fingerprint string: two hex digits a bin; empty for a text without words."""
    digits = _table([f"{b:02x}" for b in range(BINS)])
    return F.coalesce(F.array_join(F.transform(codes, lambda b: F.get(digits, F.pmod(b.cast("int"), F.lit(256)))), ""), F.lit(""))


def likeness(a: Column, b: Column) -> Column:
    """Similarity of two code arrays, 0 to 1, corrected for low-order bits that agree by chance."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x))
    chance = 1 / 256
    found = F.greatest(F.lit(0.0), (same / F.lit(float(BINS)) - chance) / (1 - chance))
    return F.when(a.isNull() & b.isNull(), 1.0).when(a.isNull() | b.isNull(), 0.0).otherwise(found)


def _bucketed(docs: DataFrame) -> tuple[DataFrame, int]:
    """docs with bucket: higher buckets hold higher ids, equal ids share one, null ids are in bucket -1."""
    rows = docs.count()
    n = max(1, min(MOST_BUCKETS, rows // BUCKET_ROWS))
    cuts = sorted({int(x) for x in docs.select(F.col("doc_id").cast("double").alias("id")).approxQuantile("id", [i / n for i in range(1, n)], 0.2 / n)}) if n > 1 else []
    if not cuts:
        return docs.withColumn("bucket", F.when(F.col("doc_id").isNull(), -1).otherwise(0)), 1
    wide = math.isqrt(len(cuts)) + 1
    groups = [cuts[i : i + wide] for i in range(0, len(cuts), wide)]
    below = lambda cs: F.size(F.filter(cs, lambda x: x <= F.col("doc_id")))
    coarse = below(_table([g[-1] for g in groups]))
    tables = F.array(*[_table(g) for g in groups])
    bucket = coarse * wide + F.when(coarse < len(groups), below(F.get(tables.cast("array<array<long>>"), coarse))).otherwise(0)
    return docs.withColumn("bucket", F.when(F.col("doc_id").isNull(), -1).otherwise(bucket)), len(cuts) + 1


def with_next(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with codes, next_text and next_codes of the next document by descending id, the first after the last."""
    docs, _ = _bucketed(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    tops = docs.groupBy("bucket").agg(F.max("doc_id").alias("top"))  # one row a bucket
    first = docs.join(F.broadcast(tops.withColumnRenamed("bucket", "b")), (F.col("bucket") == F.col("b")) & F.col("doc_id").eqNullSafe(F.col("top")))
    heads = first.groupBy("bucket").agg(F.min("text").alias("text"))
    down = Window.orderBy(F.col("bucket").desc())
    heads = with_codes(heads, "text", "codes").select("bucket", F.struct("text", "codes").alias("head"))
    following = F.coalesce(F.lead("head").over(down), F.first("head").over(down))
    heads = heads.select(F.col("bucket").alias("after"), following.alias("head"))
    within = Window.partitionBy("bucket").orderBy(F.col("doc_id").desc_nulls_last(), F.col("text"))
    df = with_codes(docs, "text", "codes")
    df = df.withColumn("following", F.lead(F.struct("text", "codes")).over(within))
    df = df.join(heads, (F.col("bucket") == F.col("after")) & F.col("following").isNull(), "left")
    df = df.withColumn("following", F.coalesce("following", "head"))
    return df.select("doc_id", "text", "codes", F.col("following.text").alias("next_text"), F.col("following.codes").alias("next_codes"))


def report(docs: DataFrame) -> DataFrame:
    """Fingerprints of every document and its edited text, and their likenesses."""
    df = with_next(docs)
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("next_text", F.lit(1), half))
    df = df.withColumn("edited", edited)
    df = df.withColumn("edited_sha256", F.sha2("edited", 256)).withColumn("n_chars", F.length("text").cast("long")).drop("text", "next_text")
    df = with_codes(df, "edited", "edited_codes")
    return df.select("doc_id", "n_chars", "edited_sha256", packed(F.col("codes")).alias("fingerprint"), packed(F.col("edited_codes")).alias("edited_fingerprint"), likeness(F.col("codes"), F.col("edited_codes")).alias("near_edited"), likeness(F.col("codes"), F.col("next_codes")).alias("near_next"))
