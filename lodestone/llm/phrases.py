"""Phrase collocation mining by stripes.

A stripe is a prefix (of no, one or two words) with an associative counter of its next words. A task counts its texts in bounded
chunks and emits one stripe for each prefix of a chunk; stripes of a prefix meet by a shuffle on the prefix and are merged element by
element. The merged stripes, rows (lang, prefix, next, n), are the one structure that everything comes from: n of an element is the
count of an extension and the total of the prefix that it makes, the greatest element of a prefix decides subsumption, and the empty prefix's
stripe gives the words and their sum.

Lengths go up by one word. A phrase occurs no more often than its parts, so elements are emitted only where a bitmap of hashes admits both parts
as occurring often enough; a wrong admission costs room and changes nothing. Bitmaps have BITS_EACH bits an entry and at most MOST_BITS, beyond which they
admit more. A prefix with more than 1 / (HOT_SPLIT x shuffle partitions) of all occurrences is known exactly from the length before; these are at most
HOT_SPLIT x partitions many, and their stripes are dealt out by the hash of the next word. A chunk emits an element once, however often it
occurs, and merging is a hash aggregation that can spill.

Scores are exact: counts are decimals in products and the division is integral.

Defined cases: null text is empty, null lang is `und`. Texts without words, empty tables: no rows. Repeated rows count again. Languages are
compared as they are written. Other columns are never read. Ties of score and count go by phrase in UTF-8 byte order.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

LEAST, SUBSUMED_PERCENT, TOP = 10, 50, 2000
SCORE_UNIT = 1_000_000
UNDEFINED = "und"
#: Bytes of text that a task counts at a time.
CHUNK_BYTES = 8 << 20
#: A prefix is hot above this part of an even partition's share; its stripe is dealt to so many segments.
HOT_SPLIT, SEGMENTS = 4, 64
#: Bits of a bitmap for each of its entries, and in all (64 MB).
BITS_EACH, MOST_BITS = 16, 1 << 29
#: Bytes as the contract reads them: marks and line ends end a piece, tab is a space, A-Z is lower-cased.
_END = b".,;:!?\n\x0b\x0c\r"
_READ = bytes.maketrans(_END + b"\t" + bytes(range(65, 91)), b"\n" * len(_END) + b" " + bytes(range(97, 123)))
#: nexts: the next words on a line each, behind a tab their count where it is above 1.
STRIPE = "lang string, prefix string, segment int, nexts string"


class Words:
    """The words of a chunk of one language: distinct words, and all in order as numbers from 2, 0 at the end of each piece."""

    def __init__(self, lang: str, texts: list[bytes]) -> None:
        ids: defaultdict[bytes, int] = defaultdict(itertools.count().__next__)
        ids[b"\n"], ids[b""]  # 0 and 1
        tokens = b"\n".join(texts).translate(_READ).replace(b"\n", b" \n ").split(b" ")
        found = np.fromiter(map(ids.__getitem__, tokens), np.int64, len(tokens))
        self.lang, self.number = lang, dict(ids)
        self.ids = np.r_[found[found != 1], 0]
        self.words = list(ids)
        self.names = pa.array(self.words, pa.binary()).cast(pa.string())
        seed = xxhash.xxh3_64_intdigest(lang)
        self.hashes = np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in self.words), np.uint64, len(self.words))


def _pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * np.uint64(0x9E3779B97F4A7C15) + b
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _admits(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes & np.uint64(8 * len(bits) - 1)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _bitmap(entries: DataFrame, hashes: Callable) -> np.ndarray:
    """A bitmap of entries (lang, phrase), which must be written already; hashes(lang, phrases) gives their 64-bit hashes. At most MOST_BITS reach the driver."""
    wanted = max(1 << 16, BITS_EACH * entries.count())
    size = min(MOST_BITS, 1 << (wanted - 1).bit_length())

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_lang = defaultdict(list)
            for lang, phrase in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by_lang[lang].append(phrase)
            for lang, phrases in by_lang.items():
                yield pa.record_batch([pa.array((hashes(lang, phrases) & np.uint64(size - 1)).astype(np.int64))], ["at"])

    at = entries.select("lang", "phrase").mapInArrow(each, "at long")
    whole = F.col("at") + 1  # bit positions of bitmaps count from 1
    rows = at.groupBy(F.bitmap_bucket_number(whole).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(whole)).alias("b")).toLocalIterator()
    bits = np.zeros(size // 8, np.uint8)
    for r in rows:
        part = np.frombuffer(r["b"], np.uint8)
        start = (r["k"] - 1) * len(part)
        bits[start : start + len(part)] = part[: len(bits) - start]
    return bits


def _word_hashes(lang: str, words: list[str]) -> np.ndarray:
    seed = xxhash.xxh3_64_intdigest(lang)
    return np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in words), np.uint64, len(words))


def _pair_hashes(lang: str, pairs: list[str]) -> np.ndarray:
    halves = [p.split(" ") for p in pairs]
    return _pair_hash(_word_hashes(lang, [a for a, _ in halves]), _word_hashes(lang, [b for _, b in halves]))


def _stripes(lang: str, prefixes: np.ndarray, name: Callable, hot: np.ndarray, nexts: np.ndarray, counts: np.ndarray, w: Words) -> pa.RecordBatch:
    """Elements (prefix number, next word, count) as one row for each prefix, for each segment of a hot one. name: of prefix numbers."""
    segments = np.where(hot, (w.hashes[nexts] % np.uint64(SEGMENTS)).astype(np.int64) + 1, 0)
    order = np.lexsort((segments, prefixes))
    prefixes, segments, nexts, counts = prefixes[order], segments[order], nexts[order], counts[order]
    begins = np.flatnonzero(np.r_[True, (prefixes[1:] != prefixes[:-1]) | (segments[1:] != segments[:-1])]) if len(order) else np.empty(0, np.int64)
    each = w.names.take(pa.array(nexts))
    many = np.flatnonzero(counts > 1)
    if len(many):
        marked = pc.binary_join_element_wise(each.take(pa.array(many)), pa.array(counts[many]).cast(pa.string()), "\t")
        each = pc.replace_with_mask(each, pa.array(counts > 1), marked)
    lists = pa.ListArray.from_arrays(pa.array(np.r_[begins, len(order)].astype(np.int32)), each)
    return pa.record_batch([pa.array([lang] * len(begins), pa.string()), name(prefixes[begins]), pa.array(segments[begins].astype(np.int32)), pc.binary_join(lists, "\n")], ["lang", "prefix", "segment", "nexts"])


def _of_none(w: Words) -> pa.RecordBatch:
    """The empty prefix's stripe, dealt to segments: words and how often they occur."""
    counts = np.bincount(w.ids, minlength=len(w.words))
    counts[:2] = 0
    at = np.flatnonzero(counts)
    return _stripes(w.lang, np.zeros(len(at), np.int64), lambda p: pa.array([""] * len(p), pa.string()), np.ones(len(at), bool), at, counts[at], w)


def _of_words(bits: np.ndarray, hot: dict[str, list[str]]) -> Callable:
    """Stripes of single words, where the bitmap admits both words."""

    def count(w: Words) -> pa.RecordBatch:
        often = _admits(bits, w.hashes)
        often[0] = False
        at = np.flatnonzero(often[w.ids[:-1]] & often[w.ids[1:]])
        n = len(w.words)
        pairs, counts = np.unique(w.ids[at] * n + w.ids[at + 1], return_counts=True)
        split = np.isin(pairs // n, [w.number[x] for p in hot.get(w.lang, ()) if (x := p.encode()) in w.number])
        return _stripes(w.lang, pairs // n, lambda p: w.names.take(pa.array(p)), split, pairs % n, counts, w)

    return count


def _of_pairs(bits: np.ndarray, hot: dict[str, list[str]]) -> Callable:
    """Stripes of two words, where the bitmap admits both pairs of the three."""

    def count(w: Words) -> pa.RecordBatch:
        n = len(w.words)
        two = np.flatnonzero((w.ids[:-1] > 0) & (w.ids[1:] > 0))
        pairs, which = np.unique(w.ids[two] * n + w.ids[two + 1], return_inverse=True)
        often = np.r_[_admits(bits, _pair_hash(w.hashes[pairs // n], w.hashes[pairs % n])), False]
        at = np.full(len(w.ids), len(pairs), np.int64)  # no pair
        at[two] = which
        three = np.flatnonzero(often[at[:-1]] & often[at[1:]])
        triples, counts = np.unique(at[three] * n + w.ids[three + 2], return_counts=True)
        own = pairs[triples // n]
        known = ([w.number.get(x.encode(), -1) for x in p.split(" ")] for p in hot.get(w.lang, ()))
        split = np.isin(own, [a * n + b for a, b in known if a >= 0 and b >= 0])
        name = lambda p: pc.binary_join_element_wise(w.names.take(pa.array(p // n)), w.names.take(pa.array(p % n)), " ")
        return _stripes(w.lang, own, name, split, triples % n, counts, w)

    return count


def _counted(docs: DataFrame, count: Callable) -> DataFrame:
    """The stripes that count makes of each chunk's Words of docs (lang, text)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: defaultdict[str, list[bytes]] = defaultdict(list)
        size = 0
        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1), strict=True):
                raw = (text.as_py() or "").encode()
                held[lang.as_py()].append(raw)
                size += len(raw) + 1
                if size >= CHUNK_BYTES:
                    for k in list(held):
                        yield count(Words(k, held.pop(k)))
                    size = 0
        for k in list(held):
            yield count(Words(k, held.pop(k)))

    return docs.mapInArrow(each, STRIPE)


def _merged(stripes: DataFrame, least: int) -> DataFrame:
    """lang, prefix, next, n: stripes of a prefix (of a segment of it) meet in one task and are added up element by element; those of least or more."""
    parts = int(stripes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    each = stripes.repartition(parts, "lang", "prefix", "segment").select("lang", "prefix", "segment", F.explode(F.split("nexts", "\n")).alias("e"))
    each = each.select("lang", "prefix", "segment", F.substring_index("e", "\t", 1).alias("next"), F.when(F.contains(F.col("e"), F.lit("\t")), F.substring_index("e", "\t", -1).cast("long")).otherwise(F.lit(1).cast("long")).alias("n"))
    return each.groupBy("lang", "prefix", "segment", "next").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).select("lang", "prefix", "next", "n")


def _hot(elements: DataFrame, phrase: Column, all_: int) -> dict[str, list[str]]:
    """Phrases of more than their share of all occurrences, by language: at most HOT_SPLIT x partitions in all."""
    parts = int(elements.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out: defaultdict[str, list[str]] = defaultdict(list)
    for r in elements.filter(F.col("n") > all_ / (HOT_SPLIT * parts)).select("lang", phrase.alias("p")).collect():
        out[r["lang"]].append(r["p"])
    return dict(out)


def merged_stripes(docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame, DataFrame]:
    """docs (lang, text) -> merged stripes (lang, prefix, next, n) of the empty prefix, whole, and of one and two words, elements of least or more."""
    context = docs.sparkSession.sparkContext
    docs = docs.select(F.coalesce("lang", F.lit(UNDEFINED)).alias("lang"), "text")
    none = materialize(_merged(_counted(docs, _of_none), 1), "stripes-0")
    all_ = none.agg(F.sum("n")).first()[0] or 0
    bits = _bitmap(none.filter(F.col("n") >= least).select("lang", F.col("next").alias("phrase")), _word_hashes)
    bits = context.broadcast(bits)
    hot = _hot(none, F.col("next"), all_)
    one = materialize(_merged(_counted(docs, lambda w: _of_words(bits.value, hot)(w)), least), "stripes-1")
    pair = F.concat_ws(" ", "prefix", "next")
    pair_bits = context.broadcast(_bitmap(one.select("lang", pair.alias("phrase")), _pair_hashes))
    hot_pairs = _hot(one, pair, all_)
    two = materialize(_merged(_counted(docs, lambda w: _of_pairs(pair_bits.value, hot_pairs)(w)), least), "stripes-2")
    return none, one, two


def _score(a: Column, left: Column, right: Column) -> Column:
    a, left, right = (x.cast("decimal(16,0)") for x in (a, left, right))
    return F.call_function("div", a * a * F.lit(SCORE_UNIT).cast("decimal(7,0)"), left * right)


def mined(docs: DataFrame, least: int = LEAST, percent: int = SUBSUMED_PERCENT, top: int = TOP) -> DataFrame:
    """docs (lang, text) -> lang, rank, phrase, a, l, r, n, score: each language's best phrases of two and three words."""
    none, once, twice = merged_stripes(docs, least)
    tokens = none.groupBy("lang").agg(F.sum("n").alias("n"))
    f1 = none.filter(F.col("n") >= least).select("lang", F.col("next").alias("word"), "n")
    f2 = once.select("lang", F.col("prefix").alias("w1"), F.col("next").alias("w2"), F.col("n").alias("a"))
    f3 = twice.select("lang", F.substring_index("prefix", " ", 1).alias("w1"), F.substring_index("prefix", " ", -1).alias("w2"), F.col("next").alias("w3"), F.col("n").alias("a"))
    one = lambda as_, n: f1.select("lang", F.col("word").alias(as_), F.col("n").alias(n))
    two = lambda x, y, n: f2.select("lang", F.col("w1").alias(x), F.col("w2").alias(y), F.col("a").alias(n))
    # the greatest extension on either side of a pair, from its stripe's elements
    over = f3.select("lang", "w1", "w2", "a").union(f3.select("lang", "w2", "w3", "a")).groupBy("lang", "w1", "w2").agg(F.max("a").alias("longest"))
    pairs = f2.join(over, ["lang", "w1", "w2"], "left").filter(F.coalesce(100 * F.col("longest") < percent * F.col("a"), F.lit(True)))
    pairs = pairs.join(one("w1", "l"), ["lang", "w1"]).join(one("w2", "r"), ["lang", "w2"])
    pairs = pairs.select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", "l", "r", _score(F.col("a"), F.col("l"), F.col("r")).alias("score"))
    triples = f3.join(one("w1", "l1"), ["lang", "w1"]).join(two("w2", "w3", "r1"), ["lang", "w2", "w3"]).join(two("w1", "w2", "l2"), ["lang", "w1", "w2"]).join(one("w3", "r2"), ["lang", "w3"])
    cuts = triples.withColumns({"s1": _score(F.col("a"), F.col("l1"), F.col("r1")), "s2": _score(F.col("a"), F.col("l2"), F.col("r2"))})
    head = F.col("s1") <= F.col("s2")
    triples = cuts.select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a", F.when(head, F.col("l1")).otherwise(F.col("l2")).alias("l"), F.when(head, F.col("r1")).otherwise(F.col("r2")).alias("r"), F.least("s1", "s2").alias("score"))
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    best = pairs.union(triples).withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top)
    return best.join(tokens, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


REPORT_SQL = f"""
with docs as (select row_number() over () as d, coalesce(lang, '{UNDEFINED}') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
pieces as (select lang, unnest(regexp_split_to_array(t, '[.,;:!?\\x0A-\\x0D]')) as p from docs),
worded as (select lang, regexp_extract_all(p, '[^\\x20\\x09]+') as w from pieces),
grams as (
  select lang, 1 as k, unnest(w) as phrase from worded
  union all select lang, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) from worded
  union all select lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) from worded),
f as materialized (select lang, k, phrase, count(*) as a from grams group by lang, k, phrase),
totals as (select lang, cast(sum(a) as bigint) as n from f where k = 1 group by lang),
cands as materialized (select lang, k, phrase, a, string_split(phrase, ' ') as w from f where k >= 2 and a >= {LEAST}),
halves as materialized (select lang, phrase, a, i, array_to_string(w[1 : i], ' ') as head, array_to_string(w[i + 1 :], ' ') as tail from (select *, unnest(range(1, k)) as i from cands)),
cuts as (
  select c.lang, c.phrase, c.a, c.i, l.a as l, r.a as r, cast(({SCORE_UNIT}::hugeint * c.a * c.a) // (l.a::hugeint * r.a) as bigint) as score
  from halves c join f l on l.lang = c.lang and l.phrase = c.head join f r on r.lang = c.lang and r.phrase = c.tail),
least as (select * from cuts qualify row_number() over (partition by lang, phrase order by score, i) = 1),
over as (select lang, p, max(a) as longest from (select lang, w[1] || ' ' || w[2] as p, a from cands where k = 3 union all select lang, w[2] || ' ' || w[3], a from cands where k = 3) group by lang, p),
kept as (select s.* from least s left join over o on o.lang = s.lang and o.p = s.phrase where o.p is null or 100 * o.longest < {SUBSUMED_PERCENT} * s.a),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept)
select k.lang, k.rank, k.phrase, k.a, k.l, k.r, t.n, k.score from ranked k join totals t on t.lang = k.lang where k.rank <= {TOP}
"""
