"""Removal of repeated byte strings by suffix arrays over the places where texts may repeat.

A string of WINDOW bytes that starts at two places has its anchor (see anchors) at the same offset in both. So the corpus is
cut into segments, one per anchor: the bytes of all windows that chose it. Segments whose gram occurs once hold no repeat.
Segments that are equal repeat in all their windows; a gram that only equal segments have is settled by that. What is left are
different segments with the same gram, as at the edge of an edited passage: of each, one copy is taken (with how many there are),
and a task builds a suffix array over many of them by linear grouping (see suffixes).
Its text has, per segment, the bytes left of the anchor and one symbol for the rank of what follows from the anchor on. Windows that share
their left bytes are neighbours in the array; they are equal as far as the least common prefix of the ranked rights between them reaches.

A gram with more than HOT_KINDS different segments does not fit one array. Its windows are sorted by a digest of 128 bits of each
window's bytes, in Spark, which tells in any number of tasks which of them occur in two segments.

Segments are told apart by two independent hashes of 64 bits, of the gram and of all the segment's bytes: of 10^12 different
segments the chance that any two agree is below 10^-14 (10^-8 where a million share their gram). What a suffix array decides
is compared byte for byte. Matches never cross documents; all is judged on the input.

A place is one long: a tag of 16 bits of its text's hash, the anchor's byte, and how far the first and last window begin before it.
Rows are told apart by a hash of id and text and by that tag (80 bits).

Defined cases: null text is empty; texts under WINDOW bytes keep all; overlaps within a document count; rows that repeat
repeat each other; null ids stay. Extra columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .anchors import WINDOW, Rolling, anchors
from .common import joined_small, materialize
from .suffixes import common_prefixes, suffix_array

#: Bytes of segments that one suffix array takes, so far as whole groups of a gram allow.
ARRAY_BYTES = 400_000
#: Different segments of one gram that one suffix array may hold.
HOT_KINDS = 4_000
#: Segments of hot grams that are broadcast to the texts; beyond, the texts are shuffled to them.
BROADCAST_SEGMENTS = 200_000


def _tag(raw: bytes) -> int:
    return xxhash.xxh3_64_intdigest(raw) & 0xFFFF


def _placed(tag: int, place: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    return tag << 47 | place << 16 | (place - first) << 8 | (place - last)


def first_of(place: Column) -> Column:
    """First window of the segment at a place."""
    return (F.shiftright(place, 16).bitwiseAND(0x7FFFFFFF) - F.shiftright(place, 8).bitwiseAND(0xFF)).cast("long")


def span_of(place: Column, lo: Column, n: Column) -> Column:
    """n windows from the lo-th of the segment at a place on, as one long: tag, first window, n - 1."""
    return F.shiftleft(F.shiftright(place, 47), 47) + F.shiftleft(first_of(place) + lo, 8) + n - 1


def windows_of(place: Column) -> Column:
    return F.shiftright(place, 8).bitwiseAND(0xFF) - place.bitwiseAND(0xFF) + 1


def segments(docs: DataFrame) -> DataFrame:
    """docs (row, text) -> row, gram, seg (hash of the segment's bytes and the anchor's offset), place per anchor."""
    schema = "row long, gram long, seg long, place long"
    names = T._parse_datatype_string(schema).names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for row, text in zip(batch.column("row").to_pylist(), batch.column("text"), strict=True):
                raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
                at, first, last, gram = anchors(Rolling(np.frombuffer(raw, np.uint8)))
                if len(at):
                    digest = xxhash.xxh3_64_intdigest
                    seg = np.array([digest(raw[a:b], k) for a, b, k in zip(first.tolist(), (last + WINDOW).tolist(), (at - first).tolist(), strict=True)], np.uint64)
                    parts.append((np.full(len(at), row), gram.view(np.int64), seg.view(np.int64), _placed(_tag(raw), at, first, last)))
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts, strict=True)], names=names)

    return docs.select("row", "text").mapInArrow(run, schema)


def _range_min(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Least of values[lo:hi] for each pair, lo < hi, by a table of powers of two."""
    table = [values]
    while 2 << (len(table) - 1) <= len(values):
        step = 1 << (len(table) - 1)
        table.append(np.minimum(table[-1][:-step], table[-1][step:]))
    level = np.frexp((hi - lo).astype(float))[1] - 1
    out = np.empty(len(lo), values.dtype)
    for k in np.unique(level):
        m = level == k
        out[m] = np.minimum(table[k][lo[m]], table[k][hi[m] - (1 << int(k))])
    return out


def repeated_windows(lefts: list[bytes], rights: list[bytes], windows: list[int], window: int = WINDOW) -> list[np.ndarray]:
    """For segments, given as bytes before and from their anchor on and their number of windows: which windows occur in another.

    Window w of a segment starts at byte w of its left bytes.
    """
    order = sorted(range(len(rights)), key=rights.__getitem__)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    shared = np.zeros(len(order), np.int64)  # shared[r]: bytes that rights of rank r - 1 and r have in common
    for r in range(1, len(order)):
        a, b = rights[order[r - 1]], rights[order[r]]
        n = min(len(a), len(b))
        apart = np.flatnonzero(np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n))
        shared[r] = apart[0] if len(apart) else n
    lengths = np.array([len(x) for x in lefts])
    ends = np.cumsum(lengths + 1) - 1  # where each segment's rank symbol stands
    text = np.empty(int(ends[-1]) + 1, np.int64)
    inside = np.ones(len(text), bool)
    inside[ends] = False
    text[inside] = np.frombuffer(b"".join(lefts), np.uint8)
    text[ends] = 256 + rank
    segment = np.searchsorted(ends, np.arange(len(text)))
    suffixes = suffix_array(text)
    common = common_prefixes(text, suffixes)
    left = ends[segment] - np.arange(len(text))  # bytes before the anchor from each place on
    is_window = np.arange(len(text)) - (ends[segment] - lengths[segment]) < np.array(windows)[segment]
    a, b = suffixes[:-1], suffixes[1:]
    same = (left[a] == left[b]) & (common[1:] >= left[a])
    a, b = a[same], b[same]
    lo, hi = rank[segment[a]], rank[segment[b]]
    reach = np.full(len(a), window)
    differ = lo < hi
    reach[differ] = _range_min(shared, lo[differ] + 1, hi[differ] + 1)
    equal = left[a] + reach >= window
    found = np.zeros(len(text), bool)
    found[a[equal]] = found[b[equal]] = True
    found &= is_window
    begins = ends - lengths
    return [found[s : s + w] for s, w in zip(begins, windows, strict=True)]


def _runs(marks: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.r_[0, marks.astype(np.int8), 0]))
    return list(zip(edges[::2].tolist(), (edges[1::2] - 1).tolist(), strict=True))


def resolve(group: pd.DataFrame) -> pd.DataFrame:
    """Segments (gram, seg, left, right, windows) of whole grams -> gram, seg, lo, hi: runs of windows that another segment has too."""
    group = group.sort_values("gram", kind="stable")
    sizes = group["left"].str.len().to_numpy() + 1
    gram = group["gram"].to_numpy()
    out: list[tuple[int, int, int, int]] = []
    begin, held = 0, 0
    for i in range(len(group) + 1):
        full = i < len(group) and held >= ARRAY_BYTES and gram[i] != gram[i - 1]
        if i == len(group) or full:
            part = group.iloc[begin:i]
            if len(part):
                for g, s, marks in zip(part["gram"], part["seg"], repeated_windows(part["left"].tolist(), part["right"].tolist(), part["windows"].tolist()), strict=True):
                    out += [(g, s, lo, hi) for lo, hi in _runs(marks)]
            begin, held = i, 0
        if i < len(group):
            held += sizes[i]
    return pd.DataFrame(out, columns=["gram", "seg", "lo", "hi"])


def _needed(n: dict) -> tuple[int, int, int]:
    """(first window, anchor, last window) of an asked segment."""
    at = n["place"] >> 16 & 0x7FFFFFFF
    return at - (n["place"] >> 8 & 0xFF), at, at - (n["place"] & 0xFF)


def _asked(raw: bytes, need: list[dict]) -> Iterator[tuple[dict, int, int, int]]:
    tag = _tag(raw)
    return ((n, *_needed(n)) for n in need if n["place"] >> 47 == tag)


def _cut_out(joined: DataFrame) -> DataFrame:
    """joined (text, need: list of (gram, seg, place)) -> gram, seg, left, right, windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            rows = []
            for text, need in zip(frame["text"], frame["need"], strict=True):
                raw = (text or "").encode("utf-8", "surrogatepass")
                rows += [(n["gram"], n["seg"], raw[first:at], raw[at : last + WINDOW], last - first + 1) for n, first, at, last in _asked(raw, need)]
            yield pd.DataFrame(rows, columns=["gram", "seg", "left", "right", "windows"])

    return joined.select("text", "need").mapInPandas(run, "gram long, seg long, left binary, right binary, windows int")


def _digests(joined: DataFrame) -> DataFrame:
    """joined (row, text, need) -> row, place, at, a, b: the digest of the at-th window of every asked segment."""
    names = ["row", "place", "at", "a", "b"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text, need in zip(batch.column("row").to_pylist(), batch.column("text"), batch.column("need").to_pylist(), strict=True):
                raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
                found = []
                for n, first, _, last in _asked(raw, need):
                    for w in range(first, last + 1):
                        digest = xxhash.xxh3_128_digest(raw[w : w + WINDOW])
                        found.append((row, n["place"], w - first, int.from_bytes(digest[:8], "big", signed=True), int.from_bytes(digest[8:], "big", signed=True)))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=names)

    return joined.select("row", "text", "need").mapInArrow(run, "row long, place long, at long, a long, b long")


def _by_row(segments_: DataFrame) -> DataFrame:
    return segments_.groupBy("row").agg(F.collect_list(F.struct("gram", "seg", "place")).alias("need"))


def repeat_spans(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs (doc_id, text) -> (documents with row, spread by row; row with ranges: spans (see span_of) of repeated windows)."""
    spark = docs.sparkSession
    docs = docs.select(F.xxhash64("doc_id", "text").alias("row"), "doc_id", "text")
    all_ = segments(docs)  # made twice: that costs less than keeping them
    grams = all_.groupBy("gram").agg(F.count(F.lit(1)).alias("n"), F.min("seg").alias("lo"), F.max("seg").alias("hi"))
    grams = materialize(grams.filter("n > 1").select("gram", (F.col("lo") != F.col("hi")).alias("many")), "grams")  # written, so that the join may split a hot gram
    live = all_.join(grams, "gram").select("row", "place", F.when(F.col("many"), F.col("gram")).alias("gram"), F.when(F.col("many"), F.col("seg")).alias("seg"))
    live = materialize(live, "live")  # segments whose gram occurs again; gram and seg where different segments share it
    sure = live.filter("gram is null").select("row", "place")
    many = live.filter("gram is not null")
    counted = many.groupBy("gram", "seg").agg(F.count(F.lit(1)).alias("n"), F.first("row").alias("row"), F.first("place").alias("place"))
    counted = materialize(counted, "kinds")  # one copy of each, chosen for good
    hot = materialize(counted.groupBy("gram").agg(F.count(F.lit(1)).alias("kinds")).filter(F.col("kinds") > HOT_KINDS).select("gram"), "hot-grams")
    is_hot = hot.count() > 0
    cool = joined_small(counted, hot, ["gram"], "left_anti") if is_hot else counted
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    spread = docs.repartition(parts, "row")  # the texts move once: both joins use this exchange
    groups = max(parts, cool.count() // HOT_KINDS)
    cut = _cut_out(spread.select("row", "text").join(_by_row(cool), "row")).withColumn("g", F.pmod(F.xxhash64("gram"), F.lit(groups)))
    runs = cut.groupBy("g").applyInPandas(resolve, "gram long, seg long, lo int, hi int")
    single = counted.filter("n = 1").select("gram", "seg", "row", "place")
    whole = lambda df: df.select("row", span_of(F.col("place"), F.lit(0), windows_of(F.col("place"))).alias("span"))
    again = many.join(counted.filter("n > 1").select("gram", "seg"), ["gram", "seg"])
    edge = single.join(runs, ["gram", "seg"]).select("row", span_of(F.col("place"), F.col("lo"), F.col("hi") - F.col("lo") + 1).alias("span"))
    spans = whole(sure).unionByName(whole(again)).unionByName(edge)
    if is_hot:
        hot_segments = materialize(joined_small(counted, hot, ["gram"], "left_semi"), "hot-segments")
        asked = _by_row(hot_segments)  # 24 bytes a segment: broadcast while they are few, whatever rows they are in
        asked = F.broadcast(asked) if hot_segments.count() <= BROADCAST_SEGMENTS else asked
        digests = materialize(_digests(docs.select("row", "text").join(asked, "row")), "windows")
        twice = materialize(digests.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("a", "b"), "repeated-windows")
        spans = spans.unionByName(digests.join(twice, ["a", "b"]).select("row", span_of(F.col("place"), F.col("at"), F.lit(1)).alias("span")))
    return spread, spans.groupBy("row").agg(F.collect_list("span").alias("ranges"))


def _merged(raw: bytes, spans: list[int] | None) -> list[list[int]]:
    """Byte ranges that the spans of a text cover, joined where they touch."""
    out: list[list[int]] = []
    tag = _tag(raw)
    for s in sorted(s for s in spans or () if s >> 47 == tag):
        a = s >> 8 & 0x7FFFFFFF
        b = a + (s & 0xFF) + WINDOW
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    spread, ranges = repeat_spans(docs)
    schema = T.StructType([docs.schema["doc_id"], *[T.StructField(n, T.LongType()) for n in ("n_bytes", "n_removed", "n_spans")], T.StructField("kept_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, found in zip(batch.column("text"), batch.column("ranges"), strict=True):
                raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
                spans, digest, at = _merged(raw, found.as_py()), hashlib.sha256(), 0
                for a, b in spans:
                    digest.update(raw[at:a])
                    at = b
                digest.update(raw[at:])
                rows.append((len(raw), sum(b - a for a, b in spans), len(spans), digest.hexdigest()))
            columns = list(map(list, zip(*rows, strict=True))) if rows else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())], names=schema.names)

    return spread.join(ranges, "row", "left").select("doc_id", "text", "ranges").mapInArrow(run, schema)
