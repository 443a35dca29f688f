"""Line dedup over levelled sorted runs of line hashes.

A run is a written table of entries (h1, h2, docs, first, top), one for each key, bucketed by hash and sorted within
each bucket, so that a join with it needs no shuffle of the run. Documents come in batches, the largest doc_id
first. A batch's keys are counted (partly before the shuffle, so a line that most documents hold is one entry a task), then they
merge-anti-join the runs: a key that no run knows is first held here, and `top` is its largest doc_id; a key that a run
knows only adds its count. The entries become a run of level 0; FANOUT runs of a level are compacted into one of the
next, so a key is rewritten once a level. A key is known by two independent 64-bit hashes of its bytes.

After the last batch all runs merge to the common keys. Occurrences meet them by hash: the few keys that hold over
1 / HOT_SHARE of all occurrences are broadcast (at most HOT_SHARE rows), the others are shuffled. Texts move once, to their doc_id.

Defined cases: null text is empty; an empty text is one empty line. Rows of one doc_id are one document when documents are counted, and
each row gets its own result. A null doc_id is one document too, below all others. Columns of documents beside doc_id
and text are never read by `report` and pass through `deduplicated` unchanged, whatever their names.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import boxed, materialize, shared_dir

BLANK_BYTES = " \t\n\x0b\x0c\r"
#: Keys of at least so many code points, in at least so many documents, lose their lines.
LEAST_CHARS, LEAST_DOCS = 20, 3
#: Batches that a table is taken in, and runs of a level that are compacted into one.
BATCHES, FANOUT = 4, 2
HOT_SHARE = 4096
ENTRY = "h1 long, h2 long, docs long, first boolean, top long"


def line_key(line: str) -> bytes:
    """The line without blanks at its ends, A-Z lower-cased, as UTF-8; empty where it is too short to count."""
    line = line.strip(BLANK_BYTES)
    return line.encode("utf-8", "surrogatepass").lower() if len(line) >= LEAST_CHARS else b""


def _digests(lines: list[str]) -> list[bytes]:
    """16 bytes for each line, empty for lines that don't count."""
    return [xxhash.xxh3_128_digest(k) if (k := line_key(x)) else b"" for x in lines]


def _halves(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), dtype=">i8").astype(np.int64).reshape(-1, 2)


def keys(docs: DataFrame, beside: str) -> DataFrame:
    """docs (doc_id, text, an int column beside) -> doc_id, beside, h1, h2: the distinct keys of each text."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, counts = [], []
            for text in batch.column(1):
                own = set(_digests((text.as_py() or "").split("\n"))) - {b""}
                counts.append(len(own))
                found += own
            h, at = _halves(found), pa.array(np.repeat(np.arange(len(counts)), counts))
            yield pa.record_batch([batch.column(0).take(at), batch.column(2).take(at), pa.array(h[:, 0]), pa.array(h[:, 1])], ["doc_id", beside, "h1", "h2"])

    return docs.select("doc_id", "text", beside).mapInArrow(each, f"doc_id long, {beside} int, h1 long, h2 long")


@dataclass
class LineRuns:
    """Levelled sorted runs in the shared folder. runs: a list of (level, table)."""

    spark: SparkSession
    fanout: int = FANOUT
    buckets: int = 0
    runs: list[tuple[int, str]] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.buckets = self.buckets or int(self.spark.conf.get("spark.sql.shuffle.partitions"))

    def _write(self, entries: DataFrame, level: int) -> None:
        name = f"line_run_{uuid.uuid4().hex}"
        entries.write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", f"{shared_dir(self.spark)}/{name}").format("parquet").saveAsTable(name)
        self.runs.append((level, name))

    def entries(self) -> DataFrame:
        """One entry for each key of all runs: sorted runs merge in pairs, by full outer merge joins."""
        if not self.runs:
            return self.spark.createDataFrame([], ENTRY)
        out = self.spark.table(self.runs[0][1])
        for _, name in self.runs[1:]:
            other = self.spark.table(name).select("h1", "h2", *[F.col(c).alias(f"_{c}") for c in ("docs", "first", "top")])
            both = out.join(other.hint("merge"), ["h1", "h2"], "full")
            docs = F.coalesce("docs", F.lit(0)) + F.coalesce("_docs", F.lit(0))
            out = both.select("h1", "h2", docs.alias("docs"), (F.coalesce("first", F.lit(False)) | F.coalesce("_first", F.lit(False))).alias("first"), F.greatest("top", "_top").alias("top"))
        return out

    def add(self, batch: DataFrame) -> None:
        """batch (doc_id, h1, h2), all of its doc_ids below those added before: becomes a run, and full levels are compacted.

        The batch meets each run in hash order. Keys that no run has (the anti-join) are first held here; those that one has bring their count.
        """
        docs = F.count_distinct("doc_id") + F.max(F.col("doc_id").isNull().cast("long"))
        entries = batch.groupBy("h1", "h2").agg(docs.alias("docs"), F.max("doc_id").alias("top")).withColumn("first", F.lit(True))
        for _, name in self.runs:
            run = self.spark.table(name).select("h1", "h2", F.lit(True).alias("_known"))
            entries = entries.join(run.hint("merge"), ["h1", "h2"], "left").withColumn("first", F.col("first") & F.col("_known").isNull()).drop("_known")
        self._write(entries.select("h1", "h2", "docs", "first", F.when(F.col("first"), F.col("top")).alias("top")), 0)
        self._compact()

    def _compact(self) -> None:
        level = 0
        while sum(k == level for k, _ in self.runs) >= self.fanout:
            full = [r for r in self.runs if r[0] == level]
            merged = LineRuns(self.spark, self.fanout, self.buckets, full).entries()
            self.runs = [r for r in self.runs if r[0] != level]
            self._write(merged, level + 1)
            for _, name in full:
                self.spark.sql(f"drop table {name}")
            level += 1

    def drop(self) -> None:
        """Forgets the tables' names; their files stay in the shared folder."""
        for _, name in self.runs:
            self.spark.sql(f"drop table {name}")

    def common(self, least: int = LEAST_DOCS) -> DataFrame:
        """h1, h2, docs, top of keys that at least so many documents hold."""
        return self.entries().filter(F.col("docs") >= least).select("h1", "h2", "docs", "top")


def _batched(rows: DataFrame, batches: int) -> DataFrame:
    """rows with _batch, the largest doc_ids in batch 0, nulls in the last; the cut points are a few numbers."""
    cuts = rows.agg(F.percentile_approx("doc_id", [k / batches for k in range(1, batches)], 1000)).first()[0] if batches > 1 else None
    above = [F.when(F.col("doc_id") > c, 0).otherwise(1) for c in sorted(set(cuts or []))]
    return rows.withColumn("_batch", sum(above, F.lit(0)))


def verdicts(docs: DataFrame, batches: int = BATCHES, fanout: int = FANOUT, least: int = LEAST_DOCS) -> DataFrame:
    """docs (doc_id, text) -> doc_id, drops (array of struct h1, h2): the keys that a document loses; documents that lose none are left out."""
    spark = docs.sparkSession
    each = keys(_batched(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), batches), "_batch")
    each = materialize(each, "line-keys", "_batch")
    runs = LineRuns(spark, fanout)
    for b in range(batches):
        runs.add(each.filter(F.col("_batch") == b).select("doc_id", "h1", "h2"))
    common = materialize(runs.common(least), "line-common")
    runs.drop()
    share = each.count() / HOT_SHARE
    gone = ~F.col("doc_id").eqNullSafe(F.col("top"))
    hot, rest = common.filter(F.col("docs") > share), common.filter(F.col("docs") <= share)
    hits = each.join(F.broadcast(hot), ["h1", "h2"]).filter(gone).select("doc_id", "h1", "h2")
    cool = each.join(F.broadcast(hot.select("h1", "h2")), ["h1", "h2"], "left_anti")
    hits = hits.union(cool.join(rest.hint("shuffle_hash"), ["h1", "h2"]).filter(gone).select("doc_id", "h1", "h2"))
    return hits.groupBy("doc_id").agg(F.collect_set(F.struct("h1", "h2")).alias("drops"))


def _met(docs: DataFrame, **options) -> DataFrame:
    """docs as column doc, with text and what it loses."""
    lost = verdicts(docs, **options).select(F.col("doc_id").alias("_id"), "drops")
    rows = boxed(docs, _k=F.col("doc_id").cast("long"), text=F.col("text"))
    return rows.join(lost, F.col("_k").eqNullSafe(F.col("_id")), "left").select("doc", "_k", "text", "drops")


def _kept(text: str | None, drops: np.ndarray | None) -> tuple[list[str], int]:
    """The lines that stay, and how many there were."""
    lines = (text or "").split("\n")
    if drops is None:
        return lines, len(lines)
    flat = drops.astype(">i8").tobytes()
    lost = {flat[i : i + 16] for i in range(0, len(flat), 16)}
    return [x for x, d in zip(lines, _digests(lines), strict=True) if d not in lost], len(lines)


def _each_kept(batch: pa.RecordBatch) -> Iterator[tuple[list[str], int]]:
    drops = batch.column("drops")
    ends, pairs = drops.offsets.to_numpy(), drops.values
    h = np.stack([pairs.field(0).to_numpy(zero_copy_only=False), pairs.field(1).to_numpy(zero_copy_only=False)], 1) if len(pairs) else np.empty((0, 2), np.int64)
    for i, text in enumerate(batch.column("text")):
        yield _kept(text.as_py(), h[ends[i] : ends[i + 1]] if ends[i + 1] > ends[i] else None)


def deduplicated(docs: DataFrame, **options) -> DataFrame:
    """docs with the lines that it keeps as text."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array(["\n".join(lines) for lines, _ in _each_kept(batch)], pa.string())
            yield pa.record_batch([batch.column("doc"), texts], ["doc", "text"])

    met = _met(docs, **options)
    out = met.select("doc", "text", "drops").mapInArrow(each, met.select("doc", "text").schema)
    return out.withColumn("doc", F.col("doc").withField("text", F.col("text"))).select("doc.*")


def report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(n, n - len(lines), hashlib.sha256("\n".join(lines).encode()).hexdigest()) for lines, n in _each_kept(batch)]
            n, dropped, sha = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.record_batch([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(dropped, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    met = _met(docs.select("doc_id", "text"), **options).select(F.col("_k").alias("doc_id"), "text", "drops")
    return met.mapInArrow(each, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


REPORT_SQL = f"""
with lines as (
  select r, doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k
  from (select r, doc_id, unnest(parts) as line, generate_subscripts(parts, 1) as pos from (select row_number() over () as r, doc_id, string_split(coalesce(text, ''), chr(10)) as parts from documents))),
common as (select k, max(doc_id) as top from lines where length(k) >= {LEAST_CHARS} group by k having count(distinct doc_id) + cast(max(case when doc_id is null then 1 else 0 end) as bigint) >= {LEAST_DOCS}),
marked as (select l.*, c.k is not null and l.doc_id is distinct from c.top as gone from lines l left join common c on l.k = c.k)
select doc_id, count(*) as n_lines, cast(count(*) filter (gone) as bigint) as n_dropped, sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) as kept_sha256
from marked group by r, doc_id
"""
