"""Mixing sources to target weights through a multivariate-hypergeometric splitting tree.

Targets: each source's share of the mix by weight, stopped at MOST_REPEATS times its own size, the excess reshared.
Each source's documents are laid on a line in keyed-hash order (a random permutation), measured in words, and the line
is cut into blocks of equal words. A source whose target is above its size gives every block once and then the first
blocks of the line again until its target is met to the word; the last block of a draw may be partial. So each source
has an exact quota of blocks.

The quotas are split among output shards by a tree: a node holds a quota per source and a number of shards; its left
child gets a multivariate-hypergeometric draw of as many blocks as its shards take, the right child the rest. One task splits
a node FAN_LEVELS levels down, then its leaves are split by tasks of their own. At the leaves each shard has an
exact count of blocks of every source. The blocks of a source are numbered by a keyed permutation (a Feistel network), a shard takes
a range of numbers, so draws are disjoint, and within a shard blocks are ordered by a keyed hash: the local shuffle.

Everything follows from the seed and the rows: reruns agree. Lines of large sources are built in salted parts (a
part's offset from sums over parts), so no task holds a source. Sources are numbered by a sort in ranges, and the level of
the targets comes from sums over the table of sources, so neither asks how many there are; only the root of the tree
holds one number for each source in a task.

Defined cases: null or blank texts have size 0 and are not taken. A null source is a source of its own, last in order. Rows that repeat
stand on the line each; null ids are ids. Extra columns are not read by plan_mix() and pass through mixed(). An empty table gives an empty mix.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import boxed, joined_small, materialize, unboxed, word_count


@dataclass(frozen=True)
class MixConfig:
    """Production parameters: weights repeat over the sources in order; share is the mix's size over all sizes."""

    weights: tuple[int, ...] = (5, 2, 1)
    share: float = 1.5
    most_repeats: int = 2
    block_words: int = 2048
    shard_blocks: int = 1024
    part_rows: int = 4_000
    seed: int = 17


#: Tables with a row a source are broadcast up to so many rows, and shuffled beyond.
BROADCAST_SOURCES = 100_000
FAN_LEVELS = 6
#: The generator's own draws stop at this population; larger ones come from draws source by source.
LARGE_POPULATION = 10**9


def numbered(sizes: DataFrame) -> DataFrame:
    """sizes (source, ...) with nth: its place from 0 in order of sources by code point, null last."""
    parts = int(sizes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = F.col("source").asc_nulls_last()
    ranges = materialize(sizes.repartitionByRange(parts, order).withColumn("range", F.spark_partition_id()), "ranges")
    own = ranges.withColumn("own", F.row_number().over(Window.partitionBy("range").orderBy(order)) - 1)
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    bases = ranges.groupBy("range").agg(F.count(F.lit(1)).alias("n")).select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))  # one row a range
    return own.join(F.broadcast(bases), "range").withColumn("nth", (F.col("base") + F.col("own")).cast("long")).drop("range", "base", "own")


def source_targets(sizes: DataFrame, config: MixConfig) -> DataFrame:
    """sizes (source, n_docs, source_size) -> with weight and target.

    The level that open sources share rises as others reach their limit; it is found by sums over the table, a few times.
    """
    weights = F.array(*[F.lit(w) for w in config.weights])
    df = numbered(sizes).withColumn("weight", F.get(weights, (F.col("nth") % len(config.weights)).cast("int")))
    df = materialize(df.withColumn("most", F.col("source_size") * config.most_repeats), "weighted")
    total = (df.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]) * config.share
    level, reached = 0.0, -1
    while True:
        full = F.col("most") <= F.col("weight") * level
        n, most, open_weight = df.agg(F.count_if(full), F.coalesce(F.sum(F.when(full, F.col("most"))), F.lit(0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0))).first()
        if n == reached or not open_weight:
            break
        level, reached = (total - most) / open_weight, n
    target = F.when(F.lit(not open_weight), F.col("most").cast("double")).otherwise(F.least(F.col("weight") * level, F.col("most").cast("double")))
    return df.select("source", "n_docs", "source_size", "weight", target.alias("target"))


def _permute(x: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A keyed permutation of 0..n-1 for each (n, key), element by element: Feistel rounds, walked until below n."""
    half = np.maximum(1, np.ceil(np.log2(np.maximum(n, 2)) / 2)).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, todo = x.astype(np.uint64), np.arange(len(x))
    while len(todo):
        left, right = out[todo] >> half[todo], out[todo] & mask[todo]
        for r in range(4):
            mixed = (right + key[todo] + np.uint64(r + 1)) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
            mixed *= np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((mixed >> np.uint64(32)) & mask[todo])
        out[todo] = left << half[todo] | right
        todo = todo[out[todo] >= n[todo].astype(np.uint64)]
    return out.astype(np.int64)


def hypergeometric(quotas: np.ndarray, n: int, seed: list[int]) -> np.ndarray:
    """How many blocks of each source a draw of n among all quotas takes."""
    if int(quotas.sum()) < LARGE_POPULATION:
        return np.random.default_rng(seed).multivariate_hypergeometric(quotas, n, method="marginals")
    rng, out = np.random.RandomState(np.random.SeedSequence(seed).generate_state(8)), np.zeros_like(quotas)
    rest = int(quotas.sum())
    for i, quota in enumerate(quotas.tolist()):  # each given those before it
        rest -= quota
        if n and quota:
            out[i] = rng.hypergeometric(quota, rest, n) if rest else n
            n -= int(out[i])
    return out


def _split(quotas: np.ndarray, first: int, last: int, shards: int, blocks: int, levels: int, seed: int):
    """Yields (first, last, quotas) of the nodes so many levels below the node of shards first..last-1."""
    if levels == 0 or last - first == 1:
        yield first, last, quotas
        return
    middle = (first + last) // 2
    edge = lambda s: blocks * s // shards  # noqa: E731  blocks in the shards before s
    draw = hypergeometric(quotas, edge(middle) - edge(first), [seed, first, last])
    yield from _split(draw, first, middle, shards, blocks, levels - 1, seed)
    yield from _split(quotas - draw, middle, last, shards, blocks, levels - 1, seed)


def shard_quotas(quotas: DataFrame, shards: int, blocks: int, seed: int) -> DataFrame:
    """quotas (sid, quota) -> (sid, shard, lo, hi): the range of a source's block numbers that each shard takes."""

    def split(node: pd.DataFrame) -> pd.DataFrame:
        node = node.sort_values("sid")
        found = [pd.DataFrame({"first": a, "last": b, "sid": node["sid"], "quota": q})[q > 0] for a, b, q in _split(node["quota"].to_numpy(), int(node["first"].iloc[0]), int(node["last"].iloc[0]), shards, blocks, FAN_LEVELS, seed)]
        return pd.concat(found)

    nodes = quotas.select(F.lit(0).cast("long").alias("first"), F.lit(shards).cast("long").alias("last"), "sid", F.col("quota").cast("long").alias("quota"))
    width = shards
    while width > 1:
        nodes = nodes.groupBy("first", "last").applyInPandas(split, "first long, last long, sid long, quota long")
        width = -(-width >> FAN_LEVELS) if width > 1 << FAN_LEVELS else 1
    before = Window.partitionBy("sid").orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    nodes = nodes.withColumn("lo", F.coalesce(F.sum("quota").over(before), F.lit(0)))
    return nodes.filter("quota > 0").select("sid", F.col("first").alias("shard"), "lo", (F.col("lo") + F.col("quota")).alias("hi"))


@dataclass(frozen=True)
class Mix:
    """sources: source, sid, sizes, target. lines: row, doc_id, sid, size, begin (its place on its source's line)."""

    sources: DataFrame
    lines: DataFrame
    config: MixConfig
    shards: int
    blocks: int

    def pieces(self) -> DataFrame:
        """row, doc_id, epoch, from_word, n_words, shard, place: every piece of a document that the mix takes."""
        c, b = self.config, self.config.block_words
        src = self.sources.select("sid", "source_size", "take", "n_blocks")
        df = joined_small(self.lines.filter("size > 0"), src, ["sid"], "inner", BROADCAST_SOURCES)
        epochs = F.explode(F.sequence(F.lit(0), F.lit(c.most_repeats - 1)))
        df = df.withColumn("epoch", epochs).withColumn("limit", F.least("source_size", F.col("take") - F.col("epoch") * F.col("source_size")))
        df = df.filter("begin < limit").withColumn("end", F.least(F.col("begin") + F.col("size"), F.col("limit")))
        df = df.withColumn("block", F.explode(F.sequence(F.floor(F.col("begin") / b), F.floor((F.col("end") - 1) / b))))
        lo, hi = F.greatest("begin", F.col("block") * b), F.least("end", (F.col("block") + 1) * b)
        df = df.select("row", "doc_id", "sid", "epoch", (lo - F.col("begin")).alias("from_word"), (hi - lo).alias("n_words"), lo.alias("at"), (F.col("epoch") * F.ceil(F.col("source_size") / b) + F.col("block")).cast("long").alias("draw"), "n_blocks")
        seed = c.seed

        def number(draw: pd.Series, n: pd.Series, sid: pd.Series) -> pd.Series:
            return pd.Series(_permute(draw.to_numpy(np.int64), n.to_numpy(np.int64), sid.to_numpy(np.int64).view(np.uint64) + np.uint64(seed)))

        df = df.withColumn("number", F.pandas_udf(number, "long")("draw", "n_blocks", "sid"))
        span = max(1, c.shard_blocks // 8)  # ranges and numbers meet on equal spans of numbers
        quotas = shard_quotas(self.sources.filter("n_blocks > 0").select("sid", F.col("n_blocks").alias("quota")), self.shards, self.blocks, seed)
        quotas = quotas.withColumn("span", F.explode(F.sequence(F.floor(F.col("lo") / span), F.floor((F.col("hi") - 1) / span))))
        df = df.withColumn("span", F.floor(F.col("number") / span))
        df = df.join(quotas, ["sid", "span"]).filter("number >= lo and number < hi")
        shuffled = Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(seed), "sid", "number"), "sid", "number", "at", "row")
        return df.withColumn("place", F.row_number().over(shuffled)).select("row", "doc_id", "epoch", "from_word", "n_words", "shard", "place")


def plan_mix(docs: DataFrame, config: MixConfig = MixConfig()) -> Mix:
    """Lines, targets and quotas for docs (doc_id, source, text)."""
    sized = docs.select(F.xxhash64("doc_id", "source", "text").alias("row"), "doc_id", "source", word_count(F.col("text")).alias("size"))
    sized = sized.withColumns({"sid": F.xxhash64(F.coalesce("source", F.lit("")), F.col("source").isNull()), "spot": F.xxhash64(F.lit(config.seed), "row")})
    sized = materialize(sized, "sized")
    sizes = materialize(sized.groupBy("source", "sid").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("size").cast("long").alias("source_size")), "sizes")
    targets = source_targets(sizes.drop("sid"), config)
    b = config.block_words
    targets = targets.withColumns({"sid": F.xxhash64(F.coalesce("source", F.lit("")), F.col("source").isNull()), "take": F.round("target").cast("long")})
    again = F.greatest(F.col("take") - F.col("source_size"), F.lit(0))
    blocks = F.when(F.col("source_size") == 0, 0).otherwise(F.ceil(F.least("take", "source_size") / b) + F.ceil(again / b))
    targets = materialize(targets.withColumn("n_blocks", blocks.cast("long")), "targets")
    parts = joined_small(sized, targets.select("sid", "n_docs"), ["sid"], "inner", BROADCAST_SOURCES)
    # the line in parts of the hash range: a part's place is known from the sums before it
    parts = parts.withColumn("part", F.floor((F.col("spot").cast("double") / float(1 << 63) + 1) / 2 * F.ceil(F.col("n_docs") / config.part_rows)).cast("long"))
    before = Window.partitionBy("sid").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = parts.groupBy("sid", "part").agg(F.sum("size").alias("words"))
    sums = materialize(sums.select("sid", "part", F.coalesce(F.sum("words").over(before), F.lit(0)).cast("long").alias("base")), "sums")
    inside = Window.partitionBy("sid", "part").orderBy("spot", "row", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    lines = parts.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)).cast("long"))
    lines = joined_small(lines, sums, ["sid", "part"], "inner").select("row", "doc_id", "sid", "size", (F.col("base") + F.col("inside")).alias("begin"))
    total = targets.agg(F.coalesce(F.sum("n_blocks"), F.lit(0))).first()[0]
    return Mix(targets, materialize(lines, "lines"), config, max(1, -(-total // config.shard_blocks)), total)


def report(docs: DataFrame, config: MixConfig = MixConfig()) -> DataFrame:
    """doc_id, size, source_size, target, taken (words) and the number of shards its pieces went to, of every row."""
    mix = plan_mix(docs, config)
    taken = mix.pieces().groupBy("row", "doc_id").agg(F.sum("n_words").alias("words"), F.count_distinct("shard").alias("shards"))
    rows = Window.partitionBy("row", "doc_id")
    lines = joined_small(mix.lines, mix.sources.select("sid", "source_size", "target"), ["sid"], "inner", BROADCAST_SOURCES)
    same = F.count(F.lit(1)).over(rows)  # rows that repeat share what was taken of them
    out = lines.withColumn("same", same).withColumn("copy", F.row_number().over(rows.orderBy("begin"))).join(taken.withColumnsRenamed({"row": "r", "doc_id": "d"}), (F.col("row") == F.col("r")) & F.col("doc_id").eqNullSafe(F.col("d")), "left")
    words = F.coalesce("words", F.lit(0))
    share = F.floor(words / F.col("same")) + (F.col("copy") <= words % F.col("same")).cast("long")
    return out.select("doc_id", "size", "source_size", "target", share.cast("long").alias("taken"), F.coalesce("shards", F.lit(0)).cast("long").alias("n_shards"))


def mixed(docs: DataFrame, config: MixConfig = MixConfig()) -> DataFrame:
    """Whole documents by the mix, shard by shard in the order of its shuffle.

    A document is given once for each epoch that takes at least half its words, in the shard and at the place of its first
    piece there. A partition holds whole shards, sorted, so that the files written from it are the mix.
    """
    mix = plan_mix(docs, config)
    times = mix.pieces().groupBy("row", "doc_id", "epoch").agg(F.sum("n_words").alias("words"), F.min(F.struct("shard", "place")).alias("at"))
    size = mix.lines.groupBy("row", "doc_id").agg(F.sum("size").alias("size"))
    whole = times.join(size.withColumnsRenamed({"row": "r", "doc_id": "d"}), (F.col("row") == F.col("r")) & F.col("doc_id").eqNullSafe(F.col("d")))
    whole = materialize(whole.filter("2 * words >= size").select(F.col("row").alias("r"), F.col("doc_id").alias("d"), "epoch", "at.shard", "at.place"), "whole")
    rows = boxed(docs, row=F.xxhash64("doc_id", "source", "text"), id=F.col("doc_id"))
    out = rows.join(whole, (F.col("row") == F.col("r")) & F.col("id").eqNullSafe(F.col("d")))
    return unboxed(out.repartition("shard").sortWithinPartitions("shard", "place", "epoch"))
