"""SimHash near-duplicates, found through a Gray-order hierarchical index.

Fingerprints are computed in Arrow batches. Documents with equal fingerprints (or texts) are one node. Nodes meet in
blocks that an index of one task can carry: for a bit limit, the bits are split into one band more than the limit, so that two
fingerprints within it agree on a band, and a few bits of each band are a key (as few as keep blocks near INDEX_ROWS);
for a word-shingle similarity, keys are minimum shingle hashes. A task takes whole
blocks, sorts each by Gray rank and builds the index: a node of a level holds the bits that all fingerprints below it share.
Pairs of nodes are followed from the roots down; the differences on bits newly shared are added to those of the
level above, and a pair of groups is dropped as soon as its accumulated differences pass the limit. Where the differences and all
bits not yet shared stay within the limit, the groups are united as wholes, and two groups that are united already are not
followed: no group's pairs are listed. A block gives a star for each of its components. Stars join to components over all blocks.

For a word-shingle similarity, bits and sketches only choose candidates. Each candidate pair is decided by its documents'
sets of distinct shingles before it links. A block proposes a spanning forest of its candidates. Where pairs of it are refused and
the links of all blocks leave nodes of it apart, its sets are sent to its task, which decides all its other candidates without listing
them. A block whose sets hold more than SETTLE_SHINGLES proposes further pairs instead, until every candidate pair is decided or joined
by decided links; both ways give the same components.

A block above BLOCK_ROWS is split by further keys, and its parts again, until none is above or no key is left: bits by a new
partition of all bits each time, which loses no pair and ends with single fingerprints; minimum hashes by further ones, so that
of pairs of the least similarity one in 3,000 is lost at a split, as many as the first keys lose.

Defined cases: null text is empty; without words the fingerprint is 0, linked like any other. Repeated rows and
ties are equal fingerprints. Extra columns, of any name, are not read by report() and pass through one_of_each(). Empty tables give empty
tables. One document stays: the least doc_id (nulls first), of repeated rows one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import boxed, joined_small, materialize, unboxed
from .components import components

BITS = 64
#: Contract of the query: words per shingle, greatest number of differing bits.
SHINGLE_WORDS, LINK_BITS = 4, 4
#: Near-duplicate stages: words per shingle, least similarity. Candidates: bits of distinct shingles (five standard
#: deviations above the mean of pairs of the least similarity), least estimate (six standard errors below it).
STAGE_WORDS, STAGE_SIMILARITY, STAGE_BITS, STAGE_ESTIMATE = 5, 0.8, 24, 0.65
#: Most further pairs that a block proposes for each node after a refusal; so many times more in each later round.
MORE_PAIRS = 16
#: Shingles of the sets that one task compares at once.
SETTLE_SHINGLES = 4_000_000
#: Minimum hashes for block keys, as many again for hot blocks; bins of the similarity sketch.
KEYS, SKETCH_BINS = 5, 256
FAN, BLOCK_ROWS, GROUP_ROWS, PAIRS_AT_ONCE = 8, 100_000, 50_000, 20_000
#: Fingerprints that a block of a bit limit holds if they are spread evenly.
INDEX_ROWS = 2_048
#: Times that a block may be split: bits of 19 partitions leave less than one bit of 64 free.
MOST_SPLITS = 19
FOLD = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def shingle_hashes(text: str | None, size: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each run of size words of the lower-cased text (fewer words: of all of them), repeats included."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()
    if not words:
        return np.empty(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([digest(joined, seed)], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    pairs = zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)
    return np.fromiter((digest(joined[a:b], seed) for a, b in pairs), np.uint64, len(words) - size + 1)


def simhash(hashes: np.ndarray) -> int:
    """Bit i is 1 if it is set in over half the hashes; as a signed 64-bit integer."""
    if not len(hashes):
        return 0
    counts = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 1 << 16):  # bounded memory for very long texts
        counts += np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, size: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, fp (64 bits as a signed long) of every row."""
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [simhash(shingle_hashes(t.as_py(), size)) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.int64())], names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


# --- the index of one task -------------------------------------------------------------------------------------------


def gray_rank(fp: np.ndarray) -> np.ndarray:
    """The place of each 64-bit pattern in the reflected Gray code."""
    out = fp.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(shift)
    return out


class GrayIndex:
    """Levels over fingerprints that are sorted by block and Gray rank; level 0 has the fingerprints themselves."""

    def __init__(self, fp: np.ndarray, block: np.ndarray) -> None:
        self.levels = [(fp, fp, block, None, None)]  # all ones in common, any ones, block, first and last child
        while True:
            ones, some, block, _, _ = self.levels[-1]
            first = np.flatnonzero(np.r_[True, block[1:] != block[:-1]]) if len(block) else np.empty(0, np.int64)
            if len(first) == len(block):
                break
            place = np.arange(len(block)) - np.repeat(first, np.diff(np.r_[first, len(block)]))
            starts = np.flatnonzero(place % FAN == 0)
            ends = np.r_[starts[1:], len(block)]
            self.levels.append((np.bitwise_and.reduceat(ones, starts), np.bitwise_or.reduceat(some, starts), block[starts], starts, ends))

    def linked(self, limit: int, sets: Unions, whole: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (u, v) of positions whose fingerprints differ in at most limit bits; pairs of groups that are one set in sets are left out.

        whole: groups that cannot differ in more bits are united in sets right away, without pairs.
        """
        top = len(self.levels) - 1
        leaves = [np.arange(len(self.levels[0][0]) + 1)]  # first leaf of each node, by level
        for level in range(1, top + 1):
            leaves.append(np.r_[leaves[-1][self.levels[level][3]], len(self.levels[0][0])])
        roots = np.arange(len(self.levels[top][0]))
        work = [(top, roots, roots, np.zeros(len(roots), np.int64))]
        marks: dict[int, tuple[int, np.ndarray]] = {}

        def one_set(level: int) -> np.ndarray:
            """Per node of a level: the set that all its leaves are in, or -1."""
            if marks.get(level, (-1,))[0] != sets.changes:
                starts = leaves[level][:-1]
                low = np.minimum.reduceat(sets.parent, starts)
                marks[level] = sets.changes, np.where(low == np.maximum.reduceat(sets.parent, starts), low, -1)
            return marks[level][1]

        while work:
            level, a, b, seen = work.pop()
            if len(a) > PAIRS_AT_ONCE:
                work.append((level, a[PAIRS_AT_ONCE:], b[PAIRS_AT_ONCE:], seen[PAIRS_AT_ONCE:]))
                a, b, seen = a[:PAIRS_AT_ONCE], b[:PAIRS_AT_ONCE], seen[:PAIRS_AT_ONCE]
            if len(a):
                of = one_set(level)
                open_ = (of[a] != of[b]) | (of[a] < 0)
                a, b, seen = a[open_], b[open_], seen[open_]
            if level == 0:
                apart = a != b
                yield a[apart], b[apart]
                continue
            ones, some, _, starts, ends = self.levels[level]
            known = ~(ones[a] ^ some[a]) & ~(ones[b] ^ some[b])
            if whole:
                near = seen + np.bitwise_count(~known) <= limit
                for x, y in zip(a[near].tolist(), b[near].tolist(), strict=True):
                    both = np.r_[leaves[level][x] : leaves[level][x + 1], leaves[level][y] : leaves[level][y + 1]]
                    sets.unite(np.full(len(both), both[0]), both)
                a, b, seen, known = a[~near], b[~near], seen[~near], known[~near]
            na, nb = (ends - starts)[a], (ends - starts)[b]
            of = np.repeat(np.arange(len(a)), na * nb)
            place = np.arange(len(of)) - np.repeat(np.cumsum(na * nb) - na * nb, na * nb)
            i, j = starts[a][of] + place // nb[of], starts[b][of] + place % nb[of]
            keep = (a[of] != b[of]) | (i <= j)
            of, i, j = of[keep], i[keep], j[keep]
            ones, some = self.levels[level - 1][:2]
            shared = ~(ones[i] ^ some[i]) & ~(ones[j] ^ some[j])
            total = seen[of] + np.bitwise_count((ones[i] ^ ones[j]) & shared & ~known[of])
            near = total <= limit
            if near.any():
                work.append((level - 1, i[near], j[near], total[near]))


class Unions:
    """Components of positions; parent always points to the root."""

    def __init__(self, n: int) -> None:
        self.parent, self.changes = np.arange(n), 0

    def unite(self, u: np.ndarray, v: np.ndarray) -> None:
        while len(u):
            a, b = self.parent[u], self.parent[v]
            apart = a != b
            u, v, a, b = u[apart], v[apart], a[apart], b[apart]
            if len(u):
                self.changes += 1
            np.minimum.at(self.parent, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = self.parent[self.parent]
                if np.array_equal(up, self.parent):
                    break
                self.parent = up

    def apart(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        return self.parent[u] != self.parent[v]


def sketch_similarity(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity of rows of two sketches: equal bins over bins that either has, corrected for chance equality."""
    used = ((a != 0) | (b != 0)).sum(1)
    same = ((a == b) & (a != 0)).sum(1)
    chance = 1 / 255
    return np.where(used == 0, 1.0, (same / np.maximum(used, 1) - chance) / (1 - chance))


def _sorted(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """order, fp, key, number of the block, id of rows by block and Gray rank."""
    fp = rows["fp"].to_numpy(np.int64).view(np.uint64)
    order = np.lexsort((gray_rank(fp), rows["key"].to_numpy()))
    key = rows["key"].to_numpy()[order]
    return order, fp[order], key, np.cumsum(np.r_[0, key[1:] != key[:-1]]) if len(key) else key, rows["id"].to_numpy()[order]


def block_stars(rows: pd.DataFrame, limit: int) -> pd.DataFrame:
    """rows (key, id, fp) of whole blocks -> links (u, v) of ids: a star for each component of each block."""
    _, fp, _, block, ids = _sorted(rows)
    sets = Unions(len(ids))
    for u, v in GrayIndex(fp, block).linked(limit, sets, whole=True):
        sets.unite(u, v)
    hangs = np.flatnonzero(sets.parent != np.arange(len(ids)))
    return pd.DataFrame({"u": ids[hangs], "v": ids[sets.parent[hangs]]})


def _rooted(rows: pd.DataFrame, order: np.ndarray, block: np.ndarray) -> Unions:
    """Positions with one root in one block are one set."""
    n = len(order)
    _, root = np.unique(rows["root"].to_numpy()[order], return_inverse=True)
    _, first, same = np.unique(block * n + root, return_index=True, return_inverse=True)
    sets = Unions(n)
    sets.unite(np.arange(n), first[same])
    return sets


def _sketches(rows: pd.DataFrame, order: np.ndarray) -> np.ndarray:
    return np.frombuffer(b"".join(rows["sketch"].to_numpy()[order]), np.uint8).reshape(len(order), -1)


class Sets:
    """Sets of longs by position, numbered so that a set is a run of flags."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.size = np.fromiter(map(len, sets), np.int64, len(sets))
        self.start = np.r_[0, np.cumsum(self.size)]
        members, self.code = np.unique(np.concatenate([np.empty(0, np.int64), *sets]), return_inverse=True)
        self.flag = np.zeros(len(members), bool)

    def shared(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Size of the intersection of sets x and y, pair by pair."""
        often = np.bincount(np.r_[x, y], minlength=len(self.size))
        swap = often[y] > often[x]
        x, y = np.where(swap, y, x), np.where(swap, x, y)
        order, out = np.argsort(x, kind="stable"), np.zeros(len(x), np.int64)
        for run in np.split(order, np.flatnonzero(np.diff(x[order])) + 1) if len(x) else []:
            own = self.code[self.start[x[run[0]]] : self.start[x[run[0]] + 1]]
            size = self.size[y[run]]
            ends = np.cumsum(size)
            self.flag[own] = True
            at = np.arange(ends[-1]) + np.repeat(self.start[y[run]] - (ends - size), size)
            counts = np.r_[0, np.cumsum(self.flag[self.code[at]])]
            self.flag[own] = False
            out[run] = counts[ends] - counts[ends - size]
        return out


def block_links(rows: pd.DataFrame, limit: int, estimate: float, least: Fraction) -> pd.DataFrame:
    """rows (key, id, fp, sketch, root, shingles) of whole blocks -> links (u, v) of ids: a star for each component, by exact sets."""
    order, fp, _, block, ids = _sorted(rows)
    sets, sketches, exact = _rooted(rows, order, block), _sketches(rows, order), Sets(list(rows["shingles"].to_numpy()[order]))
    for u, v in GrayIndex(fp, block).linked(limit, sets):
        for i in range(0, len(u), PAIRS_AT_ONCE):
            x, y = u[i : i + PAIRS_AT_ONCE], v[i : i + PAIRS_AT_ONCE]
            open_ = sets.apart(x, y)
            x, y = x[open_], y[open_]
            likely = sketch_similarity(sketches[x], sketches[y])
            best = np.argsort(-likely, kind="stable")[: int((likely >= estimate).sum())]
            for j in range(0, len(best), PAIRS_AT_ONCE // 10):  # the likeliest first: what they join need not be compared
                a, b = x[best[j : j + PAIRS_AT_ONCE // 10]], y[best[j : j + PAIRS_AT_ONCE // 10]]
                open_ = sets.apart(a, b)
                a, b = a[open_], b[open_]
                same = exact.shared(a, b)
                near_ = same * least.denominator >= (exact.size[a] + exact.size[b] - same) * least.numerator
                sets.unite(a[near_], b[near_])
    hangs = np.flatnonzero(sets.parent != np.arange(len(ids)))
    return pd.DataFrame({"u": ids[hangs], "v": ids[sets.parent[hangs]]})


def block_pairs(rows: pd.DataFrame, refused: pd.DataFrame, limit: int, estimate: float, more: int) -> pd.DataFrame:
    """rows (key, id, fp, sketch, root) of whole blocks, refused (key, u, v) -> undecided candidates (key, u, v) of different roots: a spanning forest, and up to more a node."""
    order, fp, key, block, ids = _sorted(rows)
    n = len(ids)
    if not n:
        return pd.DataFrame({"key": key, "u": ids, "v": ids})
    sketches = _sketches(rows, order)
    at = pd.DataFrame({"key": key, "id": ids, "at": np.arange(n)})
    known = refused.merge(at, left_on=["key", "u"], right_on=["key", "id"]).merge(at, left_on=["key", "v"], right_on=["key", "id"], suffixes=("_u", "_v"))
    x, y = known["at_u"].to_numpy(np.int64), known["at_v"].to_numpy(np.int64)
    codes = np.unique(np.minimum(x, y) * n + np.maximum(x, y))
    sets, trial = _rooted(rows, order, block), _rooted(rows, order, block)
    given, us, vs = np.zeros(n, np.int64), [], []
    for u, v in GrayIndex(fp, block).linked(limit, sets if more else trial):
        for i in range(0, len(u), PAIRS_AT_ONCE):
            x, y = u[i : i + PAIRS_AT_ONCE], v[i : i + PAIRS_AT_ONCE]
            open_ = sets.apart(x, y) if more else trial.apart(x, y)
            x, y = x[open_], y[open_]
            if len(codes) and len(x):
                new = ~np.isin(np.minimum(x, y) * n + np.maximum(x, y), codes)
                x, y = x[new], y[new]
            likely = sketch_similarity(sketches[x], sketches[y])
            best = np.argsort(-likely, kind="stable")[: int((likely >= estimate).sum())]
            x, y = x[best], y[best]
            up: dict[int, int] = {}
            took = []
            for k, (a, b, p, q) in enumerate(zip(x.tolist(), y.tolist(), trial.parent[x].tolist(), trial.parent[y].tolist(), strict=True)):
                while p in up:
                    p = up[p]
                while q in up:
                    q = up[q]
                if p != q:
                    up[max(p, q)] = min(p, q)
                elif given[a] >= more or given[b] >= more:
                    continue
                given[a] += 1
                given[b] += 1
                took.append(k)
            us.append(x[took])
            vs.append(y[took])
            trial.unite(us[-1], vs[-1])
    u, v = (np.concatenate([np.empty(0, np.int64), *z]).astype(np.int64) for z in (us, vs))
    return pd.DataFrame({"key": key[u], "u": np.minimum(ids[u], ids[v]), "v": np.maximum(ids[u], ids[v])})


# --- blocks and links over all tasks -----------------------------------------------------------------------------------


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def bit_parts(pieces: int, turn: int) -> list[list[int]]:
    """All bits in so many parts, dealt anew each turn."""
    bits = np.random.default_rng(turn).permutation(BITS).tolist() if turn else list(range(BITS))
    return [bits[i * BITS // pieces : (i + 1) * BITS // pieces] for i in range(pieces)]


def band_masks(limit: int, nodes: int) -> list[int]:
    """Masks such that any two fingerprints within limit bits agree on one; of each band so many bits that blocks stay near INDEX_ROWS."""
    width = max(0, (nodes // INDEX_ROWS).bit_length())
    return [_signed(sum(1 << b for b in part[-width:])) if width else 0 for part in bit_parts(limit + 1, 0)]


def _keyed(rows: DataFrame, masks: list[int], *before: Column) -> DataFrame:
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(m).cast("long").alias("m")) for i, m in enumerate(masks)]))
    rows = rows.withColumn("_band", each)
    return rows.withColumn("key", F.xxhash64(*before, "_band.i", F.col("fp").bitwiseAND(F.col("_band.m")))).drop("_band")


def band_blocks(nodes: DataFrame, limit: int, count: int) -> tuple[DataFrame, Callable[[DataFrame, int], DataFrame]]:
    """nodes (id, fp) -> rows by block key, and how to split hot blocks a further time without losing a pair."""

    def split(rows: DataFrame, turn: int) -> DataFrame:
        masks = [_signed(sum(1 << b for b in part)) for part in bit_parts(limit + 1, turn)]
        return _keyed(rows, masks, F.col("key"), F.lit(turn))

    return _keyed(nodes, band_masks(limit, count)), split


def _dealt(rows: DataFrame, columns: list[str], split: Callable[[DataFrame, int], DataFrame], turns: int) -> DataFrame:
    """rows (key and columns) -> g, key and columns, whole blocks by g; blocks above BLOCK_ROWS are split up to so many times."""
    for turn in range(1, turns + 1):
        sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
        hot = materialize(sizes.filter(F.col("n") > BLOCK_ROWS).select("key"), "hot-blocks")  # at most rows / BLOCK_ROWS
        if not hot.count():
            break
        parts = split(joined_small(rows, hot, ["key"], "left_semi"), turn)
        rows = materialize(joined_small(rows, hot, ["key"], "left_anti").unionByName(parts), "split-blocks")
    total = rows.count()
    groups = max(1, total // GROUP_ROWS, rows.sparkSession.sparkContext.defaultParallelism)
    return rows.select(F.pmod(F.xxhash64("key"), F.lit(groups)).alias("g"), "key", *columns)


def links(rows: DataFrame, limit: int, split: Callable[[DataFrame, int], DataFrame]) -> DataFrame:
    """rows (key, id, fp) -> links (u, v) of fingerprints within limit bits."""
    stars = lambda pdf: block_stars(pdf, limit)
    return _dealt(rows, ["id", "fp"], split, MOST_SPLITS).groupBy("g").applyInPandas(stars, "u long, v long").distinct()


def near(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """pairs (u, v), sets (id, shingles: distinct) -> u, v, near: whether shared shingles over all shingles reach similarity."""
    side = lambda k, s: sets.select(F.col("id").alias(k), F.col("shingles").alias(s))
    least = Fraction(str(similarity))
    both = pairs.join(side("u", "a"), "u").join(side("v", "b"), "v").withColumn("same", F.size(F.array_intersect("a", "b")).cast("long"))
    return both.select("u", "v", (F.col("same") * least.denominator >= (F.size("a") + F.size("b") - F.col("same")) * least.numerator).alias("near"))


def _proposer(limit: int, estimate: float, more: int) -> Callable:
    return lambda g, rows, refused: block_pairs(rows, refused, limit, estimate, more).assign(g=g[0])


def similar_components(rows: DataFrame, sets_of: Callable[[DataFrame], DataFrame], limit: int, estimate: float, similarity: float) -> DataFrame:
    """rows (key, further, id, fp, sketch) -> node, root: components of ids whose sets reach similarity; sets_of: ids (id) -> id, shingles."""
    spark = rows.sparkSession

    def split(hot: DataFrame, turn: int) -> DataFrame:
        """Blocks by key and each further minimum hash, those after it staying further ones."""
        parts = hot.select("id", "fp", "sketch", "further", "key", F.posexplode("further").alias("i", "min"))
        rest = F.filter("further", lambda m, i: i != F.col("i"))
        return parts.select(F.xxhash64("key", F.lit(turn), "i", "min").alias("key"), "id", "fp", "sketch", rest.alias("further"))

    held = materialize(_dealt(rows, ["id", "fp", "sketch"], split, KEYS - 1), "dealt")
    refused, sets, more = spark.createDataFrame([], "g long, key long, u long, v long"), None, 0
    roots = spark.createDataFrame([], "node long, root long")
    settle = lambda pdf: block_links(pdf, limit, estimate, Fraction(str(similarity)))
    star = [F.col("node").alias("u"), F.col("root").alias("v")]
    with_roots = lambda df: joined_small(df, roots.withColumnRenamed("node", "id"), ["id"], "left").withColumn("root", F.coalesce("root", "id"))
    while True:
        found = with_roots(held).groupBy("g").cogroup(refused.groupBy("g")).applyInPandas(_proposer(limit, estimate, more), "g long, key long, u long, v long")
        found = materialize(found, "candidates")
        pairs = found.select("u", "v").distinct()
        if sets is None:  # a forest meets each node that has a candidate
            sets = materialize(sets_of(pairs.select(F.explode(F.array("u", "v")).alias("id")).distinct()), "shingles")
        verdicts = materialize(found.join(near(pairs, sets, similarity), ["u", "v"]).select("g", "key", "u", "v", "near"), "decided")
        roots = materialize(components(verdicts.filter("near").select("u", "v").unionByName(roots.select(star))), "roots")
        apart = materialize(verdicts.filter(~F.col("near")).select("g", "key", "u", "v"), "refused")
        if apart.isEmpty():
            return roots
        asked = with_roots(joined_small(held, materialize(apart.select("key").distinct(), "asked-blocks"), ["key"], "left_semi"))
        asked = asked.select("key", "id", "root").join(sets.select("id", F.size("shingles").alias("n")), "id").groupBy("key")
        asked = asked.agg(F.sum("n").alias("n"), F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi")
        open_ = materialize(asked.select("key", "n"), "open-blocks")
        small = materialize(open_.filter(F.col("n") <= SETTLE_SHINGLES), "small-blocks")
        if not small.isEmpty():
            tasks = max(spark.sparkContext.defaultParallelism, small.agg(F.sum("n")).first()[0] // max(1, SETTLE_SHINGLES))
            whole = with_roots(joined_small(held.drop("g"), small.select("key"), ["key"], "left_semi")).join(sets, "id")
            stars = whole.groupBy(F.pmod(F.xxhash64("key", F.lit(1)), F.lit(tasks))).applyInPandas(settle, "u long, v long").distinct()
            roots = materialize(components(materialize(stars, "settled").unionByName(roots.select(star))), "roots")
        large = materialize(open_.filter(F.col("n") > SETTLE_SHINGLES).select("key"), "large-blocks")
        if large.isEmpty():
            return roots
        refused, held, more = refused.unionByName(apart), joined_small(held, large, ["key"], "left_semi"), more * MORE_PAIRS or MORE_PAIRS


def report(docs: DataFrame, size: int = SHINGLE_WORDS, limit: int = LINK_BITS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (least doc_id reachable by links) of every row."""
    of = materialize(fingerprints(docs, size), "fingerprints")
    nodes = materialize(of.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    rows, split = band_blocks(nodes.select(F.col("fp").alias("id"), "fp"), limit, nodes.count())
    found = components(links(rows, limit, split))
    rooted = nodes.join(found.select(F.col("node").alias("fp"), "root"), "fp", "left")
    least = rooted.filter("root is not null").groupBy("root").agg(F.min("first").alias("least"))
    named = rooted.join(least, "root", "left").select("fp", F.coalesce("least", "first").alias("component_id"))
    named = materialize(named, "named")
    return of.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# --- the stage of a pipeline ---------------------------------------------------------------------------------------


def _mixed(x: np.ndarray, seed: int) -> np.ndarray:
    """A bijection of 64-bit integers for each seed."""
    x = (x ^ np.uint64((seed * 0x9E3779B97F4A7C15) % (1 << 64))) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


def profile(text: str | None) -> tuple[int, int, bytes, list[int]]:
    """(content id, fingerprint, sketch, minimum hashes) of a text, from its distinct shingles of STAGE_WORDS words."""
    hashes = shingle_hashes(text, STAGE_WORDS)
    content = xxhash.xxh64_intdigest(b" ".join((text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()), seed=7)
    content -= (content >> 63) << 64
    if not len(hashes):
        return content, 0, bytes(SKETCH_BINS), [0] * (2 * KEYS)
    distinct = np.unique(hashes)
    turned = np.sort(distinct << np.uint64(56) | distinct >> np.uint64(8))  # by bin, then value
    bins = (turned >> np.uint64(56)).astype(np.int64)
    lead = np.r_[True, bins[1:] != bins[:-1]]
    sketch = np.zeros(SKETCH_BINS, np.uint8)
    sketch[bins[lead]] = turned[lead] % np.uint64(255) + np.uint64(1)
    return content, simhash(distinct), sketch.tobytes(), [int(_mixed(distinct, s).min().view(np.int64)) for s in range(1, 2 * KEYS + 1)]


def profiles(docs: DataFrame) -> DataFrame:
    """docs (row, doc_id, text) -> row, doc_id, content, fp, sketch, mins."""
    schema = T.StructType([T.StructField("row", T.LongType()), T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("content", T.LongType()), T.StructField("fp", T.LongType()), T.StructField("sketch", T.BinaryType()), T.StructField("mins", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [profile(t.as_py()) for t in batch.column("text")]
            made = [pa.array([f[k] for f in found], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64())))]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), *made], names=schema.names)

    return docs.select("row", "doc_id", "text").mapInArrow(run, schema)


def distinct_shingles(texts: DataFrame) -> DataFrame:
    """texts (id, text) -> id, shingles: the distinct hashes of the text's shingles of STAGE_WORDS words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(shingle_hashes(t.as_py(), STAGE_WORDS)).view(np.int64) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found, pa.list_(pa.int64()))], names=["id", "shingles"])

    return texts.select("id", "text").mapInArrow(run, "id long, shingles array<long>")


def groups(docs: DataFrame) -> DataFrame:
    """row (a hash of doc_id and text), doc_id, group (content id of the group's least member) of every row."""
    numbered = docs.select(F.xxhash64("doc_id", "text").alias("row"), "doc_id", "text")
    all_ = materialize(profiles(numbered), "profiles")
    any_of = lambda c: F.min(c).alias(c)  # noqa: E731  equal contents have equal values
    nodes = all_.groupBy("content").agg(any_of("fp"), any_of("sketch"), any_of("mins"))
    rows = nodes.select(F.col("content").alias("id"), "fp", "sketch", F.posexplode(F.slice("mins", 1, KEYS)).alias("i", "min"), F.slice("mins", KEYS + 1, KEYS).alias("others"))
    rows = rows.withColumn("key", F.xxhash64("i", "min"))
    rows = rows.select("key", "id", "fp", "sketch", F.col("others").alias("further"))

    def sets_of(ids: DataFrame) -> DataFrame:
        one = all_.select(F.col("content").alias("id"), "row").join(ids, "id", "left_semi").groupBy("id").agg(F.min("row").alias("row"))
        return distinct_shingles(joined_small(numbered, materialize(one, "asked"), ["row"], "inner")).dropDuplicates(["id"])

    found = similar_components(materialize(rows, "blocks"), sets_of, STAGE_BITS, STAGE_ESTIMATE, STAGE_SIMILARITY)
    return all_.select("row", "doc_id", "content").join(found.withColumnRenamed("node", "content"), "content", "left").select("row", "doc_id", F.coalesce("root", "content").alias("group"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs without near copies: of each group the row with the least doc_id stays, whole and unchanged."""
    kept = groups(docs).groupBy("group").agg(F.min(F.struct("doc_id", "row")).alias("least")).select("least.row", F.col("least.doc_id").alias("id"))
    kept = materialize(kept, "kept")  # one row a group
    rows = boxed(docs, r=F.xxhash64("doc_id", "text"), d=F.col("doc_id")).join(kept, (F.col("r") == F.col("row")) & F.col("d").eqNullSafe(F.col("id")), "left_semi")
    return unboxed(rows.dropDuplicates(["r", "d"]))
