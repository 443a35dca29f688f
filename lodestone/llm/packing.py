"""Packing documents into sequences as a cutting-stock problem with column generation.

Every document is tokenized once, in Arrow batches, and cut into pieces of the sequence length plus a rest. What
the driver sees is the histogram of piece lengths in classes of CLASS_WIDTH tokens, at most SEQUENCE / CLASS_WIDTH rows
whatever the corpus. Over it a linear program chooses how often to use each pattern (a multiset of classes
that fits a sequence). It starts from patterns filled largest first, which form a basis; an unbounded-knapsack dynamic program
prices new patterns, until the uses come within TOLERANCE of a lower bound: the volume, or the uses over the best price.
Uses are rounded down, what is left is solved again as a smaller program, and the last patterns, used less than once
each, are repaired to what is left; so every piece of the histogram has a slot. Pieces are ranked within their class (in salted
parts, so that a class holding most pieces is spread), and the rank names the pattern, its copy and the slot.

Defined cases: a null or empty text is the one closing id. Rows that repeat are packed each; null ids stay. Extra columns
are not read. An empty table gives no pieces. A text without an end of white space, of any length, is tokenized whole.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import joined_small, materialize

SEQUENCE = 2048
CLOSING_ID = 1
CLASS_WIDTH = 8
#: The program ends when its bound shows that no more than this share of sequences could still be saved.
TOLERANCE, MOST_ROUNDS = 1e-4, 4000
#: Least sound pivot of the simplex, and what counts as a tie of its ratios.
PIVOT, TIED = 1e-7, 1e-9
#: Bytes of words and ids that a Python worker keeps, with the overhead of an entry, before it begins anew.
KEPT_BYTES, ENTRY_BYTES = 256 << 20, 200
#: ASCII punctuation, which the tokenizer never joins to letters before it.
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordTokenizer:
    """Ids by the tokenizer. It drops white space and never joins across it, so each word is encoded once and remembered."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.ends_word = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends_word[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]] = True
        self.known: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.held = 0
        self.closing = np.array([CLOSING_ID], "<u4").tobytes()

    def learn(self, words: list[bytes]) -> None:
        """Adds the ids of words. A Latin-1 word with marks behind it has the ids of its lower-case letters, then those of its marks."""
        split, letters, others = [], set(), set()
        for w in words:
            text = w.decode("utf-8", "surrogatepass")
            core = text.rstrip(MARKS)
            if core.isalpha() and (core.isascii() or max(core) < "\u0100"):
                split.append((core.lower(), text[len(core) :]))
                letters.add(core.lower())
                others.add(text[len(core) :])
            else:
                split.append((text, ""))
                others.add(text)
        letters = list(letters.difference(self.parts))
        if letters:  # one token run each, so the last token of a word tells where each ends
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(letters)], add_special_tokens=False)[0].ids, "<u4")
            ends = (4 * (np.flatnonzero(self.ends_word[ids]) + 1)).tolist()
            raw = ids.tobytes()
            self.parts.update((p, raw[a:b]) for p, a, b in zip(letters, [0, *ends[:-1]], ends, strict=True))
        others = list(others.difference(self.parts, [""]))
        if others:
            found = self.tokenizer.encode(others, is_pretokenized=True, add_special_tokens=False)
            raw = np.array(found.ids, "<u4").tobytes()
            ends = np.searchsorted(found.word_ids, np.arange(len(others)), "right").tolist()
            self.parts.update((p, raw[4 * a : 4 * b]) for p, a, b in zip(others, [0, *ends[:-1]], ends, strict=True))
        self.held += sum(map(len, words)) + ENTRY_BYTES * len(words)
        self.known.update((w, self.parts[a] + self.parts[b] if b else self.parts[a]) for w, (a, b) in zip(words, split, strict=True))

    def ids(self, texts: list[str]) -> Iterator[bytes]:
        """Per text: its ids and the closing id as little-endian unsigned 32-bit integers."""
        for text in texts:
            words = text.encode("utf-8", "surrogatepass").split()
            new = list(set(words).difference(self.known))
            if self.held > KEPT_BYTES:
                self.known.clear()
                self.parts.clear()
                self.held, new = 0, list(set(words))
            if new:
                self.learn(new)
            yield b"".join(map(self.known.__getitem__, words)) + self.closing


def cut(docs: DataFrame, tokenizer: str, sequence: int = SEQUENCE) -> DataFrame:
    """Pieces of every document: whole sequences from its start, then the rest."""
    schema = T.StructType([docs.schema["doc_id"]] + [T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32", "doc_tokens")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordTokenizer(tokenizer)
        for batch in batches:
            rows, which = [], []
            for i, ids in enumerate(words.ids([t or "" for t in batch.column("text").to_pylist()])):
                tokens = len(ids) // 4
                for at in range(0, tokens, sequence):
                    end = min(at + sequence, tokens)
                    rows.append((at, end - at, zlib.crc32(ids[4 * at : 4 * end]), tokens))
                    which.append(i)
            made = np.array(rows, np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(which, pa.int64())), *(pa.array(made[:, k]) for k in range(4))], names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


# --- the cutting-stock program, over a histogram ---------------------------------------------------------------------


def best_pattern(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The multiset of sizes within capacity of the greatest worth, by dynamic programming."""
    use = worth > 1e-12
    items, gain = sizes[use], worth[use]
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fits = np.searchsorted(items, np.arange(capacity + 1), "right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if k := fits[c]:
            values = gain[:k] + best[c - items[:k]]
            j = int(values.argmax())
            if values[j] > best[c] + 1e-12:
                best[c], choice[c] = values[j], j
    counts, c, where = np.zeros(len(sizes), np.int64), capacity, np.flatnonzero(use)
    while c > 0:
        if choice[c] < 0:
            c -= 1
        else:
            counts[where[choice[c]]] += 1
            c -= items[choice[c]]
    return float(best[capacity]), counts


def first_basis(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(patterns by column, uses) that meet demand: each filled with the largest sizes left and used until one of them is used up.

    The size used up is in no later pattern, so the columns are triangular: a basis, whatever the demand.
    """
    m, left, open_ = len(sizes), demand.astype(float), list(range(len(sizes) - 1, -1, -1))
    basis, uses = np.zeros((m, m), np.int64), np.zeros(m)
    for step in range(m):
        room = capacity
        for k in open_:
            if room < sizes[k]:
                continue
            basis[k, step] = n = min(room // sizes[k], max(1, int(np.ceil(left[k]))))
            room -= n * sizes[k]
        used = np.flatnonzero(basis[:, step])
        out = used[(left[used] / basis[used, step]).argmin()]
        uses[step] = left[out] / basis[out, step]
        left = np.maximum(left - uses[step] * basis[:, step], 0)
        open_.remove(out)
    return basis, uses


def inverted(basis: np.ndarray) -> np.ndarray:
    """Inverse by elimination with row pivots; plain array steps, as a threaded linear algebra library may hang behind a JVM's fork."""
    m = len(basis)
    work = np.hstack([basis.astype(float), np.eye(m)])
    for c in range(m):
        p = c + int(np.abs(work[c:, c]).argmax())
        if p != c:
            work[[c, p]] = work[[p, c]]
        work[c] /= work[c, c]
        others = np.flatnonzero(work[:, c])
        others = others[others != c]
        work[others] -= work[others, c, None] * work[c]
    return work[:, m:]


def _times(inverse: np.ndarray, vector: np.ndarray) -> np.ndarray:
    return (inverse * vector).sum(1)


def _leaving(uses: np.ndarray, step: np.ndarray) -> int | None:
    """The pattern that a new one replaces: of those used up first (ties but for rounding), the one with the largest pivot.

    Ties are common, and a tiny pivot among them would make the basis singular. None where no pivot is sound.
    """
    ratios = np.where(step > PIVOT, uses / np.where(step > PIVOT, step, 1), np.inf)
    least = ratios.min()
    if not np.isfinite(least):
        return None
    tied = np.flatnonzero(ratios <= least + TIED * max(1.0, least))
    return int(tied[step[tied].argmax()])


def solve_patterns(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(patterns by row, uses, lower bound) of the linear program min sum(uses), patterns' uses meeting demand; revised simplex."""
    basis, uses = first_basis(sizes, demand, capacity)
    inverse = inverted(basis)
    bound = float((sizes * demand).sum()) / capacity
    for turn in range(1, MOST_ROUNDS):
        if uses.sum() <= bound * (1 + TOLERANCE):
            break
        price, pattern = best_pattern(sizes, inverse.sum(0), capacity)
        bound = max(bound, uses.sum() / price)
        if price <= 1 + TOLERANCE:
            break
        step = _times(inverse, pattern)
        out = _leaving(uses, step)
        if out is None:  # rounding has spoilt the inverse: the patterns so far meet the demand, and the plan repairs them
            break
        moved = uses[out] / step[out]
        uses = np.maximum(uses - moved * step, 0)
        uses[out] = moved
        basis[:, out] = pattern
        if turn % 64 == 0:  # rounding errors do not add up
            again = inverted(basis)
            if not np.isfinite(again).all():  # singular but for rounding
                break
            inverse, uses = again, np.maximum(_times(again, demand), 0)
        else:
            row = inverse[out] / step[out]
            inverse -= np.outer(step, row)
            inverse[out] = row
    return basis.T, uses, bound


Pattern = tuple[dict[int, int], int]


def _named(sizes: np.ndarray, pattern: np.ndarray) -> dict[int, int]:
    return {int(s): int(n) for s, n in zip(sizes, pattern, strict=True) if n}


def _filled(sizes: np.ndarray, pattern: np.ndarray, left: np.ndarray, capacity: int) -> np.ndarray:
    """pattern cut down to what is left, its room filled with the largest sizes left that fit."""
    pattern = np.minimum(pattern, left)
    room = capacity - int((pattern * sizes).sum())
    for k in range(len(sizes) - 1, -1, -1):
        n = min(int(left[k] - pattern[k]), room // int(sizes[k]))
        pattern[k] += n
        room -= n * int(sizes[k])
    return pattern


def plan(histogram: dict[int, int], capacity: int) -> list[Pattern]:
    """histogram (size -> pieces) -> patterns (size -> slots) with how often each is used; slots equal pieces for every size.

    The program's uses are rounded down; what is left is a smaller program, solved again, until all uses are below one. The
    patterns left are then taken once each, in order of use, repaired to what is left.
    """
    sizes = np.array(sorted(histogram), np.int64)
    left = np.array([histogram[s] for s in sizes.tolist()], np.int64)
    out: list[Pattern] = []
    while left.any():
        some = np.flatnonzero(left)
        found, uses, _ = solve_patterns(sizes[some], left[some].astype(float), capacity)
        patterns = np.zeros((len(found), len(sizes)), np.int64)
        patterns[:, some] = found
        order = np.argsort(-uses, kind="stable")
        taken = 0
        for k in order:
            times = int(min(np.floor(uses[k] + 1e-9), (left[patterns[k] > 0] // patterns[k][patterns[k] > 0]).min()))
            if times > 0:
                left = left - patterns[k] * times
                out.append((_named(sizes, patterns[k]), times))
                taken += times
        if taken:
            continue
        for k in order:
            pattern = _filled(sizes, patterns[k], left, capacity)
            if pattern.any():
                left = left - pattern
                out.append((_named(sizes, pattern), 1))
    return out


class Slots:
    """Where the piece of a class and rank goes: sequence and slot."""

    def __init__(self, patterns: list[tuple[dict[int, int], int]]) -> None:
        self.of: dict[int, list[list[int]]] = {}
        first = 0
        for pattern, times in patterns:
            slot = 0
            for size in sorted(pattern, reverse=True):
                self.of.setdefault(size, []).append([first, slot, pattern[size], times * pattern[size]])
                slot += pattern[size]
            first += times
        self.of = {k: np.array(v, np.int64) for k, v in self.of.items()}

    def place(self, size: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, slot = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
        for s in np.unique(size):
            at, table = size == s, self.of[int(s)]
            ends = np.cumsum(table[:, 3])
            k = np.searchsorted(ends, rank[at], "right")
            j = rank[at] - (ends[k] - table[k, 3])
            sequence[at] = table[k, 0] + j // table[k, 2]
            slot[at] = table[k, 1] + j % table[k, 2]
        return sequence, slot


def ranked(pieces: DataFrame, count: int) -> DataFrame:
    """pieces with rank, from 0, within their class; classes are ranked in salted parts."""
    salts = 16 + count // 2_000_000
    tie = F.xxhash64("doc_id", "start", "ids_crc32")
    pieces = pieces.withColumns({"tie": tie, "salt": F.pmod(tie, F.lit(salts))})
    sizes = pieces.groupBy("class", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("class").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = materialize(sizes.select("class", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "bases")
    own = Window.partitionBy("class", "salt").orderBy("tie", "doc_id", "start", "ids_crc32", "doc_tokens")
    pieces = pieces.withColumn("own", F.row_number().over(own) - 1)
    return joined_small(pieces, bases, ["class", "salt"], "inner").withColumn("rank", (F.col("base") + F.col("own")).cast("long")).drop("base", "own", "tie", "salt")


def pack(docs: DataFrame, tokenizer: str | None = None, sequence: int = SEQUENCE) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece."""
    pieces = materialize(cut(docs, tokenizer or default_tokenizer(), sequence), "pieces")
    classed = pieces.withColumn("class", F.when(F.col("length") >= sequence, sequence).otherwise(F.ceil(F.col("length") / CLASS_WIDTH) * CLASS_WIDTH).cast("long"))
    counts = {r["class"]: r["n"] for r in classed.groupBy("class").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most sequence / CLASS_WIDTH rows
    whole = counts.pop(sequence, 0)
    patterns = [({sequence: 1}, whole)] if whole else []
    patterns += [({s * CLASS_WIDTH: n for s, n in p.items()}, times) for p, times in plan({c // CLASS_WIDTH: n for c, n in counts.items()}, sequence // CLASS_WIDTH)]
    slots = Slots(patterns)

    def place(size: pd.Series, rank: pd.Series) -> pd.DataFrame:
        found = slots.place(size.to_numpy(), rank.to_numpy())
        return pd.DataFrame({"sequence_id": found[0], "slot": found[1]})

    placed = ranked(classed, sum(counts.values()) + whole).withColumn("at", F.pandas_udf(place, "sequence_id long, slot long")("class", "rank"))
    placed = placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "at.sequence_id", "at.slot")
    before = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long")).drop("slot")
