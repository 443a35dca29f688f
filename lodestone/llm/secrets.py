"""Secret scans with a trigram inverted index.

Every rule's regular expression is turned into a Boolean query over trigrams that each match must hold (an
AND of ORs of ANDs, or "anything" where a rule has no mandatory trigram). Each segment of documents (at most
SEGMENT_BYTES, or one longer document) gets an inverted index: trigram -> documents, of the trigrams that the rules ask
for. A rule's query is answered by intersecting and uniting postings; only the candidates are scanned with the
expression. Rules without mandatory trigrams scan every document. Texts are folded to ASCII lower case for the
index alone; scans run on the text itself, whole.

Defined cases: null text is the empty text, without spans. Spans are in code points, end exclusive. Matches of
a kind are leftmost and do not overlap; a match that is too short is dropped but still consumed. Kinds may
overlap each other. Repeated rows are scanned each; extra columns pass through redact(); empty tables give
empty tables.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from re import _constants as rc
from re import _parser as rp

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEGMENT_BYTES = 2 << 20
#: A set of alternatives larger than this is not enumerated when trigrams are derived.
MOST_STRINGS = 64
MASK = "[REDACTED]"


@dataclass(frozen=True)
class SecretRule:
    """group: the part that is the secret; least: shortest length of that part (0 is the whole match)."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    fold: bool = False


#: A private key from its first line to its last; where the last is missing, to the end of the runs of base64, with a last short line.
PRIVATE_KEY = (
    r"-----BEGIN (?:[A-Z0-9]+ ){0,3}PRIVATE KEY(?: BLOCK)?-----"
    r"(?:(?:(?!-----BEGIN )[\s\S])*?-----END (?:[A-Z0-9]+ ){0,3}PRIVATE KEY(?: BLOCK)?-----"
    r"|(?:(?:\s|\\[nrt])*(?:Proc-Type|DEK-Info|Version|Comment|Hash): [^\n\\]*)*"
    r"(?:(?:(?:\s|\\[nrt]|[\"',>#|]|\+(?=\s))*[A-Za-z0-9+/=]{16,})+(?:(?:\r?\n|\\n)\x20*[A-Za-z0-9+/]+={0,2}(?=[\x20\t\r]*(?:\n|\\n|[\"']|\Z)))?)?)"
)

#: The base rules of the contract, then those that the method adds.
RULES = (
    SecretRule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, True),
    SecretRule("access", r"AKIA[A-Z0-9]+", 0, 18),
    SecretRule("hex", r"[0-9a-f]+", 0, 16),
    SecretRule("private_key", PRIVATE_KEY),
    SecretRule("hosting_token", r"gh[oprsu]_[A-Za-z0-9]+", 0, 40),
    SecretRule("chat_token", r"xox[abprs]-[A-Za-z0-9-]+", 0, 20),
    SecretRule("cloud_key", r"AIza[A-Za-z0-9_-]+", 0, 39),
    SecretRule("payment_key", r"[rs]k_(?:live|test)_[A-Za-z0-9]+", 0, 24),
    SecretRule("web_token", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    SecretRule("login_url", r"[a-z][a-z0-9+.-]{1,15}://[^\s:/@]*:([^\s/@]+)@", 1, 1),
)
BASE_KINDS = ("assign", "access", "hex")

#: A query: True (any document), a trigram, or ("and" | "or", [queries]).
Query = bool | str | tuple


def _both(op: str, parts: list) -> Query:
    if op == "and":
        parts = [p for p in parts if p is not True]
    elif True in parts:
        return True
    return True if not parts else parts[0] if len(parts) == 1 else (op, parts)


def _of_strings(run: set[str]) -> Query:
    return _both("or", [_both("and", sorted({s[i : i + 3] for i in range(len(s) - 2)})) for s in sorted(run)])


def _strings(seq) -> set[str] | None:
    """All strings that a sequence of nodes can match, folded; None if there are too many."""
    run = {""}
    for op, av in seq:
        if op is rc.LITERAL:
            more = {chr(av).lower()}
        elif op is rc.IN and all(o is rc.LITERAL for o, _ in av):
            more = {chr(x).lower() for _, x in av}
        elif op in (rc.MAX_REPEAT, rc.MIN_REPEAT) and av[1] <= 1:
            inner = _strings(av[2])
            more = None if inner is None else inner | ({""} if av[0] == 0 else set())
        elif op is rc.SUBPATTERN:
            more = _strings(av[3])
        elif op is rc.BRANCH:
            each = [_strings(x) for x in av[1]]
            more = None if None in each else set().union(*each)
        elif op is rc.AT:
            more = {""}
        else:
            more = None
        if more is None or len(run) * len(more) > MOST_STRINGS:
            return None
        run = {a + b for a in run for b in more}
    return run


def _query(seq) -> Query:
    found, run = [], {""}
    for node in seq:
        op, av = node
        more = _strings([node])
        if more is not None and len(run) * len(more) <= MOST_STRINGS:
            run = {a + b for a in run for b in more}
            continue
        found.append(_of_strings(run))
        run = {""} if more is None else more
        if more is None:
            if op is rc.SUBPATTERN:
                found.append(_query(av[3]))
            elif op is rc.BRANCH:
                found.append(_both("or", [_query(x) for x in av[1]]))
            elif op in (rc.MAX_REPEAT, rc.MIN_REPEAT) and av[0] >= 1:
                found.append(_query(av[2]))
    return _both("and", [*found, _of_strings(run)])


def trigram_query(pattern: str) -> Query:
    """The trigrams, folded to lower case, that every match of pattern holds."""
    return _query(rp.parse(pattern))


def _asked(query: Query) -> set[str]:
    return set() if query is True else {query} if isinstance(query, str) else set().union(*map(_asked, query[1]))


class SegmentIndex:
    """Postings of the wanted trigrams over a segment of texts (UTF-8 bytes)."""

    def __init__(self, texts: list[bytes], wanted: dict[str, int], table: np.ndarray) -> None:
        self.size, self.wanted = len(texts), wanted
        joined = np.frombuffer(b"\x00\x00".join(texts).lower(), np.uint8)
        codes = joined[:-2].astype(np.uint32) << 16 | joined[1:-1].astype(np.uint32) << 8 | joined[2:]
        numbers = table[codes]
        at = np.flatnonzero(numbers)
        starts = np.cumsum([0] + [len(t) + 2 for t in texts[:-1]])
        docs = np.searchsorted(starts, at, "right") - 1
        pairs = np.unique(numbers[at].astype(np.int64) * max(self.size, 1) + docs)
        self.number, self.doc = pairs // max(self.size, 1), pairs % max(self.size, 1)

    def postings(self, trigram: str) -> np.ndarray:
        n = self.wanted[trigram]
        return self.doc[np.searchsorted(self.number, n) : np.searchsorted(self.number, n + 1)]

    def candidates(self, query: Query) -> np.ndarray:
        if query is True:
            return np.arange(self.size)
        if isinstance(query, str):
            return self.postings(query)
        found = [self.candidates(q) for q in query[1]]
        out = found[0]
        for more in found[1:]:
            out = np.intersect1d(out, more, assume_unique=True) if query[0] == "and" else np.union1d(out, more)
        return out


class Scanner:
    def __init__(self, rules: tuple[SecretRule, ...] = RULES) -> None:
        self.rules = [(r, re.compile(r.pattern, re.ASCII | (re.IGNORECASE if r.fold else 0)), trigram_query(r.pattern)) for r in rules]
        asked = sorted(set().union(*(_asked(q) for _, _, q in self.rules)))
        self.wanted = {t: i + 1 for i, t in enumerate(asked)}
        self.table = np.zeros(1 << 24, np.uint16)
        for t, i in self.wanted.items():
            b = t.encode("ascii")
            self.table[b[0] << 16 | b[1] << 8 | b[2]] = i

    def scan(self, texts: list[str]) -> list[list[tuple]]:
        """Per text: (start, rank of the kind, end, kind, start and end of the secret itself), sorted."""
        index = SegmentIndex([t.encode("utf-8", "surrogatepass") for t in texts], self.wanted, self.table)
        out: list[list[tuple]] = [[] for _ in texts]
        for rank, (rule, compiled, query) in enumerate(self.rules):
            for d in index.candidates(query):
                for m in compiled.finditer(texts[d]):
                    if m.end(rule.group) - m.start(rule.group) >= rule.least:
                        out[d].append((m.start(), rank, m.end(), rule.kind, m.start(rule.group), m.end(rule.group)))
        for spans in out:
            spans.sort()
        return out


def segments(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """(first position, texts) of runs of at most SEGMENT_BYTES characters, or one longer text."""
    begin, held = 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t) > SEGMENT_BYTES:
            yield begin, texts[begin:i]
            begin, held = i, 0
        held += len(t)
    if begin < len(texts):
        yield begin, texts[begin:]


def _scanned(texts: list[str], scanner: Scanner) -> Iterator[list[tuple]]:
    for _, part in segments(texts):
        yield from scanner.scan(part)


def report(docs: DataFrame, rules: tuple[SecretRule, ...] = RULES) -> DataFrame:
    """Per document: counts of the base kinds, the digest of their spans and all spans."""
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType)] + [T.StructField(f"n_{k}", T.LongType()) for k in BASE_KINDS] + [T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        for batch in batches:
            rows = []
            for spans in _scanned([t or "" for t in batch.column("text").to_pylist()], scanner):
                named = [f"{kind}:{a}:{b}" for a, _, b, kind, _, _ in spans]
                base = [s for s, x in zip(named, spans, strict=True) if x[3] in BASE_KINDS]
                rows.append([sum(x[3] == k for x in spans) for k in BASE_KINDS] + [hashlib.sha256(",".join(base).encode()).hexdigest(), ",".join(named)])
            columns = list(map(list, zip(*rows, strict=True))) if rows else [[] for _ in range(5)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns[:3]), *(pa.array(c, pa.string()) for c in columns[3:])], names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(scan, schema)


def masked(text: str, spans: list[tuple]) -> str:
    """text with every secret (overlapping ones as one) replaced by MASK."""
    out, at = [], 0
    for a, b in sorted((x[4], x[5]) for x in spans):
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], MASK]
        at = b
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, rules: tuple[SecretRule, ...] = RULES) -> DataFrame:
    """docs with the secrets in text masked and n_chars, where there, brought up to date; the columns stay."""
    names, text = docs.columns, docs.columns.index("text")
    numbered = docs.toDF(*[f"c{i}" for i in range(len(names))])  # names that hold dots stop an Arrow function

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        for batch in batches:
            texts = batch.column(text).to_pylist()
            new = [t if t is None else masked(t, s) for t, s in zip(texts, _scanned([t or "" for t in texts], scanner), strict=True)]
            yield batch.set_column(text, batch.schema.field(text), pa.array(new, batch.schema.field(text).type))

    out = numbered.mapInArrow(scan, numbered.schema)
    if "n_chars" in names:
        k = names.index("n_chars")
        out = out.withColumn(f"c{k}", F.length(f"c{text}").cast(docs.schema["n_chars"].dataType))
    return out.toDF(*names)
