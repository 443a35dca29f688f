"""Recursive splitting of page texts into overlapping chunks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .text import has_text

SIZE, OVERLAP = 1000, 150
#: Coarse to fine: paragraph, line, word, character.
SEPARATORS = ("\n\n", "\n", " ", "")


def _pieces(text: str, separator: str) -> list[str]:
    """text cut so that each piece after the first starts with the separator."""
    if not separator:
        return list(text)
    first, *rest = text.split(separator)
    return [p for p in (first, *(separator + r for r in rest)) if p]


def _merged(pieces: list[str], size: int, overlap: int) -> Iterator[str]:
    held: list[str] = []
    total = 0
    for piece in pieces:
        if held and total + len(piece) > size:
            if whole := "".join(held).strip():
                yield whole
            while held and (total > overlap or total + len(piece) > size):
                total -= len(held.pop(0))
        held.append(piece)
        total += len(piece)
    if whole := "".join(held).strip():
        yield whole


def split_text(text: str, size: int = SIZE, overlap: int = OVERLAP, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Chunks of at most size characters that share up to overlap characters with the one before."""
    at = next(i for i, s in enumerate(separators) if s in text)
    out: list[str] = []
    small: list[str] = []
    for piece in _pieces(text, separators[at]):
        if len(piece) < size:
            small.append(piece)
            continue
        out += _merged(small, size, overlap)
        small = []
        finer = separators[at + 1 :]
        out += split_text(piece, size, overlap, finer) if finer else [piece]
    return out + list(_merged(small, size, overlap))


def chunked(pages: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """One row per chunk with its page's columns and chunk_index; blank pages have none."""
    return chunked_or_failed(pages, lambda t: split_text(t, size, overlap), False)


def chunked_or_failed(pages: DataFrame, split: Callable[[str], list[str]] = split_text, failures: bool = True) -> DataFrame:
    """chunked with a column error: a page that cannot be split is one row without content, with what went wrong; others go on."""
    pages = pages.filter(has_text(pages["content"]))
    more = [T.StructField("chunk_index", T.IntegerType())] + [T.StructField("error", T.StringType())] * failures
    schema = T.StructType([*pages.schema.fields, *more])

    def tried(text: str) -> tuple[list, str | None]:
        try:
            return split(text), None
        except Exception as error:
            if not failures:
                raise
            return [None], f"{type(error).__name__}: {error}"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            parts = [tried(t) for t in frame["content"]]
            frame = frame.assign(content=[c for c, _ in parts], chunk_index=[list(range(len(c))) for c, _ in parts])
            if failures:
                frame["error"] = [e for _, e in parts]
            frame = frame.explode(["content", "chunk_index"]).dropna(subset=["chunk_index"])
            yield frame.astype({"chunk_index": "int32"})

    return pages.mapInPandas(run, schema)
