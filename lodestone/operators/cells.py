"""Exact top-k that skips cells: points lie in cells with a centre and a radius, and a cell whose best possible score is below a question's k-th is not read.

The cells of a table are built once: centres are a few of its points (those farthest from each other in a sample of SAMPLE points a cell, of least hash), each point belongs to the centre of greatest cosine, the radius
is the greatest angle in the cell. No point of a cell scores above cos(angle to the centre - radius), by the triangle inequality of angles. A question first takes its most
promising cells until they hold k points; their k-th score is its floor; then it takes those cells whose bound reaches the floor. Cosine of zero vectors is 0: they
have a cell of their own that is always read.

Centres and radii are at most MOST_CELLS rows; questions come in blocks, as everywhere. Points are laid out by cell, so that cells not visited are not scanned.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import cut
from .search import DIGITS, TOP_K, _questions, _ranked, _units, blocks_of

MOST_CELLS, SAMPLE = 4096, 8
#: Above the rounding error of cosines and angles.
SLACK = 1e-7
ZERO_CELL = -1


@dataclass
class Cells:
    """points (cell, point_id, vector), written by cell; centres (unit rows), radius and size of each cell from 0; n_zero zero vectors."""

    points: DataFrame
    centres: np.ndarray
    radius: np.ndarray
    sizes: np.ndarray
    n_zero: int

    def bounds(self, vectors: np.ndarray) -> np.ndarray:
        """[question, cell]: no score in the cell is above this."""
        if not len(self.centres):
            return np.empty((len(vectors), 0))
        angle = np.arccos(np.clip(vectors @ self.centres.T, -1.0, 1.0)) - self.radius[None]
        best = np.cos(np.maximum(angle, 0.0)) + SLACK
        best[(vectors == 0).all(1)] = SLACK  # all scores are 0
        return best


def _spread(sample: np.ndarray, n: int) -> np.ndarray:
    """n rows of the sample, each the farthest from those before it, so that no cluster is without a centre near it."""
    chosen, nearest = [], np.full(len(sample), -math.inf)
    for _ in range(min(n, len(sample))):
        chosen.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, sample @ sample[chosen[-1]])
    return sample[sorted(set(chosen))]


def built(points: DataFrame, n_cells: int | None = None) -> Cells:
    """points (point_id, vector) in cells: about the square root of their number."""
    rows = points.select("point_id", "vector")
    n_cells = min(MOST_CELLS, n_cells or max(1, math.isqrt(points.count())))
    least = rows.filter(F.exists("vector", lambda x: x != 0)).orderBy(F.xxhash64("point_id"), "point_id").limit(SAMPLE * n_cells).collect()
    centres = _spread(_units(np.array([r["vector"] for r in least], np.float64).reshape(len(least), -1 if least else 0)), n_cells)

    def placed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if not len(frame):
                continue
            units = _units(np.stack(frame["vector"].to_numpy()).astype(np.float64))
            cell, angle = np.full(len(frame), ZERO_CELL), np.zeros(len(frame))
            some = np.flatnonzero((units != 0).any(1))
            if len(some):
                cosines = units[some] @ centres.T
                cell[some] = cosines.argmax(1)
                angle[some] = np.arccos(np.clip(cosines.max(1), -1.0, 1.0))
            yield pd.DataFrame({"cell": cell.astype(np.int32), "angle": angle, "point_id": frame["point_id"], "vector": frame["vector"]})

    kind = dict(rows.dtypes)
    out = rows.mapInPandas(placed, f"cell int, angle double, point_id {kind['point_id']}, vector {kind['vector']}")
    out = cut(out.repartitionByRange("cell").sortWithinPartitions("cell"), "cells")
    radius, sizes, n_zero = np.zeros(len(centres)), np.zeros(len(centres), np.int64), 0
    for r in out.groupBy("cell").agg(F.max("angle").alias("a"), F.count(F.lit(1)).alias("n")).collect():  # a row for each cell
        if r["cell"] == ZERO_CELL:
            n_zero = r["n"]
        else:
            radius[r["cell"]], sizes[r["cell"]] = r["a"], r["n"]
    return Cells(out.drop("angle"), centres, radius, sizes, n_zero)


def _scored(cells: Cells, ids: np.ndarray, vectors: np.ndarray, asks: dict[int, np.ndarray], k: int) -> DataFrame:
    """Hits of the questions (by place) that each cell is asked by: one block product a cell and batch of its points, k kept of each."""
    kind = dict(cells.points.dtypes)["point_id"]

    def best(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for cell, part in frame.groupby("cell", sort=False):
                who = asks.get(int(cell))
                if who is None:
                    continue
                scores = np.round(vectors[who] @ _units(np.stack(part["vector"].to_numpy()).astype(np.float64)).T, DIGITS)
                points = part["point_id"].to_numpy()
                order = np.lexsort((np.broadcast_to(points, scores.shape), -scores))[:, :k]
                yield pd.DataFrame({"question_id": np.repeat(ids[who], order.shape[1]), "point_id": points[order].ravel(), "score": np.take_along_axis(scores, order, 1).ravel()})

    visited = cells.points.filter(F.col("cell").isin(sorted(asks))) if len(asks) < len(cells.centres) // 2 else cells.points
    return visited.mapInPandas(best, f"question_id long, point_id {kind}, score double")


def _asked(pairs: np.ndarray) -> dict[int, np.ndarray]:
    """[question, cell] marks -> the questions of each cell."""
    return {int(c): np.flatnonzero(pairs[:, c]) for c in np.flatnonzero(pairs.any(0))}


def _block(questions: DataFrame, cells: Cells, k: int) -> tuple[DataFrame, list[tuple[int, int]]]:
    ids, vectors = _questions(questions.select("question_id", "qvec").orderBy("question_id").collect())
    if not len(ids):
        return _ranked(_scored(cells, ids, vectors, {}, k), k), []
    bounds = cells.bounds(vectors)
    order = np.argsort(-bounds, axis=1, kind="stable")
    held = np.cumsum(cells.sizes[order], 1) - cells.sizes[order]  # points in more promising cells
    first = np.zeros(bounds.shape, bool)
    np.put_along_axis(first, order, held < k, 1)
    asks = _asked(first)
    if cells.n_zero:
        asks[ZERO_CELL] = np.arange(len(ids))
    hits = cut(_ranked(_scored(cells, ids, vectors, asks, k), k).select("question_id", "point_id", "score"), "hits")
    floors = np.full(len(ids), -math.inf)
    place = {int(q): i for i, q in enumerate(ids)}
    for r in hits.groupBy("question_id").agg(F.min("score").alias("s"), F.count(F.lit(1)).alias("n")).collect():  # a row for each question of the block
        if r["n"] >= k:
            floors[place[r["question_id"]]] = r["s"]
    second = (bounds >= floors[:, None]) & ~first
    if second.any():
        hits = hits.union(_scored(cells, ids, vectors, _asked(second), k))
    return _ranked(hits, k), [(int(q), int(n)) for q, n in zip(ids, (first | second).sum(1), strict=True)]


def topk(questions: DataFrame, cells: Cells, k: int = TOP_K) -> tuple[DataFrame, DataFrame]:
    """questions (question_id, qvec) -> the k best points each, as semantic_topk; and how many cells each visited (question_id, visited, cells)."""
    blocks = [_block(b, cells, k) for b in blocks_of(questions)]
    hits = [h for h, _ in blocks] if len(blocks) == 1 else [cut(h, "hits") for h, _ in blocks]
    visits = [(q, n, len(cells.centres)) for _, rows in blocks for q, n in rows]
    return reduce(DataFrame.unionByName, hits), questions.sparkSession.createDataFrame(visits, "question_id long, visited int, cells int")
