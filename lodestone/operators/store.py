"""The point table: deterministic keys, idempotent appends, payload maps and capped scans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Payload fields that filters may name (fixed value).
FILTERABLE = ("source", "project_title", "author", "advisor", "keywords", "year")

#: Up to so many sources of a batch are named in the scan of the point table.
PRUNED_SOURCES = 1_000


def point_key() -> Column:
    return F.sha2(F.concat_ws("\x1f", "source", F.col("page_number").cast("string"), F.col("chunk_index").cast("string"), "content"), 256)


def new_points(chunks: DataFrame, existing: DataFrame | None) -> DataFrame:
    """chunks keyed by content, without keys that the table already has: appending twice changes nothing."""
    keyed = chunks.withColumn("point_id", point_key()).dropDuplicates(["point_id"])
    return keyed if existing is None else keyed.join(existing.select("point_id"), "point_id", "left_anti")


def of_sources(points: DataFrame, chunks: DataFrame) -> DataFrame:
    """Points that may be chunks: those of the same sources, which the table's layout prunes where they are few."""
    named = [r["source"] for r in chunks.select("source").distinct().limit(PRUNED_SOURCES + 1).collect()]
    if len(named) > PRUNED_SOURCES or None in named:
        return points
    return points.filter(F.col("source").isin(named))


def append_points(chunks: DataFrame, path: str) -> None:
    """Appends new points to a Parquet table, laid out so that statistics prune by source and year."""
    spark = chunks.sparkSession
    try:
        existing = spark.read.parquet(path)
    except Exception as missing:  # the table is created on first use
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        existing = None
    fresh = new_points(chunks, existing if existing is None else of_sources(existing, chunks))
    order = [c for c in ("source", "year") if c in fresh.columns]
    fresh.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("append").parquet(path)


def vector_dimensions(points: DataFrame) -> DataFrame:
    """One row: points, least and greatest dimension; they are equal in a sound table."""
    return points.agg(F.count(F.lit(1)).alias("n_points"), F.min(F.size("vector")).alias("min_dim"), F.max(F.size("vector")).alias("max_dim"))


def payload(fields: Sequence[str] = FILTERABLE) -> Column:
    """MAP of the filterable fields, or of some of them."""
    return F.map_from_arrays(F.array(*[F.lit(c) for c in fields]), F.array(*[F.col(c) for c in fields]))


def capped(points: DataFrame, cap: int | None = None) -> DataFrame:
    """project_title, author and advisor of all points, or with a cap of the first by id."""
    df = points.select("point_id", "project_title", "author", "advisor")
    return df if cap is None else df.orderBy("point_id").limit(cap)
