"""Sources and pages: selecting files, page tables, previews and the outcome of an ingest."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import has_text
from ..sources.tables import numbered


def select_sources(files: DataFrame, mode: str = "all", names: tuple[str, ...] = (), limit: int = 10) -> DataFrame:
    """files (source) that end in .pdf: all, those named, or the first by name."""
    found = files.select("source").distinct().filter(F.col("source").endswith(".pdf"))
    if mode == "specific":
        return found.filter(F.col("source").isin(*names))
    return found.orderBy("source").limit(limit) if mode == "limit" else found


def page_table(documents: DataFrame) -> DataFrame:
    """One row per page with text; page_number and total_pages count blank pages too.

    A source of any size is numbered in ranges, by its ids alone; numbers and texts meet in a join by id, the one shuffle of the texts.
    Blank pages need no text, so they end before it. Rows that repeat an id get its numbers in any order.
    """
    ids = numbered(documents.select("source", "doc_id", has_text(F.col("text")).alias("_full")), "source", [F.col("doc_id"), F.col("_full").desc()])
    key = F.struct("source", "doc_id")  # equal where both are, nulls too; join and window share its partitioning
    ids = ids.groupBy(key.alias("_key")).agg(F.min("nth").alias("_first"), F.first("n_all").alias("_all"), F.max("_full").alias("_any"))
    texts = documents.select("source", key.alias("_key"), F.col("text").alias("content")).filter(has_text(F.col("content")))
    df = texts.join(ids.filter("_any"), "_key")
    nth = F.col("_first") + F.row_number().over(Window.partitionBy("_key").orderBy("_key"))
    return df.select("source", nth.cast("int").alias("page_number"), F.col("_all").cast("int").alias("total_pages"), "content")


def drop_blank(pages: DataFrame) -> DataFrame:
    return pages.filter(has_text(F.col("content")))


def preview(chunks: DataFrame, n: int = 3, chars: int = 100) -> DataFrame:
    """The first chunks in order, cut."""
    return chunks.orderBy("source", "page_number", "chunk_index").limit(n).select("source", "page_number", "chunk_index", F.substring("content", 1, chars).alias("head"))


def ingest_report(sources: DataFrame, pages: DataFrame, chunks: DataFrame, points: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """Counts and outcome per source; a source without pages has outcome no_pages, one in errors (source) has error."""
    count = lambda df, name: df.groupBy("source").agg(F.count(F.lit(1)).alias(name))
    df = sources
    for part, name in ((pages, "n_pages"), (chunks, "n_chunks"), (points, "n_points")):
        df = df.join(count(part, name), "source", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    if errors is None:
        df = df.withColumn("_failed", F.lit(None).cast("boolean"))
    else:
        df = df.join(errors.select("source").distinct().withColumn("_failed", F.lit(True)), "source", "left")
    return df.withColumn("outcome", F.when(F.col("_failed"), "error").when(F.col("n_pages") == 0, "no_pages").when(F.col("n_points") == 0, "nothing_written").otherwise("written")).drop("_failed")
