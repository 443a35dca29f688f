"""What several operators share: words, tables, and cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words: space, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share; a local one only where none is set and all tasks run in this process."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = context.getCheckpointDir()
        if not found:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="lodestone-"))
            found = context.getCheckpointDir()
    return found.rstrip("/")


def materialize(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Writes df to the shared folder (in one folder for each value of column by) and reads it back: lineage is cut, a lost executor loses nothing."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def boxed(docs: DataFrame, **keys: Column) -> DataFrame:
    """docs as one column doc beside the keys, so that no column of docs clashes with a helper column."""
    inside = [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]
    return docs.select(F.struct(*inside).alias("doc"), *[k.alias(name) for name, k in keys.items()])


def unboxed(rows: DataFrame) -> DataFrame:
    return rows.select("doc.*")


def words_of(text: Column) -> Column:
    """Words of a text as an array, split at BLANKS; null or blank text: an empty array."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, GAP))


def word_count(text: Column) -> Column:
    """Number of words of a text as long; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def joined_small(left: DataFrame, small: DataFrame, on: list[str], how: str, limit: int = 200_000) -> DataFrame:
    """Joins a table that must already be materialized: broadcast if counted at most limit rows, else shuffled."""
    if small.count() <= limit:
        return left.join(F.broadcast(small), on, how)
    return left.join(small, on, how)
