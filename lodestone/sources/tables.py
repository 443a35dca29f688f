"""Written tables that cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share; a local one only where none is set and all tasks run in this process."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="lodestone-"))
        found = context.getCheckpointDir()
    return found.rstrip("/")


def cut(df: DataFrame, name: str = "step") -> DataFrame:
    """Writes df to the shared checkpoint folder and reads it back: later steps that use it twice do not plan it twice."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *by: str | Column) -> DataFrame:
    """df dealt by columns to as many tasks as a shuffle has parts, however few bytes it has: for steps that make many rows, or much work, of each."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def numbered(df: DataFrame, by: str, order: list[Column]) -> DataFrame:
    """df with nth (from 0, in order within by) and n_all: a group of any size is sorted in ranges, by many tasks.

    Ranges are written, so that a range's number holds; what is known of each is one row for each group in it.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = cut(df.repartitionByRange(parts, F.col(by), *order).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = ranges.groupBy(by, "_range").agg(F.count(F.lit(1)).alias("_n"))
    group = Window.partitionBy(by)
    before = group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(F.col(by).alias("_by"), F.col("_range").alias("_r"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"), F.sum("_n").over(group).alias("n_all"))
    own = F.row_number().over(Window.partitionBy(by, "_range").orderBy(*order)) - 1
    out = ranges.withColumn("_own", own).join(sizes, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_range") == F.col("_r")))
    return out.withColumn("nth", (F.col("_base") + F.col("_own")).cast("long")).drop("_by", "_r", "_range", "_base", "_own")
