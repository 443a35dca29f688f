"""Latency summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import cut, numbered


#: The streamed sketch keeps this accuracy: a percentile's rank is off by at most one in so many of the values.
SKETCH_ACCURACY = 10_000


def weighted_ranks(df: DataFrame, by: str, value: str) -> DataFrame:
    """by, v, first, last, n_all: each distinct value of a group with the ranks (from 0) that it takes among the group's n_all values.

    Equal values are counted before anything is dealt by value, then distinct values are sorted in ranges by many tasks: neither a hot
    group nor a hot value is one task. Ranges are written, so that a range's number holds; one row is known of each for each group in it.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(F.col(by).alias("_by"), F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("_m"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = cut(counts.repartitionByRange(parts, "_by", "v").withColumn("_range", F.spark_partition_id()), "ranges")
    group = Window.partitionBy("_by")
    sizes = ranges.groupBy("_by", "_range").agg(F.sum("_m").alias("_n"))
    sizes = sizes.select(F.col("_by").alias("_g"), F.col("_range").alias("_r"), F.coalesce(F.sum("_n").over(group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"), F.sum("_n").over(group).alias("n_all"))
    upto = F.sum("_m").over(Window.partitionBy("_by", "_range").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    out = ranges.withColumn("_upto", upto).join(sizes, F.col("_by").eqNullSafe(F.col("_g")) & (F.col("_range") == F.col("_r")))
    return out.select(F.col("_by").alias(by), "v", (F.col("_base") + F.col("_upto") - F.col("_m")).alias("first"), (F.col("_base") + F.col("_upto") - 1).alias("last"), "n_all")


def percentiles(timings: DataFrame, by: str, value: str, ps: tuple[float, ...] = (50, 90, 95, 99)) -> DataFrame:
    """Exact percentiles of each group: linear interpolation at (n - 1) * p / 100; no values: 0."""
    def at(p: float) -> Column:
        spot = (F.col("n_all") - 1) * (p / 100)
        low = F.floor(spot)
        high = F.least(low + 1, F.col("n_all") - 1)
        share = spot - low
        holds = lambda rank: (F.col("first") <= rank) & (F.col("last") >= rank)
        return F.sum(F.when(holds(low), F.col("v") * (1 - share)).otherwise(0.0) + F.when(holds(high), F.col("v") * share).otherwise(0.0))

    found = weighted_ranks(timings, by, value).groupBy(F.col(by).alias("_k")).agg(*[at(p).alias(f"p{p:g}") for p in ps])
    groups = timings.select(by).distinct()
    return groups.join(found, F.col(by).eqNullSafe(F.col("_k")), "left").select(by, *[F.coalesce(f"`p{p:g}`", F.lit(0.0)).alias(f"p{p:g}") for p in ps])


def _moments(value: str) -> list[Column]:
    total = F.sum(value)
    return [F.count(value).alias("n"), F.avg(value).alias("mean_s"), F.min(value).alias("min_s"), F.max(value).alias("max_s"), F.when(total > 0, F.count(value) / total).alias("qps"), F.stddev_samp(value).alias("stddev_s")]


_SUMMARY = ("n", "mean_s", "median_s", "min_s", "max_s", "p90_s", "p95_s", "qps", "stddev_s")


def sketched_columns(value: str) -> list[Column]:
    """The summary with percentiles of a mergeable sketch of bounded size, for streams (T3); values, not interpolations."""
    held = F.percentile_approx(value, F.array(F.lit(0.5), F.lit(0.9), F.lit(0.95)), F.lit(SKETCH_ACCURACY))
    at = lambda i: F.coalesce(F.get(held, F.lit(i)).cast("double"), F.lit(0.0))
    return [*_moments(value), at(0).alias("median_s"), at(1).alias("p90_s"), at(2).alias("p95_s")]


def summary(timings: DataFrame, by: str, value: str) -> DataFrame:
    """Count, mean, median, extremes, p90, p95, rate and sample deviation."""
    exact = percentiles(timings, by, value, (50, 90, 95)).select(F.col(by).alias("_k"), F.col("p50").alias("median_s"), F.col("p90").alias("p90_s"), F.col("p95").alias("p95_s"))
    return timings.groupBy(by).agg(*_moments(value)).join(exact, F.col(by).eqNullSafe(F.col("_k"))).select(by, *_SUMMARY)


def ingest_summary(timings: DataFrame, by: str, value: str) -> DataFrame:
    """As the ingest report defines it: zero durations dropped, p90 and p95 are the element at floor(p * n).

    A group of any size is ranked in ranges of its values, by many tasks; the median is the mean of its middle elements.
    """
    df = numbered(timings.filter(F.col(value) > 0).select(by, F.col(value).alias("v")), by, [F.col("v")])
    df = df.select(by, "v", F.col("nth").alias("r"), F.col("n_all").alias("n"))
    middle = F.avg(F.when((F.col("r") == F.floor((F.col("n") - 1) / 2)) | (F.col("r") == F.floor(F.col("n") / 2)), F.col("v")))
    at = lambda p: F.max(F.when(F.col("r") == F.least(F.floor(F.col("n") * p), F.col("n") - 1), F.col("v")))
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("total_s"), F.avg("v").alias("mean_s"), middle.alias("median_s"), F.min("v").alias("min_s"), F.max("v").alias("max_s"), at(0.9).alias("p90_s"), at(0.95).alias("p95_s"))


def stage_totals(timings: DataFrame, key: str = "user") -> DataFrame:
    """Seconds per stage and in total for each key."""
    return timings.groupBy(key).agg(F.sum("seconds").alias("total_s"), F.count(F.lit(1)).alias("n_stages"))
