"""Stored indexes of the point table: payload postings (field, value -> point), and document frequencies of tokens.

Both are built once, written, and extended by what a later write adds; searches read them in place of the whole table.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import cut
from .store import FILTERABLE, payload


def distinct_tokens(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), 1))


def payload_postings(points: DataFrame, fields: Sequence[str] = FILTERABLE) -> DataFrame:
    """field, value, point_id of every filterable field that a point has, or of some of them."""
    return points.select("point_id", F.explode(payload(fields)).alias("field", "value")).filter("value is not null").select("field", "value", "point_id")


def point_tokens(points: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """point_id, token: the distinct tokens of each text, all or those wanted (token)."""
    each = points.select("point_id", F.explode(distinct_tokens(F.col("content"))).alias("token"))
    return each if wanted is None else each.join(wanted, "token", "left_semi").select("point_id", "token")


def token_frequencies(points: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """token, df: how many points' texts hold a token, of all tokens or of those wanted (token)."""
    return point_tokens(points, wanted).groupBy("token").agg(F.count(F.lit(1)).alias("df"))


@dataclass
class PointIndex:
    """postings (field, value, point_id), values (field, value, n), tokens (token, df), n_points; all but the last written tables."""

    postings: DataFrame
    values: DataFrame
    tokens: DataFrame | None
    n_points: int

    @staticmethod
    def build(points: DataFrame, texts: bool = True, fields: Sequence[str] = FILTERABLE) -> PointIndex:
        """texts: with the frequencies of tokens, which filters do not need; fields: those that filters may name."""
        postings = cut(payload_postings(points, fields).repartitionByRange("field", "value").sortWithinPartitions("field", "value"), "postings")
        values = cut(postings.groupBy("field", "value").agg(F.count(F.lit(1)).alias("n")), "values")
        return PointIndex(postings, values, cut(token_frequencies(points), "tokens") if texts else None, points.count())

    def extended(self, fresh: DataFrame) -> PointIndex:
        """With points that the table did not have (store.new_points finds them): only these are read, counts are merged."""
        more = PointIndex.build(fresh, self.tokens is not None)
        values = cut(self.values.union(more.values).groupBy("field", "value").agg(F.sum("n").alias("n")), "values")
        tokens = None if self.tokens is None else cut(self.tokens.union(more.tokens).groupBy("token").agg(F.sum("df").alias("df")), "tokens")
        return PointIndex(self.postings.union(more.postings), values, tokens, self.n_points + more.n_points)

    def members(self, groups: DataFrame) -> DataFrame:
        """groups (grp, filters), each with a field or more -> grp, filters, point_id: points that may fit, by the field that the fewest have.

        An equi-join on (field, value). The other fields are for the caller to test, on these points alone.
        """
        wanted = groups.select("grp", "filters", F.explode("filters").alias("field", "listed")).select("grp", "filters", "field", F.explode(F.array_distinct("listed")).alias("value"))
        sized = wanted.select("grp", "field", "value").join(self.values, ["field", "value"], "left").groupBy("grp", "field").agg(F.sum(F.coalesce("n", F.lit(0))).alias("n"))
        rarest = sized.groupBy("grp").agg(F.min_by("field", F.struct("n", "field")).alias("field"))
        return wanted.join(rarest, ["grp", "field"]).join(self.postings, ["field", "value"]).select("grp", "filters", "point_id")
