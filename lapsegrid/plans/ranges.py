"""Range joins as bucketed equi-joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def buckets_touched(lo: Column, hi: Column, width: float) -> Column:
    return F.sequence(F.floor(lo / F.lit(width)).cast("long"), F.floor(hi / F.lit(width)).cast("long"))


def overlap_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_span: tuple[str, str],
    right_span: tuple[str, str],
    width: float,
) -> DataFrame:
    """Pairs of half-open intervals with a positive intersection, each pair once.

    Both sides are spread over the time buckets they touch; the pair is kept only in the bucket where
    the intersection starts. ``width`` should be near the longest common interval.
    """
    keys = list(keys)
    l_lo, l_hi = left_span
    r_lo, r_hi = right_span
    a = left.withColumn("__slot", F.explode(buckets_touched(F.col(l_lo), F.col(l_hi), width)))
    b = right.withColumn("__slot", F.explode(buckets_touched(F.col(r_lo), F.col(r_hi), width)))
    start = F.greatest(F.col(l_lo), F.col(r_lo))
    joined = a.join(b, [*keys, "__slot"]).where((F.col(l_lo) < F.col(r_hi)) & (F.col(r_lo) < F.col(l_hi)))
    return (
        joined.where(F.floor(start / F.lit(width)).cast("long") == F.col("__slot"))
        .withColumn("lo", start)
        .withColumn("hi", F.least(F.col(l_hi), F.col(r_hi)))
        .drop("__slot")
    )


def point_in_range(
    points: DataFrame, ranges: DataFrame, keys: Sequence[str], at: str, span: tuple[str, str], width: float
) -> DataFrame:
    """Rows of ``points`` with ``lo <= at < hi`` for a range of the same keys."""
    keys = list(keys)
    lo, hi = span
    p = points.withColumn("__slot", F.floor(F.col(at) / F.lit(width)).cast("long"))
    r = ranges.withColumn("__slot", F.explode(buckets_touched(F.col(lo), F.col(hi), width)))
    return (
        p.join(r, [*keys, "__slot"]).where((F.col(at) >= F.col(lo)) & (F.col(at) < F.col(hi))).drop("__slot")
    )
