"""Measured group sizes: one-task-per-key plans are used only where every key was seen to be small."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

LIMIT_SETTING = "lapsegrid.heavyKeyRows"
DEFAULT_LIMIT = 1_000_000


def limit_of(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get(LIMIT_SETTING, str(DEFAULT_LIMIT)))


def has_heavy_key(df: DataFrame, keys: Sequence[str]) -> bool:
    """True if some key holds more rows than one task should take.

    One partial-aggregated count; its shuffle carries one row per key and task. The answer picks
    between a plain window (one shuffle) and the bucketed two-level plan.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    largest = counts.agg(F.max("n")).first()[0]
    return largest is not None and largest > limit_of(df)
