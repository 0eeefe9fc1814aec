"""Exact ranks and quantiles for groups of any size.

The built-in exact ``percentile`` keeps every distinct value of a group in one buffer, so it is used only
after the largest group has been measured and found small. Beyond that, values are first counted per (key, value), cut into buckets along a bounded sketch of the key's own distribution,
and only running counts cross buckets. Results are exact: the sketch decides where work is done, never
what is returned.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from lapsegrid.plans.durable import cut
from lapsegrid.plans.heavy import has_heavy_key
from lapsegrid.plans.scan import ordered_scan

VALUES_PER_BUCKET = 1_000_000
CUTS = 512


def value_positions(df: DataFrame, keys: Sequence[str], value: str, values_per_bucket: int = VALUES_PER_BUCKET) -> DataFrame:
    """One row per (keys, value): ``ties``, ``before`` (rows below it) and ``total`` rows of the key."""
    keys = list(keys)
    # Written once: later steps meet again on the value and its bucket, and a value computed twice from
    # floating sums may differ in its last bit.
    counts = cut(df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("ties")))
    summary = counts.groupBy(*keys).agg(F.count(F.lit(1)).alias("__distinct"), F.sum("ties").alias("total"))
    # Only keys with many distinct values are sketched and cut; there are at most rows / limit of them.
    heavy = summary.where(F.col("__distinct") > values_per_bucket).select(*keys)
    cuts = counts.join(heavy, keys).groupBy(*keys).agg(
        F.percentile_approx(value, [i / CUTS for i in range(1, CUTS)], 10000).alias("__cuts")
    )
    summary = summary.join(cuts, keys, "left")
    placed = counts.join(summary, keys)
    bucket = F.when(F.col("__cuts").isNull(), F.lit(0)).otherwise(
        F.size(F.filter("__cuts", lambda c: c < F.col(value)))
    )
    placed = placed.withColumn("__slot", bucket.cast("long")).drop("__cuts", "__distinct")
    scanned = ordered_scan(placed, keys, [value], F.col("__slot"), running={"__upto": ("sum", "ties")}, two_level=True)
    return scanned.select(*keys, value, "ties", (F.col("__upto") - F.col("ties")).alias("before"), "total")


def quantile_columns(metrics: Sequence[str], wanted: dict[str, float]) -> list[Column]:
    """Built-in exact quantiles as aggregate columns, for groups measured to be small."""
    return [F.percentile(F.col(m).cast("double"), F.lit(float(q))).alias(f"{m}_{a}") for m in metrics for a, q in wanted.items()]


def metric_quantiles(
    df: DataFrame, keys: Sequence[str], metrics: Sequence[str], wanted: dict[str, float], two_level: bool | None = None
) -> DataFrame:
    """Linear-interpolated exact quantiles of several columns per key; columns ``<metric>_<alias>``."""
    keys = list(keys)
    if two_level is None:
        two_level = has_heavy_key(df, keys)
    if not two_level:
        return df.groupBy(*keys).agg(*quantile_columns(metrics, wanted))
    slim = df.select(*keys, *[F.col(m).cast("double").alias(m) for m in metrics])
    long = slim.unpivot(keys, list(metrics), "__metric", "__value")
    positions = value_positions(long, [*keys, "__metric"], "__value")
    at = {a: (F.col("total") - 1) * F.lit(float(q)) for a, q in wanted.items()}

    def holds(target):
        return (F.col("before") <= target) & (target < F.col("before") + F.col("ties"))

    aggs = [F.max("total").alias("total")]
    for a in wanted:
        aggs.append(F.max(F.when(holds(F.floor(at[a])), F.col("__value"))).alias(f"__lo_{a}"))
        aggs.append(F.max(F.when(holds(F.ceil(at[a])), F.col("__value"))).alias(f"__hi_{a}"))
    picked = positions.groupBy(*keys, "__metric").agg(*aggs)
    for a in wanted:
        lo, hi = F.col(f"__lo_{a}"), F.col(f"__hi_{a}")
        picked = picked.withColumn(a, lo + (hi - lo) * (at[a] - F.floor(at[a])))
    return picked.groupBy(*keys).agg(
        *[F.max(F.when(F.col("__metric") == m, F.col(a))).alias(f"{m}_{a}") for m in metrics for a in wanted]
    )


def quantiles(
    df: DataFrame, keys: Sequence[str], value: str, wanted: dict[str, float], two_level: bool | None = None
) -> DataFrame:
    """Exact quantiles of one column per key, plus ``total`` as the number of its non-null values."""
    keys = list(keys)
    if not keys:
        return quantiles(df.withColumn("__all", F.lit(0)), ["__all"], value, wanted, two_level).drop("__all")
    if two_level is None:
        two_level = has_heavy_key(df, keys)
    present = df.where(F.col(value).isNotNull())
    if not two_level:
        return present.groupBy(*keys).agg(
            F.count(value).alias("total"),
            *[F.percentile(F.col(value).cast("double"), F.lit(float(q))).alias(a) for a, q in wanted.items()],
        )
    totals = present.groupBy(*keys).agg(F.count(value).alias("total"))
    found = metric_quantiles(present.withColumn("__v", F.col(value)), keys, ["__v"], wanted, True)
    return totals.join(found.select(*keys, *[F.col(f"__v_{a}").alias(a) for a in wanted]), keys)


def with_average_rank(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    alias: str,
    extra: dict[str, str] | None = None,
    two_level: bool | None = None,
) -> DataFrame:
    """Average rank (1-based) of each row's value in its key; NULL values get no rank.

    ``extra`` maps ``ties`` / ``before`` / ``total`` to further output names.
    """
    keys, extra = list(keys), extra or {}
    if two_level is None:
        two_level = has_heavy_key(df, keys)
    if not two_level:
        # NULLs sort last, so they never enter the ranks of real values
        order = Window.partitionBy(*keys).orderBy(F.col(value).asc_nulls_last())
        parts = {
            "ties": F.count(F.lit(1)).over(Window.partitionBy(*keys, value)),
            "before": (F.rank().over(order) - 1).cast("long"),
            "total": F.count(value).over(Window.partitionBy(*keys)),
        }
        known = F.col(value).isNotNull()
        return df.select(
            "*",
            F.when(known, parts["before"] + (parts["ties"] + 1) / 2.0).alias(alias),
            *[F.when(known, parts[c]).alias(n) for c, n in extra.items()],
        )
    df = cut(df)
    picked = value_positions(df, keys, value).select(
        *keys,
        value,
        (F.col("before") + (F.col("ties") + 1) / 2.0).alias(alias),
        *[F.col(c).alias(n) for c, n in extra.items()],
    )
    return df.join(picked, [*keys, value], "left")
