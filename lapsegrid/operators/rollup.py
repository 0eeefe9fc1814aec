"""Roll-ups per entity, frame, recording and declared window."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from lapsegrid.functions.numeric import ratio
from lapsegrid.plans.heavy import has_heavy_key
from lapsegrid.plans.ranks import metric_quantiles, quantile_columns, quantiles

ENTITY = ["stem", "identity"]


@dataclass(frozen=True)
class DeclaredWindow:
    """Half-open window ``from <= x < to`` in hours or frames, optionally against a baseline window."""

    name: str
    start: float
    stop: float
    unit: str = "hours"
    baseline: str | None = None

    def holds(self) -> Column:
        at = F.col("hours" if self.unit == "hours" else "frame_index")
        return (at >= F.lit(self.start)) & (at < F.lit(self.stop))


def in_windows(df: DataFrame, windows: Sequence[DeclaredWindow]) -> DataFrame:
    """One copy of a row for each declared window holding it. The declared list is small and fixed by the
    caller, so membership is an expression on the row and needs no join."""
    names = F.array_compact(F.array(*[F.when(w.holds(), F.lit(w.name)) for w in windows]))
    return df.withColumn("window", F.explode(names))


def summarise(df: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Median, inter-quartile range, mean and sample deviation of each metric, with the observed span."""
    keys = list(keys)
    wanted = {"q25": 0.25, "median": 0.5, "q75": 0.75}
    heavy = has_heavy_key(df, keys)
    # small groups: quantiles ride in the same aggregate as everything else
    inline = [] if heavy else quantile_columns(metrics, wanted)
    basics = df.groupBy(*keys).agg(
        *inline,
        F.count(F.lit(1)).alias("observed_frames"),
        F.min("frame_index").alias("first_frame_index"),
        F.max("frame_index").alias("last_frame_index"),
        F.min("hours").alias("first_hour"),
        F.max("hours").alias("last_hour"),
        *[F.avg(m).alias(f"{m}_mean") for m in metrics],
        *[F.stddev_samp(m).alias(f"{m}_sd") for m in metrics],
    )
    if heavy:
        basics = basics.join(metric_quantiles(df, keys, metrics, wanted, True), keys, "left")
    span = F.col("last_frame_index") - F.col("first_frame_index") + 1
    return (
        basics.withColumn("span_frames", span.cast("long"))
        .withColumn("gap_frames", (span - F.col("observed_frames")).cast("long"))
        .withColumn("coverage", ratio("observed_frames", span))
        .withColumns({f"{m}_iqr": F.col(f"{m}_q75") - F.col(f"{m}_q25") for m in metrics})
        .drop(*[f"{m}_{q}" for m in metrics for q in ("q25", "q75")])
    )


def entity_rollup(observations: DataFrame, metrics: Sequence[str]) -> DataFrame:
    return summarise(observations, ENTITY, metrics)


def frame_rollup(observations: DataFrame, frames: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Per frame of the clock: entities present, median and mean of each metric; empty frames stay."""
    keys = ["stem", "frame_index"]
    heavy = has_heavy_key(observations, keys)
    inline = [] if heavy else quantile_columns(metrics, {"median": 0.5})
    basics = observations.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("entities"), *[F.avg(m).alias(f"{m}_mean") for m in metrics], *inline
    )
    if heavy:
        basics = basics.join(metric_quantiles(observations, keys, metrics, {"median": 0.5}, True), keys, "left")
    return (
        frames.join(basics, keys, "left")
        .withColumn("entities", F.coalesce(F.col("entities"), F.lit(0).cast("long")))
    )


def recording_rollup(entities: DataFrame, observations: DataFrame, recordings: DataFrame) -> DataFrame:
    """One flat row per recording; ``recordings`` gives the length of each clock."""
    per_frame = observations.groupBy("stem", "frame_index").agg(F.count(F.lit(1)).alias("present"))
    frame_part = per_frame.groupBy("stem").agg(
        F.count(F.lit(1)).alias("frames_with_data"), F.max("present").alias("most_present")
    )
    medians = quantiles(per_frame.withColumn("present", F.col("present").cast("double")), ["stem"], "present", {"median_present": 0.5})
    entity_part = entities.join(recordings.select("stem", "n_frames"), "stem").groupBy("stem").agg(
        F.count(F.lit(1)).alias("entities"),
        F.sum("observed_frames").alias("observations"),
        F.sum("gap_frames").alias("gap_frames"),
        F.sum((F.col("observed_frames") == F.col("n_frames")).cast("long")).alias("present_every_frame"),
        F.min("first_frame_index").alias("first_frame_index"),
        F.max("last_frame_index").alias("last_frame_index"),
    )
    return entity_part.join(frame_part, "stem").join(medians.drop("total"), "stem")


def windowed_rollup(observations: DataFrame, windows: Sequence[DeclaredWindow], metrics: Sequence[str], hours_per_frame: float) -> DataFrame:
    """Entity roll-up inside each declared window; a window without observations gives no row."""
    inside = summarise(in_windows(observations, windows), [*ENTITY, "window"], metrics)
    length = F.coalesce(
        *[
            F.when(
                F.col("window") == w.name,
                F.lit(float(w.stop - w.start) * (1.0 if w.unit == "hours" else hours_per_frame)),
            )
            for w in windows
        ]
    )
    return (
        inside.withColumn("window_hours", length)
        .withColumn("window_frames", F.ceil(F.col("window_hours") / F.lit(hours_per_frame)).cast("long"))
        .withColumn("window_coverage", ratio("observed_frames", "window_frames"))
    )


def window_changes(rolled: DataFrame, windows: Sequence[DeclaredWindow], statistics: Sequence[str]) -> DataFrame:
    """Each window's statistic against its baseline window: value, baseline, difference, ratio. An entity
    missing from either window has no row."""
    keys = [*ENTITY, "statistic"]
    long = rolled.select(*ENTITY, "window", *statistics).unpivot(
        [*ENTITY, "window"], list(statistics), "statistic", "value"
    ).where(F.col("value").isNotNull())
    # windows are a declared list: one row per entity holds all of them, so no self-join is needed
    wide = long.groupBy(*keys).agg(*[F.max(F.when(F.col("window") == w.name, F.col("value"))).alias(f"__{w.name}") for w in windows])
    pairs = F.array(*[
        F.struct(F.lit(w.name).alias("window"), F.col(f"__{w.name}").alias("value"), F.lit(w.baseline).alias("baseline_window"), F.col(f"__{w.baseline}").alias("baseline"))
        for w in windows if w.baseline
    ])
    return (
        wide.select(*keys, F.inline(pairs)).where(F.col("value").isNotNull() & F.col("baseline").isNotNull())
        .withColumn("difference", F.col("value") - F.col("baseline"))
        .withColumn("ratio", ratio("value", "baseline"))
    )


def scaled_changes(changes: DataFrame, baselines: DataFrame, minimum_coverage: float) -> DataFrame:
    """Change as a fraction of the population's median baseline. A statistic whose population baseline has a
    nonpositive median or lower quartile is left out, as are rows under the coverage floor."""
    wide = quantiles(baselines, ["stem", "statistic"], "baseline", {"population_q25": 0.25, "population_median": 0.5})
    kept = wide.where((F.col("population_median") > 0) & (F.col("population_q25") > 0)).drop("total")
    return (
        changes.where(F.col("window_coverage") >= minimum_coverage)
        .join(kept, ["stem", "statistic"])
        .withColumn("scaled_change", ratio("difference", "population_median"))
    )


def trait_ratio(entities: DataFrame, group: Sequence[str], metric: str, low: float = 0.5, high: float = 1.0) -> DataFrame:
    """Median spread inside entities over the spread between entity medians, with its class."""
    group = list(group)
    between = quantiles(entities, group, f"{metric}_median", {"b25": 0.25, "b75": 0.75})
    within = quantiles(entities, group, f"{metric}_iqr", {"within_iqr": 0.5}).drop("total")
    share = F.col("ratio")
    return (
        between.join(within, group)
        .withColumn("between_iqr", F.col("b75") - F.col("b25"))
        .withColumn("ratio", ratio("within_iqr", "between_iqr"))
        .withColumn(
            "trait_class",
            F.when(share.isNull(), F.lit("undefined"))
            .when(share < low, F.lit("trait-like"))
            .when(share <= high, F.lit("mixed"))
            .otherwise(F.lit("state-like")),
        )
        .withColumnRenamed("total", "entities")
        .drop("b25", "b75")
    )


def histogram(df: DataFrame, keys: Sequence[str], value: str, edges: Sequence[float]) -> DataFrame:
    """Counts between declared edges; empty bins are rows, the last edge belongs to the last bin, values
    outside all edges are not counted. The bin list is declared, so it is exploded, not joined."""
    keys = list(keys)
    v = F.col(value)
    index = F.when(v == edges[-1], F.lit(len(edges) - 2)).otherwise(
        sum(((v >= e).cast("int") for e in edges), F.lit(0)) - 1
    )
    hits = df.where((v >= edges[0]) & (v <= edges[-1])).groupBy(*keys, index.cast("int").alias("bin")).agg(
        F.count(F.lit(1)).alias("n")
    )
    grid = df.select(*keys).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(len(edges) - 2))))
    bounds = F.array(*[F.lit(float(e)) for e in edges])
    return (
        grid.join(hits, [*keys, "bin"], "left")
        .withColumn("lo", F.element_at(bounds, F.col("bin") + 1))
        .withColumn("hi", F.element_at(bounds, F.col("bin") + 2))
        .withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    )


def even_histogram(df: DataFrame, keys: Sequence[str], value: str, bins: int, log: bool = False) -> DataFrame:
    """Histogram over each key's own range, linear or in equal log steps (positive values only)."""
    keys = list(keys)
    usable = df.where(F.col(value).isNotNull() & ((F.col(value) > 0) if log else F.lit(True)))
    scaled = usable.withColumn("__v", F.ln(value) if log else F.col(value).cast("double"))
    span = scaled.groupBy(*keys).agg(F.min("__v").alias("__lo"), F.max("__v").alias("__hi"))
    width = (F.col("__hi") - F.col("__lo")) / F.lit(float(bins))
    place = F.when(F.col("__hi") == F.col("__lo"), F.lit(0)).otherwise(
        F.least(F.floor(F.try_divide(F.col("__v") - F.col("__lo"), width)), F.lit(bins - 1))
    )
    hits = scaled.join(span, keys).groupBy(*keys, place.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    grid = span.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    lo = F.col("__lo") + F.col("bin") * width
    hi = F.col("__lo") + (F.col("bin") + 1) * width
    return (
        grid.join(hits, [*keys, "bin"], "left")
        .select(
            *keys,
            "bin",
            (F.exp(lo) if log else lo).alias("lo"),
            (F.exp(hi) if log else hi).alias("hi"),
            F.coalesce("n", F.lit(0).cast("long")).alias("n"),
        )
    )


def unit_ledger(df: DataFrame, group: Sequence[str], unit: Sequence[str], value: str, how: str) -> DataFrame:
    """Several rows per unit reduced to one by mean or median; the unit is always named by the caller."""
    keys = [*group, *unit]
    if how == "mean":
        return df.where(F.col(value).isNotNull()).groupBy(*keys).agg(
            F.avg(value).alias("unit_value"), F.count(value).alias("rows")
        )
    if how == "median":
        return quantiles(df, keys, value, {"unit_value": 0.5}).withColumnRenamed("total", "rows")
    raise ValueError(f"unknown aggregate {how}")


def two_stage_mean(df: DataFrame, inner: Sequence[str], outer: Sequence[str], value: str, minimum: int = 1) -> DataFrame:
    """Mean of means with equal weight at each stage and counts of what was eligible."""
    first = df.groupBy(*outer, *inner).agg(
        F.avg(value).alias("__mean"), F.count(value).alias("__n"), F.count(F.lit(1)).alias("__rows")
    )
    good = F.col("__n") >= minimum
    return first.groupBy(*outer).agg(
        F.avg(F.when(good, F.col("__mean"))).alias("value"),
        F.sum(good.cast("long")).alias("eligible_units"),
        F.count(F.lit(1)).alias("units"),
        F.sum("__rows").alias("rows"),
    )


def group_timecourse(df: DataFrame, group: Sequence[str], time: str, value: str, band: str = "sd") -> DataFrame:
    """Centre and band of a metric by group and time: mean with sd or sem, or median with quartiles."""
    keys = [*group, time]
    if band == "iqr":
        q = quantiles(df, keys, value, {"low": 0.25, "centre": 0.5, "high": 0.75})
        return q.withColumnRenamed("total", "n")
    stats = df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("centre"), F.stddev_samp(value).alias("__sd"))
    half = {"sd": F.col("__sd"), "sem": F.try_divide(F.col("__sd"), F.sqrt(F.col("n"))), "none": F.lit(None).cast("double")}[band]
    return stats.withColumn("low", F.col("centre") - half).withColumn("high", F.col("centre") + half).drop("__sd")
