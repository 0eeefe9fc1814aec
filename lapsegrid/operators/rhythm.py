"""Rhythm screens as aggregations: each observation meets a declared frequency list and is summed per entity."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from lapsegrid.functions.numeric import ratio, safe_corr
from lapsegrid.operators.stats import corrected
from lapsegrid.plans.heavy import has_heavy_key
from lapsegrid.plans.ranks import quantiles

ENTITY = ["stem", "identity"]
TAU = 2 * math.pi


def frequency_grid(shortest: float, longest: float, count: int) -> list[float]:
    """Periods evenly spaced in frequency between two bounds."""
    f0, f1 = 1.0 / longest, 1.0 / shortest
    return [1.0 / (f0 + (f1 - f0) * k / (count - 1)) for k in range(count)]


def periodogram(df: DataFrame, keys: Sequence[str], value: str, periods: Sequence[float]) -> DataFrame:
    """Normalised Lomb-Scargle power per key and period.

    An observation is repeated once per declared period and five sums are taken, combined map-side; the
    shuffle carries one row per key, period and task however many observations there are.
    """
    keys = list(keys)
    rows = df.where(F.col(value).isNotNull())
    stats = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("__m"), F.var_samp(value).alias("__v"))
    grid = F.array(*[F.struct(F.lit(k).alias("period_index"), F.lit(float(p)).alias("period")) for k, p in enumerate(periods)])
    at = F.lit(TAU) * F.col("hours") / F.col("period")
    # cos 2x and sin 2x follow from cos x and sin x: two waves are computed for each observation and period, not four
    sums = (
        rows.select(*keys, "hours", value).join(stats.select(*keys, "__m"), keys).withColumn("__y", F.col(value) - F.col("__m"))
        .select(*keys, "hours", "__y", F.inline(grid)).select(*keys, "period_index", "period", "__y", F.cos(at).alias("__c"), F.sin(at).alias("__s"))
        .groupBy(*keys, "period_index", "period").agg(
            F.sum(F.col("__y") * F.col("__c")).alias("c"), F.sum(F.col("__y") * F.col("__s")).alias("s"),
            F.sum(1 - 2 * F.col("__s") * F.col("__s")).alias("c2"), F.sum(2 * F.col("__s") * F.col("__c")).alias("s2"),
        )
    )
    wt = F.atan2("s2", "c2") / 2
    yc, ys = F.col("c") * F.cos(wt) + F.col("s") * F.sin(wt), F.col("s") * F.cos(wt) - F.col("c") * F.sin(wt)
    cc = F.col("n") / 2 + F.hypot("c2", "s2") / 2
    ss = F.col("n") - cc
    power = (yc * yc / cc + F.when(ss > 1e-9, ys * ys / ss).otherwise(0.0)) / (2 * F.col("__v"))
    return sums.join(stats, keys).select(*keys, "period_index", "period", "n", F.when(F.col("__v") > 1e-12, power).alias("power"))


def screen(df: DataFrame, keys: Sequence[str], family: Sequence[str], value: str, periods: Sequence[float], minimum: int, alpha: float = 0.05) -> DataFrame:
    """Best period of each key with p, q within its family, and a status; short or constant traces stay as rows."""
    keys = list(keys)
    spectrum = periodogram(df, keys, value, periods)
    m = len(periods)
    best = spectrum.where(F.col("power").isNotNull()).groupBy(*keys).agg(F.min(F.struct((-F.round("power", 9)).alias("s"), "period_index", "period", "power")).alias("b"))
    present = df.groupBy(*keys).agg(F.count(value).alias("observations"), (F.max("hours") - F.min("hours")).alias("span_hours"))
    joined = present.join(best, keys, "left")
    status = F.when(F.col("observations") < minimum, "insufficient").when(F.col("b").isNull(), "constant").otherwise("tested")
    tested = joined.withColumn("status", status)
    ok = F.col("status") == "tested"
    p = F.when(ok, 1 - F.pow(1 - F.exp(-F.col("b.power")), F.lit(float(m))))
    rows = tested.select(
        *keys, "observations", "span_hours", "status", F.when(ok, F.col("b.period")).alias("period"), F.when(ok, F.col("b.power")).alias("power"),
        F.when(ok, F.col("b.period_index").isin(0, m - 1)).alias("search_edge"), p.alias("p_value"),
    )
    cycles = F.col("span_hours") / F.col("period")
    return (
        corrected(rows, family, "p_value", has_heavy_key(df.select(*keys).distinct(), family)).drop("p_bonferroni", "p_sidak", "family_size").withColumnRenamed("q_bh", "q_value")
        .withColumn("period_class", F.when(F.col("period") < 20, "ultradian").when(F.col("period") <= 28, "circadian").when(F.col("period").isNotNull(), "infradian"))
        .withColumn("cycles_covered", cycles).withColumn("underdetermined", cycles < 2)
        .withColumn("supported", F.coalesce((F.col("q_value") <= alpha) & ~F.col("search_edge") & (cycles >= 2), F.lit(False)))
        .withColumn("display", F.when(F.col("status") != "tested", "not_tested").when(F.col("q_value") <= alpha, "significant").otherwise("exploratory"))
    )


def cosinor(df: DataFrame, keys: Sequence[str], value: str, period: float) -> DataFrame:
    """Least-squares cosine of a fixed period: mesor, amplitude, peak hour, R squared and zero-amplitude p."""
    keys = list(keys)
    angle = F.lit(TAU / period) * F.col("hours")
    rows = df.where(F.col(value).isNotNull()).withColumn("__c", F.cos(angle)).withColumn("__s", F.sin(angle))
    s = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(value).alias("y"), F.avg("__c").alias("c"), F.avg("__s").alias("s"), F.var_pop(value).alias("vy"),
        F.var_pop("__c").alias("vc"), F.var_pop("__s").alias("vs"), F.covar_pop("__c", "__s").alias("cs"), F.covar_pop(value, "__c").alias("yc"), F.covar_pop(value, "__s").alias("ys"),
    )
    det = F.col("vc") * F.col("vs") - F.col("cs") * F.col("cs")
    ok = (F.col("n") > 3) & (det > 1e-9)
    a = F.when(ok, (F.col("yc") * F.col("vs") - F.col("ys") * F.col("cs")) / det)
    b = F.when(ok, (F.col("ys") * F.col("vc") - F.col("yc") * F.col("cs")) / det)
    fit = s.withColumn("a", a).withColumn("b", b)
    mesor = F.col("y") - F.col("a") * F.col("c") - F.col("b") * F.col("s")
    r2 = F.when((F.col("vy") > 1e-12) & F.col("a").isNotNull(), F.least(F.greatest((F.col("a") * F.col("yc") + F.col("b") * F.col("ys")) / F.col("vy"), F.lit(0.0)), F.lit(1.0)))
    phase = F.pmod(F.atan2("b", "a") / TAU, F.lit(1.0))
    return fit.select(
        *keys, "n", mesor.alias("mesor"), F.hypot("a", "b").alias("amplitude"), F.when(F.abs(mesor) > 1e-12, F.hypot("a", "b") / F.abs(mesor)).alias("relative_amplitude"),
        phase.alias("phase"), (phase * period).alias("peak_hour"), r2.alias("r_squared"), F.pow(1 - r2, (F.col("n") - 3) / 2).alias("p_value"),
    )


def population_phase(fits: DataFrame, keys: Sequence[str], phase: str = "phase") -> DataFrame:
    """Vector length and mean of phases with the Rayleigh p."""
    angle = F.lit(TAU) * F.col(phase)
    s = fits.where(F.col(phase).isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(F.cos(angle)).alias("c"), F.avg(F.sin(angle)).alias("s"))
    n, r = F.col("n"), F.hypot("c", "s")
    p = F.exp(F.sqrt(1 + 4 * n + 4 * (n * n - F.pow(n * r, 2))) - (1 + 2 * n))
    return s.select(*keys, "n", r.alias("vector_length"), F.pmod(F.atan2("s", "c") / TAU, F.lit(1.0)).alias("mean_phase"), F.least(p, F.lit(1.0)).alias("rayleigh_p"))


def day_profile(df: DataFrame, keys: Sequence[str], value: str, bins: int, period: float = 24.0) -> DataFrame:
    """Mean of each bin of the folded day."""
    b = F.floor(F.pmod(F.col("hours"), F.lit(period)) / F.lit(period / bins)).cast("int")
    return df.where(F.col(value).isNotNull()).groupBy(*keys, b.alias("bin")).agg(F.avg(value).alias("mean"), F.count(F.lit(1)).alias("n"))


def _rolling(profile: DataFrame, keys: Sequence[str], bins: int, width: int) -> DataFrame:
    """Mean over ``width`` bins from each start around the day, where all of them have data."""
    starts = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda k: F.pmod(F.col("bin") - k, F.lit(bins)))
    spread = profile.withColumn("start", F.explode(starts))
    return spread.groupBy(*keys, "start").agg(F.avg("mean").alias("m"), F.count(F.lit(1)).alias("k")).where(F.col("k") == width)


def nonparametric(df: DataFrame, keys: Sequence[str], value: str, bins: int = 24) -> DataFrame:
    """Most active ten and least active five hours, their contrast, and interdaily stability on a 24 h day."""
    keys = list(keys)
    profile = day_profile(df, keys, value, bins)
    high = _rolling(profile, keys, bins, 10).groupBy(*keys).agg(F.max("m").alias("m10"))
    low = _rolling(profile, keys, bins, 5).groupBy(*keys).agg(F.min("m").alias("l5"))
    spread = df.groupBy(*keys).agg(F.var_pop(value).alias("__v"), F.avg(value).alias("__m"), F.count(value).alias("n"))
    between = profile.join(spread, keys).groupBy(*keys).agg((F.sum(F.pow(F.col("mean") - F.col("__m"), 2)) / F.count(F.lit(1))).alias("__b"), F.count(F.lit(1)).alias("bins"))
    return spread.join(between, keys).join(high, keys, "left").join(low, keys, "left").select(
        *keys, "n", "bins", "m10", "l5", ratio(F.col("m10") - F.col("l5"), F.col("m10") + F.col("l5")).alias("relative_amplitude"),
        F.when(F.col("__v") > 1e-12, F.col("__b") / F.col("__v")).alias("interdaily_stability"),
    )


def active_spans(profile: DataFrame, keys: Sequence[str], bins: int, width: int) -> DataFrame:
    """Stretch of ``width`` bins that stands out most from the rest of the day, cut where it wraps midnight."""
    keys = list(keys)
    total = profile.groupBy(*keys).agg(F.sum("mean").alias("__t"), F.count(F.lit(1)).alias("__k")).where(F.col("__k") == bins)
    scored = _rolling(profile, keys, bins, width).join(total, keys).withColumn(
        "score", F.col("m") - (F.col("__t") - F.col("m") * width) / F.lit(float(bins - width))
    )
    best = scored.groupBy(*keys).agg(F.min(F.struct((-F.round("score", 9)).alias("r"), "start", "score")).alias("b"))
    onset, end = F.col("b.start"), F.col("b.start") + width
    whole = F.array(F.struct(onset.alias("from_bin"), end.alias("to_bin")))
    cut = F.array(F.struct(onset.alias("from_bin"), F.lit(bins).alias("to_bin")), F.struct(F.lit(0).alias("from_bin"), (end - bins).alias("to_bin")))
    return best.select(*keys, onset.alias("onset_bin"), F.pmod(end, F.lit(bins)).alias("offset_bin"), F.col("b.score").alias("score"), F.inline(F.when(end <= bins, whole).otherwise(cut)))


def cycle_repeatability(df: DataFrame, fits: DataFrame, keys: Sequence[str], value: str, bins: int, minimum: int) -> DataFrame:
    """Correlation of an entity's first two cycles at its own period, over bins both have."""
    keys = list(keys)
    start = df.groupBy(*keys).agg(F.min("hours").alias("__h0"))
    rows = df.where(F.col(value).isNotNull()).join(fits.where(F.col("period").isNotNull()).select(*keys, "period"), keys).join(start, keys)
    t = (F.col("hours") - F.col("__h0")) / F.col("period")
    placed = rows.withColumn("cycle", F.floor(t + 1e-9).cast("int")).withColumn("bin", F.least(F.floor((t - F.floor(t + 1e-9)) * bins + 1e-9), F.lit(bins - 1)).cast("int")).where(F.col("cycle") <= 1)
    prof = placed.groupBy(*keys, "bin").agg(F.avg(F.when(F.col("cycle") == 0, F.col(value))).alias("a"), F.avg(F.when(F.col("cycle") == 1, F.col(value))).alias("b"))
    both = prof.where(F.col("a").isNotNull() & F.col("b").isNotNull())
    return both.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("shared_bins"), F.when(F.count(F.lit(1)) >= minimum, safe_corr("a", "b")).alias("repeatability"),
        (F.avg("b") - F.avg("a")).alias("level_change"),
    )


def aligned_composite(df: DataFrame, fits: DataFrame, keys: Sequence[str], group: Sequence[str], value: str, period: float, bins: int) -> DataFrame:
    """Observations by time since the entity's own peak, with mean and quartiles over a group."""
    since = F.pmod(F.col("hours") - F.col("peak_hour"), F.lit(period))
    rows = df.where(F.col(value).isNotNull()).join(fits.where(F.col("peak_hour").isNotNull()).select(*keys, F.round("peak_hour", 6).alias("peak_hour")), list(keys)).withColumn(
        "bin", F.floor(since / F.lit(period / bins)).cast("int")
    )
    at = [*group, "bin"]
    mean = rows.groupBy(*at).agg(F.avg(value).alias("mean"), F.count(F.lit(1)).alias("n"))
    return mean.join(quantiles(rows, at, value, {"q25": 0.25, "q75": 0.75}).drop("total"), at)


def null_rates(observed: DataFrame, null: DataFrame, family: Sequence[str], alpha: float) -> DataFrame:
    """Share of surrogates called significant, and how far the data exceed it."""
    hit = lambda d, n: d.where(F.col("p_value").isNotNull()).groupBy(*family).agg(F.avg((F.col("p_value") <= alpha).cast("double")).alias(n), F.count(F.lit(1)).alias(n + "_tests"))
    return hit(observed, "observed_rate").join(hit(null, "null_rate"), list(family)).withColumn("excess", F.col("observed_rate") - F.col("null_rate"))


def masked_intervals(df: DataFrame, value: str, intervals: Sequence[tuple[float, float]]) -> DataFrame:
    """Values inside closed declared intervals become NULL; rows stay."""
    inside = F.lit(False)
    for a, b in intervals:
        inside = inside | F.col("hours").between(a, b)
    return df.withColumn(value, F.when(~inside, F.col(value))).withColumn("omitted", inside)


def detection_agreement(screens: DataFrame, metrics: tuple[str, str], keys: Sequence[str]) -> DataFrame:
    """How two metrics' calls agree over entities, missing tests named."""
    a, b = (F.max(F.when((F.col("metric") == m) & (F.col("status") == "tested"), F.col("supported").cast("int"))) for m in metrics)
    both = screens.groupBy(*keys).agg(a.alias("a"), b.alias("b"))
    label = (
        F.when(F.col("a").isNull() & F.col("b").isNull(), "both_missing").when(F.col("a").isNull(), "first_missing").when(F.col("b").isNull(), "second_missing")
        .when((F.col("a") == 1) & (F.col("b") == 1), "both").when(F.col("a") == 1, "first_only").when(F.col("b") == 1, "second_only").otherwise("neither")
    )
    return both.groupBy("stem", label.alias("category")).agg(F.count(F.lit(1)).alias("entities"))


def any_significant(screens: DataFrame, keys: Sequence[str], expected: int) -> DataFrame:
    """Significant in any metric; without one, an incomplete set of tests leaves the entity untestable."""
    s = screens.groupBy(*keys).agg(
        F.max(F.col("supported").cast("int")).alias("__any"), F.sum((F.col("status") == "tested").cast("long")).alias("tests")
    )
    group = F.when(F.col("__any") == 1, "any_significant").when(F.col("tests") == expected, "none_significant").otherwise("untestable")
    return s.select(*keys, "tests", group.alias("membership"))
