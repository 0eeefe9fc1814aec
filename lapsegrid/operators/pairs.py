"""Neighbours, pair and lag statistics, recurrence, trends and sequence alignment."""

from __future__ import annotations

import heapq
import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql import types as T

from lapsegrid.functions.numeric import circular_gap, rank_p_value, ratio, safe_corr
from lapsegrid.operators.joins import nearest_unique
from lapsegrid.plans.blocks import BLOCK, block_pairs, correlation_of_sums, entity_pair_moments, in_tasks, select_pair_ranks, split
from lapsegrid.plans.durable import cut
from lapsegrid.plans.heavy import has_heavy_key
from lapsegrid.plans.nearest import k_nearest, within_reach
from lapsegrid.plans.ranks import metric_quantiles, quantiles, with_average_rank
from lapsegrid.plans.slopes import BLOCK as SLOPE_BLOCK, select_slopes
from lapsegrid.plans.scan import frame_bucket, hash_numbered, numbered, ordered_scan, redealt

ENTITY = ["stem", "identity"]
FRAME = ["stem", "frame_index"]


# --- neighbours ----------------------------------------------------------------------------------------


def frame_neighbours(tracks: DataFrame, k: int, radius: float, cell: float) -> DataFrame:
    """Per entity and frame: nearest other, mean distance of the k nearest, and how many within a radius."""
    at = tracks.select(*FRAME, "identity", "y", "x")
    other = F.col("t_identity") != F.col("identity")
    near = k_nearest(at, at, FRAME, ["identity"], k, cell, other, ("t_identity",))
    summary = near.groupBy(*FRAME, "identity").agg(
        F.min("distance").alias("nearest_px"), F.min_by("t_identity", "rank").alias("nearest_identity"), F.avg("distance").alias("mean_k_px")
    )
    close = within_reach(at, at, FRAME, radius).where(other & (F.round("distance", 9) <= radius)).groupBy(*FRAME, "identity").agg(
        F.count(F.lit(1)).alias("within_radius")
    )
    return at.select(*FRAME, "identity").join(summary.hint("merge"), [*FRAME, "identity"], "left").join(close.hint("merge"), [*FRAME, "identity"], "left").withColumn(
        "within_radius", F.coalesce("within_radius", F.lit(0).cast("long"))
    )


def clustering_index(neighbours: DataFrame, field_px: float) -> DataFrame:
    """Mean nearest distance over the distance expected of the same number of points at random."""
    m = neighbours.groupBy(*FRAME).agg(F.avg("nearest_px").alias("observed_px"), F.count("nearest_px").alias("entities"))
    expected = F.when(F.col("entities") > 0, 0.5 / F.sqrt(F.col("entities") / F.lit(float(field_px))))
    return m.withColumn("expected_px", expected).withColumn("index", ratio("observed_px", "expected_px"))


def closest_approach(neighbours: DataFrame, recordings: DataFrame) -> DataFrame:
    """Closest any other came over the recording; unknown unless every frame was measured."""
    m = neighbours.groupBy(*ENTITY).agg(F.min("nearest_px").alias("__m"), F.count("nearest_px").alias("measured_frames"))
    timed = m.join(recordings.select("stem", "n_frames"), "stem")
    return timed.withColumn("closest_px", F.when(F.col("measured_frames") == F.col("n_frames"), F.col("__m"))).drop("__m", "n_frames")


def pair_correlations(df: DataFrame, value: str, minimum: int) -> DataFrame:
    """Pearson r of every two entities over the frames both have, with how many those are."""
    found = [T.StructField("overlap_frames", T.LongType()), T.StructField("correlation", T.DoubleType())]
    m = entity_pair_moments(df, ["stem"], "identity", "frame_index", value, finish=correlation_of_sums(minimum, 1e-12), results=found)
    return m.withColumnsRenamed({"a": "identity_a", "b": "identity_b"})


def median_positions(tracks: DataFrame) -> DataFrame:
    return metric_quantiles(tracks, ENTITY, ["y", "x"], {"m": 0.5}).select(*ENTITY, F.col("y_m").alias("y"), F.col("x_m").alias("x"))


def with_distance(pairs: DataFrame, positions: DataFrame) -> DataFrame:
    out = pairs
    for s in ("a", "b"):
        out = out.join(positions.select("stem", F.col("identity").alias(f"identity_{s}"), F.col("y").alias(f"__y{s}"), F.col("x").alias(f"__x{s}")), ["stem", f"identity_{s}"])
    return out.withColumn("distance", F.hypot(F.col("__ya") - F.col("__yb"), F.col("__xa") - F.col("__xb"))).drop("__ya", "__yb", "__xa", "__xb")


def neighbour_graph(positions: DataFrame, k: int, cell: float) -> DataFrame:
    """Unordered edges: either end counts the other among its k nearest."""
    near = k_nearest(positions, positions, ["stem"], ["identity"], k, cell, F.col("t_identity") != F.col("identity"), ("t_identity",))
    return near.select("stem", F.least("identity", "t_identity").alias("identity_a"), F.greatest("identity", "t_identity").alias("identity_b")).distinct()


def paired_rows(pairs: DataFrame, rows: DataFrame, at: Sequence[str], carry: dict[str, str]) -> DataFrame:
    """Rows of two entities that meet at equal ``at``, for the pairs of a pair table (stem, identity_a, identity_b) only.

    ``carry`` names columns and what they become, with _a and _b behind. The table bounds the work: an entity's rows are
    repeated once for each pair it is in.
    """
    out = pairs.select("stem", "identity_a", "identity_b")
    for s, on in (("a", []), ("b", list(at))):
        side = rows.select("stem", F.col("identity").alias(f"identity_{s}"), *at, *[F.col(c).alias(f"{alias}_{s}") for c, alias in carry.items()])
        out = out.join(side, ["stem", f"identity_{s}", *on])
    return out


def switching_association(moves: DataFrame, pairs: DataFrame, hours_per_frame: float, minimum: int, least_hours: float, least_span: float, tolerance: int) -> DataFrame:
    """Do two entities change state at the same time? Per pair of a pair table: phi of their change indicators over the intervals that
    both were observed through, and how many of their changes find each other within a tolerance of frames.

    A pair needs ``minimum`` joint intervals, ``least_hours`` of them and ``least_span`` from first to last, or is insufficient; one
    whose entities never or always change is constant. Changes match as nearest-unique events: equidistant candidates and partners
    wanted twice are ambiguous and count for neither.
    """
    steps = moves.select(*ENTITY, F.col("to_frame_index").alias("frame_index"), "hours", (F.col("from_regime") != F.col("to_regime")).cast("double").alias("change"))
    keys = ["stem", "identity_a", "identity_b"]
    joint = cut(paired_rows(pairs, steps, ["frame_index"], {"change": "change", "hours": "hours"}))
    summary = joint.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("joint_intervals"), (F.count(F.lit(1)) * F.lit(hours_per_frame)).alias("joint_hours"), (F.max("hours_a") - F.min("hours_a")).alias("span_hours"),
        F.sum("change_a").cast("long").alias("changes_a"), F.sum("change_b").cast("long").alias("changes_b"), safe_corr("change_a", "change_b").alias("__phi"),
    )
    side = lambda s: joint.where(F.col(f"change_{s}") == 1).select(*keys, F.col("frame_index").cast("long").alias("frame"))
    matches = nearest_unique(side("a"), side("b"), keys, "frame", 0, tolerance, 4096)
    met = matches.groupBy(*keys).agg(F.count_if(F.col("match_status") == "matched").alias("matched"), F.count_if(F.col("match_status").isin("equidistant", "collision")).alias("ambiguous"))
    none = F.lit(0).cast("long")
    out = pairs.select(*keys).join(summary, keys, "left").join(met, keys, "left")
    for c in ("joint_intervals", "changes_a", "changes_b", "matched", "ambiguous"):
        out = out.withColumn(c, F.coalesce(c, none))
    few = (F.col("joint_intervals") < minimum) | (F.col("joint_hours") < least_hours) | (F.col("span_hours") < least_span)
    status = F.when(F.coalesce(few, F.lit(True)), "insufficient").when(F.col("__phi").isNull(), "constant").otherwise("descriptive")
    return out.select(
        *keys, "joint_intervals", F.coalesce("joint_hours", F.lit(0.0)).alias("joint_hours"), "span_hours", "changes_a", "changes_b", "matched", "ambiguous",
        ratio("matched", "changes_a").alias("matched_share_a"), ratio("matched", "changes_b").alias("matched_share_b"),
        F.when(status == "descriptive", F.col("__phi")).alias("phi"), status.alias("status"),
    )


def coordination_contrast(pairs: DataFrame, graph: DataFrame, coverage: DataFrame, replicates: int, seed: int) -> DataFrame:
    """Mean correlation of neighbours minus that of the rest, against relabellings of whole entities inside
    quarters of coverage. A replicate touches only the graph's edges: the rest follows from the totals."""
    valid = pairs.where(F.col("correlation").isNotNull()).select("stem", "identity_a", "identity_b", "correlation")
    totals = valid.groupBy("stem").agg(F.sum("correlation").alias("__t"), F.count(F.lit(1)).alias("__n"))
    strata = coverage.select(*ENTITY, F.least(F.floor(F.col("coverage") * 4), F.lit(3)).cast("int").alias("stratum"))
    reps = strata.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates))))
    keys = ["stem", "stratum", "replicate"]
    slot = F.floor(F.col("identity") / F.lit(100_000)).cast("long")
    place = numbered(reps, keys, ["identity"], slot, "position")
    drawn = hash_numbered(
        reps, keys, F.concat_ws("|", F.lit(str(seed)), "replicate", "stem", "identity"), "position", ["identity"]
    ).select(*keys, "position", F.col("identity").alias("image"))
    # replicate 0 is the observed labelling
    mapping = place.join(drawn, [*keys, "position"]).select(
        "stem", "replicate", "identity", F.when(F.col("replicate") == 0, F.col("identity")).otherwise(F.col("image")).alias("image")
    )
    a = mapping.select("stem", "replicate", F.col("identity").alias("identity_a"), F.col("image").alias("ia"))
    b = mapping.select("stem", "replicate", F.col("identity").alias("identity_b"), F.col("image").alias("ib"))
    edges = graph.join(a, ["stem", "identity_a"]).join(b, ["stem", "replicate", "identity_b"]).select(
        "stem", "replicate", F.least("ia", "ib").alias("identity_a"), F.greatest("ia", "ib").alias("identity_b")
    )
    near = edges.join(valid, ["stem", "identity_a", "identity_b"]).groupBy("stem", "replicate").agg(
        F.sum("correlation").alias("s"), F.count(F.lit(1)).alias("n")
    ).join(totals, "stem")
    contrast = F.col("s") / F.col("n") - F.try_divide(F.col("__t") - F.col("s"), (F.col("__n") - F.col("n")).cast("double"))
    scored = near.withColumn("contrast", contrast)
    seen = scored.where(F.col("replicate") == 0).select("stem", F.col("contrast").alias("estimate"), F.col("n").alias("neighbour_pairs"))
    null = scored.where((F.col("replicate") > 0) & F.col("contrast").isNotNull()).join(seen, "stem").groupBy("stem").agg(
        F.max("estimate").alias("estimate"), F.max("neighbour_pairs").alias("neighbour_pairs"), F.count(F.lit(1)).alias("replicates"),
        F.avg("contrast").alias("null_mean"),
        F.sum((F.round(F.abs("contrast"), 12) >= F.round(F.abs("estimate"), 12)).cast("long")).alias("__h"),
    )
    return null.withColumn("p_value", ratio(F.col("__h") + 1, F.col("replicates") + 1)).drop("__h")


# --- lags ------------------------------------------------------------------------------------------------


def lagged_pairs(df: DataFrame, a: str, b: str, max_lag: int, keys=tuple(ENTITY), two_level: bool | None = None) -> DataFrame:
    """Value of ``a`` at a frame with ``b`` ``lag`` frames later, lags of both signs; only frames that exist. Where every key is
    small, a frame looks at the frames around it in its key's own order, and is shuffled once."""
    if two_level is None:
        two_level = has_heavy_key(df, keys)
    if two_level:
        first = df.select(*keys, "frame_index", F.col(a).alias("va")).withColumn("lag_frames", F.explode(F.sequence(F.lit(-max_lag), F.lit(max_lag))))
        first = first.withColumn("frame_index", (F.col("frame_index") + F.col("lag_frames")).cast("int"))
        return first.join(df.select(*keys, "frame_index", F.col(b).alias("vb")), [*keys, "frame_index"])
    named = df
    for k in (*keys, "frame_index"):
        named = named.where(F.col(k).isNotNull())
    around = Window.partitionBy(*keys).orderBy("frame_index").rangeBetween(-max_lag, max_lag)
    near = F.collect_list(F.struct(F.col("frame_index").alias("__at"), F.col(b).alias("vb"))).over(around)
    met = named.select(*keys, F.col("frame_index").alias("__f"), F.col(a).alias("va"), near.alias("__near")).select(*keys, "__f", "va", F.inline("__near"))
    return met.select(*keys, F.col("__at").alias("frame_index"), "va", (F.col("__at") - F.col("__f")).alias("lag_frames"), "vb")


def lag_profile(df: DataFrame, a: str, b: str, max_lag: int, minimum: int, keys=tuple(ENTITY), two_level: bool | None = None) -> DataFrame:
    return lagged_pairs(df, a, b, max_lag, keys, two_level).groupBy(*keys, "lag_frames").agg(
        safe_corr("va", "vb").alias("correlation"), F.count(F.lit(1)).alias("pairs")
    ).where(F.col("pairs") >= minimum)


def shuffled(df: DataFrame, columns: Sequence[str], replicates: int, seed: int, keys=tuple(ENTITY), kept: Sequence[str] = (), two_level: bool | None = None) -> DataFrame:
    """Each entity's values dealt to its own frames in md5 order, per replicate (drawn alike everywhere)."""
    text = F.concat_ws("|", F.lit(str(seed)), "replicate", *keys, "frame_index")
    return redealt(df, keys, ["frame_index"], text, replicates, columns, kept, two_level)


def lag_null_band(df: DataFrame, a: str, b: str, max_lag: int, minimum: int, replicates: int, seed: int) -> DataFrame:
    """Lag profile with the mean and 2.5 / 97.5 % band of profiles against shuffled partners."""
    big = has_heavy_key(df, ENTITY)
    observed = lag_profile(df, a, b, max_lag, minimum, two_level=big)
    paired = shuffled(df, [b], replicates, seed, kept=[a], two_level=big)
    null = lag_profile(paired, a, b, max_lag, minimum, (*ENTITY, "replicate"), big).where(F.col("correlation").isNotNull())
    keys = [*ENTITY, "lag_frames"]
    # one value a replicate: a declared, bounded number
    at = lambda q: F.percentile("correlation", F.lit(q))
    band = null.groupBy(*keys).agg(F.avg("correlation").alias("surrogate_mean"), at(0.025).alias("surrogate_lo"), at(0.975).alias("surrogate_hi"))
    return observed.join(band, keys, "left")


def population_lags(profile: DataFrame) -> DataFrame:
    mean = profile.where(F.col("correlation").isNotNull()).groupBy("stem", "lag_frames").agg(F.avg("correlation").alias("mean"), F.count(F.lit(1)).alias("entities"))
    band = quantiles(profile, ["stem", "lag_frames"], "correlation", {"q25": 0.25, "q75": 0.75}).drop("total")
    return mean.join(band, ["stem", "lag_frames"])


def peak_lag(profile: DataFrame, keys=tuple(ENTITY)) -> DataFrame:
    """Lag of the largest absolute correlation; the smaller lag on ties."""
    good = profile.where(F.col("correlation").isNotNull())
    best = good.groupBy(*keys).agg(F.min(F.struct((-F.round(F.abs("correlation"), 9)).alias("s"), "lag_frames", "correlation")).alias("b"))
    return best.select(*keys, F.col("b.lag_frames").alias("peak_lag"), F.col("b.correlation").alias("peak_correlation"))


def phase_difference(fits: DataFrame, period: float, declared_pairs: DataFrame) -> DataFrame:
    """Shortest circular difference of two entities' phases, in cycles and hours."""
    out = declared_pairs
    for s in ("a", "b"):
        out = out.join(fits.select("stem", F.col("identity").alias(f"identity_{s}"), F.col("phase").alias(f"phase_{s}")), ["stem", f"identity_{s}"])
    return out.withColumn("phase_difference", circular_gap(F.col("phase_a"), F.col("phase_b"))).withColumn(
        "difference_hours", F.col("phase_difference") * F.lit(period)
    )


# --- trends and recurrence over all pairs of an entity's observations ------------------------------------


def _slopes(left: pd.DataFrame, right: pd.DataFrame, same: bool) -> np.ndarray:
    ta, va, tb, vb = (d[c].to_numpy(float) for d in (left, right) for c in ("t", "v"))
    dt, dv = tb[None, :] - ta[:, None], vb[None, :] - va[:, None]
    keep = np.triu(np.ones(dt.shape, bool), 1) if same else np.ones(dt.shape, bool)
    keep &= dt != 0  # two values at one time have no slope
    return dv[keep] / dt[keep]


#: Upper normal quantile at 0.025, a fixed value.
_Z = 1.959963984540054


def _interval_ranks(pairs: float, sigma: float) -> tuple[int, int]:
    """0-based ranks of the slopes that bound the interval at 0.95."""
    return max(int(np.round((pairs - _Z * sigma) / 2)) - 1, 0), min(int(np.round((pairs + _Z * sigma) / 2)), int(pairs) - 1)


def _average_ranks(x: np.ndarray) -> np.ndarray:
    _, at, n = np.unique(x, return_inverse=True, return_counts=True)
    return (np.cumsum(n) - (n - 1) / 2)[at]


def _small_trend(pdf: pd.DataFrame) -> pd.DataFrame:
    """The trend of one entity of at most a block of rows."""
    pdf = pdf.sort_values(["t", "v"])
    t, v = pdf["t"].to_numpy(float), pdf["v"].to_numpy(float)
    s = np.sort(_slopes(pdf, pdf, True))
    out = {k: pdf[k].iloc[0] for k in ENTITY}
    if not len(s):
        return pd.DataFrame(columns=[*ENTITY, *_TREND])
    n, k = len(v), np.unique(v, return_counts=True)[1].astype(float)
    lo, hi = _interval_ranks(len(s), math.sqrt((n * (n - 1) * (2 * n + 5) - (k * (k - 1) * (2 * k + 5)).sum()) / 18))
    rt, rv = _average_ranks(t), _average_ranks(v)
    flat = rv.std() <= 1e-9 * rv.max() or rt.std() <= 1e-9 * rt.max()
    dt = t - t.mean()
    out |= {
        "observations": n, "span_hours": t[-1] - t[0], "level_median": float(np.median(v)), "slope_per_hour": (s[(len(s) - 1) // 2] + s[len(s) // 2]) / 2, "slope_low": s[lo], "slope_high": s[hi],
        "slope_least_squares": float((dt * (v - v.mean())).sum() / (dt * dt).sum()), "monotone_rho": None if flat else float(((rt - rt.mean()) * (rv - rv.mean())).mean() / (rt.std() * rv.std())),
    }
    return pd.DataFrame([out])


_TREND = ["observations", "span_hours", "level_median", "slope_per_hour", "slope_low", "slope_high", "slope_least_squares", "monotone_rho"]


def _large_trend(rows: DataFrame, counts: DataFrame, slope_block: int) -> DataFrame:
    """The trend of entities of any size: slopes by inversion counts, ranks and the median by counted values. counts: (stem, identity, n)."""
    k, n = F.col("k"), F.col("n")
    tie = rows.groupBy(*ENTITY, "v").agg(F.count(F.lit(1)).alias("k")).groupBy(*ENTITY).agg(F.sum((k * (k - 1) * (2 * k + 5)).cast("double")).alias("__tie"))
    same_time = rows.groupBy(*ENTITY, "t").agg(F.count(F.lit(1)).alias("k")).groupBy(*ENTITY).agg(F.sum(k * (k - 1)).alias("__same"))
    pairs = ((n * (n - 1) - F.col("__same")) / 2).cast("long")
    m = n.cast("double")
    sigma = F.sqrt((m * (m - 1) * (2 * m + 5) - F.col("__tie")) / 18.0)
    sized = counts.join(tie, ENTITY).join(same_time, ENTITY).withColumn("pairs", pairs).where("pairs > 0")
    hi = F.least(F.bround((F.col("pairs") + _Z * sigma) / 2).cast("long"), F.col("pairs") - 1)
    lo = F.greatest(F.bround((F.col("pairs") - _Z * sigma) / 2).cast("long") - 1, F.lit(0).cast("long"))
    middles = (("m0", F.floor((F.col("pairs") - 1) / 2)), ("m1", F.floor(F.col("pairs") / 2)))
    ranks = sized.select(*ENTITY, "pairs", F.inline(F.array(*[F.struct(F.lit(t).alias("target"), r.cast("long").alias("rank")) for t, r in (("lo", lo), ("hi", hi), *middles)])))
    placed = numbered(rows, ENTITY, ["t", "v"], F.floor(F.col("t") / 4096).cast("long"), "position")
    values = select_slopes(placed, ENTITY, ranks, slope_block)
    at = lambda t: F.max(F.when(F.col("target") == t, F.col("value")))
    slopes = values.groupBy(*ENTITY).agg(((at("m0") + at("m1")) / 2).alias("slope_per_hour"), at("lo").alias("slope_low"), at("hi").alias("slope_high"))
    ranked = with_average_rank(with_average_rank(rows, ENTITY, "t", "rt"), ENTITY, "v", "rv")
    rest = ranked.groupBy(*ENTITY).agg(
        F.count(F.lit(1)).alias("observations"), (F.max("t") - F.min("t")).alias("span_hours"),
        F.regr_slope("v", "t").alias("slope_least_squares"), safe_corr("rt", "rv").alias("monotone_rho"),
    )
    level = metric_quantiles(rows, ENTITY, ["v"], {"median": 0.5}).withColumnRenamed("v_median", "level_median")
    return rest.join(slopes, ENTITY).join(level, ENTITY).select(*ENTITY, *_TREND)


def robust_trend(df: DataFrame, value: str, minimum: int = 5, block: int = BLOCK, slope_block: int = SLOPE_BLOCK) -> DataFrame:
    """Level median, median of all pair slopes with a rank interval at alpha 0.95, least-squares slope, change over the span
    and rank correlation with time, with its two-sided p.

    Entities of at most ``block`` rows are one task step each. Larger ones never form their pairs: a wanted slope is found
    by counting inversions (``plans/slopes.py``). Entities whose rows all have one time have no slope and no row.
    """
    rows = df.where(F.col(value).isNotNull()).select(*ENTITY, F.col("hours").cast("double").alias("t"), F.col(value).cast("double").alias("v"))
    counts = cut(rows.groupBy(*ENTITY).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= minimum))
    fields = [f for f in rows.schema.fields if f.name in ENTITY]
    kind = lambda c: T.LongType() if c == "observations" else T.DoubleType()
    out = T.StructType([*fields, *(T.StructField(c, kind(c)) for c in _TREND)])
    small = rows.join(counts.where(F.col("n") <= block).select(*ENTITY), ENTITY, "left_semi").groupBy(*ENTITY).applyInPandas(_small_trend, out)
    large = counts.where(F.col("n") > block)
    if not large.isEmpty():
        held = cut(rows.join(large.select(*ENTITY), ENTITY, "left_semi"))
        small = small.unionByName(_large_trend(held, large, slope_block))
    return small.withColumn("change_over_recording", F.col("slope_per_hour") * F.col("span_hours")).withColumn(
        "monotone_p_value", rank_p_value(F.col("monotone_rho"), F.col("observations"))
    )


def state_vectors(df: DataFrame, metrics: Sequence[str], minimum: int) -> DataFrame:
    """Complete rows with each metric standardised over the entity, in frame order."""
    full = df
    for m in metrics:
        full = full.where(F.col(m).isNotNull())
    s = full.groupBy(*ENTITY).agg(F.count(F.lit(1)).alias("__n"), *[F.avg(m).alias(f"__m_{m}") for m in metrics], *[F.stddev_pop(m).alias(f"__s_{m}") for m in metrics])
    joined = full.join(s.where(F.col("__n") >= minimum), ENTITY)
    z = [F.when(F.col(f"__s_{m}") > 1e-9, (F.col(m) - F.col(f"__m_{m}")) / F.col(f"__s_{m}")).otherwise(0.0) for m in metrics]
    return numbered(joined.select(*ENTITY, "frame_index", F.array(*z).alias("state")), ENTITY, ["frame_index"], frame_bucket(), "position")


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances to nine digits: a closest share of pairs is cut at one of them, and ties must not depend on the last bits."""
    return np.round(np.sqrt(np.maximum(((a[:, None, :] - b[None, :, :]) ** 2).sum(axis=2), 0.0)), 9)


def _distances(left: pd.DataFrame, right: pd.DataFrame) -> np.ndarray:
    return _apart(np.array(left["state"].tolist(), float), np.array(right["state"].tolist(), float))


def _states(table: pa.Table) -> np.ndarray:
    return table["state"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(table), -1)


def _upper_distances(left: pd.DataFrame, right: pd.DataFrame, same: bool) -> np.ndarray:
    d = _distances(left, right)
    return d[np.triu_indices(len(left), 1)] if same else d.ravel()


def recurrence_cutoffs(vectors: DataFrame, quantile: float, block: int = BLOCK) -> DataFrame:
    """(stem, identity, n, cutoff): the distance below which the closest share of an entity's pairs of frames lies."""
    sizes = vectors.groupBy(*ENTITY).agg(F.max("position").alias("n")).withColumn("pairs", (F.col("n") * (F.col("n") - 1) / 2).cast("long"))
    at = (F.col("pairs") - 1) * F.lit(float(quantile))
    ranks = sizes.select(*ENTITY, F.inline(F.array(*[
        F.struct(F.lit(t).alias("target"), r.cast("long").alias("rank")) for t, r in (("lo", F.floor(at)), ("hi", F.ceil(at)))])))
    if (sizes.agg(F.max("n")).first()[0] or 0) <= block:
        def pick(table: pa.Table) -> dict[str, np.ndarray]:
            z = _states(table)
            d = np.sort(_apart(z, z)[np.triu_indices(len(z), 1)])
            q = (len(d) - 1) * quantile
            return {"lo": d[[math.floor(q)]], "hi": d[[math.ceil(q)]]}

        ends = in_tasks(vectors.select(*ENTITY, "position", "state"), ENTITY, "position", ENTITY, pick, [T.StructField(c, T.DoubleType()) for c in ("lo", "hi")])
    else:
        chosen = select_pair_ranks(block_pairs(vectors, ENTITY, "position", block), ENTITY, "position", _upper_distances, ranks)
        ends = chosen.groupBy(*ENTITY).agg(*[F.max(F.when(F.col("target") == t, F.col("value"))).alias(t) for t in ("lo", "hi")])
    frac = at - F.floor(at)
    return ends.join(sizes, ENTITY).select(*ENTITY, "n", (F.col("lo") + (F.col("hi") - F.col("lo")) * frac).alias("cutoff"))


def returns_by_lag(vectors: DataFrame, cutoff: DataFrame, keys: Sequence[str], max_lag: int, block: int = BLOCK) -> DataFrame:
    """(keys, lag_frames, hits, d, v): returns at each lag (all longer ones together), and those on diagonal and vertical runs.

    ``keys`` begin with the entity; more of them (a replicate) make an entity's surrogates groups of their own, all judged by
    the entity's cutoff in one pass. Each block carries the row before and after it, so whether a return has a neighbour on
    its diagonal or column is known inside one task; only counts leave it.
    """
    keys = list(keys)
    p = F.col("position") - 1
    # halo: a row also belongs to the neighbouring block when it touches its edge
    homes = F.array_distinct(F.array(F.floor(p / block), F.floor((p - 1) / block), F.floor((p + 1) / block)))
    haloed = vectors.join(cutoff, ENTITY).withColumn("own", F.explode(homes)).where(
        (F.col("own") >= 0) & (F.col("own") <= F.floor((F.col("n") - 1) / block))
    ).withColumn("own", F.col("own").cast("int"))
    spread = haloed.withColumn("__o", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / block))))
    tasks = spread.withColumn("bi", F.least(F.col("own"), F.col("__o").cast("int"))).withColumn("bj", F.greatest(F.col("own"), F.col("__o").cast("int"))).drop("__o")
    counts = ("hits", "diagonal", "vertical")

    def count(table: pa.Table) -> dict[str, np.ndarray]:
        bi, bj = table["bi"][0].as_py(), table["bj"][0].as_py()
        own, position, z = table["own"].to_numpy(), table["position"].to_numpy(), _states(table)
        # a row may come twice, once for each way to its block pair
        (pl, il), (pr, ir) = (np.unique(np.where(own == b, position, 0), return_index=True) for b in (bi, bj))
        (pl, il), (pr, ir) = ((q[q > 0], i[q > 0]) for q, i in ((pl, il), (pr, ir)))
        hit = _apart(z[il], z[ir]) <= table["cutoff"][0].as_py()
        hit &= pl[:, None] != pr[None, :]
        pad = np.pad(hit, 1)
        diagonal = hit & (pad[:-2, :-2] | pad[2:, 2:])
        # runs along either axis: the matrix is symmetric, so both orientations of a pair are looked at
        rows_run = hit & (pad[:-2, 1:-1] | pad[2:, 1:-1])
        cols_run = hit & (pad[1:-1, :-2] | pad[1:-1, 2:])
        lag = pr[None, :] - pl[:, None]
        core = ((pl - 1) // block == bi)[:, None] & ((pr - 1) // block == bj)[None, :] & (lag > 0)
        at = np.minimum(lag[core], max_lag + 1)
        total = lambda *what: sum(np.bincount(at, w[core], max_lag + 2) for w in what).astype(np.int64)
        found = np.flatnonzero(np.bincount(at, minlength=max_lag + 2))
        sums = {"hits": total(hit), "diagonal": 2 * total(diagonal), "vertical": total(rows_run, cols_run)}
        return {"lag_frames": found.astype(np.int32), **{c: sums[c][found] for c in counts}}

    found = in_tasks(
        tasks.select(*keys, "bi", "bj", "own", "position", "state", "cutoff"), [*keys, "bi", "bj"], "position", keys, count,
        [T.StructField("lag_frames", T.IntegerType()), *(T.StructField(c, T.LongType()) for c in counts)],
    )
    return found.groupBy(*keys, "lag_frames").agg(F.sum("hits").alias("hits"), F.sum("diagonal").alias("d"), F.sum("vertical").alias("v"))


def _rates(counted: DataFrame, cutoff: DataFrame, keys: Sequence[str], max_lag: int) -> DataFrame:
    pairs = F.col("n") - F.col("lag_frames")
    return counted.where(F.col("lag_frames") <= max_lag).join(cutoff, ENTITY).select(*keys, "lag_frames", ratio("hits", pairs).alias("recurrence_rate"), pairs.alias("recurrence_pairs"))


def _shares(counted: DataFrame, cutoff: DataFrame, keys: Sequence[str]) -> DataFrame:
    total = counted.groupBy(*keys).agg(F.sum("hits").alias("h"), F.sum("d").alias("d"), F.sum("v").alias("v"))
    share = lambda c: F.coalesce(ratio(c, 2 * F.col("h")), F.lit(0.0))
    return total.join(cutoff, ENTITY).select(*keys, "cutoff", share("d").alias("determinism"), share("v").alias("laminarity"))


def recurrence(vectors: DataFrame, quantile: float, max_lag: int, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Returns to an earlier state: the rate of returns by lag, and the shares of returns on diagonal and vertical runs."""
    vectors = cut(vectors)  # the cutoff and the hits must see the same bits
    cutoff = recurrence_cutoffs(vectors, quantile, block)
    counted = returns_by_lag(vectors, cutoff, ENTITY, max_lag, block)
    return _rates(counted, cutoff, ENTITY, max_lag), _shares(counted, cutoff, ENTITY)


def detrended(df: DataFrame, metrics: Sequence[str], time: str = "hours") -> DataFrame:
    """Each metric less its own least-squares line over the entity, so that steady growth is no return."""
    lines = df.groupBy(*ENTITY).agg(*[f(m, time).alias(f"__{a}_{m}") for m in metrics for a, f in (("a", F.regr_intercept), ("b", F.regr_slope))])
    left = {m: F.col(m) - (F.coalesce(F.col(f"__a_{m}"), F.lit(0.0)) + F.coalesce(F.col(f"__b_{m}"), F.lit(0.0)) * F.col(time)) for m in metrics}
    return df.join(lines, ENTITY).select(*[left[c].alias(c) if c in left else c for c in df.columns])


def shuffled_vectors(vectors: DataFrame, replicates: int, seed: int) -> DataFrame:
    """Surrogates of state vectors: each component of an entity dealt to its own frames by an md5 order of its own, per replicate."""
    big = has_heavy_key(vectors, ENTITY)
    # an entity's surrogates are made where its rows are
    home = vectors.select(*ENTITY, "position", "state").repartition(*ENTITY)
    long = home.select(*ENTITY, "position", F.posexplode("state").alias("dim", "z")).withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    keys = [*ENTITY, "replicate"]
    text = F.concat_ws("|", F.lit(str(seed)), "replicate", *ENTITY, "dim", "position")
    dealt = hash_numbered(long, [*keys, "dim"], text, "__at", ["position"], two_level=big)
    state = F.transform(F.sort_array(F.collect_list(F.struct("dim", "z"))), lambda x: x["z"])
    return dealt.groupBy(*keys, F.col("__at").alias("position")).agg(state.alias("state"))


def recurrence_bands(vectors: DataFrame, quantile: float, max_lag: int, replicates: int, seed: int, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """``recurrence`` beside matched noise: mean and central 95 % of the rate at each lag over the surrogates, and their mean
    determinism and laminarity. Surrogates are judged by the entity's own cutoff."""
    vectors = cut(vectors)
    cutoff = cut(recurrence_cutoffs(vectors, quantile, block))
    noise = cut(shuffled_vectors(vectors, replicates, seed))
    keys = [*ENTITY, "replicate"]
    counted, null = cut(returns_by_lag(vectors, cutoff, ENTITY, max_lag, block)), cut(returns_by_lag(noise, cutoff, keys, max_lag, block))
    # one value a replicate: a declared, bounded number
    at = lambda q: F.percentile("recurrence_rate", F.lit(q))
    band = _rates(null, cutoff, keys, max_lag).groupBy(*ENTITY, "lag_frames").agg(F.avg("recurrence_rate").alias("surrogate_mean"), at(0.025).alias("surrogate_low"), at(0.975).alias("surrogate_high"))
    shares = _shares(null, cutoff, keys).groupBy(*ENTITY).agg(F.avg("determinism").alias("determinism_surrogate"), F.avg("laminarity").alias("laminarity_surrogate"))
    return _rates(counted, cutoff, ENTITY, max_lag).join(band, [*ENTITY, "lag_frames"]), _shares(counted, cutoff, ENTITY).join(shares, ENTITY)


# --- sequences -------------------------------------------------------------------------------------------


def aligned_sequences(symbols: DataFrame, pairs: DataFrame, clocks: DataFrame, band: int, chunk: int = 512, dims: int = 0, min_overlap: int = 0) -> DataFrame:
    """Banded alignment of two symbol sequences on their recording's frame axis, -1 where missing.

    clocks: (stem, n_frames), each recording's own length; the alignment of a pair ends with it. With ``dims`` the
    symbols are vectors of that length, the cost is the squared distance, and the result is the root of the total
    per frame; both sequences must then be complete. Symbol pairs with fewer than ``min_overlap`` aligned steps that
    both sequences have are left out.

    Moves are tried up, left, diagonal and the first cheapest wins. Frames are taken a chunk at a time: a round
    sees one chunk of the first sequence, the matching stretch of the second and the band's running state, and
    the state is written between rounds. So a sequence of any length needs a bounded amount of memory. A pair whose
    clock has ended takes no part in later rounds' work but for being carried along.
    """
    width = 2 * band + 1
    names = ("cost", "steps", "shift", "both")
    id_type = symbols.schema["identity"].dataType
    stem_type = symbols.schema["stem"].dataType
    out = T.StructType(
        [T.StructField("stem", stem_type), T.StructField("identity_a", id_type), T.StructField("identity_b", id_type), T.StructField("n_frames", T.IntegerType())]
        + [T.StructField(s, T.ArrayType(T.DoubleType())) for s in names]
    )
    state = pairs.select("stem", "identity_a", "identity_b").join(clocks.select("stem", F.col("n_frames").cast("int").alias("n_frames")), "stem")
    for s in names:
        # before the first row only the corner costs nothing
        start = [0.0] * width if s != "cost" else [float("inf")] * band + [0.0] + [float("inf")] * band
        state = state.withColumn(s, F.array(*[F.lit(v) for v in start]))
    longest = clocks.agg(F.max("n_frames")).first()[0] or 0
    rounds = max(1, -(-longest // chunk))
    for r in range(rounds):
        lo, hi = r * chunk, min((r + 1) * chunk, longest)

        def stretch(side: str, a: int, b: int) -> DataFrame:
            part = symbols.where((F.col("frame_index") >= a) & (F.col("frame_index") < b))
            # at most one row per frame of the stretch
            return part.groupBy("stem", "identity").agg(
                F.collect_list("frame_index").alias(f"f{side}"), F.collect_list("symbol").alias(f"s{side}")
            ).withColumnRenamed("identity", f"identity_{side}")

        joined = state.join(stretch("a", lo, hi), ["stem", "identity_a"], "left").join(
            stretch("b", max(0, lo - band), min(longest, hi + band)), ["stem", "identity_b"], "left"
        )

        def advance(batches, lo=lo, hi=hi):
            first_b = lo - band
            for pdf in batches:
                n = len(pdf)
                ends = pdf["n_frames"].to_numpy()
                tail = (dims,) if dims else ()
                left = np.full((n, hi - lo, *tail), -1.0)
                right = np.full((n, hi - lo + 2 * band, *tail), -1.0)
                for dest, f, s, base in ((left, "fa", "sa", lo), (right, "fb", "sb", first_b)):
                    for row, (frames, values) in enumerate(zip(pdf[f], pdf[s])):
                        if frames is not None and len(frames):
                            dest[row, np.asarray(frames, int) - base] = np.array(list(values), float)
                prev = {s: np.array(pdf[s].tolist(), float).reshape(n, width) for s in names}
                for i in range(lo, min(hi, ends.max(initial=0))):
                    going = i < ends
                    cur = {s: np.where(going[:, None], 0.0, prev[s]) for s in names}
                    cur["cost"][going] = np.inf
                    for k in range(width):
                        j = i + k - band
                        if j < 0:
                            continue
                        inf = np.full(n, np.inf)
                        # parents: (i-1, j), (i, j-1), (i-1, j-1); row -1 and column -1 hold only the corner
                        up = prev["cost"][:, k + 1] if k + 1 < width and i > 0 else inf
                        back = cur["cost"][:, k - 1] if k > 0 and j > 0 else inf
                        diag = prev["cost"][:, k] if (i > 0 and j > 0) or (i == 0 and j == 0) else inf
                        choice = np.argmin(np.stack([up, back, diag]), axis=0)
                        a, b = left[:, i - lo], right[:, j - first_b]
                        open_ = going & (j < ends)
                        cost = np.choose(choice, [up, back, diag]) + (((a - b) ** 2).sum(axis=1) if dims else (a != b))
                        cur["cost"][:, k] = np.where(open_, cost, cur["cost"][:, k])
                        both = np.ones(n) if dims else ((a >= 0) & (b >= 0)).astype(float)
                        for s, add in (("steps", 1.0), ("shift", both * (j - i)), ("both", both)):
                            u = prev[s][:, k + 1] if k + 1 < width else np.zeros(n)
                            v = cur[s][:, k - 1] if k > 0 else np.zeros(n)
                            cur[s][:, k] = np.where(open_, np.choose(choice, [u, v, prev[s][:, k]]) + add, cur[s][:, k])
                    prev = cur
                keys = {c: pdf[c] for c in ("stem", "identity_a", "identity_b", "n_frames")}
                yield pd.DataFrame({**keys, **{s: list(prev[s]) for s in names}})

        state = joined.mapInPandas(advance, out)
        if r + 1 < rounds:
            state = cut(state)
    end = {s: F.element_at(s, band + 1) for s in names}
    if dims:
        return state.select("stem", "identity_a", "identity_b", F.sqrt(ratio(end["cost"], F.col("n_frames").cast("double"))).alias("trajectory_distance"))
    return state.where(end["both"] >= min_overlap).select(
        "stem", "identity_a", "identity_b", F.when(end["cost"] < float("inf"), ratio(end["cost"], end["steps"])).alias("dtw_distance"),
        ratio(end["shift"], end["both"]).alias("alignment_offset_frames"), end["both"].cast("long").alias("alignment_overlap_steps"),
    )


def observed_segments(rows: DataFrame, minimum: int) -> DataFrame:
    """(stem, identity, first_frame, last_frame): runs of consecutive observed frames, `minimum` long or longer."""
    runs = runs_of(rows.select(*ENTITY, "frame_index"))
    return runs.where(F.col("last_frame") - F.col("first_frame") + 1 >= minimum)


def runs_of(rows: DataFrame) -> DataFrame:
    """Runs of consecutive frames of each entity."""
    seen = numbered(rows.distinct(), ENTITY, ["frame_index"], frame_bucket("frame_index"), "__n")
    return seen.groupBy(*ENTITY, (F.col("frame_index") - F.col("__n")).alias("__run")).agg(
        F.min("frame_index").alias("first_frame"), F.max("frame_index").alias("last_frame")
    ).drop("__run")


def common_window(segments: DataFrame, minimum: int, entities: int) -> DataFrame:
    """(stem, window_first, window_last, window_entities): the longest stretch of frames that at least `entities` entities of a recording were
    observed throughout; of equally long ones that of most entities, then the earliest. A recording without one has no row.

    Only the `entities` latest ends of each first frame matter for the length, so a recording is one small row group.
    """
    late = Window.partitionBy("stem", "first_frame").orderBy(F.desc("last_frame"))
    counted = segments.groupBy("stem", "first_frame", "last_frame").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(late.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    tops = counted.withColumn("__before", before).where(F.col("__before") < entities).drop("__before")
    stem_type = segments.schema["stem"].dataType
    out = T.StructType([T.StructField("stem", stem_type), T.StructField("window_first", T.IntegerType()), T.StructField("window_last", T.IntegerType())])

    def candidates(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("first_frame", kind="stable")
        heap: list[int] = []
        longest, found = 0, []
        for first, group in pdf.groupby("first_frame", sort=True):
            for last, n in zip(group["last_frame"], group["n"]):
                for _ in range(min(int(n), entities)):
                    (heapq.heappush if len(heap) < entities else heapq.heappushpop)(heap, int(last))
            length = heap[0] - int(first) + 1 if len(heap) == entities else 0
            if length >= max(minimum, longest, 1):
                found = [*([] if length > longest else found), (pdf["stem"].iloc[0], int(first), heap[0])]
                longest = length
        return pd.DataFrame(found, columns=["stem", "window_first", "window_last"])

    longest = tops.groupBy("stem").applyInPandas(candidates, out)
    covering = segments.join(longest, "stem").where("first_frame <= window_first AND last_frame >= window_last")
    counts = covering.groupBy("stem", "window_first", "window_last").agg(F.count(F.lit(1)).alias("window_entities"))
    best = F.max(F.struct("window_entities", (-F.col("window_first")).alias("__early"), "window_last"))
    return counts.groupBy("stem").agg(best.alias("w")).select("stem", (-F.col("w.__early")).alias("window_first"), "w.window_last", "w.window_entities")


def trajectory_window(rows: DataFrame, minimum: int, entities: int) -> DataFrame:
    """One row per entity: its recording's common window and whether the entity can be compared in it, or why not."""
    segments = cut(observed_segments(rows, minimum))
    window = common_window(segments, minimum, entities)
    longest = segments.groupBy(*ENTITY).agg(F.max(F.col("last_frame") - F.col("first_frame") + 1).cast("int").alias("longest_segment"))
    inside = segments.join(window, "stem").where("first_frame <= window_first AND last_frame >= window_last").select(*ENTITY, F.lit(True).alias("__in"))
    all_ = rows.select(*ENTITY).distinct().join(window, "stem", "left").join(longest, ENTITY, "left").join(inside, ENTITY, "left")
    status = (
        F.when(F.col("longest_segment").isNull(), "too_few_consecutive_frames")
        .when(F.col("window_first").isNull(), "no_common_window")
        .when(F.col("__in").isNull(), "insufficient_common_window_coverage")
        .otherwise("available")
    )
    return all_.select(*ENTITY, "window_first", "window_last", "window_entities", F.coalesce("longest_segment", F.lit(0)).alias("longest_segment"), status.alias("status"))


def trajectory_distances(rows: DataFrame, vector: Column, dims: int, band: int, minimum: int, entities: int) -> DataFrame:
    """Bounded warping distance of every two entities of a recording over the recording's common window."""
    window = cut(trajectory_window(rows, minimum, entities).where("status = 'available'"))
    taken = rows.join(window.select(*ENTITY, "window_first", "window_last"), ENTITY).where(F.col("frame_index").between(F.col("window_first"), F.col("window_last")))
    symbols = taken.select(*ENTITY, (F.col("frame_index") - F.col("window_first")).alias("frame_index"), vector.alias("symbol"))
    clocks = window.select("stem", (F.col("window_last") - F.col("window_first") + 1).alias("n_frames")).distinct()
    return aligned_sequences(symbols, recording_pairs(window.select(*ENTITY)), clocks, band, dims=dims)


def recording_pairs(entities: DataFrame) -> DataFrame:
    """Every two entities of a recording, for a result that has a row for each of them. The recording is named
    as an equality, so the planner shuffles on it."""
    a = entities.select("stem", F.col("identity").alias("identity_a"))
    b = entities.select("stem", F.col("identity").alias("identity_b"))
    return a.join(b, "stem").where(F.col("identity_a") < F.col("identity_b"))


def next_state_rule(moves: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Most frequent successor of each state (ties: the smaller)."""
    n = moves.groupBy(*keys, "from_regime", "to_regime").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(*keys, "from_regime").agg(F.min_by("to_regime", F.struct(-F.col("n"), F.col("to_regime"))).alias("expected"), F.sum("n").alias("seen"))


def mismatch_by_cycle(moves: DataFrame, rule: DataFrame, keys: Sequence[str], period: float, bins: int) -> DataFrame:
    """Share of transitions that break the rule, folded on a declared cycle."""
    place = F.floor(F.pmod(F.col("hours"), F.lit(period)) / F.lit(period / bins)).cast("int")
    return moves.join(rule.select(*keys, "from_regime", "expected"), [*keys, "from_regime"]).groupBy(*keys, place.alias("bin")).agg(
        F.avg((F.col("to_regime") != F.col("expected")).cast("double")).alias("mismatch"), F.count(F.lit(1)).alias("n")
    )


def cycle_vector(binned: DataFrame, keys: Sequence[str], weight: str, bins: int) -> DataFrame:
    """Length and direction of the weighted mean vector around a cycle of bins, in parts of the weight to nine digits: a
    vector that cancels out has length 0 and no direction, whatever the last bits of its sums."""
    angle = (F.col("bin") + 0.5) * F.lit(2 * math.pi / bins)
    part = lambda wave: F.round(ratio(F.sum(F.col(weight) * wave(angle)), F.sum(weight)), 9) + 0.0
    s = binned.groupBy(*keys).agg(part(F.cos).alias("c"), part(F.sin).alias("s"))
    turn = F.round(F.pmod(F.atan2("s", "c") / F.lit(2 * math.pi), F.lit(1.0)), 9)
    return s.select(
        *keys, F.hypot("c", "s").alias("vector_length"), F.when((F.col("c") != 0) | (F.col("s") != 0), F.pmod(turn, F.lit(1.0))).alias("mean_direction_cycles")
    )


def symbol_sequences(classed: DataFrame, recordings: DataFrame) -> DataFrame:
    """One row per entity and frame of its recording's clock with its class, -1 where it has none."""
    timed = classed.select(*ENTITY).distinct().join(recordings.select("stem", "n_frames"), "stem")
    grid = timed.select(*ENTITY, F.explode(F.sequence(F.lit(0), F.col("n_frames") - 1)).alias("frame_index"))
    return grid.join(classed.select(*ENTITY, "frame_index", "regime"), [*ENTITY, "frame_index"], "left").select(
        *ENTITY, "frame_index", F.coalesce("regime", F.lit(-1)).alias("symbol")
    )
