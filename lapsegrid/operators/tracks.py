"""Steps, walks, smoothing, displacement by lag and trends along an entity's frames."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from lapsegrid.functions.numeric import corr_from_moments, heading_of, moments, ratio, safe_corr, wrap_angle
from lapsegrid.plans.heavy import has_heavy_key
from lapsegrid.plans.ranks import metric_quantiles, quantiles, with_average_rank
from lapsegrid.plans.scan import frame_bucket, islands, numbered, ordered_scan

ENTITY = ["stem", "identity"]


def steps(tracks: DataFrame, two_level: bool | None = None) -> DataFrame:
    """Step from the previous observation, the gapless step (one frame apart only), path and displacement."""
    slim = tracks.select(*ENTITY, "frame_index", "hours", "y", "x")
    big = has_heavy_key(slim, ENTITY) if two_level is None else two_level
    first = slim.groupBy(*ENTITY).agg(F.min_by(F.struct("y", "x"), F.col("frame_index")).alias("__o"))
    lagged = ordered_scan(
        slim, ENTITY, ["frame_index"], frame_bucket(),
        lag={"py": "y", "px": "x", "pf": "frame_index", "ph": "hours"}, two_level=big,
    )
    dy, dx = F.col("y") - F.col("py"), F.col("x") - F.col("px")
    # as in the SQL: hypot may round to the other side of a floor
    step = F.sqrt(dy * dy + dx * dx)
    stepped = (
        lagged.withColumn("frame_gap", (F.col("frame_index") - F.col("pf")).cast("long"))
        .withColumn("step_px", step)
        .withColumn("step_px_gapless", F.when(F.col("frame_gap") == 1, F.col("step_px")))
        .withColumn("step_per_frame", ratio("step_px", "frame_gap"))
        .withColumn("speed_px_per_hour", ratio("step_px", F.col("hours") - F.col("ph")))
        .withColumn("__s", F.coalesce("step_px", F.lit(0.0)))
    )
    walked = ordered_scan(stepped, ENTITY, ["frame_index"], frame_bucket(), running={"path_px": ("sum", "__s")}, two_level=big)
    return walked.join(first, ENTITY).select(
        *ENTITY, "frame_index", "hours", "y", "x", "py", "px", "pf", "frame_gap", "step_px", "step_px_gapless", "step_per_frame",
        "speed_px_per_hour", "path_px", F.hypot(F.col("y") - F.col("__o.y"), F.col("x") - F.col("__o.x")).alias("displacement_px"),
    )


def segments(stepped: DataFrame) -> DataFrame:
    """Path segments between consecutive frames; a missing frame leaves no segment."""
    return stepped.where(F.col("frame_gap") == 1).select(
        *ENTITY, "frame_index", F.col("px").alias("x1"), F.col("py").alias("y1"), F.col("x").alias("x2"), F.col("y").alias("y2")
    )


def turns(stepped: DataFrame, floor: float, two_level: bool | None = None) -> DataFrame:
    """Heading of each consecutive step of at least ``floor`` and the wrapped turn from the step before it."""
    headed = (F.col("frame_gap") == 1) & (F.col("step_px") >= floor)
    heading = heading_of(F.when(headed, F.col("y") - F.col("py")), F.when(headed, F.col("x") - F.col("px")))
    headed = stepped.withColumn("heading", heading).select(*ENTITY, "frame_index", "frame_gap", "step_px", "heading")
    lagged = ordered_scan(
        headed, ENTITY, ["frame_index"], frame_bucket(), lag={"ph": "heading"}, two_level=two_level
    )
    turn = F.when(F.col("frame_gap") == 1, wrap_angle(F.col("heading") - F.col("ph")))
    return lagged.withColumn("turn", turn).withColumn("cos_turn", F.cos("turn")).drop("ph")


def turn_runs(turned: DataFrame, threshold: float) -> DataFrame:
    """Lengths of stretches between large turns. A turn that cannot be measured ends a stretch unfinished."""
    ended = F.col("turn").isNull() | (F.abs("turn") > threshold)
    marked = turned.withColumn("__e", ended.cast("int")).withColumn("__u", F.col("turn").isNull().cast("int"))
    numbered_runs = islands(
        marked, ENTITY, ["frame_index"], F.col("__pe") == 1, frame_bucket(), lag={"__pe": "__e"}, alias="run"
    )
    runs = numbered_runs.groupBy(*ENTITY, "run").agg(
        F.sum(1 - F.col("__u")).alias("steps"), F.max("__u").alias("__aborted")
    )
    finished = runs.where((F.col("steps") > 0))
    return finished.groupBy(*ENTITY).agg(
        F.count(F.lit(1)).alias("runs"), F.avg("steps").alias("mean_run"), F.max("steps").alias("longest_run"),
        F.sum("__aborted").alias("aborted_runs"),
    )


def centred_mean(df: DataFrame, value: str, window: int, alias: str, keys=tuple(ENTITY)) -> DataFrame:
    """Mean over an odd window of frames, only where every frame is present with a value.

    Each value is handed to the frames whose window covers it, so a long entity is spread by target frame
    and the window never needs a sorted partition.
    """
    r = window // 2
    spread = df.where(F.col(value).isNotNull()).select(
        *keys, F.explode(F.sequence(F.col("frame_index") - r, F.col("frame_index") + r)).alias("frame_index"), F.col(value).alias("__v")
    )
    means = spread.groupBy(*keys, "frame_index").agg(F.avg("__v").alias("__m"), F.count(F.lit(1)).alias("__n"))
    full = means.where(F.col("__n") == window).select(*keys, "frame_index", F.col("__m").alias(alias))
    return df.join(full, [*keys, "frame_index"], "left")


def median_then_mean(df: DataFrame, value: str, alias: str, keys=tuple(ENTITY)) -> DataFrame:
    """Three-frame median, then the strict three-frame mean of it."""
    spread = df.where(F.col(value).isNotNull()).select(
        *keys, F.explode(F.sequence(F.col("frame_index") - 1, F.col("frame_index") + 1)).alias("frame_index"), F.col(value).alias("__v")
    )
    # three values at most in a group
    mids = spread.groupBy(*keys, "frame_index").agg(F.median("__v").alias("__med"), F.count(F.lit(1)).alias("__n"))
    with_mid = df.join(mids.where(F.col("__n") == 3).drop("__n"), [*keys, "frame_index"], "left")
    return centred_mean(with_mid, "__med", 3, alias, keys).withColumnRenamed("__med", alias + "_median")


def running_baseline(df: DataFrame, value: str, half_window: int, keys=tuple(ENTITY), statistic: str = "mean") -> DataFrame:
    """Centred mean or median of whatever frames exist within the window, the residual, and whether the window is cut
    by an end of the trace. A value goes to the frames it counts for, so a group is one window, whatever the trace."""
    spread = df.where(F.col(value).isNotNull()).select(
        *keys, F.explode(F.sequence(F.col("frame_index") - half_window, F.col("frame_index") + half_window)).alias("frame_index"),
        F.col(value).alias("__v"),
    )
    middle = {"mean": F.avg, "median": F.median}[statistic]("__v").cast("double")
    means = spread.groupBy(*keys, "frame_index").agg(middle.alias("baseline"))
    ends = df.groupBy(*keys).agg(F.min("frame_index").alias("__f0"), F.max("frame_index").alias("__f1"))
    edge = (F.col("frame_index") - half_window < F.col("__f0")) | (F.col("frame_index") + half_window > F.col("__f1"))
    return (
        df.join(means, [*keys, "frame_index"], "left").join(ends, list(keys))
        .withColumn("residual", F.col(value) - F.col("baseline")).withColumn("edge", edge).drop("__f0", "__f1")
    )


def linear_detrend(df: DataFrame, value: str, time: str = "hours", keys=tuple(ENTITY)) -> DataFrame:
    """Residual from each entity's least-squares line; a single time gives the residual from the mean."""
    line = df.groupBy(*keys).agg(
        F.regr_slope(value, time).alias("__b"), F.avg(F.when(F.col(value).isNotNull(), F.col(time))).alias("__t"), F.avg(value).alias("__m")
    )
    fit = F.col("__m") + F.coalesce(F.col("__b"), F.lit(0.0)) * (F.col(time) - F.col("__t"))
    return df.join(line, list(keys)).withColumn("baseline", fit).withColumn("residual", F.col(value) - fit).drop("__b", "__t", "__m")


def polynomial_detrend(df: DataFrame, value: str, time: str = "hours", keys=tuple(ENTITY)) -> DataFrame:
    """Quadratic baseline from summed normal equations on centred time (closed form)."""
    centre = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(
        F.avg(time).alias("__c"), F.greatest(F.max(time) - F.min(time), F.lit(1e-12)).alias("__w")
    )
    t = (F.col(time) - F.col("__c")) / F.col("__w")
    at = df.join(centre, list(keys), "left").withColumn("__t", t)
    v = F.col(value)
    power = lambda k: F.sum(F.when(v.isNotNull(), F.pow("__t", F.lit(float(k)))))
    sums = at.groupBy(*keys).agg(
        F.count(v).cast("double").alias("n"), power(2).alias("s2"), power(3).alias("s3"), power(4).alias("s4"),
        F.sum(v).alias("y0"), F.sum(v * F.col("__t")).alias("y1"), F.sum(v * F.col("__t") * F.col("__t")).alias("y2"),
    )
    n, s2, s3, s4, y0, y1, y2 = (F.col(c) for c in ("n", "s2", "s3", "s4", "y0", "y1", "y2"))
    # centred time makes the first-power sum zero
    det = n * (s2 * s4 - s3 * s3) - s2 * s2 * s2
    good = F.abs(det) > 1e-12
    a = F.when(good, (y0 * (s2 * s4 - s3 * s3) + s2 * (y1 * s3 - s2 * y2)) / det)
    b = F.when(good, (n * (y1 * s4 - s3 * y2) + s2 * (y0 * s3 - s2 * y1)) / det)
    c = F.when(good, (n * (s2 * y2 - s3 * y1) - s2 * s2 * y0) / det)
    fit = sums.select(*keys, a.alias("__a0"), b.alias("__a1"), c.alias("__a2"))
    base = F.col("__a0") + F.col("__a1") * F.col("__t") + F.col("__a2") * F.col("__t") * F.col("__t")
    return (
        at.join(fit, list(keys)).withColumn("baseline", base).withColumn("residual", v - base)
        .drop("__c", "__w", "__t", "__a0", "__a1", "__a2")
    )


def first_difference(df: DataFrame, value: str) -> DataFrame:
    lagged = ordered_scan(df, ENTITY, ["frame_index"], frame_bucket(), lag={"__pv": value, "__pf": "frame_index"})
    return lagged.withColumn(
        "difference", F.when(F.col("frame_index") - F.col("__pf") == 1, F.col(value) - F.col("__pv"))
    ).drop("__pv", "__pf")


def interpolated_smooth(df: DataFrame, value: str, half_window: int, alias: str = "smooth") -> DataFrame:
    """Interior gaps filled linearly on the frame axis, then a centred mean inside the observed span."""
    slim = df.where(F.col(value).isNotNull()).select(*ENTITY, "frame_index", F.col(value).alias("__v"))
    ahead = ordered_scan(slim, ENTITY, ["frame_index"], frame_bucket(), lead={"__nf": "frame_index", "__nv": "__v"})
    last = F.coalesce(F.col("__nf") - 1, F.col("frame_index"))
    filled = ahead.withColumn("__f", F.explode(F.sequence(F.col("frame_index"), last))).select(
        *ENTITY,
        F.col("__f").alias("frame_index"),
        F.when(F.col("__f") == F.col("frame_index"), F.col("__v")).otherwise(
            F.col("__v") + (F.col("__nv") - F.col("__v")) * (F.col("__f") - F.col("frame_index")) / (F.col("__nf") - F.col("frame_index"))
        ).alias("filled"),
    )
    spread = filled.select(
        *ENTITY, F.explode(F.sequence(F.col("frame_index") - half_window, F.col("frame_index") + half_window)).alias("frame_index"),
        F.col("filled").alias("__v"),
    )
    means = spread.groupBy(*ENTITY, "frame_index").agg(F.avg("__v").alias(alias))
    return filled.join(means, [*ENTITY, "frame_index"], "left")


def sustained_onsets(df: DataFrame, value: str, sustain: int) -> DataFrame:
    """First frame where a centred trace turns from negative to positive and stays so for ``sustain`` frames."""
    lagged = ordered_scan(
        df.where(F.col(value).isNotNull()), ENTITY, ["frame_index"], frame_bucket(), lag={"__pv": value, "__pf": "frame_index"}
    )
    crossed = lagged.where((F.col("__pv") <= 0) & (F.col(value) > 0) & (F.col("frame_index") - F.col("__pf") == 1)).select(
        *ENTITY, F.col("frame_index").alias("onset_frame")
    )
    ahead = crossed.withColumn("frame_index", F.explode(F.sequence(F.col("onset_frame"), F.col("onset_frame") + sustain - 1)))
    held = ahead.join(df.select(*ENTITY, "frame_index", value), [*ENTITY, "frame_index"]).where(F.col(value) > 0)
    kept = held.groupBy(*ENTITY, "onset_frame").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") == sustain)
    return kept.groupBy(*ENTITY).agg(F.min("onset_frame").alias("onset_frame"), F.count(F.lit(1)).alias("crossings"))


def track_summary(stepped: DataFrame, minimum: int = 5) -> DataFrame:
    """Path, net displacement, straightness, step statistics and gaps per entity."""
    base = stepped.groupBy(*ENTITY).agg(
        F.count(F.lit(1)).alias("frames"),
        F.sum("step_px").alias("path_px"),
        F.max_by("displacement_px", "frame_index").alias("net_px"),
        F.count("step_px_gapless").alias("consecutive_steps"),
        F.max("step_px_gapless").alias("max_step"),
        F.avg("speed_px_per_hour").alias("mean_speed"),
        (F.max("frame_index") - F.min("frame_index") + 1).cast("long").alias("span_frames"),
    )
    q = metric_quantiles(stepped, ENTITY, ["step_px_gapless"], {"median": 0.5, "p95": 0.95})
    return (
        base.where(F.col("frames") >= minimum).join(q, ENTITY)
        .withColumnRenamed("step_px_gapless_median", "median_step").withColumnRenamed("step_px_gapless_p95", "p95_step")
        .withColumn("straightness", ratio("net_px", "path_px"))
        .withColumn("gap_frames", F.col("span_frames") - F.col("frames"))
    )


def walk_summary(stepped: DataFrame, floor: float) -> DataFrame:
    """Turning, stationary share, net direction, path asymmetry and circular spread per entity."""
    turned = turns(stepped, floor)
    angles = turned.groupBy(*ENTITY).agg(
        F.count("turn").alias("turns"),
        F.avg("cos_turn").alias("mean_cos_turn"),
        F.avg(F.cos("heading")).alias("__c"),
        F.avg(F.sin("heading")).alias("__s"),
        F.avg(F.when(F.col("frame_gap") == 1, (F.col("step_px") < floor).cast("double"))).alias("stationary_fraction"),
    )
    r = F.hypot("__c", "__s")
    shape = stepped.groupBy(*ENTITY).agg(
        F.var_samp("x").alias("__vx"), F.var_samp("y").alias("__vy"), F.covar_samp("x", "y").alias("__cxy"),
        F.min_by(F.struct("x", "y"), F.col("frame_index")).alias("__a"), F.max_by(F.struct("x", "y"), F.col("frame_index")).alias("__b"),
    )
    half = (F.col("__vx") + F.col("__vy")) / 2
    root = F.sqrt(F.pow((F.col("__vx") - F.col("__vy")) / 2, 2) + F.pow("__cxy", 2))
    return (
        angles.join(shape, ENTITY)
        .withColumn("circular_dispersion", F.when((r > 0) & (r <= 1), F.sqrt(-2 * F.ln(r))))
        .withColumn("net_angle", F.atan2(F.col("__b.y") - F.col("__a.y"), F.col("__b.x") - F.col("__a.x")))
        .withColumn("path_asymmetry", F.when(half + root > 1e-12, F.greatest(half - root, F.lit(0.0)) / (half + root)))
        .drop("__c", "__s", "__vx", "__vy", "__cxy", "__a", "__b")
    )


def frame_resultant(turned: DataFrame) -> DataFrame:
    """Length of the mean heading vector of all entities at a frame (a drift check)."""
    return turned.groupBy("stem", "frame_index").agg(
        F.count("heading").alias("entities"), F.hypot(F.avg(F.cos("heading")), F.avg(F.sin("heading"))).alias("resultant")
    ).where(F.col("entities") > 0)


def lag_pairs(df: DataFrame, columns: list[str], max_lag: int, keys=tuple(ENTITY)) -> DataFrame:
    """Rows of an entity exactly ``lag`` frames apart, for each lag 1..max_lag: an equi-join on the shifted
    frame, so missing frames give no pair and an entity is spread over tasks by frame."""
    first = df.select(*keys, F.col("frame_index").alias("__f"), *[F.col(c).alias("a_" + c) for c in columns])
    ahead = first.withColumn("lag_frames", F.explode(F.sequence(F.lit(1), F.lit(max_lag)))).withColumn(
        "frame_index", (F.col("__f") + F.col("lag_frames")).cast("int")
    )
    second = df.select(*keys, "frame_index", *[F.col(c).alias("b_" + c) for c in columns])
    return ahead.join(second, [*keys, "frame_index"]).drop("__f")


def displacement_by_lag(tracks: DataFrame, max_lag: int, minimum_pairs: int = 3) -> DataFrame:
    """Mean squared displacement per entity and lag."""
    sq = F.pow(F.col("b_y") - F.col("a_y"), 2) + F.pow(F.col("b_x") - F.col("a_x"), 2)
    return (
        lag_pairs(tracks, ["y", "x"], max_lag).groupBy(*ENTITY, "lag_frames")
        .agg(F.avg(sq).alias("msd_px2"), F.count(F.lit(1)).alias("pairs")).where(F.col("pairs") >= minimum_pairs)
    )


def growth_exponent(msd: DataFrame, minimum_lags: int = 3) -> DataFrame:
    """Slope of log displacement on log lag."""
    good = msd.where(F.col("msd_px2") > 0)
    return good.groupBy(*ENTITY).agg(
        F.count(F.lit(1)).alias("lags"), F.regr_slope(F.ln("msd_px2"), F.ln(F.col("lag_frames").cast("double"))).alias("exponent")
    ).where(F.col("lags") >= minimum_lags)


def direction_halflife(turned: DataFrame, max_lag: int) -> DataFrame:
    """First lag whose mean cosine of heading change is under one half, interpolated from the lag before it."""
    pairs = lag_pairs(turned.where(F.col("heading").isNotNull()), ["heading"], max_lag)
    means = pairs.groupBy(*ENTITY, "lag_frames").agg(F.avg(F.cos(F.col("b_heading") - F.col("a_heading"))).alias("c"))
    start = turned.where(F.col("heading").isNotNull()).select(*ENTITY).distinct().select(
        *ENTITY, F.lit(0).alias("lag_frames"), F.lit(1.0).alias("c")
    )
    # at most max_lag + 1 rows per entity
    curve = ordered_scan(
        start.unionByName(means), ENTITY, ["lag_frames"], frame_bucket("lag_frames"), lag={"pc": "c", "pl": "lag_frames"}, two_level=False
    )
    under = curve.where((F.col("c") < 0.5) & (F.col("pc") >= 0.5))
    at = F.col("pl") + (F.col("pc") - 0.5) / (F.col("pc") - F.col("c")) * (F.col("lag_frames") - F.col("pl"))
    return under.groupBy(*ENTITY).agg(F.min_by(at, F.col("lag_frames")).alias("halflife_frames"))
