"""Value normalisation, dense grids, feature tables and column screening."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from lapsegrid.functions.numeric import ratio
from lapsegrid.plans.blocks import entity_pair_moments
from lapsegrid.plans.ranks import metric_quantiles, quantiles, with_average_rank
from lapsegrid.plans.scan import frame_bucket, numbered, numbered_by, ordered_scan
from lapsegrid.functions.numeric import corr_from_moments

ENTITY = ["stem", "identity"]


def columns_for(groups: dict[str, Sequence[str]], wanted: Sequence[str], available: Sequence[str]) -> list[str]:
    """Column names with ``@group`` references expanded, each once, in order; unknown names are refused."""
    out: list[str] = []
    for name in wanted:
        if name.startswith("@") and name[1:] not in groups:
            raise ValueError(f"unknown group {name}")
        for c in groups[name[1:]] if name.startswith("@") else [name]:
            if c not in available:
                raise ValueError(f"unknown column {c}")
            if c not in out:
                out.append(c)
    return out


def dense_grid(df: DataFrame, value: str, recordings: DataFrame) -> DataFrame:
    """Every entity at every frame of its recording's clock; absent cells are NULL."""
    grid = df.select(*ENTITY).distinct().join(recordings.select("stem", "n_frames"), "stem")
    grid = grid.select(*ENTITY, F.explode(F.sequence(F.lit(0), F.col("n_frames") - 1)).alias("frame_index"))
    return grid.join(df.select(*ENTITY, "frame_index", value), [*ENTITY, "frame_index"], "left")


def minmax(df: DataFrame, value: str, keys: Sequence[str], alias: str = "scaled") -> DataFrame:
    """0..1 within ``keys``; a constant key sits at 0.5; NULL stays NULL."""
    s = df.groupBy(*keys).agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    at = F.when(F.col(value).isNull(), None).when(F.col("__hi") == F.col("__lo"), F.lit(0.5)).otherwise(
        F.try_divide(F.col(value) - F.col("__lo"), F.col("__hi") - F.col("__lo"))
    )
    return df.join(s, list(keys), "left").withColumn(alias, at).drop("__lo", "__hi")


def relative_to_median(df: DataFrame, value: str, alias: str = "relative") -> DataFrame:
    """Change relative to the entity's own median; NULL on a zero baseline."""
    q = quantiles(df, ENTITY, value, {"__f0": 0.5}).drop("total")
    return df.join(q, ENTITY, "left").withColumn(alias, ratio(F.col(value) - F.col("__f0"), "__f0")).drop("__f0")


def normalised(df: DataFrame, value: str, method: str, alias: str = "normalised") -> DataFrame:
    """``none``, ``mean`` (over the entity's mean), ``zscore`` or ``minmax`` per entity; a nonpositive mean or a
    flat trace gives NULL."""
    if method == "none":
        return df.withColumn(alias, F.col(value))
    if method == "minmax":
        return minmax(df, value, ENTITY, alias)
    s = df.groupBy(*ENTITY).agg(F.avg(value).alias("__m"), F.stddev_pop(value).alias("__s"))
    forms = {
        "mean": F.when(F.col("__m") > 0, F.col(value) / F.col("__m")),
        "zscore": F.when(F.col("__s") > 1e-9, (F.col(value) - F.col("__m")) / F.col("__s")),
    }
    if method not in forms:
        raise ValueError(f"unknown method {method}")
    return df.join(s, ENTITY).withColumn(alias, forms[method]).drop("__m", "__s")


def robust_scaled(long: DataFrame, training: DataFrame, row: str, column: str, value: str, family_size: int) -> DataFrame:
    """Columns centred on the training median and divided by the training inter-quartile range; missing values
    take the median, results are clipped to ten, and a family's columns share one column's weight."""
    fit = quantiles(long.join(training.select(row), row, "left_semi"), [column], value, {"q1": 0.25, "m": 0.5, "q3": 0.75}).drop("total")
    spread = F.col("q3") - F.col("q1")
    scaled = F.when(spread > 1e-12, (F.coalesce(F.col(value), F.col("m")) - F.col("m")) / spread).otherwise(0.0)
    clipped = F.least(F.greatest(scaled, F.lit(-10.0)), F.lit(10.0))
    return long.join(fit, column).select(row, column, (clipped / F.lit(float(family_size) ** 0.5)).alias("scaled"))


def column_correlations(long: DataFrame, row: str, column: str, value: str) -> DataFrame:
    """Spearman r of every two columns over rows having both: ranks per column, then blocks of columns times
    blocks of rows, of which there are many more."""
    ranked = with_average_rank(long.where(F.col(value).isNotNull()), [column], value, "__r").withColumn("__g", F.lit("all"))
    m = entity_pair_moments(ranked, ["__g"], column, row, "__r", stretches=4)
    return m.select(F.col("a").alias("column_a"), F.col("b").alias("column_b"), F.col("n").cast("long").alias("n"), corr_from_moments(tolerance=1e-12).alias("spearman"))


def screened_columns(long: DataFrame, row: str, column: str, value: str, max_missing: float, redundancy: float) -> DataFrame:
    """Each column with the reason it is dropped: too much missing, constant, or redundant with an earlier kept one, and which.

    The greedy pass is a fold over the ordered columns, each with those it is close to: one row of declared columns, inside Spark.
    """
    stats = long.groupBy(column).agg(
        F.avg(F.col(value).isNull().cast("double")).alias("missing"), F.min(value).alias("__lo"), F.max(value).alias("__hi")
    )
    basic = stats.withColumn(
        "reason", F.when(F.col("missing") > max_missing, "missing").when(F.col("__lo").isNull() | (F.col("__lo") == F.col("__hi")), "constant")
    ).select(column, "missing", "reason")
    pairs = column_correlations(long, row, column, value).where(F.abs("spearman") >= redundancy)
    both = F.array(F.struct(F.col("column_a").alias("c"), F.col("column_b").alias("o")), F.struct(F.col("column_b").alias("c"), F.col("column_a").alias("o")))
    close = pairs.select(F.inline(both)).groupBy(F.col("c").alias(column)).agg(F.collect_set("o").alias("close"))
    kind = long.schema[column].dataType.simpleString()
    none = F.array().cast(f"array<{kind}>")
    listed = basic.join(close, column, "left").select(F.struct(F.col(column).alias("c"), "missing", "reason", F.coalesce("close", none).alias("close")).alias("x"))
    packed = listed.agg(F.sort_array(F.collect_list("x")).alias("all"))
    keep = lambda kept, x: F.when(x["reason"].isNull() & ~F.arrays_overlap(kept, x["close"]), F.array_append(kept, x["c"])).otherwise(kept)
    judged = packed.select("all", F.aggregate("all", none, keep).alias("kept")).select("kept", F.inline("all"))
    twin = F.array_min(F.array_intersect("kept", "close"))
    redundant = F.col("reason").isNull() & ~F.array_contains("kept", F.col("c"))
    # a column that is not kept was close to one kept before it, the least of those it is close to
    return judged.select(F.col("c").alias(column), "missing", F.when(redundant, "redundant").otherwise(F.col("reason")).alias("reason"), F.when(redundant, twin).alias("redundant_with"))


def feature_table(base: DataFrame, axis_table: DataFrame, axis: str, axis_values: Sequence[str], value: str, keys: Sequence[str]) -> DataFrame:
    """Base table widened by median and inter-quartile range of a finer table, one pair of columns per declared
    value of its axis."""
    q = metric_quantiles(axis_table, [*keys, axis], [value], {"q1": 0.25, "median": 0.5, "q3": 0.75})
    slim = q.select(*keys, axis, F.col(f"{value}_median").alias("median"), (F.col(f"{value}_q3") - F.col(f"{value}_q1")).alias("iqr"))
    wide = slim.groupBy(*keys).pivot(axis, list(axis_values)).agg(F.max("median").alias(f"{value}_median"), F.max("iqr").alias(f"{value}_iqr"))
    return base.join(wide, list(keys), "left")


def since_occupied(grid: DataFrame, keys: Sequence[str], occupied: str, valid: str, two_level: bool | None = None) -> DataFrame:
    """Hours since a place was last held, started afresh after every unobserved frame."""
    held = F.when(F.col(occupied) & F.col(valid), F.struct("frame_index", "hours"))
    marked = grid.withColumn("__held", held).withColumn("__lost", F.when(~F.coalesce(F.col(valid), F.lit(False)), F.col("frame_index")))
    last = ordered_scan(marked, keys, ["frame_index"], frame_bucket(), running={"__from": ("max", "__lost")}, fill_forward={"__last": "__held"}, two_level=two_level)
    fresh = F.col("__from").isNull() | (F.col("__last.frame_index") > F.col("__from"))
    return last.where(F.col(valid)).select(*keys, "frame_index", F.when(fresh, F.col("hours") - F.col("__last.hours")).alias("since_hours"))


def snapshots(clock: DataFrame, requested: Sequence[float]) -> DataFrame:
    """Frame nearest to each requested hour (ties: the earlier)."""
    asked = clock.withColumn("requested", F.explode(F.array(*[F.lit(float(h)) for h in requested])))
    return asked.groupBy("stem", "requested").agg(F.min_by("frame_index", F.struct(F.round(F.abs(F.col("hours") - F.col("requested")), 9), F.col("frame_index"))).alias("frame_index"))


def spread_snapshots(clock: DataFrame, count: int) -> DataFrame:
    """``count`` actual frames spaced evenly over the frames a recording has."""
    placed = numbered(clock, ["stem"], ["frame_index"], frame_bucket(), "position")
    n = placed.groupBy("stem").agg(F.max("position").alias("__n"))
    want = n.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(count - 1)))).select(
        "stem", "k", (1 + F.floor((F.col("__n") - 1) * F.col("k") / F.lit(float(count - 1)) + 0.5)).cast("long").alias("position")
    )
    return want.join(placed, ["stem", "position"]).select("stem", "frame_index", "hours").distinct()


def complete_hours(observed: DataFrame, recordings: DataFrame, hours_per_frame: float) -> DataFrame:
    """Hours of every frame from the median origin of those observed; a frame that disagrees is refused by name."""
    origin = quantiles(observed.withColumn("__o", F.col("hours") - F.col("frame_index") * hours_per_frame), ["stem"], "__o", {"origin": 0.5}).drop("total")
    clock = recordings.select("stem", F.explode(F.sequence(F.lit(0), F.col("n_frames") - 1)).alias("frame_index"))
    grid = origin.join(clock, "stem")
    seen = observed.groupBy("stem", "frame_index").agg(F.min("hours").alias("__h"))
    joined = grid.join(seen, ["stem", "frame_index"], "left")
    guess = F.col("origin") + F.col("frame_index") * hours_per_frame
    off = F.abs(F.col("__h") - guess) > hours_per_frame / 2
    return joined.select("stem", "frame_index", F.coalesce("__h", guess).alias("hours"), F.when(F.col("__h").isNull(), "filled").when(off, "mismatch").otherwise("observed").alias("status"))


def stable_order(rows: DataFrame, keys: Sequence[str], order: Sequence[str], alias: str) -> DataFrame:
    """1-based place of each row in its key; ``-column`` descends, nulls come last either way, columns are of any type. The order must be unique."""
    sorts = [F.col(c.lstrip("-")).desc_nulls_last() if c.startswith("-") else F.col(c).asc_nulls_last() for c in order]
    return numbered_by(rows, keys, sorts, alias)
