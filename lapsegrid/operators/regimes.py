"""Movement and size classes, their transitions and profiles; event tables and alignment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from lapsegrid.functions.numeric import ratio
from lapsegrid.operators.presence import ENTITY
from lapsegrid.plans.heavy import has_heavy_key
from lapsegrid.plans.ranks import metric_quantiles, quantiles, with_average_rank
from lapsegrid.plans.scan import frame_bucket, numbered, ordered_scan

LEVELS = ("low", "mid", "high")


def percentile_position(df: DataFrame, keys: Sequence[str], value: str, alias: str, two_level: bool | None = None) -> DataFrame:
    """Average-rank position of each value among the key's values, 0 to 1; a single value sits at 0.5."""
    ranked = with_average_rank(df, keys, value, "__rank", {"total": "__total"}, two_level)
    at = F.when(F.col("__total") == 1, F.lit(0.5)).otherwise((F.col("__rank") - 1) / F.greatest(F.col("__total") - 1, F.lit(1)))
    return ranked.withColumn(alias, F.when(F.col("__rank").isNotNull(), at)).drop("__rank", "__total")


def classify(df: DataFrame, keys: Sequence[str], size: str, movement: str, cuts: tuple[float, float] = (1 / 3, 2 / 3)) -> DataFrame:
    """Nine classes from two percentile axes, with the distance to the class centre, the runner-up class and
    the margin between them. Values equal to nine digits share a rank, whatever the last bits of a root."""
    complete = df.where(F.col(size).isNotNull() & F.col(movement).isNotNull()).withColumn("__size", F.round(size, 9)).withColumn("__movement", F.round(movement, 9))
    big = has_heavy_key(complete, keys)
    placed = percentile_position(percentile_position(complete, keys, "__size", "size_position", big), keys, "__movement", "movement_position", big).drop("__size", "__movement")

    def level(c: str) -> Column:
        return F.when(F.col(c) < cuts[0], 0).when(F.col(c) < cuts[1], 1).otherwise(2)

    bounds = (0.0, cuts[0], cuts[1], 1.0)
    centre = [(bounds[k] + bounds[k + 1]) / 2 for k in range(3)]
    options = F.array(
        *[
            F.struct(
                # rounded, so that mirror-image classes tie and the lower one is the runner-up
                F.round(F.hypot(F.col("size_position") - centre[s], F.col("movement_position") - centre[m]), 9).alias("distance"),
                F.lit(s * 3 + m).alias("regime"),
            )
            for s in range(3)
            for m in range(3)
        ]
    )
    own = level("size_position") * 3 + level("movement_position")
    classed = placed.withColumn("regime", own.cast("int")).withColumn("__o", options)
    rivals = F.array_min(F.filter("__o", lambda o: o["regime"] != F.col("regime")))
    return (
        classed.withColumn("centre_distance", F.element_at(F.col("__o"), F.col("regime") + 1)["distance"])
        .withColumn("__r", rivals)
        .withColumn("runner_up", F.col("__r.regime"))
        .withColumn("margin", F.col("__r.distance") - F.col("centre_distance"))
        .drop("__o", "__r")
    )


def transitions(classed: DataFrame) -> DataFrame:
    """From and to class of each pair of consecutive frames, self-transitions included, with the dwell the
    first one belongs to and its length."""
    big = has_heavy_key(classed, ENTITY)
    slim = classed.select(*ENTITY, "frame_index", "hours", "regime")
    stepped = ordered_scan(
        slim, ENTITY, ["frame_index"], frame_bucket(),
        lag={"__pf": "frame_index", "__pr": "regime"}, lead={"to_frame_index": "frame_index", "to_regime": "regime"}, two_level=big,
    )
    start = F.col("__pf").isNull() | (F.col("frame_index") - F.col("__pf") != 1) | (F.col("regime") != F.col("__pr"))
    marked = ordered_scan(
        stepped.withColumn("__s", start.cast("int")), ENTITY, ["frame_index"], frame_bucket(), running={"dwell_id": ("sum", "__s")}, two_level=big
    )
    sizes = marked.groupBy(*ENTITY, "dwell_id").agg(F.count(F.lit(1)).alias("dwell_frames"))
    return marked.where(F.col("to_frame_index") - F.col("frame_index") == 1).join(sizes, [*ENTITY, "dwell_id"]).select(
        *ENTITY, F.col("frame_index").alias("from_frame_index"), "to_frame_index", "hours",
        F.col("regime").alias("from_regime"), "to_regime", "dwell_id", "dwell_frames",
    )


def transition_matrix(moves: DataFrame, keys: Sequence[str], states: int, normalise: str = "row") -> DataFrame:
    """Counts on the full state grid, as shares of the row, the column, or unscaled."""
    keys = list(keys)
    counts = moves.groupBy(*keys, "from_regime", "to_regime").agg(F.count(F.lit(1)).alias("n"))
    grid = moves.select(*keys).distinct().select(
        *keys, F.explode(F.sequence(F.lit(0), F.lit(states - 1))).alias("from_regime")
    ).withColumn("to_regime", F.explode(F.sequence(F.lit(0), F.lit(states - 1))))
    full = grid.join(counts, [*keys, "from_regime", "to_regime"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    side = {"row": "from_regime", "column": "to_regime"}.get(normalise)
    if side is None:
        return full.withColumn("share", F.col("n").cast("double"))
    # the grid holds states x states rows per key
    return full.withColumn("share", ratio("n", F.sum("n").over(Window.partitionBy(*keys, side))))


def dwell_histogram(moves: DataFrame, keys: Sequence[str], width: int) -> DataFrame:
    """One count per dwell, by class and length bucket."""
    dwells = moves.select(*ENTITY, "dwell_id", "from_regime", "dwell_frames").dropDuplicates([*ENTITY, "dwell_id"])
    bucket = F.floor((F.col("dwell_frames") - 1) / width).cast("int")
    return dwells.groupBy(*keys, "from_regime", bucket.alias("length_bucket")).agg(F.count(F.lit(1)).alias("dwells"))


def state_profile(classed: DataFrame, keys: Sequence[str], metrics: Sequence[str], states: int) -> DataFrame:
    """Count and median of each metric per class; an empty class takes the median of all rows."""
    keys = list(keys)
    own = classed.groupBy(*keys, "regime").agg(F.count(F.lit(1)).alias("observations"))
    med = metric_quantiles(classed, [*keys, "regime"], metrics, {"own": 0.5})
    everyone = metric_quantiles(classed, keys, metrics, {"all": 0.5})
    grid = everyone.withColumn("regime", F.explode(F.sequence(F.lit(0), F.lit(states - 1))))
    return (
        grid.join(own, [*keys, "regime"], "left").join(med, [*keys, "regime"], "left")
        .select(*keys, "regime", F.coalesce("observations", F.lit(0).cast("long")).alias("observations"),
                *[F.coalesce(f"{m}_own", f"{m}_all").alias(m) for m in metrics])
    )


def occupancy_by_time(classed: DataFrame, time: str = "hours") -> DataFrame:
    counts = classed.groupBy("stem", time, "regime").agg(F.count(F.lit(1)).alias("n"))
    totals = classed.groupBy("stem", time).agg(F.count(F.lit(1)).alias("__t"))
    return counts.join(totals, ["stem", time]).withColumn("fraction", ratio("n", "__t")).drop("__t")


def inside_outside(classed: DataFrame, inside: Column, metric: str) -> DataFrame:
    """Mean of a metric inside and outside a state; entities seen on one side only are left out."""
    i = F.coalesce(inside, F.lit(False))
    out = classed.groupBy(*ENTITY).agg(
        F.avg(F.when(i, F.col(metric))).alias("inside_mean"), F.avg(F.when(~i, F.col(metric))).alias("outside_mean"),
        F.count(F.when(i, F.col(metric))).alias("inside_n"), F.count(F.when(~i, F.col(metric))).alias("outside_n"),
    )
    return out.where((F.col("inside_n") > 0) & (F.col("outside_n") > 0)).withColumn("contrast", F.col("inside_mean") - F.col("outside_mean"))


# --- events ------------------------------------------------------------------------------------------


def event_ledger(events: DataFrame, censored: bool = True) -> DataFrame:
    kept = events if censored else events.where(F.col("status") != "censored")
    return kept.groupBy("event", "status").agg(F.count(F.lit(1)).alias("n"))


def event_clock(events: DataFrame, bin_hours: float) -> DataFrame:
    """Events per fixed bin of the clock, which ends with the last event of any kind; empty bins are rows."""
    hits = events.groupBy("event", F.floor(F.col("hours") / F.lit(bin_hours)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    last = hits.agg(F.max("bin")).first()[0]
    grid = hits.select("event").distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(last or 0))))
    return grid.join(hits, ["event", "bin"], "left").select(
        "event", "bin", (F.col("bin") * F.lit(bin_hours)).alias("from_hours"), F.coalesce("n", F.lit(0).cast("long")).alias("n")
    )


def event_accumulation(events: DataFrame, bin_hours: float) -> DataFrame:
    """Running count of events by kind at each distinct event time."""
    at = events.groupBy("event", "hours").agg(F.count(F.lit(1)).alias("here"))
    return ordered_scan(
        at, ["event"], ["hours"], F.floor(F.col("hours") / F.lit(bin_hours)).cast("long"), running={"accumulated": ("sum", "here")}
    )


def fate_flow(fates: DataFrame, minimum: int) -> DataFrame:
    return fates.groupBy("start_event", "end_event").agg(F.count(F.lit(1)).alias("entities")).where(F.col("entities") >= minimum)


def ranked_events(df: DataFrame, value: str, direction: str, top: int, start: int = 1) -> DataFrame:
    """The ``top`` most extreme observations of each entity, from rank ``start``: high, low, or furthest from the
    entity's median in units of its inter-quartile range. The rank filter is pushed below the shuffle, so an
    entity never gathers more than ``top`` rows per task."""
    rows = df.where(F.col(value).isNotNull())
    if direction == "deviation":
        q = quantiles(rows, ENTITY, value, {"__q1": 0.25, "__m": 0.5, "__q3": 0.75}).drop("total")
        scored = rows.join(q, ENTITY).withColumn("score", F.abs(ratio(F.col(value) - F.col("__m"), F.col("__q3") - F.col("__q1")))).drop("__q1", "__m", "__q3")
        scored = scored.where(F.col("score").isNotNull())
    else:
        scored = rows.withColumn("score", F.col(value) if direction == "high" else -F.col(value))
    w = Window.partitionBy(*ENTITY).orderBy(F.col("score").desc(), F.col("frame_index"))
    ranked = scored.withColumn("event_rank", F.row_number().over(w)).where(F.col("event_rank") <= start + top - 1)
    return ranked.where(F.col("event_rank") >= start)


def align(df: DataFrame, events: DataFrame, value: str, before: int, after: int) -> DataFrame:
    """Rows of an entity around its events by frame offset: each event asks for its own frames, an equi-join."""
    asked = events.select(*ENTITY, F.col("frame_index").alias("event_frame")).withColumn(
        "offset", F.explode(F.sequence(F.lit(-before), F.lit(after)))
    ).withColumn("frame_index", (F.col("event_frame") + F.col("offset")).cast("int"))
    return asked.join(df.select(*ENTITY, "frame_index", value), [*ENTITY, "frame_index"]).select(*ENTITY, "event_frame", "offset", value)


def standardise(df: DataFrame, value: str, alias: str = "z") -> DataFrame:
    """Against the entity's whole trace; a flat trace divides by one."""
    s = df.groupBy(*ENTITY).agg(F.avg(value).alias("__m"), F.stddev_pop(value).alias("__s"))
    flat = F.col("__s").isNull() | (F.col("__s") < 1e-9)
    return df.join(s, ENTITY).withColumn(
        alias, (F.col(value) - F.col("__m")) / F.when(flat, F.lit(1.0)).otherwise(F.col("__s"))
    ).drop("__m", "__s")


def aligned_curve(aligned: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Mean of each event at each offset, then mean and quartiles over events; ``keys`` come from the entity."""
    per_event = aligned.groupBy(*ENTITY, "event_frame", "offset").agg(F.avg(value).alias("__v"))
    at = [*keys, "offset"]
    mean = per_event.groupBy(*at).agg(F.avg("__v").alias("mean"), F.count("__v").alias("events"))
    return mean.join(quantiles(per_event, at, "__v", {"q25": 0.25, "q50": 0.5, "q75": 0.75}).drop("total"), at)


def transition_curves(classed: DataFrame, value: str, half: int) -> DataFrame:
    """Window of positions around each state change that fits inside the trace, z-scored inside the window."""
    big = has_heavy_key(classed, ENTITY)
    placed = numbered(classed.select(*ENTITY, "frame_index", "regime", value), ENTITY, ["frame_index"], frame_bucket(), "position", two_level=big)
    stepped = ordered_scan(placed, ENTITY, ["frame_index"], frame_bucket(), lag={"__pr": "regime"}, two_level=big)
    length = placed.groupBy(*ENTITY).agg(F.max("position").alias("__n"))
    changes = stepped.where(F.col("regime") != F.col("__pr")).select(*ENTITY, F.col("position").alias("event_position")).join(length, ENTITY)
    fit = changes.where((F.col("event_position") - half >= 1) & (F.col("event_position") + half <= F.col("__n"))).drop("__n")
    asked = fit.withColumn("offset", F.explode(F.sequence(F.lit(-half), F.lit(half)))).withColumn("position", F.col("event_position") + F.col("offset"))
    rows = asked.join(placed.select(*ENTITY, "position", value), [*ENTITY, "position"])
    s = rows.groupBy(*ENTITY, "event_position").agg(F.avg(value).alias("__m"), F.stddev_pop(value).alias("__s"))
    return rows.join(s, [*ENTITY, "event_position"]).select(
        *ENTITY, "event_position", "offset", F.when(F.col("__s") > 1e-9, (F.col(value) - F.col("__m")) / F.col("__s")).alias("z")
    )


def low_events(df: DataFrame, value: str, quantile: float) -> tuple[DataFrame, DataFrame]:
    """Observations at or under a quantile of all values, and each entity's event rate with its rank."""
    # one number, read first so that the scan below is a plain filter
    found = quantiles(df, [], value, {"cut": quantile}).first()
    cut = None if found is None else found["cut"]
    events = df.withColumn("cut", F.lit(cut).cast("double")).where(F.col(value) <= F.col("cut"))
    n = df.where(F.col(value).isNotNull()).groupBy(*ENTITY).agg(F.count(F.lit(1)).alias("observed"))
    e = events.groupBy(*ENTITY).agg(F.count(F.lit(1)).alias("events"))
    rates = n.join(e, ENTITY, "left").withColumn("events", F.coalesce("events", F.lit(0).cast("long"))).withColumn("rate", ratio("events", "observed"))
    ordered = rates.withColumn("__neg_rate", -F.col("rate")).withColumn("__neg_events", -F.col("events"))
    slot = F.floor(F.col("__neg_rate") * 1024).cast("long")
    ranked = numbered(ordered.withColumn("__all", F.lit(0)), ["__all"], ["__neg_rate", "__neg_events", "stem", "identity"], slot, "rate_rank")
    return events, ranked.drop("__neg_rate", "__neg_events", "__all")


def strongest_examples(events: DataFrame, value: str, top: int) -> DataFrame:
    """Each entity's most extreme event, then the ``top`` entities (a top-k report)."""
    best = events.groupBy(*ENTITY).agg(F.min(F.struct(value, "frame_index")).alias("b"))
    return best.select(*ENTITY, F.col(f"b.{value}").alias(value), F.col("b.frame_index").alias("frame_index")).orderBy(value, *ENTITY).limit(top)


def in_requested_order(df: DataFrame, identity: str, wanted: Sequence) -> DataFrame:
    """Rows of the requested identities with their place in the request."""
    return df.withColumn("request_order", F.array_position(F.array(*[F.lit(w) for w in wanted]), F.col(identity))).where(F.col("request_order") > 0)


def pages(df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, per_page: int) -> DataFrame:
    """Deterministic page number under a row budget."""
    return numbered(df, keys, order, bucket, "__rn").withColumn("page", F.floor((F.col("__rn") - 1) / per_page)).drop("__rn")
