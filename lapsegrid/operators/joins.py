"""Joins of observation tables: module joins, side tables, nearest-unique clocks and interval intersections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from lapsegrid.functions.numeric import ratio
from lapsegrid.plans.ranges import overlap_join
from lapsegrid.plans.scan import ordered_scan


def join_modules(tables: Sequence[DataFrame], keys: Sequence[str], clock: DataFrame | None = None) -> DataFrame:
    """Full outer join at one grain; a column belongs to the first table that has it."""
    keys = list(keys)
    out = tables[0]
    for t in tables[1:]:
        fresh = [c for c in t.columns if c in keys or c not in out.columns]
        out = out.join(t.select(*fresh), keys, "full_outer")
    return out if clock is None else out.join(clock, [c for c in clock.columns if c in keys], "left")


def fold(base: DataFrame, derived: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join of the columns ``base`` does not have yet."""
    fresh = [c for c in derived.columns if c not in keys and c not in base.columns]
    return base.join(derived.select(*keys, *fresh), list(keys), "left")


def granted(df: DataFrame, side_columns: Sequence[str], grants: Sequence[str]) -> DataFrame:
    """A derived step's view: side columns it did not name are hidden; a grant for an absent column is refused."""
    unknown = sorted(set(grants) - set(side_columns))
    if unknown:
        raise ValueError(f"unknown side columns {unknown}")
    return df.drop(*[c for c in side_columns if c not in grants])


def nearest_unique(reference: DataFrame, target: DataFrame, keys: Sequence[str], time: str, lag, tolerance, bucket_width) -> DataFrame:
    """For each reference time, the target observation nearest to ``time + lag`` within ``tolerance``.

    Equidistant candidates and targets wanted by more than one reference are rejected and named. Both clocks
    are laid on one line and scanned once in each direction, so only the two neighbours of a reference are
    ever looked at, however many targets lie within the tolerance.
    """
    keys = list(keys)
    r = reference.select(*keys, (F.col(time) + F.lit(lag)).alias("at"), F.lit(1).alias("side"), F.lit(None).cast("long").alias("hit"))
    t = target.select(*keys, F.col(time).alias("at"), F.lit(0).alias("side"), F.col(time).alias("hit"))
    line = r.withColumn("hit", F.col("hit").cast(target.schema[time].dataType)).unionByName(t)
    scanned = ordered_scan(
        line, keys, ["at", "side"], F.floor(F.col("at") / F.lit(bucket_width)).cast("long"),
        fill_forward={"before": "hit"}, fill_backward={"after": "hit"},
    ).where(F.col("side") == 1)
    d1, d2 = F.col("at") - F.col("before"), F.col("after") - F.col("at")
    n1, n2 = F.when(d1 <= tolerance, d1), F.when(d2 <= tolerance, d2)
    tie = (n1 == n2) & (n1 > 0)
    choice = F.when(tie, F.lit(None)).when(n2.isNull() | (n1 <= n2), F.when(n1.isNotNull(), F.col("before"))).otherwise(F.col("after"))
    picked = scanned.withColumn("target_at", choice).withColumn("__tie", F.coalesce(tie, F.lit(False)))
    wanted = picked.where(F.col("target_at").isNotNull()).groupBy(*keys, "target_at").agg(F.count(F.lit(1)).alias("__wanted"))
    joined = picked.join(wanted, [*keys, "target_at"], "left")
    status = (
        F.when(F.col("__tie"), F.lit("equidistant")).when(F.col("target_at").isNull(), F.lit("none"))
        .when(F.col("__wanted") > 1, F.lit("collision")).otherwise(F.lit("matched"))
    )
    good = status == "matched"
    return joined.select(
        *keys, (F.col("at") - F.lit(lag)).alias("reference_at"),
        F.when(good, F.col("target_at")).alias("target_at"),
        F.when(good, F.abs(F.col("target_at") - F.col("at"))).alias("distance"),
        status.alias("match_status"),
    )


def match_support(matches: DataFrame, keys: Sequence[str], max_gap, minimum: int, bucket_width) -> DataFrame:
    """Matched observations, span, gaps beyond ``max_gap`` and ambiguity of each key."""
    keys = list(keys)
    hits = ordered_scan(
        matches.where(F.col("match_status") == "matched").select(*keys, "reference_at"), keys, ["reference_at"],
        F.floor(F.col("reference_at") / F.lit(bucket_width)).cast("long"), lag={"__p": "reference_at"},
    )
    step = F.col("reference_at") - F.col("__p")
    good = hits.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), (F.max("reference_at") - F.min("reference_at")).alias("span"),
        F.sum(F.coalesce((step > max_gap).cast("long"), F.lit(0))).alias("gaps"), F.max(step).alias("largest_gap"),
    )
    bad = matches.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("references"),
        F.sum(F.col("match_status").isin("equidistant", "collision").cast("long")).alias("ambiguous"),
    )
    out = bad.join(good, keys, "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    return out.withColumn("status", F.when(F.col("n") >= minimum, F.lit("eligible")).otherwise(F.lit("insufficient")))


def adjacent_intervals(rows: DataFrame, keys: Sequence[str], time: str, max_gap: float, bucket_width: float, carry: dict[str, str] | None = None) -> DataFrame:
    """Intervals between successive observations no further apart than ``max_gap``; ``carry`` names columns to
    keep from both ends."""
    carry = carry or {}
    stepped = ordered_scan(
        rows, keys, [time], F.floor(F.col(time) / F.lit(bucket_width)).cast("long"),
        lead={"__hi": time, **{f"next_{a}": c for a, c in carry.items()}},
    )
    return stepped.where(F.col("__hi") - F.col(time) <= max_gap).select(
        *keys, F.col(time).alias("from_hours"), F.col("__hi").alias("to_hours"),
        *[F.col(c).alias(a) for a, c in carry.items()], *[F.col(f"next_{a}") for a in carry],
    )


def joint_intervals(left: DataFrame, right: DataFrame, keys: Sequence[str], width: float) -> DataFrame:
    """Intersections of two entities' supported intervals, with unsupported rows filling their common domain."""
    keys = list(keys)
    a = left.select(*keys, F.col("from_hours").alias("la"), F.col("to_hours").alias("lb"))
    b = right.select(*keys, F.col("from_hours").alias("ra"), F.col("to_hours").alias("rb"))
    domain = (
        a.groupBy(*keys).agg(F.min("la").alias("a0"), F.max("lb").alias("a1"))
        .join(b.groupBy(*keys).agg(F.min("ra").alias("b0"), F.max("rb").alias("b1")), keys)
        .select(*keys, F.greatest("a0", "b0").alias("d0"), F.least("a1", "b1").alias("d1")).where(F.col("d0") < F.col("d1"))
    )
    pieces = overlap_join(a, b, keys, ("la", "lb"), ("ra", "rb"), width).select(*keys, "lo", "hi")
    # domain ends act as empty pieces, so every uncovered stretch is a gap between neighbours
    ends = domain.select(*keys, F.explode(F.array("d0", "d1")).alias("lo")).withColumn("hi", F.col("lo"))
    line = pieces.unionByName(ends).distinct()
    nexts = ordered_scan(line, keys, ["lo", "hi"], F.floor(F.col("lo") / F.lit(width)).cast("long"), lead={"__n": "lo"})
    gaps = nexts.where(F.col("__n") > F.col("hi")).select(*keys, F.col("hi").alias("lo"), F.col("__n").alias("hi"), F.lit(False).alias("supported"))
    return pieces.withColumn("supported", F.lit(True)).unionByName(gaps)


def joint_exposure(left: DataFrame, right: DataFrame, keys: Sequence[str], width: float) -> DataFrame:
    """Intersection of two entities' exposures with how well each stretch is known and whether states agree."""
    keys = list(keys)
    a = left.select(*keys, F.col("lo").alias("la"), F.col("hi").alias("lb"), F.col("exposure").alias("left_state"))
    b = right.select(*keys, F.col("lo").alias("ra"), F.col("hi").alias("rb"), F.col("exposure").alias("right_state"))
    both = overlap_join(a, b, keys, ("la", "lb"), ("ra", "rb"), width)
    either = lambda s: (F.col("left_state") == s) | (F.col("right_state") == s)
    support = F.when(either("unobserved"), F.lit("unobserved")).when(either("unknown"), F.lit("unknown")).otherwise(F.lit("assigned"))
    return both.select(
        *keys, "lo", "hi", "left_state", "right_state", support.alias("support"),
        F.when(support == "assigned", F.col("left_state") == F.col("right_state")).alias("same_state"),
    )


def transition_support(left: DataFrame, right: DataFrame, keys: Sequence[str], width: float) -> DataFrame:
    """Overlaps of two entities' state steps, with which of them changed."""
    keys = list(keys)

    def prepared(df, p):
        changed = F.col("state") != F.col("next_state")
        return df.where(F.col("state").isNotNull() & F.col("next_state").isNotNull()).select(
            *keys, F.col("from_hours").alias(p + "a"), F.col("to_hours").alias(p + "b"), changed.alias(p + "changed")
        )

    both = overlap_join(prepared(left, "l"), prepared(right, "r"), keys, ("la", "lb"), ("ra", "rb"), width)
    return both.select(*keys, "lo", "hi", F.col("lchanged").alias("left_changed"), F.col("rchanged").alias("right_changed"))


def switch_events(steps: DataFrame, support: DataFrame, keys: Sequence[str], width: float) -> DataFrame:
    """State changes of one entity with whether the whole step lies in joint support."""
    keys = list(keys)
    moved = steps.where(F.col("state") != F.col("next_state")).select(*keys, "from_hours", "to_hours", "state", "next_state")
    pieces = overlap_join(
        moved, support.select(*keys, F.col("lo").alias("sa"), F.col("hi").alias("sb")), keys, ("from_hours", "to_hours"), ("sa", "sb"), width
    )
    covered = pieces.groupBy(*keys, "from_hours").agg(F.sum(F.col("hi") - F.col("lo")).alias("covered_hours"))
    out = moved.join(covered, [*keys, "from_hours"], "left").withColumn("covered_hours", F.coalesce("covered_hours", F.lit(0.0)))
    return out.withColumn(
        "complete", F.col("covered_hours") >= F.col("to_hours") - F.col("from_hours") - 1e-9
    ).withColumn("at_hours", (F.col("from_hours") + F.col("to_hours")) / 2)


def event_coincidence(left: DataFrame, right: DataFrame, keys: Sequence[str], time: str, tolerance, bucket_width) -> DataFrame:
    """Nearest-unique matches of two event series within a tolerance, as fractions of either side."""
    keys = list(keys)
    matched = nearest_unique(left, right, keys, time, 0, tolerance, bucket_width)
    l = matched.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("left_events"), F.sum((F.col("match_status") == "matched").cast("long")).alias("matched"),
        F.sum(F.col("match_status").isin("equidistant", "collision").cast("long")).alias("ambiguous"),
    )
    r = right.groupBy(*keys).agg(F.count(F.lit(1)).alias("right_events"))
    out = l.join(r, keys, "full_outer").na.fill(0, ["left_events", "right_events", "matched", "ambiguous"])
    return out.withColumn("left_fraction", ratio("matched", "left_events")).withColumn("right_fraction", ratio("matched", "right_events"))


def key_audit(known: DataFrame, recorded: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys present on one side only and on both, with a verdict, in one pass over both sides."""
    keys = list(keys)
    both = (
        known.select(*keys).distinct().withColumn("__k", F.lit(1))
        .join(recorded.select(*keys).distinct().withColumn("__r", F.lit(1)), keys, "full_outer")
    )
    return both.agg(
        F.sum((F.col("__k").isNotNull() & F.col("__r").isNotNull()).cast("long")).alias("shared"),
        F.sum(F.col("__r").isNull().cast("long")).alias("missing"),
        F.sum(F.col("__k").isNull().cast("long")).alias("spurious"),
    ).withColumn("passed", (F.col("missing") == 0) & (F.col("spurious") == 0))


def pool(tables: dict[str, DataFrame], stamp: Sequence[str] = ("stem",)) -> DataFrame:
    """Union by name with every column of every part; a part without its stamp is refused."""
    out = None
    for name, df in tables.items():
        lacking = [s for s in stamp if s not in df.columns]
        if lacking:
            raise ValueError(f"table of {name} lacks {lacking}")
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def pool_ledger(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows each part gives and the pooled columns it does not have."""
    every = sorted({c for df in tables.values() for c in df.columns})
    out = None
    for name, df in tables.items():
        lacking = ",".join(c for c in every if c not in df.columns)
        part = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("part"), "rows", F.lit(lacking).alias("missing_columns"))
        out = part if out is None else out.unionByName(part)
    return out


def add_runs(current: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Append rows whose key is not there yet."""
    return current.unionByName(incoming.join(current.select(*keys).distinct(), list(keys), "left_anti"))


def accepted_trace(observed: DataFrame, additions: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Observed rows plus gap additions of measured entities, with the source of each row. What is left out is
    what ``refused_additions`` returns."""
    keys = list(keys)
    grain = [*keys, "frame_index"]
    measured = additions.join(observed.select(*keys).distinct(), keys, "left_semi")
    clean = measured.join(observed.select(*grain), grain, "left_anti")
    return observed.select(*grain, value).withColumn("provenance", F.lit("observed")).unionByName(
        clean.select(*grain, value).withColumn("provenance", F.lit("added"))
    )


def refused_additions(observed: DataFrame, additions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Additions that ``accepted_trace`` refuses, each with its reason: the frame was observed, or the entity never was."""
    keys = list(keys)
    known = observed.select(*keys).distinct().withColumn("__known", F.lit(True))
    frames = observed.select(*keys, "frame_index").distinct().withColumn("__seen", F.lit(True))
    judged = additions.join(known, keys, "left").join(frames, [*keys, "frame_index"], "left")
    reason = F.when(F.col("__known").isNull(), "unmeasured_identity").when(F.col("__seen").isNotNull(), "observed_frame")
    return judged.withColumn("reason", reason).where("reason IS NOT NULL").drop("__known", "__seen")
