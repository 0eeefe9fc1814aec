"""Presence, gaps, runs, bouts, episodes and exposures. No operator here bridges a missing step."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lapsegrid.functions.numeric import ratio
from lapsegrid.plans.heavy import has_heavy_key
from lapsegrid.plans.ranks import quantiles
from lapsegrid.plans.scan import frame_bucket, islands, numbered, ordered_scan

ENTITY = ["stem", "identity"]


def time_bucket(time: str = "hours", width: float = 4096.0) -> Column:
    return F.floor(F.col(time) / F.lit(width)).cast("long")


def lifespans(observations: DataFrame) -> DataFrame:
    return observations.groupBy(*ENTITY).agg(
        F.min("frame_index").alias("first_frame_index"),
        F.max("frame_index").alias("last_frame_index"),
        F.count(F.lit(1)).alias("observed"),
    )


def roll_call(observations: DataFrame, recordings: DataFrame) -> DataFrame:
    """Every entity at every frame of its recording: named, unclaimed (missing inside its life) or outside."""
    grid = lifespans(observations).join(recordings.select("stem", "n_frames"), "stem").withColumn(
        "frame_index", F.explode(F.sequence(F.lit(0), F.col("n_frames") - 1))
    )
    seen = observations.select(*ENTITY, "frame_index", F.lit(True).alias("seen"))
    inside = F.col("frame_index").between(F.col("first_frame_index"), F.col("last_frame_index"))
    state = F.when(F.col("seen"), F.lit("named")).when(inside, F.lit("unclaimed")).otherwise(F.lit("outside_lifespan"))
    return grid.join(seen, [*ENTITY, "frame_index"], "left").select(
        *ENTITY, "frame_index", state.alias("state"), "first_frame_index", "last_frame_index"
    )


def roll_call_by_frame(calls: DataFrame) -> DataFrame:
    named, lost = (F.sum((F.col("state") == s).cast("long")) for s in ("named", "unclaimed"))
    return calls.groupBy("stem", "frame_index").agg(
        named.alias("identities_named"),
        lost.alias("identities_unclaimed"),
        (named + lost).alias("identities_expected"),
        F.count(F.lit(1)).alias("identities_total"),
    )


def gap_intervals(observations: DataFrame, two_level: bool | None = None) -> DataFrame:
    """One row per run of missing frames inside an entity's life."""
    stepped = ordered_scan(
        observations.select(*ENTITY, "frame_index"), ENTITY, ["frame_index"], frame_bucket(),
        lead={"next_frame": "frame_index"}, two_level=two_level,
    )
    return stepped.where(F.col("next_frame") - F.col("frame_index") > 1).select(
        *ENTITY,
        (F.col("frame_index") + 1).alias("gap_start"),
        (F.col("next_frame") - 1).alias("gap_end"),
        (F.col("next_frame") - F.col("frame_index") - 1).cast("long").alias("gap_frames"),
    )


def presence_audit(observations: DataFrame, recordings: DataFrame) -> DataFrame:
    """Observed and missing shares: leading, trailing and internal, with the longest internal run."""
    gaps = gap_intervals(observations).groupBy(*ENTITY).agg(
        F.max("gap_frames").alias("longest_gap"), F.sum("gap_frames").alias("internal_missing"), F.count(F.lit(1)).alias("gaps")
    )
    zero = F.lit(0).cast("long")
    base = lifespans(observations).join(gaps, ENTITY, "left").join(recordings.select("stem", "n_frames"), "stem")
    total = F.col("n_frames")
    return base.select(
        *ENTITY,
        "observed",
        (total - F.col("observed")).alias("missing"),
        ratio(total - F.col("observed"), total).alias("missing_fraction"),
        F.coalesce("longest_gap", zero).alias("longest_gap"),
        F.coalesce("gaps", zero).alias("gaps"),
        F.coalesce("internal_missing", zero).alias("internal_missing"),
        F.col("first_frame_index").cast("long").alias("leading_missing"),
        (total - 1 - F.col("last_frame_index")).cast("long").alias("trailing_missing"),
    )


def eligibility(audit: DataFrame, hours_per_frame: float, max_gap_hours: float | None = None, max_gap_frames: int | None = None,
                max_missing: int | None = None, missing_fraction: float | None = None) -> DataFrame:
    """Eligibility with every reason that failed; gap limits are exceeded with >, the fraction with >=."""
    rules: list[Column] = []
    if max_gap_frames is not None:
        rules.append(F.when(F.col("longest_gap") > max_gap_frames, F.lit("gap_frames")))
    if max_gap_hours is not None:
        rules.append(F.when(F.col("longest_gap") * F.lit(hours_per_frame) > max_gap_hours, F.lit("gap_hours")))
    if max_missing is not None:
        rules.append(F.when(F.col("missing") > max_missing, F.lit("missing_frames")))
    if missing_fraction is not None:
        rules.append(F.when(F.col("missing_fraction") >= missing_fraction, F.lit("missing_fraction")))
    reasons = F.concat_ws(";", *rules)
    return audit.withColumn("reasons", reasons).withColumn("eligible", F.col("reasons") == "")


def without_ineligible(rows: DataFrame, audited: DataFrame) -> DataFrame:
    """A consumer's view: rows of entities that failed the audit are removed."""
    return rows.join(audited.where(~F.col("eligible")).select(*ENTITY), ENTITY, "left_anti")


def frame_runs(observations: DataFrame, two_level: bool | None = None) -> DataFrame:
    """Runs of consecutive observed frames."""
    marked = islands(
        observations.select(*ENTITY, "frame_index"), ENTITY, ["frame_index"], F.col("frame_index") - F.col("__p") != 1,
        frame_bucket(), lag={"__p": "frame_index"}, alias="run", two_level=two_level,
    )
    return marked.groupBy(*ENTITY, "run").agg(
        F.min("frame_index").alias("start_frame"), F.max("frame_index").alias("end_frame"), F.count(F.lit(1)).alias("frames")
    )


def longest_run(observations: DataFrame) -> DataFrame:
    return frame_runs(observations).groupBy(*ENTITY).agg(F.max("frames").alias("longest_run"), F.max("run").alias("runs"))


def gap_frames(gaps: DataFrame) -> DataFrame:
    """One row per missing frame."""
    return gaps.withColumn("frame_index", F.explode(F.sequence(F.col("gap_start"), F.col("gap_end"))))


def persistence_events(gaps: DataFrame, explanations: DataFrame, spans: DataFrame, endings: DataFrame) -> DataFrame:
    """One marker per temporary absence, with the most frequent explanation of its frames (ties: first by
    name), and one per ending that no table explains."""
    per_gap = gap_frames(gaps).join(explanations, [*ENTITY, "frame_index"], "left")
    votes = per_gap.groupBy(*ENTITY, "gap_start", "gap_end", "mechanism").agg(F.count(F.lit(1)).alias("votes"))
    known = F.col("mechanism").isNotNull()
    best = votes.groupBy(*ENTITY, "gap_start", "gap_end").agg(
        F.min_by("mechanism", F.when(known, F.struct(-F.col("votes"), F.col("mechanism")))).alias("explanation")
    )
    absences = best.select(
        *ENTITY, F.lit("temporary_absence").alias("event"), F.col("gap_start").alias("frame_index"), "gap_end",
        F.coalesce("explanation", F.lit("unexplained")).alias("explanation"),
    )
    silent = spans.join(endings, ENTITY, "left").select(
        *ENTITY, F.lit("silent_ending").alias("event"), F.col("last_frame_index").alias("frame_index"),
        F.lit(None).cast("int").alias("gap_end"), F.coalesce("mechanism", F.lit("unexplained")).alias("explanation"),
    )
    return absences.unionByName(silent)


def adjacent_edges(rows: DataFrame, time: str = "hours", factor: float = 1.5) -> DataFrame:
    """Steps between successive observations, kept when no longer than ``factor`` times the entity's median."""
    big = has_heavy_key(rows, ENTITY)
    stepped = ordered_scan(rows, ENTITY, [time], time_bucket(time), lead={"to_hours": time}, two_level=big)
    steps = stepped.where(F.col("to_hours").isNotNull()).withColumn("step_hours", F.col("to_hours") - F.col(time))
    limit = quantiles(steps, ENTITY, "step_hours", {"median_step": 0.5}, two_level=big).drop("total")
    return steps.join(limit, ENTITY).where(F.col("step_hours") <= F.col("median_step") * factor)


def sequences(rows: DataFrame, time: str, max_gap: float, eligible: Column | None = None) -> DataFrame:
    """Contiguous sequences, split where a step exceeds ``max_gap`` or a row is not eligible."""
    marked = rows.withColumn("__ok", F.lit(True) if eligible is None else eligible)
    kept = islands(
        marked, ENTITY, [time], (F.col(time) - F.col("__p") > max_gap) | ~F.col("__po"), time_bucket(time),
        lag={"__p": time, "__po": "__ok"}, alias="sequence",
    ).where("__ok")
    runs = kept.groupBy(*ENTITY, "sequence").agg(
        F.count(F.lit(1)).alias("rows"), F.min(time).alias("start"), F.max(time).alias("end")
    )
    return numbered(runs.drop("sequence"), ENTITY, ["start"], time_bucket("start"), "sequence")


def support_intervals(rows: DataFrame, start: float, stop: float, max_gap: float) -> DataFrame:
    """Intervals between successive frames that touch a window, each with the reason it is refused."""
    stepped = ordered_scan(
        rows.select(*ENTITY, "frame_index", "hours"), ENTITY, ["frame_index"], frame_bucket(),
        lag={"from_hours": "hours", "from_frame": "frame_index"},
    ).where(F.col("from_hours").isNotNull() & (F.col("hours") > start) & (F.col("from_hours") < stop))
    reason = (
        F.when((F.col("from_hours") < start) | (F.col("hours") >= stop), F.lit("crosses_window"))
        .when(F.col("frame_index") - F.col("from_frame") > 1, F.lit("missing_frame"))
        .when(F.col("hours") - F.col("from_hours") > max_gap, F.lit("gap_too_long"))
    )
    return stepped.select(
        *ENTITY, "from_hours", F.col("hours").alias("to_hours"), reason.isNull().alias("supported"), reason.alias("reason")
    )


def episodes(rows: DataFrame, mark: Column, max_step: float, persistence: float, keys=tuple(ENTITY)) -> DataFrame:
    """Runs of marked rows inside contiguous stretches.

    ``onset_lower`` is the last unmarked time before the run in the same stretch; without one the onset is
    left-unresolved. A run qualifies once it has lasted ``persistence`` hours, at ``qualified_at``.
    """
    keys = list(keys)
    big = has_heavy_key(rows, keys)
    bucket = time_bucket()
    marked = rows.withColumn("mark", F.coalesce(mark, F.lit(False)))
    runs = islands(
        marked, keys, ["hours"], (F.col("hours") - F.col("prev_hours") > max_step) | (F.col("mark") != F.col("prev_mark")),
        bucket, lag={"prev_hours": "hours", "prev_mark": "mark"}, alias="run", two_level=big,
    )
    linked = F.col("hours") - F.col("prev_hours") <= max_step
    bounds = runs.groupBy(*keys, "run").agg(
        F.first("mark").alias("mark"),
        F.min("hours").alias("start"),
        F.max("hours").alias("end"),
        F.count(F.lit(1)).alias("rows"),
        F.min_by(F.when(linked, F.col("prev_hours")), F.col("hours")).alias("onset_lower"),
    )
    late = runs.join(bounds.select(*keys, "run", "start"), [*keys, "run"]).where(F.col("hours") - F.col("start") >= persistence)
    qualified = late.groupBy(*keys, "run").agg(F.min("hours").alias("qualified_at"))
    return bounds.join(qualified, [*keys, "run"], "left").select(
        *keys, "mark", "start", "end", "rows", "onset_lower", F.col("onset_lower").isNull().alias("left_unresolved"), "qualified_at"
    )


def response_timing(rows: DataFrame, anchor: float, factor: float, max_step: float, persistence: float) -> DataFrame:
    """First qualified departure above the entity's own baseline after an anchor, and the return after it.

    Entities that never depart, or depart and do not return, are censored at their last observation.
    """
    base = rows.where(F.col("hours") < anchor).groupBy(*ENTITY).agg(
        F.avg("signal").alias("baseline"), F.stddev_samp("signal").alias("baseline_sd")
    )
    usable = rows.join(base, ENTITY).where(F.col("hours") >= anchor)
    runs = episodes(
        usable, F.col("signal") > F.col("baseline") + factor * F.col("baseline_sd"), max_step, persistence
    ).where(F.col("qualified_at").isNotNull())
    first = runs.where("mark").groupBy(*ENTITY).agg(F.min(F.struct("start", "onset_lower")).alias("r"))
    responded = first.select(
        *ENTITY, F.col("r.start").alias("response_start"), (F.col("r.start") - anchor).alias("delay_upper"),
        (F.col("r.onset_lower") - anchor).alias("delay_lower"),
    )
    back = (
        runs.where(~F.col("mark")).join(responded, ENTITY).where(F.col("start") > F.col("response_start"))
        .groupBy(*ENTITY).agg(F.min("start").alias("recovery_start"))
    )
    ends = usable.groupBy(*ENTITY).agg(F.max("hours").alias("last_hour"))
    status = (
        F.when(F.col("baseline_sd").isNull(), F.lit("no_baseline"))
        .when(F.col("response_start").isNull(), F.lit("no_response"))
        .when(F.col("recovery_start").isNull(), F.lit("responded_censored"))
        .otherwise(F.lit("recovered"))
    )
    return (
        base.join(ends, ENTITY).join(responded, ENTITY, "left").join(back, ENTITY, "left")
        .withColumn("recovery_hours", F.col("recovery_start") - F.col("response_start"))
        .withColumn("status", status)
        .withColumn("censored_at", F.when(F.col("status").isin("no_response", "responded_censored"), F.col("last_hour")))
    )


def state_bouts(rows: DataFrame, state: str, two_level: bool | None = None) -> DataFrame:
    """Runs of one state over consecutive frames. A bout is censored where its neighbour frame is missing;
    the upper duration needs both neighbours."""
    slim = rows.select(*ENTITY, "frame_index", "hours", state)
    big = has_heavy_key(slim, ENTITY) if two_level is None else two_level
    stepped = ordered_scan(
        slim, ENTITY, ["frame_index"], frame_bucket(),
        lag={"pf": "frame_index", "ph": "hours", "ps": state}, lead={"nf": "frame_index", "nh": "hours"}, two_level=big,
    )
    runs = islands(
        stepped, ENTITY, ["frame_index"], (F.col("frame_index") - F.col("pf") != 1) | ~F.col(state).eqNullSafe(F.col("ps")) | F.col("pf").isNull(),
        frame_bucket(), alias="bout", two_level=big,
    )
    left = F.when(F.col("frame_index") - F.col("pf") == 1, F.col("ph"))
    right = F.when(F.col("nf") - F.col("frame_index") == 1, F.col("nh"))
    out = runs.groupBy(*ENTITY, "bout", state).agg(
        F.min("hours").alias("start_hour"),
        F.max("hours").alias("end_hour"),
        F.count(F.lit(1)).alias("frames"),
        F.min_by(left, F.col("frame_index")).alias("__l"),
        F.max_by(right, F.col("frame_index")).alias("__r"),
    )
    return out.select(
        *ENTITY, "bout", state, "start_hour", "end_hour", "frames",
        F.col("__l").isNull().alias("left_censored"), F.col("__r").isNull().alias("right_censored"),
        (F.col("end_hour") - F.col("start_hour")).alias("duration_lower"), (F.col("__r") - F.col("__l")).alias("duration_upper"),
    )


def exposures(rows: DataFrame, state: str, max_step: float) -> DataFrame:
    """Time split among states: a supported step gives half to each end; unsupported steps are unobserved.
    A NULL state is assigned to ``unknown``."""
    stepped = ordered_scan(
        rows.select(*ENTITY, "hours", state), ENTITY, ["hours"], time_bucket(), lead={"nh": "hours", "ns": state}
    ).where(F.col("nh").isNotNull())
    a, b = F.coalesce(F.col(state), F.lit("unknown")), F.coalesce(F.col("ns"), F.lit("unknown"))
    mid = (F.col("hours") + F.col("nh")) / 2

    def piece(lo, hi, label):
        return F.struct(lo.alias("lo"), hi.alias("hi"), label.alias("exposure"))

    both = F.array(piece(F.col("hours"), mid, a), piece(mid, F.col("nh"), b))
    blank = F.array(piece(F.col("hours"), F.col("nh"), F.lit("unobserved")))
    pieces = F.when(F.col("nh") - F.col("hours") <= max_step, both).otherwise(blank)
    return stepped.select(*ENTITY, F.inline(pieces))


def exposure_bouts(pieces: DataFrame) -> DataFrame:
    """Touching pieces with the same exposure become one bout."""
    runs = islands(
        pieces, ENTITY, ["lo"], (F.col("exposure") != F.col("__pe")) | (F.col("lo") != F.col("__ph")), time_bucket("lo"),
        lag={"__pe": "exposure", "__ph": "hi"}, alias="bout",
    )
    return runs.groupBy(*ENTITY, "bout", "exposure").agg(
        F.min("lo").alias("start_hour"), F.max("hi").alias("end_hour"), F.sum(F.col("hi") - F.col("lo")).alias("hours")
    )


def exposure_summary(bouts: DataFrame) -> DataFrame:
    """Observed, unknown and unobserved hours, switches between assigned states and their rate."""
    assigned = ~F.col("exposure").isin("unknown", "unobserved")
    stepped = ordered_scan(
        bouts, ENTITY, ["start_hour"], time_bucket("start_hour"), lag={"__pe": "exposure", "__ph": "end_hour"}
    )
    switched = assigned & ~F.col("__pe").isin("unknown", "unobserved") & (F.col("__ph") == F.col("start_hour"))
    total = stepped.groupBy(*ENTITY).agg(
        F.sum(F.when(assigned, F.col("hours")).otherwise(0.0)).alias("assigned_hours"),
        F.sum(F.when(F.col("exposure") == "unknown", F.col("hours")).otherwise(0.0)).alias("unknown_hours"),
        F.sum(F.when(F.col("exposure") == "unobserved", F.col("hours")).otherwise(0.0)).alias("unobserved_hours"),
        F.sum(F.coalesce(switched.cast("long"), F.lit(0))).alias("switches"),
    )
    return total.withColumn("switch_rate", ratio("switches", "assigned_hours"))


def display_breaks(rows: DataFrame, value: str, max_gap: float) -> DataFrame:
    """Rows with a blank one at the middle of every step longer than ``max_gap``."""
    stepped = ordered_scan(rows.select(*ENTITY, "hours", value), ENTITY, ["hours"], time_bucket(), lag={"ph": "hours"})
    own = F.struct(F.col("hours").alias("hours"), F.col(value).alias("value"))
    blank = F.struct(((F.col("ph") + F.col("hours")) / 2).alias("hours"), F.lit(None).cast("double").alias("value"))
    return stepped.select(*ENTITY, F.inline(F.when(F.col("hours") - F.col("ph") > max_gap, F.array(blank, own)).otherwise(F.array(own))))


def identity_numbers(rows: DataFrame) -> DataFrame:
    """Gap-free numbers 1..N of the identities of each recording, by identity."""
    distinct = rows.select(*ENTITY).distinct()
    return numbered(distinct, ["stem"], ["identity"], F.floor(F.col("identity") / F.lit(1_000_000)).cast("long"), "cell_number")
