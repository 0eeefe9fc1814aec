"""Life histories of entities: beginnings, endings, divisions, families and measured gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from lapsegrid.functions.numeric import ratio
from lapsegrid.operators.pixels import CELL, ENTITY, PLACE, contacts, offsets, spread
from lapsegrid.operators.presence import gap_intervals
from lapsegrid.plans.durable import cut


def life_spans(masks: DataFrame) -> DataFrame:
    frames = masks.select(*CELL).distinct()
    return frames.groupBy(*ENTITY).agg(
        F.min("frame_index").alias("first_frame"), F.max("frame_index").alias("last_frame"), F.count(F.lit(1)).alias("frames_named")
    )


def life_events(pixels: DataFrame, recordings: DataFrame, height: int, width: int, dilation: int, tolerance: float, together: int, residual: float) -> DataFrame:
    """How each name begins and ends, with what the frames can settle.

    Beginnings: present at the start, entered at the border, born beside a parent whose earlier area the two
    parts account for, or appeared. Endings: present at the end, left at the border, absorbed by the entity
    that takes its ground, died, or lost. A division is also written against the parent.
    """
    masks = pixels.where(F.col("identity").isNotNull())
    spans = life_spans(masks)
    area = masks.groupBy(*CELL).agg(
        F.count(F.lit(1)).alias("area_px"),
        (F.max(((F.col("y") == 0) | (F.col("x") == 0) | (F.col("y") == height - 1) | (F.col("x") == width - 1)).cast("int")) == 1).alias("touches_border"),
    )
    first = spans.select(*ENTITY, F.col("first_frame").alias("frame_index"), "last_frame").join(area, CELL)
    last = spans.select(*ENTITY, F.col("last_frame").alias("frame_index")).join(area, CELL)

    # contacts only in frames where some name begins
    opening = first.where(F.col("frame_index") > 0).select("stem", "frame_index").distinct()
    touching = contacts(masks.join(opening, ["stem", "frame_index"], "left_semi"), [dilation])
    both = touching.select("stem", "frame_index", F.inline(F.array(
        F.struct(F.col("identity_a").alias("identity"), F.col("identity_b").alias("partner")), F.struct(F.col("identity_b").alias("identity"), F.col("identity_a").alias("partner")))))
    now = area.select("stem", "frame_index", F.col("identity").alias("partner"), F.col("area_px").alias("partner_area_px"))
    before = area.select("stem", (F.col("frame_index") + 1).alias("frame_index"), F.col("identity").alias("partner"), F.col("area_px").alias("parent_area_before_px"))
    end_of = spans.select("stem", F.col("identity").alias("partner"), F.col("last_frame").alias("partner_last"))
    conserved = F.round((F.col("area_px") + F.col("partner_area_px")) / F.col("parent_area_before_px"), 12)
    candidates = (
        first.where((F.col("frame_index") > 0) & ~F.col("touches_border"))
        .join(both, CELL).join(now, ["stem", "frame_index", "partner"]).join(before, ["stem", "frame_index", "partner"]).join(end_of, ["stem", "partner"])
        .withColumn("area_conservation", conserved).withColumn("frames_together", F.least("last_frame", "partner_last") - F.col("frame_index") + 1)
        .where((F.abs(F.col("area_conservation") - 1) <= tolerance) & (F.col("frames_together") >= together))
    )
    parent = candidates.groupBy(*ENTITY).agg(
        F.min(F.struct(F.round(F.abs(F.col("area_conservation") - 1), 12).alias("e"), "partner", "partner_area_px", "parent_area_before_px", "area_conservation", "frames_together")).alias("p")
    )
    start_event = (
        F.when(F.col("frame_index") == 0, "present_at_start").when(F.col("touches_border"), "entered_field").when(F.col("p").isNotNull(), "born").otherwise("appeared")
    )
    start_status = F.when(F.col("frame_index") == 0, "censored").when(F.col("touches_border"), "observed").when(F.col("p").isNotNull(), "candidate").otherwise("unproven")
    nothing = F.lit(None)
    starts = first.join(parent, ENTITY, "left").select(
        *CELL, start_event.alias("event"), start_status.alias("event_status"), "area_px", F.col("p.partner").alias("partner_identity"),
        F.col("p.partner_area_px").alias("partner_area_px"), F.col("p.area_conservation").alias("area_conservation"), nothing.cast("double").alias("residual_fraction"),
    )
    divided = starts.where(F.col("event") == "born").select(
        "stem", F.col("partner_identity").alias("identity"), "frame_index", F.lit("divided").alias("event"), "event_status", F.col("partner_area_px").alias("area_px"),
        F.col("identity").alias("partner_identity"), F.col("area_px").alias("partner_area_px"), "area_conservation", "residual_fraction",
    )

    # what holds the ground one frame after a name's last
    ground = last.select(*CELL).join(masks.select(*CELL, "y", "x"), CELL)
    after = ground.withColumn("frame_index", F.col("frame_index") + 1).join(
        pixels.select(*PLACE, F.col("identity").alias("taker"), F.col("unclaimed")), PLACE
    )
    takers = after.where(F.col("taker").isNotNull()).groupBy(*ENTITY, "taker").agg(F.count(F.lit(1)).alias("n")).groupBy(*ENTITY).agg(
        F.min(F.struct((-F.col("n")).alias("m"), "taker")).alias("t")
    )
    left_over = after.groupBy(*ENTITY).agg(F.sum((F.col("taker").isNotNull() | F.col("unclaimed")).cast("long")).alias("residual_px"))
    closing = last.join(takers, ENTITY, "left").join(left_over, ENTITY, "left").withColumn("residual_px", F.coalesce("residual_px", F.lit(0).cast("long")))
    taken = -F.col("t.m") >= F.col("area_px") * (1 - residual)
    closing = closing.join(recordings.select("stem", "n_frames"), "stem")
    done = F.col("frame_index") == F.col("n_frames") - 1
    faded = F.col("residual_px") <= F.col("area_px") * residual
    end_event = (
        F.when(done, "present_at_end").when(F.col("touches_border"), "left_field").when(taken, "absorbed").when(faded, "died").otherwise("lost")
    )
    end_status = F.when(done, "censored").when(F.col("touches_border"), "observed").when(taken, "candidate").when(faded, "candidate").otherwise("unproven")
    undecided = ~done & ~F.col("touches_border") & ~F.coalesce(taken, F.lit(False))
    ends = closing.select(
        *CELL, end_event.alias("event"), end_status.alias("event_status"), "area_px", F.when(end_event == "absorbed", F.col("t.taker")).alias("partner_identity"),
        nothing.cast("long").alias("partner_area_px"), nothing.cast("double").alias("area_conservation"), F.when(undecided, ratio("residual_px", "area_px")).alias("residual_fraction"),
    )
    return starts.unionByName(divided).unionByName(ends)


def life_rows(events: DataFrame, spans: DataFrame) -> DataFrame:
    """One row per entity: how it began and ended, its parent, what absorbed it, and its children."""
    opening = ["present_at_start", "entered_field", "born", "appeared"]
    start = F.when(F.col("event").isin(opening), F.struct("event", "event_status", "partner_identity"))
    end = F.when(~F.col("event").isin([*opening, "divided"]), F.struct("event", "event_status", "partner_identity"))
    divided = F.col("event") == "divided"
    s = events.groupBy(*ENTITY).agg(
        F.max(start).alias("s"), F.max(end).alias("e"), F.sum(divided.cast("long")).alias("children"), F.min(F.when(divided, F.col("frame_index"))).alias("first_division_frame")
    )
    return s.join(spans, ENTITY).select(
        *ENTITY, F.col("s.event").alias("start_event"), F.col("s.event_status").alias("start_status"), F.col("e.event").alias("end_event"), F.col("e.event_status").alias("end_status"),
        "first_frame", "last_frame", F.col("s.partner_identity").alias("parent_identity"), F.when(F.col("e.event") == "absorbed", F.col("e.partner_identity")).alias("absorbed_into_identity"),
        "children", "first_division_frame", "frames_named", (F.col("last_frame") - F.col("first_frame") + 1 - F.col("frames_named")).alias("gap_frames"),
    )


def components(edges: DataFrame, key: str, a: str, b: str, nodes: DataFrame, node: str) -> DataFrame:
    """Smallest node of each connected group, by repeated label passing with pointer jumping.

    Each round takes the least label among neighbours and then the label of that label, so chains halve. The
    label table is written each round, and edges to a hub are combined map-side.
    """
    both = edges.select(key, F.col(a).alias("u"), F.col(b).alias("v")).unionByName(edges.select(key, F.col(b).alias("u"), F.col(a).alias("v"))).distinct()
    both = cut(both)
    labels = cut(nodes.select(key, F.col(node).alias("u")).distinct().withColumn("label", F.col("u")))
    while True:
        heard = both.join(labels.select(key, F.col("u").alias("v"), "label"), [key, "v"]).groupBy(key, "u").agg(F.min("label").alias("m"))
        lowered = labels.join(heard, [key, "u"], "left").select(key, "u", F.col("label").alias("old"), F.least("label", F.coalesce("m", F.col("label"))).alias("label"))
        jump = labels.select(key, F.col("u").alias("label"), F.col("label").alias("further"))
        stepped = cut(lowered.join(jump, [key, "label"], "left").select(key, "u", "old", F.least("label", F.coalesce("further", F.col("label"))).alias("label")))
        changed = not stepped.where(F.col("label") != F.col("old")).isEmpty()
        labels = stepped.select(key, "u", "label")
        if not changed:
            return labels.select(key, F.col("u").alias(node), F.col("label").alias("family"))


def families(rows: DataFrame) -> DataFrame:
    """Families linked by division and absorption, numbered per recording by their earliest start."""
    rows = cut(rows)
    links = rows.where(F.col("parent_identity").isNotNull()).select("stem", "identity", F.col("parent_identity").alias("other")).unionByName(
        rows.where(F.col("absorbed_into_identity").isNotNull()).select("stem", "identity", F.col("absorbed_into_identity").alias("other"))
    )
    # an edge to a name without a row of its own is not a link
    known = links.join(rows.select("stem", F.col("identity").alias("other")), ["stem", "other"], "left_semi")
    labelled = components(known, "stem", "identity", "other", rows, "identity")
    sized = labelled.join(rows.select("stem", "identity", "first_frame"), ["stem", "identity"]).groupBy("stem", "family").agg(
        F.count(F.lit(1)).alias("members"), F.min("first_frame").alias("earliest_start")
    )
    from lapsegrid.plans.scan import frame_bucket, numbered

    ranked = numbered(sized, ["stem"], ["earliest_start", "family"], frame_bucket("earliest_start"), "family_rank")
    return labelled.join(ranked, ["stem", "family"])


def gap_additions(pixels: DataFrame, blocked: DataFrame, max_gap: int, iou_floor: float, shift_limit: float, area_limit: float, corridor: int, inner: float, outer: float) -> tuple[DataFrame, DataFrame]:
    """Audit of short gaps and the measurements an eligible one adds.

    A gap is refused for a blocked entity, for its length, for endpoints that do not match, or for a foreign
    mask in the corridor around them. An eligible missing frame is read through the nearer endpoint's mask (the
    left one at the midpoint) against the free ring around it.
    """
    masks = pixels.where(F.col("identity").isNotNull())
    gaps = gap_intervals(masks.select(*CELL).distinct()).withColumn("left_frame", F.col("gap_start") - 1).withColumn("right_frame", F.col("gap_end") + 1)
    gap_key = [*ENTITY, "gap_start"]
    own = lambda side: gaps.select(*gap_key, F.col(f"{side}_frame").alias("frame_index")).join(masks.select(*CELL, "y", "x"), CELL).select(*gap_key, "y", "x", F.lit(1).alias(side))
    merged = own("left").join(own("right"), [*gap_key, "y", "x"], "full_outer")
    mean = lambda s, c: F.avg(F.when(F.col(s) == 1, F.col(c)))
    ends = merged.groupBy(*gap_key).agg(
        F.count(F.when((F.col("left") == 1) & (F.col("right") == 1), F.lit(1))).alias("__both"), F.count(F.lit(1)).alias("__union"),
        F.count("left").alias("left_area_px"), F.count("right").alias("right_area_px"),
        F.hypot(mean("left", "y") - mean("right", "y"), mean("left", "x") - mean("right", "x")).alias("centroid_shift_px"),
    )
    union = merged.select(*gap_key, "y", "x")
    around = spread(union, offsets(corridor, -1.0, "square")).select(*gap_key, "y", "x").distinct()
    frames = gaps.where(F.col("gap_frames") <= max_gap).select(*gap_key, F.explode(F.sequence("gap_start", "gap_end")).alias("frame_index"))
    foreign = (
        around.join(frames, gap_key).join(masks.select(*PLACE, F.lit(True).alias("__hit")), PLACE).groupBy(*gap_key).agg(F.count(F.lit(1)).alias("corridor_px"))
    )
    audit = gaps.join(ends, gap_key).join(foreign, gap_key, "left").join(blocked.select(*ENTITY, F.lit(True).alias("__blocked")), ENTITY, "left")
    iou = ratio("__both", "__union")
    worst = F.greatest("left_area_px", "right_area_px") / F.greatest(F.least("left_area_px", "right_area_px"), F.lit(1))
    reason = (
        F.when(F.col("__blocked"), "merged_identity").when(F.col("gap_frames") > max_gap, "gap_too_long")
        .when((iou < iou_floor) | (F.col("centroid_shift_px") > shift_limit) | (worst > area_limit), "unstable_endpoints")
        .when(F.coalesce(F.col("corridor_px"), F.lit(0)) > 0, "native_component_in_corridor").otherwise("eligible")
    )
    audited = audit.select(
        *ENTITY, "gap_start", "gap_end", "gap_frames", "left_frame", "right_frame", iou.alias("endpoint_iou"), "centroid_shift_px", "left_area_px", "right_area_px", reason.alias("reason")
    )
    wanted = audited.where(F.col("reason") == "eligible").withColumn("frame_index", F.explode(F.sequence("gap_start", "gap_end")))
    nearer = F.when(2 * (F.col("frame_index") - F.col("left_frame")) <= F.col("right_frame") - F.col("left_frame"), F.col("left_frame")).otherwise(F.col("right_frame"))
    asked = wanted.select(*CELL, "gap_start", nearer.alias("mask_frame"))
    shape = asked.join(masks.select(*ENTITY, F.col("frame_index").alias("mask_frame"), "y", "x"), [*ENTITY, "mask_frame"])
    level = shape.join(pixels.select(*PLACE, "raw"), PLACE).groupBy(*CELL).agg(F.avg("raw").alias("signal_mean"), F.count(F.lit(1)).alias("area_px"))
    reach = spread(shape.select(*CELL, "y", "x"), offsets(outer)).groupBy(*CELL, "y", "x").agg(F.min("d").alias("d")).where(F.col("d") > inner)
    free = pixels.where(F.col("identity").isNull()).select(*PLACE, "raw")
    ring = reach.join(free, PLACE).groupBy(*CELL).agg(F.median("raw").alias("background_median"))
    added = level.join(ring, CELL).withColumn("corrected_mean", F.col("signal_mean") - F.col("background_median"))
    return audited, added
