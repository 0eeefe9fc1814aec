"""Masks against sets of objects: distances by brute force, and what crosses the network or reaches the driver."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lapsegrid.operators import pixels as X
from lapsegrid.plans.distance import FRAMES, least_distances

HEIGHT, WIDTH = 70, 9


@pytest.fixture(scope="module")
def field():
    """Masks over frames of several parts, and objects of two sets that overlap; one stem has no objects, one object has no name."""
    draw = random.Random(11)
    spot = lambda: (draw.randrange(HEIGHT), draw.randrange(WIDTH))
    masks = sorted({(s, e, f, *spot()) for s in "ab" for e in (1, 2) for f in (0, 1, FRAMES, 3 * FRAMES) for _ in range(6)})
    things = sorted({("a", k, o, *spot()) for k, n in (("near", 40), ("far", 2)) for o in ("p", "q", "é") for _ in range(n)} | {("a", "nameless", "", 69, 0)})
    return masks, things


def least(places, things, kind):
    return min(((y - oy) ** 2 + (x - ox) ** 2, o) for y, x in places for _, k, o, oy, ox in things if k == kind)


def frames(spark, field):
    masks, things = field
    points = spark.createDataFrame(masks, "stem string, identity int, frame_index int, y int, x int")
    objects = spark.createDataFrame([(s, k, o or None, y, x) for s, k, o, y, x in things], "stem string, object_set string, object string, y int, x int")
    return points, objects


def test_least_distances_of_fixed_places_over_many_frames(spark, field):
    masks, things = field
    points, objects = frames(spark, field)
    got = least_distances(points, ["identity", "frame_index"], objects, "object_set", "object", ["stem"], HEIGHT, WIDTH, F.floor(F.col("frame_index") / FRAMES)).collect()
    cells = {m[:3] for m in masks if m[0] == "a"}
    assert len(got) == 3 * len(cells) and {(r.stem, r.identity, r.frame_index) for r in got} == cells
    for r in got:
        places = [m[3:] for m in masks if m[:3] == (r.stem, r.identity, r.frame_index)]
        held = {t[3:] for t in things if t[1] == r.object_set}
        assert (r.d2, r.owner or "") == least(places, things, r.object_set), r
        assert r.inside == sum(p in held for p in places), r


def test_least_distances_of_places_that_move(spark, field):
    masks, things = field
    points, objects = frames(spark, field)
    # frame 1 has the far set only, the last frame nothing
    moving = objects.withColumn("frame_index", F.explode(F.array(F.lit(0), F.lit(1), F.lit(FRAMES)))).where("frame_index <> 1 OR object_set = 'far'")
    got = least_distances(points, ["identity"], moving, "object_set", "object", ["stem", "frame_index"], HEIGHT, WIDTH).collect()
    assert sorted({(r.frame_index, r.object_set) for r in got}) == sorted([(1, "far")] + [(f, k) for f in (0, FRAMES) for k in ("far", "near", "nameless")])
    for r in got:
        assert (r.d2, r.owner or "") == least([m[3:] for m in masks if m[:3] == (r.stem, r.identity, r.frame_index)], things, r.object_set), r


@pytest.mark.parametrize("named", [True, False])
def test_no_side_of_an_overlap_is_gathered_on_the_driver(spark, field, named):
    """Tables this small are broadcast wherever a join does not ask for another way."""
    plan = X.object_overlap(*frames(spark, field), HEIGHT, WIDTH, named=named)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_places_cross_the_network_once_and_fields_not_at_all(spark, field):
    points, objects = frames(spark, field)
    plan = X.object_overlap(points, objects.withColumn("frame_index", F.lit(0)), HEIGHT, WIDTH, named=False)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\([^)]*\b[yx]#", plan), plan
    assert "Generate explode" not in plan


def test_moving_objects_and_masks_read_one_written_table(spark):
    from lapsegrid import workload

    plan = workload.callables()["moving_object_overlap"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "l_partkey" not in plan


def test_tracks_of_moving_objects_derive_the_pixels_once(spark, monkeypatch):
    from lapsegrid.sources.canonical import Inputs
    from lapsegrid.workload.registry import ENTRIES

    derived, pixels = [], Inputs.pixels
    monkeypatch.setattr(Inputs, "pixels", lambda self: derived.append(1) or pixels(self))
    ENTRIES["moving_object_tracks"].build(Inputs(spark, "/root/testdata/sf0.001"))
    assert len(derived) == 1
