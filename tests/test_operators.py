"""Hand-made series with known answers."""

import pytest
from pyspark.sql import functions as F

from lapsegrid.operators import contrasts, filters, joins, lineage, presence, rhythm, rollup, stats, tracks
from lapsegrid.sources import tables


def obs(spark, rows):
    return spark.createDataFrame(rows, "stem string, identity long, frame_index int, hours double, signal double")


@pytest.fixture(scope="module")
def gappy(spark):
    # frame 3 missing, a two-frame gap at 6-7; entity 2 has one row
    frames = [0, 1, 2, 4, 5, 8]
    return obs(spark, [("s", 1, f, float(f), 10.0 * f) for f in frames] + [("s", 2, 4, 4.0, None)])


def test_steps_and_means_do_not_bridge(gappy):
    t = gappy.where("identity = 1").select("stem", "identity", "frame_index", "hours", (F.col("signal") * 0).alias("y"), F.col("signal").alias("x"))
    got = {r["frame_index"]: r for r in tracks.steps(t).collect()}
    assert got[1]["step_px_gapless"] == 10 and got[4]["step_px_gapless"] is None and got[4]["step_px"] == 20
    assert got[8]["path_px"] == 80 and got[8]["displacement_px"] == 80
    mean = {r["frame_index"]: r["m"] for r in tracks.centred_mean(gappy.where("identity = 1"), "signal", 3, "m").collect()}
    assert mean[1] == 10 and all(mean[f] is None for f in (0, 2, 4, 5, 8))


def test_presence_states_and_audit(spark, gappy):
    rec = spark.createDataFrame([("s", 10)], "stem string, n_frames int")
    states = {(r["identity"], r["frame_index"]): r["state"] for r in presence.roll_call(gappy, rec).collect()}
    assert states[1, 3] == "unclaimed" and states[1, 9] == "outside_lifespan" and states[2, 4] == "named" and states[2, 3] == "outside_lifespan"
    audit = {r["identity"]: r for r in presence.presence_audit(gappy, rec).collect()}
    assert (audit[1]["longest_gap"], audit[1]["gaps"], audit[1]["internal_missing"], audit[1]["trailing_missing"]) == (2, 2, 3, 1)
    assert (audit[2]["longest_gap"], audit[2]["leading_missing"], audit[2]["trailing_missing"]) == (0, 4, 5)
    runs = {r["identity"]: r["longest_run"] for r in presence.longest_run(gappy).collect()}
    assert runs == {1: 3, 2: 1}


def test_eligibility_limits_are_exclusive_and_the_fraction_inclusive(spark):
    a = spark.createDataFrame([("s", 1, 2, 5, 0.5)], "stem string, identity long, longest_gap long, missing long, missing_fraction double")
    assert presence.eligibility(a, 1.0, max_gap_frames=2).first()["eligible"]
    assert not presence.eligibility(a, 1.0, max_gap_frames=1).first()["eligible"]
    assert presence.eligibility(a, 1.0, missing_fraction=0.5).first()["reasons"] == "missing_fraction"


def test_bouts_are_censored_at_gaps(spark):
    rows = [("s", 1, f, float(f), None) for f in (0, 1, 2, 3, 5)]
    df = obs(spark, rows).withColumn("state", F.when(F.col("frame_index").isin(1, 2), "b").otherwise("a"))
    got = {(r["state"], r["start_hour"]): r for r in presence.state_bouts(df, "state").collect()}
    assert not got["b", 1.0]["left_censored"] and not got["b", 1.0]["right_censored"] and got["b", 1.0]["duration_upper"] == 3
    assert got["a", 3.0]["right_censored"] and got["a", 5.0]["left_censored"] and got["a", 5.0]["duration_upper"] is None


def test_kleene_tables(spark):
    values = [True, False, None]
    df = spark.createDataFrame([(a, b) for a in values for b in values], "a boolean, b boolean")
    leaf = lambda f: {"field": f, "cmp": "eq", "value": True}
    want = {
        "and": lambda a, b: False if a is False or b is False else None if None in (a, b) else True,
        "or": lambda a, b: True if a or b else None if None in (a, b) else False,
        "xor": lambda a, b: None if None in (a, b) else a != b,
    }
    for op, table in want.items():
        for r in filters.cohort(df, {"op": op, "args": [leaf("a"), leaf("b")]}).collect():
            assert r["matched"] == table(r["a"], r["b"])
            assert r["kept"] == bool(r["matched"])
    for r in filters.cohort(df, {"op": "not", "args": [leaf("a")]}, unknown="keep").collect():
        assert r["matched"] == (None if r["a"] is None else not r["a"]) and r["kept"] == (r["a"] is not True)
    with pytest.raises(Exception, match="undecided"):
        filters.cohort(df, leaf("a"), unknown="error").collect()
    with pytest.raises(ValueError):
        filters.cohort(df, leaf("missing"))


def test_nearest_unique_rejects_ties_and_collisions(spark):
    ref = spark.createDataFrame([("k", t) for t in (10, 20, 30, 31, 50)], "k string, t long")
    target = spark.createDataFrame([("k", t) for t in (8, 12, 21, 32, 90)], "k string, t long")
    for two_level_width in (5, 1000):
        got = {r["reference_at"]: (r["match_status"], r["target_at"]) for r in joins.nearest_unique(ref, target, ["k"], "t", 0, 3, two_level_width).collect()}
        assert got == {10: ("equidistant", None), 20: ("matched", 21), 30: ("collision", None), 31: ("collision", None), 50: ("none", None)}


def test_joint_intervals_fill_their_domain(spark):
    iv = lambda rows: spark.createDataFrame([("k", float(a), float(b)) for a, b in rows], "k string, from_hours double, to_hours double")
    got = sorted((r["lo"], r["hi"], r["supported"]) for r in joins.joint_intervals(iv([(0, 2), (5, 9)]), iv([(1, 3), (6, 7), (8, 12)]), ["k"], 2.0).collect())
    assert got == [(1, 2, True), (2, 6, False), (6, 7, True), (7, 8, False), (8, 9, True)]


def test_side_table_rules(spark):
    raw = spark.createDataFrame([("1", "a"), ("2", "b"), ("x", "c"), ("9", "d")], "identity string, note string")
    known = spark.createDataFrame([(1,), (2,)], "identity long")
    side, audit = tables.side_table(raw, "lab", "identity", known, [])
    assert side.columns == ["identity", "lab_note"] and side.count() == 3
    assert audit.first().asDict() == {"rows": 4, "unusable_keys": 1, "matched_keys": 2, "unmatched_keys": 1}
    with pytest.raises(tables.GrainError):
        tables.side_table(raw.unionByName(raw), "lab", "identity", known, [])
    with pytest.raises(ValueError, match="overwrite"):
        tables.side_table(raw, "lab", "identity", known, ["lab_note"])


def test_pool_unions_by_name_and_wants_stamps(spark):
    a = spark.createDataFrame([("x", 1)], "stem string, v int")
    b = spark.createDataFrame([("y", 2.0)], "stem string, w double")
    assert sorted(joins.pool({"a": a, "b": b}).columns) == ["stem", "v", "w"]
    with pytest.raises(ValueError):
        joins.pool({"a": a, "b": b.drop("stem")})


def test_constant_series_has_no_correlation(spark):
    df = spark.createDataFrame([("s", 1.0, float(v)) for v in range(5)], "k string, a double, b double")
    r = stats.association(df, ["k"], "a", "b", 3).first()
    assert r["pearson"] is None and r["status"] == "constant"


def test_missing_tests_keep_their_slot(spark):
    df = spark.createDataFrame([("f", 1, 0.01), ("f", 2, None), ("f", 3, 0.04)], "fam string, id int, p double")
    got = {r["id"]: r for r in stats.corrected(df, ["fam"], "p").collect()}
    assert got[1]["q_bh"] == pytest.approx(0.03) and got[2]["q_bh"] is None and got[3]["p_bonferroni"] == pytest.approx(0.12)


def test_screen_finds_a_planted_period(spark):
    import math

    rows = [("s", e, float(h), math.sin(2 * math.pi * h / 24.0) * (e == 1) + (0.5 if e == 2 else 0.0) + 0.01 * ((h * 7) % 5)) for e in (1, 2) for h in range(0, 240, 3)]
    rows += [("s", 3, 0.0, 1.0)]
    df = spark.createDataFrame(rows, "stem string, identity long, hours double, v double")
    got = {r["identity"]: r for r in rhythm.screen(df, ["stem", "identity"], ["stem"], "v", rhythm.frequency_grid(12.0, 48.0, 37), 10).collect()}
    assert abs(got[1]["period"] - 24) < 0.7 and got[1]["supported"] and got[3]["status"] == "insufficient"
    fit = rhythm.cosinor(df.where("identity = 1"), ["identity"], "v", 24.0).first()
    assert fit["peak_hour"] == pytest.approx(6.0, abs=0.2) and fit["amplitude"] == pytest.approx(1.0, abs=0.02)


def test_components_of_a_chain_a_star_and_a_loner(spark):
    edges = [("s", i, i + 1) for i in range(1, 20)] + [("s", 100, 100 + i) for i in range(1, 15)]
    nodes = [("s", i) for i in [*range(1, 21), *range(100, 115), 500]]
    e, n = spark.createDataFrame(edges, "k string, a long, b long"), spark.createDataFrame(nodes, "k string, n long")
    got = {r["n"]: r["family"] for r in lineage.components(e, "k", "a", "b", n, "n").collect()}
    assert all(got[i] == 1 for i in range(1, 21)) and all(got[i] == 100 for i in range(100, 115)) and got[500] == 500


def test_recipe_dominance(spark):
    rows = [("r1", "x", 50, 1.0, 1.0, 0.05, 0.8), ("r2", "x", 50, 1.0, 1.0, 0.05, 0.7), ("r3", "x", 50, 1.0, 1.0, 0.01, 0.5), ("r4", "x", 50, 1.0, 1.0, 0.04, 0.4), ("r5", "x", 50, 0.1, 1.0, 0.0, 0.9)]
    df = spark.createDataFrame(rows, "recipe string, scope string, cases long, support double, coverage double, false_alarm double, recovery double")
    got = {r["recipe"]: r for r in stats.select_recipes(df, 0.9, 0.5, 0.2, 10).collect()}
    assert {k for k, r in got.items() if r["undominated"]} == {"r1", "r3"} and got["r1"]["outcome"] == "tie"


def test_windows_without_data_and_zero_baselines(spark):
    df = obs(spark, [("s", 1, 0, 0.0, 0.0), ("s", 1, 12, 12.0, 5.0), ("s", 2, 12, 12.0, 5.0)])
    w = [rollup.DeclaredWindow("a", 0, 6), rollup.DeclaredWindow("b", 6, 20, baseline="a"), rollup.DeclaredWindow("c", 20, 30, baseline="a")]
    rolled = rollup.windowed_rollup(df, w, ["signal"], 1.0)
    assert sorted((r["identity"], r["window"]) for r in rolled.collect()) == [(1, "a"), (1, "b"), (2, "b")]
    only = rollup.window_changes(rolled, w, ["signal_mean"]).collect()
    assert len(only) == 1 and only[0]["difference"] == 5.0 and only[0]["ratio"] is None


def test_persistence_resample_is_the_same_in_any_chunking(spark):
    rows = spark.createDataFrame([("s", 1, f, "xxyxyyxxxy"[f % 10]) for f in range(64) if f not in (20, 41)], "stem string, identity long, frame_index int, state string")
    runs = [sorted((r["frame_index"], r["state"]) for r in contrasts.persistence_resample(rows, "state", ["x", "y"], 5, chunk=c).collect()) for c in (4, 7, 64)]
    assert runs[0] == runs[1] == runs[2] and len(runs[0]) == 62 and {s for _, s in runs[0]} == {"x", "y"}


def test_readers_and_writers(spark, tmp_path):
    p = tmp_path / "trace.csv"
    p.write_text("# made by hand\nhours,a_1,a_2,b_1\n0,1,2,nan\n1,3,,5\n")
    wide = tables.read_trace_csv(spark, str(p), offset_h=2.0)
    assert [r["hours"] for r in wide.orderBy("hours").collect()] == [2.0, 3.0] and wide.orderBy("hours").first()["b_1"] is None
    panels = tables.trace_panels(wide, "a_*")
    assert {r["panel"] for r in panels.collect()} == {"a_1", "a_2"} and panels.count() == 4
    both = tables.load_sources(spark, [f"one={p}", f"two={p}"])
    assert both.groupBy("source").count().count() == 2
    c = tmp_path / "conditions.csv"
    c.write_text("recording,drug,day\nm1.tif,yes,1\nm2,no,2\n")
    assert sorted((r["stem"], r["factor"], r["level"]) for r in tables.read_conditions(spark, str(c)).collect()) == [("m1", "day", "1"), ("m1", "drug", "yes"), ("m2", "day", "2"), ("m2", "drug", "no")]
    found, record = tables.read_decision_tables(spark, {"here": str(c), "gone": str(tmp_path / "no.csv")})
    assert record == [("gone", "absent"), ("here", "read")] and set(found) == {"here"}
    df = spark.createDataFrame([("m1", 1, 2.0)], "stem string, identity long, v double")
    rec = spark.createDataFrame([("m1", "c", "p")], "stem string, condition string, subject string")
    tables.write_stamped(df, rec, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert set(back.columns) == {"stem", "condition", "subject", "identity", "v"}
    (tmp_path / "b" / "m7").mkdir(parents=True)
    df.drop("stem").coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "b" / "m7"))
    assert tables.read_batch(spark, [str(tmp_path / "b" / "m7")]).first()["stem"] == "m7"
    spec = tables.TableSpec("t", ("stem", "identity"))
    assert tables.read_table(spark, str(tmp_path / "out"), spec).count() == 1
    with pytest.raises(tables.GrainError):
        tables.check_grain(df.unionByName(df), spec.grain)


def test_contrast_refusals_are_rows(spark):
    rows = spark.createDataFrame([("f", g, u, float(u)) for g in "ab" for u in range(3)], "fam string, g string, unit long, v double")
    c = dict(name="c", metrics=["v", "nope"], test="mannwhitney", family="fam", group="g", groups=("a", "b"), unit=["unit"], aggregate="mean", minimum=9)
    got = {r["metric"]: r["note"] for r in contrasts.declared_contrasts(rows, [c]).collect()}
    assert got == {"v": "too few units", "nope": "no such metric"}


def test_derivations_fold_and_skip(spark, gappy):
    from lapsegrid.operators import extension
    from lapsegrid.sources.tables import TableSpec

    grain = ("stem", "identity", "frame_index")
    extension.register(extension.Derivation(
        "double", lambda df, p: {"double": df.select(*grain, (F.col("signal") * p["by"]).alias("scaled"))}, (TableSpec("double", grain, fold=True),), ("signal",), {"by": 2}))
    extension.register(extension.Derivation(
        "count", lambda df, p: {"count": df.groupBy("stem", "identity").agg(F.count("scaled").alias("n"))}, (TableSpec("count", ("stem", "identity")),), ("scaled",)))
    extension.register(extension.Derivation("other", lambda df, p: {}, (), ("absent",)))
    base, found, skipped = extension.derive(gappy, ["double", "count", "other"], {"double": {"by": 3}})
    assert base.where("frame_index = 2").first()["scaled"] == 60 and skipped == {"other": "needs absent"}
    assert {r["identity"]: r["n"] for r in found["count"].collect()} == {1: 6, 2: 0}
    with pytest.raises(KeyError):
        extension.derive(gappy, ["nothing"])


def test_column_groups(spark):
    from lapsegrid.operators.features import columns_for

    groups = {"shape": ["area", "width"]}
    assert columns_for(groups, ["hours", "@shape", "area"], ["hours", "area", "width"]) == ["hours", "area", "width"]
    with pytest.raises(ValueError):
        columns_for(groups, ["@missing"], ["hours"])


def test_order_puts_nulls_last_either_way(spark):
    from lapsegrid.operators.features import stable_order
    from lapsegrid.plans.heavy import LIMIT_SETTING

    rows = spark.createDataFrame([("s", 1, 2, 5.0), ("s", 2, 2, None), ("s", 3, None, 1.0), ("s", 4, 7, None), ("s", 5, 2, 1.0), ("t", 6, None, None)], "stem string, identity long, n int, m double")
    for limit in ("1000000", "1"):
        spark.conf.set(LIMIT_SETTING, limit)
        try:
            got = stable_order(rows, ["stem"], ["-n", "m", "identity"], "place").where("stem = 's'").orderBy("place").collect()
        finally:
            spark.conf.unset(LIMIT_SETTING)
        assert [r["identity"] for r in got] == [4, 5, 1, 2, 3]


def test_late_events_and_strong_persistence_show(spark, tmp_path):
    """An event on day 45 lengthens its recording's clock; a surrogate of a slow entity is as slow."""
    import datetime

    from lapsegrid.operators import contrasts as C
    from lapsegrid.operators import presence as P
    from lapsegrid.sources.canonical import Inputs

    at = datetime.datetime(2024, 1, 1)
    rows = [(k, "view", 1, at + datetime.timedelta(days=d), 1.0) for k, d in enumerate((0, 1, 44))] + [(9, "click", 2, at, 2.0)]
    spark.createDataFrame(rows, "event_id long, event_type string, user_id long, ts timestamp, value double").write.parquet(str(tmp_path / "events.parquet"))
    i = Inputs(spark, str(tmp_path))
    assert {r["stem"]: r["n_frames"] for r in i.recordings().collect()} == {"view": 45, "click": 1}
    assert P.roll_call(i.daily(), i.recordings()).count() == 46
    assert {r["stem"]: r["missing"] for r in P.presence_audit(i.daily(), i.recordings()).collect()} == {"view": 42, "click": 0}

    import numpy as np

    draw, x = np.random.default_rng(1), [0.0]
    for _ in range(1999):
        x.append(0.97 * x[-1] + draw.standard_normal() * (1 - 0.97**2) ** 0.5)
    series = spark.createDataFrame([("s", 1, k, float(v)) for k, v in enumerate(x)], "stem string, identity long, frame_index int, signal double")
    got = np.array([r["signal"] for r in C.autoregressive_surrogates(series, "signal", 1, 3).orderBy("frame_index").collect()])
    assert len(got) == 2000 and np.corrcoef(got[1:], got[:-1])[0, 1] > 0.93


def test_walks_start_from_the_shares_and_start_again_after_gaps(spark):
    from lapsegrid.operators import contrasts as C

    # every other frame is missing: no transition, so each frame is drawn from the shares
    rows = spark.createDataFrame([("s", e, 2 * k, "b" if k % 4 else "a") for e in range(20) for k in range(200)], "stem string, identity long, frame_index int, state string")
    got = {r["state"]: r["count"] for r in C.persistence_resample(rows, "state", ["a", "b"], 5).groupBy("state").count().collect()}
    assert sum(got.values()) == 4000 and 850 < got["a"] < 1150


def test_storage_needs_a_name_on_a_cluster():
    from lapsegrid.plans import durable

    class Context:
        master = "spark://somewhere"

    class Conf:
        def get(self, *_):
            return None

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(ValueError):
        durable.shared_folder(Session())


def test_pairs_at_one_time_have_no_slope(spark):
    from lapsegrid.operators.pairs import robust_trend

    rows = spark.createDataFrame([("s", 1, float(h), float(2 * h + d)) for h in range(6) for d in (0, 0.25)], "stem string, identity long, hours double, v double")
    r = robust_trend(rows, "v").first()
    assert abs(r["slope_per_hour"] - 2.0) < 0.06 and r["slope_high"] < 3


def test_equal_moves_share_a_class_position(spark):
    """Lengths that differ in the last bit of their root are ties."""
    from lapsegrid.operators.regimes import classify

    moves = [0.1 + 0.2, 0.3, 0.7, 0.1]
    df = spark.createDataFrame([("s", k, 1.0, v) for k, v in enumerate(moves)], "stem string, identity int, area double, step double")
    got = {r["identity"]: r for r in classify(df, ["stem"], "area", "step").collect()}
    assert got[0]["movement_position"] == got[1]["movement_position"] == 0.5
    assert got[0]["step"] != got[1]["step"]


def test_hours_since_a_place_was_held_in_one_scan(spark):
    from lapsegrid.operators import features as V

    held, lost = {1, 2, 6, 11}, {4, 8, 9}
    rows = [("s", k, f, f * 0.5, f in held and k == 0, f not in lost) for k in (0, 1) for f in range(13)]
    df = spark.createDataFrame(rows, "stem string, k int, frame_index int, hours double, occ boolean, valid boolean")
    plan = V.since_occupied(df, ["stem", "k"], "occ", "valid", False)
    got = {(r["k"], r["frame_index"]): r["since_hours"] for r in plan.collect()}
    want = {}
    for f in range(13):
        near = [g for g in held if g <= f and not lost & set(range(g, f + 1))]
        if f not in lost:
            want[0, f], want[1, f] = ((f - max(near)) * 0.5 if near else None), None
    assert got == want


def test_coverage_order_of_a_walk_and_of_one_place(spark):
    """A mask that never moves covers alike in any order; a walk's curve is the mean share covered."""
    from lapsegrid.operators import stats as S

    rows = [("s", 1, f, 0, f) for f in range(6)] + [("s", 2, f, 3, 3) for f in range(6)]
    df = spark.createDataFrame(rows, "stem string, identity long, frame_index int, y int, x int")
    plan = S.coverage_order_test(df, 9, 13)
    got = {r["identity"]: r for r in plan.collect()}
    assert abs(got[1]["observed"] - 21 / 36) < 1e-12 and got[2]["observed"] == 1.0 and got[2]["null_mean"] == 1.0 and got[2]["p_value"] == 1.0


def test_false_positive_rates_read_one_written_screen(spark):
    from lapsegrid import workload

    plan = workload.callables()["null_false_positive_rates"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Generate" not in plan


def test_tracks_of_objects_search_for_no_centre(spark):
    from lapsegrid.operators import pixels as X

    masks = spark.createDataFrame([("s", e, f, (e * 3 + f) % 6, x) for e in (1, 2) for f in range(4) for x in (e, e + 1)], "stem string, identity int, frame_index int, y int, x int")
    things = spark.createDataFrame([("s", "a", "o1", 0, 0), ("s", "a", "o2", 3, 4), ("s", "b", "o3", 5, 1)], "stem string, object_set string, object string, y int, x int")
    whole, slim = (X.object_overlap(masks, things, 6, 6, named=n) for n in (True, False))
    assert set(whole.columns) - set(slim.columns) == {"nearest_object", "nearest_centre", "nearest_centre_px"}
    assert "FlatMapGroupsInPandas" not in slim._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(str, whole.select(*slim.columns).collect())) == sorted(map(str, slim.collect()))


def test_half_turns_and_steps_at_the_floor_are_those_of_the_sql(spark):
    """Opposite headings differ by pi give or take a last bit, which decides the sign; a step may be the floor give or take one."""
    import itertools
    import math

    rows, legs = [], [(a / n, b / n) for n in (3, 7, 13) for a in range(-13, 14) for b in range(-13, 14) if math.hypot(a, b) > n / 2]
    for i, (dy, dx) in enumerate(legs):
        rows += [("s", i, f, f * 0.5, y, x) for f, (y, x) in enumerate(((3.0, 5.0), (3.0 + dy, 5.0 + dx), (3.0, 5.0)))]
    for i, (k, l) in enumerate(itertools.product(range(0, 80), range(0, 60, 7)), len(legs)):
        rows += [("s", i, 0, 0.0, k / 10, l / 10), ("s", i, 1, 0.5, (k + 3) / 10, (l + 4) / 10)]
    schema = "stem string, identity long, frame_index int, hours double, y double, x double"
    got = tracks.turns(tracks.steps(spark.createDataFrame(rows, schema)), 0.5).collect()
    where = {(r[1], r[2]): r[4:] for r in rows}
    for r in got:
        at, before = where[r.identity, r.frame_index], where.get((r.identity, r.frame_index - 1))
        if before is None:
            continue
        dy, dx = at[0] - before[0], at[1] - before[1]
        heading = math.atan2(dy, dx) if math.sqrt(dy * dy + dx * dx) >= 0.5 else None
        assert r.heading == heading, (before, at)
        if r.frame_index == 2:
            diff = heading - math.atan2(*(b - a for a, b in zip(where[r.identity, 0], before)))
            assert (r.turn > 0) == (math.atan2(math.sin(diff), math.cos(diff)) > 0), (before, at)
