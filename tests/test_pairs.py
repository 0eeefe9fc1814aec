"""Block-pair plans against brute force on small fixtures."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lapsegrid.functions.numeric import rank_p_value
from lapsegrid.operators import pairs as Q
from lapsegrid.plans import slopes


def alignment(left, right, window):
    n = len(left)
    cost = np.full((n + 1, n + 1), np.inf)
    cost[0, 0] = 0
    came = {}
    for i in range(1, n + 1):
        for j in range(max(1, i - window), min(n, i + window) + 1):
            options = [(i - 1, j), (i, j - 1), (i - 1, j - 1)]
            best = min(range(3), key=lambda k: (cost[options[k]], k))
            came[i, j] = options[best]
            cost[i, j] = cost[options[best]] + (left[i - 1] != right[j - 1])
    path, at = [], (n, n)
    while at[0] > 0 and at[1] > 0:
        path.append((at[0] - 1, at[1] - 1))
        at = came[at]
    both = [b - a for a, b in path if left[a] >= 0 and right[b] >= 0]
    return cost[n, n] / len(path), (float(np.mean(both)) if both else None), len(both)


@pytest.mark.parametrize("chunk", [4, 64])
def test_sequence_alignment_in_rounds(spark, chunk):
    """Two recordings with clocks of two lengths: each pair's alignment ends with its own."""
    rng = np.random.default_rng(2)
    band, clocks = 3, {"s": 13, "short": 6}
    seqs = {(stem, e): np.where(rng.random(n) < 0.2, -1, rng.integers(0, 3, n)) for stem, n in clocks.items() for e in range(4)}
    rows = [(stem, e, f, int(v)) for (stem, e), s in seqs.items() for f, v in enumerate(s) if v >= 0]
    symbols = spark.createDataFrame(rows, "stem string, identity long, frame_index int, symbol int")
    pairs = Q.recording_pairs(symbols.select("stem", "identity").distinct())
    lengths = spark.createDataFrame(list(clocks.items()), "stem string, n_frames int")
    got = Q.aligned_sequences(symbols, pairs, lengths, band, chunk=chunk).collect()
    assert len(got) == 12
    for r in got:
        d, off, both = alignment(seqs[r["stem"], r["identity_a"]], seqs[r["stem"], r["identity_b"]], band)
        assert r["dtw_distance"] == pytest.approx(d)
        assert r["alignment_overlap_steps"] == both
        assert r["alignment_offset_frames"] == (None if off is None else pytest.approx(off))
    enough = Q.aligned_sequences(symbols, pairs, lengths, band, chunk=chunk, min_overlap=6).collect()
    assert {tuple(r) for r in enough} == {tuple(r) for r in got if r["alignment_overlap_steps"] >= 6} and len(enough) < len(got)


def test_sequences_that_never_agree_differ_by_one_on_any_clock(spark):
    rows = [(stem, e, f, e) for stem, n in (("long", 20), ("short", 10)) for e in (0, 1) for f in range(n)]
    symbols = spark.createDataFrame(rows, "stem string, identity long, frame_index int, symbol int")
    lengths = symbols.groupBy("stem").agg((F.max("frame_index") + 1).alias("n_frames"))
    got = Q.aligned_sequences(symbols, Q.recording_pairs(symbols.select("stem", "identity").distinct()), lengths, 4).collect()
    assert sorted((r["stem"], r["dtw_distance"]) for r in got) == [("long", 1.0), ("short", 1.0)]


def test_last_bits_of_a_move_reach_neither_alignment_nor_rule(spark):
    """Two entities that move alike but for the last bit of one length, which lies where classes part: their sequences align and their rule is that of equal lengths."""
    from lapsegrid.operators import regimes as G

    move = 2**0.5

    def results(other):
        rows = [("s", e, f, f * 0.5, 5.0, [1.0, length, 3.0, 3.0][f % 4]) for e, length in ((1, move), (2, other)) for f in range(12)]
        df = spark.createDataFrame(rows, "stem string, identity long, frame_index int, hours double, area_px double, step_px_gapless double")
        classed = G.classify(df, ["stem"], "area_px", "step_px_gapless")
        symbols = classed.select("stem", "identity", "frame_index", F.col("regime").alias("symbol"))
        clocks = symbols.groupBy("stem").agg((F.max("frame_index") + 1).alias("n_frames"))
        aligned = Q.aligned_sequences(symbols, Q.recording_pairs(symbols.select("stem", "identity").distinct()), clocks, 4).collect()
        moves = G.transitions(classed)
        return aligned, sorted(Q.mismatch_by_cycle(moves, Q.next_state_rule(moves, ["stem"]), ["stem"], 4.0, 8).collect())

    aligned, mismatch = results(float(np.nextafter(move, 2)))
    assert [r["dtw_distance"] for r in aligned] == [0.0]
    assert (aligned, mismatch) == results(move)


def brute_window(segments, minimum, entities):
    best = None
    for first in sorted({s[1] for s in segments}):
        for last in {s[2] for s in segments}:
            n = sum(s[1] <= first and s[2] >= last for s in segments)
            if last - first + 1 >= minimum and n >= entities:
                best = max(best or (0,), (last - first + 1, n, -first, last))
    return (-best[2], best[3], best[1]) if best else None


def test_common_window_and_its_distances(spark):
    rng = np.random.default_rng(6)
    rows = []
    for stem, n, entities in (("a", 20, 6), ("b", 10, 4), ("few", 12, 2), ("gaps", 16, 3)):
        for e in range(entities):
            missing = set(rng.integers(0, n, 2).tolist()) if stem != "b" else {9 - e} if e == 3 else set()
            rows += [(stem, e, f, float(e)) for f in range(n) if f not in missing and not (stem == "gaps" and f % 3 == 2)]
    df = spark.createDataFrame(rows, "stem string, identity long, frame_index int, v double")
    segments = {}
    for stem, e, f, _ in rows:
        own = segments.setdefault((stem, e), [])
        if own and own[-1][2] == f - 1:
            own[-1][2] = f
        else:
            own.append([e, f, f])
    got = {(r["stem"], r["identity"]): r for r in Q.trajectory_window(df, 4, 3).collect()}
    assert set(got) == set(segments)
    for stem in ("a", "b", "few", "gaps"):
        long_ = [s for (st, _), own in segments.items() if st == stem for s in own if s[2] - s[1] >= 3]
        want = brute_window(long_, 4, 3)
        for (st, e), r in got.items():
            if st == stem:
                assert (None if want is None else (r["window_first"], r["window_last"], r["window_entities"])) == want
                inside = want is not None and any(s[1] <= want[0] and s[2] >= want[1] for s in segments[st, e])
                assert (r["status"] == "available") == inside
    assert {r["status"] for (st, _), r in got.items() if st == "few"} == {"no_common_window"}
    assert {r["status"] for (st, _), r in got.items() if st == "gaps"} == {"too_few_consecutive_frames"}
    distance = Q.trajectory_distances(df, F.array("v"), 1, 2, 4, 3).collect()
    available = {k for k, r in got.items() if r["status"] == "available"}
    assert {(r["stem"], r["identity_a"], r["identity_b"]) for r in distance} == {(s, a, b) for s, a in available for t, b in available if s == t and a < b}
    for r in distance:
        assert r["trajectory_distance"] == pytest.approx(r["identity_b"] - r["identity_a"])


def test_trend_in_blocks_equals_one_task(spark):
    rng = np.random.default_rng(4)
    rows = [("s", e, float(t), float(v)) for e in (1, 2) for t, v in zip(range(0, 60, e), rng.integers(-9, 9, 60))]
    rows += [("s", 1, float(t), float(t % 3)) for t in range(0, 60, 7)]  # several values at one time
    df = spark.createDataFrame(rows, "stem string, identity long, hours double, v double")
    one = {r["identity"]: r for r in Q.robust_trend(df, "v", block=1000).collect()}
    many = {r["identity"]: r for r in Q.robust_trend(df, "v", block=16, slope_block=16).collect()}
    assert set(one) == set(many) == {1, 2}
    for e in one:
        for c in ("observations", "span_hours", "level_median", "slope_per_hour", "slope_low", "slope_high", "slope_least_squares", "change_over_recording", "monotone_rho", "monotone_p_value"):
            assert many[e][c] == pytest.approx(one[e][c], abs=1e-12), c
        t = np.array([r[2] for r in rows if r[1] == e])
        v = np.array([r[3] for r in rows if r[1] == e])
        i, j = np.nonzero(t[:, None] < t[None, :])
        assert one[e]["slope_per_hour"] == pytest.approx(np.median((v[j] - v[i]) / (t[j] - t[i])))
        assert one[e]["level_median"] == pytest.approx(np.median(v))


@pytest.mark.parametrize("kind", ["smooth", "whole", "flat", "steep"])
def test_slopes_of_any_rank_without_the_pairs(spark, kind):
    """Ranks from all over the list of slopes, with brackets that must shrink to 30 pairs, and blocks of 50 rows."""
    rng = np.random.default_rng(7)
    n = 260
    t = np.sort(rng.random(n) * 90) if kind == "smooth" else np.sort(rng.integers(0, 150, n)).astype(float)
    v = {"smooth": rng.normal(size=n), "whole": rng.integers(0, 4, n).astype(float), "flat": np.full(n, 2.0), "steep": 1e6 * t + rng.normal(size=n)}[kind]
    t, v = t[np.lexsort((v, t))], v[np.lexsort((v, t))]
    i, j = np.nonzero(t[:, None] < t[None, :])
    s = np.sort((v[j] - v[i]) / (t[j] - t[i]))
    rows = spark.createDataFrame([("s", 1, k + 1, float(a), float(b)) for k, (a, b) in enumerate(zip(t, v))], "stem string, identity long, position long, t double, v double")
    wanted = sorted({0, 1, len(s) // 7, len(s) // 2 - 1, len(s) // 2, len(s) - 2, len(s) - 1})
    ranks = spark.createDataFrame([("s", 1, str(r), r, len(s)) for r in wanted], "stem string, identity long, target string, rank long, pairs long")
    got = {int(r["target"]): r["value"] for r in slopes.select_slopes(rows, ["stem", "identity"], ranks, block=50, listed=30).collect()}
    assert set(got) == set(wanted)
    for r in wanted:
        assert got[r] == pytest.approx(s[r], rel=1e-9, abs=1e-11)


def test_rank_p_value(spark):
    """Against the tail of Student's t by plain summation of its density."""
    cases = [(rho, n) for rho in (-0.7, 0.0, 0.05, 0.4, 0.999, 1.0, None) for n in (3, 4, 5, 10, 31, 400)]
    df = spark.createDataFrame(cases, "rho double, n long")
    for r in df.select("*", rank_p_value(F.col("rho"), F.col("n")).alias("p")).collect():
        if r["rho"] is None:
            assert r["p"] is None
            continue
        v = r["n"] - 2
        if abs(r["rho"]) == 1.0:
            assert r["p"] == 0.0
            continue
        angle = (np.arange(400_000) + 0.5) / 400_000 * np.pi / 2
        density = np.cos(angle) ** (v - 1)
        limit = np.arctan(abs(r["rho"]) * np.sqrt(v / (1 - r["rho"] ** 2)) / np.sqrt(v))
        assert r["p"] == pytest.approx(density[angle > limit].sum() / density.sum(), abs=1e-4)


def test_line_gives_its_slope_back_and_one_wild_value_does_not_move_it(spark):
    rows = [("s", 1, float(t), 2.0 * t) for t in range(48)] + [("s", 2, float(t), 2.0 * t + (500.0 if t == 40 else 0.0)) for t in range(48)]
    rows += [("s", 3, float(t), 7.0) for t in range(10)] + [("s", 4, 0.0, 1.0)]
    df = spark.createDataFrame(rows, "stem string, identity long, hours double, v double")
    got = {r["identity"]: r for r in Q.robust_trend(df, "v").collect()}
    assert set(got) == {1, 2, 3}
    assert got[1]["slope_per_hour"] == pytest.approx(2.0) and got[1]["change_over_recording"] == pytest.approx(94.0)
    assert got[2]["slope_per_hour"] == pytest.approx(2.0) and abs(got[2]["slope_least_squares"] - 2.0) > 0.5
    assert got[3]["slope_per_hour"] == 0.0 and got[3]["monotone_rho"] is None


def brute_recurrence(z, q):
    d = np.sqrt(((z[:, None] - z[None]) ** 2).sum(-1))
    cut = np.quantile(d[np.triu_indices(len(z), 1)], q)
    m = d <= cut
    np.fill_diagonal(m, False)
    pad = np.pad(m, 1)
    diag = m & (pad[:-2, :-2] | pad[2:, 2:])
    vert = m & (pad[:-2, 1:-1] | pad[2:, 1:-1])
    return cut, diag.sum() / m.sum(), vert.sum() / m.sum(), [np.mean(np.diagonal(m, k)) for k in range(1, 6)]


@pytest.mark.parametrize("block", [7, 100])
def test_recurrence_in_blocks(spark, block):
    rng = np.random.default_rng(8)
    n = 30
    data = np.cumsum(rng.normal(size=(n, 2)), axis=0)
    df = spark.createDataFrame([("s", 1, i, float(a), float(b)) for i, (a, b) in enumerate(data)], "stem string, identity long, frame_index int, a double, b double")
    rates, shares = Q.recurrence(Q.state_vectors(df, ["a", "b"], 5), 0.13, 5, block=block)
    cut, det, lam, by_lag = brute_recurrence((data - data.mean(0)) / data.std(0), 0.13)
    s = shares.first()
    assert s["cutoff"] == pytest.approx(cut) and s["determinism"] == pytest.approx(det) and s["laminarity"] == pytest.approx(lam)
    assert [r["recurrence_rate"] for r in rates.orderBy("lag_frames").collect()] == pytest.approx(by_lag)


def test_pair_moments_in_blocks(spark):
    from lapsegrid.plans.blocks import entity_pair_moments

    rng = np.random.default_rng(1)
    rows = [("s", e, t, float(rng.normal())) for e in range(9) for t in range(20) if rng.random() < 0.6]
    df = spark.createDataFrame(rows, "stem string, identity long, t int, v double")
    got = {(r["a"], r["b"]): r for r in entity_pair_moments(df, ["stem"], "identity", "t", "v", block=3, times_per_chunk=7).collect()}
    series = {e: {t: v for _, k, t, v in rows if k == e} for e in range(9)}
    for a in range(9):
        for b in range(a + 1, 9):
            both = sorted(set(series[a]) & set(series[b]))
            assert got[a, b]["n"] == len(both)
            assert got[a, b]["sxy"] == pytest.approx(sum(series[a][t] * series[b][t] for t in both))
            assert got[a, b]["sx"] == pytest.approx(sum(series[a][t] for t in both))


def test_pair_moments_shuffle_no_pairs(spark):
    """What is shuffled are values of entities: no stage adds up rows of pairs, of which there are many more."""
    from lapsegrid.plans.blocks import entity_pair_moments

    rng = np.random.default_rng(2)
    rows = [(s, f"e{e}", t, float(rng.normal())) for s in ("p", "q") for e in range(7) for t in range(-5, 15) if (e + t) % 3]
    df = spark.createDataFrame(rows, "stem string, identity string, t int, v double")
    got = entity_pair_moments(df, ["stem"], "identity", "t", "v", block=2, times_per_chunk=4)
    parts = entity_pair_moments(df, ["stem"], "identity", "t", "v", block=2, times_per_chunk=4, stretches=2)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("MapInArrow") < plan.index("RepartitionByExpression")
    assert "Aggregate" not in plan[: plan.index("MapInArrow")]
    found = {(r["stem"], r["a"], r["b"]): r for r in got.collect()}
    for r in parts.collect():
        assert list(found[r["stem"], r["a"], r["b"]]) == pytest.approx(list(r))
    assert parts.count() == len(found)
    of = {(s, e, t): v for s, e, t, v in rows}
    wanted = {(s, f"e{a}", f"e{b}") for s in ("p", "q") for a in range(7) for b in range(a + 1, 7) if any((s, f"e{a}", t) in of and (s, f"e{b}", t) in of for t in range(-5, 15))}
    assert set(found) == wanted
    for (s, a, b), r in found.items():
        both = [(of[s, a, t], of[s, b, t]) for t in range(-5, 15) if (s, a, t) in of and (s, b, t) in of]
        x, y = np.array(both).T
        assert [r[k] for k in ("n", "sx", "sy", "sxx", "syy", "sxy")] == pytest.approx([len(x), x.sum(), y.sum(), x @ x, y @ y, x @ y])


def test_nearest_by_growing_cells(spark):
    from lapsegrid.plans.nearest import k_nearest

    rng = np.random.default_rng(6)
    pts = np.vstack([rng.uniform(0, 3, (40, 2)), rng.uniform(50, 400, (6, 2))])
    df = spark.createDataFrame([("s", i, float(y), float(x)) for i, (y, x) in enumerate(pts)], "stem string, identity long, y double, x double")
    got = k_nearest(df, df, ["stem"], ["identity"], 3, 0.5, F.col("t_identity") != F.col("identity"), ("t_identity",)).collect()
    d = np.sqrt(((pts[:, None] - pts[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    for i in range(len(pts)):
        mine = sorted(r["distance"] for r in got if r["identity"] == i)
        assert mine == pytest.approx(sorted(d[i])[:3])


def test_places_equally_far_tie_whatever_the_last_bits(spark):
    """Moves whose lengths are equal but for the last bit of the root: the smaller identity is the nearer one."""
    from lapsegrid.plans.nearest import k_nearest

    both = [(a / 3, b / 3, c / 3, d / 3) for a in range(1, 40) for b in range(a, 40) for c in range(a + 1, 40) for d in range(c, 40) if a * a + b * b == c * c + d * d]
    moves = spark.createDataFrame(both, "a double, b double, c double, d double")
    split = moves.where("hypot(a, b) <> hypot(c, d)").orderBy("a", "b", "c", "d").first()
    assert split is not None
    far, near = sorted([(split.a, split.b), (split.c, split.d)], key=lambda p: -spark.range(1).select(F.hypot(F.lit(p[0]), F.lit(p[1]))).first()[0])
    df = spark.createDataFrame([("s", 9, 0.0, 0.0), ("s", 1, *far), ("s", 2, *near)], "stem string, identity long, y double, x double")
    got = k_nearest(df, df, ["stem"], ["identity"], 1, 0.5, F.col("t_identity") != F.col("identity"), ("t_identity",)).collect()
    assert [r["t_identity"] for r in got if r["identity"] == 9] == [1]


def test_neighbour_searches_gather_no_side_on_the_driver(spark):
    """Written tables look small on disk; neither the search nor the distance map may broadcast them."""
    from lapsegrid.operators import pixels as X
    from lapsegrid.plans.nearest import within_reach

    rows = [("s", e, f, e, (e * 7 + f) % 20, 1.0) for e in range(12) for f in range(3)]
    masks = spark.createDataFrame(rows, "stem string, identity long, frame_index int, y int, x int, raw double")
    at = masks.select("stem", "frame_index", "identity", F.col("y").cast("double").alias("y"), F.col("x").cast("double").alias("x"))
    plans = [within_reach(at, at, ["stem", "frame_index"], 4.0), Q.frame_neighbours(at, 2, 4.0, 4.0), X.domains(masks, 15, 20)]
    for df in plans:
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_domains_are_the_nearest_masks(spark):
    from lapsegrid.operators import pixels as X

    rng = np.random.default_rng(3)
    places = {(int(p) // 20, int(p) % 20): int(e) for p, e in zip(rng.choice(300, 40, replace=False), rng.integers(1, 6, 40))}
    masks = spark.createDataFrame([("s", e, 4, y, x) for (y, x), e in places.items()], "stem string, identity long, frame_index int, y int, x int")
    want = {}
    for y in range(15):
        for x in range(20):
            owner = min(((y - a) ** 2 + (x - b) ** 2, e) for (a, b), e in places.items())[1]
            want[owner] = want.get(owner, 0) + 1
    got = {r["identity"]: r for r in X.domains(masks, 15, 20).collect()}
    assert {e: r["domain_px"] for e, r in got.items()} == want
    assert all(r["domain_occupancy"] == pytest.approx(sum(e == o for o in places.values()) / r["domain_px"]) for e, r in got.items())


def test_a_cycle_vector_that_cancels_out_has_no_direction(spark):
    """Equal weights all around cancel out but for the last bits of their sums; a weight in one bin does not."""
    rows = [("even", b, 0.1) for b in range(8)] + [("half", b, 0.7) for b in (1, 5)] + [("none", b, 0.0) for b in range(8)] + [("one", 2, 0.3)]
    got = {r.stem: (r.vector_length, r.mean_direction_cycles) for r in Q.cycle_vector(spark.createDataFrame(rows, "stem string, bin int, w double"), ["stem"], "w", 8).collect()}
    assert got["even"] == (0.0, None) and got["half"] == (0.0, None) and got["none"] == (None, None)
    assert got["one"] == pytest.approx((1.0, 2.5 / 8), abs=1e-9)


@pytest.mark.parametrize("batch", ["3", "10000"])
def test_small_keys_share_a_call_of_python_and_cut_keys_wait(spark, batch):
    """Groups of one to nine rows, in batches that cut them: each group is worked on once, whole and in order."""
    from pyspark.sql import types as T

    from lapsegrid.plans.blocks import in_tasks

    rows = [(f"s{k % 3}", k, i, float(i)) for k in range(20) for i in range(1, k % 9 + 2)]
    df = spark.createDataFrame(rows[::-1], "stem string, identity long, position int, v double")

    def work(table):
        return {"n": np.array([len(table)]), "sorted": np.array([table["position"].to_pylist() == list(range(1, len(table) + 1))])}

    set_to = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(set_to)
    spark.conf.set(set_to, batch)
    try:
        got = in_tasks(df, ["stem", "identity"], "position", ["identity"], work, [T.StructField("n", T.LongType()), T.StructField("sorted", T.BooleanType())]).collect()
    finally:
        spark.conf.set(set_to, before)
    assert sorted((r["identity"], r["n"]) for r in got) == [(k, k % 9 + 1) for k in range(20)] and all(r["sorted"] for r in got)


def test_recurrence_of_many_entities_takes_no_call_for_each(spark):
    rows = [("s", e, i, float((i * 7 + e) % 5), float(i % 3)) for e in range(30) for i in range(12)]
    df = spark.createDataFrame(rows, "stem string, identity long, frame_index int, a double, b double")
    rates, _ = Q.recurrence(Q.state_vectors(df, ["a", "b"], 5), 0.1, 5)
    assert "FlatMapGroupsInPandas" not in rates._jdf.queryExecution().executedPlan().toString() and rates.count() == 150


def test_lags_and_redealt_values_of_small_and_heavy_keys_agree(spark):
    from lapsegrid.plans.scan import redealt

    rng = np.random.default_rng(4)
    rows = [("s", e, int(f), float(rng.normal()), None if f % 7 == 3 else float(f)) for e in range(5) for f in rng.permutation(40)[:25]]
    df = spark.createDataFrame([*rows, ("s", None, 1, 1.0, 1.0)], "stem string, identity long, frame_index int, a double, b double")
    lags = [sorted(map(str, Q.lagged_pairs(df, "a", "b", 3, two_level=big).select("identity", "frame_index", "lag_frames", "va", "vb").collect())) for big in (False, True)]
    text = F.concat_ws("|", F.lit("5"), "replicate", "identity", "frame_index")
    deals = [sorted(map(str, redealt(df, ["stem", "identity"], ["frame_index"], text, 3, ["b"], ["a"], big).where("identity IS NOT NULL").collect())) for big in (False, True)]
    assert lags[0] == lags[1] and deals[0] == deals[1] and len(deals[0]) == 3 * len(rows)


def test_lag_band_shuffles_a_row_once_whatever_the_copies(spark):
    df = spark.createDataFrame([("s", e, f, float(f % 5), float(f % 3)) for e in range(4) for f in range(20)], "stem string, identity long, frame_index int, a double, b double")
    plan = Q.shuffled(df, ["b"], 9, 5, kept=["a"]).groupBy("stem", "identity", "replicate").count()._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Initial Plan")[0].count("Exchange hashpartitioning") == 1


def test_a_pair_leaves_its_task_as_its_correlation(spark):
    """The same bits as the column expression gives on the six sums, and none of those reach the network or the JVM."""
    from lapsegrid.functions.numeric import corr_from_moments
    from lapsegrid.plans.blocks import entity_pair_moments

    rng = np.random.default_rng(4)
    rows = [("s", e, f, 7.0 if e == 3 else float(rng.integers(0, 40)) / 7) for e in range(12) for f in range(14) if rng.random() < (0.2 if e == 5 else 0.8)]
    df = spark.createDataFrame(rows + [("t", 1, 0, 1.0), ("t", 2, 1, 1.0)], "stem string, identity long, frame_index int, v double")
    plan = Q.pair_correlations(df, "v", 4)
    assert "sxx" not in plan._jdf.queryExecution().executedPlan().toString()
    sums = entity_pair_moments(df, ["stem"], "identity", "frame_index", "v")
    want = {(r.a, r.b): (int(r.n), r.r) for r in sums.select("a", "b", "n", F.when(F.col("n") >= 4, corr_from_moments(tolerance=1e-12)).alias("r")).collect()}
    got = {(r.identity_a, r.identity_b): (r.overlap_frames, r.correlation) for r in plan.collect()}
    assert got == want and len(got) > 50 and any(r is None for _, r in got.values())
