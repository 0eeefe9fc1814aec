"""Declared contrasts, treatment against control, and state dynamics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from lapsegrid.functions.numeric import ratio
from lapsegrid.operators import stats as S
from lapsegrid.operators.learn import unit_draw
from lapsegrid.operators.rollup import unit_ledger
from lapsegrid.plans.compose import entering
from lapsegrid.plans.durable import cut
from lapsegrid.plans.ranks import quantiles
from lapsegrid.plans.scan import frame_bucket, ordered_scan

ENTITY = ["stem", "identity"]


#: Tests by name: how many groups they compare (0: any number), whether units are matched, and what their effect is. Fixed names.
TESTS = {
    "mannwhitney": (2, False, "median_difference"),
    "kruskal": (0, False, "epsilon_squared"),
    "welch_t": (2, False, "hedges_g"),
    "anova": (0, False, "eta_squared"),
    "wilcoxon": (2, True, "median_paired_difference"),
    "paired_t": (2, True, "hedges_g_paired"),
    "signed_rank": (1, False, "median_against_zero"),
}
_CONTRAST = "contrast string, metric string, test string, family string, n_a long, n_b long, statistic double, effect_kind string, effect double, note string, p_value double"


def _tested(ledger: DataFrame, c: dict) -> DataFrame:
    """(family, n_a, n_b, statistic, effect, p_value) of one declared test over a ledger of units."""
    family, group, groups = c["family"], c["group"], list(c["groups"])
    count, paired, _ = TESTS[c["test"]]
    replicates, seed = c.get("replicates", 199), c.get("seed", 7)
    rows = ledger.where(F.col(group).isin(*groups)).withColumn("__unit", F.concat_ws("|", group, *c["unit"]))
    none = F.lit(None).cast("long")
    if c["test"] == "mannwhitney":
        medians = [quantiles(rows.where(F.col(group) == g), [family], "unit_value", {n: 0.5}).drop("total") for g, n in zip(groups, ("__a", "__b"), strict=True)]
        t = S.mann_whitney(rows, [family], group, tuple(groups), "unit_value").join(medians[0], family, "left").join(medians[1], family, "left")
        return t.select(family, "n_a", "n_b", F.col("u_statistic").alias("statistic"), (F.col("__a") - F.col("__b")).alias("effect"), "p_value")
    if c["test"] == "kruskal":
        t = S.kruskal_wallis(rows, [family], group, len(groups), "unit_value")
        return t.select(family, F.col("n").alias("n_a"), none.alias("n_b"), F.col("h_statistic").alias("statistic"), F.col("epsilon_squared").alias("effect"), "p_value")
    if c["test"] == "welch_t":
        t = S.welch(rows, [family], group, tuple(groups), "unit_value")
        p = S.permuted_difference(rows, [family], group, tuple(groups), "__unit", "unit_value", replicates, seed).select(family, "p_value")
        return t.join(p, family, "left").select(family, "n_a", "n_b", F.col("t_statistic").alias("statistic"), F.col("hedges_g").alias("effect"), "p_value")
    if c["test"] == "anova":
        t = S.anova(rows, [family], group, "unit_value")
        p = S.permuted_f(rows, [family], group, "__unit", "unit_value", replicates, seed)
        return t.join(p, family, "left").select(family, F.col("n").alias("n_a"), none.alias("n_b"), F.col("f_statistic").alias("statistic"), F.col("eta_squared").alias("effect"), "p_value")
    if paired:
        side = [F.max(F.when(F.col(group) == g, F.col("unit_value"))).alias(n) for g, n in zip(groups, ("__a", "__b"), strict=True)]
        rows = rows.withColumn("__unit", F.concat_ws("|", *c["unit"])).groupBy(family, "__unit").agg(*side).withColumn("d", F.col("__a") - F.col("__b"))
    else:
        rows = rows.withColumn("d", F.col("unit_value")).withColumn("__a", F.col("d")).withColumn("__b", F.lit(None).cast("double"))
    sizes = rows.groupBy(family).agg(F.count("__a").alias("n_a"), (F.count("__b") if paired else none).alias("n_b"))
    if c["test"] == "paired_t":
        t = S.paired_t(rows, [family], "d").join(S.sign_flipped(rows, [family], "__unit", "d", replicates, seed), family, "left")
        g = F.col("effect") * (1 - 3.0 / (4 * (F.col("n") - 1) - 1))
        return sizes.join(t, family, "left").select(family, "n_a", "n_b", F.col("t_statistic").alias("statistic"), g.alias("effect"), "p_value")
    t = S.signed_rank(rows, [family], "d").drop("effect")
    middle = quantiles(rows, [family], "d", {"effect": 0.5}).drop("total")
    return sizes.join(t, family, "left").join(middle, family, "left").select(family, "n_a", "n_b", F.col("w_plus").alias("statistic"), "effect", "p_value")


def declared_contrasts(rows: DataFrame, contrasts: Sequence[dict]) -> DataFrame:
    """One row per contrast, family and metric, by the test that the contrast names; a contrast that cannot be made
    is a row with a note.

    A contrast has name, metrics, test, family, group, groups, unit, aggregate and minimum. Rank tests have normal
    or chi-square p values; the others have permutation p values (two-sided, plus one) of ``replicates`` draws. q is
    the Benjamini-Hochberg value within the contrast.
    """
    refused, out = [], None
    for c in contrasts:
        wanted = TESTS.get(c["test"])
        for metric in c["metrics"]:
            note = None
            if wanted is None:
                note = f"unknown test {c['test']}"
            elif wanted[0] and len(c["groups"]) != wanted[0] or not wanted[0] and len(c["groups"]) < 2:
                note = f"{c['test']} does not take {len(c['groups'])} groups"
            elif metric not in rows.columns:
                note = "no such metric"
            if note:
                refused.append((c["name"], metric, c["test"], None, None, None, None, wanted[2] if wanted else None, None, note, None))
                continue
            ledger = unit_ledger(rows, [c["family"], c["group"]], c["unit"], metric, c["aggregate"])
            short = F.coalesce(F.least("n_a", "n_b") < c["minimum"], F.lit(True))
            part = _tested(ledger, c).select(
                F.lit(c["name"]).alias("contrast"), F.lit(metric).alias("metric"), F.lit(c["test"]).alias("test"), F.col(c["family"]).cast("string").alias("family"), "n_a", "n_b",
                "statistic", F.lit(wanted[2]).alias("effect_kind"), "effect", F.when(short, "too few units").alias("note"), F.when(~short, F.col("p_value")).alias("p_value"),
            )
            out = part if out is None else out.unionByName(part)
    if refused:
        kept = rows.sparkSession.createDataFrame(refused, _CONTRAST)
        out = kept if out is None else out.unionByName(kept)
    names = [f.split()[0] for f in _CONTRAST.split(", ")]
    return S.corrected(out, ["contrast"], "p_value").select(*names, F.col("q_bh").alias("q_value"))


def treatment_vs_control(changes: DataFrame, unit: Sequence[str], arm: str, matched: str | None, minimum: int, replicates: int = 199, seed: int = 7) -> DataFrame:
    """Unit-level mean changes of two arms, matched by a key or independent, with every reason a comparison is
    refused, per metric. p comes from sign flips of matched units or from relabelled ones (two-sided, plus one), q
    is its Benjamini-Hochberg value over the metrics; a refused comparison keeps its slot."""
    per = changes.groupBy("metric", arm, *unit).agg(
        F.avg("change").alias("v"), F.count("change").alias("n"), F.count_distinct("definition").alias("__d")
    )
    mixed = per.groupBy("metric").agg(F.max((F.col("__d") > 1).cast("int")).alias("__mixed"))
    if matched is None:
        t = S.welch(per, ["metric"], arm, ("treated", "control"), "v").select("metric", "n_a", "n_b", F.col("difference").alias("estimate"), F.col("t_statistic").alias("statistic"), F.col("hedges_g").alias("effect"))
        named = per.withColumn("__unit", F.concat_ws("|", arm, *unit))
        p = S.permuted_difference(named, ["metric"], arm, ("treated", "control"), "__unit", "v", replicates, seed)
    else:
        side = lambda a: per.where(F.col(arm) == a).groupBy("metric", matched).agg(F.avg("v").alias(a))
        both = cut(side("treated").join(side("control"), ["metric", matched], "full_outer").withColumn("d", F.col("treated") - F.col("control")))
        counts = both.groupBy("metric").agg(F.count("treated").alias("n_a"), F.count("control").alias("n_b"))
        t = counts.join(S.paired_t(both, ["metric"], "d"), "metric").select("metric", "n_a", "n_b", F.col("mean_difference").alias("estimate"), F.col("t_statistic").alias("statistic"), "effect")
        p = S.sign_flipped(both, ["metric"], matched, "d", replicates, seed)
    joined = t.join(mixed, "metric").join(p.select("metric", "p_value"), "metric", "left")
    reasons = F.concat_ws("; ", F.when(F.col("__mixed") == 1, F.lit("mixed definitions")), F.when(F.col("n_a") < minimum, F.lit("too few treated units")), F.when(F.col("n_b") < minimum, F.lit("too few control units")))
    judged = joined.withColumn("reasons", reasons).drop("__mixed")
    ok = F.col("reasons") == ""
    out = judged.select("metric", "n_a", "n_b", *[F.when(ok, F.col(c)).alias(c) for c in ("estimate", "statistic", "effect", "p_value")], "reasons", F.lit(0).alias("__family"))
    return S.corrected(out, ["__family"], "p_value").select("metric", "n_a", "n_b", "estimate", "statistic", "effect", "p_value", F.col("q_bh").alias("q_value"), "reasons")


def state_dynamics(rows: DataFrame, state: str, factor: float = 1.5) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Occupancy hours, transitions and change rates over steps no longer than ``factor`` times the entity's
    median step; each step gives half its time to either end."""
    from lapsegrid.operators.presence import adjacent_edges

    edges = adjacent_edges(rows.select(*ENTITY, "hours"), "hours", factor).select(*ENTITY, "hours", "to_hours", "step_hours")
    at = rows.select(*ENTITY, "hours", F.col(state).alias("from_state"))
    to = rows.select(*ENTITY, F.col("hours").alias("to_hours"), F.col(state).alias("to_state"))
    moves = edges.join(at, [*ENTITY, "hours"]).join(to, [*ENTITY, "to_hours"])
    halves = moves.select(*ENTITY, F.inline(F.array(*[F.struct(F.col(c).alias("state"), (F.col("step_hours") / 2).alias("h")) for c in ("from_state", "to_state")])))
    occupancy = halves.groupBy(*ENTITY, "state").agg(F.sum("h").alias("hours"))
    total = moves.groupBy(*ENTITY).agg(F.sum("step_hours").alias("observed_hours"), F.count(F.lit(1)).alias("steps"), F.sum((F.col("from_state") != F.col("to_state")).cast("long")).alias("changes"))
    occupancy = occupancy.join(total.select(*ENTITY, "observed_hours"), ENTITY).withColumn("fraction", ratio("hours", "observed_hours"))
    transitions = moves.groupBy(*ENTITY, "from_state", "to_state").agg(F.count(F.lit(1)).alias("n"))
    return occupancy, transitions, total.withColumn("change_rate", ratio("changes", "observed_hours"))


def persistence_caveat(rhythms: DataFrame, dynamics: DataFrame, threshold: float) -> DataFrame:
    """Marks a supported rhythm of an entity that changes state too rarely to tell it from persistence."""
    slow = F.col("change_rate") * F.col("period") < threshold
    return rhythms.join(dynamics.select(*ENTITY, "change_rate"), ENTITY, "left").withColumn(
        "caveat", F.when(F.col("change_rate").isNull(), "no_dynamics").when(F.col("period").isNotNull() & slow, "persistent_state").otherwise("none")
    )


#: Frames of a chunk whose steps are composed in one row.
CHUNK = 64


def autoregressive_surrogates(df: DataFrame, value: str, replicates: int, seed: int, chunk: int = CHUNK) -> DataFrame:
    """First-order surrogates of each entity: its own mean, spread and lag-one correlation, innovations from digests.

    ``x_t = phi x_(t-1) + sqrt(1 - phi^2) e_t``, started from the stationary spread at the first frame and again
    after every missing one. A step is an affine map; chunks of steps are composed apart and joined by doubling,
    so an entity of any length is exact and never one task. ``phi`` is held just inside the unit interval.
    """
    keys = list(ENTITY)
    from lapsegrid.functions.numeric import safe_corr

    known = df.where(F.col(value).isNotNull()).select(*keys, "frame_index", F.col(value).cast("double").alias("v"))
    lagged = cut(ordered_scan(known, keys, ["frame_index"], frame_bucket(), lag={"__p": "v", "__pf": "frame_index"}))
    near = F.coalesce(F.col("frame_index") - F.col("__pf") == 1, F.lit(False))
    edge = F.lit(1 - 1e-6)
    s = lagged.groupBy(*keys).agg(
        F.avg("v").alias("__m"), F.stddev_pop("v").alias("__s"),
        F.greatest(F.least(F.coalesce(safe_corr(F.when(near, F.col("v")), F.when(near, F.col("__p"))), F.lit(0.0)), edge), -edge).alias("phi"),
    )
    reps = lagged.select(*keys, "frame_index", near.alias("near")).withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    source = F.concat_ws("|", F.lit(str(seed)), "replicate", *keys, "frame_index")
    normal = F.sqrt(-2 * F.ln(unit_draw(source))) * F.cos(F.lit(6.283185307179586) * unit_draw(F.concat_ws("|", F.lit("b"), source)))
    drawn = reps.withColumn("e", normal).join(s, keys)
    a = F.when(F.col("near"), F.col("phi")).otherwise(0.0)
    b = F.when(F.col("near"), F.sqrt(1 - F.col("phi") * F.col("phi")) * F.col("e")).otherwise(F.col("e"))
    steps = drawn.select(*keys, "replicate", "__m", "__s", F.floor(F.col("frame_index") / chunk).alias("chunk"), F.struct("frame_index", a.alias("a"), b.alias("b")).alias("step"))
    rk = [*keys, "replicate"]
    lists = cut(steps.groupBy(*rk, "chunk").agg(F.first("__m").alias("__m"), F.first("__s").alias("__s"), F.array_sort(F.collect_list("step")).alias("steps")))

    def through(first: Column, then: Column) -> Column:
        return F.struct((then["a"] * first["a"]).alias("a"), (then["a"] * first["b"] + then["b"]).alias("b"))

    same = F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b"))
    whole = lists.select(*rk, "chunk", F.aggregate("steps", same, lambda acc, e: through(acc, e)).alias("effect"))
    came = entering(whole, rk, "chunk", "effect", through)
    begin = F.coalesce(F.col("entering")["b"], F.lit(0.0))  # every chain starts with a restart, whose map forgets what came before
    grown = F.aggregate(
        "steps", F.struct(begin.alias("x"), F.array().cast("array<struct<frame_index:int,x:double>>").alias("out")),
        lambda acc, e: F.struct(
            (e["a"] * acc["x"] + e["b"]).alias("x"),
            F.concat(acc["out"], F.array(F.struct(e["frame_index"].cast("int").alias("frame_index"), (e["a"] * acc["x"] + e["b"]).alias("x")))).alias("out"),
        ),
    )["out"]
    walked = lists.join(came, [*rk, "chunk"]).select(*rk, "__m", "__s", F.inline(grown))
    return walked.select(*rk, "frame_index", (F.col("__m") + F.col("__s") * F.col("x")).alias(value))


def persistence_resample(rows: DataFrame, state: str, states: Sequence[str], seed: int, chunk: int = CHUNK) -> DataFrame:
    """A first-order walk of each entity over its own frames, drawn by digest: the first frame, and each frame after
    a missing one, from the entity's own state shares; every other from the transitions out of the walk's state.
    A state that the entity never leaves at consecutive frames stays.

    A step maps each state to its drawn successor; chunks of steps are composed apart and joined by doubling.
    """
    names, keys = list(states), list(ENTITY)
    seen = rows.where(F.col(state).isin(names)).select(*keys, "frame_index", F.col(state).alias("s"))
    lagged = cut(ordered_scan(seen, keys, ["frame_index"], frame_bucket(), lag={"__ps": "s", "__pf": "frame_index"}))
    near = F.coalesce(F.col("frame_index") - F.col("__pf") == 1, F.lit(False))

    def cumulative(counts: DataFrame, by: list[str], name: str) -> DataFrame:
        """Running shares over the declared states, at most one row per state."""
        w = Window.partitionBy(*by)
        upto = F.sum("n").over(w.orderBy(name)) / F.sum("n").over(w)
        return counts.select(*by, F.struct(upto.alias("upto"), F.col(name).alias("to")).alias("c")).groupBy(*by).agg(F.array_sort(F.collect_list("c")).alias("c"))

    moves = lagged.where(near).groupBy(*keys, F.col("__ps").alias("from"), F.col("s").alias("to")).agg(F.count(F.lit(1)).alias("n"))
    rules = cumulative(moves, [*keys, "from"], "to").groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("from", "c"))).alias("rules"))
    shares = cumulative(lagged.groupBy(*keys, "s").agg(F.count(F.lit(1)).alias("n")), keys, "s").withColumnRenamed("c", "shares")
    drawn = lagged.select(*keys, "frame_index", near.alias("near")).join(shares, keys).join(rules, keys, "left")
    drawn = drawn.withColumn("u", unit_draw(F.concat_ws("|", F.lit(str(seed)), *keys, "frame_index")))
    pick = lambda options: F.try_element_at(F.filter(options, lambda e: e["upto"] >= F.col("u")), F.lit(1))["to"]
    step = F.struct(*[F.when(~F.col("near"), pick(F.col("shares"))).otherwise(F.coalesce(pick(F.try_element_at("rules", F.lit(n))), F.lit(n))).alias(n) for n in names])
    placed = drawn.select(*keys, F.floor(F.col("frame_index") / chunk).alias("chunk"), F.struct("frame_index", step.alias("step")).alias("step"))
    lists = cut(placed.groupBy(*keys, "chunk").agg(F.array_sort(F.collect_list("step")).alias("steps")))

    def follow(at: Column, map_: Column) -> Column:
        out = F.lit(None).cast("string")
        for n in names:
            out = F.when(at == n, map_[n]).otherwise(out)
        return out

    def through(first: Column, then: Column) -> Column:
        return F.struct(*[follow(first[n], then).alias(n) for n in names])

    same = F.struct(*[F.lit(n).alias(n) for n in names])
    whole = lists.select(*keys, "chunk", F.aggregate("steps", same, lambda acc, e: through(acc, e["step"])).alias("effect"))
    came = entering(whole, keys, "chunk", "effect", through)
    begin = F.coalesce(F.col("entering")[names[0]], F.lit(names[0]))  # a chain starts with a restart, which is the same from every state
    walk = F.aggregate(
        "steps", F.struct(begin.alias("s"), F.array().cast("array<struct<frame_index:int,state:string>>").alias("out")),
        lambda acc, e: F.struct(
            follow(acc["s"], e["step"]).alias("s"),
            F.concat(acc["out"], F.array(F.struct(e["frame_index"].cast("int").alias("frame_index"), follow(acc["s"], e["step"]).alias("state")))).alias("out"),
        ),
    )["out"]
    return lists.join(came, [*keys, "chunk"]).select(*keys, F.inline(walk))


def moving_neighbours(tracks: DataFrame, k: int, cell: float) -> DataFrame:
    """Same-frame pairs where either end counts the other among its k nearest, with their distance."""
    from lapsegrid.plans.nearest import k_nearest

    at = tracks.select("stem", "frame_index", "identity", "y", "x")
    near = k_nearest(at, at, ["stem", "frame_index"], ["identity"], k, cell, F.col("t_identity") != F.col("identity"), ("t_identity",))
    return near.groupBy("stem", "frame_index", F.least("identity", "t_identity").alias("identity_a"), F.greatest("identity", "t_identity").alias("identity_b")).agg(F.min("distance").alias("distance"))
