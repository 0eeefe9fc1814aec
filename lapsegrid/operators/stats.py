"""Unit-level tests, permutation nulls, corrections and the evidence ladders built on them."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from lapsegrid.functions.numeric import normal_upper, ratio, safe_corr
from lapsegrid.plans.durable import cut
from lapsegrid.plans.heavy import has_heavy_key
from lapsegrid.plans.ranks import quantiles, value_positions, with_average_rank
from lapsegrid.plans.scan import hash_numbered, numbered, ordered_scan

ENTITY = ["stem", "identity"]


def two_sided(z: Column) -> Column:
    return F.least(2.0 * normal_upper(F.abs(z)), F.lit(1.0))


def chi_square_upper(x: Column, df: int) -> Column:
    """Upper tail of the chi-square distribution for a declared whole number of degrees of freedom."""
    half = x / 2.0
    if df % 2 == 0:
        term, total = F.lit(1.0), F.lit(1.0)
        for k in range(1, df // 2):
            term = term * half / float(k)
            total = total + term
        return F.exp(-half) * total
    total, term = F.lit(0.0), F.sqrt(x)
    for k in range(1, (df - 1) // 2 + 1):
        total = total + term
        term = term * x / float(2 * k + 1)
    return 2.0 * normal_upper(F.sqrt(x)) + F.lit(math.sqrt(2 / math.pi)) * F.exp(-half) * total


def _tie_sum(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    t = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).cast("double").alias("__k"))
    return t.groupBy(*keys).agg(F.sum(F.pow("__k", 3) - F.col("__k")).alias("ties3"), F.sum("__k").alias("total_n"))


def mann_whitney(units: DataFrame, family: Sequence[str], group: str, pair: tuple[str, str], value: str) -> DataFrame:
    """U of the first group with the tie-corrected normal p and the rank-biserial effect."""
    keys = list(family)
    rows = units.where(F.col(group).isin(*pair) & F.col(value).isNotNull())
    ranked = with_average_rank(rows, keys, value, "__r")
    a = F.col(group) == pair[0]
    s = ranked.groupBy(*keys).agg(
        F.sum(F.when(a, F.col("__r"))).alias("__ra"), F.sum(a.cast("long")).alias("n_a"), F.sum((~a).cast("long")).alias("n_b")
    ).join(_tie_sum(rows, keys, value), keys)
    na, nb, n = F.col("n_a"), F.col("n_b"), F.col("total_n")
    u = F.col("__ra") - na * (na + 1) / 2.0
    sigma2 = na * nb / 12.0 * ((n + 1) - F.try_divide(F.col("ties3"), n * (n - 1)))
    z = F.try_divide(F.greatest(F.abs(u - na * nb / 2.0) - 0.5, F.lit(0.0)), F.sqrt(sigma2))
    return s.select(
        *keys, "n_a", "n_b", u.alias("u_statistic"), F.when((na > 0) & (nb > 0) & (sigma2 > 0), two_sided(z)).alias("p_value"),
        (2.0 * F.try_divide(u, (na * nb).cast("double")) - 1).alias("effect"),
    )


def kruskal_wallis(units: DataFrame, family: Sequence[str], group: str, groups: int, value: str) -> DataFrame:
    """H over several groups, tie corrected, with the chi-square p and epsilon squared."""
    keys = list(family)
    rows = units.where(F.col(value).isNotNull())
    ranked = with_average_rank(rows, keys, value, "__r")
    per = ranked.groupBy(*keys, group).agg(F.sum("__r").alias("__s"), F.count(F.lit(1)).alias("__g"))
    s = per.groupBy(*keys).agg(F.sum(F.col("__s") * F.col("__s") / F.col("__g")).alias("__q"), F.count(F.lit(1)).alias("groups")).join(_tie_sum(rows, keys, value), keys)
    n = F.col("total_n")
    h = (12.0 / (n * (n + 1)) * F.col("__q") - 3 * (n + 1)) / (1 - F.col("ties3") / (F.pow(n, 3) - n))
    good = (F.col("groups") == groups) & (n > groups)
    return s.select(
        *keys, "groups", n.cast("long").alias("n"), F.when(good, h).alias("h_statistic"), F.when(good, chi_square_upper(h, groups - 1)).alias("p_value"),
        F.when(good, h / ((n * n - 1) / (n + 1))).alias("epsilon_squared"),
    )


def signed_rank(pairs: DataFrame, family: Sequence[str], difference: str) -> DataFrame:
    """Rank sum of positive differences against zero; zero differences are set aside."""
    keys = list(family)
    rows = pairs.where(F.col(difference).isNotNull() & (F.col(difference) != 0)).withColumn("__a", F.round(F.abs(difference), 12))
    ranked = with_average_rank(rows, keys, "__a", "__r")
    s = ranked.groupBy(*keys).agg(
        F.sum(F.when(F.col(difference) > 0, F.col("__r")).otherwise(0.0)).alias("w_plus"), F.count(F.lit(1)).alias("n")
    ).join(_tie_sum(rows, keys, "__a").drop("total_n"), keys)
    n = F.col("n")
    mean, var = n * (n + 1) / 4.0, n * (n + 1) * (2 * n + 1) / 24.0 - F.col("ties3") / 48.0
    z = (F.col("w_plus") - mean) / F.sqrt(var)
    return s.select(*keys, "n", "w_plus", F.when(var > 0, two_sided(z)).alias("p_value"), (2 * F.col("w_plus") / (n * (n + 1) / 2.0) - 1).alias("effect"))


def welch(units: DataFrame, family: Sequence[str], group: str, pair: tuple[str, str], value: str) -> DataFrame:
    """Welch's t with its degrees of freedom, and Hedges' g."""
    keys = list(family)
    a, b = F.col(group) == pair[0], F.col(group) == pair[1]
    s = units.groupBy(*keys).agg(
        *[f(F.when(c, F.col(value))).alias(f"{p}{n}") for c, n in ((a, "a"), (b, "b")) for p, f in (("n_", F.count), ("mean_", F.avg), ("__v", F.var_samp))]
    )
    na, nb, va, vb = F.col("n_a"), F.col("n_b"), F.col("__va"), F.col("__vb")
    diff, ea, eb = F.col("mean_a") - F.col("mean_b"), va / na, vb / nb
    pooled = F.sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2))
    ok = (na > 1) & (nb > 1)
    return s.select(
        *keys, "n_a", "n_b", "mean_a", "mean_b", diff.alias("difference"), F.when(ok, F.try_divide(diff, F.sqrt(ea + eb))).alias("t_statistic"),
        F.when(ok, F.try_divide(F.pow(ea + eb, 2), ea * ea / (na - 1) + eb * eb / (nb - 1))).alias("degrees_of_freedom"),
        F.when(ok, F.try_divide(diff, pooled) * (1 - 3.0 / (4 * (na + nb) - 9))).alias("hedges_g"),
    )


def anova(units: DataFrame, family: Sequence[str], group: str, value: str) -> DataFrame:
    """One-way F and eta squared from group sums."""
    keys = list(family)
    g = units.where(F.col(value).isNotNull()).groupBy(*keys, group).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.var_pop(value).alias("v"))
    s = g.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("groups"), F.sum(F.col("n") * F.col("v")).alias("within"),
        F.sum(F.col("n") * F.col("m")).alias("__nm"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("__nmm"),
    )
    between = F.col("__nmm") - F.col("__nm") * F.col("__nm") / F.col("n")
    return s.select(
        *keys, "n", "groups",
        F.try_divide(between / F.greatest(F.col("groups") - 1, F.lit(1)), F.try_divide(F.col("within"), (F.col("n") - F.col("groups")).cast("double"))).alias("f_statistic"),
        F.try_divide(between, between + F.col("within")).alias("eta_squared"),
    )


def paired_t(pairs: DataFrame, family: Sequence[str], difference: str) -> DataFrame:
    s = pairs.groupBy(*family).agg(F.count(difference).alias("n"), F.avg(difference).alias("mean_difference"), F.stddev_samp(difference).alias("sd"))
    return s.withColumn("t_statistic", F.try_divide(F.col("mean_difference"), F.col("sd") / F.sqrt("n"))).withColumn("effect", F.try_divide(F.col("mean_difference"), F.col("sd")))


def permuted_difference(units: DataFrame, family: Sequence[str], group: str, pair: tuple[str, str], unit: str, value: str, replicates: int, seed: int) -> DataFrame:
    """Difference of group means against relabelled units: two-sided, plus one. Labels are dealt in md5 order."""
    keys = list(family)
    rows = units.where(F.col(group).isin(*pair) & F.col(value).isNotNull()).select(*keys, group, unit, value)
    a = F.col(group) == pair[0]
    seen = rows.groupBy(*keys).agg(
        F.sum(a.cast("long")).alias("n_a"), F.count(F.lit(1)).alias("n"), (F.avg(F.when(a, F.col(value))) - F.avg(F.when(~a, F.col(value)))).alias("observed")
    )
    rk = [*keys, "replicate"]
    reps = rows.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    dealt = hash_numbered(reps, rk, F.concat_ws("|", F.lit(str(seed)), "replicate", *keys, unit), "position", [unit]).join(seen, keys)
    first = F.col("position") <= F.col("n_a")
    null = dealt.groupBy(*rk).agg(
        (F.avg(F.when(first, F.col(value))) - F.avg(F.when(~first, F.col(value)))).alias("d"), F.max("observed").alias("observed")
    ).where(F.col("d").isNotNull() & F.col("observed").isNotNull())
    return null.groupBy(*keys).agg(
        F.max("observed").alias("observed"), F.avg("d").alias("null_mean"), F.count(F.lit(1)).alias("replicates"),
        ratio(F.sum((F.round(F.abs("d"), 9) >= F.round(F.abs("observed"), 9)).cast("long")) + 1, F.count(F.lit(1)) + 1).alias("p_value"),
    )


def sign_flipped(pairs: DataFrame, family: Sequence[str], unit: str, difference: str, replicates: int, seed: int) -> DataFrame:
    """Mean difference against sign flips drawn by digest: two-sided, plus one."""
    from lapsegrid.operators.learn import unit_draw

    keys = list(family)
    rows = pairs.where(F.col(difference).isNotNull()).select(*keys, unit, F.col(difference).alias("d"))
    seen = rows.groupBy(*keys).agg(F.avg("d").alias("observed"))
    reps = rows.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    up = unit_draw(F.concat_ws("|", F.lit(str(seed)), "replicate", *keys, unit)) < 0.5
    null = reps.groupBy(*keys, "replicate").agg(F.avg(F.when(up, F.col("d")).otherwise(-F.col("d"))).alias("m")).join(seen, keys)
    return null.groupBy(*keys).agg(ratio(F.sum((F.round(F.abs("m"), 9) >= F.round(F.abs("observed"), 9)).cast("long")) + 1, F.count(F.lit(1)) + 1).alias("p_value"))


def permuted_f(units: DataFrame, family: Sequence[str], group: str, unit: str, value: str, replicates: int, seed: int) -> DataFrame:
    """One-way F against relabelled units: group sizes kept, labels dealt in md5 order, plus one."""
    keys = list(family)
    rows = units.where(F.col(value).isNotNull()).select(*keys, group, unit, value)
    seen = anova(rows, keys, group, value).select(*keys, F.col("f_statistic").alias("observed"))
    sizes = rows.groupBy(*keys, group).agg(F.count(F.lit(1)).alias("__n"))
    # one row per declared group
    upto = F.sum("__n").over(Window.partitionBy(*keys).orderBy(group))
    bounds = sizes.withColumn("__upto", upto).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("__upto", group))).alias("__b"))
    reps = rows.drop(group).withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    dealt = hash_numbered(reps, [*keys, "replicate"], F.concat_ws("|", F.lit(str(seed)), "replicate", *keys, unit), "position", [unit]).join(bounds, keys)
    label = F.get(F.filter("__b", lambda e: e["__upto"] >= F.col("position")), F.lit(0))[group]
    null = anova(dealt.withColumn(group, label), [*keys, "replicate"], group, value).join(seen, keys)
    return null.groupBy(*keys).agg(ratio(F.sum((F.round("f_statistic", 9) >= F.round("observed", 9)).cast("long")) + 1, F.count(F.lit(1)) + 1).alias("p_value"))


def corrected(tests: DataFrame, family: Sequence[str], p: str, two_level: bool | None = None) -> DataFrame:
    """All four corrections in a family. A test without a p keeps its slot as 1, and stays NULL in the result.

    Small families are ranked by windows on the rows themselves. A large one is written once first: its ranks
    are joined back on p, and a p computed twice may differ in its last bit.
    """
    keys = list(family)
    slotted = tests.withColumn("__p", F.coalesce(F.col(p), F.lit(1.0)))
    if has_heavy_key(tests, keys) if two_level is None else two_level:
        slotted = cut(slotted)
        pos = value_positions(slotted, keys, "__p").withColumn("__raw", F.col("__p") * F.col("total") / (F.col("before") + F.col("ties")))
        slot = F.floor(F.col("__p") * 4096).cast("long")
        q = ordered_scan(pos, keys, ["__p"], slot, remaining={"__q": ("min", "__raw")}, two_level=True)
        ranked = slotted.join(q.select(*keys, "__p", "__q", F.col("total").alias("family_size")), [*keys, "__p"])
    else:
        w = Window.partitionBy(*keys)
        sized = slotted.withColumn("family_size", F.count(F.lit(1)).over(w)).withColumn(
            "__raw", F.col("__p") * F.col("family_size") / F.count(F.lit(1)).over(w.orderBy("__p"))
        )
        ranked = sized.withColumn("__q", F.min("__raw").over(w.orderBy(F.col("__p").desc()))).drop("__raw")
    known, m = F.col(p).isNotNull(), F.col("family_size")
    return ranked.withColumn("q_bh", F.when(known, F.least("__q", F.lit(1.0)))).withColumn(
        "p_bonferroni", F.when(known, F.least(F.col(p) * m, F.lit(1.0)))
    ).withColumn("p_sidak", F.when(known, 1 - F.pow(1 - F.col(p), m))).drop("__p", "__q")


def bootstrap_band(aligned: DataFrame, value: str, group: Sequence[str], event: Sequence[str], replicates: int, seed: int) -> DataFrame:
    """Mean curve with a 95 % band from resampled events. A replicate draws as many events as there are, by
    digest, and keeps only how often each was drawn, so no event's rows are copied."""
    keys = list(group)
    events = aligned.select(*keys, *event).distinct()
    ordered = hash_numbered(events, keys, F.concat_ws("|", *event), "position", list(event))
    n = ordered.groupBy(*keys).agg(F.max("position").alias("n"))
    draws = ordered.join(n, keys).withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    text = F.md5(F.concat_ws("|", F.lit(str(seed)), "replicate", "position"))
    picks = draws.withColumn("position", F.conv(F.substring(text, 1, 12), 16, 10).cast("long") % F.col("n") + 1).groupBy(*keys, "replicate", "position").agg(
        F.count(F.lit(1)).alias("w")
    )
    weighted = picks.join(ordered, [*keys, "position"]).join(aligned, [*keys, *event])
    curve = weighted.where(F.col(value).isNotNull()).groupBy(*keys, "replicate", "offset").agg(ratio(F.sum(F.col("w") * F.col(value)), F.sum("w")).alias("m"))
    band = quantiles(curve, [*keys, "offset"], "m", {"low": 0.025, "high": 0.975}, two_level=False).drop("total")
    mean = aligned.groupBy(*keys, "offset").agg(F.avg(value).alias("mean"), F.count(value).alias("events"))
    return mean.join(band, [*keys, "offset"], "left")


def coverage_order_test(masks: DataFrame, replicates: int, seed: int) -> DataFrame:
    """Area under the coverage curve of each entity against the same frames in shuffled order."""
    masks = cut(masks.select(*ENTITY, "frame_index", "y", "x").where("stem IS NOT NULL AND identity IS NOT NULL AND frame_index IS NOT NULL"))
    own = masks.select(*ENTITY, "frame_index").distinct()
    big = has_heavy_key(own, ENTITY)
    frames = own.repartition(*ENTITY).withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates))))
    rk = [*ENTITY, "replicate"]
    text = F.concat_ws("|", F.lit(str(seed)), "replicate", *ENTITY, "frame_index")
    # the order as it was sorts by nothing but the frame
    dealt = numbered(frames.withColumn("__md5", F.when(F.col("replicate") > 0, F.md5(text)).otherwise("")), rk, ["__md5", "frame_index"], F.lit(0), "slot", two_level=big)
    order = dealt.groupBy(*ENTITY, "frame_index").agg(F.sort_array(F.collect_list(F.struct("replicate", "slot")))["slot"].alias("slots"))
    # a frame carries its slot in every order, so a place of a mask is shuffled once whatever the number of orders;
    # a place first covered in slot s counts in every slot from s on
    placed = masks.join(order, [*ENTITY, "frame_index"])
    first = placed.groupBy(*ENTITY, "y", "x").agg(F.array(*[F.min(F.col("slots")[r]) for r in range(replicates + 1)]).alias("s"))
    area = first.select(*ENTITY, F.posexplode("s").alias("replicate", "s")).groupBy(*rk).agg(F.sum("s").alias("__s"), F.count(F.lit(1)).alias("__u"))
    n = own.groupBy(*ENTITY).agg(F.count(F.lit(1)).alias("n"))
    auc = area.join(n, ENTITY).select(*rk, ratio((F.col("n") + 1) * F.col("__u") - F.col("__s"), F.col("n") * F.col("__u")).alias("auc"))
    seen = auc.where(F.col("replicate") == 0).select(*ENTITY, F.col("auc").alias("observed"))
    null = auc.where(F.col("replicate") > 0).join(seen, ENTITY)
    centre = null.groupBy(*ENTITY).agg(F.avg("auc").alias("null_mean"))
    away = lambda c: F.round(F.abs(F.col(c) - F.col("null_mean")), 12)
    return null.join(centre, ENTITY).groupBy(*ENTITY).agg(
        F.max("observed").alias("observed"), F.max("null_mean").alias("null_mean"),
        ratio(F.sum((away("auc") >= away("observed")).cast("long")) + 1, F.count(F.lit(1)) + 1).alias("p_value"),
    )


def transition_null_band(moves: DataFrame, keys: Sequence[str], replicates: int, seed: int) -> DataFrame:
    """Each observed transition count against successors dealt anew among a group's moves."""
    keys = list(keys)
    rk = [*keys, "replicate"]
    observed = moves.groupBy(*keys, "from_regime", "to_regime").agg(F.count(F.lit(1)).alias("n"))
    reps = moves.select(*keys, "identity", "from_frame_index", "from_regime", "to_regime").withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    place = numbered(reps, rk, ["from_frame_index", "identity"], F.col("from_frame_index").cast("long"), "position")
    text = F.concat_ws("|", F.lit(str(seed)), "replicate", *keys, "identity", "from_frame_index")
    dealt = hash_numbered(reps, rk, text, "position", ["from_frame_index", "identity"]).select(*rk, "position", F.col("to_regime").alias("dealt"))
    counted = place.join(dealt, [*rk, "position"]).groupBy(*rk, "from_regime", F.col("dealt").alias("to_regime")).agg(F.count(F.lit(1)).alias("k"))
    every = observed.select(*keys, "from_regime", "to_regime").withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    full = every.join(counted, [*rk, "from_regime", "to_regime"], "left").withColumn("k", F.coalesce("k", F.lit(0).cast("long")).cast("double"))
    band = quantiles(full, [*keys, "from_regime", "to_regime"], "k", {"null_low": 0.025, "null_mid": 0.5, "null_high": 0.975}, two_level=False).drop("total")
    return observed.join(band, [*keys, "from_regime", "to_regime"])


# --- associations ----------------------------------------------------------------------------------------


def association(values: DataFrame, keys: Sequence[str], a: str, b: str, minimum: int) -> DataFrame:
    """Pearson and Spearman of matched values with support and a status."""
    keys = list(keys)
    good = values.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    big = has_heavy_key(good, keys)
    ranked = with_average_rank(with_average_rank(good, keys, a, "__ra", two_level=big), keys, b, "__rb", two_level=big)
    s = ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), safe_corr(F.col(a), F.col(b)).alias("__p"), safe_corr("__ra", "__rb").alias("__s"))
    enough = F.col("n") >= minimum
    return s.select(
        *keys, "n", F.when(enough, F.col("__p")).alias("pearson"), F.when(enough, F.col("__s")).alias("spearman"),
        F.when(~enough, "insufficient").when(F.col("__p").isNull(), "constant").otherwise("estimated").alias("status"),
    )


def direction_counts(estimates: DataFrame, keys: Sequence[str], value: str, low: str, high: str) -> DataFrame:
    """Signs of estimates in a group, and the stretch all their intervals share, if signs agree."""
    v = F.col(value)
    s = estimates.groupBy(*keys).agg(
        F.sum((v > 0).cast("long")).alias("positive"), F.sum((v < 0).cast("long")).alias("negative"), F.sum((v == 0).cast("long")).alias("zero"),
        F.count(F.lit(1)).alias("estimates"), F.max(low).alias("__lo"), F.min(high).alias("__hi"),
    )
    agree = (F.col("positive") == F.col("estimates")) | (F.col("negative") == F.col("estimates"))
    shared = agree & (F.col("__lo") <= F.col("__hi"))
    return s.withColumn("direction", F.when(F.col("positive") == F.col("estimates"), "positive").when(F.col("negative") == F.col("estimates"), "negative")
                        .when(F.col("zero") == F.col("estimates"), "zero").otherwise("mixed")).withColumn(
        "shared_low", F.when(shared, F.col("__lo"))).withColumn("shared_high", F.when(shared, F.col("__hi"))).drop("__lo", "__hi")


def contact_similarity(pairs: DataFrame, contact: str, value: str, replicates: int, seed: int) -> DataFrame:
    """Mean absolute difference of touching pairs minus that of the rest, against contact labels dealt anew."""
    rows = pairs.where(F.col(value).isNotNull()).withColumn("__c", F.when(F.col(contact), "contact").otherwise("apart"))
    keyed = rows.withColumn("__id", F.concat_ws("-", "identity_a", "identity_b"))
    return permuted_difference(keyed, ["stem"], "__c", ("contact", "apart"), "__id", value, replicates, seed)


# --- windows around an anchor ------------------------------------------------------------------------------


def anchored_windows(observations: DataFrame, metrics: Sequence[str], anchor: float, windows: Sequence[tuple[str, float, float]], hours_per_frame: float, first: float, last: float) -> DataFrame:
    """Every entity, metric and window around an anchor, with summaries, valid share, observed-interval and
    recording coverage, and truncation by the recording's ends; windows without data are kept."""
    declared = F.array(*[F.struct(F.lit(n).alias("window"), F.lit(anchor + a).alias("w0"), F.lit(anchor + b).alias("w1")) for n, a, b in windows])
    entities = observations.select(*ENTITY).distinct().select("*", F.inline(declared))
    every = entities.withColumn("metric", F.explode(F.array(*[F.lit(m) for m in metrics])))
    long = observations.select(*ENTITY, "hours", *metrics).unpivot([*ENTITY, "hours"], list(metrics), "metric", "value")
    inside = long.select("*", F.inline(declared)).where((F.col("hours") >= F.col("w0")) & (F.col("hours") < F.col("w1")))
    keys = [*ENTITY, "window", "metric"]
    held = ordered_scan(inside, keys, ["hours"], F.floor(F.col("hours") / 4096).cast("long"), lag={"__ph": "hours"})
    step = F.when(F.col("hours") - F.col("__ph") <= 1.5 * hours_per_frame, F.col("hours") - F.col("__ph"))
    stats = held.groupBy(*keys).agg(
        F.count("value").alias("observations"), F.avg("value").alias("mean"), F.min("value").alias("minimum"), F.max("value").alias("maximum"),
        F.min("hours").alias("first_hour"), F.max("hours").alias("last_hour"), F.coalesce(F.sum(step), F.lit(0.0)).alias("covered_hours"),
    )
    med = quantiles(inside, keys, "value", {"median": 0.5}).drop("total")
    length = F.col("w1") - F.col("w0")
    rec = F.greatest(F.least(F.col("w1"), F.lit(last)) - F.greatest(F.col("w0"), F.lit(first)), F.lit(0.0))
    return (
        every.join(stats, keys, "left").join(med, keys, "left")
        .withColumn("observations", F.coalesce("observations", F.lit(0).cast("long")))
        .withColumn("valid_fraction", F.col("observations") / F.greatest(F.round(length / hours_per_frame), F.lit(1.0)))
        .withColumn("interval_coverage", F.coalesce(F.col("covered_hours"), F.lit(0.0)) / length)
        .withColumn("recording_coverage", rec / length)
        .withColumn("truncated", (F.col("w0") < first) | (F.col("w1") > last))
        .withColumn("first_from_anchor", F.col("first_hour") - anchor).withColumn("last_from_anchor", F.col("last_hour") - anchor)
        .drop("w0", "w1", "covered_hours")
    )


def assess_windows(windows: DataFrame, minimum: int, valid: float, coverage: float) -> DataFrame:
    reasons = F.concat_ws(
        "; ", F.when(F.col("observations") < minimum, F.lit("too few observations")), F.when(F.col("valid_fraction") < valid, F.lit("too little valid")),
        F.when(F.col("interval_coverage") < coverage, F.lit("too little covered")), F.when(F.col("truncated"), F.lit("truncated by the recording")),
    )
    return windows.withColumn("reasons", reasons).withColumn("eligible", F.col("reasons") == "")


def within_changes(assessed: DataFrame, baseline: str, near_zero: float, threshold: float) -> DataFrame:
    """Each window's mean against the entity's baseline window: absolute and guarded relative change with the
    named reason where the relative one is refused, and the meaningful-size outcome."""
    keys = [*ENTITY, "metric"]
    base = assessed.where(F.col("window") == baseline).select(*keys, F.col("mean").alias("baseline"), F.col("eligible").alias("__be"))
    rows = assessed.where(F.col("window") != baseline).join(base, keys)
    refused = F.when(F.col("baseline").isNull(), "missing_baseline").when(F.abs("baseline") < near_zero, "near_zero_baseline").when(F.col("baseline") <= 0, "nonpositive_baseline")
    change = F.col("mean") - F.col("baseline")
    relative = F.when(refused.isNull(), F.try_divide(change, F.col("baseline")))
    ok = F.col("eligible") & F.col("__be") & relative.isNotNull()
    outcome = (
        F.when(~F.coalesce(ok, F.lit(False)), "inconclusive").when(relative >= threshold, "increase").when(relative <= -threshold, "decrease")
        .when(change != 0, "below_threshold").otherwise("no_change")
    )
    return rows.select(*keys, "window", "mean", "baseline", change.alias("change"), relative.alias("relative_change"), refused.alias("relative_refused"), outcome.alias("outcome"))


def change_evidence(
    observations: DataFrame, assessed: DataFrame, metrics: dict[str, float], anchor: float, windows: Sequence[tuple[str, float, float]], baseline: str, alpha: float
) -> DataFrame:
    """A test behind each entity's change from its baseline window to another: estimate with a pointwise interval, rank-sum p, q within the
    measurement's family, and what may be said.

    ``metrics`` names measurements with their meaningful size, in their own unit. Only comparisons whose windows are both eligible are
    tested; the others keep their slot in the family. An outcome is increase or decrease (supported and of meaningful size),
    detected_below_meaningful_threshold, no_detected_change, or inconclusive (not tested). No detected change is not shown absence.
    """
    keys = [*ENTITY, "metric", "window"]
    others = [n for n, _, _ in windows if n != baseline]
    declared = F.array(*[F.struct(F.lit(n).alias("at"), F.lit(anchor + a).alias("w0"), F.lit(anchor + b).alias("w1")) for n, a, b in windows])
    long = observations.select(*ENTITY, "hours", *metrics).unpivot([*ENTITY, "hours"], list(metrics), "metric", "value").where(F.col("value").isNotNull())
    inside = long.select("*", F.inline(declared)).where((F.col("hours") >= F.col("w0")) & (F.col("hours") < F.col("w1")))
    # the baseline meets each other window: a declared, short list
    met = F.when(F.col("at") == baseline, F.array(*[F.lit(o) for o in others])).otherwise(F.array("at"))
    rows = cut(inside.select(*ENTITY, "metric", F.explode(met).alias("window"), F.when(F.col("at") == baseline, "baseline").otherwise("target").alias("side"), "value"))
    side = lambda f, s: f(F.when(F.col("side") == s, F.col("value")))
    sums = rows.groupBy(*keys).agg(*[side(f, s).alias(f"{n}_{s}") for s in ("target", "baseline") for n, f in (("n", F.count), ("mean", F.avg), ("var", F.var_samp))])
    ranks = mann_whitney(rows, keys, "side", ("target", "baseline"), "value").select(*keys, F.col("p_value").alias("__p"), "effect")
    base = assessed.where(F.col("window") == baseline).select(*ENTITY, "metric", F.col("eligible").alias("__be"))
    asked = assessed.where(F.col("window").isin(others)).join(base, [*ENTITY, "metric"]).select(*keys, (F.col("eligible") & F.col("__be")).alias("eligible"))
    joined = asked.join(sums, keys, "left").join(ranks, keys, "left")
    spread = F.sqrt(F.col("var_target") / F.col("n_target") + F.col("var_baseline") / F.col("n_baseline")) * 1.959963984540054
    estimate = F.when(F.col("eligible"), F.col("mean_target") - F.col("mean_baseline"))
    tested = joined.select(
        *keys, "eligible", F.coalesce("n_baseline", F.lit(0).cast("long")).alias("baseline_observations"), F.coalesce("n_target", F.lit(0).cast("long")).alias("target_observations"),
        estimate.alias("estimate"), (estimate - spread).alias("interval_low"), (estimate + spread).alias("interval_high"),
        F.when(F.col("eligible"), F.col("effect")).alias("effect"), F.when(F.col("eligible"), F.col("__p")).alias("p_value"),
    )
    judged = corrected(tested, ["metric"], "p_value").withColumnRenamed("q_bh", "q_value").withColumnRenamed("family_size", "family_requested").drop("p_bonferroni", "p_sidak")
    size = F.lit(None).cast("double")
    for name, least in metrics.items():
        size = F.when(F.col("metric") == name, F.lit(float(least))).otherwise(size)
    supported, large = F.coalesce(F.col("q_value") <= alpha, F.lit(False)), F.coalesce(F.abs("estimate") >= size, F.lit(False)) & (F.col("estimate") != 0)
    outcome = (
        F.when(supported & large, F.when(F.col("estimate") > 0, "increase").otherwise("decrease")).when(supported, "detected_below_meaningful_threshold")
        .when(F.col("p_value").isNotNull(), "no_detected_change").otherwise("inconclusive")
    )
    return judged.withColumn("outcome", outcome).withColumn("meaningful_size", size)


def evidence_decision(evidence: DataFrame) -> DataFrame:
    """Per entity: responding if any comparison supports a response, else whether anything was tested at all."""
    moved = F.count_if(F.col("outcome").isin("increase", "decrease"))
    tested = F.count("p_value")
    return evidence.groupBy(*ENTITY).agg(
        F.count(F.lit(1)).alias("requested_comparisons"), tested.alias("tested_comparisons"), moved.alias("responding_comparisons"),
        F.when(moved > 0, "responding").when(tested > 0, "no_detected_response").otherwise("inconclusive").alias("decision"),
    )


def entity_decision(outcomes: DataFrame) -> DataFrame:
    """One verdict per entity over its windows and metrics."""
    has = lambda o: F.max((F.col("outcome") == o).cast("int")) == 1
    return outcomes.groupBy(*ENTITY).agg(
        F.when(has("increase") & has("decrease"), "mixed").when(has("increase"), "increase").when(has("decrease"), "decrease")
        .when(has("below_threshold") | has("no_change"), "no_detected_change").otherwise("inconclusive").alias("decision"),
        F.count(F.lit(1)).alias("tests"),
    )


def sliding_pair_windows(matched: DataFrame, keys: Sequence[str], time: str, width: float, step: float, minimum: int) -> DataFrame:
    """Overlapping windows per pair: mean, least and greatest distance beside the correlation of two signals."""
    t = F.col(time)
    first = F.greatest(F.ceil((t - width + 1e-9) / step), F.lit(0)).cast("long")
    spread = matched.withColumn("window", F.explode(F.sequence(first, F.greatest(first, F.floor(t / step).cast("long"))))).where(
        (t >= F.col("window") * step) & (t < F.col("window") * step + width)
    )
    return spread.groupBy(*keys, "window").agg(
        F.count(F.lit(1)).alias("n"), F.avg("distance").alias("mean_distance"), F.min("distance").alias("min_distance"), F.max("distance").alias("max_distance"),
        F.when(F.count(F.lit(1)) >= minimum, safe_corr("va", "vb")).alias("coordination"),
    ).withColumn("status", F.when(F.col("n") < minimum, "insufficient").when(F.col("coordination").isNull(), "constant").otherwise("estimated"))


# --- scoring ---------------------------------------------------------------------------------------------


def score_cases(cases: DataFrame, predictions: DataFrame, tolerance: float) -> DataFrame:
    """Every case with what was said about it: detected, recovered within tolerance, a half or double of the
    truth, missed, or a false alarm. Cases without a prediction stay."""
    rows = cases.join(predictions, "case_id", "left")
    t, p = F.col("true_period"), F.col("period")
    near = lambda x: F.abs(p - x) <= tolerance * x
    found = F.coalesce(F.col("detected"), F.lit(False))
    label = (
        F.when(F.col("detected").isNull(), "unavailable").when(t.isNull() & found, "false_alarm").when(t.isNull(), "true_negative").when(~found, "missed")
        .when(near(t), "recovered").when(near(t / 2) | near(t * 2), "alias").otherwise("wrong_period")
    )
    return rows.withColumn("score", label)


def weighted_rate(scored: DataFrame, keys: Sequence[str], hit: Column, block: str) -> DataFrame:
    """Rate with equal weight per block of related cases; failures stay in the denominator."""
    per = scored.groupBy(*keys, block).agg(F.avg(F.coalesce(hit, F.lit(False)).cast("double")).alias("r"), F.count(F.lit(1)).alias("n"))
    return per.groupBy(*keys).agg(F.avg("r").alias("rate"), F.count(F.lit(1)).alias("blocks"), F.sum("n").alias("cases"))


def select_recipes(summary: DataFrame, support: float, coverage: float, false_alarm: float, minimum: int) -> DataFrame:
    """Gates per recipe, then those not dominated: no admissible recipe is at least as good on recovery and
    false alarms and better on one. Dominance needs only the best recovery at or under a false-alarm rate,
    so it is one ordered scan and no self-join."""

    def gate(value: str, bound: float, least: bool) -> Column:
        good = F.col(value) >= bound if least else F.col(value) <= bound
        return F.when(F.col("cases") < minimum, "insufficient").when(good, "pass").otherwise("fail")

    gated = summary.withColumn("support_gate", gate("support", support, True)).withColumn("coverage_gate", gate("coverage", coverage, True)).withColumn(
        "false_alarm_gate", gate("false_alarm", false_alarm, False)
    )
    ok = (F.col("support_gate") == "pass") & (F.col("coverage_gate") == "pass") & (F.col("false_alarm_gate") == "pass")
    admissible = gated.withColumn("admissible", ok)
    # the recipes of a scope are a declared, short list
    w = Window.partitionBy("scope")
    value = F.when(F.col("admissible"), F.col("recovery"))
    placed = admissible.withColumn("__step", F.dense_rank().over(w.orderBy("false_alarm")))
    marked = placed.withColumn("__top", F.max(value).over(Window.partitionBy("scope", "__step"))).withColumn(
        "__before", F.max(value).over(w.orderBy("__step").rangeBetween(Window.unboundedPreceding, -1))
    ).drop("__step")
    kept = F.col("admissible") & (F.col("recovery") == F.col("__top")) & (F.col("__before").isNull() | (F.col("recovery") > F.col("__before")))
    chosen = marked.withColumn("undominated", F.coalesce(kept, F.lit(False))).drop("__top", "__before")
    n = chosen.groupBy("scope").agg(F.sum(F.col("undominated").cast("long")).alias("__k"), F.max((F.col("support_gate") == "insufficient").cast("int")).alias("__i"))
    outcome = F.when(F.col("__k") == 1, "provisional_choice").when(F.col("__k") > 1, "tie").when(F.col("__i") == 1, "insufficient").otherwise("none_acceptable")
    return chosen.join(n, "scope").withColumn("outcome", outcome).drop("__k", "__i")
