"""Grouped splits, balanced samples and state models on tables."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from lapsegrid.functions.numeric import ratio
from lapsegrid.plans.durable import cut
from lapsegrid.plans.scan import hash_numbered


def unit_draw(text: Column) -> Column:
    """Uniform number in (0, 1) from a digest, the same wherever it is computed."""
    return (F.conv(F.substring(F.md5(text.cast("string")), 1, 12), 16, 10).cast("double") + 0.5) / F.lit(float(16**12))


def group_split(rows: DataFrame, group: str, fractions: Sequence[tuple[str, float]], seed: int) -> DataFrame:
    """Whole groups dealt to named sets by md5 order; no group is in two sets."""
    groups = rows.select(group).distinct().withColumn("__all", F.lit(0))
    ordered = hash_numbered(groups, ["__all"], F.concat_ws("|", F.lit(str(seed)), group), "position", [group])
    n = groups.groupBy("__all").agg(F.count(F.lit(1)).alias("__n"))
    at = (F.col("position") - 0.5) / F.col("__n")
    bounds, upto = [], 0.0
    for name, share in fractions:
        upto += share
        bounds.append((name, upto))
    label = F.lit(bounds[-1][0])
    for name, bound in reversed(bounds[:-1]):
        label = F.when(at <= bound, name).otherwise(label)
    return ordered.join(n, "__all").select(group, label.alias("role"))


def role_status(assigned: DataFrame, minimum: int) -> DataFrame:
    return assigned.groupBy("role").agg(F.count(F.lit(1)).alias("groups")).withColumn("status", F.when(F.col("groups") >= minimum, "ready").otherwise("too_few"))


def balanced_sample(rows: DataFrame, group: str, entity: Sequence[str], row_id: Sequence[str], n: int, seed: int) -> DataFrame:
    """``n`` rows drawn without replacement with equal weight per group, entity and row. Sampling is the
    operator's purpose; the top-n is taken in two stages, so nothing is sorted as a whole."""
    per_entity = rows.groupBy(group, *entity).agg(F.count(F.lit(1)).alias("__r"))
    per_group = per_entity.groupBy(group).agg(F.count(F.lit(1)).alias("__e"))
    weighted = rows.join(per_entity, [group, *entity]).join(per_group, group)
    w = 1.0 / (F.col("__r") * F.col("__e"))
    key = -F.ln(unit_draw(F.concat_ws("|", F.lit(str(seed)), *row_id))) / w
    return weighted.withColumn("draw_key", key).drop("__r", "__e").orderBy("draw_key", *row_id).limit(n)


def capped_membership(rows: DataFrame, group: str, entity: Sequence[str], row_id: Sequence[str], per_entity: int, per_group: int, seed: int) -> DataFrame:
    """Learning rows: at most so many per entity, then dealt round-robin to an equal budget per group. Both
    caps are the operator's declared budgets, and both rank filters are pushed below the shuffle."""
    hashed = rows.withColumn("__h", F.md5(F.concat_ws("|", F.lit(str(seed)), *row_id)))
    we = Window.partitionBy(group, *entity).orderBy("__h", *row_id)
    capped = hashed.withColumn("turn", F.row_number().over(we)).where(F.col("turn") <= per_entity)
    # one number: the smallest group's share, so that every group gives equally many rows
    budget = capped.groupBy(group).agg(F.count(F.lit(1)).alias("__n")).agg(F.min(F.least(F.col("__n"), F.lit(per_group)))).first()[0]
    wg = Window.partitionBy(group).orderBy("turn", "__h", *row_id)
    taken = capped.withColumn("place", F.row_number().over(wg)).where(F.col("place") <= per_group)
    return taken.withColumn("budget", F.lit(budget).cast("long")).where(F.col("place") <= F.col("budget")).drop("__h")


#: Differences that one step of an assignment holds.
SCORES = 4_000_000


def nearest_centre(vectors: DataFrame, row: str, vector: str, centres: DataFrame, outlier: float, block: int = 1024) -> DataFrame:
    """Frozen assignment: nearest centre, distance, margin to the runner-up, and a status.

    ``centres`` has ``state`` and ``centre``, any number of them. Rows meet centres in blocks of either side; a
    block returns a row's two nearest, and the two nearest of all blocks remain.
    """
    sides = {"r": vectors.count(), "c": centres.count()}
    blocks = {k: max(1, -(-n // block)) for k, n in sides.items()}
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(blocks[k] - 1)))
    mine = vectors.select(F.col(row).alias("row"), F.col(vector).alias("v"), F.pmod(F.xxhash64(row), F.lit(blocks["r"])).cast("int").alias("rb"), every("c").alias("cb"))
    theirs = centres.select("state", F.col("centre").alias("v"), F.pmod(F.xxhash64("state"), F.lit(blocks["c"])).cast("int").alias("cb"), every("r").alias("rb"))
    kind, state = dict(mine.dtypes)["row"], dict(theirs.dtypes)["state"]

    def near(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"row": [], "distance": [], "state": []})
        right = right.sort_values("state")  # of equally far centres the smaller name comes first
        x, c, names = np.array(left["v"].tolist(), float), np.array(right["v"].tolist(), float), right["state"].to_numpy()
        step = max(1, SCORES // c.size)
        best, far = [], []
        for at in range(0, len(x), step):
            d = np.round(np.sqrt(((x[at : at + step, None, :] - c[None, :, :]) ** 2).sum(axis=2)), 9)
            two = np.argsort(d, axis=1, kind="stable")[:, :2]
            best.append(two)
            far.append(np.take_along_axis(d, two, axis=1))
        two, d = np.concatenate(best), np.concatenate(far)
        return pd.DataFrame({"row": np.repeat(left["row"].to_numpy(), two.shape[1]), "distance": d.ravel(), "state": names[two.ravel()]})

    pairs = mine.groupBy("rb", "cb").cogroup(theirs.groupBy("rb", "cb")).applyInPandas(near, f"row {kind}, distance double, state {state}")
    best = pairs.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("distance", "state"))).alias("o"))  # two per block of centres
    first, second = F.col("o")[0], F.get("o", F.lit(1))
    margin = second["distance"] - first["distance"]
    return best.select(
        F.col("row").alias(row), first["state"].alias("state"), first["distance"].alias("distance"), margin.alias("margin"),
        F.when(first["distance"] > outlier, "outlier").when(margin < 0.02, "uncertain").otherwise("assigned").alias("status"),
    )


def adjusted_rand(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Adjusted Rand index of two labellings of the same rows, from their contingency table."""
    cell = pairs.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    two = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2.0)
    one = F.lit(0).alias("__k")
    s = cell.groupBy(one).agg(two("n").alias("both"), F.sum("n").alias("total"))
    left = cell.groupBy(a).agg(F.sum("n").alias("n")).groupBy(one).agg(two("n").alias("sa"))
    right = cell.groupBy(b).agg(F.sum("n").alias("n")).groupBy(one).agg(two("n").alias("sb"))
    j = s.join(left, "__k").join(right, "__k")  # three single rows
    expected = F.col("sa") * F.col("sb") / (F.col("total") * (F.col("total") - 1) / 2.0)
    return j.select(F.col("total").alias("rows"), ratio(F.col("both") - expected, (F.col("sa") + F.col("sb")) / 2 - expected).alias("adjusted_rand"))


def refit_stability(vectors: DataFrame, row: str, vector: str, states: int, refits: int, share: float, rounds: int, seed: int) -> DataFrame:
    """How alike are the groupings of k-means refits? (refit_a, refit_b, rows, adjusted_rand) over all pairs of refits.

    Each refit draws its own share of the rows by md5, starts from the rows with its smallest md5 keys and takes ``rounds`` rounds of
    nearest centre and mean, all refits in one job a round; then every row of the table, drawn or not, is placed by every refit. Centres
    are a declared, small number of vectors and travel as one array a refit; rows never leave Spark.
    """
    text = lambda kind: F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(kind), "refit", row))
    every = vectors.select(F.col(row), F.col(vector).alias("v")).withColumn("refit", F.explode(F.sequence(F.lit(0), F.lit(refits - 1))))
    drawn = F.conv(F.substring(text("draw"), 1, 8), 16, 10).cast("double") / 2.0**32 < share
    members = cut(every.where(drawn))
    centres = _smallest(members, text("start"), states)
    for _ in range(rounds):
        near = _placed(members, centres).select("refit", "state", F.posexplode("v").alias("dim", "x"))
        means = near.groupBy("refit", "state", "dim").agg(F.avg("x").alias("m"))
        means = means.groupBy("refit", "state").agg(F.transform(F.sort_array(F.collect_list(F.struct("dim", "m"))), lambda d: d["m"]).alias("c"))
        centres = cut(means)
    placed = cut(_placed(every, centres).select(row, "refit", "state"))
    both = placed.select(row, F.col("refit").alias("refit_a"), F.col("state").alias("a")).join(placed.select(row, F.col("refit").alias("refit_b"), F.col("state").alias("b")), row)
    keys = ["refit_a", "refit_b"]
    cell = cut(both.where("refit_a < refit_b").groupBy(*keys, "a", "b").agg(F.count(F.lit(1)).alias("n")))
    two = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2.0)
    whole = cell.groupBy(*keys).agg(two("n").alias("both"), F.sum("n").alias("rows"))
    sides = [cell.groupBy(*keys, side).agg(F.sum("n").alias("n")).groupBy(*keys).agg(two("n").alias("s" + side)) for side in ("a", "b")]
    joined = whole.join(sides[0], keys).join(sides[1], keys)
    expected = F.col("sa") * F.col("sb") / (F.col("rows") * (F.col("rows") - 1) / 2.0)
    return joined.select(*keys, "rows", ratio(F.col("both") - expected, (F.col("sa") + F.col("sb")) / 2 - expected).alias("adjusted_rand"))


def _smallest(members: DataFrame, key: Column, states: int) -> DataFrame:
    """The members with the smallest keys of each refit, as its first centres: partial minima first, so no refit is sorted whole."""
    parts = members.withColumn("__key", key).withColumn("__part", F.substring("__key", 1, 2))
    inner = Window.partitionBy("refit", "__part").orderBy("__key")
    few = parts.withColumn("__n", F.row_number().over(inner)).where(F.col("__n") <= states)
    place = F.row_number().over(Window.partitionBy("refit").orderBy("__key"))
    return cut(few.withColumn("state", place - 1).where(F.col("state") < states).select("refit", "state", F.col("v").alias("c")))


def _placed(rows: DataFrame, centres: DataFrame) -> DataFrame:
    """Each row with the state of the nearest centre of its refit (of equally far ones the smaller)."""
    packed = centres.groupBy("refit").agg(F.collect_list(F.struct("state", "c")).alias("__c"))
    far = lambda v, c: F.sqrt(F.aggregate(F.zip_with(v, c, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))
    near = F.array_min(F.transform("__c", lambda c: F.struct(F.round(far(F.col("v"), c["c"]), 9).alias("d"), c["state"].alias("state"))))
    return rows.join(packed, "refit").withColumn("state", near["state"]).drop("__c")


def fit_mixture(vectors: DataFrame, features: str, counts: Sequence[int], selection: DataFrame, seed: int):
    """Gaussian mixtures for each count, scored by mean log likelihood on held-out rows; the smallest count
    within one standard error of the best is kept. Returns (model, chosen count, scores)."""
    from pyspark.ml.clustering import GaussianMixture

    scored = []
    for k in counts:
        model = GaussianMixture(k=k, seed=seed, featuresCol=features, maxIter=20).fit(vectors)
        held = log_density(selection, model, features)
        r = held.agg(F.avg("log_density").alias("m"), F.stddev_samp("log_density").alias("s"), F.count(F.lit(1)).alias("n")).first()
        scored.append((k, model, r["m"], (r["s"] or 0.0) / max(r["n"], 1) ** 0.5))
    best = max(scored, key=lambda t: t[2])
    chosen = min((t for t in scored if t[2] >= best[2] - best[3]), key=lambda t: t[0])
    return chosen[1], chosen[0], [(k, m, e) for k, _, m, e in scored]


def log_density(rows: DataFrame, model, features: str) -> DataFrame:
    """Log density of each row under a fitted mixture, in Arrow batches (the model is a few small matrices)."""
    weights = np.array(model.weights)
    parts = [(np.array(g.mean.toArray()), np.array(g.cov.toArray())) for g in model.gaussians]
    solved = []
    for mean, cov in parts:
        cov = cov + 1e-9 * np.eye(len(mean))
        sign, logdet = np.linalg.slogdet(cov)
        solved.append((mean, np.linalg.inv(cov), logdet))

    @F.pandas_udf("double")
    def density(values: pd.Series) -> pd.Series:
        x = np.array(values.tolist(), float)
        logs = []
        for w, (mean, inverse, logdet) in zip(weights, solved):
            d = x - mean
            logs.append(np.log(max(w, 1e-300)) - 0.5 * (np.einsum("ij,jk,ik->i", d, inverse, d) + logdet + len(mean) * np.log(2 * np.pi)))
        stack = np.stack(logs)
        top = stack.max(axis=0)
        return pd.Series(top + np.log(np.exp(stack - top).sum(axis=0)))

    from pyspark.ml.functions import vector_to_array

    return rows.withColumn("log_density", density(vector_to_array(F.col(features))))
