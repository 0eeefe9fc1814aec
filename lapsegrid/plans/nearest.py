"""Exact nearest neighbours on a plane by growing grid cells.

Distances are compared to nine digits, so that places equally far tie whatever the last bits of their roots. Both sides
of a join here grow with the data, and written tables of few distinct values look far smaller than their rows are in
memory: the joins ask for a merge, so no side is gathered on the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from lapsegrid.plans.durable import cut


def _cells(width: float):
    return [F.floor(F.col(c) / F.lit(width)).cast("long").alias("__c" + c) for c in ("y", "x")]


def within_reach(points: DataFrame, targets: DataFrame, keys: Sequence[str], width: float) -> DataFrame:
    """Point-target pairs (same keys) whose target lies in the 3 x 3 cells around the point's cell. Every
    target closer than ``width`` is among them. Target columns are prefixed ``t_``."""
    keys = list(keys)
    around = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy in (-1, 0, 1) for dx in (-1, 0, 1)])
    p = points.select("*", *_cells(width)).withColumn("__o", F.explode(around))
    p = p.withColumn("__cy", F.col("__cy") + F.col("__o.dy")).withColumn("__cx", F.col("__cx") + F.col("__o.dx")).drop("__o")
    t = targets.select(*keys, *[F.col(c).alias("t_" + c) for c in targets.columns if c not in keys], *_cells(width))
    joined = p.join(t.hint("merge"), [*keys, "__cy", "__cx"]).drop("__cy", "__cx")
    return joined.withColumn("distance", F.hypot(F.col("t_y") - F.col("y"), F.col("t_x") - F.col("x")))


def k_nearest(
    points: DataFrame, targets: DataFrame, keys: Sequence[str], point_id: Sequence[str], k: int, width: float, admissible=None, order: Sequence[str] = ()
) -> DataFrame:
    """The k nearest targets of every point, exactly.

    A point is settled in a round once its k-th neighbour is nearer than the cell width, since nothing
    outside the cells searched can be as close. Points left over search again with cells twice as wide, until
    a cell spans everything, when whatever was found is final. Crowded places settle in the first, small
    cells, so only sparse points ever look far. Each round is written to the shared folder.
    """
    keys, point_id = list(keys), list(point_id)
    # every round reads both sides again
    same = points is targets
    points = cut(points)
    targets = points if same else cut(targets)
    furthest = F.max(F.greatest(F.abs("y"), F.abs("x")))
    reach = 1.0 + 2.0 * max(float(df.agg(furthest).first()[0] or 0.0) for df in (points, targets))
    left = points
    found = None
    while True:
        pairs = within_reach(left, targets, keys, width)
        if admissible is not None:
            pairs = pairs.where(admissible)
        w = Window.partitionBy(*keys, *point_id).orderBy(F.round("distance", 9), *order)
        best = pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
        if width >= reach:
            return best if found is None else found.unionByName(best)
        held = Window.partitionBy(*keys, *point_id)
        settled = (F.max("rank").over(held) == k) & (F.round(F.max("distance").over(held), 9) < width)
        best = cut(best.withColumn("__settled", settled).where("__settled").drop("__settled"))
        found = best if found is None else found.unionByName(best)
        left = cut(left.join(best.where("rank = 1").select(*keys, *point_id).hint("merge"), [*keys, *point_id], "left_anti"))
        if left.isEmpty():
            return found
        width *= 2.0
