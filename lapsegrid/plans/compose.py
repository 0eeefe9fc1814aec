"""What a chain of steps does to its state, when a step is a map: chunks are composed apart, then joined by doubling."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from lapsegrid.plans.durable import cut


def entering(chunks: DataFrame, keys: Sequence[str], chunk: str, effect: str, compose: Callable[[Column, Column], Column]) -> DataFrame:
    """(keys, chunk, entering): the composed effect of all chunks before each one; NULL before the first.

    ``compose(first, then)`` joins two effects. After round r a chunk holds the effect of the 2**r chunks that end
    with it, so a key of n chunks takes log2(n) rounds, each an equi-join of one row per chunk.
    """
    keys = list(keys)
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(chunk))  # one row per chunk, not per step
    held = cut(chunks.select(*keys, chunk, F.col(effect).alias("__e"), place.alias("__p")))
    most = held.agg(F.max("__p")).first()[0] or 0
    step = 1
    while step < most:
        before = held.select(*keys, (F.col("__p") + step).alias("__p"), F.col("__e").alias("__b"))
        both = held.join(before, [*keys, "__p"], "left")
        held = cut(both.withColumn("__e", F.when(F.col("__b").isNull(), F.col("__e")).otherwise(compose(F.col("__b"), F.col("__e")))).drop("__b"))
        step *= 2
    before = held.select(*keys, (F.col("__p") + 1).alias("__p"), F.col("__e").alias("entering"))
    return held.join(before, [*keys, "__p"], "left").select(*keys, chunk, "entering")
