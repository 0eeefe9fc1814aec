"""Ordered scans (lag, lead, running totals, fills) that never need one key in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from lapsegrid.plans.heavy import LIMIT_SETTING as LIMIT_SETTING, has_heavy_key, limit_of

BUCKET = "__bucket"
FRAMES_PER_BUCKET = 4096


def frame_bucket(frame: str = "frame_index", width: float = FRAMES_PER_BUCKET) -> Column:
    """Consecutive stretch of the clock a row falls in; bounds the rows of one entity per task."""
    return F.floor(F.col(frame) / F.lit(width)).cast("long")


#: Rows of a stretch at least, where a lowered limit would cut finer.
LEAST_STRETCH = 64


def ranged(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """df, written once, with the bucket of each row: consecutive stretches of about half of the heavy-key limit.

    Spark samples and cuts the rows along the keys and the whole order, whatever its types and directions, so a key
    crowded into a short span, or into one value of the first column, is cut as evenly as any.
    """
    from lapsegrid.plans.durable import cut

    held = cut(df)
    stretches = max(1, -(-held.count() // max(limit_of(df) // 2, LEAST_STRETCH)))
    return cut(held.repartitionByRange(stretches, *[F.col(k) for k in keys], *order).withColumn(BUCKET, F.spark_partition_id().cast("long")))


def ordered_scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    bucket: Column,
    *,
    lag: dict[str, str] | None = None,
    lead: dict[str, str] | None = None,
    running: dict[str, tuple[str, str]] | None = None,
    remaining: dict[str, tuple[str, str]] | None = None,
    fill_forward: dict[str, str] | None = None,
    fill_backward: dict[str, str] | None = None,
    two_level: bool | None = None,
) -> DataFrame:
    """Add order-dependent columns to ``df`` within ``keys``.

    ``order`` must be unique within ``keys``. ``bucket`` tells what a stretch of the order is where one is known; the cut
    itself is taken from the rows (``ranged``), so no stretch outgrows the limit.

    * ``lag`` / ``lead``: ``{new: column}``, value on the previous / next row;
    * ``running`` / ``remaining``: ``{new: (sum|min|max, column)}`` from the first row to this one,
      or from this row to the last;
    * ``fill_forward`` / ``fill_backward``: ``{new: column}``, latest / earliest non-null value at
      or before / at or after this row.

    ``two_level`` None measures the largest key first. Where every key is small, these are plain windows
    and one shuffle. Otherwise rows are shuffled on (keys, bucket); what crosses buckets is one summary row per (key,
    bucket), reached by partial aggregation, and joined back on (keys, bucket).
    """
    keys, order = list(keys), list(order)
    lag, lead = lag or {}, lead or {}
    running, remaining = running or {}, remaining or {}
    fill_forward, fill_backward = fill_forward or {}, fill_backward or {}
    if two_level is None:
        two_level = has_heavy_key(df, keys)
    if not two_level:
        return _one_level(df, keys, order, lag, lead, running, remaining, fill_forward, fill_backward)

    rows = ranged(df, keys, [F.col(c).asc() for c in order])
    stamp = F.struct(*[F.col(c) for c in order])
    inner = Window.partitionBy(*keys, BUCKET).orderBy(*order)
    inner_desc = Window.partitionBy(*keys, BUCKET).orderBy(*[F.col(c).desc() for c in order])
    first = Window.unboundedPreceding
    upto, downto = inner.rowsBetween(first, 0), inner_desc.rowsBetween(first, 0)

    edge_aggs: list[Column] = []
    local: list[Column] = []
    if lag:
        packed = F.struct(*[F.col(c).alias(a) for a, c in lag.items()])
        edge_aggs.append(F.max_by(packed, stamp).alias("__last"))
        local.append(F.lag(packed, 1).over(inner).alias("__prev"))
    if lead:
        packed = F.struct(*[F.col(c).alias(a) for a, c in lead.items()])
        edge_aggs.append(F.min_by(packed, stamp).alias("__first"))
        local.append(F.lead(packed, 1).over(inner).alias("__next"))
    for prefix, wanted, frame in (("__r_", running, upto), ("__m_", remaining, downto)):
        for alias, (how, source) in wanted.items():
            fn = getattr(F, how)
            edge_aggs.append(fn(F.col(source)).alias(prefix + alias))
            local.append(fn(F.col(source)).over(frame).alias(prefix + "in_" + alias))
    for alias, source in fill_forward.items():
        present = F.when(F.col(source).isNotNull(), stamp)
        edge_aggs.append(F.max_by(F.col(source), present).alias("__f_" + alias))
        local.append(F.last(F.col(source), ignorenulls=True).over(upto).alias("__f_in_" + alias))
    for alias, source in fill_backward.items():
        present = F.when(F.col(source).isNotNull(), stamp)
        edge_aggs.append(F.min_by(F.col(source), present).alias("__b_" + alias))
        local.append(F.last(F.col(source), ignorenulls=True).over(downto).alias("__b_in_" + alias))

    across = Window.partitionBy(*keys).orderBy(BUCKET)
    across_desc = Window.partitionBy(*keys).orderBy(F.col(BUCKET).desc())
    before, after = across.rowsBetween(first, -1), across_desc.rowsBetween(first, -1)
    carried: list[Column] = [F.col(k) for k in keys] + [F.col(BUCKET)]
    if lag:
        carried.append(F.lag("__last", 1).over(across).alias("__c_last"))
    if lead:
        carried.append(F.lead("__first", 1).over(across).alias("__c_first"))
    for prefix, wanted, frame in (("__r_", running, before), ("__m_", remaining, after)):
        for alias, (how, _) in wanted.items():
            carried.append(getattr(F, how)(F.col(prefix + alias)).over(frame).alias(prefix + "c_" + alias))
    for alias in fill_forward:
        carried.append(F.last(F.col("__f_" + alias), ignorenulls=True).over(before).alias("__f_c_" + alias))
    for alias in fill_backward:
        carried.append(F.last(F.col("__b_" + alias), ignorenulls=True).over(after).alias("__b_c_" + alias))

    edges = rows.groupBy(*keys, BUCKET).agg(*edge_aggs).select(*carried)
    joined = rows.select("*", *local).join(edges, [*keys, BUCKET], "left")

    out: list[Column] = [F.col(c) for c in df.columns]
    for alias in lag:
        out.append(F.when(F.col("__prev").isNotNull(), F.col("__prev")[alias]).otherwise(F.col("__c_last")[alias]).alias(alias))
    for alias in lead:
        out.append(F.when(F.col("__next").isNotNull(), F.col("__next")[alias]).otherwise(F.col("__c_first")[alias]).alias(alias))
    for prefix, wanted in (("__r_", running), ("__m_", remaining)):
        for alias, (how, _) in wanted.items():
            inside, outside = F.col(prefix + "in_" + alias), F.col(prefix + "c_" + alias)
            if how == "sum":
                both = F.when(inside.isNotNull() & outside.isNotNull(), inside + outside).otherwise(F.coalesce(inside, outside))
            else:
                both = (F.least if how == "min" else F.greatest)(inside, outside)
            out.append(both.alias(alias))
    for alias in fill_forward:
        out.append(F.coalesce(F.col("__f_in_" + alias), F.col("__f_c_" + alias)).alias(alias))
    for alias in fill_backward:
        out.append(F.coalesce(F.col("__b_in_" + alias), F.col("__b_c_" + alias)).alias(alias))
    return joined.select(*out)


def _one_level(df, keys, order, lag, lead, running, remaining, fill_forward, fill_backward) -> DataFrame:
    asc = Window.partitionBy(*keys).orderBy(*order)
    desc = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    upto, downto = (w.rowsBetween(Window.unboundedPreceding, 0) for w in (asc, desc))
    return df.select(
        "*",
        *[F.lag(c, 1).over(asc).alias(a) for a, c in lag.items()],
        *[F.lead(c, 1).over(asc).alias(a) for a, c in lead.items()],
        *[getattr(F, how)(F.col(c)).over(upto).alias(a) for a, (how, c) in running.items()],
        *[getattr(F, how)(F.col(c)).over(downto).alias(a) for a, (how, c) in remaining.items()],
        *[F.last(F.col(c), ignorenulls=True).over(upto).alias(a) for a, c in fill_forward.items()],
        *[F.last(F.col(c), ignorenulls=True).over(downto).alias(a) for a, c in fill_backward.items()],
    )


def islands(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    starts: Column,
    bucket: Column,
    lag: dict[str, str] | None = None,
    alias: str = "island",
    two_level: bool | None = None,
) -> DataFrame:
    """Number the runs of each key. ``starts`` may use the lagged columns named in ``lag``."""
    if two_level is None:
        two_level = has_heavy_key(df, keys)
    stepped = ordered_scan(df, keys, order, bucket, lag=lag, two_level=two_level) if lag else df
    marked = stepped.withColumn("__start", F.coalesce(starts.cast("int"), F.lit(1)))
    return ordered_scan(
        marked, keys, order, bucket, running={alias: ("sum", "__start")}, two_level=two_level
    ).drop("__start")


def numbered(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, alias: str = "position", two_level: bool | None = None
) -> DataFrame:
    """1-based row number within a key."""
    return ordered_scan(
        df.withColumn("__one", F.lit(1).cast("long")), keys, order, bucket, running={alias: ("sum", "__one")}, two_level=two_level
    ).drop("__one")


def numbered_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column], alias: str, two_level: bool | None = None) -> DataFrame:
    """1-based row number within a key along any sort order, directions and places of nulls included. The order must be unique."""
    keys = list(keys)
    if two_level is None:
        two_level = has_heavy_key(df, keys)
    if not two_level:
        return df.withColumn(alias, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))
    rows = ranged(df, keys, order)
    before = Window.partitionBy(*keys).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    named = [F.col(k).alias(f"__k_{k}") for k in keys]
    edges = rows.groupBy(*keys, BUCKET).agg(F.count(F.lit(1)).alias("__n")).select(*named, F.col(BUCKET).alias("__b"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    same = F.col(BUCKET) == F.col("__b")
    for k in keys:  # a missing key is a key
        same = same & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    inner = rows.withColumn("__in", F.row_number().over(Window.partitionBy(*keys, BUCKET).orderBy(*order)))
    return inner.join(edges, same).withColumn(alias, F.col("__in") + F.col("__before")).select(*df.columns, alias)


def hash_numbered(
    df: DataFrame, keys: Sequence[str], seed: Column, alias: str = "draw", tie: Sequence[str] = (), two_level: bool | None = None
) -> DataFrame:
    """Row number in the order of an md5 text; uniform digests make its leading digits even buckets."""
    hashed = df.withColumn("__md5", F.md5(seed.cast("string")))
    bucket = F.conv(F.substring("__md5", 1, 2), 16, 10).cast("long")
    return numbered(hashed, keys, ["__md5", *tie], bucket, alias, two_level).drop("__md5")


#: Rows, copies included, that a task of ``redealt`` takes at most on average.
DEALT_ROWS = 1_000_000


def redealt(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], seed: Column, replicates: int, columns: Sequence[str], kept: Sequence[str] = (), two_level: bool | None = None
) -> DataFrame:
    """Each key's ``columns`` dealt to its own rows in the order of an md5 text (``seed``), once per replicate (1, 2, ...); ``kept``
    columns stay in their rows. ``order`` must be unique within ``keys``.

    Where every key is small, a row crosses the network once: copies, both numberings and the dealing stay in the key's task.
    """
    keys, order, columns, kept = list(keys), list(order), list(columns), list(kept)
    copies = F.explode(F.sequence(F.lit(1), F.lit(replicates)))
    rk = [*keys, "replicate"]
    if two_level is None:
        two_level = has_heavy_key(df, keys)
    slim = df.select(*keys, *order, *kept, *columns)
    if two_level:
        reps = slim.withColumn("replicate", copies)
        bucket = F.lit(0)  # stretches are cut from the rows
        place = numbered(reps.select(*rk, *order, *kept), rk, order, bucket, "position", two_level=True)
        dealt = hash_numbered(reps, rk, seed, "position", order, two_level=True).select(*rk, "position", *columns)
        return place.join(dealt, [*rk, "position"]).select(*rk, *order, *kept, *columns)
    session = df.sparkSession
    tasks = max(int(session.conf.get("spark.sql.shuffle.partitions")), -(-slim.count() * replicates // DEALT_ROWS))
    own = Window.partitionBy(*rk)
    reps = slim.repartition(tasks, *keys).withColumn("replicate", copies)
    at = reps.withColumn("__at", F.row_number().over(own.orderBy(*order))).withColumn("__md5", F.md5(seed.cast("string")))
    at = at.withColumn("__from", F.row_number().over(own.orderBy("__md5", *order)))
    fields = {f.name: f.dataType for f in slim.schema.fields}
    none = lambda c: F.lit(None).cast(fields[c]).alias(c)
    stay, move = [*order, *kept], columns
    sides = F.array(
        F.struct(F.col("__at").alias("position"), *[F.col(c) for c in stay], *[none(c) for c in move]),
        F.struct(F.col("__from").alias("position"), *[none(c) for c in stay], *[F.col(c) for c in move]),
    )
    # a position has one row that stays and one that is dealt to it
    met = at.select(*rk, F.inline(sides)).groupBy(*rk, "position").agg(*[F.max(c).alias(c) for c in (*stay, *move)])
    return met.drop("position")
