"""Order statistics of the slopes of all pairs of an entity's observations, without the pairs.

A slope below s is a pair that a line of slope s turns round: with u = v - s t, the later value lies below the earlier one.
So the pairs below s are the inversions of u in the order of time, which sorting counts. A few slopes are tried for each
wanted rank, the counts narrow its bracket, and once a bracket holds few pairs those are listed: they are what changes order
between the two ends' lines. Rows are dealt in blocks of time, and a pair of blocks is one task, so no task holds an entity.

Counts leave a margin for rounding: a pair that close to a tried slope counts neither below nor above it. A rank that falls
among more such pairs than are listed has that slope, to rounding.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from lapsegrid.plans.durable import cut

#: Observations of one block, and pairs that a bracket may hold when they are listed.
BLOCK, LISTED = 131_072, 1_000_000
#: Observations of the sample that proposes the first slopes. It decides where the search starts, never what is returned.
SAMPLE = 1024


def turned(first: np.ndarray, second: np.ndarray) -> int:
    """Pairs i < j with first[i] >= second[j], by merging ever larger blocks. Whole numbers from 0 to the length."""
    n, total, size = len(first), 0, 1
    place = np.arange(n)
    while size < n:
        pair, right = place // (2 * size), (place // size) % 2 == 1
        low = pair * (n + 2)
        keys = np.sort((low + second)[right])
        left = ~right
        at = np.searchsorted(keys, (low + first)[left], side="right") - np.searchsorted(keys, low[left], side="left")
        total += int(at.sum())
        size *= 2
    return total


def inversions(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs x < y of positions with values[x] > values[y]; work grows with their number."""
    n, size, xs, ys = len(values), 1, [], []
    rank = np.argsort(np.argsort(values, kind="stable"), kind="stable")
    place = np.arange(n)
    while size < n:
        pair, right = place // (2 * size), (place // size) % 2 == 1
        key = pair * (n + 1) + rank
        members = place[right][np.argsort(key[right])]
        keys = key[members]
        lefts = place[~right]
        begin = np.searchsorted(keys, pair[lefts] * (n + 1), side="left")
        count = np.searchsorted(keys, key[lefts], side="left") - begin
        xs.append(np.repeat(lefts, count))
        ys.append(members[np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(count.sum())])
        size *= 2
    x, y = (np.concatenate(p) if p else np.zeros(0, np.int64) for p in (xs, ys))
    strict = values[x] > values[y]
    return x[strict], y[strict]


def _lines(t: np.ndarray, v: np.ndarray, s: float, reach: tuple[float, float]) -> tuple[np.ndarray, float]:
    """v - s t and the margin of a comparison. reach: the entity's greatest |v| and its span of time."""
    return v - s * t, 16 * np.finfo(float).eps * (reach[0] + abs(s) * reach[1])


def below_and_above(left: tuple, right: tuple | None, s: float, reach: tuple[float, float]) -> tuple[int, int]:
    """Pairs surely below and surely above s: of one block (right is None), or between an earlier and a later block. A block is (t, v), ordered by both."""
    t, v = left
    u, margin = _lines(t, v, s, reach)
    if right is not None:
        w, _ = _lines(*right, s, reach)
        low, high = np.sort(u), np.sort(w)
        return int((len(u) - np.searchsorted(low, w + margin, side="right")).sum()), int((len(w) - np.searchsorted(high, u + margin, side="right")).sum())
    ordered = np.sort(u)
    below = turned(np.searchsorted(ordered, u, side="left"), np.searchsorted(ordered, u + margin, side="right"))
    # above: the same with all signs changed, and equal times in falling order of v, so that they never count
    order = np.lexsort((-v, t))
    u = -u[order]
    ordered = np.sort(u)
    return below, turned(np.searchsorted(ordered, u, side="left"), np.searchsorted(ordered, u + margin, side="right"))


def listed_slopes(left: tuple, right: tuple | None, low: float, high: float, reach: tuple[float, float], least_step: float) -> np.ndarray:
    """Slopes of the pairs that are neither surely below `low` nor surely above `high`."""
    t = left[0] if right is None else np.concatenate([left[0], right[0]])
    v = left[1] if right is None else np.concatenate([left[1], right[1]])
    if np.isfinite(low) and np.isfinite(high):
        spare = lambda s: 4 * _lines(t, v, s, reach)[1] / least_step
        order = np.argsort(_lines(t, v, low - spare(low), reach)[0], kind="stable")
        x, y = inversions(_lines(t, v, high + spare(high), reach)[0][order])
        i, j = order[x], order[y]
    else:
        i, j = np.triu_indices(len(t), 1)
    later = t[j] > t[i]
    i, j = np.where(later, i, j), np.where(later, j, i)
    keep = t[j] > t[i]
    if right is not None:
        keep &= (i < len(left[0])) & (j >= len(left[0]))
    i, j = i[keep], j[keep]
    keep = np.ones(len(i), bool)
    if np.isfinite(low):
        u, margin = _lines(t, v, low, reach)
        keep &= ~(u[j] + margin < u[i])
    if np.isfinite(high):
        u, margin = _lines(t, v, high, reach)
        keep &= ~(-u[j] + margin < -u[i])
    i, j = i[keep], j[keep]
    return (v[j] - v[i]) / (t[j] - t[i])


def _tried(low: float, high: float, below: int, upto: int, rank: int) -> list[float]:
    """Slopes to try inside a bracket: around where the rank should lie, zero, and the middle of the doubles between the ends."""
    if not (np.isfinite(low) and np.isfinite(high)):
        edge = low if np.isfinite(low) else high if np.isfinite(high) else 0.0
        step = max(1.0, abs(edge)) * 8
        return [edge + step if np.isfinite(low) or not np.isfinite(high) else edge - step, *([-step] if not (np.isfinite(low) or np.isfinite(high)) else []), *([0.0] if low < 0 < high else [])]
    width, at = high - low, low + (high - low) * min(1.0, max(0.0, (rank - below) / max(1, upto - below)))
    found = [at, at - width / 64, at + width / 64, at - width / 1024, at + width / 1024, low + width / 2]
    if low < 0 < high:
        found += [0.0, low / 2**10, high / 2**10]
    return sorted({s for s in found if low < s < high})


def select_slopes(rows: DataFrame, keys: Sequence[str], ranks: DataFrame, block: int = BLOCK, listed: int = LISTED) -> DataFrame:
    """(keys, target, value): the slope of each 0-based rank among all pairs of a key's rows with different times.

    rows: keys, position (1-based in the order of t and v), t, v. ranks: keys, target, rank, pairs (how many pairs there are).
    """
    keys = list(keys)
    fields = [rows.schema[k] for k in keys]
    reach = rows.groupBy(*keys).agg(
        F.max(F.abs("v")).alias("__v"), F.min("t").alias("__t0"), (F.max("t") - F.min("t")).alias("__span"), F.count(F.lit(1)).alias("__n")
    )
    times = rows.groupBy(*keys, "t").agg(F.min("position").alias("__first"))
    # equal times stay in one block
    steps = times.groupBy(*keys, F.floor((F.col("__first") - 1) / block).cast("int").alias("own")).agg(F.sort_array(F.collect_list("t")).alias("ts"))
    gaps = steps.select(*keys, F.array_min(F.transform(F.slice("ts", 2, block + 1), lambda x, i: x - F.get("ts", i))).alias("g"), F.element_at("ts", 1).alias("a"), F.element_at("ts", -1).alias("b"))
    least = gaps.groupBy(*keys).agg(F.min("g").alias("g"), F.sort_array(F.collect_list(F.struct("a", "b"))).alias("e"))
    between = F.array_min(F.transform(F.slice("e", F.lit(2), F.size("e")), lambda x, i: x["a"] - F.get("e", i)["b"]))
    least = least.select(*keys, F.least(F.coalesce("g", between), F.coalesce(between, "g")).alias("__step"))
    placed = rows.join(reach, keys).join(least, keys).join(times, [*keys, "t"])
    placed = placed.withColumn("own", F.floor((F.col("__first") - 1) / block).cast("int"))
    own = placed.groupBy(*keys).agg(F.sort_array(F.collect_set("own")).alias("__own"))
    met = placed.join(own, keys).withColumn("__other", F.explode("__own")).withColumn("bi", F.least("own", "__other")).withColumn("bj", F.greatest("own", "__other"))
    tasks = cut(met.select(*keys, "bi", "bj", "own", (F.col("t") - F.col("__t0")).alias("t"), "v", "__v", "__span", "__step"))

    sample = placed.where((F.col("position") - 1) % F.greatest(F.floor(F.col("__n") / SAMPLE), F.lit(1)) == 0).select(*keys, "t", "v")
    state_type = T.StructType([*fields, T.StructField("target", T.StringType()), T.StructField("rank", T.LongType()), *(T.StructField(c, T.DoubleType()) for c in ("low", "high")),
                               *(T.StructField(c, T.LongType()) for c in ("below", "upto")), T.StructField("tries", T.ArrayType(T.DoubleType())), T.StructField("value", T.DoubleType())])

    def first(pdf: pd.DataFrame) -> pd.DataFrame:
        t, v = pdf["t"].to_numpy(float), pdf["v"].to_numpy(float)
        i, j = np.nonzero(t[:, None] < t[None, :])
        s = np.sort((v[j] - v[i]) / (t[j] - t[i]))
        out = []
        for w in pdf["__r"].iloc[0]:
            at = w["rank"] / w["pairs"]
            tries = sorted({float(s[int(min(len(s) - 1, max(0, (at + d) * len(s))))]) for d in (-0.06, -0.02, 0, 0.02, 0.06)}) if len(s) else [0.0]
            out.append((*(pdf[k].iloc[0] for k in keys), w["target"], w["rank"], -np.inf, np.inf, 0, w["pairs"], tries, None))
        return pd.DataFrame(out, columns=state_type.names)

    packed = ranks.groupBy(*keys).agg(F.collect_list(F.struct("target", "rank", "pairs")).alias("__r"))
    state = cut(sample.join(packed, keys).groupBy(*keys).applyInPandas(first, state_type))

    def blocks(pdf: pd.DataFrame) -> tuple[tuple, tuple | None, tuple[float, float]]:
        pdf = pdf.sort_values(["t", "v"])
        side = lambda b: tuple(pdf.loc[pdf["own"] == b, c].to_numpy(float) for c in ("t", "v"))
        bi, bj = pdf["bi"].iloc[0], pdf["bj"].iloc[0]
        return side(bi), None if bi == bj else side(bj), (float(pdf["__v"].iloc[0]), float(pdf["__span"].iloc[0]))

    count_type = T.StructType([*fields, T.StructField("s", T.DoubleType()), T.StructField("below", T.LongType()), T.StructField("above", T.LongType())])

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right, far = blocks(pdf)
        out = [(*(pdf[k].iloc[0] for k in keys), s, *below_and_above(left, right, s, far)) for s in pdf["__tries"].iloc[0]]
        return pd.DataFrame(out, columns=count_type.names)

    def narrowed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                low, high, below, upto, rank, value = row["low"], row["high"], row["below"], row["upto"], row["rank"], row["value"]
                for c in sorted(row["counts"] if row["counts"] is not None else [], key=lambda c: c["s"]):
                    least, most = c["below"], row["pairs"] - c["above"]
                    if rank < least and c["s"] < high:
                        high, upto = c["s"], most
                    elif rank >= most and c["s"] > low:
                        low, below = c["s"], least
                    elif least <= rank < most and low < c["s"] < high:
                        low = high = c["s"]
                        below, upto = least, most
                if upto - below > listed and not low < np.nextafter(high, -np.inf):
                    value = high
                done = value == value and value is not None or upto - below <= listed
                out.append((*(row[k] for k in keys), row["target"], rank, low, high, below, upto, [] if done else _tried(low, high, below, upto, rank), value))
            yield pd.DataFrame(out, columns=state_type.names)

    pairs = ranks.select(*keys, "target", "pairs")
    for _ in range(80):  # a bracket halves at least; 64 bits of a double end sooner
        tries = state.select(*keys, F.explode("tries").alias("s")).groupBy(*keys).agg(F.collect_set("s").alias("__tries"))
        counts = tasks.join(tries, keys).groupBy(*keys, "bi", "bj").applyInPandas(count, count_type)
        counts = counts.groupBy(*keys, "s").agg(F.sum("below").alias("below"), F.sum("above").alias("above"))
        counts = counts.groupBy(*keys).agg(F.collect_list(F.struct("s", "below", "above")).alias("counts"))
        state = cut(state.join(pairs, [*keys, "target"]).join(counts, keys, "left").mapInPandas(narrowed, state_type))
        if state.where(F.size("tries") > 0).isEmpty():
            break

    found = state.where(F.col("value").isNotNull()).select(*keys, "target", "value")
    wanted = state.where(F.col("value").isNull()).groupBy(*keys).agg(F.collect_list(F.struct("target", "low", "high")).alias("__w"))
    slope_type = T.StructType([*fields, T.StructField("target", T.StringType()), T.StructField("value", T.DoubleType())])

    def listing(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right, far = blocks(pdf)
        targets, found = [], []
        for w in pdf["__w"].iloc[0]:
            found.append(listed_slopes(left, right, w["low"], w["high"], far, float(pdf["__step"].iloc[0])))
            targets += [w["target"]] * len(found[-1])
        values = np.concatenate(found)
        # names as plain objects: a long list of strings would come in several chunks, which Spark's conversion refuses
        named = {k: pd.Series([pdf[k].iloc[0]] * len(values), dtype=object) for k in keys} | {"target": pd.Series(targets, dtype=object)}
        return pd.DataFrame({**named, "value": values})

    def ranked(pdf: pd.DataFrame) -> pd.DataFrame:
        s = np.sort(pdf["value"].to_numpy(float))
        at = int(pdf["rank"].iloc[0] - pdf["below"].iloc[0])
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in keys}, "target": [pdf["target"].iloc[0]], "value": [s[min(at, len(s) - 1)]]})

    slopes = tasks.join(wanted, keys).groupBy(*keys, "bi", "bj").applyInPandas(listing, slope_type)
    chosen = slopes.join(state.select(*keys, "target", "rank", "below"), [*keys, "target"]).groupBy(*keys, "target").applyInPandas(ranked, slope_type)
    return found.unionByName(chosen)
