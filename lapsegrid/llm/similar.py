"""Near-duplicates by Jaccard similarity of word shingles: SimHash and banded minima propose, exact sets decide.

SimHash fingerprints within NEAR bits propose first: a fingerprint's points meet its first point, and the first points of
linked fingerprints meet. A 64-bit fingerprint alone cannot stand for a similarity of 0.8: such pairs differ in ten bits on
average and in up to twenty, where most pairs of a corpus meet. So BANDS keys of ROWS minima of the shingles' hashes bring
the other texts together; a pair of similarity 0.8 shares no key with a chance of 3 in a million, a more similar one
with less. A link is a pair whose sets of shingles have the similarity, counted exactly; bits alone link nothing.

Equal texts are one point. First each point under a key meets the key's first point, and links make classes. Then the
points of every key that still holds several classes meet in blocks, bounded in points and in shingles: a block brings the
sets themselves, counts all overlaps by products of bounded 0/1 matrices, and hands back a spanning forest of the links
between classes. So no list of pairs is ever written: rows grow with the points, whatever the size of a group. Blocks of a
key with many points meet each other, each pair of blocks in a task of its own.

Null texts are empty; texts without words are equal to each other. Null ids come last in the choice of a class's row. Of
rows that repeat, and of equal texts, one stays. An empty table gives none. A very long text is one set in one task, as its
text is. Other columns are carried along, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapsegrid.llm.common import bloom_hits, blocked_bloom, discard, map_texts, saved, slices
from lapsegrid.llm.simhash import components, links, majority, shingle_hashes

BANDS, ROWS = 24, 4
#: Bits in which two fingerprints may differ to propose a pair.
NEAR = 4
#: Odd factors, one for each minimum.
FACTORS = np.random.default_rng(5).integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Products that one step holds.
STEP = 2**17
#: Points, and shingles, of one block.
BLOCK, VOLUME = 512, 1_000_000
#: Shingles of one matrix product.
WIDTH = 2048
#: Shingles of small keys that one task step takes together.
TOGETHER = 250_000
#: Parts over which the pairs of one point are dealt.
PARTS = 64


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """BANDS keys of a text by its shingles' hashes; a text without any has one key that all such texts share."""
    if not len(hashes):
        return np.zeros(1, np.int64)
    step = max(1, STEP // len(hashes))
    least = np.concatenate([(FACTORS[i : i + step, None] * hashes[None, :]).min(axis=1) for i in range(0, len(FACTORS), step)])
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for row in least.reshape(BANDS, ROWS).T:
        keys = (keys ^ row) * np.uint64(0x9E3779B97F4A7C15)
        keys ^= keys >> np.uint64(29)
    return keys.view(np.int64)


def overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many values each set of a shares with each set of b. Sets are arrays of distinct values."""
    out = np.zeros((len(a), len(b)), np.float32)
    values, column = np.unique(np.concatenate([*a, *b]), return_inverse=True)
    cut = sum(map(len, a))
    in_a, in_b = column[:cut], column[cut:]
    row_a, row_b = np.repeat(np.arange(len(a)), [len(x) for x in a]), np.repeat(np.arange(len(b)), [len(x) for x in b])
    # only values that both sides hold count
    held = np.zeros(len(values), bool)
    held[in_a] = True
    both = np.zeros(len(values), bool)
    both[in_b] = True
    both &= held
    number = np.cumsum(both) - 1
    sides = []
    for column, row in ((in_a, row_a), (in_b, row_b)):
        keep = both[column]
        c, r = number[column[keep]], row[keep]
        order = np.argsort(c, kind="stable")
        sides.append((c[order], r[order]))
    for at in range(0, int(both.sum()), WIDTH):
        parts = []
        for (c, r), n in zip(sides, out.shape, strict=True):
            lo, hi = np.searchsorted(c, [at, at + WIDTH])
            m = np.zeros((n, WIDTH), np.float32)
            m[r[lo:hi], c[lo:hi] - at] = 1
            parts.append(m)
        out += parts[0] @ parts[1].T
    return out


def forest(linked: np.ndarray, held_a: np.ndarray, held_b: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (i, j) of `linked` that join the classes held_a[i] and held_b[j] into the components that all its pairs make."""
    parent: dict = {}

    def root(x: object) -> object:
        while parent.get(x, x) != x:
            parent[x] = parent.get(parent[x], parent[x])
            x = parent[x]
        return x

    out = []
    names_a, codes_a = np.unique(held_a, return_inverse=True)
    names_b, codes_b = np.unique(held_b, return_inverse=True)
    i, j = np.nonzero(linked)
    # one pair for each two classes is enough
    _, first = np.unique(codes_a[i] * len(names_b) + codes_b[j], return_index=True)
    for k in first.tolist():
        x, y = root(held_a[i[k]]), root(held_b[j[k]])
        if x != y:
            parent[x] = y
            out.append((int(i[k]), int(j[k])))
    return out


def _links(a: pd.DataFrame, b: pd.DataFrame, least: Fraction) -> list[tuple[bytes, bytes]]:
    """A spanning forest of the links between the points of a and of b."""
    if a.empty or b.empty:
        return []
    sets_a, sets_b = list(a["shingles"]), list(b["shingles"])
    n_a, n_b = np.array([len(x) for x in sets_a]), np.array([len(x) for x in sets_b])
    held_a, held_b = a["held"].to_numpy(), b["held"].to_numpy()
    both = overlaps(sets_a, sets_b).astype(np.int64)
    every = n_a[:, None] + n_b[None, :] - both
    return [(a["bits"].iat[i], b["bits"].iat[j]) for i, j in forest(both * least.denominator >= every * least.numerator, held_a, held_b)]


def _met_in_blocks(left: DataFrame, sizes: DataFrame, sets: DataFrame, least: Fraction, block: int, volume: int) -> DataFrame:
    """Links (bits, other) between the classes of the points under each key. left: (key, bits, held); sizes: (key, points, shingles)."""
    n = F.greatest(F.ceil(F.col("points") / block), F.ceil(F.col("shingles") / volume)).cast("int")
    groups = max(1, (sizes.agg(F.sum("shingles")).first()[0] or 0) // TOGETHER)
    sizes = sizes.select("key", n.alias("n"))
    dealt = left.join(sizes, "key").withColumn("mine", F.pmod(F.xxhash64("bits"), "n").cast("int")).withColumn("met", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    dealt = dealt.withColumn("lo", F.least("mine", "met")).withColumn("hi", F.greatest("mine", "met")).join(sets, "bits")
    group = F.when(F.col("n") == 1, F.pmod("key", F.lit(groups))).otherwise(F.xxhash64("key", "lo", "hi"))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[bytes, bytes]] = []
        for (_, lo, hi), g in pdf.groupby(["key", "lo", "hi"], sort=False):
            first = g["mine"] == lo
            out += _links(g, g, least) if lo == hi else _links(g[first], g[~first], least)
        return pd.DataFrame(out, columns=["bits", "other"])

    return dealt.select(group.alias("group"), "key", "lo", "hi", "mine", "bits", "held", "shingles").groupBy("group").applyInPandas(compare, "bits binary, other binary")


def _point(text_column: str) -> Column:
    """Equal texts, and only those, are one point: the first half of a SHA-256 digest."""
    return F.substring(F.unhex(F.sha2(F.coalesce(F.col(text_column), F.lit("")), 256)), 1, 16)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *arrays])))


def shingle_sets(texts: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(bits, shingles) of the points in wanted (bits). texts: (bits, text). No text is shuffled: a Bloom filter chooses, a join of its few hits decides."""
    bloom = blocked_bloom(wanted.select(F.xxhash64("bits")))
    shipped = texts.sparkSession.sparkContext.broadcast(bloom)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2):
            hit = bloom_hits(shipped.value, batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64))
            chosen = batch.filter(pa.array(hit))
            _, first = np.unique(chosen.column(0).to_numpy(zero_copy_only=False), return_index=True)
            chosen = chosen.take(pa.array(first))
            sets = [np.unique(shingle_hashes(t, words)).view(np.int64) for t in chosen.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([chosen.column(1), _lists(sets)], names=["bits", "shingles"])

    made = texts.select(F.xxhash64("bits").alias("h"), "bits", "text").mapInArrow(run, "bits binary, shingles array<long>")
    return saved(made.join(wanted, "bits", "left_semi").groupBy("bits").agg(F.first("shingles").alias("shingles")), "shingles")


def _checked(pairs: DataFrame, sets: DataFrame, least: Fraction) -> DataFrame:
    """The pairs (bits, other) whose sets of shingles have at least that similarity."""
    pairs = pairs.withColumn("part", F.pmod(F.xxhash64("other"), F.lit(PARTS)))
    # a point with many pairs is read once for each part of them, so no task holds them all
    mine = pairs.select("bits", "part").distinct().join(sets, "bits").withColumnRenamed("shingles", "a")
    theirs = sets.select(F.col("bits").alias("other"), F.col("shingles").alias("b"))
    met = pairs.join(theirs, "other").join(mine, ["bits", "part"])
    both = F.size(F.array_intersect("a", "b"))
    every = F.size("a") + F.size("b") - both
    return saved(met.where(both * least.denominator >= every * least.numerator).select("bits", "other"), "similar")


def _by_fingerprint(points: DataFrame) -> DataFrame:
    """Pairs (bits, other) that SimHash proposes. points: (bits, print)."""
    prints = saved(points.groupBy("print").agg(F.min("bits").alias("one"), F.count(F.lit(1)).alias("n")), "prints")
    same = points.join(prints.where("n > 1"), "print").where("bits > one").select(F.col("one").alias("bits"), F.col("bits").alias("other"))
    edges = links(prints.select(F.col("print").alias("bits")), NEAR)
    ends = edges.select(F.col("bits").alias("a"), F.col("other").alias("b"))
    for side, name in (("a", "bits"), ("b", "other")):
        ends = ends.join(prints.select(F.col("print").alias(side), F.col("one").alias(name)), side)
    return same.unionAll(ends.select(F.least("bits", "other").alias("bits"), F.greatest("bits", "other").alias("other")))


def classes(
    docs: DataFrame, words: int = 5, least: Fraction = Fraction(4, 5), id_column: str = "doc_id", text_column: str = "text", block: int = BLOCK, volume: int = VOLUME
) -> DataFrame:
    """(bits, first) for every distinct text: its point, and no_id, id and bits of the first row of its class, by id with nulls last."""

    def work(texts: list) -> list[pa.Array]:
        hashes = [shingle_hashes(t, words) for t in texts]
        return [_lists([band_keys(h) for h in hashes]), pa.array([majority(h) for h in hashes], pa.int64())]

    point, doc_id = _point(text_column).alias("bits"), F.col(id_column).cast("long")
    keyed = map_texts(docs, [point, F.col(text_column), doc_id.alias("id")], work, "bits binary, id long, keys array<long>, print long")
    first_row = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id")).alias("row")
    points = keyed.groupBy("bits").agg(first_row, F.first("keys").alias("keys"), F.first("print").alias("print"))
    points = saved(points.select("bits", F.struct("row.no_id", "row.id", "bits").alias("least"), "keys", "print"), "points")
    labels, texts = points.select("bits", "least"), docs.select(point, F.col(text_column).alias("text"))

    keys = points.select("bits", F.explode("keys").alias("key"))
    shared = keys.groupBy("key").agg(F.min("bits").alias("one"), F.max("bits").alias("last")).where("one < last").select("key", "one")
    met = saved(keys.join(shared, "key"), "met")
    proposed = saved(_by_fingerprint(points.select("bits", "print")), "proposed")
    sets = shingle_sets(texts, met.select("bits").unionAll(proposed.select(F.explode(F.array("bits", "other")))).distinct(), words)
    tried = met.where("bits > one").select(F.col("one").alias("bits"), F.col("bits").alias("other")).unionAll(proposed).distinct()
    found = _checked(tried, sets, least)
    discard(proposed)

    held = components(found, labels)
    held = met.select("key", "bits").join(held, "bits", "left").select("key", "bits", F.coalesce("least.bits", "bits").alias("held"))
    held = saved(held.join(sets.select("bits", F.size("shingles").alias("size")), "bits"), "held")
    discard(met)
    mixed = held.groupBy("key").agg(F.min("held").alias("one"), F.max("held").alias("last"), F.count(F.lit(1)).alias("points"), F.sum("size").alias("shingles"))
    mixed = saved(mixed.where("one < last").select("key", "points", "shingles"), "mixed")
    rest = saved(_met_in_blocks(held.select("key", "bits", "held"), mixed, sets, least, block, volume), "rest")
    discard(held, mixed, sets)
    reached = components(found.unionAll(rest), labels).withColumnRenamed("least", "first")
    discard(found, rest)
    return labels.join(reached, "bits", "left").select("bits", F.coalesce("first", "least").alias("first"))


def keep_one(docs: DataFrame, words: int = 5, least: Fraction = Fraction(4, 5), id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row of each class (all columns): the smallest id, nulls last, then by text and the other columns."""
    firsts = classes(docs, words, least, id_column, text_column).where(F.col("first.bits") == F.col("bits"))
    firsts = firsts.select(F.col("bits").alias("__bits"), F.col("first.no_id").alias("__no"), F.coalesce("first.id", F.lit(0)).alias("__id"))
    doc_id = F.col(id_column).cast("long")
    named = docs.select(F.struct(*docs.columns).alias("__row"), _point(text_column).alias("__bits"), doc_id.isNull().alias("__no"), F.coalesce(doc_id, F.lit(0)).alias("__id"))
    on = ["__bits", "__no", "__id"]
    return named.join(firsts, on, "left_semi").groupBy(*on).agg(F.min_by("__row", F.xxhash64("__row")).alias("__row")).select("__row.*")
