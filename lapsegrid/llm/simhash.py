"""Operator 8, SimHash near-duplicates by anchor-point covering.

Fingerprints are 64-bit majority votes over the XXH64 values of word shingles. The anchors are the codewords of
a linear code: 2**k points of the 64-bit space. Every fingerprint has a home, its nearest anchor, at distance d
(at most the code's covering radius R). Let x and y differ in at most t bits and d(x) <= d(y): then y lies within
d(x) + t <= d(y) + t of x's home. So a copy of each fingerprint goes to every anchor within its own home distance
plus t (never beyond R + t), and every linked pair meets at the home of one of the two. At an anchor only homes
meet copies, and the linked pairs are not written: each block of an anchor returns the edges of a spanning forest.

Equal fingerprints are one point with many documents. An anchor's homes are cut into bounded blocks by a hash;
its copies meet each block, in blocks too, so no task holds an unbounded group.

Classes are connected components: minimum labels with pointer jumping, each round written to the shared folder.

Null or empty texts have fingerprint zero and link like any other. Fewer words than a shingle: the whole sequence
is the one shingle. Repeated rows share their fingerprint and class. Null ids are left out of the class minimum.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapsegrid.llm.common import discard, map_texts, saved

BITS = np.array([[(v >> b) & 1 for b in range(8)] for v in range(256)], np.int64)
#: Members of one anchor's block of homes, and of copies, that one task step compares.
BLOCK = 2048


def shingle_hashes(text: str | None, words: int, seed: int = 42) -> np.ndarray:
    split = (text or "").encode().lower().split()
    if not split:
        return np.zeros(0, np.uint64)
    joined = b" ".join(split)
    if len(split) <= words:
        return np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, split), np.int64, len(split)) + 1) - 1
    begins = [0, *(ends[: len(split) - words] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], seed) for a, b in zip(begins, ends[words - 1 :].tolist(), strict=True)], np.uint64)


def simhash(text: str | None, words: int, seed: int = 42) -> int:
    """The signed 64-bit fingerprint; a bit is set if it is set in over half of the shingles' hashes."""
    return majority(shingle_hashes(text, words, seed))


def majority(h: np.ndarray) -> int:
    """The signed fingerprint of the shingles' hashes."""
    if not len(h):
        return 0
    lanes = h.view(np.uint8).reshape(-1, 8) + (np.arange(8, dtype=np.int64) * 256)
    ones = np.bincount(lanes.ravel(), minlength=2048).reshape(8, 256) @ BITS
    return int(np.packbits(2 * ones.ravel() > len(h), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, words: int = 4, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id and its fingerprint (long) for every row."""

    def work(texts: list) -> list[pa.Array]:
        return [pa.array([simhash(t, words) for t in texts], pa.int64())]

    return map_texts(docs, [F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")], work, "doc_id long, bits long")


@lru_cache(maxsize=2)
def anchors(k: int) -> np.ndarray:
    """All 2**k words of a systematic linear code of length 64; its parity part is drawn from a fixed seed."""
    rows = np.random.default_rng(64).integers(0, 2**63, 64, dtype=np.uint64)[:k]
    keep = np.uint64(2**64 - 2**k)
    words = np.zeros(1, np.uint64)
    for i in range(k):
        words = np.concatenate([words, words ^ ((rows[i] << np.uint64(1)) & keep | np.uint64(1 << i))])
    return words


def near_anchors(points: np.ndarray, k: int, threshold: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """For each point: its position, its home, and every anchor within its home distance plus the threshold."""
    words = anchors(k)
    for i, p in enumerate(points):
        distance = np.bitwise_count(words ^ p)
        least = int(distance.min())
        near = np.flatnonzero(distance <= least + threshold)
        yield i, int(near[np.argmax(distance[near] == least)]), near


def forest(a: np.ndarray, b: np.ndarray, threshold: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links between points a and points b, found by growing from each unseen point of a."""
    edges: list[tuple[int, int]] = []
    every, seen = np.unique(np.concatenate([a, b])), None
    seen = np.zeros(len(every), bool)
    in_a, in_b = np.isin(every, a), np.isin(every, b)
    for start in np.flatnonzero(in_a):
        if seen[start]:
            continue
        seen[start] = True
        front = [int(start)]
        while front:
            at = front.pop()
            # only a link between a home and a copy counts; it may lead either way
            open_ = ~seen & ((in_b & in_a[at]) | (in_a & in_b[at]))
            found = np.flatnonzero(open_)
            found = found[np.bitwise_count(every[found] ^ every[at]) <= threshold]
            seen[found] = True
            edges += [(int(at), int(f)) for f in found]
            front += found.tolist()
    return [(int(every[i].view(np.int64)), int(every[j].view(np.int64))) for i, j in edges]


def links(points: DataFrame, threshold: int = 4, k: int = 15, block: int = BLOCK) -> DataFrame:
    """Edges (bits, other) whose connected components are those of all pairs within the threshold. points: distinct `bits`.

    No pair within the threshold is lost; of the pairs at one anchor, only a spanning forest is returned.
    """
    spark = points.sparkSession

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 1024):
                bits = batch.column(0).slice(at, 1024).to_numpy(zero_copy_only=False)
                places, sizes, homes = [], [], []
                for _, home, near in near_anchors(bits.view(np.uint64), k, threshold):
                    places.append(near)
                    sizes.append(len(near))
                    homes.append(near == home)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(places).astype(np.int32)), pa.array(np.repeat(bits, sizes)), pa.array(np.concatenate(homes))], names=["anchor", "bits", "home"]
                )

    copies = saved(points.select("bits").mapInArrow(spread, "anchor int, bits long, home boolean"), "anchors")
    # blocks of homes and of copies per anchor, from counts; almost everywhere there is one of each
    counts = copies.groupBy("anchor").agg(F.count_if("home").alias("homes"), F.count(F.lit(1)).alias("all"))
    counts = counts.where((F.col("homes") > 0) & (F.col("all") > 1)).select(
        "anchor", F.ceil(F.col("homes") / block).cast("int").alias("nh"), F.ceil(F.col("all") / block).cast("int").alias("nc")
    )
    dealt = copies.join(counts, "anchor")
    mix = F.xxhash64("bits")
    as_home = dealt.where("home").select("anchor", F.pmod(mix, "nh").cast("int").alias("h"), F.explode(F.sequence(F.lit(0), F.col("nc") - 1)).alias("c"), "bits", F.lit(True).alias("home"))
    as_copy = dealt.select("anchor", F.explode(F.sequence(F.lit(0), F.col("nh") - 1)).alias("h"), F.pmod(mix, "nc").cast("int").alias("c"), "bits", F.lit(False).alias("home"))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        bits, home = pdf["bits"].to_numpy().view(np.uint64), pdf["home"].to_numpy(bool)
        found = forest(np.unique(bits[home]), np.unique(bits[~home]), threshold)
        return pd.DataFrame(found, columns=["bits", "other"]).astype("int64")

    # anchors are handled many to a group: a group of one call each would cost more than the comparing
    many = 64

    def compare_many(pdf: pd.DataFrame) -> pd.DataFrame:
        out = [compare(g) for _, g in pdf.groupby(["anchor", "h", "c"], sort=False) if len(g) > 1]
        return pd.concat(out) if out else pd.DataFrame({"bits": [], "other": []}).astype("int64")

    single = (F.col("h") == 0) & (F.col("c") == 0)
    group = F.when(single, F.pmod(F.xxhash64("anchor"), F.lit(2**k // many))).otherwise(F.xxhash64("anchor", "h", "c"))
    both = as_home.unionAll(as_copy).withColumn("group", group)
    edges = both.groupBy("group").applyInPandas(compare_many, "bits long, other long")
    return saved(edges.distinct(), "edges") if spark else edges


def components(edges: DataFrame, label: DataFrame) -> DataFrame:
    """(bits, least): the smallest `least` over everything reachable through edges (bits, other). label: (bits, least), one row per node.

    Each round takes the minimum over neighbours and hooks the label's own node to it; rounds end when no label changes.
    """
    both = edges.select("bits", "other").unionAll(edges.select(F.col("other").alias("bits"), F.col("bits").alias("other"))).distinct()
    both = saved(both, "links")
    # parent: the node whose label is followed; a node's parent is the reachable node with the smallest (least, bits), nulls last
    root = F.struct(F.col("least").isNull().alias("none"), "least", "bits").alias("root")
    state = saved(label.join(both.select("bits").distinct(), "bits").select("bits", root), "roots")
    while True:
        around = both.join(state.select(F.col("bits").alias("other"), "root"), "other").groupBy("bits").agg(F.min("root").alias("near"))
        hooked = state.join(around, "bits", "left").select("bits", "root", F.least("root", "near").alias("new"))
        # the node that a label names may itself know a smaller one, and learns of the smallest its followers saw
        told = hooked.groupBy(F.col("root.bits").alias("bits")).agg(F.min("new").alias("told"))
        known = saved(hooked.join(told, "bits", "left").select("bits", "root", F.least("new", "told").alias("new")), "roots")
        discard(state)
        jump = known.select(F.col("bits").alias("__to"), F.col("new").alias("__new"))
        moved = known.join(jump, F.col("new.bits") == F.col("__to"), "left").select("bits", F.least("new", "__new").alias("root"), (F.least("new", "__new") != F.col("root")).alias("moved"))
        state = saved(moved, "roots")
        discard(known)
        if state.where("moved").isEmpty():
            discard(both)
            return state.select("bits", F.col("root.least").alias("least"))


def near_duplicates(docs: DataFrame, words: int = 4, threshold: int = 4, k: int = 15, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, bits and component_id (the smallest doc_id reachable through links of at most `threshold` bits) for every row."""
    prints = saved(fingerprints(docs, words, id_column, text_column), "fingerprints")
    points = saved(prints.groupBy("bits").agg(F.min("doc_id").alias("least")), "points")
    found = components(links(points, threshold, k), points)
    classes = points.join(found.withColumnRenamed("least", "reached"), "bits", "left").select("bits", F.coalesce("reached", "least").alias("component_id"))
    return prints.join(classes, "bits").select("doc_id", "bits", "component_id")
