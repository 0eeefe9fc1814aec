"""Operator 9, approximate nearest neighbours by a forest of random-projection trees.

The forest is fitted on a bounded sample: each node splits its sample at the median of a random direction. Every row is
indexed in one leaf of each tree. A query walks all trees with one priority queue ordered by the distance to the
nearest split it would have to cross, until it has seen `leaves` leaves. Rows and queries meet by leaf (a leaf of more
than `block` rows is dealt to several tasks, each of which gets the leaf's queries), each leaf hands back a query's best
rows with exact cosines in double precision, and the best of all leaves are ranked.

Equal vectors are indexed once with their smallest ids, as many as an answer can hold. Vectors that are null, zero, hold
null or non-finite components, or have another length than most vectors of the table take no part, as queries neither. Rows repeating an id and vector count once.
Ties go to the smaller id. Fewer candidates than asked for: all that the leaves hold, and a small table is one leaf.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lapsegrid.llm.common import saved


@dataclass(frozen=True)
class ForestSettings:
    """sample: most rows that the forest is fitted on. leaf: most of them in a leaf. leaves: leaves that a query sees. block: rows of a leaf in one task."""

    trees: int = 16
    sample: int = 65_536
    leaf: int = 512
    leaves: int = 110
    block: int = 8192
    seed: int = 9


@dataclass(frozen=True)
class Forest:
    """Nodes of all trees in one list: direction, threshold, children. Leaves have child -1; roots come first."""

    direction: np.ndarray
    threshold: np.ndarray
    child: np.ndarray
    trees: int

    @classmethod
    def fit(cls, sample: np.ndarray, s: ForestSettings) -> Forest:
        draw = np.random.default_rng(s.seed)
        unit = sample / np.linalg.norm(sample, axis=1, keepdims=True) if len(sample) else sample
        direction, threshold, child = [np.zeros(sample.shape[1])] * s.trees, [0.0] * s.trees, [[-1, -1] for _ in range(s.trees)]
        work = [(t, np.arange(len(unit))) for t in range(s.trees)]
        while work:
            node, rows = work.pop()
            if len(rows) <= s.leaf:
                continue
            d = draw.standard_normal(unit.shape[1])
            d /= np.linalg.norm(d)
            at = unit[rows] @ d
            cut = float(np.median(at))
            near = at <= cut
            if near.all():  # one point many times over
                continue
            direction[node], threshold[node] = d, cut
            for side, part in ((0, rows[near]), (1, rows[~near])):
                child[node][side] = len(child)
                direction.append(np.zeros(unit.shape[1]))
                threshold.append(0.0)
                child.append([-1, -1])
                work.append((child[node][side], part))
        return cls(np.array(direction), np.array(threshold), np.array(child), s.trees)

    def leaves_of(self, unit: np.ndarray) -> np.ndarray:
        """(rows, trees): the leaf of each row in each tree."""
        out = np.empty((len(unit), self.trees), np.int64)
        for t in range(self.trees):
            at = np.full(len(unit), t)
            while True:
                inner = np.flatnonzero(self.child[at, 0] >= 0)
                if not len(inner):
                    break
                node = at[inner]
                far = np.einsum("ij,ij->i", unit[inner], self.direction[node]) > self.threshold[node]
                at[inner] = self.child[node, far.astype(np.int64)]
            out[:, t] = at
        return out

    def search(self, unit: np.ndarray, leaves: int) -> list[int]:
        """The first leaves that one queue over all trees yields, nearest split first."""
        margin = self.direction @ unit - self.threshold
        queue = [(0.0, t) for t in range(self.trees)]
        found: list[int] = []
        while queue and len(found) < leaves:
            bound, node = heapq.heappop(queue)
            while self.child[node, 0] >= 0:
                m = float(margin[node])
                side = int(m > 0)
                heapq.heappush(queue, (max(bound, abs(m)), int(self.child[node, 1 - side])))
                node = int(self.child[node, side])
            found.append(int(node))
        return found


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(-1, size)


def scaled(x: np.ndarray) -> np.ndarray:
    """Each vector times a power of two that brings its largest component near 1: no square under- or overflows, and no bit of a cosine changes."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, initial=0.0))[1][:, None])


def usable(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", size: int | None = None) -> tuple[DataFrame, int]:
    """(vec_id, v) of vectors that take part, and their length: the one given, or that of most."""
    v = F.col(vector_column)
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), v.alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = rows.where(finite & F.exists("v", lambda x: x != 0))
    if size is None:
        sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
        size = sizes["n"] if sizes else 0
    return rows.where(F.size("v") == size), size


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, settings: ForestSettings = ForestSettings(), id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for each row of queries, which is a part of vectors."""
    rows, size = usable(vectors, id_column, vector_column)
    asked = usable(queries, id_column, vector_column, size)[0].distinct()
    spark = vectors.sparkSession
    # equal vectors: one point with the k + 1 smallest ids, one of which may be the query's own
    rank = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    points = rows.distinct().withColumn("r", rank).where(F.col("r") <= k + 1).groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    points = saved(points, "points")
    n = points.count()
    every = -(-n // settings.sample) if n else 1
    sample = points.where(F.pmod(F.xxhash64("v"), F.lit(every)) == 0).select("v").limit(2 * settings.sample).toArrow()["v"].combine_chunks()
    forest = Forest.fit(scaled(_matrix(sample, size)) if n else np.zeros((0, 1)), settings)
    shipped = spark.sparkContext.broadcast(forest)
    trees, budget = settings.trees, settings.leaves

    def unit(x: np.ndarray) -> np.ndarray:
        x = scaled(x)
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 1000):
                batch = whole.slice(at, 1000)
                leaf = shipped.value.leaves_of(unit(_matrix(batch.column(0), size)))
                take = pa.array(np.repeat(np.arange(len(batch)), trees))
                yield pa.RecordBatch.from_arrays([pa.array(leaf.ravel()), batch.column(0).take(take), batch.column(1).take(take)], names=["leaf", "v", "ids"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 1000):
                batch = whole.slice(at, 1000)
                found = [shipped.value.search(q, budget) for q in unit(_matrix(batch.column(1), size))]
                take = pa.array(np.repeat(np.arange(len(batch)), [len(f) for f in found]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).astype(np.int64)), batch.column(0).take(take), batch.column(1).take(take)], names=["leaf", "query_id", "v"])

    kind = dict(points.dtypes)["v"]
    indexed = points.select("v", "ids").mapInArrow(index, f"leaf long, v {kind}, ids array<long>")
    probes = asked.mapInArrow(probe, f"leaf long, query_id long, v {kind}")
    # rows of a leaf: as many numbers as the forest has leaves, which the sample bounds
    counts = indexed.groupBy("leaf").count().withColumn("blocks", F.ceil(F.col("count") / settings.block)).select("leaf", "blocks")
    counts = F.broadcast(counts)
    indexed = indexed.join(counts, "leaf").withColumn("block", F.pmod(F.xxhash64("v"), "blocks")).drop("blocks")
    probes = probes.join(counts, "leaf").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).drop("blocks")

    def best(q: pa.Table, x: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if len(q) and len(x):
            qs, xs = (scaled(_matrix(t.column("v").combine_chunks(), size)) for t in (q, x))
            lengths = np.linalg.norm(xs, axis=1)
            ids = x.column("ids").to_pylist()
            least = np.array([i[0] for i in ids])
            scores = qs @ xs.T / (np.linalg.norm(qs, axis=1)[:, None] * lengths)
            want = min(len(xs), k + 1)
            for row, (own, vector) in enumerate(zip(q.column("query_id").to_pylist(), qs, strict=True)):
                s = scores[row]
                edge = np.partition(s, len(s) - want)[len(s) - want] - 1e-12
                near = np.flatnonzero(s >= edge)
                exact = [(float((vector * xs[j]).sum() / (np.sqrt((vector * vector).sum()) * np.sqrt((xs[j] * xs[j]).sum()))), j) for j in near[np.lexsort((least[near], -s[near]))].tolist()]
                named = sorted((-e, i) for e, j in exact for i in ids[j] if i != own)[:k]
                out += [(own, i, -e) for e, i in named]
        names = ("query_id", "vec_id", "score")
        return pa.table({c: pa.array([o[p] for o in out], t) for p, (c, t) in enumerate(zip(names, (pa.int64(), pa.int64(), pa.float64()), strict=True))})

    found = probes.groupBy("leaf", "block").cogroup(indexed.groupBy("leaf", "block")).applyInArrow(best, "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
