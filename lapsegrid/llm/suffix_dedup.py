"""Operator 10, suffix-array dedup by distributed prefix doubling.

A byte goes if a string of `length` bytes that covers it also starts anywhere else. Ranks of positions are
fingerprints of the bytes around them, and Spark groups position rank pairs at growing offsets, dropping positions
once their rank is unique:

1. offset 40: every `length`-byte window names one position, the last smallest hashed 40-gram in it. That choice
   depends on the window's content only, so equal windows name equal positions. A 40-gram that Spark counts once
   ends all windows that name it.
2. offset 200, half of `length`: the pair of that rank and the rank of the 200 bytes after the position (windows that
   begin less than 200 bytes before it) or before it (the others) is counted likewise.
3. offset `length` and more: the run of windows that name the position from one side is ranked as a whole. A run
   that occurs twice is repeated in full.
4. Different runs under one pair are compared window by window: inside a task where a pair has few runs, otherwise
   as rows of window ranks that Spark counts, so a hot pair is split.

So the suffix array is sparse: all windows are judged, but only the named positions become rows (about one in 180
bytes). Ranks are 64-bit fingerprints; equal strings share one always, unequal ones with a chance near 2**-64.

Null and empty texts lose nothing. Equal texts of at least `length` bytes vanish. Repeated rows count as separate
documents. Texts of any size are cut into overlapping stretches inside the task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapsegrid.llm.common import blocked_bloom, bloom_hits, discard, saved, slices

GRAM = 40
#: Bytes of one step; some twelve arrays of as many 64-bit values are held at once.
STRETCH = 2**19 - 4096
#: Different runs under one pair beyond which their windows are counted as rows.
FEW_RUNS = 4096
_BASE = 0x9E3779B97F4A7C15 | 1


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    size = 1
    with np.errstate(over="ignore"):
        while size < n:
            step = np.uint64(pow(base, size, 2**64))
            out[size : 2 * size] = out[: min(size, n - size)] * step
            size *= 2
    return out


class _Tables:
    """Powers of the base and of its inverse modulo 2**64, and a random value for each byte. Built once per worker."""

    ready: _Tables | None = None

    def __init__(self) -> None:
        self.up = _powers(_BASE, STRETCH + 2**13)
        self.down = _powers(pow(_BASE, -1, 2**64), STRETCH + 2**13)
        self.byte = np.random.default_rng(10).integers(1, 2**63, 256, dtype=np.uint64)

    @classmethod
    def get(cls) -> _Tables:
        cls.ready = cls.ready or cls()
        return cls.ready


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Ranks:
    """Ranks of any substrings of one stretch of bytes."""

    def __init__(self, data: np.ndarray) -> None:
        t = _Tables.get()
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(t.byte[data] * t.up[: len(data)], out=self.sums[1:])
        self.down = t.down

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[end] - self.sums[begin]) * self.down[begin])

    def every(self, size: int) -> np.ndarray:
        return _mixed((self.sums[size:] - self.sums[:-size]) * self.down[: len(self.sums) - size])


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each `width` consecutive values, from running minima of blocks in both directions."""
    n = len(x)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = x
    blocks = padded.reshape(-1, width)
    after = np.minimum.accumulate(blocks, axis=1).ravel()
    before = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(before[: n - width + 1], after[width - 1 : n])


def named_runs(data: np.ndarray, limits: np.ndarray, length: int) -> tuple[Ranks, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ranks, and for each run of windows that name one position: document, first and last window start, position.

    limits: where each document of the stretch begins, and the end of the last.
    """
    ranks = Ranks(data)
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return ranks, none, none, none, none
    mask = np.uint64(2**20 - 1)
    grams = ranks.every(GRAM)
    grams = (grams & ~mask) | (mask - np.arange(len(grams), dtype=np.uint64))
    place = (mask - (sliding_least(grams, length - GRAM + 1) & mask)).astype(np.int64)
    sizes = np.diff(limits)
    room = np.maximum(0, sizes - length + 1)
    doc = np.repeat(np.arange(len(sizes)), room)
    start = np.arange(len(doc)) - np.repeat(np.cumsum(room) - room, room) + np.repeat(limits[:-1], room)
    if not len(start):
        return ranks, none, none, none, none
    at = place[start]
    new = np.r_[True, (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])]
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(start)] - 1
    return ranks, doc[first], start[first], start[last], at[first]


def stretches(batch: pa.RecordBatch, length: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """(first row, bytes, limits, offset in the row): whole rows together, or overlapping stretches of one long row. Column 0 holds the bytes."""
    texts = batch.column(0)
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(batch) + 1].astype(np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    if len(batch) > 1 or ends[-1] - ends[0] <= STRETCH:
        yield 0, data[ends[0] : ends[-1]], ends - ends[0], 0
        return
    step = STRETCH - length + 1
    for at in range(0, max(1, int(ends[1] - ends[0]) - length + 1), step):
        part = data[ends[0] + at : min(ends[1], ends[0] + at + STRETCH)]
        yield 0, part, np.array([0, len(part)]), at


def _bytes_first(docs: DataFrame, text_column: str, *rest: Column) -> DataFrame:
    return docs.select(F.coalesce(F.col(text_column), F.lit("")).cast("binary").alias("__b"), *rest)


def _key(text_column: str) -> list[Column]:
    text = F.coalesce(F.col(text_column), F.lit(""))
    return [F.xxhash64(text).alias("h"), F.xxhash64(F.lit(7), text).alias("g")]


def repeated_grams(docs: DataFrame, length: int, text_column: str) -> DataFrame:
    """Ranks at offset 40 that at least two runs of windows share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 0, STRETCH):
            for _, data, limits, _ in stretches(batch, length):
                ranks, _, _, _, at = named_runs(data, limits, length)
                yield pa.RecordBatch.from_arrays([pa.array(ranks.of(at, at + GRAM).view(np.int64))], names=["gram"])

    return _bytes_first(docs, text_column).mapInArrow(run, "gram long").groupBy("gram").count().where("count > 1").select("gram")


RUN_SCHEMA = "h long, g long, id long, pair long, run long, first long, last long"


def ranked_runs(docs: DataFrame, bloom: np.ndarray, length: int, id_column: str, text_column: str) -> DataFrame:
    """One row per run and side of its position: rank pair at offset 200, rank of the whole run, window starts."""
    shipped = docs.sparkSession.sparkContext.broadcast(bloom)
    half = length // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 0, STRETCH):
            key = [batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3)]
            for _, data, limits, offset in stretches(batch, length):
                ranks, doc, first, last, at = named_runs(data, limits, length)
                gram = ranks.of(at, at + GRAM)
                hit = bloom_hits(shipped.value, gram.view(np.int64))
                doc, first, last, at, gram = doc[hit], first[hit], last[hit], at[hit], gram[hit]
                for side in (0, 1):
                    lo, hi = (np.maximum(first, at - half + 1), last) if side else (first, np.minimum(last, at - half))
                    ok = lo <= hi
                    d, a, b, p = doc[ok], lo[ok], hi[ok], at[ok]
                    around = ranks.of(p, p + half) if side else ranks.of(p - half, p)
                    pair = _mixed(gram[ok] ^ (around * np.uint64(3)) ^ np.uint64(side + 1))
                    whole = _mixed(ranks.of(a, b + length) ^ ((p - a).astype(np.uint64) << np.uint64(32)) ^ (b - a).astype(np.uint64))
                    cols = [*(k[d] for k in key), pair.view(np.int64), whole.view(np.int64), a - limits[d] + offset, b - limits[d] + offset]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=[x.split()[0] for x in RUN_SCHEMA.split(", ")])

    number = F.coalesce(F.col(id_column).cast("long"), F.lit(-(2**63)))
    return _bytes_first(docs, text_column, *_key(text_column), number.alias("id")).mapInArrow(run, RUN_SCHEMA)


def window_ranks(content: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(which content, offset in it, rank) of every window of the given stretches of bytes."""
    which, offset, rank, group, size = [], [], [], [], 0

    def flush() -> None:
        sizes = np.array([len(content[i]) for i in group], np.int64)
        begin = np.cumsum(sizes) - sizes
        room = sizes - length + 1
        rel = np.arange(room.sum()) - np.repeat(np.cumsum(room) - room, room)
        start = rel + np.repeat(begin, room)
        rank.append(Ranks(np.frombuffer(b"".join(content[i] for i in group), np.uint8)).of(start, start + length))
        which.append(np.repeat(np.array(group), room))
        offset.append(rel)

    for i, c in enumerate(content):
        if group and size + len(c) > STRETCH:
            flush()
            group, size = [], 0
        group.append(i)
        size += len(c)
    if group:
        flush()
    return np.concatenate(which), np.concatenate(offset), np.concatenate(rank)


def _spans(which: np.ndarray, offset: np.ndarray, length: int, keys: list[np.ndarray]) -> pd.DataFrame:
    """Maximal covered stretches of the flagged windows, `which` and `offset` ascending."""
    new = np.r_[True, (which[1:] != which[:-1]) | (offset[1:] > offset[:-1] + length)] if len(which) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(which)] - 1 if len(which) else first
    w = which[first]
    return pd.DataFrame({"pair": keys[0][w], "run": keys[1][w], "lo": offset[first], "hi": offset[last] + length})


def compared_runs(contents: DataFrame, length: int) -> DataFrame:
    """Which stretches of each run's bytes lie in windows that another run under the same pair also holds: (pair, run, lo, hi).

    contents: pair, run, n_runs and the run's bytes `content`; a row may come more than once.
    """

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates(["pair", "run"])
        keys = [pdf["pair"].to_numpy(), pdf["run"].to_numpy()]
        which, offset, rank = window_ranks(pdf["content"].tolist(), length)
        rank = rank ^ _mixed(keys[0].view(np.uint64))[which]
        order = np.argsort(rank)
        same = rank[order][1:] == rank[order][:-1]
        flags = np.zeros(len(rank), bool)
        flags[order] = np.r_[same, False] | np.r_[False, same]
        return _spans(which[flags], offset[flags], length, keys)

    few = contents.where(F.col("n_runs") <= FEW_RUNS).withColumn("part", F.pmod(F.xxhash64("pair"), F.col("parts")))
    in_tasks = few.groupBy("part").applyInPandas(compare, "pair long, run long, lo long, hi long")

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2, 100_000):
            which, offset, rank = window_ranks(batch.column(2).to_pylist(), length)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(which)), batch.column(1).take(pa.array(which)), pa.array(offset), pa.array(rank.view(np.int64))], names=["pair", "run", "lo", "rank"]
            )

    many = contents.where(F.col("n_runs") > FEW_RUNS).select("pair", "run", "content").mapInArrow(explode, "pair long, run long, lo long, rank long")
    runs = many.groupBy("pair", "rank").agg(F.min("run").alias("least"), F.max("run").alias("most")).where("least <> most").select("pair", "rank")
    as_rows = many.join(runs, ["pair", "rank"]).select("pair", "run", "lo", (F.col("lo") + length).alias("hi")).distinct()
    return in_tasks.unionAll(as_rows)


def repeated_spans(docs: DataFrame, length: int = 400, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(h, g, spans): for each text key with repeats, its covered stretches of bytes, as an array of (lo, hi); they may overlap."""
    if length < 2 * GRAM:
        raise ValueError(f"passages shorter than {2 * GRAM} bytes are not searched")
    bloom = blocked_bloom(repeated_grams(docs, length, text_column))
    rows = saved(ranked_runs(docs, bloom, length, id_column, text_column), "runs")
    runs = rows.groupBy("pair", "run").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("h", "g", "id", "first", "last")).alias("sample"))
    pairs = runs.groupBy("pair").agg(F.sum("copies").alias("all"), F.count(F.lit(1)).alias("n_runs"))
    runs = saved(runs.join(pairs.where(F.col("all") > 1), "pair"), "pairs")
    whole = runs.where(F.col("copies") > 1).select("pair", "run", F.lit(0).cast("long").alias("lo"), (F.col("sample.last") - F.col("sample.first") + length).alias("hi"))
    unclear = runs.where(F.col("n_runs") > 1)
    parts = max(1, unclear.count() // 1000)
    wanted = unclear.groupBy("sample.h", "sample.g", "sample.id").agg(F.collect_list(F.struct("pair", "run", "n_runs", F.col("sample.first").alias("first"), F.col("sample.last").alias("last"))).alias("wanted"))
    number = F.coalesce(F.col(id_column).cast("long"), F.lit(-(2**63))).alias("id")
    held = docs.select(F.coalesce(F.col(text_column), F.lit("")).cast("binary").alias("b"), *_key(text_column), number)
    held = held.where(F.octet_length("b") >= length).join(wanted, ["h", "g", "id"]).select("b", F.explode("wanted").alias("w"))
    contents = held.select("w.pair", "w.run", "w.n_runs", F.lit(parts).alias("parts"), F.substring(F.col("b"), F.col("w.first").cast("int") + 1, (F.col("w.last") - F.col("w.first") + length).cast("int")).alias("content"))
    found = saved(compared_runs(contents, length).unionAll(whole), "found")
    discard(runs)
    spans = rows.select("h", "g", "pair", "run", "first").distinct().join(found, ["pair", "run"])
    spans = spans.select("h", "g", (F.col("first") + F.col("lo")).alias("lo"), (F.col("first") + F.col("hi")).alias("hi")).distinct()
    spans = saved(spans.groupBy("h", "g").agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("spans")), "spans")
    discard(rows, found)
    return spans


def united(spans: list | None) -> list[list[int]]:
    """Maximal stretches of sorted (lo, hi) pairs."""
    out: list[list[int]] = []
    for s in spans or []:
        lo, hi = s["lo"], s["hi"]
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return out


def with_spans(docs: DataFrame, length: int = 400, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Every row of docs, all its columns, and a last column __spans of stretches to remove (null: none)."""
    spans = repeated_spans(docs, length, id_column, text_column).select(F.col("h").alias("__h"), F.col("g").alias("__g"), F.col("spans").alias("__spans"))
    h, g = _key(text_column)
    return docs.join(spans, (h == F.col("__h")) & (g == F.col("__g")), "left").select(*[docs[c] for c in docs.columns], "__spans")


def without_repeats(docs: DataFrame, length: int = 400, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of docs with repeated passages cut out of the text; n_chars, if there, follows. A character cut in part stays whole."""
    marked = with_spans(docs, length, id_column, text_column)
    at = docs.columns.index(text_column)
    chars = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def cut(text: str | None, spans: list | None) -> str | None:
        if not spans or text is None:
            return text
        data, out, done = text.encode(), [], 0
        for lo, hi in united(spans):
            while lo < hi and data[lo] & 0xC0 == 0x80:
                lo += 1
            while hi > lo and hi < len(data) and data[hi] & 0xC0 == 0x80:
                hi -= 1
            out.append(data[done:lo])
            done = hi
        return b"".join([*out, data[done:]]).decode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, at):
            n = batch.num_columns - 1
            texts = [cut(t, s) for t, s in zip(batch.column(at).to_pylist(), batch.column(n).to_pylist(), strict=True)]
            cols = [batch.column(i) for i in range(n)]
            cols[at] = pa.array(texts, cols[at].type)
            if chars is not None:
                cols[chars] = pa.array([None if t is None else len(t) for t in texts], pa.int64()).cast(cols[chars].type)
            yield pa.RecordBatch.from_arrays(cols, names=batch.schema.names[:n])

    return marked.mapInArrow(run, docs.schema)
