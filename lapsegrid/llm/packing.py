"""Operator 3, packing by first-fit decreasing in randomised groups.

Documents are dealt to groups at random (by a hash of task and row number, so equal rows spread and a repeated task
deals alike), some eight million bytes of text to a group. In a group, each document fills as many whole sequences as
it can; the rests are placed longest first, each in the first sequence with room, found by descending a tournament
tree whose nodes hold the largest room below them. Groups are independent: nothing is gathered beyond one.

Null and empty texts hold only the end id. Repeated rows are packed as often as they come. A text of any length is cut
into sequences inside one task. An empty table packs into nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapsegrid.llm.common import slices
from lapsegrid.llm.tokens import coder

#: Bytes of text in a group, on average.
GROUP_BYTES = 8_000_000


class Tournament:
    """First fit in logarithmic time: `room` of all bins in a complete binary tree of maxima."""

    def __init__(self, bins: int, capacity: int) -> None:
        self.size = 1 << max(0, bins - 1).bit_length()
        self.room = [capacity] * (2 * self.size)

    def place(self, need: int) -> int:
        """Takes `need` from the first bin with room, and returns its number. A bin always has room."""
        room, at = self.room, 1
        while at < self.size:
            at = 2 * at if room[2 * at] >= need else 2 * at + 1
        found = at - self.size
        room[at] -= need
        at //= 2
        while at:
            room[at] = max(room[2 * at], room[2 * at + 1])
            at //= 2
        return found


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset in it for each size."""
    tree = Tournament(len(sizes), capacity)
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    filled = np.zeros(len(sizes), np.int64)
    for i in np.argsort(-sizes, kind="stable").tolist():
        n = int(sizes[i])
        bins[i] = b = tree.place(n)
        offsets[i] = filled[b]
        filled[b] += n
    return bins, offsets


PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, capacity: int = 2048, vocabulary: str = "word_bpe_49k.json", end_id: int = 1, id_column: str = "doc_id", text_column: str = "text", group_bytes: int = GROUP_BYTES) -> DataFrame:
    """One row per piece, with its ids (little-endian, 32 bits each) and its place."""
    chosen = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    groups = 1 + (chosen.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0) // group_bytes

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, end = coder(vocabulary), np.array([end_id], "<u4").tobytes()
        draw, row = np.random.default_rng([3, TaskContext.get().partitionId()]), 0
        for batch in slices(batches):
            ids = [x + end for x in code.encode(batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(draw.integers(0, groups, len(ids))), pa.array(range(row, row + len(ids)), pa.int64()), batch.column(0), pa.array(ids, pa.binary())], names=["group", "row", "doc_id", "ids"])
            row += len(ids)

    def place(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("doc_id", "ascending"), ("row", "ascending")])
        ids = rows.column("ids").to_pylist()
        total = np.array([len(x) // 4 for x in ids], np.int64)
        whole = total // capacity
        doc = np.repeat(np.arange(len(ids)), whole)
        start = (np.arange(len(doc)) - np.repeat(np.cumsum(whole) - whole, whole)) * capacity
        rest = np.flatnonzero(total % capacity)
        bins, offsets = first_fit_decreasing((total % capacity)[rest], capacity)
        n_whole = len(doc)
        doc, start = np.r_[doc, rest], np.r_[start, (whole * capacity)[rest]]
        length = np.minimum(capacity, total[doc] - start)
        pieces = [ids[d][4 * s : 4 * (s + n)] for d, s, n in zip(doc.tolist(), start.tolist(), length.tolist(), strict=True)]
        sequence = key[0].as_py() * 2**32 + np.r_[np.arange(n_whole), n_whole + bins]
        doc_ids = rows.column("doc_id").combine_chunks().take(pa.array(doc))
        columns = [doc_ids, pa.array(start), pa.array(length), pa.array(pieces, pa.binary()), pa.array(total[doc]), pa.array(sequence), pa.array(np.r_[np.zeros(n_whole, np.int64), offsets])]
        return pa.table(columns, names=[f.split()[0] for f in PIECES.split(", ")])

    coded = chosen.mapInArrow(encode, "group long, row long, doc_id long, ids binary")
    return coded.groupBy("group").applyInArrow(place, PIECES)
