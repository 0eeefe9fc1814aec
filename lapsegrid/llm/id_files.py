"""Operator 1, token-id files with Elias-Fano document boundaries.

A file set is a Parquet folder whose rows are segments in ascending document order. A segment holds the concatenated
ids of its documents as little-endian integers (16 bits wide where the vocabulary allows, else 32) and, instead of a
table of 64-bit offsets, the documents' boundaries in Elias-Fano form: the low bits of each offset packed at fixed
width, the high bits as a unary bit string, and the bit position of every 64th one, from which `select` finds any
offset by counting bits in a few bytes. That costs about two bits a document beyond log2(mean length).

Writing: documents are sorted by id in ranges (ties by text, so a repeated id is split between tasks), encoded and
written in order. A segment knows how many ids its part of the file set holds before it; the parts' totals, one number
per task, give the rest. Null ids come first. Null and empty texts are documents with the end id only. Repeated rows
are written as often as they come. An empty table makes an empty file set.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapsegrid.llm.common import shared_folder, slices
from lapsegrid.llm.tokens import coder

SEGMENT_IDS = 1_000_000
SAMPLE = 64
SEGMENTS = (
    "part int, place int, before long, n_docs long, n_ids long, width int, doc_ids array<long>, low_bits int, low binary, high binary, samples array<int>, ids binary"
)


@dataclass(frozen=True)
class Boundaries:
    """n ascending offsets in Elias-Fano form."""

    n: int
    low_bits: int
    low: bytes
    high: bytes
    samples: np.ndarray

    @classmethod
    def of(cls, offsets: np.ndarray) -> Boundaries:
        n = len(offsets)
        low_bits = max(0, int(offsets[-1]) // n).bit_length() - 1 if n and offsets[-1] >= n else 0
        low = offsets & ((1 << low_bits) - 1)
        ones = (offsets >> low_bits) + np.arange(n)
        bits = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        bits[ones] = 1
        packed = (low[:, None] >> np.arange(low_bits) & 1).astype(np.uint8).ravel()
        return cls(n, low_bits, np.packbits(packed, bitorder="little").tobytes(), np.packbits(bits, bitorder="little").tobytes(), ones[::SAMPLE].astype(np.int32))

    def select(self, i: int) -> int:
        """Offset i, read from a few bytes: from the sample before it, count ones up to the wanted one."""
        at = int(self.samples[i // SAMPLE])
        left = i % SAMPLE
        byte = at >> 3
        value = self.high[byte] >> (at & 7) << (at & 7)
        while (ones := value.bit_count()) <= left:
            left -= ones
            byte += 1
            value = self.high[byte]
        for _ in range(left):
            value &= value - 1
        place = 8 * byte + (value & -value).bit_length() - 1
        first = i * self.low_bits
        chunk = int.from_bytes(self.low[first >> 3 : (first + self.low_bits + 7) >> 3], "little")
        return (place - i) << self.low_bits | chunk >> (first & 7) & ((1 << self.low_bits) - 1)

    def all(self) -> np.ndarray:
        """Every offset, in one pass over the bits."""
        ones = np.flatnonzero(np.unpackbits(np.frombuffer(self.high, np.uint8), bitorder="little"))[: self.n]
        bits = np.unpackbits(np.frombuffer(self.low, np.uint8), bitorder="little")[: self.n * self.low_bits].reshape(self.n, self.low_bits)
        low = bits.astype(np.int64) @ (1 << np.arange(self.low_bits, dtype=np.int64))
        return (ones - np.arange(self.n)) << self.low_bits | low


def write_ids(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", end_id: int = 2, id_column: str = "doc_id", text_column: str = "text") -> str:
    """Writes a file set in the shared folder and returns its path."""
    ordered = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    ordered = ordered.repartitionByRange("id", F.xxhash64("text"), F.monotonically_increasing_id()).sortWithinPartitions("id", F.xxhash64("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, place, before = TaskContext.get().partitionId(), 0, 0
        code, end = coder(vocabulary), np.array([end_id], "<u4").tobytes()
        narrow = code.library.get_vocab_size() <= 2**16 and end_id < 2**16
        ids: list = []
        held: list[bytes] = []
        size = 0

        def segment() -> pa.RecordBatch:
            offsets = np.cumsum(np.r_[0, [len(x) // 4 for x in held]])
            bounds = Boundaries.of(offsets)
            flat = np.frombuffer(b"".join(held), "<u4")
            row = [part, place, before, len(held), int(offsets[-1]), 2 if narrow else 4, ids, bounds.low_bits, bounds.low, bounds.high, bounds.samples.tolist(), (flat.astype("<u2") if narrow else flat).tobytes()]
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names=[f.split()[0] for f in SEGMENTS.split(", ")])

        for batch in slices(batches):
            for i, x in zip(batch.column(0).to_pylist(), code.encode(batch.column(1).to_pylist()), strict=True):
                ids.append(i)
                held.append(x + end)
                size += len(x) // 4 + 1
                if size >= SEGMENT_IDS:
                    yield segment()
                    place, before, ids, held, size = place + 1, before + size, [], [], 0
        if held:
            yield segment()

    path = f"{shared_folder(docs.sparkSession)}/ids-{uuid.uuid4().hex}"
    ordered.mapInArrow(run, SEGMENTS).write.parquet(path)
    return path


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of a file set: doc_id, start (ids before it), n_tokens, ids (little-endian, 32 bits each)."""
    segments = spark.read.schema(SEGMENTS).parquet(path)
    totals = {r["part"]: r["n"] for r in segments.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()}  # a number for each task that wrote
    starts, at = {}, 0
    for part in sorted(totals):
        starts[part] = at
        at += totals[part]
    names = [f.split()[0] for f in SEGMENTS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                s = {n: batch.column(i)[row].as_py() for i, n in enumerate(names)}
                offsets = Boundaries(s["n_docs"] + 1, s["low_bits"], s["low"], s["high"], np.array(s["samples"])).all()
                flat = np.frombuffer(s["ids"], "<u2" if s["width"] == 2 else "<u4").astype("<u4").tobytes()
                edges = pa.array(4 * offsets, pa.int32())
                data = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, edges.buffers()[1], pa.py_buffer(flat)])
                first = starts[s["part"]] + s["before"]
                yield pa.RecordBatch.from_arrays([pa.array(s["doc_ids"], pa.int64()), pa.array(first + offsets[:-1]), pa.array(np.diff(offsets)), data], names=["doc_id", "start", "n_tokens", "ids"])

    return segments.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


