"""Helpers shared by the training-data operators: shared storage, bounded Arrow slices, row keys."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one step inside a task works on. A single longer text makes a step of its own.
SLICE_BYTES = 2_000_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Only a local session without one (tests) gets a folder of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("name a folder that driver and executors share in spark.checkpoint.dir")
    folder = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def saved(df: DataFrame, name: str) -> DataFrame:
    """df written once as Parquet in the shared folder and read back: lineage ends here, and a lost executor costs no recomputation."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.saved_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Removes what `saved` wrote for tables that no later plan reads, so a long job's disk does not grow with its rounds."""
    for df in tables:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.saved_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def slices(batches: Iterator[pa.RecordBatch], column: int = 1, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose strings (or binaries) in `column` hold at most `most` bytes together, or one row."""
    for batch in batches:
        texts = batch.column(column)
        n = len(batch)
        if not n:
            continue
        wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
        ends = np.frombuffer(texts.buffers()[1], dtype=np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
        at = 0
        while at < n:
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + most, side="right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def map_texts(docs: DataFrame, columns: list[Column], work: Callable[[list], list[pa.Array]], schema: str, text: int = 1, most: int = SLICE_BYTES) -> DataFrame:
    """`columns` of every row, and what `work` makes of the texts in column number `text`. Narrow: no shuffle.

    `work` takes a list of str or None and returns Arrow arrays of that length. The output holds the columns
    other than the text, then those arrays.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text, most):
            made = work(batch.column(text).to_pylist())
            rest = [batch.column(i) for i in range(batch.num_columns) if i != text]
            yield pa.RecordBatch.from_arrays([*rest, *made], names=[str(i) for i in range(len(rest) + len(made))])

    names = [f.split()[0] for f in schema.split(", ")]

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in run(batches):
            yield pa.RecordBatch.from_arrays(batch.columns, names=names)

    return docs.select(*columns).mapInArrow(named, schema)


def text_key(text: str = "text") -> list[Column]:
    """A key of the text alone: equal texts share it. Two hashes and the length, so unequal texts do not."""
    t = F.coalesce(F.col(text), F.lit(""))
    return [F.xxhash64(t).alias("__h"), F.xxhash64(F.lit(7), t).alias("__g"), F.octet_length(t).cast("long").alias("__n")]


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file lies; its folder is installed on every machine and is never copied."""
    import public_tokenizers

    return public_tokenizers.path(os.path.basename(name))


#: 64-bit words of a Bloom filter sent to tasks: 8 MB, whatever the input. A full filter passes everything; exact joins follow it.
BLOOM_WORDS = 2**20


def _bloom_places(keys: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        x = keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
    one = np.uint64(1)
    bits = (one << (x & np.uint64(63))) | (one << (x >> np.uint64(6) & np.uint64(63))) | (one << (x >> np.uint64(12) & np.uint64(63)))
    return (x >> np.uint64(20)) % np.uint64(words), bits


def blocked_bloom(keys: DataFrame, words: int = BLOOM_WORDS) -> np.ndarray:
    """A blocked Bloom filter (a block is one 64-bit word, three bits a key) over the one long column of `keys`.

    Tasks set bits, Spark combines words with bit_or, and at most `words` words reach the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled = np.zeros(words, np.uint64)
        for batch in batches:
            place, bits = _bloom_places(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), words)
            np.bitwise_or.at(filled, place.astype(np.int64), bits)
        used = np.flatnonzero(filled)
        for i in range(0, len(used), 50_000):
            part = used[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(filled[part].view(np.int64))], names=["word", "bits"])

    parts = keys.where(keys[keys.columns[0]].isNotNull()).mapInArrow(run, "word long, bits long")
    found = parts.groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(words, np.uint64)
    out[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return out


def bloom_hits(bloom: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which int64 keys may be in the filter."""
    place, bits = _bloom_places(keys, len(bloom))
    return bloom[place.astype(np.int64)] & bits == bits
