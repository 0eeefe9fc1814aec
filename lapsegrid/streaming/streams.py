"""Observations arriving over time: pooled ingest, window roll-ups and presence sessions."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from lapsegrid.plans.durable import shared_folder


def file_stream(spark: SparkSession, pattern: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(pattern)


def pooled_ingest(stream: DataFrame, grain: Sequence[str], time: str, delay: str) -> DataFrame:
    """Each observation once, whichever delivery came first, remembered for as long as rows may be late."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(grain))


def window_rollup(stream: DataFrame, keys: Sequence[str], time: str, value: str, width: str, delay: str) -> DataFrame:
    """Count, mean and extremes per key and event-time window; rows later than the watermark are dropped and a
    closed window never changes."""
    w = F.window(time, width)
    return stream.withWatermark(time, delay).groupBy(*keys, w.alias("w")).agg(
        F.count(F.lit(1)).alias("observations"), F.sum(value).alias("total"), F.min(value).alias("least"), F.max(value).alias("greatest")
    )


def presence_sessions(stream: DataFrame, keys: Sequence[str], time: str, gap: str, delay: str) -> DataFrame:
    """Presence bouts: a session closes once nothing was seen for ``gap``."""
    s = F.session_window(time, gap)
    return stream.withWatermark(time, delay).groupBy(*keys, s.alias("w")).agg(F.count(F.lit(1)).alias("observations"), F.min(time).alias("first_at"), F.max(time).alias("last_at"))


def run_available(result: DataFrame, name: str) -> DataFrame:
    """Process what is there into a table of the shared folder, in append mode, and read the table back. Offsets
    and state live beside it, so a lost executor or a restart repeats no row."""
    spark = result.sparkSession
    folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    q = (
        result.writeStream.format("parquet").option("path", f"{folder}/table").option("checkpointLocation", f"{folder}/state")
        .outputMode("append").trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return spark.read.schema(result.schema).parquet(f"{folder}/table")
