"""The corpus pipeline: documents in, packed training sequences out. Each stage is one operator of lapsegrid.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lapsegrid.llm import packing, pii, quality, similar, suffix_dedup
from lapsegrid.llm.common import saved, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule or repeat themselves go."""
    return quality.keep_by_quality(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of texts with five-word shingles of similarity 0.8 or more the smallest id stays."""
    return similar.keep_one(docs)


#: Bytes of a repeated passage. 51 words with their blanks take more, unless they have less than three letters on average.
PASSAGE = 200


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of PASSAGE bytes or more that also stand elsewhere, in the same document or another, are cut out of all of them. No row goes; null and empty texts stay as they are."""
    return suffix_dedup.without_repeats(docs, PASSAGE)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data give way to the name of their kind."""
    return pii.redact(docs, pii.fit_on(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their ids, and their places in training sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_rules), ("SimHash near-dedup", near_duplicates), ("suffix-array dedup", repeated_passages), ("PII", personal_data), ("packing", packed),
]

#: Suffix arrays, fingerprints, boosted trees and packing have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
