"""Null and repeated ids in near-duplicate classes."""

import corpus_pipeline
from lapsegrid.llm import simhash


def test_null_id_takes_the_id_of_its_class(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3)], "bits long, other long")
    label = spark.createDataFrame([(1, None), (2, 70), (3, 50)], "bits long, least long")
    assert {r["bits"]: r["least"] for r in simhash.components(edges, label).collect()} == {1: 50, 2: 50, 3: 50}


def test_no_text_is_lost_by_its_id(spark):
    a, b, c, d = (" ".join(f"{n}{i}" for i in range(60)) for n in "abcd")
    rows = [(None, a, "u"), (None, d, "u"), (5, b, "u"), (5, c, "u"), (6, b, "u"), (None, b + " more", "u"), (7, c, "u"), (7, c, "v"), (None, None, "u"), (None, "", "u"), (9, " ", "u")]
    kept = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string, url string"), "")
    assert sorted((r["doc_id"] or 0, (r["text"] or "").strip()) for r in kept.collect()) == sorted([(0, a), (0, d), (5, b), (5, c), (9, "")])
