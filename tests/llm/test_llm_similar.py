"""The pipeline's near-duplicate stage against all pairs."""

import collections
import random

import corpus_pipeline
from lapsegrid.llm import similar

SCHEMA = "doc_id long, text string, url string"


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def alike(a, b):
    return a == b or 5 * len(a & b) >= 4 * len(a | b)


def brute(texts):
    """Class number of each text."""
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if alike(sets[i], sets[j]):
                root[find(i)] = find(j)
    return [find(i) for i in range(len(sets))]


def planted():
    """Originals, each with copies whose similarity runs from about 0.75 to 0.97, and chains of copies of copies."""
    draw = random.Random(3)
    texts = []
    for n in range(40):
        words = [f"w{draw.randint(0, 3000)}" for _ in range(draw.randint(60, 500))]
        texts.append(" ".join(words))
        for share in (0.004, 0.01, 0.015, 0.02, 0.022, 0.025, 0.03):
            copy = list(words)
            for at in draw.sample(range(len(words)), max(1, round(share * len(words)))):
                copy[at] = f"new{draw.randint(0, 10**9)}"
            texts.append(" ".join(copy))
            words = copy if n % 4 == 0 else words
    return texts


def test_pairs_from_similarity_0_8_are_found_and_no_others(spark):
    texts = planted()
    bands = collections.Counter()
    for i in range(0, len(texts), 8):
        a = shingles(texts[i])
        for t in texts[i + 1 : i + 8]:
            b = shingles(t)
            bands[int(20 * len(a & b) / len(a | b))] += 1
    assert min(bands[b] for b in (16, 17, 18)) >= 10 and bands[15] >= 5  # 0.8, 0.85, 0.9; some below
    least = {}
    for i, c in enumerate(brute(texts)):
        least[c] = min(least.get(c, i), i)
    docs = spark.createDataFrame([(i, t, "u") for i, t in enumerate(texts)], SCHEMA)
    kept = corpus_pipeline.near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(least.values())
    small = similar.classes(docs, block=3).select("first.id").distinct().collect()
    assert sorted(r["id"] for r in small) == sorted(least.values())


def test_fingerprints_propose_pairs(spark):
    """Points of one fingerprint meet its first point; first points of fingerprints up to four bits apart meet; others do not."""
    prints = {b"a": 0, b"b": 0, b"c": 0b1111, b"d": 0b11111 << 40, b"e": -1}
    points = spark.createDataFrame([(bytearray(k), v) for k, v in prints.items()], "bits binary, print long")
    got = {(bytes(r.bits), bytes(r.other)) for r in similar._by_fingerprint(points).collect()}
    assert got == {(b"a", b"b"), (b"a", b"c")}


def test_a_fingerprint_alone_links_nothing(spark):
    """Reordered words in short texts: whatever their bits, only the sets' similarity counts."""
    texts = ["", None, "one two three four five six", "one two three four five six seven", "six five four three two one"]
    docs = spark.createDataFrame([(n, t, "") for n, t in enumerate(texts)], SCHEMA)
    assert sorted(r.doc_id for r in similar.keep_one(docs).collect()) == [0, 2, 3, 4]
