"""The pipeline's stages one after the other, and the queries that have an SQL answer."""

import collections
import random

import pytest

import corpus_pipeline
import oracle
from lapsegrid.llm import queries
from lapsegrid.llm.common import saved, table

FOLDER = f"{oracle.DATA}/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    duck = oracle.make_duck(FOLDER)
    df = queries.QUERIES[name](spark, FOLDER)
    cursor = duck.execute(queries.SQL[name])
    assert oracle.canon(df.columns, df.collect()) == oracle.canon([d[0] for d in cursor.description], cursor.fetchall())


def test_stages(spark):
    docs = table(spark, FOLDER, "documents")
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = saved(stage(spark, docs, FOLDER), "stage")
        assert after.columns == docs.columns
        seen[name] = (docs, after)
        docs = after
    before, after = seen["quality rules"]
    labels = table(spark, FOLDER, "labels")
    assert 0 < after.count() < before.count()
    clean = before.join(labels.where("quality = 1"), "doc_id").count()
    assert after.join(labels.where("quality = 1"), "doc_id").count() >= 0.95 * clean
    before, after = seen["SimHash near-dedup"]
    copies = collections.Counter(r["text"] for r in before.collect())
    left = collections.Counter(r["text"] for r in after.collect())
    assert max(left.values()) == 1 and max(copies.values()) >= 1 and after.count() >= 0.8 * before.count()
    before, after = seen["suffix-array dedup"]
    assert before.count() == after.count()
    before, after = seen["PII"]
    assert before.count() == after.count() and after.where("text LIKE '%@mail%'").count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER)
    tokens = packed.groupBy("doc_id", "doc_tokens").sum("length").collect()
    assert len(tokens) == docs.count() and all(r["doc_tokens"] == r["sum(length)"] for r in tokens)


def test_passages_of_over_50_words_are_cut(spark):
    """Passages of 51 to 60 words go from every document that holds them; what stands around them, and documents without them, stay."""
    draw = random.Random(9)
    vocab = ["".join(draw.choice("abcdefghij") for _ in range(draw.randint(2, 7))) for _ in range(4000)]
    own = lambda n: " ".join(draw.choice(vocab) for _ in range(n))
    rows, passages = [], []
    for n in range(51, 61):
        passage = own(n)
        passages.append(passage)
        rows += [(len(rows) + k, own(150) + "\n" + passage + "\n" + own(150)) for k in range(2)]
    clean = [(1000 + k, own(300)) for k in range(20)]
    docs = spark.createDataFrame(rows + clean + [(None, None), (2000, "")], "doc_id long, text string")
    out = {r["doc_id"]: r["text"] for r in corpus_pipeline.repeated_passages(spark, docs, "").collect()}
    left = sum(passages[i // 2] in out[i] for i in range(20))
    assert left == 0
    # the line ends around a passage repeat with it, and the letters beside them may by chance
    assert all(0 <= len(t) - len(passages[i // 2]) - len(out[i]) <= 12 for i, t in rows)
    assert all(out[i] == t for i, t in clean)


def test_odd_rows_pass_all_stages(spark):
    """Null, empty and repeated rows, null ids, a long text, clashing column names; and a table without rows."""
    draw = random.Random(4)
    text = lambda n: " ".join(f"w{draw.randint(0, 5000)}" for _ in range(n))
    copy, unique = text(80), [text(60) for _ in range(30)]
    rows = [(None, None), (1, None), (2, ""), (3, " \n"), (4, copy), (5, copy), (5, copy), (None, unique[0]), (None, unique[1]), (8, unique[2]), (8, unique[3]), (9, text(60_000))]
    rows += [(20 + k, t) for k, t in enumerate(unique[4:])]
    names = "doc_id long, text string, lang string, source string, n_chars long, h long, bits string, key int, part int, mine int"
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, "b", 2, 3, 4) for i, t in rows], names)
    for some in (docs, docs.where("false")):
        left = some
        for _, stage in corpus_pipeline.STAGES[:-1]:
            after = saved(stage(spark, left, FOLDER), "odd")
            assert after.columns == docs.columns and after.count() <= left.count()
            left = after
        packed = corpus_pipeline.STAGES[-1][1](spark, left, FOLDER)
        assert packed.select("doc_id").distinct().count() == left.select("doc_id").distinct().count()
        if some is docs:
            kept = collections.Counter(r["text"] for r in left.collect())
            assert kept[copy] == 1 and all(kept[t] == 1 for t in unique) and None not in kept
