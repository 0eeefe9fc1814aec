"""Operators 11 to 13 against brute force on small tables with every odd case."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import pytest

from lapsegrid.llm import decontaminate, filter_audit, prefix_trie
from lapsegrid.llm.common import saved

DRAW = random.Random(3)
VOCAB = ["The", "of", "größe", "É", "x1", "Ab", "漢字", "don", "İ", "ß"]
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(n):
    return [DRAW.choice(VOCAB) + str(DRAW.randint(0, 30)) for _ in range(n)]


def split(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


ITEM = words(25)
SHARED = words(12)
BENCH = [
    (1, " ".join(ITEM)), (10, "prefix a b " + " ".join(SHARED)), (2, "other " + ", ".join(SHARED)), (3, "Only Four words here"), (4, ""), (5, None), (6, "..."), (None, " ".join(words(11))),
    (7, "one"), (1, " ".join(words(10))), (8, "a a a a a a a a a a"),
]
DOCS = [
    (1, None), (2, ""), (3, " ".join(words(300))), (4, " ".join(words(20) + ITEM[3:14] + words(9))), (5, "x " + "; ".join(w.upper() if w.isascii() else w for w in SHARED) + " y"),
    (6, "ONLY four-words\nhere only four words"), (7, " ".join(words(5) + ITEM + SHARED + words(5))), (8, "a " * 31), (None, BENCH[7][1]), (None, None), (9, "one two"), (7, "clean text"),
    (4, " ".join(words(20))), (11, " ".join(ITEM)), (11, " ".join(ITEM)), (12, " ".join(words(40_000) + ITEM + words(10))), (13, " ".join(ITEM[:9])),
]


def hit_words(text, n=10):
    """Hit positions and items, by plain search."""
    w, hit, items = split(text), set(), set()
    places = collections.defaultdict(list)
    for i, x in enumerate(w):
        places[x].append(i)
    for item, t in BENCH:
        b = split(t)
        size = min(n, len(b))
        for j in range(len(b) - size + 1 if b else 0):
            for i in places[b[j]]:
                if w[i : i + size] == b[j : j + size]:
                    hit |= set(range(i, i + size))
                    if item is not None:
                        items.add(str(item))
    return w, hit, sorted(items)


@pytest.mark.parametrize("block", [500_000, 7])
def test_contamination(spark, block):
    docs = saved(spark.createDataFrame([(i, t, "h", 1, 2) for i, t in DOCS], "doc_id long, text string, gram string, w int, at int").repartition(4), "docs")
    bench = spark.createDataFrame([(i, t, 0) for i, t in BENCH], "item_id long, text string, doc_id int")
    rows = decontaminate.contamination(docs, bench, block=block).collect()
    got = sorted((r["doc_id"] or -1, r["n_words"], r["n_hit"], r["n_items"], ",".join(r["items"])) for r in rows)
    want = []
    for i, t in DOCS:
        w, hit, items = hit_words(t)
        want.append((i or -1, len(w), len(hit), len(items), ",".join(items)))
    assert got == sorted(want)
    assert sum(r[2] for r in got) > 100


def test_contamination_of_empty_tables(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    assert decontaminate.contamination(docs.where("false"), bench).count() == 0
    rows = decontaminate.contamination(docs, bench.where("false")).collect()
    assert len(rows) == len(DOCS) and all(r["n_hit"] == 0 and r["items"] == [] and r["spans"] == [] for r in rows)


def test_decontaminate(spark):
    docs = spark.createDataFrame([(i, t, 5) for i, t in DOCS], "doc_id long, text string, __x int")
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    out = decontaminate.decontaminate(docs, bench)
    assert out.columns == docs.columns
    got = collections.Counter((r["doc_id"], tuple(split(r["text"]))) for r in out.collect())
    want = collections.Counter()
    for i, t in DOCS:
        w, hit, _ = hit_words(t)
        want[i, tuple(x for k, x in enumerate(w) if k not in hit)] += 1
    assert got == want
    kept = {(r["doc_id"], r["text"]) for r in out.collect()}
    assert {(i, t) for i, t in DOCS if not hit_words(t)[1]} <= kept
    dropped = decontaminate.decontaminate(docs, bench, "documents").collect()
    assert collections.Counter((r["doc_id"], r["text"]) for r in dropped) == collections.Counter((i, t) for i, t in DOCS if not hit_words(t)[1])


def brute_audit(docs, labels):
    marks = collections.defaultdict(lambda: [False, False])
    for i, q, t in labels:
        if i is not None:
            marks[i][0] |= q == 1
            marks[i][1] |= t == 1
    smallest = {}
    for i, t, _ in docs:
        if i is not None:
            smallest[t or ""] = min(i, smallest.get(t or "", i))
    parts = collections.defaultdict(list)
    for i, t, lang in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        mask = "".join(
            x for x, bad in zip("ABCDE", [len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), bool(re.search(r"[#$%&*|]", t)), i is not None and i > smallest[t]], strict=True) if bad
        )
        good, toxic = marks[i] if i in marks else (False, False)
        parts[lang or ""].append((mask, good, toxic))
    out = []
    for part, rows in parts.items():
        shapley, lines = collections.Counter(), []
        for order in map("".join, itertools.permutations("ABCDE")):
            for step, f in enumerate(order, 1):
                alive = [r for r in rows if not set(r[0]) & set(order[: step - 1])]
                gone = [r for r in alive if f in r[0]]
                shapley[f] += len(gone)
                fails = sum(f in r[0] for r in rows)
                lines.append((part, order, step, len(alive) - len(gone), len(gone), fails - len(gone), sum(r[0] == f for r in rows), sum(r[1] for r in gone), sum(r[2] for r in gone), f))
        out += [(*x[:-1], shapley[x[-1]]) for x in lines]
    return sorted(out)


def test_filter_audit(spark):
    long_ = " ".join(f"w{i}" for i in range(230))
    texts = [None, "", " \n", long_, long_, long_ + " #", "UPPER CASE " * 120, "a b " * 150, long_.upper(), "short & sweet", "short", "short", "é" * 300, " ".join(words(9_000))]
    docs = [(i, t, DRAW.choice(["en", None, "", "de"])) for i, t in enumerate(texts * 3)]
    docs += [(None, "short", "en"), (None, None, None), (4, long_, "en"), (4, "other", "fr"), (4, "other", "fr"), (-5, "short", "fr")]
    labels = [(i, DRAW.choice([0, 1, None]), DRAW.choice([0, 1])) for i in range(0, 40, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (999, 1, 1)]
    d = spark.createDataFrame([(*r, 1, 2) for r in docs], "doc_id long, text string, lang string, mask int, rank int").repartition(3)
    m = spark.createDataFrame([(*r, 3) for r in labels], "doc_id long, quality int, toxic int, n int")
    got = sorted(tuple(r) for r in filter_audit.filter_audit(d, m).collect())
    assert got == brute_audit(docs, labels)
    assert filter_audit.filter_audit(d.where("false"), m).count() == 0
    assert {r[0] for r in filter_audit.filter_audit(d, m.where("false")).collect()} == {r[2] or "" for r in docs}


def test_intervals_cover_each_removal_once():
    for n in (1, 3, 4):
        orders = list(itertools.permutations(range(n)))
        found = collections.Counter((mask, rank, step) for mask, step, lo, hi in filter_audit.intervals(n) for rank in range(lo, hi))
        want = {(mask, rank, 1 + next(k for k, f in enumerate(order) if mask >> f & 1)) for mask in range(1, 2**n) for rank, order in enumerate(orders)}
        assert set(found) == want and max(found.values()) == 1


def brute_trie(rows):
    turns = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            turns[c].append((turn is not None, turn or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32], (role, text)))
    own = {c: [t[-1] for t in sorted(x)] for c, x in turns.items()}
    full = {}
    for c, x in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c > 0 else -1)
        full[c] = tuple(own.get(base, [])[:h] + x[h:])
    members = collections.defaultdict(list)
    for c, path in full.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    children = collections.Counter(p[:-1] for p in members if p)
    leaves, saved_ = collections.Counter(), collections.Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved_[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    return sorted(
        (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved_[p], sha(",".join(map(str, sorted(c for c in m if full[c] == p))))) for p, m in members.items()
    )


def conversations():
    rows = []
    for c in [0, 1, 2, 3, 99, 100, 101, 105, 250, 251, 252, -100, -101, -7, 300, 301, 302, 303, 304, 500]:
        for turn in range(DRAW.randint(1, 8)):
            rows.append((c, turn, DRAW.choice(["user", None]), DRAW.choice(["hi", "", None, "é漢", "long text"])))
    rows += [(c, t, "user", f"t{t}") for c in (600, 601, 603, 650) for t in range(120)]
    rows += [(c, t, "user", "same") for c in range(700, 760) for t in range(4)]
    rows += [(2, None, "user", "first"), (2, 0, "b", "tie"), (2, 0, "a", "tie"), (3, 1, "user", "hi"), (3, 1, "user", "hi"), (None, 0, "user", "lost"), (801, 0, "u", "short"), (803, 5, None, None)]
    DRAW.shuffle(rows)
    return rows


@pytest.mark.parametrize(("piece", "crowd"), [(50_000, 20_000), (3, 2)])
def test_prefix_trie(spark, piece, crowd):
    rows = conversations()
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], "conv_id long, turn long, role string, text string, depth int, key string").repartition(4)
    c = prefix_trie.F.col("conv_id")
    paths = prefix_trie.rebuilt(df, c - c % 100, (prefix_trie.F.crc32(c.cast("string")) % 6).cast("int"), 5)
    got = sorted((tuple(r)[:-1] for r in prefix_trie.trie(paths, piece, crowd).collect()), key=repr)
    assert got == sorted(brute_trie(rows), key=repr)
    assert max(r[1] for r in got) >= 120


def test_prefix_trie_of_few(spark):
    df = spark.createDataFrame([(5, 0, "u", "t")], "conv_id long, turn long, role string, text string")
    assert prefix_trie.prefix_trie(df.where("false")).count() == 0
    got = [tuple(r)[:-1] for r in prefix_trie.prefix_trie(df).collect()]
    assert sorted(got, key=repr) == sorted(brute_trie([(5, 0, "u", "t")]), key=repr)
