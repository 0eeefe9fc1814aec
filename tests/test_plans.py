"""The two-level plans give the same rows as plain windows, for any bucket width."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lapsegrid.plans import ranges, ranks, scan


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    data = []
    for key, n in (("hot", 400), ("cold", 7), ("one", 1)):
        frames = np.sort(rng.choice(1000, n, replace=False))
        for f in frames:
            value = None if rng.random() < 0.2 else float(rng.integers(0, 30))
            data.append((key, int(f), value, int(rng.random() < 0.3)))
    return spark.createDataFrame(data, "k string, t int, v double, b int")


@pytest.mark.parametrize("width", [3, 50, 5000])
def test_scan_two_levels_equal_one(rows, width):
    spec = dict(
        lag={"pv": "v", "pt": "t"}, lead={"nv": "v", "nt": "t"},
        running={"rs": ("sum", "b"), "rm": ("min", "v"), "rx": ("max", "v")},
        remaining={"ms": ("sum", "v")}, fill_forward={"ff": "v"}, fill_backward={"fb": "v"},
    )
    bucket = F.floor(F.col("t") / width).cast("long")
    one = scan.ordered_scan(rows, ["k"], ["t"], bucket, two_level=False, **spec)
    two = scan.ordered_scan(rows, ["k"], ["t"], bucket, two_level=True, **spec)
    assert sorted(map(str, one.collect())) == sorted(map(str, two.select(*one.columns).collect()))


def test_quantiles_and_ranks_two_levels_equal_one(rows, monkeypatch):
    wanted = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.9, "e": 1.0}
    one = {r["k"]: r for r in ranks.quantiles(rows, ["k"], "v", wanted, two_level=False).collect()}
    ranked = ranks.with_average_rank(rows, ["k"], "v", "r", {"ties": "n"}, two_level=False)
    plain = sorted(map(str, ranked.collect()))
    for limit in (2, 10_000):
        monkeypatch.setattr(ranks.value_positions, "__defaults__", (limit,))
        two = {r["k"]: r for r in ranks.quantiles(rows, ["k"], "v", wanted, two_level=True).collect()}
        assert one.keys() == two.keys()
        for k in one:
            for c in ("total", *wanted):
                assert one[k][c] == pytest.approx(two[k][c])
        again = ranks.with_average_rank(rows, ["k"], "v", "r", {"ties": "n"}, two_level=True)
        assert plain == sorted(map(str, again.select(*ranked.columns).collect()))


def test_setting_switches_to_two_levels(spark, rows):
    from lapsegrid.plans.heavy import LIMIT_SETTING, has_heavy_key

    assert not has_heavy_key(rows, ["k"])
    spark.conf.set(LIMIT_SETTING, "100")
    try:
        assert has_heavy_key(rows, ["k"])
    finally:
        spark.conf.unset(LIMIT_SETTING)


def test_overlap_join_gives_each_pair_once(spark):
    rng = np.random.default_rng(5)
    left = [("s", float(a), float(a + w)) for a, w in zip(rng.uniform(0, 50, 40), rng.uniform(0.1, 9, 40))]
    right = [("s", float(a), float(a + w)) for a, w in zip(rng.uniform(0, 50, 30), rng.uniform(0.1, 9, 30))]
    expected = sorted(
        (round(max(a, c), 9), round(min(b, d), 9)) for _, a, b in left for _, c, d in right if a < d and c < b
    )
    l = spark.createDataFrame(left, "k string, la double, lb double")
    r = spark.createDataFrame(right, "k string, ra double, rb double")
    for width in (0.7, 4.0, 100.0):
        got = ranges.overlap_join(l, r, ["k"], ("la", "lb"), ("ra", "rb"), width)
        assert sorted((round(x.lo, 9), round(x.hi, 9)) for x in got.collect()) == expected


@pytest.mark.parametrize("first", ["spread", "equal", "text"])
def test_a_crowded_key_is_cut_evenly(spark, first):
    """Nine tenths of the rows in one key, crowded into a short span, into one first value, or ordered by text: the stretches stay bounded."""
    n = 20_000
    first_value = {"spread": F.when(F.col("id") < 10, F.col("id") * 1e6).otherwise(F.col("id") / 1e6), "equal": F.lit(1.0), "text": F.concat(F.lit("same beginning "), F.col("id").cast("string"))}[first]
    rows = spark.range(n).select(F.lit("s").alias("stem"), F.when(F.col("id") % 10 == 0, F.col("id") % 7).otherwise(-1).alias("identity"), first_value.alias("at"), F.col("id"))
    spark.conf.set(scan.LIMIT_SETTING, "1000")
    try:
        cut = scan.ranged(rows, ["stem", "identity"], [F.col("at").desc_nulls_last(), F.col("id").asc()])
        sizes = [r["count"] for r in cut.groupBy("stem", "identity", scan.BUCKET).count().collect()]
        heavy = cut.where("identity = -1").groupBy(scan.BUCKET).count().count()
        placed = scan.numbered_by(rows, ["stem", "identity"], [F.col("at").desc_nulls_last(), F.col("id").asc()], "place", two_level=True)
        plain = scan.numbered_by(rows, ["stem", "identity"], [F.col("at").desc_nulls_last(), F.col("id").asc()], "place", two_level=False)
        assert placed.exceptAll(plain).isEmpty() and placed.count() == n
    finally:
        spark.conf.unset(scan.LIMIT_SETTING)
    assert heavy >= 30 and max(sizes) <= 1000


def test_order_by_any_columns_with_missing_values(spark):
    from lapsegrid.operators.features import stable_order

    rows = [("k", t, v, i) for i, (t, v) in enumerate([("b", 1.0), (None, 2.0), ("b", None), ("a", 5.0), ("b", 7.0), (None, None), ("c", 0.0)])]
    df = spark.createDataFrame(rows, "key string, t string, v double, id long")
    want = [r[3] for r in sorted(rows, key=lambda r: (r[1] is None, [-ord(c) for c in r[1] or ""], r[2] is None, r[2] or 0.0))]
    for limit in ("1000000", "1"):
        spark.conf.set(scan.LIMIT_SETTING, limit)
        got = stable_order(df, ["key"], ["-t", "v", "id"], "place").orderBy("place").collect()
        spark.conf.unset(scan.LIMIT_SETTING)
        assert [r["id"] for r in got] == want and [r["place"] for r in got] == list(range(1, 8))


def test_distance_map_is_the_nearest_place(spark):
    """Against all places, on fields higher than a tile, with ties, a lone place, and one owner with several places."""
    import random

    from lapsegrid.plans.distance import distance_map

    draw = random.Random(5)
    height, width = 70, 9
    places = [("a", f"f{k}", y, x, draw.choice(["p", "q", "r"])) for k in range(3) for y, x in {(draw.randrange(height), draw.randrange(width)) for _ in range((1, 4, 90)[k])}]
    df = spark.createDataFrame(places, "stem string, field string, y int, x int, owner string")
    got = {(r["field"], r["y"], r["x"]): (r["d2"], r["owner"]) for r in distance_map(df, ["stem", "field"], height, width).collect()}
    assert len(got) == 3 * height * width
    for (field, y, x), found in got.items():
        assert found == min(((y - p[2]) ** 2 + (x - p[3]) ** 2, p[4]) for p in places if p[1] == field)
