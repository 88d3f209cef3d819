import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from recoup.operators import bands, ranks


@pytest.fixture(scope="module")
def rows(spark):
    rnd = random.Random(7)
    # A third of the rows share one value, and one group holds most rows.
    data = [(i, "a" if i % 4 else "b", 5.0 if i % 3 == 0 else (None if i % 17 == 0 else round(rnd.uniform(0, 50), 1)))
            for i in range(600)]
    return spark.createDataFrame(data, "id bigint, g string, x double"), data


def test_bucketed_quantiles_equal_builtin(rows):
    df, _ = rows
    probs = [0.0, 0.05, 0.5, 0.77, 1.0]
    a = {(r["g"], r["p"]): r["q"] for r in ranks.exact_quantiles(df, ["x"], probs, ["g"]).collect()}
    b = {(r["g"], r["p"]): r["q"] for r in ranks.exact_quantiles(df, ["x"], probs, ["g"], rows_per_task=20).collect()}
    assert a.keys() == b.keys() and len(a) == 10
    for k in a:
        assert a[k] == b[k]


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("rows_per_bucket", [10, 10_000])
def test_cumulate_places_nulls_alike(spark, descending, rows_per_bucket):
    data = [(None if i % 10 == 0 else float(i % 83), 1) for i in range(200)]
    df = spark.createDataFrame(data, "x double, k int").groupBy("x").agg(F.sum("k").alias("n"))
    got = {r["x"]: r["upto"] for r in ranks.cumulate(df, "x", {"upto": "n"}, (), descending, rows_per_bucket).collect()}
    assert got[None] == (200 if descending else 20)
    for x, upto in got.items():
        if x is not None:
            assert upto == sum(y is not None and (y >= x if descending else y <= x) for y, _ in data) + (0 if descending else 20)


@pytest.mark.parametrize("rows_per_bucket", [25, 100, 100_000])
def test_positions_with_nulls_and_a_hot_value_among_others(spark, rows_per_bucket):
    rnd = random.Random(3)
    data = [(i, None if i % 9 == 0 else 25.0 if rnd.random() < 0.6 else rnd.uniform(20, 30)) for i in range(1500)]
    df = spark.createDataFrame(data, "id bigint, x double")
    got = sorted((r["pos"], r["id"]) for r in ranks.ordered_position(df, "x", "id", "pos", rows_per_bucket=rows_per_bucket).collect())
    want = [i for i, x in sorted(data, key=lambda d: (d[1] is not None, d[1] or 0.0, d[0]))]
    assert got == list(enumerate(want, 1))


def test_many_bounds_are_bisected(spark):
    bounds = [float(i) * 1.5 for i in range(ranks.TREE_BOUNDS + 37)]
    xs = [None, -1.0, 0.0, 0.1, 1.5, 1.6, 300.0, 804.0, 805.0, 1e9, float("nan")]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    many = [r[0] for r in df.select(ranks.bucket_of(F.col("x"), bounds)).collect()]
    want = [-1 if x is None else len(bounds) if x != x else sum(b < x for b in bounds) for x in xs]
    assert many == want
    assert [r[0] for r in df.select(ranks.bucket_of(F.col("x"), bounds[:30])).collect()] == [min(w, 30) for w in want]


@pytest.mark.parametrize("descending", [False, True])
def test_cumulate_over_buckets(rows, descending):
    df, data = rows
    c = ranks.cumulate(ranks.value_counts(df, "x", ["g"]), "x", {"upto": "n"}, ["g"], descending, rows_per_bucket=10)
    for r in c.collect():
        xs = [x for _, g, x in data if g == r["g"] and x is not None]
        assert r["upto"] == sum(x >= r["x"] if descending else x <= r["x"] for x in xs)


def digests(ids, seed):
    return sorted(ids, key=lambda i: hashlib.md5(f"{i}-{seed}".encode()).hexdigest())


def test_smallest_whole_set(rows):
    df, data = rows
    for n in (0, 1, 77, 599, 600, 900):
        got = {r["id"] for r in ranks.smallest(df, "id", "s", n, rows_per_bucket=30).collect()}
        assert got == set(digests([d[0] for d in data], "s")[:n])


def test_smallest_per_group(spark, rows):
    df, data = rows
    quota = spark.createDataFrame([("a", 100), ("b", 1000)], "g string, quota bigint")
    got = ranks.smallest(df, "id", "s", quota, ["g"], rows_per_bucket=20).collect()
    want = set(digests([d[0] for d in data if d[1] == "a"], "s")[:100]) | {d[0] for d in data if d[1] == "b"}
    assert {r["id"] for r in got} == want and len(got) == len(want)


def test_positions_with_a_hot_value(rows):
    df, data = rows
    df = df.fillna(0.0)
    want = {i: p + 1 for p, (_, i) in enumerate(sorted((x or 0.0, i) for i, _, x in data))}
    got = {r["id"]: r["pos"] for r in ranks.ordered_position(df, "x", "id", "pos", rows_per_bucket=40).collect()}
    assert got == want
    sh = {r["id"]: r["position"] for r in ranks.shuffled_position(df, "id", "s", rows_per_bucket=30).collect()}
    assert [i for i, _ in sorted(sh.items(), key=lambda t: t[1])] == digests([d[0] for d in data], "s")


def test_average_rank(rows):
    df, data = rows
    xs = np.array([x for _, _, x in data if x is not None])
    for r in ranks.average_rank(df, "x").collect():
        assert r["rank"] == (xs < r["x"]).sum() + ((xs == r["x"]).sum() + 1) / 2


def test_cut_rules(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (1.5,), (2.0,), (3.0,), (3.1,), (-1.0,), (None,)], "x double")
    b = [0, 1, 2, 3]
    assert [r[0] for r in df.select(bands.cut("x", b)).collect()] == [None, 1, 2, 2, 3, None, None, None]
    assert [r[0] for r in df.select(bands.cut("x", b, True)).collect()] == [1, 1, 2, 2, 3, None, None, None]


def test_edges_collapse(spark):
    df = spark.createDataFrame([(1.0,)] * 8 + [(2.0,), (3.0,)], "x double")
    assert bands.edges(df, "x", 4) == [1.0, 3.0]


def test_supplied_edges_keep_low_values(spark):
    df = spark.createDataFrame([(1.0,), (10.0,), (25.0,), (99.0,)], "x double")
    got = [r[0] for r in df.select(bands.supplied("x", [5, 15, 30, 50], "b")).collect()]
    assert got == ["b2", "b1", "b2", None]


def test_lookup_is_open_at_both_ends(spark):
    df = spark.createDataFrame([(-5.0,), (1.0,), (7.0,)], "x double")
    assert [r[0] for r in df.select(bands.lookup("x", [(1.0, "lo"), (5.0, "mid"), (None, "hi")])).collect()] == ["lo", "mid", "hi"]


def test_totals_named_like_the_summed_columns_but_for_case(spark):
    df = spark.createDataFrame([(i % 3, i * 0.5, i % 2, 1 - i % 2) for i in range(200)], "f long, s double, g long, b long")
    whole = ranks.cumulate(df, "s", {"G": "g", "B": "b"}, ["f"], descending=True)
    cut = ranks.cumulate(df, "s", {"G": "g", "B": "b"}, ["f"], descending=True, rows_per_bucket=20)
    assert cut.columns == whole.columns == ["f", "s", "G", "B"]
    assert sorted(map(tuple, cut.collect())) == sorted(map(tuple, whole.collect()))
