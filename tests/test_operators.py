import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from recoup.operators import (backtest, components, evaluate, gram, joins, logit, neighbours, outliers, profile, quality,
                              sampling)
from recoup.sources import stores


@pytest.fixture(scope="module")
def six(spark):
    return spark.createDataFrame([(1.0, 1), (0.8, 1), (0.6, 1), (0.4, 0), (0.2, 1), (0.0, 0)], "pr double, good int")


def test_roc_of_six_rows(six):
    r = {x["score"]: (x["tpr"], x["fpr"]) for x in evaluate.roc(six, "pr", "good").collect()}
    assert [r[s] for s in (1.0, 0.8, 0.6, 0.4, 0.2, 0.0)] == [(0.25, 0), (0.5, 0), (0.75, 0), (0.75, 0.5), (1, 0.5), (1, 1)]
    a = evaluate.auc(six, "pr", "good").first()
    assert a["auc"] == pytest.approx(7 / 8) and a["gini"] == pytest.approx(3 / 4)


def test_tied_scores_share_their_rank(spark):
    df = spark.createDataFrame([(0.5, 1), (0.5, 0), (0.5, 1), (0.5, 0)], "pr double, good int")
    assert evaluate.auc(df, "pr", "good").first()["auc"] == pytest.approx(0.5)


def test_interval_join_equals_brute_force(spark):
    rnd = random.Random(3)
    xs = [(i, 10.0, 10.0) if i % 3 == 0 else (i, v, v + rnd.uniform(0, 9)) for i, v in ((i, rnd.uniform(0, 100)) for i in range(150))]
    ys = [(j, v, v + rnd.uniform(0, 20)) for j, v in ((j, rnd.uniform(-10, 100)) for j in range(40))]
    x = spark.createDataFrame(xs, "i bigint, a double, b double")
    y = spark.createDataFrame(ys, "j bigint, c double, d double")
    got = [(r["i"], r["j"]) for r in joins.overlap(x, y, "i", "a", "b", "c", "d", rows_per_cell=10).collect()]
    want = {(i, j) for i, a, b in xs for j, c, d in ys if a <= d and c <= b}
    assert len(got) == len(set(got)) and set(got) == want


def test_join_guard(spark):
    x = spark.createDataFrame([(1,), (1,), (1,), (None,)], "k int")
    assert joins.join_size(x, x, ["k"]) == 9
    with pytest.raises(ValueError):
        joins.guarded(x, x, ["k"])
    assert joins.guarded(x, x, ["k"], allow_cartesian=True).count() == 9


def points(n, seed=5):
    rnd = random.Random(seed)
    return [(i, [1.0, 1.0] if i % 3 == 0 else [float(rnd.randint(0, 15)), float(rnd.randint(0, 15))], i % 2, i % 5) for i in range(n)]


def brute(train, query, k, exclude=False, folds=False):
    out = {}
    for qi, qv, _, qf in query:
        c = sorted((math.dist(qv, tv), ti) for ti, tv, _, tf in train if not (exclude and ti == qi) and not (folds and tf == qf))
        out[qi] = [i for _, i in c[:k]]
    return out


@pytest.mark.parametrize("exclude,folds", [(False, False), (True, False), (False, True)])
def test_neighbours_equal_brute_force(spark, exclude, folds):
    data = points(240)
    df = spark.createDataFrame(data, "id bigint, v array<double>, label int, f int")
    nb = neighbours.knn(df, df, "id", "v", 7, exclude_self=exclude, avoid="f" if folds else None, chunk=15, pivots=6)
    got = {}
    for r in nb.orderBy("id", "rank").collect():
        got.setdefault(r["id"], []).append((round(r["dist"], 9), r["neighbour"]))
    want = brute(data, data, 7, exclude, folds)
    vec = {i: v for i, v, _, _ in data}
    for q, ids in want.items():
        assert [i for _, i in sorted(got[q])] == [i for _, i in sorted((round(math.dist(vec[q], vec[i]), 9), i) for i in ids)]


def test_vote_ties_go_to_the_smallest_label(spark):
    nb = spark.createDataFrame([(1, 1, 10), (1, 2, 11), (1, 3, 12)], "id bigint, rank int, neighbour bigint")
    lab = spark.createDataFrame([(10, 2), (11, 1), (12, 2)], "id bigint, y int")
    v = {r["k"]: r["pred"] for r in neighbours.vote(nb, lab, "id", "y", [1, 2, 3]).collect()}
    assert v == {1: 2, 2: 1, 3: 2}


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(0)
    n = 400
    x = rng.normal(size=(n, 12))
    x[:, 1] = 0.6 * x[:, 0] + 0.8 * x[:, 1]
    y = 1.0 + x[:, 0] - 2 * x[:, 1] + 0.5 * x[:, 2] + rng.normal(size=n)
    z = (rng.uniform(size=n) < 1 / (1 + np.exp(-(0.3 + x[:, 0] - x[:, 2])))).astype(int)
    rows = [(i, *map(float, x[i]), float(y[i]), int(z[i]), i % 4) for i in range(n)]
    schema = "id bigint, " + ", ".join(f"x{j} double" for j in range(12)) + ", y double, z int, fold int"
    return spark.createDataFrame(rows, schema).cache(), x, y, z


COLS = [f"x{j}" for j in range(12)]


def test_moments_two_ways_and_fold_sums(table):
    df, x, y, _ = table
    small, big = gram.moments(df, COLS[:3] + ["y"]), gram.moments(df, COLS + ["y"])
    assert np.allclose(small.block(COLS[:3], COLS[:3]), big.block(COLS[:3], COLS[:3]))
    d = x - x.mean(axis=0)
    assert np.allclose(big.block(COLS, COLS), d.T @ d)
    parts = gram.group_moments(df, COLS + ["y"], "fold")
    total = gram.pool(list(parts.values()))
    assert np.allclose(total.s, big.s) and total.n == 400
    assert np.allclose(total.minus(parts[0]).s, gram.moments(df.filter("fold <> 0"), COLS + ["y"]).s)


def test_least_squares_against_mllib(table):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression
    df, x, y, _ = table
    f = gram.ols(gram.moments(df, COLS + ["y"]), "y", COLS)
    ml = LinearRegression(labelCol="y", solver="normal").fit(VectorAssembler(inputCols=COLS, outputCol="features").transform(df))
    assert np.allclose(f.b, ml.coefficients.toArray(), atol=1e-6) and f.intercept == pytest.approx(ml.intercept, abs=1e-6)
    assert f.summary()["r2"] == pytest.approx(ml.summary.r2, abs=1e-9)
    assert np.allclose([c["p"] for c in f.coefficients()][1:], ml.summary.pValues[:-1], atol=1e-6)
    lev = gram.influence(df, f).agg(F.sum("leverage"), F.sum("resid")).first()
    assert lev[0] == pytest.approx(13, abs=1e-6) and lev[1] == pytest.approx(0, abs=1e-6)


def test_shrinkage_and_components_reach_least_squares(table):
    df = table[0]
    m = gram.moments(df, COLS + ["y"])
    b = gram.ols(m, "y", COLS).b
    for alpha in (0.0, 1.0):
        assert np.allclose(gram.penalised(m, "y", COLS, 0.0, alpha)[1], b, atol=1e-6)
    assert np.allclose(gram.component_regression(m, "y", COLS, 12)[1], b)
    assert np.allclose(gram.partial_least_squares(m, "y", COLS, 12)[1], b, atol=1e-5)
    top = gram.lambda_path(m, "y", COLS)[0]
    assert np.abs(gram.penalised(m, "y", COLS, top * 1.0001, 1.0)[1]).max() == 0
    e = df.agg(F.avg(F.pow(F.col("y") - gram.ols(m, "y", COLS).prediction(), F.lit(2)))).first()[0]
    assert gram.hold_out_mse(m, "y", COLS, gram.ols(m, "y", COLS).intercept, b) == pytest.approx(e)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_best_subsets_equal_full_enumeration(seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(200, 12)) @ (np.eye(12) + 0.4 * rng.normal(size=(12, 12)))
    x[:, 11] = x[:, 0] + x[:, 1]  # follows from the others
    y = x[:, :5] @ rng.normal(size=5) + 2 * rng.normal(size=200)
    names = [f"c{i}" for i in range(12)]
    z = np.column_stack([x, y])
    c = z - z.mean(0)
    m = gram.Moments(200.0, [*names, "y"], z.mean(0), c.T @ c)
    free = gram.independent(m, names)
    assert free == names[:11]
    for k, got in enumerate(gram.best_subsets(m, "y", free, 11), 1):
        want = min(itertools.combinations(free, k), key=lambda s: gram.ols(m, "y", s).rss)
        assert sorted(got) == sorted(want)


def test_selection_methods_agree_on_clear_signal(table):
    m = gram.moments(table[0], COLS[:6] + ["y"])
    for method in ("exhaustive", "forward", "backward"):
        t = gram.selection(m, "y", COLS[:6], method)
        assert t[2]["variables"] == "x0,x1,x2"
        assert all(a["r2"] <= b["r2"] + 1e-12 for a, b in zip(t, t[1:]))


def test_logistic_against_mllib(table):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GeneralizedLinearRegression
    df = table[0]
    f = logit.fit(df, "z", COLS[:4])
    ml = GeneralizedLinearRegression(family="binomial", labelCol="z", tol=1e-10).fit(
        VectorAssembler(inputCols=COLS[:4], outputCol="features").transform(df))
    assert np.allclose(f.beta[1:], ml.coefficients.toArray(), atol=1e-5)
    assert f.deviance == pytest.approx(ml.summary.deviance, abs=1e-5)
    assert np.allclose([c["se"] for c in f.coefficients()], np.roll(ml.summary.coefficientStandardErrors, 1), atol=1e-5)
    parts = logit.fit_many(df, "z", [logit.Spec(COLS[:2], skip_fold=1), logit.Spec(COLS[:2])], fold="fold")
    assert parts[0].n == 300 and parts[1].n == 400
    alone = logit.fit(df.filter("fold <> 1"), "z", COLS[:2])
    assert np.allclose(parts[0].beta, alone.beta, atol=1e-7)


def test_stepwise_finds_the_signal(table):
    best, trace = logit.stepwise(table[0], "z", COLS[:5], "both", math.log(400))
    assert {"x0", "x2"} <= set(best.x)
    assert all(a["aic"] > b["aic"] for a, b in zip(trace, trace[1:]))


def test_components_sum_to_the_number_of_columns(table):
    p = components.fit_pca(table[0], COLS)
    assert p.values.sum() == pytest.approx(12)
    v = p.project(table[0]).agg(*[F.var_samp(f"PC{j}") for j in (1, 12)]).first()
    assert v[0] == pytest.approx(p.values[0]) and v[1] == pytest.approx(p.values[11])


def test_replicates_cover_every_row(spark):
    df = spark.range(500).withColumnRenamed("id", "k")
    r = sampling.replicates(df, "k", 9)
    per = r.groupBy("rep").agg(F.count("*").alias("n"), F.sum("w").alias("s")).collect()
    assert len(per) == 9 and all(x["n"] == 500 and 400 < x["s"] < 600 for x in per)


def test_bootstrap_curve_surrounds_the_curve(spark):
    rnd = random.Random(1)
    cases = spark.createDataFrame([(i, 100.0 + i) for i in range(200)], "CaseId bigint, TOA double")
    pay = spark.createDataFrame([(i, m, rnd.uniform(0, 10)) for i in range(200) for m in range(1, 13)], "CaseId bigint, Month int, Payment double")
    real = {r["Month"]: r["SR"] for r in backtest.curve(pay, cases).collect()}
    for r in backtest.bootstrap(pay, cases, 60).collect():
        assert r["Q05"] <= real[r["Month"]] <= r["Q95"] and r["SR"] == pytest.approx(real[r["Month"]], rel=0.02)


def test_esd_removes_planted_outliers(spark):
    rnd = random.Random(2)
    df = spark.createDataFrame([(rnd.gauss(0, 1),) for _ in range(200)] + [(50.0,), (-60.0,)], "x double")
    steps = outliers.esd_steps(df, "x", 5)
    assert [round(s["value"]) for s in steps[:2]] == [-60, 50]
    assert sum(s["R"] > s["critical"] for s in steps) == 2
    assert outliers.grubbs(df, "x")["outlier"]


def test_stability_of_equal_and_disjoint_sets(spark):
    a = spark.createDataFrame([(float(i), "x") for i in range(200)], "v double, c string")
    same = {r["variable"]: r["psi"] for r in profile.stability(a, a, ["v", "c"]).collect()}
    assert same == {"v": 0.0, "c": 0.0}
    other = {r["variable"]: r["psi"] for r in profile.stability(a, a.withColumn("c", F.lit("y")), ["v", "c"]).collect()}
    assert other["c"] == math.inf


def test_empirical_fill_by_join_equals_lookup(spark, monkeypatch):
    df = spark.createDataFrame([(i, None if i % 5 == 0 else i % 7) for i in range(300)], "k bigint, v int")
    a = {r["k"]: r["v"] for r in quality.empirical_fill(df, "v", "k", "s").collect()}
    monkeypatch.setattr(quality, "LOOKUP_ROWS", 2)
    b = {r["k"]: r["v"] for r in quality.empirical_fill(df, "v", "k", "s").collect()}
    assert a == b and None not in a.values() and len(b) == 300


def test_group_fill_leaves_groups_without_values(spark):
    df = spark.createDataFrame([(1, "a", 2.0), (2, "a", None), (3, "b", None)], "k bigint, g string, v double")
    assert {r["k"]: r["v"] for r in quality.group_fill(df, "v", ["g"]).collect()} == {1: 2.0, 2: 2.0, 3: None}
    assert quality.group_fill(df, "v", ["g"], drop_unmatched=True).count() == 2


def test_csv_round_trip(spark):
    df = spark.createDataFrame([(1, 1.5, "a"), (2, None, "b"), (3, 12345678.25, "c")], "k bigint, x double, s string")
    path = stores.scratch(spark, "csv")
    stores.write_csv(df, path)
    assert "1,5" in "".join(r[0] for r in spark.read.text(path).collect())
    assert {tuple(r) for r in stores.read_csv(spark, path, df.schema).collect()} == {tuple(r) for r in df.collect()}


@pytest.mark.parametrize("reach", [None, 8])
def test_bootstrap_votes_equal_a_search_of_every_bag(spark, reach):
    df = spark.createDataFrame(points(90), "id bigint, v array<double>, label int, f int").drop("f")
    got = {(r["id"], r["rep"], r["k"]): r["pred"] for r in neighbours.bootstrap_votes(df, "id", "v", "label", [1, 5, 9], 2, reach).collect()}
    want = {}
    reps = sampling.replicates(df, "id", 2)
    for b in (1, 2):
        bag, oob = reps.filter((F.col("rep") == b) & (F.col("w") > 0)), reps.filter((F.col("rep") == b) & (F.col("w") == 0))
        votes = neighbours.vote(neighbours.knn(bag, oob, "id", "v", 9), bag, "id", "label", [1, 5, 9], weight="w")
        want |= {(r["id"], b, r["k"]): r["pred"] for r in votes.collect()}
    assert got == want and len({b for _, b, _ in got}) == 2


def test_the_bootstrap_of_neighbours_takes_thirty_replicates(spark, monkeypatch):
    from recoup.plans import queries
    seen, votes = [], neighbours.bootstrap_votes
    monkeypatch.setattr(neighbours, "bootstrap_votes", lambda *a: seen.append(a[5]) or votes(*a[:5], 1))
    queries()["m8_knn_bootstrap"](spark, "/root/testdata/sf0.001")
    assert seen == [30]


def test_cluster_sweeps_run_every_size_of_the_reference(spark, monkeypatch):
    from recoup.operators import models
    from recoup.plans import queries
    seen = {}
    monkeypatch.setattr(models, "cluster_sweep", lambda d, ks, fit: seen.update({fit.__name__: list(ks)}))
    for name in ("m3_hierarchical_groups", "m4_gaussian_mixture"):
        queries()[name](spark, "/root/testdata/sf0.001")
    assert seen == {"hierarchical": list(range(2, 31)), "mixture": list(range(2, 31))}


def test_debt_without_benchmark_cases_is_an_error(spark):
    val = spark.createDataFrame([(i, 100.0 * (1 + i % 10), i % 2) for i in range(40)], "CaseId bigint, TOA double, Pckg int")
    ben = spark.createDataFrame([(100 + i, 100.0 * (1 + i % 10)) for i in range(40)], "CaseId bigint, TOA double")
    pay = spark.createDataFrame([(i, m, 1.0) for i in [*range(40), *range(100, 140)] for m in range(1, 13)], "CaseId bigint, Month int, Payment double")
    assert backtest.matched_by_variable(pay, val, ben, "TOA", 3).agg(F.max("Unmatched")).first()[0] == 0
    with pytest.raises(ValueError, match="no benchmark cases"):
        backtest.matched_by_variable(pay, val, ben.filter("TOA < 600"), "TOA", 3)


def _cloud(spark, n, dim, seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, v array<double>").repartition(4), x


def test_distances_per_query_grow_slower_than_rows(spark, monkeypatch):
    """Rows that the queries' cells hold, counted at two sizes: four times the rows, far less than four times the work."""
    seen = []
    plain = neighbours._block_join

    def counted(q, t, sizes, k, bar, chunk):
        seen.append(sum(sizes.get(r["cell"], 0) * r["count"] for r in q.groupBy("cell").count().collect()))
        return plain(q, t, sizes, k, bar, chunk)

    monkeypatch.setattr(neighbours, "_block_join", counted)
    work = []
    for n in (1000, 4000):
        df, x = _cloud(spark, n, 2, 5)
        ask = df.where("id % 10 = 0")
        seen.clear()
        got = {(r["id"], r["rank"]): r["neighbour"] for r in neighbours.knn(df, ask, "id", "v", 3).collect()}
        work.append(sum(seen) / (n / 10))
        for i in range(0, n, 100):
            d = np.sqrt(((x - x[i]) ** 2).sum(1))
            assert [got[i, r] for r in (1, 2, 3)] == np.lexsort((np.arange(n), d))[:3].tolist()
    assert work[1] < 2.5 * work[0] and work[1] < 0.25 * 4000


def test_hashed_neighbours_recall(spark):
    df, _ = _cloud(spark, 3000, 4, 6)
    ask = df.where("id % 20 = 0")
    exact = neighbours.knn(df, ask, "id", "v", 10, exclude_self=True)
    found = neighbours.knn_hashed(df, ask, "id", "v", 10, tables=12, rows=600, exclude_self=True)
    assert neighbours.recall(found, exact, "id") >= 0.9
    d = {(r["id"], r["neighbour"]): r["dist"] for r in exact.collect()}
    assert all(abs(d[r["id"], r["neighbour"]] - r["dist"]) < 1e-12 for r in found.collect() if (r["id"], r["neighbour"]) in d)
