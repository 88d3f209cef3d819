import numpy as np
import pytest

from recoup.llm import vectors


def brute(rows):
    ok = [(i, lab, np.array(v, float)) for i, lab, v in rows if i is not None and lab is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    n = len(ok)
    near = np.zeros((n, n), bool)
    for a in range(n):
        for b in range(n):
            u, w = ok[a][2], ok[b][2]
            near[a, b] = a != b and ok[a][1] == ok[b][1] and len(u) == len(w) and u @ w / np.sqrt((u @ u) * (w @ w)) >= vectors.THRESHOLD
    root = list(range(n))
    for a in sorted(range(n), key=lambda a: ok[a][0]):
        front = [a] if root[a] == a else []
        seen = {a}
        while front:
            front = [b for c in front for b in np.flatnonzero(near[c]) if b not in seen and not seen.add(b)]
        for b in seen:
            if ok[root[b]][0] >= ok[a][0] and root[b] == b:
                root[b] = a
    return sorted((ok[a][0], int(near[a].sum()), ok[root[a]][0]) for a in range(n))


def sample(seed, groups=6, size=60):
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(groups):
        centre = rng.standard_normal(16)
        for _ in range(size if g == 0 else rng.integers(1, 9)):
            rows.append((len(rows), int(g % 2), (centre + rng.standard_normal(16) * rng.choice([0.0, 0.05, 0.15, 0.4])).tolist()))
    rows += [(len(rows) + i, i % 2, rng.standard_normal(16).tolist()) for i in range(150)]
    return rows


def test_recall_and_exactness(spark):
    found = total = 0
    for seed in (1, 2):
        rows = sample(seed)
        want = brute(rows)
        got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")).collect())
        assert all(g[1] <= w[1] for g, w in zip(got, want, strict=True))
        found += sum(g[1] for g in got)
        total += sum(w[1] for w in want)
    assert found >= 0.99 * total > 0


def test_a_group_beyond_a_window_is_counted_in_full(spark):
    rng = np.random.default_rng(3)
    n = vectors.WINDOW + vectors.CHUNK + 77
    x = np.ones(8) + rng.standard_normal((n, 8)) * 0.05
    rows = [(i, 1, v) for i, v in enumerate(x.tolist())]
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (u @ u.T >= vectors.THRESHOLD).sum(axis=1) - 1
    got = {r["vec_id"]: r for r in vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")).collect()}
    assert [got[i]["n_links"] for i in range(n)] == near.tolist()
    assert {r["component_id"] for r in got.values() if r["n_links"]} == {0}


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, 1, [1.0, 0.0]), (2, 1, [2.0, 0.0]), (2, 1, [1.0, 0.0]), (3, None, [1.0, 0.0]), (4, 1, None), (5, 1, []), (6, 1, [0.0, 0.0]),
            (7, 1, [1.0, None]), (8, 1, [nan, 1.0]), (9, 1, [inf, 1.0]), (None, 1, [1.0, 0.0]), (10, 2, [1.0, 0.0]), (11, 1, [1.0, 0.0, 0.0]),
            (12, 1, [1e300, 1e290]), (13, 1, [-1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").selectExpr("*", "'x' as node", "'y' as pass", "'z' as v", "0 as n", "'l' as id")
    got = sorted([(r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in vectors.near_duplicates(df).collect()], key=str)
    want = [(1, 3, 1, True), (2, 3, 1, False), (2, 3, 1, False), (12, 3, 1, False), (None, 0, None, False)]
    want += [(i, 0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 10, 11, 13)]
    assert got == sorted(want, key=str)
    assert vectors.near_duplicates(df.limit(0)).count() == 0


def test_passes_follow_the_size():
    assert vectors.passes(1) == vectors.passes(vectors.WINDOW) <= vectors.passes(10**5) < vectors.passes(10**9) < 60


def dense(n, pairs, dim=64, mean=0.95, seed=5):
    """Unit vectors whose cosine with each other is about ``mean``, and near copies of the first ones."""
    rng = np.random.default_rng(seed)
    centre = np.zeros(dim)
    centre[0] = 1.0
    u = rng.standard_normal((n, dim))
    u[:, 0] = 0.0
    x = np.sqrt(mean) * centre + np.sqrt(1 - mean) * u / np.linalg.norm(u, axis=1, keepdims=True)
    e = rng.standard_normal((pairs, dim))
    e -= (e * x[:pairs]).sum(axis=1, keepdims=True) * x[:pairs]
    c = rng.uniform(0.981, 0.99, (pairs, 1))
    return np.r_[x, c * x[:pairs] + np.sqrt(1 - c * c) * e / np.linalg.norm(e, axis=1, keepdims=True)]


@pytest.mark.parametrize(("mean", "n"), [(0.95, 12 * vectors.WINDOW), (0.9, 24 * vectors.WINDOW), (0.0, 5_000), (0.5, 700)])
def test_recall_of_the_passes_at_production_settings(spark, monkeypatch, mean, n):
    """No kind is compared directly: what is found comes through the passes."""
    monkeypatch.setattr(vectors, "_pairs", lambda classes: classes.sparkSession.createDataFrame([], "a long, b long"))
    pairs = min(600, n // 2)
    x = dense(n, pairs, mean=mean)
    assert 1 < vectors.needed(x[:vectors.SAMPLE], x.mean(axis=0), len(x)) <= vectors.MOST
    rows = spark.createDataFrame([(i, 1, v) for i, v in enumerate(x.tolist())], "vec_id long, label int, embedding array<double>")
    got = {r["vec_id"]: r for r in vectors.near_duplicates(rows).collect()}
    assert sum(got[i]["component_id"] == got[n + i]["component_id"] for i in range(pairs)) >= 0.985 * pairs
    assert all(r["n_links"] == 0 for i, r in got.items() if pairs <= i < n) or mean > 0.9


def test_a_kind_of_one_window_is_whole_in_one_pass(spark, monkeypatch):
    monkeypatch.setattr(vectors, "_pairs", lambda classes: classes.sparkSession.createDataFrame([], "a long, b long"))
    rows = [(i, lab, v) for i, lab, v in sample(4)]
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")).collect())
    assert got == brute(rows)


def test_signs_that_do_not_split_ask_for_more():
    x = dense(vectors.SAMPLE, 0)
    far = np.where(np.arange(len(x))[:, None] % 2, x, x * np.r_[-1.0, np.ones(63)])  # two dense cones
    spread_ = np.random.default_rng(1).standard_normal(x.shape)
    spread_ /= np.linalg.norm(spread_, axis=1, keepdims=True)
    count = vectors.needed(far, far.mean(axis=0), 200_000)
    assert count == 0 or count > 2 * vectors.passes(200_000)
    assert vectors.needed(far, far.mean(axis=0), 10**6) == 0 or vectors.needed(far, far.mean(axis=0), 10**6) > count
    assert 0 < vectors.needed(spread_, spread_.mean(axis=0), 200_000) <= 2 * vectors.passes(200_000)
    assert vectors.needed(x, x.mean(axis=0), 10**8) > vectors.passes(10**8)
