"""The boosting engine against a direct fit, row by row, on a few hundred rows."""
import math

import numpy as np
import pytest

from recoup.operators import boosting
from recoup.operators.boosting import HOLD_OUT, Config


def direct(codes, y, train, valid, c, start):
    """One model by plain loops over columns and cuts; losses on the left-out rows by round."""
    f = np.full(len(y), start)
    out = []
    for _ in range(c.rounds):
        if c.loss == "bernoulli":
            p = 1 / (1 + np.exp(-f))
            g, h = y - p, p * (1 - p)
        else:
            s = 2 * y - 1
            h = 1 / (1 + np.exp(s * f)) if c.loss == "gentle" else np.exp(-s * f)
            g = h * s
        w = np.ones(len(y)) if c.loss == "bernoulli" else h
        leaves, work = [], [(np.flatnonzero(train), 0)]
        while work:
            rows, depth = work.pop(0)
            best = None
            if depth < c.depth and len(rows) >= 2 * c.min_rows:
                for j in range(codes.shape[1]):
                    for cut in range(codes[:, j].max()):
                        low = rows[codes[rows, j] <= cut]
                        high = rows[codes[rows, j] > cut]
                        if min(len(low), len(high)) < c.min_rows:
                            continue
                        gain = sum(g[r].sum() ** 2 / w[r].sum() for r in (low, high)) - g[rows].sum() ** 2 / w[rows].sum()
                        if best is None or gain > best[0] * (1 + 1e-9) + 1e-12:
                            best = gain, low, high, j, cut
            if best and best[0] > 1e-9:
                work += [(best[1], depth + 1), (best[2], depth + 1)]
                leaves.append((rows, best))
            else:
                leaves.append((rows, None))
        ends = [r for r, b in leaves if b is None]
        wrong = sum(h[r].sum() - abs(g[r].sum()) for r in ends) / 2 / sum(h[r].sum() for r in ends)

        def value(rows):
            ratio = g[rows].sum() / h[rows].sum()
            if c.loss in ("bernoulli", "gentle"):
                return ratio
            if c.loss == "real":
                q = min(max((1 + ratio) / 2, 1e-5), 1 - 1e-5)
                return 0.5 * math.log(q / (1 - q))
            return 0.5 * math.log((1 - wrong) / wrong) * (1 if ratio >= 0 else -1)

        nodes = {rows.tobytes(): b for rows, b in leaves}

        def predict(rows, at):  # every row follows the splits of the training rows
            b = nodes[rows.tobytes()]
            if b is None:
                f[at] += c.rate * value(rows)
                return
            _, low, high, j, cut = b
            predict(low, at[codes[at, j] <= cut])
            predict(high, at[codes[at, j] > cut])

        values = {}
        for rows, b in leaves:
            if b is None:
                values[rows.tobytes()] = value(rows)
        predict(np.flatnonzero(train), np.arange(len(y)))
        z = f if c.loss == "bernoulli" else 2 * f
        out.append([(np.logaddexp(0, z[s]) - y[s] * z[s]).mean() for s in (train, valid)])
    return np.array(out)


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(3)
    n = 320
    x = rng.normal(size=(n, 4))
    x[:, 3] = rng.integers(0, 3, n)
    y = (x[:, 0] - 0.7 * x[:, 1] * (x[:, 3] > 0) + 0.3 * rng.normal(size=n) > 0).astype(int)
    part = rng.integers(0, 4, n)
    part[part == 3] = HOLD_OUT
    rows = [(i, int(y[i]), int(part[i]), *[None if j == 2 and i % 17 == 0 else float(x[i, j]) for j in range(4)]) for i in range(n)]
    df = spark.createDataFrame(rows, "k long, label int, part int, a double, b double, c double, d double").repartition(3)
    return df, rows


def plain(rows, edges):
    codes = np.array([[0 if v is None else int(np.searchsorted(e, v)) + 1 for v, e in zip(r[3:], edges, strict=True)] for r in rows])
    return codes, np.array([r[1] for r in rows], float), np.array([r[2] for r in rows])


def test_every_fold_and_loss_equals_a_direct_fit(table):
    df, rows = table
    configs = [Config(f"fold{k}", 15, 3, 0.1, 10, leave=k) for k in range(3)] + [Config("all", 15, 3, 0.1, 10), Config("deep", 4, 9, 0.3, 3)]
    configs += [Config(k, 6, d, r, 5, loss=k) for k, d, r in (("discrete", 2, 1.0), ("real", 2, 0.5), ("gentle", 3, 1.0))]
    fits = boosting.fit(df, "k", list("abcd"), configs, bins=16)
    codes, y, part = plain(rows, fits[0].edges)
    for m in fits:
        c = m.config
        valid = part == (HOLD_OUT if c.leave is None else c.leave)
        want = direct(codes, y, ~valid & (part != HOLD_OUT), valid, c, m.start)
        got = np.array([[h["train_loss"], h["valid_loss"]] for h in m.history])
        assert [h["round"] for h in m.history] == list(range(1, c.rounds + 1))
        assert np.allclose(got, want, rtol=1e-6, atol=1e-8), c.name


def test_area_under_the_curve_and_margins(table):
    df, rows = table
    (m,) = boosting.fit(df, "k", list("abcd"), [Config("one", 20, 2, 0.2, 10, rows=0.6, tree_columns=0.75, split_columns=0.7)], bins=16)
    f = {r["k"]: r["margin"] for r in m.margins(df, "k").collect()}
    last = m.history[-1]
    for part, name in ((True, "valid"), (False, "train")):
        s = [(f[r[0]], r[1]) for r in rows if (r[2] == HOLD_OUT) == part]
        assert abs(np.mean([np.logaddexp(0, z) - y * z for z, y in s]) - last[f"{name}_loss"]) < 1e-9
        one, zero = [z for z, y in s if y], [z for z, y in s if not y]
        exact = np.mean([(a > b) + 0.5 * (a == b) for a in one for b in zero])
        assert abs(exact - last[f"{name}_auc"]) < 0.01
    assert m.best("valid_loss") == min(m.history, key=lambda h: h["valid_loss"])["round"]


def test_folds_end_together(table):
    df, _ = table
    fits = boosting.fit(df, "k", list("abcd"), [Config(str(k), 300, 3, 0.3, 5, leave=k) for k in range(3)], bins=16,
                        until=lambda ms: boosting.no_better(boosting.fold_losses(ms), 6))
    losses = boosting.fold_losses(fits)
    assert len(losses) < 300 and min(losses) == losses[len(losses) - 7]
    n = [m.history[0]["valid_rows"] for m in fits]
    assert abs(losses[2] - sum(k * m.history[2]["valid_loss"] for k, m in zip(n, fits, strict=True)) / sum(n)) < 1e-12


def test_stop_rule(table):
    df, _ = table
    free, held = boosting.fit(df, "k", list("abcd"), [Config("free", 60, 3, 0.3, 5), Config("held", 60, 3, 0.3, 5, patience=2)], bins=16)
    assert len(free.trees) == 60 and len(held.trees) < 60
    auc = [h["valid_auc"] for h in held.history]
    assert auc == [h["valid_auc"] for h in free.history][:len(auc)]

    def stalled(a):
        mean = [(a[i] + a[i + 1]) / 2 for i in range(len(a) - 4, len(a) - 1)]
        return max(mean[1:]) <= mean[0] * (1 + 1e-4)

    assert stalled(auc) and not any(stalled(auc[:n]) for n in range(4, len(auc)))


def test_stored_margins_and_small_steps(table, monkeypatch):
    df, _ = table
    configs = [Config("x", 30, 4, 0.2, 5, rows=0.5), Config("y", 12, 2, 0.2, 5, leave=1)]
    want = [m.history for m in boosting.fit(df, "k", list("abcd"), configs, bins=16)]
    monkeypatch.setattr(boosting, "STATE_ROUNDS", 7)
    monkeypatch.setattr(boosting, "STEP_CELLS", 500)
    monkeypatch.setattr(boosting, "BLOCK_ROWS", 40)
    monkeypatch.setattr(boosting, "DIRECT", 1)
    monkeypatch.setattr(boosting, "TASK_ROWS", 50)
    got = [m.history for m in boosting.fit(df, "k", list("abcd"), configs, bins=16)]
    for a, b in zip(want, got, strict=True):
        assert [h["round"] for h in a] == [h["round"] for h in b]
        assert np.allclose([h["valid_loss"] for h in a], [h["valid_loss"] for h in b])


def test_few_rows(spark):
    df = spark.createDataFrame([(1, 1, 0, 1.0), (2, 1, 0, 2.0)], "k long, label int, part int, a double")
    (m,) = boosting.fit(df, "k", ["a"], [Config("x", 2, 2, 0.1, 1)])
    assert len(m.trees) == 2 and m.start == 0.0
