"""Logistic models by Newton steps, many models in each pass over the data.

Candidates of a stepwise search, folds of a cross-validation and penalised smooths are all
models over the same stored frame; each Newton step is one Spark job that adds up gradient and
Hessian of every model from Arrow batches, and the driver solves the small systems.
"""
from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recoup.functions import dist
from recoup.functions.columns import linear, logistic


@dataclass
class Logit:
    x: list[str]
    beta: np.ndarray
    covariance: np.ndarray
    deviance: float
    n: float
    edf: float
    converged: bool = True

    @property
    def intercept(self) -> float:
        return float(self.beta[0])

    def aic(self, k: float = 2.0) -> float:
        return self.deviance + k * self.edf

    def eta(self) -> Column:
        return linear(dict(zip(self.x, map(float, self.beta[1:]))), self.intercept)

    def probability(self) -> Column:
        return logistic(self.eta())

    def coefficients(self) -> list[dict]:
        q = dist.normal_ppf(0.975)
        out = []
        for name, b, s in zip(["(Intercept)", *self.x], self.beta, np.sqrt(np.diag(self.covariance))):
            out.append({"term": name, "estimate": float(b), "se": float(s), "z": float(b / s),
                        "p": 2 * (1 - dist.normal_cdf(abs(b / s))), "low": float(b - q * s), "high": float(b + q * s),
                        "odds_ratio": math.exp(min(float(b), 700.0))})
        return out


@dataclass
class Spec:
    """A model: its columns, an optional left-out fold, a ridge penalty per column, and a fit
    of some of the same columns to start from."""
    x: list[str]
    skip_fold: int | None = None
    penalty: dict[str, float] = field(default_factory=dict)
    start: Logit | None = None


def fit(df: DataFrame, y: str, x: Sequence[str], penalty: dict[str, float] | None = None) -> Logit:
    """One model; a fit that Newton's steps did not settle is an error, not a result."""
    found = fit_many(df, y, [Spec(list(x), penalty=penalty or {})])[0]
    if not found.converged:
        raise ValueError(f"the logistic fit of {y} on {', '.join(x)} did not converge")
    return found


def fit_many(df: DataFrame, y: str, specs: Sequence[Spec], fold: str | None = None, steps: int = 25,
             tol: float = 1e-9) -> list[Logit]:
    """Fit all models together; rows with a null in any used column are left out."""
    cols = sorted({c for s in specs for c in s.x})
    data = df.select(*[F.col(c).cast("double").alias(c) for c in cols], F.col(y).cast("double").alias("_y"),
                     *([F.col(fold).cast("int").alias("_fold")] if fold else [])).dropna("any")
    stats = data.agg(F.count(F.lit(1)), *[f(c) for c in cols for f in (F.avg, F.stddev_samp)]).first()
    centre = np.array([float(stats[1 + 2 * i]) for i in range(len(cols))])
    scale = np.array([float(stats[2 + 2 * i] or 0.0) or 1.0 for i in range(len(cols))])
    index = [[cols.index(c) for c in s.x] for s in specs]
    skip = [s.skip_fold for s in specs]
    # The penalty is stated on the original scale of a coefficient.
    ridge = [np.array([0.0] + [s.penalty.get(c, 0.0) / scale[cols.index(c)] ** 2 for c in s.x]) for s in specs]
    beta = [_start(s, cols, centre, scale) for s in specs]
    last = [math.inf] * len(specs)
    result: list[Logit | None] = [None] * len(specs)
    for step in range(steps + 1):
        active = [i for i, r in enumerate(result) if r is None]
        if not active:
            break
        sums = _pass(data, cols, centre, scale, {i: (index[i], skip[i], beta[i]) for i in active}, fold is not None)
        for i in active:
            v = sums[i]
            p = len(beta[i])
            n, dev, g = v[0], v[1], v[2:2 + p] - ridge[i] * beta[i]
            h = np.zeros((p, p))
            h[np.triu_indices(p)] = v[2 + p:]
            h = h + np.triu(h, 1).T
            penal = h + np.diag(ridge[i])
            goal = dev + float(ridge[i] @ beta[i] ** 2)
            done = abs(last[i] - goal) <= tol * (abs(goal) + 0.1)
            if done or step == steps:
                inv = np.linalg.pinv(penal)
                cov = inv @ h @ inv
                t = np.eye(p)  # back from the scaled columns
                ix = index[i]
                t[0, 1:] = -centre[ix] / scale[ix]
                t[1:, 1:] = np.diag(1.0 / scale[ix])
                result[i] = Logit(list(specs[i].x), t @ beta[i], t @ cov @ t.T, dev, n, float(np.trace(inv @ h)), done)
            else:
                last[i] = goal
                move = np.linalg.lstsq(penal, g, rcond=None)[0]
                beta[i] = beta[i] + move * min(1.0, 8.0 / max(np.abs(move).max(), 1e-12))
    return result


def _start(spec: Spec, cols, centre, scale) -> np.ndarray:
    """Starting coefficients on the scaled columns: a known fit's, or zero."""
    out = np.zeros(len(spec.x) + 1)
    if spec.start is None:
        return out
    known = dict(zip(spec.start.x, spec.start.beta[1:]))
    out[0] = spec.start.intercept + sum(b * centre[cols.index(c)] for c, b in known.items() if c in cols)
    for i, c in enumerate(spec.x):
        out[i + 1] = known.get(c, 0.0) * scale[cols.index(c)]
    return out


def _pass(data: DataFrame, cols, centre, scale, models: dict, folded: bool) -> dict[int, np.ndarray]:
    """Row count, deviance, gradient and upper Hessian of every model at its coefficients."""
    names = list(cols)

    def partial(batches):
        import pandas as pd
        acc = {}
        for pdf in batches:
            y = pdf["_y"].to_numpy()
            z = (pdf[names].to_numpy(dtype=float) - centre) / scale if names else np.zeros((len(pdf), 0))
            group = pdf["_fold"].to_numpy() if folded else None
            for i, (ix, skip, b) in models.items():
                rows = slice(None) if skip is None else group != skip
                yy = y[rows]
                x = np.column_stack([np.ones(len(yy)), z[rows][:, ix]])
                eta = np.clip(x @ b, -500, 500)
                mu = 1.0 / (1.0 + np.exp(-eta))
                dev = 2.0 * np.sum(np.logaddexp(0.0, eta) - yy * eta)
                h = (x * (mu * (1 - mu))[:, None]).T @ x
                row = np.concatenate([[len(yy), dev], x.T @ (yy - mu), h[np.triu_indices(len(b))]])
                acc[i] = acc[i] + row if i in acc else row
        for i, row in acc.items():
            yield pd.DataFrame({"model": i, "pos": np.arange(len(row)), "v": row})

    rows = (data.mapInPandas(partial, "model int, pos int, v double")
            .groupBy("model", "pos").agg(F.sum("v").alias("v")).collect())
    out = {i: np.zeros(2 + len(b) + len(b) * (len(b) + 1) // 2) for i, (_, _, b) in models.items()}
    for r in rows:
        out[r["model"]][r["pos"]] = r["v"]
    return out


def stepwise(df: DataFrame, y: str, x: Sequence[str], direction: str = "both", k: float = 2.0,
             groups: dict[str, list[str]] | None = None) -> tuple[Logit, list[dict]]:
    """Stepwise search by deviance + k * parameters. All moves of a step are fitted together."""
    groups = groups or {c: [c] for c in x}
    current = [] if direction in ("forward", "both") else list(groups)
    best = fit_many(df, y, [Spec([c for g in current for c in groups[g]])])[0]
    trace = [{"step": 0, "move": "start", "aic": best.aic(k)}]
    seen: dict[frozenset, Logit] = {frozenset(current): best}
    while True:
        moves = []
        if direction in ("forward", "both"):
            moves += [("+" + g, current + [g]) for g in groups if g not in current]
        if direction in ("backward", "both"):
            moves += [("-" + g, [c for c in current if c != g]) for g in current]
        fresh = [m for m in moves if frozenset(m[1]) not in seen]
        if fresh:
            fits = fit_many(df, y, [Spec([c for g in m[1] for c in groups[g]], start=best) for m in fresh])
            seen.update({frozenset(m[1]): f for m, f in zip(fresh, fits)})
        if not moves:
            break
        name, terms = min(moves, key=lambda m: seen[frozenset(m[1])].aic(k))
        found = seen[frozenset(terms)]
        if found.aic(k) >= best.aic(k) - 1e-9:
            break
        best, current = found, terms
        trace.append({"step": len(trace), "move": name, "aic": best.aic(k)})
    return best, trace


def residuals(df: DataFrame, y: str, model: Logit) -> DataFrame:
    """Fitted probability, response residual and deviance residual per row."""
    eta, yy = model.eta(), F.col(y)
    d = df.withColumn("_eta", eta)
    half = F.log1p(F.exp(-F.abs("_eta"))) + F.greatest(F.col("_eta"), F.lit(0.0)) - yy * F.col("_eta")
    return d.withColumns({"fitted": logistic(F.col("_eta")), "response": yy - logistic(F.col("_eta")),
                          "deviance": F.signum(yy - logistic(F.col("_eta"))) * F.sqrt(2 * half)}).drop("_eta")


def smooth_basis(df: DataFrame, column: str, knots: Sequence[float], centre: float, scale: float) -> dict[str, Column]:
    """Truncated cubic basis of a standardised column: x, x^2, x^3 and (x - k)+^3 per knot."""
    z = (F.col(column).cast("double") - F.lit(centre)) / F.lit(scale)
    out = {f"{column}__1": z, f"{column}__2": z * z, f"{column}__3": z * z * z}
    for i, k in enumerate(knots):
        d = F.greatest(z - F.lit((k - centre) / scale), F.lit(0.0))
        out[f"{column}__k{i + 1}"] = d * d * d
    return out


@dataclass
class Additive:
    """An additive logistic model: smooth terms share a penalty on their bent columns."""
    model: Logit
    terms: dict[str, list[str]]
    columns: dict[str, Column]

    def contribution(self, term: str) -> Column:
        b = dict(zip(self.model.x, self.model.beta[1:]))
        e = F.lit(0.0)
        for c in self.terms[term]:
            e = e + F.lit(float(b[c])) * self.columns[c]
        return e

    def probability(self) -> Column:
        eta = F.lit(self.model.intercept)
        for t in self.terms:
            eta = eta + self.contribution(t)
        return logistic(eta)


def additive_columns(df: DataFrame, smooth: Sequence[str], knots: int = 3) -> dict[str, dict[str, Column]]:
    """Basis columns per smooth variable with knots at inner quantiles."""
    from recoup.operators.ranks import exact_quantiles
    probs = [i / (knots + 1) for i in range(1, knots + 1)]
    q: dict[str, list[float]] = {}
    for r in exact_quantiles(df, smooth, probs).collect():
        q.setdefault(r["variable"], []).append(r["q"])
    m = df.agg(*[f(c) for c in smooth for f in (F.avg, F.stddev_samp)]).first()
    return {c: smooth_basis(df, c, sorted(set(q[c])), float(m[2 * i]), float(m[2 * i + 1]))
            for i, c in enumerate(smooth)}


def fit_additive(df: DataFrame, y: str, smooth: Sequence[str], straight: Sequence[str], penalty: float = 1.0,
                 knots: int = 3) -> Additive:
    basis = additive_columns(df, smooth, knots)
    cols = {k: e for b in basis.values() for k, e in b.items()}
    cols.update({c: F.col(c).cast("double") for c in straight})
    data = df.select(y, *[e.alias(k) for k, e in cols.items()])
    terms = {**{f"s({c})": list(b) for c, b in basis.items()}, **{c: [c] for c in straight}}
    bent = {k: penalty for b in basis.values() for k in b if not k.endswith("__1")}
    return Additive(fit(data, y, list(cols), bent), terms, cols)


def step_additive(df: DataFrame, y: str, candidates: Sequence[str], flags: Sequence[str] = (), k: float = 2.0,
                  penalty: float = 1.0) -> tuple[Additive, list[dict]]:
    """Step search in which every variable is absent, straight or smooth and moves one level at
    a time; all moves of a step are fitted in the same passes."""
    from recoup.session import stored
    basis = additive_columns(df, candidates)
    cols = {n: e for b in basis.values() for n, e in b.items()}
    cols.update({c: F.col(c).cast("double") for c in flags})
    data = stored(df.select(y, *[e.alias(n) for n, e in cols.items()]), "basis")
    level = {c: 0 for c in [*candidates, *flags]}
    top = {**{c: 2 for c in candidates}, **{c: 1 for c in flags}}

    def spec(lv, start=None):
        x, pen = [], {}
        for c, v in lv.items():
            if v == 0:
                continue
            own = [c] if c in flags else (list(basis[c])[:1] if v == 1 else list(basis[c]))
            x += own
            pen.update({n: penalty for n in own if c not in flags and not n.endswith("__1")})
        return Spec(x, penalty=pen, start=start)

    best = fit_many(data, y, [spec(level)])[0]
    trace = [{"step": 0, "move": "start", "aic": best.aic(k)}]
    while True:
        moves = [(c, v) for c in level for v in (level[c] - 1, level[c] + 1) if 0 <= v <= top[c]]
        fits = fit_many(data, y, [spec({**level, c: v}, best) for c, v in moves])
        i = min(range(len(moves)), key=lambda j: fits[j].aic(k))
        if fits[i].aic(k) >= best.aic(k) - 1e-9:
            break
        best, level = fits[i], {**level, moves[i][0]: moves[i][1]}
        trace.append({"step": len(trace), "move": f"{moves[i][0]}={('absent', 'straight', 'smooth')[moves[i][1]]}",
                      "aic": best.aic(k)})
    terms = {}
    for c, v in level.items():
        if v:
            terms[f"s({c})" if v == 2 else c] = [c] if c in flags else (list(basis[c])[:1] if v == 1 else list(basis[c]))
    return Additive(best, terms, cols), trace


def effect_sizes(df: DataFrame, model: Additive, tol: float = 0.01) -> DataFrame:
    """Range of every term's contribution between its outer and middle quantiles."""
    from recoup.operators.profile import profile
    d = df.select(*[model.contribution(t).alias(t) for t in model.terms])
    d = d.withColumnsRenamed({t: t.replace("(", "_").replace(")", "") for t in model.terms})
    return profile(d, d.columns, [tol, 0.25, 0.5, 0.75, 1 - tol])


def effect_curves(train: DataFrame, test: DataFrame, model: Additive, bins: int = 20) -> DataFrame:
    """Mean contribution of every smooth term by bin of its variable, in both sets."""
    from recoup.operators.bands import cut, edges
    out = None
    for t in model.terms:
        v = t[2:-1] if t.startswith("s(") else t
        e = edges(train, v, bins)
        if len(e) < 2:
            continue
        for name, d in (("train", train), ("test", test)):
            r = d.groupBy(cut(v, e, True).alias("bin")).agg(
                F.avg(model.contribution(t)).alias("effect"), F.count(F.lit(1)).alias("n")).select(
                F.lit(t).alias("term"), F.lit(name).alias("part"), "bin", "effect", "n")
            out = r if out is None else out.unionByName(r)
    return out
