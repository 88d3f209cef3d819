"""Least squares from one distributed pass: moments, fits, tests, selection, shrinkage.

A pass leaves n, the means and the centred cross-product matrix of the columns on the driver
(p x p numbers, whatever the row count). All fits and tests are small algebra on that; per-row
results are generated column expressions.
"""
from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recoup.functions import dist
from recoup.functions.columns import linear
from recoup.operators.outliers import quadratic_form

JVM_COLUMNS = 10


@dataclass
class Moments:
    """Count, means and centred cross products of named columns."""
    n: float
    names: list[str]
    mean: np.ndarray
    s: np.ndarray

    def at(self, names: Sequence[str]) -> list[int]:
        return [self.names.index(c) for c in names]

    def block(self, rows: Sequence[str], cols: Sequence[str]) -> np.ndarray:
        return self.s[np.ix_(self.at(rows), self.at(cols))]

    def sd(self, name: str) -> float:
        i = self.names.index(name)
        return math.sqrt(self.s[i, i] / (self.n - 1))

    def minus(self, other: "Moments") -> "Moments":
        """The moments of the rows that are not in ``other``."""
        n = self.n - other.n
        mean = (self.n * self.mean - other.n * other.mean) / n
        d = other.mean - mean
        return Moments(n, self.names, mean, self.s - other.s - np.outer(d, d) * other.n * n / self.n)


def moments(df: DataFrame, columns: Sequence[str]) -> Moments:
    return list(group_moments(df, columns).values())[0]


def group_moments(df: DataFrame, columns: Sequence[str], by: str | None = None) -> dict:
    """Moments per group (for folds) in one scan after the means; rows with nulls are left out.

    Values are shifted by the overall means first, so the sums stay accurate. A few columns are
    summed by JVM aggregates; more go through Arrow batches, whose partial sums are added up by
    a grouped aggregate of p(p+1)/2 rows per partition.
    """
    cols = list(columns)
    data = df.select(*[F.col(c).cast("double").alias(c) for c in cols],
                     *([F.col(by).alias("_g")] if by else [F.lit(0).alias("_g")])).dropna("any")
    first = data.agg(*[F.avg(c) for c in cols], F.count(F.lit(1))).first()
    shift = np.array([float(v) if v is not None else 0.0 for v in first[:-1]])
    p = len(cols)
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    if p <= JVM_COLUMNS:
        z = [F.col(c) - F.lit(float(m)) for c, m in zip(cols, shift)]
        rows = data.groupBy("_g").agg(F.count(F.lit(1)), *[F.sum(v) for v in z],
                                      *[F.sum(z[i] * z[j]) for i, j in pairs]).collect()
        sums = {r[0]: np.array([float(v) for v in r[1:]]) for r in rows}
    else:
        kind = data.schema["_g"].dataType.simpleString()
        upper = np.triu_indices(p)

        def partial(batches):
            import pandas as pd
            acc = {}
            for pdf in batches:
                for g, part in pdf.groupby("_g"):
                    x = part[cols].to_numpy(dtype=float) - shift
                    row = np.concatenate([[len(x)], x.sum(axis=0), (x.T @ x)[upper]])
                    acc[g] = acc[g] + row if g in acc else row
            for g, row in acc.items():
                yield pd.DataFrame({"g": g, "pos": np.arange(len(row)), "v": row})

        rows = (data.mapInPandas(partial, f"g {kind}, pos int, v double")
                .groupBy("g", "pos").agg(F.sum("v").alias("v")).collect())
        sums = {}
        for r in rows:
            sums.setdefault(r["g"], np.zeros(1 + p + len(pairs)))[r["pos"]] = r["v"]
    out = {}
    for g, v in sums.items():
        n, total = v[0], v[1:p + 1]
        s = np.zeros((p, p))
        for value, (i, j) in zip(v[p + 1:], pairs):
            s[i, j] = s[j, i] = value
        out[g] = Moments(float(n), cols, shift + total / n, s - np.outer(total, total) / n)
    return out


def pool(parts: Sequence[Moments]) -> Moments:
    n = sum(m.n for m in parts)
    mean = sum(m.n * m.mean for m in parts) / n
    s = sum(m.s + m.n * np.outer(m.mean - mean, m.mean - mean) for m in parts)
    return Moments(n, parts[0].names, mean, s)


@dataclass
class Ols:
    """A least-squares fit with an intercept."""
    m: Moments
    y: str
    x: list[str]
    b: np.ndarray
    intercept: float
    rss: float
    tss: float
    inverse: np.ndarray

    @property
    def df(self) -> float:
        return self.m.n - len(self.x) - 1

    @property
    def sigma2(self) -> float:
        return self.rss / self.df

    def prediction(self) -> Column:
        return linear(dict(zip(self.x, map(float, self.b))), self.intercept)

    def leverage(self) -> Column:
        """x'(X'X)^-1 x with the constant, as a column."""
        centre = self.m.mean[self.m.at(self.x)]
        return F.lit(1.0 / self.m.n) + quadratic_form(self.x, centre, self.inverse)

    def summary(self) -> dict[str, float]:
        p, n = len(self.x), self.m.n
        r2 = 1.0 - self.rss / self.tss
        f = ((self.tss - self.rss) / p) / self.sigma2
        return {"n": n, "rss": self.rss, "rse": math.sqrt(self.sigma2), "tss": self.tss, "r2": r2,
                "adj_r2": 1.0 - (self.rss / self.df) / (self.tss / (n - 1)), "f": f, "p": dist.f_sf(f, p, self.df)}

    def covariance(self) -> np.ndarray:
        """Covariance of (intercept, coefficients)."""
        centre = self.m.mean[self.m.at(self.x)]
        c = -self.inverse @ centre
        top = 1.0 / self.m.n + centre @ self.inverse @ centre
        return self.sigma2 * np.block([[np.array([[top]]), c[None, :]], [c[:, None], self.inverse]])

    def coefficients(self) -> list[dict]:
        se = np.sqrt(np.diag(self.covariance()))
        q = dist.t_ppf(0.975, self.df)
        out = []
        for name, b, s in zip(["(Intercept)", *self.x], [self.intercept, *self.b], se):
            out.append({"term": name, "estimate": float(b), "se": float(s), "t": float(b / s),
                        "p": dist.t_sf2(float(b / s), self.df), "low": float(b - q * s), "high": float(b + q * s),
                        "contains_zero": bool(b - q * s <= 0.0 <= b + q * s)})
        return out


def ols(m: Moments, y: str, x: Sequence[str]) -> Ols:
    x = list(x)
    sxx, sxy = m.block(x, x), m.block(x, [y])[:, 0]
    tss = float(m.block([y], [y])[0, 0])
    # Solved on the correlation scale: raw columns differ by many orders of magnitude.
    d = np.sqrt(np.diag(sxx))
    inv = np.linalg.inv(sxx / np.outer(d, d)) / np.outer(d, d) if x else np.zeros((0, 0))
    b = inv @ sxy if x else np.zeros(0)
    mean = m.mean[m.at(x)] if x else np.zeros(0)
    return Ols(m, y, x, b, float(m.mean[m.at([y])[0]] - mean @ b), float(tss - sxy @ b), tss, inv)


def nested_f(small: Ols, large: Ols) -> dict[str, float]:
    """F test of the added terms of a nested model."""
    q = len(large.x) - len(small.x)
    f = ((small.rss - large.rss) / q) / large.sigma2
    return {"df": q, "df_resid": large.df, "f": f, "p": dist.f_sf(f, q, large.df)}


def influence(df: DataFrame, fit: Ols) -> DataFrame:
    """Residual, leverage, external studentised residual and Cook distance per row."""
    k, n = len(fit.x) + 1, fit.m.n
    e, h = F.col("resid"), F.col("leverage")
    d = df.dropna(subset=[fit.y, *fit.x]).withColumns({"fitted": fit.prediction(), "leverage": fit.leverage()})
    d = d.withColumn("resid", F.col(fit.y) - F.col("fitted"))
    left = (F.lit(fit.rss) - e * e / (1 - h)) / F.lit(n - k - 1)
    return d.withColumns({
        "rstudent": e / F.sqrt(left * (1 - h)),
        "cook": e * e * h / (F.lit(k * fit.sigma2) * (1 - h) * (1 - h))})


def vif(m: Moments, terms: dict[str, Sequence[str]]) -> list[dict]:
    """Generalised variance inflation per term (a term may own several columns)."""
    cols = [c for cs in terms.values() for c in cs]
    s = m.block(cols, cols)
    d = np.sqrt(np.diag(s))
    r = s / np.outer(d, d)
    full = np.linalg.slogdet(r)[1]
    out = []
    for name, cs in terms.items():
        i = [cols.index(c) for c in cs]
        j = [k for k in range(len(cols)) if k not in i]
        own = np.linalg.slogdet(r[np.ix_(i, i)])[1]
        rest = np.linalg.slogdet(r[np.ix_(j, j)])[1] if j else 0.0
        g = math.exp(own + rest - full)
        out.append({"term": name, "gvif": g, "df": len(i), "scaled": g ** (1.0 / (2 * len(i)))})
    return out


def _rss(m: Moments, y: str, x: Sequence[str]) -> float:
    return ols(m, y, x).rss if x else float(m.block([y], [y])[0, 0])


def independent(m: Moments, x: Sequence[str], tolerance: float = 1e-9) -> list[str]:
    """The columns that are no linear combination of those before them."""
    s = m.block(x, x)
    d = np.sqrt(np.maximum(np.diag(s), 1e-300))
    r = s / np.outer(d, d)
    kept: list[int] = []
    for j in range(len(x)):
        if s[j, j] <= 0:
            continue
        left = 1.0 if not kept else 1.0 - r[j, kept] @ np.linalg.solve(r[np.ix_(kept, kept)], r[kept, j])
        if left > tolerance:
            kept.append(j)
    return [x[j] for j in kept]


def best_subsets(m: Moments, y: str, x: Sequence[str], top: int) -> list[list[str]]:
    """The columns of least residual sum of squares for every size, by branch and bound.

    A node keeps some columns for good and may still drop others. Dropping a set raises the residual
    sum by at least the largest single rise in it, and by at least the sum of the single rises over
    the largest eigenvalue of their correlation: both bound what is left to drop from below. The
    column whose loss costs most is decided first, and dropped last.
    """
    s = m.block([*x, y], [*x, y])
    scale = np.sqrt(np.diag(s))
    r = s / np.outer(scale, scale)
    p = len(x)
    full = np.linalg.inv(r[:p, :p])
    out = []
    start = full @ r[:p, p]
    rss_full = 1.0 - r[:p, p] @ start

    def rss(cols: list[int]) -> float:
        return float(1.0 - r[p, cols] @ np.linalg.solve(r[np.ix_(cols, cols)], r[cols, p]))

    backward: dict[int, list[int]] = {p: list(range(p))}
    for k in range(p - 1, 0, -1):
        backward[k] = min(([c for c in backward[k + 1] if c != j] for j in backward[k + 1]), key=rss)
    forward: list[int] = []
    for k in range(1, top + 1):
        forward = forward + [min((j for j in range(p) if j not in forward), key=lambda j: rss([*forward, j]))]
        best = min((sorted(forward), sorted(backward[k])), key=rss)
        found = [rss(best), best]

        def visit(cols: np.ndarray, free: np.ndarray, inverse: np.ndarray, b: np.ndarray, now: float, k: int = k, found: list = found) -> None:
            """cols: what is left; free: which of it may be dropped; inverse and coefficients of cols."""
            drop = len(cols) - k
            if drop == 0:
                if now < found[0] - 1e-13:
                    found[:] = [now, sorted(cols.tolist())]
                return
            at = np.flatnonzero(free)
            if len(at) < drop:
                return
            d = np.sqrt(np.diag(inverse)[at])
            rise = (b[at] / d) ** 2
            least = np.sort(rise)[:drop]
            low = least[-1]
            if drop > 1 and now + low < found[0]:
                low = max(low, least.sum() / np.linalg.eigvalsh(inverse[np.ix_(at, at)] / np.outer(d, d))[-1])
            if now + low >= found[0] - 1e-13:
                return
            j = at[rise.argmax()]
            kept = free.copy()
            kept[j] = False
            visit(cols, kept, inverse, b, now, k, found)
            rest = np.arange(len(cols)) != j
            column = inverse[rest, j]
            visit(cols[rest], free[rest], inverse[np.ix_(rest, rest)] - np.outer(column, column) / inverse[j, j],
                  b[rest] - column * b[j] / inverse[j, j], now + b[j] ** 2 / inverse[j, j], k, found)

        visit(np.arange(p), np.ones(p, bool), full, start, float(rss_full))
        out.append([x[j] for j in found[1]])
    return out


def selection(m: Moments, y: str, x: Sequence[str], method: str = "forward", max_size: int | None = None) -> list[dict]:
    """Best model per size with R2, adjusted R2, Cp and BIC, by exhaustive, forward or backward
    search; every candidate is a sub-matrix, the data are not read again."""
    x = independent(m, list(x))
    top = min(max_size or len(x), len(x))
    tss, n = float(m.block([y], [y])[0, 0]), m.n
    sigma2 = ols(m, y, x).sigma2
    sets: list[list[str]] = []
    if method == "exhaustive":
        sets = best_subsets(m, y, x, top)
    elif method == "forward":
        cur: list[str] = []
        for _ in range(top):
            cur = cur + [min((c for c in x if c not in cur), key=lambda c: _rss(m, y, cur + [c]))]
            sets.append(cur)
    else:
        cur = list(x)
        while cur:
            sets.insert(0, cur)
            if len(cur) == 1:
                break
            gone = min(cur, key=lambda c: _rss(m, y, [v for v in cur if v != c]))
            cur = [v for v in cur if v != gone]
        sets = sets[:top]
    out = []
    for c in sets:
        rss, d = _rss(m, y, c), len(c)
        out.append({"method": method, "size": d, "variables": ",".join(sorted(c)), "r2": 1 - rss / tss,
                    "adj_r2": 1 - (rss / (n - d - 1)) / (tss / (n - 1)),
                    "cp": rss / sigma2 - n + 2 * (d + 1), "bic": n * math.log(rss / tss) + (d + 1) * math.log(n)})
    return out


def chosen(table: Sequence[dict]) -> list[dict]:
    """The winning variable sets by every criterion, one row per variable."""
    out = []
    for method in sorted({r["method"] for r in table}):
        rows = [r for r in table if r["method"] == method]
        best = {"adj_r2": max(rows, key=lambda r: r["adj_r2"]), "cp": min(rows, key=lambda r: r["cp"]),
                "bic": min(rows, key=lambda r: r["bic"])}
        out += [{"method": method, "criterion": k, "variable": v} for k, r in best.items() for v in r["variables"].split(",")]
    return out


def lambda_path(m: Moments, y: str, x: Sequence[str], points: int = 50, ratio: float = 1e-3) -> list[float]:
    """Penalties from the smallest that zeroes every lasso coefficient downward."""
    c, _, _ = _standard(m, y, x)
    top = float(np.abs(c).max())
    return [top * ratio ** (i / (points - 1)) for i in range(points)]


def _standard(m: Moments, y: str, x: Sequence[str]):
    """Cross products per row on columns of unit variance (divisor n)."""
    sd = np.sqrt(np.diag(m.block(x, x)) / m.n)
    r = m.block(x, x) / m.n / np.outer(sd, sd)
    return m.block(x, [y])[:, 0] / m.n / sd, r, sd


def penalised(m: Moments, y: str, x: Sequence[str], lam: float, alpha: float, start: np.ndarray | None = None):
    """Ridge (alpha 0) or lasso (alpha 1) coefficients on the original scale: (intercept, b, standard b)."""
    x = list(x)
    c, r, sd = _standard(m, y, x)
    if alpha == 0:
        z = np.linalg.solve(r + lam * np.eye(len(x)), c)
    else:
        z = np.zeros(len(x)) if start is None else start.copy()
        for _ in range(5000):
            before = z.copy()
            for j in range(len(x)):
                g = c[j] - r[j] @ z + r[j, j] * z[j]
                z[j] = math.copysign(max(abs(g) - lam * alpha, 0.0), g) / (r[j, j] + lam * (1 - alpha))
            if np.abs(z - before).max() < 1e-12:
                break
        else:
            raise ValueError(f"the lasso fit of {y} at {lam} did not settle")
    b = z / sd
    return float(m.mean[m.at([y])[0]] - m.mean[m.at(x)] @ b), b, z


def path(m: Moments, y: str, x: Sequence[str], lambdas: Sequence[float], alpha: float) -> list[dict]:
    out, z = [], None
    for lam in lambdas:
        a, b, z = penalised(m, y, x, lam, alpha, z)
        out.append({"lambda": lam, "intercept": a, "coef": b})
    return out


def hold_out_mse(m: Moments, y: str, x: Sequence[str], intercept: float, b: np.ndarray) -> float:
    """Mean squared error of a linear predictor from the hold-out set's moments alone."""
    sxx, sxy = m.block(x, x), m.block(x, [y])[:, 0]
    bias = m.mean[m.at([y])[0]] - intercept - m.mean[m.at(x)] @ b
    return float((m.block([y], [y])[0, 0] - 2 * b @ sxy + b @ sxx @ b) / m.n + bias ** 2)


def fold_splits(folds: dict) -> list[tuple[Moments, Moments]]:
    """(training, hold-out) moments per fold from one grouped pass: training = total - fold."""
    total = pool(list(folds.values()))
    return [(total.minus(f), f) for f in folds.values()]


def cv_path(folds: dict, y: str, x: Sequence[str], lambdas: Sequence[float], alpha: float) -> list[dict]:
    errors = np.zeros(len(lambdas))
    n = 0.0
    for train, hold in fold_splits(folds):
        for i, r in enumerate(path(train, y, x, lambdas, alpha)):
            errors[i] += hold.n * hold_out_mse(hold, y, x, r["intercept"], r["coef"])
        n += hold.n
    return [{"lambda": lam, "mse": float(e / n)} for lam, e in zip(lambdas, errors)]


def component_regression(m: Moments, y: str, x: Sequence[str], k: int) -> tuple[float, np.ndarray]:
    """Regression on the first k principal components, back on the original scale."""
    c, r, sd = _standard(m, y, x)
    values, vectors = np.linalg.eigh(r)
    v = vectors[:, np.argsort(values)[::-1][:k]]
    b = v @ np.linalg.solve(v.T @ r @ v, v.T @ c) / sd
    return float(m.mean[m.at([y])[0]] - m.mean[m.at(x)] @ b), b


def partial_least_squares(m: Moments, y: str, x: Sequence[str], k: int) -> tuple[float, np.ndarray]:
    """Partial least squares for one response: the fit within the space spanned by c, Rc, R^2 c, ..."""
    c, r, sd = _standard(m, y, x)
    basis: list[np.ndarray] = []
    w = c
    for _ in range(k):
        for _ in range(2):
            for q in basis:
                w = w - (q @ w) * q
        norm = np.linalg.norm(w)
        if norm < 1e-10:
            break
        basis.append(w / norm)
        w = r @ basis[-1]
    q = np.stack(basis, axis=1)
    b = q @ np.linalg.solve(q.T @ r @ q, q.T @ c) / sd
    return float(m.mean[m.at([y])[0]] - m.mean[m.at(x)] @ b), b


def cv_components(folds: dict, y: str, x: Sequence[str], fit) -> list[dict]:
    """Cross-validated error per number of components."""
    out = []
    for k in range(1, len(x) + 1):
        se, n = 0.0, 0.0
        for train, hold in fold_splits(folds):
            a, b = fit(train, y, x, k)
            se += hold.n * hold_out_mse(hold, y, x, a, b)
            n += hold.n
        out.append({"ncomp": k, "rmsep": math.sqrt(se / n)})
    return out
