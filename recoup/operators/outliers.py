"""Outlier tests in one and several dimensions."""
from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recoup.functions import dist
from recoup.operators import ranks


def grubbs(df: DataFrame, column: str, alpha: float = 0.05) -> dict[str, float]:
    """Largest standardised distance and its critical value."""
    m, s, n = df.agg(F.avg(column), F.stddev_samp(column), F.count(column)).first()
    far = df.agg(F.max(F.abs(F.col(column) - F.lit(m)))).first()[0]
    t2 = dist.t_ppf(0.5 * alpha / n, n - 2) ** 2
    critical = (n - 1) / math.sqrt(n) * math.sqrt(t2 / (n - 2 + t2))
    g = far / s
    return {"n": n, "G": g, "critical": critical, "outlier": g > critical}


def tietjen_moore(df: DataFrame, column: str, k: int) -> DataFrame:
    """Variance ratios after dropping the k smallest (L_low), k largest (L_high) and k farthest (E).

    Each ratio needs sums over the kept rows only; those come from value counts and their
    running positions, so any k works and no row list is held.
    """
    x = F.col(column).cast("double")
    m, n = df.agg(F.avg(x), F.count(x)).first()
    v = (df.filter(x.isNotNull()).groupBy((x - F.lit(m)).alias("z")).agg(F.count(F.lit(1)).alias("n"))
         .withColumn("r", F.abs("z")))
    up = ranks.cumulate(v, "z", {"upto": "n"})
    far = ranks.cumulate(v, "r", {"upto": "n"}, tie="z")

    def spread(kept):
        z = F.col("z")
        return F.sum(kept * z * z) - F.sum(kept * z) * F.sum(kept * z) / F.sum(kept)

    before = F.col("upto") - F.col("n")
    high = F.greatest(F.lit(0), F.col("upto") - F.greatest(before, F.lit(k)))
    low = F.greatest(F.lit(0), F.least(F.col("upto"), F.lit(n - k)) - before)
    den = F.sum(F.col("n") * F.col("z") * F.col("z"))
    a = up.agg((spread(high) / den).alias("L_low"), (spread(low) / den).alias("L_high"))
    b = far.agg((spread(low) / den).alias("E")).first()[0]
    return a.withColumn("E", F.lit(float(b)))


def esd_steps(df: DataFrame, column: str, r: int, alpha: float = 0.05) -> list[dict]:
    """Generalised ESD statistics R_1..R_r with critical values.

    The farthest row is always the smallest or largest one left, so the r smallest and r
    largest values and three sums are enough; r is the analyst's bound on outliers.
    """
    x = F.col(column).cast("double")
    n, m = df.agg(F.count(x), F.avg(x)).first()
    z = df.filter(x.isNotNull()).select((x - F.lit(m)).alias("z"))
    s, ss = z.agg(F.sum("z"), F.sum(F.col("z") * F.col("z"))).first()
    r = min(r, n - 2)
    low = [row[0] for row in z.orderBy("z").limit(r).collect()]
    high = [row[0] for row in z.orderBy(F.desc("z")).limit(r).collect()]
    out, i, j, left = [], 0, 0, n
    for step in range(1, r + 1):
        mean = s / left
        sd = math.sqrt(max((ss - s * s / left) / (left - 1), 0.0))
        take_low = mean - low[i] > high[j] - mean
        value = low[i] if take_low else high[j]
        p = alpha / (2 * (n - step + 1))
        t = dist.t_ppf(1 - p, n - step - 1) if p > 1e-9 else -dist.t_ppf(p, n - step - 1)
        lam = (n - step) * t / math.sqrt((n - step - 1 + t * t) * (n - step + 1))
        out.append({"i": step, "R": abs(value - mean) / sd if sd > 0 else 0.0, "critical": lam, "value": value + m})
        i, j = (i + 1, j) if take_low else (i, j + 1)
        s, ss, left = s - value, ss - value * value, left - 1
    return out


def mean_cov(df: DataFrame, columns: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Mean vector and sample covariance: p + p(p+1)/2 numbers."""
    p = len(columns)
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    r = df.agg(*[F.avg(c) for c in columns], *[F.covar_samp(columns[i], columns[j]) for i, j in pairs]).first()
    cov = np.zeros((p, p))
    for v, (i, j) in zip(r[p:], pairs):
        cov[i, j] = cov[j, i] = v
    return np.array(r[:p], dtype=float), cov


def quadratic_form(columns: Sequence[str], centre: np.ndarray, matrix: np.ndarray):
    """(x - c)' M (x - c) as one column expression."""
    d = [F.col(c).cast("double") - F.lit(float(m)) for c, m in zip(columns, centre)]
    total = F.lit(0.0)
    for i in range(len(d)):
        for j in range(i, len(d)):
            w = float(matrix[i, j]) * (1.0 if i == j else 2.0)
            total = total + F.lit(w) * d[i] * d[j]
    return total


def robust_mahalanobis(df: DataFrame, columns: Sequence[str], keep: float = 0.75, rounds: int = 5,
                       level: float = 0.975) -> DataFrame:
    """Squared-root distance from a trimmed centre and covariance, and an outlier flag.

    Each round keeps the nearest share of rows and re-estimates; the estimate is scaled so
    that the median distance matches the chi-square median. Two small summaries per round.
    """
    data = df.dropna(subset=list(columns))
    centre, cov = mean_cov(data, columns)
    for _ in range(rounds):
        d2 = quadratic_form(columns, centre, np.linalg.inv(cov))
        cut = ranks.quantile_list(data.select(d2.alias("d2")), "d2", [keep])[0]
        centre, cov = mean_cov(data.filter(d2 <= F.lit(cut)), columns)
    p = len(columns)
    d2 = quadratic_form(columns, centre, np.linalg.inv(cov))
    median = ranks.quantile_list(data.select(d2.alias("d2")), "d2", [0.5])[0]
    scale = median / dist.chi2_ppf(0.5, p)
    limit = math.sqrt(dist.chi2_ppf(level, p))
    out = data.withColumn("md", F.sqrt(d2 / F.lit(scale)))
    return out.withColumn("outlier", F.col("md") > F.lit(limit))
