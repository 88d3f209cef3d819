"""Distribution functions on single numbers, for test statistics already reduced to scalars."""
from __future__ import annotations

import math


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 500):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1.0) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1.0)),
        ):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return h


def beta_cdf(x: float, a: float, b: float) -> float:
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
                     + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def f_sf(f: float, d1: float, d2: float) -> float:
    """P(F > f)."""
    return 1.0 if f <= 0 else beta_cdf(d2 / (d2 + d1 * f), d2 / 2.0, d1 / 2.0)


def t_sf2(t: float, df: float) -> float:
    """Two-sided tail probability of Student's t."""
    return beta_cdf(df / (df + t * t), df / 2.0, 0.5)


def t_cdf(t: float, df: float) -> float:
    tail = t_sf2(t, df) / 2.0
    return 1.0 - tail if t > 0 else tail


def _invert(cdf, p: float, lo: float, hi: float) -> float:
    while cdf(lo) > p:
        lo *= 2.0
    while cdf(hi) < p:
        hi *= 2.0
    for _ in range(200):
        mid = (lo + hi) / 2.0
        if cdf(mid) < p:
            lo = mid
        else:
            hi = mid
        if hi - lo <= 1e-14 * max(1.0, abs(mid)):
            break
    return (lo + hi) / 2.0


def t_ppf(p: float, df: float) -> float:
    # By symmetry only the lower tail is inverted, where the tail keeps full precision.
    if p > 0.5:
        return -t_ppf(1.0 - p, df)
    return _invert(lambda t: t_cdf(t, df), p, -10.0, 0.0) if p < 0.5 else 0.0


def chi2_sf(x: float, df: float) -> float:
    """P(chi-square > x), by series below and by continued fraction above the mean."""
    if x <= 0:
        return 1.0
    a, z = df / 2.0, x / 2.0
    front = math.exp(-z + a * math.log(z) - math.lgamma(a))
    if z < a + 1.0:
        term = total = 1.0 / a
        n = a
        while abs(term) > 1e-16 * abs(total):
            n += 1.0
            term *= z / n
            total += term
        return 1.0 - total * front
    b = z + 1.0 - a
    c, d = 1e300, 1.0 / b
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2.0
        d = 1.0 / (an * d + b)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return front * h


def normal_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2.0))


def normal_ppf(p: float) -> float:
    return _invert(normal_cdf, p, -40.0, 40.0)


def chi2_ppf(p: float, df: float) -> float:
    return _invert(lambda x: 1.0 - chi2_sf(x, df), p, 1e-12, 10.0)
