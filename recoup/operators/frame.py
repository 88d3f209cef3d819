"""Column work: recoding, indicator and polynomial terms, grids."""
from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recoup.functions.columns import col


def dummies(df: DataFrame, column: str, levels: Sequence, prefix: str | None = None) -> DataFrame:
    """Treatment coding: one 0/1 column per level except the first, which is the base."""
    p = prefix or column
    return df.withColumns({
        f"{p}_{i}": F.when(F.col(column).isNotNull(), (F.col(column) == F.lit(v)).cast("int"))
        for i, v in enumerate(levels) if i > 0})


def poly_terms(df: DataFrame, column: str, degree: int) -> dict[str, Column]:
    """Orthonormal polynomial columns of degree 1..3, from the moments of the centred column.

    Only the moments (at most seven numbers) reach the driver.
    """
    x = F.col(column).cast("double")
    m, s = df.agg(F.avg(x), F.stddev_samp(x)).first()
    z = (x - F.lit(m)) / F.lit(s)
    powers = df.agg(*[F.sum(F.pow(z, F.lit(k))) for k in range(2 * degree + 1)]).first()
    mu = [float(v) for v in powers]

    def inner(a: list[float], b: list[float]) -> float:
        return sum(p * q * mu[i + j] for i, p in enumerate(a) for j, q in enumerate(b))

    basis: list[list[float]] = [[1.0 / math.sqrt(mu[0])]]
    for d in range(1, degree + 1):
        v = [0.0] * d + [1.0]
        for _ in range(2):  # second sweep removes rounding left by the first
            for b in basis:
                c = inner(v, b)
                v = [a - c * (b[i] if i < len(b) else 0.0) for i, a in enumerate(v)]
        norm = math.sqrt(inner(v, v))
        basis.append([a / norm for a in v])
    out = {}
    for d, b in enumerate(basis[1:], 1):
        e = F.lit(0.0)
        for a in reversed(b):
            e = e * z + F.lit(a)
        out[f"{column}_p{d}"] = e
    return out


def regular_grid(df: DataFrame, column: str, points: int) -> DataFrame:
    """``points`` evenly spaced values from the column's minimum to its maximum."""
    lo_hi = df.agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    step = (F.col("hi") - F.col("lo")) / F.lit(float(points - 1))
    return (lo_hi.select("lo", step.alias("step"), F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i"))
            .select("i", (F.col("lo") + F.col("step") * F.col("i")).alias(column)))


def first_rows(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def row_at(df: DataFrame, order: Sequence[str], position: int) -> DataFrame:
    """The row at a 1-based position in the order of numeric columns, found by bucketed ranks."""
    from recoup.operators.ranks import ordered_position

    tie = order[1] if len(order) > 1 else order[0]
    return ordered_position(df, order[0], tie, "_at").filter(F.col("_at") == position).drop("_at")


def fill(x: Column | str, value) -> Column:
    return F.coalesce(col(x), value if isinstance(value, Column) else F.lit(value))
