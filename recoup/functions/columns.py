"""Small column expressions shared by the operators."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(num: Column, den: Column) -> Column:
    """Null instead of an error when the denominator is zero."""
    return num / F.nullif(den, F.lit(0).cast("double"))


def rnd(c: Column | str, digits: int = 6) -> Column:
    return F.round(col(c).cast("double"), digits)


def truncate(c: Column | str) -> Column:
    """Drop the fraction, toward zero."""
    c = col(c)
    return F.when(c >= 0, F.floor(c)).otherwise(F.ceil(c)).cast("int")


def cents(c: Column) -> Column:
    return F.floor(c * 100).cast("double") / F.lit(100.0)


def linear(terms: dict[str, float], intercept: float = 0.0, prefix: str = "") -> Column:
    """intercept + sum of coefficient * column as one JVM expression."""
    parts = [F.lit(float(b)) * F.col(prefix + v) for v, b in terms.items()]
    return reduce(lambda a, b: a + b, parts, F.lit(float(intercept)))


def logistic(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def step(x: Column) -> Column:
    return F.when(x >= 0, F.lit(1.0)).otherwise(F.lit(0.0))


def relu(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0))


def n_rows(name: str = "n") -> Column:
    return F.count(F.lit(1)).alias(name)
