"""Joins beyond the plain ones: prefixed clashes, blow-up guard, interval and look-back joins."""
from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recoup.functions.keys import fold
from recoup.operators.ranks import BROADCAST_ROWS

STEP = 8
"""Ratio of the widths of neighbouring grids of the interval join."""


def sized(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast a counted small frame; leave a larger one to the planner."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def keyed(x: DataFrame, y: DataFrame, on: Sequence[str], how: str = "left") -> DataFrame:
    """All rows of ``y`` with the columns of ``x``; clashing columns of ``y`` get ``i_``."""
    on = list(on)
    clash = [c for c in y.columns if c in x.columns and c not in on]
    y = y.withColumnsRenamed({c: f"i_{c}" for c in clash})
    return y.join(x, on, how).select(*on, *[c for c in x.columns if c not in on],
                                     *[c for c in y.columns if c not in on])


def join_size(x: DataFrame, y: DataFrame, on: Sequence[str]) -> int:
    """Exact number of rows of the inner equi join, from two group counts."""
    on = list(on)
    a = x.groupBy(*on).agg(F.count(F.lit(1)).alias("nx"))
    b = y.groupBy(*on).agg(F.count(F.lit(1)).alias("ny"))
    return a.join(b, on).agg(F.coalesce(F.sum(F.col("nx") * F.col("ny")), F.lit(0))).first()[0]


def guarded(x: DataFrame, y: DataFrame, on: Sequence[str], allow_cartesian: bool = False) -> DataFrame:
    """Inner join that refuses to return more rows than both inputs together hold."""
    if not allow_cartesian:
        rows, limit = join_size(x, y, on), x.count() + y.count()
        if rows > limit:
            raise ValueError(f"join would return {rows} rows, more than {limit}; pass allow_cartesian=True")
    return x.join(y, list(on))


def overlap(x: DataFrame, y: DataFrame, x_id: str, x_lo: str, x_hi: str, y_lo: str, y_hi: str,
            rows_per_cell: int = 1_000_000) -> DataFrame:
    """Pairs with ``x_lo <= y_hi`` and ``y_lo <= x_hi``, each pair once.

    Intervals lie on grids of growing width, each on the finest one of which it covers two cells at
    most (its own), and visit the coarser ones. A pair meets, by an equi join on the cell, on the
    coarser of the two own grids, in the first cell that both cover there. The copies of a row
    follow from the spread of the lengths, not from the number of rows. A cell that holds many rows
    of ``x`` is salted, and the rows of ``y`` in it are repeated once per salt.
    """
    def span(df: DataFrame, lo: str, hi: str) -> DataFrame:
        length = F.col(hi) - F.col(lo)
        return df.agg(F.least(F.min(lo), F.min(hi)).cast("double").alias("a"), F.greatest(F.max(lo), F.max(hi)).cast("double").alias("b"),
                      F.percentile_approx(F.when(length > 0, length.cast("double")), 0.5).alias("w"))

    ends = [r for r in (span(x, x_lo, x_hi).first(), span(y, y_lo, y_hi).first()) if r["a"] is not None]
    base = min((r["a"] for r in ends), default=0.0)
    whole = max((r["b"] for r in ends), default=0.0) - base
    width = min((r["w"] for r in ends if r["w"]), default=whole / 4096) or 1.0
    width = max(width, whole / 2 ** 40)
    top = max(0, math.ceil(math.log(max(whole / width, 1.0), STEP)))

    def placed(df: DataFrame, lo: str, hi: str, mark: str) -> DataFrame:
        length = (F.col(hi) - F.col(lo)) / F.lit(width)
        own = F.when(length > 1, F.least(F.lit(top), F.ceil(F.log(float(STEP), length)))).otherwise(0).cast("int")
        level = df.withColumn(f"_{mark}own", own).withColumn("_level", F.explode(F.sequence(F.col(f"_{mark}own"), F.lit(top))))
        grid = F.lit(width) * F.pow(F.lit(float(STEP)), F.col("_level"))
        first = F.floor((F.col(lo) - F.lit(base)) / grid)
        last = F.floor((F.col(hi) - F.lit(base)) / grid)
        return level.withColumn(f"_{mark}first", first).withColumn("_cell", F.explode(F.sequence(first, F.greatest(first, last))))

    xs, ys = placed(x, x_lo, x_hi, "x"), placed(y, y_lo, y_hi, "y")
    largest = xs.groupBy("_level", "_cell").count().agg(F.max("count")).first()[0] or 0
    salts = -(-largest // rows_per_cell) or 1
    xs = xs.withColumn("_salt", fold(x_id, "salt", salts))
    ys = ys.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    on = ["_level", "_cell", "_salt"]
    at_home = F.col("_xown") == F.col("_level")
    pairs = (xs.filter(at_home).join(ys, on)
             .unionByName(xs.filter(~at_home).join(ys.filter(F.col("_yown") == F.col("_level")), on)))
    return (pairs.filter((F.col(x_lo) <= F.col(y_hi)) & (F.col(y_lo) <= F.col(x_hi)) & (F.col("_cell") == F.greatest("_xfirst", "_yfirst")))
            .drop("_level", "_cell", "_salt", "_xown", "_yown", "_xfirst", "_yfirst"))


def look_back(events: DataFrame, key: str, month: str, marked, measured: str, back: int,
              name: str) -> DataFrame:
    """Flag rows whose ``marked`` month had ``measured`` > 0 in it or the ``back`` months before.

    Every measured month marks the months it can explain, so both passes aggregate by key and
    month and no pair of months is materialised beyond ``back + 1`` per row.
    """
    hits = (events.filter(F.coalesce(F.col(measured), F.lit(0)) > 0)
            .select(key, F.explode(F.sequence(F.col(month), F.col(month) + back)).alias(month))
            .distinct().withColumn("_hit", F.lit(1)))
    flagged = (events.filter(marked).select(key, month).distinct()
               .join(hits, [key, month], "left")
               .select(key, month, F.coalesce("_hit", F.lit(0)).alias(name)))
    return events.join(flagged, [key, month], "left")


def parameter_grid(df: DataFrame, **values: Sequence) -> DataFrame:
    """Every row of a small parameter table with every combination of the listed values."""
    for name, vals in values.items():
        df = df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in vals])))
    return df


def outer_shares(a: DataFrame, b: DataFrame, on: Sequence[str], left: str, right: str) -> DataFrame:
    """Full outer join of two share tables, missing shares as 0."""
    return a.join(b, list(on), "full").fillna(0.0, [left, right])
