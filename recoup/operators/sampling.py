"""Reproducible samples, splits, folds, bootstrap replicates and matched draws.

All randomness is a digest of a key, so a sample can be repeated and checked, does not depend
on partitioning, and survives the loss of an executor.
"""
from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recoup.functions.keys import digest, hex_number
from recoup.operators.ranks import digest_threshold, shuffled_position, smallest

# Cumulative Poisson(1) probabilities P(X <= k), k = 0..12.
POISSON1 = [math.exp(-1.0) * sum(1.0 / math.factorial(i) for i in range(k + 1)) for k in range(13)]


def sample_n(df: DataFrame, key: str, seed: str, n: int) -> DataFrame:
    return smallest(df, key, seed, n)


def split(df: DataFrame, key: str, seed: str, share: float) -> tuple[DataFrame, DataFrame]:
    """A part of floor(share * n) rows and its complement, both as filters on the digest."""
    return split_n(df, key, seed, int(math.floor(share * df.count() + 1e-9)))


def split_n(df: DataFrame, key: str, seed: str, n: int) -> tuple[DataFrame, DataFrame]:
    top = digest_threshold(df, key, seed, n)
    if top is None:
        return df.filter(F.lit(False)), df
    return df.filter(digest(key, seed) <= F.lit(top)), df.filter(digest(key, seed) > F.lit(top))


def draws(n: int, seed: str, spark, count: int | None = None) -> DataFrame:
    """``count`` draws with replacement from positions 1..n."""
    pos = F.pmod(hex_number(digest("draw", seed), 1, 15), F.lit(int(n))) + 1
    return (spark.range(1, (count or n) + 1).withColumnRenamed("id", "draw")
            .withColumn("position", pos))


def fetch_draws(df: DataFrame, key: str, seed: str = "draw", order_seed: str = "pos",
                count: int | None = None) -> DataFrame:
    """Rows fetched by a drawn list of positions; repeated draws repeat the row."""
    n = df.count()
    return draws(n, seed, df.sparkSession, count).join(
        shuffled_position(df, key, order_seed), "position")


def poisson_count(digits: Column) -> Column:
    """Poisson(1) count of a uniform given by 8 hex digits.

    Hex digits order as text, so the cumulative probabilities are compared as text and no
    digit is converted to a number.
    """
    out = None
    for k, c in enumerate(POISSON1):
        edge = math.ceil(c * 4294967296.0)
        if edge > 0xFFFFFFFF:
            break
        below = digits < F.lit(f"{edge:08x}")
        out = F.when(below, F.lit(k)) if out is None else out.when(below, F.lit(k))
    return out.otherwise(F.lit(k)).cast("int")


def replicates(df: DataFrame, key: str, b: int, prefix: str = "b") -> DataFrame:
    """One row per (row, replicate) with its bootstrap multiplicity ``w``; w = 0 is out of bag.

    A digest has room for four uniforms, so four replicates share one.
    """
    blocks = -(-b // 4)
    e = df.withColumn("_block", F.explode(F.sequence(F.lit(1), F.lit(blocks))))
    e = e.withColumn("_d", digest(key, F.concat(F.lit(prefix), F.col("_block").cast("string"))))
    e = e.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(3))))
    rep = (F.col("_block") - 1) * 4 + F.col("_i") + 1
    e = e.withColumn("rep", rep).filter(F.col("rep") <= b)
    digits = F.substring(F.col("_d"), F.col("_i") * 8 + 1, F.lit(8))
    return e.select(*df.columns, "rep", poisson_count(digits).alias("w"))


def matched(df: DataFrame, need: DataFrame, key: str, cells: Sequence[str], ratio: int,
            seed: str) -> DataFrame:
    """``ratio`` reference rows per wanted row in every cell, at most what the cell holds.

    ``need`` has the cell columns and ``wanted`` (rows to match).
    """
    quota = need.select(*cells, (F.col("wanted") * F.lit(ratio)).alias("quota"))
    return smallest(df, key, seed, quota, cells)


def balanced(df: DataFrame, key: str, label: str, per_class: int, seed: str = "bal") -> DataFrame:
    """``per_class`` draws with replacement from every class (two to a few classes)."""
    sizes = df.groupBy(label).count().orderBy(label).collect()  # one row per class
    placed = shuffled_position(df, key, "pos", by=[label])
    spark = df.sparkSession
    out = None
    for r in sizes:
        d = draws(r["count"], f"{seed}{r[label]}", spark, per_class).withColumn(
            label, F.lit(r[label]).cast(df.schema[label].dataType))
        out = d if out is None else out.unionByName(d)
    return out.join(placed, [label, "position"])


def blocks(series: DataFrame, group: str, t: str, length: int, replicate_count: int, seed: str) -> DataFrame:
    """Block bootstrap: non-overlapping blocks drawn with replacement and laid end to end.

    Returns (group, rep, slot, t, value...) where ``slot`` is the drawn block's place; only the
    drawn block numbers are generated, the values come by an equi join on (group, block).
    """
    b = F.floor((F.col(t) - 1) / F.lit(length))
    cut = series.withColumn("block", b)
    sizes = series.groupBy(group).agg(F.ceil(F.max(t) / F.lit(length)).alias("m"))
    drawn = (
        sizes.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(replicate_count))))
        .withColumn("slot", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("m") - 1)))
        .withColumn("block", F.pmod(hex_number(
            digest(F.concat_ws("_", F.col(group), F.col("rep"), F.col("slot")), seed), 1, 8), F.col("m")))
        .drop("m"))
    return drawn.join(cut, [group, "block"])


def autocorrelation(series: DataFrame, group: str, t: str, value: str, lags: int) -> DataFrame:
    """Autocorrelations of lags 1..L per series.

    A value meets its later neighbours by an equi join on (series, position).
    """
    mean = series.groupBy(F.col(group).alias("_g")).agg(F.avg(value).alias("_m"))
    z = series.join(mean, F.col(group) == F.col("_g")).select(
        group, F.col(t).alias("t"), (F.col(value) - F.col("_m")).alias("z"))
    var = z.groupBy(F.col(group).alias("_g")).agg(F.sum(F.col("z") * F.col("z")).alias("_v"))
    ahead = z.select(group, F.col("z").alias("_z0"), F.explode(F.sequence(F.lit(1), F.lit(lags))).alias("lag"), "t")
    ahead = ahead.select(group, "lag", "_z0", (F.col("t") + F.col("lag")).alias("t"))
    c = z.join(ahead, [group, "t"]).groupBy(group, "lag").agg(F.sum(F.col("z") * F.col("_z0")).alias("_c"))
    return c.join(var, F.col(group) == F.col("_g")).select(group, "lag", (F.col("_c") / F.col("_v")).alias("acf"))


def partial_autocorrelation(acf: DataFrame, group: str) -> DataFrame:
    """Partial autocorrelations by the Durbin-Levinson recursion, one small task per series."""
    import pandas as pd

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        rho = pdf.sort_values("lag")["acf"].to_numpy()  # one number per lag
        prev, out = [], []
        for k in range(1, len(rho) + 1):
            num = rho[k - 1] - sum(p * rho[k - 2 - i] for i, p in enumerate(prev))
            den = 1.0 - sum(p * rho[i] for i, p in enumerate(prev))
            last = num / den
            prev = [p - last * q for p, q in zip(prev, reversed(prev))] + [last]
            out.append(last)
        return pd.DataFrame({group: pdf[group].iloc[0], "lag": range(1, len(rho) + 1), "pacf": out})

    kind = acf.schema[group].dataType.simpleString()
    return acf.groupBy(group).applyInPandas(solve, f"{group} {kind}, lag int, pacf double")
