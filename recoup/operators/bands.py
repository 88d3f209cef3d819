"""Bands with right-closed intervals, and column scaling."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recoup.functions.columns import col
from recoup.operators.ranks import bucket_of, quantile_list

# Debt bands of the monthly recovery table and of the DPD fill, and payment bands.
TOA_BREAKS = [0, 1000, 2000, 4000, 6000, 10000, 20000, 40000, 65000, 100000]
TOA_LABEL_BREAKS = [1000, 5000, 10000, 20000, 30000]
TOA_LABELS = ["1. 1k", "2. 5k", "3. 10k", "4. 20k", "5. 30k", "6. 30k+"]
PAYMENT_BREAKS = [0, 50, 300, 60000]


def cut(x: Column | str, breaks: Sequence[float], include_lowest: bool = False) -> Column:
    """Band number 1..m for intervals (lo, hi]; null outside the breaks.

    ``include_lowest`` closes the first interval on the left.
    """
    x = col(x)
    b = [float(v) for v in breaks]
    low = x >= b[0] if include_lowest else x > b[0]
    inner = bucket_of(x, b[1:-1]) + 1
    return F.when(low & (x <= b[-1]), inner).cast("int")


def labelled(x: Column | str, breaks: Sequence[float], labels: Sequence[str]) -> Column:
    """A text label per interval, both ends open."""
    x = col(x)
    out = None
    for b, name in zip(breaks, labels):
        out = F.when(x <= b, name) if out is None else out.when(x <= b, name)
    return out.when(x > breaks[-1], labels[-1])


def edges(df: DataFrame, column: str, ncut: int) -> list[float]:
    """Distinct quantile edges; repeated edges collapse."""
    q = quantile_list(df, column, [i / ncut for i in range(ncut + 1)])
    return sorted(set(q))


def quantile_band(df: DataFrame, column: str, ncut: int, name: str | None = None,
                  include_lowest: bool = True) -> DataFrame:
    return df.withColumn(name or f"{column}_band",
                         cut(column, edges(df, column, ncut), include_lowest))


def equal_width(x: Column | str, low: float, width: float, bins: int) -> Column:
    """Bin 1..bins of constant width, the lowest value included, null outside."""
    x = col(x)
    b = F.greatest(F.ceil((x - F.lit(float(low))) / F.lit(float(width))), F.lit(1))
    return F.when((x >= low) & (b <= bins), b).cast("int")


def supplied(x: Column | str, bands: Sequence[float], prefix: str) -> Column:
    """Label by the first supplied edge that holds the value; below the first edge the
    value still takes the next one, as the fill only looks at upper edges."""
    x = col(x)
    out = F.when((x >= bands[0]) & (x <= bands[1]), f"{prefix}1")
    for i in range(2, len(bands)):
        out = out.when(x <= bands[i], f"{prefix}{i}")
    return out


def scale_params(df: DataFrame, columns: Sequence[str], method: str = "z") -> dict[str, tuple[float, float]]:
    """(shift, width) per column: two numbers per column reach the driver."""
    if method == "z":
        aggs = [f(c).alias(f"{c}_{k}") for c in columns
                for k, f in (("a", F.avg), ("b", F.stddev_samp))]
    else:
        aggs = [f(c).alias(f"{c}_{k}") for c in columns for k, f in (("a", F.min), ("b", F.max))]
    r = df.agg(*aggs).first()
    out = {}
    for c in columns:
        a, b = r[f"{c}_a"], r[f"{c}_b"]
        out[c] = (float(a), float(b) if method == "z" else float(b) - float(a))
    return out


def apply_scale(df: DataFrame, params: dict[str, tuple[float, float]], suffix: str) -> DataFrame:
    """A column of zero width scales to null rather than to an error."""
    return df.withColumns({
        f"{c}{suffix}": (F.col(c) - F.lit(a)) / F.nullif(F.lit(b), F.lit(0.0))
        for c, (a, b) in params.items()})


def band_bounds(df: DataFrame, value: str, code: str) -> list[tuple[float | None, float]]:
    """(upper bound, code) per coded band, the bound halfway to the next band; last open."""
    t = (df.groupBy(code).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
         .orderBy("lo").collect())  # one row per band
    out = []
    for a, b in zip(t, t[1:]):
        out.append(((a["hi"] + b["lo"]) / 2.0, a[code]))
    out.append((None, t[-1][code]))
    return out


def lookup(x: Column | str, bounds: Sequence[tuple[float | None, object]]) -> Column:
    """First code whose bound exceeds the value; the last band is open."""
    x = col(x)
    out = None
    for bound, code in bounds:
        if bound is None:
            return F.lit(code) if out is None else out.otherwise(F.lit(code))
        out = F.when(x < bound, F.lit(code)) if out is None else out.when(x < bound, F.lit(code))
    return out
