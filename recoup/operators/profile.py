"""Profiles, box statistics, correlations, distribution comparison, histograms, smoothing."""
from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recoup.functions import dist
from recoup.operators import bands, ranks
from recoup.operators.joins import sized


def melt(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = (), as_text: bool = False) -> DataFrame:
    """Long rows (keep..., variable, value)."""
    kind = "string" if as_text else "double"
    cells = F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).cast(kind).alias("value"))
                      for c in columns])
    return df.select(*keep, F.explode(cells).alias("r")).select(*keep, "r.*")


def profile(df: DataFrame, columns: Sequence[str], probs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Quantiles as one row per group and variable, columns q0, q5, ... q100."""
    q = ranks.exact_quantiles(df, columns, probs, by)
    return q.groupBy(*by, "variable").agg(*[
        F.max(F.when(F.round(F.col("p"), 9) == round(p, 9), F.col("q"))).alias(f"q{p * 100:g}") for p in probs])


def summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column: min, quartiles, mean, max, null count."""
    q = profile(df, columns, [0.25, 0.5, 0.75])
    aggs = []
    for c in columns:
        aggs += [F.min(c).cast("double").alias(f"{c}__min"), F.avg(c).alias(f"{c}__mean"),
                 F.max(c).cast("double").alias(f"{c}__max"),
                 F.count_if(F.col(c).isNull()).alias(f"{c}__nulls")]
    one = df.agg(*aggs)
    rows = one.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("variable"), *[F.col(f"{c}__{k}").alias(k) for k in ("min", "mean", "max", "nulls")])
        for c in columns])).alias("r")).select("r.*")
    return rows.join(q, "variable", "left")  # one row per column on both sides


def values_at(df: DataFrame, column: str, positions: Sequence[int]) -> dict[int, float]:
    """Values at 1-based sorted positions of the non-null values; as many rows as positions."""
    cum = ranks.cumulate(ranks.value_counts(df, column), column, {"upto": "n"})
    wanted = F.array(*[F.lit(int(p)) for p in sorted(set(positions))])
    hit = cum.select(F.col(column).alias("v"), F.explode(F.filter(
        wanted, lambda p: (p > F.col("upto") - F.col("n")) & (p <= F.col("upto")))).alias("p"))
    return {r["p"]: float(r["v"]) for r in hit.collect()}


def trimmed_means(df: DataFrame, column: str, trims: Sequence[float]) -> DataFrame:
    """Means with a share cut from each tail; works on value counts, never on sorted rows."""
    cum = ranks.cumulate(ranks.value_counts(df, column), column, {"upto": "n"})
    n = df.filter(F.col(column).isNotNull()).count()
    aggs = []
    for tr in trims:
        lo = int(math.floor(n * tr + 1e-9)) + 1
        hi = n + 1 - lo
        kept = F.greatest(F.lit(0), F.least(F.col("upto"), F.lit(hi))
                          - F.greatest(F.col("upto") - F.col("n") + 1, F.lit(lo)) + 1)
        aggs.append((F.sum(F.col(column) * kept) / F.sum(kept)).alias(f"trim{round(tr * 100)}"))
    return cum.agg(*aggs)


def box_statistics(df: DataFrame, column: str) -> DataFrame:
    """Whiskers, hinges and median with 1.5 IQR fences, and the number of points beyond."""
    x = F.col(column)
    n = df.filter(x.isNotNull()).count()
    half = ((n + 3) // 2) / 2
    places = [half, (n + 1) / 2, n + 1 - half]
    at = values_at(df, column, [int(f(d)) for d in places for f in (math.floor, math.ceil)])
    h = [0.5 * (at[math.floor(d)] + at[math.ceil(d)]) for d in places]
    lo, hi = h[0] - 1.5 * (h[2] - h[0]), h[2] + 1.5 * (h[2] - h[0])
    inside = x.between(F.lit(lo), F.lit(hi))
    return df.agg(
        F.min(F.when(inside, x)).alias("low"), F.lit(h[0]).alias("q1"), F.lit(h[1]).alias("median"),
        F.lit(h[2]).alias("q3"), F.max(F.when(inside, x)).alias("high"),
        F.count_if(~inside).alias("beyond"))


def contingency(df: DataFrame, row: str, column: str) -> DataFrame:
    """Counts by (row, column) with the row proportion; nulls are left out."""
    c = (df.filter(F.col(row).isNotNull() & F.col(column).isNotNull())
         .groupBy(row, column).agg(F.count(F.lit(1)).alias("n")))
    total = c.groupBy(F.col(row).alias("_r")).agg(F.sum("n").alias("_t"))
    return (c.join(total, c[row] == total["_r"]).withColumn("share", F.col("n") / F.col("_t"))
            .drop("_r", "_t"))


def covariances(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Upper triangle of the sample covariance matrix as rows (by..., a, b, cov)."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    wide = df.groupBy(*by).agg(*[F.covar_samp(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    return wide.select(*by, F.explode(F.array(*[
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{i}").alias("cov"))
        for i, (a, b) in enumerate(pairs)])).alias("r")).select(*by, "r.*")


def correlations(df: DataFrame, columns: Sequence[str], name: str = "r") -> DataFrame:
    """Pairwise-complete Pearson correlations as rows (a, b, r), one aggregate."""
    pairs = list(combinations(columns, 2))
    both = [F.corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)]
    return df.agg(*both).select(F.explode(F.array(*[
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{i}").alias(name))
        for i, (a, b) in enumerate(pairs)])).alias("r")).select("r.*")


def spearman(df: DataFrame, columns: Sequence[str], name: str = "rho") -> DataFrame:
    """Pairwise-complete Spearman correlations as rows (a, b, rho).

    All pairs go through one job: the pair is a group column, so ranks and correlations of
    every pair are computed together; equal values are counted before they are ranked.
    """
    pairs = list(combinations(columns, 2))
    cells = F.array(*[F.struct(F.lit(i).alias("pair"), F.col(a).cast("double").alias("x"),
                               F.col(b).cast("double").alias("y")) for i, (a, b) in enumerate(pairs)])
    # Counted before anything is joined: only distinct pairs of values meet the ranks.
    long = (df.select(F.explode(cells).alias("r")).select("r.*").filter("x IS NOT NULL AND y IS NOT NULL")
            .groupBy("pair", "x", "y").agg(F.count(F.lit(1)).alias("k")))

    def rank(c):
        g = long.groupBy("pair", c).agg(F.sum("k").alias("n"))
        cum = ranks.cumulate(g, c, {"upto": "n"}, ["pair"])
        return cum.select("pair", c, (F.col("upto") - (F.col("n") - 1) / 2.0).alias(f"r{c}"))

    r = long.join(rank("x"), ["pair", "x"]).join(rank("y"), ["pair", "y"])
    # Ranks have the known mean (n + 1) / 2, so centring by it keeps the sums small.
    n = long.groupBy("pair").agg(F.sum("k").alias("m")).collect()  # one row per pair
    half = F.create_map(*[F.lit(v) for row in n for v in (row["pair"], (row["m"] + 1) / 2.0)])[F.col("pair")]
    c = r.select("pair", "k", (F.col("rx") - half).alias("rx"), (F.col("ry") - half).alias("ry"))
    k, rx, ry = F.col("k"), F.col("rx"), F.col("ry")
    out = c.groupBy("pair").agg((F.sum(k * rx * ry) / F.sqrt(F.sum(k * rx * rx) * F.sum(k * ry * ry))).alias(name))
    side = [F.element_at(F.array(*[F.lit(p[k]) for p in pairs]), F.col("pair") + 1) for k in (0, 1)]
    return out.select(side[0].alias("a"), side[1].alias("b"), name)


def correlation_test(r: float, n: int) -> dict[str, float]:
    """t statistic, two-sided p and 95 % limits by the Fisher transform."""
    t = r * math.sqrt((n - 2) / (1 - r * r))
    z, half = math.atanh(r), dist.normal_ppf(0.975) / math.sqrt(n - 3)
    return {"r": r, "t": t, "df": n - 2, "p": dist.t_sf2(t, n - 2),
            "low": math.tanh(z - half), "high": math.tanh(z + half)}


def shares(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    n = df.count()
    return df.groupBy(*keys).agg((F.count(F.lit(1)) / F.lit(float(max(n, 1)))).alias(name))


def compare_distribution(a: DataFrame, b: DataFrame, column: str, bins: int = 20,
                         skip_first: bool = False) -> DataFrame:
    """Shares of two sets by value (under 20 distinct values) or by equal-width bin.

    The bins run over the pooled range; the lowest value falls in bin 1.
    """
    pooled = a.select(column).unionByName(b.select(column))
    lo, hi, few = pooled.agg(F.min(column), F.max(column), F.approx_count_distinct(column)).first()
    few = few < 40 and pooled.select(column).distinct().limit(20).count() < 20
    if few:
        key = F.col(column).cast("double")
    else:
        width = (float(hi) - float(lo)) / bins
        key = bands.equal_width(column, float(lo), width, bins)
        # The largest value may fall past the last edge by rounding; it belongs to the last bin.
        key = F.when(F.col(column) == F.lit(hi), F.lit(bins)).otherwise(key).cast("double")
    sa = shares(a.select(key.alias("bin")), ["bin"], "A")
    sb = shares(b.select(key.alias("bin")), ["bin"], "B")
    out = sa.join(sb, "bin", "full").fillna(0.0, ["A", "B"])
    return out.filter("bin > 1") if skip_first and not few else out


def stability(a: DataFrame, b: DataFrame, columns: Sequence[str], distinct_limit: int = 40,
              step: float = 0.05) -> DataFrame:
    """Population stability index per column.

    More than ``distinct_limit`` values: bands between the pooled 5 % quantiles; otherwise the
    raw values. An empty side of a band gives +infinity. All columns share one long table.
    """
    both = a.select(*columns, F.lit(1).alias("_a")).unionByName(b.select(*columns, F.lit(0).alias("_a")))
    numeric = {f.name for f in both.schema if f.dataType.simpleString() in ("int", "bigint", "double", "float")}
    counts = both.agg(*[F.approx_count_distinct(c).alias(c) for c in columns],
                      F.sum("_a").alias("_na"), F.count(F.lit(1)).alias("_n")).first()
    # The sketch is within a few per cent; only columns near the limit are counted exactly.
    near = [c for c in columns if 0.7 * distinct_limit <= counts[c] <= 1.4 * distinct_limit]
    exact = both.agg(*[F.count_distinct(c).alias(c) for c in near]).first() if near else {}
    many = [c for c in columns if c in numeric and (exact[c] if c in near else counts[c]) > distinct_limit]
    probs = [round(i * step, 10) for i in range(int(round(1 / step)) + 1)]
    cuts: dict[str, list[float]] = {}
    if many:
        for r in ranks.exact_quantiles(both, many, probs).collect():
            cuts.setdefault(r["variable"], []).append(r["q"])
    key = [bands.cut(c, sorted(set(cuts[c])), include_lowest=True).cast("string").alias(c) if c in cuts
           else F.col(c).cast("string").alias(c) for c in columns]
    long = melt(both.select("_a", *key), columns, ["_a"], as_text=True)
    n_a, n_b = float(counts["_na"]), float(counts["_n"] - counts["_na"])
    g = long.groupBy("variable", "value").agg(
        (F.sum("_a") / F.lit(n_a)).alias("x"), (F.sum(1 - F.col("_a")) / F.lit(n_b)).alias("y"))
    x, y = F.col("x"), F.col("y")
    term = F.when((x == 0) | (y == 0), F.lit(float("inf"))).otherwise((x - y) * F.log(x / F.nullif(y, F.lit(0.0))))
    return g.groupBy("variable").agg(F.sum(term).alias("psi"))


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """Count per equal-width bin with its bounds; empty bins are left out."""
    lo, hi = df.agg(F.min(column).cast("double"), F.max(column).cast("double")).first()
    width = (hi - lo) / bins
    b = F.when(F.col(column) == F.lit(hi), F.lit(bins)).otherwise(bands.equal_width(column, lo, width, bins))
    return (df.filter(F.col(column).isNotNull()).groupBy(b.cast("int").alias("bin"))
            .agg(F.count(F.lit(1)).alias("n"))
            .withColumn("low", F.lit(lo) + (F.col("bin") - 1) * F.lit(width)))


def trend(df: DataFrame, y: str, x: str) -> DataFrame:
    return df.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"),
                  F.count(F.lit(1)).alias("n"))


def smoother(df: DataFrame, x: str, y: str, span: float, grid: Sequence[float], passes: int = 0) -> DataFrame:
    """Local linear smoother at given points: tricube weights over the nearest share of rows.

    Works on the table of distinct x values with (count, sum y), so duplicated x cost
    nothing. For each grid point the distance to the k-th nearest row is found from counts
    by distance; robust passes re-weight rows by their residual from the interpolated curve.
    """
    rows = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(
        F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    n = rows.count()
    k = max(2, min(n, int(span * n + 1e-9)))
    points = [float(g) for g in sorted(grid)]
    at = F.explode(F.array(*[F.lit(g) for g in points]))
    near = (rows.groupBy("x").agg(F.count(F.lit(1)).alias("n"))
            .select("n", "x", at.alias("x0")).withColumn("d", F.abs(F.col("x") - F.col("x0")))
            .groupBy("x0", "d").agg(F.sum("n").alias("n")))
    cum = ranks.cumulate(near, "d", {"upto": "n"}, ["x0"])
    width = {r["x0"]: r["h"] for r in cum.filter(F.col("upto") >= k).groupBy("x0").agg(
        F.min("d").alias("h")).collect()}  # one row per grid point

    def fit(weighted: DataFrame) -> dict[float, float]:
        """Weighted line at every grid point from grouped sums."""
        h = F.create_map(*[F.lit(v) for g in points for v in (g, max(width[g], 1e-12))])
        e = weighted.select("x", "w", "wy", at.alias("x0"))
        u = F.abs(F.col("x") - F.col("x0")) / h[F.col("x0")]
        tri = F.when(u < 1, F.pow(1 - F.pow(u, F.lit(3)), F.lit(3)))
        e = e.withColumn("t", tri).filter("t IS NOT NULL").withColumn("dx", F.col("x") - F.col("x0"))
        w, dx, t = F.col("w"), F.col("dx"), F.col("t")
        s = e.groupBy("x0").agg(F.sum(t * w).alias("s0"), F.sum(t * w * dx).alias("s1"),
                                F.sum(t * w * dx * dx).alias("s2"), F.sum(t * F.col("wy")).alias("v0"),
                                F.sum(t * F.col("wy") * dx).alias("v1")).collect()
        out = {}
        for r in s:
            det = r["s0"] * r["s2"] - r["s1"] ** 2
            flat = r["s2"] <= 1e-12 * max(r["s0"], 1.0) or abs(det) < 1e-12 * max(1.0, r["s0"] * r["s2"])
            out[r["x0"]] = r["v0"] / r["s0"] if flat else (r["s2"] * r["v0"] - r["s1"] * r["v1"]) / det
        return out

    base = rows.groupBy("x").agg(F.count(F.lit(1)).cast("double").alias("w"), F.sum("y").alias("wy"))
    fitted = fit(base)
    for _ in range(passes):
        curve = interpolate(F.col("x"), points, [fitted[g] for g in points])
        res = rows.withColumn("e", F.abs(F.col("y") - curve))
        s = 6.0 * ranks.quantile_list(res, "e", [0.5])[0]
        b = F.when(F.col("e") < F.lit(s), F.pow(1 - F.pow(F.col("e") / F.lit(max(s, 1e-12)), F.lit(2)), F.lit(2))).otherwise(0.0)
        fitted = fit(res.withColumn("b", b).groupBy("x").agg(
            F.sum("b").alias("w"), F.sum(F.col("b") * F.col("y")).alias("wy")))
    return df.sparkSession.createDataFrame([(g, float(fitted[g])) for g in points], "x double, smooth double")


def interpolate(x: Column, xs: Sequence[float], ys: Sequence[float]) -> Column:
    """Piecewise linear curve through a few points as a column, flat outside."""
    out = F.when(x <= F.lit(xs[0]), F.lit(ys[0]))
    for (a, ya), (b, yb) in zip(zip(xs, ys), zip(xs[1:], ys[1:])):
        out = out.when(x <= F.lit(b), F.lit(ya) + (x - F.lit(a)) * F.lit((yb - ya) / (b - a)))
    return out.otherwise(F.lit(ys[-1]))


def qq_points(df: DataFrame, column: str, points: int = 100) -> DataFrame:
    """Sample quantiles against standard normal quantiles on a grid of plotting positions."""
    probs = [(i - 0.5) / points for i in range(1, points + 1)]
    theory = F.create_map(*[F.lit(v) for p in probs for v in (p, dist.normal_ppf(p))])
    q = ranks.exact_quantiles(df, [column], probs)
    return q.select("p", theory[F.col("p")].alias("normal"), F.col("q").alias("sample"))
