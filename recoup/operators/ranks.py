"""Exact ranks, running totals, quantiles and smallest-k selection without one big sorted task.

Spark plans an unpartitioned window as a single task. Here an ordering is first split into
buckets of known size: the running position inside a bucket comes from a window over that
bucket, and the offset of a bucket comes from a window over the small table of bucket totals.
"""
from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recoup.functions.keys import digest

IN_TASK_ROWS = 2_000_000
"""Largest number of rows one task may sort or one aggregate buffer may hold."""

TREE_BOUNDS = 500
"""More cut points than this are searched by bisection in an array, not by a tree of comparisons."""

CUTS_PER_PASS = 2_000
"""Cut points taken from one pass of approximate percentiles; more are found bucket by bucket."""

BROADCAST_ROWS = 100_000
"""A side is broadcast only after its rows were counted and stay below this."""


def bucket_of(x: Column, bounds: Sequence[float]) -> Column:
    """Index of the half-open bucket (b[i-1], b[i]] holding x; nulls lie in bucket -1, before all."""
    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(x <= F.lit(float(bounds[mid])), tree(lo, mid)).otherwise(tree(mid + 1, hi))

    found = tree(0, len(bounds)) if len(bounds) <= TREE_BOUNDS else bisect(x, F.lit([float(b) for b in bounds]), len(bounds))
    return F.when(x.isNull(), F.lit(-1)).otherwise(found).cast("int")


def bisect(x: Column, bounds: Column, n: int | Column) -> Column:
    """Number of the sorted ``bounds`` below x, by halving; n bounds its length."""
    top = F.lit(n) if isinstance(n, int) else n
    steps = max(1, n.bit_length()) if isinstance(n, int) else 31
    start = F.struct(F.lit(0).cast("int").alias("lo"), top.cast("int").alias("hi"))

    def half(s: Column, _: Column) -> Column:
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        right = (s["lo"] < s["hi"]) & (F.get(bounds, mid) < x)
        return F.struct(F.when(right, mid + 1).otherwise(s["lo"]).cast("int").alias("lo"),
                        F.when(right, s["hi"]).otherwise(F.when(s["lo"] < s["hi"], mid).otherwise(s["hi"])).cast("int").alias("hi"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, half, lambda s: s["lo"])


def bucket_bounds(df: DataFrame, order: str, rows_per_bucket: int = IN_TASK_ROWS) -> list[float]:
    """Cut points that split the values of ``order`` into buckets of roughly bounded size.

    Values that fill more than a bucket alone must be set apart before (see ``ordered_position``)
    or be one row each. There are as many cut points as buckets, so the driver holds one number
    for every ``rows_per_bucket`` rows.
    """
    n = df.count()
    if n <= rows_per_bucket:
        return []
    k = -(-n // rows_per_bucket) * 2
    value = F.col(order).cast("double")
    probs = [i / min(k, CUTS_PER_PASS) for i in range(1, min(k, CUTS_PER_PASS))]
    cuts = sorted(set(df.agg(F.percentile_approx(value, probs, 20_000)).first()[0] or []))
    if k > CUTS_PER_PASS:  # each coarse bucket is cut again
        inner = -(-k // CUTS_PER_PASS)
        more = (df.groupBy(bucket_of(value, cuts).alias("_b")).agg(F.percentile_approx(value, [i / inner for i in range(1, inner)], 20_000).alias("q"))
                .select(F.explode("q").alias("q")).distinct().collect())
        cuts = sorted({*cuts, *(r["q"] for r in more if r["q"] is not None)})
    return cuts


def cumulate(df: DataFrame, order: str, sums: dict[str, str], by: Sequence[str] = (),
             descending: bool = False, rows_per_bucket: int = IN_TASK_ROWS,
             tie: str | None = None) -> DataFrame:
    """Running totals of one row per (``by``, ``order``), or per (``by``, ``order``, ``tie``).

    ``sums`` maps new column -> summed column; each total includes the current row. A null order
    comes first, or last if descending, however many buckets there are.
    """
    by = list(by)
    bounds = bucket_bounds(df, order, rows_per_bucket)
    sort = [F.col(order).desc() if descending else F.col(order).asc()] + ([F.col(tie)] if tie else [])
    if not bounds:
        # The whole input was counted and fits one task.
        w = W.partitionBy(*by).orderBy(*sort).rowsBetween(W.unboundedPreceding, W.currentRow)
        return df.withColumns({new: F.sum(c).over(w) for new, c in sums.items()})
    b = bucket_of(F.col(order).cast("double"), bounds)
    cut = df.withColumn("_bucket", -b if descending else b)
    w = (W.partitionBy(*by, "_bucket").orderBy(*sort)
         .rowsBetween(W.unboundedPreceding, W.currentRow))
    inside = cut.withColumns({f"_run_{i}": F.sum(c).over(w) for i, c in enumerate(sums.values())})
    totals = cut.groupBy(*by, "_bucket").agg(
        *[F.sum(c).alias(f"_total_{i}") for i, c in enumerate(sums.values())])
    # At most len(bounds) + 1 rows per group: bounded by the bucket count.
    before = (W.partitionBy(*by).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1))
    offsets = totals.select(
        *[F.col(c).alias(f"_by_{i}") for i, c in enumerate(by)], F.col("_bucket").alias("_b"),
        *[F.coalesce(F.sum(f"_total_{i}").over(before), F.lit(0)).alias(f"_off_{i}")
          for i in range(len(sums))])
    on = [F.col("_bucket") == F.col("_b")]
    on += [F.col(c).eqNullSafe(F.col(f"_by_{i}")) for i, c in enumerate(by)]
    joined = inside.join(offsets, reduce(lambda a, c: a & c, on))
    # a total may take the place of a column, also of one that differs in case only, as it does above
    out = joined.withColumns({new: F.col(f"_run_{i}") + F.col(f"_off_{i}") for i, new in enumerate(sums)})
    return out.select(*df.withColumns({new: F.lit(None) for new in sums}).columns)


def value_counts(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """Distinct non-null values of a column with their counts, per group."""
    return df.filter(F.col(column).isNotNull()).groupBy(*by, column).agg(
        F.count(F.lit(1)).alias("n"))


def average_rank(df: DataFrame, column: str, by: Sequence[str] = (), name: str = "rank") -> DataFrame:
    """One row per distinct value with the mean rank of its ties, ready to join back."""
    c = cumulate(value_counts(df, column, by), column, {"upto": "n"}, by)
    return c.select(*by, column, "n",
                    (F.col("upto") - (F.col("n") - 1) / 2.0).alias(name))


def exact_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float],
                    by: Sequence[str] = (), rows_per_task: int = IN_TASK_ROWS) -> DataFrame:
    """Linear-interpolation quantiles as rows (by..., variable, p, q); nulls are ignored.

    Small inputs use the built-in exact percentile. Larger ones never hold a group in one
    buffer: values are counted, cumulated in buckets, and only the rows that cover a wanted
    position are kept.
    """
    by, columns = list(by), list(columns)
    if df.count() <= rows_per_task:
        grid = F.array(*[F.lit(float(p)) for p in probs])
        wide = df.groupBy(*by).agg(
            *[F.percentile(F.col(c).cast("double"), grid).alias(f"_q{i}") for i, c in enumerate(columns)])
        rows = F.array(*[F.struct(F.lit(c).alias("variable"), F.col(f"_q{i}").alias("qs"))
                         for i, c in enumerate(columns)])
        each = wide.select(*by, F.explode(rows).alias("r")).filter("r.qs IS NOT NULL").select(
            *by, "r.variable", F.explode(F.arrays_zip(grid.alias("p"), F.col("r.qs").alias("q"))).alias("z"))
        return each.select(*by, "variable", "z.p", "z.q")
    long = df.select(*by, F.explode(F.array(*[
        F.struct(F.lit(c).alias("variable"), F.col(c).cast("double").alias("value"))
        for c in columns])).alias("r")).select(*by, "r.*")
    keys = [*by, "variable"]
    cum = cumulate(value_counts(long, "value", keys), "value", {"upto": "n"}, keys,
                   rows_per_bucket=rows_per_task)
    size = cum.groupBy(*[F.col(k).alias(f"_s_{k}") for k in keys]).agg(F.max("upto").alias("size"))
    on = reduce(lambda a, c: a & c, [F.col(k).eqNullSafe(F.col(f"_s_{k}")) for k in keys])
    placed = cum.join(size, on).select(*keys, "value", "n", "upto", "size")
    first, last = F.col("upto") - F.col("n"), F.col("upto") - 1
    wanted = F.filter(
        F.transform(F.array(*[F.lit(float(p)) for p in probs]),
                    lambda p: F.struct(p.alias("p"), ((F.col("size") - 1) * p).alias("h"))),
        lambda s: (F.floor(s["h"]).between(first, last)) | (F.ceil(s["h"]).between(first, last)))
    hit = placed.withColumn("w", F.explode(wanted)).select(
        *keys, "value", F.col("w.p").alias("p"), F.col("w.h").alias("h"), first.alias("first"),
        last.alias("last"))
    low = F.max(F.when(F.floor("h").between(F.col("first"), F.col("last")), F.col("value")))
    high = F.max(F.when(F.ceil("h").between(F.col("first"), F.col("last")), F.col("value")))
    h = F.max("h")
    # the built-in percentile's own order of operations, so both ways give the same last bit
    q = F.when(low == high, low).otherwise((F.ceil(h) - h) * low + (h - F.floor(h)) * high)
    return hit.groupBy(*keys, "p").agg(q.alias("q"))


def quantile_list(df: DataFrame, column: str, probs: Sequence[float]) -> list[float]:
    """Quantiles of one column as numbers; as many values reach the driver as asked for."""
    rows = exact_quantiles(df, [column], probs).collect()
    found = {round(r["p"], 12): r["q"] for r in rows}
    return [found[round(float(p), 12)] for p in probs]


def digest_threshold(df: DataFrame, key: str, seed: str, quota: int,
                     in_task: int = 20_000) -> str | None:
    """The largest digest among the ``quota`` smallest ones; None when that takes no row.

    A radix search: counts by the next three hex digits (at most 4096 numbers) find the slice
    in which the quota is reached, until the slice is small enough to order in one task.
    """
    d = df.select(digest(key, seed).alias("_digest"))
    n, room, prefix = df.count(), int(quota), ""
    if room <= 0:
        return None
    if room >= n:
        return "g"  # after every hex digit
    while n > in_task and len(prefix) < 30:
        rows = (d.groupBy(F.substring("_digest", 1, len(prefix) + 3).alias("p"))
                .agg(F.count(F.lit(1)).alias("n")).collect())
        for r in sorted(rows):
            if r["n"] >= room:
                prefix, n = r["p"], r["n"]
                break
            room -= r["n"]
        d = d.filter(F.col("_digest").startswith(prefix))
    return d.orderBy("_digest").limit(room).agg(F.max("_digest")).first()[0]


def smallest(df: DataFrame, key: str, seed: str, quota: int | DataFrame, by: Sequence[str] = (),
             rows_per_bucket: int = 20_000, order: tuple[Column, Column] | None = None) -> DataFrame:
    """The rows with the ``quota`` smallest digests of a unique ``key`` within each group, exactly.

    ``quota`` is a number for the whole set, or one row per group with columns ``by`` and
    ``quota``. Only a threshold is searched for; taking the rows is then a plain filter, so no
    row moves and a very large group stays spread over many tasks. ``order`` replaces the
    digest by other random hex digits and a column that orders rows with equal digits.
    """
    by = list(by)
    if not by:
        top = digest_threshold(df, key, seed, quota, rows_per_bucket)
        return df.filter(F.lit(False) if top is None else digest(key, seed) <= F.lit(top))
    head, tail = order or (digest(key, seed), F.col(key))
    small = quota.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    limits = group_thresholds(df, head, tail, quota, by, small, rows_per_bucket)
    on = reduce(lambda a, c: a & c, [F.col(c).eqNullSafe(F.col(f"_t_{c}")) for c in by])
    # One threshold per group, so the counted quota table bounds what is broadcast.
    return (df.join(F.broadcast(limits) if small else limits, on)
            .filter((head < F.col("_top")) | ((head == F.col("_top")) & (tail <= F.col("_last"))))
            .select(*df.columns))


def group_thresholds(df: DataFrame, head: Column, tail: Column, quotas: DataFrame, by: Sequence[str],
                     small: bool, rows_per_bucket: int = 20_000, rows: int | None = None) -> DataFrame:
    """One threshold (digits, tie column) per group: counts by hex prefix locate the slice of each group in
    which its quota is reached, and only that slice is ranked. ``rows`` is the size of ``df``, if known."""
    n = df.count() if rows is None else rows
    digits = 1
    while n / 16 ** digits > rows_per_bucket:
        digits += 1
    d = df.select(*by, head.alias("_head"), tail.alias("_tail")).withColumn("_prefix", F.substring("_head", 1, digits))
    counts = d.groupBy(*by, "_prefix").agg(F.count(F.lit(1)).alias("_n"))
    w = W.partitionBy(*by).orderBy("_prefix").rowsBetween(W.unboundedPreceding, W.currentRow)
    size = W.partitionBy(*by)  # at most 16 counts for every rows_per_bucket rows
    counts = counts.withColumns({"_upto": F.sum("_n").over(w), "_size": F.sum("_n").over(size)})
    q = quotas.select(*[F.col(c).alias(f"_q_{c}") for c in by], F.col("quota").alias("_quota"))
    on = reduce(lambda a, c: a & c, [F.col(c).eqNullSafe(F.col(f"_q_{c}")) for c in by])
    counts = counts.join(q, on).withColumn("_want", F.least("_quota", "_size"))
    room = F.col("_want") - (F.col("_upto") - F.col("_n"))
    edge = counts.filter((room > 0) & (room <= F.col("_n"))).select(
        *[F.col(c).alias(f"_t_{c}") for c in by], F.col("_prefix").alias("_t_prefix"), room.alias("_room"))
    on = reduce(lambda a, c: a & c, [F.col(c).eqNullSafe(F.col(f"_t_{c}")) for c in by])
    near = d.join(F.broadcast(edge) if small else edge, on & (F.col("_prefix") == F.col("_t_prefix")))
    rank = W.partitionBy(*[f"_t_{c}" for c in by]).orderBy("_head", "_tail")
    return (near.withColumn("_rank", F.row_number().over(rank)).filter(F.col("_rank") == F.col("_room"))
            .select(*[f"_t_{c}" for c in by], F.col("_head").alias("_top"), F.col("_tail").alias("_last")))


def shuffled_position(df: DataFrame, key: str, seed: str, name: str = "position",
                      by: Sequence[str] = (), rows_per_bucket: int = 20_000) -> DataFrame:
    """1-based position of every row in digest order, within each group."""
    n = df.count()
    digits = 1
    while n / 16 ** digits > rows_per_bucket:
        digits += 1
    d = df.withColumn("_digest", digest(key, seed)).withColumn("_prefix", F.substring("_digest", 1, digits))
    return _positions(d, ["_digest", key], "_prefix", name, by).select(*df.columns, name)


def ordered_position(df: DataFrame, order: str, tie: str, name: str = "position",
                     by: Sequence[str] = (), rows_per_bucket: int = IN_TASK_ROWS) -> DataFrame:
    """1-based position of every row by (``order``, ``tie``), both numeric, within each group.

    Null orders come first. A value of ``order`` (or null) that fills more than a bucket alone has
    a bucket of its own, which is cut again by its own tie column.
    """
    if df.count() <= rows_per_bucket:
        return _positions(df.withColumn("_prefix", F.lit(0).cast("bigint")), [order, tie], "_prefix", name, by).select(*df.columns, name)
    value = F.col(order).cast("double")
    # at most one value for every rows_per_bucket rows
    hot = [(r["v"], r["n"]) for r in df.groupBy(value.alias("v")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > rows_per_bucket).collect()]
    known = [v for v, _ in hot if v is not None]
    rest = df.filter(value.isNotNull() & ~value.isin(known)) if known else df.filter(value.isNotNull())
    bounds = sorted({*bucket_bounds(rest, order, rows_per_bucket), *known, *(math.nextafter(v, -math.inf) for v in known)})
    second = F.lit(0)
    if hot:
        pieces = -(-max(n for _, n in hot) // rows_per_bucket) * 2
        heavy = value.isin(known) if known else F.lit(False)
        if any(v is None for v, _ in hot):
            heavy = heavy | value.isNull()
        cuts = (df.filter(heavy).groupBy(value.alias("v")).agg(F.percentile_approx(F.col(tie).cast("double"), [i / pieces for i in range(1, pieces)], 20_000).alias("q"))
                .collect())
        for r in cuts:
            own = value.isNull() if r["v"] is None else value == F.lit(r["v"])
            second = F.when(own, bucket_of(F.col(tie).cast("double"), sorted(set(r["q"] or []))) + 1).otherwise(second)
    d = df.withColumn("_prefix", bucket_of(value, bounds).cast("bigint") * F.lit(1 << 32) + second)
    return _positions(d, [order, tie], "_prefix", name, by).select(*df.columns, name)


def _positions(d: DataFrame, order: Sequence[str], bucket: str, name: str,
               by: Sequence[str] = ()) -> DataFrame:
    by = list(by)
    w = W.partitionBy(*by, bucket).orderBy(*order)
    # One row per bucket and group, so this small table may be ordered in one task.
    before = W.partitionBy(*by).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    totals = d.groupBy(*by, F.col(bucket).alias("_b")).agg(F.count(F.lit(1)).alias("_n"))
    offsets = totals.select(*[F.col(c).alias(f"_o_{c}") for c in by], "_b",
                            F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    inside = d.withColumn("_pos", F.row_number().over(w))
    on = [F.col(bucket) == F.col("_b")] + [F.col(c).eqNullSafe(F.col(f"_o_{c}")) for c in by]
    return inside.join(offsets, reduce(lambda a, c: a & c, on)).withColumn(
        name, (F.col("_pos") + F.col("_off")).cast("bigint"))
