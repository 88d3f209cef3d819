"""Portfolio back-test: recovery curves, bootstrap, packages, matching, deviations.

A payments frame has CaseId, Month, Payment with every case present in every month; package,
band and replicate are columns, so all packages and replicates run in the same jobs.
"""
from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recoup.functions.keys import digest
from recoup.operators import components, ranks, sampling
from recoup.operators.gram import group_moments
from recoup.operators.joins import sized
from recoup.session import stored

MONTHS = 12
# Quantiles reported for bootstrap curves.
QUANTILES = {"Q05": 0.05, "Q10": 0.10, "Q25": 0.25, "Q50": 0.50, "Q75": 0.75, "Q90": 0.90, "Q95": 0.95}


def monthly(pay: DataFrame, cases: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Recovery per month: a ratio of sums."""
    return (pay.join(cases.select("CaseId", "TOA", *by), "CaseId").groupBy(*by, "Month")
            .agg((F.sum("Payment") / F.sum("TOA")).alias("SR")))


def cumulative(sr: DataFrame, by: Sequence[str] = (), name: str = "SR") -> DataFrame:
    """Running sum over the twelve months of each group."""
    w = W.partitionBy(*by).orderBy("Month").rowsBetween(W.unboundedPreceding, W.currentRow)
    return sr.withColumn(name, F.sum("SR").over(w))


def curve(pay: DataFrame, cases: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Cumulative recovery curve."""
    return cumulative(monthly(pay, cases, by), by)


def wide_payments(pay: DataFrame) -> DataFrame:
    """One row per case with its payments by month, so replicates need not repeat the months."""
    return pay.groupBy("CaseId").agg(*[
        F.sum(F.when(F.col("Month") == m, F.col("Payment")).otherwise(0.0)).alias(f"p{m}")
        for m in range(1, MONTHS + 1)])


def replicate_curves(pay: DataFrame, cases: DataFrame, b: int, by: Sequence[str] = (),
                     prefix: str = "b") -> DataFrame:
    """Cumulative curves (by..., rep, Month, SR) of B bootstrap replicates.

    Weights instead of copied rows: every case carries its multiplicity in each replicate and
    the sums combine before the shuffle, which moves one row per (group, replicate).
    """
    base = cases.select("CaseId", "TOA", *by).join(wide_payments(pay), "CaseId")
    rep = sampling.replicates(base, "CaseId", b, prefix).filter("w > 0")
    sums = rep.groupBy(*by, "rep").agg(
        F.sum(F.col("w") * F.col("TOA")).alias("T"),
        *[F.sum(F.col("w") * F.col(f"p{m}")).alias(f"s{m}") for m in range(1, MONTHS + 1)])
    running = F.lit(0.0)
    points = []
    for m in range(1, MONTHS + 1):
        running = running + F.col(f"s{m}")
        points.append(F.struct(F.lit(m).alias("Month"), (running / F.col("T")).alias("SR")))
    return sums.select(*by, "rep", F.explode(F.array(*points)).alias("x")).select(*by, "rep", "x.*")


def curve_statistics(reps: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean, deviation and quantiles over the replicates (at most B values per group)."""
    return reps.groupBy(*by, "Month").agg(
        F.avg("SR").alias("SR"), F.stddev_samp("SR").alias("StdSR"),
        *[F.percentile("SR", F.lit(q)).alias(k) for k, q in QUANTILES.items()])


def bootstrap(pay: DataFrame, cases: DataFrame, b: int = 101, by: Sequence[str] = ()) -> DataFrame:
    return curve_statistics(replicate_curves(pay, cases, b, by), by)


def packages(df: DataFrame, k: int, key: str = "CaseId", order: str | None = None,
             seed: str = "pckg") -> DataFrame:
    """K packages of equal size by position, in the given order or in a random one."""
    n = df.count()
    placed = (ranks.ordered_position(df, order, key, "_pos") if order
              else ranks.shuffled_position(df, key, seed, "_pos"))
    return placed.withColumn("Pckg", F.ceil(F.col("_pos") * k / F.lit(float(n))).cast("int")).drop("_pos")


def random_split(cases: DataFrame, n: int, k: int, seed: str = "val") -> tuple[DataFrame, DataFrame]:
    """Valued cases in K random packages, and the rest as benchmark."""
    val, ben = sampling.split_n(cases, "CaseId", seed, n)
    return packages(val, k), ben


def age_split(cases: DataFrame, n: int, k: int, order: str = "D_ContractDateToImportDate") -> tuple[DataFrame, DataFrame]:
    """The n last cases in age order as valued cases in K consecutive packages."""
    placed = ranks.ordered_position(cases, order, "CaseId", "_pos")
    total = cases.count()
    val = placed.filter(F.col("_pos") > total - n).withColumn(
        "Pckg", F.ceil((F.col("_pos") - (total - n)) * k / F.lit(float(n))).cast("int")).drop("_pos")
    return val, placed.filter(F.col("_pos") <= total - n).drop("_pos")


def deviations(package_curves: DataFrame, benchmark: DataFrame, per_package: bool = False) -> DataFrame:
    """(package - benchmark) / package per package and month. K x 12 rows on the left, and a
    benchmark of 12 or K x 12 rows on the right; a benchmark's unmatched share is carried along."""
    on = ["Pckg", "Month"] if per_package else ["Month"]
    carried = [c for c in ("Unmatched",) if c in benchmark.columns]
    b = benchmark.select(*on, F.col("SR").alias("_ben"), *carried)
    return package_curves.join(b, on).select(
        "Pckg", "Month", ((F.col("SR") - F.col("_ben")) / F.nullif(F.col("SR"), F.lit(0.0))).alias("Dev"), *carried)


def deviation_summary(dev: DataFrame) -> DataFrame:
    """By month; with it the largest share of a package's debt that had no benchmark, where known."""
    lost = [F.max("Unmatched").alias("Unmatched")] if "Unmatched" in dev.columns else []
    return dev.groupBy("Month").agg(F.avg("Dev").alias("Dev"), F.avg(F.abs("Dev")).alias("DevAbs"),
                                    F.percentile("Dev", F.lit(0.25)).alias("Q25"), *lost)  # one value per package


def averaged_edges(df: DataFrame, column: str, package: str) -> DataFrame:
    """Quintile edges per package, inner ones averaged and outer ones extreme over packages."""
    q = ranks.exact_quantiles(df, [column], [0.0, 0.2, 0.4, 0.6, 0.8, 1.0], [package])
    at = {i: F.when(F.round(F.col("p"), 6) == i / 5, F.col("q")) for i in range(6)}
    return q.agg(F.min(at[0]).alias("e0"), *[F.avg(at[i]).alias(f"e{i}") for i in range(1, 5)],
                 F.max(at[5]).alias("e5"))


def weighted_curve(shares: DataFrame, curves: DataFrame, on: Sequence[str]) -> DataFrame:
    """Benchmark curve of each package: its debt by band weights the curves of the bands.

    ``Unmatched`` is the share of the package's debt in bands without a curve, which the weights
    leave out.
    """
    whole = shares.groupBy("Pckg").agg(F.sum("_debt").alias("_whole"))
    j = shares.join(curves, list(on)).groupBy("Pckg", "Month").agg(
        (F.sum(F.col("_debt") * F.col("SR")) / F.sum("_debt")).alias("SR"), F.sum("_debt").alias("_met"))
    return j.join(whole, "Pckg").select("Pckg", "Month", "SR", F.round(1 - F.col("_met") / F.col("_whole"), 9).alias("Unmatched"))


def matched_by_variable(pay: DataFrame, val: DataFrame, ben: DataFrame, column: str = "TOA", b: int = 101) -> DataFrame:
    """Deviations against a benchmark matched by the bands of one variable.

    Raises an error if a package has debt in a band without benchmark cases.
    """
    from recoup.operators.bands import supplied
    edges = sorted(set(averaged_edges(val, column, "Pckg").first()))  # six numbers
    band = supplied(column, edges, column)
    curves = stored(bootstrap(pay, ben.withColumn("band", band).filter("band IS NOT NULL"), b, ["band"]), "curves")
    debt = stored(val.withColumn("band", band).groupBy("Pckg", "band").agg(F.sum("TOA").alias("_debt")), "debt")
    lost = debt.filter("_debt > 0").join(curves.select("band").distinct(), "band", "left_anti").orderBy("Pckg", "band").first()
    if lost:
        raise ValueError(f"package {lost['Pckg']} has debt in band {lost['band']}, which holds no benchmark cases")
    return deviations(curve(pay, val, ["Pckg"]), weighted_curve(debt, curves, ["band"]), per_package=True)


def package_components(val: DataFrame, columns: Sequence[str]) -> dict[int, dict]:
    """Per package: centre, and rotation scaled to raw columns. K small matrices on the driver,
    from one pass over the valued cases."""
    out = {}
    p = len(columns)
    for k, m in group_moments(val, columns, "Pckg").items():
        cov = m.s / (m.n - 1)
        keep = [i for i in range(p) if cov[i, i] >= 1e-12]  # a constant column carries nothing
        _, rot = components.rotation(cov[np.ix_(keep, keep)])
        full = np.zeros((p, len(keep)))
        full[keep, :] = rot / np.sqrt(np.diag(cov)[keep])[:, None]
        out[int(k)] = {"centre": m.mean, "weights": full, "n": len(keep)}
    return out


def component_columns(df: DataFrame, columns: Sequence[str], fits: dict[int, dict], own: bool,
                      edges: dict[tuple[int, int], list[float]] | None = None) -> DataFrame:
    """Rows (CaseId, Pckg, c0, c1, ...) in the component space of a package: of each row in its
    own package's space, or of each row in the space of every package.

    Without ``edges`` the columns are scores; with them they are band numbers, 0 outside the
    valued range. One matrix product per Arrow batch and package.
    """
    import pandas as pd

    cols = list(columns)
    depth = min(f["n"] for f in fits.values())

    def project(batches):
        for pdf in batches:
            x = pdf[cols].to_numpy(dtype=float)
            ids = pdf["CaseId"].to_numpy()
            for k, f in fits.items():
                pick = pdf["Pckg"].to_numpy() == k if own else np.ones(len(pdf), dtype=bool)
                if not pick.any():
                    continue
                s = (x[pick] - f["centre"]) @ f["weights"]
                out = {"CaseId": ids[pick], "Pckg": np.full(int(pick.sum()), k)}
                for j in range(depth):
                    v = s[:, j]
                    if edges is not None:
                        e = np.array(edges[(k, j)])
                        band = np.clip(np.searchsorted(e, v, side="left"), 1, len(e) - 1)
                        v = np.where((v < e[0]) | (v > e[-1]), 0, band)
                    out[f"c{j}"] = v
                yield pd.DataFrame(out)

    kind = "double" if edges is None else "int"
    keep = ["CaseId", "Pckg", *cols] if own else ["CaseId", *cols]
    schema = "CaseId bigint, Pckg int, " + ", ".join(f"c{j} {kind}" for j in range(depth))
    return df.select(*keep).mapInPandas(project, schema)


def cell_at(depth: int):
    """Name of the cell of the first components; one cell holds everything if there are none."""
    if not depth:
        return F.lit("all")
    return F.concat_ws("_", *[F.col(f"c{j}").cast("string") for j in range(depth)])


def matched_by_components(pay: DataFrame, val: DataFrame, ben: DataFrame, columns: Sequence[str],
                          quantiles: int = 5, min_ratio: int = 10, b: int = 101) -> DataFrame:
    """Deviations against a benchmark matched in cells of principal components, all packages
    together. Components are dropped from the end until every cell of valued cases has
    ``min_ratio`` times as many benchmark cases; coarser cells only add cases to a cell, so
    the depth is found by going up from no component until the first failure. A package that
    fails with a single component is matched as one cell with the whole benchmark, and it is an
    error if even that holds fewer than ``min_ratio`` times its cases: no debt is left unmatched."""
    val = stored(val.select("CaseId", "TOA", "Pckg", *[c for c in columns if c != "TOA"]), "val")
    fits = package_components(val, columns)
    probs = [i / quantiles for i in range(quantiles + 1)]
    scores = stored(component_columns(val, columns, fits, own=True), "scores")
    depth = len(scores.columns) - 2
    edges: dict[tuple[int, int], list[float]] = {}
    for r in ranks.exact_quantiles(scores, [f"c{j}" for j in range(depth)], probs, ["Pckg"]).collect():
        edges.setdefault((r["Pckg"], int(r["variable"][1:])), []).append(r["q"])
    edges = {k: sorted(v) for k, v in edges.items()}
    v = stored(component_columns(val, columns, fits, True, edges), "val_bands")
    m = stored(component_columns(ben, columns, fits, False, edges), "ben_bands")

    # Counted once by all components; shorter cells are sums of these counts.
    bands_of = [f"c{j}" for j in range(depth)]
    need = v.groupBy("Pckg", *bands_of).agg(F.count(F.lit(1)).alias("nv"))
    have = stored(m.groupBy("Pckg", *bands_of).agg(F.count(F.lit(1)).alias("nb")), "ben_counts")
    need = stored(need, "val_counts")
    found: dict[int, tuple[int, int]] = {}
    active = set(fits)
    for d in range(depth + 1):
        some = F.col("Pckg").isin(list(active))
        a = need.filter(some).groupBy("Pckg", cell_at(d).alias("cell")).agg(F.sum("nv").alias("nv"))
        c = have.filter(some).groupBy("Pckg", cell_at(d).alias("cell")).agg(F.sum("nb").alias("nb"))
        low = a.join(c, ["Pckg", "cell"], "left").groupBy("Pckg").agg(
            F.min(F.floor(F.coalesce("nb", F.lit(0)) / F.col("nv"))).alias("r")).collect()  # K rows
        for r in low:
            if r["r"] >= min_ratio:
                found[r["Pckg"]] = (d, int(r["r"]))
            elif d:
                active.discard(r["Pckg"])
            else:
                raise ValueError(f"the benchmark holds fewer than {min_ratio} cases for each of package {r['Pckg']}")
        if not active:
            break

    cell = F.lit(None).cast("string")
    for d in sorted({d for d, _ in found.values()}):
        mine = [k for k, (own, _) in found.items() if own == d]
        cell = F.when(F.col("Pckg").isin(mine), cell_at(d)).otherwise(cell)
    times = F.create_map(*[F.lit(x) for k, (_, r) in found.items() for x in (k, r)])
    vc = v.select("CaseId", "Pckg", cell.alias("BandVar"))
    mc = m.select("CaseId", "Pckg", cell.alias("BandVar"))
    need = stored(vc.groupBy("Pckg", "BandVar").agg((F.count(F.lit(1)) * times[F.col("Pckg")]).alias("quota")), "quota")
    picked = ranks.smallest(mc, "CaseId", "pcamatch", need, ["Pckg", "BandVar"])
    # A drawn case serves several packages, so its payments are widened once before the join.
    curves = bootstrap(pay, ben.select("CaseId", "TOA").join(picked, "CaseId"), b, ["Pckg", "BandVar"])
    debt = vc.join(val.select("CaseId", "TOA"), "CaseId").groupBy("Pckg", "BandVar").agg(F.sum("TOA").alias("_debt"))
    return deviations(curve(pay, val, ["Pckg"]), weighted_curve(debt, curves, ["Pckg", "BandVar"]), per_package=True)


def repeated_match(pay: DataFrame, ref: DataFrame, need: DataFrame, cells: Sequence[str], ratio: int,
                   draws: int) -> DataFrame:
    """Monthly and cumulative recovery of repeated matched draws (rep, Month, SR, SRcml).

    ``need`` holds the wanted rows per cell. The draws are found on a narrow frame of keys and cells
    (those of reference rows in wanted cells): one threshold per draw and cell. Payments are read
    once: each row has its draws as an array of flags, and a batch of rows adds to the sums of all
    draws as one matrix product.
    """
    on = reduce(lambda a, c: a & c, [ref[c].eqNullSafe(need[c]) for c in cells])
    need = sized(need)
    inside = stored(ref.join(need, on).select("CaseId", "TOA", *[ref[c] for c in cells]), "inside")
    blocks = -(-draws // 4)
    # A digest orders four draws: eight hex digits each, equal digits in order of the key.
    digests = F.array(*[digest("CaseId", f"m{i + 1}") for i in range(blocks)])
    e = inside.select("CaseId", *cells, F.posexplode(digests).alias("_block", "_d"))
    e = e.select("CaseId", *cells, F.explode(F.array(*[F.struct((F.col("_block") * 4 + i + 1).alias("rep"), F.substring("_d", 8 * i + 1, 8).alias("digits"))
                                                       for i in range(4)])).alias("x")).select("CaseId", *cells, "x.*").filter(F.col("rep") <= draws)
    quota = need.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(draws)))).select("rep", *cells, (F.col("wanted") * ratio).alias("quota"))
    limits = ranks.group_thresholds(e, F.col("digits"), F.col("CaseId"), quota, ["rep", *cells], False, rows=inside.count() * draws)
    # one row per cell: the thresholds of its draws in order
    tops = limits.groupBy(*[F.col(f"_t_{c}") for c in cells]).agg(F.transform(
        F.array_sort(F.collect_list(F.struct("_t_rep", "_top", "_last"))), lambda x: F.struct(x["_top"].alias("top"), x["_last"].alias("last"))).alias("_limits"))
    same = reduce(lambda a, c: a & c, [F.col(c).eqNullSafe(F.col(f"_t_{c}")) for c in cells])
    wide = inside.select("CaseId", "TOA", *cells).join(wide_payments(pay), "CaseId").join(sized(tops), same).withColumn("_digests", digests)

    def taken(limit, i):
        own = F.substring(F.col("_digests")[F.floor(i / 4).cast("int")], (i % 4) * 8 + 1, F.lit(8))
        return ((own < limit["top"]) | ((own == limit["top"]) & (F.col("CaseId") <= limit["last"]))).cast("double")

    numbers = ["TOA", *[f"p{m}" for m in range(1, MONTHS + 1)]]
    flagged = wide.select(F.transform("_limits", taken).alias("flags"), *[F.col(c).cast("double").alias(c) for c in numbers])

    def added(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                flags = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, draws)
                sums = flags.T @ np.column_stack([b.column(i + 1).to_numpy(zero_copy_only=False) for i in range(len(numbers))])
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(1, draws + 1, dtype=np.int32)), *[pa.array(c) for c in sums.T]], ["rep", *numbers])

    sums = flagged.mapInArrow(added, "rep int, " + ", ".join(f"{c} double" for c in numbers)).groupBy("rep").agg(*[F.sum(c).alias(c) for c in numbers])
    running = F.lit(0.0)
    points = []
    for m in range(1, MONTHS + 1):
        running = running + F.col(f"p{m}")
        points.append(F.struct(F.lit(m).alias("Month"), (F.col(f"p{m}") / F.col("TOA")).alias("SR"), (running / F.col("TOA")).alias("SRcml")))
    return sums.select("rep", F.explode(F.array(*points)).alias("x")).select("rep", "x.*")


def component_cells(smp: DataFrame, ref: DataFrame, columns: Sequence[str], most: int = 3, bands: int = 5,
                    min_ratio: int = 5) -> tuple[DataFrame, DataFrame, int]:
    """The sample and the reference with the cells of the sample's first principal components: as many
    (at most ``most``) as leave every cell of the sample ``min_ratio`` times as many reference rows."""
    one = smp.select("CaseId", "TOA", F.lit(1).alias("Pckg"), *[c for c in columns if c != "TOA"])
    fits = package_components(one, columns)
    scores = stored(component_columns(one, columns, fits, own=True), "scores")
    probs = [i / bands for i in range(bands + 1)]
    depth = len(scores.columns) - 2
    edges: dict[tuple[int, int], list[float]] = {}
    for r in ranks.exact_quantiles(scores, [f"c{j}" for j in range(depth)], probs, ["Pckg"]).collect():
        edges.setdefault((r["Pckg"], int(r["variable"][1:])), []).append(r["q"])
    edges = {k: sorted(v) for k, v in edges.items()}
    s = stored(component_columns(one, columns, fits, True, edges), "bands")
    r = stored(component_columns(ref, columns, fits, False, edges), "bands")
    for d in range(min(most, depth), -1, -1):
        want = s.groupBy(cell_at(d).alias("cell")).agg(F.count(F.lit(1)).alias("n"))
        have = r.groupBy(cell_at(d).alias("cell")).agg(F.count(F.lit(1)).alias("m"))
        low = want.join(have, "cell", "left").agg(F.min(F.coalesce("m", F.lit(0)) / F.col("n"))).first()[0]
        if d == 0 or low >= min_ratio:
            break
    return (smp.select("CaseId", "TOA").join(s.select("CaseId", cell_at(d).alias("cell")), "CaseId"),
            ref.select("CaseId", "TOA").join(r.select("CaseId", cell_at(d).alias("cell")), "CaseId"), d)


def draw_statistics(draws: DataFrame) -> DataFrame:
    def five(c, tail):
        return [F.percentile(c, F.lit(0.25)).alias(f"Q25{tail}"), F.percentile(c, F.lit(0.5)).alias(f"Q50{tail}"),
                F.percentile(c, F.lit(0.75)).alias(f"Q75{tail}"), F.avg(c).alias(f"Avg{tail}"),
                F.stddev_samp(c).alias(f"Std{tail}")]
    return draws.groupBy("Month").agg(*five("SR", ""), *five("SRcml", "Cml"))
