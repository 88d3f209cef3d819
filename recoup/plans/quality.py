"""Data quality and imputation."""
from __future__ import annotations

from pyspark.sql import functions as F

from recoup.functions.columns import n_rows, rnd
from recoup.operators import bands, features, profile, quality
from recoup.plans.fixture_sql import md, u, un
from recoup.plans.registry import query



@query("q1_identity_check", """
SELECT CaseId, round(abs(Principal+Interest+coalesce(Other,0e0)-TOA),4) AS gap FROM cases WHERE abs(Principal+Interest+coalesce(Other,0e0)-TOA) > 0.01e0""")
def q1(t):
    g = quality.identity_gap(t.cases, ["Principal", "Interest", "Other"], "TOA")
    return g.select("CaseId", rnd("gap", 4).alias("gap"))


@query("q1_identity_repair", "SELECT CaseId, round(TOA-(Principal+Interest),4) AS Other FROM cases")
def q1b(t):
    return quality.repair_identity(t.cases, "TOA", ["Principal", "Interest"], "Other").select("CaseId", rnd("Other", 4).alias("Other"))


@query("q2_contradiction", "SELECT CaseId FROM cases WHERE ClosedExecution = 1 AND Bailiff = 0")
def q2(t):
    return t.cases.filter("ClosedExecution = 1 AND Bailiff = 0").select("CaseId")


MISS = ["Other", "DPD", "ExternalAgency", "Bailiff", "ClosedExecution", "Gender", "M_LastPaymentToImportDate",
        "LastPaymentAmount", "Land", "GDPPerCapita", "MeanSalary", "PopulationInCity"]


@query("q3_missing_shares", " UNION ALL ".join(
    f"SELECT '{c}' AS variable, round(avg(cast({c} IS NULL as int)),6) AS share FROM cases" for c in MISS)
    + " UNION ALL SELECT '(complete)', round(avg(cast(" + " AND ".join(f"{c} IS NOT NULL" for c in MISS) + " as int)),6) FROM cases")
def q3(t):
    return quality.missing_shares(t.cases, MISS).withColumn("share", rnd("share"))


def _five(where):
    return (f"min(DPD)::double AS q0, quantile_cont(DPD,0.25) AS q25, quantile_cont(DPD,0.5) AS q50, "
            f"quantile_cont(DPD,0.75) AS q75, max(DPD)::double AS q100 FROM cases WHERE DPD IS NOT NULL {where}")


@query("q4_drop_shift", f"""
SELECT 'all' AS part, {_five('')} UNION ALL SELECT 'complete', {_five('AND ' + ' AND '.join(f'{c} IS NOT NULL' for c in MISS))}""")
def q4(t):
    probs = [0.0, 0.25, 0.5, 0.75, 1.0]
    a = profile.profile(t.cases.filter("DPD IS NOT NULL"), ["DPD"], probs)
    b = profile.profile(t.cases.dropna("any"), ["DPD"], probs)
    return (a.withColumn("part", F.lit("all")).unionByName(b.withColumn("part", F.lit("complete")))
            .drop("variable"))


def _scenario(v):
    return f"""SELECT coalesce(ExternalAgency,{v}) AS ExternalAgency, coalesce(Bailiff,{v}) AS Bailiff, coalesce(ClosedExecution,{v}) AS ClosedExecution, count(*) AS n FROM cases GROUP BY 1,2,3"""


def _scenario_df(t, v):
    c = ["ExternalAgency", "Bailiff", "ClosedExecution"]
    return t.cases.fillna(v, c).groupBy(*c).agg(n_rows())


@query("q5_fill_pessimistic", _scenario(1))
def q5a(t):
    return _scenario_df(t, 1)


@query("q5_fill_optimistic", _scenario(0))
def q5b(t):
    return _scenario_df(t, 0)


@query("q6_mean_fill", "SELECT CaseId, round(coalesce(PopulationInCity, avg(PopulationInCity) OVER ()),6) AS PopulationInCity FROM cases")
def q6(t):
    return quality.mean_fill(t.cases.select("CaseId", "PopulationInCity"), "PopulationInCity").select(
        "CaseId", rnd("PopulationInCity").alias("PopulationInCity"))


@query("q7_median_fill", """
SELECT CaseId, cast(coalesce(D, (SELECT quantile_cont(D,0.5) FROM d)) as double) AS D FROM d"""
       .replace("SELECT CaseId,", "WITH d AS (SELECT CaseId, CASE WHEN D_ContractDateToImportDate > 100 THEN D_ContractDateToImportDate END AS D FROM cases) SELECT CaseId,", 1))
def q7(t):
    d = t.cases.select("CaseId", F.when(F.col("D_ContractDateToImportDate") > 100, F.col("D_ContractDateToImportDate")).alias("D"))
    return quality.median_fill(d, "D")


EMPIRICAL = f"""
WITH v AS (SELECT M_LastPaymentToImportDate AS m, count(*) AS n FROM cases WHERE M_LastPaymentToImportDate IS NOT NULL GROUP BY 1),
c AS (SELECT m, n, sum(n) OVER (ORDER BY m) AS upto, sum(n) OVER () AS total FROM v),
g AS (SELECT CaseId, floor({u('CaseId', 'q8')}*(SELECT any_value(total) FROM c)) AS pos FROM cases WHERE M_LastPaymentToImportDate IS NULL),
f AS (SELECT CaseId, m FROM g JOIN c ON pos >= upto - n AND pos < upto)"""


@query("q8_empirical_fill", EMPIRICAL + """
SELECT CaseId, coalesce(M_LastPaymentToImportDate, m) AS M_LastPaymentToImportDate FROM cases LEFT JOIN f USING (CaseId)""")
def q8(t):
    d = t.cases.select("CaseId", "M_LastPaymentToImportDate")
    return quality.empirical_fill(d, "M_LastPaymentToImportDate", "CaseId", "q8")


@query("q8_fill_comparison", EMPIRICAL + """
SELECT m AS M, round(n/cast(total as double),6) AS Pr, round((SELECT count(*) FROM f WHERE f.m = c.m)/cast((SELECT count(*) FROM g) as double),6) AS PrNew FROM c""")
def q8b(t):
    m = "M_LastPaymentToImportDate"
    d = t.cases.select("CaseId", F.col(m), F.col(m).isNull().alias("gap"))
    gaps = d.agg(F.sum(F.col("gap").cast("int")), F.count(F.lit(1))).first()
    filled = quality.empirical_fill(d, m, "CaseId", "q8")
    return filled.groupBy(F.col(m).alias("M")).agg(
        rnd(F.count_if(~F.col("gap")) / F.lit(float(gaps[1] - gaps[0]))).alias("Pr"),
        rnd(F.count_if("gap") / F.lit(float(gaps[0]))).alias("PrNew"))


@query("q9_group_median_fill", """
SELECT CaseId, round(coalesce(LastPaymentAmount, md),4) AS LastPaymentAmount FROM cases LEFT JOIN (
 SELECT Land, Product, quantile_cont(LastPaymentAmount,0.5) AS md FROM cases WHERE LastPaymentAmount IS NOT NULL GROUP BY 1,2) s
 ON cases.Land IS NOT DISTINCT FROM s.Land AND cases.Product = s.Product""")
def q9(t):
    d = t.cases.select("CaseId", "Land", "Product", "LastPaymentAmount")
    return quality.group_fill(d, "LastPaymentAmount", ["Land", "Product"], "median").select(
        "CaseId", rnd("LastPaymentAmount", 4).alias("LastPaymentAmount"))


@query("q10_group_mean_fill", f"""
WITH l AS (SELECT CaseId, coalesce(Land, cast({un('CaseId', 'land')} % 25 + 1 as int)) AS Land, GDPPerCapita, MeanSalary FROM cases)
SELECT CaseId, round(CASE WHEN GDPPerCapita IS NULL THEN avg(GDPPerCapita) OVER w ELSE GDPPerCapita END,4) AS GDPPerCapita,
 round(CASE WHEN GDPPerCapita IS NULL THEN avg(MeanSalary) OVER w ELSE MeanSalary END,4) AS MeanSalary FROM l WINDOW w AS (PARTITION BY Land)""")
def q10(t):
    from recoup.operators.joins import sized
    l = t.cases.select("CaseId", quality.random_category("Land", "CaseId", "land", 25).alias("Land"), "GDPPerCapita", "MeanSalary")
    s = l.groupBy("Land").agg(F.avg("GDPPerCapita").alias("G"), F.avg("MeanSalary").alias("S"))
    gap = F.col("GDPPerCapita").isNull()  # both are replaced when the first is missing
    return l.join(sized(s), "Land", "left").select(
        "CaseId", rnd(F.when(gap, F.col("G")).otherwise(F.col("GDPPerCapita")), 4).alias("GDPPerCapita"),
        rnd(F.when(gap, F.col("S")).otherwise(F.col("MeanSalary")), 4).alias("MeanSalary"))


@query("q11_band_mean_fill", """
WITH b AS (SELECT CaseId, DPD, Product, CASE WHEN TOA <= 1000 THEN 1 WHEN TOA <= 5000 THEN 2 WHEN TOA <= 10000 THEN 3
 WHEN TOA <= 20000 THEN 4 WHEN TOA <= 30000 THEN 5 ELSE 6 END AS band FROM cases)
SELECT CaseId, coalesce(DPD, cast(trunc(a) as int)) AS DPD FROM b LEFT JOIN (SELECT band, Product, avg(DPD) AS a FROM b GROUP BY 1,2) USING (band, Product)""")
def q11(t):
    d = t.cases.select("CaseId", "DPD", "Product",
                       bands.labelled("TOA", bands.TOA_LABEL_BREAKS, bands.TOA_LABELS).alias("TOAband"))
    return quality.group_fill(d, "DPD", ["TOAband", "Product"], cast=True).select("CaseId", "DPD")


@query("q12_sentinel_repair", """
WITH g AS (SELECT CaseId, coalesce(Gender,'MALE') AS Gender, Age FROM cases)
SELECT CaseId, Gender, CASE WHEN Age = -1 THEN (SELECT quantile_cont(Age,0.5) FROM g WHERE Age <> -1 AND Gender='MALE') ELSE Age END::double AS Age FROM g""")
def q12(t):
    return quality.sentinel_repair(t.cases.select("CaseId", "Gender", "Age"))


@query("q13_random_category", f"SELECT CaseId, coalesce(Land, cast({un('CaseId', 'q13')} % 37 + 1 as int)) AS Land FROM cases")
def q13(t):
    return t.cases.select("CaseId", quality.random_category("Land", "CaseId", "q13", 37).alias("Land"))


FILL = ["TOA", "Principal", "Interest", "DPD", "Age", "MeanSalary", "GDPPerCapita", "LastPaymentAmount", "M_LastPaymentToImportDate"]


@query("q14_model_fill")
def q14(t):
    filled, _ = quality.model_fill(t.cases, "PopulationInCity", "CaseId", FILL)
    return filled


@query("q15_fill_error")
def q15(t):
    _, held = quality.model_fill(t.cases, "PopulationInCity", "CaseId", FILL)
    return profile.histogram(held, "deviation", 20)


_KNOWN = " AND ".join(f"{c} IS NOT NULL" for c in FILL)


@query("q15_hold_out", f"""
WITH k AS (SELECT CaseId, PopulationInCity FROM cases WHERE PopulationInCity IS NOT NULL AND {_KNOWN}),
h AS (SELECT *, row_number() OVER (ORDER BY {md('CaseId', 'fill')}, CaseId) <= (SELECT floor(0.6*count(*)+1e-9) FROM k) AS trn FROM k)
SELECT count(*) AS n, cast(sum(CaseId) as bigint) AS ids, round(avg(PopulationInCity),6) AS actual FROM h WHERE NOT trn""")
def q15b(t):
    """The rows on which the fill is judged."""
    _, held = quality.model_fill(t.cases, "PopulationInCity", "CaseId", FILL, trees=20)
    return held.where("predicted IS NOT NULL").agg(F.count(F.lit(1)).alias("n"), F.sum("CaseId").cast("bigint").alias("ids"), rnd(F.avg("actual")).alias("actual"))
