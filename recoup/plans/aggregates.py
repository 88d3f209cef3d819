"""Aggregations."""
from __future__ import annotations

from pyspark.sql import functions as F

from recoup.functions.columns import n_rows, ratio, rnd
from recoup.functions.keys import fold
from recoup.operators import bands, features, profile, ranks
from recoup.plans.fixture_sql import un
from recoup.plans.registry import query
from recoup.plans.verbs import verbs


BAND9 = """CASE WHEN TOA > 0 AND TOA <= 1000 THEN 1 WHEN TOA <= 2000 THEN 2 WHEN TOA <= 4000 THEN 3
 WHEN TOA <= 6000 THEN 4 WHEN TOA <= 10000 THEN 5 WHEN TOA <= 20000 THEN 6 WHEN TOA <= 40000 THEN 7
 WHEN TOA <= 65000 THEN 8 WHEN TOA <= 100000 THEN 9 END"""


def monthly_recovery(t):
    """Recovery rate by month and debt band: a ratio of sums."""
    c = t.cases.select("CaseId", "TOA", bands.cut("TOA", bands.TOA_BREAKS).alias("TOAband"))
    e = t.case_events.select("CaseId", "Month", features.zero("NumberOfCalls").alias("calls"),
                             features.pay().alias("pay"))
    return (e.join(c, "CaseId").groupBy("Month", "TOAband")
            .agg(F.count(F.lit(1)).alias("NumberOfCases"), F.sum("calls").alias("NumberOfCalls"),
                 rnd(F.sum("pay") / F.sum("TOA")).alias("SR")))


@query("a1_row_count", "SELECT count(*) AS n FROM verbs")
def a1(t):
    return verbs(t).agg(n_rows())


@query("a2_count_by_keys", "SELECT species, Cube, count(*) AS n FROM verbs GROUP BY 1,2 ORDER BY 1,2")
def a2(t):
    return verbs(t).groupBy("species", "Cube").agg(n_rows()).orderBy("species", "Cube")


@query("a3_named_aggregates", """
SELECT Coin, count(*) AS n, cast(sum(Cube) as bigint) AS SumCube, round(avg(p_size),6) AS AvgSize FROM verbs GROUP BY 1""")
def a3(t):
    return verbs(t).groupBy("Coin").agg(n_rows(), F.sum("Cube").alias("SumCube"), rnd(F.avg("p_size")).alias("AvgSize"))


@query("a4_null_aware", """
SELECT Land, min(PopulationInCity) AS MinPop, round(avg(PopulationInCity),6) AS AvgPop, max(PopulationInCity) AS MaxPop,
 count(*) FILTER (PopulationInCity IS NULL) AS Nulls FROM cases GROUP BY 1""")
def a4(t):
    p = "PopulationInCity"
    return t.cases.groupBy("Land").agg(
        F.min(p).alias("MinPop"), rnd(F.avg(p)).alias("AvgPop"), F.max(p).alias("MaxPop"),
        F.count_if(F.col(p).isNull()).alias("Nulls"))


@query("a5_conditional_share", """
SELECT Product, count(*) FILTER (Gender='FEMALE') AS F_count, round(avg(CASE WHEN Gender='FEMALE' THEN 1e0 ELSE 0e0 END),6) AS F_percent
FROM cases GROUP BY 1""")
def a5(t):
    woman = F.col("Gender") == "FEMALE"
    return t.cases.groupBy("Product").agg(F.count_if(woman).alias("F_count"),
                                          rnd(F.avg(F.when(woman, 1.0).otherwise(0.0))).alias("F_percent"))


@query("a6_share_of_total", """
SELECT Suc, count(*) AS n, round(count(*)/cast(sum(count(*)) OVER () as double),6) AS share FROM success6 GROUP BY 1""")
def a6(t):
    s = features.success6(t.case_events, t.cases)
    g = s.groupBy("Suc").agg(n_rows())
    total = s.count()
    return g.withColumn("share", rnd(F.col("n") / F.lit(float(total))))


@query("a7_having", """
SELECT CaseId, count(*) AS n FROM case_events WHERE NumberOfPayment > 0 GROUP BY 1 HAVING count(*) >= 3""")
def a7(t):
    return t.case_events.filter("NumberOfPayment > 0").groupBy("CaseId").agg(n_rows()).filter("n >= 3")


@query("a8_distinct_count", """
SELECT count(DISTINCT Age) AS Age, count(DISTINCT Land) AS Land, count(DISTINCT TOA) AS TOA FROM cases""")
def a8(t):
    # One shuffle keyed by (column, value) instead of an expand over three distinct aggregates.
    long = profile.melt(t.cases, ["Age", "Land", "TOA"]).filter("value IS NOT NULL").distinct()
    return long.agg(*[F.count_if(F.col("variable") == c).alias(c) for c in ("Age", "Land", "TOA")])


@query("a9_quantile_grid", """
SELECT round(p,2) AS p, round(quantile_cont(TOA, p),4) AS q FROM cases,
 (SELECT unnest([0.0,0.05,0.1,0.15,0.2,0.25,0.3,0.35,0.4,0.45,0.5,0.55,0.6,0.65,0.7,0.75,0.8,0.85,0.9,0.95,1.0])::double AS p) GROUP BY p"""
       .replace("quantile_cont(TOA, p)", "list_extract(quantile_cont(TOA, [0.0,0.05,0.1,0.15,0.2,0.25,0.3,0.35,0.4,0.45,0.5,0.55,0.6,0.65,0.7,0.75,0.8,0.85,0.9,0.95,1.0]), cast(round(p*20) as int)+1)"))
def a9(t):
    q = ranks.exact_quantiles(t.cases, ["TOA"], [i / 20 for i in range(21)])
    return q.select(rnd("p", 2).alias("p"), rnd("q", 4).alias("q"))


PROBS7 = [0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0]


def _profile_sql(by):
    cols = ", ".join(f"round(quantile_cont(TOA,{p}),4) AS q{p * 100:g}" for p in PROBS7)
    keys = ", ".join(by)
    return f"SELECT {keys}, {cols} FROM cases GROUP BY {keys}"


def _profile(t, by):
    out = profile.profile(t.cases, ["TOA"], PROBS7, by)
    return out.select(*by, *[rnd(f"q{p * 100:g}", 4).alias(f"q{p * 100:g}") for p in PROBS7])


@query("a10_profile_by_product", _profile_sql(["Product"]))
def a10a(t):
    return _profile(t, ["Product"])


@query("a10_profile_by_gender_product", _profile_sql(["Gender", "Product"]))
def a10b(t):
    return _profile(t, ["Gender", "Product"])


@query("a10_profile_by_enforcement", _profile_sql(["Bailiff", "ClosedExecution"]))
def a10c(t):
    return _profile(t, ["Bailiff", "ClosedExecution"])


NUMERIC = ["TOA", "Principal", "Interest", "Other", "LoanAmount", "D_ContractDateToImportDate", "DPD", "Age",
           "LastPaymentAmount", "M_LastPaymentToImportDate", "GDPPerCapita", "MeanSalary", "PopulationInCity"]


@query("a11_table_summary", " UNION ALL ".join(
    f"""SELECT '{c}' AS variable, cast(min({c}) as double) AS min, round(quantile_cont({c},0.25),4) AS q25,
 round(quantile_cont({c},0.5),4) AS q50, round(avg({c}),4) AS mean, round(quantile_cont({c},0.75),4) AS q75,
 cast(max({c}) as double) AS max, count(*) FILTER ({c} IS NULL) AS nulls FROM cases""" for c in NUMERIC))
def a11(t):
    s = profile.summary(t.cases, NUMERIC)
    return s.select("variable", "min", "max", "nulls",
                    *[rnd(c, 4).alias(c) for c in ("q25", "q50", "mean", "q75")])


@query("a12_trimmed_means", """
WITH r AS (SELECT TOA, row_number() OVER (ORDER BY TOA) AS i, count(*) OVER () AS n FROM cases)
SELECT round(avg(TOA),4) AS trim0,
 round(avg(TOA) FILTER (i > floor(n*0.01) AND i <= n - floor(n*0.01)),4) AS trim1,
 round(avg(TOA) FILTER (i > floor(n*0.05) AND i <= n - floor(n*0.05)),4) AS trim5,
 round(avg(TOA) FILTER (i > floor(n*0.1) AND i <= n - floor(n*0.1)),4) AS trim10,
 round(quantile_cont(TOA,0.5),4) AS median FROM r""")
def a12(t):
    means = profile.trimmed_means(t.cases, "TOA", [0.0, 0.01, 0.05, 0.1])
    median = ranks.quantile_list(t.cases, "TOA", [0.5])[0]
    return means.select(*[rnd(c, 4).alias(c) for c in means.columns], F.lit(round(median, 4)).alias("median"))


@query("a13_box_statistics", """
WITH s AS (SELECT list_sort(list(TOA)) AS v, count(*) AS n FROM cases),
d AS (SELECT v, n, floor((n+3)/2)/2 AS h FROM s),
h AS (SELECT 0.5e0*(v[cast(floor(h) as int)]+v[cast(ceil(h) as int)]) AS q1,
  0.5e0*(v[cast(floor((n+1)/2) as int)]+v[cast(ceil((n+1)/2) as int)]) AS median,
  0.5e0*(v[cast(floor(n+1-h) as int)]+v[cast(ceil(n+1-h) as int)]) AS q3 FROM d)
SELECT min(TOA) FILTER (TOA >= q1-1.5e0*(q3-q1)) AS low, round(any_value(q1),4) AS q1, round(any_value(median),4) AS median,
 round(any_value(q3),4) AS q3, max(TOA) FILTER (TOA <= q3+1.5e0*(q3-q1)) AS high,
 count(*) FILTER (TOA < q1-1.5e0*(q3-q1) OR TOA > q3+1.5e0*(q3-q1)) AS beyond FROM cases, h""")
def a13(t):
    b = profile.box_statistics(t.cases, "TOA")
    return b.select("low", "high", "beyond", *[rnd(c, 4).alias(c) for c in ("q1", "median", "q3")])


@query("a14_monthly_recovery", f"""
SELECT Month, {BAND9} AS TOAband, count(*) AS NumberOfCases, cast(sum(coalesce(NumberOfCalls,0)) as bigint) AS NumberOfCalls,
 round(sum(coalesce(PaymentAmount,0))/sum(TOA),6) AS SR
FROM case_events JOIN cases USING (CaseId) GROUP BY 1,2""")
def a14(t):
    return monthly_recovery(t)


@query("a15_first_month", """
SELECT CaseId, min(Month) AS MinMonth_CWC FROM case_events WHERE NumberOfCallsWithClient > 0 GROUP BY 1""")
def a15(t):
    return t.case_events.filter("NumberOfCallsWithClient > 0").groupBy("CaseId").agg(
        F.min("Month").alias("MinMonth_CWC"))


@query("a16_behaviour_features", """
SELECT CaseId, LegalTransfer, SignedAgreement, round(Reach,6) AS Reach, NoCallClient, NoLetRec, NoPay, round(Pay6,2) AS Pay6 FROM behaviour6""")
def a16(t):
    b = features.behaviour6(t.case_events)
    return b.withColumns({"Reach": rnd("Reach"), "Pay6": rnd("Pay6", 2)})


@query("a16_agreement_features", "SELECT * REPLACE (round(Payments,2) AS Payments) FROM agreement3")
def a16b(t):
    return features.agreement3(t.case_events).withColumn("Payments", rnd("Payments", 2))


@query("a17_targets", """
SELECT CaseId, Reach, round(Pay712,2) AS Pay712, round(Pay712log,6) AS Pay712log, round(Payments,2) AS Payments, NoPay25, Suc0, Suc1, Suc
FROM reach JOIN pay712 USING (CaseId) JOIN success6 USING (CaseId)""")
def a17(t):
    return (features.reach(t.case_events).join(features.pay712(t.case_events), "CaseId")
            .join(features.success6(t.case_events, t.cases), "CaseId")
            .withColumns({"Pay712": rnd("Pay712", 2), "Pay712log": rnd("Pay712log"), "Payments": rnd("Payments", 2)}))


@query("a18_contingency", """
WITH e AS (SELECT list_sort(list_distinct(quantile_cont(TOA,[0,0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9,1.0]))) AS b FROM cases),
c AS (SELECT Gender, len(list_filter(b, lambda x: x < TOA)) AS band FROM cases, e WHERE Gender IS NOT NULL)
SELECT Gender, cast(band as int) AS TOA_band, count(*) AS n, round(count(*)/cast(sum(count(*)) OVER (PARTITION BY Gender) as double),6) AS share
FROM c WHERE band >= 1 GROUP BY 1,2""")
def a18(t):
    c = bands.quantile_band(t.cases, "TOA", 10, include_lowest=False)
    return profile.contingency(c, "Gender", "TOA_band").withColumn("share", rnd("share"))


@query("a19_function_over_columns", " UNION ALL ".join(
    f"SELECT '{c}' AS variable, round(avg({c}),4) AS mean, round(stddev_samp({c}),4) AS sd, count(DISTINCT {c}) AS distinct_values FROM cases"
    for c in NUMERIC[:6]))
def a19(t):
    long = profile.melt(t.cases, NUMERIC[:6])
    # Two-level: counts per value, then moments around the mean; no distinct expansion per column.
    v = long.filter("value IS NOT NULL").groupBy("variable", "value").agg(F.count(F.lit(1)).alias("w"))
    d = v.groupBy("variable").agg(F.count(F.lit(1)).alias("distinct_values"))
    m = long.groupBy("variable").agg(rnd(F.avg("value"), 4).alias("mean"), rnd(F.stddev_samp("value"), 4).alias("sd"))
    return m.join(d, "variable")


@query("a20_grouped_covariance", " UNION ALL ".join(
    f"SELECT Product, '{a}' AS a, '{b}' AS b, round(covar_samp({a},{b}),2) AS cov FROM cases GROUP BY 1"
    for i, a in enumerate(["TOA", "DPD", "Age"]) for b in ["TOA", "DPD", "Age"][i:]))
def a20(t):
    return profile.covariances(t.cases, ["TOA", "DPD", "Age"], ["Product"]).withColumn("cov", rnd("cov", 2))


@query("a21_distinct_keys", "SELECT DISTINCT CaseId FROM case_events WHERE Month <= 3 AND NumberOfAgreementConcluded > 0")
def a21(t):
    return t.case_events.filter("Month <= 3 AND NumberOfAgreementConcluded > 0").select("CaseId").distinct()


@query("a22_arg_extremes", """
SELECT Product, arg_max(CaseId, (TOA, CaseId)) AS LargestDebt, arg_min(CaseId, (TOA, CaseId)) AS SmallestDebt FROM cases GROUP BY 1""")
def a22(t):
    key = F.struct("TOA", "CaseId")
    return t.cases.groupBy("Product").agg(F.max_by("CaseId", key).alias("LargestDebt"),
                                          F.min_by("CaseId", key).alias("SmallestDebt"))


QS = [0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95]


@query("a23_quantiles_over_replicates", f"""
WITH p AS (SELECT {un('CaseId', 'pk')} % 10 AS Pckg, Month, sum(coalesce(PaymentAmount,0))/sum(TOA) AS SR
  FROM case_events JOIN cases USING (CaseId) GROUP BY 1,2)
SELECT Month, round(avg(SR),6) AS SR, round(stddev_samp(SR),6) AS StdSR,
 {', '.join(f"round(quantile_cont(SR,{q}),6) AS q{q * 100:g}" for q in QS)} FROM p GROUP BY 1""")
def a23(t):
    p = (t.case_events.join(t.cases.select("CaseId", "TOA"), "CaseId")
         .groupBy(fold("CaseId", "pk", 10).alias("Pckg"), "Month")
         .agg((F.sum(features.pay()) / F.sum("TOA")).alias("SR")))
    # At most 10 packages x 12 months: the built-in exact percentile is bounded.
    return p.groupBy("Month").agg(rnd(F.avg("SR")).alias("SR"), rnd(F.stddev_samp("SR")).alias("StdSR"),
                                  *[rnd(F.percentile("SR", F.lit(q))).alias(f"q{q * 100:g}") for q in QS])


@query("a24_panel_completeness", """
SELECT months, count(*) AS cases FROM (SELECT c.CaseId, count(e.Month) AS months FROM cases c LEFT JOIN case_events e USING (CaseId) GROUP BY 1) GROUP BY 1""")
def a24(t):
    per = (t.cases.select("CaseId").join(t.case_events.select("CaseId", "Month"), "CaseId", "left")
           .groupBy("CaseId").agg(F.count("Month").alias("months")))
    return per.groupBy("months").agg(F.count(F.lit(1)).alias("cases"))


@query("a25_averaged_edges", f"""
WITH q AS (SELECT {un('CaseId', 'pk')} % 10 AS Pckg, min(TOA) AS q0, quantile_cont(TOA,0.2) AS q20, quantile_cont(TOA,0.4) AS q40,
  quantile_cont(TOA,0.6) AS q60, quantile_cont(TOA,0.8) AS q80, max(TOA) AS q100 FROM cases GROUP BY 1)
SELECT round(min(q0),4) AS e0, round(avg(q20),4) AS e1, round(avg(q40),4) AS e2, round(avg(q60),4) AS e3, round(avg(q80),4) AS e4, round(max(q100),4) AS e5 FROM q""")
def a25(t):
    from recoup.operators.backtest import averaged_edges
    c = t.cases.withColumn("Pckg", fold("CaseId", "pk", 10))
    e = averaged_edges(c, "TOA", "Pckg")
    return e.select(*[rnd(f"e{i}", 4).alias(f"e{i}") for i in range(6)])
