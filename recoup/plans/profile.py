"""Correlation, distribution comparison, smoothing."""
from __future__ import annotations

from pyspark.sql import functions as F

from recoup.functions.columns import n_rows, rnd
from recoup.functions.keys import uniform
from recoup.operators import bands, features, profile, sampling
from recoup.plans.bands import edges_sql
from recoup.plans.fixture_sql import md, u
from recoup.plans.registry import query

VARS = ["TOA", "Principal", "DPD", "Age", "MeanSalary", "PopulationInCity"]
PAIRS = [(a, b) for i, a in enumerate(VARS) for b in VARS[i + 1:]]


@query("d1_pearson", " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a},{b}),6) AS r FROM cases" for a, b in PAIRS))
def d1(t):
    return profile.correlations(t.cases, VARS).withColumn("r", rnd("r"))


@query("d2_spearman", " UNION ALL ".join(f"""
SELECT '{a}' AS a, '{b}' AS b, round(corr(ra,rb),6) AS rho FROM (SELECT rank() OVER (ORDER BY {a}) + (count(*) OVER (PARTITION BY {a}) - 1)/2e0 AS ra,
 rank() OVER (ORDER BY {b}) + (count(*) OVER (PARTITION BY {b}) - 1)/2e0 AS rb FROM cases WHERE {a} IS NOT NULL AND {b} IS NOT NULL)""" for a, b in PAIRS))
def d2(t):
    return profile.spearman(t.cases, VARS).withColumn("rho", rnd("rho"))


def _test_sql(part, src):
    return f"""SELECT '{part}' AS part, r, n-2 AS df, round(r0*sqrt((n-2)/(1-r0*r0)),4) AS t,
 round(tanh(atanh(r0)-1.959963984540054e0/sqrt(n-3)),6) AS low, round(tanh(atanh(r0)+1.959963984540054e0/sqrt(n-3)),6) AS high
 FROM (SELECT corr(TOA,DPD) AS r0, round(corr(TOA,DPD),6) AS r, count(*) AS n FROM {src})"""


def _test_rows(t, parts):
    rows = []
    for name, r, n in parts:
        c = profile.correlation_test(r, n)
        rows.append((name, round(c["r"], 6), c["df"], round(c["t"], 4), round(c["low"], 6), round(c["high"], 6)))
    return t.spark.createDataFrame(rows, "part string, r double, df bigint, t double, low double, high double")


@query("d3_pearson_test", _test_sql("all", "cases WHERE DPD IS NOT NULL") + " UNION ALL "
       + _test_sql("first100", "(SELECT * FROM cases WHERE DPD IS NOT NULL ORDER BY CaseId LIMIT 100)"))
def d3(t):
    c = t.cases.filter("DPD IS NOT NULL").select("CaseId", "TOA", "DPD")
    parts = []
    for name, d in (("all", c), ("first100", c.orderBy("CaseId").limit(100))):
        r = d.agg(F.corr("TOA", "DPD"), F.count(F.lit(1))).first()
        parts.append((name, r[0], r[1]))
    return _test_rows(t, parts)


@query("d3_pearson_test_p")
def d3p(t):
    r = t.cases.filter("DPD IS NOT NULL").agg(F.corr("TOA", "DPD"), F.count(F.lit(1))).first()
    c = profile.correlation_test(r[0], r[1])
    return t.spark.createDataFrame([(c["t"], c["df"], c["p"])], "t double, df bigint, p double")


@query("d4_spearman_test_band", """
WITH b AS (SELECT Age, CASE WHEN TOA <= 1000 THEN 1 WHEN TOA <= 5000 THEN 2 WHEN TOA <= 10000 THEN 3 WHEN TOA <= 20000 THEN 4 WHEN TOA <= 30000 THEN 5 ELSE 6 END AS band FROM cases WHERE Age > -1),
r AS (SELECT corr(ra,rb) AS r0, count(*) AS n FROM (SELECT rank() OVER (ORDER BY Age) + (count(*) OVER (PARTITION BY Age) - 1)/2e0 AS ra,
 rank() OVER (ORDER BY band) + (count(*) OVER (PARTITION BY band) - 1)/2e0 AS rb FROM b))
SELECT 'band' AS part, round(r0,6) AS r, n-2 AS df, round(r0*sqrt((n-2)/(1-r0*r0)),4) AS t,
 round(tanh(atanh(r0)-1.959963984540054e0/sqrt(n-3)),6) AS low, round(tanh(atanh(r0)+1.959963984540054e0/sqrt(n-3)),6) AS high FROM r""")
def d4(t):
    b = t.cases.filter("Age > -1").select("Age", bands.cut(F.col("TOA"), [0, 1000, 5000, 10000, 20000, 30000, 1e12]).alias("band"))
    rho = profile.spearman(b, ["Age", "band"]).first()["rho"]
    return _test_rows(t, [("band", rho, b.count())])


@query("d5_correlations_of_two_sets", " UNION ALL ".join(f"""
SELECT '{a}' AS a, '{b}' AS b, round(corr({a},{b}) FILTER (Product='Credit card'),6) AS rA, round(corr({a},{b}) FILTER (Product='Cash loan'),6) AS rB FROM cases""" for a, b in PAIRS))
def d5(t):
    a = profile.correlations(t.cases.filter("Product = 'Credit card'"), VARS, "rA")
    b = profile.correlations(t.cases.filter("Product = 'Cash loan'"), VARS, "rB")
    return a.join(b, ["a", "b"]).withColumns({"rA": rnd("rA"), "rB": rnd("rB")})  # one row per pair


@query("d6_compare_distribution", """
WITH r AS (SELECT min(TOA) AS lo, max(TOA) AS hi FROM cases),
b AS (SELECT Product, cast(CASE WHEN TOA = hi THEN 20 ELSE greatest(ceil((TOA-lo)/((hi-lo)/20)),1) END as double) AS bin FROM cases, r)
SELECT bin, round(count(*) FILTER (Product='Credit card')/cast((SELECT count(*) FROM cases WHERE Product='Credit card') as double),6) AS A,
 round(count(*) FILTER (Product='Cash loan')/cast((SELECT count(*) FROM cases WHERE Product='Cash loan') as double),6) AS B FROM b GROUP BY 1""")
def d6(t):
    d = profile.compare_distribution(t.cases.filter("Product = 'Credit card'"), t.cases.filter("Product = 'Cash loan'"), "TOA", 20)
    return d.withColumns({"A": rnd("A"), "B": rnd("B")})


STAB_BANDED = ["TOA", "Principal", "DPD", "LoanAmount", "PopulationInCity", "Age"]
STAB_RAW = ["M_LastPaymentToImportDate", "Land", "Gender", "Bailiff"]


def _psi_sql(keep):
    base = (f"p AS (SELECT * FROM loans), s AS (SELECT CaseId FROM p ORDER BY {md('CaseId', 'psi')}, CaseId LIMIT (SELECT cast(floor(0.6*count(*)) as bigint) FROM p)),"
            f" x AS (SELECT p.*, 1 AS a FROM p JOIN s USING (CaseId) WHERE {keep} UNION ALL SELECT p.*, 0 FROM p WHERE CaseId NOT IN (SELECT CaseId FROM s)),"
            " pool AS (SELECT * FROM x), t AS (SELECT cast(sum(a) as double) AS na, cast(sum(1-a) as double) AS nb FROM x)")
    parts = []
    for c in STAB_BANDED:
        parts.append(f"SELECT '{c}' AS variable, band::varchar AS v, a FROM (SELECT a, greatest(len(list_filter(b, lambda z: z < {c})),1) AS band FROM x, ({edges_sql('pool', c, 20)}))")
    for c in STAB_RAW:
        parts.append(f"SELECT '{c}', {c}::varchar, a FROM x")
    return (f"WITH {base}, g AS (SELECT variable, v, sum(a)/any_value(na) AS x, sum(1-a)/any_value(nb) AS y FROM (" + " UNION ALL ".join(parts)
            + "), t GROUP BY 1,2) SELECT variable, round(sum(CASE WHEN x=0 OR y=0 THEN 'inf'::double ELSE (x-y)*ln(x/y) END),6) AS psi FROM g GROUP BY 1")


def _psi(t, keep):
    c = features.loans(t.cases)
    train, test = sampling.split(c, "CaseId", "psi", 0.6)
    return profile.stability(train.filter(keep), test, STAB_BANDED + STAB_RAW).withColumn("psi", rnd("psi"))


@query("d7_stability_index", _psi_sql("true"))
def d7(t):
    return _psi(t, F.lit(True))


@query("d8_stability_biased", _psi_sql(f"{u('CaseId', 'bias')} < CASE WHEN Age >= 40 THEN 0.8e0 ELSE 0.2e0 END"))
def d8(t):
    return _psi(t, uniform("CaseId", "bias") < F.when(F.col("Age") >= 40, F.lit(0.8)).otherwise(F.lit(0.2)))


@query("d9_histogram", """
WITH r AS (SELECT min(TOA) AS lo, max(TOA) AS hi FROM cases)
SELECT bin, n, round(lo+(bin-1)*((hi-lo)/50),4) AS low FROM (SELECT cast(CASE WHEN TOA = hi THEN 50 ELSE greatest(ceil((TOA-lo)/((hi-lo)/50)),1) END as int) AS bin, count(*) AS n FROM cases, r GROUP BY 1), r""")
def d9(t):
    return profile.histogram(t.cases, "TOA", 50).withColumn("low", rnd("low", 4))


@query("d10_trend_line", "SELECT round(regr_slope(TOA,Age),6) AS slope, round(regr_intercept(TOA,Age),4) AS intercept, count(*) AS n FROM cases WHERE Age > -1")
def d10(t):
    d = profile.trend(t.cases.filter("Age > -1"), "TOA", "Age")
    return d.withColumns({"slope": rnd("slope"), "intercept": rnd("intercept", 4)})


@query("d11_local_smoother", """
WITH p AS (SELECT cast(Age as double) AS x, TOA AS y FROM cases WHERE Age > -1), g AS (SELECT DISTINCT x AS x0 FROM p),
v AS (SELECT x, count(*) AS n, sum(y) AS sy FROM p GROUP BY 1),
c AS (SELECT x0, abs(x-x0) AS d, sum(n) AS n FROM g, v GROUP BY 1,2),
h AS (SELECT x0, min(d) AS h FROM (SELECT x0, d, sum(n) OVER (PARTITION BY x0 ORDER BY d) AS upto FROM c) WHERE upto >= (SELECT floor(count(*)/3e0+1e-9) FROM p) GROUP BY 1),
w AS (SELECT x0, x-x0 AS dx, n, sy, pow(1-pow(abs(x-x0)/h,3),3) AS t FROM h, v WHERE abs(x-x0) < h),
s AS (SELECT x0, sum(t*n) AS s0, sum(t*n*dx) AS s1, sum(t*n*dx*dx) AS s2, sum(t*sy) AS v0, sum(t*sy*dx) AS v1 FROM w GROUP BY 1)
SELECT x0 AS x, round((s2*v0-s1*v1)/(s0*s2-s1*s1),4) AS smooth FROM s""")
def d11(t):
    c = t.cases.filter("Age > -1").select("Age", "TOA")
    ages = [r[0] for r in c.select("Age").distinct().collect()]  # whole years of life
    return profile.smoother(c, "Age", "TOA", 1 / 3, ages).select("x", rnd("smooth", 4).alias("smooth"))


@query("d11_robust_smoother")
def d11r(t):
    c = t.cases.filter("Age > -1").select("Age", "TOA")
    ages = [r[0] for r in c.select("Age").distinct().collect()]
    return profile.smoother(c, "Age", "TOA", 1 / 3, ages, passes=3)


@query("d12_conditional_rate", f"""
WITH a AS (SELECT Age, Suc FROM scored WHERE Age > -1), e AS ({edges_sql('a', 'Age', 10)})
SELECT 'band' AS part, cast(greatest(len(list_filter(b, lambda z: z < Age)),1) as int) AS x, count(*) AS n, round(avg(Suc),6) AS rate FROM a, e GROUP BY 2
UNION ALL SELECT 'age', Age, count(*), round(avg(Suc),6) FROM a WHERE Age > 70 GROUP BY 2""")
def d12(t):
    a = features.scored(t.case_events, t.cases).filter("Age > -1").select("Age", "Suc")
    x = bands.quantile_band(a, "Age", 10, "x").groupBy("x").agg(n_rows(), rnd(F.avg("Suc")).alias("rate"))
    y = a.filter("Age > 70").groupBy(F.col("Age").alias("x")).agg(n_rows(), rnd(F.avg("Suc")).alias("rate"))
    return x.select(F.lit("band").alias("part"), "*").unionByName(y.select(F.lit("age").alias("part"), "*"))


@query("d13_qq_points")
def d13(t):
    return profile.qq_points(t.cases.select(F.log("TOA").alias("x")), "x")
