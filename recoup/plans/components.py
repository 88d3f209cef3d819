"""Components, discriminants and coverage."""
from __future__ import annotations

from pyspark.sql import functions as F

from recoup.functions.columns import rnd
from recoup.functions.keys import uniform
from recoup.operators import bands, components, evaluate, features, outliers
from recoup.plans.bands import edges_sql
from recoup.plans.fixture_sql import u
from recoup.plans.registry import query

VARS = ["TOA", "LoanAmount", "DPD", "Age", "PopulationInCity", "MeanSalary"]


def sets(t):
    loans = features.loans(t.cases)
    rule = uniform("CaseId", "pca") < F.when(F.col("TOA") >= 15000, F.lit(0.3)).otherwise(F.lit(0.1))
    return loans.filter(rule), loans.filter(~rule)


@query("m10_component_loadings")
def m10(t):
    smp, _ = sets(t)
    return components.fit_pca(smp, VARS).loadings(smp)


@query("m11_explained_variance", """
SELECT component, round(sqrt(v),6) AS sdev, round(v/2,6) AS share, round(sum(v/2) OVER (ORDER BY component),6) AS cumulated FROM (
 SELECT 1 AS component, 1+abs(corr(TOA,DPD)) AS v FROM loans UNION ALL SELECT 2, 1-abs(corr(TOA,DPD)) FROM loans)""")
def m11(t):
    loans = features.loans(t.cases)
    e = components.fit_pca(loans, ["TOA", "DPD"]).explained(loans)
    return e.select("component", *[rnd(c).alias(c) for c in ("sdev", "share", "cumulated")])


@query("m11_explained_variance_all")
def m11b(t):
    smp, _ = sets(t)
    return components.fit_pca(smp, VARS).explained(smp)


@query("m12_projection")
def m12(t):
    smp, ref = sets(t)
    return components.fit_pca(smp, VARS).project(ref, ["CaseId"])


RULE = f"{u('CaseId', 'pca')} < CASE WHEN TOA >= 15000 THEN 0.3e0 ELSE 0.1e0 END"


@query("m13_coverage", f"""
WITH s AS (SELECT * FROM loans WHERE {RULE}), r AS (SELECT * FROM loans WHERE NOT ({RULE})),
e1 AS ({edges_sql('s', 'TOA', 5).replace(' AS b', ' AS b1')}), e2 AS ({edges_sql('s', 'DPD', 5).replace(' AS b', ' AS b2')}),
f AS (SELECT *, CASE WHEN TOA >= b1[1] AND TOA <= b1[len(b1)] THEN greatest(len(list_filter(b1, lambda z: z < TOA)),1) END AS c1,
  CASE WHEN DPD >= b2[1] AND DPD <= b2[len(b2)] THEN greatest(len(list_filter(b2, lambda z: z < DPD)),1) END AS c2, {RULE} AS smp FROM loans, e1, e2),
a AS (SELECT c1, c2, count(*) FILTER (smp) AS n, count(*) FILTER (NOT smp) AS m FROM f GROUP BY 1,2 HAVING count(*) FILTER (smp) > 0)
SELECT count(*) AS cells, count(*) FILTER (m = 0) AS empty, count(*) FILTER (m < n) AS short, floor(min(m/n))::bigint AS Min, floor(quantile_cont(m/n,0.25))::bigint AS Q25,
 floor(quantile_cont(m/n,0.5))::bigint AS Q50, floor(quantile_cont(m/n,0.75))::bigint AS Q75, floor(max(m/n))::bigint AS Max FROM a""")
def m13(t):
    smp, ref = sets(t)
    cell = {f"c{i}": bands.cut(v, bands.edges(smp, v, 5), True) for i, v in ((1, "TOA"), (2, "DPD"))}
    c = components.coverage(smp.withColumns(cell), ref.withColumns(cell), ["c1", "c2"])

    def q(p):
        return F.floor(F.percentile("ratio", F.lit(p)))  # one value per cell
    return c.agg(F.count(F.lit(1)).alias("cells"), F.count_if(F.col("RefCount") == 0).alias("empty"),
                 F.count_if(F.col("RefCount") < F.col("SmpCount")).alias("short"), q(0.0).alias("Min"),
                 q(0.25).alias("Q25"), q(0.5).alias("Q50"), q(0.75).alias("Q75"), q(1.0).alias("Max"))


@query("m14_component_depth")
def m14(t):
    smp, ref = sets(t)
    fit = components.fit_pca(smp, VARS)
    a, b = fit.project(smp, ["CaseId"]), fit.project(ref, ["CaseId"])
    cell = {f"PC{j}band": bands.cut(f"PC{j}", bands.edges(a, f"PC{j}", 5), True) for j in range(1, len(VARS) + 1)}
    return components.fit_depth(a.withColumns(cell), b.withColumns(cell), list(cell), 2)


def reach_set(t):
    return t.cases.filter("Age > -1 AND DPD IS NOT NULL").select(
        "CaseId", (F.col("TOA") / 1000).alias("x1"), (F.col("DPD") / 100).alias("x2")).join(
        features.reach(t.case_events), "CaseId")


DISC = """d AS (SELECT CaseId, TOA/1000 AS x1, DPD/100 AS x2, Reach FROM cases JOIN reach USING (CaseId) WHERE Age > -1 AND DPD IS NOT NULL),
g AS (SELECT Reach, count(*) AS n, avg(x1) AS m1, avg(x2) AS m2, var_samp(x1) AS s11, var_samp(x2) AS s22, covar_samp(x1,x2) AS s12 FROM d GROUP BY 1),
n AS (SELECT sum(n) AS t FROM g)"""
POOL = """, p AS (SELECT sum((n-1)*s11)/(any_value(t)-2) AS a, sum((n-1)*s22)/(any_value(t)-2) AS b, sum((n-1)*s12)/(any_value(t)-2) AS c FROM g, n),
k AS (SELECT Reach AS r, n/cast(t as double) AS pi, m1, m2, a, b, c FROM g, n, p)"""
OWN = ", k AS (SELECT Reach AS r, n/cast(t as double) AS pi, m1, m2, s11 AS a, s22 AS b, s12 AS c FROM g, n)"
POST = """, s AS (SELECT CaseId, Reach, r, ln(pi) - 0.5e0*ln(a*b-c*c) - 0.5e0*(b*pow(x1-m1,2) - 2*c*(x1-m1)*(x2-m2) + a*pow(x2-m2,2))/(a*b-c*c) AS d FROM d, k),
o AS (SELECT CaseId, any_value(Reach) AS Reach, 1/(1+exp(sum(CASE WHEN r=0 THEN d ELSE -d END))) AS post FROM s GROUP BY 1)"""


def _disc(t, quadratic):
    d = reach_set(t)
    f = components.fit_discriminant(d, "Reach", ["x1", "x2"], quadratic)
    return d.select("CaseId", "Reach", f.posterior().alias("posterior")), f


@query("m15_linear_discriminant", f"WITH {DISC}{POOL}{POST} SELECT CaseId, round(post,6) AS posterior, cast(post > 0.5e0 as int) AS class FROM o")
def m15(t):
    d, _ = _disc(t, False)
    return d.select("CaseId", rnd("posterior").alias("posterior"), (F.col("posterior") > 0.5).cast("int").alias("class"))


@query("m16_quadratic_discriminant", f"WITH {DISC}{OWN}{POST} SELECT CaseId, round(post,6) AS posterior, cast(post > 0.5e0 as int) AS class FROM o")
def m16(t):
    d, _ = _disc(t, True)
    return d.select("CaseId", rnd("posterior").alias("posterior"), (F.col("posterior") > 0.5).cast("int").alias("class"))


@query("m17_prior_threshold", f"""
WITH {DISC}{POOL}{POST} SELECT Reach AS actual, cast(post > (SELECT avg(Reach) FROM d) as int) AS pred, count(*) AS n FROM o GROUP BY 1,2""")
def m17(t):
    d, f = _disc(t, False)
    return (d.groupBy(F.col("Reach").alias("actual"), (F.col("posterior") > F.lit(f.priors[1])).cast("int").alias("pred"))
            .agg(F.count(F.lit(1)).alias("n")))


@query("m15_linear_discriminant_all_variables")
def m15b(t):
    d = features.loans(t.cases).join(features.reach(t.case_events), "CaseId")
    f = components.fit_discriminant(d, "Reach", VARS)
    p = d.select("CaseId", "Reach", f.posterior().alias("posterior"))
    return evaluate.confusion(p, "Reach", (F.col("posterior") > F.lit(f.priors[1])).cast("int"))
