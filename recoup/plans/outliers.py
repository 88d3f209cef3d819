"""Outlier tests."""
from __future__ import annotations

from pyspark.sql import functions as F

from recoup.functions.columns import rnd
from recoup.operators import outliers
from recoup.plans.registry import query

MV = ["TOA", "Principal", "Interest", "DPD", "D_ContractDateToImportDate", "Age", "PopulationInCity"]


@query("o1_grubbs", """
SELECT count(*) AS n, round(max(abs(TOA-m))/any_value(s),6) AS G FROM cases, (SELECT avg(TOA) AS m, stddev_samp(TOA) AS s FROM cases)""")
def o1(t):
    g = outliers.grubbs(t.cases, "TOA")
    return t.spark.createDataFrame([(g["n"], round(g["G"], 6))], "n bigint, G double")


@query("o1_grubbs_decision")
def o1b(t):
    g = outliers.grubbs(t.cases, "TOA")
    return t.spark.createDataFrame([(g["G"], g["critical"], bool(g["outlier"]))], "G double, critical double, outlier boolean")


@query("o2_tietjen_moore", """
WITH m AS (SELECT avg(TOA) AS m FROM cases), z AS (SELECT TOA-m AS z, row_number() OVER (ORDER BY TOA) AS i,
 row_number() OVER (ORDER BY abs(TOA-m), TOA) AS j, count(*) OVER () AS n FROM cases, m)
SELECT round((sum(z*z) FILTER (i > 1000) - pow(sum(z) FILTER (i > 1000),2)/count(*) FILTER (i > 1000))/sum(z*z),6) AS L_low,
 round((sum(z*z) FILTER (i <= n-1000) - pow(sum(z) FILTER (i <= n-1000),2)/count(*) FILTER (i <= n-1000))/sum(z*z),6) AS L_high,
 round((sum(z*z) FILTER (j <= n-1000) - pow(sum(z) FILTER (j <= n-1000),2)/count(*) FILTER (j <= n-1000))/sum(z*z),6) AS E FROM z""")
def o2(t):
    r = outliers.tietjen_moore(t.cases, "TOA", 1000)
    return r.select(*[rnd(c).alias(c) for c in r.columns])


@query("o3_esd_statistics", """
WITH RECURSIVE b AS (SELECT avg(TOA) AS m, count(*) AS n FROM cases),
lo AS (SELECT list(z ORDER BY z) AS l FROM (SELECT TOA-m AS z FROM cases, b ORDER BY z LIMIT 100)),
hi AS (SELECT list(z ORDER BY z DESC) AS h FROM (SELECT TOA-m AS z FROM cases, b ORDER BY z DESC LIMIT 100)),
st AS (SELECT count(*) AS n, sum(TOA-m) AS s, sum((TOA-m)*(TOA-m)) AS ss FROM cases, b),
e(i, a, c, n, s, ss, R, val) AS (
 SELECT 0, 0, 0, n, s, ss, 0e0, 0e0 FROM st
 UNION ALL
 SELECT i+1, a + cast(tl as int), c + cast(NOT tl as int), n-1, s - v, ss - v*v, abs(v - s/n)/sqrt((ss - s*s/n)/(n-1)), v FROM (
  SELECT *, CASE WHEN tl THEN l[a+1] ELSE h[c+1] END AS v FROM (SELECT e.*, l, h, (s/n - l[a+1]) > (h[c+1] - s/n) AS tl FROM e, lo, hi WHERE i < 100)))
SELECT i, round(R,6) AS R, round(val + m,2) AS value FROM e, b WHERE i > 0""")
def o3(t):
    rows = outliers.esd_steps(t.cases, "TOA", 100)
    return t.spark.createDataFrame([(r["i"], round(r["R"], 6), round(r["value"], 2)) for r in rows],
                                   "i int, R double, value double")


@query("o3_esd_count")
def o3b(t):
    rows = outliers.esd_steps(t.cases, "TOA", 1000)
    over = [r["i"] for r in rows if r["R"] > r["critical"]]
    return t.spark.createDataFrame([(len(over), max(over, default=0))], "exceeding int, last_exceeding int")


@query("o4_robust_mahalanobis")
def o4(t):
    return outliers.robust_mahalanobis(t.cases.select("CaseId", *MV), MV).select("CaseId", "md", "outlier")
