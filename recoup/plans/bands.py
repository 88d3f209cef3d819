"""Bands and scaling."""
from __future__ import annotations

from pyspark.sql import functions as F

from recoup.functions.columns import n_rows, rnd
from recoup.operators import bands, features
from recoup.plans.aggregates import BAND9
from recoup.plans.registry import query



def edges_sql(table, col, k, where="true"):
    qs = ",".join(f"{i}/{k}.0" if 0 < i < k else ("0" if i == 0 else "1.0") for i in range(k + 1))
    lit = ",".join(repr(i / k) for i in range(k + 1))
    return f"SELECT list_sort(list_distinct(quantile_cont({col},[{lit}]))) AS b FROM {table} WHERE {where}"


@query("b1_fixed_bands", f"SELECT {BAND9} AS TOAband, count(*) AS n, round(avg(TOA),6) AS AvgTOA FROM cases GROUP BY 1")
def b1(t):
    return t.cases.groupBy(bands.cut("TOA", bands.TOA_BREAKS).alias("TOAband")).agg(n_rows(), rnd(F.avg("TOA")).alias("AvgTOA"))


@query("b1_payment_bands", """
SELECT CASE WHEN LastPaymentAmount > 0 AND LastPaymentAmount <= 50 THEN 1 WHEN LastPaymentAmount > 50 AND LastPaymentAmount <= 300 THEN 2
 WHEN LastPaymentAmount > 300 AND LastPaymentAmount <= 60000 THEN 3 END AS band, count(*) AS n FROM cases GROUP BY 1""")
def b1b(t):
    return t.cases.groupBy(bands.cut("LastPaymentAmount", bands.PAYMENT_BREAKS).alias("band")).agg(n_rows())


@query("b2_quantile_bands", f"""
WITH e AS ({edges_sql('cases', 'M_LastPaymentToImportDate', 10)})
SELECT cast(CASE WHEN M_LastPaymentToImportDate IS NOT NULL THEN greatest(len(list_filter(b, lambda x: x < M_LastPaymentToImportDate)),1) END as int) AS band,
 count(*) AS n, min(M_LastPaymentToImportDate) AS lo, max(M_LastPaymentToImportDate) AS hi FROM cases, e GROUP BY 1""")
def b2(t):
    c = bands.quantile_band(t.cases, "M_LastPaymentToImportDate", 10, "band")
    m = "M_LastPaymentToImportDate"
    return c.groupBy("band").agg(n_rows(), F.min(m).alias("lo"), F.max(m).alias("hi"))


@query("b3_quantile_bands_open", f"""
WITH e AS ({edges_sql('cases', 'TOA', 10)})
SELECT cast(nullif(len(list_filter(b, lambda x: x < TOA)),0) as int) AS band, count(*) AS n FROM cases, e GROUP BY 1""")
def b3(t):
    return bands.quantile_band(t.cases, "TOA", 10, "band", include_lowest=False).groupBy("band").agg(n_rows())


@query("b4_labelled_bands", """
SELECT CASE WHEN TOA <= 1000 THEN '1. 1k' WHEN TOA <= 5000 THEN '2. 5k' WHEN TOA <= 10000 THEN '3. 10k' WHEN TOA <= 20000 THEN '4. 20k'
 WHEN TOA <= 30000 THEN '5. 30k' ELSE '6. 30k+' END AS TOAband, count(*) AS n FROM cases GROUP BY 1""")
def b4(t):
    return t.cases.groupBy(bands.labelled("TOA", bands.TOA_LABEL_BREAKS, bands.TOA_LABELS).alias("TOAband")).agg(n_rows())


@query("b5_equal_width", """
SELECT cast(CASE WHEN score >= 0 AND greatest(ceil(score/0.05e0),1) <= 20 THEN greatest(ceil(score/0.05e0),1) END as int) AS band, count(*) AS n FROM scored GROUP BY 1""")
def b5(t):
    s = features.scored(t.case_events, t.cases)
    return s.groupBy(bands.equal_width("score", 0.0, 0.05, 20).alias("band")).agg(n_rows())


@query("b6_supplied_edges", """
SELECT CASE WHEN TOA >= 500 AND TOA <= 2000 THEN 'TOA1' WHEN TOA <= 5000 THEN 'TOA2' WHEN TOA <= 20000 THEN 'TOA3' END AS TOA_band, count(*) AS n FROM cases GROUP BY 1""")
def b6(t):
    return t.cases.groupBy(bands.supplied("TOA", [500, 2000, 5000, 20000], "TOA").alias("TOA_band")).agg(n_rows())


@query("b7_bands_learned_elsewhere", f"""
WITH e AS ({edges_sql('cases', 'TOA', 5, "Product='Credit card'")})
SELECT Product, cast(CASE WHEN TOA >= b[1] AND TOA <= b[len(b)] THEN greatest(len(list_filter(b, lambda x: x < TOA)),1) END as int) AS band, count(*) AS n
FROM cases, e GROUP BY 1,2""")
def b7(t):
    e = bands.edges(t.cases.filter("Product = 'Credit card'"), "TOA", 5)
    return t.cases.groupBy("Product", bands.cut("TOA", e, include_lowest=True).alias("band")).agg(n_rows())


@query("c1_z_score", """
SELECT CaseId, round((TOA-avg(TOA) OVER ())/stddev_samp(TOA) OVER (),6) AS TOA_std, round((DPD-avg(DPD) OVER ())/stddev_samp(DPD) OVER (),6) AS DPD_std FROM cases""")
def c1(t):
    d = t.cases.select("CaseId", "TOA", "DPD")
    s = bands.apply_scale(d, bands.scale_params(d, ["TOA", "DPD"]), "_std")
    return s.select("CaseId", rnd("TOA_std").alias("TOA_std"), rnd("DPD_std").alias("DPD_std"))


@query("c2_min_max", """
SELECT CaseId, round((TOA-min(TOA) OVER ())/(max(TOA) OVER ()-min(TOA) OVER ()),6) AS TOA_nrm,
 round((Principal-min(Principal) OVER ())/(max(Principal) OVER ()-min(Principal) OVER ()),6) AS Principal_nrm FROM cases""")
def c2(t):
    d = t.cases.select("CaseId", "TOA", "Principal")
    s = bands.apply_scale(d, bands.scale_params(d, ["TOA", "Principal"], "minmax"), "_nrm")
    return s.select("CaseId", rnd("TOA_nrm").alias("TOA_nrm"), rnd("Principal_nrm").alias("Principal_nrm"))


@query("c3_scaling_carried_over", """
WITH p AS (SELECT avg(TOA) AS m, stddev_samp(TOA) AS s, min(TOA) AS lo, max(TOA) AS hi FROM cases WHERE Product='Credit card'),
 q AS (SELECT min(TOA) AS lo, max(TOA) AS hi FROM cases WHERE Product='Cash loan')
SELECT CaseId, round((TOA-p.m)/p.s,6) AS z_train, round((TOA-p.lo)/(p.hi-p.lo),6) AS mm_train, round((TOA-q.lo)/(q.hi-q.lo),6) AS mm_self
FROM cases, p, q WHERE Product='Cash loan'""")
def c3(t):
    d = t.cases.select("CaseId", "TOA", "Product")
    train, test = d.filter("Product = 'Credit card'"), d.filter("Product = 'Cash loan'")
    s = bands.apply_scale(test, bands.scale_params(train, ["TOA"]), "_z")
    s = bands.apply_scale(s, bands.scale_params(train, ["TOA"], "minmax"), "_mm")
    s = bands.apply_scale(s, bands.scale_params(test, ["TOA"], "minmax"), "_self")
    return s.select("CaseId", rnd("TOA_z").alias("z_train"), rnd("TOA_mm").alias("mm_train"), rnd("TOA_self").alias("mm_self"))
