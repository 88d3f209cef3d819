"""Running totals, order, top-k, and set operations."""
from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recoup.functions.columns import rnd
from recoup.operators import features, frame, joins, ranks
from recoup.plans.registry import query
from recoup.plans.verbs import verbs


@query("w1_running_sum", """
SELECT score, cast(sum(g) OVER (ORDER BY score DESC) as bigint) AS good, cast(sum(b) OVER (ORDER BY score DESC) as bigint) AS bad FROM (
 SELECT round(score,4) AS score, sum(Suc) AS g, sum(1-Suc) AS b FROM scored GROUP BY 1)""")
def w1(t):
    s = (features.scored(t.case_events, t.cases).groupBy(rnd("score", 4).alias("score"))
         .agg(F.sum("Suc").alias("g"), F.sum(1 - F.col("Suc")).alias("b")))
    return ranks.cumulate(s, "score", {"good": "g", "bad": "b"}, descending=True).select("score", "good", "bad")


@query("w2_running_sum_by_group", """
SELECT Product, Month, round(sum(s) OVER (PARTITION BY Product ORDER BY Month),6) AS SRcml FROM (
 SELECT Product, Month, sum(coalesce(PaymentAmount,0))/sum(TOA) AS s FROM case_events JOIN cases USING (CaseId) GROUP BY 1,2)""")
def w2(t):
    s = (t.case_events.join(t.cases.select("CaseId", "TOA", "Product"), "CaseId").groupBy("Product", "Month")
         .agg((F.sum(features.pay()) / F.sum("TOA")).alias("s")))
    w = W.partitionBy("Product").orderBy("Month").rowsBetween(W.unboundedPreceding, W.currentRow)  # 12 rows each
    return s.select("Product", "Month", rnd(F.sum("s").over(w)).alias("SRcml"))


@query("w3_share_of_total", """
SELECT score, round(sum(g) OVER (ORDER BY score DESC)/cast(sum(g) OVER () as double),6) AS GoodShare FROM (
 SELECT round(score,4) AS score, sum(Suc) AS g FROM scored GROUP BY 1)""")
def w3(t):
    s = (features.scored(t.case_events, t.cases).groupBy(rnd("score", 4).alias("score"))
         .agg(F.sum("Suc").alias("g")))
    total = s.agg(F.sum("g")).first()[0]
    return ranks.cumulate(s, "score", {"good": "g"}, descending=True).select(
        "score", rnd(F.col("good") / F.lit(float(total))).alias("GoodShare"))


@query("w4_multi_key_sort", "SELECT CaseId, Product, TOA FROM cases ORDER BY Product ASC, TOA DESC, CaseId")
def w4(t):
    return t.cases.select("CaseId", "Product", "TOA").orderBy("Product", F.desc("TOA"), "CaseId")


@query("w5_top_k", "SELECT CaseId, TOA FROM cases ORDER BY TOA DESC, CaseId LIMIT 15")
def w5(t):
    return t.cases.select("CaseId", "TOA").orderBy(F.desc("TOA"), "CaseId").limit(15)


@query("w6_time_split", """
WITH r AS (SELECT CaseId, row_number() OVER (ORDER BY D_ContractDateToImportDate, CaseId) AS pos FROM cases)
SELECT CaseId, CASE WHEN pos <= 3000 THEN 'val' ELSE 'ben' END AS part FROM r""")
def w6(t):
    p = ranks.ordered_position(t.cases.select("CaseId", "D_ContractDateToImportDate"),
                               "D_ContractDateToImportDate", "CaseId", "pos")
    return p.select("CaseId", F.when(F.col("pos") <= 3000, "val").otherwise("ben").alias("part"))


@query("w7_equal_packages", """
WITH r AS (SELECT CaseId, row_number() OVER (ORDER BY TOA, CaseId) AS pos, count(*) OVER () AS n FROM cases)
SELECT CaseId, cast(ceil(pos*10/cast(n as double)) as int) AS Pckg FROM r""")
def w7(t):
    from recoup.operators.backtest import packages
    return packages(t.cases.select("CaseId", "TOA"), 10, order="TOA").select("CaseId", "Pckg")


@query("w8_average_rank", """
SELECT CaseId, rank() OVER (ORDER BY Age) + (count(*) OVER (PARTITION BY Age) - 1)/2e0 AS AgeRank FROM cases""")
def w8(t):
    c = t.cases.select("CaseId", "Age")
    r = ranks.average_rank(c, "Age", name="AgeRank").drop("n")  # one row per distinct value
    return c.join(r, "Age").select("CaseId", "AgeRank")


@query("w9_lag_difference", """
SELECT series_id, t, round(value - lag(value) OVER (PARTITION BY series_id ORDER BY t),2) AS diff FROM series""")
def w9(t):
    s = features.series(t.lineitem)
    # Neighbouring positions meet in an equi join, so one long series is not one task.
    prev = s.select("series_id", (F.col("t") + 1).alias("t"), F.col("value").alias("before"))
    return s.join(prev, ["series_id", "t"], "left").select(
        "series_id", "t", rnd(F.col("value") - F.col("before"), 2).alias("diff"))


@query("u1_union_all", "SELECT Id, Coin FROM verbs UNION ALL SELECT Id, Coin FROM verbs WHERE Coin='O'")
def u1(t):
    v = verbs(t).select("Id", "Coin")
    return v.unionByName(v.filter("Coin = 'O'"))


@query("u2_parameter_loop", """
SELECT cast(th as double) AS threshold, count(*) FILTER (coalesce(PaymentAmount,0e0) >= th) AS hits FROM case_events,
 (SELECT unnest([25,50,100,250,500]) AS th) WHERE Month <= 6 GROUP BY 1""")
def u2(t):
    # All parameters in one pass over the data: one conditional count each, then turned to rows.
    ths = [25.0, 50.0, 100.0, 250.0, 500.0]
    one = t.case_events.filter("Month <= 6").agg(
        *[F.count_if(features.pay() >= th).alias(f"h{i}") for i, th in enumerate(ths)])
    return one.select(F.explode(F.array(*[
        F.struct(F.lit(th).alias("threshold"), F.col(f"h{i}").alias("hits")) for i, th in enumerate(ths)
    ])).alias("r")).select("r.*")


@query("u3_set_difference", """
SELECT CaseId FROM cases EXCEPT SELECT CaseId FROM case_events WHERE NumberOfPayment > 0""")
def u3(t):
    return t.cases.select("CaseId").join(
        t.case_events.filter("NumberOfPayment > 0").select("CaseId"), "CaseId", "left_anti")


@query("u4_top_overlap", """
SELECT count(*) AS overlap FROM (SELECT CaseId FROM cases ORDER BY TOA DESC, CaseId LIMIT 1000)
 JOIN (SELECT CaseId FROM cases ORDER BY LoanAmount DESC, CaseId LIMIT 1000) USING (CaseId)""")
def u4(t):
    a = t.cases.orderBy(F.desc("TOA"), "CaseId").select("CaseId").limit(1000)
    b = t.cases.orderBy(F.desc("LoanAmount"), "CaseId").select("CaseId").limit(1000)
    return a.intersect(b).agg(F.count(F.lit(1)).alias("overlap"))
