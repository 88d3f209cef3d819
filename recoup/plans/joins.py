"""Joins."""
from __future__ import annotations

from pyspark.sql import functions as F

from recoup.functions.columns import rnd
from recoup.operators import bands, features, joins, ranks
from recoup.plans.fixture_sql import md
from recoup.plans.registry import query
from recoup.plans.verbs import verbs


@query("j1_keyed_join", """
SELECT CaseId, Month, TOA, PaymentAmount FROM case_events LEFT JOIN cases USING (CaseId)""")
def j1(t):
    return joins.keyed(t.cases.select("CaseId", "TOA"),
                       t.case_events.select("CaseId", "Month", "PaymentAmount"), ["CaseId"])


@query("j2_inner_join", """
SELECT c.CaseId, c.Product, r.Reach FROM cases c JOIN reach r ON c.CaseId = r.CaseId WHERE c.TOA < 65000""")
def j2(t):
    return (t.cases.filter("TOA < 65000").select("CaseId", "Product")
            .join(features.reach(t.case_events), "CaseId", "inner"))


@query("j3_left_join_prefixed", """
SELECT y.Coin, x.Id, x.n, y.Id AS i_Id FROM (
  SELECT Id, CASE WHEN Id = 1 THEN 'K' ELSE Coin END AS Coin FROM verbs) y
LEFT JOIN (SELECT Coin, min(Id) AS Id, count(*) AS n FROM verbs GROUP BY Coin) x ON x.Coin = y.Coin""")
def j3(t):
    v = verbs(t)
    y = v.select("Id", F.when(F.col("Id") == 1, "K").otherwise(F.col("Coin")).alias("Coin"))
    x = v.groupBy("Coin").agg(F.min("Id").alias("Id"), F.count(F.lit(1)).alias("n"))
    return joins.keyed(x, y, ["Coin"])


@query("j4_many_to_many", """
SELECT p.CaseId, p.Month AS PayMonth, c.Month AS CallMonth
FROM case_events p JOIN case_events c ON p.CaseId = c.CaseId
WHERE p.NumberOfPayment > 0 AND c.NumberOfCallsWithClient > 0""")
def j4(t):
    paid = t.case_events.filter("NumberOfPayment > 0").select("CaseId", F.col("Month").alias("PayMonth"))
    called = (t.case_events.filter("NumberOfCallsWithClient > 0")
              .select("CaseId", F.col("Month").alias("CallMonth")))
    return joins.guarded(paid, called, ["CaseId"], allow_cartesian=True)


@query("j5_join_guard", """
SELECT cast(sum(nx*ny) as bigint) AS joined, cast(any_value(tx) as bigint) AS left_rows,
  cast(any_value(ty) as bigint) AS right_rows
FROM (SELECT Land, count(*) AS nx FROM cases GROUP BY 1)
JOIN (SELECT Land, count(*) AS ny FROM cases WHERE Product='Credit card' GROUP BY 1) USING (Land),
 (SELECT count(*) AS tx FROM cases), (SELECT count(*) AS ty FROM cases WHERE Product='Credit card')""")
def j5(t):
    y = t.cases.filter("Product = 'Credit card'")
    rows = joins.join_size(t.cases, y, ["Land"])
    return t.cases.agg(F.lit(rows).cast("bigint").alias("joined"), F.count(F.lit(1)).alias("left_rows"),
                       F.count_if(F.col("Product") == "Credit card").alias("right_rows"))


@query("j6_interval_join", """
SELECT c.CaseId, y.Land AS BandLand, y.Product AS BandProduct
FROM cases c JOIN (SELECT Land, Product, round(quantile_cont(TOA,0.4),2) AS lo, round(quantile_cont(TOA,0.5),2) AS hi
  FROM cases WHERE Land IS NOT NULL GROUP BY 1,2) y ON c.Principal <= y.hi AND y.lo <= c.TOA""")
def j6(t):
    q = ranks.exact_quantiles(t.cases.filter("Land IS NOT NULL"), ["TOA"], [0.4, 0.5], ["Land", "Product"])
    y = q.groupBy(F.col("Land").alias("BandLand"), F.col("Product").alias("BandProduct")).agg(
        rnd(F.max(F.when(F.col("p") == 0.4, F.col("q"))), 2).alias("lo"),
        rnd(F.max(F.when(F.col("p") == 0.5, F.col("q"))), 2).alias("hi"))
    x = t.cases.select("CaseId", "Principal", "TOA")
    return joins.overlap(x, y, "CaseId", "Principal", "TOA", "lo", "hi").select(
        "CaseId", "BandLand", "BandProduct")


@query("j7_look_back", """
SELECT e.CaseId, e.Month, f.PaymentAfterCWC FROM case_events e LEFT JOIN (
  SELECT p.CaseId, p.Month, CASE WHEN sum(x.NumberOfCallsWithClient) > 0 THEN 1 ELSE 0 END AS PaymentAfterCWC
  FROM case_events p JOIN case_events x ON x.CaseId = p.CaseId AND p.Month - x.Month <= 2 AND x.Month <= p.Month
  WHERE p.NumberOfPayment > 0 GROUP BY 1,2) f ON e.CaseId = f.CaseId AND e.Month = f.Month""")
def j7(t):
    return joins.look_back(
        t.case_events.select("CaseId", "Month", "NumberOfPayment", "NumberOfCallsWithClient"),
        "CaseId", "Month", F.col("NumberOfPayment") > 0, "NumberOfCallsWithClient", 2,
        "PaymentAfterCWC").select("CaseId", "Month", "PaymentAfterCWC")


@query("j8_feature_target_join", """
SELECT CaseId, TOA, NoPay, round(Pay712,2) AS Pay712 FROM cases JOIN behaviour6 USING (CaseId) JOIN pay712 USING (CaseId)
WHERE Age <> -1 AND TOA >= 100 AND DPD >= 100 AND LastPaymentAmount > 0""")
def j8(t):
    c = t.cases.filter("Age <> -1 AND TOA >= 100 AND DPD >= 100 AND LastPaymentAmount > 0").select("CaseId", "TOA")
    return (c.join(features.behaviour6(t.case_events).select("CaseId", "NoPay"), "CaseId")
            .join(features.pay712(t.case_events).select("CaseId", rnd("Pay712", 2).alias("Pay712")), "CaseId"))


@query("j9_semi_join", """
SELECT CaseId, Month, NumberOfAgreementSigned FROM case_events WHERE Month <= 3 AND CaseId IN (
  SELECT CaseId FROM case_events WHERE Month <= 3 AND NumberOfAgreementConcluded > 0)""")
def j9(t):
    e = t.case_events.filter("Month <= 3")
    ids = e.filter("NumberOfAgreementConcluded > 0").select("CaseId")
    return e.join(ids, "CaseId", "left_semi").select("CaseId", "Month", "NumberOfAgreementSigned")


@query("j10_anti_join", f"""
SELECT CaseId, TOA FROM cases WHERE CaseId NOT IN (
  SELECT CaseId FROM cases ORDER BY {md('CaseId', 'val')}, CaseId LIMIT 1000)""")
def j10(t):
    c = t.cases.select("CaseId", "TOA")
    return c.join(ranks.smallest(c, "CaseId", "val", 1000).select("CaseId"), "CaseId", "left_anti")


@query("j11_parameter_grid", """
SELECT Product, depth, rate FROM (SELECT DISTINCT Product FROM cases),
 (SELECT unnest([2,3,4,5]) AS depth), (SELECT unnest([0.01e0,0.05e0,0.1e0]) AS rate)""")
def j11(t):
    return joins.parameter_grid(t.cases.select("Product").distinct(), depth=[2, 3, 4, 5], rate=[0.01, 0.05, 0.1])


@query("j12_full_outer_shares", """
SELECT coalesce(a.M,b.M) AS M, coalesce(round(a.s,6),0e0) AS Trn, coalesce(round(b.s,6),0e0) AS Tst FROM
 (SELECT M_LastPaymentToImportDate AS M, count(*)/cast((SELECT count(*) FROM cases WHERE Product='Cash loan' AND M_LastPaymentToImportDate IS NOT NULL) as double) AS s
  FROM cases WHERE Product='Cash loan' AND M_LastPaymentToImportDate IS NOT NULL GROUP BY 1) a FULL JOIN
 (SELECT M_LastPaymentToImportDate AS M, count(*)/cast((SELECT count(*) FROM cases WHERE TOA < 500 AND M_LastPaymentToImportDate IS NOT NULL) as double) AS s
  FROM cases WHERE TOA < 500 AND M_LastPaymentToImportDate IS NOT NULL GROUP BY 1) b ON a.M = b.M""")
def j12(t):
    def shares(df, name):
        df = df.filter("M_LastPaymentToImportDate IS NOT NULL")
        n = df.count()
        return df.groupBy(F.col("M_LastPaymentToImportDate").alias("M")).agg(
            rnd(F.count(F.lit(1)) / F.lit(float(max(n, 1)))).alias(name))
    return joins.outer_shares(shares(t.cases.filter("Product = 'Cash loan'"), "Trn"),
                              shares(t.cases.filter("TOA < 500"), "Tst"), ["M"], "Trn", "Tst")


@query("j13_group_statistic", """
SELECT CaseId, round(avg(GDPPerCapita) OVER (PARTITION BY Product, Gender),4) AS GDP FROM cases""")
def j13(t):
    stat = (t.cases.groupBy("Product", "Gender").agg(rnd(F.avg("GDPPerCapita"), 4).alias("GDP"))
            .withColumnsRenamed({"Product": "p", "Gender": "g"}))
    c = t.cases.select("CaseId", "Product", "Gender")
    return c.join(joins.sized(stat), c["Product"].eqNullSafe(stat["p"]) & c["Gender"].eqNullSafe(stat["g"])
                  ).select("CaseId", "GDP")


@query("j14_fetch_by_keys", f"""
WITH r AS (SELECT CaseId, TOA, row_number() OVER (ORDER BY {md('CaseId', 'pos')}, CaseId) AS pos FROM cases),
n AS (SELECT count(*) AS n FROM cases),
d AS (SELECT i AS draw, 1 + cast('0x'||substr(md5(concat(cast(i as varchar),'-draw')),1,15) as bigint) % (SELECT n FROM n) AS pos
  FROM (SELECT unnest(range(1, (SELECT n FROM n)+1)) AS i))
SELECT draw, CaseId, TOA FROM d JOIN r USING (pos)""")
def j14(t):
    from recoup.operators.sampling import fetch_draws
    return fetch_draws(t.cases.select("CaseId", "TOA"), "CaseId").select("draw", "CaseId", "TOA")


@query("j15_score_lookup", """
WITH trn AS (SELECT * FROM scored WHERE Product='Cash loan'),
e AS (SELECT list_sort(list_distinct(quantile_cont(score,[0,0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9,1.0]))) AS b FROM trn),
bt AS (SELECT band, min(score) AS lo, sum(Payments)/sum(TOA) AS sr FROM (
  SELECT *, greatest(len(list_filter(b, lambda x: x < score)),1) AS band FROM trn, e) GROUP BY band),
br AS (SELECT band, sr, row_number() OVER (ORDER BY lo) AS k, lead(lo) OVER (ORDER BY lo) AS nxt, lo FROM bt)
SELECT CaseId, cast(band as int) AS band, round(sr,6) AS predSR FROM scored s JOIN br
 ON (br.k = 1 OR s.score >= br.lo) AND (br.nxt IS NULL OR s.score < br.nxt) WHERE Product='Credit card'""")
def j15(t):
    from recoup.operators.evaluate import score_bands
    s = features.scored(t.case_events, t.cases)
    table, place = score_bands(s.filter("Product = 'Cash loan'"), "score", "Payments", "TOA", "Suc", 10)
    return place(s.filter("Product = 'Credit card'")).select("CaseId", "band", rnd("predSR").alias("predSR"))


@query("j16_band_transfer", """
WITH e AS (SELECT list_sort(list_distinct(quantile_cont(TOA,[0,0.2,0.4,0.6,0.8,1.0]))) AS b FROM cases WHERE Product='Cash loan'),
bt AS (SELECT greatest(len(list_filter(b, lambda x: x < TOA)),1) AS band, min(TOA) AS lo, max(TOA) AS hi
  FROM cases, e WHERE Product='Cash loan' GROUP BY 1),
br AS (SELECT band, (hi + lead(lo) OVER (ORDER BY lo))/2 AS bound, (lag(hi) OVER (ORDER BY lo) + lo)/2 AS prev FROM bt)
SELECT CaseId, cast(band as int) AS band FROM cases c JOIN br ON (prev IS NULL OR c.TOA >= prev) AND (bound IS NULL OR c.TOA < bound)
WHERE Product='Credit card'""")
def j16(t):
    trn = bands.quantile_band(t.cases.filter("Product = 'Cash loan'").select("CaseId", "TOA"), "TOA", 5, "band")
    return t.cases.filter("Product = 'Credit card'").select(
        "CaseId", bands.lookup("TOA", bands.band_bounds(trn, "TOA", "band")).cast("int").alias("band"))


@query("j17_by_month_comparison", """
SELECT a.Month, round(a.s,6) AS SRcard, round(b.s,6) AS SRloan, round(c.s,6) AS SRall FROM
 (SELECT Month, sum(coalesce(PaymentAmount,0))/sum(TOA) AS s FROM case_events JOIN cases USING (CaseId) WHERE Product='Credit card' GROUP BY 1) a
 JOIN (SELECT Month, sum(coalesce(PaymentAmount,0))/sum(TOA) AS s FROM case_events JOIN cases USING (CaseId) WHERE Product='Cash loan' GROUP BY 1) b USING (Month)
 JOIN (SELECT Month, sum(coalesce(PaymentAmount,0))/sum(TOA) AS s FROM case_events JOIN cases USING (CaseId) GROUP BY 1) c USING (Month)""")
def j17(t):
    joined = t.case_events.select("CaseId", "Month", features.pay().alias("Payment")).join(
        t.cases.select("CaseId", "TOA", "Product"), "CaseId")
    # One pass gives both sums per product; the three curves are then joined as 12-row tables.
    per = joined.groupBy("Month", "Product").agg(F.sum("Payment").alias("P"), F.sum("TOA").alias("T"))

    def curve(cond, name):
        return per.filter(cond).groupBy("Month").agg(rnd(F.sum("P") / F.sum("T")).alias(name))
    return (curve("Product = 'Credit card'", "SRcard").join(curve("Product = 'Cash loan'", "SRloan"), "Month")
            .join(curve("true", "SRall"), "Month"))
