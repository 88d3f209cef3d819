"""Scoring, evaluation, weight of evidence."""
from __future__ import annotations

from pyspark.sql import functions as F

from recoup.functions.columns import n_rows, rnd
from recoup.operators import evaluate, features
from recoup.plans.bands import edges_sql
from recoup.plans.registry import query


def scored(t):
    return features.scored(t.case_events, t.cases)


PRED = "p AS (SELECT *, cast(score > (SELECT avg(Suc) FROM scored) as int) AS pred FROM scored)"


def predicted(t):
    s = scored(t)
    return s.withColumn("pred", (F.col("score") > F.lit(evaluate.prior(s, "Suc"))).cast("int"))


@query("e1_confusion_matrix", f"WITH {PRED} SELECT Suc AS actual, count(*) FILTER (pred=1) AS pred_1, count(*) FILTER (pred=0) AS pred_0 FROM p GROUP BY 1")
def e1(t):
    return predicted(t).groupBy(F.col("Suc").alias("actual")).agg(
        F.count_if(F.col("pred") == 1).alias("pred_1"), F.count_if(F.col("pred") == 0).alias("pred_0"))


@query("e2_accuracy", f"WITH {PRED} SELECT round(avg(cast(Suc=pred as int)),6) AS accuracy, round(1-avg(cast(Suc=pred as int)),6) AS error FROM p")
def e2(t):
    a = F.avg((F.col("Suc") == F.col("pred")).cast("double"))
    return predicted(t).agg(rnd(a).alias("accuracy"), rnd(1 - a).alias("error"))


@query("e3_sensitivity_specificity", f"""
WITH {PRED} SELECT count(*) FILTER (Suc=1 AND pred=1) AS tp, count(*) FILTER (Suc=1 AND pred=0) AS fn, count(*) FILTER (Suc=0 AND pred=1) AS fp,
 count(*) FILTER (Suc=0 AND pred=0) AS tn, round(avg(cast(Suc=pred as int)),6) AS accuracy, round(avg(pred) FILTER (Suc=1),6) AS sensitivity,
 round(avg(1-pred) FILTER (Suc=0),6) AS specificity, round(avg(Suc) FILTER (pred=1),6) AS precision FROM p""")
def e3(t):
    c = evaluate.confusion(predicted(t), "Suc", "pred")
    return c.withColumns({k: rnd(k) for k in ("accuracy", "sensitivity", "specificity", "precision")})


@query("e4_impurity", """
SELECT Product, round(sum(p*(1-p)),6) AS gini, round(-sum(p*log2(p)),6) AS entropy FROM (
 SELECT Product, Gender, count(*)/cast(sum(count(*)) OVER (PARTITION BY Product) as double) AS p FROM cases WHERE Gender IS NOT NULL GROUP BY 1,2) GROUP BY 1""")
def e4(t):
    c = t.cases.filter("Gender IS NOT NULL").groupBy("Product", "Gender").agg(n_rows())
    total = c.groupBy("Product").agg(F.sum("n").alias("m"))  # one row per product
    p = F.col("n") / F.col("m")
    return c.join(total, "Product").groupBy("Product").agg(
        rnd(F.sum(p * (1 - p))).alias("gini"), rnd(-F.sum(p * F.log2(p))).alias("entropy"))


@query("e5_prior_threshold", f"WITH {PRED} SELECT CaseId, pred FROM p")
def e5(t):
    return predicted(t).select("CaseId", "pred")


@query("e6_roc_points", """
WITH s AS (SELECT score, sum(Suc) AS g, count(*)-sum(Suc) AS b FROM scored GROUP BY 1)
SELECT round(score,6) AS score, round(sum(g) OVER (ORDER BY score DESC)/cast(sum(g) OVER () as double),6) AS tpr, round(sum(b) OVER (ORDER BY score DESC)/cast(sum(b) OVER () as double),6) AS fpr FROM s""")
def e6(t):
    r = evaluate.roc(scored(t), "score", "Suc")
    return r.select(*[rnd(c).alias(c) for c in r.columns])


@query("e7_auc_gini", """
SELECT round(a,6) AS auc, round(2*a-1,6) AS gini FROM (SELECT (sum(r) FILTER (Suc=1) - g*(g+1)/2e0)/(g*(n-g)) AS a FROM (
 SELECT Suc, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score)-1)/2e0 AS r, cast(sum(Suc) OVER () as double) AS g, cast(count(*) OVER () as double) AS n FROM scored) GROUP BY g, n)""")
def e7(t):
    a = evaluate.auc(scored(t), "score", "Suc")
    return a.select(rnd("auc").alias("auc"), rnd("gini").alias("gini"))


def shares_sql(band):
    return f"""SELECT {band} AS band, round(sum(Suc)/cast((SELECT sum(Suc) FROM scored) as double),6) AS PrGood,
 round((count(*)-sum(Suc))/cast((SELECT count(*)-sum(Suc) FROM scored) as double),6) AS PrBad FROM scored"""


BAND = "cast(greatest(len(list_filter(b, lambda z: z < score)),1) as int)"


@query("e8_separation_fixed", shares_sql("cast(CASE WHEN score >= 0 AND greatest(ceil(score/0.05e0),1) <= 20 THEN greatest(ceil(score/0.05e0),1) END as int)") + " GROUP BY 1")
def e8(t):
    r = evaluate.separation_fixed(scored(t), "score", "Suc")
    return r.withColumns({"PrGood": rnd("PrGood"), "PrBad": rnd("PrBad")})


@query("e9_separation_quantile", shares_sql(BAND) + f", ({edges_sql('scored', 'score', 10)}) GROUP BY 1")
def e9(t):
    r = evaluate.separation(scored(t), "score", "Suc", 10)
    return r.withColumns({"PrGood": rnd("PrGood"), "PrBad": rnd("PrBad")})


CAL = f"c AS (SELECT {BAND} AS band, sum(Suc)::double AS og, count(*)::double AS n, sum(score) AS eg FROM scored, ({edges_sql('scored', 'score', 10)}) GROUP BY 1)"


@query("e10_calibration", f"""
WITH {CAL} SELECT band, round(og/(SELECT count(*) FROM scored),6) AS share_of_total, round(og/n,6) AS rate_in_band, og AS ObsGood, n-og AS ObsBad,
 round(eg,4) AS ExpGood, round(n-eg,4) AS ExpBad FROM c""")
def e10(t):
    r = evaluate.calibration(scored(t), "score", "Suc", 10)
    return r.withColumns({"share_of_total": rnd("share_of_total"), "rate_in_band": rnd("rate_in_band"),
                          "ExpGood": rnd("ExpGood", 4), "ExpBad": rnd("ExpBad", 4)})


@query("e10_hosmer_lemeshow", f"WITH {CAL} SELECT round(sum(pow(og-eg,2)/eg + pow(n-og-(n-eg),2)/(n-eg)),4) AS HL, 9 AS df FROM c")
def e10b(t):
    h = evaluate.hosmer_lemeshow(scored(t), "score", "Suc", 10)
    return t.spark.createDataFrame([(round(h["HL"], 4), h["df"])], "HL double, df int")


WOE = f"""e AS ({edges_sql('scored', 'TOA', 7)}), w AS (SELECT cast(greatest(len(list_filter(b, lambda z: z < TOA)),1) as int) AS band, count(*) AS n,
 ln(((sum(Suc)+0.5e0)/(SELECT sum(Suc) FROM scored))/((count(*)-sum(Suc)+0.5e0)/(SELECT count(*)-sum(Suc) FROM scored))) AS WoE,
 (sum(Suc)+0.5e0)/(SELECT sum(Suc) FROM scored) - (count(*)-sum(Suc)+0.5e0)/(SELECT count(*)-sum(Suc) FROM scored) AS Diff FROM scored, e GROUP BY 1)"""


@query("e11_weight_of_evidence", f"WITH {WOE} SELECT band, n, round(WoE,6) AS WoE, round(Diff,6) AS Diff FROM w")
def e11(t):
    w, _ = evaluate.woe_table(scored(t), "TOA", "Suc", 7)
    return w.withColumns({"WoE": rnd("WoE"), "Diff": rnd("Diff")})


@query("e11_information_value", f"WITH {WOE} SELECT round(sum(Diff*WoE),6) AS IV FROM w")
def e11b(t):
    w, _ = evaluate.woe_table(scored(t), "TOA", "Suc", 7)
    return evaluate.information_value(w).select(rnd("IV").alias("IV"))


@query("e11_woe_column", f"""
WITH {WOE} SELECT CaseId, round(WoE,6) AS TOA_WoE FROM (SELECT CaseId, cast(greatest(len(list_filter(b, lambda z: z < TOA)),1) as int) AS band FROM scored, e) JOIN w USING (band)""")
def e11c(t):
    return evaluate.add_woe(scored(t), "TOA", "Suc", 7).select("CaseId", rnd("TOA_WoE").alias("TOA_WoE"))


@query("e12_woe_merge", f"""
WITH {WOE}, r AS (SELECT CaseId, TOA, WoE FROM (SELECT CaseId, TOA, cast(greatest(len(list_filter(b, lambda z: z < TOA)),1) as int) AS band FROM scored, e) JOIN w USING (band))
SELECT CaseId, round(CASE WHEN WoE < 0 AND TOA >= 5744 THEN (SELECT avg(WoE) FROM r WHERE WoE < 0 AND TOA >= 5744) ELSE WoE END,6) AS TOA_WoE FROM r""")
def e12(t):
    w = evaluate.add_woe(scored(t), "TOA", "Suc", 7)
    m = evaluate.merge_bands(w, "TOA_WoE", (F.col("TOA_WoE") < 0) & (F.col("TOA") >= 5744))
    return m.select("CaseId", rnd("TOA_WoE").alias("TOA_WoE"))


@query("e13_shape_table", f"""
SELECT cast(greatest(len(list_filter(b, lambda z: z < TOA)),1) as int) AS band, round(sum(Suc)/cast((SELECT count(*) FROM scored) as double),6) AS share_of_total,
 round(avg(Suc),6) AS rate_in_band, round(CASE WHEN sum(Suc) > 0 AND sum(Suc) < count(*) THEN ln(sum(Suc)/cast(count(*)-sum(Suc) as double)) END,6) AS logit
FROM scored, ({edges_sql('scored', 'TOA', 7)}) GROUP BY 1""")
def e13(t):
    s = evaluate.shape(scored(t), "TOA", "Suc", 7)
    return s.select("band", *[rnd(c).alias(c) for c in ("share_of_total", "rate_in_band", "logit")])


PLACED = f"""trn AS (SELECT * FROM scored WHERE Product='Cash loan'), e AS ({edges_sql('trn', 'score', 10)}),
bt AS (SELECT {BAND} AS band, min(score) AS lo, sum(Payments)/sum(TOA) AS sr, avg(Suc) AS ss FROM trn, e GROUP BY 1),
br AS (SELECT *, row_number() OVER (ORDER BY lo) AS k, lead(lo) OVER (ORDER BY lo) AS nxt FROM bt),
pl AS (SELECT s.*, band, sr, ss FROM scored s JOIN br ON (k = 1 OR s.score >= lo) AND (nxt IS NULL OR s.score < nxt) WHERE Product='Credit card')"""


@query("e14_recovery_prediction", f"""
WITH {PLACED} SELECT band, round(sr,6) AS predSR, round(ss,6) AS predSR_Suc, count(*) AS N, round(sum(Payments)/sum(TOA),6) AS SR, round(avg(Suc),6) AS SR_Suc, round(min(score),6) AS Min FROM pl GROUP BY band, sr, ss""")
def e14(t):
    s = scored(t)
    table, _ = evaluate.recovery_prediction(s.filter("Product = 'Cash loan'"), s.filter("Product = 'Credit card'"),
                                            "score", "Payments", "TOA", "Suc", 10)
    return table.select("band", "N", *[rnd(c).alias(c) for c in ("predSR", "predSR_Suc", "SR", "SR_Suc", "Min")])


@query("e14_recovery_deviation", f"""
WITH {PLACED} SELECT round((sum(Payments)/sum(TOA) - sum(sr*TOA)/sum(TOA))/(sum(Payments)/sum(TOA)),6) AS srDev FROM pl""")
def e14b(t):
    s = scored(t)
    _, dev = evaluate.recovery_prediction(s.filter("Product = 'Cash loan'"), s.filter("Product = 'Credit card'"),
                                          "score", "Payments", "TOA", "Suc", 10)
    return dev.select(rnd("srDev").alias("srDev"))
