"""Projection, filters and column work."""
from __future__ import annotations

from pyspark.sql import functions as F

from recoup.functions.columns import logistic, ratio, relu, rnd, step, truncate
from recoup.operators import bands, features, frame, ranks
from recoup.plans.registry import query


def verbs(t):
    """The small table of the table-verb chapter."""
    return t.part.select(
        F.col("p_partkey").alias("Id"), F.col("p_type").alias("species"), "p_size", "p_retailprice",
        "p_brand", (1 + F.col("p_partkey") % 6).cast("int").alias("Cube"),
        F.when(F.col("p_size") % 2 == 0, "O").otherwise("R").alias("Coin"))


@query("p1_filter", """
SELECT CaseId, TOA, Product, Gender FROM cases
WHERE Gender IS NOT NULL AND Product = 'Credit card' AND (TOA < 2000 OR NOT (Age >= 30))""")
def p1(t):
    return t.cases.filter(
        F.col("Gender").isNotNull() & (F.col("Product") == "Credit card")
        & ((F.col("TOA") < 2000) | ~(F.col("Age") >= 30))).select("CaseId", "TOA", "Product", "Gender")


@query("p2_month_window", """
SELECT CaseId, Month, NumberOfPayment FROM case_events
WHERE Month > 3 AND Month <= 6 AND NumberOfPayment IS NOT NULL""")
def p2(t):
    return (t.case_events.filter("Month > 3 AND Month <= 6 AND NumberOfPayment IS NOT NULL")
            .select("CaseId", "Month", "NumberOfPayment"))


@query("p3_select_names", "SELECT species, Id FROM verbs")
def p3(t):
    return verbs(t).select(*["species", "Id"])


@query("p4_select_all_but", "SELECT * EXCLUDE (species, p_brand) FROM verbs")
def p4(t):
    return verbs(t).drop("species", "p_brand")


@query("p5_row_positions", """
SELECT 'fifth' AS part, Id, species, p_size FROM (
  SELECT *, row_number() OVER (ORDER BY p_retailprice, Id) AS rn FROM verbs) WHERE rn = 5
UNION ALL SELECT 'first30', Id, species, p_size FROM (
  SELECT *, row_number() OVER (ORDER BY Id) AS rn FROM verbs) WHERE rn <= 30""")
def p5(t):
    v = verbs(t)
    one = frame.row_at(v, ["p_retailprice", "Id"], 5)
    head = frame.first_rows(v, ["Id"], 30)
    return (one.select(F.lit("fifth").alias("part"), "Id", "species", "p_size")
            .unionByName(head.select(F.lit("first30").alias("part"), "Id", "species", "p_size")))


@query("p6_add_columns", """
SELECT Id, p_size*2 AS p_size, round(p_retailprice*p_size,4) AS W, 'G' AS X FROM verbs""")
def p6(t):
    return (verbs(t).withColumns({"W": rnd(F.col("p_retailprice") * F.col("p_size"), 4),
                                  "X": F.lit("G"), "p_size": F.col("p_size") * 2})
            .select("Id", "p_size", "W", "X"))


@query("p7_drop_columns", "SELECT Id, species, p_size, p_retailprice, p_brand FROM verbs")
def p7(t):
    return verbs(t).drop("Cube", "Coin")


@query("p8_row_id", """
SELECT CaseId, row_number() OVER (ORDER BY TOA, CaseId) AS RowId FROM cases""")
def p8(t):
    return ranks.ordered_position(t.cases.select("CaseId", "TOA"), "TOA", "CaseId", "RowId").drop("TOA")


@query("p9_conditional_update", """
SELECT CaseId, CASE WHEN r < 0 THEN 0e0 ELSE round(r,6) END AS LoanRepayment FROM (
  SELECT CaseId, CASE WHEN Product='Cash loan' THEN 1 - Principal/LoanAmount END AS r FROM cases)""")
def p9(t):
    r = F.when(F.col("Product") == "Cash loan", 1 - F.col("Principal") / F.col("LoanAmount"))
    return (t.cases.select("CaseId", r.alias("LoanRepayment"))
            .withColumn("LoanRepayment", F.when(F.col("LoanRepayment") < 0, 0.0)
                        .otherwise(rnd("LoanRepayment"))))


@query("p10_conditional_derive", """
SELECT CaseId, CASE WHEN Product='Cash loan' THEN round(1 - Principal/LoanAmount,6) END AS LoanRepayment
FROM cases""")
def p10(t):
    return t.cases.select("CaseId", F.when(
        F.col("Product") == "Cash loan",
        rnd(1 - F.col("Principal") / F.col("LoanAmount"))).alias("LoanRepayment"))


@query("p11_rename", "SELECT Id AS PartId, species AS kind, Cube FROM verbs")
def p11(t):
    return verbs(t).withColumnsRenamed({"Id": "PartId", "species": "kind"}).select("PartId", "kind", "Cube")


@query("p12_null_substitute", """
SELECT CaseId, Month, coalesce(PaymentAmount,0e0) AS PaymentAmount,
  coalesce(NumberOfCalls,0) AS NumberOfCalls FROM case_events""")
def p12(t):
    return t.case_events.select(
        "CaseId", "Month", frame.fill("PaymentAmount", 0.0).alias("PaymentAmount"),
        frame.fill("NumberOfCalls", 0).alias("NumberOfCalls"))


@query("p13_complete_cases", """
SELECT CaseId, TOA FROM cases WHERE Other IS NOT NULL AND DPD IS NOT NULL AND ExternalAgency IS NOT NULL
  AND Gender IS NOT NULL AND M_LastPaymentToImportDate IS NOT NULL AND Land IS NOT NULL
  AND PopulationInCity IS NOT NULL""")
def p13(t):
    return t.cases.dropna("any").select("CaseId", "TOA")


@query("p14_invalid_to_null", """
SELECT CaseId, CASE WHEN D_ContractDateToImportDate > 100 THEN D_ContractDateToImportDate END AS D,
  nullif(Age,-1) AS Age FROM cases""")
def p14(t):
    return t.cases.select(
        "CaseId", F.when(F.col("D_ContractDateToImportDate") > 100, F.col("D_ContractDateToImportDate")).alias("D"),
        F.nullif("Age", F.lit(-1)).alias("Age"))


@query("p15_indicators", """
SELECT CaseId, cast(Product='Credit card' as int) AS IfCard,
  CASE WHEN Gender='FEMALE' THEN 1 WHEN Gender IS NOT NULL THEN 0 END AS IfWoman,
  CASE WHEN Gender='MALE' THEN 1 WHEN Gender IS NOT NULL THEN 0 END AS IfMan FROM cases""")
def p15(t):
    return t.cases.select(
        "CaseId", (F.col("Product") == "Credit card").cast("int").alias("IfCard"),
        (F.col("Gender") == "FEMALE").cast("int").alias("IfWoman"),
        (F.col("Gender") == "MALE").cast("int").alias("IfMan"))


@query("p16_dummy_coding", """
SELECT CaseId, CASE WHEN b IS NOT NULL THEN cast(b=2 as int) END AS LstPayBand_1,
  CASE WHEN b IS NOT NULL THEN cast(b=3 as int) END AS LstPayBand_2 FROM (
  SELECT CaseId, CASE WHEN LastPaymentAmount > 0 AND LastPaymentAmount <= 50 THEN 1
    WHEN LastPaymentAmount > 50 AND LastPaymentAmount <= 300 THEN 2
    WHEN LastPaymentAmount > 300 AND LastPaymentAmount <= 60000 THEN 3 END AS b FROM cases)""")
def p16(t):
    df = t.cases.select("CaseId", bands.cut("LastPaymentAmount", bands.PAYMENT_BREAKS).alias("LstPayBand"))
    return frame.dummies(df, "LstPayBand", [1, 2, 3]).drop("LstPayBand")


@query("p17_one_hot_target", """
SELECT CaseId, cast(IfSigned=1 as int) AS IfSigned, cast(IfSigned=-1 as int) AS IfNotSigned FROM agreement3""")
def p17(t):
    return features.agreement3(t.case_events).select(
        "CaseId", (F.col("IfSigned") == 1).cast("int").alias("IfSigned"),
        (F.col("IfSigned") == -1).cast("int").alias("IfNotSigned"))


@query("p18_type_recodes", """
SELECT CaseId, cast(DPD as double) AS DPDnum, cast(Land as varchar) AS LandLevel,
  cast(CASE WHEN Other >= 0 THEN floor(Other) ELSE ceil(Other) END as int) AS OtherInt,
  cast(cast(Bailiff as varchar) as int) AS BailiffFlag FROM cases""")
def p18(t):
    return t.cases.select(
        "CaseId", F.col("DPD").cast("double").alias("DPDnum"), F.col("Land").cast("string").alias("LandLevel"),
        truncate("Other").alias("OtherInt"), F.col("Bailiff").cast("string").cast("int").alias("BailiffFlag"))


@query("p19_columns_by_name", """
SELECT CaseId, round((TOA-min(TOA) OVER ())/(max(TOA) OVER () - min(TOA) OVER ()),6) AS TOA_std,
  round((DPD-min(DPD) OVER ())/(max(DPD) OVER () - min(DPD) OVER ()),6) AS DPD_std,
  round((Age-min(Age) OVER ())/cast(max(Age) OVER () - min(Age) OVER () as double),6) AS Age_std FROM cases""")
def p19(t):
    names = ["TOA", "DPD", "Age"]
    df = t.cases.select("CaseId", *names)
    scaled = bands.apply_scale(df, bands.scale_params(df, names, "minmax"), "_std")
    return scaled.select("CaseId", *[rnd(f"{v}_std").alias(f"{v}_std") for v in names])


@query("p20_composite_key", """
SELECT Product || '_' || cast(Land as varchar) AS Key, count(*) AS n FROM cases WHERE Land IS NOT NULL GROUP BY 1""")
def p20(t):
    return (t.cases.filter("Land IS NOT NULL")
            .groupBy(F.concat_ws("_", "Product", F.col("Land").cast("string")).alias("Key"))
            .agg(F.count(F.lit(1)).alias("n")))


@query("p21_number_from_label", """
SELECT cast(k*0.05e0 as double) AS Pr, n FROM (
  SELECT greatest(cast(ceil(score/0.05e0) as int),1)-1 AS k, count(*) AS n FROM scored
  WHERE score >= 0 AND score <= 1 GROUP BY 1)""")
def p21(t):
    s = features.scored(t.case_events, t.cases).filter("score >= 0 AND score <= 1")
    low = bands.equal_width("score", 0.0, 0.05, 20) - 1
    label = F.concat(F.lit("("), (low * F.lit(0.05)).cast("string"), F.lit(","),
                     ((low + 1) * F.lit(0.05)).cast("string"), F.lit("]"))
    return (s.groupBy(label.alias("Band")).agg(F.count(F.lit(1)).alias("n"))
            .select(F.regexp_extract("Band", r"^[\[(]([^,]+),", 1).cast("double").alias("Pr"), "n"))


@query("p22_log_and_ratio", """
SELECT CaseId, round(ln(TOA),6) AS LogTOA, round(Pay712log,6) AS Pay712log,
  round(1-Principal/LoanAmount,6) AS Repayment,
  CASE WHEN NoCalls > 0 THEN round(cast(NoCallsCl as double)/NoCalls,6) ELSE 0e0 END AS PrcCallCl
FROM cases JOIN pay712 USING (CaseId) JOIN agreement3 USING (CaseId)""")
def p22(t):
    df = (t.cases.select("CaseId", "TOA", "Principal", "LoanAmount")
          .join(features.pay712(t.case_events), "CaseId").join(features.agreement3(t.case_events), "CaseId"))
    share = ratio(F.col("NoCallsCl").cast("double"), F.col("NoCalls").cast("double"))
    return df.select(
        "CaseId", rnd(F.log("TOA")).alias("LogTOA"), rnd("Pay712log").alias("Pay712log"),
        rnd(1 - F.col("Principal") / F.col("LoanAmount")).alias("Repayment"),
        F.coalesce(rnd(share), F.lit(0.0)).alias("PrcCallCl"))


@query("p23_polynomial_terms", """
WITH c AS (SELECT CaseId, TOA - avg(TOA) OVER () AS d FROM cases),
m AS (SELECT cast(count(*) as double) AS n, sum(d*d) AS s2, sum(d*d*d) AS s3 FROM c),
q AS (SELECT CaseId, d, d*d - s3/s2*d - s2/n AS e, s2 FROM c, m)
SELECT CaseId, round(d/sqrt(s2),8) AS TOA_p1, round(e/sqrt(sum(e*e) OVER ()),8) AS TOA_p2 FROM q""")
def p23(t):
    terms = frame.poly_terms(t.cases, "TOA", 2)
    return t.cases.select("CaseId", *[rnd(e, 8).alias(k) for k, e in terms.items()])


@query("p24_interaction_terms", """
SELECT CaseId, round(Reach,6) AS Reach, NoCallClient, round(Reach*NoCallClient,6) AS Reach_x_NoCallClient
FROM behaviour6""")
def p24(t):
    b = features.behaviour6(t.case_events)
    return b.select("CaseId", rnd("Reach").alias("Reach"), "NoCallClient",
                    rnd(F.col("Reach") * F.col("NoCallClient")).alias("Reach_x_NoCallClient"))


@query("p25_scalar_function", "SELECT Id, p_size + Cube + 3 AS total FROM verbs")
def p25(t):
    t.spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION add3(x INT, y INT, z INT) RETURNS INT RETURN x + y + z")
    return verbs(t).select("Id", F.expr("add3(p_size, Cube, 3)").alias("total"))


@query("p26_activations", """
WITH z AS (SELECT CaseId, (TOA - avg(TOA) OVER ())/stddev_samp(TOA) OVER () AS z FROM cases)
SELECT CaseId, round(1/(1+exp(-z)),6) AS logistic, round(tanh(z),6) AS tanh,
  cast(z >= 0 as int)::double AS step, round(greatest(z,0e0),6) AS relu FROM z""")
def p26(t):
    df = t.cases.select("CaseId", "TOA")
    z = F.col("TOA_std")
    return bands.apply_scale(df, bands.scale_params(df, ["TOA"]), "_std").select(
        "CaseId", rnd(logistic(z)).alias("logistic"), rnd(F.tanh(z)).alias("tanh"),
        step(z).alias("step"), rnd(relu(z)).alias("relu"))


@query("p27_regular_grid", """
SELECT cast(g.i as int) AS i, round(lo + (hi-lo)/100e0*g.i,4) AS TOA
FROM (SELECT min(TOA) AS lo, max(TOA) AS hi FROM cases), (SELECT unnest(range(0,101)) AS i) g""")
def p27(t):
    return frame.regular_grid(t.cases, "TOA", 101).select("i", rnd("TOA", 4).alias("TOA"))
