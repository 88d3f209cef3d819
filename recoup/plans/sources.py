"""Sources and sinks."""
from __future__ import annotations

from pyspark.sql import functions as F

from recoup.functions.columns import rnd
from recoup.plans.registry import query
from recoup.sources import stores


@query("s1_load_tables", """
SELECT 'cases' AS name, count(*) AS n, round(sum(TOA),2) AS total FROM cases
UNION ALL SELECT 'case_events', count(*), round(sum(PaymentAmount),2) FROM case_events""")
def s1(t):
    t.cases.createOrReplaceTempView("cases")
    t.case_events.createOrReplaceTempView("case_events")
    a = t.spark.table("cases").agg(F.count(F.lit(1)).alias("n"), rnd(F.sum("TOA"), 2).alias("total"))
    b = t.spark.table("case_events").agg(
        F.count(F.lit(1)).alias("n"), rnd(F.sum("PaymentAmount"), 2).alias("total"))
    return (a.select(F.lit("cases").alias("name"), "n", "total")
            .unionByName(b.select(F.lit("case_events").alias("name"), "n", "total")))


@query("s2_literal_table", """
SELECT Code, Pr, count(*) AS n, round(sum(TOA*Pr),2) AS weighted
FROM (VALUES ('Cash loan','CL',0.4e0),('Credit card','CC',0.6e0)) v(Product, Code, Pr)
JOIN cases USING (Product) GROUP BY Code, Pr""")
def s2(t):
    literal = t.spark.createDataFrame(
        [("Cash loan", "CL", 0.4), ("Credit card", "CC", 0.6)], "Product string, Code string, Pr double")
    return (t.cases.join(F.broadcast(literal), "Product")  # two literal rows
            .groupBy("Code", "Pr").agg(F.count(F.lit(1)).alias("n"),
                                       rnd(F.sum(F.col("TOA") * F.col("Pr")), 2).alias("weighted")))


@query("s3_write_csv", """
SELECT concat(CaseId,';',replace(cast(TOA as varchar),'.',','),';',
  coalesce(replace(cast(LastPaymentAmount as varchar),'.',','),''),';',Product) AS value FROM cases""")
def s3(t):
    path = stores.scratch(t.spark, "csv")
    stores.write_csv(t.cases.select("CaseId", "TOA", "LastPaymentAmount", "Product"), path)
    return t.spark.read.text(path).filter(~F.col("value").startswith("CaseId"))


@query("s4_read_csv", "SELECT CaseId, TOA, LastPaymentAmount, Product FROM cases")
def s4(t):
    df = t.cases.select("CaseId", "TOA", "LastPaymentAmount", "Product")
    path = stores.scratch(t.spark, "csv")
    stores.write_csv(df, path)
    return stores.read_csv(t.spark, path, df.schema)


@query("s5_columnar_round_trip", "SELECT CaseId, TOA, Age, Gender FROM cases")
def s5(t):
    return stores.round_trip(t.cases.select("CaseId", "TOA", "Age", "Gender"), "columnar")


@query("s6_saved_results", """
SELECT a.Product, a.n, b.total FROM (SELECT Product, count(*) AS n FROM cases GROUP BY 1) a
JOIN (SELECT Product, round(sum(TOA),2) AS total FROM cases GROUP BY 1) b USING (Product)""")
def s6(t):
    folder = stores.save_tables(t.spark, {
        "counts": t.cases.groupBy("Product").agg(F.count(F.lit(1)).alias("n")),
        "totals": t.cases.groupBy("Product").agg(rnd(F.sum("TOA"), 2).alias("total"))})
    a, b = (stores.load_table(t.spark, folder, n) for n in ("counts", "totals"))
    return a.join(b, "Product")


@query("s8_list_tables", """
SELECT 'cases' AS name, count(*) AS "rows", 20 AS n_columns,
 'CaseId,TOA,Principal,Interest,Other,Product,LoanAmount,D_ContractDateToImportDate,DPD,ExternalAgency,Bailiff,ClosedExecution,Age,Gender,M_LastPaymentToImportDate,LastPaymentAmount,Land,GDPPerCapita,MeanSalary,PopulationInCity' AS columns
FROM cases
UNION ALL SELECT 'case_events', count(*), 13,
 'CaseId,Month,NumberOfCalls,NumberOfCallsWithClient,NumberOfLettersSent,NumberOfVisits,NumberOfVisitsWithClient,NumberOfLettersReceived,NumberOfAgreementConcluded,NumberOfAgreementSigned,TransferToLegalProcess,NumberOfPayment,PaymentAmount'
FROM case_events""")
def s8(t):
    t.cases.createOrReplaceTempView("cases")
    t.case_events.createOrReplaceTempView("case_events")
    return stores.list_tables(t.spark, ["cases", "case_events"])
