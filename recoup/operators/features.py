"""Targets and behavioural features read from the monthly panel."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recoup.functions.columns import ratio

EVENT_COUNTS = ["NumberOfCalls", "NumberOfCallsWithClient", "NumberOfLettersSent", "NumberOfVisits",
                "NumberOfVisitsWithClient", "NumberOfLettersReceived", "NumberOfAgreementConcluded",
                "NumberOfAgreementSigned", "TransferToLegalProcess", "NumberOfPayment"]


def zero(name: str):
    """In the panel a null count means the event did not happen."""
    return F.coalesce(F.col(name), F.lit(0))


def pay():
    return F.coalesce(F.col("PaymentAmount"), F.lit(0.0))


def reach(panel: DataFrame) -> DataFrame:
    hit = (zero("NumberOfVisitsWithClient") > 0) | (zero("NumberOfCallsWithClient") > 0)
    return panel.groupBy("CaseId").agg(F.max(hit.cast("int")).alias("Reach"))


def behaviour6(panel: DataFrame) -> DataFrame:
    calls, client = F.sum(zero("NumberOfCalls")), F.sum(zero("NumberOfCallsWithClient"))
    return panel.filter("Month <= 6").groupBy("CaseId").agg(
        F.max(zero("TransferToLegalProcess")).cast("int").alias("LegalTransfer"),
        (F.sum(zero("NumberOfAgreementSigned")) > 0).cast("int").alias("SignedAgreement"),
        F.coalesce(ratio(client.cast("double"), calls.cast("double")), F.lit(0.0)).alias("Reach"),
        client.cast("bigint").alias("NoCallClient"),
        F.sum(zero("NumberOfLettersReceived")).cast("bigint").alias("NoLetRec"),
        F.sum(zero("NumberOfPayment")).cast("bigint").alias("NoPay"),
        F.sum(pay()).alias("Pay6"),
    )


def pay712(panel: DataFrame) -> DataFrame:
    return (
        panel.filter("Month > 6").groupBy("CaseId")
        .agg(F.greatest(F.sum(pay()), F.lit(0.0)).alias("Pay712"))
        .withColumn("Pay712log", F.log(F.col("Pay712") + 1))
    )


def success6(panel: DataFrame, cases: DataFrame, threshold: float = 50.0) -> DataFrame:
    paid = panel.filter("Month <= 6").groupBy("CaseId").agg(
        F.sum(pay()).alias("Payments"), F.count_if(pay() >= threshold).alias("NoPay25"))
    return (
        paid.join(cases.select("CaseId", "TOA"), "CaseId")
        .select("CaseId", "Payments", "NoPay25",
                (F.col("Payments") / F.col("TOA") >= 0.05).cast("int").alias("Suc0"),
                (F.col("NoPay25") >= 2).cast("int").alias("Suc1"))
        .withColumn("Suc", F.greatest("Suc0", "Suc1"))
    )


def agreement3(panel: DataFrame) -> DataFrame:
    """First-quarter behaviour of the cases that were offered an agreement.

    The offer test is a group condition, so one aggregate replaces the key list and semi join.
    """
    def flag(name):
        return F.when(F.max(zero(name)) > 0, 1).otherwise(-1).cast("int")

    def total(name):
        return F.sum(zero(name)).cast("bigint")

    return panel.filter("Month <= 3").groupBy("CaseId").agg(
        flag("NumberOfAgreementConcluded").alias("IfConcluded"),
        flag("NumberOfAgreementSigned").alias("IfSigned"),
        F.sum(pay()).alias("Payments"),
        F.count_if(pay() > 0).alias("NoPay"),
        total("NumberOfCalls").alias("NoCalls"),
        total("NumberOfCallsWithClient").alias("NoCallsCl"),
        total("NumberOfVisits").alias("NoVisits"),
        total("NumberOfVisitsWithClient").alias("NoVisitsCl"),
        total("NumberOfLettersReceived").alias("NoLettRec"),
    ).filter("IfConcluded = 1")


def scored(panel: DataFrame, cases: DataFrame) -> DataFrame:
    """A deterministic score and the success target, for the evaluation operators."""
    s = (F.lit(0.55) - F.lit(0.4) * F.col("TOA") / F.lit(50000.0)
         + F.lit(0.1) * (F.col("Product") == "Credit card").cast("int")
         + F.lit(0.15) * F.col("Age").between(30, 50).cast("int"))
    return (
        cases.select("CaseId", "TOA", "Age", "DPD", "Product", s.alias("score"))
        .join(success6(panel, cases).select("CaseId", "Payments", "Suc"), "CaseId")
    )


def loans(cases: DataFrame) -> DataFrame:
    """Complete cash loans of natural persons."""
    return cases.filter("Product = 'Cash loan' AND Age > -1").dropna("any")


def payments(panel: DataFrame, cases: DataFrame) -> DataFrame:
    return (
        panel.join(cases.select("CaseId"), "CaseId")
        .select("CaseId", "Month", pay().alias("Payment"))
    )


def series(lineitem: DataFrame) -> DataFrame:
    """Daily totals per return flag; the day number restarts in each series."""
    from pyspark.sql import Window as W

    daily = lineitem.groupBy(F.col("l_returnflag").alias("series_id"),
                             F.col("l_shipdate").cast("date").alias("day")).agg(
        F.sum("l_extendedprice").alias("value"))
    w = W.partitionBy("series_id").orderBy("day")
    return daily.select("series_id", F.row_number().over(w).cast("bigint").alias("t"), "value")
