"""Input tables: the stored base tables and the case / monthly-panel tables built on them."""
from __future__ import annotations

import hashlib
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recoup.functions.columns import cents
from recoup.functions.keys import uniform
from recoup.session import shared_dir, spread

BASE = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
        "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

_STORED: dict[tuple[str, str, str], str] = {}


def build_cases(orders: DataFrame, customer: DataFrame) -> DataFrame:
    """One row per debt."""
    k = F.col("o_orderkey")
    base = (
        orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .select(
            k.alias("CaseId"), "o_custkey", "c_nationkey", "c_acctbal", "c_mktsegment",
            cents(F.col("o_totalprice") / 10).alias("TOA"),
            (F.datediff(F.lit("2002-01-01").cast("date"), F.col("o_orderdate").cast("date")) - 100)
            .cast("int").alias("D_ContractDateToImportDate"),
        )
    )
    k = F.col("CaseId")
    toa, nat = F.col("TOA"), F.col("c_nationkey")

    def known(every: int, value):
        return F.when(k % every != 0, value)

    base = base.withColumns({
        "Principal": cents(toa * (F.lit(0.5) + F.lit(0.4) * uniform(k, "pr"))),
        "Interest": cents(toa * 0.1 * uniform(k, "in")),
        "_ba": uniform(k, "ba"),
        "_ce": uniform(k, "ce"),
        "_m": uniform(k, "m"),
        "_pop": uniform(k, "pop"),
    })
    month = F.when(F.col("_m") < 0.6, F.lit(50)).otherwise(
        (1 + F.floor((F.col("_m") - 0.6) * 90)).cast("int"))
    age = F.when(F.col("c_acctbal") < 0, F.lit(-1)).otherwise(18 + F.col("o_custkey") % 60).cast("int")
    closed = (((F.col("_ba") < 0.3) & (F.col("_ce") < 0.5)) | (F.col("_ce") < 0.002)).cast("int")
    return base.select(
        "CaseId", "TOA", "Principal", "Interest",
        known(50, toa - (F.col("Principal") + F.col("Interest"))).alias("Other"),
        F.when(F.col("c_mktsegment").isin("BUILDING", "HOUSEHOLD"), "Credit card")
        .otherwise("Cash loan").alias("Product"),
        cents(F.col("Principal") * (F.lit(0.9) + F.lit(0.6) * uniform(k, "la"))).alias("LoanAmount"),
        "D_ContractDateToImportDate",
        known(17, F.floor(F.col("D_ContractDateToImportDate") * uniform(k, "dpd")).cast("int")).alias("DPD"),
        known(23, (uniform(k, "ea") < 0.4).cast("int")).alias("ExternalAgency"),
        known(23, (F.col("_ba") < 0.3).cast("int")).alias("Bailiff"),
        known(23, closed).alias("ClosedExecution"),
        age.alias("Age"),
        F.when(F.col("c_acctbal") >= 0,
               F.when(F.col("o_custkey") % 2 == 0, "FEMALE").otherwise("MALE")).alias("Gender"),
        known(29, month).alias("M_LastPaymentToImportDate"),
        known(29, F.when(month == 50, F.lit(0.0)).otherwise(cents(F.lit(500.0) * uniform(k, "lp"))))
        .alias("LastPaymentAmount"),
        known(31, (nat + 1).cast("int")).alias("Land"),
        known(31, (F.lit(20000) + F.lit(700) * nat).cast("double")).alias("GDPPerCapita"),
        known(31, (F.lit(3000) + F.lit(40) * ((nat * 7) % 25)).cast("double")).alias("MeanSalary"),
        F.when(F.col("_pop") >= 0.3, F.floor(F.col("_pop") * 1000).cast("double") / F.lit(100.0))
        .alias("PopulationInCity"),
    )


def build_case_events(lineitem: DataFrame, cases: DataFrame) -> DataFrame:
    """Twelve rows per case; a null count means the event did not happen.

    The empty months come in as skeleton rows of the same aggregate, so the panel is
    complete after one shuffle and needs no outer join.
    """
    j = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    rate = (F.lit(0.55) - F.lit(0.4) * F.col("TOA") / F.lit(50000.0)
            + F.lit(0.1) * (F.col("Product") == "Credit card").cast("int")
            + F.lit(0.15) * F.col("Age").between(30, 50).cast("int"))
    lines = (
        lineitem.join(cases.select("CaseId", "TOA", "Product", "Age"),
                      F.col("l_orderkey") == F.col("CaseId"))
        .select(
            "CaseId", F.month("l_shipdate").cast("int").alias("Month"),
            "l_quantity", "l_returnflag", "l_linestatus",
            (uniform(j, "pay") < rate).alias("pays"), uniform(j, "sg").alias("sg"),
            cents(F.col("l_extendedprice") * (F.lit(1.0) - F.col("l_discount")) / 100).alias("amount"),
            F.lit(1).alias("line"),
        )
    )
    months = cases.select("CaseId", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("Month"))
    rows = lines.unionByName(months, allowMissingColumns=True)

    def n(cond):
        return F.nullif(F.count_if(cond), F.lit(0)).cast("bigint")

    back, full = F.col("l_returnflag"), F.col("l_linestatus")
    return rows.groupBy("CaseId", "Month").agg(
        F.nullif(F.sum("l_quantity"), F.lit(0.0)).cast("int").alias("NumberOfCalls"),
        n(back == "R").alias("NumberOfCallsWithClient"),
        n(full == "F").alias("NumberOfLettersSent"),
        n(back == "A").alias("NumberOfVisits"),
        n((back == "A") & (full == "F")).alias("NumberOfVisitsWithClient"),
        n(F.col("line") == 1).alias("NumberOfLettersReceived"),
        n(F.col("sg") < 0.3).alias("NumberOfAgreementConcluded"),
        n((F.col("sg") < 0.3) & F.col("pays")).alias("NumberOfAgreementSigned"),
        F.max(F.when(F.col("sg") > 0.97, F.lit(1))).cast("int").alias("TransferToLegalProcess"),
        n(F.col("pays")).alias("NumberOfPayment"),
        F.nullif(F.round(F.sum(F.when(F.col("pays"), F.col("amount"))), 2), F.lit(0.0)).alias("PaymentAmount"),
    )


class Tables:
    """Named access to the tables under one folder.

    ``cases`` and ``case_events`` are derived once per application and kept as parquet in the
    session's shared folder, which is what loading the two stored tables means here.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def base(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def state(self, *names: str) -> str:
        """What the files of the named tables are at the moment: their paths, sizes and times."""
        out = []
        for name in names:
            files = self.base(name).select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
            out += sorted(f"{r[0]} {r[1]} {r[2]}" for r in files.collect())  # one row per file
        return hashlib.md5("\n".join(out).encode()).hexdigest()

    def _kept(self, name: str, build, *inputs: str) -> DataFrame:
        app = self.spark.sparkContext.applicationId
        key = (app, self.sf_dir, name, self.state(*inputs))
        if key not in _STORED:
            path = os.path.join(shared_dir(self.spark), app, f"{name}-{key[-1]}-{hashlib.md5(self.sf_dir.encode()).hexdigest()[:8]}")
            build().write.mode("overwrite").parquet(path)
            _STORED[key] = path
        return self.spark.read.parquet(_STORED[key])

    @property
    def cases(self) -> DataFrame:
        return self._kept("cases", lambda: build_cases(spread(self.orders), self.customer), "orders", "customer")

    @property
    def case_events(self) -> DataFrame:
        return self._kept("case_events", lambda: build_case_events(spread(self.lineitem), self.cases), "lineitem", "orders", "customer")

    def __getattr__(self, name: str) -> DataFrame:
        if name in BASE:
            return self.base(name)
        raise AttributeError(name)
