"""SQL text of the derived input tables, for the side that checks the Spark queries."""
from __future__ import annotations


def u(key: str, salt: str) -> str:
    """Hash-uniform of a key."""
    return (f"(cast(cast('0x'||substr(md5(concat(cast({key} as varchar),'-','{salt}')),1,8) as bigint)"
            f" as double)/4294967296e0)")


def us(key: str, salt: str) -> str:
    """Hash-uniform with a salt given as an SQL expression."""
    return (f"(cast(cast('0x'||substr(md5(concat(cast({key} as varchar),'-',{salt})),1,8) as bigint)"
            f" as double)/4294967296e0)")


def boot(key: str, rep: str) -> str:
    """Bootstrap uniform of a key in replicate ``rep``: four replicates share a digest."""
    return (f"(cast(cast('0x'||substr(md5(concat(cast({key} as varchar),'-b',cast(({rep}-1)//4+1 as varchar))),"
            f"cast(8*(({rep}-1)%4)+1 as int),8) as bigint) as double)/4294967296e0)")


def un(key: str, salt: str) -> str:
    """The integer behind the hash-uniform."""
    return f"cast('0x'||substr(md5(concat(cast({key} as varchar),'-','{salt}')),1,8) as bigint)"


def md(key: str, salt: str) -> str:
    return f"md5(concat(cast({key} as varchar),'-','{salt}'))"


_K = "CaseId"

FIXTURES: dict[str, str] = {
    "cases": f"""
SELECT CaseId, TOA, Principal, Interest,
  CASE WHEN CaseId % 50 <> 0 THEN TOA - (Principal + Interest) END AS Other,
  Product, floor(Principal*(0.9e0+0.6e0*{u(_K, 'la')})*100)/100 AS LoanAmount,
  D_ContractDateToImportDate,
  CASE WHEN CaseId % 17 <> 0 THEN cast(floor(D_ContractDateToImportDate*{u(_K, 'dpd')}) as int) END AS DPD,
  CASE WHEN CaseId % 23 <> 0 THEN cast({u(_K, 'ea')} < 0.4e0 as int) END AS ExternalAgency,
  CASE WHEN CaseId % 23 <> 0 THEN cast({u(_K, 'ba')} < 0.3e0 as int) END AS Bailiff,
  CASE WHEN CaseId % 23 <> 0 THEN
    cast(({u(_K, 'ba')} < 0.3e0 AND {u(_K, 'ce')} < 0.5e0) OR {u(_K, 'ce')} < 0.002e0 as int) END AS ClosedExecution,
  cast(CASE WHEN c_acctbal < 0 THEN -1 ELSE 18 + o_custkey % 60 END as int) AS Age,
  CASE WHEN c_acctbal >= 0 THEN CASE WHEN o_custkey % 2 = 0 THEN 'FEMALE' ELSE 'MALE' END END AS Gender,
  CASE WHEN CaseId % 29 <> 0 THEN m END AS M_LastPaymentToImportDate,
  CASE WHEN CaseId % 29 <> 0 THEN
    CASE WHEN m = 50 THEN 0e0 ELSE floor(500e0*{u(_K, 'lp')}*100)/100 END END AS LastPaymentAmount,
  CASE WHEN CaseId % 31 <> 0 THEN cast(c_nationkey + 1 as int) END AS Land,
  CASE WHEN CaseId % 31 <> 0 THEN cast(20000 + 700*c_nationkey as double) END AS GDPPerCapita,
  CASE WHEN CaseId % 31 <> 0 THEN cast(3000 + 40*((c_nationkey*7) % 25) as double) END AS MeanSalary,
  CASE WHEN {u(_K, 'pop')} >= 0.3e0 THEN floor({u(_K, 'pop')}*1000)/100 END AS PopulationInCity
FROM (
  SELECT *, floor(TOA*(0.5e0+0.4e0*{u(_K, 'pr')})*100)/100 AS Principal,
    floor(TOA*0.1e0*{u(_K, 'in')}*100)/100 AS Interest,
    CASE WHEN {u(_K, 'm')} < 0.6e0 THEN 50 ELSE cast(1+floor(({u(_K, 'm')}-0.6e0)*90) as int) END AS m
  FROM (
    SELECT o_orderkey AS CaseId, o_custkey, c_nationkey, c_acctbal,
      CASE WHEN c_mktsegment IN ('BUILDING','HOUSEHOLD') THEN 'Credit card' ELSE 'Cash loan' END AS Product,
      floor(o_totalprice/10*100)/100 AS TOA,
      cast(date_diff('day', cast(o_orderdate as date), date '2002-01-01') - 100 as int) AS D_ContractDateToImportDate
    FROM orders JOIN customer ON o_custkey = c_custkey))""",
    "case_events": f"""
SELECT s.CaseId, s.Month, NumberOfCalls, NumberOfCallsWithClient, NumberOfLettersSent, NumberOfVisits,
  NumberOfVisitsWithClient, NumberOfLettersReceived, NumberOfAgreementConcluded,
  NumberOfAgreementSigned, TransferToLegalProcess, NumberOfPayment, PaymentAmount
FROM (SELECT CaseId, cast(g.m as int) AS Month FROM cases, (SELECT unnest(range(1,13)) AS m) g) s
LEFT JOIN (
  SELECT CaseId, Month, cast(nullif(sum(l_quantity),0) as int) AS NumberOfCalls,
    nullif(count(*) FILTER (l_returnflag='R'),0) AS NumberOfCallsWithClient,
    nullif(count(*) FILTER (l_linestatus='F'),0) AS NumberOfLettersSent,
    nullif(count(*) FILTER (l_returnflag='A'),0) AS NumberOfVisits,
    nullif(count(*) FILTER (l_returnflag='A' AND l_linestatus='F'),0) AS NumberOfVisitsWithClient,
    count(*) AS NumberOfLettersReceived,
    nullif(count(*) FILTER (sg < 0.3e0),0) AS NumberOfAgreementConcluded,
    nullif(count(*) FILTER (sg < 0.3e0 AND pays),0) AS NumberOfAgreementSigned,
    cast(max(CASE WHEN sg > 0.97e0 THEN 1 END) as int) AS TransferToLegalProcess,
    nullif(count(*) FILTER (pays),0) AS NumberOfPayment,
    nullif(round(sum(CASE WHEN pays THEN amount END),2),0) AS PaymentAmount
  FROM (
    SELECT CaseId, cast(month(l_shipdate) as int) AS Month, l_quantity, l_returnflag, l_linestatus,
      {u('(l_orderkey*10+l_linenumber)', 'pay')} < 0.55e0 - 0.4e0*TOA/50000e0
        + 0.1e0*cast(Product='Credit card' as int) + 0.15e0*cast(Age BETWEEN 30 AND 50 as int) AS pays,
      {u('(l_orderkey*10+l_linenumber)', 'sg')} AS sg,
      floor(l_extendedprice*(1e0-l_discount)/100*100)/100 AS amount
    FROM lineitem JOIN cases ON l_orderkey = CaseId)
  GROUP BY CaseId, Month) e USING (CaseId, Month)""",
    "verbs": """
SELECT p_partkey AS Id, p_type AS species, p_size, p_retailprice, p_brand,
  cast(1 + p_partkey % 6 as int) AS Cube, CASE WHEN p_size % 2 = 0 THEN 'O' ELSE 'R' END AS Coin
FROM part""",
    "reach": """
SELECT CaseId, cast(max(CASE WHEN coalesce(NumberOfVisitsWithClient,0) > 0
    OR coalesce(NumberOfCallsWithClient,0) > 0 THEN 1 ELSE 0 END) as int) AS Reach
FROM case_events GROUP BY CaseId""",
    "behaviour6": """
SELECT CaseId, cast(max(coalesce(TransferToLegalProcess,0)) as int) AS LegalTransfer,
  cast(CASE WHEN sum(coalesce(NumberOfAgreementSigned,0)) > 0 THEN 1 ELSE 0 END as int) AS SignedAgreement,
  CASE WHEN sum(coalesce(NumberOfCalls,0)) > 0
    THEN cast(sum(coalesce(NumberOfCallsWithClient,0)) as double)/cast(sum(NumberOfCalls) as double) ELSE 0e0 END AS Reach,
  cast(sum(coalesce(NumberOfCallsWithClient,0)) as bigint) AS NoCallClient,
  cast(sum(coalesce(NumberOfLettersReceived,0)) as bigint) AS NoLetRec,
  cast(sum(coalesce(NumberOfPayment,0)) as bigint) AS NoPay,
  sum(coalesce(PaymentAmount,0e0)) AS Pay6
FROM case_events WHERE Month <= 6 GROUP BY CaseId""",
    "pay712": """
SELECT CaseId, Pay712, ln(Pay712+1) AS Pay712log FROM (
  SELECT CaseId, greatest(sum(coalesce(PaymentAmount,0e0)),0e0) AS Pay712
  FROM case_events WHERE Month > 6 GROUP BY CaseId)""",
    "success6": """
SELECT CaseId, Payments, NoPay25, Suc0, Suc1, greatest(Suc0, Suc1) AS Suc FROM (
  SELECT CaseId, Payments, NoPay25, cast(Payments/TOA >= 0.05e0 as int) AS Suc0,
    cast(NoPay25 >= 2 as int) AS Suc1
  FROM (SELECT CaseId, sum(coalesce(PaymentAmount,0e0)) AS Payments,
      count(*) FILTER (coalesce(PaymentAmount,0e0) >= 50) AS NoPay25
    FROM case_events WHERE Month <= 6 GROUP BY CaseId) JOIN cases USING (CaseId))""",
    "agreement3": """
SELECT CaseId,
  cast(CASE WHEN max(coalesce(NumberOfAgreementConcluded,0)) > 0 THEN 1 ELSE -1 END as int) AS IfConcluded,
  cast(CASE WHEN max(coalesce(NumberOfAgreementSigned,0)) > 0 THEN 1 ELSE -1 END as int) AS IfSigned,
  sum(coalesce(PaymentAmount,0e0)) AS Payments,
  count(*) FILTER (coalesce(PaymentAmount,0e0) > 0) AS NoPay,
  cast(sum(coalesce(NumberOfCalls,0)) as bigint) AS NoCalls,
  cast(sum(coalesce(NumberOfCallsWithClient,0)) as bigint) AS NoCallsCl,
  cast(sum(coalesce(NumberOfVisits,0)) as bigint) AS NoVisits,
  cast(sum(coalesce(NumberOfVisitsWithClient,0)) as bigint) AS NoVisitsCl,
  cast(sum(coalesce(NumberOfLettersReceived,0)) as bigint) AS NoLettRec
FROM case_events WHERE Month <= 3 AND CaseId IN (
  SELECT CaseId FROM case_events WHERE Month <= 3 AND NumberOfAgreementConcluded > 0)
GROUP BY CaseId""",
    "scored": """
SELECT CaseId, TOA, Age, DPD, Product, Payments, Suc,
  0.55e0 - 0.4e0*TOA/50000e0 + 0.1e0*cast(Product='Credit card' as int)
    + 0.15e0*cast(Age BETWEEN 30 AND 50 as int) AS score
FROM cases JOIN success6 USING (CaseId)""",
    "payments": """
SELECT c.CaseId, e.Month, coalesce(e.PaymentAmount,0e0) AS Payment
FROM loans c JOIN case_events e ON e.CaseId = c.CaseId""",
    "loans": """
SELECT * FROM cases WHERE Product = 'Cash loan' AND Age > -1 AND Other IS NOT NULL AND DPD IS NOT NULL
  AND ExternalAgency IS NOT NULL AND M_LastPaymentToImportDate IS NOT NULL AND Land IS NOT NULL
  AND PopulationInCity IS NOT NULL AND Gender IS NOT NULL""",
    "series": """
SELECT l_returnflag AS series_id, row_number() OVER (PARTITION BY l_returnflag ORDER BY d) AS t, v AS value
FROM (SELECT l_returnflag, cast(l_shipdate as date) AS d, sum(l_extendedprice) AS v
  FROM lineitem GROUP BY 1, 2)""",
}
