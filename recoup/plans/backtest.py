"""Portfolio back-test."""
from __future__ import annotations

from pyspark.sql import functions as F

from recoup.functions.columns import rnd
from recoup.functions.keys import uniform
from recoup.operators import backtest, components, features
from recoup.plans.fixture_sql import boot, md, u
from recoup.plans.registry import query
from recoup.plans.sampling import poisson_sql

B = 101
QS = {"Q05": 0.05, "Q10": 0.1, "Q25": 0.25, "Q50": 0.5, "Q75": 0.75, "Q90": 0.9, "Q95": 0.95}


def setup(t):
    """Complete cash loans and their payments."""
    loans = features.loans(t.cases)
    return loans, features.payments(t.case_events, loans)


def size(loans) -> int:
    """Three tenths of the loans are valued, in ten packages."""
    return loans.count() * 3 // 10


def random_sets(t):
    loans, pay = setup(t)
    val, ben = backtest.random_split(loans, size(loans), 10)
    return pay, val, ben


def age_sets(t):
    loans, pay = setup(t)
    val, ben = backtest.age_split(loans, size(loans), 10)
    return pay, val, ben


VAL = f"""n AS (SELECT count(*)*3//10 AS n FROM loans),
vr AS (SELECT CaseId, row_number() OVER (ORDER BY {md('CaseId', 'val')}, CaseId) AS i FROM loans),
vs AS (SELECT l.* FROM loans l JOIN vr USING (CaseId) WHERE i <= (SELECT n FROM n)),
val AS (SELECT *, cast(ceil(row_number() OVER (ORDER BY {md('CaseId', 'pckg')}, CaseId)*10/cast((SELECT n FROM n) as double)) as int) AS Pckg FROM vs),
ben AS (SELECT l.* FROM loans l JOIN vr USING (CaseId) WHERE i > (SELECT n FROM n))"""
OLD = """n AS (SELECT count(*)*3//10 AS n, count(*) AS m FROM loans),
vr AS (SELECT *, row_number() OVER (ORDER BY D_ContractDateToImportDate, CaseId) AS i FROM loans),
val AS (SELECT *, cast(ceil((i-(m-n))*10/cast(n as double)) as int) AS Pckg FROM vr, n WHERE i > m-n),
ben AS (SELECT * FROM vr, n WHERE i <= m-n)"""


def curve_sql(name, src, by=""):
    k = f"{by}, " if by else ""
    part = f"PARTITION BY {by} " if by else ""
    return f"{name} AS (SELECT {k}Month, sum(sr) OVER ({part}ORDER BY Month) AS SR FROM (SELECT {k}Month, sum(Payment)/sum(TOA) AS sr FROM payments JOIN {src} USING (CaseId) GROUP BY {k}Month))"


def boot_sql(name, src, by=""):
    """Replicate curves and their mean and quantiles over the replicates."""
    k = f"{by}, " if by else ""
    return (f"{name}_w AS (SELECT CaseId, {k}TOA, g.r AS rep, {poisson_sql(boot('CaseId', 'g.r'))} AS w FROM {src}, (SELECT unnest(range(1,{B + 1})) AS r) g),"
            f"{name}_m AS (SELECT {k}rep, Month, sum(w*Payment)/sum(w*TOA) AS sr FROM {name}_w JOIN payments USING (CaseId) WHERE w > 0 GROUP BY {k}rep, Month),"
            f"{name}_c AS (SELECT {k}rep, Month, sum(sr) OVER (PARTITION BY {k}rep ORDER BY Month) AS SR FROM {name}_m),"
            f"{name} AS (SELECT {k}Month, avg(SR) AS SR, stddev_samp(SR) AS StdSR, "
            + ", ".join(f"quantile_cont(SR,{q}) AS {c}" for c, q in QS.items()) + f" FROM {name}_c GROUP BY {k}Month)")


STATS = ", ".join(f"round({c},6) AS {c}" for c in ["SR", "StdSR", *QS])
DEV = """d AS (SELECT p.Pckg, p.Month, (p.SR-b.SR)/nullif(p.SR,0) AS Dev FROM pk p JOIN {} b ON {})
SELECT Month, round(avg(Dev),6) AS Dev, round(avg(abs(Dev)),6) AS DevAbs, round(quantile_cont(Dev,0.25),6) AS Q25 FROM d GROUP BY 1"""


def rounded(df):
    return df.select(*[rnd(c).alias(c) if k == "double" else c for c, k in df.dtypes])


@query("x1_payments", "SELECT CaseId, Month, Payment FROM payments")
def x1(t):
    return setup(t)[1]


@query("x2_cumulative_curve", f"WITH {curve_sql('c', 'loans')} SELECT Month, round(SR,6) AS SR FROM c")
def x2(t):
    loans, pay = setup(t)
    return rounded(backtest.curve(pay, loans))


@query("x2_cumulative_curve_by_product", """
SELECT Product, Month, round(sum(sr) OVER (PARTITION BY Product ORDER BY Month),6) AS SR FROM (
 SELECT Product, Month, sum(coalesce(PaymentAmount,0e0))/sum(TOA) AS sr FROM case_events JOIN cases USING (CaseId) GROUP BY 1,2)""")
def x2b(t):
    return rounded(backtest.curve(features.payments(t.case_events, t.cases), t.cases, ["Product"]))


@query("x3_bootstrap_curve", f"WITH {VAL}, {boot_sql('bb', 'ben')} SELECT Month, {STATS} FROM bb")
def x3(t):
    pay, _, ben = random_sets(t)
    return rounded(backtest.bootstrap(pay, ben, B))


@query("x4_bootstrap_curve_by_band", f"""
WITH {VAL}, bn AS (SELECT *, CASE WHEN TOA <= 5000 THEN 'low' WHEN TOA <= 20000 THEN 'mid' ELSE 'high' END AS band FROM ben), {boot_sql('bb', 'bn', 'band')}
SELECT band, Month, {STATS} FROM bb""")
def x4(t):
    pay, _, ben = random_sets(t)
    band = F.when(F.col("TOA") <= 5000, "low").when(F.col("TOA") <= 20000, "mid").otherwise("high")
    return rounded(backtest.bootstrap(pay, ben.withColumn("band", band), B, ["band"]))


@query("x5_random_packages", f"WITH {VAL} SELECT CaseId, Pckg FROM val")
def x5(t):
    return random_sets(t)[1].select("CaseId", "Pckg")


@query("x6_age_packages", f"WITH {OLD} SELECT CaseId, Pckg FROM val")
def x6(t):
    return age_sets(t)[1].select("CaseId", "Pckg")


@query("x7_deviation_random", f"WITH {VAL}, {boot_sql('bb', 'ben')}, {curve_sql('pk', 'val', 'Pckg')}, " + DEV.format("bb", "p.Month = b.Month"))
def x7(t):
    pay, val, ben = random_sets(t)
    d = backtest.deviations(backtest.curve(pay, val, ["Pckg"]), backtest.bootstrap(pay, ben, B))
    return rounded(backtest.deviation_summary(d))


@query("x7_deviation_age", f"WITH {OLD}, {boot_sql('bb', 'ben')}, {curve_sql('pk', 'val', 'Pckg')}, " + DEV.format("bb", "p.Month = b.Month"))
def x7b(t):
    pay, val, ben = age_sets(t)
    d = backtest.deviations(backtest.curve(pay, val, ["Pckg"]), backtest.bootstrap(pay, ben, B))
    return rounded(backtest.deviation_summary(d))


def _by_variable(sets):
    band = "CASE WHEN TOA >= e[1] AND TOA <= e[2] THEN 1 WHEN TOA <= e[3] THEN 2 WHEN TOA <= e[4] THEN 3 WHEN TOA <= e[5] THEN 4 WHEN TOA <= e[6] THEN 5 END"
    return f"""WITH {sets}, q AS (SELECT Pckg, min(TOA) AS a, quantile_cont(TOA,0.2) AS b, quantile_cont(TOA,0.4) AS c, quantile_cont(TOA,0.6) AS d, quantile_cont(TOA,0.8) AS e, max(TOA) AS f FROM val GROUP BY 1),
ed AS (SELECT [min(a),avg(b),avg(c),avg(d),avg(e),max(f)] AS e FROM q),
vb AS (SELECT CaseId, Pckg, TOA, {band} AS band FROM val, ed), bn AS (SELECT * FROM (SELECT CaseId, TOA, {band} AS band FROM ben, ed) WHERE band IS NOT NULL),
{boot_sql('bb', 'bn', 'band')}, {curve_sql('pk', 'val', 'Pckg')},
w AS (SELECT Pckg, band, sum(TOA) AS debt FROM vb GROUP BY 1,2),
mb AS (SELECT Pckg, Month, sum(debt*SR)/sum(debt) AS SR FROM w JOIN bb USING (band) GROUP BY 1,2), """ + DEV.format("mb", "p.Month = b.Month AND p.Pckg = b.Pckg")


@query("x8_deviation_matched_by_variable", _by_variable(VAL))
def x8(t):
    pay, val, ben = random_sets(t)
    return rounded(backtest.deviation_summary(backtest.matched_by_variable(pay, val, ben, "TOA", B)).drop("Unmatched"))


@query("x8_deviation_matched_by_variable_age", _by_variable(OLD))
def x8b(t):
    pay, val, ben = age_sets(t)
    return rounded(backtest.deviation_summary(backtest.matched_by_variable(pay, val, ben, "TOA", B)).drop("Unmatched"))


#: The variables of the component matching.
PCA = ["LoanAmount", "TOA", "Principal", "D_ContractDateToImportDate", "DPD", "ExternalAgency", "Bailiff",
       "ClosedExecution", "PopulationInCity", "Age", "LastPaymentAmount", "M_LastPaymentToImportDate", "MeanSalary", "IfMan"]


def _by_components(sets):
    pay, val, ben = sets
    man = (F.col("Gender") == "MALE").cast("int")
    return backtest.matched_by_components(pay, val.withColumn("IfMan", man), ben.withColumn("IfMan", man), PCA, 5, 10, B)


@query("x9_deviation_matched_by_components")
def x9(t):
    return backtest.deviation_summary(_by_components(random_sets(t)))


@query("x9_deviation_matched_by_components_age")
def x9b(t):
    return backtest.deviation_summary(_by_components(age_sets(t)))


@query("x10_three_methods")
def x10(t):
    pay, val, ben = random_sets(t)
    per = backtest.curve(pay, val, ["Pckg"])

    def named(dev, tail):
        s = backtest.deviation_summary(dev)
        return s.select("Month", F.col("Dev").alias(f"Dev{tail}"), F.col("DevAbs").alias(f"DevAbs{tail}"))
    a = named(backtest.deviations(per, backtest.bootstrap(pay, ben, B)), "All")
    b = named(backtest.matched_by_variable(pay, val, ben, "TOA", B), "V")
    c = named(_by_components((pay, val, ben)), "PCA")
    return a.join(b, "Month").join(c, "Month")


CELLS = ["b0", "b1", "b2"]
#: Three given components of standardised columns, for the draws that SQL repeats.
GIVEN = [{"TOA": 0.7, "Principal": 0.7}, {"Age": 0.7, "D_ContractDateToImportDate": -0.7}, {"Age": 0.7, "D_ContractDateToImportDate": 0.7}]
GIVEN_COLUMNS = ["TOA", "Principal", "Age", "D_ContractDateToImportDate"]


def hidden_sample(t):
    """A sample by a hidden rule, and the rest."""
    p = F.when(F.col("TOA") >= 15000, F.lit(0.14)).otherwise(F.lit(0.06))
    smp_rule = uniform("CaseId", "smp") < p
    return t.cases.filter(smp_rule), t.cases.filter(~smp_rule)


def match_sets(t):
    """The sample and the reference in five bands of each given component of the sample."""
    from recoup.operators import bands
    smp, ref = hidden_sample(t)
    scale = bands.scale_params(smp, GIVEN_COLUMNS)

    def scored(d):
        z = {c: (F.col(c) - F.lit(a)) / F.lit(b) for c, (a, b) in scale.items()}
        return d.select("CaseId", "TOA", *[F.round(sum(F.lit(w) * z[c] for c, w in g.items()), 6).alias(f"s{j}") for j, g in enumerate(GIVEN)])
    smp, ref = scored(smp), scored(ref)
    cells = {f"b{j}": bands.cut(f"s{j}", bands.edges(smp, f"s{j}", 5), True) for j in range(len(GIVEN))}
    return smp.withColumns(cells), ref.withColumns(cells), features.payments(t.case_events, t.cases)


_SCALED = ", ".join(f"avg({c}) AS m_{c}, stddev_samp({c}) AS d_{c}" for c in GIVEN_COLUMNS)
_SCORES = ", ".join("round(" + " + ".join(f"({w}e0) * (({c} - m_{c}) / d_{c})" for c, w in g.items()) + f", 6) AS s{j}" for j, g in enumerate(GIVEN))
_EDGES = ", ".join(f"list_sort(list_distinct(quantile_cont(s{j}, [0,0.2,0.4,0.6,0.8,1.0]))) AS e{j}" for j in range(3))
_BANDS = ", ".join(f"cast(CASE WHEN s{j} >= e{j}[1] AND s{j} <= e{j}[len(e{j})] THEN greatest(len(list_filter(e{j}, lambda z: z < s{j})), 1) END as int) AS b{j}" for j in range(3))
MATCH = f"""k AS MATERIALIZED (SELECT CaseId, {', '.join(GIVEN_COLUMNS)}, {u('CaseId', 'smp')} < CASE WHEN TOA >= 15000 THEN 0.14e0 ELSE 0.06e0 END AS smp FROM cases),
z AS (SELECT {_SCALED} FROM k WHERE smp),
c AS MATERIALIZED (SELECT CaseId, TOA, smp, {_SCORES} FROM k, z),
e AS (SELECT {_EDGES} FROM c WHERE smp),
x AS MATERIALIZED (SELECT c.CaseId, c.TOA, c.smp, {_BANDS} FROM c, e),
need AS (SELECT b0, b1, b2, count(*) AS wanted FROM x WHERE smp GROUP BY ALL),
rr AS (SELECT x.CaseId, x.TOA, g.j AS rep, row_number() OVER (PARTITION BY g.j, b0, b1, b2 ORDER BY substr(md5(concat(cast(x.CaseId as varchar),'-m',cast((g.j-1)//4+1 as varchar))),cast(8*((g.j-1)%4)+1 as int),8), x.CaseId) AS i, wanted
 FROM x JOIN need USING (b0, b1, b2), (SELECT unnest(range(1,102)) AS j) g WHERE NOT smp),
pp AS MATERIALIZED (SELECT CaseId, Month, coalesce(PaymentAmount,0e0) AS Payment FROM case_events),
dm AS (SELECT rep, Month, sum(Payment)/sum(TOA) AS SR FROM rr JOIN pp USING (CaseId) WHERE i <= wanted*5 GROUP BY 1,2),
dc AS MATERIALIZED (SELECT rep, Month, SR, sum(SR) OVER (PARTITION BY rep ORDER BY Month) AS SRcml FROM dm)"""


def _draws(t):
    smp, ref, pay = match_sets(t)
    need = smp.groupBy(*CELLS).agg(F.count(F.lit(1)).alias("wanted"))
    return smp, ref, pay, backtest.repeated_match(pay, ref, need, CELLS, 5, B)


@query("x11_matching_by_components")
def x11b(t):
    """The same draws in cells of the sample's own principal components."""
    man = (F.col("Gender") == "MALE").cast("int")
    smp, ref = (d.filter("Gender IS NOT NULL").withColumn("IfMan", man).dropna("any", subset=PCA) for d in hidden_sample(t))
    smp, ref, depth = backtest.component_cells(smp, ref, PCA)
    need = smp.groupBy("cell").agg(F.count(F.lit(1)).alias("wanted"))
    draws = backtest.repeated_match(features.payments(t.case_events, t.cases), ref, need, ["cell"], 5, B)
    return rounded(backtest.draw_statistics(draws)).withColumn("components", F.lit(depth))


@query("x11_repeated_matching", f"""WITH {MATCH} SELECT Month, """ + ", ".join(
    f"round(quantile_cont({c},0.25),6) AS Q25{s}, round(quantile_cont({c},0.5),6) AS Q50{s}, round(quantile_cont({c},0.75),6) AS Q75{s}, round(avg({c}),6) AS Avg{s}, round(stddev_samp({c}),6) AS Std{s}"
    for c, s in (("SR", ""), ("SRcml", "Cml"))) + " FROM dc GROUP BY 1")
def x11(t):
    return rounded(backtest.draw_statistics(_draws(t)[3]))


@query("x12_absolute_deviation", f"""WITH {MATCH},
s AS (SELECT Month, sum(sr) OVER (ORDER BY Month) AS SR FROM (SELECT Month, sum(Payment)/sum(TOA) AS sr FROM x JOIN pp USING (CaseId) WHERE smp GROUP BY 1)),
a AS (SELECT Month, sum(sr) OVER (ORDER BY Month) AS SR FROM (SELECT Month, sum(Payment)/sum(TOA) AS sr FROM x JOIN pp USING (CaseId) WHERE NOT smp GROUP BY 1)),
m AS (SELECT Month, quantile_cont(SRcml,0.5) AS SR FROM dc GROUP BY 1)
SELECT Month, round(abs(s.SR-a.SR)/s.SR,6) AS DevAllCml, round(abs(s.SR-m.SR)/s.SR,6) AS DevRefCml FROM s JOIN a USING (Month) JOIN m USING (Month)""")
def x12(t):
    smp, ref, pay, draws = _draws(t)
    real = backtest.curve(pay, smp).withColumnRenamed("SR", "real")
    whole = backtest.curve(pay, ref).withColumnRenamed("SR", "whole")
    med = backtest.draw_statistics(draws).select("Month", "Q50Cml")
    j = real.join(whole, "Month").join(med, "Month")  # twelve rows each
    return rounded(j.select("Month", (F.abs(F.col("real") - F.col("whole")) / F.col("real")).alias("DevAllCml"),
                            (F.abs(F.col("real") - F.col("Q50Cml")) / F.col("real")).alias("DevRefCml")))
