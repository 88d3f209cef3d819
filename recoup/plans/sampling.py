"""Sampling and resampling."""
from __future__ import annotations

from pyspark.sql import functions as F

from recoup.functions.columns import n_rows, rnd
from recoup.functions.keys import fold, uniform
from recoup.operators import features, sampling
from recoup.plans.fixture_sql import boot, md, u, un
from recoup.plans.registry import query



def poisson_sql(expr: str) -> str:
    return "(" + "+".join(f"cast({expr} >= {c!r}::double as int)" for c in sampling.POISSON1) + ")"


@query("r1_random_sample", f"SELECT CaseId FROM cases ORDER BY {md('CaseId', 'r1')}, CaseId LIMIT 5000")
def r1(t):
    return sampling.sample_n(t.cases.select("CaseId"), "CaseId", "r1", 5000)


@query("r2_train_test_split", f"""
SELECT CaseId, CASE WHEN row_number() OVER (ORDER BY {md('CaseId', 'r2')}, CaseId) <= floor(0.6e0*count(*) OVER ()+1e-9) THEN 'trn' ELSE 'tst' END AS part FROM cases""")
def r2(t):
    a, b = sampling.split(t.cases.select("CaseId"), "CaseId", "r2", 0.6)
    return a.withColumn("part", F.lit("trn")).unionByName(b.withColumn("part", F.lit("tst")))


@query("r3_nested_split", f"""
WITH v AS (SELECT CaseId FROM cases ORDER BY {md('CaseId', 'val')}, CaseId LIMIT 4000), b AS (SELECT CaseId FROM cases WHERE CaseId NOT IN (SELECT CaseId FROM v)),
r AS (SELECT CaseId, row_number() OVER (ORDER BY {md('CaseId', 'trn')}, CaseId) AS i, count(*) OVER () AS n FROM b)
SELECT CaseId, 'val' AS part FROM v UNION ALL SELECT CaseId, CASE WHEN i <= floor(0.6e0*n+1e-9) THEN 'trn' ELSE 'tst' END FROM r""")
def r3(t):
    val, ben = sampling.split_n(t.cases.select("CaseId"), "CaseId", "val", 4000)
    trn, tst = sampling.split(ben, "CaseId", "trn", 0.6)
    return (val.withColumn("part", F.lit("val")).unionByName(trn.withColumn("part", F.lit("trn")))
            .unionByName(tst.withColumn("part", F.lit("tst"))))


@query("r4_folds", f"SELECT CaseId, cast({un('CaseId', 'cv')} % 10 + 1 as int) AS CVfold FROM cases")
def r4(t):
    return t.cases.select("CaseId", (fold("CaseId", "cv", 10) + 1).alias("CVfold"))


REP = f"SELECT CaseId, TOA, cast(g.r as int) AS rep, {poisson_sql(boot('CaseId', 'g.r'))} AS w FROM cases, (SELECT unnest(range(1,{{}}+1)) AS r) g"


@query("r5_bootstrap_replicates", f"SELECT CaseId, rep, cast(w as int) AS w FROM ({REP.format(5)})")
def r5(t):
    return sampling.replicates(t.cases.select("CaseId"), "CaseId", 5)


@query("r6_bootstrap_mean", f"""
SELECT round(avg(m),4) AS mean, round(quantile_cont(m,0.05),4) AS q05, round(quantile_cont(m,0.95),4) AS q95 FROM (
 SELECT rep, sum(w*TOA)/sum(w) AS m FROM ({REP.format(101)}) GROUP BY rep)""")
def r6(t):
    r = sampling.replicates(t.cases.select("CaseId", "TOA"), "CaseId", 101)
    m = r.groupBy("rep").agg((F.sum(F.col("w") * F.col("TOA")) / F.sum("w")).alias("m"))  # 101 rows
    return m.agg(rnd(F.avg("m"), 4).alias("mean"), rnd(F.percentile("m", F.lit(0.05)), 4).alias("q05"),
                 rnd(F.percentile("m", F.lit(0.95)), 4).alias("q95"))


@query("r7_out_of_bag_size", f"""
SELECT rep, count(*) FILTER (w = 0) AS oob, round(count(*) FILTER (w = 0)/cast(count(*) as double),6) AS share, cast(sum(w) as bigint) AS drawn FROM ({REP.format(101)}) GROUP BY rep""")
def r7(t):
    r = sampling.replicates(t.cases.select("CaseId"), "CaseId", 101)
    out = F.count_if(F.col("w") == 0)
    return r.groupBy("rep").agg(out.alias("oob"), rnd(out / F.count(F.lit(1))).alias("share"), F.sum("w").alias("drawn"))


@query("r8_block_bootstrap", """
WITH m AS (SELECT series_id, cast(ceil(max(t)/12e0) as bigint) AS m FROM series GROUP BY 1),
d AS (SELECT series_id, rep, slot, cast('0x'||substr(md5(concat(series_id,'_',cast(rep as varchar),'_',cast(slot as varchar),'-blk')),1,8) as bigint) % m AS block
 FROM (SELECT series_id, m, unnest(range(0, m)) AS slot FROM m), (SELECT unnest(range(1,21)) AS rep))
SELECT series_id, cast(rep as int) AS rep, count(*) AS n, round(avg(value),2) AS mean FROM d JOIN series s USING (series_id)
WHERE cast(floor((s.t-1)/12) as bigint) = d.block GROUP BY 1,2""")
def r8(t):
    b = sampling.blocks(features.series(t.lineitem), "series_id", "t", 12, 20, "blk")
    return b.groupBy("series_id", "rep").agg(n_rows(), rnd(F.avg("value"), 2).alias("mean"))


@query("r9_biased_split", f"""
SELECT CaseId, cast({u('CaseId', 'r9')} < CASE WHEN TOA >= 15000 THEN 0.7e0 ELSE 0.3e0 END as int) AS TrnC FROM cases""")
def r9(t):
    p = F.when(F.col("TOA") >= 15000, F.lit(0.7)).otherwise(F.lit(0.3))
    return t.cases.select("CaseId", (uniform("CaseId", "r9") < p).cast("int").alias("TrnC"))


@query("r10_matched_sample", f"""
WITH c AS (SELECT CaseId, Product, coalesce(Land,0) AS Land, {u('CaseId', 'r10')} < 0.1e0 AS smp FROM cases),
n AS (SELECT Product, Land, count(*) AS wanted FROM c WHERE smp GROUP BY 1,2),
r AS (SELECT CaseId, Product, Land, row_number() OVER (PARTITION BY Product, Land ORDER BY {md('CaseId', 'ref')}, CaseId) AS i FROM c WHERE NOT smp)
SELECT CaseId, Product, Land FROM r JOIN n USING (Product, Land) WHERE i <= wanted*5""")
def r10(t):
    c = t.cases.select("CaseId", "Product", F.coalesce("Land", F.lit(0)).alias("Land"))
    smp = uniform("CaseId", "r10") < 0.1
    need = c.filter(smp).groupBy("Product", "Land").agg(F.count(F.lit(1)).alias("wanted"))
    return sampling.matched(c.filter(~smp), need, "CaseId", ["Product", "Land"], 5, "ref")


@query("r11_class_balancing", f"""
WITH r AS (SELECT CaseId, Suc, row_number() OVER (PARTITION BY Suc ORDER BY {md('CaseId', 'pos')}, CaseId) AS position FROM success6),
n AS (SELECT Suc, count(*) AS n FROM success6 GROUP BY 1),
d AS (SELECT Suc, i AS draw, 1 + cast('0x'||substr(md5(concat(cast(i as varchar),'-bal',cast(Suc as varchar))),1,15) as bigint) % n AS position FROM n, (SELECT unnest(range(1,7001)) AS i))
SELECT draw, CaseId, Suc FROM d JOIN r USING (Suc, position)""")
def r11(t):
    s = features.success6(t.case_events, t.cases).select("CaseId", "Suc")
    return sampling.balanced(s, "CaseId", "Suc", 7000).select("draw", "CaseId", "Suc")


@query("r12_autocorrelation", """
WITH m AS (SELECT series_id, t, value - avg(value) OVER (PARTITION BY series_id) AS z FROM series),
v AS (SELECT series_id, sum(z*z) AS v FROM m GROUP BY 1)
SELECT a.series_id, cast(a.t - b.t as int) AS lag, round(sum(a.z*b.z)/any_value(v.v),6) AS acf FROM m a JOIN m b ON a.series_id = b.series_id AND a.t - b.t BETWEEN 1 AND 20
 JOIN v ON v.series_id = a.series_id GROUP BY 1,2""")
def r12(t):
    return sampling.autocorrelation(features.series(t.lineitem), "series_id", "t", "value", 20).withColumn("acf", rnd("acf"))


@query("r12_partial_autocorrelation")
def r12b(t):
    acf = sampling.autocorrelation(features.series(t.lineitem), "series_id", "t", "value", 20)
    return sampling.partial_autocorrelation(acf, "series_id")
