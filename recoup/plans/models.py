"""Trees, ensembles and their comparison."""
from __future__ import annotations

from dataclasses import replace

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from recoup.functions.columns import rnd
from recoup.functions.keys import fold
from recoup.operators import bands, boosting, features, forests, models, sampling
from recoup.plans.fixture_sql import boot, md, un
from recoup.plans.linear import frame_of
from recoup.plans.registry import query
from recoup.session import stored
from recoup.sources import stores

COLS = ["TOA", "Principal", "Interest", "LoanAmount", "D_ContractDateToImportDate", "DPD", "ExternalAgency", "Bailiff",
        "ClosedExecution", "Age", "IfMan", "LastPaymentAmount", "M_LastPaymentToImportDate", "MeanSalary", "PopulationInCity"]


def target_sets(t):
    """Complete loans with the success target, stored once, split 60 / 40."""
    d = features.loans(t.cases).withColumn("IfMan", (F.col("Gender") == "MALE").cast("int")).join(
        features.success6(t.case_events, t.cases).select("CaseId", "Suc"), "CaseId")
    d = models.assemble(d.select("CaseId", *COLS, F.col("Suc").cast("double").alias("label")), COLS)
    return sampling.split(stored(d, "target"), "CaseId", "trn", 0.6)


def measured(t, name, model, trn, tst):
    return frame_of(t, [(name, models.accuracy(model.transform(trn)), models.accuracy(model.transform(tst)))],
                    "model string, train_accuracy double, test_accuracy double")


# Labels of the hold-out of the target sets.
HOLD = f"""h AS (SELECT CaseId, Suc, row_number() OVER (ORDER BY {md('CaseId', 'trn')}, CaseId) <= (SELECT floor(0.6*count(*)+1e-9) FROM loans) AS trn
 FROM loans JOIN (SELECT CaseId, Suc FROM success6) USING (CaseId))
SELECT cast(Suc as double) AS label, count(*) AS n FROM h WHERE NOT trn GROUP BY 1"""


@query("s7_model_round_trip")
def s7(t):
    trn, tst = target_sets(t)
    from pyspark.ml import Pipeline
    model = Pipeline(stages=[LogisticRegression(featuresCol="features", labelCol="label")]).fit(trn)
    path = stores.scratch(t.spark, "model")
    model.write().overwrite().save(path)
    return PipelineModel.load(path).transform(tst).select("CaseId", "label", "prediction")


@query("s7_labels", f"WITH {HOLD}")
def s7b(t):
    """The reloaded model scores every row of the hold-out once."""
    return s7(t).where("prediction IN (0, 1)").groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("t1_tree_gini")
def t1(t):
    trn, tst = target_sets(t)
    return measured(t, "gini", models.tree(trn, "gini"), trn, tst)


@query("t2_tree_entropy")
def t2(t):
    trn, tst = target_sets(t)
    return measured(t, "entropy", models.tree(trn, "entropy"), trn, tst)


@query("t3_tree_pruned_by_cross_validation")
def t3(t):
    trn, tst = target_sets(t)
    rows, best = models.depth_by_cross_validation(trn.withColumn("fold", fold("CaseId", "cv", 5)), range(1, 11), "fold", 5)
    return frame_of(t, [(d, e, best.depth) for d, e in rows], "max_depth int, cv_error double, chosen_depth int")


@query("t4_cost_matrix")
def t4(t):
    trn, tst = target_sets(t)
    w = F.when(F.col("label") == 1, F.lit(1.5)).otherwise(F.lit(1.0))
    m = models.tree(trn.withColumn("w", w), weight="w")
    s = models.probability(m.transform(tst))
    # A miss costs 1.5 times a false alarm: predict 1 where the unweighted odds exceed 1 / 1.5.
    plain = models.probability(models.tree(trn).transform(tst)).select("CaseId", (F.col("score") > 1 / 2.5).cast("double").alias("by_threshold"))
    return s.join(plain, "CaseId").groupBy("label", "prediction", "by_threshold").agg(F.count(F.lit(1)).alias("n"))


@query("t4_labels", f"WITH {HOLD}")
def t4b(t):
    return t4(t).groupBy("label").agg(F.sum("n").alias("n"))


@query("t5_bagging")
def t5(t):
    trn, tst = target_sets(t)
    return measured(t, "bagging", models.forest(trn, 1000, "all"), trn, tst)


@query("t6_random_forest")
def t6(t):
    trn, tst = target_sets(t)
    return measured(t, "forest", models.forest(trn, 1000, "5"), trn, tst)


TREES = 1000
_ENSEMBLES: dict[tuple, str] = {}


def ensemble(t):
    """The training rows and the forest of 1,000 trees on them (nodes under 100 rows stay whole), grown once for the state of the inputs
    and read from its stored table by every later query."""
    trn, tst = (d.drop("features") for d in target_sets(t))
    state = (t.spark.sparkContext.applicationId, t.sf_dir, t.state("lineitem", "orders", "customer"))
    if state not in _ENSEMBLES:
        _ENSEMBLES[state] = forests.bagged(trn, "CaseId", COLS, TREES, per_split=5, min_rows=50).save(t.spark)
    return trn, tst, forests.Bag.load(t.spark, _ENSEMBLES[state], COLS)


@query("t7_out_of_bag")
def t7(t):
    trn, _, bag = ensemble(t)
    v = bag.votes(trn, "CaseId", "label")
    wrong = ((F.col("votes") / F.col("times") > 0.5).cast("double") != F.col("label")).cast("double")
    return v.groupBy("times").agg(F.count(F.lit(1)).alias("n"), F.avg(wrong).alias("oob_error"),
                                  (F.lit(1.0) - F.col("times") / F.lit(float(TREES))).alias("in_bag_share"))


@query("t7_out_of_bag_times", f"""
WITH complete AS (SELECT CaseId FROM cases WHERE Product = 'Cash loan' AND Age > -1 AND Other IS NOT NULL AND DPD IS NOT NULL AND ExternalAgency IS NOT NULL
  AND Gender IS NOT NULL AND M_LastPaymentToImportDate IS NOT NULL AND Land IS NOT NULL AND PopulationInCity IS NOT NULL),
l AS (SELECT CaseId, row_number() OVER (ORDER BY {md('CaseId', 'trn')}, CaseId) <= (SELECT floor(0.6*count(*)+1e-9) FROM complete) AS trn FROM complete),
o AS (SELECT CaseId, count(*) FILTER ({boot('CaseId', 'j')} * 4294967296 < ceil(exp(-1.0) * 4294967296)) AS times FROM l, (SELECT unnest(range(1, {TREES + 1})) AS j) WHERE trn GROUP BY 1)
SELECT times, count(*) AS n FROM o GROUP BY 1""")
def t7b(t):
    """How many rows were left out by how many trees."""
    trn, _, bag = ensemble(t)
    return bag.votes(trn, "CaseId", "label").groupBy("times").agg(F.count(F.lit(1)).alias("n"))


@query("t8_impurity_importance")
def t8(t):
    return frame_of(t, ensemble(t)[2].impurity_importance(), "variable string, importance double")


@query("t9_permutation_importance")
def t9(t):
    trn, _, bag = ensemble(t)
    return frame_of(t, bag.permutation_importance(trn, "CaseId", "label"), "variable string, rise double, scaled double")


@query("t10_tree_sizes")
def t10(t):
    return frame_of(t, ensemble(t)[2].sizes(), "tree int, nodes int, leaves int, depth int")


@query("t10_tree_listing")
def t10b(t):
    trn, _ = target_sets(t)
    return models.tree_listing(models.tree(trn), t.spark)


@query("t11_partial_dependence")
def t11(t):
    trn, _, bag = ensemble(t)
    return bag.dependence(trn, "TOA", bands.edges(trn, "TOA", 15))


@query("t19_median_by_parameter_pair", f"""
WITH s AS (SELECT {un('CaseId', 'f19')} % 5 AS f, TOA, Age, Suc FROM scored), g AS (SELECT unnest([0.3e0,0.4e0,0.5e0,0.6e0]) AS th), h AS (SELECT unnest([0e0,0.1e0,0.2e0]) AS w),
a AS (SELECT th, w, f, avg(cast((0.55e0-0.4e0*TOA/50000e0+w*cast(Age BETWEEN 30 AND 50 as int) > th)::int = Suc as int)) AS acc FROM s, g, h GROUP BY 1,2,3)
SELECT th, w, round(quantile_cont(acc,0.5),6) AS median FROM a GROUP BY 1,2""")
def t19(t):
    s = features.scored(t.case_events, t.cases).select(fold("CaseId", "f19", 5).alias("f"), "TOA", "Age", "Suc")
    pairs = [(th, w) for th in (0.3, 0.4, 0.5, 0.6) for w in (0.0, 0.1, 0.2)]
    hit = [F.avg((((F.lit(0.55) - F.lit(0.4) * F.col("TOA") / F.lit(50000.0) + F.lit(w) * F.col("Age").between(30, 50).cast("int"))
                   > F.lit(th)).cast("int") == F.col("Suc")).cast("double")).alias(f"a{i}") for i, (th, w) in enumerate(pairs)]
    per = s.groupBy("f").agg(*hit)  # five rows, every parameter pair in one pass
    return per.select(F.explode(F.array(*[F.struct(F.lit(th).alias("th"), F.lit(w).alias("w"), F.col(f"a{i}").alias("acc"))
                                          for i, (th, w) in enumerate(pairs)])).alias("r")).select("r.*").groupBy("th", "w").agg(
        rnd(F.percentile("acc", F.lit(0.5))).alias("median"))


def stacked_scores(t):
    """Scores on the hold-out of a logistic model, a forest of 500 trees and 200 rounds of boosting, and
    their convex combination by the scores of five folds, each from models that left it out."""
    trn, tst = target_sets(t)
    learners = {"logistic": lambda d: LogisticRegression(featuresCol="features", labelCol="label").fit(d), "forest": lambda d: models.forest(d, 500, "5")}
    names = [*learners, "boosting"]
    trn = stored(trn.withColumn("fold", fold("CaseId", "cv", 5)), "folds")
    rows = trn.drop("features").withColumnRenamed("fold", "part").unionByName(tst.drop("features").withColumn("part", F.lit(boosting.HOLD_OUT)))
    plan = boosting.Config("boosting", 200, 3, 0.05, 50, rows=0.5)
    *by_fold, full = boosting.fit(rows, "CaseId", COLS, [*[replace(plan, leave=k) for k in range(5)], plan])

    def boosted(m, d):
        best = m.best("valid_loss") if m.config.leave is not None else round(sum(x.best("valid_loss") for x in by_fold) / 5)
        return m.margins(d, "CaseId", best).select("CaseId", (1 / (1 + F.exp(-F.col("margin")))).alias("boosting"))

    left = boosted(by_fold[0], trn.filter("fold = 0"))
    for k in range(1, 5):
        left = left.unionByName(boosted(by_fold[k], trn.filter(F.col("fold") == k)))
    oof = stored(models.out_of_fold(trn, "CaseId", "fold", 5, learners).join(left, "CaseId"), "oof")
    weights = models.convex_weights(oof, names, "label")
    wide = tst.select("CaseId", "label", "features")
    for n, f in learners.items():
        wide = models.probability(f(trn).transform(wide), n).drop("rawPrediction", "probability", "prediction")
    wide = wide.join(boosted(full, tst), "CaseId")
    mix = sum(F.lit(w) * F.col(n) for n, w in weights.items())
    return stored(wide.select(F.col("label").cast("int").alias("label"), *names, mix.alias("stacked")), "stacked"), names, weights


@query("t20_stacked_models")
def t20(t):
    scores, names, weights = stacked_scores(t)
    from recoup.plans.linear import leaderboard
    board = leaderboard(scores, "label", {n: F.col(n) for n in [*names, "stacked"]}, 0.5)
    weight = F.create_map(*[F.lit(x) for n in names for x in (n, weights[n])])
    return board.withColumn("weight", weight[F.col(board.columns[0])])
