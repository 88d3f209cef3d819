"""Models trained by MLlib, and the searches, ensembles and explanations built on them."""
from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from itertools import combinations

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline
from pyspark.ml.classification import DecisionTreeClassifier, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PARALLEL_FITS = 4


def assemble(df: DataFrame, columns: Sequence[str], name: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(columns), outputCol=name).transform(df)


def probability(df: DataFrame, name: str = "score") -> DataFrame:
    return df.withColumn(name, vector_to_array("probability")[1])


def accuracy(pred: DataFrame, label: str = "label") -> float:
    return float(pred.agg(F.avg((F.col("prediction") == F.col(label)).cast("double"))).first()[0])


def in_parallel(work: Sequence[Callable[[], object]]) -> list:
    """Independent fits submitted from a few threads; each is a set of Spark jobs."""
    wrap = inheritable_thread_target(SparkSession.active())
    with ThreadPoolExecutor(PARALLEL_FITS) as pool:
        return [f.result() for f in [pool.submit(wrap(w)) for w in work]]


# Clusters ---------------------------------------------------------------------------------

def cluster_rule(df: DataFrame, cluster: str) -> DataFrame:
    """A cluster predicts FEMALE where its share of women is above the overall share; its mean
    age predicts age. Both errors follow from three sums per cluster."""
    woman = (F.col("Gender") == "FEMALE").cast("int")
    g = df.groupBy(cluster).agg(
        F.count(F.lit(1)).alias("n"), F.sum(woman).alias("f"),
        (F.count(F.lit(1)) * F.var_pop(F.col("Age").cast("double"))).alias("sse"))
    share = df.agg(F.avg(woman)).first()[0]
    right = F.when(F.col("f") / F.col("n") > F.lit(share), F.col("f")).otherwise(F.col("n") - F.col("f"))
    return g.agg((1 - F.sum(right) / F.sum("n")).alias("ClassError"), (F.sum("sse") / F.sum("n")).alias("MSE"))


# Trees --------------------------------------------------------------------------------------

def tree(train: DataFrame, impurity: str = "gini", min_leaf: int = 50, depth: int = 5, weight: str | None = None):
    est = DecisionTreeClassifier(labelCol="label", featuresCol="features", impurity=impurity, maxDepth=depth,
                                 minInstancesPerNode=min_leaf, seed=1)
    return (est.setWeightCol(weight) if weight else est).fit(train)


def forest(train: DataFrame, trees: int, subset: str, min_leaf: int = 20, depth: int = 6):
    return RandomForestClassifier(labelCol="label", featuresCol="features", numTrees=trees, featureSubsetStrategy=subset,
                                  minInstancesPerNode=min_leaf, maxDepth=depth, seed=1).fit(train)


def depth_by_cross_validation(train: DataFrame, depths: Sequence[int], fold: str, folds: int):
    """Cross-validated error per tree depth; the smallest error wins."""
    est = DecisionTreeClassifier(labelCol="label", featuresCol="features", seed=1, minInstancesPerNode=20)
    grid = ParamGridBuilder().addGrid(est.maxDepth, list(depths)).build()
    ev = MulticlassClassificationEvaluator(labelCol="label", metricName="accuracy")
    cv = CrossValidator(estimator=est, estimatorParamMaps=grid, evaluator=ev, numFolds=folds, foldCol=fold,
                        parallelism=PARALLEL_FITS).fit(train)
    return [(d, 1.0 - a) for d, a in zip(depths, cv.avgMetrics)], cv.bestModel


def tree_listing(model, spark) -> DataFrame:
    lines = model.toDebugString.splitlines()
    return spark.createDataFrame([(i, line.strip(), len(line) - len(line.lstrip())) for i, line in enumerate(lines)],
                                 "line int, rule string, indent int")


# Searches and ensembles --------------------------------------------------------------------

def auc_of(model, df: DataFrame) -> float:
    return float(BinaryClassificationEvaluator(labelCol="label", rawPredictionCol="rawPrediction").evaluate(model.transform(df)))


def random_order(combos: Sequence[dict], seed: str) -> list[dict]:
    """A repeatable random order of a small parameter grid."""
    import hashlib
    return sorted(combos, key=lambda c: hashlib.md5(f"{sorted(c.items())}-{seed}".encode()).hexdigest())


def out_of_fold(df: DataFrame, key: str, fold: str, folds: int, learners: dict[str, Callable[[DataFrame], object]]) -> DataFrame:
    """Out-of-fold scores of every learner, one column each, joined by key."""
    def one(name, k):
        m = learners[name](df.filter(F.col(fold) != k))
        return probability(m.transform(df.filter(F.col(fold) == k))).select(key, F.lit(name).alias("learner"), "score")
    out = None
    for d in in_parallel([lambda n=n, k=k: one(n, k) for n in learners for k in range(folds)]):
        out = d if out is None else out.unionByName(d)
    wide = out.groupBy(key).agg(*[F.max(F.when(F.col("learner") == n, F.col("score"))).alias(n) for n in learners])
    return df.select(key, "label").join(wide, key)


def convex_weights(df: DataFrame, names: Sequence[str], label: str) -> dict[str, float]:
    """Weights of the scores, none below zero and one in all, of least mean squared error. One pass
    gives the moments; every support of the few scores is solved in closed form, and the best one
    without a negative weight is the minimum."""
    k = len(names)
    sums = df.agg(*[F.avg(F.col(a) * F.col(b)).alias(f"g{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names)],
                  *[F.avg(F.col(a) * F.col(label)).alias(f"c{i}") for i, a in enumerate(names)]).first()
    g = np.array([[sums[f"g{i}_{j}"] for j in range(k)] for i in range(k)], float)
    c = np.array([sums[f"c{i}"] for i in range(k)], float)
    best, found = np.inf, np.zeros(k)
    for size in range(1, k + 1):
        for use in combinations(range(k), size):
            at = list(use)
            system = np.block([[g[np.ix_(at, at)], np.ones((size, 1))], [np.ones((1, size)), np.zeros((1, 1))]])
            w = np.linalg.lstsq(system, np.r_[c[at], 1.0], rcond=None)[0][:size]
            if w.min() < -1e-12:
                continue
            loss = w @ g[np.ix_(at, at)] @ w - 2 * w @ c[at]
            if loss < best - 1e-15:
                best, found = loss, np.zeros(k)
                found[at] = w
    return dict(zip(names, map(float, found), strict=True))


def network(train: DataFrame, layers: Sequence[int], seed: int = 1, limit: int = 400, tolerance: float = 1e-5):
    """The fitted network, its iterations, and whether the loss settled before the limit."""
    scaled = StandardScaler(inputCol="features", outputCol="scaled", withMean=True)
    net = MultilayerPerceptronClassifier(labelCol="label", featuresCol="scaled", layers=list(layers), maxIter=limit, tol=tolerance, seed=seed)
    model = Pipeline(stages=[scaled, net]).fit(train)
    steps = model.stages[-1].summary().totalIterations
    return model, steps, steps < limit


def agreement(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Counts by (actual, first prediction, second prediction)."""
    j = a.select(key, "label", F.col("prediction").alias("first")).join(b.select(key, F.col("prediction").alias("second")), key)
    return j.groupBy("label", "first", "second").agg(F.count(F.lit(1)).alias("n"))


def subsets(columns: Sequence[str], sizes: Sequence[int], each: int) -> list[list[str]]:
    """Random variable subsets, repeatable."""
    rng = np.random.default_rng(123)
    return [sorted(rng.choice(list(columns), s, replace=False).tolist()) for s in sizes for _ in range(each)]
