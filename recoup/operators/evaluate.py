"""Evaluation of scores: confusion, ROC, separation, calibration, weight of evidence, score bands."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recoup.functions import dist
from recoup.functions.columns import ratio
from recoup.operators import bands, ranks


def confusion(df: DataFrame, actual: str, predicted: str | Column) -> DataFrame:
    """tp, fn, fp, tn and the measures built on them."""
    p = F.col(predicted) if isinstance(predicted, str) else predicted
    a = F.col(actual)
    c = df.agg(F.count_if((a == 1) & (p == 1)).alias("tp"), F.count_if((a == 1) & (p == 0)).alias("fn"),
               F.count_if((a == 0) & (p == 1)).alias("fp"), F.count_if((a == 0) & (p == 0)).alias("tn"))

    def share(num, *den):
        return ratio(F.col(num).cast("double"), sum((F.col(d) for d in den[1:]), F.col(den[0])).cast("double"))

    total = F.col("tp") + F.col("fn") + F.col("fp") + F.col("tn")
    return c.withColumns({
        "accuracy": ratio((F.col("tp") + F.col("tn")).cast("double"), total.cast("double")),
        "sensitivity": share("tp", "tp", "fn"), "specificity": share("tn", "tn", "fp"),
        "precision": share("tp", "tp", "fp")})


def prior(df: DataFrame, target: str) -> float:
    return float(df.agg(F.avg(target)).first()[0])


def by_score(df: DataFrame, score: str, target: str) -> DataFrame:
    """Good and bad counts per distinct score: the map-side step of every curve below."""
    return df.groupBy(F.col(score).alias("score")).agg(
        F.sum(target).alias("good"), (F.count(F.lit(1)) - F.sum(target)).alias("bad"),
        F.count(F.lit(1)).alias("n"))


def roc(df: DataFrame, score: str, target: str) -> DataFrame:
    """True and false positive rates at every distinct score, highest first."""
    s = by_score(df, score, target)
    g, b = s.agg(F.sum("good"), F.sum("bad")).first()
    c = ranks.cumulate(s, "score", {"g": "good", "b": "bad"}, descending=True)
    return c.select("score", ratio(F.col("g").cast("double"), F.lit(float(g or 0))).alias("tpr"),
                    ratio(F.col("b").cast("double"), F.lit(float(b or 0))).alias("fpr"))


def auc(df: DataFrame, score: str, target: str) -> DataFrame:
    """Area under the curve by the rank sum, and the Gini index; ties share their rank."""
    s = by_score(df, score, target)
    c = ranks.cumulate(s, "score", {"upto": "n"})
    rank = F.col("upto") - (F.col("n") - 1) / 2.0
    g, b = F.sum("good").cast("double"), F.sum("bad").cast("double")
    a = c.agg(ratio(F.sum(F.col("good") * rank) - g * (g + 1) / 2.0, g * b).alias("auc"))
    return a.withColumn("gini", F.col("auc") * 2 - 1)


def class_shares(df: DataFrame, band: Column, target: str) -> DataFrame:
    """Share of the goods and of the bads in every band."""
    t = df.groupBy(band.alias("band")).agg(F.sum(target).alias("g"), F.count(F.lit(1)).alias("n"))
    total = df.agg(F.sum(target), F.count(F.lit(1))).first()
    good = float(total[0] or 0)
    return t.select("band", ratio(F.col("g").cast("double"), F.lit(good)).alias("PrGood"),
                    ratio((F.col("n") - F.col("g")).cast("double"), F.lit(float(total[1] - good))).alias("PrBad"))


def separation_fixed(df: DataFrame, score: str, target: str, width: float = 0.05) -> DataFrame:
    n = int(round(1 / width))
    return class_shares(df, bands.equal_width(score, 0.0, width, n), target)


def separation(df: DataFrame, score: str, target: str, ncut: int = 10) -> DataFrame:
    return class_shares(df, bands.cut(score, bands.edges(df, score, ncut), True), target)


def calibration(df: DataFrame, score: str, target: str, ncut: int = 10) -> DataFrame:
    """Observed and expected goods and bads by quantile band of the score."""
    n = df.count()
    t = df.groupBy(bands.cut(score, bands.edges(df, score, ncut), True).alias("band")).agg(
        F.sum(target).cast("double").alias("ObsGood"), F.count(F.lit(1)).cast("double").alias("n"),
        F.sum(score).alias("ExpGood"))
    return t.select("band", (F.col("ObsGood") / F.lit(float(n))).alias("share_of_total"),
                    (F.col("ObsGood") / F.col("n")).alias("rate_in_band"), "ObsGood",
                    (F.col("n") - F.col("ObsGood")).alias("ObsBad"), "ExpGood",
                    (F.col("n") - F.col("ExpGood")).alias("ExpBad"))


def hosmer_lemeshow(df: DataFrame, score: str, target: str, ncut: int = 10, df_: int | None = None) -> dict:
    """Statistic and p value; the degrees of freedom stay ncut - 1 even if bands collapse."""
    t = calibration(df, score, target, ncut)
    term = (ratio(F.pow(F.col("ObsGood") - F.col("ExpGood"), F.lit(2)), F.col("ExpGood"))
            + ratio(F.pow(F.col("ObsBad") - F.col("ExpBad"), F.lit(2)), F.col("ExpBad")))
    h = float(t.agg(F.sum(term)).first()[0])
    d = df_ if df_ is not None else ncut - 1
    return {"HL": h, "df": d, "p": dist.chi2_sf(h, d)}


def woe_table(df: DataFrame, column: str, target: str, ncut: int = 10) -> tuple[DataFrame, list[float]]:
    """Weight of evidence per quantile band with half a case added to each side."""
    e = bands.edges(df, column, ncut)
    g, n = df.agg(F.sum(target), F.count(F.lit(1))).first()
    good, bad = F.lit(float(g)), F.lit(float(n - g))
    t = df.groupBy(bands.cut(column, e, True).alias("band")).agg(
        F.sum(target).alias("_g"), F.count(F.lit(1)).alias("n"))
    pg, pb = (F.col("_g") + 0.5) / good, (F.col("n") - F.col("_g") + 0.5) / bad
    return t.select("band", "n", F.log(pg / pb).alias("WoE"), (pg - pb).alias("Diff")), e


def information_value(table: DataFrame) -> DataFrame:
    return table.agg(F.sum(F.col("Diff") * F.col("WoE")).alias("IV"))


def add_woe(df: DataFrame, column: str, target: str, ncut: int = 10) -> DataFrame:
    """The frame with ``<column>_WoE``; a handful of band values becomes an expression, no join."""
    t, e = woe_table(df, column, target, ncut)
    values = {r["band"]: float(r["WoE"]) for r in t.collect()}  # at most ncut + 1 rows
    band = bands.cut(column, e, True)
    out = F.lit(None).cast("double")
    for b, v in values.items():
        out = F.when(band.isNull() if b is None else band == b, F.lit(v)).otherwise(out)
    return df.withColumn(f"{column}_WoE", out)


def merge_bands(df: DataFrame, code: str, cond: Column) -> DataFrame:
    """Rows that meet the condition all take the mean of their codes."""
    m = df.filter(cond).agg(F.avg(code)).first()[0]
    return df.withColumn(code, F.when(cond, F.lit(m)).otherwise(F.col(code))) if m is not None else df


def shape(df: DataFrame, column: str, target: str, ncut: int = 10) -> DataFrame:
    """Success share of all rows, rate within the band, and logit by quantile band."""
    n = df.count()
    t = df.groupBy(bands.cut(column, bands.edges(df, column, ncut), True).alias("band")).agg(
        F.sum(target).cast("double").alias("g"), F.count(F.lit(1)).cast("double").alias("m"))
    return t.select("band", (F.col("g") / F.lit(float(n))).alias("share_of_total"),
                    (F.col("g") / F.col("m")).alias("rate_in_band"),
                    F.when((F.col("g") > 0) & (F.col("g") < F.col("m")),
                           F.log(F.col("g") / F.nullif(F.col("m") - F.col("g"), F.lit(0.0)))).alias("logit"))


def score_bands(train: DataFrame, score: str, pay: str, debt: str, target: str, ncut: int):
    """Quantile bands of the training scores with their recovery, and a function that places
    new rows: each takes the last band whose lowest training score it reaches, with the first
    band open below and the last open above. One row per band reaches the driver."""
    e = bands.edges(train, score, ncut)
    table = (
        train.withColumn("band", bands.cut(score, e, include_lowest=True))
        .groupBy("band").agg((F.sum(pay) / F.sum(debt)).alias("SR"), F.avg(target).alias("SR_Suc"),
                             F.min(score).alias("Min"), F.count(F.lit(1)).alias("N")))
    rows = table.orderBy("Min").collect()
    uppers = [r["Min"] for r in rows[1:]] + [None]

    def place(df: DataFrame) -> DataFrame:
        def by(values):
            return bands.lookup(score, list(zip(uppers, values)))
        return df.withColumns({
            "band": by([r["band"] for r in rows]).cast("int"),
            "predSR": by([float(r["SR"]) for r in rows]),
            "predSR_Suc": by([float(r["SR_Suc"]) for r in rows])})

    return table, place


def recovery_prediction(train: DataFrame, new: DataFrame, score: str, pay: str, debt: str, target: str,
                        ncut: int = 10) -> tuple[DataFrame, DataFrame]:
    """Predicted against real recovery by band of new rows, and the overall deviation."""
    _, place = score_bands(train, score, pay, debt, target, ncut)
    placed = place(new)
    table = placed.groupBy("band", "predSR", "predSR_Suc").agg(
        F.count(F.lit(1)).alias("N"), (F.sum(pay) / F.sum(debt)).alias("SR"),
        F.avg(target).alias("SR_Suc"), F.min(score).alias("Min"))
    real = F.sum(pay) / F.sum(debt)
    expected = F.sum(F.col("predSR") * F.col(debt)) / F.sum(debt)
    return table, placed.agg(ratio(real - expected, real).alias("srDev"))
