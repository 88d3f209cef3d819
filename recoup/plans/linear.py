"""Linear, logistic and additive models."""
from __future__ import annotations

import math

from pyspark.sql import functions as F

from recoup.functions import dist
from recoup.functions.columns import n_rows, rnd
from recoup.functions.keys import fold
from recoup.operators import bands, evaluate, features, frame, gram, logit, profile, ranks, sampling
from recoup.plans.fixture_sql import md, un
from recoup.plans.registry import query
from recoup.session import stored

X = ["TOA", "Principal", "DPD", "M_LastPaymentToImportDate", "Age", "SignedAgreement", "Reach", "NoCallClient",
     "NoLetRec", "NoPay"]


def regression_set(t):
    """Paying natural persons with six months of behaviour and the following six months' payments."""
    c = t.cases.filter("Age <> -1 AND TOA >= 100 AND DPD >= 100 AND LastPaymentAmount > 0").dropna("any")
    d = (c.join(features.behaviour6(t.case_events), "CaseId").join(features.pay712(t.case_events), "CaseId"))
    return d.withColumns({
        "IfCard": (F.col("Product") == "Credit card").cast("int"),
        "IfWoman": (F.col("Gender") == "FEMALE").cast("int"),
        "LstPay_2": (bands.cut("LastPaymentAmount", bands.PAYMENT_BREAKS) == 2).cast("int"),
        "LstPay_3": (bands.cut("LastPaymentAmount", bands.PAYMENT_BREAKS) == 3).cast("int")})


SET = """rs AS (SELECT * FROM cases JOIN pay712 USING (CaseId) JOIN (SELECT CaseId, NoPay, NoCallClient FROM behaviour6) USING (CaseId)
 WHERE Age <> -1 AND TOA >= 100 AND DPD >= 100 AND LastPaymentAmount > 0 AND Other IS NOT NULL AND ExternalAgency IS NOT NULL AND Gender IS NOT NULL
 AND M_LastPaymentToImportDate IS NOT NULL AND Land IS NOT NULL AND PopulationInCity IS NOT NULL)"""
FIT2 = SET + """, mm AS (SELECT count(*)::double AS n, avg(TOA) AS m1, avg(NoPay) AS m2, avg(Pay712log) AS my, var_pop(TOA)*count(*) AS s11, var_pop(NoPay)*count(*) AS s22,
 covar_pop(TOA,NoPay)*count(*) AS s12, covar_pop(TOA,Pay712log)*count(*) AS s1y, covar_pop(NoPay,Pay712log)*count(*) AS s2y, var_pop(Pay712log)*count(*) AS tss FROM rs),
bb AS (SELECT *, (s22*s1y-s12*s2y)/(s11*s22-s12*s12) AS b1, (s11*s2y-s12*s1y)/(s11*s22-s12*s12) AS b2 FROM mm),
ff AS (SELECT *, my-b1*m1-b2*m2 AS b0, tss-b1*s1y-b2*s2y AS rss, s11*s22-s12*s12 AS det FROM bb)"""


def fit2(t):
    d = regression_set(t)
    return d, gram.ols(gram.moments(d, ["TOA", "NoPay", "Pay712log"]), "Pay712log", ["TOA", "NoPay"])


def frame_of(t, rows, schema):
    """A small fitted summary as a frame; numpy scalars become plain numbers."""
    plain = [tuple(v.item() if hasattr(v, "item") else v for v in r) for r in rows]
    return t.spark.createDataFrame(plain, schema)


@query("l1_least_squares", f"""
WITH {FIT2} SELECT CaseId, round(b0+b1*TOA+b2*NoPay,6) AS fitted, round(Pay712log-(b0+b1*TOA+b2*NoPay),6) AS resid FROM rs, ff""")
def l1(t):
    d, f = fit2(t)
    return d.select("CaseId", rnd(f.prediction()).alias("fitted"), rnd(F.col("Pay712log") - f.prediction()).alias("resid"))


@query("l1_least_squares_all_variables")
def l1b(t):
    d = regression_set(t)
    f = gram.ols(gram.moments(d, [*X, "IfCard", "Pay712log"]), "Pay712log", [*X, "IfCard"])
    return d.select("CaseId", f.prediction().alias("fitted"), (F.col("Pay712log") - f.prediction()).alias("resid"))


@query("l2_fit_statistics", f"""
WITH {FIT2} SELECT n, round(rss,4) AS rss, round(sqrt(rss/(n-3)),6) AS rse, round(tss,4) AS tss, round(1-rss/tss,6) AS r2,
 round(1-(rss/(n-3))/(tss/(n-1)),6) AS adj_r2, round(((tss-rss)/2)/(rss/(n-3)),4) AS f FROM ff""")
def l2(t):
    s = fit2(t)[1].summary()
    return frame_of(t, [(s["n"], round(s["rss"], 4), round(s["rse"], 6), round(s["tss"], 4), round(s["r2"], 6),
                         round(s["adj_r2"], 6), round(s["f"], 4))],
                    "n double, rss double, rse double, tss double, r2 double, adj_r2 double, f double")


@query("l3_coefficients", f"""
WITH {FIT2}, v AS (SELECT *, rss/(n-3) AS s2 FROM ff), c AS (
 SELECT '(Intercept)' AS term, b0 AS estimate, sqrt(s2*(1/n + (m1*m1*s22 - 2*m1*m2*s12 + m2*m2*s11)/det)) AS se FROM v
 UNION ALL SELECT 'TOA', b1, sqrt(s2*s22/det) FROM v UNION ALL SELECT 'NoPay', b2, sqrt(s2*s11/det) FROM v)
SELECT term, round(estimate,8) AS estimate, round(se,8) AS se, round(estimate/se,4) AS t FROM c""")
def l3(t):
    rows = [(c["term"], round(c["estimate"], 8), round(c["se"], 8), round(c["t"], 4)) for c in fit2(t)[1].coefficients()]
    return frame_of(t, rows, "term string, estimate double, se double, t double")


@query("l3_coefficient_limits")
def l3b(t):
    d = regression_set(t)
    f = gram.ols(gram.moments(d, [*X, "IfCard", "Pay712log"]), "Pay712log", [*X, "IfCard"])
    return frame_of(t, [tuple(c.values()) for c in f.coefficients()],
                    "term string, estimate double, se double, t double, p double, low double, high double, contains_zero boolean")


@query("l4_scale_invariance", f"""
WITH {FIT2} SELECT round(max(abs(b0+b1*TOA+b2*NoPay - (b0+(b1*1000)*(TOA/1000)+b2*NoPay))),6) AS largest_difference FROM rs, ff""")
def l4(t):
    d = regression_set(t).withColumn("TOAk", F.col("TOA") / 1000)
    m = gram.moments(d, ["TOA", "TOAk", "NoPay", "Pay712log"])
    a, b = gram.ols(m, "Pay712log", ["TOA", "NoPay"]), gram.ols(m, "Pay712log", ["TOAk", "NoPay"])
    return d.agg(rnd(F.max(F.abs(a.prediction() - b.prediction()))).alias("largest_difference"))


@query("l5_nested_f_test")
def l5(t):
    m = gram.moments(regression_set(t), [*X, "IfCard", "Pay712log"])
    r = gram.nested_f(gram.ols(m, "Pay712log", X[:5]), gram.ols(m, "Pay712log", [*X, "IfCard"]))
    return frame_of(t, [tuple(float(v) for v in r.values())], "df double, df_resid double, f double, p double")


@query("l5_nested_f_test_two", f"""
WITH {FIT2} SELECT 1e0 AS df, n-3 AS df_resid, round((tss-s1y*s1y/s11-rss)/(rss/(n-3)),4) AS f FROM ff""")
def l5b(t):
    """The test of one added column, in closed form on the other side."""
    m = gram.moments(regression_set(t), ["TOA", "NoPay", "Pay712log"])
    r = gram.nested_f(gram.ols(m, "Pay712log", ["TOA"]), gram.ols(m, "Pay712log", ["TOA", "NoPay"]))
    return frame_of(t, [(float(r["df"]), float(r["df_resid"]), round(float(r["f"]), 4))], "df double, df_resid double, f double")


@query("l6_factor_interaction_polynomial")
def l6(t):
    d = regression_set(t)
    d = d.withColumn("Reach_x_NoCallClient", F.col("Reach") * F.col("NoCallClient"))
    d = d.withColumns(frame.poly_terms(d, "TOA", 3))
    base = [*X[1:], "IfCard", "LstPay_2", "LstPay_3"]
    m = gram.moments(d, [*base, "TOA", "Reach_x_NoCallClient", "TOA_p1", "TOA_p2", "TOA_p3", "Pay712log"])
    models = {"dummies": ["TOA", *base], "interaction": ["TOA", *base, "Reach_x_NoCallClient"],
              "poly2": ["TOA_p1", "TOA_p2", *base, "Reach_x_NoCallClient"],
              "poly3": ["TOA_p1", "TOA_p2", "TOA_p3", *base, "Reach_x_NoCallClient"]}
    rows = []
    for name, x in models.items():
        s = gram.ols(m, "Pay712log", x).summary()
        rows.append((name, len(x), s["rss"], s["r2"], s["adj_r2"], s["f"], s["p"]))
    return frame_of(t, rows, "model string, terms int, rss double, r2 double, adj_r2 double, f double, p double")


@query("l7_variance_inflation", f"""
WITH {SET}, r AS (SELECT corr(TOA,Principal) AS r FROM rs) SELECT 'TOA' AS term, round(1/(1-r*r),4) AS gvif FROM r UNION ALL SELECT 'Principal', round(1/(1-r*r),4) FROM r""")
def l7(t):
    m = gram.moments(regression_set(t), ["TOA", "Principal"])
    return frame_of(t, [(v["term"], round(v["gvif"], 4)) for v in gram.vif(m, {"TOA": ["TOA"], "Principal": ["Principal"]})],
                    "term string, gvif double")


@query("l7_generalised_variance_inflation")
def l7b(t):
    m = gram.moments(regression_set(t), [*X, "LstPay_2", "LstPay_3"])
    v = gram.vif(m, {**{c: [c] for c in X}, "LstPayBand": ["LstPay_2", "LstPay_3"]})
    return frame_of(t, [tuple(r.values()) for r in v], "term string, gvif double, df int, scaled double")


FIT1 = SET + """, mm AS (SELECT count(*)::double AS n, avg(TOA) AS m1, regr_slope(Pay712log,TOA) AS b1, regr_intercept(Pay712log,TOA) AS b0, var_pop(TOA)*count(*) AS sxx,
 var_pop(Pay712log)*count(*)*(1-pow(corr(Pay712log,TOA),2)) AS rss FROM rs),
ee AS (SELECT CaseId, Pay712log-b0-b1*TOA AS e, b0+b1*TOA AS fitted, TOA, 1/n+pow(TOA-m1,2)/sxx AS h, n, rss FROM rs, mm)"""


def fit1(t):
    d = regression_set(t)
    return d, gram.ols(gram.moments(d, ["TOA", "Pay712log"]), "Pay712log", ["TOA"])


@query("l8_influence", f"""
WITH {FIT1} SELECT CaseId, round(h,8) AS leverage, round(e/sqrt((rss-e*e/(1-h))/(n-3)*(1-h)),6) AS rstudent, round(e*e*h/(2*rss/(n-2)*(1-h)*(1-h)),8) AS cook FROM ee""")
def l8(t):
    i = gram.influence(*fit1(t))
    return i.select("CaseId", rnd("leverage", 8).alias("leverage"), rnd("rstudent").alias("rstudent"), rnd("cook", 8).alias("cook"))


@query("l8_influential_count", f"WITH {FIT1} SELECT count(*) AS n FROM ee WHERE e*e*h/(2*rss/(n-2)*(1-h)*(1-h)) > 4/n")
def l8b(t):
    d, f = fit1(t)
    return gram.influence(d, f).filter(F.col("cook") > F.lit(4.0 / f.m.n)).agg(n_rows())


@query("l9_durbin_watson", f"""
WITH {FIT1} SELECT round(sum(d*d)/sum(e*e),6) AS dw FROM (SELECT e, e - lag(e) OVER (ORDER BY CaseId) AS d FROM ee)""")
def l9(t):
    d, f = fit1(t)
    r = d.select("CaseId", (F.col("Pay712log") - f.prediction()).alias("e"))
    p = ranks.ordered_position(r, "CaseId", "CaseId", "i").select("i", "e")
    prev = p.select((F.col("i") + 1).alias("i"), F.col("e").alias("before"))
    diff = F.col("e") - F.col("before")
    return p.join(prev, "i", "left").agg(rnd(F.sum(diff * diff) / F.sum(F.col("e") * F.col("e"))).alias("dw"))


@query("l10_constant_variance", f"""
WITH {FIT1}, u AS (SELECT e*e/(rss/n) AS u, e*e AS e2, fitted, TOA FROM ee),
s AS (SELECT regr_sxx(u, fitted)*pow(regr_slope(u, fitted),2)/2 AS score, count(*)*pow(corr(e2,TOA),2) AS bp, pow(corr(e2,TOA),2) AS r2, count(*) AS n FROM u)
SELECT 'score' AS test, round(score,4) AS statistic FROM s UNION ALL SELECT 'breusch_pagan', round(bp,4) FROM s UNION ALL SELECT 'f', round(r2/((1-r2)/(n-2)),4) FROM s""")
def l10(t):
    return constant_variance(t).select("test", rnd("statistic", 4).alias("statistic"))


@query("l10_constant_variance_p")
def l10b(t):
    return constant_variance(t)


def constant_variance(t):
    d, f = fit1(t)
    e2 = F.pow(F.col("Pay712log") - f.prediction(), F.lit(2))
    r = d.select("TOA", f.prediction().alias("fitted"), e2.alias("e2"), (e2 / F.lit(f.rss / f.m.n)).alias("u"))
    m = gram.moments(r, ["TOA", "fitted", "e2", "u"])
    score = gram.ols(m, "u", ["fitted"])
    s1 = (score.tss - score.rss) / 2.0
    s2 = gram.ols(m, "e2", ["TOA"]).summary()
    bp = s2["r2"] * m.n
    return frame_of(t, [("score", s1, dist.chi2_sf(s1, 1)), ("breusch_pagan", bp, dist.chi2_sf(bp, 1)), ("f", s2["f"], s2["p"])],
                    "test string, statistic double, p double")


@query("l11_normality")
def l11(t):
    from pyspark.ml.stat import KolmogorovSmirnovTest
    d, f = fit1(t)
    z = d.select(((F.col("Pay712log") - f.prediction()) / F.lit(math.sqrt(f.sigma2))).alias("z"))
    k = KolmogorovSmirnovTest.test(z, "z", "norm", 0.0, 1.0).first()
    s, u, n = z.agg(F.skewness("z"), F.kurtosis("z"), F.count(F.lit(1))).first()
    jb = n / 6.0 * (s * s + u * u / 4.0)
    return frame_of(t, [("kolmogorov_smirnov", float(k["statistic"]), float(k["pValue"])), ("skew_kurtosis", jb, dist.chi2_sf(jb, 2))],
                    "test string, statistic double, p double")


@query("l12_prediction_intervals")
def l12(t):
    d = regression_set(t)
    x = ["TOA", "DPD", "Age", "NoPay"]
    f = gram.ols(gram.moments(d, [*x, "Pay712log"]), "Pay712log", x)
    med = {r["variable"]: r["q"] for r in ranks.exact_quantiles(d, x[1:], [0.5]).collect()}
    g = frame.regular_grid(d, "TOA", 101).withColumns({c: F.lit(v) for c, v in med.items()})
    q = dist.t_ppf(0.975, f.df)
    h, s2 = f.leverage(), F.lit(f.sigma2)
    g = g.withColumns({"fit": f.prediction(), "_c": F.sqrt(s2 * h) * q, "_p": F.sqrt(s2 * (1 + h)) * q})
    return g.select("TOA", "fit", (F.col("fit") - F.col("_c")).alias("conf_low"), (F.col("fit") + F.col("_c")).alias("conf_high"),
                    (F.col("fit") - F.col("_p")).alias("pred_low"), (F.col("fit") + F.col("_p")).alias("pred_high"))


@query("l13_residual_smoother")
def l13(t):
    d, f = fit2(t)
    r = d.select(f.prediction().alias("fitted"), (F.col("Pay712log") - f.prediction()).alias("resid"))
    grid = sorted(set(ranks.quantile_list(r, "fitted", [i / 20 for i in range(21)])))
    return profile.smoother(r, "fitted", "resid", 2 / 3, grid)


SEL = [*X, "IfCard", "IfWoman"]
#: All variables; a column that follows from those before it is left out of the search.
ALL = ["TOA", "Principal", "Interest", "Other", "LoanAmount", "D_ContractDateToImportDate", "DPD", "ExternalAgency", "Bailiff", "ClosedExecution",
       "Age", "LastPaymentAmount", "M_LastPaymentToImportDate", "GDPPerCapita", "MeanSalary", "PopulationInCity", "LegalTransfer", "SignedAgreement",
       "Reach", "NoCallClient", "NoLetRec", "NoPay", "Pay6", "IfCard", "IfWoman", "LstPay_2", "LstPay_3"]


def selection_table(t):
    m = gram.moments(regression_set(t), [*ALL, "Pay712log"])
    return [r for method in ("exhaustive", "forward", "backward") for r in gram.selection(m, "Pay712log", ALL, method)]


# Size 1 is the largest squared correlation; size 2 the best pair from the correlations of all pairs.
SIZES = "WITH " + SET.replace("JOIN (SELECT CaseId, NoPay, NoCallClient FROM behaviour6) USING (CaseId)", "JOIN behaviour6 USING (CaseId)") + f""",
wide AS (SELECT Pay712log, {", ".join(f"cast({c} as double) AS {c}" for c in ALL if c not in ("IfCard", "IfWoman", "LstPay_2", "LstPay_3"))},
  cast(Product = 'Credit card' as double) AS IfCard, cast(Gender = 'FEMALE' as double) AS IfWoman,
  cast(LastPaymentAmount > 50 AND LastPaymentAmount <= 300 as double) AS LstPay_2, cast(LastPaymentAmount > 300 as double) AS LstPay_3 FROM rs),
tall AS (UNPIVOT (SELECT row_number() OVER () AS r, * FROM wide) ON {", ".join(ALL)} INTO NAME v VALUE x),
one AS (SELECT v, corr(x, Pay712log) AS ry FROM tall GROUP BY v),
two AS (SELECT a.v AS v, b.v AS w, corr(a.x, b.x) AS rx FROM tall AS a JOIN tall AS b ON a.r = b.r AND a.v < b.v GROUP BY a.v, b.v)
SELECT 1 AS size, round(max(ry * ry), 8) AS r2 FROM one
UNION ALL SELECT 2, round(max((p.ry * p.ry + q.ry * q.ry - 2 * p.ry * q.ry * rx) / (1 - rx * rx)), 8)
FROM two JOIN one AS p ON p.v = two.v JOIN one AS q ON q.v = two.w WHERE 1 - rx * rx > 1e-9"""


@query("l14_best_subset_small", SIZES)
def l14b(t):
    m = gram.moments(regression_set(t), [*ALL, "Pay712log"])
    return frame_of(t, [(r["size"], round(r["r2"], 8)) for r in gram.selection(m, "Pay712log", ALL, "exhaustive", 2)], "size int, r2 double")


@query("l14_variable_selection")
def l14(t):
    return frame_of(t, [tuple(r.values()) for r in selection_table(t)],
                    "method string, size int, variables string, r2 double, adj_r2 double, cp double, bic double")


@query("l15_chosen_variables")
def l15(t):
    return frame_of(t, [tuple(r.values()) for r in gram.chosen(selection_table(t))],
                    "method string, criterion string, variable string")


def _path(t, alpha):
    m = gram.moments(regression_set(t), [*SEL, "Pay712log"])
    rows = []
    for r in gram.path(m, "Pay712log", SEL, gram.lambda_path(m, "Pay712log", SEL), alpha):
        rows += [(float(r["lambda"]), v, float(b)) for v, b in zip(["(Intercept)", *SEL], [r["intercept"], *r["coef"]])]
    return frame_of(t, rows, "lambda double, variable string, coefficient double")


@query("l16_ridge_path")
def l16(t):
    return _path(t, 0.0)


@query("l17_lasso_path")
def l17(t):
    return _path(t, 1.0)


def folds(t):
    d = regression_set(t).withColumn("fold", fold("CaseId", "cv", 10))
    return gram.group_moments(d, [*SEL, "Pay712log"], "fold")


@query("l18_penalty_by_cross_validation")
def l18(t):
    fm = folds(t)
    lams = gram.lambda_path(gram.pool(list(fm.values())), "Pay712log", SEL)
    rows = [(name, r["lambda"], r["mse"]) for name, a in (("ridge", 0.0), ("lasso", 1.0))
            for r in gram.cv_path(fm, "Pay712log", SEL, lams, a)]
    return frame_of(t, rows, "method string, lambda double, mse double")


@query("l19_component_regression")
def l19(t):
    return frame_of(t, [tuple(r.values()) for r in gram.cv_components(folds(t), "Pay712log", SEL, gram.component_regression)],
                    "ncomp int, rmsep double")


@query("l20_partial_least_squares")
def l20(t):
    return frame_of(t, [tuple(r.values()) for r in gram.cv_components(folds(t), "Pay712log", SEL, gram.partial_least_squares)],
                    "ncomp int, rmsep double")


@query("l21_hold_out_error", f"""
WITH {SET}, s AS (SELECT CaseId FROM rs ORDER BY {md('CaseId', 'ho')}, CaseId LIMIT (SELECT cast(floor(0.5*count(*)+1e-9) as bigint) FROM rs)),
a AS (SELECT * FROM rs WHERE CaseId IN (SELECT CaseId FROM s)), b AS (SELECT * FROM rs WHERE CaseId NOT IN (SELECT CaseId FROM s)),
p AS (SELECT avg(Pay712log) AS m, regr_slope(Pay712log,TOA) AS b1, regr_intercept(Pay712log,TOA) AS b0, regr_slope(Pay712log,NoPay) AS c1, regr_intercept(Pay712log,NoPay) AS c0 FROM a)
SELECT 'mean' AS model, round(avg(pow(Pay712log-m,2)),6) AS mse FROM b, p UNION ALL SELECT 'TOA', round(avg(pow(Pay712log-b0-b1*TOA,2)),6) FROM b, p
UNION ALL SELECT 'NoPay', round(avg(pow(Pay712log-c0-c1*NoPay,2)),6) FROM b, p""")
def l21(t):
    a, b = sampling.split(regression_set(t), "CaseId", "ho", 0.5)
    m = gram.moments(a, ["TOA", "NoPay", "Pay712log"])
    preds = {"mean": F.lit(float(m.mean[2])), **{v: gram.ols(m, "Pay712log", [v]).prediction() for v in ("TOA", "NoPay")}}
    return error_table(b, "Pay712log", preds)


def error_table(df, y, preds, digits=6):
    one = df.agg(*[F.avg(F.pow(F.col(y) - e, F.lit(2))).alias(f"e{i}") for i, e in enumerate(preds.values())])
    return one.select(F.explode(F.array(*[
        F.struct(F.lit(k).alias("model"), rnd(f"e{i}", digits).alias("mse")) for i, k in enumerate(preds)])).alias("r")).select("r.*")


@query("l21_hold_out_error_all_models")
def l21b(t):
    a, b = sampling.split(regression_set(t), "CaseId", "ho", 0.5)
    am = gram.group_moments(a.withColumn("fold", fold("CaseId", "cv", 10)), [*SEL, "Pay712log"], "fold")
    m, y = gram.pool(list(am.values())), "Pay712log"
    from recoup.functions.columns import linear

    def expr(pair):
        return linear(dict(zip(SEL, map(float, pair[1]))), pair[0])
    lams = gram.lambda_path(m, y, SEL)
    preds = {"full": gram.ols(m, y, SEL).prediction()}
    for method in ("forward", "backward"):
        best = min(gram.selection(m, y, SEL, method), key=lambda r: r["bic"])
        preds[method] = gram.ols(m, y, best["variables"].split(",")).prediction()
    for name, alpha in (("ridge", 0.0), ("lasso", 1.0)):
        lam = min(gram.cv_path(am, y, SEL, lams, alpha), key=lambda r: r["mse"])["lambda"]
        preds[name] = expr(gram.penalised(m, y, SEL, lam, alpha)[:2])
    for name, f in (("pcr", gram.component_regression), ("pls", gram.partial_least_squares)):
        k = min(gram.cv_components(am, y, SEL, f), key=lambda r: r["rmsep"])["ncomp"]
        preds[name] = expr(f(m, y, SEL, k))
    return error_table(b, y, preds)


LX = ["TOA", "Principal", "Interest", "D_ContractDateToImportDate", "DPD", "Age", "Repayment", "IfWoman", "Bailiff"]


def scoring_set(t):
    """Complete cash loans with the six-month success target, stored because fits read it often."""
    d = (features.loans(t.cases).filter("LoanAmount >= Principal")
         .join(features.success6(t.case_events, t.cases).select("CaseId", "Payments", "Suc"), "CaseId"))
    return d.withColumns({"Repayment": 1 - F.col("Principal") / F.col("LoanAmount"),
                          "IfWoman": (F.col("Gender") == "FEMALE").cast("int")}).select(
        "CaseId", "TOA", "Principal", "Interest", "LoanAmount", "D_ContractDateToImportDate", "DPD", "Age", "Repayment", "IfWoman",
        "Bailiff", "ClosedExecution", "Payments", "Suc")


def train_test(t):
    d = stored(scoring_set(t), "scoring")
    return sampling.split(d, "CaseId", "trn", 0.6)


@query("l22_logistic_fit")
def l22(t):
    f = logit.fit(stored(scoring_set(t), "scoring"), "Suc", LX)
    return frame_of(t, [tuple(c.values()) for c in f.coefficients()],
                    "term string, estimate double, se double, z double, p double, low double, high double, odds_ratio double")


# The scoring set, and its sums that a logistic fit with a constant has to meet.
SCORING = """sc AS (SELECT l.*, 1 - Principal/LoanAmount AS Repayment, cast(Gender = 'FEMALE' as int) AS IfWoman, Suc
 FROM loans AS l JOIN (SELECT CaseId, Suc FROM success6) USING (CaseId) WHERE LoanAmount >= Principal)"""


@query("l22_score_equations", f"WITH {SCORING} " + " UNION ALL ".join(
    f"SELECT '{c}' AS term, round(cast(sum({x}*Suc) as double),2) AS observed, 1e0 AS ratio FROM sc" for c, x in [("(Intercept)", "1"), *[(c, c) for c in LX]]))
def l22b(t):
    """At the fit the fitted probabilities add up to the ones, weighted by every column."""
    d = stored(scoring_set(t), "scoring")
    p = logit.fit(d, "Suc", LX).probability()
    terms = [("(Intercept)", F.lit(1.0)), *[(c, F.col(c).cast("double")) for c in LX]]
    r = d.withColumn("_p", p).agg(*[f for i, (_, x) in enumerate(terms) for f in (F.sum(x * F.col("Suc")).alias(f"y{i}"), F.sum(x * F.col("_p")).alias(f"p{i}"))]).first()
    return frame_of(t, [(c, round(r[f"y{i}"], 2), round(r[f"p{i}"] / r[f"y{i}"], 5)) for i, (c, _) in enumerate(terms)], "term string, observed double, ratio double")


@query("l23_mean_scores", f"WITH {SCORING} SELECT count(*) AS n, round(avg(Suc),6) AS rate, round(avg(Suc),6) AS linear, round(avg(Suc),6) AS logistic FROM sc")
def l23b(t):
    """Both fits have the mean of the target."""
    d = l23(t)
    return d.agg(F.count(F.lit(1)).alias("n"), rnd(F.avg("Suc")).alias("rate"), rnd(F.avg("linear")).alias("linear"), rnd(F.avg("logistic")).alias("logistic"))


@query("l23_linear_and_logistic")
def l23(t):
    d = stored(scoring_set(t), "scoring")
    a = gram.ols(gram.moments(d, ["TOA", "Suc"]), "Suc", ["TOA"])
    b = logit.fit(d, "Suc", ["TOA"])
    return d.select("CaseId", "TOA", "Suc", a.prediction().alias("linear"), b.probability().alias("logistic"))


@query("l24_logistic_residuals")
def l24(t):
    d = stored(scoring_set(t), "scoring")
    return logit.residuals(d, "Suc", logit.fit(d, "Suc", LX)).select("CaseId", "Suc", "fitted", "response", "deviance")


def _steps(t, direction, bic):
    d = stored(scoring_set(t), "scoring")
    k = math.log(d.count()) if bic else 2.0
    _, trace = logit.stepwise(d, "Suc", LX, direction, k)
    return frame_of(t, [tuple(r.values()) for r in trace], "step int, move string, aic double")


@query("l25_stepwise_forward_aic")
def l25a(t):
    return _steps(t, "forward", False)


@query("l25_stepwise_backward_bic")
def l25b(t):
    return _steps(t, "backward", True)


@query("l25_stepwise_both_aic")
def l25c(t):
    return _steps(t, "both", False)


SMOOTH = ["TOA", "DPD", "Age"]


@query("l26_additive_fit")
def l26(t):
    trn, tst = train_test(t)
    f = logit.fit_additive(trn, "Suc", SMOOTH, ["IfWoman", "Bailiff"])
    return tst.select("CaseId", "Suc", f.probability().alias("probability"))


@query("l27_additive_steps")
def l27(t):
    trn, _ = train_test(t)
    _, trace = logit.step_additive(trn, "Suc", SMOOTH, ["IfWoman", "Bailiff"])
    return frame_of(t, [tuple(r.values()) for r in trace], "step int, move string, aic double")


@query("l28_effect_sizes")
def l28(t):
    trn, _ = train_test(t)
    return logit.effect_sizes(trn, logit.fit_additive(trn, "Suc", SMOOTH, ["IfWoman", "Bailiff"]))


@query("l29_effects_train_and_test")
def l29(t):
    trn, tst = train_test(t)
    return logit.effect_curves(trn, tst, logit.fit_additive(trn, "Suc", SMOOTH, ["IfWoman", "Bailiff"]))


@query("e15_fold_sizes", f"WITH {SCORING} SELECT cast({un('CaseId', 'cv')} % 10 as int) AS fold, count(*) AS n, cast(sum(Suc) as bigint) AS ones FROM sc GROUP BY 1")
def e15b(t):
    """Rows and ones that the models of the folds are scored on."""
    d = scoring_set(t).withColumn("fold", fold("CaseId", "cv", 10))
    return d.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.sum("Suc").cast("bigint").alias("ones"))


@query("e15_cross_validated_roc")
def e15(t):
    d = stored(scoring_set(t).withColumn("fold", fold("CaseId", "cv", 10)), "scoring")
    fits = logit.fit_many(d, "Suc", [logit.Spec(LX, skip_fold=k) for k in range(10)], fold="fold")
    score = F.lit(None).cast("double")
    for k, f in enumerate(fits):
        score = F.when(F.col("fold") == k, f.probability()).otherwise(score)
    s = d.withColumn("score", score).groupBy("fold", "score").agg(
        F.sum("Suc").alias("g"), (F.count(F.lit(1)) - F.sum("Suc")).alias("b"))
    c = ranks.cumulate(s, "score", {"G": "g", "B": "b"}, ["fold"], descending=True)
    total = c.groupBy("fold").agg(F.max("G").alias("g1"), F.max("B").alias("b1"))
    return c.join(total, "fold").select("fold", "score", (F.col("G") / F.col("g1")).alias("tpr"), (F.col("B") / F.col("b1")).alias("fpr"))


@query("e16_leaderboard", """
WITH p AS (SELECT Suc, TOA, score, CASE WHEN Product='Credit card' THEN 1e0 ELSE 0e0 END AS card FROM scored), pr AS (SELECT avg(Suc) AS q FROM scored),
m AS (SELECT 'score' AS model, Suc, score AS s FROM p UNION ALL SELECT 'debt', Suc, 1-TOA/50000e0 FROM p UNION ALL SELECT 'card', Suc, card FROM p),
r AS (SELECT model, Suc, s, rank() OVER (PARTITION BY model ORDER BY s) + (count(*) OVER (PARTITION BY model, s)-1)/2e0 AS r FROM m),
a AS (SELECT model, (sum(r) FILTER (Suc=1) - sum(Suc)*(sum(Suc)+1)/2e0)/(cast(sum(Suc) as double)*(count(*)-sum(Suc))) AS a, avg(cast(cast(s > q as int) = Suc as int)) AS acc FROM r, pr GROUP BY 1)
SELECT model, round(acc,6) AS accuracy, round(2*a-1,6) AS gini FROM a ORDER BY gini DESC, model""")
def e16(t):
    s = features.scored(t.case_events, t.cases)
    q = evaluate.prior(s, "Suc")
    models = {"score": F.col("score"), "debt": 1 - F.col("TOA") / F.lit(50000.0),
              "card": F.when(F.col("Product") == "Credit card", 1.0).otherwise(0.0)}
    return leaderboard(s, "Suc", models, q)


def leaderboard(df, target, models, threshold):
    """Accuracy and Gini of several scores, all in one long counted table, best first."""
    long = df.select(target, F.explode(F.array(*[
        F.struct(F.lit(k).alias("model"), e.alias("s")) for k, e in models.items()])).alias("r")).select(target, "r.*")
    c = long.groupBy("model", "s").agg(F.sum(target).alias("g"), F.count(F.lit(1)).alias("n"))
    hit = F.when(F.col("s") > F.lit(threshold), F.col("g")).otherwise(F.col("n") - F.col("g"))
    cum = ranks.cumulate(c, "s", {"upto": "n"}, ["model"])
    g = F.sum("g").cast("double")
    b = F.sum(F.col("n") - F.col("g")).cast("double")
    rank = F.sum(F.col("g") * (F.col("upto") - (F.col("n") - 1) / 2.0))
    out = cum.groupBy("model").agg(rnd(F.sum(hit) / F.sum("n")).alias("accuracy"),
                                   rnd(2 * (rank - g * (g + 1) / 2.0) / (g * b) - 1).alias("gini"))
    return out.orderBy(F.desc("gini"), "model")


@query("e17_balanced_training")
def e17(t):
    trn, tst = train_test(t)
    bal = stored(sampling.balanced(trn, "CaseId", "Suc", max(trn.count() // 2, 1)), "balanced")
    rows = []
    for name, d in (("unbalanced", trn), ("balanced", bal)):
        f, _ = logit.stepwise(d, "Suc", LX, "forward", math.log(max(d.count(), 2)))
        s = tst.withColumn("score", f.probability())
        _, dev = evaluate.recovery_prediction(d.withColumn("score", f.probability()), s, "score", "Payments", "TOA", "Suc", 7)
        rows.append((name, f.x, float(s.agg(F.avg("score")).first()[0]), evaluate.prior(tst, "Suc"),
                     float(evaluate.auc(s, "score", "Suc").first()["gini"]), float(dev.first()[0])))
    return frame_of(t, [(r[0], ",".join(r[1]), *r[2:]) for r in rows],
                    "training string, variables string, mean_score double, actual_rate double, gini double, sr_deviation double")
