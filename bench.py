"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the data folder and BENCH_CPUS the local threads. Loading the two stored
tables is timed as its own query; every other query reads them as a user of the library would.
"""
from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from recoup.plans import queries  # noqa: E402
from recoup.session import build_session  # noqa: E402

HEADLINE = [
    "s1_load_tables", "a14_monthly_recovery", "a10_profile_by_product", "a11_table_summary", "a16_behaviour_features",
    "a17_targets", "j7_look_back", "j6_interval_join", "w1_running_sum", "b2_quantile_bands", "q9_group_median_fill",
    "q14_model_fill", "d2_spearman", "d7_stability_index", "d11_local_smoother", "o2_tietjen_moore", "o3_esd_count",
    "o4_robust_mahalanobis", "o5_local_outlier_factor", "r6_bootstrap_mean", "r10_matched_sample", "m5_knn_classification",
    "m12_projection", "m15_linear_discriminant", "l1_least_squares_all_variables", "l14_variable_selection", "l17_lasso_path",
    "l22_logistic_fit", "l25_stepwise_backward_bic", "l26_additive_fit", "e7_auc_gini", "e10_hosmer_lemeshow",
    "e11_woe_column", "e14_recovery_prediction", "t5_bagging", "t6_random_forest", "t12_gradient_boosting",
    "t14_adaptive_boosting", "t17_grid_search", "t21_linear_margin", "t26_network", "x2_cumulative_curve", "x3_bootstrap_curve",
    "x4_bootstrap_curve_by_band", "x7_deviation_random", "x8_deviation_matched_by_variable",
    "x9_deviation_matched_by_components", "x11_repeated_matching",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = sys.argv[1:]
    spark = build_session(f"local[{cpus}]", "recoup-bench", int(cpus), "20g")
    registered = queries()
    times: dict[str, float] = {}
    failed: dict[str, str] = {}
    for name in HEADLINE if not only else only:
        start = time.time()
        try:
            registered[name](spark, folder).write.format("noop").mode("overwrite").save()
            times[name] = round(time.time() - start, 3)
        except Exception as e:  # keep timing the rest; the failure is reported in the line
            failed[name] = str(e)[:200]
        print(f"{name} {time.time() - start:.2f}", file=sys.stderr)
    line = {"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
            "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}
    if failed:
        line["failed"] = failed
    print(json.dumps(line))


if __name__ == "__main__":
    main()
