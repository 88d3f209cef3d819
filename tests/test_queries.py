"""A query of every chapter against its SQL twin; RECOUP_ALL=1 runs every twin."""
import os

import duckdb
import pytest

from recoup.plans import oracle_sql, queries
from recoup.sources.tables import BASE
from tools.oracle_check import norm

FOLDER = "/root/testdata/sf0.001"
SOME = ["s4_read_csv", "p8_row_id", "p23_polynomial_terms", "j6_interval_join", "j7_look_back", "a12_trimmed_means", "a13_box_statistics",
        "a14_monthly_recovery", "w6_time_split", "b2_quantile_bands", "q8_empirical_fill", "d2_spearman", "d7_stability_index",
        "o2_tietjen_moore", "r3_nested_split", "r10_matched_sample", "m15_linear_discriminant", "l3_coefficients", "e7_auc_gini",
        "e14_recovery_prediction", "x4_bootstrap_curve_by_band", "x8_deviation_matched_by_variable"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in BASE:
        c.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return c


def test_register_is_consistent():
    assert set(oracle_sql()) <= set(queries()) and len(queries()) > 240


@pytest.mark.parametrize("name", sorted(oracle_sql()) if os.environ.get("RECOUP_ALL") else SOME)
def test_query_equals_sql(spark, con, name):
    df = queries()[name](spark, FOLDER)
    rel = con.sql(oracle_sql()[name])
    cols = sorted(df.columns)
    assert cols == sorted(rel.columns)
    at = {c: i for i, c in enumerate(rel.columns)}
    mine = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
    theirs = sorted(tuple(norm(r[at[c]]) for c in cols) for r in rel.fetchall())
    assert mine == theirs
