import hashlib
import math

import pytest
from pyspark.sql import functions as F

from recoup.functions import dist, keys
from recoup.functions.columns import truncate
from recoup.operators.sampling import POISSON1, poisson_count


def test_distribution_tables():
    assert dist.t_ppf(0.975, 10) == pytest.approx(2.228139, abs=1e-5)
    assert dist.t_sf2(2.228139, 10) == pytest.approx(0.05, abs=1e-6)
    assert dist.chi2_sf(3.841459, 1) == pytest.approx(0.05, abs=1e-6)
    assert dist.chi2_sf(16.918978, 9) == pytest.approx(0.05, abs=1e-6)
    assert dist.f_sf(4.964603, 1, 10) == pytest.approx(0.05, abs=1e-6)
    assert dist.normal_ppf(0.975) == pytest.approx(1.959964, abs=1e-6)
    assert dist.chi2_ppf(0.5, 3) == pytest.approx(2.365974, abs=1e-5)


def test_digest_and_uniform(spark):
    r = spark.range(5).select("id", keys.digest("id", "s").alias("d"), keys.uniform("id", "s").alias("u")).collect()
    for row in r:
        d = hashlib.md5(f"{row['id']}-s".encode()).hexdigest()
        assert row["d"] == d and row["u"] == int(d[:8], 16) / 2 ** 32


def test_poisson_text_thresholds_equal_numeric_ones(spark):
    edges = [math.ceil(c * 2 ** 32) for c in POISSON1]
    values = sorted({v for e in edges for v in (e - 1, e) if v < 2 ** 32} | {0, 2 ** 32 - 1})
    df = spark.createDataFrame([(v, f"{v:08x}") for v in values], "v bigint, h string")
    for r in df.select("v", poisson_count(F.col("h")).alias("w")).collect():
        assert r["w"] == sum(r["v"] / 2 ** 32 >= c for c in POISSON1)


def test_truncate_goes_toward_zero(spark):
    df = spark.createDataFrame([(1.9,), (-1.9,), (None,)], "x double")
    assert [r[0] for r in df.select(truncate("x")).collect()] == [1, -1, None]
