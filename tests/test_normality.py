"""Normality tests against their definitions."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonagrid.operators import normality


def test_log_tail(spark):
    zs = [0.0, 1e-9, 0.3, 1.0, 1.999, 2.0, 2.5, 4.0, 6.0, 9.0, 30.0]
    got = [x.t for x in spark.createDataFrame([(z,) for z in zs], "z double").coalesce(1).select(normality.log_upper_tail(F.col("z")).alias("t")).collect()]
    assert got == pytest.approx([math.log(math.erfc(z / math.sqrt(2)) / 2) for z in zs], rel=1e-9)


def anderson(x: np.ndarray) -> float:
    n, f = len(x), NormalDist(x.mean(), x.std(ddof=1))
    v = sorted(x.tolist())
    s = sum((2 * i - 1) * (math.log(f.cdf(v[i - 1])) + math.log(f.cdf(2 * f.mean - v[n - i]))) for i in range(1, n + 1))
    return (-n - s / n) * (1 + 0.75 / n + 2.25 / n**2)


@pytest.mark.parametrize(("kind", "normal"), [("normal", True), ("ties", False), ("exponential", False), ("uniform", False)])
def test_statistics(spark, kind, normal):
    r = np.random.default_rng(7)
    x = {"normal": r.normal(3, 2, 3000), "ties": np.round(r.normal(0, 1, 800)), "exponential": r.exponential(1, 700), "uniform": r.uniform(0, 1, 900)}[kind]
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,), (float("nan"),)], "v double")
    got = normality.normality_tests(df, "v").collect()[0]
    assert got.n == len(x) and got.a2 == pytest.approx(anderson(x), abs=1e-6)
    assert got.k2 == pytest.approx(got.skew_z**2 + got.kurtosis_z**2) and got.k2_p == pytest.approx(math.exp(-got.k2 / 2))
    assert (got.a2_p > 0.05) == normal and (normal is False or got.k2_p > 0.01)


def test_transforms_are_standard_normal():
    """Over many samples of normal values both transforms have mean 0 and deviation 1."""
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    r = np.random.default_rng(3)
    x = r.normal(size=(4000, 60))
    c = x - x.mean(1, keepdims=True)
    m2 = (c**2).mean(1)
    rows = list(zip(((c**3).mean(1) / m2**1.5).tolist(), ((c**4).mean(1) / m2**2 - 3).tolist(), strict=True))
    df = spark.createDataFrame(rows, "g1 double, g2 double").select(normality.skew_z(F.col("g1"), F.lit(60.0)).alias("s"), normality.kurtosis_z(F.col("g2"), F.lit(60.0)).alias("k"))
    for x in df.agg(*[f(c).alias(f"{c}{i}") for c in "sk" for i, f in enumerate((F.avg, F.stddev))]).collect():
        assert (x.s0, x.k0) == pytest.approx((0, 0), abs=0.06) and (x.s1, x.k1) == pytest.approx((1, 1), abs=0.05)


def test_too_few_or_constant(spark):
    for rows in ([(1.0,)] * 5, [(2.0,)] * 50, []):
        got = normality.normality_tests(spark.createDataFrame(rows, "v double"), "v").collect()
        assert len(got) == 1 and got[0].n == len(rows) and got[0].k2 is None and got[0].a2 is None and got[0].a2_p is None
