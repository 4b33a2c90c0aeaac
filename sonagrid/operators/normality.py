"""Tests of normality for a metric over a whole table: D'Agostino and Pearson's K2, Anderson and Darling's A2.

K2 needs four moments. A2 needs every value's rank from below and from above; the second follows
from the first, and equal values need their average rank only, so distinct values with counts are
ranked by ranges and nothing is joined back to the rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonagrid.operators import quantiles

#: Below this the tail is a half less a series, beyond it a continued fraction; lengths of both.
JOINT, SERIES, FRACTION = 2.0, 30, 60


def log_upper_tail(z: Column) -> Column:
    """ln of the standard normal's share above ``z`` of 0 or more, to about 1e-11."""
    series, fraction = F.lit(1.0), z
    for k in range(SERIES, 0, -1):
        series = 1 + z * z / (2 * k + 1) * series
    for k in range(FRACTION, 0, -1):
        fraction = z + k / fraction
    middle = 0.5 - F.exp(-z * z / 2) / math.sqrt(2 * math.pi) * z * series
    return F.when(z < JOINT, F.log(F.when(z < JOINT, middle).otherwise(0.5))).otherwise(-z * z / 2 - math.log(2 * math.pi) / 2 - F.log(fraction))


def skew_z(g1: Column, n: Column) -> Column:
    """D'Agostino's transform of the skewness to a standard normal."""
    y = g1 * F.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    beta = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = F.sqrt(2 * (beta - 1)) - 1
    return F.asinh(y / F.sqrt(2 / (w2 - 1))) / F.sqrt(F.log(w2) / 2)


def kurtosis_z(g2: Column, n: Column) -> Column:
    """Anscombe and Glynn's transform of the excess kurtosis to a standard normal."""
    x = (g2 + 3 - 3 * (n - 1) / (n + 1)) / F.sqrt(24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5)))
    root = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6 + 8 / root * (2 / root + F.sqrt(1 + 4 / (root * root)))
    d = 1 + x * F.sqrt(2 / (a - 4))
    return (1 - 2 / (9 * a) - F.signum(d) * F.cbrt((1 - 2 / a) / F.abs(d))) / F.sqrt(2 / (9 * a))


def anderson_p(a: Column) -> Column:
    """Stephens' approximation of the p value of A2, mean and deviation estimated, corrected for n."""
    return (
        F.when(a >= 0.6, F.exp(1.2937 - 5.709 * a + 0.0186 * a * a))
        .when(a >= 0.34, F.exp(0.9177 - 4.279 * a - 1.38 * a * a))
        .when(a >= 0.2, 1 - F.exp(-8.318 + 42.796 * a - 59.938 * a * a))
        .otherwise(1 - F.exp(-13.436 + 101.14 * a - 223.73 * a * a))
    )


def normality_tests(cells: DataFrame, value: str, least: int = 20) -> DataFrame:
    """One row: n, skew_z, kurtosis_z, k2, k2_p, a2 (corrected for n), a2_p. Null and NaN don't count.

    Fewer than ``least`` values, or values that do not vary: n alone, the rest null.
    """
    good = cells.select(F.col(value).cast("double").alias("v")).filter("v IS NOT NULL AND NOT isnan(v)")
    stats = good.agg(F.count("*").cast("double").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd"), F.when(F.stddev_pop("v") > 0, F.skewness("v")).alias("g1"), F.when(F.stddev_pop("v") > 0, F.kurtosis("v")).alias("g2"))
    use = (F.col("n") >= least) & (F.col("sd") > 0)
    z = (F.col("v") - F.col("mean")) / F.col("sd")
    tail = log_upper_tail(F.col("size"))
    placed = quantiles.ranks(good, [], "v").crossJoin(F.broadcast(stats)).filter(use).withColumn("z", z).withColumn("size", F.abs("z")).withColumn("tail", tail)  # one row of statistics
    body = F.log1p(-F.exp("tail"))
    below, above = F.when(F.col("z") < 0, F.col("tail")).otherwise(body), F.when(F.col("z") < 0, body).otherwise(F.col("tail"))
    part = F.col("_n") * ((2 * F.col("rank") - 1) * below + (2 * (F.col("n") - F.col("rank")) + 1) * above)
    folded = placed.agg(F.sum(part).alias("s"))
    n = F.when(use, F.col("n"))
    a2 = (-n - F.col("s") / n) * (1 + 0.75 / n + 2.25 / (n * n))
    k2 = F.col("skew_z") * F.col("skew_z") + F.col("kurtosis_z") * F.col("kurtosis_z")
    out = stats.crossJoin(F.broadcast(folded)).withColumns({"skew_z": skew_z(F.when(use, F.col("g1")), n), "kurtosis_z": kurtosis_z(F.when(use, F.col("g2")), n), "a2": a2})
    return out.select(F.col("n").cast("long").alias("n"), "skew_z", "kurtosis_z", k2.alias("k2"), F.exp(-k2 / 2).alias("k2_p"), "a2", F.when(F.col("a2").isNotNull(), anderson_p(F.col("a2"))).alias("a2_p"))
