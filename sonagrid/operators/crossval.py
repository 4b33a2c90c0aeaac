"""Least squares with chosen predictors and cross-validation, from moments.

One aggregation by group and fold gathers counts, means and covariances. What a fold trains on is
the group's total less the fold, so no row is read again for any fold; only absolute errors, which
have no moments, take a second pass.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonagrid.operators.statistics import correlation

#: A predictor or target that varies less is taken as constant.
FLAT = 1e-12


class Moments(NamedTuple):
    n: float
    mean: np.ndarray
    scatter: np.ndarray  # sums of products of deviations

    def less(self, part: Moments) -> Moments:
        """These rows without those of ``part``."""
        n = self.n - part.n
        if n <= 0:
            return Moments(0, np.zeros_like(self.mean), np.zeros_like(self.scatter))
        mean = (self.n * self.mean - part.n * part.mean) / n
        d = part.mean - mean
        return Moments(n, mean, self.scatter - part.scatter - np.outer(d, d) * (n * part.n / self.n))

    def plus(self, other: Moments) -> Moments:
        n = self.n + other.n
        d = other.mean - self.mean
        return Moments(n, self.mean + d * (other.n / n), self.scatter + other.scatter + np.outer(d, d) * (self.n * other.n / n))


class Fit(NamedTuple):
    intercept: float
    beta: np.ndarray


def solve(m: Moments) -> Fit:
    """Least squares of the last variable on the others; of collinear ones the smallest solution, constant ones get 0."""
    sd = np.sqrt(np.maximum(np.diag(m.scatter)[:-1], 0) / max(m.n, 1))
    varies = sd > FLAT
    scale = np.where(varies, sd, 1.0)
    a = m.scatter[:-1, :-1] / np.outer(scale, scale) / max(m.n, 1)
    b = np.where(varies, m.scatter[:-1, -1] / scale / max(m.n, 1), 0.0)
    a[~varies, :] = a[:, ~varies] = 0.0
    beta = np.linalg.lstsq(a, b, rcond=1e-10)[0] / scale
    return Fit(float(m.mean[-1] - beta @ m.mean[:-1]), beta)


def squared_error(fit: Fit, m: Moments) -> float:
    """Sum of squared residuals of a fit on the rows behind the moments."""
    b = np.append(-fit.beta, 1.0)
    off = m.mean[-1] - fit.intercept - fit.beta @ m.mean[:-1]
    return max(float(b @ m.scatter @ b), 0.0) + m.n * float(off) ** 2


def r_squared(fit: Fit, m: Moments) -> float | None:
    total = float(m.scatter[-1, -1])
    return 1 - squared_error(fit, m) / total if total > FLAT * max(m.n, 1) else None


_RESULT = "g {kind}, n long, chosen array<int>, intercept double, beta array<double>, r2 double, rmse double, fold_r2 array<double>"


def _task(k: int, pairs: list[tuple[int, int]], most: int, least: int, kind: pa.DataType):
    def of(row: dict) -> tuple:
        parts = []
        for p in row["parts"]:
            c = np.zeros((k, k))
            for (i, j), v in zip(pairs, p["cov"], strict=True):
                c[i, j] = c[j, i] = v * p["n"]
            parts.append((p["fold"], Moments(p["n"], np.array(p["mean"]), c)))
        parts.sort(key=lambda x: x[0])
        total = parts[0][1]
        for _, m in parts[1:]:
            total = total.plus(m)
        rated = [(abs(r), -i) for i, (r, n) in enumerate(zip(row["r"], row["pairs"], strict=True)) if r is not None and r == r and n >= least]
        chosen = [-i for _, i in sorted(rated, reverse=True)[:most]]
        use = [*chosen, k - 1]
        cut = lambda m: Moments(m.n, m.mean[use], m.scatter[np.ix_(use, use)])
        total = cut(total)
        fit = solve(total)
        folds = [r_squared(solve(total.less(cut(m))), cut(m)) if total.n > m.n else None for _, m in parts]
        full = np.zeros(k - 1)
        full[chosen] = fit.beta
        return row["g"], int(total.n), chosen, fit.intercept, full.tolist(), r_squared(fit, total), (squared_error(fit, total) / total.n) ** 0.5, folds

    kinds = (kind, pa.int64(), pa.list_(pa.int32()), pa.float64(), pa.list_(pa.float64()), pa.float64(), pa.float64(), pa.list_(pa.float64()))

    def task(batches):
        for b in batches:
            columns = list(zip(*map(of, b.to_pylist()), strict=True)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["g", "n", "chosen", "intercept", "beta", "r2", "rmse", "fold_r2"])

    return task


def cross_validated(rows: DataFrame, group: str, y: str, candidates: list[str], fold: Column, most: int = 10, least: int = 5) -> DataFrame:
    """Per group: least squares of y on the ``most`` candidates with the largest |r| to it, and R squared of every fold.

    |r| takes the rows that have both, at least ``least`` of them; ties go by the order of the
    candidates. In the regression missing predictors are 0; rows without y, group or fold are left
    out. ``fold`` is a whole-number expression; R squared of a fold is that of the fit on the other
    folds, null if y does not vary in it. Predictors are chosen once a group, before the folds.
    Returns group, n, predictors (comma-joined, strongest first), intercept, beta (an array in
    the order of the candidates, 0 if not chosen), r2, rmse, mae, fold_r2 (by fold), cv_r2_mean and cv_r2_std.
    """
    names = [f"x{i}" for i in range(len(candidates))]
    k = len(names) + 1
    raw = [F.col(c).cast("double").alias(n) for c, n in zip(candidates, names, strict=True)]
    cells = rows.select(F.col(group).alias("g"), fold.cast("long").alias("fold"), F.col(y).cast("double").alias("y"), *raw).filter("g IS NOT NULL AND fold IS NOT NULL AND y IS NOT NULL AND NOT isnan(y)")
    cells = cells.select("g", "fold", "y", *(F.when(~F.isnan(n), F.col(n)).alias(n) for n in names))
    filled = [F.coalesce(n, F.lit(0.0)) for n in names] + [F.col("y")]
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    moments = cells.groupBy("g", "fold").agg(F.count("*").alias("n"), F.array(*map(F.avg, filled)).alias("mean"), F.array(*[F.covar_pop(filled[i], filled[j]) for i, j in pairs]).alias("cov"))
    rated = cells.groupBy("g").agg(F.array(*[correlation(n, "y") for n in names]).alias("r"), F.array(*map(F.count, names)).alias("pairs"))
    folded = moments.groupBy("g").agg(F.collect_list(F.struct("fold", "n", "mean", "cov")).alias("parts"))  # one a fold
    kind = rows.schema[group].dataType.simpleString()
    arrow = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_()}[kind]
    solved = folded.join(rated, "g").mapInArrow(_task(k, pairs, most, least, arrow), _RESULT.format(kind=kind))
    predicted = F.col("intercept")
    for i, x in enumerate(filled[:-1]):
        predicted = predicted + F.col("beta")[i] * x
    errors = cells.join(solved.select("g", "intercept", "beta"), "g").groupBy("g").agg(F.avg(F.abs(F.col("y") - predicted)).alias("mae"))
    label = F.array(*map(F.lit, candidates))
    known = F.filter("fold_r2", lambda v: v.isNotNull())
    mean = F.aggregate(known, F.lit(0.0), lambda a, v: a + v) / F.size(known)
    spread = F.sqrt(F.aggregate(known, F.lit(0.0), lambda a, v: a + (v - F.col("cv_r2_mean")) * (v - F.col("cv_r2_mean"))) / F.size(known))
    out = solved.join(errors, "g").withColumn("cv_r2_mean", F.when(F.size(known) > 0, mean))
    return out.select(F.col("g").alias(group), "n", F.array_join(F.transform("chosen", lambda i: label[i]), ",").alias("predictors"), "intercept", "beta", "r2", "rmse", "mae", "fold_r2", "cv_r2_mean", F.when(F.size(known) > 0, spread).alias("cv_r2_std"))
