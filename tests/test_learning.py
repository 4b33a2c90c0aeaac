"""Forest, cross-validated regression, proximity density and order matching against plain versions."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonagrid.operators import crossval, forest, proximity, signal

# --- forest ---


def plain_path(forest_: forest.Forest, tree: int, row: list[float]) -> float:
    node, depth = 0, 0
    while forest_.feature[tree, node] >= 0:
        node = 2 * node + (2 if row[forest_.feature[tree, node]] >= forest_.cut[tree, node] else 1)
        depth += 1
    return depth + float(forest.expected_depth(forest_.size[tree, node]))


def test_forest_finds_planted_outliers(spark):
    r = random.Random(1)
    rows = [(i, r.gauss(0, 1), r.gauss(5, 2), None) for i in range(600)] + [(600 + i, 12.0 + i, -20.0, 1.0) for i in range(6)] + [(700, None, 1.0, 1.0), (701, float("nan"), 1.0, 1.0), (702, float("inf"), 1.0, 1.0)]
    df = spark.createDataFrame(rows, "key long, a double, b double, c double")
    fitted = forest.fit(df, "key", ["a", "b"], trees=40, sample=64)
    assert fitted.feature.shape == (40, 127) and (fitted.size[:, 0] == 64).all()
    got = {x.key: x for x in forest.outliers(df, "key", ["a", "b"], 40, 64, 0.0095).collect()}
    assert set(got) == set(range(606))
    assert {k for k, x in got.items() if x.outlier} == set(range(600, 606))
    for k in (0, 17, 603):
        mean = np.mean([plain_path(fitted, t, list(rows[k][1:3])) for t in range(40)])
        assert got[k].score == pytest.approx(2 ** (-mean / float(forest.expected_depth(64))), abs=1e-12)


def test_forest_does_not_depend_on_partitions(spark):
    rows = [(i, float(i % 97), float(i * i % 89)) for i in range(500)]
    df = spark.createDataFrame(rows, "key long, a double, b double")
    one, other = (forest.fit(df.repartition(n), "key", ["a", "b"], 9, 32) for n in (1, 7))
    assert (one.feature == other.feature).all() and (one.cut == other.cut).all() and (one.size == other.size).all()


def test_forest_of_few_or_equal_rows(spark):
    few = spark.createDataFrame([(i, 1.0) for i in range(9)], "key long, a double")
    assert forest.outliers(few, "key", ["a"]).count() == 0
    equal = spark.createDataFrame([(i, 1.0) for i in range(30)], "key long, a double")
    assert {x.score for x in forest.outliers(equal, "key", ["a"], 5, 16).collect()} == {0.5}


# --- regression ---


def regression_rows(seed: int) -> list[tuple]:
    r = random.Random(seed)
    rows = []
    for i in range(400):
        a, b, noise = r.gauss(0, 1), r.gauss(1e6, 3), r.gauss(0, 0.5)
        g = r.choice(["p", "q", None])
        y = 3 * a - 2 * (b - 1e6) + noise + (1e4 if g == "q" else 0)
        rows.append((i, g, None if i % 41 == 0 else y, a, None if i % 13 == 0 else b, 2 * a, 7.0, r.random(), float("nan") if i % 17 == 0 else r.random()))
    return rows


def test_cross_validation_from_moments(spark):
    """Against least squares on the rows themselves, with collinear, constant and missing predictors."""
    rows = regression_rows(2)
    names = ["a", "b", "twice_a", "flat", "x", "y2"]
    df = spark.createDataFrame(rows, "i long, g string, y double, a double, b double, twice_a double, flat double, x double, y2 double")
    got = {r.g: r for r in crossval.cross_validated(df, "g", "y", names, F.col("i") % 4, most=4).collect()}
    assert set(got) == {"p", "q"}
    clean = lambda v: v is not None and v == v
    for g, found in got.items():
        own = [r for r in rows if r[1] == g and clean(r[2])]
        y = np.array([r[2] for r in own])
        x = np.array([[v if clean(v) else 0.0 for v in r[3:]] for r in own])
        rs = []
        for j in range(len(names)):
            both = np.array([clean(r[3 + j]) for r in own])
            rs.append(abs(np.corrcoef(x[both, j], y[both])[0, 1]) if x[both, j].std() > 0 else -1.0)
        chosen = [j for j in sorted(range(len(names)), key=lambda j: (-round(rs[j], 9), j)) if rs[j] >= 0][:4]
        assert found.predictors.split(",") == [names[j] for j in chosen]
        design = np.column_stack([np.ones(len(own)), x[:, chosen]])
        fold = np.array([r[0] % 4 for r in own])

        def fit(mask, design=design, y=y):
            centre = design[mask].mean(0) * (np.arange(design.shape[1]) > 0)
            scale = np.where(design[mask].std(0) > 0, design[mask].std(0), 1)
            z = (design - centre) / scale
            return z @ np.linalg.lstsq(z[mask], y[mask], rcond=1e-8)[0]

        whole = fit(np.ones(len(own), bool))
        ss = lambda p, m, y=y: 1 - ((y[m] - p[m]) ** 2).sum() / ((y[m] - y[m].mean()) ** 2).sum()
        assert found.r2 == pytest.approx(ss(whole, fold >= 0), abs=1e-6)
        assert found.mae == pytest.approx(np.abs(y - whole).mean(), rel=1e-5)
        assert found.rmse == pytest.approx(np.sqrt(((y - whole) ** 2).mean()), rel=1e-5)
        want = [ss(fit(fold != k), fold == k) for k in range(4)]
        assert found.fold_r2 == pytest.approx(want, abs=1e-5)
        assert (found.cv_r2_mean, found.cv_r2_std) == pytest.approx((np.mean(want), np.std(want)), abs=1e-5)


def test_one_fold_and_constant_target(spark):
    df = spark.createDataFrame([("a", 1.0, float(i)) for i in range(8)], "g string, y double, x double")
    row = crossval.cross_validated(df, "g", "y", ["x"], F.lit(0)).collect()[0]
    assert row.r2 is None and row.fold_r2 == [None] and row.cv_r2_mean is None and row.mae == 0 and row.predictors == ""
    assert crossval.cross_validated(df.filter("false"), "g", "y", ["x"], F.lit(0)).count() == 0


# --- proximity ---


def plain_density(freq, amp, f0, sigma=500.0, hard=False, per_band=4):
    p = amp**2 / (amp**2).sum()
    if f0 and ((freq >= f0) & (freq <= f0 + 4000)).any():
        inside = (freq >= f0) & (freq <= f0 + 4000)
        freq, p = freq[inside], p[inside] / p[inside].sum()
    edges = np.array(proximity.BANDS)
    band = np.clip(np.searchsorted(edges, freq, "right") - 1, 0, 3)
    weight = 1 - 0.5 * np.minimum(np.abs(freq - (edges[band] + edges[band + 1]) / 2) / ((edges[band + 1] - edges[band]) / 2), 1)
    keep = np.zeros(len(p), bool)
    for b in range(4):
        at = np.flatnonzero(band == b)
        keep[at[np.lexsort((freq[at], -np.round(p[at] * weight[at], 12)))][:per_band]] = True
    p = np.where(keep, p, 0 if hard else 0.1 * p * weight)
    freq, p = (freq[keep], p[keep]) if hard else (freq, p)
    p = p / p.sum()
    k = np.exp(-((freq[:, None] - freq[None, :]) ** 2) / (2 * sigma**2))
    np.fill_diagonal(k, 0)
    n = len(p)
    rich = (math.exp(-(p * np.log(np.maximum(p, 1e-12))).sum()) - 1) / (n - 1) if n > 1 else 0
    near = min((p[:, None] * p[None, :] * k).sum() / (1 - (p**2).sum()), 1) if n > 1 else 0
    low = (p * np.clip((1000 - freq) / 100, 0, 1)).sum()
    density = 0.45 * rich + 0.55 * near
    return n, rich, near, low, density, 0.65 * density + 0.35 * low


@pytest.mark.parametrize(("hard", "sigma"), [(False, 500.0), (True, 500.0), (False, 37.0)])
def test_proximity_without_pairs(spark, hard, sigma):
    """The series over cells gives the sum over all pairs, for notes of one to 3,000 components."""
    r = np.random.default_rng(3)
    notes = {1: (1, 0.0), 2: (3, 440.0), 3: (3000, 100.0), 4: (40, None), 5: (200, 1e6)}
    rows = []
    for note, (n, f0) in notes.items():
        freq = np.round(r.uniform(5, 24000, n), 3)
        rows += [(note, float(f), float(a), f0) for f, a in zip(freq, r.uniform(0.01, 1, n), strict=True)]
    bad = [(9, -5.0, 1.0, None), (9, 5.0, 0.0, None), (9, 5.0, None, None), (1, float("inf"), 1.0, 0.0)]
    df = spark.createDataFrame(rows + bad, "note long, freq_hz double, amp double, f0_hz double")
    got = {x.note: tuple(x)[1:] for x in proximity.proximity_density(df, sigma=sigma, hard=hard).collect()}
    assert set(got) == set(notes)
    for note, (_, f0) in notes.items():
        own = np.array([x[1:3] for x in rows if x[0] == note])
        assert got[note] == pytest.approx(plain_density(own[:, 0], own[:, 1], f0, sigma, hard), abs=1e-9)


def test_proximity_copies_no_cell(spark):
    """Cells meet where they lie: no join, and nothing exploded before a shuffle."""
    df = spark.createDataFrame([(1, 100.0, 1.0), (1, 700.0, 0.5)], "note long, freq double, mass double")
    plan = proximity.kernel_sums(df, 500.0)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan
    assert proximity.kernel_sums(df.filter("false"), 500.0).count() == 0


@pytest.mark.parametrize("gap", [0.0, 4000.0, 4499.0, 4501.0, 9000.0])
def test_proximity_across_blocks(spark, gap):
    """Pairs of one block, of two neighbours and of blocks with empty ones between."""
    freq, mass = np.array([10.0, 4490.0, 4510.0]) + np.array([0.0, gap, gap]), np.array([0.5, 0.3, 0.2])
    df = spark.createDataFrame([("x", float(f), float(m)) for f, m in zip(freq, mass, strict=True)], "note string, freq double, mass double")
    k = np.exp(-((freq[:, None] - freq[None, :]) ** 2) / (2 * 500.0**2))
    np.fill_diagonal(k, 0)
    assert proximity.kernel_sums(df, 500.0).collect()[0].pair_sum == pytest.approx((mass[:, None] * mass * k).sum(), abs=1e-12)


# --- orders ---


def test_greedy_orders_has_no_highest(spark):
    r = np.random.default_rng(5)
    for f0, b in ((20.0, 0.0), (55.0, 1e-5), (110.0, 1e-4)):
        n = np.arange(1, 300)
        freq = r.permutation(np.concatenate([n * f0 * np.sqrt(1 + b * n * n) * 2 ** (r.uniform(-60, 60, len(n)) / 1200), r.uniform(20, 5000, 50)]))
        used, want = set(), []
        for k in range(1, 3000):
            wanted = k * f0 * np.sqrt(1 + b * k * k)
            off = np.abs(1200 * np.log2(freq / wanted))
            free = [i for i in np.argsort(off, kind="stable") if i not in used and off[i] <= 50]
            if free:
                used.add(free[0])
                want.append((k, int(free[0])))
        got = signal.greedy_orders(freq, f0, b)
        assert got == want and max(k for k, _ in got) > 64
    assert signal.greedy_orders(np.zeros(0), 10.0, 0.0) == [] and signal.greedy_orders(np.ones(3), 0.0, 0.0) == []
