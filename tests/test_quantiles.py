"""Exact quantiles by ranges equal Spark's percentile and numpy's, and ranks those of a sort."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonagrid.operators import normalise, quantiles, statistics

SHARES = {"a": 0.0, "b": 0.05, "c": 0.25, "d": 0.5, "e": 0.75, "f": 0.99, "g": 1.0}


@pytest.fixture(scope="module")
def cells(spark):
    draw = random.Random(5)
    rows = [("hot", draw.gauss(0, 1)) for _ in range(4000)]  # one key holds most rows
    rows += [("ties", float(draw.randrange(4))) for _ in range(300)]
    rows += [(None, draw.random() * 1e9) for _ in range(101)]
    rows += [("one", 7.5), ("two", -2.0), ("two", 3.0), ("void", None), ("hot", None), ("ties", math.nan)]
    return spark.createDataFrame(rows, "k string, v double").repartition(7)


@pytest.mark.parametrize("ranges", [2, 37, 1000])
def test_by_key_equals_percentile(cells, ranges):
    good = cells.filter("v IS NOT NULL AND NOT isnan(v)")
    want = good.groupBy("k").agg(*(F.percentile("v", q).alias(n) for n, q in SHARES.items()))
    got = quantiles.exact(cells, ["k"], "v", SHARES, ranges)
    assert got.columns == want.columns
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, map(tuple, want.collect())))


def test_whole_table_equals_numpy(cells):
    v = np.array([r.v for r in cells.collect() if r.v is not None and not math.isnan(r.v)])
    got = quantiles.exact(cells, [], "v", SHARES).first()
    assert [got[n] for n in SHARES] == pytest.approx(np.quantile(v, list(SHARES.values())).tolist(), rel=1e-12)


def test_empty_and_void(spark, cells):
    none = cells.filter("k = 'void'")
    assert [tuple(r) for r in quantiles.exact(none, [], "v", {"m": 0.5}).collect()] == [(None,)]
    assert quantiles.exact(none, ["k"], "v", {"m": 0.5}).count() == 0
    signed = spark.createDataFrame([(-0.0,), (0.0,), (3.0,)], "v double")
    assert [(r.v, r._n) for r in quantiles.distinct_counts(signed, [], "v").orderBy("v").collect()] == [(0.0, 2), (3.0, 1)]
    row = quantiles.with_exact(none.groupBy("k").agg(F.count("*").alias("n")), none, ["k"], "v", {"m": 0.5}).first()
    assert (row.k, row.n, row.m) == ("void", 1, None)


def test_a_range_holds_few_values_of_any_key(cells):
    counts = quantiles.ranged(quantiles.distinct_counts(cells, ["k"], "v"), "v", 100)
    most = counts.groupBy("k", "_range").count().agg(F.max("count")).first()[0]
    assert most <= 3 * counts.count() / 100


def test_no_percentile_buffer_in_the_plan(cells):
    plan = quantiles.exact(cells, ["k"], "v", {"m": 0.5})._jdf.queryExecution().toString()
    assert "percentile_approx" in plan and "percentile(" not in plan


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_ranks_equal_a_sort(cells, keys):
    groups: dict = {}
    for r in cells.collect():
        if r.v is not None and not math.isnan(r.v):
            groups.setdefault(r.k if keys else 0, []).append(r.v)
    want = set()
    for k, v in groups.items():
        v.sort()
        for x in set(v):
            at = [i + 1 for i, y in enumerate(v) if y == x]
            want.add((*([k] if keys else []), x, sum(at) / len(at), len(at)))
    got = [tuple(r) for r in quantiles.ranks(cells, keys, "v").collect()]
    assert len(got) == len(want) and set(got) == want


def test_callers_keep_their_values(cells):
    good = cells.filter("k = 'hot' AND v IS NOT NULL")
    v = np.array([r.v for r in good.collect()])
    q1, med, q3 = np.quantile(v, [0.25, 0.5, 0.75])
    mark = normalise.fences(good, ["k"], "v").first()
    assert (mark.q1, mark.q3, mark.low) == pytest.approx((q1, q3, q1 - 1.5 * (q3 - q1)))
    z = {r.v: r.robust_z for r in normalise.robust_z(good, "v").collect()}
    x = v[0]
    assert z[x] == pytest.approx(0.6745 * (x - med) / np.median(np.abs(v - med)))
    told = {r.scope: r for r in statistics.describe(cells.filter("v IS NULL OR NOT isnan(v)"), ["v"], "k").collect()}
    assert told["hot"].median == pytest.approx(med) and told["(none)"]["count"] == 101 and set(told) == {"ALL", "hot", "ties", "one", "two", "(none)"}
    assert statistics.shape(good, ["k"], "v").first().iqr == pytest.approx(q3 - q1)


def test_spearman_of_every_two_columns(spark):
    """Every pair over the rows that have both, with ties and nulls, and one ordering a column."""
    r = random.Random(9)
    some = lambda: None if r.random() < 0.2 else float(r.randrange(15))
    df = spark.createDataFrame([(some(), some(), some()) for _ in range(300)] + [(float("nan"), None, None)], "x double, y double, z double")
    got = {(p.a, p.b): (p.rho, p.n) for p in statistics.spearman_all(df, ["x", "y", "z"]).collect()}
    assert set(got) == {("x", "y"), ("x", "z"), ("y", "z")}
    for (a, b), (rho, n) in got.items():
        want = statistics.spearman(df.filter("not isnan(x) or x is null"), a, b).first()
        assert n == want.n and rho == pytest.approx(want.rho, abs=1e-12)
    plan = statistics.spearman_all(df, ["x", "y", "z"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("percentile_approx(") == 2 * 3  # for the order of a column and for the sizes of its ranges
    assert [(p.rho, p.n) for p in statistics.spearman_all(df.filter("false"), ["x", "y"]).collect()] == [(None, 0)]
