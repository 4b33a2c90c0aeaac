"""Values of operators that SQL doesn't replay, against definitions written out."""

from __future__ import annotations

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sonagrid.operators import confirmation, dissonance, signal, statistics


def test_principal_components_are_those_of_the_correlation_matrix(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 3)) @ np.array([[2.0, 0.5, 0.0], [0.0, 1.0, 0.3], [0.0, 0.0, 0.2]]) + [5, -1, 100]
    rows = [(i, *(None if (i, j) in {(3, 0), (9, 2)} else float(v) for j, v in enumerate(r))) for i, r in enumerate(x)]
    scores, explained = statistics.principal_components(spark.createDataFrame(rows, "note long, a double, b double, c double").repartition(5), "note", ["a", "b", "c"], 2)
    got = np.array([r.scores for r in sorted(scores.collect(), key=lambda r: r.note)])
    x[3, 0] = x[9, 2] = np.nan
    x = np.where(np.isnan(x), np.nanmean(x, axis=0), x)
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    values, vectors = np.linalg.eigh(np.cov(z.T))
    assert explained == pytest.approx(values[::-1][:2] / values.sum())
    for k in range(2):
        want = z @ vectors[:, 2 - k]
        sign = np.sign(want @ got[:, k])
        assert got[:, k] == pytest.approx(sign * want, abs=1e-8)


def bark(f):
    return 13 * math.atan(0.00076 * f) + 3.5 * math.atan((f / 7500) ** 2)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(20, 12000), st.integers(-90, 0)), max_size=30, unique_by=lambda x: x[0]))
def test_masking_keeps_what_no_louder_stayer_covers(items):
    freq, db = np.array([f for f, _ in items], float), np.array([d for _, d in items], float)
    stay = []
    for d, f in sorted(((d, f) for f, d in items), key=lambda x: (-x[0], x[1])):
        if all(e - 14 - 12 * abs(bark(g) - bark(f)) < d for e, g in stay):
            stay.append((d, f))
    assert sorted(freq[signal.mask_components(freq, db)].tolist()) == sorted(f for _, f in stay)


def test_curves_of_arrays_and_of_met_pairs_agree(spark, monkeypatch):
    """Notes on both sides of the bound, components without amplitude or frequency; the scale is the curve's local minima."""
    rng = np.random.default_rng(8)
    rows = [(k, float(f), float(a)) for k, n in ((1, 1), (2, 5), (3, 5), (4, 30)) for f, a in zip(rng.uniform(100, 3000, n), rng.uniform(0.1, 1, n), strict=True)]
    rows += [(2, 500.0, None), (3, None, 0.5), (5, 300.0, None), (6, None, 0.5)]
    df = spark.createDataFrame(rows, "note long, freq_hz double, amp double")
    arrays = {(r.note, r.step): r.dissonance for r in dissonance.curve(df).collect()}
    assert {k for k, _ in arrays} == {1, 2, 3, 4, 5} and len(arrays) == 500
    minima = {tuple(r) for r in dissonance.scale(dissonance.curves(df)).collect()}
    assert minima and minima == {(r.note, r.step) for r in dissonance.local_minima(dissonance.curve(df)).collect()}
    for bound in (0, 4):
        monkeypatch.setattr(dissonance, "ARRAY", bound)
        met = {(r.note, r.step): r.dissonance for r in dissonance.curve(df).collect()}
        assert met.keys() == arrays.keys()
        assert all(met[k] == (pytest.approx(v) if v is not None else None) for k, v in arrays.items())


def test_stretch_with_a_t_value_of_just_two(spark):
    """Orders 7, 1, 5, 5 of which one is flat: t is 2 but for the rounding of its sums, in any order of the rows."""
    peaks = [(1, 280.0, 280.0 * n * (1 + (x - 0.04) * 0.02)) for n, x in ((7, 0.07), (1, 0.05), (5, 0.07), (5, 0.07))]
    for rows in (peaks, peaks[::-1], peaks[2:] + peaks[:2]):
        got = confirmation.rematched_stretch(spark.createDataFrame(rows, "note long, f0_hz double, freq_hz double").coalesce(1)).first()
        assert got.fitted and got.orders == 3


def test_greedy_orders_in_blocks_are_a_plain_walk(monkeypatch):
    """Every order in turn takes its nearest free peak, with orders laid out in blocks of any size."""
    rng = np.random.default_rng(12)
    for f0, b, n in ((50.0, 1e-5, 6), (3.0, 0.0, 40), (90.0, 4e-4, 12)):
        freq, used, want = rng.uniform(20, 5000, n), set(), []
        for k in range(1, int(freq.max() * 2 ** (50 / 1200) / f0) + 1):
            at = k * f0 * math.sqrt(1 + b * k * k)
            off = [(abs(1200 * math.log2(x / at)), i) for i, x in enumerate(freq) if i not in used and abs(1200 * math.log2(x / at)) <= 50]
            if off:
                used.add(min(off)[1])
                want.append((k, min(off)[1]))
        for block in (1, 7, 1 << 14):
            monkeypatch.setattr(signal, "_ORDERS", block)
            assert signal.greedy_orders(freq, f0, b) == want
