"""What a task holds: few sorts at once, and tasks whose number grows with the rows."""

from __future__ import annotations

import math

import pytest

from sonagrid.operators import dissonance, regions
from sonagrid.plans import catalog, inputs
from tests.conftest import SMALL


def executed(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def sorts(df) -> int:
    return executed(df).count("Sort [")


@pytest.fixture
def peaks(spark):
    rows = [(1, 100.0, f, p) for f, p in ((30.0, 1.0), (35.0, 0.5), (100.0, 4.0), (101.0, 4.0), (160.0, 2.0), (4999.0, 3.0), (5001.0, 3.0), (5002.0, 1.0))]
    return spark.createDataFrame(rows, "note long, f0_hz double, freq_hz double, power double")


def test_descriptors_sort_once(peaks):
    assert sorts(regions.descriptors(peaks).select("note", "total_body", "e_h")) == 1
    assert sorts(regions.regions(peaks).select("note", "loudest")) == 2


def test_energy_of_an_order_is_its_loudest(peaks):
    """Order 50 lies across the body's bound: of the equally loud peaks the lower one counts, and it is in the body."""
    harmonic = regions.regions(peaks).filter("region = 'H'").collect()
    assert sorted((r.freq_hz, r.loudest) for r in harmonic) == [(100.0, True), (101.0, False), (4999.0, True), (5001.0, False), (5002.0, False)]
    row = regions.descriptors(peaks).collect()[0]
    assert (row.e_h, row.body_h) == (7.0, 7.0)
    above = regions.descriptors(peaks.filter("freq_hz <> 4999")).collect()[0]
    assert (above.e_h, above.body_h) == (7.0, 4.0)


def test_tasks_grow_with_the_rows(spark, monkeypatch):
    rows = inputs.components(spark, SMALL)
    assert "REPARTITION" not in executed(inputs.dealt(spark, SMALL, rows))
    for size in (100, 50):
        monkeypatch.setattr(inputs, "TASK_ROWS", size)
        assert inputs.dealt(spark, SMALL, rows).rdd.getNumPartitions() == -(-rows.count() // size)


def test_density_shuffles_rows_once(spark, monkeypatch):
    monkeypatch.setattr(inputs, "TASK_ROWS", 100)
    assert executed(catalog.queries()["acd_score"](spark, SMALL)).count("Exchange") == 1


def brute_timbre(items, interval):
    def sethares(f1, a1, f2, a2):
        y = 0.24 * abs(f2 - f1) / (0.0207 * min(f1, f2) + 18.96)
        return min(a1, a2) * max(0.0, math.exp(-3.5 * y) - math.exp(-5.75 * y))

    cross = sum(sethares(f, a, g * interval, b) for f, a in items for g, b in items)
    low, high = (sum(sethares(f * x, a, g * x, b) for i, (f, a) in enumerate(items) for g, b in items[:i]) for x in (1.0, interval))
    return cross, cross + low + high, low, cross + high


@pytest.mark.parametrize("most", [1024, 3])
def test_timbre_by_arrays_and_by_joins(spark, monkeypatch, most):
    """Both ways give all pairs; rows without a note or a frequency count nothing but keep their note."""
    monkeypatch.setattr(dissonance, "ARRAY", most)
    notes = {1: [(200.0, 1.0)], 2: [(200.0, 1.0), (200.0, 1.0), (310.0, 0.5)], 3: [(100.0 * k + 3.0 * (k % 3), 1.0 / k) for k in range(1, 25)]}
    rows = [(n, f, a) for n, items in notes.items() for f, a in items] + [(4, None, 1.0), (None, 100.0, 1.0), (None, 110.0, 1.0)]
    df = dissonance.same_timbre(spark.createDataFrame(rows, "note long, freq_hz double, amp double"), 1.5)
    got = {r.note: tuple(r)[1:] for r in df.collect()}
    assert set(got) == {*notes, 4, None} and got[4] == got[None] == (0.0,) * 4
    for note, items in notes.items():
        assert got[note] == pytest.approx(brute_timbre(items, 1.5), abs=1e-12)
    if most == 1024:  # partials by note, and the counts by which large notes are known
        assert executed(df).split("Initial Plan")[0].count("Exchange hashpartitioning(note") <= 3
