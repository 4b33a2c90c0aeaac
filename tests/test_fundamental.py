"""Fundamentals of synthetic sounds, the choice by a prior, and partials from peaks, against plain versions."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonagrid.operators import fundamental, partials
from sonagrid.operators.signal import autocorrelation_f0

RATE = 8000.0


def sound(f0: float, orders: range, noise: float = 0.0, seconds: float = 0.5) -> np.ndarray:
    r = np.random.default_rng(int(f0))
    t = np.arange(int(seconds * RATE)) / RATE
    return sum(np.sin(2 * np.pi * f0 * n * t + n) / n for n in orders) + noise * r.normal(size=len(t))


def test_difference_is_what_it_says():
    x = np.random.default_rng(1).normal(size=(3, 400))
    x[2] = 0
    longest = 150
    got = fundamental.normalised_difference(x, longest)
    for row, d in zip(x, got, strict=True):
        raw = [sum((row[j] - row[j + lag]) ** 2 for j in range(400 - longest)) for lag in range(longest + 1)]
        want = [1.0] + [raw[k] * k / sum(raw[1 : k + 1]) if sum(raw[1 : k + 1]) else 1.0 for k in range(1, longest + 1)]
        assert d == pytest.approx(want, abs=1e-8)


@pytest.mark.parametrize("f0", [55.0, 110.0, 196.3, 440.0, 987.7])
@pytest.mark.parametrize(("orders", "noise"), [(range(1, 6), 0.0), (range(2, 7), 0.0), (range(1, 6), 0.1)])
def test_tracks_tones_without_their_first_partial_and_with_noise(f0, orders, noise):
    orders = range(orders.start, min(orders.stop, int(RATE / 2 / f0)))
    found = dict(x[:2] for x in fundamental.tracked(sound(f0, orders, noise), RATE))
    assert any(abs(hz / f0 - 1) < 0.01 for hz in found.values())
    assert abs(found.get("votes", found.get("trough")) / f0 - 1) < 0.01


def test_no_candidate_in_silence_or_nothing():
    for x in (np.zeros(4000), np.zeros(0), np.ones(3), np.full(4000, np.nan), np.ones(4000)):
        assert all(len(c) == 5 and 20 <= c[1] <= 2000 for c in fundamental.tracked(x, RATE))
    assert fundamental.tracked(np.zeros(4000), RATE) == []


def test_candidates_over_rows(spark):
    rows = [(1, sound(220.0, range(1, 5)).tolist(), RATE), (2, [], RATE), (3, None, RATE), (4, [0.0] * 3000, RATE), (5, sound(330.0, range(1, 4)).tolist(), 0.0), (6, sound(330.0, range(1, 4), seconds=0.1).tolist(), RATE)]
    found = fundamental.candidates(spark.createDataFrame(rows, "k long, s array<double>, r double"), "k", "s", "r").collect()
    assert {x.k for x in found} == {1, 6}
    assert all(abs(x.candidate_hz / 220 - 1) < 0.01 for x in found if x.k == 1)
    assert all(x.place == i for k in (1, 6) for i, x in enumerate(sorted((y for y in found if y.k == k), key=lambda y: y.place)))


def test_choice_by_prior(spark):
    rows = [
        (1, 0, 660.0, 220.0), (1, 1, 500.0, 220.0),  # a third
        (2, 0, 220.1, 220.0),
        (3, 0, 300.0, 220.0),  # no ratio fits
        (4, 0, 123.0, None), (4, 1, 100.0, None),
        (5, None, None, 220.0), (6, None, None, None), (7, 0, -5.0, 110.0), (8, 0, 55.0, 220.0), (8, 1, 880.0, 220.0),
    ]
    got = {x.k: x for x in fundamental.chosen(spark.createDataFrame(rows, "k long, place int, candidate_hz double, prior double"), "k", "prior").collect()}
    assert [got[k].status for k in range(1, 9)] == ["corrected", "direct", "prior", "unchecked", "prior", None, "prior", "corrected"]
    assert [got[k].f0_hz for k in range(1, 9)] == pytest.approx([220.0, 220.1, 220.0, 123.0, 220.0, None, 110.0, 220.0])
    assert got[1].ratio == pytest.approx(1 / 3) and got[8].ratio == 0.25  # 0.25 before 4: the smaller of equally far ratios
    assert got[1].error_before > 1000 and got[1].error_after == 0


def test_tones_have_their_frequency(spark):
    notes = spark.createDataFrame([(1, 200.0, [0.0, 1.0, None]), (2, 100.0, None)], "k long, f0 double, a array<double>")
    rows = {x.k: np.array(x.samples) for x in fundamental.tones(notes, "k", "f0", "a", 800, RATE).collect()}
    assert rows[1] == pytest.approx(np.sin(2 * math.pi * 400 * np.arange(800) / RATE), abs=1e-9) and not rows[2].any()


# --- peaks ---


def plain_partials(freq, f0, cents):
    r = 2 ** (cents / 1200) - 1
    used, out = set(), []
    for n in range(1, int(max(freq) * 2 / f0) + 2):
        best = [(round(abs(f - n * f0), 9), i) for i, f in enumerate(freq) if i not in used and abs(f - n * f0) <= n * f0 * r]
        if best:
            used.add(min(best)[1])
            out.append((n, min(best)[1]))
    return out


@pytest.mark.parametrize("cents", [20.0, 60.0])
def test_orders_take_their_nearest_peak_once(spark, cents):
    """Above the forties windows of orders overlap, so that several claim one peak."""
    r = np.random.default_rng(int(cents))
    notes = {1: 25.0, 2: 110.0, 3: 0.0, 4: None}
    peaks = {n: np.sort(np.round(r.uniform(20, 4000, 250), 4)) for n in notes}
    rows = [(n, i, float(f), 1.0) for n, fs in peaks.items() for i, f in enumerate(fs)]
    got = partials.harmonic_partials(spark.createDataFrame(rows, "note long, bin long, freq_hz double, amp double"), spark.createDataFrame(list(notes.items()), "note long, f0_hz double"), cents).collect()
    for n, f0 in notes.items():
        assert sorted((x.n, x.bin) for x in got if x.note == n) == (plain_partials(peaks[n], f0, cents) if f0 else [])


def test_peaks_of_a_spectrum(spark):
    """Refined to the true place of a Gaussian peak; weaker neighbours, the floor and the ends give none; null is 0."""
    bins = np.arange(60)
    amp = 0.01 + np.exp(-((bins - 20.3) ** 2) / 4) + 0.5 * np.exp(-((bins - 40.0) ** 2) / 4)
    amp[[0, 59, 50]] = [9.0, 9.0, 0.0105]
    rows = [(1, int(b), 10.0 * int(b), float(a)) for b, a in zip(bins, amp, strict=True)] + [(2, b, 10.0 * b, None) for b in range(5)]
    got = partials.spectral_peaks(spark.createDataFrame(rows, "note long, bin long, freq_hz double, amp double")).orderBy("bin").collect()
    assert [x.bin for x in got] == [20, 40]
    assert got[0].freq_hz == pytest.approx(203.0, abs=0.3) and got[0].amp == pytest.approx(1.01, abs=0.01)


def test_energy_shares(spark):
    peaks = spark.createDataFrame([(1, 1, 50.0, 1.0), (1, 2, 100.0, 2.0), (1, 3, 260.0, 2.0), (2, 1, 9.0, 0.0)], "note long, bin long, freq_hz double, amp double")
    mine = partials.harmonic_partials(peaks, spark.createDataFrame([(1, 100.0)], "note long, f0_hz double"))
    got = {x.note: tuple(x)[1:] for x in partials.peak_energy(peaks, mine, 80.0).collect()}
    assert got[1] == pytest.approx((3, 1, 4 / 9, 1 / 9, 4 / 9)) and got[2] == (1, 0, None, None, None)


def test_sounds_tracked_together_are_as_tracked_alone(spark):
    """Short sounds of two lengths and rates among silence, gaps and a long one; a map over batches gives the same tracks."""
    x = [sound(f0, range(1, 5), noise, 0.2) for f0, noise in ((110, 0.0), (233, 0.3), (440, 0.05), (61, 1.0))]
    x += [np.zeros(1600), np.full(1600, np.nan), np.ones(1600), np.ones(10), np.cos(np.pi / 1600 * np.arange(1600))]
    for got, own in zip(fundamental.tracked_together(np.stack([s for s in x if len(s) == 1600]), RATE), [s for s in x if len(s) == 1600], strict=True):
        assert [(m, pytest.approx(hz), pytest.approx(sure), c, n) for m, hz, sure, c, n in fundamental.tracked(own, RATE)] == got
    sounds = [*x, x[0][:1200], sound(196, range(1, 4)), None, np.zeros(0)]
    rows = spark.createDataFrame([(i, None if s is None else [float(v) for v in s], RATE if i != 2 else 16000.0) for i, s in enumerate(sounds)], "k int, samples array<double>, rate double")
    got = {}
    for r in fundamental.candidates(rows, "k", "samples", "rate").collect():
        got.setdefault(r.k, []).append((r.method, r.candidate_hz))
    want = {i: [(m, pytest.approx(hz)) for m, hz, *_ in fundamental.tracked(s, RATE if i != 2 else 16000.0)] for i, s in enumerate(sounds) if s is not None}
    assert got == {i: w for i, w in want.items() if w}


def test_no_strong_peak_is_none():
    """A slow fall has peaks of negative correlation only."""
    x = np.linspace(1, -1, 400) ** 3 + 0.01 * np.sin(np.arange(400))
    assert autocorrelation_f0(x, RATE, 30.0, 60.0) is None


def test_tones_heard_where_they_are_made(spark):
    notes = spark.createDataFrame([(k, 90.0 + 7 * (k % 40), None if k == 9 else [1.0, 0.0, None, 0.5][: k % 5]) for k in range(600)], "k long, f0 double, amps array<double>")
    want = fundamental.candidates(fundamental.tones(notes, "k", "f0", "amps", 2000, RATE), "k", "samples", "rate", 40.0, 2000.0)
    got = fundamental.tone_candidates(notes, "k", "f0", "amps", 2000, RATE, 40.0, 2000.0)
    assert got.schema == want.schema and got.count() > 900
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
