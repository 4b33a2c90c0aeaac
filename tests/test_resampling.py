"""Resampling: tones keep frequency and level, nothing folds over, blocks don't show, files come at one rate."""

from __future__ import annotations

import math
import wave
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonagrid.operators import uncertainty
from sonagrid.operators.signal import resampled
from sonagrid.sources import audio


def tone(hz: float, rate: int, seconds: float = 0.5) -> np.ndarray:
    return np.sin(2 * np.pi * hz * np.arange(int(rate * seconds)) / rate)


@pytest.mark.parametrize("to", [48000, 22050, 16000, 8000, 44101])
def test_a_tone_stays(to):
    got, want = resampled(tone(440, 44100), 44100, to), tone(440, to)
    assert abs(len(got) - len(want)) <= 1
    inner = slice(to // 20, len(want) - to // 20)
    assert np.abs(got[: len(want)][inner] - want[inner]).max() < 2e-3


def test_what_is_beyond_the_new_limit_goes():
    got = resampled(tone(7000, 44100), 44100, 8000)
    assert np.abs(got[400:-400]).max() < 1e-2


def test_blocks_do_not_show():
    x = np.random.default_rng(3).normal(size=5000)
    assert np.allclose(resampled(x, 44100, 32000, cells=1000), resampled(x, 44100, 32000), atol=1e-12)


def test_ends_and_nothing():
    assert len(resampled(np.zeros(0), 8000, 16000)) == 0
    assert len(resampled(np.ones(1), 8000, 16000)) == 2
    x = np.arange(5.0)
    assert np.array_equal(resampled(x, 8000, 8000), x)


def test_files_of_two_rates(spark, tmp_path):
    for rate in (16000, 22050):
        with wave.open(str(tmp_path / f"{rate}.wav"), "wb") as w:
            w.setnchannels(1), w.setsampwidth(2), w.setframerate(rate)
            w.writeframes((tone(440, rate) * 20000).astype("<i2").tobytes())
    rows = audio.read_audio(spark, str(tmp_path), to_rate=8000).collect()
    assert [(r.sample_rate, len(r.samples), r.status) for r in rows] == [(8000, 4000, "ok")] * 2
    for r in rows:
        assert np.argmax(np.abs(np.fft.rfft(r.samples))) == 220


def test_draws_that_rearrange_a_note_are_not_below_its_point(spark):
    """The share of draws below the point, by exact sums: rounding in another order of the same components does not count."""
    for amps in ((0.9, 0.33, 0.43), (0.58, 0.28, 0.81), (0.18, 0.79, 0.66)):
        s = np.log1p(np.sort(amps))
        picks = uncertainty.draw_indices(5, 0, np.arange(400), 0, np.arange(3), 3)
        sums, point = np.array([math.fsum(s[p]) for p in picks]), math.fsum(s)
        jack = np.array([point - x for x in s])
        off = jack.mean() - jack
        speed, normal = np.sum(off**3) / (6 * np.sum(off**2) ** 1.5), NormalDist()
        z0 = normal.inv_cdf(float(np.mean(sums < point)))
        want = [np.percentile(sums, 100 * normal.cdf(z0 + (z0 + z) / (1 - speed * (z0 + z)))) for z in (normal.inv_cdf(0.025), normal.inv_cdf(0.975))]
        got = uncertainty.bootstrap_scores(spark.createDataFrame([(5, "H", a) for a in amps], "note long, comp string, amp double"), draws=400).first()
        assert [got.density_low_bca, got.density_high_bca] == pytest.approx(want, rel=1e-9)


def test_notes_drawn_together_are_as_drawn_alone(spark):
    """Blocks of notes, parts of one size, and a part that is drawn on its own."""
    rows = [(k, "HIS"[(k + i) % 3], 0.05 + (k * 7 + i * 13) % 29 / 30) for k in range(60) for i in range(1 + k % 9)] + [(99, "H", 0.01 * i) for i in range(1, 101)]
    df = spark.createDataFrame(rows, "note long, comp string, amp double")
    together = {r.note: r for r in uncertainty.bootstrap_scores(df, draws=2000).collect()}
    assert len(together) == 61
    for k in (3, 8, 59, 99):
        alone = uncertainty.bootstrap_scores(df.filter(f"note = {k}"), draws=2000).first()
        assert list(together[k]) == [pytest.approx(v, rel=1e-9, abs=1e-12) if v is not None else None for v in alone]


def test_effective_number_draws_as_spark_hashes(spark):
    """The hash of note, draw and place in numpy is Spark's."""
    df = spark.createDataFrame([(k, 0.1 + i / 7) for k in (-3, 11) for i in range(5)], "note long, amp double")
    picks = spark.createDataFrame([(k, b, j) for k in (-3, 11) for b in range(1, 41) for j in range(1, 6)], "note long, b int, j int").withColumn("at", F.pmod(F.xxhash64(F.lit(7), "note", "b", "j"), F.lit(5))).collect()
    power = np.sort([(0.1 + i / 7) ** 2 for i in range(5)])
    got = {r.note: r for r in uncertainty.bootstrap_effective(df, draws=40).collect()}
    for k in (-3, 11):
        drawn = np.array([power[[p["at"] for p in picks if p.note == k and p.b == b]] for b in range(1, 41)])
        values = np.sort(drawn.sum(1) ** 2 / (drawn**2).sum(1))
        assert [got[k].low, got[k].high] == pytest.approx([values[1], values[38]])
