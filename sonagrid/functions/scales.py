"""Frequency scales, levels, windows and tolerances as column expressions."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def erb_bandwidth(f: Column) -> Column:
    """Equivalent rectangular bandwidth in Hz (Glasberg and Moore)."""
    return 0.108 * f + 24.7


def erb_rate(f: Column) -> Column:
    return 21.4 * F.log10(1 + 0.00437 * f)


def zwicker_bandwidth(f: Column) -> Column:
    """Critical bandwidth in Hz (Zwicker and Terhardt)."""
    return 25 + 75 * (1 + 1.4 * (f / 1000) * (f / 1000)) ** 0.69


def bark(f: Column) -> Column:
    return 13 * F.atan(0.00076 * f) + 3.5 * F.atan((f / 7500) * (f / 7500))


def amplitude_to_db(a: Column, least: float = 1e-12) -> Column:
    return 20 * F.log10(F.greatest(a, F.lit(least)))


def db_to_amplitude(db: Column) -> Column:
    return F.pow(F.lit(10.0), db / 20)


def power_to_db(p: Column, least: float = 1e-24) -> Column:
    return 10 * F.log10(F.greatest(p, F.lit(least)))


def db_to_power(db: Column) -> Column:
    return F.pow(F.lit(10.0), db / 10)


def cents(ratio: Column) -> Column:
    return 1200 * F.log2(ratio)


def cents_to_ratio(c: Column) -> Column:
    return F.pow(F.lit(2.0), c / 1200)


def stretched(n: Column, f0: Column, b: Column) -> Column:
    """Partial n of a stiff string: n f0 sqrt(1 + B n^2)."""
    return n * f0 * F.sqrt(1 + b * n * n)


def harmonic_tolerance(n: Column, f0: Column, bin_hz: float, tolerance_cents: float = 30.0, spacing_cap: float = 0.30) -> tuple[Column, Column]:
    """(tolerance in Hz, which limb decides): max(bin, min(n f0 c / 1200, cap f0))."""
    musical, cap = n * f0 * tolerance_cents / 1200, spacing_cap * f0
    inner = F.least(musical, cap)
    limb = F.when(inner < bin_hz, "bin").when(cap < musical, "spacing_cap").otherwise("cents")
    return F.greatest(F.lit(float(bin_hz)), inner), limb


def low_band_upper(f0: Column) -> Column:
    """Upper bound of the low-frequency compartment: min(f0 / 2, 80 Hz)."""
    return F.least(0.5 * f0, F.lit(80.0))


def sub_margin_percent(f0: Column) -> Column:
    """35, 25, 15 or 10 per cent, below 60, 120, 300 Hz and above."""
    return F.when(f0 < 60, 35.0).when(f0 < 120, 25.0).when(f0 < 300, 15.0).otherwise(10.0)


def low_frequency_class(f: Column, f0: Column, dc_floor: float = 20.0) -> Column:
    """dc, low_band, sub_fundamental or body."""
    return F.when(f < dc_floor, "dc").when(f <= low_band_upper(f0), "low_band").when(f < f0 * (1 - sub_margin_percent(f0) / 100), "sub_fundamental").otherwise("body")


def tier_factor(n_fft: Column, kind: Column, reference: int = 4096) -> Column:
    """N_ref / N for amplitude sums, its square for power sums, 1 for anything else."""
    ratio = F.lit(float(reference)) / n_fft
    return F.when(kind == "peak_amplitude_sum", ratio).when(kind == "peak_power_sum", ratio * ratio).otherwise(1.0)


def hop_length(policy: Column, n_fft: Column, fixed: int = 512) -> Column:
    return F.when(policy == "fixed", F.lit(fixed)).otherwise(F.floor(n_fft / 4).cast("int"))


#: Cosine terms of analysis windows.
WINDOW_TERMS = {"hann": (0.5, 0.5), "hamming": (0.54, 0.46), "blackman": (0.42, 0.5, 0.08), "blackmanharris": (0.35875, 0.48829, 0.14128, 0.01168), "boxcar": (1.0,)}
#: Bins that a peak's main lobe covers.
FOOTPRINT_BINS = {"blackmanharris": 8, "hann": 4, "hamming": 4, "blackman": 6}


def window(name: str, n: int) -> np.ndarray:
    k = 2 * math.pi * np.arange(n) / n
    return sum((-1) ** i * a * np.cos(i * k) for i, a in enumerate(WINDOW_TERMS[name])) + np.zeros(n)


def window_enbw_bins(name: str, n: int) -> float:
    """Equivalent noise bandwidth: N sum w^2 / (sum w)^2."""
    w = window(name, n)
    return float(n * np.sum(w * w) / np.sum(w) ** 2)


def footprint_hz(name: str, sample_rate: float, n_fft: int) -> float:
    return FOOTPRINT_BINS.get(name, 8) * sample_rate / n_fft


def periodogram_to_psd(power: Column, name: str, sample_rate: float, n_fft: int) -> Column:
    """One-sided power spectral density of |X|^2."""
    return 2 * power / (sample_rate * float(np.sum(window(name, n_fft) ** 2)))


def peak_energy(power: Column, name: str, n_fft: int) -> Column:
    """Energy of a sinusoid's peak: P / (sum w)^2."""
    return power / float(np.sum(window(name, n_fft)) ** 2)
