"""What a transform of a given length resolves: tolerances, guards, frame geometry and expected counts."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from sonagrid.functions.scales import window_enbw_bins


def bin_width(sample_rate: Column, n_fft: Column) -> Column:
    return F.when((sample_rate > 0) & (n_fft > 0), sample_rate / n_fft)


def enbw_hz(name: str, sample_rate: float, n_fft: int) -> float:
    """A window's equivalent noise bandwidth in Hz."""
    return window_enbw_bins(name, n_fft) * sample_rate / n_fft


def cents_span(f: Column, cents: float, least_hz: float = 2.0) -> Column:
    """Width in Hz of so many cents above f, at least ``least_hz``."""
    return F.greatest(F.lit(float(least_hz)), f * (2.0 ** (cents / 1200.0) - 1.0))


def perceptual_tolerance(f0: Column, order: Column, cents: float = 15.0, least_hz: float = 2.0) -> Column:
    return cents_span(order * f0, cents, least_hz)


def false_slots(slots: Column, false_alarm: float) -> Column:
    """Slots that noise alone is expected to fill; null for a negative number of slots."""
    return F.when(slots >= 0, slots * false_alarm)


def gated_mass(amp: Column, snr_db: Column, floor: Column) -> Column:
    """Amplitude above the floor, which the ratio gives where there is one; 0 without a positive amplitude."""
    level = F.coalesce(amp / F.pow(F.lit(10.0), snr_db / 20), F.when(floor >= 0, floor), F.lit(0.0))
    return F.when(amp > 0, F.greatest(F.lit(0.0), amp - level)).otherwise(0.0)


def saddle_bins(f0: Column, bin_hz: Column, least: int = 3, most: int = 256, unknown: int = 10) -> Column:
    """Half the harmonic spacing in bins, within bounds."""
    own = F.greatest(F.lit(least), F.least(F.lit(most), F.rint(0.5 * f0 / bin_hz).cast("int")))
    return F.when((f0 > 0) & (bin_hz > 0), own).otherwise(unknown)


def leakage_half_width(bin_hz: Column, lobe_bins: float = 4.0) -> Column:
    """Half a main lobe in Hz; 0 without a bin width."""
    return F.when(bin_hz > 0, 0.5 * lobe_bins * bin_hz).otherwise(0.0)


def protection_tolerance(bin_hz: Column, bins: float = 2.0, least_hz: float = 5.0) -> Column:
    return F.coalesce(F.greatest(F.lit(float(least_hz)), bins * bin_hz), F.lit(float(least_hz)))


def resolution_guard(f0: Column, n_fft: Column, sample_rate: Column, seconds: Column, most: int = 32768, most_ratio: float = 0.125) -> dict[str, Column]:
    """A longer transform where a bin is wider than a share of f0: n_fft, ratio, escalated, warning.

    The next power of two that resolves f0 is taken, up to ``most``, unless the sustained part
    (null: unlimited) is shorter than it.
    """
    ratio = sample_rate / n_fft / f0
    wanted = F.pow(F.lit(2.0), F.ceil(F.log2(F.ceil(sample_rate / (f0 * most_ratio))))).cast("int")
    wanted = F.least(F.greatest(wanted, n_fft), F.lit(most))
    fits = F.coalesce(wanted / sample_rate <= seconds, F.lit(True))
    longer = F.coalesce((ratio > most_ratio) & fits & (wanted > n_fft), F.lit(False))
    used = F.when(longer, wanted).otherwise(n_fft)
    final = sample_rate / used / f0
    return {"n_fft": used, "bin_to_f0": final, "escalated": longer, "warning": F.coalesce(final > most_ratio, F.lit(True))}


def overlap(n_fft: Column, hop: Column) -> Column:
    return F.when(hop > 0, n_fft / hop)


def hop_seconds(hop: Column, sample_rate: Column) -> Column:
    return F.when(sample_rate > 0, hop / sample_rate)


def frame_span(frames: Column, hop: Column, start: Column, end: Column) -> tuple[Column, Column]:
    """First and last (exclusive) frame of a span of samples; all frames if the span is missing or empty."""
    valid = F.coalesce(end > start, F.lit(False)) & (frames > 0)
    first = F.when(valid, F.greatest(F.lit(0), F.least(frames, F.rint(start / hop).cast("int")))).otherwise(0)
    last = F.when(valid, F.greatest(first + 1, F.least(frames, F.rint(end / hop).cast("int")))).otherwise(F.greatest(frames, F.lit(0)))
    return first, last


def expected_orders(f0: Column, low_hz: float, high_hz: float) -> Column:
    """How many harmonic orders lie in a range of frequencies."""
    first, last = F.greatest(F.lit(1), F.ceil(low_hz / f0)), F.floor(high_hz / f0)
    return F.when(f0 > 0, F.greatest(F.lit(0), last - first + 1)).otherwise(0).cast("long")


def expected_log_bins(low_hz: Column, high_hz: float, cents: float) -> Column:
    """How many log-frequency bins of so many cents a range has."""
    low = F.greatest(low_hz, F.lit(1e-6))
    return F.when(low < high_hz, F.ceil(1200 * F.log2(high_hz / low) / cents)).otherwise(0).cast("long")


def audio_problem(n_fft: Column, hop: Column, sample_rate: Column, samples: Column) -> Column:
    """The first fault of a transform's parameters, null if there is none."""
    faults = (
        (n_fft < 64, "n_fft under 64"),
        (n_fft > 65536, "n_fft over 65536"),
        (hop < 1, "no hop"),
        (hop > n_fft, "hop over n_fft"),
        (sample_rate < 8000, "rate under 8000"),
        (sample_rate > 192000, "rate over 192000"),
        (samples < n_fft, "shorter than n_fft"),
    )
    out = F.lit(None).cast("string")
    for condition, name in reversed(faults):
        out = F.when(condition, name).otherwise(out)
    return out


def register_by_frequency(f: Column, edges: tuple[float, ...] = (200.0, 400.0, 800.0), names: tuple[str, ...] = ("low", "mid", "high", "very_high"), unknown: str = "unknown") -> Column:
    """The name of the first range whose upper edge lies above f."""
    out = F.lit(names[-1])
    for edge, name in zip(reversed(edges), reversed(names[:-1]), strict=True):
        out = F.when(f < edge, name).otherwise(out)
    return F.when(f > 0, out).otherwise(unknown)


def diagnostic_upper(f0: Column, upper: Column, cap_hz: float = 200.0) -> Column:
    """Up to where low-frequency rows are exported: f0, at most the cap, but never under the compartment's bound."""
    return F.greatest(F.coalesce(F.when(upper > 0, upper), F.lit(80.0)), F.least(F.coalesce(F.when(f0 > 0, f0), F.lit(cap_hz)), F.lit(cap_hz)))


def regular_grid(step_hz: Column, sample_rate: float, n_fft: int, points: Column, slack: float = 0.35) -> Column:
    """Whether the median step of an axis of eight points or more is a transform's bin width."""
    df = sample_rate / n_fft
    return F.coalesce((points >= 8) & (F.abs(step_hz - df) <= slack * df), F.lit(False))


def log_log_slope_terms(n: Column, width: Column) -> tuple[Column, Column]:
    """(log n, log width) of positive pairs, for a regression of widths against sizes."""
    good = (n > 0) & (width > 0)
    return F.when(good, F.log(n)), F.when(good, F.log(width))


def normal_quantile(p: Column) -> Column:
    """Inverse of the standard normal distribution (Acklam's rational approximation, 1.2e-9 relative)."""
    a = (-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.3577518672690, -30.66479806614716, 2.506628277459239)
    b = (-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572)
    c = (-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783)
    d = (0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416)

    def poly(x: Column, of: tuple[float, ...]) -> Column:
        out = F.lit(of[0])
        for k in of[1:]:
            out = out * x + k
        return out

    tail = F.sqrt(-2 * F.log(F.least(p, 1 - p)))
    outer = poly(tail, c) / (poly(tail, d) * tail + 1)
    q = p - 0.5
    inner = q * poly(q * q, a) / (poly(q * q, b) * q * q + 1)
    value = F.when(p < 0.02425, outer).when(p > 1 - 0.02425, -outer).otherwise(inner)
    return F.when((p > 0) & (p < 1), value)


def normal_cdf(z: Column) -> Column:
    """The standard normal distribution (Abramowitz and Stegun 7.1.26, 1.5e-7 absolute)."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    tail = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * F.exp(-x * x) / 2
    return F.when(z >= 0, 1 - tail).otherwise(tail)
