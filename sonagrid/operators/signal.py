"""Signals: framing, spectra, envelopes, fundamentals, smoothing, masking, greedy matching.

These are sequential folds or transforms over one note's array, so they run as Arrow functions over
batches of rows (one row a note or file); rows are independent.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonagrid.functions.scales import window


def power_spectrum(samples: np.ndarray, n_fft: int, hop: int, name: str = "hann") -> np.ndarray:
    """Mean power of the frames' one-sided spectra (reflected edges, centred frames)."""
    x = np.asarray(samples, float)
    if not len(x):
        return np.zeros(n_fft // 2 + 1)
    pad = n_fft // 2
    x = np.pad(x, pad, mode="reflect" if len(x) > pad else "edge")
    frames = np.lib.stride_tricks.sliding_window_view(x, n_fft)[::hop]
    return np.mean(np.abs(np.fft.rfft(frames * window(name, n_fft), axis=1)) ** 2, axis=0)


def resampled(samples: np.ndarray, rate: int, to: int, reach: int = 32, cells: int = 1 << 20) -> np.ndarray:
    """Samples at another rate by a windowed sinc that reaches ``reach`` zero crossings to each side.

    The kernel's cut-off is the lower of both Nyquist frequencies; places beyond the ends are silent.
    Output is made in blocks of about ``cells`` kernel values, so memory doesn't grow with the length.
    """
    x = np.asarray(samples, float)
    if rate == to or not len(x):
        return x
    share = math.gcd(rate, to)
    up, down = to // share, rate // share
    cut = min(1.0, up / down)
    side = math.ceil(reach / cut)
    steps = np.arange(-side, side + 1)
    padded = np.concatenate([np.zeros(side), x, np.zeros(side + 1)])
    out = np.empty(-(-len(x) * up // down))
    block = max(1, cells // len(steps))
    for first in range(0, len(out), block):
        whole, part = np.divmod(np.arange(first, min(first + block, len(out)), dtype=np.int64) * down, up)
        away = steps - part[:, None] / up
        kernel = np.sinc(cut * away) * np.where(np.abs(away) <= side, 0.5 + 0.5 * np.cos(np.pi * away / side), 0.0)
        kernel /= kernel.sum(axis=1, keepdims=True)
        out[first : first + block] = np.einsum("ij,ij->i", kernel, padded[whole[:, None] + steps + side])
    return out


def autocorrelation_f0(samples: np.ndarray, rate: float, low: float = 50.0, high: float = 2000.0) -> float | None:
    """The first strong peak of the normalised autocorrelation, refined by a parabola; None for silence."""
    found = autocorrelations_f0(np.asarray(samples, float)[None], rate, low, high)[0]
    return None if np.isnan(found) else float(found)


def autocorrelations_f0(samples: np.ndarray, rate: float, low: float = 50.0, high: float = 2000.0) -> np.ndarray:
    """:func:`autocorrelation_f0` of each row; NaN where there is none."""
    n = samples.shape[1]
    out = np.full(len(samples), np.nan)
    a, b = max(2, int(rate / high)), min(n // 2, int(rate / low) + 1)
    if n < 4 or b - a < 3:
        return out
    x = samples - samples.mean(axis=1, keepdims=True)
    heard = np.flatnonzero(x.any(1))
    r = np.fft.irfft(np.abs(np.fft.rfft(x[heard], 2 * n)) ** 2)[:, : b + 1]
    out[heard] = autocorrelation_peaks(r, n, rate, a)
    return out


def autocorrelation_peaks(r: np.ndarray, n: int, rate: float, first: int) -> np.ndarray:
    """:func:`autocorrelation_f0` from each row's sums of products at lags 0, 1, ... of ``n`` samples; lags from ``first`` to the last but one are looked at."""
    out, b = np.full(len(r), np.nan), r.shape[1] - 1
    r = r / r[:, :1] * n / np.arange(n, n - b - 1, -1)
    part = r[:, first:b]
    peaks = np.zeros(part.shape, bool)
    peaks[:, 1:-1] = (part[:, 1:-1] > part[:, :-2]) & (part[:, 1:-1] >= part[:, 2:])
    peaks &= part >= 0.9 * np.where(peaks, part, -np.inf).max(1, keepdims=True)
    row = np.flatnonzero(peaks.any(1))
    best = peaks[row].argmax(1) + first
    l, c, h = (r[row, best + k] for k in (-1, 0, 1))
    out[row] = rate / (best + 0.5 * (l - h) / (l - 2 * c + h))
    return out


def one_pole_envelope(samples: np.ndarray, rate: float, seconds: float = 0.010) -> np.ndarray:
    """|x| smoothed by a one-pole filter."""
    keep = np.exp(-1 / (seconds * rate))
    out, level = np.empty(len(samples)), 0.0
    for i, x in enumerate(np.abs(samples)):
        level = keep * level + (1 - keep) * x
        out[i] = level
    return out


def attack_sustain_release(samples: np.ndarray, rate: float) -> tuple[float, float, float]:
    """Seconds of attack (10 to 90 % of the envelope's peak), of sustain until it falls under 20 %, and of the rest."""
    e = one_pole_envelope(samples, rate)
    if not len(e) or e.max() <= 0:
        return 0.0, 0.0, 0.0
    top = int(np.argmax(e >= 0.9 * e.max()))
    start = int(np.argmax(e >= 0.1 * e.max()))
    after = np.flatnonzero(e[top:] < 0.2 * e.max())
    end = top + int(after[0]) if len(after) else len(e)
    return (top - start) / rate, (end - top) / rate, (len(e) - end) / rate


def trim_silence(samples: np.ndarray, threshold: float, pad: int) -> np.ndarray:
    """Without leading and trailing samples under a threshold, but ``pad`` of them."""
    loud = np.flatnonzero(np.abs(samples) > threshold)
    return samples[max(0, loud[0] - pad) : loud[-1] + 1 + pad] if len(loud) else samples[:0]


def savitzky_golay(values: np.ndarray, length: int = 7, order: int = 2) -> np.ndarray:
    """Least-squares polynomial smoothing with repeated edge values."""
    half = length // 2
    basis = np.vander(np.arange(-half, half + 1), order + 1, increasing=True)
    kernel = np.linalg.pinv(basis)[0]
    return np.convolve(np.pad(values, half, mode="edge"), kernel[::-1], mode="valid")


def moving_centroid_merge(freq: np.ndarray, amp: np.ndarray, fraction: float = 1.0) -> list[tuple[float, float]]:
    """Ascending components join while they lie within a fraction of an ERB of the growing group's centroid."""
    out: list[list[float]] = []
    for f, a in sorted(zip(freq, amp, strict=True)):
        e = a * a
        if out and f - out[-1][0] <= fraction * (0.108 * out[-1][0] + 24.7):
            total = out[-1][1] + e
            out[-1] = [(out[-1][0] * out[-1][1] + f * e) / total if total else f, total]
        else:
            out.append([f, e])
    return [(c, float(np.sqrt(e))) for c, e in out]


#: Orders that are laid out at once, however low a fundamental.
_ORDERS = 1 << 14


def greedy_orders(freq: np.ndarray, f0: float, b: float, cents: float = 50.0) -> list[tuple[int, int]]:
    """(order, place) pairs: each stretched order takes the nearest unused peak within a window, lowest order first.

    All orders up to the highest peak (and its window) are tried; a series that starts at 0 or below has none.
    """
    if not len(freq) or not f0 > 0:
        return []
    reach = float(np.max(freq)) * 2 ** (cents / 1200)
    order = np.argsort(freq, kind="stable")
    rising = np.asarray(freq, float)[order]
    free = np.ones(len(freq), bool)
    out = []
    last = int(reach / f0)
    for first in range(1, last + 1, _ORDERS):
        n = np.arange(first, min(first + _ORDERS, last + 1))
        want = n * f0 * np.sqrt(1 + b * n * n)
        low = np.searchsorted(rising, want * 2 ** (-cents / 1200) * (1 - 1e-12))
        high = np.searchsorted(rising, want * 2 ** (cents / 1200) * (1 + 1e-12), "right")
        # Only orders with a peak in their window are folded over.
        for k in np.flatnonzero((want <= reach) & (low < high)).tolist():
            near = np.arange(low[k], high[k])
            off = np.abs(1200 * np.log2(rising[near] / want[k]))
            held = free[near] & (off <= cents)
            if held.any():
                best = min(zip(off[held].tolist(), order[near[held]].tolist(), near[held].tolist(), strict=True))
                free[best[2]] = False
                out.append((int(n[k]), int(best[1])))
        if want[-1] > reach:
            break
    return out


def mask_components(freq: np.ndarray, db: np.ndarray, slope: float = 12.0, offset: float = -14.0) -> np.ndarray:
    """Which components stay, loudest first: one is masked if a stayer's skirt on the Bark scale covers it."""
    z = 13 * np.arctan(0.00076 * freq) + 3.5 * np.arctan((freq / 7500) ** 2)
    stays = np.zeros(len(freq), bool)
    for i in np.lexsort((freq, -db)):
        cover = db[stays] + offset - slope * np.abs(z[stays] - z[i])
        stays[i] = not np.any(cover >= db[i])
    return stays


def map_arrays(rows: DataFrame, key: str, arrays: list[str], fn, schema: str, keys: list[str] | None = None) -> DataFrame:
    """fn(arrays of one row) -> rows (tuples) of ``schema`` after the key; nulls count as empty arrays."""
    kind = rows.schema[key].dataType.simpleString()
    full = f"{key} {kind}, {schema}"
    names = [key, *[c.strip().split(" ")[0] for c in schema.split(",")]]
    kinds = {"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string()}
    types = [kinds[c.strip().split(" ")[1]] for c in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out_keys, out = [], []
            for k, *values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for row in fn(*[np.asarray(v if v is not None else [], float) for v in values]):
                    out_keys.append(k)
                    out.append(row)
            columns = list(zip(*out, strict=True)) or [[]] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(out_keys, batch.schema.field(0).type), *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]], names=names)

    return rows.select(key, *[F.col(a) for a in arrays]).mapInArrow(run, full)
