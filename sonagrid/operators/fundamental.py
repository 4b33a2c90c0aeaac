"""Fundamental frequency from samples, and the choice among candidates by a prior.

Frames are compared with themselves at every lag by the cumulative-mean-normalised difference, its
sums taken by Fourier transform for all frames of a sound at once. Two readings of it are given:
the first trough below one threshold, and votes over a range of thresholds. The choice is a join
with nothing: each candidate is corrected by small whole ratios, and the least deviation from the
prior wins in one aggregation.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonagrid.operators.signal import autocorrelation_f0, autocorrelation_peaks, autocorrelations_f0

#: Frames whose differences are held at a time.
FRAMES = 256
#: Short sounds that are tracked together: their arrays stay in a core's cache.
SOUNDS = 32
#: Thresholds of the vote; their weights fall linearly, so low thresholds count most.
THRESHOLDS = np.arange(0.01, 0.51, 0.01)
VOICED = 0.8
#: By their numbers i and j: the votes of thresholds i up to j, added up one by one.
_VOTES = np.array([np.concatenate([np.zeros(i), np.cumsum([0.0, *(THRESHOLDS[::-1] / THRESHOLDS.sum())[i:]])]) for i in range(len(THRESHOLDS) + 1)])
#: Tones of at least so many notes of one f0 and of at most so many orders are heard by tables.
ALIKE, ORDERS = 128, 16
#: Products of a multiplication of matrices at a time: so few that it stays on the task's own core.
PRODUCTS = 1 << 18
#: Decimals of candidates and confidences; beyond them they depend on how sums are made.
DIGITS = 8


def frames_of(x: np.ndarray, frame: int, hop: int) -> np.ndarray:
    """Whole frames; a shorter sound is one frame."""
    return x[None, :] if len(x) < frame else np.lib.stride_tricks.sliding_window_view(x, frame)[::hop]


def normalised_difference(frames: np.ndarray, longest: int) -> np.ndarray:
    """d'(lag) for lags 0 to ``longest``, each over a window of frame length less ``longest``; 1 where nothing differs yet."""
    n = frames.shape[1]
    window = n - longest
    size = 1 << (n - 1).bit_length()  # no lag wanted reaches beyond the frame
    spectrum = np.fft.rfft(frames, size)
    head = np.fft.rfft(frames[:, :window], size)
    cross = np.fft.irfft(spectrum * np.conj(head), size)[:, : longest + 1]
    power = np.concatenate([np.zeros((len(frames), 1)), np.cumsum(frames**2, axis=1)], axis=1)
    at = np.arange(longest + 1)
    energy = power[:, at + window] - power[:, at]
    energy += energy[:, :1].copy()
    return _by_mean(energy - 2 * cross, energy)


def _by_mean(d: np.ndarray, energy: np.ndarray) -> np.ndarray:
    """Differences at lags 0, 1, ... over the mean of those up to the lag; ``energy``: of both windows of a lag."""
    at = np.arange(d.shape[1])
    d = np.maximum(d, 0.0)
    d[:, 0] = 0.0
    d[d < 1e-10 * energy] = 0.0  # rounding of the sums
    total = np.cumsum(d, axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        out = d * at / total
    out[total <= 0] = 1.0
    out[:, 0] = 1.0
    return out


def _refined(d: np.ndarray, rows: np.ndarray, lag: np.ndarray) -> np.ndarray:
    """Lags moved to the lowest point of the parabola through three values."""
    inner = np.clip(lag, 1, d.shape[1] - 2)
    l, c, r = (d[rows, inner + k] for k in (-1, 0, 1))
    bend = l - 2 * c + r
    shift = np.where((inner == lag) & (bend > 1e-12), 0.5 * (l - r) / np.where(bend > 1e-12, bend, 1.0), 0.0)
    return lag + np.clip(shift, -1.0, 1.0)


def _troughs(d: np.ndarray, first: int) -> np.ndarray:
    """Local minima from lag ``first`` on."""
    low = np.zeros(d.shape, bool)
    low[:, 1:-1] = (d[:, 1:-1] <= d[:, :-2]) & (d[:, 1:-1] < d[:, 2:])
    low[:, : max(first, 1)] = False
    return low


def first_trough(d: np.ndarray, first: int, threshold: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """Per frame: the refined lag of the first trough below the threshold, else of the lowest value; and 1 - d' there."""
    rows = np.arange(len(d))
    low = _troughs(d, first) & (d < threshold)
    found = low.any(1)
    lag = np.where(found, low.argmax(1), first + d[:, first:].argmin(1))
    return _refined(d, rows, lag), 1 - d[rows, lag]


def voted_trough(d: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray]:
    """Per frame: the lag with most votes, and its share of them. Each threshold votes for its first trough; without one it has no vote."""
    rows = np.arange(len(d))
    low = np.where(_troughs(d, first), d, np.inf)
    reached = np.minimum.accumulate(low, axis=1)
    under = np.searchsorted(THRESHOLDS, reached, side="right")  # thresholds that are not above what is reached
    votes = np.zeros(d.shape)
    votes[:, 1:] = _VOTES[under[:, 1:], under[:, :-1]]
    lag = votes.argmax(1)
    return _refined(d, rows, np.maximum(lag, 1)), votes[rows, lag]


def tracked(x: np.ndarray, rate: float, low: float = 20.0, high: float = 2000.0, frame: int = 2048, hop: int = 512) -> list[tuple[str, float, float, int, int]]:
    """(method, f0, confidence, frames that count, frames) of a sound, the surest method first; silence has none.

    A frame spans two periods of the lowest frequency at least; f0 is the median over the frames
    that count: for votes those of which 0.8 agree. A sound shorter than a frame is one frame, and
    lags end at half of it.
    """
    x = np.asarray(x, float)
    if len(x) < 16 or not np.any(x) or not np.all(np.isfinite(x)):
        return []
    frame = frame_length(rate, low, frame)
    parts = frames_of(x - x.mean(), frame, hop)
    longest = min(int(rate / low) + 1, parts.shape[1] // 2)
    first = max(2, int(rate / high))
    if longest - first < 3:
        return []
    lags, sure, votes, share = [], [], [], []
    for i in range(0, len(parts), FRAMES):
        d = normalised_difference(parts[i : i + FRAMES], longest)
        for reading, at, by in ((first_trough, lags, sure), (voted_trough, votes, share)):
            a, b = reading(d, first)
            at.append(a)
            by.append(b)
    out = []
    lag, certain = np.concatenate(votes), np.concatenate(share)
    held = certain > VOICED
    if held.any():
        out.append(("votes", float(rate / np.median(lag[held])), float(certain[held].mean()), int(held.sum()), len(lag)))
    lag, certain = np.concatenate(lags), np.concatenate(sure)
    out.append(("trough", float(rate / np.median(lag)), float(certain.mean()), len(lag), len(lag)))
    plain = autocorrelation_f0(x[: max(4 * frame, 8192)], rate, low, high)
    if plain is not None:
        out.append(("autocorrelation", plain, 0.0, 1, 1))
    return [o for o in out if low <= o[1] <= high]


def frame_length(rate: float, low: float, frame: int = 2048) -> int:
    """Two periods of the lowest frequency at least."""
    return max(frame, int(2 * rate / low) + 2)


def tracked_together(x: np.ndarray, rate: float, low: float = 20.0, high: float = 2000.0) -> list[list[tuple[str, float, float, int, int]]]:
    """:func:`tracked` of each row, sounds of one length that are shorter than a frame."""
    n = x.shape[1]
    out: list[list] = [[] for _ in x]
    longest, first = min(int(rate / low) + 1, n // 2), max(2, int(rate / high))
    if n < 16 or longest - first < 3:
        return out
    heard = np.flatnonzero(x.any(1) & np.isfinite(x).all(1))
    for i in range(0, len(heard), SOUNDS):
        rows = heard[i : i + SOUNDS]
        own = x[rows]
        d = normalised_difference(own - own.mean(axis=1, keepdims=True), longest)
        voted, share = voted_trough(d, first)
        lag, sure = first_trough(d, first)
        plain = autocorrelations_f0(own, rate, low, high)
        for row, v, s, t, c, p in zip(rows.tolist(), (rate / voted).tolist(), share.tolist(), (rate / lag).tolist(), sure.tolist(), plain.tolist(), strict=True):
            found = [("votes", v, s, 1, 1)] if s > VOICED else []
            found += [("trough", t, c, 1, 1), ("autocorrelation", p, 0.0, 1, 1)]
            out[row] = [o for o in found if low <= o[1] <= high]
    return out


_FOUND = ("method", "place", "candidate_hz", "confidence", "counted", "frames")
_FOUND_SCHEMA = "method string, place int, candidate_hz double, confidence double, counted int, frames int"
_METHODS = pa.array(["votes", "trough", "autocorrelation"])
Batches = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def _found(key: str, keys: pa.Array, at: np.ndarray, columns: list, digits: int | None) -> pa.RecordBatch:
    """A batch of candidates: of which row each is, and their columns."""
    kinds = (pa.string(), pa.int32(), pa.float64(), pa.float64(), pa.int32(), pa.int32())
    plain = [np.round(np.asarray(c, float), digits) if k == pa.float64() and digits is not None else c for c, k in zip(columns, kinds, strict=True)]
    return pa.RecordBatch.from_arrays([keys.take(pa.array(at)), *(pa.array(c, k) for c, k in zip(plain, kinds, strict=True))], names=[key, *_FOUND])


def _tracking(key: str, low: float, high: float, digits: int | None = DIGITS) -> Batches:
    """Batches of key, samples and rate to batches of candidates."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists, rates = b.column("samples"), b.column("rate").to_numpy(zero_copy_only=False)
            bounds, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
            size = np.diff(bounds)
            usable = lists.is_valid().to_numpy(zero_copy_only=False) & (rates > 0)
            found: list[list] = [[] for _ in size]
            for n, hz in sorted(set(zip(size[usable].tolist(), rates[usable].tolist(), strict=True))):
                alike = np.flatnonzero(usable & (size == n) & (rates == hz))
                if 0 < n < frame_length(hz, low):
                    for i in range(0, len(alike), FRAMES):
                        own = alike[i : i + FRAMES]
                        for row, tracks in zip(own.tolist(), tracked_together(flat[bounds[own][:, None] + np.arange(n)], hz, low, high), strict=True):
                            found[row] = tracks
                else:
                    for row in alike.tolist():
                        found[row] = tracked(flat[bounds[row] : bounds[row + 1]], hz, low, high)
            at = np.array([i for i, tracks in enumerate(found) for _ in tracks], np.int64)
            out = [(method, place, hz, sure, counted, n) for tracks in found for place, (method, hz, sure, counted, n) in enumerate(tracks)]
            yield _found(key, b.column(0), at, list(zip(*out, strict=True)) or [[]] * len(_FOUND), digits)

    return task


def candidates(sounds: DataFrame, key: str, samples: str, rate: str, low: float = 20.0, high: float = 2000.0) -> DataFrame:
    """(key, method, place, candidate_hz, confidence, counted, frames) of every sound; place 0 is the surest. A map over the rows.

    Frequencies and confidences are rounded to :data:`DIGITS` decimals.

    ``samples`` is an array of doubles, ``rate`` a column. Sounds without any candidate have no row.
    """
    kind = sounds.schema[key].dataType.simpleString()
    given = sounds.select(key, F.col(samples).cast("array<double>").alias("samples"), F.col(rate).cast("double").alias("rate"))
    return given.mapInArrow(_tracking(key, low, high), f"{key} {kind}, {_FOUND_SCHEMA}")


def _sounding(key: str, samples: int, rate: float) -> Batches:
    """Batches of key, f0 and amplitudes to batches of key, f0, samples and rate, few notes at a time."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = 2 * np.pi / rate * np.arange(samples)
        for b in (whole.slice(i, FRAMES) for whole in batches for i in range(0, whole.num_rows, FRAMES)):
            lists, hz = b.column(2), b.column(1).to_numpy(zero_copy_only=False)
            bounds, flat = lists.offsets.to_numpy(), np.nan_to_num(lists.values.to_numpy(zero_copy_only=False))
            waves = np.zeros((b.num_rows, samples))
            for i in range(b.num_rows):
                for n, a in enumerate(flat[bounds[i] : bounds[i + 1]], 1):
                    if a:
                        waves[i] += a * np.sin(n * np.nan_to_num(hz[i]) * t)
            out = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * samples, pa.int32()), pa.array(waves.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), out, pa.array(np.full(b.num_rows, rate))], names=[key, "f0", "samples", "rate"])

    return task


def _given(notes: DataFrame, key: str, f0: str, amps: str) -> DataFrame:
    return notes.select(key, F.col(f0).cast("double").alias("f0"), F.coalesce(F.col(amps).cast("array<double>"), F.array().cast("array<double>")).alias("amps"))


def tones(notes: DataFrame, key: str, f0: str, amps: str, samples: int, rate: float) -> DataFrame:
    """(key, f0, samples, rate): each note's orders 1, 2, ... summed as sines of the amplitudes in an array; nulls are silent. A map over the rows."""
    kind = notes.schema[key].dataType.simpleString()
    return _given(notes, key, f0, amps).mapInArrow(_sounding(key, samples, rate), f"{key} {kind}, f0 double, samples array<double>, rate double")


@lru_cache(64)
def _tables(f0: float, orders: int, samples: int, rate: float, low: float, high: float) -> tuple[np.ndarray, ...]:
    """What :func:`tracked_together` sums over samples, by pairs of orders: differences, energies and autocorrelations at every lag.

    A tone is a sum of sines, so each of its sums is that of products of two amplitudes times a sum
    over two sines, which is the same for all tones of one f0.
    """
    longest = min(int(rate / low) + 1, samples // 2)
    window = samples - longest
    x = np.sin(np.arange(1, orders + 1)[:, None] * f0 * (2 * np.pi / rate * np.arange(samples)))
    x -= x.mean(axis=1, keepdims=True)
    p, q = np.triu_indices(orders)
    both = np.where(p == q, 1.0, 2.0)
    head, first = x[:, :window], x[:, :window] @ x[:, :window].T
    out = np.empty((3, len(p), longest + 1))
    for lag in range(longest + 1):
        tail = x[:, lag : lag + window]
        moved = x[:, : samples - lag] @ x[:, lag:].T
        for k, sums in enumerate(((head - tail) @ (head - tail).T, first + tail @ tail.T, (moved + moved.T) / 2)):
            out[k, :, lag] = both * sums[p, q]
    return p, q, *out


def _matmul(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a @ b``, few rows at a time, so that it isn't spread over other tasks' cores."""
    out, step = np.empty((len(a), b.shape[1])), max(1, PRODUCTS // b.size)
    for i in range(0, len(a), step):
        np.matmul(a[i : i + step], b, out=out[i : i + step])
    return out


def heard_together(amps: np.ndarray, f0: float, samples: int, rate: float, low: float, high: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """:func:`tracked_together` of tones of one f0 by their orders' amplitudes, without their samples: which of (votes, trough, autocorrelation) each row has, their f0 and confidence."""
    first = max(2, int(rate / high))
    p, q, differences, energies, products = _tables(f0, amps.shape[1], samples, rate, low, high)
    pairs = amps[:, p] * amps[:, q]
    d = _by_mean(_matmul(pairs, differences), _matmul(pairs, energies))
    voted, share = voted_trough(d, first)
    lag, sure = first_trough(d, first)
    hz = np.stack([rate / voted, rate / lag, autocorrelation_peaks(_matmul(pairs, products), samples, rate, first)], axis=1)
    has = (hz >= low) & (hz <= high)
    has[:, 0] &= share > VOICED
    return has, hz, np.stack([share, sure, np.zeros(len(d))], axis=1)


def _hearing(key: str, samples: int, rate: float, low: float, high: float, digits: int | None = DIGITS) -> Batches:
    """Batches of key, f0 and amplitudes to batches of candidates: notes that share f0 and length by tables, others by their samples."""
    make, track = _sounding(key, samples, rate), _tracking(key, low, high, digits)
    longest, first = min(int(rate / low) + 1, samples // 2), max(2, int(rate / high))
    short = 16 <= samples < frame_length(rate, low) and longest - first >= 3

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists, hz = b.column(2), b.column(1).to_numpy(zero_copy_only=False)
            bounds, flat = lists.offsets.to_numpy(), np.nan_to_num(lists.values.to_numpy(zero_copy_only=False))
            size = np.diff(bounds)
            done = np.zeros(b.num_rows, bool)
            fits = np.flatnonzero((size > 0) & (size <= ORDERS) & (hz > 0) & (hz <= high)) if short else []
            kinds, of, count = np.unique(np.stack([hz[fits], size[fits]]), axis=1, return_inverse=True, return_counts=True)
            for i in np.flatnonzero(count >= ALIKE):
                rows = fits[of.ravel() == i]
                f0, n = float(kinds[0, i]), int(kinds[1, i])
                amps = flat[bounds[rows][:, None] + np.arange(n)]
                top = np.abs(amps).max(1)
                done[rows[top == 0]] = True  # silence has no candidate
                heard = (top > 1e-100) & (top < 1e100)
                for own in (np.flatnonzero(heard)[k : k + FRAMES] for k in range(0, int(heard.sum()), FRAMES)):
                    has, tones, sure = heard_together(amps[own], f0, samples, rate, low, high)
                    row, method = np.nonzero(has)
                    place = (np.cumsum(has, axis=1) - 1)[row, method]
                    ones = np.ones(len(row), np.int32)
                    yield _found(key, b.column(0), rows[own][row], [_METHODS.take(pa.array(method)), place, tones[row, method], sure[row, method], ones, ones], digits)
                done[rows[heard]] = True
            if not done.all():
                yield from track(make(iter([b.take(pa.array(np.flatnonzero(~done)))])))

    return task


def tone_candidates(notes: DataFrame, key: str, f0: str, amps: str, samples: int, rate: float, low: float = 20.0, high: float = 2000.0, digits: int | None = DIGITS) -> DataFrame:
    """:func:`candidates` of :func:`tones`, heard in the task that makes them: no samples go through the JVM, and none are made of notes of few orders that share f0 with others. ``digits`` None rounds nothing."""
    kind = notes.schema[key].dataType.simpleString()
    return _given(notes, key, f0, amps).mapInArrow(_hearing(key, samples, rate, low, high, digits), f"{key} {kind}, {_FOUND_SCHEMA}")


def _cents(a: Column, b: Column) -> Column:
    return F.abs(1200 * F.log2(a / b))


def chosen(found: DataFrame, key: str, prior: str, most: int = 6, cents: float = 50.0) -> DataFrame:
    """One fundamental for each key of (key, place, candidate_hz, prior): f0_hz, raw_hz, ratio, error_before, error_after, status.

    With a prior each candidate is tried times and divided by 1 to ``most``; the least deviation
    wins (ties: the ratio nearest to 1, the smaller ratio, the surer candidate). Beyond ``cents``
    the prior itself is taken (status ``prior``), else status is ``corrected`` or ``direct``.
    Without a prior the surest candidate is taken as it is (``unchecked``). Candidates of 0 or
    below and nulls don't count; keys without any keep their prior, if there is one.
    """
    usable = F.col("candidate_hz") > 0
    rows = found.select(key, F.when(usable, F.col("place")).alias("place"), F.when(usable, F.col("candidate_hz")).alias("raw"), F.when(F.col(prior) > 0, F.col(prior)).alias("prior"))
    ratios = [*(float(n) for n in range(1, most + 1)), *(1.0 / n for n in range(2, most + 1))]
    off = lambda ratio: F.coalesce(F.round(_cents(F.col("raw") * ratio, F.col("prior")), 6), F.lit(0.0))
    tried = [F.struct(off(x).alias("off"), F.round(F.abs(F.log2(F.lit(x))), 6).alias("far"), F.lit(x).alias("ratio"), F.col("place"), F.col("raw")) for x in ratios]
    rows = rows.select(key, "place", "raw", "prior", F.when(F.col("raw").isNotNull(), F.least(*tried) if len(tried) > 1 else tried[0]).alias("best"))
    surest = F.min(F.when(F.col("raw").isNotNull(), F.struct("place", "raw"))).alias("surest")
    met = rows.groupBy(key).agg(F.min("best").alias("best"), surest, F.max("prior").alias("prior"), F.min(_cents(F.col("raw"), F.col("prior"))).alias("error_before"))
    near = F.col("prior").isNotNull() & F.col("best").isNotNull() & (F.col("best.off") <= cents)
    value = F.when(near, F.col("best.raw") * F.col("best.ratio")).otherwise(F.coalesce("prior", "surest.raw"))
    status = F.when(F.col("prior").isNull() & F.col("surest").isNotNull(), "unchecked").when(near, F.when(F.col("best.ratio") == 1, "direct").otherwise("corrected")).when(F.col("prior").isNotNull(), "prior")
    return met.select(key, value.alias("f0_hz"), F.when(near, F.col("best.raw")).alias("raw_hz"), F.when(near, F.col("best.ratio")).alias("ratio"), "error_before", F.when(near, F.col("best.off")).alias("error_after"), status.alias("status"))
