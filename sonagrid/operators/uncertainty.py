"""Resampling without a random generator: draws are indexed by a hash, so any partitioning gives the same."""

from __future__ import annotations

from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonagrid.functions import phi as weights


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows dealt by note over all shuffle partitions: few bytes a note but much work, which AQE would merge into few tasks."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "note")


_X1, _X2, _X3, _X5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))


def _hashed(value: np.ndarray, state: np.ndarray) -> np.ndarray:
    """The 64-bit xxHash of non-negative 32-bit integers, seeded by the hash of what came before: F.xxhash64(..., value)."""
    h = (state + (_X5 + np.uint64(4))) ^ (value.astype(np.uint64) * _X1)
    h = (h << np.uint64(23) | h >> np.uint64(41)) * _X2 + _X3
    h ^= h >> np.uint64(33)
    h *= _X2
    h ^= h >> np.uint64(29)
    h *= _X3
    h ^= h >> np.uint64(32)
    return h


def bootstrap_effective(components: DataFrame, draws: int = 1200, level: float = 0.95, seed: int = 7) -> DataFrame:
    """Percentile interval of the effective number of components per note, null with fewer than three.

    A note's amplitudes are one array; draw b takes element pmod(hash(note, b, j), n) at place j. One
    grouping by note; notes of one size are drawn together, place by place, in blocks of bounded memory.
    """
    rows = _dealt(components).groupBy("note").agg(F.array_sort(F.collect_list(F.col("amp") * F.col("amp"))).alias("p"))
    total = F.aggregate("p", F.lit(0.0), lambda s, x: s + x)
    rows = rows.select("note", F.size("p").cast("long").alias("n"), F.try_divide(total * total, F.aggregate("p", F.lit(0.0), lambda s, x: s + x * x)).alias("estimate"), F.xxhash64(F.lit(seed), "note").alias("state"), "p")
    places = [int(round(q * (draws - 1))) for q in ((1 - level) / 2, (1 + level) / 2)]

    def limits(state: np.ndarray, start: np.ndarray, n: int, p: np.ndarray) -> np.ndarray:
        """(notes, 2) limits of notes of one size; NaN is kept, a draw without any power (null) comes last and is -1 here."""
        drawn = _hashed(np.arange(1, draws + 1), state[:, None])
        total, squares = np.zeros(drawn.shape), np.zeros(drawn.shape)
        for j in range(1, n + 1):
            h = _hashed(np.array(j), drawn).view(np.int64)
            x = p[start[:, None] + (h - h // n * n)]
            total += x
            squares += x * x
        empty = squares == 0
        with np.errstate(all="ignore"):
            value = np.sort(np.where(empty, np.nan, total * total / squares), axis=1)
        held = draws - empty.sum(1)
        return np.stack([np.where(at < held, value[:, at], -1.0) for at in places], axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, lists = b.column(1).to_numpy(), b.column(4)
            start = lists.offsets.to_numpy()[:-1].astype(np.int64) - lists.offsets[0].as_py()
            state, p = b.column(3).to_numpy().view(np.uint64), lists.flatten().to_numpy(zero_copy_only=False)
            out = np.full((len(n), 2), -1.0)
            step = max(1, _BLOCK // draws)
            for size in np.unique(n[n > 2]).tolist():
                alike = np.flatnonzero(n == size)
                for i in range(0, len(alike), step):
                    own = alike[i : i + step]
                    out[own] = limits(state[own], start[own], size, p)
            ends = [pa.array(c, mask=c < 0) for c in out.T]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), *ends], names=["note", "n", "estimate", "low", "high"])

    kind = components.schema["note"].dataType.simpleString()
    out = rows.mapInArrow(run, f"note {kind}, n long, estimate double, low double, high double")
    return out.select("note", "n", "estimate", "low", "high", F.try_divide(100 * (F.col("high") - F.col("low")), F.abs("estimate")).alias("width_percent"))


def jackknife_effective(components: DataFrame) -> DataFrame:
    """Leave-one-out effective numbers in closed form from a note's sums: mean, and the jackknife standard error."""
    p = F.col("amp") * F.col("amp")
    sums = components.groupBy("note").agg(F.sum(p).alias("s"), F.sum(p * p).alias("q"), F.count("*").alias("n"))
    rows = components.select("note", p.alias("p")).join(sums, "note").filter("n > 1")
    left = F.try_divide((F.col("s") - F.col("p")) * (F.col("s") - F.col("p")), F.col("q") - F.col("p") * F.col("p"))
    out = rows.withColumn("x", left).groupBy("note").agg(F.avg("x").alias("mean"), F.var_pop("x").alias("v"), F.max("n").alias("n"))
    return out.select("note", "mean", F.sqrt((F.col("n") - 1) * F.col("v")).alias("std_error"))


_PRIME = 2**31 - 1
_NORMAL = NormalDist()


#: Places that are drawn at once, whatever a note's size and the number of draws.
_AT_ONCE = 1 << 20
#: Cells of a block of notes that are drawn together: its arrays stay in a core's cache.
_BLOCK = 1 << 16
#: Parts of more components are drawn on their own, by :func:`drawn_sums`.
_SMALL = 64


def _folded(x: np.ndarray) -> np.ndarray:
    """x modulo 2^31 - 1 for 0 <= x < 2^63, without division."""
    x = (x & _PRIME) + (x >> 31)
    x = (x & _PRIME) + (x >> 31)
    return np.where(x >= _PRIME, x - _PRIME, x)


def _uniform(x: np.ndarray) -> np.ndarray:
    """The whole number below 2^31 - 1 that a draw's linear form leads to."""
    x = _folded(x)
    x = _folded(x * x + 12345)
    return _folded(x * x + 6789)


def draw_indices(note: int, seed: int, draw: np.ndarray, part: int, place: np.ndarray, n: int) -> np.ndarray:
    """(draws, places) elements from 0 to n - 1: whole-number arithmetic on note, draw, place and part, the same in any engine."""
    return _uniform(seed % _PRIME + note % 1000003 * 7919 + draw[:, None] * 104729 + place * 1299709 + part * 15485863) % n


def _sums(amp: np.ndarray, s: np.ndarray) -> np.ndarray:
    """What scores need of components (last axis): sums of s, of its square, how many are above 0, and energy."""
    return np.stack([s.sum(-1), (s * s).sum(-1), (s > 0).sum(-1).astype(float), (amp * amp).sum(-1)], axis=-1)


def drawn_sums(note: int, seed: int, draws: int, part: int, amp: np.ndarray, s: np.ndarray) -> np.ndarray:
    """(draws, 4) sums of the elements that each draw takes, ``_AT_ONCE`` places at a time."""
    n = len(s)
    out = np.zeros((draws, 4))
    step = max(1, _AT_ONCE // max(1, n))
    for b in range(0, draws, step):
        draw = np.arange(b, min(draws, b + step), dtype=np.int64)
        for j in range(0, n, _AT_ONCE):
            at = draw_indices(note, seed, draw, part, np.arange(j, min(n, j + _AT_ONCE), dtype=np.int64), n)
            out[b : b + len(draw)] += _sums(amp[at], s[at])
    return out


def percentiles(rising: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The q-th quantile of each row in ascending order, interpolated; NaN where a row has one."""
    h = q * (rising.shape[1] - 1)
    at = np.floor(h).astype(np.int64)
    row = np.arange(len(rising))
    a, b = rising[row, at], rising[row, np.minimum(at + 1, rising.shape[1] - 1)]
    t, step = h - at, b - a
    return np.where(np.isnan(rising[:, -1]), np.nan, np.where(t < 0.5, a + step * t, b - step * (1 - t)))


def bca_limits(share: np.ndarray, rising: np.ndarray, speed: np.ndarray, level: float) -> list[np.ndarray]:
    """Efron's bias-corrected accelerated interval of each row of draws; NaN where it is not defined.

    ``share`` counts the draws below the point (those that only rearrange it, equal but for rounding,
    are not), ``speed`` is the acceleration from the jackknife.
    """
    draws = rising.shape[1]
    least = 1 / (draws + 1)
    normal = np.array([_NORMAL.inv_cdf(min(max(k / draws, least), 1 - least)) for k in range(draws + 1)])
    z0 = normal[share]
    out = []
    for q in ((1 - level) / 2, (1 + level) / 2):
        z = z0 + _NORMAL.inv_cdf(q)
        below = 1 - speed * z
        held = np.abs(below) > 1e-12
        at = np.array([_NORMAL.cdf(x) for x in (z0 + z / np.where(held, below, 1.0)).tolist()])
        out.append(np.where(held, percentiles(rising, at), np.nan))
    return out


def _scores(mass: np.ndarray, squares: np.ndarray, count: np.ndarray, share: np.ndarray, first: np.ndarray, balance: float) -> np.ndarray:
    """(score, note, ...): plain, strict and balanced density from sums per part (first axis); a note's parts begin at ``first``."""
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        penalty = np.where((squares > 0) & (count > 0), mass * mass / squares / count, 0.0)
        weighted = share * mass
        return np.stack([np.add.reduceat(x, first, axis=0) for x in (weighted, weighted * penalty, weighted * penalty**balance)])


def _shares(energy: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Each part's share of its note's energy."""
    total = np.repeat(np.add.reduceat(energy, first, axis=0), np.diff(np.append(first, len(energy))), axis=0)
    with np.errstate(invalid="ignore"):
        return np.divide(energy, total, out=np.zeros_like(energy), where=total > 1e-30)


_SCORES = ("density", "strict", "balanced")


def bootstrap_scores(components: DataFrame, name: str = "log", balance: float = 0.5, draws: int = 800, level: float = 0.95, seed: int = 0, recompute: bool = True) -> DataFrame:
    """Resampling intervals of a note's plain, strict and balanced density; null with two components or fewer.

    Input: note, comp, amp. Components are drawn with replacement within their compartment; energy
    shares are computed anew in every draw, or kept (``recompute``). Per score: the point, its
    percentile and BCa limits, the draws' standard deviation as a share of the point, and their bias. Draws
    are indexed (:func:`draw_indices`), so any partitioning gives the same. One grouping by note; a
    note's components are flat arrays in one task; notes are drawn together in blocks, and memory for
    the draws is bounded, whatever their number.
    """
    a = F.when(F.col("amp") >= 0, F.col("amp"))
    item = F.struct("comp", a.alias("amp"), weights.phi(name, a).alias("s"))
    notes = _dealt(components.filter(a.isNotNull())).groupBy("note").agg(F.sort_array(F.collect_list(item)).alias("items"))
    names = [f"{s}{x}" for s in _SCORES for x in ("", "_low", "_high", "_low_bca", "_high_bca", "_relative", "_bias")]

    def drawn(key: np.ndarray, part: np.ndarray, start: np.ndarray, size: np.ndarray, sums: np.ndarray, amp: np.ndarray, s: np.ndarray) -> np.ndarray:
        """(sum, part, draw): what each draw of each part sums up to; parts of one size go together, place by place."""
        out = np.zeros((4, len(size), draws))
        form = seed % _PRIME + key % 1000003 * 7919 + part * 15485863
        for n in np.unique(size).tolist():
            alike = np.flatnonzero(size == n)
            if n == 1:
                out[:, alike] = sums[:, start[alike], None]
            elif n <= _SMALL:
                x, at, own = form[alike, None] + np.arange(draws) * 104729, start[alike, None], np.zeros((4, len(alike), draws))
                for j in range(n):
                    picked = _uniform(x + j * 1299709).astype(np.uint32)
                    picked = at + (picked - picked // np.uint32(n) * np.uint32(n))
                    for k in range(4):
                        own[k] += sums[k][picked]
                out[:, alike] = own
            else:
                for i in alike.tolist():
                    own = slice(start[i], start[i] + n)
                    out[:, i] = drawn_sums(int(key[i]), seed, draws, int(part[i]), amp[own], s[own]).T
        return out

    def acceleration(sums: np.ndarray, whole: np.ndarray, share: np.ndarray, size: np.ndarray, first: np.ndarray) -> np.ndarray:
        """(score, note): BCa acceleration from the scores with one component less, for each component."""
        parts = np.diff(np.append(first, len(size)))
        note = np.repeat(np.arange(len(first)), np.add.reduceat(size, first))
        own = np.repeat(np.arange(len(size)), size)
        jack = np.empty((len(_SCORES), len(own)))
        for i in range(0, len(own), _BLOCK):
            at = np.arange(i, min(i + _BLOCK, len(own)))
            n = parts[note[at]]
            begin = np.cumsum(n) - n
            row = np.repeat(at, n)
            seg = first[note[row]] + np.arange(len(row)) - np.repeat(begin, n)
            left = whole[:, seg] - np.where(seg == own[row], sums[:, row], 0.0)
            jack[:, at] = _scores(*left[:3], _shares(np.maximum(left[3], 0), begin) if recompute else share[seg], begin, balance)
        begin = np.searchsorted(note, np.arange(len(first)))
        off = (np.add.reduceat(jack, begin, axis=1) / np.diff(np.append(begin, len(own))))[:, note] - jack
        spread, cubes = np.add.reduceat(off**2, begin, axis=1), np.add.reduceat(off**3, begin, axis=1)
        return np.where(spread > 1e-30, cubes / (6 * np.where(spread > 1e-30, spread, 1.0) ** 1.5), 0.0)

    def scored(keys: np.ndarray, bounds: np.ndarray, comp: np.ndarray, amp: np.ndarray, s: np.ndarray) -> np.ndarray:
        """(column, note) of notes whose components come sorted by compartment; NaN stands for null."""
        new = np.zeros(len(s), bool)
        new[1:] = comp[1:] != comp[:-1]
        new[bounds[:-1]] = True
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, len(s)))
        first = np.searchsorted(start, bounds[:-1])
        parts = np.diff(np.append(first, len(start)))
        note = np.repeat(np.arange(len(keys)), parts)
        part = np.arange(len(start)) - first[note]
        sums = np.stack([s, s * s, (s > 0).astype(float), amp * amp])
        whole = np.add.reduceat(sums, start, axis=1)
        share = _shares(whole[3], first)
        point = _scores(*whole[:3], share, first, balance)
        out = np.full((len(_SCORES), 7, len(keys)), np.nan)
        out[:, 0] = point
        speed = acceleration(sums, whole, share, size, first)
        # Notes in blocks of so many parts that their draws fill a block.
        block = (first * draws) // _BLOCK
        edges = np.append(np.flatnonzero(np.diff(block, prepend=-1)), len(keys))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            i, j = first[a], first[b] if b < len(keys) else len(start)
            got = drawn(keys[note[i:j]], part[i:j], start[i:j], size[i:j], sums, amp, s)
            held = _shares(got[3], first[a:b] - i) if recompute else share[i:j, None]
            for k, own in enumerate(_scores(*got[:3], held, first[a:b] - i, balance)):
                x, rising = point[k, a:b], np.sort(own, axis=1)
                for at, q in ((1, 50 * (1 - level)), (2, 50 * (1 + level))):
                    out[k, at, a:b] = percentiles(rising, np.full(b - a, q / 100))
                out[k, 3, a:b], out[k, 4, a:b] = bca_limits((own < (x - 1e-12 * np.abs(x))[:, None]).sum(1), rising, speed[k, a:b], level)
                out[k, 5, a:b] = np.where(np.abs(x) > 1e-30, own.std(axis=1, ddof=1) / np.where(np.abs(x) > 1e-30, np.abs(x), 1.0), np.nan)
                out[k, 6, a:b] = own.mean(axis=1) - x
        out[:, 1:, np.diff(bounds) <= 2] = np.nan
        return out.reshape(-1, len(keys))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            items = b.column(1)
            bounds = items.offsets.to_numpy().astype(np.int64) - items.offsets[0].as_py()
            comp, amp, s = items.flatten().flatten()
            comp = comp.dictionary_encode(null_encoding="encode").indices.to_numpy()
            with np.errstate(invalid="ignore"):
                columns = scored(b.column(0).to_numpy().astype(np.int64), bounds, comp, amp.to_numpy(), s.to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(bounds)), *(pa.array(c, mask=np.isnan(c)) for c in columns)], names=["note", "n", *names])

    kind = components.schema["note"].dataType.simpleString()
    return notes.mapInArrow(run, f"note {kind}, n long, " + ", ".join(f"{c} double" for c in names))


def interval_basis(intervals: DataFrame, score: str, frames: str, width_limit: float = 25.0, least_frames: int = 8, least_parts: int = 3) -> DataFrame:
    """How wide an interval is in per cent, whether that is too wide, and what it rests on: frames, components, or neither."""
    width = F.try_divide(100 * (F.col(f"{score}_high") - F.col(f"{score}_low")), F.abs(score))
    basis = F.when(F.col(frames) >= least_frames, "frames").when(F.col("n") >= least_parts, "components").otherwise("none")
    return intervals.select("note", width.alias("width_percent"), F.coalesce(width > width_limit, F.lit(False)).alias("wide"), basis.alias("basis"), F.col(frames).alias("frames"), "n")
