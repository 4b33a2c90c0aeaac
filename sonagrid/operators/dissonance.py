"""Pairwise dissonance and roughness of a note's partials.

All pairs of a note count. Counts and amplitude sums over pairs have closed forms over the note's
rows in order of amplitude; only the kernels need pairs, and they vanish with distance, so partials meet within a
band on a warped frequency scale on which the band has one width: an equality join on (note, cell),
no cross join, whatever the number of partials. ``REACH`` bounds what is left out: at most
6e-19 of a pair's smaller amplitude.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sonagrid.functions.scales import bark, erb_bandwidth, zwicker_bandwidth
from sonagrid.operators.ranges import band_pairs, near_pairs

#: Pairs further apart than this many y = 0.24 df / (0.0207 f + 18.96) aren't met: e^(-3.5 * 12) is 6e-19.
REACH = 12.0
#: The scale on which that reach is one width: z = log(0.0207 f + 18.96) / 0.0207.
_WIDTH = math.log(1 + 0.0207 * REACH / 0.24) / 0.0207


def _warped(f: Column) -> Column:
    return F.log(0.0207 * f + 18.96) / 0.0207


def _by_amplitude(partials: DataFrame) -> DataFrame:
    """Rows with their place in ascending amplitude, which also tells equal partials apart."""
    return partials.select("note", "freq_hz", "amp", F.row_number().over(Window.partitionBy("note").orderBy("amp", "freq_hz")).cast("long").alias("id"))


def partial_pairs(partials: DataFrame) -> DataFrame:
    """Pairs of a note's partials that are near enough to matter, each once: f1 <= f2, a1, a2."""
    rows = _by_amplitude(partials).withColumn("z", _warped(F.col("freq_hz")))
    met = band_pairs(rows, ["note"], "z", _WIDTH, ["z", "freq_hz", "amp", "id"])
    return met.select("note", F.col("freq_hz_lo").alias("f1"), F.col("freq_hz_hi").alias("f2"), F.col("amp_lo").alias("a1"), F.col("amp_hi").alias("a2"))


def sethares(f1: Column, f2: Column, a1: Column, a2: Column) -> Column:
    """min(a1, a2) (e^-3.5y - e^-5.75y), y = 0.24 (f2 - f1) / (0.0207 f1 + 18.96)."""
    y = 0.24 * (f2 - f1) / (0.0207 * f1 + 18.96)
    return F.least(a1, a2) * F.greatest(F.lit(0.0), F.exp(-3.5 * y) - F.exp(-5.75 * y))


def vassilakis(f1: Column, f2: Column, a1: Column, a2: Column) -> Column:
    """(a1 a2)^0.1 * 0.5 (2 min / (a1 + a2))^3.11 * the same curve of the interval."""
    s = 0.24 * (f2 - f1) / (0.0207 * f1 + 18.96)
    depth = 2 * F.least(a1, a2) / (a1 + a2)
    return F.when(a1 + a2 > 0, F.pow(a1 * a2, F.lit(0.1)) * 0.5 * F.pow(depth, F.lit(3.11)) * (F.exp(-3.5 * s) - F.exp(-5.75 * s))).otherwise(0.0)


def hutchinson_knopoff(f1: Column, f2: Column, a1: Column, a2: Column) -> Column:
    """a1 a2 g(y), y the interval in critical bandwidths 1.72 mean^0.65, g the standard curve; nothing beyond 1.2."""
    y = (f2 - f1) / (1.72 * F.pow((f1 + f2) / 2, F.lit(0.65)))
    g = F.pow(math.e * (y / 0.25) * F.exp(-y / 0.25), F.lit(2.0))
    return F.when((y > 0) & (y <= 1.2), a1 * a2 * g).otherwise(0.0)


def critical_bandwidth(mean: Column, zwicker_below_hz: float | None = None) -> Column:
    """1.72 mean^0.65 Hz; optionally Zwicker's bandwidth at low frequencies."""
    width = 1.72 * F.pow(mean, F.lit(0.65))
    return width if zwicker_below_hz is None else F.when(mean < zwicker_below_hz, zwicker_bandwidth(mean)).otherwise(width)


def table_lookup(y: Column, points: list[tuple[float, float]]) -> Column:
    """Linear interpolation in a short ascending table of (y, g), a literal of the query; 0 outside of it."""
    out = F.lit(0.0)
    for (y0, g0), (y1, g1) in zip(points, points[1:], strict=False):
        out = F.when((y > y0) & (y <= y1), g0 + (y - y0) * ((g1 - g0) / (y1 - y0))).otherwise(out)
    return F.when(y == points[0][0], points[0][1]).otherwise(out)


def dissonance(partials: DataFrame) -> DataFrame:
    """All models in one pass over the near pairs: sums, pair mean, and normalised by min amplitudes or energy.

    Notes of one partial have no pairs and no row.
    """
    n = F.count("*")
    rows = _by_amplitude(partials)
    # Of all pairs, the k-th smallest amplitude is the lesser one in n - k.
    closed = rows.groupBy("note").agg(
        (n * (n - 1) / 2).cast("long").alias("pairs"),
        (n * F.sum("amp") - F.sum(F.col("amp") * F.col("id"))).alias("least"),
        ((n - 1) * F.sum(F.col("amp") * F.col("amp"))).alias("energy"),
    )
    args = [F.col(c) for c in ("f1", "f2", "a1", "a2")]
    near = partial_pairs(partials).select("note", sethares(*args).alias("s"), vassilakis(*args).alias("v"), hutchinson_knopoff(*args).alias("h"))
    sums = near.groupBy("note").agg(*[F.sum(c).alias(c) for c in "svh"])
    out = closed.filter("pairs > 0").join(sums, "note", "left").fillna(0.0, list("svh"))
    return out.select(
        "note",
        "pairs",
        F.col("s").alias("sethares_sum"),
        (F.col("s") / F.col("pairs")).alias("sethares_mean_pair"),
        F.try_divide("s", "least").alias("sethares_minamp"),
        F.col("v").alias("vassilakis_sum"),
        F.try_divide("h", "energy").alias("hutchinson_knopoff"),
        (10 * F.col("h") / F.col("pairs")).alias("hutchinson_knopoff_mean_pair_scaled"),
    )


def compare_models(partials: DataFrame, models: tuple[str, ...] = ("sethares_sum", "vassilakis_sum", "hutchinson_knopoff")) -> DataFrame:
    """note, model, value and each value's share of the model's largest in the corpus."""
    long = dissonance(partials).unpivot(["note"], list(models), "model", "value").filter(F.col("value").isNotNull())
    top = long.groupBy("model").agg(F.max("value").alias("top"))  # one row a model
    return long.join(F.broadcast(top), "model").withColumn("normalised", F.try_divide("value", "top")).drop("top")


def roughness(partials: DataFrame, basis: str = "zwicker", ceiling_hz: float = 15500.0, reach: float = 20.0, share: float = 0.25) -> DataFrame:
    """Sum of a_i a_j x e^(1-x), x = (f_j - f_i) / (share * bandwidth(f_i)), over pairs with x <= reach.

    ``id`` tells a note's partials apart. Partials meet within a band on a scale (Bark, or ERB
    rate) on which the reach is nearly one width; :func:`reach_width` bounds it.
    """
    width = {"zwicker": zwicker_bandwidth, "erb": erb_bandwidth}[basis]
    rows = partials.filter(F.col("freq_hz").between(0.0, ceiling_hz)).withColumn("_z", _SCALES[basis][0](F.col("freq_hz")))
    pairs = band_pairs(rows, ["note"], "_z", reach_width(basis, ceiling_hz, reach * share), ["_z", "freq_hz", "amp", "id"])
    x = (F.col("freq_hz_hi") - F.col("freq_hz_lo")) / (share * width(F.col("freq_hz_lo")))
    value = F.when(x <= reach, F.col("amp_lo") * F.col("amp_hi") * x * F.exp(1 - x)).otherwise(0.0)
    return pairs.groupBy("note").agg(F.sum(value).alias("roughness"))


#: By basis: the warped scale as an expression and as a number, and the bandwidth as a number.
_SCALES = {
    "zwicker": (bark, lambda f: 13 * math.atan(0.00076 * f) + 3.5 * math.atan((f / 7500) ** 2), lambda f: 25 + 75 * (1 + 1.4 * (f / 1000) ** 2) ** 0.69),
    "erb": (lambda f: F.log(0.108 * f + 24.7) / 0.108, lambda f: math.log(0.108 * f + 24.7) / 0.108, lambda f: 0.108 * f + 24.7),
}


def reach_width(basis: str, ceiling_hz: float, bandwidths: float) -> float:
    """The largest distance on the warped scale of a partial and one so many bandwidths above it, up to a ceiling."""
    _, scale, width = _SCALES[basis]
    step = 2.0
    most = max(scale(min(f + bandwidths * width(f), ceiling_hz)) - scale(f) for f in (k * step for k in range(int(ceiling_hz / step) + 1)))
    return 1.01 * most


def cross_dissonance(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """Sethares dissonance between two sets of partials per key (freq_hz, amp in both); keys of ``first`` without near ones have 0."""
    a = first.select(*keys, F.col("freq_hz").alias("fa"), F.col("amp").alias("aa"), _warped(F.col("freq_hz")).alias("za"))
    b = second.select(*keys, F.col("freq_hz").alias("fb"), F.col("amp").alias("ab"), _warped(F.col("freq_hz")).alias("zb"))
    low = F.col("fa") <= F.col("fb")
    f1, f2 = F.least("fa", "fb"), F.greatest("fa", "fb")
    a1, a2 = F.when(low, F.col("aa")).otherwise(F.col("ab")), F.when(low, F.col("ab")).otherwise(F.col("aa"))
    met = near_pairs(a, b, keys, "za", "zb", _WIDTH).select(*keys, sethares(f1, f2, a1, a2).alias("s"))
    none = first.select(*keys, F.lit(0.0).alias("s"))
    return met.unionByName(none).groupBy(*keys).agg(F.sum("s").alias("dissonance"))


#: Notes of up to so many partials are arrays; of more, they are met by a join.
ARRAY = 1024
#: Cells of a block of notes that are summed together: its arrays stay in a core's cache.
_BLOCK = 1 << 15


def _curve_sums(freq: np.ndarray, amp: np.ndarray, ratio: np.ndarray) -> np.ndarray:
    """(notes, intervals) sums of (notes, partials) over all pairs of one partial and a shifted one; NaN amplitudes are missing."""

    def value(fa: np.ndarray, aa: np.ndarray, shifted: np.ndarray, ab: np.ndarray) -> np.ndarray:
        y = 0.24 * np.abs(shifted - fa) / (0.0207 * np.minimum(fa, shifted) + 18.96)
        return np.nan_to_num(np.fmin(aa, ab) * np.maximum(0.0, np.exp(-3.5 * y) - np.exp(-5.75 * y)))

    n = freq.shape[1]
    out = np.zeros((len(freq), len(ratio)))
    for j in range(n):
        shifted, ab = freq[:, j, None] * ratio, amp[:, j, None]
        if len(freq) > 1:
            for i in range(n):
                out += value(freq[:, i, None], amp[:, i, None], shifted, ab)
        else:
            out[0] += value(freq.T, amp.T, shifted, ab).sum(0)
    out[np.isnan(amp).all(1)] = np.nan
    return out


def _summed(lists: pa.ListArray, width: int, sums: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """(notes, width): ``sums`` over (notes, partials) of frequencies and amplitudes, small notes of one size together."""
    offsets = lists.offsets.to_numpy().astype(np.int64)
    start, size = offsets[:-1] - offsets[0], np.diff(offsets)
    freq, amp = (c.to_numpy(zero_copy_only=False) for c in lists.flatten().flatten())
    out = np.empty((len(size), width))
    for n in np.unique(size).tolist():
        alike = np.flatnonzero(size == n)
        step = max(1, _BLOCK // width) if n <= 16 else 1
        for i in range(0, len(alike), step):
            at = start[alike[i : i + step], None] + np.arange(n)
            out[alike[i : i + step]] = sums(freq[at], amp[at])
    return out


def curves(partials: DataFrame, low: float = 1.0, high: float = 2.0, steps: int = 100) -> DataFrame:
    """(note, dissonance): Sethares dissonance of a timbre against itself, one array over a grid of intervals.

    A note of up to ``ARRAY`` partials is summed over all its pairs where its partials lie, so that only
    partials are shuffled. Partials of larger notes meet by note within the band widened by the largest
    shift, many tasks a note, and the grid is laid over those pairs.
    """
    rows = partials.filter(F.col("note").isNotNull() & F.col("freq_hz").isNotNull() & ~F.isnan("freq_hz")).select("note", F.col("freq_hz").cast("double").alias("freq_hz"), F.col("amp").cast("double").alias("amp"))
    many = rows.groupBy("note").count().filter(F.col("count") > ARRAY).select("note")
    parts = int(partials.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    few = rows.repartition(parts, "note").join(many, "note", "left_anti").groupBy("note").agg(F.sort_array(F.collect_list(F.struct("freq_hz", "amp"))).alias("items"))
    ratio = low + np.arange(steps) * ((high - low) / (steps - 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = _summed(b.column(1), steps, lambda freq, amp: _curve_sums(freq, amp, ratio)).ravel()
            grid = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * steps, pa.int32()), pa.array(flat, mask=np.isnan(flat)))
            yield pa.RecordBatch.from_arrays([b.column(0), grid], names=["note", "dissonance"])

    kind = partials.schema["note"].dataType.simpleString()
    return few.mapInArrow(run, f"note {kind}, dissonance array<double>").unionByName(_met_curves(rows.join(many, "note", "left_semi"), low, high, steps))


def _met_curves(rows: DataFrame, low: float, high: float, steps: int) -> DataFrame:
    widest = max(abs(math.log(low)), abs(math.log(high))) / 0.0207
    a = rows.select("note", F.col("freq_hz").alias("fa"), F.col("amp").alias("aa"), _warped(F.col("freq_hz")).alias("za"))
    b = rows.select("note", F.col("freq_hz").alias("fb"), F.col("amp").alias("ab"), _warped(F.col("freq_hz")).alias("zb"))
    met = near_pairs(a, b, ["note"], "za", "zb", _WIDTH + widest).select("note", "fa", "aa", "fb", "ab", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("step"))
    shifted = F.col("fb") * (low + F.col("step") * ((high - low) / (steps - 1)))
    value = sethares(F.least(F.col("fa"), shifted), F.greatest(F.col("fa"), shifted), F.col("aa"), F.col("ab"))
    sums = met.groupBy("note", "step").agg(F.sum(value).alias("dissonance"))
    return sums.groupBy("note").agg(F.sort_array(F.collect_list(F.struct("step", "dissonance")))["dissonance"].alias("dissonance"))


def curve(partials: DataFrame, low: float = 1.0, high: float = 2.0, steps: int = 100) -> DataFrame:
    """:func:`curves`, one row an interval of the grid."""
    long = curves(partials, low, high, steps).select("note", F.posexplode("dissonance").alias("step", "dissonance"))
    return long.withColumn("interval", low + F.col("step") * ((high - low) / (steps - 1)))


def scale(curves: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """(note, step) of the strict local minima of arrays of dissonance; differences up to the tolerance are none."""
    d = lambda i: F.get("dissonance", i)
    inner = F.sequence(F.lit(1), F.size("dissonance") - 2)
    low = F.filter(inner, lambda i: (d(i) < d(i - 1) - tolerance) & (d(i) < d(i + 1) - tolerance))
    return curves.filter(F.size("dissonance") > 2).select("note", F.explode(low).alias("step"))


def same_timbre(partials: DataFrame, interval: float) -> DataFrame:
    """Dissonance of a timbre sounded with itself shifted by an interval: cross is between the two, full within both together, added is full less what each has alone.

    A note of up to ``ARRAY`` partials is summed over all its pairs where its partials lie, so that
    partials are shuffled once; those of larger notes, few notes beside the partials, meet by joins.
    """
    rows = partials.select("note", F.col("freq_hz").cast("double").alias("freq_hz"), F.col("amp").cast("double").alias("amp"))
    good = F.col("note").isNotNull() & F.col("freq_hz").isNotNull() & ~F.isnan("freq_hz")
    many = F.broadcast(rows.filter(good).groupBy("note").count().filter(F.col("count") > ARRAY).select("note"))
    items = F.sort_array(F.collect_list(F.when(good, F.struct("freq_hz", "amp")))).alias("items")
    few = rows.join(many, "note", "left_anti").groupBy("note").agg(items)

    def sums(freq: np.ndarray, amp: np.ndarray) -> np.ndarray:
        # At the interval 1 every pair of a note meets itself twice, and no partial counts against itself.
        own = np.ones(1)
        cross, low, high = (_curve_sums(*x) for x in ((freq, amp, np.array([interval])), (freq, amp, own), (freq * interval, amp, own)))
        return np.nan_to_num(np.hstack([cross, low / 2, high / 2]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, _summed(b.column(1), 3, sums).T.copy())], names=["note", "cross", "low", "high"])

    kind = partials.schema["note"].dataType.simpleString()
    out = few.mapInArrow(run, f"note {kind}, cross double, low double, high double").unionByName(_met_timbre(rows.join(many, "note", "left_semi"), interval))
    return out.select("note", "cross", (F.col("cross") + F.col("low") + F.col("high")).alias("full"), F.col("low").alias("intrinsic"), (F.col("cross") + F.col("high")).alias("added"))


def _met_timbre(own: DataFrame, interval: float) -> DataFrame:
    shifted = own.select("note", (F.col("freq_hz") * interval).alias("freq_hz"), "amp")
    cross = cross_dissonance(own, shifted, ["note"]).withColumnRenamed("dissonance", "cross")
    alone = [dissonance(x).select("note", F.col("sethares_sum").alias(n)) for x, n in ((own, "low"), (shifted, "high"))]
    return cross.join(alone[0], "note", "left").join(alone[1], "note", "left").fillna(0.0, ["low", "high"])


def local_minima(curves: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """Strict local minima of each note's curve; differences up to the tolerance are none."""
    order = Window.partitionBy("note").orderBy("step")
    rows = curves.withColumn("_l", F.lag("dissonance").over(order)).withColumn("_r", F.lead("dissonance").over(order))
    return rows.filter((F.col("dissonance") < F.col("_l") - tolerance) & (F.col("dissonance") < F.col("_r") - tolerance)).drop("_l", "_r")
