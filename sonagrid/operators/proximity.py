"""Proximity density of a note: how rich, how close together and how low its components lie.

Richness is an effective number, closeness a Gaussian-weighted sum over all pairs. The pairs are
never made: components are gathered into cells half a kernel wide, each with the moments of its
masses about its centre, and cells meet cells of their note through the kernel's Taylor series in
Hermite polynomials. That is linear in the components, and exact to about 1e-10 of the sum.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.polynomial.hermite import hermval
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Band edges in Hz; components beyond the last count in the last band, others below the first in the first.
BANDS = (20.0, 200.0, 1000.0, 5000.0, 20000.0)
#: Terms of the series; cells are half a kernel wide, so offsets differ by at most half a kernel.
TERMS = 18
#: Cells farther apart than this many kernel widths contribute under exp(-40).
REACH = 9.0
#: Blocks that are summed together.
_ROWS = 1000


def band_of(freq: Column) -> Column:
    """0 for the lowest band."""
    out = F.lit(0)
    for i, low in enumerate(BANDS[1:-1], 1):
        out = F.when(freq >= low, i).otherwise(out)
    return out


def band_weight(freq: Column, band: Column) -> Column:
    """1 in the middle of a band, 0.5 at its edges and beyond."""
    low, high = F.array(*map(F.lit, BANDS[:-1]))[band], F.array(*map(F.lit, BANDS[1:]))[band]
    return 1.0 - 0.5 * F.least(F.abs(freq - (low + high) / 2) / ((high - low) / 2), F.lit(1.0))


def capped_masses(components: DataFrame, gamma: float = 2.0, hz_window: float = 4000.0, per_band: int = 4, hard: bool = False) -> DataFrame:
    """note, freq, mass of every component (amplitude ** gamma, normalised in steps), with a cap on each band.

    Only components within ``hz_window`` above the fundamental count, if there is a fundamental and
    any such component. Of each band the ``per_band`` with most mass times band weight keep their
    mass; the rest keep a tenth of it times the weight, or go if ``hard``. Ties go to the lower
    frequency. 0 or less: no cap.
    """
    given = components.select("note", F.col("freq_hz").cast("double").alias("freq"), F.col("amp").cast("double").alias("amp"), F.col("f0_hz").cast("double").alias("f0"))
    sound = given.filter((F.col("freq") > 0) & (F.col("amp") > 0) & (F.col("freq") < float("inf")) & (F.col("amp") < float("inf")))
    note = Window.partitionBy("note")
    inside = F.coalesce((F.col("f0") > 0) & F.col("freq").between(F.col("f0"), F.col("f0") + hz_window), F.lit(False))
    marked = sound.withColumn("inside", inside).withColumn("some", F.max("inside").over(note)).filter(F.col("inside") | ~F.col("some"))
    power = F.pow("amp", F.lit(gamma))
    rows = marked.withColumn("mass", power / F.sum(power).over(note)).withColumn("band", band_of(F.col("freq")))
    if per_band <= 0:
        return rows.select("note", "freq", "mass")
    weight = band_weight(F.col("freq"), F.col("band"))
    place = F.row_number().over(Window.partitionBy("note", "band").orderBy(F.desc(F.round(F.col("mass") * weight, 12)), "freq"))
    ranked = rows.withColumn("place", place)
    if hard:
        ranked = ranked.filter(F.col("place") <= per_band)
    held = F.col("mass") * F.when(F.col("place") <= per_band, 1.0).otherwise(0.1 * weight)
    return ranked.select("note", "freq", (held / F.sum(held).over(note)).alias("mass"))


def _field(near: int, step: float) -> np.ndarray:
    """What the moments of a block of ``near`` cells say of its own pairs, and of those with the next block, both orders.

    The entry for moment k of one cell and moment j of another is that of (offset - other offset) ** (k + j)
    by the binomial theorem, times the series' coefficient at the distance of their centres.
    """
    k = np.arange(TERMS)
    order = np.add.outer(k, k)
    kept = order < TERMS
    binomial = np.array([[math.comb(i + j, i) * (-1.0) ** j if i + j < TERMS else 0.0 for j in k] for i in k])
    apart = np.subtract.outer(np.arange(near), np.arange(2 * near))
    t = apart * step
    series = np.stack([(-1.0) ** n / math.factorial(n) * hermval(t, np.eye(TERMS)[n]) * np.exp(-t * t) for n in range(TERMS)], -1)
    series[np.abs(apart) > near] = 0.0
    series[:, near:] *= 2.0
    full = series[:, :, np.where(kept, order, 0)] * np.where(kept, binomial, 0.0)
    return full.transpose(0, 2, 1, 3).reshape(near * TERMS, 2 * near * TERMS)


def kernel_sums(masses: DataFrame, sigma: float) -> DataFrame:
    """(note, pair_sum): mass x mass x exp(-(distance / sigma) ** 2 / 2) over all ordered pairs of a note, own pairs left out.

    With t = distance / (sigma sqrt 2), exp(-(t + s)^2) = sum over n of (-s)^n / n! H_n(t) exp(-t^2),
    where t joins two cell centres and s the offsets within the cells, of which moments are known.
    A block is as many cells as the kernel reaches, so cells meet those of their block and the next
    one: a row a block, in the order of a note's blocks, and no cell is copied.
    """
    unit = sigma * math.sqrt(2)
    width = sigma / 2
    near = math.ceil(REACH * sigma / width)
    cell = F.floor(F.col("freq") / width)
    offset = (F.col("freq") - (cell + 0.5) * width) / unit
    powers = [F.sum(F.col("mass") * (F.pow("offset", F.lit(float(k))) if k else F.lit(1.0))) for k in range(TERMS)]
    cells = masses.withColumn("cell", cell).withColumn("offset", offset).groupBy("note", "cell").agg(F.array(*powers).alias("m"), F.sum(F.col("mass") * F.col("mass")).alias("own"))
    block = F.floor(F.col("cell") / near)
    placed = cells.select("note", block.alias("block"), F.struct((F.col("cell") - block * near).cast("int").alias("place"), "m").alias("cell"), "own")
    blocks = placed.groupBy("note", "block").agg(F.collect_list("cell").alias("cells"), F.sum("own").alias("own"))
    along = Window.partitionBy("note").orderBy("block")
    met = blocks.select("note", "own", "cells", F.when(F.lead("block").over(along) == F.col("block") + 1, F.lead("cells").over(along)).alias("next"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = _field(near, width / unit)
        for whole in batches:
            for at in range(0, whole.num_rows, _ROWS):
                b = whole.slice(at, _ROWS)
                moments = np.zeros((b.num_rows, 2 * near, TERMS))
                for side in (0, 1):
                    lists = b.column(2 + side)
                    place, m = lists.flatten().flatten()
                    row = np.repeat(np.arange(b.num_rows), lists.value_lengths().fill_null(0).to_numpy())
                    moments[row, place.to_numpy() + side * near] = m.flatten().to_numpy().reshape(-1, TERMS)
                flat = moments.reshape(b.num_rows, -1)
                found = np.einsum("ij,ij->i", flat[:, : near * TERMS] @ field, flat) - b.column(1).to_numpy()
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found)], names=["note", "pair_sum"])

    kind = masses.schema["note"].dataType.simpleString()
    return met.mapInArrow(run, f"note {kind}, pair_sum double").groupBy("note").agg(F.sum("pair_sum").alias("pair_sum"))


def proximity_density(components: DataFrame, sigma: float = 500.0, gamma: float = 2.0, hz_window: float = 4000.0, per_band: int = 4, hard: bool = False, weights: tuple[float, float] = (0.45, 0.55), low_share: float = 0.35, low_hz: float = 1000.0, q: float = 1.0) -> DataFrame:
    """Per note: n, richness, proximity, low, density and weighted_density; notes without a sounding component are left out.

    richness = (effective number of order q - 1) / (n - 1); proximity = pair sum / (1 - sum of
    squared masses), at most 1; low = mass below ``low_hz``, fading over the last tenth below it.
    density = weights over richness and proximity; weighted_density mixes in ``low`` by ``low_share``.
    Both are 0 for single components.
    """
    masses = capped_masses(components, gamma, hz_window, per_band, hard)
    p = F.col("mass")
    fade = F.least(F.greatest((low_hz - F.col("freq")) / (0.1 * low_hz), F.lit(0.0)), F.lit(1.0))
    effective = F.exp(-F.sum(p * F.log(F.greatest(p, F.lit(1e-12))))) if abs(q - 1) < 1e-12 else F.pow(F.sum(F.pow(p, F.lit(q))), F.lit(1 / (1 - q)))
    sums = masses.groupBy("note").agg(F.count("*").alias("n"), effective.alias("effective"), F.sum(p * p).alias("squares"), F.sum(p * fade).alias("low"))
    met = sums.join(kernel_sums(masses, sigma), "note")
    several = F.col("n") > 1
    richness = F.when(several, F.greatest((F.col("effective") - 1) / (F.col("n") - 1), F.lit(0.0))).otherwise(0.0)
    rest = 1 - F.col("squares")
    proximity = F.when(several & (rest > 1e-12), F.least(F.greatest(F.col("pair_sum"), F.lit(0.0)) / rest, F.lit(1.0))).otherwise(0.0)
    out = met.select("note", "n", richness.alias("richness"), proximity.alias("proximity"), "low")
    density = weights[0] * F.col("richness") + weights[1] * F.col("proximity")
    return out.withColumn("density", density).withColumn("weighted_density", (1 - low_share) * F.col("density") + low_share * F.col("low"))
