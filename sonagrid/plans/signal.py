"""Queries of array transforms; SQL has no Fourier transform and no greedy folds, so these have none."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonagrid.operators import signal
from sonagrid.plans.catalog import query
from sonagrid.plans.inputs import components, table
from sonagrid.plans.rounding import rounded


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding")


def _spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = F.array_sort(F.collect_list(F.struct("freq_hz", "amp")))
    # Few bytes a note, much work: dealt over all shuffle partitions, which AQE would merge into few.
    dealt = components(spark, sf_dir).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "note")
    rows = dealt.groupBy("note").agg(order.alias("xs"), F.first("f0_hz").alias("f0"))
    return rows.select("note", F.col("xs.freq_hz").alias("freq"), F.col("xs.amp").alias("amp"), F.array("f0").alias("f0"))


@query()
def stft_power(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean power spectrum of each vector, 16-sample frames, hop 8."""
    return rounded(signal.map_arrays(_vectors(spark, sf_dir), "vec_id", ["embedding"], lambda x: enumerate(signal.power_spectrum(x, 16, 8).tolist()), "bin long, power double"))


@query()
def f0_autocorrelation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(signal.map_arrays(_vectors(spark, sf_dir), "vec_id", ["embedding"], lambda x: [(signal.autocorrelation_f0(x, 6400.0, 200.0, 3000.0),)], "f0 double"))


@query()
def envelope_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(signal.map_arrays(_vectors(spark, sf_dir), "vec_id", ["embedding"], lambda x: [signal.attack_sustain_release(x, 1000.0)], "attack double, sustain double, release double"))


@query("SELECT vec_id, greatest(max(i) + 1, 0) - greatest(min(i) - 1, 1) + CASE WHEN max(i) = 64 THEN 0 ELSE 1 END AS kept FROM (SELECT vec_id, unnest(range(1, 65)) AS i, embedding FROM embeddings) AS x WHERE abs(embedding[i]) > 0.2 GROUP BY vec_id")
def silence_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples kept of each vector with one sample of padding; vectors that are silent throughout are left out."""
    out = signal.map_arrays(_vectors(spark, sf_dir), "vec_id", ["embedding"], lambda x: [(len(signal.trim_silence(x, 0.2, 1)),)], "kept long")
    return out.filter("kept > 0")


@query()
def savgol_smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(signal.map_arrays(_vectors(spark, sf_dir), "vec_id", ["embedding"], lambda x: enumerate(signal.savitzky_golay(x).tolist()), "bin long, value double"))


@query()
def moving_centroid_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(signal.map_arrays(_spectra(spark, sf_dir), "note", ["freq", "amp"], lambda f, a: signal.moving_centroid_merge(f, a), "freq_hz double, amp double"))


@query()
def greedy_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signal.map_arrays(_spectra(spark, sf_dir), "note", ["freq", "f0"], lambda f, f0: signal.greedy_orders(f, float(f0[0]), 1e-5), "slot long, place long")


@query()
def spectral_masking(spark: SparkSession, sf_dir: str) -> DataFrame:
    fn = lambda f, a: [(float(x), float(y)) for x, y, s in zip(f, a, signal.mask_components(f, 20 * np.log10(np.maximum(a, 1e-12))), strict=True) if s]
    return rounded(signal.map_arrays(_spectra(spark, sf_dir), "note", ["freq", "amp"], fn, "freq_hz double, amp double"))
