"""Queries of gates, slot assignment, stops and fits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonagrid.functions import scales
from sonagrid.operators import classify
from sonagrid.plans.catalog import query
from sonagrid.plans.inputs import COMPONENTS, components, with_ctes
from sonagrid.plans.rounding import rounded, rounded_sql

_DB = "d AS (SELECT *, 20 * log10(greatest(amp, 1e-12)) AS db FROM components)"
_SLOT = """t AS (SELECT *, greatest(1.0::DOUBLE, round_even(peak_hz / f0_hz, 0)) AS slot FROM components),
v AS (SELECT *, abs(peak_hz - slot * f0_hz) AS deviation_hz, least(slot * f0_hz * 30 / 1200, 0.30 * f0_hz) AS inner_hz FROM t),
slots AS (SELECT *, greatest(5.0, inner_hz) AS tolerance_hz,
  CASE WHEN inner_hz < 5.0 THEN 'bin' WHEN 0.30 * f0_hz < slot * f0_hz * 30 / 1200 THEN 'spacing_cap' ELSE 'cents' END AS limb,
  deviation_hz <= greatest(5.0, inner_hz) AS within FROM v)"""


def _levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(spark, sf_dir).withColumn("db", scales.amplitude_to_db(F.col("amp")))


def _slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.harmonic_slots(components(spark, sf_dir))


@query(rounded_sql(with_ctes(COMPONENTS, _DB, "g AS (SELECT *, max(db) OVER (PARTITION BY note) AS top FROM d)") + "SELECT note, n, db FROM g WHERE db >= top - 20", "db", "note n"))
def relative_db_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(classify.relative_level_gate(_levels(spark, sf_dir)).select("note", "n", "db"))


@query(rounded_sql(with_ctes(COMPONENTS, "g AS (SELECT *, max(amp) OVER (PARTITION BY note) AS top FROM components)") + "SELECT note, n, amp FROM g WHERE amp >= 0.01 * top AND freq_hz <= 12000", "amp", "note n"))
def d24_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(classify.strength_gate(components(spark, sf_dir)).select("note", "n", "amp"))


@query(rounded_sql(with_ctes(COMPONENTS) + "SELECT note, n, freq_hz, amp FROM components WHERE amp > 0 AND freq_hz <= 3000 AND include", "freq_hz amp", "note n"))
def standard_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(classify.standard_components(components(spark, sf_dir), 3000.0, True).select("note", "n", "freq_hz", "amp"))


@query(
    with_ctes(COMPONENTS)
    + """SELECT note, CASE WHEN freq_hz < 20 THEN 'dc' WHEN freq_hz <= least(0.5 * f0_hz, 80) THEN 'low_band'
  WHEN freq_hz < f0_hz * (1 - CASE WHEN f0_hz < 60 THEN 35.0 WHEN f0_hz < 120 THEN 25.0 WHEN f0_hz < 300 THEN 15.0 ELSE 10.0 END / 100) THEN 'sub_fundamental' ELSE 'body' END AS region, count(*) AS n
FROM components GROUP BY ALL"""
)
def subbass_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = components(spark, sf_dir).withColumn("region", scales.low_frequency_class(F.col("freq_hz"), F.col("f0_hz")))
    return rows.groupBy("note", "region").agg(F.count("*").alias("n"))


@query(with_ctes(COMPONENTS) + "SELECT note, count(*) FILTER (WHERE CASE WHEN comp = 'H' THEN include ELSE status = 'confirmed' END) AS validated, count(*) AS components FROM components GROUP BY note")
def validated_partials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(spark, sf_dir).groupBy("note").agg(F.count_if(classify.validated()).alias("validated"), F.count("*").alias("components"))


@query(rounded_sql(with_ctes(COMPONENTS, _SLOT) + "SELECT note, n, part, bin, slot, deviation_hz, tolerance_hz, limb, within FROM slots", "slot deviation_hz tolerance_hz", "note n part bin limb within"))
def tolerance_limb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_slots(spark, sf_dir).select("note", "n", "part", "bin", "slot", "deviation_hz", "tolerance_hz", "limb", "within"))


@query(
    rounded_sql(
        with_ctes(
            COMPONENTS,
            _SLOT,
            "a AS (SELECT *, row_number() OVER (PARTITION BY note, bin ORDER BY deviation_hz, slot, amp DESC, part) AS b FROM slots WHERE within)",
            "c AS (SELECT *, row_number() OVER (PARTITION BY note, slot, b = 1 ORDER BY amp DESC, deviation_hz, part, bin) AS s FROM a)",
            "r AS (SELECT note, part, bin, slot, CASE WHEN b > 1 THEN 'peak_bin_taken' WHEN s > 1 THEN 'slot_taken' ELSE 'assigned' END AS assignment FROM c UNION ALL SELECT note, part, bin, slot, 'rejected_by_tolerance' FROM slots WHERE NOT within)",
        )
        + "SELECT note, part, bin, slot, assignment FROM r",
        "slot",
        "note part bin assignment",
    )
)
def exclusive_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(classify.exclusive_assignment(_slots(spark, sf_dir)).select("note", "part", "bin", "slot", "assignment"))


@query(
    rounded_sql(
        with_ctes(
            COMPONENTS,
            _SLOT,
            "e AS (SELECT note, slot, within, abs(1200 * log2(peak_hz / (slot * f0_hz))) AS err, amp * amp AS e FROM slots)",
            """g AS (SELECT note, count(DISTINCT slot) FILTER (WHERE within) AS orders, quantile_cont(err, 0.5) FILTER (WHERE within) AS median_cents, quantile_cont(err, 0.95) FILTER (WHERE within) AS p95_cents,
  sum(e * err) FILTER (WHERE within) / sum(e) FILTER (WHERE within) AS weighted_cents, coalesce(sum(e) FILTER (WHERE within), 0) / sum(e) AS energy_within FROM e GROUP BY note)""",
        )
        + "SELECT *, CASE WHEN orders = 0 THEN 'none' WHEN orders >= 3 AND energy_within >= 0.5 THEN 'good' WHEN energy_within >= 0.25 THEN 'fair' ELSE 'weak' END AS status FROM g",
        "median_cents p95_cents weighted_cents energy_within",
        "note orders status",
    )
)
def alignment_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(classify.alignment(_slots(spark, sf_dir)))


@query(
    rounded_sql(
        with_ctes(
            COMPONENTS,
            _SLOT,
            "b AS (SELECT note, slot, bool_or(within) AS within, max(persistence) AS persistence, min(deviation_hz / tolerance_hz) AS excess FROM slots GROUP BY note, slot)",
            "g AS (SELECT *, coalesce(lag(slot) OVER w = slot - 1 AND lag(within) OVER w AND lead(slot) OVER w = slot + 1 AND lead(within) OVER w, false) AS held FROM b WINDOW w AS (PARTITION BY note ORDER BY slot))",
            "r AS (SELECT *, NOT within AND held AND persistence >= 0.05 AND excess <= 2 AS restored FROM g)",
        )
        + "SELECT note, slot, within, restored, within OR restored AS accepted FROM r",
        "slot",
        "note within restored accepted",
    )
)
def continuity_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(classify.continuity_override(_slots(spark, sf_dir)))


@query(
    with_ctes(
        COMPONENTS,
        _DB,
        "l AS (SELECT note, n, max(db) AS db FROM d GROUP BY note, n)",
        "e AS (SELECT note, n, quantile_cont(db, 0.5) OVER (PARTITION BY note ORDER BY n ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS envelope, quantile_cont(db, 0.15) OVER (PARTITION BY note) AS floor FROM l)",
        "r AS (SELECT note, n, sum(CASE WHEN envelope <= floor + 3 THEN 1 ELSE 0 END) OVER (PARTITION BY note ORDER BY n ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS run, lag(n) OVER (PARTITION BY note ORDER BY n) AS first FROM e)",
    )
    + "SELECT note, min(first) FILTER (WHERE run = 2) AS stop_order, count(*) AS orders FROM r GROUP BY note"
)
def body_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.body_stop(_levels(spark, sf_dir))


@query(
    with_ctes(
        COMPONENTS,
        "b AS (SELECT note, n, bool_or(include) AS ok FROM components GROUP BY note, n)",
        "r AS (SELECT *, sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER w AS run, count(*) OVER w AS len FROM b WINDOW w AS (PARTITION BY note ORDER BY n ROWS BETWEEN 1 PRECEDING AND CURRENT ROW))",
        "s AS (SELECT *, min(CASE WHEN len = 2 AND run = 2 THEN n END) OVER (PARTITION BY note) AS stop FROM r)",
    )
    + "SELECT note, count(*) FILTER (WHERE ok) AS kept, max(stop) AS stop FROM s WHERE stop IS NULL OR n <= stop GROUP BY note"
)
def continuity_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.rejection_latch(components(spark, sf_dir))


@query(with_ctes(COMPONENTS) + "SELECT note, bin, count(*) AS claims FROM components WHERE include GROUP BY note, bin HAVING count(*) > 1")
def duplicate_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.duplicate_bins(components(spark, sf_dir))


@query(
    rounded_sql(
        with_ctes(COMPONENTS, _SLOT, "f AS (SELECT note, sum(amp * slot * peak_hz) / sum(amp * slot * slot) AS f0_refit, max(f0_hz) AS f0_hz FROM slots WHERE within AND slot <= 8 GROUP BY note)")
        + "SELECT note, f0_refit, f0_hz, 1200 * log2(f0_refit / f0_hz) AS discrepancy_cents, abs(1200 * log2(f0_refit / f0_hz)) > 15 AS applied FROM f",
        "f0_refit f0_hz discrepancy_cents",
        "note applied",
    )
)
def f0_refit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(classify.refit_fundamental(_slots(spark, sf_dir)))


@query(
    rounded_sql(
        with_ctes(COMPONENTS, _SLOT, "f AS (SELECT note, regr_slope(pow(peak_hz / slot, 2), slot * slot) AS s, regr_intercept(pow(peak_hz / slot, 2), slot * slot) AS i, count(DISTINCT slot * slot) AS orders FROM slots WHERE within GROUP BY note)")
        + "SELECT note, orders, CASE WHEN orders >= 3 AND i > 0 THEN sqrt(i) END AS f0_fit, CASE WHEN orders >= 3 AND i > 0 THEN s / i END AS b FROM f",
        "f0_fit b",
        "note orders",
    )
)
def stretch_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(classify.stretch_fit(_slots(spark, sf_dir)))


@query(
    with_ctes(COMPONENTS)
    + """SELECT note, n, part, bin,
  CASE WHEN NOT include THEN 'not_local_peak' WHEN freq_hz / 200 >= 12 AND amp * 10 >= 6 THEN 'strict_validated' WHEN freq_hz / 200 >= 12 THEN 'snr_validated' WHEN freq_hz / 200 >= 3 THEN 'weak' ELSE 'rejected_low_snr' END AS candidate,
  CASE WHEN amp * 10 - 2 <= 0 THEN 'rejected' WHEN amp * 10 - 2 >= 3 THEN 'validated' WHEN persistence >= 0.05 THEN 'validated_weak' ELSE 'marginal' END AS margin,
  CASE WHEN NOT include THEN 'floor' WHEN n = 1 THEN 'stretched_comb_member' WHEN n = 2 THEN 'leakage' WHEN status <> 'confirmed' OR persistence < 0.03 THEN 'not_confirmed' ELSE 'confirmed' END AS confirmation
FROM components"""
)
def candidate_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = components(spark, sf_dir)
    return rows.select(
        "note", "n", "part", "bin",
        classify.candidate_status(F.col("freq_hz") / 200, F.col("amp") * 10, F.col("include")).alias("candidate"),
        classify.margin_gate(F.col("amp") * 10 - 2, F.col("persistence"), strong=0.05).alias("margin"),
        classify.confirm_residual(F.col("include"), F.col("n") == 1, F.col("n") == 2, F.col("status") == "confirmed", F.col("persistence"), 0.03).alias("confirmation"),
    )
