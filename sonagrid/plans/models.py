"""Queries of resampling, confirmation, comparison over groups, and regression."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonagrid.operators import confirmation, statistics, uncertainty
from sonagrid.plans.catalog import query
from sonagrid.plans.inputs import COMPONENTS, METRICS, SPECTRUM, components, metrics, spectrum, with_ctes
from sonagrid.plans.rounding import rounded, rounded_sql

_M = 2147483647
_DRAWS = (
    "parts AS (SELECT note, comp, amp, ln(1 + amp) AS s, dense_rank() OVER (PARTITION BY note ORDER BY comp) - 1 AS k, row_number() OVER (PARTITION BY note, comp ORDER BY amp) - 1 AS j, count(*) OVER (PARTITION BY note, comp) AS n, count(*) OVER (PARTITION BY note) AS all_ FROM components)",
    f"x0 AS (SELECT note, comp, n, b, (note % 1000003 * 7919 + b * 104729 + j * 1299709 + k * 15485863) % {_M} AS x FROM parts, (SELECT unnest(range(0, 800)) AS b) WHERE all_ > 2)",
    f"x1 AS (SELECT note, comp, b, ((((x * x + 12345) % {_M}) * ((x * x + 12345) % {_M}) + 6789) % {_M}) % n AS j FROM x0)",
    "d0 AS (SELECT x1.note, x1.b, x1.comp, sum(s) AS d, sum(s * s) AS ss, count(*) FILTER (WHERE s > 0) AS c, sum(amp * amp) AS e FROM x1 JOIN parts USING (note, comp, j) GROUP BY ALL)",
    "d1 AS (SELECT note, b, sum(e * d) / sum(e) AS density, sum(e * d * d * d / ss / c) / sum(e) AS strict, sum(e * d * sqrt(d * d / ss / c)) / sum(e) AS balanced FROM d0 GROUP BY note, b)",
    "d2 AS (SELECT note, " + ", ".join(f"quantile_cont({s}, {q}) AS {s}_{n}" for s in ("density", "strict", "balanced") for q, n in ((0.025, "low"), (0.975, "high"))) + " FROM d1 GROUP BY note)",
)
_LIMITS = "density_low density_high strict_low strict_high balanced_low balanced_high"


@query(rounded_sql(with_ctes(COMPONENTS, *_DRAWS) + "SELECT d2.* FROM d2", _LIMITS, digits=5))
def bootstrap_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentile limits of 800 draws, energy shares computed anew in each; notes of more than two components."""
    out = uncertainty.bootstrap_scores(components(spark, sf_dir)).filter("n > 2")
    return rounded(out.select("note", *_LIMITS.split()), 5)


@query()
def bootstrap_bca(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points, BCa limits, relative spread and bias of the same draws."""
    out = uncertainty.bootstrap_scores(components(spark, sf_dir))
    return rounded(out.select("note", "n", *[f"{s}{x}" for s in ("strict", "balanced") for x in ("", "_low_bca", "_high_bca", "_relative", "_bias")]), 5)


@query(
    rounded_sql(
        with_ctes(COMPONENTS, *_DRAWS, "p0 AS (SELECT note, comp, sum(ln(1 + amp)) AS d, sum(pow(ln(1 + amp), 2)) AS ss, count(*) FILTER (WHERE amp > 0) AS c, sum(amp * amp) AS e, count(*) AS m FROM components GROUP BY note, comp)", "p AS (SELECT note, sum(e * d * d * d / ss / c) / sum(e) AS strict, CAST(sum(m) AS BIGINT) AS n FROM p0 GROUP BY note)", "w AS (SELECT note, n, 100 * (strict_high - strict_low) / abs(strict) AS width_percent FROM p LEFT JOIN d2 USING (note))")
        + "SELECT note, n, width_percent, coalesce(width_percent > 25, false) AS wide, CASE WHEN note % 12 >= 8 THEN 'frames' WHEN n >= 3 THEN 'components' ELSE 'none' END AS basis, note % 12 AS frames FROM w",
        "width_percent",
        "note n wide basis frames",
        digits=3,
    )
)
def interval_basis(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = uncertainty.bootstrap_scores(components(spark, sf_dir)).withColumn("frames", F.col("note") % 12)
    return rounded(uncertainty.interval_basis(rows, "strict", "frames"), 3)


# Confirmation: a spectrum's bins are the candidates, every sixth bin is an accepted harmonic.

_CONFIRM = (
    "c AS (SELECT note, bin, freq_hz, amp, 170.0::DOUBLE + note % 300 AS f0_hz, CASE WHEN note % 2 = 0 THEN 0.0004::DOUBLE ELSE 0 END AS b, (bin % 10) / 10.0::DOUBLE AS persistence, amp * amp AS p, 20 * log10(greatest(amp, 1e-12)) AS db FROM spectrum)",
    "k0 AS (SELECT *, list_sort(list_concat(coalesce(list(p) OVER (PARTITION BY note ORDER BY bin ROWS BETWEEN 66 PRECEDING AND 3 PRECEDING), []), coalesce(list(p) OVER (PARTITION BY note ORDER BY bin ROWS BETWEEN 3 FOLLOWING AND 66 FOLLOWING), []))) AS cells, lag(db) OVER w AS l, lead(db) OVER w AS r, min(db) OVER (PARTITION BY note ORDER BY bin ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS lo, min(db) OVER (PARTITION BY note ORDER BY bin ROWS BETWEEN 1 FOLLOWING AND 6 FOLLOWING) AS hi FROM c WINDOW w AS (PARTITION BY note ORDER BY bin))",
    "k1 AS (SELECT *, cells[1:greatest(1, CAST(floor(len(cells) * 0.75) AS BIGINT))] AS kept FROM k0)",
    "k2 AS (SELECT *, p >= len(kept) * (pow(0.3, -1.0 / len(kept)) - 1) * list_sum(kept) / len(kept) AS detected, db > l AND db > r AND db - greatest(lo, hi) >= 3 AS local, greatest(1, round_even(sqrt(CASE WHEN b > 1e-12 THEN (sqrt(1 + 4 * b * freq_hz * freq_hz / (f0_hz * f0_hz)) - 1) / (2 * b) ELSE freq_hz * freq_hz / (f0_hz * f0_hz) END), 0)) AS o FROM k1)",
    "k3 AS (SELECT *, b > 1e-6 AND abs(freq_hz - o * f0_hz * sqrt(1 + b * o * o)) <= greatest(50.0, least(o * f0_hz * 30 / 1200, 0.3 * f0_hz)) AS comb, bin % 6 IN (0, 1, 5) AS leaked FROM k2)",
    "k4 AS (SELECT *, CASE WHEN NOT detected THEN 'floor' WHEN comb THEN 'stretched_comb_member' WHEN leaked THEN 'leakage' WHEN NOT coalesce(local, false) OR persistence < 0.5 THEN 'not_confirmed' ELSE 'confirmed' END AS status FROM k3)",
)


def _confirmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    bins = spectrum(spark, sf_dir)
    note, at = F.col("note"), F.col("bin")
    candidates = bins.select("note", "bin", "freq_hz", (170.0 + note % 300).alias("f0_hz"), F.when(note % 2 == 0, 0.0004).otherwise(0.0).alias("b"), ((at % 10) / 10.0).alias("persistence"))
    accepted = bins.filter(at % 6 == 0).select("note", F.col("freq_hz").alias("centre"))
    return confirmation.residual_confirmation(candidates, bins, accepted, 50.0, false_alarms=0.3)


@query(with_ctes(SPECTRUM, *_CONFIRM) + "SELECT note, bin, detected, comb, leaked, coalesce(local, false) AS local_peak, status FROM k4")
def residual_confirmation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _confirmed(spark, sf_dir).select("note", "bin", "detected", "comb", "leaked", F.col("local").alias("local_peak"), "status")


@query(rounded_sql(with_ctes(SPECTRUM, *_CONFIRM) + "SELECT note, 'H' AS comp, CAST(o AS BIGINT) AS n, freq_hz FROM k4 WHERE status = 'stretched_comb_member'", "freq_hz", "note comp n"))
def reassigned_harmonics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(confirmation.reassigned(_confirmed(spark, sf_dir)))


def _rematch_sql(rounds: int = 4) -> list[str]:
    out = ["peaks AS (SELECT note, 50.0::DOUBLE + note % 40 * 10.0::DOUBLE AS f0_hz, (50.0::DOUBLE + note % 40 * 10.0::DOUBLE) * n * sqrt(1 + 0.0005 * (note % 3) * n * n) * (1 + (persistence - 0.04) * 0.02) AS freq_hz FROM components)", "s0 AS (SELECT note, max(f0_hz) AS f0, 0.0::DOUBLE AS b FROM peaks GROUP BY note)"]
    for i in range(rounds):
        cap = "" if i == rounds - 1 else f" AND k <= {8 * 2**i}"
        out += [
            f"m{i} AS (SELECT p.note, f0_hz, freq_hz, f0, b, greatest(1, round_even(sqrt(CASE WHEN b > 1e-12 THEN (sqrt(1 + 4 * b * freq_hz * freq_hz / (f0 * f0)) - 1) / (2 * b) ELSE freq_hz * freq_hz / (f0 * f0) END), 0)) AS k FROM peaks p JOIN s{i} s ON s.note = p.note)",
            f"n{i} AS (SELECT note, f0_hz, CASE WHEN abs(1200 * log2(freq_hz / (k * f0 * sqrt(1 + b * k * k)))) <= 50{cap} THEN k * k END AS x, CASE WHEN abs(1200 * log2(freq_hz / (k * f0 * sqrt(1 + b * k * k)))) <= 50{cap} THEN pow(freq_hz / k, 2) END AS y FROM m{i})",
            f"q{i} AS (SELECT note, max(f0_hz) AS start, count(x)::DOUBLE AS n, count(DISTINCT x) AS orders, avg(x) AS mx, avg(y) AS my, var_pop(x) * count(x) AS sxx, var_pop(y) * count(x) AS syy, covar_pop(y, x) * count(x) AS sxy FROM n{i} GROUP BY note)",
            f"f{i} AS (SELECT *, CASE WHEN sxx > 0 THEN sxy / sxx END AS slope, CASE WHEN sxx > 0 THEN my - sxy / sxx * mx END AS intercept FROM q{i})",
            f"g{i} AS (SELECT *, coalesce(orders >= 3 AND intercept > 0 AND slope > 0 AND slope * sqrt(sxx) / sqrt(greatest(greatest(syy - slope * sxy, 0) / greatest(n - 2, 1), 1e-18)) >= 2, false) AS fitted FROM f{i})",
            f"s{i + 1} AS (SELECT note, CASE WHEN fitted THEN sqrt(intercept) ELSE start END AS f0, CASE WHEN fitted THEN slope / intercept ELSE 0 END AS b, orders, fitted FROM g{i})",
        ]
    return out


@query(rounded_sql(with_ctes(COMPONENTS, *_rematch_sql()) + "SELECT note, f0, b, orders, fitted FROM s4", "f0 b", "note orders fitted"))
def stretch_rematched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as partials of strings of three stiffnesses, slightly detuned."""
    f0 = 50.0 + F.col("note") % 40 * 10.0
    freq = f0 * F.col("n") * F.sqrt(1 + 0.0005 * (F.col("note") % 3) * F.col("n") * F.col("n")) * (1 + (F.col("persistence") - 0.04) * 0.02)
    return rounded(confirmation.rematched_stretch(components(spark, sf_dir).select("note", f0.alias("f0_hz"), freq.alias("freq_hz"))))


# Groups -------------------------------------------------------------------------------------------

_PAIRS = ", ".join(f"corr({a}, {b}) AS r_{a}_{b}" for a, b in (("m1", "m2"), ("m1", "m3"), ("m2", "m3")))
_CORR = "c AS (SELECT 'm1' AS a, 'm2' AS b, corr(m1, m2) AS r FROM metrics UNION ALL SELECT 'm1', 'm3', corr(m1, m3) FROM metrics UNION ALL SELECT 'm2', 'm3', corr(m2, m3) FROM metrics)"


@query(rounded_sql(with_ctes(METRICS, _CORR) + "SELECT a, b, r, CASE WHEN a = 'm1' AND b = 'm3' THEN 'declared' ELSE 'empirical' END AS kind FROM c WHERE abs(r) >= 0.9", "r", "a b kind"))
def high_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(statistics.high_correlations(statistics.correlations(metrics(spark, sf_dir), ["m1", "m2", "m3"]).select("a", "b", "r"), [("m3", "m1")]))


@query(rounded_sql(with_ctes(METRICS, _CORR, "p AS (SELECT CASE WHEN a = 'm1' THEN b ELSE a END AS predictor, r FROM c WHERE a = 'm1' OR b = 'm1')") + "SELECT predictor, r, CAST(row_number() OVER (ORDER BY abs(r) DESC, predictor) AS INTEGER) AS place FROM p ORDER BY place LIMIT 10", "r", "predictor place"))
def strongest_predictors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(statistics.strongest(statistics.correlations(metrics(spark, sf_dir), ["m1", "m2", "m3"]), "m1"))


@query(
    rounded_sql(
        with_ctes(METRICS, f"w AS (SELECT grp, {_PAIRS} FROM metrics WHERE grp IS NOT NULL GROUP BY grp)", "l AS (SELECT grp, 1 AS pair, r_m1_m2 AS r FROM w UNION ALL SELECT grp, 2, r_m1_m3 FROM w UNION ALL SELECT grp, 3, r_m2_m3 FROM w)")
        + "SELECT l.grp, avg(abs(l.r - b.r)) AS mean_gap, max(abs(l.r - b.r)) AS largest_gap, count(*) AS pairs FROM l JOIN l b ON b.pair = l.pair AND b.grp = 'F' WHERE l.grp <> 'F' GROUP BY l.grp",
        "mean_gap largest_gap",
        "grp pairs",
    )
)
def group_correlation_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(statistics.group_correlations(metrics(spark, sf_dir).filter("grp is not null"), "grp", ["m1", "m2", "m3"], "F"))


@query(
    rounded_sql(
        with_ctes(METRICS, "d AS (SELECT a.grp, 100 * (a.m1 - b.m1) / b.m1 AS p FROM metrics a JOIN metrics b ON b.note = a.note - 1 WHERE b.m1 <> 0 AND a.grp IS NOT NULL)")
        + "SELECT grp, avg(p) AS mean, stddev_pop(p) AS std, min(p) AS least, max(p) AS most, avg(abs(p)) AS mean_size, count(p) AS n FROM d GROUP BY grp",
        "mean std least most mean_size",
        "grp n",
    )
)
def baseline_deviations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Against the metrics of the note before as a baseline."""
    rows = metrics(spark, sf_dir)
    return rounded(statistics.deviations(rows.filter("grp is not null"), rows.select((F.col("note") + 1).alias("note"), "m1"), ["note"], "grp", "m1"))


@query(
    rounded_sql(
        with_ctes(METRICS, "g AS (SELECT grp, avg(m1) AS m1, avg(m2) AS m2, avg(m3) AS m3 FROM metrics WHERE grp IS NOT NULL GROUP BY grp)", "l AS (SELECT 'm1' AS metric, m1 AS m FROM g UNION ALL SELECT 'm2', m2 FROM g UNION ALL SELECT 'm3', m3 FROM g)", "s AS (SELECT metric, avg(m) AS mean, stddev_pop(m) AS std, count(m) AS groups FROM l GROUP BY metric HAVING count(m) > 1)")
        + "SELECT metric, mean, std, groups, std / mean AS cv, CASE WHEN std / mean < 0.1 THEN 'high' WHEN std / mean < 0.3 THEN 'medium' ELSE 'low' END AS consistency FROM s",
        "mean std cv",
        "metric groups consistency",
    )
)
def group_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(statistics.consistency(metrics(spark, sf_dir), "grp", ["m1", "m2", "m3"]))


@query(
    rounded_sql(
        with_ctes(
            METRICS,
            "f AS (SELECT grp, m1 AS y, coalesce(m2, 0) AS p, coalesce(m3, 0) AS q FROM metrics WHERE grp IS NOT NULL)",
            "s AS (SELECT grp, count(*) AS n, avg(y) AS intercept, stddev_pop(p) AS sp, stddev_pop(q) AS sq, var_pop(y) AS vy, covar_pop(p, y) / stddev_pop(p) AS cy, covar_pop(q, y) / stddev_pop(q) AS dy, covar_pop(p, q) / stddev_pop(p) / stddev_pop(q) AS r FROM f GROUP BY grp)",
            "b AS (SELECT *, (cy - r * dy) / (1 - r * r) AS b_m2, (dy - r * cy) / (1 - r * r) AS b_m3 FROM s)",
        )
        + "SELECT grp, intercept, b_m2, b_m3, 1 - (vy - b_m2 * cy - b_m3 * dy) / vy AS r2, sqrt(vy - b_m2 * cy - b_m3 * dy) AS rmse, n FROM b",
        "intercept b_m2 b_m3 r2 rmse",
        "grp n",
        digits=5,
    )
)
def group_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(statistics.multiple_regression(metrics(spark, sf_dir), "grp", "m1", ["m2", "m3"]), 5)


@query(
    rounded_sql(
        with_ctes(METRICS, "l AS (SELECT note, 'm1' AS metric, m1 AS v FROM metrics UNION ALL SELECT note, 'm2', m2 FROM metrics UNION ALL SELECT note, 'm4', m4 FROM metrics)", "s AS (SELECT metric, quantile_cont(v, 0.5) AS c, quantile_cont(v, 0.75) - quantile_cont(v, 0.25) AS w FROM l WHERE note % 2 = 0 GROUP BY metric)")
        + "SELECT note, metric, CASE WHEN w > 1e-12 THEN (v - c) / w ELSE 0 END AS z FROM l JOIN s USING (metric) WHERE v IS NOT NULL",
        "z",
        "note metric",
    )
)
def reference_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All notes on a scale fitted on the even ones."""
    rows, names = metrics(spark, sf_dir), ["m1", "m2", "m4"]
    return rounded(statistics.apply_scale(rows.select("note", *names), ["note"], names, statistics.fit_scale(rows.filter("note % 2 = 0").select(*names), names, robust=True)))


@query(
    rounded_sql(
        with_ctes(METRICS, "m AS (SELECT coalesce(grp, 'none') AS grp, m1, avg(m1) OVER (PARTITION BY coalesce(grp, 'none')) AS c FROM metrics)", "g AS (SELECT grp, count(*) AS n, avg(pow(m1 - c, 3)) / pow(avg(pow(m1 - c, 2)), 1.5) AS g1, avg(pow(m1 - c, 4)) / pow(avg(pow(m1 - c, 2)), 2) - 3 AS g2 FROM m GROUP BY grp)")
        + "SELECT grp, n, g1, g2, n * (g1 * g1 / 6 + g2 * g2 / 24) AS statistic, exp(-n * (g1 * g1 / 6 + g2 * g2 / 24) / 2) AS p FROM g",
        "g1 g2 statistic p",
        "grp n",
        digits=5,
    )
)
def normality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(statistics.omnibus_normality(metrics(spark, sf_dir).withColumn("grp", F.coalesce("grp", F.lit("none"))), ["grp"], "m1"), 5)


@query(rounded_sql(with_ctes(METRICS) + "SELECT coalesce(grp, 'none') AS grp, count(m1) AS n, count(*) FILTER (WHERE m1 NOT BETWEEN 20 AND 300) AS outside, count(*) FILTER (WHERE m1 NOT BETWEEN 20 AND 300) / count(m1)::DOUBLE AS share, count(*) FILTER (WHERE m1 NOT BETWEEN 20 AND 300) / count(m1)::DOUBLE <= 0.1 AS valid FROM metrics GROUP BY 1", "share", "grp n outside valid"))
def outlier_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(statistics.outlier_fraction(metrics(spark, sf_dir).withColumn("grp", F.coalesce("grp", F.lit("none"))), ["grp"], "m1", 20.0, 300.0, 0.1))
