"""Queries of composed scores and of rank stability."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonagrid.operators import composites
from sonagrid.plans.catalog import query
from sonagrid.plans.density import PHI_SQL, _scores_sql
from sonagrid.plans.inputs import COMPONENTS, METRICS, SPECTRUM, components, metrics, spectrum, with_ctes
from sonagrid.plans.rounding import rounded, rounded_sql


@query(rounded_sql(with_ctes(COMPONENTS, "b AS (SELECT note, coalesce(sum(amp) FILTER (WHERE comp = 'H'), 0) AS h, coalesce(sum(amp) FILTER (WHERE comp = 'I'), 0) AS i FROM components GROUP BY note)") + "SELECT note, exp(0.7 * ln(1 + h) + 0.3 * ln(1 + i)) - 1 AS kept, 0.7 * h + 0.3 * i AS plain FROM b", "kept plain"))
def combined_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda c: F.coalesce(F.sum(F.when(F.col("comp") == c, F.col("amp"))), F.lit(0.0))
    b = components(spark, sf_dir).groupBy("note").agg(part("H").alias("h"), part("I").alias("i"))
    return rounded(b.select("note", composites.combined(F.col("h"), F.col("i")).alias("kept"), composites.combined(F.col("h"), F.col("i"), keep_range=False).alias("plain")))


@query(rounded_sql(with_ctes(COMPONENTS, "g AS (SELECT note, count(*) AS n, exp(avg(ln(amp))) AS g FROM components WHERE comp = 'H' AND amp > 0 GROUP BY note)") + "SELECT note, 0.8 * least(1.0, n / 100.0) + 0.2 * tanh(g) AS richness FROM g", "richness"))
def harmonic_richness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(composites.richness(components(spark, sf_dir)))


@query(rounded_sql(with_ctes(COMPONENTS, "l AS (SELECT note, amp, 20 * log10(greatest(amp, 1e-12)) > -12 AS loud FROM components WHERE comp = 'I')") + "SELECT note, greatest(0.0, least(1.0, 0.8 * count(*) FILTER (WHERE loud) / 50.0 + 0.2 * tanh(coalesce(avg(amp) FILTER (WHERE loud), 0)))) AS density FROM l GROUP BY note", "density"))
def inharmonic_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(composites.level_density(components(spark, sf_dir), "I", -12.0, 50.0))


@query(rounded_sql(with_ctes(COMPONENTS, "g AS (SELECT note, CAST(floor(5000 / max(f0_hz)) AS BIGINT) AS slots, count(DISTINCT CASE WHEN comp = 'H' THEN n END) AS found FROM components GROUP BY note)") + "SELECT note, slots, found, pow(least(1.0, found / slots), 0.5) AS fill FROM g", "fill", "note slots found"))
def capacity_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(composites.capacity(components(spark, sf_dir), 5000.0))


@query(
    rounded_sql(
        with_ctes(
            COMPONENTS,
            "o AS (SELECT DISTINCT note, n FROM components WHERE comp = 'H')",
            "s AS (SELECT note, unnest(range(1, top + 1)) AS n FROM (SELECT note, max(n) AS top FROM o GROUP BY note))",
            "m AS (SELECT s.note, s.n, o.n IS NOT NULL AS there FROM s LEFT JOIN o ON o.note = s.note AND o.n = s.n)",
            "r AS (SELECT *, sum(CASE WHEN there THEN 1 ELSE 0 END) OVER (PARTITION BY note ORDER BY n) AS part FROM m)",
            "g AS (SELECT note, part, count(*) FILTER (WHERE NOT there) AS gap, count(*) FILTER (WHERE there) AS there FROM r GROUP BY note, part)",
        )
        + "SELECT note, sum(there) / sum(gap + there) AS completeness, max(gap) AS longest_gap FROM g GROUP BY note",
        "completeness",
        "note longest_gap",
    )
)
def harmonic_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(composites.completeness(components(spark, sf_dir)))


@query(
    rounded_sql(
        with_ctes(SPECTRUM, "b AS (SELECT note, CAST(CASE WHEN freq_hz < 200 THEN 0 WHEN freq_hz < 1000 THEN 1 WHEN freq_hz < 5000 THEN 2 WHEN freq_hz < 20000 THEN 3 END AS INTEGER) AS band, 20 * log10(greatest(amp, 1e-12)) AS db FROM spectrum)")
        + "SELECT note, band, quantile_cont(db, 0.2) AS floor_db, count(*) AS bins FROM b WHERE band IS NOT NULL GROUP BY note, band",
        "floor_db",
        "note band bins",
    )
)
def band_noise_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(composites.band_floor(spectrum(spark, sf_dir)))


def _rho(table: str, a: str, b: str, la: str, lb: str) -> str:
    rank = "rank() OVER (ORDER BY {0}) + (count(*) OVER (PARTITION BY {0}) - 1) / 2.0"
    return f"SELECT {la} AS a, {lb} AS b, corr(x, y) AS rho, count(*) AS n FROM (SELECT {rank.format(a)} AS x, {rank.format(b)} AS y FROM {table})"


_ALPHA = "sc AS (SELECT note, " + ", ".join(f"round(sum(share * mass * pow(penalty, {a})), 9) AS s{i}" for i, a in enumerate((0.25, 0.5, 1.0))) + " FROM p_ GROUP BY note)"


@query(rounded_sql(with_ctes(f"p_ AS ({_scores_sql('log')})", _ALPHA) + "\nSELECT a, b, rho, n FROM (" + " UNION ALL ".join(_rho("sc", f"s{i}", f"s{j}", f"{x}::DOUBLE", f"{y}::DOUBLE") for (i, x), (j, y) in (((0, 0.25), (1, 0.5)), ((0, 0.25), (2, 1.0)), ((1, 0.5), (2, 1.0)))) + ") AS u", "a b rho", "n"))
def alpha_rank_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(composites.rank_stability(components(spark, sf_dir)))


_SUMS = "sc AS (SELECT note, " + ", ".join(f"round(sum({PHI_SQL[k].format('amp')}), 9) AS v_{k}" for k in ("linear", "sqrt", "log")) + " FROM components GROUP BY note)"


@query(rounded_sql(with_ctes(COMPONENTS, _SUMS) + "\nSELECT a, b, rho, n FROM (" + " UNION ALL ".join(_rho("sc", f"v_{a}", f"v_{b}", f"'{a}'", f"'{b}'") for a, b in (("linear", "sqrt"), ("linear", "log"), ("sqrt", "log"))) + ") AS u", "rho", "a b n"))
def phi_rank_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(composites.phi_stability(components(spark, sf_dir)))


@query(
    rounded_sql(
        with_ctes(
            METRICS,
            "q AS (SELECT quantile_cont(m1, 0.01) AS lo, quantile_cont(m1, 0.99) AS hi, count(*) AS total FROM metrics)",
            "b AS (SELECT note, floor((m1 - lo) / ((hi - lo) / 50)) AS bin, total FROM metrics, q)",
        )
        + "SELECT note, -log10(count(*) OVER (PARTITION BY bin) / total) AS isolation FROM b",
        "isolation",
    )
)
def isolation_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(composites.isolation(metrics(spark, sf_dir), "m1", "note"))
