"""Queries of normalisation, ranks, statistics, resampling and the adaptive fold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonagrid.operators import adaptive, normalise, statistics, uncertainty
from sonagrid.operators.relational import long_form
from sonagrid.plans.catalog import query
from sonagrid.plans.inputs import COMPONENTS, METRICS, components, metrics, table, with_ctes
from sonagrid.plans.rounding import rounded, rounded_sql

_M = ["m1", "m2", "m3", "m4"]
_CELLS = "c AS (" + " UNION ALL ".join(f"SELECT note, grp, '{m}' AS metric, {m} AS value FROM metrics WHERE {m} IS NOT NULL" for m in _M) + ")"


def _long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long_form(metrics(spark, sf_dir), ["note", "grp"], _M)


_DESCRIBE = "count(value) AS count, avg(value) AS mean, stddev_samp(value) AS std, min(value) AS min, quantile_cont(value, 0.25) AS q25, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q75, max(value) AS max"


@query(
    rounded_sql(
        with_ctes(METRICS, _CELLS, f"d AS (SELECT metric, 'ALL' AS scope, {_DESCRIBE} FROM c GROUP BY metric UNION ALL SELECT metric, coalesce(grp, '(none)'), {_DESCRIBE} FROM c GROUP BY metric, grp)") + "SELECT * FROM d",
        "mean std min q25 median q75 max",
        "metric scope count",
    )
)
def describe_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(statistics.describe(metrics(spark, sf_dir), _M, "grp"))


@query(
    rounded_sql(
        with_ctes(METRICS, _CELLS)
        + "SELECT metric, max(value) - min(value) AS range, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr, stddev_samp(value) / avg(value) AS cv, CASE WHEN stddev_pop(value) > 0 THEN skewness(value) END AS g1, CASE WHEN stddev_pop(value) > 0 THEN kurtosis(value) END AS g2 FROM c GROUP BY metric",
        "range iqr cv g1 g2",
        "metric",
    )
)
def shape_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(statistics.shape(_long(spark, sf_dir), ["metric"], "value"))


@query(
    rounded_sql(
        with_ctes(METRICS, _CELLS, "f AS (SELECT metric, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM c GROUP BY metric HAVING count(*) >= 4 AND quantile_cont(value, 0.75) > quantile_cont(value, 0.25))",
                  "o AS (SELECT metric, note, value, row_number() OVER (PARTITION BY metric ORDER BY greatest(q1 - 0.5 * (q3 - q1) - value, value - (q3 + 0.5 * (q3 - q1))) DESC, note) AS rank FROM c JOIN f USING (metric) WHERE value < q1 - 0.5 * (q3 - q1) OR value > q3 + 0.5 * (q3 - q1))")
        + "SELECT metric, note, value, CAST(rank AS INTEGER) AS rank FROM o WHERE rank <= 100",
        "value",
        "metric note rank",
    )
)
def iqr_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(normalise.outliers(_long(spark, sf_dir), ["metric"], "value", "note", 100, 0.5))


@query(
    rounded_sql(
        with_ctes(METRICS)
        + "SELECT note, (m1 - avg(m1) OVER ()) / stddev_pop(m1) OVER () AS z_m1, (m2 - avg(m2) OVER ()) / stddev_pop(m2) OVER () AS z_m2, (m3 - avg(m3) OVER ()) / stddev_pop(m3) OVER () AS z_m3, 0.5 * ((m1 - avg(m1) OVER ()) / stddev_pop(m1) OVER ()) + 0.3 * ((m2 - avg(m2) OVER ()) / stddev_pop(m2) OVER ()) + 0.2 * ((m3 - avg(m3) OVER ()) / stddev_pop(m3) OVER ()) AS idx FROM metrics",
        "z_m1 z_m2 z_m3 idx",
    )
)
def zscore_sbti(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = normalise.z_scores(metrics(spark, sf_dir), {"m1": 0.5, "m2": 0.3, "m3": 0.2})
    return rounded(out.select("note", "z_m1", "z_m2", "z_m3", F.col("index").alias("idx")))


@query(rounded_sql(with_ctes(METRICS) + "SELECT note, (m2 - min(m2) OVER ()) / (max(m2) OVER () - min(m2) OVER ()) AS scaled, least(1.0, m1 / max(m1) OVER ()) AS of_max FROM metrics", "scaled of_max"))
def minmax_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = normalise.min_max(metrics(spark, sf_dir), "m2").withColumnRenamed("scaled", "s2")
    return rounded(normalise.max_scaled(out, "m1").select("note", F.col("s2").alias("scaled"), F.col("scaled").alias("of_max")))


@query(
    rounded_sql(
        with_ctes(METRICS, "d AS (SELECT note, m3, quantile_cont(m3, 0.5) OVER () AS med FROM metrics)", "e AS (SELECT *, quantile_cont(abs(m3 - med), 0.5) OVER () AS mad FROM d)")
        + "SELECT note, 0.6745 * (m3 - med) / mad AS robust_z FROM e",
        "robust_z",
    )
)
def robust_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(normalise.robust_z(metrics(spark, sf_dir), "m3").select("note", "robust_z"))


@query(
    rounded_sql(
        with_ctes(METRICS, "q AS (SELECT quantile_cont(m1, 0.05) AS lo, quantile_cont(m1, 0.95) AS hi, ln(min(m1)) AS llo, ln(max(m1)) AS lhi FROM metrics)")
        + "SELECT note, greatest(0.0, least(1.0, (m1 - lo) / (hi - lo))) AS clipped, (ln(m1) - llo) / (lhi - llo) AS logged FROM metrics, q",
        "clipped logged",
    )
)
def percentile_log_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = normalise.clipped_range(metrics(spark, sf_dir), "m1").withColumnRenamed("scaled", "clipped")
    return rounded(normalise.log_range(out, "m1").select("note", "clipped", F.col("scaled").alias("logged")))


@query(
    rounded_sql(
        with_ctes(METRICS)
        + "\nSELECT a, b, r, n FROM ("
        + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {f'corr({a}, {b})' if 'm4' not in (a, b) else 'NULL'} AS r, count(*) FILTER (WHERE {a} IS NOT NULL AND {b} IS NOT NULL) AS n FROM metrics" for i, a in enumerate(_M) for b in _M[i + 1 :])
        + ") AS u",
        "r",
        "a b n",
    )
)
def corr_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(statistics.correlations(metrics(spark, sf_dir), _M))


_AVG_RANK = "rank() OVER (ORDER BY {0}) + (count(*) OVER (PARTITION BY {0}) - 1) / 2.0"


@query(rounded_sql(with_ctes(METRICS, "v AS (SELECT m1, m2 FROM metrics WHERE m1 IS NOT NULL AND m2 IS NOT NULL)", f"r AS (SELECT {_AVG_RANK.format('m1')} AS x, {_AVG_RANK.format('m2')} AS y FROM v)") + "SELECT corr(x, y) AS rho, count(*) AS n FROM r", "rho", "n"))
def spearman_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(statistics.spearman(metrics(spark, sf_dir), "m1", "m2"))


@query(
    rounded_sql(
        with_ctes(
            METRICS,
            f"r AS (SELECT grp, m2, {_AVG_RANK.format('m2')} AS k FROM metrics WHERE grp IS NOT NULL AND m2 IS NOT NULL)",
            "g AS (SELECT grp, sum(k) AS r, CAST(count(*) AS DOUBLE) AS n FROM r GROUP BY grp)",
            "t AS (SELECT sum(c * c * c - c) AS ties FROM (SELECT CAST(count(*) AS DOUBLE) AS c FROM r GROUP BY m2))",
            "h AS (SELECT sum(n) AS n, sum(r * r / n) AS s, count(*) AS k FROM g)",
            "o AS (SELECT (12 / (n * (n + 1)) * s - 3 * (n + 1)) / (1 - ties / (n * n * n - n)) AS h, k - 1 AS df, n FROM h, t)",
        )
        + "SELECT h, df, CAST(n AS BIGINT) AS n, h / ((n * n - 1) / (n + 1)) AS epsilon_squared FROM o",
        "h epsilon_squared",
        "df n",
    )
)
def kruskal_register(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(statistics.kruskal_wallis(metrics(spark, sf_dir), "grp", "m2"))


@query(
    rounded_sql(
        with_ctes(
            METRICS,
            f"r AS (SELECT grp, m2, {_AVG_RANK.format('m2')} AS k FROM metrics WHERE grp IN ('O', 'F') AND m2 IS NOT NULL)",
            "t AS (SELECT sum(c * c * c - c) AS ties FROM (SELECT CAST(count(*) AS DOUBLE) AS c FROM r GROUP BY m2))",
            "s AS (SELECT sum(k) FILTER (WHERE grp = 'O') AS r, CAST(count(*) FILTER (WHERE grp = 'O') AS DOUBLE) AS a, CAST(count(*) FILTER (WHERE grp = 'F') AS DOUBLE) AS b FROM r)",
        )
        + "SELECT r - a * (a + 1) / 2 AS u, (r - a * (a + 1) / 2 - a * b / 2) / sqrt(a * b / 12 * ((a + b + 1) - ties / ((a + b) * (a + b - 1)))) AS z, CAST(a AS BIGINT) AS n1, CAST(b AS BIGINT) AS n2 FROM s, t",
        "u z",
        "n1 n2",
    )
)
def mann_whitney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(statistics.mann_whitney(metrics(spark, sf_dir), "grp", "m2", "O", "F"))


@query(rounded_sql(with_ctes(METRICS) + "\nSELECT predictor, slope, intercept, r2, n FROM (SELECT 'm2' AS predictor, regr_slope(m1, m2) AS slope, regr_intercept(m1, m2) AS intercept, regr_r2(m1, m2) AS r2, CAST(regr_count(m1, m2) AS BIGINT) AS n FROM metrics UNION ALL SELECT 'm3', regr_slope(m1, m3), regr_intercept(m1, m3), regr_r2(m1, m3), CAST(regr_count(m1, m3) AS BIGINT) FROM metrics) AS u", "slope intercept r2", "predictor n"))
def ols_regr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(statistics.least_squares(metrics(spark, sf_dir), "m1", ["m2", "m3"]))


@query(
    rounded_sql(
        with_ctes(METRICS, "t AS (SELECT note, m1, row_number() OVER (ORDER BY m1 DESC, note) AS d, row_number() OVER (ORDER BY m1, note) AS u FROM metrics)")
        + "\nSELECT note, m1, rank, side FROM (SELECT note, m1, CAST(d AS INTEGER) AS rank, 'top' AS side FROM t WHERE d <= 5 UNION ALL SELECT note, m1, CAST(u AS INTEGER), 'bottom' FROM t WHERE u <= 5) AS x",
        "m1",
        "note rank side",
    )
)
def top_bottom_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(normalise.extremes(metrics(spark, sf_dir), "m1", "note").select("note", "m1", "rank", "side"))


_RESPONSES = "r AS (SELECT l_partkey AS a, l_suppkey AS b, CASE WHEN l_quantity > 40 THEN l_partkey WHEN l_quantity > 10 THEN l_suppkey END AS choice FROM lineitem)"


@query(with_ctes(_RESPONSES, "u AS (SELECT choice AS item, 1 AS w FROM r UNION ALL SELECT a, 0 FROM r UNION ALL SELECT b, 0 FROM r)") + "SELECT item, CAST(sum(w) AS BIGINT) AS wins FROM u WHERE item IS NOT NULL GROUP BY item")
def rank_win_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("l_quantity")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"), F.when(q > 40, F.col("l_partkey")).when(q > 10, F.col("l_suppkey")).alias("choice"))
    return statistics.win_counts(rows, "a", "b", "choice")


@query("WITH k AS (SELECT o_orderkey AS a, lead(o_orderkey) OVER (ORDER BY o_orderkey) AS b FROM orders) SELECT a, b, 'adjacent' AS kind FROM k WHERE b IS NOT NULL UNION ALL SELECT max(o_orderkey), min(o_orderkey), 'ends' FROM orders")
def adjacent_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.adjacent_pairs(table(spark, sf_dir, "orders"), "o_orderkey", F.floor(F.col("o_orderkey") / 1000))


@query(rounded_sql(with_ctes(METRICS) + "SELECT grp, avg(m1) AS mean, quantile_cont(m1, 0.5) AS median, count(m1) AS n, CAST(row_number() OVER (ORDER BY avg(m1) DESC, grp) AS INTEGER) AS place FROM metrics WHERE grp IS NOT NULL GROUP BY grp", "mean median", "grp n place"))
def group_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(statistics.group_means(metrics(spark, sf_dir), "grp", "m1"))


@query(rounded_sql(with_ctes(COMPONENTS) + "SELECT note, avg(amp) AS mean, stddev_samp(amp) AS std, max(amp) - min(amp) AS range, count(amp) AS n, stddev_samp(amp) / avg(amp) AS cv FROM components GROUP BY note", "mean std range cv", "note n"))
def resolution_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(statistics.spread_over(components(spark, sf_dir), ["note"], "amp"))


@query(
    rounded_sql(
        with_ctes(
            COMPONENTS,
            "s AS (SELECT note, sum(amp * amp) AS s, sum(pow(amp * amp, 2)) AS q, count(*) AS m FROM components GROUP BY note)",
            "x AS (SELECT c.note, m, pow(s - amp * amp, 2) / (q - pow(amp * amp, 2)) AS x FROM components c JOIN s ON c.note = s.note WHERE m > 1)",
        )
        + "SELECT note, avg(x) AS mean, sqrt((max(m) - 1) * var_pop(x)) AS std_error FROM x GROUP BY note",
        "mean std_error",
        digits=5,
    )
)
def jackknife_effective(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(uncertainty.jackknife_effective(components(spark, sf_dir)), 5)


@query()
def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(uncertainty.bootstrap_effective(components(spark, sf_dir)))


@query()
def pca_loadings(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores, _ = statistics.principal_components(metrics(spark, sf_dir), "note", ["m1", "m2", "m3"], 2)
    return rounded(scores.select("note", *[F.abs(F.get("scores", F.lit(i))).alias(f"pc{i + 1}") for i in range(2)]))


_OBS = """obs AS (SELECT l_suppkey AS k, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_partkey, l_linenumber, l_extendedprice) AS t,
  l_quantity / (l_quantity + l_linenumber + 10) AS o1, l_linenumber / (l_quantity + l_linenumber + 10) AS o2, 10 / (l_quantity + l_linenumber + 10) AS o3, l_tax * 50 AS evidence FROM lineitem)"""
_KL = " + ".join(f"0.5 * (CASE WHEN p{i} > 0 AND (p{i} + o{i}) > 0 THEN p{i} * ln(p{i} / ((p{i} + o{i}) / 2)) ELSE 0 END + CASE WHEN o{i} > 0 THEN o{i} * ln(o{i} / ((p{i} + o{i}) / 2)) ELSE 0 END)" for i in (1, 2, 3))


FOLDED = f"""WITH RECURSIVE {_OBS},
f AS (SELECT k, CAST(0 AS BIGINT) AS t, 8.0::DOUBLE / 3 AS a1, 8.0::DOUBLE / 3 AS a2, 8.0::DOUBLE / 3 AS a3 FROM (SELECT DISTINCT k FROM obs)
  UNION ALL
  SELECT k, t, 0.98 * a1 + g * o1, 0.98 * a2 + g * o2, 0.98 * a3 + g * o3 FROM (
    SELECT k, t, a1, a2, a3, o1, o2, o3, greatest(0.1, least(1.0, exp(-({_KL}) / 0.18))) * greatest(0.25, least(4.0, evidence)) AS g FROM (
      SELECT f.k, obs.t, a1, a2, a3, o1, o2, o3, evidence, a1 / (a1 + a2 + a3) AS p1, a2 / (a1 + a2 + a3) AS p2, a3 / (a1 + a2 + a3) AS p3 FROM f JOIN obs ON obs.k = f.k AND obs.t = f.t + 1))),
e AS (SELECT k, max(t) AS t FROM f GROUP BY k)
SELECT f.k, f.t AS observations, round(a1, 6) AS a1, round(a2, 6) AS a2, round(a3, 6) AS a3 FROM f JOIN e ON e.k = f.k AND e.t = f.t"""


@query(FOLDED)
def adaptive_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, n = F.col("l_quantity"), F.col("l_linenumber")
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("k"), "l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice",
        (q / (q + n + 10)).alias("o1"), (n / (q + n + 10)).alias("o2"), (10 / (q + n + 10)).alias("o3"), (F.col("l_tax") * 50).alias("evidence"),
    )
    return rounded(adaptive.fold(rows, "k", ["l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice"]))
