"""Queries of the forest of random splits, cross-validated regression, proximity density, fundamentals and peaks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonagrid.operators import crossval, forest, fundamental, normality, partials, proximity
from sonagrid.plans.catalog import query
from sonagrid.plans.inputs import COMPONENTS, METRICS, SPECTRUM, TASK_ROWS, components, metrics, spectrum, table, with_ctes
from sonagrid.plans.rounding import rounded, rounded_sql

_TREES, _SAMPLE, _LEVELS = 100, 256, 8


def _mixed(x: str) -> str:
    once = f"((({x}) * ({x}) + 12345) % {forest.PRIME})"
    return f"(({once} * {once} + 6789) % {forest.PRIME})"


def _choice(turn: int) -> str:
    return _mixed(f"(tree * 104729 + node * 1299709 + {turn * 15485863 + 7919}) % {forest.PRIME}")


def _forest_sql() -> list[str]:
    """The trees of the same hash rule, level by level, and every row's way down each."""
    xs = ("x0", "x1", "x2")
    depth = f"CASE WHEN size <= 1 THEN 0 WHEN size = 2 THEN 1 ELSE 2 * (ln(size - 1) + {forest.EULER_GAMMA}) - 2 * (size - 1) / size::DOUBLE END"
    out = [
        "w AS MATERIALIZED (SELECT note, m1 AS x0, m2 AS x1, m3 AS x2 FROM metrics WHERE m1 IS NOT NULL AND m2 IS NOT NULL AND m3 IS NOT NULL)",
        f"t AS MATERIALIZED (SELECT note, x0, x1, x2, CAST(tree AS BIGINT) AS tree FROM w, (SELECT unnest(range({_TREES})) AS tree))",
        f"a0 AS MATERIALIZED (SELECT * EXCLUDE (nth) FROM (SELECT *, CAST(0 AS BIGINT) AS node, row_number() OVER (PARTITION BY tree ORDER BY {_mixed(f'(note % 1000003 * 7919 + tree * 104729) % {forest.PRIME}')}, note) AS nth FROM t) WHERE nth <= {_SAMPLE})",
        "r0 AS MATERIALIZED (SELECT *, CAST(0 AS BIGINT) AS node FROM t)",
    ]
    for d in range(_LEVELS + 1):
        lows = ", ".join(f"min({x}) AS low_{x}, max({x}) AS high_{x}" for x in xs)
        varies = ", ".join(f"CASE WHEN high_{x} > low_{x} THEN {i} END" for i, x in enumerate(xs))
        ends = {e: "CASE j " + " ".join(f"WHEN {i} THEN {e}_{x}" for i, x in enumerate(xs)) + " END" for e in ("low", "high")}
        own = "CASE j " + " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(xs)) + " END"
        split = f"CASE WHEN size >= 2 AND len(vs) > 0 THEN vs[{_choice(0)} % len(vs) + 1] END" if d < _LEVELS else "NULL::INTEGER"
        out += [
            f"k{d} AS (SELECT *, list_filter([{varies}], lambda v: v IS NOT NULL) AS vs FROM (SELECT tree, node, count(*) AS size, {lows} FROM a{d} GROUP BY tree, node))",
            f"n{d} AS MATERIALIZED (SELECT *, {ends['low']} + ({_choice(1)} + 0.5::DOUBLE) / {forest.PRIME} * ({ends['high']} - {ends['low']}) AS cut FROM (SELECT tree, node, size, {', '.join(f'low_{x}, high_{x}' for x in xs)}, {split} AS j FROM k{d}))",
            f"l{d} AS (SELECT note, {d} + {depth} AS path FROM r{d} JOIN n{d} USING (tree, node) WHERE j IS NULL)",
        ]
        if d < _LEVELS:
            step = f"note, x0, x1, x2, tree, 2 * node + 1 + CAST({own} >= cut AS BIGINT) AS node"
            out += [f"{s}{d + 1} AS MATERIALIZED (SELECT {step} FROM {s}{d} JOIN n{d} USING (tree, node) WHERE j IS NOT NULL)" for s in ("a", "r")]
    normal = float(forest.expected_depth(_SAMPLE))
    paths = " UNION ALL ".join(f"SELECT * FROM l{d}" for d in range(_LEVELS + 1))
    out += [
        f"s AS (SELECT note, pow(2, -sum(path) / {_TREES} / {normal!r}) AS score FROM ({paths}) GROUP BY note)",
        f"c AS (SELECT *, CAST(round(score * {forest.GRID}) AS INTEGER) AS cell FROM s)",
        "o AS (SELECT note, score, count(*) OVER (ORDER BY cell DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - count(*) OVER (PARTITION BY cell) < 0.1 * count(*) OVER () AS outlier FROM c)",
    ]
    return out


@query(rounded_sql(with_ctes(METRICS, *_forest_sql()) + "SELECT note, score, outlier FROM o", "score", "note outlier"))
def isolation_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hundred trees on three metrics; the tenth that is isolated first."""
    return rounded(forest.outliers(metrics(spark, sf_dir), "note", ["m1", "m2", "m3"], _TREES, _SAMPLE))


# Regression ---------------------------------------------------------------------------------------

_ERR = "y - a - b * p - c * q"


def _two(name: str, rows: str, keys: str) -> list[str]:
    """Least squares on two predictors by Cramer's rule, rows and groups given."""
    return [
        f"{name}_m AS (SELECT {keys}, avg(y) AS my, avg(p) AS mp, avg(q) AS mq, var_pop(p) AS vp, var_pop(q) AS vq, covar_pop(p, q) AS pq, covar_pop(p, y) AS py, covar_pop(q, y) AS qy FROM {rows} GROUP BY {keys})",
        f"{name}_b AS (SELECT *, (py * vq - qy * pq) / (vp * vq - pq * pq) AS b, (qy * vp - py * pq) / (vp * vq - pq * pq) AS c FROM {name}_m)",
        f"{name} AS (SELECT *, my - b * mp - c * mq AS a FROM {name}_b)",
    ]


_CROSS = (
    "f AS (SELECT grp, note % 5 AS fold, m1 AS y, m2 AS x0, m3 AS x1, CAST(note % 97 AS DOUBLE) AS x2 FROM metrics WHERE grp IS NOT NULL)",
    "r AS (SELECT grp, unnest([0, 1, 2]) AS i, unnest([abs(corr(x0, y)), abs(corr(x1, y)), abs(corr(x2, y))]) AS r FROM f GROUP BY grp)",
    "k AS (SELECT grp, list(i ORDER BY r DESC, i)[1:2] AS chosen FROM r GROUP BY grp)",
    "v AS (SELECT grp, fold, y, chosen, [coalesce(x0, 0), coalesce(x1, 0), x2][chosen[1] + 1] AS p, [coalesce(x0, 0), coalesce(x1, 0), x2][chosen[2] + 1] AS q FROM f JOIN k USING (grp))",
    *_two("whole", "v", "grp"),
    "apart AS (SELECT v.*, g.fold AS test FROM v JOIN (SELECT DISTINCT grp, fold FROM v) g ON g.grp = v.grp AND g.fold <> v.fold)",
    *_two("trained", "apart", "grp, test"),
    f"folds AS (SELECT v.grp, v.fold, 1 - sum(pow({_ERR}, 2)) / (var_pop(y) * count(*)) AS fold_r2 FROM v JOIN trained t ON t.grp = v.grp AND t.test = v.fold GROUP BY v.grp, v.fold)",
    f"fit AS (SELECT v.grp, count(*) AS n, any_value(list_transform(chosen, lambda i: ['m2', 'm3', 'm5'][i + 1])) AS names, any_value(a) AS intercept, 1 - sum(pow({_ERR}, 2)) / (var_pop(y) * count(*)) AS r2, sqrt(avg(pow({_ERR}, 2))) AS rmse, avg(abs({_ERR})) AS mae FROM v JOIN whole w ON w.grp = v.grp GROUP BY v.grp)",
    "cv AS (SELECT grp, avg(fold_r2) AS cv_r2_mean, stddev_pop(fold_r2) AS cv_r2_std FROM folds GROUP BY grp)",
)


def _regressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = metrics(spark, sf_dir).withColumn("m5", (F.col("note") % 97).cast("double"))
    return crossval.cross_validated(rows, "grp", "m1", ["m2", "m3", "m5"], F.col("note") % 5, most=2)


@query(rounded_sql(with_ctes(METRICS, *_CROSS) + "SELECT grp, n, array_to_string(names, ',') AS predictors, intercept, r2, rmse, mae, cv_r2_mean, cv_r2_std FROM fit JOIN cv USING (grp)", "intercept r2 rmse mae cv_r2_mean cv_r2_std", "grp n predictors"))
def cross_validated_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_regressed(spark, sf_dir).drop("beta", "fold_r2"))


@query(rounded_sql(with_ctes(METRICS, *_CROSS) + "SELECT grp, CAST(fold AS INTEGER) AS fold, fold_r2 FROM folds", "fold_r2", "grp fold"))
def cross_validated_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_regressed(spark, sf_dir).select("grp", F.posexplode("fold_r2").alias("fold", "fold_r2")))


# Proximity ----------------------------------------------------------------------------------------


def _mass_sql(hard: bool) -> list[str]:
    edges = ((20, 200), (200, 1000), (1000, 5000), (5000, 20000))
    band = "CASE WHEN freq_hz >= 5000 THEN 3 WHEN freq_hz >= 1000 THEN 2 WHEN freq_hz >= 200 THEN 1 ELSE 0 END"
    lows, highs = ([float(e[i]) for e in edges] for i in (0, 1))
    keep = "WHERE place <= 4" if hard else ""
    return [
        "c AS (SELECT note, freq_hz, amp, 170.0::DOUBLE + note % 300 AS f0 FROM spectrum WHERE freq_hz > 0 AND amp > 0)",
        "i AS (SELECT *, freq_hz BETWEEN f0 AND f0 + 4000 AS inside FROM c)",
        f"m AS (SELECT note, freq_hz AS freq, amp * amp / sum(amp * amp) OVER (PARTITION BY note) AS mass, {band} AS band FROM (SELECT *, bool_or(inside) OVER (PARTITION BY note) AS any_inside FROM i) WHERE inside OR NOT any_inside)",
        f"e AS (SELECT *, 1 - 0.5 * least(abs(freq - ({lows}[band + 1] + {highs}[band + 1]) / 2) / (({highs}[band + 1] - {lows}[band + 1]) / 2), 1) AS weight FROM m)",
        "k AS (SELECT *, row_number() OVER (PARTITION BY note, band ORDER BY round(mass * weight, 12) DESC, freq) AS place FROM e)",
        f"h AS (SELECT note, freq, mass * CASE WHEN place <= 4 THEN 1 ELSE 0.1 * weight END AS held FROM k {keep})",
        "p AS (SELECT note, freq, held / sum(held) OVER (PARTITION BY note) AS mass FROM h)",
    ]


def _with_f0(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spectrum(spark, sf_dir).select("note", "freq_hz", "amp", (170.0 + F.col("note") % 300).alias("f0_hz"))


@query(
    rounded_sql(
        with_ctes(
            SPECTRUM,
            *_mass_sql(False),
            "s AS (SELECT note, count(*) AS n, exp(-sum(mass * ln(greatest(mass, 1e-12)))) AS effective, sum(mass * mass) AS squares, sum(mass * least(greatest((1000 - freq) / 100, 0), 1)) AS low FROM p GROUP BY note)",
            "g AS (SELECT a.note, sum(a.mass * b.mass * exp(-pow(a.freq - b.freq, 2) / (2 * 500.0::DOUBLE * 500.0::DOUBLE))) AS pair_sum FROM p a JOIN p b ON b.note = a.note AND b.freq <> a.freq GROUP BY a.note)",
            "o AS (SELECT s.note, n, low, CASE WHEN n > 1 THEN greatest((effective - 1) / (n - 1), 0) ELSE 0 END AS richness, CASE WHEN n > 1 AND 1 - squares > 1e-12 THEN least(coalesce(pair_sum, 0) / (1 - squares), 1) ELSE 0 END AS proximity FROM s LEFT JOIN g USING (note))",
            "d AS (SELECT *, 0.45 * richness + 0.55 * proximity AS density FROM o)",
        )
        + "SELECT note, n, richness, proximity, low, density, 0.65 * density + 0.35 * low AS weighted_density FROM d",
        "richness proximity low density weighted_density",
        "note n",
    )
)
def proximity_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(proximity.proximity_density(_with_f0(spark, sf_dir)))


@query(rounded_sql(with_ctes(SPECTRUM, *_mass_sql(True)) + "SELECT note, freq, mass FROM p", "freq mass", "note"))
def band_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four components of most weighted mass in each band."""
    return rounded(proximity.capped_masses(_with_f0(spark, sf_dir), hard=True))


# Fundamentals -------------------------------------------------------------------------------------


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every note's amplitudes by order; line items are dealt by note once, over tasks that grow in number."""
    amps = [F.coalesce(F.sum(F.when(F.col("n") == n, F.col("amp"))), F.lit(0.0)) for n in range(1, 8)]
    # Few bytes a note, much work: over all shuffle partitions at least, which AQE would merge into one.
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-table(spark, sf_dir, "lineitem").count() // TASK_ROWS))
    return components(spark, sf_dir).repartition(tasks, "note").groupBy("note").agg(F.max("f0_hz").alias("f0_hz"), F.array(*amps).alias("amps"))


@query()
def fundamental_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of a second of every note's partials at 8 kHz heard, its candidates corrected against the note's nominal fundamental; a Fourier transform has no SQL."""
    found = fundamental.tone_candidates(_orders(spark, sf_dir), "note", "f0_hz", "amps", 2000, 8000.0, 40.0, 2000.0, None)
    nominal = components(spark, sf_dir).groupBy("note").agg(F.max("f0_hz").alias("prior"))
    return rounded(fundamental.chosen(nominal.join(found, "note", "left"), "note", "prior"))


_TRIED = (
    "c AS (SELECT note, CAST(n AS INTEGER) AS place, peak_hz AS raw, f0_hz AS prior FROM components)",
    "t AS (SELECT *, unnest([1.0::DOUBLE, 2, 3, 4, 5, 6, 1.0::DOUBLE / 2, 1.0::DOUBLE / 3, 1.0::DOUBLE / 4, 1.0::DOUBLE / 5, 1.0::DOUBLE / 6]) AS ratio FROM c)",
    "b AS (SELECT note, max(prior) AS prior, min(abs(1200 * log2(raw / prior))) AS error_before, min(struct_pack(off_ := round(abs(1200 * log2(raw * ratio / prior)), 6), far := round(abs(log2(ratio)), 6), ratio := ratio, place := place, raw := raw)) AS best FROM t GROUP BY note)",
)


@query(
    rounded_sql(
        with_ctes(COMPONENTS, *_TRIED)
        + "SELECT note, CASE WHEN best.off_ <= 50 THEN best.raw * best.ratio ELSE prior END AS f0_hz, CASE WHEN best.off_ <= 50 THEN best.raw END AS raw_hz, CASE WHEN best.off_ <= 50 THEN best.ratio END AS ratio, error_before, CASE WHEN best.off_ <= 50 THEN best.off_ END AS error_after, CASE WHEN best.off_ > 50 THEN 'prior' WHEN best.ratio = 1 THEN 'direct' ELSE 'corrected' END AS status FROM b",
        "f0_hz raw_hz ratio error_before error_after",
        "note status",
    )
)
def fundamental_by_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partials as candidates: the one nearest to the nominal fundamental after division by its order."""
    rows = components(spark, sf_dir).select("note", F.col("n").cast("int").alias("place"), F.col("peak_hz").alias("candidate_hz"), F.col("f0_hz").alias("prior"))
    return rounded(fundamental.chosen(rows, "note", "prior"))


# Peaks --------------------------------------------------------------------------------------------

_R = 2 ** (60 / 1200) - 1
_PEAKS = (
    "y AS (SELECT note, bin, freq_hz, amp, log10(greatest(amp, 1e-12)) AS y FROM spectrum)",
    "d AS (SELECT *, lag(y) OVER w AS l, lead(y) OVER w AS r FROM y WINDOW w AS (PARTITION BY note ORDER BY bin))",
    "u AS (SELECT d.* FROM d JOIN (SELECT note, quantile_cont(amp, 0.1) AS floor_ FROM spectrum GROUP BY note) USING (note) WHERE y > l AND y >= r AND amp >= floor_ * pow(10, 3 / 20.0::DOUBLE))",
    "x AS (SELECT *, max(struct_pack(amp := amp, b := -bin)) OVER (PARTITION BY note ORDER BY bin RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS top FROM u)",
    "z AS (SELECT *, CASE WHEN abs(l - 2 * y + r) > 2e-10 THEN greatest(least(0.5 * (l - r) / (l - 2 * y + r), 1), -1) ELSE 0 END AS shift FROM x WHERE top.b = -bin)",
    "peaks AS (SELECT note, bin, freq_hz + shift * 100 AS freq_hz, pow(10, y - 0.25 * (l - r) * shift) AS amp FROM z)",
    "w AS (SELECT note, bin, freq_hz, amp, 170.0::DOUBLE + note % 300 AS f0, unnest(range(1, 41)) AS n FROM peaks)",
    f"i AS (SELECT note, list(struct_pack(n := n, off_ := round(abs(freq_hz - n * f0), 9), bin := bin, freq_hz := freq_hz, amp := amp) ORDER BY n, round(abs(freq_hz - n * f0), 9), bin) AS found FROM w WHERE abs(freq_hz - n * f0) <= n * f0 * {_R!r} GROUP BY note)",
    "f AS (SELECT note, list_reduce(list_prepend([found[1]][1:0], list_transform(found, lambda x: [x])), lambda a, x: CASE WHEN len(a) = 0 THEN x WHEN x[1].n > a[-1].n AND NOT list_contains(list_transform(a, lambda e: e.bin), x[1].bin) THEN list_concat(a, x) ELSE a END) AS taken FROM i)",
    "partials AS (SELECT note, x.n AS n, x.bin AS bin, x.freq_hz AS freq_hz, x.amp AS amp, x.off_ AS off_hz FROM (SELECT note, unnest(taken) AS x FROM f))",
)


def _partials(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    bins = spectrum(spark, sf_dir)
    peaks = partials.spectral_peaks(bins)
    return peaks, partials.harmonic_partials(peaks, bins.select("note", (170.0 + F.col("note") % 300).alias("f0_hz")).distinct(), 60.0)


@query(rounded_sql(with_ctes(SPECTRUM, *_PEAKS) + "SELECT note, n, bin, freq_hz, amp, off_hz FROM partials", "freq_hz amp off_hz", "note n bin"))
def peak_partials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peaks of 64 bins of 100 Hz within 60 cents of the orders of fundamentals from 170 to 469 Hz."""
    return rounded(_partials(spark, sf_dir)[1])


@query(
    rounded_sql(
        with_ctes(SPECTRUM, *_PEAKS, "e AS (SELECT p.note, p.amp * p.amp AS e, h.n, CASE WHEN h.n IS NOT NULL THEN 'h' WHEN p.freq_hz < 300 THEN 'low' ELSE 'other' END AS kind FROM peaks p LEFT JOIN partials h ON h.note = p.note AND h.bin = p.bin)")
        + "SELECT note, count(*) AS peaks, count(n) AS partials, coalesce(sum(e) FILTER (kind = 'h'), 0) / sum(e) AS harmonic_share, coalesce(sum(e) FILTER (kind = 'low'), 0) / sum(e) AS low_share, coalesce(sum(e) FILTER (kind = 'other'), 0) / sum(e) AS other_share FROM e GROUP BY note",
        "harmonic_share low_share other_share",
        "note peaks partials",
    )
)
def peak_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(partials.peak_energy(*_partials(spark, sf_dir), 300.0))


# Normality ----------------------------------------------------------------------------------------


def _tail_sql(z: str) -> str:
    series, fraction = "1", z
    for k in range(normality.SERIES, 0, -1):
        series = f"(1 + {z} * {z} / {2 * k + 1} * {series})"
    for k in range(normality.FRACTION, 0, -1):
        fraction = f"({z} + {k} / {fraction})"
    return f"CASE WHEN {z} < 2 THEN ln(0.5::DOUBLE - exp(-{z} * {z} / 2) / sqrt(2 * pi()) * {z} * {series}) ELSE -{z} * {z} / 2 - ln(2 * pi()) / 2 - ln({fraction}) END"


_NORMAL = (
    "c AS (SELECT unnest(['m1', 'm2', 'm3']) AS metric, unnest([m1, m2, m3]) AS v FROM metrics)",
    "s AS (SELECT metric, count(*)::DOUBLE AS n, avg(v) AS m, stddev_samp(v) AS sd FROM c WHERE v IS NOT NULL GROUP BY metric)",
    "g AS (SELECT metric, any_value(n) AS n, avg(pow(v - m, 3)) / pow(avg(pow(v - m, 2)), 1.5) AS g1, avg(pow(v - m, 4)) / pow(avg(pow(v - m, 2)), 2) AS b2 FROM c JOIN s USING (metric) WHERE v IS NOT NULL GROUP BY metric)",
    "o AS (SELECT metric, n, (v - m) / sd AS z, abs((v - m) / sd) AS a, row_number() OVER (PARTITION BY metric ORDER BY v)::DOUBLE AS i FROM c JOIN s USING (metric) WHERE v IS NOT NULL)",
    f"t AS (SELECT *, {_tail_sql('a')} AS tail FROM o)",
    "u AS (SELECT metric, n, i, CASE WHEN z < 0 THEN tail ELSE ln(1 - exp(tail)) END AS below, CASE WHEN z < 0 THEN ln(1 - exp(tail)) ELSE tail END AS above FROM t)",
    "a AS (SELECT metric, (-n - sum((2 * i - 1) * below + (2 * (n - i) + 1) * above) / n) * (1 + 0.75 / n + 2.25 / (n * n)) AS a2 FROM u GROUP BY metric, n)",
    "k0 AS (SELECT *, g1 * sqrt((n + 1) * (n + 3) / (6 * (n - 2))) AS y, sqrt(2 * (3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9)) - 1)) - 1 AS w2, (b2 - 3 * (n - 1) / (n + 1)) / sqrt(24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))) AS x, 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))) AS r FROM g)",
    "k1 AS (SELECT *, 6 + 8 / r * (2 / r + sqrt(1 + 4 / (r * r))) AS b FROM k0)",
    "k2 AS (SELECT metric, n, ln(y / sqrt(2 / (w2 - 1)) + sqrt(y * y * (w2 - 1) / 2 + 1)) / sqrt(ln(w2) / 2) AS skew_z, (1 - 2 / (9 * b) - sign(1 + x * sqrt(2 / (b - 4))) * cbrt((1 - 2 / b) / abs(1 + x * sqrt(2 / (b - 4))))) / sqrt(2 / (9 * b)) AS kurtosis_z FROM k1)",
)


@query(
    rounded_sql(
        with_ctes(METRICS, *_NORMAL)
        + "SELECT metric, CAST(n AS BIGINT) AS n, skew_z, kurtosis_z, skew_z * skew_z + kurtosis_z * kurtosis_z AS k2, exp(-(skew_z * skew_z + kurtosis_z * kurtosis_z) / 2) AS k2_p, a2, CASE WHEN a2 >= 0.6 THEN exp(1.2937 - 5.709 * a2 + 0.0186 * a2 * a2) WHEN a2 >= 0.34 THEN exp(0.9177 - 4.279 * a2 - 1.38 * a2 * a2) WHEN a2 >= 0.2 THEN 1 - exp(-8.318 + 42.796 * a2 - 59.938 * a2 * a2) ELSE 1 - exp(-13.436 + 101.14 * a2 - 223.73 * a2 * a2) END AS a2_p FROM k2 JOIN a USING (metric)",
        "skew_z kurtosis_z k2 k2_p a2 a2_p",
        "metric n",
        digits=5,
    )
)
def normality_order_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, out = metrics(spark, sf_dir), None
    for m in ("m1", "m2", "m3"):
        one = normality.normality_tests(rows, m).select(F.lit(m).alias("metric"), "*")
        out = one if out is None else out.unionByName(one)
    return rounded(out, 5)
