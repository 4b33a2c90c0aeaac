"""Statistics over metric tables: descriptions, correlations, rank tests, regression, components."""

from __future__ import annotations

from itertools import combinations

from pyspark.ml.feature import PCA, Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sonagrid.operators import quantiles
from sonagrid.operators.normalise import average_ranks


def sample_skewness(value: str) -> Column:
    """Bias-corrected G1; null with fewer than three values."""
    n = F.count(value)
    return F.when((n > 2) & (F.stddev_pop(value) > 0), F.skewness(value) * F.sqrt((n * (n - 1)).cast("double")) / (n - 2))


def correlation(a: str, b: str) -> Column:
    """Pearson's r over the rows that have both; null where one of them does not vary (``corr`` fails there)."""
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    spread = F.stddev_pop(F.when(both, F.col(a))) * F.stddev_pop(F.when(both, F.col(b)))
    return F.try_divide(F.covar_pop(a, b), spread)


def sample_kurtosis(value: str) -> Column:
    """Bias-corrected excess G2; null with fewer than four values."""
    n = F.count(value).cast("double")
    return F.when((n > 3) & (F.stddev_pop(value) > 0), (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(value) + 6))


def describe(rows: DataFrame, metrics: list[str], group: str) -> DataFrame:
    """Count, mean, std, quartiles and range per metric: over all rows, and per group (grouping sets)."""
    cells = rows.unpivot([group], metrics, "metric", "value").filter("value is not null")
    sets = cells.groupingSets([["metric"], ["metric", group]], "metric", group).agg(
        F.grouping(group).alias("_all"),
        F.count("value").alias("count"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    both = F.explode(F.array(F.struct(F.lit(1).cast("byte").alias("_all"), F.lit(None).cast(cells.schema[group].dataType).alias("_g")), F.struct(F.lit(0).cast("byte").alias("_all"), F.col(group).alias("_g"))))
    twice = cells.select("metric", "value", both.alias("x")).select("metric", "value", "x._all", F.col("x._g").alias(group))
    sets = quantiles.with_exact(sets, twice, ["metric", "_all", group], "value", {"q25": 0.25, "median": 0.5, "q75": 0.75})
    return sets.withColumn("scope", F.when(F.col("_all") == 1, "ALL").otherwise(F.coalesce(F.col(group), F.lit("(none)")))).drop("_all", group)


def shape(cells: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Range, interquartile range, coefficient of variation, G1 and G2 per key."""
    out = cells.groupBy(*keys).agg(
        (F.max(value) - F.min(value)).alias("range"),
        F.try_divide(F.stddev_samp(value), F.avg(value)).alias("cv"),
        sample_skewness(value).alias("g1"),
        sample_kurtosis(value).alias("g2"),
    )
    out = quantiles.with_exact(out, cells, keys, value, {"_q1": 0.25, "_q3": 0.75})
    return out.select(*keys, "range", (F.col("_q3") - F.col("_q1")).alias("iqr"), "cv", "g1", "g2")


def correlations(rows: DataFrame, metrics: list[str], least: int = 3) -> DataFrame:
    """Pairwise-complete Pearson correlation of every two metrics, in one scan; null with too few or constant values."""
    pairs = list(combinations(sorted(metrics), 2))
    cells = []
    for i, (a, b) in enumerate(pairs):
        both = F.col(a).isNotNull() & F.col(b).isNotNull()
        x, y = F.when(both, F.col(a)), F.when(both, F.col(b))
        varied = (F.count(x) >= least) & (F.stddev_pop(x) > 1e-12) & (F.stddev_pop(y) > 1e-12)
        cells += [F.when(varied, F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))).alias(f"r{i}"), F.count(x).alias(f"n{i}")]
    wide = rows.agg(*cells)
    out = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{i}").alias("r"), F.col(f"n{i}").alias("n")) for i, (a, b) in enumerate(pairs)])
    return wide.select(F.explode(out).alias("x")).select("x.*")


def sum_in_order(rows: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """(keys, sum of ``value``), a key's values added up one by one in the order given: the same in its last bit however rows are dealt over tasks."""
    of = Window.partitionBy(*keys).orderBy(*order)
    upto = F.sum(value).over(of.rowsBetween(Window.unboundedPreceding, 0))
    return rows.select(*keys, upto.alias(value), F.lead(F.lit(True)).over(of).alias("_more")).filter("_more IS NULL").drop("_more")


def spearman(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Spearman's rho of two columns: Pearson of average ranks over complete rows."""
    cells = rows.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y"))
    ranked = average_ranks(average_ranks(cells, [], "x", "rx"), [], "y", "ry")
    return ranked.agg(F.corr("rx", "ry").alias("rho"), F.count("*").alias("n"))


def spearman_all(rows: DataFrame, names: list[str]) -> DataFrame:
    """(a, b, rho, n): :func:`spearman` of every two of the columns, each pair over the rows that have both.

    Every column is ordered and joined back once, whatever the number of pairs; NaN is missing.
    """
    at = {n: i for i, n in enumerate(names)}
    there = [F.when(F.col(n).isNotNull() & ~F.isnan(n), 1 << i).otherwise(0) for n, i in at.items()]
    cells = rows.select(*(F.col(n).cast("double").alias(n) for n in names)).withColumn("_there", sum(there, F.lit(0)))
    ranked = cells
    for n, i in at.items():
        ranked = ranked.join(quantiles.ranks_among(cells, n, "_there", {f"_{i}_{j}": 1 << i | 1 << j for j in at.values() if j != i}), [n, "_there"], "left")
    pairs = [(a, b, F.col(f"_{at[a]}_{at[b]}"), F.col(f"_{at[b]}_{at[a]}")) for a, b in combinations(names, 2)]
    found = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(x, y).alias("rho"), F.count(F.when(x.isNotNull() & y.isNotNull(), 1)).alias("n")) for a, b, x, y in pairs]
    return ranked.agg(F.array(*found).alias("found")).select(F.inline("found"))


def kruskal_wallis(cells: DataFrame, group: str, value: str) -> DataFrame:
    """H with the correction for ties, its degrees of freedom and epsilon squared."""
    ranked = average_ranks(cells.filter(F.col(group).isNotNull() & F.col(value).isNotNull()), [], value)
    sums = ranked.groupBy(group).agg(F.sum("rank").alias("r"), F.count("*").cast("double").alias("n"))
    total = sums.agg(F.sum("n").alias("N"), F.sum(F.col("r") * F.col("r") / F.col("n")).alias("s"), F.count("*").alias("k"))
    ties = ranked.groupBy(value).agg(F.count("*").cast("double").alias("t")).agg(F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")).alias("ties"))
    n = F.col("N")
    h = (12 / (n * (n + 1)) * F.col("s") - 3 * (n + 1)) / (1 - F.col("ties") / (n * n * n - n))
    rows = total.crossJoin(F.broadcast(ties)).select(h.alias("h"), (F.col("k") - 1).alias("df"), n.cast("long").alias("n"))
    return rows.withColumn("epsilon_squared", F.col("h") / ((F.pow("n", F.lit(2.0)) - 1) / (F.col("n") + 1)))


def mann_whitney(cells: DataFrame, group: str, value: str, first: str, second: str) -> DataFrame:
    """U of the first group and its normal approximation with the tie correction."""
    two = cells.filter(F.col(group).isin(first, second) & F.col(value).isNotNull())
    ranked = average_ranks(two, [], value)
    sums = ranked.agg(F.sum(F.when(F.col(group) == first, F.col("rank"))).alias("r"), F.count_if(F.col(group) == first).cast("double").alias("a"), F.count_if(F.col(group) == second).cast("double").alias("b"))
    ties = ranked.groupBy(value).agg(F.count("*").cast("double").alias("t")).agg(F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")).alias("ties"))
    a, b = F.col("a"), F.col("b")
    n = a + b
    u = F.col("r") - a * (a + 1) / 2
    sigma = F.sqrt(a * b / 12 * ((n + 1) - F.col("ties") / (n * (n - 1))))
    return sums.crossJoin(F.broadcast(ties)).select(u.alias("u"), F.try_divide(u - a * b / 2, sigma).alias("z"), a.cast("long").alias("n1"), b.cast("long").alias("n2"))


def least_squares(rows: DataFrame, y: str, xs: list[str]) -> DataFrame:
    """Simple regression of y on each x: slope, intercept, r squared, n; strongest first."""
    cells = []
    for i, x in enumerate(xs):
        cells += [F.regr_slope(y, x).alias(f"s{i}"), F.regr_intercept(y, x).alias(f"i{i}"), F.regr_r2(y, x).alias(f"r{i}"), F.regr_count(y, x).alias(f"n{i}")]
    wide = rows.agg(*cells)
    out = F.array(*[F.struct(F.lit(x).alias("predictor"), F.col(f"s{i}").alias("slope"), F.col(f"i{i}").alias("intercept"), F.col(f"r{i}").alias("r2"), F.col(f"n{i}").alias("n")) for i, x in enumerate(xs)])
    return wide.select(F.explode(out).alias("x")).select("x.*")


def win_counts(responses: DataFrame, first: str, second: str, choice: str) -> DataFrame:
    """Wins of every item over its pairs, zero-win items too."""
    won = responses.select(F.col(choice).alias("item"), F.lit(1).alias("w"))
    seen = responses.select(F.col(first).alias("item"), F.lit(0).alias("w")).unionByName(responses.select(F.col(second).alias("item"), F.lit(0).alias("w")))
    return won.unionByName(seen).filter("item is not null").groupBy("item").agg(F.sum("w").alias("wins"))


def adjacent_pairs(notes: DataFrame, order: str, bucket: Column | None = None) -> DataFrame:
    """Consecutive notes as pairs, and the last with the first.

    Windows run within ``bucket`` (an ascending range of ``order``) and its ends are joined by a
    window over one row a bucket, so no task sees all notes.
    """
    rows = notes.select(F.col(order).alias("a"), (F.lit(0) if bucket is None else bucket).alias("_b"))
    inner = rows.withColumn("b", F.lead("a").over(Window.partitionBy("_b").orderBy("a")))
    ends = rows.groupBy("_b").agg(F.min("a").alias("lo"), F.max("a").alias("hi"))
    linked = ends.withColumn("next", F.lead("lo").over(Window.orderBy("lo"))).select("hi", "next")
    wrap = rows.agg(F.max("a").alias("a"), F.min("a").alias("b")).filter("a <> b")
    full = inner.join(linked, inner["a"] == linked["hi"], "left").select("a", F.coalesce("b", "next").alias("b")).filter("b is not null")
    return full.withColumn("kind", F.lit("adjacent")).unionByName(wrap.withColumn("kind", F.lit("ends")))


def principal_components(rows: DataFrame, label: str, metrics: list[str], k: int = 3) -> tuple[DataFrame, list[float]]:
    """(label, scores) and explained variance of mean-imputed, standardised metrics."""
    filled = Imputer(strategy="mean", inputCols=metrics, outputCols=[f"_{m}" for m in metrics]).fit(rows).transform(rows)
    vectors = VectorAssembler(inputCols=[f"_{m}" for m in metrics], outputCol="_v").transform(filled)
    scaled = StandardScaler(withMean=True, inputCol="_v", outputCol="_z").fit(vectors).transform(vectors)
    model = PCA(k=min(k, len(metrics)), inputCol="_z", outputCol="_p").fit(scaled)
    return model.transform(scaled).select(label, vector_to_array("_p").alias("scores")), [float(x) for x in model.explainedVariance]


def group_means(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Mean, median and count per group (null groups dropped), with its place from the highest mean."""
    means = rows.filter(F.col(group).isNotNull()).groupBy(group).agg(F.avg(value).alias("mean"), F.percentile(value, 0.5).alias("median"), F.count(value).alias("n"))
    return means.withColumn("place", F.row_number().over(Window.orderBy(F.desc("mean"), group)))


def high_correlations(pairs: DataFrame, declared: list[tuple[str, str]], threshold: float = 0.9) -> DataFrame:
    """Pairs (a, b, r) with |r| from the threshold up, and whether they depend by definition (declared) or only in the data."""
    known = F.array(*[F.struct(F.lit(min(p)).alias("a"), F.lit(max(p)).alias("b")) for p in declared]) if declared else None
    own = F.struct(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    kind = F.lit("empirical") if known is None else F.when(F.array_contains(known, own), "declared").otherwise("empirical")
    return pairs.filter(F.abs("r") >= threshold).select("a", "b", "r", kind.alias("kind"))


def strongest(pairs: DataFrame, target: str, k: int = 10) -> DataFrame:
    """The k predictors with the largest |r| to a target (a report)."""
    other = F.when(F.col("a") == target, F.col("b")).otherwise(F.col("a"))
    own = pairs.filter(((F.col("a") == target) | (F.col("b") == target)) & F.col("r").isNotNull())
    rows = own.select(other.alias("predictor"), "r").orderBy(F.desc(F.abs("r")), "predictor").limit(k)
    return rows.withColumn("place", F.row_number().over(Window.orderBy(F.desc(F.abs("r")), "predictor")))


def group_correlations(rows: DataFrame, group: str, metrics: list[str], baseline: str) -> DataFrame:
    """How far each group's correlations lie from those of a baseline group: mean and largest |difference|, and pairs compared."""
    pairs = list(combinations(sorted(metrics), 2))
    wide = rows.groupBy(group).agg(*[correlation(a, b).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    long = wide.unpivot([group], [f"r{i}" for i in range(len(pairs))], "pair", "r").filter(F.col("r").isNotNull() & ~F.isnan("r"))
    base = long.filter(F.col(group) == baseline).select("pair", F.col("r").alias("base"))  # one row a pair
    met = long.filter(F.col(group) != baseline).join(F.broadcast(base), "pair")
    gap = F.abs(F.col("r") - F.col("base"))
    return met.groupBy(group).agg(F.avg(gap).alias("mean_gap"), F.max(gap).alias("largest_gap"), F.count("*").alias("pairs"))


def deviations(rows: DataFrame, baseline: DataFrame, keys: list[str], group: str, value: str) -> DataFrame:
    """Per group: mean, std, range and mean size of the deviation in per cent from the baseline's value of the same key."""
    base = baseline.select(*keys, F.col(value).alias("_base")).filter(F.col("_base") != 0)
    percent = 100 * (F.col(value) - F.col("_base")) / F.col("_base")
    met = rows.join(base, keys).withColumn("_p", percent)
    return met.groupBy(group).agg(F.avg("_p").alias("mean"), F.stddev_pop("_p").alias("std"), F.min("_p").alias("least"), F.max("_p").alias("most"), F.avg(F.abs("_p")).alias("mean_size"), F.count("_p").alias("n"))


def consistency(rows: DataFrame, group: str, metrics: list[str], edges: tuple[float, float] = (0.1, 0.3)) -> DataFrame:
    """Per metric: mean and std of the groups' means, their ratio, and high, medium or low consistency."""
    long = rows.filter(F.col(group).isNotNull()).unpivot([group], metrics, "metric", "value").groupBy("metric", group).agg(F.avg("value").alias("m")).filter("m is not null")
    out = long.groupBy("metric").agg(F.avg("m").alias("mean"), F.stddev_pop("m").alias("std"), F.count("*").alias("groups")).filter("groups > 1")
    cv = F.try_divide("std", "mean")
    return out.withColumn("cv", cv).withColumn("consistency", F.when(cv < edges[0], "high").when(cv < edges[1], "medium").when(cv.isNotNull(), "low"))


def multiple_regression(rows: DataFrame, group: str, y: str, xs: list[str]) -> DataFrame:
    """Least squares of y on standardised predictors, per group: intercept, one coefficient each, r squared, rmse, n.

    Missing predictors count as 0 before standardising; rows without y are left out. One
    aggregation gathers each group's moments; the normal equations, one small system a group, are
    solved in Arrow batches. Constant predictors get 0.
    """
    import numpy as np
    import pyarrow as pa

    cols = [F.coalesce(F.col(x).cast("double"), F.lit(0.0)).alias(f"x{i}") for i, x in enumerate(xs)]
    cells = rows.filter(F.col(y).isNotNull() & F.col(group).isNotNull()).select(F.col(group).alias("g"), *cols, F.col(y).cast("double").alias(f"x{len(xs)}"))
    k = len(xs) + 1
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    moments = cells.groupBy("g").agg(F.count("*").alias("n"), F.array(*[F.avg(f"x{i}") for i in range(k)]).alias("mean"), F.array(*[F.covar_pop(f"x{i}", f"x{j}") for i, j in pairs]).alias("cov"))

    def solve(batches):
        for b in batches:
            out = []
            for n, mean, cov in zip(b["n"].to_pylist(), b["mean"].to_pylist(), b["cov"].to_pylist(), strict=True):
                c = np.zeros((k, k))
                for (i, j), v in zip(pairs, cov, strict=True):
                    c[i, j] = c[j, i] = v
                sd = np.sqrt(np.diag(c)[:-1])
                scale = np.where(sd > 1e-12, sd, 1.0)
                z = c[:-1, :-1] / np.outer(scale, scale)
                beta = np.linalg.lstsq(z, np.where(sd > 1e-12, c[:-1, -1] / scale, 0.0), rcond=1e-10)[0]
                left = max(c[-1, -1] - float(beta @ (c[:-1, -1] / scale)), 0.0)
                out.append((mean[-1], beta.tolist(), 1 - left / c[-1, -1] if c[-1, -1] > 0 else None, left**0.5, n))
            columns = list(zip(*out, strict=True)) or [[]] * 5
            kinds = (pa.float64(), pa.list_(pa.float64()), pa.float64(), pa.float64(), pa.int64())
            yield pa.RecordBatch.from_arrays([b["g"], *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names=["g", "intercept", "beta", "r2", "rmse", "n"])

    kind = cells.schema["g"].dataType.simpleString()
    solved = moments.mapInArrow(solve, f"g {kind}, intercept double, beta array<double>, r2 double, rmse double, n long")
    return solved.select(F.col("g").alias(group), "intercept", *[F.col("beta")[i].alias(f"b_{x}") for i, x in enumerate(xs)], "r2", "rmse", "n")


def fit_scale(rows: DataFrame, metrics: list[str], robust: bool = False) -> DataFrame:
    """(metric, centre, width) of a reference table: mean and std, or median and interquartile range."""
    long = rows.unpivot([], metrics, "metric", "value").filter(F.col("value").isNotNull())
    centre = F.percentile("value", 0.5) if robust else F.avg("value")
    width = F.percentile("value", 0.75) - F.percentile("value", 0.25) if robust else F.stddev_pop("value")
    return long.groupBy("metric").agg(centre.alias("centre"), width.alias("width"))


def apply_scale(rows: DataFrame, keys: list[str], metrics: list[str], scale: DataFrame) -> DataFrame:
    """Values of any table on a scale fitted before: (key, metric, z); 0 where the reference did not vary."""
    long = rows.unpivot(keys, metrics, "metric", "value").filter(F.col("value").isNotNull())
    z = F.when(F.col("width") > 1e-12, (F.col("value") - F.col("centre")) / F.col("width")).otherwise(0.0)
    return long.join(F.broadcast(scale), "metric").select(*keys, "metric", z.alias("z"))  # one row a metric


def omnibus_normality(cells: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Skewness and excess kurtosis with their squared sum n (g1^2 / 6 + g2^2 / 24), and its chi-squared(2) tail."""
    out = cells.groupBy(*keys).agg(F.count(value).alias("n"), F.skewness(value).alias("g1"), F.kurtosis(value).alias("g2"))
    k2 = F.col("n") * (F.col("g1") * F.col("g1") / 6 + F.col("g2") * F.col("g2") / 24)
    return out.withColumn("statistic", k2).withColumn("p", F.exp(-k2 / 2))


def outlier_fraction(cells: DataFrame, keys: list[str], value: str, low: float, high: float, most: float) -> DataFrame:
    """How many values lie out of a range, their share, and whether it is small enough."""
    out = cells.groupBy(*keys).agg(F.count(value).alias("n"), F.count_if(~F.col(value).between(low, high)).alias("outside"))
    share = F.try_divide(F.col("outside").cast("double"), F.col("n"))
    return out.withColumn("share", share).withColumn("valid", F.coalesce(share <= most, F.lit(False)))


def spread_over(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean, std, CV and range of a value measured under several settings."""
    out = rows.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), (F.max(value) - F.min(value)).alias("range"), F.count(value).alias("n"))
    return out.withColumn("cv", F.try_divide("std", "mean"))


