"""Queries of the relational layer: merges, deduplication, diffs, set operations, gates, coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonagrid.functions import guards
from sonagrid.operators import relational, statistics
from sonagrid.plans.catalog import query
from sonagrid.plans.inputs import COMPONENTS, METRICS, components, metrics, table, with_ctes
from sonagrid.plans.rounding import rounded, rounded_sql

_LEFT = "l AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE n_chars END AS n_chars, lang FROM documents)"
_RIGHT = "r AS (SELECT doc_id, quality * 1000 AS n_chars, toxic FROM labels)"


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    left = docs.select("doc_id", F.when(F.pmod("doc_id", F.lit(3)) != 0, F.col("n_chars")).alias("n_chars"), "lang")
    return left, labels.select("doc_id", (F.col("quality") * 1000).cast("long").alias("n_chars"), F.col("toxic").cast("long").alias("toxic"))


@query(with_ctes(_LEFT, _RIGHT) + "SELECT l.doc_id, CAST(coalesce(l.n_chars, r.n_chars) AS BIGINT) AS n_chars, l.lang, CAST(r.toxic AS BIGINT) AS toxic FROM l LEFT JOIN r USING (doc_id)")
def merge_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = _sides(spark, sf_dir)
    return relational.merge_coalesce(left, relational.require_unique(right, ["doc_id"]), ["doc_id"])


@query(
    rounded_sql(
        "WITH n AS (SELECT n_nationkey, n_name, r_name FROM nation LEFT JOIN region ON n_regionkey = r_regionkey)\nSELECT o_orderkey, o_totalprice, c_mktsegment, n_name, r_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN n ON c_nationkey = n_nationkey",
        "o_totalprice",
        "o_orderkey c_mktsegment n_name r_name",
    )
)
def satellite_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with the sheets that belong to them; the small sheets are joined first."""
    places = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left").select("n_nationkey", "n_name", "r_name")
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left").join(places, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return rounded(rows.select("o_orderkey", "o_totalprice", "c_mktsegment", "n_name", "r_name"))


_PRIORITY = "(CASE WHEN l_linestatus = 'F' THEN 1000 ELSE 0 END + CASE WHEN l_returnflag = 'N' THEN 100 ELSE 0 END + l_quantity)"


@query(rounded_sql(f"WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_PRIORITY} DESC, l_partkey, l_suppkey, l_linenumber) AS k FROM lineitem)\nSELECT l_orderkey, l_partkey, l_suppkey, l_quantity FROM r WHERE k = 1", "l_quantity", "l_orderkey l_partkey l_suppkey"))
def dedupe_best_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    priority = F.when(F.col("l_linestatus") == "F", 1000).otherwise(0) + F.when(F.col("l_returnflag") == "N", 100).otherwise(0) + F.col("l_quantity")
    return rounded(relational.best_row(rows, ["l_orderkey"], F.desc(priority), "l_partkey", "l_suppkey", "l_linenumber").select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity"))


@query("SELECT o_custkey, arg_max(o_orderpriority, o_orderkey) FILTER (WHERE o_orderkey % 4 <> 0) AS priority, CAST(arg_max(o_orderkey, o_orderkey) FILTER (WHERE o_orderkey % 3 <> 0) AS BIGINT) AS last_key FROM orders GROUP BY o_custkey")
def last_non_null_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.when(F.pmod("o_orderkey", F.lit(4)) != 0, F.col("o_orderpriority")).alias("priority"), F.when(F.pmod("o_orderkey", F.lit(3)) != 0, F.col("o_orderkey")).alias("last_key"))
    return relational.last_non_null(rows, ["o_custkey"], F.col("o_orderkey"), ["priority", "last_key"])


@query("SELECT l_orderkey, l_linenumber, count(*) AS rows FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def m1_violation_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.violating_keys(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


_DIFF = """a AS (SELECT c_custkey AS k, c_acctbal AS v FROM customer WHERE c_custkey % 5 <> 0),
b AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN c_acctbal ELSE c_acctbal * 1.01 END AS v FROM customer WHERE c_custkey % 7 <> 0),
d AS (SELECT k, a.v AS current, b.v AS baseline, a.v - b.v AS delta, CASE WHEN b.v <> 0 THEN 100 * (a.v - b.v) / abs(b.v) END AS percent, CASE WHEN a.v IS NULL THEN 'baseline_only' WHEN b.v IS NULL THEN 'current_only' ELSE 'both' END AS side FROM a FULL JOIN b USING (k))"""


def _diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))
    other = c.filter(F.pmod("k", F.lit(7)) != 0).withColumn("v", F.when(F.pmod("k", F.lit(2)) == 0, F.col("v")).otherwise(F.col("v") * 1.01))
    return relational.full_diff(c.filter(F.pmod("k", F.lit(5)) != 0), other, ["k"], "v")


@query(rounded_sql(with_ctes(_DIFF) + "SELECT * FROM d", "current baseline delta percent", "k side"))
def full_outer_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_diff(spark, sf_dir))


@query(rounded_sql(with_ctes(_DIFF) + "SELECT count(*) AS rows, count(*) FILTER (WHERE abs(percent) > 0.5) AS over, max(abs(percent)) AS largest, count(*) FILTER (WHERE side <> 'both') AS one_sided FROM d", "largest", "rows over one_sided"))
def diff_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(relational.diff_summary(_diff(spark, sf_dir), 0.5))


@query("SELECT 'anti' AS kind, count(*) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT 'semi', count(*) FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def anti_semi_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    kinds = [docs.join(labels, "doc_id", f"left_{k}").agg(F.lit(k).alias("kind"), F.count("*").alias("n")) for k in ("anti", "semi")]
    return kinds[0].unionByName(kinds[1])


@query(
    """WITH a AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'A'), b AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R')
SELECT 'union' AS op, count(*) AS n, CAST(sum(k) AS BIGINT) AS total FROM (SELECT k FROM a UNION SELECT k FROM b)
UNION ALL SELECT 'intersect', count(*), CAST(sum(k) AS BIGINT) FROM (SELECT k FROM a INTERSECT SELECT k FROM b)
UNION ALL SELECT 'except', count(*), CAST(sum(k) AS BIGINT) FROM (SELECT k FROM a EXCEPT SELECT k FROM b)"""
)
def union_intersect_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    a, b = (rows.filter(F.col("l_returnflag") == x).select(F.col("l_partkey").alias("k")) for x in ("A", "R"))
    parts = {"union": a.union(b).distinct(), "intersect": a.intersect(b), "except": a.subtract(b)}
    out = [p.agg(F.lit(n).alias("op"), F.count("*").alias("n"), F.sum("k").alias("total")) for n, p in parts.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


_BALANCE = "b AS (SELECT note, coalesce(sum(amp) FILTER (WHERE comp = 'H'), 0) AS h, coalesce(sum(amp) FILTER (WHERE comp = 'I'), 0) AS i, coalesce(sum(amp) FILTER (WHERE comp = 'S'), 0) AS s, sum(amp) AS total FROM components GROUP BY note)"


@query(with_ctes(COMPONENTS, _BALANCE) + "SELECT note, CASE WHEN total <= 0 THEN 'empty' WHEN abs(h + i + s - total) > 1e-6 THEN 'mismatch' WHEN h / total >= 0.5 THEN 'harmonic' WHEN i / total >= 0.5 THEN 'residual' ELSE 'mixed' END AS status FROM b")
def component_balance_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = [F.coalesce(F.sum(F.when(F.col("comp") == c, F.col("amp"))), F.lit(0.0)).alias(c.lower()) for c in "HIS"]
    b = components(spark, sf_dir).groupBy("note").agg(*part, F.sum("amp").alias("total"))
    off = F.abs(F.col("h") + F.col("i") + F.col("s") - F.col("total")) > 1e-6
    status = F.when(F.col("total") <= 0, "empty").when(off, "mismatch").when(F.col("h") / F.col("total") >= 0.5, "harmonic").when(F.col("i") / F.col("total") >= 0.5, "residual").otherwise("mixed")
    return b.select("note", status.alias("status"))


_QUALITY = "q AS (SELECT l_orderkey AS note, 100.0 - CASE WHEN bool_or(l_returnflag = 'N') THEN 0 ELSE 35 END - CASE WHEN sum(l_discount) <= 0.2 THEN 0 ELSE 25 END - CASE WHEN count(*) > 2 THEN 0 ELSE 15 END - CASE WHEN max(l_tax) < 0.08 THEN 0 ELSE 10 END AS score FROM lineitem GROUP BY l_orderkey)"


@query(rounded_sql(with_ctes(_QUALITY) + "SELECT note, greatest(0.0, score) AS score, CASE WHEN score <= 59.999 THEN 'reject' WHEN score <= 74.999 THEN 'diagnostic' WHEN score <= 84.999 THEN 'usable_with_caution' WHEN score <= 92.999 THEN 'good' ELSE 'strong' END AS grade FROM q", "score", "note grade"))
def quality_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sum of discounts is compared with a bound that one note in 29 meets exactly: where it is that near, discounts are added up in the order of the table, as SQL does."""
    less = lambda ok, cost: F.when(ok, 0.0).otherwise(float(cost))
    items = table(spark, sf_dir, "lineitem").withColumns({"note": F.col("l_orderkey"), "_file": F.col("_metadata.file_path"), "_row": F.col("_metadata.row_index")})
    rows = items.groupBy("note").agg(
        F.sum("l_discount").alias("loss"), (100.0 - less(F.bool_or(F.col("l_returnflag") == "N"), 35) - less(F.count("*") > 2, 15) - less(F.max("l_tax") < 0.08, 10)).alias("score")
    )
    near = rows.filter(F.abs(F.col("loss") - 0.2) < 1e-9).select("note").alias("near")
    items = items.select("note", "l_discount", "_file", "_row").alias("items").join(near, F.col("items.note").eqNullSafe(F.col("near.note")), "left_semi")
    exact = statistics.sum_in_order(items, ["note"], "l_discount", ["_file", "_row"]).alias("exact")
    rows = rows.alias("rows").join(exact, F.col("rows.note").eqNullSafe(F.col("exact.note")), "left")
    score = guards.clip(F.col("score") - less(F.coalesce("exact.l_discount", "loss") <= 0.2, 25), 0.0, 100.0)
    return rounded(rows.select("rows.note", score.alias("score"), guards.quality_grade(score).alias("grade")))


@query("SELECT l_orderkey AS note, count(*) AS frames, count(*) FILTER (WHERE l_linestatus = 'F') AS validated, count(*) >= 8 AND count(*) FILTER (WHERE l_linestatus = 'F') > 2 AS eligible FROM lineitem GROUP BY l_orderkey")
def eligibility_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("note")).agg(F.count("*").alias("frames"), F.count_if(F.col("l_linestatus") == "F").alias("validated"))
    return rows.withColumn("eligible", guards.eligible(F.col("frames"), F.col("validated")))


def _cells(sql_name: str = "metrics") -> str:
    return " UNION ALL ".join(f"SELECT note, grp, '{m}' AS metric, {m} AS value FROM {sql_name}" for m in ("m1", "m2", "m3", "m4"))


@query(rounded_sql(with_ctes(METRICS, f"c AS ({_cells()})") + "SELECT metric, count(value) AS present, count(value) / count(*) AS fraction FROM c GROUP BY metric", "fraction", "metric present"))
def coverage_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(relational.coverage(metrics(spark, sf_dir), ["m1", "m2", "m3", "m4"]))


@query(rounded_sql(with_ctes(METRICS, f"c AS ({_cells()})") + "SELECT metric, count(*) FILTER (WHERE value IS NULL) AS missing, count(*) FILTER (WHERE value IS NULL) / count(*) AS fraction, min(note) FILTER (WHERE value IS NULL) AS first_label FROM c GROUP BY metric", "fraction", "metric missing first_label"))
def missing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(relational.missing_summary(metrics(spark, sf_dir), ["m1", "m2", "m3", "m4"], "note"))


@query(with_ctes(METRICS, f"c AS ({_cells()})") + "SELECT metric, count(DISTINCT value) AS \"distinct\" FROM c WHERE value IS NOT NULL GROUP BY metric HAVING stddev_samp(value) <= 1e-9 OR count(value) < 2")
def near_constant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.near_constant(metrics(spark, sf_dir), ["m1", "m2", "m3", "m4"])


@query(with_ctes(METRICS) + "SELECT 'm1_positive' AS \"check\", count(*) FILTER (WHERE NOT coalesce(m1 > 0, false)) AS violations FROM metrics UNION ALL SELECT 'm2_present', count(*) FILTER (WHERE m2 IS NULL) FROM metrics UNION ALL SELECT 'm3_bounded', count(*) FILTER (WHERE NOT coalesce(m3 BETWEEN 0 AND 600, false)) FROM metrics")
def contract_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    checks = {"m1_positive": F.col("m1") > 0, "m2_present": F.col("m2").isNotNull(), "m3_bounded": guards.in_range(F.col("m3"), 0, 600)}
    return relational.contract_violations(metrics(spark, sf_dir), checks)


@query("SELECT event_type, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS k, count(*) AS n FROM events GROUP BY event_type")
def json_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_type", F.from_json("props", "k bigint").alias("p"))
    return rows.groupBy("event_type").agg(F.sum("p.k").alias("k"), F.count("*").alias("n"))


@query("SELECT 'orders' AS sheet, 'rows' AS key, CAST(count(*) AS VARCHAR) AS value FROM orders UNION ALL SELECT 'orders', 'statuses', CAST(count(DISTINCT o_orderstatus) AS VARCHAR) FROM orders UNION ALL SELECT 'orders', 'group:' || o_orderstatus, CAST(count(*) AS VARCHAR) FROM orders GROUP BY o_orderstatus")
def corpus_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders")
    whole = rows.agg(F.count("*").alias("rows"), F.countDistinct("o_orderstatus").alias("statuses")).unpivot([], ["rows", "statuses"], "key", "value")
    groups = rows.groupBy("o_orderstatus").agg(F.count("*").alias("value")).select(F.concat(F.lit("group:"), "o_orderstatus").alias("key"), "value")
    return whole.unionByName(groups).select(F.lit("orders").alias("sheet"), "key", F.col("value").cast("string").alias("value"))
