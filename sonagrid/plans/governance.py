"""Queries of tiered resolution, of the metric catalogue, and of streams that restart."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonagrid.operators import tiers
from sonagrid.plans.catalog import query
from sonagrid.plans.inputs import METRICS, metrics, table, with_ctes
from sonagrid.plans.metrics import FOLDED
from sonagrid.plans.rounding import rounded, rounded_sql
from sonagrid.sources import catalogue
from sonagrid.streaming import profiles, sinks

CATALOGUE = Path(catalogue.__file__).with_name("metric_catalogue.json")

_TIERS = (
    "l AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey END AS k1, CASE WHEN o_orderkey % 3 < 2 THEN CAST(floor(o_totalprice / 50) AS BIGINT) END AS k2, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey % 40 END AS k3 FROM orders)",
    "r AS (SELECT c_custkey AS t, c_custkey AS k1, CAST(floor(c_acctbal) AS BIGINT) AS k2, c_nationkey AS k3 FROM customer)",
    "m AS (SELECT id, tier, least_ AS t, n FROM l JOIN (SELECT 1 AS tier, k1 AS k, min(t) AS least_, count(*) AS n FROM r GROUP BY k1) ON k = l.k1 UNION ALL SELECT id, tier, least_, n FROM l JOIN (SELECT 2 AS tier, k2 AS k, min(t) AS least_, count(*) AS n FROM r GROUP BY k2) ON k = l.k2 UNION ALL SELECT id, tier, least_, n FROM l JOIN (SELECT 3 AS tier, k3 AS k, min(t) AS least_, count(*) AS n FROM r GROUP BY k3) ON k = l.k3)",
    "b AS (SELECT id, arg_min(struct_pack(tier := tier, t := t, n := n), CASE WHEN n > 1 THEN 10 ELSE 0 END + tier) AS x FROM m GROUP BY id)",
)


@query(with_ctes(*_TIERS) + "SELECT l.id, x.t AS target, ['id', 'balance', 'nation'][x.tier] AS tier, CASE WHEN x IS NULL THEN 'unmatched' WHEN x.n > 1 THEN 'ambiguous' ELSE 'matched' END AS status, coalesce(x.n, 0) AS candidates FROM l LEFT JOIN b ON b.id = l.id")
def tiered_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders to customers by id, by balance, by nation, some keys missing: rows of every tier, ambiguous and unmatched ones."""
    o = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(o.alias("id"), F.when(o % 3 == 0, F.col("o_custkey")).alias("k1"), F.when(o % 3 < 2, F.floor(F.col("o_totalprice") / 50)).alias("k2"), F.when(o % 7 != 0, o % 40).alias("k3"))
    targets = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("target"), F.floor("c_acctbal").alias("b"), F.col("c_nationkey").alias("c"))
    return tiers.resolve(rows, targets, "id", "target", [("id", F.col("k1"), F.col("target")), ("balance", F.col("k2"), F.col("b")), ("nation", F.col("k3"), F.col("c"))])


# Metrics under several names, as compiled tables of different age have them.
_NAMED = """cells AS (
  SELECT note, CASE WHEN name = 'm1' AND note % 50 = 0 THEN 'total' WHEN name = 'm1' AND note % 50 = 1 THEN 'm1_first' WHEN name = 'm3' AND note % 9 = 0 THEN 'old_m3' WHEN name = 'm2' AND note % 40 = 3 THEN 'm0' ELSE name END AS name, value
  FROM (SELECT note, unnest(['m1', 'm2', 'm3', 'm4']) AS name, unnest([m1, m2, m3, m4]) AS value FROM metrics))"""
_KNOWN = (
    "entries(name, metric, status) AS (VALUES ('m1', 'm1', 'canonical'), ('m2', 'm2', 'canonical'), ('m3', 'm3', 'diagnostic'), ('m5', 'm5', 'canonical'), ('total', 'm1', 'canonical'), ('m1_first', 'm1', 'canonical'), ('m0', 'm0', 'legacy'))",
    "seen AS (SELECT c.name, c.note, c.value, coalesce(e.metric, c.name) AS metric, CASE WHEN starts_with(c.name, 'old_') THEN 'legacy' ELSE coalesce(e.status, 'diagnostic') END AS status, e.metric IS NOT NULL AS declared FROM cells c LEFT JOIN entries e ON e.name = c.name)",
)


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    note, name = F.col("note"), F.col("name")
    long = metrics(spark, sf_dir).unpivot(["note"], ["m1", "m2", "m3", "m4"], "name", "value")
    old = F.when((name == "m1") & (note % 50 == 0), "total").when((name == "m1") & (note % 50 == 1), "m1_first").when((name == "m3") & (note % 9 == 0), "old_m3").when((name == "m2") & (note % 40 == 3), "m0")
    return long.withColumn("name", F.coalesce(old, name))


@query(
    with_ctes(METRICS, _NAMED, *_KNOWN)
    + "SELECT name, metric, status, count(*) AS cells, count(*) - count(value) AS missing, CASE WHEN status = 'legacy' THEN 'retired' WHEN NOT declared THEN 'undeclared' WHEN name <> metric THEN 'alias' WHEN count(value) = 0 THEN 'empty' ELSE 'ok' END AS finding FROM seen GROUP BY name, metric, status, declared UNION ALL SELECT name, name, status, 0, 0, 'absent' FROM entries WHERE name = metric AND status = 'canonical' AND name NOT IN (SELECT metric FROM seen)"
)
def metric_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue.drift(_cells(spark, sf_dir), catalogue.load(spark, CATALOGUE.as_uri()), ("old_",))


@query(rounded_sql(with_ctes(METRICS, _NAMED, *_KNOWN) + "SELECT note, metric, arg_min(value, (name <> metric, name)) AS value FROM seen WHERE status = 'canonical' AND value IS NOT NULL GROUP BY note, metric", "value", "note metric"))
def published_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(catalogue.published(_cells(spark, sf_dir), catalogue.load(spark, CATALOGUE.as_uri()), ["note"], prefixes=("old_",)))


# Streams ------------------------------------------------------------------------------------------


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.readStream.schema(table(spark, sf_dir, name).schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir.rstrip("/"))


@query(FOLDED)
def stream_adaptive_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch fold's rows from keyed state, by way of a sink and a checkpoint in the shared folder."""
    q, n = F.col("l_quantity"), F.col("l_linenumber")
    rows = _stream(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("k"), "l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice", (q / (q + n + 10)).alias("o1"), (n / (q + n + 10)).alias("o2"), (10 / (q + n + 10)).alias("o3"), (F.col("l_tax") * 50).alias("evidence"))
    folder = sinks.new_folder(spark)
    sinks.start(profiles.adaptive_profile(rows, "k", ["l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice"]), folder, "update").awaitTermination()
    return rounded(sinks.latest(spark, folder, ["k"]))


@query(
    "WITH o AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 12 HOUR THEN 0 ELSE 1 END AS new FROM events),\n"
    "s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS nth FROM o)\n"
    "SELECT user_id, min(ts)::TIMESTAMP AS started, (max(ts) + INTERVAL 12 HOUR)::TIMESTAMP AS ended, count(*) AS samples FROM s GROUP BY user_id, nth"
)
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _stream(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    folder = sinks.new_folder(spark)
    sinks.start(profiles.sessions(events, "ts", "user_id", "12 hours", "60 days"), folder, "complete").awaitTermination()
    return sinks.last_batch(spark, folder)
