"""The tables of a folder in the roles that the operators have names for, in Spark and as SQL.

components: one row a line item. note is the order, comp the compartment (H, I or S, from the return
flag), n the partial's number, amp its amplitude, freq_hz its frequency, include whether it is
validated, status its state, f0_hz the note's fundamental, peak_hz the partial's measured frequency.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    f0 = 50.0 + F.pmod(F.col("l_orderkey"), F.lit(40)) * 10.0
    return rows.select(
        F.col("l_orderkey").alias("note"),
        F.when(F.col("l_returnflag") == "N", "H").when(F.col("l_returnflag") == "A", "I").otherwise("S").alias("comp"),
        F.col("l_linenumber").cast("long").alias("n"),
        (F.col("l_extendedprice") / 99991.0).alias("amp"),
        (F.col("l_quantity") * 100.0).alias("freq_hz"),
        (F.col("l_linestatus") == "F").alias("include"),
        F.when(F.col("l_discount") < 0.03, "confirmed").when(F.col("l_discount") < 0.07, "candidate").otherwise("floor").alias("status"),
        f0.alias("f0_hz"),
        (f0 * F.col("l_linenumber") * (1.0 + (F.col("l_discount") - 0.05) * 0.5)).alias("peak_hz"),
        F.col("l_tax").alias("persistence"),
        F.col("l_partkey").alias("part"),
        F.col("l_suppkey").alias("bin"),
    )


#: Rows of a task that sorts or gathers components by note.
TASK_ROWS = 500_000


def dealt(spark: SparkSession, sf_dir: str, rows: DataFrame) -> DataFrame:
    """Rows of line items dealt by note over tasks whose number grows with the table, not their size.

    Few rows are left to the settings: Spark shuffles them by note where it has to.
    """
    tasks = -(-table(spark, sf_dir, "lineitem").count() // TASK_ROWS)
    return rows.repartition(tasks, "note") if tasks > spark.sparkContext.defaultParallelism else rows


COMPONENTS = """components AS (
  SELECT l_orderkey AS note, CASE l_returnflag WHEN 'N' THEN 'H' WHEN 'A' THEN 'I' ELSE 'S' END AS comp,
    CAST(l_linenumber AS BIGINT) AS n, l_extendedprice / 99991.0 AS amp, l_quantity * 100.0 AS freq_hz,
    l_linestatus = 'F' AS include,
    CASE WHEN l_discount < 0.03 THEN 'confirmed' WHEN l_discount < 0.07 THEN 'candidate' ELSE 'floor' END AS status,
    50.0::DOUBLE + (l_orderkey % 40) * 10.0::DOUBLE AS f0_hz,
    (50.0::DOUBLE + (l_orderkey % 40) * 10.0::DOUBLE) * l_linenumber * (1.0::DOUBLE + (l_discount - 0.05::DOUBLE) * 0.5::DOUBLE) AS peak_hz,
    l_tax AS persistence, l_partkey AS part, l_suppkey AS bin
  FROM lineitem)"""


def spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a bin of 64-bin spectra: note (vec_id), bin, freq_hz, amp, label."""
    rows = table(spark, sf_dir, "embeddings")
    return rows.select(F.col("vec_id").alias("note"), F.col("label").cast("long").alias("label"), F.posexplode("embedding").alias("bin", "x")).select(
        "note", "label", F.col("bin").cast("long").alias("bin"), ((F.col("bin") + 1) * 100.0).alias("freq_hz"), F.abs(F.col("x").cast("double")).alias("amp")
    )


SPECTRUM = """spectrum AS (
  SELECT vec_id AS note, CAST(label AS BIGINT) AS label, CAST(i - 1 AS BIGINT) AS bin, i * 100.0::DOUBLE AS freq_hz, abs(CAST(embedding[i] AS DOUBLE)) AS amp
  FROM (SELECT vec_id, label, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings))"""


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row an order, as a compiled metric table: note, group (nullable), m1 to m4, some missing."""
    rows = table(spark, sf_dir, "orders")
    return rows.select(
        F.col("o_orderkey").alias("note"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("grp"),
        (F.col("o_totalprice") / 1000.0).alias("m1"),
        F.when(F.pmod(F.col("o_custkey"), F.lit(7)) != 0, F.col("o_custkey").cast("double")).alias("m2"),
        F.when(F.pmod(F.col("o_orderkey"), F.lit(5)) != 0, F.sqrt(F.col("o_totalprice"))).alias("m3"),
        F.lit(2.5).cast("double").alias("m4"),
    )


METRICS = """metrics AS (
  SELECT o_orderkey AS note, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS grp, o_totalprice / 1000.0 AS m1,
    CASE WHEN o_custkey % 7 <> 0 THEN CAST(o_custkey AS DOUBLE) END AS m2,
    CASE WHEN o_orderkey % 5 <> 0 THEN sqrt(o_totalprice) END AS m3, CAST(2.5 AS DOUBLE) AS m4
  FROM orders)"""


def with_ctes(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"
