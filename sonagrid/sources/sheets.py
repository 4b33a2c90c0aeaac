"""Named tables (the sheets of a workbook), manifests, key/value metadata, reports."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonagrid.operators.relational import merge_coalesce, merge_keys, require_unique

MANIFEST = "file_path string, instrument string, instrument_family string, technique string, written_pitch string, sounding_pitch string, dynamic string, register string, source string, notes string"


def write_sheets(sheets: dict[str, DataFrame], folder: str, mode: str = "error") -> None:
    """One Parquet table a sheet."""
    for name, rows in sheets.items():
        rows.write.mode(mode).parquet(f"{folder.rstrip('/')}/{name}")


def read_sheet(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}")


def list_sheets(spark: SparkSession, folder: str) -> list[str]:
    """Names of the tables in a folder, by whatever file system holds it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    return sorted(f.getPath().getName() for f in files if f.isDirectory() and not f.getPath().getName().startswith(("_", ".")))


def merged_sheets(spark: SparkSession, folder: str, base: str, satellites: list[str], exact: str, fallback: str) -> DataFrame:
    """The base sheet with its satellites merged on, each by the best key that both have; base rows stay as many."""
    rows = read_sheet(spark, folder, base)
    have = list_sheets(spark, folder)
    for name in satellites:
        if name in have:
            other = read_sheet(spark, folder, name)
            keys = merge_keys(rows, other, exact, fallback)
            rows = merge_coalesce(rows, require_unique(other, keys), keys)
    return rows


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A corpus manifest from CSV (with a header) or JSON lines; missing columns are null."""
    if path.endswith((".json", ".jsonl")):
        return spark.read.schema(MANIFEST).json(path)
    return spark.read.schema(MANIFEST).csv(path, header=True, enforceSchema=False)


def manifest_problems(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Entries without a path, repeated ones, and those whose file isn't in ``files`` (path)."""
    blank = manifest.filter(F.col("file_path").isNull() | (F.trim("file_path") == "")).select(F.lit(None).cast("string").alias("file_path"), F.lit("blank_path").alias("problem"))
    named = manifest.filter(F.trim("file_path") != "")
    repeated = named.groupBy("file_path").count().filter("count > 1").select("file_path", F.lit("duplicate").alias("problem"))
    missing = named.join(files.select(F.col("path").alias("file_path")), "file_path", "left_anti").select("file_path", F.lit("missing_file").alias("problem")).distinct()
    return blank.unionByName(repeated).unionByName(missing)


def metadata_map(pairs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Key/value rows as one map per group; of repeated keys the first value in order stays."""
    first = pairs.groupBy(*(keys or []), "key").agg(F.min("value").alias("value"))
    return first.groupBy(*(keys or [])).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("metadata"))


def lookup_table(spark: SparkSession, path: str) -> DataFrame:
    """Two numeric columns from a CSV with comment lines."""
    return spark.read.schema("x double, y double").csv(path, comment="#", header=True)


def write_report(tables: dict[str, DataFrame], folder: str, form: str = "csv") -> None:
    """Small report tables as CSV or JSON, one folder each."""
    for name, rows in tables.items():
        writer = rows.coalesce(1).write.mode("overwrite")
        (writer.option("header", True).csv if form == "csv" else writer.json)(f"{folder.rstrip('/')}/{name}")


def write_run_manifest(spark: SparkSession, folder: str, payload: dict) -> None:
    """A run's settings as one JSON row."""
    spark.createDataFrame([(json.dumps(payload, sort_keys=True, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder.rstrip('/')}/run_manifest")
