"""Streams run to completion over a folder: the stream's rows equal those of SQL over the whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonagrid.plans.catalog import query
from sonagrid.plans.inputs import table
from sonagrid.streaming import profiles, sinks


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir.rstrip("/")).withColumn("ts", F.col("ts").cast("timestamp"))


@query("SELECT event_type, to_timestamp((CAST(floor(epoch(ts) / 3600) AS BIGINT) - i) * 3600)::TIMESTAMP AS started, count(*) AS n FROM events, (SELECT unnest([0, 1]) AS i) GROUP BY ALL")
def stream_hopped_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = sinks.new_folder(spark)
    sinks.start(profiles.activity(_events(spark, sf_dir), "ts", "event_type", "2 hours", "1 hour", "60 days"), folder, "complete").awaitTermination()
    return sinks.last_batch(spark, folder)
