"""Sinks in a shared folder for streams that restart from their checkpoint.

Every micro-batch is written under its number, in place of what a failed attempt at the same batch
left, so a batch that is done again after a restart counts once.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset a folder of this machine, but only under a ``local`` master."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="sonagrid-stream-")
    return folder.rstrip("/")


def new_folder(spark: SparkSession) -> str:
    """A place in the shared folder that no other stream has."""
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def start(stream: DataFrame, folder: str, mode: str) -> StreamingQuery:
    """Write what there is now, batch by batch, to ``folder``/batches; ``folder``/checkpoint is where a restart goes on."""

    def put(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/batches/batch={batch}")

    return stream.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()


def latest(spark: SparkSession, folder: str, keys: list[str]) -> DataFrame:
    """Of an update stream: each key's row of the newest batch that has it."""
    rows = spark.read.parquet(f"{folder}/batches")
    newest = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("batch")))
    return rows.withColumn("_nth", newest).filter("_nth = 1").drop("_nth", "batch")


def last_batch(spark: SparkSession, folder: str) -> DataFrame:
    """Of a complete stream: the newest batch, which holds everything."""
    rows = spark.read.parquet(f"{folder}/batches")
    return rows.join(F.broadcast(rows.agg(F.max("batch").alias("batch"))), "batch").drop("batch")  # one row
