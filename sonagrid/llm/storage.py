"""Tables in the shared folder that the cluster names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

#: Bytes of the Arrow batches of :func:`bound_batches`, about.
BATCH_BYTES = 1 << 20
_path_of: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
_table_of: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
_open: list[Scratch] = []


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``.

    Where it is unset a folder of our own is made, but only if all tasks run on this machine
    (a ``local`` master); on a cluster the executors would not see it, so that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="sonagrid-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def bound_batches(spark: SparkSession) -> None:
    """From here on the session hands rows to Python in batches of ``BATCH_BYTES``, unless it has a bound of its own.

    Else a batch has 10,000 rows, which of whole texts are some 20 MB, held several times by a JVM and its worker.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(BATCH_BYTES))


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again.

    This cuts the lineage: whatever reads the result reads files that every executor sees,
    so a lost executor costs only its running tasks. The innermost :func:`scratch` owns the table.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _path_of[out] = path
    if _open:
        _open[-1].tables.append(out)
    return out


def bucketed(df: DataFrame, name: str, buckets: int, column: str) -> DataFrame:
    """Like :func:`written`, but a table bucketed by a column: what joins or groups by it need not shuffle the table."""
    spark = df.sparkSession
    path, table = new_path(spark, name), f"{name}_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, column).option("path", path).format("parquet").saveAsTable(table)
    out = spark.table(table)
    _path_of[out], _table_of[out] = path, table
    if _open:
        _open[-1].tables.append(out)
    return out


def delete(df: DataFrame) -> None:
    """Remove the files of a table made by :func:`written` or :func:`bucketed` that no later plan reads; others stay."""
    place, table = _path_of.pop(df, None), _table_of.pop(df, None)
    if table:
        df.sparkSession.sql(f"DROP TABLE IF EXISTS {table}")
    if place:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(place)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


class Scratch:
    """Tables that go when their :func:`scratch` ends."""

    def __init__(self) -> None:
        self.tables: list[DataFrame] = []

    def keep(self, *tables: DataFrame) -> None:
        """These outlive the scratch; the one around it, if any, owns them from here on."""
        for df in tables:
            self.tables = [x for x in self.tables if x is not df]
            if len(_open) > 1:
                _open[-2].tables.append(df)


@contextmanager
def scratch() -> Iterator[Scratch]:
    """Delete what :func:`written` wrote within the block, but for tables that are kept."""
    own = Scratch()
    _open.append(own)
    try:
        yield own
    finally:
        _open.pop()
        for df in own.tables:
            delete(df)
