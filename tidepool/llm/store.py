"""Tables written to the folder that the whole cluster shares.

A lineage is cut by writing a table below ``spark.checkpoint.dir``: every executor can
read it again, so a lost executor costs its own tasks and nothing else. Tables written
inside ``scratch()`` belong to it and are deleted with it; all others stay until their
writer deletes them, as lazy results may still read them.
"""

from __future__ import annotations

import contextlib
import gc
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


class Scratch:
    """Folders and catalogue tables that one call wrote for itself."""

    def __init__(self) -> None:
        self.folders: list[str] = []
        self.tables: list[str] = []

    def release(self, spark: SparkSession) -> None:
        """Delete them; call it once the results built on them are stored."""
        while self.folders:
            _delete(spark, self.folders.pop())
        while self.tables:
            spark.sql(f"DROP TABLE IF EXISTS {self.tables.pop()}")


#: The scratch of the innermost ``scratch()``; what is written outside of any is nobody's.
_OPEN: list[Scratch] = []


@contextlib.contextmanager
def scratch() -> Iterator[Scratch]:
    """Collects what is written inside, for a later ``release``; nothing else is ever deleted by it."""
    _OPEN.append(Scratch())
    try:
        yield _OPEN[-1]
    finally:
        _OPEN.pop()


def _delete(spark: SparkSession, folder: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; where none is set, a temporary folder in local mode and an error on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tidepool-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return the table that was written."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidepool/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if _OPEN:
        _OPEN[-1].folders.append(path)
    kept = spark.read.schema(df.schema).parquet(path)
    kept._tidepool_folder = path
    return kept


def discard(*kept: DataFrame) -> None:
    """Delete tables of ``keep`` that nothing reads any more, and let go of finished shuffles."""
    spark = kept[0].sparkSession
    for df in kept:
        folder = df.__dict__.pop("_tidepool_folder", None)
        if folder:
            _delete(spark, folder)
            for own in _OPEN:
                if folder in own.folders:
                    own.folders.remove(folder)
    collect(spark)


def collect(spark: SparkSession) -> None:
    """Spark's cleaner removes the files of a shuffle when the driver's garbage collector finds its plan gone; a job of many short steps would otherwise leave them all to its end."""
    gc.collect()
    spark._jvm.System.gc()


def keep_bucketed(df: DataFrame, name: str, buckets: int, key: str) -> DataFrame:
    """The same as a table in the warehouse, bucketed by ``key``; for columns that are compressed already."""
    table = f"tidepool_{name}_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, key).option("compression", "none").saveAsTable(table)
    if _OPEN:
        _OPEN[-1].tables.append(table)
    return df.sparkSession.table(table)
