"""Numbered generations of a result in a shared folder.

A generation's data is written first, under a name of its own; then a manifest with its
number is put in place, once, and only what has a manifest counts. So a writer that dies
leaves nothing that is read, a generation that is written again changes nothing, and of
two writers of one number exactly one wins. Readers and writers of any session, now or
after a restart, see the same generations, because there is no other state than the folder.
"""

from __future__ import annotations

import json
import os
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tidepool-stream-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def own_folder(spark: SparkSession) -> str:
    """A new folder for one stream or one call."""
    return f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """The rows of ``df``, computed now and once: written to a new folder among the shared ones, which nobody deletes."""
    where = f"{shared_dir(df.sparkSession)}/kept-{uuid.uuid4().hex}"
    df.write.parquet(where)
    return df.sparkSession.read.schema(df.schema).parquet(where)


class Files:
    """Small files of a folder that the whole cluster shares."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _at(self, name: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return where, where.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def names(self) -> list[str]:
        """Names in order, without those of files that are being written."""
        where, fs = self._at("")
        if not fs.exists(where):
            return []
        return sorted(name for s in fs.listStatus(where) if not (name := s.getPath().getName()).startswith((".", "_")))

    def read(self, name: str) -> str:
        where, fs = self._at(name)
        stream = fs.open(where)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def delete(self, name: str) -> None:
        where, fs = self._at(name)
        fs.delete(where, True)

    def put_once(self, name: str, text: str) -> bool:
        """Put a whole file in place unless there is one of that name; True for the one writer that did."""
        target, fs = self._at(name)
        if fs.exists(target):
            return False
        own, _ = self._at(f".{uuid.uuid4().hex}")
        stream = fs.create(own, False)
        stream.write(text.encode())
        stream.close()
        try:
            if fs.getUri().getScheme() == "file":  # a rename would replace there
                os.link(own.toUri().getPath(), target.toUri().getPath())
            else:
                hadoop = self.spark._jvm.org.apache.hadoop.fs
                keep = self.spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 0)
                hadoop.FileContext.getFileContext(target.toUri(), self.spark._jsc.hadoopConfiguration()).rename(own, target, keep)
            return True
        except FileExistsError:
            return False
        except Py4JJavaError as error:
            if "FileAlreadyExists" not in error.java_exception.getClass().getName():
                raise
            return False
        finally:
            fs.delete(own, False)


class Generations:
    """Generations of one result; the one of the largest number is the current one.

    ``schema``: rows are JSON lines, read under it; else they are Parquet.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: StructType | str | None = None):
        self.spark, self.folder, self.schema = spark, folder.rstrip("/"), schema
        self._manifests = Files(spark, f"{self.folder}/committed")
        self._data = Files(spark, f"{self.folder}/data")

    def numbers(self) -> list[int]:
        return [int(name) for name in self._manifests.names()]

    def newest(self, below: int | None = None) -> int | None:
        """The largest committed number, or the largest below another."""
        return max((n for n in self.numbers() if below is None or n < below), default=None)

    def stage(self) -> str:
        """A new folder for a generation's data."""
        return f"{self.folder}/data/{uuid.uuid4().hex}"

    def publish(self, number: int, staged: str, **notes) -> bool:
        """Make staged data the generation of that number; False, and the data goes, if that number or a later one counts already."""
        newest = self.newest()
        fresh = newest is None or number > newest
        if fresh and self._manifests.put_once(f"{number:020d}", json.dumps({"data": staged.rpartition("/")[2], **notes})):
            return True
        self._data.delete(staged.rpartition("/")[2])
        return False

    def commit(self, number: int, df: DataFrame, **notes) -> bool:
        """Write a generation and make it count; a stale number is refused."""
        staged = self.stage()
        df.write.parquet(staged) if self.schema is None else df.write.json(staged)
        return self.publish(number, staged, **notes)

    def notes(self, number: int) -> dict:
        return json.loads(self._manifests.read(f"{number:020d}"))

    def where(self, number: int) -> str:
        """The folder of a committed generation's data."""
        return f"{self.folder}/data/{self.notes(number)['data']}"

    def read(self, number: int | None = None) -> DataFrame | None:
        """A generation's rows, of the current one if no number is given; None before the first."""
        number = self.newest() if number is None else number
        if number is None:
            return None
        return self.spark.read.parquet(self.where(number)) if self.schema is None else self.spark.read.schema(self.schema).json(self.where(number))

    def drop(self, *numbers: int) -> None:
        """Forget generations: first they stop counting, then their data goes."""
        for number in numbers:
            data = self.notes(number)["data"]
            self._manifests.delete(f"{number:020d}")
            self._data.delete(data)


class Versioned:
    """A stored object that writers replace by compare-and-set of its version."""

    def __init__(self, spark: SparkSession, folder: str, schema: StructType | str | None = None):
        self._of = Generations(spark, folder, schema)

    def read(self) -> tuple[DataFrame | None, int]:
        """(rows, token): the token is what a writer gives back."""
        token = self._of.newest()
        return (None, 0) if token is None else (self._of.read(token), token)

    def replace(self, df: DataFrame, token: int) -> int | None:
        """The new version's token, or None if the object isn't at ``token`` any more: then nothing changes."""
        if (self._of.newest() or 0) != token:
            return None
        return token + 1 if self._of.commit(token + 1, df) else None
