"""Loaders of stored tables; each reads only what a query selects from it."""

from __future__ import annotations

import fnmatch
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table; zone-less timestamps are instants in UTC."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.withColumns({f.name: F.col(f.name).cast("timestamp") for f in df.schema if f.dataType.typeName() == "timestamp_ntz"})


def catalogue(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A JSON array of records, read under an explicit schema: absent fields are null."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def documents(spark: SparkSession, pattern: str) -> DataFrame:
    """(slug, text) of text files, one row each; the slug is the file name without its ending. Spark's readers pass over files without a byte, so these have no row.

    Of a pattern for the names in one folder the folder is listed once, not each of its files.
    """
    folder, _, names = pattern.rpartition("/")
    if re.fullmatch(r"[\w.:/+=-]*\w", folder, re.ASCII) and re.search(r"[*?\[{]", names) and not names.startswith((".", "_")):
        found = spark.read.option("pathGlobFilter", names).option("recursiveFileLookup", True).text(folder, wholetext=True)
        inside = re.sub(r"^(\w[\w.+-]*:(//[^/]*)?)?/*", "/", folder)
        found = found.where(F.regexp_replace("_metadata.file_path", "/[^/]*$", "").endswith(inside))
    else:
        found = spark.read.text(pattern, wholetext=True)
    return found.select(F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "").alias("slug"), F.col("value").alias("text"))


#: Folders that files are dealt to where there may be millions: what one task lists. Bytes that a task reads before it passes them on.
FOLDERS, READ = 256, 8 << 20


def dealt_documents(spark: SparkSession, folder: str, names: str, folders: int = FOLDERS) -> DataFrame:
    """``documents`` of files that ``put_files`` has dealt to as many folders.

    Spark's readers hold the path of each file on the driver; here a task lists one folder
    after the other and reads what it finds, so the driver knows only the folders' numbers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)

        def told(found: list[tuple[str, bytes]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.binary())], ["slug", "text"])

        for batch in batches:
            for k in batch.column(0).to_pylist():
                found, size = [], 0
                for info in store.get_file_info(fs.FileSelector(f"{root}/{k}", allow_not_found=True)):
                    name = info.base_name
                    if info.type != fs.FileType.File or not info.size or name.startswith((".", "_")) or not fnmatch.fnmatchcase(name, names):
                        continue
                    with store.open_input_stream(info.path) as stream:
                        text = stream.read()
                    found.append((re.sub(r"\.[^.]*$", "", name), text))
                    size += len(text)
                    if size >= READ:
                        yield told(found)
                        found, size = [], 0
                if found:
                    yield told(found)

    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    found = spark.range(0, folders, 1, min(folders, tasks)).mapInArrow(run, "slug string, text binary")
    return found.select("slug", F.col("text").cast("string").alias("text"))


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt evenly over as many tasks as shuffles have."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))


def put_files(files: DataFrame, folder: str, folders: int | None = None) -> None:
    """Write each row (name, text) as a file of its own; a null text is an empty file. A file is written aside and then moved, so a task that runs again puts the same file in its place.

    With ``folders`` the files are dealt by their names to so many folders below ``folder``, for ``dealt_documents``.
    """

    def write(batches):
        made = set()
        for batch in batches:
            store, root = fs.FileSystem.from_uri(folder)
            for name, text, k in zip(batch["name"], batch["text"], batch["k"], strict=True):
                where = root if folders is None else f"{root}/{k}"
                if where not in made:
                    store.create_dir(where, recursive=True)
                    made.add(where)
                aside = f"{where}/.{uuid.uuid4().hex}"
                with store.open_output_stream(aside) as out:
                    out.write((text or "").encode())
                store.move(aside, f"{where}/{name}")
            yield batch[["name"]]

    # to write a file costs more than to move its row, and many small rows may be read by one task
    spread(files.select("name", "text", F.pmod(F.xxhash64("name"), F.lit(folders or 1)).alias("k"))).mapInPandas(write, "name string").write.format("noop").mode("overwrite").save()


def binaries(spark: SparkSession, pattern: str) -> DataFrame:
    """(key, path, bytes, byte_size) of stored objects; the key is the file name."""
    df = spark.read.format("binaryFile").load(pattern)
    return df.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("key"), "path", F.col("content").alias("bytes"), F.col("length").alias("byte_size"))


def query(spark: SparkSession, text: str, **values) -> DataFrame:
    """SQL text with named parameters; values never become part of the text. DataFrames are passed as {name}."""
    frames = {k: v for k, v in values.items() if isinstance(v, DataFrame)}
    return spark.sql(text, args={k: v for k, v in values.items() if k not in frames} or None, **frames)
