"""Joins whose conditions Spark doesn't plan well by itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from tidepool.functions.temporal import plus
from tidepool.sources.generations import Files, own_folder

DAY = 86_400


def overlapping(df: DataFrame, id_: str, key: str, start: str, end: str, bucket: int = DAY) -> DataFrame:
    """(a, b), a < b: pairs of one key whose half-open intervals overlap.

    Intervals are put into every bucket of time that they touch, and meet there; a pair
    is reported in the bucket where the later of the two starts, so no distinct is
    needed. With buckets not shorter than most intervals rows hardly multiply, and no
    key's intervals all meet in one place.
    """
    at = lambda t: F.floor(F.unix_seconds(t) / bucket)
    last = plus(F.col(end), 0)
    rows = df.select(F.col(id_).alias("id"), F.col(key).alias("key"), F.col(start).alias("s"), last.alias("e"), F.explode(F.sequence(at(F.col(start)), at(F.timestamp_micros(F.unix_micros(last) - 1)))).alias("bucket"))
    a, b = rows.alias("a"), rows.alias("b")
    both = a.join(b, F.expr("a.key = b.key AND a.bucket = b.bucket AND a.id < b.id AND a.s < b.e AND b.s < a.e"))
    return both.where(F.col("a.bucket") == at(F.greatest("a.s", "b.s"))).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"))


def within(points: DataFrame, intervals: DataFrame, key: str, at: str, start: str, end: str, bucket: int = DAY) -> DataFrame:
    """Points with the intervals of their key that contain them, half open."""
    slot = lambda t: F.floor(F.unix_seconds(t) / bucket)
    spans = intervals.withColumn("_bucket", F.explode(F.sequence(slot(F.col(start)), slot(F.timestamp_micros(F.unix_micros(F.col(end)) - 1)))))
    joined = points.withColumn("_bucket", slot(F.col(at))).join(spans, [key, "_bucket"])
    return joined.where((F.col(start) <= F.col(at)) & (F.col(at) < F.col(end))).drop("_bucket")


def first_match(left: DataFrame, array: str, right: DataFrame, on: str, id_: str) -> DataFrame:
    """For each row the first element of an array that the right side has: (id, on)."""
    rows = left.select(id_, F.posexplode(array).alias("_pos", on))
    return rows.join(right.select(on).distinct(), on).groupBy(id_).agg(F.min_by(on, "_pos").alias(on))


def nested(parents: DataFrame, children: DataFrame, key: str, order: list[str], columns: list[str], name: str) -> DataFrame:
    """Parents with an ordered array of their children; a parent without any has an empty one."""
    item = F.struct(*order, *[c for c in columns if c not in order])
    grouped = children.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias(name))
    return parents.join(grouped, key, "left").withColumn(name, F.coalesce(name, F.array().cast(grouped.schema[name].dataType)))


def clusters(df: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Rows with ``cluster``, the start of the first of the overlapping half-open intervals of their key that they hang together with.

    A scan in two levels: within each day of a key, and over the days of a key, so a key with
    many rows is as many tasks' work as it has days.
    """
    rows = df.withColumn("_day", F.floor(F.unix_seconds(start) / DAY))
    days_before = W.partitionBy(key).orderBy("_day").rowsBetween(W.unboundedPreceding, -1)
    in_day = W.partitionBy(key, "_day").orderBy(start)
    reach = rows.groupBy(key, "_day").agg(F.max(end).alias("_top")).withColumn("_before", F.max("_top").over(days_before)).drop("_top")
    so_far = F.greatest("_before", F.max(end).over(in_day.rowsBetween(W.unboundedPreceding, -1)))
    marked = rows.join(reach, [key, "_day"]).withColumn("_begins", F.when(so_far.isNull() | (so_far <= F.col(start)), F.col(start)))
    carried = marked.groupBy(key, "_day").agg(F.max("_begins").alias("_last")).withColumn("_carried", F.max("_last").over(days_before)).drop("_last")
    begun = F.max("_begins").over(in_day.rowsBetween(W.unboundedPreceding, W.currentRow))
    return marked.join(carried, [key, "_day"]).withColumn("cluster", F.coalesce(begun, "_carried")).drop("_day", "_before", "_begins", "_carried")


def components(edges: DataFrame, key: str) -> DataFrame:
    """(key, node, component) of all nodes of edges (key, a, b): the smallest node that each hangs together with, within its key.

    Each round takes the smallest name among neighbours, then the name of that name's node, so
    a chain needs as many rounds as its length has binary digits. A round's names are written
    to the shared folder; the driver sees only whether any changed.
    """
    spark, folder = edges.sparkSession, own_folder(edges.sparkSession)
    files = Files(spark, folder)
    edges.select(key, "a", "b").unionByName(edges.select(key, F.col("b").alias("a"), F.col("a").alias("b"))).distinct().write.parquet(f"{folder}/edges")
    both = spark.read.parquet(f"{folder}/edges")
    both.select(key, F.col("a").alias("node")).distinct().withColumn("component", F.col("node")).write.parquet(f"{folder}/names-0")
    number, changed = 0, not both.isEmpty()
    while changed:
        names = spark.read.parquet(f"{folder}/names-{number}")
        near = both.join(names.withColumnRenamed("node", "b"), [key, "b"]).groupBy(key, "a").agg(F.min("component").alias("_near")).withColumnRenamed("a", "node")
        met = names.join(near, [key, "node"]).select(key, "node", F.col("component").alias("_old"), F.least("component", "_near").alias("_met"))
        jump = names.select(key, F.col("node").alias("_met"), F.col("component").alias("_further"))
        met.join(jump, [key, "_met"]).select(key, "node", F.least("_met", "_further").alias("component"), "_old").write.parquet(f"{folder}/names-{number + 1}")
        changed = not spark.read.parquet(f"{folder}/names-{number + 1}").where("component <> _old").isEmpty()
        files.delete(f"names-{number}")
        number += 1
    return spark.read.parquet(f"{folder}/names-{number}").select(key, "node", "component")
