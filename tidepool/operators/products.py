"""All pairs of two tables' rows of one key, where few keys have many rows on both sides."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: Rows of a key that are packed into one on either side: a cell of the product has about the square of it.
PACK = 512


def packed(df: DataFrame, key: str, name: str, pack: int = PACK) -> DataFrame:
    """(key, ``name``): the other columns of a key's rows as arrays of about ``pack`` structs, dealt by hash."""
    rest = [c for c in df.columns if c != key]
    parts = df.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / pack).alias("_parts"))
    dealt = df.join(parts.hint("merge"), key).withColumn("_part", F.pmod(F.xxhash64(*rest), F.col("_parts")))
    return dealt.groupBy(key, "_part").agg(F.collect_list(F.struct(*rest)).alias(name)).drop("_part")


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt evenly over as many tasks as shuffles have: few rows that become many must not share one for being small."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))


def paired(left: DataFrame, right: DataFrame, key: str, pack: int = PACK) -> DataFrame:
    """(columns of ``left`` without the key, then of ``right``) of every pair of rows with one key; a null key has none.

    Only packs are shuffled, and cells of two packs are dealt over all tasks, so a key whose
    pairs are most of the result costs no task more than others, and pairs are made as they are read.
    Neither side goes through the driver: sizes of files tell little of what is made of them.
    """
    cells = packed(left, key, "_left", pack).join(packed(right, key, "_right", pack).hint("merge"), key).drop(key)
    # Spark holds all rows that one generated loop makes of a row; a lambda keeps the outer generator out of it, so that is the pairs of one row, not those of a cell
    return spread(cells).select(F.inline(F.transform("_left", lambda row: row)), "_right").select(*[F.col(c) for c in left.columns if c != key], F.inline("_right"))
