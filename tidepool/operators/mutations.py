"""Changes of stored tables as functions from a snapshot to the next one.

Every function takes and returns DataFrames; writing one is a single job that either
replaces the snapshot or leaves it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def _same(keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"t.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys])


def append(target: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(next snapshot, rows inserted)."""
    return target.unionByName(rows, allowMissingColumns=True), rows


def insert_ignore(target: DataFrame, rows: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows whose key is new, the first of each key; (next snapshot, rows inserted)."""
    new = rows.dropDuplicates(keys).join(target.select(*keys), keys, "left_anti").select(*rows.columns)
    return target.unionByName(new, allowMissingColumns=True), new


def upsert(target: DataFrame, rows: DataFrame, keys: list[str], keep: list[str] = (), choose: dict[str, Column] | None = None) -> DataFrame:
    """The snapshot with rows inserted, or laid over those of their key. Columns in ``keep`` stay those of the old row; ``choose`` gives a column as an expression over s.(new) and t.(old) columns."""
    choose = choose or {}
    both = target.alias("t").join(rows.withColumn("_new", F.lit(True)).alias("s"), _same(keys), "full")
    cols = []
    for c in target.columns:
        new, old = (F.col(f"s.{c}") if c in rows.columns else F.lit(None)), F.col(f"t.{c}")
        if c in choose:
            value = F.when(F.col("s._new").isNotNull(), choose[c]).otherwise(old)
        elif c in keys:
            value = F.coalesce(new, old)
        elif c in keep or c not in rows.columns:
            value = F.coalesce(old, new)
        else:
            value = F.when(F.col("s._new").isNotNull(), new).otherwise(old)
        cols.append(value.alias(c))
    return both.select(*cols)


def update(target: DataFrame, where: Column, **values: Column) -> DataFrame:
    return target.withColumns({c: F.when(where, v).otherwise(F.col(c)) for c, v in values.items()})


def patch(target: DataFrame, rows: DataFrame, key: str, columns: list[str], present: bool = False) -> DataFrame:
    """The snapshot with columns of rows laid over it by key. A null leaves the old value; with ``present`` a column <c>_present says whether the new value counts, null or not."""
    renamed = rows.select(key, *[F.col(c).alias(f"_n_{c}") for c in columns], *([F.col(f"{c}_present").alias(f"_p_{c}") for c in columns] if present else []))
    joined = target.join(renamed, key, "left")
    new = {c: F.when(F.coalesce(f"_p_{c}", F.lit(False)), F.col(f"_n_{c}")).otherwise(F.col(c)) if present else F.coalesce(f"_n_{c}", c) for c in columns}
    return joined.withColumns(new).select(*target.columns)


def delete(target: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    return target.join(rows.select(*keys), keys, "left_anti").select(*target.columns)


def delete_where(target: DataFrame, where: Column) -> DataFrame:
    return target.where(~F.coalesce(where, F.lit(False)))


def insert_capped(target: DataFrame, rows: DataFrame, owner: str, order: str, cap: int) -> DataFrame:
    """The snapshot with as many rows of each owner as stay under its cap, in order."""
    have = target.groupBy(owner).agg(F.count(F.lit(1)).alias("_have"))
    place = F.row_number().over(W.partitionBy(owner).orderBy(order))
    new = rows.withColumn("_place", place).join(have, owner, "left").where(F.col("_place") <= cap - F.coalesce("_have", F.lit(0)))
    return target.unionByName(new.select(*rows.columns), allowMissingColumns=True)


def insert_next_ordinal(target: DataFrame, rows: DataFrame, parent: str, ordinal: str, order: str) -> DataFrame:
    """The snapshot with rows added behind the last of their parent; ordinals begin at 0."""
    last = target.groupBy(parent).agg(F.max(ordinal).alias("_last"))
    place = F.row_number().over(W.partitionBy(parent).orderBy(order))
    new = rows.withColumn("_place", place).join(last, parent, "left").withColumn(ordinal, (F.coalesce(F.col("_last") + 1, F.lit(0)) + F.col("_place") - 1).cast(target.schema[ordinal].dataType))
    return target.unionByName(new.select(*[c for c in target.columns if c in new.columns]), allowMissingColumns=True)


def numbered(target: DataFrame, rows: DataFrame, id_: str, order: str) -> DataFrame:
    """``rows`` with the ids after the snapshot's largest. Places are counted in groups of rows, so no task ranks them all."""
    top = target.agg(F.coalesce(F.max(id_), F.lit(0)).alias("_top"))
    group = F.pmod(F.xxhash64(order), F.lit(64))
    grouped = rows.withColumn("_group", group)
    sizes = grouped.groupBy("_group").agg(F.count(F.lit(1)).alias("_n"))
    starts = sizes.withColumn("_before", F.sum("_n").over(W.orderBy("_group")) - F.col("_n")).drop("_n")  # 64 rows
    placed = grouped.withColumn("_place", F.row_number().over(W.partitionBy("_group").orderBy(order))).join(F.broadcast(starts), "_group")
    new = placed.crossJoin(F.broadcast(top)).withColumn(id_, F.col("_top") + F.col("_before") + F.col("_place"))  # one row
    return new.select(*[c for c in rows.columns if c != id_], id_)


def append_next_id(target: DataFrame, rows: DataFrame, id_: str, order: str) -> DataFrame:
    """The snapshot with rows under the ids after its largest."""
    new = numbered(target, rows, id_, order)
    return target.unionByName(new.select(*[c for c in target.columns if c in new.columns]), allowMissingColumns=True)


def cascade(children: DataFrame, parents: DataFrame, key: str, parent_key: str) -> DataFrame:
    """Children whose parent is still there."""
    return children.join(parents.select(F.col(parent_key).alias(key)), key, "left_semi").select(*children.columns)


def set_null(children: DataFrame, parents: DataFrame, key: str, parent_key: str) -> DataFrame:
    """Children, their reference nulled where the parent is gone."""
    there = parents.select(F.col(parent_key).alias(key)).distinct().withColumn("_there", F.lit(True))
    return children.join(there, key, "left").withColumn(key, F.when(F.col("_there"), F.col(key))).select(*children.columns)


def all_or_nothing(target: DataFrame, rows: DataFrame, valid: Column) -> DataFrame:
    """The snapshot with all rows, or as it is if one of them isn't valid."""
    good = rows.agg(F.coalesce(F.bool_and(valid), F.lit(True)).alias("_ok"))
    return target.unionByName(rows.crossJoin(F.broadcast(good)).where("_ok").drop("_ok"), allowMissingColumns=True)  # one row


def unapplied(files: DataFrame, applied: DataFrame) -> DataFrame:
    """(place, version) of migrations that haven't been applied, in the order of their names; files and applied are registries, a row for each migration."""
    every = files.select("version", (F.row_number().over(W.orderBy("version")) - 1).cast("long").alias("place"))
    return every.join(applied.select("version"), "version", "left_anti").select("place", "version")
