"""Mixing sources to target weights by systematic sampling.

Every step is a DataFrame operation. A source's documents have one expected number
of copies, target / size. The documents are put in a fixed order, the expected copies
are prefix-summed, one random offset is added, and a document is emitted once for each
integer boundary its stretch crosses. The order is by size class, so that the words
taken stay near the target; within a class a salt splits the documents into groups of
bounded size, so a source with a third of all rows is ranked by many tasks.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidepool.llm import store

WORD = "[^\\x20\\x09-\\x0D]+"
#: Seed of the random offset.
SEED = 20240607
#: Groups into which the documents of one source and size class are split.
SALTS = 64
#: Ids are reduced by this prime before they are salted, so that no id overflows.
SPREAD = 1_000_003
#: A source is used at most so many times over.
MOST = 3


def offset(seed: int = SEED) -> float:
    """The random offset in [0, 1) of a seed."""
    return round(random.Random(seed).random(), 6)


def n_words(text: Column) -> Column:
    """Words of a text: white space is squeezed to single bytes and the words counted; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, source: str = "source", size: str = "size") -> DataFrame:
    """(source, source_size, target) of each source.

    Sources by code point, null last, weigh 1, 2, 3, repeating. Target i is
    min(3 * size_i, level * weight_i), where the level makes the targets sum to all
    sizes: the sources that reach their cap are those with the smallest cap per
    weight, so a running sum in that order finds the level without iterating. The
    rows here are one per source.
    """
    per = sizes.groupBy(F.col(source).alias("source")).agg(F.sum(size).alias("source_size"))
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("weight", (F.row_number().over(by_name) - 1) % 3 + 1)
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    per = per.withColumn("cap", MOST * F.col("source_size")).withColumn("total", F.sum("source_size").over(everything))
    by_ratio = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    per = (
        per.withColumn("left", F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("weights", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("level", F.col("left") / F.col("weights"))
    )
    # the first source, in this order, that stays under its cap sets the level of all after it
    free = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source"), F.col("level")))
    per = per.withColumn("at", F.min(free).over(everything)).withColumn("shared", F.col("at.level") * F.col("weight"))
    return per.select("source", "source_size", F.when(F.col("shared") < F.col("cap"), F.col("shared")).otherwise(F.col("cap")).cast("double").alias("target"))


#: Columns that ``mix`` adds.
ADDED = ["size", "source_size", "target", "copies", "taken"]


def mix(docs: DataFrame, seed: int = SEED, salts: int = SALTS, keep: list[str] | None = None, texts: bool = False) -> DataFrame:
    """``keep`` columns of ``docs`` (default: all but clashing ones) with size, source_size, target, copies and taken. ``texts``: some of ``keep`` holds the texts, under another name.

    Null text has size 0 and is never taken; a null source is a source; rows with one
    doc_id are told apart by size and a hash of the text, and equal rows are ranked in any
    order, which gives the same rows. A source without words has target 0. An empty table
    gives an empty result.
    """
    kept = [c for c in docs.columns if c not in ADDED] if keep is None else keep
    # columns go by their place, so no name can clash
    own = docs.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(kept)], F.col("source").alias("of"), F.col("doc_id").alias("id"), n_words(F.col("text")).alias("n"), F.xxhash64("text").alias("tie"))
    # the size class rises with the root of the size, so the widths of classes stay in proportion
    salt = F.pmod(F.pmod(F.coalesce(F.col("id").cast("long"), F.lit(0)), F.lit(SPREAD)) * 7919, F.lit(salts))
    keyed = own.withColumn("class", F.floor(F.sqrt("n"))).withColumn("salt", salt)
    if not texts and "text" not in kept:
        keyed = store.keep(keyed, "sizes")  # small, and texts are read once
    # a null source is told by a flag, so that the rows are ranked and joined by one shuffle
    group = ["named", "nameless", "class", "salt"]
    keyed = keyed.withColumns({"named": F.coalesce(F.col("of").cast("string"), F.lit("")), "nameless": F.col("of").isNull()})
    groups = keyed.groupBy("of", *group).agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("words"))
    running = W.partitionBy("of").orderBy("class", "salt").rowsBetween(W.unboundedPreceding, -1)
    placed = groups.withColumn("before", F.coalesce(F.sum("rows").over(running), F.lit(0)))
    targets = source_targets(groups, "of", "words")
    placed = placed.alias("g").join(targets.alias("t"), F.expr("g.of <=> t.source")).select(*group, "before", "source_size", "target")
    rank = F.row_number().over(W.partitionBy(*group).orderBy("n", "id", "tie"))
    joined = keyed.withColumn("rank", rank).alias("k").join(placed, group)
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    at = F.col("before") + F.col("rank")
    crossed = F.floor(at * each + F.lit(offset(seed))) - F.floor((at - 1) * each + F.lit(offset(seed)))
    copies = F.when(F.col("n") > 0, crossed).otherwise(F.lit(0)).cast("long")
    return joined.select(*[F.col(f"k.c{k}").alias(c) for k, c in enumerate(kept)], F.col("n").alias("size"), "source_size", "target", copies.alias("copies"), (copies * F.col("n")).alias("taken"))


def repeated(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The mixed documents themselves: each row of ``docs`` as often as it is taken, with the columns of ``docs``.

    A null or wordless text is never taken, so its row goes; repeated rows are each taken
    by themselves; an empty table gives an empty result.
    """
    named = docs.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns)], *[F.col(c) for c in ("doc_id", "source", "text")])
    mixed = mix(named, seed, keep=[f"c{k}" for k in range(len(docs.columns))], texts=True)
    some = mixed.where("copies > 0").withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return some.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(docs.columns)])


#: The same for DuckDB, over the table {docs}; {offset}, {salts} and {spread} as above.
SQL = """
WITH sized AS (
  SELECT *, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) END::BIGINT AS size FROM {docs}),
keyed AS (
  SELECT doc_id, text, source, size, floor(sqrt(size))::BIGINT AS class,
         (((coalesce(doc_id, 0)::BIGINT % {spread} + {spread}) % {spread}) * 7919) % {salts} AS salt FROM sized),
per AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight
  FROM keyed GROUP BY source),
capped AS (
  SELECT *, 3 * source_size AS cap, sum(source_size) OVER () AS total,
         sum(3 * source_size) OVER r AS before, sum(weight) OVER () AS weights, sum(weight) OVER r AS weights_before
  FROM per WINDOW r AS (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
levels AS (
  SELECT *, (total - coalesce(before, 0))::DOUBLE / (weights - coalesce(weights_before, 0))::DOUBLE AS level FROM capped),
shared AS (
  SELECT *, first_value(level) OVER (ORDER BY CASE WHEN level * weight <= cap THEN 0 ELSE 1 END, cap / weight, source NULLS LAST) * weight AS share FROM levels),
targets AS (SELECT source, source_size, CASE WHEN share < cap THEN share ELSE cap::DOUBLE END AS target FROM shared),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY class, salt, size, doc_id NULLS FIRST) AS rank FROM keyed),
taken AS (
  SELECT k.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS each
  FROM ranked k JOIN targets t ON k.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CASE WHEN size > 0 THEN floor(rank * each + {offset}) - floor((rank - 1) * each + {offset}) ELSE 0 END::BIGINT * size AS taken
FROM taken
"""


def sql(docs: str = "documents", seed: int = SEED, salts: int = SALTS) -> str:
    return SQL.replace("{docs}", docs).replace("{salts}", str(salts)).replace("{spread}", str(SPREAD)).replace("{offset}", repr(offset(seed)) + "::DOUBLE")
