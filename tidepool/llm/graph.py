"""Groups of linked ids: connected components, and links found in buckets without forming all pairs of a bucket."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidepool.llm import store

#: A bucket of so many ids has all its pairs formed at once; a larger one begins with one id against all others.
SMALL = 8
#: Pairs of a larger bucket that a round forms beyond its quota of 1, 8, 64 ... ids.
FEW = 256


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(id, component) of every id in ``links`` (a, b); the component is its smallest id.

    Large-star and small-star steps in turn (Kiveris and others, 2014): every step hangs
    neighbours on the smallest id seen, rows never exceed the links, and a few rounds
    bring every id to its smallest one. Each round is a written table.
    """
    edges = store.keep(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    while not _are_stars(edges):
        both = edges.union(edges.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.join(least.select("u", F.least("u", "m").alias("m")), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(small, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").union(small.select("u", "m")).distinct()
        before, edges = edges, store.keep(hung, name)
        del both, least, large, small, hung
        store.discard(before)
    found = edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return found.union(found.select("component", "component").distinct())


def _are_stars(edges: DataFrame) -> bool:
    """Whether every a (> b) has one b, and no b is an a."""
    ends = edges.select(F.col("a").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("b", F.lit(0), F.lit(1)))
    off = ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR (up = 1 AND down = 1)")
    return not off.limit(1).count()


def grouped(members: DataFrame, verify: Callable[[DataFrame], DataFrame], name: str = "grouped", compatible: str = "true", carry: list[str] | None = None) -> DataFrame:
    """(id, component) of the ids in ``members``, by all pairs of ids that share a bucket and that ``verify`` confirms.

    members: (key, id, score, size), each key and id once, score and size being those of the
    id. verify takes
    distinct pairs (a, b, ...), a < b, and returns the rows of those that hold; pairs whose
    sizes don't satisfy ``compatible`` (SQL over size_a and size_b, and over further columns
    of members that ``carry`` names) can't hold. The result
    is that of verifying every pair of every bucket, but pairs are formed in rounds. First
    each bucket's id of the highest score meets every other: in a bucket of copies of one
    thing, that thing, which shares most with the others, links all; in buckets of up to
    SMALL ids all meet. Only larger buckets that still span several components go on:
    there, ids outside the largest component meet those of other components, all at once
    where that is few pairs, else as many ids as the round allows. So a bucket of mutual
    copies costs as many pairs as it has members, and only a large bucket of strangers
    costs more, in rounds. From round to round components are carried on: a round's links
    join components, not ids.
    """
    in_bucket = W.partitionBy("key")
    carry = ["size", *(carry or [])]
    ranked = members.withColumn("rank", F.row_number().over(in_bucket.orderBy(F.desc("score"), "id"))).withColumn("n", F.count(F.lit(1)).over(in_bucket))
    ranked = store.keep(ranked.where("n > 1").drop("score"), f"{name}-members")

    def pairs_of(turn: DataFrame, others: DataFrame, unless: str, *more: str) -> DataFrame:
        both = turn.join(others, "key").where(f"NOT ({unless})").where(compatible)
        return both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), *more).distinct()

    def side(df: DataFrame, letter: str, as_: str, *more: Column) -> DataFrame:
        return df.select("key", F.col("id").alias(letter), *[F.col(c).alias(f"{c}_{as_}") for c in carry], *more)

    turn = side(ranked.where(f"rank = 1 OR n <= {SMALL}"), "x", "a", F.col("rank").alias("rank_x"))
    others = side(ranked, "y", "b", F.col("rank").alias("rank_y"))
    links = store.keep(verify(pairs_of(turn, others, "rank_x >= rank_y")), f"{name}-links")
    joined = components(links, name)
    ids = ranked.select("id").distinct()
    found = store.keep(ids.join(joined, "id", "left").select("id", F.coalesce("component", "id").alias("component")), f"{name}-found")
    # the first of a large bucket has met all others
    left = ranked.where(f"n > {SMALL} AND rank > 1").join(found, "id")
    quota = 1
    del turn, others, joined, ids
    store.discard(links)
    while True:
        sizes = left.groupBy("key", "component").agg(F.count(F.lit(1)).alias("m"))
        split = sizes.groupBy("key").agg(F.max(F.struct("m", "component")).alias("most"), F.count(F.lit(1)).alias("kinds")).where("kinds > 1").select("key", F.col("most.component").alias("largest"))
        open_ = store.keep(left.join(split, "key").withColumn("rest", F.col("component") != F.col("largest")).drop("largest"), f"{name}-open")
        mine = F.row_number().over(W.partitionBy("key").orderBy("rank"))
        some = open_.where("rest").withColumn("turn", mine)
        turn = store.keep(side(some.where(f"turn <= {quota} OR turn * n <= {FEW}"), "x", "a", F.col("component").alias("of_x"), F.col("turn")), f"{name}-turn")
        if not turn.limit(1).count():
            store.discard(open_, turn)
            return found
        # an id of the turn meets all of other components but those whose turn was before its own
        theirs = open_.join(turn.select("key", F.col("x").alias("id"), F.col("turn").alias("turn_y")), ["key", "id"], "left")
        others = side(theirs, "y", "b", F.col("component").alias("of_y"), F.coalesce("turn_y", F.lit(1 << 30)).alias("turn_y"))
        pairs = pairs_of(turn, others, "of_x = of_y OR turn >= turn_y", F.least("of_x", "of_y").alias("one"), F.greatest("of_x", "of_y").alias("two"))
        new = store.keep(verify(pairs).select(F.col("one").alias("a"), F.col("two").alias("b")).distinct(), f"{name}-links")
        merged = store.keep(components(new, name).toDF("component", "into"), f"{name}-merged")

        def carried(df: DataFrame, merged: DataFrame = merged) -> DataFrame:
            return df.join(merged, "component", "left").withColumn("component", F.coalesce("into", "component")).drop("into")

        after = store.keep(carried(found).select("id", "component"), f"{name}-found")
        rest = store.keep(carried(theirs.where("turn_y IS NULL").drop("turn_y", "rest")), f"{name}-left")
        gone, found, left = (found, open_, turn, new, merged, left), after, rest
        del theirs, others, pairs, some, open_, turn, new, merged, carried, rest
        store.discard(*gone)
        quota *= 8
