"""Near-duplicate documents by bottom-k sketches of one hash function.

A document's set is its distinct five-word shingles, hashed once to 63 bits; its sketch
is the K smallest hashes. Two sets of similarity 0.75 or more share at least SHARED of
the values in their sketches, up to a chance below 1e-8 for sets larger than a sketch,
and surely for smaller ones. So the SHARED - 1 most widespread values of each sketch are
left out of the inverted lists: a passage that is common to many documents makes no
candidates. Documents of a list are paired in rounds. A pair is formed only if enough bits
of both agree, each bit being one of the smallest of the whole set's hashes under a function
of its own: sets that merely share a passage make no row. Exact set similarity decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidepool.llm import graph, store, textarrays as ta

SHINGLE = 5
#: Values in a sketch.
K = 64
#: Values that sketches of similar sets share at least: for sets larger than a sketch, and the most for smaller ones.
SHARED, SHARED_SMALL = 24, 43
#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Bits of a set, and those in which a pair may differ: a bit differs with chance (1 - similarity) / 2, so more differ in a similar pair with a chance below 1e-8.
BITS, DIFFER = 512, 109
#: Ids of candidates that are broadcast at most; beyond it they are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def _sets(buf: np.ndarray, off: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """(sorted distinct shingle hashes of each document, hash of each document's sequence of words)."""
    n = len(off) - 1
    low = ta.LOWER[buf]
    start, end, doc = ta.words(low, off)
    h = ta.span_hash(ta.prefix_hash(low), start, end)
    count = ta.counts(doc, n)
    first = np.concatenate([[0], np.cumsum(count)])
    running = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(ta.mix(h) * ta._powers(len(h))[0][: len(h)], out=running[1:])
    node = (ta.span_hash(running, first[:-1], first[1:]) >> np.uint64(1)).astype(np.int64)
    got, owner = ta.shingles(h, doc, n, SHINGLE)
    got = (got >> np.uint64(1)).astype(np.int64)
    at = np.searchsorted(owner, np.arange(n + 1))
    return [np.unique(got[at[k] : at[k + 1]]) for k in range(n)], node


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    off = np.concatenate([[0], np.cumsum([len(x) for x in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(off), pa.array(np.concatenate([*arrays, np.zeros(0, np.int64)])))


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, own, n_shingles, node, sketch), own being a hash of the text; documents of one sequence of words have one node, a hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, buf, off in ta.slices(batch):
                sets, node = _sets(buf, off)
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(2), pa.array([len(x) for x in sets], pa.int64()), pa.array(node), _lists([x[:K] for x in sets])], ["doc_id", "own", "n_shingles", "node", "sketch"])

    return docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text")).mapInArrow(run, "doc_id long, own long, n_shingles long, node long, sketch array<long>")


#: Factors of the functions whose smallest values give the bits.
_FACTORS = np.random.default_rng(75).integers(0, 1 << 32, BITS, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_WORDS = [f"w{k}" for k in range(BITS // 64)]


def minhash_bits(sets: list[np.ndarray]) -> np.ndarray:
    """BITS bits of each set as 64-bit integers, a row for each: of the smallest product of its hashes and a factor, one mixed bit. An empty set has none."""
    out = np.zeros((len(sets), BITS), bool)
    size = np.array([len(x) for x in sets], np.int64)
    some = np.flatnonzero(size)
    if len(some):
        begin = np.cumsum(size[some]) - size[some]
        h = np.concatenate([sets[k] for k in some]).astype(np.uint64)
        h = ta.mix(h).astype(np.uint32)
        for k, factor in enumerate(_FACTORS):
            least = np.minimum.reduceat(h * factor, begin)
            out[some, k] = ((least ^ (least >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(31)
    return np.packbits(out, axis=1).view(np.int64)


def full_sets(docs: DataFrame) -> DataFrame:
    """(node, set, w0, w1, ...): whole sets, sorted, and their bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, buf, off in ta.slices(batch, limit=1 << 20):
                sets, node = _sets(buf, off)
                bits = minhash_bits(sets)
                yield pa.RecordBatch.from_arrays([pa.array(node), _lists(sets), *[pa.array(np.ascontiguousarray(bits[:, k])) for k in range(len(_WORDS))]], ["node", "set", *_WORDS])

    return docs.select("text").mapInArrow(run, "node long, set array<long>, " + ", ".join(f"{w} long" for w in _WORDS))


def candidates(classes: DataFrame) -> DataFrame:
    """(key, id, score, size): the inverted lists; classes: (node, n_shingles, sketch), a row for each node.

    The score is the number of values of the sketch that other sketches have too: highest
    for a text from which others were made.
    """
    posts = classes.select("node", "n_shingles", F.explode("sketch").alias("value"))
    spread = posts.groupBy("value").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    shared = posts.join(spread, "value")
    # at most K values of a node meet here
    per_node = shared.groupBy("node").agg(F.first("n_shingles").alias("n"), F.collect_list(F.struct("df", "value")).alias("all"))
    small = F.least(F.ceil(F.col("n") * F.lit(PERCENT) / 100), F.lit(SHARED_SMALL))
    dropped = F.when(F.col("n") > K, F.lit(SHARED)).otherwise(small).cast("int") - 1
    posted = F.slice(F.sort_array("all", asc=False), dropped + 1, F.lit(K))
    return per_node.where(F.size("all") > dropped).select(F.explode(posted.getField("value")).alias("key"), F.col("node").alias("id"), F.size("all").alias("score"), F.col("n").alias("size"))


def similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The rows of ``pairs`` (a, b, ...) whose whole ``sets`` are similar."""
    one = sets.select(F.col("node").alias("a"), F.col("set").alias("of_a"))
    two = sets.select(F.col("node").alias("b"), F.col("set").alias("of_b"))
    checked = pairs.join(one, "a").join(two, "b").withColumn("common", F.size(F.array_intersect("of_a", "of_b")).cast("long"))
    return checked.where(100 * F.col("common") >= PERCENT * (F.size("of_a") + F.size("of_b") - F.col("common"))).select(*pairs.columns)


def _linked(docs: DataFrame) -> DataFrame:
    """(doc_id, own, n_shingles, component_id, first) of every row; own: a hash of the text; first: (doc_id, own) of the component's first row."""
    told = store.keep(sketches(docs), "sketches")
    linked = told.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = store.keep(linked.groupBy("node").agg(F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch"), F.min(F.struct("doc_id", "own")).alias("at")), "classes")
    members = store.keep(candidates(classes), "lists")
    ids = store.keep(members.select(F.col("id").alias("node")).distinct().join(classes, "node").select("at.doc_id", "node"), "candidates")
    some = ids.select("doc_id").distinct()
    some = F.broadcast(some) if ids.count() <= BROADCAST_IDS else some
    sets = store.keep(full_sets(docs.join(some, "doc_id", "left_semi")).join(ids.select("node"), "node", "left_semi").dropDuplicates(["node"]), "sets")
    alike = " + ".join(f"bit_count({w}_a ^ {w}_b)" for w in _WORDS)
    fitting = f"100 * least(size_a, size_b) >= {PERCENT} * greatest(size_a, size_b) AND {alike} <= {DIFFER}"
    told_apart = members.join(sets.select(F.col("node").alias("id"), *_WORDS), "id")
    found = graph.grouped(told_apart, lambda pairs: similar(pairs, sets), "near", fitting, _WORDS)
    store.discard(members, ids, sets)
    of = classes.select("node", "at").join(found.withColumnRenamed("id", "node"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = of.groupBy("component").agg(F.min("at").alias("first"))
    joined = told.drop("sketch").join(of.join(least, "component").select("node", "first"), "node", "left")
    own = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("first"))
    return joined.withColumn("first", own).select("doc_id", "own", "n_shingles", F.coalesce("first.doc_id", "doc_id").alias("component_id"), "first")


def link(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs``.

    Null or wordless text: an empty set, linked with nothing. A null doc_id is linked
    with nothing either, has a null component and is kept. Equal texts are one node.
    Rows that share a doc_id are documents of their own. An empty table gives an empty
    result.
    """
    return _linked(docs).select("doc_id", "n_shingles", "component_id").withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def representatives(docs: DataFrame) -> DataFrame:
    """One row of each group of near duplicates, with the columns of ``docs``: that of the smallest doc_id and, of different texts under it, of the smallest hash.

    A row is judged by its own text: a different text under the doc_id of a copy stays.
    Null and wordless texts and rows without a doc_id all stay. Of rows with one doc_id
    and one text one stays. An empty table gives an empty one; further columns come
    through whatever their names.
    """
    told = _linked(docs).where("first IS NOT NULL")
    per = told.groupBy("doc_id", "own").agg(F.first("first").alias("first"), F.count(F.lit(1)).alias("n"))
    gone = per.where((F.col("first.doc_id") != F.col("doc_id")) | (F.col("first.own") != F.col("own"))).select("doc_id", "own")
    once = store.keep(per.where("n > 1 AND first.doc_id = doc_id AND first.own = own").select("doc_id", "own", F.lit(True).alias("once")), "once")
    columns = docs.columns
    text = f"c{columns.index('text')}"
    named = docs.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(columns)]).withColumn("key", F.col(f"c{columns.index('doc_id')}").cast("long")).withColumn("hash", F.xxhash64(text))
    own = lambda right: (F.col("key") == right["doc_id"]) & (F.col("hash") == right["own"])
    left = named.join(gone, own(gone), "left_anti")
    if once.limit(1).count():  # equal rows are rare; only they are brought together
        several = left.join(once, own(once), "left_semi").dropDuplicates(["key", "hash"])
        left = left.join(once, own(once), "left_anti").union(several)
    return left.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(columns)])
