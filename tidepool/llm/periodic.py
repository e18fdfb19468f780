"""Periodic runs of words, found by masking with repeated k-grams, then Main-Lorentz.

A run of period q and at least LEAST words has two periods or more, so its words but
for the last q occur again q words on: an overlap of LEAST - LEAST // 2 = K words at
least. So each word of a run lies in a K-gram that occurs twice in its document; all
other words are masked, and only stretches of unmasked words that are long enough are
searched at all. A mask of hashes may let too many words through, never too few.

The search is Main-Lorentz over all surviving stretches of many documents at once. The
stretches stand one after another; at level j the centres are the odd multiples of 2^j,
and a run is found at the highest level with a centre strictly inside of it, where it
reaches at most 2^j words to either side. For each centre m and period q, how far the
words at m - q and m (or m and m + q) agree forwards and backwards is found by names of
all substrings of 1, 2, 4, ... words (equal names: equal words, no hashes), so a run's
ends and periods are exact. Time grows as n log n of the surviving words.

A row is judged by itself, whatever its doc_id: there is no shuffle, and a lost executor
costs its own tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tidepool.llm import textarrays as ta

#: Words of the shortest run.
LEAST = 12
#: Surviving words that are searched at once, about; a document's stay together.
AT_ONCE = 1 << 16
#: Bytes of results that are handed on at once, about.
OUT = 1 << 22
RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def surviving(ids: np.ndarray, least: int = LEAST) -> list[tuple[int, int]]:
    """Maximal stretches [first, end) of ``least`` words and more that in-document repeated k-grams cover."""
    n, k = len(ids), least - least // 2
    if n < least:
        return []
    odd = ta.mix(np.arange(1, k + 1, dtype=np.uint64)) | np.uint64(1)
    gram = np.zeros(n - k + 1, np.uint64)
    for t in range(k):
        gram += ta.mix(ids[t : t + len(gram)].astype(np.uint64) + np.uint64(1)) * odd[t]
    order = np.argsort(gram)
    same = gram[order[1:]] == gram[order[:-1]]
    if not same.any():
        return []
    again = np.concatenate([order[1:][same], order[:-1][same]])
    edge = np.bincount(again, minlength=n + 1) - np.bincount(again + k, minlength=n + 1)
    covered = np.concatenate([[False], np.cumsum(edge[:-1]) > 0, [False]])
    first, end = np.flatnonzero(covered[1:] & ~covered[:-1]), np.flatnonzero(~covered[1:] & covered[:-1])
    long = end - first >= least
    return list(zip(first[long].tolist(), end[long].tolist(), strict=True))


def _names(ids: np.ndarray, longest: int) -> list[np.ndarray]:
    """names[j][i]: the same number for equal substrings of 2^j items, where they fit."""
    names = [ids.astype(np.int64)]
    while 2 << (len(names) - 1) <= longest:
        half = 1 << (len(names) - 1)
        last = names[-1]
        pair = last[:-half] * (int(last.max()) + 1) + last[half:]
        names.append(np.unique(pair, return_inverse=True)[1].reshape(-1))
    return names


def _agree(names: list[np.ndarray], i: np.ndarray, j: np.ndarray, room: np.ndarray, back: bool) -> np.ndarray:
    """How many items agree from i and j on, at most ``room``; backwards: of those that end before i and j."""
    done = np.zeros(len(i), np.int64)
    for level in range(len(names) - 1, -1, -1):
        size = 1 << level
        at = np.flatnonzero(done + size <= room)
        step = done[at]
        a, b = (i[at] - step - size, j[at] - step - size) if back else (i[at] + step, j[at] + step)
        done[at[names[level][a] == names[level][b]]] += size
    return done


def main_lorentz(ids: np.ndarray, bounds: list[tuple[int, int]], least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, smallest period) of all maximal runs inside the stretches [first, end) of ``ids``, in order."""
    if not bounds:
        return []
    low, high = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
    for a, b in bounds:
        low[a:b], high[a:b] = a, b
    longest = max(b - a for a, b in bounds)
    names = _names(ids, longest)
    found: list[np.ndarray] = []
    # the places inside of a run hold a multiple of any power of two below ``least``; the last level has all multiples, as a stretch holds one at most
    level, last = (least - 1).bit_length() - 1, (longest - 1).bit_length()
    for level in range(min(level, last), last + 1):
        half = 1 << level
        centres = np.arange(half, len(ids), half if level == last else 2 * half)
        centres = centres[(low[centres] < centres) & (high[centres] > centres)]
        most = min(half, longest // 2)
        # a slice of centres has about AT_ONCE pairs, whatever the level
        width = max(1, AT_ONCE // most)
        for at in range(0, len(centres), width):
            m, q = np.repeat(centres[at : at + width], most), np.tile(np.arange(1, most + 1), len(centres[at : at + width]))
            found += _crossing(names, low, high, m, q, -1, least) + _crossing(names, low, high, m, q, 1, least)
    if not found:
        return []
    start, end, period = np.concatenate(found, axis=1)
    order = np.lexsort((period, end, start))  # the smallest of a stretch's periods comes first
    start, end, period = start[order], end[order], period[order]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    return sorted((int(s), int(e - s), int(q)) for s, e, q in zip(start[new], end[new], period[new], strict=True))


def _crossing(names: list[np.ndarray], low: np.ndarray, high: np.ndarray, m: np.ndarray, q: np.ndarray, side: int, least: int) -> list[np.ndarray]:
    """Runs around the centres m with a whole period q to the left (side -1) or right (1) of m."""
    other = m + side * q
    fits = (other >= low[m]) & (other < high[m])
    m, q, other = m[fits], q[fits], other[fits]
    i, j = np.minimum(m, other), np.maximum(m, other)
    # one agreeing word beside the pair is needed, whatever the period
    word = names[0]
    near = word[i] == word[j]
    inner = i > low[i]
    near |= inner & (word[i - inner] == word[j - inner])
    i, j, q = i[near], j[near], q[near]
    after, before = _agree(names, i, j, high[j] - j, False), _agree(names, i, j, i - low[i], True)
    whole = (after + before >= q) & (after + before + q >= least)
    i, j, q, after, before = i[whole], j[whole], q[whole], after[whole], before[whole]
    return [np.stack([i - before, j + after, q])]


def runs(words: list[list[bytes]], least: int = LEAST) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of each document, by start and then period."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in words]
    held: list[np.ndarray] = []
    place: list[tuple[int, int, int]] = []  # document, word of the stretch's first one, its place among those held
    size = 0

    def search() -> None:
        nonlocal held, place, size
        ends = np.cumsum([len(x) for x in held])
        bounds = [(int(e - len(x)), int(e)) for x, e in zip(held, ends, strict=True)]
        first = np.array([a for a, _ in bounds])
        for s, length, q in main_lorentz(np.concatenate(held), bounds, least):
            doc, word, begin = place[int(np.searchsorted(first, s, "right")) - 1]
            out[doc].append((word + s - begin, length, q))
        held, place, size = [], [], 0

    for d, own in enumerate(words):
        if len(own) < least:
            continue
        seen: dict[bytes, int] = {}
        ids = np.fromiter((seen.setdefault(w, len(seen)) for w in own), np.int64, len(own))
        for a, b in surviving(ids, least):
            place.append((d, a, size))
            held.append(ids[a:b])
            size += b - a
        if size >= AT_ONCE:
            search()
    if held:
        search()
    for own in out:
        own.sort(key=lambda r: (r[0], r[2]))
    return out


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that any run contains after its first period."""
    if not found:
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, period in found:
        edge[start + period] += 1
        edge[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]


def find(docs: DataFrame, keep: list[str] | None = None, least: int = LEAST) -> DataFrame:
    """Each row with its n_words, its runs of at least ``least`` words and its collapsed text.

    ``keep`` names the columns that come along, all if it is None. A null text has no words and
    an empty collapsed text; repeated rows and equal or null doc_ids are each judged by
    themselves; an empty table gives an empty one. Own columns named ``_n_words``, ``_runs``
    or ``_collapsed`` are the only ones that can clash, and win over given ones.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("_n_words", "_runs", "_collapsed")]
    sent = docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], F.col("text").cast("binary").alias("t"))
    schema = sent.drop("t").schema.add("n", "long").add("r", T.DataType.fromDDL("array<struct<start:long,length:long,period:long>>")).add("c", "binary")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, _, _ in ta.slices(batch, "t", OUT):
                words = [(t or b"").split() for t in rows.column(rows.num_columns - 1).to_pylist()]
                found = runs(words, least)
                listed = [[{"start": s, "length": n, "period": q} for s, n, q in own] for own in found]
                left = [b" ".join(collapsed(w, own)) for w, own in zip(words, found, strict=True)]
                yield pa.RecordBatch.from_arrays([*rows.columns[:-1], pa.array([len(w) for w in words], pa.int64()), pa.array(listed, RUNS), pa.array(left, pa.binary())], names=schema.names)

    out = sent.mapInArrow(work, schema)
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], F.col("n").alias("_n_words"), F.col("r").alias("_runs"), F.col("c").cast("string").alias("_collapsed"))


def planted(docs: DataFrame) -> DataFrame:
    """Documents of which each with crc32(doc_id) % 10 = 0 repeats a stretch of its words up to its end; a null doc_id leaves its row as it is."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    wide = docs.withColumn("_w", F.when((h % 10 == 0) & F.col("text").isNotNull(), words))
    n, g = F.nullif(F.size("_w").cast("long"), F.lit(0).cast("long")), F.floor(h / 10).cast("long")
    a = g % n
    p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8)).cast("long")

    def at(i: Column) -> Column:
        return F.when(i < a, i).otherwise(a + (i - a) % p)

    again = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.element_at("_w", (at(i) + 1).cast("int"))), " ")
    return wide.withColumn("text", F.when(n > 0, again).otherwise(F.col("text"))).drop("_w")


def digest(docs: DataFrame) -> DataFrame:
    """Number of runs, the longest one and digests of all runs and of the collapsed text, for each row of ``docs``; four nulls without a run."""
    found = find(docs.select("doc_id", "text"), keep=["doc_id"])
    best = F.array_min(F.transform("_runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    listed = F.array_join(F.transform("_runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    return found.select("doc_id", "_collapsed", F.size("_runs").cast("long").alias("n_runs"), best.alias("_best"), F.sha2(listed, 256).alias("runs_sha256")).select(
        "doc_id",
        "n_runs",
        F.col("_best.start").alias("start"),
        (-F.col("_best.less")).alias("length"),
        F.col("_best.period").alias("period"),
        F.floor(-F.col("_best.less") * 1000 / F.col("_best.period")).cast("long").alias("exponent_milli"),
        "runs_sha256",
        F.sha2("_collapsed", 256).alias("collapsed_sha256"),
    )
