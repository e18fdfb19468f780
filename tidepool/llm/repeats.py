"""Exact repeats of 100 bytes and more, by suffix arrays over content-chosen anchors.

Every string of LEAST bytes holds an anchor: the leftmost smallest hash among its
K-byte windows, so equal strings have their anchor at the same place. Only anchors
whose K bytes occur twice go on, each with the bytes around it that a string of LEAST
bytes through it can reach. A shard sorts the suffixes that start at its anchors,
stack-scans the common-prefix interval tree of the sorted suffixes and splits each
interval by what stands to the left: the groups that differ further left are the maximal
repeats, and each has all its occurrences. All but the first occurrence of a group are
spans to remove. The same scan from right to left finds how far they reach to the left.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from tidepool.llm import blocks, textarrays as ta

LEAST = 100
#: Bytes of an anchor, and windows of that size in a string of LEAST bytes.
K = 32
#: Suffixes that a shard sorts at once, about; groups of one anchor stay together.
SORTED = 30_000
#: Bytes of text searched for anchors at once, about: what a processor's cache holds.
PART = 1 << 18


def anchors(buf: np.ndarray, off: np.ndarray, least: int = LEAST, k: int = K) -> tuple[np.ndarray, ...]:
    """(position, document, hash of its k bytes, hash of all bytes that a string through it reaches) of the anchors of all strings of ``least`` bytes."""
    out = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]]
    for i, j in ta.parts(off, PART):
        got = _anchors(buf[off[i] : off[j]], off[i : j + 1] - off[i], least, k)
        for x, y, add in zip(out, got, (off[i], i, np.uint64(0), np.uint64(0)), strict=True):
            x.append(y + add)
    return tuple(map(np.concatenate, out))


def _anchors(buf: np.ndarray, off: np.ndarray, least: int, k: int) -> tuple[np.ndarray, ...]:
    n, width = len(buf), least - k + 1
    if n < least:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    running = ta.prefix_hash(buf)
    # all spans are equally long, so the lengths needn't enter the hash
    h = value = ta.mix((running[k:] - running[:-k]) * ta._powers(n)[1][: n - k + 1])
    where, done = np.arange(len(h), dtype=np.int32 if n < 1 << 31 else np.int64), 1
    while done < width:  # leftmost smallest of `done` windows, then of more
        step = min(done, width - done)
        take = value[:-step] <= value[step:]
        where = np.where(take, where[:-step], where[step:])
        value = np.minimum(value[:-step], value[step:])
        done += step
    # strings that cross documents don't count
    size = np.maximum(np.diff(off) - least + 1, 0)
    doc = np.repeat(np.arange(len(size)), size)
    start = np.arange(len(doc)) + np.repeat(off[:-1] - (np.cumsum(size) - size), size)
    where = where[start].astype(np.int64)
    new = np.ones(len(where), bool)
    new[1:] = (where[1:] != where[:-1]) | (doc[1:] != doc[:-1])
    at, doc = where[new], doc[new]
    a, b = np.minimum(least - k, at - off[doc]), np.minimum(least, off[doc + 1] - at)
    return at, doc, h[at], ta.mix(ta.span_hash(running, at - a, at + b) + a.astype(np.uint64))


def intervals(lcp: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(prefix length, first, last) of all common-prefix intervals of ``least`` and more; lcp[i] is that of suffixes i - 1 and i, -1 where they have nothing to do with each other."""
    out: list[tuple[int, int, int]] = []
    depth, begin = [-1], [0]
    for i, x in enumerate([*lcp.tolist()[1:], -1], 1):
        first = i - 1
        while depth[-1] > x:
            first = begin.pop()
            d = depth.pop()
            if d >= least:
                out.append((d, first, i - 1))
        if depth[-1] < x:
            depth.append(x)
            begin.append(first)
    a = np.array(out, np.int64).reshape(-1, 3)
    return a[:, 0], a[:, 1], a[:, 2]


def _running(side: np.ndarray) -> np.ndarray:
    """Hash of the first j bytes of each row, for all j."""
    out = np.zeros((side.shape[0], side.shape[1] + 1), np.uint64)
    np.cumsum(ta._BYTE[side] * ta._powers(side.shape[1])[0][: side.shape[1]], axis=1, out=out[:, 1:])
    return out


def reach(group: np.ndarray, near: np.ndarray, near_n: np.ndarray, far: np.ndarray, far_n: np.ndarray, rank: np.ndarray, least: int, least_near: int) -> np.ndarray:
    """How far each suffix's longest repeat of an earlier one reaches on the near side, -1 if it repeats none.

    Rows of one ``group`` share an anchor; near and far are the bytes on its two sides,
    read away from it. A repeat of x bytes nearby counts if least - x bytes on the far
    side are equal too.
    """
    n, width = near.shape
    padded = np.zeros((n, -(-width // 8) * 8), np.uint8)
    padded[:, :width] = near
    columns = padded.view(">u8")
    order = np.lexsort((near_n, *[columns[:, c] for c in range(columns.shape[1] - 1, -1, -1)], group))
    s = near[order]
    lcp = np.full(n, -1, np.int64)
    if n > 1:
        differ = s[1:] != s[:-1]
        same = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
        same = np.minimum(same, np.minimum(near_n[order][1:], near_n[order][:-1]))
        lcp[1:] = np.where(group[order][1:] == group[order][:-1], same, -1)
    depth, first, last = intervals(lcp, least_near)
    out = np.full(n, -1, np.int64)
    ahead = _running(far)
    size = last - first + 1
    at = 0
    while at < len(depth):  # some intervals at a time; an interval's suffixes stay together
        to = max(at + 1, int(np.searchsorted(np.cumsum(size[at:]), 400_000, "right")) + at)
        d = np.repeat(depth[at:to], size[at:to])
        number = np.repeat(np.arange(at, to), size[at:to])
        begin = np.cumsum(size[at:to]) - size[at:to]
        member = order[np.arange(len(d)) - np.repeat(begin, size[at:to]) + np.repeat(first[at:to], size[at:to])]
        need = least - d
        able = far_n[member] >= need
        d, number, member, need = d[able], number[able], member[able], need[able]
        # left-extension diversity: one interval falls into groups by what stands on the far side
        key = ta.mix(ahead[member, need] + ta.mix(number.astype(np.uint64) + np.uint64(1)))
        by = np.lexsort((rank[member], key))
        later = np.zeros(len(by), bool)
        later[1:] = key[by][1:] == key[by][:-1]
        np.maximum.at(out, member[by][later], d[by][later])
        at = to
    return out


def _contexts(buf: np.ndarray, off: np.ndarray, at: np.ndarray, doc: np.ndarray, left: int, right: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes around each anchor, zero beyond its document, bytes there are on the left, on the right)."""
    n_left, n_right = np.minimum(left, at - off[doc]), np.minimum(right, off[doc + 1] - at)
    padded = np.concatenate([np.zeros(left, np.uint8), buf, np.zeros(right, np.uint8)])
    rows = np.lib.stride_tricks.sliding_window_view(padded, left + right)[at].copy()
    place = np.arange(-left, right)[None, :]
    rows[(place < -n_left[:, None]) | (place >= n_right[:, None])] = 0
    return rows, n_left, n_right


def _send(shards: int, least: int) -> Callable:
    left, right = least - K, least

    def run(key: tuple, block: pa.Table, known: pa.Table) -> pa.Table:
        shared = [np.array(x, np.int64).view(np.uint64) for x in known.column("found").to_pylist()]
        found = np.sort(np.concatenate(shared)) if shared else np.zeros(0, np.uint64)
        dest, blob = [], []
        for data in block.column("blob").to_pylist():
            ids, _, off, buf = blocks.expand(data)[:4]
            at, doc, h, whole = anchors(buf, off, least)
            if len(found):
                k = np.minimum(np.searchsorted(found, h), len(found) - 1)
                hit = found[k] == h
                at, doc, h, whole = at[hit], doc[hit], h[hit], whole[hit]
            if not len(found) or not len(at):
                continue
            n_left, n_right = np.minimum(left, at - off[doc]), np.minimum(right, off[doc + 1] - at)
            # of anchors whose surroundings are equal, the first stands for the others of its block
            order = np.lexsort((at, doc, ids[doc], whole))
            head = np.ones(len(order), bool)
            head[1:] = whole[order][1:] != whole[order][:-1]
            owner = order[np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))]
            heads, tails, owners = order[head], order[~head], owner[~head]
            shard = (h >> np.uint64(11)) % np.uint64(shards)
            for s in np.unique(shard[heads]).tolist():
                mine = heads[shard[heads] == s]
                mine = mine[np.argsort(mine)]
                rest = shard[owners] == s
                rows, a, b = _contexts(buf, off, at[mine], doc[mine], left, right)
                dest.append(int(s))
                blob.append(blocks.squeeze(h[mine], ids[doc[mine]], doc[mine].astype(np.int32), (at - off[doc])[mine], a.astype(np.uint8), b.astype(np.uint8), rows, doc[tails[rest]].astype(np.int32), (at - off[doc])[tails[rest]], n_left[tails[rest]].astype(np.uint8), n_right[tails[rest]].astype(np.uint8)))
        return pa.table({"shard": pa.array(dest, pa.int64()), "block": pa.array([key[0].as_py()] * len(dest), pa.int64()), "blob": pa.array(blob, pa.binary())})

    return run


def _sorted(least: int) -> Callable:
    left = least - K

    def run(key: tuple, sent: pa.Table) -> pa.Table:
        source = sent.column("block").to_numpy()
        got = [blocks.expand(x) for x in sent.column("blob").to_pylist()]
        part = np.repeat(np.arange(len(got)), [len(x[0]) for x in got])
        h, ids, doc, at, a, b, rows = (np.concatenate([x[k] for x in got]) for k in range(7))
        rank = np.empty(len(h), np.int64)
        rank[np.lexsort((at, doc, source[part], ids))] = np.arange(len(h))
        a, b = a.astype(np.int64), b.astype(np.int64)
        to_right, to_left = np.full(len(h), -1, np.int64), np.full(len(h), -1, np.int64)
        by = np.argsort(h, kind="stable")
        edge = np.flatnonzero(np.append(True, h[by][1:] != h[by][:-1]))
        edge = np.append(edge, len(by))
        i = 0
        while i < len(edge) - 1:
            j = max(i + 1, int(np.searchsorted(edge, edge[i] + SORTED, "right")) - 1)
            m = by[edge[i] : edge[j]]
            r, l_ = rows[m][:, left:], rows[m][:, :left][:, ::-1]
            to_right[m] = reach(h[m], r, b[m], l_, a[m], rank[m], least, K)
            to_left[m] = reach(h[m], l_, a[m], r, b[m], rank[m], least, 0)
            i = j
        out = []
        for k, x in enumerate(got):
            hit = np.flatnonzero((part == k) & (to_right >= 0) & (to_left >= 0))
            o_doc, o_at = np.concatenate([doc[hit], x[7]]), np.concatenate([at[hit], x[8]])
            start, end = o_at - np.concatenate([to_left[hit], x[9].astype(np.int64)]), o_at + np.concatenate([to_right[hit], x[10].astype(np.int64)])
            if len(o_doc):
                out.append((int(source[k]), blocks.squeeze(o_doc, start, end)))
        return pa.table({"block": pa.array([x[0] for x in out], pa.int64()), "spans": pa.array([x[1] for x in out], pa.binary())})

    return run


def _cut(key: tuple, block: pa.Table, told: pa.Table) -> pa.Table:
    out: list[tuple] = []
    for data in block.column("blob").to_pylist():
        ids, known, off, buf = blocks.expand(data)[:4]
        edge = np.zeros(len(buf) + 1, np.int32)
        for spans in told.column("spans").to_pylist():
            doc, start, end = blocks.expand(spans)
            np.add.at(edge, off[doc] + start, 1)
            np.add.at(edge, off[doc] + end, -1)
        gone = np.cumsum(edge[:-1]) > 0
        first = gone.copy()
        first[1:] &= ~gone[:-1]
        begins = off[:-1][np.diff(off) > 0]
        first[begins] = gone[begins]
        removed, runs = ta.per_doc(gone, off), ta.per_doc(first, off)
        for k in range(len(ids)):
            own = slice(off[k], off[k + 1])
            text = buf[own][~gone[own]] if removed[k] else buf[own]
            out.append((int(ids[k]) if known[k] else None, int(off[k + 1] - off[k]), int(removed[k]), int(runs[k]), hashlib.sha256(text.tobytes()).hexdigest()))
    cols = list(zip(*out, strict=True)) if out else [()] * 5
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
    return pa.table({n: pa.array(list(c), t) for n, c, t in zip(["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"], cols, kinds, strict=True)})


def remove(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row of ``docs``.

    Removed is each byte covered by a string of ``least`` bytes that also starts earlier:
    in a smaller doc_id, or earlier in the same document. A null text is empty. Rows
    with one doc_id follow each other in the order in which they were read; a null
    doc_id comes after all others. An empty table gives an empty result.
    """
    n = blocks.buckets(docs)
    table = blocks.write(docs, n)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                _, _, off, buf = blocks.expand(data)[:4]
                h, count = np.unique(anchors(buf, off, least)[2], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.full(len(h), number), pa.int64()), pa.array(np.minimum(count, 2), pa.int64())], ["h", "block", "n"])

    # a block names an anchor once, so no group of this window is larger than the blocks
    here = table.mapInArrow(found, "h long, block long, n long")
    twice = here.withColumn("all", F.sum("n").over(W.partitionBy("h"))).where("all > 1")
    shared = twice.groupBy("block").agg(F.collect_list("h").alias("found"))
    sent = table.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(_send(n, least), "shard long, block long, blob binary")
    spans = sent.groupBy("shard").applyInArrow(_sorted(least), "block long, spans binary")
    return table.groupBy("block").cogroup(spans.groupBy("block")).applyInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
