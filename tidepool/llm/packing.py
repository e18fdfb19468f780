"""Best-fit packing of tokenised documents into sequences, improved by swaps.

A document becomes its token ids and one end id; only what is longer than a sequence is
cut. Pieces are dealt into cells of bounded size by a hash. In a cell, pieces start in
the fullest bin that takes them, largest first; then local search exchanges one piece
for one or for two of another underfull bin, or moves one, whenever that increases the
sum of squared fills, until nothing improves; bins that empty out vanish. Bins that stay
underfull are opened again and dealt anew into fewer cells, round after round, until one
cell is left, so the waste of a cell does not add up over the cluster.
"""

from __future__ import annotations

import bisect
import itertools
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidepool.llm import store, textarrays as ta

TOKENIZER = "word_bpe_49k.json"
#: Tokens in a sequence, and the id after every document.
LENGTH, END = 2048, 0
#: Pieces in a cell, about.
CELL = 8192
#: A bin with fewer tokens than this share of a sequence is opened again in the next round.
UNDERFULL = 0.985
#: Words whose ids a worker remembers; beyond that it forgets all and goes on.
REMEMBERED = 2_000_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long"

#: A byte that texts hardly have, and what sets words apart in a text of many.
MARK, APART = b"\x01", b" \x01 "

_WORKER: dict = {}


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


_STOP, _PLAIN = np.zeros(256, bool), np.zeros(256, bool)
_STOP[[44, 46]] = True
_PLAIN[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True


def _folded(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The bytes with words of ASCII characters in lower case, as this tokenizer reads them.

    Other words keep their case, as composing characters comes before lower case, and so
    do all words where the name of a special token may stand, which is read as written.
    """
    if b"<|" in buf.tobytes():
        return buf
    wide = np.zeros(len(buf) + 1, np.int32)
    np.cumsum(buf >= 128, out=wide[1:])
    other = wide[end] > wide[start]
    edge = np.zeros(len(buf) + 1, np.int8)
    edge[start[other]] += 1
    edge[end[other]] -= 1
    return np.where(np.cumsum(edge[:-1], dtype=np.int8) > 0, buf, ta.LOWER[buf])


class WordIds:
    """Ids of texts, word by word: this tokenizer never joins what white space separates, so equal words have equal ids."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        (self.mark,) = self.tokenizer.encode(MARK.decode(), add_special_tokens=False).ids
        self.forget()

    def forget(self) -> None:
        self.place: dict[int, int] = {}
        self.ids, self.used = np.zeros(1 << 20, np.uint32), 0
        self.first, self.size = np.zeros(1 << 18, np.int64), np.zeros(1 << 18, np.int64)

    def learn(self, hashes: list[int], found: list[bytes]) -> None:
        if any(MARK in w for w in found):
            ids, size = self._alone(found)
        else:  # many words as one text, with a mark between that is one token and joins nothing
            texts = [(APART.join(found[i : i + 200]) + APART).decode("utf-8", "replace") for i in range(0, len(found), 200)]
            ids = np.concatenate([np.array(x.ids, np.uint32) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)])
            at = np.flatnonzero(ids == self.mark)
            ids, size = np.delete(ids, at), np.diff(at, prepend=-1) - 1
        total, k = len(ids), len(self.place)
        if self.used + total > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(total, len(self.ids)), np.uint32)])
        if k + len(size) > len(self.first):
            more = np.zeros(max(len(size), len(self.first)), np.int64)
            self.first, self.size = np.concatenate([self.first, more]), np.concatenate([self.size, more])
        self.ids[self.used : self.used + total] = ids
        self.size[k : k + len(size)] = size
        self.first[k : k + len(size)] = self.used + np.cumsum(size) - size
        self.place.update(zip(hashes, range(k, k + len(size)), strict=True))
        self.used += total

    def _alone(self, found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        got = [x.ids for x in self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in found], add_special_tokens=False)]
        return np.array(list(itertools.chain.from_iterable(got)), np.uint32), np.array([len(x) for x in got], np.int64)

    def encode(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets)."""
        start, end, doc = ta.words(buf, off)
        buf = _folded(buf, start, end)
        # a full stop or comma after an ASCII letter or digit is a token of its own; without it words recur far more often
        mark = (end - start > 1) & _STOP[buf[end - 1]] & _PLAIN[buf[np.maximum(end - 2, 0)]]
        cut = end[mark] - 1
        at = np.flatnonzero(mark) + 1
        start, doc, end = np.insert(start, at, cut), np.insert(doc, at, doc[mark]), np.insert(end, at - 1, cut)
        h = ta.span_hash(ta.prefix_hash(buf), start, end)
        known, example, index = ta.distinct(h)
        if len(self.place) > REMEMBERED:
            self.forget()
        keys = known.tolist()
        which = np.fromiter(map(self.place.get, keys, itertools.repeat(-1)), np.int64, len(keys))
        new = np.flatnonzero(which < 0)
        raw, first, last = buf.tobytes(), start[example].tolist(), end[example].tolist()
        which[new] = len(self.place) + np.arange(len(new))
        for at in range(0, len(new), 20_000):
            part = new[at : at + 20_000].tolist()
            self.learn([keys[i] for i in part], [raw[first[i] : last[i]] for i in part])
        which = which[index]
        size = self.size[which]
        to = np.cumsum(size)
        shift = np.repeat(self.first[which] - (to - size), size)
        ids = self.ids[np.arange(int(to[-1]) if len(to) else 0) + shift]
        bounds = np.zeros(len(off), np.int64)
        np.cumsum(np.bincount(doc, weights=size, minlength=len(off) - 1).astype(np.int64), out=bounds[1:])
        return ids, bounds


def pieces(docs: DataFrame, path: str | None = None, length: int = LENGTH) -> DataFrame:
    """A row for each piece of each document: its place in the document and the CRC of its ids."""
    path = path or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _WORKER:
            _WORKER[path] = WordIds(path)
        for batch in batches:
            for rows, buf, off in ta.slices(batch, limit=2 * ta.SLICE):
                ids, bounds = _WORKER[path].encode(buf, off)
                out: list[tuple] = []
                for k, doc_id in enumerate(rows.column(0).to_pylist()):
                    own = np.append(ids[bounds[k] : bounds[k + 1]], END).astype("<u4")
                    out += [(doc_id, p, at, len(x := own[at : at + length]), zlib.crc32(x.tobytes())) for p, at in enumerate(range(0, len(own), length))]
                doc, piece, at, n, crc = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(at, pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES)


def best_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins as lists of indices: largest first, each into the fullest bin that takes it."""
    free: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by the room they have
    rooms: list[int] = []  # rooms of which there are bins, sorted
    bins: list[list[int]] = []
    for i in np.argsort(-sizes, kind="stable").tolist():
        n = int(sizes[i])
        at = bisect.bisect_left(rooms, n)
        if at == len(rooms):
            bins.append([])
            b, room = len(bins) - 1, capacity
        else:
            room = rooms[at]
            b = free[room].pop()
            if not free[room]:
                del rooms[at]
        bins[b].append(i)
        if room - n:
            if not free[room - n]:
                bisect.insort(rooms, room - n)
            free[room - n].append(b)
    return bins


def improve(sizes: np.ndarray, bins: list[list[int]], capacity: int, sweeps: int = 4) -> list[list[int]]:
    """Local search over underfull bins.

    The fullest underfull bin looks for what fills its room best: a piece that another
    underfull bin gives it (move), or a larger piece for one or for two of its own
    (swap). The giver must be emptier than the taker, so every step increases the sum of
    squared fills, and the search ends.
    """
    fill = [int(sizes[b].sum()) if len(b) else 0 for b in (np.array(x, int) for x in bins)]
    for _ in range(sweeps):
        changed = False
        under = sorted((b for b in range(len(bins)) if bins[b] and fill[b] < capacity), key=lambda b: -fill[b])
        place = {b: k for k, b in enumerate(under)}
        where = {i: b for b in under for i in bins[b]}
        by_size = sorted((int(sizes[i]), i) for b in under for i in bins[b])
        for b in under:
            while bins[b] and fill[b] < capacity:
                room, best = capacity - fill[b], None
                own = sorted((int(sizes[i]), (i,)) for i in bins[b])
                pairs = [(x + y, (*i, *j)) for k, (x, i) in enumerate(own[:6]) for y, j in own[k + 1 : 6]]
                for lost, out in [(0, ()), *own, *pairs]:
                    # the largest piece of an emptier bin that fits once `out` has left
                    at, tries = bisect.bisect_right(by_size, (lost + room, len(sizes))) - 1, 0
                    while at >= 0 and tries < 12 and by_size[at][0] > lost:
                        n, i = by_size[at]
                        giver = where[i]
                        if place[giver] > place[b] and fill[giver] < capacity and fill[giver] <= fill[b] and fill[giver] - n + lost >= 0:
                            if best is None or n - lost > best[0]:
                                best = (n - lost, i, giver, out)
                            break
                        at, tries = at - 1, tries + 1
                    if best and best[0] == room:
                        break
                if best is None:
                    break
                gain, i, giver, out = best
                bins[giver].remove(i)
                bins[b].append(i)
                where[i] = b
                for j in out:
                    bins[b].remove(j)
                    bins[giver].append(j)
                    where[j] = giver
                fill[b] += gain
                fill[giver] -= gain
                changed = True
        if not changed:
            break
    return [b for b in bins if b]


def _pack_cell(capacity: int, least: int, base: int) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    def run(key: tuple, cell: pd.DataFrame) -> pd.DataFrame:
        # doc_id may be null or repeated: the other columns settle the order, and rows equal in all are alike
        cell = cell.sort_values(["length", "doc_id", "piece", "start", "ids_crc32"], kind="stable", ignore_index=True)
        sizes = cell["length"].to_numpy()
        bins = improve(sizes, best_fit(sizes, capacity), capacity)
        sequence, offset = np.full(len(cell), -1, np.int64), np.zeros(len(cell), np.int64)
        for b, members in enumerate(bins):
            n = sizes[members]
            if n.sum() >= least:
                sequence[members] = base + (int(key[0]) << 24) + b
                offset[members] = np.cumsum(n) - n
        return cell[["doc_id", "piece", "start", "length", "ids_crc32"]].assign(sequence_id=sequence, offset=offset)

    return run


def pack(cut: DataFrame, length: int = LENGTH, cell: int = CELL, underfull: float = UNDERFULL) -> DataFrame:
    """``pieces`` rows with sequence_id and offset; every row is placed once.

    Pieces that fill a sequence stand alone. A round deals the open pieces into cells
    by a hash of their row numbers, keeps the bins that are full enough and passes the rest
    on; the last round, of one cell, keeps all. The rows of a round are a written table,
    so a task that runs again numbers and deals them as before. The rounds shrink by the share of
    pieces in underfull bins, a few in a hundred.
    """
    spark = cut.sparkSession
    cut = store.keep(cut, "pieces")
    whole = cut.where(F.col("length") >= length)
    # a sequence of its own: numbered apart from all others by partition and row
    done = [whole.withColumn("sequence_id", F.monotonically_increasing_id() + F.lit(1 << 62)).withColumn("offset", F.lit(0).cast("long"))]
    left, turn = cut.where(F.col("length") < length), 0
    count = left.count()
    while count:
        last = count <= cell
        cells = max(1, -(-count // cell))
        dealt = left.withColumn("_cell", F.pmod(F.xxhash64(F.lit(turn), F.monotonically_increasing_id()), F.lit(cells)))
        work = _pack_cell(length, 0 if last else int(underfull * length), turn << 56)
        placed = store.keep(dealt.repartition(min(cells, 4096), "_cell").groupBy("_cell").applyInPandas(work, PACKED), f"packed-{turn}")
        done.append(placed.where("sequence_id >= 0"))
        left, before = placed.where("sequence_id < 0").drop("sequence_id", "offset"), count
        count, turn = 0 if last else left.count(), turn + 1
        if count > 0.6 * before:  # such pieces don't combine any better: keep their bins as they are
            underfull = 0.0
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out
