"""Scores of a word trigram model kept as an Elias-Fano trie.

Counts, trie and scores never pass through the driver. Each block of documents sends the
distinct bigrams and trigrams of its texts, with their counts in training documents, to
shards by first word. A shard adds them up, builds the levels of its trie in
memory-mapped files and answers every question of every block: counts and backoffs of
contexts, and the quantised probability of each successor. A block then scores its texts.
Training counts and questions travel together, so held-out words cost nothing more.

The model: P(w | uv) = max(0, c(uvw) - d) / c(uv) + d * T(uv) / c(uv) * P(w | v), T being
the number of different successors, P(w | v) the same one word shorter, and
P(w) = (c(w) - d1) / N, or d1 * V / N for the one class of unseen words. A document
follows two ends. d is DISCOUNT in both orders, whatever the input; d1 is n1 / (n1 + 2 * n2)
of the words that occur once and twice. Codes are rounded down, so a context's
probabilities never sum to more than one.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidepool.llm import blocks, store, textarrays as ta

#: Hash of the token that ends, and as a context begins, every document.
END = np.uint64(0x9D5C0F3A71E4B286)
#: Bits of a successor within its context; a shard may have 2 ** (62 - WIDE) contexts.
WIDE = 32
#: What is taken from the count of each bigram and trigram.
DISCOUNT = 0.75
#: Shards for each bucket of blocks: what of a shard is in memory at once.
SHARDS = 2
#: A code is so many parts of a power of ten; NONE: not in the trie.
PARTS, NONE = 32, 65535
#: Documents whose crc32(doc_id) mod 5 is this are held out.
HELD = 1

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
_ONES = _BITS.sum(axis=1, dtype=np.int64)
#: Place of the k-th one of a byte, and of its k-th zero.
_PLACE = [np.argsort(_BITS != bit, axis=1, kind="stable").astype(np.uint8) for bit in (0, 1)]


def _mapped(x: np.ndarray, folder: str, name: str) -> np.ndarray:
    """The array as a memory-mapped file."""
    if not x.size:
        return x
    path = os.path.join(folder, name)
    np.ascontiguousarray(x).tofile(path)
    return np.memmap(path, x.dtype, "r", shape=x.shape)


class EliasFano:
    """A sequence of integers below 2**63 that never fall: low bits as they are, high bits in unary; searched where it lies, in memory-mapped files."""

    def __init__(self, values: np.ndarray, folder: str, name: str):
        self.n = len(values)
        top = int(values[-1]) + 1 if self.n else 1
        self.l = max(0, (top // max(1, self.n)).bit_length() - 1)
        values = values.astype(np.uint64)
        high = (values >> np.uint64(self.l)).astype(np.int64)
        planes = -(-self.l // 8)
        low = (values & np.uint64((1 << self.l) - 1)).astype("<u8").view(np.uint8).reshape(self.n, 8)[:, :planes]
        bits = np.zeros((int(high[-1]) if self.n else 0) + self.n + 2, np.uint8)
        bits[high + np.arange(self.n)] = 1
        packed = np.packbits(bits, bitorder="little")
        ones = np.concatenate([[0], np.cumsum(_ONES[packed])])
        self.low = _mapped(low, folder, f"{name}.low")
        self.bits = _mapped(packed, folder, f"{name}.high")
        # ones, and zeros, before each byte
        self.before = [np.arange(len(ones)) * 8 - ones, ones]

    def _select(self, k: np.ndarray, bit: int) -> np.ndarray:
        """Place of the k-th (from 0) one or zero."""
        before = self.before[bit]
        byte = np.searchsorted(before, k, "right") - 1
        return byte * 8 + _PLACE[bit][self.bits[byte], k - before[byte]]

    def _low(self, i: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i), np.uint64)
        rows = self.low[i]
        for p in range(rows.shape[1]):
            out |= rows[:, p].astype(np.uint64) << np.uint64(8 * p)
        return out

    def get(self, i: np.ndarray) -> np.ndarray:
        return ((self._select(i, 1) - i).astype(np.uint64) << np.uint64(self.l)) | self._low(i)

    def find(self, x: np.ndarray) -> np.ndarray:
        """Index of each value, -1 where it isn't in the sequence: the successor of x, if that is x."""
        x = x.astype(np.uint64)
        out = np.full(len(x), -1, np.int64)
        high = (x >> np.uint64(self.l)).astype(np.int64)
        able = np.flatnonzero(x <= self.get(np.array([self.n - 1]))) if self.n else np.zeros(0, np.int64)
        high, low = high[able], x[able] & np.uint64((1 << self.l) - 1)
        lo = np.where(high > 0, self._select(np.maximum(high - 1, 0), 0) - (high - 1), 0)
        hi = self._select(high, 0) - high
        hi_all, active = hi.copy(), np.flatnonzero(lo < hi)
        while len(active):
            mid = (lo[active] + hi[active]) // 2
            less = self._low(mid) < low[active]
            lo[active[less]], hi[active[~less]] = mid[less] + 1, mid[~less]
            active = active[lo[active] < hi[active]]
        hit = np.flatnonzero(lo < hi_all)
        hit = hit[self._low(lo[hit]) == low[hit]]
        out[able[hit]] = lo[hit]
        return out


def code(logs: np.ndarray) -> np.ndarray:
    """Quantised log10 probabilities, rounded down."""
    return np.clip(np.ceil(-logs * PARTS - 1e-9), 0, NONE - 1).astype(np.uint16)


def uncode(codes: np.ndarray) -> np.ndarray:
    return 10.0 ** (-codes.astype(float) / PARTS)


class Level:
    """Successors of the nodes of the level above: pointers to where those of each begin, and the successors, each an Elias-Fano sequence; quantised probabilities beside them.

    Successors are kept relative to their context: what precedes them is added, the last
    of the context before, so the sequence rises over all contexts. A successor is looked
    for from there on, between its context's two pointers. A successor that was not seen
    is a node without probability: only a way to the level below.
    """

    def __init__(self, pointers: np.ndarray, successors: np.ndarray, seen: np.ndarray, folder: str, name: str):
        n = len(pointers) - 1
        own = successors + np.uint64(1)  # so that it is never what precedes it
        kinds = np.diff(pointers)
        owner = np.repeat(np.arange(n), kinds)
        last = np.zeros(n, np.uint64)
        some = np.flatnonzero(kinds)
        last[some] = own[pointers[1:][some] - 1]
        base = np.cumsum(last, dtype=np.uint64) - last
        counts = np.bincount(owner, weights=seen, minlength=n).astype(np.int64)
        types = np.bincount(owner[seen > 0], minlength=n)
        self.pointers = EliasFano(pointers, folder, f"{name}.pointers")
        self.successors = EliasFano(base[owner] + own, folder, f"{name}.successors")
        self.counts = _mapped(counts, folder, f"{name}.counts")
        self.backoff = _mapped(code(np.log10(np.where(counts > 0, DISCOUNT * types / np.maximum(counts, 1), 1.0))), folder, f"{name}.backoff")
        self.codes = _mapped(np.where(seen > 0, code(np.log10(np.maximum(seen - DISCOUNT, DISCOUNT / 4) / np.maximum(counts[owner], 1))), NONE).astype(np.uint16), folder, f"{name}.codes")

    def ask(self, at: np.ndarray, sizes: np.ndarray, successors: np.ndarray) -> tuple[np.ndarray, ...]:
        """(counts and backoff codes of contexts, node and code of each successor) of contexts by their node above, -1 for none, each with ``sizes`` successors. No context has count 0 and a backoff of one."""
        known = np.flatnonzero(at >= 0)
        here = at[known]
        counts, backoff = np.zeros(len(at), np.int64), np.zeros(len(at), np.uint16)
        counts[known], backoff[known] = self.counts[here], self.backoff[here]
        begin, end, base = (np.zeros(len(at), np.int64) for _ in range(3))
        begin[known], end[known] = self.pointers.get(here).astype(np.int64), self.pointers.get(here + 1).astype(np.int64)
        before = known[begin[known] > 0]
        base[before] = self.successors.get(begin[before] - 1).astype(np.int64)
        owner = np.repeat(np.arange(len(at)), sizes)
        node, codes = np.full(len(owner), -1, np.int64), np.full(len(owner), NONE, np.uint16)
        mine = np.flatnonzero(begin[owner] < end[owner])
        of = owner[mine]
        found = self.successors.find(base[of].astype(np.uint64) + successors[mine] + np.uint64(1))
        inside = (found >= begin[of]) & (found < end[of])
        node[mine[inside]], codes[mine[inside]] = found[inside], self.codes[found[inside]]
        return counts, backoff, node, codes


class Trie:
    """First words, their successors, and the successors of both."""

    def __init__(self, words: np.ndarray, two: tuple, three: tuple, folder: str):
        self.words = EliasFano(words >> np.uint64(1), folder, "words")
        self.two, self.three = Level(*two, folder, "two"), Level(*three, folder, "three")

    def ask(self, words: np.ndarray, sizes: np.ndarray, after: np.ndarray, sizes3: np.ndarray, after3: np.ndarray) -> tuple[np.ndarray, ...]:
        """(counts, backoffs of words, codes of bigrams, backoffs of bigrams, codes of trigrams)."""
        counts, backoff, node, codes = self.two.ask(self.words.find(words >> np.uint64(1)), sizes, after)
        _, backoff3, _, codes3 = self.three.ask(node, sizes3, after3)
        return counts, backoff, codes, backoff3, codes3


def _planes(x: np.ndarray, n: int) -> np.ndarray:
    """Integers as byte planes, which squeeze better."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(len(x), 8)[:, :n].T)


def _whole(planes: np.ndarray) -> np.ndarray:
    out = np.zeros(planes.shape[1], np.uint64)
    for p in range(planes.shape[0]):
        out |= planes[p].astype(np.uint64) << np.uint64(8 * p)
    return out


class Tokens:
    """The tokens of a block: distinct words, distinct bigrams and trigrams, and where they occur.

    A bigram is ``before``, ``after`` (places in ``words``), a trigram ``context`` (a place
    in the bigrams), ``last``; both in order, ``seen`` their training counts.
    """

    def __init__(self, data: bytes):
        self.ids, self.known, off, buf, held = blocks.expand(data)
        self.held = held.astype(bool)
        n = len(self.ids)
        h, doc = ta.word_hashes(buf, off)
        count = ta.counts(doc, n)
        # every document is followed by its end, and follows two
        to = np.cumsum(count)
        token = np.insert(h, to, END) if n else h
        self.doc = np.insert(doc, to, np.arange(n)) if n else doc
        self.words, self.token = np.unique(token, return_inverse=True)
        kinds = max(1, len(self.words))
        first = np.cumsum(count + 1) - count - 1
        end = int(np.searchsorted(self.words, END))
        before = np.append(end, self.token[:-1])[: len(token)]
        # two ends are what precedes a document
        pair, self.pair = np.unique(np.append(before * kinds + self.token, end * kinds + end), return_inverse=True)
        ends, self.pair = self.pair[-1], self.pair[:-1]
        self.before, self.after = pair // kinds, pair % kinds
        context = np.append(ends, self.pair[:-1])[: len(token)]
        context[first] = ends
        triple, example, self.triple = np.unique(context * kinds + self.token, return_index=True, return_inverse=True)
        self.context, self.last = triple // kinds, triple % kinds
        #: the last two words of each trigram as a bigram
        self.last_two = self.pair[example]
        taught = ~self.held[self.doc]
        self.seen, self.seen3 = (np.bincount(of, weights=taught, minlength=k).astype(np.int64) for of, k in ((self.pair, len(pair)), (self.triple, len(triple))))
        self.n_tokens = count + 1


def _send(shards: int) -> Callable:
    """A message to each shard, which has a range of hashes of first words."""
    edge = np.array([-(-(s << 64) // shards) for s in range(shards)], np.uint64)

    def run(batches):
        for batch in batches:
            for number, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                t = Tokens(data)
                short = t.words >> np.uint64(64 - WIDE)
                word = np.append(np.searchsorted(t.words, edge), len(t.words))
                pair = np.searchsorted(t.before, word)
                triple = np.searchsorted(t.context, pair)
                for s in range(shards):
                    w, p, q = (slice(x[s], x[s + 1]) for x in (word, pair, triple))
                    if w.start < w.stop:
                        sizes = [np.bincount(of - x.start, minlength=x.stop - x.start).astype(np.uint32) for of, x in ((t.before[p], w), (t.context[q], p))]
                        after = [_planes(short[x], WIDE // 8) for x in (t.after[p], t.last[q])]
                        blob = blocks.squeeze(_planes(np.diff(t.words[w], prepend=np.uint64(0)), 8), sizes[0], after[0], t.seen[p].astype(np.uint32), sizes[1], after[1], t.seen3[q].astype(np.uint32))
                        yield pa.RecordBatch.from_arrays([pa.array([s], pa.int64()), pa.array([number], pa.int64()), pa.array([blob], pa.binary())], ["shard", "block", "blob"])

    return run


def _summed(owner: np.ndarray, after: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, ...]:
    """(owner, successor, count of each n-gram; the n-gram of each row)."""
    gram, index = np.unique((owner.astype(np.uint64) << np.uint64(WIDE)) + after, return_inverse=True)
    return (gram >> np.uint64(WIDE)).astype(np.int64), gram & np.uint64((1 << WIDE) - 1), np.bincount(index, weights=seen, minlength=len(gram)).astype(np.int64), index


def _trie(got: list[tuple], folder: str) -> Trie:
    """The trie of all messages: words, bigrams of each, their successors and counts, trigrams of each, their successors and counts."""
    words, at = np.unique(np.concatenate([x[0] for x in got]), return_inverse=True)
    sizes, after, seen, sizes3, after3, seen3 = (np.concatenate([x[k] for x in got]) for k in range(1, 7))
    owner, after, seen, node = _summed(np.repeat(at, sizes), after, seen)
    owner3, after3, seen3, _ = _summed(np.repeat(node, sizes3), after3, seen3)
    del node, at
    taught = seen3 > 0
    owner3, after3, seen3 = owner3[taught], after3[taught], seen3[taught]
    below = np.bincount(owner3, minlength=len(owner))
    kept = np.flatnonzero((seen > 0) | (below > 0))
    owner, after, seen, below = owner[kept], after[kept], seen[kept], below[kept]
    own = np.bincount(owner, minlength=len(words))
    has = own > 0
    return Trie(words[has], (np.append(0, np.cumsum(own[has])), after, seen), (np.append(0, np.cumsum(below)), after3, seen3), folder)


def _answer(key: tuple, sent: pa.Table) -> pa.Table:
    number = sent.column("block").to_pylist()
    got = []
    for x in sent.column("blob").to_pylist():
        words, sizes, after, seen, sizes3, after3, seen3 = blocks.expand(x)
        got.append((np.cumsum(_whole(words), dtype=np.uint64), sizes, _whole(after).astype(np.uint32), seen, sizes3, _whole(after3).astype(np.uint32), seen3))
    with tempfile.TemporaryDirectory() as folder:
        trie = _trie(got, folder)
        out = [(k, blocks.squeeze(*trie.ask(x[0], x[1], x[2], x[4], x[5])), 0, 0, 0, 0) for k, x in zip(number, got, strict=True)]
        c = np.array(trie.two.counts)
        del trie
    c = c[c > 0]
    out.append((-1, None, int(c.sum()), len(c), int((c == 1).sum()), int((c == 2).sum())))
    kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
    table = pa.table({n: pa.array([x[i] for x in out], t) for i, (n, t) in enumerate(zip(["block", "answer", "n", "v", "n1", "n2"], kinds, strict=True))})
    return table.append_column("shard", pa.array([key[0].as_py()] * len(out), pa.int64()))


def _score(total: int, kinds: int, n1: int, n2: int) -> Callable:
    d1 = n1 / (n1 + 2 * n2) if n1 else 0.5
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    types = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]

    def run(key: tuple, block: pa.Table, told: pa.Table) -> pa.Table:
        out = []
        for data in block.column("blob").to_pylist():
            t = Tokens(data)
            answers = sorted(zip(told.column("shard").to_pylist(), told.column("answer").to_pylist(), strict=True))
            parts = [blocks.expand(x) for _, x in answers]
            c, backoff, codes, backoff3, codes3 = (np.concatenate([x[k] for x in parts]) for k in range(5))
            base = np.log10((c + 0.5) / (total + 0.5 * (kinds + 1)))
            p = np.ones(len(t.context))
            if total:
                single = np.where(c > 0, (c - d1) / total, d1 * kinds / total)
                double = uncode(backoff)[t.before] * single[t.after] + np.where(codes < NONE, uncode(codes), 0.0)
                p = uncode(backoff3)[t.context] * double[t.last_two] + np.where(codes3 < NONE, uncode(codes3), 0.0)
            n = len(t.ids)
            log = np.log10(np.maximum(p, 1e-300))
            cols = [t.ids, t.held, t.n_tokens, np.bincount(t.doc, weights=(c > 0)[t.token], minlength=n).astype(np.int64), np.full(n, total), np.bincount(t.doc, weights=base[t.token], minlength=n), np.bincount(t.doc, weights=log[t.triple], minlength=n)]
            out.append(pa.table({m: pa.array(x, ty, mask=~t.known if m == "doc_id" else None) for m, x, ty in zip(names, cols, types, strict=True)}))
        return pa.concat_tables(out)

    return run


def score(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of ``docs``.

    A null text is empty and has its end as only token. A null doc_id is a training
    document. Equal rows each count. Without training tokens every score is that of
    certainty, 0. An empty table gives an empty result.
    """
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == HELD, F.lit(False))
    n = blocks.buckets(docs)
    table = blocks.write(docs.select("doc_id", "text", held.cast("long").alias("held")), n, ["held"])
    sent = table.mapInArrow(_send(SHARDS * n), "shard long, block long, blob binary")
    told = store.keep(sent.groupBy("shard").applyInArrow(_answer, "block long, answer binary, n long, v long, n1 long, n2 long, shard long"), "answers")
    sums = told.where("block = -1").agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("n", "v", "n1", "n2")]).first()
    answers = told.where("block <> -1").select("shard", "block", "answer")
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return table.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_score(*map(int, sums)), schema)
