"""Whole texts as byte arrays: words, lines and their 64-bit hashes for many documents at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: The white space of the word pattern [^\x20\x09-\x0D]+.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes that begin a code point in UTF-8.
LEADS = (np.arange(256) & 0xC0) != 0x80
#: Bytes of text handled at once; one longer document is handled alone.
SLICE = 1 << 20

_P = np.uint64(0x9E3779B97F4A7C55)
_PINV = np.uint64(pow(int(_P), -1, 1 << 64))
_POWERS: list[np.ndarray] = [np.ones(0, np.uint64)] * 2


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits all depend on all input bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def _powers(n: int) -> list[np.ndarray]:
    if len(_POWERS[0]) <= n:
        size = 1 << max(16, int(n).bit_length())
        for k, base in enumerate((_P, _PINV)):
            _POWERS[k] = np.ones(size, np.uint64)
            _POWERS[k][1:] = base
            np.multiply.accumulate(_POWERS[k], out=_POWERS[k])
    return _POWERS


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    """Running polynomial hash of the bytes, one longer than ``buf``; see ``span_hash``."""
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTE[buf] * _powers(len(buf))[0][: len(buf)], out=out[1:])
    return out


def span_hash(running: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each span of bytes: equal bytes have equal hashes wherever they stand."""
    down = _powers(len(running))[1]
    return mix((running[end] - running[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, offsets); a null text is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "").cast(pa.large_binary())
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return buf, off - off[0]


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """The batch in runs of whole documents of about ``limit`` bytes: (rows, bytes, offsets)."""
    if not batch.num_rows:
        return
    buf, off = texts(batch.column(batch.schema.get_field_index(column)))
    for at, to in parts(off, limit):
        yield batch.slice(at, to - at), buf[off[at] : off[to]], off[at : to + 1] - off[at]


def parts(off: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Runs (first, end) of whole documents of about ``limit`` bytes."""
    at, n = 0, len(off) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
        yield at, to
        at = to


def words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document) of every word; a word never crosses documents."""
    inside = ~SPACE[buf]
    before, after = np.zeros(len(buf), bool), np.zeros(len(buf), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    cut = off[(off > 0) & (off < len(buf))]
    before[cut], after[cut - 1] = False, False
    start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return start, end, np.searchsorted(off, start, "right") - 1


def word_hashes(buf: np.ndarray, off: np.ndarray, fold: np.ndarray = LOWER) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of every word of any amount of text, in bounded memory; ``fold`` maps bytes first."""
    hashes, docs = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for i, j in parts(off, SLICE):
        own, bounds = fold[buf[off[i] : off[j]]], off[i : j + 1] - off[i]
        start, end, doc = words(own, bounds)
        hashes.append(span_hash(prefix_hash(own), start, end))
        docs.append(doc + i)
    return np.concatenate(hashes), np.concatenate(docs)


def lines(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document) of every line split at \\n; an empty text has one empty line."""
    breaks = np.flatnonzero(buf == 10)
    doc = np.searchsorted(off, breaks, "right") - 1
    start = np.concatenate([off[:-1], breaks + 1])
    end = np.concatenate([off[1:], breaks])
    owner = np.concatenate([np.arange(len(off) - 1), doc])
    a, b = np.lexsort((start, owner)), np.lexsort((end, owner))
    return start[a], end[b], owner[a]


def distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted distinct values, a place of each, which one each item is)."""
    order = np.argsort(h)
    in_order = h[order]
    new = np.ones(len(h), bool)
    new[1:] = in_order[1:] != in_order[:-1]
    index = np.empty(len(h), np.int64)
    index[order] = np.cumsum(new) - 1
    return in_order[new], order[new], index


def per_doc(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sum of a value per byte (or per item) over each document."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[off[1:]] - total[off[:-1]]


def counts(doc: np.ndarray, n: int) -> np.ndarray:
    """Items per document."""
    return np.bincount(doc, minlength=n).astype(np.int64)


def shingles(hashes: np.ndarray, doc: np.ndarray, n: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of each run of ``size`` words; a document with fewer words has its whole sequence as one."""
    count = counts(doc, n)
    first = np.concatenate([[0], np.cumsum(count)])
    odd = mix(np.arange(1, size + 1, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019)) | np.uint64(1)
    out = np.zeros(max(0, len(hashes) - size + 1), np.uint64)
    for t in range(size):
        out += mix(hashes[t : t + len(out)] * odd[t])
    whole = np.flatnonzero(doc[: len(out)] == doc[size - 1 : size - 1 + len(out)])
    got, owner = mix(out[whole]), doc[whole]
    for d in np.flatnonzero((count > 0) & (count < size)):
        h = np.uint64(count[d])
        with np.errstate(over="ignore"):
            for t, x in enumerate(hashes[first[d] : first[d + 1]]):
                h += mix(np.array([x * odd[t]], np.uint64))[0]
        got, owner = np.append(got, mix(np.array([h ^ np.uint64(0x5851F42D4C957F2D)], np.uint64))), np.append(owner, d)
    order = np.argsort(owner, kind="stable")
    return got[order], owner[order]
