"""Documents in compressed blocks, so that whole texts move little and can be met again by block number.

A block holds whole documents of a few megabytes. The table of blocks is bucketed by the
block number: what other stages find out about a block joins it there without moving the
texts again.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tidepool.llm import store, textarrays as ta

#: Bytes of text in a block, about, and blocks in a bucket, about.
BLOCK, PER_BUCKET = 4 << 20, 3
MOST_BUCKETS = 4096


def squeeze(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed value."""
    heads, body = [], b""
    for x in arrays:
        x = np.ascontiguousarray(x)
        heads.append((x.dtype.str, x.shape))
        body += x.tobytes()
    head = repr(heads).encode()
    raw = len(head).to_bytes(4, "little") + head + body
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def expand(blob: bytes) -> list[np.ndarray]:
    import ast

    raw = pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), "zstd", asbytes=True)
    n = int.from_bytes(raw[:4], "little")
    out, at = [], 4 + n
    for kind, shape in ast.literal_eval(raw[4 : 4 + n].decode()):
        x = np.dtype(kind)
        size = x.itemsize * math.prod(shape)
        out.append(np.frombuffer(raw[at : at + size], x).reshape(shape))
        at += size
    return out


def buckets(docs: DataFrame) -> int:
    """Buckets for the texts of ``docs``."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return int(min(MOST_BUCKETS, max(6, size // (BLOCK * PER_BUCKET))))


def write(docs: DataFrame, n: int, extra: list[str] | None = None) -> DataFrame:
    """(block, blob): doc_id (null: the largest integer, with has_id false), ``extra`` long columns, offsets and bytes of whole texts."""
    extra = extra or []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
        for batch in batches:
            for rows, buf, off in ta.slices(batch, "text", BLOCK):
                ids = rows.column(0)
                known = ids.is_valid().to_numpy(zero_copy_only=False)
                ids = ids.fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)
                more = [rows.column(2 + k).fill_null(0).to_numpy(zero_copy_only=False) for k in range(len(extra))]
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([squeeze(ids, known, off, buf, *more)], pa.binary())], ["block", "blob"])
                number += 1

    made = docs.select(F.col("doc_id").cast("long"), "text", *[F.col(c).cast("long") for c in extra]).mapInArrow(run, "block long, blob binary")
    return store.keep_bucketed(made, "blocks", n, "block")
