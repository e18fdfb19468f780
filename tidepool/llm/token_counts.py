"""Token counts of whole texts under a unigram model, by dynamic programming over a trie.

The vocabulary is a public one, read by path; the file ranks its pieces, so a piece's
probability is taken as falling with its rank (Zipf). A pre-token is a word with the mark
of a word's beginning. Distinct pre-tokens are inserted in a trie; a node holds the
best score of its prefix and the number of tokens of that segmentation, computed once
however many pre-tokens share it, and a pre-token's count stands at its last node. The
pre-tokens come sorted, so the trie is walked depth first and only the branch at hand is
in memory. A text's count is the sum over its words.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidepool.llm import textarrays as ta

VOCABULARY = "piece_bpe_32k.model"
#: The mark of a word's beginning in the vocabulary.
BEGIN = "▁"
#: The rank that is added to all, in Zipf's law after Mandelbrot.
SHIFT = 2.7
#: How much less likely a byte of a character without a piece is than the rarest piece.
BYTE = -2.0
#: Words whose counts a worker remembers; beyond that it forgets all and goes on.
REMEMBERED = 1_000_000

_WORKER: dict = {}


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def piece_scores(path: str) -> dict[str, float]:
    """Log probability of each ordinary piece of a vocabulary file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    pieces = [model.id_to_piece(i) for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    mass = math.log(sum(1 / (r + SHIFT) for r in range(1, len(pieces) + 1)))
    return {p: -math.log(r + SHIFT) - mass for r, p in enumerate(pieces, 1)}


class PreTokenTrie:
    """Tokens in the best segmentation of pre-tokens; ``nodes`` counts the prefixes that were computed."""

    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self.longest = max(map(len, scores))
        self.byte = min(scores.values()) + BYTE
        self.nodes = 0

    def counts(self, pretokens: list[str]) -> list[int]:
        """Terminal counts of sorted pre-tokens."""
        scores, longest, byte = self.scores, self.longest, self.byte
        branch, best, tokens, out = "", [0.0], [0], []
        for word in pretokens:
            shared, most = 0, min(len(word), len(branch))
            while shared < most and word[shared] == branch[shared]:
                shared += 1
            del best[shared + 1 :], tokens[shared + 1 :]
            for d in range(shared + 1, len(word) + 1):
                # a character that no piece has is so many bytes; any longer piece that ends here may do better
                n = len(word[d - 1].encode("utf-8", "replace"))
                top, count = best[d - 1] + byte * n, tokens[d - 1] + n
                for k in range(max(0, d - longest), d):
                    s = scores.get(word[k:d])
                    if s is not None and best[k] + s > top:
                        top, count = best[k] + s, tokens[k] + 1
                best.append(top)
                tokens.append(count)
            self.nodes += len(word) - shared
            branch = word
            out.append(tokens[-1])
        return out


class WordCounts:
    """Counts of words by their hash, remembered over a worker's batches."""

    def __init__(self, path: str):
        self.trie = PreTokenTrie(piece_scores(path))
        self.known: dict[int, int] = {}

    def of(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = ta.span_hash(ta.prefix_hash(buf), start, end)
        distinct, example, index = ta.distinct(h)
        keys = distinct.tolist()
        if len(self.known) > REMEMBERED:
            self.known = {}
        raw = buf.tobytes()
        new = sorted((BEGIN + raw[start[example[i]] : end[example[i]]].decode("utf-8", "replace"), k) for i, k in enumerate(keys) if k not in self.known)
        self.known.update(zip((k for _, k in new), self.trie.counts([w for w, _ in new]), strict=True))
        return np.fromiter(map(self.known.__getitem__, keys), np.int64, len(keys))[index]


def count(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_words, n_tokens) of every row of ``docs``.

    Null and empty texts have none. Nothing is shuffled, so keys, ties and repeated rows
    don't matter; a text of any length is counted whole. An empty table gives an empty
    result.
    """
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _WORKER:
            _WORKER[path] = WordCounts(path)
        for batch in batches:
            for rows, buf, off in ta.slices(batch):
                start, end, doc = ta.words(buf, off)
                n = len(off) - 1
                tokens = np.bincount(doc, weights=_WORKER[path].of(buf, start, end), minlength=n)
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(ta.counts(doc, n)), pa.array(tokens.astype(np.int64))], ["doc_id", "n_words", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_words long, n_tokens long")
