"""Quality classifier from weak labels.

Heuristic labellers vote on every document: good, bad or nothing. Expectation
maximisation over the counts of all vote patterns estimates how each labeller votes on
good and on bad documents, without a true label; a document's posterior follows from its
pattern. The posteriors of a bounded sample of documents train a linear scorer over
hashed features of the text, which then scores all texts. A second head of the scorer
learns insults from a bounded sample of labelled documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidepool.llm import quality_rules, store, textarrays as ta

#: Documents whose posteriors train the quality head; labelled documents that train the insult head.
SAMPLE, LABELLED = 6000, 4000
#: Share of clean labelled documents, scored by a head that hasn't seen them, that the insult head lets pass.
ACCEPTED = 0.99
#: Hashed features.
SIZE = 1 << 16
#: A document is kept if it is at least this likely to be good, and at most this likely to insult.
GOOD, INSULTS = 0.5, 0.5
#: labeller -> (numerator, denominator, bad beyond): votes bad or nothing.
SUSPICIOUS = {
    "capitals": ("n_upper", "n_letters", 0.4),
    "symbols": ("n_symbols", "n_words", 0.15),
    "repeated_words": ("n_repeat_words", "n_words", 0.35),
    "repeated_lines": ("n_dup_lines", "n_lines", 0.4),
    "marks": ("n_marks", "n_words", 0.2),
}
#: Beyond this share of a suspicious labeller's limit a text is no longer ordinary.
ORDINARY = 0.4
#: All labellers, in the order of their votes.
LABELLERS = [*SUSPICIOUS, "variety", "length", "ordinary"]


def votes() -> Column:
    """The vote pattern of a measured document: per labeller 0 bad, 1 nothing, 2 good, as digits of a number to base three."""
    value = {k: F.col(top) / F.greatest(F.col(bottom), F.lit(1)) for k, (top, bottom, _) in SUSPICIOUS.items()}
    variety = F.col("n_distinct") / F.greatest(F.col("n_words"), F.lit(1))
    ordinary = F.lit(True)
    for k, (_, _, bad) in SUSPICIOUS.items():
        ordinary = ordinary & (value[k] <= ORDINARY * bad)
    each = [F.when(value[k] > bad, 0).otherwise(1) for k, (_, _, bad) in SUSPICIOUS.items()]
    each.append(F.when(variety < 0.25, 0).when(variety >= 0.4, 2).otherwise(1))
    each.append(F.when(F.col("n_words") < 15, 0).when(F.col("n_words") >= 40, 2).otherwise(1))
    each.append(F.when(ordinary, 2).otherwise(1))
    out = F.lit(0)
    for vote in each:
        out = out * 3 + vote
    return out.cast("int")


def posteriors(patterns: dict[int, int], rounds: int = 60) -> dict[int, float]:
    """P(good) of each pattern, by expectation maximisation from a weighted vote: a suspicion counts twice."""
    if not patterns:
        return {}
    keys = sorted(patterns)
    n = np.array([patterns[k] for k in keys], float)
    digits = np.array([[k // 3**j % 3 for j in range(len(LABELLERS))] for k in keys])
    p = 1 / (1 + np.exp(-((digits == 2).sum(axis=1) - 2.0 * (digits == 0).sum(axis=1))))
    for _ in range(rounds):
        prior = (n @ p + 1) / (n.sum() + 2)
        log = np.log(prior) - np.log(1 - prior)
        for j in range(digits.shape[1]):
            for v in range(3):
                at = digits[:, j] == v
                good = (n[at] @ p[at] + 0.5) / (n @ p + 1.5)
                bad = (n[at] @ (1 - p[at]) + 0.5) / (n @ (1 - p) + 1.5)
                log = log + at * np.log(good / bad)
        p = 1 / (1 + np.exp(-np.clip(log, -30, 30)))
    return dict(zip(keys, p.tolist(), strict=True))


def features(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashed feature, document, weight): the word beginnings and shapes of each document, weights of one document having norm one."""
    low = ta.LOWER[buf]
    start, end, doc = ta.words(low, off)
    n = len(off) - 1
    stems = ta.span_hash(ta.prefix_hash(low), start, np.minimum(end, start + quality_rules.STEM))
    # shape of a word: capitals and symbols among its bytes, and whether it equals the word before
    shape = np.zeros((3, len(buf) + 1), np.int32)
    np.cumsum((buf >= 65) & (buf <= 90), out=shape[0, 1:])
    np.cumsum(quality_rules._SYMBOL[buf] | quality_rules._MARK[buf], out=shape[1, 1:])
    capital = shape[0, end] - shape[0, start]
    symbol = shape[1, end] - shape[1, start]
    same = np.zeros(len(stems), np.int64)
    same[1:] = (stems[1:] == stems[:-1]) & (doc[1:] == doc[:-1])
    kind = np.minimum(capital, 3) * 12 + np.minimum(symbol, 2) * 4 + same * 2 + (end - start > 25)
    f = np.concatenate([(stems >> np.uint64(5)) % np.uint64(SIZE - 64), (SIZE - 64 + kind).astype(np.uint64)]).astype(np.int64)
    owner = np.concatenate([doc, doc])
    key, count = np.unique(owner * SIZE + f, return_counts=True)
    owner, f = key // SIZE, key % SIZE
    weight = np.sqrt(count)
    norm = np.sqrt(np.bincount(owner, weights=weight**2, minlength=n))
    return f, owner, weight / norm[owner]


def fit(f: np.ndarray, owner: np.ndarray, weight: np.ndarray, target: np.ndarray, use: np.ndarray, rounds: int = 150, rate: float = 20.0) -> np.ndarray:
    """Weights, the last one the bias, of logistic regression on soft targets of the documents in ``use``; classes count equally."""
    w = np.zeros(SIZE + 1)
    good, bad = max(1e-9, target[use].sum()), max(1e-9, (1 - target[use]).sum())
    each = use * (target * 0.5 / good + (1 - target) * 0.5 / bad)
    speed = np.zeros_like(w)
    for _ in range(rounds):
        z = np.bincount(owner, weights=w[f] * weight, minlength=len(target)) + w[-1]
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) * each
        slope = np.bincount(f, weights=error[owner] * weight, minlength=SIZE + 1)
        slope[-1] = error.sum()
        speed = 0.9 * speed - rate * (slope + 1e-6 * w)
        w += speed
    return w


def _train(sample: pd.DataFrame) -> pd.DataFrame:
    text = [(x or "").encode() for x in sample["text"]]
    off = np.concatenate([[0], np.cumsum([len(x) for x in text])]).astype(np.int64)
    buf = np.frombuffer(b"".join(text), np.uint8)
    got = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]]
    for i, j in ta.parts(off, ta.SLICE):
        f, owner, weight = features(buf[off[i] : off[j]], off[i : j + 1] - off[i])
        for x, y in zip(got, (f, owner + i, weight), strict=True):
            x.append(y)
    f, owner, weight = map(np.concatenate, got)
    good, toxic = sample["good"].to_numpy(float), sample["toxic"].to_numpy(float)
    heads = []
    for target in (good, toxic):
        use = ~np.isnan(target)
        heads.append(fit(f, owner, weight, np.nan_to_num(target), use) if use.any() else np.zeros(SIZE + 1))
    return pd.DataFrame({"weights": [np.stack(heads).astype("<f4").tobytes()]})


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, score, insult_score, kept) of every row of ``docs``.

    score is the probability of being good, insult_score that of insulting: the two
    heads. A null or empty text has no features and gets the bias alone; the labellers
    see an empty text. Equal rows get equal results. Without labels insult_score is one
    half and rejects nothing. An empty table gives an empty result. The driver sees the
    counts of vote patterns, of which there are 3 ** len(LABELLERS) at most, and the
    weights.
    """
    measured = store.keep(quality_rules.measure(docs).select("doc_id", votes().alias("pattern")), "votes")
    of = posteriors({r["pattern"]: r["count"] for r in measured.groupBy("pattern").count().collect()})
    known = quality_rules.told(labels)
    order = F.xxhash64("doc_id")
    some = measured.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).orderBy(order, "doc_id").limit(SAMPLE).select("doc_id", "pattern")
    taught = known.where(F.pmod(order, F.lit(2)) == 0).orderBy(order, "doc_id").limit(LABELLED).select("doc_id", F.col("_toxic").cast("double").alias("toxic"))
    chosen = store.keep(some.join(taught, "doc_id", "full"), "sample")
    posterior = pd.Series(of)

    def train(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return _train(rows.drop_duplicates("doc_id").sort_values("doc_id", ignore_index=True).assign(good=lambda x: x["pattern"].map(posterior)))

    # one task fits the scorer: its rows are bounded by SAMPLE + LABELLED
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy(F.lit(0).alias("all")).applyInPandas(train, "weights binary").collect()
    heads = np.frombuffer(rows[0]["weights"], "<f4").reshape(2, -1).astype(float) if rows else np.zeros((2, SIZE + 1))
    shared = docs.sparkSession.sparkContext.broadcast((heads, of))  # SIZE floats for each head

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (good, toxic), weak = shared.value
        for batch in batches:
            for rows, buf, off in ta.slices(batch):
                f, owner, weight = features(buf, off)
                n = len(off) - 1
                p = [1 / (1 + np.exp(-np.clip(np.bincount(owner, weights=w[f] * weight, minlength=n) + w[-1], -30, 30))) for w in (good, toxic)]
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(p[0]), pa.array(p[1])], ["doc_id", "score", "insult_score"])

    scored = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double, insult_score double")
    return scored.withColumn("kept", (F.col("score") >= GOOD) & (F.col("insult_score") <= INSULTS))
