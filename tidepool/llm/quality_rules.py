"""Quality rules whose cutoffs are certified on labelled documents.

Each rule compares one measure of a text with a cutoff; a stratum's verdict is a set of
rules with cutoffs, and rejects what any of them rejects. Labelled documents fall into
parts by a hash, each used whole. One teaches the insult stems. One orders candidate rules
of each stratum: again and again the cutoff is added that rejects most bad documents for
the clean ones it costs. All others certify: the verdicts of one rule, of
two, and so on, whose order does not depend on it, are tested one after the other until
an exact binomial test can no longer show, at the stated confidence, that the verdict as
a whole rejects at most ALPHA of the stratum's clean documents (fixed sequence, so no
correction is due within a stratum); the confidence is shared out over the strata
(Bonferroni). So the chance that any stratum's verdict exceeds ALPHA is at most DELTA.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidepool.llm import store, textarrays as ta

#: Share of a stratum's clean documents that its verdict may reject.
ALPHA = 0.05
#: Chance that any stratum's verdict exceeds ALPHA.
DELTA = 0.05
#: A rule must reject so many bad labelled documents for each clean one, beyond what earlier rules reject.
WORTH = 20

#: Of so many parts of the labelled documents by a hash the first teaches, the second orders, the others certify.
PARTS = 4
#: Ids of teaching documents that are broadcast at most; beyond it they are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Bytes of a stem; the most stems; documents that must have one; how much more often toxic ones do than clean ones.
STEM, STEMS, LEAST, TIMES = 5, 4096, 4, 25

#: Fixed list: characters that count as symbols.
SYMBOLS = "#*$%&|<>"

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MORE = ["n_lines", "n_upper", "n_letters", "n_marks", "n_distinct", "n_digits", "n_insults"]


def _steps(first: float, last: float, n: int = 24) -> list[float]:
    return [round(first + (last - first) * k / (n - 1), 6) for k in range(n)]


#: rule -> (numerator, denominator, direction, cutoffs from the mildest to the strictest)
RULES: dict[str, tuple[str, str, int, list[float]]] = {
    "long_words": ("word_chars", "n_words", 1, _steps(40, 8)),
    "short_words": ("word_chars", "n_words", -1, _steps(1, 4)),
    "symbols": ("n_symbols", "n_words", 1, _steps(1, 0.01)),
    "repeated_lines": ("n_dup_lines", "n_lines", 1, _steps(0.95, 0.05)),
    "repeated_words": ("n_repeat_words", "n_words", 1, _steps(0.5, 0.02)),
    "capitals": ("n_upper", "n_letters", 1, _steps(1, 0.1)),
    "marks": ("n_marks", "n_words", 1, _steps(2, 0.1)),
    "few_words": ("n_distinct", "n_words", -1, _steps(0.02, 0.5)),
    "digits": ("n_digits", "word_chars", 1, _steps(0.6, 0.02)),
    "insults": ("n_insults", "n_words", 1, [round(0.2 * 0.75**k, 6) for k in range(24)]),
}


def _counted(buf: np.ndarray, off: np.ndarray, insults: np.ndarray) -> dict[str, np.ndarray]:
    n = len(off) - 1
    start, end, doc = ta.words(buf, off)
    running = ta.prefix_hash(buf)
    h = ta.span_hash(running, start, end)
    out = {"n_words": ta.counts(doc, n), "word_chars": ta.per_doc(ta.LEADS[buf] & ~ta.SPACE[buf], off)}
    out["n_symbols"] = ta.per_doc(_SYMBOL[buf], off)
    # lines with a word, and those among them that differ
    a, b, owner = ta.lines(buf, off)
    worded = np.searchsorted(start, b) > np.searchsorted(start, a)
    a, b, owner = a[worded], b[worded], owner[worded]
    out["n_lines"] = ta.counts(owner, n)
    out["n_dup_lines"] = out["n_lines"] - _distinct(ta.span_hash(running, a, b), owner, n)[0]
    # windows of three words found twice or more, and the words they cover
    _, repeated = _distinct_windows(h, doc, n)
    out["n_repeat_words"] = np.bincount(doc, weights=repeated, minlength=n).astype(np.int64)
    out["n_distinct"] = _distinct(h, doc, n)[0]
    out["n_upper"] = ta.per_doc((buf >= 65) & (buf <= 90), off)
    low = ta.LOWER[buf]
    out["n_letters"] = ta.per_doc((low >= 97) & (low <= 122), off)
    out["n_marks"] = ta.per_doc(_MARK[buf], off)
    stems = ta.span_hash(ta.prefix_hash(low), start, np.minimum(end, start + STEM))
    out["n_insults"] = np.bincount(doc, weights=np.isin(stems, insults), minlength=n).astype(np.int64)
    out["n_digits"] = ta.per_doc((buf >= 48) & (buf <= 57), off)
    return out


_SYMBOL = np.isin(np.arange(256), list(SYMBOLS.encode()))
_MARK = np.isin(np.arange(256), list(b"!?|"))


def _distinct(h: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(different hashes of each owner, whether each item occurs twice or more)."""
    key = ta.mix(h + ta.mix(owner.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key, kind="stable")
    new = np.ones(len(key), bool)
    new[1:] = key[order][1:] != key[order][:-1]
    last = np.ones(len(key), bool)
    last[:-1] = new[1:]
    twice = np.zeros(len(key), bool)
    twice[order] = ~(new & last)
    return np.bincount(owner[order][new], minlength=n).astype(np.int64), twice


def _distinct_windows(h: np.ndarray, doc: np.ndarray, n: int, size: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Words that lie in a window of ``size`` words found twice or more in their document."""
    k = max(0, len(h) - size + 1)
    whole = doc[:k] == doc[size - 1 : size - 1 + k]
    window = np.zeros(k, np.uint64)
    for t in range(size):
        window += ta.mix(h[t : t + k] * np.uint64(2 * t + 0x9E3779B1))
    at = np.flatnonzero(whole)
    number, twice = _distinct(window[at], doc[at], n)
    covered = np.zeros(len(h), bool)
    for t in range(size):
        covered[at[twice] + t] = True
    return number, covered


def part() -> Column:
    """The part of a labelled document, from 0 on."""
    return F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(PARTS))


def insult_stems(docs: DataFrame, taught: DataFrame) -> np.ndarray:
    """Hashes of word beginnings that toxic documents have far more often than clean ones; learned from all of ``taught`` (doc_id, _toxic), the labelled documents of part 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, buf, off in ta.slices(batch):
                low = ta.LOWER[buf]
                start, end, doc = ta.words(low, off)
                stems = ta.span_hash(ta.prefix_hash(low), start, np.minimum(end, start + STEM)).view(np.int64)
                toxic = np.array(rows.column(1).to_pylist(), np.int64)
                each = np.unique(np.stack([stems, doc]), axis=1) if len(stems) else np.zeros((2, 0), np.int64)
                found, index = np.unique(each[0], return_inverse=True)
                n, bad = np.bincount(index, minlength=len(found)), np.bincount(index, weights=toxic[each[1]], minlength=len(found))
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(n - bad, pa.int64(), safe=False), pa.array(bad, pa.int64(), safe=False)], ["stem", "clean", "bad"])

    n = {r["_toxic"]: r["count"] for r in taught.groupBy("_toxic").count().collect()}
    few = F.broadcast(taught) if sum(n.values()) <= BROADCAST_IDS else taught
    per_stem = docs.select("doc_id", "text").where(part() == 0).join(few, "doc_id").select("text", "_toxic").mapInArrow(run, "stem long, clean long, bad long").groupBy("stem").agg(F.sum("clean").alias("clean"), F.sum("bad").alias("bad"))
    rate = F.col("bad") / max(1, n.get(1, 0)) / ((F.col("clean") + 0.5) / max(1, n.get(0, 0)))
    top = per_stem.where((F.col("bad") >= LEAST) & (rate >= TIMES)).orderBy(F.desc("bad"), "stem").limit(STEMS).collect()
    return np.array([r["stem"] for r in top], np.int64).view(np.uint64)


def measure(docs: DataFrame, carry: list[str] | None = None, insults: np.ndarray | None = None, text: str = "text") -> DataFrame:
    """``carry`` columns (default doc_id) of each document with its counts; a null text counts as empty."""
    carry = carry or ["doc_id"]
    insults = np.zeros(0, np.uint64) if insults is None else insults
    names = BASE + MORE
    kept = docs.select(*carry, F.col(text).alias("_text"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*carry).schema] + [f"{c} long" for c in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, buf, off in ta.slices(batch, "_text"):
                got = _counted(buf, off, insults)
                yield pa.RecordBatch.from_arrays([rows.column(k) for k in range(len(carry))] + [pa.array(got[c], pa.int64()) for c in names], carry + names)

    return kept.mapInArrow(run, schema)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def ratio(rule: str) -> Column:
    top, bottom, _, _ = RULES[rule]
    return F.col(top) / F.greatest(F.col(bottom), F.lit(1))


def binomial_tail(x: int, n: int, p: float) -> float:
    """P(at most x of n) when each has chance p, by exact summation in logarithms."""
    if x >= n:
        return 1.0
    terms = [math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p) for k in range(x + 1)]
    most = max(terms)
    return min(1.0, math.exp(most) * sum(math.exp(t - most) for t in terms))


def ordered(steps: DataFrame, worth: float = WORTH) -> dict[str, list[tuple[str, int]]]:
    """stratum -> (rule, step) in the order in which they are added to its verdict.

    steps: (_stratum, _clean, s: {rule: the first step whose cutoff rejects}) of the ordering
    documents. The next rule and step is that with the largest gain: bad documents that
    nothing rejects so far, less ``worth`` times the clean ones; of equal gains the one
    with fewer clean ones, then the mildest, then the first rule. Documents are counted by
    Spark, once for each rule that is added; what comes here is counts by rule and step.
    """
    each = F.explode(F.array(*[F.struct(F.lit(place).alias("place"), F.col(f"s.{rule}").alias("step")) for place, rule in enumerate(RULES)])).alias("at")
    rows = steps.select("_stratum", "_clean", "s", each)
    paths = {r["_stratum"]: [] for r in steps.select("_stratum").distinct().collect()}
    growing = set(paths)
    while growing:
        left = F.lit(False)
        for stratum in growing:
            free = F.lit(True)
            for rule, k in paths[stratum]:
                free = free & (F.col(f"s.{rule}") > k)
            left = left | (F.col("_stratum").eqNullSafe(F.lit(stratum)) & free)
        counts = {stratum: np.zeros((2, len(RULES), max(len(r[3]) for r in RULES.values()) + 1), np.int64) for stratum in growing}
        for r in rows.where(left).groupBy("_stratum", "_clean", "at.place", "at.step").count().collect():
            counts[r["_stratum"]][int(r["_clean"]), r["place"], r["step"]] = r["count"]
        for stratum in list(growing):
            best = None
            for place, (rule, (_, _, _, cutoffs_)) in enumerate(RULES.items()):
                bad, good = np.cumsum(counts[stratum][:, place, : len(cutoffs_)], axis=1)
                gain = bad - worth * good
                k = int(np.lexsort((np.arange(len(cutoffs_)), good, -gain))[0])
                if gain[k] > 0 and (best is None or (-gain[k], good[k], k, place) < best[0]):
                    best = (-gain[k], good[k], k, place), rule, k
            if best is None:
                growing.remove(stratum)
            else:
                paths[stratum].append(best[1:])
    return paths


def certified(path: list[tuple[str, int]], clean: list[int], n: int, level: float, alpha: float = ALPHA) -> list[tuple[str, int]]:
    """The rules of ``path`` up to the last whose verdict passes; clean[k]: certifying clean documents, of ``n``, that rule k rejects and none before it."""
    rejected, passed = 0, 0
    for k in range(len(path)):
        rejected += clean[k]
        if n == 0 or binomial_tail(rejected, n, alpha) > level:
            break
        passed = k + 1
    return path[:passed]


def told(labels: DataFrame) -> DataFrame:
    """(doc_id, _clean, _toxic) of the labelled documents: with several labels, clean only if all agree, toxic if any says so; a null label says nothing."""
    toxic = F.coalesce(F.col("toxic"), F.lit(0)) == 1
    clean = (F.col("quality") == 1) & ~toxic
    return labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min(clean.cast("int")).alias("_clean"), F.max(toxic.cast("int")).alias("_toxic"))


def first_step(rule: str) -> Column:
    """The first step of a rule whose cutoff rejects a measured document, the number of steps if none does: cutoffs run from mild to strict."""
    _, _, way, cutoffs = RULES[rule]
    value = ratio(rule)
    return F.size(F.filter(F.array(*map(F.lit, cutoffs)), lambda c: ~(value > c) if way > 0 else ~(value < c)))


def rejects(rule: str, step: int) -> Column:
    cutoff = RULES[rule][3][step]
    return ratio(rule) > cutoff if RULES[rule][2] > 0 else ratio(rule) < cutoff


def cutoffs(measured: DataFrame, known: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> dict[str, list[tuple[str, int]]]:
    """stratum -> certified (rule, step) of ``measured`` documents (with _stratum) that pass the base rule, by the labels in ``known`` (doc_id, _clean, _part)."""
    usable = measured.where(~base_failed()).join(known, "doc_id")
    steps = store.keep(usable.where("_part = 1").select("_stratum", "_clean", F.struct(*[first_step(r).alias(r) for r in RULES]).alias("s")), "ordering")
    paths = ordered(steps)
    rest = usable.where("_part > 1")
    # of each certifying document the first rule of its stratum's path that rejects it
    place = F.lit(None).cast("int")
    for stratum, path in paths.items():
        first = F.coalesce(*[F.when(rejects(rule, k), i) for i, (rule, k) in enumerate(path)], F.lit(len(path)))
        place = F.when(F.col("_stratum").eqNullSafe(F.lit(stratum)), first).otherwise(place)
    held = rest.where("_clean = 1").groupBy("_stratum", place.alias("place")).count().collect()
    strata = {r["_stratum"] for r in held}
    out = {}
    for stratum in strata & set(paths):
        counts = {r["place"]: r["count"] for r in held if r["_stratum"] == stratum}
        path = paths[stratum]
        out[stratum] = certified(path, [counts.get(k, 0) for k in range(len(path))], sum(counts.values()), delta / len(strata), alpha)
    return {k: v for k, v in out.items() if v}


def verdict(certified_: dict[str, list[tuple[str, int]]], stratum: str) -> Column:
    """Whether a measured document passes all rules that are certified for its stratum."""
    passes = F.lit(True)
    for name, rules in certified_.items():
        for rule, k in rules:
            passes = passes & ~(F.col(stratum).eqNullSafe(F.lit(name)) & rejects(rule, k))
    return passes


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang", carry: list[str] | None = None) -> DataFrame:
    """doc_id, the stratum and ``carry`` columns under the names _own_..., with counts, base_failed and kept.

    A null or empty text has no words and fails the base rule. A stratum without enough
    clean labels (null is a stratum too) has no certified cutoff: only the base rule
    holds there. Rows with one doc_id share its label. The result of an empty table is
    empty. What reaches the driver is counts for each stratum, rule and step, and STEMS
    hashes at most.
    """
    known = store.keep(told(labels).withColumn("_part", part()), "known")
    insults = insult_stems(docs, known.where("_part = 0").select("doc_id", "_toxic"))
    own = docs.select("doc_id", F.col(stratum).alias("_stratum"), "text", *[F.col(f"`{c}`").alias(f"_own_{c}") for c in carry or []])
    measured = store.keep(measure(own, ["doc_id", "_stratum", *[f"_own_{c}" for c in carry or []]], insults), "measured")
    found = cutoffs(measured, known.where("_part > 0").select("doc_id", "_clean", "_part"))
    return measured.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & verdict(found, "_stratum"))


def accepted(docs: DataFrame, labels: DataFrame, stratum: str = "lang") -> DataFrame:
    """The rows of ``docs`` that pass, with the columns of ``docs``. Null and empty texts fail; repeated rows pass or fail together; an empty table gives an empty one."""
    return judge(docs, labels, stratum, docs.columns).where("kept").select(*[F.col(f"_own_{c}").alias(c) for c in docs.columns])
