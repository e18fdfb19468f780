"""Repeats, near-dedup, rules and language model against brute force."""

import math
import random

import brute
import pytest
from made import SCHEMA, sentence
from pyspark.sql import Window as W, functions as F

from tidepool.llm import near_dedup, ngram, quality_rules, repeats


def table(spark, rows, parts=4):
    return spark.createDataFrame([(i, t, "en", "web", 0) for i, t in rows], SCHEMA).repartition(parts)


def repeats_of(df):
    return {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in repeats.remove(df).collect()}


def test_repeats_are_those_of_all_substrings(docs, texts):
    assert repeats_of(docs) == brute.repeats(texts)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_repeats_of_periodic_and_overlapping_texts(spark, seed):
    rng = random.Random(seed)
    passage = sentence(rng, 40)
    made = ["a" * 350, "ab" * 180, "x" * 99, "x" * 100, "x" * 101, passage, "q" + passage[7:], passage[:120] + passage[60:] + passage[:130]]
    made += [sentence(rng, 20) + passage[a : a + rng.randint(95, 140)] + sentence(rng, 9) for a in (0, 3, 30, 31)]
    made += ["".join(rng.choice("ab") for _ in range(90)) * rng.randint(1, 4) for _ in range(6)]
    rng.shuffle(made)
    rows = list(enumerate(made, 1))
    assert repeats_of(table(spark, rows)) == brute.repeats(rows)


def near_of(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.link(df).collect()}


def test_near_copies_are_those_of_all_pairs(docs, texts):
    assert near_of(docs) == brute.near(texts)


@pytest.mark.parametrize("seed", [1, 2])
def test_near_copies_at_the_threshold_and_in_chains(spark, seed):
    rng = random.Random(seed)
    rows, shared = [], sentence(rng, 25)
    for family in range(12):
        base = [rng.choice("abcdefghij") + str(rng.randint(0, 999)) for _ in range(rng.choice([4, 7, 20, 40, 150, 400]))]
        for _ in range(5):
            rows.append(" ".join(base) + (" " + shared if family % 3 == 0 else ""))
            for _ in range(max(1, len(base) // 60)):  # drifts on: a chain whose ends aren't alike
                base[rng.randrange(len(base))] = "new" + str(rng.randint(0, 9999))
    rows = list(enumerate(rows, 1))
    assert near_of(table(spark, rows)) == brute.near(rows)


def test_rules_count_as_the_contract_says(docs, labels, texts):
    got = {r["doc_id"]: r for r in quality_rules.judge(docs, labels).collect()}
    assert len(got) == len(texts)
    for i, t in texts:
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == brute.rules(t), i
        assert not (r["base_failed"] and r["kept"])


def test_binomial_bound_is_exact():
    for x, n, p in ((0, 10, 0.1), (3, 40, 0.05), (40, 40, 0.5), (2, 1000, 0.01)):
        assert quality_rules.binomial_tail(x, n, p) == pytest.approx(sum(math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(x + 1)))


def test_verdicts_hold_their_bound_per_stratum():
    """Three rules whose verdicts reject 3, 6 and 9 of a hundred clean documents: one beyond five is used in few samples."""
    rng = random.Random(1)
    path, wrong, used = [("symbols", 3), ("digits", 2), ("marks", 1)], 0, 0
    for _ in range(300):
        drawn = [rng.choices(range(4), [3, 3, 3, 91])[0] for _ in range(1500)]
        got = quality_rules.certified(path, [drawn.count(k) for k in range(3)], 1500, 0.05)
        wrong += len(got) > 1
        used += len(got) > 0
    assert wrong <= 0.05 * 300
    assert used > 0.9 * 300
    assert quality_rules.certified(path, [0, 0, 0], 59, 0.05) == path
    assert quality_rules.certified(path, [0, 0, 0], 58, 0.05) == []  # too few to be sure


def test_all_labels_order_the_rules(spark):
    """Of many labelled documents the bad ones are the last by their hash, and each of two strata has a rule of its own."""
    n = 9000
    own = spark.range(n + 400).withColumnRenamed("id", "doc_id").withColumn("nth", F.row_number().over(W.orderBy(F.xxhash64("doc_id"))))
    bad = (F.col("nth") > n) & (F.col("doc_id") < n)
    part = F.when(F.col("doc_id") < n, 1).otherwise(2).cast("long")
    known = own.select("doc_id", F.when(bad, 0).otherwise(1).alias("_clean"), part.alias("_part"))
    stratum = F.when(F.col("doc_id") % 2 == 0, "even")
    fixed = {"n_words": 100, "word_chars": 500, "n_lines": 10, "n_letters": 500, "n_distinct": 80}
    counts = [F.lit(fixed.get(c, 0)).cast("long").alias(c) for c in quality_rules.BASE + quality_rules.MORE if c not in ("n_symbols", "n_marks")]
    measured = own.select("doc_id", stratum.alias("_stratum"), *counts, F.when(bad & stratum.isNull(), 90).otherwise(0).alias("n_symbols"), F.when(bad & stratum.isNotNull(), 150).otherwise(0).alias("n_marks"))
    found = quality_rules.cutoffs(measured, known)
    assert {k: [rule for rule, _ in v] for k, v in found.items()} == {None: ["symbols"], "even": ["marks"]}


def plain_kept(rows, labels, part):
    """kept of measured documents, with rules ordered and certified by scans in plain Python."""
    q = quality_rules
    first = {}
    for r in rows:
        for rule, (top, bottom, way, cuts) in q.RULES.items():
            value = r[top] / max(r[bottom], 1)
            first[r["doc_id"], rule] = next((k for k, c in enumerate(cuts) if (value > c if way > 0 else value < c)), len(cuts))
    usable = [r for r in rows if not r["base_failed"] and r["doc_id"] in labels and part[r["doc_id"]] > 0]
    ordering = [r for r in usable if part[r["doc_id"]] == 1]
    strata = {r["_stratum"] for r in usable if part[r["doc_id"]] > 1 and labels[r["doc_id"]]}
    kept = {}
    for stratum in {r["_stratum"] for r in rows}:
        left, path = [r for r in ordering if r["_stratum"] == stratum], []
        while True:
            best = None
            for place, rule in enumerate(q.RULES):
                for k in range(len(q.RULES[rule][3])):
                    hit = [labels[r["doc_id"]] for r in left if first[r["doc_id"], rule] <= k]
                    gain = sum(not c for c in hit) - q.WORTH * sum(hit)
                    key = (-gain, sum(hit), k, place)
                    if gain > 0 and (best is None or key < best[0]):
                        best = key, rule, k
            if best is None:
                break
            path.append(best[1:])
            left = [r for r in left if first[r["doc_id"], best[1]] > best[2]]
        clean = [r for r in usable if r["_stratum"] == stratum and part[r["doc_id"]] > 1 and labels[r["doc_id"]]]
        used = 0
        for k in range(1, len(path) + 1):
            x, n = sum(any(first[r["doc_id"], rule] <= at for rule, at in path[:k]) for r in clean), len(clean)
            if n == 0 or sum(math.comb(n, j) * q.ALPHA**j * (1 - q.ALPHA) ** (n - j) for j in range(x + 1)) > q.DELTA / len(strata):
                break
            used = k
        for r in rows:
            if r["_stratum"] == stratum:
                kept[r["doc_id"]] = not r["base_failed"] and not any(first[r["doc_id"], rule] <= at for rule, at in path[:used])
    return kept


def test_kept_is_that_of_plain_scans(spark):
    from tidepool.llm.queries import table as read

    docs, labels = (read(spark, "/root/testdata/sf0.01", x) for x in ("documents", "labels"))
    rows = [r.asDict() for r in quality_rules.judge(docs, labels).collect()]
    told = {r["doc_id"]: r["_clean"] for r in quality_rules.told(labels).collect()}
    part = {r[0]: r[1] for r in labels.selectExpr("doc_id", f"pmod(xxhash64(doc_id), {quality_rules.PARTS})").collect()}
    want = plain_kept(rows, told, part)
    assert {r["doc_id"]: r["kept"] for r in rows} == want
    assert any(not r["base_failed"] and not r["kept"] for r in rows)  # a stratum has labels enough


def test_language_model(docs, texts):
    got = {r["doc_id"]: r for r in ngram.score(docs).collect()}
    base, full = brute.unigram(texts), brute.trigram(texts)
    for i, _ in texts:
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == base[i][:4]
        assert r["base_score"] == pytest.approx(base[i][4])
        # three codes at most make a probability, each rounded down by less than a part
        assert full[i] - 3 / ngram.PARTS * r["n_tokens"] - 1e-6 <= r["score"] <= full[i] + 1e-6


def test_model_is_better_than_words_alone_on_held_out_texts(spark):
    from tidepool.llm.queries import table as read

    got = ngram.score(read(spark, "/root/testdata/sf0.001", "documents")).where("held_out").agg({"score": "sum", "base_score": "sum"}).first()
    assert got["sum(score)"] > got["sum(base_score)"]


def test_probabilities_of_a_context_sum_to_one_at_most(tmp_path):
    import numpy as np

    rng = np.random.default_rng(3)
    kinds = rng.integers(1, 30, 40)
    successors = np.concatenate([np.sort(rng.choice(1 << ngram.WIDE, k, replace=False)) for k in kinds]).astype(np.uint64)
    seen = rng.integers(1, 9, len(successors))
    pointers = np.concatenate([[0], np.cumsum(kinds)])
    counts = np.add.reduceat(seen, pointers[:-1])
    level = ngram.Level(pointers, successors, seen, str(tmp_path), "one")
    assert level.pointers.get(np.arange(41)).tolist() == pointers.tolist()
    assert isinstance(level.codes, np.memmap) and isinstance(level.successors.low, np.memmap)
    c, backoff, node, codes = level.ask(np.arange(40), kinds, successors)
    assert c.tolist() == counts.tolist() and node.tolist() == list(range(len(seen)))
    assert (codes != ngram.NONE).all()
    mass = np.add.reduceat(ngram.uncode(codes), pointers[:-1]) + ngram.uncode(backoff)
    assert (mass <= 1 + 1e-9).all() and (mass > 0.85).all()
    other = level.ask(np.full(40, -1), np.ones(40, int), successors[:40])
    assert (other[0] == 0).all() and (other[1] == 0).all() and (other[2] == -1).all() and (other[3] == ngram.NONE).all()
    wrong = level.ask(np.arange(40), np.ones(40, int), (successors[pointers[:-1]] + np.uint64(1)))[3]
    assert (wrong == ngram.NONE).mean() > 0.9


@pytest.mark.parametrize("seed", [1, 2])
def test_successors_are_those_of_their_context(tmp_path, seed):
    """Every successor asked of every context, contexts without any among them."""
    import numpy as np

    rng = np.random.default_rng(seed)
    few = (np.arange(8).astype(np.uint64) << np.uint64(ngram.WIDE - 3)) + np.uint64(5)
    own = [np.sort(rng.choice(few, rng.integers(0, 8), replace=False)) for _ in range(30)]
    own[0], own[1], own[2] = few[-1:], few[:0], few[:1]  # a context's first follows the last of the one before
    kinds = np.array([len(x) for x in own])
    pointers = np.concatenate([[0], np.cumsum(kinds)])
    seen = rng.integers(0, 5, pointers[-1])
    level = ngram.Level(pointers, np.concatenate(own), seen, str(tmp_path), "two")
    _, _, _, codes = level.ask(np.arange(30), np.full(30, 8), np.tile(few, 30))
    want = np.full((30, 8), ngram.NONE, np.uint16)
    for k, x in enumerate(own):
        n = seen[pointers[k] : pointers[k + 1]]
        told = [ngram.code(np.log10((c - ngram.DISCOUNT) / n.sum())) if c else ngram.NONE for c in n]
        want[k, np.isin(few, x)] = told
    assert codes.reshape(30, 8).tolist() == want.tolist()
    none = ngram.Level(np.zeros(1, int), few[:0], seen[:0], str(tmp_path), "none")
    assert none.ask(np.full(30, -1), kinds, np.concatenate(own))[3].tolist() == [ngram.NONE] * len(seen)


@pytest.mark.parametrize("low", [0, 5, 40])
def test_elias_fano_round_trip(tmp_path, low):
    import numpy as np

    rng = np.random.default_rng(low)
    x = np.sort(rng.integers(0, 1 << (low + 6), 500))
    x = np.unique(x)
    e = ngram.EliasFano(x, str(tmp_path), "x")
    assert e.get(np.arange(len(x))).tolist() == x.tolist()
    assert e.find(x).tolist() == list(range(len(x)))
    absent = np.setdiff1d(rng.integers(0, 1 << (low + 7), 500), x)
    assert (e.find(absent) == -1).all()
    assert (ngram.EliasFano(np.zeros(0, np.int64), str(tmp_path), "none").find(x) == -1).all()
