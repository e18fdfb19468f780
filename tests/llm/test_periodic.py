"""Periodic runs against every stretch of every period."""

import hashlib
import random
import zlib

import pytest
from made import SCHEMA
from pyspark.sql import functions as F

from tidepool.llm import periodic


def brute_runs(words, least=12):
    """All maximal stretches of each period by plain comparison; the smallest period of each."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i >= q and j - i + q >= least:
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


def planted(doc_id, text):
    words = text.encode().split()
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i if i < a else a + (i - a) % p] for i in range(n)]


def expected(doc_id, text):
    words = planted(doc_id, text or "")
    runs = brute_runs(words)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(((-n, s, q) for s, n, q in runs), default=None)
    four = (best[1], -best[0], best[2], -best[0] * 1000 // best[2]) if best else (None,) * 4
    sha = [hashlib.sha256(x).hexdigest() for x in ("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode(), b" ".join(w for i, w in enumerate(words) if i not in gone))]
    return (doc_id, len(runs), *four, *sha)


def got(df):
    return sorted(map(repr, map(tuple, periodic.digest(df).collect())))


@pytest.mark.parametrize("seed", range(40))
def test_runs_are_all_and_maximal(seed):
    rng = random.Random(seed)
    letters = [b"a", b"b", b"c", b"d"][: rng.choice([1, 2, 2, 3, 4])]
    texts = []
    for _ in range(rng.randint(1, 25)):
        words = [rng.choice(letters) for _ in range(rng.randint(0, 40))]
        for _ in range(rng.randint(0, 4)):
            root = [rng.choice(letters) for _ in range(rng.randint(1, 30))]
            words += (root * rng.randint(1, 6))[: rng.randint(1, 99)] + [rng.choice(letters) for _ in range(rng.randint(0, 20))]
        texts.append(words)
    for least in (12, 5, 2):
        assert periodic.runs(texts, least) == [brute_runs(w, least) for w in texts]


def test_words_of_fibonacci_and_thue_morse():
    fib = ["a", "ab"]
    while len(fib[-1]) < 1500:
        fib.append(fib[-1] + fib[-2])
    morse = "".join("ab"[bin(i).count("1") % 2] for i in range(2048))
    texts = [[c.encode() for c in t] for t in (fib[-1], morse, morse * 2, "a" * 700)]
    assert periodic.runs(texts) == [brute_runs(w) for w in texts]


def test_words_outside_of_repeated_grams_are_masked():
    import numpy as np

    ids = np.arange(400)
    assert periodic.surviving(ids) == []
    ids[100:120] = ids[80:100]  # a run of 40 words
    ids[300:306] = ids[10:16]  # a repeated gram, too short to hold a run
    assert periodic.surviving(ids) == [(80, 120)]


def test_search_in_many_rounds(monkeypatch):
    rng = random.Random(3)
    texts = [[rng.choice([b"x", b"y"]) for _ in range(rng.randint(0, 90))] for _ in range(60)]
    monkeypatch.setattr(periodic, "AT_ONCE", 64)
    assert periodic.runs(texts) == [brute_runs(w) for w in texts]


def test_query_by_brute_force(spark, docs, texts):
    rng = random.Random(8)
    more = [(1000 + i, " ".join(rng.choice(["on", "and", "over"]) for _ in range(rng.randint(0, 160)))) for i in range(60)]
    table = spark.createDataFrame([(i, t, "en", "web", 0) for i, t in more], SCHEMA)
    short = [(i, t) for i, t in texts if len(t or "") < 20_000]  # plain comparison takes the square of the words
    assert got(docs.where(F.col("doc_id").isin([i for i, _ in short])).unionByName(table).transform(periodic.planted)) == sorted(repr(expected(i, t)) for i, t in short + more)
    assert got(docs.transform(periodic.planted))


def test_whole_queries_table_by_brute_force(spark):
    """The registered query over the whole smallest table; long texts by their surviving stretches alone would hide a wrong mask, so all periods are compared."""
    from tidepool.llm import queries

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert sorted(map(repr, map(tuple, queries.op12_periodic_runs(spark, "/root/testdata/sf0.001").collect()))) == sorted(repr(expected(i, t)) for i, t in rows)


def test_odd_tables(spark, odd, empty):
    assert periodic.digest(empty).count() == 0
    rows = odd.collect()
    out = periodic.digest(odd).collect()
    assert sorted(map(repr, map(tuple, out))) == sorted(repr(expected(None, r["text"]) if r["doc_id"] is None else (r["doc_id"], *expected(None, r["text"])[1:])) for r in rows)
    kept = periodic.find(odd)
    assert kept.columns[: len(odd.columns)] == odd.columns and kept.count() == len(rows)
