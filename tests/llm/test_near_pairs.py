"""Which pairs near-dedup forms."""

import numpy as np

from tidepool.llm import near_dedup


def test_documents_that_share_a_passage_are_not_paired(spark, monkeypatch):
    """Only pairs that the bits of their sets don't tell apart are formed; links are those of all pairs."""
    met, inner = [], near_dedup.similar
    monkeypatch.setattr(near_dedup, "similar", lambda pairs, *more: met.append(pairs.count()) or inner(pairs, *more))
    passage = " ".join(f"common{k}" for k in range(100))
    rows = [(i, passage + " " + " ".join(f"own{i}x{k}" for k in range(100))) for i in range(40)]
    rows.append((40, rows[7][1] + " more"))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.link(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: c for i, (_, c, _) in got.items()} == {i: 7 if i == 40 else i for i in range(41)}
    assert sum(met) == 1


def test_bits_of_similar_sets():
    rng = np.random.default_rng(4)
    both = [rng.integers(0, 1 << 62, n) for n in (3, 30, 300, 3000)]
    pairs = [(np.union1d(x, rng.integers(0, 1 << 62, len(x) // 3)), x) for x in both]
    bits = near_dedup.minhash_bits([y for pair in pairs for y in pair] + [np.zeros(0, np.int64)]).view(np.uint64)
    assert (np.bitwise_count(bits[0:8:2] ^ bits[1:8:2]).sum(axis=1) <= near_dedup.DIFFER).all()
    assert not bits[8].any()
    assert np.bitwise_count(bits[0] ^ bits[4]).sum() > near_dedup.DIFFER
