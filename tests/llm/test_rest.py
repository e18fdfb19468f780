"""Packing, mixing, lines, token counts, weak labels, media copies and the pipeline."""

import hashlib
import random
import zlib
from functools import cache
from itertools import combinations

import brute
import numpy as np
import pytest
from made import SCHEMA
from oracle import compare, connect

from tidepool.llm import line_dedup, media, mixing, packing, quality_model, queries, token_counts


@cache
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.tokenizer_path())


def direct_ids(text, end=True):
    return tokenizer().encode(text or "", add_special_tokens=False).ids + [packing.END] * end


def check_packed(rows, texts):
    want = {(i, p): (at, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, t in texts for ids in [direct_ids(t)] for p, at in enumerate(range(0, len(ids), 2048)) for x in [ids[at : at + 2048]]}
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows} == want
    assert len(rows) == len(want)
    for members in brute.by(rows, "sequence_id").values():
        at = 0
        for r in sorted(members, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
    return len({r["sequence_id"] for r in rows})


def test_packing(docs, texts):
    rows = packing.pack(packing.pieces(docs)).collect()
    used = check_packed(rows, texts)
    assert used <= -(-sum(r["length"] for r in rows) // 2048) + 1


def test_ids_are_those_of_whole_texts():
    """Word by word the same ids as the tokenizer's over whole texts of odd characters."""
    rng = random.Random(2)
    odd = ["a", "B", "7", ".", ",", "..", "'s", "'", "n't", "é", "é", "İ", "ß", "日", "🙂", " ", " ", "\u0085", "​", "\x00", "\x01", "\x1f", "<|", "<|endoftext|>", "<|startoftext|>", "|>", "-", "_", " ", " ", "\n", "\t", "\x0b", "ǅ", "́", "Ω", "x.", "9,"]
    texts = ["".join(rng.choice(odd) for _ in range(rng.randint(0, 25))) for _ in range(600)]
    texts += ["".join(x for x in t if x.isascii() and ord(x) > 2) for t in texts]
    words = packing.WordIds(packing.tokenizer_path())
    for t in texts:
        data = t.encode()
        got, _ = words.encode(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
        assert got.tolist() == direct_ids(t, end=False), repr(t)


def test_swaps_only_improve():
    rng = np.random.default_rng(4)
    sizes = rng.integers(1, 1400, 700)
    bins = packing.best_fit(sizes, 2048)
    before, squares = len(bins), sum(int(sizes[b].sum()) ** 2 for b in bins)
    after = packing.improve(sizes, [list(b) for b in bins], 2048)
    assert sorted(i for b in after for i in b) == list(range(len(sizes)))
    assert all(sizes[b].sum() <= 2048 for b in after)
    assert len(after) <= before
    assert sum(int(sizes[b].sum()) ** 2 for b in after) >= squares


def test_swap_empties_a_bin_that_best_fit_leaves():
    sizes = np.array([5, 5, 4, 3, 3])  # largest first leaves three bins of ten
    bins = packing.improve(sizes, [[0, 2], [1, 3], [4]], 10)
    assert len(bins) == 2


def test_packing_in_many_cells(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(["word"] * rng.randint(1, 1500))) for i in range(1, 1200)]
    cut = packing.pieces(spark.createDataFrame(rows, "doc_id long, text string"))
    got = packing.pack(cut, cell=100).collect()
    used = check_packed(got, rows)
    assert used <= 1.02 * sum(r["length"] for r in got) / 2048 + 1


def test_mixing_against_sql(spark):
    compare(spark, connect(), queries.op6_mixing, queries.oracle_sql()["op6_mixing"])


def test_mixing_meets_targets(docs):
    rows = mixing.mix(docs).collect()
    total = sum(r["size"] for r in rows)
    by_source = brute.by(rows, "source")
    assert sum(v[0]["target"] for v in by_source.values()) == pytest.approx(min(total, sum(3 * v[0]["source_size"] for v in by_source.values())))
    for members in by_source.values():
        taken, most = sum(r["taken"] for r in members), max(r["size"] for r in members)
        assert abs(taken - members[0]["target"]) <= 2 * most
        assert all(r["taken"] <= 3 * r["size"] for r in members)
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in rows) == sorted((r["doc_id"], r["taken"]) for r in again)
    assert sum(r["copies"] for r in rows) == mixing.repeated(docs).count()


def wanted_lines(texts):
    """{doc_id: numbers of lines to take out} by edit distances of all pairs of lines."""
    everything = brute.lines(texts)
    forms = sorted({n for _, _, _, n in everything}, key=len)
    linked = []
    for k, a in enumerate(forms):
        for b in forms[k + 1 :]:
            may = int(0.1 * len(b))
            if len(b) - len(a) > may:
                break
            if brute.edit_distance(a, b) <= may:
                linked.append((a, b))
    of, first = brute.groups(set(forms), linked), {}
    own = {i: t for i, t in texts}
    for i, k, _, n in sorted(everything, key=lambda x: x[:2]):
        first.setdefault(of[n], (i, k))
    return {i: {k for j, k, _, n in everything if j == i and first[of[n]] != (i, k)} for i in own}, len(linked)


def test_lines(spark, docs, texts):
    """The lines taken out are those that edit distances of all pairs of lines tell."""
    short = [(i, t) for i, t in texts if len(t or "") < 4000]
    gone, linked = wanted_lines(short)
    assert linked > 4 and any(gone.values())
    some = docs.where(docs["doc_id"].isin([i for i, _ in short]))
    left = {r["doc_id"]: r["text"] for r in line_dedup.clean(some).collect()}
    digest = {r["doc_id"]: r for r in line_dedup.digest(some).collect()}
    for i, t in short:
        want = None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i])
        assert left[i] == want
        assert digest[i]["kept_sha256"] == hashlib.sha256((want or "").encode()).hexdigest()
        assert digest[i]["n_removed"] == len(gone[i])
    # what the pipeline keeps: documents with something left, or that lose nothing
    full = {i for i, _ in short if not gone[i] or left[i].strip()}
    assert {r["doc_id"] for r in line_dedup.clean(some, emptied=False).collect()} == full


def edited(rng, line, kind):
    at = rng.randrange(1, len(line) - 1)
    if kind == "added":
        return line[:at] + "q" + line[at:]
    if kind == "removed":
        return line[:at] + line[at + 1 :]
    if kind == "changed":
        return line[:at] + ("x" if line[at] != "x" else "y") + line[at + 1 :]
    out = list(line)
    for k in rng.sample(range(len(line)), int(kind * len(line))):
        out[k] = rng.choice("abcdefghijklmnopqrstuvwxyz")
    return "".join(out)


@pytest.mark.parametrize("least, most", [(16, 28), (31, 59), (62, 98), (105, 190), (210, 390), (420, 980), (1200, 2500)])
def test_recall_of_edited_lines(spark, least, most):
    """Every line once more with a character added, removed or changed, and with 5% changed: nine of ten and more are found, and nothing that isn't within the bound."""
    rng = random.Random(least)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 8)))
    rows, kinds = [], ["added", "removed", "changed", 0.05]
    for n in range(120):
        line, size = word(), rng.randint(least, most)
        while len(line) < size:
            line += " " + word()
        for k, text in enumerate([line, edited(rng, line, kinds[n % 4])]):
            rows.append((10 * n + k, " ".join(text.split())))
    gone = {r["doc_id"] for r in line_dedup.digest(spark.createDataFrame(rows, "doc_id long, text string")).where("n_removed = 1").collect()}
    of = dict(rows)
    for i in gone:
        assert i % 10 == 1 and brute.edit_distance(of[i], of[i - 1]) <= int(0.1 * max(len(of[i]), len(of[i - 1])))
    for k, kind in enumerate(kinds):
        due = [10 * n + 1 for n in range(120) if n % 4 == k and brute.edit_distance(of[10 * n], of[10 * n + 1]) <= int(0.1 * max(len(of[10 * n]), len(of[10 * n + 1])))] if most < 1000 or kind == 0.05 else [10 * n + 1 for n in range(120) if n % 4 == k]
        assert sum(i in gone for i in due) >= 0.9 * len(due), (kind, len(due))


def test_long_lines_by_pieces():
    """Never closer than the edit distance, and close ones are found."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdeé日") for _ in range(rng.randint(2, 7)))
    found = []
    for _ in range(30):
        a = " ".join(word() for _ in range(rng.choice([90, 150])))
        b = "".join(c if rng.random() > rng.choice([0.01, 0.05, 0.14]) else rng.choice(["", "x", c + "y"]) for c in a)
        may = int(0.1 * max(len(a), len(b)))
        x, y = (np.frombuffer(t.encode("utf-32-le"), "<u4").astype(np.int64) for t in (a, b))
        true, got = brute.edit_distance(a, b) <= may, line_dedup.few_edits(x, y, may)
        assert not got or true
        found.append(got == true)
    assert sum(found) >= 28


def test_texts_that_share_a_doc_id(spark):
    """Lines and copies are taken from the text that they are in, not from other texts under its doc_id."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghijklm") for _ in range(6))
    one, two, three = (" ".join(word() for _ in range(60)) for _ in range(3))
    rows = [(1, one), (2, one + " end"), (2, two), (2, three), (2, two)]
    docs = spark.createDataFrame([(i, t, None, None, 0) for i, t in rows], SCHEMA)
    kept = sorted((r["doc_id"], r["text"]) for r in queries.near_dedup.representatives(docs).collect())
    assert kept == sorted([(1, one), (2, two), (2, three)])
    left = sorted((r["doc_id"], r["text"]) for r in line_dedup.clean(docs).collect())
    assert left == sorted([(1, one), (2, ""), (2, two), (2, three), (2, two)])


def test_a_copied_document_leaves_no_remnant(spark, pipeline):
    """A document, its edited copy with a line of its own and a third text: line dedup takes the shared lines out of the copy, and no shortened copy of them is left."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklm") for _ in range(6))
    lines = [" ".join(word() for _ in range(12)) for _ in range(9)]
    copied = [x + "s" for x in lines]
    other = "\n".join(" ".join(word() for _ in range(12)) for _ in range(6))
    rows = [(1, "\n".join(lines)), (2, "\n".join(copied)), (3, other)]
    docs = spark.createDataFrame([(i, t, "en", "web", len(t)) for i, t in rows], SCHEMA)
    left = pipeline.lines(spark, docs, "").collect()
    assert sorted((r["doc_id"], r["text"]) for r in left) == [(1, rows[0][1]), (3, other)]


def test_a_pending_result_outlives_a_pipeline_stage(spark, pipeline, docs, labels, tmp_path):
    """A stage deletes what the stage before it wrote, and nothing else."""
    pending = queries.near_dedup.link(docs)
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    first = pipeline.quality(spark, docs, str(tmp_path))
    first.write.parquet(f"{tmp_path}/first.parquet")
    pipeline.lines(spark, spark.read.parquet(f"{tmp_path}/first.parquet"), str(tmp_path)).collect()
    assert pending.count() == docs.count()


def test_wide_ids_and_taken_names(spark):
    """Ids of all 64 bits, and further columns named as the operators name theirs."""
    names = ["_tie", "_class", "_salt", "_rank", "_id", "_gone", "_own", "c0", "c1", "of", "n", "tie", "class", "salt", "rank", "lines", "hash", "once", "nth"]
    text = " ".join(f"word{i}" for i in range(80))
    rows = [(i, f"{text} {i}" if i % 2 else text, "en", "web", 5, *range(len(names))) for i in (2**63 - 1, -(2**63), 2**62 + 1, 7)]
    docs = spark.createDataFrame(rows, SCHEMA + "".join(f", {c} long" for c in names))
    wanted = {tuple(r)[5:] for r in docs.collect()}
    for out in (mixing.mix(docs).select(*docs.columns), mixing.repeated(docs), line_dedup.clean(docs), queries.near_dedup.representatives(docs)):
        assert out.columns == docs.columns
        assert {tuple(r)[5:] for r in out.collect()} == wanted
    assert mixing.mix(docs).count() == 4


def test_token_counts(docs, texts):
    path = token_counts.vocabulary_path()
    scores = token_counts.piece_scores(path)
    byte = min(scores.values()) + token_counts.BYTE
    got = {r["doc_id"]: (r["n_words"], r["n_tokens"]) for r in token_counts.count(docs).collect()}
    for i, t in texts:
        w = [x.decode() for x in brute.words(t)]
        assert got[i] == (len(w), sum(brute.unigram_tokens(token_counts.BEGIN + x, scores, byte) for x in w))


def test_trie_computes_a_shared_prefix_once():
    trie = token_counts.PreTokenTrie({"a": -1.0, "ab": -1.5, "b": -1.0, "c": -2.0})
    assert trie.counts(["a", "ab", "abc", "abcc", "b"]) == [1, 1, 2, 3, 1]
    assert trie.nodes == 5


def test_weak_labels_find_the_accurate_labeller():
    """Labellers of known accuracy: posteriors are right more often than any single vote."""
    rng = random.Random(8)
    n = len(quality_model.LABELLERS)
    patterns, truth = {}, {}
    for _ in range(4000):
        good = rng.random() < 0.7
        vote = [(2 if good == (rng.random() < 0.9) else 0) if rng.random() < 0.6 else 1 for _ in range(n)]
        key = int("".join(map(str, reversed(vote))), 3)
        patterns[key] = patterns.get(key, 0) + 1
        truth.setdefault(key, []).append(good)
    p = quality_model.posteriors(patterns)
    right = sum((p[k] > 0.5) == g for k, gs in truth.items() for g in gs)
    assert right > 0.93 * 4000


@pytest.mark.parametrize("sf, toxic", [("sf0.01", 1.0), ("sf0.1", 0.3)])
def test_classifier_on_held_out_labels(spark, sf, toxic):
    """Shares of held-out documents that are kept; sf0.01 has too few insulting ones to learn from."""
    sf = f"/root/testdata/{sf}"
    got = queries.op4_quality_model(spark, sf)
    labels = queries.table(spark, sf, "labels")
    order = "pmod(xxhash64(doc_id), 2) = 1"
    r = got.join(labels, "doc_id").where(order).selectExpr("avg(CASE WHEN quality = 1 AND toxic = 0 THEN int(kept) END) clean", "avg(CASE WHEN quality = 0 THEN int(kept) END) bad", "avg(CASE WHEN quality = 1 AND toxic = 1 THEN int(kept) END) toxic").first()
    assert r["clean"] > 0.96
    assert r["bad"] < 0.5
    assert r["toxic"] <= toxic


def test_copies_are_found_and_strangers_are_not(spark):
    """Scenes and their edits: cropped, scaled, turned, paler, with noise. Classes are those of the scenes, for nine of ten edits and more; no two scenes are one class."""
    rng = np.random.default_rng(6)
    rows, of = [], {}
    for n in range(12):
        x = media.scene(rng.normal(size=16))
        made = [x, *[media.edited(x, 6 * n + k) for k in range(6)], media.resize(x, 67, 67), media.resize(x, 134, 134), media.turned(x, 0.17), x[20:90, 10:100]]
        for k, y in enumerate(made):
            rows.append((100 * n + k, media.encode(np.ascontiguousarray(y)), 1, "x"))
            of[100 * n + k] = 100 * n
    got = {r["id"]: r["class_id"] for r in media.copies(spark.createDataFrame(rows, "id long, image binary, key long, node string")).collect()}
    assert all(of[c] == of[i] for i, c in got.items())
    assert sum(got[i] == of[i] for i in got) >= 0.9 * len(got)


def test_strangers_by_brute_force():
    """Of all pairs of forty scenes none agrees, and each agrees with its edit."""
    rng = np.random.default_rng(8)
    scenes = [media.scene(rng.normal(size=8)) for _ in range(40)]
    told = [media.describe(np.rint(x)) for x in scenes]
    assert not any(media.agree(*told[i], *told[j]) >= media.AGREE for i, j in combinations(range(40), 2))
    edits = [media.describe(np.clip(np.rint(media.edited(x, k)), 0, 255)) for k, x in enumerate(scenes)]
    assert sum(media.agree(*a, *b) >= media.AGREE for a, b in zip(told, edits, strict=True)) >= 36


def test_odd_images(spark):
    x = media.scene(np.arange(9.0))
    rows = [(1, media.encode(x)), (1, media.encode(x)), (2, media.encode(x)), (3, None), (4, b""), (5, b"not an image"), (6, media.encode(np.full((60, 60), 9.0))), (7, b"\xff\xd8\xff\xe0 jpeg"), (8, b"P5 9 9"), (9, b"\x89PNG\r\n\x1a\n"), (None, media.encode(x))]
    got = sorted((str(r["id"]), r["format"], r["decoded"], r["class_id"], r["kept"]) for r in media.copies(spark.createDataFrame(rows, "id long, image binary")).collect())
    assert got == sorted([("1", "pgm", True, 1, True)] * 2 + [("2", "pgm", True, 1, False), ("3", None, False, 3, True), ("4", None, False, 4, True), ("5", None, False, 5, True), ("6", "pgm", True, 6, True), ("7", "jpeg", False, 7, True), ("8", "pgm", False, 8, True), ("9", "png", False, 9, True), ("None", "pgm", True, None, True)], key=str)


@pytest.mark.parametrize("colour, n", [(0, 1), (2, 3), (4, 2), (6, 4)])
def test_png_round_trip(colour, n):
    """A row of each filter type."""
    rng = np.random.default_rng(colour)
    x = rng.integers(0, 256, (10, 7, n))
    raw = b""
    zero = np.zeros(n, int)
    for y in range(10):
        line = []
        for k in range(7):
            a, b, c = x[y, k - 1] if k else zero, x[y - 1, k] if y else zero, x[y - 1, k - 1] if k and y else zero
            guess = {0: zero, 1: a, 2: b, 3: (a + b) // 2}.get(y % 5)
            if guess is None:
                guess = np.array([min((abs(p + q - r - v), m, v) for m, v in enumerate((p, q, r)))[2] for p, q, r in zip(a.tolist(), b.tolist(), c.tolist(), strict=True)])
            line.append((x[y, k] - guess) % 256)
        raw += bytes([y % 5]) + np.array(line, np.uint8).tobytes()
    chunk = lambda name, body: len(body).to_bytes(4, "big") + name + body + b"crc!"
    packed = zlib.compress(raw)
    data = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", (7).to_bytes(4, "big") + (10).to_bytes(4, "big") + bytes([8, colour, 0, 0, 0])) + chunk(b"IDAT", packed[:9]) + chunk(b"IDAT", packed[9:]) + chunk(b"IEND", b"")
    want = x[:, :, : n - (colour in (4, 6))].mean(axis=2)
    assert np.allclose(media.decode(data), want, atol=1e-3)


def test_comments_in_headers():
    assert media.decode(b"P5 # a word\n2 # wide\n 1\n255\n\x05\x06").tolist() == [[5.0, 6.0]]
    assert media.decode(b"P5 2 1 65535\n\x05\x06\x07\x08") is None


@pytest.fixture(scope="module")
def pipeline():
    return pytest.importorskip("corpus_pipeline")


def test_pipeline_stages_decide(spark, pipeline, docs, labels, tmp_path):
    """Each stage keeps the columns of documents and passes on what its operator keeps; packing places every document."""
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    now, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for k, (_, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, now, str(tmp_path))
        out.write.parquet(f"{tmp_path}/stage{k}.parquet")
        seen.append((now, spark.read.parquet(f"{tmp_path}/stage{k}.parquet")))
        if k < 4:
            assert seen[-1][1].dtypes == docs.dtypes
        now = seen[-1][1]
    (raw, ruled), (_, lined), (_, lone), (_, mixed), (_, packed) = seen
    texts_of = lambda df: [(r["doc_id"], r["text"]) for r in df.collect()]
    assert all(not brute.rules(t)[5] for _, t in texts_of(ruled))
    assert {i for i, _ in texts_of(lined)} == {r["doc_id"] for r in line_dedup.clean(ruled).collect() if (r["text"] or "").strip()}
    want = brute.near(texts_of(lined))
    assert sorted(i for i, _ in texts_of(lone)) == sorted(i for i, (_, _, kept) in want.items() if kept)
    copies = brute.by(mixing.mix(lone).collect())
    assert {i: len(v) for i, v in brute.by(mixed.collect()).items()} == {i: v[0]["copies"] for i, v in copies.items() if v[0]["copies"]}
    rows = packed.collect()
    whole = brute.by(rows)
    for i, members in brute.by(mixed.collect()).items():
        assert sum(r["length"] for r in whole[i]) == len(members) * len(direct_ids(members[0]["text"]))
    run = pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in run) == sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in rows)


EACH = {
    "repeats": lambda d, lab: queries.repeats.remove(d),
    "near": lambda d, lab: queries.near_dedup.link(d),
    "representatives": lambda d, lab: queries.near_dedup.representatives(d),
    "rules": lambda d, lab: queries.quality_rules.judge(d, lab),
    "accepted": lambda d, lab: queries.quality_rules.accepted(d, lab),
    "lm": lambda d, lab: queries.ngram.score(d),
    "lines": lambda d, lab: line_dedup.clean(d),
    "digest": lambda d, lab: line_dedup.digest(d),
    "mix": lambda d, lab: mixing.mix(d),
    "repeated": lambda d, lab: mixing.repeated(d),
    "tokens": lambda d, lab: token_counts.count(d),
    "model": lambda d, lab: quality_model.classify(d, lab),
    "packing": lambda d, lab: packing.pack(packing.pieces(d)),
}


@pytest.mark.parametrize("name", sorted(EACH))
def test_empty_tables(empty, no_labels, name):
    assert EACH[name](empty, no_labels).collect() == []


@pytest.mark.parametrize("name", sorted(EACH))
def test_nulls_repeats_and_clashing_columns(odd, labels, name):
    got = EACH[name](odd, labels).collect()
    rows = odd.collect()
    if name in ("representatives", "accepted", "repeated"):
        assert {tuple(r) for r in got} <= {tuple(r) for r in rows}
        assert EACH[name](odd, labels).columns == odd.columns
    elif name == "lines":
        assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["size"]) for r in got) == sorted((r["doc_id"] is None, r["doc_id"] or 0, r["size"]) for r in rows)
        assert EACH[name](odd, labels).dtypes == odd.dtypes
    else:
        assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r["doc_id"]) for r in rows)


def test_accepted_rows_come_whole(spark, labels):
    """A clashing column keeps its own values."""
    text = " ".join(f"word{i}" for i in range(80))
    one = spark.createDataFrame([(1, text, "en", "web", 5, 77, 88)], SCHEMA + ", n_words long, size long")
    assert queries.quality_rules.accepted(one, labels).first()["n_words"] == 77
    assert mixing.repeated(one).first()["size"] == 88


def test_media_of_an_empty_table(spark):
    assert media.copies(spark.createDataFrame([], "id long, image binary")).collect() == []
    assert media.copies(media.pictures(spark.createDataFrame([(1, None), (None, [0.1, 0.2])], "vec_id long, embedding array<float>"))).count() == 3


def test_queries_run_on_the_given_tables(spark):
    sf = "/root/testdata/sf0.001"
    for name, query in queries.queries().items():
        rows = query(spark, sf).count()
        assert rows >= queries.table(spark, sf, "embeddings" if name.startswith("op1_") else "documents").count()


def test_white_space_that_loses_no_line_stays(spark):
    rows = [(1, "   "), (2, " \n "), (3, ""), (4, None), (5, "one two three four"), (6, "one two three four"), (7, "one two three four\n  \n")]
    got = line_dedup.clean(spark.createDataFrame(rows, "doc_id long, text string"), emptied=False).collect()
    assert sorted(map(tuple, got)) == sorted(rows[:5])


def plain_unfiltered(filters, lines):
    h, w, n = lines.shape
    out = np.zeros((h + 1, w + 1, n), int)
    for y, x, k in np.ndindex(h, w, n):
        a, b, c = out[y + 1, x, k], out[y, x + 1, k], out[y, x, k]
        guesses = [0, a, b, (a + b) // 2, min((a, b, c), key=lambda g: abs(a + b - c - g))]
        out[y + 1, x + 1, k] = (int(lines[y, x, k]) + guesses[filters[y]]) % 256
    return out[1:, 1:]


@pytest.mark.parametrize("shape, top", [((7, 11, 3), 5), ((11, 7, 1), 5), ((1, 9, 4), 5), ((9, 1, 2), 5), ((6, 6, 3), 3)])
def test_png_filters(shape, top):
    rng = np.random.default_rng(3)
    filters, lines = rng.integers(0, top, shape[0]).astype(np.uint8), rng.integers(0, 256, shape).astype(np.uint8)
    assert (media._unfiltered(filters, lines) == plain_unfiltered(filters, lines)).all()
    assert media._unfiltered(filters + 5, lines) is None


def test_png_that_unpacks_to_more_than_it_declares():
    def png(w, h, body):
        head = w.to_bytes(4, "big") + h.to_bytes(4, "big") + bytes([8, 0, 0, 0, 0])
        return b"\x89PNG\r\n\x1a\n" + b"".join(len(b).to_bytes(4, "big") + n + b + b"crc!" for n, b in ((b"IHDR", head), (b"IDAT", zlib.compress(body))))

    assert media.decode(png(4, 2, bytes(10 + 50_000_000))).shape == (2, 4)
    assert media.decode(png(4, 2, bytes(9))) is None
    assert media.decode(png(1 << 20, 1 << 20, bytes(100))) is None
