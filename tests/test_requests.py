"""Batches of claims, reviews and follows against handling them one by one; documents, feeds and stored files."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tidepool.operators import feed, requests as R
from tidepool.plans import media, registry  # noqa: F401
from tidepool.sources import content, tables


def one_by_one_claims(asked, stored, users, venues):
    had = {(c["user_id"], c["venue_id"]): dict(c) for c in stored}
    out = []
    for r in sorted(asked, key=lambda r: r["seq"]):
        u, v = r["user_id"], r["venue_id"]
        if u not in users or v not in venues:
            out.append((r["seq"], "not_found", False))
            continue
        own = had.get((u, v))
        note = (r["note"] or "").strip()[:1000]
        domain = (users[u] or "").split("@")[-1]
        if own and own["status"] == "verified":
            out.append((r["seq"], "unchanged", False))
        elif domain and domain == venues[v]:
            if any(c["status"] == "verified" and k[1] == v for k, c in had.items()):
                out.append((r["seq"], "conflict", False))
            else:
                had[u, v] = {"status": "verified", "method": "domain", "note": own and own["note"]}
                out.append((r["seq"], "verified", own is None))
        elif note:
            had[u, v] = {"status": "pending", "method": "manual", "note": note}
            out.append((r["seq"], "manual", own is None))
        elif own is None:
            had[u, v] = {"status": "pending", "method": None, "note": None}
            out.append((r["seq"], "pending", True))
        else:
            out.append((r["seq"], "kept", False))
    return out, sorted((*k, c["status"], c["method"], c["note"]) for k, c in had.items())


@pytest.mark.parametrize("seed", range(3))
def test_claims(spark, seed):
    rng = random.Random(seed)
    venues = {v: f"v{v % 3}.test" if v < 4 else "" for v in range(5)}
    users = {u: rng.choice([f"A@V{u % 3}.test".lower(), "me@mail.test", "", None]) for u in range(8)}
    pairs = rng.sample([(u, v) for u in users for v in venues], 10)
    stored = [{"user_id": u, "venue_id": v, "status": rng.choice(["pending", "denied", "verified"]), "method": None, "note": rng.choice([None, "old"])} for u, v in pairs]
    asked = [{"seq": i, "user_id": rng.choice([*users, 99]), "venue_id": rng.choice([*venues, 77, None]), "note": rng.choice(["", None, "  ", f" mine {i} ", "x" * 1200])} for i in range(120)]
    claim = "user_id long, venue_id long, status string, method string, note string"
    got, after = R.claimed(
        spark.createDataFrame(asked, "seq long, user_id long, venue_id long, note string"), spark.createDataFrame(stored, claim),
        spark.createDataFrame(list(users.items()), "user_id long, email string"), spark.createDataFrame([(v, f"https://www.{w}/x" if w else None) for v, w in venues.items()], "venue_id long, website string"),
    )
    want, want_after = one_by_one_claims(asked, stored, users, venues)
    assert sorted((r.seq, r.outcome, r.created) for r in got.collect()) == sorted(want)
    rows = [(r.user_id, r.venue_id, r.status, r.note) for r in after.collect()]
    assert sorted(rows, key=str) == sorted([(u, v, s, n) for u, v, s, _, n in want_after], key=str)


GOOD = {"name": "A", "neighborhood": "N", "address": "1 St", "phone": "", "website": "https://a.test", "source_url": "", "days": ["Monday"], "start_time": "16:00", "end_time": "18:00", "deals": ["x"], "vibe": "bar", "lat": 1.0, "lng": 2.0, "image": ""}
LISTING = "name string, neighborhood string, address string, phone string, website string, source_url string, days array<string>, start_time string, end_time string, deals array<string>, vibe string, lat double, lng double, image string"
NONE = dict.fromkeys(GOOD)


def one_by_one_reviews(commands, stored, top):
    state = {s["submission_id"]: {"status": s["status"], "reason": s["denial_reason"], "id": s["published_id"], "listing": {k: s[k] for k in GOOD}, "first": {k: s[k] for k in GOOD}} for s in stored}
    shown, new, out = {}, 0, []
    for c in sorted(commands, key=lambda c: c["seq"]):
        s = state.get(c["submission_id"])
        if s is None:
            out.append((c["seq"], "not_found", None, None))
            continue
        listing = {k: c[k] for k in GOOD} if c["name"] is not None else s["first"]
        bad, placed = not listing["name"].strip(), listing["lat"] is not None
        did = "bad_action"
        if c["action"] == "deny":
            did, s["status"], s["reason"] = "denied", "denied", c["reason"]
        elif c["action"] in ("edit", "approve"):
            if bad or (not placed and (c["action"] == "approve" or s["status"] == "approved")):
                did = "invalid"
            elif s["status"] == "approved" and s["id"] is not None:
                did, s["listing"] = "updated", listing
                shown[s["id"]] = listing["name"]
            elif c["action"] == "approve":
                did, s["listing"], s["status"], s["id"] = "published", listing, "approved", ("new", c["seq"])
                shown[s["id"]] = listing["name"]
                new += 1
            else:
                did, s["listing"] = "edited", listing
        out.append((c["seq"], did, s["status"], s["id"] if did in ("updated", "published") else None))
    return out, state, shown, new


@pytest.mark.parametrize("seed", range(3))
def test_reviews(spark, seed):
    rng = random.Random(seed)

    def listing(i):
        return {**GOOD, "name": rng.choice([f"L{i}", f"L{i}", " "]), "lat": rng.choice([1.0, 1.0, None])}

    stored = [{"submission_id": i, "status": rng.choice(["pending", "approved", "denied"]), "denial_reason": None, "published_id": rng.choice([None, i + 1]), **listing(f"s{i}"), "name": f"S{i}"} for i in range(6)]
    for s in stored:
        s["published_id"] = s["published_id"] if s["status"] == "approved" else None
    commands = [{"seq": i, "submission_id": rng.choice([*range(6), 50]), "action": rng.choice(["approve", "approve", "edit", "edit", "deny", "what", None]), "reason": f"r{i}", **(listing(i) if rng.random() < 0.6 else NONE)} for i in range(90)]
    catalogue = [{"venue_id": i, **GOOD, "name": f"V{i}"} for i in range(1, 11)]
    got, subs, venues = R.reviewed(
        spark.createDataFrame(commands, f"seq long, submission_id long, action string, reason string, {LISTING}"), spark.createDataFrame(stored, f"submission_id long, status string, denial_reason string, published_id long, {LISTING}"),
        spark.createDataFrame(catalogue, f"venue_id long, {LISTING}"),
    )
    want, state, shown, new = one_by_one_reviews(commands, stored, 10)
    rows = {r.seq: r for r in got.collect()}
    assert [(q, rows[q].outcome, rows[q].status) for q, *_ in want] == [w[:3] for w in want]
    ids = {("new", q): r.venue_id for q, r in rows.items() if r.outcome == "published"}
    assert sorted(ids.values()) == list(range(11, 11 + new))  # numbered on, each once
    assert all(rows[q].venue_id == ids.get(v, v) for q, _, _, v in want)
    after = {r.submission_id: r for r in subs.collect()}
    assert {k: (r.status, r.denial_reason, r.published_id, r.name, r.lat) for k, r in after.items()} == {k: (s["status"], s["reason"], ids.get(s["id"], s["id"]), s["listing"]["name"], s["listing"]["lat"]) for k, s in state.items()}
    names = {**{c["venue_id"]: c["name"] for c in catalogue}, **{ids.get(k, k): n for k, n in shown.items()}}
    assert {r.venue_id: r.name for r in venues.collect()} == names


def test_approving_twice_makes_one_venue(spark):
    stored = spark.createDataFrame([{"submission_id": 1, "status": "pending", "denial_reason": None, "published_id": None, **GOOD}], f"submission_id long, status string, denial_reason string, published_id long, {LISTING}")
    commands = spark.createDataFrame([{"seq": i, "submission_id": 1, "action": "approve", "reason": None, **NONE} for i in (1, 2)], f"seq long, submission_id long, action string, reason string, {LISTING}")
    got, _, venues = R.reviewed(commands, stored, spark.createDataFrame([], f"venue_id long, {LISTING}"))
    assert [(r.outcome, r.venue_id) for r in got.orderBy("seq").collect()] == [("published", 1), ("updated", 1)]
    assert venues.count() == 1


def test_follows(spark):
    patch = "seq long, user_id long, venue_id long, happy_hour boolean, promotion boolean, channel_email boolean, channel_text boolean"
    follow = "user_id long, venue_id long, happy_hour boolean, promotion boolean, channel_email boolean, channel_text boolean"
    patches = spark.createDataFrame([(1, 1, 1, None, None, None, None), (2, 1, 1, True, None, None, True), (3, 1, 1, None, False, None, None), (4, 2, 1, None, None, False, None), (5, 9, 1, True, True, True, True), (6, 1, 9, True, True, True, True)], patch)
    got, after = R.followed(patches, spark.createDataFrame([(2, 1, True, False, True, True), (3, 1, None, None, None, None)], follow), spark.createDataFrame([(1,), (2,), (3,)], "user_id long"), spark.createDataFrame([(1,)], "venue_id long"))
    assert [tuple(r)[3:] for r in got.orderBy("seq").collect()] == [
        ("created", False, True, True, False), ("changed", True, True, True, True), ("changed", True, False, True, True), ("changed", True, False, False, True), ("user_not_found", None, None, None, None), ("venue_not_found", None, None, None, None),
    ]
    assert sorted(map(tuple, after.collect())) == [(1, 1, True, False, True, True), (2, 1, True, False, False, True), (3, 1, None, None, None, None)]


def test_empty_batches(spark):
    claim = "user_id long, venue_id long, status string, method string, note string"
    none = lambda s: spark.createDataFrame([], s)
    got, after = R.claimed(none("seq long, user_id long, venue_id long, note string"), spark.createDataFrame([(1, 2, "pending", None, "n")], claim), none("user_id long, email string"), none("venue_id long, website string"))
    assert got.count() == 0 and [tuple(r) for r in after.collect()] == [(1, 2, "pending", None, "n")]


def header(*lines, body="B"):
    return "---\n" + "\n".join(lines) + "\n---\n" + body


def test_headers(spark):
    three = ("title: T", "description: D", "pubDate: 2026-01-02")
    docs = [
        header(*three), header(*three, "draft: true", "venues: [a-b, 'c d', \"e, f\"]", "author: \"X \\\"Y\\\"\""), header("title: 7", "description: true", "pubDate: 2026-02-30"), header(*three, "venues: [a, 7]", "draft: 1", "heroImage: [x]"),
        header(*three, "venues:", "aiGenerated: no"), "no header", "", None, "---\ntitle: T\nno end", header(*three, "title: again").replace("\n", "\r\n"),
    ]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(docs)], "doc_id long, text string, errors string")
    got = {r.doc_id: r for r in content.entries(df).collect()}
    assert [got[i].errors for i in range(10)] == [
        [], [], ["title:text", "description:text", "pubDate:date"], ["draft:flag", "venues:texts", "heroImage:text"], ["venues:texts", "aiGenerated:flag"],
        *[["title:missing", "description:missing", "pubDate:missing"]] * 4, [],
    ]
    assert (got[0].draft, got[0].author, got[0].venues, got[0].ai_generated, got[0].hero_image, got[0].body) == (False, "Editors", [], False, None, "B")
    assert (got[1].draft, got[1].author, got[1].venues) == (True, 'X "Y"', ["a-b", "c d", "e, f"])
    assert [got[i].body for i in (5, 6, 7, 8)] == ["no header", "", "", "---\ntitle: T\nno end"]
    assert got[9].title == "T" and got[9].body == "B"
    assert [r.doc_id for r in content.published(content.entries(df)).collect()] == [0, 9]


def element(**change):
    good = {"id": "1", "venueId": 2, "venue": {"id": 2, "name": "N", "slug": "n", "neighborhood": "", "image": ""}, "type": "event", "title": "T", "description": "", "state": "live", "hasDealCode": False, "startsAt": "2026-01-01T10:00:00Z", "endsAt": "2026-01-01T12:00:00Z", "effectiveEndsAt": "2026-01-01T11:00:00.000Z"}
    return {k: v for k, v in {**good, **change}.items() if v != "-"}


def test_feed_elements(spark):
    good = [element(), element(dealCode=None), element(hasDealCode=True), element(hasDealCode=True, dealCode="X"), element(effectiveEndsAt="2026-01-01T12:00:00Z")]
    bad = [
        element(id=1), element(id=" "), element(id="-"), element(venueId=3), element(venueId="2"), element(venueId=2.5), element(venue=None), element(venueId=-2, venue={**element()["venue"], "id": -2}), element(type="flash"), element(title=" "), element(description=None),
        element(state="ended"), element(hasDealCode="true"), element(dealCode="X"), element(hasDealCode=True, dealCode=""), element(hasDealCode=True, dealCode=None), element(startsAt="2026-01-01T11:00:00Z"), element(effectiveEndsAt="2026-01-01T12:00:01Z"), element(endsAt="soon"), 7, None, [],
    ]
    df = spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(good + bad)], "i long, x string")
    got = {r.i: r.ok for r in df.select("i", feed.valid(F.try_parse_json("x")).alias("ok")).collect()}
    assert [got[i] for i in range(len(good + bad))] == [True] * len(good) + [False] * len(bad)


def test_feed_payloads(spark):
    page = lambda *items, now="2026-01-01T10:30:00Z": json.dumps({"serverNow": now, "promotions": list(items)})
    rows = [page(element(), element(id="2")), page(element(), element(state="ended")), page(), page(element(), now=None), "{", None, "[]", json.dumps({"serverNow": "x", "promotions": {}})]
    got = feed.promotions(spark.createDataFrame(list(enumerate(rows)), "page long, payload string"), ["page"]).collect()
    assert sorted((r.page, r.reason or "", r.id or "") for r in got) == [(0, "", "1"), (0, "", "2"), (1, "invalid", ""), (2, "", ""), *[(i, "malformed", "") for i in range(3, 8)]]


def test_files(spark, tmp_path):
    where = f"file://{tmp_path}/files"
    tables.put_files(spark.createDataFrame([("a.md", "one\n\ntwo\n"), ("b.c.md", "x\n\n"), ("none.md", None), ("x.json", '[{"k": 1}, {"k": 2, "s": "t"}]')], "name string, text string"), where)
    tables.put_files(spark.createDataFrame([("a.md", "again")], "name string, text string"), where)
    assert sorted(map(tuple, tables.documents(spark, f"{where}/*.md").collect())) == [("a", "again"), ("b.c", "x\n\n")]  # none of the empty one
    assert sorted(map(tuple, tables.catalogue(spark, f"{where}/*.json", "k long, s string, none string").collect())) == [(1, None, None), (2, "t", None)]


def test_text_files_are_listed_by_folder(spark, tmp_path):
    """One folder is listed, not each file; files below it and of other endings aren't read."""
    for name in ("a.md", "b-c.md", "c.txt", "sub/d.md", "k=1/e.md", f"sub/{tmp_path.name}/f.md"):
        where = tmp_path / name
        where.parent.mkdir(parents=True, exist_ok=True)
        where.write_text(name)
    found = tables.documents(spark, f"file://{tmp_path}/*.md")
    assert sorted(map(tuple, found.collect())) == [("a", "a.md"), ("b-c", "b-c.md")]
    assert f"{tmp_path}]" in found._jdf.queryExecution().executedPlan().toString().replace("a.md", "?")


def test_files_in_many_folders_are_not_listed_by_the_driver(spark, tmp_path):
    where = f"file://{tmp_path}/files"
    texts = [(f"doc-{k}.md", f"text {k}\n") for k in range(50)] + [("a.b.md", "é\n\n"), ("none.md", None), ("x.json", "{}"), ("_hidden.md", "h")]
    tables.put_files(spark.createDataFrame(texts, "name string, text string"), where, 7)
    tables.put_files(spark.createDataFrame([("doc-3.md", "again")], "name string, text string"), where, 7)
    found = tables.dealt_documents(spark, where, "*.md", 7)
    want = {(name[:-3], text) for name, text in texts if text and name.endswith(".md") and name[0] != "_"} - {("doc-3", "text 3\n")} | {("doc-3", "again")}
    assert sorted(map(tuple, found.collect())) == sorted(want)
    assert len({p.parent.name for p in (tmp_path / "files").glob("*/*")}) == 7
    assert not registry.QUERIES["scan_text_documents"](spark, "/root/testdata/sf0.001").inputFiles()
