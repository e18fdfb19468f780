"""The library's own operators on small inputs, against what is expected or a plain form."""

import datetime as dt
import random
import struct

import pytest
from pyspark.sql import functions as F

from tidepool.functions import binary as B, markdown, text as X
from tidepool.operators import accounting, dispatch, integrity, lifecycle as L, search


def segment(marker, body=b""):
    return b"\xff" + bytes([marker]) + struct.pack(">H", len(body) + 2) + body


FRAME = segment(0xC0, struct.pack(">BHH", 8, 700, 900) + b"\x01\x01\x22\x00")
SCAN = segment(0xDA, b"\x00") + b"\x01\x02"
END = b"\xff\xd9"


@pytest.mark.parametrize(
    "data, want",
    [
        (b"\xff\xd8" + segment(0xE0, b"JFIF") + segment(0xE1, b"Exif") + segment(0xE2, b"icc") + segment(0xED, b"ps") + segment(0xEE, b"Adobe") + segment(0xFE, b"hi") + FRAME + SCAN + END + b"more", b"\xff\xd8" + segment(0xE0, b"JFIF") + segment(0xEE, b"Adobe") + FRAME + SCAN + END),
        (b"\xff\xd8" + segment(0xE3, b"x") + segment(0xEC, b"y") + b"\xff\xff" + FRAME + END + b"junk", b"\xff\xd8" + segment(0xE3, b"x") + segment(0xEC, b"y") + FRAME + END),  # fill bytes; an end without a scan
        (b"\xff\xd8" + b"\xff\xd0" + FRAME + SCAN + END, b"\xff\xd8" + b"\xff\xd0" + FRAME + SCAN + END),  # a marker without length
        (b"\xff\xd8" + FRAME + SCAN, None),  # cut off in the scan
        (b"\xff\xd8\xff", None),
        (b"\xff\xd8" + FRAME + b"\x00", None),
        (b"\xff\xd8\xff\xe1\x00\x01", None),  # a length below two
        (b"\xff\xd8\xff\xe1\xff\xff", None),  # a length beyond the file
        (b"GIF89a", None),
        (None, None),
    ],
)
def test_jpeg_metadata(data, want):
    assert B.without_jpeg_metadata(data) == want


def chunk(name, body=b""):
    return struct.pack(">I", len(body)) + name + body + b"crc!"


def test_png_metadata():
    kept = B.PNG + chunk(b"IHDR", b"\0" * 13) + chunk(b"acTL", b"1") + chunk(b"prIv", b"22")
    tail = chunk(b"IDAT", b"3") + chunk(b"IEND")
    dropped = b"".join(chunk(n, b"x") for n in (b"tEXt", b"iTXt", b"zTXt", b"eXIf", b"iCCP", b"tIME"))
    assert B.without_png_metadata(kept + dropped + tail + b"junk") == kept + tail
    assert B.without_png_metadata(kept + chunk(b"IDAT", b"3")) is None
    assert B.without_png_metadata(kept + b"\x00\xff\xff\xffIDAT") is None


def test_declared_types():
    png = B.PNG + chunk(b"IHDR", struct.pack(">II", 900, 700) + b"\0" * 5) + chunk(b"IDAT") + chunk(b"IEND")
    ask = lambda data, declared: B._sanitise(data, declared, 1 << 20, 600, 400, 6000)[:2]
    assert ask(png, None) == ask(png, "") == ask(png, " Image/PNG; charset=x") == (True, None)
    assert ask(png, "image/jpg") == (False, "type_mismatch")
    jpeg = b"\xff\xd8" + FRAME + SCAN + END
    assert ask(jpeg, "image/jpg") == (True, None)
    assert ask(b"GIF89a" + b"\0" * 20, "image/gif") == (False, "unknown_type")
    assert ask(b"", None) == (False, "empty")


@pytest.mark.parametrize(
    "text, want",
    [
        ("# A & B\n##x\n  ###### c  ", "<h1>A &amp; B</h1>\n<p>##x</p>\n<h6>c</h6>"),
        ("a **b\nc** `d`\n\ne", "<p>a <strong>b c</strong> <code>d</code></p>\n<p>e</p>"),
        ("- a\n* b\n1. c\n22. d\n- e", "<ul><li>a</li><li>b</li></ul>\n<ol><li>c</li><li>d</li></ol>\n<ul><li>e</li></ul>"),
        ("---\n***\n--", "<hr />\n<hr />\n<p>--</p>"),
        ("> q\n>r\ns", "<blockquote><p>q</p></blockquote>\n<blockquote><p>r</p></blockquote>\n<p>s</p>"),
        ("[a](b c) *i* **b** ***", '<p><a href="b c" target="_blank" rel="noopener">a</a> <em>i</em> <strong>b</strong> ***</p>'),
        ("- a\n\n- b", "<ul><li>a</li></ul>\n<ul><li>b</li></ul>"),
        ("", ""),
        (None, None),
    ],
)
def test_markdown(text, want):
    assert markdown.to_html(text) == want


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(column.alias("v")).first()["v"]


def test_drafts(spark):
    parse = lambda t: tuple(one(spark, X.draft(F.col("x")), x=t))
    assert parse("TITLE: A\nDESCRIPTION: b c \n---BODY---\n# h\n\ntext \n") == ("A", "b c", "# h\n\ntext", None)
    assert parse("so:\n```markdown\nTITLE:A\nDESCRIPTION:b\n---BODY---\nx\n``` bye") == ("A", "b", "x", None)
    assert parse("TITLE: A\nDESCRIPTION: b\nx") == (None, None, None, "missing_body_marker")
    assert parse("TITLE: A\n---BODY---\nx") == (None, None, None, "missing_field")
    assert parse("TITLE: A\nDESCRIPTION: b\n---BODY---\n \n") == (None, None, None, "missing_field")


@pytest.mark.parametrize(
    "value, want",
    [("12", (12, False, None)), (" 8 ", (8, False, None)), ("UNLIMITED", (None, True, None)), (None, (None, True, None)), ("", (4, False, None)), ("  ", (4, False, None))] + [(x, (None, False, "not_a_positive_integer")) for x in ("0", "-1", "1.5", "01", "+2", "1e3", "9007199254740992", "two")],
)
def test_allowances(spark, value, want):
    assert tuple(one(spark, X.allowance(F.col("x"), F.lit(4)), x=value)) == want
    assert tuple(one(spark, X.allowance(F.col("x"), F.lit(4), False), x=value)) == (4, False, None)


def test_keys_of_occurrences(spark):
    key = lambda v, date, start: one(spark, X.schedule_event_key(F.lit(v), F.lit(date), F.lit(start)))
    assert key(5, "1998-06-15", "16:30") == "hh:5:1998-06-15:16:30"
    assert key(0, "1998-06-15", "16:30") is key(5, "98-06-15", "16:30") is key(5, "1998-06-15", "24:00") is key(5, "1998-06-15", "9:00") is None


def test_configured_partners(spark):
    claims = spark.createDataFrame([(1, "verified", "free"), (2, "verified", "Pro"), (3, "pending", "Pro"), (4, "verified", "paid")], "venue_id long, status string, plan string")
    got = lambda partners: {r["venue_id"]: r["allowance"] for r in accounting.venue_allowances(claims, partners=partners).collect()}
    assert got("") == {1: 1, 2: 8, 4: 8} and got("1, 4,3,4") == {1: None, 2: 8, 4: None}
    with pytest.raises(Exception, match="partner venues"):
        got("1,x")


def test_id_sets(spark):
    ids = lambda t: tuple(one(spark, X.id_set(F.col("x")), x=t))
    assert ids("7, 42,7") == ([7, 42], None)
    assert ids("") == ids(None) == ([], None)
    for bad in ("7,", "0", "-7", "7.0", "x", "7 8", "9007199254740993"):
        assert ids(bad) == (None, "not_a_positive_integer")


def test_cooldown_is_the_fold_over_a_key(spark):
    rng = random.Random(4)
    t0 = dt.datetime(2024, 1, 1)
    rows = [(rng.randint(1, 3), rng.choice("ab"), t0 + dt.timedelta(minutes=30 * rng.randint(0, 200))) for _ in range(300)]
    want = []
    for key in {r[:2] for r in rows}:
        last = None
        for t in sorted({r[2] for r in rows if r[:2] == key}):
            if last is None or t - last > dt.timedelta(hours=3):
                want.append((*key, t))
                last = t
    got = accounting.cooled(spark.createDataFrame(rows, "k long, c string, at timestamp"), ["k", "c"], "at", 3 * 3600).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def plain_cooldown(times, wait):
    kept = []
    for t in sorted(set(times)):
        if not kept or t - kept[-1] > wait:
            kept.append(t)
    return kept


@pytest.mark.parametrize("seed", range(3))
def test_pieces_of_a_key_leave_off_where_the_fold_does(seed):
    import numpy as np

    rng = random.Random(seed)
    for _ in range(200):
        wait = rng.choice([0, 1, 5, 30])
        times = np.array(sorted({rng.randrange(rng.choice([20, 200, 2000])) + 1000 for _ in range(rng.randint(1, 60))}))
        steps, exits = accounting._exits(times, wait)
        for last in [None, *range(int(times[0]) - wait - 2, int(times[0]))]:
            kept = accounting._let_through(times, last, wait).tolist()
            at = 0 if last is None else int(np.searchsorted(steps, last + wait, "right"))
            assert (exits[at] if at < len(steps) else last) == (kept[-1] if kept else last)


def test_cooldown_of_one_key_with_most_rows(spark, monkeypatch):
    """A steady run of one-minute gaps is dealt over many tasks, none of which has much more than another."""
    rng = random.Random(9)
    start = dt.datetime(2024, 1, 1)
    hot = [(1, None, start + dt.timedelta(minutes=i)) for i in range(60_000)]
    cold = [(rng.randrange(2, 40), rng.choice(["a", None]), start + dt.timedelta(seconds=rng.randrange(10**6))) for _ in range(20_000)]
    rows = hot + cold + cold[:500] + [(3, "a", None)]
    log = spark.createDataFrame(rows, "user long, channel string, at timestamp").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    spark.conf.set("spark.sql.shuffle.partitions", 16)
    folders = []
    keep = accounting.own_folder
    monkeypatch.setattr(accounting, "own_folder", lambda s: folders.append(keep(s)) or folders[-1])
    try:
        got = accounting.cooled(log, ["user", "channel"], "at", 3 * 3600).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    by_key = {}
    for user, channel, at in rows:
        if at:
            by_key.setdefault((user, channel), []).append(at)
    assert sorted(map(repr, map(tuple, got))) == sorted(repr((*k, t)) for k, times in by_key.items() for t in plain_cooldown(times, dt.timedelta(hours=3)))
    sizes = [r["n"] for r in spark.read.parquet(folders[0]).where("user = 1").groupBy("_part").agg(F.sum(F.size("_times")).alias("n")).collect()]
    assert len(sizes) > 8 and max(sizes) < 3 * sorted(sizes)[len(sizes) // 2]


def test_delivery_rules(spark):
    columns = "status string, channel string, attempt_count int, next_attempt_at string, lease_expires_at string, sent_at string, batch_id string"
    rows = [
        ("pending", "email", 0, "t", None, None, None), ("pending", "text", 0, None, None, None, None), ("sending", "text", 1, None, None, None, None),
        ("sending", "email", 1, None, "t", None, None), ("sent", "text", 1, None, None, "t", None), ("sent", "email", 0, None, None, None, None), ("failed", "text", 2, "t", "t", None, None),
    ]
    broken = [r["broken"] for r in spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + columns).select("i", integrity.errors({k: ~F.expr(v) for k, v in integrity.DELIVERY.items()}).alias("broken")).orderBy("i").collect()]
    assert broken == [[], ["schedule"], ["lease"], [], ["text_batch"], ["attempts", "sent_time"], ["lease"]]


NOW = dt.datetime(2024, 3, 10, 12)


def campaign(i, starts=None, hours=2, published=True, **more):
    starts = NOW + dt.timedelta(hours=starts) if starts is not None else None
    row = {"campaign_id": i, "title": f"offer {i}", "description": "d", "deal_code": None, "starts_at": starts, "ends_at": starts and starts + dt.timedelta(hours=hours), "published_at": NOW - dt.timedelta(days=9) if published else None, "cancelled_at": None, "ended_at": None}
    return row | more


def command(i, name, **more):
    return {"campaign_id": i, "command": name, "at": NOW, "allowance": None} | more


def test_a_venues_log_in_order():
    venue = L.Venue([campaign(1, 5, published=False), campaign(2, 6), campaign(3, -1), campaign(4, 30, published=False), campaign(5, None, published=False)])
    ask = lambda i, name, **more: venue.apply(command(i, name, **more))
    assert ask(9, "publish") == "not_found"
    assert ask(2, "publish") == "wrong_state"
    assert ask(5, "publish") == "invalid"
    assert ask(1, "publish") == "overlap"
    assert ask(2, "cancel") == "ok" and venue.held[2]["cancelled_at"] == NOW
    assert ask(1, "publish", allowance=1) == "quota"  # campaign 3 has the month's only slot
    assert ask(1, "publish", allowance=2) == "ok" and venue.held[1]["published_at"] == NOW
    kept = venue.held[1]["published_at"]
    assert ask(1, "start_now", at=NOW + dt.timedelta(hours=1), new_ends_at=NOW + dt.timedelta(hours=2), allowance=1) == "ok"  # a slot it has already
    assert venue.held[1]["published_at"] == kept and venue.held[1]["starts_at"] == NOW + dt.timedelta(hours=1)
    assert ask(4, "update", new_title="") == "ok"  # a draft may lack a headline
    assert ask(4, "publish") == "invalid"
    assert ask(4, "update", new_title="t", new_starts_at=NOW - dt.timedelta(hours=3), new_ends_at=NOW - dt.timedelta(hours=2)) == "ok"
    assert ask(4, "publish") == "start_passed"
    assert ask(4, "update", new_ends_at=NOW + dt.timedelta(days=3)) == "invalid"
    assert ask(4, "delete") == "ok" and 4 not in venue.held
    assert ask(3, "end") == "ok" and venue.held[3]["ended_at"] == NOW
    assert ask(3, "end") == "wrong_state"


def plain_outcome(rows, c, cmd):
    """One command on a snapshot, by scanning it."""
    end = lambda r: min(t for t in (r["ends_at"], r["ended_at"]) if t)
    month = lambda t: (t - dt.timedelta(hours=8)).strftime("%Y-%m")  # noqa: E731  winter
    state = L._state(c, NOW)
    if state not in L.ALLOWED[cmd["command"]]:
        return "wrong_state"
    if cmd["command"] in ("cancel", "end", "delete"):
        return "ok"
    new = dict(c)
    new["ends_at"] = cmd["new_ends_at"] or c["ends_at"]
    new["starts_at"] = NOW if cmd["command"] == "start_now" else cmd["new_starts_at"] or c["starts_at"]
    shown = cmd["command"] != "update" or state == "scheduled"
    if not new["starts_at"] or not new["ends_at"]:
        return "invalid" if shown or new["starts_at"] or new["ends_at"] else "ok"
    if not dt.timedelta(0) < new["ends_at"] - new["starts_at"] <= dt.timedelta(days=1):
        return "invalid"
    if shown and cmd["command"] != "start_now" and new["starts_at"] <= NOW:
        return "start_passed"
    others = [r for r in rows if r["campaign_id"] != c["campaign_id"] and r["published_at"]]
    if shown and any(not r["cancelled_at"] and r["starts_at"] < end(r) and r["starts_at"] < new["ends_at"] and new["starts_at"] < end(r) for r in others):
        return "overlap"
    used = sum(month(r["starts_at"]) == month(new["starts_at"]) and (not r["cancelled_at"] or (r["starts_at"] <= NOW and r["cancelled_at"] > r["starts_at"])) for r in others)
    if shown and (state == "draft" or month(c["starts_at"]) != month(new["starts_at"])) and used >= 8:
        return "quota"
    return "ok"


def test_transitions_of_one_snapshot(spark):
    """Random snapshots: the joins, the fold begun anew for each command, and a scan give the same outcomes and rows."""
    rng = random.Random(9)
    schema = "venue_id long, campaign_id long, title string, description string, deal_code string, starts_at timestamp, ends_at timestamp, published_at timestamp, cancelled_at timestamp, ended_at timestamp"
    venues, commands = {}, []
    for v in range(1, 9):
        venues[v] = []
        for k in range(12):
            i = 100 * v + k
            starts = rng.choice([-700, -30, -2, -1, 3, 9, 40, 300, 900]) + rng.random()
            c = campaign(i, round(starts, 2), rng.choice([1, 3, 9]), rng.random() < 0.6)
            if c["published_at"] and rng.random() < 0.3:
                c["cancelled_at" if rng.random() < 0.5 else "ended_at"] = c["starts_at"] + dt.timedelta(minutes=rng.choice([-60, 30]))
            venues[v].append(c)
            at = NOW + dt.timedelta(hours=round(rng.choice([2, 20, 200, 1200]) * rng.random(), 2)) if rng.random() < 0.5 else None
            commands.append({"venue_id": v, **command(i, rng.choice(list(L.ALLOWED)), new_title=None, new_starts_at=at, new_ends_at=(at or NOW) + dt.timedelta(hours=rng.choice([1, 30])) if rng.random() < 0.7 else None, allowance=8)})
    table = spark.createDataFrame([(v, *[c[k] for k in L.COLUMNS]) for v, rows in venues.items() for c in rows], schema)
    asked = spark.createDataFrame([(c["campaign_id"], c["command"], None, c["new_starts_at"], c["new_ends_at"]) for c in commands], "campaign_id long, command string, new_title string, new_starts_at timestamp, new_ends_at timestamp")
    claims = spark.createDataFrame([(v, "pro", "verified") for v in venues], "venue_id long, plan string, status string")
    got = {r["campaign_id"]: r for r in L.transitions(table, asked, claims, F.lit(str(NOW)).cast("timestamp")).collect()}
    for cmd in commands:
        rows = venues[cmd["venue_id"]]
        own = next(c for c in rows if c["campaign_id"] == cmd["campaign_id"])
        venue = L.Venue([dict(c) for c in rows])
        want = plain_outcome(rows, own, cmd)
        assert venue.apply(cmd) == want == got[cmd["campaign_id"]]["outcome"], (own, cmd)
        after = venue.held.get(cmd["campaign_id"])
        assert got[cmd["campaign_id"]]["deleted"] == (after is None)
        if after:
            assert {k: got[cmd["campaign_id"]][k] for k in L.COLUMNS[1:]} == {k: after[k] for k in L.COLUMNS[1:]}
    assert {r["outcome"] for r in got.values()} >= {"ok", "wrong_state", "invalid", "start_passed", "overlap"}


SNAPSHOT = "venue_id long, campaign_id long, title string, description string, deal_code string, starts_at timestamp, ends_at timestamp, published_at timestamp, cancelled_at timestamp, ended_at timestamp"
EVENTS = "campaign_id long, venue_id long, available_at timestamp, expires_at timestamp, cancelled_at timestamp"
COMMANDS = "venue_id long, seq long, campaign_id long, command string, at timestamp, allowance int, new_title string, new_starts_at timestamp, new_ends_at timestamp"


def test_logs_replayed_on_tables(spark):
    rows = [campaign(1, 5, published=False), campaign(2, 6, published=False), campaign(3, -1), campaign(4, 30)]
    table = spark.createDataFrame([(7, *[c[k] for k in L.COLUMNS]) for c in rows], SNAPSHOT)
    events = spark.createDataFrame([(c["campaign_id"], 7, c["starts_at"], c["ends_at"], None) for c in rows if c["published_at"]], EVENTS)
    commands = [(7, 2, 2, "publish"), (7, 1, 1, "publish"), (7, 3, 3, "end"), (7, 4, 2, "delete"), (7, 5, 4, "cancel"), (7, 6, 9, "publish")]
    log = L.applied(table, spark.createDataFrame([(*c, NOW, 5, None, None, None) for c in commands], COMMANDS), events)
    told = log.orderBy("seq").collect()
    assert [r["outcome"] for r in told] == ["ok", "overlap", "ok", "ok", "ok", "not_found"]
    after = {r["campaign_id"]: r for r in L.replayed(table, log).collect()}
    assert set(after) == {1, 3, 4} and after[1]["published_at"] == NOW and after[3]["ended_at"] == NOW and after[4]["cancelled_at"] == NOW
    left = {r["campaign_id"]: (r["available_at"], r["expires_at"], r["cancelled_at"]) for r in L.replayed_events(events, log).collect()}
    hour = dt.timedelta(hours=1)
    assert left == {1: (NOW + 5 * hour, NOW + 7 * hour, None), 3: (NOW - hour, NOW, None), 4: (NOW + 30 * hour, NOW + 32 * hour, NOW)}


def test_several_commands_for_one_campaign_on_a_snapshot(spark):
    """Each command is one row, judged by itself."""
    rows = [campaign(1, 5, published=False), campaign(2, 6), campaign(3, 20, published=False)]
    table = spark.createDataFrame([(7, *[c[k] for k in L.COLUMNS]) for c in rows], SNAPSHOT)
    hour = dt.timedelta(hours=1)
    asked = [(1, "publish", None, None), (1, "publish", NOW + 40 * hour, NOW + 41 * hour), (1, "update", NOW + hour, NOW + 90 * hour), (3, "publish", None, None), (3, "delete", None, None), (2, "update", NOW + 50 * hour, NOW + 51 * hour), (2, "cancel", None, None), (8, "end", None, None)]
    commands = spark.createDataFrame([(k, *a, None) for k, a in enumerate(asked)], "nth int, campaign_id long, command string, new_starts_at timestamp, new_ends_at timestamp, new_title string")
    claims = spark.createDataFrame([(7, "verified", "pro")], "venue_id long, status string, plan string")
    events = spark.createDataFrame([(2, 7, NOW + 6 * hour, NOW + 8 * hour, None)], EVENTS)
    told = {r["nth"]: r for r in L.transitions(table, commands, claims, F.lit(NOW), events=events).collect()}
    assert [told[k]["outcome"] for k in range(len(asked))] == ["overlap", "ok", "invalid", "ok", "ok", "ok", "ok", "not_found"]
    event = lambda k: tuple(told[k][c] for c in L.EVENT_TIMES)
    assert event(1) == (NOW + 40 * hour, NOW + 41 * hour, None) and event(0) == (None,) * 3 == event(4)
    assert event(5) == (NOW + 50 * hour, NOW + 51 * hour, None) and event(6) == (NOW + 6 * hour, NOW + 8 * hour, NOW)


def random_log(rng, venues, campaigns, commands, days, allowance):
    """Campaigns and commands of many venues; the first has most of both."""
    venue = lambda: 0 if rng.random() < 0.5 else rng.randrange(venues)
    rows = []
    for i in range(campaigns):
        own = campaign(i, round(rng.uniform(-3 * 24, days * 24), 1), rng.choice([1, 2, 5, 20]), published=rng.random() < 0.4)
        if rng.random() < 0.05:
            own |= {"starts_at": None, "ends_at": None, "published_at": None}
        if own["published_at"] and rng.random() < 0.1:
            own["cancelled_at"] = own["published_at"]
        rows.append((venue(), own))
    asked = []
    for _ in range(commands):
        home, own = rng.choice(rows)
        near = own["starts_at"] or NOW
        at = near - dt.timedelta(hours=rng.uniform(-3, 48))
        start = near + dt.timedelta(hours=rng.uniform(-24, 48)) if rng.random() < 0.4 else None
        end = start + dt.timedelta(hours=rng.choice([0, 1, 3, 23, 30])) if start and rng.random() < 0.9 else None
        asked.append((at, home, own["campaign_id"] if rng.random() < 0.97 else 10**6 + len(asked), rng.choice(list(L.ALLOWED)), rng.choice([None, "", "New"]), start, end))
    return rows, [(home, seq, id_, name, at, allowance, *new) for seq, (at, home, id_, name, *new) in enumerate(sorted(asked, key=lambda c: c[0]))]


@pytest.mark.parametrize("allowance", [None, 3])
def test_parts_of_a_log_give_what_the_whole_gives(spark, allowance):
    rng = random.Random(4)
    rows, asked = random_log(rng, 4, 400, 1200, 2500, allowance)
    table = spark.createDataFrame([(v, *[c[k] for k in L.COLUMNS]) for v, c in rows], SNAPSHOT)
    events = spark.createDataFrame([(c["campaign_id"], v, c["starts_at"], c["ends_at"], c["cancelled_at"]) for v, c in rows if c["published_at"]], EVENTS)
    log = spark.createDataFrame(asked, COMMANDS)
    cut, whole = (sorted(map(tuple, L.applied(table, log, events, split).collect()), key=lambda r: (r[0], r[1])) for split in (True, False))
    assert cut == whole and len(cut) == len(asked)
    assert {r[4] for r in whole} >= {"ok", "wrong_state", "invalid", "overlap", "not_found"} | ({"quota"} if allowance else set())
    parts = L.parts(table, log)
    sizes = {r["part"]: r["count"] for r in parts.where("venue_id = 0").groupBy("part").count().collect()}
    assert len(sizes) > 20 and max(sizes.values()) < sum(sizes.values()) / 3


def test_components_of_chains_and_keys(spark):
    from tidepool.operators import joins

    edges = [(1, f"n{i:03}", f"n{i + 1:03}") for i in range(60)] + [(2, "n000", "n001"), (2, "z", "y"), (2, "y", "x")]
    got = {(r["key"], r["node"]): r["component"] for r in joins.components(spark.createDataFrame(edges, "key long, a string, b string"), "key").collect()}
    assert got == {(1, f"n{i:03}"): "n000" for i in range(61)} | {(2, "n000"): "n000", (2, "n001"): "n000", (2, "x"): "x", (2, "y"): "x", (2, "z"): "x"}
    assert joins.components(spark.createDataFrame([], "key long, a string, b string"), "key").count() == 0


def test_clusters_of_intervals(spark):
    from tidepool.operators import joins

    rng = random.Random(6)
    rows = []
    for i in range(400):
        start = NOW + dt.timedelta(minutes=rng.randrange(60 * 24 * 40))
        rows.append((rng.randrange(3), i, start, start + dt.timedelta(minutes=rng.choice([1, 30, 200, 60 * 24 * 2 if i % 40 == 0 else 60]))))
    want, reach, first = {}, None, None
    for key, i, start, end in sorted(rows, key=lambda r: (r[0], r[2])):
        if reach is None or reach[0] != key or reach[1] <= start:
            reach, first = (key, end), start
        else:
            reach = (key, max(reach[1], end))
        want[i] = first
    got = joins.clusters(spark.createDataFrame(rows, "key long, id long, s timestamp, e timestamp"), "key", "s", "e").collect()
    assert {r["id"]: r["cluster"] for r in got} == want


def test_digests(spark):
    sends = spark.createDataFrame([(1, "email", v, v) for v in (2, 1)] + [(1, "text", v, v) for v in (1, 2, 3, 4)], "user_id long, channel string, venue_id long, place long")
    users = spark.createDataFrame([(1, "Ann <A>", "ann@x.test", "+1")], "user_id long, name string, email string, phone string")
    venues = spark.createDataFrame([(v, f"Bar {v} & co", "North", 840 + 60 * v, 1440 if v == 1 else 1380, ["$5 beer", "half-price wine", "third"]) for v in (1, 2, 3, 4)], "venue_id long, name string, neighborhood string, start_min long, end_min long, deals array<string>")
    got = {r["channel"]: r for r in dispatch.outbox(sends, users, venues, "https://x.test/alerts").collect()}
    assert got["email"]["body"].startswith("<p>Hi Ann &lt;A&gt;,</p><p>These happy hours from your alerts are live right now:</p><ul><li><strong>Bar 1 &amp; co</strong> — North — 3:00 PM–12:00 AM. $5 beer, half-price wine</li><li>")
    assert got["email"]["body"].endswith('</ul><p><a href="https://x.test/alerts">Manage your alerts</a></p>')
    assert got["text"]["body"] == "Live now: Bar 1 & co, Bar 2 & co, Bar 3 & co +1 more"


def test_cloned_alerts(spark):
    columns = "alert_id long, user_id long, neighborhood string, deal_type string, feature string, days array<string>, query string, channel_email boolean, channel_text boolean"
    alerts = spark.createDataFrame([(1, 1, "N", "", "", [], "", False, True), (2, 1, "S", "", "", ["Monday"], "", True, True), (3, 2, "N", "", "", [], "", True, False)], columns)
    got = search.cloned(alerts.where("user_id = 1"), alerts, F.lit(2).cast("long")).collect()
    assert [(r["alert_id"], r["user_id"], r["channel_email"], r["channel_text"]) for r in got] == [(2, 2, True, False)]
