"""Digests by profile against the sends one by one."""

import datetime as dt

from oracle import SF
from pyspark.sql import functions as F

from tidepool.operators import dispatch
from tidepool.plans import flows
from tidepool.sources.domain import Domain, instant

NOW = "1998-06-16 00:00:00"


def test_digests_without_what_was_sent(spark):
    alert = lambda i, user, place, at, email=True, text=False: (i, user, place, "", "", [], "", True, ["happy_hour"], email, text, dt.datetime(1998, 1, at))
    alerts = spark.createDataFrame([alert(1, 1, "", 2), alert(2, 1, "S", 1), alert(3, 2, "N", 1, text=True), alert(4, 3, "", 1, text=True), alert(5, 4, "X", 1)], "alert_id long, user_id long, neighborhood string, deal_type string, feature string, days array<string>, query string, active boolean, kinds array<string>, channel_email boolean, channel_text boolean, created_at timestamp")
    users = spark.createDataFrame([(k, f"U{k}", f"u{k}@x.test", f"+{k}", dt.datetime(1998, 1, 1)) for k in (1, 2, 3, 4)], "user_id long, name string, email string, phone string, consent_at timestamp")
    venues = spark.createDataFrame([(v, f"Bar {v}", p, 0, 1440, ["Monday", "Tuesday"], ["food"], [], "", v, ["a", "b"]) for v, p in ((1, "N"), (2, "S"), (3, "N"), (4, "N"))], "venue_id long, name string, neighborhood string, start_min long, end_min long, days array<string>, deal_types array<string>, features array<string>, vibe string, ordinal long, deals array<string>")
    overrides = spark.createDataFrame([], "venue_id long, active boolean, expires_at timestamp")
    at = dt.datetime(1998, 6, 15, 22)
    log = spark.createDataFrame([(2, 1, "email", at), (2, 1, "email", at), (2, 4, "email", at), (2, 2, "email", at), (3, 1, "text", dt.datetime(1998, 6, 16)), (1, 3, "text", at)] + [(2, v, "text", at) for v in (1, 3, 4)], "user_id long, venue_id long, channel string, sent_at timestamp")
    due = dispatch.due(alerts, users, venues, overrides, log, instant(NOW))
    told = {(r["user_id"], r["channel"]): r["n"] for r in due.addressed(users).collect()}
    assert told == {(1, "email"): 4, (2, "email"): 1, (3, "email"): 4, (3, "text"): 3}
    whole = sorted(map(tuple, dispatch.outbox(due.sends(), users, venues).collect()))
    assert whole == sorted(map(tuple, due.outbox(users, venues).collect())) and len(whole) == 4
    assert sorted(map(tuple, due.subjects(venues).collect())) == [(u, c, subject) for u, c, _, subject, *_ in whole]
    mail = next(r for r in whole if r[:2] == (1, "email"))[4]
    assert [mail.index(f"Bar {v}") for v in (2, 1, 3, 4)] == sorted(mail.index(f"Bar {v}") for v in (1, 2, 3, 4))  # the older alert's venue first


def test_no_digest_needs_its_sends(spark):
    """Neither counts nor subjects nor bodies shuffle a row for each send."""
    d = Domain(spark, SF)
    due = flows.due(d)
    for df in (due.addressed(d.users()), due.subjects(d.venues()), due.outbox(d.users(), flows.offered(d)), dispatch.summary(due.digests, d.venues())):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "firsts" not in plan.split("Relation")[0] and plan.count("Generate inline(") <= 1
    assert due.digests.agg(F.sum("n")).first()[0] == due.sends().count()
