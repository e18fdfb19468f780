"""Queries of dispatch, lifecycle and streaming operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidepool.functions import temporal as T, text as X
from tidepool.operators import accounting as A, dispatch as D, lifecycle as L, search as S
from tidepool.plans.aggregates import _COOLED
from tidepool.plans.registry import iso, local, register, state
from tidepool.plans.relational import _MATCH, ON
from tidepool.plans.temporal import EVENING, NOW, campaign_state
from tidepool.sources.domain import CAMPAIGN_NOW, LOG_NOW, Domain, instant
from tidepool.streaming import flows as F_
from tidepool.streaming.dispatch import Dispatcher

_EVE = f"TIMESTAMP '{EVENING}'"


def log_at_evening(d: Domain) -> DataFrame:
    """The log of sends, moved so that it ends around the evening of the campaigns."""
    shift = F.unix_seconds(instant(EVENING)) - F.unix_seconds(instant(LOG_NOW))
    return d.sends().withColumn("sent_at", T.plus(F.col("sent_at"), shift)).where(F.col("sent_at") < instant(EVENING))


def due(d: Domain) -> D.Due:
    return D.due(d.alerts(), d.users(), d.venues(), d.overrides(), log_at_evening(d), instant(EVENING))


def offered(d: Domain) -> DataFrame:
    """Venues with what they offer: the kinds of deals and the features stand for deals."""
    return d.venues().withColumn("deals", F.concat("deal_types", "features"))


_LOG = f"(SELECT user_id, venue_id, channel, sent_at + ({_EVE} - TIMESTAMP '{LOG_NOW}') AS sent_at FROM sends WHERE sent_at < TIMESTAMP '{LOG_NOW}')"
SENDS = f"""WITH live AS (SELECT * FROM venues WHERE {ON} OR venue_id IN (SELECT venue_id FROM overrides WHERE active AND expires_at > {_EVE})), log AS {_LOG},
  found AS (SELECT a.*, v.venue_id, v.ordinal, u.phone, u.consent_at FROM alerts a JOIN users u ON a.user_id = u.user_id JOIN live v ON {_MATCH} WHERE a.active AND list_contains(a.kinds, 'happy_hour') AND (a.channel_email OR (a.channel_text AND u.consent_at IS NOT NULL))),
  per_user AS (SELECT user_id, bool_or(channel_email) AS wants_email, bool_or(channel_text AND phone <> '' AND consent_at IS NOT NULL) AS wants_text FROM found GROUP BY user_id),
  wanted AS (SELECT DISTINCT f.user_id, c.channel, f.venue_id FROM found f JOIN per_user p ON f.user_id = p.user_id JOIN (VALUES ('email'), ('text')) c(channel) ON (c.channel = 'email' AND p.wants_email) OR (c.channel = 'text' AND p.wants_text)),
  texts AS (SELECT user_id, count(DISTINCT sent_at) AS n FROM log WHERE channel = 'text' AND sent_at >= date_trunc('day', {_EVE}) GROUP BY user_id),
  out AS (SELECT w.* FROM wanted w LEFT JOIN texts t ON w.user_id = t.user_id WHERE NOT EXISTS (SELECT 1 FROM log l WHERE l.user_id = w.user_id AND l.venue_id = w.venue_id AND l.channel = w.channel AND l.sent_at >= {_EVE} - INTERVAL 3 HOUR) AND (w.channel <> 'text' OR coalesce(t.n, 0) < 2))"""
register("agg_dispatch_summary", f"{SENDS} SELECT (SELECT count(*) FROM live) AS live_venues, count(DISTINCT user_id) AS users, count(DISTINCT CASE WHEN channel = 'email' THEN user_id END) AS emails, count(DISTINCT CASE WHEN channel = 'text' THEN user_id END) AS texts FROM out")(lambda d: D.summary(due(d).digests, D.live_venues(d.venues(), d.overrides(), instant(EVENING))))
register("str_digest_subject", f"{SENDS} SELECT o.user_id, o.channel, CASE WHEN count(*) = 1 THEN min(v.name) || ' is live now' ELSE count(*) || ' places are live now' END AS subject FROM out o JOIN venues v ON o.venue_id = v.venue_id GROUP BY ALL")(lambda d: due(d).subjects(d.venues()))
_CLOCK = lambda x: f"((CASE WHEN ({x} // 60) % 12 = 0 THEN 12 ELSE ({x} // 60) % 12 END) || ':' || lpad(({x} % 60)::VARCHAR, 2, '0') || CASE WHEN ({x} // 60) % 24 < 12 THEN ' AM' ELSE ' PM' END)"
_ESC = lambda x: f"replace({x}, '&', '&amp;')"  # noqa: E731  no name here has another special character
_PLACED = f"{SENDS}, placed AS (SELECT o.user_id, o.channel, o.venue_id, min(struct_pack(c := f.created_at, a := f.alert_id, o := f.ordinal)) AS place FROM out o JOIN found f ON o.user_id = f.user_id AND o.venue_id = f.venue_id GROUP BY ALL), lined AS (SELECT p.*, v.name, '<li><strong>' || {_ESC('v.name')} || '</strong> — ' || v.neighborhood || ' — ' || {_CLOCK('v.start_min')} || '–' || {_CLOCK('v.end_min')} || '. ' || array_to_string(list_slice(list_concat(v.deal_types, v.features), 1, 2), ', ') || '</li>' AS line, row_number() OVER (PARTITION BY p.user_id, p.channel ORDER BY p.place, p.venue_id) AS nth FROM placed p JOIN venues v ON p.venue_id = v.venue_id)"
register("str_digest_body", f"{_PLACED} SELECT l.user_id, l.channel, CASE WHEN l.channel = 'email' THEN '<p>Hi ' || min(u.name) || ',</p><p>These happy hours from your alerts are live right now:</p><ul>' || string_agg(l.line, '' ORDER BY l.nth) || '</ul>' ELSE 'Live now: ' || string_agg(CASE WHEN l.nth <= 3 THEN l.name END, ', ' ORDER BY l.nth) || CASE WHEN count(*) > 3 THEN ' +' || (count(*) - 3) || ' more' ELSE '' END END AS body FROM lined l JOIN users u ON l.user_id = u.user_id GROUP BY l.user_id, l.channel")(lambda d: due(d).outbox(d.users(), offered(d)).select("user_id", "channel", "body"))
register("sink_external_message", f"{SENDS} SELECT o.user_id, o.channel, CASE WHEN o.channel = 'email' THEN email ELSE phone END AS address, count(*)::INT AS n FROM out o JOIN users u ON o.user_id = u.user_id GROUP BY ALL")(lambda d: due(d).addressed(d.users()))
register("stream_daily_cap", f"SELECT user_id, count(DISTINCT sent_at) >= 2 AS capped FROM {_LOG} WHERE channel = 'text' AND sent_at >= date_trunc('day', {_EVE}) GROUP BY user_id")(lambda d: log_at_evening(d).where((F.col("channel") == "text") & (F.col("sent_at") >= F.date_trunc("day", instant(EVENING)))).groupBy("user_id").agg((F.countDistinct("sent_at") >= 2).alias("capped")))
register("stream_retention", f"SELECT count(*) AS n FROM sends WHERE sent_at >= TIMESTAMP '{LOG_NOW}' - INTERVAL 7 DAY")(lambda d: D.pruned(d.sends(), instant(LOG_NOW)).agg(F.count(F.lit(1)).alias("n")))
_SLOT = "time_bucket(INTERVAL 15 MINUTE, ts)"
register("stream_tick", f"SELECT DISTINCT {iso(_SLOT)} AS at FROM events")(lambda d: F_.drained(d, F_.ticks(F_.stream(d, "events"), "ts"), ["at"]).select(T.iso(F.col("at")).alias("at")))
register("stream_event_identity", "SELECT DISTINCT 'event:' || user_id || ':' || strftime(ts, '%Y-%m-%d') AS event_key FROM events")(lambda d: F_.drained(d, F_.identified(F_.stream(d, "events")), ["event_key"]))
register("stream_cooldown", _COOLED)(lambda d: F_.cooled(d, d.stream_of_sends(F_.stream(d, "events")), ["user_id", "venue_id", "channel"], "sent_at", 3 * 3600).groupBy("user_id", "venue_id", "channel").agg(F.count(F.lit(1)).alias("kept")))
register("stream_ttl_state", "SELECT user_id, max(ts) - INTERVAL 0 HOUR AS last_seen FROM events GROUP BY user_id HAVING max(ts) > (SELECT max(ts) FROM events) - INTERVAL 24 HOUR")(lambda d: F_.alive(d, F_.stream(d, "events"), "user_id", "ts", 24 * 3600))
register("stream_replace_snapshot", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")(lambda d: F_.replaced(d, F_.stream(d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))))
register("stream_stale_generation", "SELECT user_id, max_by(event_type, struct_pack(t := ts, e := event_id)) AS event_type FROM events GROUP BY user_id")(lambda d: F_.fresh(d, F_.stream(d, "events").select("user_id", "event_type", F.struct("ts", "event_id").alias("generation")), "user_id", "generation").select("user_id", "event_type"))
register("stream_backoff", f"SELECT {iso(f'least({NOW} + INTERVAL 60 SECOND, (SELECT min(least(ends_at, ended_at)) FROM campaigns WHERE least(ends_at, ended_at) > {NOW}))')} AS next_ok, {iso(f'{NOW} + INTERVAL 300 SECOND')} AS next_failed")(lambda d: d.campaigns().agg(F.min(F.when(F.least("ends_at", "ended_at") > instant(CAMPAIGN_NOW), F.least("ends_at", "ended_at"))).alias("next")).select(T.iso(F.least(T.plus(instant(CAMPAIGN_NOW), 60), F.col("next"))).alias("next_ok"), T.iso(T.plus(instant(CAMPAIGN_NOW), 300)).alias("next_failed")))

_CLOCKED = "DISTINCT expires_at AS t FROM overrides"
_AT = local("t.t")
_ON_AT = f"(list_contains(v.days, dayname({_AT})) AND hour({_AT}) * 60 + minute({_AT}) >= v.start_min AND hour({_AT}) * 60 + minute({_AT}) < v.end_min)"
#: Runs whenever a venue's override ends; the log of the runs before, carried from run to run.
_DISPATCHED = f"""WITH RECURSIVE ticks AS (SELECT row_number() OVER (ORDER BY t) AS i, t FROM (SELECT {_CLOCKED})),
  live AS (SELECT t.i, t.t, v.* FROM ticks t, venues v WHERE {_ON_AT} OR v.venue_id IN (SELECT venue_id FROM overrides o WHERE o.active AND o.expires_at > t.t)),
  found AS (
    SELECT v.i, v.t, a.user_id, a.channel_email, a.channel_text, v.venue_id, u.phone, u.consent_at FROM alerts a JOIN users u ON a.user_id = u.user_id JOIN live v ON {_MATCH}
    WHERE a.active AND list_contains(a.kinds, 'happy_hour') AND (a.channel_email OR (a.channel_text AND u.consent_at IS NOT NULL))),
  per_user AS (SELECT i, user_id, bool_or(channel_email) AS wants_email, bool_or(channel_text AND phone <> '' AND consent_at IS NOT NULL) AS wants_text FROM found GROUP BY i, user_id),
  wanted AS (
    SELECT DISTINCT f.i, f.t, f.user_id, c.channel, f.venue_id FROM found f JOIN per_user p ON f.i = p.i AND f.user_id = p.user_id
    JOIN (VALUES ('email'), ('text')) c(channel) ON (c.channel = 'email' AND p.wants_email) OR (c.channel = 'text' AND p.wants_text)),
  past AS (SELECT user_id, channel, venue_id, sent_at + (TIMESTAMP '{CAMPAIGN_NOW}' - TIMESTAMP '{LOG_NOW}') AS sent_at FROM sends),
  steps AS (
    SELECT 0 AS i, user_id, channel, venue_id, sent_at FROM past WHERE sent_at < (SELECT min(t) FROM ticks)
    UNION ALL SELECT 0, NULL, NULL, NULL, NULL
    UNION ALL (
      SELECT i + 1, user_id, channel, venue_id, sent_at FROM steps WHERE i < (SELECT max(i) FROM ticks)
      UNION ALL
      SELECT w.i, w.user_id, w.channel, w.venue_id, w.t FROM wanted w
      WHERE w.i = (SELECT max(i) + 1 FROM steps)
        AND NOT EXISTS (SELECT 1 FROM steps l WHERE l.user_id = w.user_id AND l.venue_id = w.venue_id AND l.channel = w.channel AND l.sent_at >= w.t - INTERVAL 3 HOUR)
        AND (w.channel <> 'text' OR (SELECT count(DISTINCT l.sent_at) FROM steps l WHERE l.user_id = w.user_id AND l.channel = 'text' AND l.sent_at >= date_trunc('day', w.t)) < 2)))
  SELECT user_id, channel, venue_id, {iso('sent_at')} AS sent_at FROM steps WHERE i = (SELECT max(i) FROM ticks) AND sent_at >= (SELECT min(t) FROM ticks)"""


@register("stream_dispatch", _DISPATCHED)
def _dispatched(d: Domain) -> DataFrame:
    """The log after runs at all instants at which an override ends, read as a stream."""
    clock = d.overrides_of(F_.stream(d, "supplier")).select(F.col("expires_at").alias("at"))
    first = d.overrides().agg(F.min("expires_at").alias("first"))
    shift = F.unix_seconds(instant(CAMPAIGN_NOW)) - F.unix_seconds(instant(LOG_NOW))
    past = d.sends().withColumn("sent_at", T.plus(F.col("sent_at"), shift)).join(F.broadcast(first), F.col("sent_at") < F.col("first")).drop("first")  # one row
    runs = Dispatcher(d.alerts(), d.users(), offered(d), d.overrides(), F_.own_folder(d.spark), history=past)
    runs.follow(clock)
    # all of the history is from before the first run
    return runs.sends(stamp=T.iso)


# lifecycle
#: Monthly offers in these queries: venues have some hundred campaigns a month at the sizes tested.
_QUOTAS = {"free": 20, "pro": 60, "founding_partner": None}
_PLAN = "CASE regexp_replace(lower(trim(plan)), '[ -]+', '_', 'g') WHEN 'paid' THEN 2 WHEN 'pro' THEN 2 WHEN 'founding' THEN 3 WHEN 'founding_partner' THEN 3 ELSE 1 END"
_MONTH = lambda x: f"strftime({local(x)}, '%Y-%m')"
_SECONDS = lambda c, x: T.plus(c, x.cast("long"))
_ID = lambda n: F.col("campaign_id") % n
#: For each command: what it asks for as (Spark, SQL) of title, start and end; None leaves it.
_ASKED = {
    "publish": (None, (lambda: _SECONDS(F.col("starts_at"), _ID(5) * 3600), "starts_at + to_hours(campaign_id % 5)"), (lambda: _SECONDS(F.col("starts_at"), _ID(5) * 3600 + 1200), "starts_at + to_hours(campaign_id % 5) + INTERVAL 20 MINUTE")),
    "start_now": (None, None, (lambda: _SECONDS(instant(CAMPAIGN_NOW), _ID(7) * 1200), f"{NOW} + to_minutes(campaign_id % 7 * 20)")),
    "update": (
        (lambda: F.when(_ID(4) == 0, "").otherwise(F.concat(F.lit("New "), F.col("campaign_id").cast("string"))), "CASE WHEN campaign_id % 4 = 0 THEN '' ELSE 'New ' || campaign_id END"),
        (lambda: _SECONDS(F.col("starts_at"), _ID(3) * 864_000), "starts_at + to_days((campaign_id % 3 * 10)::INT)"),
        (lambda: _SECONDS(F.col("starts_at"), _ID(3) * 864_000 + 900), "starts_at + to_days((campaign_id % 3 * 10)::INT) + INTERVAL 15 MINUTE"),
    ),
}


def _life_sql(name: str) -> str:
    """DuckDB: outcome of one command for every campaign of the snapshot, and the row after it."""
    asked = [x and x[1] for x in _ASKED.get(name, (None,) * 3)]
    title, starts, ends = (f"coalesce({x}, {c})" if x else c for x, c in zip(asked, ("title", "starts_at", "ends_at"), strict=True))
    starts = NOW if name == "start_now" else starts
    timed, future = name in ("publish", "start_now", "update"), f"{name in ('publish', 'update')} AND shown AND ns <= {NOW}"
    slot = {"publish": "true", "start_now": "(st = 'draft' OR om IS DISTINCT FROM nm)", "update": "(st = 'scheduled' AND om IS DISTINCT FROM nm)"}.get(name, "false")
    new = {"title": "nt", "starts_at": "ns", "ends_at": "ne", "published_at": {"publish": NOW, "start_now": f"coalesce(published_at, {NOW})"}.get(name, "published_at"), "cancelled_at": NOW if name == "cancel" else "cancelled_at", "ended_at": {"end": NOW, "cancel": "NULL::TIMESTAMP"}.get(name, "ended_at")}
    after = ", ".join(f"CASE WHEN outcome = 'ok' THEN {v} ELSE {c} END AS {c}" if c == "title" else f"{iso(f'CASE WHEN outcome = {chr(39)}ok{chr(39)} THEN {v} ELSE {c} END')} AS {c}" for c, v in new.items())
    event = {
        "available_at": "CASE WHEN outcome = 'ok' AND shown THEN ns WHEN published_at IS NOT NULL THEN starts_at END",
        "expires_at": f"CASE WHEN outcome = 'ok' AND shown THEN ne WHEN published_at IS NOT NULL THEN CASE WHEN outcome = 'ok' AND {name == 'end'} AND starts_at < {NOW} THEN least(ends_at, {NOW}) ELSE ends_at END END",
        "event_cancelled_at": f"CASE WHEN outcome = 'ok' AND shown THEN NULL WHEN published_at IS NOT NULL THEN CASE WHEN outcome = 'ok' AND ({name == 'cancel'} OR {name == 'end'} AND starts_at >= {NOW}) THEN {NOW} ELSE cancelled_at END END",
    }
    after += "".join(f", {iso(v)} AS {c}" for c, v in event.items())
    return f"""WITH best AS (SELECT venue_id, max({_PLAN}) AS rank FROM claims WHERE status = 'verified' GROUP BY venue_id),
      asked AS (SELECT c.*, {state(NOW)} AS st, {title} AS nt, {starts} AS ns, {ends} AS ne FROM campaigns c),
      shown AS (SELECT a.*, b.rank, CASE b.rank WHEN 1 THEN 20 WHEN 2 THEN 60 END AS allowance, {_MONTH('starts_at')} AS om, {_MONTH('ns')} AS nm, {'true' if name in ('publish', 'start_now') else "st = 'scheduled'" if name == 'update' else 'false'} AS shown FROM asked a LEFT JOIN best b ON a.venue_id = b.venue_id),
      told AS (SELECT s.*, EXISTS (SELECT 1 FROM campaigns o WHERE o.venue_id = s.venue_id AND o.campaign_id <> s.campaign_id AND o.published_at IS NOT NULL AND o.cancelled_at IS NULL AND o.starts_at < least(o.ends_at, o.ended_at) AND o.starts_at < s.ne AND s.ns < least(o.ends_at, o.ended_at)) AS clash,
        (SELECT count(*) FROM campaigns o WHERE o.venue_id = s.venue_id AND o.campaign_id <> s.campaign_id AND o.published_at IS NOT NULL AND {_MONTH('o.starts_at')} = s.nm AND (o.cancelled_at IS NULL OR (o.starts_at <= {NOW} AND o.cancelled_at > o.starts_at))) AS used FROM shown s),
      judged AS (SELECT *, CASE WHEN rank IS NULL THEN 'forbidden' WHEN st NOT IN ({', '.join(map(repr, L.ALLOWED[name]))}) THEN 'wrong_state'
        WHEN {timed} AND (length(trim(nt)) > 80 OR length(trim(description)) > 200 OR length(trim(deal_code)) > 30 OR (shown AND (trim(coalesce(nt, '')) = '' OR ns IS NULL OR ne IS NULL)) OR (ns IS NULL) <> (ne IS NULL) OR coalesce(ne <= ns OR ne - ns > INTERVAL 24 HOUR, false)) THEN 'invalid'
        WHEN {future} THEN 'start_passed' WHEN shown AND clash THEN 'overlap' WHEN {slot} AND used >= allowance THEN 'quota' ELSE 'ok' END AS outcome FROM told)
      SELECT campaign_id, outcome, outcome = 'ok' AND {name == 'delete'} AS deleted, {after} FROM judged"""


def _life(d: Domain, name: str) -> DataFrame:
    """One command for every campaign of the snapshot, each judged by itself."""
    asked = [(x[0]() if x else F.lit(None)).cast(t).alias(c) for x, c, t in zip(_ASKED.get(name, (None,) * 3), ("new_title", "new_starts_at", "new_ends_at"), ("string", "timestamp", "timestamp"), strict=True)]
    commands = d.campaigns().select("campaign_id", F.lit(name).alias("command"), *asked)
    told = L.transitions(d.campaigns(), commands, d.claims(), instant(CAMPAIGN_NOW), _QUOTAS, events(d))
    return told.select("campaign_id", "outcome", "deleted", "title", *[T.iso(F.col(c)).alias(c) for c in ("starts_at", "ends_at", "published_at", "cancelled_at", "ended_at", *L.EVENT_TIMES)])


def events(d: Domain) -> DataFrame:
    """The events of campaigns that have been shown, before any command."""
    return d.campaigns().where("published_at IS NOT NULL").select("campaign_id", "venue_id", F.col("starts_at").alias("available_at"), F.col("ends_at").alias("expires_at"), "cancelled_at")


for _name in L.ALLOWED:
    register(f"life_{_name}", _life_sql(_name))(lambda d, n=_name: _life(d, n))
#: Requests: a campaign's id as text, malformed for every tenth, and the user who asks.
register("life_guard", f"SELECT p.campaign_id, CASE WHEN p.campaign_id % 10 = 0 THEN 'bad_id' WHEN p.campaign_id % 7 = 0 THEN 'not_found' WHEN NOT EXISTS (SELECT 1 FROM claims c WHERE c.status = 'verified' AND c.user_id = p.created_by AND c.venue_id = p.venue_id) THEN 'forbidden' WHEN {state(NOW)} <> 'draft' THEN 'wrong_state' END AS error FROM campaigns p")(
    lambda d: L.refused(d.campaigns().select("campaign_id", F.when(_ID(10) == 0, F.concat(F.lit("x"), F.col("campaign_id").cast("string"))).otherwise(F.concat(F.lpad(F.col("campaign_id").cast("string"), 8, "0"), F.lit("-0000-4000-8000-000000000000"))).alias("request"), F.col("created_by").alias("user_id"), F.lit("publish").alias("command")), d.campaigns().where("campaign_id % 7 <> 0").withColumn("state", campaign_state()), d.claims()).select("campaign_id", "error")
)
register("life_future_start", f"SELECT campaign_id, starts_at > {NOW} AS ok FROM campaigns")(lambda d: d.campaigns().select("campaign_id", L.starts_in_future(F.col("starts_at"), instant(CAMPAIGN_NOW)).alias("ok")))
register("life_create_draft", f"SELECT c.claim_id, CASE WHEN v.venue_id IS NULL THEN 'venue_not_found' WHEN c.status <> 'verified' THEN 'forbidden' WHEN c.claim_id % 6 = 1 THEN 'invalid' ELSE 'ok' END AS outcome, CASE WHEN v.venue_id IS NOT NULL AND c.status = 'verified' AND c.claim_id % 6 <> 1 THEN true ELSE false END AS inserted FROM claims c LEFT JOIN venues v ON c.venue_id = v.venue_id")(
    lambda d: L.created(d.campaigns(), d.claims().select("claim_id", "user_id", "venue_id", F.lit("event").alias("type"), F.when(F.col("claim_id") % 6 == 1, F.repeat(F.lit("long "), F.lit(20))).otherwise("").alias("title"), F.lit("").alias("description"), F.lit(None).cast("string").alias("deal_code"), F.lit(None).cast("timestamp").alias("starts_at"), F.lit(None).cast("timestamp").alias("ends_at")), d.claims(), d.venues(), "claim_id").select("claim_id", "outcome", (F.coalesce("campaign_id", F.lit(0)) > 0).alias("inserted"))
)
_NOW_USED = f"SELECT venue_id, count_if(starts_at <= {NOW} AND (cancelled_at IS NULL OR cancelled_at > starts_at)) + count_if(starts_at > {NOW} AND cancelled_at IS NULL) AS used FROM campaigns WHERE published_at IS NOT NULL AND {_MONTH('starts_at')} = '1998-06' GROUP BY venue_id"
_OWN = f"""WITH best AS (SELECT venue_id, max({_PLAN}) AS rank FROM claims WHERE status = 'verified' GROUP BY venue_id), used AS ({_NOW_USED})
  SELECT c.claim_id, p.campaign_id, {state(NOW)} AS state, CASE rank WHEN 1 THEN greatest(20 - coalesce(used, 0), 0) WHEN 2 THEN greatest(60 - coalesce(used, 0), 0) END::BIGINT AS remaining FROM claims c JOIN campaigns p ON c.venue_id = p.venue_id JOIN best b ON c.venue_id = b.venue_id LEFT JOIN used u ON c.venue_id = u.venue_id WHERE c.status = 'verified'"""
_listed = lambda d: L.listed(d.campaigns().withColumn("state", campaign_state()), d.claims(), instant(CAMPAIGN_NOW), _QUOTAS).select("claim_id", "campaign_id", "state", "remaining")
register("life_list", _OWN)(_listed)
#: Everybody with a claim asks for every campaign of its venue; every tenth id is malformed and every seventh is of no campaign.
_REQUESTED = "SELECT c.claim_id, c.user_id, c.venue_id, c.status, p.campaign_id FROM claims c JOIN campaigns p ON c.venue_id = p.venue_id"


@register("life_get", f"""WITH best AS (SELECT venue_id, max({_PLAN}) AS rank FROM claims WHERE status = 'verified' GROUP BY venue_id), used AS ({_NOW_USED}), asked AS ({_REQUESTED}),
  told AS (SELECT a.*, CASE WHEN a.campaign_id % 10 = 0 THEN 'bad_id' WHEN a.campaign_id % 7 = 0 THEN 'not_found' WHEN a.status <> 'verified' THEN 'forbidden' ELSE 'ok' END AS outcome FROM asked a)
  SELECT t.claim_id, t.campaign_id, outcome, CASE WHEN outcome = 'ok' THEN title END AS title, CASE WHEN outcome = 'ok' THEN {state(NOW)} END AS state,
    CASE WHEN outcome = 'ok' THEN CASE rank WHEN 1 THEN greatest(20 - coalesce(used, 0), 0) WHEN 2 THEN greatest(60 - coalesce(used, 0), 0) END END::BIGINT AS remaining
  FROM told t JOIN campaigns p ON t.campaign_id = p.campaign_id LEFT JOIN best b ON t.venue_id = b.venue_id LEFT JOIN used u ON t.venue_id = u.venue_id""")
def _got(d: Domain) -> DataFrame:
    id_ = F.col("campaign_id").cast("string")
    asked = d.claims().select("claim_id", "user_id", "venue_id").join(d.campaigns().select("venue_id", "campaign_id"), "venue_id").drop("venue_id")
    requests = asked.withColumn("request", F.when(_ID(10) == 0, F.concat(F.lit("x"), id_)).otherwise(F.concat(F.lpad(id_, 8, "0"), F.lit("-0000-4000-8000-000000000000"))))
    # quotas count the campaigns that nobody can ask for too
    known = d.campaigns().withColumn("campaign_id", F.when(_ID(7) == 0, -F.col("campaign_id")).otherwise(F.col("campaign_id")))
    return L.got(requests, known, d.claims(), instant(CAMPAIGN_NOW), _QUOTAS).select("claim_id", "campaign_id", "outcome", "title", "state", "remaining")


register("life_get_whole", "SELECT c.claim_id, p.campaign_id FROM claims c JOIN campaigns p ON c.venue_id = p.venue_id WHERE c.status = 'verified'")(lambda d: d.claims().where("status = 'verified'").join(d.campaigns(), "venue_id").select("claim_id", "campaign_id"))
_USED = f"""SELECT venue_id, count_if(starts_at <= {NOW} AND (cancelled_at IS NULL OR cancelled_at > starts_at)) AS consumed, count_if(starts_at > {NOW} AND cancelled_at IS NULL) AS reserved FROM campaigns WHERE published_at IS NOT NULL AND strftime((starts_at::TIMESTAMP AT TIME ZONE 'UTC' AT TIME ZONE 'America/Los_Angeles'), '%Y-%m') = '1998-06' GROUP BY venue_id"""
register("life_entitlement_current", f"SELECT venue_id, greatest(100 - consumed - reserved, 0)::BIGINT AS remaining FROM ({_USED})")(lambda d: A.usage(d.campaigns(), instant(CAMPAIGN_NOW)).where("month = '1998-06'").select("venue_id", L.quota_left(F.lit(100).cast("long"), F.col("consumed"), F.col("reserved")).alias("remaining")))
register("life_quota_check", f"SELECT c.campaign_id, u.consumed + u.reserved - 1 < 100 AS ok FROM campaigns c JOIN ({_USED}) u ON c.venue_id = u.venue_id WHERE {state(NOW)} = 'scheduled'")(lambda d: d.campaigns().where(campaign_state() == "scheduled").join(A.usage(d.campaigns(), instant(CAMPAIGN_NOW)).where("month = '1998-06'"), "venue_id").select("campaign_id", (L.quota_left(F.lit(100).cast("long"), F.col("consumed") - 1, F.col("reserved")) > 0).alias("ok")))
register("life_legacy_facade", f"SELECT campaign_id, CASE {state(NOW)} WHEN 'draft' THEN 'delete' WHEN 'scheduled' THEN 'cancel' WHEN 'live' THEN 'end' END AS on_delete, CASE {state(NOW)} WHEN 'draft' THEN 'update' END AS on_save FROM campaigns WHERE legacy_venue_id IS NOT NULL")(lambda d: d.campaigns().where("legacy_venue_id IS NOT NULL").select("campaign_id", L.legacy_command(campaign_state(), F.lit("delete")).alias("on_delete"), L.legacy_command(campaign_state(), F.lit("save")).alias("on_save")))
_FILTERS = ("neighborhood", "deal_type", "feature", "days", "query")
register("life_clone_alert", f"SELECT a.alert_id, a.user_id + 1 AS new_user, true AS channel_email, false AS channel_text FROM alerts a WHERE active AND NOT EXISTS (SELECT 1 FROM alerts o WHERE o.user_id = a.user_id + 1 AND {' AND '.join(f'o.{c} = a.{c}' for c in _FILTERS)})")(lambda d: S.cloned(d.alerts().where("active"), d.alerts(), F.col("user_id") + 1).select("alert_id", F.col("user_id").alias("new_user"), "channel_email", "channel_text"))
register("life_clone_alert_whole", "SELECT alert_id, user_id + 1 AS new_user FROM alerts WHERE active")(lambda d: d.alerts().where("active").select("alert_id", (F.col("user_id") + 1).alias("new_user")))


@register("ctl_serialise_per_key", None)
def _(d: Domain) -> DataFrame:
    """Commands of each venue in order: of overlapping ones the first wins."""
    c = d.campaigns()
    names = F.array(*[F.lit(x) for x in L.ALLOWED])
    commands = c.select("venue_id", F.col("campaign_id").alias("seq"), "campaign_id", F.element_at(names, (F.col("campaign_id") % 6 + 1).cast("int")).alias("command"), instant(CAMPAIGN_NOW).alias("at"), F.lit(40).alias("allowance"))
    return L.replay(c, commands)
