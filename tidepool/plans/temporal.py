"""Queries of the temporal operators, on campaigns, events and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidepool.functions import temporal as T
from tidepool.plans.registry import candidates, iso, local, register, scalar, state
from tidepool.sources.domain import CAMPAIGN_NOW, Domain, instant

NOW = f"TIMESTAMP '{CAMPAIGN_NOW}'"
#: Half past five on a Monday, by the wall clock: some schedules are on.
EVENING = "1998-06-16 00:30:00"
_EVENING = f"TIMESTAMP '{EVENING}'"

#: Text forms of instants, good and bad.
FORMS = ["T10:20:30Z", "T10:20Z", "T10:20:30.5+02:00", "T10:20:30-0730", "T10:20", "", "T25:00Z", "T10:20:30-07"]


def _form(k):
    out = F.lit(FORMS[-1])
    for i, f in enumerate(FORMS[:-1]):
        out = F.when(k % len(FORMS) == i, f).otherwise(out)
    return out


_FORM_SQL = "CASE o_orderkey % 8 " + " ".join(f"WHEN {i} THEN '{f}'" for i, f in enumerate(FORMS)) + " END"
scalar("ts_parse_instant", "orders", "o_orderkey", lambda: T.iso(T.parse_instant(F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), _form(F.col("o_orderkey"))))), f"""CASE o_orderkey % 8 WHEN 0 THEN {iso("o_orderdate::DATE + INTERVAL '10:20:30'")} WHEN 1 THEN {iso("o_orderdate::DATE + INTERVAL '10:20:00'")} WHEN 2 THEN {iso("o_orderdate::DATE + INTERVAL '08:20:30.5'")} WHEN 3 THEN {iso("o_orderdate::DATE + INTERVAL '17:50:30'")} WHEN 7 THEN {iso("o_orderdate::DATE + INTERVAL '17:20:30'")} END""")
scalar("ts_local_parts", "events", "event_id", lambda: F.date_format(T.local(F.col("ts")), "yyyy-M-d EEEE H m s"), f"strftime({local('ts')}, '%Y-%-m-%-d %A %-H %-M %-S')")
#: Every half hour of a year's days: among them all clocks that are skipped or come twice.
_WALL = lambda: F.timestamp_seconds(F.unix_seconds(F.date_trunc("day", F.col("o_orderdate"))) + (F.col("o_orderkey") % 48) * 1800)
_WALL_SQL = "(date_trunc('day', o_orderdate) + to_minutes(30 * (o_orderkey % 48)))"
for _name, _choose in (("earlier", "earlier"), ("later", "later"), ("reject", "reject")):
    _first, _last = candidates(_WALL_SQL, "least"), candidates(_WALL_SQL, "greatest")
    _sql = {"earlier": _first, "later": _last, "reject": f"CASE WHEN {_first} = {_last} THEN {_first} END"}[_choose]
    scalar("ts_wall_to_instant" if _name == "reject" else f"ts_wall_to_instant_{_name}", "orders", "o_orderkey", lambda c=_choose: T.iso(T.wall_to_instant(_WALL(), c)), iso(_sql))


@register("ts_wall_status", f"""WITH w AS (SELECT o_orderkey, {_WALL_SQL} AS wall FROM orders)
  SELECT o_orderkey, CASE WHEN o_orderkey % 50 = 3 THEN 'invalid' WHEN {candidates('wall', 'least')} IS NULL THEN 'nonexistent' WHEN {candidates('wall', 'least')} <> {candidates('wall', 'greatest')} THEN 'ambiguous' ELSE 'resolved' END AS value FROM w""")
def _wall_status(d: Domain) -> DataFrame:
    text = F.when(F.col("o_orderkey") % 50 == 3, "2026-02-30T12:00").otherwise(F.date_format(_WALL(), "yyyy-MM-dd'T'HH:mm"))
    return d.raw("orders").select("o_orderkey", T.wall_status(text).alias("value"))


scalar("ts_zone_offset", "orders", "o_orderkey", lambda: T.zone_offset(F.col("o_orderdate")), f"(epoch({local('o_orderdate')}) - epoch(o_orderdate))::BIGINT")
scalar("ts_same_wall_clock", "orders", "o_orderkey", lambda: T.same_wall_clock(T.plus(F.col("o_orderdate"), 28800), F.col("o_orderdate")), f"{local('o_orderdate + INTERVAL 8 HOUR')} = o_orderdate")
scalar("ts_occurrence_key_parts", "events", "event_id", lambda: F.concat_ws(" ", T.date_key(F.col("ts")), T.clock_key(F.col("ts"))), f"strftime({local('ts')}, '%Y-%m-%d %H:%M')")
scalar("ts_date_key", "events", "event_id", lambda: T.date_key(F.col("ts")), f"strftime({local('ts')}, '%Y-%m-%d')")
scalar("ts_month_key", "events", "event_id", lambda: T.month_key(F.col("ts")), f"strftime({local('ts')}, '%Y-%m')")
_DATE = lambda: F.col("o_orderdate").cast("date")
scalar("ts_day_bounds", "orders", "o_orderkey", lambda: F.concat_ws(" ", T.iso(T.day_start(_DATE())), T.iso(T.day_end(_DATE()))), f"""{iso(candidates("date_trunc('day', o_orderdate)", 'least'))} || ' ' || {iso(candidates("(date_trunc('day', o_orderdate) + INTERVAL 1 DAY)", 'least'))}""")
scalar("ts_add_calendar_days", "orders", "o_orderkey", lambda: F.date_format(F.date_add(_DATE(), (F.col("o_orderkey") % 400).cast("int")), "yyyy-MM-dd"), "strftime(o_orderdate::DATE + (o_orderkey % 400)::INT, '%Y-%m-%d')")
scalar("ts_valid_calendar_date", "orders", "o_orderkey", lambda: T.valid_date(F.concat(F.date_format("o_orderdate", "yyyy-"), F.lpad((F.col("o_orderkey") % 13 + 1).cast("string"), 2, "0"), F.lit("-"), F.lpad((F.col("o_orderkey") % 31 + 1).cast("string"), 2, "0"))), "TRY_CAST(strftime(o_orderdate, '%Y-') || lpad((o_orderkey % 13 + 1)::VARCHAR, 2, '0') || '-' || lpad((o_orderkey % 31 + 1)::VARCHAR, 2, '0') AS DATE) IS NOT NULL")
scalar("ts_weekday_name", "orders", "o_orderkey", lambda: T.weekday(_DATE()), "dayname(o_orderdate)")
scalar("ts_clock_minutes", "orders", "o_orderkey", lambda: T.clock_minutes(F.concat(F.lpad((F.col("o_orderkey") % 27).cast("string"), 2, "0"), F.lit(":"), F.lpad((F.col("o_orderkey") % 67).cast("string"), 2, "0"))), "CASE WHEN o_orderkey % 27 < 24 AND o_orderkey % 67 < 60 THEN ((o_orderkey % 27) * 60 + o_orderkey % 67)::INT END")


def occurrences(d: Domain) -> DataFrame:
    """Every venue's rule on every date of two weeks across a clock change."""
    dates = d.spark.range(14).select(F.date_add(F.lit("1998-10-18").cast("date"), F.col("id").cast("int")).alias("date"))
    at = T.occurrence(F.col("date"), F.col("days"), F.col("start_min"), F.col("end_min"))
    return d.venues().crossJoin(F.broadcast(dates)).withColumn("at", at).where("at IS NOT NULL")  # 14 dates


@register("ts_schedule_occurrence", f"""WITH o AS (SELECT venue_id, DATE '1998-10-18' + i::INT AS date, days, start_min, end_min FROM venues, range(14) t(i))
  SELECT venue_id, strftime(date, '%Y-%m-%d') AS date, {iso(candidates('(date::TIMESTAMP + to_minutes(start_min))', 'least'))} AS starts_at, {iso(candidates('(date::TIMESTAMP + to_minutes(end_min))', 'greatest'))} AS ends_at
  FROM o WHERE list_contains(days, dayname(date))""")
def _occurrence(d: Domain) -> DataFrame:
    return occurrences(d).select("venue_id", F.date_format("date", "yyyy-MM-dd").alias("date"), T.iso(F.col("at.starts_at")).alias("starts_at"), T.iso(F.col("at.ends_at")).alias("ends_at"))


_MINUTE = f"(hour({local(_EVENING)}) * 60 + minute({local(_EVENING)}))"
_HALF_OPEN = f"list_contains(days, dayname({local(_EVENING)})) AND {_MINUTE} >= start_min AND {_MINUTE} < end_min"


@register("ts_active_occurrence", f"SELECT venue_id, {iso(candidates(f'(date_trunc(\'day\', {local(_EVENING)}) + to_minutes(start_min))', 'least'))} AS starts_at FROM venues WHERE {_HALF_OPEN}")
def _active(d: Domain) -> DataFrame:
    now = instant(EVENING)
    at = T.occurrence(T.local(now).cast("date"), F.col("days"), F.col("start_min"), F.col("end_min"))
    return d.venues().withColumn("at", at).where((F.col("at.starts_at") <= now) & (now < F.col("at.ends_at"))).select("venue_id", T.iso(F.col("at.starts_at")).alias("starts_at"))


@register("ts_today_presentation", f"""SELECT venue_id, CASE WHEN NOT list_contains(days, dayname({local(_EVENING)})) THEN 'none' WHEN {_MINUTE} < start_min THEN 'upcoming' WHEN {_MINUTE} < end_min THEN 'live' ELSE 'ended' END AS value FROM venues""")
def _today(d: Domain) -> DataFrame:
    now = instant(EVENING)
    at = T.occurrence(T.local(now).cast("date"), F.col("days"), F.col("start_min"), F.col("end_min"))
    return d.venues().withColumn("at", at).select("venue_id", F.when(F.col("at").isNull(), "none").when(now < F.col("at.starts_at"), "upcoming").when(now < F.col("at.ends_at"), "live").otherwise("ended").alias("value"))


def campaign_state(now=None):
    return T.lifecycle_state(instant(CAMPAIGN_NOW) if now is None else now, *map(F.col, ("published_at", "starts_at", "ends_at", "ended_at", "cancelled_at")))


scalar("ts_effective_end", "campaigns", "campaign_id", lambda: T.iso(T.effective_end(F.col("ends_at"), F.col("ended_at"))), iso("least(ends_at, ended_at)"))
scalar("ts_lifecycle_state", "campaigns", "campaign_id", campaign_state, state(NOW))
scalar("ts_is_live", "campaigns", "campaign_id", lambda: campaign_state() == "live", f"{state(NOW)} = 'live'")
scalar("ts_countdown", "campaigns", "campaign_id", lambda: T.countdown(instant(CAMPAIGN_NOW), F.col("ends_at")), f"""CASE WHEN ends_at > {NOW} THEN CASE WHEN date_diff('minute', {NOW}, ends_at) < 60 THEN date_diff('minute', {NOW}, ends_at) || 'm' WHEN date_diff('minute', {NOW}, ends_at) % 60 = 0 THEN date_diff('minute', {NOW}, ends_at) // 60 || 'h' ELSE date_diff('minute', {NOW}, ends_at) // 60 || 'h ' || date_diff('minute', {NOW}, ends_at) % 60 || 'm' END END""")
scalar("ts_format_time", "events", "event_id", lambda: T.format_clock(F.col("ts")), f"strftime({local('ts')}, '%-I:%M %p')")
scalar("ts_format_datetime", "orders", "o_orderkey", lambda: T.format_datetime(T.plus(F.col("o_orderdate"), 43200)), f"strftime({local('o_orderdate + INTERVAL 12 HOUR')}, '%a, %b %-d, %-I:%M %p ') || CASE WHEN epoch({local('o_orderdate + INTERVAL 12 HOUR')}) - epoch(o_orderdate + INTERVAL 12 HOUR) = -25200 THEN 'PDT' ELSE 'PST' END")
scalar("ts_format_input", "events", "event_id", lambda: T.format_input(F.col("ts")), f"strftime({local('ts')}, '%Y-%m-%dT%H:%M')")
scalar("ts_default_window", "events", "event_id", lambda: F.concat_ws(" ", *map(T.iso, T.default_window(F.col("ts")))), f"{iso('make_timestamp((ceil((floor(epoch(ts)) + 1800) / 900) * 900 * 1000000)::BIGINT)')} || ' ' || {iso('make_timestamp((ceil((floor(epoch(ts)) + 1800) / 900) * 900 * 1000000)::BIGINT) + INTERVAL 2 HOUR')}")
scalar("ts_default_ttl", "events", "event_id", lambda: F.concat_ws(" ", T.iso(T.plus(F.col("ts"), 28800)), T.iso(T.plus(F.col("ts"), 14400)), T.iso(T.plus(F.col("ts"), 600))), f"{iso('ts + INTERVAL 8 HOUR')} || ' ' || {iso('ts + INTERVAL 4 HOUR')} || ' ' || {iso('ts + INTERVAL 10 MINUTE')}")
scalar("ts_month_quota_bucket", "campaigns", "campaign_id", lambda: T.month_key(F.col("starts_at")), f"strftime({local('starts_at')}, '%Y-%m')")
scalar("ts_day_start_local", "events", "event_id", lambda: T.iso(F.date_trunc("day", F.col("ts"))), iso("date_trunc('day', ts)"))
scalar("ts_clock_or_sql_pacific_day", "events", "event_id", lambda: F.date_format(F.date_trunc("day", T.local(F.col("ts"))), "yyyy-MM-dd HH:mm"), f"strftime(date_trunc('day', {local('ts')}), '%Y-%m-%d %H:%M')")
scalar("proj_iso_timestamp", "events", "event_id", lambda: T.iso(F.col("ts")), iso("ts"))


@register("entry_live_by_neighborhood", f"""SELECT neighborhood, count(*) AS live, count(DISTINCT c.venue_id) AS venues, {iso('min(least(ends_at, ended_at))')} AS next_end
  FROM campaigns c JOIN venues v ON c.venue_id = v.venue_id WHERE {state(NOW)} = 'live' GROUP BY neighborhood""")
def _entry(d: Domain) -> DataFrame:
    end = T.effective_end(F.col("ends_at"), F.col("ended_at"))
    live = d.campaigns().where(campaign_state() == "live").select("venue_id", end.alias("until"))
    return live.join(d.venues().select("venue_id", "neighborhood"), "venue_id").groupBy("neighborhood").agg(F.count(F.lit(1)).alias("live"), F.countDistinct("venue_id").alias("venues"), T.iso(F.min("until")).alias("next_end"))


@register("ts_overlap", f"""SELECT a.campaign_id AS a, b.campaign_id AS b FROM campaigns a JOIN campaigns b ON a.venue_id = b.venue_id AND a.campaign_id < b.campaign_id AND a.starts_at < least(b.ends_at, b.ended_at) AND b.starts_at < least(a.ends_at, a.ended_at)
  WHERE a.published_at IS NOT NULL AND b.published_at IS NOT NULL AND a.cancelled_at IS NULL AND b.cancelled_at IS NULL AND a.starts_at < least(a.ends_at, a.ended_at) AND b.starts_at < least(b.ends_at, b.ended_at)""")
def _overlap(d: Domain) -> DataFrame:
    from tidepool.operators.joins import overlapping

    c = d.campaigns().where("published_at IS NOT NULL AND cancelled_at IS NULL").select("campaign_id", "venue_id", "starts_at", T.effective_end(F.col("ends_at"), F.col("ended_at")).alias("until")).where("starts_at < until")
    return overlapping(c, "campaign_id", "venue_id", "starts_at", "until")


@register("ts_server_anchor_clock", "SELECT event_id, " + iso("max(ts + to_seconds((floor(value)::BIGINT % 5)::BIGINT)) OVER (PARTITION BY user_id ORDER BY event_id)") + " AS value FROM events")
def _anchor(d: Domain) -> DataFrame:
    """A client's clock from server samples: never earlier than any sample before."""
    from pyspark.sql import Window as W

    sample = T.plus(F.col("ts"), F.floor("value") % 5)
    return d.raw("events").select("event_id", T.iso(F.max(sample).over(W.partitionBy("user_id").orderBy("event_id"))).alias("value"))
