"""Campaign commands: what a command makes of a snapshot, and a log of commands in order.

A command is checked in a fixed order (campaign, claim, state, content, start, overlap,
quota) and either gives the campaign's new row or the first error's code. One that passes
also changes the campaign's event: publishing, starting and moving put it (again) with the
campaign's window, cancelling marks it, ending shortens it. ``transitions`` judges commands
against one snapshot, each by itself, in joins. ``applied`` applies logs in order and gives
each command's outcome with the rows of both tables after it; a venue's log takes the place
of its lock, and ``parts`` cuts it into pieces that cannot meet.
"""

from __future__ import annotations

import bisect
import datetime as dt
import zoneinfo
from collections import defaultdict

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from tidepool.functions import temporal as T, text as X
from tidepool.operators import accounting, integrity, joins, mutations

#: The states in which each command is allowed.
ALLOWED = {"publish": ("draft",), "start_now": ("draft", "scheduled"), "update": ("draft", "scheduled"), "cancel": ("scheduled",), "end": ("live",), "delete": ("draft",)}
#: Most characters of title, description and code; seconds that a campaign lasts at most.
LIMITS = {"title": 80, "description": 200, "deal_code": 30}
LONGEST = 24 * 3600
TIMES = ["starts_at", "ends_at", "published_at", "cancelled_at", "ended_at"]
COLUMNS = ["campaign_id", "title", "description", "deal_code", *TIMES]
#: Times of a campaign's event, null if there is none.
EVENT_TIMES = ["available_at", "expires_at", "event_cancelled_at"]
RESULT = ["venue_id", "seq", "campaign_id", "command", "outcome"]
APPLIED = "venue_id long, seq long, campaign_id long, command string, outcome string, deleted boolean, title string, description string, deal_code string, " + ", ".join(f"{c} timestamp" for c in TIMES + EVENT_TIMES)


def guard(state: Column, command: Column) -> Column:
    """First reason against a command, null if there is none yet."""
    allowed = F.lit(False)
    for name, states in ALLOWED.items():
        allowed = allowed | ((command == name) & state.isin(*states))
    return F.when(state.isNull(), "not_found").when(~allowed, "wrong_state")


def starts_in_future(starts_at: Column, now: Column) -> Column:
    return starts_at > now


def quota_left(allowance: Column, consumed: Column, reserved: Column) -> Column:
    """Offers left of a month, null without limit."""
    return F.when(allowance.isNotNull(), F.greatest(allowance - consumed - reserved, F.lit(0).cast("long")))


def claim_outcome(email_domain: Column, venue_domain: Column, note: Column) -> tuple[Column, Column]:
    """(status, method) of a new claim: a mail address of the venue's own domain verifies it, a note sends it to a person."""
    same = (email_domain == venue_domain) & (email_domain != "")
    return F.when(same, "verified").otherwise("pending"), F.when(same, "email_domain").when(note != "", "manual")


def legacy_command(state: Column, wish: Column) -> Column:
    """The campaign command behind saving or deleting a single-slot offer."""
    deleted = F.when(state == "draft", "delete").when(state == "scheduled", "cancel").when(state == "live", "end")
    return F.when(wish == "delete", deleted).when(state.isNull(), "create").when(state == "draft", "update")


def timing_label(state: Column) -> Column:
    """When a campaign is on, in the zone's clock: only the end of a live one."""
    end = F.least("ends_at", "ended_at")
    span = F.concat(T.format_datetime(F.col("starts_at")), F.lit(" – "), T.format_datetime(end))
    fallback = F.when(state == "draft", "Timing not set").otherwise("Timing unavailable")
    return F.when((state == "live") & end.isNotNull(), F.concat(F.lit("Ends "), T.format_datetime(end))).when(F.col("starts_at").isNotNull() & F.col("ends_at").isNotNull(), span).otherwise(fallback)


def preview_label(type_label: Column, at_once: Column) -> Column:
    """Headline, kind with description, and timing of a campaign that is being edited, a line each."""
    title, about = F.trim("title"), F.trim("description")
    details = F.when(F.coalesce(about, F.lit("")) == "", type_label).otherwise(F.concat(type_label, F.lit(" · "), about))
    end = T.format_datetime(F.col("ends_at"))
    now = F.coalesce(F.concat(F.lit("Starts now · ends "), end), F.lit("Starts now · end required"))
    later = F.coalesce(F.concat(T.format_datetime(F.col("starts_at")), F.lit(" – "), end), F.lit("Scheduled start and end required"))
    return F.concat_ws("\n", F.coalesce(F.nullif(title, F.lit("")), F.lit("Your promotion headline")), details, F.when(at_once, now).otherwise(later))


_WINDOW = ["campaign_id", "venue_id", "starts_at", "ends_at"]


def _overlapping(asked: DataFrame, campaigns: DataFrame) -> DataFrame:
    """Those of the asked windows (campaign_id, venue_id, starts_at, ends_at) that meet a published, not cancelled one of another campaign of the venue, each once.

    Windows meet in the days that they touch, so no venue's windows are all in one place.
    Only windows that a campaign may have are asked about: the others fail before.
    """
    day = lambda t: F.floor(F.unix_seconds(t) / 86_400)
    touched = lambda s, e: F.explode(F.sequence(day(s), day(e)))
    held = campaigns.where("published_at IS NOT NULL AND cancelled_at IS NULL").select("venue_id", F.col("campaign_id").alias("_other"), F.col("starts_at").alias("_s"), F.least("ends_at", "ended_at").alias("_e")).where("_s < _e")
    held = held.withColumn("_day", touched(F.col("_s"), F.col("_e")))
    span = F.unix_seconds("ends_at") - F.unix_seconds("starts_at")
    mine = asked.where((F.col("starts_at") < F.col("ends_at")) & (span <= LONGEST)).select(*_WINDOW).distinct().withColumn("_day", touched(F.col("starts_at"), F.col("ends_at")))
    return mine.join(held, ["venue_id", "_day"]).where("campaign_id <> _other AND starts_at < _e AND _s < ends_at").select(*_WINDOW).distinct()


def event_after(done: Column, name: Column, moved: Column, starts_at: Column, ends_at: Column, now: Column) -> list[Column]:
    """Times of a campaign's event (available_at, expires_at, event_cancelled_at) after a command, from those before it.

    ``moved``: the command shows the campaign or moves one that is shown, so its event is put with
    its window. An event that ends at its very beginning can't be shortened; it is cancelled.
    """
    old = {c: F.col(c) for c in EVENT_TIMES}
    there = old["available_at"].isNotNull()
    begun = old["available_at"] < now
    available = F.when(done & moved, starts_at).otherwise(old["available_at"])
    expires = F.when(done & moved, ends_at).when(done & there & (name == "end") & begun, F.least(old["expires_at"], now)).otherwise(old["expires_at"])
    marked = done & there & ((name == "cancel") | ((name == "end") & ~begun))
    cancelled = F.when(done & moved, F.lit(None).cast("timestamp")).when(marked, now).otherwise(old["event_cancelled_at"])
    return [available.alias("available_at"), expires.alias("expires_at"), cancelled.alias("event_cancelled_at")]


def _with_events(rows: DataFrame, events: DataFrame | None) -> DataFrame:
    """Rows by campaign_id with the times of their events."""
    if events is None:
        return rows.withColumns({c: F.lit(None).cast("timestamp") for c in EVENT_TIMES})
    return rows.join(events.select("campaign_id", "available_at", "expires_at", F.col("cancelled_at").alias("event_cancelled_at")), "campaign_id", "left")


def transitions(campaigns: DataFrame, commands: DataFrame, claims: DataFrame, now: Column, allowances: dict[str, int | None] | None = None, events: DataFrame | None = None) -> DataFrame:
    """``commands`` (campaign_id, command, new_title, new_starts_at, new_ends_at and others) on one snapshot, with outcome, deleted, and the campaign's columns and its event's times after it.

    Each command is judged by itself against the snapshot and gives one row, also if a campaign
    has several; null new_... values leave the column as it is. "ok" comes with the new
    row, an error's code with the old one. ``events``: (campaign_id, available_at, expires_at,
    cancelled_at), at most one for each campaign.
    """
    own_columns = [c for c in commands.columns if c not in ("new_title", "new_starts_at", "new_ends_at")]
    known = _with_events(campaigns.select("venue_id", *COLUMNS), events)
    rows = commands.join(known, "campaign_id", "left").join(accounting.venue_allowances(claims, allowances), "venue_id", "left")
    name = F.col("command")
    state = T.lifecycle_state(now, *map(F.col, ("published_at", "starts_at", "ends_at", "ended_at", "cancelled_at")))
    rows = rows.withColumn("_state", F.when(F.col("venue_id").isNotNull(), state))
    edits, timed = name == "update", name.isin("update", "publish")
    new = {
        "title": F.when(edits, F.coalesce("new_title", "title")).otherwise(F.col("title")),
        "starts_at": F.when(name == "start_now", now).when(timed, F.coalesce("new_starts_at", "starts_at")).otherwise(F.col("starts_at")),
        "ends_at": F.when(timed | (name == "start_now"), F.coalesce("new_ends_at", "ends_at")).otherwise(F.col("ends_at")),
        "published_at": F.when(name == "publish", now).when(name == "start_now", F.coalesce("published_at", now)).otherwise(F.col("published_at")),
        "cancelled_at": F.when(name == "cancel", now).otherwise(F.col("cancelled_at")),
        "ended_at": F.when(name == "end", now).when(name == "cancel", F.lit(None)).otherwise(F.col("ended_at")),
    }
    for c, value in new.items():
        rows = rows.withColumn(f"_new_{c}", value)
    shown = name.isin("publish", "start_now") | (edits & (F.col("_state") == "scheduled"))
    rows = rows.withColumn("_bad", F.size(integrity.promotion_errors(*LIMITS.values(), LONGEST / 3600, required=shown, title="_new_title", starts_at="_new_starts_at", ends_at="_new_ends_at")) > 0)
    window = [F.col(c) if c in ("campaign_id", "venue_id") else F.col(f"_new_{c}").alias(c) for c in _WINDOW]
    clash = _overlapping(rows.where(shown).select(*window), campaigns).withColumnsRenamed({"starts_at": "_new_starts_at", "ends_at": "_new_ends_at"}).withColumn("_clash", F.lit(True))
    used = accounting.usage(campaigns, now).select("venue_id", F.col("month").alias("_month"), (F.col("consumed") + F.col("reserved")).alias("_used"))
    old_month, month = T.month_key(F.col("starts_at")), T.month_key(F.col("_new_starts_at"))
    counted = F.col("published_at").isNotNull() & (old_month == month) & (F.col("cancelled_at").isNull() | ((F.col("starts_at") <= now) & (F.col("cancelled_at") > F.col("starts_at"))))
    own = F.coalesce(counted, F.lit(False)).cast("int")
    rows = rows.withColumn("_month", month).withColumn("_own", own).join(used, ["venue_id", "_month"], "left").join(clash, ["campaign_id", "venue_id", "_new_starts_at", "_new_ends_at"], "left")
    future = (name == "publish") | (edits & (F.col("_state") == "scheduled"))
    slot = (name == "publish") | ((name == "start_now") & ((F.col("_state") == "draft") | ~old_month.eqNullSafe(month))) | (edits & (F.col("_state") == "scheduled") & ~old_month.eqNullSafe(month))
    outcome = F.coalesce(
        F.when(F.col("venue_id").isNull(), "not_found"), F.when(F.col("known").isNull(), "forbidden"), guard(F.col("_state"), name),
        F.when(timed | (name == "start_now"), F.when(F.col("_bad"), "invalid")), F.when(future & (F.col("_new_starts_at") <= now), "start_passed"),
        F.when(shown & F.col("_clash"), "overlap"), F.when(slot & (F.coalesce("_used", F.lit(0)) - F.col("_own") >= F.col("allowance")), "quota"), F.lit("ok"),
    )
    rows = rows.withColumn("outcome", outcome)
    done = F.col("outcome") == "ok"
    event = event_after(done, name, shown, F.col("_new_starts_at"), F.col("_new_ends_at"), now)
    return rows.select(*own_columns, "venue_id", "outcome", (done & (name == "delete")).alias("deleted"), *event, *[F.when(done, F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in COLUMNS[1:]])


def refused(requests: DataFrame, campaigns: DataFrame, claims: DataFrame) -> DataFrame:
    """``requests`` (campaign_id, request, user_id, command) with ``error``, the first reason before anything is changed: a malformed id, no such campaign, no verified claim of the user on its venue, the wrong state (a column of campaigns)."""
    verified = claims.where("status = 'verified'").select("user_id", "venue_id", F.lit(True).alias("_claimed")).distinct()
    found = requests.join(campaigns.select("campaign_id", "venue_id", F.col("state").alias("_state")), "campaign_id", "left").join(verified, ["user_id", "venue_id"], "left")
    wrong = guard(F.col("_state"), F.col("command"))
    error = F.when(~F.col("request").rlike(X.UUID), "bad_id").when(F.col("venue_id").isNull(), "not_found").when(F.col("_claimed").isNull(), "forbidden").otherwise(wrong)
    return found.withColumn("error", error).drop("_state", "_claimed")


def got(requests: DataFrame, campaigns: DataFrame, claims: DataFrame, now: Column, allowances: dict[str, int | None] | None = None) -> DataFrame:
    """``requests`` (campaign_id, request, user_id) with ``outcome``: bad_id, not_found, forbidden or ok; and for ok the campaign's title and state and what is left of its venue's offers this month (null without limit)."""
    verified = claims.where("status = 'verified'").select("user_id", "venue_id", F.lit(True).alias("_claimed")).distinct()
    used = accounting.usage(campaigns, now).where(F.col("month") == T.month_key(now)).select("venue_id", "consumed", "reserved")
    zero = F.lit(0).cast("long")
    per = accounting.venue_allowances(claims, allowances).join(used, "venue_id", "left").select("venue_id", quota_left(F.col("allowance"), F.coalesce("consumed", zero), F.coalesce("reserved", zero)).alias("_remaining"))
    state = T.lifecycle_state(now, *map(F.col, ("published_at", "starts_at", "ends_at", "ended_at", "cancelled_at")))
    found = requests.join(campaigns.select("campaign_id", "venue_id", F.col("title").alias("_title"), state.alias("_state")), "campaign_id", "left").join(verified, ["user_id", "venue_id"], "left").join(per, "venue_id", "left")
    outcome = F.when(~F.col("request").rlike(X.UUID), "bad_id").when(F.col("_state").isNull(), "not_found").when(F.col("_claimed").isNull(), "forbidden").otherwise("ok")
    shown = [F.when(F.col("outcome") == "ok", F.col(f"_{c}")).alias(c) for c in ("title", "state", "remaining")]
    return found.withColumn("outcome", outcome).select(*requests.columns, "outcome", *shown)


def created(campaigns: DataFrame, requests: DataFrame, claims: DataFrame, venues: DataFrame, key: str) -> DataFrame:
    """``requests`` (key, user_id, venue_id and the draft's columns) with ``outcome`` and, where that is "ok", the id of the draft that is inserted: one after the largest there is."""
    verified = claims.where("status = 'verified'").select("user_id", "venue_id", F.lit(True).alias("_claimed")).distinct()
    rows = requests.join(venues.select("venue_id", F.lit(True).alias("_venue")), "venue_id", "left").join(verified, ["user_id", "venue_id"], "left")
    bad = F.size(integrity.promotion_errors(*LIMITS.values(), LONGEST / 3600, required=F.lit(False))) > 0
    rows = rows.withColumn("outcome", F.when(F.col("_venue").isNull(), "venue_not_found").when(F.col("_claimed").isNull(), "forbidden").when(bad, "invalid").otherwise("ok")).drop("_venue", "_claimed")
    return rows.join(mutations.numbered(campaigns, rows.where("outcome = 'ok'").select(key), "campaign_id", key), key, "left")


def listed(campaigns: DataFrame, claims: DataFrame, now: Column, allowances: dict[str, int | None] | None = None) -> DataFrame:
    """Campaigns of each verified claim's venue, with what is left of the venue's offers this month (null without limit)."""
    used = accounting.usage(campaigns, now).where(F.col("month") == T.month_key(now)).select("venue_id", (F.col("consumed") + F.col("reserved")).alias("_used"))
    per = accounting.venue_allowances(claims, allowances).join(used, "venue_id", "left")
    left = F.when(F.col("allowance").isNotNull(), F.greatest(F.col("allowance") - F.coalesce("_used", F.lit(0)), F.lit(0).cast("long")))
    return claims.where("status = 'verified'").join(per.select("venue_id", left.alias("remaining")), "venue_id").join(campaigns, "venue_id")


_ZONE = zoneinfo.ZoneInfo(T.ZONE)


def _end(c: dict) -> dt.datetime | None:
    return min((t for t in (c["ends_at"], c["ended_at"]) if t), default=None)


def _state(c: dict, now: dt.datetime) -> str:
    end = _end(c)
    if c["cancelled_at"]:
        return "cancelled"
    if not (c["published_at"] and c["starts_at"] and c["ends_at"]):
        return "draft"
    if end <= c["starts_at"]:
        return "ended" if c["ended_at"] else "draft"
    return "scheduled" if now < c["starts_at"] else "live" if now < end else "ended"


def _month(t: dt.datetime) -> str:
    return t.replace(tzinfo=dt.UTC).astimezone(_ZONE).strftime("%Y-%m")


class Venue:
    """A venue's campaigns while commands are applied one after another: published windows in order of their start, published campaigns by month."""

    def __init__(self, rows: list[dict]):
        self.held = {r["campaign_id"]: {c: r[c] for c in COLUMNS} for r in rows}
        self.events = {r["campaign_id"]: {c: r[c] for c in EVENT_TIMES} for r in rows if r.get("available_at")}
        self.windows: list[tuple[dt.datetime, int]] = []
        self.months: dict[str, set[int]] = defaultdict(set)
        self.longest = dt.timedelta(0)
        for r in rows:
            self._place(r)

    def _place(self, c: dict, sign: bool = True) -> None:
        """Put a campaign's window and month in, or take them out."""
        if not (c["published_at"] and c["starts_at"]):
            return
        ids = self.months[_month(c["starts_at"])]
        ids.add(c["campaign_id"]) if sign else ids.discard(c["campaign_id"])
        end = _end(c)
        if c["cancelled_at"] or end is None or end <= c["starts_at"]:
            return
        at = bisect.bisect_left(self.windows, (c["starts_at"], c["campaign_id"]))
        if sign:
            self.windows.insert(at, (c["starts_at"], c["campaign_id"]))
            self.longest = max(self.longest, end - c["starts_at"])
        else:
            del self.windows[at]

    def clashes(self, c: dict) -> bool:
        first = bisect.bisect_left(self.windows, (c["starts_at"] - self.longest, -1))
        last = bisect.bisect_left(self.windows, (c["ends_at"], -1))
        return any(i != c["campaign_id"] and c["starts_at"] < _end(self.held[i]) for _, i in self.windows[first:last])

    def used(self, month: str, now: dt.datetime, but: int) -> int:
        rows = [self.held[i] for i in self.months[month] if i != but]
        return sum(not c["cancelled_at"] or c["starts_at"] <= now and c["cancelled_at"] > c["starts_at"] for c in rows)

    def apply(self, command: dict) -> str:
        """Apply one command; "ok" or the code of the first error."""
        now, name, c = command["at"], command["command"], self.held.get(command["campaign_id"])
        if c is None:
            return "not_found"
        state = _state(c, now)
        if state not in ALLOWED.get(name, ()):
            return "wrong_state"
        new = dict(c)
        if name == "cancel":
            new |= {"cancelled_at": now, "ended_at": None}
        elif name == "end":
            new["ended_at"] = now
        elif name != "delete":
            error = self._revised(c, new, command, state, now)
            if error:
                return error
        self._tell(c["campaign_id"], name, state, new, now)
        self._place(c, False)
        del self.held[c["campaign_id"]]
        if name != "delete":
            self.held[c["campaign_id"]] = new
            self._place(new)
        return "ok"

    def _tell(self, campaign: int, name: str, state: str, new: dict, now: dt.datetime) -> None:
        """Change the campaign's event as its command asks."""
        event = self.events.get(campaign)
        if name in ("publish", "start_now") or name == "update" and state == "scheduled":
            self.events[campaign] = {"available_at": new["starts_at"], "expires_at": new["ends_at"], "event_cancelled_at": None}
        elif event and name == "end" and event["available_at"] < now:
            event["expires_at"] = min(event["expires_at"], now)
        elif event and name in ("cancel", "end"):
            event["event_cancelled_at"] = now

    def _revised(self, c: dict, new: dict, command: dict, state: str, now: dt.datetime) -> str | None:
        """Fill in ``new`` for publish, start_now or update, or the reason against it."""
        name = command["command"]
        if name == "update" and command.get("new_title") is not None:
            new["title"] = command["new_title"]
        new["ends_at"] = command.get("new_ends_at") or c["ends_at"]
        new["starts_at"] = now if name == "start_now" else command.get("new_starts_at") or c["starts_at"]
        if name != "update":
            new["published_at"] = now if name == "publish" else c["published_at"] or now
        shown = name != "update" or state == "scheduled"
        if any(len((new[k] or "").strip()) > most for k, most in LIMITS.items()) or bool(new["starts_at"]) != bool(new["ends_at"]):
            return "invalid"
        if new["starts_at"] and not 0 < (new["ends_at"] - new["starts_at"]).total_seconds() <= LONGEST:
            return "invalid"
        if shown and not ((new["title"] or "").strip() and new["starts_at"]):
            return "invalid"
        if shown and name != "start_now" and new["starts_at"] <= now:
            return "start_passed"
        if shown and self.clashes(new):
            return "overlap"
        month = _month(new["starts_at"]) if shown else ""
        moved = not c["starts_at"] or _month(c["starts_at"]) != month
        if shown and (state == "draft" or moved) and command["allowance"] is not None and self.used(month, now, c["campaign_id"]) >= command["allowance"]:
            return "quota"
        return None


def _plain(rows: pd.DataFrame) -> list[dict]:
    """Rows with None for what is missing and times as datetimes."""
    clear = lambda v: None if v is None or v is pd.NaT or (isinstance(v, float) and v != v) else v.to_pydatetime() if isinstance(v, pd.Timestamp) else v
    return [{k: clear(v) for k, v in r.items()} for r in rows.to_dict("records")]


def parts(campaigns: DataFrame, commands: DataFrame) -> DataFrame:
    """(venue_id, campaign_id, part) of venues with commands: campaigns of different parts can't meet, whatever commands come through.

    Two campaigns meet in windows that overlap, or in a month whose offers are counted. A
    campaign's windows are at most LONGEST long and begin where it begins now, where a command
    would have it begin, or at the time of a command that starts it now. Windows of a
    venue that overlap form clusters; clusters and months that one campaign touches are one
    part. A part is named by its smallest member.
    """
    own = campaigns.join(commands.select("venue_id").distinct(), "venue_id", "left_semi").select("venue_id", "campaign_id", "starts_at", "ends_at")
    asked = commands.select("venue_id", "campaign_id", F.when(F.col("command") == "start_now", F.col("at")).otherwise(F.col("new_starts_at")).alias("starts_at"), F.lit(None).cast("timestamp").alias("ends_at"))
    longest = T.plus(F.col("starts_at"), LONGEST)
    windows = own.unionByName(asked).where("starts_at IS NOT NULL").withColumn("ends_at", F.coalesce(F.greatest("ends_at", longest), longest)).distinct()
    clustered = joins.clusters(windows, "venue_id", "starts_at", "ends_at")
    nodes = clustered.select("venue_id", "campaign_id", F.concat(F.lit("w"), F.unix_micros("cluster").cast("string")).alias("node"))
    counted = commands.where("allowance IS NOT NULL").select("venue_id").distinct()
    months = windows.join(counted, "venue_id", "left_semi").select("venue_id", "campaign_id", F.concat(F.lit("m"), T.month_key(F.col("starts_at"))).alias("node"))
    nodes = nodes.unionByName(months).distinct()
    first = nodes.groupBy("venue_id", "campaign_id").agg(F.min("node").alias("first"))
    touching = nodes.join(first, ["venue_id", "campaign_id"])
    named = joins.components(touching.where("node <> first").select("venue_id", F.col("first").alias("a"), F.col("node").alias("b")).distinct(), "venue_id")
    found = first.join(named, (first["venue_id"] == named["venue_id"]) & (first["first"] == named["node"]), "left").select(first["venue_id"], first["campaign_id"], F.coalesce(named["component"], first["first"]).alias("part"))
    # a draft without times meets nobody
    everyone = own.select("venue_id", "campaign_id").unionByName(commands.select("venue_id", "campaign_id")).distinct()
    return everyone.join(found, ["venue_id", "campaign_id"], "left").withColumn("part", F.coalesce("part", F.concat(F.lit("c"), F.col("campaign_id").cast("string"))))


def applied(campaigns: DataFrame, commands: DataFrame, events: DataFrame | None = None, split: bool = True) -> DataFrame:
    """Each command (venue_id, seq, campaign_id, command, at, allowance, new_title, new_starts_at, new_ends_at), in order of seq within its venue: outcome, deleted, and the campaign's columns and its event's times after it.

    One part of a venue's campaigns and log is one task's work: order is the point of it.
    ``split=False`` takes a venue as one part. A command looks only at windows near its own
    and at its month.
    """
    for c, kind in (("new_title", "string"), ("new_starts_at", "timestamp"), ("new_ends_at", "timestamp")):
        if c not in commands.columns:
            commands = commands.withColumn(c, F.lit(None).cast(kind))

    def run(key: tuple, own: pd.DataFrame, log: pd.DataFrame) -> pd.DataFrame:
        venue = Venue(_plain(own[COLUMNS + EVENT_TIMES]))
        told = []
        for c in _plain(log.sort_values("seq")):
            outcome, id_ = venue.apply(c), c["campaign_id"]
            after, event = venue.held.get(id_, {}), venue.events.get(id_, {})
            told.append({"venue_id": key[0], "seq": c["seq"], "campaign_id": id_, "command": c["command"], "outcome": outcome, "deleted": outcome == "ok" and c["command"] == "delete", **{k: after.get(k) for k in COLUMNS[1:]}, **{k: event.get(k) for k in EVENT_TIMES}})
        names = [f.name for f in schema]
        return pd.DataFrame(told, columns=names).astype(dict.fromkeys(TIMES + EVENT_TIMES, "datetime64[us]"))

    schema = StructType.fromDDL(APPLIED)
    own = _with_events(campaigns.select("venue_id", *COLUMNS), events)
    if split:
        named = parts(campaigns, commands)
        own, log = own.join(named, ["venue_id", "campaign_id"]), commands.join(named, ["venue_id", "campaign_id"])
    else:
        own, log = own.withColumn("part", F.lit("")), commands.withColumn("part", F.lit(""))
    own, log = own.toDF(*own.columns), log.toDF(*log.columns)  # both may come from one table
    return own.groupBy(own["venue_id"], own["part"]).cogroup(log.groupBy(log["venue_id"], log["part"])).applyInPandas(run, schema)


def replay(campaigns: DataFrame, commands: DataFrame) -> DataFrame:
    """(venue_id, seq, campaign_id, command, outcome) of ``applied``."""
    return applied(campaigns, commands).select(*RESULT)


def _latest(log: DataFrame, columns: list[str]) -> DataFrame:
    """Of each campaign the columns after its last command that was carried out."""
    return log.where("outcome = 'ok'").groupBy("campaign_id").agg(F.max_by(F.struct(*columns), "seq").alias("_after"))


def replayed(campaigns: DataFrame, log: DataFrame) -> DataFrame:
    """The campaigns after the commands of ``applied``; those without any are as they were, those that were deleted are gone."""
    after = campaigns.join(_latest(log, ["deleted", *COLUMNS[1:]]), "campaign_id", "left").where("NOT coalesce(_after.deleted, false)")
    changed = F.col("_after").isNotNull()
    return after.select("venue_id", *[F.when(changed, F.col(f"_after.{c}")).otherwise(F.col(c)).alias(c) if c != "campaign_id" else F.col(c) for c in COLUMNS])


def replayed_events(events: DataFrame, log: DataFrame) -> DataFrame:
    """(campaign_id, venue_id, available_at, expires_at, cancelled_at): the events after the commands of ``applied``, one for each campaign that has been shown."""
    after = _latest(log, ["venue_id", *EVENT_TIMES]).where("_after.available_at IS NOT NULL").select("campaign_id", F.col("_after.venue_id").alias("venue_id"), F.col("_after.available_at").alias("available_at"), F.col("_after.expires_at").alias("expires_at"), F.col("_after.event_cancelled_at").alias("cancelled_at"))
    old = events.select("campaign_id", "venue_id", "available_at", "expires_at", "cancelled_at")
    return after.unionByName(old.join(after.select("campaign_id"), "campaign_id", "left_anti"))
