"""Instants, wall clocks and recurring schedules in one time zone, exact across its clock changes.

Instants are timestamps in a session whose zone is UTC; a wall clock is a timestamp whose
fields are those of the clock on the wall.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

ZONE = "America/Los_Angeles"
#: An instant as text: date, time, and an offset that must be there.
INSTANT = r"^(\d{4}-\d{2}-\d{2})T(\d{2}:\d{2}(?::\d{2}(?:\.\d{1,9})?)?)(Z|[+-]\d{2}(?::?\d{2})?)$"
#: A wall clock as text, without an offset.
WALL = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2})?$"
CLOCK = r"^([01]\d|2[0-3]):[0-5]\d$"


def local(instant: Column, zone: str = ZONE) -> Column:
    """Wall clock of an instant."""
    return F.from_utc_timestamp(instant, zone)


def plus(instant: Column, seconds) -> Column:
    return F.timestamp_micros(F.unix_micros(instant) + (seconds if isinstance(seconds, Column) else F.lit(seconds)).cast("long") * 1_000_000)


def parse_instant(text: Column) -> Column:
    """An instant from text with an offset; null without one, or for a date or time that doesn't exist."""
    offset = F.regexp_extract(text, INSTANT, 3)
    hours, minutes = F.substring(offset, 2, 2).try_cast("int"), F.coalesce(F.regexp_extract(offset, r"^...:?(\d\d)$", 1).try_cast("int"), F.lit(0))
    shift = F.when(offset == "Z", 0).otherwise(F.when(F.substring(offset, 1, 1) == "-", -1).otherwise(1) * (hours * 3600 + minutes * 60))
    stamp = F.concat(F.regexp_extract(text, INSTANT, 1), F.lit(" "), F.regexp_extract(text, INSTANT, 2))
    # one in UTC, as most are, needs no pattern for its parts
    utc = F.replace(F.substr(text, F.lit(1), F.length(text) - 1), F.lit("T"), F.lit(" ")).try_cast("timestamp")
    return F.when(text.rlike(INSTANT), F.when(text.endswith("Z"), utc).otherwise(plus(stamp.try_cast("timestamp"), -shift)))


def zone_offset(instant: Column, zone: str = ZONE) -> Column:
    """Seconds that the wall clock is ahead of UTC."""
    return F.unix_seconds(local(instant, zone)) - F.unix_seconds(instant)


def same_wall_clock(instant: Column, wall: Column, zone: str = ZONE) -> Column:
    return local(instant, zone) == wall


def _candidates(wall: Column, zone: str) -> tuple[Column, Column]:
    """First and last instant at which the wall shows this clock; null if it never does."""
    near = F.to_utc_timestamp(wall, zone)
    at = [F.when(local(x, zone) == wall, x) for x in (plus(near, -3600), near, plus(near, 3600))]
    return F.least(*at), F.greatest(*at)


def wall_to_instant(wall: Column, choose: str = "reject", zone: str = ZONE) -> Column:
    """The instant of a wall clock. A clock that is skipped gives null; one that comes twice gives the earlier or later one, or null to reject it."""
    first, last = _candidates(wall, zone)
    return {"earlier": first, "later": last}.get(choose, F.when(first == last, first))


def wall_status(text: Column, zone: str = ZONE) -> Column:
    """invalid, nonexistent, ambiguous or resolved, for wall clock text."""
    wall = F.when(text.rlike(WALL), F.replace(text, F.lit("T"), F.lit(" "))).try_cast("timestamp")
    first, last = _candidates(wall, zone)
    return F.when(wall.isNull(), "invalid").when(first.isNull(), "nonexistent").when(first != last, "ambiguous").otherwise("resolved")


def date_key(instant: Column, zone: str = ZONE) -> Column:
    return F.date_format(local(instant, zone), "yyyy-MM-dd")


def month_key(instant: Column, zone: str = ZONE) -> Column:
    return F.date_format(local(instant, zone), "yyyy-MM")


def clock_key(instant: Column, zone: str = ZONE) -> Column:
    return F.date_format(local(instant, zone), "HH:mm")


def day_start(date: Column, zone: str = ZONE) -> Column:
    """The instant at which a date begins."""
    return wall_to_instant(date.cast("timestamp"), "earlier", zone)


def day_end(date: Column, zone: str = ZONE) -> Column:
    return day_start(F.date_add(date, 1), zone)


def valid_date(text: Column) -> Column:
    """Whether text is a date of the calendar, in full form."""
    return text.rlike(r"^\d{4}-\d{2}-\d{2}$") & text.try_cast("date").isNotNull()


def weekday(date: Column) -> Column:
    return F.date_format(date, "EEEE")


def clock_minutes(text: Column) -> Column:
    """Minutes since midnight of an HH:MM clock, null for anything else."""
    return F.when(text.rlike(CLOCK), F.substring(text, 1, 2).try_cast("int") * 60 + F.substring(text, 4, 2).try_cast("int"))


def occurrence(date: Column, days: Column, start_min: Column, end_min: Column, zone: str = ZONE) -> Column:
    """(starts_at, ends_at) of a weekly rule on a date; null where it doesn't take place. The start takes the earlier, the end the later of two equal clocks."""
    wall = lambda m: F.timestamp_seconds(F.unix_seconds(date.cast("timestamp")) + m * 60)
    start, end = wall_to_instant(wall(start_min), "earlier", zone), wall_to_instant(wall(end_min), "later", zone)
    return F.when(F.array_contains(days, weekday(date)) & (end_min > start_min) & (end > start), F.struct(start.alias("starts_at"), end.alias("ends_at")))


def schedule_live(now: Column, days: Column, start_min: Column, end_min: Column, zone: str = ZONE) -> Column:
    """Whether a weekly rule is on, from its start up to but not at its end."""
    today = occurrence(local(now, zone).cast("date"), days, start_min, end_min, zone)
    return F.coalesce((today.starts_at <= now) & (now < today.ends_at), F.lit(False))


def schedule_live_closed(now: Column, days: Column, start_min: Column, end_min: Column, zone: str = ZONE) -> Column:
    """The same by minutes of the wall clock, the end included."""
    wall = local(now, zone)
    minute = F.hour(wall) * 60 + F.minute(wall)
    return F.array_contains(days, F.date_format(wall, "EEEE")) & minute.between(start_min, end_min)


def effective_end(ends_at: Column, ended_at: Column) -> Column:
    return F.least(ends_at, ended_at)


def lifecycle_state(now: Column, published_at: Column, starts_at: Column, ends_at: Column, ended_at: Column, cancelled_at: Column) -> Column:
    """cancelled, draft, scheduled, live or ended; the order of the cases matters."""
    end = effective_end(ends_at, ended_at)
    return (
        F.when(cancelled_at.isNotNull(), "cancelled")
        .when(published_at.isNull() | starts_at.isNull() | ends_at.isNull(), "draft")
        .when(ended_at.isNotNull() & (end <= starts_at), "ended")
        .when(end <= starts_at, "draft")
        .when(now < starts_at, "scheduled")
        .when(now < end, "live")
        .otherwise("ended")
    )


def countdown(now: Column, target: Column) -> Column:
    """Minutes left, rounded up, as Xm, Xh or Xh Ym; null at the target and after it."""
    left = F.ceil((F.unix_micros(target) - F.unix_micros(now)) / 60_000_000)
    h, m = F.floor(left / 60), left % 60
    return F.when(target > now, F.when(h == 0, F.concat(m.cast("string"), F.lit("m"))).when(m == 0, F.concat(h.cast("string"), F.lit("h"))).otherwise(F.concat(h.cast("string"), F.lit("h "), m.cast("string"), F.lit("m"))))


def format_clock(instant: Column, zone: str = ZONE) -> Column:
    return F.date_format(local(instant, zone), "h:mm a")


def format_datetime(instant: Column, zone: str = ZONE) -> Column:
    """Weekday, day and clock with the zone's abbreviation, which tells summer from winter time."""
    summer = zone_offset(instant, zone) == -7 * 3600
    return F.concat(F.date_format(local(instant, zone), "EEE, MMM d, h:mm a "), F.when(summer, "PDT").otherwise("PST"))


def format_input(instant: Column, zone: str = ZONE) -> Column:
    return F.date_format(local(instant, zone), "yyyy-MM-dd'T'HH:mm")


def iso(instant: Column) -> Column:
    return F.date_format(instant, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def default_window(now: Column) -> tuple[Column, Column]:
    """Half an hour from now, up to the next quarter hour, and two hours on."""
    start = F.timestamp_seconds((F.ceil((F.unix_seconds(now) + 1800) / 900) * 900).cast("long"))
    return start, plus(start, 7200)
