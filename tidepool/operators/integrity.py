"""Integrity rules: each gives the rows that break it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tidepool.functions import text as X
from tidepool.sources.domain import DAYS, KINDS

#: Rules as SQL conditions that hold for good rows; a null condition holds.
USER = {"credential": "google_id IS NOT NULL OR password_hash IS NOT NULL"}
SAVED = {"rating": "rating IS NULL OR rating BETWEEN 1 AND 5"}
CAMPAIGN = {
    "published_complete": "published_at IS NULL OR (coalesce(title, '') <> '' AND starts_at IS NOT NULL AND ends_at IS NOT NULL)",
    "terminal_once": "ended_at IS NULL OR cancelled_at IS NULL",
    "terminal_published": "(ended_at IS NULL AND cancelled_at IS NULL) OR published_at IS NOT NULL",
}


def violations(df: DataFrame, rules: dict[str, str]) -> DataFrame:
    """Rows that break a rule, with the names of the rules they break."""
    return named_violations(df, {name: ~F.coalesce(F.expr(rule), F.lit(True)) for name, rule in rules.items()})


def named_violations(df: DataFrame, broken: dict[str, Column]) -> DataFrame:
    return df.withColumn("broken", errors(broken)).where(F.size("broken") > 0)


def errors(broken: dict[str, Column]) -> Column:
    """Names of the conditions that are true, in order."""
    return F.filter(F.array(*[F.when(c, name) for name, c in broken.items()]), lambda x: x.isNotNull())


def outside(column: str, values: list[str]) -> Column:
    return ~F.col(column).isin(*values)


def outside_arrays(column: str, values: list[list[str]]) -> Column:
    return ~reduce(lambda a, b: a | b, [F.col(column) == F.array(*map(F.lit, v)) for v in values])


def not_positive(column: str) -> Column:
    return F.col(column) <= 0


def bad_window(start: str, end: str, longest: int) -> Column:
    """Only one of two ends, an end not after the start, or more than ``longest`` seconds."""
    s, e = F.col(start), F.col(end)
    return (s.isNull() != e.isNull()) | F.coalesce((e <= s) | (F.unix_seconds(e) - F.unix_seconds(s) > longest), F.lit(False))


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def orphans(df: DataFrame, parents: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with a whole reference to a parent that isn't there."""
    whole = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    return df.where(whole).join(parents.select(*keys), keys, "left_anti")


def promotion_errors(max_title: int = 80, max_description: int = 200, max_code: int = 30, hours: float = 24, required: Column | bool = False, title: str = "title", starts_at: str = "starts_at", ends_at: str = "ends_at", type_: str | None = None) -> Column:
    """What is wrong with a campaign; where ``required`` holds (it is shown, not a draft) it also needs a headline and both times. ``type_`` names a column that must hold one of the types."""
    must = required if isinstance(required, Column) else F.lit(required)
    headline = F.trim(F.coalesce(title, F.lit("")))
    start, end = F.col(starts_at), F.col(ends_at)
    typed = {} if type_ is None else {"type": ~F.coalesce(F.col(type_).isin(*KINDS), F.lit(False))}
    return errors({
        **typed, "title": must & (headline == ""), "title_length": F.length(headline) > max_title, "description_length": F.length(F.trim("description")) > max_description, "code_length": F.length(F.trim("deal_code")) > max_code,
        "start": must & start.isNull(), "end": must & end.isNull(), "window": start.isNull() != end.isNull(),
        "duration": F.unix_seconds(end) - F.unix_seconds(start) > hours * 3600, "order": end <= start,
    })


#: Rules of queued deliveries: what a row's status says of its times and its batch.
DELIVERY = {
    "lease": "(status = 'sending') = (lease_expires_at IS NOT NULL)",
    "schedule": "status <> 'pending' OR next_attempt_at IS NOT NULL",
    "attempts": "status = 'pending' OR attempt_count > 0",
    "sent_time": "(status = 'sent') = (sent_at IS NOT NULL)",
    "text_batch": "channel <> 'text' OR status <> 'sent' OR batch_id IS NOT NULL",
}
#: Rule of events: a campaign's has the campaign, a schedule's has none.
EVENT = {"subject": "(event_type = 'happy_hour_started' AND promotion_id IS NULL) OR (event_type = 'promotion_started' AND promotion_id IS NOT NULL)"}
#: What the columns of each table may hold; null is allowed.
DOMAINS = {
    "deliveries": {"status": ["pending", "sending", "sent", "failed"], "channel": ["email", "text"], "distribution_source": ["organic_follow", "saved_alert", "paid_boost"]},
    "events": {"event_type": ["happy_hour_started", "promotion_started"]},
    "campaigns": {"type": KINDS},
    "claims": {"status": ["verified", "pending", "denied"], "verification_method": ["domain", "phone", "manual"], "plan": ["free", "paid"]},
    "photos": {"photo_type": ["venue", "menu_item"], "status": ["published", "in_review", "rejected"]},
    "images": {"origin": ["upload", "url", "generated", "edited", "owner"]},
    "saved": {"status": ["favorite", "want-to-try", "been-to"]},
    "sessions": {"role": ["user", "restaurant"]},
    "submissions": {"status": ["pending", "approved", "denied"]},
    "users": {"plan": ["free", "paid"]},
    "sends": {"channel": ["email", "text"]},
}


def outside_domains(df: DataFrame, table: str, key: str) -> DataFrame:
    """(table, key, broken): rows of a table with the columns whose value isn't one of their domain's; columns that ``df`` doesn't have are not looked at."""
    rules = {c: outside(c, values) for c, values in DOMAINS[table].items() if c in df.columns}
    return named_violations(df, rules).select(F.lit(table).alias("table"), F.col(key).cast("string").alias("key"), F.array_join("broken", ",").alias("broken"))


#: What alerts may be about, in canonical order; and what an alert that doesn't say is about.
ALERT_KINDS, ALERT_DEFAULT = ["happy_hour", "promotion"], ["happy_hour"]
#: Most characters of an alert's search text.
QUERY = 80


def alert_kinds(kinds: Column) -> Column:
    """(kinds, errors) of a list of texts: the known ones in canonical order; ``none`` if it is empty, ``unknown`` if it has another. A null list is the default and no error."""
    given = F.filter(F.transform(kinds, X.clean), lambda x: x != "")
    known = F.array_intersect(F.array(*map(F.lit, ALERT_KINDS)), given)
    wrong = errors({"none": F.size(given) == 0, "unknown": F.exists(given, lambda x: ~x.isin(*ALERT_KINDS))})
    return F.struct(F.when(kinds.isNull(), F.array(*map(F.lit, ALERT_DEFAULT))).otherwise(known).alias("kinds"), F.when(kinds.isNull(), F.array().cast("array<string>")).otherwise(wrong).alias("errors"))


def alert_filters(days: str = "days", neighborhood: str = "neighborhood", deal_type: str = "deal_type", feature: str = "feature", query: str = "query") -> Column:
    """An alert's filters as they are kept: days that are none go, texts are cleaned, the search text is cut."""
    named = F.filter(F.transform(F.coalesce(days, F.array().cast("array<string>")), X.clean), lambda x: x.isin(*DAYS))
    return F.struct(named.alias("days"), *[X.clean(F.col(c)).alias(n) for n, c in (("neighborhood", neighborhood), ("deal_type", deal_type), ("feature", feature))], F.substring(X.clean(F.col(query)), 1, QUERY).alias("query"))


def alert_channels(given: Column) -> Column:
    """(email, text) from JSON text: mail unless it is switched off with false itself, text messages only for a value that counts as true. No JSON is no choice."""
    at = lambda f: F.try_variant_get(F.try_parse_json(given), f"$.{f}", "variant")
    kind, text = F.schema_of_variant(at("text")), F.try_variant_get(F.try_parse_json(given), "$.text", "string")
    off = F.coalesce((F.schema_of_variant(at("email")) == "BOOLEAN") & ~F.try_variant_get(F.try_parse_json(given), "$.email", "boolean"), F.lit(False))
    false = kind.isNull() | (kind == "VOID") | ((kind == "BOOLEAN") & (text == "false")) | ((kind == "STRING") & (text == "")) | (~kind.isin("BOOLEAN", "STRING", "VOID") & F.coalesce(text.try_cast("double") == 0, F.lit(False)))
    return F.struct((~off).alias("email"), (~false).alias("text"))


def _blank(c: str) -> Column:
    return X.clean(F.col(c)) == ""


def _no_texts(c: str) -> Column:
    """Not a list of one or more texts."""
    return F.coalesce((F.size(c) < 1) | F.exists(c, lambda x: F.coalesce(X.clean(x), F.lit("")) == ""), F.lit(True))


def _not_like(c: str, pattern: str) -> Column:
    return ~F.coalesce(F.col(c).rlike(pattern), F.lit(False))


def _filled_not_like(c: str, pattern: str) -> Column:
    return ~_blank(c) & ~X.clean(F.col(c)).rlike(pattern)


def _bad_days(c: str) -> Column:
    return _no_texts(c) | F.coalesce(F.exists(c, lambda x: ~x.isin(*DAYS)), F.lit(False))


def catalogue_errors() -> Column:
    """Names of the rules that a catalogue record breaks: (id, name, neighborhood, address, lat, lng, days, start_time, end_time, deals, vibe, website, verified, last_verified_present, source_url, deal_types, features, image)."""
    return errors({
        "id": F.col("id").isNull(), "name": _blank("name"), "neighborhood": _blank("neighborhood"), "address": _blank("address"),
        "lat": F.col("lat").isNull() | F.isnan("lat"), "lng": F.col("lng").isNull() | F.isnan("lng"), "lat_range": ~F.col("lat").between(-90, 90), "lng_range": ~F.col("lng").between(-180, 180),
        "days": _bad_days("days"), "start_time": _not_like("start_time", X.TIME), "end_time": _not_like("end_time", X.TIME), "deals": _no_texts("deals"), "vibe": _blank("vibe"),
        "website": _not_like("website", X.URL), "verified": F.col("verified").isNull(), "last_verified": ~F.col("last_verified_present"), "source_url": _not_like("source_url", X.URL),
        "deal_types": _no_texts("deal_types"), "features": _no_texts("features"), "image": F.col("image").isNotNull() & (_blank("image") | _not_like("image", X.STORED_IMAGE)),
    })


def _listing_rules(coordinates: bool = False) -> dict[str, Column]:
    rules = {
        "name": _blank("name"), "neighborhood": _blank("neighborhood"), "address": _blank("address"), "phone": _filled_not_like("phone", X.PHONE), "website": _not_like("website", X.URL),
        "source_url": ~X.clean(F.coalesce(F.nullif(F.col("source_url"), F.lit("")), F.col("website"))).rlike(X.URL), "days": _bad_days("days"), "start_time": _not_like("start_time", X.TIME), "end_time": _not_like("end_time", X.TIME),
        "deals": _no_texts("deals"), "vibe": _blank("vibe"), "coordinates": F.lit(coordinates) & (F.col("lat").isNull() | F.col("lng").isNull()), "lat_range": ~F.col("lat").between(-90, 90), "lng_range": ~F.col("lng").between(-180, 180),
        "image": _filled_not_like("image", X.STORED_IMAGE),
    }
    return {k: F.coalesce(v, F.lit(False)) for k, v in rules.items()}


def listing_errors(coordinates: bool = False) -> Column:
    """Names of the rules that a submitted listing breaks; with ``coordinates`` it needs a place."""
    return errors(_listing_rules(coordinates))


def submission_errors() -> Column:
    """Those of the listing, and of its contact (contact_name, contact_email)."""
    return errors({**_listing_rules(), "contact_name": _blank("contact_name"), "contact_email": _not_like("contact_email", X.EMAIL)})


def owner_patch_errors() -> Column:
    """Names of the rules that an owner's edit breaks; its image must be one of the venue's own."""
    rules = {k: v for k, v in _listing_rules().items() if k in ("days", "start_time", "end_time", "deals", "vibe", "address", "website", "phone")}
    order = ["days", "start_time", "end_time", "deals", "vibe", "address", "website", "phone"]
    return errors({**{k: rules[k] for k in order}, "image": _filled_not_like("image", X.OWN_IMAGE)})
