"""Queries of projections, filters, joins, aggregates, windows, sorts and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from tidepool.functions import geo, temporal as T, text as X
from tidepool.operators import feed, joins as J, search as S
from tidepool.plans.registry import candidates, iso, local, register, state
from tidepool.plans.temporal import EVENING, NOW, campaign_state
from tidepool.sources.domain import KINDS, CAMPAIGN_NOW, DAYS, LOG_NOW, Domain, instant

_LOG = f"TIMESTAMP '{LOG_NOW}'"
_EVE = f"TIMESTAMP '{EVENING}'"
_MIN = f"(hour({local(_EVE)}) * 60 + minute({local(_EVE)}))"
ON = f"(list_contains(days, dayname({local(_EVE)})) AND {_MIN} >= start_min AND {_MIN} < end_min)"


def on(now: str = EVENING):
    return T.schedule_live(instant(now), F.col("days"), F.col("start_min"), F.col("end_min"))


# sources
register("scan_table_full", "SELECT count(*) AS n, sum(l_quantity) AS quantity FROM lineitem")(lambda d: d.raw("lineitem").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity")))
register("scan_clock", f"SELECT campaign_id, {state(NOW)} AS state FROM campaigns")(lambda d: d.campaigns().select("campaign_id", campaign_state().alias("state")))


@register("scan_parameterised_sql", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 1000")
def _(d: Domain) -> DataFrame:
    from tidepool.sources.tables import query

    return query(d.spark, "SELECT o_orderkey, o_totalprice FROM {orders} WHERE o_orderpriority = :priority AND o_totalprice > :least", orders=d.raw("orders"), priority="1-URGENT", least=1000)


#: What is wrong with which campaigns of the feed, as SQL of both engines; and with which payloads.
_SPOILT_ITEM = {"type": "campaign_id % 4001 = 7", "title": "title = '' AND campaign_id % 31 = 1", "venue": "campaign_id % 5003 = 11", "code": "campaign_id % 7001 = 13", "ends": "campaign_id % 6007 = 17"}
_NO_TIME, _CUT = "page % 11 = 3", "page % 11 = 5"
_ANY_SPOILT = " OR ".join(_SPOILT_ITEM.values())


def payloads(d: Domain) -> DataFrame:
    """(page, payload): campaigns as pages of the public feed, at most 100 in each, some with one bad element; some have no server time or are cut off."""
    if_ = lambda name, bad, good: F.when(F.expr(_SPOILT_ITEM[name]), bad).otherwise(good)
    c = d.campaigns().withColumn("page", F.floor(F.col("campaign_id") / 100)).join(d.venues().select("venue_id", "name", "neighborhood"), "venue_id")
    title = F.when(F.expr(_SPOILT_ITEM["title"]), F.lit(" ")).when(F.col("title") == "", "Untitled").otherwise(F.col("title"))
    venue = F.struct(if_("venue", F.col("venue_id") + 1, F.col("venue_id")).alias("id"), "name", X.slugify(F.col("name")).alias("slug"), "neighborhood", F.lit("").alias("image"))
    has = F.col("deal_code").isNotNull()
    code = F.when(has, if_("code", F.lit(""), F.trim("deal_code"))).when(F.expr(_SPOILT_ITEM["code"]), F.lit("X"))
    ends = if_("ends", T.plus(F.col("ends_at"), 60), F.col("ends_at"))
    item = F.struct(
        F.col("campaign_id").cast("string").alias("id"), F.col("venue_id").alias("venueId"), venue.alias("venue"), if_("type", F.lit("flash_sale"), F.col("type")).alias("type"), title.alias("title"), "description", F.lit("live").alias("state"), has.alias("hasDealCode"), code.alias("dealCode"),
        T.iso(F.col("starts_at")).alias("startsAt"), T.iso(F.col("ends_at")).alias("endsAt"), T.iso(ends).alias("effectiveEndsAt"),
    )
    pages = c.groupBy("page").agg(F.collect_list(item).alias("promotions"))
    text = F.to_json(F.struct(F.when(~F.expr(_NO_TIME), F.lit("1998-06-15T20:00:00Z")).alias("serverNow"), "promotions"))
    return pages.select("page", F.when(F.expr(_CUT), F.substr(text, F.lit(1), F.length(text) - 1)).otherwise(text).alias("payload"))


@register("scan_http_feed", f"""WITH c AS (SELECT *, campaign_id // 100 AS page FROM campaigns JOIN (SELECT venue_id FROM venues) USING (venue_id)), p AS (SELECT page, CASE WHEN {_NO_TIME} OR {_CUT} THEN 'malformed' WHEN bool_or({_ANY_SPOILT}) THEN 'invalid' END AS reason FROM c GROUP BY page)
  SELECT page, reason, NULL AS id, NULL::BIGINT AS venue_id, NULL AS title, NULL AS starts_at FROM p WHERE reason IS NOT NULL
  UNION ALL SELECT page, NULL, campaign_id::VARCHAR, venue_id, CASE WHEN title = '' THEN 'Untitled' ELSE title END, {iso('starts_at')} FROM c JOIN p USING (page) WHERE reason IS NULL""")
def _(d: Domain) -> DataFrame:
    """The campaigns of every accepted page of the feed; a page with one bad element is rejected whole, with the reason."""
    return feed.promotions(payloads(d), ["page"]).select("page", "reason", "id", "venue_id", "title", T.iso(F.col("starts_at")).alias("starts_at"))


@register("scan_referenced_keys", "SELECT image_key, count(*) AS n, string_agg(DISTINCT venue_id::VARCHAR, ',' ORDER BY venue_id::VARCHAR) AS venues FROM photos GROUP BY image_key")
def _(d: Domain) -> DataFrame:
    return d.photos().groupBy("image_key").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set(F.col("venue_id").cast("string"))), ",").alias("venues"))


register("scan_document_by_key", "SELECT doc_id, lang, length(text) AS n FROM documents WHERE doc_id = 17")(lambda d: d.raw("documents").where("doc_id = 17").select("doc_id", "lang", F.length("text").cast("long").alias("n")))

# projections
register("proj_row_rename", "SELECT c_custkey AS custKey, c_name AS name, c_acctbal AS accountBalance FROM customer")(lambda d: d.raw("customer").select(F.col("c_custkey").alias("custKey"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("accountBalance")))
register("proj_nest_struct", "SELECT alert_id, '{\"email\":' || channel_email || ',\"text\":' || channel_text || '}' AS channels FROM alerts")(lambda d: d.alerts().select("alert_id", F.to_json(F.struct(F.col("channel_email").alias("email"), F.col("channel_text").alias("text"))).alias("channels")))
register("proj_whitelist", "SELECT venue_id, start_min, end_min FROM venue_patches")(lambda d: d.venue_patches().select(*[c for c in d.venue_patches().columns if c in ("venue_id", "start_min", "end_min")]))
register("proj_public_redaction", "SELECT campaign_id, title, deal_code IS NOT NULL AS has_code, CASE WHEN created_by % 2 = 0 THEN trim(deal_code) END AS deal_code FROM campaigns")(lambda d: S.redacted(d.campaigns(), F.col("created_by") % 2 == 0))
register("proj_redact_codes", "SELECT campaign_id, venue_id, title FROM campaigns")(lambda d: d.campaigns().drop("deal_code").select("campaign_id", "venue_id", "title"))
register("proj_public_user", "SELECT user_id, name, consent_at IS NOT NULL AS sms_opted_in, password_hash IS NOT NULL AS has_password FROM users")(lambda d: d.users().select("user_id", "name", F.col("consent_at").isNotNull().alias("sms_opted_in"), F.col("password_hash").isNotNull().alias("has_password")))
_ACTIONS = {"update": ("draft", "scheduled"), "publish": ("draft",), "start_now": ("draft", "scheduled"), "cancel": ("scheduled",), "end": ("live",), "delete": ("draft",)}
_ACTIONS_SQL = ", ".join(f"{state(NOW)} IN ({', '.join(repr(s) for s in v)}) AS may_{k}" for k, v in _ACTIONS.items())
register("proj_merchant_dto", f"SELECT campaign_id, {state(NOW)} AS state, {iso('least(ends_at, ended_at)')} AS until, {_ACTIONS_SQL} FROM campaigns")(lambda d: d.campaigns().select("campaign_id", campaign_state().alias("state"), T.iso(F.least("ends_at", "ended_at")).alias("until"), *[campaign_state().isin(*v).alias(f"may_{k}") for k, v in _ACTIONS.items()]))
register("life_allowed_actions", f"SELECT campaign_id, {_ACTIONS_SQL} FROM campaigns")(lambda d: d.campaigns().select("campaign_id", *[campaign_state().isin(*v).alias(f"may_{k}") for k, v in _ACTIONS.items()]))
register("proj_legacy_dto", "SELECT campaign_id, CASE WHEN published_at IS NOT NULL AND title <> '' THEN title ELSE description END AS text FROM campaigns WHERE legacy_venue_id IS NOT NULL")(lambda d: d.campaigns().where("legacy_venue_id IS NOT NULL").select("campaign_id", F.when(F.col("published_at").isNotNull() & (F.col("title") != ""), F.col("title")).otherwise(F.col("description")).alias("text")))
_MERGED = "SELECT v.venue_id, coalesce(p.name, v.name) AS name, coalesce(p.start_min, v.start_min) AS start_min, coalesce(p.end_min, v.end_min) AS end_min FROM venues v LEFT JOIN venue_patches p ON v.venue_id = p.venue_id"
register("proj_merge_overlay", _MERGED)(lambda d: S.overlaid(d.venues(), d.venue_patches(), "venue_id", ["name", "start_min", "end_min"]).select("venue_id", "name", "start_min", "end_min"))
register("join_left_overlay", _MERGED)(lambda d: S.overlaid(d.venues(), d.venue_patches(), "venue_id", ["name", "start_min", "end_min"]).select("venue_id", "name", "start_min", "end_min"))
register("proj_image_fallback", "SELECT venue_id, coalesce(nullif(image, ''), CASE vibe WHEN 'wine bar' THEN '/stock/wine' WHEN 'dive bar' THEN '/stock/dive' END, '/stock/any') AS image FROM venues")(lambda d: d.venues().select("venue_id", F.coalesce(F.nullif("image", F.lit("")), F.when(F.col("vibe") == "wine bar", "/stock/wine").when(F.col("vibe") == "dive bar", "/stock/dive"), F.lit("/stock/any")).alias("image")))
register("proj_moderation_decision", "SELECT photo_id, CASE photo_id % 4 WHEN 0 THEN 'reject' WHEN 1 THEN 'review' WHEN 2 THEN 'review' ELSE 'publish' END AS decision FROM photos")(lambda d: d.photos().select("photo_id", S.moderation(F.when(F.col("photo_id") % 4 == 0, '{"safe":false,"relevant":true}').when(F.col("photo_id") % 4 == 1, '{"safe":true,"relevant":false}').when(F.col("photo_id") % 4 == 2, "not json").otherwise('{"safe":true,"relevant":true}')).alias("decision")))
register("proj_moderation_record", "SELECT photo_id, '{\"status\":\"' || status || '\",\"caption\":\"' || caption || '\"}' AS record FROM photos")(lambda d: d.photos().select("photo_id", F.to_json(F.struct("status", "caption")).alias("record")))
register("proj_public_photo", "SELECT photo_id, '/api/images/' || image_key AS url, caption FROM photos")(lambda d: d.photos().select("photo_id", F.concat(F.lit("/api/images/"), "image_key").alias("url"), "caption"))


@register("proj_consumer_state", f"""WITH live AS (SELECT DISTINCT venue_id FROM campaigns WHERE {state(NOW)} = 'live')
  SELECT v.venue_id, CASE WHEN {ON} AND l.venue_id IS NOT NULL THEN 'both' WHEN {ON} THEN 'happy_hour' WHEN l.venue_id IS NOT NULL THEN 'deal' ELSE 'neither' END AS state FROM venues v LEFT JOIN live l ON v.venue_id = l.venue_id""")
def _(d: Domain) -> DataFrame:
    live = d.campaigns().where(campaign_state() == "live").select("venue_id").distinct().withColumn("deal", F.lit(True))
    deal = F.coalesce("deal", F.lit(False))
    return d.venues().join(live, "venue_id", "left").select("venue_id", F.when(on() & deal, "both").when(on(), "happy_hour").when(deal, "deal").otherwise("neither").alias("state"))


register("proj_campaign_next_row", "SELECT campaign_id, coalesce(nullif(title, ''), 'untitled') AS title, CASE WHEN campaign_id % 2 = 0 THEN NULL ELSE deal_code END AS deal_code FROM campaigns")(lambda d: d.campaigns().select("campaign_id", F.coalesce(F.nullif("title", F.lit("")), F.lit("untitled")).alias("title"), F.when(F.col("campaign_id") % 2 != 0, F.col("deal_code")).alias("deal_code")))
register("proj_config_dimension", "SELECT claim_id, CASE WHEN plan = 'Pro' THEN 8 WHEN plan = ' founding-partner' THEN NULL ELSE 1 END AS allowance FROM claims")(lambda d: d.claims().select("claim_id", S.allowance(F.col("plan"), {"free": 1, "pro": 8, "founding_partner": None}).alias("allowance")))
register("proj_form_normalise", "SELECT user_id, trim(name) AS name, lower(trim(email)) AS email, nullif(phone, '') AS phone FROM users")(lambda d: d.users().select("user_id", X.clean(F.col("name")).alias("name"), F.lower(X.clean(F.col("email"))).alias("email"), F.nullif("phone", F.lit("")).alias("phone")))

# filters
register("filter_eq_key", "SELECT user_id, name FROM users WHERE user_id = 42")(lambda d: d.users().where("user_id = 42").select("user_id", "name"))
register("filter_case_insensitive_key", "SELECT user_id FROM users WHERE lower(email) = lower('CUSTOMER#000000042@example.test')")(lambda d: d.users().where(F.lower("email") == F.lower(F.lit("CUSTOMER#000000042@example.test"))).select("user_id"))
register("filter_composite_key", "SELECT claim_id, status FROM claims WHERE user_id = 41 AND venue_id = 41")(lambda d: d.claims().where("user_id = 41 AND venue_id = 41").select("claim_id", "status"))
register("filter_status", "SELECT photo_id, status FROM photos WHERE status <> 'rejected' AND photo_type = 'gallery'")(lambda d: d.photos().where("status <> 'rejected' AND photo_type = 'gallery'").select("photo_id", "status"))
register("filter_admin", "SELECT user_id FROM users WHERE email IN ('customer#000000001@example.test', 'customer#000000007@example.test')")(lambda d: d.users().where(F.lower("email").isin("customer#000000001@example.test", "customer#000000007@example.test")).select("user_id"))
register("filter_sms_eligible", "SELECT user_id FROM users WHERE trim(phone) <> '' AND consent_at IS NOT NULL")(lambda d: d.users().where((F.trim("phone") != "") & F.col("consent_at").isNotNull()).select("user_id"))
register("filter_user_list", "SELECT venue_id, status, note FROM saved WHERE user_id = 43")(lambda d: d.saved().where("user_id = 43").select("venue_id", "status", "note").orderBy("venue_id"))
register("filter_venue_history", "SELECT campaign_id FROM campaigns WHERE venue_id = 7")(lambda d: d.campaigns().where("venue_id = 7").orderBy(F.desc_nulls_first("created_at"), F.desc("campaign_id")).select("campaign_id"))
register("filter_unexpired", f"SELECT venue_id FROM overrides WHERE active AND expires_at > {NOW}")(lambda d: d.overrides().where(F.col("active") & (F.col("expires_at") > instant(CAMPAIGN_NOW))).select("venue_id"))
register("filter_since", f"SELECT send_id FROM sends WHERE sent_at >= {_LOG}")(lambda d: d.sends().where(F.col("sent_at") >= instant(LOG_NOW)).select("send_id"))
register("filter_not_null_partial", "SELECT campaign_id FROM campaigns WHERE legacy_venue_id IS NOT NULL")(lambda d: d.campaigns().where("legacy_venue_id IS NOT NULL").select("campaign_id"))
_LIVE_SQL = f"published_at IS NOT NULL AND cancelled_at IS NULL AND starts_at <= {NOW} AND {NOW} < least(ends_at, ended_at)"
register("filter_interval_contains_now", f"SELECT campaign_id, venue_id FROM campaigns WHERE {_LIVE_SQL}")(lambda d: S.live_campaigns(d.campaigns(), instant(CAMPAIGN_NOW)).select("campaign_id", "venue_id"))
register("filter_array_contains", "SELECT venue_id FROM venues WHERE list_contains(days, 'Friday') AND list_contains(deal_types, 'food')")(lambda d: d.venues().where(F.array_contains("days", "Friday") & F.array_contains("deal_types", "food")).select("venue_id"))
register("filter_array_overlap", "SELECT alert_id FROM alerts WHERE len(days) = 0 OR list_has_any(days, ['Sunday', 'Saturday'])")(lambda d: d.alerts().where((F.size("days") == 0) | F.arrays_overlap("days", F.array(F.lit("Sunday"), F.lit("Saturday")))).select("alert_id"))
register("filter_any_in_array", "SELECT alert_id FROM alerts WHERE list_contains(kinds, 'happy_hour')")(lambda d: d.alerts().where(F.array_contains("kinds", "happy_hour")).select("alert_id"))
register("filter_channel_eligibility", "SELECT alert_id FROM alerts a JOIN users u ON a.user_id = u.user_id WHERE channel_email OR (channel_text AND consent_at IS NOT NULL)")(lambda d: d.alerts().join(d.users().select("user_id", "consent_at"), "user_id").where("channel_email OR (channel_text AND consent_at IS NOT NULL)").select("alert_id"))
register("filter_substring_haystack", "SELECT venue_id FROM venues WHERE contains(lower(name || ' ' || neighborhood || ' ' || vibe), 'wine')")(lambda d: d.venues().where(S.haystack("name", "neighborhood", "vibe").contains("wine")).select("venue_id"))
register("filter_all_terms", "SELECT doc_id FROM documents WHERE contains(lower(text), 'the') AND contains(lower(text), 'rights')")(lambda d: d.raw("documents").where(S.all_terms(F.lower("text"), "the rights")).select("doc_id"))
register("filter_normalised_equality", "SELECT venue_id FROM venues WHERE trim(lower(neighborhood)) = 'nation_3'")(lambda d: d.venues().where(F.trim(F.lower("neighborhood")) == "nation_3").select("venue_id"))
_HAV = "(2 * 3958.7613::DOUBLE * asin(least(1.0::DOUBLE, sqrt(pow(sin(radians(lat - 32.7) / 2), 2) + cos(radians(32.7)) * cos(radians(lat)) * pow(sin(radians(lng + 117.1) / 2), 2)))))"
register("filter_radius", f"SELECT venue_id FROM venues WHERE {_HAV} <= 8")(lambda d: d.venues().where(geo.within(F.col("lat"), F.col("lng"), 32.7, -117.1, 8)).select("venue_id"))
register("filter_name_prefix_search", "SELECT venue_id, name FROM venues WHERE contains(lower(name), '00001') ORDER BY name, venue_id LIMIT 8")(lambda d: d.venues().where(F.lower("name").contains("00001")).orderBy("name", "venue_id").limit(8).select("venue_id", "name"))
register("filter_trust", "SELECT venue_id FROM venues WHERE verified")(lambda d: d.venues().where("verified").select("venue_id"))
register("filter_live_schedule_halfopen", f"SELECT venue_id FROM venues WHERE {ON}")(lambda d: d.venues().where(on()).select("venue_id"))
register("filter_live_schedule_closed", f"SELECT venue_id FROM venues WHERE list_contains(days, dayname({local(_EVE)})) AND {_MIN} BETWEEN start_min AND end_min")(lambda d: d.venues().where(T.schedule_live_closed(instant(EVENING), F.col("days"), F.col("start_min"), F.col("end_min"))).select("venue_id"))
register("filter_live_schedule_local", f"SELECT venue_id FROM venues v WHERE (list_contains(days, dayname({_EVE} + INTERVAL 17 HOUR)) AND hour({_EVE} + INTERVAL 17 HOUR) * 60 + minute({_EVE} + INTERVAL 17 HOUR) BETWEEN start_min AND end_min) OR venue_id IN (SELECT venue_id FROM overrides WHERE active AND expires_at > {NOW})")(lambda d: S.with_overrides(d.venues(), d.overrides(), instant(CAMPAIGN_NOW)).where(F.col("overridden") | T.schedule_live_closed(T.plus(instant(EVENING), 17 * 3600), F.col("days"), F.col("start_min"), F.col("end_min"), "UTC")).select("venue_id"))
register("filter_venue_live", f"SELECT venue_id FROM venues WHERE {ON} OR venue_id IN (SELECT venue_id FROM overrides WHERE active AND expires_at > {NOW})")(lambda d: S.with_overrides(d.venues(), d.overrides(), instant(CAMPAIGN_NOW)).where(F.col("overridden") | on()).select("venue_id"))
register("filter_feed_live", f"SELECT campaign_id FROM campaigns WHERE {state(NOW)} = 'live' AND starts_at <= {NOW} AND {NOW} < least(ends_at, ended_at)")(lambda d: d.campaigns().where((campaign_state() == "live") & (F.col("starts_at") <= instant(CAMPAIGN_NOW)) & (instant(CAMPAIGN_NOW) < F.least("ends_at", "ended_at"))).select("campaign_id"))
register("filter_row_validity", "SELECT campaign_id, venue_id > 0 AND title <> '' AND length(title) <= 80 AND type IN ('special_deal', 'extended_happy_hour', 'event', 'other') AND ends_at > starts_at AND published_at IS NOT NULL AS is_valid FROM campaigns")(lambda d: d.campaigns().select("campaign_id", ((F.col("venue_id") > 0) & (F.col("title") != "") & (F.length("title") <= 80) & F.col("type").isin(*KINDS) & (F.col("ends_at") > F.col("starts_at")) & F.col("published_at").isNotNull()).alias("is_valid")))
register("filter_claim_verified", "SELECT claim_id FROM claims WHERE status = 'verified'")(lambda d: d.claims().where("status = 'verified'").select("claim_id"))
register("filter_claim_verified_whole", "SELECT claim_id FROM claims WHERE status = 'verified'")(lambda d: d.claims().where("status = 'verified'").select("claim_id"))
register("filter_manager", "SELECT s.session_id FROM sessions s WHERE role = 'admin' OR user_id IN (SELECT user_id FROM claims WHERE status = 'verified')")(lambda d: S.managers(d.sessions(), d.claims()).select("session_id"))
register("filter_empty_sections", "SELECT section_id FROM sections WHERE section_id IN (SELECT section_id FROM items)")(lambda d: d.sections().join(d.items().select("section_id"), "section_id", "left_semi").select("section_id"))

# joins
register("join_alerts_users", "SELECT alert_id, email FROM alerts a JOIN users u ON a.user_id = u.user_id WHERE active")(lambda d: d.alerts().where("active").join(d.users(), "user_id").select("alert_id", "email"))
register("join_items_sections", "SELECT item_id, title FROM items i JOIN sections s ON i.section_id = s.section_id")(lambda d: d.items().join(d.sections(), "section_id").select("item_id", "title"))
register("join_item_to_parent_key", "SELECT item_id, venue_id FROM items i JOIN sections s ON i.section_id = s.section_id")(lambda d: d.items().join(d.sections(), "section_id").select("item_id", "venue_id"))
register("join_item_to_parent_key_whole", "SELECT item_id, venue_id FROM items i JOIN sections s ON i.section_id = s.section_id")(lambda d: d.items().join(d.sections(), "section_id").select("item_id", "venue_id"))
register("join_group_nest", "SELECT s.section_id, coalesce(string_agg(i.name, ',' ORDER BY i.sort_order, i.created_at, i.item_id, i.name), '') AS items FROM sections s LEFT JOIN items i ON s.section_id = i.section_id GROUP BY s.section_id")(lambda d: J.nested(d.sections(), d.items(), "section_id", ["sort_order", "created_at", "item_id"], ["name"], "items").select("section_id", F.array_join(F.transform("items", lambda x: x["name"]), ",").alias("items")))
register("join_inner_drop_missing", f"SELECT c.campaign_id, v.name FROM campaigns c JOIN venues v ON c.venue_id = v.venue_id WHERE {_LIVE_SQL}")(lambda d: S.live_campaigns(d.campaigns(), instant(CAMPAIGN_NOW)).join(d.venues(), "venue_id").select("campaign_id", "name"))
register("join_saved_spots_catalogue", "SELECT s.user_id, v.name FROM saved s JOIN venues v ON s.venue_id = v.venue_id")(lambda d: d.saved().join(d.venues().select("venue_id", "name"), "venue_id").select("user_id", "name"))
register("join_left_enrich_default", "SELECT s.user_id, coalesce(v.name, 'Venue #' || s.venue_id) AS name FROM saved s LEFT JOIN venues v ON s.venue_id = v.venue_id")(lambda d: d.saved().join(d.venues().select("venue_id", "name"), "venue_id", "left").select("user_id", F.coalesce("name", F.concat(F.lit("Venue #"), F.col("venue_id").cast("string"))).alias("name")))
register("map_lookup_default", "SELECT p.photo_id, coalesce(v.name, 'Venue #' || p.venue_id) AS name FROM photos p LEFT JOIN venues v ON p.venue_id = v.venue_id")(lambda d: d.photos().join(d.venues().select("venue_id", "name"), "venue_id", "left").select("photo_id", F.coalesce("name", F.concat(F.lit("Venue #"), F.col("venue_id").cast("string"))).alias("name")))
register("join_double_dimension", f"SELECT c.claim_id, v.name AS base_name, m.name AS merged_name FROM claims c LEFT JOIN venues v ON c.venue_id = v.venue_id LEFT JOIN ({_MERGED}) m ON c.venue_id = m.venue_id")(lambda d: d.claims().join(d.venues().select("venue_id", F.col("name").alias("base_name")), "venue_id", "left").join(S.overlaid(d.venues(), d.venue_patches(), "venue_id", ["name"]).select("venue_id", F.col("name").alias("merged_name")), "venue_id", "left").select("claim_id", "base_name", "merged_name"))
register("join_semi_flag", "SELECT venue_id, venue_id IN (SELECT venue_id FROM claims WHERE status = 'verified') AS already_claimed FROM venues")(lambda d: d.venues().join(d.claims().where("status = 'verified'").select("venue_id").distinct().withColumn("hit", F.lit(True)), "venue_id", "left").select("venue_id", F.col("hit").isNotNull().alias("already_claimed")))
register("join_exists", "SELECT user_id FROM users u WHERE EXISTS (SELECT 1 FROM alerts a WHERE a.user_id = u.user_id AND a.channel_text)")(lambda d: d.users().join(d.alerts().where("channel_text").select("user_id"), "user_id", "left_semi").select("user_id"))
register("set_membership", "SELECT venue_id FROM venues WHERE venue_id IN (SELECT venue_id FROM follows)")(lambda d: d.venues().join(d.follows().select("venue_id"), "venue_id", "left_semi").select("venue_id"))
register("join_anti_cooldown", f"SELECT f.user_id, f.venue_id FROM follows f WHERE NOT EXISTS (SELECT 1 FROM sends s WHERE s.user_id = f.user_id AND s.venue_id = f.venue_id AND s.channel = 'email' AND s.sent_at >= {_LOG} - INTERVAL 3 HOUR)")(lambda d: d.follows().withColumn("channel", F.lit("email")).join(d.sends().where(F.col("sent_at") >= T.plus(instant(LOG_NOW), -10800)).select("user_id", "venue_id", "channel"), ["user_id", "venue_id", "channel"], "left_anti").select("user_id", "venue_id"))
_MATCH = "(len(a.days) = 0 OR list_has_any(a.days, v.days)) AND (a.neighborhood = '' OR a.neighborhood = v.neighborhood) AND (a.deal_type = '' OR list_contains(v.deal_types, a.deal_type)) AND (a.feature = '' OR list_contains(v.features, a.feature)) AND (a.query = '' OR contains(lower(v.name || ' ' || v.neighborhood || ' ' || v.vibe), a.query))"
register("join_theta_alert_venue", f"SELECT a.alert_id, v.venue_id FROM alerts a JOIN (SELECT * FROM venues WHERE {ON}) v ON {_MATCH}")(lambda d: S.matches(d.alerts(), d.venues().where(on()), ["alert_id", "venue_id"]))
register("join_interval_overlap", f"""SELECT a.campaign_id AS a, b.campaign_id AS b FROM campaigns a JOIN campaigns b ON a.venue_id = b.venue_id AND a.campaign_id < b.campaign_id AND a.starts_at < b.ends_at AND b.starts_at < a.ends_at""")(lambda d: J.overlapping(d.campaigns().select("campaign_id", "venue_id", "starts_at", "ends_at"), "campaign_id", "venue_id", "starts_at", "ends_at"))
register("join_interval_point", "SELECT s.o_orderkey, c.campaign_id FROM (SELECT o_orderkey, o_custkey % n + 1 AS venue_id, TIMESTAMP '1998-06-01' + to_minutes(o_orderkey * 13 % 43200) AS at FROM orders, (SELECT count(*) AS n FROM supplier)) s JOIN campaigns c ON s.venue_id = c.venue_id AND c.starts_at <= s.at AND s.at < c.ends_at")(lambda d: J.within(d.raw("orders").crossJoin(F.broadcast(d.raw("supplier").agg(F.count(F.lit(1)).alias("n")))).select("o_orderkey", (F.col("o_custkey") % F.col("n") + 1).alias("venue_id"), T.plus(instant("1998-06-01 00:00:00"), F.col("o_orderkey") * 13 % 43200 * 60).alias("at")), d.campaigns().select("venue_id", "campaign_id", "starts_at", "ends_at"), "venue_id", "at", "starts_at", "ends_at").select("o_orderkey", "campaign_id"))
_SLUG = "regexp_replace(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"
register("join_docs_by_slug_array", f"SELECT d.doc_id, v.venue_id FROM (SELECT doc_id, unnest([doc_id % n, (doc_id * 7) % n, n + 3]) + 1 AS id FROM documents, (SELECT count(*) AS n FROM supplier)) d JOIN venues w ON w.venue_id = d.id JOIN (SELECT venue_id, {_SLUG} AS slug FROM venues) v ON v.slug = {_SLUG.replace('name', 'w.name')}")(lambda d: S.by_slug(_mentions(d), d.venues()))
register("join_first_match", "SELECT doc_id, min_by(id, pos) AS venue_id FROM (SELECT doc_id, unnest([n + 4, doc_id % n + 1, (doc_id * 7) % n + 1]) AS id, unnest([0, 1, 2]) AS pos FROM documents, (SELECT count(*) AS n FROM supplier)) WHERE id IN (SELECT venue_id FROM venues) GROUP BY doc_id")(lambda d: J.first_match(d.raw("documents").crossJoin(F.broadcast(d.raw("supplier").agg(F.count(F.lit(1)).alias("n")))).select("doc_id", F.expr("array(n + 4, doc_id % n + 1, (doc_id * 7) % n + 1)").alias("ids")), "ids", d.venues(), "venue_id", "doc_id"))
register("join_published_lookup", "SELECT i.item_id, p.caption FROM items i LEFT JOIN (SELECT * FROM photos WHERE status = 'published') p ON i.photo_id = p.photo_id")(lambda d: d.items().join(d.photos().where("status = 'published'").select("photo_id", "caption"), "photo_id", "left").select("item_id", "caption"))
register("join_owner_photo_allowed", "SELECT photo_id FROM photos p WHERE EXISTS (SELECT 1 FROM claims c WHERE c.venue_id = p.venue_id AND c.status = 'verified') AND status = 'published'")(lambda d: d.photos().where("status = 'published'").join(d.claims().where("status = 'verified'").select("venue_id"), "venue_id", "left_semi").select("photo_id"))
register("join_follow_recipients", f"""WITH live AS (SELECT campaign_id, venue_id FROM campaigns WHERE {_LIVE_SQL})
  SELECT DISTINCT l.campaign_id, r.user_id FROM live l JOIN (SELECT venue_id, user_id FROM follows WHERE promotion UNION ALL SELECT v.venue_id, a.user_id FROM alerts a JOIN venues v ON {_MATCH} WHERE a.active AND list_contains(a.kinds, 'promotion')) r ON l.venue_id = r.venue_id""")(lambda d: S.recipients(S.live_campaigns(d.campaigns(), instant(CAMPAIGN_NOW)), d.follows(), d.alerts(), d.venues()))


def _mentions(d: Domain) -> DataFrame:
    """(doc_id, slug): the venues that a document names, one of which doesn't exist."""
    ids = d.raw("documents").crossJoin(F.broadcast(d.raw("supplier").agg(F.count(F.lit(1)).alias("n")))).select("doc_id", F.explode(F.expr("array(doc_id % n, (doc_id * 7) % n, n + 3)")).alias("id")).withColumn("venue_id", F.col("id") + 1)
    return ids.join(d.venues().select("venue_id", X.slugify(F.col("name")).alias("slug")), "venue_id").select("doc_id", "slug")
