"""Queries of snapshot changes and integrity rules."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from tidepool.functions import temporal as T, text as X
from tidepool.operators import integrity as I, mutations as M, search as S
from tidepool.plans.registry import iso, register
from tidepool.plans.temporal import NOW
from tidepool.sources.domain import CAMPAIGN_NOW, DAYS, DEAL_TYPES, KINDS, LOG_NOW, Domain, instant
from tidepool.sources.generations import Versioned, own_folder, shared_dir

_LOG = f"TIMESTAMP '{LOG_NOW}'"
_PATCH = "SELECT v.venue_id, CASE WHEN p.venue_id IS NOT NULL THEN p.start_min ELSE v.start_min END AS start_min, CASE WHEN p.venue_id IS NOT NULL THEN p.end_min ELSE v.end_min END AS end_min FROM venues v FULL JOIN venue_patches p ON v.venue_id = p.venue_id"


def _hours(d: Domain) -> DataFrame:
    return d.venues().select("venue_id", "start_min", "end_min")


register("sink_insert_returning", "SELECT venue_id, start_min FROM venues UNION ALL SELECT venue_id + 100000, start_min FROM venue_patches")(lambda d: M.append(d.venues().select("venue_id", "start_min"), d.venue_patches().select((F.col("venue_id") + 100000).alias("venue_id"), "start_min"))[0])
register("sink_upsert_replace", _PATCH)(lambda d: M.upsert(_hours(d), d.venue_patches().select("venue_id", "start_min", "end_min"), ["venue_id"]))
register("sink_upsert_coalesce", "SELECT u.email, CASE WHEN u.user_id % 3 = 0 THEN coalesce(nullif(CASE WHEN u.user_id % 2 = 0 THEN '' ELSE 'new' END, ''), u.name) ELSE u.name END AS name FROM users u")(lambda d: M.upsert(d.users().select("email", "name"), d.users().where("user_id % 3 = 0").select("email", F.when(F.col("user_id") % 2 == 0, "").otherwise("new").alias("name")), ["email"], choose={"name": F.coalesce(F.nullif(F.col("s.name"), F.lit("")), F.col("t.name"))}))
register("sink_upsert_resurrect", f"SELECT 'promotion:' || campaign_id AS event_key, {iso('starts_at')} AS available_at, CASE WHEN campaign_id % 2 = 0 THEN NULL ELSE {iso('cancelled_at')} END AS cancelled_at FROM campaigns WHERE published_at IS NOT NULL")(lambda d: (lambda e: M.upsert(e, e.where("campaign_id % 2 = 0").withColumn("cancelled_at", F.lit(None).cast("timestamp")), ["event_key"]).select("event_key", T.iso(F.col("available_at")).alias("available_at"), T.iso(F.col("cancelled_at")).alias("cancelled_at")))(_events(d)))
register("sink_insert_ignore", "SELECT image_key, min(photo_id) AS first FROM photos GROUP BY image_key UNION ALL SELECT 'new' || photo_id, photo_id FROM photos")(lambda d: M.insert_ignore(d.photos().groupBy("image_key").agg(F.min("photo_id").alias("first")), d.photos().select(F.explode(F.array("image_key", F.concat(F.lit("new"), F.col("photo_id").cast("string")))).alias("image_key"), F.col("photo_id").alias("first")), ["image_key"])[0])
register("sink_insert_guarded_cap", "SELECT user_id, count(*) + CASE WHEN count(*) < 3 THEN 1 ELSE 0 END AS n FROM alerts GROUP BY user_id")(lambda d: M.insert_capped(d.alerts().select("user_id", "alert_id"), d.users().select("user_id", (F.col("user_id") + 10_000_000).alias("alert_id")).unionByName(d.users().select("user_id", (F.col("user_id") + 20_000_000).alias("alert_id"))), "user_id", "alert_id", 3).groupBy("user_id").agg(F.count(F.lit(1)).alias("n")))
register("sink_insert_next_ordinal", "SELECT venue_id, max(sort_order) + 1 AS sort_order FROM sections GROUP BY venue_id UNION ALL SELECT venue_id, sort_order FROM sections")(lambda d: M.insert_next_ordinal(d.sections().select("venue_id", "sort_order", "title"), d.venues().join(d.sections().select("venue_id"), "venue_id", "left_semi").select("venue_id", F.lit("new").alias("title")), "venue_id", "sort_order", "title").select("venue_id", "sort_order"))
register("sink_append_next_id", "SELECT venue_id FROM venues UNION ALL SELECT (SELECT max(venue_id) FROM venues) + row_number() OVER (ORDER BY submission_id) FROM submissions WHERE status = 'approved'")(lambda d: M.append_next_id(d.venues().select("venue_id"), d.submissions().where("status = 'approved'").select("submission_id"), "venue_id", "submission_id"))
register("sink_update_partial", "SELECT v.venue_id, coalesce(p.name, v.name) AS name FROM venues v LEFT JOIN venue_patches p ON v.venue_id = p.venue_id")(lambda d: M.patch(d.venues().select("venue_id", "name"), d.venue_patches(), "venue_id", ["name"]))
register("sink_update_tristate", "SELECT v.venue_id, CASE WHEN v.venue_id % 8 = 1 THEN NULL WHEN v.venue_id % 8 = 5 THEN 'set' ELSE v.name END AS name FROM venues v")(lambda d: M.patch(d.venues().select("venue_id", "name"), d.venue_patches().select("venue_id", F.when(F.col("venue_id") % 8 == 5, "set").alias("name"), F.lit(True).alias("name_present")), "venue_id", ["name"], present=True))
register("sink_update_replace_all", _PATCH)(lambda d: M.upsert(_hours(d), d.venue_patches().select("venue_id", "start_min", "end_min"), ["venue_id"]))
register("sink_update_compare_and_set", f"SELECT claim_id, CASE WHEN phone_code = '000000' OR (claim_id % 2 = 1 AND code_expires_at > {NOW}) THEN 'verified' ELSE status END AS status FROM claims")(lambda d: M.update(d.claims(), (F.col("phone_code") == "000000") | ((F.col("claim_id") % 2 == 1) & (F.col("code_expires_at") > instant(CAMPAIGN_NOW))), status=F.lit("verified")).select("claim_id", "status"))


def _events(d: Domain) -> DataFrame:
    return d.campaigns().where("published_at IS NOT NULL").select("campaign_id", F.concat(F.lit("promotion:"), F.col("campaign_id").cast("string")).alias("event_key"), F.col("starts_at").alias("available_at"), F.col("ends_at").alias("expires_at"), "cancelled_at", "ended_at")


register("sink_update_interval_shrink", f"SELECT campaign_id, {iso('CASE WHEN ended_at > starts_at THEN least(ends_at, ended_at) ELSE ends_at END')} AS expires_at, ended_at <= starts_at AS cancelled FROM campaigns WHERE published_at IS NOT NULL AND ended_at IS NOT NULL")(lambda d: _events(d).where("ended_at IS NOT NULL").select("campaign_id", T.iso(F.when(F.col("available_at") < F.col("ended_at"), F.least("expires_at", "ended_at")).otherwise(F.col("expires_at"))).alias("expires_at"), (F.col("ended_at") <= F.col("available_at")).alias("cancelled")))
register("sink_update_bulk", "SELECT photo_id, CASE WHEN status = 'pending' THEN 'published' ELSE status END AS status FROM photos")(lambda d: M.update(d.photos(), F.col("status") == "pending", status=F.lit("published")).select("photo_id", "status"))
register("sink_update_cancel", f"SELECT campaign_id, coalesce({iso('cancelled_at')}, CASE WHEN venue_id = 3 THEN {iso(NOW)} END) AS cancelled_at FROM campaigns")(lambda d: M.update(d.campaigns(), (F.col("venue_id") == 3) & F.col("cancelled_at").isNull(), cancelled_at=instant(CAMPAIGN_NOW)).select("campaign_id", T.iso(F.col("cancelled_at")).alias("cancelled_at")))
register("sink_update_catalogue_row", "SELECT venue_id, CASE WHEN venue_id = 5 THEN 'Renamed' ELSE name END AS name FROM venues")(lambda d: M.update(d.venues(), F.col("venue_id") == 5, name=F.lit("Renamed")).select("venue_id", "name"))
register("sink_delete_key", "SELECT user_id, venue_id FROM follows WHERE user_id NOT IN (SELECT user_id FROM claims)")(lambda d: M.delete(d.follows(), d.claims().select("user_id").distinct(), ["user_id"]).select("user_id", "venue_id"))
register("sink_delete_guarded", "SELECT campaign_id FROM campaigns WHERE NOT (venue_id = 4 AND published_at IS NULL)")(lambda d: M.delete_where(d.campaigns(), (F.col("venue_id") == 4) & F.col("published_at").isNull()).select("campaign_id"))
register("sink_delete_ttl", f"SELECT session_id FROM sessions WHERE expires_at > {NOW}")(lambda d: M.delete_where(d.sessions(), F.col("expires_at") <= instant(CAMPAIGN_NOW)).select("session_id"))
register("sink_cascade", "SELECT item_id, CASE WHEN photo_id IN (SELECT photo_id FROM photos WHERE status = 'published') THEN photo_id END AS photo_id FROM items WHERE section_id IN (SELECT section_id FROM sections WHERE sort_order > 0)")(lambda d: M.set_null(M.cascade(d.items(), d.sections().where("sort_order > 0"), "section_id", "section_id"), d.photos().where("status = 'published'"), "photo_id", "photo_id").select("item_id", "photo_id"))
@register("sink_batch_in_tx", "SELECT send_id, user_id, venue_id FROM sends UNION ALL SELECT send_id + 1000000000, user_id, venue_id FROM sends")
def _batches(d: Domain) -> DataFrame:
    """A good batch goes in whole, then one with a single bad row not at all, then an empty one changes nothing."""
    log = d.sends().select("send_id", "user_id", "venue_id")
    batch = lambda shift, user: log.select((F.col("send_id") + shift).alias("send_id"), user.alias("user_id"), "venue_id")
    good = M.all_or_nothing(log, batch(10**9, F.col("user_id")), F.col("user_id") > 0)
    spoilt = M.all_or_nothing(good, batch(2 * 10**9, F.when(F.col("send_id") != 7, F.col("user_id"))), F.col("user_id").isNotNull() & (F.col("user_id") > 0))
    return M.all_or_nothing(spoilt, log.where(F.lit(False)), F.col("user_id") > 0)


register("ctl_transaction", "SELECT count(*) AS n FROM (SELECT 1 FROM sends UNION ALL SELECT 1 FROM sends)")(lambda d: M.all_or_nothing(d.sends(), d.sends(), F.col("user_id") > 0).agg(F.count(F.lit(1)).alias("n")))
register("sink_ddl_versioned", "SELECT row_number() OVER (ORDER BY version) + (SELECT count(*) FROM region) - 1 AS place, version FROM (SELECT lpad(n_nationkey::VARCHAR, 4, '0') || '_' || lower(n_name) AS version FROM nation WHERE n_nationkey >= (SELECT count(*) FROM region)) ")(lambda d: _migrations(d))
register("sink_backfill_migration", f"SELECT venue_id, trim(deal_code) AS deal_code, description, {iso('updated_at')} AS created_at, NULL::VARCHAR AS title FROM legacy WHERE venue_id NOT IN (SELECT legacy_venue_id FROM campaigns WHERE legacy_venue_id IS NOT NULL)")(lambda d: d.legacy().join(d.campaigns().where("legacy_venue_id IS NOT NULL").select(F.col("legacy_venue_id").alias("venue_id")), "venue_id", "left_anti").select("venue_id", F.trim("deal_code").alias("deal_code"), "description", T.iso(F.col("updated_at")).alias("created_at"), F.lit(None).cast("string").alias("title")))
def _migrations(d: Domain) -> DataFrame:
    """Files by name in a stored folder, those applied so far in a stored table: the first five of a nation each."""
    where = f"{shared_dir(d.spark)}/migrations-{uuid.uuid4().hex}"
    version = F.concat(F.lpad(F.col("n_nationkey").cast("string"), 4, "0"), F.lit("_"), F.lower("n_name"))
    d.raw("nation").select(version.alias("version"), F.col("n_name").alias("value")).repartition("version").write.partitionBy("version").text(f"{where}/files")
    d.raw("nation").where("n_nationkey < 5").select(version.alias("version")).write.parquet(f"{where}/applied")
    files = d.spark.read.text(f"{where}/files", wholetext=True).select("version").distinct()
    return M.unapplied(files, d.spark.read.parquet(f"{where}/applied"))


_CATALOGUE = "venue_id long, name string, neighborhood string"


def _catalogue(d: Domain) -> Versioned:
    """The venues as one stored JSON object of version 1."""
    stored = Versioned(d.spark, own_folder(d.spark), _CATALOGUE)
    stored.replace(d.venues().select("venue_id", "name", "neighborhood"), 0)
    return stored


@register("sink_commit_versioned", "SELECT venue_id, CASE venue_id WHEN 5 THEN 'Renamed' WHEN 6 THEN 'Renamed too' ELSE name END AS name, neighborhood, 3 AS version FROM venues")
def _committed(d: Domain) -> DataFrame:
    """Two writers read one version: the first commits, the second is refused, reads again and commits."""
    stored = _catalogue(d)
    rows, token = stored.read()
    stored.replace(M.update(rows, F.col("venue_id") == 5, name=F.lit("Renamed")), token)
    if stored.replace(M.update(rows, F.col("venue_id") == 6, name=F.lit("Renamed too")), token) is None:
        rows, token = stored.read()
        stored.replace(M.update(rows, F.col("venue_id") == 6, name=F.lit("Renamed too")), token)
    rows, token = stored.read()
    return rows.withColumn("version", F.lit(token))


@register("scan_remote_json_versioned", "SELECT venue_id, name, neighborhood, 1 AS version FROM venues")
def _versions(d: Domain) -> DataFrame:
    """A stored JSON object under its schema, with the token that a writer gives back."""
    rows, token = _catalogue(d).read()
    return rows.withColumn("version", F.lit(token))


# integrity rules: the rows that break them
register("chk_user_credential", "SELECT user_id FROM users WHERE google_id IS NULL AND password_hash IS NULL")(lambda d: I.violations(d.users(), I.USER).select("user_id"))
register("chk_positive_ids", "SELECT o_orderkey FROM orders WHERE o_orderkey <= 0")(lambda d: d.raw("orders").where(I.not_positive("o_orderkey")).select("o_orderkey"))
register("chk_rating", "SELECT user_id FROM saved WHERE rating IS NOT NULL AND rating NOT BETWEEN 1 AND 5")(lambda d: I.violations(d.saved(), I.SAVED).select("user_id"))
register("chk_campaign_window", "SELECT campaign_id FROM campaigns WHERE (starts_at IS NULL) <> (ends_at IS NULL) OR ends_at <= starts_at OR ends_at > starts_at + INTERVAL 5 HOUR")(lambda d: d.campaigns().where(I.bad_window("starts_at", "ends_at", 5 * 3600)).select("campaign_id"))
register("chk_campaign_published_complete", "SELECT campaign_id FROM campaigns WHERE published_at IS NOT NULL AND (coalesce(title, '') = '' OR starts_at IS NULL OR ends_at IS NULL)")(lambda d: I.violations(d.campaigns(), {"published_complete": I.CAMPAIGN["published_complete"]}).select("campaign_id"))
register("chk_campaign_terminal", "SELECT campaign_id FROM campaigns WHERE (ended_at IS NOT NULL AND cancelled_at IS NOT NULL) OR ((ended_at IS NOT NULL OR cancelled_at IS NOT NULL) AND published_at IS NULL)")(lambda d: I.violations(d.campaigns(), {k: v for k, v in I.CAMPAIGN.items() if k.startswith("terminal")}).select("campaign_id"))
register("chk_alert_kinds", "SELECT alert_id FROM alerts WHERE NOT (kinds = ['happy_hour'] OR kinds = ['promotion'])")(lambda d: d.alerts().where(I.outside_arrays("kinds", [["happy_hour"], ["promotion"]])).select("alert_id"))
register("chk_event_window", "SELECT campaign_id FROM campaigns WHERE published_at IS NOT NULL AND ended_at IS NOT NULL AND ended_at <= ends_at - INTERVAL 2 HOUR")(lambda d: _events(d).where("ended_at IS NOT NULL").withColumn("expires_at", F.col("expires_at") - F.expr("INTERVAL 2 HOURS")).where(~(F.col("expires_at") < F.col("ended_at"))).select("campaign_id"))
_QUEUE_SQL = """(SELECT e.event_id, CASE WHEN user_id % 5 = 0 THEN 'happy_hour_started' ELSE 'promotion_started' END AS event_type, CASE WHEN user_id % 4 <> 0 THEN user_id END AS promotion_id,
  CASE WHEN event_type IN ('view', 'click') THEN 'email' WHEN event_id % 41 = 0 THEN 'fax' ELSE 'text' END AS channel, ['pending', 'sending', 'sent', 'failed', 'lost'][CASE WHEN event_id % 97 = 0 THEN 5 ELSE (event_id % 4 + 1)::INT END] AS status,
  event_id % 3 AS attempt_count, CASE WHEN event_id % 7 <> 0 THEN ts END AS next_attempt_at, CASE WHEN event_id % 8 = 1 THEN ts END AS lease_expires_at, CASE WHEN event_id % 9 < 7 AND event_id % 4 = 2 THEN ts END AS sent_at, CASE WHEN event_id % 5 > 0 THEN event_id END AS batch_id FROM events e)"""


def deliveries(d: Domain) -> DataFrame:
    """Queued deliveries with their events, one for each stored event; some break a rule."""
    k, u, at = F.col("event_id"), F.col("user_id"), F.col("ts")
    status = F.element_at(F.array(*map(F.lit, [*I.DOMAINS["deliveries"]["status"], "lost"])), F.when(k % 97 == 0, 5).otherwise((k % 4 + 1).cast("int")))
    return d.raw("events").select(
        k, F.when(u % 5 == 0, "happy_hour_started").otherwise("promotion_started").alias("event_type"), F.when(u % 4 != 0, u).alias("promotion_id"),
        F.when(F.col("event_type").isin("view", "click"), "email").when(k % 41 == 0, "fax").otherwise("text").alias("channel"), status.alias("status"),
        (k % 3).alias("attempt_count"), F.when(k % 7 != 0, at).alias("next_attempt_at"), F.when(k % 8 == 1, at).alias("lease_expires_at"), F.when((k % 9 < 7) & (k % 4 == 2), at).alias("sent_at"), F.when(k % 5 > 0, k).alias("batch_id"),
    )


def _broken_sql(rules: dict[str, str]) -> str:
    named = ", ".join(f"CASE WHEN NOT coalesce({rule}, true) THEN '{name}' END" for name, rule in rules.items())
    return f"SELECT event_id, broken FROM (SELECT event_id, array_to_string(list_filter([{named}], lambda x: x IS NOT NULL), ',') AS broken FROM {_QUEUE_SQL}) WHERE broken <> ''"


_LISTS_OF = {
    "deliveries": ("event_id", _QUEUE_SQL), "events": ("event_id", f"(SELECT event_id, CASE WHEN event_id % 83 = 5 THEN 'promotion_ended' ELSE event_type END AS event_type FROM {_QUEUE_SQL})"), "campaigns": ("campaign_id", "(SELECT campaign_id, CASE WHEN campaign_id % 29 = 1 THEN 'flash_sale' ELSE type END AS type FROM campaigns)"),
    "claims": ("claim_id", "(SELECT claim_id, status, plan, CASE claim_id % 5 WHEN 0 THEN 'domain' WHEN 1 THEN 'phone' WHEN 2 THEN 'manual' WHEN 3 THEN 'post' END AS verification_method FROM claims)"), "photos": ("photo_id", "photos"),
    "images": ("photo_id", "(SELECT photo_id, ['upload', 'url', 'generated', 'edited', 'owner', 'scan'][(photo_id % 6 + 1)::INT] AS origin FROM photos)"), "saved": ("user_id", "saved"), "sessions": ("session_id", "sessions"), "submissions": ("submission_id", "submissions"), "users": ("user_id", "users"), "sends": ("send_id", "sends"),
}


def _with_domains(d: Domain) -> dict[str, DataFrame]:
    """The tables whose columns have a domain, some with values outside of it."""
    k, p = F.col("claim_id") % 5, F.col("photo_id") % 6
    method = F.when(k == 0, "domain").when(k == 1, "phone").when(k == 2, "manual").when(k == 3, "post")
    origin = F.element_at(F.array(*map(F.lit, [*I.DOMAINS["images"]["origin"], "scan"])), (p + 1).cast("int"))
    event = deliveries(d).withColumn("event_type", F.when(F.col("event_id") % 83 == 5, "promotion_ended").otherwise(F.col("event_type")))
    return {
        "deliveries": deliveries(d), "events": event, "campaigns": d.campaigns().withColumn("type", F.when(F.col("campaign_id") % 29 == 1, "flash_sale").otherwise(F.col("type"))), "claims": d.claims().withColumn("verification_method", method), "photos": d.photos(), "images": d.photos().select("photo_id", origin.alias("origin")),
        "saved": d.saved(), "sessions": d.sessions(), "submissions": d.submissions(), "users": d.users(), "sends": d.sends(),
    }


def _domain_sql(table: str) -> str:
    key, rows = _LISTS_OF[table]
    columns = [c for c in I.DOMAINS[table] if (table, c) != ("deliveries", "distribution_source")]
    broken = ", ".join(f"CASE WHEN {c} NOT IN ({', '.join(map(repr, I.DOMAINS[table][c]))}) THEN '{c}' END" for c in columns)
    return f"SELECT '{table}' AS \"table\", {key}::VARCHAR AS key, concat_ws(',', {broken}) AS broken FROM {rows} t"


@register("chk_enum", f"SELECT * FROM ({' UNION ALL '.join(map(_domain_sql, I.DOMAINS))}) WHERE broken <> ''")
def _outside(d: Domain) -> DataFrame:
    """The rows of all tables that hold a value outside of their column's domain."""
    return reduce(DataFrame.unionByName, [I.outside_domains(df, table, _LISTS_OF[table][0]) for table, df in _with_domains(d).items()])


register("chk_event_subject", _broken_sql(I.EVENT))(lambda d: I.violations(deliveries(d), I.EVENT).select("event_id", F.array_join("broken", ",").alias("broken")))
register("chk_delivery_state", _broken_sql(I.DELIVERY))(lambda d: I.violations(deliveries(d), I.DELIVERY).select("event_id", F.array_join("broken", ",").alias("broken")))
register("uniq_full", "SELECT venue_id, image_key FROM photos GROUP BY ALL HAVING count(*) > 1")(lambda d: I.duplicates(d.photos(), ["venue_id", "image_key"]).select("venue_id", "image_key"))
register("uniq_partial", "SELECT venue_id, count(*) AS n FROM claims WHERE status = 'verified' GROUP BY venue_id HAVING count(*) > 1")(lambda d: I.duplicates(d.claims().where("status = 'verified'"), ["venue_id"]))
register("uniq_expression", "SELECT lower(substring(name, 1, 15)) AS key, count(*) AS n FROM users GROUP BY 1 HAVING count(*) > 1")(lambda d: I.duplicates(d.users().select(F.lower(F.substring("name", 1, 15)).alias("key")), ["key"]))
register("fk_orphans", "SELECT user_id FROM saved WHERE venue_id NOT IN (SELECT venue_id FROM venues)")(lambda d: I.orphans(d.saved(), d.venues(), ["venue_id"]).select("user_id"))
#: Records whose fields are spoilt by turns: (field, good, bad) as SQL of both engines over the venue's number n.
_SPOILT = [
    ("id", "venue_id", "CAST(NULL AS BIGINT)"), ("name", "name", "'  '"), ("neighborhood", "neighborhood", "''"), ("address", "'1 Main St'", "CAST(NULL AS VARCHAR(9))"),
    ("lat", "lat", "CAST(91.5 AS DOUBLE)"), ("lng", "lng", "CAST(NULL AS DOUBLE)"), ("start_time", "'16:00'", "'24:00'"), ("end_time", "'18:30'", "'6 pm'"), ("vibe", "'wine bar'", "vibe"),
    ("website", "'HTTPS://bar.test'", "'bar.test'"), ("verified", "verified", "CAST(NULL AS BOOLEAN)"), ("last_verified_present", "true", "false"), ("source_url", "'http://bar.test/menu'", "''"),
    ("image", "CAST(NULL AS VARCHAR(9))", "'javascript:x'"), ("phone", "'+1 (619) 555-0100'", "'call us'"), ("contact_name", "'Ann'", "' '"), ("contact_email", "'ann@bar.test'", "'ann@bar'"),
]
_LISTS = [("days", "days"), ("deals", "deal_types"), ("deal_types", "deal_types"), ("features", "features")]


def records(d: Domain) -> DataFrame:
    """Catalogue records and submissions made of venues; record n has the field of number n modulo 19 spoilt, and lists as the venue has them."""
    turn = F.col("ordinal") % 19
    days = F.when(turn == 18, F.array(F.lit("Funday"))).otherwise(F.col("days"))
    return d.venues().select("venue_id", *[F.when(turn == k, F.expr(bad)).otherwise(F.expr(good)).alias(c) for k, (c, good, bad) in enumerate(_SPOILT)], *[(days if c == "days" else F.col(of)).alias(c) for c, of in _LISTS])


_RECORDS = "(SELECT venue_id, " + ", ".join(f"CASE WHEN ordinal % 19 = {k} THEN {bad} ELSE {good} END AS {c}" for k, (c, good, bad) in enumerate(_SPOILT)) + ", " + ", ".join(f"CASE WHEN ordinal % 19 = 18 THEN ['Funday'] ELSE days END AS {c}" if c == "days" else f"{of} AS {c}" for c, of in _LISTS) + " FROM venues)"
_NO, _URL_SQL, _TIME_SQL, _LIST = (lambda c: f"trim(coalesce({c}, '')) = ''"), (lambda c: f"NOT regexp_matches(coalesce({c}, ''), '(?i)^https?://')"), (lambda c: f"NOT regexp_matches({c}, '^([01][0-9]|2[0-3]):[0-5][0-9]$')"), (lambda c: f"len({c}) = 0")
_DAYS_SQL = "len(days) = 0 OR len(list_filter(days, lambda x: x NOT LIKE '%day' OR x = 'Funday')) > 0"
_RULES_SQL = {
    "catalogue": {"id": "id IS NULL", **{c: _NO(c) for c in ("name", "neighborhood", "address")}, "lat": "lat IS NULL", "lng": "lng IS NULL", "lat_range": "lat NOT BETWEEN -90 AND 90", "lng_range": "lng NOT BETWEEN -180 AND 180", "days": _DAYS_SQL, "start_time": _TIME_SQL("start_time"), "end_time": _TIME_SQL("end_time"), "deals": _LIST("deals"), "vibe": _NO("vibe"), "website": _URL_SQL("website"), "verified": "verified IS NULL", "last_verified": "NOT last_verified_present", "source_url": _URL_SQL("source_url"), "deal_types": _LIST("deal_types"), "features": _LIST("features"), "image": "image IS NOT NULL"},
    "submission": {**{c: _NO(c) for c in ("name", "neighborhood", "address")}, "phone": "phone = 'call us'", "website": _URL_SQL("website"), "source_url": _URL_SQL("coalesce(nullif(source_url, ''), website)"), "days": _DAYS_SQL, "start_time": _TIME_SQL("start_time"), "end_time": _TIME_SQL("end_time"), "deals": _LIST("deals"), "vibe": _NO("vibe"), "lat_range": "lat NOT BETWEEN -90 AND 90", "image": "image IS NOT NULL", "contact_name": _NO("contact_name"), "contact_email": "contact_email = 'ann@bar'"},
    "patch": {"days": _DAYS_SQL, "start_time": _TIME_SQL("start_time"), "end_time": _TIME_SQL("end_time"), "deals": _LIST("deals"), "vibe": _NO("vibe"), "address": _NO("address"), "website": _URL_SQL("website"), "phone": "phone = 'call us'", "image": "image IS NOT NULL"},
}
for _name, _rules, _errors in (("val_listing", "catalogue", I.catalogue_errors), ("val_submission", "submission", I.submission_errors), ("val_owner_patch", "patch", I.owner_patch_errors)):
    _named = ", ".join(f"CASE WHEN {rule} THEN '{k}' END" for k, rule in _RULES_SQL[_rules].items())
    register(_name, f"SELECT venue_id, array_to_string(list_filter([{_named}], lambda x: x IS NOT NULL), ',') AS errors FROM {_RECORDS}")(lambda d, e=_errors: records(d).select("venue_id", F.array_join(e(), ",").alias("errors")))
_OFFERED = """(SELECT campaign_id, CASE WHEN campaign_id % 23 = 0 THEN 'flash_sale' ELSE type END AS type, repeat(title, (campaign_id % 10 + 1)::INT) AS title, repeat(description, (campaign_id % 15 + 1)::INT) AS description,
  repeat(trim(deal_code), (campaign_id % 6 + 1)::INT) AS deal_code, CASE WHEN campaign_id % 19 > 0 THEN starts_at END AS starts_at, CASE WHEN campaign_id % 17 > 0 THEN starts_at + to_hours(campaign_id % 30) END AS ends_at, campaign_id % 2 = 0 AS shown FROM campaigns)"""
_PROMOTION = {
    "type": "type NOT IN ('special_deal', 'extended_happy_hour', 'event', 'other')", "title": "shown AND title = ''", "title_length": "length(title) > 80", "description_length": "length(description) > 200", "code_length": "length(deal_code) > 30",
    "start": "shown AND starts_at IS NULL", "end": "shown AND ends_at IS NULL", "window": "(starts_at IS NULL) <> (ends_at IS NULL)", "duration": "ends_at - starts_at > INTERVAL 24 HOUR", "order": "ends_at <= starts_at",
}


@register("val_promotion", f"SELECT campaign_id, concat_ws(',', {', '.join(f'CASE WHEN {rule} THEN {k!r} END' for k, rule in _PROMOTION.items())}) AS errors FROM {_OFFERED}")
def _promotions(d: Domain) -> DataFrame:
    """Drafts and offers to be shown, in turn, of all lengths, kinds and windows."""
    k = F.col("campaign_id")
    often = lambda c, n: F.expr(f"repeat({c}, int(campaign_id % {n} + 1))")
    offers = d.campaigns().select(
        "campaign_id", F.when(k % 23 == 0, "flash_sale").otherwise(F.col("type")).alias("type"), often("title", 10).alias("title"), often("description", 15).alias("description"), often("trim(deal_code)", 6).alias("deal_code"),
        F.when(k % 19 > 0, F.col("starts_at")).alias("starts_at"), F.when(k % 17 > 0, T.plus(F.col("starts_at"), k % 30 * 3600)).alias("ends_at"),
    )
    return offers.select("campaign_id", F.array_join(I.promotion_errors(required=k % 2 == 0, type_="type"), ",").alias("errors"))


@register("val_alert_filters", f"""SELECT alert_id, CASE alert_id % 4 WHEN 0 THEN array_to_string(days, ',') WHEN 1 THEN array_to_string(list_append(days, 'Sunday'), ',') ELSE '' END AS days, neighborhood, deal_type, feature, substring(rtrim(repeat('ab ', (alert_id % 40)::INT)), 1, 80) AS query,
  CASE alert_id % 6 WHEN 0 THEN 'happy_hour' WHEN 3 THEN 'happy_hour,promotion' WHEN 4 THEN 'promotion' WHEN 5 THEN array_to_string(kinds, ',') ELSE '' END AS kinds, CASE WHEN alert_id % 6 IN (1, 2) THEN 'none' WHEN alert_id % 6 = 4 THEN 'unknown' ELSE '' END AS errors FROM alerts""")
def _filters(d: Domain) -> DataFrame:
    """What is kept of alerts' filters as they were typed, and what is wrong with their kinds."""
    k, none = F.col("alert_id"), F.array().cast("array<string>")
    days = F.when(k % 4 == 0, F.col("days")).when(k % 4 == 1, F.concat("days", F.array(F.lit("Funday"), F.lit(" Sunday ")))).when(k % 4 == 2, F.array(F.lit("monday")))
    kinds = F.when(k % 6 == 1, none).when(k % 6 == 2, F.array(F.lit(" "))).when(k % 6 == 3, F.array(F.lit("promotion"), F.lit(" happy_hour "))).when(k % 6 == 4, F.array(F.lit("promotion"), F.lit("news"), F.lit("promotion"))).when(k % 6 == 5, F.col("kinds"))
    typed = d.alerts().select("alert_id", days.alias("days"), F.concat(F.lit("  "), "neighborhood").alias("neighborhood"), "deal_type", F.nullif("feature", F.lit("")).alias("feature"), F.expr("repeat('ab ', int(alert_id % 40))").alias("query"), kinds.alias("kinds"))
    kept = typed.select("alert_id", I.alert_filters().alias("f"), I.alert_kinds(F.col("kinds")).alias("k"))
    return kept.select("alert_id", F.array_join("f.days", ",").alias("days"), "f.neighborhood", "f.deal_type", "f.feature", "f.query", F.array_join("k.kinds", ",").alias("kinds"), F.array_join("k.errors", ",").alias("errors"))


#: Choices of channels as they come, in JSON.
_CHOICES = ['{}', '{"email":false}', '{"email":"false","text":"false"}', '{"email":null,"text":null}', '{"email":true,"text":true}', '{"text":1}', '{"text":0}', '{"text":""}', '{"text":false}', '{"email":0,"text":[]}', "not json"]


@register("val_alert_channels", f"""WITH c AS (SELECT alert_id, CASE WHEN json_valid(j) THEN j::JSON END AS j FROM (SELECT alert_id, [{', '.join(f"'{c}'" for c in _CHOICES)}, NULL][(alert_id % {len(_CHOICES) + 1} + 1)::INT] AS j FROM alerts))
  SELECT alert_id, json_extract(j, '$.email')::VARCHAR IS DISTINCT FROM 'false' AS email, coalesce(json_extract(j, '$.text')::VARCHAR NOT IN ('null', 'false', '0', '""'), false) AS text FROM c""")
def _channels(d: Domain) -> DataFrame:
    """Channels of alerts from what was sent, which may be any JSON or none."""
    given = F.element_at(F.array(*map(F.lit, _CHOICES), F.lit(None).cast("string")), (F.col("alert_id") % (len(_CHOICES) + 1) + 1).cast("int"))
    return d.alerts().select("alert_id", I.alert_channels(given).alias("c")).select("alert_id", "c.email", "c.text")
