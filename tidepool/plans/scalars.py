"""Queries of text, number, array and JSON functions over whole columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidepool.functions import binary as B, geo, markdown, temporal as TT, text as X
from tidepool.operators import lifecycle as L
from tidepool.plans.registry import local, register, scalar, state
from tidepool.plans.temporal import NOW, campaign_state, occurrences
from tidepool.sources.domain import DAYS, FEATURES, Domain, picked

#: DuckDB: the same white space as ``text.SPACES``.
_S = "\\s\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{feff}"


def _clean(x: str) -> str:
    return f"coalesce(regexp_replace({x}, '^[{_S}]+|[{_S}]+$', '', 'g'), '')"


def _slug(x: str) -> str:
    return f"regexp_replace(regexp_replace(lower({x}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"


_PADDED = lambda c: F.concat(F.lit(" \t "), F.col(c), F.lit("﻿\n"))
scalar("str_clean", "part", "p_partkey", lambda: X.clean(F.when(F.col("p_partkey") % 9 == 0, None).otherwise(_PADDED("p_name"))), _clean("CASE WHEN p_partkey % 9 <> 0 THEN ' ' || chr(9) || chr(160) || p_name || chr(65279) || chr(10) END"))
scalar("str_clean_list", "documents", "doc_id", lambda: F.array_join(X.clean_list(F.col("text")), "|"), f"array_to_string(list_filter([{_clean('x')} FOR x IN regexp_split_to_array(text, '[\\n,]')], lambda y: y <> ''), '|')")
scalar("str_slugify", "part", "p_partkey", lambda: X.slugify(F.concat_ws(" & ", "p_name", "p_type")), _slug("p_name || ' & ' || p_type"))
scalar("str_slugify_80", "documents", "doc_id", lambda: X.slugify(F.col("text"), 80), f"regexp_replace(substring({_slug('text')}, 1, 80), '-+$', '')")
scalar("str_slug_to_key", "part", "p_partkey", lambda: F.concat(F.concat_ws("-", F.coalesce(F.nullif(X.slugify(F.col("p_name"), 60), F.lit("")), F.lit("image")), (F.col("p_partkey") + 1700000000000).cast("string"), F.substring(F.md5("p_name"), 1, 8)), F.lit(".jpg")), f"coalesce(nullif(regexp_replace(substring({_slug('p_name')}, 1, 60), '-+$', ''), ''), 'image') || '-' || (p_partkey + 1700000000000) || '-' || substring(md5(p_name), 1, 8) || '.jpg'")
scalar("str_normalise_search", "documents", "doc_id", lambda: X.normalise_search(F.col("text")), "trim(regexp_replace(lower(strip_accents(text)), '[^a-z0-9]+', ' ', 'g'))")
scalar("str_extract_domain", "pages", "page_id", lambda: X.extract_domain(F.concat(F.lit(" HTTPS://me@www."), F.regexp_replace("url", "^http://", ""))), "regexp_replace(list_extract(string_split(split_part(regexp_replace(lower(trim(' HTTPS://me@www.' || regexp_replace(url, '^http://', ''))), '^[a-z]+://', ''), '/', 1), '@'), -1), '^www\\.', '')")
scalar("str_labelize", "part", "p_partkey", lambda: X.labelize(F.concat_ws("-", F.lower("p_type"), "p_name")), "array_to_string([upper(substring(x, 1, 1)) || substring(x, 2) FOR x IN regexp_extract_all(lower(p_type) || '-' || p_name, '([A-Za-z0-9_]+|[^A-Za-z0-9_]+)')], '')")
scalar("str_escape_html", "pages", "page_id", lambda: X.escape_html(F.col("html")), "replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')")
_HM = lambda k: F.concat(F.lpad((F.col(k) % 24).cast("string"), 2, "0"), F.lit(":"), F.lpad((F.col(k) % 60).cast("string"), 2, "0"))
_HM_SQL = "lpad((o_orderkey % 24)::VARCHAR, 2, '0') || ':' || lpad((o_orderkey % 60)::VARCHAR, 2, '0')"
scalar("str_format_time", "orders", "o_orderkey", lambda: X.format_time(_HM("o_orderkey")), "CASE WHEN o_orderkey % 24 % 12 = 0 THEN 12 ELSE o_orderkey % 24 % 12 END || ':' || lpad((o_orderkey % 60)::VARCHAR, 2, '0') || CASE WHEN o_orderkey % 24 < 12 THEN ' AM' ELSE ' PM' END")
scalar("str_format_distance", "orders", "o_orderkey", lambda: X.format_distance((F.col("o_orderkey") % 97) / 13.7), "CASE WHEN (o_orderkey % 97) / 13.7::DOUBLE < 0.1 THEN 'Nearby' WHEN (o_orderkey % 97) / 13.7::DOUBLE < 1 THEN printf('%.1f', (o_orderkey % 97) / 13.7::DOUBLE * 5280 / 1000) || 'k ft' ELSE printf('%.1f', (o_orderkey % 97) / 13.7::DOUBLE) || ' mi' END")
scalar("str_plan_normalise", "claims", "claim_id", lambda: X.plan_name(F.col("plan")), "CASE regexp_replace(lower(trim(plan)), '[ -]+', '_', 'g') WHEN 'paid' THEN 'pro' WHEN 'pro' THEN 'pro' WHEN 'founding' THEN 'founding_partner' WHEN 'founding_partner' THEN 'founding_partner' ELSE 'free' END")
scalar("str_truncate", "documents", "doc_id", lambda: F.concat_ws("|", *[F.substring("text", 1, n) for n in (20, 80, 200, 1000)]), "concat_ws('|', substring(text, 1, 20), substring(text, 1, 80), substring(text, 1, 200), substring(text, 1, 1000))")
_MESSY = lambda: F.concat(F.lpad((F.col("o_orderkey") % 30).cast("string"), 2, "0"), F.lit(":"), F.lpad((F.col("o_orderkey") % 70).cast("string"), 2, "0"))
scalar("str_regex_valid_time", "orders", "o_orderkey", lambda: _MESSY().rlike(X.TIME), "o_orderkey % 30 < 24 AND o_orderkey % 70 < 60")
scalar("str_regex_valid_email", "users", "user_id", lambda: F.when(F.col("user_id") % 3 == 0, F.replace("email", F.lit("@"), F.lit(" "))).otherwise(F.col("email")).rlike(X.EMAIL), "user_id % 3 <> 0")
scalar("str_regex_valid_phone", "users", "user_id", lambda: F.col("phone").rlike(X.PHONE), "regexp_matches(phone, '^\\+?[0-9()\\-.\\s]{7,20}$')")
scalar("str_regex_valid_url", "pages", "page_id", lambda: F.concat_ws(" ", F.col("url").rlike(X.URL).cast("string"), F.substr("url", F.lit(8)).rlike(X.STORED_IMAGE).cast("string"), F.concat(F.lit("/api/images/"), F.col("page_id").cast("string")).rlike(X.OWN_IMAGE).cast("string")), "concat_ws(' ', regexp_matches(url, '(?i)^https?://')::VARCHAR, regexp_matches(substring(url, 8), '(?i)^(/[^/]|https?://)')::VARCHAR, regexp_matches('/api/images/' || page_id, '^/api/images/[^/]+$')::VARCHAR)")
_ID = lambda: F.regexp_replace(F.md5("p_name"), "^(.{8})(.{4}).(.{3}).(.{3})(.{12})$", "$1-$2-4$3-a$4-$5")
scalar("str_regex_valid_uuid", "part", "p_partkey", lambda: F.when(F.col("p_partkey") % 2 == 0, _ID()).otherwise(F.md5("p_name")).rlike(X.UUID), "p_partkey % 2 = 0")
scalar("str_phone_digits", "users", "user_id", lambda: F.regexp_replace("phone", "[^0-9+]", ""), "regexp_replace(phone, '[^0-9+]', '', 'g')")
scalar("str_trust_label", "venues", "venue_id", lambda: F.when(F.col("verified") & (F.col("ordinal") % 2 == 0), F.concat(F.lit("Verified "), F.date_format(F.date_add(F.lit("1998-01-01").cast("date"), F.col("ordinal").cast("int")), "MMM d"))).when(F.col("verified"), "Verified").otherwise("Needs verification"), "CASE WHEN verified AND ordinal % 2 = 0 THEN 'Verified ' || strftime(DATE '1998-01-01' + ordinal::INT, '%b %-d') WHEN verified THEN 'Verified' ELSE 'Needs verification' END")
scalar("str_pluralise", "follows", "user_id", lambda: F.concat((F.col("user_id") % 3).cast("string"), F.when(F.col("user_id") % 3 == 1, " offer left").otherwise(" offers left")), "(user_id % 3) || CASE WHEN user_id % 3 = 1 THEN ' offer left' ELSE ' offers left' END")
#: Labels of campaign types and states.
LABELS = {"special_deal": "Special Deal", "extended_happy_hour": "Extended Happy Hour", "event": "Event", "other": "Other"}
STATE_LABELS = {"draft": "Draft", "scheduled": "Scheduled", "live": "Live", "ended": "Ended", "cancelled": "Cancelled"}


def labelled(labels: dict[str, str], name: Column) -> Column:
    """The label of a name; one without a label is shown as it is."""
    return F.coalesce(F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])[name], name)


def _case(labels: dict[str, str], x: str) -> str:
    return f"CASE {x} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in labels.items()) + f" ELSE {x} END"


scalar("str_enum_label", "campaigns", "campaign_id", lambda: F.concat_ws(" / ", labelled(LABELS, F.col("type")), labelled(STATE_LABELS, campaign_state())), f"concat_ws(' / ', {_case(LABELS, 'type')}, {_case(STATE_LABELS, state(NOW))})")
scalar("str_filter_summary", "alerts", "alert_id", lambda: F.coalesce(F.nullif(F.array_join(F.filter(F.array(F.array_join("days", ", "), "neighborhood", "deal_type", "feature", "query"), lambda x: x != ""), " | "), F.lit("")), F.lit("Any")), "coalesce(nullif(array_to_string(list_filter([array_to_string(days, ', '), neighborhood, deal_type, feature, query], lambda x: x <> ''), ' | '), ''), 'Any')")


@register("str_event_key_schedule", """WITH o AS (SELECT venue_id, DATE '1998-10-18' + i::INT AS date, days, start_min FROM venues, range(14) t(i))
  SELECT venue_id, 'hh:' || venue_id || ':' || strftime(date, '%Y-%m-%d') || ':' || lpad((start_min // 60)::VARCHAR, 2, '0') || ':' || lpad((start_min % 60)::VARCHAR, 2, '0') AS value FROM o WHERE list_contains(days, dayname(date))""")
def _schedule_keys(d: Domain) -> DataFrame:
    """Keys of every occurrence of two weeks across a clock change, from the local date and clock at which it begins."""
    begins = TT.local(F.col("at.starts_at"))
    return occurrences(d).select("venue_id", X.schedule_event_key(F.col("venue_id"), F.date_format(begins, "yyyy-MM-dd"), F.date_format(begins, "HH:mm")).alias("value"))


scalar("str_event_key_campaign", "campaigns", "campaign_id", lambda: F.concat(F.lit("promotion:"), F.col("campaign_id").cast("string")), "'promotion:' || campaign_id")
_DOC = lambda: F.concat(F.lit("---\ntitle: \"A "), F.col("doc_id").cast("string"), F.lit("\"\ndraft: true\nlang: "), F.col("lang"), F.lit("\n---\n"), F.col("text"))
_DOC_SQL = "('---' || chr(10) || 'title: \"A ' || doc_id || '\"' || chr(10) || 'draft: true' || chr(10) || 'lang: ' || lang || chr(10) || '---' || chr(10) || text)"
scalar("str_frontmatter_split", "documents", "doc_id", lambda: F.concat_ws("=", X.frontmatter(_DOC()).header, X.frontmatter(_DOC()).body), "'title: \"A ' || doc_id || '\"' || chr(10) || 'draft: true' || chr(10) || 'lang: ' || lang || '=' || text")
scalar("str_frontmatter_value", "documents", "doc_id", lambda: F.concat_ws("|", *[X.header_value(X.frontmatter(_DOC()).header, f) for f in ("title", "draft", "lang")]), "'A ' || doc_id || '|true|' || lang")
scalar("sink_rewrite_header_field", "documents", "doc_id", lambda: F.md5(X.drop_header_field(X.set_header_field(X.set_header_field(_DOC(), "draft", F.lit("false")), "slug", F.col("source")), "lang")), "md5('---' || chr(10) || 'title: \"A ' || doc_id || '\"' || chr(10) || 'draft: false' || chr(10) || 'slug: ' || source || chr(10) || '---' || chr(10) || text)")
scalar("str_markdown_inline", "documents", "doc_id", lambda: markdown.inline(F.concat(F.lit("**b** `c` *i* [l](http://x y) & "), F.regexp_replace("text", r"[*`\\[\\]&<>]", ""))), """'<strong>b</strong> <code>c</code> <em>i</em> <a href="http://x y" target="_blank" rel="noopener">l</a> &amp; ' || regexp_replace(text, '[*`\\[\\]&<>]', '', 'g')""")
_DRAFT = lambda: F.concat(F.when(F.col("doc_id") % 2 == 0, "```md\nTITLE: ").otherwise("TITLE:"), F.col("source"), F.lit("\nDESCRIPTION: about "), F.col("lang"), F.when(F.col("doc_id") % 5 == 0, "\n").otherwise("\n---BODY---\n"), F.when(F.col("doc_id") % 7 == 0, "").otherwise(F.concat(F.lit("b "), F.replace("text", F.lit("`"), F.lit("")), F.lit(" e"))), F.when(F.col("doc_id") % 2 == 0, "\n```").otherwise(""))
scalar("str_draft_extract", "documents", "doc_id", lambda: X.let(X.draft(_DRAFT()), lambda f: F.coalesce(f.error, F.concat_ws("|", f.title, f.description, f.body))), "CASE WHEN doc_id % 5 = 0 THEN 'missing_body_marker' WHEN doc_id % 7 = 0 THEN 'missing_field' ELSE source || '|about ' || lang || '|b ' || replace(text, '`', '') || ' e' END")
scalar("str_json_object_in_text", "events", "event_id", lambda: F.when(X.json_object_in(F.concat(F.lit("said: "), F.col("props"), F.lit(" done"))).isNotNull(), X.json_object_in(F.concat(F.lit("said: "), F.col("props"), F.lit(" done")))), "props")
scalar("str_url_encode", "part", "p_partkey", lambda: X.url_encode(F.concat_ws(" & ", "p_name", "p_type", F.lit("é'(x)"))), "replace(replace(replace(url_encode(p_name || ' & ' || p_type || ' & ' || 'é''(x)'), '%27', ''''), '%28', '('), '%29', ')')")
#: Inputs of the parsers below, by turns.
_LISTS, _QUOTAS = ["7, 42,7", "", "5,0", "3,x", "9, 12 ,3,9", "1,,2", "9007199254740993"], ["12", " Unlimited ", "", "0", "-3", "1.5", "9007199254740992", " 8 "]
_TURN = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.col("p_partkey") % len(values) + 1).cast("int"))
_TURN_SQL = lambda values: f"[{', '.join(map(repr, values))}][(p_partkey % {len(values)} + 1)::INT]"
_WHOLE = lambda x: f"(regexp_full_match({x}, '[1-9][0-9]*') AND TRY_CAST({x} AS HUGEINT) <= 9007199254740991)"
scalar("str_csv_int_set", "part", "p_partkey", lambda: F.coalesce(X.id_set(_TURN(_LISTS)).error, F.array_join(X.id_set(_TURN(_LISTS)).ids, ",")), f"CASE WHEN {_TURN_SQL(_LISTS)} = '' THEN '' WHEN len(list_filter(string_split({_TURN_SQL(_LISTS)}, ','), lambda x: NOT coalesce({_WHOLE('trim(x)')}, false))) > 0 THEN 'not_a_positive_integer' ELSE CASE p_partkey % {len(_LISTS)} WHEN 0 THEN '7,42' ELSE '9,12,3' END END")
_QUOTA = lambda: X.allowance(F.when(F.col("p_partkey") % 9 != 0, _TURN(_QUOTAS)), F.lit(4), F.col("p_partkey") % 11 != 0)
scalar("str_allowance_parse", "part", "p_partkey", lambda: F.coalesce(_QUOTA().error, F.when(_QUOTA().unlimited, "unlimited"), _QUOTA().allowance.cast("string")), f"CASE WHEN p_partkey % 11 = 0 THEN '4' WHEN p_partkey % 9 = 0 THEN 'unlimited' WHEN trim({_TURN_SQL(_QUOTAS)}) = '' THEN '4' WHEN lower(trim({_TURN_SQL(_QUOTAS)})) = 'unlimited' THEN 'unlimited' WHEN coalesce({_WHOLE(f'trim({_TURN_SQL(_QUOTAS)})')}, false) THEN trim({_TURN_SQL(_QUOTAS)}) ELSE 'not_a_positive_integer' END")
_AT = lambda x: f"(strftime({local(x)}, '%a, %b %-d, %-I:%M %p ') || CASE WHEN epoch({local(x)}) - epoch({x}) = -25200 THEN 'PDT' ELSE 'PST' END)"
scalar("str_timing_label", "campaigns", "campaign_id", lambda: L.timing_label(campaign_state()), f"CASE WHEN {state(NOW)} = 'live' THEN 'Ends ' || {_AT('least(ends_at, ended_at)')} WHEN starts_at IS NOT NULL AND ends_at IS NOT NULL THEN {_AT('starts_at')} || ' – ' || {_AT('least(ends_at, ended_at)')} WHEN {state(NOW)} = 'draft' THEN 'Timing not set' ELSE 'Timing unavailable' END")
scalar("str_preview_label", "campaigns", "campaign_id", lambda: L.preview_label(F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv])[F.col("type")], F.col("campaign_id") % 3 == 0), "concat_ws(chr(10), CASE WHEN trim(title) = '' THEN 'Your promotion headline' ELSE trim(title) END, CASE type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in LABELS.items()) + f" END || CASE WHEN trim(description) = '' THEN '' ELSE ' · ' || trim(description) END, CASE WHEN campaign_id % 3 = 0 THEN 'Starts now · ends ' || {_AT('ends_at')} ELSE {_AT('starts_at')} || ' – ' || {_AT('ends_at')} END)")

scalar("num_safe_positive_int", "orders", "o_orderkey", lambda: (F.col("o_orderkey") * 700000000000).between(1, 9007199254740991), "o_orderkey * 700000000000 BETWEEN 1 AND 9007199254740991")
scalar("num_clamp_floor", "customer", "c_custkey", lambda: F.greatest(F.col("c_acctbal"), F.lit(0.0)), "greatest(c_acctbal, 0.0)")
scalar("num_rating", "saved", "user_id", lambda: F.when(F.col("status").isin("favorite", "been_to") & F.col("rating").between(1, 5), F.col("rating")), "CASE WHEN status IN ('favorite', 'been_to') AND rating BETWEEN 1 AND 5 THEN rating END")
scalar("num_big_endian", "orders", "o_orderkey", lambda: B.number(F.unhex(F.concat(F.lit("ff"), F.lpad(F.hex("o_orderkey"), 8, "0"))), 1, 4) * 65536 + B.number(F.unhex(F.lpad(F.hex(F.col("o_orderkey") % 65536), 4, "0")), 0, 2), "o_orderkey * 65536 + o_orderkey % 65536")
_CENTER = (32.7, -117.1)
_HAV = "(pow(sin(radians(lat - 32.7) / 2), 2) + cos(radians(32.7)) * cos(radians(lat)) * pow(sin(radians(lng + 117.1) / 2), 2))"
scalar("geo_haversine_exact", "venues", "venue_id", lambda: F.round(geo.haversine(F.lit(_CENTER[0]), F.lit(_CENTER[1]), F.col("lat"), F.col("lng")), 6), f"round(2 * 3958.7613::DOUBLE * asin(least(1.0::DOUBLE, sqrt({_HAV}))), 6)")
scalar("geo_haversine_legacy", "venues", "venue_id", lambda: F.round(geo.haversine_legacy(F.lit(_CENTER[0]), F.lit(_CENTER[1]), F.col("lat"), F.col("lng")), 6), f"round(2 * 3959.0::DOUBLE * atan2(sqrt({_HAV}), sqrt(1 - {_HAV})), 6)")
scalar("geo_valid_point", "venues", "venue_id", lambda: geo.valid_point(F.when(F.col("ordinal") % 3 == 0, None).otherwise(F.col("lat") + F.col("ordinal") % 90), F.col("lng")), "coalesce(CASE WHEN ordinal % 3 <> 0 THEN lat + ordinal % 90 END BETWEEN -90 AND 90 AND lng BETWEEN -180 AND 180, false)")

scalar("arr_contains", "venues", "venue_id", lambda: F.array_contains("days", "Friday"), "list_contains(days, 'Friday')")
scalar("arr_overlap", "venues", "venue_id", lambda: F.arrays_overlap("features", F.array(F.lit("patio"), F.lit("live-music"))), "list_has_any(features, ['patio', 'live-music'])")
scalar("arr_filter_map", "venues", "venue_id", lambda: F.array_join(F.filter(F.transform("features", lambda x: F.regexp_extract(x, "^(.*)-", 1)), lambda x: x != ""), ","), "array_to_string(list_filter([regexp_extract(x, '^(.*)-', 1) FOR x IN features], lambda x: x <> ''), ',')")
scalar("arr_flatten", "venues", "venue_id", lambda: F.array_join(F.flatten(F.array("days", "features")), ","), "array_to_string(flatten([days, features]), ',')")
scalar("arr_slice", "venues", "venue_id", lambda: F.array_join(F.slice("days", 1, 3), ","), "array_to_string(list_slice(days, 1, 3), ',')")
scalar("arr_join", "venues", "venue_id", lambda: F.array_join("days", " / "), "array_to_string(days, ' / ')")
scalar("arr_index_of", "venues", "venue_id", lambda: (F.array_position("days", "Friday") - 1).cast("int"), "(coalesce(list_position(days, 'Friday'), 0) - 1)::INT")
scalar("arr_all", "venues", "venue_id", lambda: F.forall("days", lambda x: x.endswith("day")), "len(list_filter(days, lambda x: NOT suffix(x, 'day'))) = 0")
scalar("arr_any", "venues", "venue_id", lambda: F.exists("days", lambda x: x.startswith("S")), "len(list_filter(days, lambda x: x[1] = 'S')) > 0")
scalar("arr_all_nonempty_strings", "venues", "venue_id", lambda: (F.size("deal_types") > 0) & F.forall("deal_types", lambda x: F.trim(x) != ""), "len(deal_types) > 0")
scalar("json_encode", "venues", "venue_id", lambda: F.to_json(F.struct("venue_id", "neighborhood")), "'{\"venue_id\":' || venue_id || ',\"neighborhood\":\"' || neighborhood || '\"}'")
scalar("json_decode", "events", "event_id", lambda: F.to_json(F.from_json("props", "map<string,string>")).isNotNull(), "json_valid(props)")
scalar("json_string_list", "documents", "doc_id", lambda: F.array_join(F.slice(F.filter(F.transform(F.split(F.lower("text"), "\\."), X.clean), lambda x: x != ""), 1, 12), "|"), f"array_to_string(list_slice(list_filter([{_clean('x')} FOR x IN string_split(lower(text), '.')], lambda x: x <> ''), 1, 12), '|')")
scalar("json_key_presence", "events", "event_id", lambda: F.array_join(F.array_sort(F.json_object_keys("props")), ","), "array_to_string(list_sort(json_keys(props)), ',')")
scalar("cond_coalesce", "campaigns", "campaign_id", lambda: F.coalesce("deal_code", "title", F.lit("-")), "coalesce(deal_code, title, '-')")
scalar("cond_nullif", "campaigns", "campaign_id", lambda: F.nullif("title", F.lit("")), "nullif(title, '')")
scalar("cond_least", "campaigns", "campaign_id", lambda: F.date_format(F.least("ends_at", "ended_at", "cancelled_at"), "yyyy-MM-dd HH:mm"), "strftime(least(ends_at, ended_at, cancelled_at), '%Y-%m-%d %H:%M')")
scalar("cond_case", "campaigns", "campaign_id", lambda: F.when(F.col("cancelled_at").isNotNull(), "c").when(F.col("ended_at").isNotNull(), "e").otherwise("-"), "CASE WHEN cancelled_at IS NOT NULL THEN 'c' WHEN ended_at IS NOT NULL THEN 'e' ELSE '-' END")

scalar("set_ordered_union", "venues", "venue_id", lambda: F.array_join(F.array_union(F.array(*map(F.lit, FEATURES[:2])), "features"), ","), "array_to_string(list_concat(['patio', 'dog-friendly'], list_filter(features, lambda x: x NOT IN ('patio', 'dog-friendly'))), ',')")
scalar("set_stable_reorder", "venues", "venue_id", lambda: F.array_join(F.concat(F.filter(F.array(*map(F.lit, reversed(DAYS))), lambda x: F.array_contains("days", x)), F.array_except("days", F.array(*map(F.lit, reversed(DAYS))))), ","), "array_to_string(list_filter(['Saturday', 'Friday', 'Thursday', 'Wednesday', 'Tuesday', 'Monday', 'Sunday'], lambda x: list_contains(days, x)), ',')")
scalar("set_canonical_subset", "alerts", "alert_id", lambda: F.array_join(F.array_intersect(F.array(F.lit("happy_hour"), F.lit("promotion")), F.reverse("kinds")), ","), "array_to_string(list_filter(['happy_hour', 'promotion'], lambda x: list_contains(kinds, x)), ',')")
scalar("set_difference_unknown", "venues", "venue_id", lambda: F.array_join(F.array_except("features", F.array(*map(F.lit, FEATURES[:2]))), ","), "array_to_string(list_filter(features, lambda x: x NOT IN ('patio', 'dog-friendly')), ',')")
scalar("limit_first_n_array", "venues", "venue_id", lambda: F.array_join(F.slice("days", 1, 2), ","), "array_to_string(list_slice(days, 1, 2), ',')")
scalar("limit_overflow_label", "venues", "venue_id", lambda: X.overflow_label(F.col("days")), "array_to_string(list_slice(days, 1, 3), ', ') || CASE WHEN len(days) > 3 THEN ' +' || (len(days) - 3) || ' more' ELSE '' END")
scalar("win_dedup_sorted_adjacent", "venues", "venue_id", lambda: F.array_join(F.array_distinct(F.array_sort(F.concat("days", "days"))), ","), "array_to_string(list_sort(days), ',')")
scalar("proj_week_dots", "venues", "venue_id", lambda: F.array_join(F.transform(F.array(*map(F.lit, DAYS)), lambda x: F.when(F.array_contains("days", x), F.when(x == "Monday", "T").otherwise("x")).otherwise(".")), ""), "array_to_string([CASE WHEN list_contains(days, x) THEN CASE WHEN x = 'Monday' THEN 'T' ELSE 'x' END ELSE '.' END FOR x IN ['Sunday', 'Monday', 'Tuesday', 'Wednesday', 'Thursday', 'Friday', 'Saturday']], '')")
scalar("proj_drop_empty_key", "venues", "venue_id", lambda: F.to_json(F.struct("venue_id", F.nullif("image", F.lit("")).alias("image"))), "CASE WHEN image = '' THEN '{\"venue_id\":' || venue_id || '}' ELSE '{\"venue_id\":' || venue_id || ',\"image\":\"' || image || '\"}' END")
scalar("proj_deal_code_class", "campaigns", "campaign_id", lambda: F.when(F.col("deal_code").isNull(), "none").when(F.col("campaign_id") % 2 == 0, "gated").otherwise(F.concat(F.lit("revealed:"), F.trim("deal_code"))), "CASE WHEN deal_code IS NULL THEN 'none' WHEN campaign_id % 2 = 0 THEN 'gated' ELSE 'revealed:' || trim(deal_code) END")
