"""Queries of aggregates, windows, sorts and limits, and set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidepool.functions import geo, temporal as T
from tidepool.operators import accounting as A, nearby as N, search as S
from tidepool.plans.registry import iso, local, register, state
from tidepool.plans.relational import _HAV, _LIVE_SQL, _MATCH, ON, on
from tidepool.plans.temporal import NOW, campaign_state
from tidepool.sources.domain import CAMPAIGN_NOW, LOG_NOW, Domain, instant

_LOG = f"TIMESTAMP '{LOG_NOW}'"


def ranked(df: DataFrame, bucket: Column, day: Column, order: list[Column], keep: list[str]) -> DataFrame:
    """Rows with their place in the order of bucket, day from the newest on, then ``order``.

    A row's place is its place within bucket and day and the rows of all that come
    before; only those counts, one for each bucket and day, are in one window.
    """
    rows = df.withColumn("_bucket", bucket).withColumn("_day", day)
    counts = rows.groupBy("_bucket", "_day").agg(F.count(F.lit(1)).alias("_n"))
    ahead = counts.withColumn("_ahead", F.coalesce(F.sum("_n").over(W.orderBy("_bucket", F.desc("_day")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    own = F.row_number().over(W.partitionBy("_bucket", "_day").orderBy(*order))
    return rows.withColumn("_own", own).join(ahead, ["_bucket", "_day"]).select(*keep, (F.col("_ahead") + F.col("_own")).cast("int").alias("place"))


register("agg_count_filtered", "SELECT count(*) AS n FROM photos WHERE status = 'pending' AND photo_type = 'menu'")(lambda d: d.photos().where("status = 'pending' AND photo_type = 'menu'").agg(F.count(F.lit(1)).alias("n")))
register("agg_count_by_status", "SELECT count(*) AS total, count_if(status = 'pending')::BIGINT AS pending, count_if(status = 'approved')::BIGINT AS approved, count_if(status = 'denied')::BIGINT AS denied FROM submissions")(lambda d: d.submissions().agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in ("pending", "approved", "denied")]))
register("agg_max_plus_one", "SELECT s.section_id, (coalesce(max(i.sort_order) + 1, 0))::INT AS next FROM sections s LEFT JOIN items i ON s.section_id = i.section_id GROUP BY s.section_id")(lambda d: d.sections().select("section_id").join(d.items().groupBy("section_id").agg(F.max("sort_order").alias("m")), "section_id", "left").select("section_id", F.coalesce(F.col("m") + 1, F.lit(0)).alias("next")))
register("agg_group_collect", "SELECT user_id, string_agg(alert_id::VARCHAR, ',' ORDER BY created_at, alert_id) AS alerts FROM alerts WHERE active GROUP BY user_id")(lambda d: d.alerts().where("active").groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("created_at", "alert_id"))), lambda x: x["alert_id"].cast("string")), ",").alias("alerts")))
_SENT_TODAY = f"channel = 'text' AND sent_at >= date_trunc('day', {_LOG}) AND sent_at < {_LOG}"
register("agg_count_distinct_per_key", f"SELECT user_id, count(DISTINCT sent_at) AS n FROM sends WHERE {_SENT_TODAY} GROUP BY user_id")(lambda d: d.sends().where((F.col("channel") == "text") & (F.col("sent_at") >= F.date_trunc("day", instant(LOG_NOW))) & (F.col("sent_at") < instant(LOG_NOW))).groupBy("user_id").agg(F.countDistinct("sent_at").alias("n")))
register("agg_bool_or", "SELECT user_id, bool_or(channel_email) AS wants_email, bool_or(channel_text) AS wants_text FROM alerts GROUP BY user_id")(lambda d: d.alerts().groupBy("user_id").agg(F.bool_or("channel_email").alias("wants_email"), F.bool_or("channel_text").alias("wants_text")))
register("agg_set_union_matches", f"SELECT a.user_id, v.venue_id, min(a.alert_id) AS first_alert FROM alerts a JOIN (SELECT * FROM venues WHERE {ON}) v ON {_MATCH} WHERE a.active GROUP BY a.user_id, v.venue_id")(lambda d: S.unions(d.alerts().where("active"), d.venues().where(on())))
_COUNTED = f"""SELECT venue_id, strftime({local('starts_at')}, '%Y-%m') AS month, count_if(starts_at <= {NOW} AND (cancelled_at IS NULL OR cancelled_at > starts_at))::BIGINT AS consumed, count_if(starts_at > {NOW} AND cancelled_at IS NULL)::BIGINT AS reserved
  FROM campaigns WHERE published_at IS NOT NULL AND starts_at IS NOT NULL GROUP BY ALL"""
register("agg_monthly_usage", _COUNTED)(lambda d: A.usage(d.campaigns(), instant(CAMPAIGN_NOW)))
register("agg_entitlement", f"""WITH u AS ({_COUNTED}), p AS (SELECT venue_id, max(CASE WHEN venue_id IN (1, 4, 9) OR plan = ' founding-partner' THEN 2 WHEN plan = 'Pro' THEN 1 ELSE 0 END) AS rank FROM claims WHERE status = 'verified' GROUP BY venue_id)
  SELECT u.venue_id, u.month, CASE coalesce(rank, 0) WHEN 0 THEN 1 WHEN 1 THEN 8 END AS allowance, CASE coalesce(rank, 0) WHEN 0 THEN greatest(1 - consumed - reserved, 0) WHEN 1 THEN greatest(8 - consumed - reserved, 0) END AS remaining FROM u LEFT JOIN p ON u.venue_id = p.venue_id""")(lambda d: A.entitlements(A.usage(d.campaigns(), instant(CAMPAIGN_NOW)), d.claims(), partners="1, 4,9"))
register("agg_distinct_sorted", "SELECT x AS value, count(*) AS n FROM (SELECT unnest(features) AS x FROM venues) GROUP BY x")(lambda d: d.venues().select(F.explode("features").alias("value")).groupBy("value").agg(F.count(F.lit(1)).alias("n")).orderBy("value"))
register("set_distinct", "SELECT DISTINCT neighborhood FROM venues")(lambda d: d.venues().select("neighborhood").distinct())
_BUCKET = f"CASE {state(NOW)} WHEN 'live' THEN 'active' WHEN 'scheduled' THEN 'scheduled' WHEN 'draft' THEN 'drafts' ELSE 'past' END"
register("agg_partition_by_state", f"SELECT bucket, venue_id, count(*) AS n FROM (SELECT venue_id, {_BUCKET} AS bucket FROM campaigns) GROUP BY bucket, venue_id")(lambda d: A.bucketed(d.campaigns(), campaign_state()).groupBy("bucket", "venue_id").agg(F.count(F.lit(1)).alias("n")))
register("agg_keyed_last_wins", f"SELECT venue_id, arg_max(campaign_id, (ends_at, campaign_id)) AS campaign_id FROM campaigns WHERE {_LIVE_SQL} GROUP BY venue_id")(lambda d: S.live_campaigns(d.campaigns(), instant(CAMPAIGN_NOW)).groupBy("venue_id").agg(F.max_by("campaign_id", F.struct("ends_at", "campaign_id")).alias("campaign_id")))
register("agg_match_count", f"SELECT a.alert_id, count(*) AS n, array_to_string(list_slice(list(v.venue_id ORDER BY v.venue_id), 1, 12), ',') AS first FROM alerts a JOIN venues v ON {_MATCH} GROUP BY a.alert_id")(lambda d: S.match_counts(d.alerts(), d.venues()).select("alert_id", "n", F.array_join(F.transform("first", lambda x: x.cast("string")), ",").alias("first")))
register("agg_min_future_boundary", f"SELECT venue_id, {iso(f'min(t)')} AS next FROM (SELECT venue_id, starts_at AS t FROM campaigns UNION ALL SELECT venue_id, ends_at FROM campaigns) WHERE t > {NOW} GROUP BY venue_id")(lambda d: d.campaigns().select("venue_id", F.explode(F.array("starts_at", "ends_at")).alias("t")).where(F.col("t") > instant(CAMPAIGN_NOW)).groupBy("venue_id").agg(T.iso(F.min("t")).alias("next")))
register("agg_live_count", f"SELECT count(*) AS shown, (SELECT count(*) FROM venues WHERE {ON}) AS live FROM venues WHERE verified")(lambda d: d.venues().agg(F.count_if("verified").alias("shown"), F.count_if(on()).alias("live")))
register("agg_referrers_by_key", "SELECT image_key, string_agg(photo_id::VARCHAR, ',' ORDER BY photo_id) AS referrers FROM photos GROUP BY image_key")(lambda d: d.photos().groupBy("image_key").agg(F.array_join(F.transform(F.array_sort(F.collect_list("photo_id")), lambda x: x.cast("string")), ",").alias("referrers")))
register("agg_duplicate_detection", "SELECT venue_id, count(*) AS n FROM claims GROUP BY venue_id HAVING count(*) > 1")(lambda d: d.claims().groupBy("venue_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
register("agg_bytes_total", "SELECT source, sum(octet_length(encode(text)))::BIGINT AS bytes FROM documents GROUP BY source")(lambda d: d.raw("documents").groupBy("source").agg(F.sum(F.octet_length("text")).alias("bytes")))

register("win_prev_next", "SELECT doc_id, lag(doc_id) OVER w AS newer, lead(doc_id) OVER w AS older FROM documents WINDOW w AS (PARTITION BY source ORDER BY n_chars DESC, doc_id)")(lambda d: (lambda w: d.raw("documents").select("doc_id", F.lag("doc_id").over(w).alias("newer"), F.lead("doc_id").over(w).alias("older")))(W.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")))
register("win_first_occurrence_dedup", "SELECT venue_id, image_key, min_by(photo_id, (sort_order, photo_id)) AS photo_id FROM photos GROUP BY venue_id, image_key")(lambda d: d.photos().groupBy("venue_id", "image_key").agg(F.min_by("photo_id", F.struct("sort_order", "photo_id")).alias("photo_id")))
register("win_first_conflict", f"""SELECT a.campaign_id, arg_max(b.campaign_id, (b.created_at, b.campaign_id)) AS conflict FROM campaigns a JOIN campaigns b ON a.venue_id = b.venue_id AND a.campaign_id <> b.campaign_id AND a.starts_at < least(b.ends_at, b.ended_at) AND b.starts_at < least(a.ends_at, a.ended_at)
  WHERE b.published_at IS NOT NULL AND b.cancelled_at IS NULL AND a.published_at IS NOT NULL AND a.cancelled_at IS NULL GROUP BY a.campaign_id""")(lambda d: A.first_conflicts(d.campaigns()))
_COOLED = """WITH RECURSIVE numbered AS (SELECT user_id, venue_id, channel, sent_at FROM sends), kept AS (
  SELECT user_id, venue_id, channel, min(sent_at) AS sent_at FROM numbered GROUP BY ALL
  UNION ALL
  SELECT k.user_id, k.venue_id, k.channel, min(n.sent_at) FROM kept k JOIN numbered n ON n.user_id = k.user_id AND n.venue_id = k.venue_id AND n.channel = k.channel AND n.sent_at > k.sent_at + INTERVAL 3 HOUR GROUP BY k.user_id, k.venue_id, k.channel, k.sent_at)
  SELECT user_id, venue_id, channel, count(*) AS kept FROM kept GROUP BY user_id, venue_id, channel"""
register("win_cooldown_greedy", _COOLED)(lambda d: A.cooled(d.sends(), ["user_id", "venue_id", "channel"], "sent_at", 3 * 3600).groupBy("user_id", "venue_id", "channel").agg(F.count(F.lit(1)).alias("kept")))
register("win_rank_bucket_sort", "SELECT submission_id, row_number() OVER (ORDER BY CASE status WHEN 'pending' THEN 0 WHEN 'approved' THEN 1 ELSE 2 END, created_at DESC, submission_id)::INT AS place FROM submissions")(lambda d: ranked(d.submissions(), F.when(F.col("status") == "pending", 0).when(F.col("status") == "approved", 1).otherwise(2), F.col("created_at").cast("date"), [F.desc("created_at"), F.col("submission_id")], ["submission_id"]))
register("win_ordinal_append", "SELECT photo_id, (sort_max + row_number() OVER (PARTITION BY venue_id ORDER BY photo_id))::BIGINT AS sort_order FROM (SELECT *, max(sort_order) OVER (PARTITION BY venue_id) AS sort_max FROM photos)")(lambda d: d.photos().select("photo_id", (F.max("sort_order").over(W.partitionBy("venue_id")) + F.row_number().over(W.partitionBy("venue_id").orderBy("photo_id"))).cast("long").alias("sort_order")))



def placed(d: Domain, where: Column, order: list[Column]) -> DataFrame:
    return d.campaigns().where(where).select("campaign_id", F.row_number().over(W.partitionBy("venue_id").orderBy(*order, "campaign_id")).alias("place"))


register("sort_created_desc", "SELECT campaign_id, row_number() OVER (PARTITION BY venue_id ORDER BY created_at DESC NULLS FIRST, campaign_id) AS place FROM campaigns")(lambda d: placed(d, F.lit(True), [F.desc_nulls_first("created_at")]))
register("sort_two_key", "SELECT campaign_id, row_number() OVER (PARTITION BY venue_id ORDER BY ends_at ASC NULLS LAST, campaign_id) AS place FROM campaigns")(lambda d: placed(d, F.lit(True), [F.asc_nulls_last("ends_at")]))
register("sort_live_first_then_start", f"SELECT venue_id, row_number() OVER (PARTITION BY neighborhood ORDER BY CASE WHEN {ON} THEN 0 ELSE 1 END, start_min, ordinal) AS place FROM venues")(lambda d: d.venues().select("venue_id", F.row_number().over(W.partitionBy("neighborhood").orderBy(on().desc(), "start_min", "ordinal")).alias("place")))
register("sort_by_distance", f"SELECT venue_id, row_number() OVER (PARTITION BY neighborhood ORDER BY round({_HAV}, 6), ordinal) AS place FROM venues")(lambda d: d.venues().select("venue_id", F.row_number().over(W.partitionBy("neighborhood").orderBy(F.round(geo.haversine(F.lit(32.7), F.lit(-117.1), F.col("lat"), F.col("lng")), 6), "ordinal")).alias("place")))
register("sort_compare_nulls_last", "SELECT campaign_id, row_number() OVER (PARTITION BY venue_id ORDER BY cancelled_at DESC NULLS LAST, campaign_id) AS place FROM campaigns")(lambda d: placed(d, F.lit(True), [F.desc_nulls_last("cancelled_at")]))
_U = "least(ends_at, ended_at)"
register("sort_active", f"SELECT campaign_id, row_number() OVER (PARTITION BY venue_id ORDER BY {_U} ASC NULLS LAST, starts_at ASC NULLS LAST, campaign_id) AS place FROM campaigns WHERE {state(NOW)} = 'live'")(lambda d: placed(d, campaign_state() == "live", [F.least("ends_at", "ended_at").asc_nulls_last(), F.asc_nulls_last("starts_at")]))
register("sort_scheduled", f"SELECT campaign_id, row_number() OVER (PARTITION BY venue_id ORDER BY starts_at ASC NULLS LAST, {_U} ASC NULLS LAST, campaign_id) AS place FROM campaigns WHERE {state(NOW)} = 'scheduled'")(lambda d: placed(d, campaign_state() == "scheduled", [F.asc_nulls_last("starts_at"), F.least("ends_at", "ended_at").asc_nulls_last()]))
register("sort_drafts", f"SELECT campaign_id, row_number() OVER (PARTITION BY venue_id ORDER BY updated_at DESC NULLS LAST, created_at DESC NULLS LAST, campaign_id) AS place FROM campaigns WHERE {state(NOW)} = 'draft'")(lambda d: placed(d, campaign_state() == "draft", [F.desc_nulls_last("updated_at"), F.desc_nulls_last("created_at")]))
register("sort_past", f"SELECT campaign_id, row_number() OVER (PARTITION BY venue_id ORDER BY coalesce(cancelled_at, ended_at, ends_at) DESC NULLS LAST, updated_at DESC NULLS LAST, campaign_id) AS place FROM campaigns WHERE {state(NOW)} IN ('ended', 'cancelled')")(lambda d: placed(d, campaign_state().isin("ended", "cancelled"), [F.coalesce("cancelled_at", "ended_at", "ends_at").desc_nulls_last(), F.desc_nulls_last("updated_at")]))
register("sort_docs_newest", "SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS place FROM documents")(lambda d: d.raw("documents").select("doc_id", F.row_number().over(W.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")).alias("place")))
register("limit_n", "SELECT photo_id FROM photos ORDER BY sort_order, photo_id LIMIT 50")(lambda d: d.photos().orderBy("sort_order", "photo_id").limit(50).select("photo_id"))
register("limit_n_per_key", "SELECT venue_id, photo_id, nth FROM (SELECT *, row_number() OVER (PARTITION BY venue_id ORDER BY sort_order, photo_id)::INT AS nth FROM photos) WHERE nth <= 8")(lambda d: N.smallest(d.photos(), ["venue_id"], [F.col("sort_order"), F.col("photo_id")], 8).select("venue_id", "photo_id", "nth"))
_CENTRES = "(SELECT c_custkey AS centre, 32.45::DOUBLE + (c_custkey % 53) * 0.01::DOUBLE AS y, -117.35::DOUBLE + (c_custkey % 47) * 0.01::DOUBLE AS x FROM customer)"
_APART = "(2 * 3958.7613::DOUBLE * asin(least(1.0::DOUBLE, sqrt(pow(sin(radians(lat - y) / 2), 2) + cos(radians(y)) * cos(radians(lat)) * pow(sin(radians(lng - x) / 2), 2)))))"
register("sort_by_distance_nearest", f"SELECT centre, venue_id, distance, nth FROM (SELECT *, row_number() OVER (PARTITION BY centre ORDER BY distance, venue_id)::INT AS nth FROM (SELECT centre, venue_id, round({_APART}, 6) AS distance FROM {_CENTRES}, venues)) WHERE nth <= 5")(lambda d: N.nearest(centres(d), d.venues(), "centre", 5))
register("filter_radius_join", f"SELECT centre, venue_id FROM {_CENTRES}, venues WHERE {_APART} <= 3.1")(lambda d: N.within(centres(d), d.venues(), 3.1).select("centre", "venue_id"))


def centres(d: Domain) -> DataFrame:
    """A point for each customer, in and around the venues' town."""
    k = F.col("c_custkey")
    return d.raw("customer").select(k.alias("centre"), (32.45 + (k % 53) * 0.01).alias("lat"), (-117.35 + (k % 47) * 0.01).alias("lng"))


register("set_union_priority", f"""SELECT venue_id, arg_max(title, (prio, t, id)) AS title FROM (SELECT venue_id, description AS title, 0 AS prio, updated_at AS t, 0 AS id FROM legacy UNION ALL SELECT venue_id, title, 1, ends_at, campaign_id FROM campaigns WHERE {_LIVE_SQL}) GROUP BY venue_id""")(lambda d: A.prioritised(d.legacy().select("venue_id", F.col("description").alias("title"), F.col("updated_at").alias("t"), F.lit(0).cast("long").alias("id")), S.live_campaigns(d.campaigns(), instant(CAMPAIGN_NOW)).select("venue_id", "title", F.col("ends_at").alias("t"), F.col("campaign_id").alias("id"))))
register("set_offsets", f"SELECT o_orderkey, array_to_string(list_sort(list_distinct([(epoch({local('o_orderdate - INTERVAL 1 DAY')}) - epoch(o_orderdate - INTERVAL 1 DAY))::BIGINT, (epoch({local('o_orderdate + INTERVAL 1 DAY')}) - epoch(o_orderdate + INTERVAL 1 DAY))::BIGINT])), ',') AS value FROM orders")(lambda d: d.raw("orders").select("o_orderkey", F.array_join(F.transform(F.array_sort(F.array_distinct(F.array(*[T.zone_offset(T.plus(F.col("o_orderdate"), s)) for s in (-86400, 86400)]))), lambda x: x.cast("string")), ",").alias("value")))
