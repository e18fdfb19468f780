"""The domain's tables, derived from the stored star schema by fixed arithmetic.

k is a row's key. Stored keys begin at 0 and ids at 1, so an id is k + 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidepool.sources.tables import table

#: Weekdays, deal types, features and types of campaigns, in canonical order.
DAYS = ["Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday"]
DEAL_TYPES = ["drinks", "food", "bottles"]
FEATURES = ["patio", "dog-friendly", "late-night", "live-music"]
KINDS = ["special_deal", "extended_happy_hour", "event", "other"]
#: "Now" of queries over campaigns, and over the log of sends.
CAMPAIGN_NOW, LOG_NOW = "1998-06-15 20:00:00", "2024-01-15 20:00:00"
ZONE = "America/Los_Angeles"


def instant(text: str) -> Column:
    return F.lit(text).cast("timestamp")


def picked(values: list[str], k: Column, keep) -> Column:
    """The values whose index i passes keep(k + i)."""
    return F.filter(F.array(*map(F.lit, values)), lambda v: keep(k + F.array_position(F.array(*map(F.lit, values)), v) - 1))


def clock(minutes: Column) -> Column:
    return F.concat_ws(":", F.lpad(F.floor(minutes / 60).cast("string"), 2, "0"), F.lpad((minutes % 60).cast("string"), 2, "0"))


class Domain:
    """Views over one folder of stored tables; nothing is read until a query runs."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def raw(self, name: str) -> DataFrame:
        return table(self.spark, self.folder, name)

    def venues(self) -> DataFrame:
        k = F.col("s_suppkey")
        nation = self.raw("nation").select("n_nationkey", "n_name")
        df = self.raw("supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        start = 840 + 30 * (k % 10)
        return df.select(
            (k + 1).alias("venue_id"), F.concat("s_name", F.lit(" & "), "n_name").alias("name"), F.col("n_name").alias("neighborhood"),
            (32.5 + (k % 50) * 0.01).alias("lat"), (-117.3 + (k % 40) * 0.01).alias("lng"),
            picked(DAYS, k, lambda x: x % 3 != 0).alias("days"), start.alias("start_min"), (start + 60 + 30 * (k % 5)).alias("end_min"),
            picked(DEAL_TYPES, k, lambda x: x % 3 == 0).alias("deal_types"), picked(FEATURES, k, lambda x: x % 3 == 0).alias("features"),
            (F.col("s_acctbal") > 0).alias("verified"), F.when(k % 7 == 0, "").otherwise(F.concat(F.lit("/api/images/v"), k.cast("string"))).alias("image"),
            F.when(k % 2 == 0, "wine bar").when(k % 3 == 0, "dive bar").otherwise("").alias("vibe"), F.col("s_acctbal").alias("balance"), k.alias("ordinal"),
        )

    def venue_patches(self) -> DataFrame:
        """Owner edits of every fourth venue: new hours, and a phone cleared on purpose."""
        k = F.col("s_suppkey")
        return self.raw("supplier").where(k % 4 == 0).select((k + 1).alias("venue_id"), F.lit(900).cast("long").alias("start_min"), F.lit(1080).cast("long").alias("end_min"), F.lit("").alias("phone"), F.when(k % 8 == 0, F.concat(F.lit("Renamed "), k.cast("string"))).alias("name"))

    def users(self) -> DataFrame:
        k = F.col("c_custkey")
        return self.raw("customer").select((k + 1).alias("user_id"), F.col("c_name").alias("name"), F.concat(F.lower("c_name"), F.lit("@example.test")).alias("email"), F.when(k % 5 == 0, "").otherwise(F.concat(F.lit("+1 (619) 555-"), F.lpad((k % 10000).cast("string"), 4, "0"))).alias("phone"), F.when(F.col("c_acctbal") > 0, instant("1998-01-01 00:00:00")).alias("consent_at"), F.when(k % 3 == 0, "paid").otherwise("free").alias("plan"), F.when(k % 4 == 0, F.concat(F.lit("g"), k.cast("string"))).alias("google_id"), F.when(k % 4 != 1, F.concat(F.lit("h"), k.cast("string"))).alias("password_hash"), F.concat(F.lit("s"), k.cast("string")).alias("share_id"), F.col("c_nationkey").alias("nation"))

    def alerts(self) -> DataFrame:
        """Two saved alerts of every user."""
        k, j = F.col("c_custkey"), F.col("j")
        nation = self.raw("nation").select("n_nationkey", "n_name")
        df = self.raw("customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).withColumn("j", F.explode(F.array(F.lit(1), F.lit(2))))
        pick = (k + j) % 4
        return df.select(
            (2 * k + j).alias("alert_id"), (k + 1).alias("user_id"), F.concat(F.lit("alert "), j.cast("string")).alias("name"), F.when(j == 1, F.col("n_name")).otherwise("").alias("neighborhood"),
            F.when(pick == 0, "").when(pick == 1, DEAL_TYPES[0]).when(pick == 2, DEAL_TYPES[1]).otherwise(DEAL_TYPES[2]).alias("deal_type"), F.when(k % 6 == 5, FEATURES[1]).otherwise("").alias("feature"),
            F.when(k % 2 == 0, F.array().cast("array<string>")).otherwise(picked(DAYS, k, lambda x: x % 2 == 0)).alias("days"), F.when(k % 9 == 4, "supplier#00000000").otherwise("").alias("query"),
            (k % 4 != 1).alias("channel_email"), (k % 3 == 0).alias("channel_text"),
            F.when(k % 3 == 0, F.array(F.lit("happy_hour"))).when(k % 3 == 1, F.array(F.lit("promotion"))).otherwise(F.array(F.lit("happy_hour"), F.lit("promotion"))).alias("kinds"),
            (k % 10 != 9).alias("active"), F.timestamp_seconds(F.unix_seconds(instant("1998-01-01 00:00:00")) + k * 60).alias("created_at"),
        )

    def campaigns(self) -> DataFrame:
        k = F.col("o_orderkey")
        n = self.raw("supplier").agg(F.count(F.lit(1)).alias("n"))
        df = self.raw("orders").crossJoin(F.broadcast(n))  # one row
        starts = F.timestamp_seconds(F.unix_seconds(instant("1998-06-01 00:00:00")) + (k * 7 % 720) * 3600)
        shift = lambda seconds: F.timestamp_seconds(F.unix_seconds(starts) + seconds)
        return df.select(
            (k + 1).alias("campaign_id"), (F.col("o_custkey") % F.col("n") + 1).alias("venue_id"), starts.alias("starts_at"), shift((1 + k % 8) * 3600).alias("ends_at"),
            F.when(F.col("o_orderstatus") != "P", shift(-86400)).alias("published_at"), F.when(k % 11 == 0, shift(-7200)).alias("cancelled_at"), F.when(k % 7 == 0, shift(1800)).alias("ended_at"),
            F.when(k % 4 == 0, KINDS[0]).when(k % 4 == 1, KINDS[1]).when(k % 4 == 2, KINDS[2]).otherwise(KINDS[3]).alias("type"), F.when(k % 13 == 0, "").otherwise(F.concat(F.lit("Offer "), k.cast("string"))).alias("title"),
            F.concat(F.lit("Deal of order "), k.cast("string")).alias("description"), F.when(k % 3 == 0, F.concat(F.lit(" CODE"), k.cast("string"))).alias("deal_code"),
            F.col("o_orderdate").alias("created_at"), shift(-3600 * (k % 5)).alias("updated_at"), F.when(k % 17 == 0, F.col("o_custkey") % F.col("n") + 1).alias("legacy_venue_id"), (F.col("o_custkey") + 1).alias("created_by"),
        )

    def overrides(self) -> DataFrame:
        """Venues switched on by hand; times around the campaigns' now."""
        return self.overrides_of(self.raw("supplier"))

    def overrides_of(self, suppliers: DataFrame) -> DataFrame:
        """The same of suppliers, stored or streaming."""
        k = F.col("s_suppkey")
        now = F.unix_seconds(instant(CAMPAIGN_NOW))
        return suppliers.where(k % 5 == 0).select((k + 1).alias("venue_id"), (k % 10 != 5).alias("active"), F.timestamp_seconds(now - 3600).alias("since"), F.timestamp_seconds(now + (k % 7 - 2) * 3600).alias("expires_at"))

    def sends(self) -> DataFrame:
        return self.stream_of_sends(self.raw("events"))

    def stream_of_sends(self, events: DataFrame) -> DataFrame:
        """The log of sends from events, stored or streaming."""
        n = self.raw("supplier").agg(F.count(F.lit(1)).alias("n"))
        df = events.crossJoin(F.broadcast(n))  # one row
        return df.select(F.col("event_id").alias("send_id"), (F.col("user_id") + 1).alias("user_id"), (F.col("event_id") % F.col("n") + 1).alias("venue_id"), F.when(F.col("event_type").isin("view", "click"), "email").otherwise("text").alias("channel"), F.col("ts").cast("timestamp").alias("sent_at"))

    def follows(self) -> DataFrame:
        k = F.col("c_custkey")
        n = self.raw("supplier").agg(F.count(F.lit(1)).alias("n"))
        return self.raw("customer").where(k % 3 == 0).crossJoin(F.broadcast(n)).select((k + 1).alias("user_id"), (k % F.col("n") + 1).alias("venue_id"), (k % 2 == 0).alias("happy_hour"), (k % 4 != 0).alias("promotion"), F.lit(True).alias("channel_email"), (k % 2 == 1).alias("channel_text"))

    def claims(self) -> DataFrame:
        """A claim of every fourth user on a venue; several users may claim one."""
        k = F.col("c_custkey")
        n = self.raw("supplier").agg(F.count(F.lit(1)).alias("n"))
        return self.raw("customer").where(k % 4 == 0).crossJoin(F.broadcast(n)).select((k + 1).alias("claim_id"), (k + 1).alias("user_id"), (k % F.col("n") + 1).alias("venue_id"), F.when(k % 3 == 0, "verified").when(k % 3 == 1, "pending").otherwise("denied").alias("status"), F.when(k % 8 == 0, "Pro").when(k % 8 == 4, " founding-partner").otherwise("free").alias("plan"), F.lpad((k * 7919 % 1000000).cast("string"), 6, "0").alias("phone_code"), F.timestamp_seconds(F.unix_seconds(instant(CAMPAIGN_NOW)) + (k % 9 - 4) * 300).alias("code_expires_at"), F.when(k % 2 == 0, "").otherwise("I manage it").alias("note"))

    def sections(self) -> DataFrame:
        k = F.col("p_partkey")
        n = self.raw("supplier").agg(F.count(F.lit(1)).alias("n"))
        return self.raw("part").crossJoin(F.broadcast(n)).select((k + 1).alias("section_id"), (k % F.col("n") + 1).alias("venue_id"), F.col("p_type").alias("title"), (k % 5).cast("int").alias("sort_order"))

    def items(self) -> DataFrame:
        """Menu items; sections whose key is divisible by seven have none."""
        df = self.raw("lineitem").where(F.col("l_partkey") % 7 != 0)
        return df.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("item_id"), (F.col("l_partkey") + 1).alias("section_id"), F.concat(F.lit("item "), F.col("l_orderkey").cast("string")).alias("name"), F.col("l_extendedprice").cast("string").alias("price"), F.when(F.col("l_linenumber") == 1, F.col("l_suppkey") + 1).alias("photo_id"), F.col("l_linenumber").alias("sort_order"), F.col("l_shipdate").alias("created_at"))

    def photos(self) -> DataFrame:
        k = F.col("p_partkey")
        n = self.raw("supplier").agg(F.count(F.lit(1)).alias("n"))
        return self.raw("part").crossJoin(F.broadcast(n)).select((k + 1).alias("photo_id"), (k % F.col("n") + 1).alias("venue_id"), F.concat(F.lit("img"), (k % 37).cast("string")).alias("image_key"), F.when(k % 5 == 0, "rejected").when(k % 5 == 1, "pending").otherwise("published").alias("status"), F.col("p_name").alias("caption"), (k % 11).cast("int").alias("sort_order"), F.when(k % 2 == 0, "gallery").otherwise("menu").alias("photo_type"))

    def legacy(self) -> DataFrame:
        """Single-slot offers from before campaigns."""
        k = F.col("s_suppkey")
        return self.raw("supplier").where(k % 6 == 0).select((k + 1).alias("venue_id"), F.concat(F.lit("OLD"), k.cast("string")).alias("deal_code"), F.concat(F.lit("old offer "), k.cast("string")).alias("description"), F.timestamp_seconds(F.unix_seconds(instant("1998-05-01 00:00:00")) + k * 3600).alias("updated_at"))

    def sessions(self) -> DataFrame:
        k = F.col("c_custkey")
        return self.raw("customer").select(F.concat(F.lit("t"), k.cast("string")).alias("session_id"), (k + 1).alias("user_id"), F.when(k % 50 == 0, "admin").otherwise("user").alias("role"), F.timestamp_seconds(F.unix_seconds(instant(CAMPAIGN_NOW)) + (k % 13 - 6) * 3600).alias("expires_at"))

    def submissions(self) -> DataFrame:
        k = F.col("c_custkey")
        return self.raw("customer").where(k % 10 == 3).select((k + 1).alias("submission_id"), F.when(k % 3 == 0, "pending").when(k % 3 == 1, "approved").otherwise("denied").alias("status"), F.col("c_name").alias("contact_name"), F.concat(F.lower("c_name"), F.lit("@example.test")).alias("contact_email"), F.lit("").alias("contact_notes"), F.timestamp_seconds(F.unix_seconds(instant("1998-04-01 00:00:00")) + (k * 37 % 1000) * 3600).alias("created_at"))

    def saved(self) -> DataFrame:
        k = F.col("c_custkey")
        n = self.raw("supplier").agg(F.count(F.lit(1)).alias("n"))
        return self.raw("customer").where(k % 2 == 0).crossJoin(F.broadcast(n)).select((k + 1).alias("user_id"), (k * 3 % (F.col("n") + 5) + 1).alias("venue_id"), F.when(k % 6 == 0, "favorite").when(k % 6 == 2, "been_to").otherwise("want_to_go").alias("status"), F.concat(F.lit("note "), k.cast("string")).alias("note"), F.when(k % 7 < 6, (k % 7).cast("int")).alias("rating"))
