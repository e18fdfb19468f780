"""Alert dispatch: one tick from saved alerts to an outbox; ``streaming.dispatch`` has its form over time.

One tick: the live venues, alerts that match them, one digest for each user and channel,
without venues that were sent within the cooldown, and without texts once the day's cap
is reached. If any matching alert of a user wants mail, the mail lists all venues that
any of the user's alerts matched; the same holds for texts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tidepool.functions import temporal as T, text as X
from tidepool.operators import products, search
from tidepool.sources.generations import kept


@dataclass(frozen=True)
class Rules:
    """Seconds of the cooldown, texts a day, the day's zone, days that the log is kept."""

    cooldown: int = 3 * 3600
    cap: int = 2
    cap_zone: str = "UTC"
    retention: int = 7 * 86400


def live_venues(venues: DataFrame, overrides: DataFrame, now: Column) -> DataFrame:
    return search.with_overrides(venues, overrides, now).where(F.col("overridden") | T.schedule_live(now, F.col("days"), F.col("start_min"), F.col("end_min")))


@dataclass(frozen=True)
class Due:
    """What one run sends, by profile: nothing here is of the size of the sends.

    ``digests`` (user_id, channel, _profile, firsts, _left_out, n): n venues, those of the
    profile but the ones in ``_left_out`` (null: none). ``held`` (_profile, venue_id, nth,
    venue_ordinal): see ``search.profiled``.
    """

    digests: DataFrame
    held: DataFrame

    def sends(self) -> DataFrame:
        """(user_id, channel, venue_id, place), each send once; place is that of the first match, by alert, then venue."""
        mine = self.digests.select("_profile", "user_id", "channel", "firsts", "_left_out")
        found = products.paired(mine, self.held, "_profile").where(F.col("_left_out").isNull() | ~F.array_contains("_left_out", F.col("venue_id")))
        first = F.col("firsts")[F.col("nth")]
        return found.select("user_id", "channel", "venue_id", F.struct(first["created_at"].alias("created_at"), first["alert_id"].alias("alert_id"), "venue_ordinal").alias("place"))

    def addressed(self, users: DataFrame) -> DataFrame:
        """(user_id, channel, address, n)."""
        return self.digests.join(users.select("user_id", "email", "phone"), "user_id").select("user_id", "channel", _address(), "n")

    def subjects(self, venues: DataFrame) -> DataFrame:
        """(user_id, channel, subject): only a digest of one venue needs its name."""
        single = self.digests.where("n = 1").select("user_id", "channel", "_profile", "_left_out").join(self.held.select("_profile", "venue_id"), "_profile")
        single = single.where(F.col("_left_out").isNull() | ~F.array_contains("_left_out", F.col("venue_id"))).join(venues.select("venue_id", "name"), "venue_id")
        several = self.digests.where("n > 1").select("user_id", "channel", _subject(F.col("n"), F.lit(None).cast("string")).alias("subject"))
        return several.unionByName(single.select("user_id", "channel", _subject(F.lit(1), F.col("name")).alias("subject")))

    def outbox(self, users: DataFrame, venues: DataFrame, link: str = "", site: str = "") -> DataFrame:
        """What ``outbox`` gives for the sends; a profile's lines are collected once, and joined to packs of its users."""
        to = self.digests.select("user_id", "channel", "_profile", "_left_out").join(users.select("user_id", F.col("name").alias("user_name"), "email", "phone"), "user_id")
        return written(to, self.held, lined(venues), "_profile", link, site)


def wanted(alerts: DataFrame, users: DataFrame, live: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Who could be told of what, whatever was sent before: (user_id, channel, _profile, firsts) and the profiles' venues, see ``search.profiled``."""
    eligible = alerts.where(F.col("active") & F.array_contains("kinds", "happy_hour")).join(users.select("user_id", "phone", "consent_at"), "user_id")
    eligible = eligible.where(F.col("channel_email") | (F.col("channel_text") & F.col("consent_at").isNotNull()))
    texts = (F.trim("phone") != "") & F.col("consent_at").isNotNull()
    wants = {"wants_email": F.bool_or("channel_email"), "wants_text": F.bool_or(F.col("channel_text") & texts)}
    per_user, held = search.profiled(eligible, live, ["created_at", "alert_id"], wants)
    both = per_user.withColumn("channel", F.explode(F.filter(F.array(F.when(F.col("wants_email"), "email"), F.when(F.col("wants_text"), "text")), lambda c: c.isNotNull()))).drop("wants_email", "wants_text")
    return both, held


def capped(both: DataFrame, log: DataFrame, now: Column, rules: Rules) -> DataFrame:
    """Rows (user_id, channel, ...) without texts to users who had the day's number of them; log is (user_id, channel, sent_at)."""
    today = T.day_start(T.local(now, rules.cap_zone).cast("date"), rules.cap_zone)
    sent = log.where((F.col("channel") == "text") & (F.col("sent_at") >= today) & (F.col("sent_at") <= now)).groupBy("user_id").agg(F.countDistinct("sent_at").alias("texts"))
    return both.join(sent, "user_id", "left").where((F.col("channel") != "text") | (F.coalesce("texts", F.lit(0)) < rules.cap)).drop("texts")


def within_cooldown(now: Column, rules: Rules) -> Column:
    return (F.col("sent_at") >= T.plus(now, -rules.cooldown)) & (F.col("sent_at") <= now)


def due(alerts: DataFrame, users: DataFrame, venues: DataFrame, overrides: DataFrame, log: DataFrame, now: Column, rules: Rules = Rules()) -> Due:
    """One run; log is (user_id, venue_id, channel, sent_at)."""
    both, held = wanted(alerts, users, live_venues(venues, overrides, now))
    recent = log.where(within_cooldown(now, rules)).select("user_id", "venue_id", "channel").distinct()
    asked = capped(both, log, now, rules)
    out = asked.select("user_id", "channel", "_profile").join(recent, ["user_id", "channel"]).join(held.select("_profile", "venue_id"), ["_profile", "venue_id"])
    out = out.groupBy("user_id", "channel").agg(F.collect_list("venue_id").alias("_left_out"))
    counts = held.groupBy("_profile").agg(F.count(F.lit(1)).cast("int").alias("_held"))
    told = asked.join(out, ["user_id", "channel"], "left").join(counts, "_profile")
    n = F.when(F.col("_left_out").isNull(), F.col("_held")).otherwise(F.col("_held") - F.size("_left_out"))
    return Due(kept(told.withColumn("n", n).where("n > 0").drop("_held")), held)


def tick(alerts: DataFrame, users: DataFrame, venues: DataFrame, overrides: DataFrame, log: DataFrame, now: Column, rules: Rules = Rules()) -> DataFrame:
    """(user_id, channel, venue_id, place): what one run sends; log is (user_id, venue_id, channel, sent_at)."""
    return due(alerts, users, venues, overrides, log, now, rules).sends()


def _address() -> Column:
    return F.when(F.col("channel") == "email", F.col("email")).otherwise(F.col("phone")).alias("address")


def _subject(n: Column, name: Column) -> Column:
    return F.when(n == 1, F.concat(name, F.lit(" is live now"))).otherwise(F.concat(n.cast("string"), F.lit(" places are live now")))


def outbox(sends: DataFrame, users: DataFrame, venues: DataFrame, link: str = "", site: str = "") -> DataFrame:
    """(user_id, channel, address, subject, body, n): one digest for each user and channel. Nothing is delivered here; a sender reads this table.

    venues: (venue_id, name, neighborhood, start_min, end_min, deals). A mail lists every
    venue with its hours and first two deals and ends with ``link``, a text the first three
    names and ``site``.
    """
    named = sends.join(lined(venues), "venue_id")
    digest = named.groupBy("user_id", "channel").agg(F.array_sort(F.collect_list(F.struct("place", "venue_id", "name", "line"))).alias("venues"))
    return _written(digest.join(users.select("user_id", F.col("name").alias("user_name"), "email", "phone"), "user_id"), link, site)


def lined(venues: DataFrame) -> DataFrame:
    """(venue_id, name, line): a venue's line in a mail."""
    clock = lambda minutes: X.format_time(F.concat_ws(":", F.lpad((F.floor(minutes / 60) % 24).cast("string"), 2, "0"), F.lpad((minutes % 60).cast("string"), 2, "0")))
    hours = F.concat(clock(F.col("start_min")), F.lit("–"), clock(F.col("end_min")))
    # fixed values: the sentences of mails and texts
    line = F.concat(F.lit("<li><strong>"), X.escape_html(F.col("name")), F.lit("</strong> — "), X.escape_html(F.col("neighborhood")), F.lit(" — "), hours, F.lit(". "), X.escape_html(F.array_join(F.slice("deals", 1, 2), ", ")), F.lit("</li>"))
    return venues.select("venue_id", "name", line.alias("line"))


def written(to: DataFrame, held: DataFrame, lines: DataFrame, key: str, link: str, site: str) -> DataFrame:
    """``_written`` for users ``to`` (``key``, user_id, channel, _left_out, user_name, email, phone, and maybe ``_added``, venues with their lines besides those of the key) by the venues that their key holds.

    A key's lines are collected once, and joined to packs of its users. A key that holds nothing counts only for what is added.
    """
    lists = held.join(lines, "venue_id").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("nth", "venue_ordinal", "venue_id", "name", "line"))).alias("venues"))
    packs = products.packed(to, key, "_to", pack=256)
    added = "_added" in to.columns
    # the lambda keeps the users of a pack, each with all its venues, from being made at once, see products.paired
    both = packs.join(lists, key, "left" if added else "inner").select(F.inline(F.transform("_to", lambda u: u)), "venues")
    left = F.filter("venues", lambda v: ~F.array_contains("_left_out", v["venue_id"]))
    both = both.withColumn("venues", F.when(F.col("_left_out").isNull(), F.col("venues")).otherwise(left))
    if added:
        none = F.array().cast(lists.schema["venues"].dataType)
        both = both.withColumn("venues", F.when(F.col("_added").isNull(), F.col("venues")).otherwise(F.array_sort(F.concat(F.coalesce("venues", none), "_added"))))
    return _written(both, link, site)


def _written(digest: DataFrame, link: str, site: str) -> DataFrame:
    """Digests of (user_id, channel, venues in order, user_name, email, phone)."""
    names = F.transform("venues", lambda v: v["name"])
    n = F.size("venues")
    foot = f'<p><a href="{link}">Manage your alerts</a></p>' if link else ""
    mail = F.concat(F.lit("<p>Hi "), X.escape_html(F.coalesce("user_name", F.lit(""))), F.lit(",</p><p>These happy hours from your alerts are live right now:</p><ul>"), F.array_join(F.transform("venues", lambda v: v["line"]), ""), F.lit("</ul>" + foot))
    body = F.when(F.col("channel") == "email", mail).otherwise(F.concat(F.lit("Live now: "), X.overflow_label(names), F.lit(f". {site}" if site else "")))
    return digest.select("user_id", "channel", _address(), _subject(n, names[0]).alias("subject"), body.alias("body"), n.alias("n"))


def logged(sends: DataFrame, now: Column) -> DataFrame:
    """Rows for the log; all sends of a run share one time."""
    return sends.select("user_id", "venue_id", "channel", now.alias("sent_at"))


def pruned(log: DataFrame, now: Column, rules: Rules = Rules()) -> DataFrame:
    return log.where(F.col("sent_at") >= T.plus(now, -rules.retention))


def summary(sends: DataFrame, live: DataFrame) -> DataFrame:
    """One row: live venues, users reached, mails and texts; of sends, or of one row for each digest."""
    users = sends.agg(F.countDistinct("user_id").alias("users"), F.countDistinct(F.when(F.col("channel") == "email", F.col("user_id"))).alias("emails"), F.countDistinct(F.when(F.col("channel") == "text", F.col("user_id"))).alias("texts"))
    return live.agg(F.count(F.lit(1)).alias("live_venues")).crossJoin(users)  # one row each
