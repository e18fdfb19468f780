"""Directory search: overlays, liveness, filters and the match of saved alerts with venues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidepool.functions import text as X
from tidepool.operators import nearby, products
from tidepool.sources.generations import kept


#: What an alert looks for; two alerts with the same filters are duplicates.
FILTERS = ["neighborhood", "deal_type", "feature", "days", "query"]


def overlaid(base: DataFrame, patch: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Base rows with a patch's columns laid over them; a null in the patch leaves the base, an empty text replaces it."""
    renamed = patch.select(key, *[F.col(c).alias(f"_p_{c}") for c in columns])
    joined = base.join(renamed, key, "left")
    return joined.withColumns({c: F.coalesce(f"_p_{c}", c) for c in columns}).drop(*[f"_p_{c}" for c in columns])


def redacted(campaigns: DataFrame, signed_in: Column) -> DataFrame:
    """Public columns; a code only for those who may see it, and whether there is one."""
    return campaigns.select("campaign_id", "title", F.col("deal_code").isNotNull().alias("has_code"), F.when(signed_in, F.trim("deal_code")).alias("deal_code"))


def moderation(verdict: Column) -> Column:
    """Decision on a JSON verdict: unsafe is rejected; irrelevant or unreadable is reviewed."""
    parsed = F.from_json(verdict, "safe boolean, relevant boolean")
    return F.when(~parsed.safe, "reject").when(parsed.safe & parsed.relevant, "publish").otherwise("review")


def allowance(plan: Column, allowances: dict[str, int | None]) -> Column:
    """Monthly offers of a plan; null is without limit."""
    name = X.plan_name(plan)
    out = F.lit(None).cast("int")
    for k, v in allowances.items():
        out = F.when(name == k, F.lit(v).cast("int")).otherwise(out)
    return out


def live_campaigns(campaigns: DataFrame, now: Column) -> DataFrame:
    return campaigns.where(F.col("published_at").isNotNull() & F.col("cancelled_at").isNull() & (F.col("starts_at") <= now) & (now < F.least("ends_at", "ended_at")))


def with_overrides(venues: DataFrame, overrides: DataFrame, now: Column) -> DataFrame:
    """Venues with ``overridden``: switched on by hand and not run out."""
    live = overrides.where(F.col("active") & (F.col("expires_at") > now)).select("venue_id").distinct().withColumn("overridden", F.lit(True))
    return venues.join(live, "venue_id", "left").withColumn("overridden", F.coalesce("overridden", F.lit(False)))


def haystack(*columns: str) -> Column:
    return F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]))


def all_terms(text: Column, query: str) -> Column:
    out = F.lit(True)
    for term in query.lower().split():
        out = out & text.contains(term)
    return out


def managers(sessions: DataFrame, claims: DataFrame) -> DataFrame:
    """Sessions of admins and of users with a verified claim."""
    verified = claims.where("status = 'verified'").select("user_id").distinct().withColumn("_verified", F.lit(True))
    return sessions.join(verified, "user_id", "left").where((F.col("role") == "admin") | F.col("_verified").isNotNull()).drop("_verified")


def _grams(text: Column, n: Column) -> Column:
    """Strings of ``n`` characters in a text."""
    some = F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, n))
    return F.when(F.length(text) >= n, some).otherwise(F.array().cast("array<string>"))


def by_text(kinds: DataFrame, v: DataFrame) -> DataFrame:
    """Candidates (filters, venue_id): venues whose text holds the rarest gram of each filter's query; an empty query has the empty gram, which every venue holds.

    The index has each venue under the grams of one to three characters of its text, so a query
    meets the venues of one short list, not all.
    """
    held = v.select("venue_id", F.explode(F.array_union(F.array(F.lit("")), F.concat(*[_grams(F.col("v_text"), F.lit(n)) for n in (1, 2, 3)]))).alias("_gram"))
    asked, n = F.lower("query"), F.least(F.length("query"), F.lit(3))
    mine = kinds.withColumn("_gram", F.explode(F.when(n == 0, F.array(F.lit(""))).otherwise(_grams(asked, n))))
    often = held.groupBy("_gram").agg(F.count(F.lit(1)).alias("_n"))
    rarest = mine.join(often, "_gram", "left").groupBy(*FILTERS).agg(F.min_by("_gram", F.coalesce("_n", F.lit(0))).alias("_gram"))
    return rarest.join(held, "_gram").drop("_gram")


def _kinds_matched(kinds: DataFrame, venues: DataFrame) -> DataFrame:
    """(filters, venue_id, venue_ordinal) of different filters."""
    v = venues.select("venue_id", F.col("neighborhood").alias("v_neighborhood"), F.col("days").alias("v_days"), "deal_types", "features", haystack("name", "neighborhood", "vibe").alias("v_text"), F.col("ordinal").alias("venue_ordinal") if "ordinal" in venues.columns else F.col("venue_id").alias("venue_ordinal"))
    passes = (
        ((F.size("days") == 0) | F.arrays_overlap("days", "v_days"))
        & ((F.col("deal_type") == "") | F.array_contains("deal_types", F.col("deal_type")))
        & ((F.col("feature") == "") | F.array_contains("features", F.col("feature")))
        & ((F.col("query") == "") | F.col("v_text").contains(F.lower("query")))
    )
    near = kinds.where("neighborhood <> ''").join(v, F.col("neighborhood") == F.col("v_neighborhood"))
    dealt = kinds.where("neighborhood = '' AND deal_type <> ''").join(v.withColumn("one", F.explode("deal_types")), F.col("deal_type") == F.col("one")).drop("one")
    featured = kinds.where("neighborhood = '' AND deal_type = '' AND feature <> ''").join(v.withColumn("one", F.explode("features")), F.col("feature") == F.col("one")).drop("one")
    rest = kinds.where("neighborhood = '' AND deal_type = '' AND feature = ''")
    texts = rest.where((F.size("days") == 0) | (F.col("query") != ""))
    by_query = by_text(texts, v).join(v, "venue_id")
    dated = rest.where((F.size("days") > 0) & (F.col("query") == "")).withColumn("one", F.explode("days")).join(v.withColumn("one", F.explode("v_days")), "one").drop("one").dropDuplicates([*FILTERS, "venue_id"])
    return near.unionByName(dealt).unionByName(featured).unionByName(dated).unionByName(by_query).where(passes).select(*FILTERS, "venue_id", "venue_ordinal")


def matches(alerts: DataFrame, venues: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Alerts with each venue that passes all their filters; an empty filter passes every venue. Of ``columns`` only those are told: packs carry nothing else through the product.

    Alerts with a neighbourhood meet venues by it, the others by deal type or feature if
    they have one, by the text they ask for, or by weekday. Only an alert without any filter
    meets all venues. Filters are grouped first, as far fewer differ than there are alerts.
    """
    left, right = _kinded(alerts), _kinds_kept(alerts, venues)
    if columns is None:
        return products.paired(left, right, "_kind")
    own = lambda df: df.select("_kind", *[c for c in columns if c in df.columns])
    return products.paired(own(left), own(right), "_kind").select(*columns)


def _kinds_kept(alerts: DataFrame, venues: DataFrame) -> DataFrame:
    """(_kind, venue_id, venue_ordinal) of the different filters of alerts, found once for all that use them."""
    return kept(_kinded(_kinds_matched(alerts.select(*FILTERS).distinct(), venues)).drop(*FILTERS))


def _kinded(df: DataFrame) -> DataFrame:
    """Rows with ``_kind``, a text that stands for their filters; null if a filter is, as such an alert matches nothing."""
    whole = F.lit(True)
    for c in FILTERS:
        whole = whole & F.col(c).isNotNull()
    return df.withColumn("_kind", F.when(whole, F.to_json(F.struct(*FILTERS))))


def profiled(alerts: DataFrame, venues: DataFrame, order: list[str], more: dict[str, Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """Users by what their alerts match together: (user_id, _profile, firsts, ``more``) and (_profile, venue_id, nth, venue_ordinal).

    Users whose different filters are the same, in the same order, share a profile, so a
    profile's venues are found once. ``nth`` is the place, from 0 on, of the first of these
    filters that a venue passes, and ``firsts`` has the ``order`` values of a user's first
    alert with each. Alerts that match no venue don't count, neither here nor in ``more``,
    which aggregates a user's alerts.
    """
    kinds = _kinds_kept(alerts, venues)
    known = _kinded(alerts).join(kinds.select("_kind").distinct(), "_kind", "left_semi")
    first = known.groupBy("user_id", "_kind").agg(F.min(F.struct(*order)).alias("_first"))
    users = first.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("_first", "_kind"))).alias("_all"))
    profile = F.transform("_all", lambda a: a["_kind"])
    users = kept(users.select("user_id", F.sha2(F.to_json(profile), 256).alias("_profile"), profile.alias("_kinds"), F.transform("_all", lambda a: a["_first"]).alias("firsts")))
    opened = users.groupBy("_profile").agg(F.first("_kinds").alias("_kinds")).select("_profile", F.posexplode("_kinds").alias("_nth", "_kind"))
    held = opened.join(kinds, "_kind").groupBy("_profile", "venue_id").agg(F.min(F.struct("_nth", "venue_ordinal")).alias("_place"))
    held = kept(held.select("_profile", "venue_id", F.col("_place._nth").alias("nth"), F.col("_place.venue_ordinal").alias("venue_ordinal")))
    users = users.drop("_kinds")
    if more:
        users = users.join(known.groupBy("user_id").agg(*[v.alias(c) for c, v in more.items()]), "user_id")
    return users, held


def unions(alerts: DataFrame, venues: DataFrame) -> DataFrame:
    """(user_id, venue_id, first_alert): the venues that any of a user's alerts matches, each once, with the least alert that does."""
    users, held = profiled(alerts, venues, ["alert_id"])
    found = products.paired(users, held.select("_profile", "venue_id", "nth"), "_profile")
    return found.select("user_id", "venue_id", F.col("firsts")[F.col("nth")]["alert_id"].alias("first_alert"))


def match_counts(alerts: DataFrame, venues: DataFrame, first: int = 12) -> DataFrame:
    """(alert_id, n, first) of alerts that match any venue: how many, and the ``first`` smallest ids in order.

    Counted once for different filters, and no task holds more than ``first`` ids of one.
    """
    matched = _kinds_matched(alerts.select(*FILTERS).distinct(), venues)
    few = nearby.smallest(matched, FILTERS, [F.col("venue_id")], first).groupBy(*FILTERS).agg(F.array_sort(F.collect_list("venue_id")).alias("first"))
    counts = matched.groupBy(*FILTERS).agg(F.count(F.lit(1)).alias("n")).join(few, FILTERS)
    return alerts.join(counts, FILTERS).select("alert_id", "n", "first")


def recipients(campaigns: DataFrame, follows: DataFrame, alerts: DataFrame, venues: DataFrame) -> DataFrame:
    """(campaign_id, user_id): who follows a campaign's venue, and whose alert for offers matches it; each once.

    Campaigns meet profiles of alerts, not users, and only followers are compared with what
    their own alerts give; nothing of the size of the result is shuffled or made distinct.
    """
    offers = campaigns.select("campaign_id", "venue_id").distinct()
    wanted = alerts.where(F.col("active") & F.array_contains("kinds", "promotion"))
    users, held = profiled(wanted, venues.join(offers.select("venue_id"), "venue_id", "left_semi"), ["alert_id"])
    users = users.select("user_id", "_profile")
    offered = held.join(offers, "venue_id").select("_profile", "campaign_id").distinct()
    followers = follows.where("promotion").select("venue_id", "user_id").join(offers, "venue_id").select("campaign_id", "user_id").distinct()
    others = followers.join(users, "user_id", "left").join(offered, ["_profile", "campaign_id"], "left_anti")
    return products.paired(users, offered, "_profile").select("campaign_id", "user_id").unionByName(others.select("campaign_id", "user_id"))


def by_slug(mentions: DataFrame, venues: DataFrame) -> DataFrame:
    """(doc_id, venue_id) for mentions (doc_id, slug) of venues by the slug of their name."""
    return mentions.join(venues.select("venue_id", X.slugify(F.col("name")).alias("slug")), "slug").select("doc_id", "venue_id")


def cloned(alerts: DataFrame, existing: DataFrame, user: Column) -> DataFrame:
    """Copies of alerts for another user, by mail only; where that user has an alert with the same filters there is none."""
    copies = alerts.withColumn("user_id", user).withColumn("channel_email", F.lit(True)).withColumn("channel_text", F.lit(False))
    return copies.join(existing.select("user_id", *FILTERS).distinct(), ["user_id", *FILTERS], "left_anti")
