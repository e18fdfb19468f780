"""What people ask for in batches: claims of venues, reviews of submitted listings, settings of follows.

Each function takes a batch and the stored tables and gives (outcomes, next snapshots).
``seq`` is a request's place in its batch and unique. What an earlier request of the batch
did counts for the later ones, as if they were handled one by one. No request is dropped:
one that can't be done has an outcome that says why.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidepool.functions import text as X
from tidepool.operators import integrity, mutations

#: Most characters of a claim's note that are kept.
NOTE = 1000
CLAIM = ["user_id", "venue_id", "status", "method", "note"]
#: Columns of a listing, as the rules of integrity take them.
LISTING = ["name", "neighborhood", "address", "phone", "website", "source_url", "days", "start_time", "end_time", "deals", "vibe", "lat", "lng", "image"]
#: Columns of a follow with their defaults.
FOLLOW = {"happy_hour": False, "promotion": True, "channel_email": True, "channel_text": False}


def claimed(requests: DataFrame, claims: DataFrame, users: DataFrame, venues: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Claims (seq, user_id, venue_id, note) of users (user_id, email) on venues (venue_id, website); ``claims`` holds CLAIM, one row for a user and venue.

    Outcomes: not_found (no such user or venue), unchanged (the user's claim is verified),
    conflict (verified for someone else, and the user's mail is the venue's domain too),
    verified (by domain), manual (pending, a person reads the note), pending (a bare new
    claim), kept (there is a claim already). A venue verified once stays with the first,
    whoever asks later. ``created`` tells new claims from changed ones. Gives (outcomes,
    next claims).
    """
    mail, site = X.extract_domain(F.col("email")), X.extract_domain(F.col("website"))
    asked = requests.join(users.select("user_id", "email", F.lit(True).alias("_user")), "user_id", "left").join(venues.select("venue_id", "website", F.lit(True).alias("_venue")), "venue_id", "left")
    asked = asked.withColumn("_found", F.col("_venue").isNotNull() & F.col("_user").isNotNull()).withColumn("_same", F.col("_found") & (mail != "") & F.coalesce(mail == site, F.lit(False)))
    asked = asked.withColumn("note", F.substring(X.clean(F.col("note")), 1, NOTE))
    own = claims.select("user_id", "venue_id", F.col("status").alias("_status"))
    verified = claims.where("status = 'verified'").groupBy("venue_id").agg(F.min("user_id").alias("_low"), F.max("user_id").alias("_high"))
    asked = asked.join(own, ["user_id", "venue_id"], "left").join(verified, "venue_id", "left")
    free = F.col("_same") & F.col("_low").isNull()
    first = asked.where(free).groupBy("venue_id").agg(F.min(F.struct("seq", "user_id")).alias("_first"))
    pairs = asked.where("_found").groupBy("user_id", "venue_id").agg(F.min("seq").alias("_begin"))
    asked = asked.join(first, "venue_id", "left").join(pairs, ["user_id", "venue_id"], "left")
    mine = F.col("_first.user_id") == F.col("user_id")
    other = F.col("_low").isNotNull() | ~F.coalesce(mine, F.lit(False))
    outcome = (
        F.when(~F.col("_found"), "not_found").when(F.col("_status") == "verified", "unchanged")
        .when(F.col("_same") & other, "conflict").when(F.col("_same") & (F.col("seq") == F.col("_first.seq")), "verified").when(F.col("_same"), "unchanged")
        .when(F.col("note") != "", "manual").when(F.col("_status").isNull() & (F.col("seq") == F.col("_begin")), "pending").otherwise("kept")
    )
    asked = asked.withColumn("outcome", outcome)
    created = F.col("_status").isNull() & (F.col("seq") == F.col("_begin")) & F.col("outcome").isin("verified", "manual", "pending")
    outcomes = asked.select("seq", "user_id", "venue_id", "outcome", created.alias("created"))
    done = asked.where(F.col("outcome").isin("verified", "manual", "pending")).groupBy("user_id", "venue_id").agg(
        F.bool_or(F.col("outcome") == "verified").alias("_verified"), F.max_by("note", F.when(F.col("outcome") == "manual", F.col("seq"))).alias("_note"), F.bool_or(F.col("outcome") == "manual").alias("_manual")
    )
    new = done.select(
        "user_id", "venue_id", F.when(F.col("_verified"), "verified").otherwise("pending").alias("status"), F.when(F.col("_verified"), "domain").when(F.col("_manual"), "manual").alias("method"), F.when(F.col("_manual"), F.col("_note")).alias("note"),
    )
    return outcomes, mutations.upsert(claims.select(*CLAIM), new, ["user_id", "venue_id"], choose={"note": F.coalesce(F.col("s.note"), F.col("t.note"))})


def _before(value: Column, order: W) -> Column:
    """The last value that isn't null of the rows before this one."""
    return F.last(value, ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, -1))


def reviewed(commands: DataFrame, submissions: DataFrame, catalogue: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Reviews (seq, submission_id, action, reason, and LISTING) of submissions (submission_id, status, denial_reason, published_id, and LISTING), with effect on the catalogue (venue_id and LISTING).

    ``deny`` notes the reason. ``edit`` and ``approve`` lay the listing over the stored one;
    a command without a name has no listing and means the one that is stored when the batch
    begins. A listing that breaks a rule is refused (invalid); approving, and editing what
    is approved, also needs coordinates. Approving publishes a new venue; approving or
    editing what is published already changes that venue, so approving twice makes one.
    Approving what was denied in between publishes again. Outcomes: not_found, bad_action,
    denied, invalid, edited, published, updated. A submission's commands are read in order
    as a stream of one task. Gives (outcomes with status and venue_id, next submissions,
    next catalogue).
    """
    stored = submissions.select("submission_id", F.col("status").alias("_status"), F.col("published_id").alias("_published"), F.struct(*LISTING).alias("_listing"))
    given = F.when(F.col("name").isNotNull(), F.struct(*LISTING))
    asked = commands.withColumn("_given", given).drop(*LISTING).join(stored, "submission_id", "left")
    asked = asked.withColumn("_listing", F.coalesce("_given", "_listing")).select("seq", "submission_id", "action", "reason", "_status", "_published", "_listing", "_listing.*")
    asked = asked.withColumn("_bad", F.size(integrity.listing_errors()) > 0).withColumn("_placed", F.col("lat").isNotNull() & F.col("lng").isNotNull()).drop(*LISTING)
    order = W.partitionBy("submission_id").orderBy("seq")
    approves = (F.col("action") == "approve") & ~F.col("_bad") & F.col("_placed")
    after = F.when(F.col("_status").isNotNull(), F.when(F.col("action") == "deny", "denied").when(approves, "approved"))
    asked = asked.withColumn("_after", after)
    asked = asked.withColumn("_is", F.coalesce(_before(F.col("_after"), order), "_status"))
    approved_before = _before(F.when(F.col("_after") == "approved", True), order).isNotNull()
    known = (F.col("_is") == "approved") & (F.col("_published").isNotNull() | approved_before)
    refused = F.col("_bad") | (~F.col("_placed") & ((F.col("action") == "approve") | (F.col("_is") == "approved")))
    outcome = (
        F.when(F.col("_status").isNull(), "not_found").when(F.col("action") == "deny", "denied").when(~F.coalesce(F.col("action").isin("edit", "approve"), F.lit(False)), "bad_action")
        .when(refused, "invalid").when(known, "updated").when(F.col("action") == "approve", "published").otherwise("edited")
    )
    judged = asked.withColumn("outcome", outcome)
    new = mutations.numbered(catalogue.select("venue_id"), judged.where("outcome = 'published'").select("seq"), "venue_id", "seq")
    judged = judged.join(new, "seq", "left")
    own = F.when(F.col("outcome").isin("published", "updated"), F.coalesce("venue_id", _before(F.col("venue_id"), order), "_published"))
    judged = judged.withColumn("status", F.coalesce("_after", "_is")).withColumn("_own", own)
    accepted = F.when(F.col("outcome").isin("published", "updated", "edited"), F.col("seq"))
    last = judged.where("_status IS NOT NULL").groupBy("submission_id").agg(
        F.max_by("status", "seq").alias("status"), F.max_by("reason", F.when(F.col("outcome") == "denied", F.col("seq"))).alias("denial_reason"), F.bool_or(F.col("outcome") == "denied").alias("_denied"),
        F.max_by("_own", F.when(F.col("outcome") == "published", F.col("seq"))).alias("published_id"), F.max_by("_listing", accepted).alias("_listing"),
    )
    laid = {c: F.when(F.col("s._listing").isNotNull(), F.col(f"s._listing.{c}")).otherwise(F.col(f"t.{c}")) for c in LISTING}
    kept = {"denial_reason": F.when(F.col("s._denied"), F.col("s.denial_reason")).otherwise(F.col("t.denial_reason")), "published_id": F.coalesce(F.col("s.published_id"), F.col("t.published_id"))}
    next_submissions = mutations.upsert(submissions, last, ["submission_id"], choose={**laid, **kept})
    shown = judged.where("_own IS NOT NULL").groupBy(F.col("_own").alias("venue_id")).agg(F.max_by("_listing", "seq").alias("_listing")).select("venue_id", "_listing.*")
    next_catalogue = mutations.upsert(catalogue, shown, ["venue_id"])
    return judged.select("seq", "submission_id", "outcome", "status", F.col("_own").alias("venue_id")), next_submissions, next_catalogue


def followed(patches: DataFrame, follows: DataFrame, users: DataFrame, venues: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Settings (seq, user_id, venue_id, and FOLLOW, null where not given) of follows.

    Each setting is the one that is given, else the one that is stored, else its default.
    Outcomes: user_not_found, venue_not_found, created, changed; with the settings after the
    request, null if it failed. Gives (outcomes, next follows).
    """
    keys = ["user_id", "venue_id"]
    stored = follows.select(*keys, F.lit(True).alias("_stored"), *[F.col(c).alias(f"_{c}") for c in FOLLOW])
    asked = patches.join(users.select("user_id", F.lit(True).alias("_user")), "user_id", "left").join(venues.select("venue_id", F.lit(True).alias("_venue")), "venue_id", "left").join(stored, keys, "left")
    order = W.partitionBy(*keys).orderBy("seq")
    good = F.col("_user").isNotNull() & F.col("_venue").isNotNull()
    value = {c: F.when(good, F.coalesce(c, _before(F.col(c), order), f"_{c}", F.lit(default))) for c, default in FOLLOW.items()}
    outcome = F.when(F.col("_user").isNull(), "user_not_found").when(F.col("_venue").isNull(), "venue_not_found").when(F.col("_stored").isNull() & (F.row_number().over(order) == 1), "created").otherwise("changed")
    outcomes = asked.select("seq", *keys, outcome.alias("outcome"), *[v.alias(c) for c, v in value.items()])
    last = outcomes.where(F.col("outcome").isin("created", "changed")).groupBy(*keys).agg(F.max_by(F.struct(*FOLLOW), "seq").alias("_s")).select(*keys, "_s.*")
    return outcomes, mutations.upsert(follows.select(*keys, *FOLLOW), last, keys)
