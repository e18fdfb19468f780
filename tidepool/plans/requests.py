"""Queries of batches of claims, reviews and follows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidepool.operators import requests as R
from tidepool.plans.changes import _RECORDS, _RULES_SQL, records
from tidepool.plans.registry import register
from tidepool.sources.domain import Domain

_N = "(SELECT count(*) AS n FROM supplier)"


def _times(d: Domain, df: DataFrame, times: int) -> DataFrame:
    """Every row so many times, with its turn ``j`` and the number ``n`` of venues."""
    n = d.raw("supplier").agg(F.count(F.lit(1)).alias("n"))
    return df.crossJoin(F.broadcast(n)).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))  # one row


# claims: users ask four times, half of them for a venue whose domain their mail may have
_ASKED_VENUE = "CASE WHEN j % 2 = 0 THEN (user_id * 3) % n + 1 ELSE (user_id + j) % (n + 2) + 1 END"
_ASKED_NOTE = "CASE WHEN (user_id + j) % 5 = 0 THEN ' I run it ' WHEN (user_id + j) % 5 = 1 THEN NULL ELSE '' END"
_MAIL = "CASE WHEN user_id % 3 = 0 THEN concat('U@V', (user_id * 3) % n + 1, '.Test') ELSE 'me@mail.test' END"


def claims(d: Domain) -> tuple[DataFrame, DataFrame]:
    users = d.users().crossJoin(F.broadcast(d.raw("supplier").agg(F.count(F.lit(1)).alias("n")))).select("user_id", F.expr(_MAIL).alias("email"))
    venues = d.venues().select("venue_id", F.expr("concat('https://www.v', venue_id, '.test/menu')").alias("website"))
    asked = _times(d, d.users().select("user_id"), 4).select((F.col("user_id") * 4 + F.col("j")).alias("seq"), "user_id", F.expr(_ASKED_VENUE).alias("venue_id"), F.expr(_ASKED_NOTE).alias("note"))
    stored = d.claims().select("user_id", "venue_id", "status", F.lit(None).cast("string").alias("method"), "note")
    return R.claimed(asked, stored, users, venues)


_CLAIMS = f"""WITH r AS (SELECT user_id * 4 + j AS seq, user_id, {_ASKED_VENUE} AS venue_id, trim(coalesce({_ASKED_NOTE}, '')) AS note, user_id % 3 = 0 AND {_ASKED_VENUE} = (user_id * 3) % n + 1 AS same FROM users, range(4) t(j), {_N}),
  f AS (SELECT r.*, v.venue_id IS NOT NULL AS found, c.status AS had, EXISTS (SELECT 1 FROM claims o WHERE o.venue_id = r.venue_id AND o.status = 'verified' AND o.user_id <> r.user_id) AS taken FROM r LEFT JOIN venues v ON v.venue_id = r.venue_id LEFT JOIN claims c ON c.user_id = r.user_id AND c.venue_id = r.venue_id),
  w AS (SELECT venue_id, arg_min(user_id, seq) AS winner, min(seq) AS won FROM f WHERE found AND same AND NOT taken AND had IS DISTINCT FROM 'verified' GROUP BY venue_id),
  q AS (SELECT f.*, CASE WHEN NOT found THEN 'not_found' WHEN had = 'verified' THEN 'unchanged' WHEN same AND (taken OR winner <> user_id) THEN 'conflict' WHEN same AND won = seq THEN 'verified' WHEN same THEN 'unchanged' WHEN note <> '' THEN 'manual'
    WHEN had IS NULL AND seq = min(seq) OVER (PARTITION BY user_id, f.venue_id) THEN 'pending' ELSE 'kept' END AS outcome, min(seq) OVER (PARTITION BY user_id, f.venue_id) AS began FROM f LEFT JOIN w ON w.venue_id = f.venue_id)"""


@register("life_claim_workflow", f"""{_CLAIMS},
  last AS (SELECT user_id, venue_id, bool_or(outcome = 'verified') AS v, bool_or(outcome = 'manual') AS m FROM q WHERE outcome IN ('verified', 'manual', 'pending') GROUP BY ALL)
  SELECT seq, user_id, venue_id, outcome, had IS NULL AND seq = began AND outcome IN ('verified', 'manual', 'pending') AS created, NULL AS status, NULL AS method, NULL AS note FROM q
  UNION ALL SELECT NULL, coalesce(c.user_id, l.user_id), coalesce(c.venue_id, l.venue_id), NULL, NULL, CASE WHEN l.v THEN 'verified' WHEN l.user_id IS NOT NULL THEN 'pending' ELSE c.status END, CASE WHEN l.v THEN 'domain' WHEN l.m THEN 'manual' END,
    CASE WHEN l.m THEN 'I run it' ELSE c.note END FROM claims c FULL JOIN last l ON c.user_id = l.user_id AND c.venue_id = l.venue_id""")
def _(d: Domain) -> DataFrame:
    """What each request comes to, and all claims after the batch."""
    outcomes, after = claims(d)
    return outcomes.unionByName(after, allowMissingColumns=True)


# reviews: four commands for every submission


def reviews(d: Domain) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Stored listings are those of venues; half of the commands carry another venue's, some of them spoilt, some without a place."""
    n = d.raw("supplier").agg(F.count(F.lit(1)).alias("n"))
    listings = records(d).select("venue_id", *R.LISTING)
    mine = d.submissions().crossJoin(F.broadcast(n)).withColumn("venue_id", F.expr("submission_id % n + 1"))  # one row
    published = F.when((F.col("status") == "approved") & (F.col("submission_id") % 2 == 0), F.col("venue_id"))
    stored = mine.join(listings, "venue_id").select("submission_id", "status", F.lit(None).cast("string").alias("denial_reason"), published.alias("published_id"), *R.LISTING)
    asked = _times(d, d.submissions().select("submission_id"), 4).withColumn("venue_id", F.when(F.expr("(submission_id + j) % 2 = 0"), F.expr("(submission_id * 5 + j) % n + 1")))
    action = F.element_at(F.array(*map(F.lit, ["approve", "approve", "edit", "deny", "archive"])), F.expr("int((submission_id div 10 * 7 + j * j) % 5 + 1)"))
    commands = asked.join(listings, "venue_id", "left").select((F.col("submission_id") * 4 + F.col("j")).alias("seq"), "submission_id", action.alias("action"), F.concat(F.lit("no "), F.col("j").cast("string")).alias("reason"), *R.LISTING)
    return R.reviewed(commands, stored, listings)


_BROKEN = " OR ".join(f"coalesce({rule}, false)" for k, rule in _RULES_SQL["submission"].items() if not k.startswith("contact"))


def _reviews_sql(times: int = 4) -> str:
    """The commands one after the other, each on the state that the one before left."""
    steps = [f"""l AS (SELECT venue_id, {_BROKEN} AS bad, lat IS NOT NULL AND lng IS NOT NULL AS placed FROM {_RECORDS}),
      s0 AS (SELECT submission_id, submission_id % n + 1 AS own, n, status, CASE WHEN status = 'approved' AND submission_id % 2 = 0 THEN (submission_id % n + 1)::VARCHAR END AS venue, NULL AS outcome FROM submissions, {_N})"""]
    for j in range(times):
        listing = f"CASE WHEN (submission_id + {j}) % 2 = 0 THEN (submission_id * 5 + {j}) % n + 1 ELSE own END"
        action = f"['approve', 'approve', 'edit', 'deny', 'archive'][((submission_id // 10 * 7 + {j * j}) % 5 + 1)::INT]"
        steps.append(f"""a{j} AS (SELECT s.*, {action} AS action, bad, placed FROM s{j} s JOIN l ON l.venue_id = {listing}),
      o{j} AS (SELECT *, CASE WHEN action = 'deny' THEN 'denied' WHEN action = 'archive' THEN 'bad_action' WHEN bad OR (NOT placed AND (action = 'approve' OR status = 'approved')) THEN 'invalid' WHEN status = 'approved' AND venue IS NOT NULL THEN 'updated' WHEN action = 'approve' THEN 'published' ELSE 'edited' END AS did FROM a{j}),
      s{j + 1} AS (SELECT submission_id, own, n, CASE WHEN did = 'denied' THEN 'denied' WHEN did = 'published' THEN 'approved' ELSE status END AS status, CASE WHEN did = 'published' THEN 'new' ELSE venue END AS venue, did AS outcome FROM o{j})""")
    rows = " UNION ALL ".join(f"SELECT submission_id * 4 + {j} AS seq, submission_id, outcome, status, CASE WHEN outcome IN ('published', 'updated') THEN venue END AS venue FROM s{j + 1}" for j in range(times))
    return f"WITH {', '.join(steps)} {rows}"


@register("life_submission_workflow", _reviews_sql())
def _(d: Domain) -> DataFrame:
    """What each review comes to: approving twice publishes once, and a denied one that is approved again is published again."""
    outcomes, _, _ = reviews(d)
    n = d.raw("supplier").agg(F.count(F.lit(1)).alias("n"))
    venue = F.when(F.col("venue_id") > F.col("n"), "new").otherwise(F.col("venue_id").cast("string"))
    return outcomes.crossJoin(F.broadcast(n)).select("seq", "submission_id", "outcome", "status", venue.alias("venue"))  # one row


# follows: three settings of every user, the first and the last for one venue
_FOLLOWED = "CASE j WHEN 1 THEN user_id % (n + 1) + 1 ELSE (user_id - 1) % n + 1 END"
_SETTINGS = {"happy_hour": "CASE (user_id + j) % 4 WHEN 0 THEN true WHEN 1 THEN false END", "promotion": "CASE (user_id + 2 * j) % 5 WHEN 0 THEN false END", "channel_email": "CASE WHEN j = 0 AND user_id % 2 = 0 THEN false END", "channel_text": "CASE WHEN j = 2 AND user_id % 7 = 0 THEN true END"}


@register("life_follow_patch", f"""WITH r AS (SELECT user_id * 3 + j AS seq, user_id, {_FOLLOWED} AS venue_id, {', '.join(f'{sql} AS {c}' for c, sql in _SETTINGS.items())} FROM (SELECT user_id + 7 AS user_id FROM users), range(3) t(j), {_N}),
  k AS (SELECT r.*, CASE WHEN u.user_id IS NULL THEN 'user_not_found' WHEN v.venue_id IS NULL THEN 'venue_not_found' WHEN f.user_id IS NULL AND row_number() OVER w = 1 THEN 'created' ELSE 'changed' END AS outcome,
    {', '.join(f'coalesce(last_value(r.{c} IGNORE NULLS) OVER (w ROWS UNBOUNDED PRECEDING), f.{c}, {str(v).lower()}) AS new_{c}' for c, v in R.FOLLOW.items())}
    FROM r LEFT JOIN users u ON u.user_id = r.user_id LEFT JOIN venues v ON v.venue_id = r.venue_id LEFT JOIN follows f ON f.user_id = r.user_id AND f.venue_id = r.venue_id WINDOW w AS (PARTITION BY r.user_id, r.venue_id ORDER BY seq)),
  last AS (SELECT user_id, venue_id, {', '.join(f'arg_max(new_{c}, seq) AS {c}' for c in R.FOLLOW)} FROM k WHERE outcome IN ('created', 'changed') GROUP BY ALL)
  SELECT seq, user_id, venue_id, outcome, {', '.join(f"CASE WHEN outcome IN ('created', 'changed') THEN new_{c} END AS {c}" for c in R.FOLLOW)} FROM k
  UNION ALL SELECT NULL, coalesce(l.user_id, f.user_id), coalesce(l.venue_id, f.venue_id), NULL, {', '.join(f'CASE WHEN l.user_id IS NOT NULL THEN l.{c} ELSE f.{c} END' for c in R.FOLLOW)} FROM last l FULL JOIN follows f ON f.user_id = l.user_id AND f.venue_id = l.venue_id""")
def _(d: Domain) -> DataFrame:
    """What each patch leaves, and all follows after the batch; some users and venues don't exist."""
    asked = _times(d, d.users().select((F.col("user_id") + 7).alias("user_id")), 3)
    patches = asked.select((F.col("user_id") * 3 + F.col("j")).alias("seq"), "user_id", F.expr(_FOLLOWED).alias("venue_id"), *[F.expr(sql).alias(c) for c, sql in _SETTINGS.items()])
    outcomes, after = R.followed(patches, d.follows(), d.users(), d.venues())
    return outcomes.unionByName(after, allowMissingColumns=True)
