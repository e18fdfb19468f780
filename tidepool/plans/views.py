"""The domain's tables as DuckDB SQL, for comparing results."""

from __future__ import annotations

VIEWS: dict[str, str] = {
    "venues": """SELECT s_suppkey + 1 AS venue_id, s_name || ' & ' || n_name AS name, n_name AS neighborhood,
      32.5::DOUBLE + (s_suppkey % 50) * 0.01::DOUBLE AS lat, -117.3::DOUBLE + (s_suppkey % 40) * 0.01::DOUBLE AS lng,
      [d.v FOR d IN [{'i': 0, 'v': 'Sunday'}, {'i': 1, 'v': 'Monday'}, {'i': 2, 'v': 'Tuesday'}, {'i': 3, 'v': 'Wednesday'}, {'i': 4, 'v': 'Thursday'}, {'i': 5, 'v': 'Friday'}, {'i': 6, 'v': 'Saturday'}] IF (s_suppkey + d.i) % 3 <> 0] AS days,
      840 + 30 * (s_suppkey % 10) AS start_min, 840 + 30 * (s_suppkey % 10) + 60 + 30 * (s_suppkey % 5) AS end_min,
      [d.v FOR d IN [{'i': 0, 'v': 'drinks'}, {'i': 1, 'v': 'food'}, {'i': 2, 'v': 'bottles'}] IF (s_suppkey + d.i) % 3 = 0] AS deal_types,
      [d.v FOR d IN [{'i': 0, 'v': 'patio'}, {'i': 1, 'v': 'dog-friendly'}, {'i': 2, 'v': 'late-night'}, {'i': 3, 'v': 'live-music'}] IF (s_suppkey + d.i) % 3 = 0] AS features,
      s_acctbal > 0 AS verified, CASE WHEN s_suppkey % 7 = 0 THEN '' ELSE '/api/images/v' || s_suppkey END AS image,
      CASE WHEN s_suppkey % 2 = 0 THEN 'wine bar' WHEN s_suppkey % 3 = 0 THEN 'dive bar' ELSE '' END AS vibe, s_acctbal AS balance, s_suppkey AS ordinal
      FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "venue_patches": """SELECT s_suppkey + 1 AS venue_id, 900::BIGINT AS start_min, 1080::BIGINT AS end_min, '' AS phone, CASE WHEN s_suppkey % 8 = 0 THEN 'Renamed ' || s_suppkey END AS name FROM supplier WHERE s_suppkey % 4 = 0""",
    "users": """SELECT c_custkey + 1 AS user_id, c_name AS name, lower(c_name) || '@example.test' AS email, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE '+1 (619) 555-' || lpad((c_custkey % 10000)::VARCHAR, 4, '0') END AS phone,
      CASE WHEN c_acctbal > 0 THEN TIMESTAMP '1998-01-01' END AS consent_at, CASE WHEN c_custkey % 3 = 0 THEN 'paid' ELSE 'free' END AS plan, CASE WHEN c_custkey % 4 = 0 THEN 'g' || c_custkey END AS google_id, CASE WHEN c_custkey % 4 <> 1 THEN 'h' || c_custkey END AS password_hash, 's' || c_custkey AS share_id, c_nationkey AS nation FROM customer""",
    "alerts": """SELECT 2 * c_custkey + j AS alert_id, c_custkey + 1 AS user_id, 'alert ' || j AS name, CASE WHEN j = 1 THEN n_name ELSE '' END AS neighborhood,
      CASE (c_custkey + j) % 4 WHEN 0 THEN '' WHEN 1 THEN 'drinks' WHEN 2 THEN 'food' ELSE 'bottles' END AS deal_type, CASE WHEN c_custkey % 6 = 5 THEN 'dog-friendly' ELSE '' END AS feature,
      CASE WHEN c_custkey % 2 = 0 THEN []::VARCHAR[] ELSE [d.v FOR d IN [{'i': 0, 'v': 'Sunday'}, {'i': 1, 'v': 'Monday'}, {'i': 2, 'v': 'Tuesday'}, {'i': 3, 'v': 'Wednesday'}, {'i': 4, 'v': 'Thursday'}, {'i': 5, 'v': 'Friday'}, {'i': 6, 'v': 'Saturday'}] IF (c_custkey + d.i) % 2 = 0] END AS days,
      CASE WHEN c_custkey % 9 = 4 THEN 'supplier#00000000' ELSE '' END AS query, c_custkey % 4 <> 1 AS channel_email, c_custkey % 3 = 0 AS channel_text,
      CASE c_custkey % 3 WHEN 0 THEN ['happy_hour'] WHEN 1 THEN ['promotion'] ELSE ['happy_hour', 'promotion'] END AS kinds, c_custkey % 10 <> 9 AS active, TIMESTAMP '1998-01-01' + to_minutes(c_custkey) AS created_at
      FROM customer JOIN nation ON c_nationkey = n_nationkey, (VALUES (1), (2)) t(j)""",
    "campaigns": """SELECT o_orderkey + 1 AS campaign_id, o_custkey % n + 1 AS venue_id, st AS starts_at, st + to_hours(1 + o_orderkey % 8) AS ends_at, CASE WHEN o_orderstatus <> 'P' THEN st - INTERVAL 1 DAY END AS published_at,
      CASE WHEN o_orderkey % 11 = 0 THEN st - INTERVAL 2 HOUR END AS cancelled_at, CASE WHEN o_orderkey % 7 = 0 THEN st + INTERVAL 30 MINUTE END AS ended_at,
      CASE o_orderkey % 4 WHEN 0 THEN 'special_deal' WHEN 1 THEN 'extended_happy_hour' WHEN 2 THEN 'event' ELSE 'other' END AS type, CASE WHEN o_orderkey % 13 = 0 THEN '' ELSE 'Offer ' || o_orderkey END AS title, 'Deal of order ' || o_orderkey AS description,
      CASE WHEN o_orderkey % 3 = 0 THEN ' CODE' || o_orderkey END AS deal_code, o_orderdate AS created_at, st - to_hours(o_orderkey % 5) AS updated_at, CASE WHEN o_orderkey % 17 = 0 THEN o_custkey % n + 1 END AS legacy_venue_id, o_custkey + 1 AS created_by
      FROM (SELECT *, TIMESTAMP '1998-06-01' + to_hours(o_orderkey * 7 % 720) AS st FROM orders), (SELECT count(*) AS n FROM supplier)""",
    "overrides": """SELECT s_suppkey + 1 AS venue_id, s_suppkey % 10 <> 5 AS active, TIMESTAMP '1998-06-15 19:00:00' AS since, TIMESTAMP '1998-06-15 20:00:00' + to_hours(s_suppkey % 7 - 2) AS expires_at FROM supplier WHERE s_suppkey % 5 = 0""",
    "sends": """SELECT event_id AS send_id, user_id + 1 AS user_id, event_id % n + 1 AS venue_id, CASE WHEN event_type IN ('view', 'click') THEN 'email' ELSE 'text' END AS channel, ts AS sent_at FROM events, (SELECT count(*) AS n FROM supplier)""",
    "follows": """SELECT c_custkey + 1 AS user_id, c_custkey % n + 1 AS venue_id, c_custkey % 2 = 0 AS happy_hour, c_custkey % 4 <> 0 AS promotion, true AS channel_email, c_custkey % 2 = 1 AS channel_text FROM customer, (SELECT count(*) AS n FROM supplier) WHERE c_custkey % 3 = 0""",
    "claims": """SELECT c_custkey + 1 AS claim_id, c_custkey + 1 AS user_id, c_custkey % n + 1 AS venue_id, CASE c_custkey % 3 WHEN 0 THEN 'verified' WHEN 1 THEN 'pending' ELSE 'denied' END AS status, CASE c_custkey % 8 WHEN 0 THEN 'Pro' WHEN 4 THEN ' founding-partner' ELSE 'free' END AS plan,
      lpad((c_custkey * 7919 % 1000000)::VARCHAR, 6, '0') AS phone_code, TIMESTAMP '1998-06-15 20:00:00' + to_minutes((c_custkey % 9 - 4) * 5) AS code_expires_at, CASE WHEN c_custkey % 2 = 0 THEN '' ELSE 'I manage it' END AS note FROM customer, (SELECT count(*) AS n FROM supplier) WHERE c_custkey % 4 = 0""",
    "sections": """SELECT p_partkey + 1 AS section_id, p_partkey % n + 1 AS venue_id, p_type AS title, (p_partkey % 5)::INT AS sort_order FROM part, (SELECT count(*) AS n FROM supplier)""",
    "items": """SELECT l_orderkey * 8 + l_linenumber AS item_id, l_partkey + 1 AS section_id, 'item ' || l_orderkey AS name, CASE WHEN l_linenumber = 1 THEN l_suppkey + 1 END AS photo_id, l_linenumber AS sort_order, l_shipdate AS created_at FROM lineitem WHERE l_partkey % 7 <> 0""",
    "photos": """SELECT p_partkey + 1 AS photo_id, p_partkey % n + 1 AS venue_id, 'img' || (p_partkey % 37) AS image_key, CASE p_partkey % 5 WHEN 0 THEN 'rejected' WHEN 1 THEN 'pending' ELSE 'published' END AS status, p_name AS caption, (p_partkey % 11)::INT AS sort_order, CASE WHEN p_partkey % 2 = 0 THEN 'gallery' ELSE 'menu' END AS photo_type FROM part, (SELECT count(*) AS n FROM supplier)""",
    "legacy": """SELECT s_suppkey + 1 AS venue_id, 'OLD' || s_suppkey AS deal_code, 'old offer ' || s_suppkey AS description, TIMESTAMP '1998-05-01' + to_hours(s_suppkey) AS updated_at FROM supplier WHERE s_suppkey % 6 = 0""",
    "sessions": """SELECT 't' || c_custkey AS session_id, c_custkey + 1 AS user_id, CASE WHEN c_custkey % 50 = 0 THEN 'admin' ELSE 'user' END AS role, TIMESTAMP '1998-06-15 20:00:00' + to_hours(c_custkey % 13 - 6) AS expires_at FROM customer""",
    "submissions": """SELECT c_custkey + 1 AS submission_id, CASE c_custkey % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'approved' ELSE 'denied' END AS status, c_name AS contact_name, lower(c_name) || '@example.test' AS contact_email, '' AS contact_notes, TIMESTAMP '1998-04-01' + to_hours(c_custkey * 37 % 1000) AS created_at FROM customer WHERE c_custkey % 10 = 3""",
    "saved": """SELECT c_custkey + 1 AS user_id, c_custkey * 3 % (n + 5) + 1 AS venue_id, CASE c_custkey % 6 WHEN 0 THEN 'favorite' WHEN 2 THEN 'been_to' ELSE 'want_to_go' END AS status, 'note ' || c_custkey AS note, CASE WHEN c_custkey % 7 < 6 THEN (c_custkey % 7)::INT END AS rating FROM customer, (SELECT count(*) AS n FROM supplier) WHERE c_custkey % 2 = 0""",
}


def with_views(sql: str) -> str:
    """The query with the views that it names, as common table expressions."""
    import re

    used = [v for v in VIEWS if re.search(rf"\b{v}\b", sql)]
    head = ", ".join(f"{v} AS ({VIEWS[v]})" for v in used)
    sql = sql.strip()
    if not head:
        return sql
    for begin in ("WITH RECURSIVE ", "WITH "):
        if sql.upper().startswith(begin):
            return f"{begin}{head}, {sql[len(begin):]}"
    return f"WITH {head} {sql}"
