"""The fixture domain once more, as SQL views for the checks."""

from __future__ import annotations

import re

from lagoon.functions.scalars import PALETTE
from lagoon.sources.domain import AS_OF, PRIORITIES, PRODUCTS

AS_OF_SQL = f"TIMESTAMP '{AS_OF}'"


def sql_list(values) -> str:
    return "[" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in values) + "]"


def avatar_sql(expr: str) -> str:
    total = f"list_sum(list_transform(string_split({expr}, ''), lambda ch: unicode(ch)))"
    return f"list_extract({sql_list(PALETTE)}, CAST({total} % {len(PALETTE)} AS INTEGER) + 1)"


def trim_sql(expr: str) -> str:
    return f"regexp_replace(regexp_replace({expr}, '^[\\s\\x{{A0}}\\x{{FEFF}}]+', ''), '[\\s\\x{{A0}}\\x{{FEFF}}]+$', '')"


def minted_sql(prefix: str, *parts: str) -> str:
    """The id of a row with this natural key: each part's text with its length before it, a dash for null."""
    key = " || ".join(f"coalesce(length(CAST({p} AS VARCHAR)) || ':' || CAST({p} AS VARCHAR), '-')" for p in parts)
    return f"'{prefix}' || substring(sha256({key}), 1, 32)"


N = "(SELECT count(*) FROM customer)"
K = "CAST(regexp_extract(props, '[0-9]+', 0) AS INTEGER)"

VIEWS: dict[str, str] = {
    "accounts": f"""
        SELECT 'u' || c_custkey AS id, c_name AS name, upper(substring(c_name, 1, 1)) AS initial,
               {avatar_sql('c_name')} AS avatar_bg,
               CASE WHEN c_custkey % 7 <> 0 THEN lower(c_name) || '@example.org' END AS email,
               CASE WHEN c_custkey % 13 <> 0 THEN 'x' END AS password_hash,
               CASE WHEN c_custkey % 5 = 0 THEN 'sub' || c_custkey END AS apple_sub,
               CASE WHEN c_custkey % 3 = 0 THEN TIMESTAMP '2024-01-02 00:00:00' END AS email_verified_at,
               CAST(NULL AS VARCHAR) AS avatar_url
        FROM customer""",
    "users": """
        SELECT a.*, coalesce(s.last_seen, TIMESTAMP '2023-12-25 00:00:00') AS last_seen
        FROM accounts a LEFT JOIN (SELECT 'u' || user_id AS id, max(ts) AS last_seen FROM events GROUP BY 1) s
          ON s.id = a.id""",
    "auth_sessions": """
        SELECT sha256('tok' || event_id) AS token_hash, 'u' || user_id AS user_id, ts AS created_at,
               ts AS last_used, ts + INTERVAL 10 DAY AS expires_at
        FROM events WHERE event_type = 'signup'""",
    "email_verifications": """
        SELECT sha256('ver' || event_id) AS token_hash, 'u' || user_id AS user_id,
               CASE WHEN event_id % 9 = 0 THEN 'old.' ELSE '' END
                 || 'customer#' || lpad(CAST(user_id AS VARCHAR), 9, '0') || '@example.org' AS email,
               ts AS created_at, ts + INTERVAL 10 DAY AS expires_at
        FROM events WHERE event_type = 'view'""",
    "raw_dives": f"""
        SELECT event_id AS seq, 'u' || user_id AS user_id, ts,
               CASE WHEN {K} = 0 THEN 'oops' ELSE CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) END AS mins,
               CASE WHEN event_type IN ('signup', 'view', 'purchase') THEN event_type END AS species_id,
               CASE {K} % 4 WHEN 0 THEN ' Fin ' || {K} || ' ' WHEN 1 THEN 'no/slash' WHEN 2 THEN '   ' END AS nickname
        FROM events""",
    "dives": """
        SELECT event_id AS seq, 'u' || user_id AS user_id, ts,
               least(120, greatest(0, CAST(floor(value) AS INTEGER))) AS mins,
               CASE WHEN event_type IN ('signup', 'view', 'purchase') THEN event_type END AS species_id
        FROM events""",
    "user_creatures": """
        SELECT 'c' || o_orderkey AS id, 'u' || o_custkey AS user_id, lower(o_orderpriority) AS species_id,
               CASE WHEN o_orderkey % 3 = 0 THEN 'Nick ' || (o_orderkey % 97) END AS nickname,
               o_orderdate AS caught_at
        FROM orders""",
    "user_species": f"""
        SELECT 'u' || (p_partkey % (2 * {N})) AS user_id, p_name AS species_id,
               CAST(p_partkey % 4 AS INTEGER) AS count
        FROM part""",
    "rooms": """
        SELECT 'r' || s_suppkey AS id, s_name AS name,
               CASE WHEN s_suppkey % 2 = 0 THEN 'expedition' ELSE 'room' END AS kind,
               CASE WHEN s_suppkey % 2 = 0 THEN 10 + 4 * s_nationkey END AS depth,
               CASE WHEN s_suppkey % 3 = 0 THEN 'once' ELSE 'daily' END AS schedule,
               CASE WHEN s_suppkey % 3 <> 0 THEN CAST((37 * s_suppkey) % 1440 AS INTEGER) END AS start_min,
               CASE WHEN s_suppkey % 3 = 0 THEN TIMESTAMP '2024-02-01 09:00:00' END AS start_at,
               'u' || s_suppkey AS host_id,
               TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(s_suppkey % 28 AS INTEGER)) AS created_at
        FROM supplier""",
    "room_dives": """
        SELECT 'r' || l_suppkey AS room_id, 'u' || o_custkey AS user_id, CAST(l_quantity AS INTEGER) AS mins,
               10 + 2 * CAST(l_quantity AS INTEGER) AS depth, l_shipdate AS ts, l_linenumber AS ln
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "room_members": """
        SELECT room_id, user_id, min(ts) AS joined_at FROM room_dives WHERE ln <= 2 GROUP BY 1, 2""",
    "friendships": f"""
        SELECT DISTINCT user_id, friend_id, TIMESTAMP '2024-01-01 00:00:00' AS since FROM (
            SELECT 'u' || c_custkey AS user_id, 'u' || ((7 * c_custkey + 1) % {N}) AS friend_id FROM customer
            UNION ALL
            SELECT 'u' || ((7 * c_custkey + 1) % {N}), 'u' || c_custkey FROM customer)
        WHERE user_id <> friend_id""",
    "blocks": f"""
        SELECT 'u' || k AS blocker_id, 'u' || t AS blocked_id,
               min(TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(k % 29 AS INTEGER))) AS created_at
        FROM (SELECT c_custkey AS k, (5 * c_custkey + 2) % {N} AS t FROM customer WHERE c_custkey % 11 = 0
              UNION ALL
              SELECT c_custkey, (7 * c_custkey + 1) % {N} FROM customer WHERE c_custkey % 17 = 0)
        WHERE k <> t GROUP BY 1, 2""",
    "reports": f"""
        SELECT {minted_sql('rp', f"('u' || (conv_id % {N}))", '(conv_id * 1000 + turn)')} AS id,
               'u' || (conv_id % {N}) AS reporter_id, 'u' || ((3 * conv_id + turn) % {N}) AS target_id,
               substring(text, 1, 500) AS reason
        FROM conversations""",
    "closure": """
        SELECT blocker_id AS viewer_id, blocked_id AS target_id FROM blocks
        UNION SELECT blocked_id, blocker_id FROM blocks""",
    "trades": f"""
        SELECT 't' || o_orderkey AS id, 'u' || o_custkey AS from_id, 'u' || ((3 * o_custkey + 1) % {N}) AS to_id,
               lower(o_orderpriority) AS give_id,
               list_extract({sql_list(PRIORITIES)}, CAST(o_orderkey % 5 AS INTEGER) + 1) AS get_id,
               CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'F' THEN 'accepted' ELSE 'declined' END AS status,
               o_orderdate AS created_at,
               CASE WHEN o_orderstatus <> 'O' THEN o_orderdate END AS resolved_at,
               CASE WHEN o_orderkey % 4 = 0 THEN 'c' || o_orderkey END AS give_creature_id,
               o_orderkey AS seq
        FROM orders WHERE o_custkey <> (3 * o_custkey + 1) % {N}""",
    "purchase_events": f"""
        SELECT event_id AS seq, ts,
               CASE WHEN {K} % 10 = 0 THEN '' ELSE 'u' || user_id END AS app_user_id,
               CASE WHEN {K} % 20 <> 0 THEN 'u' || user_id END AS original_app_user_id,
               CASE event_type WHEN 'signup' THEN 'INITIAL_PURCHASE' WHEN 'view' THEN 'renewal'
                    WHEN 'purchase' THEN 'NON_RENEWING_PURCHASE' WHEN 'click' THEN 'CANCELLATION'
                    ELSE CASE WHEN {K} % 2 = 0 THEN 'EXPIRATION' ELSE 'BILLING_ISSUE' END END AS type,
               list_extract({sql_list(PRODUCTS)}, {K} % 8 + 1) AS product_id,
               {K} % 3 = 0 AS has_pro,
               CASE WHEN {K} % 25 <> 0 THEN 'tx' || (event_id - event_id % 30) END AS transaction_id,
               CAST(NULL AS VARCHAR) AS original_transaction_id,
               CASE WHEN {K} % 15 <> 0 THEN 1704067200000 + CAST({K} AS BIGINT) * 86400000 END AS expiration_at_ms
        FROM events""",
    "auth_log": """
        SELECT event_id, ts, 'u' || user_id AS device_key, event_type AS path,
               CASE WHEN event_id % 3 = 0 THEN 'GET' ELSE 'POST' END AS method FROM events""",
    "collections": """
        SELECT user_id, species_id, count(*) AS n FROM user_creatures GROUP BY 1, 2""",
    "stats": """
        SELECT u.id AS user_id, CAST(coalesce(sum(d.mins), 0) AS BIGINT) AS total_mins, count(d.seq) AS dives,
               count(d.species_id) AS caught
        FROM accounts u LEFT JOIN dives d ON d.user_id = u.id GROUP BY 1""",
}


def _needs(sql: str) -> list[str]:
    words = set(re.findall(r"[a-z_]+", sql))
    return [v for v in VIEWS if v in words]


def with_views(sql: str) -> str:
    """Prefix a statement with the views it mentions, directly or through others."""
    wanted: set[str] = set()
    queue = _needs(sql)
    while queue:
        v = queue.pop()
        if v not in wanted:
            wanted.add(v)
            queue += _needs(VIEWS[v])
    ordered = [v for v in _ORDER if v in wanted]
    if not ordered:
        return sql
    ctes = ",\n".join(f"{v} AS ({VIEWS[v]})" for v in ordered)
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes},\n{body[15:]}"
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"


# Dependencies come first: a view only mentions views named before it.
_ORDER = list(VIEWS)
