"""Names, friends, blocks, reports."""

from pyspark.sql import functions as F

from lagoon.operators import reports
from lagoon.operators import social as op
from lagoon.registry import query
from lagoon.registry.views import AS_OF_SQL, N
from lagoon.sources.domain import AS_OF, instant, uid


@query("symmetric_closure", "SELECT viewer_id, target_id FROM closure")
def symmetric_closure(d):
    return op.symmetric_closure(d.blocks)


# Pairs to look at: every friendship, and every block both ways.
PAIRS = """
  pairs AS (SELECT user_id AS viewer_id, friend_id AS target_id FROM friendships
            UNION SELECT blocker_id, blocked_id FROM blocks UNION SELECT blocked_id, blocker_id FROM blocks)"""


@query(
    "visible",
    f"""WITH {PAIRS} SELECT * FROM pairs p WHERE NOT EXISTS (
          SELECT 1 FROM blocks b WHERE (b.blocker_id = p.viewer_id AND b.blocked_id = p.target_id)
                                    OR (b.blocker_id = p.target_id AND b.blocked_id = p.viewer_id))""",
)
def visible(d):
    pairs = d.friendships.select(F.col("user_id").alias("viewer_id"), F.col("friend_id").alias("target_id"))
    return op.visible(pairs.unionByName(op.block_pairs(d.blocks)).distinct(), d.blocks)


@query(
    "name_availability",
    """WITH asks AS (SELECT c_custkey AS request_id,
              CASE WHEN c_custkey % 3 = 0 THEN 'Free Name ' || c_custkey ELSE upper(c_name) END AS name,
              CASE WHEN c_custkey % 3 = 1 THEN 'u' || c_custkey WHEN c_custkey % 3 = 2 THEN 'u' || (c_custkey + 1) END AS self_id
            FROM customer)
       SELECT request_id, a.name, self_id, o.id IS NULL OR coalesce(o.id = self_id, false) AS available
       FROM asks a LEFT JOIN accounts o ON lower(o.name) = lower(a.name)""",
)
def name_availability(d):
    k = F.col("c_custkey")
    asks = d.raw("customer").select(
        k.alias("request_id"),
        F.when(k % 3 == 0, F.concat(F.lit("Free Name "), k.cast("string"))).otherwise(F.upper("c_name")).alias("name"),
        F.when(k % 3 == 1, uid(k)).when(k % 3 == 2, uid(k + 1)).alias("self_id"),
    )
    return op.name_availability(asks, d.accounts)


FRIEND_ASKS = f"""
  asks AS (SELECT c_custkey AS request_id, 'u' || c_custkey AS user_id,
                  CASE c_custkey % 11 WHEN 0 THEN 'Customer#' || lpad(CAST((5 * c_custkey + 2) % {N} AS VARCHAR), 9, '0')
                       WHEN 1 THEN '   ' WHEN 2 THEN 'Nobody Here' WHEN 3 THEN c_name
                       ELSE ' CUSTOMER#' || lpad(CAST((c_custkey + 9) % {N} AS VARCHAR), 9, '0') || ' ' END AS name
           FROM customer)"""


def friend_asks(d):
    k, n = F.col("c_custkey"), d.n_customers
    named = lambda p, x: F.concat(F.lit(p), F.lpad((x % n).cast("string"), 9, "0"))
    turn = k % 11
    return d.raw("customer").select(
        k.alias("request_id"),
        uid(k).alias("user_id"),
        F.when(turn == 0, named("Customer#", 5 * k + 2)).when(turn == 1, "   ").when(turn == 2, "Nobody Here")
        .when(turn == 3, F.col("c_name")).otherwise(F.concat(named(" CUSTOMER#", k + 9), F.lit(" "))).alias("name"),
    )


@query(
    "resolve_friend_requests",
    f"""WITH {FRIEND_ASKS}, judged AS (
    SELECT request_id, user_id, CASE WHEN trim(a.name) = '' THEN 'empty' WHEN o.id IS NULL THEN 'unknown'
             WHEN o.id = user_id THEN 'self'
             WHEN EXISTS (SELECT 1 FROM closure c WHERE c.viewer_id = user_id AND c.target_id = o.id) THEN 'unknown'
             ELSE 'ok' END AS outcome, o.id, o.name
    FROM asks a LEFT JOIN accounts o ON lower(o.name) = lower(trim(a.name)))
  SELECT request_id, user_id, outcome, CASE WHEN outcome = 'ok' THEN id END AS friend_id,
         CASE WHEN outcome = 'ok' THEN name END AS friend_name FROM judged""",
)
def resolve_friend_requests(d):
    return op.resolve_friend_requests(friend_asks(d), d.accounts, d.blocks)


@query(
    "add_friendships",
    f"""WITH {FRIEND_ASKS}, ok AS (
    SELECT user_id, o.id AS friend_id FROM asks a JOIN accounts o ON lower(o.name) = lower(trim(a.name))
    WHERE o.id <> user_id AND NOT EXISTS (SELECT 1 FROM closure c WHERE c.viewer_id = user_id AND c.target_id = o.id))
  SELECT DISTINCT user_id, friend_id, {AS_OF_SQL} AS since
  FROM (SELECT user_id, friend_id FROM ok UNION SELECT friend_id, user_id FROM ok) n
  WHERE NOT EXISTS (SELECT 1 FROM friendships f WHERE f.user_id = n.user_id AND f.friend_id = n.friend_id)""",
)
def add_friendships(d):
    asked = op.resolve_friend_requests(friend_asks(d), d.accounts, d.blocks).filter("outcome = 'ok'")
    return op.add_friendships(d.friendships, asked.select("user_id", "friend_id"), instant(AS_OF))


@query(
    "resolve_block_requests",
    f"""SELECT c_custkey AS request_id, 'u' || c_custkey AS user_id,
              CASE c_custkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'u' || c_custkey WHEN 2 THEN 'ghost'
                   ELSE 'u' || ((c_custkey + 3) % {N}) END AS target_id,
              CASE c_custkey % 5 WHEN 0 THEN 'missing target' WHEN 1 THEN 'self' WHEN 2 THEN 'unknown' ELSE 'ok' END AS outcome
        FROM customer""",
)
def resolve_block_requests(d):
    k = F.col("c_custkey")
    raw = d.raw("customer").select(
        k.alias("request_id"),
        uid(k).alias("user_id"),
        F.when(k % 5 == 0, "  ").when(k % 5 == 1, uid(k)).when(k % 5 == 2, "ghost")
        .otherwise(F.concat(F.lit(" "), uid((k + 3) % d.n_customers))).alias("target_id"),
    )
    return op.resolve_block_requests(raw, d.accounts)


@query(
    "friends_of",
    """SELECT user_id AS viewer_id, friend_id AS target_id FROM friendships f WHERE NOT EXISTS (
         SELECT 1 FROM closure c WHERE c.viewer_id = f.user_id AND c.target_id = f.friend_id)""",
)
def friends_of(d):
    return op.friends_of(d.friendships, d.accounts, d.blocks)


@query(
    "block_list",
    """SELECT blocker_id, row_number() OVER (PARTITION BY blocker_id ORDER BY b.created_at DESC, blocked_id) AS pos,
              u.id, u.name, u.initial, u.avatar_bg FROM blocks b JOIN accounts u ON u.id = b.blocked_id""",
)
def block_list(d):
    return op.block_list(d.blocks, d.accounts)


# New blocks hit friendships and pending trades on purpose; one in two exists already.
NEW_BLOCKS = """
  asked AS (SELECT user_id AS blocker_id, friend_id AS blocked_id FROM friendships
              WHERE CAST(substring(user_id, 2) AS BIGINT) % 9 = 0
            UNION ALL SELECT to_id, from_id FROM trades WHERE seq % 2 = 0
            UNION ALL SELECT blocker_id, blocked_id FROM blocks WHERE CAST(substring(blocker_id, 2) AS BIGINT) % 2 = 0),
  cut AS (SELECT blocker_id AS a, blocked_id AS b FROM asked UNION SELECT blocked_id, blocker_id FROM asked)"""


def new_blocks(d):
    number = lambda c: F.substring(c, 2, 20).cast("bigint")
    return (
        d.friendships.filter(number("user_id") % 9 == 0).select(F.col("user_id").alias("blocker_id"), F.col("friend_id").alias("blocked_id"))
        .union(d.trades.filter("seq % 2 = 0").select("to_id", "from_id"))
        .union(d.blocks.filter(number("blocker_id") % 2 == 0).select("blocker_id", "blocked_id"))
    )


def _blocked(d):
    return op.apply_blocks(new_blocks(d), d.blocks, d.friendships, d.trades, instant(AS_OF))


@query(
    "apply_blocks",
    f"""WITH {NEW_BLOCKS}
  SELECT blocker_id, blocked_id, created_at FROM blocks
  UNION ALL SELECT DISTINCT blocker_id, blocked_id, {AS_OF_SQL} FROM asked a WHERE NOT EXISTS (
    SELECT 1 FROM blocks b WHERE b.blocker_id = a.blocker_id AND b.blocked_id = a.blocked_id)""",
)
def apply_blocks(d):
    return _blocked(d)[0]


@query(
    "apply_blocks_friendships",
    f"""WITH {NEW_BLOCKS} SELECT user_id, friend_id FROM friendships f
        WHERE NOT EXISTS (SELECT 1 FROM cut c WHERE c.a = f.user_id AND c.b = f.friend_id)""",
)
def apply_blocks_friendships(d):
    return _blocked(d)[1].select("user_id", "friend_id")


@query(
    "apply_blocks_trades",
    f"""WITH {NEW_BLOCKS}
  SELECT id, CASE WHEN hit THEN 'cancelled' ELSE status END AS status,
         CASE WHEN hit THEN {AS_OF_SQL} ELSE resolved_at END AS resolved_at
  FROM (SELECT t.*, status = 'pending' AND EXISTS (SELECT 1 FROM cut c WHERE c.a = t.from_id AND c.b = t.to_id) AS hit
        FROM trades t)""",
)
def apply_blocks_trades(d):
    return _blocked(d)[2].select("id", "status", "resolved_at")


@query(
    "remove_blocks",
    """SELECT blocker_id, blocked_id, created_at FROM blocks
       WHERE CAST(substring(blocker_id, 2) AS BIGINT) % 3 <> 0""",
)
def remove_blocks(d):
    """Every third blocker takes back their own rows; rows against them stay."""
    asked = d.blocks.filter(F.substring("blocker_id", 2, 20).cast("bigint") % 3 == 0)
    return op.remove_blocks(d.blocks, asked)


@query("ingest_reports", f"SELECT *, {AS_OF_SQL} AS created_at FROM reports WHERE CAST(substring(target_id, 2) AS BIGINT) % 4 <> 0")
def ingest_reports(d):
    some = d.lapsed(d.accounts, F.substring("id", 2, 20).cast("bigint") % 4 == 0)
    return reports.ingest_reports(d.raw_reports, some, instant(AS_OF))
