"""Integrity audits over the domain with damage put in by rule."""

from pyspark.sql import functions as F

from lagoon import schemas
from lagoon.operators import audit as op
from lagoon.registry import query
from lagoon.registry.accounts import number, tables
from lagoon.registry.purchases import EFFECTS
from lagoon.sources.files import conform

BAD_ROOMS = """
  bad_rooms AS (SELECT id, CASE WHEN n % 11 = 1 THEN 'cave' ELSE kind END AS kind, CASE WHEN n % 7 = 0 THEN 5 ELSE depth END AS depth,
                       schedule, CASE WHEN n % 5 = 0 THEN 2000 ELSE start_min END AS start_min,
                       CASE WHEN n % 6 = 0 THEN NULL ELSE start_at END AS start_at
                FROM (SELECT *, CAST(substring(id, 2) AS BIGINT) AS n FROM rooms))"""


def damaged(d):
    """Every kind of damage the rules look for, in a share of the rows."""
    t = tables(d)
    n = number("id")
    t["rooms"] = (
        t["rooms"]
        .withColumn("kind", F.when(n % 11 == 1, "cave").otherwise(F.col("kind")))
        .withColumn("depth", F.when(n % 7 == 0, 5).otherwise(F.col("depth")))
        .withColumn("start_min", F.when(n % 5 == 0, 2000).otherwise(F.col("start_min")))
        .withColumn("start_at", F.when(n % 6 != 0, F.col("start_at")))
    )
    t["user_species"] = t["user_species"].withColumn("count", F.col("count") - 1)
    t["room_dives"] = t["room_dives"].withColumn("mins", F.col("mins") - 2)
    t["friendships"] = t["friendships"].withColumn(
        "friend_id", F.when(number("user_id") % 13 == 0, F.col("user_id")).otherwise(F.col("friend_id"))
    )
    return t


@query(
    "audit_checks",
    f"""WITH {EFFECTS}, {BAD_ROOMS}
  SELECT 'user_species' AS "table", 'count not negative' AS rule, count(*) AS bad_rows FROM user_species WHERE count < 1
  UNION ALL SELECT 'rooms', 'kind', count(*) FROM bad_rooms WHERE kind NOT IN ('room', 'expedition')
  UNION ALL SELECT 'rooms', 'depth range', count(*) FROM bad_rooms WHERE depth NOT BETWEEN 10 AND 120
  UNION ALL SELECT 'rooms', 'schedule', count(*) FROM bad_rooms WHERE schedule NOT IN ('daily', 'once')
  UNION ALL SELECT 'rooms', 'start range', count(*) FROM bad_rooms WHERE start_min NOT BETWEEN 0 AND 1439
  UNION ALL SELECT 'rooms', 'depth iff expedition', count(*) FROM bad_rooms WHERE (kind = 'expedition') <> (depth IS NOT NULL)
  UNION ALL SELECT 'rooms', 'start_min iff daily', count(*) FROM bad_rooms WHERE (schedule = 'daily') <> (start_min IS NOT NULL)
  UNION ALL SELECT 'rooms', 'start_at iff once', count(*) FROM bad_rooms WHERE (schedule = 'once') <> (start_at IS NOT NULL)
  UNION ALL SELECT 'room_dives', 'minutes positive', count(*) FROM room_dives WHERE mins <= 2
  UNION ALL SELECT 'room_dives', 'depth range', count(*) FROM room_dives WHERE depth NOT BETWEEN 10 AND 120
  UNION ALL SELECT 'friendships', 'not oneself', count(*) FROM friendships WHERE CAST(substring(user_id, 2) AS BIGINT) % 13 = 0
  UNION ALL SELECT 'blocks', 'not oneself', count(*) FROM blocks WHERE blocker_id = blocked_id
  UNION ALL SELECT 'pearl_grants', 'pearls positive', count(*) FROM grants WHERE pearls <= 0""",
)
def audit_checks(d):
    return op.audit_checks(damaged(d))


# Per table: view with the columns of its keys, the owner whose number decides which rows are doubled, and (rule, key) in SQL.
KEYED = {
    "users": ("SELECT id, name, email, apple_sub FROM accounts", "id", [("id", "id"), ("name", "lower(name)"), ("email", "lower(email)"), ("apple_sub", "apple_sub")]),
    "user_species": ("SELECT user_id, species_id FROM user_species", "user_id", [("key", "user_id || '|' || species_id")]),
    "user_creatures": ("SELECT id, user_id FROM user_creatures", "user_id", [("id", "id")]),
    "user_stats": ("SELECT user_id FROM stats", "user_id", [("key", "user_id")]),
    "rooms": ("SELECT id, host_id FROM rooms", "host_id", [("id", "id")]),
    "room_dives": ("SELECT room_id || '.' || user_id || '.' || mins || '.' || strftime(ts, '%Y%m%d') AS id, user_id FROM room_dives", "user_id", [("id", "id")]),
    "room_members": ("SELECT room_id, user_id FROM room_members", "user_id", [("key", "room_id || '|' || user_id")]),
    "trades": ("SELECT id, from_id FROM trades", "from_id", [("id", "id")]),
    "reports": ("SELECT CAST(conv_id * 1000 + turn AS VARCHAR) AS id, 'u' || (conv_id % (SELECT count(*) FROM customer)) AS reporter_id FROM conversations", "reporter_id", [("id", "id")]),
    "friendships": ("SELECT user_id, friend_id FROM friendships", "user_id", [("key", "user_id || '|' || friend_id")]),
    "blocks": ("SELECT blocker_id, blocked_id FROM blocks", "blocker_id", [("key", "blocker_id || '|' || blocked_id")]),
    "auth_sessions": ("SELECT token_hash, user_id FROM auth_sessions", "user_id", [("key", "token_hash")]),
    "email_verifications": ("SELECT token_hash, user_id FROM email_verifications", "user_id", [("key", "token_hash")]),
    "pearl_grants": ("SELECT transaction_id, user_id FROM grants", "user_id", [("key", "transaction_id")]),
}
DOUBLED = ", ".join(
    f"keyed_{t} AS (SELECT * FROM ({view}) UNION ALL SELECT * FROM ({view}) WHERE CAST(substring({owner}, 2) AS BIGINT) % 17 = 0)"
    for t, (view, owner, _) in KEYED.items()
)


@query(
    "audit_unique",
    f"WITH {EFFECTS}, {DOUBLED} " + " UNION ALL ".join(
        f"SELECT '{t}' AS \"table\", '{rule}' AS rule, {key} AS key, count(*) AS n FROM keyed_{t} WHERE {key} IS NOT NULL GROUP BY {key} HAVING count(*) > 1"
        for t, (_, _, rules) in KEYED.items() for rule, key in rules
    ),
)
def audit_unique(d):
    t = tables(d)
    day = F.date_format("ts", "yyyyMMdd")
    t["room_dives"] = t["room_dives"].withColumn("id", F.concat_ws(".", "room_id", "user_id", F.col("mins").cast("string"), day))
    t["reports"] = t["reports"].withColumn("id", F.col("seq").cast("string"))
    return op.audit_unique({name: df.unionByName(df.filter(number(KEYED[name][1]) % 17 == 0)) for name, df in t.items()})


@query(
    "audit_nulls",
    f"""WITH {EFFECTS},
  worn AS (SELECT id, CASE WHEN CAST(substring(id, 2) AS BIGINT) % 8 <> 5 THEN name END AS name FROM accounts),
  dealt AS (SELECT CASE WHEN CAST(substring(from_id, 2) AS BIGINT) % 9 <> 1 THEN from_id END AS from_id,
                   CASE WHEN CAST(substring(to_id, 2) AS BIGINT) % 7 <> 1 THEN give_id END AS give_id FROM trades)
  SELECT 'users' AS "table", 'name' AS "column", count(*) FILTER (name IS NULL) AS bad_rows FROM worn
  UNION ALL SELECT 'trades', 'from_id', count(*) FILTER (from_id IS NULL) FROM dealt
  UNION ALL SELECT 'trades', 'give_id', count(*) FILTER (give_id IS NULL) FROM dealt
  UNION ALL SELECT 'pearl_grants', 'user_id', count(*) FILTER (user_id IS NULL) FROM grants""",
)
def audit_nulls(d):
    t = tables(d)
    dealt = t["trades"].select(
        F.when(number("from_id") % 9 != 1, F.col("from_id")).alias("from_id"), F.when(number("to_id") % 7 != 1, F.col("give_id")).alias("give_id")
    )
    worn = t["users"].select("id", F.when(number("id") % 8 != 5, F.col("name")).alias("name"))
    return op.audit_nulls({"users": worn, "trades": dealt, "pearl_grants": t["pearl_grants"].select("user_id")})


FK_CHILDREN = [
    ("user_species", "user_id", "user_species"), ("user_creatures", "user_id", "user_creatures"), ("user_stats", "user_id", "stats"),
    ("rooms", "host_id", "rooms"), ("room_dives", "user_id", "room_dives"), ("room_members", "user_id", "room_members"),
    ("trades", "from_id", "trades"), ("trades", "to_id", "trades"),
    ("reports", "reporter_id", "reports"), ("reports", "target_id", "reports"),
    ("friendships", "user_id", "friendships"), ("friendships", "friend_id", "friendships"),
    ("blocks", "blocker_id", "blocks"), ("blocks", "blocked_id", "blocks"),
    ("auth_sessions", "user_id", "auth_sessions"), ("email_verifications", "user_id", "email_verifications"),
    ("pearl_grants", "user_id", "grants"),
]
ORPHANS = " UNION ALL ".join(
    f"SELECT '{t}' AS child, '{c}' AS \"column\", count(*) AS orphans FROM {v} WHERE {c} NOT IN (SELECT id FROM kept)"
    for t, c, v in FK_CHILDREN
)


@query(
    "audit_foreign_keys",
    f"""WITH {EFFECTS}, kept AS (SELECT id FROM accounts WHERE CAST(substring(id, 2) AS BIGINT) % 20 <> 3),
  open AS (SELECT id FROM rooms WHERE CAST(substring(id, 2) AS BIGINT) % 9 <> 4)
  {ORPHANS}
  UNION ALL SELECT 'room_dives', 'room_id', count(*) FROM room_dives WHERE room_id NOT IN (SELECT id FROM open)
  UNION ALL SELECT 'room_members', 'room_id', count(*) FROM room_members WHERE room_id NOT IN (SELECT id FROM open)""",
)
def audit_foreign_keys(d):
    t = tables(d)
    t["users"] = d.lapsed(t["users"], number("id") % 20 == 3)
    t["rooms"] = d.lapsed(t["rooms"], number("id") % 9 == 4)
    return op.audit_foreign_keys(t)


@query(
    "conform",
    """SELECT id, from_id, to_id, give_id, get_id, 'pending' AS status, CAST(created_at AS TIMESTAMP) AS created_at,
              CAST(NULL AS TIMESTAMP) AS resolved_at, CAST(NULL AS VARCHAR) AS give_creature_id FROM trades""",
)
def conform_old_trades(d):
    """Trades as an old table held them: text times, no status, no named creature."""
    old = d.trades.select("get_id", "give_id", "to_id", "from_id", "id", F.col("created_at").cast("string").alias("created_at"))
    return conform(old, schemas.TRADES, schemas.DEFAULTS["trades"])
