"""Integrity audits: value rules, uniqueness, orphans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Per table, the rules every row must satisfy (null passes, as in a CHECK).
CHECKS = {
    "user_species": {"count not negative": "count >= 0"},
    "rooms": {
        "kind": "kind in ('room', 'expedition')",
        "depth range": "depth between 10 and 120",
        "schedule": "schedule in ('daily', 'once')",
        "start range": "start_min between 0 and 1439",
        "depth iff expedition": "(kind = 'expedition') = (depth is not null)",
        "start_min iff daily": "(schedule = 'daily') = (start_min is not null)",
        "start_at iff once": "(schedule = 'once') = (start_at is not null)",
    },
    "room_dives": {"minutes positive": "mins > 0", "depth range": "depth between 10 and 120"},
    "friendships": {"not oneself": "user_id <> friend_id"},
    "blocks": {"not oneself": "blocker_id <> blocked_id"},
    "pearl_grants": {"pearls positive": "pearls > 0"},
}
# Per table, the columns that may not be null.
NOT_NULL = {
    "users": ["name", "initial", "avatar_bg", "created_at", "last_seen", "pro_lifetime"],
    "user_species": ["user_id", "species_id", "count"],
    "user_creatures": ["user_id", "species_id", "caught_at"],
    "user_stats": ["total_mins", "dives", "caught", "updated_at", "week_mins"],
    "rooms": ["name", "kind", "schedule", "host_id", "created_at"],
    "room_dives": ["room_id", "user_id", "mins", "depth", "ts"],
    "room_members": ["room_id", "user_id", "joined_at"],
    "trades": ["from_id", "to_id", "give_id", "get_id", "status", "created_at"],
    "reports": ["reporter_id", "target_id", "created_at"],
    "friendships": ["user_id", "friend_id", "since"],
    "blocks": ["blocker_id", "blocked_id", "created_at"],
    "auth_sessions": ["user_id", "created_at", "last_used", "expires_at"],
    "email_verifications": ["user_id", "email", "created_at", "expires_at"],
    "pearl_grants": ["user_id", "product_id", "pearls", "created_at"],
}
# Per table, what must be unique (rows with a null key do not count).
UNIQUE = {
    "users": {"id": ["id"], "name": ["lower(name)"], "email": ["lower(email)"], "apple_sub": ["apple_sub"]},
    "user_species": {"key": ["user_id", "species_id"]},
    "user_creatures": {"id": ["id"]},
    "user_stats": {"key": ["user_id"]},
    "rooms": {"id": ["id"]},
    "room_dives": {"id": ["id"]},
    "room_members": {"key": ["room_id", "user_id"]},
    "trades": {"id": ["id"]},
    "reports": {"id": ["id"]},
    "friendships": {"key": ["user_id", "friend_id"]},
    "blocks": {"key": ["blocker_id", "blocked_id"]},
    "auth_sessions": {"key": ["token_hash"]},
    "email_verifications": {"key": ["token_hash"]},
    "pearl_grants": {"key": ["transaction_id"]},
}
# Fixed values: (child, column, parent); every parent key is `id`.
FOREIGN_KEYS = [
    ("user_species", "user_id", "users"), ("user_creatures", "user_id", "users"), ("user_stats", "user_id", "users"),
    ("rooms", "host_id", "users"), ("room_dives", "room_id", "rooms"), ("room_dives", "user_id", "users"),
    ("room_members", "room_id", "rooms"), ("room_members", "user_id", "users"),
    ("trades", "from_id", "users"), ("trades", "to_id", "users"),
    ("reports", "reporter_id", "users"), ("reports", "target_id", "users"),
    ("friendships", "user_id", "users"), ("friendships", "friend_id", "users"),
    ("blocks", "blocker_id", "users"), ("blocks", "blocked_id", "users"),
    ("auth_sessions", "user_id", "users"), ("email_verifications", "user_id", "users"),
    ("pearl_grants", "user_id", "users"),
]


def audit_checks(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, rule, bad_rows): all rules of a table in one pass over it."""
    parts = []
    for name, df in tables.items():
        rules = CHECKS.get(name)
        if not rules:
            continue
        bad = [F.count_if(F.expr(f"not ({rule})")).alias(label) for label, rule in rules.items()]
        wide = df.agg(*bad)
        pairs = F.array(*[F.struct(F.lit(label).alias("rule"), F.col(f"`{label}`").alias("bad_rows")) for label in rules])
        parts.append(wide.select(F.lit(name).alias("table"), F.inline(pairs)))
    return reduce(DataFrame.unionByName, parts)


def audit_nulls(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, column, bad_rows): nulls where none may be, of the columns a table has; one pass over each table."""
    parts = []
    for name, df in tables.items():
        columns = [c for c in NOT_NULL.get(name, []) if c in df.columns]
        if not columns:
            continue
        wide = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
        pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("bad_rows")) for c in columns])
        parts.append(wide.select(F.lit(name).alias("table"), F.inline(pairs)))
    return reduce(DataFrame.unionByName, parts)


def audit_unique(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, rule, key, n) for every key held by more than one row.

    Each table is read once, its keys stacked; all keys of all tables are counted by
    one aggregate, which counts before the shuffle.
    """
    parts = []
    for name, df in tables.items():
        keys = []
        for rule, columns in UNIQUE.get(name, {}).items():
            first, *rest = [F.expr(c).cast("string") for c in columns]
            second = rest[0] if rest else F.lit("")
            keys.append(F.struct(F.lit(rule).alias("rule"), first.alias("k0"), second.alias("k1"), F.lit(bool(rest)).alias("two")))
        if keys:
            parts.append(df.select(F.lit(name).alias("table"), F.inline(F.array(*keys))))
    stacked = reduce(DataFrame.unionByName, parts).filter("k0 is not null and k1 is not null")
    counted = stacked.groupBy("table", "rule", "k0", "k1", "two").agg(F.count("*").alias("n")).filter("n > 1")
    key = F.when(F.col("two"), F.concat_ws("|", "k0", "k1")).otherwise(F.col("k0"))
    return counted.select("table", "rule", key.alias("key"), "n")


def audit_foreign_keys(tables: dict[str, DataFrame]) -> DataFrame:
    """(child, column, orphans): rows whose parent is missing, for edges with both tables given.

    Each table is read once: its own id, where others refer to it, and what it
    refers to are rows of one stack. An aggregate by (parent, key) then knows
    whether the key is there and how many rows of each edge want it, however hot.
    """
    edges = [e for e in FOREIGN_KEYS if e[0] in tables and e[2] in tables]
    parents = {parent for _, _, parent in edges}
    parts = []
    for name, df in tables.items():
        rows = [(name, "id", -1)] if name in parents else []
        rows += [(parent, column, i) for i, (child, column, parent) in enumerate(edges) if child == name]
        if rows:
            cells = [F.struct(F.lit(p).alias("parent"), F.col(c).alias("key"), F.lit(i).alias("edge")) for p, c, i in rows]
            parts.append(df.select(F.inline(F.array(*cells))))
    stacked = reduce(DataFrame.unionByName, parts).filter("key is not null")
    wanted = [F.count_if(F.col("edge") == i).alias(f"e{i}") for i in range(len(edges))]
    by_key = stacked.groupBy("parent", "key").agg(F.bool_or(F.col("edge") == -1).alias("there"), *wanted)
    sums = [F.coalesce(F.sum(F.when(~F.col("there"), F.col(f"e{i}"))), F.lit(0)).cast("bigint").alias(f"e{i}") for i in range(len(edges))]
    found = [
        F.struct(F.lit(child).alias("child"), F.lit(column).alias("column"), F.col(f"e{i}").alias("orphans"))
        for i, (child, column, _) in enumerate(edges)
    ]
    return by_key.agg(*sums).select(F.inline(F.array(*found)))
