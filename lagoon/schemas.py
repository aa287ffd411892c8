"""Declared schemas of the domain tables (and of the raw event documents)."""

from __future__ import annotations

from pyspark.sql import types as T


_TYPES = {
    "string": T.StringType(),
    "int": T.IntegerType(),
    "bigint": T.LongType(),
    "double": T.DoubleType(),
    "boolean": T.BooleanType(),
    "timestamp": T.TimestampType(),
    "date": T.DateType(),
    "array<string>": T.ArrayType(T.StringType()),
}


def _s(columns: str) -> T.StructType:
    """A schema from "name type, …" (usable before any session exists)."""
    pairs = [c.split() for c in columns.split(",")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


USERS = _s(
    "id string, name string, initial string, avatar_bg string, created_at timestamp, last_seen timestamp, "
    "avatar_url string, email string, email_verified_at timestamp, password_hash string, apple_sub string, "
    "pro_until timestamp, pro_lifetime boolean"
)
USER_SPECIES = _s("user_id string, species_id string, count int")
USER_CREATURES = _s("id string, user_id string, species_id string, nickname string, caught_at timestamp")
USER_STATS = _s(
    "user_id string, total_mins bigint, dives bigint, caught bigint, updated_at timestamp, "
    "week_mins bigint, week_start date"
)
ROOMS = _s(
    "id string, name string, kind string, depth int, schedule string, start_min int, start_at timestamp, "
    "host_id string, created_at timestamp"
)
ROOM_DIVES = _s("id string, room_id string, user_id string, mins int, depth int, ts timestamp")
ROOM_MEMBERS = _s("room_id string, user_id string, joined_at timestamp")
TRADES = _s(
    "id string, from_id string, to_id string, give_id string, get_id string, status string, "
    "created_at timestamp, resolved_at timestamp, give_creature_id string"
)
REPORTS = _s("id string, reporter_id string, target_id string, reason string, created_at timestamp")
FRIENDSHIPS = _s("user_id string, friend_id string, since timestamp")
BLOCKS = _s("blocker_id string, blocked_id string, created_at timestamp")
AUTH_SESSIONS = _s(
    "token_hash string, user_id string, created_at timestamp, last_used timestamp, expires_at timestamp"
)
EMAIL_VERIFICATIONS = _s(
    "token_hash string, user_id string, email string, created_at timestamp, expires_at timestamp"
)
PEARL_GRANTS = _s(
    "transaction_id string, user_id string, product_id string, pearls int, created_at timestamp"
)

TABLES = {
    "users": USERS,
    "user_species": USER_SPECIES,
    "user_creatures": USER_CREATURES,
    "user_stats": USER_STATS,
    "rooms": ROOMS,
    "room_dives": ROOM_DIVES,
    "room_members": ROOM_MEMBERS,
    "trades": TRADES,
    "reports": REPORTS,
    "friendships": FRIENDSHIPS,
    "blocks": BLOCKS,
    "auth_sessions": AUTH_SESSIONS,
    "email_verifications": EMAIL_VERIFICATIONS,
    "pearl_grants": PEARL_GRANTS,
}

# Values a missing column takes when an older table is read under the current schema.
DEFAULTS = {
    "users": {"pro_lifetime": False},
    "user_stats": {"total_mins": 0, "dives": 0, "caught": 0, "week_mins": 0},
    "rooms": {"kind": "room", "schedule": "daily"},
    "trades": {"status": "pending"},
    "user_species": {"count": 0},
}

PURCHASE_EVENT = _s(
    "type string, app_user_id string, original_app_user_id string, product_id string, "
    "entitlement_ids array<string>, transaction_id string, original_transaction_id string, "
    "expiration_at_ms string, purchased_at_ms string"
)

# Columns and types of the parquet inputs the fixture domain is derived from. Declaring
# timestamps as instants keeps time predicates pushable into the scan.
INPUTS = {
    "customer": _s("c_custkey bigint, c_name string"),
    "supplier": _s("s_suppkey bigint, s_name string, s_nationkey int"),
    "part": _s("p_partkey bigint, p_name string"),
    "orders": _s(
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_orderdate timestamp, o_orderpriority string"
    ),
    "lineitem": _s(
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_shipdate timestamp"
    ),
    "events": _s(
        "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"
    ),
    "documents": _s("doc_id bigint, text string"),
    "conversations": _s("conv_id bigint, turn bigint, role string, text string"),
}
