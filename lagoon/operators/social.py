"""Friends and blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagoon.functions.text import trim_all
from lagoon.plans.ranges import range_position
from lagoon.sources.files import append_new


def both_ways(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Each edge and its reverse, in one pass over the input."""
    here = F.struct(F.col(a).alias(a), F.col(b).alias(b))
    there = F.struct(F.col(b).alias(a), F.col(a).alias(b))
    return edges.select(F.inline(F.array(here, there)))


def block_pairs(blocks: DataFrame) -> DataFrame:
    """(viewer, target) pairs hidden from each other, whoever blocked whom."""
    pairs = both_ways(blocks, "blocker_id", "blocked_id")
    return pairs.toDF("viewer_id", "target_id")


def symmetric_closure(blocks: DataFrame) -> DataFrame:
    return block_pairs(blocks).distinct()


def visible(pairs: DataFrame, blocks: DataFrame, viewer: str = "viewer_id", target: str = "target_id") -> DataFrame:
    """Drop pairs with a block in either direction.

    The closure turns the two-way condition into an equi-join key, so this is a
    hash or merge anti join on (viewer, target) rather than a nested loop.
    """
    hidden = block_pairs(blocks).toDF(viewer, target)
    return pairs.join(hidden, [viewer, target], "left_anti")


def with_blocked_flag(df: DataFrame, blocks: DataFrame, viewer: str, target: str, name: str = "is_blocked") -> DataFrame:
    hidden = symmetric_closure(blocks).toDF(viewer, target).withColumn(name, F.lit(True))
    return df.join(hidden, [viewer, target], "left").withColumn(name, F.coalesce(name, F.lit(False)))


def name_availability(requests: DataFrame, users: DataFrame) -> DataFrame:
    """requests(request_id, name, self_id): is the name free, ignoring case, or already mine?"""
    owners = users.select(F.lower("name").alias("_key"), F.col("id").alias("owner_id"))
    return (
        requests.withColumn("_key", F.lower("name"))
        .join(owners, "_key", "left")
        .withColumn(
            "available",
            F.col("owner_id").isNull() | F.coalesce(F.col("owner_id") == F.col("self_id"), F.lit(False)),
        )
        .drop("_key", "owner_id")
    )


def resolve_friend_requests(raw: DataFrame, users: DataFrame, blocks: DataFrame) -> DataFrame:
    """raw(request_id, user_id, name): the diver named, or why not.

    A block is reported exactly like an unknown name.
    """
    found = users.select(F.lower("name").alias("_key"), F.col("id").alias("friend_id"), F.col("name").alias("friend_name"))
    asked = raw.withColumn("name", trim_all(F.col("name"))).withColumn("_key", F.lower("name"))
    known = with_blocked_flag(asked.join(found, "_key", "left"), blocks, "user_id", "friend_id")
    outcome = (
        F.when(F.coalesce(F.col("name"), F.lit("")) == "", "empty")
        .when(F.col("friend_id").isNull(), "unknown")
        .when(F.col("friend_id") == F.col("user_id"), "self")
        .when(F.col("is_blocked"), "unknown")
        .otherwise("ok")
    )
    ok = F.col("outcome") == "ok"
    return known.withColumn("outcome", outcome).select(
        "request_id",
        "user_id",
        "outcome",
        F.when(ok, F.col("friend_id")).alias("friend_id"),
        F.when(ok, F.col("friend_name")).alias("friend_name"),
    )


def resolve_block_requests(raw: DataFrame, users: DataFrame) -> DataFrame:
    """raw(request_id, user_id, target_id) with an outcome column."""
    asked = raw.withColumn("target_id", trim_all(F.coalesce("target_id", F.lit(""))))
    known = users.select(F.col("id").alias("target_id"), F.lit(True).alias("_known"))
    outcome = (
        F.when(F.col("target_id") == "", "missing target")
        .when(F.col("target_id") == F.col("user_id"), "self")
        .when(F.col("_known").isNull(), "unknown")
        .otherwise("ok")
    )
    return asked.join(known, "target_id", "left").select("request_id", "user_id", "target_id", outcome.alias("outcome"))


def friends_of(friendships: DataFrame, users: DataFrame, blocks: DataFrame) -> DataFrame:
    """(viewer, friend) pairs with both accounts present and no block between them."""
    pairs = friendships.select(F.col("user_id").alias("viewer_id"), F.col("friend_id").alias("target_id"))
    pairs = pairs.filter("viewer_id <> target_id")
    ids = users.select(F.col("id").alias("target_id"))
    return visible(pairs.join(ids, "target_id", "left_semi"), blocks)


def block_list(blocks: DataFrame, users: DataFrame) -> DataFrame:
    """Whom each diver has blocked, newest first (ties by id)."""
    placed = range_position(blocks, ["blocker_id"], [F.desc("created_at"), F.asc("blocked_id")])
    return placed.join(
        users.select("id", "name", "initial", "avatar_bg"), F.col("blocked_id") == F.col("id")
    ).select("blocker_id", "pos", "id", "name", "initial", "avatar_bg")


def add_friendships(friendships: DataFrame, accepted: DataFrame, as_of) -> DataFrame:
    """New rows, both directions, for accepted(user_id, friend_id); existing pairs are left alone."""
    incoming = both_ways(accepted, "user_id", "friend_id").withColumn("since", as_of)
    return append_new(friendships, incoming, ["user_id", "friend_id"], [F.asc("since")])


def apply_blocks(
    new: DataFrame, blocks: DataFrame, friendships: DataFrame, trades: DataFrame, as_of
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Insert blocks, end the friendships and cancel the pending trades between the pairs."""
    incoming = new.select("blocker_id", "blocked_id").withColumn("created_at", as_of)
    added = append_new(blocks, incoming, ["blocker_id", "blocked_id"], [F.asc("created_at")])
    # Side effects follow every request, also one whose block already exists.
    cut = both_ways(new, "blocker_id", "blocked_id").distinct()
    kept = friendships.join(cut.toDF("user_id", "friend_id"), ["user_id", "friend_id"], "left_anti")
    hit = cut.toDF("from_id", "to_id").withColumn("_cut", F.lit(True))
    cancel = F.col("_cut") & (F.col("status") == "pending")
    settled = (
        trades.join(hit, ["from_id", "to_id"], "left")
        .withColumn("resolved_at", F.when(cancel, as_of).otherwise(F.col("resolved_at")))
        .withColumn("status", F.when(cancel, F.lit("cancelled")).otherwise(F.col("status")))
        .select(*trades.columns)
    )
    return blocks.unionByName(added.select(*blocks.columns)), kept, settled


def remove_blocks(blocks: DataFrame, requests: DataFrame) -> DataFrame:
    """Unblock: only the row the caller created goes; a block the other way stays."""
    return blocks.join(requests.select("blocker_id", "blocked_id"), ["blocker_id", "blocked_id"], "left_anti")
