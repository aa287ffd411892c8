"""Trade offers: lists, validation, withdrawal, and settlement of acceptances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lagoon.operators.collection import collections
from lagoon.operators.social import visible, with_blocked_flag
from lagoon.plans.ranges import range_position
from lagoon.plans.skew import left_join_known
from lagoon.session import cut_lineage


def pending_sides(trades: DataFrame) -> DataFrame:
    """Each pending trade once per side: incoming for its recipient, outgoing for its proposer."""
    sides = F.array(
        F.struct(F.col("to_id").alias("user_id"), F.lit("incoming").alias("side")),
        F.struct(F.col("from_id").alias("user_id"), F.lit("outgoing").alias("side")),
    )
    return trades.filter("status = 'pending'").select(F.inline(sides), *trades.columns)


def trade_lists(
    trades: DataFrame, users: DataFrame, blocks: DataFrame | None = None, hide_blocked: bool = False
) -> DataFrame:
    """Pending trades per user and side with both names, newest first by `pos`."""
    sides = pending_sides(trades)
    if hide_blocked:
        other = F.when(F.col("side") == "incoming", F.col("from_id")).otherwise(F.col("to_id"))
        sides = visible(sides.withColumn("_other", other), blocks, "user_id", "_other").drop("_other")
    about = lambda p: users.select(
        F.col("id").alias(f"{p}_id"), F.col("name").alias(f"{p}_name"),
        F.col("initial").alias(f"{p}_initial"), F.col("avatar_bg").alias(f"{p}_bg"),
    )
    placed = range_position(sides, ["user_id", "side"], [F.desc("created_at"), F.asc("id")])
    placed = placed.join(about("from"), "from_id").join(about("to").drop("to_initial", "to_bg"), "to_id")
    return placed.select(
        "user_id", "side", "pos", "id", "from_id", "to_id", "from_name", "from_initial", "from_bg",
        "to_name", "give_id", "get_id", "status", "created_at",
    )


def validate_trades(raw: DataFrame, creatures: DataFrame, blocks: DataFrame) -> DataFrame:
    """raw(request_id, from_id, to_id, give_id, get_id, give_creature_id) with the first failing rule.

    A spare is a count of two or more, on both sides. A named creature must be
    the proposer's and of the offered species.
    """
    counts = collections(creatures)
    mine = counts.toDF("from_id", "give_id", "_mine")
    theirs = counts.toDF("to_id", "get_id", "_theirs")
    named = creatures.select(
        F.col("id").alias("give_creature_id"), F.col("user_id").alias("_owner"), F.col("species_id").alias("_species")
    )
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    wanted = F.nullif(F.col("give_creature_id"), F.lit(""))
    joined = with_blocked_flag(raw.withColumn("give_creature_id", wanted), blocks, "from_id", "to_id")
    joined = joined.join(mine, ["from_id", "give_id"], "left").join(theirs, ["to_id", "get_id"], "left")
    joined = left_join_known(cut_lineage(joined), named, ["give_creature_id"])
    owned = F.coalesce((F.col("_owner") == F.col("from_id")) & (F.col("_species") == F.col("give_id")), F.lit(False))
    reason = (
        F.when((text("to_id") == "") | (text("give_id") == "") | (text("get_id") == ""), "fields missing")
        .when(F.col("to_id") == F.col("from_id"), "self")
        .when(F.col("is_blocked"), "blocked")
        .when(F.coalesce("_mine", F.lit(0)) < 2, "no spare to give")
        .when(F.coalesce("_theirs", F.lit(0)) < 2, "no spare to get")
        .when(F.col("give_creature_id").isNotNull() & ~owned, "creature not yours")
    )
    return joined.withColumn("reason", reason).select(
        "request_id", "from_id", "to_id", "give_id", "get_id", "give_creature_id", "reason"
    )


def trades_with_both_spares(trades: DataFrame, creatures: DataFrame) -> DataFrame:
    """Pending trades that could settle right now, each looked at on its own."""
    held = collections(creatures).filter("n > 1").drop("n")
    return (
        trades.filter("status = 'pending'")
        .join(held.toDF("from_id", "give_id"), ["from_id", "give_id"], "left_semi")
        .join(held.toDF("to_id", "get_id"), ["to_id", "get_id"], "left_semi")
    )


def apply_declines(trades: DataFrame, decisions: DataFrame, as_of: Column) -> DataFrame:
    """decisions(trade_id, user_id): either side may withdraw a pending trade."""
    asked = decisions.select(F.col("trade_id").alias("id"), "user_id")
    pending = trades.filter("status = 'pending'").select("id", "from_id", "to_id")
    hit = (
        asked.join(pending, "id")
        .filter((F.col("user_id") == F.col("from_id")) | (F.col("user_id") == F.col("to_id")))
        .select("id", F.lit(True).alias("_hit"))
        .distinct()
    )
    return (
        trades.join(hit, "id", "left")
        .withColumn("status", F.when(F.col("_hit"), "declined").otherwise(F.col("status")))
        .withColumn("resolved_at", F.when(F.col("_hit"), as_of).otherwise(F.col("resolved_at")))
        .select(*trades.columns)
    )
