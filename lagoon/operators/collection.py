"""Creatures, collections, spares and friend cards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagoon.functions.scalars import (
    hours_minutes,
    minted_id,
    presence,
    presence_dot_colour,
    presence_text_colour,
    whole_hours,
)
from lagoon.functions.text import nickname_problem, trim_all
from lagoon.operators.social import friends_of
from lagoon.plans.ranges import range_position
from lagoon.plans.skew import first_per_key


def collections(creatures: DataFrame) -> DataFrame:
    """Count per (user, species), derived from the creatures themselves."""
    return creatures.groupBy("user_id", "species_id").agg(F.count("*").alias("n"))


def spares(creatures: DataFrame) -> DataFrame:
    return collections(creatures).filter("n > 1")


def newest_spare(creatures: DataFrame) -> DataFrame:
    """The creature a trade would hand over per (user, species): the newest, ids breaking ties.

    One partial aggregate yields both the count and the pick.
    """
    newest = F.max(F.struct("caught_at", "id"))
    return (
        creatures.groupBy("user_id", "species_id")
        .agg(F.count("*").alias("n"), newest.alias("_newest"))
        .filter("n > 1")
        .select("user_id", "species_id", F.col("_newest.id").alias("creature_id"), F.col("_newest.caught_at").alias("caught_at"))
    )


def creature_log(creatures: DataFrame) -> DataFrame:
    """Every creature with its place in its owner's log, oldest first."""
    return range_position(creatures, ["user_id"], [F.asc("caught_at"), F.asc("id")]).select("user_id", "pos", "id", "species_id", "nickname", "caught_at")


def species_lists(creatures: DataFrame) -> DataFrame:
    """Per user: sorted species held and species with spares.

    Collects (user, species) counts, so an array is as long as the species
    catalogue at most, however many creatures a user holds.
    """
    return (
        collections(creatures)
        .groupBy("user_id")
        .agg(
            F.sort_array(F.collect_list("species_id")).alias("species"),
            F.sort_array(F.collect_list(F.when(F.col("n") > 1, F.col("species_id")))).alias("spares"),
        )
    )


def friend_cards(friendships, users, blocks, stats, creatures, as_of) -> DataFrame:
    """One card per (viewer, friend): species, spares, totals, presence.

    Everything is aggregated per user before it meets the pairs.
    """
    held = species_lists(creatures).withColumnRenamed("user_id", "target_id")
    totals = stats.select(F.col("user_id").alias("target_id"), "total_mins", "dives")
    about = users.select(F.col("id").alias("target_id"), "name", "initial", "avatar_bg")
    seen_last = users.select(F.col("id").alias("target_id"), "last_seen")
    placed = range_position(
        friends_of(friendships, users, blocks).join(seen_last, "target_id"),
        ["viewer_id"],
        [F.desc("last_seen"), F.asc("target_id")],
    )
    none = F.array().cast("array<string>")
    mins, seen = F.coalesce("total_mins", F.lit(0)).cast("bigint"), F.col("last_seen")
    return (
        placed.join(about, "target_id")
        .join(totals, "target_id", "left")
        .join(held, "target_id", "left")
        .select(
            "viewer_id",
            "pos",
            F.col("target_id").alias("id"),
            "name",
            "initial",
            "avatar_bg",
            F.coalesce("species", none).alias("species"),
            F.coalesce("spares", none).alias("spares"),
            mins.alias("total_mins"),
            F.coalesce("dives", F.lit(0)).cast("bigint").alias("dives"),
            "last_seen",
            whole_hours(mins).alias("total_hours"),
            hours_minutes(mins).alias("today"),
            presence(seen, as_of).alias("status"),
            presence_text_colour(seen, as_of).alias("status_fg"),
            presence_dot_colour(seen, as_of).alias("status_colour"),
        )
    )


def backfill_creatures(counts: DataFrame, creatures: DataFrame, as_of) -> DataFrame:
    """Retired counts to one row per creature, for users who hold none yet.

    Zero counts go first: a sequence from 1 to 0 would count downwards.
    """
    return (
        counts.filter("count > 0")
        .join(creatures.select("user_id"), "user_id", "left_anti")
        .withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("count"))))
        .select(
            minted_id("c", F.col("user_id"), F.col("species_id"), F.col("_i")).alias("id"),
            "user_id",
            "species_id",
            F.lit(None).cast("string").alias("nickname"),
            as_of.alias("caught_at"),
        )
    )


def rename_outcomes(requests: DataFrame, creatures: DataFrame) -> DataFrame:
    """requests(seq, user_id, creature_id, nickname): the reason each is refused, or ok.

    Blank clears the nickname. Only the owner may rename.
    """
    asked = requests.withColumn("nickname", trim_all(F.coalesce("nickname", F.lit(""))))
    owners = creatures.select(F.col("id").alias("creature_id"), F.col("user_id").alias("_owner"))
    problem = F.when(F.col("nickname") != "", nickname_problem(F.col("nickname")))
    mine = F.coalesce(F.col("_owner") == F.col("user_id"), F.lit(False))
    return (
        asked.join(owners, "creature_id", "left")
        .withColumn("outcome", F.coalesce(problem, F.when(~mine, F.lit("no such creature")), F.lit("ok")))
        .withColumn("nickname", F.nullif(F.col("nickname"), F.lit("")))
        .select("seq", "user_id", "creature_id", "nickname", "outcome")
    )


def apply_renames(creatures: DataFrame, requests: DataFrame) -> DataFrame:
    """Creatures after the batch: the last valid rename of each wins."""
    valid = rename_outcomes(requests, creatures).filter("outcome = 'ok'")
    last = first_per_key(valid, ["creature_id"], [F.desc("seq")]).select(
        F.col("creature_id").alias("id"), F.col("nickname").alias("_new"), F.lit(True).alias("_renamed")
    )
    return (
        creatures.join(last, "id", "left")
        .withColumn("nickname", F.when(F.col("_renamed"), F.col("_new")).otherwise(F.col("nickname")))
        .select(*creatures.columns)
    )
