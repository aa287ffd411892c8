"""Dives: ingestion, lifetime and weekly totals, leaderboard, community impact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lagoon.functions.scalars import clamp_minutes, hours_minutes, medal_colour, minted_id
from lagoon.functions.text import nickname_problem, trim_all
from lagoon.operators.social import block_pairs
from lagoon.plans.leaderboard import visible_top

BOARD_SIZE = 25
# Community counters start here.
PEARLS_BASE, PEARLS_PER_MINUTE, PEARLS_PER_CORAL, CORALS_OFFSET, CORALS_MIN = 18442, 2, 500, 34, 2


def monday_of(ts: Column) -> Column:
    return F.date_trunc("week", ts)


def ingest_dives(raw: DataFrame) -> DataFrame:
    """raw(seq, user_id, ts, mins, species_id, nickname) to validated dives.

    Minutes are clamped, never refused. A bad nickname is dropped and reported;
    the catch stands.
    """
    wanted = F.nullif(trim_all(F.col("nickname")), F.lit(""))
    problem = F.when(wanted.isNotNull(), nickname_problem(wanted))
    caught = F.nullif(F.col("species_id"), F.lit(""))
    return raw.select(
        "seq",
        "user_id",
        "ts",
        clamp_minutes(F.col("mins")).alias("mins"),
        caught.alias("species_id"),
        F.when(caught.isNotNull() & problem.isNull(), wanted).alias("nickname"),
        problem.alias("nickname_rejected"),
        F.when(caught.isNotNull(), minted_id("c", F.col("user_id"), F.col("seq"))).alias("creature_id"),
    )


def caught_creatures(dives: DataFrame) -> DataFrame:
    """The creatures ingested dives land."""
    return dives.filter("creature_id is not null").select(
        F.col("creature_id").alias("id"), "user_id", "species_id", "nickname", F.col("ts").alias("caught_at")
    )


def diver_stats(dives: DataFrame) -> DataFrame:
    """Lifetime totals; every dive counts, a catch only with a species."""
    return dives.groupBy("user_id").agg(
        F.sum(F.col("mins").cast("bigint")).alias("total_mins"),
        F.count("*").alias("dives"),
        F.count("species_id").alias("caught"),
    )


def weekly_minutes(dives: DataFrame) -> DataFrame:
    """Each diver's minutes in the last week with a dive, and that week's Monday."""
    per_week = dives.groupBy("user_id", monday_of(F.col("ts")).alias("_week")).agg(
        F.sum(F.col("mins").cast("bigint")).alias("_mins")
    )
    return (
        per_week.groupBy("user_id")
        .agg(F.max("_week").alias("_last"), F.max_by("_mins", "_week").alias("week_mins"))
        .select("user_id", "week_mins", F.to_date("_last").alias("week_start"))
    )


def this_week(dives: DataFrame, as_of: Column) -> DataFrame:
    """Minutes of the current week up to `as_of`: a stale week is simply absent.

    Both bounds are constants on the raw column, so they reach the scan.
    """
    return (
        dives.filter((F.col("ts") >= monday_of(as_of)) & (F.col("ts") <= as_of))
        .groupBy("user_id")
        .agg(F.sum(F.col("mins").cast("bigint")).alias("week_mins"))
    )


def user_stats(users: DataFrame, dives: DataFrame) -> DataFrame:
    """Every account with its totals; accounts without a dive read as zero."""
    totals = diver_stats(dives).withColumnRenamed("user_id", "id")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return users.select("id").join(totals, "id", "left").select(
        F.col("id").alias("user_id"), zero("total_mins"), zero("dives"), zero("caught")
    )


def leaderboard(viewers: DataFrame, users: DataFrame, dives: DataFrame, blocks: DataFrame, as_of: Column) -> DataFrame:
    """Top 25 of this week for every viewer, without whomever the viewer cannot see."""
    week = this_week(dives, as_of).withColumnRenamed("user_id", "id")
    scored = (
        users.select("id", "name", "initial", "avatar_bg", "last_seen")
        .join(week, "id", "left")
        .withColumn("week_mins", F.coalesce("week_mins", F.lit(0)).cast("bigint"))
    )
    order = [F.desc("week_mins"), F.desc("last_seen"), F.asc("id")]
    board = visible_top(viewers, order, scored, block_pairs(blocks), BOARD_SIZE)
    you = F.col("id") == F.col("viewer_id")
    return board.select(
        "viewer_id",
        "rank",
        "id",
        F.when(you, F.concat("name", F.lit(" (you)"))).otherwise(F.col("name")).alias("name"),
        "initial",
        "avatar_bg",
        "week_mins",
        hours_minutes(F.col("week_mins")).alias("time"),
        medal_colour(F.col("rank")).alias("rank_fg"),
        you.alias("you"),
    )


def community_impact(dives: DataFrame) -> DataFrame:
    """One row: pearls and corals the whole community has earned."""
    mins = F.coalesce(F.sum(F.col("mins").cast("bigint")), F.lit(0))
    pearls = mins * PEARLS_PER_MINUTE + PEARLS_BASE
    corals = F.floor(F.col("community_pearls") / F.lit(PEARLS_PER_CORAL)).cast("bigint") - CORALS_OFFSET
    return dives.agg(pearls.cast("bigint").alias("community_pearls")).select(
        "community_pearls", F.greatest(F.lit(CORALS_MIN).cast("bigint"), corals).alias("corals")
    )


def last_active(dives: DataFrame) -> DataFrame:
    return dives.groupBy("user_id").agg(F.max("ts").alias("last_seen"))


def activity_spells(dives: DataFrame, gap: str = "5 minutes") -> DataFrame:
    """Stretches of activity separated by more than the presence threshold.

    Spells are first built hour by hour, then those that touch are merged, so a
    user with very many dives is spread over many tasks; the second step sees at
    most one row per user and gap length.
    """
    hourly = dives.groupBy("user_id", F.date_trunc("hour", "ts").alias("_hour"), F.session_window("ts", gap).alias("w")).agg(
        F.count("*").alias("n")
    )
    return merge_spells(hourly.select("user_id", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), F.col("n").alias("dives")))


def merge_spells(spells: DataFrame) -> DataFrame:
    """spells(user_id, started, ended, dives), those that overlap or touch as one."""
    lasting = F.concat((F.unix_micros("ended") - F.unix_micros("started")).cast("string"), F.lit(" microseconds"))
    return (
        spells.groupBy("user_id", F.session_window("started", lasting).alias("w"))
        .agg(F.sum("dives").alias("dives"))
        .select("user_id", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "dives")
    )
