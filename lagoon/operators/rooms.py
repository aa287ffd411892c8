"""Group rooms: definitions, dives, progress, membership and its event log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lagoon.functions.moderation import is_blocked_name
from lagoon.functions.scalars import minted_id, parse_number, round_half_up
from lagoon.functions.text import trim_all
from lagoon.operators.social import visible
from lagoon.plans.ranges import range_position
from lagoon.plans.skew import hash_page, previous_value, running_total
from lagoon.session import cut_lineage
from lagoon.sources.files import append_new

MINUTES_PER_CORAL = 60
PAGE = 1_000


def validate_rooms(raw: DataFrame, as_of: Column) -> DataFrame:
    """raw(request_id, host_id, name, kind, schedule, depth, start_min, start_at), all untrusted text.

    The first failing rule names the reason; numbers are rounded only after they pass.
    """
    name = trim_all(F.coalesce("name", F.lit("")))
    kind, schedule = F.coalesce("kind", F.lit("room")), F.coalesce("schedule", F.lit("daily"))
    depth, start_min = parse_number(F.col("depth")), parse_number(F.col("start_min"))
    start_at = F.col("start_at").try_cast("timestamp")
    within = lambda c, low, high: F.coalesce(c.between(low, high), F.lit(False))
    expedition, daily = kind == "expedition", schedule == "daily"
    reason = (
        F.when(name == "", "name missing")
        .when(is_blocked_name(name), "name blocked")
        .when(~kind.isin("room", "expedition"), "unknown kind")
        .when(~schedule.isin("daily", "once"), "unknown schedule")
        .when(expedition & ~within(depth, 10, 120), "depth out of range")
        .when(daily & ~within(start_min, 0, 1439), "start time missing")
        .when(~daily & start_at.isNull(), "start date missing")
        .when(~daily & (F.timestamp_diff("MILLISECOND", start_at, as_of) > 60_000), "start in the past")
    )
    return raw.select(
        "request_id",
        "host_id",
        name.alias("name"),
        kind.alias("kind"),
        F.when(expedition, round_half_up(depth)).alias("depth"),
        schedule.alias("schedule"),
        F.when(daily, round_half_up(start_min)).alias("start_min"),
        F.when(~daily, start_at).alias("start_at"),
        reason.alias("reason"),
    )


def create_rooms(accepted: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """New rooms and their first members, the hosts, for validated requests."""
    rooms = accepted.filter("reason is null").select(
        minted_id("r", F.col("host_id"), F.col("request_id")).alias("id"),
        "name", "kind", "depth", "schedule", "start_min", "start_at", "host_id",
        as_of.alias("created_at"),
    )
    members = rooms.select(F.col("id").alias("room_id"), F.col("host_id").alias("user_id"), F.col("created_at").alias("joined_at"))
    return rooms, members


def room_dive_problem(mins: Column, depth: Column) -> Column:
    """Checked before rounding. NaN passes comparisons here, so numbers must be finite."""
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    return (
        F.when(bad(mins) | (mins <= 0), "minutes missing")
        .when(mins >= 2.0**31 - 1, "minutes out of range")
        .when(bad(depth) | (depth < 10) | (depth > 120), "depth out of range")
        .when(F.floor(mins + 0.5) < 1, "minutes round to zero")
    )


def ingest_room_dives(raw: DataFrame, members: DataFrame) -> DataFrame:
    """raw(seq, room_id, user_id, mins, depth, ts) with a reason per refused dive."""
    gate = members.select("room_id", "user_id", F.lit(True).alias("_member"))
    mins, depth = F.col("mins"), F.col("depth")
    reason = F.coalesce(room_dive_problem(mins, depth), F.when(F.col("_member").isNull(), "not a member"))
    return (
        raw.join(gate, ["room_id", "user_id"], "left")
        .withColumn("reason", reason)
        .select(
            F.when(F.col("reason").isNull(), minted_id("d", F.col("room_id"), F.col("user_id"), F.col("seq"))).alias("id"),
            "seq",
            "room_id",
            "user_id",
            F.when(F.col("reason").isNull(), round_half_up(mins)).alias("mins"),
            F.when(F.col("reason").isNull(), round_half_up(depth)).alias("depth"),
            "ts",
            "reason",
        )
    )


def dives_by_members(dives: DataFrame, members: DataFrame) -> DataFrame:
    return dives.join(members.select("room_id", "user_id"), ["room_id", "user_id"], "left_semi")


def dives_by_outsiders(dives: DataFrame, members: DataFrame) -> DataFrame:
    return dives.join(members.select("room_id", "user_id"), ["room_id", "user_id"], "left_anti")


def room_progress(dives: DataFrame) -> DataFrame:
    total = F.sum(F.col("mins").cast("bigint"))
    return dives.groupBy("room_id").agg(
        F.count("*").alias("dives"),
        total.alias("total_mins"),
        F.sum(F.col("depth").cast("bigint")).alias("shared_depth"),
    ).withColumn("corals", F.floor(F.col("total_mins") / F.lit(MINUTES_PER_CORAL)).cast("bigint"))


def room_participants(members: DataFrame, users: DataFrame, page_size: int = PAGE) -> DataFrame:
    """(room_id, page, participants): who is in, as sorted arrays.

    An ordinary room is one page. A very large one is spread over pages by a
    hash of the member, so that no task gathers more than about a page.
    """
    people = members.join(users.select(F.col("id").alias("user_id"), "initial", "avatar_bg"), "user_id")
    sizes = members.groupBy("room_id").agg(F.count("*").alias("_size"))
    return (
        people.join(sizes, "room_id")
        .withColumn("page", hash_page(F.col("user_id"), F.col("_size"), page_size))
        .groupBy("room_id", "page")
        .agg(
            F.sort_array(
                F.collect_set(F.struct(F.col("user_id").alias("id"), "initial", F.col("avatar_bg").alias("bg")))
            ).alias("participants")
        )
    )


def room_cards(
    rooms: DataFrame,
    members: DataFrame,
    users: DataFrame,
    dives: DataFrame,
    page_size: int = PAGE,
) -> DataFrame:
    """Every room with host, progress and participants; newest first by `pos`.

    Members and dives are aggregated per room before the join, so neither
    multiplies the other.
    """
    hosts = users.select(F.col("id").alias("host_id"), F.col("name").alias("host"))
    placed = range_position(rooms, [], [F.desc("created_at"), F.asc("id")])
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    people = room_participants(members, users, page_size)
    nobody = F.array().cast("array<struct<id:string,initial:string,bg:string>>")
    return (
        placed.join(hosts, "host_id")
        .withColumnRenamed("id", "room_id")
        .join(room_progress(dives), "room_id", "left")
        .join(people, "room_id", "left")
        .select(
            "pos",
            F.col("room_id").alias("id"),
            "name", "kind", "depth", "schedule", "start_min", "start_at", "host", "host_id",
            zero("dives"), zero("total_mins"), zero("shared_depth"), zero("corals"),
            zero("page"),
            F.coalesce("participants", nobody).alias("participants"),
        )
    )


def rooms_seen_by(pairs: DataFrame, rooms: DataFrame, blocks: DataFrame, hide_blocked: bool = False) -> DataFrame:
    """pairs(viewer_id, room_id) a viewer may be shown.

    Rooms are shared with everybody by default. With `hide_blocked`, pairs whose
    host and viewer have a block between them go.
    """
    hosted = pairs.join(rooms.select(F.col("id").alias("room_id"), "host_id"), "room_id")
    return visible(hosted, blocks, "viewer_id", "host_id") if hide_blocked else hosted


def empty_rooms(rooms: DataFrame, members: DataFrame) -> DataFrame:
    return rooms.join(members.select(F.col("room_id").alias("id")), "id", "left_anti")


def join_outcomes(requests: DataFrame, rooms: DataFrame, members: DataFrame) -> DataFrame:
    """requests(seq, room_id, user_id): joined, already in, or no such room."""
    known = rooms.select(F.col("id").alias("room_id"), F.lit(True).alias("_known"))
    inside = members.select("room_id", "user_id", F.lit(True).alias("_in"))
    return (
        requests.join(known, "room_id", "left")
        .join(inside, ["room_id", "user_id"], "left")
        .withColumn(
            "outcome",
            F.when(F.col("_known").isNull(), "no such room").when(F.col("_in"), "already in").otherwise("joined"),
        )
        .drop("_known", "_in")
    )


def apply_joins(requests: DataFrame, rooms: DataFrame, members: DataFrame) -> DataFrame:
    """Members after a batch of joins(seq, room_id, user_id, ts); repeats are ignored."""
    known = requests.join(rooms.select(F.col("id").alias("room_id")), "room_id", "left_semi")
    added = append_new(members, known, ["room_id", "user_id"], [F.asc("seq")])
    return members.unionByName(added.select("room_id", "user_id", F.col("ts").alias("joined_at")))


def apply_leaves(
    leaves: DataFrame, rooms: DataFrame, members: DataFrame, dives: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rooms, members and dives after a batch of leaves(room_id, user_id).

    A room that had a leave and has nobody left goes, with its dives. Rooms
    that were empty without a leave stay.
    """
    left = members.join(leaves.select("room_id", "user_id"), ["room_id", "user_id"], "left_anti")
    touched = leaves.select("room_id").distinct()
    gone = touched.join(left.select("room_id"), "room_id", "left_anti")
    return (
        rooms.join(gone.withColumnRenamed("room_id", "id"), "id", "left_anti"),
        left,
        dives.join(gone, "room_id", "left_anti"),
    )


def replay_room_events(events: DataFrame, members: DataFrame, rooms: DataFrame) -> DataFrame:
    """Outcome of each event(seq ≥ 0, room_id, user_id, action join|leave), as if played one by one.

    Who is inside changes only when a (room, user) pair switches, so each event
    is a step of -1, 0 or +1; the room dies at its first leave that brings the
    running head count to zero, and later events find no room. Counts and
    previous actions are carried across slices of the log, so a room or a pair
    with a large share of all events is still spread over many tasks.
    """
    known = events.join(rooms.select(F.col("id").alias("room_id")), "room_id", "left_semi")
    inside = members.select("room_id", "user_id", F.lit(True).alias("_inside"))
    paired = previous_value(known, ["room_id", "user_id"], "seq", "action", "_before")
    stepped = (
        paired.join(inside, ["room_id", "user_id"], "left")
        .withColumn(
            "_was_in",
            F.coalesce(F.col("_before") == "join", F.coalesce("_inside", F.lit(False))),
        )
        .withColumn("_is_in", F.col("action") == "join")
        .withColumn("_step", F.col("_is_in").cast("int") - F.col("_was_in").cast("int"))
    )
    # Each stage is read twice below; materialising it keeps the work linear in the log.
    stepped = cut_lineage(stepped.select("seq", "room_id", "user_id", "action", "_was_in", "_step"))
    heads = members.groupBy("room_id").agg(F.count("*").alias("_heads"))
    counted = cut_lineage(
        running_total(stepped, ["room_id"], "seq", "_step", "_moved")
        .join(heads, "room_id", "left")
        .withColumn("members_after", F.coalesce("_heads", F.lit(0)) + F.col("_moved"))
    )
    death = (
        counted.filter("action = 'leave' and members_after = 0")
        .groupBy("room_id")
        .agg(F.min("seq").alias("_death"))
    )
    too_late = F.coalesce(F.col("seq") > F.col("_death"), F.lit(False))
    outcome = (
        F.when(too_late, "no such room")
        .when(F.col("seq") == F.col("_death"), "left and removed")
        .when(F.col("action") == "leave", F.when(F.col("_was_in"), "left").otherwise("was not in"))
        .otherwise(F.when(F.col("_was_in"), "already in").otherwise("joined"))
    )
    played = counted.join(death, "room_id", "left").select(
        "seq",
        "room_id",
        "user_id",
        "action",
        outcome.alias("outcome"),
        F.when(~too_late, F.col("members_after")).cast("bigint").alias("members_after"),
    )
    unknown = events.join(rooms.select(F.col("id").alias("room_id")), "room_id", "left_anti").select(
        "seq", "room_id", "user_id", "action",
        F.lit("no such room").alias("outcome"), F.lit(None).cast("bigint").alias("members_after"),
    )
    return played.unionByName(unknown)
