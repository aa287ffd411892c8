"""Rooms: validation, dives, progress, membership."""

from pyspark.sql import functions as F

from lagoon.operators import rooms as op
from lagoon.registry import query
from lagoon.registry.views import AS_OF_SQL, minted_sql
from lagoon.sources.domain import AS_OF, instant, uid

# Room requests: every part row asks for a room, with most rules broken by some.
ROOM_REQUESTS = """
  requests AS (
    SELECT p_partkey AS request_id, 'u' || (p_partkey % 97) AS host_id,
           CASE WHEN p_partkey % 19 = 0 THEN '  ' WHEN p_partkey % 23 = 0 THEN 'k.y.s' ELSE ' ' || p_name || ' ' END AS name,
           CASE p_partkey % 3 WHEN 0 THEN 'room' WHEN 1 THEN 'expedition'
                ELSE CASE WHEN p_partkey % 29 = 2 THEN 'cave' END END AS kind,
           CASE p_partkey % 4 WHEN 0 THEN 'daily' WHEN 1 THEN 'once' WHEN 2 THEN 'once'
                ELSE CASE WHEN p_partkey % 31 = 3 THEN 'weekly' END END AS schedule,
           CASE WHEN p_partkey % 7 = 0 THEN 'deep' WHEN p_partkey % 7 = 1 THEN '1e12' ELSE CAST(p_partkey % 140 AS VARCHAR) || '.5' END AS depth,
           CASE WHEN p_partkey % 5 = 0 THEN CAST(NULL AS VARCHAR) ELSE CAST(p_partkey % 1500 AS VARCHAR) END AS start_min,
           CASE WHEN p_partkey % 6 = 1 THEN 'soon' WHEN p_partkey % 6 = 2 THEN '2024-01-30 11:59:00'
                WHEN p_partkey % 6 = 5 THEN '2024-01-30 11:58:59' ELSE '2024-02-05 10:00:00' END AS start_at
    FROM part),
  checked AS (
    SELECT request_id, host_id, trim(name) AS name, coalesce(kind, 'room') AS kind,
           coalesce(schedule, 'daily') AS schedule, TRY_CAST(depth AS DOUBLE) AS d,
           TRY_CAST(start_min AS DOUBLE) AS m, TRY_CAST(start_at AS TIMESTAMP) AS s
    FROM requests),
  judged AS (
    SELECT *, CASE WHEN name = '' THEN 'name missing' WHEN name = 'k.y.s' THEN 'name blocked'
                   WHEN kind NOT IN ('room', 'expedition') THEN 'unknown kind'
                   WHEN schedule NOT IN ('daily', 'once') THEN 'unknown schedule'
                   WHEN kind = 'expedition' AND (d IS NULL OR d < 10 OR d > 120) THEN 'depth out of range'
                   WHEN schedule = 'daily' AND (m IS NULL OR m < 0 OR m > 1439) THEN 'start time missing'
                   WHEN schedule <> 'daily' AND s IS NULL THEN 'start date missing'
                   WHEN schedule <> 'daily' AND s < TIMESTAMP '2024-01-30 11:59:00' THEN 'start in the past' END AS reason
    FROM checked)"""


def room_requests(d):
    k = F.col("p_partkey")
    text = lambda c: c.cast("string")
    return d.raw("part").select(
        k.alias("request_id"),
        uid(k % 97).alias("host_id"),
        F.when(k % 19 == 0, "  ").when(k % 23 == 0, "k.y.s").otherwise(F.concat(F.lit(" "), "p_name", F.lit(" "))).alias("name"),
        F.when(k % 3 == 0, "room").when(k % 3 == 1, "expedition").when(k % 29 == 2, "cave").alias("kind"),
        F.when(k % 4 == 0, "daily").when((k % 4).isin(1, 2), "once").when(k % 31 == 3, "weekly").alias("schedule"),
        F.when(k % 7 == 0, "deep").when(k % 7 == 1, "1e12").otherwise(F.concat(text(k % 140), F.lit(".5"))).alias("depth"),
        F.when(k % 5 != 0, text(k % 1500)).alias("start_min"),
        F.when(k % 6 == 1, "soon").when(k % 6 == 2, "2024-01-30 11:59:00").when(k % 6 == 5, "2024-01-30 11:58:59")
        .otherwise("2024-02-05 10:00:00").alias("start_at"),
    )


@query(
    "validate_rooms",
    f"""WITH {ROOM_REQUESTS}
  SELECT request_id, host_id, name, kind,
         CASE WHEN kind = 'expedition' THEN TRY_CAST(floor(d + 0.5) AS INTEGER) END AS depth, schedule,
         CASE WHEN schedule = 'daily' THEN TRY_CAST(floor(m + 0.5) AS INTEGER) END AS start_min,
         CASE WHEN schedule <> 'daily' THEN s END AS start_at, reason
  FROM judged""",
)
def validate_rooms(d):
    return op.validate_rooms(room_requests(d), instant(AS_OF))


@query(
    "create_rooms",
    f"""WITH {ROOM_REQUESTS}
  SELECT {minted_sql('r', 'host_id', 'request_id')} AS id, name, kind, schedule,
         host_id AS first_member, {AS_OF_SQL} AS joined_at
  FROM judged WHERE reason IS NULL""",
)
def create_rooms(d):
    rooms, members = op.create_rooms(op.validate_rooms(room_requests(d), instant(AS_OF)), instant(AS_OF))
    first = members.select(F.col("room_id").alias("id"), F.col("user_id").alias("first_member"), "joined_at")
    return rooms.select("id", "name", "kind", "schedule").join(first, "id")


# Raw room dives: some minutes and depths are unusable on purpose.
RAW_DIVES = """
  raw AS (
    SELECT l_orderkey * 10000000 + l_partkey * 100 + l_linenumber AS seq, 'r' || l_suppkey AS room_id,
           'u' || o_custkey AS user_id,
           CASE WHEN l_partkey % 13 = 0 THEN 'NaN'::DOUBLE WHEN l_partkey % 13 = 1 THEN 0.3
                WHEN l_partkey % 13 = 2 THEN -1 WHEN l_partkey % 13 = 3 THEN 1e12 ELSE l_quantity + 0.5 END AS mins,
           CASE WHEN l_partkey % 17 = 0 THEN 9.6 WHEN l_partkey % 17 = 1 THEN 120.4 ELSE 10 + 2 * l_quantity END AS depth,
           l_shipdate AS ts
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
  judged AS (
    SELECT r.*, CASE WHEN isnan(mins) OR mins <= 0 THEN 'minutes missing'
                     WHEN mins > 2147483646 THEN 'minutes out of range'
                     WHEN depth < 10 OR depth > 120 THEN 'depth out of range'
                     WHEN floor(mins + 0.5) < 1 THEN 'minutes round to zero'
                     WHEN m.room_id IS NULL THEN 'not a member' END AS reason
    FROM raw r LEFT JOIN room_members m ON m.room_id = r.room_id AND m.user_id = r.user_id)"""


def raw_room_dives(d):
    p, q = F.col("l_partkey"), F.col("l_quantity")
    return (
        d.raw("lineitem")
        .join(d.raw("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        .select(
            (F.col("l_orderkey") * 10000000 + p * 100 + F.col("l_linenumber")).alias("seq"),
            F.concat(F.lit("r"), F.col("l_suppkey").cast("string")).alias("room_id"),
            uid("o_custkey").alias("user_id"),
            F.when(p % 13 == 0, float("nan")).when(p % 13 == 1, 0.3).when(p % 13 == 2, -1.0).when(p % 13 == 3, 1e12).otherwise(q + 0.5).alias("mins"),
            F.when(p % 17 == 0, 9.6).when(p % 17 == 1, 120.4).otherwise(10 + 2 * q).alias("depth"),
            F.col("l_shipdate").alias("ts"),
        )
    )


@query(
    "ingest_room_dives",
    f"""WITH {RAW_DIVES}
  SELECT CASE WHEN reason IS NULL
              THEN {minted_sql('d', 'room_id', 'user_id', 'seq')} END AS id,
         seq, room_id, user_id, CASE WHEN reason IS NULL THEN CAST(floor(mins + 0.5) AS INTEGER) END AS mins,
         CASE WHEN reason IS NULL THEN CAST(floor(depth + 0.5) AS INTEGER) END AS depth, ts, reason
  FROM judged""",
)
def ingest_room_dives(d):
    return op.ingest_room_dives(raw_room_dives(d), d.room_members)


@query(
    "room_dives_by_members",
    """SELECT room_id, user_id, mins, depth, ts FROM room_dives r
       WHERE EXISTS (SELECT 1 FROM room_members m WHERE m.room_id = r.room_id AND m.user_id = r.user_id)""",
)
def room_dives_by_members(d):
    return op.dives_by_members(d.room_dives.drop("ln"), d.room_members)


@query(
    "room_dives_by_outsiders",
    """SELECT room_id, user_id, mins, depth, ts FROM room_dives r
       WHERE NOT EXISTS (SELECT 1 FROM room_members m WHERE m.room_id = r.room_id AND m.user_id = r.user_id)""",
)
def room_dives_by_outsiders(d):
    return op.dives_by_outsiders(d.room_dives.drop("ln"), d.room_members)


PROGRESS = """
  progress AS (SELECT room_id, count(*) AS dives, CAST(sum(mins) AS BIGINT) AS total_mins,
                      CAST(sum(depth) AS BIGINT) AS shared_depth, CAST(sum(mins) AS BIGINT) // 60 AS corals
               FROM room_dives GROUP BY 1)"""


@query("room_progress", f"WITH {PROGRESS} SELECT * FROM progress")
def room_progress(d):
    return op.room_progress(d.room_dives_by_room)


# Pages of about `size` members, by hash.
def pages(size):
    return f"""
  sized AS (SELECT room_id, greatest(1, CAST(ceil(count(*) / {size}) AS BIGINT)) AS pages FROM room_members GROUP BY 1),
  people AS (
    SELECT m.room_id, u.id, u.initial, u.avatar_bg,
           CAST(('0x' || substring(md5(u.id), 1, 8)) AS BIGINT) % s.pages AS page
    FROM room_members m JOIN accounts u ON u.id = m.user_id JOIN sized s ON s.room_id = m.room_id)"""


@query(
    "room_participants",
    f"""WITH {pages(op.PAGE)}
  SELECT room_id, page, count(*) AS n,
         string_agg(id || ':' || initial || ':' || avatar_bg, ',' ORDER BY id) AS participants
  FROM people GROUP BY 1, 2""",
)
def room_participants(d):
    return _flat(op.room_participants(d.room_members, d.accounts))


@query(
    "room_participants_paged",
    f"""WITH {pages(10)}
  SELECT room_id, page, count(*) AS n,
         string_agg(id || ':' || initial || ':' || avatar_bg, ',' ORDER BY id) AS participants
  FROM people GROUP BY 1, 2""",
)
def room_participants_paged(d):
    return _flat(op.room_participants(d.room_members, d.accounts, page_size=10))


def _flat(df):
    """Arrays as text, which both engines print alike."""
    each = F.transform("participants", lambda p: F.concat_ws(":", p.id, p.initial, p.bg))
    return df.select(
        *[c for c in df.columns if c != "participants"],
        F.size("participants").cast("bigint").alias("n"),
        F.array_join(each, ",").alias("participants"),
    )


@query(
    "room_cards",
    f"""WITH {PROGRESS}, {pages(10)},
  paged AS (SELECT room_id, page, count(*) AS n,
                   string_agg(id || ':' || initial || ':' || avatar_bg, ',' ORDER BY id) AS participants
            FROM people GROUP BY 1, 2)
  SELECT r.pos, r.id, r.name, r.kind, r.depth, r.schedule,
         r.start_min, r.start_at, h.name AS host, r.host_id, coalesce(d.dives, 0) AS dives,
         coalesce(d.total_mins, 0) AS total_mins, coalesce(d.shared_depth, 0) AS shared_depth,
         coalesce(d.corals, 0) AS corals, coalesce(p.page, 0) AS page, coalesce(p.n, 0) AS n,
         coalesce(p.participants, '') AS participants
  FROM (SELECT *, row_number() OVER (ORDER BY created_at DESC, id) AS pos FROM rooms) r
  JOIN accounts h ON h.id = r.host_id LEFT JOIN progress d ON d.room_id = r.id
  LEFT JOIN paged p ON p.room_id = r.id""",
)
def room_cards(d):
    cards = op.room_cards(d.rooms, d.room_members, d.accounts, d.room_dives_by_room, page_size=10)
    return _flat(cards)


@query(
    "rooms_hiding_blocked",
    """SELECT m.user_id AS viewer_id, r.id AS room_id, r.host_id FROM room_members m JOIN rooms r ON r.id = m.room_id
       WHERE NOT EXISTS (SELECT 1 FROM closure c WHERE c.viewer_id = m.user_id AND c.target_id = r.host_id)""",
)
def rooms_hiding_blocked(d):
    pairs = d.room_members.select(F.col("user_id").alias("viewer_id"), "room_id")
    return op.rooms_seen_by(pairs, d.rooms, d.blocks, hide_blocked=True)


# A log that drains every third room: its members leave, and other rooms lose some.
LEAVES = """
  leaves AS (SELECT room_id, user_id FROM room_members
             WHERE CAST(substring(room_id, 2) AS BIGINT) % 3 = 0 OR CAST(substring(user_id, 2) AS BIGINT) % 4 = 0),
  kept AS (SELECT * FROM room_members m WHERE NOT EXISTS
             (SELECT 1 FROM leaves l WHERE l.room_id = m.room_id AND l.user_id = m.user_id)),
  gone AS (SELECT DISTINCT room_id FROM leaves WHERE room_id NOT IN (SELECT room_id FROM kept))"""


def leaves(d):
    number = lambda c: F.substring(c, 2, 20).cast("bigint")
    return d.room_members.filter((number("room_id") % 3 == 0) | (number("user_id") % 4 == 0))


@query(
    "empty_rooms",
    f"""WITH {LEAVES} SELECT r.id, r.name FROM rooms r
        WHERE NOT EXISTS (SELECT 1 FROM kept k WHERE k.room_id = r.id)""",
)
def empty_rooms(d):
    kept = d.room_members.join(leaves(d).select("room_id", "user_id"), ["room_id", "user_id"], "left_anti")
    return op.empty_rooms(d.rooms, kept).select("id", "name")


@query(
    "apply_leaves",
    f"""WITH {LEAVES}
  SELECT 'rooms' AS kind, id AS room_id, CAST(1 AS BIGINT) AS n FROM rooms WHERE id NOT IN (SELECT room_id FROM gone)
  UNION ALL SELECT 'members', room_id, count(*) FROM kept GROUP BY room_id
  UNION ALL SELECT 'dives', room_id, count(*) FROM room_dives WHERE room_id NOT IN (SELECT room_id FROM gone) GROUP BY room_id""",
)
def apply_leaves(d):
    rooms, members, dives = op.apply_leaves(leaves(d), d.rooms, d.room_members, d.room_dives_by_room)
    count = lambda df, kind: df.groupBy("room_id").agg(F.count("*").alias("n")).select(
        F.lit(kind).alias("kind"), "room_id", "n")
    return count(rooms.withColumnRenamed("id", "room_id"), "rooms").unionByName(count(members, "members")).unionByName(
        count(dives, "dives"))


JOINS = """
  asks AS (SELECT event_id AS seq, 'r' || (event_id % (SELECT 2 * count(*) FROM supplier)) AS room_id,
                  'u' || user_id AS user_id, ts FROM events)"""


def joins(d):
    n = 2 * d.raw("supplier").count()
    return d.raw("events").select(
        F.col("event_id").alias("seq"),
        F.concat(F.lit("r"), (F.col("event_id") % n).cast("string")).alias("room_id"),
        uid("user_id").alias("user_id"),
        "ts",
    )


@query(
    "join_outcomes",
    f"""WITH {JOINS}
  SELECT a.*, CASE WHEN r.id IS NULL THEN 'no such room' WHEN m.room_id IS NOT NULL THEN 'already in'
                   ELSE 'joined' END AS outcome
  FROM asks a LEFT JOIN rooms r ON r.id = a.room_id
  LEFT JOIN room_members m ON m.room_id = a.room_id AND m.user_id = a.user_id""",
)
def join_outcomes(d):
    return op.join_outcomes(joins(d), d.rooms, d.room_members)


@query(
    "apply_joins",
    f"""WITH {JOINS}
  SELECT room_id, user_id, joined_at FROM room_members
  UNION ALL
  SELECT room_id, user_id, ts FROM (
    SELECT a.*, row_number() OVER (PARTITION BY room_id, user_id ORDER BY seq) AS rn FROM asks a
    WHERE EXISTS (SELECT 1 FROM rooms r WHERE r.id = a.room_id)
      AND NOT EXISTS (SELECT 1 FROM room_members m WHERE m.room_id = a.room_id AND m.user_id = a.user_id))
  WHERE rn = 1""",
)
def apply_joins(d):
    return op.apply_joins(joins(d), d.rooms, d.room_members)


# A mixed log of all users over all rooms, and some that do not exist.
REPLAY_MEMBERS = "members AS (SELECT room_id, user_id FROM room_members)"


@query(
    "replay_room_events",
    f"""WITH log AS (SELECT event_id AS seq, 'r' || ((event_id * 7 + user_id) % (SELECT count(*) + 9 FROM supplier)) AS room_id, 'u' || user_id AS user_id,
                           CASE WHEN value < 25 THEN 'join' ELSE 'leave' END AS action FROM events),
  {REPLAY_MEMBERS},
  known AS (SELECT l.*, m.user_id IS NOT NULL AS inside FROM log l
            LEFT JOIN members m ON m.room_id = l.room_id AND m.user_id = l.user_id
            WHERE EXISTS (SELECT 1 FROM rooms r WHERE r.id = l.room_id)),
  steps AS (SELECT *, coalesce(lag(action) OVER (PARTITION BY room_id, user_id ORDER BY seq) = 'join', inside) AS was_in
            FROM known),
  heads AS (SELECT s.*, coalesce(n, 0) + CAST(sum(CAST(action = 'join' AS INTEGER) - CAST(was_in AS INTEGER))
                      OVER (PARTITION BY s.room_id ORDER BY seq) AS BIGINT) AS heads
            FROM steps s LEFT JOIN (SELECT room_id, count(*) AS n FROM members GROUP BY 1) c ON c.room_id = s.room_id),
  death AS (SELECT room_id, min(seq) AS at FROM heads WHERE action = 'leave' AND heads = 0 GROUP BY 1)
  SELECT h.seq, h.room_id, h.user_id, h.action,
         CASE WHEN h.seq > d.at THEN 'no such room' WHEN h.seq = d.at THEN 'left and removed'
              WHEN h.action = 'leave' THEN CASE WHEN was_in THEN 'left' ELSE 'was not in' END
              ELSE CASE WHEN was_in THEN 'already in' ELSE 'joined' END END AS outcome,
         CASE WHEN h.seq > d.at THEN NULL ELSE heads END AS members_after
  FROM heads h LEFT JOIN death d ON d.room_id = h.room_id
  UNION ALL
  SELECT seq, room_id, user_id, action, 'no such room', NULL FROM log
  WHERE room_id NOT IN (SELECT id FROM rooms)""",
)
def replay_room_events(d):
    log = d.raw("events").select(
        F.col("event_id").alias("seq"),
        F.concat(F.lit("r"), ((F.col("event_id") * 7 + F.col("user_id")) % (d.raw("supplier").count() + 9)).cast("string")).alias("room_id"),
        uid("user_id").alias("user_id"),
        F.when(F.col("value") < 25, "join").otherwise("leave").alias("action"),
    )
    return op.replay_room_events(log, d.room_members, d.rooms)
