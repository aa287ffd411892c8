"""Creatures, spares, friend cards, renames."""

from pyspark.sql import functions as F

from lagoon.operators import activity
from lagoon.operators import collection as op
from lagoon.registry import query
from lagoon.registry.views import AS_OF_SQL, minted_sql
from lagoon.sources.domain import AS_OF, instant, uid


@query("collections", "SELECT * FROM collections")
def collections(d):
    return op.collections(d.user_creatures)


@query("spares", "SELECT * FROM collections WHERE n > 1")
def spares(d):
    return op.spares(d.user_creatures)


@query(
    "newest_spare",
    """SELECT user_id, species_id, id AS creature_id, caught_at FROM (
         SELECT *, row_number() OVER (PARTITION BY user_id, species_id ORDER BY caught_at DESC, id DESC) AS rn,
                count(*) OVER (PARTITION BY user_id, species_id) AS n FROM user_creatures) WHERE rn = 1 AND n > 1""",
)
def newest_spare(d):
    return op.newest_spare(d.user_creatures)


@query(
    "creature_log",
    """SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY caught_at, id) AS pos, id, species_id,
              nickname, caught_at FROM user_creatures""",
)
def creature_log(d):
    return op.creature_log(d.user_creatures)


CARDS = """
  held AS (SELECT user_id, string_agg(species_id, ',' ORDER BY species_id) AS species,
                  coalesce(string_agg(species_id, ',' ORDER BY species_id) FILTER (WHERE n > 1), '') AS spares
           FROM collections GROUP BY 1),
  cards AS (
    SELECT f.user_id AS viewer_id, u.id, u.name, u.initial, u.avatar_bg, coalesce(h.species, '') AS species,
           coalesce(h.spares, '') AS spares, s.total_mins, s.dives, u.last_seen
    FROM friendships f JOIN users u ON u.id = f.friend_id JOIN stats s ON s.user_id = u.id
    LEFT JOIN held h ON h.user_id = u.id
    WHERE NOT EXISTS (SELECT 1 FROM closure c WHERE c.viewer_id = f.user_id AND c.target_id = f.friend_id))"""


@query(
    "friend_cards",
    f"""WITH {CARDS}
  SELECT viewer_id, id, name, initial, avatar_bg, species, spares, total_mins, dives, last_seen,
         total_mins // 60 AS total_hours, (total_mins // 60) || 'h ' || (total_mins % 60) || 'm' AS today,
         CASE WHEN exact < 300000000 THEN 'Active now'
              WHEN exact // 60000000 < 60 THEN 'Last seen ' || (exact // 60000000) || 'm ago'
              WHEN exact // 3600000000 < 24 THEN 'Last seen ' || (exact // 3600000000) || 'h ago'
              ELSE 'Last seen ' || (exact // 86400000000) || 'd ago' END AS status,
         CASE WHEN exact < 300000000 THEN '#1e8a4a' ELSE '#5b7484' END AS status_fg,
         CASE WHEN exact < 300000000 THEN '#4ADE80' ELSE '#b9cdd8' END AS status_colour,
         row_number() OVER (PARTITION BY viewer_id ORDER BY last_seen DESC, id) AS pos
  FROM (SELECT *, date_diff('microsecond', last_seen, TIMESTAMP '2024-01-30 23:59:59') AS exact FROM cards)""",
)
def friend_cards(d):
    cards = op.friend_cards(
        d.friendships, d.users, d.blocks, activity.diver_stats(d.dives), d.user_creatures,
        instant("2024-01-30 23:59:59"),
    )
    return cards.withColumn("species", F.array_join("species", ",")).withColumn("spares", F.array_join("spares", ","))


@query(
    "backfill_creatures",
    f"""SELECT {minted_sql('c', 'user_id', 'species_id', 'i')} AS id, user_id, species_id,
              CAST(NULL AS VARCHAR) AS nickname, {AS_OF_SQL} AS caught_at
        FROM (SELECT user_id, species_id, unnest(range(1, count + 1)) AS i FROM user_species s
              WHERE NOT EXISTS (SELECT 1 FROM user_creatures c WHERE c.user_id = s.user_id))""",
)
def backfill_creatures(d):
    return op.backfill_creatures(d.user_species, d.user_creatures, instant(AS_OF))


# One in six creatures is renamed, some twice, some by a stranger, some badly.
RENAMES = """
  asks AS (SELECT o_orderkey * 2 + t AS seq, 'c' || o_orderkey AS creature_id,
                  CASE WHEN o_orderkey % 30 = 6 THEN 'nobody' ELSE 'u' || o_custkey END AS user_id,
                  CASE WHEN o_orderkey % 24 = 0 THEN '  ' WHEN o_orderkey % 54 = 0 AND t = 1 THEN 'a/b'
                       ELSE ' Pal ' || (o_orderkey % 100) || ' ' || t END AS nickname
           FROM orders, (VALUES (0), (1)) AS v(t) WHERE t = 0 OR o_orderkey % 18 = 0),
  judged AS (SELECT a.seq, a.user_id, a.creature_id, nullif(trim(a.nickname), '') AS nickname,
                    CASE WHEN a.nickname = 'a/b' THEN 'bad characters'
                         WHEN c.user_id IS NULL OR c.user_id <> a.user_id THEN 'no such creature' ELSE 'ok' END AS outcome
             FROM asks a LEFT JOIN user_creatures c ON c.id = a.creature_id)"""


def renames(d):
    k = F.col("o_orderkey")
    text = lambda c: c.cast("string")
    return (
        d.raw("orders")
        .select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("t"))
        .filter((F.col("t") == 0) | (k % 18 == 0))
        .select(
            (k * 2 + F.col("t")).alias("seq"),
            F.concat(F.lit("c"), text(k)).alias("creature_id"),
            F.when(k % 30 == 6, "nobody").otherwise(uid("o_custkey")).alias("user_id"),
            F.when(k % 24 == 0, "  ").when((k % 54 == 0) & (F.col("t") == 1), "a/b")
            .otherwise(F.concat(F.lit(" Pal "), text(k % 100), F.lit(" "), text(F.col("t")))).alias("nickname"),
        )
    )


@query("rename_outcomes", f"WITH {RENAMES} SELECT * FROM judged")
def rename_outcomes(d):
    return op.rename_outcomes(renames(d), d.user_creatures)


@query(
    "apply_renames",
    f"""WITH {RENAMES}, last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY creature_id ORDER BY seq DESC) AS rn
                                 FROM judged WHERE outcome = 'ok') WHERE rn = 1)
  SELECT c.id, c.user_id, c.species_id, CASE WHEN l.creature_id IS NOT NULL THEN l.nickname ELSE c.nickname END AS nickname,
         c.caught_at FROM user_creatures c LEFT JOIN last l ON l.creature_id = c.id""",
)
def apply_renames(d):
    return op.apply_renames(d.user_creatures, renames(d))
